"""An audit log whose entries carry the hash of the one before, and checks of stored frames."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import base4_encode, fnv1a64, mirror

GENESIS = "0" * 64


def _payload(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in columns]))


def chained(entries: DataFrame, stream: str, seq: str, previous: dict[str, str] | None = None) -> DataFrame:
    """entries with prev_hash and entry_hash, one chain for each value of stream, ordered by seq.

    A chain is sequential, so each stream is folded in order by one task; rows
    arrive in batches and only the last hash is kept.
    """
    columns, before = list(entries.columns), previous or {}
    sorted_rows = entries.withColumn("_payload", _payload(columns)).withColumn("_stream", F.col(stream).cast("string")).repartition(F.col(stream)).sortWithinPartitions(stream, seq)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str | None, str] = {}
        for batch in batches:
            prev, own = [], []
            for name, body in zip(batch.column("_stream").to_pylist(), batch.column("_payload").to_pylist()):
                p = last.get(name) or before.get(name, GENESIS)
                h = hashlib.sha256(f"{p}|{body}".encode()).hexdigest()
                prev.append(p)
                own.append(h)
                last = {name: h}
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), pa.array(prev, pa.string()), pa.array(own, pa.string())], [*columns, "prev_hash", "entry_hash"])

    kinds = dict(entries.dtypes)
    return sorted_rows.mapInArrow(fold, ", ".join([f"`{c}` {kinds[c]}" for c in columns] + ["prev_hash string", "entry_hash string"]))


def first_broken(chain: DataFrame, stream: str, seq: str) -> DataFrame:
    """(stream, broken): for each chain with a fault the least seq at which a hash or a link doesn't hold."""
    columns = [c for c in chain.columns if c not in ("prev_hash", "entry_hash")]
    recomputed = F.sha2(F.concat_ws("|", F.coalesce("prev_hash", F.lit("")), _payload(columns)).cast("binary"), 256)
    before = F.coalesce(F.lag("entry_hash").over(Window.partitionBy(stream).orderBy(seq)), F.lit(GENESIS))
    marked = chain.withColumn("_bad", ~(recomputed.eqNullSafe(F.col("entry_hash")) & F.col("prev_hash").eqNullSafe(before)))
    return marked.where("_bad").groupBy(stream).agg(F.min(seq).alias("broken"))


def digest(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", *columns).cast("binary"), 256)


def with_checksum(df: DataFrame, payload: str) -> DataFrame:
    return df.withColumn("crc", F.crc32(F.col(payload).cast("binary")))


def materialised(entries: DataFrame, seq: str, payload: str, collection: str) -> DataFrame:
    """A log entry as a stored frame: its number, collection, base-4 symbols, their mirror, the hash of the whole payload as its one field entry, and a checksum."""
    raw = F.col(payload).cast("binary")
    framed = entries.select(F.col(seq).cast("long").alias("signature"), F.lit(collection).alias("collection"), raw.alias("payload"), base4_encode(raw).alias("symbols"))
    entry = F.array(F.struct(F.lit("_payload").alias("field_name"), F.lit(0).alias("offset"), F.length("symbols").alias("length"), fnv1a64(F.col("payload")).alias("value_hash")))
    return framed.select("*", mirror(F.col("symbols")).alias("mirror"), entry.alias("entries"), F.crc32("payload").alias("crc"))


def scrub(frames: DataFrame, checksums: DataFrame, key: str, payload: str) -> DataFrame:
    """(checked, missing, corrupt): frames with a stored checksum, without one, and with another one."""
    joined = frames.join(checksums.select(F.col(key).alias("_k"), F.col("crc").alias("_crc")), F.col(key) == F.col("_k"), "left")
    bad = F.crc32(F.col(payload).cast("binary")) != F.col("_crc")
    return joined.agg(F.count("_crc").alias("checked"), F.count(F.when(F.col("_crc").isNull(), 1)).alias("missing"), F.count(F.when(bad, 1)).alias("corrupt"))
