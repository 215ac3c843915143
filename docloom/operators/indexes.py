"""Index-like operators as relations: postings, ranges, segment statistics, dictionaries, trigrams, Bloom bits.

Postings are (value, id) rows sorted within partitions, not one list a value, so
a frequent value needs no single large row; summaries are aggregates.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scalar import trigrams
from ..plans.plan import PlanError
from ..sources.files import Files
from .predicates import like

DICTIONARY = 254  # codes of a segment's dictionary


def exact_index(df: DataFrame, field: str, id_field: str) -> DataFrame:
    """(value, id) for each record that has the field, laid out by value; lookup is a filter."""
    return df.where(F.col(field).isNotNull()).select(F.col(field).alias("value"), F.col(id_field).alias("id"))


def index_summary(index: DataFrame) -> DataFrame:
    return index.groupBy("value").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def range_lookup(index: DataFrame, low: Any = None, high: Any = None, low_open: bool = False, high_open: bool = False) -> DataFrame:
    out = index
    if low is not None:
        out = out.where(F.col("value") > low if low_open else F.col("value") >= low)
    if high is not None:
        out = out.where(F.col("value") < high if high_open else F.col("value") <= high)
    return out


def save_index(index: DataFrame, path: str) -> None:
    """Sorted by value, so that file statistics prune lookups."""
    index.repartitionByRange("value").sortWithinPartitions("value", "id").write.mode("overwrite").parquet(path)


def composite_layout(df: DataFrame, filter_field: str, order_field: str) -> DataFrame:
    """Records laid out by the field of an equality and then the field of an order: a top-k of one value reads few row groups."""
    return df.repartitionByRange(filter_field, order_field).sortWithinPartitions(filter_field, order_field)


@dataclass
class IndexCatalogue:
    """Saved indexes of one collection under a root: a manifest, a folder for each field and one for each composite."""

    spark: SparkSession
    root: str
    hash_fields: tuple[str, ...] = ()
    range_fields: tuple[str, ...] = ()
    composites: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def _folder(kind: str, *fields: str) -> str:
        return f"{kind}-{hashlib.sha256(json.dumps(fields).encode()).hexdigest()[:32]}"

    def _path(self, kind: str, *fields: str) -> str:
        return f"{self.root.rstrip('/')}/{self._folder(kind, *fields)}"

    def rebuild(self, df: DataFrame, id_field: str) -> IndexCatalogue:
        """Write all indexes from the records, the manifest last."""
        for field in self.hash_fields:
            save_index(exact_index(df, field, id_field), self._path("hash", field))
        for field in self.range_fields:
            save_index(exact_index(df, field, id_field), self._path("range", field))
        for pair in self.composites:
            composite_layout(df, *pair).write.mode("overwrite").parquet(self._path("composite", *pair))
        Files(self.spark, self.root).write("manifest.json", json.dumps({"hash": self.hash_fields, "range": self.range_fields, "composite": self.composites}))
        return self

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> IndexCatalogue:
        files = Files(spark, root)
        if not files.exists("manifest.json"):
            raise PlanError(f"no indexes under {root}")
        kept = json.loads(files.read("manifest.json"))
        return cls(spark, root, tuple(kept["hash"]), tuple(kept["range"]), tuple(map(tuple, kept["composite"])))

    def exact(self, field: str, value: Any) -> DataFrame:
        """(value, id) of the records whose field has the value."""
        if field not in self.hash_fields:
            raise PlanError(f"no hash index on {field}")
        return range_lookup(self.spark.read.parquet(self._path("hash", field)), value, value)

    def between(self, field: str, low: Any = None, high: Any = None, low_open: bool = False, high_open: bool = False) -> DataFrame:
        if field not in self.range_fields:
            raise PlanError(f"no range index on {field}")
        return range_lookup(self.spark.read.parquet(self._path("range", field)), low, high, low_open, high_open)

    def top(self, filter_field: str, value: Any, order_field: str, n: int, descending: bool = True) -> DataFrame:
        """The first n records of one value, by a composite."""
        if (filter_field, order_field) not in self.composites:
            raise PlanError(f"no composite of {filter_field} and {order_field}")
        found = self.spark.read.parquet(self._path("composite", filter_field, order_field)).where(F.col(filter_field) == value)
        return found.orderBy(F.desc(order_field) if descending else F.asc(order_field)).limit(n)


def intersect_ids(*candidates: DataFrame) -> DataFrame:
    """Ids found by all lookups."""
    return reduce(lambda a, b: a.join(b.select("id"), "id", "left_semi"), [c.select("id").distinct() for c in candidates])


def trigram_postings(df: DataFrame, field: str, id_field: str) -> DataFrame:
    """(gram, id), one row for each distinct trigram of a record."""
    return df.select(F.explode(trigrams(F.col(field))).alias("gram"), F.col(id_field).alias("id"))


def trigram_candidates(df: DataFrame, postings: DataFrame, field: str, id_field: str, text: str) -> DataFrame:
    """Records whose field holds text, found by its trigrams and verified; short texts are scanned for."""
    grams = sorted({text[i : i + 3] for i in range(len(text) - 2)})
    found = df
    if grams:
        hits = postings.where(F.col("gram").isin(grams)).groupBy("id").agg(F.count("*").alias("hits")).where(F.col("hits") == len(grams))
        found = df.join(hits, df[id_field] == hits["id"], "left_semi")
    return found.where(like(F.col(field), f"%{text}%") if "%" not in text and "_" not in text else F.col(field).contains(text))


def segment_of(id_field: str, size: int) -> Column:
    return F.floor(F.col(id_field) / size).cast("long")


def segment_stats(df: DataFrame, id_field: str, size: int, **fields: str) -> DataFrame:
    """(segment_id, n, min_x, max_x ...) with fields given as x=column."""
    marks = [f(c).alias(f"{n}_{x}") for x, c in fields.items() for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(segment_of(id_field, size).alias("segment_id")).agg(F.count("*").alias("n"), *marks)


def bounds_allow(x: str, op: str, value: Any) -> Column:
    """Whether a segment may hold a record whose x meets the condition, by typed bounds."""
    low, high = F.col(f"min_{x}"), F.col(f"max_{x}")
    return {"eq": (low <= value) & (high >= value), "gt": high > value, "gte": high >= value, "lt": low < value, "lte": low <= value, "ne": (low != value) | (high != value)}[op]


def may_match(stats: DataFrame, x: str, op: str, value: Any) -> DataFrame:
    return stats.where(bounds_allow(x, op, value))


def skip_counts(stats: DataFrame, x: str, op: str, value: Any) -> DataFrame:
    """(blocks, skipped) in one pass."""
    return stats.agg(F.count("*").alias("blocks"), F.count(F.when(~bounds_allow(x, op, value), 1)).alias("skipped"))


def pruned(df: DataFrame, segments: DataFrame, id_field: str, size: int) -> DataFrame:
    """Records of the given segments."""
    return df.withColumn("_segment", segment_of(id_field, size)).join(segments.select(F.col("segment_id").alias("_segment")), "_segment", "left_semi").drop("_segment")


def value_dictionary(df: DataFrame, field: str, id_field: str, size: int) -> DataFrame:
    """(segment_id, value, freq, code): a segment's most frequent values, ties by value."""
    counts = df.where(F.col(field).isNotNull()).groupBy(segment_of(id_field, size).alias("segment_id"), F.col(field).alias("value")).agg(F.count("*").alias("freq"))
    code = F.row_number().over(Window.partitionBy("segment_id").orderBy(F.desc("freq"), "value"))
    return counts.withColumn("code", code).where(F.col("code") <= DICTIONARY)


def dictionary_coverage(df: DataFrame, dictionary: DataFrame, field: str, id_field: str, size: int) -> DataFrame:
    """(segment_id, covered, total, complete)."""
    totals = df.where(F.col(field).isNotNull()).groupBy(segment_of(id_field, size).alias("segment_id")).agg(F.count("*").alias("total"))
    covered = dictionary.groupBy("segment_id").agg(F.sum("freq").alias("covered"))
    return totals.join(covered, "segment_id", "left").select("segment_id", F.coalesce("covered", F.lit(0)).cast("long").alias("covered"), "total", (F.coalesce("covered", F.lit(0)) == F.col("total")).alias("complete"))


def _bloom_places(value: Column, bits: int) -> Column:
    """Three places in a filter, from one digest of the value's text."""
    digest = F.md5(value.cast("string").cast("binary"))
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") % bits for i in range(3)])


def bloom_bits(df: DataFrame, field: str, id_field: str, size: int, bits: int = 4096) -> DataFrame:
    """(segment_id, bit): the set bits of each segment's Bloom filter, at most bits a segment."""
    return df.where(F.col(field).isNotNull()).select(segment_of(id_field, size).alias("segment_id"), F.explode(_bloom_places(F.col(field), bits)).alias("bit")).distinct()


def bloom_candidates(bits_of: DataFrame, value: Any, bits: int = 4096) -> DataFrame:
    """Segments whose filter may hold the value."""
    at = F.array_distinct(_bloom_places(F.lit(value), bits))
    wanted = bits_of.where(F.array_contains(at, F.col("bit")))
    return wanted.groupBy("segment_id").agg(F.count("*").alias("hits")).where(F.col("hits") == F.size(at)).select("segment_id")


def selectivity(df: DataFrame, *fields: str) -> DataFrame:
    """(field, selectivity): one over the distinct values, all fields in one pass."""
    wide = df.agg(*[F.count_distinct(F.col(f)).alias(f) for f in fields])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (1.0 / F.col(f)).alias("selectivity")) for f in fields]))
    return wide.select(pairs.alias("p")).select("p.field", "p.selectivity")


# fixed values: upper bounds of the latency classes, in milliseconds
LATENCIES = (1, 5, 10, 25, 50, 100, 250, 500, 1000)


def latency_histogram(df: DataFrame, field: str, bounds: tuple[int, ...] = LATENCIES) -> DataFrame:
    """(le, n): rows at or under each bound, in one pass."""
    wide = df.agg(*[F.count(F.when(F.col(field) <= b, 1)).alias(f"b{b}") for b in bounds])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{b}").alias("n")) for b in bounds])).alias("p")).select("p.le", "p.n")
