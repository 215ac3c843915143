"""Operator 10: exact substring deduplication on a compacted de Bruijn graph of tokens.

* k-mers as edges. Every run of k = 20 words is an edge. An edge is filed under
  its least 8-word hash (a minimizer), which equal edges share; consecutive
  edges of a document under one minimizer travel as one unit, so a unit is a
  piece of a path, and only units whose minimizer comes back matter.
* First places. Within a block of text, then within a minimizer's group, the
  least (doc_id, start) of each edge is its source; every other place repeats
  it. Places that repeat one inside a block go no further, so the commonest
  passage sends one unit for each block and not one for each document.
* Compaction. Repeated edges whose sources also follow each other form a
  nonbranching path; successive pieces are joined to maximal spans
  (doc, start, n, source doc, source start).
* Verification. The source of each span is read again from its text, and the words
  of both places are compared by a cryptographic digest where they are removed; a
  span that doesn't hold stays.

Edges are told apart by 48 bits of the window's hash, and by 32 of the minimizer's
and the part it is filed in. Among a million different windows of one minimizer 0.002
pairs are expected to share a mark; such a pair could leave a repeat, never take words.

A document is a doc_id and a text. Most ids have one text; where one has several,
each is a variant, numbered by 32 bits of its hash, and a place is
(doc, variant, start), the last two in one number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import kernels as K
from .storage import column, cut, lean

U = np.uint64
EDGE = 20  # words of a window
SEED = 8  # words of a minimizer
COMBINE_BYTES = 3 << 20  # text whose repeats are found before anything is shuffled
MARK_BITS = 48  # by which a minimizer's windows are told apart
LONGEST_UNIT = 60_000  # edges
GROUP_BYTES = 6 << 20  # aimed at for one group of units
START_BITS = 31  # of a place; the variant is above them
START = (1 << START_BITS) - 1
BROADCAST_IDS = 500_000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width values."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1])
    return out


def _edges(words: K.Words, doc_ids: np.ndarray, variants: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Window hash, minimizer, document and start (below its variant) of each edge."""
    h = words.hashes()
    at, docs = K.inside(words.first, k)
    if not len(at):
        return np.empty(0, U), np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    seeds = min(SEED, k)
    low = _sliding_min(K.windows(h, seeds), k - seeds + 1)
    return K.windows(h, k)[at], low[at], doc_ids[docs], at - words.first[docs] + (variants << START_BITS)[docs]


def _runs(doc: np.ndarray, start: np.ndarray, source: np.ndarray, source_start: np.ndarray) -> list[np.ndarray]:
    """Consecutive places with consecutive sources, as (doc, start, n, source, source start)."""
    order = np.lexsort((start, doc))
    doc, start, source, source_start = doc[order], start[order], source[order], source_start[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (source[1:] != source[:-1]) | (source_start[1:] != source_start[:-1] + 1)
    at = np.flatnonzero(head)
    return [doc[at], start[at], np.diff(np.append(at, len(doc))), source[at], source_start[at]]


def _repeats(key: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which places are the first of their key, or equal to it, and the runs of the others."""
    order = np.lexsort((start, doc, *key))
    head = np.zeros(len(order), bool)
    head[:1] = True
    for x in key:
        x = x[order]
        head[1:] |= x[1:] != x[:-1]
    rest, heads = np.flatnonzero(~head), np.flatnonzero(head)
    at, source = order[rest], order[heads[np.searchsorted(heads, rest) - 1]]
    again = (doc[at] != doc[source]) | (start[at] != start[source])
    at, source = at[again], source[again]
    first = np.ones(len(doc), bool)
    first[at] = False
    return first, _runs(doc[at], start[at], doc[source], start[source])


def _stretches(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers at, at + 1, ..., n of them, of each stretch."""
    out = np.ones(n.sum(), np.int64)
    ends = np.cumsum(n)[:-1]
    out[:1] = at[:1]
    out[ends] = at[1:] - at[:-1] - n[:-1] + 1
    return np.cumsum(out, out=out)


def _packed(marks: np.ndarray) -> bytes:
    """The lower 48 bits of each."""
    return marks.astype(np.uint32).tobytes() + (marks >> U(32)).astype(np.uint16).tobytes()


def _unpacked(raws: list[bytes], at: np.ndarray) -> np.ndarray:
    """The marks at these places of all."""
    sizes = [len(x) // 6 for x in raws]
    low = np.concatenate([np.frombuffer(x, np.uint32, n) for x, n in zip(raws, sizes)])[at]
    high = np.concatenate([np.frombuffer(x, np.uint16, n, 4 * n) for x, n in zip(raws, sizes)])[at]
    return low | high.astype(U) << U(32)


def _file(parts: int, k: int):
    """Units by part, packed, and the repeats that a block shows by itself."""
    fields = ["part", "seeds", "docs", "starts", "variants", "sizes", "marks", "repeats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [list(x) for x in zip(*held)]
            held.clear()  # each column's pieces go when it is made
            mark, seed, doc, start = (np.concatenate(columns.pop(0)) for _ in range(4))
            first, repeats = _repeats((mark,), doc, start)
            mark = mark[first]
            seed = seed[first]
            doc = doc[first]
            start = start[first]
            head = np.ones(len(mark), bool)
            head[1:] = (seed[1:] != seed[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
            at = np.flatnonzero(head)
            if (n := np.diff(np.append(at, len(mark)))).max(initial=0) > LONGEST_UNIT:
                at = np.concatenate([np.arange(a, a + m, LONGEST_UNIT) for a, m in zip(at, n)])
                n = np.diff(np.append(at, len(mark)))
            seed, doc, start = seed[at], doc[at], start[at]
            part = (K.mix(seed, 11) % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
            marks = mark[_stretches(at[order], n[order])] & U((1 << MARK_BITS) - 1)
            del mark, first, head
            ends = np.append(cuts, len(order))
            edge_ends = np.concatenate(([0], np.cumsum(n[order])))
            pack = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
            seed, doc, start = seed[order], doc[order], start[order]
            shown = np.array_split(np.stack([x.astype(np.int64) for x in repeats]), len(cuts), axis=1)  # over all parts, as any may have them
            return pa.RecordBatch.from_arrays(
                [pa.array(part[order][cuts]), pack(seed.astype(np.uint32)), pack(doc), pack((start & START).astype(np.int32)), pack((start >> START_BITS).astype(np.uint32)) if (start >> START_BITS).any() else pa.array([b""] * len(cuts), pa.binary()), pack(n[order].astype(np.uint16)), pa.array([_packed(marks[edge_ends[a] : edge_ends[b]]) for a, b in zip(ends, ends[1:])], pa.binary()), pa.array([x.tobytes() for x in shown], pa.binary())], fields
            )

        for rows, words in K.blocks(batches):
            edges = _edges(words, rows.column("doc").to_numpy(), rows.column("variant").to_numpy(), k)
            if len(edges[0]):
                held.append(edges)
            size += len(words.data)
            if size >= COMBINE_BYTES:
                if held:
                    yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _first_places(table: pa.Table) -> pa.Table:
    """Runs of repeated edges of one part."""
    read = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    passed = [np.frombuffer(x, np.int64).reshape(5, -1) for x in table["repeats"].to_pylist() if x]
    seed, doc, start, n = read("seeds", np.uint32), read("docs", np.int64), read("starts", np.int32).astype(np.int64), read("sizes", np.uint16).astype(np.int64)
    if any(variants := table["variants"].to_pylist()):
        sizes = [len(x) // 8 for x in table["docs"].to_pylist()]
        start += np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) if x else np.zeros(m, np.int64) for x, m in zip(variants, sizes)]) << START_BITS
    order = np.argsort(seed, kind="stable")
    same = np.zeros(len(seed), bool)
    same[1:] = seed[order][1:] == seed[order][:-1]
    shared = same.copy()
    shared[:-1] |= same[1:]
    units = np.sort(order[shared])
    at = np.concatenate(([0], np.cumsum(n)))[units]
    n = n[units]
    mark = _unpacked(table["marks"].to_pylist(), _stretches(at, n))
    _, found = _repeats((mark, np.repeat(seed[units], n)), np.repeat(doc[units], n), _stretches(start[units], n))
    columns = [np.concatenate(x) for x in zip(found, *passed)]
    del seed, doc, start, mark, order, same, shared, found, passed
    K.tidy()
    return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("doc", "start", "n", "source", "source_start"), columns)})


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _digests(k: int):
    """Digest of the words of each wanted stretch of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for doc, variant, text, wanted in zip(*(batch.column(x) for x in ("doc", "variant", "text", "wanted"))):
                words, place = (text.as_py() or "").encode().split(), variant.as_py() << START_BITS
                for x in wanted.as_py():
                    a, n = x["start"] - place, x["n"]
                    piece = words[a : a + n + k - 1]
                    for column, value in zip(out, (doc.as_py(), x["start"], n, _digest(piece) if len(piece) == n + k - 1 else None)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["source", "source_start", "n", "digest"])

    return run


def _variant_of(start: str) -> Column:
    return F.shiftright(start, START_BITS)


def placed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, int, bool]:
    """docs with doc and variant, which tell documents apart and order them; the bytes of all texts; whether a doc has several rows.

    doc is the doc_id; a null one is replaced by a number of the text's hash under
    all likely ids. variant is 0 unless the id is null or has several texts.
    """
    digest = F.xxhash64(F.coalesce(text, F.lit("")))
    keyed = docs.withColumn("doc", F.coalesce(doc_id, F.lit(-(2**63)) + digest.bitwiseAND((1 << 61) - 1)))
    own = (F.shiftrightunsigned(digest, 32).bitwiseOR(F.lit(1))).alias("variant")
    ids = cut(keyed.select("doc", digest.alias("h"), F.octet_length(text).alias("size")).groupBy("doc").agg((F.min("h") != F.max("h")).alias("several"), F.sum("size").alias("size"), F.count("*").alias("rows")))
    several = ids.where("several").select("doc", "several")
    n, size, rows = ids.agg(F.count(F.when(F.col("several"), 1)), F.sum("size"), F.max("rows")).first()
    size, repeated = size or 0, (rows or 0) > 1
    if not n:
        return keyed.select("*", F.when(F.col(doc_id).isNull(), own).otherwise(F.lit(0).cast("long")).alias("variant")), size, repeated
    marked = keyed.join(F.broadcast(several) if n <= BROADCAST_IDS else several, "doc", "left")
    return marked.select(*keyed.columns, F.when(F.col(doc_id).isNull() | F.col("several"), own).otherwise(F.lit(0).cast("long")).alias("variant")), size, repeated


def repeated_spans(texts: DataFrame, size: int, repeated: bool = True, k: int = EDGE) -> DataFrame:
    """(doc, variant, spans): for each document with repeats, the stretches (start, n edges, digest of the source's words).

    texts: doc, variant and text as placed() gives them, and any other columns;
    size: their bytes; repeated: whether a document may have several rows. Rows of one document are never repeats of each other.
    """
    parts = max(8, int(size / 6 * 7.5) // GROUP_BYTES + 1)
    filed = texts.select("doc", "variant", "text").mapInArrow(_file(parts, k), "part long, seeds binary, docs binary, starts binary, variants binary, sizes binary, marks binary, repeats binary")
    pieces = filed.groupBy("part").applyInArrow(_first_places, "doc long, start long, n long, source long, source_start long")
    along = Window.partitionBy("doc").orderBy("start")
    follows = (F.lag(F.col("start") + F.col("n")).over(along) == F.col("start")) & (F.lag("source").over(along) == F.col("source")) & (F.lag(F.col("source_start") + F.col("n")).over(along) == F.col("source_start"))
    spans = pieces.withColumn("head", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("path", F.sum("head").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("doc", "path").agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.min("source").alias("source"), F.min("source_start").alias("source_start")).drop("path")
    spans = cut(spans)
    wanted = spans.select(F.col("source").alias("doc"), F.col("source_start").alias("start"), "n").distinct()
    wanted = wanted.groupBy("doc", _variant_of("start").alias("variant")).agg(F.collect_list(F.struct("start", "n")).alias("wanted"))
    # all columns, so that the texts are dealt out once for this and for the caller's join
    read = texts.join(wanted.hint("shuffle_hash"), ["doc", "variant"]).mapInArrow(_digests(k), "source long, source_start long, n long, digest binary")
    if repeated:  # else no aggregate stands between the exchanges and the join, so that a source of many spans can be split
        read = read.groupBy("source", "source_start", "n").agg(F.max("digest").alias("digest"))
    held = spans.join(read, ["source", "source_start", "n"])
    return held.groupBy("doc", _variant_of("start").alias("variant")).agg(F.collect_list(F.struct(F.col("start").bitwiseAND(START).alias("start"), "n", "digest")).alias("spans"))


def _kept(k: int, digest: bool):
    """Counts and either the digest of the kept words or the text without the removed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, out = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                raw, spans = (text.as_py() or "").encode(), spans.as_py()
                words = raw.split()
                keep = np.ones(len(words), bool)
                for x in spans or ():
                    stretch = slice(x["start"], x["start"] + x["n"] + k - 1)
                    if _digest(words[stretch]) == x["digest"]:
                        keep[stretch] = False
                removed = len(words) - int(keep.sum())
                counts.append(len(words))
                gone.append(removed)
                if digest:
                    out.append(hashlib.sha256(b" ".join([w for w, x in zip(words, keep) if x] if removed else words)).hexdigest())
                elif removed:
                    at = K.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    ends = np.append(at.starts[1:], len(raw))
                    out.append(b"".join(raw[a:b] for a, b, x in zip(at.starts, ends, keep) if x).decode().rstrip(" \t\n\r\v\f"))
                else:
                    out.append(text.as_py())
            rest = [x for x in batch.schema.names if x not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in rest), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], [*rest, "n_words", "n_removed", "kept"])

    return run


def _removed(docs: DataFrame, k: int, digest: bool) -> DataFrame:
    """The columns of docs but for text as c0, c1, ..., and n_words, n_removed and kept."""
    rest = [c for c in docs.columns if c != "text"]
    named = lean(docs).select(*[column(c).alias(f"c{i}") for i, c in enumerate(rest)], "text")
    texts, size, repeated = placed(named, doc_id=f"c{rest.index('doc_id')}")
    joined = texts.join(repeated_spans(texts, size, repeated, k).hint("shuffle_hash"), ["doc", "variant"], "left").drop("doc", "variant")
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"c{i} {kinds[c]}" for i, c in enumerate(rest)), "n_words long, n_removed long, kept string"])
    return joined.mapInArrow(_kept(k, digest), schema)


def remove_repeats(docs: DataFrame, k: int = EDGE, digest: bool = False) -> DataFrame:
    """The rows of docs without text, and n_words, n_removed and kept, which replace columns of docs named so.

    A word goes if a window of k words that covers it also starts earlier
    (smaller doc_id, or same document and earlier start), judged on the input.
    kept: the text without those words, each kept word with the white space
    after it (unchanged where nothing goes); with digest, the SHA-256 of the
    kept words joined by one space. Null text: no words, a null kept text.
    Texts of fewer than k words stay. Rows with equal doc_id and text are one
    document, and not repeats of each other. Of one doc_id's different texts
    each is a document, and which of them is earlier is decided by their hashes.
    Null doc_ids: documents by their text, before all others. An empty table
    gives an empty result; other columns stay as they are.
    """
    own = ["n_words", "n_removed", "kept"]
    rest = [c for c in docs.columns if c != "text"]
    return _removed(docs, k, digest).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest) if c not in own], *own)


def without_repeats(docs: DataFrame, k: int = EDGE) -> DataFrame:
    """The rows of docs, with all columns, whose texts are those that remove_repeats keeps.

    n_chars, if there is one, is counted again for a text that lost words; a
    text that lost all of its words goes with its row.
    """
    done = _removed(docs, k, False).where("n_removed = 0 or n_removed < n_words")
    at = {c: F.col(f"c{i}") for i, c in enumerate(c for c in docs.columns if c != "text")}
    if "n_chars" in at:
        at["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(at["n_chars"])
    return done.select(*[at.get(c, F.col("kept")).alias(c) for c in docs.columns])
