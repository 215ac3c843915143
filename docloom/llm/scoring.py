"""Operator 6: n-gram language-model scores by stupid backoff, computed relationally.

Brants et al., "Large language models in machine translation" (2007):
S(w | h) = c(h w) / c(h) if the n-gram occurs, else 0.4 S(w | shorter h), and
c(w) / N for single words. Counts come from all documents.

The relations: documents are exploded into n-grams, chunk by chunk (a chunk is
CHUNK_BYTES of texts that are read together, packed as one row). Each chunk sends
its distinct n-grams and counts to the partition of their hash; the partition is
the count table, which adds up and joins the totals back to the chunks that hold
the n-gram; a chunk then sums logarithms by document. A frequent n-gram is one row
a chunk, however often it occurs, and rows are packed as arrays: one for each chunk
and partition.

An n-gram is its partition (dealt by the low half of a 64-bit hash) and the upper
48 bits inside it, sent as ascending steps. Partitions have a bounded size of some
1.7 million n-grams, among which 0.005 pairs are expected to share 48 bits, at any
size of the corpus; from 65 536 partitions on, these are all bits of the hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .storage import lean

U = np.uint64
ORDER = 3
BACKOFF = 0.4
MIN_COUNT = 1  # occurrences from which an n-gram of two words or more counts; 1: any that occurs
CHUNK_BYTES = 12 << 20  # text of a chunk, about
GROUP_BYTES = 12 << 20  # n-grams of a partition, about
DENSE = 1024  # keys from which steps are shorter than the keys' upper bits


def _grams(words: K.Words, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the n-gram hashes and the words that end them."""
    h = words.hashes()
    out = []
    for n in range(1, order + 1):
        at, _ = K.inside(words.first, n)
        out.append((K.mix(K.windows(h, n)[at] if len(at) else np.empty(0, U), 30 + n), at + n - 1))
    return out


def _filed(grams: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Ascending n-grams by partition, ascending in each: their order, and (partition, begin, end) of each stretch."""
    part = ((grams & U(2**32 - 1)) % U(parts)).astype(np.min_scalar_type(parts))
    by = np.argsort(part, kind="stable")
    part = part[by]
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(by) else np.empty(0, np.int64)
    return by, list(zip(part[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(by)]))


def _packed_keys(grams: np.ndarray) -> bytes:
    """The upper 48 bits of ascending n-grams: 32 as they are, the 16 above as steps where these are short."""
    low, high = (grams >> U(16)).astype(np.uint32), (grams >> U(48)).astype(np.int64)
    return low.tobytes() + (high.astype(np.uint16).tobytes() if len(grams) < DENSE else _packed(np.diff(high, prepend=0)))


def _unpacked_keys(raw: bytes, n: int) -> np.ndarray:
    low, rest = np.frombuffer(raw[: 4 * n], np.uint32), raw[4 * n :]
    high = np.frombuffer(rest, np.uint16) if n < DENSE else np.cumsum(_unpacked(rest, n))
    return (high.astype(U) << U(32)) | low


def _chunk_counts(words_list: list[K.Words], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the chunk's distinct n-grams, ascending, and how often they occur."""
    each = [_grams(x, order) for x in words_list]
    return [np.unique(np.concatenate([x[n][0] for x in each]), return_counts=True) for n in range(order)]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = words = 0
    for _, w in K.blocks(batches):
        size, words = size + len(w.data), words + len(w.starts)
    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([words], pa.int64())], ["bytes", "words"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a chunk: rows that are read together, compressed."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for x in held:
                out.write_batch(x)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.large_binary()).cast(pa.binary())], ["texts"])

    size = 0
    for rows, words in K.blocks(batches):
        held.append(rows)
        size += len(words.data)
        if size >= CHUNK_BYTES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _words_of(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, K.Words]]:
    for x in table["texts"]:
        yield from K.blocks(pa.ipc.open_stream(x.as_buffer()))


def _ask(parts: int, order: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        rows = {"chunk": [], "part": [], "n": [], "size": [], "grams": [], "counts": []}
        for n, (grams, counts) in enumerate(_chunk_counts([w for _, w in _words_of(table)], order), 1):
            by, stretches = _filed(grams, parts)
            grams, counts = grams[by], counts[by]
            for part, a, b in stretches:
                for name, value in zip(rows, (chunk, part, n, b - a, _packed_keys(grams[a:b]), _packed(counts[a:b]))):
                    rows[name].append(value)
        return pa.table({"chunk": pa.array(rows["chunk"], pa.int64()), "part": pa.array(rows["part"], pa.int64()), "n": pa.array(rows["n"], pa.int32()), "size": pa.array(rows["size"], pa.int32()), "grams": pa.array(rows["grams"], pa.binary()), "counts": pa.array(rows["counts"], pa.binary())})

    return run


def _total(min_count: int):
    def run(table: pa.Table) -> pa.Table:
        """The count table of one partition and its answers."""
        part, chunks, orders, lengths = table["part"][0].as_py(), *(table[c].to_pylist() for c in ("chunk", "n", "size"))
        answers: list[bytes] = [b""] * len(chunks)
        for n in set(orders):
            rows = [i for i, x in enumerate(orders) if x == n]
            grams = [_unpacked_keys(table["grams"][i].as_py(), lengths[i]) for i in rows]
            counts = np.concatenate([_unpacked(table["counts"][i].as_py(), lengths[i]) for i in rows])
            sizes = np.cumsum([0, *map(len, grams)])
            joined = np.concatenate(grams)
            by = np.argsort(joined, kind="stable")
            head = np.append(True, joined[by][1:] != joined[by][:-1])
            sums = np.add.reduceat(counts[by], np.flatnonzero(head))
            back = np.empty(len(by), np.int64)
            back[by] = sums[np.cumsum(head) - 1]
            if n > 1:
                back[back < min_count] = 0
            for i, a, b in zip(rows, sizes, sizes[1:]):
                answers[i] = _packed(back[a:b])
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "part": pa.array([part] * len(chunks), pa.int64()), "n": pa.array(orders, pa.int32()), "totals": pa.array(answers, pa.binary())})

    return run


def _packed(x: np.ndarray) -> bytes:
    """Small numbers in a byte, the others after them in eight."""
    big = x >= 255
    return np.where(big, 255, x).astype(np.uint8).tobytes() + x[big].astype(np.int64).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw[:n], np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[n:], np.int64)
    return out


def _score(parts: int, order: int, backoff: float, total: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        empty = pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64())})
        if not texts.num_rows:
            return empty
        rows = list(_words_of(texts))
        given = {(p, n): x for p, n, x in zip(*(answers[c].to_pylist() for c in ("part", "n", "totals")))}
        tables = []
        for n, (grams, _) in enumerate(_chunk_counts([w for _, w in rows], order), 1):
            by, stretches = _filed(grams, parts)
            counts = np.empty(len(grams), np.int64)
            for part, a, b in stretches:
                counts[by[a:b]] = _unpacked(given[part, n], b - a)
            tables.append((grams, counts))
        out = [[], [], []]
        for block, words in rows:
            each = _grams(words, order)
            found = [t[1][np.searchsorted(t[0], g)] for (g, _), t in zip(each, tables)]
            log = np.log(np.maximum(found[0], 1)) - np.log(max(total, 1))
            for n in range(2, order + 1):
                ends = each[n - 1][1]
                # the history's count: its n-gram of the order below ends one word earlier
                before = np.zeros(len(words.starts), np.int64)
                before[each[n - 2][1]] = found[n - 2]
                counts, history = found[n - 1], before[ends - 1]
                log[ends] = np.where(counts > 0, np.log(np.maximum(counts, 1)) - np.log(np.maximum(history, 1)), np.log(backoff) + log[ends])
            out[0].append(block.column("doc_id"))
            out[1].append(words.counts)
            out[2].append(np.array([log[a:b].sum() for a, b in zip(words.first, words.first[1:])]))
        return pa.table({"doc_id": pa.chunked_array(out[0]), "n_words": pa.array(np.concatenate(out[1]), pa.int64()), "log_score": pa.array(np.concatenate(out[2]), pa.float64())})

    return run


def backoff_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """(doc_id, n_words, log_score) for each row of docs (doc_id, text).

    log_score is the sum of ln S over all words, runs outside ASCII white space,
    unchanged. Null or empty text: 0 words, 0.0. A null doc_id is kept. Repeated
    rows are scored and counted each. Other columns are ignored. An empty table
    gives an empty result. n-grams of two words or more that occur fewer than
    min_count times don't count; a history counts if its own n-gram does.
    """
    docs = lean(docs).select("doc_id", "text")
    size, total = docs.mapInArrow(_measure, "bytes long, words long").agg(F.sum("bytes"), F.sum("words")).first()
    size, total = size or 0, total or 0
    parts = max(8, int(size / 6 * order * 7) // GROUP_BYTES + 1)
    chunks = docs.mapInArrow(_pack, "texts binary").select(F.monotonically_increasing_id().alias("chunk"), "texts")
    asked = chunks.groupBy("chunk").applyInArrow(_ask(parts, order), "chunk long, part long, n int, size int, grams binary, counts binary")
    told = asked.groupBy("part").applyInArrow(_total(min_count), "chunk long, part long, n int, totals binary")
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_score(parts, order, backoff, total), "doc_id long, n_words long, log_score double")
