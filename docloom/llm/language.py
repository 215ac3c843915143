"""Operator 2: language identification by bit-sliced Bloom filters of n-grams.

One Bloom filter for each language, bit-sliced: slot i holds one bit for each
language, so looking an n-gram up is one AND over its slots and returns the mask
of all languages that contain it. A text's bits are counted for each language,
the expected share of false positives is taken off, and the most counts decide.

n-grams are three code points around each letter (case folded; anything that is
no letter reads as a gap). A language keeps the N_GRAMS n-grams most frequent in
it among those at least SHARE as frequent as in any other language. The model is
fitted on about SAMPLE_DOCS labelled documents for each language, chosen by a
hash of their number; prediction sees nothing but the whole text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import kernels as K
from .storage import column, lean

U = np.uint64
SLOTS = 1 << 20
PROBES = 3
N_GRAMS = 20_000
SHARE = 0.35
SAMPLE_DOCS = 2_000
MAX_LANGUAGES = 256  # that are learned, the most frequent ones; a parameter
LOW_COVERAGE = 0.25  # share of known n-grams under which keep_identified rejects a text


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # SLOTS x bytes of the language mask
    false_rate: np.ndarray

    @property
    def planes(self) -> int:
        return self.table.shape[1]


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram around each letter as one number, and letters by text."""
    low = [(x or "").lower() for x in texts]
    raw = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[raw]
    at = np.flatnonzero(letter)
    code = np.where(letter, raw, 0).astype(U)
    ends = np.cumsum([len(x) + 1 for x in low])
    return (code[at - 1] << U(42)) | (code[at] << U(21)) | code[at + 1], np.diff(np.searchsorted(at, np.concatenate(([0], ends)), "right"))


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    h = K.mix(grams, 21)
    return [((h >> U(20 * i)) & U(SLOTS - 1)).astype(np.int64) for i in range(PROBES)]


def _text_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    K.take_turn()
    for batch in batches:
        _, offsets = K.utf8(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            to = min(max(int(np.searchsorted(offsets, offsets[at] + K.BLOCK_BYTES, "right")) - 1, at + 1), batch.num_rows)
            rows = batch.slice(at, to - at)
            yield rows, rows.column("text").to_pylist()
            at = to
    K.tidy()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in _text_blocks(batches):
        languages = np.array(rows.column("lang").to_pylist(), object)
        grams, counts = _grams(texts)
        owner = np.repeat(np.arange(len(texts)), counts)
        for name in sorted(set(languages)):
            values, n = np.unique(grams[(languages == name)[owner]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), K.signed(values), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def fit(docs: DataFrame, usable: Column, sample_docs: int = SAMPLE_DOCS, n_grams: int = N_GRAMS, max_languages: int = MAX_LANGUAGES) -> Model:
    """A model from the rows of docs (doc_id, text, lang) that are usable and have text and lang.

    The sizes are bounds of the model: about sample_docs documents and n_grams
    n-grams a language, and the max_languages that most rows have. Rows without
    doc_id aren't learned from. Nothing to learn from gives a model without languages.
    """
    labelled = lean(docs).where(usable & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not sizes:
        return Model((), np.zeros((SLOTS, 1), np.uint8), np.zeros(0))
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = F.lit(False)
    for r in sizes:
        chosen |= (F.col("lang") == r["lang"]) & (spread < int(min(1.0, sample_docs / r["count"]) * (1 << 30)))
    counts = labelled.where(chosen).mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    shares = shares.withColumn("most", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") >= SHARE * F.col("most"))
    ranked = shares.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("share"), "gram")))
    kept = ranked.where(F.col("place") <= n_grams).select("lang", "gram").toArrow()  # n_grams rows a language at most
    languages = tuple(sorted(r["lang"] for r in sizes))
    table = np.zeros((SLOTS, -(-len(languages) // 8)), np.uint8)
    index = {x: i for i, x in enumerate(languages)}
    owner = np.array([index[x] for x in kept["lang"].to_pylist()], np.int64)
    grams = kept["gram"].to_numpy().view(U)
    for i in range(len(languages)):
        for slots in _slots(grams[owner == i]):
            table[slots, i // 8] |= 1 << (i % 8)
    filled = np.array([np.count_nonzero(table[:, i // 8] & (1 << (i % 8))) / SLOTS for i in range(len(languages))])
    return Model(languages, table, filled**PROBES)


def scores(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each text its letters, and for each language the n-grams it knows, corrected."""
    grams, counts = _grams(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    slots = _slots(grams)
    known = []
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    for plane in range(model.planes):
        column = np.ascontiguousarray(model.table[:, plane])
        mask = column[slots[0]]
        for x in slots[1:]:
            mask = mask & column[x]
        known.append(np.bincount(owner * 256 + mask, minlength=len(texts) * 256).reshape(len(texts), 256) @ bits)
    hits = np.hstack(known)[:, : len(model.languages)]
    rate = model.false_rate
    return counts, np.maximum((hits - counts[:, None] * rate) / (1 - rate), 0)


def _predict(shared: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, texts in _text_blocks(batches):
            counts, hits = scores(model, texts)
            names, sure, cover = [], [], []
            for n, x in zip(counts, hits):
                if not n or not len(x):
                    names.append("und")
                    sure.append(0.0)
                    cover.append(0.0)
                    continue
                best = int(x.argmax())
                names.append(model.languages[best])
                sure.append(float(x[best] / x.sum()) if x[best] > 0 else 0.0)
                cover.append(min(1.0, float(x[best] / n)))
            rest = [x for x in rows.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*(rows.column(x) for x in rest), pa.array(names, pa.string()), pa.array(sure, pa.float64()), pa.array(cover, pa.float64())], [*rest, "lang_pred", "score", "coverage"])

    return run


def _shared(docs: DataFrame, model: Model) -> Broadcast:
    """The model once for each executor; its size is bounded by max_languages."""
    return docs.sparkSession.sparkContext.broadcast(model)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, coverage) for each row of docs (doc_id, text).

    lang_pred is a learned language; `und` for a null text or one without a
    letter, and where nothing was learned. score: the language's part of all
    corrected counts; coverage: the part of the n-grams that it knows. Ties go
    to the first name. A text with letters but no known n-gram gets the first
    language with score 0. Null doc_id and repeated rows are kept, an empty table
    gives an empty result, and other columns are ignored.
    """
    return lean(docs).select("doc_id", "text").mapInArrow(_predict(_shared(docs, model)), "doc_id long, lang_pred string, score double, coverage double")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is known: not `und`, and LOW_COVERAGE of the n-grams at least; all columns stay."""
    shared = _shared(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, texts in _text_blocks(batches):
            counts, hits = scores(model, texts)
            good = (counts > 0) & ((hits.max(1) if hits.shape[1] else np.zeros(len(texts))) >= LOW_COVERAGE * counts)
            yield rows.filter(pa.array(good))

    # plain names inside, as a name with a dot can't be handed to Python
    inside = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    renamed = lean(docs).select(*[column(c).alias(x) for c, x in zip(docs.columns, inside)])
    return renamed.mapInArrow(run, renamed.schema).select(*[F.col(x).alias(c) for c, x in zip(docs.columns, inside)])


def held_out() -> Column:
    """Documents that no model may learn from. One without a doc_id isn't held out (and isn't learned from)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
