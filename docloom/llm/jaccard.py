"""Operator 3: exact n-gram Jaccard self-join with PartEnum signatures.

PartEnum (Arasu, Ganti, Kaushik: "Efficient exact set-similarity joins", 2006):
the feature domain is cut into first-level parts, each of these into CELLS
second-level parts, and a set signs every subset of CELLS - 1 of the second-level
parts of each first-level part. Sets that differ in few features agree on one.

* Bands. A set of s features belongs to level L, the least with 2**L >= s. Where
  4/3 s reaches the next level, the set signs there too, so any two sets that may
  be similar meet at the level of the larger one, whose partition both use.
* Signatures. Sets with Jaccard >= 3/4 differ in k <= (x + y) / 7 features, so in
  all but k / 2 first-level parts they differ in one feature at most, and there the
  subset of second-level parts without that feature is the same. A first-level
  part is good for a set if all its subsets hold features. A set signs its parts
  in their order until k / 2 + 1 good ones are done; of the two sets of a similar
  pair, one is done first, and one of its good parts is such a part. A set without
  so many good parts (a small one) signs all parts and its single features besides;
  two such sets share a feature. No similar pair is lost.
* Texts with equal sets are one class from the start; only classes are joined.
  In a bucket (classes under one signature) a central member leads. Each class
  is first compared with the leaders it shares the most buckets with, in rounds.
  All classes of the buckets that one class leads make a group, so a group holds
  each of them once, however many buckets they share; pairs in a group that are
  still apart are compared by parity bitmaps, whose differing bits bound the
  difference from below, and pairs that pass are intersected exactly. A group is
  compared in pairs of blocks of BLOCK_CLASSES classes, so no task has a whole
  large one.

Feature and set hashes have 64 bits. Signatures are filed by the upper bits of
their hash and told apart within a file by 32 others, and travel with the upper 40
bits of their class, which stand for every class that begins so: an accidental
equality makes a pair to compare, never a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import kernels as K
from .components import components
from .storage import apart, column, cut, lean

U = np.uint64
WORDS = 5
CELLS = 3  # second-level parts
SIGNED = 0.85  # signatures a feature, about
BUCKET_BYTES = 12 << 20  # aimed at for one group of signatures
REMEMBERED = 50_000  # pairs, by a task
PREFIX_BITS = 40  # of a class, with its signatures
BLOCK_CLASSES = 512  # of a group that one task compares with as many others
BROADCAST_ROWS = 500_000  # ids sent to all executors at most; above, a shuffled join
LEADERS = 2  # that a class is compared with in one round
STAR_ROUNDS = 2  # of that; what is apart then is compared pair by pair
SIGN_BYTES = 4 << 20  # text signed at a time


def shingle_sets(words: K.Words, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each document, and document offsets."""
    h = words.hashes(fold=True)
    at, docs = K.inside(words.first, k)
    runs = K.windows(h, k)
    values = runs[at] if len(at) else np.empty(0, U)
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    whole = np.zeros(len(short), U)
    for i in range(k - 1):
        there = counts[short] > i
        whole[there] = K.join_pairs(whole[there], h[words.first[short[there]] + i])
    values, docs = np.concatenate((values, K.mix(whole, 99))), np.concatenate((docs, short))
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
    values, docs = values[new], docs[new]
    return values, K.grouped(docs, len(counts))


def class_of(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash of each set; 0 for an empty one."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), U)
    full = np.flatnonzero(sizes)
    if len(full):
        sums = np.add.reduceat(K.mix(values, 1), offsets[full])
        turned = np.bitwise_xor.reduceat(K.mix(values, 2), offsets[full])
        out[full] = np.maximum(K.mix(sums * U(3) + turned + sizes[full].astype(U)), 1)
    return out


def parity_bits(values: np.ndarray) -> bytes:
    """Bit i: whether an odd number of features is i modulo the length, a power of two >= twice the size."""
    m = 64
    while m < 2 * len(values):
        m *= 2
    counts = np.bincount((values & U(m - 1)).astype(np.int64), minlength=m)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _levels(sizes: np.ndarray) -> np.ndarray:
    """Least L with 2**L >= s."""
    out = np.zeros(len(sizes), np.int64)
    while (low := (1 << out) < sizes).any():
        out[low] += 1
    return out


def _first_parts(levels: np.ndarray) -> np.ndarray:
    """First-level parts at each level: one more than half the features by which similar sets of it can differ, and a tenth for parts that aren't good."""
    most = (2 << levels) // 7
    return most // 2 + 2 + most // 20


def signatures(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signature hashes and the sets (by number) that give them. values ascend within each set."""
    sizes = np.diff(offsets)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    home, more = _levels(sizes), _levels(4 * sizes // 3)
    owner_all = np.repeat(np.arange(len(sizes)), sizes)
    elements = K.mix(values, 3)
    for step in (0, 1):
        sets = np.flatnonzero((sizes > 0) & ((step == 0) | (more > home)))
        if not len(sets):
            continue
        level = home[sets] + step
        parts = _first_parts(level)
        place = np.full(len(sizes), -1)
        place[sets] = np.arange(len(sets))
        take = place[owner_all] >= 0
        owner, value, element = place[owner_all[take]], values[take], elements[take]
        ahead = np.concatenate(([0], np.cumsum(parts)))
        scaled = (value >> U(32)) * parts[owner].astype(U)
        inner = ((scaled & U(2**32 - 1)) * U(CELLS)) >> U(32)
        cell = (ahead[owner] + (scaled >> U(32)).astype(np.int64)) * CELLS + inner.astype(np.int64)
        at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        sums, counts = np.zeros(ahead[-1] * CELLS, U), np.zeros(ahead[-1] * CELLS, np.int64)
        sums[cell[at]] = np.add.reduceat(element, at)
        counts[cell[at]] = np.diff(np.append(at, len(cell)))
        sums, counts = sums.reshape(-1, CELLS), counts.reshape(-1, CELLS)
        rest = counts.sum(1, keepdims=True) - counts
        who = np.repeat(np.arange(len(sets)), parts)
        part = np.arange(ahead[-1]) - ahead[who]
        salt = (level[who] << 40 | part).astype(U)[:, None] * U(CELLS) + np.arange(CELLS, dtype=U)
        sign = K.mix(sums.sum(1, keepdims=True, dtype=U) - sums + salt * U(0xC2B2AE3D27D4EB4F), 4)
        own = sizes[sets]
        need = (own + np.minimum(4 * own // 3, 1 << level)) // 14
        good = (rest > 0).all(1)
        before = np.cumsum(good) - good
        before -= before[ahead[:-1]][who]
        give = (rest > 0) & (before <= need[who])[:, None]
        out.append((sign[give], sets[who[np.nonzero(give)[0]]]))
        weak = np.bincount(who, good, len(sets)) <= need
        if (single := weak[owner]).any():
            out.append((K.mix(value[single] + level[owner[single]].astype(U), 5), sets[owner[single]]))
    if not out:
        return np.empty(0, U), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, words in K.blocks(batches):
        values, offsets = shingle_sets(words)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(np.diff(offsets)), K.signed(class_of(values, offsets)), pa.array([parity_bits(values[a:b]) if b > a else b"" for a, b in zip(offsets, offsets[1:])], pa.binary())],
            ["doc_id", "n_shingles", "class", "bits"],
        )


def _packed(prefixes: np.ndarray) -> bytes:
    """The lower 32 bits of each, then the 8 above."""
    return prefixes.astype(np.uint32).tobytes() + (prefixes >> U(32)).astype(np.uint8).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    n = len(raw) // 5
    return np.frombuffer(raw, np.uint32, n) | np.frombuffer(raw, np.uint8, n, 4 * n).astype(U) << U(32)


def _sign(parts: int):
    """Signature rows by part: packed hashes and classes, once for each block of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            sign, who = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            part = (sign >> U(33)) % U(parts)
            order = np.lexsort((who, part))
            low, who, part = sign[order].astype(np.uint32), who[order], part[order]
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            cuts = np.append(at, len(part))
            return pa.RecordBatch.from_arrays(
                [pa.array(part[at].astype(np.int64)), pa.array([low[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array([_packed(who[a:b] >> U(64 - PREFIX_BITS)) for a, b in zip(cuts, cuts[1:])], pa.binary())],
                ["part", "signs", "classes"],
            )

        seen = np.empty(0, U)  # classes of this block
        for _, words in K.blocks(batches):
            values, offsets = shingle_sets(words)
            own = class_of(values, offsets)
            first = np.zeros(len(own), bool)
            first[np.unique(own, return_index=True)[1]] = True
            first &= (own != 0) & ~np.isin(own, seen)
            seen = np.concatenate((seen, own[first]))
            sizes = np.diff(offsets)
            values = values[np.repeat(first, sizes)]
            sign, who = signatures(values, np.concatenate(([0], np.cumsum(sizes[first]))))
            if len(sign):
                held.append((sign, own[first][who]))
            size += len(words.data)
            if size >= SIGN_BYTES and held:
                yield flush()
                held, size, seen = [], 0, np.empty(0, U)
        if held:
            yield flush()

    return run


def _buckets(table: pa.Table) -> pa.Table:
    """Distinct groups of two or more classes, by their prefixes, that share a signature."""
    sign = np.frombuffer(b"".join(table["signs"].to_pylist()), np.uint32)
    who = np.concatenate([_unpacked(x) for x in table["classes"].to_pylist()])
    order = np.argsort(sign, kind="stable")
    sign, who = sign[order], who[order]
    same = np.zeros(len(sign), bool)
    same[1:] = sign[1:] == sign[:-1]
    near = same.copy()
    near[:-1] |= same[1:]
    sign, who = sign[near], who[near]
    who = who.view(np.int64)
    order = np.lexsort((who, sign))
    sign, who = sign[order], who[order]
    new = np.ones(len(sign), bool)
    new[1:] = (sign[1:] != sign[:-1]) | (who[1:] != who[:-1])
    sign, who = sign[new], who[new]
    at = np.flatnonzero(np.append(True, sign[1:] != sign[:-1])) if len(sign) else np.empty(0, np.int64)
    n = np.diff(np.append(at, len(sign)))
    many = n > 1
    if not many.any():
        return pa.table({"bucket": pa.array([], pa.int64()), "members": pa.array([], pa.list_(pa.int64()))})
    keep = np.repeat(many, n)
    who, n = who[keep], n[many]
    at = np.concatenate(([0], np.cumsum(n)))
    named = K.mix(np.add.reduceat(K.mix(who.view(U), 6), at[:-1]) + n.astype(U), 8)
    _, first = np.unique(named, return_index=True)
    index = np.concatenate([np.arange(at[i], at[i + 1]) for i in first])
    members = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n[first]))).astype(np.int32)), pa.array(who[index]))
    del sign, who, order, same, near, index
    K.tidy()
    return pa.table({"bucket": K.signed(named[first]), "members": members})


def _fold(bits: np.ndarray, to: int) -> np.ndarray:
    while bits.shape[-1] > to:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _far(bits_a: bytes, bits_b: bytes) -> int:
    """Features by which two sets differ at least."""
    a, b = np.frombuffer(bits_a, np.uint8), np.frombuffer(bits_b, np.uint8)
    m = min(len(a), len(b))
    return int(np.bitwise_count(_fold(a, m) ^ _fold(b, m)).sum())


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.to_pydict()
        keep = [7 * _far(p, q) <= n + m for n, p, m, q in zip(x["n_a"], x["bits_a"], x["n_b"], x["bits_b"])]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _compared(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, of one group and pair of blocks each, that lie in different components and may be similar."""
    who, root, size, block, lo, hi = (table[x].to_numpy() for x in ("node", "root", "n_shingles", "block", "lo", "hi"))
    head = np.append(True, np.diff(table["lead"].to_numpy()).astype(bool) | np.diff(lo).astype(bool) | np.diff(hi).astype(bool))
    group = np.cumsum(head)
    bits = table["bits"].to_pylist()
    width = np.array([len(x) for x in bits])
    folded = []  # for each width: places of the bitmaps that are as long at least, those bitmaps folded to a quarter of it and to it
    wide, fine = np.empty(0, np.int64), np.empty((0, 8), np.uint8)
    for m in np.unique(width)[::-1]:
        own = np.flatnonzero(width == m)
        wide = np.concatenate((wide, own))
        fine = np.concatenate((_fold(fine, m) if len(fine) else np.empty((0, m), np.uint8), np.frombuffer(b"".join(bits[i] for i in own), np.uint8).reshape(-1, m)))
        place = np.full(len(bits), -1)
        place[wide] = np.arange(len(wide))
        folded.append((m, place, (_fold(fine, max(m // 4, 8)), fine)))
    out_a, out_b = [], []
    i = np.arange(len(who))
    for step in range(1, len(who)):
        i = i[i + step < len(who)]
        i = i[(group[i] == group[i + step]) & (3 * size[i + step] <= 4 * size[i])]  # sizes ascend in a group
        if not len(i):
            break
        j = i + step
        use = (root[i] != root[j]) & ((lo[i] == hi[i]) | (block[i] != block[j]))
        for m, place, levels in folded:
            x = i[use & (np.minimum(width[i], width[j]) == m)]
            for rows in levels:
                y = x + step
                x = x[7 * np.bitwise_count(rows[place[x]] ^ rows[place[y]]).sum(1, dtype=np.int64) <= size[x] + size[y]]
            out_a.append(who[x])
            out_b.append(who[x + step])
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) from rows sorted by lead, lo, hi and n_shingles; those of one of these keys are held together."""
    held: list[pa.RecordBatch] = []
    said = np.empty((2, 0), np.int64)  # pairs that were given, REMEMBERED at most; others are given again for each group

    def pairs(table: pa.Table) -> pa.RecordBatch:
        nonlocal said
        a, b = _compared(table)
        found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        every, first = np.unique(np.hstack([said, found]), axis=1, return_index=True)
        found = every[:, first >= said.shape[1]]
        said = every if every.shape[1] <= REMEMBERED else found
        return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "b"])

    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        keys = np.stack([table[x].to_numpy() for x in ("lead", "lo", "hi")])
        last = int(np.flatnonzero((keys != keys[:, -1:]).any(0))[-1]) + 1 if (keys != keys[:, -1:]).any() else 0
        if last:
            yield pairs(table.slice(0, last))
            held = table.slice(last).to_batches()
    if held:
        yield pairs(pa.Table.from_batches(held).combine_chunks())


def _block_pairs(members: DataFrame) -> DataFrame:
    """members (lead, size, node, ...) with block, lo and hi: once for each pair of blocks of the group that holds the member's."""
    blocks = F.ceil(F.col("size") / BLOCK_CLASSES).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    out = placed.select("*", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    return out.drop("blocks", "other")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, words in K.blocks(batches):
        values, offsets = shingle_sets(words)
        yield pa.RecordBatch.from_arrays([K.signed(class_of(values, offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), K.signed(values))], ["class", "shingles"])


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of classes whose sets really link; pairs come checkpointed."""
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = cut(wanted.join(nodes.hint("merge"), "class").select(F.col("rep").alias("doc_id")))
    small = wanted.count() <= BROADCAST_ROWS
    texts = docs.join(F.broadcast(wanted) if small else wanted, "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets, "class long, shingles array<bigint>").dropDuplicates(["class"])
    a = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")).hint("merge")
    b = sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")).hint("merge")
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(a, "a").join(b, "b").where(100 * both >= 75 * (F.size("x") + F.size("y") - both)).select("a", "b")


def _near(edges: DataFrame, sketches: DataFrame) -> DataFrame:
    """Edges whose bitmaps don't rule a link out."""
    side = lambda x: sketches.select(F.col("class").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")).hint("merge")
    return edges.join(side("a"), "a").join(side("b"), "b").where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)").mapInArrow(_may_link, "a long, b long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    Words are runs outside ASCII white space, A-Z lower-cased; the set holds the
    distinct shingles of five words, or the whole sequence of a shorter text.
    Rows link at 100 * intersection >= 75 * union. component_id is the least
    doc_id reachable. Null or empty text: 0 shingles, a component of its own.
    Null doc_id: kept, and first in the order. Repeated rows give repeated rows.
    Other columns are ignored. An empty table gives an empty result. A very long
    text is hashed as a whole, in some 40 bytes a word.
    """
    docs = lean(docs).select("doc_id", "text")
    described = cut(docs.mapInArrow(_describe, "doc_id long, n_shingles long, class long, bits binary"))
    nodes = cut(described.where("n_shingles > 0").groupBy("class").agg(F.first("n_shingles").alias("n_shingles"), F.min("doc_id").alias("rep")))
    total = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(8, int(total * SIGNED * 9) // BUCKET_BYTES + 1)
    signed = docs.mapInArrow(_sign(parts), "part long, signs binary, classes binary")
    buckets = signed.groupBy("part").applyInArrow(_buckets, "bucket long, members array<bigint>").dropDuplicates(["bucket"])
    flat = cut(buckets).select("bucket", F.size("members").alias("size"), F.explode("members").alias("prefix"))
    # a bucket's leader is the member with the most company over all its buckets: in a group of
    # near copies that is the text they come from, which more of them are similar to
    company = flat.groupBy("prefix").agg(F.sum("size").alias("company"))
    named = nodes.select(F.shiftrightunsigned("class", 64 - PREFIX_BITS).alias("prefix"), F.col("class").alias("node"))
    company = apart(company.join(named.hint("merge"), "prefix"))
    flat = cut(flat.join(company, "prefix").drop("prefix"))
    # bitmaps only of classes that share a bucket
    sketches = described.groupBy("class").agg(F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"))
    sketches = cut(sketches.join(company.select(F.col("node").alias("class")), "class", "left_semi"))
    lead = apart(flat.groupBy("bucket").agg(F.max(F.struct("company", "node"))["node"].alias("a")))
    spokes = cut(flat.join(lead, "bucket").where("a <> node").groupBy("a", F.col("node").alias("b")).count())
    best = Window.partitionBy("b").orderBy(F.desc("count"), "a")
    links, found, tried = None, None, None
    for _ in range(STAR_ROUNDS):
        left = spokes
        if found is not None:
            root = lambda x: found.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")).hint("merge")  # noqa: E731, B023
            either = tried.union(tried.select(F.col("b").alias("a"), F.col("a").alias("b"))).hint("merge")
            left = left.join(either, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
            left = left.where("coalesce(root_a, a) <> coalesce(root_b, b)")
        chosen = cut(left.withColumn("place", F.row_number().over(best)).where(F.col("place") <= LEADERS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if chosen.isEmpty():
            break
        tried = chosen if tried is None else tried.union(chosen)
        new = cut(_verified(cut(_near(chosen, sketches)), docs, nodes))
        links = new if links is None else links.union(new)
        found = components(links)
    if links is None:
        links = tried = spokes.select("a", "b")  # no two classes share a signature
        found = components(links)
    # a group whose members aren't all connected yet may hold other links
    sizes = apart(spokes.groupBy(F.col("a").alias("lead")).agg((F.count("*") + 1).alias("size")))
    groups = spokes.select(F.col("a").alias("lead"), F.col("b").alias("node")).union(sizes.select("lead", "lead")).join(sizes, "lead")
    members = groups.join(found.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = members.groupBy("lead").agg((F.min("root") != F.max("root")).alias("open")).where("open").select("lead")
    open_ = apart(open_)
    members = _block_pairs(members.join(open_, "lead", "left_semi")).join(sketches.withColumnRenamed("class", "node").hint("merge"), "node")
    members = members.repartition("lead", "lo", "hi").sortWithinPartitions("lead", "lo", "hi", "n_shingles")
    rest = members.mapInArrow(_apart, "a long, b long").distinct()
    rest = cut(rest.join(tried.hint("merge"), ["a", "b"], "left_anti"))
    found = components(links.union(cut(_verified(rest, docs, nodes))))
    joined = nodes.join(found.hint("merge"), nodes["class"] == found["node"], "left").select("class", "rep", F.coalesce("root", "class").alias("root"))
    least = apart(joined.groupBy("root").agg(F.min("rep").alias("component_id")))
    of_class = joined.join(least, "root").select("class", "component_id")
    out = described.select("doc_id", "n_shingles", "class").join(of_class.hint("merge"), "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the least of its component; all columns stay. Rows with a null doc_id stay."""
    drop = jaccard_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*map(column, docs.columns))
