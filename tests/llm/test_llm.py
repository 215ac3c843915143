import hashlib
import itertools
import random
import re
import textwrap
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import chat, components, decontaminate, html_text, jaccard, language, pieces, quality, scoring, substring, urls
from docloom.llm import kernels as K
from docloom.llm.queries import ORACLES, QUERIES
from tests.oracle import check

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, n_shingles string, spans string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "e", "x", "y") for i, t in texts], DOCS)


def noisy_texts(seed, n=60):
    """Copies, near copies, shared passages, short, empty, null and repeated texts, odd white space."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    base = [[word() for _ in range(rng.randrange(1, 90))] for _ in range(n // 4)]
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        if rng.random() < 0.2:
            w = w + w[: len(w) // 2] + w
        out.append("".join(x + rng.choice([" ", "\n", "\t ", "\x0b"]) for x in w))
    return [*enumerate(out + ["", None, " \n", "One", "one two", "ONE TWO", "a b c d", "\u00a0 x\u2003y"])]


def words(t, fold=False):
    t = t or ""
    if fold:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    return re.findall(r"[^\x20\x09-\x0D]+", t)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, name):
    check(spark, name, QUERIES[name], ORACLES[name], SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_rows(spark, name, tmp_path):
    """Every query over empty tables gives an empty result, except for the rows that a query adds itself."""
    for t in ("documents", "pages", "benchmark", "conversations"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == (1 if name.startswith("op1_") else 0)


def test_word_kernel():
    import pyarrow as pa

    texts = [t for _, t in noisy_texts(5)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    seen = []
    for rows, w in K.blocks([batch], size=500):
        for i in range(rows.num_rows):
            seen.append([bytes(w.data[a:b]).decode() for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]])])
    assert seen == [words(t) for t in texts]
    h = np.arange(30, dtype=np.uint64)
    assert len({int(x) for x in K.windows(h, 20)}) == 11 and len(K.windows(h, 31)) == 0


def jaccard_model(texts):
    sets = {}
    for i, t in texts:
        w = words(t, True)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i in keys:
        for j in keys:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("seed, block", [(1, 1024), (2, 3)])
def test_jaccard_is_exact(spark, monkeypatch, seed, block):
    """With blocks of three classes, buckets are compared over many pairs of blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    texts = noisy_texts(seed, 150)
    df = docs_of(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == jaccard_model(texts)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in got.items() if i == c}


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(3)
    for size in [1, 2, 3, 4, 5, 7, 9, 12, 20, 31, 50, 90, 160, 333]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            gone, new = rng.integers(0, size // 4 + 1), rng.integers(0, size // 3 + 1)
            b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 2**64, new, dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < 75 * (len(a) + len(b) - both):
                continue
            s, who = jaccard.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
            assert set(s[who == 0]) & set(s[who == 1])
            assert 7 * jaccard._far(jaccard.parity_bits(a), jaccard.parity_bits(b)) <= len(a) + len(b)


def test_components_over_many_partitions(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(120)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for size in (10**6, 40):
        monkeypatch.setattr(components, "PART_EDGES", size)
        assert {r.node: r.root for r in components.components(df).collect()} == {x: find(x) for x in list(root)}


@pytest.mark.parametrize("combine", [1, 1 << 22])
def test_substring_dedup_is_exact(spark, monkeypatch, combine):
    monkeypatch.setattr(substring, "COMBINE_BYTES", combine)
    monkeypatch.setattr(substring, "LONGEST_UNIT", 3)
    texts = noisy_texts(6)
    first, gone = {}, {}
    for i, t in texts:
        w = words(t)
        for j in range(len(w) - 19):
            if first.setdefault(tuple(w[j : j + 20]), (i, j)) != (i, j):
                gone.setdefault(i, set()).update(range(j, j + 20))
    shuffled = docs_of(spark, random.Random(1).sample(texts, len(texts))).repartition(7)
    for r in substring.remove_repeats(shuffled, digest=True).collect():
        w = words(dict(texts)[r.doc_id])
        kept = [x for j, x in enumerate(w) if j not in gone.get(r.doc_id, ())]
        assert (r.n_words, r.n_removed, r.kept) == (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    for r in substring.remove_repeats(shuffled).collect():
        t = dict(texts)[r.doc_id]
        assert r.kept == t if not r.n_removed else words(r.kept) == [x for j, x in enumerate(words(t)) if j not in gone[r.doc_id]]


def test_filing_edges_takes_little_memory():
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 30_000, 5_000))) for _ in range(130)]
    batch = pa.RecordBatch.from_pydict({"doc": list(range(130)), "variant": [0] * 130, "text": texts})
    list(substring._file(8, 20)(iter([batch.slice(0, 2)])))  # tables of powers
    tracemalloc.start()
    try:
        rows = list(substring._file(8, 20)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    edges = sum(len(x) // 6 for b in rows for x in b.column("marks").to_pylist())
    assert edges > 640_000
    assert most < 84 * edges


def test_repeats_of_blocks_are_dealt_over_the_parts(monkeypatch):
    monkeypatch.setattr(substring, "COMBINE_BYTES", 1)
    rng = np.random.default_rng(6)
    batches = []
    for i in range(20):
        text = rng.integers(0, 10**6, 2_000).astype(str)
        passages = [text[a : a + 25] for a in range(0, 2_000, 50)]
        rows = [" ".join(text), " ".join(np.concatenate([np.append(x, "|") for x in passages]))]
        batches.append(pa.RecordBatch.from_pydict({"doc": [2 * i, 2 * i + 1], "variant": [0, 0], "text": rows}))
    shown = Counter()
    for b in substring._file(16, 20)(iter(batches)):
        for part, x in zip(b.column("part").to_pylist(), b.column("repeats").to_pylist()):
            shown[part] += len(x) // 40
    assert sum(shown.values()) == 20 * 40  # runs of edges
    assert max(shown.values()) < 80


def test_windows_under_one_mark_are_told_apart(spark, monkeypatch):
    """With marks of two bits most windows of a minimizer meet under one mark; none is removed that isn't a repeat."""
    monkeypatch.setattr(substring, "MARK_BITS", 2)
    monkeypatch.setattr(substring, "COMBINE_BYTES", 1)
    w = lambda i: [f"w{(i * 7 + j * j) % 31}x" if j % 9 else "seed" for j in range(60)]
    texts = [(i, " ".join(w(i))) for i in range(30)]
    assert len({tuple(w(i)[j : j + 20]) for i in range(30) for j in range(41)}) == 30 * 41
    assert substring.remove_repeats(docs_of(spark, texts)).agg(F.sum("n_removed")).first()[0] == 0


def test_substring_rows_that_share_an_id(spark):
    """A doc_id's different texts are documents of their own; rows with equal id and text are one."""
    w = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, w("a")), (5, w("a")), (5, w("x")), (5, w("x")), (6, w("x")), (None, w("n")), (None, w("n")), (None, w("m")), (7, w("n")), (8, w("a") + " " + w("b")), (8, w("b"))]
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got - Counter([(8, 80, 40), (8, 40, 0), (8, 80, 80), (8, 40, 40)]) == Counter({(1, 40, 0): 1, (5, 40, 40): 1, (5, 40, 0): 2, (6, 40, 40): 1, (None, 40, 0): 3, (7, 40, 40): 1})
    # of 8's two texts one holds b first
    assert (got[8, 80, 40], got[8, 40, 40]) == (1, 1) or (got[8, 80, 80], got[8, 40, 0]) == (1, 1)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (3, text), (None, text), (None, None), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in substring.remove_repeats(df).collect()) == [(-1, 0), (-1, 0), (3, 40), (3, 40), (4, 0)]
    assert jaccard.jaccard_components(df).count() == 5 and scoring.backoff_scores(df).count() == 5
    assert pieces.encode(df, decoded=True).where("round_trip").count() == 5
    full = df.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    assert quality.judge(full).count() == 5


def test_chat_round_trip_and_machine(spark):
    said = ["\\### Assistant: </turn> ok", "", None, "\\o\\\\c</turn><turn user>\n", "a\\", "</tur", "\\\\o"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(said + ["end"])] + [(2, 0, "assistant", "x"), (2, 0, "a>\nb<\\", "y"), (2, None, None, None), (None, 1, "user", "z")]
    done = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments")))
    got = {r.conv_id: r for r in done.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user" if i % 2 == 0 else "assistant", t or "") for i, t in enumerate(said + ["end"])]
    assert got[1].valid and got[1].loss == "".join((t or "") for t in (said + ["end"])[1::2])
    assert [(t.role, t.text) for t in got[2].turns] == [("", ""), ("a>\nb<\\", "y"), ("assistant", "x")] and got[2].end_state == "invalid"
    assert not got[None].valid


def test_language_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op2_language_id"](spark, folder).where("held_out").join(truth, "doc_id")
    assert found.selectExpr("avg(cast(lang = lang_pred as int))").first()[0] > 0.98
    model = language.fit(spark.read.parquet(f"{folder}/documents.parquet"), ~language.held_out())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "\u4e2d\u6587"), (5, "the the of")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred in model.languages and 0 <= got[5].score <= 1
    assert {r.doc_id for r in language.keep_identified(odd, model).collect()} == {5}


def test_language_scores_against_single_lookups(spark):
    """Corrected counts from one lookup an n-gram, by hand; nothing to learn from and null ids."""
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("the cat sat on the mat", "en"), ("le chat est sur le tapis", "fr"), ("die Katze sitzt auf der Matte", "de")] * 8)] + [(None, "the null", "en")], "doc_id long, text string, lang string")
    model = language.fit(docs, ~language.held_out())
    texts = ["the cat", "Le TAPIS!", "xyz 12", "", None, "\u00e9t\u00e9 katze"]
    counts, hits = language.scores(model, texts)
    for t, n, found in zip(texts, counts, hits):
        low = f"\n{(t or '').lower()}\n"
        grams = [tuple(ord(c) if c.isalpha() else 0 for c in low[i - 1 : i + 2]) for i in range(1, len(low) - 1) if low[i].isalpha()]
        raw = np.zeros(3)
        for a, b, c in grams:
            slots = language._slots(np.array([a << 42 | b << 21 | c], np.uint64))
            raw += [all(model.table[s[0], 0] & (1 << k) for s in slots) for k in range(3)]
        assert n == len(grams) and np.allclose(found, np.maximum((raw - n * model.false_rate) / (1 - model.false_rate), 0))
    out = docs.withColumn("lang_pred", F.lit("own")).withColumn("held_out", language.held_out())
    assert out.where("held_out is null").isEmpty() and language.identify(out, model).where("doc_id is null").count() == 1
    none = language.fit(docs.where("false"), ~language.held_out())
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"} and language.keep_identified(docs, none).isEmpty()


def test_bloom_filters_hold_every_ngram():
    table = np.zeros((language.SLOTS, 1), np.uint8)
    grams = language._grams(["hello wörld"])[0]
    for slots in language._slots(grams):
        table[slots, 0] |= 2
    model = language.Model(("a", "b"), table, np.zeros(2))
    counts, hits = language.scores(model, ["hello", "", None])
    assert counts.tolist() == [5, 0, 0] and hits[0, 0] == 0 and hits[0, 1] >= 4  # the gap after the last letter is there too


def test_pieces_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    odd = ["   a  b c", "\n\n x\n", "日本語 テスト😀 ñ", "aaaaaaaaaaaa bbbbbbbb", " " * 17 + "deep", "--------====...", " ", "\t\ta\x00", "x" * 3000, "", None]
    texts = [*odd, *(r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = pieces.encode(df, decoded=True).cache()
    for r in coded.collect():
        assert r.piece_ids == (library.encode(texts[r.doc_id]) if texts[r.doc_id] else []) and r.round_trip
    assert {r.doc_id: r.text for r in pieces.decode(coded).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_pieces_of_a_text_without_spaces():
    """A million characters in one word, in bounded time; ids as the library's on a part that it can do."""
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(5)
    vocabulary = pieces.Pieces.read(pieces.MODEL)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz\u65e5\u672c\u8a9e0123") for _ in range(1_000_000))
    began = time.monotonic()
    ids = np.frombuffer(vocabulary.encode_next(pieces.MARK + word), np.int32)
    assert time.monotonic() - began < 60
    assert ids.tolist() == library.encode(word)
    assert pieces.decode_ids(ids, np.array([0, len(ids)]), vocabulary.tables()) == [word]
    # nothing of it is kept for the next word but what is shared
    assert np.frombuffer(vocabulary.encode_next(pieces.MARK + word[:50] + "z"), np.int32).tolist() == library.encode(word[:50] + "z")


@pytest.mark.parametrize("other", ["jaccard", "substring", "language"])
def test_what_pieces_keep_goes_when_another_operator_works(monkeypatch, other):
    monkeypatch.setattr(pieces, "_resident", {})
    sent = lambda f: cloudpickle.loads(cloudpickle.dumps(f))  # noqa: E731 as a worker gets it
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "variant": [0], "doc": [1], "text": ["a b ab"], "lang": ["en"]})
    vocabulary = pieces.Pieces([("<unk>", 0.0), ("a", -1.0), ("b", -2.0), ("ab", -0.5), ("▁", -3.0)], {}, 0)
    for _ in range(2):
        list(sent(pieces._encode(vocabulary, False))(iter([batch.select(["doc_id", "text"])])))
        assert len(pieces._resident) == 1  # the next task of the operator has it
    run = {"jaccard": jaccard._describe, "substring": substring._file(8, 20), "language": language._count}[other]
    list(sent(run)(iter([batch])))
    assert not pieces._resident


def test_scored_viterbi_against_brute_force():
    rng = random.Random(7)
    vocabulary = [("<unk>", 0.0)] + [(x, -rng.random() * 5) for x in ["a", "b", "c", "ab", "bc", "abc", "ca", "cab"]]
    own = pieces.Pieces(vocabulary, {}, 0, merging=False)
    score = dict(vocabulary)

    def best(w):
        return max((score[w[:i]] + (best(w[i:])[0] if i < len(w) else 0.0), [w[:i], *(best(w[i:])[1] if i < len(w) else [])]) for i in range(1, len(w) + 1) if w[:i] in score)

    todo = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(60)}
    for w, raw in own.encode_words(todo).items():
        assert sum(score[vocabulary[i][0]] for i in np.frombuffer(raw, np.int32)) == pytest.approx(best(w)[0])


def test_quality_base_counts_and_junk(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a a a a"), (-4, "x y z\nx y z\nq"), (-5, "\u00a0 b\n\n \n")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(0).cast("long")})
    both = df.select("doc_id", "text", "lang", "source", "n_chars").union(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    texts = {r.doc_id: r.text or "" for r in both.collect()}
    for r in quality.judge(both).collect():
        w, lines = words(texts[r.doc_id]), [x for x in texts[r.doc_id].split("\n") if words(x)]
        c = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", texts[r.doc_id])), len(lines) - len(set(lines)), len(covered), failed)
        assert not (r.kept and failed)


def scatter_of(e):
    factor = np.array([[e[f"l{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
    return np.array([e[f"m{i}"] for i in range(4)]), factor @ factor.T


def test_quality_distances_match_numpy(spark):
    """Distances to each start's estimate, recomputed from it by linear algebra; the least determinant is chosen."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 4)) * 0.3 + 1
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, x0 double, x1 double, x2 double, x3 double")
    estimates = quality._concentrated(rows, quality._start(rows)).cache()
    assert estimates.count() == quality.STARTS
    for e in estimates.collect():
        m, c = scatter_of(e)
        want = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        got = sorted(r.d2 for r in quality._distances(rows, estimates.where(F.col("start") == e.start)).collect())
        assert np.allclose(got, np.sort(want))
    best = min(estimates.collect(), key=lambda e: np.linalg.det(scatter_of(e)[1]))
    assert quality._least(estimates).first().start == best.start


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quality_estimate_is_the_exhaustive_minimum(spark, seed):
    """Sixteen rows a group, four of them elsewhere: of all 1 820 subsets of twelve the estimate describes the one of least determinant."""
    rng = np.random.default_rng(seed)
    groups = {}
    for g in "ab":
        turn = np.linalg.qr(rng.normal(size=(4, 4)))[0]
        near = rng.normal(size=(12, 4)) * [0.5, 0.2, 0.2, 0.1] @ turn
        groups[g] = np.vstack([near, rng.normal(size=(4, 4)) * 0.3 + rng.choice([-1, 1], 4) * 6 @ turn])
    rows = spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], "g string, x0 double, x1 double, x2 double, x3 double")
    floors = np.diag(np.square(quality.FLOOR))
    for e in quality.estimated(rows).collect():
        x = groups[e.g]
        best = min((list(c) for c in itertools.combinations(range(16), 12)), key=lambda c: np.linalg.det(np.cov(x[c].T, bias=True) + floors))
        m, c = scatter_of(e)
        assert np.allclose(m, x[best].mean(0)) and np.allclose(c, np.cov(x[best].T, bias=True) + floors)


def test_quality_outlier_of_each_statistic(spark):
    rng = random.Random(12)
    word = lambda k=6: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(k - 3, k + 4)))
    text = lambda k=6: [" ".join(word(k) for _ in range(12)) for _ in range(12)]
    phrase = " ".join(word() for _ in range(24))
    planted = {-1: text(14), -2: [x + " ## $$" for x in text()], -3: [y for x in text() for y in (x, "ok")], -4: [*text(), phrase, phrase]}
    rows = {i: text() for i in range(300)} | planted
    kept = {r.doc_id: r.kept for r in quality.judge(docs_of(spark, [(i, "\n".join(x)) for i, x in rows.items()])).where("not base_failed").collect()}
    assert len(kept) == len(rows) and not any(kept[i] for i in planted)
    assert sum(kept.values()) >= 297


@pytest.mark.parametrize("chunk, order, least", [(1, 3, 1), (1 << 22, 2, 1), (200, 3, 2)])
def test_scores_against_brute_force(spark, monkeypatch, chunk, order, least):
    """Over chunks of one row and of many, with repeated rows and null ids."""
    monkeypatch.setattr(scoring, "CHUNK_BYTES", chunk)
    texts = noisy_texts(9, 40)
    texts += [texts[3], texts[3], (None, texts[5][1]), (None, None)]
    each = [(i, words(t)) for i, t in texts]
    one = Counter(x for _, w in each for x in w)
    two = Counter(p for _, w in each for p in zip(w, w[1:]))
    three = Counter(p for _, w in each for p in zip(w, w[1:], w[2:]))
    total = sum(one.values())

    def s(h, x):
        if len(h) == 2 and three[(*h, x)] >= least:
            return three[(*h, x)] / two[h]
        if len(h) == 2:
            return 0.4 * s(h[1:], x)
        if len(h) == 1 and two[(*h, x)] >= least:
            return two[(*h, x)] / one[h[0]]
        return 0.4 * s((), x) if h else one[x] / total

    want = sorted((i is not None, i, len(w), round(sum(np.log(s(tuple(w[max(0, j - order + 1) : j]), x)) for j, x in enumerate(w)), 6)) for i, w in each)
    got = sorted((r.doc_id is not None, r.doc_id, r.n_words, round(r.log_score, 6)) for r in scoring.backoff_scores(docs_of(spark, texts), order=order, min_count=least).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=1e-5)


def test_no_two_ngrams_share_a_key():
    """Keys of 48 bits in their partitions are as many as the n-grams."""
    import pyarrow.parquet as pq

    found, keys = [set() for _ in range(3)], [set() for _ in range(3)]
    for _, w in K.blocks(pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_batches()):
        text = [bytes(w.data[a:b]) for a, b in zip(w.starts, w.ends)]
        for n, (grams, ends) in enumerate(scoring._grams(w, 3)):
            found[n].update(tuple(text[e - n : e + 1]) for e in ends)
            keys[n].update(zip(((grams & np.uint64(2**32 - 1)) % np.uint64(8)).tolist(), (grams >> np.uint64(16)).tolist()))
    assert [len(x) for x in found] == [len(x) for x in keys] and len(found[2]) > 100_000


def test_html_layout():
    page = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body><script>var a="</p>";</script>
    <h1>Top</h1><p>one <b>two</b><p>three<br>four<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul><div hidden>no</div><div style="display: none">no<p>no</div>
    <table><tr><th>A<th>Long head<tr><td>1 &lt; 2<td>z</table>end<!-- no --><pre> k
  l</pre><template>no</template> 3 < 4"""
    assert html_text.render(page) == "Top\n\none two\n\nthree\nfour\n\n- a\n- b\n  3. x\n  4. y\n\nA     | Long head\n1 < 2 | z\n\nend\n\n k\n  l\n\n3 < 4"
    assert html_text.render(None) == html_text.render("") == html_text.render("<!-- open") == ""
    assert html_text.render("<div>" * 5000 + "deep") == "deep" and html_text.render("</p></table><td>cell</td></b>x") != ""


def test_html_spans_widths_and_visibility():
    grid = html_text.render("<table><tr><td colspan=2>Title<td>X<tr><td>a<td>b<td>c<tr><td rowspan=2>tall<td>1<td>2<tr><td>3<td>4<tr><td colspan=3>a long line under all of it</table>")
    assert grid == "Title    | X\na    | b | c\ntall | 1 | 2\n     | 3 | 4\na long line under all of it"
    assert html_text.render("<table><tr><td>\u65e5\u672c<td>x<tr><td>abcd<td>y<tr><td>e\u0301<td>z</table>") == "\u65e5\u672c | x\nabcd | y\ne\u0301    | z"
    assert html_text.render("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>ok") == "yes\nok"
    assert html_text.render("<div style='display:none'>no<b style='visibility:visible'>no</b></div>ok") == "ok"
    assert html_text.render("<table><td colspan=0 rowspan=x>a<td colspan=99999999999>b") == "a | b"


def test_html_time_is_linear():
    began = time.monotonic()
    assert html_text.render("<p><table><td>" + "<div>" * 200_000 + "deep").strip() == "deep"
    assert html_text.render("<div>" * 200_000 + "deep") == "deep" and html_text.render("<b>" * 200_000 + "x" + "</p>" * 1000).startswith("x")
    assert html_text.render("<ul><li>a" * 5_000).count("a") == 5_000 and len(html_text.render("<table>" + "<tr><td rowspan=3>a<td>b" * 20_000)) > 40_000
    assert time.monotonic() - began < 60


def test_html_keeps_all_visible_words():
    """Pages made of known words, in random nesting with hidden parts: the words come back in order, without the hidden ones."""
    rng = random.Random(11)

    def part(depth, shown, seen):
        out = []
        for _ in range(rng.randrange(1, 5)):
            if depth > 4 or rng.random() < 0.4:
                w = f"w{rng.randrange(10**6)}"
                out.append(f" {w} ")
                seen.extend([w] * shown)
            else:
                name = rng.choice("div p span ul b section blockquote h2 em article script hidden style".split())
                if name == "script":
                    out.append("<script>var w1 = '<p>w2';</script>")
                    continue
                hides = name in ("hidden", "style")
                tag = {"hidden": "<div hidden>", "style": "<div style='display:none'>"}.get(name, f"<{name}>")
                tag += "<li>" * (name == "ul")
                out.append(tag + part(depth + 1, shown and not hides, seen) + ("" if name == "p" and rng.random() < 0.5 else f"</{'div' if hides else name}>"))
        return "".join(out)

    for _ in range(200):
        seen = []
        page = part(0, True, seen)
        assert re.findall(r"w\d+", html_text.render(page)) == seen, page


def test_html_raw_end_after_letters_that_grow_in_lower_case():
    dotted = "\u0130" * 40
    assert html_text.render(f"<body>{dotted}<script>x</ScRipt><p>seen</p><textarea>a</TEXTAREA><p>end") == f"{dotted}\n\nseen\n\na\n\nend"


def test_templates(spark):
    q = "A train leaves Paris at 12:30 and travels 120 km in 2 hours while Anna walks 5 km, how far is it from Anna to the train after 3 hours"
    d = [(1, "Intro here. " + q.replace("120", "340").replace("Anna", "Maria") + " and more."), (2, "Intro. " + q.replace("Anna", "Maria", 1)), (3, q), (4, None), (5, ""), (6, "two words"), (None, q), (7, "nothing of that kind is in this text at all")]
    docs = spark.createDataFrame(d, "doc_id long, text string").withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame([(9, q), (10, "two words"), (11, None)], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {(1, 9), (3, 9), (6, 10)} and got[1, 9].n_changed > 0 and got[3, 9].n_changed == 0
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {2, 4, 5, 7, None}


QUESTION = "Last week Natalia sold small clips to 48 friends in April, and then Natalia sold half as many clips to Jonas in May before Natalia gave Jonas 12 of them"


def leaked(spark, texts, items):
    docs = spark.createDataFrame([(i, f"Some words before. {t} And some other words after it all") for i, t in enumerate(texts)], "doc_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}


def test_leaks_whatever_layout_and_case(spark):
    texts = [QUESTION, QUESTION.lower(), QUESTION.upper(), *(textwrap.fill(QUESTION, n) for n in (20, 60, 65)), QUESTION.replace(" ", "  "), QUESTION.replace(" ", "\u00a0\t")]
    assert leaked(spark, texts, [QUESTION]) == {(i, 0) for i in range(len(texts))}


def test_short_items_inside_documents(spark):
    items = ["What is the capital city of France?", "add 5 and 3", "so 7"]
    texts = [items[0], items[0].lower(), items[0].replace("France", "Spain"), "add 5 and 3", "add 6 and 2", "What is the capital of France?"]
    assert leaked(spark, texts, items) == {(0, 0), (1, 0), (2, 0), (3, 1)}


def test_leaks_over_moved_diagonals_and_in_parts(spark):
    words = [f"w{'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]}" for i in range(59)]
    texts = [QUESTION.replace("Natalia", "Mary Ann").replace("48", "52"), " ".join(words[20:45]), " ".join(words[20:32]), " ".join(words[:19] + ["one", "more"] + words[19:38] + ["again"] + words[38:57]), QUESTION.replace("Natalia", "Mary Ann", 1).replace("Natalia", "Peter", 1).replace("Natalia", "Jo Ann Lee")]
    assert leaked(spark, texts, [QUESTION, " ".join(words)]) == {(0, 0), (1, 1), (3, 1)}


def test_tables_of_numbers(spark):
    """Windows of slots only meet by their values, so numbers don't meet all others."""
    numbers = lambda n, seed: " ".join(str(x) for x in np.random.default_rng(seed).integers(0, 10**6, n))
    item = numbers(400, 1)
    docs = spark.createDataFrame([(1, numbers(20_000, 2)), (2, numbers(50, 3) + " " + item + " " + numbers(50, 4))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.n_changed) for r in decontaminate.leaks(docs, bench).collect()] == [(2, 7, 0)]
    windows = lambda df, key: decontaminate._windows(decontaminate._forms(df, key), [8]).select("h")
    assert windows(docs, "doc_id").join(windows(bench, "item_id"), "h").count() == 393


def test_leaks_equal_plain_search(spark):
    docs = {r.doc_id: " ".join(words(r.text)) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    items = [" ".join(words(r.text)) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    got = {r.doc_id for r in QUERIES["op8_decontamination"](spark, "/root/testdata/sf0.01").where("leaked").collect()}
    assert {i for i, t in docs.items() if any(x in t for x in items)} == got


def test_url_rules(spark):
    rules = urls.Rules()
    cases = {"http://a.net/x": "block", "https://www.Example.NET/en/1": "allow", "http://example.net/de/1": "block", "http://m.example.com/de/": "block", "http://x.org/fr/a?b": "allow", "http://a.net": None, "http://notnet/x": None, "x.org/fr/": None, None: None}
    for url, want in cases.items():
        found = rules.find(*urls.split_url(url))
        assert (found and found[1]) == want, url
    assert urls.split_url("HTTP://U@Host:80/P?q#f") == ("u@host:80", "/P") and urls.split_url("a://h?x/y") == ("h", "") and urls.split_url("ab") == ("", "")
    assert urls.named_by(urls.RULES) == {"net", "example", "com", "org", "/en", "/de", "/fr"}


def test_url_words_against_all_splits():
    rng = random.Random(3)
    counts = {"cheap": 50, "pills": 50, "the": 100, "example": 20} | {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 90) for _ in range(25)}
    segmenter = urls.Segmenter(counts)
    assert segmenter.split("cheappills") == ("cheap", "pills")
    for _ in range(60):
        run = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 10)))
        splits = [[run[a:b] for a, b in zip((0, *cuts), (*cuts, len(run)))] for n in range(len(run)) for cuts in itertools.combinations(range(1, len(run)), n)]
        cost = lambda x: sum(map(segmenter.cost, x))
        assert "".join(segmenter.split(run)) == run and cost(segmenter.split(run)) == pytest.approx(max(map(cost, splits)))


def test_url_model_learns_from_blocked_urls(spark):
    """Words of blocked urls block others without a seed; a seed word that allowed urls use is allowed."""
    rows = [f"http://win-zorb{i % 5}.net/a/{i}" for i in range(60)] + [f"http://calm-garden{i % 5}.com/b/{i}" for i in range(90)] + [f"http://cheap-flights{i % 5}.com/b/{i}" for i in range(120)]
    asked = ["http://win-zorb.com/c", "http://zorbwin.org/c", "http://calm-garden.org/c", "http://cheap-flights.org/c", "http://casino-garden.org/c", "http://cheappillscasino.org/c", None, "http://x.net/", "no url"]
    pages = spark.createDataFrame([*((i, u) for i, u in enumerate(rows)), *((1000 + i, u) for i, u in enumerate(asked)), (None, asked[0])], "page_id long, url string").withColumns({"block": F.lit("x"), "words": F.lit("y")})
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert [got[1000 + i].verdict for i in range(len(asked))] == ["block", "block", "allow", "allow", "allow", "block", "allow", "block", "allow"]
    assert got[1001].words == "zorb win org /c" and got[1000].rule is None and got[1007].rule == "net/" and got[None].verdict == "block"
    # the sum of weights, by hand
    counts = {}
    for i in (0, 1):
        counts[i] = Counter(w for p, r in got.items() if r.host and ((r.rule is not None and r.verdict == "block") == (i == 0)) for w in r.words.split() if w not in urls.named_by(urls.RULES))
    n = [sum(c.values()) + len(counts[0] | counts[1]) + 1 for c in (counts[0], counts[1])]
    hosts = [sum(1 for r in got.values() if r.host and (r.rule is not None and r.verdict == "block") == k) for k in (True, False)]
    want = np.log(hosts[0] + 1) - np.log(hosts[1] + 1) + sum(np.log(counts[0][w] + 1) - np.log(counts[1][w] + 1) + np.log(n[1]) - np.log(n[0]) + (np.log(urls.SEED_ODDS) if w == "casino" else 0) for w in ("casino", "garden", "/c"))
    assert got[1004].log_odds == pytest.approx(want)


def test_url_words_beyond_the_most_frequent(spark):
    """Every word of three occurrences counts, however many words are more frequent."""
    name = lambda i: "".join("bcdfghjklm"[int(c)] for c in f"{i:05d}")
    frequent = [(i, "http://" + ".".join(name(j) for j in range(k, k + 1000)) + ".com/") for i, k in enumerate([*range(0, 52000, 1000)] * 4)]
    rare = [(1000 + i, "http://rare.org/zuvaxo") for i in range(3)] + [(2000, "http://rare.org/zuvaxorare")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(frequent + rare, "page_id long, url string")).where("page_id >= 1000").collect()}
    assert got[1000].words == "rare org /zuvaxo" and got[2000].words == "rare org /zuvaxo /rare"
    assert abs(got[2000].log_odds - got[1000].log_odds) > 0.01


CLASHES = "n_words n_removed kept doc class part words item_id at shift count spans wanted digest node root rep component_id n_shingles bits held both c0 h n source_start seed bucket members lang_pred piece_ids a.b".split()


def test_stages_keep_clashing_columns(spark):
    """Columns named like those that the operators make or use inside stay as they are."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    wide = docs.withColumns({x: F.lit(f"own {x}") for x in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, out = stage(spark, docs, SMALL), stage(spark, wide, SMALL)
        assert out.dtypes == wide.dtypes, name
        rows = out.collect()
        assert all(r[x] == f"own {x}" for r in rows for x in CLASHES), name
        assert sorted((r.doc_id, r.text, r.n_chars) for r in rows) == sorted((r.doc_id, r.text, r.n_chars) for r in plain.collect()), name
    assert pieces.encode(wide).count() == quality.judge(wide).count() == scoring.backoff_scores(wide).count() == wide.count()
    got = substring.remove_repeats(wide)
    assert len(set(got.columns)) == len(got.columns) and got.agg(F.sum("n_words")).first()[0] > 0


def test_repeated_turns_and_clashing_columns_of_chats(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"segments": F.lit(1), "formatted": F.lit("x"), "turns": F.lit("y"), "end_state": F.lit("z")})
    got = {r.conv_id: r for r in chat.format_chats(df).withColumn("read", chat.read_turns(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in got[1]["read"]] == [("user", "a"), ("user", "a"), ("assistant", "b")] and not got[1].valid
    assert [(t.role, t.text) for t in got[2]["read"]] == [("", "")]
    assert chat.format_chats(df.where("false")).isEmpty()


def test_repeated_rows_of_every_operator(spark):
    """A table twice: each row's verdict is there twice, and is the same for both."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    twice = lambda df: df.union(df)
    for out, key in ((urls.judge(twice(pages)), "page_id"), (html_text.extract(twice(pages)), "page_id"), (quality.judge(twice(docs)), "doc_id"), (language.identify(twice(docs), language.fit(docs, ~language.held_out())), "doc_id")):
        rows = Counter(map(str, out.collect()))
        assert set(rows.values()) <= {2, 4} and sum(rows.values()) == 2 * (pages if key == "page_id" else docs).count()
    one, two = decontaminate.leaks(docs, bench), decontaminate.leaks(twice(docs), twice(bench))
    assert {(r.doc_id, r.item_id, r.n_changed) for r in one.collect()} == {(r.doc_id, r.item_id, r.n_changed) for r in two.collect()}


def odd_documents(spark):
    """Rows with nulls in any column, empty and long texts, repeated rows, one id twice."""
    long = " ".join(f"the word{i % 977} of a text" for i in range(60_000))
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, None), (3, "the cat sat on the mat and the dog", None, "s", 3), (3, "the cat sat on the mat and the dog", None, "s", 3), (3, "another text of the same number", "en", None, 3), (None, "a text without a number, the first", "en", "s", 3), (4, long, "en", "s", len(long)), (5, "1234 5678", "en", "s", 9), (6, "\x00\x0b the \u00a0\u2003 of", "en", "s", 1)]
    base = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").union(base.where("doc_id > 10"))


def test_stages_of_odd_rows_and_of_none(spark):
    docs = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).dtypes == docs.dtypes
        assert 0 < stage(spark, docs, SMALL).count() <= docs.count()
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, SMALL).where("round_trip").count() == docs.count()
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SMALL).isEmpty()
    for query in (quality.judge, scoring.backoff_scores, substring.remove_repeats, jaccard.jaccard_components, pieces.encode):
        assert query(docs).count() == docs.count() and query(none).isEmpty()


def test_language_stage_against_single_texts(spark):
    """What the stage keeps is what single lookups would keep, on the documents of a table."""
    docs = odd_documents(spark)
    model = language.fit(docs, ~language.held_out())
    texts = docs.select("doc_id", "text").collect()
    counts, hits = zip(*(language.scores(model, [r.text]) for r in texts))
    want = Counter((r.doc_id, r.text) for r, n, h in zip(texts, counts, hits) if n[0] and h[0].max() >= language.LOW_COVERAGE * n[0])
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.STAGES[0][1](spark, docs, SMALL).collect())
    assert got == want and 0 < len(want) < len(texts)


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "substring_dedup", "decontamination", "sentencepiece"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder).cache()
        assert i == len(corpus_pipeline.STAGES) - 1 or out.dtypes == docs.dtypes, name
        assert 0 < out.count() <= docs.count()
        docs = out
    assert docs.where("round_trip").count() == docs.count() == corpus_pipeline.run(spark, folder).count()
