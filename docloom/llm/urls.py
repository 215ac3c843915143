"""Operator 9: URL filters.

Rules first: a rule names a host, which fits it and all subdomains, and a path
that the url's path starts with; the longest rule that fits wins. Urls without
a rule are judged by a model: unigram Viterbi splits the runs of letters of host
and path into words, and multinomial naive Bayes scores them.

The model is fitted here. Word frequencies are those of the tokens between
separators over all urls. The classes are the rules' verdicts: urls that a rule
blocks, and all others, so the model carries over to other hosts what the words
of blocked ones have in common. Words that the rules name themselves are no
features. Seed words, a parameter, are believed to be SEED_ODDS times as frequent
in unwanted urls beforehand; that belief is one term of the sum, which the counts
of the seed word and the other words can outweigh.

Both tables hold every entry and stay distributed: urls are dealt into blocks, and
a block is joined with the counts of just the substrings, and then the weights of
just the words, that its urls hold. Counts come from all rows, summed before they
travel; only their totals reach the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import cut

BLOCK_BITS = 12  # 2 ** BLOCK_BITS urls share a table of counts
SENT = 200_000  # substrings that are held before they are sent on
MIN_COUNT = 3  # a rarer token is no word of its own, but may be made of words; a parameter
LONGEST = 24  # letters of a word; a longer run is made of words
# fixed values: the rules of the contract
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# what is believed of words before any url is seen; a parameter
SEEDS = ("adult", "bet", "bonus", "casino", "cheap", "farm", "loan", "pills", "porn", "poker", "replica", "sex", "spam", "viagra", "xxx")
SEED_ODDS = 50.0
SEED_WEIGHT = 50  # occurrences as a word that a seed has beforehand

HOST = re.compile(r"://([^/?#]*)([^?#]*)")
LETTERS = re.compile(r"[a-z]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    m = HOST.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class Rules:
    """Rules by host; a lookup tries the host and its parents."""

    def __init__(self, rules: tuple[tuple[str, str, str], ...] = RULES):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, at = None, 0
        while at >= 0 and host:
            name = host[at:]
            for start, verdict in self.by_host.get(name, ()):
                if path.startswith(start) and (best is None or len(name) + len(start) > len(best[0])):
                    best = (name + start, verdict)
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return best


def named_by(rules: tuple[tuple[str, str, str], ...]) -> frozenset[str]:
    """The words of the rules' own hosts and paths, as Segmenter.words marks them."""
    return frozenset(chain.from_iterable([*LETTERS.findall(host), *("/" + w for w in LETTERS.findall(path.lower()))] for _, host, path in rules))


class Segmenter:
    """Most probable split of a run of letters into words, by unigram Viterbi."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """total: of all counts, where counts has only those of the words that can occur."""
        total = total or sum(counts.values()) or 1
        self.log = {w: math.log(n / total) for w, n in counts.items() if n > 0}
        self.total = total
        self.seen: dict[str, tuple[str, ...]] = {}

    def cost(self, word: str) -> float:
        found = self.log.get(word)
        return found if found is not None else -math.log(self.total) - 2.5 * len(word)

    def split(self, run: str) -> tuple[str, ...]:
        found = self.seen.get(run)
        if found is None:
            best: list[tuple[float, int]] = [(0.0, 0)]
            for end in range(1, len(run) + 1):
                best.append(max(((best[a][0] + self.cost(run[a:end]), a) for a in range(max(0, end - LONGEST), end)), key=lambda x: (x[0], -x[1])))
            out, at = [], len(run)
            while at:
                out.append(run[best[at][1] : at])
                at = best[at][1]
            if len(self.seen) > 200_000:
                self.seen.clear()
            found = self.seen[run] = tuple(reversed(out))
        return found

    def words(self, host: str, path: str) -> list[str]:
        """Tokens of the host, then those of the path, marked apart."""
        own = [w for run in LETTERS.findall(host) for w in self.split(run)]
        return own + ["/" + w for run in LETTERS.findall(path.lower()) for w in self.split(run)]


@dataclass
class Bayes:
    """Multinomial naive Bayes with add-one smoothing: block against allow. Words in seeds weigh ln(SEED_ODDS) more."""

    counts: dict[str, tuple[int, int]] = field(default_factory=dict)  # word: occurrences in blocked and in allowed urls
    urls: tuple[int, int] = (0, 0)
    whole: tuple[int, int, int] | None = None  # entries and sums of the whole table, where counts has only a part
    seeds: frozenset[str] = frozenset()
    left_out: frozenset[str] = frozenset()

    def __post_init__(self):
        entries, *sums = self.whole or (len(self.counts), *(sum(x[i] for x in self.counts.values()) for i in (0, 1)))
        sums = [x + entries + 1 for x in sums]
        self.unseen = math.log(sums[1]) - math.log(sums[0])
        self.weight = {w: math.log(a + 1) - math.log(b + 1) + self.unseen for w, (a, b) in self.counts.items()}
        self.prior = math.log(self.urls[0] + 1) - math.log(self.urls[1] + 1)

    def blocks(self, words: list[str]) -> float:
        """Log odds of block."""
        return self.prior + sum(self.weight.get(w, 0.0) + (math.log(SEED_ODDS) if w.lstrip("/") in self.seeds else 0.0) for w in words if w not in self.left_out)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[str] = Counter()
        for url in batch.column("url").to_pylist():
            host, path = split_url(url)
            counts.update(x for x in LETTERS.findall(host + "/" + path.lower()) if len(x) <= LONGEST)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word) for what may be a word of a block's urls."""
    for batch in batches:
        found: set[tuple[int, str]] = set()
        for block, url in zip(batch.column("block").to_pylist(), batch.column("url").to_pylist()):
            host, path = split_url(url)
            for run in set(LETTERS.findall(host + "/" + path.lower())):
                for a in range(len(run)):
                    found.update((block, run[a:b]) for b in range(a + 1, min(a + LONGEST, len(run)) + 1))
                    if len(found) >= SENT:
                        yield _of_blocks(found)
                        found.clear()
        yield _of_blocks(found)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, word) for the words of a block."""
    for batch in batches:
        yield _of_blocks({(block, w) for block, words in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist()) for w in words})


def _of_blocks(found: set[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([w for _, w in found], pa.string())], ["block", "word"])


def _segment(total: int):
    def run(urls: pa.Table, counts: pa.Table) -> pa.Table:
        segmenter = Segmenter(dict(zip(counts.column("word").to_pylist(), counts.column("n").to_pylist())), total)
        split = [split_url(url) for url in urls.column("url").to_pylist()]
        words = [segmenter.words(host, path) for host, path in split]
        return pa.Table.from_arrays([urls.column("block"), urls.column("page_id"), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array(words, pa.list_(pa.string()))], ["block", "page_id", "host", "path", "words"])

    return run


def _classes(rules: tuple[tuple[str, str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, left_out = Rules(rules), named_by(rules)
        for batch in batches:
            counts: Counter[tuple[str, int]] = Counter()
            for host, path, words in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "words"))):
                if host:
                    rule = own.find(host, path)
                    kind = 0 if rule and rule[1] == "block" else 1
                    counts.update((w, kind) for w in ["", *words] if w not in left_out)
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in counts], pa.string()), pa.array([k for _, k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["word", "kind", "n"])

    return run


def word_counts(urls: DataFrame, seeds: tuple[str, ...] = SEEDS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) for each token that occurs min_count times or more, seeds with their weight added."""
    frequent = urls.mapInArrow(_tokens, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    known = urls.sparkSession.createDataFrame([(w, SEED_WEIGHT) for w in seeds], "word string, n long")
    return frequent.union(known).groupBy("word").agg(F.sum("n").alias("n"))


def _joined(rows: DataFrame, wanted: DataFrame, table: DataFrame, run, schema: str) -> DataFrame:
    """run over each block's rows and the entries of table that it wants."""
    part = wanted.distinct().join(table, "word")
    return rows.groupBy("block").cogroup(part.groupBy("block")).applyInArrow(run, schema)


def segmented(pages: DataFrame, seeds: tuple[str, ...] = SEEDS, min_count: int = MIN_COUNT) -> DataFrame:
    """(block, page_id, host, path, words) for each row of pages."""
    urls = cut(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block")))
    counts = cut(word_counts(urls.select("url").where(F.col("url").isNotNull()), seeds, min_count))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return cut(_joined(urls, urls.select("block", "url").mapInArrow(_substrings, "block long, word string"), counts, _segment(total), "block long, page_id long, host string, path string, words array<string>"))


def class_counts(rows: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(word, block_n, allow_n) over segmented rows: occurrences in urls that a rule blocks, and in others; the empty word counts urls."""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    return rows.select("host", "path", "words").mapInArrow(_classes(rules), "word string, kind int, n long").groupBy("word").agg(of(0).alias("block_n"), of(1).alias("allow_n"))


def _judge(urls: tuple[int, int], whole: tuple[int, int, int], rules: tuple[tuple[str, str, str], ...], seeds: tuple[str, ...]):
    def run(rows: pa.Table, counts: pa.Table) -> pa.Table:
        bayes = Bayes({w: (a, b) for w, a, b in zip(*(counts.column(c).to_pylist() for c in ("word", "block_n", "allow_n")))}, urls, whole, frozenset(seeds), named_by(rules))
        own = Rules(rules)
        out: tuple[list, ...] = ([], [], [], [])
        for host, path, words in zip(*(rows.column(c).to_pylist() for c in ("host", "path", "words"))):
            odds = bayes.blocks(words) if host else -1.0
            rule = own.find(host, path)
            for column, value in zip(out, (rule and rule[0], rule[1] if rule else "block" if odds > 0 else "allow", odds, " ".join(words))):
                column.append(value)
        kinds = (pa.string(), pa.string(), pa.float64(), pa.string())
        return pa.Table.from_arrays([*(rows.column(c) for c in ("page_id", "host", "path")), *(pa.array(x, k) for x, k in zip(out, kinds))], ["page_id", "host", "path", "rule", "verdict", "log_odds", "words"])

    return run


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, seeds: tuple[str, ...] = SEEDS, min_count: int = MIN_COUNT) -> DataFrame:
    """(page_id, host, path, rule, verdict, log_odds, words) for each row of pages (page_id, url).

    Null url or one without `://`: empty host and path, no rule, allow. log_odds
    over 0 blocks where no rule fits; equal urls are judged alike. Null page_id and
    repeated rows are kept and counted each; an empty table gives an empty result.
    Other columns are ignored. A very long run of letters is split in time in
    proportion to its length.
    """
    rows = segmented(pages, seeds, min_count)
    classes = cut(class_counts(rows, rules))
    word, of_urls = F.col("word") != "", lambda c: F.coalesce(F.max(F.when(F.col("word") == "", F.col(c))), F.lit(0))
    of_words = lambda c: F.coalesce(F.sum(F.when(word, F.col(c))), F.lit(0))
    blocked, allowed, *whole = classes.agg(of_urls("block_n"), of_urls("allow_n"), F.count(F.when(word, 1)), of_words("block_n"), of_words("allow_n")).first()
    wanted = rows.select("block", "words").mapInArrow(_words, "block long, word string")
    return _joined(rows, wanted, classes, _judge((blocked, allowed), tuple(whole), tuple(rules), tuple(seeds)), "page_id long, host string, path string, rule string, verdict string, log_odds double, words string")
