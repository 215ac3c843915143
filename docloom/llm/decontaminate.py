"""Operator 8: benchmark decontamination by templates, in DataFrame functions only.

Texts are brought to canonical forms that don't depend on white space. In the
typed form numbers, units and runs of names are typed placeholders, so a question
with other values has the same template; in the plain form names are lower-cased
words, so it doesn't depend on case. Windows of tokens of the documents are
hash-joined with those of the benchmark, and an item of fewer tokens than a window
with document windows of its own length. A window of slots only has no template, so
its values are compared: a table of numbers doesn't meet every other one.

Matches of one document and item on one diagonal (document position less item
position) make segments. Segments whose positions rise, on diagonals at most DRIFT
apart, make chains, as a value of another length moves the diagonal. A chain's
slots must be consistent: one value of the item always stands for the same value
of the document, and the other way round. An item leaks into a document when a
chain holds SHARE of its windows or a run of RUN tokens.

The benchmark's windows are broadcast if they were counted to be few, else they
are joined by a shuffle. Nothing depends on how many documents hold an item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .storage import column, cut

WINDOW = 8
SHARE = 0.5
RUN = 20  # tokens that match without a break and are a leak, however long the item is
DRIFT = 8  # diagonals between two segments of a chain
LITERALS = 4  # of a shorter item than a window, for it to be found with other values
BROADCAST_WINDOWS = 1_000_000
BROADCAST_DOCS = 200_000

# fixed values: units that may follow a number
UNITS = (
    "km kg cm mm m g mg t lb lbs oz ft in mi mph kmh ml l s sec secs min mins h hr hrs "
    "seconds minutes hours days weeks months years meters metres miles pounds grams liters litres "
    "percent dollars euros pounds cents usd eur gbp"
).split()
NUMBER, NAME, UNIT, END = "\x01", "\x02", "\x03", "\x04"  # END closes a run of names
TYPED, PLAIN, EITHER = 0, 1, 2  # forms; a text without names has one form


def tokens(text: Column) -> Column:
    """Words and numbers in order; a number, run of names or unit begins with its type mark and keeps its value."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x01-\x04\s\p{Z}&&[^ ]][\x01-\x04\s\p{Z}]*+| [\x01-\x04\s\p{Z}]++", " ")
    numbers = F.regexp_replace(text, r"(?<![\p{L}\p{N}])([0-9]+(?:[.,:/][0-9]+)*)", NUMBER + "$1 ")
    units = F.regexp_replace(numbers, rf"(?i)({NUMBER}[0-9.,:/]+ )\s*({'|'.join(sorted(set(UNITS), key=lambda x: (-len(x), x)))}|[%$€£])(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2 ")
    numbers = F.when(text.rlike("[0-9]"), units).otherwise(text)
    names = F.regexp_replace(numbers, r"(?<=[\p{L}\p{N}][,;:]{0,1} )(\p{Lu}\p{L}++(?: \p{Lu}\p{L}++)*+)", NAME + "$1" + END)
    return F.regexp_extract_all(F.lower(names), F.lit(rf"{NUMBER}[0-9.,:/]+|{NAME}[^{END}]+|{UNIT}[^\s]+|[\p{{L}}\p{{N}}]+"), F.lit(0))


def _is_slot(token: Column) -> Column:
    return token < END


def _forms(texts: DataFrame, key: str) -> DataFrame:
    """(key, form, words) for the forms of each text; names are marked in both, one by one in the plain form."""
    one_by_one = lambda t: F.when(t.startswith(NAME), F.transform(F.split(F.substr(t, F.lit(2)), " "), lambda w: F.concat(F.lit(NAME), w))).otherwise(F.array(t))
    worded = texts.select(key, F.explode(F.array(tokens(F.col("text")))).alias("words"))
    plain = F.when(F.exists("words", lambda t: t.startswith(NAME) & t.contains(" ")), F.flatten(F.transform("words", one_by_one))).otherwise(F.col("words"))
    form = lambda f, words: F.struct(F.lit(f).alias("form"), words.alias("words"))
    forms = F.when(F.exists("words", lambda t: t.startswith(NAME)), F.array(form(TYPED, F.col("words")), form(PLAIN, plain))).otherwise(F.array(form(EITHER, F.col("words"))))
    return worded.select(key, F.inline(forms))


def _bare(token: Column) -> Column:
    return F.when(token.startswith(NAME), F.substr(token, F.lit(2))).otherwise(token)


def _windows(formed: DataFrame, widths: list[int], whole: bool = False) -> DataFrame:
    """formed's columns but words, with (at, h) for each window; whole: one shorter than WINDOW only where it is the text."""
    is_open = lambda t: _is_slot(t) & ~((F.col("form") == PLAIN) & t.startswith(NAME))
    hashes = F.transform("words", lambda t: F.xxhash64(F.when(is_open(t), F.substring(t, 1, 1)).otherwise(_bare(t))))

    def hashed(h: Column, i: Column, w: int) -> Column:
        """Hash of a window; of its values where all tokens are slots, which the first tells of most windows."""
        words = [F.get("words", i + k) for k in range(w)]
        none = reduce(lambda rest, t: is_open(t) & rest, reversed(words[:-1]), is_open(words[-1]))  # the first token decides most windows
        return F.when(none, F.xxhash64(F.lit(END), *words)).otherwise(F.xxhash64(*[F.get(h, i + k) for k in range(w)]))

    rows = lambda h, w: F.transform(F.sequence(F.lit(0), F.size(h) - w), lambda i: F.struct(i.alias("at"), hashed(h, i, w).alias("h")))
    fits = lambda h, w: F.size(h) == w if whole and w < WINDOW else F.size(h) >= w
    none = F.array().cast("array<struct<at:int,h:bigint>>")
    each = lambda h: F.concat(*[F.when(fits(h, w), rows(h, w)).otherwise(none) for w in widths])
    return formed.select(*[c for c in formed.columns if c != "words"], F.inline(F.transform(F.array(hashes), each)[0]))


def _chains(segments: Column) -> Column:
    """The best chain that ends with each of the segments, which are sorted."""
    kind = "array<struct<n:int,run:int,members:array<struct<lo:int,hi:int,shift:int>>>>"

    def grow(chains: Column, s: Column) -> Column:
        def follows(c: Column) -> Column:
            last = F.element_at(c["members"], -1)
            return (last["hi"] < s["lo"]) & (last["hi"] + last["shift"] < s["lo"] + s["shift"]) & (F.abs(last["shift"] - s["shift"]) <= DRIFT)

        n = s["hi"] - s["lo"] + 1
        longer = lambda c: F.struct((F.coalesce(c["n"], F.lit(0)) + n).alias("n"), F.greatest(F.coalesce(c["run"], F.lit(0)), n).alias("run"), F.when(c.isNull(), F.array(s)).otherwise(F.concat(c["members"], F.array(s))).alias("members"))
        return F.concat(chains, F.transform(F.array(F.array_max(F.filter(chains, follows))), longer)).cast(kind)

    return F.aggregate(segments, F.array().cast(kind), grow)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, n_hits, n_slots, n_changed) for each item that a document holds.

    docs: doc_id, text; benchmark: item_id, text; both may have other columns.
    n_changed counts slots whose value is another than in the item. An item of
    fewer than eight tokens matches as a whole, anywhere in a document; with other
    values only if it has LITERALS other tokens or is the whole document. Null or
    empty texts match nothing; rows with a null doc_id or item_id are left out.
    Rows with the same doc_id are taken together, so repeated ones change nothing.
    A text's tokens are one array, so it can't be longer than a row. Empty tables
    give an empty result; other columns are ignored.
    """
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    items = cut(_forms(benchmark.select("item_id", "text").where(F.col("item_id").isNotNull()), "item_id").where(F.size("words") > 0).withColumn("width", F.least(F.size("words"), F.lit(WINDOW))))
    wanted = cut(_windows(items, list(range(1, WINDOW + 1)), whole=True).select("item_id", F.col("form").alias("item_form"), "width", F.col("at").alias("item_at"), "h"))
    widths = sorted({WINDOW, *(r["width"] for r in items.select("width").distinct().collect())})
    sizes = wanted.groupBy("item_id", "item_form").agg(F.count("*").alias("n_windows"))
    few = wanted.count() <= BROADCAST_WINDOWS
    hits = _windows(_forms(docs, "doc_id"), widths).join(F.broadcast(wanted) if few else wanted, "h")
    hits = hits.where((F.col("form") == F.col("item_form")) | (F.col("form") == EITHER) | (F.col("item_form") == EITHER))
    pair = ["doc_id", "form", "item_id", "item_form", "width"]
    hits = hits.groupBy(*pair, (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_set("item_at").alias("at"))
    edges = lambda step: F.sort_array(F.filter("at", lambda x: ~F.array_contains("at", x + step)))
    segments = F.zip_with(edges(-1), edges(1), lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"), F.col("shift").alias("shift")))
    hits = hits.select(*pair, F.size("at").alias("n"), segments.alias("segments")).groupBy(*pair).agg(F.sum("n").alias("n"), F.sort_array(F.flatten(F.collect_list("segments"))).alias("segments"))
    enough = lambda n, run: (n >= SHARE * F.col("n_windows")) | (run >= RUN - WINDOW + 1)
    hits = hits.join(sizes, ["item_id", "item_form"]).where(enough(F.col("n"), F.col("n")))
    chains = F.filter(_chains(F.col("segments")), lambda c: enough(c["n"], c["run"]))
    found = cut(hits.select(*pair, "n_windows", F.inline(chains)))
    holders = found.select("doc_id").distinct()
    small = holders.count() <= BROADCAST_DOCS
    texts = _forms(docs.join(F.broadcast(holders) if small else holders, "doc_id", "left_semi"), "doc_id").withColumnRenamed("words", "doc_words")
    found = found.join(items.select("item_id", F.col("form").alias("item_form"), F.col("words").alias("item_words")), ["item_id", "item_form"]).join(texts, ["doc_id", "form"])

    def reach(m: Column, j: Column) -> Column:
        """Item positions of a segment; in the plain form also those since the one before on its diagonal."""
        before = F.get("members", j - 1)
        lo = F.when((F.col("item_form") == PLAIN) & (before["shift"] == m["shift"]), before["hi"] + 1).otherwise(m["lo"])
        return F.transform(F.sequence(lo, m["hi"] + F.col("width") - 1), lambda i: F.struct(F.get("item_words", i).alias("a"), F.get("doc_words", i + m["shift"]).alias("b")))

    pairs = F.filter(F.flatten(F.transform("members", reach)), lambda p: _is_slot(p["a"]) & ((F.substring(p["a"], 1, 1) == F.substring(p["b"], 1, 1)) | (_bare(p["a"]) == _bare(p["b"]))))
    pairs = F.array_distinct(F.transform(pairs, lambda p: F.struct(_bare(p["a"]).alias("a"), _bare(p["b"]).alias("b"))))
    literals = F.size(F.filter("item_words", lambda t: ~_is_slot(t)))
    checked = found.select("doc_id", "item_id", "n_windows", F.col("n").cast("long").alias("n_hits"), pairs.alias("pairs"), ((F.col("width") == WINDOW) | (literals >= LITERALS) | (F.size("doc_words") == F.size("item_words"))).alias("template"))
    different = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))
    checked = checked.where((different("a") == F.size("pairs")) & (different("b") == F.size("pairs")))
    checked = checked.select("doc_id", "item_id", "n_windows", "n_hits", F.size("pairs").alias("n_slots"), F.size(F.filter("pairs", lambda p: p["a"] != p["b"])).alias("n_changed"), "template")
    checked = checked.where(F.col("template") | (F.col("n_changed") == 0))
    best = F.max(F.struct("n_hits", (-F.col("n_changed")).alias("kept"), "n_slots", "n_windows")).alias("best")
    both = checked.groupBy("doc_id", "item_id").agg(best)
    return both.select("doc_id", "item_id", "best.n_windows", "best.n_hits", F.col("best.n_slots").cast("long").alias("n_slots"), (-F.col("best.kept")).cast("long").alias("n_changed"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs into which no item leaks; all columns stay. Rows with a null doc_id stay."""
    held = leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti").select(*map(column, docs.columns))
