"""Operator 5: quality rules with robust multivariate outliers, in DataFrame functions only.

Base rules reject short and repetitive texts. The others are measured by four
transformed shares (mean word length, symbols, duplicate lines, repeated words);
for each language and source the minimum-covariance-determinant estimate of
their centre and scatter is sought by concentration steps (Rousseeuw and Van
Driessen, "A fast algorithm for the minimum covariance determinant estimator",
1999) from several deterministic starts at the medians (Hubert, Rousseeuw and
Verdonck, "A deterministic algorithm for robust location and scatter", 2012):
median deviations alone, and with the correlations of spatial signs and of
hyperbolic tangents. Of the ends of all starts the one of least determinant is the
group's estimate, and a text is rejected by its Mahalanobis distance.

Everything is counted over all rows that pass the base rules. Order statistics
come from histograms of fixed fine bins, which add up in any order and are of
bounded size for each group. Groups of fewer than min_rows rows join their
language's pool, and too small pools join one pool. Estimates are a small table;
it is broadcast only when its rows were counted to be few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import cut

MIN_ROWS = 200  # of a group with an estimate of its own; a parameter
SUBSET = 0.75  # part of the rows that the estimate describes
STEPS = 4  # of each start
STARTS = 3
FLOOR = (0.06, 0.25, 0.25, 0.15)  # scatter below which differences mean nothing, for each statistic
# chi-square quantiles, for SUBSET and for 0.999, with one degree of freedom: floors can leave but one statistic
# that varies, and of all whole degrees one has the farthest tail for the same SUBSET quantile
CHI_SUBSET = 1.3233
CUTOFF = 10.8276
BROADCAST_GROUPS = 50_000
D = 4
BINS = 64  # bins to a unit of a statistic, or of the logarithm of a distance
SPACES = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of three words found twice or more.

    Windows are sorted as (hash bits, position) packed into one long; neighbours
    with equal bits are candidates, of which the whole hashes decide.
    """
    n = F.size(words)

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(-1).alias("e"), F.lit(0).alias("c"))
        grow = lambda acc, x: F.struct((x + 2).cast("int").alias("e"), (acc["c"] + F.least(F.lit(3), x + 2 - acc["e"])).cast("int").alias("c"))
        return F.aggregate(F.sort_array(positions), start, grow)["c"]

    def again(rows: Column, same) -> Column:
        """Those equal to the one before or after."""
        near = lambda x, j: F.coalesce(same(x, F.get(rows, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(rows, j + 1)), F.lit(False))
        return F.filter(rows, near)

    def count(hashes: Column) -> Column:
        bits = F.ceil(F.log2(F.size(hashes) + F.lit(1.0))).cast("int")

        def packed(k: Column) -> Column:
            low = F.call_function("shiftleft", F.lit(1).cast("long"), k)
            rows = F.sort_array(F.transform(hashes, lambda h, i: F.call_function("shiftleft", h, k).bitwiseOR(i.cast("long"))))
            bits_of = lambda x: F.call_function("shiftright", x, k)
            near = _let(rows, lambda s: again(s, lambda x, y: bits_of(x) == bits_of(y)))
            return F.transform(near, lambda x: x.bitwiseAND(low - 1).cast("int"))

        def exact(candidates: Column) -> Column:
            rows = F.array_sort(F.transform(candidates, lambda i: F.struct(F.get(hashes, i).alias("h"), i.alias("i"))))
            twice = _let(rows, lambda s: again(s, lambda x, y: x["h"] == y["h"]))
            return F.when(F.size(candidates) == 0, F.lit(0)).otherwise(covered(F.transform(twice, lambda x: x["i"])))

        return _let(_let(bits, packed), exact)

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 4, F.lit(0)).otherwise(_let(hashes, count)).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts of each row of docs; null texts have none."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = docs.select("doc_id", "lang", "source", text.alias("text"), F.array_remove(F.split(text, SPACES), "").alias("words"), lines.alias("lines"))
    return words.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    ).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def _measures() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n).alias("x0"),
        F.log1p(20 * F.col("n_symbols") / n).alias("x1"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("x2"),
        F.sqrt(F.col("n_repeat_words") / n).alias("x3"),
    ]


def _bin(x: Column) -> Column:
    return F.floor(x * BINS).cast("int")


def _quantile_bins(binned: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, top): the first bin by which share of the rows is reached."""
    counts = binned.groupBy(*keys, "bin").count()
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.withColumn("upto", F.sum("count").over(upto)).withColumn("n", F.sum("count").over(Window.partitionBy(*keys)))
    return sums.where(F.col("upto") >= share * F.col("n")).groupBy(*keys).agg(F.min("bin").alias("top"))


def _small(table: DataFrame) -> DataFrame:
    """A table of groups, computed; broadcast if it has few rows."""
    done = cut(table)
    return F.broadcast(done) if done.count() <= BROADCAST_GROUPS else done


def _grouped(rows: DataFrame, min_rows: int) -> DataFrame:
    """rows with the column g, the name of the group that describes them."""
    sizes = rows.groupBy("lang", "source").count()
    own = sizes.withColumn("own", F.col("count") >= min_rows)
    rest = own.withColumn("pool", F.sum(F.when(~F.col("own"), F.col("count")).otherwise(0)).over(Window.partitionBy("lang")))
    names = rest.select(
        F.col("lang").alias("l"),
        F.col("source").alias("s"),
        F.when(F.col("own"), F.to_json(F.array("lang", "source"))).when(F.col("pool") >= min_rows, F.to_json(F.array("lang"))).otherwise("").alias("g"),
    )
    names = _small(names)
    return rows.join(names, rows["lang"].eqNullSafe(names["l"]) & rows["source"].eqNullSafe(names["s"])).drop("l", "s")


def _start(rows: DataFrame) -> DataFrame:
    """Estimates from which the concentration of each group begins: STARTS of them, told apart by start.

    All are at the medians. The scatter is that of median deviations, with no
    correlation, with that of spatial signs, or with that of hyperbolic tangents.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"x{i}").alias("x")) for i in range(D)])).alias("p")
    long = rows.select("g", pairs).select("g", "p.f", "p.x")
    medians = _small(_quantile_bins(long.withColumn("bin", _bin(F.col("x"))), ["g", "f"], 0.5).select("g", "f", ((F.col("top") + 0.5) / BINS).alias("m")))
    off = long.join(medians, ["g", "f"]).withColumn("bin", _bin(F.abs(F.col("x") - F.col("m"))))
    spread = _quantile_bins(off, ["g", "f"], 0.5).select("g", "f", (1.4826 * (F.col("top") + 0.5) / BINS).alias("s"))
    both = medians.join(spread, ["g", "f"])
    of = lambda i, c: F.max(F.when(F.col("f") == i, F.col(c)))
    wide = _small(both.groupBy("g").agg(*[of(i, "m").alias(f"m{i}") for i in range(D)], *[of(i, "s").alias(f"s{i}") for i in range(D)]))
    scaled = rows.join(wide, "g").select("g", *[((F.col(f"x{i}") - F.col(f"m{i}")) / F.sqrt(F.col(f"s{i}") ** 2 + FLOOR[i] ** 2)).alias(f"z{i}") for i in range(D)])
    scaled = scaled.withColumn("r", F.sqrt(sum(F.col(f"z{i}") * F.col(f"z{i}") for i in range(D))))
    lower = [(i, j) for i in range(D) for j in range(i + 1)]
    sign = lambda i: F.when(F.col("r") > 0, F.col(f"z{i}") / F.col("r")).otherwise(0.0)
    bent = lambda i: F.tanh(f"z{i}")
    shapes = scaled.groupBy("g").agg(*[F.avg(y(i) * y(j)).alias(f"{n}{i}{j}") for n, y in (("u", sign), ("t", bent)) for i, j in lower])
    linked = lambda n, i, j: F.coalesce(F.col(f"{n}{i}{j}") / F.sqrt(F.greatest(F.col(f"{n}{i}{i}") * F.col(f"{n}{j}{j}"), F.lit(1e-12))), F.lit(0.0)) if i != j else F.lit(1.0)
    correlations = [lambda i, j: F.lit(float(i == j)), lambda i, j: linked("u", i, j), lambda i, j: linked("t", i, j)]
    starts = [F.struct(F.lit(k).alias("start"), *[(F.col(f"s{i}") * F.col(f"s{j}") * c(i, j)).alias(f"c{i}{j}") for i, j in lower]) for k, c in enumerate(correlations)]
    centred = wide.join(shapes, "g").select("g", *[f"m{i}" for i in range(D)], F.inline(F.array(*starts)))
    return _factored(centred)


def _factored(table: DataFrame) -> DataFrame:
    """g, start, the centre m and the Cholesky factor l of the scatter c with the floors added."""
    for i in range(D):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (FLOOR[i] ** 2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            table = table.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return table.select("g", "start", *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i in range(D) for j in range(i + 1)])


def _determinant() -> Column:
    """Logarithm of the scatter's determinant."""
    return sum(2 * F.log(F.col(f"l{i}{i}")) for i in range(D))


def _least(estimates: DataFrame) -> DataFrame:
    """Of each group's estimates the one of least determinant; of equal ones the first start."""
    own = [c for c in estimates.columns if c != "g"]
    best = estimates.groupBy("g").agg(F.min_by(F.struct(*own), F.struct(_determinant(), F.col("start"))).alias("e"))
    return best.select("g", *[f"e.{c}" for c in own])


def _distances(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """rows with the squared distance d2 to each of their group's estimates, told apart by start."""
    out = rows.join(estimates, "g")
    for i in range(D):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return out.withColumn("d2", sum(F.col(f"z{i}") * F.col(f"z{i}") for i in range(D))).select(*rows.columns, "start", "d2")


def _log_bin() -> Column:
    return _bin(F.log(F.col("d2") + 1e-6))


def _concentrated(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One step of all starts: centre and scatter of the SUBSET of each group that is nearest to the estimate."""
    far = _distances(rows, estimates).withColumn("bin", _log_bin())
    tops = _small(_quantile_bins(far, ["g", "start"], SUBSET))
    near = far.join(tops, ["g", "start"]).where("bin <= top")
    sums = near.groupBy("g", "start").agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"t{i}") for i in range(D)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(D) for j in range(i + 1)])
    means = [(F.col(f"t{i}") / F.col("n")).alias(f"m{i}") for i in range(D)]
    scatter = [(F.col(f"q{i}{j}") / F.col("n") - F.col(f"t{i}") / F.col("n") * F.col(f"t{j}") / F.col("n")).alias(f"c{i}{j}") for i in range(D) for j in range(i + 1)]
    return _factored(sums.select("g", "start", *means, *scatter))


def estimated(rows: DataFrame) -> DataFrame:
    """The estimate of each group g of rows (g, x0, x1, ...): start, centre m and factor l."""
    estimates = _small(_start(rows))
    for _ in range(STEPS):
        estimates = _small(_concentrated(rows, estimates))
    return _small(_least(estimates))


def judge(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed, distance and kept for each row of docs (doc_id, text, lang, source).

    distance: squared Mahalanobis distance, scaled so that its quantile
    of SUBSET is that of chi-square; null where the base rules fail. kept: they pass and it is CUTOFF
    at most. Null text: no words, failed. Null lang or source: a group of its
    own; one of fewer than min_rows joins its language's, and then all small ones.
    Equal rows are judged alike. A text's words are one array. An empty table gives an empty result. Other
    columns are ignored.
    """
    counted = cut(statistics(docs))
    rows = counted.where("not base_failed").select("doc_id", "lang", "source", *_measures())
    rows = _grouped(rows, min_rows).select("g", *[f"x{i}" for i in range(D)])
    estimates = estimated(rows)
    middle = _quantile_bins(_distances(rows, estimates).withColumn("bin", _log_bin()), ["g"], SUBSET)
    scale = _small(middle.select("g", (F.exp((F.col("top") + 0.5) / BINS) / CHI_SUBSET).alias("scale")))
    passed = _grouped(counted.where("not base_failed").select("*", *_measures()), min_rows)
    passed = _distances(passed, estimates).join(scale, "g").withColumn("distance", F.col("d2") / F.col("scale"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    failed = counted.where("base_failed").select(*columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return passed.select(*columns, "distance", (F.col("distance") <= CUTOFF).alias("kept")).union(failed)
