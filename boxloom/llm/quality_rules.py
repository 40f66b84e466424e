"""Quality rules: robust multivariate outliers among statistics of a text, for each language and source.

Base rule: a text fails with fewer than 50 words, or if over half of its words stand in three-word windows that occur
twice or more in it.  Of the rest, each stratum (language and source) gets minimum-covariance-determinant estimates of
centre and covariance of the transformed statistics.  There are three deterministic starts: the stratum's medians and absolute
deviations, those of its language, and mean and covariance of all its rows.  Each takes two concentration steps, which
re-estimate from the ``SHARE`` of rows with the smallest Mahalanobis distance; the start of least determinant goes on
until its determinant falls no more.  A row is rejected if its squared distance is above ``CUTOFF``.  Where the median of a
stratum's distances is above that of the chi-square law, they are scaled down to it; they are never scaled up, as they
are small where floors make them so.

No stratum is pooled and none is judged differently for its size: every estimate is mixed with ``WEIGHT`` rows of a plain target, the medians
and deviations of the stratum's language, themselves mixed with as many rows of those of all (a regularized
minimum covariance determinant).  Statistics are ratios with ``PRIOR`` words of a plain text added, so that short texts are not
outliers by chance, and the squares of ``FLOORS`` are added to the variances, so that a statistic that is constant in a
stratum does not reject small deviations.

Everything runs in DataFrame expressions.  Statistics are whole multiples of 1 / ``GRID``, so that all sums are exact and
no result depends on how rows are dealt; up to 2e10 rows of a stratum fit the sums.  Quantiles are taken from counts of
distances by bins of ``1 / BINS`` of a doubling, medians from counts of equal values, so no stratum is gathered in one task.

Defined results: a null or blank text has no words and fails the base rule; null languages and sources are strata of
their own; repeated rows are judged alike, and rows at equal distance (ties at the quantile) are all taken or none; a text of any length is
counted whole by one task; an empty table gives an empty result; columns named in ``keep`` are passed on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, intermediate, is_small, join_with_hot_keys, kept, stored, table, words

SYMBOLS = "#*$%&|<>"
PUNCTUATION = "!?;:\"'()[]{}~=_^@\\/"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
#: Words of a plain text that are added to each text, and their mean length.
PRIOR, PRIOR_LENGTH = 100.0, 5.0
#: Statistics with the standard deviation that is added to each.
FLOORS = {"log_words": 0.25, "word_length": 0.03, "symbols": 0.03, "dup_lines": 0.10, "repeats": 0.10, "capitals": 0.05, "punctuation": 0.05}
NAMES = list(FLOORS)
N = len(NAMES)
PAIRS = [(i, j) for i in range(N) for j in range(i + 1)]
GRID, BINS = 1024, 16
SHARE, WEIGHT = 0.75, 50.0
#: Variance of a normal law over that of its inner ``SHARE`` in seven dimensions; deviation over median absolute deviation.
CONSISTENCY, NORMAL = 1.325, 1.4826
#: Median, and quantile at 1 - 1e-6, of the chi-square law with seven degrees of freedom.
CHI_MEDIAN, CUTOFF = 6.346, 40.52
#: A determinant has fallen if its logarithm did by so much.
LEAST_FALL = 1e-3
#: Estimates of so many strata are sent to every executor.
BROADCAST_STRATA = 100_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Up to so many different repeated windows, their places are found by search; beyond, by a sort.  Both give the same.
FEW = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and wherever ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(word: Column) -> Column:
    """Number of words in three-word windows that occur twice or more."""

    def covered(places: Column) -> Column:
        following = F.concat(F.slice(places, 2, F.size(places)), F.array(F.element_at(places, -1) + 3))
        return F.aggregate(F.zip_with(places, following, lambda a, b: F.least(F.lit(3), b - a)), F.lit(0), lambda a, b: a + b)

    def by_search(hashes: Column, twice: Column) -> Column:
        return F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())

    def by_sort(hashes: Column) -> Column:
        def equal_neighbour(rows: Column) -> Column:
            same = lambda x, i: (x["h"] == F.get(rows, i - 1)["h"]) | (x["h"] == F.get(rows, i + 1)["h"])
            return F.transform(F.filter(rows, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])

        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.sort_array(let(F.sort_array(placed), equal_neighbour))

    def of(hashes: Column) -> Column:
        def repeats(ordered: Column) -> Column:
            return F.array_distinct(F.filter(ordered, lambda h, i: (i > 0) & (h == F.get(ordered, i - 1))))

        def places(twice: Column) -> Column:
            return F.when(F.size(twice) <= FEW, by_search(hashes, twice)).otherwise(by_sort(hashes))

        found = let(let(let(F.sort_array(hashes), repeats), places), covered)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found)

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return let(word, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows(w), of)))


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the base counts, and those that only the vector uses."""
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda chars: F.char_length(t) - F.char_length(F.translate(t, chars, ""))
    per_word = let(words(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    dups = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    counted = df.withColumns({"__w": per_word, "__l": dups, "word_chars": F.char_length(F.translate(t, SPACES, "")), "n_symbols": without(SYMBOLS), "__capitals": without(CAPITALS), "__punctuation": without(PUNCTUATION)})
    return counted.withColumns({"n_words": F.col("__w.n"), "n_repeat_words": F.col("__w.r"), "n_dup_lines": F.col("__l.d"), "__lines": F.col("__l.n")}).drop("__w", "__l")


def with_vector(df: DataFrame) -> DataFrame:
    n = F.col("n_words") + PRIOR
    chars = F.col("word_chars") + PRIOR * PRIOR_LENGTH
    vector = {
        "log_words": F.log(F.col("n_words") + 1.0),
        "word_length": F.log(chars / n),
        "symbols": F.sqrt(F.col("n_symbols") / chars),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / (F.col("__lines") + 5.0)),
        "repeats": F.sqrt(F.col("n_repeat_words") / n),
        "capitals": F.sqrt(F.col("__capitals") / chars),
        "punctuation": F.sqrt(F.col("__punctuation") / chars),
    }
    return df.withColumns({k: F.round(v * GRID).cast("long") for k, v in vector.items()})


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words").cast("long") > 50 * F.col("n_words").cast("long"))


def medians(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Lower median of ``value`` for each key, from rows (keys, value, n)."""
    order = Window.partitionBy(*keys).orderBy("value")
    ranked = counts.select(*keys, "value", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("all"))
    return ranked.where(2 * F.col("upto") >= F.col("all")).groupBy(*keys).agg(F.min("value").alias("median"), F.first("all").alias("all"))


def centres(counts: DataFrame) -> DataFrame:
    """Arrays ``centre`` and ``spread`` (median, squared deviation) and ``rows`` for each stratum, language and for all: ``of``
    has an empty source for a language and an empty language for all, which no stratum has.  counts: (stratum, name,
    value, n) with the number of the statistic as name."""
    lang, source, whole = F.col("stratum.lang").alias("lang"), F.col("stratum.source").alias("source"), F.lit("")
    levels = F.array(F.struct(lang, source), F.struct(lang, whole.alias("source")), F.struct(whole.alias("lang"), whole.alias("source")))
    keyed = ["of", "name"]
    counts = counts.select(F.explode(levels).alias("of"), "name", "value", "n").groupBy(*keyed, "value").agg(F.sum("n").alias("n"))
    middle = kept(medians(counts, keyed), "medians")
    away = counts.join(middle.drop("all"), keyed).withColumn("value", F.abs(F.col("value") - F.col("median"))).drop("median")
    both = middle.join(medians(away, keyed).select(*keyed, F.col("median").alias("away")), keyed)
    spread = F.pow(F.col("away") * (NORMAL / GRID), F.lit(2.0))
    ordered = both.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("name", (F.col("median") / GRID).alias("c"), spread.alias("s")))).alias("x"), F.first("all").alias("rows"))  # as many entries as statistics
    return ordered.select("of", F.col("x.c").alias("centre"), F.col("x.s").alias("spread"), "rows")


def mixed(own: Column, target: Column, w: Column) -> Column:
    return w * own + (1 - w) * target


def targets(found: DataFrame) -> DataFrame:
    """For each language, its centre ``tc`` and spread ``ts``, mixed with ``WEIGHT`` rows of those of all; found: ``centres``."""
    everything = found.where("of.lang = ''").select(F.col("centre").alias("ac"), F.col("spread").alias("as"))
    languages = found.where("of.lang <> '' and of.source = ''").crossJoin(F.broadcast(everything))  # one row
    w = F.col("rows") / (F.col("rows") + WEIGHT)
    between = F.transform(F.zip_with("centre", "ac", lambda a, b: (a - b) * (a - b)), lambda x: x * w * (1 - w))
    spread = F.zip_with(F.zip_with("spread", "as", lambda a, b: mixed(a, b, w)), between, lambda a, b: a + b)
    return languages.select("of.lang", F.zip_with("centre", "ac", lambda a, b: mixed(a, b, w)).alias("tc"), spread.alias("ts"))


def sums() -> list[Column]:
    x = [F.col(c) for c in NAMES]
    return [F.count("*").alias("n"), *[F.sum(c).alias(f"u{i}") for i, c in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"v{i}_{j}") for i, j in PAIRS]]


def summed() -> Column:
    """``sums`` but the number of rows as one array ``x``."""
    return F.array(*[f"u{i}" for i in range(N)], *[f"v{i}_{j}" for i, j in PAIRS]).alias("x")


#: The entries of a lower triangle by rows: their places, and where the rows of i and j begin.
ENTRIES = "array(" + ", ".join(f"named_struct('at', {at}, 'i', {i}, 'j', {j}, 'r', {i * (i + 1) // 2}, 'q', {j * (j + 1) // 2})" for at, (i, j) in enumerate(PAIRS)) + ")"
SQUARES = "array(" + ", ".join(f"{x * x!r}D" for x in FLOORS.values()) + ")"


def factored(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with the centre ``m``, the inverse ``inv`` of the Cholesky factor of the covariance ``s`` (lower triangle),
    to whose diagonal the floors are added, and ``logdet``.  Each entry needs only those before it.  These are a few
    rows for each stratum; lambdas keep their plans and code small."""
    dot = "aggregate(zip_with(slice(l, e.r + 1, e.j), slice(l, e.q + 1, e.j), (x, y) -> x * y), 0D, (a, x) -> a + x)"
    entry = f"CASE WHEN e.i = e.j THEN sqrt(greatest(s[e.at] + {SQUARES}[e.i] - {dot}, {SQUARES}[e.i])) ELSE (s[e.at] - {dot}) / l[e.q + e.j] END"
    lower = rows.withColumn("lower", F.expr(f"aggregate({ENTRIES}, cast(array() AS array<double>), (l, e) -> concat(l, array({entry})))"))
    above = "aggregate(sequence(e.j, e.i - 1), 0D, (a, k) -> a + lower[e.r + k] * v[cast(k * (k + 1) / 2 AS int) + e.j])"
    inverse = f"CASE WHEN e.i = e.j THEN 1D / lower[e.r + e.j] ELSE - {above} / lower[e.r + e.i] END"
    logdet = f"aggregate(sequence(0, {N - 1}), 0D, (a, k) -> a + 2 * ln(lower[cast(k * (k + 3) / 2 AS int)]))"
    return lower.select(*keep, "m", F.expr(f"aggregate({ENTRIES}, cast(array() AS array<double>), (v, e) -> concat(v, array({inverse})))").alias("inv"), F.expr(logdet).alias("logdet"))


def estimates(rows: DataFrame, factor: float) -> DataFrame:
    """``rows`` with centre ``m`` and covariance ``s`` (lower triangle) from sums ``x`` over ``n`` rows (covariances times
    ``factor``), mixed with the target tc, ts; ``rows``: the stratum's."""
    first = rows.withColumns({"w": F.col("rows") / (F.col("rows") + WEIGHT), "o": F.expr(f"transform(slice(x, 1, {N}), y -> y / n / {GRID})"), "v": F.slice("x", N + 1, len(PAIRS))})
    own = f"w * {factor!r}D * (v[e.at] / n / {GRID * GRID} - o[e.i] * o[e.j])"
    between = "w * (1 - w) * (o[e.i] - tc[e.i]) * (o[e.j] - tc[e.j])"
    cov = F.expr(f"transform({ENTRIES}, e -> {own} + {between} + CASE WHEN e.i = e.j THEN (1 - w) * ts[e.i] ELSE 0D END)")
    return first.withColumns({"m": F.expr("zip_with(o, tc, (x, y) -> w * x + (1 - w) * y)"), "s": cov})


def diagonal(spread: str) -> Column:
    """The covariance of independent statistics."""
    return F.expr(f"transform({ENTRIES}, e -> CASE WHEN e.i = e.j THEN {spread}[e.i] ELSE 0D END)")


def known(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows``, none of which lacks a value of ``names``: saying so halves the code that is generated for them."""
    return rows.where(" and ".join(f"{c} is not null" for c in names))


def with_fit(rows: DataFrame, fit: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """``rows`` with the entries of their stratum's estimates as columns; small: ``fit`` can be sent to every executor."""
    entries = {f"m{i}": F.get("m", F.lit(i)) for i in range(N)} | {f"w{k}": F.get("inv", F.lit(k)) for k in range(len(PAIRS))}
    flat = known(fit.select("*", *[v.alias(k) for k, v in entries.items()]).drop("m", "inv"), list(entries))
    return rows.join(F.broadcast(flat), "stratum", how) if small else join_with_hot_keys(rows, flat, "stratum", how=how)


def with_distance(rows: DataFrame) -> DataFrame:
    """``rows``, joined with their fit, with the squared Mahalanobis distance ``d2``."""
    off = rows.withColumns({f"y{i}": F.col(name) / GRID - F.col(f"m{i}") for i, name in enumerate(NAMES)})
    z = [sum((F.col(f"w{i * (i + 1) // 2 + j}") * F.col(f"y{j}") for j in range(i + 1)), F.lit(0.0)) for i in range(N)]
    return off.withColumn("d2", sum((F.pow(x, F.lit(2.0)) for x in z), F.lit(0.0)))


def concentrated(rows: DataFrame, fit: DataFrame, small: bool) -> DataFrame:
    """A concentration step of each (stratum, start) of ``fit``: new estimates, the median bin of the distances, and the
    old estimates ``m0``, ``inv0`` and determinant ``before``.  The bins of a stratum and start, some hundreds at most, are
    added up in one array: with windows and a second set of sums the driver compiles half as much code again."""
    keys = ["stratum", "start"]
    near = with_distance(with_fit(rows, fit.select(*keys, "m", "inv"), small)).withColumn("bin", F.floor(F.log2(F.col("d2") + 2.0**-10) * BINS))
    bins = near.groupBy(*keys, "bin").agg(*sums()).select(*keys, "bin", "n", summed())
    grouped = bins.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "n", "x"))).alias("bins"))  # as many entries as bins
    counted = grouped.withColumn("all", F.expr("aggregate(bins, 0L, (a, e) -> a + e.n)"))
    none = f"named_struct('upto', 0L, 'n', 0L, 'x', array_repeat(0L, {N + len(PAIRS)}), 'middle', cast(null AS bigint))"
    inner = f"a.upto < all * {SHARE!r}D"
    added = f"'n', if({inner}, a.n + e.n, a.n), 'x', if({inner}, zip_with(a.x, e.x, (p, q) -> p + q), a.x)"
    middle = "coalesce(a.middle, if(2 * (a.upto + e.n) >= all, e.bin, null))"
    total = F.expr(f"aggregate(bins, {none}, (a, e) -> named_struct('upto', a.upto + e.n, {added}, 'middle', {middle}))")
    before = fit.select(*keys, "rows", "tc", "ts", F.col("m").alias("m0"), F.col("inv").alias("inv0"), F.col("logdet").alias("before"))
    total = counted.select(*keys, total.alias("t")).select(*keys, "t.n", "t.x", "t.middle").join(before, keys)
    return factored(estimates(total, CONSISTENCY), [*keys, "rows", "tc", "ts", "middle", "m0", "inv0", "before"])


def beginnings(rows: DataFrame) -> DataFrame:
    """The three starts of each stratum, with its number of ``rows`` and its target ``tc``, ``ts``."""
    names = F.array(*[F.struct(F.lit(i).alias("name"), F.col(c).alias("value")) for i, c in enumerate(NAMES)])
    counts = stored(rows.select("stratum", F.inline(names)).groupBy("stratum", "name", "value").agg(F.count("*").alias("n")), "value-counts")
    found = stored(centres(counts), "centres")
    strata = found.where("of.source <> ''").withColumnRenamed("of", "stratum").withColumn("lang", F.col("stratum.lang")).join(targets(found), "lang")
    whole = rows.groupBy("stratum").agg(*sums()).select("stratum", "n", summed())
    both = estimates(strata.join(whole, "stratum"), 1.0)
    own = {"oc": F.zip_with("centre", "tc", lambda a, b: mixed(a, b, F.col("w"))), "os": F.zip_with("spread", "ts", lambda a, b: mixed(a, b, F.col("w")))}
    start = lambda i, m, s: F.struct(F.lit(i).alias("start"), F.col(m).alias("m"), s.alias("s"))
    starts = F.array(start(0, "oc", diagonal("os")), start(1, "tc", diagonal("ts")), start(2, "m", F.col("s")))
    kinds = both.withColumns(own).select("stratum", "rows", "tc", "ts", F.inline(starts))
    return factored(kinds, ["stratum", "start", "rows", "tc", "ts"])


def fitted(rows: DataFrame) -> DataFrame:
    """Estimates of least determinant for each stratum, with ``scale`` from squared distance to chi-square.  Every step
    writes its estimates, a row per stratum and start, so that plans stay short; what a step needs goes along in them, so
    that each takes one query and two joins, as every query and broadcast costs memory of the driver."""
    fit = stored(beginnings(rows), "estimates")
    small = is_small(fit, BROADCAST_STRATA)
    for _ in range(2):
        fit = stored(concentrated(rows, fit, small), "estimates")
    best = F.min(F.struct("logdet", "start", "rows", "tc", "ts", "m", "inv")).alias("best")
    fit = stored(fit.groupBy("stratum").agg(best).select("stratum", "best.*"), "estimates")
    small = small or is_small(fit, BROADCAST_STRATA)
    done = []
    while not done or not fit.isEmpty():
        step = stored(concentrated(rows, fit, small), "estimates")
        falls = F.col("logdet") < F.col("before") - LEAST_FALL
        # the step's median is that of distances under the estimates before it, which are final if it lowers nothing
        scale = F.least(F.lit(1.0), F.lit(CHI_MEDIAN) / F.pow(F.lit(2.0), (F.col("middle") + 1) / BINS))
        done.append(step.where(~falls).select("stratum", F.col("m0").alias("m"), F.col("inv0").alias("inv"), scale.alias("scale")))
        fit = step.where(falls)
    return reduce(DataFrame.union, done)


def quality_rules(df: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The columns ``keep`` of each row, the base counts, base_failed, distance and kept."""
    spark = df.sparkSession
    names = [c for c in keep if c not in (*COUNTS, "base_failed", "distance", "kept")]
    passed = F.struct(*names) if names else F.lit(None).cast("struct<x:int>")  # out of reach of the names used here
    plain = df.select(passed.alias("__kept"), F.col(text).alias("__text"), F.col(lang).alias("__lang"), F.col(source).alias("__source"))
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    stratum = F.struct(part("__lang").alias("lang"), part("__source").alias("source"))
    counted = with_vector(with_counts(plain, "__text"))
    rows = stored(counted.select("__kept", stratum.alias("stratum"), *COUNTS, *NAMES, base_failed().alias("base_failed")), "statistics")
    good = known(rows.where("not base_failed"), NAMES).select("stratum", *NAMES)
    if good.isEmpty():
        judged = rows.withColumns({"d2": F.lit(None).cast("double"), "scale": F.lit(1.0)})
    else:
        with intermediate(spark):
            fit = kept(fitted(good), "estimates")
        judged = with_distance(with_fit(rows, fit, is_small(fit, BROADCAST_STRATA), "left"))
    distance = F.col("d2") * F.col("scale")
    out = [F.col(f"__kept.`{c}`").alias(c) for c in names]
    return judged.select(*out, *[F.col(c).cast("long").alias(c) for c in COUNTS], "base_failed", distance.alias("distance"), (~F.col("base_failed") & F.coalesce(distance <= CUTOFF, F.lit(True))).alias("kept"))


def op10_quality_rules(spark, sf_dir) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), ["doc_id"])
