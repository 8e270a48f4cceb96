"""Quality rules by robust multivariate outliers, with DataFrame functions only.

Each document gives five statistics (words, mean word length, symbols, repeated lines, repeated words), transformed so
that ordinary prose is near normal. For each pair of language and source the minimum-covariance-determinant estimate
of centre and covariance is found: from medians with median absolute deviations, concentration steps keep the share H
of rows with the smallest Mahalanobis distances and take their moments, until no group's determinant falls. One more
step takes the moments of all rows within the 0.975 quantile. Up to H and in the start nearly half of a group may be
outlying; the plain moments are no start, because a third of equal rows ends with the smaller determinant from there.
The covariance is made consistent for normal data and widened by a floor for each statistic, since clean prose has
none of some of them. A document whose squared distance is over the chi-squared cut is rejected. Documents that fail
the base rules take no part in the estimates. Groups of fewer than `least` usable rows are estimated together as one
pool.

Quantiles are merged sketches and moments are partial sums, so a group with a third of all rows costs no more in one
task than any other; a group's estimate is one row, broadcast where groups are few and else joined by salted keys.

A 3-word window is compared by a 64-bit hash inside its own document only.

Cases: a null or empty text has no words, fails the base rules, and is not kept. Null language and null source are
values of their own. With no usable row, nothing but the base rules decides. Repeated rows and tied ids are judged
row by row; other columns aren't read. An empty table gives an empty result. A text of any length is one row's work,
in arrays of its words and hashes.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmap.llm.common import WORD_SPACE, Scratch

D = 5
#: (n + D + 1) / 2 of n rows, where n is the fewest that are estimated alone.
H = 0.515
#: Added to the standard deviation of each transformed statistic, in quadrature.
FLOOR = (0.35, 0.04, 0.10, 0.25, 0.10)
#: The 0.999 quantile of chi-squared with 5 degrees of freedom, the mean of the smallest share H of its draws over 5,
#: its 0.975 quantile, and the mean of the draws below that over 5.
CUT = 20.515
CONSISTENCY = 0.53339
NEAR = 12.8325
NEAR_CONSISTENCY = 0.94739
#: Groups whose estimates are broadcast; beyond, they are joined by key, each in SALTS parts.
MOST_BROADCAST = 10_000
SALTS = 32
#: Fall of half the logarithm of a determinant that is none: a hundredth, or 0.2 % of each of five deviations.
STILL = 0.01
X = [f"x{i}" for i in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column) -> Column:
    """Words in 3-word windows whose hash is in the array twice or more."""
    placed = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda v, k: ((k > 0) & (F.get(s, k - 1)["x"] == v["x"])) | F.coalesce(F.get(s, k + 1)["x"] == v["x"], F.lit(False)))
        return let(F.array_sort(F.transform(twice, lambda v: v["i"])), gaps)

    def gaps(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda v, k: F.coalesce(F.least(F.get(p, k + 1) - v, F.lit(3)), F.lit(3))), F.lit(0), lambda a, b: a + b)

    return F.when(F.size(windows) == F.size(F.array_distinct(windows)), 0).otherwise(let(placed, repeated))


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base columns of every row."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, WORD_SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, WORD_SPACE, "")) > 0)
    windows = F.when(F.size("words") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.size("words") - 2), lambda i: F.xxhash64(F.get("words", i - 1), F.get("words", i), F.get("words", i + 1))))
    rows = docs.select("doc_id", "lang", "source", text.alias("text")).withColumn("words", words)
    rows = rows.withColumn("windows", windows)
    return rows.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _covered(F.col("windows")).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _vectors(base: DataFrame) -> DataFrame:
    n = F.greatest("n_words", F.lit(1)).cast("double")
    made = (F.log(n), F.log(F.greatest("word_chars", F.lit(1)) / n), F.log1p(4 * F.col("n_symbols") / n), F.log1p(F.col("n_dup_lines").cast("double")), F.asin(F.sqrt(F.col("n_repeat_words") / n)))
    return base.withColumns(dict(zip(X, made, strict=True)))


def _moments(weight: Column, tag: str, centre: str) -> list[Column]:
    """Sums over the rows in a subset, of deviations from a fixed centre."""
    dev = [F.col(x) - F.col(f"{centre}{i}") for i, x in enumerate(X)]
    out = [F.sum(F.when(weight, 1)).alias(f"{tag}n")]
    out += [F.sum(F.when(weight, dev[i])).alias(f"{tag}s{i}") for i in range(D)]
    return out + [F.sum(F.when(weight, dev[i] * dev[j])).alias(f"{tag}q{i}{j}") for i, j in PAIRS]


def _invert(groups: DataFrame, tag: str, consistency: float = CONSISTENCY) -> DataFrame:
    """Adds the precision matrix and log determinant to moments: tag + m0.., p00.., det."""
    n = F.greatest(F.coalesce(f"{tag}n", F.lit(0)), F.lit(1)).cast("double")
    mean = {i: F.coalesce(F.col(f"{tag}s{i}"), F.lit(0.0)) / n for i in range(D)}
    out = groups.withColumns({f"{tag}m{i}": F.col(f"c{i}") + mean[i] for i in range(D)})
    cov = {f"{tag}v{i}{j}": (F.coalesce(F.col(f"{tag}q{i}{j}"), F.lit(0.0)) / n - mean[i] * mean[j]) / consistency + (FLOOR[i] ** 2 if i == j else 0.0) for i, j in PAIRS}
    out = out.withColumns(cov)
    for i in range(D):  # Cholesky factor, row by row
        for j in range(i + 1):
            rest = reduce(add, [F.col(f"{tag}l{i}{k}") * F.col(f"{tag}l{j}{k}") for k in range(j)], F.lit(0.0))
            left = F.col(f"{tag}v{i}{j}") - rest
            out = out.withColumn(f"{tag}l{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-9))) if i == j else left / F.col(f"{tag}l{j}{j}"))
    for i in range(D):  # its inverse
        for j in range(i + 1):
            rest = reduce(add, [F.col(f"{tag}l{i}{k}") * F.col(f"{tag}w{k}{j}") for k in range(j, i)], F.lit(0.0))
            out = out.withColumn(f"{tag}w{i}{j}", (F.lit(1.0 if i == j else 0.0) - rest) / F.col(f"{tag}l{i}{i}"))
    precision = {f"{tag}p{i}{j}": reduce(add, [F.col(f"{tag}w{k}{i}") * F.col(f"{tag}w{k}{j}") for k in range(i, D)]) for i, j in PAIRS}
    det = reduce(add, [F.log(f"{tag}l{i}{i}") for i in range(D)])
    return out.withColumns(precision | {f"{tag}det": det})


def _distance(tag: str) -> Column:
    dev = [F.col(x) - F.col(f"{tag}m{i}") for i, x in enumerate(X)]
    return reduce(add, [F.col(f"{tag}p{i}{j}") * dev[i] * dev[j] * (1 if i == j else 2) for i, j in PAIRS])


def _model(tag: str) -> list[str]:
    return [f"{tag}m{i}" for i in range(D)] + [f"{tag}p{i}{j}" for i, j in PAIRS]


def _meet(rows: DataFrame, table: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """rows with the columns of table, one row a group g of n: broadcast where these are few.

    Beyond that each group's row stands SALTS times and the group's rows are dealt over these, so that no task has all.
    """
    if n <= MOST_BROADCAST:
        return rows.join(F.broadcast(table), "g", how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # any salt finds the same row, so a task that is run again may draw others
    return rows.withColumn("_salt", (F.rand() * SALTS).cast("int")).join(salted, ["g", "_salt"], how).drop("_salt")


def estimates(usable: DataFrame, scratch: Scratch, n_groups: int, most_steps: int = 30) -> DataFrame:
    """Centre m0.. and precision p00.. of each group g, from rows with g and the vector.

    Steps go on while any group's determinant falls, by more than what quantiles that are sketches let it swing;
    most_steps only guards against one that swings more.
    """
    centres = [f"c{i}" for i in range(D)]
    meet = lambda table: _meet(usable, table, n_groups)
    save = lambda table, name: scratch.save(table.coalesce(1) if n_groups <= MOST_BROADCAST else table, name)
    middle = usable.groupBy("g").agg(*[F.percentile_approx(x, 0.5, 1_000).alias(c) for x, c in zip(X, centres, strict=True)])
    middle = save(middle, "middle")
    off = meet(middle).groupBy("g").agg(*[F.first(c).alias(c) for c in centres], *[F.percentile_approx(F.abs(F.col(x) - F.col(c)), 0.5, 1_000).alias(f"t{i}") for i, (x, c) in enumerate(zip(X, centres, strict=True))])
    scale = [F.greatest(1.4826 * F.col(f"t{i}"), F.lit(FLOOR[i])) for i in range(D)]
    start = [F.col(c).alias(f"am{i}") for i, c in enumerate(centres)] + [(1 / (scale[i] * scale[i]) if i == j else F.lit(0.0)).alias(f"ap{i}{j}") for i, j in PAIRS]
    now = save(off.select("g", *centres, *start, F.lit(float("inf")).alias("adet")), "step")
    for _ in range(most_steps):
        cuts = meet(now).withColumn("da", _distance("a")).groupBy("g").agg(F.percentile_approx("da", H, 10_000).alias("ka"))
        aimed = save(now.join(cuts, "g"), "cuts")
        sums = _sums(meet(aimed).withColumn("da", _distance("a")), F.col("da") <= F.col("ka"), [*centres, "adet"])
        made = _invert(sums.withColumnRenamed("adet", "before"), "a")
        falls = F.col("adet") < F.col("before") - STILL
        following = save(made.select("g", *centres, *_model("a"), "adet", falls.alias("falls")), "step")
        fell = following.agg(F.bool_or("falls")).first()[0]
        now = following.drop("falls")
        if not fell:
            break
    far = meet(now).withColumn("da", _distance("a"))
    out = _invert(_sums(far, F.col("da") <= NEAR, centres), "a", NEAR_CONSISTENCY)
    return save(out.select("g", *[F.col("a" + c).alias(c) for c in (x[1:] for x in _model("a"))]), "model")


def _sums(rows: DataFrame, weight: Column, centres: list[str]) -> DataFrame:
    return rows.groupBy("g").agg(*[F.first(c).alias(c) for c in centres], *_moments(weight, "a", "c"))


def judge(docs: DataFrame, least: int = 200, cut: float = CUT) -> DataFrame:
    """Base statistics of every row, distance (squared; null where the base rules fail) and kept."""
    scratch = Scratch(docs.sparkSession, "mcd")
    base = scratch.save(_vectors(base_statistics(docs)), "statistics", "zstd")
    sized = base.filter(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"))
    names = F.to_json(F.struct("lang", "source"))
    large = scratch.save(sized.filter(F.col("n") >= least).select(names.alias("g")).coalesce(1), "groups")
    n_groups = large.count() + 1
    rows = _meet(base.withColumn("g", names), large.withColumn("own", F.lit(True)), n_groups, "left").withColumn("g", F.when(F.col("own"), F.col("g")).otherwise("")).drop("own")
    model = estimates(rows.filter(~F.col("base_failed")).select("g", *X), scratch, n_groups)
    judged = _meet(rows, model, n_groups, "left").withColumn("distance", F.when(~F.col("base_failed"), _distance("")))
    return judged.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)).alias("kept"), "distance",
    )
