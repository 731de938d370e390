"""Statistics of paired systems, agreement of raters, samples and splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def task_means(trials: DataFrame, value: str) -> DataFrame:
    """The mean per system and task; tasks without a value are absent."""
    return trials.where(F.col(value).isNotNull()).groupBy("system_id", "task_id").agg(F.avg(value).alias("value"))


def paired(means: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair of systems and task that both have: a, b, task_id, diff."""
    side = lambda x: means.select(F.col("system_id").alias(x), "task_id", F.col("value").alias(f"value_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), ["b", "task_id"]).withColumn("diff", F.col("value_b") - F.col("value_a"))


def compare(means: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair: n, mean and median difference, d_z, the signed-rank sums and rank-biserial r, and the normal p value of the sums.

    Zero differences are left out of the ranks; ties share their mean rank.
    """
    rows = paired(means, pairs)
    ranked = rows.where("diff != 0").withColumn("size", F.round(F.abs("diff"), 12))
    ranked = ranked.withColumn("rank", F.expr("rank() over (partition by a, b order by size) + (count(*) over (partition by a, b, size) - 1) / 2.0"))
    ties = ranked.groupBy("a", "b", "size").agg(F.count("*").alias("t")).groupBy("a", "b").agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    sums = ranked.groupBy("a", "b").agg(F.count("*").alias("m"), F.sum(F.when(F.col("diff") > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("diff") < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"))
    base = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("diff").alias("mean_diff"), F.median("diff").alias("median_diff"), F.stddev_samp("diff").alias("_sd"))
    out = base.join(sums, ["a", "b"], "left").join(ties, ["a", "b"], "left")
    m = F.col("m")
    sigma = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.coalesce("ties", F.lit(0)) / 48)
    z = (F.least("w_plus", "w_minus") - m * (m + 1) / 4) / F.nullif(sigma, F.lit(0.0))
    return out.select(
        "a", "b", "n", "mean_diff", "median_diff", (F.col("mean_diff") / F.nullif("_sd", F.lit(0.0))).alias("d_z"), "w_plus", "w_minus",
        ((F.col("w_plus") - F.col("w_minus")) / (F.col("w_plus") + F.col("w_minus"))).alias("rank_biserial"), F.coalesce(2 * normal_tail(F.abs(z)), F.lit(1.0)).alias("p_value"),
    )


def normal_tail(z: Column) -> Column:
    """The upper tail of the normal distribution, by the rational approximation of Abramowitz and Stegun 26.2.17 (error under 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series


def holm(tests: DataFrame, family: str, p: str = "p_value") -> DataFrame:
    """``tests`` with the Holm-adjusted p; a null p stays null and doesn't count."""
    known = tests.where(F.col(p).isNotNull())
    m = f"count(*) over (partition by {family})"
    ranked = known.withColumn("_raw", F.expr(f"least(1.0D, ({m} - row_number() over (partition by {family} order by {p}, name) + 1) * {p})"))
    adjusted = ranked.withColumn("p_adjusted", F.expr(f"max(_raw) over (partition by {family} order by {p}, name rows unbounded preceding)")).drop("_raw")
    return adjusted.unionByName(tests.where(F.col(p).isNull()).withColumn("p_adjusted", F.lit(None).cast("double")))


def discordant(flags: DataFrame, pairs: DataFrame) -> DataFrame:
    """McNemar counts per pair: n, tasks that only a or only b passes, and the exact two-sided p."""
    side = lambda x: flags.select(F.col("system_id").alias(x), "task_id", F.col("passed").alias(f"p_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), ["b", "task_id"])
    n = both.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.expr("p_a and not p_b")).alias("only_a"), F.count_if(F.expr("p_b and not p_a")).alias("only_b"))
    return n.withColumn("p_value", binomial_two_sided(F.least("only_a", "only_b"), F.col("only_a") + F.col("only_b")))


def binomial_two_sided(k: Column, n: Column) -> Column:
    """min(1, 2 P(X <= k)) for X ~ Bin(n, 1/2), summed in logarithms from the first term on."""
    named = lambda log, total: F.struct(log.alias("log"), total.alias("total"))
    zero = -n * F.lit(math.log(2.0))
    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<long>"))
    grow = lambda s, i: s["log"] + F.log((n - i + 1) / i)
    tail = F.aggregate(terms, named(zero, F.exp(zero)), lambda s, i: named(grow(s, i), s["total"] + F.exp(grow(s, i))), lambda s: s["total"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def cohen_kappa(ratings: DataFrame, one: str, other: str) -> DataFrame:
    """n, observed and expected agreement and kappa (null if agreement by chance is certain)."""
    pairs = ratings.where(F.col(one).isNotNull() & F.col(other).isNotNull()).select(F.col(one).alias("x"), F.col(other).alias("y"))
    cells = pairs.groupBy("x", "y").agg(F.count("*").alias("c"))
    n = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("same"))
    rows, columns = cells.groupBy(F.col("x").alias("v")).agg(F.sum("c").alias("r")), cells.groupBy(F.col("y").alias("v")).agg(F.sum("c").alias("k"))
    chance = rows.join(columns, "v").agg(F.sum(F.col("r") * F.col("k")).alias("rk"))
    both = n.join(F.broadcast(chance)).select("n", (F.col("same") / F.col("n")).alias("observed"), (F.col("rk") / (F.col("n") * F.col("n"))).alias("expected"))
    return both.withColumn("kappa", (F.col("observed") - F.col("expected")) / F.nullif(1 - F.col("expected"), F.lit(0.0)))


def quadratic_kappa(ratings: DataFrame, one: str, other: str) -> DataFrame:
    """Weighted kappa with squared distances, from sums: no table of cells is needed."""
    x, y = F.col(one).cast("double"), F.col(other).cast("double")
    r = ratings.where(x.isNotNull() & y.isNotNull())
    s = r.agg(F.count("*").alias("n"), F.avg((x - y) * (x - y)).alias("seen"), (F.var_pop(x) + F.var_pop(y) + F.pow(F.avg(x) - F.avg(y), 2)).alias("chance"))
    return s.select("n", (1 - F.col("seen") / F.nullif("chance", F.lit(0.0))).alias("weighted_kappa"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation; ranks come from the counts of each value, so only distinct values are put in order."""

    def ranks(c: str, name: str) -> DataFrame:
        n = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
        return n.select(c, F.expr(f"sum(n) over (order by {c}) - n + (n + 1) / 2.0").alias(name))

    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y).join(ranks(x, "_rx"), x).join(ranks(y, "_ry"), y)
    return both.agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho"))


def hash_order(key: Column, seed: str) -> Column:
    """A reproducible random order: the digest of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")))


def stratified_split(rows: DataFrame, key: str, strata: tuple[str, ...], seed: str = "42", dev: float = 0.4, val: float = 0.2) -> DataFrame:
    """``rows`` with split: in each stratum, in hash order, the first go to dev, the next to val, the rest to test."""
    by = ", ".join(strata)
    ordered = rows.withColumn("_o", hash_order(F.col(key), seed))
    n, of = F.expr(f"row_number() over (partition by {by} order by _o, {key})"), F.expr(f"count(*) over (partition by {by})")
    ordered = ordered.withColumn("_n", n).withColumn("_of", of)
    split = F.when(F.col("_n") <= F.floor(F.col("_of") * dev + 0.5), "dev").when(F.col("_n") <= F.floor(F.col("_of") * dev + 0.5) + F.floor(F.col("_of") * val + 0.5), "val").otherwise("test")
    return ordered.withColumn("split", split).drop("_o", "_n", "_of")


def bootstrap_mean(df: DataFrame, value: str, *by: str, draws: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """A percentile interval of the mean per group by Poisson resampling: each row counts a hashed Poisson(1) number of times in each draw."""
    u = F.pmod(F.xxhash64(F.lit(seed), "_draw", "_row"), F.lit(1 << 30)) / float(1 << 30)
    times, total = F.lit(0), 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        times = times + (u >= total).cast("int")
    rows = df.where(F.col(value).isNotNull()).select(*by, value, F.xxhash64(*df.columns).alias("_row"))
    drawn = rows.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_times", times)
    means = drawn.groupBy(*by, "_draw").agg((F.sum(F.col("_times") * F.col(value)) / F.nullif(F.sum("_times"), F.lit(0))).alias("m"))
    tail = (1 - level) / 2
    return means.groupBy(*by).agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))


def min_detectable_effect(n: Column, sd: Column, wilcoxon_efficiency: float = 0.955) -> Column:
    """At a power of 0.8 and a level of 0.05."""
    return 2.801585 * sd / F.sqrt(n * wilcoxon_efficiency)


def fleiss_kappa(ratings: DataFrame, item: str, rater: str, category: str) -> DataFrame:
    """n_items, observed and expected agreement and kappa of several raters; items with a single rating take no part.

    Kappa is null if agreement by chance is certain.
    """
    latest = ratings.where(F.col(category).isNotNull()).groupBy(item, rater).agg(F.max(category).alias("_c"))
    cells = latest.groupBy(item, "_c").agg(F.count("*").alias("k"))
    items = cells.groupBy(item).agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("kk")).where("m > 1")
    agreed = (F.col("kk") - F.col("m")) / (F.col("m") * (F.col("m") - 1))
    seen = items.agg(F.count("*").alias("n_items"), F.avg(agreed).alias("observed"), F.sum("m").alias("all"))
    shares = cells.join(items.select(item), item, "left_semi").groupBy("_c").agg(F.sum("k").alias("k"))
    chance = shares.agg(F.sum(F.col("k") * F.col("k")).alias("squares"))  # one row of at most as many categories squared
    both = seen.crossJoin(F.broadcast(chance)).select("n_items", "observed", (F.col("squares") / (F.col("all") * F.col("all"))).alias("expected"))
    return both.withColumn("kappa", (F.col("observed") - F.col("expected")) / F.nullif(1 - F.col("expected"), F.lit(0.0)))


def kendall_tau(df: DataFrame, x: str, y: str) -> DataFrame:
    """Tau-b from the table of counts of value pairs: n, concordant, discordant, tau.

    Both columns are ratings of few values; what is joined with itself is the
    table of distinct pairs, not the rows.
    """
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("c"))
    a, b = cells.alias("a"), cells.alias("b")
    ahead = a.join(b, F.col("a.x") < F.col("b.x"), "inner")
    pairs = ahead.agg(
        F.coalesce(F.sum(F.when(F.col("a.y") < F.col("b.y"), F.col("a.c") * F.col("b.c"))), F.lit(0)).alias("concordant"),
        F.coalesce(F.sum(F.when(F.col("a.y") > F.col("b.y"), F.col("a.c") * F.col("b.c"))), F.lit(0)).alias("discordant"),
    )

    def tied(c: str) -> DataFrame:
        n = cells.groupBy(c).agg(F.sum("c").alias("n"))
        return n.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(f"tied_{c}"))

    n = cells.agg(F.sum("c").alias("n"))
    whole = n.crossJoin(F.broadcast(pairs)).crossJoin(F.broadcast(tied("x"))).crossJoin(F.broadcast(tied("y")))  # one row each
    every = F.col("n") * (F.col("n") - 1) / 2
    scale = F.sqrt((every - F.col("tied_x")) * (every - F.col("tied_y")))
    return whole.select("n", "concordant", "discordant", ((F.col("concordant") - F.col("discordant")) / F.nullif(scale, F.lit(0.0))).alias("tau"))


def ladder(systems: tuple[str, ...]) -> list[tuple[str, str]]:
    """Each system against the one before it."""
    return list(zip(systems[:-1], systems[1:], strict=True))


def compare_by_stratum(means: DataFrame, strata: DataFrame, pairs: DataFrame) -> DataFrame:
    """``compare`` within each stratum (task_id, stratum), Holm-adjusted over the pairs of a stratum."""
    keyed = means.join(strata, "task_id").withColumn("system_id", F.concat_ws("|", "stratum", "system_id"))
    wanted = strata.select("stratum").distinct().join(F.broadcast(pairs))  # few strata, few pairs
    named = wanted.select(F.concat_ws("|", "stratum", "a").alias("a"), F.concat_ws("|", "stratum", "b").alias("b"))
    found = compare(keyed.select("system_id", "task_id", "value"), named)
    side = lambda c: F.substring_index(c, "|", -1)
    return holm(found.select(F.substring_index("a", "|", 1).alias("stratum"), side("a").alias("a"), side("b").alias("b"), F.concat_ws("-", side("a"), side("b")).alias("name"), "n", "mean_diff", "p_value"), "stratum")
