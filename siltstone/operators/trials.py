"""Aggregates of measured trials: per task, per system, deltas, frontiers, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOULES_PER_KWH = 3.6e6


def _std(name: str) -> Column:
    """The sample deviation, 0 for a single value."""
    return F.when(F.count(name) > 1, F.stddev_samp(name)).when(F.count(name) == 1, 0.0)


def per_task(trials: DataFrame, values: tuple[str, ...], scored: str = "quality") -> DataFrame:
    """Mean, deviation and median of each value per system and task; null values take no part."""
    sums = [F.count("*").alias("n_trials"), F.count(scored).alias("n_scored")]
    for v in values:
        sums += [F.avg(v).alias(f"mean_{v}"), _std(v).alias(f"std_{v}"), F.median(v).alias(f"median_{v}")]
    return trials.groupBy("system_id", "task_id").agg(*sums)


def per_system(tasks: DataFrame, values: tuple[str, ...], scored: str = "quality") -> DataFrame:
    """The mean of task means (not the pooled mean), and how many tasks had no score."""
    sums = [F.count("*").alias("n_tasks"), F.count_if(F.col("n_scored") == 0).alias("n_unscored")]
    sums += [f(f"mean_{v}").alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("std", _std))]
    return tasks.groupBy("system_id").agg(*sums)


def rate(flag: Column, known: Column) -> Column:
    """The share of true among the known; null if none is."""
    return F.avg(F.when(known, flag.cast("double")))


def carbon(joules: Column, grams_per_kwh: Column) -> Column:
    return joules / JOULES_PER_KWH * grams_per_kwh


def token_cost(tokens: Column, dollars_per_million: Column) -> Column:
    return tokens / 1e6 * dollars_per_million


def per_success(trials: DataFrame, success: Column, cost: Column, *by: str, extra: Column | None = None) -> DataFrame:
    """All that was spent over the successes; null without one. Unknown outcomes are left out of the rate."""
    spent = F.sum(cost) + (F.lit(0.0) if extra is None else F.first(extra))
    n = F.count_if(success)
    return trials.groupBy(*by).agg(
        n.alias("n_success"), F.count_if(success.isNotNull()).alias("n_known"), (spent / F.nullif(n, F.lit(0))).alias("cost_per_success"), rate(success, success.isNotNull()).alias("success_rate")
    )


def deltas(summary: DataFrame, transitions: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Later minus earlier system for each transition (from_system, to_system)."""
    a = summary.select(F.col("system_id").alias("from_system"), *(F.col(v).alias(f"_a_{v}") for v in values))
    b = summary.select(F.col("system_id").alias("to_system"), *(F.col(v).alias(f"_b_{v}") for v in values))
    both = transitions.join(a, "from_system").join(b, "to_system")
    return both.select("from_system", "to_system", *((F.col(f"_b_{v}") - F.col(f"_a_{v}")).alias(f"delta_{v}") for v in values))


def pareto(points: DataFrame, quality: str, cost: str, buckets: int = 64) -> DataFrame:
    """Points that no other is as good as at no more cost, and better in one of the two.

    With one cost, a point is on the frontier if its quality is the best at its
    cost and above all that is cheaper. Points are first reduced to the best
    quality of each cost; what is cheaper is known from a running maximum
    within ranges of cost and one over the ranges.
    """
    best = points.groupBy(cost).agg(F.max(quality).alias("_best"))
    low, high = best.agg(F.min(cost), F.max(cost)).first()
    width = ((high or 0) - (low or 0)) / buckets or 1.0
    best = best.withColumn("_range", F.least(F.floor((F.col(cost) - (low or 0)) / width), F.lit(buckets - 1)))
    tops = best.groupBy("_range").agg(F.max("_best").alias("_top"))
    before = tops.withColumn("_before", F.expr("max(_top) over (order by _range rows between unbounded preceding and 1 preceding)")).drop("_top")
    within = F.expr(f"max(_best) over (partition by _range order by {cost} rows between unbounded preceding and 1 preceding)")
    kept = best.withColumn("_within", within).join(before, "_range").where("_best > coalesce(greatest(_within, _before), _best - 1)")
    return points.join(kept.select(cost, F.col("_best").alias(quality)), [cost, quality], "left_semi")


def price(models: DataFrame, prices: DataFrame, default_input: float = 1.0, default_output: float = 4.0) -> DataFrame:
    """Each model's price: its own, else that of the first listed name it begins with, else the default.

    ``prices`` (name, position, input_price, output_price) is a dimension of
    a few rows; prefixes of a model are joined by equality.
    """
    prefixes = models.select("model_id").distinct().withColumn("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("model_id")), lambda n: F.substring(F.col("model_id"), F.lit(1), n))))
    order = F.struct((F.col("name") != F.col("model_id")).alias("longer"), "position")
    found = prefixes.join(prices, "name").groupBy("model_id").agg(F.min_by(F.struct("input_price", "output_price"), order).alias("p"))
    return models.join(found, "model_id", "left").select(
        *models.columns, F.coalesce("p.input_price", F.lit(default_input)).alias("input_price"), F.coalesce("p.output_price", F.lit(default_output)).alias("output_price")
    )


def trapezoid(samples: DataFrame, by: str, time: str, value: str) -> DataFrame:
    """The integral of ``value`` over ``time`` (seconds) per ``by``, with peak, mean and count."""
    over = f"over (partition by {by} order by {time})"
    area = samples.withColumn("_area", F.expr(f"({time} - lag({time}) {over}) * ({value} + lag({value}) {over}) / 2"))
    return area.groupBy(by).agg(F.count("*").alias("n_samples"), F.sum("_area").alias("integral"), F.max(value).alias("peak"), F.avg(value).alias("mean"))


def latest(log: DataFrame, key: str, order: Column) -> DataFrame:
    """Of each key the row that was appended last."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), order).alias("_row")).select(key, "_row.*")


def pending(plan: DataFrame, ledger: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Units of the plan that the ledger hasn't seen (or hasn't seen succeed)."""
    done = ledger.where("status = 'ok'") if retry_errors else ledger
    return plan.join(done.select("unit_id"), "unit_id", "left_anti")


def status_counts(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """How many units of the plan stand where by their latest row of the ledger (unit_id, status, seq); unseen ones are pending."""
    last = ledger.groupBy("unit_id").agg(F.max_by("status", "seq").alias("status"))
    return plan.select("unit_id").join(last, "unit_id", "left").groupBy(F.coalesce("status", F.lit("pending")).alias("status")).agg(F.count("*").alias("n"))


def cheapest_per_tier(profiles: DataFrame) -> DataFrame:
    """Of each tier the profile of the lowest cost, an unknown cost last: tier, model_id, cost."""
    order = F.struct(F.col("cost").isNull().alias("unknown"), "cost", "model_id")
    return profiles.groupBy("tier").agg(F.min_by(F.struct("model_id", "cost"), order).alias("p")).select("tier", "p.model_id", "p.cost")


def first_seen(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The distinct values of each group in the order in which they first occur: by, value, position."""
    first = rows.groupBy(by, value).agg(F.min(order).alias("_first"))
    return first.withColumn("position", F.expr(f"row_number() over (partition by {by} order by _first, {value})")).drop("_first")


def study_summary(runs: DataFrame, by: str) -> DataFrame:
    """``runs`` (error, peak, total) per group: how many succeeded and failed, the distinct errors in order, extremes of the peak, and whether any came within 128 of the total."""
    return runs.groupBy(by).agg(
        F.count_if(F.col("error").isNull()).alias("n_ok"), F.count("error").alias("n_error"), F.array_join(F.sort_array(F.collect_set("error")), "|").alias("errors"),
        F.min("peak").alias("low"), F.max("peak").alias("high"), F.bool_or(F.col("peak") >= F.col("total") - 128).alias("saturated"),
    )
