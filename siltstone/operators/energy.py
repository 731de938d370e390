"""Energy and cost arithmetic over measured or estimated samples. What is unknown stays null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GPU_SHARE_OF_TDP = 0.70
#: From the weakest on: a total is no better than its weakest part.
TIERS = ("unavailable", "estimated", "measured")


def cpu_joules(tdp_watts: Column, utilisation: Column, seconds: Column) -> Column:
    return tdp_watts * F.coalesce(utilisation, F.lit(1.0)) * seconds


def gpu_proxy_joules(tdp_watts: Column, seconds: Column) -> Column:
    return tdp_watts * GPU_SHARE_OF_TDP * seconds


def facility(joules: Column, pue: Column) -> Column:
    """With what the building uses on top."""
    return joules * F.coalesce(pue, F.lit(1.0))


def utilisation(idle_before: Column, total_before: Column, idle_after: Column, total_after: Column) -> Column:
    """Of two readings of a processor's counters, between 0 and 1; null if no time passed."""
    total = total_after - total_before
    return F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (idle_after - idle_before) / total)))


def net_joules(gross: Column, idle_watts: Column, seconds: Column) -> Column:
    return gross - idle_watts * seconds


def tier(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), name) - 1


def accounted(trials: DataFrame, by: str) -> DataFrame:
    """Per group: joules (measured, else estimated) and the weakest tier among its rows.

    ``trials`` has measured_joules and estimated_joules; a row with neither
    makes the total null.
    """
    name = F.when(F.col("measured_joules").isNotNull(), "measured").when(F.col("estimated_joules").isNotNull(), "estimated").otherwise("unavailable")
    rows = trials.withColumn("_joules", F.coalesce("measured_joules", "estimated_joules")).withColumn("_tier", tier(name))
    summed = rows.groupBy(by).agg(F.min("_tier").alias("_weakest"), F.sum("_joules").alias("_sum"))
    return summed.select(by, F.when(F.col("_weakest") > 0, F.col("_sum")).alias("joules"), F.get(F.array(*map(F.lit, TIERS)), F.col("_weakest").cast("int")).alias("tier"))


def rework_joules(passed: Column, joules: Column) -> Column:
    """A failed trial's energy is without bound."""
    return F.when(passed, joules).otherwise(F.lit(float("inf")))


def per_query(measured: DataFrame, idle_watts: Column) -> DataFrame:
    """``measured`` (component, gross_joules, seconds, queries) with net joules and net joules per query."""
    net = net_joules(F.col("gross_joules"), idle_watts, F.col("seconds"))
    return measured.withColumn("net_joules", net).withColumn("net_per_query", net / F.nullif("queries", F.lit(0)))


def increment(measured: DataFrame, with_part: str, without_part: str) -> DataFrame:
    """What a part adds: one component's net joules per query less another's."""
    value = lambda name: F.max(F.when(F.col("component") == name, F.col("net_per_query")))
    return measured.agg((value(with_part) - value(without_part)).alias("increment"))
