"""Measured runs as streams: the thermal rule with its retries, and a ledger in which each unit is done once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from siltstone.sources.storage import written

# Above which temperature an attempt doesn't count, down to which a machine cools, how often a unit is tried again.
MAX_TEMP, RESUME_TEMP, MAX_RETRIES = 90.0, 65.0, 2

ATTEMPTS = "machine string, ts timestamp, seq long, unit_id string, status string, temp double"
JUDGED = "machine string, seq long, unit_id string, status string, attempt int, counted boolean, cooling boolean"

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine:
    """What the rule remembers of a machine: whether it is cooling, and how often each unit was tried since it last counted."""

    def __init__(self, max_temp: float, resume_temp: float, retries: int, cooling: bool, tried: dict[str, int]) -> None:
        self.max_temp, self.resume_temp, self.retries, self.cooling, self.tried = max_temp, resume_temp, retries, cooling, tried

    def see(self, unit_id: str | None, status: str | None, temp: float | None) -> tuple[str | None, int, bool, bool] | None:
        """(status, attempt, counted, cooling when it ended) of an attempt; None for a reading, which has no unit."""
        cooling, hot = self.cooling, temp is not None and temp > self.max_temp
        if hot:
            self.cooling = True
        elif temp is None or temp <= self.resume_temp:
            self.cooling = False
        if unit_id is None:
            return None
        attempt = self.tried.get(unit_id, 0)
        if not hot:
            self.tried.pop(unit_id, None)
            return status, attempt, True, cooling
        if attempt < self.retries:
            self.tried[unit_id] = attempt + 1
            return status, attempt, False, cooling
        self.tried.pop(unit_id, None)
        return "thermal_fail", attempt, False, cooling


class ThermalRule(StatefulProcessor):
    """Holds a machine's rows until the watermark has passed them, then judges them in the order of their time."""

    def __init__(self, max_temp: float, resume_temp: float, retries: int) -> None:
        self.rule = max_temp, resume_temp, retries

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, seq long, unit_id string, status string, temp double")
        self.cooling = handle.getValueState("cooling", "cooling boolean")
        self.tried = handle.getMapState("tried", "unit_id string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(ts.value // 1000, int(seq), unit_id, status, None if pd.isna(temp) else float(temp)) for b in rows for ts, seq, unit_id, status, temp in zip(b.ts, b.seq, b.unit_id, b.status, b.temp, strict=True)]
        if new:
            self.waiting.appendList(new)
            self._wake(new)
        return iter(())

    def _wake(self, rows: list[tuple]) -> None:
        """A timer for when all of the first row's millisecond has passed; later rows get theirs when it goes off."""
        self.handle.registerTimer(min(r[0] for r in rows) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1]))
        due, rest = [r for r in rows if r[0] < upto], [r for r in rows if r[0] >= upto]
        if not due:
            return
        if rest:
            self.waiting.put(rest)
            self._wake(rest)
        else:
            self.waiting.clear()
        tried = {k[0]: v[0] for k, v in self.tried.iterator()}
        machine = Machine(*self.rule, self.cooling.exists() and self.cooling.get()[0], dict(tried))
        judged = []
        for _, seq, unit_id, status, temp in due:
            if found := machine.see(unit_id, status, temp):
                judged.append((key[0], seq, unit_id, *found))
        self.cooling.update((machine.cooling,))
        for unit_id, n in machine.tried.items():
            if tried.get(unit_id) != n:
                self.tried.updateValue((unit_id,), (n,))
        for unit_id in tried.keys() - machine.tried.keys():
            self.tried.removeKey((unit_id,))
        yield pd.DataFrame(judged, columns=[c.split()[0] for c in JUDGED.split(", ")])

    def close(self) -> None:
        pass


def thermal_rule(stream: DataFrame, late: str = "1 hour", max_temp: float = MAX_TEMP, resume_temp: float = RESUME_TEMP, retries: int = MAX_RETRIES) -> DataFrame:
    """Attempts judged by the temperature at their end: machine, seq, unit_id, status, attempt, counted, cooling.

    ``stream`` has machine, ts, seq, unit_id, status and temp; a row without a unit is a
    reading only. A machine is cooling from a temperature over ``max_temp`` until
    one of at most ``resume_temp``; ``cooling`` says so of when an attempt
    ended. An attempt that ends too hot doesn't count; the unit is tried again
    ``retries`` times and is then a thermal_fail. A null temperature is never too
    hot and ends a cooling. Rows may come in any order within ``late``; they are held in state until
    the watermark has passed them, and judged in the order of ts and seq. The state is those rows, a flag
    for each machine, and a count for each unit that is being tried again.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    keyed = stream.select("machine", "ts", "seq", "unit_id", "status", F.col("temp").cast("double").alias("temp")).withWatermark("ts", late).groupBy("machine")
    return keyed.transformWithStateInPandas(statefulProcessor=ThermalRule(max_temp, resume_temp, retries), outputStructType=JUDGED, outputMode="append", timeMode="eventTime")


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


class Ledger:
    """A folder of JSON lines in which each unit of a plan is done once, whatever is cut short.

    Rows are written a batch at a time, each in its own folder, which is replaced if the
    batch is done again. A batch counts once it is complete; what a lost driver left of
    one is not read. ``schema`` has unit_id and status.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    @staticmethod
    def plan_hash(plan: DataFrame) -> str:
        """A digest of a plan's rows, columns by name, the same however they are partitioned."""
        row = F.to_json(F.struct(*sorted(plan.columns)), {"ignoreNullFields": "false"})
        found = plan.select(F.xxhash64(row).alias("a"), F.xxhash64(F.lit(1), row).alias("b")).agg(F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(20,0)")).alias("a"), F.sum(F.col("b").cast("decimal(20,0)")).alias("b"))
        return found.select(F.left(F.sha2(F.concat_ws("|", "n", "a", "b"), 256), F.lit(16)).alias("h")).first().h

    def open(self, plan: DataFrame) -> str:
        """Binds the folder to ``plan``, or raises if it is bound to another one already."""
        mine, place = self.plan_hash(plan), f"{self.path}/run"
        if _exists(self.spark, f"{place}/_SUCCESS"):
            bound = self.spark.read.schema("plan_hash string").json(place).first().plan_hash
            if bound != mine:
                raise RuntimeError(f"{self.path} is of another plan: {bound} != {mine}")
        else:
            self.spark.createDataFrame([(mine,)], "plan_hash string").coalesce(1).write.mode("overwrite").json(place)
        return mine

    def rows(self) -> DataFrame:
        """All rows of complete batches with the number of their batch; a line that is torn is skipped."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/results")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        whole = [f"{self.path}/results/{n}" for n in names if n.startswith("batch=") and _exists(self.spark, f"{self.path}/results/{n}/_SUCCESS")]
        if not whole:
            return self.spark.createDataFrame([], f"{self.schema}, batch long")
        return self.spark.read.schema(f"{self.schema}, batch long").option("basePath", f"{self.path}/results").option("mode", "DROPMALFORMED").json(whole)

    def latest(self) -> DataFrame:
        """Each unit's row of its last batch."""
        rows = self.rows()
        rest = [c for c in rows.columns if c not in ("unit_id", "batch")]
        return rows.groupBy("unit_id").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("unit_id", "r.*")

    def pending(self, plan: DataFrame, retry_errors: bool = False) -> DataFrame:
        """Units of the plan without a row, and with ``retry_errors`` those whose latest is not ok."""
        done = self.latest()
        return plan.join((done.where("status = 'ok'") if retry_errors else done).select("unit_id"), "unit_id", "left_anti")

    def append(self, rows: DataFrame, batch: int) -> None:
        """Writes a batch; of several rows of one unit any one. The batch of a number that is complete is replaced."""
        rows.dropDuplicates(["unit_id"]).write.mode("overwrite").json(f"{self.path}/results/batch={batch}")

    def next_batch(self) -> int:
        """A number after those of all complete batches."""
        last = self.rows().agg(F.max("batch")).first()[0]
        return 0 if last is None else last + 1

    def run(self, units: DataFrame, execute: Callable[[DataFrame], DataFrame]) -> None:
        """Executes the units of a stream that the ledger doesn't have yet, batch after batch, and writes what came of them.

        After a failure the same call takes up where it stopped: offsets are in
        the ledger's folder, and a batch that was cut short is done again and replaces what was left of it.
        """

        def once(batch: DataFrame, number: int) -> None:
            before = self.rows().where(F.col("batch") != number).select("unit_id")
            todo = batch.dropDuplicates(["unit_id"]).join(before, "unit_id", "left_anti")
            self.append(execute(todo), number)

        units.writeStream.option("checkpointLocation", f"{self.path}/offsets").trigger(availableNow=True).foreachBatch(once).start().awaitTermination()

    def retry(self, plan: DataFrame, execute: Callable[[DataFrame], DataFrame]) -> None:
        """Executes once more what is pending or did not end well."""
        todo = written(self.pending(plan, retry_errors=True), "retry")
        self.append(execute(todo), self.next_batch())

    def status(self, plan: DataFrame) -> DataFrame:
        """(status, n): where the plan's units stand; those without a row are pending."""
        return plan.select("unit_id").join(self.latest(), "unit_id", "left").groupBy(F.coalesce("status", F.lit("pending")).alias("status")).agg(F.count("*").alias("n"))


def repaired_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of a log of JSON lines, and the lines that are none, as a torn last line, to be run again."""
    lines = spark.read.text(path).where("trim(value) != ''").withColumn("row", F.from_json("value", f"{schema}, _torn string", {"columnNameOfCorruptRecord": "_torn"}))
    whole = F.col("row").isNotNull() & F.col("row._torn").isNull()
    names = [c.strip().split()[0] for c in schema.split(",")]
    return lines.where(whole).select(*(F.col(f"row.{n}").alias(n) for n in names)), lines.where(~whole).select("value")
