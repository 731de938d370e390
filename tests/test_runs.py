"""The thermal rule against a plain program, in any order and after a restart; the ledger after failures."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from siltstone.sources.storage import shared_path
from siltstone.streaming import runs

START = datetime.datetime(2024, 1, 1)


def attempts(seed, n=240):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        machine = rng.choice(["a", "b", "c"])
        unit = rng.choice([None, "u1", "u2", "u3"])
        rows.append((machine, START + datetime.timedelta(seconds=30 * k + rng.choice([0, 0.25])), k, unit, None if unit is None else rng.choice(["ok", "error"]), rng.choice([None, 40.0, 65.0, 66.0, 90.0, 91.0, 95.0, 99.0])))
    return rows


def brute(rows):
    out, state = [], {}
    for machine, ts, seq, unit, status, temp in sorted(rows, key=lambda r: (r[1], r[2])):
        cooling, tried = state.setdefault(machine, [False, {}])
        hot = temp is not None and temp > 90
        state[machine][0] = True if hot else False if temp is None or temp <= 65 else cooling
        if unit is None:
            continue
        n = tried.pop(unit, 0)
        if hot and n < 2:
            tried[unit] = n + 1
        out.append((machine, seq, unit, "thermal_fail" if hot and n == 2 else status, n, not hot, cooling))
    return sorted(out)


def feed(spark, folder, rows, files, start=0):
    for k, part in enumerate(files):
        time.sleep(0.02)
        spark.createDataFrame([rows[i] for i in part], runs.ATTEMPTS).coalesce(1).write.mode("append").parquet(f"{folder}/{start + k}")


def judge(spark, folder, out, state, fail_at=None):
    stream = spark.readStream.schema(runs.ATTEMPTS).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(folder)

    def keep(batch, number):
        if number == fail_at:
            raise RuntimeError("stopped here")
        batch.write.mode("overwrite").parquet(f"{out}/_batch={number}")

    runs.thermal_rule(stream, "3 hours").writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


@pytest.mark.parametrize("fail_at", [None, 2])
def test_files_in_any_order(spark, fail_at):
    rows, rng = attempts(7), random.Random(3)
    order = list(range(len(rows)))
    rng.shuffle(order)
    folder, out, state = (shared_path(spark, n) for n in ("attempts", "judged", "state"))
    feed(spark, folder, rows, [order[k::4] for k in range(4)])
    if fail_at is not None:
        with pytest.raises(Exception, match="stopped here"):
            judge(spark, folder, out, state, fail_at)
    else:
        judge(spark, folder, out, state)
    closing = ("end", START + datetime.timedelta(days=9), 10_000, None, None, None)
    feed(spark, folder, [closing], [[0]], start=90)
    judge(spark, folder, out, state)
    got = spark.read.schema(runs.JUDGED).parquet(out).drop("_batch").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_machine_by_hand():
    machine = runs.Machine(90, 65, 2, False, {})
    assert machine.see("u", "ok", 93) == ("ok", 0, False, False)
    assert machine.see(None, None, 80) is None and machine.cooling
    assert machine.see(None, None, 64) is None and not machine.cooling
    assert machine.see("u", "ok", 70) == ("ok", 1, True, False)
    assert [machine.see("v", "ok", 95)[:3] for _ in range(4)] == [("ok", 0, False), ("ok", 1, False), ("thermal_fail", 2, False), ("ok", 0, False)]


PLAN = "unit_id string, task string, place int"
ROW = "unit_id string, status string, error string"


def plan(spark, n=12):
    return spark.createDataFrame([(f"s|t{k % 3}|{k}", f"t{k % 3}", k) for k in range(n)], PLAN)


def execute(units):
    failed = F.col("task") == "t2"
    return units.select("unit_id", F.when(failed, "error").otherwise("ok").alias("status"), F.when(failed, "nothing found").alias("error"))


def ledger(spark):
    return runs.Ledger(spark, shared_path(spark, "ledger"), ROW)


def units_of(spark, df, files=4):
    folder = shared_path(spark, "plan")
    for k in range(files):
        df.where(f"place % {files} = {k}").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    return spark.readStream.schema(PLAN).option("maxFilesPerTrigger", "1").parquet(folder)


def stands(found, units):
    return {r.status: r.n for r in found.status(units).collect()}


def test_each_unit_once_though_killed_twice(spark):
    book, units = ledger(spark), plan(spark)
    book.open(units)
    stream, calls = units_of(spark, units), []

    def dies(before_write):
        def run(batch):
            calls.append(1)
            if len(calls) == 2:
                if before_write:
                    raise RuntimeError("killed")
                execute(batch).write.mode("overwrite").json(f"{book.path}/results/batch=1")
                files = book.spark._jvm.org.apache.hadoop.fs.Path(f"{book.path}/results/batch=1/_SUCCESS")
                files.getFileSystem(spark._jsc.hadoopConfiguration()).delete(files, False)
                raise RuntimeError("killed")
            return execute(batch)

        return run

    for before_write in (True, False):
        calls.clear()
        if not before_write:
            calls.append(1)
        with pytest.raises(Exception, match="killed"):
            book.run(stream, dies(before_write))
        assert book.rows().count() == 3
    assert stands(book, units) == {"ok": 2, "error": 1, "pending": 9}
    book.run(stream, execute)
    assert book.rows().count() == 12 == book.rows().select("unit_id").distinct().count()
    assert stands(book, units) == {"ok": 8, "error": 4}
    assert book.pending(units).count() == 0 and book.pending(units, retry_errors=True).count() == 4
    book.retry(units, lambda todo: todo.select("unit_id", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error")))
    assert stands(book, units) == {"ok": 12} and book.rows().count() == 16


def test_units_seen_in_an_earlier_batch_are_not_done_again(spark):
    book, units = ledger(spark), plan(spark, 4)
    book.run(units_of(spark, units.union(units.withColumn("place", F.col("place") + 1)), 3), execute)
    assert book.rows().count() == 4


def test_another_plan_is_refused(spark):
    book = ledger(spark)
    bound = book.open(plan(spark))
    assert book.open(plan(spark).repartition(3).select("place", "unit_id", "task")) == bound
    with pytest.raises(RuntimeError, match="of another plan"):
        book.open(plan(spark, 11))
    with pytest.raises(RuntimeError, match="of another plan"):
        book.open(plan(spark).withColumn("place", 11 - F.col("place")))


def test_torn_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"unit_id": "a", "status": "ok"}\n\n{"unit_id": "b", "status": "error"}\n{"unit_id": "c", "sta')
    whole, torn = runs.repaired_log(spark, f"file://{tmp_path}/log.jsonl", "unit_id string, status string")
    assert sorted((r.unit_id, r.status) for r in whole.collect()) == [("a", "ok"), ("b", "error")]
    assert [r.value for r in torn.collect()] == ['{"unit_id": "c", "sta']
