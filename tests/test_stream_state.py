"""The log of last records: what it holds, what it writes, and batches that fail or are repeated."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridtide.operators.densify import Interp
from gridtide.sinks import file_target
from gridtide.streaming import interpolate_each_batch, state

RECORD = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType())])


def test_merges_keep_few_runs_of_each_level(monkeypatch):
    monkeypatch.setattr(state, "SMALLEST_RUN", 4)
    rng = random.Random(3)
    for sizes in ([1] * 300, [rng.choice([0, 1, 5, 40, 300]) for _ in range(400)]):
        runs, written = [], 0
        for batch, rows in enumerate(sizes):
            runs.append(state.Run(0, batch, rows))
            while merged := state.to_merge(runs):
                assert merged == runs[-len(merged) :]
                rows = sum(r.rows for r in merged)
                written += rows
                runs = [*runs[: -len(merged)], state.Run(0, batch, rows)]
            levels = [r.level for r in runs]
            assert levels == sorted(levels, reverse=True)
            assert all(levels.count(k) < state.FAN for k in levels)
        # A row is written again for each level it rises to, and with small ones on its way.
        assert written <= 2 * sum(sizes) * 8


def held(spark, log, batch_id):
    runs = log.runs(spark, batch_id)
    return {r["id"]: r["v"] for r in log._newest(spark, runs).collect()} if runs else {}


def test_log_holds_the_newest_record(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "SMALLEST_RUN", 4)
    log = state.LastRecords(str(tmp_path), RECORD, ["id"])
    rng, wanted = random.Random(1), {}
    for batch in range(12):
        rows = {rng.choice([None, *range(30)]): batch + rng.random() for _ in range(rng.choice([0, 1, 6, 25]))}
        wanted |= rows
        runs = log.runs(spark, batch - 1)
        log.note(spark, log.put(spark.createDataFrame(list(rows.items()), RECORD), runs, batch), batch)
        assert held(spark, log, batch) == wanted
    asked = spark.createDataFrame([(None, 0.0), (3, 0.0), (3, 1.0), (99, 0.0)], RECORD)
    found = {r["id"]: r["v"] for r in log.of(asked, log.runs(spark, 11)).collect()}
    assert found == {k: v for k, v in wanted.items() if k in (None, 3)}
    # Slots are used again: no more of them than runs before and after a batch.
    assert len(list(tmp_path.glob("slot=*"))) <= 2 * state.FAN * 4


def test_state_that_does_not_follow_is_refused(spark, tmp_path):
    log = state.LastRecords(str(tmp_path), RECORD, ["id"])
    log.note(spark, log.put(spark.createDataFrame([(1, 1.0)], RECORD), [], 0), 0)
    with pytest.raises(RuntimeError):
        log.runs(spark, 2)


def size(folder):
    return {p: p.stat().st_size for p in folder.rglob("*.parquet")}


def test_small_batches_write_little_beside_many_ids(spark, tmp_path):
    """A million ids held, a thousand of them in the batch: under two megabytes are written."""
    log_folder = tmp_path / "state"
    writer = interpolate_each_batch(RECORD, 2, [Interp("v", "double")], ["id"], ["v"], file_target(str(tmp_path / "out")), str(log_folder))
    ids = 1_000_000
    writer(spark.range(ids).select("id", F.lit(0.0).alias("v")), 0)
    for batch_id in (1, 2):
        before = size(log_folder)
        writer(spark.range(0, ids, 1000).select("id", F.lit(2.0 * batch_id).alias("v")), batch_id)
        new = {p: n for p, n in size(log_folder).items() if p not in before}
        assert new
        assert sum(new.values()) < 2_000_000
        out = spark.read.parquet(str(tmp_path / "out")).where(F.col("batch") == batch_id)
        assert [tuple(r) for r in out.groupBy("v").count().orderBy("v").collect()] == [(2.0 * batch_id - 2, 1000), (2.0 * batch_id - 1, 1000)]


@pytest.mark.parametrize("broken", ["put", "output", "note"])
def test_failed_batches_give_the_same_rows(spark, tmp_path, monkeypatch, broken):
    """Twenty batches, every third of which fails at some step and is run again."""
    monkeypatch.setattr(state, "SMALLEST_RUN", 4)
    rng = random.Random(9)
    batches = [[(rng.randrange(12), float(k * 100 + j)) for j in range(rng.randint(1, 15))] for k in range(20)]

    def run(folder, failing):
        target = file_target(str(folder / "out"))
        writer = interpolate_each_batch(RECORD, 2, [Interp("v", "double")], ["id"], ["v"], target, str(folder / "state"))
        for batch_id, rows in enumerate(batches):
            df = spark.createDataFrame(rows, RECORD)
            if failing and batch_id % 3 == 2:
                with monkeypatch.context() as m:

                    def fails(*_):
                        raise OSError("executor lost")

                    if broken == "put":
                        m.setattr(state.LastRecords, "_write", fails)
                    elif broken == "output":
                        m.setattr("gridtide.streaming.interpolate.write_batch", fails)
                    else:
                        m.setattr(state.LastRecords, "note", fails)
                    with pytest.raises(OSError):
                        writer(df, batch_id)
            writer(df, batch_id)
            if failing and batch_id % 5 == 0:
                writer(df, batch_id)  # done, but run again
        got = spark.read.parquet(target.path)
        return sorted((r["batch"], r["id"], r["v"]) for r in got.collect())

    whole = run(tmp_path / "whole", False)
    assert run(tmp_path / "failing", True) == whole
    last, wanted = {}, []
    for k, rows in enumerate(batches):
        for id_, v in sorted(rows, key=lambda r: r[1]):
            if id_ in last:
                wanted += [(k, id_, last[id_]), (k, id_, (last[id_] + v) / 2)]
            last[id_] = v
    assert whole == sorted(wanted)
