"""Order operators against brute force, with one id holding a third of the rows."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gridtide.operators import order as O

SCHEMA = "id long, ts long, seq long, x double"


def skewed_rows(n, seed, ids=40):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        id_ = 0 if rng.random() < 0.34 else rng.randrange(1, ids)
        # Few distinct times, so the second order column decides often.
        rows.append((id_, rng.randrange(n // 20), seq, rng.random()))
    rng.shuffle(rows)
    return rows


def brute_next(rows, keyed):
    chains = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        chains.setdefault(row[0] if keyed else None, []).append(row)
    return {
        a[2]: (b[2] if b else None)
        for chain in chains.values()
        for a, b in zip(chain, [*chain[1:], None], strict=True)
    }


@pytest.mark.parametrize("keys", [["id"], []])
@pytest.mark.parametrize("size", [None, 50, 333])
@pytest.mark.parametrize("stored", [False, True])
def test_next_equals_brute_force(spark, few, keys, size, stored):
    rows = skewed_rows(4000, seed=7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = O.with_next(df, keys, ["ts", "seq"], ["seq", "x"], rows_per_segment=size, stored=stored)
    assert got.columns == [*df.columns, "next"]
    found = {r.seq: (r.next.seq if r.next else None) for r in got.collect()}
    assert found == brute_next(rows, bool(keys))


@pytest.fixture(params=[False, True], ids=["many ranges", "few ranges"])
def few(request, monkeypatch):
    """With few ranges every one of them holds several pieces."""
    if request.param:
        monkeypatch.setattr(O, "RANGES", 3)


@pytest.mark.parametrize("hot", [0, None])
def test_hot_key_takes_several_ranges(spark, hot):
    rows = [(r[0] or hot, *r[1:]) for r in skewed_rows(6000, seed=3)]
    df = spark.createDataFrame(rows, SCHEMA)
    ranged = O.in_ranges(df.select(F.struct(*df.columns).alias(O.ROW)), ["id"], ["ts", "seq"], O.Layout(15, 150))
    sizes = ranged.groupBy(O.SEGMENT).count().collect()
    assert len(sizes) == 15
    assert max(r["count"] for r in sizes) < 1200
    assert max(r["count"] for r in ranged.groupBy(O.SEGMENT, O.PIECE).count().collect()) == 150
    is_hot = F.col(f"{O.ROW}.id").eqNullSafe(F.lit(hot))
    assert ranged.where(is_hot).select(O.SEGMENT).distinct().count() >= 4
    got = O.with_next(df, ["id"], ["ts", "seq"], ["seq"], rows_per_segment=400)
    assert {r.seq: (r.next.seq if r.next else None) for r in got.collect()} == brute_next(rows, True)


def test_next_struct_with_nulls_is_still_a_next(spark):
    df = spark.createDataFrame([(1, i, i, None) for i in range(200)], SCHEMA)
    got = O.with_next(df, ["id"], ["ts", "seq"], ["x"], rows_per_segment=20)
    assert got.where("next IS NULL").count() == 1


def test_instants_survive_a_driver_zone_with_daylight_saving(spark, monkeypatch):
    monkeypatch.setenv("TZ", "Europe/Prague")
    time.tzset()
    try:
        # Minutes around 2024-10-27 01:00 UTC, when local clocks repeat an hour.
        df = spark.range(1_729_980_000, 1_729_995_000, 60).select(
            F.lit(1).alias("id"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("s")
        )
        got = O.with_next(df, ["id"], ["ts"], ["ts", "s"], rows_per_segment=8)
        steps = got.where("next IS NOT NULL").select(
            F.col("next.s") - F.col("s"), F.unix_seconds("next.ts") - F.col("s")
        )
        assert {tuple(r) for r in steps.collect()} == {(60, 60)}
        assert got.where("next IS NULL").count() == 1
    finally:
        monkeypatch.undo()
        time.tzset()


def test_equal_order_values_do_not_break_the_chain(spark):
    df = spark.createDataFrame([(1, 5, i, 0.0) for i in range(500)], SCHEMA)
    got = O.with_next(df, ["id"], ["ts"], ["x"], rows_per_segment=20)
    assert got.count() == 500
    assert got.where("next IS NULL").count() == 1


@pytest.mark.parametrize("size", [None, 64])
def test_position_equals_brute_force(spark, few, size):
    rows = skewed_rows(3000, seed=11)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = O.with_position(df, ["ts", "seq"], rows_per_segment=size)
    expected = {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}
    assert {r.seq: r.position for r in got.collect()} == expected


@pytest.mark.parametrize("size", [None, 64])
def test_max_before_equals_brute_force(spark, few, size):
    rows = skewed_rows(2500, seed=13)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = O.with_max_before(df, ["ts", "seq"], "x", rows_per_segment=size)
    top, expected = None, {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        expected[r[2]] = top
        top = r[3] if top is None else max(top, r[3])
    assert {r.seq: r.max_before for r in got.collect()} == expected


def test_ranges_grow_in_number_up_to_a_width_and_then_in_pieces(spark):
    def cut(rows, width, keyed=True):
        found = O.layout(spark, rows, rows * width, keyed)
        return found.ranges, found.piece_rows * width

    assert cut(10**4, 100) == (1, O.PIECE_BYTES // 100 * 100)
    assert cut(10**8, 100)[0] == -(-(10**10) // O.RANGE_BYTES)
    # Wide rows take more ranges and shorter pieces than narrow ones.
    assert cut(10**6, 10**4)[0] == 100 * cut(10**6, 100)[0] - 25
    for rows, width in ((2 * 10**12, 50), (10**15, 1000)):
        ranges, piece = cut(rows, width)
        assert ranges == O.RANGES
        assert piece <= O.PIECE_BYTES
    assert cut(10**4, 100, keyed=False)[0] == 10**4 // O.SMALLEST_RANGE
    assert cut(0, 1, keyed=False)[0] == 1
    assert O.layout(spark, 10**13, 1, True, 7) == O.Layout(O.RANGES, 7)


def test_small_pieces_share_ranges(spark):
    # A range each would be 20,000 tasks for these rows, whose results all go to the driver.
    for rows in (6 * 10**6, 36 * 10**6):
        cut = O.layout(spark, rows, rows * 60, True, 300)
        assert cut.piece_rows == 300
        assert cut.ranges <= rows / 10**4
    assert O.layout(spark, 10**5, 6 * 10**6, True, 300).ranges == O.FEW_RANGES
    assert O.layout(spark, 10**4, 10**6, True, 300).ranges == 34


def test_row_bytes_follow_the_values(spark):
    df = spark.createDataFrame([(1, "é" * 100, [1] * 50, None), (None, None, None, None)], "a long, b string, c array<int>, d struct<x:int>")
    kind = df.schema
    sizes = [r[0] for r in df.select(O.row_bytes(kind, F.struct(*df.columns)).alias("n")).collect()]
    assert sizes == [8 + 8 + 216 + 416 + 16, 8 + 8 + 8 + 16 + 16]


def test_bucket_numbers_are_one_to_one(spark):
    for n in (1, 3, 8, 211, 1000):
        found = O._bucket_numbers(spark, n).collect()
        assert sorted(r[O.RANGE] for r in found) == list(range(n))
        again = spark.createDataFrame(found).select(F.pmod(F.hash(F.col(O.SEGMENT).cast("int")), F.lit(n)), O.RANGE)
        assert all(a == b for a, b in again.collect())


def test_more_ranges_than_asked_for_lose_no_row(spark, monkeypatch):
    kind = type(spark.range(1))
    whole = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, n, *c: whole(self, 40, *c))
    rows = skewed_rows(3000, seed=5)
    df = spark.createDataFrame(rows, SCHEMA)
    got = O.with_next(df, ["id"], ["ts", "seq"], ["seq"], rows_per_segment=500)
    assert {r.seq: (r.next.seq if r.next else None) for r in got.collect()} == brute_next(rows, True)
    placed = O.with_position(df, ["ts", "seq"], rows_per_segment=500)
    assert sorted(r.position for r in placed.collect()) == list(range(3000))


def test_input_is_evaluated_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = skewed_rows(2000, seed=6)
    df = spark.createDataFrame(rows, SCHEMA).mapInArrow(counted, SCHEMA)
    for got in (O.with_next(df, ["id"], ["ts", "seq"], ["seq"], rows_per_segment=100), O.with_position(df, ["ts", "seq"])):
        assert got.count() == 2000
    assert seen.value == 4000


def test_columns_called_like_the_helpers(spark):
    df = spark.createDataFrame([(1, i, 2 * i) for i in range(50)], "_segment long, _at long, _row long")
    got = O.with_next(df, ["_segment"], ["_at"], ["_row"], rows_per_segment=7, into="_first")
    assert got.columns == ["_segment", "_at", "_row", "_first"]
    assert {r["_at"]: r["_first"][0] if r["_first"] else None for r in got.collect()} == {
        i: 2 * i + 2 if i < 49 else None for i in range(50)
    }


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert O.with_next(df, [], ["ts"], ["x"]).count() == 0
    assert O.with_position(df, ["ts"]).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_window_over_the_whole_table(spark):
    df = spark.createDataFrame(skewed_rows(3000, seed=1), SCHEMA)
    got = O.with_next(df, [], ["ts", "seq"], ["x"], rows_per_segment=100)
    plan = plan_of(got)
    over_rows = re.findall(r"lead\(.*?windowspecdefinition\((\w+)#", plan)
    assert over_rows.count(O.SEGMENT) >= 2
    # Only the ranges' heads, one row each, are in one window.
    assert len([w for w in over_rows if w != O.SEGMENT]) <= 1
    assert "Cartesian" not in plan
    assert "BroadcastNestedLoop" not in plan
    assert got.select(F.count("*")).first()[0] == 3000


def rows_exchanged(plan):
    """Exchanges and sorts above a scan that still carry whole rows."""
    return [line for line in plan.splitlines() if re.search(r"(Exchange|Sort) ", line) and O.SEGMENT in line]


def test_rows_are_exchanged_once(spark):
    """The exchange into ranges is the only one of rows, and stored rows are not sorted again."""
    df = spark.createDataFrame(skewed_rows(3000, seed=2), SCHEMA)
    rows = df.select(F.struct(*df.columns).alias(O.ROW))
    written = plan_of(O.dealt(rows, ["id"], ["ts", "seq"], O.Layout(10, 100)))
    assert len(re.findall(r"Exchange rangepartitioning", written)) == 1
    assert "hashpartitioning(_segment" not in written
    asked = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(asked)
    spark.conf.set(asked, -1)  # as it is where the heads are many
    try:
        got = O.with_next(df, ["id"], ["ts", "seq"], ["x"], rows_per_segment=100)
        plan = plan_of(got)
        # What is exchanged is one head for each range, to be put in order and handed back.
        assert len(re.findall(f"Exchange hashpartitioning.{O.SEGMENT}", plan)) == 1
        assert not [line for line in rows_exchanged(plan) if f"{O.AT}#" in line]
        assert "SortMergeJoin" in plan
        placed = plan_of(O.with_position(df, ["ts", "seq"], rows_per_segment=100))
        assert f"{O.AT}#" not in "".join(rows_exchanged(placed))
    finally:
        spark.conf.set(asked, before)
