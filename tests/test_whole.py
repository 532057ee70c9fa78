"""Queries and operators that must do the whole job: all levels, all rows, all days."""

from pyspark.sql import functions as F

from tessera.operators import closure, incremental, verify
from tessera.operators.reach import build
from tessera.plans import QUERIES

SF = "/root/testdata/sf0.001"


def test_closure_of_a_long_chain(spark):
    n = 12
    e = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(n)] + [("t0", "t5"), ("t12", "t10"), (None, "t9")], "child string, parent string")
    reach, index = closure.closure(e), build(e)
    got = {(r.descendant, r.ancestor): r.depth for r in reach.collect()}
    assert got["t0", "t12"] == 8 and got["t1", "t12"] == 11 and got["t12", "t12"] == 3 and got[None, "t12"] == 4
    assert len(got) == reach.count() and {a for d, a in got if d == "t0"} == {f"t{i}" for i in range(1, n + 1)}
    own = spark.createDataFrame([("t12", "m")], "id string, member string")
    assert [(r.owner, r.depth) for r in closure.effective_members(own, reach).where("id = 't1'").collect()] == [("t12", 11)]
    pair = spark.createDataFrame([("t1", "t12"), ("t12", "t1")], "from_id string, to_id string")
    assert {r.from_id: r.reason for r in closure.assignable(pair, e, index).collect()} == {"t1": "compatible", "t12": None}
    args = spark.createDataFrame([(1, "f", 0, "t1"), (2, "f", 0, "t12")], "call_id int, name string, pos int, type string")
    params = spark.createDataFrame([("f", 0, "t11")], "name string, pos int, type string")
    assert verify.first_mismatch(args, params, index).collect() == []
    assert closure.closure(e.limit(0)).collect() == []


def test_callers_of_a_long_chain(spark):
    calls = spark.createDataFrame([(i + 1, i) for i in range(9)] + [(4, 9), (20, 21)], "caller long, callee long")
    touched = spark.createDataFrame([(0,), (3,)], "routine long")
    got = incremental.expand_callers(touched, calls).collect()
    assert sorted((r.routine, r.depth) for r in got) == [(0, 0), (1, 1), (2, 2), (3, 0), (4, 1), (5, 2), (6, 3), (7, 4), (8, 5), (9, 6)]
    far = incremental.expand_callers(touched.where("routine = 0"), calls.where(F.col("caller") <= 9)).collect()
    assert len(far) == 10


def _days(spark, ids):
    return spark.createDataFrame(ids, "day long, path string, hash string")


def test_snapshots_of_all_days(spark):
    new = _days(spark, [(1, "a", "1"), (2, "a", "2"), (4, "b", "3"), (2, "c", "4")])
    old = new.withColumn("day", F.col("day") + 1).where("day <= 4")
    got = sorted(tuple(r) for r in incremental.snapshot_diff(old, new, "day").collect())
    assert got == [(1, "a", "added"), (2, "a", "changed"), (2, "c", "added"), (3, "a", "removed"), (3, "c", "removed"), (4, "b", "added")]


def test_daily_query_sees_the_last_day(spark):
    days = spark.read.parquet(f"{SF}/events.parquet").select(F.unix_date(F.to_date("ts")).alias("d"))
    want = {r.d for r in days.distinct().collect()}
    got = {r.day for r in QUERIES["snapshot_diff_daily"](spark, SF).where("change != 'removed'").collect()}
    assert got == want


def _parts(spark, tmp_path, n=600):
    rows = [(i, f"red w{i % 7}", f"T{i % 2}", "B") for i in range(1, n + 1)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    return rows


def test_all_holders_of_a_member(spark, tmp_path):
    rows = _parts(spark, tmp_path)
    got = sorted((r.member, r.id) for r in QUERIES["index_member_holders"](spark, str(tmp_path)).collect())
    assert got == sorted((m, f"part.{k}") for k, name, *_ in rows for m in name.split())


def test_all_parts_inherit(spark, tmp_path):
    rows = _parts(spark, tmp_path)
    got = sorted((r.id, r.member, r.inherited) for r in QUERIES["template_inherit_all"](spark, str(tmp_path)).collect())
    want = [(f"part.{k}", m, False) for k, name, *_ in rows for m in name.split()]
    want += [(f"part.{k}", "w0", True) for k, name, *_ in rows if "w0" not in name.split()]  # "red w0" is the least name of both kinds
    assert got == sorted(want)
