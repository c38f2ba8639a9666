import pytest
from pyspark.sql import functions as F

from mosaiq.operators import stages
from mosaiq.operators.stages import Stage


def videos(spark):
    rows = [("s", "r", True, 1), ("s", "a", False, 2), ("s", "b", False, 3), ("t", "q", True, 4), ("t", "c", False, 5), ("u", "d", False, 6)]
    return spark.createDataFrame(rows, "source_id string, video_id string, is_reference boolean, size int")


class Broken(Exception):
    pass


def plan(fail=(), broken=None, calls=None, factor=2):
    """Three stages: each adds to what the one before made. `broken` raises before a stage, as a lost driver does."""

    def first(work, earlier):
        if calls is not None:
            calls.append(("first", sorted(r[0] for r in work.select("video_id").collect())))
        return work.select("video_id", (F.col("size") * factor).alias("x"), F.when(F.col("video_id").isin(*fail), "unreadable").alias("error"))

    def second(work, earlier):
        if broken == "second":
            raise Broken
        return work.join(earlier["first"].select("video_id", "x"), "video_id").select("video_id", (F.col("x") + 1).alias("y"), F.lit(None).cast("string").alias("error"))

    def third(work, earlier):
        out = work.join(earlier["second"].select("video_id", "y"), "video_id").select("video_id", (F.col("y") * 10).alias("z"), F.lit(None).cast("string").alias("error"))
        return out.filter("video_id <> 'b'") if broken == "third" else out

    return [Stage("first", first, ("size",), {"factor": factor}), Stage("second", second), Stage("third", third)]


def tables(spark, folder, df):
    log = stages.current(stages.read_log(spark, folder), stages.with_keys(df, plan()), plan())
    return {n: sorted(tuple(r) for r in stages.results(spark, folder, n, log).drop("error").collect()) for n in ("first", "second", "third")}


def test_a_broken_run_ends_with_the_tables_of_an_unbroken_one(spark, tmp_path):
    df = videos(spark).filter("source_id <> 'u'")
    whole, parts = f"{tmp_path}/whole", f"{tmp_path}/parts"
    assert {r["state"] for r in stages.run(df, plan(), whole).collect()} == {"completed"}
    with pytest.raises(Broken):
        stages.run(df, plan(broken="second"), parts)
    # rows of an attempt that ended before its log was written do not count
    spark.createDataFrame([("a", 999, None)], "video_id string, y int, error string").write.parquet(f"{parts}/results/second/attempt=lost")
    calls = []
    stages.run(df, plan(calls=calls), parts)
    assert calls == [] and tables(spark, parts, df) == tables(spark, whole, df)
    assert dict(tables(spark, whole, df)["third"]) == {v: 10 * (2 * n + 1) for v, n in (("r", 1), ("a", 2), ("b", 3), ("q", 4), ("c", 5))}


def test_a_failed_reference_stops_its_source_only(spark, tmp_path):
    df, folder = videos(spark).filter("video_id <> 'b'"), str(tmp_path)
    got = {(r["video_id"], r["stage"]): r["state"] for r in stages.run(df, plan(fail=("r",))[:2], folder).collect()}
    assert got["r", "first"] == "failed" and got["r", "second"] == "waiting"
    assert {got[v, s] for v in "ad" for s in ("first", "second")} == {"blocked"}  # d has no reference
    assert {got[v, s] for v in "qc" for s in ("first", "second")} == {"completed"}


def test_missing_results_fail_and_changed_inputs_are_due_again(spark, tmp_path):
    df, folder, calls = videos(spark).filter("source_id = 's'"), str(tmp_path), []
    two = lambda **how: [plan(**how)[k] for k in (0, 1)]
    lost = [two()[0], Stage("second", lambda work, earlier: two()[1].run(work, earlier).filter("video_id <> 'b'"))]
    got = {r["video_id"]: r["state"] for r in stages.run(df, lost, folder).filter("stage = 'second'").collect()}
    assert got == {"r": "completed", "a": "completed", "b": "failed"}
    assert stages.read_log(spark, folder).filter("video_id = 'b' and stage = 'second'").first()["reason"] == "no result"
    changed = df.withColumn("size", F.when(F.col("video_id") == "a", 7).otherwise(F.col("size")))
    assert {r["state"] for r in stages.run(changed, two(calls=calls), folder).collect()} == {"completed"}
    assert calls == [("first", ["a"])]  # b's first stage stands, its second is tried again
    log = stages.current(stages.read_log(spark, folder), stages.with_keys(changed, two()), two())
    assert {r["video_id"]: r["y"] for r in stages.results(spark, folder, "second", log).collect()} == {"r": 3, "a": 15, "b": 7}
    keys = [{tuple(r) for r in stages.with_keys(df, two(factor=k)).select("video_id", "key_first", "key_second").collect()} for k in (2, 3)]
    assert not keys[0] & keys[1]  # another parameter makes both stages due
