"""The kept mart equals one scan of everything, after late, repeated and split batches."""



from moveatlas import schema as S
from moveatlas.plans import mart
from moveatlas.sources import counts as C
from moveatlas.streaming import mart as K


def rows(counts, days, **more):
    return counts(*({"ymd": d, "hour": f"{h:02d}", "place": p, "purpose": u, "cells": str(1 + i % 3), **more}
                    for i, (d, h, p, u) in enumerate((d, h, p, u) for d in days for h in (11, 19) for p in ("A_B_C", "A_B_D")
                                                     for u in (S.SHOPPING, S.RETURN_HOME, S.TOURISM))))


def compared(df):
    rows = (tuple(r) for r in df.select(*sorted(df.columns)).collect())
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


YEAR = ("20240101", "20241231")


def test_late_and_repeated_batches(spark, counts, tmp_path):
    path = str(tmp_path / "mart")
    first, late = rows(counts, ["20240105", "20240210"]), rows(counts, ["20240106", "20250103"])
    K.write_batch(C.standardise_counts(first), path, "1")
    K.write_batch(C.standardise_counts(late), path, "2")
    K.write_batch(C.standardise_counts(first), path, "1")
    whole = C.standardise_counts(first.unionByName(late))
    assert compared(K.read_mart(spark, path, (202401, 202412))) == compared(mart.indicator_mart(whole, YEAR))
    february = mart.indicator_mart(whole, ("20240201", "20240229"), S.DISTRICT)
    assert compared(K.read_mart(spark, path, (202402, 202402), (S.DISTRICT,))) == compared(february)


def test_compacted_marts_read_the_same(spark, counts, tmp_path):
    path, to = str(tmp_path / "mart"), str(tmp_path / "compact")
    for i, day in enumerate(("20240105", "20240106", "20240301")):
        K.write_batch(C.standardise_counts(rows(counts, [day])), path, str(i))
    K.compact(spark, path, to)
    assert compared(K.read_mart(spark, to, (202401, 202412))) == compared(K.read_mart(spark, path, (202401, 202412)))
    assert spark.read.parquet(to).count() < spark.read.parquet(path).count()


def test_new_files_are_added_once(spark, counts, tmp_path):
    src, path, progress = (str(tmp_path / n) for n in ("in", "mart", "progress"))
    days = ["20240105", "20240112", "20240209"]
    frames = [rows(counts, [d]) for d in days]
    for i, frame in enumerate(frames[:2]):
        frame.coalesce(1).write.option("header", True).mode("append").csv(src)
    K.keep_mart(spark, src, path, progress, files_per_batch=1).awaitTermination()
    K.keep_mart(spark, src, path, progress).awaitTermination()
    frames[2].coalesce(1).write.option("header", True).mode("append").csv(src)
    K.keep_mart(spark, src, path, progress).awaitTermination()
    whole = C.standardise_counts(frames[0].unionByName(frames[1]).unionByName(frames[2]))
    assert compared(K.read_mart(spark, path, (202401, 202412))) == compared(mart.indicator_mart(whole, YEAR))


def test_reading_the_mart_does_not_read_counts(spark, counts, tmp_path):
    path = str(tmp_path / "mart")
    K.write_batch(C.standardise_counts(rows(counts, ["20240105"])), path, "1")
    stored = K.read_mart(spark, path, (202401, 202401))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ETL_YM,202401)" in plan and "MALE_00" not in plan


def test_indicators_from_the_kept_mart(spark, counts, tmp_path):
    path = str(tmp_path / "mart")
    frame = rows(counts, ["20240105", "20240108"])
    K.write_batch(C.standardise_counts(frame), path, "1")
    kept = K.read_mart(spark, path, (202401, 202412))
    once = mart.indicator_mart(C.standardise_counts(frame), YEAR)
    for part in (mart.bedtown_from_mart, mart.hotness_from_mart, mart.women_share_from_mart):
        assert compared(part(kept)) == compared(part(once))
