from pathlib import Path

from lexweave import session as S


def test_shared_folder_and_release(spark):
    where = S.shared_dir(spark)
    assert where == S.shared_dir(spark) and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    df = S.materialize(spark.range(5).toDF("x"), "t")
    path = Path(S._written[-1][1].removeprefix("file://"))
    assert path.exists() and df.count() == 5
    S.release()
    assert not path.exists() and not S._written


def test_small_or_not(spark):
    df = spark.range(10).toDF("x")
    assert "broadcast" in S.small_or_not(df, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in S.small_or_not(df, 9)._jdf.queryExecution().logical().toString().lower()
