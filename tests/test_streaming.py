from datetime import datetime, timedelta

from lexweave.functions import text as T
from lexweave.operators import diversity as D
from lexweave.operators import guard as U
from lexweave.streaming import documents as S
from lexweave.streaming import guard as SG


def test_documents_stream(spark, tmp_path):
    rows = [(i, f"the cat {i % 4} sat on a mat and the dog {'ran ' * (i % 5)}", datetime(2025, 1, 1 + i), "src") for i in range(12)] + [(99, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ingested_at timestamp, source string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.profile_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r.doc_id: round(r.mtld or -1, 9) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.doc_id: round(r.mtld or -1, 9) for r in D.panel_a(T.tokens(df), ["doc_id"]).collect()}
    assert got == want and len(got) == 12
    q = S.basic_columns(stream).writeStream.format("memory").queryName("basic_rows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {r.doc_id: round(r.msttr, 9) for r in D.msttr(T.tokens(df), ["doc_id"]).collect()}
    assert {r.doc_id: round(r.msttr, 9) for r in spark.table("basic_rows").collect()} == batch
    q = S.windowed_counts(stream).writeStream.format("memory").queryName("win_rows").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("win_rows").count() >= 2


def test_guard_stream(spark, tmp_path):
    at = datetime(2025, 1, 1)
    rows = [(i, f"s{i % 2}", at + timedelta(seconds=10 * i), 1 + i % 30, i % 4 != 0) for i in range(40)]
    df = spark.createDataFrame(rows, "request_id long, session_key string, ts timestamp, documents int, success boolean")
    df.coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "g"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "g"))
    q = SG.decisions_stream(stream).writeStream.format("memory").queryName("guard_rows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda rs: sorted((r.request_id, r.decision, r.retry_after, round(r.credits, 6)) for r in rs)
    assert key(spark.table("guard_rows").collect()) == key(U.decisions(df).collect())
