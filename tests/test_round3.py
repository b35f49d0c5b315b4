"""Inputs of the third review: folders of files as streams, slow triggers, odd decoded bytes, fresh fetches."""
import base64
import time

from pyspark.sql import functions as F

from beaconry.operators import refang as R
from beaconry.operators import store as S
from beaconry.plans import catalog_store as CS
from beaconry.plans import catalog_stream as CT
from beaconry.plans import views as V
from beaconry.streaming import alerts as A
from beaconry.streaming import jobs as J


def test_stream_of_file_and_folder(spark, tmp_path):
    spark.range(40).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/made")
    next(tmp_path.glob("made/*.parquet")).rename(tmp_path / "events.parquet")
    for name, rows in (("documents", 40), ("events", 7)):
        out = J.run_available(V.stream(spark, str(tmp_path), name), "append", f"{tmp_path}/run-{name}")
        assert sorted(r.id for r in out.collect()) == list(range(rows))


def test_decoded_name_before_a_foreign_letter(spark):
    run = base64.b64encode("z{bz.jyݶ and more".encode()).decode()
    plain = base64.b64encode("٥.٥.٥.٥ no indicator".encode()).decode()
    docs = spark.createDataFrame([(1, f"x {run} y"), (2, f"x {plain} y")], "doc_id int, text string")
    out = {r.doc_id: r.clean for r in R.only(docs, "base64_runs").collect()}
    assert out[1].endswith("[DECODED_BASE64_IOCS]\nz{bz.jyݶ and more") and out[2] == f"x {plain} y"


def test_alert_timers_with_slow_triggers(spark, tmp_path, monkeypatch):
    quick = A.merged

    def slow(batch):
        time.sleep(9)
        return quick(batch)

    monkeypatch.setattr(A, "merged", slow)
    schema = "channel string, severity string, item string, lane int"
    spark.createDataFrame([("hot", "High", f"h{i}", i % 2) for i in range(25)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    out = A.run_until_quiet(A.alerts(stream, F.col("lane"), seconds=3), str(tmp_path), 3).collect()
    assert sorted((r.reason, len(r["items"])) for r in out) == [("full", 10), ("full", 10), ("timer", 5)]


def test_fetch_age_below_two_minutes(spark, tmp_path):
    events = "select 1L as event_id, 1L as user_id, 'view' as event_type, 1D as value, timestamp '2024-01-30 23:59:30' as ts"
    spark.sql(events).write.parquet(f"{tmp_path}/events.parquet")
    row = CS.QUERIES["fetch_age"][0](spark, str(tmp_path)).first()
    assert tuple(row) == (0, "Last feed fetch was 0 minutes ago.")
    checks = V.view(spark, str(tmp_path), V.FEED_CHECKS, "events")
    assert S.fetch_age(checks, CS.as_of()).first().message == "Last feed fetch was just now."


def test_ingest_triggers_are_many_tasks_work(spark, monkeypatch):
    tasks, ids = [], []

    def record(stream, normalize, as_of, tables, progress):
        def note(batch, epoch):
            tasks.append(batch.rdd.getNumPartitions())
            ids.extend(r.doc_id for r in batch.select("doc_id").collect())

        stream.writeStream.option("checkpointLocation", progress).foreachBatch(note).trigger(availableNow=True).start().awaitTermination()

    monkeypatch.setattr(J, "ingest_cycle", record)
    sf_dir = "/root/testdata/sf0.001"
    CT.ingested(spark, sf_dir)
    every = {r.doc_id for r in V.table(spark, sf_dir, "documents").select("doc_id").collect()}
    assert set(ids) == every and len(ids) > len(every)  # a part comes again
    assert len(tasks) >= 4 and all(n > 1 for n in tasks)
