"""The batch gate reads its matches from one stored table."""
from beaconry.operators import verify


def test_gate_runs_the_texts_once(spark):
    rows = [(1, 1, "a", "ip", 0.9), (1, 2, "b", "ip", 0.7), (2, 1, "a", "ip", 0.8), (3, 1, "c", "url", None)]
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(len(batch))
            yield batch

    schema = "doc_id long, place int, value string, type string, confidence double"
    found = spark.createDataFrame(rows, schema).mapInPandas(counted, schema)
    verdicts = spark.createDataFrame([("a", "ip", 0.5, False, None), ("b", "ip", 0.6, True, "seen")], "value string, type string, confidence double, is_valid boolean, reasoning string")
    got = {(r.doc_id, r.value): r for r in verify.batch_gate(found, verdicts, top=2).collect()}
    assert calls.value == len(rows)
    assert got[1, "a"].verified and got[2, "a"].verified and not got[1, "a"].is_valid and got[1, "a"].reasoning == ""
    assert not got[1, "b"].verified and got[1, "b"].verdict_confidence is None and got[1, "b"].is_valid
    assert not got[3, "c"].verified


def test_gate_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, place int, value string, type string, confidence double")
    verdicts = spark.createDataFrame([], "value string, type string, confidence double, is_valid boolean, reasoning string")
    assert verify.batch_gate(empty, verdicts).collect() == []
