"""Forecasts where a reply gives none."""
from beaconry import constants as C
from beaconry.operators import predict


def test_fallback(spark):
    rows = [
        (1, '{"predictions": [], "defensive_recommendations": ["x"]}', "Impact"),  # an empty answer is an answer
        (2, '{"current_stage": "Impact"}', "Exfiltration"), (3, "no object", None), (4, None, "Elsewhere"), (5, "", "Discovery"),
        (6, '{"predictions": [{"tactic": "Impact"}]}', "Discovery"),
    ]
    made = predict.forecast(spark.createDataFrame(rows, "id int, raw_reply string, stage string"), "stage")
    got = {r.id: r for r in made.collect()}
    assert {i for i, r in got.items() if r.fallback} == {2, 3, 4, 5}
    assert got[1].predictions == [] and got[1].recommendations == ["x"]
    assert got[6].predictions[0].tactic == "Impact" and got[6].recommendations == []
    assert [p.tactic for p in got[2].predictions] == ["Impact"] * 3  # the last stage is followed by itself
    assert [p.tactic for p in got[3].predictions] == [p.tactic for p in got[4].predictions] == C.STAGES[1:4]
    assert [p.confidence for p in got[5].predictions] == [0.6, 0.4, 0.3]
    assert all(got[i].recommendations == C.FALLBACK_RECOMMENDATIONS for i in (2, 3, 4, 5))


def test_no_replies(spark):
    assert predict.forecast(spark.createDataFrame([], "raw_reply string, stage string"), "stage").collect() == []
