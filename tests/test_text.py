"""Refang and extraction on literal inputs."""
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beaconry import constants as C
from beaconry.operators import extract as X
from beaconry.operators import refang as R

PAIRS = [
    ("hxxps://evil[.]com/a", "https://evil.com/a"),
    ("hxxp://evil[dot]com", "http://evil.com"),
    ("1.2.3[.]4", "1.2.3.4"),
    ("0x7f000001", "127.0.0.1"),
    ("3232235777", "192.168.1.1"),
    ("0300.0250.1.1", "192.168.1.1"),
    ("08.09.1.2", "08.09.1.2"),
    ("a​b.com", "ab.com"),
    (r"http \x41 \101", "http A A"),
    ("user[at]evil.com", "user@evil.com"),
    ("user (at) evil.com", "user@evil.com"),
    ("CVE_2024 12345", "CVE-2024-12345"),
    ("meow://z.ru", "http://z.ru"),
    ("fxp://z.ru", "ftp://z.ru"),
    ("h**ps://x.y", "https://x.y"),
    ("hxxp%3A%2F%2Fz", "http%3A%2F%2Fz"),
    ("evil\n.com", "evil.com"),
    ("xn--bcher-kva.top", "bücher.top"),
    ("&#104;&amp;", "h&"),
    ("ｅｖｉｌ．com", "evil.com"),
    ("http[:]//a.b", "http://a.b"),
    ("`a.b.c` **d.e**", "a.b.c d.e"),
    ("plain text stays", "plain text stays"),
    ("aHR0cDovL2V2aWwucnUvYS5leGU=", "aHR0cDovL2V2aWwucnUvYS5leGU=\n\n[DECODED_BASE64_IOCS]\nhttp://evil.ru/a.exe"),
]


def test_refang_pairs(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(PAIRS)], "id int, text string")
    got = {r.id: (r.clean, r.was_modified) for r in R.refang(rows).collect()}
    for i, (dirty, clean) in enumerate(PAIRS):
        assert got[i] == (clean, dirty != clean), dirty


def test_refang_is_narrow(spark):
    """No shuffle between documents and observations, and one run of the chain."""
    docs = spark.createDataFrame([(1, "hxxp://a.ru")], "doc_id long, text string")
    plan = X.observations(X.extract(R.refang(docs)), ["doc_id"]).where("type = 'url'")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("posexplode(") == 1 and plan.count("h(?:[a-z*_-]{1,2}ps") == 1


def test_unknown_rule_is_refused(spark):
    with pytest.raises(ValueError):
        R.refang(spark.createDataFrame([("x",)], "text string"), skip=["nope"])


def extracted(spark, text, **options):
    docs = spark.createDataFrame([(1, text)], "doc_id long, clean string")
    return {r.value: r for r in X.observations(X.extract(docs, **options), ["doc_id"]).collect()}


def test_filters(spark):
    found = extracted(
        spark,
        "10.0.0.1 192.0.2.7 8.8.8.8 999.1.1.1 45.1.2.3 www.google.com evil.ru report.pdf http://bad.top/p x@y.org "
        "https://github.com/a/b http://www.microsoft.com/x bad.top",
    )
    assert {"192.0.2.7", "45.1.2.3", "evil.ru", "http://bad.top/p", "x@y.org", "https://github.com/a/b"} <= set(found)
    for gone in ("10.0.0.1", "8.8.8.8", "999.1.1.1", "www.google.com", "report.pdf", "http://www.microsoft.com/x", "bad.top"):
        assert gone not in found
    assert "10.0.0.1" in extracted(spark, "10.0.0.1", include_private=True)


def test_scores(spark):
    found = extracted(spark, "malware c2 exploit at http://evil.ru/payload.exe " + "x" * 200 + " " + "0" * 32)
    assert round(found["http://evil.ru/payload.exe"].confidence, 4) == 1.0
    assert round(found["0" * 32].confidence, 4) == 0.35


def test_first_match_decides(spark):
    text = "evil.ru " + "y" * 300 + " malware evil.ru"
    assert round(extracted(spark, text)["evil.ru"].confidence, 4) == 0.7  # the first place has no boost


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["1.2.3.4", "evil.ru", "malware", "z" * 150, "a@b.cc", "CVE-2024-1234", " ", "9.9.9.9", "c2"]), max_size=40))
def test_contexts_match_slicing(spark, words):
    """The window built from gaps equals the slice of the text around the match."""
    text = " ".join(words)
    docs = spark.createDataFrame([(1, text)], "doc_id long, clean string")
    for kind in ("ip", "domain"):
        got = docs.select(F.expr(X._matches("clean", kind)).alias("m")).first().m or []
        spans = [m.span() for m in re.finditer(C.INDICATOR_PATTERNS[kind], text)]
        assert [r.context for r in got] == [text[max(0, a - 100) : b + 100].lower() for a, b in spans]


def test_positions(spark):
    text = "x 1.2.3.4 and 5.6.7.8"
    docs = spark.createDataFrame([(1, text)], "doc_id long, clean string")
    for r in X.extract_positions(docs, "ip", ["doc_id"]).collect():
        assert text[r.start : r.end] == r.value
