"""Inputs of the third review that its fixes came back for: odd characters beside names."""
from collections import Counter

from pyspark.sql import functions as F

from beaconry.operators import extract as X
from beaconry.operators import refang as R
from beaconry.plans import catalog_graph as CG


def test_domain_edges_beyond_ascii(spark):
    texts = [
        "zz.jyr׫", "׫aa.example", "a.evil.top—", "é-b.evil.top", "-c.evil.top", "x -d.evil.top y",
        "e-.f.top.", "g..h.top", "_i.evil.top", "\U0001f600j.evil.top", "k.evil.top\U0001f600", "l.evil.top_ (m.evil.top)", "n--o.p-q.top9 r.st",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, clean string")
    found = {}
    for r in X.extract_positions(docs, "domain", ["doc_id"]).collect():
        found.setdefault(r.doc_id, []).append((r.value, r.start))
    import duckdb

    from beaconry.plans import oracle_text as O

    con = duckdb.connect()
    con.execute("create table cleaned (doc_id int, clean varchar)")
    con.executemany("insert into cleaned values (?, ?)", list(enumerate(texts)))
    want = {}
    for doc, value, start in con.execute(f"select doc_id, value, start from ({O.raw_matches('domain', 'doc_id')}) order by doc_id, start").fetchall():
        want.setdefault(doc, []).append((value, start))
    assert found == want and 0 not in found and found[3] == [("-b.evil.top", 1)]


def test_bridged_families_of_one_and_two(spark, tmp_path):
    # the ids end after one document of a family, leave a gap, and go on with two, one and one
    ids = [*range(61), *range(76, 90), 95, 96, *range(102, 128)]
    spark.createDataFrame([(i,) for i in ids], "doc_id bigint").write.parquet(f"{tmp_path}/documents.parquet")
    sizes = Counter(i // 6 for i in ids)
    want = {(f"d{min(i for i in ids if i // 6 == f):012d}", n) for f, n in sizes.items()}
    assert {1, 2, 6} <= set(sizes.values())
    got = {(r["first"], r.members) for r in CG.communities_bridged(spark, str(tmp_path)).collect()}
    assert got == want


def test_prose_is_set_aside_and_put_back(spark):
    words = "plain words of prose, and more of them. They go on and\non for a while"
    marks = [
        "x", "evil[.]top", "spaced . evil . top", "eve AT evil.top", "ops [at] evil.top", "bad DOT cc", "broken\n.evil.top", "<b>", "[t](http://", ")",
        "CVE 2022 12345", "hxxp://a.ru", "http://cut.ru\n", "45 . 77 . 1 . 2", "ª", "&ordf;", "été où", "aHR0cDovL2I2NC1ob3N0LnJ1L2EuZXhl", "`q.w`", "Antidisestablishmentarian", "1234567890",
    ]
    texts = [f"{a} {words} {b} {words} {c}" for a in marks for b in marks for c in ("", words)] + [f"{a}{words}{a}" for a in marks]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8)
    got = {r.id: r.clean for r in R.refang(rows).collect()}
    # rules one after the other, each as a job of its own: no prose is set aside there
    kept = rows.withColumn("clean", F.col("text"))
    kept = R.refang(kept, "clean", "clean", skip=R.CHAIN.keys() | {"punycode"})
    for some in (["base64_runs", "markdown", "split_lines"], ["brackets", "dots", "slashes"], ["at_signs", "url_schemes", "ip_encodings"], ["cve_forms", "punycode"]):
        kept = R.only(kept, *some, text="clean").localCheckpoint()
    want = {r.id: r.clean for r in kept.collect()}
    assert got == want
    apart = rows.select(F.expr(R.beside_prose("text", lambda t: f"string(length({t}))")).alias("n"), F.length("text").alias("of"))
    assert apart.where("try_cast(n as int) < of - 40").count() > len(texts) // 2  # most texts are rewritten without their prose


def test_urls_beside_decoded_bytes(spark, tmp_path):
    """Addresses, and their places behind other decoded names, where white space, digits and letters are not ASCII."""
    import base64

    import duckdb

    from beaconry.plans import catalog_text as CT

    decoded = [
        "http://a.b/c\x85", "http://a.b/c\x13-\xa0", "x.top AT y", "q . w.ru http://z.b/", "é1234567890 x.top", "٣12345678 x.top", "x.topAT y",
        "éAT x.top", "é0x2d4d0a0b x.top", "http://a.b/c\x0bd", "x.top é0055.0115.012.013", "DOTé x.top", "CVE 2022 12345 x.top", "http://a.b\x0b\n.top/x",
    ]
    docs = [(12 * i + 4, "run " + base64.b64encode(t.encode()).decode(), "s") for i, t in enumerate(decoded)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run, sql = CT.QUERIES["extract_url"]
    got = sorted((r.doc_id, r.value, r.start, r.end) for r in run(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f'select doc_id, value, start, "end" from ({sql}) order by all').fetchall()
    assert got == want and len(got) > 4 * len(docs)
