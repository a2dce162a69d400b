import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate([None, "", "12 34", "A plain text about nothing much at all.", "token = '0123456789abcdef0123' and more words"])]
    rows += [(5, "Repeated row of words.", "en", "s", 1)] * 2 + [(None, "A text without an id here.", "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("uses", F.lit(1)).withColumn("spans", F.lit("x"))


def test_stages_on_odd_rows(spark, odd, data):
    for limit in (None, 0):
        docs = odd if limit is None else odd.limit(0)
        if limit is None:
            docs = docs.unionByName(spark.read.parquet(f"{data}/documents.parquet"), allowMissingColumns=True)
        for name, stage in c.STAGES:
            docs = c.staged(stage(spark, docs, data), f"test-{name}")
            assert name == "encoding" or docs.columns == list(c.COLUMNS)
        assert (docs.count() > 0) == (limit is None)


def test_run(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = c.near_duplicates(spark, docs, data)
    groups = {r.component_id for r in c.simhash.similar(docs).collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == groups
    clean = c.secret_scan(spark, docs, data).where("text RLIKE '[0-9a-f]{16}'")
    assert clean.count() == 0
    out = c.run(spark, data)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() >= len(groups) - 1


def test_rows_that_survive_near_duplicates(spark, data):
    a, b, z = "one plain text about rivers and hills and the old road", "another story of seven ships that left the harbour", "a third of machines, none of which was ever built here"
    rows = [(None, z, "en", "s", 1), (None, b, "en", "s", 1), (4, a, "en", "s", 1), (4, "x y z of quite other words in a row", "en", "s", 1), (3, "x y z of quite other words in a row", "en", "s", 1)]
    rows += [(9, b, "en", "s", 1), (7, "said twice by the same", "en", "s", 1), (7, "said twice by the same", "en", "s", 1), (8, "said twice in two places", "en", "s", 1), (8, "said twice in two places", "de", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted((r.doc_id or 0, r.text) for r in c.near_duplicates(spark, df, data).collect())
    assert got == [(0, z), (3, rows[4][1]), (4, a), (7, rows[6][1]), (8, rows[8][1]), (9, b)]


def test_survivors_of_odd_rows(spark, odd, data):
    kept = c.near_duplicates(spark, c.language(spark, odd, data), data)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 4), (False, 5), (True, 0)]


def test_no_labels(spark, odd, data):
    kept = c.language(spark, odd.withColumn("lang", F.lit(None).cast("string")), data)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.lang) for r in kept.collect()) == [(False, 3, "und"), (False, 4, "und"), (False, 5, "und"), (False, 5, "und"), (True, 0, "und")]


def test_mixing_of_equal_rows(spark, data):
    rows = [(i, f"words number {i} of the large one", "en", "large", 1) for i in range(400)] + [(None, "a b c", "en", "small", 1)] * 3 + [(None, "a b d", "en", "small", 1), (None, "", "en", "none", None), (1, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    n = {tuple(r)[:5]: r["count"] for r in c.mixing_stage(spark, df, data).groupBy(*c.COLUMNS).count().collect()}
    assert set(n) == set(rows) and all(n[r] == 1 for r in rows if r[3] != "small")
    assert 4 < n[rows[400]] + n[rows[403]] <= 8 and n[rows[400]] >= 3
    assert c.mixing_stage(spark, df.limit(0), data).count() == 0
