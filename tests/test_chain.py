import pytest
from pyspark.sql import functions as F

from lodestone.engine import STAGES, Engine
from lodestone.operators import isolation, search
from lodestone.plans.fixtures import table as t


@pytest.fixture(scope="module")
def calls(spark, data):
    return t(spark, data, "calls").limit(12)


def test_stages_are_fed_by_each_other(spark, data, calls, tmp_path):
    e = Engine(t(spark, data, "chunks"), t(spark, data, "standards"), None, None, t(spark, data, "specs"))
    r = e.run(calls.union(spark.createDataFrame([("blank", " \n"), ("null", None)], "tender_id string, text string")), str(tmp_path / "run"))
    assert [(x.stage, x.status) for x in r.stages.collect()] == [(s, "success") for s in STAGES]
    status = {x.tender_id: (x.status, x.error) for x in r.tenders.collect()}
    assert status["blank"] == status["null"] == ("error", "text required") and list(status.values()).count(("success", None)) == 11
    recs = {(x.tender_id, x.standard_id): x["rank"] for x in r.tables["ranking"].collect()}
    assert recs and max(recs.values()) <= 5
    assert {(x.tender_id, x.standard_id) for x in r.tables["evidence"].collect()} <= set(recs)
    traced = [x for x in r.tables["traceability"].collect() if x.standard_id]
    assert traced and {(x.tender_id, x.standard_id) for x in traced} <= set(recs) and all(x.evidence_text and x.evidence_page for x in traced)


def test_a_broken_stage_leaves_the_others(spark, data, calls, tmp_path):
    e = Engine(t(spark, data, "chunks"), t(spark, data, "standards"), None, None, t(spark, data, "specs").drop("confidence"))
    r = e.run(calls, str(tmp_path / "partial"))
    got = {x.stage: x for x in r.stages.collect()}
    assert got["evidence"].status == "error" and "confidence" in got["evidence"].error
    assert all(x.status == "success" for s, x in got.items() if s != "evidence") and got["gaps"].rows > 0
    assert {x.status for x in r.tables["traceability"].collect()} == {"not_found"}
    assert {x.status for x in r.tenders.collect() if x.tender_id != "T0"} == {"partial"}


def test_a_row_that_raises_while_a_stage_runs(spark, data, calls, tmp_path):
    broken = t(spark, data, "chunks").withColumn("page", F.when(F.col("text") != "", F.raise_error(F.lit("no such page")).cast("int")))
    r = Engine(broken, t(spark, data, "standards"), None, None, t(spark, data, "specs")).run(calls, str(tmp_path / "raised"))
    got = {x.stage: x.status for x in r.stages.collect()}
    assert got["understand"] == got["gaps"] == got["quality"] == got["version_check"] == "success" and "error" in (got["ranking"], got["evidence"])


def test_without_understanding_nothing_goes_on(spark, data, tmp_path):
    calls = spark.createDataFrame([("a", "text")], "tender_id string, text string").withColumn("text", F.when(F.col("text") != "", F.raise_error(F.lit("unreadable")).cast("string")))
    r = Engine(t(spark, data, "chunks"), t(spark, data, "standards")).run(calls, str(tmp_path / "error"))
    assert [(x.stage, x.status) for x in r.stages.collect()] == [("understand", "error")]


def test_search_without_vectors(spark, data):
    e = Engine(t(spark, data, "chunks"), t(spark, data, "standards"))
    q = spark.createDataFrame([("q", "brass parts as per IS 10:2001"), ("none", "zzqx")], "query_id string, query string")
    got = e.recommended(q).collect()
    assert got and {x.tender_id for x in got} == {"q"} and len(got) <= 5
    assert search.none(q).count() == 0


def test_broken_documents_stay_alone(spark):
    good = '{"pages": [{"page": 1, "text": "a", "outline": "[[1, \\"Scope\\"]]", "tables": ["[[1]]"]}]}'
    rows = [(1, good), (2, "{"), (3, None), (4, '{"pages": 5}'), (5, '{"pages": [{"page": 1, "text": 7}]}'), (6, '{"pages": [{"page": 1, "text": "b", "outline": "[[1]]"}]}'), (7, '{"pages": [{"page": 1, "text": "c", "tables": ["[[1]]", "x", null]}]}'), (8, '{"pages": []}'), (9, good)]
    x = isolation.read_documents(spark.createDataFrame(rows, "doc_id int, payload string").repartition(1))
    got = {r.doc_id: (r.status, r.warnings) for r in x["outcomes"].collect()}
    assert [got[i][0] for i in range(1, 10)] == ["SUCCESS", "FAILED", "FAILED", "FAILED", "FAILED", "PARTIAL", "SUCCESS", "SUCCESS", "SUCCESS"]
    assert got[2][1] == "document_failed:JSONDecodeError" and got[3][1] == "document_failed:TypeError" and got[7][1] == "table_failed:JSONDecodeError; table_failed:TypeError"
    assert sorted(r.doc_id for r in x["pages"].collect()) == [1, 6, 7, 9] and sorted(r.doc_id for r in x["tables"].collect()) == [1, 7, 9]
    assert x["failures"].count() == 7 and x["sections"].count() == 2


def test_a_failed_save_changes_nothing(spark, tmp_path):
    from lodestone.sources.store import Store

    store = Store(spark, str(tmp_path / "store"))
    assert store.version() == 0 and store.names() == []
    rows = lambda *ids: spark.createDataFrame([(w, i) for w, i in ids], "workspace_id string, id int")
    told = lambda name: sorted((r.workspace_id, r.id) for r in store.read(name).collect())
    assert store.save({"a": rows(("x", 1), ("y", 2)), "b": rows(("x", 3))}) == 1
    held = store.read("a")
    bad = rows(("x", 9)).withColumn("id", F.raise_error(F.lit("midway")).cast("int"))
    with pytest.raises(Exception, match="midway"):
        store.replace({"a": rows(("x", 8)), "b": bad})
    assert store.version() == 1 and told("a") == [("x", 1), ("y", 2)] and told("b") == [("x", 3)]
    assert store.replace({"a": rows(("x", 7), ("x", 6)), "b": rows(("z", 5))}) == 2
    assert told("a") == [("x", 6), ("x", 7), ("y", 2)] and told("b") == [("x", 3), ("z", 5)]
    assert sorted(r.id for r in held.collect()) == [1, 2]
    store.save({"c": spark.createDataFrame([(1,)], "other int")})
    assert store.delete(rows(("x", 0), ("x", 0))) == 4
    assert told("a") == [("y", 2)] and told("b") == [("z", 5)] and store.read("c").count() == 1


def test_queries_of_one_wording_are_ranked_once(spark, data, monkeypatch):
    e = Engine(t(spark, data, "chunks"), t(spark, data, "standards"))
    brass, steel = "brass parts as per IS 10:2001", "steel tank"
    asked = lambda *rows: spark.createDataFrame(list(rows), "query_id string, query string")
    alone = {q: [(x["standard_id"], x["rank"], x["score"], x["evidence_chunks"]) for x in e.recommended(asked(("q", q))).orderBy("rank").collect()] for q in (brass, steel)}
    seen, lexical = [], search.lexical
    monkeypatch.setattr(search, "lexical", lambda q, *a, **k: (seen.append(q.count()), lexical(q, *a, **k))[1])
    got = e.recommended(asked(("a", brass), ("b", brass), ("c", steel), ("d", brass), ("e", None), ("f", None))).orderBy("tender_id", "rank").collect()
    assert seen == [3] and alone[brass]
    for name, q in (("a", brass), ("b", brass), ("c", steel), ("d", brass), ("e", None)):
        assert [(x["standard_id"], x["rank"], x["score"], x["evidence_chunks"]) for x in got if x.tender_id == name] == alone.get(q, [])


def test_pairs_of_parameters_and_clauses_are_not_sorted(spark):
    from lodestone.operators import tender

    params = spark.createDataFrame([("T", 0, "material", "brass", "Material"), ("T", 1, "capacity", "20 L", "Capacity"), ("T", 2, "safety", "hazard", "Safety: hazard"), ("U", 0, "product", "pump", "Product")], "tender_id string, ord int, name string, value string, label string")
    # two clauses with one place, two that say the same, one without a place
    rows = [("T", 5, "S5", "Capacity", "20", "b"), ("T", 3, "S3", "Capacity", "20", "a"), ("T", 3, "S2", "Capacity", "21", "c"), ("T", None, "S0", "Capacity", "20 l", "d"), ("T", 4, "S4", "Material", "brass", "e")]
    specs = spark.createDataFrame(rows, "tender_id string, spec_ord int, spec_id string, property string, value string, evidence string")
    best = tender.best_match(params, specs)
    got = {(x.tender_id, x.name): (x.score, x.spec_id, x.evidence_text, x.status) for x in best.collect()}
    assert got == {("T", "material"): (8, "S4", "e", "supported"), ("T", "capacity"): (12, "S3", "a", "supported"), ("T", "safety"): (0, None, None, "not_found"), ("U", "product"): (0, None, None, "not_found")}
    plan = best._jdf.queryExecution().sparkPlan().toString()
    assert any("HashAggregate(" in x and "SortAggregate" not in x and "score" in x for x in plan.split("\n"))


def test_rows_of_tenders_are_not_broadcast(spark, data, calls):
    from lodestone.operators import analysis, ranking, tender

    reqs, known = tender.requirements(calls), t(spark, data, "standards")
    specs = spark.createDataFrame([("T1", 1, "STD1", "S1", "Capacity", "20", 20.0, "L", "brass")], "tender_id string, spec_ord int, standard_id string, spec_id string, property string, value string, nominal double, unit string, material string")
    recs = spark.createDataFrame([("T1", "STD1", 1)], "tender_id string, standard_id string, rank int")
    params = tender.traceable(reqs)
    matches = tender.best_match(params, specs)
    built = (tender.query_text(reqs, tender.keywords(calls)), tender.gap_evidence(tender.gaps(reqs), specs), analysis.conflicts(reqs, specs, recs, known), tender.scores(reqs, tender.issues(reqs)), matches)
    built += (analysis.specification(params, matches, specs), ranking.newer_editions(tender.reference_rows(reqs), known))
    for df in built:
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
