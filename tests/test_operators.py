import re

import pytest
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions import identifiers as I
from lodestone.functions import text as T
from lodestone.functions.unicode import folded
from lodestone.operators import evaluation, extract, graph, ranking, search, sections, tender


def one(spark, c, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if not isinstance(v, int) else 'int'}" for k, v in cols.items()))
    return df.select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("", 0.0), (None, 0.0), ("aaaa aaaa aaaa", 0.3), ("plain words of usual length", 1.0), ("x" * 50, 0.18)])
def test_quality(spark, text, want):
    assert one(spark, T.quality("t"), t=text) == want


def test_scalars(spark):
    assert one(spark, T.number_and_unit("t")[0], t="1.2.3 mm") is None
    assert one(spark, T.number_and_unit("t")[1], t="12.5 mm") == "mm"
    assert one(spark, T.canonical_unit("t"), t=" ohm ") == "Ω"
    assert one(spark, T.token_estimate("t"), t="") == 1
    assert one(spark, T.normalised("t"), t=" a  b\r\n\n\n\n c ") == "a b\n\nc"
    assert one(spark, folded(F.col("t")), t="ﬁne ²") == "fine 2"
    assert one(spark, T.page_of("t"), t="on page 12") == 12


def test_query_identifiers_need_a_year(spark):
    # four digits after the number are mandatory, and words that end in "is" count
    for q, want in (("IS 1448", []), ("IS 12633", ["IS 12633"]), ("IS 1448 Part 97", []), ("this 99999", ["is 99999"])):
        assert one(spark, search.query_ids("t"), t=q) == want


def test_identifiers(spark):
    assert one(spark, I.normalised(I.parsed("t")), t="see IS 1448 (Part 97) : 2026 there") == "IS 1448 (Part 97):2026"
    assert one(spark, I.shown("t"), t="IS_1448_Part_97_2026") == "IS 1448 (Part 97):2026"
    assert one(spark, I.standard_id("t"), t="IS 1448 (Part 97):2026") == "IS_1448_Part_97_2026"


def test_bm25_by_hand(spark):
    import math

    chunks = spark.createDataFrame([("a", "steel pipe"), ("b", "steel steel valve"), ("c", "pump")], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "valve"), (2, ""), (3, "steel")], "query_id int, query string")
    got = {(r.query_id, r.chunk_id): r.score for r in search.bm25(q, chunks).collect()}
    idf = math.log(3 - 1 + 0.5) - math.log(1.5)
    assert got[1, "b"] == pytest.approx(idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / 2)), abs=1e-6)
    assert not [k for k in got if k[0] == 2]
    # "steel" is in more than half the chunks: its idf is a quarter of the mean
    raw = [math.log(1.5) - math.log(2.5)] + 3 * [idf]
    assert got[3, "a"] == pytest.approx(0.25 * sum(raw) / 4 * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 2)), abs=1e-6)


def test_fields_are_searched(spark):
    chunks = spark.createDataFrame([("a", "steel pipe", "IS_10", "Scope"), ("b", None, "IS_1448_2", None), ("c", "pump", None, "General")], "chunk_id string, text string, standard_id string, section string")
    got = {(r.chunk_id, r.term) for r in search.postings(chunks).collect()}
    assert got == {("a", "steel"), ("a", "pipe"), ("a", "is_10"), ("a", "scope"), ("b", "is_1448_2"), ("c", "pump"), ("c", "general")}
    q = spark.createDataFrame([(1, "is_1448_2")], "query_id int, query string")
    assert [r.chunk_id for r in search.lexical(q, chunks).collect()] == ["b"]


def test_pruned_search_is_exact(spark, tmp_path):
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(3)
    names = [f"w{int(rnd.paretovariate(0.6)) % 900}" for _ in range(40_000)]
    rows = [(f"c{i:04}", " ".join(rnd.choice(names) for _ in range(rnd.choice([0, 3, 20, 60]))), f"STD{i % 9}", "Scope") for i in range(1500)]
    rows += [("same1", rows[5][1], "STD5", "Scope"), ("same2", rows[5][1], "STD5", "Scope"), ("none", None, None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, standard_id string, section string")
    asked = [(i, rows[i * 7][1]) for i in range(60)] + [(100, "w1 w1 w1 w2"), (101, "nothing here"), (102, ""), (103, None), (104, "scope"), (105, "std5 w333")]
    q = spark.createDataFrame(asked, "query_id int, query string")
    index = search.written(chunks, str(tmp_path / "index"))
    for k in (1, 5, 20):
        whole = search.top(search.bm25(q, index).where("score > 0"), k)
        got = search.lexical(q, index, k)
        row = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())
        assert row(got) == row(whole) == row(search.lexical(q, chunks, k))
    # of queries with a rare term most chunks that share a common one are never scored
    common = spark.createDataFrame([(i, f"w{500 + i} w{700 + i} scope std5 w1") for i in range(40)], "query_id int, query string")
    pairs, every = search.candidates(common, index, 5)[1].count(), search.bm25(common, index).count()
    assert pairs < every / 4
    assert index.blocks.agg(F.max("n")).first()[0] <= 2 * search.SEGMENT


def test_min_max_of_equal_scores(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0)], "query_id int, chunk_id string, score double")
    assert {r.norm for r in search.min_max(df).collect()} == {0.5}


def test_fusion_of_one_sided_hits(spark):
    s = "query_id int, chunk_id string, score double, rank int"
    sem = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.1, 2)], s)
    lex = spark.createDataFrame([(1, "b", 5.0, 1), (1, "c", 1.0, 2)], s)
    got = {r.chunk_id: (r.score, r.sources) for r in search.fused(search.merged(sem, lex)).collect()}
    assert got == {"a": (0.425, "semantic"), "b": (0.3, "semantic+lexical"), "c": (0.0, "lexical")}


def test_abstention(spark):
    ranks = spark.createDataFrame([(1, "s", 0.7, 3, 1), (2, "s", 0.236, 1, 1), (3, "s", 0.458, 2, 1)], "query_id int, standard string, score double, chunks int, rank int")
    q = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id int")
    got = {r.query_id: (r.decision, r.confidence) for r in ranking.decided(ranks, q).collect()}
    assert got == {1: ("RECOMMEND", "HIGH"), 2: ("ABSTAIN", "INSUFFICIENT_EVIDENCE"), 3: ("RECOMMEND", "MEDIUM"), 4: ("ABSTAIN", "INSUFFICIENT_EVIDENCE")}


def test_sections(spark):
    page = "1 Scope\n\nSome text here.\n2 Requirements\n2.1 General\n2.1.1 Details\n2.1 General\nAnnex A (informative)\nReferences"
    p = spark.createDataFrame([("d", 1, page)], "doc_id string, page int, text string")
    got = {r.title: (r.number, r.level, r.parent_title) for r in sections.sections(sections.headings(sections.lines(p))).collect()}
    assert got["Details"] == ("2.1.1", 3, "General") and got["General"] == ("2.1", 2, "Requirements") and got["Scope"][1:] == (1, None)
    assert got["References"][0] is None and len([k for k in got if k == "General"]) == 1


def test_packing(spark):
    parts = F.split("t", r"\|")
    assert one(spark, sections.packed(parts, 3), t="a b|c|d e f g h|i") == ["a b\n\nc", "d e f g h", "i"]
    assert one(spark, sections.packed(F.array().cast("array<string>"), 3), t="") == []


def test_values(spark):
    p = spark.createDataFrame([("d", 1, "The tube length shall be 161.925 ± 0.254 mm at 20 °C. Range 30 - 50 mm width ok.")], "doc_id string, page int, text string")
    got = extract.nearest_property(extract.values(extract.clauses(p))).orderBy("clause_no", "value_no").collect()
    assert [(r.number, r.unit, r.property) for r in got] == [("161.925", "mm", "tube length"), ("20", "°C", "tube length"), ("30 - 50", "mm", "width")]
    assert (got[2].nominal, got[2].maximum) == (30.0, 50.0)


def test_references(spark):
    p = spark.createDataFrame([("d", 1, "IS 10:2001 and IS 99, IS 456, ASTM D 1655, ISO 9001"), ("d", 2, "is 456")], "doc_id string, page int, text string")
    got = {(r.target, r.page) for r in extract.references(p).collect()}
    assert got == {("IS 10:2001", 1), ("IS 456", 1), ("ASTM D 1655", 1), ("ISO 9001", 1)}


def test_metrics_bounds(spark):
    runs = spark.createDataFrame([("m", 1, f"D-{i}", i) for i in range(1, 4)], "model string, query_id int, doc_id string, rank int")
    rel = spark.createDataFrame([(1, "d_2"), (1, "d_9")], "query_id int, doc_id string")
    r = evaluation.per_query(evaluation.judged(runs, rel), rel).first()
    assert (r.p5, r.r5, r.mrr, r.fp5) == (0.2, 0.5, 0.5, 0.4)


def test_new_edges_once(spark):
    s = "source string, target string, type string, confidence double"
    refs = spark.createDataFrame([("a", "b", "x", 0.5), ("a", "b", "y", 0.9), ("a", "c", "x", 0.1)], s)
    old = spark.createDataFrame([("a", "c", "x", 0.1)], s)
    assert [tuple(r) for r in graph.new_edges(refs, old).collect()] == [("a", "b", "y", 0.9)]


def test_tender_edges(spark):
    x = spark.createDataFrame([("t1", None), ("t2", ""), ("t3", "5 mm 5 cm 5 kg, IS 456:2000. may")], "tender_id string, text string")
    r = tender.requirements(x)
    gaps = {(g.tender_id, g.parameter) for g in tender.gaps(r).collect()}
    assert ("t1", "material") in gaps and ("t3", "unit_consistency") in gaps and ("t3", "standard_references") not in gaps
    scores = {s.tender_id: s.score for s in tender.scores(r, tender.issues(r)).collect()}
    assert scores["t1"] == scores["t2"] == 100 - 45 - 15 - 5 - 1


def test_config():
    c = config.DEFAULT
    assert c.semantic_weight + c.lexical_weight + c.metadata_weight == pytest.approx(1)


def test_tender_values_keep_their_form(spark):
    from lodestone.operators import tender

    texts = ["two centrifugal pumps", "SS304 body", "Water  storage\ntank", "SS  316 plate", "nothing of the kind", None, "500L and 500 L, Brass; 20 °C"]
    x = spark.createDataFrame(list(enumerate(texts)), "tender_id int, text string")
    got = {r.tender_id: r for r in tender.requirements(x).collect()}
    assert [got[i].product for i in range(7)] == ["pump", None, "Water  storage\ntank", None, None, None, None]
    assert [got[i].material for i in range(7)] == [None, "SS304", None, "SS  316", None, None, "Brass"]
    assert got[6].capacity == "500L" and got[6].dimensions == ["500L", "500 L", "20 °C"]


def test_evidence_over_pages(spark):
    from lodestone.operators import tender

    pages = [("a", 2, "a pump, then pipe, valve and cable"), ("a", 1, "x" * 200 + " steel\nplate as per IS 10:2001 and IS 10:2001"), ("b", 1, None), ("c", 1, "5 mm " * 9 + "IS 10:2001")]
    x = spark.createDataFrame(pages, "tender_id string, page int, text string")
    got = {r.tender_id: r for r in tender.page_requirements(x).collect()}
    a = got["a"]
    assert a.product == "steel" and [(e.page, e.value) for e in a.product_evidence] == [(1, "steel"), (2, "pump"), (2, "pipe")]
    assert a.product_evidence[0].source_text == "x" * 119 + " steel plate as per IS 10:2001 and IS 10:2001"
    assert [(e.page, e.value) for e in a.references] == [(1, "IS 10:2001")] and a.material is None
    assert got["b"].product is None and got["b"].dimensions == [] and len(got["c"].dimensions) == 8


def test_trace_evidence(spark):
    from lodestone.operators import tender

    reqs = tender.requirements(spark.createDataFrame([(1, "steel pipe, 5 mm, inspection and testing")], "tender_id int, text string"))
    specs = [(1, 0, "s0", "Diameter", "90", "STD1", "Dimensions", 3, "mm", None), (1, 1, "s1", "Wall", "5.2", "STD1", "Dimensions", 4, "mm", "y" * 300), (1, 2, "s2", "Inspection", "", "STD2", None, None, None, "")]
    s = spark.createDataFrame(specs, "tender_id int, spec_ord int, spec_id string, property string, value string, standard_id string, section string, page int, unit string, evidence string")
    got = {r.value: r for r in tender.best_match(tender.traceable(reqs), s).collect()}
    assert (got["5 mm"].spec_id, got["5 mm"].clause, got["5 mm"].evidence_page, got["5 mm"].evidence_text, got["5 mm"].status) == ("s1", "Dimensions", 4, "y" * 200, "partially_supported")
    assert (got["inspection"].spec_id, got["inspection"].evidence_text, got["inspection"].score) == ("s2", "Inspection:  ", 3)
    assert got["steel"].status == "not_found" and got["steel"].evidence_text is None


def test_pages_are_dealt_out_before_they_are_searched(spark):
    """A table that lies in one piece is searched in many; what is found isn't shuffled again for its tender (F19, F39)."""
    pages = spark.createDataFrame([(f"T{i // 2}", i % 2 + 1, "brass pump 5 mm, IS 10:2001; PVC pump 5 L") for i in range(40)], "tender_id string, page int, text string").coalesce(1)
    for made, key in ((tender.page_hits(pages), r"tender_id#\d+, page"), (tender.page_requirements(pages), r"tender_id")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(rf"Generate explode(.|\n)*RepartitionByExpression \[{key}", plan)  # below it in the plan
    assert tender.page_hits(pages).where("kind = 'product'").select("hit_no", "start", "value").distinct().orderBy("hit_no").collect() == [(0, 6, "pump"), (1, 33, "pump")]


def test_places_of_texts_that_have_the_mark(spark):
    df = spark.createDataFrame([("a1\x01bb22 \x01c333",), ("a1bb22",), ("no",), ("",), (None,), ("\U0001f600 7",)], "t string")
    found = [[tuple(m) for m in r[0]] for r in df.select(T.places("t", "[0-9]+")).collect()]
    assert found == [[("1", 1, 2), ("22", 5, 7), ("333", 10, 13)], [("1", 1, 2), ("22", 4, 6)], [], [], [], [("7", 2, 3)]]


def test_gaps_are_found_once_for_their_evidence(spark):
    """Requirements are searched in one piece a tender and not again for the evidence (F41); a standard without a name takes a place, but is none."""
    reqs = tender.requirements(spark.createDataFrame([("a", "brass pump"), ("b", "steel")], "tender_id string, text string"))
    rows = [("a", 1, None, "Capacity", "1", "L"), ("a", 2, "S1", "Testing", "2", ""), ("a", 3, "S2", "Capacity", "5", "L"), ("a", 4, "S3", "Safety", "x", "")]
    specs = spark.createDataFrame(rows, "tender_id string, spec_ord int, standard_id string, property string, value string, unit string")
    out = tender.gap_evidence(tender.gaps(reqs), specs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.count("RepartitionByExpression [tender_id") == 1
    told = {(r["tender_id"], r["parameter"]): r["evidence"] for r in out.where("severity = 'critical'").collect()}
    assert told["a", "capacity"] == "IS S2 — Capacity: 5 L" and told["a", "testing"] == "IS S1 — Testing: 2 "
    assert told["a", "safety"] is None and told["b", "capacity"] is None


def test_workspace_references_by_the_shorter_list(spark):
    """A standard with many references isn't paired with all of them in a workspace that has few targets (F44); results are those of all pairs."""
    traces = spark.createDataFrame([("w", "r", "hub"), ("v", "q", "a")], "workspace_id string, requirement_id string, standard_id string")
    items = spark.createDataFrame([("w", "t7"), ("w", "a"), ("v", "b"), ("v", "c"), ("v", "t1"), ("v", None)], "workspace_id string, standard_id string")
    edges = spark.createDataFrame([("hub", f"t{i}", "cites") for i in range(500)] + [("a", "b", "cites"), ("a", "b", "old"), ("a", "c", "cites"), ("a", "x", "cites")], "source string, target string, type string")
    out = graph.workspace_graph(traces, items, edges)
    assert "n_out" in out._jdf.queryExecution().optimizedPlan().toString()
    found = sorted(tuple(r) for r in out.where("type <> 'traceable_to'").collect())
    assert found == [("v", "a", "b", "cites"), ("v", "a", "b", "old"), ("v", "a", "c", "cites"), ("w", "hub", "t7", "cites")]


def test_isolated_rows_are_handed_on_in_slices(spark):
    """Results of a batch aren't held together (F43)."""
    import pyarrow as pa

    from lodestone.operators import isolation

    class Rows:
        schema = spark.createDataFrame([], "doc_id int, x string").schema

        def mapInArrow(self, run, schema):
            return run

    def work(x):
        return [int(x)]

    run = isolation.isolated(Rows(), "x", work, "array<int>")
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int32()), pa.array(["no" if i == 300 else str(i) for i in range(600)])], names=["doc_id", "x"])
    made = list(run(iter([batch])))
    assert max(b.num_rows for b in made) <= 256
    rows = [r for b in made for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(600)) and rows[300]["error"] == "ValueError" and rows[300]["out"] is None
    assert all(r["out"] == [r["doc_id"]] and r["error"] is None for r in rows if r["doc_id"] != 300)


def test_a_clause_is_searched_for_its_material_once(spark):
    """Not again for each of its values (F38)."""
    found = spark.createDataFrame([("d", 1, 0, "brass load 5 mm at 20 degrees and 00000000000000000000007 mm")], "doc_id string, page int, clause_no int, clause string")
    out = extract.values(found)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Aluminium")  # below it in the plan
    assert [(r["nominal"], r["material"], r["value_no"]) for r in out.collect()] == [(5.0, "brass", 0), (20.0, "brass", 1)]


def test_ranking_sends_no_chunk_text(spark):
    hits = spark.createDataFrame([(1, "D_P1", 0.9), (1, "D_P2", 0.8), (2, "D_P1", 0.7)], "query_id bigint, chunk_id string, score double")
    chunks = spark.createDataFrame([("D_P1", "S1", "Scope", "Stainless Steels of BRASS"), ("D_P2", "S1", None, "pipes"), ("D_P3", "S1", "Brass", None)], "chunk_id string, standard_id string, section string, text string")
    standards = spark.createDataFrame([("S1", "Brass pipes", "IS 1:2000", 2001)], "standard_id string, title string, normalized_identifier string, edition_year int")
    queries = spark.createDataFrame([(1, "Brass rods"), (2, "rods")], "query_id bigint, query string")
    assert {r.chunk_id: r.named for r in ranking.named(chunks).collect()} == {"D_P1": ["steel", "stainless", "brass"], "D_P2": [], "D_P3": ["brass"]}
    whole, short = ranking.ranked(hits.join(chunks, "chunk_id"), standards, queries), ranking.ranked(hits.join(ranking.named(chunks), "chunk_id"), standards, queries)
    assert sorted(whole.collect()) == sorted(short.collect())
    assert {r.query_id: r.material for r in short.collect()} == {1: 0.7, 2: 0.0}
