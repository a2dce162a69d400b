"""Queries against their SQL over small tables with what the given ones lack."""

import math

import duckdb
import numpy as np
import pytest
from conftest import duck_rows, rows
from pyspark.sql import functions as F

from lodestone.operators import evaluation, search, tiles
from lodestone.plans import registry


def same(spark, folder, name, **tables):
    """Whether a query over these tables gives what its SQL does, and its rows."""
    c = duckdb.connect()
    for t, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = rows(registry.QUERIES[name](spark, str(folder)))
    assert got == duck_rows(c, registry.SQL[name])
    return got[1]


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name", ["sec_02_classify", "sec_03_dedup", "sec_06_section_id", "sec_09_asof_section"])
def test_numbered_lines_and_annexes_are_no_known_headings(spark, tmp_path, name):
    texts = ["Title one.\n4325 Betz das mit Enheit\nTitle one.\ntext", "Annex B\n1.2 Scope of it\nno heading", "Other.\r\n12 Words", "Annex C here."]
    same(spark, tmp_path, name, documents=([(i, x, "en", "s", len(x)) for i, x in enumerate(texts)], DOCUMENTS))


def test_long_lines_are_packed_whole(spark, tmp_path):
    long = "Ein Satz von Worten. " * 200
    texts = [long, f"short\n{long}\nend", "a\n\nb " * 90]
    same(spark, tmp_path, "chk_02_pack", documents=([(i, x, "en", "s", len(x)) for i, x in enumerate(texts)], DOCUMENTS))


def test_tiled_search_is_exact_and_shuffles_no_pairs(spark, tmp_path):
    import random

    rnd = random.Random(5)
    names = [f"w{int(rnd.paretovariate(0.6)) % 900}" for _ in range(40_000)]
    made = [(f"c{i:04}", " ".join(rnd.choice(names) for _ in range(rnd.choice([0, 3, 20, 60]))), f"STD{i % 9}", "Scope") for i in range(1500)]
    made += [(f"same{i}", made[5][1], "STD5", "Scope") for i in range(40)] + [("none", None, None, None)]
    chunks = spark.createDataFrame(made, "chunk_id string, text string, standard_id string, section string").repartition(3)
    asked = [(i, made[i * 7][1]) for i in range(60)] + [(90, made[5][1]), (91, made[5][1]), (100, "w1 w1 w1 w2"), (101, "nothing here"), (102, ""), (103, None), (104, "scope"), (105, "std5 w333")]
    q = spark.createDataFrame(asked, "query_id int, query string")
    index = search.written(chunks, str(tmp_path / "index"), pruned=False)
    assert index.blocks is None
    told = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())
    for k, most in ((1, 1 << 30), (20, 1 << 30), (5, 20_000)):
        got = search.tiled(q, index, k, most=most)
        assert told(got) == told(search.top(search.bm25(q, index).where("score > 0"), k))
    assert told(search.lexical(q, index)) == told(search.lexical(q, chunks))
    plan = search.lexical(q, index)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate explode" not in plan


def test_vectors_in_tiles_are_summed_in_order(spark):
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(6)
    v = [(f"v{i:03}", [rnd.choice([-1.0, 0.1, 0.3, 7.7]) * rnd.random() for _ in range(8)]) for i in range(700)]
    v += [(f"same{i}", v[3][1]) for i in range(30)] + [("null", None), ("hole", [None] + [1.0] * 7), ("nan", [float("nan")] * 8), ("inf", [float("inf")] + [1.0] * 7), ("short", [1.0] * 3)]
    vectors = spark.createDataFrame(v, "chunk_id string, vector array<float>").repartition(3)
    asked = [(i, v[i][1]) for i in range(9)] + [(20, None), (21, [1.0] * 3), (22, [float("nan")] * 8), (23, [0.0] * 8)]
    q = spark.createDataFrame(asked, "query_id int, vector array<float>")
    pairs = vectors.crossJoin(q.where("vector IS NOT NULL").select("query_id", F.col("vector").alias("asked")))
    whole = search.top(pairs.select("query_id", "chunk_id", search.dot(F.col("vector"), F.col("asked")).alias("score")), 20)
    told = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, repr(r.score)) for r in df.collect())
    assert told(search.semantic(q, vectors)) == told(search.semantic(q, vectors, most=700)) == told(whole)
    assert search.semantic(q.where("false"), vectors).count() == 0


def test_relevance_by_class_lists_no_pairs(spark):
    labels = [(i, None if i % 11 == 0 else i % 4) for i in range(60)]
    e = spark.createDataFrame(labels, "doc_id bigint, label int")
    asked = e.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    runs = spark.createDataFrame([("m", q, d, r) for q in range(0, 60, 10) for r, d in enumerate(range(q // 3, q // 3 + 12), 1)] + [("m", 10, 999, 13)], "model string, query_id bigint, doc_id bigint, rank int")
    pairs = asked.join(e, "label").select("query_id", "doc_id")
    old = evaluation.judged(runs, pairs)
    new = evaluation.judged_by_class(runs, asked, e)
    told = lambda df: sorted(map(str, df.collect()))
    assert told(new.select(*old.columns)) == told(old)
    assert told(evaluation.per_query(new, evaluation.relevant_by_class(asked, e))) == told(evaluation.per_query(old, pairs))


def test_bonuses_send_on_what_follows_an_identifier_alone(spark):
    """Of a chunk's text what is before its first identifier isn't shuffled (F4, F9); the sums are those of the whole text."""
    chunks = spark.createDataFrame(
        [("a", "x" * 500 + " as per is 10:2001 and IS 7 (Part 2): 2015", None), ("b", "y" * 500, "IS 10:2001"), ("c", "this 5, Is\n10:2001", "S"), ("d", "z" * 500, "S"), ("e", None, None), ("f", "IS 99:1999 IS 10:2001", "")],
        "chunk_id string, text string, standard_id string",
    )
    queries = spark.createDataFrame([(1, "IS 10:2001 or IS 7 (Part 2): 2015"), (2, "Is\n10:2001 is 10:2001 IS 10:2001"), (3, "no identifier"), (4, None)], "query_id int, query string")
    found = queries.select("query_id").crossJoin(chunks.select("chunk_id"))
    got = {(r.query_id, r.chunk_id): r.metadata_bonus for r in search.bonuses(found, queries, chunks).collect() if r.metadata_bonus}
    whole = found.join(queries, "query_id").join(chunks, "chunk_id").select("query_id", "chunk_id", search.bonus(search.query_ids("query"), F.col("text"), F.col("standard_id")).alias("b"))
    assert got == {(r.query_id, r.chunk_id): r.b for r in whole.collect() if r.b} and got[1, "a"] == got[2, "b"] == 0.3 and got[2, "c"] == 0.15
    assert search.bonuses(found, queries, chunks.where("chunk_id = 'd'")).count() == 0


@pytest.mark.parametrize("of", [tiles.Terms, tiles.Vectors])
def test_a_worker_goes_on_with_what_its_first_task_has_found(tmp_path, of):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(4)
    words = [[f"{'ab'[i % 2]}{w}" for w in rng.zipf(1.3, 60) % 50] for i in range(400)]
    counts = [{w: x.count(w) for w in set(x)} for x in words]
    if of is tiles.Terms:
        asked = [[{"term": w, "weight": float(n) * (1 + len(w)), "df": 20} for w, n in c.items()] for c in counts[:40]]
        queries = pa.table({"query_id": pa.array(range(40)), "asked": pa.array(asked)})
        rows = pa.RecordBatch.from_pydict({"chunk_id": [f"C{i}" for i in range(400)], "length": pa.array([60] * 400, pa.int32()), "terms": [[{"term": w, "tf": n} for w, n in c.items()] for c in counts]})
        settings = (5, 400, 60.0, 1.5, 0.75)
        score = lambda q, r: math.floor(sum(a["weight"] * 2.5 * counts[r][a["term"]] / (counts[r][a["term"]] + 1.5) for a in asked[q] if a["term"] in counts[r]) * 1e6 + 0.5) / 1e6
    else:
        v = rng.integers(-9, 9, (400, 6)).astype(float)
        queries = pa.table({"query_id": pa.array(range(40)), "vector": pa.array(list(v[:40]))})
        rows = pa.RecordBatch.from_pydict({"chunk_id": [f"C{i}" for i in range(400)], "vector": pa.array(list(v))})
        settings = (5,)
        score = lambda q, r: float(v[q] @ v[r])
    pq.write_table(queries, tmp_path / "a.parquet")
    run = tiles.best(f"file://{tmp_path}", of, *settings)
    tasks = [[x for b in run(iter([part])) for x in b.to_pylist()] for part in (rows.slice(0, 300), rows.slice(300), rows.slice(0, 300))]
    assert len(tasks[0]) == 200 and len(tasks[1]) < 120 and len(tasks[2]) <= 200
    for q in range(40):
        whole = sorted((-score(q, r), f"C{r}") for r in range(400) if of is tiles.Vectors or score(q, r) > 0)[:5]
        for parts in (tasks[:2], tasks[1:]):
            got = sorted((-x["score"], x["chunk_id"]) for t in parts for x in t if x["query_id"] == q)[:5]
            assert [x[1] for x in got] == [x[1] for x in whole] and np.allclose([x[0] for x in got], [x[0] for x in whole], atol=1.5e-6)
