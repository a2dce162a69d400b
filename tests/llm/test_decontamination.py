import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import decontamination as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    of = {}
    for i, text in items:
        w = words(text)
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if n else ():
            of.setdefault(tuple(w[s : s + n]), set()).add("" if i is None else str(i))
    out = []
    for i, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for n in {len(x) for x in of}:
            for s in range(len(w) - n + 1):
                found = of.get(tuple(w[s : s + n]))
                if found:
                    hit |= set(range(s, s + n))
                    ids |= found
        out.append((str(i), len(w), sorted(hit), sorted(ids)))
    return sorted(out)


def found(docs, items, **more):
    rows = d.contamination(docs, items, **more).collect()
    return sorted((str(r.doc_id), r.n_words, [k for s in r.spans for k in range(s.start, s.end)], list(r.item_ids)) for r in rows)


def test_against_brute_force(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    items += [(None, "a Null id, of the sort that tables have, every now and then here"), (7, items[3][1]), (900, "one-word"), (901, "Zwölf"), (902, None), (903, "!? ..."), (904, ""), (905, "of the"), (906, items[2][1] + " " + items[2][1])]
    plain = items[5][1]
    docs += [(-1, None), (-2, ""), (-3, " .,!"), (-4, plain), (-4, plain), (None, "x " + plain.upper() + " y"), (-5, " ".join(plain.split()[:9])), (-6, " ".join(plain.split()[:10])), (-7, "zwölf ZWÖLF one word"), (-8, items[-9][1].replace(" ", "-"))]
    docs += [(-9, ("the\n" * 30 + plain + "." + plain) * 3), (-10, "of\x00THE　of the")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("uid", F.lit(0)).withColumn("windows", F.lit(0)).withColumn("len", F.lit(0)).repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1)).withColumn("len", F.lit(""))
    got = found(df, bench)
    assert got == brute(docs, items)
    assert sum(bool(x[2]) for x in got) > 8
    assert found(df, bench, gram=3) == got and found(df, bench, gram=10) == got


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string"), spark.createDataFrame([(1, "some words")], "item_id bigint, text string")
    assert found(docs.limit(0), items) == [] and found(docs, items.limit(0)) == [("1", 2, [], [])]
    assert found(docs, items) == [("1", 2, [0, 1], ["1"])]


def test_query_digests(spark, data):
    rows = d.query(spark, data).collect()
    clean = [r for r in rows if not r.contaminated]
    assert clean and all(r.n_hit == r.n_items == 0 and r.items_sha256 == hashlib.sha256(b"").hexdigest() for r in clean)
    assert all(r.n_hit >= 10 and r.n_items for r in rows if r.contaminated)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aB zé-\n9日\x00@[`{"), max_size=40)), max_size=6))
def test_words(texts):
    hashes, offsets = d.word_hashes(pa.array(texts, pa.string()))
    want = [words(x) for x in texts]
    assert np.diff(offsets).tolist() == [len(x) for x in want]
    flat = [w for x in want for w in x]
    assert len({(w, h) for w, h in zip(flat, hashes.tolist())}) == len(set(flat)) == len(set(hashes.tolist()))


def test_long_texts_in_parts(monkeypatch):
    text = "one two, three " * 1000 + "x" * 9000 + " end"
    whole, _ = d.word_hashes(pa.array([text]))
    monkeypatch.setattr(d, "PART", 100)
    parts, offsets = d.word_hashes(pa.array([text]))
    assert (whole == parts).all() and offsets.tolist() == [0, 3002]
    bits = np.full(1024, 255, np.uint8)
    many = d._hits(whole, offsets, [2, 10], 5, bits).to_pylist()[0]
    monkeypatch.setattr(d, "PART", 1 << 20)
    assert {(x["gram"], x["len"], s["window"], s["start"]) for x in many for s in x["spans"]} == {(x["gram"], x["len"], s["window"], s["start"]) for x in d._hits(whole, offsets, [2, 10], 5, bits).to_pylist()[0] for s in x["spans"]} | set()


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 10), st.integers(2, 6))
def test_every_shared_span_has_a_common_fingerprint(seed, length, gram):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 2**63, 7).astype(np.uint64)
    span = pool[rng.integers(0, 7, length)]
    one, two = (np.concatenate([pool[rng.integers(0, 7, rng.integers(0, 20))], span, pool[rng.integers(0, 7, rng.integers(0, 20))]]) for _ in "ab")
    prints = [set(d.fingerprints(x, np.zeros(len(x), np.int64), length, gram)[1].tolist()) for x in (one, two)]
    assert prints[0] & prints[1]
