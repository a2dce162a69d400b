import html
import json
import re

import numpy as np
import pytest

import brute_mix
from lodestone.llm import _graph, html_text, mixing, vectors

# -- components


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7), (200, 201)]
    got = {r.node: r.root for r in _graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert _graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- vectors


def test_vectors_sql(spark, data, duck):
    from conftest import duck_rows, rows

    assert rows(vectors.query(spark, data)) == duck_rows(duck, vectors.SQL)


def test_quantisation_bound():
    rng = np.random.default_rng(1)
    raw = rng.normal(size=(300, 40)) * 10 ** rng.uniform(-3, 3, (300, 1))
    q, scale, error = vectors.quantised(raw)
    x = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    approx = (q.astype(float) @ q.astype(float).T) * scale[:, None] * scale
    assert (np.abs(x @ x.T - approx) <= error[:, None] + (1 + error[:, None]) * error + 1e-12).all()


def test_vectors_odd(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK_BYTES", 1)  # chunks of 64
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    rows = [(i, [float(v) for v in base + 0.05 * rng.normal(size=8)], 1) for i in range(150)]
    rows += [(1000 + i, [float(v) for v in rng.normal(size=8)], 1) for i in range(150)]
    rows += [(5000, None, 1), (5001, [], 1), (5002, [0.0] * 8, 1), (5003, [1.0, None] * 4, 1), (5004, [float("nan")] * 8, 1), (5005, rows[0][1], None), (5006, rows[0][1], 2), (5007, rows[0][1][:4], 1), (5008, rows[0][1], 2), (5008, rows[0][1], 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "1 AS key", "2 AS chunk")
    got = {}
    for r in vectors.near_duplicates(df).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    x = np.array([r[1] for r in rows[:300]])
    cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    links = (cos >= 0.98).sum(axis=1) - 1
    assert all(got[rows[i][0]][0][0] == links[i] for i in range(300)) and links.max() > 5
    for v in (5000, 5001, 5002, 5003, 5004, 5005, 5007):
        assert got[v] == [(0, v, True)]
    assert got[5006] == [(2, 5006, True)] and got[5008] == [(2, 5006, False)] * 2
    assert vectors.near_duplicates(df.limit(0)).count() == 0


# -- HTML


def main_text(page):
    m = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    t = re.sub(r"<(p|h1|/p|/h1)>", "\n", m[1] if m else "")
    t = re.sub(r"<[^>]*>", " ", t)
    return "\n".join(y for y in (" ".join(html.unescape(z).split()) for z in t.split("\n")) if y)


def test_pages(spark, data):
    df = spark.read.parquet(f"{data}/pages.parquet")
    pages = {r.page_id: r.html for r in df.collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(df).collect()}
    assert got == {k: (main_text(v), len(main_text(v))) for k, v in pages.items()}


def test_furniture():
    page = """<body><header><h1>Site</h1></header><nav>menu</nav><div class="cookie-notice">ok?</div><main><h2>T&amp;T</h2><p>one<br>two  <b>three<p>four &lt;b&gt;
    <form><input name=x>search</form><aside>see also</aside><ul><li>a<li>b</ul><div id="comments"><p>nice!</p></div><script>if (a < b) "</p>"</script><style>p{}</style></main><footer>f</footer>"""
    _, labels, texts = html_text.blocks(page)
    assert [t for x, t in zip(labels, texts) if x.startswith("+")] == ["T&T", "one two three", "four <b>", "a", "b"]


def test_alignment():
    a = html_text.fold("ul li #x /li li #x /li /ul p #y /p".split())
    assert html_text.shown(a) == "ul ( li #x /li )+ /ul p #y /p"
    b = html_text.align(a, "ul li #x /li /ul div #z /div".split())
    assert html_text.shown(b) == "ul ( li #x /li )+ /ul ( p )? ( #y )? ( /p )? ( div )? ( #z )? ( /div )?"
    assert html_text.slots(b) == ["x", "y", "z"] and html_text.align(b, a) == html_text.align(b, b)


def test_template_text_is_left_out(spark):
    page = "<div><p>Welcome to our site</p><p>{0} body of page {0}</p></div>"
    rows = [(i, "http://h.example/x", page.format(i)) for i in range(5)] + [(9, "http://one.example/", page.format(9)), (10, None, None), (11, "", ""), (12, "http://h.example/x", "a < b & c")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'z' AS host", "1 AS labels")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert all(got[i] == f"{i} body of page {i}" or got[i].startswith("Welcome") for i in range(5)) and got[10] == got[11] == "" and got[12] == "a < b & c"
    assert html_text.extract(df.limit(0)).count() == 0


def test_template_slots_apart_from_content(spark):
    page = "<div><p>Welcome to our site</p>{}<p>All rights reserved</p></div>"
    rows = [(i, "http://h.example/x", page.format("".join(f"<p>{k} body of page {i}</p>" for k in range(1 + i % 3)))) for i in range(7)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got == {i: "\n".join(f"{k} body of page {i}" for k in range(1 + i % 3)) for i in range(7)}


def test_equal_text_of_few_pages_stays(spark):
    quote = "<blockquote><p>A quoted line.</p></blockquote>"
    rows = [(i, "http://h.example/x", f"<div><p>Head</p><h2>Page {i}</h2>{quote if i < 3 else ''}</div>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {i: f"Page {i}\nA quoted line." if i < 3 else f"Page {i}" for i in range(20)}


@pytest.mark.parametrize("around", ["div class='layout has-sidebar'", "div class=elementor-widget-container", "form action=x", "div class='sidebar wrap'", "div class=has-ads"])
def test_article_in_class_marked_container(around):
    _, labels, texts = html_text.blocks(f"<{around}><p>beside</p><article><p>body</p><div class=comments><article><p>nice!</p></article></div><aside><article>more</article></aside></article></{around.split()[0]}>")
    assert [t for x, t in zip(labels, texts) if x[:1] == "+"] == ["body"]
    _, labels, texts = html_text.blocks("<div class='related'><article>teaser</article><main>body</main></div><div hidden><main>unseen</main></div>")
    assert [t for x, t in zip(labels, texts) if x[:1] == "+"] == ["body"]


def test_wrappers_read_their_pages(spark, data):
    df = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html")
    parsed = df.mapInArrow(html_text._parse, html_text.PARSED.format(id="bigint"))
    of = {r.host: html_text.Reader(json.loads(r["shape"])) for r in html_text.wrappers(parsed.select("host", "shape")).collect()}
    for r in parsed.collect():
        stream = html_text.labelled(r.stream, r.labels)
        assert [of[r.host].ops[k] for k in of[r.host].match(stream)] == stream and all(html_text.Reader.places(of[r.host], stream))
    assert html_text.Reader(["p", ["?", ["#x"]], "/p"]).match(["p"]) is None


# -- mixing


def test_plan():
    tokens = {"hot": 9000, "a": 500, "b": 300, "c": 200, "none": 0}
    p = brute_mix.plan(tokens, target=0.9, most=100)
    assert abs(brute_mix.entropy(p.weights) - 0.9) < 1e-6 and abs(sum(p.weights.values()) - 1) < 1e-12 and "none" not in p.weights
    p = brute_mix.plan(tokens, target=0.9, most=1.5)
    assert abs(max(p.passes.values()) - 1.5) < 1e-6 and min(p.passes.values()) == pytest.approx(1)
    assert brute_mix.plan({"a": 5}).passes == {"a": 1.0} and brute_mix.plan({}).weights == {}


def test_schedule(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 4}", 10 + i % 7) for i in range(6000)] + [(7000, "hot", 0), (7001, "bare", 0), (7002, "hot", 11), (7002, "hot", 11), (None, "hot", 3)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    got = mixing.schedule(sized, target=0.99, most=1.7).collect()
    tokens = {}
    for _, s, n in rows:
        tokens[s] = tokens.get(s, 0) + n
    p = brute_mix.plan(tokens, 0.99, 1.7)
    assert sum(r["pass"] == 0 for r in got) == len(rows) and all(0 <= r.place < 1 for r in got)
    for s, times in p.passes.items():
        used = sorted((r.offset, r.tokens) for r in got if r.source == s and r.tokens)
        at = 0
        for offset, n in used:  # every source is one unbroken run of tokens up to its budget
            assert offset == at
            at += n
        assert times * tokens[s] <= at + 1e-6 < times * tokens[s] + 17
    assert mixing.schedule(sized.limit(0)).count() == 0


def test_same_schedule_however_dealt(spark):
    rows = [(i, f"s{i % 5 % 3}", 1 + i % 9) for i in range(2000)]
    a = mixing.schedule(spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint").repartition(3))
    b = mixing.schedule(spark.createDataFrame(rows[::-1], "doc_id bigint, source string, tokens bigint").repartition(5))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("target,most", [(0.9, 100), (0.9, 1.5), (0.99, 1.7), (0.2, 100), (1.0, 1.0)])
def test_exponent_against_brute_force(spark, target, most):
    for tokens in ({"hot": 9000, "a": 500, "b": 300, "c": 200, "none": 0}, {f"s{i}": 1 + 7 * i * i for i in range(40)}, {"a": 5}, {"a": 5, "b": 5}, {"none": 0}, {}):
        df = spark.createDataFrame(list(tokens.items()), "source string, tokens bigint")
        assert mixing.exponent(df, target, most) == pytest.approx(brute_mix.plan(tokens, target, most).exponent, abs=1e-8)


def test_schedule_against_brute_force(spark, monkeypatch):
    """A mix made by hand from the blocks: each source's blocks in the order of a pass, documents in the order of a block, until the budget ends."""
    monkeypatch.setattr(mixing, "COPIES", 100)
    rows = [(i, f"s{i % 7 % 4}", 1 + i % 5) for i in range(500)] + [(None, "s0", 3)] * 2500 + [(7, "s1", 2)] * 3
    got = mixing.schedule(spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint"), 0.97, 3.0).collect()
    tokens = {}
    for _, s, n in rows:
        tokens[s] = tokens.get(s, 0) + n
    p = brute_mix.plan(tokens, 0.97, 3.0)
    for s in tokens:
        mine = sorted((r for r in got if r.source == s), key=lambda r: (r["pass"], r.offset))
        each = {}
        for r in mine:
            each.setdefault(r["pass"], []).append((r.doc_id if r.doc_id is not None else -1, r.tokens))
        whole = sorted((d if d is not None else -1, n) for d, x, n in rows if x == s)
        at = 0
        for k in sorted(each):
            assert sorted(each[k]) == whole if k < max(each) else not set(each[k]) - set(whole)
            for _, n in each[k]:
                assert at < p.passes[s] * tokens[s] + 1e-6
                at += n
        assert at >= p.passes[s] * tokens[s] - 1e-6 and [r.offset for r in mine][0] == 0
    hot = {r.block for r in got if r.doc_id is None}
    assert len(hot) > 1


def test_sizes(spark):
    rows = [(1, "a\tb\n c", "s"), (2, None, None), (3, "", "s"), (None, " x\x0by\x0cz ", "s")]
    got = mixing.sizes(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).select("source", "tokens").collect()
    assert [tuple(r) for r in got] == [("s", 3), ("", 0), ("s", 0), ("s", 3)]


def test_wrappers_cover_all_pages(spark, data):
    df = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html")
    parsed = df.mapInArrow(html_text._parse, html_text.PARSED.format(id="bigint"))
    w = html_text.wrappers(parsed.select("host", "shape")).collect()
    assert sum(r.n for r in w) == df.count() and all(json.loads(r["shape"]) for r in w)


def test_one_sum_decides(monkeypatch):
    """Pairs right at the threshold link alike whether a strip is computed whole or pair by pair."""
    rng = np.random.default_rng(8)
    raw = np.round(rng.normal(0, 1, (1, 48)) + rng.normal(0, 0.15, (60, 48)), 2)
    q, scale, error = vectors.quantised(raw)
    chunk = {"raw": raw.tobytes(), "q": q.tobytes(), "scale": scale.tobytes(), "error": error.tobytes(), "counts": np.ones(60, np.int64).tobytes()}
    v, norm = vectors._scaled(raw)
    r, c = np.triu_indices(60, 1)
    cosines = vectors._cosines(v, norm, v, norm, r, c)
    for threshold in np.sort(cosines)[::97]:
        found = []
        for dense in (0.0, 1.0):
            monkeypatch.setattr(vectors, "DENSE", dense)
            found.append(vectors.tile(chunk, chunk, True, 48, float(threshold))[0].tolist())
        assert found[0] == found[1] and sum(found[0]) == 2 * int((cosines >= threshold).sum())
