"""Queries on sections and chunks with the usual vocabulary and sizes, on provenance, evidence, standards, workspaces and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import config
from lodestone.operators import analysis, extract, graph, ingest, isolation, search, sections, standards, tender, views
from lodestone.plans.analytics import FIRST, GAPS, MATCH, REQ, SP, STATUS, _reqs, _specs
from lodestone.plans.fixtures import table as t
from lodestone.plans.texts import FREQUENCY, SCORED

QUERIES, SQL = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


@query("""SELECT doc_id, page, ocr_pages, (ocr_pages > 0.3 * pages OR chars < 500) AS ocr_required FROM (SELECT row_id // 4 AS doc_id, 1 AS page, count(*) AS pages, sum(length(trim(x))) AS chars, count(*) FILTER (length(trim(x)) <= 30 AND images > 0) AS ocr_pages
FROM (SELECT row_id, images, CASE WHEN row_id % 3 = 1 THEN substring(text, 1, 25) ELSE text END AS x FROM page_rows) GROUP BY 1)""")
def src_07_document_gate(s, d):
    p = t(s, d, "page_rows").select(F.floor(F.col("row_id") / 4).alias("doc_id"), "images", F.when(F.col("row_id") % 3 == 1, F.substring("text", 1, 25)).otherwise(F.col("text")).alias("text"))
    return ingest.document_gate(ingest.page_gate(p)).select("doc_id", F.lit(1).alias("page"), "ocr_pages", "ocr_required")


@query("""SELECT standard_id, line_no, number, x AS title FROM (SELECT standard_id, 0 AS line_no, '1' AS number, 'Scope' AS x FROM standards UNION ALL SELECT standard_id, 1, NULL, 'Foreword' FROM standards
UNION ALL SELECT standard_id, 2, (edition_year % 9 + 1) || '.' || (edition_year % 5), title FROM standards UNION ALL SELECT standard_id, 3, 'Annex B', '(informative)' FROM standards)""")
def sec_02_headings(s, d):
    page = F.concat_ws("\n", F.lit("1 Scope"), F.lit("Foreword"), F.concat(F.col("edition_year") % 9 + 1, F.lit("."), F.col("edition_year") % 5, F.lit(" "), "title"), F.lit("Annex B (informative)"), F.lit("3 This heading is far too long to be taken for one"), F.lit("4 Ends with a stop."), F.lit("a plain line of text"))
    p = t(s, d, "standards").select(F.col("standard_id").alias("doc_id"), F.lit(1).alias("page"), page.alias("text"))
    return sections.headings(sections.lines(p)).select(F.col("doc_id").alias("standard_id"), "line_no", "number", "title")


ESTIMATE = "greatest(1, CAST(floor(len(list_filter(string_split_regex({}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) * 1.3) AS INT))"
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
# the packing of a page, a unit a step: what was gathered so far, and what the step gave out
PACKS = f"""c0 AS (SELECT row_id, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '') AS a,
  list_filter(list_transform(string_split(regexp_replace(text, '([.。])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda x: trim(x)), lambda x: x <> '') AS b FROM page_rows),
c1 AS (SELECT row_id, unnest(CASE WHEN len(a) <= 1 AND length(text) > 800 THEN b ELSE a END) AS p, generate_subscripts(CASE WHEN len(a) <= 1 AND length(text) > 800 THEN b ELSE a END, 1) AS pi FROM c0),
c2 AS (SELECT row_id, pi, p, {ESTIMATE.format('p')} > 700 AS long FROM c1),
c3 AS (SELECT row_id, pi, 0 AS si, p AS u, 0 AS kind FROM c2 WHERE NOT long UNION ALL SELECT row_id, pi, 0, '', 2 FROM c2 WHERE long
  UNION ALL SELECT row_id, pi, generate_subscripts(string_split(regexp_replace(p, '([.])\\s+', '\\1' || chr(31), 'g'), chr(31)), 1), unnest(string_split(regexp_replace(p, '([.])\\s+', '\\1' || chr(31), 'g'), chr(31))), 1 FROM c2 WHERE long),
c4 AS (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY pi, si) AS i, u, kind, {ESTIMATE.format('u')} AS tok FROM c3),
c5(row_id, i, buf, sum, out_text, out_tok, out_kind) AS (SELECT DISTINCT row_id, 0::BIGINT, '', 0, NULL::VARCHAR, NULL::INT, NULL::INT FROM c4
  UNION ALL SELECT row_id, i + 1, CASE WHEN cut THEN '' WHEN full_ THEN own WHEN kind = 2 THEN buf ELSE buf || own END, CASE WHEN cut THEN 0 WHEN full_ THEN tok WHEN kind = 2 THEN sum ELSE sum + tok END,
    CASE WHEN cut OR full_ THEN st END, CASE WHEN cut OR full_ THEN sum END, CASE WHEN cut OR full_ THEN (kind = 1)::INT END
  FROM (SELECT c5.row_id, c5.i, buf, sum, c4.kind, c4.tok, {STRIP.format('buf')} AS st, c4.u || CASE WHEN c4.kind = 1 THEN ' ' ELSE chr(10) || chr(10) END AS own,
    c4.kind = 2 AND length({STRIP.format('buf')}) >= 40 AS cut, c4.kind <> 2 AND sum + c4.tok > 500 AND {STRIP.format('buf')} <> '' AS full_ FROM c5 JOIN c4 ON c4.row_id = c5.row_id AND c4.i = c5.i + 1)),
c6 AS (SELECT row_id, i, out_text AS text, out_tok AS tok, out_kind AS kind FROM c5 WHERE out_text IS NOT NULL
  UNION ALL SELECT row_id, i + 1, {STRIP.format('buf')}, sum, 2 FROM (SELECT row_id, max_by(buf, i) AS buf, max_by(sum, i) AS sum, max(i) AS i FROM c5 GROUP BY row_id) WHERE {STRIP.format('buf')} <> ''),
pk AS (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY i) - 1 AS pos, text, tok, kind FROM c6)"""


@query(f"WITH RECURSIVE {PACKS} SELECT row_id, pos, sha256(text) AS sha, tok, kind FROM pk")
def chk_02_packs(s, d):
    x = t(s, d, "page_rows").select("row_id", F.posexplode(sections.packs(sections.paragraphs("text"))).alias("pos", "c"))
    return x.select("row_id", F.col("pos").cast("bigint").alias("pos"), F.sha2("c.text", 256).alias("sha"), "c.tok", "c.kind")


NORMAL = "regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(replace({}, chr(160), ' '), '\\r', '', 'g'), '[ \\t]+', ' ', 'g'), chr(10)), lambda l: trim(l)), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
CHUNKED = f"""{PACKS}, k1 AS (SELECT 'd' || (row_id // 10) AS doc_id, (row_id % 10 + 1)::INT AS page, CASE WHEN row_id % 3 = 0 THEN 'Test methods' ELSE 'General' END AS section, pos, {NORMAL.format('text')} AS text, tok, kind FROM pk),
k2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) AS seq FROM k1 WHERE kind <> 2 OR length(text) >= 40),
k3 AS (SELECT doc_id, page, doc_id || printf('_P%03d_C%03d', page, seq) AS chunk_id, text, tok AS tokens, CASE WHEN kind <> 1 AND section = 'Test methods' THEN 'requirements' ELSE 'general' END AS chunk_type FROM k2 WHERE length(text) BETWEEN 40 AND 6000 AND tok >= 10)"""


@query(f"WITH RECURSIVE {CHUNKED} SELECT chunk_id, page, sha256(text) AS sha, tokens, chunk_type FROM k3")
def chk_03_chunk_rows(s, d):
    p = t(s, d, "page_rows").withColumn("section", F.when(F.col("row_id") % 3 == 0, "Test methods").otherwise("General"))
    p = p.select(F.concat(F.lit("d"), F.floor(F.col("row_id") / 10).cast("string")).alias("doc_id"), (F.col("row_id") % 10 + 1).cast("int").alias("page"), "text", "section")
    return sections.chunks(p).select("chunk_id", "page", F.sha2("text", 256).alias("sha"), "tokens", "chunk_type")


@query("SELECT DISTINCT spec_id, standard_id, page, 0 AS value_no, 'at ' || page || ' degrees' AS condition, nullif(material, '') AS material FROM specs UNION SELECT DISTINCT spec_id, standard_id, page, 1, 'at ' || page || ' degrees', nullif(material, '') FROM specs")
def spx_05_condition(s, d):
    x = t(s, d, "specs")
    c = x.select(F.concat_ws("|", "spec_id", "standard_id").alias("doc_id"), "page", F.lit(0).alias("clause_no"), F.concat_ws(" ", F.lit("Load of"), "material", "value", F.lit("mm at"), F.col("page").cast("string"), F.lit("degrees")).alias("clause"))
    v = extract.values(c)
    part = lambda k: F.get(F.split("doc_id", r"\|"), k)
    return v.select(part(0).alias("spec_id"), part(1).alias("standard_id"), "page", "value_no", "condition", "material").distinct()


@query("""SELECT tender_id AS doc_id, 'IS 77777 (Part 3) (Sec 2):2019' AS target, CASE WHEN text LIKE '%Safety%' THEN 'safety_reference' ELSE 'test_method_reference' END AS relationship, 0.85::DOUBLE AS confidence FROM tenders
UNION ALL SELECT tender_id, regexp_extract(text, 'IS [0-9]+:[0-9]{4}', 0), 'allied', 0.85 FROM tenders UNION ALL SELECT tender_id, 'ISO 9001:2015', 'normative_reference', 0.75 FROM tenders""")
def ref_03_in_context(s, d):
    more = F.when(F.col("text").contains("Safety"), " by IS 77777 (Part 3) (Sec 2) : 2019 and ISO 9001:2015").otherwise(" test procedure of IS 77777 (Part 3) (Sec 2) : 2019 and ISO 9001:2015")
    p = t(s, d, "tenders").select(F.col("tender_id").alias("doc_id"), F.lit(7).alias("page"), F.concat("text", more).alias("text"))
    return extract.references(p).select("doc_id", "target", "relationship", F.col("confidence").cast("double").alias("confidence"))


MARKED = "'Marking of ' || tender_id || repeat(' and so on', 12) || '. Packaging' || repeat(' or other', 12) || '. Sampling of goods'"
CUT = "trim(substring(x, greatest(strpos(x, '{w}') - 81, 0) + 1, strpos(x, '{w}') - 1 + least(length('{w}') + 60, length(x) - strpos(x, '{w}') + 1) + 200 - greatest(strpos(x, '{w}') - 81, 0)))"


@query(f"WITH m AS (SELECT tender_id, {MARKED} AS x FROM tenders) " + " UNION ALL ".join(f"SELECT tender_id AS doc_id, '{w.lower()}_requirements' AS type, {CUT.format(w=w)} AS value FROM m" for w in ("Marking", "Packaging", "Sampling")))
def cmp_03_close_marks(s, d):
    x = F.concat(F.lit("Marking of "), "tender_id", F.repeat(F.lit(" and so on"), F.lit(12)), F.lit(". Packaging"), F.repeat(F.lit(" or other"), F.lit(12)), F.lit(". Sampling of goods"))
    p = t(s, d, "tenders").select(F.col("tender_id").alias("doc_id"), F.lit(4).alias("page"), x.alias("text"))
    return extract.compliance(p).select("doc_id", "type", "value")


NEAR = "trim(substring(text, greatest({s} - 120, 0) + 1, {s} + length(v) + 120 - greatest({s} - 120, 0)))"


@query(f"""WITH h AS (SELECT tender_id, text, regexp_extract(text, 'capacity ([0-9]+ L)', 1) AS v, strpos(text, 'capacity ') + 8 AS s, 0 AS hit_no FROM tenders UNION ALL SELECT tender_id, text, regexp_extract(text, 'length ([0-9]+ mm)', 1), strpos(text, 'length ') + 6, 1 FROM tenders)
SELECT tender_id AS doc_id, 1 AS page, hit_no, v AS value, substring({NEAR.format(s='s')}, 1, 400) AS source_text FROM h""")
def tnd_01_provenance(s, d):
    p = t(s, d, "tenders").select(F.col("tender_id").alias("doc_id"), F.lit(1).alias("page"), "text")
    return tender.provenance(p, config.DIMENSION)


THREE = "t3 AS (SELECT * FROM sp JOIN (SELECT tender_id, standard_id FROM (SELECT tender_id, standard_id, row_number() OVER (PARTITION BY tender_id ORDER BY min(spec_ord), standard_id) AS place FROM sp GROUP BY tender_id, standard_id) WHERE place <= 3) USING (tender_id, standard_id))"
GAPPED = """gp AS (SELECT tender_id, unnest([CASE WHEN material IS NULL THEN 'material' END, CASE WHEN application IS NULL THEN 'application' END, CASE WHEN len(testing) = 0 THEN 'testing' END, CASE WHEN len(safety) = 0 THEN 'safety' END, 'certification']) AS parameter FROM rq)"""


@query(f"""WITH {REQ}, {SP}, {THREE}, {GAPPED}, e AS (SELECT tender_id, parameter, min_by('IS ' || standard_id || ' — ' || property || ': ' || value || ' ' || unit, spec_ord) AS evidence FROM gp JOIN t3 USING (tender_id) WHERE contains(lower(property), parameter) OR contains(parameter, lower(property)) GROUP BY ALL)
SELECT tender_id, parameter, evidence FROM gp LEFT JOIN e USING (tender_id, parameter) WHERE parameter IS NOT NULL""")
def gap_04_evidence(s, d):
    g = tender.gaps(_reqs(s, d)).where("severity = 'critical'")
    return tender.gap_evidence(g, _specs(s, d)).select("tender_id", "parameter", "evidence")


COMPARED = f"""b AS (SELECT *, dimensions[1] AS td, nullif(array_to_string(testing, ', '), '') AS tt, CASE WHEN tst THEN 'specified' END AS ss FROM rq LEFT JOIN fs USING (tender_id)),
cp AS (SELECT tender_id, 'material' AS requirement, material AS tender, sm AS standard, {STATUS.format(t='material', s='sm', e='contains(material, sm) OR contains(sm, material)')} AS status FROM b
UNION ALL SELECT tender_id, 'capacity', capacity, sc, {STATUS.format(t='capacity', s='sc', e="abs(split_part(capacity, ' ', 1)::DOUBLE - sc::DOUBLE) < 1e-6")} FROM b
UNION ALL SELECT tender_id, 'dimensions', td, sd, {STATUS.format(t='td', s='sd', e="coalesce(abs(split_part(td, ' ', 1)::DOUBLE - sd::DOUBLE) <= try_cast(st AS DOUBLE), false)")} FROM b
UNION ALL SELECT tender_id, 'testing', tt, ss, {STATUS.format(t='tt', s='ss', e='tst')} FROM b)"""


@query(f"WITH {MATCH}, {FIRST}, {COMPARED} SELECT bm.tender_id, ord, name, value, CASE cp.status WHEN 'MATCH' THEN 'supported' WHEN 'MISMATCH' THEN 'conflict' WHEN 'TENDER_NOT_SPECIFIED' THEN 'review_required' ELSE bm.status END AS status FROM bm LEFT JOIN cp ON cp.tender_id = bm.tender_id AND cp.requirement = lower(name)")
def trc_04_override(s, d):
    r, sp = _reqs(s, d), _specs(s, d)
    x = tender.overridden(tender.best_match(tender.traceable(r), sp), analysis.comparison(r, sp))
    return x.select("tender_id", F.col("ord").cast("bigint").alias("ord"), "name", "value", "status")


@query(f"WITH {REQ}, {SP}, {FIRST}, {COMPARED} SELECT tender_id, requirement AS parameter, tender AS tender_value, standard AS standard_value, 'high' AS severity FROM cp WHERE status = 'MISMATCH'")
def cnf_05_matrix(s, d):
    return analysis.matrix_conflicts(analysis.comparison(_reqs(s, d), _specs(s, d))).drop("type")


@query(f"WITH {REQ}, {SP}, five AS (SELECT tender_id, standard_id FROM (SELECT tender_id, standard_id, row_number() OVER (PARTITION BY tender_id ORDER BY min(spec_ord), standard_id) AS place FROM sp GROUP BY tender_id, standard_id) WHERE place <= 5) SELECT sp.tender_id, spec_ord, standard_id FROM sp JOIN five USING (tender_id, standard_id)")
def cnf_01_first_five(s, d):
    return analysis.first_standards(_specs(s, d), 5).select("tender_id", "spec_ord", "standard_id")


@query("""WITH x AS (SELECT DISTINCT standard_id, page, 'P' || page AS section_id FROM specs), y AS (SELECT *, max((confidence >= 0.6)::INT) OVER (PARTITION BY standard_id) AS has_some FROM (SELECT DISTINCT standard_id, spec_id, page, confidence FROM specs)),
a AS (SELECT standard_id, string_agg(section_id, ',' ORDER BY page, section_id) AS sections FROM (SELECT *, row_number() OVER (PARTITION BY standard_id ORDER BY page, section_id) AS n FROM x) WHERE n <= 30 GROUP BY 1),
b AS (SELECT standard_id, string_agg(spec_id, ',' ORDER BY page, spec_id) AS specs FROM (SELECT *, row_number() OVER (PARTITION BY standard_id ORDER BY page, spec_id) AS n FROM y WHERE confidence >= 0.6 OR has_some = 0) WHERE n <= 20 GROUP BY 1)
SELECT standard_id, sections, specs FROM standards LEFT JOIN a USING (standard_id) LEFT JOIN b USING (standard_id)""")
def std_01_whole(s, d):
    sp = t(s, d, "specs")
    x = standards.detail(t(s, d, "standards"), sp.select("standard_id", "page", F.concat(F.lit("P"), "page").alias("section_id")).distinct(), sp.select("standard_id", "spec_id", "page", "confidence").distinct())
    return x.select("standard_id", F.array_join(F.transform("sections", lambda v: v["section_id"]), ",").alias("sections"), F.array_join(F.transform("specs", lambda v: v["spec_id"]), ",").alias("specs"))


@query("SELECT spec_id, standard_id, page, CASE WHEN page % 3 = 0 THEN 0 ELSE 2 END AS n_headers, CASE WHEN page % 3 = 0 THEN 0 ELSE least(20, page * 5) END AS n_rows, CASE WHEN page % 3 = 0 THEN NULL ELSE value END AS cell FROM specs")
def std_02_tables(s, d):
    row = F.concat(F.lit('["'), "value", F.lit('","'), "unit", F.lit('"]'))
    rows = F.when(F.col("page") % 3 == 0, "not json").otherwise(F.concat(F.lit("["), F.array_join(F.array_repeat(row, F.col("page") * 5), ","), F.lit("]")))
    h, r = standards.cells(F.lit('["Value","Unit"]'), rows)
    return t(s, d, "specs").select("spec_id", "standard_id", "page", F.size(h).alias("n_headers"), F.size(r).alias("n_rows"), F.get(F.get(r, 0), 0).alias("cell"))


TEN = "standards chunks tables figures_confirmed figures_total references specifications documents workspaces relationships".split()


@query("""SELECT name, n FROM (SELECT 'standards' AS name, count(*) AS n FROM standards UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'tables', count(*) FROM specs WHERE property = 'Capacity' UNION ALL SELECT 'figures_confirmed', count(*) FROM figures WHERE caption
UNION ALL SELECT 'figures_total', count(*) FROM figures UNION ALL SELECT 'references', count(*) FROM edges UNION ALL SELECT 'specifications', count(*) FROM specs UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'workspaces', count(*) FROM customer UNION ALL SELECT 'relationships', count(*) FROM old_edges)""")
def std_03_ten_counts(s, d):
    f, sp = t(s, d, "figures"), t(s, d, "specs")
    frames = [t(s, d, "standards"), t(s, d, "chunks"), sp.where("property = 'Capacity'"), f.where("caption"), f, t(s, d, "edges"), sp, t(s, d, "documents"), t(s, d, "customer"), t(s, d, "old_edges")]
    return standards.counts(dict(zip(TEN, frames)))


@query("SELECT 'healthy' AS status, (SELECT count(*) FROM standards) AS corpus, (SELECT count(*) FROM chunks) AS chunks, 'loaded' AS semantic_index, 'loaded' AS lexical_index")
def std_04_health(s, d):
    c = t(s, d, "chunks")
    return standards.health(t(s, d, "standards"), c, t(s, d, "vectors"), search.postings(c))


@query("SELECT chunk_id, standard_id, page FROM chunks WHERE standard_id IN (SELECT standard_id FROM standards WHERE starts_with(normalized_identifier, 'IS 1'))")
def src_11_by_number(s, d):
    return standards.by_key(t(s, d, "chunks"), "standard_id", t(s, d, "standards").where("startswith(normalized_identifier, 'IS 1')")).select("chunk_id", "standard_id", "page")


@query("SELECT chunk_id, len(vector) AS dim FROM vectors")
def ret_05_dimensions(s, d):
    return standards.checked_vectors(t(s, d, "vectors"), 64).select("chunk_id", F.size("vector").cast("bigint").alias("dim"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN 'index built by ' || p_brand WHEN p_size <> 64 THEN 'index has dimension ' || p_size END AS problem FROM part")
def ret_15_model(s, d):
    x = t(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "model-a").otherwise(F.col("p_brand")).alias("model"), F.col("p_size").alias("dim"))
    return standards.same_model(x, "model-a", 64).select("p_partkey", "problem")


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'FAILED' WHEN doc_id % 3 = 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, nullif(concat_ws('; ', CASE WHEN doc_id % 7 = 0 THEN 'document_failed:' || source END, CASE WHEN doc_id % 5 = 0 THEN 'figure_failed:' || source END, CASE WHEN doc_id % 3 = 0 THEN 'section_failed:' || source END), '') AS warnings FROM documents""")
def inc_05_outcomes(s, d):
    x = t(s, d, "documents").select("doc_id", F.col("source").alias("message"))
    stages = [F.when(F.col("doc_id") % k == 0, F.lit(name)) for k, name in ((7, "document"), (5, "figure"), (3, "section"))]
    failures = x.select("doc_id", "message", F.explode(F.array_compact(F.array(*stages))).alias("stage"))
    return ingest.outcomes(x, failures)


FAULTS = """fd AS (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN 'document_failed:JSONDecodeError' WHEN doc_id % 11 = 0 THEN 'document_failed:ValueError' END AS fatal,
 CASE WHEN doc_id % 3 = 0 THEN 'section_failed:JSONDecodeError' END AS section, CASE WHEN doc_id % 5 = 0 THEN 'table_failed:JSONDecodeError' END AS tab FROM documents)"""


@query(f"""WITH {FAULTS} SELECT doc_id, CASE WHEN fatal IS NOT NULL THEN 'FAILED' WHEN section IS NOT NULL THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, CASE WHEN fatal IS NOT NULL THEN fatal ELSE nullif(concat_ws('; ', section, tab), '') END AS warnings FROM fd""")
def inc_05_isolated(s, d):
    return isolation.read_documents(t(s, d, "raw_documents"))["outcomes"]


@query(f"""WITH {FAULTS} SELECT doc_id, 'page' AS part, 1 AS page, sha256(replace(replace(text, chr(92), ''), '"', '')) AS sha FROM fd WHERE fatal IS NULL UNION ALL SELECT doc_id, 'page', 2, NULL FROM fd WHERE fatal IS NULL
UNION ALL SELECT doc_id, 'section', 1, sha256('1 Scope') FROM fd WHERE fatal IS NULL AND section IS NULL UNION ALL SELECT doc_id, 'table', 1, sha256('1 2 3') FROM fd WHERE fatal IS NULL""")
def inc_05_what_remains(s, d):
    x = isolation.read_documents(t(s, d, "raw_documents"))
    pages = x["pages"].select("doc_id", F.lit("page").alias("part"), "page", F.sha2("text", 256).alias("sha"))
    parts = x["sections"].select("doc_id", F.lit("section").alias("part"), "page", F.sha2(F.concat_ws(" ", "level", "title"), 256).alias("sha"))
    cells = x["tables"].select("doc_id", F.lit("table").alias("part"), "page", F.sha2(F.array_join(F.flatten("cells"), " "), 256).alias("sha"))
    return pages.unionByName(parts).unionByName(cells)


@query("SELECT sha, min(path) AS path, count(*) AS n FROM files GROUP BY sha")
def inc_02_firsts(s, d):
    return ingest.firsts(t(s, d, "files"))


@query("SELECT 'WS_' || substring(sha256(c_custkey::VARCHAR), 1, 12) AS workspace_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Procurement ' || substring('WS_' || substring(sha256(c_custkey::VARCHAR), 1, 12), 1, 8) END AS name, 'active' AS status FROM customer")
def wsp_01_created(s, d):
    x = t(s, d, "customer").select(F.col("c_custkey").alias("request_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"), F.lit(None).cast("string").alias("description"), F.col("c_custkey").alias("created_at"))
    return graph.created(x).select("workspace_id", "name", "status")


@query("SELECT concat('W', c_custkey) AS workspace_id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'closed' ELSE 'active' END AS status FROM customer ORDER BY c_custkey DESC")
def wsp_01_updated(s, d):
    c = t(s, d, "customer")
    ws = c.select(F.concat(F.lit("W"), "c_custkey").alias("workspace_id"), F.col("c_name").alias("name"), F.lit("none").alias("description"), F.lit("active").alias("status"))
    new = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("W"), "c_custkey").alias("workspace_id"), F.col("c_mktsegment").alias("name"), F.lit(None).cast("string").alias("description"), F.lit("closed").alias("status"))
    return graph.updated(ws, new).select("workspace_id", "name", "status")


@query(f"WITH {REQ} SELECT tender_id FROM rq WHERE contains(lower(concat_ws('|', product, material, application, capacity, text)), 'brass')")
def ui_02_requirements(s, d):
    return views.requirements_with(_reqs(s, d), "brass").select("tender_id")


@query("SELECT spec_id, section, page, card FROM (SELECT spec_id, property AS section, page, property || ': ' || value || ' ' || unit AS card FROM specs) WHERE contains(lower(card), '7') OR contains(lower(section), '7') OR contains(page::VARCHAR, '7')")
def ui_03_evidence_cards(s, d):
    return views.evidence_cards(t(s, d, "specs"), "7")


# pictures wide enough for slices of a scan
WIDE = SCORED.replace(FREQUENCY, FREQUENCY.replace("SELECT *,", "SELECT * REPLACE (width * 1.5::DOUBLE AS width),"))


@query(f"WITH {WIDE} SELECT figure_id, standard_id, strip, rejected, score FROM e")
def fig_06_slices(s, d):
    f = t(s, d, "figures").withColumn("width", F.col("width") * 1.5)
    f = extract.duplicate_frequency(f, f.select("doc_id").distinct().withColumn("n_pages", F.lit(700.0).cast("double")))
    strip = (F.col("width") > 0.85 * 595) & (F.col("height") < 0.15 * 842)
    return extract.scored_figures(f).select("figure_id", "standard_id", strip.alias("strip"), "rejected", "score")


@query(f"WITH {MATCH}, own AS (SELECT tender_id, score >= 2 AS ok FROM bm) SELECT tender_id, count(*) FILTER (ok) AS supported, count(*) FILTER (NOT ok) AS requires_input FROM own GROUP BY 1")
def ui_08_spec_split(s, d):
    p, sp = tender.traceable(_reqs(s, d)), _specs(s, d)
    x = analysis.specification(p, tender.best_match(p, sp), sp).where("status <> 'additional'")
    return views.split_counts(x, "tender_id", "status", ["supported", "requires_input"])


@query(f"WITH {REQ}, {GAPS} SELECT tender_id, count(*) FILTER (x LIKE '%|critical') AS critical, count(*) FILTER (x LIKE '%|important') AS important, 0::BIGINT AS info FROM g WHERE x IS NOT NULL GROUP BY 1")
def ui_08_gaps_by_tender(s, d):
    return views.split_counts(tender.gaps(_reqs(s, d)), "tender_id", "severity", ["critical", "important", "info"])


@query("""SELECT s.standard_id, title, edition_year, coalesce(a.n, 0) AS specifications, coalesce(b.n, 0) AS figures, coalesce(c.n, 0) AS chunks FROM standards s
LEFT JOIN (SELECT standard_id, count(*) AS n FROM specs GROUP BY 1) a USING (standard_id) LEFT JOIN (SELECT standard_id, count(*) AS n FROM figures GROUP BY 1) b USING (standard_id)
LEFT JOIN (SELECT standard_id, count(*) AS n FROM chunks GROUP BY 1) c USING (standard_id)""")
def src_15_manifest(s, d):
    docs = t(s, d, "standards").select("standard_id", "title", "edition_year")
    return ingest.manifest(docs, {"specifications": t(s, d, "specs"), "figures": t(s, d, "figures"), "chunks": t(s, d, "chunks")})
