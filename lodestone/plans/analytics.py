"""Queries on tenders, comparisons, graphs, workspaces, checks and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import config
from lodestone.operators import analysis, dq, graph, tender, views
from lodestone.plans.fixtures import table as t

QUERIES, SQL = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


# what the tender texts say, read off the fixture's own rules
REQ = """rq AS (SELECT tender_id, text,
 CASE WHEN text LIKE '%water storage tank%' THEN 'water storage tank' WHEN text LIKE '%pump%' THEN 'pump' WHEN text LIKE '%mild steel%' THEN 'steel' END AS product,
 CASE WHEN text LIKE '%mild steel%' THEN 'mild steel' WHEN text LIKE '%brass%' THEN 'brass' WHEN text LIKE '%HDPE%' THEN 'HDPE' WHEN text LIKE '%copper%' THEN 'copper' END AS material,
 CASE WHEN text LIKE '%storage tank%' AND text NOT LIKE '%drinking water%' THEN 'storage tank' WHEN text LIKE '%storage tank%' THEN 'storage tank' WHEN text LIKE '%drinking water%' THEN 'drinking water' END AS application,
 regexp_extract(text, 'capacity ([0-9]+) L', 1) || ' L' AS capacity, [regexp_extract(text, 'capacity ([0-9]+) L', 1) || ' L', regexp_extract(text, 'length ([0-9]+) mm', 1) || ' mm'] AS dimensions,
 CASE WHEN text LIKE '%Testing and inspection%' THEN ['testing', 'inspection'] WHEN text LIKE '%Test may%' THEN ['test'] ELSE [] END AS testing,
 CASE WHEN text LIKE '%Safety warning%' THEN ['safety', 'warning'] ELSE [] END AS safety, regexp_extract(text, 'IS [0-9]+:[0-9]{4}', 0) AS ref FROM tenders)"""


def _reqs(s, d):
    return tender.requirements(t(s, d, "tenders"))


@query(f"WITH {REQ} SELECT tender_id, product, material, application, capacity FROM rq")
def tnd_02_requirements(s, d):
    return _reqs(s, d).select("tender_id", "product", "material", "application", "capacity")


# each page's matches of each pattern, with their places told from what lies between them
_EACH = "SELECT tender_id, page, '{k}' AS kind, text, regexp_extract_all(text, '{p}') AS v, string_split_regex(text, '{p}') AS gaps FROM tender_pages"
PAGE_HITS = "ph0 AS (" + " UNION ALL ".join(_EACH.format(k=k, p=p) for k, p in config.HITS.items()) + """),
ph1 AS (SELECT tender_id, page, kind, text, v, gaps, unnest(generate_series(1, len(v))) AS k FROM ph0 WHERE len(v) > 0),
ph2 AS (SELECT tender_id, page, kind, k - 1 AS hit_no, text, v[k] AS value, (list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:k - 1], lambda x: length(x))), 0))::INT AS start FROM ph1),
ph AS (SELECT tender_id, page, kind, hit_no::INT AS hit_no, start, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS value, substring(replace(regexp_replace(substring(text, greatest(start - 120, 0) + 1, start + length(value) + 120 - greatest(start - 120, 0)), '^\\s+|\\s+$', '', 'g'), chr(10), ' '), 1, 400) AS source_text FROM ph2)"""


@query(f"WITH {PAGE_HITS} SELECT tender_id, page, kind, hit_no, start, value, source_text FROM ph")
def tnd_02_page_hits(s, d):
    return tender.page_hits(t(s, d, "tender_pages"))


_SINGLE = ("product", "material", "application", "capacity")
_TOLD = "string_agg(page || ' ' || value || ': ' || source_text, ' | ' ORDER BY page, hit_no) FILTER (kind = '{k}' AND n <= {n})"


@query(f"""WITH {PAGE_HITS}, rf AS (SELECT *, row_number() OVER (PARTITION BY tender_id, kind, CASE WHEN kind = 'reference' THEN value ELSE page || '/' || hit_no END ORDER BY page, hit_no) AS again FROM ph),
nn AS (SELECT *, row_number() OVER (PARTITION BY tender_id, kind ORDER BY page, hit_no) AS n FROM rf WHERE again = 1)
SELECT tender_id, {', '.join(f"any_value(value) FILTER (kind = '{k}' AND n = 1) AS {k}, coalesce({_TOLD.format(k=k, n=3)}, '') AS {k}_evidence" for k in _SINGLE)},
coalesce({_TOLD.format(k='dimension', n=8)}, '') AS dimensions, coalesce({_TOLD.format(k='reference', n=1000000)}, '') AS refs FROM (SELECT DISTINCT tender_id FROM tender_pages) LEFT JOIN nn USING (tender_id) GROUP BY tender_id""")
def tnd_02_page_requirements(s, d):
    told = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["page"].cast("string"), F.lit(" "), e["value"], F.lit(": "), e["source_text"])), " | ")
    r = tender.page_requirements(t(s, d, "tender_pages"))
    return r.select("tender_id", *_SINGLE, *(told(f"{k}_evidence").alias(f"{k}_evidence") for k in _SINGLE), told("dimensions").alias("dimensions"), told("references").alias("refs"))


@query(f"WITH {REQ} SELECT tender_id, array_to_string(dimensions, ';') AS dimensions FROM rq")
def tnd_03_dimensions(s, d):
    return _reqs(s, d).select("tender_id", F.array_join("dimensions", ";").alias("dimensions"))


@query(f"WITH {REQ} SELECT tender_id, array_to_string(testing, ';') AS testing, array_to_string(safety, ';') AS safety FROM rq")
def tnd_04_cues(s, d):
    return _reqs(s, d).select("tender_id", F.array_join("testing", ";").alias("testing"), F.array_join("safety", ";").alias("safety"))


@query(f"WITH {REQ} SELECT tender_id, ref AS value, split_part(ref, ':', 1) AS base, split_part(ref, ':', 2)::INT AS year FROM rq")
def tnd_05_references(s, d):
    return tender.reference_rows(_reqs(s, d)).select("tender_id", "value", "base", "year")


WORDS = """wd AS (SELECT tender_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[a-z]{3,}'), 1) AS pos FROM tenders),
kw AS (SELECT * FROM (SELECT tender_id, word, count(*) AS n, row_number() OVER (PARTITION BY tender_id ORDER BY count(*) DESC, min(pos)) AS rank FROM wd
 WHERE word NOT IN ('the','and','for','with','from','that','this','shall','will','are','has','have','been','were','which','using','test','standard') GROUP BY tender_id, word) WHERE rank <= 12)"""


@query(f"WITH {WORDS} SELECT tender_id, word, n, rank FROM kw")
def tnd_06_keywords(s, d):
    return tender.keywords(t(s, d, "tenders")).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""WITH {REQ}, {WORDS}, k AS (SELECT tender_id, string_agg(word, ' ' ORDER BY rank) AS k FROM kw WHERE rank <= 8 GROUP BY 1)
SELECT tender_id, substring(concat_ws(' ', product, material, application, capacity, k, nullif(array_to_string(testing[1:3], ' '), '')), 1, 600) AS query FROM rq LEFT JOIN k USING (tender_id)""")
def tnd_07_query_text(s, d):
    x = t(s, d, "tenders")
    return tender.query_text(tender.requirements(x), tender.keywords(x))


GAPS = """g AS (SELECT tender_id, unnest([CASE WHEN material IS NULL THEN 'material|critical' END, CASE WHEN application IS NULL THEN 'application|critical' END, CASE WHEN len(testing) = 0 THEN 'testing|critical' END,
 CASE WHEN len(safety) = 0 THEN 'safety|critical' END, 'certification|critical', 'temperature|important', 'pressure|important', 'voltage|important', 'tolerance|important', 'surface_finish|important', 'coating|important', 'marking|important', 'delivery|important', 'warranty|important',
 CASE WHEN len(testing) < 2 THEN 'testing_methods|important' END]) AS x FROM rq)"""


@query(f"WITH {REQ}, {GAPS} SELECT tender_id, split_part(x, '|', 1) AS parameter, split_part(x, '|', 2) AS severity FROM g WHERE x IS NOT NULL")
def gap_01_missing(s, d):
    return tender.gaps(_reqs(s, d))


@query("""SELECT tender_id, kind, n::INT AS n, first, severity FROM (
SELECT tender_id, 'approximate' AS kind, 2 AS n, 'about' AS first, 'warning' AS severity FROM tenders WHERE text LIKE '%Test may%'
UNION ALL SELECT tender_id, 'vague', 1, 'suitable', 'warning' FROM tenders WHERE text LIKE '%Test may%'
UNION ALL SELECT tender_id, 'optional', 1, 'may', 'info' FROM tenders WHERE text LIKE '%Test may%'
UNION ALL SELECT tender_id, 'subjective', 1, 'good quality', 'warning' FROM tenders WHERE text LIKE '%good quality%'
UNION ALL SELECT tender_id, 'unnamed', 1, 'as per', 'warning' FROM tenders WHERE text LIKE '%as per drawing%')""")
def qlt_02_ambiguity(s, d):
    return tender.ambiguity(t(s, d, "tenders"))


ISSUES = """i AS (SELECT tender_id, unnest([CASE WHEN product IS NULL THEN 'missing_parameter|critical' END, CASE WHEN material IS NULL THEN 'missing_parameter|critical' END, CASE WHEN application IS NULL THEN 'missing_parameter|critical' END,
 CASE WHEN len(testing) = 0 THEN 'missing_parameter|warning' END, CASE WHEN split_part(ref, ':', 2)::INT < 2015 OR regexp_extract(ref, '[0-9]{4}')::INT < 2015 THEN 'outdated_reference|warning' END,
 CASE WHEN split_part(dimensions[1], ' ', 1) = split_part(dimensions[2], ' ', 1) THEN 'internal_conflict|warning' END, CASE WHEN len(testing) = 0 THEN 'missing_acceptance|warning' END, CASE WHEN text NOT LIKE '%inspection%' THEN 'missing_inspection|info' END]) AS x FROM rq_)"""
REQ_ = "rq_ AS (SELECT * REPLACE (CASE WHEN regexp_matches(ref, 'IS [0-9]{4}:') THEN regexp_extract(ref, '[0-9]{4}', 0) || ':' || regexp_extract(ref, '[0-9]{4}', 0) ELSE ref END AS ref) FROM rq)"


@query(f"WITH {REQ}, {REQ_}, {ISSUES} SELECT tender_id, split_part(x, '|', 1) AS category, split_part(x, '|', 2) AS severity FROM i WHERE x IS NOT NULL")
def qlt_01_issues(s, d):
    return tender.issues(_reqs(s, d))


@query(f"""WITH {REQ}, {REQ_}, {ISSUES} SELECT rq.tender_id, count(*) FILTER (x LIKE '%critical') AS critical, count(*) FILTER (x LIKE '%warning') AS warnings, count(*) FILTER (x LIKE '%info') AS info,
greatest(0, 100 - 15 * count(*) FILTER (x LIKE '%critical') - 5 * count(*) FILTER (x LIKE '%warning') - count(*) FILTER (x LIKE '%info'))::BIGINT AS score FROM rq LEFT JOIN i USING (tender_id) GROUP BY rq.tender_id""")
def qlt_07_score(s, d):
    r = _reqs(s, d)
    return tender.scores(r, tender.issues(r))


SP = "sp AS (SELECT DISTINCT ON (tender_id, spec_ord) *, CASE property WHEN 'Length' THEN 'Dimensions' ELSE 'Requirements' END AS section FROM tender_specs ORDER BY tender_id, spec_ord, spec_id, standard_id, value, material, property, unit, tolerance)"
TRACED = """list_concat(CASE WHEN product IS NULL THEN [] ELSE ['product|' || product || '|Product'] END, CASE WHEN material IS NULL THEN [] ELSE ['material|' || material || '|Material'] END, CASE WHEN application IS NULL THEN [] ELSE ['application|' || application || '|Application'] END,
 ['capacity|' || capacity || '|Capacity', 'dimension|' || dimensions[1] || '|Dimension 1', 'dimension|' || dimensions[2] || '|Dimension 2'], list_transform(testing, lambda x: 'testing|' || x || '|Testing: ' || x), list_transform(safety, lambda x: 'safety|' || x || '|Safety: ' || x))"""
PARAMS = f"""pr AS (SELECT tender_id, unnest({TRACED}) AS x, generate_subscripts({TRACED}, 1) - 1 AS ord FROM rq),
pp AS (SELECT tender_id, ord, split_part(x, '|', 1) AS name, split_part(x, '|', 2) AS value, split_part(x, '|', 3) AS label FROM pr)"""
MATCH = f"""{REQ}, {SP}, {PARAMS}, mt AS (SELECT tender_id, ord, name, pp.value, spec_ord, spec_id, standard_id, section, page, property || ': ' || sp.value || ' ' || unit AS told, CASE WHEN spec_id IS NULL THEN 0 ELSE (CASE WHEN len(list_filter(string_split(lower(label), ' '), lambda w: contains(lower(property), w))) > 0 THEN 3 ELSE 0 END)
 + (CASE WHEN contains(lower(sp.value), lower(pp.value)) OR contains(lower(pp.value), lower(sp.value)) THEN 5 ELSE 0 END)
 + (CASE WHEN abs(try_cast(split_part(pp.value, ' ', 1) AS DOUBLE) - sp.value::DOUBLE) / greatest(abs(sp.value::DOUBLE), 1) < 0.15::DOUBLE THEN 4 ELSE 0 END) END AS score FROM pp LEFT JOIN sp USING (tender_id)),
bm AS (SELECT tender_id, ord, name, value, score, CASE WHEN score > 0 THEN spec_id END AS spec_id, CASE WHEN score > 0 THEN standard_id END AS standard_id, CASE WHEN score > 0 THEN section END AS clause, CASE WHEN score > 0 THEN page END AS evidence_page, CASE WHEN score > 0 THEN told END AS evidence_text,
 CASE WHEN score >= 5 THEN 'supported' WHEN score >= 2 THEN 'partially_supported' WHEN score > 0 THEN 'unverified' ELSE 'not_found' END AS status
 FROM (SELECT *, row_number() OVER (PARTITION BY tender_id, ord ORDER BY score DESC, spec_ord) AS n FROM mt) WHERE n = 1)"""


def _specs(s, d):
    """A tender's specifications, one a place. They are brought together by tender once, for all steps."""
    x = t(s, d, "tender_specs").repartition("tender_id")
    first = F.min(F.struct("spec_id", "standard_id", "value", "material", "property", "unit", "tolerance", "nominal", "confidence", "page"))
    return x.groupBy("tender_id", "spec_ord").agg(first.alias("x")).select("tender_id", "spec_ord", "x.*", F.when(F.col("x.property") == "Length", "Dimensions").otherwise("Requirements").alias("section"))


@query(f"WITH {REQ}, {PARAMS} SELECT tender_id, ord, name, value, label FROM pp")
def trc_01_params(s, d):
    return tender.traceable(_reqs(s, d)).withColumn("ord", F.col("ord").cast("bigint"))


@query(f"WITH {MATCH} SELECT tender_id, ord, name, value, score, spec_id, standard_id, clause, evidence_page, evidence_text, status FROM bm")
def trc_02_best_match(s, d):
    x = tender.best_match(tender.traceable(_reqs(s, d)), _specs(s, d))
    return x.withColumn("ord", F.col("ord").cast("bigint"))


@query(f"WITH {MATCH} SELECT status, count(*) AS n FROM bm GROUP BY status")
def trc_03_status_counts(s, d):
    return tender.best_match(tender.traceable(_reqs(s, d)), _specs(s, d)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {MATCH}, own AS (SELECT tender_id, ord AS sort_order, name AS parameter, value AS requirement, CASE WHEN score >= 2 THEN 'supported' ELSE 'requires_input' END AS status FROM bm),
n AS (SELECT tender_id, count(*) AS n, list(DISTINCT name) AS names FROM pp GROUP BY 1),
m AS (SELECT sp.*, n.n, row_number() OVER (PARTITION BY tender_id, standard_id, property, value ORDER BY spec_ord) AS k FROM sp LEFT JOIN n USING (tender_id) WHERE len(list_filter(coalesce(n.names, []), lambda x: contains(lower(property), x))) = 0),
a AS (SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY spec_ord) - 1 AS j FROM m WHERE k = 1)
SELECT * FROM own UNION ALL SELECT tender_id, coalesce(n, 0) + 2 * j, property, value || ' ' || unit, 'additional' FROM a WHERE j < 10""")
def spb_02_specification(s, d):
    p, sp = tender.traceable(_reqs(s, d)), _specs(s, d)
    return analysis.specification(p, tender.best_match(p, sp), sp).withColumn("sort_order", F.col("sort_order").cast("bigint"))


FIRST = """fs AS (SELECT tender_id, arg_min(material, spec_ord) FILTER (material <> '') AS sm, arg_min(value, spec_ord) FILTER (property = 'Capacity') AS sc, arg_min(value, spec_ord) FILTER (property = 'Length') AS sd,
 arg_min(tolerance, spec_ord) FILTER (property = 'Length') AS st, bool_or(property = 'Material test') AS tst FROM sp GROUP BY 1)"""
STATUS = "CASE WHEN {t} IS NULL THEN 'TENDER_NOT_SPECIFIED' WHEN {s} IS NULL THEN 'STANDARD_NOT_FOUND' WHEN {e} THEN 'MATCH' ELSE 'MISMATCH' END"


@query(f"""WITH {REQ}, {SP}, {FIRST}, b AS (SELECT *, dimensions[1] AS td, nullif(array_to_string(testing, ', '), '') AS tt, CASE WHEN tst THEN 'specified' END AS ss FROM rq LEFT JOIN fs USING (tender_id))
SELECT tender_id, 'material' AS requirement, material AS tender, sm AS standard, {STATUS.format(t='material', s='sm', e='contains(material, sm) OR contains(sm, material)')} AS status FROM b
UNION ALL SELECT tender_id, 'capacity', capacity, sc, {STATUS.format(t='capacity', s='sc', e="abs(split_part(capacity, ' ', 1)::DOUBLE - sc::DOUBLE) < 1e-6")} FROM b
UNION ALL SELECT tender_id, 'dimensions', td, sd, {STATUS.format(t='td', s='sd', e="coalesce(abs(split_part(td, ' ', 1)::DOUBLE - sd::DOUBLE) <= try_cast(st AS DOUBLE), false)")} FROM b
UNION ALL SELECT tender_id, 'testing', tt, ss, {STATUS.format(t='tt', s='ss', e='tst')} FROM b""")
def cmpr_01_matrix(s, d):
    return analysis.comparison(_reqs(s, d), _specs(s, d))


@query(f"""WITH {REQ}, {SP}, dm AS (SELECT tender_id, unnest(dimensions) AS parameter, generate_subscripts(dimensions, 1) AS k FROM rq), x AS (SELECT tender_id, parameter, k, standard_id, spec_ord, nominal, abs(split_part(parameter, ' ', 1)::DOUBLE - nominal) / abs(nominal) * 100 AS off FROM dm JOIN sp USING (tender_id) WHERE nominal <> 0)
SELECT tender_id, parameter, standard_id, nominal, CASE WHEN off > 30 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT *, row_number() OVER (PARTITION BY tender_id, parameter, standard_id ORDER BY k, spec_ord) AS n FROM x WHERE off > 15) WHERE n = 1""")
def cnf_01_value_conflict(s, d):
    return analysis.value_conflicts(_reqs(s, d), _specs(s, d))


@query(f"WITH {REQ}, {SP} SELECT DISTINCT tender_id, standard_id, rq.material AS t_material, sp.material FROM rq JOIN sp USING (tender_id) WHERE rq.material IS NOT NULL AND sp.material <> '' AND NOT contains(rq.material, sp.material) AND NOT contains(sp.material, rq.material)")
def cnf_02_material_conflict(s, d):
    return analysis.material_conflicts(_reqs(s, d), _specs(s, d))


@query(f"WITH {REQ}, {SP}, rf AS (SELECT tender_id, tender_id || '_0' AS ref_id, split_part(ref, ':', 2)::INT AS year FROM rq) SELECT tender_id, ref_id, standard_id, year, edition_year FROM rf JOIN (SELECT DISTINCT tender_id, standard_id FROM sp) USING (tender_id) JOIN standards USING (standard_id) WHERE edition_year > year + 5")
def cnf_03_version_conflict(s, d):
    st = _specs(s, d).select("tender_id", "standard_id").distinct().join(t(s, d, "standards").select("standard_id", "edition_year"), "standard_id")
    return analysis.version_conflicts(tender.reference_rows(_reqs(s, d)), st)


@query("WITH x AS (SELECT spec_id, standard_id, page, value::DOUBLE AS a, 20.0::DOUBLE AS b FROM specs) SELECT spec_id, standard_id, page, abs(a - b) / b * 100 <= 10 AS compatible, abs(a - b) / b * 100 AS difference FROM x")
def cnf_06_compatible(s, d):
    x = t(s, d, "specs").withColumn("c", analysis.compatible(F.concat_ws(" ", "value", F.lit("mm")), F.lit("20 MM")))
    return x.select("spec_id", "standard_id", "page", "c.compatible", "c.difference")


NEW = "ne AS (SELECT source, target, type, confidence FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY confidence DESC, type) AS n FROM edges) WHERE n = 1 AND (source, target) NOT IN (SELECT (source, target) FROM old_edges))"


@query(f"WITH {NEW} SELECT source, target, type, confidence FROM ne")
def grf_04_populate_antijoin(s, d):
    return graph.new_edges(t(s, d, "edges"), t(s, d, "old_edges"))


@query("SELECT coalesce(nullif(type, 'R'), 'unknown') AS type, count(*) AS n FROM edges GROUP BY 1")
def grf_05_type_counts(s, d):
    return graph.edge_counts(t(s, d, "edges").withColumn("type", F.nullif("type", F.lit("R"))))


@query("SELECT source, target FROM old_edges ORDER BY source, target LIMIT 200")
def grf_03_all_relationships(s, d):
    return graph.all_relationships(t(s, d, "old_edges"))


EGO = "SELECT * FROM (SELECT standard_id AS root, '{k}' AS kind, {n} AS node, row_number() OVER (PARTITION BY standard_id ORDER BY {n}) AS n FROM {f}) WHERE n <= {m} AND root IN (SELECT standard_id FROM standards)"


@query(f"""WITH a AS ({EGO.format(k='contains', n='section_id', f="(SELECT DISTINCT standard_id, 'P' || page AS section_id FROM specs)", m=15)}),
b AS ({EGO.format(k='specifies', n='spec_id', f='(SELECT DISTINCT standard_id, spec_id FROM specs)', m=10)}), c AS ({EGO.format(k='references', n='target', f='(SELECT source AS standard_id, target FROM old_edges)', m=15)})
SELECT root, kind, node, true AS known FROM a UNION ALL SELECT root, kind, node, true FROM b UNION ALL SELECT root, kind, node, node IN (SELECT standard_id FROM standards WHERE edition_year < 2010) FROM c""")
def grf_01_ego(s, d):
    st, sp = t(s, d, "standards"), t(s, d, "specs").select("standard_id", "spec_id", F.concat(F.lit("P"), "page").alias("section_id"))
    refs = t(s, d, "old_edges").withColumnRenamed("source", "standard_id")
    return graph.ego_graphs(st, sp.select("standard_id", "section_id").distinct(), sp.select("standard_id", "spec_id").distinct(), refs, st.where("edition_year < 2010"))


@query("""WITH m AS (SELECT DISTINCT concat('W', o.o_custkey) AS workspace_id, standard_id FROM tender_specs JOIN orders o ON tender_id = concat('T', o.o_orderkey)),
tr AS (SELECT DISTINCT concat('W', o.o_custkey) AS workspace_id, tender_id AS source, standard_id AS target, 'traceable_to' AS type FROM tender_specs JOIN orders o ON tender_id = concat('T', o.o_orderkey) WHERE spec_ord = 1),
cr AS (SELECT a.workspace_id, e.source, e.target, 'cites' AS type, row_number() OVER (PARTITION BY a.workspace_id, e.source ORDER BY e.target) AS n FROM old_edges e JOIN m a ON a.standard_id = e.source JOIN m b ON b.standard_id = e.target AND a.workspace_id = b.workspace_id)
SELECT * FROM tr UNION ALL SELECT workspace_id, source, target, type FROM cr WHERE n <= 5""")
def grf_02_workspace(s, d):
    o = t(s, d, "orders").select(F.concat(F.lit("W"), "o_custkey").alias("workspace_id"), F.concat(F.lit("T"), "o_orderkey").alias("tender_id"))
    x = t(s, d, "tender_specs").join(o, "tender_id")
    traces = x.where("spec_ord = 1").select("workspace_id", F.col("tender_id").alias("requirement_id"), "standard_id")
    return graph.workspace_graph(traces, x.where("spec_ord > 1"), t(s, d, "old_edges").withColumn("type", F.lit("cites")))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def src_10_last_writes(s, d):
    return graph.last_writes(t(s, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("""SELECT standard_id, coalesce(nullif(CASE WHEN b.p_size % 2 = 0 THEN b.p_brand ELSE '' END, ''), a.title) AS title, CASE WHEN b.p_partkey IS NULL THEN a.edition_year ELSE 2026 END AS edition_year
FROM standards a LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 = 0) b ON standard_id = concat('STD', b.p_partkey)""")
def src_09_upsert(s, d):
    old = t(s, d, "standards").select("standard_id", "title", "edition_year")
    p = t(s, d, "part").where("p_partkey % 3 = 0")
    new = p.select(F.concat(F.lit("STD"), "p_partkey").alias("standard_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("title"), F.lit(2026).alias("edition_year"))
    return graph.upserted(old, new, "standard_id", ["title"])


@query("SELECT concat('W', user_id) AS workspace_id, event_id, event_type FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 1000 = 0) OR event_id % 1000 = 0")
def wsp_02_replace(s, d):
    e = t(s, d, "events").select(F.concat(F.lit("W"), "user_id").alias("workspace_id"), "event_id", "event_type")
    return graph.replaced(e, e.where("event_id % 1000 = 0"))


@query("SELECT concat('W', c_custkey) AS workspace_id, coalesce(n, 0) AS n_items, items FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS items FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def wsp_01_get(s, d):
    items = t(s, d, "orders").select(F.concat(F.lit("W"), "o_custkey").alias("workspace_id"), F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("sort_order"))
    return graph.workspaces(t(s, d, "customer").select(F.concat(F.lit("W"), "c_custkey").alias("workspace_id")), items).select("workspace_id", "n_items", "items")


@query("SELECT standard_id, count(*) AS specs, (SELECT count(*) FROM old_edges e WHERE e.source = specs.standard_id) AS refs FROM specs GROUP BY standard_id")
def std_03_counts(s, d):
    n = t(s, d, "specs").groupBy("standard_id").agg(F.count("*").alias("specs"))
    r = t(s, d, "old_edges").groupBy(F.col("source").alias("standard_id")).agg(F.count("*").alias("refs"))
    return n.join(r, "standard_id", "left").select("standard_id", "specs", F.coalesce("refs", F.lit(0)).alias("refs"))


@query("SELECT standard_id, spec_id, page FROM (SELECT standard_id, spec_id, page, row_number() OVER (PARTITION BY standard_id ORDER BY page, spec_id) AS n FROM (SELECT DISTINCT standard_id, spec_id, page FROM specs)) WHERE n <= 20")
def std_01_detail(s, d):
    from lodestone.operators.ranking import first_of

    return first_of(t(s, d, "specs").select("standard_id", "spec_id", "page").distinct(), "standard_id", ["page", "spec_id"], 20)


DQ = """SELECT * FROM (VALUES ('standard_ids', (SELECT count(*) FROM standards WHERE coalesce(standard_id, '') = ''), 'FAIL'),
('titles', (SELECT (avg(CASE WHEN scope = '' THEN 1.0 ELSE 0 END) > 0.4)::INT FROM standards), 'WARN'), ('chunk_pages', (SELECT count(*) FROM chunks WHERE page - 1 = 0), 'FAIL'),
('figure_pages', (SELECT count(*) FROM figures WHERE coalesce(page, 0) = 0), 'FAIL'), ('table_pages', (SELECT count(*) FROM specs WHERE coalesce(page, 0) = 0), 'FAIL'), ('reference_sources', (SELECT count(*) FROM edges WHERE coalesce(source, '') = ''), 'FAIL'),
('figures_per_standard', (SELECT count(*) FROM (SELECT standard_id FROM figures GROUP BY 1 HAVING count(*) > 80)), 'WARN'), ('figure_groups', (SELECT count(*) FROM (SELECT duplicate_group FROM figures WHERE caption GROUP BY 1 HAVING count(*) > 10)), 'WARN'),
('short_chunks', (SELECT count(*) FROM chunks WHERE length(trim(text)) < 10), 'FAIL'), ('long_chunks', (SELECT count(*) FROM chunks WHERE length(text) > 6000), 'WARN'), ('broken_chunks', (SELECT count(*) FROM chunks WHERE length(text) - length(replace(text, chr(65533), '')) > 5), 'WARN'),
('vectors', (SELECT abs((SELECT count(*) FROM embeddings) - (SELECT count(*) FROM documents))), 'FAIL')) AS v(check_name, bad, f)"""


def _dq(s, d):
    f = t(s, d, "figures").withColumn("confirmed", F.col("caption"))
    st = t(s, d, "standards").withColumn("title", F.col("scope"))
    c = t(s, d, "chunks").withColumn("page", F.col("page") - 1)
    return dq.report(st, c, f, t(s, d, "specs"), t(s, d, "edges"), t(s, d, "vectors"), t(s, d, "documents"))


@query(f"SELECT check_name, bad::BIGINT AS bad, CASE WHEN bad > 0 THEN f ELSE 'PASS' END AS status FROM ({DQ})")
def dq_report(s, d):
    return _dq(s, d)


@query(f"SELECT CASE WHEN bool_or(bad > 0 AND f = 'FAIL') THEN 'FAIL' ELSE 'PASS' END AS overall, count(*) FILTER (bad > 0) AS issues FROM ({DQ})")
def dq_13_overall(s, d):
    return dq.overall(_dq(s, d))


@query("SELECT spec_id, property, value FROM specs WHERE contains(lower(property), 'length') AND (contains(value, '4') OR contains(lower(material), '4')) ORDER BY lower(value), spec_id LIMIT 8 OFFSET 8")
def ui_01_spec_page(s, d):
    return views.spec_page(t(s, d, "specs"), "length", "4", "value", 1).select("spec_id", "property", "value")


@query("SELECT spec_id, standard_id, page FROM specs WHERE property = 'Material test'")
def ui_04_tests(s, d):
    return views.tests_only(t(s, d, "specs").withColumn("condition", F.lit(None).cast("string"))).select("spec_id", "standard_id", "page")


@query("SELECT standard_id, title FROM standards WHERE contains(lower(standard_id), '77') OR contains(lower(title), '77')")
def ui_06_directory(s, d):
    return views.search_any(t(s, d, "standards"), "77", ["standard_id", "title"]).select("standard_id", "title")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) % 2 = 1")
def ui_09_toggled(s, d):
    return views.toggled(t(s, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "n")


@query("SELECT spec_id, standard_id, page, CASE WHEN confidence >= 0.7 THEN 'Strong Match' WHEN confidence >= 0.4 THEN 'Relevant' ELSE 'Low' END AS label FROM specs")
def rnk_16_labels(s, d):
    return t(s, d, "specs").select("spec_id", "standard_id", "page", views.match_label(F.lit("LOW"), F.col("confidence")).alias("label"))


@query("SELECT spec_id, standard_id, page, CASE WHEN tolerance = '' THEN 'TENDER_NOT_SPECIFIED' ELSE 'MATCH' END AS status FROM specs")
def ui_10_status(s, d):
    return t(s, d, "specs").select("spec_id", "standard_id", "page", views.tender_status(F.lit("MATCH"), F.col("tolerance")).alias("status"))
