"""Queries on the chained analysis: what each stage makes of the tenders, from the engine's own recommendations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.operators import graph
from lodestone.plans.analytics import GAPS, MATCH, PARAMS, REQ, SP, WORDS, _reqs
from lodestone.plans.fixtures import table as t
from lodestone.plans.retrieval import RANKED, SEM, _index
from lodestone.sources.files import work_folder
from lodestone.sources.store import Store

QUERIES, SQL = {}, {}
_RUN: dict[tuple, object] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


def _report(s, d):
    """The run over all calls, made by the first query of a session that needs it and again after the corpus has changed."""
    index = _index(s, d)
    at = (s.sparkContext.applicationId, d, id(index))
    if at not in _RUN:
        engine = Engine(t(s, d, "chunks"), t(s, d, "standards"), None, index, t(s, d, "specs"))
        _RUN[at] = engine.run(t(s, d, "calls"), work_folder(s, "analysis"))
    return _RUN[at]


_own = lambda sql: sql.replace("FROM tenders", "FROM calls WHERE trim(text) <> ''").replace("trim(text) <> '' WHERE", "trim(text) <> '' AND")
NO_SEM = "sem AS (SELECT NULL::VARCHAR AS query_id, NULL::VARCHAR AS chunk_id, 0.0::DOUBLE AS score, 0 AS rank WHERE false)"
# a short query gives way to the text itself
ASKED = """bq AS (SELECT tender_id, text, substring(concat_ws(' ', product, material, application, capacity, k, nullif(array_to_string(testing[1:3], ' '), '')), 1, 600) AS built
 FROM rq LEFT JOIN (SELECT tender_id, string_agg(word, ' ' ORDER BY rank) AS k FROM kw WHERE rank <= 8 GROUP BY 1) USING (tender_id)),
tq AS (SELECT tender_id AS query_id, CASE WHEN length(text) > 20 AND length(built) < 50 THEN substring(text, 1, 500) ELSE built END AS query FROM bq)"""
FOUND = re.sub(r"\bqueries\b", "tq", RANKED.replace(SEM, NO_SEM))
SPECIFIED = """rec AS (SELECT query_id AS tender_id, standard AS standard_id, rank, score, split_part(evidence_chunks, ',', 1) AS chunk_id FROM rr WHERE rank <= 5),
cs AS (SELECT DISTINCT standard_id, spec_id, page, property, value, nominal, unit, material, tolerance, confidence FROM (SELECT *, max((confidence >= 0.6)::INT) OVER (PARTITION BY standard_id) AS has_some FROM specs) WHERE confidence >= 0.6 OR has_some = 0),
es AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY standard_id ORDER BY page, spec_id, property, value, nominal, unit, material, tolerance, confidence) AS n FROM cs) WHERE n <= 12),
sp AS (SELECT rec.tender_id, rec.rank * 100 + es.n - 1 AS spec_ord, es.standard_id, es.spec_id, es.property, es.value, es.nominal, es.unit, es.material, es.tolerance, ch.page, NULL AS section, substring(ch.text, 1, 200) AS evidence
 FROM rec JOIN es USING (standard_id) LEFT JOIN chunks ch USING (chunk_id))"""
CHAIN = f"{_own(REQ)}, {_own(WORDS)}, {ASKED}, {FOUND}, {SPECIFIED}"
TRACED = re.sub(r"\bbm\b", "tm", MATCH).replace(f"{REQ}, {SP}, ", "").replace("property || ': ' || sp.value || ' ' || unit AS told", "coalesce(nullif(evidence, ''), property || ': ' || sp.value || ' ' || unit) AS told")


@query(f"WITH {CHAIN} SELECT tender_id, standard_id, rank, score, chunk_id FROM rec")
def anl_01_recommended(s, d):
    r = _report(s, d).tables["ranking"]
    return r.select("tender_id", "standard_id", F.col("rank").cast("bigint").alias("rank"), "score", F.get("evidence_chunks", 0).alias("chunk_id"))


@query(f"WITH {CHAIN}, {TRACED} SELECT tender_id, ord, name, value, score, spec_id, standard_id, evidence_page, evidence_text, status FROM tm")
def anl_01_traces(s, d):
    r = _report(s, d).tables["traceability"]
    return r.select("tender_id", F.col("ord").cast("bigint").alias("ord"), "name", "value", "score", "spec_id", "standard_id", "evidence_page", "evidence_text", "status")


@query(f"""WITH {CHAIN}, s5 AS (SELECT * FROM sp), dm AS (SELECT tender_id, unnest(dimensions) AS parameter FROM rq),
v AS (SELECT DISTINCT tender_id, 'value_mismatch' AS type, parameter, standard_id FROM dm JOIN s5 USING (tender_id) WHERE nominal <> 0 AND abs(split_part(parameter, ' ', 1)::DOUBLE - nominal) / abs(nominal) * 100 > 15),
m AS (SELECT DISTINCT tender_id, 'material_conflict' AS type, 'material' AS parameter, standard_id FROM rq JOIN s5 USING (tender_id) WHERE rq.material IS NOT NULL AND s5.material <> '' AND NOT contains(lower(rq.material), s5.material) AND NOT contains(s5.material, lower(rq.material))),
e AS (SELECT DISTINCT tender_id, 'version_conflict' AS type, ref AS parameter, standard_id FROM rq JOIN rec USING (tender_id) JOIN standards USING (standard_id) WHERE edition_year > split_part(ref, ':', 2)::INT + 5)
SELECT * FROM v UNION ALL SELECT * FROM m UNION ALL SELECT * FROM e""")
def anl_01_conflicts(s, d):
    return _report(s, d).tables["conflicts"].select("tender_id", "type", "parameter", "standard_id")


@query(f"""WITH {CHAIN}, {GAPS.replace("g AS", "gx AS", 1)}, {PARAMS},
ne AS (SELECT tender_id FROM rq JOIN (SELECT split_part(normalized_identifier, ':', 1) AS base, max(edition_year) AS latest FROM standards GROUP BY 1) ON base = split_part(ref, ':', 1) WHERE split_part(ref, ':', 2)::INT < latest)
SELECT stage, 'success' AS status, n FROM (SELECT 'understand' AS stage, (SELECT count(*) FROM rq) AS n UNION ALL SELECT 'ranking', (SELECT count(*) FROM rec) UNION ALL SELECT 'evidence', (SELECT count(*) FROM sp)
UNION ALL SELECT 'gaps', (SELECT count(*) FROM gx WHERE x IS NOT NULL) UNION ALL SELECT 'quality', (SELECT count(*) FROM rq) UNION ALL SELECT 'traceability', (SELECT count(*) FROM pp)
UNION ALL SELECT 'save_workspace', (SELECT count(*) FROM pp WHERE name <> 'dimension') UNION ALL SELECT 'version_check', (SELECT count(*) FROM ne))""")
def anl_01_stages(s, d):
    """The report of the stages; conflicts have their own query, and what specification() makes of traces is held to SQL by spb_02."""
    return _report(s, d).stages.where("stage NOT IN ('conflicts', 'specification')").select("stage", "status", F.col("rows").alias("n"))


@query("SELECT tender_id, CASE WHEN trim(text) = '' THEN 'error' ELSE 'success' END AS status, CASE WHEN trim(text) = '' THEN 'text required' END AS error FROM calls")
def anl_01_status(s, d):
    return _report(s, d).tenders


@query(f"WITH {REQ}, {PARAMS} SELECT tender_id, name AS category, value FROM pp WHERE name <> 'dimension'")
def wsp_02_requirement_rows(s, d):
    return graph.requirement_rows(_reqs(s, d)).select("tender_id", "category", "value")


def _stored(s, d):
    """Workspaces of all customers with their requirements and traces; then a save for a third of them, and a deletion."""
    store = Store(s, work_folder(s, "store"))
    ws = t(s, d, "customer").select(F.concat(F.lit("W"), "c_custkey").alias("workspace_id"), F.col("c_custkey").alias("created_at"))
    o = t(s, d, "orders").select(F.concat(F.lit("W"), "o_custkey").alias("workspace_id"), F.col("o_orderkey").alias("id"), "o_custkey")
    store.save({"workspaces": ws, "requirements": o.drop("o_custkey"), "traces": o.select("workspace_id", (F.col("id") * 2).alias("id"))})
    again = o.where("o_custkey % 3 = 0 AND id % 2 = 0").drop("o_custkey")
    store.replace({"requirements": again, "traces": again.withColumn("id", -F.col("id"))})
    store.delete(ws.where("created_at % 10 = 0"))
    return store


KEPT = """w AS (SELECT concat('W', c_custkey) AS workspace_id, c_custkey AS created_at FROM customer WHERE c_custkey % 10 <> 0),
o AS (SELECT concat('W', o_custkey) AS workspace_id, o_orderkey AS id, o_custkey % 3 = 0 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) AS again FROM orders WHERE o_custkey % 10 <> 0),
r AS (SELECT workspace_id, id, 'requirement' AS kind FROM o WHERE NOT again OR id % 2 = 0 UNION ALL SELECT workspace_id, CASE WHEN again THEN -id ELSE id * 2 END, 'trace' FROM o WHERE NOT again OR id % 2 = 0)"""


@query(f"WITH {KEPT} SELECT workspace_id, id, kind FROM r")
def src_10_replaced_together(s, d):
    store = _stored(s, d)
    one = lambda name, kind: store.read(name).select("workspace_id", "id", F.lit(kind).alias("kind"))
    return one("requirements", "requirement").unionByName(one("traces", "trace"))


@query(f"WITH {KEPT} SELECT workspace_id, created_at FROM w ORDER BY created_at DESC, workspace_id")
def wsp_01_listed(s, d):
    return graph.listed(_stored(s, d).read("workspaces"))
