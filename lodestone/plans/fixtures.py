"""The domain's tables, derived from the given ones. Each text is SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SPEC_COLUMNS = """l_linenumber AS spec_ord, concat('S', l_orderkey, '_', l_linenumber) AS spec_id, concat('STD', l_partkey) AS standard_id,
  CASE l_returnflag WHEN 'A' THEN 'Length' WHEN 'N' THEN 'Capacity' ELSE 'Material test' END AS property,
  CAST(CAST(l_quantity AS INT) AS STRING) AS value, l_quantity AS nominal, CASE WHEN l_linestatus = 'O' THEN 'mm' ELSE 'L' END AS unit,
  CASE WHEN l_suppkey % 2 = 0 THEN '2' ELSE '' END AS tolerance,
  CASE l_suppkey % 5 WHEN 0 THEN 'steel' WHEN 1 THEN 'brass' WHEN 2 THEN 'copper' ELSE '' END AS material,
  l_tax * 10 AS confidence, l_linenumber AS page"""

TABLES = {
    "standards": """SELECT concat('STD', p_partkey) AS standard_id, concat('IS ', p_partkey, ':', 1976 + p_size) AS normalized_identifier,
  p_name AS title, 1976 + p_size AS edition_year, p_name AS base, concat(p_size, '.', p_partkey % 100) AS ics_code,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('Scope of ', p_name) END AS scope FROM part""",
    "specs": f"SELECT {SPEC_COLUMNS} FROM lineitem",
    "tender_specs": f"SELECT concat('T', l_orderkey) AS tender_id, {SPEC_COLUMNS} FROM lineitem",
    "tenders": """SELECT concat('T', o_orderkey) AS tender_id, concat('Supply of ',
  CASE o_orderkey % 3 WHEN 0 THEN 'water storage tank' WHEN 1 THEN 'pump' ELSE 'goods' END, ' in ',
  CASE o_custkey % 5 WHEN 0 THEN 'mild steel' WHEN 1 THEN 'brass' WHEN 2 THEN 'HDPE' WHEN 3 THEN 'copper' ELSE 'wood' END,
  CASE WHEN o_orderkey % 2 = 0 THEN ' for drinking water' ELSE '' END, ', capacity ', o_custkey % 90 + 10, ' L, length ', o_orderkey % 50 + 1,
  ' mm, as per IS ', o_custkey % 2000 + 100, ':', 1990 + o_orderkey % 33, '. ',
  CASE o_orderkey % 4 WHEN 0 THEN 'Testing and inspection shall be of good quality. ' WHEN 1 THEN 'Test may be about suitable, about enough. ' ELSE '' END,
  CASE WHEN o_custkey % 3 = 0 THEN 'Safety warning labels.' ELSE 'Goods as per drawing.' END) AS text FROM orders""",
    "calls": """SELECT concat('T', c_custkey) AS tender_id, CASE WHEN c_custkey % 50 = 0 THEN ' ' ELSE concat('Supply of ',
  CASE c_custkey % 3 WHEN 0 THEN 'water storage tank' WHEN 1 THEN 'pump' ELSE 'goods' END, ' in ',
  CASE c_nationkey % 5 WHEN 0 THEN 'mild steel' WHEN 1 THEN 'brass' WHEN 2 THEN 'HDPE' WHEN 3 THEN 'copper' ELSE 'wood' END,
  CASE WHEN c_custkey % 2 = 0 THEN ' for drinking water' ELSE '' END, ', capacity ', c_custkey % 90 + 10, ' L, length ', c_custkey % 50 + 1,
  ' mm, as per IS ', c_custkey % 2000 + 1, ':', 1990 + c_custkey % 33, '. ',
  CASE c_custkey % 4 WHEN 0 THEN 'Testing and inspection shall be of good quality. ' WHEN 1 THEN 'Test may be about suitable, about enough. ' ELSE '' END,
  CASE WHEN c_custkey % 3 = 0 THEN 'Safety warning labels.' ELSE 'Goods as per drawing.' END) END AS text FROM customer""",
    "tender_pages": """SELECT concat('T', o_orderkey) AS tender_id, 1 AS page, concat('Supply of ',
  CASE o_orderkey % 5 WHEN 0 THEN 'centrifugal pumps' WHEN 1 THEN concat('Water  storage', chr(10), 'tank') WHEN 2 THEN 'Gas Turbine fuel' WHEN 3 THEN 'pipes, valves and cement' ELSE 'goods' END,
  ', body SS', CASE o_custkey % 3 WHEN 0 THEN '304' WHEN 1 THEN concat('  316', chr(10)) ELSE ' wood' END, ', capacity ', o_custkey % 90 + 10, CASE o_custkey % 4 WHEN 0 THEN 'L' ELSE ' litre' END,
  ' at ', o_orderkey % 50 + 1, 'mm to ', o_orderkey % 7, '.5 bar.') AS text FROM orders
  UNION ALL SELECT concat('T', o_orderkey) AS tender_id, 2 AS page, concat(chr(10), 'Storage tank for aviation', repeat(' and others', CAST(o_orderkey % 30 AS INT)), '; brass, Copper and PVC; ', o_custkey % 9, ' kg by 2 tons',
  repeat('; 4 cm wide', CAST(o_custkey % 10 AS INT)), '; as per IS ', o_custkey % 2000 + 100, ' (Part 2) : 2015, IS 10:2001 and IS 10:2001 ') AS text FROM orders WHERE o_orderkey % 3 <> 0""",
    "edges": "SELECT concat('STD', l_partkey) AS source, concat('STD', l_suppkey) AS target, l_returnflag AS type, l_discount AS confidence FROM lineitem",
    "old_edges": "SELECT DISTINCT concat('STD', l_partkey) AS source, concat('STD', l_suppkey) AS target FROM lineitem WHERE l_returnflag = 'R'",
    "chunks": """SELECT concat('D', doc_id % 97, '_P', doc_id) AS chunk_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE concat('STD', 1 + doc_id % 50) END AS standard_id,
  CASE doc_id % 4 WHEN 0 THEN 'Scope' WHEN 1 THEN 'Test methods' ELSE 'General' END AS section, CAST(1 + doc_id % 10 AS INT) AS page, text || CASE WHEN doc_id % 10 = 0 THEN ' Brass parts as per IS 10:2001' ELSE '' END AS text, doc_id FROM documents""",
    "queries": """SELECT doc_id AS query_id, CASE WHEN doc_id % 1000 = 700 THEN 'zzqx 99999' ELSE text || CASE WHEN doc_id % 200 = 0 THEN ' brass' ELSE '' END
  || CASE WHEN doc_id % 300 = 0 THEN ' IS 10:2001' ELSE '' END END AS query FROM documents WHERE doc_id % 100 = 0""",
    "vectors": "SELECT concat('D', vec_id % 97, '_P', vec_id) AS chunk_id, embedding AS vector FROM embeddings",
    "vector_queries": "SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id % 100 = 0",
    "files": "SELECT concat('IS_', doc_id, '_', 1990 + doc_id % 30, '.pdf') AS path, sha256(text) AS sha, source FROM documents",
    "raw_documents": """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '{"pages": [' WHEN doc_id % 11 = 0 THEN '{"pages": [{"page": "x", "text": "a"}]}'
  ELSE concat('{"pages": [{"page": 1, "text": "', replace(replace(text, chr(92), ''), '"', ''), '", "outline": "', CASE WHEN doc_id % 3 = 0 THEN 'broken' ELSE concat('[[1, ', chr(92), '"Scope', chr(92), '"]]') END,
  '", "tables": ["[[1, 2], [3, null]]"', CASE WHEN doc_id % 5 = 0 THEN ', "[[1"' ELSE '' END, ']}, {"page": 2, "text": null}]}') END AS payload FROM documents""",
    "page_rows": "SELECT source AS doc_id, CAST(1 + doc_id % 10 AS INT) AS page, text, CAST(doc_id % 3 AS INT) AS images, length(text) AS chars, doc_id AS row_id FROM documents",
    "figures": """SELECT concat('STD', l_partkey % 20) AS doc_id, concat('STD', l_partkey) AS standard_id, concat('F', l_orderkey, '_', l_linenumber) AS figure_id, l_linenumber AS page,
  concat('h', l_suppkey % 40) AS pix_hash, l_quantity * 10 AS width, 20 + l_discount * 3000 AS height, l_tax AS y0, l_tax + 0.1 AS y1,
  l_linestatus = 'O' AS caption, l_returnflag = 'A' AS in_section, concat('g', l_suppkey) AS duplicate_group FROM lineitem""",
}


def names(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table, or a given one."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name not in TABLES:
        return read(name)
    sql = TABLES[name].replace("sha256(text)", "sha2(text, 256)")
    source = re.search(r"FROM (\w+)", sql)[1]
    return spark.sql(re.sub(rf"FROM {source}\b", "FROM {base}", sql.replace("{", "{{").replace("}", "}}")), base=read(source))


def with_tables(sql: str) -> str:
    """DuckDB SQL with the domain tables it names in front."""
    found = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    head = ", ".join(f"{t} AS ({TABLES[t]})" for t in found)
    if not found:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:]}"
    return f"WITH {head}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {head} {body}"
