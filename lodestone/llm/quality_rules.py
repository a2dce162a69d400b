"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps one long of
failure bits beside the measurements, so a policy is a mask, a verdict is one
bitwise AND, and an ablation is an aggregation over the distinct bit patterns,
never another pass over the texts. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

# The white space between words, and the characters that count as symbols.
SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """fails: from the measurement columns to a boolean. A rule keeps its bit for ever; policies refer to it by name."""

    bit: int
    name: str
    fails: Callable[[], Column]


RULES = (
    Rule(0, "few_words", lambda: F.col("n_words") < 10),
    Rule(1, "repeated_words", lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    Rule(2, "symbols", lambda: 2 * F.col("n_symbols") > F.col("n_words")),
    Rule(3, "repeated_lines", lambda: (F.col("n_dup_lines") >= 3) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines"))),
    Rule(4, "long_words", lambda: F.col("word_chars") > 20 * F.col("n_words")),
    Rule(5, "capitals", lambda: (F.col("n_upper") >= 20) & (F.col("n_upper") > 2 * F.col("n_lower"))),
)
BASE = ("few_words", "repeated_words")
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "repeated_lines", "long_words", "capitals"),
}
CURRENT = "v2"


def mask(policy: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def _count(text: Column, chars: str) -> Column:
    """How many of these characters the text has."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words from the array `words`: words inside a five-word window that occurs again in the text.

    Windows are compared as 64-bit hashes of word hashes. Texts whose windows
    are all distinct, nearly all of them, stop after one array_distinct; the
    rest sort (hash, position) and compare neighbours.
    """
    n, w = F.size("words"), WINDOW
    df = df.withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))
    df = df.withColumn(
        "windows",
        F.when(
            n >= w,
            F.transform(F.sequence(F.lit(0), n - w), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(w)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.withColumn("sorted", F.when(again, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def twin(x: Column, k: Column) -> Column:
        before, after = F.get("sorted", k - 1)["h"], F.get("sorted", k + 1)["h"]
        return F.when((x["h"] == before) | (x["h"] == after), x["i"])

    places = F.sort_array(F.array_compact(F.transform("sorted", twin)))
    df = df.withColumn("places", F.when(F.col("sorted").isNotNull(), places))
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["total"] + p + w - F.greatest(a["end"], p)).alias("total"), (p + w).alias("end")),
        lambda a: a["total"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, the measurements, fail_bits.

    A null text counts as empty and fails `few_words`; repeated rows give
    repeated rows; other columns are ignored; an empty table gives no rows.
    """
    ws = "[ \\t-\\r]"
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.withColumn("words", F.array_remove(F.split("text", f"{ws}+"), ""))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    df = _repeats(df)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    df = df.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        _count(F.col("text"), upper).alias("n_upper"),
        _count(F.col("text"), upper.lower()).alias("n_lower"),
    )
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(r.fails(), F.lit(1 << r.bit)).otherwise(0).cast("long"))
    return df.withColumn("fail_bits", bits)


def verdict(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Adds base_failed and kept. The base rules hold whatever the policy."""
    base = sum(1 << r.bit for r in RULES if r.name in BASE)
    failed = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")) != 0
    return rows.withColumn("base_failed", failed(base)).withColumn("kept", ~failed(base | mask(policy)))


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: rows that fail it, rows that fail it alone (kept again without it), and rows kept with and without it.

    Works from counts of the distinct bit patterns, at most 2 ** rules rows.
    """
    m = mask(policy)
    patterns = rows.select(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in POLICIES[policy]])
    one = patterns.select("bits", "n", F.explode(rules).alias("r"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return one.groupBy(F.col("r.rule").alias("rule")).agg(
        total(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("failed"),
        total(F.col("bits") == F.col("r.bit")).alias("failed_alone"),
        total(F.col("bits") == 0).alias("kept"),
        total(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("kept_without_rule"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verdict(ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t,
    list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5
), k AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i + 4], ' ')) AS n FROM g
), p AS (
  SELECT r, count(DISTINCT i + j) AS n FROM k, range(0, 5) AS o(j) WHERE n >= 2 GROUP BY r
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
    length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS n_lower
  FROM w LEFT JOIN p USING (r)
), b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 2 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END
    + CASE WHEN n_upper >= 20 AND n_upper > 2 * n_lower THEN 32 ELSE 0 END)::BIGINT AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM b
"""
