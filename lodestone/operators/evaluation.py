"""Retrieval metrics over whole tables of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import rounded, word_set


def judged(runs: DataFrame, relevant: DataFrame) -> DataFrame:
    """runs (model, query_id, rank, doc_id) with `hit`, ids compared in lower case with - as _."""
    norm = lambda c: F.replace(F.lower(F.col(c).cast("string")), F.lit("-"), F.lit("_"))
    r = relevant.select("query_id", norm("doc_id").alias("key")).distinct().withColumn("yes", F.lit(1))
    return runs.withColumn("key", norm("doc_id")).join(r, ["query_id", "key"], "left").withColumn("hit", F.coalesce("yes", F.lit(0))).drop("yes", "key")


def judged_by_class(runs: DataFrame, asked: DataFrame, classes: DataFrame) -> DataFrame:
    """judged() where all documents of a query's class (asked: query_id, label) are relevant (classes: doc_id, label): each result looks up two labels, and pairs of a query and a relevant document are never listed."""
    own = runs.join(asked.select("query_id", F.col("label").alias("wanted")).distinct(), "query_id", "left")
    got = own.join(classes.select("doc_id", "label").distinct(), "doc_id", "left")
    hit = F.coalesce(F.max(F.when(F.col("wanted") == F.col("label"), 1)), F.lit(0))
    return got.groupBy(*runs.columns).agg(hit.alias("hit"))


def relevant_by_class(asked: DataFrame, classes: DataFrame) -> DataFrame:
    """(query_id, n_relevant): the size of a query's class, counted once a class."""
    n = classes.where("label IS NOT NULL").select("doc_id", "label").distinct().groupBy("label").agg(F.count("*").alias("n"))
    return asked.select("query_id", "label").distinct().join(n, "label").groupBy("query_id").agg(F.sum("n").alias("n_relevant"))


def per_query(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """Precision, recall, reciprocal rank, any hit and false positives of each model and query; k stays k where a list is shorter. relevant has pairs (query_id, doc_id), or their number (query_id, n_relevant)."""
    n = relevant if "n_relevant" in relevant.columns else relevant.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    at = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0))
    q = hits.groupBy("model", "query_id").agg(at(5).alias("h5"), at(10).alias("h10"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.count_if((F.col("rank") <= 5) & (F.col("hit") == 0)).alias("false5"))
    q = q.join(n, "query_id", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))
    recall = lambda h: F.when(F.col("n_relevant") > 0, rounded(F.col(h) / F.col("n_relevant"), 4)).otherwise(0.0)
    return q.select(
        "model",
        "query_id",
        "n_relevant",
        (F.col("h5") / 5).alias("p5"),
        (F.col("h10") / 10).alias("p10"),
        recall("h5").alias("r5"),
        recall("h10").alias("r10"),
        rounded(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("mrr"),
        F.when(F.col("h5") > 0, 1.0).otherwise(0.0).alias("exact5"),
        (F.col("false5") / 5).alias("fp5"),
    )


METRICS = ("r5", "r10", "p5", "p10", "mrr", "exact5", "sem5", "fp5")
"""In the order of the comparison; all but the last are better when higher."""


def macro(q: DataFrame) -> DataFrame:
    """Means by model: over queries with relevant documents, false positives over all. Topic relevance (sem5) is averaged where it is there."""
    mean = lambda m: F.avg(F.col(m) if m == "fp5" else F.when(F.col("n_relevant") > 0, F.col(m)))
    return q.groupBy("model").agg(*[rounded(mean(m), 4).alias(m) for m in METRICS if m in q.columns])


def topic_relevance(hits: DataFrame, topics: DataFrame, body: str = "text") -> DataFrame:
    """Mean share of a query's topic words in its first five results."""
    t = word_set("topics")
    j = hits.where("rank <= 5").join(topics.select("query_id", t.alias("t")), "query_id")
    share = F.when(F.size("t") > 0, F.size(F.array_intersect("t", word_set(body))) / F.size("t")).otherwise(0.0)
    return j.groupBy("model", "query_id").agg(rounded(F.avg(share), 4).alias("sem5"))


def place(models: list[str]) -> Column:
    """A model's place in the list; one that isn't listed comes last."""
    of = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    return F.when(of > 0, of).otherwise(len(models) + 1)


def winner(m: DataFrame, models: list[str]) -> DataFrame:
    """Models of macro() with sem5, with their composite score, the best marked; of equals the first of the list."""
    s = 0.25 * F.col("r5") + 0.15 * F.col("r10") + 0.20 * F.col("p5") + 0.20 * F.col("mrr") + 0.10 * F.col("exact5") - 0.03 * F.col("fp5") + 0.07 * F.col("sem5")
    s = m.select("model", rounded(s, 6).alias("score"))
    best = s.agg(F.min_by("model", F.struct((-F.col("score")), place(models), "model")).alias("best"))
    return s.crossJoin(F.broadcast(best)).select("model", "score", (F.col("model") == F.col("best")).alias("winner"))  # one row


def compared(m: DataFrame, models: list[str]) -> DataFrame:
    """Metrics down, models across, and `best`: the model with the highest value, of false positives with the lowest, of equals the first of the list."""
    long = m.unpivot("model", [c for c in METRICS if c in m.columns], "metric", "value")
    better = F.when(F.col("metric") == "fp5", F.col("value")).otherwise(-F.col("value"))
    best = long.groupBy("metric").agg(F.min_by("model", F.struct(better.alias("v"), place(models).alias("p"))).alias("best"))
    return long.groupBy("metric").pivot("model", models).agg(F.first("value")).join(best, "metric")


def hit_rate(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, hit1, hit5): whether the expected string is part of the first, or one of the first five, ids."""
    j = runs.join(expected, "query_id")
    has = F.contains(F.lower("doc_id"), F.lower("expected"))
    return j.groupBy("query_id").agg(F.max(F.when(has & (F.col("rank") == 1), 1).otherwise(0)).alias("hit1"), F.max(F.when(has & (F.col("rank") <= 5), 1).otherwise(0)).alias("hit5"))


def hit_summary(rates: DataFrame, least: float = 0.6) -> DataFrame:
    """One row: queries, hits at 1 and 5, their shares, and PASS where the share at 5 reaches `least`, else WARN; no queries are a WARN."""
    n = rates.agg(F.count("*").alias("queries"), F.coalesce(F.sum("hit1"), F.lit(0)).alias("hits1"), F.coalesce(F.sum("hit5"), F.lit(0)).alias("hits5"))
    share = lambda c: rounded(F.when(F.col("queries") > 0, F.col(c) / F.col("queries")).otherwise(0.0), 4)
    return n.select("queries", "hits1", "hits5", share("hits1").alias("share1"), share("hits5").alias("share5"), F.when((F.col("queries") > 0) & (F.col("hits5") >= least * F.col("queries")), "PASS").otherwise("WARN").alias("status"))


def invented(runs: DataFrame, corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    """Results that the corpus doesn't have; there should be none."""
    return runs.join(corpus.select(key), key, "left_anti")
