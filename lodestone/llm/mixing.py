"""Mixing sources by temperature.

Each source's share of all tokens is raised to an exponent and normalised: 1
keeps the shares, 0 makes them equal. The exponent is found by bisection, the
largest whose weights reach a target entropy, raised again as far as needed so
that no source is repeated more often than a limit. Weights then become token
budgets, as many passes over each source's blocks as its budget holds, in a
fresh permutation each pass, the last one cut where the budget ends.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import staged, table

ENTROPY = 0.95
"""Target entropy as a share of the largest possible, that of equal weights."""
REPEATS = 2.0
"""The most passes over any source."""
BLOCK_DOCS = 1000
"""About so many documents a block, so a block is a task's small work whatever the source's size."""
STEPS = 60
SECTIONS = 32
COPIES = 1000
"""The most copies of a repeated row that are dealt to one block."""


def exponent(per_source: DataFrame, target: float = ENTROPY, most: float = REPEATS) -> float:
    """The exponent for a table of (source, tokens), 1 where no source has tokens or all have the same.

    An interval that holds it is cut into SECTIONS again and again, the entropy
    at all cuts summed in one pass over the table; no source comes to the
    driver. The repetition limit, by the largest and the smallest source, wins.
    """
    some = per_source.where("tokens > 0")
    n, small, large = some.agg(F.count("*"), F.min("tokens"), F.max("tokens")).first()
    if not n or small == large:
        return 1.0
    x = F.col("tokens") / F.lit(float(large))
    lo, hi = 0.0, 1.0
    while hi - lo > 1e-9:
        cuts = [lo + (hi - lo) * k / SECTIONS for k in range(1, SECTIONS + 1)]
        sums = some.agg(*[F.sum(F.pow(x, F.lit(a))) for a in cuts], *[F.sum(F.pow(x, F.lit(a)) * F.ln(x)) for a in cuts]).first()
        # entropy falls as the exponent rises
        ok = [(math.log(s) - a * t / s) / math.log(n) >= target for a, s, t in zip(cuts, sums[:SECTIONS], sums[SECTIONS:])]
        k = ok.index(False) if False in ok else SECTIONS
        if k == SECTIONS:
            lo = cuts[-1]
            break
        lo, hi = cuts[k - 1] if k else lo, cuts[k]
    low, high = 0.0, 1.0  # passes over the smallest source fall as the exponent rises
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (low, mid) if (large / small) ** (1 - mid) <= most else (mid, high)
    return max(lo, high if (large / small) ** 1.0 > most else 0.0)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, tokens, text_hash) of each document: tokens are words; a null source is the source ''."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), "[ \\t-\\r]+"), "")).cast("bigint").alias("tokens"),
        F.xxhash64(text_col).alias("text_hash"),
    )


def schedule(sized: DataFrame, target: float = ENTROPY, most: float = REPEATS, seed: int = 1) -> DataFrame:
    """One row per use of a document: the columns of sized, which has doc_id, source and tokens, with pass, block, offset and place.

    offset counts the source's tokens before it, place = offset / budget lies in
    [0, 1) and orders the mix, so every source is spread evenly over it. A use
    belongs to the mix if its first token does. Documents without tokens, and
    those of a source without any, are used once, at the offset they meet.
    Repeated rows are separate documents; they are counted first and dealt out
    COPIES at a time. An empty table gives no rows.

    Only per-block sums are ordered within a source; documents are ordered
    within blocks, which hashing keeps small, so a hot source is many tasks.
    """
    names = sized.columns
    same = staged(sized.groupBy(*names).agg(F.count("*").alias("copies")), "mixing-sizes")
    per_source = same.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("of"), F.sum("copies").alias("docs"))
    per_source = staged(per_source, "mixing-sources")
    a = exponent(per_source.withColumnRenamed("of", "tokens"), target, most)
    # the largest source is the least repeated one and is passed once, so that no document is left out
    largest = per_source.agg(F.max("of").alias("largest"))
    times = F.when(F.col("of") > 0, F.pow(F.col("of") / F.col("largest"), F.lit(a - 1))).otherwise(1.0)
    passes = per_source.crossJoin(F.broadcast(largest)).withColumn("times", times)  # one row
    whole = F.greatest(F.lit(1), F.ceil(F.col("times") - 1e-9)).cast("int")
    passes = passes.select("source", "of", (F.col("times") * F.col("of")).alias("budget"), F.greatest(F.lit(1), F.expr(f"docs div {BLOCK_DOCS}")).alias("blocks"), F.explode(F.sequence(F.lit(0), whole - 1)).alias("pass"))
    passes = staged(passes, "mixing-passes")  # so that its size is known and Spark sends it to all tasks only if it is small
    deal = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(copies - 1) div {COPIES}"))).alias("deal")
    used = same.select(*names, "copies", deal).withColumn("copies", F.least(F.lit(COPIES), F.col("copies") - COPIES * F.col("deal")))
    used = used.join(passes, "source").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), *names, "deal"), "blocks"))
    # by block, lest what follows takes the join's dealing by source as good enough
    used = used.repartition("source", "pass", "block")
    total = F.col("tokens") * F.col("copies")
    mixed = F.xxhash64(F.lit(seed), "source", "pass", "block")
    blocks = used.groupBy("source", "pass", "block").agg(F.sum(total).alias("block_tokens")).withColumn("order", mixed)
    before = W.partitionBy("source", "pass").orderBy("order", "block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumn("block_at", F.coalesce(F.sum("block_tokens").over(before), F.lit(0))).select("source", "pass", "block", "block_at")
    inside = W.partitionBy("source", "pass", "block").orderBy(F.xxhash64(F.lit(seed), "pass", *names, "deal"), *names, "deal").rowsBetween(W.unboundedPreceding, -1)
    used = used.join(blocks, ["source", "pass", "block"])
    used = used.withColumn("at", F.col("pass") * F.col("of") + F.col("block_at") + F.coalesce(F.sum(total).over(inside), F.lit(0)))
    used = used.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))).withColumn("offset", (F.col("at") + F.col("copy") * F.col("tokens")).cast("bigint"))
    # the first pass is always whole: the budget holds it by choice of the least repeated source
    used = used.where((F.col("offset") < F.col("budget")) | (F.col("pass") == 0))
    place = F.when(F.col("budget") > 0, F.least(F.col("offset") / F.col("budget"), F.lit(1 - 2.0**-53))).otherwise(0.0)
    return used.select("doc_id", "source", "pass", "block", "tokens", "offset", place.alias("place"), *[c for c in names if c not in ("doc_id", "source", "tokens")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(sizes(table(spark, sf_dir, "documents"))).drop("text_hash")
