"""Secret scan with corpus-wide ownership frequency.

One pass over the texts finds credential-shaped spans and hashes their values.
Every value is then counted by the distinct repositories and owners that hold
it: a value that many owners share is a copied example, a value that few hold
is taken for a live credential. The base kinds are always reported; spans of
the generic `token` kind are reported only for owner-specific values.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import staged, table

# The base patterns, in their listed order, with the least length of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "token")

TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
TOKEN_BITS = 3.2
"""A generic token needs a digit, letters of both cases, and this entropy a character."""
HINTS = ("passw", "secret", "token", "apikey", "api_key")
SHARE, FEWEST, MOST = 0.1, 2, 20
"""A value is a copied example if this share of all owners holds it: FEWEST at least, and MOST are enough."""


def entropy(value: str) -> float:
    counts, n = Counter(value).values(), len(value)
    return -sum(c / n * math.log2(c / n) for c in counts)


def scan(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of each span, in code points, by start and then by kind as listed."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                found.append((m.start(), m.end(), 0, m[2]))
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    taken = [(a, b) for a, b, _, _ in found]
    for m in TOKEN.finditer(text):
        v = m[0]
        if re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v) and entropy(v) >= TOKEN_BITS:
            if not any(a < m.end() and m.start() < b for a, b in taken):
                found.append((m.start(), m.end(), 3, v))
    return [(a, b, KINDS[k], v) for a, b, k, v in sorted(found, key=lambda x: (x[0], x[2]))]


SCANNED = "doc_id {id}, repository string, owner string, text_md5 string, spans array<struct<start: int, end: int, kind: string, hash: string>>"


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("hash", pa.string())]))
    for b in batches:
        md5s, spans = [], []
        for text in b.column("text").to_pylist():
            found = scan(text)
            md5s.append(hashlib.md5(text.encode()).hexdigest() if found else None)
            spans.append([{"start": s, "end": e, "kind": k, "hash": hashlib.sha256(v.encode()).hexdigest()} for s, e, k, v in found])
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("repository"), b.column("owner"), pa.array(md5s, pa.string()), pa.array(spans, span)],
            names=["doc_id", "repository", "owner", "text_md5", "spans"],
        )


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "source", owner_col: str | None = None) -> DataFrame:
    """One row per document row with its spans; written once, since both the counts and the result read it. Without an owner column the repository stands for its owner."""
    kind = docs.schema[id_col].dataType.simpleString()
    df = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.col(repository_col).cast("string").alias("repository"),
        F.col(owner_col or repository_col).cast("string").alias("owner"),
    )
    return staged(df.mapInArrow(_scan_batches, SCANNED.format(id=kind)), "secrets")


def ownership(found: DataFrame, owners: int | None = None) -> DataFrame:
    """One row per distinct value hash: n_docs, n_repositories, n_owners, verdict `example` or `live`. Without a number of owners a tenth of all are needed (SHARE, FEWEST, MOST).

    Rows of a value are first summed by (value, repository, owner), so a value
    in a third of all documents is a few rows by the time it is counted. A null
    repository or owner counts as one.
    """
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    one = found.select("repository", "owner", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    held = one.groupBy("hash", "repository", "owner").agg(F.count("*").alias("n"))
    by = lambda c: F.count_distinct(named(c))
    counts = held.groupBy("hash").agg(F.sum("n").alias("n_docs"), by("repository").alias("n_repositories"), by("owner").alias("n_owners"))
    if owners is None:
        everyone = found.agg(F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), F.ceil(SHARE * F.count_distinct(named("owner"))))).alias("needed"))
        counts = counts.crossJoin(F.broadcast(everyone))  # one row
    else:
        counts = counts.withColumn("needed", F.lit(owners))
    return counts.withColumn("verdict", F.when(F.col("n_owners") >= F.col("needed"), "example").otherwise("live")).drop("needed")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "source", owner_col: str | None = None, owners: int | None = None) -> DataFrame:
    """One row per document row: doc_id, text_md5 (null without spans), spans as an array with start, end, kind, hash, n_owners, n_repositories and verdict.

    Null texts hold no spans; repeated rows give repeated rows; equal doc_ids
    with different texts stay apart; other columns are ignored.
    """
    found = scanned(docs, id_col, text_col, repository_col, owner_col)
    # nearly every value is one document's own: only what several documents hold comes back
    shared = ownership(found, owners).where("n_docs > 1 OR verdict = 'example'").select("hash", F.struct("hash", "n_owners", "n_repositories", "verdict").alias("known"))
    held = found.select("doc_id", "text_md5", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash")).distinct()
    marks = held.join(shared, "hash").groupBy(F.col("doc_id").alias("of"), F.col("text_md5").alias("md5")).agg(F.collect_list("known").alias("known"))
    out = found.join(marks, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_md5") == F.col("md5")), "left")
    alone = F.struct(F.lit("").alias("hash"), F.lit(1).cast("bigint").alias("n_owners"), F.lit(1).cast("bigint").alias("n_repositories"), F.lit("live").alias("verdict"))
    of = lambda s: F.coalesce(F.get(F.filter("known", lambda k: k["hash"] == s["hash"]), 0), alone)
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["hash"].alias("hash"), *[of(s)[c].alias(c) for c in ("n_owners", "n_repositories", "verdict")]))
    return out.select("doc_id", "text_md5", F.filter(spans, lambda s: (s["kind"] != "token") | (s["verdict"] == "live")).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, overlapping ones merged, replaced by the mark."""
    done = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
            F.greatest(a["at"], s["end"]).alias("at"),
        ),
    )
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "token")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["verdict"] == "live")).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: s["verdict"] == "example")).cast("long").alias("n_example"),
        # of the values in the document, the most owners and repositories that hold one
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["n_owners"])), F.lit(0)).cast("long").alias("most_owners"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["n_repositories"])), F.lit(0)).cast("long").alias("most_repositories"),
    )
