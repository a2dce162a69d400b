"""Language identification by error-correcting output codes.

Each language gets a codeword; one binary classifier on hashed character
n-grams predicts each bit; a text's language is the codeword with the least
loss, each bit's loss weighted by how well its classifier did in training. A
small gap to the second codeword flags the text as ambiguous.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import table

DIMS = 4096
TRAIN_DOCS = 2000
"""The most labelled documents the model is fitted on, shared evenly among the languages; the rest of the labelled documents are not needed for the fit."""
MARGIN = 0.1
"""A text whose best and second-best codewords differ by less in mean weighted loss is ambiguous."""
TEXTS = 256
"""Texts whose features are held at a time."""
MULTIPLIERS = ((1,), (1, 31), (1, 31, 961))
"""Hash multipliers of single characters, pairs and triples."""


def features(text: str) -> np.ndarray:
    """Hashed 1- to 3-gram shares of the whole text, square-rooted and of unit length. ASCII characters other than letters count as a space."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((codes < 128) & ((codes < 97) | (codes > 122)), np.uint32(32), codes)
    v = np.zeros(DIMS)
    for order, ms in enumerate(MULTIPLIERS):
        n = len(codes) - len(ms) + 1
        h = np.zeros(n, np.uint32)
        for k, m in enumerate(ms):
            h += codes[k : k + n] * np.uint32(m)
        h = (h * np.uint32(2654435761) + np.uint32(order * 97)) >> np.uint32(20)
        v += np.bincount(h, minlength=DIMS) / n
    v = np.sqrt(v)
    return (v / np.sqrt(v @ v)).astype(np.float32)


def lettered(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1: every split of up to five classes; beyond that 15 bits or more, random with a fixed seed, at the best least distance of 200 draws."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 5:
        bits = np.array([[(b >> i) & 1 for b in range(1, 2 ** (n - 1))] for i in range(n)])
        return np.where(bits, 1.0, -1.0)
    rng, width = np.random.default_rng(7), max(15, int(np.ceil(10 * np.log2(n))))
    draws = [np.where(rng.random((n, width)) < 0.5, 1.0, -1.0) for _ in range(200)]
    return max(draws, key=lambda c: min((c[i] != c[j]).sum() for i in range(n) for j in range(i)))


@dataclass(frozen=True)
class Model:
    langs: list[str]
    code: np.ndarray  # langs x bits
    weights: np.ndarray  # dims x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit, summing to 1

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each text; ('und', 0.0, True) for a null text or one without a letter."""
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        at = [i for i, t in enumerate(texts) if lettered(t)] if self.langs else []
        if not at:
            return out
        margins = np.tanh(np.stack([features(texts[i]) for i in at]) @ self.weights + self.bias)
        loss = ((1 - margins[:, None, :] * self.code[None]) / 2 * self.trust).sum(axis=2)
        share = np.exp(-loss / 0.1)
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        ordered = np.sort(loss, axis=1)
        gap = ordered[:, 1] - ordered[:, 0] if len(self.langs) > 1 else np.ones(len(at))
        for k, i in enumerate(at):
            out[i] = (self.langs[best[k]], float(share[k, best[k]]), bool(gap[k] < MARGIN))
        return out


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """Logistic regression for each bit, by full-batch gradient steps with momentum; deterministic."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((0, 0)), np.zeros((DIMS, 0)), np.zeros(0), np.zeros(0))
    y = np.array([names.index(v) for v in langs])
    code = codewords(len(names))
    target = code[y]
    counts = np.bincount(y, minlength=len(names))
    share = (1 / counts[y] / len(names))[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(150):
        g = (-target / (1 + np.exp(target * (x @ w + b))) * share).astype(np.float32)
        vw = 0.9 * vw - 4.0 * (x.T @ g + 1e-5 * w)
        vb = 0.9 * vb - 4.0 * g.sum(axis=0)
        w, b = w + vw, b + vb
    right = ((np.sign(x @ w + b) == target) * share).sum(axis=0)
    trust = np.log(np.clip(right, 0.501, 0.999) / (1 - np.clip(right, 0.501, 0.999)))
    return Model(names, code, w / 2, b / 2, trust / trust.sum())


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS) -> DataFrame:
    """At most `most` rows (lang, h, text), shared evenly: per language the documents with the least hashes of id and text, repeated rows once.

    Every language of a labelled text with a letter has a row; of more than
    `most` languages the commonest are taken.
    """
    df = docs.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    df = df.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    langs = df.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("rows")).orderBy(F.desc("n"), "lang").limit(most).collect()
    each = max(1, most // max(1, len(langs)))
    # first by a hash threshold that leaves about twice the wanted documents and some more, all of a language with few; those are then ranked
    top = [(r["lang"], min(2**63 - 1, int(-(2**63) + min(1.0, (2 * each + 40) / max(1, r["rows"])) * 2**64))) for r in langs]
    cut = docs.sparkSession.createDataFrame(top, "lang string, cut bigint")
    held = df.join(F.broadcast(cut), "lang").where("h <= cut").groupBy("lang", "h").agg(F.min("text").alias("text"))  # at most `most` rows are broadcast
    return held.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("place") <= each).select("lang", "h", "text")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS) -> Model:
    """Fitted on a bounded sample of the labelled documents (`sample`), in one task: at most `most` rows of 8 KB. Only the model comes to the driver.

    Documents with a null label, a null text or no letter are not used. Without
    any other the model has no languages.
    """
    chosen = sample(docs, id_col, text_col, lang_col, most).mapInArrow(_chosen, "lang string, h bigint, x binary")
    found = chosen.repartition(1).mapInArrow(_fitted, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit(np.zeros((0, DIMS), np.float32), [])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("lang", "h", "x"))))
    if rows:
        x = np.stack([np.frombuffer(r[2], np.float16) for r in rows]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(x, [r[0] for r in rows]))], pa.binary())], names=["model"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t).astype(np.float16).tobytes() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), pa.array(rows, pa.binary())], names=["lang", "h", "x"])


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs, without the text if so asked, with lang_pred, score and ambiguous added, from the text alone.

    Null texts and texts without a letter get `und`, score 0 and ambiguous; an
    untrained model gives every text `und`. Columns of those names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # dims x bits floats, whatever the input
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    df = docs.select(*[F.col(f"`{c}`") for c in keep])
    left = df if keep_text else df.drop(text_col)
    schema = T.StructType([*left.schema.fields]).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    left_names = left.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [g for k in range(0, b.num_rows, TEXTS) for g in held.value.predict(b.column(text_col).slice(k, TEXTS).to_pylist())]
            more = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in left_names], *more], names=[*left_names, "lang_pred", "score", "ambiguous"])

    return df.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    rows = identify(docs.select("doc_id", "text").withColumn("held_out", held_out()), model, keep_text=False)
    return rows.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
