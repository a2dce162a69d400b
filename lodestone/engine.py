"""What a user asks: whole tables of queries or tenders in, DataFrames out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions.identifiers import base
from lodestone.functions.text import stripped, text
from lodestone.operators import analysis, graph, ranking, search, tender
from lodestone.operators.joins import by_sorting
from lodestone.sources.files import work_folder

STAGES = ("understand", "ranking", "evidence", "gaps", "conflicts", "quality", "traceability", "specification", "save_workspace", "version_check")
DEPENDENT = ("ranking", "evidence")
"""Stages without which the rest goes on, with no recommendations."""
RECOMMENDED = "tender_id string, standard_id string, rank int, score double, evidence_chunks array<string>"
SPECIFIED = "tender_id string, spec_ord int, standard_id string, spec_id string, property string, value string, nominal double, unit string, material string, tolerance string, page int, section string, evidence string"


@dataclass
class Report:
    """A run's tables by stage, a status a stage (stage, status, error, rows), and a status a tender (tender_id, status, error)."""

    tables: dict[str, DataFrame]
    stages: DataFrame
    tenders: DataFrame


@dataclass
class Engine:
    """chunks (chunk_id, standard_id, section, page, text), standards, and where there are any vectors (chunk_id, vector), a written lexical index and the standards' specifications."""

    chunks: DataFrame
    standards: DataFrame
    vectors: DataFrame | None = None
    index: search.Index | None = None
    specs: DataFrame | None = None
    settings: config.Config = field(default_factory=config.Config)

    def search(self, queries: DataFrame, mode: str = "lexical", k: int = 20) -> DataFrame:
        """(query_id, chunk_id, score, rank). queries has query_id with query, vector or both, as the mode asks. Hybrid merges the best 20 of each, with a bonus for identifiers that the query names."""
        if mode not in ("lexical", "semantic", "hybrid"):
            raise ValueError(f"no such mode: {mode}")
        if mode != "lexical" and self.vectors is None:
            raise ValueError("there is no vector index")
        if mode == "lexical":
            found = search.lexical(queries, self.index or self.chunks, k)
        elif mode == "semantic":
            found = search.semantic(queries, self.vectors, k)
        else:
            found = search.hybrid(queries, self.chunks, self.vectors, self.index, c=self.settings).where(F.col("rank") <= k)
        return found.select("query_id", "chunk_id", "score", "rank")

    def recommend(self, queries: DataFrame) -> DataFrame:
        """Standards of each query by rank, from the fused lists of both searches, with the query's decision and confidence; a query without any is there once."""
        hits = self.search(queries, "hybrid", 40).join(ranking.named(self.chunks), "chunk_id")
        ranked = ranking.ranked(hits, self.standards, queries, self.settings)
        return ranking.decided(ranked, queries, self.settings).join(ranked.select("query_id", "standard", "score", "rank"), "query_id", "left")

    def analyse(self, tenders: DataFrame, specs: DataFrame) -> dict[str, DataFrame]:
        """Every stage by name. specs has the specifications of each tender's standards; a stage that fails leaves the others as they are, since each is a plan of its own."""
        reqs = tender.requirements(tenders)
        params = tender.traceable(reqs)
        matches = tender.best_match(params, specs)
        issues = tender.issues(reqs)
        return {
            "requirements": reqs,
            "gaps": tender.gaps(reqs),
            "issues": issues,
            "quality": tender.scores(reqs, issues),
            "ambiguity": tender.ambiguity(tenders),
            "comparison": analysis.comparison(reqs, specs),
            "value_conflicts": analysis.value_conflicts(reqs, specs),
            "material_conflicts": analysis.material_conflicts(reqs, specs),
            "traceability": matches,
            "specification": analysis.specification(params, matches, specs),
        }

    def recommended(self, queries: DataFrame, most: int = 5) -> DataFrame:
        """(tender_id, standard_id, rank, score, evidence_chunks): the first standards of each query that the corpus has. Queries without a vector, or an engine without vectors, are searched by their words; those of one wording are ranked once then."""
        if "vector" not in queries.columns:
            queries = queries.withColumn("vector", F.lit(None).cast("array<float>"))
        each = None
        if self.vectors is None:
            # a query_id may have several rows: they are its wording together
            path = work_folder(queries.sparkSession, "wordings")
            own = queries.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("query"))).alias("wording"))
            once = own.groupBy("wording").agg(F.min("query_id").alias("one"))
            each = by_sorting(own).join(once, "wording").select("one", "query_id")
            queries.join(once.select(F.col("one").alias("query_id")), "query_id", "left_semi").write.parquet(path)
            queries = queries.sparkSession.read.parquet(path)
            hits = search.fused(search.merged(search.none(queries), search.lexical(queries, self.index or self.chunks, c=self.settings)), c=self.settings)
        else:
            hits = self.search(queries, "hybrid", 40)
        ranked = ranking.ranked(hits.select("query_id", "chunk_id", "score").join(ranking.named(self.chunks), "chunk_id"), self.standards, queries, self.settings).where(F.col("rank") <= most)
        if each is not None:
            ranked = ranked.withColumnRenamed("query_id", "one").join(each, "one")
        return ranked.select(F.col("query_id").cast("string").alias("tender_id"), F.col("standard").alias("standard_id"), "rank", "score", "evidence_chunks")

    def specified(self, recommended: DataFrame, most: int = 12) -> DataFrame:
        """The specifications that are evidence for recommended standards, twelve a standard at most, each with the page and text of the standard's first evidence chunk; spec_ord follows the standards' ranks."""
        own = ("standard_id", "spec_id", "page", "property", "value", "nominal", "unit", "material", "tolerance", "confidence")
        wanted = recommended.select("standard_id").distinct()
        rows = ranking.confident(self.specs.join(wanted, "standard_id", "left_semi"), self.settings.spec_confidence).select(*own).distinct()
        order = F.struct("page", *(c for c in own if c not in ("standard_id", "page")))
        first = ranking.top_of(rows.withColumn("at", order), ["standard_id"], "at", most).groupBy("standard_id").agg(F.sort_array(F.collect_list("at")).alias("specs"))
        # pages and texts are met before the specifications are spread, then a tender's rows stay together
        cited = recommended.select("tender_id", "standard_id", "rank", F.get("evidence_chunks", 0).alias("chunk_id"))
        page = self.chunks.select("chunk_id", F.col("page").cast("int").alias("page"), F.substring(text("text"), 1, 200).alias("evidence"))
        page = page.join(cited.select("chunk_id").distinct(), "chunk_id", "left_semi")
        each = cited.join(page, "chunk_id", "left").join(first, "standard_id").repartition("tender_id")
        each = each.select("tender_id", "standard_id", "rank", "page", "evidence", F.posexplode("specs").alias("n", "s"))
        return each.select(
            "tender_id", (F.col("rank") * 100 + F.col("n")).cast("int").alias("spec_ord"), "standard_id", "s.spec_id", "s.property", "s.value", F.col("s.nominal").cast("double").alias("nominal"), "s.unit", "s.material", "s.tolerance",
            "page", F.lit(None).cast("string").alias("section"), text("evidence").alias("evidence"),
        )

    def run(self, tenders: DataFrame, folder: str) -> Report:
        """The ten stages over a table of tenders (tender_id, text), each fed by those before it and written below `folder` when it is done.

        A stage that fails leaves its error in the report and an empty table;
        the others go on. Without `understand` nothing can: the run is an error.
        Tenders without text are errors of their own. Any other failure makes
        the run partial.
        """
        spark, tables, told = tenders.sparkSession, {}, []
        tenders = tenders.select(F.col("tender_id").cast("string").alias("tender_id"), "text")
        good = tenders.where(stripped("text") != "")

        def stage(name: str, build: Callable[[], DataFrame], schema: str = "tender_id string") -> DataFrame:
            try:
                build().write.mode("overwrite").parquet(f"{folder}/{name}")
                tables[name] = spark.read.parquet(f"{folder}/{name}")
                told.append((name, "success", None, tables[name].count()))
            except Exception as e:  # whatever goes wrong in a stage is its own
                tables[name] = spark.createDataFrame([], schema)
                told.append((name, "error", str(e).split("\n")[0][:500], 0))
            return tables[name]

        def understood() -> DataFrame:
            reqs = tender.requirements(good)
            built = tender.query_text(reqs, tender.keywords(good)).withColumnRenamed("query", "built")
            return ranking.understood(reqs.join(by_sorting(built), "tender_id"))

        reqs = stage("understand", understood)
        if told[-1][1] == "success":
            recs = stage("ranking", lambda: self.recommended(reqs.select(F.col("tender_id").alias("query_id"), F.col("query_text").alias("query"))), RECOMMENDED)
            specs = stage("evidence", lambda: self.specified(recs), SPECIFIED)
            params = tender.traceable(reqs)
            # dealt out by tender once for all that looks for its first standards
            near = specs.repartition("tender_id")
            stage("gaps", lambda: tender.gap_evidence(tender.gaps(reqs), near))
            stage("conflicts", lambda: analysis.conflicts(reqs, near, recs, self.standards))
            stage("quality", lambda: tender.scores(reqs, tender.issues(reqs)))
            matches = stage("traceability", lambda: tender.best_match(params, specs))
            stage("specification", lambda: analysis.specification(params, matches, analysis.first_standards(near, 3)))
            stage("save_workspace", lambda: graph.requirement_rows(reqs))
            known = self.standards.withColumn("base", base("normalized_identifier"))
            stage("version_check", lambda: ranking.newer_editions(tender.reference_rows(reqs), known))
        status = "error" if told[0][1] == "error" else "partial" if any(x[1] == "error" for x in told) else "success"
        errors = "; ".join(f"{n}: {e}" for n, s, e, _ in told if s == "error") or None
        stages = spark.createDataFrame(told, "stage string, status string, error string, rows bigint")
        blank = F.coalesce(stripped("text") == "", F.lit(True))
        each = tenders.select("tender_id", F.when(blank, "error").otherwise(status).alias("status"), F.when(blank, "text required").otherwise(F.lit(errors)).alias("error"))
        return Report(tables, stages, each)
