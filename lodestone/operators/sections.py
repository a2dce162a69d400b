"""Pages to sections and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions.text import normalised, stripped, text, token_estimate

NUMBERED = r"(?i)^\s*([0-9]+(?:\.[0-9]+)*|[A-Z]\.[0-9]+|Annex\s+[A-Z])\s+(.+)$"
ANNEX = r"(?i)^\s*Annex\s+([A-Z])(?:[^A-Za-z0-9_]|$)"
KINDS = ("numbered", "known", "annex")
KNOWN = r"(?i)^\s*(?:[0-9]+(?:\.[0-9]+)*\s+)?(" + "|".join(config.HEADINGS) + r")\s*$"


def lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, line): lines of 1 to 120 characters, trimmed."""
    each = pages.select("doc_id", "page", F.posexplode(F.split(text("text"), "\n")).alias("line_no", "line"))
    return each.withColumn("line", F.trim("line")).where("line <> '' AND length(line) <= 120")


def headings(each: DataFrame, known: str = KNOWN, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Lines that are headings of the asked kinds, with number and title: numbered ones of at most 8 words without a full stop, known names, annexes."""
    number, title = F.regexp_extract("line", NUMBERED, 1), F.trim(F.regexp_extract("line", NUMBERED, 2))
    numbered = (number != "") & (F.size(F.split(title, r"\s+")) <= 8) & ~title.endswith(".")
    rules = {"numbered": numbered, "known": F.col("line").rlike(known), "annex": F.col("line").rlike(ANNEX)}
    kind = F.coalesce(*(F.when(rules[k], k) for k in KINDS if k in kinds))
    out = each.withColumn("kind", kind).where("kind IS NOT NULL")
    return out.withColumn("number", F.when(F.col("kind") == "numbered", number).when(F.col("kind") == "annex", F.get(F.split("line", r"\s+"), 1))).withColumn(
        "title", F.when(F.col("kind") == "numbered", title).otherwise(F.col("line"))
    )


def level(number: Column) -> Column:
    """1 to 3 by the number's depth; 1 without a number."""
    return F.when(number.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+"), 3).when(number.rlike(r"^[0-9]+\.[0-9]+|^[A-Z]\.[0-9]+"), 2).otherwise(1)


def sections(found: DataFrame) -> DataFrame:
    """Headings once a page, with level, parent (the nearest before of a smaller level) and an id that is unique in the document."""
    once = W.partitionBy("doc_id", "page", F.lower("title")).orderBy("line_no")
    s = found.withColumn("n", F.row_number().over(once)).where("n = 1").drop("n").withColumn("level", level(F.col("number")))
    before = W.partitionBy("doc_id").orderBy("page", "line_no").rowsBetween(W.unboundedPreceding, -1)
    last = lambda of: F.last(F.when(of, F.struct("page", "line_no", "title")), ignorenulls=True).over(before)
    up1, up2 = last(F.col("level") == 1), last(F.col("level") <= 2)
    parent = F.when(F.col("level") == 2, up1).when(F.col("level") == 3, up2)
    s = s.withColumn("parent_title", parent["title"])
    base = F.format_string("P%03d_%s", F.col("page").cast("int"), F.regexp_replace(F.substring("title", 1, 24), "[^A-Za-z0-9]+", "_"))
    s = s.withColumn("base", base)
    k = F.row_number().over(W.partitionBy("doc_id", "base").orderBy("line_no")) - 1
    s = s.withColumn("k", k)
    s = s.withColumn("section_id", F.when(F.col("k") == 0, F.col("base")).otherwise(F.format_string("%s_%02d", "base", "k")))
    return s.drop("base", "k").where(F.length("title").between(3, 80))


def section_of(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, page, section): the last section that starts on or before each page, else General. One union and one window, no range join."""
    a = found.select("doc_id", "page", "line_no", "title", F.lit(0).alias("is_page"))
    b = pages.select("doc_id", "page", F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("string").alias("title"), F.lit(1).alias("is_page")).distinct()
    w = W.partitionBy("doc_id").orderBy("page", "is_page", "line_no").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("section", F.coalesce(F.last("title", ignorenulls=True).over(w), F.lit("General")))
    return both.where("is_page = 1").select("doc_id", "page", "section")


def paragraphs(body: Column | str) -> Column:
    """Paragraphs at blank lines; a single one of more than 800 characters is cut at sentence ends."""
    paras = F.filter(F.transform(F.split(text(body), "\n\n"), lambda p: F.trim(p)), lambda p: p != "")
    sentences = F.filter(F.transform(F.split(text(body), r"(?<=[.。])\s+"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when((F.size(paras) <= 1) & (F.length(text(body)) > 800), sentences).otherwise(paras)


def units(paras: Column, long: int | None = config.DEFAULT.long_paragraph) -> Column:
    """Paragraphs (kind 0); one of more than `long` estimated tokens as a cut (kind 2) and its sentences (kind 1). Without `long` all stay whole."""
    unit = lambda t, kind: F.struct(t.alias("text"), token_estimate(t).alias("tok"), F.lit(kind).alias("kind"))
    if long is None:
        return F.transform(paras, lambda p: unit(p, 0))
    sentences = lambda p: F.concat(F.array(unit(F.lit(""), 2)), F.transform(F.split(p, r"(?<=[.])\s+"), lambda x: unit(x, 1)))
    return F.flatten(F.transform(paras, lambda p: F.when(token_estimate(p) > long, sentences(p)).otherwise(F.array(unit(p, 0)))))


def packs(paras: Column, most: int = config.DEFAULT.chunk_tokens, long: int | None = config.DEFAULT.long_paragraph) -> Column:
    """Structs (text, tok, kind) of units joined in order up to `most` estimated tokens, a longer unit alone; kind is 0 for what a paragraph ended, 1 a sentence, 2 the end of the page.

    A cut ends what has 40 characters or more; what is shorter goes on with the sentences. One fold, no shuffle.
    """
    start = F.struct(F.lit("").alias("buf"), F.lit(0).alias("tok"), F.array().cast("array<struct<text:string,tok:int,kind:int>>").alias("out"))
    pack = lambda a, kind: F.concat(a["out"], F.array(F.struct(stripped(a["buf"]).alias("text"), a["tok"].alias("tok"), kind.alias("kind"))))

    def step(a: Column, u: Column) -> Column:
        cut = (u["kind"] == 2) & (F.length(stripped(a["buf"])) >= 40)
        full = (u["kind"] != 2) & (a["tok"] + u["tok"] > most) & (stripped(a["buf"]) != "")
        own = F.concat(u["text"], F.when(u["kind"] == 1, " ").otherwise("\n\n"))
        return F.struct(
            F.when(cut, "").when(full, own).when(u["kind"] == 2, a["buf"]).otherwise(F.concat(a["buf"], own)).alias("buf"),
            F.when(cut, 0).when(full, u["tok"]).when(u["kind"] == 2, a["tok"]).otherwise(a["tok"] + u["tok"]).alias("tok"),
            F.when(cut | full, pack(a, F.when(u["kind"] == 1, 1).otherwise(0))).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(units(paras, long), start, step, lambda a: F.when(stripped(a["buf"]) != "", pack(a, F.lit(2))).otherwise(a["out"]))


def packed(paras: Column, most: int = config.DEFAULT.chunk_tokens, long: int | None = config.DEFAULT.long_paragraph) -> Column:
    """The texts of packs()."""
    return F.transform(packs(paras, most, long), lambda x: x["text"])


def chunks(pages: DataFrame, most: int = config.DEFAULT.chunk_tokens, long: int = config.DEFAULT.long_paragraph) -> DataFrame:
    """(doc_id, page, chunk_id, text, tokens, chunk_type) of pages with their section. Numbers run through the document; what is too short or long is left out after numbering, but for short ends of pages, which have no number."""
    each = pages.select("doc_id", "page", "section", F.posexplode(packs(paragraphs("text"), most, long)).alias("pos", "c"))
    each = each.withColumn("text", normalised("c.text")).where("c.kind <> 2 OR length(text) >= 40")
    seq = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "pos"))
    each = each.withColumn("seq", seq).withColumn("tokens", F.col("c.tok"))
    each = each.withColumn("chunk_id", F.format_string("%s_P%03d_C%03d", F.col("doc_id").cast("string"), F.col("page").cast("int"), "seq"))
    kind = F.when((F.col("c.kind") != 1) & F.lower("section").rlike("requirement|apparatus|test|scope"), "requirements").otherwise("general")
    return each.where("length(text) BETWEEN 40 AND 6000 AND tokens >= 10").select("doc_id", "page", "chunk_id", "text", "tokens", kind.alias("chunk_type"))


def backfilled(standards: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """full_text from the chunks in page order where it is missing or short; scope from the first scope chunk."""
    joined = chunk_rows.groupBy("standard_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "chunk_id", "text"))), lambda x: x["text"]), "\n").alias("joined"),
        F.min(F.when(F.col("section").rlike(r"(?i)^\s*(1\.?)?\s*scope\s*$") & (F.length("text") > 10), F.struct("page", "chunk_id", "text"))).alias("scope_chunk"),
    )
    out = standards.join(joined, "standard_id", "left")
    short = F.length(text("full_text")) < 100
    return out.select("standard_id", F.when(short, F.substring(text("joined"), 1, 50000)).otherwise(F.col("full_text")).alias("full_text"), F.substring(F.col("scope_chunk.text"), 1, 5000).alias("scope"))
