"""Requirements from tender texts, and the checks on them; one row a tender, all tenders at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions.identifiers import base, year
from lodestone.functions.text import around, first_number, places, stripped, text, unit_inside

from lodestone.operators.analysis import first_standards
from lodestone.operators.joins import by_sorting

WORD = "(?:^|[^A-Za-z0-9_])"


def first(c: Column | str, pattern: str) -> Column:
    """The first match as it stands in the text, null if none."""
    return F.nullif(stripped(F.regexp_extract(text(c), pattern, 0)), F.lit(""))


def cues(c: Column | str, words: str, most: int = 8) -> Column:
    """Distinct words found, in order of their first place."""
    found = F.regexp_extract_all(F.lower(text(c)), F.lit(f"{WORD}({words.lower()})(?=[^a-z0-9_]|$)"), 1)
    return F.slice(F.array_distinct(found), 1, most)


def every(c: Column | str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text(c), F.lit(pattern), 0), lambda x: stripped(x))


def requirements(tenders: DataFrame) -> DataFrame:
    """tender_id, full_text and what the text asks for: product, material, application, capacity, dimensions, testing, safety, refs. Values keep the text's case; page_requirements() tells where they stand. Tenders are dealt out by id first, as joins of them need it anyway: a table in few large pieces would be searched by few tasks."""
    t = tenders.select("tender_id", text("text").alias("full_text")).repartition("tender_id")
    return t.select(
        "tender_id",
        "full_text",
        first("full_text", config.PRODUCT).alias("product"),
        first("full_text", config.MATERIAL).alias("material"),
        first("full_text", config.APPLICATION).alias("application"),
        first("full_text", config.CAPACITY).alias("capacity"),
        F.slice(every("full_text", config.DIMENSION), 1, 8).alias("dimensions"),
        cues("full_text", config.TEST_WORDS).alias("testing"),
        cues("full_text", config.SAFETY_WORDS).alias("safety"),
        F.array_distinct(every("full_text", config.TENDER_REFERENCE)).alias("refs"),
    )


def page_hits(pages: DataFrame, kinds: dict[str, str] = config.HITS) -> DataFrame:
    """(tender_id, page, kind, hit_no, start, value, source_text): every match of every kind of pattern from one pass over the pages, with 120 characters on both sides, 400 at most, on one line. Kinds may overlap; hit_no counts a page's hits of a kind from 0.

    Searching a page takes longer than moving it, and a table may lie in few
    large pieces, so pages are dealt out first.
    """
    return hits_within(pages.select("tender_id", "page", "text").repartition("tender_id", "page"), kinds)


def hits_within(pages: DataFrame, kinds: dict[str, str] = config.HITS) -> DataFrame:
    """page_hits() where the pages lie."""

    def found(kind: str, pattern: str) -> Column:
        return F.transform(places("text", pattern), lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("hit_no"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))

    own = pages.select("tender_id", "page", text("text").alias("text"))
    each = own.select("tender_id", "page", "text", F.explode(F.concat(*(found(k, p) for k, p in kinds.items()))).alias("h")).select("tender_id", "page", "text", "h.*")
    window = F.replace(stripped(around("text", F.col("start"), F.col("end"), 120, 120)), F.lit("\n"), F.lit(" "))
    return each.select("tender_id", "page", "kind", "hit_no", "start", stripped("value").alias("value"), F.substring(window, 1, 400).alias("source_text"))


def page_requirements(pages: DataFrame, most: int = 3, dimensions: int = 8) -> DataFrame:
    """One row a tender: product, material, application and capacity, each the first hit over its pages, with up to three places of evidence (value, page, source_text); up to eight dimensions and all different references as such places. A tender without hits has nulls and empty lists."""
    # a tender's pages are brought together before they are searched: they are less than what is found on them
    pages = pages.select("tender_id", "page", "text").repartition("tender_id")
    hits = hits_within(pages)
    # of a page no more hits can matter than of the tender, and a repeated reference matters once
    limit = F.when(F.col("kind") == "dimension", dimensions).when(F.col("kind") != "reference", most)
    place = F.struct("page", "hit_no", "value", "source_text")
    once = hits.where(limit.isNull() | (F.col("hit_no") < limit)).groupBy("tender_id", "kind", F.when(F.col("kind") == "reference", F.col("value")).otherwise(F.concat_ws("/", "page", "hit_no")).alias("of")).agg(F.min(place).alias("p"))

    def listed(kind: str, n: int | None) -> Column:
        all_of = F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("p")))), lambda p: F.struct(p["value"].alias("value"), p["page"].alias("page"), p["source_text"].alias("source_text")))
        return F.slice(all_of, 1, n) if n else all_of

    single = ("product", "material", "application", "capacity")
    lists = [listed(k, most).alias(f"{k}_evidence") for k in single] + [listed("dimension", dimensions).alias("dimensions"), listed("reference", None).alias("references")]
    gathered = once.groupBy("tender_id").agg(*lists)
    out = pages.select("tender_id").distinct().join(gathered, "tender_id", "left")
    kind = "array<struct<value:string,page:int,source_text:string>>"
    names = [f"{k}_evidence" for k in single] + ["dimensions", "references"]
    out = out.select("tender_id", *(F.coalesce(F.col(c), F.array().cast(kind)).alias(c) for c in names))
    return out.select("tender_id", *(F.get(f"{k}_evidence", 0)["value"].alias(k) for k in single), *names)


def keywords(tenders: DataFrame, most: int = 12) -> DataFrame:
    """(tender_id, word, n, rank): the commonest words of three letters or more, ties by first place."""
    each = tenders.select("tender_id", F.posexplode(F.regexp_extract_all(F.lower(text("text")), F.lit("[a-z]{3,}"), 0)).alias("pos", "word"))
    n = each.where(~F.col("word").isin(config.STOPWORDS)).groupBy("tender_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("at"))
    w = W.partitionBy("tender_id").orderBy(F.col("n").desc(), "at")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("tender_id", "word", "n", "rank")


def query_text(reqs: DataFrame, words: DataFrame) -> DataFrame:
    """(tender_id, query): what is asked for, eight keywords and three tests."""
    k = words.where("rank <= 8").groupBy("tender_id").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("k"))
    q = F.concat_ws(" ", "product", "material", "application", "capacity", F.transform("k", lambda x: x["word"]), F.slice("testing", 1, 3))
    q = F.substring(F.trim(F.regexp_replace(q, r"\s+", " ")), 1, 600)
    return reqs.join(by_sorting(k), "tender_id", "left").select("tender_id", F.when(q != "", q).otherwise("procurement requirement").alias("query"))


def reference_rows(reqs: DataFrame) -> DataFrame:
    each = reqs.select("tender_id", F.posexplode("refs").alias("pos", "value"))
    return each.select(F.concat_ws("_", "tender_id", "pos").alias("ref_id"), "tender_id", "value", base("value").alias("base"), F.coalesce(year("value"), F.regexp_extract("value", "([0-9]{4})$", 1).try_cast("int")).alias("year"))


def present(name: str) -> Column:
    """Whether a requirement is there; what is never extracted is not."""
    if name in ("product", "material", "application", "capacity"):
        return text(name) != ""
    if name in ("dimensions", "testing", "safety"):
        return F.size(name) > 0
    return F.lit(False)


def gaps(reqs: DataFrame) -> DataFrame:
    """(tender_id, parameter, severity) of everything missing or thin."""
    rows = [F.when(~present(p), F.struct(F.lit(p).alias("parameter"), F.lit("critical").alias("severity"))) for p in config.CRITICAL]
    rows += [F.when(~present(p), F.struct(F.lit(p).alias("parameter"), F.lit("important").alias("severity"))) for p in config.IMPORTANT]
    units = F.array_distinct(F.array_compact(F.transform("dimensions", lambda d: F.lower(unit_inside(d)))))
    for cond, p, s in ((F.size("testing") < 2, "testing_methods", "important"), (F.size("refs") == 0, "standard_references", "info"), (F.size(units) > 2, "unit_consistency", "info")):
        rows.append(F.when(cond, F.struct(F.lit(p).alias("parameter"), F.lit(s).alias("severity"))))
    return reqs.select("tender_id", F.explode(F.array_compact(F.array(*rows))).alias("g")).select("tender_id", "g.parameter", "g.severity")


def provenance(pages: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, page, hit_no, value, source_text): every match with its page and 120 characters on both sides, 400 at most, on one line."""
    each = pages.where(F.col("text").rlike(pattern)).select("doc_id", "page", "text", F.posexplode(places("text", pattern)).alias("hit_no", "m"))
    window = F.replace(stripped(around("text", F.col("m.start"), F.col("m.end"), 120, 120)), F.lit("\n"), F.lit(" "))
    return each.select("doc_id", "page", "hit_no", stripped("m.value").alias("value"), F.substring(window, 1, 400).alias("source_text"))


def gap_evidence(found: DataFrame, specs: DataFrame, standards: int = 3) -> DataFrame:
    """gaps() with `evidence`: the first specification of the tender's first standards whose property holds the parameter or is held by it; null without one. specs has (tender_id, spec_ord, standard_id, property, value, unit)."""
    prop = F.lower(text("property"))
    told = F.concat_ws("", F.lit("IS "), "standard_id", F.lit(" — "), "property", F.lit(": "), "value", F.lit(" "), "unit")
    # once a property: its first specification says the same for every parameter
    near = first_standards(specs, standards).groupBy("tender_id", prop.alias("prop")).agg(F.min(F.struct("spec_ord", told.alias("told"))).alias("e"))
    near = near.groupBy("tender_id").agg(F.collect_list(F.struct("e", "prop")).alias("near"))
    # gaps are read once: each looks through its tender's properties
    fits = F.filter("near", lambda x: F.contains(x["prop"], F.col("parameter")) | F.contains(F.col("parameter"), x["prop"]))
    return found.join(by_sorting(near), "tender_id", "left").withColumn("evidence", F.array_min(F.transform(fits, lambda x: x["e"]))["told"]).drop("near")


# Vague wording and how grave it is.
VAGUE = (
    ("approximately|approx|about|around|roughly", "approximate", "warning"),
    ("suitable|appropriate|adequate|sufficient", "vague", "warning"),
    ("high quality|good quality|best quality", "subjective", "warning"),
    ("may|might|could|should", "optional", "info"),
)
UNNAMED = "as per|in accordance with|conforming to"


def ambiguity(tenders: DataFrame) -> DataFrame:
    """(tender_id, kind, n, first, severity), one row a kind of wording found."""
    rows = []
    for words, kind, severity in VAGUE:
        found = F.regexp_extract_all(F.lower(text("text")), F.lit(f"{WORD}({words})(?=[^a-z0-9_]|$)"), 1)
        rows.append(F.when(F.size(found) > 0, F.struct(F.lit(kind).alias("kind"), F.size(found).alias("n"), F.get(found, 0).alias("first"), F.lit(severity).alias("severity"))))
    unnamed = F.regexp_extract_all(F.lower(text("text")), F.lit(rf"{WORD}({UNNAMED})(?=[^a-z0-9_]|$)(?!\s+(?:is|iso|astm|iec|bis))"), 1)
    rows.append(F.when(F.size(unnamed) > 0, F.struct(F.lit("unnamed").alias("kind"), F.size(unnamed).alias("n"), F.get(unnamed, 0).alias("first"), F.lit("warning").alias("severity"))))
    return tenders.select("tender_id", F.explode(F.array_compact(F.array(*rows))).alias("a")).select("tender_id", "a.*")


def issues(reqs: DataFrame) -> DataFrame:
    """(tender_id, category, severity) of a tender's shortcomings, an issue a row."""
    many = lambda cond, c, s: F.when(cond, F.array(F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity")))).otherwise(F.array())
    per = lambda arr, c, s: F.transform(arr, lambda _: F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity")))
    old = F.filter("refs", lambda r: F.regexp_extract(r, "([0-9]{4})", 1).try_cast("int") < 2015)
    bare = F.filter("dimensions", lambda d: F.trim(d).rlike("^[0-9.]+$"))
    numbers = F.transform("dimensions", lambda d: F.regexp_extract(d, "^([0-9.]+)", 1))
    again = F.slice(numbers, F.lit(1), F.size(numbers) - F.size(F.array_distinct(numbers)))
    parts = [many(~present(p), "missing_parameter", "critical") for p in ("product", "material", "application")]
    parts += [many(~present(p), "missing_parameter", "warning") for p in ("capacity", "testing", "dimensions")]
    parts += [per(bare, "missing_unit", "warning"), per(old, "outdated_reference", "warning"), per(again, "internal_conflict", "warning")]
    parts += [many(F.size("testing") == 0, "missing_acceptance", "warning"), many(~F.contains(F.lower(F.substring("full_text", 1, 2000)), F.lit("inspection")), "missing_inspection", "info")]
    parts = [p.cast("array<struct<category:string,severity:string>>") for p in parts]
    return reqs.select("tender_id", F.explode(F.concat(*parts)).alias("i")).select("tender_id", "i.category", "i.severity")


def scores(reqs: DataFrame, found: DataFrame) -> DataFrame:
    """(tender_id, score, critical, warnings, info): 100 less 15, 5 and 1 for each, 0 at least."""
    n = lambda s: F.count_if(F.col("severity") == s)
    counts = found.groupBy("tender_id").agg(n("critical").alias("critical"), n("warning").alias("warnings"), n("info").alias("info"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    out = reqs.select("tender_id").join(by_sorting(counts), "tender_id", "left").select("tender_id", z("critical"), z("warnings"), z("info"))
    return out.withColumn("score", F.greatest(F.lit(0), 100 - 15 * F.col("critical") - 5 * F.col("warnings") - F.col("info")).cast("bigint"))


def traceable(reqs: DataFrame) -> DataFrame:
    """(tender_id, ord, name, value, label): the parameters that can be traced to a clause; label is what they are called in full."""
    one = lambda c: F.when(text(c) != "", F.array(F.struct(F.lit(c).alias("name"), F.col(c).alias("value"), F.lit(c.title()).alias("label")))).otherwise(F.array())
    each = lambda c, n, k, label: F.transform(F.slice(c, 1, k), lambda x, i: F.struct(F.lit(n).alias("name"), x.alias("value"), label(x, i).alias("label")))
    numbered = lambda x, i: F.concat(F.lit("Dimension "), i + 1)
    named = lambda n: lambda x, i: F.concat(F.lit(f"{n}: "), x)
    parts = [*map(one, ("product", "material", "application", "capacity")), each("dimensions", "dimension", 5, numbered), each("testing", "testing", 3, named("Testing")), each("safety", "safety", 3, named("Safety"))]
    parts = [p.cast("array<struct<name:string,value:string,label:string>>") for p in parts]
    return reqs.select("tender_id", F.posexplode(F.concat(*parts)).alias("ord", "p")).select("tender_id", "ord", "p.*")


def overridden(matches: DataFrame, compared: DataFrame) -> DataFrame:
    """best_match() with the status that the comparison of the same parameter gives, where it has one."""
    c = compared.select("tender_id", F.lower("requirement").alias("key"), F.col("status").alias("told"))
    out = matches.withColumn("key", F.lower("name")).join(by_sorting(c), ["tender_id", "key"], "left").drop("key")
    told = F.when(F.col("told") == "MATCH", "supported").when(F.col("told") == "MISMATCH", "conflict").when(F.col("told") == "TENDER_NOT_SPECIFIED", "review_required")
    return out.withColumn("status", F.coalesce(told, "status")).drop("told")


SCORES = (12, 9, 8, 7, 5, 4, 3)
"""All that 3, 4 and 5 can add up to, the best first."""


def best_match(params: DataFrame, specs: DataFrame, most: int = 200) -> DataFrame:
    """The best clause of a tender's recommended standards for each parameter: how well it supports it, where it stands and what it says.

    specs has (tender_id, spec_ord, spec_id, property, value), and where there
    are any standard_id, section, page, unit and evidence. 3 for a word of the
    parameter's label in the property, 5 for a value inside the other, 4 for
    numbers within 15 %. The first of the best wins; none above 0 is not_found.
    The evidence is the standard's own, cut at 200 characters, else the
    specification in words.
    """
    # what a row says is worked out before the rows are paired; what it says at length is met again by the best alone
    own = params.withColumn("p_words", F.split(F.lower("label"), " ")).withColumn("p_value", F.lower("value")).withColumn("p_number", first_number(F.lower("value")))
    there = lambda c, kind="string": F.col(c) if c in specs.columns else F.lit(None).cast(kind)
    told = F.concat(text("property"), F.lit(": "), text("value"), F.lit(" "), text(there("unit")))
    said = F.coalesce(F.nullif(F.substring(text(there("evidence")), 1, most), F.lit("")), told)
    s = F.struct("spec_ord", "spec_id", there("standard_id").alias("standard_id"), there("section").alias("clause"), there("page", "int").alias("evidence_page"), said.alias("evidence_text"))
    by = ("tender_id", F.lower(text("property")).alias("s_property"), F.lower(text("value")).alias("s_value"), F.coalesce(F.col("spec_ord").cast("bigint"), F.lit(2**63 - 1)).alias("k"))
    s_number = first_number(F.col("s_value"))
    words, value, prop, other, a, b = (F.col(c) for c in ("p_words", "p_value", "s_property", "s_value", "p_number", "s_number"))
    score = F.when(F.exists(words, lambda w: F.contains(prop, w)), 3).otherwise(0)
    score = score + F.when((value != "") & (other != "") & (F.contains(other, value) | F.contains(value, other)), 5).otherwise(0)
    score = score + F.when(F.abs(a - b) / F.greatest(F.abs(b), F.lit(1.0)) < 0.15, 4).otherwise(0)
    theirs = specs.select(*by).repartition("tender_id").groupBy("tender_id", "s_property", "s_value").agg(F.min("k").alias("k")).withColumn("s_number", s_number)
    # the first place of each score that there can be: numbers alone, so that pairs are counted without being sorted
    pairs = own.join(by_sorting(theirs), "tender_id", "left").withColumn("score", score)
    first_at = pairs.groupBy(*own.columns).agg(*(F.min(F.when(F.col("score") == n, F.col("k"))).alias(f"at_{n}") for n in SCORES))
    n = F.coalesce(*(F.when(F.col(f"at_{n}").isNotNull(), n) for n in SCORES), F.lit(0))
    first_at = first_at.select(*own.columns, n.alias("n"), F.coalesce(*(F.col(f"at_{n}") for n in SCORES)).alias("at"))
    full = specs.select(*by, s.alias("s")).withColumnRenamed("tender_id", "of").withColumn("s_number", s_number)
    both = first_at.join(by_sorting(full), (F.col("tender_id") == F.col("of")) & (F.col("at") == F.col("k")) & (score == F.col("n")), "left")
    keys = ("tender_id", "ord", "name", "value")
    once = both.groupBy(*keys, F.col("n").alias("score"), (-F.col("at")).alias("k"), "s_property", "s_value").agg(F.min("s").alias("s"))
    best = once.groupBy(*keys).agg(F.max(F.struct("score", "k", "s")).alias("m"))
    n = F.col("m.score")
    status = F.when(n >= 5, "supported").when(n >= 2, "partially_supported").when(n > 0, "unverified").otherwise("not_found")
    rest = [F.when(n > 0, F.col(f"m.s.{c}")).alias(c) for c in ("spec_id", "standard_id", "clause", "evidence_page", "evidence_text")]
    return best.select("tender_id", "ord", "name", "value", n.cast("int").alias("score"), *rest, status.alias("status"))
