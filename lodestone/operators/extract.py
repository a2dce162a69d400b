"""Facts from page texts: values, references, compliance marks, tables, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import around, places, rounded, stripped, text

# Units, properties and qualifiers of a value.
UNIT = r"µm|µL|um|nm|mm|cm|km|kg|mg|mL|ml|kPa|MPa|Pa|bar|psi|°C|°F|kHz|MHz|Hz|kV|mA|kW|kN|Nm|ppm|dB|ohm|Ω|%|m|g|t|L|l|C|K|V|A|W|N"
PROPERTY = (
    "surface roughness|deposit thickness|deposit volume|tube length|flow rate|heater tube|length|width|height|diameter|thickness|radius|capacity|volume|weight|mass|pressure|temperature|"
    "voltage|current|power|frequency|hardness|strength|tensile|elongation|density|viscosity|tolerance|roughness|aeration|filtration|metallurgy|magnesium|silicon|grade|class|material|"
    "concentration|pH|resistance|load"
)
QUALIFIER = r"not\s+less\s+than|not\s+more\s+than|minimum|maximum|at\s+least|up\s+to|approx\.?|approximately|shall\s+be|shall\s+not\s+exceed|shall\s+exceed"
VALUE = rf"(?i)((?:{QUALIFIER})?)\s*([0-9]+(?:\.[0-9]+)?(?:\s*[-–]\s*[0-9]+(?:\.[0-9]+)?)?)\s*(±\s*[0-9]+(?:\.[0-9]+)?)?\s*({UNIT})?(?:\s*/\s*({UNIT}))?(?:\s*(per\s+\w+))?"
# The condition and the material of a value.
CONDITION = r"(?i)\bat\s+[^,.]{2,40}"
MATERIAL = r"(?i)\b(Aluminium|Aluminum|6061-T6|stainless steel|SS\s*304|SS\s*316|steel|brass|copper|PVC|HDPE|rubber|elastomer|ceramic|glass|6061)\b"


def clauses(pages: DataFrame) -> DataFrame:
    """(doc_id, page, clause_no, clause): at least 20 characters, with a number and a property or unit."""
    each = pages.select("doc_id", "page", F.posexplode(F.split(text("text"), r"(?<=[.\n])\s+")).alias("clause_no", "clause"))
    return each.where((F.length(F.trim("clause")) >= 20) & F.col("clause").rlike("[0-9]") & F.col("clause").rlike(rf"(?i)({PROPERTY})|({UNIT})"))


def values(found: DataFrame) -> DataFrame:
    """One row per value in a clause: where it stands, raw, qualifier, number, tolerance, unit, per, nominal and, of a range, maximum, the clause's material and the condition near the value."""
    part = lambda x, k: F.regexp_extract(x, VALUE, k)
    # a number is no longer than what it stands in
    each = F.filter(places("clause", VALUE), lambda x: F.when(F.length(x["value"]) <= 20, True).otherwise(F.length(part(x["value"], 2)) <= 20))
    none = lambda c: F.nullif(stripped(c), F.lit(""))
    found = found.withColumn("material", none(F.regexp_extract("clause", MATERIAL, 0)))
    each = found.select("*", F.posexplode(each).alias("value_no", "v")).select("doc_id", "page", "clause_no", "clause", "material", "value_no", "v.*")
    named = {"qualifier": 1, "number": 2, "tolerance": 3, "unit": 4, "unit2": 5, "per": 6}
    each = each.select("*", *[part(F.col("value"), k).alias(n) for n, k in named.items()])
    each = each.withColumn("unit", F.when(F.col("unit") != "", F.col("unit")).otherwise(F.col("unit2"))).drop("unit2")
    raw = F.concat_ws(" ", F.nullif("qualifier", F.lit("")), stripped("value"))
    ends = F.split("number", r"\s*[-–]\s*")
    return each.withColumns(
        {
            "raw": raw,
            "nominal": F.get(ends, 0).try_cast("double"),
            "maximum": F.get(ends, 1).try_cast("double"),
            "condition": none(F.regexp_extract(around("clause", F.col("start"), F.col("end"), 80, 80), CONDITION, 0)),
        }
    ).drop("value")


def nearest_property(found: DataFrame) -> DataFrame:
    """values() with `property`: the last one before the value, else the first within 60 characters after it, else the clause's first, else `requirement`."""
    named = rf"(?i)\b({PROPERTY})\b"
    before = F.regexp_extract_all(F.substring("clause", F.lit(1), F.col("start")), F.lit(named), 1)
    after = F.regexp_extract(F.substring("clause", F.col("end") + 1, F.lit(60)), named, 1)
    some = lambda c: F.nullif(c, F.lit(""))
    found_ = F.coalesce(F.get(before, F.size(before) - 1), some(after), some(F.regexp_extract("clause", named, 1)), F.lit("requirement"))
    return found.withColumn("property", F.lower(found_))


def confidence(prop: Column, unit: Column, tolerance: Column, clause: Column) -> Column:
    c = F.lit(0.5) + F.when(prop != "requirement", 0.15).otherwise(0.0) + F.when(unit != "", 0.15).otherwise(0.0)
    c = c + F.when(tolerance != "", 0.10).otherwise(0.0) - F.when(F.length(clause) > 300, 0.10).otherwise(0.0)
    return rounded(F.greatest(F.lit(0.1), F.least(F.lit(0.95), c)), 2)


def capped(specs: DataFrame, most: int = 30) -> DataFrame:
    """After more than `most` on a page each later clause still gives its first."""
    w = W.partitionBy("doc_id", "page").orderBy("clause_no", "value_no")
    return specs.withColumn("n", F.row_number().over(w)).where((F.col("n") <= most + 1) | (F.col("value_no") == 0)).drop("n")


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """One row a key, the first in order, by partial minima: a key with many rows is no burden."""
    by = [(F.col(k) if isinstance(k, str) else k).alias(f"key_{i}") for i, k in enumerate(keys)]
    return df.groupBy(*by).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("first")).select("first.*")


def unique_specs(specs: DataFrame) -> DataFrame:
    return first_by(specs, ["standard_id", "page", F.lower("property"), F.lower("value")], ["spec_id"])


# The four kinds of reference, in the order in which a page is searched, with relationship and confidence.
REFERENCES = (
    ("IS", r"(?i)IS\s*([0-9]{2,6})\s*(?:\(?\s*Part\s*([0-9]+)[^)]*\)?)?\s*(?:\(?\s*Sec\s*([0-9]+)[^)]*\)?)?\s*[:\-]?\s*([0-9]{4})?", None, None),
    ("ISO", r"(?i)ISO\s*([0-9]+(?:[-:][0-9]+)*(?:\s*Part\s*[0-9]+)?)\s*[:\-]?\s*([0-9]{4})?", "normative_reference", 0.75),
    ("ASTM", r"(?i)ASTM\s*([A-Z]?\s*[0-9]+(?:[-.][0-9]+)*)", "test_method_reference", 0.6),
    ("IEC", r"(?i)IEC\s*([0-9]+(?:[-:][0-9]+)*)", "allied", 0.6),
)


def references(pages: DataFrame) -> DataFrame:
    """(doc_id, page, kind, raw, target, relationship, confidence): a document's references, each once, on its first page.

    On the first five pages of a document that speaks of normative references
    on its first six, a reference is normative; else the 300 characters before it tell.
    """
    normative = pages.where((F.col("page") <= 6) & F.contains(F.lower(text("text")), F.lit("normative references"))).select("doc_id").distinct().withColumn("normative", F.lit(True))
    kind_of = "array<struct<kind:string,kind_no:int,pos:int,raw:string,context:string>>"

    def found(order: int, kind: str, pattern: str) -> Column:
        before = lambda m: F.substring("text", F.greatest(m["start"] - 300, F.lit(0)) + 1, F.least(m["start"], F.lit(300))) if kind == "IS" else F.lit(None).cast("string")
        each = F.transform(places("text", pattern), lambda m, i: F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("kind_no"), i.alias("pos"), stripped(m["value"]).alias("raw"), before(m).alias("context")))
        # the bare word is quicker to look for than the pattern
        return F.when(F.col("text").rlike(rf"(?i){kind}\s*[A-Z0-9]"), each.cast(kind_of)).otherwise(F.array().cast(kind_of))

    # all kinds from one pass over the pages
    rows = pages.select("doc_id", "page", F.explode(F.concat(*(found(i, kind, pattern) for i, (kind, pattern, _, _) in enumerate(REFERENCES)))).alias("r")).select("doc_id", "page", "r.*")
    rows = rows.join(normative, "doc_id", "left")
    own = REFERENCES[0][1]
    is_own, year, number = F.col("kind") == REFERENCES[0][0], F.col("raw").rlike("[0-9]{4}"), F.regexp_extract("raw", own, 1)
    group = lambda k, form: F.when(F.regexp_extract("raw", own, k) != "", F.format_string(form, F.regexp_extract("raw", own, k))).otherwise("")
    good = F.when(is_own, year | F.contains(F.lower("raw"), F.lit("part")) | (number.try_cast("int") >= 100)).when(F.col("kind").isin("ASTM", "IEC"), F.length("raw") >= 6).otherwise(True)
    target = F.when(is_own, F.concat(F.lit("IS "), number, group(2, " (Part %s)"), group(3, " (Sec %s)"), group(4, ":%s"))).otherwise(F.col("raw"))
    hint = F.when(F.col("normative") & (F.col("page") <= 5), "normative references").otherwise(F.col("context"))
    relation, sure = F.when(is_own, relationship(hint)), F.when(is_own, F.when(year, 0.85).otherwise(0.55))
    for kind, _, usual, confidence in REFERENCES[1:]:
        relation, sure = relation.when(F.col("kind") == kind, usual), sure.when(F.col("kind") == kind, confidence)
    rows = rows.where(good).select("doc_id", "page", "kind", "raw", target.alias("target"), relation.alias("relationship"), sure.alias("confidence"), "kind_no", "pos")
    return first_by(rows, ["doc_id", F.replace(F.lower("raw"), F.lit(" "), F.lit(""))], ["page", "kind_no", "pos"]).drop("kind_no", "pos")


def relationship(context: Column) -> Column:
    low = F.lower(text(context))
    has = lambda w: F.contains(low, F.lit(w))
    return (
        F.when(has("normative") | has("references"), "normative_reference")
        .when(has("test") & (has("method") | has("procedure")), "test_method_reference")
        .when(has("terminolog") | has("definitions") | has("vocabulary"), "terminology_reference")
        .when(has("safety"), "safety_reference")
        .otherwise("allied")
    )


# Cues of compliance, what makes a certification required, and the cues of which a page must have one.
ORDERS = r"(?i)\b(QCO|Quality\s+Control\s+Order)\b"
CERTIFICATES = r"(?i)\b(certification|BIS\s+licen[sc]e|ISI\s+mark|Standard\s+Mark|Compulsory\s+Certification)\b"
REQUIRED = r"(?i)(required|mandatory|shall|c\.?o\.?m\.?pulsory)"
MARKS = r"(?id)\b(Marking|Labelling|Packaging|Sampling|Inspection)\b.{0,60}"
MARKED = r"(?i)\b(Marking|Sampling|Inspection)\b"


def compliance(pages: DataFrame) -> DataFrame:
    """(doc_id, page, type, value, confidence): control orders, certification that a context demands, and after page 3 marking and the like, once a page and type. Places are found first, contexts are cut out around them."""

    def hits(df: DataFrame, pattern: str, before: int, after: int) -> DataFrame:
        each = df.where(F.col("text").rlike(pattern)).select("doc_id", "page", "text", F.posexplode(places("text", pattern)).alias("pos", "m"))
        value = F.replace(stripped(around("text", F.col("m.start"), F.col("m.end"), before, after)), F.lit("\n"), F.lit(" "))
        return each.select("doc_id", "page", "pos", F.regexp_extract("m.value", pattern, 1).alias("cue"), F.substring(value, 1, 500).alias("value"))

    orders = hits(pages, ORDERS, 120, 120).withColumn("type", F.lit("qco_reference")).withColumn("confidence", F.lit(0.7))
    certificates = hits(pages, CERTIFICATES, 120, 120).where(F.col("value").rlike(REQUIRED)).withColumn("type", F.lit("certification_required")).withColumn("confidence", F.lit(0.65))
    marks = hits(pages.where((F.col("page") > 3) & F.col("text").rlike(MARKED)), MARKS, 80, 200).withColumn("type", F.concat(F.lower("cue"), F.lit("_requirements")))
    marks = first_by(marks, ["doc_id", "page", "type"], ["pos"]).withColumn("confidence", F.lit(0.6))
    return orders.unionByName(certificates).unionByName(marks, allowMissingColumns=True).select("doc_id", "page", "type", "value", "confidence")


def compliance_or_default(standards: DataFrame, found: DataFrame) -> DataFrame:
    n = found.groupBy("standard_id").agg(F.count("*").alias("n"))
    return standards.select("standard_id").join(n, "standard_id", "left").select("standard_id", F.when(F.col("n") > 0, "Established").otherwise("Not established").alias("compliance"))


def table_status(rows: Column) -> Column:
    """struct(status, confidence) of array<array<string>> rows, the first the header: by the share of rows about as wide as the header."""
    wide = F.size(F.get(rows, 0))
    body = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
    share = F.size(F.filter(body, lambda r: F.abs(F.size(r) - wide) <= 1)) / F.size(body)
    make = lambda s, c: F.struct(F.lit(s).alias("status"), F.lit(c).alias("confidence"))
    return F.when(F.size(rows) < 2, make("EMPTY", 0.2)).when((share > 0.85) & (wide >= 2), make("SUCCESS", 0.9)).when(share > 0.6, make("PARTIAL", 0.6)).otherwise(make("LOW", 0.3))


def table_caption(page: Column | str) -> Column:
    """The page's first line with a table number."""
    return F.get(F.filter(F.transform(F.split(text(page), "\n"), lambda x: F.trim(x)), lambda x: x.rlike("(?i)Table\\s+[0-9]+")), 0)


def table_id(page: Column, index: Column, box: Column) -> Column:
    """index counts from 0."""
    return F.concat(F.format_string("T%03d_%02d_", page.cast("int"), (index + 1).cast("int")), F.substring(F.md5(box), 1, 6))


def table_text(rows: Column, most: int = 8) -> Column:
    """The first rows of cells, a line each; cells are trimmed and on one line, missing ones empty."""
    cell = lambda c: F.replace(stripped(c), F.lit("\n"), F.lit(" "))
    return F.array_join(F.transform(F.slice(rows, 1, most), lambda r: F.array_join(F.transform(r, cell), " | ")), "\n")


# How captions begin.
FIGURE = r"(?i)(Figure|Fig\.)\s+([A-Z]?[0-9]+(?:\.[0-9]+)*)"
FIGURE_LINE = r"(?im)^\s*(Figure|Fig\.)\s+[0-9A-Z.]+.*"


def figure_caption(page: Column | str) -> Column:
    """struct(number, caption): of the first line that begins with a figure's number, the rest is the caption, or the line where there is no rest; else, of a figure named anywhere, some text around it on one line. Null if there is none."""
    t = text(page)
    line, named = stripped(F.regexp_extract(t, FIGURE_LINE, 0)), F.get(places(t, FIGURE), 0)
    number = F.regexp_extract(line, FIGURE, 0)
    rest = F.regexp_replace(F.substring(line, F.instr(line, number) + F.length(number), 1 << 30), "^[ —–\\-:\t]+|[ —–\\-:\t]+$", "")
    second = F.coalesce(F.get(F.split(line, r"\s+"), 1), F.lit(""))
    own = F.struct(F.when(number != "", number).otherwise(second).alias("number"), F.substring(F.when((number != "") & (rest != ""), rest).otherwise(line), 1, 300).alias("caption"))
    near = F.replace(stripped(around(t, named["start"], named["start"], 60, 120)), F.lit("\n"), F.lit(" "))
    return F.when(line != "", own).when(named.isNotNull(), F.struct(named["value"].alias("number"), F.substring(near, 1, 300).alias("caption")))


def duplicate_frequency(figures: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds `frequency`: how often the picture occurs in its document, by pages of it. A picture is known by its hash, one without a hash by its width and height."""
    f = figures.withColumn("same", F.coalesce(F.nullif("pix_hash", F.lit("")), F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))))
    n = f.groupBy("doc_id", "same").agg(F.count("*").alias("n_same"))
    return f.join(n, ["doc_id", "same"]).join(pages.select("doc_id", "n_pages"), "doc_id").withColumn("frequency", F.col("n_same") / F.greatest("n_pages", F.lit(1))).drop("n_same", "same")


def scored_figures(f: DataFrame) -> DataFrame:
    """Adds score, rejected and confirmed from frequency, place on the page (y0, y1 as shares), width, height, caption and section.

    A slice of a scan is nearly as wide as its page (page_width and page_height, where f has them, else an A4 page in points) and low.
    """
    page = lambda name, usual: F.coalesce(F.col(name), F.lit(usual)) if name in f.columns else F.lit(usual)
    area, aspect = F.col("width") * F.col("height"), F.col("width") / F.col("height")
    band = (F.col("y1") < 0.12) | (F.col("y0") > 0.90)
    when = lambda c, v: F.when(c, v).otherwise(0.0)
    s = F.lit(0.5) + when(F.col("frequency") > 0.35, -0.4) + when(band, -0.25) + when(band & (F.col("frequency") > 0.2), -0.2)
    s = s + when(area < 2500, -0.3) + when(area > 80000, 0.15)
    s = s + F.when((aspect > 15), -0.40).when(aspect > 10, -0.30).when(aspect > 8, -0.15).otherwise(0.0)
    strip = (F.col("width") > 0.85 * page("page_width", 595.0)) & (F.col("height") < 0.15 * page("page_height", 842.0)) & (F.col("height") < 150)
    s = s + when(strip, -0.35)
    s = s + when((F.col("width") < 100) & (F.col("height") < 100) & ~F.col("caption"), -0.25) + F.when(F.col("caption"), 0.35).otherwise(-0.05) + when(F.col("in_section"), 0.10)
    f = f.withColumn("raw", s).withColumn("strip", strip)
    override = F.col("caption") & (area > 15000)
    rejected = ~override & ((F.col("raw") < 0.35) | (F.col("frequency") > 0.35) & band | (area < 2500) & ~F.col("caption"))
    f = f.join(f.groupBy("doc_id", "page").agg((F.count("*") > 8).alias("crowd")), ["doc_id", "page"])
    crowd = F.col("crowd")
    rejected = rejected | (crowd | F.col("strip")) & ~F.col("caption")
    score = rounded(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw"))), 3)
    f = f.withColumn("rejected", rejected).withColumn("score", F.when(crowd & ~F.col("caption"), F.least(score, F.lit(0.30))).otherwise(score)).drop("raw", "crowd", "strip")
    return f.withColumn("confirmed", (F.col("score") >= 0.45) & (~F.col("rejected") | F.col("caption")))


def numbered_figures(f: DataFrame) -> DataFrame:
    """Confirmed figures without a number get the next ones of their document."""
    plain = f.where("confirmed AND figure_number IS NULL").withColumn("figure_number", F.concat(F.lit("Figure "), F.row_number().over(W.partitionBy("doc_id").orderBy("page", "figure_id"))))
    return f.where("NOT (confirmed AND figure_number IS NULL)").unionByName(plain)
