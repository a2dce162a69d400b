"""Standard identifiers: parsing, formatting and metadata of first pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import safe_id, text

# The strict and the loose form of an identifier.
STRICT = r"(?i)IS\s*[:\-]?\s*([0-9]{2,6})\s*(?:\(?\s*Part\s*([0-9]+)\s*\)?)?\s*(?:\(?\s*Sec\s*([0-9]+)\s*\)?)?\s*[:\-]\s*([0-9]{4})"
LOOSE = r"(?i)IS\s+([0-9]{2,6})\s*\(?\s*Part\s*([0-9]+)[^)]*\)?\s*([0-9]{4})"


def group(c: Column | str, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text(c), pattern, k), F.lit(""))


def parsed(c: Column | str) -> Column:
    """struct(number, part, section, year) of an identifier: the strict form, else the loose one."""
    first = lambda k, j: F.coalesce(group(c, STRICT, k), *([group(c, LOOSE, j)] if j else []))
    return F.struct(first(1, 1).alias("number"), first(2, 2).alias("part"), group(c, STRICT, 3).alias("section"), first(4, 3).cast("int").alias("year"))


def normalised(p: Column) -> Column:
    part = F.when(p["part"].isNotNull(), F.concat(F.lit(" (Part "), p["part"], F.lit(")"))).otherwise("")
    section = F.when(p["section"].isNotNull(), F.concat(F.lit(" (Sec "), p["section"], F.lit(")"))).otherwise("")
    return F.when(p["number"].isNotNull(), F.concat(F.lit("IS "), p["number"], part, section, F.coalesce(F.concat(F.lit(":"), p["year"]), F.lit(""))))


def base(c: Column | str) -> Column:
    """The identifier without its year."""
    n, p = group(c, r"(?i)IS\s*([0-9]+)", 1), group(c, r"(?i)Part\s*([0-9]+)", 1)
    return F.when(n.isNotNull(), F.concat(F.lit("IS "), n, F.when(p.isNotNull(), F.concat(F.lit(" (Part "), p, F.lit(")"))).otherwise("")))


def year(c: Column | str) -> Column:
    return group(c, r"[:\-]\s*([0-9]{4})", 1).cast("int")


def shown(c: Column | str) -> Column:
    """IS_1448_Part_97_2026 as IS 1448 (Part 97):2026."""
    t = F.regexp_replace(text(c), r"^IS_([0-9]+)_Part_([0-9]+)_([0-9]{4})$", "IS $1 (Part $2):$3")
    return F.regexp_replace(t, r"^IS_([0-9]+)_([0-9]{4})$", "IS $1:$2")


def standard_id(c: Column | str) -> Column:
    return safe_id(c)


def file_hints(c: Column | str) -> tuple[Column, Column]:
    """Number and year that a file name hints at."""
    return group(c, r"(?i)IS[_ ]?([0-9]+)", 1), group(c, r"((?:19|20)[0-9]{2})", 1).cast("int")


def metadata(c: Column | str) -> Column:
    """struct(iso_reference, ics_code, revision): the first of each."""
    return F.struct(
        group(c, r"(?i)ISO\s*[0-9]+(?::[0-9]+)?\s*:\s*[0-9]{4}", 0).alias("iso_reference"),
        group(c, r"(?i)ICS\s*([0-9.]+(?:\s*,\s*[0-9.]+)*)", 1).alias("ics_code"),
        group(c, r"(?i)(First|Second|Third|Fourth|Fifth)\s+Revision", 1).alias("revision"),
    )


def title(page: Column | str) -> Column:
    """Up to three of the seven lines after the one with the identifier, short of the first imprint line; null if shorter than 5."""
    lines = F.filter(F.transform(F.split(text(page), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(r"(?i)IS\s*[0-9]+")), F.lit(True))
    after = F.slice(lines, at.cast("int") + 1, F.lit(7))
    stop = F.array_position(F.transform(after, lambda x: x.rlike("(?i)ICS|BIS|Price Group|MANAK|BUREAU")), F.lit(True)).cast("int")
    before = F.when(stop > 0, F.slice(after, F.lit(1), stop - 1)).otherwise(after)
    good = F.filter(before, lambda x: (F.length(x) >= 4) & x.rlike("[A-Za-z0-9]"))
    t = F.regexp_replace(F.array_join(F.slice(good, 1, 3), " "), r"(?i)\s*\(\s*(First|Second|Third).*$", "")
    t = F.substring(F.trim(t), 1, 200)
    return F.when((at > 0) & (F.length(t) >= 5), t)


def title_or(title_: Column, scope: Column, identifier: Column) -> Column:
    """The title, else the first line of the scope, else the identifier."""
    line = F.nullif(F.substring(F.trim(F.get(F.split(text(scope), "\n"), 0)), 1, 120), F.lit(""))
    return F.coalesce(F.nullif(title_, F.lit("")), line, identifier)
