"""Text functions: Column to Column, built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import config

# What a token and a control character are.
TOKEN = r"[a-z0-9]+(?:[_\-./][a-z0-9]+)*"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
MARK = "\x01"
"""Stands on both sides of what places() finds; texts hardly have it."""


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokens(c: Column | str) -> Column:
    """Lower-case tokens; inner hyphens, dots and slashes stay."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(TOKEN), 0)


def word_set(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), 0))


def words(c: Column | str) -> Column:
    return F.array_remove(F.split(text(c), r"[ \t\n\x0B\f\r]+"), "")


def token_estimate(c: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.size(words(c)) * F.lit(1.3)).cast("int"))


def squeezed(c: Column | str) -> Column:
    """Lower case, white space single, trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.lower(text(c)), r"\s+", " "))


def normalised(c: Column | str) -> Column:
    """No-break spaces and carriage returns out, runs of blanks single, lines trimmed, blank lines single. Compatibility folding is `functions.unicode.folded`."""
    t = F.regexp_replace(F.regexp_replace(text(c), " ", " "), "\r", "")
    t = F.regexp_replace(t, "[ \t]+", " ")
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    t = F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def control_count(c: Column | str) -> Column:
    return F.regexp_count(text(c), F.lit(CONTROL))


def rounded(c: Column, digits: int) -> Column:
    """Half up by floor, the same in any engine."""
    return F.floor(c * float(10**digits) + 0.5) / float(10**digits)


def quality(c: Column | str) -> Column:
    """0 for a blank text, else 1 less the share of control characters, cut for odd word lengths and few distinct characters."""
    t = text(c)
    w = words(t)
    average = F.aggregate(F.transform(w, lambda x: F.length(x)), F.lit(0), lambda a, x: a + x) / F.size(w)
    head = F.split(F.substring(F.trim(t), 1, 200), "")
    score = 1 - control_count(t) / F.length(t)
    score = score * F.when((average > 20) | (average < 2), 0.6).otherwise(1.0)
    score = score * F.when(F.size(F.array_distinct(head)) < 5, 0.3).otherwise(1.0)
    return F.when(F.size(w) == 0, F.lit(0.0)).otherwise(rounded(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 3))


def canonical_unit(c: Column | str, units: dict[str, str] = config.UNITS) -> Column:
    """The canonical spelling, an unknown unit as it is, null for an empty one."""
    u = F.trim(text(c))
    known = F.create_map(*[F.lit(x) for pair in units.items() for x in pair])
    return F.when(u != "", F.coalesce(F.try_element_at(known, u), u))


def number_and_unit(c: Column | str) -> tuple[Column, Column]:
    """Of `12.5 mm` the number and the unit; null where the whole isn't of that form or the number is malformed."""
    shape = r"^([0-9.]+)\s*([a-zA-Z°μΩ±]+.*)?$"
    t = F.trim(text(c))
    unit = F.regexp_extract(t, shape, 2)
    n = F.regexp_extract(t, shape, 1).try_cast("double")
    return n, F.when(n.isNotNull() & (unit != ""), F.trim(unit))


def first_number(c: Column | str) -> Column:
    """The first blank-separated word as a number, commas dropped."""
    return F.get(words(F.regexp_replace(text(c), ",", "")), 0).try_cast("double")


def unit_inside(c: Column | str) -> Column:
    """The first unit found anywhere, inside words too; null if none."""
    return F.nullif(F.regexp_extract(text(c), r"(?i)(mm|cm|m|inch|in|kg|g|L|mL|°C|bar|kPa|MPa|V|A|kW|Hz)", 0), F.lit(""))


def safe_id(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(text(c), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def citation(number: Column, section: Column, clause: Column, page: Column) -> Column:
    """Parts that are there, comma-separated."""
    part = lambda c, form: F.when(text(c.cast("string")) != "", F.format_string(form, c.cast("string")))
    return F.concat_ws(", ", part(number, "%s"), part(section, "Sec. %s"), part(clause, "Cl. %s"), part(page, "p. %s"))


def page_of(c: Column | str) -> Column:
    """The page that a piece of evidence names, as p.N or page N."""
    t = F.lower(text(c))
    found = F.coalesce(F.nullif(F.regexp_extract(t, r"p\.([0-9]+)", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"page\s*([0-9]+)", 1), F.lit("")))
    return found.cast("int")


def snippet(c: Column | str, pattern: str, around: int, most: int) -> Column:
    """The first match with some context, on one line."""
    found = F.regexp_extract(text(c), f"(?s).{{0,{around}}}(?:{pattern}).{{0,{around}}}", 0)
    return F.substring(F.regexp_replace(F.trim(found), "\n", " "), 1, most)


def prefixed(c: Column | str, prefix: Column) -> Column:
    return F.concat(F.coalesce(prefix, F.lit("")), text(c))


def stripped(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.btrim(text(c), F.lit(" \t\n\x0B\f\r"))


def places(c: Column | str, pattern: str) -> Column:
    """The matches of a pattern in order, as structs of value, start and end in characters, the end exclusive.

    One search puts a mark on both sides of each match; between marks every
    other piece is one. A text that has the mark is searched twice instead.
    """
    t = text(c)
    marked = F.split(F.regexp_replace(t, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    found = F.regexp_extract_all(t, F.lit(pattern), 0)
    apart = F.flatten(F.zip_with(F.slice(F.split(t, pattern, -1), F.lit(1), F.size(found)), found, lambda b, v: F.array(b, v)))
    pieces = F.when(F.contains(t, F.lit(MARK)), apart).otherwise(marked)
    none = F.struct(F.lit(0).alias("at"), F.lit(False).alias("is_match"), F.array().cast("array<struct<value:string,start:int,end:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + F.length(x)
        match = F.array(F.struct(x.alias("value"), a["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), (~a["is_match"]).alias("is_match"), F.when(a["is_match"], F.concat(a["out"], match)).otherwise(a["out"]).alias("out"))

    return F.aggregate(pieces, none, step, lambda a: a["out"])


def around(c: Column | str, start: Column, end: Column, before: int, after: int) -> Column:
    """A stretch of text with some characters more on both sides."""
    low = F.greatest(start - before, F.lit(0))
    return F.substring(text(c), low + 1, end + after - low)
