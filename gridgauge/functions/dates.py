"""DAT-01 to DAT-09: dates in text, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridgauge.functions import text

# What parts the two dates of a range.
RANGE = r"(?i)\s+(?:through|thru|thr|to|-|–|—|until|till)\s+"
FORMATS = ("yyyy-M-d", "M/d/yyyy", "M-d-yyyy", "yyyy/M/d", "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM yyyy", "MMM yyyy", "d.M.yyyy", "d/M/yyyy", "d-M-yyyy")
#: What each part of a format may look like, at least: a text of another shape can't be read by it.
SHAPES = {"yyyy": r"[+-]?\d{4,}", "MMMM": r"[^\d\s]{3,}", "MMM": r"[^\d\s]{3,}", "M": r"0*(?:[1-9]|1[0-2])", "d": r"0*(?:[1-9]|[12]\d|3[01])"}
MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
PATTERNS = (
    r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b",
    r"\b\d{1,2}[-/]\d{1,2}[-/]\d{4}\b",
    r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2}\b",
    rf"\b(?:{MONTHS})\.?\s+\d{{1,2}},?\s+\d{{4}}\b",
    rf"\b\d{{1,2}}\s+(?:{MONTHS})\.?,?\s+\d{{4}}\b",
    rf"\b(?:{MONTHS})\.?\s+\d{{4}}\b",
    # blanks round the separators
    r"\b(?:0?[1-9]|1[0-2])\s*[/-]\s*(?:0?[1-9]|[12]\d|3[01])\s*[/-]\s*(?:19|20)\d{2}\b",
    # run together with other text; a digit ahead is no part of a month of two digits
    r"(?:(?<![\d/-])(?:0?[1-9]|1[0-2])|(?<=\d)(?:0[1-9]|1[0-2]))[/-](?:0?[1-9]|[12]\d|3[01])[/-](?:19|20)\d{2}",
    rf"(?:{MONTHS})\.?\d{{1,2}},?\d{{4}}",
    r"(?<=StatementDate|PaymentDate)\d{1,2}[/-]\d{1,2}[/-]\d{4}",
)


def shape(form: str) -> str:
    """An expression that every text fits that ``form`` can read."""
    return "^" + re.sub(r"yyyy|MMMM|MMM|M|d|\.", lambda m: SHAPES.get(m[0], r"\."), form) + "$"


def parse(c: Column) -> Column:
    """DAT-03: the date that a text is, by the first format that fits; years of two digits below 50 are of this century.  Else null.

    The text is cleaned once, and only formats of its shape are tried: one that fails costs an exception.
    """
    return F.get(F.transform(F.array(_cleaned(c)), _read), 0)


def _cleaned(c: Column) -> Column:
    v = F.regexp_replace(text.strip(c), r"\.(?=\s)", "")
    return F.regexp_replace(F.regexp_replace(v, r"(?<=\d)\s*([/-])\s*(?=\d)", "$1"), rf"(?i)^({MONTHS})\.?(\d{{1,2}}),?(\d{{4}})$", "$1 $2 $3")


def _read(v: Column) -> Column:
    short = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{2})$"
    part = lambda k: F.regexp_extract(v, short, k).try_cast("int")
    year = F.when(part(3) < 50, part(3) + 2000).otherwise(part(3) + 1900)
    two = F.when(v.rlike(short), F.try_to_date(F.concat_ws("-", year, part(1), part(2)), "yyyy-M-d"))
    return F.coalesce(two, *[F.when(v.rlike(shape(f)), F.try_to_date(v, f)) for f in FORMATS])


def statement_date(c: Column) -> Column:
    """DAT-01: the first date of a range as ISO text; what can't be read stays as it is."""
    inside = lambda start: F.coalesce(*[F.array_min(F.slice(F.filter(F.transform(F.regexp_extract_all(start, F.lit("(?i)" + p), 0), parse), lambda x: x.isNotNull()), 1, 1)) for p in PATTERNS])
    day = F.transform(F.array(F.get(F.split(text.strip(c), RANGE, 2), 0)), lambda start: F.coalesce(parse(start), inside(start)))
    return F.coalesce(F.date_format(F.get(day, 0), "yyyy-MM-dd"), c)


def find(c: Column) -> Column:
    """DAT-02: all dates in a line, form by form, each once."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?i)" + p), 0) for p in PATTERNS])))


# Label families, in order.
LABELS = {"statement": ("statement date", "report date", "statement"), "payment": ("payment date", "paid date", "check date", "pay date"), "period": ("period", "month ending", "cycle"), "effective": ("effective",), "due": ("due date",), "invoice": ("invoice", "bill date"), "processing": ("process", "run date", "generated")}


def date_type(label: Column) -> Column:
    """DAT-05: family of a label."""
    said = F.lower(F.coalesce(label, F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for name, words in LABELS.items():
        out = out.when(said.rlike("|".join(words)), name)
    return out.otherwise("unknown")


def label(line: Column, date: Column) -> Column:
    """DAT-04: struct of confidence and label: the nearest label before the date, .8 + .2 by nearness; else ``inferred`` with .2."""
    said = F.lower(F.coalesce(line, F.lit("")))
    at = F.instr(F.coalesce(line, F.lit("")), date)
    found = []
    for words in LABELS.values():
        for w in words:
            p = F.instr(said, F.lit(w))
            found.append(F.when((p > 0) & (p < at), F.struct(F.round(0.8 + 0.2 * (1 - F.least(F.lit(1.0), (at - p) / 100)), 6).alias("confidence"), F.lit(w).alias("label"))))
    return F.coalesce(F.array_max(F.array_compact(F.array(*found))), F.struct(F.lit(0.2).alias("confidence"), F.lit("inferred").alias("label")))


def valid_context(date: Column, context: Column) -> Column:
    """DAT-08: words of a statement permit a date; numbers of four digits and more on an id line and amounts next to it forbid it."""
    said = F.lower(F.coalesce(context, F.lit("")))
    return parse(date).isNotNull() & (said.rlike("statement|period|date|commission|report") | ~(said.rlike(r"(?:id|no|number|#)\W{0,3}\d{4,}") | said.rlike(r"\$\s*[\d,]+\.\d{2}")))


def context_label(line: Column, date: Column, context: Column) -> Column:
    """DAT-09: label of the line with max(.8, 1 - distance / 100), else of the context .6, else an indicator .5, else .3."""
    own = label(line, date)
    near = date_type(context)
    return (
        F.when(own["label"] != "inferred", F.struct(F.greatest(F.lit(0.8), own["confidence"]).alias("confidence"), own["label"].alias("label")))
        .when(near != "unknown", F.struct(F.lit(0.6).alias("confidence"), near.alias("label")))
        .when(F.lower(F.coalesce(context, F.lit(""))).rlike("date|as of"), F.struct(F.lit(0.5).alias("confidence"), F.lit("date").alias("label")))
        .otherwise(F.struct(F.lit(0.3).alias("confidence"), F.lit("inferred").alias("label")))
    )


def month(c: Column) -> Column:
    """DAT-06: year and month of a date text."""
    return F.date_format(parse(c), "yyyy-MM")


def looks_like_date(c: Column) -> Column:
    """DAT-07."""
    return F.coalesce(text.strip(c).rlike(r"^(\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})"), F.lit(False))


def best_dates(dates: Column, k: int = 5) -> Column:
    """SRT-09, SRT-13, SET-06: of structs (confidence, date, ...) the surest of each date, the k surest of those."""
    ordered = F.array_sort(dates, lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0))
    first = F.filter(ordered, lambda x, i: F.array_position(F.transform(ordered, lambda y: y["date"]), x["date"]) == i + 1)
    return F.slice(first, 1, k)
