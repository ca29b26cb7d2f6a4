"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Filename words that name no carrier.
NO_CARRIER = "statement commission report monthly annual summary final original finalized copy scan scanned pdf doc docx".split()
# OCR repairs of the letter O in numbers, in order.
OCR_RULES = (
    (r"(\d)O(\d)", "$10$2"),
    (r"(\$)O(\d)", "$10$2"),
    (r"2O2([0-9])", "202$1"),
    (r"(\d)O(\d)\.O(\d)", "$10$2.0$3"),
    (r"\.O(\d)", ".0$1"),
    (r"(\d)O\.O%", "$10.0%"),
    (r"([A-Z]{2})O+(\d+)", "$100$2"),
    (r"([A-Z]{2}\d+)O+", "$10"),
    (r" O(\d) ", " 0$1 "),
)
SPACE = r"(?U)\s"


def replace(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def strip(c: Column) -> Column:
    """All white space at both ends, not only blanks."""
    return replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def cell(c: Column) -> Column:
    """STR-01: a table cell as it is compared: trimmed, lower case, without currency signs and digit grouping, white space collapsed."""
    said = F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))
    said = replace(said, r"[$€£¥₹]", "")
    said = replace(said, r"(?<=\d),(?=\d{3})", "")
    return strip(replace(said, rf"{SPACE}+", " "))


def headers(c: Column) -> Column:
    """STR-02."""
    return F.transform(c, lambda x: F.lower(strip(F.coalesce(x, F.lit("")))))


def carrier(filename: Column) -> Column:
    """STR-03: the first meaningful word of a file name, its first letter upper case; else Unknown."""
    base = replace(filename, r"\.[^/.]+$", "")
    parts = F.transform(F.split(base, r"[\s_\-/]+"), lambda p: F.regexp_replace(p, r"[^a-zA-Z0-9&]", ""))
    fine = F.filter(parts, lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(*NO_CARRIER) & ~t.rlike(r"^\d"))
    first = F.get(fine, 0)
    return F.coalesce(F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 1_000_000)), F.lit("Unknown"))


def fix_ocr(c: Column, rules: int = len(OCR_RULES)) -> Column:
    """STR-04 (all rules) and STR-05 (the first so many, without the last)."""
    for pattern, to in OCR_RULES[:rules]:
        c = replace(c, pattern, to)
    return c


def clean(c: Column, dashes: bool = False) -> Column:
    """STR-06, and STR-07 with ``dashes``: runs of underscores (and dashes) are blanks, runs of dots one dot."""
    said = replace(F.coalesce(c, F.lit("")), r"_+", " ")
    if dashes:
        said = replace(said, r"-+", " ")
    said = replace(replace(replace(said, r"\.+", "."), r"[ \t]+", " "), r"\n{2,}", "\n")
    return strip(fix_ocr(said))


def drop_repeats(c: Column) -> Column:
    """STR-08: of directly repeated words and phrases of up to three words one stays, ignoring case."""
    for n in (3, 2, 1):
        phrase = r"\b(" + r"\s+".join([r"\w+"] * n) + r")(?:\s+\1\b)+"
        c = replace(c, "(?iU)" + phrase, "$1")
    return c


def sanitize(c: Column) -> Column:
    """STR-09: without control characters, white space collapsed."""
    return strip(replace(replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", ""), r"\s+", " "))


STATE_CODES = tuple(rf"\b[A-Z]{{2}}\d{{{n}}}\b" for n in (5, 4, 3, 2, 1)) + (r"\b[A-Z]{2}\d+\b",)


def fix_state_codes(c: Column) -> Column:
    """STR-11: O for 0 inside codes of two capitals and digits."""
    for pattern, to in ((r"\b([A-Z]{2})O{2,}(\d+)\b", "$100$2"), (r"\b([A-Z]{2})O(\d+)\b", "$10$2"), (r"\b([A-Z]{2}\d+)O{2,}\b", "$100"), (r"\b([A-Z]{2}\d+)O\b", "$10"), (r"\b([A-Z]{2}\d+)O(\d+)\b", "$10$2")):
        c = replace(c, pattern, to)
    return c


def clean_company(c: Column) -> Column:
    """STR-10: state codes repaired, then all codes of the first form that occurs removed."""
    said = fix_state_codes(F.coalesce(c, F.lit("")))
    out = F.lit(None).cast("string")
    for pattern in reversed(STATE_CODES):
        out = F.when(said.rlike(pattern), replace(said, pattern, "")).otherwise(out)
    return strip(replace(F.coalesce(out, said), r"\s+", " "))


# Company suffixes.
SUFFIXES = ("LLC", "Inc", "Corp", "Ltd", "Co", "LP", "LLP", "PC", "PA")
COMPANY_PATTERNS = (
    r"(?i)(?:company name|group name|client|customer)\s*:\s*([^\n|]+)",
    r"(?i)\b([a-z][\w&.,' -]*?\s(?:llc|inc|corp|ltd|llp|lp)\b\.?)",
    r"(?i)\b([a-z][\w&.,' -]*?\s(?:company|corporation|incorporated|group|associates|enterprises)\b)",
)


def companies(c: Column) -> Column:
    """STR-12: company names in a text, by pattern, longer than three characters, each once."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), 1) for p in COMPANY_PATTERNS])
    return F.array_distinct(F.filter(F.transform(found, strip), lambda x: F.length(x) > 3))


def company_score(c: Column, strict: bool = True) -> Column:
    """STR-13: suffix 0.4, length 0.3, character set 0.3; a name above 0.5 is valid.

    ``strict``: suffixes are looked up as written in an upper-cased name, so only all-capital ones count.
    """
    said = F.upper(strip(c))
    ends = SUFFIXES if not strict else tuple(s for s in SUFFIXES if s == s.upper())
    suffix = said.rlike(r"\b(" + "|".join(s.upper() for s in ends) + r")\b")
    return F.round(F.when(suffix, 0.4).otherwise(0.0) + F.when(F.length(said).between(3, 100), 0.3).otherwise(0.0) + F.when(said.rlike(r"^[A-Z0-9&.,'\- ]+$"), 0.3).otherwise(0.0), 6)


def is_header_row(row: Column) -> Column:
    """STR-14: a short row that names a company."""
    text = F.concat_ws(" ", row)
    return (F.size(F.filter(row, lambda x: strip(F.coalesce(x, F.lit(""))) != "")) <= 3) & (F.size(companies(text)) > 0) & ~is_transaction_row(row)


def is_transaction_row(row: Column) -> Column:
    """STR-14: a row with an amount, a percentage or a date."""
    return F.exists(row, lambda x: F.coalesce(x, F.lit("")).rlike(r"\$\s*[\d,]+(\.\d+)?|\d+(\.\d+)?\s*%|\d{1,2}/\d{1,2}/\d{2,4}"))


def contains_similarity(a: Column, b: Column) -> Column:
    """STR-16: share of the first text's characters that occur in the second; not symmetric."""
    x, y = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    hits = F.size(F.filter(F.split(x, ""), lambda ch: (ch != "") & F.contains(y, ch)))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(hits / F.greatest(F.length(x), F.length(y)))


def jaccard(a: Column, b: Column) -> Column:
    """SET-05: shared share of two arrays' distinct elements; of two empty ones 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def data_type(c: Column) -> Column:
    """STR-24: the first of date, currency, percentage, number, text that fits."""
    v = strip(F.coalesce(c, F.lit("")))
    return (
        F.when(v.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$|^\d{4}[/-]\d{1,2}[/-]\d{1,2}$"), "date").when(v.rlike(r"^[($-]*\$\s*[\d,]+(\.\d+)?\)?$"), "currency")
        .when(v.rlike(r"^-?[\d,]+(\.\d+)?\s*%$"), "percentage").when(v.rlike(r"^-?[\d,]+(\.\d+)?$"), "number").otherwise("text")
    )


def headers_look_like_data(h: Column) -> Column:
    """STR-25: whether so many headers look like values that the row is none of headers."""
    n = F.size(h)
    like = F.size(F.filter(h, lambda x: data_type(x) != "text"))
    return F.when(n > 0, like / n >= F.when(n >= 5, 0.4).otherwise(0.5)).otherwise(False)


def pattern_of(kind: Column) -> Column:
    """STR-18: the expression for values of a data type."""
    return F.when(kind == "date", r"^\d{1,4}[/-]\d{1,2}[/-]\d{1,4}$").when(kind == "currency", r"^[($-]*\$\s*[\d,]+(\.\d+)?\)?$").when(kind == "percentage", r"^-?[\d,]+(\.\d+)?\s*%$").when(kind == "number", r"^-?[\d,]+(\.\d+)?$").otherwise(r"^.+$")


def split_line(c: Column) -> Column:
    """STR-20: cells by the first separator that gives more than one: tab, pipe, two blanks, blank."""
    out = F.split(c, r"\s+")
    for sep in (r"\s{2,}", r"\s*\|\s*", r"\t"):
        out = F.when(F.size(F.split(c, sep)) > 1, F.split(c, sep)).otherwise(out)
    return F.transform(out, strip)


def gap_columns(c: Column, width: Column | int) -> Column:
    """STR-23: cells by gaps of three blanks or more, padded or cut to the header's width."""
    from gridgauge.functions.tables import to_width

    return to_width(F.filter(F.split(strip(c), r"\s{3,}"), lambda x: x != ""), width)


NOISE = r"^(?:[-_=.*\s]*|n/?a|null|none|page \d+(?: of \d+)?|[|\\/]+)$"


def drop_noise(row: Column) -> Column:
    """STR-17: a row without cells that hold nothing but rules, placeholders or page marks."""
    return F.filter(row, lambda x: ~F.lower(strip(F.coalesce(x, F.lit("")))).rlike(NOISE))


def page_score(text: Column, page: Column, pages: Column) -> Column:
    """STR-21: how likely a page is to hold the statement's tables: position, words for and against, length, dates."""
    said = F.lower(F.coalesce(text, F.lit("")))
    score = F.when(page == 0, 10).when(page < pages * 0.3, 5).when(page >= pages - 1, -5).otherwise(0)
    for word in ("commission", "statement", "total", "summary", "premium", "policy", "agent"):
        score = score + F.when(said.contains(word), 5).otherwise(0)
    for word in ("terms and conditions", "disclaimer", "privacy", "legal notice"):
        score = score - F.when(said.contains(word), 10).otherwise(0)
    return score + F.when(F.length(said) > 500, 3).otherwise(0) + F.when(said.rlike(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"), 3).otherwise(0)


def digital_pdf(text: Column) -> Column:
    """STR-22: more than 100 characters on the first pages, and a word of the domain."""
    said = F.lower(F.coalesce(text, F.lit("")))
    return (F.length(strip(said)) > 100) & said.rlike("commission|statement|premium|policy|agent|broker")


def safe_filename(name: Column, fallback: str = "results.csv") -> Column:
    """SNK-07: stem of letters, digits and ``._- ``, at most 120 characters, with the suffix ``_results.csv``."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1)
    stem = F.substring(strip(replace(replace(base, r"(?<=.)\.[^.]*$", ""), r"[^\p{L}\p{N}._ \-]", "")), 1, 120)
    return F.when(stem == "", F.lit(fallback)).otherwise(F.concat(stem, F.lit("_results.csv")))


def file_format(path: Column) -> Column:
    """SRC-17: kind of document by the path's extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext.isin("docx", "doc"), "docx").when(ext.isin("png", "jpg", "jpeg", "tif", "tiff", "bmp"), "image").when(ext.isin("xlsx", "xls", "xlsm"), "excel").otherwise("unknown")


# Words by which a carrier is found in a text.
CARRIERS = {"Aetna": ("aetna",), "Blue Cross Blue Shield": ("blue cross", "blue shield", "bcbs"), "Cigna": ("cigna",), "Humana": ("humana",), "UnitedHealthcare": ("united ?healthcare", "uhc"), "Allied": ("allied",), "Kaiser Permanente": ("kaiser",), "Anthem": ("anthem",)}


def carrier_in_text(c: Column) -> Column:
    """STR-15: struct of carrier and confidence: min(.9, .5 + .1 n), .2 more in a heading; the surest carrier, null without any."""
    said = F.lower(F.coalesce(c, F.lit("")))
    head = F.substring(said, 1, 200)
    found = []
    for name, patterns in CARRIERS.items():
        p = r"\b(?:" + "|".join(patterns) + r")\b"
        n = F.regexp_count(said, F.lit(p))
        conf = F.least(F.lit(0.9), 0.5 + 0.1 * n) + F.when(head.rlike(p), 0.2).otherwise(0.0)
        found.append(F.when(n > 0, F.struct(F.round(F.least(F.lit(1.0), conf), 6).alias("confidence"), F.lit(name).alias("carrier"))))
    return F.array_max(F.array_compact(F.array(*found)))
