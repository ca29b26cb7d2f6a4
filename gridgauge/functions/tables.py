"""Functions over table values: ``headers`` is array<string>, ``rows`` array<array<string>>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridgauge.functions import text


def no_cells() -> Column:
    return F.array().cast("array<string>")


def no_rows() -> Column:
    return F.array().cast("array<array<string>>")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def blank(c: Column) -> Column:
    return text.strip(F.coalesce(c, F.lit(""))) == ""


def to_width(row: Column, width: Column | int) -> Column:
    """TBL-03, TBL-25, TBL-40: padded with empty cells or cut; null cells are empty."""
    w = F.lit(width) if isinstance(width, int) else width
    cells = F.transform(F.coalesce(row, no_cells()), lambda x: F.coalesce(x, F.lit("")))
    return let(cells, lambda c: F.slice(F.concat(c, F.array_repeat(F.lit(""), F.greatest(w - F.size(c), F.lit(0)))), 1, w))


def all_to_width(rows: Column, width: Column | int) -> Column:
    w = F.lit(width) if isinstance(width, int) else width
    return let(w, lambda n: F.transform(rows, lambda r: to_width(r, n)))


def widest(headers: Column, rows: Column) -> Column:
    return F.greatest(F.size(headers), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))


def numbers_to(n: Column) -> Column:
    """0 to n - 1; of nothing an empty array."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)


def reconcile(headers: Column, rows: Column) -> tuple[Column, Column]:
    """TBL-07: as many headers as the widest row has cells, new ones named ``Col n``; all rows that wide."""
    w = widest(headers, rows)
    return F.transform(numbers_to(w), lambda i: F.coalesce(F.get(headers, i), F.concat(F.lit("Col "), (i + 1).cast("string")))), all_to_width(rows, w)


def drop_empty(headers: Column, rows: Column) -> tuple[Column, Column]:
    """TBL-08: without columns whose header and cells are all empty, then without empty rows; unnamed columns become ``Column_n``."""
    held = F.filter(numbers_to(widest(headers, rows)), lambda i: ~blank(F.get(headers, i)) | F.exists(rows, lambda r: ~blank(F.get(r, i))))
    heads = F.transform(held, lambda i: F.when(i < F.size(headers), F.get(headers, i)).otherwise(F.concat(F.lit("Column_"), (i + 1).cast("string"))))
    cells = let(held, lambda own: F.transform(rows, lambda r: F.transform(own, lambda i: F.coalesce(F.get(r, i), F.lit("")))))
    return heads, F.filter(cells, lambda r: F.exists(r, lambda x: ~blank(x)))


def ragged(headers: Column, rows: Column) -> Column:
    """TBL-12: whether a row's width differs from the header's."""
    return F.exists(rows, lambda r: F.size(r) != F.size(headers))


def split_header(rows: Column, external: Column, names: Column) -> tuple[Column, Column]:
    """TBL-11: with an external header all rows are body, else the first one is the header; null cells are empty."""
    fill = lambda r: F.transform(r, lambda x: F.coalesce(x, F.lit("")))
    body = F.transform(rows, fill)
    return F.when(external, fill(names)).otherwise(F.coalesce(F.get(body, 0), no_cells())), F.when(external, body).otherwise(F.slice(body, 2, F.greatest(F.size(body), F.lit(1))))


def append(headers: Column, rows: Column, more: Column) -> Column:
    """TBL-34, SET-04: rows of a second table after those of the first, at the first one's width."""
    return F.concat(all_to_width(rows, F.size(headers)), all_to_width(more, F.size(headers)))


def auto_named(headers: Column) -> Column:
    """TBL-35: whether all headers are ``column 1``, ``column 2`` and so on."""
    return (F.size(headers) > 0) & F.forall(numbers_to(F.size(headers)), lambda i: F.lower(text.strip(F.get(headers, i))) == F.concat(F.lit("column "), (i + 1).cast("string")))


def unique_names(headers: Column) -> Column:
    """TBL-14: repeated headers get ``_1``, ``_2`` and so on; empty ones are named by place."""
    named = F.transform(numbers_to(F.size(headers)), lambda i: F.when(blank(F.get(headers, i)), F.concat(F.lit("Column_"), (i + 1).cast("string"))).otherwise(F.get(headers, i)))
    before = lambda all_, i: F.size(F.filter(F.slice(all_, 1, i), lambda x: x == F.get(all_, i)))
    nth = lambda all_, i: let(before(all_, i), lambda n: F.when(n > 0, F.concat_ws("_", F.get(all_, i), n)).otherwise(F.get(all_, i)))
    return let(named, lambda all_: F.transform(numbers_to(F.size(all_)), lambda i: nth(all_, i)))


def valid_structure(headers: Column, rows: Column) -> tuple[Column, Column]:
    """TBL-14: headers for every column, unique; rows at their width."""
    w = widest(headers, rows)
    return let(to_width(headers, w), unique_names), all_to_width(rows, w)


def header_from_data(rows: Column, i: Column) -> Column:
    """TBL-15: a name for column ``i`` by its first five values."""
    values = F.transform(F.slice(rows, 1, 5), lambda r: F.coalesce(F.get(r, i), F.lit("")))
    like = lambda p: F.exists(values, lambda v: v.rlike(p))
    return F.when(like(r"\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}"), "Date").when(like(r"\$\s*[\d,]+|^\d+\.\d{2}$"), "Amount").when(like(r"^[A-Za-z][A-Za-z .,&'-]{2,}$"), "Name").otherwise(F.concat(F.lit("Column_"), (i + 1).cast("string")))


def column_types(headers: Column, rows: Column) -> Column:
    """TBL-16: number, date, currency or text of each column, by up to ten samples that aren't empty."""
    def kind(i):
        values = F.slice(F.filter(F.transform(rows, lambda r: text.strip(F.coalesce(F.get(r, i), F.lit("")))), lambda v: v != ""), 1, 10)
        every = lambda p: (F.size(values) > 0) & F.forall(values, lambda v: v.rlike(p))
        return F.when(every(r"^-?[\d,]+(\.\d+)?$"), "number").when(every(r"^\d{1,4}[/-]\d{1,2}[/-]\d{1,4}$"), "date").when(every(r"^[($-]*\$\s*[\d,.]+\)?$"), "currency").otherwise("text")

    return F.transform(numbers_to(F.size(headers)), kind)


def nulls_for_blanks(rows: Column) -> Column:
    """TBL-17: empty cells are null, rows without a value go."""
    cells = F.transform(rows, lambda r: F.transform(r, lambda x: F.when(~blank(x), x)))
    return F.filter(cells, lambda r: F.exists(r, lambda x: x.isNotNull()))


def zip_headers(header_rows: Column) -> Column:
    """TBL-24: headers in several rows, joined column by column."""
    w = F.coalesce(F.array_max(F.transform(header_rows, F.size)), F.lit(0))
    return F.transform(numbers_to(w), lambda i: F.array_join(F.filter(F.transform(header_rows, lambda r: text.strip(F.coalesce(F.get(r, i), F.lit("")))), lambda x: x != ""), " "))


def split_compound(headers: Column) -> Column:
    """TBL-23: a header of two names, apart by two blanks, a slash with blanks or a line break, becomes two."""
    return F.flatten(F.transform(headers, lambda h: F.filter(F.transform(F.split(F.coalesce(h, F.lit("")), r"\s{2,}|\s+/\s+|\n"), text.strip), lambda x: x != "")))


def fill_sub_headers(headers: Column) -> Column:
    """TBL-13: a blank header takes the last one that isn't blank, with its place below it: ``Name 2``, ``Name 3``."""
    start = F.struct(no_cells().alias("out"), F.lit("").alias("parent"), F.lit(1).alias("n"))

    def step(acc, h):
        named = ~blank(h)
        parent, n = F.when(named, text.strip(F.coalesce(h, F.lit("")))).otherwise(acc["parent"]), F.when(named, 1).otherwise(acc["n"] + 1)
        name = F.when(named | (parent == ""), parent).otherwise(F.concat_ws(" ", parent, n))
        return F.struct(F.concat(acc["out"], F.array(name)).alias("out"), parent.alias("parent"), n.alias("n"))

    return F.aggregate(headers, start, step, lambda acc: acc["out"])


def chunk_lines(lines: Column, most: int) -> Column:
    """WIN-14, WIN-15: pieces joined up to ``most`` characters in order; a longer piece is alone."""
    start = F.struct(no_cells().alias("done"), F.lit("").alias("open"))

    def step(acc, x):
        fits = (acc["open"] == "") | (F.length(acc["open"]) + 1 + F.length(x) <= most)
        joined = F.when(acc["open"] == "", x).otherwise(F.concat(acc["open"], F.lit("\n"), x))
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(fits, joined).otherwise(x).alias("open"))

    return F.aggregate(lines, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def page_ranges(pages: Column, n: int) -> Column:
    """WIN-16: (first, last) of consecutive ranges of ``n`` pages, from 0."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(pages - 1, F.lit(0)), F.lit(n)), lambda a: a < pages)
    return F.transform(starts, lambda a: F.struct(a.alias("first"), (F.least(a + n, pages) - 1).alias("last")))


def representative_pages(pages: Column, k: int) -> Column:
    """SRT-08: the first three, evenly spaced ones between, and the last three pages, up to ``k`` in order."""
    every = numbers_to(pages)
    middle = max(k - 6, 0)
    spaced = F.transform(F.sequence(F.lit(1), F.lit(max(middle, 1))), lambda j: F.floor(3 + j * (pages - 6) / (middle + 1)).cast("int"))
    return F.when(pages <= k, every).otherwise(F.array_sort(F.array_distinct(F.concat(F.slice(every, 1, 3), spaced if middle else F.array().cast("array<int>"), F.transform(F.sequence(F.lit(3), F.lit(1)), lambda j: pages - j)))))


def corrections(before: Column, after: Column) -> Column:
    """TBL-33: cells at the same place that differ."""
    return F.aggregate(F.zip_with(before, after, lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))), F.lit(0), lambda acc, n: acc + n)


# --- numbers in cells ---------------------------------------------------------------------------------------------

NUMBER = r"([\d,]+(?:\.\d+)?)"
BRACKETS = (
    (rf"^\(\s*\$\s*{NUMBER}\s*\)", "money"),
    (rf"^\(\s*\$?\s*-\s*{NUMBER}\s*\$?\s*\)", "money"),
    (rf"^\\\(\s*\$?\s*{NUMBER}\s*\\\)", "money"),
    (rf"^\(\s*{NUMBER}\s*\)", "plain"),
    (rf"^\$\s*{NUMBER}", "positive"),
)


def monetary(c: Column) -> Column:
    """MTH-15: decimals, digit grouping, or a value from a cent to a billion."""
    n = F.regexp_replace(c, r"[,()$\s]", "").try_cast("double")
    return (c.contains(".") & (F.length(F.substring_index(c, ".", -1)) <= 2)) | c.contains(",") | F.coalesce(n.between(0.01, 1e9), F.lit(False))


def brackets(c: Column) -> Column:
    """MTH-14: accounting negatives, ``($1,200.00)`` as ``-$1200.00``; the first form that fits counts."""
    v = text.strip(F.coalesce(c, F.lit("")))
    out = F.when(F.lit(False), v)
    for pattern, kind in BRACKETS:
        n = F.regexp_replace(F.regexp_extract(v, pattern, 1), ",", "")
        sign = {"money": F.lit("-$"), "positive": F.lit("$"), "plain": F.when(monetary(v), "-$").otherwise("-")}[kind]
        out = out.when(v.rlike(pattern), F.concat(sign, n))
    return F.when(v == "", c).otherwise(out.otherwise(v))


def fix_brackets(rows: Column) -> Column:
    """TBL-29: every cell."""
    return F.transform(rows, lambda r: F.transform(r, brackets))


def numeric(c: Column) -> Column:
    """MTH-17: a number once ``,``, ``$`` and ``%`` are gone."""
    return F.regexp_replace(text.strip(F.coalesce(c, F.lit(""))), r"[,$%]", "").try_cast("double").isNotNull()


def format_number(c: Column) -> Column:
    """MTH-13: currency and percentage texts in one form: ``$1,234.50``, ``12.5%``; others as they are."""
    v = text.strip(F.coalesce(c, F.lit("")))
    n = F.regexp_replace(v, r"[,$%()\s]", "").try_cast("double")
    minus = v.rlike(r"^\(|^-|^\$-")
    money = F.concat(F.when(minus, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(n), 2))
    return F.when(n.isNull(), v).when(v.contains("%"), F.concat(F.regexp_replace(F.format_number(n, 4), r"\.?0+$", ""), F.lit("%"))).when(v.contains("$") | v.rlike(r"^\("), money).otherwise(v)


def size_class(pages: Column) -> Column:
    """MTH-19: small, medium, large or max, by pages, with the time limit in seconds."""
    name = F.when(pages <= 10, "small").when(pages <= 50, "medium").when(pages <= 100, "large").otherwise("max")
    return F.struct(name.alias("size"), F.when(pages <= 10, 300).when(pages <= 50, 600).when(pages <= 100, 1200).otherwise(1800).alias("seconds"))


def text_tokens(c: Column) -> Column:
    """MTH-20: about a token for four characters."""
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)


def page_tokens(pages: Column, digital: Column) -> Column:
    """MTH-20: 750 tokens a page, three tenths of that for text pages."""
    return F.floor(pages * 750 * F.when(digital, 0.3).otherwise(1.0))


def filled(row: Column) -> Column:
    """Share of cells that aren't empty."""
    return F.when(F.size(row) > 0, F.size(F.filter(row, lambda x: ~blank(x))) / F.size(row)).otherwise(0.0)


def completeness(headers: Column, rows: Column) -> Column:
    """AGG-38: cells that aren't empty over headers x rows, at most 1."""
    cells = F.aggregate(rows, F.lit(0), lambda acc, r: acc + F.size(F.filter(r, lambda x: ~blank(x))))
    room = F.size(headers) * F.size(rows)
    return F.when(room > 0, F.least(F.lit(1.0), cells / room)).otherwise(0.0)


def structure_score(headers: Column, rows: Column) -> Column:
    """AGG-39: meaningful headers 0.4, consistent rows 0.4, 6 to 500 cells 0.2."""
    n = F.size(headers)
    meaningful = F.when(n > 0, F.size(F.filter(headers, lambda h: ~blank(h) & (F.length(text.strip(h)) > 1) & ~F.lower(h).rlike(r"^column[_ ]?\d+$"))) / n).otherwise(0.0)
    even = F.when(F.size(rows) > 0, F.size(F.filter(rows, lambda r: F.size(r) == n)) / F.size(rows)).otherwise(0.0)
    return 0.4 * meaningful + 0.4 * even + F.when((n * F.size(rows)).between(6, 500), 0.2).otherwise(0.0)


def fidelity(headers: Column, rows: Column) -> Column:
    """AGG-40: of the first ten rows' filled cells the share of amounts, percentages and decimals x 0.6, and headers with a company term x 0.4."""
    cells = F.filter(F.flatten(F.slice(rows, 1, 10)), lambda x: ~blank(x))
    like = F.size(F.filter(cells, lambda x: x.rlike(r"^[($-]*\$?\s*[\d,]+\.\d{2}\)?$|^\$\s*[\d,]+|^-?\d+(\.\d+)?\s*%$")))
    term = F.exists(headers, lambda h: F.lower(F.coalesce(h, F.lit(""))).rlike("company|group|client|customer|carrier"))
    return F.when(F.size(cells) > 0, 0.6 * like / F.size(cells)).otherwise(0.0) + F.when(term, 0.4).otherwise(0.0)


def text_table_confidence(headers: Column, rows: Column) -> Column:
    """MTH-21: .3, .3 by meaningful headers, .4 by filled cells."""
    meaningful = F.when(F.size(headers) > 0, F.size(F.filter(headers, lambda h: F.length(text.strip(F.coalesce(h, F.lit("")))) > 2)) / F.size(headers)).otherwise(0.0)
    return F.least(F.lit(1.0), 0.3 + 0.3 * meaningful + 0.4 * completeness(headers, rows))


def mostly_empty(row: Column) -> Column:
    """MTH-23: at least nine tenths of the cells are empty."""
    return (F.size(row) == 0) | (F.size(F.filter(row, blank)) / F.size(row) >= 0.9)


def letter(score: Column) -> Column:
    """AGG-44: grade of a score."""
    return F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.7, "C").when(score >= 0.6, "D").otherwise("F")


def level(score: Column) -> Column:
    """AGG-42: level of an overall score."""
    return F.when(score >= 0.9, "excellent").when(score >= 0.8, "good").when(score >= 0.7, "acceptable").when(score >= 0.6, "poor").otherwise("failed")
