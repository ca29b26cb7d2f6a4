"""Quality of extracted tables and of runs: AGG-35 to AGG-54."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgauge.functions import tables as tb
from gridgauge.functions import text


def spread(value: Column) -> list[Column]:
    """AGG-35: mean, population deviation, least, most."""
    return [F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]


def speed(runs: DataFrame, by: list[str], seconds: str, megabytes: str) -> DataFrame:
    """AGG-36: times and throughput."""
    return runs.groupBy(*by).agg(*spread(F.col(seconds)), F.sum(seconds).alias("total"), F.try_divide(F.sum(megabytes), F.sum(seconds)).alias("mb_s"))


def benchmark(results: DataFrame, by: list[str]) -> DataFrame:
    """AGG-37: success rate, mean quality, mean time without zeros, and a histogram of quality in five levels."""
    q = F.col("quality")
    bins = {"excellent": q >= 0.9, "good": (q >= 0.8) & (q < 0.9), "acceptable": (q >= 0.7) & (q < 0.8), "poor": (q >= 0.6) & (q < 0.7), "failed": q < 0.6}
    return results.groupBy(*by).agg(F.avg(F.col("ok").cast("double")).alias("success_rate"), F.avg("quality").alias("mean_quality"), F.avg(F.when(F.col("seconds") > 0, F.col("seconds"))).alias("mean_seconds"), *[F.count_if(c).alias(k) for k, c in bins.items()])


def hierarchy(rows: Column, flagged: Column) -> Column:
    """AGG-41: .5 if the payload says so, .6 if one of the first five rows names a company; can be above 1."""
    named = F.exists(F.slice(rows, 1, 5), lambda r: F.size(text.companies(F.concat_ws(" ", r))) > 0)
    return F.when(flagged, 0.5).otherwise(0.0) + F.when(named, 0.6).otherwise(0.0)


def validate(tables: DataFrame, confidence: Column) -> DataFrame:
    """AGG-38 to AGG-43: parts, overall score .25/.25/.25/.15/.10, level and issues of each table."""
    h, r = F.col("headers"), F.col("rows")
    t = tables.withColumns({"completeness": tb.completeness(h, r), "structure": tb.structure_score(h, r), "fidelity": tb.fidelity(h, r), "hierarchy": hierarchy(r, F.lit(False)), "confidence": confidence})
    t = t.withColumn("overall", 0.25 * F.col("completeness") + 0.25 * F.col("structure") + 0.25 * F.col("fidelity") + 0.15 * F.col("hierarchy") + 0.10 * F.col("confidence"))
    uneven = F.size(F.filter(r, lambda x: F.size(x) != F.size(h))) > 0.2 * F.size(r)
    issues = F.array_compact(F.array(F.when(F.size(r) == 0, "empty"), F.when(F.size(h) == 0, "no_headers"), F.when(uneven, "ragged"), F.when(F.col("overall") < 0.6, "low_score")))
    return t.withColumns({"level": tb.level(F.col("overall")), "issues": issues})


def graded(headers: Column, rows: Column, confidence: Column) -> Column:
    """AGG-44: struct of score and letter: structure (1, ragged .5), completeness and the run's own confidence, averaged."""
    score = (F.when(tb.ragged(headers, rows), 0.5).otherwise(1.0) + tb.completeness(headers, rows) + F.coalesce(confidence, F.lit(0.0))) / 3
    return F.struct(F.round(score, 6).alias("score"), tb.letter(score).alias("grade"))


def factors(tables: DataFrame, by: list[str]) -> DataFrame:
    """AGG-45: .3 for headers, .3 for rows, .2 for even rows, .2 for filled cells, added over a run's tables, at most 1."""
    h, r = F.col("headers"), F.col("rows")
    one = F.when(F.size(h) > 0, 0.3).otherwise(0.0) + F.when(F.size(r) > 0, 0.3).otherwise(0.0) + F.when(~tb.ragged(h, r), 0.2).otherwise(0.0) + 0.2 * tb.completeness(h, r)
    return tables.groupBy(*by).agg(F.least(F.sum(F.round(one, 9)), F.lit(1.0)).alias("score"))


def consistency(confidence: Column, value: Column, texts: Column) -> Column:
    """AGG-46: confidence and .1 for each text that mentions the value, at most 1."""
    n = F.size(F.filter(texts, lambda t: F.contains(F.lower(F.coalesce(t, F.lit(""))), F.lower(value))))
    return F.least(F.lit(1.0), confidence + 0.1 * n)


def overall_confidence(carrier: Column, date: Column, tables: Column, text_: Column, layout: Column) -> Column:
    """AGG-47: weights .3, .3, .2, .1, .1, kept within 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.3 * carrier + 0.3 * date + 0.2 * tables + 0.1 * text_ + 0.1 * layout))


def fallback_quality(headers: Column, rows: Column) -> Column:
    """AGG-48: .3 filled cells, .3 even rows, .2 columns of one kind, .2 headers with words."""
    n = F.size(headers)
    even = F.when(F.size(rows) > 0, F.size(F.filter(rows, lambda r: F.size(r) == n)) / F.size(rows)).otherwise(0.0)
    one_kind = lambda i: F.size(F.array_distinct(F.transform(F.filter(F.transform(rows, lambda r: F.get(r, i)), lambda x: ~tb.blank(x)), text.data_type))) <= 1
    coherent = F.when(n > 0, F.size(F.filter(tb.numbers_to(n), one_kind)) / n).otherwise(0.0)
    worded = F.when(n > 0, F.size(F.filter(headers, lambda h: F.coalesce(h, F.lit("")).rlike("[A-Za-z]{2,}"))) / n).otherwise(0.0)
    return 0.3 * tb.completeness(headers, rows) + 0.3 * even + 0.2 * coherent + 0.2 * worded


def keep_good(tables: DataFrame, least: float = 0.3) -> DataFrame:
    """FLT-20: tables of that quality at least, with white space in cells collapsed."""
    tidy = F.transform("rows", lambda r: F.transform(r, text.sanitize))
    return tables.withColumn("rows", tidy).where(fallback_quality(F.col("headers"), F.col("rows")) >= least)


def cell_profile(cells: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """AGG-49: share of empty cells, numbers, dates, amounts and percentages; mean and deviation of lengths; warnings."""
    v = text.strip(F.coalesce(F.col(value), F.lit("")))
    kind = lambda k: F.count_if(text.data_type(v) == k)
    got = cells.groupBy(*by).agg(F.avg((v == "").cast("double")).alias("empty_share"), kind("number").alias("numbers"), kind("date").alias("dates"), kind("currency").alias("amounts"), kind("percentage").alias("percentages"), F.avg(F.length(v)).alias("mean_length"), F.stddev_pop(F.length(v)).alias("std_length"))
    return got.withColumn("warnings", F.array_compact(F.array(F.when(F.col("empty_share") > 0.5, "mostly_empty"), F.when(F.col("mean_length") < 2, "very_short"), F.when(F.col("std_length") > 2 * F.col("mean_length"), "uneven"))))


def column_profile(cells: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """AGG-53: lengths, kinds of characters, case, numbers, words of a column's cells that aren't empty."""
    v = F.col(value)
    share = lambda p: F.sum(F.regexp_count(v, F.lit(p))) / F.sum(F.length(v))
    rate = lambda c: F.avg(c.cast("double"))
    words = F.size(F.split(text.strip(v), r"\s+"))
    return cells.where(~tb.blank(v)).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.length(v)).alias("mean_length"), F.stddev_pop(F.length(v)).alias("std_length"), F.min(F.length(v)).alias("min_length"), F.max(F.length(v)).alias("max_length"),
        share("[A-Za-z]").alias("letters"), share("[0-9]").alias("digits"), share(r"[^A-Za-z0-9\s]").alias("others"), share(r"\s").alias("spaces"),
        rate(v == F.upper(v)).alias("upper"), rate(v == F.lower(v)).alias("lower"), rate(tb.numeric(v)).alias("numeric"), rate(v.rlike(r"^-?\d+\.\d+$")).alias("decimal"), rate(v.contains("$")).alias("currency"),
        F.avg(words).alias("mean_words"), F.max(words).alias("max_words"),
    )


def fits_column(value: Column, profile: Column) -> Column:
    """TBL-42: length within two deviations of the mean, and digits or letters where the column has them."""
    n = F.length(value)
    near = F.abs(n - profile["mean_length"]) <= 2 * F.greatest(profile["std_length"], F.lit(1.0))
    digits = F.regexp_count(value, F.lit("[0-9]")) / F.greatest(n, F.lit(1))
    return near & (F.abs(digits - profile["digits"]) <= 0.5)


def diversity(rows: Column) -> Column:
    """AGG-54: the data types in a table's rows."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.flatten(rows), lambda x: ~tb.blank(x)), text.data_type)))


def commission_summary(cells: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """AGG-50: sum, number and mean of positive numbers; the mean divides by one at least."""
    n = F.regexp_replace(F.coalesce(F.col(value), F.lit("")), r"[,$%\s]", "").try_cast("double")
    got = cells.where(n > 0).groupBy(*by).agg(F.sum(n).alias("total"), F.count("*").alias("n"))
    return got.withColumn("mean", F.col("total") / F.greatest(F.col("n"), F.lit(1)))


def percent_quality(tables: DataFrame, by: list[str]) -> DataFrame:
    """AGG-51: whole percent of the most that a run's tables could score, 1.5 each: headers .5, rows .5, completeness .5."""
    h, r = F.col("headers"), F.col("rows")
    one = F.when(F.size(h) > 0, 0.5).otherwise(0.0) + F.when(F.size(r) > 0, 0.5).otherwise(0.0) + 0.5 * tb.completeness(h, r)
    return tables.groupBy(*by).agg(F.floor(F.round(100 * F.sum(one) / (1.5 * F.count("*")), 9)).alias("percent"))


def preservation(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """AGG-52: share of tables and rows that a step kept."""
    count = lambda t, s: t.groupBy(*by).agg(F.count("*").alias(f"tables_{s}"), F.sum(F.size("rows")).alias(f"rows_{s}"))
    got = count(before, "before").join(count(after, "after"), by, "left").fillna(0)
    pct = lambda x: F.coalesce(100 * F.try_divide(F.col(f"{x}_after"), F.col(f"{x}_before")), F.lit(0.0)).alias(f"{x}_percent")
    return got.select(*by, pct("tables"), pct("rows"))


def complexity(cells: DataFrame, by: list[str]) -> DataFrame:
    """MTH-24: simple below 30 cells of under 15 characters at few places, else complex."""
    got = cells.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.length("value")).alias("mean_length"), F.count_distinct(F.round("x", -1), F.round("y", -1)).alias("places"))
    return got.withColumn("complexity", F.when((F.col("n") < 30) & (F.col("mean_length") < 15) & (F.col("places") <= F.col("n")), "simple").otherwise("complex"))
