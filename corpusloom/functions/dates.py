"""Date functions. Nothing reads the clock: the present is an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Forms of dates in search results, in the order in which they are tried.
FORMS = (
    ("\\d{4}-\\d{1,2}-\\d{1,2}", "yyyy-M-d"), ("\\d{4}/\\d{1,2}/\\d{1,2}", "yyyy/M/d"), ("\\d{4}\\.\\d{1,2}\\.\\d{1,2}", "yyyy.M.d"),
    ("\\d{1,2}/\\d{1,2}/\\d{4}", "M/d/yyyy"), ("\\d{1,2}/\\d{1,2}/\\d{4}", "d/M/yyyy"), ("\\d{1,2}\\.\\d{1,2}\\.\\d{4}", "d.M.yyyy"), ("\\d{1,2}\\.\\d{1,2}\\.\\d{4}", "M.d.yyyy"),
    ("[A-Za-z]{3} \\d{1,2}, \\d{4}", "MMM d, yyyy"), ("[A-Za-z]{3,9} \\d{1,2}, \\d{4}", "MMMM d, yyyy"), ("\\d{1,2} [A-Za-z]{3} \\d{4}", "d MMM yyyy"), ("\\d{1,2} [A-Za-z]{3,9} \\d{4}", "d MMMM yyyy"),
)
# Seconds of the units of relative dates.
UNITS = {"minute": 60, "hour": 3600, "day": 86_400, "week": 604_800, "month": 30 * 86_400, "year": 365 * 86_400}


def search_date(value: Column, as_of: Column) -> Column:
    """Time of a search result: ISO, one of the fixed forms, or relative to ``as_of``; null where nothing fits."""
    x = F.regexp_replace(F.trim(value), "(?i)^(updated|publiée?)[:\\s-]+", "")
    x = F.regexp_replace(x, "[·–—]", " ")
    x = F.regexp_replace(F.regexp_replace(x, "\\s+", " "), "^[ .\\-]+|[ .\\-]+$", "")
    x = F.regexp_replace(x, "\\b([A-Za-z]{3,9})\\.", "$1")
    x = F.regexp_replace(x, "(?i)(?<=\\d)(st|nd|rd|th)", "")
    cased = F.initcap(x)
    iso = F.when(x.rlike("^\\d{4}-\\d{2}-\\d{2}([T ]\\d{2}(:?\\d{2}(:?\\d{2}([.,]\\d+)?)?)?(Z|[+-]\\d{2}:?\\d{2})?)?$"), F.try_to_timestamp(F.regexp_replace(x, ",", ".")).cast("timestamp_ntz"))
    fixed = [F.when(x.rlike(f"^{shape}$"), F.try_to_timestamp(cased, F.lit(form)).cast("timestamp_ntz")) for shape, form in FORMS]
    now = as_of.cast("timestamp_ntz")
    n = F.regexp_extract(x, "(?i)^(?:about )?(\\d+) (minute|hour|day|week|month|year)s? ago$", 1)
    unit = F.lower(F.regexp_extract(x, "(?i)^(?:about )?(\\d+) (minute|hour|day|week|month|year)s? ago$", 2))
    seconds = F.create_map(*[v for k, s in UNITS.items() for v in (F.lit(k), F.lit(s))])[unit] * F.try_to_number(F.when(n != "", n).otherwise("0"), F.lit("999999999")).cast("long")
    ago = F.when(n != "", now - F.make_dt_interval(secs=seconds.cast("decimal(18,6)")))
    named = F.when(F.lower(x) == "today", now).when(F.lower(x) == "yesterday", now - F.expr("INTERVAL 1 DAY"))
    return F.coalesce(iso, *fixed, named, ago)


def extractor_date(value: Column) -> Column:
    """Time of an extraction result in one of three forms, else null."""
    return F.coalesce(*[F.try_to_timestamp(F.when(value.rlike(shape), value), F.lit(form)).cast("timestamp_ntz") for shape, form in (
        ("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}\\.\\d+Z$", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), ("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z$", "yyyy-MM-dd'T'HH:mm:ss'Z'"), ("^\\d{4}-\\d{2}-\\d{2}$", "yyyy-MM-dd"))])


def earlier(a: Column, b: Column) -> Column:
    return F.least(a, b)


def windows(spark: SparkSession, start: dt.date, end: dt.date, step: str) -> DataFrame:
    """(win_start, win_end) of consecutive windows of a day, week or month, the last one cut at ``end``.

    Months follow one another by date, each day of month cut to the shorter month once reached (31 January, 28 February, 28 March).
    """
    if start > end:
        raise ValueError("the start lies after the end")
    if step not in ("day", "week", "month"):
        raise ValueError(f"no such step: {step}")
    one = spark.range(1).select(F.lit(start).alias("a"), F.lit(end).alias("b"))
    if step == "month":
        months = F.sequence(F.lit(1), F.ceil(F.months_between("b", "a")).cast("int") + 1)
        starts = F.aggregate(months, F.array("a"), lambda acc, _: F.concat(acc, F.array(F.add_months(F.element_at(acc, -1), F.lit(1)))))
        # add_months keeps the day of its own argument, so the cut carries on
        starts = F.filter(starts, lambda d: d <= F.col("b"))
    else:
        starts = F.sequence("a", "b", F.expr(f"INTERVAL 1 {step}"))
    opened = one.select("b", F.posexplode(starts).alias("k", "win_start"))
    nexts = F.add_months("win_start", 1) if step == "month" else F.date_add("win_start", 1 if step == "day" else 7)
    return opened.select("win_start", F.least(F.date_sub(nexts, 1), "b").alias("win_end"))
