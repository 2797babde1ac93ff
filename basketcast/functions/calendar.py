"""Calendar, holiday and time-of-day features as column expressions.

Everything here stays inside one projection: the holiday list is short and
fixed, so a membership test replaces a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketcast.constants import HOLIDAYS_2024, HOLIDAYS_ALL, TIME_BANDS


def parse_hour(value: Column | str) -> Column:
    """Hour of ``HH:mm:ss`` text, of a bare integer hour, else null."""
    text = F.trim((F.col(value) if isinstance(value, str) else value).cast("string"))
    clock = F.hour(F.try_to_timestamp(text, F.lit("H:mm:ss")))
    return F.coalesce(clock, text.try_cast("int"))


def weekday(date: Column | str) -> Column:
    """0 = Monday .. 6 = Sunday."""
    return F.weekday(date)


def is_weekend(date: Column | str) -> Column:
    return (F.weekday(date) >= 5).cast("int")


def week_of_month(date: Column | str) -> Column:
    """1 for days 1-7, 2 for days 8-14, and so on."""
    return F.floor((F.dayofmonth(date) - 1) / 7).cast("int") + 1


def is_listed_holiday(date: Column | str, holidays: Sequence[str] = HOLIDAYS_ALL) -> Column:
    column = F.col(date) if isinstance(date, str) else date
    return column.isin(*[F.to_date(F.lit(d)) for d in holidays]).cast("int")


def is_holiday_or_weekend(date: Column | str, holidays: Sequence[str] = HOLIDAYS_2024) -> Column:
    return F.greatest(is_listed_holiday(date, holidays), is_weekend(date))


def time_band(hour: Column | str) -> Column:
    """Band of the day, right-closed; hour 0 and null have none."""
    column = F.col(hour) if isinstance(hour, str) else hour
    lower, band = 0, None
    for upper, label in TIME_BANDS:
        inside = (column > lower) & (column <= upper)
        band = F.when(inside, label) if band is None else band.when(inside, label)
        lower = upper
    return band


def time_period(hour: Column | str) -> Column:
    """0 morning, 1 noon, 2 afternoon, 3 everything else (null included)."""
    column = F.col(hour) if isinstance(hour, str) else hour
    return (F.when((column >= 5) & (column < 11), 0)
            .when((column >= 11) & (column < 15), 1)
            .when((column >= 15) & (column < 19), 2)
            .otherwise(3))


def calendar_parts(df: DataFrame, date: str = "sale_date") -> DataFrame:
    return df.withColumns({"month": F.month(date), "day": F.dayofmonth(date), "weekday": weekday(date)})


def weekday1_dom(df: DataFrame, date: str = "sale_date") -> DataFrame:
    """Weekday counted from 1 and day of month."""
    return df.withColumns({"weekday1": weekday(date) + 1, "day_of_month": F.dayofmonth(date)})


def month_phase(df: DataFrame, date: str = "sale_date") -> DataFrame:
    """Flags for the first five days, from the 25th on, and between."""
    day = F.dayofmonth(date)
    return df.withColumns({
        "month_start": (day <= 5).cast("int"),
        "month_end": (day >= 25).cast("int"),
        "month_middle": ((day > 5) & (day < 25)).cast("int"),
    })


def nth_friday(df: DataFrame, date: str = "sale_date") -> DataFrame:
    friday = weekday(date) == 4
    return df.withColumns({
        "second_friday": (friday & (week_of_month(date) == 2)).cast("int"),
        "fourth_friday": (friday & (week_of_month(date) == 4)).cast("int"),
    })


def calendar_features(df: DataFrame, date: str = "sale_date", hour: str = "hour") -> DataFrame:
    """All date and hour features the scoring models read, in one projection."""
    out = nth_friday(month_phase(calendar_parts(df, date), date), date)
    return out.withColumns({
        "weekend": is_weekend(date),
        "week_of_month": week_of_month(date),
        "holiday": is_listed_holiday(date),
        "holiday_or_weekend": is_holiday_or_weekend(date),
        "time_band": time_band(hour),
        "time_period": time_period(hour),
    })


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(later, earlier)


def days_from_max(df: DataFrame, date: str = "sale_date", name: str = "days_from_max") -> DataFrame:
    """Days to the last date of the frame, which arrives as a scalar subquery."""
    last = df.agg(F.max(date).alias("last"))
    return df.withColumn(name, F.datediff(last.scalar(), F.col(date)))
