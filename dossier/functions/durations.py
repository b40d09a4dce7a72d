"""Rendering of years and dates."""

from pyspark.sql import functions as F


def years_and_months(value):
    """2.5 -> '2 years 6 months'; months are rounded half to even and may reach 12."""
    value = F.coalesce(value, F.lit(0.0))
    years = value.try_cast("bigint")
    months = F.rint((value - years) * 12).cast("bigint")
    year_part = F.concat(years.cast("string"), F.when(years == 1, " year").otherwise(" years"))
    month_part = F.concat(months.cast("string"), F.when(months == 1, " month").otherwise(" months"))
    return (
        F.when((years > 0) & (months > 0), F.concat(year_part, F.lit(" "), month_part))
        .when(years > 0, year_part)
        .otherwise(month_part)
    )


def day(ts):
    return F.date_format(ts, "yyyy-MM-dd")
