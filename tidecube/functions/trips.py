"""Column functions: time parts, durations, speeds, labels, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of codes.
PAYMENT = {1: "Credit card", 2: "Cash", 3: "No charge", 4: "Dispute", 5: "Unknown", 6: "Voided trip"}
RATECODE = {1: "Standard rate", 2: "JFK", 3: "Newark", 4: "Nassau or Westchester", 5: "Negotiated fare", 6: "Group ride", 99: "Unknown"}
VENDOR = {1: "Creative Mobile Technologies", 2: "VeriFone Inc"}
COMPANY = {"HV0002": "Juno", "HV0003": "Uber", "HV0004": "Via", "HV0005": "Lyft"}
MONTHS = dict(enumerate("January February March April May June July August September October November December".split(), 1))
DAYS = {1: "Sunday", 2: "Monday", 3: "Tuesday", 4: "Wednesday", 5: "Thursday", 6: "Friday", 7: "Saturday"}
# End of fixed values.


def label(code: Column, names: dict, other: str) -> Column:
    out = F.lit(other)
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def duration_seconds(start: Column, end: Column) -> Column:
    return (end.cast("timestamp").cast("long") - start.cast("timestamp").cast("long")).cast("double")


def minutes(seconds: Column) -> Column:
    return F.round(seconds / 60, 2)


def is_weekend(day_of_week: Column) -> Column:
    return day_of_week.isin(1, 7)


def speed_mph(miles: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, F.round(miles / (seconds / 3600), 2))


def hour_timestamp(date: Column, hour: Column) -> Column:
    return F.timestamp_add("HOUR", hour, date.cast("timestamp"))


def month_index(year: Column, month: Column) -> Column:
    return year * 12 + month


def year_month(year: Column, month: Column) -> Column:
    return F.format_string("%04d-%02d", year.cast("int"), month.cast("int"))


def previous_month(month: Column) -> Column:
    return F.when(month == 1, 12).otherwise(month - 1)


def fixed_band(trips: Column) -> Column:
    """Upper limits excluded."""
    return F.when(trips < 20, "low").when(trips < 50, "medium").when(trips < 100, "high").otherwise("very_high")


def quartile_band(value: Column, q1: Column, q2: Column, q3: Column) -> Column:
    """Upper limits included."""
    return F.when(value <= q1, "low").when(value <= q2, "medium").when(value <= q3, "high").otherwise("very_high")


def demand_bucket(trips: Column) -> Column:
    return F.when(trips < 10, "0-9").when(trips < 50, "10-49").when(trips < 100, "50-99").when(trips < 250, "100-249").otherwise("250+")


def demand_bucket_order(trips: Column) -> Column:
    return F.when(trips < 10, 1).when(trips < 50, 2).when(trips < 100, 3).when(trips < 250, 4).otherwise(5)


def clock(hour: Column) -> Column:
    """12-hour clock: 0 is 12 AM."""
    twelve = F.pmod(hour, F.lit(12))
    return F.concat_ws(" ", F.when(twelve == 0, 12).otherwise(twelve).cast("string"), F.when(hour < 12, "AM").otherwise("PM"))


def age(seconds: Column) -> Column:
    part = lambda unit: F.floor(seconds / unit).cast("string")
    return F.when(seconds < 60, F.concat(part(1), F.lit(" s ago"))).when(seconds < 3600, F.concat(part(60), F.lit(" min ago"))).when(seconds < 86400, F.concat(part(3600), F.lit(" hr ago"))).otherwise(F.concat(part(86400), F.lit(" d ago")))


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def non_negative(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))
