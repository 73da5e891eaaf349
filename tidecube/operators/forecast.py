"""Zero-filled grids and features that know only the past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecube.functions import trips as fn


def source_free_demand(cube: DataFrame) -> DataFrame:
    rows = cube.dropna(subset=["PULocationID", "pickup_date", "pickup_hour", "trip_count"])
    return rows.groupBy("PULocationID", "pickup_date", "pickup_hour").agg(F.sum(F.col("trip_count").cast("double")).alias("trip_count"))


def modelling_dates(demand: DataFrame, stride: int = 1) -> DataFrame:
    dates = demand.select("pickup_date").distinct()
    return dates if stride <= 1 else dates.where(F.pmod(F.dayofyear("pickup_date"), F.lit(stride)) == 1)


CELL = ["PULocationID", "pickup_day_of_week", "pickup_hour"]
#: Levels of history: their keys, and how many grid rows a day of theirs has (of hours and zones).
LEVELS = {
    "location": (["PULocationID"], lambda hours, zones: hours),
    "location_hour": (["PULocationID", "pickup_hour"], lambda hours, zones: F.lit(1)),
    "location_dow_hour": (CELL, lambda hours, zones: F.lit(1)),
    "hour": (["pickup_hour"], lambda hours, zones: zones),
}


def cells(demand: DataFrame) -> DataFrame:
    """Demand by zone, weekday, hour and month, each with its days that have trips, five at most. What SparseGrid is made of;
    to be written once where it is read more than once."""
    d = F.col("pickup_date")
    rows = demand.select("PULocationID", "pickup_hour", d, "trip_count", F.dayofweek(d).alias("pickup_day_of_week"), fn.month_index(F.year(d), F.month(d)).alias("month_index"))
    return rows.groupBy(*CELL, "month_index").agg(F.collect_list(F.struct("pickup_date", "trip_count")).alias("days"))


class SparseGrid:
    """Every zone, date and hour, 0 where there were no trips, without a row for the zeros.

    Sums and busy hours of the finest key (zone, weekday, hour, month) come from observed rows; coarser keys add these up.
    Zeros are arithmetic: the rows that a key has by the calendar, less those observed. Histories are prefix sums over the
    months of a key, as arrays with an entry for each month. Rows of the grid are only made at the end, from one row for each
    zone, weekday and hour, so nothing of the grid's size is shuffled or joined.
    """

    def __init__(self, cells: DataFrame, stride: int = 1, hours: int = 24):
        spark, day = cells.sparkSession, F.col("pickup_date")
        self.hours = hours
        self.zones = cells.select("PULocationID").distinct()
        dates = cells.select(F.explode("days.pickup_date").alias("pickup_date")).distinct()
        days = F.col("days")
        if stride > 1:
            on = lambda d: F.pmod(F.dayofyear(d), F.lit(stride)) == 1
            dates, days = dates.where(on(day)), F.filter("days", lambda x: on(x["pickup_date"]))
        total = F.aggregate("days", F.lit(0.0), lambda acc, x: acc + x["trip_count"])
        busy = F.size(F.filter("days", lambda x: x["trip_count"] != 0))
        self.observed = cells.where(F.col("pickup_hour").between(0, hours - 1)).withColumn("days", days).withColumns({"total": total, "busy": busy})
        self.dates = dates.withColumns({"pickup_day_of_week": F.dayofweek(day), "month_index": fn.month_index(F.year(day), F.month(day))})
        #: one row: n_zones, months (each month of the grid in order, with its number of dates)
        month = self.dates.groupBy("month_index").agg(F.count("*").alias("n"))
        self.months = month.agg(F.sort_array(F.collect_list(F.struct("month_index", "n"))).alias("months")).join(self.zones.agg(F.count("*").alias("n_zones")))
        #: a row for each weekday: its months with their dates, and where they are in months
        month = self.dates.groupBy("pickup_day_of_week", "month_index").agg(F.sort_array(F.collect_list("pickup_date")).alias("dates"))
        month = month.groupBy("pickup_day_of_week").agg(F.sort_array(F.collect_list(F.struct("month_index", F.size("dates").alias("n"), "dates"))).alias("dow_months"))
        at = lambda x: (F.array_position(F.col("months.month_index"), x["month_index"]) - 1).cast("int")
        place = F.transform("dow_months", lambda x: F.struct(x["month_index"].alias("month_index"), x["n"].alias("n"), x["dates"].alias("dates"), at(x).alias("at")))
        self.weekdays = month.join(self.months).withColumn("dow_months", place)
        self.hour = spark.range(hours).select(F.col("id").cast("int").alias("pickup_hour"))

    def level(self, name: str) -> DataFrame:
        """Keys of a level that the grid has, each with months (its own, in order) and two arrays beside it: mean and zeros, the
        mean of its rows' trips and the share of rows without any."""
        keys, a_day = LEVELS[name]
        sums = self.observed.groupBy(*keys, "month_index").agg(F.sum("total").alias("total"), F.sum("busy").alias("busy"))
        sums = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("month_index", F.struct("total", "busy")))).alias("sums"))
        all_keys = self.zones if "PULocationID" in keys else None
        if "pickup_hour" in keys:
            all_keys = self.hour if all_keys is None else all_keys.crossJoin(self.hour)
        if "pickup_day_of_week" in keys:
            all_keys = all_keys.crossJoin(self.weekdays.drop("months").withColumnRenamed("dow_months", "months"))
        else:
            all_keys = all_keys.crossJoin(self.months)
        rows = lambda m: m["n"] * a_day(F.lit(self.hours), F.col("n_zones"))
        of = lambda m, c: F.coalesce(F.get(F.map_values(F.map_filter("sums", lambda k, v: k == m["month_index"])), F.lit(0))[c], F.lit(0))
        mean = F.transform("months", lambda m: of(m, "total") / rows(m))
        zeros = F.transform("months", lambda m: 1 - of(m, "busy") / rows(m))
        return all_keys.join(sums, keys, "left").select(*keys, F.transform("months", lambda m: m["month_index"]).alias("months"), mean.alias("mean"), zeros.alias("zeros"))

    def expanding(self, name: str, **measures: str) -> DataFrame:
        """For each key of a level and month the mean of its earlier months' values, each month alike; null in its first month.
        measures: mean or zeros by the name of what is made of it."""
        keys = LEVELS[name][0]
        found = F.arrays_zip("months", *[before(F.col(c)).alias(k) for k, c in measures.items()])
        return self.level(name).select(*keys, F.inline(found).alias("month_index", *measures))

    def previous_month(self) -> DataFrame:
        """The calendar month before, found by its key: a month without rows is a gap, not skipped."""
        rows = self.level("location_hour").select("PULocationID", "pickup_hour", F.inline(F.arrays_zip("months", "mean")).alias("month_index", "previous_month_location_hour_avg"))
        return rows.withColumn("month_index", F.col("month_index") + 1)

    def by_cell(self, with_history: bool) -> DataFrame:
        """A row for each zone, weekday, hour and month: its dates, its days with trips and, if asked for, its histories."""
        days = self.observed.groupBy(*CELL).agg(F.map_from_entries(F.collect_list(F.struct("month_index", "days"))).alias("days"))
        out = self.zones.crossJoin(self.weekdays).crossJoin(self.hour).join(days, CELL, "left")
        pick = {"days": lambda x, i: F.get(F.map_values(F.map_filter("days", lambda k, v: k == x["month_index"])), F.lit(0))}
        if with_history:
            z, h, zh, zdh = (self.level(k) for k in ("location", "hour", "location_hour", "location_dow_hour"))
            out = out.join(z.select("PULocationID", before(F.col("mean")).alias("z")), "PULocationID").join(h.select("pickup_hour", before(F.col("mean")).alias("h")), "pickup_hour")
            out = out.join(zh.select("PULocationID", "pickup_hour", before(F.col("mean")).alias("zh"), before(F.col("zeros")).alias("zr"), F.col("mean").alias("month_mean")), ["PULocationID", "pickup_hour"])
            out = out.join(zdh.select(*CELL, before(F.col("mean")).alias("zdh")), CELL)
            earlier = lambda x: F.when(F.get(F.col("months.month_index"), x["at"] - 1) == x["month_index"] - 1, F.get("month_mean", x["at"] - 1))
            pick |= {
                "location_avg": lambda x, i: F.get("z", x["at"]), "location_hour_avg": lambda x, i: F.get("zh", x["at"]), "location_hour_zero_rate": lambda x, i: F.get("zr", x["at"]),
                "location_dow_hour_avg": lambda x, i: F.get("zdh", i), "previous_month_location_hour_avg": lambda x, i: earlier(x), "hour_avg": lambda x, i: F.get("h", x["at"]),
            }
        month = F.transform("dow_months", lambda x, i: F.struct(x["month_index"].alias("month_index"), x["dates"].alias("dates"), *[v(x, i).alias(k) for k, v in pick.items()]))
        return out.select(*CELL, F.inline(month))

    def rows(self, with_history: bool = False) -> DataFrame:
        """The grid itself, as large as zones x dates x hours: with_history adds hour_avg and the features that filled completes."""
        out = self.by_cell(with_history).withColumn("pickup_date", F.explode("dates"))
        d = F.col("pickup_date")
        trips = F.coalesce(F.get(F.filter("days", lambda x: x["pickup_date"] == d), F.lit(0))["trip_count"], F.lit(0.0))
        return out.withColumns({
            "trip_count": trips, "pickup_year": F.year(d), "pickup_month": F.month(d), "pickup_day": F.dayofmonth(d), "is_weekend": fn.is_weekend(F.dayofweek(d)),
        }).drop("dates", "days")

    def with_history(self) -> DataFrame:
        return filled(self.rows(True))

    def pooled(self) -> dict[str, DataFrame]:
        """Means over all years; the month table is by calendar month, to be joined on the month before."""
        month = F.pmod(F.col("month_index") - 1, F.lit(12)) + 1
        total = F.sum("total").alias("total")
        observed = self.observed.withColumn("previous_month", month)
        dates, hours = self.dates.withColumn("previous_month", month), self.hour
        zone, zone_hour = self.zones, self.zones.crossJoin(hours)
        n_all, n_dow, n_month = (dates.groupBy(*by).agg(F.count("*").alias("n")) for by in ([], ["pickup_day_of_week"], ["previous_month"]))

        def mean(keys: list[str], known: DataFrame, rows, **measures) -> DataFrame:
            sums = observed.groupBy(*keys).agg(total, F.sum("busy").alias("busy"))
            filled_sums = known.join(sums, keys, "left").withColumns({"n": rows(F.col("n")), "total": F.coalesce("total", F.lit(0.0)), "busy": F.coalesce("busy", F.lit(0))})
            return filled_sums.where("n > 0").select(*keys, *[v.alias(k) for k, v in measures.items()])

        avg, same = F.col("total") / F.col("n"), lambda n: n
        return {
            "location": mean(["PULocationID"], zone.join(n_all), lambda n: n * self.hours, location_avg=avg),
            "location_hour": mean(["PULocationID", "pickup_hour"], zone_hour.join(n_all), same, location_hour_avg=avg, location_hour_zero_rate=1 - F.col("busy") / F.col("n")),
            "location_dow_hour": mean(CELL, zone_hour.crossJoin(n_dow), same, location_dow_hour_avg=avg),
            "previous": mean(["PULocationID", "previous_month", "pickup_hour"], zone_hour.crossJoin(n_month), same, previous_month_location_hour_avg=avg),
        }


def grid(demand: DataFrame, stride: int = 1, hours: int = 24) -> DataFrame:
    """Every zone, date and hour with its trips, 0 where there were none. As large as zones x dates x hours by definition."""
    return SparseGrid(cells(demand), stride, hours).rows()


def with_history(rows: DataFrame | SparseGrid) -> DataFrame:
    """A grid with features that know only the past. Rows of demand stand for the grid of their zones, dates and 24 hours."""
    return (rows if isinstance(rows, SparseGrid) else SparseGrid(cells(rows))).with_history()


def before(values: Column) -> Column:
    """For each entry of an array the mean of those before it, null for the first."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out"))
    mean = lambda acc: F.when(F.size(acc["out"]) > 0, acc["sum"] / F.size(acc["out"]))
    step = lambda acc, v: F.struct((acc["sum"] + v).alias("sum"), F.concat(acc["out"], F.array(mean(acc))).alias("out"))
    return F.aggregate(values, start, step, lambda acc: acc["out"])


def filled(df: DataFrame) -> DataFrame:
    """Each average falls back to the one before it, which is filled by then."""
    df = df.withColumn("location_avg", F.coalesce("location_avg", "hour_avg", F.lit(0.0)))
    df = df.withColumn("location_hour_avg", F.coalesce("location_hour_avg", "location_avg"))
    df = df.withColumn("location_dow_hour_avg", F.coalesce("location_dow_hour_avg", "location_hour_avg"))
    df = df.withColumn("previous_month_location_hour_avg", F.coalesce("previous_month_location_hour_avg", "location_hour_avg"))
    return df.withColumn("location_hour_zero_rate", F.coalesce("location_hour_zero_rate", F.lit(1.0))).drop("hour_avg")


def serving_grid(zones: DataFrame, year: int, months: list[int]) -> DataFrame:
    """zones x months x weekdays x hours."""
    spark = zones.sparkSession
    ids = lambda n, name, first=0: spark.range(first, first + n).select(F.col("id").cast("int").alias(name))
    month = spark.createDataFrame([(m,) for m in months], "pickup_month int")
    out = zones.select("PULocationID").distinct().crossJoin(month).crossJoin(ids(7, "pickup_day_of_week", 1)).crossJoin(ids(24, "pickup_hour"))
    return out.withColumns({"pickup_year": F.lit(year), "is_weekend": fn.is_weekend(F.col("pickup_day_of_week")), "previous_month": fn.previous_month(F.col("pickup_month"))})


def forecast_features(target: DataFrame, known: SparseGrid) -> DataFrame:
    for part in known.pooled().values():
        target = target.join(part, [c for c in part.columns if c in target.columns], "left")
    return filled(target.withColumn("hour_avg", F.lit(0.0)))


def scored(predictions: DataFrame, zones: DataFrame) -> DataFrame:
    """prediction clamped at 0, rounded, banded, with its zone's names."""
    rows = predictions.withColumn("predicted_trip_count", F.round(fn.non_negative(F.col("prediction")).cast("decimal(30,10)"), 2).cast("double"))
    rows = rows.withColumn("demand_level", fn.fixed_band(F.col("predicted_trip_count")))
    return rows.join(zones.withColumnRenamed("location_id", "PULocationID"), "PULocationID", "left")
