"""Row filters of the two feeds, counted in one pass, and data-quality audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def in_years(ts: Column, years: list[int]) -> Column:
    """year(ts) in years; for years in a row as a range of ts, which scans can push down."""
    years = sorted(set(years))
    if years and years == list(range(years[0], years[-1] + 1)):
        return (ts >= F.lit(f"{years[0]}-01-01").cast("timestamp")) & (ts < F.lit(f"{years[-1] + 1}-01-01").cast("timestamp"))
    return F.year(ts).isin(years)


def seconds_between(start: Column, end: Column) -> Column:
    return end.cast("timestamp").cast("long") - start.cast("timestamp").cast("long")


def yellow_steps(years: list[int], max_hours: float = 3, max_miles: float = 100, passengers=(1, 6), least_fare: float = 0.01, vendors=(1, 2), ratecodes=(1, 2, 3, 4, 5, 6, 99), payments=(1, 2, 3, 4, 5, 6)) -> list[tuple[str, Column]]:
    """Name and condition of each cleaning step; a row whose condition is null goes, as do rows with null codes."""
    c = F.col
    minutes = seconds_between(c("tpep_pickup_datetime"), c("tpep_dropoff_datetime")) / 60.0
    return [
        ("valid_years", in_years(c("tpep_pickup_datetime"), years)),
        ("time_order", c("tpep_dropoff_datetime") > c("tpep_pickup_datetime")),
        ("duration", (minutes >= 1.0) & (minutes <= max_hours * 60)),
        ("distance", (c("trip_distance") > 0) & (c("trip_distance") <= max_miles)),
        ("passengers", c("passenger_count").between(*passengers)),
        ("fare", (c("fare_amount") >= least_fare) & (c("total_amount") >= least_fare)),
        ("codes", c("VendorID").isin(*vendors) & c("RatecodeID").isin(*[float(r) for r in ratecodes]) & c("payment_type").isin(*payments)),
    ]


def hvfhv_steps(years: list[int], max_miles: float = 100, seconds=(60, 10800), least_fare: float = 0.01) -> list[tuple[str, Column]]:
    c = F.col
    needed = ["hvfhs_license_num", "pickup_datetime", "dropoff_datetime", "PULocationID", "DOLocationID"]
    return [
        ("required", reduce(Column.__and__, [c(x).isNotNull() for x in needed])),
        ("valid_years", in_years(c("pickup_datetime"), years)),
        ("time_order", c("dropoff_datetime") > c("pickup_datetime")),
        ("distance", (c("trip_miles") > 0) & (c("trip_miles") <= max_miles)),
        ("duration", c("trip_time").between(*seconds)),
        ("fare", c("base_passenger_fare") >= least_fare),
    ]


def cleaned(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    return reduce(lambda d, s: d.where(s[1]), steps, df)


def step_counts(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """step, step_order, rows_before, rows_after and rows_removed of steps in order: one pass of conditional sums."""
    passed, sums = F.lit(True), [F.count("*").alias("n0")]
    for k, (_, condition) in enumerate(steps, 1):
        passed = passed & F.coalesce(condition, F.lit(False))
        sums.append(F.sum(passed.cast("long")).alias(f"n{k}"))
    total = df.agg(*sums).fillna(0)
    rows = F.array(*[F.struct(F.lit(name).alias("step"), F.lit(k).cast("long").alias("step_order"), F.col(f"n{k - 1}").alias("rows_before"), F.col(f"n{k}").alias("rows_after")) for k, (name, _) in enumerate(steps, 1)])
    return total.select(F.explode(rows).alias("r")).select("r.*", (F.col("r.rows_before") - F.col("r.rows_after")).alias("rows_removed"))


class Counted:
    """Cleaning that counts on the way: rows are what all steps keep, and the job that writes them tells how many rows each step
    had and kept, which columns have nulls, and whether any row is left.

    The counts are there once one action over rows has ended, and they are that action's. Nothing is read for them alone. All of
    it is counted before the first shuffle, so a task that is tried again counts once.
    """

    def __init__(self, df: DataFrame, steps: list[tuple[str, Column]], audited: list[str] | None = None):
        self.names, self.audited = [name for name, _ in steps], df.columns if audited is None else audited
        self._steps, self._nulls = Observation(), Observation()
        passed, reached = F.lit(True), F.lit(0)
        for _, condition in steps:
            passed = passed & F.coalesce(condition, F.lit(False))
            reached = reached + passed.cast("int")
        at = "_steps_passed"
        counts = [F.count("*").alias("n0"), *[F.count_if(F.col(at) >= k).alias(f"n{k}") for k in range(1, len(steps) + 1)]]
        kept = df.withColumn(at, reached).observe(self._steps, *counts).where(F.col(at) == len(steps)).drop(at)
        self.rows = kept.observe(self._nulls, F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{k}") for k, c in enumerate(self.audited)])

    def written(self, path: str) -> DataFrame:
        """rows as Parquet, read again; an error if none is left, after they are written."""
        self.rows.write.mode("overwrite").parquet(path)
        if not self._nulls.get["rows"]:
            raise ValueError("the table has no rows")
        return self.rows.sparkSession.read.schema(self.rows.schema).parquet(path)

    def steps(self) -> list[dict]:
        """What step_counts gives, of the action that has ended."""
        n = [self._steps.get[f"n{k}"] for k in range(len(self.names) + 1)]
        return [{"step": name, "step_order": k, "rows_before": n[k - 1], "rows_after": n[k], "rows_removed": n[k - 1] - n[k]} for k, name in enumerate(self.names, 1)]

    def nulls(self) -> dict[str, int]:
        """Nulls of each audited column among the rows that are kept."""
        return {c: self._nulls.get[f"null_{k}"] for k, c in enumerate(self.audited)}


def null_audit(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name and null_count, 0 for an empty table."""
    names = columns or df.columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in names])).alias("r")).select("r.*")


def quality_checks(df: DataFrame, years: list[int], seconds=(60, 10800), max_miles: float = 100) -> DataFrame:
    """One row of counts of standardised trips that break a rule; one pass."""
    c, n = F.col, lambda cond: F.coalesce(F.count_if(cond), F.lit(0))
    return df.agg(
        F.count("*").alias("row_count"),
        n(c("pickup_datetime").isNull()).alias("null_pickup"),
        n(c("dropoff_datetime").isNull()).alias("null_dropoff"),
        n(c("PULocationID").isNull()).alias("null_pu"),
        n(c("DOLocationID").isNull()).alias("null_do"),
        n(c("dropoff_datetime") <= c("pickup_datetime")).alias("bad_order"),
        n(c("trip_duration_seconds") < seconds[0]).alias("too_short"),
        n(c("trip_duration_seconds") > seconds[1]).alias("too_long"),
        n(c("trip_miles") <= 0).alias("no_distance"),
        n(c("trip_miles") > max_miles).alias("too_far"),
        n(~c("pickup_year").isin(years)).alias("bad_year"),
    )


def validate(df: DataFrame, columns: list[str], years: list[int]) -> DataFrame:
    """quality_checks; raises on missing columns, checked first, and on an empty table."""
    from tidecube.operators.schema import require

    out = quality_checks(require(df, columns), years)
    if out.first()["row_count"] == 0:
        raise ValueError("the table has no rows")
    return out


def rows_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).orderBy(*keys)
