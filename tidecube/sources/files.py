"""Reading and writing: months of files, inventories, resumable steps, sinks."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecube.operators import schema

log = logging.getLogger(__name__)


def fresh(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: it names the folder that the driver and all executors share")
        root = "/tmp/checkpoints/tidecube"
    return f"{root.rstrip('/')}/io-{uuid.uuid4().hex}"


def kept(df: DataFrame, path: str) -> DataFrame:
    """df as Parquet at a new path, read again: what several parts of a plan read is made once, and outlives executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_schemas(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Paths of Parquet files or folders by schema (as JSON). Footers are read by tasks and told apart there; the driver opens one
    file of each kind. What tasks cannot open by themselves, as on a file system that only Spark knows, the driver opens."""

    def footer(path: str) -> str | None:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        try:
            store, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        except (pa.ArrowInvalid, OSError):
            return None
        if store.get_file_info(at).type == fs.FileType.Directory:
            below = [f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
            if not below:
                return None
            at = min(below)
        with store.open_input_file(at) as f:
            kind = pq.read_schema(f)
        own = (kind.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
        return own.decode() if own else kind.remove_metadata().to_string()

    def footers(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pylist([{"path": p, "kind": footer(p) or f"path {p}"} for p in b.column("path").to_pylist()])

    tasks = max(min(len(paths), 2 * spark.sparkContext.defaultParallelism), 1)
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks).mapInArrow(footers, "path string, kind string")
    kinds = rows.groupBy("kind").agg(F.collect_list("path").alias("paths")).collect()
    found: dict[str, list[str]] = {}
    for r in kinds:
        found.setdefault(spark.read.option("mergeSchema", "false").parquet(r["paths"][0]).schema.json(), []).extend(r["paths"])
    return found


def read_months(spark: SparkSession, paths: list[str], types: str) -> DataFrame:
    """Files whose types drift: those of one schema are one scan, and each scan is brought to the schema before they are put
    together. So the plan grows with the number of schemas, not with the number of months."""
    if not paths:
        raise FileNotFoundError("no input files")
    scans = [spark.read.schema(T.StructType.fromJson(json.loads(s))).parquet(*sorted(group)) for s, group in sorted(file_schemas(spark, paths).items())]
    return reduce(DataFrame.unionByName, [schema.enforce(df, types) for df in scans])


def combined_sources(spark: SparkSession, paths: dict[str, str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Those of the named Parquet sources that are there, each prepared and put together. A missing one is warned of; an
    error if there is none."""
    found = []
    for name, path in paths.items():
        if exists(spark, path):
            found.append(prepare(spark.read.parquet(path)))
        else:
            log.warning("%s is missing: %s", name, path)
    if not found:
        raise FileNotFoundError(f"none of the sources is there: {', '.join(paths)}")
    return reduce(DataFrame.unionByName, found)


def read_table(spark: SparkSession, path: str, name: str, kind: str = "parquet") -> DataFrame:
    """The table at path; where there is none, the catalog's table of that name. Files that are there but cannot be read are an
    error: another table's rows do not take their place."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        log.warning("%s is not there, taking table %s", path, name)
        return spark.table(name)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, modified, is_parquet and is_metadata of all files below a folder, by Spark's own file listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumns({"is_parquet": name.endswith(".parquet"), "is_metadata": name.startswith("_") | name.startswith(".") | name.endswith(".json")}).orderBy("path")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path or a glob, on any file system that Spark reads; what is below is not listed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return bool(found)


def copy_files(spark: SparkSession, pairs: list[tuple[str, str]], overwrite: bool = False) -> list[dict]:
    """Copies files, (source, target) each, by tasks; returns source, target, action and size of each.

    A target with content is skipped unless overwrite; an empty one, left by a broken copy, is replaced. A file is copied
    to a name of its own and renamed when it is whole. A missing source is an error.
    """

    def open_fs(path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")

    def copy(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                (store, at), (to, target) = open_fs(r["source"]), open_fs(r["target"])
                size, there = store.get_file_info(at).size, to.get_file_info(target)
                if size is None:
                    raise FileNotFoundError(r["source"])
                action = "copied" if there.type == fs.FileType.NotFound else "replaced" if overwrite or not there.size else "skipped"
                if action != "skipped":
                    part = f"{target}.{uuid.uuid4().hex}.part"
                    to.create_dir(target.rpartition("/")[0], recursive=True)
                    with store.open_input_stream(at) as a, to.open_output_stream(part) as b:
                        while block := a.read(8 << 20):
                            b.write(block)
                    if there.type != fs.FileType.NotFound:
                        to.delete_file(target)
                    to.move(part, target)
                done.append(r | {"action": action, "size": size})
            if done:
                yield pa.RecordBatch.from_pylist(done)

    if not pairs:
        return []
    rows = spark.createDataFrame(pairs, "source string, target string").repartition(min(len(pairs), spark.sparkContext.defaultParallelism))
    return [r.asDict() for r in rows.mapInArrow(copy, "source string, target string, action string, size long").collect()]


def qualified(path: str, uri: str) -> str:
    return path if "://" in path else uri.rstrip("/") + "/" + path.lstrip("/")


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """month_start of every month from first to last, both yyyy-MM."""
    ends = spark.sql("select explode(sequence(to_date(:a), to_date(:b), interval 1 month)) as month_start", args={"a": f"{first}-01", "b": f"{last}-01"})
    return ends.withColumns({"pickup_year": F.year("month_start"), "pickup_month": F.month("month_start")})


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """A zone file with a header; names found whatever their case; "N/A" stays a text."""
    raw = spark.read.option("header", "true").csv(path)
    out = schema.enforce(raw, "LocationID long, Borough string, Zone string, service_zone string").toDF("location_id", "borough", "zone", "service_zone")
    return out.withColumn("service_zone", F.coalesce("service_zone", "zone"))


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet by partition; rows of one partition meet first, so that each has few files, and only partitions that df has are
    replaced. Spark splits what a hot partition gathers by size (rebalance), so no task writes all of it."""
    df.hint("rebalance", *[F.col(k) for k in keys]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_once(df: DataFrame, path: str) -> DataFrame:
    """df at path; if there is a finished output with the same columns in the same order, it is taken as it is."""
    spark = df.sparkSession
    if exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        there = spark.read.parquet(path)
        if schema.same_columns(there, df.columns):
            return there
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def medallion(spark: SparkSession, raw: DataFrame, folder: str, to_silver, to_gold) -> DataFrame:
    """Bronze, silver and gold copies below a folder, each step skipped if its output is there."""
    bronze = write_once(raw, f"{folder}/bronze")
    silver = write_once(to_silver(bronze), f"{folder}/silver")
    return write_once(to_gold(silver), f"{folder}/gold")


def medallion_months(spark: SparkSession, months: list[str], read_month: Callable[[str], DataFrame], folder: str, to_silver, to_gold) -> DataFrame:
    """Gold rows of all months. Each month has its own bronze, silver and gold outputs, and what is finished is not made
    again: a run that broke off goes on at the layer and month where it was. Months that cannot be had are an error when
    they are read, not skipped."""
    if not months:
        raise ValueError("no months")
    gold = []
    for m in months:
        bronze = write_once(read_month(m), f"{folder}/bronze/{m}")
        silver = write_once(to_silver(bronze), f"{folder}/silver/{m}")
        gold.append(write_once(to_gold(silver), f"{folder}/gold/{m}"))
    return spark.read.schema(gold[0].schema).parquet(*[f"{folder}/gold/{m}" for m in months])


def rows_frame(spark: SparkSession, rows: list[dict], fields: list[str]) -> DataFrame:
    """A few rows as texts, with these columns in this order: what a row lacks is null, what else it has is left out."""
    text = lambda v: None if v is None else str(v)
    return spark.createDataFrame([[text(r.get(f)) for f in fields] for r in rows], T.StructType([T.StructField(f, T.StringType()) for f in fields]))


def write_single_csv(df: DataFrame, path: str) -> None:
    """For small results that one file should hold."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_jdbc(df: DataFrame, url: str, name: str, **options: str) -> None:
    """Replaces the rows of a table and keeps its definition and indexes; a table that is not there is made.

    Rows go to a stage, a table of this batch alone, by many tasks. When all are there, one transaction empties the table and
    fills it from the stage. So a load that fails on the way leaves the old rows, and readers never see a part of the new.
    """
    jvm = df.sparkSession._jvm
    stage = f"{name}_stage_{uuid.uuid4().hex[:12]}"
    writer = lambda rows, to, mode: rows.write.format("jdbc").options(url=url, dbtable=to, **options).mode(mode).save()
    writer(df.limit(0), name, "append")
    if "driver" in options:
        jvm.java.lang.Class.forName(options["driver"], True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    login = jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in options:
            login.setProperty(k, options[k])
    try:
        writer(df, stage, "overwrite")
        connection = jvm.java.sql.DriverManager.getConnection(url, login)
        try:
            connection.setAutoCommit(False)
            quote = connection.getMetaData().getIdentifierQuoteString().strip()
            columns = ", ".join(f"{quote}{c}{quote}" for c in df.columns)
            statement = connection.createStatement()
            statement.executeUpdate(f"DELETE FROM {name}")
            statement.executeUpdate(f"INSERT INTO {name} ({columns}) SELECT {columns} FROM {stage}")
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()
    finally:
        drop_jdbc(jvm, url, stage, login)


def drop_jdbc(jvm, url: str, name: str, login) -> None:
    """Drops a stage, where it was made."""
    connection = jvm.java.sql.DriverManager.getConnection(url, login)
    try:
        connection.createStatement().executeUpdate(f"DROP TABLE {name}")
    except Py4JJavaError as e:
        log.warning("stage %s is not dropped: %s", name, str(e.java_exception.getMessage()))
    finally:
        connection.close()


def publish(df: DataFrame, name: str, partition: str | None = None, order: list[str] | None = None) -> None:
    """Creates or replaces a catalog table. partition and order lay it out by the columns that readers filter by: a folder
    for each value, and files sorted so that row groups have narrow ranges, which is what Spark has for indexes."""
    if partition:
        df = df.hint("rebalance", F.col(partition))
    if order:
        df = df.sortWithinPartitions(*([partition] if partition else []), *order)
    writer = df.write.mode("overwrite").format("parquet")
    (writer.partitionBy(partition) if partition else writer).saveAsTable(name)


def cleaning_report(steps: DataFrame) -> str:
    """Markdown of step_counts; a share of nothing is 0 %."""
    rows = steps.orderBy("step_order").collect()
    pct = lambda part, whole: f"{100 * part / whole:.2f} %" if whole else "0.00 %"
    lines = ["| step | before | after | removed | % |", "|---|---|---|---|---|"]
    lines += [f"| {r['step']} | {r['rows_before']:,} | {r['rows_after']:,} | {r['rows_removed']:,} | {pct(r['rows_removed'], r['rows_before'])} |" for r in rows]
    if rows:
        a, b = rows[0]["rows_before"], rows[-1]["rows_after"]
        lines.append(f"| all | {a:,} | {b:,} | {a - b:,} | {pct(a - b, a)} |")
    return "\n".join(lines)


def analysis_report(table: str, files: DataFrame, columns: DataFrame, summary: DataFrame, outputs: list[str]) -> str:
    """Markdown of a table's files (an inventory), columns (schema.described), sources (analytics.source_summary) and outputs."""
    size = files.agg(F.count("*").alias("n"), F.count_if("is_parquet").alias("data"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    lines = [f"# {table}", "", "## Files", "", f"* files: {size['n']:,}", f"* data files: {size['data']:,}", f"* bytes: {size['bytes']:,}", "", "## Columns", "", "| column | type |", "|---|---|"]
    lines += [f"| {r['column_name']} | {r['data_type']} |" for r in columns.collect()]
    lines += ["", "## Sources", "", "| source | rows | trips | trips a row | zones |", "|---:|---:|---:|---:|---:|"]
    lines += [f"| {r['source_id']} | {r['row_count']:,} | {r['trips'] or 0:,} | {(r['trips'] or 0) / r['row_count']:.2f} | {r['zones']:,} |" for r in summary.orderBy("source_id").collect()]
    return "\n".join([*lines, "", "## Outputs", "", *[f"* {x}" for x in outputs]]) + "\n"
