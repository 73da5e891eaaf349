"""A session from the environment, a configuration and defaults, in this order of precedence."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import SparkSession

#: (Spark's setting, environment variable, name in a configuration's part "spark", default)
SETTINGS = [
    ("spark.master", "SPARK_MASTER_URL", "master", "local[1]"),
    ("spark.driver.memory", "SPARK_DRIVER_MEMORY", "driver_memory", "2500m"),
    ("spark.sql.shuffle.partitions", "SPARK_SHUFFLE_PARTITIONS", "shuffle_partitions", "48"),
    ("spark.default.parallelism", "SPARK_DEFAULT_PARALLELISM", "default_parallelism", "48"),
]
#: Only where executors are processes of their own.
CLUSTER = [
    ("spark.executor.memory", "SPARK_EXECUTOR_MEMORY", "executor_memory", "1500m"),
    ("spark.executor.cores", "SPARK_EXECUTOR_CORES", "executor_cores", "2"),
    ("spark.cores.max", "SPARK_CORES_MAX", "cores_max", "4"),
]
ALWAYS = {"spark.sql.session.timeZone": "UTC", "spark.sql.parquet.mergeSchema": "false", "spark.sql.parquet.compression.codec": "snappy", "spark.sql.adaptive.enabled": "true"}
CLUSTER_ALWAYS = {"spark.network.timeout": "600s", "spark.executor.heartbeatInterval": "60s"}


def options(config: Mapping | None = None, env: Mapping[str, str] | None = None) -> dict[str, str]:
    """Spark's settings: the environment over config["spark"] over the defaults; executors' only for a cluster's master."""
    own, env = (config or {}).get("spark") or {}, os.environ if env is None else env
    chosen = lambda parts: {key: str(env.get(variable) or own.get(name) or default) for key, variable, name, default in parts}
    out = ALWAYS | chosen(SETTINGS)
    if not out["spark.master"].startswith("local"):
        out |= CLUSTER_ALWAYS | chosen(CLUSTER)
    return out


def session(name: str = "tidecube", config: Mapping | None = None, env: Mapping[str, str] | None = None) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=options(config, env)).getOrCreate()
