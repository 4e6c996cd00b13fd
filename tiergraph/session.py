"""A session with the settings that the plans count on; on a cluster, its own settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | None = None, name: str = "tiergraph", **conf: str) -> SparkSession:
    n = cores or int(os.environ.get("BENCH_CPUS") or 0) or os.cpu_count() or 4
    b = SparkSession.builder.appName(name)
    if not os.environ.get("SPARK_MASTER") and not os.environ.get("MASTER"):
        b = b.master(f"local[{n}]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", str(n)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
