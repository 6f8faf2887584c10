"""Session defaults used by the tests, the bench and local work.

On a cluster the session is the caller's; nothing in the package changes its settings.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "rollcall", **conf: object) -> SparkSession:
    """A local session with the settings the package is tuned for."""
    # Tasks share the cores already; threads of their own inside numpy only wait for each other.
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        # Split a hot join partition even where the next step then has to shuffle again.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        # Recording the Python call site of every column costs more than planning the query.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {key: str(value) for key, value in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
