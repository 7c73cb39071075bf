"""Session helpers.

Library functions never create a session; they take one (or a DataFrame) from the
caller. These helpers are for tests, the bench and local runs.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "pursewise", extra_conf: dict | None = None) -> SparkSession:
    master = master or os.environ.get("PURSEWISE_MASTER", "local[*]")
    builder = SparkSession.builder
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PURSEWISE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset the folder is made under the session's warehouse
    (``spark.sql.warehouse.dir``), which all executors share as well; no machine-local
    temporary folder is ever used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_pursewise")
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local one on a
    cluster: ``spark.checkpoint.dir`` names the shared place)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/pursewise-io/{what}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per Spark application.

    Python tasks import their helpers from it whatever the executors' working directory is.
    Where the package is installed on the executors this changes nothing.
    """
    sc = spark.sparkContext
    package = Path(__file__).parent
    if getattr(sc, "_pursewise_shipped", False) or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="pursewise-")) / "pursewise.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, Path(package.name) / f.relative_to(package))
    sc.addPyFile(str(archive))
    sc._pursewise_shipped = True
