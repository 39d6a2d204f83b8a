"""Session settings the library relies on.

On a cluster the session comes from the platform; ``configure`` only fills in
settings that are unset. ``local_session`` is for tests and the bench.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that make results independent of the machine: ANSI errors, UTC, AQE
# with skew-join splitting (a hot key may hold a third of the rows).
DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply library defaults where the session leaves them unset."""
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session (tests, the bench) without the setting gets a scratch
    folder; on a cluster the setting is required, never a machine-local folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not is_local(spark):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, ANSI, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "16g"))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession | None = None) -> None:
    """Make this package importable by Python workers (once per Spark application).

    Python UDFs pickle their module by reference; executors import it. In a
    local session whose workers cannot import it, a zip is sent with
    ``addPyFile``. On a cluster nothing is written: the package is installed on
    the executors or passed with ``--py-files``.
    """
    import pathlib
    import zipfile

    spark = spark or SparkSession.getActiveSession()
    if spark is None or not is_local(spark):
        # On a cluster the package is installed on the executors or passed with --py-files.
        return
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="tidemark-py-")) / "tidemark.zip"
    with zipfile.ZipFile(target, "w") as zf:
        for path in root.rglob("*.py"):
            zf.write(path, pathlib.Path("tidemark") / path.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
