"""Session settings and durable lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "palimpsest", master: str | None = None, shuffle_partitions: int | None = None, checkpoints: str | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; sizes are left to the cluster unless given.  ``checkpoints`` names a folder that all executors share."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if checkpoints:
        builder = builder.config("spark.checkpoint.dir", checkpoints)
    return builder.getOrCreate()


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through the folder that the cluster names in spark.checkpoint.dir.

    On a cluster that names none this is an error: a machine's own folder would be
    lost with the machine.  Within one local JVM a folder beside the warehouse serves.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="palimpsest-checkpoint-")
        context.setCheckpointDir(named)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, for files that a query writes and reads again."""
    durable(spark.range(1))
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/files-{uuid.uuid4().hex}"


def tuned(spark: SparkSession) -> SparkSession:
    """Set the runtime options that the wide text expressions need, unless the user chose others.

    The JVM never compiles methods over 8000 bytes of bytecode, so generated code
    beyond that is better split per projection.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="palimpsest-code-")) / "palimpsest.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark
