"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "repo_signals", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and skew-join handling on; ANSI stays at its default."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Hash instead of sort where AQE has seen that every build partition is small.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """All timestamp arithmetic of this package assumes a UTC session."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a temporary folder, because there every task sees it.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="repo_signals-"))
    return sc.getCheckpointDir().rstrip("/")


SENDING = threading.Lock()


def send_package(spark: SparkSession) -> None:
    """Let Python tasks import the package: it goes out as a zip file through Spark, once per application."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    with SENDING:
        if getattr(context, "_repo_signals_sent", False):
            return
        archive = Path(tempfile.mkdtemp()) / "repo_signals_package.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for module in sorted(root.rglob("*.py")):
                out.write(module, module.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._repo_signals_sent = True


def run_folder(spark: SparkSession) -> str:
    """The scratch folder of this application."""
    return f"{scratch_dir(spark)}/repo_signals/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the scratch folder, so that runs never overwrite each other."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application left in the scratch folder; call it once its results are written."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Compute a frame once, as a table in the shared scratch folder, and read it back.

    For small summaries that several later steps need: they no longer recompute
    the input, the planner knows the size, and a lost executor costs nothing.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
