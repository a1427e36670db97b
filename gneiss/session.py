"""Session helpers: configuration, shared folders, lineage cuts and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "gneiss", **conf: str) -> SparkSession:
    """A session with the settings that the operators expect; further settings by keyword (dots as ``__``)."""
    b = SparkSession.builder.master(master).appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local master gets a new local folder; any other raises."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = Path(tempfile.mkdtemp(prefix="gneiss-")).as_uri()
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return (root or str(sc._jsc.sc().getCheckpointDir().get())).rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path, used by nobody else, for files that executors write and others read."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a reliable checkpoint: computed once, safe against the loss of any executor."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table written to the shared folder and read again. Unlike a checkpoint it keeps none of the plan's constraints, which would grow with every round of a loop."""
    path = shared_folder(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch to a Python worker, at most, where the session has Spark's defaults: two workers share an executor's spare memory.
ARROW_ROWS, ARROW_BYTES = 4000, 16 << 20


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once a context, so that their Python workers can import it; and bound Arrow batches."""
    for key, default, value in (("maxRecordsPerBatch", "10000", ARROW_ROWS), ("maxBytesPerBatch", "67108864b", ARROW_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))
    sc = spark.sparkContext
    if getattr(sc, "_gneiss_shipped", False):
        return
    package = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(prefix="gneiss-src-"), "gneiss_src.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(to)
    sc._gneiss_shipped = True
