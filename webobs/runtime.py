"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "webobs", master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    b = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's own setting, or a temporary one where it is unset (tests)."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if at:
        return at
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="webobs-ckpt-")
    sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the shared folder, so a lost executor loses nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def width(df: DataFrame | SparkSession, part: int = 128 << 20) -> int:
    """Partitions of a shuffle that is planned by hand (range partitioning): the session's number, or more for large data.

    The optimizer's estimate of the size decides; a partition gets about `part` bytes. For a session it is the session's number.
    """
    if isinstance(df, SparkSession):
        return int(df.conf.get("spark.sql.shuffle.partitions"))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # no estimate, as on a remote session
        return least
    return max(least, min(-(-size // part), 100_000)) if size < 1 << 60 else least  # joins without statistics multiply up to absurd sizes


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application, wherever they run."""
    import pathlib
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_webobs_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    path = pathlib.Path(tempfile.mkdtemp(prefix="webobs-ship-")) / "webobs_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._webobs_shipped = True


def stage(df: DataFrame) -> DataFrame:
    """As cut, but as compressed columns: for wide intermediate tables that are read more than once."""
    import uuid

    at = f"{checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(at)
    sc = df.sparkSession.sparkContext
    if not hasattr(sc, "_webobs_stages"):  # what isn't dropped before is deleted when the application ends
        atexit.register(_quietly, df.sparkSession)
    sc._webobs_stages = [*getattr(sc, "_webobs_stages", []), at]
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _quietly(spark: SparkSession) -> None:
    try:
        drop_stages(spark)
    except Exception:  # the session has ended before
        pass


def drop_stages(spark: SparkSession) -> int:
    """Delete the staged tables of this application, once no result that reads them is needed; gives their number."""
    sc = spark.sparkContext
    done = getattr(sc, "_webobs_stages", [])
    for at in done:
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    sc._webobs_stages = []
    return len(done)
