"""The panel as a table: built once per application, bucketed by instrument.

Every window family partitions by instrument. Writing the panel bucketed and
sorted by (instrument, date) means those windows read it without a shuffle. The
table lives in the folder the cluster names in ``spark.checkpoint.dir``, so it
survives the loss of executors; it also cuts the lineage of all later queries.
"""

import hashlib
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from .bars import add_signal, bars, instruments

_SCRATCH = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession):
    """Configured checkpoint folder; a temporary one only in local mode."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="panelspark-")
        sc.setCheckpointDir(path)
        return path
    return None


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read again: cuts a loop's lineage.

    A frame that is read from files is planned with the files' size. ``DataFrame.checkpoint``
    keeps the estimate of the plan it cuts, which every join multiplies, so that a loop's
    estimates double their digits each round and the driver soon only plans.
    """
    spark = df.sparkSession
    root = _SCRATCH.get() or shared_dir(spark)
    if root is None:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    path = f"{root}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)    # texts take two thirds of their size with snappy
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Frames cut inside the block share a folder, which is deleted when the block ends.

    For a block whose last step writes its result: no frame of the block may be read later.
    """
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _SCRATCH.set(path)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def state_of(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the files that bars are built from.

    They name the panel table, so changed files make a new one. One look at each folder
    by Hadoop's file system; the files are not opened.
    """
    jvm, found = spark.sparkContext._jvm, []
    for name in ("lineitem", "supplier", "nation", "region"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found += [f"{x.getPath()}|{x.getLen()}|{x.getModificationTime()}" for x in fs.listStatus(path)]
    return "\n".join(sorted(found))


def build_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_signal(bars(spark, sf_dir))


def bucket_count(spark: SparkSession, sf_dir: str) -> int:
    """No more buckets than instruments: a bucketed scan keeps a task for every bucket.

    Shuffle partitions are set for the ticks. Adaptive execution joins small ones, but not
    the buckets of a table, so each family would run as many, mostly empty, tasks.
    """
    keys = instruments(spark, sf_dir).count()
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), keys))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the signal column ``s``, read from the bucketed table."""
    name = "panelspark_panel_" + hashlib.sha256(
        f"{spark.sparkContext.applicationId}|{state_of(spark, sf_dir)}".encode()).hexdigest()[:16]
    if not spark.catalog.tableExists(name):
        root = shared_dir(spark)
        if root is None:
            return build_panel(spark, sf_dir)
        buckets = bucket_count(spark, sf_dir)
        (build_panel(spark, sf_dir).repartition(buckets, "instrument").write
         .mode("overwrite").option("path", f"{root}/{name}").format("parquet")
         .bucketBy(buckets, "instrument").sortBy("instrument", "date").saveAsTable(name))
    return spark.table(name)
