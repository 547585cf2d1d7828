"""Session helpers.

The library never creates a session on its own inside an operator; callers pass
one in.  ``build_session`` is a convenience for tests, the bench and the CLI.
"""

from __future__ import annotations

import os
import tempfile
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins from measured sizes (this is
# the size check behind every broadcast we do not hint ourselves), splits skewed
# join partitions and coalesces small shuffle partitions.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "acreage", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(SCALE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("ACREAGE_DRIVER_MEMORY", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    On a cluster the folder is the one named by ``spark.checkpoint.dir`` (or
    already set on the SparkContext).  Only when neither is set and the master
    is ``local`` (tests) do we pick a scratch folder of our own; elsewhere a
    missing setting is an error, since other machines could not see the folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d and not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="acreage-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (once for each Spark application), so that Python functions of it run in tasks
    wherever the driver was started and whatever is installed there."""
    import shutil
    app = spark.sparkContext.applicationId
    if app not in SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        to = os.path.join(tempfile.mkdtemp(prefix="acreage-package-"), "acreage-package")      # the driver serves it from here
        spark.sparkContext.addPyFile(shutil.make_archive(to, "zip", os.path.dirname(here), os.path.basename(here)))
        SHIPPED.add(app)


SHIPPED: set[str] = set()


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (survives executor
    loss; never a local checkpoint).  The input is persisted for the duration
    of the checkpoint so it is computed once: an eager checkpoint otherwise
    computes its input a second time when the checkpoint files are written.
    The returned frame reads only the checkpoint files, so the temporary
    cache is released at once."""
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        out = cached.checkpoint(eager=True)
    finally:
        cached.unpersist()
    return out


def store(df, name: str):
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.  Cuts the lineage and survives lost
    executors; ``discard`` deletes it when nothing reads it any more.  Returns (frame, path)."""
    import uuid
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table through the file system of its path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Tables:
    """The stored tables of an iterative job: putting a new one under a name deletes the one before."""

    def __init__(self, spark: SparkSession, job: str) -> None:
        self.spark, self.job, self.paths, self.frames = spark, job, {}, {}

    def put(self, **frames) -> None:
        """Store all frames (they may read the tables of the same names), then delete those they replace."""
        with ThreadPoolExecutor(len(frames)) as pool:          # their jobs do not depend on each other
            new = dict(zip(frames, pool.map(lambda k: store(frames[k], f"{self.job}-{k}"), frames)))
        old = [self.paths[k] for k in new if k in self.paths]
        for k, (df, path) in new.items():
            self.frames[k], self.paths[k] = df, path
        for path in old:
            discard(self.spark, path)

    def __getitem__(self, name: str):
        return self.frames[name]

    def drop(self, *names: str) -> None:
        for k in names or list(self.paths):
            discard(self.spark, self.paths.pop(k))
            del self.frames[k]
