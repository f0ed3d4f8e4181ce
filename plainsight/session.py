"""Session defaults, table access and scratch tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "12g") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once a session, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_plainsight_shipped", False):
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="plainsight-code-")) / "plainsight.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(str(archive))
    sc._plainsight_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Repartition only a scan that is too narrow for the cluster, ahead of CPU-bound work.

    Large inputs have far more splits than cores, so there this is a no-op and costs no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _checkpoint_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local session may do without: its one machine holds every task."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="plainsight-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Folders of this driver's scratch tables that still exist.
_kept: list[Scratch] = []


class Scratch:
    """Written tables that cut lineage, in the shared checkpoint folder.

    A written table survives the loss of any executor, is computed once and is columnar and compressed. A result
    reads them as long as it lives; ``release`` deletes those of all results, and so does the end of the driver.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{_checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
        _kept.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_counting(self, df: DataFrame, name: str, **what: Column) -> tuple[DataFrame, Row]:
        """Save, and the given aggregates of the rows, taken while they are written. A repeated task may count twice."""
        seen = Observation()
        saved = self.save(df.observe(seen, *[c.alias(n) for n, c in what.items()]), name)
        return saved, Row(**seen.get)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        for name in names:
            self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        self._delete(self.root)
        if self in _kept:
            _kept.remove(self)


def release() -> None:
    """Delete the scratch tables of all results so far; none of them can be read afterwards."""
    for scratch in [*_kept]:
        try:
            scratch.close()
        except Exception:  # the session has ended: the folder goes with its owner's clean-up
            _kept.remove(scratch)


atexit.register(release)
