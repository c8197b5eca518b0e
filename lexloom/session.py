"""Session settings and durable intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Largest number of rows a side may have (after counting it) to be broadcast on purpose.
BROADCAST_ROWS = 100_000

_own: dict[str, str] = {}
#: Folders of intermediate tables that are still there: path -> what deletes it.
_tables: dict[str, Callable[[], object]] = {}


def build_session(app: str = "lexloom", cores: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitter's session is used."""
    n = cores or 8
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a temporary folder only in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="lexloom-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


def release(only: set[str] | None = None) -> None:
    """Delete the intermediate tables (those of the given folders, or all of this process). Results that are still to be
    computed from them can't be any more, so write those first. Runs by itself when the process ends."""
    for path in list(_tables) if only is None else [p for p in _tables if p in only]:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            _tables.pop(path)()


@contextlib.contextmanager
def scratch_scope() -> Iterator[None]:
    """Deletes, at its end, the intermediate tables made inside: for a query whose result is written inside."""
    before = set(_tables)
    try:
        yield
    finally:
        release(set(_tables) - before)


atexit.register(release)


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is run inside go with its end, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Intermediate tables written as Parquet in the shared folder: they cut lineage, survive the loss of
    executors, and give the next plan exact sizes. `release` or `scratch_scope` deletes them."""

    def __init__(self, spark: SparkSession, name: str = "step"):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/lexloom/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}
        root = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        _tables[self.root] = lambda: files.delete(root, True)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        with _shuffles_dropped(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        # The schema is given: no footer has to be read, and an empty result keeps its columns.
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        self._keep = getattr(self, "_keep", [])
        self._keep.append(back)
        return back

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that no later plan reads."""
        path = self.paths.pop(id(df), None) if df is not None else None
        if path:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
