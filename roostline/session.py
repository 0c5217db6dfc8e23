"""Session defaults and the shared scratch area."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. AQE sizes the shuffle partitions, splits skewed
# join partitions and turns a shuffled join into a broadcast join once a side is
# *measured* to be small. No operator carries a broadcast hint of its own.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Plans here have many columns; recording a call site for each costs more than running small queries.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "roostline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` takes extra ones, dots written as ``__``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Of the running thread: areas that one thread has open are nothing to another.
_areas: contextvars.ContextVar[tuple[str, ...]] = contextvars.ContextVar("areas", default=())


def _root(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; where it names none, a folder in the warehouse.

    Both are shared by all executors; there is no rule of its own for local mode.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession, label: str = "area") -> Iterator[str]:
    """Owns all that is staged inside it, and deletes it at the end: write the result inside.

    Without it, staged tables stay until someone cleans the scratch folder, since a query
    is lazy and reads them later.
    """
    area = scratch_dir(spark, label)
    before = _areas.set((*_areas.get(), area))
    try:
        yield area
    finally:
        _areas.reset(before)
        remove_folder(spark, area)


def scratch_dir(spark: SparkSession, label: str = "scratch") -> str:
    """A fresh folder path in the innermost open area, else in the scratch folder itself."""
    return f"{(_areas.get() or (_root(spark),))[-1]}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "stage", **options: str) -> DataFrame:
    """Write ``df`` once as Parquet in the scratch area and read it back.

    For an aggregate that several branches of a plan consume: the raw table is
    scanned once, a lost executor costs a re-read and not a recompute, and the
    planner knows the exact size of what follows. ``options`` go to the writer.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read._roostline_staged = True
    return read


def once(df: DataFrame, label: str = "stage") -> DataFrame:
    """``df`` as a staged table; itself if it is one already."""
    return df if getattr(df, "_roostline_staged", False) else staged(df, label)
