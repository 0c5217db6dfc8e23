"""Published results: a Parquet table each, and one JSON record per publication."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roostline.sources import schemas


# Names that start with an underscore are no data to Spark's readers.
NEW, OLD = "_new", "_old"


class _Files:
    """Where the versions of one published table lie."""

    def __init__(self, spark: SparkSession, folder: str, name: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._folder, self._name = folder, name
        self._store = self._path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def beside(self, kind: str) -> str:
        return f"{self._folder}/{kind}-{self._name}-{uuid.uuid4().hex}"

    def current(self) -> str:
        return f"{self._folder}/{self._name}"

    def exists(self) -> bool:
        return self._store.exists(self._path(self.current()))

    def _left(self, kind: str) -> list[str]:
        """What earlier publications of this name left."""
        if not self._store.exists(self._path(self._folder)):
            return []
        start = f"{kind}-{self._name}-"
        names = [f.getPath().getName() for f in self._store.listStatus(self._path(self._folder))]
        return [f"{self._folder}/{n}" for n in sorted(names) if n.startswith(start) and len(n) == len(start) + 32]

    def set_aside(self) -> str | None:
        """The version that a publication took away before it died, if there is no current one."""
        left = self._left(OLD)
        return left[0] if left and not self.exists() else None

    def _rename(self, old: str, new: str) -> None:
        if not self._store.rename(self._path(old), self._path(new)):
            raise OSError(f"{old} cannot be renamed to {new}")

    def mend(self) -> None:
        """Put back what was taken away, and delete what was not finished."""
        aside = self.set_aside()
        if aside:
            self._rename(aside, self.current())
        for path in [*self._left(NEW), *self._left(OLD)]:
            self._store.delete(self._path(path), True)

    def replace(self, fresh: str) -> None:
        aside = self.beside(OLD)
        if self.exists():
            self._rename(self.current(), aside)
        self._rename(fresh, self.current())
        self._store.delete(self._path(aside), True)


def read_result(spark: SparkSession, folder: str, filename: str) -> DataFrame:
    """The published table of that name, also while a publication of it is broken off."""
    files = _Files(spark, f"{folder}/tables", filename)
    return spark.read.parquet(files.set_aside() or files.current())


def publish(
    result: DataFrame,
    folder: str,
    filename: str,
    title: str,
    description: str = "",
    kind: str = "parquet",
    created: str | None = None,
) -> str:
    """Write ``result`` and append its record to the manifest; returns the table's path.

    The table is written beside the current one and takes its place by rename when it is whole; the record follows. A
    publication that dies before leaves the current table as it is, and one that dies between the two renames
    leaves it under another name, where ``read_result`` and the next publication find it. Publications of one
    name must not run at the same time.
    """
    relative = f"tables/{filename}"
    files = _Files(result.sparkSession, f"{folder}/tables", filename)
    files.mend()
    fresh = files.beside(NEW)
    result.write.parquet(fresh)
    files.replace(fresh)
    stamp = created or datetime.now(timezone.utc).replace(tzinfo=None).isoformat()
    values = [title, description, filename, kind, stamp, relative]
    record = result.sparkSession.createDataFrame([values], schemas.MANIFEST_JSON)
    record.coalesce(1).write.mode("append").json(f"{folder}/manifest")
    return f"{folder}/{relative}"


def manifest_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``file`` and ``record`` (null where it is no record) of each JSON object in the files of a manifest.

    A file may hold one object, also over several lines, an array of them, or one on each line. Files are
    small: one per publication.
    """
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("text"))
    schema = f"STRUCT<{', '.join(f.replace(' ', ': ', 1) for f in schemas.MANIFEST_JSON.split(', '))}>"
    one = F.from_json("text", schema)
    many = F.from_json("text", f"ARRAY<{schema}>")
    lines = F.filter(F.split("text", r"\r?\n"), lambda line: F.trim(line) != "")
    # Text after the first object of a whole file is not seen by the parser, so lines are taken where each is one.
    by_line = F.transform(lines, lambda line: F.from_json(line, schema))
    each_line = (F.size(lines) > 1) & F.forall(lines, lambda line: F.ltrim(line).startswith("{"))
    records = F.when(F.col("text").startswith("["), many).when(each_line, by_line).otherwise(F.array(one))
    return files.select("file", F.explode(F.coalesce(records, F.array(F.lit(None).cast(schema)))).alias("record"))


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """All records of all files; ``broken_records`` counts what is none."""
    return manifest_documents(spark, folder).where(F.col("record.filename").isNotNull()).select("record.*")


def broken_records(spark: SparkSession, folder: str) -> DataFrame:
    """Files with objects that are not readable or have no file name, and how many."""
    return manifest_documents(spark, folder).where(F.col("record.filename").isNull()).groupBy("file").agg(F.count("*").alias("n"))


def latest_records(manifest: DataFrame) -> DataFrame:
    """The newest record of each file name."""
    fields = [c for c in manifest.columns if c != "filename"]
    newest = F.max_by(F.struct(*fields), F.struct("created", "title"))
    return manifest.groupBy("filename").agg(newest.alias("r")).select("filename", "r.*")


def in_publish_order(manifest: DataFrame, order: DataFrame) -> DataFrame:
    """Newest records of the wanted names, numbered and sorted by ``order(filename, position)``."""
    return latest_records(manifest).join(order, "filename").orderBy("position")


def missing_results(manifest: DataFrame, order: DataFrame) -> DataFrame:
    """Wanted names without a record."""
    return order.join(manifest.select("filename"), "filename", "left_anti")
