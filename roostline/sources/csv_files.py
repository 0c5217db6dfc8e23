"""CSV files as spreadsheet and data-frame tools write them: columns by name, doubled quotes, cells with line breaks."""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roostline.session import staged

# The functions below travel to the executors themselves, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# For readers and writers: a quote within a cell is written twice.
DIALECT = {"header": "true", "quote": '"', "escape": '"'}
HEAD_BYTES = 1 << 16
HEADS_AT_ONCE = 16


def literal(path: str) -> str:
    """File names may hold characters that a path pattern would interpret."""
    return re.sub(r"([\[\]{}*?])", r"\\\1", path)


def numbered(header: list[str]) -> list[str]:
    """Repeated column names get ``.1``, ``.2``, ... in order of appearance."""
    seen: dict[str, int] = {}
    names = []
    for name in header:
        again = seen.get(name, 0)
        names.append(f"{name}.{again}" if again else name)
        seen[name] = again + 1
    return names


def _first_line(spark: SparkSession, path: str) -> str:
    """The first line of a file in whatever store; no more than the bytes up to its end, in steps of 64 KB, are asked for."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    stream = where.getFileSystem(conf).open(where)
    codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
    stream = codec.createInputStream(stream) if codec else stream
    try:
        found = b""
        while b"\n" not in found:
            more = bytes(stream.readNBytes(HEAD_BYTES))
            if not more:
                break
            found += more
    finally:
        stream.close()
    return found.partition(b"\n")[0].rstrip(b"\r").decode("utf-8-sig")


@dataclass(frozen=True)
class Layout:
    """Files that share a header, and the size of the largest of them in bytes."""

    header: tuple[str, ...]
    files: list[str]
    largest: int


def layouts(spark: SparkSession, paths: list[str]) -> list[Layout]:
    """The distinct headers of all files below ``paths``; each file may have its own.

    One job lists the files and opens none; then the head of each is read, several at a time, so the
    work grows with the files and not with their sizes. The driver
    gets one entry per file, as it does for any listing. A header itself has no line break. Empty files count for nothing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([literal(p) for p in paths])
    sizes = {r.path: r["length"] for r in files.where("length > 0").select("path", "length").collect()}
    with ThreadPoolExecutor(HEADS_AT_ONCE) as pool:
        heads = zip(sizes, pool.map(lambda path: _first_line(spark, path), sizes))
        found: dict[tuple[str, ...], list[str]] = {}
        for path, line in heads:
            found.setdefault(tuple(numbered(next(csv.reader([line]), []))), []).append(path)
    return [Layout(h, sorted(paths), max(sizes[p] for p in paths)) for h, paths in sorted(found.items())]


WHOLE, TAIL, ALL, HEAD = range(4)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, block, inside, line) of splits, in order -> records (file, block, part, text), without headers.

    ``inside`` tells whether a split begins within quotes. A record that goes over the edge of a split comes in parts:
    ``TAIL`` where it begins, ``ALL`` for a split that lies within it, ``HEAD`` where it ends.
    """
    split, held, quoted, part, header = None, [], False, WHOLE, False
    out: list[tuple] = []

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 4
        out.clear()
        types = (pa.string(), pa.int64(), pa.int8(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "block", "part", "text"])

    def close() -> None:
        if held:
            out.append((*split, ALL if part == HEAD else TAIL, "\n".join(held)))

    for batch in batches:
        odd = pc.bit_wise_and(pc.count_substring(batch.column(3), '"'), 1).to_pylist()
        for file, block, inside, line, flips in zip(*(c.to_pylist() for c in batch.columns), odd):
            if (file, block) != split:
                close()
                split, held, quoted, part, header = (file, block), [], inside, HEAD if inside else WHOLE, block == 0
            held.append(line)
            quoted ^= bool(flips)
            if not quoted:
                if not header:
                    out.append((*split, part, "\n".join(held)))
                held, part, header = [], WHOLE, False
        yield batch_of()
    close()
    yield batch_of()


def records(spark: SparkSession, files: list[str]) -> DataFrame:
    """``file`` and ``text`` of every record of CSV files whose cells may hold line breaks; large files are read by many tasks.

    Whether a split begins within quotes follows from the parity of all quotes before it: the quotes of each split
    are counted, summed up along its file, and the splits read once more with that. Only records that go over the
    edge of a split are put together from parts. Headers and empty lines are left out. Cells with quotes or line
    breaks have to be quoted as a whole, quotes in them doubled, and lines end with a line feed (and a carriage return before it).
    """
    lines = spark.read.option("lineSep", "\n").text([literal(f) for f in files])
    file, block = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    marks = (F.length("value") - F.length(F.replace("value", F.lit('"')))).cast("bigint")
    counted = staged(lines.select(file, block, marks.alias("marks")).groupBy("file", "block").agg(F.sum("marks").alias("marks")), "quotes")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = counted.select("file", "block", (F.coalesce(F.sum("marks").over(before), F.lit(0)) % 2 == 1).alias("inside")).where("inside")
    # Only splits that begin within a cell are listed, a row each; the join keeps the lines in their order.
    odd = F.broadcast(staged(odd, "quotes"))
    given = lines.select(file, block, "value").join(odd, ["file", "block"], "left")
    given = given.select("file", "block", F.coalesce("inside", F.lit(False)).alias("inside"), "value")
    cut = given.mapInArrow(_records, "file STRING, block BIGINT, part TINYINT, text STRING")
    cut = staged(cut, "records")
    # A record in parts begins with a TAIL; the ALLs and the HEAD that follow are its own. There are at most two parts a split.
    along = Window.partitionBy("file").orderBy("block", F.col("part") != HEAD)
    edges = cut.where(F.col("part") != WHOLE).withColumn("number", F.sum((F.col("part") == TAIL).cast("int")).over(along))
    together = edges.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    joined = together.select("file", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    both = cut.where(F.col("part") == WHOLE).select("file", "text").unionByName(joined)
    return both.select("file", F.regexp_replace("text", "\r$", "").alias("text")).where(F.trim("text") != "")


def read_files(spark: SparkSession, layout: Layout, types: dict[str, str], multi_line: bool, file: str | None = None) -> DataFrame:
    """Files of one header. Columns are text but for those in ``types``; a cell that does not fit fails the job.

    ``file`` adds a column of that name with the path of each row's file, encoded as Spark's metadata column shows it. With ``multi_line``, files that are larger than
    one split are cut into records first, since the reader would give each to one task.
    """
    schema = ", ".join(f"`{c.replace('`', '``')}` {types.get(c, 'STRING')}" for c in layout.header)
    rules = DIALECT | {"mode": "FAILFAST"}
    if multi_line and layout.largest > _split_size(spark):
        cut = records(spark, layout.files)
        parsed = cut.select(F.from_csv("text", schema, rules | {"header": "false"}).alias("row"), "file")
        return parsed.select("row.*", *([F.col("file").alias(file)] if file else []))
    found = spark.read.schema(schema).options(**rules).option("multiLine", multi_line).csv([literal(f) for f in layout.files])
    return found.withColumn(file, F.col("_metadata.file_path")) if file else found


def _split_size(spark: SparkSession) -> int:
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def read_csv(spark: SparkSession, path: str, columns: dict[str, str], multi_line: bool = True) -> DataFrame:
    """``columns`` (name -> type) of the CSV file or folder, by name, in the given order. Others are not read.

    A file without one of them is an error. With ``multi_line`` cells may hold line breaks; a large file is then read
    twice, by many tasks. Turn it off for files without such cells.
    """
    found = layouts(spark, [path])
    if not found:
        return spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in columns.items()))
    parts = []
    for layout in found:
        missing = [c for c in columns if c not in layout.header]
        if missing:
            raise ValueError(f"{layout.files[0]}: no column {', '.join(missing)}; it has {', '.join(layout.header)}")
        parts.append(read_files(spark, layout, columns, multi_line).select(*[F.col(f"`{c}`") for c in columns]))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table

