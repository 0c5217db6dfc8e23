"""A workbook landed as a folder with one CSV per sheet.

A sheet may be a file ``<sheet>.csv``, a Spark output folder ``<sheet>.csv/`` or a
partition folder ``sheet=<sheet>/``.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roostline.sources.csv_files import layouts, read_files


def _entries(spark: SparkSession, folder: str) -> dict[str, str]:
    """Sheet name -> path, from a listing that opens no file.

    The names come to the driver; there is one per sheet, not per file or row.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ).select("path")
    root = re.escape(folder.rstrip("/").split("://")[-1].split("file:")[-1])
    tail = F.regexp_replace("path", f"^.*?{root}/", "")
    top = F.substring_index(tail, "/", 1)
    found = files.select(top.alias("top")).where(~F.col("top").rlike("^[_.]")).distinct()
    out = {}
    for row in found.collect():
        plain = unquote(row.top)
        name = re.sub(r"\.csv$", "", re.sub(r"^sheet=", "", plain))
        out[name] = f"{folder.rstrip('/')}/{plain}"
    return out


def select_sheets(spark: SparkSession, folder: str, word: str) -> dict[str, str]:
    """Sheets whose name contains ``word``, case ignored."""
    found = _entries(spark, folder)
    return {name: found[name] for name in sorted(found) if word.lower() in name.lower()}


def read_layouts(spark: SparkSession, sheets: dict[str, str], multi_line: bool = True) -> list[DataFrame]:
    """One frame per *distinct header*, each over all files that share it, also when files of one sheet differ.

    Headers come from one job, and the plan grows with the number of layouts, not with the number of sheets.
    All cells are strings; ``source_sheet`` names the sheet of each row. Cells may hold line breaks;
    ``multi_line=False`` takes each line for a row and reads large files once instead of twice.
    """
    if not sheets:
        return []
    paths = list(sheets.values())
    frames = []
    for layout in layouts(spark, paths):
        data = read_files(spark, layout, {}, multi_line, file="source_sheet")
        frames.append(data.withColumn("source_sheet", _sheet_of(F.col("source_sheet"), paths)))
    return frames


def _sheet_of(file_path, paths: list[str]):
    """Sheet name from a file path: the first part below the folder, decoded."""
    folder = paths[0].rsplit("/", 1)[0]
    root = re.escape(folder.split("://")[-1].split("file:")[-1])
    top = F.substring_index(F.regexp_replace(file_path, f"^.*?{root}/", ""), "/", 1)
    plain = F.url_decode(F.replace(top, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.regexp_replace(plain, "^sheet=", ""), r"\.csv$", "")
