"""Explicit schemas of every input; nothing is inferred."""

from __future__ import annotations

# Consolidated visit sheet. Counts are read as DOUBLE because a sheet with an empty
# cell writes its whole column as "3.0"; the reader casts them back to BIGINT.
VISITS_CSV = {
    "Date": "STRING", "Bird": "STRING", "Time": "STRING", "LeftPecks": "DOUBLE", "RightPecks": "DOUBLE",
    "LeftSeed": "DOUBLE", "RightSeed": "DOUBLE", "source_sheet": "STRING", "Notes": "STRING", "CoolDown": "STRING",
}
VISITS_COLUMNS = list(VISITS_CSV)
VISIT_COUNTS = ["LeftPecks", "RightPecks", "LeftSeed", "RightSeed"]

DAILY_CSV = {"Date": "STRING", "source_sheet": "STRING", "Bird": "STRING", "Feeder Visits": "DOUBLE"}
DAILY_COLUMNS = list(DAILY_CSV)

PHASES_CSV = {"LocationOfChange": "STRING", "DateChangeStarted": "STRING", "DescriptionOfChange": "STRING"}

MIGRATION_COLUMNS = ["migration_start_utc", "region_name", "total_birds"]

STATION_DAILY_JSON = (
    "dailyDetectionCounts ARRAY<STRUCT<date: STRING, total: BIGINT, "
    "counts: ARRAY<STRUCT<key: STRING, count: BIGINT>>>>"
)

# Species entries are maps, so that an absent key can be told from a null value.
DEVICE_DAILY_JSON = "date STRING, serial_code STRING, species ARRAY<MAP<STRING, STRING>>"

STATION_NODE = (
    "id STRING, name STRING, country STRING, state STRING, "
    "coords STRUCT<lat: DOUBLE, lon: DOUBLE>, type STRING, timezone STRING, "
    "locationPrivacy STRING"
)
DETECTION_NODE = (
    "id STRING, timestamp STRING, certainty STRING, confidence DOUBLE, "
    "probability DOUBLE, score DOUBLE, coords STRUCT<lat: DOUBLE, lon: DOUBLE>, "
    "species STRUCT<id: STRING, commonName: STRING, scientificName: STRING, "
    "ebirdCode: STRING>, station STRUCT<id: STRING, name: STRING>, "
    "soundscape STRUCT<id: STRING, url: STRING, startTime: STRING, endTime: STRING>"
)

MANIFEST_JSON = (
    "title STRING, description STRING, filename STRING, type STRING, "
    "created STRING, image_path STRING"
)


def page_schema(collection: str, node: str) -> str:
    """Schema of a landed result page whose rows are under ``data.<collection>.nodes``."""
    as_struct = ", ".join(_as_field(f) for f in _split_fields(node))
    return f"data STRUCT<{collection}: STRUCT<nodes: ARRAY<STRUCT<{as_struct}>>>>"


def _split_fields(ddl: str) -> list[str]:
    fields, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            fields.append(ddl[start:i].strip())
            start = i + 1
    return [*fields, ddl[start:].strip()]


def _as_field(field: str) -> str:
    name, kind = field.split(" ", 1)
    return f"{name}: {kind}"
