"""Registered queries: each takes a session and a folder of driver tables.

Dates and timestamps leave a query as ISO text and ratios rounded to six places, so
that results compare across engines. Row order is not part of a result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roostline import fixed_values
from roostline.functions import curves, text
from roostline.functions.timebins import TimeBins
from roostline.operators import acoustic, calendar, catalogue, cleaning, diversity, fitting
from roostline.operators import intervals, phases, survival, timegrid
from roostline.operators.geo import within_boxes
from roostline.plans import acoustic_jobs, analyses, consolidate
from roostline.session import scratch_dir, staged
from roostline.sources import manifest, nested, schemas, tables
from roostline.sources.csv_files import DIALECT
from roostline.workload import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

PHASE_PARAMETERS = (0.45, 0.06, 0.55, 0.04)


def portable(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, doubles to six places, integers as BIGINT."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + 0.0
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, folder: portable(fn(spark, folder))
    return fn


# ---------------------------------------------------------------- sources and sinks


def _note(event_id):
    """A cell with commas, quotes and, in one of three, a line break."""
    number = event_id.cast("string")
    lines = F.when(event_id % 3 == 0, F.concat(F.lit('"first" line\nsecond, "'), number, F.lit('"')))
    return F.coalesce(lines, F.concat(F.lit('said ""id, '), number, F.lit('"" twice')))


def _visit_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Visits in the columns of a visit sheet."""
    none = F.lit(None)
    return v.visits(spark, folder).select(
        F.col("date").alias("Date"),
        F.col("bird").alias("Bird"),
        F.date_format("ts", "HH:mm:ss").alias("Time"),
        (F.col("event_id") % 7).alias("LeftPecks"),
        (F.col("event_id") % 5).alias("RightPecks"),
        none.cast("bigint").alias("LeftSeed"),
        none.cast("bigint").alias("RightSeed"),
        F.col("site").alias("source_sheet"),
        _note(F.col("event_id")).alias("Notes"),
        none.cast("string").alias("CoolDown"),
    )


def _land_visits(spark: SparkSession, folder: str) -> str:
    """Visits as CSV in two folders whose files have their columns in different orders."""
    path = scratch_dir(spark, "visits-csv")
    sheet = _visit_sheet(spark, folder)
    even = F.col("LeftPecks") % 2 == 0
    tables.write_csv(sheet.where(even), f"{path}/even")
    tables.write_csv(sheet.where(~even).select(*reversed(sheet.columns)), f"{path}/odd")
    return path


@query
def csv_scan(spark, folder):
    return tables.read_visits(spark, _land_visits(spark, folder)).select(
        "date", "site", "bird", "time", "LeftPecks", "RightPecks", "LeftSeed", "notes", "ts", "minute_of_day"
    )


@query
def daily_csv_scan(spark, folder):
    path = scratch_dir(spark, "daily-csv")
    columns = F.col("date").alias("Date"), F.col("bird").alias("Bird"), F.col("site").alias("source_sheet"), F.col("visits").alias("Feeder Visits")
    tables.write_csv(v.daily(spark, folder).select(*columns), path)
    return tables.read_daily(spark, path)


@query
def phase_csv_scan(spark, folder):
    """The first and last day of each site as changes; a text that is no date gives null."""
    path = scratch_dir(spark, "phases-csv")
    days = v.visits(spark, folder).groupBy("site").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    first = days.select(
        F.concat(F.lit('Began, "'), "site", F.lit('"')).alias("DescriptionOfChange"), F.concat(F.lit(" "), "site").alias("LocationOfChange"),
        F.col("lo").cast("string").alias("DateChangeStarted"),
    )
    last = days.select(
        F.concat(F.lit("Ends\nafter "), F.col("hi").cast("string")).alias("DescriptionOfChange"), F.col("site").alias("LocationOfChange"),
        F.lit("soon").alias("DateChangeStarted"),
    )
    tables.write_csv(first.unionByName(last), path)
    return tables.read_phase_changes(spark, path)


@query
def visit_rejects(spark, folder):
    """Rows per reason whose date or time cannot be read, from sheets with several spellings of both."""
    path = scratch_dir(spark, "visits-csv")
    sheet = _visit_sheet(spark, folder)
    number = F.regexp_extract("Notes", r"(\d+)", 1).cast("bigint")
    clock = F.concat(F.lit("1970-01-01 "), "Time").cast("timestamp_ntz")
    spelled = (
        F.when(number % 7 == 0, "noon").when(number % 7 == 1, "25:10:00").when(number % 7 == 2, F.date_format(clock, "h:mm:ss a"))
        .when(number % 7 == 3, F.date_format(clock, "H:mm")).when(number % 7 == 4, " ").otherwise(F.col("Time"))
    )
    day = F.when(number % 5 == 0, F.date_format("Date", "MM/dd/yyyy")).otherwise(F.col("Date").cast("string"))
    tables.write_csv(sheet.withColumns({"Time": spelled, "Date": day}), path)
    return tables.read_visit_rejects(spark, path).groupBy("reason").agg(F.count("*").alias("n"))


@query
def migration_scan(spark, folder):
    path = scratch_dir(spark, "migration")
    night = F.col("night").cast("timestamp_ntz").alias("migration_start_utc")
    v.migration(spark, folder).select(night, "region_name", "total_birds", F.lit("x").alias("peak")).write.parquet(path)
    return tables.read_migration(spark, path)


def _land_phases(spark: SparkSession, path: str) -> None:
    changes = v.phase_changes(spark).select(
        F.col("site").alias("LocationOfChange"),
        F.col("change_date").alias("DateChangeStarted"),
        F.col("description").alias("DescriptionOfChange"),
    )
    tables.write_csv(changes, f"{path}/PhaseChanges.csv")


def _land_visit_sheets(spark: SparkSession, folder: str) -> str:
    """A workbook folder with a visit sheet per site and the phase changes."""
    path = scratch_dir(spark, "workbook")
    named = F.concat(F.initcap("source_sheet"), F.lit(", FL Raw Data")).alias("sheet")
    columns = [c for c in schemas.VISITS_COLUMNS if c != "source_sheet"]
    # Partition folders ``sheet=<name>`` beside sheet folders ``<name>.csv``.
    sheet = _visit_sheet(spark, folder).select(named, *columns)
    # The files of one sheet differ in the order of their columns.
    even = F.col("LeftPecks") % 2 == 0
    for part in (sheet.where(even), sheet.where(~even).select(*reversed(sheet.columns))):
        part.write.mode("append").partitionBy("sheet").options(**DIALECT).csv(path)
    _land_phases(spark, path)
    return path


def _land_daily_sheets(spark: SparkSession, folder: str) -> str:
    """A workbook folder with a wide daily sheet for one site, long ones for the others, and the phase changes."""
    path = scratch_dir(spark, "workbook")
    daily = staged(v.named_daily(spark, folder), "daily")
    species = v.species_names()
    wide = cleaning.matrix(
        daily.where("site = 'view'").withColumn("Date", F.col("date").cast("string")), ["Date"], "bird", "visits", species
    )
    total = wide.agg(F.lit("Grand Total").alias("Date"), *[F.sum(s).alias(s) for s in species])
    tables.write_csv(wide.unionByName(total), f"{path}/South daily summaries.csv")
    sheet = F.concat(F.initcap("site"), F.lit(", FL Daily Su")).alias("sheet")
    long = daily.where("site <> 'view'").select(
        sheet, F.col("date").alias("Date"), F.col("bird").alias("Bird"), F.col("visits").alias("Feeder Visits")
    )
    long.write.mode("append").partitionBy("sheet").options(**DIALECT).csv(path)
    _land_phases(spark, path)
    return path


@query
def sheet_scan(spark, folder):
    sheets = consolidate.raw_visits(spark, _land_visit_sheets(spark, folder))
    return sheets.select("Date", "Bird", "Time", "LeftPecks", "source_sheet", "Notes")


@query
def consolidated_daily(spark, folder):
    return consolidate.daily_summaries(spark, _land_daily_sheets(spark, folder))


def _land_json(df: DataFrame, label: str) -> str:
    path = scratch_dir(df.sparkSession, label)
    df.write.json(path)
    return path


@query
def station_counts_json(spark, folder):
    counts = v.station_daily(spark, folder)
    entry = F.struct(F.col("species_id").alias("key"), F.col("n").alias("count"))
    days = counts.groupBy("date", "total").agg(F.collect_list(entry).alias("counts"))
    documents = days.groupBy(F.year("date").alias("__y"), F.month("date").alias("__m")).agg(
        F.collect_list(F.struct("date", "total", "counts")).alias("dailyDetectionCounts")
    )
    return nested.read_station_daily(spark, _land_json(documents.drop("__y", "__m"), "stations"))


@query
def device_counts_json(spark, folder):
    counts = v.device_daily(spark, folder)
    name = F.when(F.col("species_name") != "sp03", F.col("species_name")).alias("name")
    n = F.when(F.col("species_name") != "sp04", F.col("n")).alias("count")
    documents = counts.groupBy("date", "serial_code").agg(F.collect_list(F.struct(name, n)).alias("species"))
    # Nulls are not written, which leaves these keys absent.
    return nested.read_device_daily(spark, _land_json(documents, "devices"))


def _detection_pages(spark: SparkSession, folder: str) -> str:
    d = v.detections(spark, folder)
    node = F.struct(
        F.col("id").cast("string").alias("id"),
        F.col("timestamp").cast("string").alias("timestamp"),
        F.struct("lat", "lon").alias("coords"),
        F.when(F.col("species_common") != "error", F.struct(F.col("species_common").alias("commonName"))).alias("species"),
        F.struct(F.col("station_id").alias("id")).alias("station"),
    )
    pages = d.groupBy(F.floor(F.col("id") / 500).alias("page")).agg(F.collect_list(node).alias("nodes"))
    wrapped = pages.select(F.struct(F.struct("nodes").alias("detections")).alias("data"))
    return _land_json(wrapped, "pages")


@query
def paged_documents(spark, folder):
    pages = nested.read_json(
        spark, _detection_pages(spark, folder), schemas.page_schema("detections", schemas.DETECTION_NODE)
    )
    rows = nested.page_rows(pages, "detections")
    return rows.select("id", "timestamp", F.col("station.id").alias("station_id"))


@query
def flatten_detections(spark, folder):
    return nested.read_detections(spark, _detection_pages(spark, folder))


@query
def county_csv_sink(spark, folder):
    path = scratch_dir(spark, "counties")
    located = within_boxes(v.detections(spark, folder), v.boxes(spark))
    tables.write_csv_per_key(located, path, "county")
    schema = "id BIGINT, lat DOUBLE, lon DOUBLE, species_common STRING, station_id STRING, timestamp STRING, county STRING"
    return spark.read.schema(schema).option("header", True).csv(path).select("county", "id", "species_common", "station_id")


@query
def table_sinks(spark, folder):
    path = scratch_dir(spark, "totals")
    totals = diversity.site_totals(v.daily(spark, folder))
    tables.write_csv(totals, f"{path}/csv")
    tables.write_parquet(totals, f"{path}/parquet", ["site"])
    from_csv = spark.read.schema("date DATE, site STRING, visits BIGINT").option("header", True).csv(f"{path}/csv")
    from_parquet = spark.read.parquet(f"{path}/parquet").select("date", "site", "visits")
    kind = F.lit("csv").alias("kind"), F.lit("parquet").alias("kind")
    return from_csv.select(kind[0], "*").unionByName(from_parquet.select(kind[1], "*"))


def _published(spark: SparkSession, folder: str) -> str:
    """Diversity and totals published, the totals twice."""
    path = scratch_dir(spark, "published")
    daily = v.daily(spark, folder)
    totals = diversity.site_totals(daily)
    base = diversity.species_days(daily)
    manifest.publish(totals, path, "heatmap_counts", "Totals", created="2024-02-01T10:00:00")
    manifest.publish(diversity.shannon(base), path, "diversity_metrics", "Shannon", created="2024-02-01T10:05:00")
    again = f"Totals of {totals.count()} site days"
    manifest.publish(totals, path, "heatmap_counts", again, "second", created="2024-02-02T10:00:00")
    return path


@query
def result_manifest(spark, folder):
    path = _published(spark, folder)
    records = manifest.read_manifest(spark, f"{path}/manifest")
    rows = spark.read.parquet(f"{path}/tables/heatmap_counts").agg(F.count("*").alias("table_rows"))
    listed = records.select("filename", "title", "type", "created", "image_path")
    return listed.withColumn("table_rows", rows.scalar())


@query
def publish_order(spark, folder):
    records = manifest.read_manifest(spark, f"{_published(spark, folder)}/manifest")
    order = fixed_values.dimension(spark, fixed_values.PUBLISH_ORDER)
    found = manifest.in_publish_order(records, order).select("position", "filename", "title", F.lit(True).alias("found"))
    missing = manifest.missing_results(records, order).select(
        "position", "filename", F.lit(None).cast("string").alias("title"), F.lit(False).alias("found")
    )
    return found.unionByName(missing)


@query
def device_dimension(spark, folder):
    devices = v.device_daily(spark, folder).groupBy("serial_code").agg(
        F.min("date").cast("string").alias("first_seen"), F.countDistinct("species_name").alias("species")
    )
    # A device that the service does not know answers with an empty document.
    known = F.col("serial_code") != "error"
    documents = devices.select(
        "serial_code",
        F.when(known, F.col("first_seen")).alias("first_seen"),
        F.when(known, F.col("species")).alias("species"),
    )
    path = scratch_dir(spark, "device-info")
    columns = [c for c in documents.columns if c != "serial_code"]
    documents.select("serial_code", F.to_json(F.struct(*columns)).alias("value")).write.partitionBy("serial_code").text(f"{path}/by-serial")
    _name_documents(spark, f"{path}/by-serial", f"{path}/documents")
    return nested.read_devices(spark, f"{path}/documents", "first_seen STRING, species BIGINT")


def _name_documents(spark: SparkSession, landed: str, path: str) -> None:
    """Moves the one file of each ``serial_code=<serial>`` folder to ``<serial>.json``, as the service names its documents."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(hadoop(path))
    for part in store.globStatus(hadoop(f"{landed}/serial_code=*/part-*")):
        serial = part.getPath().getParent().getName().partition("=")[2]
        store.rename(part.getPath(), hadoop(f"{path}/{serial}.json"))


# ------------------------------------------------------------ projection and cleaning


@query
def project_visits(spark, folder):
    return v.visits(spark, folder).select("date", "bird", "ts", "site")


@query
def site_keys(spark, folder):
    sheet = F.concat(F.initcap("site"), F.lit(" City, FL 32259 Raw Data"))
    keyed = v.visits(spark, folder).select(text.site_key_from_sheet(sheet).alias("site_key"))
    return keyed.groupBy("site_key").agg(F.count("*").alias("n"))


@query
def remap_regions(spark, folder):
    return cleaning.remap(v.migration(spark, folder), "region_name", v.region_map(spark))


@query
def drop_null_species(spark, folder):
    return v.visits(spark, folder).na.drop(subset=["bird"]).select("event_id", "bird", "site")


@query
def drop_incomplete(spark, folder):
    return v.daily(spark, folder).na.drop("any")


@query
def drop_subtotals(spark, folder):
    totals = diversity.site_totals(v.daily(spark, folder)).select(
        F.col("date").cast("string").alias("Date"), "site", "visits"
    )
    subtotal = totals.groupBy("site").agg(F.sum("visits").alias("visits")).select(
        F.when(F.col("site") != "view", "Grand Total").alias("Date"), "site", "visits"
    )
    return cleaning.drop_subtotals(totals.unionByName(subtotal))


@query
def lower_bounds(spark, folder):
    nights = cleaning.since(v.migration(spark, folder), "night", "2024-01-10", strict=True)
    days = cleaning.since(v.daily(spark, folder), "date", "2024-01-20")
    return nights.select(F.lit("migration").alias("source"), F.col("night").alias("date"), F.col("total_birds").alias("n")).unionByName(
        days.select(F.lit("daily").alias("source"), "date", F.col("visits").alias("n"))
    )


@query
def excluded_species(spark, folder):
    return cleaning.excluding(v.visits(spark, folder), "bird", ["sp01", "sp02"]).select("event_id", "bird")


@query
def positive_visits(spark, folder):
    return v.daily(spark, folder).where("visits > 0")


@query
def text_dates(spark, folder):
    raw = v.visits(spark, folder).select(
        "event_id",
        F.concat(F.lit("  "), "site", F.lit(" ")).alias("site"),
        F.when(F.col("event_id") % 3 == 0, F.lit("not a date")).otherwise(F.col("date").cast("string")).alias("day"),
    )
    return raw.select("event_id", F.trim("site").alias("site"), text.parse_date(F.col("day")).alias("date"))


@query
def visit_timestamps(spark, folder):
    raw = v.visits(spark, folder).select(
        "event_id",
        "date",
        F.when(F.col("event_id") % 10 == 1, F.date_format("ts", "H:mm"))
        .when(F.col("event_id") % 10 == 2, F.date_format("ts", "h:mm:ss a"))
        .when(F.col("event_id") % 10 == 3, F.concat(F.date_format("ts", "HH:mm:ss"), F.lit("h")))
        .when(F.col("event_id") % 10 != 0, F.date_format("ts", "HH:mm:ss"))
        .alias("time"),
    )
    return raw.select("event_id", text.visit_timestamp(F.col("date"), F.col("time")).alias("ts"))


@query
def migration_millions(spark, folder):
    return analyses.nightly_by_site(v.migration(spark, folder), v.region_map(spark), start="night")


@query
def log_offset(spark, folder):
    totals = diversity.site_totals(v.daily(spark, folder))
    return totals.select("date", "site", (F.col("visits") + 1).alias("visits_plus_one"))


@query
def county_membership(spark, folder):
    return within_boxes(v.detections(spark, folder), v.boxes(spark)).select("county", "id", "lat", "lon")


@query
def detections_in_period(spark, folder):
    rows = cleaning.in_period(v.detections(spark, folder), "timestamp", "2024-01-05", "2024-01-12")
    return rows.select("id", "timestamp", "species_common")


@query
def recent_detections(spark, folder):
    return cleaning.recent(v.detections(spark, folder), "timestamp", 8).select("id", "timestamp")


@query
def unpivot_species(spark, folder):
    species = v.species_names()
    wide = cleaning.matrix(v.named_daily(spark, folder), ["date", "site"], "bird", "visits", species)
    return cleaning.unpivot_species(wide, ids=("date", "site")).withColumnRenamed("Feeder Visits", "visits")


@query
def bin_date_matrix(spark, folder):
    """Counts by time bin and day: one block of rows per site and month, one column per day of it."""
    grid = timegrid.dense_grid(v.visits(spark, folder))
    by_day = grid.select("site", F.trunc("date", "month").alias("month"), "time_bin", "label", F.dayofmonth("date").alias("day"), "n")
    wide = cleaning.matrix(by_day, ["site", "month", "time_bin", "label"], "day", "n", range(1, 32))
    return wide.select("site", "month", "time_bin", "label", *[F.col(str(d)).alias(f"d{d:02d}") for d in range(1, 32)])


@query
def union_tables(spark, folder):
    """Daily rows and migration nights stacked by column name."""
    nights = analyses.nightly_by_site(v.migration(spark, folder), v.region_map(spark), start="night")
    return cleaning.union_by_name([v.daily(spark, folder), nights])


@query
def condition_labels(spark, folder):
    """Whole texts classified by the words that change descriptions use."""
    words = F.col("text")
    return (
        v.table(spark, folder, "documents")
        .groupBy(
            text.condition_from_text(words).alias("condition"),
            text.condition_from_text(words, strict=True).alias("strict_condition"),
        )
        .agg(F.count("*").alias("n"))
    )


@query
def change_conditions(spark, folder):
    sites = diversity.site_totals(v.daily(spark, folder)).select("site").distinct()
    changes = phases.intervals(v.phase_changes(spark)).join(sites, "site")
    return changes.select("site", "start_date", "end_date", "condition", "segment")


@query
def iso_weeks(spark, folder):
    d = v.station_daily(spark, folder)
    return d.groupBy(text.iso_week(F.col("date")).alias("week")).agg(F.sum("n").alias("n"))


@query
def week_starts(spark, folder):
    d = v.station_daily(spark, folder)
    return d.groupBy(text.week_start(F.col("date")).alias("week"), F.year("date").alias("year")).agg(F.sum("n").alias("n"))


@query
def date_texts(spark, folder):
    totals = diversity.site_totals(v.daily(spark, folder))
    return totals.select(
        "site", text.day_text(F.col("date")).alias("day"), text.axis_label(F.col("date")).alias("label"), "visits"
    )


@query
def calendar_days(spark, folder):
    bounds = v.station_daily(spark, folder).groupBy("species_id").agg(
        F.min("date").alias("first"), F.max("date").alias("last")
    )
    return calendar.days_between(bounds, "first", "last")


# ------------------------------------------------------------------------- time grid


@query
def time_bin_counts(spark, folder):
    return timegrid.bin_counts(v.visits(spark, folder))


@query
def short_day_bins(spark, folder):
    """Counts in hourly bins from six to eight in the evening; other times go to the end bins."""
    bins = TimeBins(6, 20, 60)
    counts = timegrid.bin_counts(v.visits(spark, folder), bins)
    return counts.select("site", "date", "time_bin", bins.label(F.col("time_bin")).alias("label"), "n")


@query
def heatmap_counts(spark, folder):
    return timegrid.dense_grid(v.visits(spark, folder)).select("site", "date", "time_bin", "label", "n")


@query
def heatmap_proportions(spark, folder):
    grid = timegrid.dense_grid(v.visits(spark, folder))
    return grid.select("site", "date", "time_bin", "day_total", "proportion")


# ----------------------------------------------------------------------------- joins


@query
def coverage_gaps(spark, folder):
    observed = v.device_daily(spark, folder)
    planned = calendar.coverage(observed, "2024-01-01", "2024-02-03")
    return calendar.coverage_gaps(planned, observed)


@query
def migration_join(spark, folder):
    totals = diversity.site_totals(v.daily(spark, folder))
    nights = analyses.nightly_by_site(v.migration(spark, folder), v.region_map(spark), "2024-01-02", "night")
    return totals.join(nights, ["date", "site"], "left")


@query
def condition_in_force(spark, folder):
    rows = phases.condition_in_force(v.visits(spark, folder), v.phase_changes(spark))
    return rows.select("event_id", "site", "date", "condition")


@query
def gap_filled_series(spark, folder):
    series = v.named_daily(spark, folder).withColumn("note", F.lit("seen"))
    return calendar.fill_days(series, ["bird", "site"])


@query
def species_styles(spark, folder):
    seen = v.named_daily(spark, folder).groupBy("bird").agg(F.sum("visits").alias("visits"))
    return catalogue.with_styles(seen, v.styles(spark))


@query
def unstyled_species(spark, folder):
    return catalogue.unstyled(v.daily(spark, folder), v.styles(spark))


# ---------------------------------------------------------------------- aggregations


@query
def site_day_totals(spark, folder):
    return diversity.site_totals(v.daily(spark, folder))


@query
def species_richness(spark, folder):
    return diversity.richness(diversity.species_days(v.daily(spark, folder)))


@query
def richness_of_all_rows(spark, folder):
    return diversity.richness(diversity.species_days(v.daily(spark, folder)), positive_only=False)


@query
def shannon_diversity(spark, folder):
    return diversity.shannon(diversity.species_days(v.daily(spark, folder)))


@query
def weekly_presence(spark, folder):
    return diversity.weekly_presence(diversity.species_days(v.daily(spark, folder)), complete_only=True)


@query
def county_daily_totals(spark, folder):
    return acoustic.daily_totals(v.station_daily(spark, folder))


@query
def daily_variation(spark, folder):
    return acoustic.variation(acoustic.daily_totals(v.station_daily(spark, folder)))


@query
def yearly_trend(spark, folder):
    return acoustic.yearly_trend(acoustic.daily_totals(v.station_daily(spark, folder)))


@query
def detection_summary(spark, folder):
    return acoustic.summary(v.station_daily(spark, folder))


@query
def distinct_pairs(spark, folder):
    return v.visits(spark, folder).na.drop(subset=["bird"]).select("bird", "site").distinct()


@query
def pair_sizes(spark, folder):
    return intervals.large_keys(v.visits(spark, folder), ["bird", "site"], 70)


@query
def yearly_device_counts(spark, folder):
    return acoustic.yearly_counts(v.device_daily(spark, folder), 2024)


# ------------------------------------------------------------ windows and time series


@query
def site_intervals(spark, folder):
    rows = intervals.interval_rows(v.visits(spark, folder))
    return rows.select("event_id", "site", "ivi_minutes")


@query
def species_intervals(spark, folder):
    rows = intervals.interval_rows(v.visits(spark, folder), ["bird", "site"], min_rows=5)
    return rows.select("event_id", "bird", "site", "ivi_minutes")


@query
def interval_histogram(spark, folder):
    return intervals.interval_histogram(v.visits(spark, folder))


@query
def phase_segments(spark, folder):
    daily = v.named_daily(spark, folder)
    return phases.segments(daily, v.phase_changes(spark), ["bird", "site"])


@query
def markers_before_change(spark, folder):
    return phases.markers_before(v.daily(spark, folder), v.phase_changes(spark))


@query
def markers_between_dates(spark, folder):
    return phases.markers_between(v.daily(spark, folder), v.phase_changes(spark))


@query
def primary_markers(spark, folder):
    marks = phases.primary_markers(v.daily(spark, folder), v.phase_changes(spark))
    texts = F.array_join(F.transform("markers", lambda m: m.cast("string")), "|")
    return marks.select("site", "primary_marker", texts.alias("markers"))


@query
def phase_periods(spark, folder):
    return phases.periods(v.daily(spark, folder), v.phase_changes(spark))


@query
def weekly_sorensen_by_date(spark, folder):
    return diversity.weekly_sorensen_by_date(diversity.species_days(v.daily(spark, folder)))


def _station_base(spark: SparkSession, folder: str) -> DataFrame:
    rows = v.station_daily(spark, folder).select("date", F.col("species_id").alias("bird"), F.col("n").alias("visits"))
    return diversity.species_days(rows, keys=())


@query
def weekly_sorensen(spark, folder):
    presence = diversity.weekly_presence(_station_base(spark, folder), (), "week_start")
    return diversity.consecutive_weeks(diversity.weekly_sorensen(presence, ()))


@query
def weekly_sorensen_iso(spark, folder):
    return diversity.weekly_sorensen_by_date(_station_base(spark, folder), (), complete_only=False)


@query
def rolling_sorensen(spark, folder):
    return diversity.rolling_sorensen(diversity.species_days(v.daily(spark, folder)))


@query
def survivor_curve(spark, folder):
    runs = survival.survivor_runs(intervals.interval_histogram(v.visits(spark, folder)))
    return survival.survivor_points(runs)


# ------------------------------------------------------------------------ model fits


def _site_runs(spark: SparkSession, folder: str) -> DataFrame:
    return survival.survivor_runs(intervals.interval_histogram(v.visits(spark, folder)))


def _given_parameters(runs: DataFrame) -> DataFrame:
    values = [F.lit(x).alias(p) for p, x in zip(fitting.PARAMETERS, PHASE_PARAMETERS)]
    return runs.select("site").distinct().select("site", *values)


@query
def curve_values(spark, folder):
    at = [F.lit(x) for x in PHASE_PARAMETERS]
    return _site_runs(spark, folder).select(
        "site",
        "t",
        curves.survivor(F.col("t"), *at).alias("value"),
        curves.log_survivor(F.col("t"), *at).alias("log_value"),
    )


@query
def fit_sites_linear(spark, folder):
    return fitting.fit(_site_runs(spark, folder), fitting.LINEAR_PER_SITE)


@query
def fit_sites_log(spark, folder):
    return fitting.fit(_site_runs(spark, folder), fitting.LOG_PER_SITE)


@query
def fit_species(spark, folder):
    return analyses.bout_fits(v.visits(spark, folder), {"species": fitting.LOG_PER_SPECIES}, ["bird", "site"], 5)


@query
def fit_species_single_start(spark, folder):
    return analyses.bout_fits(v.visits(spark, folder), {"single": fitting.LOG_SINGLE_START}, ["bird"])


def _outcomes(visits: DataFrame, plan: fitting.FitPlan, keys: list[str], min_rows: int = 0) -> DataFrame:
    """What becomes of each fit, and whether its parameters are a minimum: no one of them could take a hundredth off the error."""
    runs = staged(survival.survivor_runs(intervals.interval_histogram(visits, keys, min_rows), keys), "runs")
    params = staged(fitting.fit(runs, plan, keys), "fits")
    checked = fitting.optimality(runs, params, plan, keys)
    optimal = ((F.col("gain") <= 0.01) & F.col("in_bounds")).alias("optimal")
    return params.join(checked, keys, "left").select(*keys, "n", "start_no", "converged", "reason", optimal)


@query
def fit_outcome_linear(spark, folder):
    return _outcomes(v.visits(spark, folder), fitting.LINEAR_PER_SITE, ["site"])


@query
def fit_outcome_log(spark, folder):
    return _outcomes(v.visits(spark, folder), fitting.LOG_PER_SITE, ["site"])


@query
def fit_outcome_species(spark, folder):
    return _outcomes(v.visits(spark, folder), fitting.LOG_PER_SPECIES, ["bird", "site"], 5)


@query
def fit_outcome_species_fast(spark, folder):
    """The same visits with all times divided by twelve: shorter intervals, for which the first start is feasible."""
    visits = v.visits(spark, folder).withColumn("sec", F.floor(F.col("sec") / 12).cast("bigint"))
    return _outcomes(visits, fitting.LOG_PER_SPECIES, ["bird", "site"], 5)


@query
def fit_outcome_single_start(spark, folder):
    return _outcomes(v.visits(spark, folder), fitting.LOG_SINGLE_START, ["bird"])


@query
def goodness_of_fit(spark, folder):
    runs = staged(_site_runs(spark, folder), "runs")
    return fitting.goodness_of_fit(runs, _given_parameters(runs))


@query
def prediction_grid(spark, folder):
    runs = staged(_site_runs(spark, folder), "runs")
    return fitting.prediction_grid(runs, _given_parameters(runs), 200)


# ------------------------------------------------------------------------ composites


@query
def flagship_diversity(spark, folder):
    return analyses.diversity_metrics(v.daily(spark, folder))


@query
def sorted_metrics(spark, folder):
    base = diversity.species_days(v.daily(spark, folder))
    return diversity.alpha_diversity(base).orderBy("site", "date")


@query
def baseline_series(spark, folder):
    return analyses.baseline_series(v.daily(spark, folder), v.phase_changes(spark), "2024-01-05")


@query
def migration_overlay(spark, folder):
    return analyses.migration_overlay(
        v.daily(spark, folder), v.migration(spark, folder), v.region_map(spark), v.phase_changes(spark),
        "2024-01-02", "night",
    )


@query
def bout_points(spark, folder):
    return analyses.bout_points(v.visits(spark, folder), v.phase_changes(spark))


@query
def bout_all_sites(spark, folder):
    plans = {"linear": fitting.LINEAR_PER_SITE, "log": fitting.LOG_PER_SITE}
    return analyses.bout_fits(v.visits(spark, folder), plans)


def _county_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Station counts of two counties: customers of even and of odd number."""
    county = F.when(F.col("o_custkey") % 2 == 0, "even").otherwise("odd").alias("county")
    species = F.concat(F.lit("s"), (F.col("o_custkey") % 17).cast("string")).alias("species_id")
    counts = v.table(spark, folder, "orders").groupBy(county, F.col("o_orderdate").cast("date").alias("date"), species)
    day = Window.partitionBy("county", "date")
    return counts.agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(day))


@query
def county_acoustic_daily(spark, folder):
    return analyses.acoustic_daily(_county_counts(spark, folder), ["county"])


@query
def county_report(spark, folder):
    """The station report written and read back: rows of each table, and the summary of each county."""
    path = scratch_dir(spark, "report")
    acoustic_jobs.write_station_report(_county_counts(spark, folder), path, ["county"])
    rows = lambda name, column: spark.read.option("header", True).csv(f"{path}/{name}").groupBy("county").agg(F.count("*").alias(column))
    schema = "county STRING, days BIGINT, weeks BIGINT, species BIGINT, detections BIGINT, cv DOUBLE"
    summary = spark.read.schema(schema).option("header", True).csv(f"{path}/summary")
    return summary.join(rows("daily", "daily_rows"), "county").join(rows("weekly", "weekly_rows"), "county").join(rows("trends", "years"), "county")


@query
def device_report(spark, folder):
    path = scratch_dir(spark, "report")
    acoustic_jobs.write_device_report(v.device_daily(spark, folder), path)
    schema = "serial_code STRING, days BIGINT, weeks BIGINT, species BIGINT, detections BIGINT"
    rows = spark.read.schema("date DATE, serial_code STRING, species_name STRING, n BIGINT").option("header", True).csv(f"{path}/daily")
    counted = rows.groupBy("serial_code").agg(F.count("*").alias("daily_rows"))
    return spark.read.schema(schema).option("header", True).csv(f"{path}/summary").join(counted, "serial_code")


@query
def station_pages(spark, folder):
    """Stations as result pages, one for each three, read back."""
    d = v.detections(spark, folder).groupBy("station_id").agg(F.max("lat").alias("lat"), F.min("lon").alias("lon"))
    coords = F.when(F.col("station_id") != "7", F.struct("lat", "lon")).alias("coords")
    node = F.struct(F.col("station_id").alias("id"), F.concat(F.lit("Station "), "station_id").alias("name"), coords)
    pages = d.groupBy(F.floor(F.col("station_id").cast("int") / 3)).agg(F.collect_list(node).alias("nodes"))
    path = _land_json(pages.select(F.struct(F.struct("nodes").alias("stations")).alias("data")), "stations")
    return nested.read_stations(spark, path).select("id", "name", "coords.lat", "coords.lon", "timezone")


@query
def acoustic_daily(spark, folder):
    return analyses.acoustic_daily(v.station_daily(spark, folder))
