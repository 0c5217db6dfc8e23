"""The registered queries in SQL, for comparison on another engine.

Written from the definition of each result and not from the Spark plan: windows
instead of pre-aggregation, list functions instead of presence rows, a row per point
instead of runs. Model fits have no SQL form and are tested on known curves.
"""

from __future__ import annotations

VISITS = """visits AS (
  SELECT event_id, CAST(ts AS DATE) AS date, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts,
         hour(ts) * 60 + minute(ts) AS minute_of_day, event_type AS site,
         CASE WHEN user_id % 25 = 24 THEN NULL
              ELSE concat('sp', lpad(CAST(user_id % 25 AS VARCHAR), 2, '0')) END AS bird,
         value
  FROM events)"""
DAILY = VISITS + """,
daily AS (
  SELECT date, site, bird, CAST(sum(CASE WHEN value >= 30 THEN 1 ELSE 0 END) AS BIGINT) AS visits
  FROM visits GROUP BY date, site, bird)"""
NAMED = DAILY + """,
named AS (SELECT date, site, coalesce(bird, 'unknown') AS bird, visits FROM daily)"""
TOTALS = DAILY + """,
totals AS (SELECT date, site, CAST(coalesce(sum(visits), 0) AS BIGINT) AS visits FROM daily GROUP BY date, site)"""
CHANGES = """changes AS (
  SELECT site, CAST(d AS DATE) AS change_date, description,
         CASE WHEN contains(lower(description), 'seed') AND NOT contains(lower(description), 'extinct')
              THEN 'Seed' ELSE 'No Seed' END AS condition
  FROM (VALUES
    ('click', '2024-01-10', 'Extinction'), ('click', '2024-01-20', 'Seed returned'),
    ('view', '2024-01-15', 'No seed'), ('purchase', '2024-01-08', 'Seed extinction'),
    ('purchase', '2023-12-01', 'Seed'), ('error', '2024-02-15', 'Extinct')) AS t(site, d, description))"""
MIGRATION = """migration AS (
  SELECT CAST(DATE '2024-01-01' + CAST(o_orderkey % 25 AS INTEGER) AS DATE) AS night,
         concat('region-', o_orderpriority) AS region_name, count(*) * 1000 AS total_birds
  FROM orders GROUP BY 1, 2)"""
REGIONS = """regions AS (
  SELECT * FROM (VALUES ('region-1-URGENT', 'click'), ('region-2-HIGH', 'view'),
                        ('region-3-MEDIUM', 'purchase')) AS t(region_name, site))"""
NIGHTS = MIGRATION + ",\n" + REGIONS + """,
nights AS (
  SELECT m.night AS date, r.site, m.total_birds / 1e6 AS millions
  FROM migration m LEFT JOIN regions r USING (region_name))"""
STATION = """station AS (
  SELECT date, species_id, n, CAST(sum(n) OVER (PARTITION BY date) AS BIGINT) AS total FROM (
    SELECT CAST(o_orderdate AS DATE) AS date, concat('s', CAST(o_custkey % 17 AS VARCHAR)) AS species_id,
           count(*) AS n FROM orders GROUP BY 1, 2))"""
DEVICE = VISITS + """,
device AS (
  SELECT date, site AS serial_code, coalesce(bird, 'unknown') AS species_name, count(*) AS n
  FROM visits GROUP BY 1, 2, 3)"""
DETECTIONS = """detections AS (
  SELECT event_id AS id, ts AS timestamp,
         CAST(29.4 + (event_id % 140) * 0.01 AS DOUBLE) AS lat,
         CAST(-82.2 + (user_id % 130) * 0.01 AS DOUBLE) AS lon,
         event_type AS species_common, CAST(user_id % 20 AS VARCHAR) AS station_id
  FROM events),
boxes AS (
  SELECT county, CAST(a AS DOUBLE) AS sw_lat, CAST(b AS DOUBLE) AS ne_lat,
         CAST(c AS DOUBLE) AS sw_lon, CAST(d AS DOUBLE) AS ne_lon
  FROM (VALUES ('a', 30.00, 30.65, -82.10, -81.20), ('b', 29.55, 30.25, -81.80, -81.05)) AS t(county, a, b, c, d))"""
GRID_CLOCK = "strftime(TIMESTAMP '1970-01-01' + to_minutes(CAST({minutes} AS BIGINT)), '%I:%M %p')"

# Interval of each visit to the one before it, by row.
SITE_IVI = VISITS + """,
ivi AS (
  SELECT * FROM (
    SELECT event_id, site, date, date_diff('second', lag(ts) OVER (PARTITION BY site ORDER BY ts, event_id), ts) AS gap_s
    FROM visits) WHERE gap_s IS NOT NULL)"""
POINTS = SITE_IVI + """,
points AS (
  SELECT site, gap_s / 60.0 AS t, row_number() OVER (PARTITION BY site ORDER BY gap_s, event_id) AS rank,
         count(*) OVER (PARTITION BY site) AS n
  FROM ivi),
curve AS (SELECT site, t, rank, n, (n - rank + 1) / CAST(n AS DOUBLE) AS y FROM points)"""

# Change in force and number of change dates passed, for a row r with site and date.
IN_FORCE = """(SELECT arg_max(c.condition, (c.change_date, c.description)) FROM changes c
     WHERE c.site = r.site AND c.change_date <= r.date)"""
PASSED = """(SELECT count(DISTINCT c.change_date) FROM changes c WHERE c.site = r.site AND c.change_date <= r.date)"""

SHANNON = """CASE WHEN sum(v) > 0 THEN coalesce(-sum(CASE WHEN v > 0 THEN (v / total) * ln(v / total) END), 0)
            ELSE 0 END"""

RICHNESS = """richness AS (
  SELECT date, site, count(DISTINCT bird) AS richness FROM daily WHERE visits > 0 GROUP BY date, site)"""
SHANNON_BY_SITE = f"""shannon AS (
  SELECT date, site, {SHANNON} AS shannon_h FROM (
    SELECT date, site, bird, CAST(sum(visits) AS DOUBLE) AS v,
           CAST(sum(sum(visits)) OVER (PARTITION BY date, site) AS DOUBLE) AS total
    FROM daily WHERE bird IS NOT NULL GROUP BY date, site, bird)
  GROUP BY date, site)"""
SORENSEN = """CASE WHEN len(a) + len(b) > 0
         THEN 1 - 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END"""
WEEKLY = f"""week_sets AS (
  SELECT site, week, coalesce(list(DISTINCT bird) FILTER (WHERE v > 0), []) AS b FROM (
    SELECT site, CAST(week(date) AS BIGINT) AS week, bird, sum(visits) AS v
    FROM daily WHERE bird IS NOT NULL GROUP BY 1, 2, 3) GROUP BY site, week),
weekly AS (
  SELECT site, week, {SORENSEN} AS sorensen FROM (
    SELECT *, lag(b) OVER (PARTITION BY site ORDER BY week) AS a FROM week_sets)),
weekly_dates AS (
  SELECT d.date, d.site, w.sorensen
  FROM (SELECT DISTINCT date, site FROM daily WHERE bird IS NOT NULL) d
  LEFT JOIN weekly w ON w.site = d.site AND w.week = week(d.date))"""
ROLLING = f"""day_sets AS (
  SELECT site, date, coalesce(list(bird) FILTER (WHERE v > 0), []) AS s,
         row_number() OVER (PARTITION BY site ORDER BY date) AS i FROM (
    SELECT site, date, bird, sum(visits) AS v FROM daily WHERE bird IS NOT NULL GROUP BY 1, 2, 3)
  GROUP BY site, date),
windows AS (
  SELECT site, date, i,
         list_distinct(flatten(list(s) OVER (PARTITION BY site ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))) AS b,
         list_distinct(flatten(coalesce(list(s) OVER (PARTITION BY site ORDER BY date ROWS BETWEEN 9 PRECEDING AND 7 PRECEDING), []))) AS a
  FROM day_sets),
rolling AS (SELECT date, site, CASE WHEN i > 7 THEN {SORENSEN} END AS rolling_sorensen FROM windows)"""
STATION_WEEKS = f"""week_sets AS (
  SELECT week, list(DISTINCT species_id) AS b FROM (
    SELECT {{week}} AS week, species_id FROM station WHERE n > 0) GROUP BY week),
weekly AS (
  SELECT week, a IS NULL AS is_first, CASE WHEN a IS NOT NULL THEN {SORENSEN} END AS sorensen FROM (
    SELECT *, lag(b) OVER (ORDER BY week) AS a FROM week_sets))"""

# Observed dates around each change.
AROUND = TOTALS + ",\n" + CHANGES + """,
around AS (
  SELECT c.site, c.change_date, c.description,
         max(t.date) FILTER (WHERE t.date < c.change_date) AS lo,
         min(t.date) FILTER (WHERE t.date >= c.change_date) AS hi,
         list_sort(list(DISTINCT t.date)) AS days
  FROM changes c JOIN totals t ON t.site = c.site GROUP BY ALL),
between_marks AS (
  SELECT site, change_date, description,
         CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo WHEN len(days) >= 2 THEN days[-2] ELSE days[1] END AS l,
         CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN hi ELSE days[-1] END AS r
  FROM around),
marks AS (
  SELECT site, change_date, description,
         CAST(l AS TIMESTAMP) + to_hours(12 * CAST(date_diff('day', l, r) AS INTEGER)) AS marker
  FROM between_marks)"""

SPECIES_COLUMNS = [f"sp{i:02d}" for i in range(24)]
CURVE = "0.45 * exp(-0.06 * t) + 0.55 * exp(-0.04 * t)"
CURVE_DOUBLE = CURVE.replace("0.45", "CAST(0.45 AS DOUBLE)").replace("0.55", "CAST(0.55 AS DOUBLE)")

ORACLE_SQL: dict[str, str] = {}


def _add(name: str, body: str, *parts: str) -> None:
    ORACLE_SQL[name] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


_D = "CAST(date AS VARCHAR) AS date"

# ---------------------------------------------------------------- sources and sinks
_NOTE = """CASE WHEN event_id % 3 = 0 THEN concat('"first" line', chr(10), 'second, "', CAST(event_id AS VARCHAR), '"')
  ELSE concat('said ""id, ', CAST(event_id AS VARCHAR), '"" twice') END"""
_add("csv_scan", f"""SELECT {_D}, site, bird, strftime(ts, '%H:%M:%S') AS time, event_id % 7 AS "LeftPecks",
  event_id % 5 AS "RightPecks", CAST(NULL AS BIGINT) AS "LeftSeed", {_NOTE} AS notes,
  CAST(ts AS VARCHAR) AS ts, minute_of_day FROM visits""", VISITS)
_add("daily_csv_scan", f"SELECT {_D}, site, bird, visits FROM daily", DAILY)
_add("phase_csv_scan", """SELECT site, CAST(min(date) AS VARCHAR) AS change_date, concat('Began, "', site, '"') AS description
FROM visits GROUP BY site
UNION ALL SELECT site, NULL, concat('Ends', chr(10), 'after ', CAST(max(date) AS VARCHAR)) FROM visits GROUP BY site""", VISITS)
_add("visit_rejects", """SELECT CASE WHEN event_id % 5 = 0 THEN 'unreadable date' ELSE 'unreadable time' END AS reason, count(*) AS n
FROM visits WHERE event_id % 5 = 0 OR event_id % 7 < 2 GROUP BY 1""", VISITS)
_add("migration_scan", """SELECT CAST(CAST(night AS TIMESTAMP) AS VARCHAR) AS migration_start_utc, region_name,
  CAST(total_birds AS DOUBLE) AS total_birds FROM migration""", MIGRATION)
_add("sheet_scan", f"""SELECT CAST(date AS VARCHAR) AS "Date", bird AS "Bird", strftime(ts, '%H:%M:%S') AS "Time",
  CAST(event_id % 7 AS DOUBLE) AS "LeftPecks", concat(site, '_fl') AS source_sheet,
  {_NOTE} AS "Notes" FROM visits""", VISITS)
_add("consolidated_daily", """SELECT CAST(date AS VARCHAR) AS "Date",
  concat(upper(site[1]), site[2:], ', FL Daily Su') AS source_sheet, bird AS "Bird",
  CAST(visits AS DOUBLE) AS "Feeder Visits" FROM named WHERE site <> 'view'
UNION ALL
SELECT CAST(d.date AS VARCHAR), 'South daily summaries', s.bird, CAST(v.visits AS DOUBLE)
FROM (SELECT DISTINCT date FROM named WHERE site = 'view') d
CROSS JOIN (SELECT CASE WHEN i < 24 THEN concat('sp', lpad(CAST(i AS VARCHAR), 2, '0')) ELSE 'unknown' END AS bird FROM range(25) AS g(i)) s
LEFT JOIN named v ON v.site = 'view' AND v.date = d.date AND v.bird = s.bird""", NAMED)
_add("station_counts_json", f"SELECT {_D}, species_id, n, total FROM station", STATION)
_add("device_counts_json", f"""SELECT {_D}, serial_code,
  CASE WHEN species_name = 'sp03' THEN 'Unknown' ELSE species_name END AS species_name, '' AS species_scientific,
  CASE WHEN species_name = 'sp04' THEN 0 ELSE n END AS n,
  CAST(sum(CASE WHEN species_name = 'sp04' THEN 0 ELSE n END) OVER (PARTITION BY date, serial_code) AS BIGINT)
    AS total_daily_detections FROM device""", DEVICE)
_add("paged_documents", """SELECT CAST(id AS VARCHAR) AS id, CAST(timestamp AS VARCHAR) AS timestamp, station_id
FROM detections""", DETECTIONS)
_add("flatten_detections", """SELECT CAST(id AS VARCHAR) AS id, CAST(timestamp AS VARCHAR) AS timestamp,
  CAST(NULL AS VARCHAR) AS certainty, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS DOUBLE) AS probability,
  CAST(NULL AS DOUBLE) AS score, round(lat, 6) AS lat, round(lon, 6) AS lon,
  CASE WHEN species_common <> 'error' THEN species_common END AS species_common,
  CAST(NULL AS VARCHAR) AS species_scientific, CAST(NULL AS VARCHAR) AS species_ebird, station_id,
  CAST(NULL AS VARCHAR) AS station_name, CAST(NULL AS VARCHAR) AS sound_url, CAST(NULL AS VARCHAR) AS sound_start,
  CAST(NULL AS VARCHAR) AS sound_end FROM detections""", DETECTIONS)
_IN_BOX = "lat BETWEEN sw_lat AND ne_lat AND lon BETWEEN sw_lon AND ne_lon"
_add("county_csv_sink", f"""SELECT county, id, species_common, station_id FROM detections JOIN boxes ON {_IN_BOX}""", DETECTIONS)
_add("table_sinks", f"""SELECT kind, {_D}, site, visits FROM totals CROSS JOIN (VALUES ('csv'), ('parquet')) AS k(kind)""", TOTALS)
_add("result_manifest", """SELECT filename,
  CASE WHEN title = 'Again' THEN (SELECT concat('Totals of ', count(*), ' site days') FROM totals) ELSE title END AS title, 'parquet' AS type, created, concat('tables/', filename) AS image_path,
  (SELECT count(*) FROM totals) AS table_rows FROM (VALUES
  ('heatmap_counts', 'Totals', '2024-02-01T10:00:00'), ('diversity_metrics', 'Shannon', '2024-02-01T10:05:00'),
  ('heatmap_counts', 'Again', '2024-02-02T10:00:00')) AS t(filename, title, created)""", TOTALS)
_add("publish_order", """SELECT CAST(position AS BIGINT) AS position, filename,
  CASE WHEN position = 4 THEN (SELECT concat('Totals of ', count(*), ' site days') FROM totals) ELSE title END AS title,
  title IS NOT NULL AS found FROM (VALUES
  (1, 'species_visits_by_date', NULL), (2, 'migration_relation', NULL), (3, 'mbd_plot', NULL),
  (4, 'heatmap_counts', 'Again'), (5, 'heatmap_proportions', NULL), (6, 'all_birds_bout_analysis', NULL),
  (7, 'individual_species_bout_analysis', NULL), (8, 'diversity_metrics', 'Shannon')) AS t(position, filename, title)""", TOTALS)
_add("device_dimension", """SELECT serial_code, CAST(min(date) AS VARCHAR) AS first_seen,
  count(DISTINCT species_name) AS species FROM device WHERE serial_code <> 'error' GROUP BY serial_code""", DEVICE)

# ------------------------------------------------------------ projection and cleaning
_add("project_visits", f"SELECT {_D}, bird, CAST(ts AS VARCHAR) AS ts, site FROM visits", VISITS)
_add("site_keys", "SELECT concat(site, '_city_fl_32259') AS site_key, count(*) AS n FROM visits GROUP BY site", VISITS)
_add("remap_regions", """SELECT CAST(night AS VARCHAR) AS night, r.site AS region_name, total_birds
FROM migration LEFT JOIN regions r USING (region_name)""", MIGRATION, REGIONS)
_add("drop_null_species", "SELECT event_id, bird, site FROM visits WHERE bird IS NOT NULL", VISITS)
_add("drop_incomplete", f"""SELECT {_D}, site, bird, visits FROM daily
WHERE date IS NOT NULL AND site IS NOT NULL AND bird IS NOT NULL AND visits IS NOT NULL""", DAILY)
_add("drop_subtotals", """SELECT CAST(date AS VARCHAR) AS "Date", site, visits FROM totals
UNION ALL SELECT NULL, site, CAST(sum(visits) AS BIGINT) FROM totals WHERE site = 'view' GROUP BY site""", TOTALS)
_add("lower_bounds", f"""SELECT 'migration' AS source, CAST(night AS VARCHAR) AS date, total_birds AS n FROM migration
  WHERE night > DATE '2024-01-10'
UNION ALL SELECT 'daily', CAST(date AS VARCHAR), visits FROM daily WHERE date >= DATE '2024-01-20'""", DAILY, MIGRATION)
_add("excluded_species", """SELECT event_id, bird FROM visits
WHERE bird IS NULL OR bird NOT IN ('sp01', 'sp02')""", VISITS)
_add("positive_visits", f"SELECT {_D}, site, bird, visits FROM daily WHERE visits > 0", DAILY)
_add("text_dates", """SELECT event_id, site, CASE WHEN event_id % 3 <> 0 THEN CAST(date AS VARCHAR) END AS date
FROM visits""", VISITS)
_add("visit_timestamps", """SELECT event_id, CASE WHEN event_id % 10 = 1 THEN CAST(date_trunc('minute', ts) AS VARCHAR)
  WHEN event_id % 10 NOT IN (0, 3) THEN CAST(ts AS VARCHAR) END AS ts
FROM visits""", VISITS)
_add("migration_millions", "SELECT CAST(date AS VARCHAR) AS date, site, round(millions, 6) AS millions FROM nights", NIGHTS)
_add("log_offset", f"SELECT {_D}, site, visits + 1 AS visits_plus_one FROM totals", TOTALS)
_add("county_membership", f"""SELECT county, id, round(lat, 6) AS lat, round(lon, 6) AS lon
FROM detections JOIN boxes ON {_IN_BOX}""", DETECTIONS)
_add("detections_in_period", """SELECT id, CAST(timestamp AS VARCHAR) AS timestamp, species_common FROM detections
WHERE CAST(timestamp AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'""", DETECTIONS)
_add("recent_detections", """SELECT id, CAST(timestamp AS VARCHAR) AS timestamp FROM detections
WHERE timestamp >= (SELECT max(timestamp) FROM detections) - INTERVAL 8 HOUR""", DETECTIONS)
_add("unpivot_species", """SELECT CAST(d.date AS VARCHAR) AS date, d.site, s.bird AS "Bird", CAST(v.visits AS DOUBLE) AS visits
FROM (SELECT DISTINCT date, site FROM daily) d
CROSS JOIN (SELECT CASE WHEN i < 24 THEN concat('sp', lpad(CAST(i AS VARCHAR), 2, '0')) ELSE 'unknown' END AS bird FROM range(25) AS g(i)) s
LEFT JOIN named v ON v.site = d.site AND v.date = d.date AND v.bird = s.bird""", NAMED)
_BIN = "LEAST(47, minute_of_day // 30)"
_GRID = f"""grid AS (
  SELECT d.site, d.date, i AS time_bin, coalesce(c.n, 0) AS n,
         CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY d.site, d.date) AS BIGINT) AS day_total
  FROM (SELECT DISTINCT site, date FROM visits) d CROSS JOIN range(48) AS g(i)
  LEFT JOIN (SELECT site, date, {_BIN} AS b, count(*) AS n FROM visits GROUP BY ALL) c
    ON c.site = d.site AND c.date = d.date AND c.b = i)"""
_add("bin_date_matrix", "SELECT site, CAST(date_trunc('month', date) AS DATE)::VARCHAR AS month, time_bin, "
     + GRID_CLOCK.format(minutes="time_bin * 30") + " AS label, "
     + ", ".join(f"max(n) FILTER (WHERE day(date) = {d}) AS d{d:02d}" for d in range(1, 32))
     + " FROM grid GROUP BY 1, 2, 3, 4", VISITS, _GRID)
_add("union_tables", f"""SELECT {_D}, site, bird, visits, CAST(NULL AS DOUBLE) AS millions FROM daily
UNION ALL SELECT CAST(date AS VARCHAR), site, NULL, NULL, round(millions, 6) FROM nights""", DAILY, NIGHTS)
_add("condition_labels", """SELECT condition, strict_condition, count(*) AS n FROM (
  SELECT CASE WHEN contains(t, 'seed') AND NOT contains(t, 'extinct') THEN 'Seed' ELSE 'No Seed' END AS condition,
         CASE WHEN contains(t, 'seed') AND NOT contains(t, 'extinct') AND NOT contains(t, 'no seed')
              THEN 'Seed' ELSE 'No Seed' END AS strict_condition
  FROM (SELECT lower(coalesce(text, '')) AS t FROM documents)) GROUP BY 1, 2""")
_add("change_conditions", """SELECT site, CAST(change_date AS VARCHAR) AS start_date,
  CAST(lead(change_date) OVER (PARTITION BY site ORDER BY change_date) AS VARCHAR) AS end_date, condition,
  row_number() OVER (PARTITION BY site ORDER BY change_date) AS segment
FROM changes WHERE site IN (SELECT site FROM totals)""", TOTALS, CHANGES)
_add("iso_weeks", "SELECT CAST(week(date) AS BIGINT) AS week, CAST(sum(n) AS BIGINT) AS n FROM station GROUP BY 1", STATION)
_add("week_starts", """SELECT CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR) AS week,
  CAST(year(date) AS BIGINT) AS year, CAST(sum(n) AS BIGINT) AS n FROM station GROUP BY 1, 2""", STATION)
_add("date_texts", """SELECT site, strftime(date, '%Y-%m-%d') AS day, strftime(date, '%m/%d') AS label, visits
FROM totals""", TOTALS)
_add("calendar_days", """SELECT species_id, CAST(CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS VARCHAR)
  AS date FROM station GROUP BY species_id""", STATION)

# ------------------------------------------------------------------------- time grid
_add("time_bin_counts", f"""SELECT site, {_D}, CAST({_BIN} AS BIGINT) AS time_bin, count(*) AS n
FROM visits GROUP BY ALL""", VISITS)
_add("short_day_bins", f"""SELECT site, {_D}, time_bin, {GRID_CLOCK.format(minutes='(time_bin + 6) * 60')} AS label, count(*) AS n
FROM (SELECT site, date, CAST(greatest(0, least(14, minute_of_day // 60 - 6)) AS BIGINT) AS time_bin FROM visits)
GROUP BY site, date, time_bin""", VISITS)
_add("heatmap_counts", f"SELECT site, {_D}, time_bin, {GRID_CLOCK.format(minutes='time_bin * 30')} AS label, n FROM grid", VISITS, _GRID)
_add("heatmap_proportions", f"""SELECT site, {_D}, time_bin, day_total,
  round_even(CAST(n AS DOUBLE) / day_total, 2) AS proportion FROM grid""", VISITS, _GRID)

# ----------------------------------------------------------------------------- joins
_add("coverage_gaps", """SELECT serial_code, CAST(CAST(d AS DATE) AS VARCHAR) AS date
FROM (SELECT DISTINCT serial_code FROM device) k
CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-03', INTERVAL 1 DAY)) AS d) c
WHERE NOT EXISTS (SELECT 1 FROM device x WHERE x.serial_code = k.serial_code AND x.date = CAST(d AS DATE))""", DEVICE)
_add("migration_join", """SELECT CAST(t.date AS VARCHAR) AS date, t.site, t.visits, round(n.millions, 6) AS millions
FROM totals t LEFT JOIN nights n ON n.date = t.date AND n.site = t.site AND n.date > DATE '2024-01-02'""", TOTALS, NIGHTS)
_add("condition_in_force", f"""SELECT event_id, site, {_D}, coalesce({IN_FORCE}, 'Seed') AS condition FROM visits r""", VISITS, CHANGES)
_add("gap_filled_series", """SELECT CAST(CAST(c.d AS DATE) AS VARCHAR) AS date, c.site, c.bird, coalesce(k.visits, 0) AS visits,
  CASE WHEN k.visits IS NOT NULL THEN 'seen' END AS note
FROM (SELECT bird, site, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d
      FROM named GROUP BY bird, site) c
LEFT JOIN named k ON k.bird = c.bird AND k.site = c.site AND k.date = CAST(c.d AS DATE)""", NAMED)
_STYLES = """styles AS (
  SELECT * FROM (VALUES ('sp00', '#DC143C', '#DC143C', '#DC143C', 'o'), ('sp01', '#000000', '#FFFFFF', 'black', 'o'),
    ('sp02', '#708090', '#708090', 'black', '^'), ('sp03', '#4169E1', NULL, NULL, NULL)) AS t(bird, color, fill, edge, marker))"""
_add("species_styles", """SELECT d.bird, CAST(sum(visits) AS BIGINT) AS visits, coalesce(any_value(color), '#808080') AS color,
  coalesce(any_value(fill), any_value(color), '#808080') AS fill, coalesce(any_value(edge), 'black') AS edge,
  coalesce(any_value(marker), 'o') AS marker
FROM named d LEFT JOIN styles s ON s.bird = d.bird GROUP BY d.bird""", NAMED, _STYLES)
_add("unstyled_species", """SELECT DISTINCT bird FROM daily
WHERE bird IS NOT NULL AND bird NOT IN (SELECT bird FROM styles)""", DAILY, _STYLES)

# ---------------------------------------------------------------------- aggregations
_add("site_day_totals", f"SELECT {_D}, site, visits FROM totals", TOTALS)
_add("species_richness", f"SELECT {_D}, site, richness FROM richness", DAILY, RICHNESS)
_add("richness_of_all_rows", f"SELECT {_D}, site, count(DISTINCT bird) AS richness FROM daily GROUP BY date, site", DAILY)
_add("shannon_diversity", f"SELECT {_D}, site, round(shannon_h, 6) AS shannon_h FROM shannon", DAILY, SHANNON_BY_SITE)
_add("weekly_presence", """SELECT site, CAST(week(date) AS BIGINT) AS week, bird, sum(visits) > 0 AS present
FROM daily WHERE bird IS NOT NULL GROUP BY 1, 2, 3""", DAILY)
_add("county_daily_totals", f"SELECT {_D}, max(total) AS total FROM station GROUP BY date", STATION)
_DAY_TOTALS = "day_totals AS (SELECT date, max(total) AS total FROM station GROUP BY date)"
_add("daily_variation", """SELECT count(*) AS days, round(stddev_samp(total) / avg(total), 6) AS cv FROM day_totals""", STATION, _DAY_TOTALS)
# Student's t in its finite trigonometric form: sin(theta) is |r|, one term per two degrees of freedom.
_TREND = """trend AS (
  SELECT year(date) AS year, count(*) AS days, regr_slope(total, x) AS slope, corr(total, x) AS r, count(*) - 2 AS nu
  FROM (SELECT *, date_diff('day', min(date) OVER (PARTITION BY year(date)), date) AS x FROM day_totals)
  GROUP BY 1 HAVING count(*) > 5),
terms AS (
  SELECT year, j, exp(sum(CASE WHEN j = 0 THEN 0 WHEN nu % 2 = 0 THEN ln((2 * j - 1) / (2.0 * j))
                               ELSE ln(2.0 * j / (2 * j + 1)) END) OVER (PARTITION BY year ORDER BY j)) AS coef
  FROM trend CROSS JOIN range(0, 400) AS g(j) WHERE j < CASE WHEN nu % 2 = 0 THEN nu // 2 ELSE (nu - 1) // 2 END)"""
_add("yearly_trend", """SELECT CAST(t.year AS BIGINT) AS year, days, round(any_value(slope), 6) AS slope, round(any_value(r), 6) AS r,
  round(CASE WHEN any_value(nu) % 2 = 0
    THEN 1 - any_value(abs(r)) * sum(coef * pow(1 - r * r, j))
    ELSE 1 - 2 / pi() * (asin(any_value(abs(r))) + any_value(abs(r)) * sum(coef * pow(1 - r * r, j + 0.5))) END, 6) AS p
FROM trend t JOIN terms m ON m.year = t.year GROUP BY t.year, days""", STATION, _DAY_TOTALS, _TREND)

# ------------------------------------------------------------ windows and time series
_add("detection_summary", """SELECT count(DISTINCT date) AS days, count(DISTINCT date_trunc('week', date)) AS weeks,
  count(DISTINCT species_id) AS species, CAST(sum(n) AS BIGINT) AS detections FROM station""", STATION)
_add("distinct_pairs", "SELECT DISTINCT bird, site FROM visits WHERE bird IS NOT NULL", VISITS)
_add("pair_sizes", """SELECT bird, site, count(*) AS n FROM visits WHERE bird IS NOT NULL
GROUP BY bird, site HAVING count(*) >= 70""", VISITS)
_add("yearly_device_counts", """SELECT serial_code, CAST(year(date) AS BIGINT) AS year, species_name, CAST(sum(n) AS BIGINT) AS n
FROM device WHERE year(date) = 2024 GROUP BY 1, 2, 3""", DEVICE)
_add("site_intervals", "SELECT event_id, site, round(gap_s / 60.0, 6) AS ivi_minutes FROM ivi", SITE_IVI)
_add("species_intervals", """SELECT event_id, bird, site, round(gap_s / 60.0, 6) AS ivi_minutes FROM (
  SELECT event_id, bird, site, count(*) OVER (PARTITION BY bird, site) AS size,
         date_diff('second', lag(ts) OVER (PARTITION BY bird, site ORDER BY ts, event_id), ts) AS gap_s
  FROM visits WHERE bird IS NOT NULL) WHERE size >= 5 AND gap_s IS NOT NULL""", VISITS)
_add("interval_histogram", "SELECT site, gap_s, count(*) AS n FROM ivi GROUP BY site, gap_s", SITE_IVI)
_add("phase_segments", f"""SELECT {_D}, site, bird, visits, raw_segment,
  dense_rank() OVER (PARTITION BY bird, site ORDER BY raw_segment) AS segment
FROM (SELECT *, {PASSED} AS raw_segment FROM named r)""", NAMED, CHANGES)
_add("markers_before_change", """SELECT site, CAST(change_date AS VARCHAR) AS change_date, description,
  CAST(CAST(lo AS TIMESTAMP) + to_hours(12 * CAST(date_diff('day', lo, change_date) AS INTEGER)) AS VARCHAR) AS marker
FROM around WHERE lo IS NOT NULL""", AROUND)
_add("markers_between_dates", """SELECT site, CAST(change_date AS VARCHAR) AS change_date, description,
  CAST(marker AS VARCHAR) AS marker FROM marks""", AROUND)
_add("primary_markers", """SELECT site, CAST(arg_min(marker, change_date) AS VARCHAR) AS primary_marker,
  string_agg(CAST(marker AS VARCHAR), '|' ORDER BY change_date, description) AS markers FROM marks GROUP BY site""", AROUND)
_add("phase_periods", """SELECT site, phase_no, CAST(s AS VARCHAR) AS start_date, CAST(e AS VARCHAR) AS end_date, condition,
  CAST(CAST(s AS TIMESTAMP) + to_hours(12 * CAST(date_diff('day', s, e) AS INTEGER)) AS VARCHAR) AS middle
FROM (
  SELECT site, k, s, condition, row_number() OVER w AS phase_no, lead(s) OVER w AS e FROM (
    SELECT site, 0 AS k, min(date) AS s, 'Seed' AS condition FROM totals GROUP BY site
    UNION ALL SELECT site, 1, change_date, condition FROM changes
    UNION ALL SELECT site, 2, max(date), NULL FROM totals GROUP BY site)
  WINDOW w AS (PARTITION BY site ORDER BY k, s)) WHERE k < 2""", TOTALS, CHANGES)
_add("weekly_sorensen_by_date", f"SELECT {_D}, site, round(sorensen, 6) AS sorensen FROM weekly_dates", DAILY, WEEKLY)
_add("weekly_sorensen", """SELECT CAST(week AS VARCHAR) AS week, round(sorensen, 6) AS sorensen FROM weekly
WHERE NOT is_first""", STATION, STATION_WEEKS.format(week="CAST(date_trunc('week', date) AS DATE)"))
_add("weekly_sorensen_iso", """SELECT CAST(d.date AS VARCHAR) AS date, round(w.sorensen, 6) AS sorensen
FROM (SELECT DISTINCT date FROM station) d JOIN weekly w ON w.week = week(d.date)""", STATION, STATION_WEEKS.format(week="week(date)"))
_add("rolling_sorensen", f"SELECT {_D}, site, round(rolling_sorensen, 6) AS rolling_sorensen FROM rolling", DAILY, ROLLING)
_add("survivor_curve", "SELECT site, round(t, 6) AS t, rank, round(y, 6) AS survivor FROM curve", POINTS)

# ------------------------------------------------------------------------ model fits
_add("curve_values", f"""SELECT site, round(t, 6) AS t, round({CURVE_DOUBLE}, 6) AS value,
  round(ln({CURVE_DOUBLE} + 1e-10), 6) AS log_value FROM (SELECT DISTINCT site, t FROM curve)""", POINTS)
# A fit goes through its starts in order; the first within the bounds is accepted on these data. Start rates are
# multiples of 1 / (scale * mean interval in minutes).
_OUTCOME = """gaps AS (
  SELECT {keys}, (sec - lag(sec) OVER (PARTITION BY {keys} ORDER BY sec)) / 60.0 AS t, count(*) OVER (PARTITION BY {keys}) AS size
  FROM (SELECT *, CAST(epoch(ts) AS BIGINT) // {step} AS sec FROM visits) WHERE {keys_known}),
sized AS (SELECT {keys}, count(*) AS n, {scale} * avg(t) AS mean FROM gaps WHERE t IS NOT NULL AND size >= {size} GROUP BY {keys}),
feasible AS (
  SELECT {keys}, min(k) AS start_no FROM sized, (VALUES {starts}) AS s(k, r1, r2)
  WHERE r1 / mean BETWEEN {low1} AND {high1} AND r2 / mean BETWEEN {low2} AND {high2} GROUP BY {keys}),
outcome AS (
  SELECT s.*, CASE WHEN n >= {points} THEN start_no END AS start_no FROM sized s LEFT JOIN feasible USING ({keys}))"""
_SPECIES_STARTS = "(1, 1.0, 0.01), (2, 0.5, 0.05), (3, 2.0, 0.001), (4, 0.1, 0.1)"
_VERDICT = """SELECT {keys}, n, CAST(start_no AS BIGINT) AS start_no, start_no IS NOT NULL AS converged,
  CASE WHEN n < {points} THEN 'too few points' WHEN start_no IS NULL THEN 'no feasible start' END AS reason,
  CASE WHEN start_no IS NOT NULL THEN true END AS optimal FROM outcome"""


def _fit_outcome(name, keys, step=1, scale=1.0, size=1, starts="(1, 0.0, 0.0)", low1=0, high1=1, low2=0, high2=1, points=10):
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys.split(", "))
    sql = _OUTCOME.format(keys=keys, keys_known=known, step=step, scale=scale, size=size, starts=starts, low1=low1, high1=high1, low2=low2, high2=high2, points=points)
    _add(name, _VERDICT.format(keys=keys, points=points), VISITS, sql)


for _name in ("fit_outcome_linear", "fit_outcome_log"):
    _fit_outcome(_name, "site", points=4)
for _name, _step in (("fit_outcome_species", 1), ("fit_outcome_species_fast", 12)):
    _fit_outcome(_name, "bird, site", _step, size=5, starts=_SPECIES_STARTS, low1=0.001, high1=50, low2=0.0001, high2=10)
_fit_outcome("fit_outcome_single_start", "bird", scale=0.3, starts="(1, 3.0, 0.05)", low1=0.01, high1=20, low2=0.001, high2=1)
_add("goodness_of_fit", f"""SELECT site, count(*) AS n,
  round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(y - f)), 6) AS mae
FROM (SELECT *, {CURVE_DOUBLE} AS f FROM curve) GROUP BY site""", POINTS)
_add("prediction_grid", f"""SELECT site, step, round(t, 6) AS t, round({CURVE_DOUBLE}, 6) AS total,
  round(CAST(0.45 AS DOUBLE) * exp(-0.06 * t), 6) AS within_bout, round(CAST(0.55 AS DOUBLE) * exp(-0.04 * t), 6) AS between_bout
FROM (SELECT site, i AS step, i * max_t / 199.0 AS t FROM (SELECT site, max(t) AS max_t FROM curve GROUP BY site)
      CROSS JOIN range(200) AS g(i))""", POINTS)

# ------------------------------------------------------------------------ composites
_ALPHA = "alpha AS (SELECT * FROM richness FULL JOIN shannon USING (date, site))"
_add("flagship_diversity", f"""SELECT {_D}, site, richness, round(shannon_h, 6) AS shannon_h, round(sorensen, 6) AS sorensen,
  round(rolling_sorensen, 6) AS rolling_sorensen
FROM alpha FULL JOIN weekly_dates USING (date, site) FULL JOIN rolling USING (date, site)""",
     DAILY, RICHNESS, SHANNON_BY_SITE, _ALPHA, WEEKLY, ROLLING)
_add("sorted_metrics", f"SELECT {_D}, site, richness, round(shannon_h, 6) AS shannon_h FROM alpha ORDER BY site, date",
     DAILY, RICHNESS, SHANNON_BY_SITE, _ALPHA)
_add("baseline_series", f"""SELECT {_D}, site, visits, visits + 1 AS visits_plus_one, raw_segment,
  dense_rank() OVER (PARTITION BY site ORDER BY raw_segment) AS segment
FROM (SELECT *, {PASSED} AS raw_segment FROM (
  SELECT CAST(c.d AS DATE) AS date, c.site, coalesce(k.visits, 0) AS visits
  FROM (SELECT site, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d
        FROM totals WHERE date >= DATE '2024-01-05' GROUP BY site) c
  LEFT JOIN totals k ON k.site = c.site AND k.date = CAST(c.d AS DATE)) r)""", TOTALS, CHANGES)
_add("migration_overlay", f"""SELECT CAST(date AS VARCHAR) AS date, site, visits, round(millions, 6) AS millions, raw_segment,
  dense_rank() OVER (PARTITION BY site ORDER BY raw_segment) AS segment
FROM (SELECT r.date, r.site, r.visits, n.millions, {PASSED} AS raw_segment FROM totals r
      LEFT JOIN nights n ON n.date = r.date AND n.site = r.site AND n.date > DATE '2024-01-02')""", TOTALS, CHANGES, NIGHTS)
_add("bout_points", f"""SELECT site, round(gap_s / 60.0, 6) AS t, condition, count(*) AS m, round(max(top), 6) AS survivor_top, max(n) AS n
FROM (
  SELECT site, gap_s, coalesce({IN_FORCE}, 'Seed') AS condition, count(*) OVER (PARTITION BY site) AS n,
         (count(*) OVER (PARTITION BY site) - rank() OVER (PARTITION BY site ORDER BY gap_s) + 1)
           / CAST(count(*) OVER (PARTITION BY site) AS DOUBLE) AS top
  FROM ivi r) GROUP BY site, gap_s, condition""", SITE_IVI, CHANGES)
_COUNTY = """county AS (
  SELECT *, CAST(sum(n) OVER (PARTITION BY county, date) AS BIGINT) AS total FROM (
    SELECT CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS county, CAST(o_orderdate AS DATE) AS date,
           concat('s', CAST(o_custkey % 17 AS VARCHAR)) AS species_id, count(*) AS n FROM orders GROUP BY 1, 2, 3)),
county_days AS (SELECT county, date, max(total) AS total FROM county GROUP BY 1, 2)"""
_add("county_acoustic_daily", f"""SELECT county, CAST(date AS VARCHAR) AS date, max(total_reported) AS total, count(DISTINCT species_id) AS richness,
  round({SHANNON}, 6) AS shannon_h
FROM (SELECT county, date, species_id, CAST(n AS DOUBLE) AS v, CAST(total AS DOUBLE) AS total,
             total AS total_reported FROM county) GROUP BY county, date""", _COUNTY)
_add("county_report", """SELECT c.county, count(DISTINCT c.date) AS days, count(DISTINCT date_trunc('week', c.date)) AS weeks,
  count(DISTINCT species_id) AS species, CAST(sum(n) AS BIGINT) AS detections, round(any_value(cv), 6) AS cv,
  count(DISTINCT c.date) AS daily_rows, count(DISTINCT date_trunc('week', c.date)) - 1 AS weekly_rows, any_value(years) AS years
FROM county c
JOIN (SELECT county, stddev_samp(total) / avg(total) AS cv FROM county_days GROUP BY county) v USING (county)
JOIN (SELECT county, count(*) AS years FROM (
  SELECT county, year(date) AS y FROM county_days GROUP BY 1, 2 HAVING count(*) > 5) GROUP BY county) y USING (county)
GROUP BY c.county""", _COUNTY)
_add("device_report", """SELECT serial_code, count(DISTINCT date) AS days, count(DISTINCT date_trunc('week', date)) AS weeks,
  count(DISTINCT species_name) AS species, CAST(sum(n) AS BIGINT) AS detections, count(*) AS daily_rows
FROM device GROUP BY serial_code""", DEVICE)
_add("station_pages", """SELECT station_id AS id, concat('Station ', station_id) AS name,
  CASE WHEN station_id <> '7' THEN round(max(lat), 6) END AS lat, CASE WHEN station_id <> '7' THEN round(min(lon), 6) END AS lon,
  CAST(NULL AS VARCHAR) AS timezone
FROM detections GROUP BY station_id""", DETECTIONS)
_add("acoustic_daily", f"""SELECT CAST(date AS VARCHAR) AS date, max(total_reported) AS total, count(DISTINCT species_id) AS richness,
  round({SHANNON}, 6) AS shannon_h
FROM (SELECT date, species_id, CAST(n AS DOUBLE) AS v, CAST(sum(n) OVER (PARTITION BY date) AS DOUBLE) AS total,
             total AS total_reported FROM station) GROUP BY date""", STATION)
