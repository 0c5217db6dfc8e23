"""Names, boxes and styles whose results have to agree with existing reports.

They are defaults for the operators' dimension tables; pass your own tables instead
for other sites and species.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession

# Site of each raw sheet key and each daily sheet name.
SITE_LABELS = """\
from_value;to_value
southampton_uk;Southampton, UK
jacksonville_fl_32259;Jacksonville, FL
essex_fells_nj_07021;Essex Fells, NJ
Southampton daily summaries;Southampton, UK
Jacksonville, FL 32259 Daily Su;Jacksonville, FL
Essex Fells, NJ 07021 Daily Sum;Essex Fells, NJ
"""

# Site of each migration region.
REGION_SITES = """\
from_value;to_value
Duval County, Florida;Jacksonville, FL
Essex County, New Jersey;Essex Fells, NJ
Boulder County, Colorado;Boulder, CO
Lee County, Alabama;Lee County, AL
Contra Costa County, California;Contra Costa County, CA
"""

# Bounding boxes of the counties (they overlap).
COUNTY_BOXES = """\
county;sw_lat;ne_lat;sw_lon;ne_lon
duval_fl;30.00;30.65;-82.10;-81.20
st_johns_fl;29.55;30.25;-81.80;-81.05
"""

# Order in which results are published.
PUBLISH_ORDER = """\
position;filename
1;species_visits_by_date
2;migration_relation
3;mbd_plot
4;heatmap_counts
5;heatmap_proportions
6;all_birds_bout_analysis
7;individual_species_bout_analysis
8;diversity_metrics
"""

# Line colour, fill, edge colour and marker of each species.
SPECIES_STYLES = """\
bird;color;fill;edge;marker
Northern Cardinal;#DC143C;#DC143C;#DC143C;o
Tufted Titmouse;#B0C4DE;#B0C4DE;#B0C4DE;o
Gray Catbird;#808080;#808080;black;o
Carolina Chickadee;#000000;#FFFFFF;black;o
Carolina Wren;#8B4513;#8B4513;#8B4513;o
Red-bellied Woodpecker;#FF0000;#FF0000;black;o
Common Ground Dove;#D2B48C;#D2B48C;#D2B48C;o
Mourning Dove;#D2B48C;#D2B48C;black;o
Downy Woodpecker;#4B0082;#4B0082;black;o
Pigeon.1;#708090;#708090;black;^
Robin;#FF6347;#FF6347;black;o
Coal tit;#2F4F4F;#2F4F4F;black;o
White-breasted Nuthatch;#F0E68C;#F0E68C;black;o
Black-capped Chickadee;#000000;#FFFFFF;black;o
Blue tit;#4169E1;#4169E1;black;o
Pigeon;#708090;#708090;black;^
Blue Jay;#0000FF;#0000FF;black;o
Great tit;#FFD700;#FFD700;black;o
Nuthatch;#8FBC8F;#8FBC8F;black;o
House Finch;#A7947F;#A7947F;#D9534F;o
Dark-eyed Junco;#3C4043;#3C4043;black;^
"""

# First days of the migration and series windows.
MIGRATION_AFTER = "2025-10-02"
SERIES_FROM = "2025-10-05"

NUMERIC = {"position": int, "sw_lat": float, "ne_lat": float, "sw_lon": float, "ne_lon": float}


def dimension(spark: SparkSession, text: str) -> DataFrame:
    """One of the tables above as a DataFrame."""
    rows = list(csv.DictReader(io.StringIO(text), delimiter=";"))
    header = list(rows[0])
    types = {int: "INT", float: "DOUBLE", str: "STRING"}
    schema = ", ".join(f"{c} {types[NUMERIC.get(c, str)]}" for c in header)
    return spark.createDataFrame([[NUMERIC.get(c, str)(r[c]) for c in header] for r in rows], schema)
