"""Schemas, domains and breaks that operators share."""

from __future__ import annotations

from pyspark.sql import types as T

# Risk zones are numbered 1 to 5; a score on a break belongs to the higher zone; 0 is no data.
ZONE_BREAKS = (0.2, 0.4, 0.6, 0.8)
ZONE_NAMES = ("Very Low", "Low", "Moderate", "High", "Very High")
# Numbers that mean "missing" in raw extracts.
SENTINELS = (-9999.0, -3.4028234663852886e38)
#: Side of a raster cell in metres.
CELL_M = 30.0
#: Classes with fewer rows are merged into OTHER.
RARE_MIN_ROWS = 50
OTHER = "Other"
UNKNOWN = "Unknown"

ORDER_CONTRACT = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()),
    T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderpriority", T.StringType()),
])
