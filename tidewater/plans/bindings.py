"""The given tables in the roles of the engine, as DataFrames and as SQL.

Each ``*_SQL`` text is the same derivation as the function next to it, so a
query and its SQL start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.raster import merge_cells
from tidewater.sources.scans import table, zone_rings

BY = "https://creativecommons.org/licenses/by/4.0/"
BY_ND = "https://creativecommons.org/licenses/by-nd/4.0/"

LICENSE_SQL = (
    f"CASE WHEN o_orderstatus = 'F' THEN '{BY}' WHEN o_orderstatus = 'O' THEN '{BY_ND}' "
    "WHEN o_orderpriority = '5-LOW' THEN 'all rights reserved' END"
)
LAT_SQL = "(32 + (o_orderkey * 37 % 1700) / CAST(100 AS DOUBLE))"
LON_SQL = "(-130 + (o_orderkey * 53 % 1500) / CAST(100 AS DOUBLE))"

# orders as clean sightings; a tenth of them has no position
SIGHTINGS_SQL = f"""(
  SELECT o_orderkey AS sighting_id, o_custkey AS individual_id, o_orderpriority AS species,
         CAST(o_orderdate AS DATE) AS obs_date,
         CASE WHEN o_orderkey % 10 <> 3 THEN {LAT_SQL} END AS lat,
         CASE WHEN o_orderkey % 10 <> 3 THEN {LON_SQL} END AS lon,
         {LICENSE_SQL} AS license, o_orderstatus AS provider,
         'thumb/' || CAST(o_orderkey AS VARCHAR) || '.jpg' AS thumb_url,
         CAST(o_orderkey AS VARCHAR) AS source_row_id
  FROM orders)"""


def sightings(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    spark_sql = lambda text: F.expr(text.replace("VARCHAR", "STRING"))
    placed = F.col("o_orderkey") % 10 != 3
    return orders.select(
        F.col("o_orderkey").alias("sighting_id"),
        F.col("o_custkey").alias("individual_id"),
        F.col("o_orderpriority").alias("species"),
        F.to_date("o_orderdate").alias("obs_date"),
        F.when(placed, spark_sql(LAT_SQL)).alias("lat"),
        F.when(placed, spark_sql(LON_SQL)).alias("lon"),
        spark_sql(LICENSE_SQL).alias("license"),
        F.col("o_orderstatus").alias("provider"),
        F.concat(F.lit("thumb/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("thumb_url"),
        F.col("o_orderkey").cast("string").alias("source_row_id"),
    )


ENCOUNTERS_SQL = f"""(
  SELECT CAST(o_orderkey AS VARCHAR) AS row_id,
         CASE WHEN o_orderkey % 40 <> 7
              THEN 'https://catalog.example/individual/' || CAST(o_custkey AS VARCHAR) END AS organism_id,
         o_orderpriority AS scientific_name,
         CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date_time,
         {LAT_SQL} AS latitude, {LON_SQL} AS longitude, {LICENSE_SQL} AS license,
         CAST(o_orderkey % 4 + 1 AS INT) AS group_size, o_orderstatus AS provider,
         CASE WHEN o_orderkey % 3 = 0 THEN 'holder ' || CAST(o_custkey AS VARCHAR) END AS rights_holder,
         'https://img.example/' || CAST(o_orderkey AS VARCHAR) AS external_resource,
         'thumb/' || CAST(o_orderkey AS VARCHAR) || '.jpg' AS external_resource_thumb
  FROM orders)"""


def encounters(spark: SparkSession, folder: str) -> DataFrame:
    text = ENCOUNTERS_SQL.replace("VARCHAR", "STRING").replace("FROM orders", "FROM {orders}")
    return spark.sql(f"SELECT * FROM {text}", orders=table(spark, folder, "orders"))


MANIFEST_SQL = """(
  SELECT o_orderkey AS sighting_id, o_custkey AS individual_id,
         'blobs/' || CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) || '.jpg' AS asset_ref,
         'https://img.example/' || CAST(o_orderkey AS VARCHAR) AS source_url,
         CASE WHEN o_orderstatus = 'F' THEN 'ok' WHEN o_orderstatus = 'O' THEN 'found' ELSE '404' END AS status
  FROM orders)"""


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    text = MANIFEST_SQL.replace("VARCHAR", "STRING").replace("FROM orders", "FROM {orders}")
    return spark.sql(f"SELECT * FROM {text}", orders=table(spark, folder, "orders"))


# customers as the hub; half of them carry their own dates
INDIVIDUALS_SQL = """(
  SELECT c_custkey AS individual_id, c_name AS name,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Machine ' || CAST(c_custkey AS VARCHAR) END AS common_name,
         CASE WHEN c_custkey % 2 = 0 THEN DATE '1990-01-01' END AS first_seen,
         CASE WHEN c_custkey % 2 = 0 THEN DATE '2005-12-31' END AS last_seen
  FROM customer)"""


def individuals(spark: SparkSession, folder: str) -> DataFrame:
    text = INDIVIDUALS_SQL.replace("VARCHAR", "STRING").replace("FROM customer", "FROM {customer}")
    return spark.sql(f"SELECT * FROM {text}", customer=table(spark, folder, "customer"))


IMAGES_SQL = "(SELECT vec_id AS image_id, label AS individual_id, embedding FROM embeddings)"


def images(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        F.col("label").alias("individual_id"),
        "embedding",
    )


# catalog cards of the images: where they come from and their thumbnails (some have none)
CARDS_SQL = """(
  SELECT vec_id AS image_id, 'catalog-' || CAST(label % 3 AS VARCHAR) AS catalog,
         CASE WHEN vec_id % 5 <> 0 THEN 'thumbs/' || CAST(vec_id AS VARCHAR) || '.jpg' END AS thumb_ref
  FROM embeddings WHERE vec_id % 7 <> 0)"""


def cards(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").where("vec_id % 7 <> 0")
    return rows.select(
        F.col("vec_id").alias("image_id"),
        F.concat(F.lit("catalog-"), (F.col("label") % 3).cast("string")).alias("catalog"),
        F.when(F.col("vec_id") % 5 != 0, F.concat(F.lit("thumbs/"), F.col("vec_id").cast("string"), F.lit(".jpg"))).alias("thumb_ref"),
    )


def image_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored vector as a query that must not find itself."""
    return images(spark, folder).select(
        F.col("image_id").alias("query_id"),
        F.col("image_id").alias("hide_id"),
        F.col("individual_id").alias("true_id"),
        "embedding",
    )


# events as enriched encounters: depth, temperature and zones inside a JSON text
HABITAT_SQL = """(
  SELECT user_id AS individual_id,
         CAST(-10 * CAST(json_extract_string(props, '$.k') AS INT) AS DOUBLE) AS depth,
         value AS sst, event_type AS lme,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) > 80 THEN 'area ' || event_type END AS wdpa
  FROM events)"""


def staging(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    oceano = F.to_json(
        F.struct(
            F.struct((k * -10).cast("string").alias("ETOPO1")).alias("BATH"),
            F.struct(F.struct(F.col("value").alias("DAY")).alias("OISST")).alias("SST"),
            F.struct(
                F.array(F.struct(F.col("event_type").alias("LME_NAME"))).alias("LME"),
                F.array(
                    F.struct(F.when(k > 80, F.concat(F.lit("area "), "event_type")).alias("NAME"))
                ).alias("WDPA"),
            ).alias("ZONE"),
        )
    )
    return table(spark, folder, "events").select(
        "user_id", F.col("event_id").cast("string").alias("row_id"), oceano.alias("oceano")
    )


# line items as traffic cells on one grid: upper left corner and cell edge in metres
GRID = (-14500000.0, 6300000.0, 10000.0)
CELLS_SQL = """(
  SELECT CAST(year(l_shipdate) AS INT) AS year, l_partkey % 256 AS col, l_suppkey % 181 AS row,
         count(*) AS value
  FROM lineitem GROUP BY ALL)"""
TILE = 16  # cells along a tile
TILE_EDGES = (1, 4, 16)  # the grid is 16 tiles wide
TILES_SQL = f"(SELECT DISTINCT year, col // {TILE} AS tx, row // {TILE} AS ty FROM {CELLS_SQL})"


def cells(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(
        F.year("l_shipdate").alias("year"),
        (F.col("l_partkey") % 256).alias("col"),
        (F.col("l_suppkey") % 181).alias("row"),
    )
    return rows.groupBy("year", "col", "row").agg(F.count(F.lit(1)).alias("value"))


def tiles(spark: SparkSession, folder: str, size: int = TILE) -> DataFrame:
    """The cells packed into square tiles of ``size`` (at most size * size values each)."""
    x0, y0, scale = GRID
    at = (F.col("row") % size * size + F.col("col") % size).cast("int")
    placed = merge_cells(cells(spark, folder)).select(
        "year",
        F.floor(F.col("col") / size).alias("tx"),
        F.floor(F.col("row") / size).alias("ty"),
        at.alias("at"),
        F.col("value").cast("int").alias("value"),
    )
    tile = ["year", "tx", "ty"]
    calm = placed.select(*tile).distinct().select(
        *tile, F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("at"), F.lit(0).alias("value")
    )
    pixels = placed.unionByName(calm).groupBy(*tile, "at").agg(F.max("value").alias("value"))
    listed = F.sort_array(F.collect_list(F.struct("at", "value")))
    packed = pixels.groupBy(*tile).agg(F.transform(listed, lambda p: p["value"]).alias("pixels"))
    return packed.select(
        "year",
        (F.col("ty") * 1000 + F.col("tx")).cast("int").alias("rid"),
        (F.lit(x0) + F.col("tx") * size * scale).alias("ulx"),
        (F.lit(y0) - F.col("ty") * size * scale).alias("uly"),
        F.lit(scale).alias("scale"),
        F.lit(size).alias("width"),
        F.lit(size).alias("height"),
        "pixels",
        F.lit(3857).alias("srid"),
    )


# protected zones as slanted rings (name, part, corners); one zone has two parts, one is not convex
ZONE_RINGS = (
    ("Bank", 1, ((-124.2, 38.0), (-123.5, 38.6), (-122.9, 38.0), (-123.5, 37.3))),
    ("Bay", 1, ((-123.1, 37.6), (-121.5, 36.9), (-122.6, 36.6), (-121.4, 35.5), (-122.9, 35.9))),
    ("Channel", 1, ((-120.6, 33.8), (-119.9, 33.8), (-120.1, 34.35))),
    ("Channel", 2, ((-119.6, 33.2), (-118.9, 33.3), (-119.0, 33.8), (-119.5, 33.7))),
    ("Olympic", 1, ((-126.0, 47.0), (-124.4, 47.4), (-124.4, 48.6), (-125.6, 48.3))),
)
ZONE_EDGES_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {p}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)"
    for n, p, ring in ZONE_RINGS
    for a, b in zip(ring, (*ring[1:], ring[0]))
) + ") AS z(name, part_id, x1, y1, x2, y2))"


def zone_hits_sql(boxes_sql: str) -> str:
    """Boxes and the zone parts that they meet, edge by edge."""
    side = lambda x, y: f"(x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1)"
    sides = ", ".join(side(x, y) for x in ("lon_min", "lon_max") for y in ("lat_min", "lat_max"))
    return f"""(
      SELECT request_id, name FROM (
        SELECT request_id, name, part_id,
               bool_or(least(x1, x2) <= lon_max AND greatest(x1, x2) >= lon_min AND least(y1, y2) <= lat_max
                       AND greatest(y1, y2) >= lat_min AND least({sides}) <= 0 AND greatest({sides}) >= 0) AS touched,
               count(*) FILTER ((y1 > lat_min) <> (y2 > lat_min)
                                AND lon_min < x1 + (lat_min - y1) * (x2 - x1) / (y2 - y1)) % 2 = 1 AS inside
        FROM {boxes_sql} CROSS JOIN {ZONE_EDGES_SQL} GROUP BY ALL) WHERE touched OR inside)"""


def zones(spark: SparkSession) -> DataFrame:
    rows = [(n, p, [{"x": x, "y": y} for x, y in ring]) for n, p, ring in ZONE_RINGS]
    return zone_rings(
        spark.createDataFrame(rows, "name string, part_id int, ring array<struct<x:double,y:double>>")
    )


# named regions as boxes (ours), and which feeding region goes with which breeding region
REGION_ROWS = (
    ("CA", 32.0, 39.99, -127.0, -117.0),
    ("MX", 32.0, 33.0, -117.0, -115.0),
    ("PNW", 40.0, 49.0, -128.0, -120.0),
    ("SE-AK", 46.0, 49.0, -130.0, -128.0),
)
REGIONS_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for n, a, b, c, d in REGION_ROWS
) + ") AS r(region, lat_min, lat_max, lon_min, lon_max))"
REGION_LINKS = (("CA", "MX"), ("PNW", "MX"), ("SE-AK", "HI"))


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(REGION_ROWS), "region string, lat_min double, lat_max double, lon_min double, lon_max double"
    )


# conversations as a message log with tool rows: every second assistant turn calls a tool,
# and the turn after it is the result
MESSAGES_SQL = """(
  SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS msg_id,
         CASE WHEN turn % 4 = 2 THEN 'tool' ELSE role END AS role, text AS content,
         CASE WHEN turn % 4 = 1 AND role = 'assistant'
              THEN 'call-' || CAST(turn AS VARCHAR) END AS call_id,
         CASE WHEN turn % 4 = 2 THEN 'call-' || CAST(turn - 1 AS VARCHAR) END AS tool_call_id
  FROM conversations)"""
TOKENS_SQL = "CAST(ceil((length(content) + length(role)) / CAST(4 AS DOUBLE)) + 3 AS BIGINT)"
PROSE_SQL = "(role <> 'tool' AND call_id IS NULL)"


def messages(spark: SparkSession, folder: str) -> DataFrame:
    text = MESSAGES_SQL.replace("VARCHAR", "STRING").replace("FROM conv", "FROM {conv}")
    text = text.replace("{conv}ersations", "{conversations}")
    rows = spark.sql(f"SELECT * FROM {text}", conversations=table(spark, folder, "conversations"))
    call = F.struct(
        F.col("call_id").alias("id"),
        F.concat(F.lit("tool_"), F.col("turn").cast("string")).alias("name"),
        F.to_json(F.struct(F.col("turn").alias("turn"))).alias("args"),
    )
    calls = F.when(F.col("call_id").isNotNull(), F.array(call))
    return rows.withColumn("tool_calls", calls).drop("call_id")


def plain_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as they are: no tool rows."""
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.concat_ws("-", "conv_id", "turn").alias("msg_id"),
        "role",
        F.col("text").alias("content"),
    )


def rounded(column: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def cited(citations: str) -> Column:
    """What a row cites, as one text: kind, source, locator and reference of each, in order."""
    one = lambda c: F.concat_ws("|", c["kind"], c["source"], c["locator"], c["ref"])
    return F.array_join(F.transform(citations, one), ";")
