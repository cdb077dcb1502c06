"""History, range, region and habitat queries on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import habitat as H
from tidewater.plans import bindings as B
from tidewater.plans.registry import query
from tidewater.plans.similarity_queries import LABELLED_SQL, labelled_sightings

TAIL = (1.0 - H.CORE_PCT) / 2.0
LOCATED_SQL = f"(SELECT * FROM {B.SIGHTINGS_SQL} WHERE lat IS NOT NULL AND lon IS NOT NULL)"


def _core(axis: str) -> str:
    pick = lambda share: (
        f"list_sort(list({axis}))[CAST(least(count(*) - 1, floor({share!r}::DOUBLE * count(*))) AS BIGINT) + 1]"
    )
    return f"{pick(TAIL)} AS {axis}_min, {pick(1.0 - TAIL)} AS {axis}_max"


CORE_SQL = f"""(
  SELECT individual_id, count(*) AS n_sightings, {_core('lat')}, {_core('lon')}
  FROM {LOCATED_SQL} GROUP BY individual_id)"""


@query(
    "sighting_history",
    f"""SELECT individual_id, sighting_id, obs_date, lat, lon, species, provider,
               row_number() OVER (PARTITION BY individual_id ORDER BY obs_date NULLS LAST, sighting_id) AS seq
        FROM {LOCATED_SQL}""",
)
def _(spark, d):
    return H.sighting_history(B.sightings(spark, d)).select(
        "individual_id", "sighting_id", "obs_date", "lat", "lon", "species", "provider", "seq"
    )


@query("core_bbox", f"SELECT * FROM {CORE_SQL}")
def _(spark, d):
    return H.core_bbox(B.sightings(spark, d))


@query(
    "full_extent",
    f"""SELECT individual_id, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max
        FROM {LOCATED_SQL} GROUP BY 1""",
)
def _(spark, d):
    return H.full_extent(B.sightings(spark, d))


@query(
    "bbox_outliers",
    f"""SELECT individual_id, count(*) AS n_sightings,
               count(*) FILTER (NOT (lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max)) AS n_outside
        FROM {LOCATED_SQL} JOIN (SELECT * EXCLUDE (n_sightings) FROM {CORE_SQL}) USING (individual_id) GROUP BY 1""",
)
def _(spark, d):
    s = B.sightings(spark, d)
    return H.bbox_outliers(s, H.core_bbox(s))


@query(
    "seen_span",
    f"""SELECT individual_id, coalesce(max(i.first_seen), min(obs_date)) AS first_seen,
               coalesce(max(i.last_seen), max(obs_date)) AS last_seen
        FROM {LOCATED_SQL} LEFT JOIN {B.INDIVIDUALS_SQL} i USING (individual_id) GROUP BY 1""",
)
def _(spark, d):
    return H.seen_span(B.individuals(spark, d), B.sightings(spark, d))


@query(
    "sighting_lookup",
    f"""WITH b AS (SELECT * FROM {CORE_SQL}),
        o AS (SELECT individual_id, count(*) FILTER (NOT (lat BETWEEN lat_min AND lat_max
                     AND lon BETWEEN lon_min AND lon_max)) AS n_outside
              FROM {LOCATED_SQL} JOIN b USING (individual_id) GROUP BY 1),
        s AS (SELECT individual_id, coalesce(max(i.first_seen), min(obs_date)) AS first_seen,
                     coalesce(max(i.last_seen), max(obs_date)) AS last_seen
              FROM {LOCATED_SQL} LEFT JOIN {B.INDIVIDUALS_SQL} i USING (individual_id) GROUP BY 1),
        c AS (SELECT individual_id, string_agg('sighting|' || provider || '|' || thumb_url || '|' || CAST(individual_id AS VARCHAR), ';'
                                               ORDER BY r) AS cited
              FROM (SELECT *, row_number() OVER (PARTITION BY individual_id ORDER BY obs_date NULLS LAST, sighting_id) AS r
                    FROM {LOCATED_SQL}) WHERE r <= 10 GROUP BY 1)
        SELECT i.individual_id, b.individual_id IS NOT NULL AS ok,
               CASE WHEN b.individual_id IS NULL THEN 'No sightings for this individual'
                    ELSE CAST(n_sightings AS VARCHAR) || ' sightings of ' || coalesce(i.common_name, i.name)
                      || ' (' || CAST(s.first_seen AS VARCHAR) || '–' || CAST(s.last_seen AS VARCHAR)
                      || '); core range (central 90%) lat ' || printf('%.2f–%.2f', lat_min, lat_max)
                      || ', lon ' || printf('%.2f–%.2f', lon_min, lon_max)
                      || CASE WHEN n_outside > 0 THEN '; ' || CAST(n_outside AS VARCHAR)
                              || ' outlying sightings trimmed from range' ELSE '' END END AS summary,
               coalesce(cited, '') AS cited
        FROM {B.INDIVIDUALS_SQL} i LEFT JOIN b USING (individual_id) LEFT JOIN o USING (individual_id)
        LEFT JOIN s USING (individual_id) LEFT JOIN c USING (individual_id)""",
)
def _(spark, d):
    people = B.individuals(spark, d)
    out = H.sighting_lookup(people.select("individual_id"), B.sightings(spark, d), people)
    return out.select(
        "individual_id", "ok", "summary", B.cited("citations").alias("cited")
    )


@query("region_label", f"SELECT sighting_id, region FROM {LABELLED_SQL}")
def _(spark, d):
    return labelled_sightings(spark, d).select("sighting_id", "region")


@query(
    "region_profile",
    f"""WITH l AS (SELECT individual_id, coalesce(region, 'other') AS region FROM {LABELLED_SQL}),
        s AS (SELECT individual_id, count(DISTINCT region) AS k FROM l GROUP BY 1),
        p AS (SELECT region, individual_id, count(*) AS n FROM l GROUP BY ALL)
        SELECT region, CAST(sum(n) AS BIGINT) AS n_sightings, count(*) AS n_individuals,
               round(avg(CASE WHEN k = 1 THEN 1 ELSE 0 END), 6) AS single_region_share,
               round(sum(n) / (SELECT count(*) FROM l), 6) AS share
        FROM p JOIN s USING (individual_id) GROUP BY region""",
)
def _(spark, d):
    out = H.region_profile(labelled_sightings(spark, d))
    return out.withColumns({c: B.rounded(c) for c in ("single_region_share", "share")})


@query(
    "density_grid",
    f"""SELECT CAST(floor(lat) AS INT) AS lat_cell, CAST(floor(lon) AS INT) AS lon_cell,
               CAST(month(obs_date) AS INT) AS month, count(*) AS n,
               round(count(*) / sum(count(*)) OVER (PARTITION BY floor(lat), floor(lon)), 6) AS month_share
        FROM {LOCATED_SQL} WHERE obs_date IS NOT NULL GROUP BY floor(lat), floor(lon), month(obs_date)""",
)
def _(spark, d):
    return H.density_grid(B.sightings(spark, d)).withColumn("month_share", B.rounded("month_share"))


@query(
    "context_join",
    """SELECT o_custkey AS individual_id, o_orderkey AS sighting_id, event_id
       FROM orders JOIN (SELECT DISTINCT event_id FROM events) ON event_id = o_orderkey""",
)
def _(spark, d):
    """Sightings met with their enrichment row by the text id; repeated rows count once."""
    env = H.environment(B.staging(spark, d))
    doubled = env.unionByName(env)
    joined = H.context_join(B.sightings(spark, d), doubled)
    return joined.select(
        "individual_id", "sighting_id", F.col("source_row_id").cast("long").alias("event_id")
    )


def habitat_rows(spark, d):
    return H.environment(B.staging(spark, d).withColumnRenamed("user_id", "individual_id"))


HABITAT_STATS_SQL = f"""(
  SELECT individual_id, count(*) AS n, min(depth) AS depth_min, max(depth) AS depth_max,
         round(avg(CASE WHEN depth > -200 THEN 1 ELSE 0 END), 6) AS shelf_fraction,
         min(sst) AS sst_min, max(sst) AS sst_max,
         array_to_string(list_sort(list(DISTINCT lme)), '|') AS regions,
         coalesce(array_to_string(list_sort(list(DISTINCT wdpa) FILTER (wdpa IS NOT NULL)), '|'), '') AS sanctuaries,
         round(quantile_cont(depth, 0.5), 6) AS depth_median, round(quantile_cont(sst, 0.5), 6) AS sst_median
  FROM {B.HABITAT_SQL} GROUP BY individual_id)"""


@query("habitat_context", f"SELECT * FROM {HABITAT_STATS_SQL}")
def _(spark, d):
    out = H.habitat_context(habitat_rows(spark, d))
    return out.withColumns(
        {
            "shelf_fraction": B.rounded("shelf_fraction"),
            "depth_median": B.rounded("depth_median"),
            "sst_median": B.rounded("sst_median"),
            "regions": F.array_join("regions", "|"),
            "sanctuaries": F.array_join("sanctuaries", "|"),
        }
    )


@query(
    "habitat_answers",
    f"""SELECT i.individual_id, h.individual_id IS NOT NULL AS ok,
               CASE WHEN h.individual_id IS NULL THEN 'No oceano context for this individual'
               ELSE CAST(n AS VARCHAR) || ' sightings; median depth ' || printf('%.0f', round(depth_median)) || ' m ('
                 || printf('%.0f', round(shelf_fraction * 100)) || '% over continental shelf); SST ~'
                 || printf('%.1f', round(sst_median, 1)) || '°C; regions: ' || replace(regions, '|', ', ')
                 || CASE WHEN sanctuaries <> '' THEN '; sanctuaries: ' || replace(sanctuaries, '|', ', ') ELSE '' END
               END AS summary,
               CASE WHEN h.individual_id IS NULL THEN '' ELSE 'sighting|encounter enrichment|' || CAST(i.individual_id AS VARCHAR) END AS cited
        FROM {B.INDIVIDUALS_SQL} i LEFT JOIN {HABITAT_STATS_SQL} h USING (individual_id)""",
)
def _(spark, d):
    """Contract rows of every individual."""
    answers = H.habitat_answers(
        B.individuals(spark, d).select("individual_id"), H.habitat_context(habitat_rows(spark, d))
    )
    return answers.select("individual_id", "ok", "summary", B.cited("citations").alias("cited"))


@query(
    "habitat_extra",
    """SELECT event_type AS region, count(*) AS n, 1.0::DOUBLE AS sst_share, round(avg(value), 6) AS sst_mean,
              0.0::DOUBLE AS salinity_share, NULL::DOUBLE AS salinity_mean
       FROM events GROUP BY 1""",
)
def _(spark, d):
    rows = B.staging(spark, d).withColumn(
        "region", F.get_json_object("oceano", "$.ZONE.LME[0].LME_NAME")
    )
    paths = {"sst": "$.SST.OISST.DAY", "salinity": "$.SALINITY.HYCOM.DAY"}
    out = H.habitat_extra(rows, "region", paths)
    return out.withColumn("sst_mean", B.rounded("sst_mean"))
