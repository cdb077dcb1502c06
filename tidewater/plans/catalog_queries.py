"""Catalog, write rules, joins and scalar functions on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.contract import answer_all, citation
from tidewater.functions.geo import mercator_x, mercator_y
from tidewater.functions.hashing import hash_bucket
from tidewater.functions.text import is_url, path_suffix_match
from tidewater.functions.vectors import is_unit, l2_normalize, norm, parse_vector
from tidewater.operators import catalog as C
from tidewater.operators import splits
from tidewater.operators.conversation import map_merge
from tidewater.operators.ingest import download_reconcile, pending
from tidewater.plans import bindings as B
from tidewater.plans.registry import query
from tidewater.session import scratch_path
from tidewater.sources import scans, schemas, sinks
from tidewater.sources.scans import table


@query(
    "license_allow",
    f"""SELECT sighting_id, license FROM {B.SIGHTINGS_SQL}
        WHERE individual_id IS NOT NULL
          AND (license LIKE '%creativecommons%' OR license LIKE '%publicdomain%')""",
)
def _(spark, d):
    s = B.sightings(spark, d)
    keep = F.col("individual_id").isNotNull() & C.license_allowed(F.col("license"))
    return s.where(keep).select("sighting_id", "license")


@query(
    "license_deny",
    f"""SELECT m.sighting_id, s.license FROM {B.MANIFEST_SQL} m JOIN {B.SIGHTINGS_SQL} s USING (sighting_id)
        WHERE m.status = 'ok' AND s.license NOT LIKE '%-nd/%'""",
)
def _(spark, d):
    rows = B.manifest(spark, d).where("status = 'ok'").join(
        B.sightings(spark, d).select("sighting_id", "license"), "sighting_id"
    )
    return rows.where(C.license_not_denied(F.col("license"))).select("sighting_id", "license")


CLEAN_SQL = f"""(
  SELECT CAST(regexp_extract(organism_id, '(\\d+)$', 1) AS BIGINT) AS individual_id,
         CAST('0x' || left(md5(row_id), 15) AS BIGINT) AS sighting_id, organism_id AS individual_url,
         scientific_name AS species, CAST(nullif(date_time, '') AS DATE) AS obs_date,
         latitude AS lat, longitude AS lon, license, row_id AS source_row_id, group_size,
         external_resource AS image_url, external_resource_thumb AS thumb_url, rights_holder, provider
  FROM {B.ENCOUNTERS_SQL})"""
LICENSED_SQL = f"""(
  SELECT * FROM {CLEAN_SQL} WHERE individual_id IS NOT NULL AND license LIKE '%creativecommons%')"""


@query("clean_encounters", f"SELECT * FROM {CLEAN_SQL}")
def _(spark, d):
    return C.clean_encounters(B.encounters(spark, d))


@query("catalog_sightings", f"SELECT * FROM {LICENSED_SQL}")
def _(spark, d):
    return C.build_sightings(B.encounters(spark, d))


@query(
    "catalog_individuals",
    f"""WITH c AS (SELECT individual_id, species, count(*) AS n FROM {LICENSED_SQL} GROUP BY ALL),
        m AS (SELECT individual_id, first(species ORDER BY n DESC, species) AS species FROM c GROUP BY ALL),
        a AS (SELECT individual_id, count(*) AS n_sightings, min(obs_date) AS first_seen, max(obs_date) AS last_seen,
                     min(individual_url) AS individual_url FROM {LICENSED_SQL} GROUP BY ALL)
        SELECT a.individual_id, species, n_sightings, first_seen, last_seen, individual_url
        FROM a JOIN m USING (individual_id)""",
)
def _(spark, d):
    return C.build_individuals(C.build_sightings(B.encounters(spark, d)))


@query(
    "vector_literals",
    """SELECT vec_id, len(embedding) AS width, embedding[1]::DOUBLE AS first_value,
              embedding[len(embedding)]::DOUBLE AS last_value FROM embeddings""",
)
def _(spark, d):
    """Vectors written as text literals and read back."""
    text = F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<string>"), ","), F.lit("]"))
    read = table(spark, d, "embeddings").select("vec_id", parse_vector(text).alias("v"))
    return read.select(
        "vec_id", F.size("v").alias("width"), F.element_at("v", 1).cast("double").alias("first_value"),
        F.element_at("v", -1).cast("double").alias("last_value"),
    )


@query(
    "url_or_path",
    r"""SELECT page_id, regexp_matches(url, '^https?://') AS is_url,
               regexp_matches(regexp_replace(url, '^https', 'ftp'), '^https?://') AS other_is_url FROM pages""",
)
def _(spark, d):
    other = F.regexp_replace("url", "^https", "ftp")
    return table(spark, d, "pages").select(
        "page_id", is_url(F.col("url")).alias("is_url"), is_url(other).alias("other_is_url")
    )


@query(
    "build_catalog",
    f"""SELECT count(*) AS raw_rows,
          count(*) FILTER (individual_id IS NOT NULL AND license LIKE '%creativecommons%') AS sightings,
          count(*) FILTER (individual_id IS NULL) AS no_individual,
          count(*) FILTER (individual_id IS NOT NULL AND license IS NULL) AS no_license,
          count(*) FILTER (individual_id IS NOT NULL AND license NOT LIKE '%creativecommons%') AS closed_license,
          count(DISTINCT individual_id) FILTER (license LIKE '%creativecommons%') AS individuals
        FROM {CLEAN_SQL}""",
)
def _(spark, d):
    return C.build_catalog_report(B.encounters(spark, d))


@query(
    "hub_derive",
    f"""WITH c AS (SELECT individual_id, species, count(*) AS n FROM {LICENSED_SQL} GROUP BY ALL),
        m AS (SELECT individual_id, first(species ORDER BY n DESC, species) AS species FROM c GROUP BY ALL),
        a AS (SELECT individual_id, count(*) AS n_sightings, min(obs_date) AS first_seen,
                     max(obs_date) AS last_seen FROM {LICENSED_SQL} GROUP BY ALL)
        SELECT a.individual_id, species, n_sightings, first_seen, last_seen FROM a JOIN m USING (individual_id)""",
)
def _(spark, d):
    return C.hub_derive(C.build_sightings(B.encounters(spark, d)))


@query(
    "orphan_check",
    """SELECT count(*) AS n_rows,
              CAST(sum(CASE WHEN c_custkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_orphans
       FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""",
)
def _(spark, d):
    parents = B.individuals(spark, d).join(
        table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("individual_id")),
        "individual_id",
        "left_semi",
    )
    return C.orphan_check(B.sightings(spark, d), parents, "individual_id")


@query(
    "upsert_latest",
    """SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY
                  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, o_orderkey DESC) AS rn FROM orders)
       WHERE rn = 1""",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return sinks.upsert_latest(
        rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus <> 'F'"), ["o_custkey"], "o_orderkey"
    )


@query(
    "insert_if_absent",
    """WITH n AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders
                  WHERE o_orderstatus <> 'F' GROUP BY ALL)
       SELECT * FROM n WHERE NOT EXISTS (
         SELECT 1 FROM orders e WHERE e.o_orderstatus = 'F' AND e.o_custkey = n.o_custkey
                                  AND e.o_orderpriority = n.o_orderpriority)""",
)
def _(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")
    return sinks.insert_if_absent(
        rows.where("o_orderstatus = 'F'"),
        rows.where("o_orderstatus <> 'F'"),
        ["o_custkey", "o_orderpriority"],
        [F.col("o_orderkey")],
    ).select("o_custkey", "o_orderpriority", "o_orderkey")


@query(
    "conditional_update",
    f"""SELECT m.sighting_id,
               CASE WHEN m.status = 'ok' AND f.k IS NOT NULL THEN 'corrupt' ELSE m.status END AS status,
               (m.status = 'ok' AND f.k IS NOT NULL) AS changed
        FROM {B.MANIFEST_SQL} m
        LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 49) f ON f.k = m.sighting_id""",
)
def _(spark, d):
    flagged = table(spark, d, "lineitem").where("l_quantity > 49").select(
        F.col("l_orderkey").alias("sighting_id")
    )
    return sinks.conditional_update(
        B.manifest(spark, d), flagged, "sighting_id", "status", "ok", "corrupt"
    ).select("sighting_id", "status", "changed")


@query(
    "page_concat",
    """SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n_pages
       FROM conversations GROUP BY conv_id""",
)
def _(spark, d):
    return scans.page_concat(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query(
    "page_range_select",
    """SELECT c.conv_id AS doc_id, c.turn AS page_no FROM conversations c
       JOIN (SELECT conv_id, min(turn) AS a, max(turn) AS b FROM conversations
             WHERE role = 'assistant' GROUP BY conv_id) r
         ON r.conv_id = c.conv_id AND c.turn BETWEEN r.a AND r.b""",
)
def _(spark, d):
    pages = table(spark, d, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "role"
    )
    ranges = pages.where("role = 'assistant'").groupBy("doc_id").agg(
        F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page")
    )
    return scans.page_range_select(pages, ranges).select("doc_id", "page_no")


@query(
    "raster_tiles_to_cells",
    f"""SELECT year, col, row, CAST(value AS BIGINT) AS value,
               {B.GRID[0]} + (col + 0.5) * {B.GRID[2]} AS x, {B.GRID[1]} - (row + 0.5) * {B.GRID[2]} AS y
        FROM {B.CELLS_SQL}""".replace("0.5)", "0.5::DOUBLE)"),
)
def _(spark, d):
    x0, y0, scale = B.GRID
    return scans.raster_cells(B.tiles(spark, d)).select(
        "year",
        F.floor((F.col("x") - x0) / scale).alias("col"),
        F.floor((F.lit(y0) - F.col("y")) / scale).alias("row"),
        "value",
        "x",
        "y",
    )


@query(
    "raster_grid_check",
    f"""SELECT year, count(DISTINCT (col // 16, row // 16)) AS tiles, true AS srid_ok, true AS scale_ok,
               true AS size_ok, true AS pixels_ok, true AS aligned_ok
        FROM {B.CELLS_SQL} GROUP BY year""",
)
def _(spark, d):
    return scans.raster_grid_check(B.tiles(spark, d), size=16)


@query(
    "array_member_filter",
    """SELECT conv_id, array_to_string(list_sort(list(DISTINCT role)), '|') AS roles FROM conversations
       GROUP BY conv_id HAVING list_contains(list(DISTINCT role), 'system')""",
)
def _(spark, d):
    roles = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return roles.where(F.array_contains("roles", "system")).select(
        "conv_id", F.array_join(F.array_sort("roles"), "|").alias("roles")
    )


@query(
    "gallery_restrict",
    f"""SELECT sighting_id, individual_id FROM {B.SIGHTINGS_SQL}
        WHERE individual_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def _(spark, d):
    members = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("individual_id")
    )
    return B.sightings(spark, d).join(members, "individual_id", "left_semi").select(
        "sighting_id", "individual_id"
    )


@query(
    "filters_where",
    f"""SELECT sighting_id FROM {B.SIGHTINGS_SQL}
        WHERE species IN ('1-URGENT', '2-HIGH') AND lat BETWEEN 33 AND 45 AND lon BETWEEN -128 AND -118
          AND obs_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""",
)
def _(spark, d):
    s = B.sightings(spark, d)
    where = C.filters_where(
        available=s.columns,
        species=["1-URGENT", "2-HIGH"],
        region=(33.0, 45.0, -128.0, -118.0),
        date_range=("1996-01-01", "1999-12-31"),
        source=["F"],
    )
    return s.where(where).select("sighting_id")


@query(
    "split_label",
    """WITH c AS (SELECT o_custkey AS individual_id, count(*) AS n,
                         CAST('0x' || left(md5(CAST(o_custkey AS VARCHAR)), 6) AS BIGINT) % 100 AS b
                  FROM orders GROUP BY ALL)
       SELECT individual_id, CASE WHEN n < 4 THEN 'train' WHEN b >= 85 THEN 'test' WHEN b >= 70 THEN 'val'
                                  ELSE 'train' END AS split FROM c""",
)
def _(spark, d):
    per = splits.eligible(B.sightings(spark, d), 1)
    label = splits.split_label(F.col("n_photos"), hash_bucket(F.col("individual_id")))
    return per.select("individual_id", label.alias("split"))


@query(
    "hash_bucket",
    """SELECT o_orderkey AS id,
              CAST(CAST('0x' || left(md5(CAST(o_orderkey AS VARCHAR)), 6) AS BIGINT) % 100 AS INT) AS bucket
       FROM orders""",
)
def _(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), hash_bucket(F.col("o_orderkey")).alias("bucket")
    )


@query(
    "path_normalize",
    f"""SELECT sighting_id, '/data/img/' || regexp_replace(asset_ref, '^blobs/', '') AS path
        FROM {B.MANIFEST_SQL}""",
)
def _(spark, d):
    return B.manifest(spark, d).select(
        "sighting_id", scans.path_normalize(F.col("asset_ref"), "/data/img").alias("path")
    )


@query(
    "status_normalize",
    f"""SELECT sighting_id, CASE WHEN status IN ('ok', 'found', '200') THEN 'ok' ELSE 'failed' END AS status
        FROM {B.MANIFEST_SQL}""",
)
def _(spark, d):
    return B.manifest(spark, d).select(
        "sighting_id", C.status_normalize(F.col("status")).alias("status")
    )


@query(
    "result_contract",
    """SELECT c_custkey AS individual_id, n IS NOT NULL AS ok,
              coalesce(CAST(n AS VARCHAR) || ' sightings', 'No sightings') AS summary,
              CASE WHEN n IS NULL THEN '' ELSE 'count|orders|' || CAST(c_custkey AS VARCHAR) END AS cited, 'count' AS tool
       FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders
                                WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey""",
)
def _(spark, d):
    found = (
        B.sightings(spark, d)
        .where("provider = 'P'")
        .groupBy("individual_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "individual_id",
            F.format_string("%d sightings", "n").alias("summary"),
            F.array(
                citation("count", F.lit("orders"), F.lit(None), F.col("individual_id"))
            ).alias("citations"),
        )
    )
    out = answer_all(
        B.individuals(spark, d).select("individual_id"), found, "individual_id", "count", "No sightings"
    )
    return out.select("individual_id", "ok", "summary", B.cited("citations").alias("cited"), "tool")


@query(
    "manifest_join",
    f"""SELECT m.sighting_id, m.status, s.species, s.obs_date, s.license
        FROM {B.MANIFEST_SQL} m JOIN {B.SIGHTINGS_SQL} s USING (sighting_id)""",
)
def _(spark, d):
    return C.manifest_join(B.manifest(spark, d), B.sightings(spark, d)).select(
        "sighting_id", "status", "species", "obs_date", "license"
    )


@query(
    "hub_enrich",
    """SELECT l_orderkey AS sighting_id, l_linenumber, 'thumb/' || CAST(o_orderkey AS VARCHAR) || '.jpg' AS thumb_url,
              c_name AS name
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey
       LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""",
)
def _(spark, d):
    s = B.sightings(spark, d)
    # the image rows carry their individual, as the embedding table does
    img = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("sighting_id"), "l_linenumber"
    ).join(s.select("sighting_id", "individual_id"), "sighting_id")
    named = table(spark, d, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("individual_id"), F.col("c_name").alias("name")
    )
    return C.hub_enrich(img, s, named).select("sighting_id", "l_linenumber", "thumb_url", "name")


EXISTING_SQL = "(SELECT DISTINCT l_orderkey AS sighting_id FROM lineitem WHERE l_returnflag = 'R')"


def _existing(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("sighting_id"), F.lit("v1").alias("embedder_ver")
    )


@query(
    "pending_anti",
    f"""SELECT sighting_id, asset_ref FROM {B.MANIFEST_SQL} JOIN {B.SIGHTINGS_SQL} s USING (sighting_id)
        WHERE status = 'ok' AND s.license NOT LIKE '%-nd/%'
          AND sighting_id NOT IN (SELECT sighting_id FROM {EXISTING_SQL})""",
)
def _(spark, d):
    return pending(B.manifest(spark, d), B.sightings(spark, d), _existing(spark, d), "v1").select(
        "sighting_id", "asset_ref"
    )


@query(
    "split_semi",
    f"""WITH c AS (SELECT o_custkey AS individual_id, count(*) AS n,
                          CAST('0x' || left(md5(CAST(o_custkey AS VARCHAR)), 6) AS BIGINT) % 100 AS b
                   FROM orders GROUP BY ALL)
        SELECT sighting_id, individual_id FROM {B.SIGHTINGS_SQL}
        WHERE individual_id IN (SELECT individual_id FROM c WHERE n >= 4 AND b >= 70 AND b < 85)""",
)
def _(spark, d):
    s = B.sightings(spark, d)
    return splits.gallery_of(s, splits.reid_split(s), "val").select("sighting_id", "individual_id")


@query(
    "download_reconcile",
    """SELECT o_custkey AS individual_id, o_orderkey AS sighting_id,
              '/data/' || CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) || '.jpg' AS asset_ref,
              CASE WHEN o_orderstatus = 'F' THEN 'found' ELSE 'to_fetch' END AS status
       FROM orders""",
)
def _(spark, d):
    m = B.manifest(spark, d)
    tasks = m.select("individual_id", "sighting_id", F.col("source_url").alias("url"))
    listing = m.where("status = 'ok'").select(
        scans.path_normalize(F.col("asset_ref"), "/data").alias("asset_ref"), F.lit(10).alias("n_bytes")
    )
    return download_reconcile(tasks, listing, "/data").drop("url")


@query(
    "version_census",
    """WITH v AS (SELECT 'v1' AS embedder_ver FROM orders WHERE o_orderstatus <> 'P'
                  UNION ALL SELECT 'v2' FROM orders WHERE o_orderstatus = 'F')
       SELECT embedder_ver, count(*) AS n_rows,
              round(count(*) / (SELECT count(*) FROM orders), 6) AS coverage FROM v GROUP BY embedder_ver""",
)
def _(spark, d):
    m = B.manifest(spark, d)
    v1 = m.where("status <> '404'").select("sighting_id", F.lit("v1").alias("embedder_ver"))
    v2 = m.where("status = 'ok'").select("sighting_id", F.lit("v2").alias("embedder_ver"))
    out = C.version_census(v1.unionByName(v2), m)
    return out.withColumn("coverage", B.rounded("coverage"))


@query(
    "singleton_tail",
    """SELECT count(*) AS individuals, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS seen_once,
              round(avg(n), 6) AS mean_sightings, max(n) AS most_sightings
       FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""",
)
def _(spark, d):
    return C.singleton_tail(B.sightings(spark, d)).withColumn(
        "mean_sightings", B.rounded("mean_sightings")
    )


@query(
    "eligible_having",
    """SELECT o_custkey AS individual_id, count(*) AS n_photos FROM orders GROUP BY 1 HAVING count(*) >= 10""",
)
def _(spark, d):
    return splits.eligible(B.sightings(spark, d), 10)


FACTS_SQL = """(
  SELECT o_orderpriority AS species, count(*) AS abundance, round(avg(o_totalprice), 2) AS pbr
  FROM orders GROUP BY 1)"""


def _facts(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("species")).agg(
        F.count(F.lit(1)).alias("abundance"), F.round(F.avg("o_totalprice"), 2).alias("pbr")
    )


@query(
    "stock_facts",
    f"""SELECT sighting_id, species, abundance, pbr FROM {B.SIGHTINGS_SQL}
        LEFT JOIN (SELECT * FROM {FACTS_SQL} WHERE species <> '5-LOW') USING (species)""",
)
def _(spark, d):
    s = B.sightings(spark, d).select("sighting_id", "species")
    return C.stock_facts(s, _facts(spark, d).where("species <> '5-LOW'"))


@query(
    "year_union",
    """SELECT CAST(year(l_shipdate) AS INT) AS year, count(*) AS n, round(sum(l_quantity), 2) AS quantity
       FROM lineitem GROUP BY 1""",
)
def _(spark, d):
    path = scratch_path(spark, "years")
    rows = table(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), "l_quantity")
    rows.write.partitionBy("year").parquet(path)
    return scans.year_union(spark, path).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query(
    "map_merge",
    """WITH m AS (SELECT conv_id, CAST(turn AS VARCHAR) AS k, 'new-' || role AS v FROM conversations WHERE turn >= 2
                  UNION ALL
                  SELECT conv_id, CAST(turn AS VARCHAR), 'old-' || role FROM conversations WHERE turn < 2
                  UNION ALL
                  SELECT conv_id, CAST(max(turn) + 1 AS VARCHAR), 'old-end' FROM conversations GROUP BY conv_id)
       SELECT conv_id, string_agg(k || '=' || v, '|' ORDER BY k) AS merged FROM m GROUP BY conv_id""",
)
def _(spark, d):
    rows = table(spark, d, "conversations").select(
        "conv_id", "turn", F.col("turn").cast("string").alias("k"), "role"
    )
    pairs = lambda tag, cond: F.map_from_entries(
        F.collect_list(F.when(cond, F.struct("k", F.concat(F.lit(tag), "role"))))
    )
    per = rows.groupBy("conv_id").agg(
        pairs("old-", F.lit(True)).alias("old"),
        pairs("new-", F.col("turn") >= 2).alias("new"),
        (F.max("turn") + 1).cast("string").alias("next"),
    )
    existing = F.map_concat("old", F.create_map("next", F.lit("old-end")))
    entries = F.array_sort(F.map_entries(map_merge(existing, F.col("new"))))
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    return per.select("conv_id", text.alias("merged"))


@query(
    "json_paths",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k,
              json_extract_string(props, '$.none') AS missing FROM events""",
)
def _(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
        F.get_json_object("props", "$.none").alias("missing"),
    )


@query(
    "web_mercator",
    f"""SELECT sighting_id, round(6378137 * radians(lon), 3) AS x,
               round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y
        FROM {B.SIGHTINGS_SQL} WHERE lat IS NOT NULL""",
)
def _(spark, d):
    return B.sightings(spark, d).where("lat is not null").select(
        "sighting_id",
        B.rounded(mercator_x(F.col("lon")), 3).alias("x"),
        B.rounded(mercator_y(F.col("lat")), 3).alias("y"),
    )


@query(
    "vector_health",
    """SELECT vec_id, len(embedding) AS width,
              round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm,
              abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) <= 1e-3 AS unit,
              true AS unit_after
       FROM embeddings""",
)
def _(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id",
        F.size(e).cast("long").alias("width"),
        B.rounded(norm(e)).alias("norm"),
        is_unit(e).alias("unit"),
        is_unit(l2_normalize(e)).alias("unit_after"),
    )


@query(
    "span_match",
    """SELECT page_id, regexp_matches(url, '(^|/)example\\.com/en/[0-9]+$') AS plain,
              list_slice(list_filter(string_split(url, '/'), lambda s: len(s) > 0), -2, -1)
                = ['en', regexp_extract(url, '([^/]+)$', 1)] AS english
       FROM pages""",
)
def _(spark, d):
    tail = F.concat(F.lit("en/"), F.regexp_extract("url", "([^/]+)$", 1))
    number = F.regexp_extract("url", "([0-9]+)$", 1)
    site = F.concat(F.lit("example.com/en/"), number)
    return table(spark, d, "pages").select(
        "page_id",
        ((F.length(number) > 0) & path_suffix_match(F.col("url"), site)).alias("plain"),
        path_suffix_match(F.col("url"), tail).alias("english"),
    )


@query("manifest_csv", f"SELECT sighting_id, individual_id, asset_ref, source_url, status FROM {B.MANIFEST_SQL}")
def _(spark, d):
    """The manifest as a CSV file with a header, read back by its header."""
    path = scratch_path(spark, "manifest")
    sinks.write_manifest(B.manifest(spark, d), path)
    return spark.read.schema(schemas.MANIFEST).csv(path, header=True)


@query(
    "download_task_scan",
    """SELECT CAST(o_custkey AS VARCHAR) AS individual_id, CAST(o_orderkey AS VARCHAR) AS sighting_id,
              'https://img.example/' || CAST(o_orderkey AS VARCHAR) AS url FROM orders""",
)
def _(spark, d):
    """Task lists without a header, written with spaces around the fields."""
    path = scratch_path(spark, "tasks")
    padded = [F.concat(F.lit("  "), c, F.lit(" ")) for c in (F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))]
    url = F.concat(F.lit(" https://img.example/"), F.col("o_orderkey").cast("string"))
    line = F.concat_ws(",", *padded, url)
    table(spark, d, "orders").select(line.alias("value")).write.text(path)
    return scans.download_tasks(spark, path)


@query(
    "frozen_split",
    f"""SELECT status, count(*) AS n, CAST(sum(sighting_id) AS BIGINT) AS ids FROM {B.MANIFEST_SQL} WHERE status <> 'found' GROUP BY 1""",
)
def _(spark, d):
    """A frozen table is replaced as a whole; a dataset that exists is not seeded again."""
    frozen, seeded = scratch_path(spark, "frozen"), scratch_path(spark, "seed")
    rows = B.manifest(spark, d)
    sinks.write_frozen(rows, frozen, ["status"])
    sinks.write_frozen(rows.where("status <> 'found'"), frozen, ["status"])
    sinks.seed_once(spark.read.parquet(frozen), seeded)
    sinks.seed_once(rows, seeded)
    return spark.read.parquet(seeded).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("sighting_id").alias("ids"))
