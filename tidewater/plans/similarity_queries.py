"""Vector search and re-identification over the stored vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import pivots, splits
from tidewater.operators import similarity as S
from tidewater.operators.habitat import region_label
from tidewater.plans import bindings as B
from tidewater.plans.registry import query
from tidewater.session import scratch_path, stored
from tidewater.sources.scans import gallery, table
from tidewater.sources.sinks import write_gallery

COS = "list_cosine_similarity(q.embedding::DOUBLE[], g.embedding::DOUBLE[])"
PAIRS_SQL = f"""(
  SELECT q.vec_id AS query_id, q.label AS true_id, g.vec_id AS image_id, g.label AS individual_id,
         round({COS}, 9) AS score
  FROM embeddings q JOIN embeddings g ON q.vec_id <> g.vec_id)"""
IMAGES_50_SQL = f"""(
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_id) AS rank
                 FROM {PAIRS_SQL}) WHERE rank <= 50)"""


def people_sql(images_sql: str, k: int) -> str:
    return f"""(
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, individual_id) AS rank
        FROM (SELECT query_id, individual_id, max(score) AS score, count(*) AS n_images,
                     first(image_id ORDER BY score DESC, image_id) AS image_id
              FROM {images_sql} GROUP BY ALL)) WHERE rank <= {k})"""


PEOPLE_SQL = people_sql(IMAGES_50_SQL, 5)


def signals_sql(people: str, threshold: float) -> str:
    return f"""(
      SELECT query_id, max(individual_id) FILTER (rank = 1) AS top_individual,
             max(score) FILTER (rank = 1) AS top_score,
             max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS margin,
             max(score) FILTER (rank = 1) < {threshold} AS abstain
      FROM {people} GROUP BY query_id)"""


def candidate_images(spark, d):
    """Top 50 images of every stored vector, itself hidden."""
    return S.nearest(
        B.image_queries(spark, d), B.images(spark, d), S.CANDIDATE_IMAGES, hide="image", block_rows=1024
    )


def candidates(spark, d, k=S.TOP_INDIVIDUALS):
    return S.best_per_individual(candidate_images(spark, d), k)


@query(
    "knn_exact",
    f"""SELECT query_id, image_id, individual_id, round(score, 6) AS score, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image_id) AS rank
          FROM {PAIRS_SQL.replace('ON q.vec_id <> g.vec_id', 'ON true')}) WHERE rank <= 5""",
)
def _(spark, d):
    q = B.image_queries(spark, d).select("query_id", "embedding")
    found = S.nearest(q, B.images(spark, d), 5, block_rows=1024)
    return found.withColumn("score", B.rounded("score"))


@query(
    "knn_live",
    f"""SELECT query_id, image_id, individual_id, round(score, 6) AS score, rank
        FROM {IMAGES_50_SQL}""",
)
def _(spark, d):
    """The candidate images of every stored image, as a live question asks for them."""
    found = S.nearest(B.image_queries(spark, d), B.images(spark, d), S.CANDIDATE_IMAGES, hide="image")
    return found.withColumn("score", B.rounded("score"))


@query(
    "knn_pruned",
    f"""SELECT query_id, image_id, individual_id, round(score, 6) AS score, rank
        FROM {IMAGES_50_SQL} WHERE rank <= 10""",
)
def _(spark, d):
    """The same search through the pivot table, as large galleries take it; small cells, so that these tables have many."""
    sizes = pivots.Sizes(cell_rows=64, block_rows=256)
    found = pivots.search(B.image_queries(spark, d), B.images(spark, d), 10, hide="image", sizes=sizes).found
    return found.withColumn("score", B.rounded("score"))


@query(
    "knn_leave_one_out",
    f"SELECT query_id, image_id, individual_id, round(score, 6) AS score, rank FROM {IMAGES_50_SQL} WHERE rank <= 10",
)
def _(spark, d):
    found = S.nearest(B.image_queries(spark, d), B.images(spark, d), 10, hide="image", block_rows=1024)
    return found.withColumn("score", B.rounded("score"))


@query(
    "best_per_individual",
    f"SELECT query_id, individual_id, image_id, n_images, round(score, 6) AS score, rank FROM {PEOPLE_SQL}",
)
def _(spark, d):
    return candidates(spark, d).withColumn("score", B.rounded("score"))


@query(
    "margin_abstain",
    f"""SELECT query_id, top_individual, round(top_score, 6) AS top_score, round(margin, 6) AS margin, abstain
        FROM {signals_sql(PEOPLE_SQL, 0.4)}""",
)
def _(spark, d):
    out = S.margin_abstain(candidates(spark, d), threshold=0.4)
    return out.withColumns({c: B.rounded(c) for c in ("top_score", "margin")})


CANDIDATES_SQL = f"""(
  SELECT query_id,
         string_agg(CAST(individual_id AS VARCHAR) || ' ' || printf('%.4f', score) || ' ' || CAST(n_images AS VARCHAR) || ' '
                    || CAST(image_id AS VARCHAR), ';' ORDER BY rank) AS candidates,
         string_agg(concat_ws('|', 'catalog_image', coalesce(catalog, 'catalog'), thumb_ref, CAST(individual_id AS VARCHAR)), ';'
                    ORDER BY rank) AS cited
  FROM {PEOPLE_SQL} LEFT JOIN {B.CARDS_SQL} c USING (image_id) GROUP BY 1)"""


@query(
    "photo_id",
    f"""SELECT s.query_id, 'photo_id' AS tool, true AS ok, top_individual, round(top_score, 6) AS top_score,
               round(margin, 6) AS margin, abstain, 0.4::DOUBLE AS threshold,
               CASE WHEN abstain THEN 'No confident match (top=' || printf('%.3f', top_score) || ' < 0.4) → likely NOVEL'
                    ELSE 'Top match individual ' || CAST(top_individual AS VARCHAR) || ' (score='
                         || printf('%.3f', top_score) || ', margin=' || coalesce(printf('%.3f', margin), 'n/a') || ')' END AS summary,
               candidates, cited
        FROM {signals_sql(PEOPLE_SQL, 0.4)} s JOIN {CANDIDATES_SQL} USING (query_id)""",
)
def _(spark, d):
    """All stored vectors identified leave-one-out, one contract row each (flagship)."""
    ranked = candidates(spark, d)
    out = S.photo_answers(B.image_queries(spark, d), ranked, B.cards(spark, d), threshold=0.4)
    told = F.transform(
        "candidates",
        lambda c: F.format_string("%s %.4f %d %s", c["individual_id"], c["score"], c["n_images"], c["image_id"]),
    )
    return out.select(
        "query_id", "tool", "ok", "top_individual", B.rounded("top_score").alias("top_score"),
        B.rounded("margin").alias("margin"), "abstain", "threshold", "summary",
        F.array_join(told, ";").alias("candidates"), B.cited("citations").alias("cited"),
    )


SCOPED_PAIRS_SQL = f"(SELECT * FROM {PAIRS_SQL} WHERE true_id % 3 = individual_id % 3)"


@query(
    "knn_scoped",
    f"""SELECT query_id, individual_id, n_images, round(score, 6) AS score, rank
        FROM {people_sql(SCOPED_PAIRS_SQL, 5)}""",
)
def _(spark, d):
    """Identification inside the query's own split; no pair across splits is scored."""
    gallery = B.images(spark, d).withColumn("scope", F.col("individual_id") % 3)
    asked = B.image_queries(spark, d).withColumn("scope", F.col("true_id") % 3)
    ranked = S.nearest(
        asked, gallery, 5, by="individual", scope=["scope"], hide="image", block_rows=1024
    )
    owners = asked.select("query_id", F.col("true_id").alias("own_individual"))
    full = S.with_support(ranked, owners, gallery)
    return full.select("query_id", "individual_id", "n_images", B.rounded("score").alias("score"), "rank")


STRANGERS_SQL = f"(SELECT * FROM {PAIRS_SQL} WHERE true_id % 3 = individual_id % 3 AND true_id <> individual_id)"


@query(
    "open_set_tail",
    f"""SELECT true_id % 3 AS scope, count(*) AS n_queries,
               round(avg(CASE WHEN top < 0.35 THEN 1 ELSE 0 END), 6) AS abstain_rate
        FROM (SELECT query_id, true_id, max(score) AS top FROM {STRANGERS_SQL} GROUP BY ALL) GROUP BY 1""",
)
def _(spark, d):
    """Individuals taken out of the gallery should abstain."""
    gallery = B.images(spark, d).withColumn("scope", F.col("individual_id") % 3)
    asked = B.image_queries(spark, d).withColumn("scope", F.col("true_id") % 3)
    strangers = asked.withColumn("hide_id", F.col("true_id"))
    ranked = S.nearest(
        strangers, gallery, 2, by="individual", scope=["scope"], hide="individual", block_rows=1024
    )
    signals = S.margin_abstain(ranked, 0.35).join(asked.select("query_id", "scope"), "query_id")
    return signals.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg(F.col("abstain").cast("int")), 6).alias("abstain_rate"),
    )


HALF_PAIRS_SQL = PAIRS_SQL.replace("q.embedding", "q.embedding[1:32]").replace(
    "g.embedding", "g.embedding[1:32]"
)


def _arm_sql(arm: str, pairs: str) -> str:
    best = f"(SELECT query_id, true_id, individual_id, max(score) AS score FROM {pairs} GROUP BY ALL)"
    ranked = f"""(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, individual_id) AS r
                  FROM {best})"""
    return f"""SELECT '{arm}' AS arm, count(*) AS n_queries, round(avg(CASE WHEN r <= 1 THEN 1 ELSE 0 END), 6) AS reid_1,
                      round(avg(CASE WHEN r <= 5 THEN 1 ELSE 0 END), 6) AS reid_5
               FROM {ranked} WHERE individual_id = true_id"""


@query("arm_compare", f"{_arm_sql('half', HALF_PAIRS_SQL)} UNION ALL {_arm_sql('whole', PAIRS_SQL)}")
def _(spark, d):
    """Two inputs of the same embedder (whole and half vectors) against the same truth."""
    arms = []
    for arm, cut in (("whole", F.col("embedding")), ("half", F.slice("embedding", 1, 32))):
        gallery = B.images(spark, d).withColumn("embedding", cut)
        asked = B.image_queries(spark, d).withColumn("embedding", cut)
        ranked = S.nearest(asked, gallery, 5, by="individual", hide="image", block_rows=1024)
        arms.append(ranked.select(F.lit(arm).alias("arm"), "query_id", "individual_id", "rank"))
    truth = B.image_queries(spark, d).select(
        F.explode(F.array(F.lit("whole"), F.lit("half"))).alias("arm"), "query_id", "true_id"
    )
    out = S.arm_scores(arms[0].unionByName(arms[1]), truth, ["whole", "half"])
    return out.withColumns({c: B.rounded(c) for c in ("reid_1", "reid_5")})


@query(
    "pair_top1",
    f"""WITH p AS (SELECT label, min(vec_id) AS a, max(vec_id) AS b FROM embeddings GROUP BY label),
        s AS (SELECT p.label AS individual_id, h.label AS top_id, {COS} AS score
              FROM p JOIN embeddings q ON q.vec_id = p.a
              CROSS JOIN p h JOIN embeddings g ON g.vec_id = h.b)
        SELECT individual_id, first(top_id ORDER BY round(score, 9) DESC, top_id) AS top_id,
               first(top_id ORDER BY round(score, 9) DESC, top_id) = individual_id AS hit
        FROM s GROUP BY individual_id""",
)
def _(spark, d):
    """One query and one gallery image per individual: is the own image the nearest?"""
    ends = B.images(spark, d).groupBy("individual_id").agg(
        F.min_by("embedding", "image_id").alias("q"), F.max_by("embedding", "image_id").alias("g")
    )
    asked = ends.select(F.col("individual_id").alias("query_id"), F.col("q").alias("embedding"))
    gallery = ends.select(
        F.col("individual_id").alias("image_id"), "individual_id", F.col("g").alias("embedding")
    )
    top = S.nearest(asked, gallery, 1)
    return top.select(
        F.col("query_id").alias("individual_id"),
        F.col("individual_id").alias("top_id"),
        (F.col("query_id") == F.col("individual_id")).alias("hit"),
    )


def versioned(spark, d):
    """Vectors of three widths in one gallery, and the settings that say which versions are in use."""
    path, settings = scratch_path(spark, "gallery"), scratch_path(spark, "settings")
    for version, width, state in (("v1", 16, "retired"), ("v2", 32, "active"), ("v3", 64, "active")):
        rows = B.images(spark, d).where(F.lit(version != "v2") | (F.col("image_id") % 2 == 0))
        write_gallery(rows.withColumns({"embedding": F.slice("embedding", 1, width), "embedder_ver": F.lit(version)}), path)
        spark.range(1).select(F.lit(version).alias("embedder_ver"), F.lit(state).alias("state")).write.mode("append").parquet(settings)
    return gallery(spark, path, spark.read.parquet(settings).where("state = 'active'"))


EVEN_SQL = HALF_PAIRS_SQL.replace("ON q.vec_id <> g.vec_id", "ON q.vec_id <> g.vec_id AND q.vec_id % 2 = 0 AND g.vec_id % 2 = 0")


@query(
    "knn_versions",
    f"""SELECT embedder_ver, query_id, image_id, round(score, 6) AS score, rank FROM (
          SELECT *, row_number() OVER (PARTITION BY embedder_ver, query_id ORDER BY score DESC, image_id) AS rank
          FROM (SELECT 'v2' AS embedder_ver, * FROM {EVEN_SQL} UNION ALL SELECT 'v3', * FROM {PAIRS_SQL})) WHERE rank <= 5""",
)
def _(spark, d):
    """Every stored vector of a version in use against those of its own version; others are not read."""
    rows = stored(versioned(spark, d), "versions")
    name = F.concat_ws(":", "embedder_ver", "image_id")
    asked = rows.select("embedder_ver", name.alias("query_id"), F.col("image_id").alias("hide_id"), "embedding")
    found = S.nearest(asked, rows, 5, scope=["embedder_ver"], hide="image")
    parts = F.split("query_id", ":")
    return found.select(
        parts[0].alias("embedder_ver"), parts[1].cast("long").alias("query_id"), "image_id", B.rounded("score").alias("score"), "rank"
    )


@query(
    "cosine_separation",
    f"""SELECT count(*) FILTER (true_id = individual_id) AS same_pairs,
               count(*) FILTER (true_id <> individual_id) AS diff_pairs,
               round(avg(score) FILTER (true_id = individual_id), 6) AS same_mean,
               round(avg(score) FILTER (true_id <> individual_id), 6) AS diff_mean
        FROM {PAIRS_SQL}""",
)
def _(spark, d):
    out = S.cosine_separation(B.images(spark, d))
    return out.withColumns({c: B.rounded(c) for c in ("same_mean", "diff_mean")})


@query(
    "supcon_value",
    f"""WITH s AS (SELECT q.vec_id // 32 AS batch_id, q.vec_id AS a, g.vec_id AS b,
                          q.label = g.label AS same, {COS} / 0.1 AS v
                   FROM embeddings q JOIN embeddings g ON q.vec_id // 32 = g.vec_id // 32),
        m AS (SELECT a, max(v) AS mx FROM s GROUP BY a),
        l AS (SELECT a, ln(sum(CASE WHEN a <> b THEN exp(v - mx) ELSE 0 END) + 1e-12) AS ld
              FROM s JOIN m USING (a) GROUP BY a),
        t AS (SELECT batch_id, a, sum(CASE WHEN same AND a <> b THEN v - mx - ld ELSE 0 END)
                     / greatest(sum(CASE WHEN same AND a <> b THEN 1 ELSE 0 END), 1) AS x
              FROM s JOIN m USING (a) JOIN l USING (a) GROUP BY batch_id, a)
        SELECT batch_id, count(*) AS n, round(-avg(x), 6) AS loss FROM t GROUP BY batch_id""",
)
def _(spark, d):
    batches = B.images(spark, d).withColumn("batch_id", F.floor(F.col("image_id") / 32))
    return S.supcon_value(batches).withColumn("loss", B.rounded("loss"))


@query(
    "version_parity",
    """SELECT CAST(vec_id AS VARCHAR) || '.jpg' AS asset_ref,
              round(list_cosine_similarity(embedding::DOUBLE[],
                list_concat(embedding[1:32]::DOUBLE[], list_transform(embedding[33:64], lambda x: 0::DOUBLE))), 6) AS cosine
       FROM embeddings""",
)
def _(spark, d):
    """The same image under two versions (the second keeps half of the vector)."""
    v1 = table(spark, d, "embeddings").select(
        F.concat(F.col("vec_id").cast("string"), F.lit(".jpg")).alias("asset_ref"), "embedding"
    )
    half = F.concat(F.slice("embedding", 1, 32), F.array_repeat(F.lit(0.0).cast("float"), 32))
    return S.version_parity(v1, v1.withColumn("embedding", half)).withColumn("cosine", B.rounded("cosine"))


@query(
    "gallery_cap",
    """SELECT image_id, individual_id, slot FROM (
         SELECT vec_id AS image_id, label AS individual_id,
                row_number() OVER (PARTITION BY label ORDER BY vec_id) AS slot FROM embeddings) WHERE slot <= 6""",
)
def _(spark, d):
    return splits.gallery_cap(B.images(spark, d)).select("image_id", "individual_id", "slot")


LABELLED_SQL = f"""(
  SELECT s.*, (SELECT min(region) FROM {B.REGIONS_SQL} r
               WHERE s.lat BETWEEN r.lat_min AND r.lat_max AND s.lon BETWEEN r.lon_min AND r.lon_max) AS region
  FROM {B.SIGHTINGS_SQL} s WHERE lat IS NOT NULL)"""


def labelled_sightings(spark, d):
    points = B.sightings(spark, d).where("lat is not null")
    return region_label(points, B.regions(spark))


_LINKS = ", ".join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in B.REGION_LINKS)


@query(
    "region_prior",
    f"""WITH l AS (SELECT * FROM {LABELLED_SQL}),
        seen AS (SELECT individual_id, max(species) AS sp, list_sort(list(DISTINCT region)) AS regions
                 FROM l WHERE region IS NOT NULL GROUP BY 1),
        links AS (SELECT a, list(b) AS linked FROM (VALUES {_LINKS}) AS v(a, b) GROUP BY a),
        c AS (SELECT p.query_id, p.individual_id, p.rank, seen.sp, seen.regions, l.region, links.linked
              FROM {PEOPLE_SQL} p LEFT JOIN seen USING (individual_id)
              LEFT JOIN l ON l.sighting_id = p.query_id LEFT JOIN links ON links.a = l.region),
        f AS (SELECT *, coalesce(list_contains(regions, region), false) AS observed_here,
                     coalesce(list_has_any(regions, linked), false) AS linked_here FROM c),
        s AS (SELECT query_id, count(DISTINCT array_to_string(regions, '|')) > 1 AS separable FROM f GROUP BY 1)
        SELECT query_id, individual_id, rank, observed_here, linked_here, separable,
               separable AND coalesce(sp = '5-LOW', false) AND region IS NOT NULL AND regions IS NOT NULL
                 AND NOT observed_here AND NOT linked_here AS demote
        FROM f JOIN s USING (query_id)""",
)
def _(spark, d):
    placed = labelled_sightings(spark, d)
    links = spark.createDataFrame(list(B.REGION_LINKS), "a string, b string")
    asked = placed.select(F.col("sighting_id").alias("query_id"), "region").where("region is not null")
    seen = placed.select("individual_id", "species", "region")
    return S.region_prior(candidates(spark, d), seen, asked, links, "5-LOW")
