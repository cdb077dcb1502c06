"""Splits and samples over the sightings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import splits as P
from tidewater.plans import bindings as B
from tidewater.plans.registry import query
from tidewater.sources.sinks import export_cases

PICK_SQL = f"""(
  SELECT individual_id, sighting_id AS query_sighting_id FROM (
    SELECT individual_id, sighting_id, row_number() OVER (PARTITION BY individual_id
           ORDER BY md5(CAST(sighting_id AS VARCHAR))) AS rn FROM {B.SIGHTINGS_SQL}) WHERE rn = 1)"""
SPLIT_SQL = f"""(
  WITH c AS (SELECT o_custkey AS individual_id, count(*) AS n_photos,
                    CAST('0x' || left(md5(CAST(o_custkey AS VARCHAR)), 6) AS BIGINT) % 100 AS b
             FROM orders GROUP BY ALL HAVING count(*) >= 2),
  l AS (SELECT individual_id, n_photos, CASE WHEN n_photos < 4 THEN 'train' WHEN b >= 85 THEN 'test'
               WHEN b >= 70 THEN 'val' ELSE 'train' END AS split FROM c)
  SELECT l.individual_id, split, n_photos, CASE WHEN split <> 'train' THEN query_sighting_id END AS query_sighting_id
  FROM l JOIN {PICK_SQL} USING (individual_id))"""


def split(spark, d):
    return P.reid_split(B.sightings(spark, d))


@query("holdout_pick", f"SELECT * FROM {PICK_SQL}")
def _(spark, d):
    return P.holdout_pick(B.sightings(spark, d))


@query(
    "loo_split",
    f"""SELECT individual_id, query_sighting_id, 'closed_set' AS role FROM {PICK_SQL}
        WHERE individual_id IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 10)""",
)
def _(spark, d):
    return P.loo_split(B.sightings(spark, d))


@query("reid_split", f"SELECT * FROM {SPLIT_SQL}")
def _(spark, d):
    return split(spark, d)


V2_SQL = "(SELECT * FROM orders WHERE o_orderkey % 4 <> 0)"


@query("reid_split_version", f"SELECT * FROM {SPLIT_SQL.replace('FROM orders', f'FROM {V2_SQL}')}")
def _(spark, d):
    """The split over the images that one embedding version has stored."""
    version = F.when(F.col("sighting_id") % 4 == 0, "v1").otherwise("v2")
    return P.reid_split(B.sightings(spark, d).withColumn("embedder_ver", version), "v2")


@query(
    "split_summary",
    f"""SELECT split, count(*) AS individuals, CAST(sum(n_photos) AS BIGINT) AS images,
               round(avg(n_photos), 1) AS mean_photos, count(query_sighting_id) AS held_out_queries
        FROM {SPLIT_SQL} GROUP BY split""",
)
def _(spark, d):
    return P.split_summary(split(spark, d))


@query(
    "split_leakage",
    f"""SELECT CAST(sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS BIGINT) AS in_two_splits,
               CAST(sum(t) AS BIGINT) AS train_with_query, CAST(sum(e) AS BIGINT) AS eval_without_query
        FROM (SELECT individual_id, count(DISTINCT split) AS k,
                     count(*) FILTER (split = 'train' AND query_sighting_id IS NOT NULL) AS t,
                     count(*) FILTER (split <> 'train' AND query_sighting_id IS NULL) AS e
              FROM {SPLIT_SQL} GROUP BY 1)""",
)
def _(spark, d):
    return P.split_leakage(split(spark, d))


CASES_SQL = f"""(
  SELECT 'reid-val-' || CAST(query_sighting_id AS VARCHAR) AS case_id, query_sighting_id, individual_id, name
  FROM {SPLIT_SQL} JOIN {B.INDIVIDUALS_SQL} USING (individual_id) WHERE split = 'val')"""


@query("eval_cases", f"SELECT *, 'reid_val' AS tag FROM {CASES_SQL}")
def _(spark, d):
    cases = P.eval_cases(split(spark, d), B.individuals(spark, d), "val")
    return cases.select("case_id", "input.*", F.col("tags")[0].alias("tag"))


@query(
    "case_export_json",
    f"""SELECT case_id, '{{"query_sighting_id":' || CAST(query_sighting_id AS VARCHAR) || ',"individual_id":'
               || CAST(individual_id AS VARCHAR) || ',"name":"' || name || '"}}' AS input,
               '{{"individual_id":' || CAST(individual_id AS VARCHAR) || ',"name":"' || name || '"}}' AS expected,
               '["reid_val"]' AS tags FROM {CASES_SQL}""",
)
def _(spark, d):
    return export_cases(P.eval_cases(split(spark, d), B.individuals(spark, d), "val"))


POOL_SQL = f"""(
  SELECT individual_id, sighting_id, asset_ref FROM (
    SELECT m.*, count(*) OVER (PARTITION BY m.individual_id) AS readable
    FROM {B.MANIFEST_SQL} m JOIN {SPLIT_SQL} s USING (individual_id)
    WHERE m.status = 'ok' AND s.split = 'train' AND s.n_photos >= 2) WHERE readable >= 2)"""


def pool(spark, d):
    return P.train_pool(split(spark, d), B.manifest(spark, d), 2)


@query("train_pool", f"SELECT * FROM {POOL_SQL}")
def _(spark, d):
    return pool(spark, d)


@query(
    "label_index",
    f"""SELECT asset_ref, individual_id,
               CAST(dense_rank() OVER (ORDER BY individual_id) - 1 AS INT) AS class_index FROM {POOL_SQL}""",
)
def _(spark, d):
    return P.label_index(pool(spark, d))


SEED = 7


def _hash(*parts: str) -> str:
    return f"md5('{SEED}:' || " + " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


def _draw(n: str, *parts: str) -> str:
    return f"CAST('0x' || left({_hash(*parts)}, 8) AS BIGINT) % ({n})"


def _stratum(slot: str, slots: int, n: str, *parts: str) -> str:
    low = f"CAST(floor({slot} * {n} / {slots}::DOUBLE) AS BIGINT)"
    high = f"CAST(floor(({slot} + 1) * {n} / {slots}::DOUBLE) AS BIGINT)"
    return f"({low} + {_draw(f'greatest({high} - {low}, 1)', *parts, slot)})"


def _permuted(table: str, at: str, n: str, *parts: str) -> str:
    """``table`` with ``place``: where ``at`` stands in the keyed permutation of ``0 .. n-1``."""
    spread = lambda i, v: f"CAST('0x' || left({_hash(*parts, str(i), v)}, 8) AS BIGINT)"
    rounds = "(SELECT *, x % cols AS c0, x // cols AS r0 FROM walk WHERE x < 0 OR x >= n_)"
    rounds = rounds.replace("x % cols", "(CASE WHEN x < 0 THEN -1 - x ELSE x END) % cols")
    rounds = rounds.replace("x // cols", "(CASE WHEN x < 0 THEN -1 - x ELSE x END) // cols")
    for i in range(4):
        if i % 2 == 0:
            new = f"(c{i} + {spread(i, f'r{i}')}) % cols AS c{i + 1}, r{i} AS r{i + 1}"
        else:
            new = f"c{i} AS c{i + 1}, (r{i} + {spread(i, f'c{i}')}) % rows_ AS r{i + 1}"
        rounds = f"(SELECT *, {new} FROM {rounds})"
    return f"""(
      WITH RECURSIVE start AS (
        SELECT *, {n} AS n_, CAST(ceil(sqrt(CAST({n} AS DOUBLE))) AS BIGINT) AS cols, -1 - ({at}) AS x FROM {table}),
      sized AS (SELECT *, CAST(ceil(n_ / CAST(cols AS DOUBLE)) AS BIGINT) AS rows_ FROM start),
      walk AS (
        SELECT * FROM sized
        UNION ALL
        SELECT * EXCLUDE (c0, r0, c1, r1, c2, r2, c3, r3, c4, r4) REPLACE (r4 * cols + c4 AS x) FROM {rounds})
      SELECT * EXCLUDE (n_, cols, x, rows_), x AS place FROM walk WHERE x >= 0 AND x < n_)"""


@query(
    "pk_batches",
    f"""WITH pool AS (SELECT * FROM {POOL_SQL}),
        img AS (SELECT individual_id, sighting_id, row_number() OVER (PARTITION BY individual_id ORDER BY sighting_id) - 1 AS place FROM pool),
        ppl AS (SELECT individual_id, n_photos, row_number() OVER (ORDER BY individual_id) - 1 AS place
                FROM (SELECT individual_id, count(*) AS n_photos FROM pool GROUP BY 1)),
        drawn AS (SELECT batch, p_slot, n, {_stratum('p_slot', 8, 'n', 'batch')} AS at_
                 FROM (SELECT unnest(generate_series(0, greatest(1, (SELECT count(*) FROM pool) // 32) - 1)) AS batch)
                 CROSS JOIN (SELECT unnest(generate_series(0, 7)) AS p_slot)
                 CROSS JOIN (SELECT count(*) AS n FROM ppl)),
        seat AS (SELECT batch, p_slot, individual_id, n_photos FROM {_permuted('drawn', 'at_', 'n', "'people'")} s JOIN ppl USING (place)),
        pick AS (SELECT batch, p_slot, k_slot, individual_id, n_photos,
                        CASE WHEN n_photos >= 4 THEN {_stratum('k_slot', 4, 'n_photos', 'batch', 'individual_id')}
                             ELSE {_draw('n_photos', 'batch', 'individual_id', 'k_slot')} END AS at_
                 FROM seat CROSS JOIN (SELECT unnest(generate_series(0, 3)) AS k_slot))
        SELECT batch, CAST(p_slot AS INT) AS p_slot, CAST(k_slot AS INT) AS k_slot, individual_id, sighting_id
        FROM {_permuted('pick', 'at_', 'n_photos', 'individual_id')} s JOIN img USING (individual_id, place)""",
)
def _(spark, d):
    """As many batches of 8 x 4 as the pool has images / 32, so the work grows with the data."""
    return P.pk_batches(pool(spark, d), None, 8, 4, seed=SEED)


@query(
    "probe_pairs",
    f"""WITH c AS (SELECT individual_id FROM {POOL_SQL} GROUP BY 1
                   ORDER BY {_hash('individual_id')}, individual_id LIMIT 200),
        r AS (SELECT individual_id, sighting_id, row_number() OVER (PARTITION BY individual_id
                     ORDER BY {_hash('sighting_id')}, sighting_id) AS r FROM {POOL_SQL} JOIN c USING (individual_id))
        SELECT individual_id, max(sighting_id) FILTER (r = 1) AS query_sighting_id,
               max(sighting_id) FILTER (r = 2) AS gallery_sighting_id FROM r GROUP BY 1""",
)
def _(spark, d):
    return P.probe_pairs(pool(spark, d), 200, seed=SEED)


@query(
    "query_gallery_sample",
    f"""WITH c AS (SELECT individual_id, query_sighting_id FROM {SPLIT_SQL} WHERE split = 'val'
                   ORDER BY md5('0:' || CAST(individual_id AS VARCHAR)), individual_id LIMIT 100),
        r AS (SELECT c.individual_id, m.sighting_id,
                     CASE WHEN m.sighting_id = c.query_sighting_id THEN 'query' ELSE 'gallery' END AS role
              FROM c JOIN {B.MANIFEST_SQL} m USING (individual_id) WHERE m.status = 'ok'),
        n AS (SELECT *, row_number() OVER (PARTITION BY individual_id, role ORDER BY sighting_id) AS slot,
                     count(*) FILTER (role = 'query') OVER (PARTITION BY individual_id) AS q,
                     count(*) FILTER (role = 'gallery') OVER (PARTITION BY individual_id) AS g FROM r)
        SELECT individual_id, sighting_id, role, slot FROM n WHERE q > 0 AND g > 0 AND slot <= 6""",
)
def _(spark, d):
    return P.query_gallery_sample(split(spark, d), B.manifest(spark, d), 100)


@query(
    "sample_with_replacement",
    f"""WITH p AS (SELECT individual_id, sighting_id, row_number() OVER (ORDER BY sighting_id) - 1 AS at_,
                          count(*) OVER () AS n FROM {POOL_SQL}),
        w AS (SELECT draw, {_draw('n', 'draw')} AS at_
              FROM (SELECT unnest(generate_series(0, (SELECT count(*) FROM {POOL_SQL}) - 1)) AS draw)
              CROSS JOIN (SELECT count(*) AS n FROM {POOL_SQL}))
        SELECT draw, individual_id, sighting_id FROM w JOIN p USING (at_)""",
)
def _(spark, d):
    rows = pool(spark, d).select("individual_id", "sighting_id")
    return P.sample_with_replacement(rows, "sighting_id", seed=SEED)


@query(
    "test_guard",
    f"""SELECT 'reid-test-' || CAST(query_sighting_id AS VARCHAR) AS case_id, individual_id
        FROM {SPLIT_SQL} JOIN {B.INDIVIDUALS_SQL} USING (individual_id) WHERE split = 'test'""",
)
def _(spark, d):
    """Cases of the sealed split: refused without the flag, given with it."""
    frozen, people = split(spark, d), B.individuals(spark, d)
    try:
        P.eval_cases(frozen, people, "test")
    except PermissionError:
        return P.eval_cases(frozen, people, "test", allow_test=True).select(
            "case_id", "expected.individual_id"
        )
    raise AssertionError("the test split was given away without the flag")
