"""The corpus operators bound to whole given tables, with production parameters."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import audit, bpe, decontam, htmltext, linededup, mixing, negatives, passages, quality, sharding, simhash, surrogates, urltree
from tidewater.plans.registry import query
from tidewater.sources.scans import table

#: tokenizer file of op7, a name below the folder of the installed vocabularies
VOCABULARY = "byte_bpe_50k.json"


@query("op1_compression_bands")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = quality.judged(docs)
    return out.select("row.doc_id", *[c for c in out.columns if c != "row"])


URL_RULES = (
    urltree.Rule("allow", "org", "/"),
    urltree.Rule("block", "example.org", "/es/"),
    urltree.Rule("block", "example.org", "/en/1"),
    urltree.Rule("allow", "com", "/fr/"),
    urltree.Rule("block", "com", "/de/"),
)


def url_sql(tree: urltree.Tree, rules: tuple[urltree.Rule, ...]) -> str:
    """The tree as SQL: a step per level for the wildcards, then one per level for the merges."""
    d = tree.depth
    tail = r"'^(.*?)((?:\.[A-Za-z][A-Za-z0-9]{0,5})?)$'"
    stem, end = f"regexp_extract(x, {tail}, 1)", f"regexp_extract(x, {tail}, 2)"
    shapes = " ".join(
        f"WHEN regexp_matches({stem}, '{pattern.replace('(?=[^0-9]*[0-9])', '')}')"
        + (f" AND regexp_matches({stem}, '[0-9]')" if "(?=" in pattern else "")
        + f" THEN '{mark}' || {end}"
        for pattern, mark in urltree.SHAPES
    )
    fits = lambda r: f"(r.host = '{r.host}' OR ends_with(r.host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in ordered)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ordered)
    upper = urltree.UPPER
    out = rf"""
WITH known AS (
  SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id),
rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{upper}', '{upper.lower()}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
numbered AS (
  SELECT *, TRY_CAST(regexp_extract(path, '([0-9]{{1,18}})(?:\.[A-Za-z]+)?/?$', 1) AS BIGINT) AS doc FROM named),
parts AS (
  SELECT page_id, host, path, bad,
         CASE WHEN path = '' THEN [] ELSE string_split(regexp_replace(path, '^/', ''), '/') END AS parts
  FROM numbered LEFT JOIN known ON doc = doc_id),
rows_ AS (
  SELECT page_id, host, path, bad,
         list_transform(CASE WHEN len(parts) > {d} THEN list_concat(parts[1:{d}], ['**']) ELSE parts END,
                        lambda x: CASE {shapes} ELSE x END) AS shaped FROM parts),
t0 AS (
  SELECT host, shaped, count(*) AS n, count(bad) AS labels, coalesce(sum(bad), 0) AS bad, [] AS template
  FROM (SELECT host, CAST(shaped AS VARCHAR[]) AS shaped, bad FROM rows_) GROUP BY host, shaped)"""
    for k in range(1, d + 1):
        before = f"t{k - 1}" if k > 1 else "(SELECT host, shaped, n, labels, bad, CAST(template AS VARCHAR[]) AS template FROM t0)"
        out += f""",
c{k} AS (SELECT *, CASE WHEN len(shaped) >= {k} THEN shaped[{k}] END AS child FROM {before} b),
k{k} AS (SELECT host, template, child, sum(n) AS n, sum(labels) AS labels FROM c{k} WHERE child IS NOT NULL GROUP BY host, template, child),
p{k} AS (SELECT host, template, count(*) AS children FROM k{k} GROUP BY host, template),
l{k} AS (SELECT k{k}.host, k{k}.template, child FROM k{k} JOIN p{k} ON k{k}.host = p{k}.host AND k{k}.template = p{k}.template
  WHERE children <= {tree.fanout} OR n >= {tree.support} OR labels >= {tree.min_labels} OR child LIKE '<%' OR child = '**'),
t{k} AS (SELECT c.host, shaped, n, labels, bad,
  CASE WHEN c.child IS NULL THEN c.template ELSE list_concat(c.template, [CASE WHEN l.child IS NULL THEN '*' ELSE c.child END]) END AS template
  FROM c{k} c LEFT JOIN l{k} l ON c.host = l.host AND c.template = l.template AND c.child = l.child)"""
    out += f""",
formed AS (SELECT host, shaped, labels, bad, CASE WHEN len(shaped) > {d} THEN list_concat(template, ['**']) ELSE template END AS template FROM t{d}),
m{d + 1} AS (SELECT host, template, template AS merged, sum(labels) AS labels, sum(bad) AS bad FROM formed GROUP BY host, template)"""
    for k in range(d, 0, -1):
        out += f""",
h{k} AS (SELECT *, CASE WHEN len(merged) >= {k}
                        THEN list_concat(list_concat(merged[1:{k - 1}], ['~']), merged[{k + 1}:]) END AS masked FROM m{k + 1}),
b{k} AS (SELECT host, masked, merged, sum(labels) AS l, sum(bad) AS b FROM h{k} WHERE masked IS NOT NULL GROUP BY host, masked, merged),
q{k} AS (SELECT host, masked, sum(l) AS pl, sum(b) AS pb, count(*) AS branches FROM b{k} GROUP BY host, masked),
j{k} AS (SELECT b.host, b.merged, b.masked AS into_ FROM b{k} b JOIN q{k} q ON b.host = q.host AND b.masked = q.masked
  WHERE branches > 1 AND (l = 0 OR pow(b.b / l::DOUBLE - pb / pl::DOUBLE, 2)
        - {tree.z**2!r}::DOUBLE * (pb / pl::DOUBLE) * (1 - pb / pl::DOUBLE) / l <= 0)),
m{k} AS (SELECT h.host, template, coalesce(into_, h.merged) AS merged, labels, bad
  FROM h{k} h LEFT JOIN j{k} j ON h.host = j.host AND h.merged = j.merged)"""
    return out + f""",
base AS (SELECT CASE WHEN sum(labels) > 0 THEN sum(bad) / sum(labels)::DOUBLE ELSE 0 END AS rate FROM m1),
hosts AS (SELECT host, (sum(bad) + {tree.prior}::DOUBLE * any_value(rate)) / (sum(labels) + {tree.prior}::DOUBLE) AS host_rate
  FROM m1, base GROUP BY host),
purity AS (SELECT m1.host, merged, sum(labels) AS n_labels,
    (sum(bad) + {tree.prior}::DOUBLE * any_value(host_rate)) / (sum(labels) + {tree.prior}::DOUBLE) AS bad_rate
  FROM m1 JOIN hosts ON m1.host = hosts.host GROUP BY m1.host, merged)
SELECT r.page_id, r.host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN bad_rate >= {tree.max_bad}::DOUBLE AND n_labels >= {tree.min_labels} THEN 'block' ELSE 'allow' END AS verdict,
       '/' || array_to_string(m1.merged, '/') AS template, CAST(n_labels AS BIGINT) AS n_labels, round(bad_rate, 9) AS bad_rate
FROM (SELECT page_id, host, path, CAST(shaped AS VARCHAR[]) AS shaped FROM rows_) r
JOIN formed f ON r.host = f.host AND r.shaped = f.shaped
JOIN m1 ON f.host = m1.host AND f.template = m1.template
JOIN purity ON m1.host = purity.host AND m1.merged = purity.merged
"""


@query("op2_url_templates", url_sql(urltree.Tree(), URL_RULES))
def op2(spark: SparkSession, folder: str) -> DataFrame:
    pages = urltree.page_labels(table(spark, folder, "pages"), table(spark, folder, "labels"))
    return urltree.judged_urls(pages, URL_RULES).withColumnRenamed("id", "page_id")


#: the key of op3; a production run passes its own, kept apart from the data
SURROGATE_KEY = b"tidewater demonstration key"


@query("op3_keyed_surrogates")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = surrogates.checked_surrogates(docs, SURROGATE_KEY)
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight,
         2.0::DOUBLE * source_size AS most
  FROM sources),
steps AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()
            - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget,
         sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM weighed),
level AS (
  SELECT max(budget / open_weight) FILTER (WHERE most / weight > budget / open_weight) AS at_level FROM steps),
targets AS (
  SELECT source, source_size,
         CASE WHEN at_level IS NULL OR most <= weight * at_level THEN most ELSE weight * at_level END AS target
  FROM weighed, level),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id NULLS LAST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN target - whole * source_size > 0
                                  AND 2 * earlier + size <= 2 * (target - whole * source_size)
                                 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""


@query("op4_mix_sources", MIX_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), "source", mixing.word_count(F.col("text")).alias("size"))
    out = mixing.mixed(rows, weights=corpus_pipeline.MIX_WEIGHTS)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op5_compact_windows")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(table(spark, folder, "documents"))


@query("op6_simhash_bytes")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op7_bpe_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.counted(docs, public_tokenizers.path(VOCABULARY))


@query("op8_template_leaks")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SHARD_SQL = """
WITH steps AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
    FROM range(256) r(i))),
keyed AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS k FROM documents),
ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY k, doc_id NULLS LAST) - 1)::DOUBLE
            / (2 * count(*) OVER (PARTITION BY source)) AS at_ FROM keyed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY at_, source NULLS LAST, k, doc_id NULLS LAST) - 1 AS place,
         count(*) OVER () AS total FROM ranked),
sharded AS (SELECT *, place * 16 // total AS shard FROM placed)
SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS size,
       CASE WHEN text = '' THEN 0 ELSE
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
                         lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) END AS text_crc32,
       'rows' AS law, CAST(shard AS INT) AS shard, place - (shard * total + 15) // 16 AS slot, CAST(NULL AS INT) AS grown_shard
FROM sharded, steps
"""


@query("op9_stratified_shards", SHARD_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    rows = docs.select(
        F.col("doc_id").alias("id"),
        "source",
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    return sharding.interleaved(rows, shards=corpus_pipeline.SHARDS).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


LINE_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, text, count(*) AS n_rows FROM documents GROUP BY doc_id, text),
split AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS line_no
  FROM docs),
occ AS (
  SELECT * FROM split WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]')) > 0),
lines AS (
  SELECT line, len(line) AS n, count(*) AS copies,
         min({'late': doc_id IS NULL, 'id': doc_id, 'no': line_no}) AS place
  FROM occ GROUP BY line),
long_ AS (
  SELECT line, n, substr(line, 1, CAST(floor(n / 2) AS INT)) AS head,
         substr(line, CAST(floor(n / 2) AS INT) + 1, n) AS tail FROM lines WHERE n >= 32),
probes AS (
  SELECT line, n, n AS other, head, tail FROM long_
  UNION ALL
  SELECT line, n, n - 1, substr(line, 1, CAST(floor((n - 1) / 2) AS INT)), substr(line, CAST(floor((n - 1) / 2) AS INT) + 2, n)
  FROM long_),
pairs AS (
  SELECT a.line AS a, b.line AS b FROM long_ a JOIN probes b ON a.n = b.other AND a.head = b.head WHERE a.line <> b.line
  UNION
  SELECT a.line, b.line FROM long_ a JOIN probes b ON a.n = b.other AND a.tail = b.tail WHERE a.line <> b.line),
links AS (
  SELECT a, b FROM pairs WHERE levenshtein(a, b) <= 1
  UNION SELECT b, a FROM pairs WHERE levenshtein(a, b) <= 1),
reach AS (
  SELECT a AS line, a AS other FROM links
  UNION SELECT r.line, l.b FROM reach r JOIN links l ON r.other = l.a),
firsts AS (
  SELECT x.line, min({'place': y.place, 'line': y.line}) AS keep
  FROM (SELECT line, other FROM reach UNION SELECT line, line FROM lines) x JOIN lines y ON x.other = y.line
  GROUP BY x.line),
lost AS (
  SELECT o.doc_id, o.text, o.line_no, o.line <> f.keep.line AS near
  FROM occ o JOIN firsts f USING (line)
  WHERE o.line_no <> f.keep.place.no OR o.doc_id IS DISTINCT FROM f.keep.place.id),
gone AS (
  SELECT doc_id, text, count(*) AS n_dropped, count(*) FILTER (WHERE near) AS n_near,
         array_to_string(list(line_no ORDER BY line_no), ',') AS dropped
  FROM lost GROUP BY doc_id, text),
held AS (SELECT doc_id, text, count(*) AS n_lines FROM occ GROUP BY doc_id, text)
SELECT d.doc_id, d.n_rows, coalesce(h.n_lines, 0) AS n_lines, coalesce(g.n_dropped, 0) AS n_dropped,
       coalesce(g.n_near, 0) AS n_near, coalesce(g.dropped, '') AS dropped
FROM docs d
LEFT JOIN held h ON d.doc_id IS NOT DISTINCT FROM h.doc_id AND d.text IS NOT DISTINCT FROM h.text
LEFT JOIN gone g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.text IS NOT DISTINCT FROM g.text
"""


@query("op10_line_segments", LINE_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    out = linededup.deduplicated(table(spark, folder, "documents"))
    return out.withColumn("dropped", F.array_join("dropped", ","))


NEGATIVES_SQL = """
WITH named AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings),
usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM named
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER o AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW o AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER o <= 10
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = given.where(negatives.usable(F.col("embedding"))).select(
        F.col("vec_id").alias("id"), label.alias("label"), negatives.scaled(F.col("embedding")).alias("vector")
    )
    return negatives.mined(rows, is_anchor=F.col("id") % 100 == 0)


AUDIT_SQL = r"""
WITH RECURSIVE known AS (
  SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         concat(CASE WHEN len(words) < 100 THEN 'A' ELSE '' END,
                CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END,
                CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text) THEN 'C' ELSE '' END,
                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
                CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM docs d LEFT JOIN known k ON d.doc_id = k.doc_id),
kinds AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
orders AS (
  SELECT '' AS o
  UNION ALL SELECT o || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE strpos(o, f) = 0),
steps AS (
  SELECT o, CAST(s AS INT) AS step, o[s] AS f FROM orders, range(1, 6) r(s) WHERE len(o) = 5),
gone AS (
  SELECT part, o, fails, n, good, toxic,
         (SELECT min(s) FROM range(1, 6) r(s) WHERE strpos(fails, o[s]) > 0) AS at_step
  FROM kinds, orders WHERE len(o) = 5),
told AS (
  SELECT part, s.o AS filter_order, step, f,
         sum(CASE WHEN at_step IS NULL OR at_step > step THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN at_step = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN strpos(fails, f) > 0 AND at_step < step THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN at_step = step THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN at_step = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM gone g JOIN steps s ON g.o = s.o GROUP BY part, s.o, step, f)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM told
"""


@query("op12_filter_audit", AUDIT_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audited(audit.mask_cells(table(spark, folder, "documents"), table(spark, folder, "labels")))


@query("op13_main_text")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return htmltext.extracted(pages).select("row.page_id", "row.url", "text", "n_chars")


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
