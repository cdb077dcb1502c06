"""The recursive splitter as SQL: spans separator by separator, then a greedy merge.

A text is cut before each occurrence of the first separator that it holds; a piece that
is too long is cut by the next one. That is one step per separator. Runs of adjacent
short pieces are merged by a recursive query: each step takes from a run the longest
chunk that fits and moves its head on until the rest is short enough to be repeated.
"""

from __future__ import annotations

from tidewater.operators.corpus import CHUNK_OVERLAP, CHUNK_SIZE

SEPARATORS = ("chr(10) || chr(10)", "chr(10)", "' '")
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"


def chunks_sql(bodies: str, size: int = CHUNK_SIZE, overlap: int | None = None) -> str:
    """``(key, part, start, pos, text)`` of the chunks of ``(key, part, body)``, as the text of a subquery."""
    overlap = int(size * CHUNK_OVERLAP) if overlap is None else overlap
    last = len(SEPARATORS)
    level = lambda body, first: "CASE " + "".join(
        f"WHEN {first} <= {i} AND contains({body}, {s}) THEN {i} " for i, s in enumerate(SEPARATORS)
    ) + f"ELSE {last} END"
    out = f"""(
  WITH RECURSIVE
  node0 AS (SELECT key, part, CAST(0 AS BIGINT) AS at_, body, {level('body', 0)} AS level FROM {bodies} WHERE body <> '')"""
    for i, separator in enumerate(SEPARATORS):
        out += f""",
  cut{i} AS (
    SELECT key, part, at_ AS node, level, unnest(string_split(body, {separator})) AS piece,
           generate_subscripts(string_split(body, {separator}), 1) AS i FROM node{i} WHERE level = {i}),
  span{i} AS (
    SELECT key, part, node, level, node + coalesce(sum(len(piece)) OVER w, 0) AS a, len(piece) AS n, piece, i
    FROM (SELECT key, part, node, level, i, CASE WHEN i > 1 THEN {separator} || piece ELSE piece END AS piece FROM cut{i})
    WINDOW w AS (PARTITION BY key, part, node ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  node{i + 1} AS (
    SELECT * FROM node{i} WHERE level > {i}
    UNION ALL SELECT key, part, a, piece, {level('piece', i + 1)} FROM span{i} WHERE n >= {size})"""
    out += f""",
  span{last} AS (
    SELECT key, part, at_ AS node, level, at_ + i AS a, 1 AS n
    FROM (SELECT *, unnest(range(len(body))) AS i FROM node{last})),
  spans AS ({" UNION ALL ".join(f"SELECT key, part, node, level, a, n FROM span{i} WHERE n > 0" for i in range(last + 1))}),
  numbered AS (
    SELECT *, sum(CASE WHEN n >= {size} THEN 1 ELSE 0 END) OVER (PARTITION BY key, part, node, level ORDER BY a) AS run FROM spans),
  runs AS (
    SELECT key, part, node, level, run, list(CAST(a AS BIGINT) ORDER BY a) AS a, list(CAST(a + n AS BIGINT) ORDER BY a) AS b
    FROM numbered WHERE n < {size} GROUP BY ALL),
  -- state: the head of the next chunk and the first piece to try; found: the piece that no longer fits
  walk AS (
    SELECT key, part, node, level, run, a, b, CAST(1 AS BIGINT) AS head, CAST(2 AS BIGINT) AS following,
           CAST(NULL AS BIGINT) AS start, CAST(NULL AS BIGINT) AS stop, false AS done FROM runs
    UNION ALL
    SELECT key, part, node, level, run, a, b,
           CASE WHEN hit IS NULL THEN head
                ELSE head - 1 + list_position(list_transform(a[head:hit], lambda x: x = a[hit]
                       OR (a[hit] - x <= {overlap} AND b[hit] - x <= {size})), true) END,
           CASE WHEN hit IS NULL THEN following ELSE hit + 1 END,
           a[head], CASE WHEN hit IS NULL THEN b[-1] ELSE a[hit] END, hit IS NULL
    FROM (
      SELECT *, tried - 1 + nullif(list_position(list_transform(b[tried:tried + {size}], lambda x: x - a[head] > {size}), true), 0) AS hit
      FROM (SELECT *, greatest(following, head + 1) AS tried FROM walk WHERE NOT done))),
  cuts AS (
    SELECT w.key, w.part, w.start, substring(body, CAST(w.start + 1 AS BIGINT), CAST(w.stop - w.start AS BIGINT)) AS raw
    FROM walk w JOIN {bodies} t ON w.key = t.key AND w.part = t.part WHERE w.start IS NOT NULL)
  SELECT key, part, start, CAST(start + len(raw) - len(ltrim(raw, {SPACES})) AS INT) AS pos, trim(raw, {SPACES}) AS text
  FROM cuts WHERE trim(raw, {SPACES}) <> '')"""
    return out
