"""Corpus pipeline and search over the documents.

The documents carry no real report headings, so line-start words that occur in
them stand in; language is the metadata filter and source the document type.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.stems import stems_sql
from tidewater.functions.text import clean_lines, heading_pattern
from tidewater.operators import corpus as K
from tidewater.operators import search as Q
from tidewater.operators.embedders import WORDS_64, embed_column
from tidewater.plans import bindings as B
from tidewater.plans.chunk_sql import SPACES, chunks_sql
from tidewater.plans.registry import query
from tidewater.session import stored
from tidewater.sources.scans import table
from tidewater.sources.sinks import upsert_latest

HEADINGS: dict[str, str | None] = {
    "The": "STOCK",
    "And": "MORTALITY",
    "Than the": None,
    "Is": "STOCK",
    "De la": "MORTALITY",
    "La": None,
    "Der": "STOCK",
}

WORD = "[\\p{L}\\p{N}_]"
CLEAN_SQL = f"""(
  SELECT doc_id, lang, source,
         array_to_string(list_filter(
           list_transform(string_split(regexp_replace(text, '({WORD}+)-\\n({WORD}+)', '\\1\\2', 'g'), chr(10)),
                          lambda s: trim(s, ' ' || chr(9) || chr(13))),
           lambda s: len(s) > 0 AND NOT regexp_full_match(s, '[0-9]+') AND NOT regexp_matches(s, '\\.{{4}}')), chr(10)) AS text
  FROM documents)"""


def documents(spark, d):
    return table(spark, d, "documents")


def cleaned(spark, d):
    return K.clean_documents(documents(spark, d))


@query("clean_lines", f"SELECT doc_id, text FROM {CLEAN_SQL}")
def _(spark, d):
    return documents(spark, d).select("doc_id", clean_lines(F.col("text")).alias("text"))


def _heading_rows() -> str:
    rows = []
    for i, (h, subject) in enumerate(HEADINGS.items()):
        pattern = heading_pattern(h).removeprefix("(?im)").replace("'", "''")
        kept = "NULL" if subject is None else f"'{subject}'"
        rows.append(f"({i}, '{h}', {kept}, '{pattern}')")
    return "(SELECT * FROM (VALUES " + ", ".join(rows) + ") AS h(ordinal, heading, subject, pattern))"


INDEX_SQL = f"""(
  SELECT doc_id, text, ordinal, heading, subject,
         CAST(length(regexp_extract(text, '(?s)\\A(.*?)(?mi:' || pattern || ')', 1)) + 1 AS INT) AS start,
         length(regexp_extract(text, '(?mi)' || pattern, 0)) AS width
  FROM {CLEAN_SQL} CROSS JOIN {_heading_rows()} WHERE regexp_matches(text, '(?mi)' || pattern))"""
SECTIONS_SQL = f"""(
  SELECT *, lead(start, 1, length(text) + 1) OVER (PARTITION BY doc_id ORDER BY start, ordinal) AS stop FROM {INDEX_SQL})"""


@query("heading_index", f"SELECT doc_id, heading, start FROM {INDEX_SQL}")
def _(spark, d):
    return K.heading_index(cleaned(spark, d), HEADINGS)


@query("section_spans", f"SELECT doc_id, heading AS section, start, CAST(stop AS INT) AS stop FROM {SECTIONS_SQL}")
def _(spark, d):
    return K.section_spans(cleaned(spark, d), HEADINGS)


@query(
    "section_split",
    f"""SELECT doc_id, heading AS section, subject,
               trim(substring(text, start + width, greatest(stop - start - width, 0)), ' ' || chr(10) || chr(9)) AS body
        FROM {SECTIONS_SQL} WHERE subject IS NOT NULL""",
)
def _(spark, d):
    kept = K.section_split(cleaned(spark, d), HEADINGS)
    return kept.select("doc_id", F.explode_outer("sections").alias("s")).where("s is not null").select(
        "doc_id", "s.section", "s.subject", "s.body"
    )


@query(
    "heading_coverage",
    f"""WITH m AS (SELECT doc_id, list(heading) AS found FROM {INDEX_SQL} GROUP BY 1)
        SELECT doc_id, CAST(coalesce(len(found), 0) AS INT) AS n_matched, {len(HEADINGS)} AS n_known,
               array_to_string(list_filter({list(HEADINGS)!r}, lambda h: NOT list_contains(coalesce(found, []), h)), '|') AS missing
        FROM documents LEFT JOIN m USING (doc_id)""",
)
def _(spark, d):
    out = K.heading_coverage(cleaned(spark, d), HEADINGS)
    return out.withColumn("missing", F.array_join("missing", "|"))


CHUNK_TEXT_SQL = f"""
  SELECT key AS doc_id, CAST(row_number() OVER (PARTITION BY key ORDER BY start) AS INT) AS chunk_no, pos, text
  FROM {chunks_sql(f"(SELECT doc_id AS key, 0 AS part, text AS body FROM {CLEAN_SQL})")}"""


@query("chunk_text", CHUNK_TEXT_SQL)
def _(spark, d):
    return K.chunk_text(cleaned(spark, d))


def _corpus_documents(spark, d):
    return cleaned(spark, d).select(
        "doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file"), "text"
    )


def _metadata(spark, d):
    """One metadata row per document file, derived from the table."""
    return documents(spark, d).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file"),
        F.col("lang").alias("species"), F.col("source").alias("stock"), F.lit(2024).alias("year"),
    )


def corpus_chunks(spark, d):
    return K.chunk_annotate(_corpus_documents(spark, d), _metadata(spark, d), HEADINGS)


def _title(text: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({text}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


BODIES_SQL = f"""(
  SELECT doc_id AS key, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, ordinal) AS INT) AS part,
         heading AS section, subject,
         trim(substring(text, start + width, greatest(stop - start - width, 0)), {SPACES}) AS body
  FROM {SECTIONS_SQL} WHERE subject IS NOT NULL)"""
ANNOTATED_SQL = f"""(
  SELECT 'doc-' || CAST(key AS VARCHAR) || '.'
           || CAST(row_number() OVER (PARTITION BY key ORDER BY part, c.start) AS VARCHAR) AS chunk_id,
         c.text, '[' || concat_ws(' - ', d.lang, {_title('subject')}, d.source) || ' — ' || {_title('section')} || ']' AS header,
         d.lang AS species, CAST(NULL AS VARCHAR) AS sanctuary, 'SAR' AS doc_type, section, d.source AS stock,
         'doc-' || CAST(key AS VARCHAR) || '.pdf' AS source, CAST(2024 AS INT) AS year
  FROM {chunks_sql(BODIES_SQL)} c JOIN {BODIES_SQL} b USING (key, part) JOIN documents d ON d.doc_id = key)"""


@query("chunk_annotate", f"SELECT * FROM {ANNOTATED_SQL}")
def _(spark, d):
    out = corpus_chunks(spark, d)
    return out.withColumn("species", F.array_join("species", "|"))


@query(
    "chunk_peek",
    f"""SELECT chunk_id, section, CAST(len(text) AS INT) AS n_chars, left(text, 80) AS head, right(text, 80) AS tail
        FROM {ANNOTATED_SQL}""",
)
def _(spark, d):
    return K.chunk_peek(corpus_chunks(spark, d))


@query(
    "corpus_ingest",
    f"""SELECT chunk_id, header, section, text, CAST(CASE WHEN species = 'en' THEN 2 ELSE 1 END AS INT) AS batch,
               {WORDS_64.width} AS width, '{WORDS_64.version}' AS embedder_ver FROM {ANNOTATED_SQL}""",
)
def _(spark, d):
    """Clean, split, chunk, embed, upsert: a second version of the English chunks replaces the first."""
    chunks = corpus_chunks(spark, d)
    done = K.embed_chunks(chunks, WORDS_64).withColumn("batch", F.lit(1))
    again = done.where(F.array_contains("species", "en")).withColumn("batch", F.lit(2))
    stored = upsert_latest(done, again, ["chunk_id"], "batch")
    return stored.select(
        "chunk_id", "header", "section", "text", "batch", F.size("embedding").alias("width"), "embedder_ver"
    )


@query(
    "alt_id_links",
    """SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '([A-Z][a-z]+ha[a-z]+)', 1)) AS alt_id FROM documents""",
)
def _(spark, d):
    """Words of a given form in a text, linked to the row (here: capitalized words with 'ha')."""
    return K.alt_id_links(documents(spark, d), "doc_id", "text", r"([A-Z][a-z]+ha[a-z]+)")


# search: every document is one chunk


def chunks(spark, d):
    return documents(spark, d).select(
        F.col("doc_id").alias("chunk_id"),
        "text",
        F.array("lang").alias("species"),
        F.col("source").alias("doc_type"),
        F.lit("body").alias("section"),
        "source",
        F.lit(2024).alias("year"),
    )


def embedded(rows):
    return rows.withColumn("embedding", embed_column(WORDS_64, F.col("text")))


def search_queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


WORDS_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


def _bags(table_sql: str, key: str) -> str:
    return f"""(
      SELECT {key}, CAST('0x' || left(md5(w), 6) AS BIGINT) % 64 AS bucket, count(*) AS c
      FROM (SELECT {key}, unnest({WORDS_SQL}) AS w FROM {table_sql}) GROUP BY ALL)"""


def vector_sql(docs: str, k: int) -> str:
    """Cosine of hashed word counts, from sparse counts."""
    return f"""(
      WITH d AS (SELECT * FROM {_bags(docs, 'doc_id')}), q AS (SELECT * FROM {_bags('benchmark', 'item_id')}),
      dn AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM d GROUP BY 1),
      qn AS (SELECT item_id, sqrt(sum(c * c)) AS n FROM q GROUP BY 1),
      s AS (SELECT qn.item_id AS query_id, dn.doc_id AS chunk_id,
                   round(coalesce(sum(q.c * d.c), 0) / any_value(qn.n) / any_value(dn.n), 6) AS score
            FROM qn CROSS JOIN dn LEFT JOIN q ON q.item_id = qn.item_id
            LEFT JOIN d ON d.doc_id = dn.doc_id AND d.bucket = q.bucket GROUP BY 1, 2)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)
      WHERE rank <= {k})"""


ENGLISH_SQL = "(SELECT * FROM documents WHERE lang = 'en')"


def _vector(spark, d, species=None, k=Q.TOP_K):
    found = Q.prefilter(chunks(spark, d), species=species)
    return Q.vector_search(
        embedded(search_queries(spark, d)), embedded(found), k, score_digits=6, block_rows=4096
    )


@query("doc_vector_search", f"SELECT * FROM {vector_sql(ENGLISH_SQL, 5)}")
def _(spark, d):
    return _vector(spark, d, species="en")


@query("vector_topk", f"SELECT query_id, chunk_id, rank FROM {vector_sql('documents', 20)}")
def _(spark, d):
    return _vector(spark, d, k=Q.CANDIDATES).select("query_id", "chunk_id", "rank")


STOPS_SQL = f"{list(Q.STOP_WORDS)!r}"
def word_stems_sql(rows: str) -> str:
    """``word, stem`` of all words in ``rows``."""
    return stems_sql(f"(SELECT DISTINCT unnest({WORDS_SQL}) AS word FROM {rows})")


def tokens_sql(docs: str) -> str:
    """``doc_id, w, n``: the stems of the words that are no stop words, and their number."""
    return f"""(
      SELECT doc_id, list(stem) AS w, count(*) AS n
      FROM (SELECT doc_id, unnest({WORDS_SQL}) AS word FROM {docs}) JOIN {word_stems_sql(docs)} USING (word)
      WHERE NOT list_contains({STOPS_SQL}, word) GROUP BY doc_id)"""


def keyword_sql(terms: str, cand: int, docs: str = "documents") -> str:
    """``terms``: ``query_id, t`` with the list of required stems."""
    return f"""(
      WITH d AS (SELECT * FROM {tokens_sql(docs)}), q AS (SELECT * FROM {terms} WHERE len(t) > 0),
      s AS (SELECT query_id, doc_id AS chunk_id,
                   len(list_filter(w, lambda x: list_contains(t, x))) / n::DOUBLE AS score
            FROM q JOIN d ON list_has_all(w, t))
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)
      WHERE rank <= {cand})"""


TERMS_SQL = f"""(
  SELECT query_id, list_distinct(list(stem)) AS t
  FROM (SELECT query_id, unnest({WORDS_SQL}) AS word FROM SOURCE) JOIN {word_stems_sql('SOURCE')} USING (word)
  WHERE NOT list_contains({STOPS_SQL}, word) GROUP BY query_id)"""
SENTENCES_SQL = f"""(
  SELECT CAST(item_id AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS query_id, s AS text
  FROM (SELECT item_id, unnest(string_split(text, '.')) AS s,
               generate_subscripts(string_split(text, '.'), 1) - 1 AS i FROM benchmark)
  WHERE regexp_matches(s, '[\\p{{L}}\\p{{N}}]'))"""
FULL_TERMS_SQL = TERMS_SQL.replace("SOURCE", "(SELECT item_id AS query_id, text FROM benchmark)")
SENTENCE_TERMS_SQL = TERMS_SQL.replace("SOURCE", SENTENCES_SQL)


def sentence_queries(spark, d):
    """Every sentence of the benchmark texts, as queries of all lengths."""
    sentences = table(spark, d, "benchmark").select(
        "item_id", F.posexplode(F.split("text", "[.]", -1)).alias("i", "text")
    )
    return sentences.where(F.col("text").rlike("[\\p{L}\\p{N}]")).select(
        F.concat_ws("-", "item_id", "i").alias("query_id"), "text"
    )


@query(
    "doc_keyword_search",
    f"SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM {keyword_sql(SENTENCE_TERMS_SQL, 20)}",
)
def _(spark, d):
    found = Q.keyword_search(sentence_queries(spark, d), chunks(spark, d))
    return found.withColumn("score", B.rounded("score"))


@query(
    "doc_passage_search",
    f"SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM {keyword_sql(FULL_TERMS_SQL, 20)}",
)
def _(spark, d):
    """Whole benchmark texts as queries: documents that hold every term of one."""
    found = Q.keyword_search(search_queries(spark, d), chunks(spark, d))
    return found.withColumn("score", B.rounded("score"))


def fusion_sql(vector: str, keyword: str, k: int) -> str:
    return f"""(
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
          SELECT query_id, chunk_id, v.rank AS vrank, k.rank AS krank,
                 coalesce(1::DOUBLE / (60 + v.rank), 0) + coalesce(1::DOUBLE / (60 + k.rank), 0) AS score
          FROM {vector} v FULL JOIN {keyword} k USING (query_id, chunk_id))) WHERE rank <= {k})"""


@query(
    "rrf_fusion",
    f"""SELECT query_id, chunk_id, vrank, krank, round(score, 6) AS score, rank
        FROM {fusion_sql(vector_sql('documents', 20), keyword_sql(FULL_TERMS_SQL, 20), 10)}""",
)
def _(spark, d):
    vector = _vector(spark, d, k=Q.CANDIDATES)
    keyword = Q.keyword_search(search_queries(spark, d), chunks(spark, d))
    return Q.rrf_fusion(vector, keyword, k=10).withColumn("score", B.rounded("score"))


ENGLISH_KEYWORD_SQL = keyword_sql(FULL_TERMS_SQL, 20, ENGLISH_SQL)


@query(
    "doc_hybrid_search",
    f"""SELECT query_id, chunk_id, vrank, krank, round(f.score, 6) AS score, rank, left(text, 100) AS snippet
        FROM {fusion_sql(vector_sql(ENGLISH_SQL, 20), ENGLISH_KEYWORD_SQL, 5)} f
        JOIN documents ON doc_id = chunk_id""",
)
def _(spark, d):
    rows = Q.prefilter(chunks(spark, d), species="en")
    found = Q.hybrid_search(
        embedded(search_queries(spark, d)), embedded(rows), score_digits=6, block_rows=4096
    )
    out = Q.with_snippets(found, rows)
    return out.select(
        "query_id", "chunk_id", "vrank", "krank", B.rounded("score").alias("score"), "rank", "snippet"
    )


@query(
    "scope_check",
    f"""WITH f AS (SELECT query_id, array_to_string(list_sort(list(DISTINCT lang)), '|') AS free_species
                   FROM {vector_sql('documents', 5)} JOIN documents ON doc_id = chunk_id GROUP BY 1),
        s AS (SELECT query_id, array_to_string(list_sort(list(DISTINCT lang)), '|') AS scoped_species
              FROM {vector_sql("(SELECT * FROM documents WHERE lang = 'fr')", 5)}
              JOIN documents ON doc_id = chunk_id GROUP BY 1)
        SELECT query_id, free_species, scoped_species, true AS scoped_single FROM f FULL JOIN s USING (query_id)""",
)
def _(spark, d):
    out = Q.scope_check(_vector(spark, d), _vector(spark, d, species="fr"), chunks(spark, d))
    return out.withColumns(
        {c: F.array_join(c, "|") for c in ("free_species", "scoped_species")}
    )


CATALOG_DOCS_SQL = "(SELECT * FROM documents WHERE source = 'src1')"


@query(
    "catalog_search",
    f"""SELECT query_id, chunk_id, vrank, krank, round(score, 6) AS score, rank
        FROM {fusion_sql(vector_sql(CATALOG_DOCS_SQL, 20), keyword_sql(FULL_TERMS_SQL, 20, CATALOG_DOCS_SQL), 5)}""",
)
def _(spark, d):
    """Fused search in one kind of documents."""
    queries, rows = embedded(search_queries(spark, d)), embedded(chunks(spark, d))
    found = Q.catalog_search(queries, rows, "src1", score_digits=6, block_rows=4096)
    return found.withColumn("score", B.rounded("score"))


def ingested(spark, d):
    """What ingest leaves for search: chunks with vectors and tokens, and the words of all of them."""
    done = K.embed_chunks(corpus_chunks(spark, d), WORDS_64)
    index = stored(Q.index_tokens(done), "corpus")
    return index, stored(Q.word_table(index), "words")


INGESTED_SQL = f"(SELECT chunk_id AS doc_id, text FROM {ANNOTATED_SQL})"
EMBEDDED_SQL = f"(SELECT chunk_id AS doc_id, header || chr(10) || text AS text FROM {ANNOTATED_SQL})"


@query(
    "corpus_search",
    f"""SELECT query_id, f.chunk_id, vrank, krank, round(f.score, 6) AS score, rank, section, source, left(text, 100) AS snippet
        FROM {fusion_sql(vector_sql(EMBEDDED_SQL, 20), keyword_sql(FULL_TERMS_SQL, 20, INGESTED_SQL), 5)} f
        JOIN {ANNOTATED_SQL} c ON c.chunk_id = f.chunk_id""",
)
def _(spark, d):
    """From cleaned documents to answers: ingest writes vectors, tokens and words once, search reads them."""
    index, words = ingested(spark, d)
    asked = embedded(search_queries(spark, d))
    found = Q.hybrid_search(asked, index, vocabulary=words, score_digits=6, block_rows=4096)
    out = Q.with_snippets(found, index)
    return out.select(
        "query_id", "chunk_id", "vrank", "krank", B.rounded("score").alias("score"), "rank", "section", "source", "snippet"
    )
