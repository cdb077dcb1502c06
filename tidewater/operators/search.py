"""Filtered vector, keyword and fused search for a table of queries."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewater.functions.ordered import keep_top
from tidewater.functions.stems import with_stem
from tidewater.functions.text import words
from tidewater.operators.similarity import nearest
from tidewater.session import stored

# fixed values: answer length, candidates per channel, rank constant of the fusion, snippet length
TOP_K = 5
CANDIDATES = 20
RRF_K = 60
SNIPPET = 100

# fixed values: English words that carry no search meaning
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being "
    "below between both but by can did do does doing don down during each few for from further "
    "had has have having he her here hers herself him himself his how i if in into is it its "
    "itself just me more most my myself no nor not now of off on once only or other our ours "
    "ourselves out over own s same she should so some such t than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with you your yours yourself yourselves"
).split()


def prefilter(
    chunks: DataFrame, species: str | None = None, doc_type: str | None = None,
    embedder_ver: str | None = None,
) -> DataFrame:
    """Metadata filter that runs before any ranking, shared by both channels."""
    out = chunks
    if embedder_ver is not None:
        out = out.where(F.col("embedder_ver") == embedder_ver)
    if species is not None:
        out = out.where(F.array_contains("species", species))
    if doc_type is not None:
        out = out.where(F.col("doc_type") == doc_type)
    return out


def vector_search(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, **blocks) -> DataFrame:
    """``query_id, chunk_id, score, rank`` of the ``k`` nearest chunks by cosine.

    queries: ``query_id, embedding``; chunks: ``chunk_id, embedding``.
    """
    gallery = chunks.select(
        F.col("chunk_id").alias("image_id"), F.lit(0).alias("individual_id"), "embedding"
    )
    found = nearest(queries, gallery, k, **blocks)
    return found.select("query_id", F.col("image_id").alias("chunk_id"), "score", "rank")


def index_tokens(chunks: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Chunks with the token columns that ingest writes once.

    ``kept`` are the search terms in order, ``terms`` the distinct ones,
    ``words`` all words as one line (for phrases), ``n_words`` the text length.
    """
    split = chunks.withColumn("_w", words(F.col("text")))
    kept = split.withColumn("kept", F.filter("_w", lambda w: ~w.isin(list(stop_words))))
    return kept.withColumns(
        {
            "terms": F.array_distinct("kept"),
            "words": F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")),
            "n_words": F.greatest(F.size("kept"), F.lit(1)),
        }
    ).drop("_w")


def parse_queries(queries: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Query text to alternatives: required terms, phrases and excluded terms.

    The web search form: bare terms are all required, ``"..."`` is a phrase,
    ``or`` separates alternatives, a leading ``-`` excludes a term.
    """
    lower = F.lower("text")
    phrases = F.regexp_extract_all(F.col("alt"), F.lit('"([^"]*)"'), F.lit(1))
    bare = F.regexp_replace("alt", r'"[^"]*"', " ")
    minus = r"(?:^|\s)-([\p{L}\p{N}]+)"
    excluded = F.regexp_extract_all(bare, F.lit(minus), F.lit(1))
    positive = F.regexp_replace(bare, minus, " ")
    stops = F.array(*[F.lit(w) for w in stop_words])
    return (
        queries.select("query_id", F.posexplode(F.split(lower, r"\sor\s")).alias("alt_no", "alt"))
        .select(
            "query_id",
            "alt_no",
            F.array_except(F.array_union(words(positive), words(F.array_join(phrases, " "))), stops)
            .alias("required"),
            F.filter(
                F.transform(phrases, lambda p: F.array_join(words(p), " ")),
                lambda p: F.length(p) > 0,
            ).alias("phrases"),
            F.array_except(excluded, stops).alias("excluded"),
        )
        .where(F.size("required") > 0)
    )


def word_table(index: DataFrame) -> DataFrame:
    """``word, df, stem`` of every term of an index: what ingest writes next to it, once.

    Stems are computed per different word, not per occurrence.
    """
    terms = index.select(F.explode_outer("terms").alias("word")).where("word is not null")
    return with_stem(terms.groupBy("word").agg(F.count(F.lit(1)).alias("df")))


_ANY_WORD = "[^ ]+"


def _asked(queries: DataFrame, vocabulary: DataFrame, stop_words: list[str]) -> DataFrame:
    """Alternatives of all queries with the words of the index that their stems stand for.

    ``needs``: for each required term its document frequency and its words, rarest first; ``excluded``:
    words that must not occur; ``phrases``: patterns over a line of words, in which a stop
    word is any word. Alternatives with a term that no text holds are left out.
    """
    kind = lambda name, listed: F.transform(
        listed, lambda w, i: F.struct(F.lit(name).alias("kind"), i.alias("no"), F.lit(0).alias("at"), w.alias("word"))
    )
    in_phrase = lambda p, i: F.transform(
        F.split(p, " "), lambda w, j: F.struct(F.lit("phrase").alias("kind"), i.alias("no"), j.alias("at"), w.alias("word"))
    )
    listed = F.concat(kind("need", F.col("required")), kind("not", F.col("excluded")), F.flatten(F.transform("phrases", in_phrase)))
    parts = parse_queries(queries, stop_words).select("query_id", "alt_no", F.explode(listed).alias("p")).select("query_id", "alt_no", "p.*")
    stems = with_stem(parts.select("word").distinct())
    known = (
        vocabulary.join(stems.select("stem").distinct(), "stem")
        .groupBy("stem")
        .agg(F.array_sort(F.collect_list("word")).alias("variants"), F.sum("df").alias("df"))
    )
    found = parts.join(stems.join(known, "stem", "left").drop("stem"), "word", "left")
    stop = F.col("word").isin(list(stop_words))
    pattern = F.when(stop, F.lit(_ANY_WORD)).otherwise(F.concat(F.lit("(?:"), F.array_join("variants", "|"), F.lit(")")))
    is_kind = lambda name, value: F.when(F.col("kind") == name, value)
    by_part = found.groupBy("query_id", "alt_no", "kind", "no").agg(
        F.first("variants").alias("variants"),
        F.first("df").alias("df"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("at", pattern.alias("pattern")))), lambda x: x["pattern"]), " "
        ).alias("pattern"),
    )
    ends = rf"^(?:{re.escape(_ANY_WORD)} )+|(?: {re.escape(_ANY_WORD)})+$"
    line = F.concat(F.lit(" "), F.regexp_replace("pattern", ends, ""), F.lit(" "))
    return (
        by_part.groupBy("query_id", "alt_no")
        .agg(
            F.array_sort(F.collect_list(is_kind("need", F.struct("df", "variants")))).alias("needs"),
            F.flatten(F.collect_list(is_kind("not", F.col("variants")))).alias("excluded"),
            F.collect_list(is_kind("phrase", line)).alias("phrases"),
        )
        .where(F.forall("needs", lambda n: n["variants"].isNotNull()))
    )


def keyword_search(
    queries: DataFrame,
    chunks: DataFrame,
    cand: int = CANDIDATES,
    salt: int = 16,
    vocabulary: DataFrame | None = None,
    stop_words: list[str] = STOP_WORDS,
) -> DataFrame:
    """``query_id, chunk_id, score, rank``: chunks with all required terms of a query.

    A term is found in every form of its English stem. Each alternative is driven by its
    rarest term: only the postings of that term's words are joined, and the remaining
    terms are tested against the chunk's own words, counted once. Postings are salted, so a term
    found in a third of all chunks is spread over ``salt`` tasks. Score: term frequency
    over text length. Chunks without token columns are indexed into the shared folder
    first; ``vocabulary`` is their :func:`word_table`, if it is stored.
    """
    index = chunks if "terms" in chunks.columns else stored(index_tokens(chunks, stop_words), "tokens")
    asked = stored(_asked(queries, word_table(index) if vocabulary is None else vocabulary, stop_words), "asked")
    rarest = asked.select("query_id", "alt_no", F.explode(F.col("needs")[0]["variants"]).alias("term"))
    asked_by = rarest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    postings = index.select("chunk_id", F.explode_outer("terms").alias("term")).where("term is not null")
    salted = postings.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(salt)).cast("int"))
    candidates = salted.join(asked_by, ["term", "salt"]).drop("salt", "term")
    scored = _matched(candidates, asked, index).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return keep_top(scored, ranked, cand)


_FORMS_KEPT = 100_000  # terms with their forms that a task remembers


def _matched(candidates: DataFrame, asked: DataFrame, index: DataFrame) -> DataFrame:
    """``query_id, chunk_id, score`` of the candidates whose chunk passes the whole alternative.

    The rows of a chunk come before its candidates, so its words are counted once and the forms
    of a term are looked up once per chunk, however long it is and however many ask for them.
    A chunk that comes in several rows is tested row by row. Words hold letters and digits
    only, so an alternative travels as one text: needed terms, rarest first, are parted by
    spaces, their forms by bars.
    """
    listed = lambda c: F.array_join(F.transform(c, lambda n: F.array_join(n["variants"], "|")), " ")
    alternatives = asked.select(
        "query_id", "alt_no", listed(F.col("needs")).alias("needs"), F.array_join("excluded", " ").alias("excluded"),
        F.array_join("phrases", "\n").alias("phrases"),
    )
    words_of = ["chunk_id", "kept", "words", "n_words"]
    held = index.withColumn("kept", F.array_join("kept", " ")).select(*words_of).where("chunk_id is not null")
    pairs = candidates.join(alternatives, ["query_id", "alt_no"]).drop("alt_no").where("chunk_id is not null")
    empty = lambda df, names: {c: F.lit(None).cast(df.schema[c].dataType) for c in names}
    own = ["query_id", "needs", "excluded", "phrases"]
    both = held.withColumns(empty(pairs, own)).unionByName(pairs.withColumns(empty(held, words_of[1:])))
    ordered = both.withColumn("asks", F.col("query_id").isNotNull()).repartition("chunk_id").sortWithinPartitions("chunk_id", "asks")
    out = StructType([index.schema["chunk_id"], asked.schema["query_id"], StructField("score", DoubleType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms: dict[str, frozenset] = {}
        here, rows = None, []

        def times(need: str, counts: Counter, seen: dict[str, int]) -> int:
            """How often the forms of a term occur in a chunk."""
            if need not in seen:
                if need not in forms:
                    if len(forms) >= _FORMS_KEPT:
                        forms.clear()
                    forms[need] = frozenset(need.split("|"))
                seen[need] = sum(map(counts.__getitem__, counts.keys() & forms[need]))
            return seen[need]

        for batch in batches:
            chunk, asks = batch.column("chunk_id").to_pylist(), batch.column("asks").to_pylist()
            query, needs, excluded, phrases = (batch.column(c).to_pylist() for c in own)
            kept, words, n_words = (batch.column(c) for c in words_of[1:])
            found: list[tuple] = []
            for i, id in enumerate(chunk):
                if not asks[i]:
                    if id != here:
                        here, rows = id, []
                    rows.append((Counter((kept[i].as_py() or "").split()), {}, words[i].as_py(), n_words[i].as_py()))
                    continue
                if id != here:
                    continue
                terms, without = needs[i].split(" "), excluded[i].split()
                for counts, seen, line, size in rows:
                    if not all(times(n, counts, seen) for n in terms[1:]) or any(w in counts for w in without):
                        continue
                    if phrases[i] and not all(re.search(p, line) for p in phrases[i].split("\n")):
                        continue
                    found.append((id, query[i], sum(times(n, counts, seen) for n in dict.fromkeys(terms)) / size))
            if found:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*found), schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return ordered.mapInArrow(run, out)


def rrf_fusion(vector: DataFrame, keyword: DataFrame, k: int = TOP_K, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists per query."""
    both = vector.select("query_id", "chunk_id", F.col("rank").alias("vrank")).join(
        keyword.select("query_id", "chunk_id", F.col("rank").alias("krank")),
        ["query_id", "chunk_id"],
        "full_outer",
    )
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    fused = both.withColumn("score", part("vrank") + part("krank"))
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return keep_top(fused, ranked, k)


def hybrid_search(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = TOP_K,
    cand: int = CANDIDATES,
    vocabulary: DataFrame | None = None,
    **blocks,
) -> DataFrame:
    """Vector and keyword candidates over the same filtered chunks, fused by rank.

    queries: ``query_id, text, embedding``; chunks: ``chunk_id, text, embedding``,
    with the token columns if they are stored. ``vocabulary`` may be that of all
    chunks, filtered or not: it finds the forms of a term, the chunks decide.
    """
    vector = vector_search(queries.select("query_id", "embedding"), chunks, cand, **blocks)
    plain = chunks.drop("embedding")
    keyword = keyword_search(queries.select("query_id", "text"), plain, cand, vocabulary=vocabulary)
    return rrf_fusion(vector, keyword, k)


def catalog_search(
    queries: DataFrame, chunks: DataFrame, doc_type: str, k: int = TOP_K, **blocks
) -> DataFrame:
    """Fused search inside one kind of document."""
    return hybrid_search(queries, prefilter(chunks, doc_type=doc_type), k, **blocks)


def with_snippets(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Metadata and the first characters of each found chunk."""
    cards = chunks.select(
        "chunk_id", "species", "section", "source", "year",
        F.left("text", F.lit(SNIPPET)).alias("snippet"),
    )
    return found.join(cards, "chunk_id")


def scope_check(free: DataFrame, scoped: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct species found per query without and with the species filter."""
    kinds = chunks.select("chunk_id", F.explode("species").alias("kind"))
    arm = lambda df, name: (
        df.join(kinds, "chunk_id")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_set("kind")).alias(name))
    )
    joined = arm(free, "free_species").join(arm(scoped, "scoped_species"), "query_id", "full_outer")
    return joined.withColumn("scoped_single", F.size("scoped_species") <= 1)
