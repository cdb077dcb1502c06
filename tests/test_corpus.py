"""Cleaning, sections, chunks, annotation and search on hand-made rows."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions.text import clean_lines
from tidewater.operators import corpus as K
from tidewater.operators import search as Q
from tidewater.operators.embedders import WORDS_64, embed_column, embed_rows, get_embedder, hashed_words


def cleaned(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(clean_lines(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("popula-\ntion size", "population size"),
        ("a-\nb-\nc", "ab-\nc"),
        ("é-\nà", "éà"),
        ("one\n\n  two \n 12 \nSize ..... 7\nthree...", "one\ntwo\nthree..."),
        ("a\r\nb c\x0bd", "a\nb\nc\nd"),
        (" x　", "x"),
        ("", ""),
    ],
)
def test_clean_lines(spark, text, want):
    assert cleaned(spark, text) == want


def test_split_text_golden():
    assert K.split_text("") == []
    assert K.split_text("short") == [(0, "short")]
    words = "one two three four five six"
    got = [c for _, c in K.split_text(words, size=10, overlap=4)]
    assert got == ["one two", "two three", "four five", "six"]
    assert [c for _, c in K.split_text("abcdefgh", size=3, overlap=1)] == ["abc", "cde", "efg", "gh"]
    assert [c for _, c in K.split_text("p1\n\np2\n\np3", size=7, overlap=0)] == ["p1\n\np2", "p3"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(4, 30))
def test_chunks_are_slices_that_cover_the_text(text, size):
    chunks = K.split_text(text, size, overlap=size // 5)
    covered = set()
    for pos, chunk in chunks:
        assert 0 < len(chunk) <= size
        assert text[pos : pos + len(chunk)] == chunk
        covered.update(range(pos, pos + len(chunk)))
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)


REPORT = """Stock Assessment
STOCK DEFINITION AND  GEOGRAPHIC RANGE
Whales feed here.
POPULATION SIZE
There are many.
Fishery Information
Not kept.
Vessel Strikes
Strikes were seen.
"""


@pytest.fixture()
def docs(spark):
    rows = [(1, "humpback-caorwa-2021.pdf", REPORT), (2, "blue-whale-enp-2023.pdf", "no headings at all")]
    return spark.createDataFrame(rows, "doc_id long, file string, text string")


def test_sections_use_the_matched_length(docs):
    out = K.section_split(docs).where("doc_id = 1").select(F.explode_outer("sections").alias("s")).select("s.*")
    assert {r.section: r.body for r in out.collect()} == {
        "STOCK DEFINITION AND GEOGRAPHIC RANGE": "Whales feed here.",
        "POPULATION SIZE": "There are many.",
        "Vessel Strikes": "Strikes were seen.",
    }


def test_heading_coverage(docs):
    out = {r.doc_id: r for r in K.heading_coverage(docs).collect()}
    assert (out[1].n_matched, out[1].n_known) == (4, 11)
    assert "REFERENCES" in out[1].missing and len(out[2].missing) == 11


def test_chunks_are_annotated_and_numbered(docs, spark):
    out = K.chunk_annotate(docs, K.report_metadata(spark)).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in out] == [f"humpback-caorwa-2021.{n}" for n in (1, 2, 3)]
    assert out[2].header == (
        "[Humpback Whale - Mortality - California Oregon Washington — Vessel Strikes]"
    )
    assert (out[0].year, out[0].species, out[0].sanctuary) == (2022, ["Humpback Whale"], None)


def test_unknown_file_fails(spark):
    docs = spark.createDataFrame([(1, "other.pdf", REPORT)], "doc_id long, file string, text string")
    with pytest.raises(Exception, match="no metadata for file other.pdf"):
        K.chunk_annotate(docs, K.report_metadata(spark)).collect()


def test_embedders(spark):
    with pytest.raises(KeyError):
        get_embedder("nope")
    assert get_embedder("hashed-words-64").width == 64
    rows = spark.createDataFrame([(1, "a b"), (2, "..."), (3, None)], "id long, t string")
    out = embed_rows(rows, WORDS_64, "t").collect()  # unreadable inputs are skipped
    assert [(r.id, len(r.embedding), r.embedder_ver) for r in out] == [(1, 64, "hashed-words-64")]
    assert hashed_words(["A b"], 64)[0].tolist() == hashed_words(["b, a!"], 64)[0].tolist()


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, "Ship strikes kill whales near the shipping lanes", ["blue"], "SAR"),
        (2, "Whales whales and more whales", ["humpback"], "SAR"),
        (3, "Entanglement in gear harms whales", ["humpback"], "CR"),
        (4, "Lanes for shipping", ["blue"], "CR"),
    ]
    return spark.createDataFrame(rows, "chunk_id long, text string, species array<string>, doc_type string")


def ask(spark, chunks, text):
    query = spark.createDataFrame([(1, text)], "query_id long, text string")
    return [r.chunk_id for r in Q.keyword_search(query, chunks).orderBy("rank").collect()]


def test_keyword_search_forms(spark, chunks):
    assert ask(spark, chunks, "whales") == [2, 3, 1]  # by frequency over length
    assert ask(spark, chunks, "the whales strikes") == [1]  # stop words do not count, all terms do
    assert ask(spark, chunks, "whales -strikes -gear") == [2]
    assert ask(spark, chunks, '"shipping lanes"') == [1]
    assert ask(spark, chunks, "entanglement or lanes") == [4, 3, 1]
    assert ask(spark, chunks, "the of and") == []
    assert ask(spark, chunks, "unseen whales") == []
    assert ask(spark, chunks, '"shipping of lane"') == [] and ask(spark, chunks, '"lane for ship"') == [4]


def test_keyword_search_finds_all_forms_of_a_stem(spark, chunks):
    assert ask(spark, chunks, "ship strike") == ask(spark, chunks, "ships striking") == [1]
    assert ask(spark, chunks, "harming whaling") == [3]
    assert ask(spark, chunks, '"ship strike" -entangled') == [1] and ask(spark, chunks, "whale -killed -entangling") == [2]
    index = Q.index_tokens(chunks)
    table = {r.word: (r.df, r.stem) for r in Q.word_table(index).collect()}
    assert table["whales"] == (3, "whale") and table["shipping"] == (2, "ship")
    query = spark.createDataFrame([(1, "whale")], "query_id long, text string")
    stored = Q.keyword_search(query, index, vocabulary=Q.word_table(index))
    assert [r.chunk_id for r in stored.orderBy("rank").collect()] == [2, 3, 1]


def test_keyword_search_equals_brute_force_on_a_hot_term(spark):
    rng = random.Random(2)
    vocabulary = ["hot"] * 6 + [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 12))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    asked = [["hot"], ["hot", "w3"], ["w1", "w2"], ["hot", "w5", "w6"]]
    queries = spark.createDataFrame(
        [(i, " ".join(t)) for i, t in enumerate(asked)], "query_id long, text string"
    )
    got = {(r.query_id, r.chunk_id): r.score for r in Q.keyword_search(queries, docs, cand=1000).collect()}
    want = {}
    for i, terms in enumerate(asked):
        for j, text in enumerate(texts):
            tokens = text.split()
            if all(t in tokens for t in terms):
                want[i, j] = sum(tokens.count(t) for t in terms) / len(tokens)
    assert got == pytest.approx(want)


def test_hybrid_fuses_by_rank_and_respects_the_filter(spark, chunks):
    embedded = chunks.withColumn("embedding", embed_column(WORDS_64, F.col("text")))
    query = spark.createDataFrame([(1, "whales strikes")], "query_id long, text string")
    query = query.withColumn("embedding", embed_column(WORDS_64, F.col("text")))
    out = Q.hybrid_search(query, embedded).orderBy("rank").collect()
    assert out[0].chunk_id == 1 and out[0].krank == 1
    assert out[0].score == pytest.approx(1 / (60 + out[0].vrank) + 1 / 61)
    scoped = Q.hybrid_search(query, Q.prefilter(embedded, species="humpback")).collect()
    assert {r.chunk_id for r in scoped} == {2, 3} and all(r.krank is None for r in scoped)
    both = Q.prefilter(embedded, species="humpback", doc_type="CR")
    assert [r.chunk_id for r in Q.hybrid_search(query, both).collect()] == [3]


def test_alt_ids(spark):
    rows = spark.createDataFrame(
        [(1, "Also formerly RCHP-11RUCO868 and RCHP-13RUCO1338"), (2, "none")], "id long, remarks string"
    )
    out = K.alt_id_links(rows, "id", "remarks").collect()
    assert sorted(r.alt_id for r in out) == ["RCHP-11RUCO868", "RCHP-13RUCO1338"]


def test_keyword_search_counts_the_words_of_a_chunk_once(spark):
    rows = [("a", "Storm storms calm " * 40), ("a", "storm quiet"), ("b", "calm storm"), ("c", None), (None, "storm calm")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "storm calm"), (2, 'calm "calm storm" -quiet'), (None, "storm")], "query_id long, text string")
    found = Q.keyword_search(queries, chunks)
    assert {(r.query_id, r.chunk_id, round(r.score, 6)) for r in found.collect()} == {(1, "a", 1.0), (1, "b", 1.0), (2, "a", 1.0), (2, "b", 1.0)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "arrays_overlap" not in plan  # the arrays of a chunk are not walked once per candidate
