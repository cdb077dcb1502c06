"""Document text to cleaned text, sections, chunks and corpus rows.

The whole pipeline is narrow: headings, sections and chunk numbers are computed
inside the row of their document, so no step needs a shuffle.

Arrays are exploded with the ``outer`` form and the empty rows dropped after it:
the plain form lets the optimizer copy the whole array expression into a filter
on its size, which evaluates every regular expression twice or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import clean_lines, heading_pattern, strip
from tidewater.operators.embedders import Embedder, embed_rows

# fixed values: section headings and the subject they are kept under (None: dropped)
SECTION_HEADINGS: dict[str, str | None] = {
    "STOCK DEFINITION AND GEOGRAPHIC RANGE": "STOCK",
    "POPULATION SIZE": "STOCK",
    "CURRENT AND MAXIMUM NET PRODUCTIVITY RATES": None,
    "POTENTIAL BIOLOGICAL REMOVAL": None,
    "HUMAN-CAUSED MORTALITY AND SERIOUS INJURY": "MORTALITY",
    "Fishery Information": None,
    "REFERENCES": None,
    "Vessel Strikes": "MORTALITY",
    "Other human-caused mortality and serious injury": "MORTALITY",
    "Habitat Concerns": "MORTALITY",
    "STATUS OF STOCK": "STOCK",
}

# fixed values: file name, species, stock label, year of revision
REPORT_FILES: tuple[tuple[str, str, str, int], ...] = (
    ("blue-whale-enp-2023.pdf", "Blue Whale", "Eastern North Pacific", 2024),
    ("fin-whale-caorwa-2023.pdf", "Fin Whale", "California Oregon Washington ", 2024),
    ("gray-whale-eastern-np-2020.pdf", "Gray Whale", "Eastern North Pacific", 2021),
    ("humpback-caorwa-2021.pdf", "Humpback Whale", "California Oregon Washington", 2022),
    (
        "humpback-casmex-dps-2022.pdf",
        "Humpback Whale",
        "Central America / Southern Mexico - California Oregon Washington",
        2023,
    ),
    ("killer-whale-enp-2024.pdf", "Killer Whale", "Eastern Pacific Southern Resident", 2024),
    (
        "killer-whale-southern-resident-2021.pdf",
        "Killer Whale",
        "Eastern North Pacific Southern Resident",
        2022,
    ),
    ("sperm-whale-caorwa-2023.pdf", "Sperm Whale", "California Oregon Washington", 2024),
)

# fixed values: chunk size in characters, share of overlap
CHUNK_SIZE = 512
CHUNK_OVERLAP = 0.2


def clean_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn(text, clean_lines(F.col(text)))


def _heading_list(text: Column, headings: dict[str, str | None]) -> Column:
    """Found headings of a text as ``(start, ordinal, heading, subject, after)``, by position."""
    known = [
        F.struct(
            F.regexp_instr(text, F.lit(heading_pattern(heading))).alias("start"),
            F.lit(i).alias("ordinal"),
            F.lit(heading).alias("heading"),
            F.lit(subject).cast("string").alias("subject"),
            F.lit(heading_pattern(heading)).alias("pattern"),
        )
        for i, (heading, subject) in enumerate(headings.items())
    ]
    found = F.filter(F.array(*known), lambda h: h["start"] > 0)

    def measured(h: Column) -> Column:
        # the pattern matches where the rest of the text starts, so this is one short match
        rest = F.substring(text, h["start"], F.length(text))
        matched = F.regexp_substr(rest, h["pattern"])
        return F.struct(
            h["start"].alias("start"),
            h["ordinal"].alias("ordinal"),
            h["heading"].alias("heading"),
            h["subject"].alias("subject"),
            (h["start"] + F.length(matched)).alias("after"),
        )

    return F.array_sort(F.transform(found, measured))


def heading_index(docs: DataFrame, headings: dict[str, str | None] = SECTION_HEADINGS) -> DataFrame:
    """First position of every known heading found in each document (1-based)."""
    listed = docs.select("doc_id", F.explode_outer(_heading_list(F.col("text"), headings)).alias("h"))
    return listed.where("h is not null").select("doc_id", "h.heading", "h.start")


def _section_list(text: Column, found: Column) -> Column:
    """Bodies between headings; the last section ends with the text."""

    def section(h: Column, i: Column) -> Column:
        following = F.try_element_at(found, i + 2)["start"]
        end = F.coalesce(following, F.length(text) + 1)
        body = F.substring(text, h["after"], F.greatest(end - h["after"], F.lit(0)))
        return F.struct(
            h["heading"].alias("section"),
            h["subject"].alias("subject"),
            h["start"].alias("start"),
            end.alias("stop"),
            strip(body).alias("body"),
        )

    return F.transform(found, section)


def section_spans(docs: DataFrame, headings: dict[str, str | None] = SECTION_HEADINGS) -> DataFrame:
    """Start and end of every section, kept or not."""
    found = docs.withColumn("_h", _heading_list(F.col("text"), headings))
    listed = found.select(
        "doc_id", F.explode_outer(_section_list(F.col("text"), F.col("_h"))).alias("s")
    )
    return listed.where("s is not null").select("doc_id", "s.section", "s.start", "s.stop")


def section_split(docs: DataFrame, headings: dict[str, str | None] = SECTION_HEADINGS) -> DataFrame:
    """Kept sections of each document as an array column ``sections``."""
    found = docs.withColumn("_h", _heading_list(F.col("text"), headings))
    sections = F.filter(
        _section_list(F.col("text"), F.col("_h")), lambda s: s["subject"].isNotNull()
    )
    return found.withColumn("sections", sections).drop("_h")


def _pieces(text: str, start: int, stop: int, separators: tuple[str, ...]) -> tuple[list, tuple]:
    """Spans split before each occurrence of the first separator that occurs."""
    for i, separator in enumerate(separators):
        if separator == "":
            return [(p, p + 1) for p in range(start, stop)], ()
        at = text.find(separator, start, stop)
        if at < 0:
            continue
        cuts = [start]
        while at >= 0:
            cuts.append(at)
            at = text.find(separator, at + len(separator), stop)
        cuts.append(stop)
        return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a], separators[i + 1 :]
    return [(start, stop)], ()


def _windows(spans: list, size: int, overlap: int) -> list:
    """Greedy runs of adjacent spans up to ``size``, sharing up to ``overlap`` characters."""
    runs, head = [], 0
    for i, (a, b) in enumerate(spans):
        if i > head and b - spans[head][0] > size:
            runs.append((spans[head][0], a))
            while head < i and (a - spans[head][0] > overlap or b - spans[head][0] > size):
                head += 1
    if spans:
        runs.append((spans[head][0], spans[-1][1]))
    return runs


def split_text(
    text: str,
    size: int = CHUNK_SIZE,
    overlap: int | None = None,
    separators: tuple[str, ...] = ("\n\n", "\n", " ", ""),
) -> list[tuple[int, str]]:
    """Recursive character split of one text: ``(offset, chunk)`` in order.

    Works on spans of the text: adjacent short pieces are merged up to ``size``;
    a piece that is too long is split again by the next separator.
    """
    overlap = int(size * CHUNK_OVERLAP) if overlap is None else overlap
    out: list[tuple[int, str]] = []

    def emit(spans: list) -> None:
        for a, b in _windows(spans, size, overlap):
            body = text[a:b]
            kept = body.strip()
            if kept:
                out.append((a + len(body) - len(body.lstrip()), kept))

    def walk(start: int, stop: int, seps: tuple[str, ...]) -> None:
        spans, rest = _pieces(text, start, stop, seps)
        short: list = []
        for a, b in spans:
            if b - a < size:
                short.append((a, b))
                continue
            emit(short)
            short = []
            if rest:
                walk(a, b, rest)
            else:
                out.append((a, text[a:b]))
        emit(short)

    walk(0, len(text), separators)
    return out


def chunk_column(bodies: Column, size: int = CHUNK_SIZE, overlap: int | None = None) -> Column:
    """Chunks of an array of bodies: one array of ``(body_no, pos, text)`` per row."""

    @F.pandas_udf("array<struct<body_no:int,pos:int,text:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = []
            for listed in batch:
                row = []
                for no, body in enumerate(() if listed is None else listed):
                    row += [
                        {"body_no": no, "pos": pos, "text": text}
                        for pos, text in split_text(body or "", size, overlap)
                    ]
                rows.append(row)
            yield pd.Series(rows, index=batch.index, dtype=object)

    # not copied into filters by the optimizer, so every text is split once
    return run.asNondeterministic()(bodies)


def chunk_text(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int | None = None) -> DataFrame:
    """Chunks of whole documents: ``doc_id, chunk_no, pos, text``."""
    chunked = docs.withColumn("_chunks", chunk_column(F.array("text"), size, overlap))
    listed = chunked.select("doc_id", F.posexplode_outer("_chunks").alias("n", "c"))
    return listed.where("c is not null").select(
        "doc_id", (F.col("n") + 1).alias("chunk_no"), "c.pos", "c.text"
    )


def report_metadata(spark) -> DataFrame:
    """The file lookup table (a fixed handful of rows)."""
    return spark.createDataFrame(
        list(REPORT_FILES), "file string, species string, stock string, year int"
    )


def annotate(docs: DataFrame, metadata: DataFrame) -> DataFrame:
    """File metadata onto documents; a file without metadata fails the job.

    ``metadata`` has one row per corpus file (hand-written, far below a megabyte).
    """
    known = metadata.withColumn("_known", F.lit(True))
    joined = docs.join(known, "file", "left")
    # the check sits in a column that is used, so it cannot be pruned away
    failed = F.raise_error(F.concat(F.lit("no metadata for file "), F.col("file")))
    file = F.when(F.col("_known"), F.col("file")).otherwise(failed)
    return joined.withColumn("file", file).drop("_known")


def chunk_annotate(
    docs: DataFrame,
    metadata: DataFrame,
    headings: dict[str, str | None] = SECTION_HEADINGS,
    size: int = CHUNK_SIZE,
    tag: str = "SAR",
) -> DataFrame:
    """Cleaned documents ``doc_id, file, text`` to numbered, annotated chunks."""
    split = section_split(annotate(docs, metadata), headings)
    bodies = F.transform("sections", lambda s: s["body"])
    chunked = split.withColumn("_chunks", chunk_column(bodies, size))
    numbered = chunked.select(
        "file", "species", "stock", "year", "sections", F.posexplode_outer("_chunks").alias("_n", "_c")
    ).where("_c is not null")
    part = F.element_at("sections", F.col("_c.body_no") + 1)
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    header = F.concat(
        F.lit("["),
        F.concat_ws(" - ", "species", F.initcap(F.lower(part["subject"])), "stock"),
        F.lit(" — "),
        F.initcap(F.lower(part["section"])),
        F.lit("]"),
    )
    return numbered.select(
        F.concat_ws(".", stem, (F.col("_n") + 1).cast("string")).alias("chunk_id"),
        F.col("_c.text").alias("text"),
        header.alias("header"),
        F.array("species").alias("species"),
        F.lit(None).cast("string").alias("sanctuary"),
        F.lit(tag).alias("doc_type"),
        part["section"].alias("section"),
        "stock",
        F.col("file").alias("source"),
        "year",
    )


def embed_chunks(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """Embed header and body together; the stored text stays the bare body."""
    joined = chunks.withColumn("_in", F.concat_ws("\n", "header", "text"))
    return embed_rows(joined, embedder, "_in").drop("_in")


def heading_coverage(
    docs: DataFrame, headings: dict[str, str | None] = SECTION_HEADINGS
) -> DataFrame:
    """Matched and missing headings per document."""
    known = F.array(*[F.lit(h) for h in headings])
    matched = F.transform(_heading_list(F.col("text"), headings), lambda h: h["heading"])
    return docs.select("doc_id", matched.alias("_m")).select(
        "doc_id",
        F.size("_m").alias("n_matched"),
        F.lit(len(headings)).alias("n_known"),
        F.array_except(known, F.col("_m")).alias("missing"),
    )


def chunk_peek(chunks: DataFrame, width: int = 80) -> DataFrame:
    """Length, head and tail of every chunk."""
    return chunks.select(
        "chunk_id",
        "section",
        F.length("text").alias("n_chars"),
        F.left("text", F.lit(width)).alias("head"),
        F.right("text", F.lit(width)).alias("tail"),
    )


def alt_id_links(
    rows: DataFrame, key: str, remarks: str, pattern: str = r"([A-Z]+-[0-9]{2}[A-Z]+[0-9]+)"
) -> DataFrame:
    """Alternate catalog ids named in remarks, linked to the row's id."""
    ids = F.regexp_extract_all(F.col(remarks), F.lit(pattern), F.lit(1))
    return rows.select(key, F.explode(F.array_distinct(ids)).alias("alt_id")).distinct()


def zone_to_chunks(overlaps: DataFrame, chunks: DataFrame, totals: dict[str, Column] | None = None) -> DataFrame:
    """Chunks about the zones of each request (``request_id, zones``).

    With ``totals`` (aggregates of ``chunk_id`` by name) a request meets one row per zone
    with these instead of its chunks: they are worked out once per zone, not once per
    request, whose number times that of the chunks of a zone no cluster can list.
    """
    wanted = overlaps.select("request_id", F.explode_outer("zones").alias("sanctuary"))
    about = chunks.select("chunk_id", "sanctuary")
    if totals:
        about = about.groupBy("sanctuary").agg(*[c.alias(name) for name, c in totals.items()])
    return wanted.join(about, "sanctuary")
