"""Scans, write rules, catalog, habitat and ingest on hand-made rows."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewater.operators import catalog as C
from tidewater.operators import habitat as H
from tidewater.operators import usage as U
from tidewater.operators.embedders import WORDS_64
from tidewater.operators.ingest import embed_pending, flag_unreadable, pending
from tidewater.sources import scans, schemas, sinks


def test_download_tasks_are_trimmed(spark, tmp_path):
    (tmp_path / "tasks.csv").write_text(" 12 , 7,  http://x/7.jpg\n13,8,http://x/8.jpg \n")
    out = scans.download_tasks(spark, str(tmp_path / "tasks.csv")).orderBy("individual_id").collect()
    assert [tuple(r) for r in out] == [("12", "7", "http://x/7.jpg"), ("13", "8", "http://x/8.jpg")]


def test_image_listing_and_unreadable_files(spark, tmp_path):
    good = b"\xff\xd8\xff\xe0" + b"\x00" * 20 + b"\xff\xd9"
    for who, name, body in (("4", "41", good), ("4", "42", good[:10]), ("5", "51", b"<html>")):
        (tmp_path / who).mkdir(exist_ok=True)
        (tmp_path / who / f"{name}.jpg").write_bytes(body)
    (tmp_path / "readme.txt").write_text("x")
    files = scans.image_listing(spark, str(tmp_path), with_content=True)
    assert {(r.individual_id, r.sighting_id) for r in files.collect()} == {(4, 41), (4, 42), (5, 51)}
    manifest = files.select("sighting_id", "individual_id", "asset_ref", F.lit("ok").alias("status"))
    first = flag_unreadable(manifest, files)
    assert {r.sighting_id: r.status for r in first.collect()} == {41: "ok", 42: "corrupt", 51: "corrupt"}
    again = flag_unreadable(first.drop("changed"), files)
    assert again.where("changed").count() == 0


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, batch int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2), (3, "e", 3)], "k long, v string, batch int")
    once = sinks.upsert_latest(old, new, ["k"], "batch")
    twice = sinks.upsert_latest(once, new, ["k"], "batch")
    want = [(1, "a", 1), (2, "c", 2), (3, "e", 3)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))


def test_conditional_update_runs_once(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, "ok"), (3, "failed")], "id long, status string")
    bad = spark.createDataFrame([(2,), (3,), (2,)], "id long")
    first = sinks.conditional_update(rows, bad, "id", "status", "ok", "corrupt")
    assert {r.id: (r.status, r.changed) for r in first.collect()} == {
        1: ("ok", False), 2: ("corrupt", True), 3: ("failed", False)
    }


def test_frozen_seed_manifest_and_json(spark, tmp_path):
    one, two = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "a int")
    sinks.seed_once(one, str(tmp_path / "seed"))
    sinks.seed_once(two, str(tmp_path / "seed"))
    assert spark.read.parquet(str(tmp_path / "seed")).first().a == 1
    sinks.write_frozen(one, str(tmp_path / "split"))
    sinks.write_frozen(two, str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split")).first().a == 2
    manifest = spark.createDataFrame([(1, 2, "a", "u", "ok")], schemas.MANIFEST)
    sinks.write_manifest(manifest, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).first().status == "ok"
    cases = spark.sql("select 'c' as case_id, struct(1 as a) as input, struct(2 as b) as expected, array('t') as tags")
    row = sinks.export_cases(cases).first()
    assert (json.loads(row.input), json.loads(row.expected), row.tags) == ({"a": 1}, {"b": 2}, '["t"]')


RAW = "row_id string, organism_id string, scientific_name string, date_time string, latitude double, longitude double, license string"


def test_catalog_build(spark):
    url = "https://x/individual/"
    rows = [
        ("1", url + "7", "hump", "2020-01-02", 1.0, 2.0, "https://creativecommons.org/by"),
        ("2", url + "7", "gray", "", 1.0, 2.0, "https://creativecommons.org/by"),
        ("3", url + "7", "gray", "not a date", 1.0, 2.0, "publicdomain/zero"),
        ("4", url + "8", "hump", "2020-01-02", 1.0, 2.0, None),
        ("5", url + "8", "hump", "2020-01-02", 1.0, 2.0, "closed"),
        ("6", None, "hump", "2020-01-02", 1.0, 2.0, "https://creativecommons.org/by"),
        ("7", url + "x", "hump", "2020-01-02", 1.0, 2.0, "https://creativecommons.org/by"),
    ]
    raw = spark.createDataFrame(rows, RAW)
    hub = C.hub_derive(C.build_sightings(raw)).collect()
    assert [(r.individual_id, r.species, r.n_sightings, str(r.first_seen)) for r in hub] == [
        (7, "gray", 3, "2020-01-02")
    ]
    report = C.build_catalog_report(raw).first()
    assert (report.raw_rows, report.sightings, report.no_individual, report.no_license, report.closed_license) == (
        7, 3, 2, 1, 1
    )


def test_mode_ties_take_the_smallest(spark):
    rows = spark.createDataFrame(
        [(1, "b", None), (1, "a", None), (2, None, None)], "individual_id long, species string, obs_date date"
    )
    assert {r.individual_id: r.species for r in C.hub_derive(rows).collect()} == {1: "a", 2: None}


def test_license_rules(spark):
    rows = spark.createDataFrame([("by/4.0",), ("by-nd/4.0",), (None,)], "license string")
    assert rows.where(C.license_not_denied(F.col("license"))).count() == 1


def test_filters_ignore_missing_columns(spark):
    rows = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"])], "id long, species_list array<string>")
    where = C.filters_where(available=rows.columns, species=["y"], region=(0, 1, 0, 1), source=["s"])
    assert [r.id for r in rows.where(where).collect()] == [1]


SIGHT = "individual_id long, sighting_id long, obs_date date, lat double, lon double, provider string, thumb_url string"


@pytest.fixture(scope="module")
def sightings(spark):
    rows = [(1, i, f"2020-01-{i + 1:02d}" if i else None, 10.0 + i, 20.0 - i, "p", f"t{i}") for i in range(20)]
    rows += [(2, 100, None, 1.0, 2.0, None, None), (3, 200, "2020-05-05", None, None, "p", "t")]
    return spark.createDataFrame(rows, SIGHT.replace("obs_date date", "obs_date string")).withColumn(
        "obs_date", F.to_date("obs_date")
    )


def test_core_range(sightings):
    out = {r.individual_id: r for r in H.core_bbox(sightings).collect()}
    assert set(out) == {1, 2}
    assert (out[1].lat_min, out[1].lat_max) == (10.0 + int((1 - 0.9) / 2 * 20), 29.0)
    full = H.core_bbox(sightings, core_pct=1.0).where("individual_id = 1").first()
    extent = H.full_extent(sightings).where("individual_id = 1").first()
    assert (full.lat_min, full.lat_max) == (extent.lat_min, extent.lat_max) == (10.0, 29.0)


def test_lookup_answers_every_request(spark, sightings):
    people = spark.createDataFrame(
        [(1, "n1", "common", None, None), (2, None, None, None, None), (3, "n3", None, None, None)],
        "individual_id long, name string, common_name string, first_seen date, last_seen date",
    )
    requests = spark.createDataFrame([(1,), (2,), (3,), (9,)], "individual_id long")
    out = {r.individual_id: r for r in H.sighting_lookup(requests, sightings, people).collect()}
    assert out[1].ok and out[1].name == "common" and len(out[1].citations) == 10
    assert out[1].citations[0].locator == "t1"  # oldest first, unknown dates last
    assert "20 sightings of common (2020-01-02–2020-01-20)" in out[1].summary
    assert "1 sightings of individual 2 (dates unknown)" in out[2].summary
    assert [(out[i].ok, out[i].summary) for i in (3, 9)] == [(False, "No sightings for this individual")] * 2


def test_history_numbers_unknown_dates_last(sightings):
    out = {r.sighting_id: r.seq for r in H.sighting_history(sightings).where("individual_id = 1").collect()}
    assert out[1] == 1 and out[0] == 20 and len(out) == 20


def test_environment_reads_the_published_paths(spark):
    doc = {
        "BATH": {"ETOPO1": "-87"}, "SST": {"OISST": {"DAY": 14.2}},
        "ZONE": {"LME": [{"LME_NAME": "California Current"}], "WDPA": [{"NAME": "Bay"}]},
    }
    rows = spark.createDataFrame([("1", json.dumps(doc)), ("2", "{}"), ("3", "broken")], "row_id string, oceano string")
    out = {r.source_row_id: r for r in H.environment(rows).collect()}
    assert tuple(out["1"])[1:] == (-87.0, 14.2, "California Current", "Bay")
    assert tuple(out["2"])[1:] == tuple(out["3"])[1:] == (None, None, None, None)


def test_habitat_counts_rows_without_depth(spark):
    rows = spark.createDataFrame(
        [(1, -100.0, 10.0, "a", None), (1, -300.0, 12.0, "b", "z"), (1, None, None, "a", None)],
        "individual_id long, depth double, sst double, lme string, wdpa string",
    )
    r = H.habitat_context(rows).first()
    assert (r.n, r.shelf_fraction, r.depth_median, r.regions, r.sanctuaries) == (3, 0.5, -200.0, ["a", "b"], ["z"])
    requests = spark.createDataFrame([(1,), (2,)], "individual_id long")
    out = {x.individual_id: x for x in H.habitat_answers(requests, H.habitat_context(rows)).collect()}
    assert out[1].summary == (
        "3 sightings; median depth -200 m (50% over continental shelf); SST ~11.0°C; regions: a, b; sanctuaries: z"
    )
    assert (out[2].ok, out[2].summary) == (False, "No oceano context for this individual")


def test_duplicate_staging_rows_count_once(spark):
    s = spark.createDataFrame([(1, 5, "r"), (1, 6, "gone")], "individual_id long, sighting_id long, source_row_id string")
    staging = spark.createDataFrame([("r", 1.0), ("r", 1.0)], "source_row_id string, depth double")
    assert [r.sighting_id for r in H.context_join(s, staging).collect()] == [5]


def test_region_label(spark):
    regions = spark.createDataFrame(
        [("B", 0.0, 5.0, 0.0, 5.0), ("A", 4.0, 9.0, 0.0, 5.0)],
        "region string, lat_min double, lat_max double, lon_min double, lon_max double",
    )
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 4.5, 1.0), (3, 50.0, 1.0)], "point_id long, lat double, lon double")
    out = {r.point_id: r.region for r in H.region_label(points, regions).collect()}
    assert out == {1: "B", 2: "A", 3: None}


def test_embed_pending_twice(spark):
    manifest = spark.createDataFrame(
        [(i, i, f"p{i}", "u", "ok" if i != 3 else "404") for i in range(6)], schemas.MANIFEST
    ).withColumn("text", F.concat(F.lit("word "), F.col("sighting_id").cast("string")))
    sight = spark.createDataFrame(
        [(0, "by/"), (1, "by-nd/4"), (2, None), (3, "by/"), (4, "by/"), (5, "by/")], "sighting_id long, license string"
    )
    stored = spark.createDataFrame([(4, "hashed-words-64"), (5, "other")], "sighting_id long, embedder_ver string")
    new = embed_pending(manifest, sight, stored, WORDS_64, "text")
    assert sorted(r.sighting_id for r in new.collect()) == [0, 5]
    after = stored.unionByName(new.select("sighting_id", "embedder_ver"))
    assert embed_pending(manifest, sight, after, WORDS_64, "text").count() == 0
    members = spark.createDataFrame([(5,)], "individual_id long")
    assert [r.sighting_id for r in pending(manifest, sight, stored, "hashed-words-64", members).collect()] == [5]


def test_usage(spark):
    calls = spark.createDataFrame(
        [("a", 1_000_000, 0), ("a", 0, 1_000_000), ("a", 0, 0), ("b", 5, 5)], schemas.USAGE_LOG
    )
    prices = spark.createDataFrame([("a", 3.0, 15.0)], "role string, price_in double, price_out double")
    out = {r.role: r for r in U.usage_rollup(calls, prices).collect()}
    assert (out["a"].calls, out["a"].estimated_cost, out["b"].estimated_cost) == (2, 18.0, None)


def test_years_come_from_the_tables(spark, tmp_path):
    rows = [(1992, 1.0), (2030, 2.0), (2030, 3.0), (None, 4.0)]
    spark.createDataFrame(rows, "year int, v double").write.partitionBy("year").parquet(f"{tmp_path}/t")
    out = scans.year_union(spark, f"{tmp_path}/t")
    assert {(r.year, r.n) for r in out.groupBy("year").count().withColumnRenamed("count", "n").collect()} == {
        (1992, 1), (2030, 2), (None, 1)
    }


def test_package_reaches_workers_started_elsewhere(tmp_path):
    """A session in another folder, whose workers do not find the package by themselves."""
    root = str(Path(__file__).resolve().parents[1])
    code = (
        "import importlib.util, sys\n"
        f"spec = importlib.util.spec_from_file_location('__spark_entry__', {root!r} + '/__spark_entry__.py')\n"
        "entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        f".config('spark.checkpoint.dir', {str(tmp_path)!r}).getOrCreate()\n"
        "print('ROWS', entry.entry(spark).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "ROWS " in done.stdout, done.stderr[-2000:]
