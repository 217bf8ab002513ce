from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from curbflow.operators import audit as log
from curbflow.functions.text import file_id, normalise_text
from curbflow.settings import SourceScope
from curbflow.sources import catalog, files, links
from curbflow.sources.lake import read_audit_csv, read_audit_log
from curbflow.sources.sinks import append_events, export_events


def test_grid_and_the_one_missing_file(spark):
    scope = SourceScope()
    grid = catalog.expected_files(spark, scope)
    assert grid.count() == 192
    assert catalog.expected_files(spark, scope, include_current=False).count() == 144
    observed = grid.where("NOT (service = 'fhv' AND year = 2023 AND month = 7)").where("year < 2026 OR month < 3")
    missing = catalog.missing_files(grid, observed, scope.historical_years).collect()
    assert [m.filename for m in missing] == ["fhv_tripdata_2023-07.parquet"]
    summary = {r.service: r.missing_files for r in catalog.completeness(grid, observed, scope.historical_years).collect()}
    assert summary == {"yellow": 0, "green": 0, "fhv": 1, "fhvhv": 0}


def test_current_year_counts_only_when_published(spark):
    grid = catalog.expected_files(spark, SourceScope(historical_years=(2025,), current_year=2026))
    linked = spark.createDataFrame([("yellow_tripdata_2026-01.parquet",)], "filename string")
    kept = links.published_only(grid, linked, [2025])
    assert kept.groupBy("year").count().orderBy("year").collect() == [(2025, 48), (2026, 1)]


def test_inventory_ignores_foreign_names_and_orders(spark, tmp_path):
    for name in ("green_tripdata_2023-01.parquet", "YELLOW_tripdata_2023-01.parquet", "fhvhv_tripdata_2022-12.parquet",
                 "yellow_tripdata_2023-13.parquet", "notes.parquet"):
        (tmp_path / name).write_bytes(b"PAR1....PAR1")
    found = files.file_inventory(files.list_files(spark, str(tmp_path), "*.parquet")).collect()
    assert [(r.service, r.year, r.month) for r in found] == [("fhvhv", 2022, 12), ("yellow", 2023, 1), ("green", 2023, 1)]
    with pytest.raises(ValueError, match="unknown services"):
        files.trip_files(files.list_files(spark, str(tmp_path)), ["boat"])


def test_integrity_streams_size_magic_and_hash(spark, tmp_path):
    good, bad = b"PAR1" + bytes(range(256)) * 99 + b"PAR1", b"NOPE....FAIL"
    (tmp_path / "good file.parquet").write_bytes(good)
    (tmp_path / "bad.parquet").write_bytes(bad)
    (tmp_path / "tiny.parquet").write_bytes(b"PAR1")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.file_integrity(files.list_files(spark, str(tmp_path))).collect()}
    assert rows["good file.parquet"].sha256 == hashlib.sha256(good).hexdigest()
    assert (rows["good file.parquet"].size, rows["good file.parquet"].parquet_magic) == (len(good), True)
    assert not rows["bad.parquet"].parquet_magic and not rows["tiny.parquet"].parquet_magic


def test_reconciliation_names_the_first_broken_rule(spark):
    sha = "a" * 64
    stored = spark.createDataFrame([("u", 9, sha, True), ("lost", 0, sha, True)], "url string, size bigint, sha256 string, parquet_magic boolean")
    side = "url string, size_bytes bigint, content_length bigint, sha256 string, etag string"
    entry = "url string, size_bytes bigint, sha256 string, status string, etag string"

    def verdict(sidecar, manifest):
        out = files.reconcile_manifest(
            stored, spark.createDataFrame([sidecar], side), spark.createDataFrame([manifest], entry)
        )
        return {r.url: r.verdict for r in out.collect()}

    good_side, good_entry = ("u", 9, 9, sha.upper(), "e"), ("u", 9, sha, "SKIPPED", None)
    assert verdict(good_side, good_entry) == {"u": "OK", "lost": "FILE_ABSENT"}
    assert verdict(good_side, (*good_entry[:4], "other"))["u"] == "ETAG"
    assert verdict(("u", 9, 8, sha, None), good_entry)["u"] == "SIZE"
    assert verdict(("v", 9, 9, sha, None), good_entry)["u"] == "SIDECAR_ABSENT"
    assert verdict(good_side, ("u", 9, sha, "FAILED", None))["u"] == "MANIFEST_STATUS"


def test_links_resolve_like_a_browser(spark):
    html = """<html><!-- <a href="/commented">x</a> --><script>var t='<a href="/script">';</script>
    <A class="x" HREF='/root.parquet'>a</A><a href=rel%20name/yellow_tripdata_2026-01.parquet?v=1>b</a>
    <a href="../up/./file.parquet">c</a><a href="//cdn.example.org/f.parquet">d</a>
    <a href="https://other.example.org/z?a=1&amp;b=2">e</a><a href="#top">f</a><a href="?q=1">g</a>
    <a href="mailto:x@example.org">h</a><abbr href="/no">i</abbr></html>"""
    pages = spark.createDataFrame([(1, "https://site.example.org/a/b/page.html?x=1#frag", html)], "page_id int, url string, html string")
    got = {r.href: r.url for r in links.page_links(pages).collect()}
    assert got == {
        "/root.parquet": "https://site.example.org/root.parquet",
        "rel%20name/yellow_tripdata_2026-01.parquet?v=1": "https://site.example.org/a/b/rel%20name/yellow_tripdata_2026-01.parquet?v=1",
        "../up/./file.parquet": "https://site.example.org/a/up/file.parquet",
        "//cdn.example.org/f.parquet": "https://cdn.example.org/f.parquet",
        "https://other.example.org/z?a=1&b=2": "https://other.example.org/z?a=1&b=2",
        "#top": "https://site.example.org/a/b/page.html?x=1#top",
        "?q=1": "https://site.example.org/a/b/page.html?q=1",
        "mailto:x@example.org": "mailto:x@example.org",
    }
    trips = links.trip_links(links.page_links(pages)).collect()
    assert [t.filename for t in trips] == ["yellow_tripdata_2026-01.parquet"]


def test_conflicting_links(spark):
    found = spark.createDataFrame([("f", "u1"), ("f", "u1"), ("f", "u2"), ("g", "u3")], "filename string, url string")
    assert [(r.filename, r.urls) for r in links.link_conflicts(found).collect()] == [("f", 2)]


def test_run_lifecycle_and_failure(spark, tmp_path):
    path = str(tmp_path / "events")
    append_events(log.events_frame(spark, [log.run_started("r", "silver", {"years": [2023]})]), path)
    append_events(log.events_frame(spark, [log.run_finished("r", error="ValueError: no")]), path)
    events = spark.read.parquet(path)
    assert {r.status for r in events.collect()} == {"STARTED", "FAILED"}
    flat = log.flatten_events(events)
    assert len(flat.columns) == 22
    assert flat.where("status = 'FAILED'").first().error == "ValueError: no"
    state = log.current_state(events, "event_type").first()
    assert (state.status, state.changes) == ("FAILED", 2)


def test_flatten_prefers_own_fields_and_keeps_json(spark):
    details = {"size_bytes": 5, "metrics": {"b": 1}, "source": {"size_bytes": 9, "service": "fhv", "year": 2024}}
    events = log.events_frame(spark, [log.event("file_status", "VALIDATED", details=details), log.event("x", "OK")])
    rows = {r.event_type: r for r in log.flatten_events(events).collect()}
    own = rows["file_status"]
    assert (own.size_bytes, own.service, own.year, own.month) == (5, "fhv", 2024, None)
    assert json.loads(own.metrics_json) == {"b": 1} and json.loads(own.details_json) == details
    assert rows["x"].metrics_json == "{}"


def test_log_reader_skips_blanks_and_refuses_junk(spark, tmp_path):
    line = json.dumps({"event_id": "1", "event_type": "a", "status": "OK", "timestamp_utc": "2024-01-01T00:00:00.000+00:00", "run_id": None, "details": {"k": 1}})
    log_file = tmp_path / "log.jsonl"
    log_file.write_text(f"{line}\n\n{line}\n")
    events = read_audit_log(spark, str(log_file))
    assert events.count() == 2 and json.loads(events.first().details) == {"k": 1}
    log_file.write_text(f"{line}\nnot json\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_audit_log(spark, str(log_file)).collect()
    log_file.write_text("\n")
    with pytest.raises(ValueError, match="empty"):
        read_audit_log(spark, str(log_file))


def test_history_is_rows_in_order_and_latest_breaks_ties(spark):
    rows = [("b", "k", 2), ("a", "k", 2), ("c", "k", 1)]
    events = spark.createDataFrame(rows, "event_id string, file_id string, t int").selectExpr(
        "event_id", "file_id", "'s' AS status", "timestamp_seconds(t) AS timestamp_utc", "'r' AS run_id", "'{}' AS details"
    )
    assert [r.event_id for r in log.status_history(events, "file_id").collect()] == ["c", "a", "b"]
    assert log.latest_by(events, "file_id").first().event_id == "b"


def test_text_helpers(spark):
    frame = spark.createDataFrame([("  Ángel\t ÑANDÚ  ö ", "http://x/y", "n")], "t string, u string, f string")
    row = frame.select(
        normalise_text(F.col("t")).alias("t"), file_id(F.col("u"), F.col("f")).alias("u"), file_id(F.lit(""), F.col("f")).alias("f")
    ).first()
    assert row.t == "angel nandu o"
    assert row.u == hashlib.sha256(b"http://x/y").hexdigest() and row.f == hashlib.sha256(b"n").hexdigest()


def test_export_survives_quotes_and_is_read_under_a_schema(spark, tmp_path):
    details = {"error": 'said "no", twice', "size_bytes": 7, "source": {"filename": "f"}}
    flat = log.flatten_events(log.events_frame(spark, [log.event("file_status", "FAILED", details=details)]))
    export_events(flat, str(tmp_path / "export"))
    back = read_audit_csv(spark, str(tmp_path / "export" / "csv"))
    assert back.columns == flat.columns
    row = back.first()
    assert (row.error, row.size_bytes, row.filename) == ('said "no", twice', 7, "f")
    assert json.loads(row.details_json) == details
    assert log.files_by(back, "event_type").first().files == 1
