"""Files against grid, listing, bytes, sidecar and manifest: the first broken rule of each."""

from __future__ import annotations

import pytest

from curbflow.settings import SERVICES
from curbflow.sources.files import TRIP_FILE, prove_files

SHA = "ab" * 32
PATH = "file:/lake/{}"
URL = "https://data.example.org/{}"


def name(month: int, year: int = 2024, service: str = "green") -> str:
    return f"{service}_tripdata_{year}-{month:02d}.parquet"


@pytest.fixture(scope="module")
def proof(spark):
    due = [name(m) for m in range(1, 13)] + [name(m, 2026) for m in (1, 2, 3)]
    here = [name(m) for m in range(1, 12)] + [name(1, 2026)]
    listed = [(PATH.format(n), 100 if n != name(2) else 90) for n in here]
    listed += [(PATH.format(f"again/{name(3)}"), 100), (PATH.format("README.parquet"), 5), (PATH.format(name(1, 2019)), 100)]
    read = [(p, 100, SHA if p != PATH.format(name(4)) else "cd" * 32, p != PATH.format(name(5))) for p, _ in listed]
    recorded = [n for n in (*here, name(12), name(3, 2026)) if n != name(6)]
    sidecars = [(URL.format(n), 100 if n != name(7) else 101, None, SHA.upper() if n != name(8) else "zz", "e1") for n in recorded]
    kept = [n for n in [*recorded, name(6)] if n != name(9)]
    manifest = [(URL.format(n), 100, SHA, "FAILED" if n == name(10) else "SKIPPED", "e2" if n == name(11) else None) for n in kept]
    frame = spark.createDataFrame
    rows = prove_files(
        frame([("green", int(n[15:19]), int(n[20:22]), n) for n in due], "service string, year int, month int, filename string"),
        frame(listed, "path string, length long"),
        frame(read, "path string, size long, sha256 string, parquet_magic boolean"),
        frame(sidecars, "url string, size_bytes long, content_length long, sha256 string, etag string"),
        frame(manifest, "url string, size_bytes long, sha256 string, status string, etag string"),
        historical_years=(2024,), current_year=2026,
    ).collect()
    assert len({r.filename for r in rows}) == len(rows)
    return {r.filename: (r.verdict, r.seen_in) for r in rows}


@pytest.mark.parametrize(("month", "verdict"), [
    (1, "OK"), (2, "LISTED_SIZE"), (3, "DUPLICATE"), (4, "CHECKSUM"), (5, "PARQUET_MAGIC"), (6, "SIDECAR_ABSENT"), (7, "SIZE"),
    (8, "SIDECAR_SHA256"), (9, "MANIFEST_ABSENT"), (10, "MANIFEST_STATUS"), (11, "ETAG"), (12, "FILE_ABSENT"),
])
def test_first_broken_rule(proof, month, verdict):
    assert proof[name(month)][0] == verdict


def test_where_files_were_met(proof):
    assert proof[name(1)][1] == 31 and proof[name(6)][1] == 31 - 8 and proof[name(9)][1] == 31 - 16
    assert proof[name(12)][1] == 1 + 8 + 16


def test_files_of_this_year_may_be_missing_but_not_lost(proof):
    assert proof[name(1, 2026)][0] == "OK"
    assert proof[name(2, 2026)] == ("NOT_YET_PUBLISHED", 1)
    assert proof[name(3, 2026)][0] == "FILE_ABSENT"


def test_foreign_names_and_years(proof):
    assert proof["README.parquet"] == ("UNKNOWN_NAME", 6)
    assert proof[name(1, 2019)] == ("OUT_OF_SCOPE", 6)


def test_the_pattern_knows_every_service():
    import re

    for service in SERVICES:
        assert re.match(TRIP_FILE, name(1, service=service).upper()).group(1).lower() == service
    assert not re.match(TRIP_FILE, name(13)) and not re.match(TRIP_FILE, "fh_tripdata_2024-01.parquet")
