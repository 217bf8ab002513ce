"""Text helpers: labels, file identity, title normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Combining marks (Unicode category Mn, main block) dropped after decomposition.
COMBINING_MARKS = r"[̀-ͯ]"

# Precomposed letters of Western European languages and their base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
BASE = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def normalise_text(column: Column) -> Column:
    """Accent-free, whitespace-collapsed, lower-case form used to compare titles.

    ``translate`` and ``regexp_replace`` stay inside code generation; Spark has no built-in
    Unicode decomposition, so the Western European letters are listed.
    """
    plain = F.regexp_replace(F.translate(column, ACCENTED, BASE), COMBINING_MARKS, "")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def route_label(origin: Column, destination: Column) -> Column:
    return F.concat_ws(" → ", origin, destination)


def file_id(url: Column, filename: Column) -> Column:
    """Identity of a file: SHA-256 of its URL, or of its name when it has no URL."""
    return F.sha2(F.when(F.length(url) > 0, url).otherwise(filename), 256)


def trip_filename(service: str, year: str, month: str) -> str:
    """SQL for the published name of a monthly file, from SQL for its parts."""
    return f"format_string('%s_tripdata_%d-%02d.parquet', {service}, {year}, {month})"
