"""Host-level quality rules: failure rates per domain, shrunk by an empirical beta prior."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import SPACE_CHARS, word_array, written

SYMBOLS = "#*$%&|<>"
HAS_WORD = "[^ \\t-\\r]"


@dataclass(frozen=True)
class HostLimits:
    min_words: int = 20
    max_repeat_percent: int = 30
    max_symbols_per_word: float = 0.5
    max_dup_line_share: float = 0.5
    window: int = 8
    max_host_rate: float = 0.5


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(hashes: Column, window: int) -> Column:
    """Words covered by windows whose hash occurs twice or more: sort, keep neighbours, add gaps."""

    def repeated(ordered: Column) -> Column:
        def twin(x: Column, j: Column) -> Column:
            before = F.get(ordered, j - 1)["h"]
            after = F.get(ordered, j + 1)["h"]
            return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(ordered, twin), lambda x: x["at"]))

    def add(positions: Column) -> Column:
        gaps = F.transform(
            positions,
            lambda p, j: F.least(F.lit(window), F.coalesce(F.get(positions, j + 1) - p, F.lit(window))),
        )
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    pairs = F.transform(hashes, lambda h, j: F.struct(h.alias("h"), j.alias("at")))
    return _let(F.array_sort(pairs), lambda ordered: _let(repeated(ordered), add))


def repeat_words(words: Column, window: int = 8) -> Column:
    """Words lying in ``window``-word windows found twice or more in the same text.

    Windows are compared by 64-bit hashes of their words' hashes, within one text only. Texts whose
    window hashes are all distinct, the usual case, stop after that test.
    """

    def windows(hashed: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashed) - window)
        rolled = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(window)]))
        return F.when(F.size(hashed) >= window, rolled).otherwise(F.array().cast("array<bigint>"))

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _covered(hashes, window)).otherwise(
            F.lit(0).cast("long")
        )

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(windows(h), count))


def base_measures(df: DataFrame, text: str = "text", limits: HostLimits = HostLimits()) -> DataFrame:
    """``df`` with the measures and ``base_failed``. A null text counts as empty and fails."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike(HAS_WORD))
    measured = df.withColumns(
        {
            "_words": word_array(F.col(text)),
            "word_chars": F.length(F.translate(body, SPACE_CHARS, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        }
    )
    return (
        measured.withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "n_repeat_words": repeat_words(F.col("_words"), limits.window),
                "_n_lines": F.size(lines).cast("long"),
            }
        )
        .drop("_words")
        .withColumn(
            "base_failed",
            (F.col("n_words") < limits.min_words)
            | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words")),
        )
    )


def host_rates(measured: DataFrame, host: str, limits: HostLimits = HostLimits()) -> DataFrame:
    """One row per host: failures of any rule, documents, shrunk rate and verdict.

    The prior Beta(a, b) is fitted to the hosts' rates by moments, weighted by documents: with mean
    m and variance v, a + b = m (1 - m) / v - 1, at least 1 and at most 1000 (used where hosts do
    not differ). A host's rate is (failures + a) / (documents + a + b), so a host with few
    documents stays near the corpus rate. Hosts above ``max_host_rate`` are rejected.
    """
    failed = (
        F.col("base_failed")
        | (F.col("n_symbols") > limits.max_symbols_per_word * F.col("n_words"))
        | (F.col("n_dup_lines") > limits.max_dup_line_share * F.col("_n_lines"))
    )
    hosts = measured.groupBy(F.col(host).alias("_host")).agg(
        F.sum(failed.cast("long")).alias("failures"), F.count("*").alias("documents")
    )
    rate = F.col("failures") / F.col("documents")
    # The moments are one row; a join on a constant key would be a cross join, so it is read here.
    n, failures, squares = hosts.agg(
        F.coalesce(F.sum("documents"), F.lit(0)),
        F.coalesce(F.sum("failures"), F.lit(0)),
        F.coalesce(F.sum(F.col("documents") * rate * rate), F.lit(0.0)),
    ).first()
    mean = failures / n if n else 0.0
    variance = squares / n - mean * mean if n else 0.0
    strength = min(max(mean * (1 - mean) / variance - 1, 1.0), 1000.0) if variance > 1e-12 else 1000.0
    shrunk = (F.col("failures") + strength * mean) / (F.col("documents") + strength)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_kept", shrunk <= limits.max_host_rate)


def host_rules(
    df: DataFrame, host: str = "source", text: str = "text", key: str = "doc_id", limits: HostLimits = HostLimits()
) -> DataFrame:
    """Key, host, measures, ``base_failed``, the host's rate and ``kept`` for every row.

    ``kept`` is false for rows that fail the base rules and for all rows of a rejected host. A null
    host is a host of its own. Repeated rows and null keys are rows like others. Only the three
    named columns are read. Measures are written once, without texts; host counts combine
    map-side, so a host with a third of all rows is a few partial rows.
    """
    narrow = df.select(F.col(key).alias("_key"), F.col(host).alias("_host_of"), F.col(text).alias("_text"))
    measured = written(base_measures(narrow, "_text", limits).drop("_text"), "host-measures")
    hosts = host_rates(measured, "_host_of", limits)
    return measured.join(hosts, F.col("_host_of").eqNullSafe(F.col("_host"))).select(
        F.col("_key").alias(key), F.col("_host_of").alias(host),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate",
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"),
    )
