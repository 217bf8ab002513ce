"""Mixing sources to target weights along a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbflow.llm.common import word_array, written

POINT_BITS = 62
CHUNK_BITS = 14  # slots ranked in one window, and slots drawn from one row
TASK_SLOTS = 1 << 18
LINE_BITS = 12


@dataclass(frozen=True)
class Mix:
    """``documents``: one row per input row with size, source_size, target and taken words.
    ``parts``: which words of which document fill which slot of the schedule."""

    documents: DataFrame
    parts: DataFrame


def bit_reversed(i: Column) -> Column:
    """The base-2 van der Corput point of ``i``, as an integer of POINT_BITS bits."""
    for mask, step in (
        (0x5555555555555555, 1),
        (0x3333333333333333, 2),
        (0x0F0F0F0F0F0F0F0F, 4),
        (0x00FF00FF00FF00FF, 8),
        (0x0000FFFF0000FFFF, 16),
    ):
        low = F.lit(mask)
        i = F.shiftleft(i.bitwiseAND(low), step).bitwiseOR(F.shiftrightunsigned(i, step).bitwiseAND(low))
    i = F.shiftleft(i, 32).bitwiseOR(F.shiftrightunsigned(i, 32))
    return F.shiftrightunsigned(i, 64 - POINT_BITS)


def source_targets(sizes: DataFrame, source: str, ceiling: int) -> DataFrame:
    """One row per source: source_size, target and its interval of the unit line.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share all words. A target
    stops at ``ceiling`` times its source and the excess is shared again by weight. Sorted by that
    limit per weight, the stopped sources are a prefix, so one pass of running sums finds them.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("_source").asc_nulls_last())
    by_limit = everything.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    to_here = everything.orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.groupBy(F.col(source).alias("_source"))
        .agg(F.sum("size").alias("source_size"))
        .withColumn("_rank", F.row_number().over(by_name) - 1)
        .withColumn("_weight", (F.col("_rank") % 3 + 1).cast("double"))
        .withColumn("_ratio", ceiling * F.col("source_size") / F.col("_weight"))
        .withColumn("_words", F.sum("source_size").over(everything))
    )
    left = F.col("_words") - F.coalesce(F.sum(ceiling * F.col("source_size")).over(by_limit), F.lit(0))
    weight_left = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(by_limit), F.lit(0.0))
    level = ranked.withColumn("_level", left / weight_left).withColumn(
        "_stopped", F.col("_ratio") <= F.col("_level")
    )
    shared = F.max(F.when(~F.col("_stopped"), F.col("_level"))).over(everything)
    return (
        level.withColumn(
            "target",
            F.when(F.col("_stopped"), (ceiling * F.col("source_size")).cast("double")).otherwise(
                F.col("_weight") * shared
            ),
        )
        .withColumn("_limit", F.least(F.round("target").cast("long"), ceiling * F.col("source_size")))
        .withColumn("_from", F.coalesce(F.sum("_limit").over(to_here), F.lit(0)))
        .withColumn("_all", F.sum("_limit").over(everything))
        .select("_source", "source_size", "target", "_limit", "_from", "_all")
    )


def _running(df: DataFrame, group: str, bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """Sum of ``value`` before each row in (group, bucket, order), from per-bucket totals.

    A group of any size is spread over its buckets; only one total per bucket meets per group.
    """
    totals = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(group, bucket, F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(base, [group, bucket])
        .withColumn(name, F.col("_base") + F.col("_inside"))
        .drop("_base", "_inside")
    )


def schedule_slots(targets: DataFrame, block_words: int) -> DataFrame:
    """The slots of the schedule that belong to each source: _id, _limit, slot and _chunk.

    ``targets``: _id, _limit, _from and _all, the interval [_from, _from + _limit) of a line of _all
    words. A source needs the first b indices whose van der Corput point lies in its interval. The
    interval is a union of dyadic cells, at most two of a size, and the indices of a cell of size
    2^-l are one arithmetic progression of step 2^l. So a source's slots are counted off directly:
    up to (b + cells) / share they hold b at least and b + 2 cells at most, however small the share.
    _chunk rises with the slot and has about 2^CHUNK_BITS slots of a source.
    """
    end = F.lit(1 << POINT_BITS)
    sources = targets.filter("_limit > 0").select(
        "_id", "_limit", F.ceil(F.col("_limit") / block_words).alias("_blocks"),
        *[
            F.expr(f"CAST({at} AS DECIMAL(19, 0)) * CAST({1 << POINT_BITS} AS DECIMAL(19, 0)) DIV CAST(_all AS DECIMAL(19, 0))").alias(name)
            for at, name in (("_from", "_low"), ("_from + _limit", "_high"))
        ],
    ).withColumn("_share", (F.col("_high") - F.col("_low")) / end)
    sized = sources.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(POINT_BITS)))).selectExpr(
        "*", "shiftrightunsigned(_low + shiftleft(1L, _k) - 1, _k) AS _l", "shiftrightunsigned(_high, _k) AS _r",
        f"{POINT_BITS} - _k AS _level",
    ).filter("_l < _r")
    odd_ends = F.array(F.when(F.col("_l") % 2 == 1, F.col("_l")), F.when(F.col("_r") % 2 == 1, F.col("_r") - 1))
    cells = (
        sized.withColumn("_cell", F.explode(F.array_compact(odd_ends)))
        .withColumn("_first", bit_reversed(F.expr("shiftleft(_cell, _k)")))
        .withColumn("_cells", F.count("*").over(Window.partitionBy("_id")))
        .withColumn("_until", F.ceil(F.least((F.col("_blocks") + F.col("_cells")) / F.col("_share"), end.cast("double"))))
        .filter("_first < _until")
        .withColumn("_last", F.expr("shiftrightunsigned(_until - _first - 1, _level)"))
    )
    # Rows of at most 2^CHUNK_BITS slots, in two steps, are spread before they are written out.
    tasks = targets.agg(F.coalesce(F.sum("_limit"), F.lit(0))).first()[0] // (block_words * TASK_SLOTS) + 1
    size = 1 << CHUNK_BITS
    return (
        cells.withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("_last", 2 * CHUNK_BITS))))
        .withColumn("_b", F.explode(F.sequence(F.col("_a") * size, F.least((F.col("_a") + 1) * size - 1, F.shiftright("_last", CHUNK_BITS)))))
        .select("_id", "_limit", "_share", "_first", "_level", "_last", "_b")
        .repartition(tasks, "_id", "_first", "_b")
        .withColumn("_j", F.explode(F.sequence(F.col("_b") * size, F.least((F.col("_b") + 1) * size - 1, F.col("_last")))))
        .withColumn("slot", F.col("_first") + F.expr("shiftleft(_j, _level)"))
        .select("_id", "_limit", "slot", F.floor(F.col("slot") * F.col("_share") / size).alias("_chunk"))
    )


def mix_sources(
    df: DataFrame,
    block_words: int = 512,
    ceiling: int = 3,
    seed: int = 17,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    row: str | None = None,
) -> Mix:
    """Fill a schedule of blocks so that every prefix of it holds the sources in their target shares.

    Slot ``i`` of the schedule belongs to the source whose interval of cumulative target shares
    holds the van der Corput point of ``i``. The k-th slot of a source takes the k-th block of
    ``block_words`` words of that source's documents in hashed order, read ``ceiling`` times over
    at most; the last block is cut at the target. Every source is given as many slots as its target
    has blocks, so it reaches the target exactly (in whole words); a source that is short of points
    takes the next ones of its interval, which are solved for and not searched.

    A null text or one without words has size 0 and is never taken. A null source is a source of
    its own and weighs in last. Repeated rows and repeated or null keys are separate documents. A
    hot source is split by hash ranges, its slots by ranges of the schedule. Empty tables give
    empty frames. Only the named columns are read, so others may have any name. ``row`` names a
    unique long column that the results carry as ``_row``, to find the input rows again.
    """
    sized = written(
        df.select(F.col(key).alias("_key"), F.col(source).alias("_name"), F.size(word_array(F.col(text))).cast("long").alias("size"), F.xxhash64(F.col(text)).alias("_content"), (F.col(row) if row else F.lit(None)).cast("long").alias("_given"))
        .withColumn("_row", F.col("_given") if row else F.monotonically_increasing_id())
        .withColumn("_hash", F.xxhash64(F.lit(seed), "_key", "_content").bitwiseAND(F.lit((1 << 63) - 1)))
        .drop("_given"),
        "mix-sizes",
    )
    # One row per source, read several times.
    targets = written(
        source_targets(sized, "_name", ceiling).withColumn("_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("_source").asc_nulls_last()))),
        "mix-targets",
    )
    joined = sized.join(targets, F.col("_name").eqNullSafe(F.col("_source"))).drop("_source")
    # Drawn rows have no size that the optimizer could see, so it is told not to broadcast them.
    slots = _running(schedule_slots(targets, block_words).hint("merge"), "_id", "_chunk", ["slot"], F.lit(1).cast("long"), "_block").filter(
        F.col("_block") * block_words < F.col("_limit")
    ).select("_id", "_block", "slot")

    line = _running(
        joined.filter("size > 0").withColumn("_range", F.shiftright("_hash", 63 - LINE_BITS)),
        "_id", "_range", ["_hash", "_key", "_row"], F.col("size"), "_start",
    )
    passes = line.filter("_limit > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_limit") / F.col("source_size")) - 1))
    ).withColumn("_start", F.col("_start") + F.col("epoch") * F.col("source_size")).filter("_start < _limit")
    parts = (
        passes.withColumn("_end", F.least(F.col("_start") + F.col("size"), F.col("_limit")))
        .withColumn(
            "_block",
            F.explode(F.sequence(F.floor(F.col("_start") / block_words), F.floor((F.col("_end") - 1) / block_words))),
        )
        .withColumn("_a", F.greatest("_start", F.col("_block") * block_words))
        .withColumn("_b", F.least("_end", (F.col("_block") + 1) * block_words))
        .join(slots.hint("merge"), ["_id", "_block"])
        .select(
            "slot", "_row", F.col("_key").alias(key), F.col("_name").alias(source), "epoch",
            (F.col("_a") - F.col("_start")).alias("first_word"), (F.col("_b") - F.col("_a")).alias("words"),
        )
    )
    taken = parts.groupBy("_row").agg(F.sum("words").alias("taken"))
    documents = joined.join(taken, "_row", "left").select(
        "_row", F.col("_key").alias(key), F.col("_name").alias(source), "size", "source_size", "target",
        F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
    )
    return Mix(documents, parts)


def mixed_rows(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``df`` as the mix takes it: each row as often as the schedule passes over at least half of its
    words. Rows without words do not appear."""
    rows = written(df.withColumn("_at", F.monotonically_increasing_id()), "mix-rows")
    chosen = mix_sources(rows, key=key, source=source, text=text, row="_at").documents
    copies = chosen.filter("taken > 0").select(
        F.col("_row").alias("_at"), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("_copies")
    )
    return (
        rows.join(copies.filter("_copies > 0"), "_at")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
        .select(*df.columns)
    )
