"""Reply trees as conversations: paths by iterative self-joins, branches ranked, one text a path.

The template of a turn is ``### role: text</turn>`` and a line end. In roles and texts a backslash
goes before ``\\``, ``#``, ``<`` and, in roles, ``:``; so neither mark can occur inside, and taking
the backslashes away gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbflow.llm.common import written

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
TEXT_CONTROL = re.compile(r"([\\#<])")
ROLE_CONTROL = re.compile(r"([\\#<:])")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.DOTALL)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str | None, str | None]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text, and the spans (code points) of the texts whose loss counts."""
    out: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        head = OPEN + ROLE_CONTROL.sub(r"\\\1", role or "") + COLON
        body = TEXT_CONTROL.sub(r"\\\1", text or "")
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"not a turn at character {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def chain_of_turns(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Flat conversations as trees: each row replies to the one before it by turn.

    Gives node, parent, conversation, role, text and score (0). Ties of a turn, a null turn among
    them (first), are ordered by role and text. The null conversation is a conversation.
    """
    rows = written(
        df.select(
            F.col(conversation).alias("conversation"), F.col(turn).alias("_turn"),
            F.col(role).alias("role"), F.col(text).alias("text"),
        ).withColumn("node", F.monotonically_increasing_id()),
        "turns",
    )
    order = Window.partitionBy("conversation").orderBy("_turn", "role", "text", "node")
    return rows.withColumn("parent", F.lag("node").over(order)).select(
        "node", "parent", "conversation", "role", "text", F.lit(0.0).alias("score")
    )


def root_paths(nodes: DataFrame) -> DataFrame:
    """(leaf, node, distance) for every node between each leaf and its root, both included.

    Distances double: with the paths up to 2^k - 1 steps and the jumps of 2^k steps known, one
    self-join gives the paths up to 2^(k+1) - 1 steps and another the next jumps, so a chain of n
    replies takes log n rounds. Each round is written to the shared folder. A node whose parent is
    missing is a root. A circle of replies has no root: rounds end when they pass the number of
    nodes, and paths that reach no root are left out.
    """
    links = written(nodes.select("node", "parent"), "reply-links")
    ids = links.select(F.col("node").alias("parent"))
    jumps = links.join(ids, "parent", "left_semi").select(F.col("node").alias("at"), F.col("parent").alias("up"))
    jumps = written(jumps, "reply-jumps")
    roots = links.join(jumps, F.col("node") == F.col("at"), "left_anti").select(F.col("node").alias("root"))
    leaves = links.join(jumps.select(F.col("up").alias("node")), "node", "left_anti")
    own = leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance"))
    steps = [written(own, "reply-leaves")]
    nodes_in_all = links.count()
    reach = 1
    while reach <= max(nodes_in_all, 1):
        known = reduce(DataFrame.unionByName, steps)
        further = written(
            known.join(jumps, F.col("node") == F.col("at")).select(
                "leaf", F.col("up").alias("node"), (F.col("distance") + reach).alias("distance")
            ),
            "reply-paths",
        )
        if further.isEmpty():
            break
        steps.append(further)
        twice = jumps.select(F.col("at").alias("_middle"), F.col("up").alias("_top"))
        jumps = written(
            jumps.join(twice, F.col("up") == F.col("_middle")).select("at", F.col("_top").alias("up")), "reply-jumps"
        )
        reach *= 2
    paths = reduce(DataFrame.unionByName, steps)
    rooted = paths.join(roots, F.col("node") == F.col("root"), "left_semi").select("leaf")
    return paths.join(rooted, "leaf", "left_semi")


def format_branches(nodes: DataFrame, branches: int = 1, learn: str = "assistant") -> DataFrame:
    """The ``branches`` best paths of every tree as conversations.

    ``nodes``: node (unique), parent, conversation, role, text, score. A path's score is the sum of
    its nodes' (null: 0); of equal scores the longer path wins, then the smaller leaf. Gives
    conversation (the root's), root, leaf, rank, n_turns, formatted and loss_spans. Null roles and
    texts are empty. An empty table gives no conversation.
    """
    kept = written(nodes, "reply-nodes")
    paths = written(root_paths(kept), "reply-branches")
    placed = paths.join(kept, "node")
    totals = placed.groupBy("leaf").agg(
        F.sum(F.coalesce("score", F.lit(0.0))).alias("_score"),
        F.max("distance").alias("_depth"),
        F.max_by("node", "distance").alias("root"),
    )
    best = Window.partitionBy("root").orderBy(F.desc("_score"), F.desc("_depth"), "leaf")
    chosen = totals.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches)
    turns = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("at"), "conversation", "role", "text")))
    gathered = (
        placed.join(chosen, "leaf")
        .groupBy("leaf", "root", "rank")
        .agg(turns.alias("turns"))
    )
    kind = kept.schema["conversation"].dataType.simpleString()
    schema = (
        f"conversation {kind}, root long, leaf long, rank int, n_turns long, formatted string, "
        "loss_spans array<struct<first: long, last: long>>"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                formatted, spans = format_turns([(t["role"], t["text"]) for t in row["turns"]], learn)
                rows.append(
                    {
                        "conversation": row["turns"][0]["conversation"], "root": row["root"], "leaf": row["leaf"],
                        "rank": row["rank"], "n_turns": len(row["turns"]), "formatted": formatted,
                        "loss_spans": [{"first": a, "last": b} for a, b in spans],
                    }
                )
            yield pa.RecordBatch.from_pylist(
                rows,
                pa.schema(
                    [
                        ("conversation", batch.schema.field("turns").type.value_type.field("conversation").type),
                        ("root", pa.int64()), ("leaf", pa.int64()), ("rank", pa.int32()), ("n_turns", pa.int64()),
                        ("formatted", pa.string()),
                        ("loss_spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                    ]
                ),
            )

    return gathered.mapInArrow(write, schema)


def loss_text(formatted: str, spans: list[tuple[int, int]]) -> str:
    """The texts under the loss mask, unescaped, in order, with nothing between."""
    return "".join(unescape(formatted[a:b]) for a, b in spans)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, figures of the turns and of the loss text, read back from the output."""
    kind = formatted.schema["conversation"].dataType.simpleString()
    schema = (
        f"conversation {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = parse_turns(text)
                learnt = loss_text(text, [(s["first"], s["last"]) for s in spans])
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((len(turns), _sha(said), len(learnt), _sha(learnt), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conversation"), *columns],
                ["conversation", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.select("conversation", "formatted", "loss_spans").mapInArrow(read, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()
