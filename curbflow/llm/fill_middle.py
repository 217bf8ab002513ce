"""Fill-in-the-middle examples: texts cut at two unit borders and rearranged around marks.

One full match of a repeated group finds every unit of a text: the regex library keeps all captures
of a repeated group, so the ends of the captures are the borders, their number is n, and both cut
offsets are looked up in them.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import small_batches

# The unit of a text, the marks and the shares of the forms, as the contract states them.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_SHARE = 50
SUFFIX_FIRST_SHARE = 80

UNITS = regex.compile(f"({UNIT})*")
CUTS = "n long, prefix long, middle long"


def cut_points(text: str, first: int, second: int) -> tuple[int, int, int]:
    """Number of units, and where the prefix and the middle end: after the smaller and the larger of
    the two draws, each taken modulo n + 1."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    a, b = sorted((first % (n + 1), second % (n + 1)))
    return n, ends[a - 1] if a else 0, ends[b - 1] if b else 0


def _cutter() -> Callable[[Column, Column, Column], Column]:
    def cuts(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
        found = [cut_points(*row) for row in zip(texts, first.tolist(), second.tolist(), strict=True)]
        return pd.DataFrame(found, columns=["n", "prefix", "middle"])

    return F.pandas_udf(cuts, CUTS)


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of ``seed:key``; a null key counts as no text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(df: DataFrame, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with each text rearranged for learning to fill in its middle.

    A text is cut into units (leading white space and a word, or trailing white space). Prefix,
    middle and suffix end at two units drawn by a hash of ``seed`` and the key. Adds ``n`` (units),
    ``form`` (plain, psm or spm), ``output``, ``prefix_chars`` and ``middle_chars`` (code points,
    null for plain). A text is left plain if it is empty, holds a mark, or is drawn to be.

    A null text counts as empty and gives an empty output; a null key draws as the empty key. Equal
    rows give equal results, each row its own. Input columns with the added names are replaced; any
    others stay. A text of any length is one match, linear in its length. Empty tables stay empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(key), seed)
    names = [c for c in df.columns if c not in ("n", "form", "output", "prefix_chars", "middle_chars")]
    # The pieces are cut from the text where it is: only three numbers a row come back from Python.
    cut = small_batches(df).select(
        *[F.col(c) for c in names], body.alias("_body"), h3.alias("_h3"), h4.alias("_h4"), _cutter()(body, h1, h2).alias("_cut")
    )
    marked = F.contains("_body", F.lit(PREFIX)) | F.contains("_body", F.lit(SUFFIX)) | F.contains("_body", F.lit(MIDDLE))
    plain = (F.col("_body") == "") | marked | (F.col("_h3") % 100 >= PLAIN_SHARE)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < SUFFIX_FIRST_SHARE, "spm").otherwise("psm")
    a, b = F.col("_cut.prefix"), F.col("_cut.middle")
    prefix, middle = F.substr("_body", F.lit(1), a), F.substr("_body", a + 1, b - a)
    suffix = F.substr("_body", b + 1)
    output = (
        F.when(F.col("form") == "plain", F.col("_body"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    moved = F.col("form") != "plain"
    return cut.withColumn("form", form).select(
        *names, F.col("_cut.n").alias("n"), "form", output.alias("output"),
        F.when(moved, a).alias("prefix_chars"), F.when(moved, b - a).alias("middle_chars"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. Marks never occur in a text that is rearranged, and
    none can arise where parts meet, so the first place of each mark is the mark itself."""
    mark = len(PREFIX)

    def between(start: Column, stop: Column) -> Column:
        return F.substr(output, start + mark, stop - start - mark)

    p, s, m = (F.instr(output, x) for x in (PREFIX, SUFFIX, MIDDLE))
    rest = F.substr(output, m + mark)
    return (
        F.when(form == "psm", F.concat(between(p, s), rest, between(s, m)))
        .when(form == "spm", F.concat(between(p, m), rest, between(s, p)))
        .otherwise(output)
    )
