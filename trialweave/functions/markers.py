"""Entity markers around two spans of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialweave.functions.text import let

# The marker tokens.
MARKERS = ("[E1]", "[/E1]", "[E2]", "[/E2]")

MAX_POSITION = (1 << 31) - 1  # behind the end of any text


def inject_markers(
    text: Column,
    e1_start: Column,
    e1_end: Column,
    e2_start: Column,
    e2_end: Column,
    bounds: str = "clamp",
    balanced: bool = False,
) -> Column:
    """Insert the four markers from right to left.

    At equal positions a later marker ends up further left. `bounds='skip'` leaves out a
    marker that lies beyond the current text; `clamp` appends it. `balanced=True` puts
    closing markers before opening ones where two spans touch.
    """
    if bounds not in ("clamp", "skip"):
        raise ValueError(f"unknown bounds {bounds!r}")
    tie = (0, 2, 1, 3) if balanced else (0, 1, 2, 3)
    inserts = F.sort_array(
        F.array(
            *[
                F.struct((-F.least(pos, F.lit(MAX_POSITION)).cast("int")).alias("neg"), F.lit(rank).alias("tie"), F.lit(m).alias("marker"))
                for pos, rank, m in zip((e1_start, e1_end, e2_start, e2_end), tie, MARKERS)
            ]
        )
    )

    def insert(acc: Column, x: Column) -> Column:
        pos = -x["neg"]
        placed = F.concat(F.substring(acc, F.lit(1), pos), x["marker"], F.substr(acc, pos + 1))
        return F.when(pos > F.length(acc), acc).otherwise(placed) if bounds == "skip" else placed

    def placed(z: Column) -> Column:
        """Positions inside the text: all five pieces are cut from it at once, instead of a new text per marker."""
        at = [-z[k]["neg"] for k in range(4)]
        parts = [F.substring(text, F.lit(1), at[3]), z[3]["marker"]]
        for k in (2, 1, 0):
            parts += [F.substring(text, at[k + 1] + 1, at[k] - at[k + 1]), z[k]["marker"]]
        inside = (at[3] >= 0) & (at[0] <= F.length(text))
        return F.when(inside, F.concat(*parts, F.substr(text, at[0] + 1))).otherwise(F.aggregate(z, text, insert))

    return let(inserts, placed)
