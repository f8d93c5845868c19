"""String and array expressions shared by the operators. All are plain Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Unicode-aware text tools treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a regex character class, with and without the line feed.
WS = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WS_INLINE = "\\t\\x0b-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORD = "\\p{L}\\p{M}\\p{N}_"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times in `body`."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def universal_newlines(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, "\r\n?", "\n")).otherwise(c)


def text_lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def hash_u(*parts: Column | str | int) -> Column:
    """First 32 bits of md5 over the parts joined by `|`, as a bigint.

    Depends on values only, so it is the same after a retry or another partitioning.
    """
    return F.conv(F.substring(key_digest(*parts), 1, 8), 16, 10).cast("bigint")


def key_digest(*parts: Column | str | int) -> Column:
    """md5 hex string of the parts joined by `|`; strings name columns, ints are literals."""
    cols = [p if isinstance(p, Column) else F.lit(p) if isinstance(p, int) else F.col(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def running_offsets(lengths: Column, block: int = 32) -> Column:
    """Exclusive prefix sums of an int array: [3, 1, 2] -> [0, 3, 4].

    Sums run inside blocks first and over the block totals second, so a row of n values
    costs about n * block steps, not n * n.
    """

    def sums(values: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("before"), F.lit(0).alias("total"))
        return F.aggregate(
            values,
            start,
            lambda acc, x: F.struct(
                F.concat(acc["before"], F.array(acc["total"])).alias("before"),
                (acc["total"] + x).alias("total"),
            ),
        )

    def blocked(values: Column) -> Column:
        last = F.floor((F.size(values) - 1) / block).cast("int")
        per_block = F.transform(
            F.sequence(F.lit(0), last), lambda b: sums(F.slice(values, b * block + 1, block))
        )
        return let(
            per_block,
            lambda parts: F.flatten(
                F.zip_with(
                    parts,
                    sums(F.transform(parts, lambda p: p["total"]))["before"],
                    lambda p, base: F.transform(p["before"], lambda v: v + base),
                )
            ),
        )

    return let(
        lengths,
        lambda a: F.when(F.size(a) == 0, F.array().cast("array<int>"))
        .when(F.size(a) <= block, sums(a)["before"])
        .otherwise(blocked(a)),
    )


def lines_with_offsets(text: Column) -> Column:
    """array<struct<line_no, text, off>>; `off` is the code-point offset in the document."""
    return let(
        text_lines(text),
        lambda ls: F.transform(
            F.arrays_zip(
                ls.alias("text"),
                running_offsets(F.transform(ls, lambda x: F.length(x) + 1)).alias("off"),
            ),
            lambda z, i: F.struct(i.alias("line_no"), z["text"].alias("text"), z["off"].alias("off")),
        ),
    )
