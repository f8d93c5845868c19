"""BIO tag sequences and score arrays as in-row expressions (no shuffle)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialweave.functions.text import let

IGNORE_ID = -100


def base_label(tag: Column) -> Column:
    """Strip one leading `B-` or `I-`; hyphens inside the type stay."""
    return F.when(is_part(tag), F.substr(tag, F.lit(3))).otherwise(tag)


def is_part(tag: Column) -> Column:
    """The tag begins with `B-` or `I-`. Plain prefixes: a pattern costs much more per token."""
    return tag.startswith("B-") | tag.startswith("I-")


def continues(tags: Column, i: Column) -> Column:
    """Tag i carries on the chunk of tag i-1: an `I-` of the same type."""
    return (
        (i > 0)
        & tags[i].startswith("I-")
        & F.when(i > 0, is_part(tags[i - 1]) & (base_label(tags[i - 1]) == base_label(tags[i])))
    )


def bio_spans(tags: Column, mode: str = "strict") -> Column:
    """array<struct<type, start, end>> over token positions, `end` inclusive.

    lenient: a stray `I-` opens a span. strict: it opens none, so only chunks that begin
    with `B-` remain. Every non-O tag lies in one lenient chunk, hence the k-th first
    position belongs to the k-th last position.
    """
    if mode not in ("strict", "lenient"):
        raise ValueError(f"unknown mode {mode!r}")

    def chunks(t: Column) -> Column:
        joined = let(
            F.transform(t, lambda _, i: F.coalesce(continues(t, i), F.lit(False))),
            lambda cont: F.zip_with(
                F.filter(
                    F.transform(t, lambda x, i: F.when(is_part(x) & ~cont[i], i)),
                    lambda i: i.isNotNull(),
                ),
                F.filter(
                    F.transform(
                        t,
                        lambda x, i: F.when(
                            is_part(x)
                            & ((i == F.size(t) - 1) | ~F.coalesce(F.get(cont, i + 1), F.lit(False))),
                            i,
                        ),
                    ),
                    lambda i: i.isNotNull(),
                ),
                lambda s, e: F.struct(base_label(t[s]).alias("type"), s.alias("start"), e.alias("end")),
            ),
        )
        if mode == "strict":
            return F.filter(joined, lambda c: t[c["start"]].startswith("B-"))
        return joined

    return let(tags, chunks)


def argmax(scores: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def softmax_confidence(scores: Column) -> Column:
    """Softmax probability of the winner, four decimals."""
    return let(
        F.array_max(scores),
        lambda top: F.round(
            1.0 / F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)), 4
        ),
    )


def may_follow(before: str, tag: str) -> bool:
    """An `I-` tag needs a tag of its type in front."""
    return not tag.startswith("I-") or before in (tag, "B-" + tag[2:])


def viterbi(emissions: Column, tags: Sequence[str], transitions: Sequence[Sequence[float]], start: Sequence[float]) -> Column:
    """The best tag sequence under the BIO rule, as positions in `tags`; array<array<double>> -> array<int>.

    Score of a sequence: start of its first tag, transitions[before][tag] and emissions of all.
    One fold over the row keeps the best score per tag and the tag before it; a second one
    walks back. Among equal scores the smaller tag position wins, at each step. Tags that may
    not begin a sequence or follow another one are left out there.
    """
    begin = [k for k, tag in enumerate(tags) if not tag.startswith("I-")]
    worst = F.lit(float("-inf"))
    best_of = lambda options: F.array_max(F.array(*options))

    def first(e: Column) -> Column:
        return F.array(*[e[k] + F.lit(float(start[k])) if k in begin else worst for k in range(len(tags))])

    def step(acc: Column, e: Column) -> Column:
        def arrive(k: int) -> Column:
            before = [i for i, tag in enumerate(tags) if may_follow(tag, tags[k])]
            return best_of([F.struct((acc["scores"][i] + F.lit(float(transitions[i][k]))).alias("v"), F.lit(-i).alias("b")) for i in before])

        return let(
            F.array(*[arrive(k) for k in range(len(tags))]),
            lambda best: F.struct(
                F.zip_with(best, e, lambda b, x: b["v"] + x).alias("scores"),
                F.concat(acc["back"], F.array(F.transform(best, lambda b: -b["b"]))).alias("back"),
            ),
        )

    def walk(done: Column) -> Column:
        last = (F.array_position(done["scores"], F.array_max(done["scores"])) - 1).cast("int")
        path = F.aggregate(F.reverse(done["back"]), F.array(last), lambda acc, b: F.concat(acc, F.array(b[F.element_at(acc, -1)])))
        return F.reverse(path)

    def decode(e: Column) -> Column:
        none = F.array().cast("array<array<int>>")
        done = F.aggregate(F.slice(e, 2, F.size(e)), F.struct(first(e[0]).alias("scores"), none.alias("back")), step)
        return F.when(F.size(e) > 0, let(done, walk)).otherwise(F.array().cast("array<int>"))

    return let(emissions, decode)


def drop_ignored(truth: Column, *others: Column) -> Column:
    """array<struct<truth, p0, p1, ..>> without the positions whose truth is the ignore id."""
    named = [truth.alias("truth")] + [c.alias(f"p{i}") for i, c in enumerate(others)]
    return F.filter(F.arrays_zip(*named), lambda z: z["truth"] != IGNORE_ID)
