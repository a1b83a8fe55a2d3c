"""Mixing sources to target weights, in DataFrame functions alone.

The token shares of the sources are raised to an exponent (1 keeps them, 0 makes all sources
equal), which is bisected to the largest that meets a target entropy, and then raised again if the
budget would repeat a source too often. Each source's budget is realised as whole epochs and a
last one in part: an epoch is a permutation of the source by a hash of key and epoch, walked block
by block (by the first bits of the hash) until the budget is met. The cut is found by summing
tokens by blocks, then by blocks of the cut block, so no source is ever sorted or held in one task.

Sources stay a table, however many there are: a round of the bisection sums the powers of their
shares for GRID exponents at once, and only these sums reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import few_bytes, materialize, unused

#: A round of the bisection looks at so many parts of what is left: ROUNDS of them halve it 50 times.
GRID, ROUNDS = 1 << 10, 5
BITS = 60
#: Bits of a level of blocks: so many blocks of a source meet in one task.
BLOCK_BITS = 12
ADDED = ["n_tokens", "weight", "copies", "epoch", "block"]


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def permuted(key: Column, epoch: Column) -> Column:
    """60 hashed bits of key and epoch: the place in that epoch's permutation."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("")), epoch.cast("string"))), 1, 15), 16, 10).cast("long")


@dataclass
class Shares:
    """The sources with tokens, by their shares of all tokens."""

    table: DataFrame  # (p): one row for each source
    n: int
    least: float
    most: float

    def sums(self, exponent: Callable[[Column], Column], n: int = 1) -> list[tuple[float, float]]:
        """For the exponents a of 1 to n the sums of p^a and of p^a ln p over all sources."""
        each = self.table.select("p", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i")).withColumn("a", exponent(F.col("i")))
        power = F.pow("p", "a")
        found = each.groupBy("i").agg(F.sum(power).alias("s"), F.sum(power * F.ln("p")).alias("l")).collect()
        return [(r.s, r.l) for r in sorted(found)]

    def largest(self, low: float, high: float, enough: Callable[[float, float, float], bool], exponent: Callable = lambda x: x) -> float:
        """The largest x in [low, high] for which `enough` (of the exponent and its two sums), true at
        low and ever less so, still holds. `exponent` takes numbers and columns."""
        if enough(exponent(high), *self.sums(lambda _: F.lit(float(exponent(high))))[0]):
            return high
        for _ in range(ROUNDS):
            point = lambda i, low=low, wide=high - low: low + wide * i / GRID
            sums = self.sums(lambda i, point=point: exponent(point(i)), GRID - 1)
            held = next((i for i, x in enumerate(sums, 1) if not enough(exponent(point(i)), *x)), GRID)
            low, high = (point(held - 1) if held > 1 else low), (point(held) if held < GRID else high)
        return low


def weights(sources: DataFrame, entropy_share: float, max_repeats: float, budget: float | None, whole: bool = False) -> DataFrame:
    """(source, tokens, exponent, weight, quota) of rows of (source, tokens).

    budget: in sizes of the corpus. None stands for the most that repeats no source over
    `max_repeats`. With one, the exponent grows until no source is repeated more. `whole` stands for
    the least budget that has every source once; the exponent grows likewise.
    """
    if whole and (budget is not None or max_repeats < 1):
        raise ValueError("a whole mixture has its own budget and takes each source once at least")
    if budget is not None and budget > max_repeats:
        raise ValueError("a budget of more sizes than a source may be repeated can't be met")
    sources = materialize(sources)
    n, total, least, most = sources.where("tokens > 0").agg(F.count(F.lit(1)), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    exponent, norm, size = 1.0, 1.0, 0.0
    if n:
        shares = Shares(sources.where("tokens > 0").select((F.col("tokens") / total).alias("p")), n, least / total, most / total)
        # the entropy, in nats, of the shares raised to a
        exponent = shares.largest(0.0, 1.0, lambda a, s, l: math.log(s) - a * l / s >= entropy_share * math.log(n) - 1e-12)
        repeated = lambda a, s: shares.least ** (a - 1) / s  # noqa: E731  of budget 1, the smallest source is repeated most
        spread = lambda a: (shares.least / shares.most) ** (a - 1)  # noqa: E731  times that it is taken while the largest is taken once
        if whole:
            exponent = 1 - shares.largest(0.0, 1 - exponent, lambda a, s, l: spread(a) <= max_repeats, lambda d: 1 - d)
        elif budget is not None:  # the repetition shrinks as the exponent grows: bisect what is left to 1
            exponent = 1 - shares.largest(0.0, 1 - exponent, lambda a, s, l: budget * repeated(a, s) <= max_repeats * (1 + 1e-12), lambda d: 1 - d)
        norm = shares.sums(lambda _: F.lit(exponent))[0][0]
        size = norm * shares.most ** (1 - exponent) if whole else budget if budget is not None else max_repeats / repeated(exponent, norm)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / (total or 1), F.lit(exponent)) / norm).otherwise(0.0)
    # a hair more, so that a quota of exactly the whole source isn't lost to rounding
    quota = F.floor(F.col("weight") * (size * (total or 0)) + 1e-6).cast("long")
    joined = sources.withColumn("weight", weight).withColumn("exponent", F.lit(exponent))
    return joined.select("source", "tokens", "exponent", "weight", (F.greatest("tokens", quota) if whole else quota).alias("quota"))


def cuts(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """`plan` with `epochs` (whole ones) and `cut`: rows whose place in the last epoch is less than
    `cut` are taken once more; together they have the most tokens that the quota has left.

    sized: (source, key, tokens). Each turn narrows the cut by BLOCK_BITS bits.
    """
    names = plan.columns
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1)).cast("long"))
    left = F.when(F.col("tokens") > 0, F.col("quota") - F.col("epochs") * F.col("tokens")).otherwise(0).cast("long")
    state = materialize(plan.withColumn("left", left).withColumn("cut", F.lit(0).cast("long")))
    open_ = state.where("left > 0").select("source", "epochs")
    placed = materialize(sized.join(few_bytes(open_, 64), "source").select("source", permuted(F.col("key"), F.col("epochs")).alias("at"), "tokens"))
    for used in range(0, BITS, BLOCK_BITS):
        if state.where("left > 0").isEmpty():
            break
        rest = BITS - used - BLOCK_BITS
        inside = placed
        if used:
            cut = state.where("left > 0").select("source", F.col("cut").alias("from"))
            inside = placed.join(few_bytes(cut, 64), "source").where(F.shiftright("at", rest + BLOCK_BITS) == F.shiftright("from", rest + BLOCK_BITS))
        blocks = inside.groupBy("source", F.shiftright("at", rest).alias("block")).agg(F.sum("tokens").alias("n"))
        run = W.partitionBy("source").orderBy("block")
        blocks = blocks.withColumn("upto", F.sum("n").over(run)).join(state.select("source", "left"), "source")
        over = blocks.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("block", (F.col("upto") - F.col("n")).alias("before"))).alias("b"))
        end = F.lit(1 << BITS) if not used else F.col("cut") + F.lit(1 << (rest + BLOCK_BITS))
        state = materialize(state.join(over, "source", "left").select(
            *names, "epochs",
            F.when(F.col("left") <= 0, F.col("left")).when(F.col("b").isNull(), F.lit(0)).otherwise(F.col("left") - F.col("b.before")).cast("long").alias("left"),
            F.when(F.col("left") <= 0, F.col("cut")).when(F.col("b").isNull(), end).otherwise(F.shiftleft("b.block", rest)).cast("long").alias("cut"),
        ))
    return state.drop("left")


def mix(docs: DataFrame, entropy_share: float = 0.9, max_repeats: float = 1.0, budget: float | None = None, text: str = "text", key: str = "doc_id", source: str = "source", whole: bool = False) -> DataFrame:
    """`docs` with n_tokens, weight, copies, and epoch and block of the last copy.

    Rows of copies 0 are not in the mixture; with `whole` there are none, and small sources are
    repeated instead, up to `max_repeats`. Null and empty texts have no tokens and are in it once (of
    no budget); very long texts are counted whole, and one that passes what its source has left is
    not taken in part; null sources are one source with ''; rows of one key in one source are taken
    together; ties in the permutation too; columns of these names are replaced, all others stay as
    they are; an empty table stays empty. `docs` is read twice and has to give the same rows.
    """
    docs = docs.drop(*ADDED)
    group, epochs, cut, at = unused(docs.columns, "group", "epochs", "cut", "at")
    own = F.coalesce(F.col(source).cast("string"), F.lit(""))
    sized = materialize(docs.select(own.alias("source"), F.col(key).alias("key"), count_words(F.col(text)).alias("tokens")))
    plan = weights(sized.groupBy("source").agg(F.sum("tokens").alias("tokens")), entropy_share, max_repeats, budget, whole)
    plan = cuts(sized, plan).select(F.col("source").alias(group), "weight", F.col("epochs").alias(epochs), F.col("cut").alias(cut))
    rows = docs.withColumn(group, own).join(few_bytes(plan, 64), group).withColumn(at, permuted(F.col(key), F.col(epochs)))
    more = (F.col(at) < F.col(cut)).cast("long")
    return rows.select(
        *(F.col(f"`{c}`") for c in docs.columns), count_words(F.col(text)).alias("n_tokens"), "weight", (F.col(epochs) + more).alias("copies"),
        F.when(more > 0, F.col(epochs)).otherwise(F.col(epochs) - 1).alias("epoch"),
        F.shiftright(F.when(more > 0, F.col(at)).otherwise(permuted(F.col(key), F.col(epochs) - 1)), BITS - BLOCK_BITS).alias("block"),
    )
