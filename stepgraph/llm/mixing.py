"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target number of words.  Whole epochs of the source come first; what is left of
the target (less than one epoch) is fitted exactly: the documents are counted by length, each length
gives its proportional share, and a bounded-knapsack dynamic program over the lengths still free fits
the remaining budget.  Which documents of a length are taken follows a seeded hash of the id.

Defined cases: null text counts 0 words; a null source is a source of its own, last in order; rows
with equal ids are separate documents; documents of size 0 are never drawn for a part of an epoch;
an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, checkpoint, internal, ranked

#: Documents of one source and length are ranked in so many ranges of their hash.
BINS = 4096
#: So many of the shortest lengths give a document back before the knapsack is solved.
RELEASED = 64
#: Bits of the knapsack's table at most, where the first fit misses its budget.
TABLE = 1 << 18


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, epochs: int) -> DataFrame:
    """sources (one row each: w words, _weight) with target: by weight, the sum that of all words, none above epochs times its words.

    The level, words for each unit of weight, rises as sources fill up; each round sums what is full and what is not.
    Only such sums pass through the driver, however many sources there are.
    """
    total, level = None, 0.0
    while True:
        full = F.lit(level) * F.col("_weight") >= F.col("w") * epochs
        free = F.sum(F.when(~full, F.col("_weight")))
        row = sources.agg(F.sum("w").alias("w"), F.sum(F.when(full, F.col("w") * epochs)).alias("full"), free.alias("free")).first()
        total = row["w"] or 0
        if not row["free"] or (higher := (total - (row["full"] or 0)) / row["free"]) <= level:
            return sources.withColumn("target", F.least(F.lit(level) * F.col("_weight"), (F.col("w") * epochs).cast("double")))
        level = higher


def reached(sizes: Sequence[int], free: Sequence[int], order: Sequence[int], rest: int) -> list[int]:
    """The bounded knapsack: how many of the free documents of each size add up as near to rest as any choice does."""
    limit = 2 * rest + 1
    mask = (1 << (limit + 1)) - 1
    reach, steps, take = 1, [], [0] * len(sizes)
    for i in order:
        left, part = min(free[i], limit // sizes[i]), 1
        while left > 0 and not reach >> rest & 1:
            n = min(part, left)
            wider = (reach | reach << (sizes[i] * n)) & mask
            if wider != reach:
                steps.append((i, n, reach))
                reach = wider
            left -= n
            part *= 2
        if reach >> rest & 1:
            break
    at = next(x for d in range(rest + 1) for x in (rest - d, rest + d) if reach >> x & 1)
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            at -= sizes[i] * n
            take[i] += n
    return take


def fit_budget(sizes: Sequence[int], counts: Sequence[int], budget: int, table: int = TABLE) -> list[int]:
    """How many documents of each size to take so that their words come as near budget as can be.

    Sizes are distinct.  The proportional share goes first, from long to short, each length passing on what it could
    not use; then the RELEASED shortest lengths give a document back and a bounded knapsack over the documents left
    fits the rest.  While words are missing or left over, every length gives back more, twice as many each time, until
    all are free and the program's choice is the best of all; its table is kept within so many bits.
    """
    take = [0] * len(sizes)
    total = sum(s * n for s, n in zip(sizes, counts, strict=True))
    if budget <= 0 or total <= 0:
        return take
    if budget >= total:
        return [n if s else 0 for s, n in zip(sizes, counts, strict=True)]
    order = sorted((i for i, s in enumerate(sizes) if s > 0), key=lambda i: sizes[i])
    carry = 0  # in units of 1 / total words
    for i in reversed(order):
        share = sizes[i] * counts[i] * budget + carry
        take[i] = min(counts[i], share // (sizes[i] * total))
        carry = share - take[i] * sizes[i] * total
    best, miss, back = take, None, 1
    while miss != 0:
        kept = list(take)
        for i in order[:RELEASED] if back == 1 else order:  # the program gets these documents to choose from
            kept[i] = max(0, take[i] - back)
        rest = budget - sum(kept[i] * sizes[i] for i in order)
        if miss is not None and 2 * rest > table:
            break
        more = reached(sizes, [n - k for n, k in zip(counts, kept, strict=True)], order, rest)
        gap = abs(rest - sum(more[i] * sizes[i] for i in order))
        if miss is None or gap < miss:
            best, miss = [k + m for k, m in zip(kept, more, strict=True)], gap
        if not any(kept):
            break
        back *= 2
    return best


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    epochs: int = 3,
    seed: int = 20240229,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    row: str | None = None,
) -> DataFrame:
    """One row per document: _uid, key, size, source_size, target and taken (words the mix takes of it).

    Sources in the order of their code points, null last, weigh weights[0], weights[1], ..., repeating.
    _uid tells rows of equal ids apart: the column row of docs, or a number given here.
    """
    name = F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source)))
    narrow = checkpoint(
        docs.select(
            (F.monotonically_increasing_id() if row is None else F.col(row)).alias("_uid"),
            F.col(key).alias(key),
            name.alias("_src"),
            word_count(F.col(text)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(key)).alias("_hash"),
        )
    ).withColumn("_bin", F.pmod(F.shiftright("_hash", 20), F.lit(BINS)).cast("int"))
    bins = narrow.groupBy("_src", "size", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    cells = bins.groupBy("_src", "size").agg(F.sum("_n").alias("_n"))
    totals = cells.groupBy("_src").agg(F.sum(F.col("size") * F.col("_n")).alias("w"))
    last = totals.withColumn("_last", F.col("_src") == "n").withColumn("_all", F.lit(0))
    share = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("double")
    placed = checkpoint(ranked(last, ["_all"], ["_last", "_src"]).select("_src", "w", share.alias("_weight")))
    words, target = F.col("w"), F.col("target")
    whole = F.when(words > 0, F.least(F.lit(epochs), F.floor(target / F.when(words > 0, words)))).otherwise(0).cast("int")
    rest = F.round(target - whole * words).cast("long")
    over = (words > 0) & (rest >= words)
    sources = checkpoint(
        water_fill(placed, epochs).select(
            "_src",
            words.alias("source_size"),
            "target",
            F.when(over, whole + 1).otherwise(whole).alias("_whole"),
            F.when(over | (words == 0), F.lit(0)).otherwise(F.greatest(rest, F.lit(0))).alias("_rest"),
        )
    )

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        sizes, counts = [int(x) for x in part["size"]], [int(x) for x in part["_n"]]
        took = fit_budget(sizes, counts, int(part["_rest"].iloc[0]))
        return pd.DataFrame({"_src": part["_src"], "size": part["size"], "_take": np.array(took, dtype="int64")})

    drawn = (
        cells.join(sources.filter("_rest > 0").select("_src", "_rest"), "_src")
        .groupBy("_src")
        .applyInPandas(fit, "_src string, size long, _take long")
    )
    before = Window.partitionBy("_src", "size").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    quota = (
        bins.join(drawn.filter("_take > 0"), ["_src", "size"])
        .withColumn("_quota", F.col("_take") - F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter("_quota > 0")
        .select("_src", "size", "_bin", "_quota")
    )
    rank = F.row_number().over(Window.partitionBy("_src", "size", "_bin").orderBy("_hash", "_uid"))
    return (
        narrow.join(quota, ["_src", "size", "_bin"], "left")
        .withColumn("_drawn", F.coalesce((rank <= F.col("_quota")).cast("long"), F.lit(0)))
        .join(sources, "_src")
        .withColumn("_copies", F.col("_whole") + F.col("_drawn"))
        .withColumn("taken", F.col("size") * F.col("_copies"))
        .select("_uid", key, "size", "source_size", "target", "taken", "_copies")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs itself, each document as often as the mix takes it.

    Rows are numbered in a checkpoint first, so docs may be any plan, whatever order its rows come in.
    """
    uid, n = internal(docs, "_mix_uid"), internal(docs, "_mix_copies")
    rows = checkpoint(docs.withColumn(uid, F.monotonically_increasing_id()))
    copies = mix(rows, row=uid, **options).filter("_copies > 0").select(F.col("_uid").alias(uid), F.col("_copies").alias(n))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return rows.join(copies, uid).select(*kept, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias(n)).select(*kept)


def op1_mixing(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")
