"""Reducers as ordered folds over a log of writes (keys, order..., value).

Every fold is aggregated before the shuffle; lists that are deduplicated or cut to a length are so before
they are gathered, so a run with very many writes gathers only what its field keeps.  order must be total.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _order(order: list[str]) -> Column:
    return F.struct(*order)


def _gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("_o", "_v")))
    return rows.groupBy(*keys).agg(F.transform(pairs, lambda p: p["_v"]).alias("value"))


def last_value(writes: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return writes.groupBy(*keys).agg(F.max_by(value, _order(order)).alias("value"))


def first_value(writes: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return writes.groupBy(*keys).agg(F.min_by(value, _order(order)).alias("value"))


def total(writes: DataFrame, keys: list[str], order: list[str], value: str, ordered: bool = False) -> DataFrame:
    """The sum; ordered adds doubles in write order, for results that must not depend on partitioning."""
    if not ordered:
        return writes.groupBy(*keys).agg(F.sum(value).alias("value"))
    rows = _gathered(writes.select(*keys, _order(order).alias("_o"), F.col(value).alias("_v")), keys)
    return rows.withColumn("value", F.aggregate("value", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))))


def append(writes: DataFrame, keys: list[str], order: list[str], value: str, unique: bool = False, max_length: int | None = None) -> DataFrame:
    """Values in write order; unique keeps first occurrences, max_length the last ones after that.  Nulls are elements."""
    rows = writes.select(*keys, _order(order).alias("_o"), F.col(value).alias("_v"))
    if unique:
        rows = rows.groupBy(*keys, "_v").agg(F.min("_o").alias("_o"))
    if max_length is not None:
        if max_length < 1:
            raise ValueError("max_length must be positive")
        late = Window.partitionBy(*keys).orderBy(F.desc("_o"))
        rows = rows.withColumn("_r", F.row_number().over(late)).filter(F.col("_r") <= max_length).drop("_r")
    return _gathered(rows, keys)


def union(writes: DataFrame, keys: list[str], order: list[str], value: str, by: Column | None = None) -> DataFrame:
    """Membership: the first element of each identity; those whose identity by is null are told apart by their value."""
    if by is None:
        return append(writes, keys, order, value, unique=True)
    rows = writes.select(*keys, _order(order).alias("_o"), F.col(value).alias("_v"), by.alias("_k"))
    rows = rows.withColumn("_w", F.when(F.col("_k").isNull(), F.to_json(F.struct("_v"))))
    rows = rows.groupBy(*keys, "_k", "_w").agg(F.min(F.struct("_o", "_v")).alias("_f")).select(*keys, "_f._o", "_f._v")
    return _gathered(rows, keys)


def merge(writes: DataFrame, keys: list[str], order: list[str], key: str, value: str) -> DataFrame:
    """A map from writes of one entry each; the last write of a key wins, a null value included."""
    rows = writes.groupBy(*keys, key).agg(F.max_by(value, _order(order)).alias("_v"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("_k"), "_v")))
    return rows.groupBy(*keys).agg(F.map_from_entries(entries).alias("value"))


def merged_deep(left: dict, right: dict) -> dict:
    out = dict(left)
    for k, v in right.items():
        out[k] = merged_deep(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def merge_deep(writes: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """JSON objects merged recursively in write order; other values are ignored.  Dynamic maps have no built-in fold."""
    @F.pandas_udf("string")
    def fold(lists: pd.Series) -> pd.Series:
        out = []
        for items in lists:
            state: dict = {}
            for item in items:
                part = json.loads(item) if item else None
                if isinstance(part, dict):
                    state = merged_deep(state, part)
            out.append(json.dumps(state, sort_keys=True))
        return pd.Series(out)

    rows = _gathered(writes.select(*keys, _order(order).alias("_o"), F.col(value).alias("_v")), keys)
    return rows.withColumn("value", fold("value"))


#: What an accumulating reducer starts from.
ZERO = {"append": [], "union": [], "merge": {}, "sum": 0}
