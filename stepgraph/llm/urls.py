"""URL filtering by a sort-merge range join of reversed-host keys.

A host becomes the key of its labels in reverse, each closed by a separator, so a rule's host with all its
subdomains is one interval of keys and intervals nest.  Urls are cut into ranges of (key, path, hash) by a
bounded sample; a rule goes to every range its interval meets.  Each range is swept in key order with a
stack of the rules that are active; among these the longest whose path is a prefix of the url's wins.

Defined cases: a null url, or one without "://", has an empty host and path and meets no rule; rules with
a null or empty host meet nothing, a null path is an empty one; of equal rules block wins; repeated rows
each get their row; an empty table gives an empty result; other columns are not read.  The rules of the
hosts on one branch (a host and its parent domains) must fit into a task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, lower_ascii, shuffle_partitions, table

MARK, NEXT, LOW = "\x01", "\x02", "\x00"
#: Characters of a key that decide its range.
HEAD = 200
#: Sampled urls for each range.
SAMPLE = 64
#: Urls in a range, about, when there are more than shuffle partitions can hold.
RANGE_ROWS = 400_000
OUT = "page_id long, host string, path string, rule string, verdict string"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    """com, example, www, each closed by MARK; empty for an empty host."""
    clean = F.translate(host, LOW + MARK + NEXT, "   ")
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(clean, r"\.")), MARK), F.lit(MARK))
    )


def sweep(rows: Iterator[tuple], default: str) -> Iterator[tuple]:
    """(page, host, path, rule, verdict) from rows (range, key, kind, page, host, path, verdict) in that order; kind 0 is a rule."""
    stack: list[tuple[str, str, dict, list]] = []  # key, host, {path: verdict}, lengths of paths
    now = None
    for part, key, kind, page, host, path, verdict in rows:
        if part != now:
            now, stack = part, []
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if kind == 0:
            if not stack or stack[-1][0] != key or stack[-1][1] != host:
                stack.append((key, host, {}, []))
            rules, lengths = stack[-1][2:]
            if len(path) not in lengths:
                lengths.append(len(path))
            rules[path] = "block" if rules.get(path) == "block" else verdict
            continue
        best = None
        for _, suffix, rules, lengths in stack:
            if host != suffix and not host.endswith("." + suffix):
                continue
            for n in lengths:
                if n <= len(path) and (path[:n] in rules) and (best is None or len(suffix) + n >= best[0]):
                    best = (len(suffix) + n, suffix + path[:n], rules[path[:n]])
        yield page, host, path, best and best[1], best[2] if best else default


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; rules has host, path and verdict."""
    spark = pages.sparkSession
    urls = checkpoint(
        pages.select(F.col(key).cast("long").alias("page"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
        .withColumn("key", key_of(F.col("host")))
        .withColumn("salt", F.hex(F.xxhash64("page", "path", F.monotonically_increasing_id())))
    )
    place = F.concat(F.substring("key", 1, HEAD), F.lit(LOW), F.substring("path", 1, HEAD), F.lit(LOW), F.col("salt"))
    n = urls.count()
    ranges = max(shuffle_partitions(spark), -(-n // RANGE_ROWS))
    # A sample of about SAMPLE urls a range, by hash; it alone reaches the driver.
    keep = F.pmod(F.xxhash64("salt", F.lit(1)), F.lit(1 << 20)) < max(1, min(1 << 20, ranges * SAMPLE * (1 << 20) // max(n, 1)))
    seen = sorted(r[0] for r in urls.filter(keep).select(place).limit(4 * ranges * SAMPLE).collect())
    bounds = sorted({seen[i * len(seen) // ranges] for i in range(1, ranges)}) if seen else []
    columns = ["part", "key", "kind", "page", "host", "path", "verdict"]
    schema = "part int, key string, kind int, page long, host string, path string, verdict string"

    def place_urls(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            at, page, host, path, whole = frame.columns
            part = pa.array([bisect_right(bounds, x) for x in at.to_pylist()], pa.int32())
            one = pa.array([1] * len(page), pa.int32())
            yield pa.RecordBatch.from_arrays([part, whole, one, page, host, path, pa.nulls(len(page), pa.string())], columns)

    def place_rules(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for whole, host, path, verdict in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                first = bisect_right(bounds, whole[:HEAD])
                last = bisect_right(bounds, (whole[:-1] + NEXT)[:HEAD] + NEXT)
                for start in range(first, last + 1, 10_000):
                    parts = list(range(start, min(last + 1, start + 10_000)))
                    k = len(parts)
                    yield pa.RecordBatch.from_pydict(
                        dict(zip(columns, [pa.array(parts, pa.int32()), [whole] * k, pa.array([0] * k, pa.int32()), pa.nulls(k, pa.int64()), [host] * k, [path] * k, [verdict] * k], strict=True))
                    )

    known = (
        rules.select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .filter("host <> ''")
        .withColumn("key", key_of(F.col("host")))
    )
    both = (
        urls.select(place, "page", "host", "path", "key")
        .mapInArrow(place_urls, schema)
        .unionByName(known.select("key", "host", "path", "verdict").mapInArrow(place_rules, schema))
    )

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for frame in frames for row in zip(*(c.to_pylist() for c in frame.columns), strict=True))
        held = []
        for row in sweep(rows, default):
            held.append(row)
            if len(held) >= 20_000:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    def batch(held: list) -> pa.RecordBatch:
        kinds = [pa.int64()] + [pa.string()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], [key, "host", "path", "rule", "verdict"])

    return (
        both.repartitionByRange(ranges, "part")
        .sortWithinPartitions("part", "key", "kind", "host", "path", "verdict")
        .mapInArrow(run, OUT.replace("page_id", key, 1))
    )


#: The fixed rules of the registered query, by its contract; OP7_SQL below still blocks net/de/.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op7_urls(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP7_SQL = r"""
WITH parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rhost, rpath, rverdict) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
keyed AS (SELECT row_number() OVER () AS rid, * FROM parsed),
best AS (
  SELECT rid, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
         max_by(rverdict, length(rhost || rpath)) AS rverdict
  FROM keyed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict
FROM keyed LEFT JOIN best USING (rid)
"""
