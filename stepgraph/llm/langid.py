"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text is lower-cased and its UTF-8 bytes, with everything in ASCII that is not a letter read as a space,
give counts of two- and three-byte grams in hashed buckets.  Logarithmic counts times inverse document
frequency, scaled to length 1, are compared by cosine with CLUSTERS centroids for each language (spherical
k-means), and the nearest names the language.  A text farther from every centroid than almost all texts of
its length were in fitting is rejected; lengths that fitting hardly met go by the nearest ones.  The model is
fitted on at most FIT_ROWS documents a language and MOST_ROWS in all, those of the smallest hashes of the id;
predictions read whole texts.

Defined cases: null texts and texts without a letter are "und" with score 0, and rejected; a table with no
labelled document to learn from gives "und" throughout, and then identified_documents rejects nothing; fewer than
LEAST_IN_CLASS of them set no limit; null languages are not learned from; repeated rows each get their row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, internal, lean, table

BITS = 12
SIZE = 2 << BITS
FIT_ROWS = 600
MOST_ROWS = 6_000
CLUSTERS = 3
#: Share of the fitting texts of a length class that may lie farther than the limit, and how far beyond it is still kept.
OUTLIERS, SLACK = 0.01, 0.6
#: A length class with fewer fitting texts takes its limit from the texts of its nearest classes too.
LEAST_IN_CLASS = 20
SEED = 11
CHUNK = 1 << 20
LETTER = re.compile(r"[^\W\d_]")
_KEEP = np.full(256, 32, "u1")
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def grams(text: str) -> np.ndarray:
    """Counts of the hashed grams of a whole text: SIZE longs, two-byte grams first."""
    out = np.zeros(SIZE, "int64")
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), "u1")
    for at in range(0, max(1, len(data) - 2), CHUNK):
        b = _KEEP[data[at : at + CHUNK + 2]].astype("u4")
        pair = b[:-1] * np.uint32(0x9E3779B1) ^ b[1:] * np.uint32(0x85EBCA77)
        last = at + CHUNK + 2 >= len(data)
        two = pair if last else pair[:CHUNK]
        out[: SIZE // 2] += np.bincount(two * np.uint32(0xC2B2AE3D) >> np.uint32(32 - BITS), minlength=SIZE // 2)
        three = (pair[:-1] * np.uint32(0x27D4EB2F) ^ b[2:] * np.uint32(0x165667B1)) * np.uint32(0xC2B2AE3D)
        out[SIZE // 2 :] += np.bincount(three >> np.uint32(32 - BITS), minlength=SIZE // 2)
    return out


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # centroids x SIZE, of length 1
    idf: np.ndarray
    limits: np.ndarray  # least cosine by length class

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        rows = np.log1p(counts).astype("f4") * self.idf
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(1 + counts.sum(axis=1)).astype("int64"), 63)


@dataclass
class Rows:
    """Sparse vectors one after the other: those of row i are at and value from ends[i - 1] to ends[i]; none is empty."""

    at: np.ndarray
    value: np.ndarray
    ends: np.ndarray

    def part(self, first: int, last: int) -> Rows:
        begin = self.ends[first - 1] if first else 0
        return Rows(self.at[begin : self.ends[last - 1]], self.value[begin : self.ends[last - 1]], self.ends[first:last] - begin)

    def starts(self) -> np.ndarray:
        return np.append(0, self.ends[:-1])

    def dot(self, head: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.value * head[self.at], self.starts())

    def dots(self, heads: list[np.ndarray]) -> np.ndarray:
        return np.stack([self.dot(h) for h in heads], axis=1)

    def total(self, rows: np.ndarray) -> np.ndarray:
        """The sum of the rows marked, scaled to length 1."""
        some = np.repeat(rows, np.diff(self.ends, prepend=0))
        out = np.bincount(self.at[some], self.value[some], SIZE).astype("f4")
        return out / max(float(np.linalg.norm(out)), 1e-12)

    def dense(self, row: int) -> np.ndarray:
        out = np.zeros(SIZE, "f4")
        one = self.part(row, row + 1)
        out[one.at] = one.value
        return out


def cluster(rows: Rows, k: int, rounds: int = 12) -> list[np.ndarray]:
    """At most k centroids of length 1 by spherical k-means from mutually far rows."""
    n = len(rows.ends)
    heads = [rows.dense(int(rows.dot(rows.total(np.ones(n, bool))).argmax()))]
    near = rows.dot(heads[0])
    while len(heads) < min(k, n):
        heads.append(rows.dense(int(near.argmin())))
        near = np.maximum(near, rows.dot(heads[-1]))
    for _ in range(rounds):
        own = rows.dots(heads).argmax(axis=1)
        heads = [rows.total(own == c) if (own == c).any() else h for c, h in enumerate(heads)]
    return heads


def fit(at: list[np.ndarray], counts: list[np.ndarray], languages: list[str], clusters: int = CLUSTERS) -> Model:
    """A model of rows in the order of their languages: buckets and counts of each.  Sparse, so memory follows the grams."""
    names = np.array(languages, dtype=object)
    rows = Rows(np.concatenate(at).astype("i4"), np.concatenate(counts), np.cumsum([len(x) for x in at]))
    classes = np.minimum(np.log2(1 + np.add.reduceat(rows.value, rows.starts())).astype("int64"), 63)
    idf = np.log((1 + len(at)) / (1 + np.bincount(rows.at, minlength=SIZE))).astype("f4") + np.float32(1)
    rows.value = np.log1p(rows.value).astype("f4") * idf[rows.at]
    rows.value /= np.repeat(np.maximum(np.sqrt(np.add.reduceat(rows.value**2, rows.starts())), 1e-12), np.diff(rows.ends, prepend=0))
    model = Model([], np.zeros((0, SIZE), "f4"), idf, np.zeros(64))
    heads = []
    for name in sorted(set(languages)):
        mine = np.flatnonzero(names == name)
        found = cluster(rows.part(int(mine[0]), int(mine[-1]) + 1), clusters)
        heads += found
        model.languages += [name] * len(found)
    model.centroids = np.stack(heads).astype("f4")
    cosine = np.full(len(at), -1.0)
    for head in heads:
        cosine = np.maximum(cosine, rows.dot(head))
    if len(cosine) >= LEAST_IN_CLASS:
        for c in range(len(model.limits)):
            away = np.abs(classes - c)
            enough = np.sort(away)[LEAST_IN_CLASS - 1]
            model.limits[c] = SLACK * np.quantile(cosine[away <= enough], OUTLIERS)
    return model


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS, most_rows: int = MOST_ROWS, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model | None:
    """A model of the labelled documents outside the held-out fold; None if there are none.

    Of the rows of one id and language, the one whose text has the smallest hash counts.  The sample is fitted in one
    task; it and the model grow with the number of languages beyond most_rows of them, else with nothing.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"), held_out(key).alias("out"))
    known = known.filter("not out and lang is not null and text is not null").withColumn("h", F.xxhash64(F.lit(SEED), "k"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}  # one row per language
    if not counts:
        return None
    each = max(1, min(fit_rows, most_rows // len(counts)))
    bars = [(name, int(1.25 * each / n * 2**64) - 2**63 if 1.25 * each < n else (1 << 63) - 1) for name, n in counts.items()]
    some = known.join(F.broadcast(spark.createDataFrame(bars, "lang string, bar long")), "lang").filter("h <= bar")
    some = some.groupBy("lang", "h").agg(F.min(F.struct(F.xxhash64("text").alias("x"), "text")).alias("t"))

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for name, h, words in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), frame.column(2), strict=True):
                words = words.as_py()
                if LETTER.search(words):
                    got = grams(words)
                    at = np.flatnonzero(got)
                    yield pa.RecordBatch.from_pydict({"lang": [name], "h": [h], "at": [at.astype("<u2").tobytes()], "n": [got[at].astype("<f4").tobytes()]})

    def model(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for frame in frames for r in frame.to_pylist()), key=lambda r: (r["lang"], r["h"], r["at"], r["n"]))
        left = dict.fromkeys(counts, each)
        kept = []
        for r in rows:
            if left[r["lang"]]:
                left[r["lang"]] -= 1
                kept.append(r)
        if kept:
            made = fit([np.frombuffer(r["at"], "<u2") for r in kept], [np.frombuffer(r["n"], "<f4") for r in kept], [r["lang"] for r in kept])
            yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(made)]})

    made = some.select("lang", "h", "t.text").mapInArrow(count, "lang string, h long, at binary, n binary").repartition(1).mapInArrow(lean(model), "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else None


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores and whether accepted."""
    lang, score, accepted = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    at = [i for i, x in enumerate(texts) if x and LETTER.search(x)] if model else []
    for first in range(0, len(at), 256):
        some = at[first : first + 256]
        counts = np.stack([grams(texts[i]) for i in some])
        cosine = model.vectors(counts) @ model.centroids.T
        best = cosine.argmax(axis=1)
        value = np.clip(cosine.max(axis=1).astype("f8"), 0, 1)
        score[some] = value
        accepted[some] = value >= model.limits[length_class(counts)]
        for i, b in zip(some, best, strict=True):
            lang[i] = model.languages[b]
    return lang, score, accepted


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs with lang_pred, score and accepted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # (languages x CLUSTERS) x SIZE floats
    kept = docs.select(*[F.col(f"`{c}`") for c in keep or []], F.col(text).alias(internal(docs, "_text")))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            lang, score, accepted = predict(frame.column(frame.num_columns - 1).to_pylist(), sent.value)
            columns = [*frame.columns[:-1], pa.array(lang), pa.array(score), pa.array(accepted)]
            yield pa.RecordBatch.from_arrays(columns, [*(keep or []), "lang_pred", "score", "accepted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, ", ".join(filter(None, [schema, "lang_pred string, score double, accepted boolean"])))


def op2_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, learn(docs), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


def identified_documents(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents that are rejected; all of them where there is nothing to learn from."""
    model = learn(docs, **options)
    if model is None:
        return docs
    clear = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # whatever the columns are called
    found = identify(clear, model, text=f"c{docs.columns.index('text')}", keep=clear.columns)
    return found.filter("accepted").select(*clear.columns).toDF(*docs.columns)
