"""Near-duplicate groups of the pipeline against a comparison of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepgraph.llm import bitslice, shingles, similar, simhash


def sets_of(text, width=5):
    words = (text or "").split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def kept_by_brute_force(rows):
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(key)
    return sorted(min(g) for g in groups.values())


def near_copies():
    draw = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    passage = [draw.choice(words) for _ in range(30)]
    rows = []

    def add(tokens):
        rows.append((len(rows), " ".join(tokens)))

    for _ in range(25):
        base = [draw.choice(words) for _ in range(draw.choice([3, 12, 60, 200]))]
        if draw.random() < 0.5:
            base += passage
        for edits in (0, 0, 1, 2, 4, 7):
            more = list(base)
            for _ in range(edits):
                more[draw.randrange(len(more))] = draw.choice(words)
            add(more)
    base = [draw.choice(words) for _ in range(150)]
    for _ in range(60):  # one large group of near copies
        more = list(base)
        more[draw.randrange(150)] = "x"
        add(more)
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, " \n")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("part", [1 << 15, 16])
def test_near_copies_at_every_similarity(spark, monkeypatch, part):
    """On an input that gives its rows in another order each time, with short and with cut lists."""
    monkeypatch.setattr(similar, "PART", part)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("_id", "_row", "_one", "_hit", "_b0", "_doc")})
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == kept_by_brute_force(rows)


def test_odd_rows(spark):
    rows = [(None, "a b c"), (7, "A b  c"), (7, "a b c"), (3, None), (2, ""), (9, "word " * 200_000), (8, "word " * 199_999), (None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.deduplicated(docs).select("doc_id", F.length("text")).collect()
    assert sorted(((r[0] is None, r[0], r[1]) for r in got), key=str) == sorted([(False, 7, got_len(got, 7)), (False, 2, 0), (False, 8, 999_995), (True, None, 1)], key=str)
    assert simhash.deduplicated(docs.limit(0)).collect() == []


def got_len(rows, key):
    return next(r[1] for r in rows if r[0] == key)


def test_shingles_are_sets_of_words():
    texts = ["a b", " a\tb\n", None, "", "a b c d e f", "x a b c d e f", "\x0b\x0c", "é " * 3, "w" * 3_000_000 + " v", "t " * 70]
    hashes, offsets = shingles.shingle_sets(texts)
    sets = [set(hashes[offsets[i] : offsets[i + 1]].tolist()) for i in range(len(texts))]
    assert [len(s) for s in sets] == [len(sets_of(t)) for t in texts]
    assert sets[0] == sets[1] and sets[4] < sets[5]
    draw = random.Random(1)
    many = [" ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(40))) for _ in range(400)]
    hashes, offsets = shingles.shingle_sets(many)
    sets = [set(hashes[offsets[i] : offsets[i + 1]].tolist()) for i in range(len(many))]
    for i in range(0, 400, 7):
        for j in range(400):
            assert len(sets[i] & sets[j]) == len(sets_of(many[i]) & sets_of(many[j]))


def test_sketches_are_majorities():
    draw = random.Random(2)
    hashes, offsets = shingles.shingle_sets([" ".join(str(draw.random()) for _ in range(n)) for n in (0, 1, 5, 260, 3000)])
    made = shingles.sketches(hashes, offsets, 2)
    for i in range(5):
        own = hashes[offsets[i] : offsets[i + 1]]
        for c in range(2):
            mixed = shingles.mix(own + np.uint64((c + 1) * 0xD1342543DE82EF95 % (1 << 64)))
            assert int(made[i, c]) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in mixed) > len(own))


@pytest.mark.parametrize("radius", [0, 3, 5, 48, 64, 128])
def test_wide_distances(radius):
    rng = np.random.default_rng(radius)
    values = rng.integers(0, 2**63, (300, 2), dtype="u8")
    values[1::2] = values[::2] ^ (rng.integers(0, 2**63, (150, 2), dtype="u8") & rng.integers(0, 2**63, (150, 2), dtype="u8"))
    plane = bitslice.planes(values)
    plane = np.concatenate([plane, np.zeros((128, 1), "u8")], axis=1)
    for d in (1, 63, 64, 65, 200):
        wanted = bitslice.lanes_of(np.arange(300 - d), plane.shape[1] - 1)
        found = bitslice.positions(bitslice.near_wide(plane, wanted, d, radius)).tolist()
        assert found == [i for i in range(300 - d) if sum(int(x).bit_count() for x in values[i] ^ values[i + d]) <= radius]


def test_a_star_of_near_copies_makes_few_pairs(spark):
    """Copies that are alike with their original only: two pairs for each listing beforehand, few afterwards."""
    draw = random.Random(5)
    base = [f"w{draw.randrange(10_000)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 500):
        more = list(base)
        for at in draw.sample(range(150), draw.choice([1, 2, 3, 4, 8, 12])):
            more[at] = f"x{draw.randrange(10_000)}"
        rows.append((i, " ".join(more)))
    docs = spark.createDataFrame(rows, "_id long, _text string").repartition(4)
    lists = similar.by_minima(docs.withColumn("_root", F.col("_id")), 5)
    assert similar.neighbours(lists).count() <= 2 * similar.FIRST * len(rows)
    hashes, offsets = shingles.shingle_sets([t for _, t in rows])
    sets = [hashes[offsets[i] : offsets[i + 1]] for i in range(len(rows))]
    like = {i for i in range(1, len(rows)) if shingles.alike(sets[0], sets[i])}
    kept = {r.doc_id for r in simhash.deduplicated(docs.toDF("doc_id", "text")).collect()}
    assert len(like) > 150 and kept.isdisjoint(like) and kept == set(kept_by_brute_force(rows))
