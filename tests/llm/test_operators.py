"""Each operator against a brute force, and on nulls, empty tables, repeated rows, ties and extra columns."""

import re
import unicodedata
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from stepgraph.llm import ann, bitslice, html, langid, mixing, packing, quality, quotes, simhash, topk, urls
from stepgraph.llm.common import held_out, ranked
from test_similar import kept_by_brute_force

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (2, "", "en", "a", 0),
    (None, "one two three four", "en", None, 18),
    (4, "word " * 30_000, "en", "b", 150_000),
    (5, "\n\t ", "fr", "b", 3),
    (6, "The cat sat on the mat. " * 3, "en", "a", 72),
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with columns whose names clash with those the operators make."""
    rows = spark.createDataFrame(ODD, DOCS)
    return rows.withColumns({c: F.lit("x") for c in ("size", "taken", "_uid", "score", "fingerprint", "_fp", "predicted", "h", "k0", "c0", "_row", "_one")})


def tokens():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# 1


def test_mix_meets_its_targets(docs):
    rows = mixing.mix(docs).join(docs.select("doc_id", "source", "text"), "doc_id").toPandas()
    assert (rows["size"] == [len(WORD.findall(t or "")) for t in rows["text"]]).all()
    assert (rows["taken"] <= 3 * rows["size"]).all()
    by = rows.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert abs(by["target"].sum() - rows["size"].sum()) < 1e-6 * rows["size"].sum()
    assert ((by["taken"] - by["target"]).abs() <= 0.02 * by["target"] + 50).all()
    again = mixing.mix(docs).toPandas()
    assert sorted(zip(again.doc_id, again.taken)) == sorted(zip(rows.doc_id, rows.taken))


def filled(words, weights, epochs):
    """By brute force: water poured in small steps of exact fractions, one source full at a time."""
    targets, left, free = [Fraction(0)] * len(words), Fraction(sum(words)), set(range(len(words)))
    while free and left:
        step = min([Fraction(epochs * words[i] - targets[i], weights[i]) for i in free] + [left / sum(weights[i] for i in free)])
        for i in free:
            targets[i] += step * weights[i]
            left -= step * weights[i]
        free = {i for i in free if targets[i] < epochs * words[i]}
    return [float(t) for t in targets]


def test_water_fill(spark):
    draw = np.random.default_rng(6)
    cases = [[1, 100, 0], [0, 0], [7], [3, 1, 1, 1, 1000]] + [draw.integers(0, 1000, 12).tolist() for _ in range(3)]
    for words in cases:
        rows = spark.createDataFrame([(f"s{i:03}", w, float((5, 2, 1)[i % 3])) for i, w in enumerate(words)], "_src string, w long, _weight double")
        got = [r.target for r in mixing.water_fill(rows, 3).orderBy("_src").collect()]
        assert got == pytest.approx(filled(words, [(5, 2, 1)[i % 3] for i in range(len(words))], 3), abs=1e-6), words


def test_mix_of_many_sources(spark):
    rows = spark.range(3000).selectExpr("id doc_id", "repeat('w ', cast(id % 7 as int)) text", "if(id % 100 = 0, null, concat('source', id % 1500)) source")
    got = mixing.mix(rows).toPandas()
    assert len(got) == 3000 and (got["taken"] <= 3 * got["size"]).all()
    assert abs(got["taken"].sum() - got["size"].sum()) < 0.2 * got["size"].sum()


def test_knapsack():
    assert sum(n * s for n, s in zip(mixing.fit_budget([3, 5, 7], [10, 10, 10], 71), [3, 5, 7])) == 71
    assert mixing.fit_budget([4], [3], 0) == [0] and mixing.fit_budget([4], [3], 99) == [3]


def test_mix_odd_rows(odd, spark):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix(odd.limit(0)).collect() == []
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_rows_keep_their_copies_on_any_plan(docs):
    """A shuffled input gives its rows in another order whenever it is read."""
    want = {r.doc_id: r._copies for r in mixing.mix(docs).collect() if r._copies}
    for moved in (docs.repartition(8), docs.join(docs.select(F.col("doc_id").alias("other")), F.col("doc_id") == F.col("other")).drop("other")):
        got = {r.doc_id: (r.n, r.texts) for r in mixing.mixed_documents(moved).groupBy("doc_id").agg(F.count("*").alias("n"), F.collect_set("text").alias("texts")).collect()}
        assert {d: n for d, (n, _) in got.items()} == want
        texts = {r.doc_id: r.text for r in docs.collect()}
        assert all(t == [texts[d]] * (texts[d] is not None) for d, (_, t) in got.items())


def test_knapsack_against_every_subset():
    draw = np.random.default_rng(4)
    for _ in range(300):
        sizes = sorted(set(draw.integers(1, 30, draw.integers(1, 5)).tolist()))
        counts = draw.integers(0, 4, len(sizes)).tolist()
        budget = int(draw.integers(0, 120))
        sums = {0}
        for s, n in zip(sizes, counts):
            sums = {x + k * s for x in sums for k in range(n + 1)}
        took = mixing.fit_budget(sizes, counts, budget)
        assert all(0 <= t <= n for t, n in zip(took, counts))
        assert abs(sum(t * s for t, s in zip(took, sizes)) - budget) == min(abs(x - budget) for x in sums), (sizes, counts, budget)


# 2


def test_language(docs, odd, spark):
    model = langid.learn(docs)
    rows = langid.identify(docs, model, keep=["doc_id", "lang", "text"]).withColumn("out", held_out()).toPandas()
    rows = rows[rows["out"] & (rows["text"].str.len() > 100)]
    assert (rows["lang"] == rows["lang_pred"]).mean() > 0.97 and rows["accepted"].mean() > 0.97
    got = {r.doc_id: r for r in langid.identify(odd, model, keep=["doc_id"]).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].accepted for i in (1, 2, 5))
    assert langid.identified_documents(odd).columns == odd.columns
    assert langid.learn(odd.limit(0)) is None and langid.identified_documents(docs.withColumn("lang", F.lit(None).cast("string"))).count() == docs.count()
    clash = docs.withColumns({"lang_pred": F.lit("x"), "accepted": F.lit(0)})
    assert langid.identified_documents(clash).columns == clash.columns
    assert langid.identify(docs.limit(0), model, keep=["doc_id"]).collect() == []
    assert langid.predict(["abc"], None)[0] == ["und"]
    assert langid.predict(["漢字仮名" * 50], model)[2].tolist() == [False]


def test_foreign_texts_of_every_length_are_rejected(docs):
    model = langid.learn(docs)
    draw = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    for n in (40, 200, 10_000, 100_000, 1_000_000):
        texts = ["".join(draw.choice(letters, n)), ("Это русский текст, которого модель не знает. " * (n // 45 + 1))[:n]]
        assert not langid.predict(texts, model)[2].any(), n


# 3

TALK = [
    (1, 0, "u", "Hello there\nHow are you?\n\nSecond part here."),
    (1, 1, "a", "On Monday Bob wrote:\n> Hello there\n> how are  YOU?\n\nI am fine."),
    (1, 2, "u", ">> Second part here.\n> I am fine.\nGreat"),
    (1, 3, "u", "> nothing like it\nx"),
    (1, 4, "a", "> How are you?\nyes"),
    (2, 0, "u", None),
    (None, 1, "u", "> q"),
    (2, None, "u", "z"),
    (2, 0, "u", "a > b"),
]


def test_quotes(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").withColumn("root", F.lit(1))
    rows = quotes.link_quotes(df).collect()
    got = {(r.conv_id, r.turn): (r.text, r.quotes, r.linked, r.parent_turn, r.root_turn, r.depth, r.reply_index) for r in rows if r.conv_id == 1}
    assert got[1, 1] == ("I am fine.", 1, 1, 0, 0, 1, 1)
    assert got[1, 2] == ("Great", 2, 2, 1, 0, 2, 2)
    assert got[1, 3] == ("x", 1, 0, None, 3, 0, 4)
    assert got[1, 4] == ("yes", 1, 1, 0, 0, 1, 3)
    assert len(rows) == len(TALK)
    assert quotes.link_quotes(df.limit(0)).collect() == []


def test_ranked(spark):
    df = spark.range(1000).selectExpr("id", "if(id < 900, 'hot', 'cold') g", "id % 7 o")
    rows = ranked(df, ["g"], ["o", "id"]).collect()
    for g in ("hot", "cold"):
        mine = sorted((r.o, r.id, r._rank) for r in rows if r.g == g)
        assert [r[2] for r in mine] == list(range(len(mine)))


def test_quotes_do_not_depend_on_the_order_of_rows(spark):
    rows = []
    for c in range(40):
        for t in range(6):
            quoted = "" if t == 0 else f"> line {c} {t - 1}\n" if t % 2 else f"> line {c} 0\n>> nothing\n"
            rows.append((c, t, "user", f"{quoted}line {c} {t}\n\nline {c} 0" if t == 3 else f"{quoted}line {c} {t}"))
    rows.append((99, 1, "user", "> long\n" + "word " * 200_000))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(df.repartition(8)).collect()}
    assert got == {(r.conv_id, r.turn): r for r in quotes.link_quotes(df.coalesce(1)).collect()} and len(got) == len(rows)
    for c in range(40):  # brute force: the earliest message that holds the quoted line
        for t in range(1, 6):
            wanted = t - 1 if t % 2 else 0
            assert got[c, t].parent_turn == wanted and got[c, t].text.startswith(f"line {c} {t}") and got[c, t].root_turn == 0
    assert len(got[99, 1].text) == 1_000_000 - 1 and got[99, 1].linked == 0


def test_a_passage_said_twice_belongs_to_the_first(spark):
    rows = [(1, 0, "u", "same words"), (1, 1, "a", "same words"), (1, 2, "u", "> Same   words\nyes"), (1, 3, "u", ">\n> \nblank quote")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("_uid", "hash", "parent", "said", "level")})
    got = {r.turn: r for r in quotes.link_quotes(df).collect()}
    assert got[2].parent_turn == 0 and got[2].text == "yes" and got[1].parent_turn is None and got[3].quotes == 0 and got[3].text == "blank quote"


# 4 and 6


def vectors(spark, n=3000, d=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype("f4")
    x[n // 2 :] = x[: n - n // 2] if n % 2 == 0 else x[n // 2 :]  # every vector twice: ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    bad = [(n, None), (n + 50, [None] + [1.0] * (d - 1)), (n + 100, [float("nan")] * d), (n + 150, [float("inf")] * d), (None, [1.0] * d)]
    return x.astype("f8"), spark.createDataFrame(rows + bad + [(n + 200, [1.0, 2.0])], "vec_id long, embedding array<float>")


def test_exact_top_k(spark):
    x, df = vectors(spark)
    got = {}
    for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), 5, shard=700).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = np.floor(256 * x)
    for q in range(0, len(x), 50):
        score = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:5]
        assert sorted(got[q]) == [(k + 1, i, int(score[i])) for k, i in enumerate(order)]
    assert set(got) == set(range(0, len(x), 50))
    assert topk.top_k(df.limit(0), df.limit(0), 5).collect() == []


def packed_shard(ids, rows):
    order = topk.arrange(rows)
    ids, rows = ids[order], topk.quantise(rows[order])
    starts = np.arange(0, len(ids), topk.BLOCK_ROWS)
    high, low = (f.reduceat(rows, starts, axis=0) for f in (np.maximum, np.minimum))
    return {"ids": ids.astype("<i8").tobytes(), "dim": rows.shape[1], "data": rows.tobytes(), "high": high.tobytes(), "low": low.tobytes()}


@pytest.mark.parametrize("spread", [0.01, 3.0])
def test_pruning_skips_blocks_and_stays_exact(spread):
    """Close groups let most blocks be skipped; where nothing can be, the results are as exact."""
    rng = np.random.default_rng(0)
    rows = np.repeat(rng.normal(size=(16, 8)) * 4, 64, axis=0) + rng.normal(size=(1024, 8)) * spread
    ids = rng.permutation(1024)
    visits = []
    found = {q: (vecs.tolist(), scores.tolist()) for q, vecs, scores in topk.prune(packed_shard(ids, rows), ids[::10], rows[::10], 5, visits=visits)}
    whole = np.floor(256 * rows)
    for at, i in enumerate(range(0, 1024, 10)):
        score = whole @ whole[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:5]
        assert found[at] == (ids[order].tolist(), score[order].astype(int).tolist())
    blocks = 1024 // topk.BLOCK_ROWS
    assert sum(visits) / (len(visits) * blocks) < 0.5 if spread < 1 else max(visits) <= blocks


def test_searches_over_many_shards_and_blocks(spark, monkeypatch):
    """Cells of several shards and blocks, other dimensions among them, columns of clashing names, and ties."""
    from stepgraph.llm import vectors as both

    monkeypatch.setattr(both, "BYTES", 16 * 8 * 100)
    x, df = vectors(spark, 1200)
    df = df.repartition(3).withColumns({c: F.lit(1) for c in ("n", "score", "query_id", "rank", "_g", "dim")})
    wanted = df.filter("vec_id % 2 = 0")
    exact = {}
    for r in topk.top_k(df, wanted, 5, shard=100).collect():
        exact.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    near = {}
    for r in ann.nearest(df, wanted, 5, shard=100, depth=8).collect():
        near.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    whole = np.floor(256 * x)
    for q in range(0, 1200, 2):
        for scores, got in ((whole @ whole[q], [(k, v) for k, v, _ in sorted(exact[q])]), (ann.exactly(x, x[q], np.arange(1200)), sorted(near[q]))):
            order = [i for i in np.lexsort((np.arange(1200), -scores)) if i != q][:5]
            assert got == [(k + 1, i) for k, i in enumerate(order)]
    assert set(exact) == set(near) == {q for q in range(0, 1200, 2)}


def test_sample_for_codebooks_is_as_large_as_meant(spark):
    df = spark.range(9000).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    assert len(ann.sample(df, "embedding", "vec_id", 4000, 7)[2]) == 4000


def test_ann_recall(spark):
    x, df = vectors(spark, 9001, 32)
    got = {}
    for r in ann.nearest(df.coalesce(1), df.filter("vec_id % 100 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q in range(0, len(x), 100):
        score = x @ x[q]
        score[q] = -np.inf
        best = set(np.argsort(-score)[:20])
        hit += len(best & {v for _, v, _ in got[q]})
        assert all(abs(s - x[v] @ x[q]) < 1e-9 for _, v, s in got[q])
        assert [k for k, _, _ in sorted(got[q])] == list(range(1, 21))
    assert hit / (20 * len(range(0, len(x), 100))) >= 0.9
    assert ann.nearest(df.limit(0), df.limit(0), 20).collect() == []


# 5


@pytest.mark.parametrize("noise", [0, 1e-4])
def test_ann_hot_group(noise):
    draw = np.random.default_rng(2)
    rows = draw.normal(size=(3000, 16))
    rows[::3] = rows[0] + noise * draw.normal(size=(1000, 16))
    ids = draw.permutation(3000)
    books = ann.fit(rows[:1000])
    codes = ann.encode(rows, books, ann.eta(16))
    both = np.ascontiguousarray((codes[:, ::2] | codes[:, 1::2] << 4).T)
    shard = {"ids": ids.astype("<i8").tobytes(), "dim": 16, "data": rows.astype("<f8").tobytes(), "codes": both.tobytes()}
    for q, found, _ in ann.scan(shard, ids[:60], rows[:60], books, 20, ann.DEPTH):
        others = np.flatnonzero(ids != ids[q])
        exact = ann.exactly(rows, rows[q], others)
        assert found.tolist() == ids[others][np.lexsort((ids[others], -exact))[:20]].tolist()


def test_quality(spark, docs, odd):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.learn(docs, labels)
    rows = quality.scored(docs, model, keep=["doc_id"]).join(labels, "doc_id").toPandas()
    assert (rows["predicted"] == rows["quality"]).mean() > 0.9 and rows["score"].between(0, 1).all()
    assert quality.scored(odd, model, keep=["doc_id"]).filter("score is null").count() == 0
    kept = quality.good_documents(odd, labels)
    assert kept.columns == odd.columns
    nothing = quality.learn(docs, labels.limit(0))
    assert quality.scored(odd, nothing).first().score == 0.5


def test_scoring_of_an_empty_table_and_of_repeated_ids(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.learn(docs, labels)
    assert quality.scored(docs.limit(0), model, keep=["doc_id"]).collect() == []
    once = quality.learn(docs.unionByName(docs).unionByName(docs), labels)
    assert once.weights == model.weights and once.rules == model.rules  # a row that repeats counts once


def test_statistics_against_plain_python(spark):
    texts = ["Ünï CODE!! a,b. 12 #$ |x|\n\nĀ é 9\u0663", "", None, "a" * 100_000, "\n", "x x\tx"]
    rows = quality.with_statistics(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", ["i"]).collect()
    share = lambda n, of: n / of if of else 0.0
    for r in rows:
        t = texts[r.k0] or ""
        words, lines = WORD.findall(t), t.split("\n")
        want = {
            "chars": len(t), "words": len(words), "word_length": share(len(t), len(words)), "distinct_words": share(len(set(words)), len(words)),
            "lines": len(lines), "distinct_lines": share(len(set(lines)), len(lines)), "line_length": len(t) / len(lines),
            "upper": share(sum(unicodedata.category(c) == "Lu" for c in t), len(t)), "letters": share(sum(unicodedata.category(c)[0] == "L" for c in t), len(t)),
            "digits": share(sum(c in "0123456789" for c in t), len(t)), "symbols": share(sum(c in "#$%&*" for c in t), len(t)), "pipes": share(t.count("|"), len(t)),
            "shouts": share(t.count("!"), len(t)), "stops": share(t.count("."), len(t)), "commas": share(t.count(","), len(t)), "breaks": share(t.count("\n"), len(t)),
        }
        assert {k: r[k] for k in want} == pytest.approx(want), r.k0


def test_rules_are_conjunctions_over_paths():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.3)).astype("f8")
    model = quality.fit(x, y)
    assert model.rules and all(r.tests for r in model.rules)
    total = model.bias + sum(w * r.hits(x) for r, w in zip(model.rules, model.weights))
    assert ((total > 0) == (y > 0)).mean() > 0.97


# 7


def test_urls_against_brute_force(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("example.com", "", "block"), ("a.example.com", "/", "allow"), ("com", "/en/", "allow"), ("", "/x", "block"), ("net", "/é", "block")]
    links = [None, "no scheme", "http://", "http://COM/en/1", "http://www.example.com/en/77?x#y", "https://b.a.example.com/en/7", "http://notexample.com/en/7", "x://example.com?en", "http://example.com/en/6://a.example.com/", "http://q.net/éa", "http://com/en/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(links * 40)], "page_id long, url string").withColumn("host", F.lit("x"))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, table).collect()}

    def expected(u):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda f: (f[0], f[2] == "block"), default=(0, None, "allow"))
        return host, path, best[1], best[2]

    assert got == {i: expected(u) for i, u in enumerate(links * 40)}
    assert urls.filter_urls(df.limit(0), table).collect() == []


def test_a_hot_host_and_a_very_long_url(spark):
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow")], "host string, path string, verdict string")
    links = [f"http://hot.example.com/en/{i}" for i in range(3000)] + ["http://a.com/en/" + "x" * 200_000, "http://" + "a." * 50_000 + "com/en/"]
    df = spark.createDataFrame(list(enumerate(links)), "page_id long, url string").withColumns({c: F.lit("x") for c in ("rule", "verdict", "_key", "path")})
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(df, rules).collect()}
    assert got == {i: ("example.com/en/7", "allow") if "example" in u and "/en/7" in u else ("com/en/", "block") for i, u in enumerate(links)}


def test_registered_rules_are_those_of_the_contract(spark, tmp_path):
    """block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"""
    links = ["http://a.com/en/1", "http://example.com/en/71", "http://a.net/de/1", "http://www.example.net/de/8", "http://x.org/es/", "http://a.net/en/"]
    spark.createDataFrame(list(enumerate(links)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.rule, r.verdict) for r in urls.op7_urls(spark, str(tmp_path)).orderBy("page_id").collect()]
    assert got == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "allow")]


# 8


def brute_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark, docs, odd):
    rows = simhash.near_duplicates(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {d: brute_print(t) for d, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{p:016x}" for d, p in prints.items()}
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id: r.component_id for r in rows} == {d: find(d) for d in ids}
    got = simhash.near_duplicates(odd.select("doc_id", "text")).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    assert simhash.near_duplicates(odd.limit(0)).collect() == []
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == 4


def test_long_lists_are_compared_part_by_part(spark):
    rng = np.random.default_rng(3)
    base = np.uint64(0x0123456789ABCDEF)
    values = sorted({int(base) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 20, (300, 2))})
    df = spark.createDataFrame([(v,) for v in values], "_fp long")
    from stepgraph.llm.components import components

    for part in (1 << 15, 16):
        nodes = {r.node: r.root for r in components(simhash.links(df, part=part)).collect()}
        assert set(nodes) == set(values) and len(set(nodes.values())) == 1


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    values = rng.integers(0, 2**63, 200, dtype="u8")
    values[1::2] = values[::2] ^ np.array([sum(1 << int(b) for b in set(rng.integers(0, 64, k % 6))) for k in range(100)], "u8")
    plane = np.concatenate([bitslice.planes(values), np.zeros((64, 1), "u8")], axis=1)
    for d in (1, 2, 63, 64, 65, 130):
        want = np.zeros(256, "u1")
        want[: 200 - d] = 1
        found = np.unpackbits(bitslice.near(plane, np.pad(np.packbits(want, bitorder="little").view("<u8"), (0, plane.shape[1] - 1 - 4)).copy(), d, radius).view("u1"), bitorder="little")
        for i in range(200 - d):
            assert found[i] == (int(values[i] ^ values[i + d]).bit_count() <= radius)


# 9


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Home</li></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><header><h1>Title &amp; more</h1></header><p>One  <b>bold</b>
    text&#33;</p><aside>side</aside><p>Two<br>lines<p>Three<script>var t="</p>";</script><div class="ad">Buy</div>
    <section id="comments"><p>Nice!</p></section></article><form>Search</form><footer>&copy;</footer>"""
    assert html.lines_of(page) == (["Title & more", "One bold text!", "Two lines", "Three"], True)
    assert html.lines_of(None) == ([], False) and html.lines_of("<p>a<!-- x -->b") == (["ab"], False)


@pytest.mark.parametrize("around", ["form", 'div class="content-sidebar-wrap"', 'div class="container has-sidebar"'])
def test_what_holds_the_article_is_not_dropped(around):
    name = around.split()[0]
    page = f"<body><{around}><nav>menu</nav><article><p>Body.</p></article></{name}><div class=sidebar>more</div></body>"
    assert html.lines_of(page) == (["Body."], True)


@pytest.mark.parametrize("around", ["has-sidebar", "content with-ads", "no-menu", "menu-open", "page-with-comments", "hasSidebar", "ad-free"])
def test_what_an_element_goes_with_does_not_drop_it(around):
    assert html.lines_of(f'<div class="{around}"><p>x</p></div>') == (["x"], False)
    assert html.lines_of(f'<div class="{around}"><article><p>x</p></article></div>') == (["x"], True)


@pytest.mark.parametrize("name", ["sidebar", "post-sidebar", "comment-list", "related-articles", "newsletterSignup", "ad-slot-2", "site-footer", "cookie-notice", "share-buttons", "topNav"])
def test_what_a_class_names_is_dropped(name):
    assert html.lines_of(f'<main><p>x</p><div class="big {name}"><p>y</p></div><p id="{name}">z</p></main>') == (["x"], True)


def test_shared_lines_are_a_longest_common_subsequence():
    draw = np.random.default_rng(8)
    for _ in range(300):
        a, b = ([str(x) for x in draw.integers(0, draw.integers(1, 9), draw.integers(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = [a[i] for i in sorted(html.shared(a, b))]
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(x in rest for x in found)
    long = [str(i) for i in range(6000)]
    assert html.shared(long, ["new", *long[::-1][:1], *long[:3000], "x", *long[3000:]]) == set(range(6000))


def test_differencing(spark):
    rows = [
        (1, "http://a.com/x/1", "<p>Welcome</p><p>Story one.</p><p>Foot</p>"),
        (2, "http://a.com/x/2", "<p>Welcome</p><p>Story&nbsp;two.</p><p>Foot</p>"),
        (3, None, None),
        (4, "http://b.com/", "<p>alone"),
        (4, "http://b.com/", "<p>alone"),
        (5, "http://a.com/y", "<article><p>Welcome</p></article>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.main_text(df).collect())
    assert got == [(1, "Story one.", 10), (2, "Story two.", 10), (3, "", 0), (4, "alone", 5), (4, "alone", 5), (5, "Welcome", 7)]
    assert html.main_text(df.limit(0)).collect() == []


def test_every_page_is_differenced_and_then_checked(spark):
    def page(ad, text):
        return f"<nav><p>Home</p></nav><div class=ad>{ad}</div><article><p>Same words.</p><p>{text}</p></article><footer>Foot</footer>"

    rows = [(i, f"http://a.com/x/{i}", page(f"Buy {i}", f"Story {i}.")) for i in range(3)]
    rows += [(3, "http://b.com/1", page("Buy", "Alone.")), (4, "http://c.com/1", "<main></main><p>Welcome</p><p>One.</p>"), (5, "http://c.com/2", "<main></main><p>Welcome</p><p>Two.</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_lines, r.n_shared, r.n_restored, r.n_removed) for r in html.main_text(df).collect()}
    for i in range(3):  # Home, Same words. and Foot are shared, the second is restored, Buy is removed
        assert got[i] == (f"Same words.\nStory {i}.", 5, 3, 1, 1)
    assert got[3] == ("Same words.\nAlone.", 5, 0, 0, 3)
    assert got[4] == ("One.", 2, 1, 0, 0) and got[5] == ("Two.", 2, 1, 0, 0)


def test_copies_are_differenced_alike(spark):
    page = "<div class=ad>{}</div><p>Welcome</p><p>Story one.</p>"
    rows = [(i, f"http://a.com/x/1?ref={i}", page.format(i % 3)) for i in range(7)] + [(9, "http://a.com/x/2", "<p>Welcome</p><p>Story two.</p>")]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        got = sorted((r.page_id, r.text) for r in html.main_text(df).collect())
        assert got == [(i, "Story one.") for i in range(7)] + [(9, "Story two.")]


def test_pages_are_paired_with_the_nearest_path(spark, monkeypatch):
    monkeypatch.setattr(html, "RUN", 4)
    draw = np.random.default_rng(9)
    paths = sorted({"/" + "".join(draw.choice(list("ab/"), draw.integers(0, 9))) for _ in range(200)})
    rows = [(bytes([i, h]), f"h{h}", x, [i]) for h in (0, 1) for i, x in enumerate(paths)] + [(b"lone", "", "/", [7])]
    got = {bytes(r._page): r._near for r in html.nearest(spark.createDataFrame(rows, "_page binary, _host string, _path string, _keys array<long>")).collect()}
    assert len(got) == len(rows) and got[b"lone"] is None
    for page, _, path, (i,) in rows[:-1]:
        (j,) = got[page]
        assert j != i and html._common(path, paths[j]) == max(html._common(path, x) for k, x in enumerate(paths) if k != i)


def test_odd_pages(spark):
    long = "<article>" + "<p>word</p>" * 60_000 + "</article>"
    rows = [(1, "http://a.com/1", long), (2, "http://a.com/2", "<main><p>cut of"), (3, "http://a.com/3", "<p>a<div class='x"), (4, "http://a.com/4", "<<>&lt;&#x41;&bogus;"), (5, "u", "<!-- never closed <p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("n_chars", "_uid", "_host", "_lines", "_rank")})
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert got[1].count("word") == 60_000 and got[2] == "cut of" and got[3].startswith("a") and got[5] == "" and "<A&bogus;" in got[4]


# 10


def test_packing_round_trip(docs, odd):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens())
    for df in (docs, odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), odd.limit(0)):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        rows = packing.pack(df, tokens()).toPandas().sort_values(["sequence_id", "offset"])
        ids = {d: np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}
        for r in rows.itertuples():
            assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(ids[r.doc_id]) == r.doc_tokens
        starts = rows.sort_values(["doc_id", "start"]).groupby("doc_id")
        assert (starts["length"].cumsum() - rows["length"] == rows["start"]).all()
        assert (rows.groupby("sequence_id")["length"].cumsum() - rows["length"] == rows["offset"]).all()
        used = rows.groupby("sequence_id")["length"].sum()
        assert (used <= 2048).all() and set(starts["length"].sum().items()) == {(d, len(i)) for d, i in ids.items()}


def test_best_fit_decreasing():
    lengths = [700, 600, 1400, 1300, 40, 2048, 8]
    assert sorted(sorted(lengths[i] for i in w) for w in packing.best_fit(lengths)) == [[8, 40, 600, 1400], [700, 1300], [2048]]


def test_encoder_equals_the_tokenizer():
    encode = packing.Encoder(tokens())
    texts = ["İstanbul ΣΑΣ é ́x a\x85b a\xa0b \x1cq it's IT'S don''t <|endoftext|> <|x 1234 ñ١ Ⅷ 中文 👍🏽 ﬁ", "", " \n ", "x" * 5000, "Ñandú's ½ cafés, $5!"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [c.ids for c in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_any_other_tokenizer_encodes_whole_texts(odd, spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = packing.Encoder(path)
    texts = ["Two  words, it's IT'S \n x", "", "naïve 中文 👍🏽" * 50]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [c.ids for c in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert not encode.in_pieces and packing.Encoder(tokens()).in_pieces
    rows = packing.pack(odd.withColumns({c: F.lit("x") for c in ("start", "length", "sequence_id")}), path).collect()
    first = [r.doc_id for r in rows if r.start == 0]
    assert len(first) == len(ODD) and first.count(None) == 1 and first.count(2) == 2


def test_encoder_equals_the_tokenizer_on_every_plain_character():
    encode = packing.Encoder(tokens())
    texts = [w for c in map(chr, range(0x250)) for w in (f"ab{c}cd", f"AB{c}CD", f"{c}LI", f"KPALIM{c}", f"1{c}2", f"a{c}{c}b '{c}s")]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [c.ids for c in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_pipeline(spark, docs):
    df = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, df, SMALL)
        assert after.columns == docs.columns, name
        if name in ("quality", "language"):
            assert 0 < after.count() <= df.count()
        if name == "near_duplicates":
            assert {r.doc_id for r in after.collect()} == set(kept_by_brute_force([(r.doc_id, r.text.lower()) for r in df.collect()]))
        if name == "mixing":
            want = {(r._uid, r._copies) for r in mixing.mix(df).collect()}
            assert after.count() == sum(n for _, n in want)
        df = after
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_pipeline_of_odd_and_empty_tables(spark, odd, tmp_path):
    """Rows with nulls and repeats pass through every stage; empty tables and missing labels give defined results."""
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, rows, marks in (("odd", plain, labels), ("empty", plain.limit(0), labels), ("unlabelled", plain, labels.limit(0))):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        marks.write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert got == [] if name == "empty" else {r.doc_id for r in got} <= {1, 2, None, 4, 5, 6}
