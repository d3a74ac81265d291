import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import ann, language, quality, queries

SF = "/root/testdata/sf0.01"


def test_ann_small_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (100, [0.9, 0.1]), (2, [0.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = ann.nearest(df, F.col("vec_id") % 100 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 100), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert got[0].score == 0 and abs(got[2].score - 2**0.5) < 1e-12
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).isEmpty() and ann.nearest(df.filter("vec_id in (3, 4)"), F.col("vec_id") >= 0).isEmpty()


def test_ann_recall_and_blocks(spark):
    v = np.random.default_rng(2).standard_normal((3000, 24)).astype(np.float32)
    v[1500:1700] = v[0]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    got = ann.nearest(df, F.col("vec_id") % 30 == 0, query_block=40).collect()
    w, hits = v.astype(float), 0
    for q in range(0, 3000, 30):
        d = np.sqrt(((w - w[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), np.round(d, 9)))[:10]
        mine = sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
        assert len(mine) == 10
        hits += len({i for _, i in mine} & set(want.tolist()))
    assert hits / 1000 > 0.99


def test_ann_estimates_from_bits():
    """Inner products by counting bits are those of the unpacked codes, up to the rounding of the query."""
    rng = np.random.default_rng(3)
    for dim in (5, 64, 100):
        q, x = rng.standard_normal((7, dim)), rng.standard_normal((40, dim))
        planes, codes = ann.Planes(q), ann.packed(x >= 0)
        got = planes.products(2, 7, codes, np.bitwise_count(codes).sum(1, dtype=np.int64))
        want = q[2:] @ np.where(x >= 0, 1, -1).T / np.sqrt(dim)
        assert (np.abs(got - want) <= planes.slack[2:, None] + 1e-12).all() and np.abs(got - want).max() > 0


def _small_network(seed=0):
    net = language.Network(["a", "b", "c"], seed)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    return net


def test_backpropagation_agrees_with_differences():
    rng = np.random.default_rng(0)
    net = _small_network()
    x, size = language._side_by_side([bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (30, 9, 24)])
    y = np.array([0, 3, 1])
    _, grad = net.gradients(x, size, y)
    seen = np.unique(x[:9])
    for name in ("out", "tf", "ub", "uf", "tb", "out_b"):
        w = net.p[name]
        for _ in range(4):
            at = tuple(rng.choice(seen) if n == 256 else rng.integers(0, n) for n in w.shape)
            old, eps = w[at], 1e-5
            w[at] = old + eps
            up = net.gradients(x, size, y)[0]
            w[at] = old - eps
            down = net.gradients(x, size, y)[0]
            w[at] = old
            assert abs((up - down) / (2 * eps) - grad[name][at]) < 1e-6 + 1e-4 * abs(grad[name][at]), name


def _plain_labels(net, text):
    """The network in plain loops, one byte and one unit after the other; a label for every byte."""
    from math import exp, tanh

    n, both = language.HIDDEN, []
    for d in "fb":
        table, u = net.p[f"t{d}"], net.p[f"u{d}"]
        h, out = [0.0] * n, [None] * len(text)
        for t in range(len(text)) if d == "f" else reversed(range(len(text))):
            m = [sum(u[g][j] * h[j] for j in range(n)) for g in range(3 * n)]
            a = [table[g][text[t]] for g in range(3 * n)]
            sig = lambda v: 1 / (1 + exp(-v))
            r, z = [sig(a[g] + m[g]) for g in range(n)], [sig(a[n + g] + m[n + g]) for g in range(n)]
            c = [tanh(a[2 * n + g] + r[g] * m[2 * n + g]) for g in range(n)]
            h = [h[g] + z[g] * (c[g] - h[g]) for g in range(n)]
            out[t] = h
        both.append(out)
    labels = []
    for f, b in zip(*both, strict=True):
        s = [exp(sum(w * v for w, v in zip(row, f + b, strict=True)) + bias[0]) for row, bias in zip(net.p["out"], net.p["out_b"], strict=True)]
        labels.append([v / sum(s) for v in s])
    return labels


def test_every_byte_is_labelled_as_by_plain_loops():
    rng = np.random.default_rng(1)
    net = _small_network(2)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (1, 7, 40, 130)]
    x, size = language._side_by_side(texts)
    got = net.labels(x, size)
    for i, text in enumerate(texts):
        assert np.abs(got[: len(text), :, i] - np.array(_plain_labels(net, text))).max() < 1e-9
    assert np.abs(net.documents(texts) - [np.mean(_plain_labels(net, t), axis=0) for t in texts]).max() < 1e-6


def test_stretches_agree_with_the_whole_text(spark):
    """A trained network labels a long text in stretches as it does in one piece."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = language.learn(docs)
    text = max((r.text for r in docs.collect() if r.text), key=len)[:6000].lower().encode()
    x, size = language._side_by_side([text])
    assert np.abs(net.labels(x, size)[:, :, 0].mean(0) - net.documents([text])[0]).max() < 5e-3


def test_language(spark):
    got = queries.op9_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_language_cases(spark):
    rows = [(i, "the cat and the dog " * 3, "en") for i in range(60)] + [(100 + i, "der hund und die katze " * 3, "de") for i in range(60)]
    rows += [(300, None, "en"), (301, "12 !?", None), (302, "", "de"), (None, "the dog", "en"), (303, "der hund " * 30_000, None), (304, "und", "und"), (300, "the cat", None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, stretch string, lang_pred int")
    got = {(r.doc_id, r.lang_pred): r for r in language.identify(df).collect()}
    assert all((k, "und") in got and got[k, "und"].score == 0 for k in (300, 301, 302))
    assert (None, "en") in got and (303, "de") in got and not got[None, "en"].held_out
    assert language.keep_identified(df).columns == df.columns
    assert language.identify(df.limit(0)).isEmpty()
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_many_languages_and_junk(spark):
    """No language is left out, however many there are, and letters in no language's order go."""
    import random

    rng = random.Random(5)
    words = {f"l{k}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(5)] for k in range(300)}
    many = spark.createDataFrame([(i, " ".join(rng.choices(words[f"l{i % 300}"], k=8)), f"l{i % 300}") for i in range(900)], "doc_id long, text string, lang string")
    drawn = {r.lang for r in language.sample(many).collect()}
    assert drawn == {r.lang for r in many.filter(~language.held_out()).collect()} and len(drawn) > 256
    few = language.sample(many)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in few and "SortMergeJoin" not in few
    two = [(i, " ".join(rng.choices(words[f"l{i % 2}"], k=rng.randint(2, 40))), f"l{i % 2}") for i in range(300)]
    junk = [(1000 + i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=300)), None) for i in range(10)]
    df = spark.createDataFrame(two + junk, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in language.keep_identified(df).collect()}
    assert kept >= set(range(300)) and len(kept) <= 302


def test_isotonic_is_rising_and_pools():
    x, y = quality.isotonic(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert y.tolist() == [0, 0.5, 1, 1] or y.tolist() == [0, 0.5, 1] and x[1] == 1.5


def test_quality(spark):
    got = queries.op7_quality_scores(spark, SF).collect()
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r.score, marks[r.doc_id]) for r in got if r.held_out and r.doc_id in marks]
    good, bad = ([s for s, m in held if m == v] for v in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


@pytest.mark.parametrize("marks", [[], [(1, 1)], [(1, 1), (2, 0), (2, None), (3, 7), (999, 1), (None, 1), (1, 1)]])
def test_quality_cases(spark, marks):
    docs = spark.createDataFrame([(1, "a b.", 5), (2, "", 5), (3, None, 5), (None, "x", 5), (1, "a b.", 5)], "doc_id long, text string, score int")
    got = quality.score_quality(docs, spark.createDataFrame(marks, "doc_id long, quality int")).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 1}) == 1
    assert quality.score_quality(docs.limit(0), spark.createDataFrame(marks, "doc_id long, quality int")).isEmpty()
