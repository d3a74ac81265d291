import hashlib
import random

import numpy as np

from orrery.llm import near

from .test_exact_mix_bpe import keep, library, mixed


def classes(texts):
    """Brute force: connected components of pairs of similarity 0.8 or more over five-word shingles."""
    from collections import Counter

    def bag(t):
        w = (t or "").split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()

    bags, up = [bag(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            same = (texts[i] or "").split() == (texts[j] or "").split()
            shared, every = (a & bags[j]).total(), (a | bags[j]).total()
            if same or every and shared / every >= 0.8:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return [root(i) for i in range(len(texts))]


def corpus():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([3, 40, 200]))
        for _ in range(rng.choice([1, 4, 15])):
            own = list(base)
            for _ in range(rng.randint(0, len(base) // 100)):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
    loop = "x y z " * 30
    return [*out, None, "", " \n", "a", "a", " a ", "a b c d", "a b c d e", loop, loop + "x", out[0] + "\n"]


def test_near(spark):
    texts = corpus()
    df = spark.createDataFrame([(i * 2, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, label string, row int")
    got = {r.doc_id: r for r in near.near_duplicates(df).collect()}
    want = classes(texts)
    assert [got[2 * i].class_id for i in range(len(texts))] == [2 * c for c in want]
    assert all(got[2 * i].kept == (c == i) and got[2 * i].class_size == want.count(c) for i, c in enumerate(want))
    assert near.keep_one_of_each(df).columns == df.columns and near.near_duplicates(df.limit(0)).isEmpty()
    odd = spark.createDataFrame([(None, "p q"), (1, "p q"), (1, "p q"), (None, "r")], "doc_id long, text string")
    assert sorted([(r.doc_id, r.class_id, r.class_size, r.kept) for r in near.near_duplicates(odd).collect()], key=str) == sorted([(None, 1, 3, False), (1, 1, 3, True), (1, 1, 3, False), (None, None, 1, True)], key=str)


def test_distinct_texts_under_one_id_stay(spark):
    rows = [(None, "a one"), (None, "b two"), (None, "c three"), (5, "d one"), (5, "e two"), (5, "f"), (2, "f"), (7, "g"), (7, "g"), (None, "f")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    got = sorted([(r.doc_id, r.text) for r in near.keep_one_of_each(df).collect()], key=str)
    assert got == sorted([(None, "a one"), (None, "b two"), (None, "c three"), (5, "d one"), (5, "e two"), (2, "f"), (7, "g")], key=str)


def test_ids_of_64_bits(spark):
    """Ids that agree in their low bits, the greatest and the least long, and null are all told apart."""
    big = 1234567890123456789
    rows = [(big, "a b c"), (big + (1 << 44), "a b c"), (big + 1, "d"), ((1 << 63) - 1, "e"), (None, "e"), (-(1 << 63), "f"), (3, "f"), ((1 << 42) - 1, "g"), (None, "g"), (big, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.class_id, r.kept) for r in near.near_duplicates(df).collect()]
    firsts = {"a b c": big, "d": big + 1, "e": (1 << 63) - 1, "f": -(1 << 63), "g": (1 << 42) - 1, "h": big}
    assert sorted(got, key=str) == sorted([(d, firsts[t], d == firsts[t]) for d, t in rows], key=str)
    assert sorted((r.doc_id, r.text) for r in near.keep_one_of_each(df).collect()) == sorted((d, t) for t, d in firsts.items())


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 62, 900, dtype=np.uint64))
    for shared in (890, 600, 0):
        b = np.unique(np.concatenate([a[:shared], rng.integers(0, 1 << 62, 900 - shared, dtype=np.uint64)]))
        s = near.signatures(np.concatenate([a, b, a[:3]]), np.repeat([0, 1, 2], [len(a), len(b), 3]), 3, k=2000)
        assert abs((s[0] == s[1]).mean() - near.similarity_exact(a, b)) < 0.05


def test_components(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 52), (51, 52)], "a long, b long")
    got = {r.row: r.label for r in near.components(path).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 51: 50, 52: 50}


def test_pipeline_against_brute_force(spark):
    """Each stage on what its predecessor kept, done over in plain Python."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    step = p.STAGES[0][1](spark, docs, sf)
    assert step.columns == docs.columns and {r.doc_id for r in step.collect()} == {d for d, r in rows.items() if any(c.isalpha() for c in r.text or "")}
    left = {d for d, k, *_ in keep([(d, r.text) for d, r in rows.items()]) if d == k}
    ids = sorted(left)
    want = classes([rows[d].text for d in ids])
    ids = [d for i, d in enumerate(ids) if want[i] == i]
    total, target = mixed([(d, rows[d].text, rows[d].source) for d in ids])
    enc, got = library(), p.run(spark, sf).collect()
    assert {r.doc_id for r in got} <= set(ids)
    words = lambda d: len((rows[d].text or "").split())
    for s in total:
        own = [r for r in got if rows[r.doc_id].source == s]
        longest = max([words(d) for d in ids if rows[d].source == s], default=0)
        assert target[s] - 1 <= sum(words(r.doc_id) for r in own) <= target[s] + longest
    for r in got:
        tokens = enc.encode_ordinary(rows[r.doc_id].text)
        assert (r.n_tokens, r.ids_sha256) == (len(tokens), hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest())


def test_rest_of_a_bucket(spark, monkeypatch):
    """All texts in one bucket, whose first text is like none: what is left is found exactly."""
    from pyspark.sql import functions as F

    signed = near.banded
    monkeypatch.setattr(near, "banded", lambda rows: signed(rows).withColumn("bands", F.when(F.size("bands") > 0, F.array(F.lit(1).cast("long"))).otherwise(F.array().cast("array<long>"))))
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    frame = rng.choices(words, k=90)  # a passage that all share, but for the likeness not enough
    texts = ["first " * 7]
    for _ in range(15):
        base = frame + rng.choices(words, k=60)
        for _ in range(4):
            for _ in range(rng.randint(0, 4)):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))  # a chain: each from the one before
    texts += [*corpus(), "last " * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near.near_duplicates(df).collect()}
    want = classes(texts)
    assert len(set(want)) > 20 and [got[i] for i in range(len(texts))] == want
