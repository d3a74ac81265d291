"""Both substring deduplicators against brute force, on texts that share passages."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import graph, queries, suffixes, windows


def brute(rows, units, window, join):
    first = {}
    key = lambda u, i: tuple(u[i : i + window])
    order = lambda d: float("inf") if d is None else d
    for doc, text in rows:
        u = units(text)
        for i in range(len(u) - window + 1):
            k = key(u, i)
            first[k] = min(first.get(k, float("inf")), order(doc))
    out = []
    for doc, text in rows:
        u = units(text)
        gone = set()
        for i in range(len(u) - window + 1):
            if first[key(u, i)] < order(doc):
                gone.update(range(i, i + window))
        spans = sum(i in gone and i - 1 not in gone for i in range(len(u)))
        out.append((doc, len(u), len(gone), spans, hashlib.sha256(join([x for i, x in enumerate(u) if i not in gone])).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abé", k=rng.randint(1, 4))) for _ in range(12)]
    said = lambda n: rng.choice([" ", "  ", "\n"]).join(rng.choices(words, k=n))
    passages = [said(rng.randint(13, 60)) for _ in range(4)]
    rows = []
    for d in range(40):
        parts = [said(rng.randint(0, 30))] + [x for _ in range(rng.randint(0, 3)) for x in (rng.choice(passages)[rng.randint(0, 9) :], said(rng.randint(0, 5)))]
        rows.append((d * 3 % 41, " ".join(parts)))
    copy = max((t for _, t in rows), key=len)
    return [*rows, (90, copy), (90, copy), (91, None), (92, ""), (93, "ab" * 400), (94, "ab" * 90), (95, "x " * 300), (96, "x " * 20), (90, "x " * 40), (None, copy), (None, "ab" * 100), (97, "\x00" * 80), (98, "\x00" * 60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, gone string, row int")
    got = suffixes.remove_repeated_bytes(df).collect()
    want = brute([(d, (t or "").encode()) for d, t in rows], lambda b: [b[i : i + 1] for i in range(len(b))], 50, b"".join)
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got], key=str) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, hits string")
    got = graph.remove_repeated_words(df).collect()
    want = brute([(d, (t or "").encode()) for d, t in rows], bytes.split, 13, b" ".join)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in got], key=str) == sorted([(w[0], w[1], w[2], w[4]) for w in want], key=str)


def test_ids_of_64_bits(spark):
    """The document of smaller id keeps its text, whatever the ids' size."""
    far = {d: d * ((1 << 56) + 7) - (1 << 61) for d in range(64)}
    rows = [(far.get(d, d if d is None else (1 << 62) + d), t) for d, t in corpus(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bytes_ = brute([(d, (t or "").encode()) for d, t in rows], lambda b: [b[i : i + 1] for i in range(len(b))], 50, b"".join)
    got = suffixes.remove_repeated_bytes(df).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got], key=str) == bytes_
    words = brute([(d, (t or "").encode()) for d, t in rows], bytes.split, 13, b" ".join)
    got = graph.remove_repeated_words(df).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in got], key=str) == sorted([(w[0], w[1], w[2], w[4]) for w in words], key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeated_bytes(df).isEmpty() and graph.remove_repeated_words(df).isEmpty()


def test_suffix_order_is_lexicographic():
    rng = np.random.default_rng(1)
    raw = rng.choice(np.frombuffer(b"ab", np.uint8), 900)
    buf = np.concatenate([raw, np.zeros(3 * suffixes.reach(50), np.uint8)])
    text = buf.tobytes()
    got = suffixes.suffix_order(buf, np.arange(900))
    assert [text[i : i + 50] for i in got] == sorted(text[i : i + 50] for i in range(900))


def test_pieces_of_long_texts_agree(monkeypatch):
    """Cut at any place, the runs hold each window once, under the same anchor."""
    rng = random.Random(4)
    texts = [bytes(rng.choices(b"ab", k=3000)), b"", b"a" * 49, bytes(rng.choices(b"ab", k=50))]
    laid = windows.lay(texts, False)

    def held():
        return sorted((s + j, h) for s, n, h in zip(*(x.tolist() for x in windows.runs(laid, 50, 16)), strict=True) for j in range(n))

    whole = held()
    assert [w[0] for w in whole] == [*range(2951), 3049]
    monkeypatch.setattr(windows, "PIECE", 700)
    assert held() == whole


def test_words_are_laid_side_by_side(monkeypatch):
    texts = [b"  one\ttwo\n", b"", b" \x0b", b"three", b"four  five\r"]
    laid = windows.lay(texts, True)
    assert laid.first.tolist() == [0, 2, 2, 2, 3, 5]
    assert [laid.raw[a:b] for a, b in zip(laid.starts, laid.ends, strict=True)] == b" ".join(texts).split()
    whole = windows.unit_hashes(laid, 0, 5)
    monkeypatch.setattr(windows, "HASHED", 6)
    windows._cache.clear()
    assert (windows.unit_hashes(laid, 1, 4) == whole[1:4]).all()
    windows._cache.clear()


def test_unpack_is_inverse():
    a = np.array([5, -3, 1 << 50], np.int64)
    b = np.array([1, 2, 3], np.uint32)
    got = windows.unpack(windows.pack(a=a, b=b), np.int64, np.uint32)
    assert got[0].tolist() == a.tolist() and got[1].tolist() == b.tolist()


def test_op2_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted([tuple(r) for r in queries.op2_suffix_dedup(spark, sf).collect()], key=str)
    assert got == brute(rows, lambda b: [b[i : i + 1] for i in range(len(b))], 50, b"".join)


PASSAGE_RNG = random.Random(9)


def _passage_docs(n=3):
    word = lambda: "".join(PASSAGE_RNG.choices("abcdefgh", k=5))
    passage = [word() for _ in range(300)]
    return [(d, " ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)])) for d in range(n)]


def test_paths_are_compacted(spark):
    """One long passage in three documents, over many anchors, becomes one path."""
    docs = spark.createDataFrame(_passage_docs(), "doc_id long, text string")
    n = windows.narrowed(docs, graph.FRAME)
    paths = graph.local_paths(n.sent, graph.FRAME).filter("path is not null").select("path", "head", "tail", "n", "least", "null").cache()
    assert paths.count() > 20 and paths.groupBy().sum("n").first()[0] == 288
    units = graph.compacted(paths).collect()
    assert len({u.unitig for u in units}) == 1 and len(units) == paths.count()
    sizes = {p.path: p.n for p in paths.collect()}
    at = 0
    for u in sorted(units, key=lambda u: u.offset):
        assert u.offset == at
        at += sizes[u.path]


def test_compacted_paths_decide(spark, monkeypatch):
    """What is removed is read off the compacted paths: with another least document there, other text goes."""
    docs = spark.createDataFrame(_passage_docs(), "doc_id long, text string")
    removed = lambda: {r.doc_id: r.n_removed for r in graph.remove_repeated_words(docs).collect()}
    assert removed() == {0: 0, 1: 300, 2: 300}
    true = graph.compacted
    monkeypatch.setattr(graph, "compacted", lambda paths: true(paths).withColumn("least", F.lit(1).cast("long")))
    assert removed() == {0: 0, 1: 0, 2: 300}


def test_rings_and_gaps(spark):
    cols = "path long, head long, tail long, n long, least long, null long"
    ring = spark.createDataFrame([(1, 10, 11, 2, 0, 0), (2, 11, 10, 3, 0, 0), (3, 20, 21, 4, 0, 0), (4, 21, 22, 5, 0, 0), (5, 22, 23, 1, 7, 0)], cols)
    units = graph.compacted(ring)
    assert sorted(map(tuple, units.select("path", "unitig", "offset").collect())) == [(3, 3, 0), (4, 3, 4)]
    a = lambda *x: np.array(x, np.int64)
    first, start, end = graph.path_runs(a(7, 7, 8, 8), a(0, 4, 5, 90), a(4, 5, 4, 5), a(3, 3, 3, 3), a(0, 4, 0, 4))
    assert sorted(zip(first.tolist(), start.tolist(), end.tolist(), strict=True)) == [(0, 0, 9), (2, 5, 9), (3, 90, 95)]


def test_unbranched_edges():
    edge = np.array([0, 1, 2, 3, 0, 1, 4, 5, 6, 5])
    follows = np.array([1, 1, 1, 0, 1, 1, 0, 1, 1], bool)
    first, before = graph.unbranched(edge, follows, np.zeros(7, np.int64), 7)
    # 1 goes on to 2 and to 4; 5 and 6 go round
    assert first.tolist() == [0, 0, 2, 2, 4, 5, 6] and before.tolist() == [0, 1, 0, 1, 0, 0, 0]


def test_long_repeats_need_deeper_names():
    rng = np.random.default_rng(2)
    own = [rng.choice(np.frombuffer(b"ab", np.uint8), 150).tobytes() for _ in range(3)]
    texts = [own[0] + own[1], own[2] + own[1], own[0][:120] + own[2]]
    counts = np.array([len(t) - 119 for t in texts])
    got = suffixes.suffix_classes(texts, counts, 120)
    windows_ = [t[i : i + 120] for t, n in zip(texts, counts.tolist(), strict=True) for i in range(n)]
    names = {}
    assert len(set(got.tolist())) == len(set(windows_))
    for w, g in zip(windows_, got.tolist(), strict=True):
        assert names.setdefault(w, g) == g
