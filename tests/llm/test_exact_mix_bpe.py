import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from orrery.llm import bpe, common, exact, mix, queries

DOCS = [(5, "a b"), (3, "ab"), (4, " a\tb "), (2, "a b"), (7, None), (6, ""), (8, " \n"), (9, "z" * 9), (9, "z" * 9), (1, "zz z" * 2), (None, "q"), (None, "q "), (11, "q")]


def keep(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    out = []
    for d, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[n])
        out.append((d, best[3], len(groups[n]), d == best[3] and -len(t or "") == best[0], hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in DOCS], "doc_id long, text string, group_size int, digest string").repartition(5)
    assert sorted(map(tuple, exact.dedup_exact(df, files_per_batch=1).collect()), key=str) == keep(DOCS)
    kept = exact.keep_first_copies(df)
    assert kept.columns == df.columns and sorted([r.doc_id for r in kept.collect()], key=str) == sorted({k for _, k, *_ in keep(DOCS)}, key=str)
    assert exact.dedup_exact(df.limit(0)).isEmpty()


def test_full_bytes_are_checked(spark):
    """With a digest that many texts share, the groups are those of the texts all the same."""
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    weak = exact.dedup_exact(df, digest=lambda n: F.length(n).cast("string"))
    assert sorted([tuple(r)[:4] for r in weak.collect()], key=str) == [r[:4] for r in keep(DOCS)]


def test_state_outlasts_a_call(spark, tmp_path):
    """Batches meet those of earlier calls; a batch run again counts once; texts are fetched by locator."""
    weak = lambda n: F.length(n).cast("string")
    for name, digest in (("sha", exact.sha256_digest), ("weak", weak)):
        home, rows = f"{tmp_path}/{name}", []
        for k, part in enumerate([DOCS[:4], [(21, "ba"), *DOCS[8:]], [(20, "a  b  "), (None, "qq"), *DOCS[4:8]]]):
            path = f"{tmp_path}/{name} docs-{k}"
            spark.createDataFrame(part, "doc_id long, text string").repartition(2).write.parquet(path)
            rows += part
            expected = keep(rows)
            for _ in range(2 if k == 1 else 1):
                got = exact.dedup_exact(spark.read.parquet(path), digest, home=home, batch=f"b {k}").collect()
                own = Counter((d, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()) for d, t in part)
                judged = {r for r in expected if (r[0], r[4]) in own}
                assert {tuple(r)[:4] for r in got} == {r[:4] for r in judged}
                assert Counter(r.doc_id for r in got) == Counter(d for d, _ in part)


def test_lasting_state_needs_files(spark, tmp_path):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    exact.dedup_exact(df, home=f"{tmp_path}/h", batch="0").collect()
    with pytest.raises(ValueError, match="files"):
        exact.dedup_exact(df, home=f"{tmp_path}/h", batch="1").collect()


def test_distinct_texts_under_one_id_stay(spark):
    """Null and repeated ids: each text is judged by itself, and a rejected copy isn't let back in."""
    rows = [(None, "x one"), (None, "x two"), (None, "x three"), (5, "y one"), (5, "y two"), (5, "z"), (2, "z "), (7, "w"), (7, "w"), (8, "v v"), (8, "vv "), (None, None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    for digest in (exact.sha256_digest, lambda n: F.length(n).cast("string")):
        got = [(r.doc_id, r.text) for r in exact.keep_first_copies(df, digest).collect()]
        fixed = [g for g in got if g[0] != 8]
        assert sorted(fixed, key=str) == sorted([(None, None), (None, "x one"), (None, "x two"), (None, "x three"), (5, "y one"), (5, "y two"), (2, "z "), (7, "w")], key=str)
        assert [g for g in got if g[0] == 8] in ([(8, "v v")], [(8, "vv ")])


def test_filter_lets_all_present_keys_through(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    keys = spark.range(0, 3000, 7).select(F.col("id").cast("string").alias("k"))
    got = {r.k for r in common.only_present(rows, F.col("k"), keys).collect()}
    assert {str(i) for i in range(0, 3000, 7)} <= got and len(got) < 600


def mixed(rows, weights=(5, 2, 1), share=1.5, epochs=2):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, size, strict=True):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(total.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > epochs * total[s]}
        if not full:
            target |= {s: w[s] * level for s in open_}
            break
        for s in full:
            target[s] = float(epochs * total[s])
            left -= target[s]
        open_ -= full
    return total, target


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 900]), rng.choice(["b", "b", "b", "a", "z", None, ""])) for i in range(300)]
    rows += [(None, "a b", "a"), (7, "x y", "b"), (7, "x y z", "b"), (400, None, "only-empty")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, size int")
    got = mix.mix(df).collect()
    total, target = mixed(rows)
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == total[r.source] and abs(r.target - target[r.source]) < 1e-6
    assert len(got) == len(rows) and all(taken[s] == int(target[s] + 1e-9) or abs(taken[s] - target[s]) <= 1 for s in total)
    assert sorted(map(str, got)) == sorted(map(str, mix.mix(df.repartition(7)).collect()))
    again = mix.repeat_by_mix(df.filter("doc_id < 300"))
    assert again.columns == df.columns and again.count() > 0
    assert mix.mix(df.limit(0)).isEmpty()


def test_repeats_follow_the_mix_row_by_row(spark):
    """Rows without an id, of one id, with columns of any name: each comes as often as it is taken."""
    import math
    from collections import Counter

    rows = [(None, f"w{i} " * (1 + i % 7), "a") for i in range(40)] + [(5, "x " * n, "b") for n in range(1, 9)]
    rows += [(7, "y y", "b")] * 3 + [(7, "y y", "a"), (8, None, "a"), (9, "z", None), (9, "z", None)]
    df = spark.createDataFrame([(*r, i, "k") for i, r in enumerate(rows)], "doc_id long, text string, source string, copies int, text_key string")
    taken = Counter()
    for r in mix.mix(df, keys=True).collect():
        taken[r.doc_id, bytes(r.text_key), r.source] += math.ceil(r.taken / r["size"]) if r.taken else 0
    got = mix.repeat_by_mix(df)
    assert got.columns == df.columns
    rows_ = got.collect()
    key = lambda r: (r.doc_id, hashlib.sha256((r.text or "").encode()).digest(), r.source)
    assert Counter(map(key, rows_)) == Counter({k: n for k, n in taken.items() if n})
    same = Counter(r.copies for r in rows_ if r.doc_id == 7 and r.source == "b")
    assert max(same.values(), default=0) - min((same[i] for i in range(48, 51)), default=0) <= 2


def test_mix_uses_no_python(spark):
    plan = queries.op5_source_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_librarys(spark):
    rng = random.Random(1)
    parts = ["a", "b", "é", " ", "  ", "\n", "\t", "1", "99", "!", "$$", " ", "　", "\x1c", "日", "\U0001f600", "'s", "'ll", "x" * 5, "<|endoftext|>"]
    texts = [None, "", " ", "a" * 70_000, " " * 70_000, "a b" * 40_000, "\n" * 33_000 + "x" * 40_000, " \n" * 30_000 + "!" * 40_000]
    texts += ["".join(rng.choices(parts, k=n)) for n in (1, 5, 50, 500, 40_000, 120_000)]
    rows = [*enumerate(texts), (12, texts[12]), (None, texts[11]), (3, texts[13])]
    enc = library()
    want = []
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, part string")
    assert sorted(map(tuple, bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()), key=str) == sorted(want, key=str)
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).isEmpty()


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    shared_dir = common.shared_dir

    def session(master, named=None):
        held = {} if named is None else {"spark.checkpoint.dir": named}
        conf = SimpleNamespace(get=lambda k, default=None: held.get(k, default), set=held.__setitem__)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            shared_dir(session(master))
        assert shared_dir(session(master, "hdfs://n/shared/")) == "hdfs://n/shared"
    assert shared_dir(session("local[4]")).startswith("file:")
