"""Near-duplicates by DartMinHash signatures and a banded join.

A text is the multiset of its shingles (five words). The region of a shingle that occurs c times is c
wide and reaches up from rank 0. Darts fall on the region as a Poisson process that depends on the
shingle alone, so texts that share a shingle share its darts. Each dart hits one of k coordinates; the
earliest dart of each coordinate is the signature, and two texts agree in a coordinate with the
probability of their weighted Jaccard similarity. Only about k ln k darts are thrown for a text,
whatever its length.

Texts with equal bands of their signatures meet in a bucket. Each is compared exactly with the first
text there, which holds most buckets together. Buckets that this leaves in several classes are not
paired out: their texts go through a prefix join (rare shingles first), which loses no pair of the
wanted similarity. Leaders drawn by hash merge what they can there, then pairs that are still in
different classes are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, only_kept, only_present, release, text_key
from .windows import Laid, lay, unit_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: 20 bands of 4 rows: a pair of similarity 0.8 is missed once in 37,000 times.
BANDS, ROWS = 20, 4
K = BANDS * ROWS
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ALL = (1 << 64) - 1
_CHUNK = 1 << 20
#: Slots of the table of shingle counts that orders shingles; its size is fixed, whatever the corpus.
SLOTS = 1 << 20
#: Rounds of drawn leaders before all other links; any number gives the same classes.
LEADERS = 2


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def elements(text: bytes) -> np.ndarray:
    """The text's shingles as sorted numbers, the c-th copy of a shingle as a number of its own, so
    that weighted sets compare as plain ones. Fewer than five words are one shingle; none have none."""
    return _elements(lay([text], True))


def _elements(laid: Laid) -> np.ndarray:
    if not len(laid.starts):
        return np.zeros(0, np.uint64)
    h = unit_hashes(laid, 0, len(laid.starts))
    n = min(SHINGLE, len(h))
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = _mix(out + h[j : j + m] + np.uint64(j + 1))
    out.sort()
    same = np.concatenate([[False], out[1:] == out[:-1]])
    if same.any():
        first = np.maximum.accumulate(np.where(same, 0, np.arange(m)))
        out = np.sort(_mix(out + (np.arange(m) - first).astype(np.uint64) * _ODD))
    return out


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Weighted Jaccard similarity of two texts by their elements; 0 if either has none. Where the
    numbers of elements alone rule `least` out, their ratio comes back, which is no less."""
    if not len(a) or not len(b):
        return 0.0
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1:
        return min(len(a), len(b)) / max(len(a), len(b))
    return similarity_exact(a, b)


def similarity_exact(a: np.ndarray, b: np.ndarray) -> float:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def signatures(element: np.ndarray, owner: np.ndarray, texts: int, k: int = K) -> np.ndarray:
    """(texts, k) ids of the earliest darts. owner: the text of each element; every text has some."""
    size = np.bincount(owner, minlength=texts)
    limit = (np.log(k) + 2) * k / np.maximum(size, 1)
    rank = np.full(texts * k, np.inf)
    dart = np.zeros(texts * k, np.uint64)
    e, t, o, nth = element, np.zeros(len(element)), owner, 0
    late: list[tuple] = []  # elements whose next dart is beyond the limit of their text
    open_ = np.ones(texts, bool)
    while True:
        while len(e):
            nth += 1
            u = _mix(e + np.uint64(nth * int(_ODD) & _ALL))
            t = t - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53))
            inside = t <= limit[o]
            late.append((e[~inside], t[~inside], o[~inside], np.full((~inside).sum(), nth), u[~inside]))
            e, t, o, u = e[inside], t[inside], o[inside], u[inside]
            _throw(rank, dart, o, t, u, k)
        open_ = np.isinf(rank.reshape(texts, k)).any(1)
        if not open_.any():
            return dart.reshape(texts, k)
        # a coordinate was not hit: go on with these texts, twice as far
        limit[open_] *= 2
        e, t, o, n, u = (np.concatenate([x[i] for x in late]) for i in range(5))
        late = []
        for step in np.unique(n):
            i = (n == step) & open_[o]
            _further(rank, dart, e[i], t[i], o[i], u[i], int(step), limit, k, late)
        e, t, o = e[:0], t[:0], o[:0]


def _further(rank, dart, e, t, o, u, nth, limit, k, late) -> None:
    while len(e):
        inside = t <= limit[o]
        late.append((e[~inside], t[~inside], o[~inside], np.full((~inside).sum(), nth), u[~inside]))
        e, t, o, u = e[inside], t[inside], o[inside], u[inside]
        _throw(rank, dart, o, t, u, k)
        nth += 1
        u = _mix(e + np.uint64(nth * int(_ODD) & _ALL))
        t = t - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53))


def _throw(rank, dart, o, t, u, k) -> None:
    if not len(o):
        return
    ids = _mix(u ^ _ODD)
    cell = o * k + ((ids >> np.uint64(20)) % np.uint64(k)).astype(np.int64)
    order = np.lexsort((t, cell))
    c = cell[order]
    first = order[np.concatenate([[True], c[1:] != c[:-1]])]
    first = first[t[first] < rank[cell[first]]]
    rank[cell[first]], dart[cell[first]] = t[first], ids[first]


def banded(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, text_key, bands): the digests of the words and of the text as it is, and a number
    for each band; no bands without words."""
    names = ["doc_id", "digest", "text_key", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            held: list[tuple] = []
            size = 0
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                for doc, text in zip(b["doc_id"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), strict=True):
                    laid = lay([text], True)
                    held.append((doc, hashlib.md5(laid.raw).digest(), hashlib.sha256(text).digest(), _elements(laid)))
                    size += len(held[-1][3])
                    if size >= _CHUNK // 4:
                        yield close(held)
                        held, size = [], 0
            if held:
                yield close(held)

    def close(held: list[tuple]) -> pa.RecordBatch:
        full = [i for i, h in enumerate(held) if len(h[3])]
        bands: list = [[] for _ in held]
        if full:
            sizes = [len(held[i][3]) for i in full]
            owner = np.repeat(np.arange(len(full)), sizes)
            sig = signatures(np.concatenate([held[i][3] for i in full]), owner, len(full)).reshape(len(full), BANDS, ROWS)
            key = np.arange(BANDS, dtype=np.uint64) * np.ones((len(full), 1), np.uint64)
            for j in range(ROWS):
                key = _mix(key * _ODD + sig[:, :, j])
            for i, own in zip(full, key.view(np.int64), strict=True):
                bands[i] = own.tolist()
        kinds = (pa.int64(), pa.binary(), pa.binary())
        cols = [pa.array([h[i] for h in held], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(bands, pa.list_(pa.int64()))], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest binary, text_key binary, bands array<long>")


def fetched(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(row, text) for keys (row, key): the texts by their text_key. Copies of a text are reduced to one
    in the task that reads them, and a filter of fixed size leaves out most others before any shuffle."""
    rows = docs.select(text_key(F.col("text")).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    once = only_present(rows, F.col("key"), keys.select("key")).dropDuplicates(["key"])
    return once.join(keys, "key").select("row", "text")


def alike(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts have the similarity or more. texts: (row, text)."""
    second = texts.join(pairs, F.col("row") == F.col("b")).select("a", "b", F.col("text").alias("text_b"))
    first = texts.join(second, F.col("row") == F.col("a")).select("a", "b", F.col("text").alias("text_a"), "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                keep = []
                for a, text_a, text_b in zip(b["a"].to_pylist(), b["text_a"].cast(pa.binary()), b["text_b"].cast(pa.binary()), strict=True):
                    if a != at:
                        at, own = a, elements(text_a.as_py())
                    keep.append(similarity(own, elements(text_b.as_py()), least) >= least)
                yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(keep))

    return first.mapInArrow(run, "a long, b long")


def salted(keys: DataFrame) -> DataFrame:
    """Each key once for each of the ways that its rows are dealt."""
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))


def opened(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """rows (row, key and others) with their label, of those keys that hold more than one class. Rows
    with a salt are dealt by key and salt."""
    now = rows.join(labels, "row", "left").withColumn("label", F.coalesce("label", "row"))
    dealt = [key, "ways"] if "ways" in rows.columns else [key]
    split = now.groupBy(*dealt).agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo < _hi").select(*dealt)
    if "ways" in rows.columns:
        return now.join(salted(split).drop("ways"), [key, "salt"], "left_semi").select(*rows.columns, "label")
    return now.join(split, key, "left_semi").select(*rows.columns, "label")


def slot_counts(texts: DataFrame) -> np.ndarray:
    """How often each slot of the shingles' numbers occurs; SLOTS numbers for any corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            for t in b["text"].cast(pa.binary()):
                np.add.at(total, _slot(elements(t.as_py())), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["slot", "n"])

    got = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return np.minimum(out, np.iinfo(np.uint32).max).astype(np.uint32)


def _slot(e: np.ndarray) -> np.ndarray:
    return (e >> np.uint64(44)).astype(np.int64) % SLOTS


#: Rows of a shingle that are dealt together, about; more frequent shingles are dealt in several ways.
TOGETHER = 512


def prefixes(texts: DataFrame, least: float) -> DataFrame:
    """(element, row, size, after, ways, salt): each text's rarest shingles, as many as a text of the
    wanted similarity can't all lack; after is the number of shingles that come later in the order. ways
    is a number of the shingle's own, more than one if it is much more frequent than most; salt is the
    way of the row."""
    counts = slot_counts(texts)
    ways = 1 + np.maximum(counts.astype(np.int64) - 2 * int(counts.mean()), 0) // TOGETHER
    held = texts.sparkSession.sparkContext.broadcast((counts, ways))
    names = ["element", "row", "size", "after", "ways", "salt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, ways = held.value
        for b in batches:
            for row, text in zip(b["row"].to_pylist(), b["text"].cast(pa.binary()), strict=True):
                e = elements(text.as_py())
                n = len(e)
                e = e[np.lexsort((e, freq[_slot(e)]))][: n - int(np.ceil(least * n - 1e-6)) + 1]
                w = ways[_slot(e)]
                salt = int(_mix(np.array([row], np.uint64))[0] >> np.uint64(33)) % w
                cols = (e.view(np.int64), np.full(len(e), row, np.int64), np.full(len(e), n, np.int64), n - 1 - np.arange(len(e)))
                small = [pa.array(x.astype(np.int32)) for x in (w, salt)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *small], names=names)

    return texts.select("row", "text").mapInArrow(run, "element long, row long, size long, after long, ways int, salt int")


def _enough(least: float, after: str = "after", size: str = "size") -> Column:
    """Whether two texts, a and b, that have their first common shingle here can have the similarity."""
    return (F.least(f"{after}_a", f"{after}_b") + 1) * (1 + least) >= least * (F.col(f"{size}_a") + F.col(f"{size}_b")) - 1e-6


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")).distinct()


def led(entries: DataFrame, nth: int, least: float) -> DataFrame:
    """(a, b): each row with its shingle's leader, where that is of another class. Classes are drawn by
    hash, and the first row of the one drawn leads; a large class is drawn no more often than a small
    one. Rows that have the shingle too late in their order to meet rows of their size come last."""
    own = ("row", "label", "size", "after")
    late = (F.col("after") < F.col("size") * (2 * least / (1 + least)) - 1).alias("late")
    draw = F.xxhash64("label", "element", F.lit(nth)).alias("draw")
    leader = salted(entries.groupBy("element", "ways").agg(F.min(F.struct(late, draw, *own)).alias("b")))
    leader = leader.select("element", "salt", *(F.col(f"b.{c}").alias(f"{c}_b") for c in own))
    rest = entries.select("element", "salt", *(F.col(c).alias(f"{c}_a") for c in own))
    return _pairs(rest.join(leader, ["element", "salt"]).filter((F.col("label_a") != F.col("label_b")) & _enough(least)))


def crossed(entries: DataFrame, least: float) -> DataFrame:
    """(a, b): all pairs of rows of different classes that meet at a shingle and can have the
    similarity. Classes are paired before rows, so a class that holds a third of all rows is never
    joined with itself."""
    bounds = ("label", "small", "large", "after", "ways")
    grouped = entries.groupBy("element", "label", "ways")
    classes = materialize(grouped.agg(F.min("size").alias("small"), F.max("size").alias("large"), F.max("after").alias("after")), "near-meet")
    side = lambda t, x, *c: t.select("element", *(F.col(n).alias(f"{n}_{x}") for n in c))
    near_size = (F.col("large_a") >= least * F.col("small_b")) & (F.col("large_b") >= least * F.col("small_a")) & _enough(least, size="small")
    meet = side(classes, "a", *bounds).join(side(classes, "b", *bounds), "element").filter((F.col("label_a") < F.col("label_b")) & near_size)
    # a row is only taken on where it can be like some row of the other class
    other = salted(meet.select("element", "label_a", "label_b", F.col("ways_a").alias("ways"), F.col("small_b").alias("size_b"), "large_b", "after_b"))
    fits = (F.col("size_a") >= least * F.col("size_b")) & (F.col("large_b") >= least * F.col("size_a")) & _enough(least)
    rows = side(entries, "a", "label", "row", "size", "after", "salt").withColumnRenamed("salt_a", "salt")
    one = other.join(rows, ["element", "label_a", "salt"]).filter(fits).select("element", "label_a", "label_b", "row_a", "size_a", "after_a")
    return _pairs(one.join(side(entries, "b", "label", "row", "size", "after"), ["element", "label_b"]).filter(_enough(least)))


def components(edges: DataFrame) -> DataFrame:
    """(row, label): the least row of the connected component of each row in an edge. Each round hooks
    every row to its least neighbour, jumps once and contracts the edges, until none is left."""
    spark = edges.sparkSession
    labels = None
    while True:
        edges = materialize(edges, "near-edges")
        if edges.isEmpty():
            return labels if labels is not None else spark.createDataFrame([], "row long, label long")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("hook")).withColumnRenamed("a", "row"), "near-hooks")
        jump = hook.select(F.col("row").alias("hook"), F.col("hook").alias("label"))
        here = materialize(hook.join(jump, "hook").select("row", "label"), "near-labels")
        as_ = lambda x: here.select(F.col("row").alias(x), F.col("label").alias("_" + x))
        edges = edges.join(as_("a"), "a").join(as_("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).filter("a < b").distinct()
        if labels is None:
            labels = here
        else:
            old = labels.join(here.select(F.col("row").alias("label"), F.col("label").alias("to")), "label", "left").select("row", F.coalesce("to", "label").alias("label"))
            labels = materialize(old, "near-labels")


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels after more edges: only classes that these link are looked at again."""
    as_ = lambda x: labels.select(F.col("row").alias(x), F.col("label").alias("_" + x))
    own = lambda x: F.coalesce("_" + x, x)
    between = edges.join(as_("a"), "a", "left").join(as_("b"), "b", "left").select(F.least(own("a"), own("b")).alias("a"), F.greatest(own("a"), own("b")).alias("b"))
    over = components(between.filter("a < b").distinct())
    moved = labels.join(over.select(F.col("row").alias("label"), F.col("label").alias("to")), "label", "left").select("row", F.coalesce("to", "label").alias("label"))
    return materialize(moved.unionByName(over.join(labels, "row", "left_anti").select("row", "label")), "near-labels")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Classes of documents that are linked by similarities of `least` or more.

    docs has doc_id and text. One row per document: doc_id, class_id (the smallest doc_id of its
    class), class_size (rows), kept (the row of the smallest doc_id; of several texts of this id the one
    of least SHA-256). Texts of the same words are one class at once; of these only one goes on. Texts
    without words, null among them, are one class. Texts of fewer than five words are one shingle. doc_ids are any 64-bit numbers; null ones come last and may
    be a class_id only of classes that have no other; rows that repeat a doc_id are compared one by one,
    and one of them is kept. Other columns are ignored.

    In a class not all texts need be similar to each other. Links inside a class that is already held
    together aren't sought; between classes that meet in a bucket, all are.
    """
    return judged(docs, least).drop("text_key")


def judged(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """near_duplicates() and the text_key of each row."""
    spark = docs.sparkSession
    # rows are told apart, and texts numbered once their copies are together, by numbers in written tables
    signed = materialize(banded(docs).select("*", F.monotonically_increasing_id().alias("tie")), "near-bands")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "tie")
    grouped = signed.groupBy("digest").agg(F.count("*").alias("n"), F.min(best).alias("best"), F.first("bands").alias("bands"))
    # in the order of their doc_ids, so that what comes first in a bucket is the first document, which
    # copies were made of more often than of each other
    ordered = materialize(grouped, "near-grouped").orderBy("best.none", "best.doc_id", "digest")
    copies = materialize(ordered.select(F.monotonically_increasing_id().alias("row"), "*"), "near-copies")
    deals = materialize(copies.select("row", F.explode("bands").alias("band")), "near-deals")
    ends = deals.groupBy("band").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).filter("lo < hi")
    shared = materialize(deals.join(ends, "band").select("row", "band", "lo"), "near-shared")
    discard(deals)
    release(spark)
    met = shared.select("row").distinct()
    texts = materialize(fetched(docs, copies.join(met, "row").select("row", F.col("best.text_key").alias("key"))), "near-texts")

    pairs = materialize(shared.filter("lo < row").select(F.col("lo").alias("a"), F.col("row").alias("b")).distinct(), "near-pairs")
    labels = components(alike(pairs, texts, least))
    release(spark)
    # what the first text of a bucket doesn't hold together meets again at its rare shingles: leaders
    # merge the large classes, at one pair a shingle and row, then all links left are sought
    split = opened(shared.select("row", "band"), labels, "band").select("row").distinct()
    entries = materialize(prefixes(texts.join(split, "row", "left_semi"), least), "near-prefixes")
    discard(shared)
    for nth in range(LEADERS + 1):
        now = materialize(opened(entries.drop("label"), labels, "element"), "near-prefixes")
        discard(entries)
        entries = now
        if entries.isEmpty():
            break
        more = materialize(led(entries, nth, least) if nth < LEADERS else crossed(entries, least), "near-pairs")
        labels = merged(labels, materialize(alike(more, texts, least), "near-links"))
        release(spark)
    discard(entries)
    discard(texts)

    of = copies.join(labels, "row", "left").select("digest", "n", "best", F.coalesce("label", "row").alias("label"))
    sizes = of.groupBy("label").agg(F.sum("n").alias("class_size"), F.min("best").alias("first"))
    classes = materialize(of.join(sizes, "label").select("digest", F.col("first.doc_id").alias("class_id"), "class_size", F.col("first.tie").alias("first_tie")), "near-classes")
    kept = (F.col("tie") == F.col("first_tie")).alias("kept")
    return signed.drop("bands").join(classes, "digest").select("doc_id", "class_id", "class_size", kept, "text_key")


def keep_one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The first document of each class, with all columns, whatever other texts its doc_id has; a row
    that repeats its id and text stays once."""
    return only_kept(docs, judged(docs, least).filter("kept"))
