"""Substring deduplication on a De Bruijn graph of words.

Nodes are 12 words in a row, edges are 13. Edges are dealt by their anchors (windows.py), as
minimiser-partitioned assemblers do. Within a partition, words and then grams get exact names, so an
edge is a pair of node names; edges that follow each other without a branch and have the same least
document make a local path. Paths are then compacted across partitions by joins: where one path alone
ends in a node and one alone starts there, and both have the same least document, they are linked, and
links are followed by pointer doubling. The least document of a compacted path is its first part's, and
that decides: where a later document runs along the path, the run is removed. Runs are put together by
their coordinates in the document: two parts are one run only if no edge between them is missing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows
from .common import discard, materialize, release

WINDOW, GRAM = 13, 4


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    return np.unique((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), return_inverse=True)[1]


def gram_names(words: np.ndarray, length: int) -> np.ndarray:
    """The name of the gram of that many words at each place where one fits."""
    out, have, power, size = None, 0, words, 1
    while size <= length:
        if length & size:
            if out is None:
                out = power
            else:
                m = len(words) - have - size + 1
                out = _pair(out[:m], power[have : have + m])
            have += size
        size *= 2
        if size <= length:
            m = len(power) - size // 2
            power = _pair(power[:m], power[size // 2 :])
    return out


def edge_classes(contexts: list[bytes], counts: np.ndarray, window: int) -> np.ndarray:
    """The edge of each window: counts[i] of them start at the first words of contexts[i]."""
    known: dict[bytes, int] = {}
    sizes, words = [], []
    for c in contexts:
        own = c.split(b" ")
        sizes.append(len(own))
        words += [known.setdefault(w, len(known)) for w in own]
    words = np.array(words, np.int64)
    nodes = gram_names(words, window - 1)
    edges = _pair(nodes[:-1], nodes[1:])  # two nodes that overlap but for one word each
    sizes = np.array(sizes, np.int64)
    first = np.cumsum(sizes) - sizes
    at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return edges[at]


FRAME = windows.Frame(WINDOW, GRAM, True, edge_classes)

#: Two kinds of rows, written by one task and so of one mind. With path: a local path; head and tail are
#: the hashes of its end nodes, n its edges, least and null its least document. With batch: blob says
#: which edges of the texts that the batch sent are which edges of which paths.
LOCAL = "bucket long, batch long, blob binary, path long, head long, tail long, n long, least long, null long"
_TYPES = (np.int64, np.int64, np.uint32, np.uint32, np.uint32)


def _hash(words: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


def unbranched(edge: np.ndarray, follows: np.ndarray, same: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n edges the first edge of its path, and how many edges come before it there. edge: a
    sequence of edges; follows[i]: whether edge[i + 1] comes after edge[i] in a text; same: a number for
    each edge, equal within a path. Edges that go round in a ring are paths of their own."""
    a, b = edge[:-1][follows], edge[1:][follows]
    pairs = np.unique(a * n + b)
    a, b = pairs // n, pairs % n
    one = (np.bincount(a, minlength=n)[a] == 1) & (np.bincount(b, minlength=n)[b] == 1) & (same[a] == same[b]) & (a != b)
    to, steps = np.arange(n), np.zeros(n, np.int64)
    to[b[one]], steps[b[one]] = a[one], 1
    for _ in range(max(n, 2).bit_length()):
        if not steps[to].any():
            return to, steps
        to, steps = to[to], steps + steps[to]
    ring = steps[to] > 0
    to[ring], steps[ring] = np.flatnonzero(ring), 0
    return to, steps


def local_paths(sent: DataFrame, frame: windows.Frame) -> DataFrame:
    def run(table):
        m = windows.Meeting(table, frame)
        bucket, node = table["bucket"][0].as_py(), frame.window - 1
        _, edge = np.unique(m.classes, return_inverse=True)
        n = int(edge.max()) + 1
        least, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
        least[edge], most[edge] = m.least, m.most
        text, _ = windows.ragged(m.count)
        # only edges that some document has after another one are kept
        twice = (least < most)[edge]
        follows = twice[:-1] & twice[1:] & (text[:-1] == text[1:])
        first, before = unbranched(edge, follows, least, n)
        # the paths
        size = np.bincount(first, minlength=n)
        heads = np.unique(first[edge[twice]])
        where = np.zeros(n, np.int64)
        where[edge] = np.arange(len(edge))  # any window that shows the edge
        tails = np.zeros(n, np.int64)
        last = np.flatnonzero(before == size[first] - 1)
        tails[first[last]] = last
        words = {}

        def own(e: int) -> list[bytes]:
            w = where[e]
            t = text[w]
            if t not in words:
                words[t] = m.texts[t].split(b" ")
            return words[t][w - m.first[t] : w - m.first[t] + node + 1]

        number = np.full(n, -1)
        number[heads] = np.arange(len(heads)) | (bucket << 32)
        head = np.fromiter((_hash(own(e)[:-1]) for e in heads.tolist()), np.int64, len(heads))
        tail = np.fromiter((_hash(own(e)[1:]) for e in tails[heads].tolist()), np.int64, len(heads))
        # the texts along the paths
        on = first[edge]
        new = np.concatenate([[True], (on[1:] != on[:-1]) | (before[edge][1:] != before[edge][:-1] + 1)])
        text, start, count = m.stretches(new)
        at = m.first[text] + start
        kept = twice[at]
        text, start, count, at = text[kept], start[kept], count[kept], at[kept]
        begin, pieces = windows.picked(text, len(m.texts))
        out = []
        for batch, which in zip(m.batch, m.which, strict=True):
            sent_, nth = windows.ragged(pieces[which])
            s = begin[which][sent_] + nth
            if len(s):
                e = edge[at[s]]
                out.append((batch, windows.pack(path=number[first[e]], before=before[e], which=sent_.astype(np.uint32), first=start[s].astype(np.uint32), count=count[s].astype(np.uint32))))
        k, p = len(out), len(heads)
        cols = {
            "bucket": pa.array(np.full(k + p, bucket)),
            "batch": pa.array([o[0] for o in out] + [None] * p, pa.int64()),
            "blob": pa.array([o[1] for o in out] + [None] * p, pa.binary()),
        }
        rest = {"path": number[heads], "head": head, "tail": tail, "n": size[heads], "least": m.ids[least[heads]], "null": m.nulls[least[heads]].astype(np.int64)}
        return pa.table(cols | {c: pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(v, pa.int64())]) for c, v in rest.items()})

    return sent.groupBy("bucket").applyInArrow(run, LOCAL)


def compacted(paths: DataFrame) -> DataFrame:
    """(path, unitig, offset, least, null): the path that each path was compacted into, by that one's
    first part, the edges before it there, and the least document of the whole. paths: path, head, tail,
    n, least, null; one that is linked to none is a whole of its own and left out.

    Pointers are doubled; rows that have arrived at a first part are only looked up from then on."""
    alone = lambda end, *more: paths.groupBy(F.col(end).alias("node")).agg(F.count("*").alias("k_"), *(F.min(c).alias(a) for c, a in more)).filter("k_ = 1").drop("k_")
    before = alone("tail", ("path", "to"), ("n", "offset"), ("least", "least"), ("null", "null"))
    after = alone("head", ("path", "path"), ("least", "least_"), ("null", "null_"))
    same = (F.col("least") == F.col("least_")) & (F.col("null") == F.col("null_")) & (F.col("path") != F.col("to"))
    links = materialize(before.join(after, "node").filter(same).select("path", "to", "offset"), "graph-links")
    arrived, moving, count = None, links, None
    while True:
        known = moving if arrived is None else moving.unionByName(arrived)
        ahead = known.select(F.col("path").alias("to"), F.col("to").alias("to_"), F.col("offset").alias("more_"))
        step = moving.join(ahead, "to", "left").select("path", F.coalesce("to_", "to").alias("to"), (F.col("offset") + F.coalesce("more_", F.lit(0))).alias("offset"), F.col("to_").isNull().alias("there"))
        step = materialize(step, "graph-links")
        there, moving = step.filter("there").drop("there"), step.filter("not there").drop("there")
        arrived = there if arrived is None else arrived.unionByName(there)
        left = moving.count()
        # of a chain fewer parts are on the way after each round; when none has arrived, all go round in rings
        if left in (0, count):
            break
        count = left
    roots = paths.select(F.col("path").alias("unitig"), "least", "null")
    ends = arrived.select("path", F.col("to").alias("unitig"), "offset")
    firsts = ends.select("unitig").distinct().select(F.col("unitig").alias("path"), "unitig", F.lit(0).cast("long").alias("offset"))
    return ends.unionByName(firsts).join(roots, "unitig").select("path", "unitig", "offset", "least", "null")


PLACED = (np.int64, np.int64, np.int64, np.uint32, np.uint32, np.uint32, np.uint8)


def placed(local: DataFrame, units: DataFrame) -> DataFrame:
    """(batch, blob): the stretches of the texts that a batch sent, with the compacted path that each is
    on, the place of its text's first window on that path's scale, and the path's least document."""
    left = local.filter("batch is not null").select("bucket", "batch", "blob")
    own = local.filter("path is not null").select("bucket", "path", "least", "null")
    joined = units.select("path", "unitig", "offset", F.col("least").alias("least_"), F.col("null").alias("null_"))
    right = own.join(joined, "path", "left").select(F.col("bucket").alias("owner"), "path", F.coalesce("unitig", "path").alias("unitig"), F.coalesce("offset", F.lit(0).cast("long")).alias("offset"), F.coalesce("least_", "least").alias("least"), F.coalesce("null_", "null").alias("null"))

    def run(blobs, paths):
        low = 0xFFFFFFFF
        n = paths.num_rows
        at = paths["path"].to_numpy() & low
        unitig, offset, least, null = (np.zeros(n, np.int64) for _ in range(4))
        for out, name in ((unitig, "unitig"), (offset, "offset"), (least, "least"), (null, "null")):
            out[at] = paths[name].to_numpy()
        found = []
        for batch, blob in zip(blobs["batch"].to_pylist(), blobs["blob"].to_pylist(), strict=True):
            path, before, which, first, count = windows.unpack(blob, *_TYPES)
            p = path & low
            found.append((batch, blobs["bucket"][0].as_py().to_bytes(8, "little") + windows.pack(unitig=unitig[p], offset=offset[p] + before, least=least[p], which=which, first=first, count=count, null=null[p].astype(np.uint8))))
        return pa.table({"batch": pa.array([f[0] for f in found], pa.int64()), "blob": pa.array([f[1] for f in found], pa.binary())})

    return left.groupBy("bucket").cogroup(right.groupBy("owner")).applyInArrow(run, "batch long, blob binary")


def path_runs(doc: np.ndarray, start: np.ndarray, count: np.ndarray, unitig: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, start, end) of the runs of documents along compacted paths, in edges: stretches at one
    diagonal of document and path, each beginning where the one before ends. first: one stretch of each."""
    order = np.lexsort((start, start - offset, unitig, doc))
    d, s, e, u, g = doc[order], start[order], (start + count)[order], unitig[order], (start - offset)[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (u[1:] != u[:-1]) | (g[1:] != g[:-1]) | (s[1:] != e[:-1])])
    at = np.flatnonzero(new)
    return order[at], s[at], e[np.append(at[1:], len(e)) - 1]


def lost_spans(batch: windows.Batch, hits: list[bytes], blobs: list[bytes], frame: windows.Frame, buckets: int) -> tuple[windows.Laid, np.ndarray, np.ndarray, np.ndarray]:
    """The batch's texts, and (document, start, end), in words of the batch, of the spans they lose."""
    found, got = windows.find(batch, hits, frame, buckets), []
    for blob in blobs:
        b = int.from_bytes(blob[:8], "little")
        unitig, offset, least, which, first, count, null = windows.unpack(blob[8:], *PLACED)
        head, size = windows.picked(which, len(found.texts[b][0]))
        own, nth = windows.ragged(size[found.which[b]])
        s = head[found.which[b]][own] + nth
        got.append((found.doc[b][own], found.start[b][own] + first[s], count[s].astype(np.int64), unitig[s], offset[s], least[s], null[s]))
    doc, start, count, unitig, offset, least, null = (np.concatenate([g[i] for g in got]) for i in range(7))
    first, start, end = path_runs(doc, start, count, unitig, offset)
    doc = doc[first]
    lost = windows.later(batch.ids[doc], batch.nulls[doc], least[first], null[first])
    doc, start, end = doc[lost], start[lost], end[lost] + frame.window - 1
    order = np.lexsort((start, doc))
    return found.laid, doc[order], start[order], end[order]


def remove_repeated_words(docs: DataFrame, frame: windows.Frame = FRAME) -> DataFrame:
    """Texts without the words of windows that also start in a document with a smaller doc_id.

    docs has doc_id and text. One row per document: doc_id, n_words, n_removed, kept (the remaining
    words joined by one space). Windows are judged on the input and don't cross documents; null text
    has no words; texts of fewer words than a window lose none. doc_ids are any 64-bit numbers; null ones
    come after all others and are one id; rows that repeat a doc_id are no smaller than each other and
    are judged one by one. Other columns are ignored.
    """
    n = windows.narrowed(docs, frame)
    local = materialize(local_paths(n.sent, frame), "graph-local")
    release(docs.sparkSession)
    units = materialize(compacted(local.filter("path is not null").select("path", "head", "tail", "n", "least", "null")), "graph-units")
    release(docs.sparkSession)
    found = materialize(placed(local, units), "graph-placed")
    discard(local)
    release(docs.sparkSession)
    buckets = n.buckets

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hits, blobs in windows.opened(arrow):
            if blobs:
                laid, doc, start, end = lost_spans(batch, hits, blobs, frame, buckets)
            else:
                laid, doc = windows.lay(batch.texts, True), np.zeros(0, np.int64)
            head, size = windows.picked(doc, len(batch.ids))
            out = []
            for i, (h, k) in enumerate(zip(head.tolist(), size.tolist(), strict=True)):
                a, z = int(laid.first[i]), int(laid.first[i + 1])
                cut = [(a, z)]
                if k:
                    s, e = windows.spans(start[h : h + k], end[h : h + k])
                    cut = zip([a, *e.tolist()], [*s.tolist(), z], strict=True)
                cut = [(x, y) for x, y in cut if x < y]
                kept = b" ".join(laid.raw[laid.starts[x] : laid.ends[y - 1]] for x, y in cut)
                out.append((z - a, z - a - sum(y - x for x, y in cut), kept))
            ids = pa.array(batch.ids, mask=batch.nulls.astype(bool))
            cols = [ids, pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())]
            yield from windows.slices(pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept"]))

    return windows.judged(n, found).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")
