"""Substring deduplication by difference-cover suffix sorting.

Windows are dealt by their anchors (windows.py). Each reducer sorts the suffixes of its texts with a
difference cover modulo 3: the sampled suffixes, at places 1 and 2 modulo 3, are sorted by triples of
symbols and named; triples of names are named again, three times as deep each time, until the names
tell all apart or reach over a window; the remaining suffixes are sorted by their first byte and the
name after it and merged in. Then the prefixes of neighbours are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import windows
from .common import materialize, release

WINDOW, GRAM = 50, 16
_SYMBOL = 6  # bytes of a symbol: a triple has 18, a triple of names 54


def _names(*keys: np.ndarray) -> np.ndarray:
    """Ranks, from 1, of rows by their keys, the first key counting most; equal rows have one rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def _symbols(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the two bytes, and the symbol, that start there."""
    two = (b[:-1] << np.uint64(8)) | b[1:]
    three = (two[:-1] << np.uint64(8)) | b[2:]
    return two, (three[:-3] << np.uint64(24)) | three[3:]


def reach(window: int) -> int:
    """The bytes by which names tell suffixes apart: a triple of symbols, times three until it covers a window."""
    depth = 3 * _SYMBOL
    while depth < window:
        depth *= 3
    return depth


def sampled_ranks(symbol: np.ndarray, deep: np.ndarray, depth: int, n: int) -> np.ndarray:
    """Ranks of the sampled places in deep by the depth bytes there. Depths above a triple of symbols
    recurse: the names of a third of the depth, at three places, are the symbols of the next naming."""
    rank = np.zeros(n, np.int64)
    if depth == 3 * _SYMBOL:
        rank[deep] = _names(symbol[deep], symbol[deep + _SYMBOL], symbol[deep + 2 * _SYMBOL])
        return rank
    third, need = depth // 3, np.zeros(n, bool)
    for k in range(3):
        need[deep + k * third] = True
    below = np.flatnonzero(need)
    name = sampled_ranks(symbol, below, third, n)
    if len(below) and name.max() == len(below):
        return name  # all are told apart already
    rank[deep] = _names(name[deep], name[deep + third], name[deep + 2 * third])
    return rank


def suffix_order(buf: np.ndarray, wanted: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The places in wanted, sorted by the bytes of buf that start there, as many as a window has at
    least. buf must have zeros for 2 * reach(window) bytes after the last of these."""
    depth = reach(window)
    n = len(buf) - 3 * _SYMBOL
    b = buf.astype(np.uint64)
    two, symbol = _symbols(b)
    need = np.zeros(n, bool)
    for shift in range(3):
        need[wanted + shift] = True
    deep = np.flatnonzero(need)
    rank = sampled_ranks(symbol, deep[deep % 3 != 0], depth, n)
    # merge the remaining suffixes
    one = lambda i: (b[i].astype(np.int64) << 40) | rank[i + 1]
    two_ = lambda i: (two[i].astype(np.int64) << 40) | rank[i + 2]
    sampled, rest = wanted[wanted % 3 != 0], wanted[wanted % 3 == 0]
    sampled = sampled[np.argsort(rank[sampled], kind="stable")]
    rest = rest[np.argsort(one(rest), kind="stable")]
    is_one = sampled % 3 == 1
    firsts, seconds = np.sort(one(sampled[is_one])), np.sort(two_(sampled[~is_one]))
    place_rest = np.arange(len(rest)) + np.searchsorted(firsts, one(rest)) + np.searchsorted(seconds, two_(rest))
    place = np.arange(len(sampled))
    place[is_one] += np.searchsorted(one(rest), one(sampled[is_one]), "right")
    place[~is_one] += np.searchsorted(np.sort(two_(rest)), two_(sampled[~is_one]), "right")
    return np.concatenate([sampled, rest])[np.argsort(np.concatenate([place, place_rest]), kind="stable")]


def suffix_classes(contexts: list[bytes], counts: np.ndarray, window: int) -> np.ndarray:
    """The equality class of each window: counts[i] of them start at the head of contexts[i]."""
    if window < _SYMBOL:
        raise ValueError(f"windows have {_SYMBOL} bytes at least")
    buf = np.frombuffer(b"".join(contexts) + bytes(3 * reach(window)), np.uint8)
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    first = np.cumsum(sizes) - sizes
    at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    order = suffix_order(buf, at, window)
    # compare adjacent prefixes
    _, symbol = _symbols(buf.astype(np.uint64))
    new = np.zeros(len(order), bool)
    for shift in [*range(0, window - _SYMBOL, _SYMBOL), window - _SYMBOL]:
        s = symbol[order + shift]
        new[1:] |= s[1:] != s[:-1]
    by_place = np.empty(len(buf), np.int64)
    by_place[order] = np.cumsum(new)
    return by_place[at]


FRAME = windows.Frame(WINDOW, GRAM, False, suffix_classes)
_TYPES = (np.int64, np.uint32, np.uint32, np.uint32, np.uint8)


def verdicts(sent: DataFrame, frame: windows.Frame) -> DataFrame:
    """(batch, blob): of the texts that a batch sent, the windows that some smaller document has."""

    def run(table):
        m, out = windows.Meeting(table, frame), []
        bucket = table["bucket"][0].as_py()
        text, first, count = m.stretches(np.concatenate([[True], m.least[1:] != m.least[:-1]]))
        least = m.least[m.first[text] + first]
        head, size = windows.picked(text, len(m.texts))
        for batch, which, high in zip(m.batch, m.which, m.high, strict=True):
            own, nth = windows.ragged(size[which])
            s = head[which][own] + nth
            lost = least[s] < high[own]
            if lost.any():
                own, s = own[lost], s[lost]
                blob = windows.pack(id=m.ids[least[s]], which=own.astype(np.uint32), first=first[s].astype(np.uint32), count=count[s].astype(np.uint32), null=m.nulls[least[s]])
                out.append((batch, bucket.to_bytes(8, "little") + blob))
        return pa.table({"batch": pa.array([o[0] for o in out], pa.int64()), "blob": pa.array([o[1] for o in out], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "batch long, blob binary")


def lost_spans(batch: windows.Batch, hits: list[bytes], blobs: list[bytes], frame: windows.Frame, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the maximal spans that the batch's documents lose, sorted."""
    found, got = windows.find(batch, hits, frame, buckets), []
    for blob in blobs:
        b = int.from_bytes(blob[:8], "little")
        ids, which, first, count, nulls = windows.unpack(blob[8:], *_TYPES)
        head, size = windows.picked(which, len(found.texts[b][0]))
        own, nth = windows.ragged(size[found.which[b]])
        s = head[found.which[b]][own] + nth
        doc, start = found.doc[b][own], found.start[b][own] + first[s]
        lost = windows.later(batch.ids[doc], batch.nulls[doc], ids[s], nulls[s])
        got.append((doc[lost], start[lost], (start + count[s] + frame.window - 1)[lost]))
    doc, start, end = (np.concatenate([g[i] for g in got]) for i in range(3))
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # a text ends where the next one starts: moved apart by a byte each, spans of two texts don't touch
    start, end = windows.spans(start + doc, end + doc)
    doc = np.searchsorted(found.laid.first[1:] + np.arange(len(batch.ids)), start, "right")
    return doc, start - doc - found.laid.first[doc], end - doc - found.laid.first[doc]


def remove_repeated_bytes(docs: DataFrame, frame: windows.Frame = FRAME) -> DataFrame:
    """Texts without the bytes of windows that also start in a document with a smaller doc_id.

    docs has doc_id and text, read as UTF-8 bytes. One row per document: doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs), kept (the remaining bytes). Windows are judged on the input and
    don't cross documents; null text is empty; texts shorter than a window lose nothing. doc_ids are any
    64-bit numbers; null ones come after all others and are one id; rows that repeat a doc_id are no
    smaller than each other and are judged one by one. Other columns are ignored.
    """
    n = windows.narrowed(docs, frame)
    found = materialize(verdicts(n.sent, frame), "window-verdicts")
    release(docs.sparkSession)
    buckets = n.buckets
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hits, blobs in windows.opened(arrow):
            none = np.zeros(0, np.int64)
            doc, start, end = lost_spans(batch, hits, blobs, frame, buckets) if blobs else (none, none, none)
            head, size = windows.picked(doc, len(batch.ids))
            kept = []
            for text, h, k in zip(batch.texts, head.tolist(), size.tolist(), strict=True):
                s, e = start[h : h + k].tolist(), end[h : h + k].tolist()
                kept.append(b"".join(text[x:y] for x, y in zip([0, *e], [*s, len(text)], strict=True)) if k else text)
            sizes = np.fromiter(map(len, batch.texts), np.int64, len(kept))
            left = np.fromiter(map(len, kept), np.int64, len(kept))
            ids = pa.array(batch.ids, mask=batch.nulls.astype(bool))
            yield from windows.slices(pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(sizes - left), pa.array(size), pa.array(kept, pa.binary())], names=names))

    return windows.judged(n, found).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

