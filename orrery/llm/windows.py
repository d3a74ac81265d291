"""Repeated windows of a corpus, the frame shared by the two substring deduplicators.

A window is W consecutive units (bytes or words) of one document. Each window has an anchor: among the
k-grams in it the one with the least hash, leftmost first. Equal windows have equal anchors, so all
occurrences of a window meet at the reducer of its anchor, and neighbouring windows with one anchor
travel as one run.

    1. batches()   texts are written side by side in batches of a few MB; a batch has a number, and a
                   document is a place in its batch, so any doc_ids do: null, repeated, of any size
    2. anchors()   each anchor of a batch once, dealt by its hash: which anchors have two documents
    3. contexts()  the texts of the runs at these anchors, each once a batch, dealt by anchor again
    4. Meeting     what a reducer knows: each window's class, by the classes function given, and the
                   least document that has it
    5. places      the verdicts go back to the batches, which find the places of their runs again

Nothing travels once for each occurrence: a batch sends an anchor or a text once, with its least and its
greatest document, however many of its documents have it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Bytes of text in a batch, and bytes of text whose anchors one reducer gets.
BATCH_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
#: Units whose anchors are sought at once, and bytes of words hashed at once.
PIECE, HASHED = 1 << 16, 1 << 18
_POS = np.uint64((1 << 22) - 1)
_MUL = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_M64 = (1 << 64) - 1
_LAST = np.iinfo(np.int64).max
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Frame:
    """window: W; gram: k, a power of two; words: units are words, else bytes; classes: (contexts,
    counts, W) -> the class of each window of each context, one after the other."""

    window: int
    gram: int
    words: bool
    classes: Callable


# ---------------------------------------------------------------- packing


def pack(**columns: np.ndarray) -> bytes:
    """Columns of one length, 64-bit ones as differences, compressed together."""
    import zstandard

    parts = [len(next(iter(columns.values()))).to_bytes(4, "little")]
    for c in columns.values():
        c = np.ascontiguousarray(c)
        if c.dtype == np.int64:
            c = np.diff(c, prepend=np.int64(0))
            # byte planes: the high bytes are nearly all alike
            parts.append(c.view(np.uint8).reshape(-1, 8).T.tobytes())
        else:
            parts.append(c.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for t in types:
        if t is np.int64:
            planes = np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T
            out.append(np.cumsum(np.ascontiguousarray(planes).reshape(-1).view(np.int64)))
            at += 8 * n
        else:
            size = np.dtype(t).itemsize
            out.append(np.frombuffer(raw, t, n, at))
            at += size * n
    return out


def pack_texts(texts: list[bytes], level: int = 3) -> bytes:
    import zstandard

    sizes = pack(size=np.fromiter(map(len, texts), np.int64, len(texts)))
    return len(sizes).to_bytes(8, "little") + sizes + zstandard.ZstdCompressor(level=level).compress(b"".join(texts))


def unpack_texts(blob: bytes) -> list[bytes]:
    import zstandard

    n = 8 + int.from_bytes(blob[:8], "little")
    ends = np.cumsum(unpack(blob[8:n], np.int64)[0]).tolist()
    raw = zstandard.ZstdDecompressor().decompress(blob[n:])
    return [raw[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]


# ---------------------------------------------------------------- units


@dataclass(frozen=True)
class Laid:
    """Texts side by side: their bytes, the unit that each text starts at (and one more), and where each
    word starts and ends in the bytes; words are followed by one space each. Bytes are their own units."""

    raw: bytes
    first: np.ndarray
    starts: np.ndarray | None
    ends: np.ndarray | None

    def between(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte ranges of units lo up to hi; no range is empty."""
        return (lo, hi) if self.starts is None else (self.starts[lo], self.ends[hi - 1])


def lay(texts: list[bytes], words: bool) -> Laid:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not words:
        return Laid(b"".join(texts), np.concatenate([[0], np.cumsum(sizes)]), None, None)
    buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    space = _SPACE[buf]
    after = np.concatenate([[True], space[:-1]]) if len(space) else space
    begins = np.flatnonzero(~space & after)
    first = np.searchsorted(begins, np.concatenate([[0], np.cumsum(sizes + 1)]))
    size = np.flatnonzero(space & ~after) - begins
    out = buf[~(space & after)]
    out[_SPACE[out]] = 0x20
    starts = np.cumsum(size + 1) - size - 1
    return Laid(out.tobytes(), first, starts, starts + size)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    size, p = 1, base & _M64
    while size < n:
        m = min(size, n - size)
        out[size : size + m] = out[:m] * np.uint64(p)
        p = p * p & _M64
        size *= 2
    return out


_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_cache: dict[str, np.ndarray] = {}


def _hash_together(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word from prefix sums over at most HASHED bytes."""
    if "up" not in _cache or len(_cache["up"]) <= HASHED:
        _cache["up"], _cache["down"] = _powers(HASHED + 1, _MUL), _powers(HASHED + 1, pow(_MUL, -1, 1 << 64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[buf] * _cache["up"][: len(buf)])])
    h = (sums[ends] - sums[starts]) * _cache["down"][starts]
    return h ^ (h >> np.uint64(31))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, in memory that the longest word does not raise by more than its own size."""
    import hashlib

    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(ends, a + HASHED, "right"))
        if j <= i:
            j = i + 1
            out[i] = int.from_bytes(hashlib.blake2b(buf[a : ends[i]], digest_size=8).digest(), "little")
        else:
            out[i:j] = _hash_together(buf[a : ends[j - 1]], starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def unit_hashes(laid: Laid, lo: int, hi: int) -> np.ndarray:
    buf = np.frombuffer(laid.raw, np.uint8)
    if laid.starts is None:
        return _TABLE[buf[lo:hi]]
    return word_hashes(buf, laid.starts[lo:hi], laid.ends[lo:hi])


def runs(laid: Laid, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, count, anchor hash) of the runs of windows with one anchor; no window leaves its text."""
    total, found = int(laid.first[-1]), []
    for lo in range(0, total, PIECE):
        hi = min(total, lo + PIECE + window - 1)
        if hi - lo < window:
            break
        a, b = np.searchsorted(laid.first, lo, "right") - 1, np.searchsorted(laid.first, hi, "left")
        until = np.repeat(laid.first[a + 1 : b + 1], np.diff(np.clip(laid.first[a : b + 1], lo, hi)))
        m = min(PIECE, hi - lo - window + 1)
        at = np.flatnonzero(until[:m] >= np.arange(lo + window, lo + window + m))
        if not len(at):
            continue
        h, least = _least_grams(unit_hashes(laid, lo, hi), window, gram)
        anchor = (least[at] & _POS).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        found.append((at[new] + lo, np.diff(np.append(new, len(at))), h[anchor[new]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _least_grams(units: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the grams, and of the grams in each window the least one, its place in the low bits."""
    h, step, p = units, 1, _MUL
    while step < gram:
        h = h[:-step] * np.uint64(p) + h[step:]
        p = p * p & _M64
        step *= 2
    h = (h ^ (h >> np.uint64(29))) * _MIX
    h ^= h >> np.uint64(32)
    least = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    width, step = window - gram + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        rest = width - step
        least = np.minimum(least[:-rest], least[rest:])
    return h, least


# ---------------------------------------------------------------- batches

CORPUS = "batch long, size long, docs binary, texts binary"
SENT = "bucket long, batch long, blob binary"


@dataclass(frozen=True)
class Batch:
    """number; ids of the documents, nulls as 0 and marked; their texts; rank: documents in the order of
    their ids, null last, equal ids with one rank."""

    number: int
    ids: np.ndarray
    nulls: np.ndarray
    texts: list[bytes]
    rank: np.ndarray


def ranked(ids: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    order = np.lexsort((ids, nulls))
    i, n = ids[order], nulls[order]
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], (i[1:] != i[:-1]) | (n[1:] != n[:-1])]).astype(np.int64))[: len(ids)]
    return out


def batches(docs: DataFrame) -> DataFrame:
    """The texts of docs (doc_id, text) in batches of BATCH_BYTES; a longer text is a batch of its own.
    Null text is empty. To be written before use: the numbers hold for one run over docs only."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        nth, size, held = TaskContext.get().partitionId() << 32, 0, []

        def close() -> pa.RecordBatch:
            ids = np.array([h[0] or 0 for h in held], np.int64)
            head = pack(id=ids, null=np.array([h[0] is None for h in held], np.uint8))
            return _rows(["batch", "size", "docs", "texts"], [(nth, sum(len(h[1]) for h in held), head, pack_texts([h[1] for h in held], 1))])

        for b in arrow:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), strict=True):
                    if held and size + len(text) > BATCH_BYTES:
                        yield close()
                        nth, size, held = nth + 1, 0, []
                    held.append((doc, text))
                    size += len(text) + 16
        if held:
            yield close()

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, CORPUS)


def _rows(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"docs": pa.binary(), "texts": pa.binary(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, pa.int64())) for i, n in enumerate(names)], names=names)


def opened(arrow: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The batches of an Arrow stream, each with what its other columns, in order, hold for it."""
    for whole in arrow:
        for at in range(whole.num_rows):
            row = whole.slice(at, 1)
            ids, nulls = unpack(row["docs"][0].as_py(), np.int64, np.uint8)
            more = [row[n][0].as_py() for n in row.schema.names if n not in ("batch", "docs", "texts")]
            yield Batch(row["batch"][0].as_py(), ids, nulls, unpack_texts(row["texts"][0].as_py()), ranked(ids, nulls)), *more


def _groups(sorted_: np.ndarray) -> np.ndarray:
    """Where the groups of equal values start."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def _spread(batch: Batch, docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group of docs (places in the batch) the one of least and the one of greatest rank."""
    key = batch.rank[docs] * (len(batch.ids) + 1) + docs
    return tuple(f.reduceat(key, starts) % (len(batch.ids) + 1) for f in (np.minimum, np.maximum))


def _buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(34)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, _groups(bucket[order])[1:]):
        if len(part):
            yield int(bucket[part[0]]), part


def anchors(corpus: DataFrame, frame: Frame, buckets: int) -> DataFrame:
    """Each anchor of a batch once, with its least document and whether the batch has it in two."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (batch,) in opened(arrow):
            laid = lay(batch.texts, frame.words)
            start, _, hashes = runs(laid, frame.window, frame.gram)
            if not len(start):
                continue
            doc = np.searchsorted(laid.first, start, "right") - 1
            order = np.argsort(hashes, kind="stable")
            at = _groups(hashes[order])
            low, high = _spread(batch, doc[order], at)
            two, hashes = batch.rank[low] != batch.rank[high], hashes[order][at]
            place = np.argsort(low, kind="stable")  # by document, so that ids differ by little
            low, two, hashes = low[place], two[place], hashes[place]
            short, ids, nulls = hashes.astype(np.uint32), batch.ids[low], batch.nulls[low]
            blob = lambda i: pack(id=ids[i], key=short[i], two=(two[i] * 2 + nulls[i]).astype(np.uint8))  # noqa: E731, B023
            yield _rows(["bucket", "batch", "blob"], [(b, batch.number, blob(i)) for b, i in _by_bucket(_buckets(hashes, buckets))])

    return corpus.select("batch", "docs", "texts").mapInArrow(run, SENT)


def repeated(sent: DataFrame) -> DataFrame:
    """(batch, hits): for each batch its anchors that two documents have, as bucket << 32 | key."""

    def run(table):
        got = [unpack(b, np.int64, np.uint32, np.uint8) for b in table["blob"].to_pylist()]
        ids, key, mark = (np.concatenate([g[i] for g in got]) for i in range(3))
        order = np.argsort(key, kind="stable")
        at, i, null = _groups(key[order]), ids[order], mark[order] & 1
        differ = np.minimum.reduceat(i, at) != np.maximum.reduceat(i, at)
        differ |= np.minimum.reduceat(null, at) != np.maximum.reduceat(null, at)
        differ |= np.maximum.reduceat(mark[order], at) > 1
        hit = np.empty(len(key), bool)
        hit[order] = np.repeat(differ, np.diff(np.append(at, len(key))))
        cuts = np.cumsum([len(g[0]) for g in got])[:-1]
        bucket = table["bucket"][0].as_py()
        out = [(n, pack(key=np.sort(k[h].astype(np.int64)) | (bucket << 32))) for n, k, h in zip(table["batch"].to_pylist(), np.split(key, cuts), np.split(hit, cuts), strict=True) if h.any()]
        return pa.Table.from_batches([_rows(["batch", "blob"], out)])

    return sent.groupBy("bucket").applyInArrow(run, "batch long, blob binary").groupBy("batch").agg(F.collect_list("blob").alias("hits"))


@dataclass(frozen=True)
class Found:
    """The runs of a batch at repeated anchors, by bucket and in the order of the batch: where they start,
    their document (a place in the batch), and which of the bucket's texts they are. texts: for each
    bucket its distinct texts, with key and number of windows."""

    laid: Laid
    start: dict[int, np.ndarray]
    doc: dict[int, np.ndarray]
    which: dict[int, np.ndarray]
    texts: dict[int, tuple[list[bytes], np.ndarray, np.ndarray]]


def find(batch: Batch, hits: list[bytes], frame: Frame, buckets: int) -> Found:
    """The same for the same batch and hits, so both passes over the batches number texts alike."""
    laid = lay(batch.texts, frame.words)
    start, count, hashes = runs(laid, frame.window, frame.gram)
    wanted = np.sort(np.concatenate([unpack(h, np.int64)[0] for h in hits]))
    bucket, short = _buckets(hashes, buckets), hashes.astype(np.uint32)
    code = bucket << 32 | short
    place = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
    i = np.flatnonzero(wanted[place] == code)
    start, count, bucket, short = start[i], count[i], bucket[i], short[i]
    doc = np.searchsorted(laid.first, start, "right") - 1
    lo, hi = laid.between(start, start + count + frame.window - 1)
    raw, out = laid.raw, Found(laid, {}, {}, {}, {})
    for b, i in _by_bucket(bucket):
        known: dict[bytes, int] = {}
        which = np.fromiter((known.setdefault(raw[s:e], len(known)) for s, e in zip(lo[i].tolist(), hi[i].tolist(), strict=True)), np.int64, len(i))
        head = np.empty(len(known), np.int64)
        head[which[::-1]] = i[::-1]
        out.start[b], out.doc[b], out.which[b], out.texts[b] = start[i], doc[i], which, (list(known), short[head], count[head])
    return out


def contexts(narrow: DataFrame, frame: Frame, buckets: int) -> DataFrame:
    """The texts of the runs at repeated anchors, each once a batch, with its least and greatest document."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hits in opened(arrow):
            found, out = find(batch, hits, frame, buckets), []
            for b, (texts, key, count) in found.texts.items():
                order = np.argsort(found.which[b], kind="stable")
                low, high = _spread(batch, found.doc[b][order], _groups(found.which[b][order]))
                ids, nulls = batch.ids, batch.nulls
                marks = (nulls[low] + 2 * nulls[high]).astype(np.uint8)
                head = pack(low=ids[low], high=ids[high], key=key, count=count.astype(np.uint32), null=marks)
                out.append((b, batch.number, len(head).to_bytes(4, "little") + head + pack_texts(texts)))
            if out:
                yield _rows(["bucket", "batch", "blob"], out)

    return narrow.select("batch", "docs", "texts", "hits").mapInArrow(run, SENT)


class Meeting:
    """What a reducer knows of the windows at its anchors.

    texts: the distinct texts; first, count: their windows, numbered one text after the other; least: the
    rank of the least document that has each window, most: that of the greatest; ids, nulls: the
    documents by rank. Of each batch that sent something: its number, the texts it sent, the greatest
    rank it has of each."""

    def __init__(self, table, frame: Frame):
        known: dict[bytes, int] = {}
        which, cols = [], []
        for blob in table["blob"].to_pylist():
            n = 4 + int.from_bytes(blob[:4], "little")
            body = unpack_texts(blob[n:])
            which.append(np.fromiter((known.setdefault(t, len(known)) for t in body), np.int64, len(body)))
            cols.append(unpack(blob[4:n], np.int64, np.int64, np.uint32, np.uint32, np.uint8))
        low, high, key, count, null = (np.concatenate([c[j] for c in cols]) for j in range(5))
        rank = ranked(np.concatenate([low, high]), np.concatenate([null & 1, null >> 1]))
        place = np.argsort(rank, kind="stable")
        place = place[_groups(rank[place])]
        self.ids, self.nulls = np.concatenate([low, high])[place], np.concatenate([null & 1, null >> 1])[place]
        low, high = rank[: len(low)], rank[len(low) :]
        self.batch, self.which = table["batch"].to_pylist(), which
        self.high = np.split(high, np.cumsum([len(w) for w in which])[:-1])
        self.texts, all_ = list(known), np.concatenate(which)
        n = len(self.texts)
        self.count, short = np.zeros(n, np.int64), np.zeros(n, np.uint32)
        self.count[all_], short[all_] = count, key
        least, most = np.full(n, _LAST), np.full(n, -1)
        np.minimum.at(least, all_, low)
        np.maximum.at(most, all_, high)
        self.first = np.cumsum(self.count) - self.count
        self.least, self.most = np.repeat(least, self.count), np.repeat(most, self.count)
        # windows are compared where one anchor has several texts; alone, a text's windows have its documents
        order = np.argsort(short, kind="stable")
        size = np.diff(np.append(_groups(short[order]), n))
        several = np.sort(order[np.repeat(size > 1, size)])
        self.classes = -1 - np.arange(len(self.least))
        if len(several):
            counts = self.count[several]
            classes = frame.classes([self.texts[j] for j in several], counts, frame.window)
            where = np.repeat(self.first[several] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            low, high = np.full(classes.max() + 1, _LAST), np.full(classes.max() + 1, -1)
            np.minimum.at(low, classes, self.least[where])
            np.maximum.at(high, classes, self.most[where])
            self.classes[where], self.least[where], self.most[where] = classes, low[classes], high[classes]

    def stretches(self, new: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cut all windows where new says, and between texts: (text, first window in it, windows) of each."""
        of = np.repeat(np.arange(len(self.texts)), self.count)
        new[0], new[1:] = True, new[1:] | (of[1:] != of[:-1])
        at = np.flatnonzero(new)
        return of[at], at - self.first[of[at]], np.diff(np.append(at, len(of)))


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes: the group of each member, and its number in it."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def picked(owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """owner, sorted, holds numbers below n: where each one's group starts, and how long it is."""
    size = np.bincount(owner, minlength=n)
    return np.cumsum(size) - size, size


def spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of intervals that are sorted by start; touching ones join."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return starts[new], reach[np.append(new[1:], len(starts)) - 1]


def later(ids: np.ndarray, nulls: np.ndarray, than_ids: np.ndarray, than_nulls: np.ndarray) -> np.ndarray:
    """Whether documents come after others in the order of ids, null last."""
    return (nulls > than_nulls) | ((nulls == than_nulls) & (ids > than_ids))


@dataclass(frozen=True)
class Narrowed:
    corpus: DataFrame
    hits: DataFrame
    sent: DataFrame
    buckets: int


def narrowed(docs: DataFrame, frame: Frame) -> Narrowed:
    """The written batches, their repeated anchors, the contexts that batches send (not yet written), and
    the number of buckets."""
    corpus = materialize(batches(docs), "window-batches")
    total = corpus.agg(F.sum("size")).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    hits = materialize(repeated(anchors(corpus, frame, buckets)), "window-hits")
    release(docs.sparkSession)
    return Narrowed(corpus, hits, contexts(corpus.join(hits, "batch"), frame, buckets), buckets)


def judged(n: Narrowed, found: DataFrame) -> DataFrame:
    """The batches with hits and found (batch, blob) gathered as lists; null where a batch has none."""
    gathered = found.groupBy("batch").agg(F.collect_list("blob").alias("found"))
    return n.corpus.join(n.hits.join(gathered, "batch"), "batch", "left").select("batch", "docs", "texts", "hits", "found")



def slices(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
