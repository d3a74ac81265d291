"""Byte-level BPE by overlapping chunks.

A long text is cut into chunks that overlap. All chunks are pre-tokenised in parallel. Where two
neighbours have a pre-token boundary in common inside their overlap, they agree from there on, and the
text is stitched there: it falls into pieces that begin and end at such boundaries. Then all pieces are
encoded in parallel, each pre-token on its own by the ranks of the vocabulary, and the ids of a document
are put together in order. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: The code points with the Unicode property White_Space, which is what \s means in the pattern.
WHITE_SPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

CHUNK, OVERLAP = 1 << 15, 1 << 9  # code points
CACHED = 200_000  # pre-tokens a worker remembers at most


class Codec:
    """Encoder and decoder for one file of ranks; the file is read where the code runs."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        explicit = pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]")
        self.find = regex.compile(explicit).finditer
        self.all = regex.compile(explicit).findall
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._encode_single_piece
        self.known: dict[str, tuple[str, int]] = {}

    def ends(self, text: str) -> list[int]:
        """Where pre-tokens end."""
        return [m.end() for m in self.find(text)]

    def ids(self, pieces: list[str]) -> list[tuple[str, int]]:
        """For each pre-token its ids, as decimals joined by a space, and how many they are."""
        known = self.known
        if len(known) > CACHED:
            known.clear()
        for p in set(pieces).difference(known):
            ids = self.merge(p.encode())
            known[p] = " ".join(map(str, ids)), len(ids)
        return [known[p] for p in pieces]

    def decode(self, ids: str) -> bytes:
        """The bytes of ids given as decimals."""
        return b"".join(map(self.bytes_of.__getitem__, map(int, ids.split())))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every text of docs (doc_id, text) and decode the ids again.

    One row per document: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space),
    decoded_sha256 (of the decoded bytes). Null text is empty; doc_id may be null or repeat, rows are
    told apart by a row number of their own; other columns are ignored.
    """
    digests = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))

    is_long = F.length("text") > CHUNK
    return rows.filter(~is_long).mapInArrow(_at_once(path, pattern), digests).unionByName(_encode_long(rows.filter(is_long), path, pattern, digests))


def _at_once(path: str, pattern: str):
    """Each text of a batch encoded as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b, out = whole.slice(at, 512), []
                for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                    got = c.ids(c.all(text))
                    ids = " ".join([x[0] for x in got])
                    out.append((doc, sum([x[1] for x in got]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
                yield _digest_rows(out)

    return run


def stitched(marks: DataFrame) -> DataFrame:
    """marks (doc_id, hash, chunk, heads, tails) with piece, a number that rises along the document, start,
    where the piece begins in its first chunk, and stop, where the next one does in the next chunk.

    heads: boundaries in the head of the chunk, tails: those from the next chunk's start on, both counted
    from there. The end of a chunk may have moved the last two of its boundaries, so these don't count."""
    order = Window.partitionBy("doc_id", "hash").orderBy("chunk")
    before = F.lag("tails").over(order)
    sure = F.filter(F.slice(before, 1, F.greatest(F.size(before) - 2, F.lit(0))), lambda x: x > 0)
    found = marks.withColumn("start", F.when(F.col("chunk") == 0, 0).otherwise(F.array_min(F.array_intersect(sure, F.col("heads")))))
    piece = F.sum(F.col("start").isNotNull().cast("int")).over(order)
    return found.select("doc_id", "hash", "chunk", piece.cast("long").alias("piece"), "start", F.lead("start").over(order).alias("stop"))


def _encode_long(rows: DataFrame, path: str, pattern: str, digests: str) -> DataFrame:
    # Chunks leave the task that read the text: they are dealt out by document and chunk, whatever
    # the length of the document. hash tells apart different texts of one doc_id; equal rows of one
    # doc_id are one document with a number of copies.
    keyed = rows.groupBy("doc_id", F.sha2("text", 256).alias("hash")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    n = F.ceil(F.length("text") / CHUNK).cast("int")
    cut = keyed.select("doc_id", "hash", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    cut = cut.select("doc_id", "hash", "chunk", F.col("text").substr(F.col("chunk") * CHUNK + 1, F.lit(CHUNK + OVERLAP)).alias("part")).repartition("doc_id", "hash", "chunk")

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        names = ["doc_id", "hash", "chunk", "part", "heads", "tails"]
        for b in batches:
            ends = [c.ends(t) for t in b["part"].to_pylist()]
            tails = [[x - CHUNK for x in e if x >= CHUNK] for e in ends]
            heads = [[x for x in e if x <= OVERLAP] for e in ends]
            marks = [pa.array(x, pa.list_(pa.int32())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays([*(b[k] for k in names[:4]), *marks], names=names)

    marked = materialize(cut.mapInArrow(pretokenise, "doc_id long, hash string, chunk int, part string, heads array<int>, tails array<int>"), "bpe-chunks")
    # only the boundaries of a document meet in one task, not its text
    places = stitched(marked.drop("part")).select(F.col("doc_id").alias("doc_"), F.col("hash").alias("hash_"), F.col("chunk").alias("chunk_"), "piece", "start", "stop")
    same = F.col("doc_id").eqNullSafe(F.col("doc_")) & (F.col("hash") == F.col("hash_")) & (F.col("chunk") == F.col("chunk_"))
    pieces = marked.drop("heads", "tails").join(places, same).select("doc_id", "hash", "piece", "chunk", "part", "start", "stop")
    pieces = pieces.repartition("doc_id", "hash", "piece").sortWithinPartitions("doc_id", "hash", "piece", "chunk")

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a piece: its ids as decimals, and whether a pre-token ends where the piece does. The
        chunks of a piece come one after the other; most pieces lie in one chunk."""
        c = codec(path, pattern)
        names = ["doc_id", "hash", "piece", "chunk", "part", "start", "stop"]
        rows = ([x for x in zip(*(b[k].to_pylist() for k in names), strict=True)] for b in batches)
        at, held, out = None, [], []
        for doc, h, piece, _, part, start, stop in (r for b in rows for r in b):
            if at != (doc, h, piece):
                if held:
                    out.append((*at, *_piece_ids(c, held)))
                at, held = (doc, h, piece), []
                if len(out) >= 64:
                    yield _piece_rows(out)
                    out = []
            held.append((part, start, stop))
        if held:
            out.append((*at, *_piece_ids(c, held)))
        yield _piece_rows(out)

    done = materialize(pieces.mapInArrow(encode_pieces, "doc_id long, hash string, piece long, ids string, whole boolean"), "bpe-pieces")
    own = keyed.select(F.col("doc_id").alias("doc_"), F.col("hash").alias("hash_"), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("doc_")) & (F.col("hash") == F.col("hash_"))
    # pieces that begin at a true boundary and end at one prove the next one's beginning; where one does
    # not, scans that were both out of step have met, and the document is encoded in one go
    broken = done.filter("not whole").select(F.col("doc_id").alias("doc_"), F.col("hash").alias("hash_")).distinct()
    order = ["doc_id", "hash", "piece"]
    ids = done.join(broken, same, "left_anti").join(own, same).select(*order, "copies", "ids").repartition("doc_id", "hash").sortWithinPartitions(*order)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        at = None
        for b in batches:
            out: list[tuple] = []
            for doc, h, copies, own in zip(*(b[k].to_pylist() for k in ("doc_id", "hash", "copies", "ids")), strict=True):
                if at != (doc, h):
                    if at is not None:
                        out += [(at[0], n, ids_sha.hexdigest(), out_sha.hexdigest())] * times
                    at, n, times, ids_sha, out_sha = (doc, h), 0, copies, hashlib.sha256(), hashlib.sha256()
                if own:
                    ids_sha.update((" " * (n > 0) + own).encode())
                    out_sha.update(c.decode(own))
                    n += own.count(" ") + 1
            if out:
                yield _digest_rows(out)
        if at is not None:
            yield _digest_rows([(at[0], n, ids_sha.hexdigest(), out_sha.hexdigest())] * times)

    whole = keyed.join(broken, same, "left_semi").select("doc_id", F.explode(F.array_repeat("text", F.col("copies").cast("int"))).alias("text"))
    return ids.mapInArrow(put_together, digests).unionByName(whole.mapInArrow(_at_once(path, pattern), digests))


def _piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "hash", "piece", "ids", "whole"])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _piece_ids(c: Codec, chunks: list[tuple]) -> tuple[str, bool]:
    """The ids of a piece by its chunks (part, start, stop): it begins at start in the first one and ends
    at stop in the one after the last, or with the text."""
    start = chunks[0][1]
    last, _, stop = chunks[-1]
    body = [p[:CHUNK] for p, _, _ in chunks[:-1]]
    if stop is None:
        return " ".join(x[0] for x in c.ids(c.all("".join([*body, last])[start:]))), True
    text = "".join([*body, last[: CHUNK + stop]])[start:]
    pieces, at_end = _as_in_context(c, text, last[CHUNK + stop :])
    return " ".join(x[0] for x in c.ids(pieces)), at_end


def _as_in_context(c: Codec, text: str, following: str) -> tuple[list[str], bool]:
    """The pre-tokens of text when `following` comes after it, and whether one ends where text does."""
    pieces, at = [], 0
    for m in c.find(text + following):
        if at >= len(text):
            break
        pieces.append(m[0])
        at = m.end()
    return pieces, at == len(text)
