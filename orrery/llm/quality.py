"""Quality scores from random Fourier features.

Statistics of the whole text are standardised and mapped to cosines of random directions, which
approximate a Gaussian kernel. Ridge regression on them is solved from normal equations that each
partition sums for itself; isotonic regression on out-of-fold scores turns them into probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Random features, ridge, folds, and the cells of the scores that isotonic regression sees.
FEATURES, RIDGE, FOLDS, CELLS = 256, 1e-3, 3, 1024
#: Partitions that sum the other partitions' normal equations; the driver gets as many matrices a fold.
SUMMERS = 8
NAMES = ["log_bytes", "upper", "digit", "space", "newline", "point", "mark", "beyond", "entropy", "word_len", "word_spread", "distinct", "ended", "line_len", "short_lines", "distinct_lines", "squeezed", "stops", "capitals"]
_POINTS = b".,;:'\"()-?"


def statistics(text: bytes) -> list[float]:
    """What a text's score is computed from; nothing but the text goes in."""
    if not text:
        return [0.0] * len(NAMES)
    n = len(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digit, space = count[65:91].sum(), count[48:58].sum(), count[9:14].sum() + count[32]
    points = count[np.frombuffer(_POINTS, np.uint8)].sum()
    ascii_ = count[33:127].sum()
    marks = ascii_ - count[97:123].sum() - upper - digit - points
    p = count[count > 0] / n
    words = text.split()
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = text.split(b"\n")
    line = np.fromiter(map(len, lines), np.float64, len(lines))
    w = max(len(words), 1)
    return [
        np.log1p(n), upper / n, digit / n, space / n, count[10] / n, points / n, marks / n, count[128:].sum() / n,
        float(-(p * np.log2(p)).sum()), sizes.mean(), sizes.std(), len(set(words)) / w, (count[46] + count[33] + count[63]) / w,
        np.log1p(line.mean()), float((line < 30).mean()), len(set(lines)) / len(lines), len(zlib.compress(text, 1)) / n, count[46] / w, sum(map(bytes.isupper, words)) / w,
    ]


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                x = [list(map(float, statistics(t or b""))) for t in b["text"].cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<float>")


class Map:
    """From statistics to random features; the last is the constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES, seed: int = 5):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.turn = rng.standard_normal((d, features)) / np.sqrt(d)
        self.phase = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        z = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.turn + self.phase)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def _rows(b: pa.RecordBatch) -> np.ndarray:
    return b["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES)).astype(np.float64)


def normal_equations(train: DataFrame, features: Map) -> dict[int, np.ndarray]:
    """For each fold the sum of z z' with z = (features, label). Partitions sum their rows, SUMMERS
    tasks sum the partitions; the driver gets at most SUMMERS * FOLDS matrices."""
    schema = "fold int, sums binary"

    def by_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            z = np.concatenate([features(_rows(b)), b["y"].to_numpy()[:, None]], axis=1)
            fold = b["fold"].to_numpy()
            for k in np.unique(fold):
                own = z[fold == k]
                sums[k] = sums.get(k, 0) + own.T @ own
        yield _sums(sums)

    def of_partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, s in zip(b["fold"].to_pylist(), b["sums"].to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(s)
        yield _sums(sums)

    size = FEATURES + 2
    out: dict[int, np.ndarray] = {k: np.zeros((size, size)) for k in range(FOLDS)}
    for r in train.select("x", "y", "fold").mapInArrow(by_partition, schema).repartition(SUMMERS).mapInArrow(of_partitions, schema).collect():
        out[r["fold"]] += np.frombuffer(r["sums"]).reshape(size, size)
    return out


def _sums(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(k) for k in sums], pa.int32()), pa.array([np.ascontiguousarray(s).tobytes() for s in sums.values()], pa.binary())], names=["fold", "sums"])


def ridge(sums: np.ndarray, strength: float = RIDGE) -> np.ndarray:
    n = max(sums[-2, -2], 1.0)
    a = sums[:-1, :-1] + np.diag(np.append(np.full(len(sums) - 2, strength * n + 0.1), 1e-9))
    return np.linalg.solve(a, sums[:-1, -1])


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y: pool adjacent violators, x sorted."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, weight, strict=True):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document of docs (doc_id, text) for quality as labels (doc_id, quality) marks it.

    One row per document: doc_id, held_out, score (0 to 1), predicted (1 from 0.5). Labels of documents
    whose crc32(doc_id as text) mod 3 is 1 are never learnt from; these are held out. Labels other than
    0 and 1 and those of unknown documents don't count; a doc_id labelled twice counts with the mean;
    rows that repeat a doc_id are each learnt from and scored. Null text is empty and scored as such; a
    null doc_id is not held out. Without any label all scores are 0.5. Other columns are ignored.
    """
    rows = materialize(described(docs), "quality-statistics")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    marks = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    train = materialize(rows.join(marks.filter(part != 1), "doc_id").select("x", "y", fold.alias("fold")), "quality-train")
    held_out = F.coalesce(part == 1, F.lit(False)).alias("held_out")
    moments = train.agg(F.count("*"), *(f(F.col("x")[j].cast("double")) for j in range(len(NAMES)) for f in (F.avg, F.stddev_pop))).first()
    if not moments[0]:
        return rows.select("doc_id", held_out, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    moments = np.array(moments[1:], float)
    features = Map(moments[0::2], moments[1::2])
    sums = normal_equations(train, features)
    whole = ridge(sum(sums.values()))
    parts = np.stack([ridge(sum(s for j, s in sums.items() if j != k)) for k in range(FOLDS)])

    def out_of_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = (features(_rows(b)) * parts[b["fold"].to_numpy()]).sum(1)
            cell = np.clip((raw + 1) / 3 * CELLS, 0, CELLS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(raw), b["y"]], names=["cell", "raw", "y"])

    cells = train.select("x", "y", "fold").mapInArrow(out_of_fold, "cell int, raw double, y double").groupBy("cell").agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("cell").collect()
    knots = isotonic(*(np.array([r[c] for r in cells], float) for c in ("raw", "y", "n")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = features(_rows(b)) @ whole
            # the rising function, and a thousandth of the raw score so that its flat parts keep their order
            s = 0.999 * np.interp(raw, *knots) + 0.001 * np.clip((raw + 1) / 3, 0, 1)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(np.clip(s, 0, 1))], names=["doc_id", "score"])

    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
