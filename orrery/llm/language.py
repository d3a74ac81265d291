"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte of the lower-cased text is a position. The network runs over the text both ways and labels
every position; a document's probabilities are the mean over its positions. Long texts are cut into
stretches that are read side by side; the states are run in over the bytes before and after a stretch,
so that no position is labelled out of context. The network is trained here, in numpy, by
backpropagation through time, on stretches of a bounded sample of the documents. One more label, for no
language, is learnt from the same stretches with their bytes shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

#: Bytes of a stretch, bytes on each side of it that run the states in, and units of the network each way.
STRETCH, CONTEXT, HIDDEN = 256, 32, 12
#: The training sample: documents a language at most, and in all (one of each language at least);
#: stretches a document and their bytes.
PER_LANGUAGE, IN_ALL, PER_DOCUMENT, LEARNT = 600, 4000, 2, 128
EPOCHS, BATCH, RATE = 6, 128, 0.02
#: One stretch in so many is learnt a second time, shuffled, as no language.
SHUFFLED = 4
#: Stretches labelled at once.
AT_ONCE = 512
#: The table of languages, one row each, is broadcast if it has no more rows than this.
SMALL = 10_000


@lru_cache(1)
def _letter():
    import regex

    return regex.compile(r"\p{L}").search


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _side_by_side(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(time, batch) bytes with zeros after the ends, and the lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    longest = int(size.max())
    return np.frombuffer(b"".join(t.ljust(longest, b"\0") for t in texts), np.uint8).reshape(len(texts), longest).T, size


class Network:
    """The weights, by name. t: what each byte adds to the gates, u: what the state adds. Gates in rows:
    reset, update, candidate. Labels are the languages and, last, none."""

    def __init__(self, languages: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-1])).astype(np.float32)
        self.languages = languages
        k = len(languages) + 1
        self.p = {"out": normal(k, 2 * HIDDEN), "out_b": np.zeros((k, 1), np.float32)}
        for d in "fb":
            self.p |= {f"t{d}": rng.standard_normal((3 * HIDDEN, 256)).astype(np.float32), f"u{d}": normal(3 * HIDDEN, HIDDEN)}

    def states(self, x: np.ndarray, size: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """(time, HIDDEN, batch): the state after each byte of x (time, batch). Backwards it starts at
        each text's own end."""
        table, u = self.p[f"t{d}"], self.p[f"u{d}"]
        n, shortest = HIDDEN, int(size.min())
        h = np.zeros((n, x.shape[1]), table.dtype)
        out = np.empty((len(x), n, x.shape[1]), table.dtype)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a, m = table.take(x[t], axis=1), u @ h
            g = a[: 2 * n]
            g += m[: 2 * n]
            g = _sigmoid(g)
            r, z = g[:n], g[n:]
            if t >= shortest:
                z *= t < size
            c = r * m[2 * n :]
            c += a[2 * n :]
            c = np.tanh(c)
            if keep is not None:
                keep.append((t, h, r, z, c, m[2 * n :]))
            h = h + z * (c - h)
            out[t] = h
        return out

    def labels(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Probabilities of the labels at each byte: (time, labels, batch)."""
        h = np.concatenate([self.states(x, size, d) for d in "fb"], axis=1)
        s = np.matmul(self.p["out"], h) + self.p["out_b"]
        s = np.exp(s - s.max(1, keepdims=True))
        return s / s.sum(1, keepdims=True)

    def gradients(self, x: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients by backpropagation through time, over the bytes of the texts."""
        p, n = self.p, HIDDEN
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self.states(x, size, d, kept[d]) for d in "fb"], axis=1)
        s = np.matmul(p["out"], h) + p["out_b"]
        s = np.exp(s - s.max(1, keepdims=True))
        s /= s.sum(1, keepdims=True)
        real = np.arange(len(x))[:, None] < size[None, :]
        total = max(int(real.sum()), 1)
        at = (np.arange(len(x))[:, None], y[None, :], np.arange(x.shape[1])[None, :])
        loss = float(-(np.log(s[at] + 1e-9) * real).sum() / total)
        s[at] -= 1
        s *= (real / total)[:, None, :].astype(s.dtype)
        grad = {"out": np.einsum("tkb,thb->kh", s, h, optimize=True), "out_b": s.sum((0, 2))[:, None]}
        dh_all = np.matmul(p["out"].T, s)
        for i, d in enumerate("fb"):
            u = p[f"u{d}"]
            da, du = np.empty((len(x), 3 * n, x.shape[1]), u.dtype), np.zeros_like(u)
            back = np.zeros((n, x.shape[1]), u.dtype)
            for t, before, r, z, c, mc in reversed(kept[d]):
                dh = dh_all[t, i * n : (i + 1) * n] + back
                dc = dh * z * (1 - c * c)
                own = da[t]
                own[:n] = dc * mc * r * (1 - r)
                own[n : 2 * n] = dh * (c - before) * z * (1 - z)
                own[2 * n :] = dc
                dm = np.concatenate([own[: 2 * n], dc * r])
                du += dm @ before.T
                back = dh * (1 - z) + u.T @ dm
            index = x.reshape(-1)
            flat = da.transpose(1, 0, 2).reshape(3 * n, -1)
            grad |= {f"u{d}": du, f"t{d}": np.stack([np.bincount(index, row, 256) for row in flat]).astype(u.dtype)}
        return loss, grad

    def train(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = 4) -> list[float]:
        """Adam over shuffled batches. The loss of each epoch."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        losses, step = [], 0
        # a small sample gets as many steps as a large one
        epochs = max(epochs, min(60, -(-120 * BATCH // max(len(texts), 1))))
        for epoch in range(epochs):
            total, order = [], rng.permutation(len(texts))
            for lo in range(0, len(texts), BATCH):
                i = order[lo : lo + BATCH]
                # every other stretch is cut short, as short texts are
                own = [texts[j][: rng.integers(8, LEARNT) if rng.random() < 0.5 else None] for j in i]
                none = [bytes(rng.permutation(np.frombuffer(t, np.uint8))) for t in own[::SHUFFLED] if len(t) >= 16]
                x, size = _side_by_side([*own, *none])
                loss, grad = self.gradients(x, size, np.concatenate([y[i], np.full(len(none), len(self.languages))]))
                total.append(loss)
                step += 1
                rate = RATE * (0.2 if epoch * 4 >= epochs * 3 else 1)
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            losses.append(float(np.mean(total)))
        return losses

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """(texts, labels): the mean of the probabilities at all bytes of each text; none is empty."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        owner = np.repeat(np.arange(len(texts)), -(-size // STRETCH))
        start = np.concatenate([np.arange(0, n, STRETCH) for n in size.tolist()])
        end = np.minimum(start + STRETCH, size[owner])
        lo, hi = np.maximum(start - CONTEXT, 0), np.minimum(end + CONTEXT, size[owner])
        out = np.zeros((len(texts), len(self.languages) + 1))
        order = np.argsort(hi - lo, kind="stable")
        for at in range(0, len(order), AT_ONCE):
            i = order[at : at + AT_ONCE]
            x, n = _side_by_side([texts[o][a:b] for o, a, b in zip(owner[i], lo[i], hi[i], strict=True)])
            t = np.arange(len(x))[:, None]
            own = (t >= (start - lo)[i]) & (t < (end - lo)[i])
            np.add.at(out, owner[i], np.einsum("tkb,tb->bk", self.labels(x, n), own.astype(np.float32), optimize=True))
        return out / size[:, None]


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame) -> DataFrame:
    """(lang, draw, doc_id, nth, stretch): what the network learns from. Documents are taken by a hash of
    their id and text, about PER_LANGUAGE of each language, fewer if that makes more than IN_ALL, but
    one of each; of each one stretches at even distances over the whole text. Only lang and text of
    documents that are not held out are looked at."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    known = known.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.octet_length("text") > 0) & ~held_out())
    n = known.select("lang").distinct().count()
    quota = max(1, min(PER_LANGUAGE, IN_ALL // max(n, 1)))
    draw = F.pmod(F.xxhash64(F.lit("lid"), F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / (1 << 30)
    first = known.select("lang", draw.alias("draw")).groupBy("lang").agg(F.min("draw").alias("least"), F.count("*").alias("n"))
    upto = first.select("lang", F.greatest(F.col("least"), F.lit(float(quota)) / F.col("n")).alias("upto"))
    # the texts stay where they are, unless there are more languages than there ever were
    upto = F.broadcast(upto) if n <= SMALL else upto
    taken = known.withColumn("draw", draw).join(upto, "lang").filter("draw <= upto").select("lang", "draw", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, own, doc, text in zip(*(b[c].to_pylist() for c in ("lang", "draw", "doc_id", "text")), strict=True):
                text = text.lower().encode()
                n = -(-len(text) // LEARNT)
                for k in sorted({n * j // PER_DOCUMENT for j in range(PER_DOCUMENT)}):
                    out.append((lang, own, doc, k, text[k * LEARNT : (k + 1) * LEARNT]))
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["lang", "draw", "doc_id", "nth", "stretch"])

    return taken.mapInArrow(run, "lang string, draw double, doc_id long, nth long, stretch binary")


def learn(docs: DataFrame) -> Network | None:
    """The network for the languages of docs; None if no document has a language. What the driver gets
    is bounded: IN_ALL documents and one of each language, about, and of rows with one draw the first."""
    drawn = sample(docs)
    most = 2 * PER_DOCUMENT * (IN_ALL + drawn.select("lang").distinct().count())
    order = ["draw", "lang", "doc_id", "nth", "stretch"]
    got = drawn.orderBy(*order).limit(most).toPandas().sort_values(["lang", *order])
    if not len(got):
        return None
    languages = sorted(got["lang"].unique())
    net = Network(languages)
    net.train([bytes(s) for s in got["stretch"]], np.searchsorted(languages, got["lang"]))
    return net


#: The columns that label_languages() adds.
LABELS = ("lang_pred", "lang_score", "no_language")


def label_languages(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with three more columns, and their names (LABELS, with as many _ as make them new): the
    language, its probability among the languages, and the probability of no language. No row is moved.
    The language is `und`, with 0 and 1, where the text is null or has no letter, and for all if there
    is nothing to learn from."""
    net = learn(docs)
    names = [f.name for f in docs.schema.fields]
    at = next(i for i, n in enumerate(names) if n == "text")
    more = list(LABELS)
    while {n.lower() for n in names} & set(more):
        more = [f"{n}_" for n in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = _letter()
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                texts = b.column(at).to_pylist()
                full = [i for i, t in enumerate(texts) if net and t and letter(t)]
                lang, score, none = ["und"] * len(texts), [0.0] * len(texts), [1.0] * len(texts)
                if full:
                    p = net.documents([texts[i].lower().encode() for i in full])
                    known = p[:, :-1] / np.maximum(p[:, :-1].sum(1, keepdims=True), 1e-30)
                    for i, best, s, no in zip(full, known.argmax(1), known.max(1), p[:, -1], strict=True):
                        lang[i], score[i], none[i] = net.languages[best], float(min(s, 1.0)), float(no)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(none, pa.float64())], names=[*b.schema.names, *more])

    wide = StructType([*docs.schema.fields]).add(more[0], StringType()).add(more[1], DoubleType()).add(more[2], DoubleType())
    return docs.mapInArrow(run, wide), more


def identify(docs: DataFrame) -> DataFrame:
    """The language of every document of docs (doc_id, text, lang).

    One row per document: doc_id, held_out (crc32(doc_id as text) mod 5 is 0; such documents are never
    learnt from), lang_pred, score (the mean probability of lang_pred over the text's bytes, among the
    languages). Every lang value that a document outside the held-out ones has is learnt. A null doc_id
    is not held out and not learnt from; rows that repeat a doc_id are labelled one by one. Null text and
    text without a letter are `und` with score 0, as are all if nothing can be learnt. Other columns are
    ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    learnt, (lang, score, _) = label_languages(narrow)
    return learnt.select("doc_id", held_out().alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


def keep_identified(docs: DataFrame, most: float = 0.97) -> DataFrame:
    """The documents in a language, with all their columns: those go that have no letter, and those whose
    probability of no language is above `most` in the mean over their bytes. If nothing can be learnt,
    all documents with a letter would be `und` too, and all go."""
    learnt, (_, score, none) = label_languages(docs)
    return learnt.filter((F.col(score) > 0) & (F.col(none) <= most)).select(*docs.columns)
