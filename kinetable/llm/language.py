"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes, labels every byte position and pools the positions of the whole text.
It is trained here, in numpy, by backpropagation through time on a bounded sample of labelled windows.

Nulls, empty texts and texts without a letter give ``und`` with score 0; repeated rows give repeated
results; an empty table gives no rows, one without labels ``und`` throughout (a filter then keeps every text with a
letter).  Rows without a letter count for no language's share of the sample.  Very long texts are cut into
windows of ``WINDOW`` bytes that are all read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import filter_texts, gives_back, map_texts, pieces

#: Bound of the training sample: documents of each language, windows of each of these; languages, at most.
TRAIN_DOCS, TRAIN_WINDOWS, LANGUAGES = 300, 6, 1000
WINDOW, HIDDEN, EPOCHS, BATCH, RATE = 64, 6, 12, 128, 0.03
#: Windows that go through the network at once.
LANES = 1024
UNKNOWN = "und"
#: A filter rejects texts without a letter, and texts whose likeliest language has less than this many times the
#: probability that each language has by chance: the network can't tell what they are.
OVER_CHANCE = 1.2
_LETTER = regex.compile(r"\p{L}")


class ByteGRU:
    """Two gated recurrent networks, left to right and right to left, and a softmax at each position."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.h, self.k = hidden, classes
        self.w = {}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.w["u" + d] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
        self.w["o"] = rng.normal(0, 0.3, (2 * hidden, classes)).astype(np.float32)
        self.w["c"] = np.zeros(classes, np.float32)

    def run(self, x: np.ndarray, d: str) -> np.ndarray:
        """States (steps, hidden, lanes) at each step of x (steps, lanes), in the order of reading."""
        h = self.h
        table, u = np.ascontiguousarray(self.w["x" + d].T), np.ascontiguousarray(self.w["u" + d].T)
        table[: 2 * h] *= 0.5  # a sigmoid is a hyperbolic tangent at half its argument
        u[: 2 * h] *= 0.5
        lanes = x.shape[1]
        state = np.zeros((h, lanes), np.float32)
        out = np.empty((len(x), h, lanes), np.float32)
        gx, gh = np.empty((3 * h, lanes), np.float32), np.empty((3 * h, lanes), np.float32)
        for t in range(len(x)):
            np.take(table, x[t], axis=1, out=gx, mode="clip")
            np.dot(u, state, out=gh)
            gates = gx[: 2 * h]
            gates += gh[: 2 * h]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            z, n = gates[:h], gates[h:]
            n *= gh[2 * h :]
            n += gx[2 * h :]
            np.tanh(n, out=n)
            step = out[t]
            np.subtract(state, n, out=step)
            step *= z
            step += n
            state = step
        return out

    def traced(self, x: np.ndarray, d: str):
        """States (steps, lanes, hidden) and what backpropagation needs of each step."""
        h, table, u = self.h, self.w["x" + d], self.w["u" + d]
        state = np.zeros((x.shape[1], h), np.float32)
        out, kept = np.empty((*x.shape, h), np.float32), []
        for t in range(len(x)):
            gx, gh = table[x[t]], state @ u
            gates = 1 / (1 + np.exp(-(gx[:, : 2 * h] + gh[:, : 2 * h])))
            z, r, hn = gates[:, :h], gates[:, h:], gh[:, 2 * h :]
            n = np.tanh(gx[:, 2 * h :] + r * hn)
            kept.append((state, z, r, n, hn))
            out[t] = state = n + z * (state - n)
        return out, kept

    def gradients(self, x: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """x (steps, lanes) bytes of which the first ``size`` count, y (lanes) classes: gradients of the mean cross entropy over positions."""
        steps, lanes, h = *x.shape, self.h
        (f, kf), (b, kb) = self.traced(x, "f"), self.traced(x[::-1], "b")
        both = np.concatenate([f, b[::-1]], 2)
        logit = both @ self.w["o"] + self.w["c"]
        logit -= logit.max(2, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(2, keepdims=True)
        weight = (np.arange(steps)[:, None] < size) / (size * lanes)
        loss = float(-(np.log(p[:, np.arange(lanes), y] + 1e-9) * weight).sum())
        p[:, np.arange(lanes), y] -= 1
        p *= weight[:, :, None]
        p = p.astype(np.float32)
        g = {"o": np.tensordot(both, p, ((0, 1), (0, 1))), "c": p.sum((0, 1))}
        up = p @ self.w["o"].T
        for d, kept, seen, above in (("f", kf, x, up[:, :, :h]), ("b", kb, x[::-1], up[::-1, :, h:])):
            u, gu = self.w["u" + d], np.zeros_like(self.w["u" + d])
            to_table, back = np.empty((steps, lanes, 3 * h), np.float32), np.zeros((lanes, h), np.float32)
            for t in range(steps - 1, -1, -1):
                state, z, r, n, hn = kept[t]
                back = back + above[t]
                dn = back * (1 - z) * (1 - n * n)
                dz = back * (state - n) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                to_table[t] = np.concatenate([dz, dr, dn], 1)
                dh = np.concatenate([dz, dr, dn * r], 1)
                gu += state.T @ dh
                back = back * z + dh @ u.T
            ids, flat = seen.ravel(), to_table.reshape(-1, 3 * h)
            g["x" + d] = np.stack([np.bincount(ids, flat[:, j], 256) for j in range(3 * h)], 1).astype(np.float32)
            g["u" + d] = gu
        return g, loss

    def fit(self, x: np.ndarray, size: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> list[float]:
        """Adam over shuffled batches; x (windows, steps)."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(w) for k, w in self.w.items()}
        losses, t = [], 0
        for epoch in range(epochs):
            order, rate = rng.permutation(len(y)), RATE * (1 - epoch / epochs) + 1e-3
            for i in range(0, len(y), BATCH):
                own = order[i : i + BATCH]
                g, loss = self.gradients(np.ascontiguousarray(x[own].T), size[own], y[own])
                t += 1
                losses.append(loss)
                for k, grad in g.items():
                    m[k] += 0.1 * (grad - m[k])
                    v[k] += 0.01 * (grad * grad - v[k])
                    self.w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return losses

    def pooled(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sums of the positions' log probabilities for windows x (windows, steps) of so many bytes."""
        x = np.ascontiguousarray(x.T)
        f, b, o = self.run(x, "f"), self.run(x[::-1], "b")[::-1], np.ascontiguousarray(self.w["o"].T)
        logit = np.matmul(o[:, : self.h], f)
        logit += np.matmul(o[:, self.h :], b)
        logit += self.w["c"][:, None]
        counts = np.arange(len(x))[:, None] < size
        norm = np.log(np.exp(logit).sum(1))
        norm *= counts
        logit *= counts[:, None, :]
        return (logit.sum(0) - norm.sum(0)).T


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of all texts in rows of WINDOW bytes, the bytes of each row that count, and its text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    rows = -(-sizes // WINDOW)
    flat = np.zeros(int(rows.sum()) * WINDOW, np.uint8)
    first = (np.cumsum(rows) - rows) * WINDOW
    for start, t in zip(first.tolist(), texts, strict=True):
        flat[start : start + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), rows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)
    return flat.reshape(-1, WINDOW), np.minimum(WINDOW, sizes[owner] - nth * WINDOW), owner


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few windows of each training document, spread evenly over its bytes; every second one is cut short."""
    for batch in (p for b in batches for p in pieces(b, 0)):
        rows = []
        for text, lang, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode("utf-8", "replace")
            for k, i in enumerate(np.linspace(0, max(0, len(raw) - WINDOW), TRAIN_WINDOWS if len(raw) > WINDOW else 1).astype(int)):
                own = raw[i : i + (6 + (i * 7 + len(raw)) % 26 if k % 2 == 0 else WINDOW)]
                rows.append((lang, own.ljust(WINDOW, b"\0"), len(own), h))
        lang, own, n, h = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(own, pa.binary()), pa.array(n, pa.int32()), pa.array(h, pa.int64())], ["lang", "bytes", "n", "h"])


def train(docs: DataFrame, docs_per_lang: int = TRAIN_DOCS) -> tuple[list[str], ByteGRU | None]:
    """The languages and the network, from text and non-null lang of the documents that are not held out.

    About ``docs_per_lang`` documents of each language, drawn by a hash of id and text, give windows to the driver, and
    never more than twice as many windows as that makes.
    """
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return [], None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, docs_per_lang / n))])
    drawn = usable.withColumn("h", F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1_000_003))).filter(F.col("h") < share[F.col("lang")] * 1_000_003)
    got = drawn.select("text", "lang", "h").mapInArrow(gives_back(_samples), "lang string, bytes binary, n int, h long")
    got = got.orderBy("h", "bytes").limit(2 * docs_per_lang * TRAIN_WINDOWS * len(counts)).drop("h").toPandas()
    langs = sorted(set(got["lang"]))
    if not langs:
        return [], None
    got = got.sort_values(["lang", "bytes"])
    x = np.frombuffer(b"".join(got["bytes"]), np.uint8).reshape(-1, WINDOW)
    y = np.searchsorted(np.array(langs), got["lang"].to_numpy(str))
    net = ByteGRU(len(langs), max(HIDDEN, len(langs) // 2))  # more languages take a larger state
    if len(langs) > 1:
        net.fit(x, got["n"].to_numpy(), y)
    return langs, net


def classify(texts: list, langs: list[str], net: ByteGRU | None) -> tuple[np.ndarray, np.ndarray]:
    """The language of each text, and the network's probability for it."""
    pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    own = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)]
    if own and net is not None:
        raw = [texts[i].encode("utf-8", "replace") for i in own]
        x, size, owner = windows(raw)
        total = np.zeros((len(own), len(langs)))
        for i in range(0, len(x), LANES):
            np.add.at(total, owner[i : i + LANES], net.pooled(x[i : i + LANES], size[i : i + LANES]))
        total /= np.array([len(t) for t in raw])[:, None]
        p = np.exp(total - total.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        pred[own], score[own] = np.array(langs, object)[p.argmax(1)], p.max(1)
    return pred, score


def predict(docs: DataFrame, langs: list[str], net: ByteGRU | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; the prediction reads nothing but the text."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_texts(rows, ["doc_id", "held_out"], "lang_pred string, score double", lambda texts: classify(texts, langs, net))


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, *train(docs))


def least_score(langs: list[str]) -> float:
    """The score under which the network can't tell: little more than that of a guess among the languages."""
    return OVER_CHANCE / len(langs) if len(langs) > 1 else 0.0


def accepted(docs: DataFrame, least: float | None = None) -> DataFrame:
    """The rows, with all their columns, whose text has a language: a letter, and a score of ``least``, by default that of
    ``least_score``.  Where nothing could be learned, as no row has a language, a letter is enough."""
    langs, net = train(docs)
    lowest = least_score(langs) if least is None else least

    def sure(texts: list) -> np.ndarray:
        if net is None:
            return np.array([t is not None and bool(_LETTER.search(t)) for t in texts], bool)
        pred, score = classify(texts, langs, net)
        return (pred != UNKNOWN) & (score >= lowest)

    return filter_texts(docs, sure)
