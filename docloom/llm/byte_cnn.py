"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes. `filters` learned filters of `width` bytes slide over every byte of the whole text. A filter's
answer at a place is a sum of one table entry per byte under it, and one for whether the eight bytes there occurred
before in the text, so that repetition can be seen by a filter. The text is cut into chunks of 512 bytes that overlap by
half; each filter is max-pooled over each chunk. The mean and the maximum over the chunks go through one logistic unit,
which gives the probability that the text is of good quality. Max-pooling makes training cheap: the gradient goes to the
one place per chunk and filter that won.

The network is fitted on the driver to a bounded sample: at most `sample` labelled rows (whole texts of at most
`longest` bytes each and `sample_bytes` in all; rows in the order of a hash of their id, as many good ones as bad where there
are enough). It is then sent to the tasks and scores every row. Only the text goes into a score; labels, lang, source and
ids never do.

A text of more than LONG bytes is scored in parts: filters are pooled block by block anyway, and whether eight bytes occurred
before is settled for one class of hashes after the other. Memory holds the text, two bytes for each of its bytes, and arrays
of some hundred bytes for each byte of a part.

Defined results: a null or empty text is scored like any other, as one chunk of padding. Every row gives one row, also
where ids repeat or are null (a null id is not held out). Of rows with one labelled id the least text is learned, of several
labels the greatest. No usable labels, or labels of one kind only: the network is
not fitted and every score is the share of good labels, or 0.5. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import slices, text_buffers

HOP = 256
WIDTH = 6
FILTERS = 16
GRAM = 8
#: Places that the filters are applied to at a time: what they answer stays in the processor's cache.
BLOCK = 32 * HOP
#: Bytes over which a text is scored in parts, and bytes of a part.
LONG = 4 << 20


@dataclass
class Laid:
    """Texts laid out one after the other, each padded with 0 to whole hops and at least WIDTH - 1 bytes."""

    symbols: np.ndarray
    echo: np.ndarray
    hops: np.ndarray  # of each text
    ends: np.ndarray  # places whose window would leave the text


def _grams(raw: np.ndarray, n: int) -> np.ndarray:
    """44 bits of a hash of the eight bytes at each of the first n places; past the end there are zeros."""
    words = np.zeros(n, np.uint64)
    padded = np.concatenate([raw, np.zeros(GRAM, np.uint8)])
    for k in range(GRAM):
        words = words << np.uint64(8) | padded[k : k + n]
    return (words ^ (words >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)


def _echoes(raw: np.ndarray, row: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether the eight bytes at each place stand earlier in the same text."""
    n = len(raw)
    out = np.zeros(n, np.uint8)
    if n < GRAM:
        return out
    # a text's number and the hash in one key, so that one sort does; a slice holds fewer than 2^20 texts
    key = row.astype(np.uint64) << np.uint64(44) | _grams(raw, n)
    order = np.argsort(key, kind="stable")
    key = key[order]
    out[order[1:][key[1:] == key[:-1]]] = 1
    last = np.repeat(offsets[1:], np.diff(offsets))
    out[np.arange(n) + GRAM > last] = 0
    return out


def _long_echoes(raw: np.ndarray, part: int) -> np.ndarray:
    """`_echoes` of one text, by classes of hashes: each pass over the text sorts what falls into its class."""
    n = len(raw)
    out = np.zeros(n, np.uint8)
    classes = -(-n // part)
    for c in range(classes):
        keys, places = [], []
        for a in range(0, n, part):
            key = _grams(raw[a : a + part + GRAM], min(part, n - a))
            mine = np.flatnonzero(key % np.uint64(classes) == c)
            keys.append(key[mine])
            places.append(mine + a)
        key, place = np.concatenate(keys), np.concatenate(places)
        order = np.argsort(key, kind="stable")
        key = key[order]
        out[place[order[1:][key[1:] == key[:-1]]]] = 1
    out[max(0, n - GRAM + 1) :] = 0
    return out


def lay(raw: np.ndarray, offsets: np.ndarray, long: int = LONG) -> Laid:
    sizes = np.diff(offsets)
    hops = np.maximum(1, -(-(sizes + WIDTH - 1) // HOP))
    base = np.concatenate([[0], np.cumsum(hops * HOP)])
    symbols, echo = np.zeros(int(base[-1]), np.uint8), np.zeros(int(base[-1]), np.uint8)
    if len(sizes) == 1 and sizes[0] > long:
        symbols[: len(raw)] = raw
        echo[: len(raw)] = _long_echoes(raw, long)
    else:
        row = np.repeat(np.arange(len(sizes)), sizes)
        to = np.arange(len(raw)) + (base[:-1] - offsets[:-1])[row]
        symbols[to] = raw
        echo[to] = _echoes(raw, row, offsets)
    ends = (base[1:, None] - np.arange(WIDTH - 1, 0, -1)[None, :]).ravel()
    return Laid(symbols, echo, hops, ends)


@dataclass
class Net:
    tables: np.ndarray  # (WIDTH, 256, FILTERS)
    echo: np.ndarray  # (2, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS + 1,): of the mean, of the maximum, constant

    @classmethod
    def start(cls, seed: int) -> Net:
        rng = np.random.default_rng(seed)
        tables = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        tables[:, 0] = 0
        weights = np.zeros(2 * FILTERS + 1, np.float32)
        weights[:-1] = rng.normal(0, 0.2, 2 * FILTERS)
        return cls(tables, np.zeros((2, FILTERS), np.float32), np.zeros(FILTERS, np.float32), weights)

    def parts(self) -> list[np.ndarray]:
        return [self.tables, self.echo, self.bias, self.weights]

    def answers(self, symbols: np.ndarray, echo: np.ndarray, first: int, last: int, ends: np.ndarray, out: np.ndarray, held: np.ndarray) -> np.ndarray:
        """(places, filters) of the places first .. last before pooling, in `out`; `ends` in order leave their text."""
        out, n = out[: last - first], len(symbols)
        np.take(self.echo + self.bias, echo[first:last], axis=0, out=out, mode="clip")
        for j in range(WIDTH):
            size = min(last + j, n) - first - j
            np.take(self.tables[j], symbols[first + j : first + j + size], axis=0, out=held[:size], mode="clip")
            out[:size] += held[:size]
        a, b = np.searchsorted(ends, (first, last))
        out[ends[a:b] - first] = -np.inf
        return out

    def blocks(self, x: Laid) -> Iterator[tuple[int, np.ndarray]]:
        """(first hop, answers by hop) of one block after the other; the arrays are used again."""
        out, held = (np.empty((BLOCK, self.bias.shape[0]), np.float32) for _ in range(2))
        for a in range(0, len(x.symbols), BLOCK):
            b = min(a + BLOCK, len(x.symbols))
            yield a // HOP, self.answers(x.symbols, x.echo, a, b, x.ends, out, held).reshape(-1, HOP, out.shape[1])

    def pooled(self, x: Laid) -> tuple[np.ndarray, np.ndarray]:
        """(chunks, filters) after pooling and rectifying, and each text's number of chunks."""
        by_hop = np.empty((len(x.symbols) // HOP, self.bias.shape[0]), np.float32)
        for hop, answers in self.blocks(x):
            answers.max(axis=1, out=by_hop[hop : hop + len(answers)])
        firsts, chunks = _chunks(x.hops)
        return np.maximum(np.maximum(by_hop[firsts[0]], by_hop[firsts[1]]), 0), chunks

    def score(self, x: Laid) -> np.ndarray:
        h, chunks = self.pooled(x)
        return _sigmoid(_joined(h, chunks)[0] @ self.weights)


def _chunks(hops: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """First and second hop of each chunk, and each text's number of chunks; a text of one hop is one chunk."""
    chunks = np.maximum(hops - 1, 1)
    base = np.concatenate([[0], np.cumsum(hops)[:-1]])
    at = np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks) + np.repeat(base, chunks)
    return (at, at + np.repeat((hops > 1).astype(np.int64), chunks)), chunks


def _joined(h: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the mean and maximum over its chunks and a one; and which chunk each maximum is from."""
    starts = np.cumsum(chunks) - chunks
    top = np.maximum.reduceat(h, starts, axis=0)
    mean = np.add.reduceat(h, starts, axis=0) / chunks[:, None]
    return np.concatenate([mean, top, np.ones((len(chunks), 1), h.dtype)], axis=1).astype(np.float32), top


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gradients(net: Net, x: Laid, good: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Weighted mean cross-entropy and its gradients, in the order of Net.parts."""
    n, f = len(x.symbols) // HOP, net.bias.shape[0]
    place, by_hop = np.empty((n, f), np.int64), np.empty((n, f), np.float32)
    for at, answers in net.blocks(x):
        here = slice(at, at + len(answers))
        answers.argmax(axis=1, out=place[here])
        answers.max(axis=1, out=by_hop[here])
    (a, b), chunks = _chunks(x.hops)
    second = by_hop[b] > by_hop[a]
    raw = np.where(second, by_hop[b], by_hop[a])
    h = np.maximum(raw, 0)
    z, top = _joined(h, chunks)
    p = _sigmoid(z @ net.weights)
    loss = float(-(weight * np.where(good == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9))).sum() / weight.sum())
    d = (weight * (p - good) / weight.sum()).astype(np.float32)
    g_weights = z.T @ d
    text = np.repeat(np.arange(len(chunks)), chunks)
    share = d[:, None] * net.weights[None, :f] / chunks[:, None]
    g_h = share[text]
    is_top = h == top[text]
    starts = np.cumsum(chunks) - chunks
    ties = np.add.reduceat(is_top.astype(np.float32), starts, axis=0)
    g_h = g_h + is_top * (d[:, None] * net.weights[None, f : 2 * f] / ties)[text]
    g_h = g_h * (raw > 0)
    hop = np.where(second, b[:, None], a[:, None])
    filt = np.broadcast_to(np.arange(f), hop.shape)
    at = (hop * HOP + place[hop, filt]).ravel()
    g, filt = g_h.ravel(), filt.ravel()
    live = np.flatnonzero(g)
    at, g, filt = at[live], g[live].astype(np.float64), filt[live]
    g_tables = np.zeros_like(net.tables)
    for j in range(WIDTH):
        g_tables[j] = np.bincount(x.symbols[np.minimum(at + j, len(x.symbols) - 1)].astype(np.int64) * f + filt, g, minlength=256 * f).reshape(256, f)
    g_tables[:, 0] = 0
    g_echo = np.bincount(x.echo[at].astype(np.int64) * f + filt, g, minlength=2 * f).reshape(2, f).astype(np.float32)
    g_echo[0] = 0
    return loss, [g_tables, g_echo, np.bincount(filt, g, minlength=f).astype(np.float32), g_weights.astype(np.float32)]


def fit(texts: list[bytes], good: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Net:
    """Adam on balanced classes."""
    net, rng = Net.start(seed), np.random.default_rng(seed)
    weight = np.where(good == 1, 0.5 / max(1, (good == 1).sum()), 0.5 / max(1, (good == 0).sum())) * len(good)
    first, second = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    step, turns = 0, -(-len(texts) // batch) * epochs
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            sizes = np.array([len(texts[k]) for k in pick])
            raw = np.frombuffer(b"".join(texts[k] for k in pick), np.uint8)
            _, grads = gradients(net, lay(raw, np.concatenate([[0], np.cumsum(sizes)])), good[pick], weight[pick])
            step += 1
            now = rate * (1 - 0.9 * step / turns)
            for p, g, m, v in zip(net.parts(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: str, sample: int, sample_bytes: int, longest: int) -> tuple[list[bytes], np.ndarray]:
    """At most `sample` whole texts of at most `longest` bytes with their labels, half of each kind where there are enough."""
    marks = labels.where("quality in (0, 1)").where(F.expr(learn)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marks = marks.withColumn("order", F.xxhash64("doc_id"))
    some = marks.where("quality = 1").orderBy("order").limit(sample // 2).union(marks.where("quality = 0").orderBy("order").limit(sample // 2))
    # bounded by `sample` rows of ids, so they may be broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= longest).join(F.broadcast(some), "doc_id")
    one = rows.groupBy("doc_id", "order", "quality").agg(F.min("text").alias("text"))
    texts, good, total = [], [], 0
    for r in one.orderBy("order").toLocalIterator():
        text = r["text"].encode()
        if total + len(text) > sample_bytes:
            break
        total += len(text)
        texts.append(text)
        good.append(r["quality"])
    return texts, np.array(good)


def score_texts(docs: DataFrame, labels: DataFrame, learn: str = "crc32(cast(doc_id as string)) % 5 <> 0", sample: int = 3000, sample_bytes: int = 16 << 20, longest: int = 1 << 20) -> DataFrame:
    """(doc_id, score) of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    texts, good = labelled_sample(docs, labels, learn, sample, sample_bytes, longest)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if len(set(good.tolist())) < 2:
        return rows.select("doc_id", F.lit(float(good.mean()) if len(good) else 0.5).alias("score"))
    net = spark.sparkContext.broadcast(fit(texts, good))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            score = net.value.score(lay(*text_buffers(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score.astype(np.float64))], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted); rows whose crc32(doc_id) is a multiple of 5 are held out of learning."""
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False))
    return score_texts(docs, labels).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
