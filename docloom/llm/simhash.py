"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint is the 64-bit majority of its word shingles' XXH64 values. Fingerprints link at `most` = 4 or fewer
differing bits; classes are the connected components of the links.

Candidates. The 64 bits form a ring of five segments. If two fingerprints differ in at most 4 bits, then from some
segment on every chain of l consecutive segments holds at most floor(4 l / 5) differences (0, 1, 2, 3, 4): the
pigeonring principle, stronger than the pigeonhole's single equal segment. So the pair agrees on that whole segment, and
on one half of the next one, because two halves share at most one difference. That is an equi-join key of about 20 bits,
ten per fingerprint. With many distinct fingerprints the key takes in the chain of three as well (one of the three
half segments that follow agrees: about 26 bits, thirty keys), so that random buckets stay small. Pairs in a bucket
must then pass every chain's budget, which ends with the full Hamming distance.

Skew. Equal fingerprints are one class before any pair is looked at, however many copies there are. A bucket is not
turned into pairs of rows: a task reads it as numbers and returns links that connect what belongs together (at most one
per member and bucket), comparing blocks in numpy; large buckets are first gathered around pivots.

Components are found by alternating star contractions over tables in the shared folder; nothing is collected.

Defined results: a null or empty text has fingerprint 0 and links like any other; fewer than four words make a single
shingle. Rows with equal ids are the same document: they get one component, and each row returns its own fingerprint. A
row with a null id gets the component of the documents with its very fingerprint, or null if there are none, and links
nothing. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_ROWS, Scratch, slices, texts_of

MOST = 4
SHINGLE = 4
#: Ring segments as (lowest bit, width).
RING = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
BUDGETS = tuple(MOST * n // len(RING) for n in range(1, len(RING) + 1))
#: From so many distinct fingerprints on, keys cover chains of three segments.
LONG_KEYS_FROM = 1 << 22
#: Buckets up to this size are compared in one block.
BLOCK = 1024
#: Rows of a node from which on it may be a hub.
HUB = 128


def fingerprints(texts: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints of whole texts."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.encode().lower().split()
        n = len(words)
        if n == 0:
            continue
        joined = b" ".join(words)
        if n <= shingle:
            hashes.append(digest(joined, 42))
            counts[i] = 1
            continue
        ends = list(accumulate([len(w) + 1 for w in words]))
        hashes += [digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[shingle - 1 :])]  # noqa: B905
        counts[i] = n - shingle + 1
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    values = np.array(hashes, np.uint64)
    ends = np.cumsum(counts[full])
    starts = ends - counts[full]
    ones = np.zeros((len(full), 64), np.int64)
    step = 1 << 17
    for a in range(0, len(values), step):  # in blocks, as bits take 64 bytes a shingle
        bits = np.unpackbits(values[a : a + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        inside = np.flatnonzero((ends > a) & (starts < a + step))
        cuts = np.maximum(starts[inside] - a, 0)
        ones[inside] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    set_bits = ones * 2 > counts[full][:, None]
    out[full] = np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4 << 20):
        fp = fingerprints(texts_of(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint's 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _bits(low: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col("fp"), low).bitwiseAND(F.lit((1 << width) - 1))


def _halves(segment: int) -> list[tuple[int, int]]:
    low, width = RING[segment % len(RING)]
    return [(low, width // 2), (low + width // 2, width - width // 2)]


def ring_keys(chain: int = 2) -> Column:
    """Array of join keys: the start segment whole, and one agreeing half per further chain link; the first byte of a
    key names the start and the halves that it holds."""
    keys = []
    for i, (low, width) in enumerate(RING):
        a, b = _halves(i + 1)
        picks = [[a], [b]] if chain == 2 else [[a, x] for x in (b, *_halves(i + 2))] + [[b, x] for x in (a, *_halves(i + 2))]
        for j, parts in enumerate(picks):
            key, at = F.lit((i << 3 | j) << 56).cast("long").bitwiseOR(_bits(low, width)), width
            for lo, wide in parts:
                key, at = key.bitwiseOR(F.shiftleft(_bits(lo, wide), at)), at + wide
            keys.append(key)
    return F.array(*keys)


_MASKS = np.array([[np.uint64(sum(((1 << w) - 1) << lo for lo, w in (RING[(i + k) % 5] for k in range(n)))) for n in range(1, 6)] for i in range(5)])


def chains_hold(diff: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether all chains from `start` stay within their budgets; the last chain is the whole ring."""
    good = np.ones(len(diff), bool)
    for n, budget in enumerate(BUDGETS):
        good &= np.bitwise_count(diff & _MASKS[start, n]) <= budget
    return good


class _Forest:
    """Union-find that remembers which unions joined something."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = x = p[p[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def bucket_links(fp: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links that connect what the pairs of one bucket connect, at most len(fp) - 1.

    Members near a pivot hang on it by a true link of their own. Members of different balls are compared only where
    the pivots are near enough for a link (the triangle inequality) and the balls aren't connected yet.
    """
    n, forest, out = len(fp), _Forest(len(fp)), []
    near = lambda x: np.bitwise_count(x) <= MOST

    def link(a: int, b: int) -> None:
        if forest.join(a, b):
            out.append((a, b))

    def block(left: np.ndarray, right: np.ndarray) -> None:
        for a in range(0, len(left), BLOCK):
            for b in range(0, len(right), BLOCK):
                x, y = left[a : a + BLOCK], right[b : b + BLOCK]
                hits = np.argwhere(near(fp[x][:, None] ^ fp[y][None, :]))
                for i, j in _spanning(hits, len(x), len(y)):
                    link(int(x[i]), int(y[j]))

    rest = np.arange(n)
    if n <= BLOCK:
        a, b = np.nonzero(np.triu(near(fp[:, None] ^ fp[None, :]), 1))
        ok = chains_hold(fp[a] ^ fp[b], np.full(len(a), start))
        for i, j in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
            link(i, j)
        return out
    balls: list[np.ndarray] = []
    while len(rest):
        inside = near(fp[rest] ^ fp[rest[0]])
        balls.append(rest[inside])
        for x in rest[inside][1:].tolist():
            link(int(rest[0]), x)
        rest = rest[~inside]
    pivots = fp[[b[0] for b in balls]]
    alone = np.array([len(b) == 1 for b in balls])
    for i, ball in enumerate(balls):
        far = np.bitwise_count(pivots[i + 1 :] ^ pivots[i])
        reach = MOST + (0 if alone[i] else MOST) + np.where(alone[i + 1 :], 0, MOST)
        for j in (np.flatnonzero(far <= reach) + i + 1).tolist():
            if forest.root(int(ball[0])) != forest.root(int(balls[j][0])):
                block(ball, balls[j])
    return out


def _spanning(hits: np.ndarray, n: int, m: int) -> list[tuple[int, int]]:
    """Few of many pairs that connect the same: pairs that join something in a forest of both sides."""
    forest, out = _Forest(n + m), []
    for i, j in hits.tolist():
        if forest.join(i, n + j):
            out.append((i, j))
    return out


def _small_links(keys: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys, all of at most BLOCK rows, run lengths mixed: compared at each distance."""
    run = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    start = (keys.view(np.uint64) >> np.uint64(59)).astype(np.int64)
    left, right, live, step = [], [], np.arange(len(keys)), 1
    while True:
        live = live[live + step < len(keys)]
        live = live[run[live] == run[live + step]]
        if not len(live):
            break
        good = live[chains_hold(fp[live] ^ fp[live + step], start[live])]
        left.append(rep[good])
        right.append(rep[good + step])
        step += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, rep) sorted by key -> links between representatives. Holds one bucket at most beside a batch."""

    def emit(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    def runs(keys: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        sizes = np.diff(cuts)
        small = np.repeat((sizes <= 32) & (sizes > 1), sizes)
        yield from emit(*_small_links(keys[small], fp[small], rep[small]))
        for i in np.flatnonzero(sizes > 32).tolist():
            part = slice(cuts[i], cuts[i + 1])
            pairs = np.array(bucket_links(fp[part], int(keys[cuts[i]]) >> 59), np.int64).reshape(-1, 2)
            yield from emit(rep[part][pairs[:, 0]], rep[part][pairs[:, 1]])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        cols = tuple(c.to_numpy(zero_copy_only=False) for c in (batch.column("key"), batch.column("fp"), batch.column("rep")))
        if not len(cols[0]):
            continue
        if held and cols[0][0] == held[-1][0][-1] == cols[0][-1]:
            held.append(cols)
            continue
        keys, fp, rep = (np.concatenate(x) for x in zip(*held, cols, strict=True))
        last = int(np.searchsorted(keys, keys[-1]))
        held = [(keys[last:], fp[last:], rep[last:])]
        if last:
            yield from runs(keys[:last], fp[:last].view(np.uint64), rep[:last])
    if held:
        keys, fp, rep = (np.concatenate(x) for x in zip(*held, strict=True))
        yield from runs(keys, fp.view(np.uint64), rep)


def links(classes: DataFrame, chain: int) -> DataFrame:
    """(a, b) links between the representatives of distinct fingerprints (fp, rep)."""
    keyed = classes.select(F.explode(ring_keys(chain)).alias("key"), "fp", "rep")
    return keyed.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_link_batches, "a long, b long")


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b), for every node that has an edge.

    Alternates large-star and small-star steps until no row changes. A step's minimum is an aggregation with map-side
    combine. The nodes with the most rows, hubs of HUB rows at least and at most BROADCAST_ROWS of them, get their minimum by
    broadcast, so a hub's rows stay where they are; any other node has fewer rows than each of those, or than HUB.
    """

    def star(pairs: DataFrame, larger: bool, name: str) -> DataFrame:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if larger:
            both = both.union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), f"{name}m")
        hubs = lowest.where(F.col("n") >= HUB).orderBy(F.desc("n"), "u").limit(BROADCAST_ROWS).select("u", "m")  # bounded
        marked = both.join(F.broadcast(hubs), "u", "left")
        hung = marked.where("m is not null").unionByName(marked.where("m is null").drop("m").join(lowest.select("u", "m").hint("merge"), "u"))
        if larger:
            moved = hung.where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            moved = hung.select(F.col("m").alias("a"), F.col("v").alias("b")).union(lowest.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return scratch.table(moved.where(F.col("a") < F.col("b")).distinct(), name)

    pairs = scratch.table(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}0")
    turn, n = 0, pairs.count()
    while n:
        turn += 1
        after = star(star(pairs, True, f"{name}{turn}l"), False, f"{name}{turn}")
        was, n = n, after.count()
        # both have distinct rows: as many rows, and none that is new, are the same rows
        if n == was and after.join(pairs, ["a", "b"], "left_anti").isEmpty():
            break
        pairs = after
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("root")).union(pairs.select(F.col("a"), F.col("a")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs (doc_id, text); the smallest id of a component names it."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.table(with_fingerprints(docs), "fp")
    of_fp = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    classes = scratch.table(of_fp.where("rep is not null"), "classes")
    same_id = marked.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y")
    twice = same_id.select("doc_id").join(marked, "doc_id").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    chain = 2 if classes.count() < LONG_KEYS_FROM else 3
    joined = components(links(classes, chain).union(twice), scratch)
    named = classes.join(joined, classes.rep == joined.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    out = marked.join(named.hint("merge"), "fp", "left")
    return scratch.finish(out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))
