"""Removal of long repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a `length` = 200-byte string that covers it also starts anywhere else, in another text or in the same.

Dealing positions to buckets. Every start position p belongs to the anchor of its string: the `gram`-byte substring
with the least hash within p's 200 bytes (the leftmost of equals). Equal strings have equal anchors at equal offsets, so
only positions with one anchor value need comparing: an anchor value is a bucket of suffixes. Positions with one anchor
are neighbours, so a text falls into fragments, about one per 80 bytes, each a range of positions in one bucket.

  1. Each text yields its fragments: (anchor, digest of the fragment's bytes, doc, first position, positions). The digest
     is BLAKE2b of 128 bits under a random key of the run, so no input can be made to collide. Of the fragments that are
     equal within a task two go on, so a hot passage sends two rows per task; the others are settled as copies.
  2. Sorted by anchor and digest, of each kind of fragment the first two are kept for the sort and the further ones are
     settled as copies of them. A fragment alone in its bucket repeats nowhere and is dropped. What is left are buckets with
     several fragments.
  3. The bytes of those fragments are fetched and dealt by bucket. A task takes whole buckets up to a block of text and
     sorts them suffix bucket by suffix bucket: first by their next seven bytes, then, however long the tie, by the rank of
     the next cover sample. The cover is D = {0, 1, 3} modulo 7: any two positions reach samples at one common distance below
     seven, and the samples' ranks to 224 bytes are computed once for the block, by doubling. Neighbours in that order are
     compared byte by byte over 200 bytes.
  4. The spans join the texts again; what they cover is cut.

Hot buckets. A common phrase within ever different surroundings is one anchor with very many kinds of fragments. Such a
bucket is dealt again by classes of offsets: positions whose anchor lies 16 c to 16 c + 15 bytes on all cover the same 185
bytes around it, so equal strings have these bytes in common and anchor, class and their digest name a smaller bucket. If
that is still large, classes of one offset follow, whose 185 bytes are the whole 200, so that only equal strings are left
together. Buckets with more than HOT fragments are dealt so after step 2; those that a sample of SAMPLE texts shows to be
common are dealt so from the start, lest all their rows meet in one task of step 2. The sample decides how the work is dealt,
never the result. Memory is bounded by the block, by HOT and by one text with its spans.

Defined results: a null text is empty. Texts shorter than 200 bytes lose nothing. Cuts ignore character borders; the
kept text drops what is no longer UTF-8, the digest is of the bytes. Every row is a text of its own, also where ids
repeat or are null. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, join_small, numbered, slices, text_buffers
from docloom.llm.rolling import mix, prefix_sums, ranges, window_hashes

LENGTH = 200
GRAM = 40
#: Bytes that are hashed at a time.
CHUNK = 1 << 20
#: Bytes of fragments that a task sorts at a time; a larger bucket makes a block of its own.
BLOCK = 512 << 10
#: Fragments over which a bucket is dealt by classes of offsets, and how wide these are, one after the other.
HOT = 10_000
CLASSES = (16, 1)
#: Texts in the sample for common anchors, and the kinds of fragments there that make an anchor common.
SAMPLE, COMMON = 4_000, 12
#: Most anchors that are dealt so from the start; any others are found after step 2.
MOST_COMMON = 4_096
COVER, PERIOD = (0, 1, 3), 7
#: Bits of a key that orders by bucket, bytes and rank at once.
KEY_BITS = 63

def fragments(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, row, first position in the row, positions, anchor - first) of all rows' fragments.

    `raw` holds the rows' bytes one after the other. The fragments of a row cover its start positions without overlap.
    """
    n = len(raw)
    if n < length:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4))
    sums = prefix_sums(raw)
    grams = np.arange(n - gram + 1)
    hashes = window_hashes(sums, slice(0, n - gram + 1), slice(gram, n + 1))
    bits = np.uint64((1 << 24) - 1)  # positions of a chunk; what of the hash is left orders the grams everywhere alike
    keys = (hashes & ~bits) | grams.astype(np.uint64)
    width, have = length - gram + 1, 1
    least = keys
    while have * 2 <= width:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    anchor = (least & bits).astype(np.int64)  # of each start position 0 .. n - length
    valid = np.zeros(n - length + 1, bool)
    sizes = np.diff(offsets)
    for a, s in zip(offsets[:-1].tolist(), sizes.tolist(), strict=True):
        if s >= length:
            valid[a : a + s - length + 1] = True
    anchor[~valid] = -1
    cuts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
    first, after = cuts[:-1], cuts[1:]
    real = anchor[first] >= 0
    first, after = first[real], after[real]
    at = anchor[first]
    row = np.searchsorted(offsets, first, side="right") - 1
    return hashes[at], row, first - offsets[row], after - first, at - first


def _pieces_of(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Byte ranges (first row, last row, first byte, last byte) of about CHUNK bytes; longer rows are cut with overlap."""
    row, n = 0, len(offsets) - 1
    while row < n:
        size = offsets[row + 1] - offsets[row]
        if size > 2 * CHUNK:
            for a in range(0, int(size) - length + 1, CHUNK):
                yield row, row + 1, int(offsets[row]) + a, int(min(offsets[row] + a + CHUNK + length - 1, offsets[row + 1]))
            row += 1
            continue
        last = row
        while last < n and offsets[last + 1] - offsets[row] <= 2 * CHUNK:
            last += 1
        yield row, last, int(offsets[row]), int(offsets[last])
        row = last


def _merge(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans sorted by row and start, with touching and overlapping ones joined."""
    if not len(row):
        return row, first, last
    order = np.lexsort((first, row))
    row, first, last = row[order], first[order], last[order]
    big = int(last.max()) + 2
    reach = np.maximum.accumulate(row * big + last)  # rows are apart, so a row's spans never reach the next
    new = np.concatenate([[True], row[1:] * big + first[1:] > reach[:-1]])
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [len(row)]]) - 1
    return row[starts], first[starts], reach[ends] - row[starts] * big


def split(anchor: np.ndarray, first: np.ndarray, n: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(which fragment, first, positions, anchor - first, class) of fragments cut into classes of `width` offsets."""
    top = at // width
    count = top - (at - n + 1) // width + 1
    which = np.repeat(np.arange(len(n)), count)
    class_ = ranges(top - count + 1, count)
    begin = np.maximum(0, at[which] - class_ * width - width + 1)
    end = np.minimum(n[which] - 1, at[which] - class_ * width)
    return which, first[which] + begin, end - begin + 1, at[which] - begin, class_


def _digests(whole: memoryview, start: np.ndarray, end: np.ndarray, key: bytes) -> np.ndarray:
    """(n, 2) numbers: 128-bit digests of whole[start:end] under the key."""
    blake = hashlib.blake2b
    found = [blake(whole[a:b], digest_size=16, key=key).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def _keys(whole: memoryview, base: np.ndarray, found: tuple[np.ndarray, ...], anchor: np.ndarray, width: int, key: bytes) -> np.ndarray:
    """Names of the smaller buckets that `split` makes: by anchor, class, and the bytes that the class has in common. `base`
    is where each fragment's text begins."""
    which, first, _, at, class_ = found
    start = base + first + at - class_ * width
    common = _digests(whole, start, start + LENGTH - width + 1, key)[:, 0].view(np.uint64)
    return mix(anchor.view(np.uint64)[which] ^ mix((class_ + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + width))) ^ common


_FRAGMENTS = "route long, anchor long, whole long, other long, doc long, first long, n long, at int, done boolean"
_NAMES = ["route", "anchor", "whole", "other", "doc", "first", "n", "at", "done"]


def _thinned(anchor: np.ndarray, digest: np.ndarray, doc: np.ndarray, first: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of fragments: of each kind two, and merged spans (done) of the others."""
    if not len(anchor):
        return
    order = np.lexsort((digest[:, 1], digest[:, 0], anchor))
    a, d = anchor[order], digest[order]
    same = (a[1:] == a[:-1]) & (d[1:] == d[:-1]).all(axis=1)
    done = np.zeros(len(anchor), bool)
    done[order[2:][same[1:] & same[:-1]]] = True
    rows, at_row = np.unique(doc[done], return_inverse=True)
    srow, sfirst, slast = _merge(at_row, first[done], first[done] + n[done])
    keep, spans = ~done, len(srow)
    none = np.zeros(spans, np.int64)
    sdoc = rows[srow] if spans else none
    longs = [
        (anchor[keep].view(np.int64), mix(sdoc.astype(np.uint64)).view(np.int64)), (anchor[keep].view(np.int64), none), (digest[keep, 0], none),
        (digest[keep, 1], none), (doc[keep], sdoc), (first[keep], sfirst), (n[keep], slast - sfirst),
    ]
    cols = [*(np.concatenate(c) for c in longs), np.concatenate([at[keep], none]).astype(np.int32), np.arange(int(keep.sum()) + spans) >= int(keep.sum())]
    for i in range(0, len(cols[0]), 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 200_000]) for c in cols], names=_NAMES)


def _fragment_batches(key: bytes, common: np.ndarray):
    """Texts -> fragments; those with a common anchor by classes of offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            raw, offsets = text_buffers(batch.column("text"))
            docs = batch.column("row").to_numpy()
            whole = memoryview(raw)
            found = []
            for a, b, x, y in _pieces_of(offsets, LENGTH):
                local = np.clip(offsets[a : b + 1], x, y) - x
                anchor, row, first, n, at = fragments(raw[x:y], local)
                row, first = row + a, first + (x - int(offsets[a]) if b - a == 1 else 0)
                start = offsets[row] + first
                hot = np.isin(anchor, common) if len(common) else np.zeros(len(anchor), bool)
                if hot.any():
                    parts = split(anchor[hot], first[hot], n[hot], at[hot], CLASSES[0])
                    which, f, m, t, _ = parts
                    base = offsets[row[hot]][which]
                    found.append((_keys(whole, base, parts, anchor[hot], CLASSES[0], key), _digests(whole, base + f, base + f + m + LENGTH - 1, key), row[hot][which], f, m, t))
                    anchor, row, first, n, at, start = (c[~hot] for c in (anchor, row, first, n, at, start))
                found.append((anchor, _digests(whole, start, start + n + LENGTH - 1, key), row, first, n, at))
            if found:
                anchor, digest, row, first, n, at = (np.concatenate(c) for c in zip(*found, strict=True))
                yield from _thinned(anchor, digest, docs[row], first, n, at)

    return run


def _class_batches(key: bytes, width: int):
    """Rows (row, text, opened) -> their fragments by classes of offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            raw, offsets = text_buffers(batch.column("text"))
            row, anchor, first, n, at = _opened(batch)
            parts = split(anchor, first, n, at, width)
            which, f, m, t, _ = parts
            base, whole = offsets[row][which], memoryview(raw)
            names = _keys(whole, base, parts, anchor, width, key)
            yield from _thinned(names, _digests(whole, base + f, base + f + m + LENGTH - 1, key), batch.column("row").to_numpy()[row][which], f, m, t)

    return run


def _opened(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(which row of the batch, anchor, first, n, at) of all entries of the column `opened`."""
    opened = batch.column("opened")
    flat = opened.flatten()
    row = np.repeat(np.arange(len(opened)), opened.value_lengths().fill_null(0).to_numpy())
    return row, *(flat.field(c).to_numpy().astype(np.int64) for c in ("anchor", "first", "n", "at"))


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (anchor, kind) of their fragments, for the sample."""
    for batch in slices(batches, 8 << 20):
        raw, offsets = text_buffers(batch.column("text"))
        whole = memoryview(raw)
        for a, b, x, y in _pieces_of(offsets, LENGTH):
            anchor, row, first, n, _ = fragments(raw[x:y], np.clip(offsets[a : b + 1], x, y) - x)
            start = offsets[row + a] + first + (x - int(offsets[a]) if b - a == 1 else 0)
            kind = _digests(whole, start, start + n + LENGTH - 1, b"")[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(kind)], names=["anchor", "kind"])


def common_anchors(docs: DataFrame) -> np.ndarray:
    """Anchors with many kinds of fragments in a sample of about SAMPLE texts: at most MOST_COMMON numbers."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    some = docs.select("text").sample(share, 7).mapInArrow(_anchor_batches, "anchor long, kind long").distinct()
    counts = some.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") >= COMMON)
    found = counts.orderBy(F.desc("kinds"), "anchor").limit(MOST_COMMON).select("anchor").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64))


_SETTLED = "doc long, first long, n long, anchor long, at int, full boolean, open boolean"


def _settle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, whole, other) -> `open` rows, whose bytes are sorted and compared: the first two of each kind,
    and any that are not alone in their bucket; and `full` rows, further copies of a kind.

    The first two rows of the last kind are held back until the next kind shows whether their bucket has several.
    """
    names = ["anchor", "whole", "other", "doc", "first", "n", "at"]

    def emit(cols: tuple[np.ndarray, ...], full: np.ndarray, open_: np.ndarray) -> Iterator[pa.RecordBatch]:
        pick = full | open_
        if pick.any():
            anchor, _, _, doc, first, n, at = (c[pick] for c in cols)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(first), pa.array(n), pa.array(anchor), pa.array(at.astype(np.int32)), pa.array(full[pick]), pa.array(open_[pick])],
                names=["doc", "first", "n", "anchor", "at", "full", "open"],
            )

    held: tuple[np.ndarray, ...] | None = None
    several = False  # whether the held rows' bucket has another kind
    for batch in batches:
        cols = tuple(batch.column(c).to_numpy().astype(np.int64) for c in names)
        done = batch.column("done").to_numpy(zero_copy_only=False)
        if done.any():
            no = np.zeros(int(done.sum()), bool)
            yield from emit(tuple(c[done] for c in cols), ~no, no)
            cols = tuple(c[~done] for c in cols)
        if not len(cols[0]):
            continue
        if held is not None:
            cols = tuple(np.concatenate([h, c]) for h, c in zip(held, cols, strict=True))
        anchor, whole, other = cols[:3]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]) | (other[1:] != other[:-1])])
        heads = np.flatnonzero(new)
        kind = np.cumsum(new) - 1
        place = np.arange(len(anchor)) - heads[kind]
        bucket = np.concatenate([[0], np.cumsum(anchor[heads][1:] != anchor[heads][:-1])])
        multi = np.bincount(bucket)[bucket] > 1
        if several and held is not None:
            multi[bucket == 0] = True
        twice = np.diff(heads, append=len(anchor)) > 1
        full = place > 1
        open_ = ~full & (twice | multi)[kind]
        last = slice(heads[-1], min(heads[-1] + 2, len(anchor)))
        keep = np.ones(len(anchor), bool)
        keep[last] = False
        yield from emit(tuple(c[keep] for c in cols), full[keep], open_[keep])
        held, several = tuple(c[last] for c in cols), bool(multi[-1])
    if held is not None:
        n = len(held[0])
        yield from emit(held, np.zeros(n, bool), np.full(n, several or n > 1))


def _bytes_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, text, opened) -> one row per fragment with its bytes."""
    for batch in slices(batches, 8 << 20):
        raw, offsets = text_buffers(batch.column("text"))
        row, anchor, first, n, at = _opened(batch)
        docs, start, size = batch.column("row").to_numpy()[row], offsets[row] + first, n + LENGTH - 1
        for i in range(0, len(row), 20_000):
            part = slice(i, i + 20_000)
            data = raw[ranges(start[part], size[part])]
            ends = np.concatenate([[0], np.cumsum(size[part])]).astype(np.int32)
            content = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
            longs = [pa.array(c[part]) for c in (anchor, docs, first, n)]
            yield pa.RecordBatch.from_arrays([*longs, pa.array(at[part].astype(np.int32)), content], names=["anchor", "doc", "first", "n", "at", "content"])


class _Big:
    """Bytes whose next eight from any place on are read as one big-endian number, zeros following the last."""

    def __init__(self, raw: np.ndarray):
        self.at = np.ndarray(len(raw) + 1, ">u8", np.concatenate([raw, np.zeros(8, np.uint8)]), 0, (1,))

    def words(self, at: np.ndarray, n: int) -> np.ndarray:
        """The n = 1 .. 8 bytes at each place."""
        return self.at[at].astype(np.uint64) >> np.uint64(64 - 8 * n)


def _ranks(values: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal values having equal ranks."""
    order = np.argsort(values)
    ordered = values[order]
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(values)])
    return out


def cover_ranks(big: _Big, coordinate: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the cover samples by their next `depth` bytes at least (equal bytes, equal rank), at their positions.

    A sample is a position whose coordinate modulo 7 is in the cover. Its rank by 7 bytes is refined by doubling: the
    position 7, 14, 28, ... bytes on is a sample as well, or past the end (rank 0).
    """
    residue = coordinate % PERIOD
    where = np.flatnonzero((residue == COVER[0]) | (residue == COVER[1]) | (residue == COVER[2]))
    rank = np.zeros(len(coordinate) + depth * 2 + PERIOD, np.int64)
    rank[where] = _ranks(big.words(where, PERIOD))
    have = PERIOD
    while have < depth:
        rank[where] = _ranks(rank[where] * (len(where) + 1) + rank[where + have])
        have *= 2
    return rank


#: Bytes from a position of each residue to the next sample: three at most.
_REACH = np.array([min((d - r) % PERIOD for d in COVER) for r in range(PERIOD)])


def suffix_order(big: _Big, coordinate: np.ndarray, positions: np.ndarray, bucket: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Indices that sort `positions` by bucket and then by their next `depth` bytes.

    Coordinates must grow by one from byte to byte wherever compared strings lie. Where all positions of a bucket have one
    residue, the bytes before the next sample and that sample's rank order them. Otherwise ties over seven bytes are sorted
    by the rank of the first sample on the way, within each residue, and where a tie holds several residues, the residues'
    sorted lists are merged by comparisons at the distance that the cover gives for the pair.
    """
    if not len(positions):
        return np.zeros(0, np.int64)
    rank = cover_ranks(big, coordinate, depth)
    residue = coordinate[positions] % PERIOD
    later = rank[positions + _REACH[residue]]
    of_bucket = np.zeros(int(bucket.max()) + 1, residue.dtype)
    of_bucket[bucket] = residue
    if (of_bucket[bucket] == residue).all():
        before = big.words(positions, 3).astype(np.int64) >> (8 * (3 - _REACH[residue]))
        top = int(later.max()) + 1
        if (len(of_bucket) << 24) * top < 1 << KEY_BITS:
            return np.argsort((bucket << 24 | before) * top + later)
        return np.lexsort((before * top + later, bucket))
    head = big.words(positions, PERIOD)
    order = np.lexsort((later, residue, head, bucket))
    b, h, r = bucket[order], head[order], residue[order]
    tie = np.concatenate([[0], np.cumsum((b[1:] != b[:-1]) | (h[1:] != h[:-1]))])
    mixed = np.unique(tie[1:][(tie[1:] == tie[:-1]) & (r[1:] != r[:-1])])
    if len(mixed):
        from functools import cmp_to_key

        meet = [[min(d for d in range(PERIOD) if (x + d) % PERIOD in COVER and (y + d) % PERIOD in COVER) for y in range(PERIOD)] for x in range(PERIOD)]

        def compare(i: int, j: int) -> int:
            d = meet[int(residue[i])][int(residue[j])]  # fewer than seven bytes, which are equal
            return int(rank[positions[i] + d]) - int(rank[positions[j] + d])

        edges = np.searchsorted(tie, np.arange(tie[-1] + 2))
        for t in mixed.tolist():
            part = slice(edges[t], edges[t + 1])
            order[part] = sorted(order[part].tolist(), key=cmp_to_key(compare))
    return order


def repeated_positions(raw: np.ndarray, coordinate: np.ndarray, positions: np.ndarray, bucket: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which positions' `length`-byte strings are found at another position of the same bucket."""
    big = _Big(raw)
    order = suffix_order(big, coordinate, positions, bucket, length)
    p = positions[order]
    if len(p) < 2:
        return np.zeros(len(p), bool)
    live = np.flatnonzero(bucket[order][1:] == bucket[order][:-1])
    for k in range(0, length, 8):  # byte by byte, eight at a time
        shift = np.uint64(64 - 8 * min(8, length - k))
        live = live[(big.at[p[live] + k] ^ big.at[p[live + 1] + k]) >> shift == 0]
    out = np.zeros(len(p), bool)
    out[order[live]] = True
    out[order[live + 1]] = True
    return out


def _sort_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, doc, first, n, at, content) sorted by anchor -> spans (doc, first, last), block by block."""

    def block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        raw, offsets = text_buffers(rows.column("content").combine_chunks())
        anchor, doc, first, n, at = (rows.column(c).to_numpy().astype(np.int64) for c in ("anchor", "doc", "first", "n", "at"))
        size = np.diff(offsets)
        # coordinates count from a fragment's anchor, so equal strings have equal residues
        coordinate = np.arange(len(raw)) - np.repeat(offsets[:-1] + at, size) + PERIOD * LENGTH
        fragment = np.repeat(np.arange(len(n)), n)
        positions = ranges(offsets[:-1], n)
        ids = np.cumsum(np.concatenate([[0], anchor[1:] != anchor[:-1]]))
        # a suffix bucket: one anchor at one distance
        bucket = ids[fragment] * (2 * LENGTH) + (coordinate[positions] - PERIOD * LENGTH + LENGTH)
        hit = np.flatnonzero(repeated_positions(raw, coordinate, positions, bucket))
        p = positions[hit] - offsets[:-1][fragment[hit]] + first[fragment[hit]]
        order = np.argsort(doc[fragment[hit]], kind="stable")
        ids_, row = np.unique(doc[fragment[hit]][order], return_inverse=True)
        srow, sfirst, slast = _merge(row, p[order], p[order] + 1)
        if len(srow):
            yield pa.RecordBatch.from_arrays([pa.array(ids_[srow]), pa.array(sfirst), pa.array(slast - sfirst)], names=["doc", "first", "n"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column("content").nbytes
        if size < BLOCK:
            continue
        rows = pa.Table.from_batches(held)
        keys = rows.column("anchor").to_numpy()
        cut = int(np.searchsorted(np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])), np.count_nonzero(keys[1:] != keys[:-1])))
        if cut:
            yield from block(rows.slice(0, cut).combine_chunks())
            rest = rows.slice(cut).combine_chunks()
            held, size = rest.to_batches(), rest.nbytes
    if held:
        yield from block(pa.Table.from_batches(held).combine_chunks())


_RESULT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _cut_batches(with_text: bool):
    """Rows (row, text, spans of start positions) -> what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 32 << 20):
            yield cut(batch)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = text_buffers(batch.column("text"))
        opened = batch.column("spans")
        counts = opened.value_lengths().fill_null(0).to_numpy()
        flat = opened.flatten()
        row = np.repeat(np.arange(batch.num_rows), counts)
        first = flat.field("first").to_numpy() if len(row) else np.zeros(0, np.int64)
        n = flat.field("n").to_numpy() if len(row) else np.zeros(0, np.int64)
        srow, sfirst, slast = _merge(row, first, first + n + LENGTH - 1)
        spans = np.bincount(srow, minlength=batch.num_rows)
        removed = np.bincount(srow, (slast - sfirst).astype(float), minlength=batch.num_rows).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(spans)])
        digests, kept = [], []
        whole = raw.tobytes()
        for i in range(batch.num_rows):
            a, b = int(offsets[i]), int(offsets[i + 1])
            if spans[i]:
                parts, here = [], a
                for s, e in zip(sfirst[at[i] : at[i + 1]].tolist(), slast[at[i] : at[i + 1]].tolist(), strict=True):
                    parts.append(whole[here : a + s])
                    here = a + e
                left = b"".join([*parts, whole[here:b]])
            else:
                left = whole[a:b]
            digests.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode(errors="ignore") if with_text else None)
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans.astype(np.int64)), pa.array(digests), pa.array(kept, pa.string())],
            names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )

    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """(doc, first, n): runs of start positions whose strings repeat. `docs` has (row, text), row being unique."""
    key = secrets.token_bytes(16)  # the same in all tasks of this run, whenever they run

    def with_opened(rows: DataFrame) -> DataFrame:
        opened = rows.groupBy("doc").agg(F.collect_list(F.struct("first", "n", "anchor", "at")).alias("opened"))  # of one text
        return docs.join(opened.hint("merge"), docs.row == opened.doc).select("row", "text", "opened")

    found = docs.mapInArrow(_fragment_batches(key, common_anchors(docs)), _FRAGMENTS)
    spans, open_ = [], []
    for i, width in enumerate((*CLASSES, None)):
        dealt = found.repartition("route").sortWithinPartitions("route", "anchor", "whole", "other")
        settled = scratch.table(dealt.mapInArrow(_settle_batches, _SETTLED), f"settled{i}")
        spans.append(settled.where("full").select("doc", "first", "n"))
        rows = settled.where("open").drop("full", "open")
        large = scratch.table(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select("anchor", F.lit(True).alias("hot")), f"hot{i}")
        if width is None or large.isEmpty():
            open_.append(rows)
            break
        marked = scratch.table(join_small(rows, large, ["anchor"]), f"opened{i}")
        open_.append(marked.where("hot is null").drop("hot"))
        found = with_opened(marked.where("hot")).mapInArrow(_class_batches(key, width), _FRAGMENTS)
    pieces = with_opened(reduce(DataFrame.unionByName, open_)).mapInArrow(_bytes_batches, "anchor long, doc long, first long, n long, at int, content binary")
    sorted_ = pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_batches, "doc long, first long, n long")
    return reduce(DataFrame.union, [*spans, sorted_])


def without_repeats(docs: DataFrame, scratch: Scratch, with_text: bool) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row of `docs` (row, text); reads `scratch` later."""
    spans = scratch.table(repeated_spans(docs, scratch), "spans")
    per = spans.groupBy("doc").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    joined = docs.join(per.hint("merge"), F.col("row") == F.col("doc"), "left").select("row", "text", "spans")
    return joined.mapInArrow(_cut_batches(with_text), _RESULT)


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    rows, row = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scratch)
    cut = without_repeats(rows.select(F.col(row).alias("row"), "text"), scratch, False).drop("kept")
    out = cut.join(rows.select(F.col(row).alias("doc"), "doc_id"), "doc")
    return scratch.finish(out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with the repeated bytes cut from `text` and n_chars, if there, counted anew."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    rows, row = numbered(docs, scratch)
    cut = without_repeats(rows.select(F.col(row).alias("row"), "text"), scratch, True).select(F.col("doc").alias(row), F.col("kept").alias("text"))
    out = rows.drop("text").join(cut, row)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return scratch.finish(out.select(*docs.columns))
