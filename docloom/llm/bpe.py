"""Byte-level BPE by pre-token: token counts without ids, and ids through a cache of pre-tokens.

A byte-level BPE never merges across pre-tokens, so a text's tokens are those of its pre-tokens one after the other.
`pretokens` splits as the library does. Texts of ASCII and Latin letters go through one compiled pattern, which agrees
with the library's there; any other text is split by the library's own pre-tokenizer.

Token counts. Pass one counts pre-tokens over all texts (partial counts per task, then an aggregation). The library
encodes each distinct pre-token once. Pass two reads the texts again and joins per-document frequencies to the piece
counts: the frequent head, bounded to `head` pre-tokens by a cut taken from the counts' histogram, is broadcast and
summed on the spot; the rest goes through a shuffle join. Ids are never materialised.

Defined results: a null text is empty (0 bytes, 0 tokens). The special string is one token, as the library's default
has it. Every row gets its own count, also where ids repeat or are null. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, slices, texts_of
from docloom.llm.rolling import Words, distinct_spans, ranges

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The split pattern of GPT-2 style byte-level BPE, over texts of `_PLAIN` characters (fixed values).
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: ASCII without control characters other than tab and line ends, and the Latin letters up to U+017F.
_NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ſ]")
HEAD = 1 << 18


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    kind = type(tok.pre_tokenizer).__name__
    if kind != "ByteLevel" or tok.normalizer is not None or type(tok.model).__name__ != "BPE":
        raise ValueError(f"only byte-level BPE without a normalizer is supported, not {kind}")
    return tok


@lru_cache(maxsize=4)
def specials(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """The added tokens' pattern and ids; where they overlap, the leftmost longest counts."""
    ids = {t.content: i for i, t in tokenizer(path).get_added_tokens_decoder().items()}
    found = "|".join(re.escape(x) for x in sorted(ids, key=len, reverse=True))
    return (re.compile(f"({found})") if ids else None), ids


def pretokens(path: str, text: str) -> list[str]:
    """Pre-tokens of one text that has no special strings."""
    if not _NOT_PLAIN.search(text):
        return _SPLIT.findall(text)
    return [text[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(text)]


def units(path: str, text: str) -> list[str]:
    """Pre-tokens and special strings of one text, in order."""
    pattern, ids = specials(path)
    if pattern is None or not any(x in text for x in ids):
        return pretokens(path, text)
    out: list[str] = []
    for i, part in enumerate(pattern.split(text)):
        if i % 2:
            out.append(part)
        elif part:
            out += pretokens(path, part)
    return out


def piece_ids(path: str, distinct: list[str]) -> list[list[int]]:
    """The library's ids of each unit.

    Units of a space and what follows it split the same way when they stand in a row, so they are encoded as one text,
    whose word numbers tell the units apart; the others are encoded one by one.
    """
    tok = tokenizer(path)
    joins = [i for i, x in enumerate(distinct) if len(x) > 1 and x[0] == " " and not x[1].isspace()]
    others = list(set(range(len(distinct))).difference(joins))
    out: list[list[int]] = [[]] * len(distinct)
    for a in range(0, len(joins), 10_000):
        part = joins[a : a + 10_000]
        row = tok.encode("".join([distinct[i] for i in part]), add_special_tokens=False)
        words = np.array([-1 if w is None else w for w in row.word_ids])
        cuts = np.searchsorted(words, np.arange(len(part) + 1)).tolist()
        if words[0] or words[-1] != len(part) - 1:  # something was split otherwise, or is special
            others += part
            continue
        ids = row.ids
        for i, x, y in zip(part, cuts, cuts[1:]):  # noqa: B905
            out[i] = ids[x:y]
    for i, e in zip(others, tok.encode_batch([distinct[i] for i in others], add_special_tokens=False), strict=True):
        out[i] = e.ids
    return out


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["unit", "n"])
            seen.clear()
            return out

        for batch in slices(batches, 4 << 20):
            for text in texts_of(batch.column("text")):
                seen.update(units(path, text))
            if len(seen) > 400_000:
                yield flush()
        if seen:
            yield flush()

    return run


def _piece_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = piece_ids(path, batch.column("unit").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("unit"), batch.column("n"), pa.array([len(x) for x in ids], pa.int64())], names=["unit", "n", "pieces"]
            )

    return run


def unit_pieces(docs: DataFrame, path: str) -> DataFrame:
    """(unit, n, pieces): every distinct pre-token of all texts, how often it occurs, and how many pieces it has."""
    counts = docs.select("text").mapInArrow(_count_batches(path), "unit string, n long")
    return counts.groupBy("unit").agg(F.sum("n").alias("n")).mapInArrow(_piece_batches(path), "unit string, n long, pieces long")


def frequency_cut(table: DataFrame, most: int, n: str = "n") -> int:
    """The least frequency from which on at most `most` rows have it, from a histogram of at most some hundred rows."""
    step = F.floor(F.log2(F.col(n)) * 8)
    bars = {r["b"]: (r["rows"], r["low"]) for r in table.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("rows"), F.min(n).alias("low")).collect()}
    cut, total = 1 << 62, 0
    for b in sorted(bars, reverse=True):
        total += bars[b][0]
        if total > most:
            break
        cut = bars[b][1]
    return cut


def _frequency_batches(path: str, head):
    """Per row: one base row with the head's sum, and one row per distinct unit outside the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = head.value
        for batch in slices(batches, 4 << 20):
            rows, docs, unit, times, base, size = [], [], [], [], [], []
            for row, doc, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                total = 0
                for x, n in Counter(units(path, text)).items():
                    p = pieces.get(x)
                    if p is None:
                        rows.append(row)
                        docs.append(doc)
                        unit.append(x)
                        times.append(n)
                        base.append(0)
                        size.append(0)
                    else:
                        total += n * p
                rows.append(row)
                docs.append(doc)
                unit.append(f"\x00{row}")
                times.append(0)
                base.append(total)
                size.append(len(text.encode()))
            longs = [pa.array(x, pa.int64()) for x in (rows, docs, times, base, size)]
            yield pa.RecordBatch.from_arrays([*longs[:2], pa.array(unit, pa.string()), *longs[2:]], names=["row", "doc_id", "unit", "times", "base", "size"])

    return run


def token_counts(docs: DataFrame, path: str, most: int = 512, head: int = HEAD) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-counts")
    table = scratch.table(unit_pieces(docs, path), "pieces")
    cut = frequency_cut(table, head)
    # at most `head` rows
    known = table.where(F.col("n") >= cut).select("unit", "pieces").toArrow()
    shared = spark.sparkContext.broadcast(dict(zip(known.column(0).to_pylist(), known.column(1).to_pylist(), strict=True)))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = numbered.mapInArrow(_frequency_batches(path, shared), "row long, doc_id long, unit string, times long, base long, size long")
    rare = table.where(F.col("n") < cut).select("unit", "pieces")
    tokens = F.col("base") + F.col("times") * F.coalesce("pieces", F.lit(0))
    summed = rows.join(rare.hint("merge"), "unit", "left").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("size").alias("n_bytes"), F.sum(tokens).alias("n_tokens"))
    return scratch.finish(summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > most).alias("over_limit")))


#: Kinds of bytes in plain texts: 1 letters (also the bytes of the Latin letters beyond ASCII), 2 digits, 3 white space.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_KIND[[9, 10, 13, 32]] = 3
#: Bytes that send a text to the slow path: control characters, the apostrophe (contractions), other scripts.
_SLOW = np.ones(256, bool)
_SLOW[[9, 10, 13, *range(32, 127), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = False
_SLOW[39] = True


def plain_rows(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts `plain_spans` splits: no byte of _SLOW, no multiplication or division sign, nothing like a special string."""
    bad = _SLOW[raw]
    after = raw[1:]
    bad[:-1] |= (raw[:-1] == 0xC3) & ((after == 0x97) | (after == 0xB7)) | (raw[:-1] == 60) & (after == 124)
    total = np.concatenate([[0], np.cumsum(bad)])
    return total[offsets[1:]] == total[offsets[:-1]]


def plain_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, row) of the pre-tokens of plain texts, which the split pattern's runs of one kind give directly:
    a run takes one space before it; of white space before something else the last character stands alone."""
    kind = _KIND[raw]
    space = kind == 3
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    first = first[:-1]
    before, after = np.roll(kind, 1), np.concatenate([first[1:], [True]])
    next_solid = ~after & ~np.concatenate([space[1:], [True]])
    solid_start = ~space & (first | (before != kind) & ((before != 3) | (np.roll(raw, 1) != 32)))
    start = np.flatnonzero(solid_start | space & (first | (before != 3) | next_solid))
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, np.minimum(np.concatenate([start[1:], [len(raw)]]), offsets[row + 1]), row


class IdCache:
    """Ids of texts; each distinct pre-token is encoded once per `room`. Hashes only group equal pre-tokens, by distinct_spans."""

    kept: dict[str, IdCache] = {}

    @classmethod
    def of(cls, path: str) -> IdCache:
        """The worker process's own, which outlives a task."""
        return cls.kept.setdefault(path, cls(path))

    def __init__(self, path: str, room: int = 1_000_000):
        self.path, self.room = path, room
        self.kind = np.dtype("<u2") if tokenizer(path).get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 20, self.kind)
        self.start = np.zeros(1 << 16, np.int64)  # start[i] .. start[i + 1] are the ids of place i

    def _learn(self, units: list[bytes]) -> None:
        n, found = len(self.place), piece_ids(self.path, [x.decode() for x in units])
        sizes = np.array([len(x) for x in found], np.int64)
        if n + len(found) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(max(len(self.start), len(found)), np.int64)])
        at = int(self.start[n])
        total = int(sizes.sum())
        if at + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), self.kind)])
        self.ids[at : at + total] = np.fromiter((i for x in found for i in x), self.kind, total)
        self.start[n + 1 : n + 1 + len(found)] = at + np.cumsum(sizes)
        self.place.update(zip(units, range(n, n + len(found)), strict=True))

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text of a byte array with offsets."""
        out: list[np.ndarray] = [np.zeros(0, self.kind)] * (len(offsets) - 1)
        if not len(raw):
            return out
        plain = plain_rows(raw, offsets)
        for i in np.flatnonzero(~plain).tolist():
            text = raw[offsets[i] : offsets[i + 1]].tobytes().decode()
            split = units(self.path, text)
            ids = dict(zip(new := list(set(split)), piece_ids(self.path, new), strict=True))
            out[i] = np.array([x for u in split for x in ids[u]], self.kind)
        start, end, row = plain_spans(raw, offsets)
        keep = plain[row]
        if not keep.any():
            return out
        start, end, row = start[keep], end[keep], row[keep]
        at, which, _ = distinct_spans(Words(raw), start, end - start)
        if len(self.place) > self.room:
            self._clear()
        whole = raw.tobytes()
        listed = [whole[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        missing = [x for x in listed if x not in self.place]
        if missing:
            self._learn(missing)
        place = np.fromiter(map(self.place.__getitem__, listed), np.int64, len(listed))[which]
        sizes = self.start[place + 1] - self.start[place]
        flat = self.ids[ranges(self.start[place], sizes)]
        ends = np.cumsum(np.bincount(row, sizes, minlength=len(plain)).astype(np.int64))
        for i in np.flatnonzero(plain).tolist():
            out[i] = flat[ends[i - 1] if i else 0 : ends[i]]
        return out
