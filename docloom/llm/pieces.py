"""SentencePiece encoding and decoding over a relational lattice.

Units. A text is normalised as the model says (a leading space, spaces as U+2581) and cut wherever no piece can reach
across: between two characters that stand next to each other in no piece. That is before every space, around punctuation
that no piece joins, and inside odd words. Encoding a text is encoding its units one after the other, and equal units
encode alike. Cutting, counting and looking up are done in numpy: units are grouped by 64-bit keys and then compared.

Lattice. The distinct units are a table. Their substrings of bounded length are exploded and equi-joined to the piece
table (one row per piece of the vocabulary; broadcast if that has at most VOCABULARY rows); the matches are a unit's edges.
Edges are grouped by unit, which is how the table is partitioned already, and folded with the higher-order function
`aggregate`:

  * unigram models: Viterbi. The fold goes over end positions and keeps the best score and the last edge of each.
  * BPE models: the fold replays the merges. Its state is a bit mask of the borders between segments; each step takes,
    of the edges that join exactly two neighbouring segments, the one with the best score (the leftmost of equals).

The Viterbi path over a BPE model's scores, which are merge ranks, is not what SentencePiece returns for it, so the
model's own type decides. Characters without a piece fall back to bytes. Units of more than `LONGEST` characters (the
mask is a long) are encoded by the library.

Texts. The frequent units, at most `head` by a cut from the counts' histogram, go to all tasks. The others are joined to
the input partitions that hold them, a row per unit and partition, and written to one folder for each partition, which that
partition's task reads back: the texts themselves are never shuffled, and no row grows with the number of partitions. The
input is read twice with the same partitions; a unit that is in neither place (a partition was cut otherwise) is encoded by
the library.

A text is worked through in parts of about SLICE characters, cut before spaces, so memory holds one text, its ids, and some
hundred bytes for each character of a part (a longer run without a space is one part).

Defined results: a null or empty text has no pieces. Every row gives one row, also where ids repeat or are null. U+2581
in a text decodes to a space, as in the library. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.bpe import frequency_cut
from docloom.llm.common import Scratch, let, settings, slices, spans_of_bytes, text_buffers, texts_of
from docloom.llm.rolling import Words, distinct_spans, ranges

SPACE = "▁"
#: Characters of a unit that the fold takes: borders are the bits of a long.
LONGEST = 60
HEAD = 1 << 18
#: A vocabulary of at most so many pieces is broadcast.
VOCABULARY = 1 << 18
#: Characters of a piece by which the lengths of pieces are looked up.
HEADS = 3
#: Files that the units of one input partition are dealt to at most.
FILES = 8
#: Bytes of text that a task works on at a time; the arrays take some hundred bytes for each.
SLICE = 1 << 19
#: Code points below this are looked up in a table of pairs.
LOW = 0x180
#: So many groups of a task are held in memory before Spark turns to sorting them.
_IN_MEMORY = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"


@dataclass
class Model:
    processor: object
    unigram: bool
    #: piece -> (id, score), without control, unknown and byte pieces
    pieces: dict[str, tuple[int, float]]
    #: id of the byte piece of each byte, or -1
    byte_ids: list[int]
    unknown: int
    prefix: bool
    spell: list[bytes]
    #: pairs of neighbouring characters in pieces, x << 21 | y, sorted; and a table of those of low code points
    pairs: np.ndarray
    low: np.ndarray

    @property
    def longest_piece(self) -> int:
        return max(map(len, self.pieces), default=1)

    @property
    def merges_unknown(self) -> bool:
        """Without byte pieces a run of unknown characters is one unknown piece, as in the library."""
        return min(self.byte_ids) < 0

    def parts(self, texts: list[str], most: int = SLICE) -> tuple[list[str], list[int]]:
        """Normalised texts cut into parts of about `most` characters, before spaces, which no piece reaches across; and the
        text of each part."""
        out, row = [], []
        for i, text in enumerate(texts):
            a, lead = 0, SPACE if self.prefix and text else ""
            while a < len(text):
                b = len(text)
                if b - a > most:
                    cut = text.rfind(" ", a + 1, a + most)
                    b = cut if cut > 0 else text.find(" ", a + most) % (len(text) + 1)
                out.append(lead + text[a:b].replace(" ", SPACE))
                row.append(i)
                a, lead = b, ""
        return out, row

    def split(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(code points of all parts, first and end of each unit, its part)."""
        points = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        cut = np.ones(len(points) + 1, bool)
        if len(points) > 1:
            small = np.where(points < LOW, points, np.where(points == ord(SPACE), LOW, LOW + 1)).astype(np.int64)
            joined = self.low[small[:-1], small[1:]]
            other = np.flatnonzero((small[:-1] > LOW) | (small[1:] > LOW))
            if len(self.pairs):
                code = points[other].astype(np.int64) << 21 | points[other + 1]
                at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
                joined[other] = self.pairs[at] == code
            cut[1:-1] = ~joined
        cut[offsets] = True
        start = np.flatnonzero(cut[:-1])
        part = np.searchsorted(offsets, start, side="right") - 1
        return points, start, np.concatenate([start[1:], [len(points)]])[: len(start)], part

    def by_library(self, unit: str) -> list[int]:
        """The library's ids of one unit, without the leading space that it would add to a text."""
        return self.processor.encode(unit)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or proto.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models with the identity normaliser are supported")
    pieces, byte_ids, spell, unknown = {}, [-1] * 256, [], 0
    for i, p in enumerate(proto.pieces):
        spell.append(p.piece.encode())
        if p.type == p.BYTE:
            byte_ids[int(p.piece[1:-1], 16)] = i
            spell[i] = bytes([int(p.piece[1:-1], 16)])
        elif p.type == p.UNKNOWN:
            unknown, spell[i] = i, " ⁇ ".encode()
        elif p.type == p.CONTROL:
            spell[i] = b""
        elif p.type == p.NORMAL:
            pieces[p.piece] = (i, p.score)
        else:
            raise ValueError("user-defined and unused pieces are not supported")
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("a piece reaches across a space")
    found = {(ord(x), ord(y)) for p in pieces for x, y in zip(p, p[1:])}  # noqa: B905
    pairs = np.array(sorted(x << 21 | y for x, y in found), np.int64)
    place = lambda x: x if x < LOW else LOW if x == ord(SPACE) else None
    low = np.zeros((LOW + 2, LOW + 2), bool)
    for x, y in found:
        if place(x) is not None and place(y) is not None:
            low[place(x), place(y)] = True
    norm.add_dummy_prefix, prefix = False, norm.add_dummy_prefix  # units have theirs already
    processor = SentencePieceProcessor(model_proto=proto.SerializeToString())
    return Model(processor, proto.trainer_spec.model_type == 1, pieces, byte_ids, unknown, prefix, spell, pairs, low)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id, rank, score): one row per piece; rank 0 has the best score, ties by id."""
    found = model(path).pieces
    order = sorted(found, key=lambda p: (-found[p][1], found[p][0]))
    return spark.createDataFrame([(p, found[p][0], r, float(found[p][1])) for r, p in enumerate(order)], "piece string, id int, rank long, score double")


#: An edge is a long: rank, start, length and id, so that edges in ascending order are the best first.
_START, _SIZE, _ID = 26, 20, (1 << 20) - 1


def _start(e: Column) -> Column:
    return F.shiftright(e, _START).bitwiseAND(F.lit(63))


def _size(e: Column) -> Column:
    return F.shiftright(e, _SIZE).bitwiseAND(F.lit(63))


def lattice(units: DataFrame, pieces: DataFrame, longest: int, small: bool = True) -> DataFrame:
    """`units` (unit, ...) with `edges`, the pieces found in each unit, the best score first: (edge, score). `small` says that
    the piece table may be broadcast; then only substrings as long as some piece that starts with the same HEADS characters
    are made."""
    n = F.length("unit")
    starts = units.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    every = F.sequence(F.lit(1), F.least(n - F.col("i"), F.lit(longest)))
    if small:
        heads = pieces.where(F.length("piece") >= HEADS).groupBy(F.substring("piece", 1, HEADS).alias("start")).agg(F.collect_set(F.length("piece")).alias("sizes"))
        starts = starts.withColumn("start", F.substring(F.col("unit"), F.col("i") + 1, F.lit(HEADS))).join(F.broadcast(heads), "start", "left")
        own = F.filter(F.coalesce("sizes", F.array().cast("array<int>")), lambda k: k <= n - F.col("i"))
        every = F.concat(F.sequence(F.lit(1), F.least(n - F.col("i"), F.lit(HEADS - 1))), own)
    cut = starts.withColumn("k", F.explode(every))
    # the other columns ride on the first character's row alone, which is kept even without a piece
    keys = [c for c in units.columns if c != "unit"]
    lead = (F.col("i") == 0) & (F.col("k") == 1)
    cut = cut.select("unit", *[F.when(lead, F.col(c)).alias(c) for c in keys], "i", "k", F.substring(F.col("unit"), F.col("i") + 1, F.col("k")).alias("piece"))
    found = cut.join(F.broadcast(pieces) if small else pieces.hint("merge"), "piece", "left").where(F.col("id").isNotNull() | lead)
    shift = lambda c, by: F.shiftleft(F.col(c).cast("long"), by)
    edge = shift("rank", 32).bitwiseOR(shift("i", _START)).bitwiseOR(shift("k", _SIZE)).bitwiseOR(F.col("id").cast("long"))
    both = F.struct(edge.alias("edge"), F.col("score").alias("score")) if "score" in pieces.columns else edge
    listed = F.collect_list(F.when(F.col("id").isNotNull(), both))
    return found.groupBy("unit").agg(*[F.first(c, ignorenulls=True).alias(c) for c in keys], F.sort_array(listed).alias("edges"))


def _bits(low: Column, high: Column) -> Column:
    """A long with the bits low .. high - 1 set."""
    power = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))
    return power(high) - power(low)


def _borders(e: Column) -> tuple[Column, Column]:
    """Masks of an edge: its two ends, and what lies between."""
    a, b = _start(e), _start(e) + _size(e)
    return _bits(a, a + 1) + _bits(b, b + 1), _bits(a + 1, b)


def masks(edges: Column) -> Column:
    """Each edge's masks, and its start and id as `key`."""
    key = lambda e: F.shiftleft(_start(e), 20).bitwiseOR(e.bitwiseAND(F.lit(_ID)))
    return F.transform(edges, lambda e: F.struct(*(x.alias(name) for x, name in zip((*_borders(e), key(e)), ("ends", "inside", "key"), strict=True))))


def bpe_borders(edges: Column, n: Column) -> Column:
    """Mask of segment borders (bits 0 .. n) after all merges; `edges` are masks. The sign bit is set when nothing merges any
    more, and then no edge is looked at."""
    done = F.lit(-(1 << 63))

    def merge(borders: Column, e: Column) -> Column:
        fits = lambda x: (F.bit_count(borders.bitwiseAND(x["inside"])) == 1) & (borders.bitwiseAND(x["ends"]) == x["ends"])
        best = F.get(F.filter(e, fits), F.lit(0))["inside"]
        return F.when(borders < 0, borders).otherwise(F.coalesce(borders - borders.bitwiseAND(best), borders.bitwiseOR(done)))

    whole = _bits(F.lit(0), n + 1)
    steps = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    longer = F.filter(edges, lambda x: x["inside"] != 0)
    return let(longer, lambda e: F.when(F.size(e) == 0, whole).otherwise(F.aggregate(steps, whole, lambda b, _: merge(b, e), lambda b: b.bitwiseAND(F.lit((1 << 63) - 1)))))


def viterbi_borders(edges: Column, n: Column, unknown_score: float) -> Column:
    """Mask of the borders of the best path over edges with scores; a character without a piece costs `unknown_score`. Of
    equally good paths the one with the longer last piece is taken."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("mask")))

    def step(best: Column, end: Column, e: Column) -> Column:
        into = F.filter(e, lambda x: _start(x["edge"]) + _size(x["edge"]) == end)
        at = lambda i: F.get(best, i.cast("int"))
        ways = F.transform(into, lambda x: F.struct((at(_start(x["edge"]))["score"] + x["score"]).alias("score"), (-_start(x["edge"])).alias("back")))
        alone = F.struct((at(end - 1)["score"] + F.lit(unknown_score)).alias("score"), (-(end - 1)).cast("long").alias("back"))
        way = F.when(F.exists(into, lambda x: _size(x["edge"]) == 1), F.array_max(ways)).otherwise(F.array_max(F.array_append(ways, alone)))
        grown = lambda w: F.struct(w["score"].alias("score"), (at(-w["back"])["mask"] + _bits(end, end + 1)).alias("mask"))
        return F.concat(best, F.transform(F.array(way), grown))

    return let(edges, lambda e: F.aggregate(F.sequence(F.lit(1), n), start, lambda b, x: step(b, x, e), lambda b: F.get(b, n)["mask"]))


def unit_ids(unit: Column, edges: Column, mask: Column, byte_ids: list[int], unknown: int) -> Column:
    """Ids of the segments between the borders of `mask`; a segment without a piece is one character, in bytes or unknown."""
    n = F.length(unit)
    fallback = F.array(*[F.lit(b) for b in byte_ids])
    id_of = lambda e: e["key"].bitwiseAND(F.lit(_ID)).cast("int")

    def spelled(a: Column) -> Column:
        code = F.hex(F.encode(F.substring(unit, a + 1, F.lit(1)), "UTF-8"))
        if min(byte_ids) < 0:
            return F.array(F.lit(unknown))
        return F.transform(F.sequence(F.lit(0), (F.length(code) / 2 - 1).cast("int")), lambda i: F.get(fallback, F.conv(F.substring(code, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int")))

    def segment(cuts: Column, k: Column) -> Column:
        a, b = F.get(cuts, k), F.get(cuts, k + 1)
        known = F.filter(edges, lambda e: e["ends"] == _bits(a, a + 1) + _bits(b, b + 1))
        return F.when(F.size(known) > 0, F.array(id_of(F.get(known, F.lit(0))))).otherwise(spelled(a))

    cuts = F.filter(F.sequence(F.lit(0), n), lambda i: mask.bitwiseAND(_bits(i, i + 1)) != 0)
    one_by_one = let(cuts, lambda c: F.flatten(F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda k: segment(c, k))))
    # where each segment has its piece, which is the rule, the edges that are segments in order of their starts do
    is_segment = lambda e: (mask.bitwiseAND(e["inside"]) == 0) & (mask.bitwiseAND(e["ends"]) == e["ends"])
    own = F.sort_array(F.transform(F.filter(edges, is_segment), lambda e: e["key"]))
    return let(own, lambda o: F.when(F.size(o) == F.bit_count(mask) - 1, F.transform(o, lambda x: x.bitwiseAND(F.lit(_ID)).cast("int"))).otherwise(one_by_one))


def encode_units(units: DataFrame, path: str) -> DataFrame:
    """`units` (unit, ...), partitioned by unit, with `ids` of each unit of at most LONGEST characters."""
    m = model(path)
    n = F.length("unit")
    table = piece_table(units.sparkSession, path)
    found = lattice(units, table if m.unigram else table.drop("score"), m.longest_piece, len(m.pieces) <= VOCABULARY)
    if m.unigram:
        worst = min(s for _, s in m.pieces.values()) - 10.0
        plain = F.transform("edges", lambda e: e["edge"])
        fold = lambda _: viterbi_borders(F.col("edges"), n, worst)
    else:
        plain = F.col("edges")
        fold = lambda e: bpe_borders(e, n)
    # each step is bound by `let`: inside a lambda it would run again for each element
    ids = let(masks(plain), lambda e: let(fold(e), lambda mask: unit_ids(F.col("unit"), e, mask, m.byte_ids, m.unknown)))
    return found.withColumn("ids", ids).drop("edges")


def _strings(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    whole = points.tobytes().decode("utf-32-le")
    return [whole[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def _distinct_units(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of each distinct unit, which one each place has, counts); code points take two bytes where they fit."""
    wide = 4 if points.max(initial=0) > 0xFFFF else 2
    raw = np.ascontiguousarray(points.astype(f"<u{wide}")).view(np.uint8)
    return distinct_spans(Words(raw), start * wide, (end - start) * wide)


def _runs(parts: list[str], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of parts of about `most` characters."""
    sizes = np.array([len(x) for x in parts], np.int64)
    return spans_of_bytes(np.concatenate([[0], np.cumsum(sizes)]), 2 * most)


def _unit_batches(path: str):
    """Texts -> (unit, part, n): what this partition holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, partition = model(path), TaskContext.get().partitionId()
        place: dict[str, int] = {}
        counts = np.zeros(1 << 16, np.int64)

        def flush() -> pa.RecordBatch:
            cols = [pa.array(place, pa.string()), pa.array(np.full(len(place), partition, np.int32)), pa.array(counts[: len(place)])]
            return pa.RecordBatch.from_arrays(cols, names=["unit", "part", "n"])

        for batch in slices(batches, SLICE):
            parts, _ = m.parts(texts_of(batch.column("text")))
            for a, b in _runs(parts):
                points, start, end, _ = m.split(parts[a:b])
                at, _, n = _distinct_units(points, start, end)
                here = [place.setdefault(x, len(place)) for x in _strings(points, start[at], end[at])]
                if len(place) > len(counts):
                    counts = np.concatenate([counts, np.zeros(max(len(counts), len(here)), np.int64)])
                counts[here] += n
                if len(place) > 250_000:
                    yield flush()
                    place, counts = {}, np.zeros(1 << 16, np.int64)
        if place:
            yield flush()

    return run


class _Table:
    """Ids of units: keys of the units in order, the units themselves, and the ids one after the other."""

    def __init__(self, units: list[str], flat: np.ndarray, size: np.ndarray):
        points = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
        self.words = Words(points.view(np.uint8))
        length = np.array([len(x) for x in units], np.int64) * 4
        place = np.cumsum(length) - length
        keys = self.words.keys(place, length)
        order = np.argsort(keys, kind="stable")
        self.keys, self.place, self.length = keys[order], place[order], length[order]
        self.flat, self.size = flat, size[order]
        self.start = (np.cumsum(size) - size)[order]

    @classmethod
    def of(cls, tables: list[pa.Table]) -> _Table:
        units, parts, sizes = [], [], []
        for t in tables:
            units += t.column("unit").to_pylist()
            raw, offsets = text_buffers(t.column("ids").combine_chunks())
            parts.append(raw.view(">i4").astype(np.int32))
            sizes.append(np.diff(offsets) // 4)
        none = np.zeros(0, np.int64)
        return cls(units, np.concatenate([none.astype(np.int32), *parts]), np.concatenate([none, *sizes]))

    def find(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the units at start .. end of code points, and which are there: keys are looked up, units compared."""
        if not len(self.keys) or not len(start):
            return np.zeros(len(start), np.int64), np.zeros(len(start), bool)
        words = Words(np.ascontiguousarray(points.astype("<u4")).view(np.uint8))
        first, size = start * 4, (end - start) * 4
        keys = words.keys(first, size)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = (self.keys[at] == keys) & (self.length[at] == size)
        pick = np.flatnonzero(there)
        there[pick] = words.equal(first[pick], self.words, self.place[at[pick]], size[pick])
        return at, there


def _own_units(root: str, part: int) -> Iterator[pa.Table]:
    """(unit, ids) tables that were written for an input partition."""
    fs, where = pafs.FileSystem.from_uri(root)
    for f in fs.get_file_info(pafs.FileSelector(f"{where}/part={part}", allow_not_found=True)):
        if f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as source:
                yield pq.ParquetFile(source).read(columns=["unit", "ids"])


class _Encoder:
    """Ids of parts of texts: units from the table, and from the library what is in neither place, such as long units."""

    def __init__(self, m: Model, known: _Table):
        self.m, self.known = m, known
        self.others: dict[str, np.ndarray] = {}

    def ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each part has)."""
        known = self.known
        points, start, end, part = self.m.split(parts)
        at, which, _ = _distinct_units(points, start, end)
        place, there = known.find(points, start[at], end[at])
        flat = known.flat
        if there.all():
            first, size = known.start[place], known.size[place]
        else:
            first, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            first[there], size[there] = known.start[place[there]], known.size[place[there]]
            lost = _strings(points, start[at[~there]], end[at[~there]])
            if len(self.others) > 20_000:
                self.others.clear()
            for x in lost:
                if x not in self.others:
                    self.others[x] = np.array(self.m.by_library(x), np.int32)
            found = [self.others[x] for x in lost]
            size[~there] = more = np.array([len(x) for x in found], np.int64)
            first[~there] = len(flat) + np.cumsum(more) - more
            flat = np.concatenate([flat, *found])
        first, size = first[which], size[which]
        return flat[ranges(first, size)], np.bincount(part, size, minlength=len(parts)).astype(np.int64)


def _encode_batches(path: str, head, root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        coder = _Encoder(m, _Table.of([head.value, *_own_units(root, TaskContext.get().partitionId())]))
        for batch in slices(batches, SLICE):
            parts, row = m.parts(texts_of(batch.column("text")))
            done = [coder.ids(parts[a:b]) for a, b in _runs(parts)]
            ids = np.concatenate([np.zeros(0, np.int32), *(x for x, _ in done)])
            sizes = np.concatenate([np.zeros(0, np.int64), *(n for _, n in done)])
            ends = np.concatenate([[0], np.cumsum(np.bincount(np.array(row, np.int64), sizes, minlength=batch.num_rows).astype(np.int64))])
            if m.merges_unknown and len(ids):
                keep = np.concatenate([[True], (ids[1:] != m.unknown) | (ids[:-1] != m.unknown)])
                keep[ends[:-1][ends[:-1] < len(ids)]] = True
                ends, ids = np.concatenate([[0], np.cumsum(keep)])[ends], ids[keep]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "piece_ids"])

    return run


def encode(docs: DataFrame, path: str, scratch: Scratch, head: int = HEAD, decoded: bool = False) -> DataFrame:
    """docs (text and other columns) with `piece_ids`, an array of ints. Reads `scratch` later.

    With `decoded` the ids are decoded again in the same worker process, as by `decode`.
    """
    spark, docs = docs.sparkSession, docs.drop("piece_ids")
    found = docs.select("text").mapInArrow(_unit_batches(path), "unit string, part int, n long")
    held = scratch.table(found.where(F.length("unit") <= LONGEST), "held")
    # fine partitions, so that a task's units and edges are grouped in memory; grouping by sorting would spill all edges
    finer = held.select("unit", "n").repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "unit")
    counted = finer.groupBy("unit").agg(F.sum("n").alias("n"))
    with settings(spark, {_IN_MEMORY: str(1 << 17)}):
        table = scratch.table(encode_units(counted, path).select("unit", "n", _packed(F.col("ids")).alias("ids")), "units")
    cut = frequency_cut(table, head)
    # at most `head` rows
    frequent = table.where(F.col("n") >= cut).select("unit", "ids")
    shared = spark.sparkContext.broadcast(frequent.toArrow())
    # frequent units go first, by a broadcast of at most `head` units: what is left has no hot key
    rest = held.select("unit", "part").join(F.broadcast(frequent.select("unit")), "unit", "left_anti")
    rare = rest.join(table.where(F.col("n") < cut).select("unit", "ids").hint("shuffle_hash"), "unit")
    root = scratch.path("parts")
    rare.repartition("part", F.pmod(F.xxhash64("unit"), F.lit(FILES))).write.partitionBy("part").parquet(root)
    run = _encode_batches(path, shared, root)
    out = docs.withColumn("piece_ids", F.lit(None).cast("array<int>"))
    if not decoded:
        return docs.mapInArrow(run, out.schema)
    back = _decode_batches(path)
    return docs.drop("decoded").mapInArrow(lambda batches: back(run(batches)), out.drop("decoded").withColumn("decoded", F.lit("")).schema)


def _packed(ids: Column) -> Column:
    """Each id as four bytes, highest first, one after the other."""
    return F.unhex(F.array_join(F.transform(ids, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def _spelling(m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all pieces one after the other, their sizes)."""
    table = [x.replace(SPACE.encode(), b" ") for x in m.spell]
    return np.frombuffer(b"".join(table), np.uint8), np.array([len(x) for x in table], np.int64)


def spelled(m: Model, ids: np.ndarray, offsets: np.ndarray, most: int = 200_000) -> list[bytes]:
    """What the ids between each two offsets spell, by gathers from the pieces' bytes, `most` ids at a time."""
    flat, size = _spelling(m)
    start = np.cumsum(size) - size
    raw, lengths = [], size[ids]
    for a in range(0, len(ids), most):
        raw.append(flat[ranges(start[ids[a : a + most]], lengths[a : a + most])].tobytes())
    whole = b"".join(raw)
    lead = 1 if m.prefix else 0
    ends = np.concatenate([[0], np.cumsum(lengths)])[offsets]
    return [whole[a + lead : b] if lead and whole[a : a + 1] == b" " and b > a else whole[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]  # noqa: B905


def _decode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            sizes = np.concatenate([[0], np.cumsum(batch.column("piece_ids").value_lengths().fill_null(0).to_numpy())])
            for a, b in spans_of_bytes(sizes, 200_000):
                part = batch.slice(a, b - a)
                ids = part.column("piece_ids").flatten().to_numpy()
                texts = [x.decode(errors="replace") for x in spelled(m, ids, sizes[a : b + 1] - sizes[a])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` (piece_ids and other columns) with `decoded`, the text that the ids spell."""
    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(_decode_batches(path), encoded.withColumn("decoded", F.lit("")).schema)


def encoded_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, ids_xxh64, n_chars, round_trip): a hash of each text's ids, and whether they decode to it."""
    scratch = Scratch(docs.sparkSession, "pieces")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    both = encode(rows, path, scratch, decoded=True)
    ids = F.col("piece_ids")
    same = F.col("decoded") == F.replace("text", F.lit(SPACE), F.lit(" "))
    out = both.select("doc_id", F.size(ids).cast("long").alias("n_pieces"), F.xxhash64(ids).alias("ids_xxh64"), F.length("text").cast("long").alias("n_chars"), same.alias("round_trip"))
    return scratch.finish(out)
