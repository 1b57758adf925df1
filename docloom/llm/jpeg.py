"""Baseline JPEG as a media column: lossless payloads in, dimensions and thumbnail hashes out, all in numpy.

Reading. `parse` walks the markers of a baseline (SOF0) file: quantisation and Huffman tables, frame and scan headers,
restart interval, comments. `decode` then Huffman-decodes the scans of many files at once, in lock step: each restart
segment of each file is a lane, and one step decodes one coefficient symbol of every lane by table lookup. Only what is
needed is rebuilt: the coefficients of a file written by `encode`, and for any file the DC values of the first
component, which give a luminance thumbnail with one pixel for every 8 x 8 block.

Writing. `encode` stores bytes losslessly: a byte b is the quantised coefficient b - 128, 64 to a block in zigzag order,
three components to a unit, so 192 bytes make a unit. The file is an ordinary 4:4:4 baseline JPEG with all quantisers 1,
its own Huffman tables, a restart marker every few units, and the payload's length in a comment; units past the payload,
which fill the last row, are blocks of zeros.

Memory. Files are written and read in groups of restart segments, which stand alone: beside a text, its file, two bytes for
each coefficient and the payload, a task holds arrays for about GROUP blocks or bytes at a time. The format's limit of 65535
pixels a side bounds a payload at 12.8 GB.

Defined results: a null or empty text is one unit of 192 spaces. Equal payloads give equal files. A file that is not
baseline, is cut short or has bad codes raises ValueError. Every row gives one row, also where ids repeat or are null.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import slices, spans_of_bytes, text_buffers

UNIT = 192
#: Units between restart markers.
RESTART = 4
_NOTE = b"payload "
#: Blocks that are coded, and bytes of segments that are decoded, at a time.
GROUP = 1 << 15


def canonical(counts: list[int]) -> list[tuple[int, int]]:
    """(code, length) of each symbol of a Huffman table, given how many codes each length 1 to 16 has."""
    out, code = [], 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length))
            code += 1
        code <<= 1
    return out


def _own_tables() -> tuple[tuple[list[int], list[int]], tuple[list[int], list[int]]]:
    """(counts, symbols) for DC and AC: four bits for what bytes of text use, nine for the other AC symbols."""
    dc = [0] * 16
    dc[3] = 12
    ac = [0] * 16
    ac[3], ac[8] = 9, 15 * 8 + 1
    common = [0x00, *range(1, 9)]
    return (dc, list(range(12))), (ac, common + [run << 4 | size for run in range(1, 16) for size in range(1, 9)] + [0xF0])


OWN_DC, OWN_AC = _own_tables()


def _encoder_table(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    codes, sizes = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s, (c, n) in zip(symbols, canonical(counts), strict=True):
        codes[s], sizes[s] = c, n
    return codes, sizes


_DC_CODE, _DC_SIZE = _encoder_table(*OWN_DC)
_AC_CODE, _AC_SIZE = _encoder_table(*OWN_AC)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(width: int, height: int, payload: int) -> bytes:
    tables = b"".join(_segment(0xC4, bytes([kind << 4]) + bytes(counts) + bytes(symbols)) for kind, (counts, symbols) in enumerate((OWN_DC, OWN_AC)))
    frame = struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([i, 0x11, 0]) for i in (1, 2, 3))
    scan = bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])
    return b"".join([
        b"\xff\xd8", _segment(0xFE, _NOTE + str(payload).encode()), _segment(0xDB, b"\x00" + b"\x01" * 64), _segment(0xC0, frame),
        tables, _segment(0xDD, struct.pack(">H", RESTART)), _segment(0xDA, scan),
    ])


def grid(units: int) -> tuple[int, int]:
    """(columns, rows) of the units of a payload, nearly square; both stay within the format's 65535 pixels."""
    cols = max(1, min(8191, math.isqrt(units - 1) + 1 if units > 1 else 1))
    rows = -(-units // cols)
    if rows > 8191:
        raise ValueError("the payload is larger than a baseline JPEG can hold")
    return cols, rows


def _bit_sizes(values: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)


def _segment_bytes(coefficients: np.ndarray, segment_of_block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of blocks (n, 64) and the end of each segment in them; a segment is padded with ones.

    DC values are coded as differences to the same component's last block in the segment.
    """
    n = len(coefficients)
    dc = coefficients[:, 0].copy()
    previous = np.zeros(n, np.int64)
    previous[3:] = np.where(segment_of_block[3:] == segment_of_block[:-3], dc[:-3], 0)
    values = coefficients.copy()
    values[:, 0] = dc - previous
    place = np.arange(64)
    live = values != 0
    live[:, 0] = True
    last = np.maximum.accumulate(np.where(live, place, 0), axis=1)
    block, k = np.nonzero(live)
    before = np.where(k > 0, last[block, np.maximum(k - 1, 0)], 0)
    run = np.where(k > 0, k - before - 1, 0)
    value = values[block, k]
    size = _bit_sizes(value)
    zrl = run >> 4
    symbol = (run & 15) << 4 | size
    code = np.where(k == 0, _DC_CODE[size], _AC_CODE[symbol])
    length = np.where(k == 0, _DC_SIZE[size], _AC_SIZE[symbol])
    extra = np.where(value < 0, value + (1 << size) - 1, value).astype(np.uint64)
    bits = code << size.astype(np.uint64) | extra
    length = length + size
    # zero runs of sixteen go before, ends of blocks after their coefficient; few blocks have either
    z = np.repeat(np.flatnonzero(zrl), zrl[zrl > 0])
    ends = np.flatnonzero(last[:, 63] < 63)
    key = np.concatenate([block * 256 + k * 2 + 1, block[z] * 256 + k[z] * 2, ends * 256 + 255])
    bits = np.concatenate([bits, np.full(len(z), _AC_CODE[0xF0]), np.full(len(ends), _AC_CODE[0])])
    length = np.concatenate([length, np.full(len(z), _AC_SIZE[0xF0]), np.full(len(ends), _AC_SIZE[0])])
    if len(z) or len(ends):
        order = np.argsort(key, kind="stable")
        key, bits, length = key[order], bits[order], length[order]
    segment = segment_of_block[key >> 8]
    cut = np.flatnonzero(np.concatenate([segment[1:] != segment[:-1], [True]]))
    total = np.cumsum(length)
    used = np.diff(np.concatenate([[0], total[cut]]))
    pad = -used % 8
    ends_bytes = np.cumsum((used + pad) >> 3)
    shift = np.concatenate([[0], np.cumsum(pad)[:-1]])
    index = np.zeros(len(segment), np.int64)
    index[cut[:-1] + 1] = 1
    start = total - length + shift[np.cumsum(index)]
    # each code of at most 31 bits falls into at most five bytes
    out = np.zeros(int(ends_bytes[-1]) + 8, np.uint8)
    word = bits << (np.uint64(40) - (start & 7).astype(np.uint64) - length.astype(np.uint64))
    for i in range(5):
        part = (word >> np.uint64(32 - 8 * i) & np.uint64(0xFF)).astype(np.uint8)
        hit = np.flatnonzero(part)
        if len(hit):
            # several codes may meet in one byte: as their bits are apart, adding is joining
            out += np.bincount((start[hit] >> 3) + i, part[hit], minlength=len(out)).astype(np.uint8)
    out = out[: int(ends_bytes[-1])]
    out[ends_bytes - 1] |= ((1 << pad) - 1).astype(np.uint8)
    return out, ends_bytes


def encode(payloads: list[bytes]) -> list[bytes]:
    """JPEG files that hold the payloads, each a positive multiple of 192 bytes."""
    units = [len(p) // UNIT for p in payloads]
    grids = [grid(n) for n in units]
    cells = [c * r for c, r in grids]
    blocks = np.full((3 * sum(cells), 64), 128, np.uint8)
    segment_of_unit, at, seg = [], 0, 0
    seg_of_file = [0]
    for p, n, c in zip(payloads, units, cells, strict=True):
        blocks[3 * at : 3 * (at + n)] = np.frombuffer(p, np.uint8).reshape(-1, 64)
        segment_of_unit.append(seg + np.arange(c, dtype=np.int32) // RESTART)
        at, seg = at + c, seg + -(-c // RESTART)
        seg_of_file.append(seg)
    segment = np.repeat(np.concatenate(segment_of_unit), 3)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(segment)) + 1, [len(segment)]])
    coded, ends_of, total = [], [], 0
    for a, b in spans_of_bytes(cuts, GROUP):
        part = slice(cuts[a], cuts[b])
        raw, ends = _segment_bytes(blocks[part].astype(np.int64) - 128, segment[part] - segment[cuts[a]])
        coded.append(raw)
        ends_of.append(ends + total)
        total += len(raw)
    data, ends = np.concatenate(coded), np.concatenate(ends_of)
    # bytes FF in the data are followed by 00
    full = np.flatnonzero(data == 0xFF)
    data = np.insert(data, full + 1, 0)
    ends = ends + np.searchsorted(full, ends)
    raw, starts = data.tobytes(), np.concatenate([[0], ends[:-1]])
    out = []
    for i, (p, (cols, rows)) in enumerate(zip(payloads, grids, strict=True)):
        parts = [header(8 * cols, 8 * rows, len(p))]
        for j, s in enumerate(range(seg_of_file[i], seg_of_file[i + 1])):
            if j:
                parts.append(bytes([0xFF, 0xD0 + (j - 1) % 8]))
            parts.append(raw[starts[s] : ends[s]])
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


@dataclass
class Scan:
    """One file's headers, and its entropy-coded segments with stuffing removed."""

    width: int = 0
    height: int = 0
    payload: int | None = None
    restart: int = 0
    #: id, horizontal and vertical sampling, quantisation table
    components: list[tuple[int, int, int, int]] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    #: of the scan: component, DC table, AC table
    parts: list[tuple[int, int, int]] = field(default_factory=list)
    segments: list[bytes] = field(default_factory=list)


def parse(raw: bytes) -> Scan:
    """Markers of a baseline file with one interleaved scan, or one component."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no start marker")
    out, at = Scan(), 2
    try:
        while True:
            if raw[at] != 0xFF:
                raise ValueError("a marker is expected")
            marker = raw[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            size = int.from_bytes(raw[at + 2 : at + 4])
            body = raw[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE and body.startswith(_NOTE):
                out.payload = int(body[len(_NOTE) :])
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 64 * (1 + wide)
                    out.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    counts = body[1:17]
                    n = sum(counts)
                    out.huffman[body[0]] = (counts, body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                out.restart = int.from_bytes(body[:2])
            elif marker == 0xC0:
                bits, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
                if bits != 8:
                    raise ValueError("only 8 bits a sample")
                out.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a baseline frame")
            elif marker == 0xDA:
                ids = [c[0] for c in out.components]
                out.parts = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                break
            elif marker == 0xD9:
                raise ValueError("no scan")
    except IndexError:
        raise ValueError("the file is cut short") from None
    if len(out.parts) != len(out.components) or not out.width or not out.height:
        raise ValueError("only one scan with all components")
    data = np.frombuffer(raw, np.uint8, offset=at)
    full = np.flatnonzero(data[:-1] == 0xFF)
    after = data[full + 1]
    ends = full[(after != 0) & (after != 0xFF) & ~((after >= 0xD0) & (after <= 0xD7))]
    if not len(ends):
        raise ValueError("no end marker")
    end = int(ends[0])
    marks = full[(after >= 0xD0) & (after <= 0xD7) & (full < end)]
    stuffed = full[(after == 0) & (full < end)] + 1
    keep = np.ones(end, bool)
    keep[stuffed] = False
    keep[marks] = keep[marks + 1] = False
    clean = data[:end][keep].tobytes()
    gone = np.searchsorted(np.sort(np.concatenate([stuffed, marks, marks + 1])), marks)
    edges = [0, *(marks - gone).tolist(), len(clean)]
    out.segments = [clean[a:b] for a, b in zip(edges, edges[1:])]  # noqa: B905
    return out


def _lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """For each 16 bits that may come next: symbol << 8 | code length, length 0 where no code fits."""
    counts, symbols = table
    out = np.zeros(1 << 16, np.uint16)
    for s, (code, n) in zip(symbols, canonical(list(counts)), strict=True):
        out[code << (16 - n) : (code + 1) << (16 - n)] = s << 8 | n
    return out


@dataclass
class Decoded:
    """Coefficients by coded block (blocks, 64 in zigzag order) or DC values alone, per file."""

    scan: Scan
    blocks: np.ndarray
    #: component of each block in a unit, in coded order
    pattern: list[int]


def decode(files: list[bytes], dc_only: bool = False) -> list[Decoded]:
    """Huffman-decodes the files' scans together; with dc_only the AC coefficients are read but not kept."""
    scans = [parse(f) for f in files]
    tables: dict[tuple[bytes, bytes], int] = {}
    lane_units, lane_pattern, lane_file, patterns, lane_bytes = [], [], [], [], []
    known: dict[tuple, int] = {}
    for i, s in enumerate(scans):
        alone = len(s.components) == 1
        row = []
        for c, dc, ac in s.parts:
            _, h, v, _ = s.components[c]
            for kind in (dc, 16 | ac):
                if kind not in s.huffman:
                    raise ValueError("a Huffman table is missing")
                tables.setdefault(s.huffman[kind], len(tables))
            row += [(c, tables[s.huffman[dc]], tables[s.huffman[16 | ac]])] * (1 if alone else h * v)
        p = known.setdefault(tuple(row), len(patterns))
        if p == len(patterns):
            patterns.append(row)
        cols, rows = units_of(s)
        n, step = cols * rows, s.restart or cols * rows
        if len(s.segments) != -(-n // step):
            raise ValueError("restart markers and size disagree")
        for j, seg in enumerate(s.segments):
            lane_units.append(min(step, n - j * step))
            lane_pattern.append(p)
            lane_file.append(i)
            lane_bytes.append(seg)
    lookups = np.concatenate([_lookup(t) for t in tables])
    results: list[np.ndarray] = []
    sizes = np.cumsum([0, *map(len, lane_bytes)])
    for a, b in spans_of_bytes(sizes, 64 * GROUP):
        results += _decode_lanes(lane_bytes[a:b], np.array(lane_units[a:b]), np.array(lane_pattern[a:b]), patterns, lookups, dc_only)
    out, lane = [], 0
    for s in scans:
        mine = results[lane : lane + len(s.segments)]
        pattern = patterns[lane_pattern[lane]]
        lane += len(s.segments)
        out.append(Decoded(s, np.concatenate(mine), [c for c, _, _ in pattern]))
    return out


def units_of(s: Scan) -> tuple[int, int]:
    """Columns and rows of the scan's units."""
    if len(s.components) == 1:
        return -(-s.width // 8), -(-s.height // 8)
    h, v = max(c[1] for c in s.components), max(c[2] for c in s.components)
    return -(-s.width // (8 * h)), -(-s.height // (8 * v))


def _decode_lanes(
    data: list[bytes], units: np.ndarray, pattern: np.ndarray, patterns: list[list[tuple[int, int, int]]], lookups: np.ndarray, dc_only: bool
) -> list[np.ndarray]:
    """Each step reads one symbol and its value bits in every lane that is still at work."""
    n = len(data)
    sizes = np.array([len(p) for p in patterns])[pattern]
    blocks = units * sizes
    base = np.concatenate([[0], np.cumsum(blocks)])
    width = 1 if dc_only else 64
    out = np.zeros((int(base[-1]), width), np.int16)
    raw = np.frombuffer(b"".join(x + b"\x00" * 8 for x in data), np.uint8)
    lengths = np.array([len(x) for x in data])
    start = np.concatenate([[0], np.cumsum(lengths + 8)[:-1]])
    words = np.zeros(len(raw), np.uint64)  # the next eight bytes, big-endian; those past the end are of the next lane or zero
    for k in range(8):
        words[: len(raw) - k] |= raw[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    most = max(len(p) for p in patterns)
    grid_c, grid_dc, grid_ac = (np.zeros((len(patterns), most), np.int64) for _ in range(3))
    for i, p in enumerate(patterns):
        for j, (c, dc, ac) in enumerate(p):
            grid_c[i, j], grid_dc[i, j], grid_ac[i, j] = c, dc, ac
    prediction = np.zeros((n, int(grid_c.max()) + 1), np.int64)
    live = np.arange(n)
    bit = start * 8  # of each live lane
    block, k = np.zeros(n, np.int64), np.zeros(n, np.int64)
    limit = (start + lengths) * 8
    pat, size = pattern, sizes
    inside = np.zeros(n, np.int64)  # of the block in its unit
    while len(live):
        word = words[bit >> 3] << (bit & 7).astype(np.uint64)
        is_dc = k == 0
        table = np.where(is_dc, grid_dc[pat, inside], grid_ac[pat, inside])
        entry = lookups[(table << 16) + (word >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        length, symbol = entry & 255, entry >> 8
        if not length.all():
            raise ValueError("a code that no table has")
        low, run = symbol & 15, np.where(is_dc, 0, symbol >> 4)
        wide = np.where(is_dc, symbol, low)
        value = ((word << length.astype(np.uint64)) >> np.uint64(1) >> (63 - wide).astype(np.uint64)).astype(np.int64)
        value = np.where((wide > 0) & (value < (1 << np.maximum(wide - 1, 0))), value - (1 << wide) + 1, value)
        bit = bit + length + wide
        stop = ~is_dc & (symbol == 0)  # end of block
        at = np.where(stop, 64, k + run)
        if (at > 63).any() and (at[~stop] > 63).any():
            raise ValueError("more than 64 coefficients in a block")
        first = np.flatnonzero(is_dc)
        if len(first):
            c = grid_c[pat[first], inside[first]]
            value[first] += prediction[live[first], c]
            prediction[live[first], c] = value[first]
        if dc_only:
            out[base[live[first]] + block[first], 0] = value[first]
        else:
            put = np.flatnonzero(~stop)
            out[base[live[put]] + block[put], at[put]] = value[put]
        k = at + 1
        done = np.flatnonzero(k >= 64)
        if len(done):
            k[done] = 0
            block[done] += 1
            inside[done] = (inside[done] + 1) % size[done]
            keep = block < blocks[live]
            if not keep.all():
                if (bit[~keep] > limit[live[~keep]]).any():
                    raise ValueError("a scan is cut short")
                live, bit, block, k, inside, pat, size = (x[keep] for x in (live, bit, block, k, inside, pat, size))
    return [out[a:b] for a, b in zip(base, base[1:])]  # noqa: B905


def payload(d: Decoded) -> bytes:
    """What `encode` stored."""
    if d.scan.payload is None:
        raise ValueError("the file holds no payload")
    return (d.blocks + np.int16(128)).astype(np.uint8).tobytes()[: d.scan.payload]


def thumbnail(d: Decoded) -> np.ndarray:
    """DC-only luminance: one pixel for every 8 x 8 block of the first component, cut to the picture."""
    s = d.scan
    cols, rows = units_of(s)
    first = s.parts[0][0]
    _, h, v, q = s.components[first]
    if len(s.components) == 1:
        h = v = 1
    own = [i for i, c in enumerate(d.pattern) if c == first]
    dc = d.blocks[:, 0].astype(np.int64).reshape(rows, cols, len(d.pattern))[:, :, own].reshape(rows, cols, v, h)
    level = np.clip(np.rint(dc * s.quant[q][0] / 8 + 128), 0, 255).astype(np.uint8)
    picture = level.transpose(0, 2, 1, 3).reshape(rows * v, cols * h)
    top_h, top_v = max(c[1] for c in s.components), max(c[2] for c in s.components)
    if len(s.components) == 1:
        return picture
    return picture[: -(-s.height * v // (8 * top_v)), : -(-s.width * h // (8 * top_h))]


def average_hash(picture: np.ndarray) -> int:
    """64 bits: which cells of an 8 x 8 mean-pooled picture are over the mean of the cells."""
    height, width = picture.shape
    sums = np.zeros((height + 1, width + 1))
    sums[1:, 1:] = picture.cumsum(0).cumsum(1)
    y, x = (np.arange(9) * height) // 8, (np.arange(9) * width) // 8
    y0, y1 = y[:-1], np.maximum(y[1:], y[:-1] + 1)
    x0, x1 = x[:-1], np.maximum(x[1:], x[:-1] + 1)
    area = (y1 - y0)[:, None] * (x1 - x0)[None, :]
    cells = (sums[np.ix_(y1, x1)] - sums[np.ix_(y0, x1)] - sums[np.ix_(y1, x0)] + sums[np.ix_(y0, x0)]) / area
    return int.from_bytes(np.packbits((cells > cells.mean()).ravel()).tobytes())


def feature(d: Decoded) -> str:
    """Dimensions, perceptual hash and exact hash of the thumbnail."""
    t = thumbnail(d)
    return f"{d.scan.width}x{d.scan.height}:{average_hash(t):016x}:{hashlib.sha256(t.tobytes()).hexdigest()[:16]}"


def _padded(raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    whole = raw.tobytes()
    texts = [whole[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]  # noqa: B905
    return [t.ljust(max(1, -(-len(t) // UNIT)) * UNIT) for t in texts]


def _store_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1 << 20):
        raw, offsets = text_buffers(batch.column("text"))
        media = encode(_padded(raw, offsets))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text of docs (doc_id, text) as a JPEG that holds it."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store_batches, "doc_id long, n_bytes long, media binary")


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1 << 20, "media"):
        files = batch.column("media").to_pylist()
        read = decode(files)
        payloads = [payload(d) for d in read]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("n_bytes"), pa.array([len(p) for p in payloads], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                pa.array([len(f) for f in files], pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files]), pa.array([feature(d) for d in read]),
            ],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def features(media: DataFrame) -> DataFrame:
    """Digests of the payload read back from (doc_id, n_bytes, media), of the file, and the picture's feature."""
    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(_read_batches, out)
