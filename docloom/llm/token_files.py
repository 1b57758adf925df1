"""Token-id files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

The rows are dealt to shards by ranges of doc_id; of an id with very many rows, by ranges of a hash as well. A shard's task
encodes its texts in order, some thousand at a time, ranks the ids by how often these use them (most frequent first, ties by
id), and writes a file to the shared folder:

    magic "DLTI0001"; header of 6 little-endian u64: number of documents, of ids, of distinct ids, bytes of data,
    id width (2 or 4), spare; then the document lengths (u32 each, in ids, with the end id), the distinct ids in rank
    order (id width each), the control bytes, the data bytes.

Each control byte holds four 2-bit codes, lowest bits first: code c means that the rank takes c + 1 data bytes, little-
endian. Control and data bytes stand apart, so decoding is a table lookup per control byte and gathers in numpy, with no
branch per id. Ranks are the file's own: a file can be read alone, and no second pass over the corpus is needed.

A file is written under a name of its own for each attempt and renamed when complete, and only the attempts whose rows
Spark kept are in the manifest; so a lost executor leaves nothing half-written behind that is read.

Defined results: a null text is empty and gives the end id alone. Rows with equal doc_id are ordered by text (by a hash and
then by text if there are more of them than a file has rows), rows with a null doc_id come first. An empty table gives no file and an empty result. Extra columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.bpe import IdCache
from docloom.llm.common import Scratch, join_small, slices, text_buffers

MAGIC = b"DLTI0001"
#: Most rows of a file.
SHARD_ROWS = 8_000
#: Most shards; with more rows, a shard writes several files.
MOST_SHARDS = 10_000
#: A file holds about so many ids at most; a longer text makes a file of its own.
PART_IDS = 1 << 24


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control bytes, data bytes) of non-negative ranks below 2^32."""
    wide = ranks.max(initial=0) > 0xFFFF
    ranks = ranks.astype("<u4" if wide else "<u2")
    if not wide:
        extra = (ranks > 0xFF).view(np.uint8)
    else:
        extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = extra
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    lanes = ranks.view(np.uint8).reshape(len(ranks), ranks.dtype.itemsize)
    return control.astype(np.uint8), lanes[np.arange(ranks.dtype.itemsize, dtype=np.uint8)[None, :] <= extra[:, None]]


#: Lengths of the four values of each control byte.
_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks of `pack`, by table lookup."""
    sizes = _LENGTHS[control].ravel()[:n]
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    out = padded[starts].astype(np.uint32)
    for k in (1, 2, 3):
        wide = np.flatnonzero(sizes > k)
        if len(wide):
            out[wide] |= padded[starts[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def file_bytes(lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One shard's file: document lengths in ids, and all ids."""
    counts = np.bincount(ids)  # as long as the vocabulary
    distinct = np.flatnonzero(counts).astype(ids.dtype)
    order = np.lexsort((distinct, -counts[distinct]))
    rank = np.zeros(len(counts), "<u4")
    rank[distinct[order]] = np.arange(len(order))
    control, data = pack(rank[ids])
    head = np.array([len(lengths), len(ids), len(distinct), len(data), ids.dtype.itemsize, 0], "<u8")
    return b"".join([MAGIC, head.tobytes(), lengths.astype("<u4").tobytes(), distinct[order].tobytes(), control.tobytes(), data.tobytes()])


def read_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(document lengths, ids as u32) of a file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token-id file")
    docs, n, distinct, size, width, _ = (int(x) for x in np.frombuffer(raw, "<u8", 6, 8))
    at = 56
    lengths = np.frombuffer(raw, "<u4", docs, at)
    at += 4 * docs
    table = np.frombuffer(raw, f"<u{width}", distinct, at).astype("<u4")
    at += width * distinct
    control = np.frombuffer(raw, np.uint8, -(-n // 4), at)
    at += len(control)
    return lengths, table[unpack(control, np.frombuffer(raw, np.uint8, size, at), n)] if n else np.zeros(0, "<u4")


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _writer(path: str, root: str, end_id: int, most: int, most_ids: int):
    """Rows (doc_id, text) in order -> files of at most `most` rows and about `most_ids` ids, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, shard = IdCache.of(path), TaskContext.get().partitionId()
        end = np.array([end_id], cache.kind)
        seq, size, ids, parts = 0, 0, [], []

        def write() -> pa.RecordBatch:
            fs, where = _open(root)
            fs.create_dir(where, recursive=True)
            name = f"shard-{shard:08d}-{seq:05d}-{uuid.uuid4().hex}.ids"
            lengths = np.array([len(p) for p in parts], np.int64)
            with fs.open_output_stream(f"{where}/.{name}") as out:
                out.write(file_bytes(lengths, np.concatenate(parts)))
            fs.move(f"{where}/.{name}", f"{where}/{name}")
            return pa.RecordBatch.from_arrays(
                [*(pa.array([x], pa.int64()) for x in (shard, seq)), pa.array([name]), pa.array([int(lengths.sum())], pa.int64()), pa.array([ids], pa.list_(pa.int64()))],
                names=["shard", "part", "file", "n_ids", "doc_ids"],
            )

        for batch in slices(batches, 4 << 20):
            encoded = cache.encode(*text_buffers(batch.column("text")))
            for doc, part in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                if parts and (len(parts) == most or size + len(part) > most_ids):
                    yield write()
                    seq, size, ids, parts = seq + 1, 0, [], []
                ids.append(doc)
                parts.append(np.concatenate([part, end]))
                size += len(part) + 1
        if parts:
            yield write()

    return run


def _reader(root: str):
    """Rows (shard, file, doc_ids, before) -> one row per document, from the file alone but for the doc_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = _open(root)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(f"{where}/{row['file']}") as f:
                    lengths, ids = read_bytes(f.read())
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                longs = [pa.array(x, pa.int64()) for x in (row["doc_ids"], row["before"] + ends - lengths, lengths.astype(np.int64), crc)]
                yield pa.RecordBatch.from_arrays(longs, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write_token_files(docs: DataFrame, path: str, root: str, end_id: int = 0, shard_rows: int = SHARD_ROWS, part_ids: int = PART_IDS) -> DataFrame:
    """Writes all texts of docs (doc_id, text) to files under the URI `root`; returns the manifest (shard, part, file, n_ids, doc_ids)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ["doc_id"]
    many = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows)
    if not many.isEmpty():
        key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("key")
        marked = join_small(rows.withColumn("key", key), many.select(key, F.lit(True).alias("many")), ["key"])
        # equal texts of one id may change places, so they are dealt by where they come from
        rows = marked.select("doc_id", "text", *(F.when(F.col("many"), c).alias(n) for n, c in (("deal", F.xxhash64("text")), ("spread", F.monotonically_increasing_id() % 1024))))
        order += ["deal", "spread"]
    shards = max(1, min(MOST_SHARDS, -(-rows.count() // shard_rows)))
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    return dealt.mapInArrow(_writer(path, root, end_id, shard_rows, part_ids), "shard long, part long, file string, n_ids long, doc_ids array<long>")


def read_token_files(manifest: DataFrame, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files; start counts all ids before it."""
    # one short row per file: their running sum is small work
    before = F.sum("n_ids").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("shard", "part", "n_ids").withColumn("before", F.coalesce(before, F.lit(0)))
    count = max(1, manifest.count())
    files = manifest.drop("n_ids").join(placed.drop("n_ids"), ["shard", "part"]).repartition(count, "shard", "part")
    return files.mapInArrow(_reader(root), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Writes the files to scratch, reads them back and drops them; see read_token_files for the columns."""
    scratch = Scratch(docs.sparkSession, "token-files")
    root = scratch.path("ids")
    manifest = scratch.table(write_token_files(docs, path, root, end_id), "manifest")
    return scratch.finish(read_token_files(manifest, root))
