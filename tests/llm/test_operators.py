"""Each operator against a brute-force version, on small tables and on awkward ones."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import bpe, byte_cnn, chat, jpeg, mixing, pieces, quality_rules, rolling, simhash, suffix_dedup, token_files
from docloom.llm.common import Scratch, settings

from .conftest import AWKWARD, prose

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SPACE = r"[^\x20\x09-\x0D]+"


def key(x):
    return -1 if x is None or x != x else int(x)


# --- 1: mixing --------------------------------------------------------------------------------------------------------
def test_mixing_reaches_its_weights(make):
    rng = random.Random(1)
    docs = make([prose(rng, rng.randint(5, 40)) for _ in range(3000)]).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b").otherwise("c"))
    out = mixing.mix(docs, {"a": 3.0, "b": 1.0}, total=30.0)
    size = {r["source"]: r["z"] for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("z")).collect()}
    assert set(size) == {"a", "b"} and size["a"] / size["b"] == pytest.approx(3, rel=0.05)
    counts = [r["n"] for r in out.where("source = 'b'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()]
    assert np.var(counts) == pytest.approx(np.mean(counts), rel=0.2)  # Poisson


def test_mixing_awkward(awkward):
    out = mixing.mix(awkward, total=5.0)
    assert out.columns == [*awkward.columns, "copy_no", "shuffle_key"]
    a, b = out.collect(), mixing.mix(awkward.repartition(3), total=5.0).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and a
    assert mixing.mix(awkward.limit(0)).count() == 0 and mixing.mix(awkward, {}).count() == 0


def test_rows_without_ids_are_spread(make):
    rng = random.Random(3)
    docs = make([prose(rng, 8) for _ in range(600)], [None] * 600).union(make([None] * 600, [None] * 600)).withColumn("source", F.lit("a"))
    out = mixing.mix(docs, total=2.0).withColumn("p", F.spark_partition_id())
    assert len({r["shuffle_key"] for r in out.where("text is not null").collect()}) > 400
    with settings(docs.sparkSession, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        sizes = [r["n"] for r in out.groupBy("p").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)


# --- 2: quality rules -------------------------------------------------------------------------------------------------
def base(text):
    words = re.findall(SPACE, text or "")
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def test_quality_statistics(make, spark):
    rng = random.Random(2)
    texts = [*AWKWARD]
    for _ in range(150):
        words = prose(rng, rng.randint(1, 60)).split()
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(len(words))
            words[rng.randrange(len(words)) : 0] = words[a : a + rng.randint(6, 20)]
        texts.append("".join(w + rng.choice([" ", " ", "\n", "  ", "\t"]) + rng.choice(["", "", "#", "| "]) for w in words))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_rules.quality_verdicts(make(texts), labels).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(t), t
        assert not (r["kept"] and r["base_failed"])


def test_binomial_tail(spark):
    from math import comb

    cases = [(20, 0), (20, 1), (500, 3), (3000, 40), (3000, 100)]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.02).alias("p"))
    for r in df.collect():
        exact = sum(comb(r["n"], i) * 0.02**i * 0.98 ** (r["n"] - i) for i in range(r["k"] + 1))
        assert r["p"] == pytest.approx(exact if r["k"] <= r["n"] * 0.02 else 1.0, rel=1e-9)


def test_cutoffs_control_the_risk(spark):
    rng = random.Random(3)
    rows = [("a" if i % 4 else None, 1, min(1.0, rng.expovariate(9))) for i in range(8000)] + [("rare", 1, 0.0)] * 5
    held = spark.createDataFrame(rows, "stratum string, quality int, f double")
    rules = {"f": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1]}
    got = {r["stratum"]: r["cut_f"] for r in quality_rules.certified_cutoffs(held, rules=rules).collect()}
    assert set(got) == {"a", ""}
    for s, c in got.items():
        mine = [f for st, _, f in rows if (st == "a") == (s == "a")]
        assert sum(f >= c for f in mine) / len(mine) <= quality_rules.RISK
        assert sum(f >= c - 0.1 for f in mine) / len(mine) > 0.02  # and is not needlessly mild


def test_quality_empty(awkward, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.quality_verdicts(awkward, labels).count() == awkward.count()
    assert quality_rules.quality_verdicts(awkward.limit(0), labels).count() == 0


# --- 3, 4: tokens -----------------------------------------------------------------------------------------------------
def token_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("head", [1 << 18, 3])
def test_token_counts(awkward, head):
    rows = awkward.select("doc_id", "text").collect()
    expected = sorted((key(r[0]), len((r[1] or "").encode()), len(x), len(x) > 512) for r, x in zip(rows, token_ids([r[1] for r in rows]), strict=True))
    assert sorted((key(r[0]), *r[1:]) for r in bpe.token_counts(awkward, BPE, head=head).collect()) == expected
    assert bpe.token_counts(awkward.limit(0), BPE).count() == 0


def test_id_cache_splits_as_the_library():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab éÉ1 2.,!-\n\t  ×'s <|x\rſ") for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [x or "" for x in AWKWARD]
    cache, out = bpe.IdCache(BPE, room=500), []
    for i in range(0, len(texts), 500):
        raw = [t.encode() for t in texts[i : i + 500]]
        out += cache.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert [x.tolist() for x in out] == token_ids(texts)


def test_packing():
    rng = np.random.default_rng(5)
    for most in (1, 300, 70_000, 1 << 32):
        for n in (0, 1, 2, 3, 4, 5, 1001):
            ranks = rng.integers(0, most, n, dtype=np.uint64)
            control, data = token_files.pack(ranks)
            assert (token_files.unpack(control, data, n) == ranks).all()
    ids = rng.integers(0, 50_000, 5000).astype("<u2")
    lengths, back = token_files.read_bytes(token_files.file_bytes(np.array([2000, 0, 3000]), ids))
    assert lengths.tolist() == [2000, 0, 3000] and (back == ids).all()


def test_token_files(awkward):
    rows = sorted(awkward.select("doc_id", "text").collect(), key=lambda r: (key(r[0]), r[1] is not None, (r[1] or "").encode()))
    start, expected = 0, []
    for r, ids in zip(rows, token_ids([r[1] for r in rows]), strict=True):
        raw = np.array([*ids, 0], "<u4")
        expected.append((key(r[0]), start, len(raw), zlib.crc32(raw.tobytes())))
        start += len(raw)
    got = sorted(((key(r[0]), *r[1:]) for r in token_files.token_files(awkward, BPE).collect()), key=lambda r: r[1])
    assert got == expected
    assert token_files.token_files(awkward.limit(0), BPE).count() == 0


@pytest.mark.parametrize(("most", "ids"), [(4, 1 << 24), (1000, 600)])
def test_token_files_of_frequent_ids(make, spark, tmp_path, most, ids):
    rng = random.Random(37)
    texts = [prose(rng, rng.randint(0, 80)) for _ in range(60)] + ["same"] * 30 + [None] * 30
    docs = make(texts, [rng.choice([7, 8, None]) if i % 2 else i for i in range(60)] + [7] * 30 + [None] * 30).repartition(5)
    root = f"file://{tmp_path}/ids"
    manifest = token_files.write_token_files(docs, BPE, root, 0, most, ids).cache()
    files = manifest.collect()
    assert max(len(f["doc_ids"]) for f in files) <= most and all(f["n_ids"] <= ids or len(f["doc_ids"]) == 1 for f in files)
    got = sorted(token_files.read_token_files(manifest, root).collect(), key=lambda r: r["start"])
    assert [key(r["doc_id"]) for r in got] == sorted(key(r["doc_id"]) for r in got)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    crc = lambda x: zlib.crc32(np.array([*x, 0], "<u4").tobytes())
    rows = docs.select("doc_id", "text").collect()
    expected = sorted((key(r["doc_id"]), crc(x)) for r, x in zip(rows, token_ids([r["text"] for r in rows]), strict=True))
    assert sorted((key(r["doc_id"]), r["ids_crc32"]) for r in got) == expected


# --- 5: media ---------------------------------------------------------------------------------------------------------
def test_jpeg_round_trip(awkward):
    media = jpeg.store(awkward)
    rows, files = awkward.select("text").collect(), [r["media"] for r in media.collect()]
    for r, got, file in zip(rows, jpeg.features(media).collect(), files, strict=True):
        raw = (r["text"] or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (got["n_bytes"], got["payload_bytes"], got["payload_sha256"], got["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (got["media_bytes"], got["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
    assert jpeg.features(jpeg.store(awkward.limit(0))).count() == 0


def slow_decode(raw):
    """Bit by bit, one code at a time."""
    s = jpeg.parse(raw)
    tables = {k: {(c, n): sym for sym, (c, n) in zip(v[1], jpeg.canonical(list(v[0])), strict=True)} for k, v in s.huffman.items()}
    cols, rows = jpeg.units_of(s)
    out, left = [], cols * rows
    for seg in s.segments:
        bits, at, last = "".join(f"{b:08b}" for b in seg), 0, [0] * 9

        def symbol(t):
            nonlocal at
            code = n = 0
            while (code, n) not in t:
                code, at, n = code << 1 | int(bits[at]), at + 1, n + 1  # noqa: B023
            return t[code, n]

        def value(n):
            nonlocal at
            v, at = int(bits[at : at + n] or "0", 2), at + n  # noqa: B023
            return v if not n or v >> (n - 1) else v - (1 << n) + 1

        for _ in range(min(left, s.restart or left)):
            for c, dc, ac in s.parts:
                h, v = s.components[c][1:3]
                for _ in range(h * v if len(s.parts) > 1 else 1):
                    block = [0] * 64
                    last[c] += value(symbol(tables[dc]))
                    block[0], k = last[c], 1
                    while k < 64:
                        x = symbol(tables[16 | ac])
                        if x == 0:
                            break
                        k += x >> 4
                        if x & 15:
                            block[k] = value(x & 15)
                        k += 1
                    out.append(block)
        left -= s.restart
    return np.array(out)


def subsampled(width, height, rng):
    """A file with 2 x 2 luminance blocks a unit, no restarts, and a real quantiser, from the writer's own parts."""
    units = -(-width // 16) * -(-height // 16)
    values = rng.integers(-40, 40, (units * 6, 64)) * (rng.random((units * 6, 64)) < 0.15)
    own = [0, 0, 0, 0, 1, 2] * units
    out, last = "", [0, 0, 0]
    size = lambda v: int(abs(v)).bit_length()
    extra = lambda v: format(v if v > 0 else v + (1 << size(v)) - 1, f"0{size(v)}b") if v else ""
    code = lambda codes, sizes, s: format(int(codes[s]), f"0{int(sizes[s])}b")
    for c, block in zip(own, values.tolist(), strict=True):
        d = block[0] - last[c]
        last[c] = block[0]
        out += code(jpeg._DC_CODE, jpeg._DC_SIZE, size(d)) + extra(d)
        run, nonzero = 0, [k for k in range(1, 64) if block[k]]
        for k in range(1, (nonzero[-1] if nonzero else 0) + 1):
            if not block[k]:
                run += 1
                continue
            while run > 15:
                out, run = out + code(jpeg._AC_CODE, jpeg._AC_SIZE, 0xF0), run - 16
            out, run = out + code(jpeg._AC_CODE, jpeg._AC_SIZE, run << 4 | size(block[k])) + extra(block[k]), 0
        if not nonzero or nonzero[-1] < 63:
            out += code(jpeg._AC_CODE, jpeg._AC_SIZE, 0)
    out += "1" * (-len(out) % 8)
    data = bytes(int(out[i : i + 8], 2) for i in range(0, len(out), 8)).replace(b"\xff", b"\xff\x00")
    head = jpeg.header(width, height, 0)
    head = head.replace(b"\x01\x11\x00\x02", b"\x01\x22\x00\x02").replace(b"\xff\xdd\x00\x04\x00\x04", b"").replace(b"\x00" + b"\x01" * 64, b"\x00\x08" + b"\x01" * 63)
    return head + data + b"\xff\xd9", values


def test_long_jpegs_are_written_and_read_in_groups(monkeypatch):
    rng = np.random.default_rng(33)
    payloads = [rng.integers(0, 256, 192 * n).astype(np.uint8).tobytes() for n in (1, 700, 3, 90)]
    whole = jpeg.encode(payloads)
    monkeypatch.setattr(jpeg, "GROUP", 40)
    assert jpeg.encode(payloads) == whole
    read = jpeg.decode(whole)
    assert [jpeg.payload(d) for d in read] == payloads
    monkeypatch.undo()
    assert [jpeg.feature(d) for d in jpeg.decode(whole)] == [jpeg.feature(d) for d in read]


def test_jpeg_against_a_bitwise_decoder():
    rng = np.random.default_rng(6)
    payloads = [bytes(range(256)) * 3, b"\x80" * 384, (b"\x80" * 63 + b"\xff") * 15, b"\xff" * 1728, rng.integers(0, 256, 192 * 37, dtype=np.uint8).tobytes()]
    files = jpeg.encode(payloads)
    sub = [subsampled(w, h, rng) for w, h in ((16, 16), (50, 35), (33, 64))]
    read = jpeg.decode([*files, *[f for f, _ in sub]])
    assert [jpeg.payload(d) for d in read[:5]] == payloads
    for f, d in zip([*files, *[f for f, _ in sub]], read, strict=True):
        assert (d.blocks == slow_decode(f)).all()
        assert (jpeg.decode([f], dc_only=True)[0].blocks[:, 0] == d.blocks[:, 0]).all()
    for (_, values), d in zip(sub, read[5:], strict=True):
        assert (d.blocks == values).all()
        assert jpeg.thumbnail(d).shape == (-(-d.scan.height // 8), -(-d.scan.width // 8))
    first = values[:, 0].reshape(-1, 6)
    assert jpeg.thumbnail(read[-1])[1, 1] == np.clip(first[0, 3] + 128, 0, 255)


@pytest.mark.parametrize("raw", [b"", b"\xff\xd8\xff", b"\xff\xd8\xff\xc2\x00\x04xx\xff\xd9", jpeg.encode([b"x" * 1920])[0][:-60]])
def test_bad_jpeg(raw):
    with pytest.raises(ValueError):
        jpeg.decode([raw])


# --- 6: near-duplicates -----------------------------------------------------------------------------------------------
def slow_fingerprint(text):
    words = re.findall(SPACE, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, most=4):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= most and root(i) != root(j):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def test_near_duplicates(make):
    rng = random.Random(7)
    texts = [*AWKWARD]
    for _ in range(12):
        words = prose(rng, 300).split()
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(300)] = "changed"
            texts.append(" ".join(copy))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(make(texts)).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == classes(fps)


@pytest.mark.parametrize("chain", [2, 3])
def test_ring_links_lose_nothing(spark, chain):
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        fps |= {f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(8)}
    dense = rng.getrandbits(64)  # more than BLOCK members of one bucket
    fps |= {dense ^ (1 << a | 1 << b) for a, b in itertools.combinations(range(14, 64), 2)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, rep long")
    scratch = Scratch(spark, "t")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(table, chain), scratch).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == classes(fps)


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(edges, Scratch(spark, "t")).collect()}
    assert roots == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_near_duplicates_awkward(awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count() and simhash.near_duplicates(awkward.limit(0)).count() == 0
    by_id = collections.defaultdict(set)
    for r in rows:
        by_id[r["doc_id"]].add(r["component_id"])
    assert all(len(v) == 1 for k, v in by_id.items() if k is not None)


# --- 7: repeated passages ---------------------------------------------------------------------------------------------
def cut_repeats(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[p : p + length] for x in raws for p in range(len(x) - length + 1))
    out = []
    for x in raws:
        mark = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        kept = bytes(v for v, m in zip(x, mark, strict=True) if not m)
        runs = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((len(x), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passages():
    rng = random.Random(9)
    shared = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(150, 900))) for _ in range(8)]
    line = "a common line that is long enough to be an anchor by itself, is it not? " * 2
    texts = []
    for i in range(120):
        t = "".join(rng.choice("xyzuvw \n") for _ in range(rng.randint(0, 700)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            t += p[rng.randint(0, 50) : len(p) - rng.randint(0, 50)] + "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 90)))
        texts.append(t + (line + "".join(rng.choice("mnopq") for _ in range(rng.randint(0, 300))) if i % 2 else ""))
    return [*texts, texts[0], texts[5], "", None, "q" * 1000, "ab" * 300, "z" * 60_000 + "y", *AWKWARD]


@pytest.mark.parametrize(("hot", "common"), [(50_000, 10**9), (5, 10**9), (1, 10**9), (50_000, 3), (1, 2)])
def test_repeated_bytes(make, monkeypatch, hot, common):
    texts = passages()
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (hot,))
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.repeated_bytes(make(texts).repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == cut_repeats(texts)


def test_repeated_bytes_awkward(awkward):
    rows = awkward.select("doc_id", "text").collect()
    expected = sorted(map(str, zip([r[0] for r in rows], cut_repeats([r[1] for r in rows]), strict=True)))
    assert sorted(str((r["doc_id"], tuple(r)[1:])) for r in suffix_dedup.repeated_bytes(awkward).collect()) == expected
    assert suffix_dedup.repeated_bytes(awkward.limit(0)).count() == 0
    assert suffix_dedup.remove_repeats(awkward).columns == awkward.columns


def test_pieces_of_long_rows(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    offsets = np.array([0, 100, 100, 2000, 2300, 2301])
    covered = collections.Counter(p for _, _, x, y in suffix_dedup._pieces_of(offsets, 200) for p in range(x, y - 199))
    assert all(covered[p] for a, b in itertools.pairwise(offsets.tolist()) for p in range(a, b - 199))


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefgh"])
@pytest.mark.parametrize("bits", [63, 1])
def test_suffix_order(alphabet, bits, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "KEY_BITS", bits)
    rng = random.Random(10)
    raw = np.frombuffer(bytes(rng.choice(alphabet.encode()) for _ in range(900)) * 2, np.uint8)
    positions = np.arange(len(raw) - 230)
    for bucket in (np.zeros(len(positions), np.int64), positions % 3, positions % 7, positions % 7 + positions % 2 * 7):
        order = suffix_dedup.suffix_order(suffix_dedup._Big(raw), np.arange(len(raw)) + 3, positions, bucket, 200)
        keys = [(bucket[p], raw[p : p + 200].tobytes()) for p in positions[order]]
        assert keys == sorted(keys)
    hit = suffix_dedup.repeated_positions(raw, np.arange(len(raw)), positions, np.zeros(len(positions), np.int64))
    seen = collections.Counter(raw[p : p + 200].tobytes() for p in positions)
    assert hit.tolist() == [seen[raw[p : p + 200].tobytes()] > 1 for p in positions]


def test_window_hashes_do_not_depend_on_place():
    raw = np.frombuffer(b"xxabcabcyyabc", np.uint8)
    sums = rolling.prefix_sums(raw)
    h = rolling.window_hashes(sums, np.array([2, 5, 10, 0]), np.array([5, 8, 13, 3]))
    assert h[0] == h[1] == h[2] != h[3]


# --- 8: chat ----------------------------------------------------------------------------------------------------------
def legal(roles):
    roles = roles[1:] if roles[:1] == [1] else roles
    return bool(roles) and len(roles) % 2 == 0 and all(r == (2, 3)[i % 2] for i, r in enumerate(roles))


def cheapest(roles):
    best = None
    price = lambda given, r: 0 if given == r else 3 if given else 1

    def go(i, seq, cost):
        nonlocal best
        if best is not None and cost >= best:
            return
        if i == len(roles):
            for k in range(3):
                for more in itertools.product((2, 3), repeat=k):
                    if legal(seq + list(more)) and (best is None or cost + 2 * k < best):
                        best = cost + 2 * k
            return
        if seq:
            go(i + 1, seq, cost + 1 + price(roles[i], seq[-1]))
        for k in range(3):
            for more in itertools.product((1, 2, 3), repeat=k):
                for r in (1, 2, 3):
                    go(i + 1, [*seq, *more, r], cost + 2 * k + price(roles[i], r))

    go(0, [], 0)
    return best


def price_of(roles, moves):
    total = sum(2 * len(ins) + ("merge" in name) + (0 if g == r else 3 if g else 1) for g, (r, name, ins) in zip(roles, moves, strict=True))
    return total + 2 * len(chat.ENDING[moves[-1][0]])


def test_repairs_are_cheapest_and_legal():
    for n in (1, 2, 3):
        for roles in itertools.product(range(4), repeat=n):
            moves = chat.repair(list(roles))
            assert price_of(roles, moves) == cheapest(list(roles)), roles
            text = "".join(chat.fragments(["t"] * n, moves, 0, True))
            heads = [chat.KNOWN[x.split("\n", 1)[0]] for x in text.split("<|im_start|>")[1:]]
            assert legal(heads) and text.count("<|im_end|>") == len(heads) == text.count("<|im_start|>")


def test_conversations(spark):
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, " User "]), f"x{t}") for c in range(25) for t in range(rng.randint(1, 6))]
    rows += [(777, t, rng.choice(["user", "assistant", "system"]), f"y{t}") for t in range(150)] + [(None, 1, "user", "n"), (None, None, None, None), (3, 0, "user", "x0"), (3, 0, "user", "x0")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, key string").repartition(3)
    got = collections.defaultdict(list)
    for r in chat.repair_conversations(df, 7).collect():
        got[r["conv_id"]].append(r)
    order = lambda r: tuple((v is not None, v if v is not None else "") for v in r)
    given = collections.defaultdict(list)
    for c, *rest in sorted(rows, key=order):
        given[c].append(rest)
    assert sum(map(len, got.values())) == len(rows)
    for c, turns in given.items():
        mine = sorted(got[c], key=lambda r: r["place"])
        assert [r["place"] for r in mine] == list(range(len(turns)))
        assert [(r["turn"], r["role"]) for r in mine] == [(t, r) for t, r, _ in turns]
        moves = chat.repair([chat.role_of(r) for _, r, _ in turns])
        assert [(chat.KNOWN[r["new_role"]], r["operation"], tuple(chat.KNOWN[x] for x in r["inserted"].split(",") if x)) for r in mine] == moves
        assert [r["inserted_after"] for r in mine] == [""] * (len(turns) - 1) + [",".join(chat.ROLES[x] for x in chat.ENDING[moves[-1][0]])]
        whole = "".join(r["fragment"] for r in mine)
        assert whole == "".join(chat.fragments([t or "" for _, _, t in turns], moves, 0, True))
        assert legal([chat.KNOWN[x.split("\n", 1)[0]] for x in whole.split("<|im_start|>")[1:]])
    assert chat.repair_conversations(df.limit(0)).count() == 0


def test_repair_does_not_depend_on_cuts():
    rng = random.Random(5)
    for _ in range(4000):
        roles = [rng.randint(0, 3) for _ in range(rng.randint(2, 8))]
        whole = chat.repair(roles)
        cuts = [[c] for c in range(1, len(roles))] + [sorted(rng.sample(range(1, len(roles)), rng.randint(1, len(roles) - 1)))]
        for cut in cuts:
            parts = [roles[a:b] for a, b in zip([0, *cut], [*cut, len(roles)])]  # noqa: B905
            ends = chat.borders([chat.segment_matrix(x) for x in parts])
            assert [m for x, (first, last) in zip(parts, ends, strict=True) for m in chat.repair(x, first, last)] == whole, (roles, cut)


# --- 9: classifier ----------------------------------------------------------------------------------------------------
def texts_and_labels(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = prose(rng, rng.randint(30, 150))
        out.append((t, 1) if i % 3 else (t.upper().replace(" ", "!! "), 0))
    return out


def test_gradients_match_differences():
    rng = np.random.default_rng(12)
    texts = [x[0].encode() for x in texts_and_labels(6, 1)]
    good, weight = np.array([1, 0, 1, 1, 0, 1]), np.ones(6)
    x = byte_cnn.lay(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    net = byte_cnn.Net.start(1)
    for p in net.parts():
        p += rng.normal(0, 0.05, p.shape).astype(np.float32)
    _, grads = byte_cnn.gradients(net, x, good, weight)
    for part, grad in zip(net.parts(), grads, strict=True):
        if not grad.any():  # nothing is repeated here, and the entry for that alone is learned
            continue
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        keep, step = part[at], np.float32(1e-2)
        part[at] = keep + step
        up, _ = byte_cnn.gradients(net, x, good, weight)
        part[at] = keep - step
        down, _ = byte_cnn.gradients(net, x, good, weight)
        part[at] = keep
        assert (up - down) / (2 * step) == pytest.approx(grad[at], rel=0.15, abs=2e-3)


def slow_score(net, text):
    """The network's probability for one text, place by place in plain Python."""
    hops = max(1, -(-(len(text) + byte_cnn.WIDTH - 1) // 256))
    padded = text + bytes(hops * 256 - len(text))
    best = []
    for hop in range(hops):
        top = [-float("inf")] * 16
        for p in range(hop * 256, min(hop * 256 + 256, len(padded) - byte_cnn.WIDTH + 1)):
            echo = int(p + 8 <= len(text) and text.find(text[p : p + 8]) < p)
            for f in range(16):
                x = float(net.echo[echo, f]) + float(net.bias[f]) + sum(float(net.tables[j, padded[p + j], f]) for j in range(byte_cnn.WIDTH))
                top[f] = max(top[f], x)
        best.append(top)
    chunks = [[max(0.0, *(x[f] for x in best[i : i + 2])) for f in range(16)] for i in range(max(1, hops - 1))]
    mean, most = [sum(c[f] for c in chunks) / len(chunks) for f in range(16)], [max(c[f] for c in chunks) for f in range(16)]
    z = sum(float(w) * x for w, x in zip(net.weights, [*mean, *most, 1.0], strict=True))
    return 1 / (1 + math.exp(-z))


def test_scores_by_brute_force():
    rng = random.Random(29)
    texts = [b"", b"a", b"abcdefgh" * 3, "naïve Über".encode(), *(prose(rng, n).encode() for n in (40, 90, 160, 300)), b"x" * 252, b"y" * 251, bytes(range(256)) * 3]
    net = byte_cnn.Net.start(5)
    net.echo[1] = np.linspace(-1, 1, 16)
    net.bias += np.linspace(-0.5, 0.5, 16).astype(np.float32)
    whole = np.frombuffer(b"".join(texts), np.uint8)
    got = net.score(byte_cnn.lay(whole, np.cumsum([0, *map(len, texts)])))
    assert got == pytest.approx([slow_score(net, t) for t in texts], abs=1e-5)


def test_long_texts_are_scored_in_parts():
    rng = random.Random(31)
    text = np.frombuffer((prose(rng, 3000) + prose(rng, 50) * 3).encode(), np.uint8)
    net, ends = byte_cnn.Net.start(6), np.array([0, len(text)])
    whole, parted = byte_cnn.lay(text, ends), byte_cnn.lay(text, ends, 1000)
    assert (whole.echo == parted.echo).all() and whole.echo.any()
    assert net.score(whole) == net.score(parted)


def test_of_repeated_ids_one_text_is_learned(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "c" * 20), (3, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0)], "doc_id long, quality int")
    texts, good = byte_cnn.labelled_sample(docs, labels, "true", 10, 100, 19)
    assert sorted(zip(texts, good.tolist(), strict=True)) == [(b"", 1), (b"d", 0)]


def test_classifier_held_out(spark, make, awkward):
    rows = texts_and_labels(500, 13)
    docs = make([t for t, _ in rows])
    labels = spark.createDataFrame([(i, q, 0) for i, (_, q) in enumerate(rows)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in byte_cnn.classify(docs, labels).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [(r["score"], rows[i][1], r["predicted"]) for i, r in got.items() if r["held_out"]]
    assert sum((s >= 0.3) == bool(q) == bool(p) for s, q, p in held) / len(held) > 0.95
    odd = byte_cnn.classify(awkward, labels.where("doc_id >= 0")).collect()
    assert len(odd) == awkward.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert byte_cnn.classify(awkward.limit(0), labels.limit(0)).count() == 0


def test_scores_do_not_depend_on_the_batch():
    texts = [(x or "").encode() for x in AWKWARD]
    net = byte_cnn.Net.start(3)
    lay = lambda part: byte_cnn.lay(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in part])]))
    assert np.allclose(net.score(lay(texts)), [net.score(lay([t]))[0] for t in texts], atol=1e-5)


# --- 10: pieces -------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("head", [1 << 18, 5])
def test_pieces_match_the_library(awkward, spark, head):
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=PIECES)
    out = pieces.decode(pieces.encode(awkward.withColumn("text", F.coalesce("text", F.lit(""))), PIECES, Scratch(spark, "t"), head=head), PIECES).collect()
    assert [r["piece_ids"] for r in out] == lib.encode([r["text"] for r in out])
    assert all(r["decoded"] == r["text"].replace("▁", " ") for r in out)
    assert pieces.encoded_documents(awkward.limit(0), PIECES).count() == 0
    assert pieces.encoded_documents(awkward, PIECES).where("not round_trip").count() == 0


def test_long_texts_are_encoded_in_parts(make, spark, monkeypatch):
    from sentencepiece import SentencePieceProcessor

    rng = random.Random(23)
    texts = [prose(rng, 400), "  two  spaces " * 40, "x" * 900 + " " + "y" * 300, "", " ", "a b"]
    m = pieces.model(PIECES)
    parts, row = m.parts(texts, 50)
    assert max(map(len, parts)) > 100 and ["".join(p for p, r in zip(parts, row, strict=True) if r == i) for i in range(len(texts))] == ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
    coder = pieces._Encoder(m, pieces._Table.of([]))
    ids = [sum((coder.ids([p])[0].tolist() for p, r in zip(parts, row, strict=True) if r == i), []) for i in range(len(texts))]
    assert ids == SentencePieceProcessor(model_file=PIECES).encode(texts)
    flat, ends = np.array(sum(ids, [])), np.cumsum([0, *map(len, ids)])
    assert [x.decode() for x in pieces.spelled(m, flat, ends, 7)] == texts


def test_viterbi_against_all_paths(spark):
    scores = {"a": -1.0, "b": -1.5, "ab": -1.2, "ba": -2.0, "aba": -3.5, "bb": -1.1, "abb": -2.0}
    found = {p: (i, s) for i, (p, s) in enumerate(scores.items())}
    order = sorted(found, key=lambda p: (-found[p][1], found[p][0]))
    table = spark.createDataFrame([(p, found[p][0], r, found[p][1]) for r, p in enumerate(order)], "piece string, id int, rank long, score double")
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("abx", repeat=n)]

    def paths(w):
        if not w:
            return [([], 0.0)]
        out = [([w[0], *p], s - 20.0) for p, s in paths(w[1:])] if w[0] not in scores else []
        for piece, score in scores.items():
            if w.startswith(piece):
                out += [([piece, *p], s + score) for p, s in paths(w[len(piece) :])]
        return out

    units = spark.createDataFrame([(w, 1) for w in words], "unit string, n long")
    got = pieces.lattice(units, table, 3).withColumn("m", pieces.viterbi_borders(F.col("edges"), F.length("unit"), -20.0)).collect()
    for r in got:
        cuts = [i for i in range(len(r["unit"]) + 1) if r["m"] >> i & 1]
        mine = [r["unit"][a:b] for a, b in itertools.pairwise(cuts)]
        assert sum(scores.get(p, -20.0) for p in mine) == pytest.approx(max(s for _, s in paths(r["unit"])))


def unigram_model(file, fallback):
    """A unigram model written by hand: pieces of syllables with scores in quarters, so that sums are exact."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    proto.trainer_spec.byte_fallback = fallback
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    proto.normalizer_spec.escape_whitespaces = True
    kind = proto.SentencePiece
    listed = [("<unk>", 0.0, kind.UNKNOWN), ("<s>", 0.0, kind.CONTROL), ("</s>", 0.0, kind.CONTROL)]
    listed += [(f"<0x{b:02X}>", 0.0, kind.BYTE) for b in range(256)] if fallback else []
    rng = random.Random(17)
    letters = "antherosiply"
    found = {*letters, "▁", *["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(250)], "ing", "th", "er", "an", "the", "re", "on"}
    found |= {"▁" + x for x in list(found)[:150] if x != "▁"}
    listed += [(x, -rng.randint(4, 60) / 4, kind.NORMAL) for x in sorted(found)]
    for piece, score, type_ in listed:
        proto.pieces.add(piece=piece, score=score, type=type_)
    file.write_bytes(proto.SerializeToString())
    return str(file)


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_models_go_through_the_viterbi_fold(make, spark, tmp_path, fallback):
    from sentencepiece import SentencePieceProcessor

    path = unigram_model(tmp_path / "unigram.model", fallback)
    rng = random.Random(19)
    texts = ["", "the", "  anther  on ", "x\ny zz", "naïve the漢字 the", "a" * 70 + " the " + "z" * 80, *[prose(rng, rng.randint(1, 60)) for _ in range(60)]]
    lib = SentencePieceProcessor(model_file=path)
    for head in (1 << 18, 3):
        out = pieces.encode(make(texts), path, Scratch(spark, "t"), head=head).collect()
        assert [r["piece_ids"] for r in out] == lib.encode([r["text"] for r in out])


def test_colliding_units_get_their_own_ids(make, spark):
    """Two words of 1024 letters that every polynomial hash modulo 2^64 takes for one."""
    word = lambda a, b: "".join((a, b)[i.bit_count() & 1] for i in range(1024))
    twins = [word("a", "b"), word("b", "a")]
    raw = np.frombuffer("".join(twins).encode(), np.uint8)
    sums = rolling.prefix_sums(raw)
    assert len(set(rolling.window_hashes(sums, np.array([0, 1024]), np.array([1024, 2048])).tolist())) == 1
    texts = [*twins, " ".join(twins), " ".join(twins[::-1])]
    whole = "".join(texts).encode()
    got = bpe.IdCache(BPE).encode(np.frombuffer(whole, np.uint8), np.cumsum([0, *map(len, texts)]))
    assert [x.tolist() for x in got] == [bpe.tokenizer(BPE).encode(t, add_special_tokens=False).ids for t in texts]
    from sentencepiece import SentencePieceProcessor

    out = pieces.encode(make(texts), PIECES, Scratch(spark, "t")).collect()
    assert [r["piece_ids"] for r in out] == SentencePieceProcessor(model_file=PIECES).encode([r["text"] for r in out])


def test_spans_with_equal_keys_are_told_apart():
    raw = np.frombuffer(b"abcabdabcabd" + b"x" * 300 + b"x" * 299 + b"y", np.uint8)
    start, size = np.array([0, 3, 6, 9, 0, 12, 312]), np.array([3, 3, 3, 3, 4, 300, 300])
    strings = [raw[a : a + n].tobytes() for a, n in zip(start, size, strict=True)]
    for keys in (None, np.zeros(len(start), np.uint64)):
        at, which, counts = rolling.distinct_spans(rolling.Words(raw), start, size, keys)
        assert [strings[at[w]] for w in which] == strings and len(at) == len(set(strings))
        assert counts.tolist() == [strings.count(strings[i]) for i in at]


def test_lattice_makes_no_substring_longer_than_pieces_that_start_so(spark):
    pieces_ = ["a", "ab", "abc", "abcde", "bcd", "xyzz", "é", "éa"]
    table = spark.createDataFrame([(p, i, i) for i, p in enumerate(pieces_)], "piece string, id int, rank long")
    words = ["abcdefab", "xyz", "éab", "q", "zzzzxyzz"]
    got = pieces.lattice(spark.createDataFrame([(w, 1) for w in words], "unit string, n long"), table, 5)
    assert got._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 2
    place = lambda e: ((e >> 26) & 63, (e >> 20) & 63, e & ((1 << 20) - 1))
    want = {w: sorted((i, len(p), j) for j, p in enumerate(pieces_) for i in range(len(w)) if w.startswith(p, i)) for w in words}
    assert {r["unit"]: sorted(map(place, r["edges"])) for r in got.collect()} == want
