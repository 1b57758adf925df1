"""The pipeline's stages, and all of it against the same steps by brute force."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from .conftest import prose
from .test_operators import PIECES, base, classes, slow_fingerprint


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    shared = prose(rng, 70)
    texts = []
    for i in range(120):
        t = prose(rng, rng.randint(25, 120))
        texts.append(f"{t} {shared} {prose(rng, 5)}" if i % 10 == 0 else t)
    near = prose(rng, 200).split()
    for i in range(5):
        copy = list(near)
        copy[7 * i] = "edit"
        texts.append(" ".join(copy))
    texts += [texts[3], texts[4], "too short", None, "", "# | $ " * 40]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    root = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), texts


def raw_cut(texts):
    """What is left of each text's bytes, as text."""
    import collections

    raws = [t.encode() for t in texts]
    seen = collections.Counter(x[p : p + 200] for x in raws for p in range(len(x) - 199))
    out = []
    for x in raws:
        gone = {q for p in range(len(x) - 199) if seen[x[p : p + 200]] > 1 for q in range(p, p + 200)}
        out.append(bytes(v for i, v in enumerate(x) if i not in gone).decode(errors="ignore"))
    return out


def test_stages(corpus, spark):
    from sentencepiece import SentencePieceProcessor

    root, texts = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    out = corpus_pipeline.quality(spark, docs, root)
    assert out.columns == docs.columns
    kept = sorted(r["doc_id"] for r in out.collect())
    assert kept == [i for i, t in enumerate(texts) if not base(t)[5]]  # too few labels for any further cutoff
    out = corpus_pipeline.near_dedup(spark, out, root)
    groups = classes([slow_fingerprint(texts[i]) for i in kept])
    kept = [i for k, i in enumerate(kept) if groups[k] == k]
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == kept
    out = corpus_pipeline.passage_dedup(spark, out, root)
    left = dict(zip(kept, raw_cut([texts[i] for i in kept]), strict=True))
    assert out.columns == docs.columns and {r["doc_id"]: r["text"] for r in out.collect()} == left
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect()) and any(left[i] != texts[i] for i in kept)
    mixed = corpus_pipeline.mixing(spark, out, root)
    assert mixed.columns == docs.columns
    drawn = sorted(r["doc_id"] for r in mixed.collect())
    assert set(drawn) <= set(kept) and 0.5 * len(kept) < len(drawn) < 1.5 * len(kept)
    encoded = corpus_pipeline.encoding(spark, mixed, root).collect()
    lib = SentencePieceProcessor(model_file=PIECES)
    assert sorted(r["doc_id"] for r in encoded) == drawn
    assert all(r["piece_ids"] == lib.encode(left[r["doc_id"]]) and r["n_pieces"] == len(r["piece_ids"]) for r in encoded)
    run = corpus_pipeline.run(spark, root).select("doc_id", "n_pieces").collect()
    assert sorted(map(tuple, run)) == sorted((r["doc_id"], r["n_pieces"]) for r in encoded)


def test_repeated_and_null_ids(spark, corpus):
    root, texts = corpus
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[2]), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_dedup(spark, corpus_pipeline.quality(spark, docs, root), root)
    assert sorted(r["text"] for r in out.collect()) == sorted([texts[0], texts[1], texts[2]])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), root).count() == 0
    assert corpus_pipeline.passage_dedup(spark, docs.withColumn("row", F.lit(1)), root).columns == [*docs.columns, "row"]
