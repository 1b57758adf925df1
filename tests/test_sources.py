"""The file source and the change stream."""

import os
import time

from docloom.sources import corpus, mdcorpus
from docloom.streaming import watch


def tree(root):
    for path, raw in {
        "a.md": b"---\nid: 1\n---\n", "_archived/x.md": b"old", "_summaries/y.md": b"sum", ".hidden.md": b"h", "TRAP_z.md": b"t", "note.txt": b"n", "bad.md": b"\xff\xfe",
        "crlf.md": b"---\r\nid: 2\r\n---\r\n", "empty.md": b"", "d/e/f.md": b"deep",
    }.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(raw)
    (root / "link.md").symlink_to(root / "a.md")


def test_scan(spark, tmp_path):
    tree(tmp_path)
    mdcorpus.register(spark)
    read = lambda **o: {r["path"]: r for r in spark.read.format("mdcorpus").options(path=str(tmp_path), **o).load().collect()}
    rows = read()
    assert sorted(rows) == [".hidden.md", "TRAP_z.md", "_archived/x.md", "_summaries/y.md", "a.md", "crlf.md", "d/e/f.md", "empty.md", "link.md"]
    assert rows["link.md"]["is_symlink"] and rows["empty.md"]["size"] == 0
    assert "_archived/x.md" not in read(root_only="true") and ".hidden.md" not in read(include_hidden="false")
    assert "TRAP_z.md" not in read(skip_prefixes="TRAP_;TEST_") and "d/e/f.md" not in read(exclude="/e/") and "d/e/f.md" not in read(max_depth="2")
    docs = corpus.documents(spark.read.format("mdcorpus").option("path", str(tmp_path)).load())
    assert {r["path"]: r["doc_id"] for r in docs.collect()}["crlf.md"] == "2"


def test_stream_of_events(spark, tmp_path):
    root, state = tmp_path / "c", tmp_path / "s"
    root.mkdir()
    mdcorpus.register(spark)
    (root / "a.md").write_text("one")
    got = []
    files = spark.readStream.format("mdcorpus").option("path", str(root)).load()
    q = watch.watch(files, lambda df, n: got.extend((r["path"], r["kind"]) for r in df.collect()), str(state))
    try:
        q.processAllAvailable()
        (root / "b.md").write_text("two")
        os.utime(root / "a.md", (time.time() + 5, time.time() + 5))
        q.processAllAvailable()
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(got) == [("a.md", "created"), ("a.md", "modified"), ("b.md", "created")]


def test_between(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1)], "path string, mtime long")
    b = spark.createDataFrame([("x", 1), ("y", 2), ("z", 1)], "path string, mtime long")
    assert sorted(tuple(r) for r in watch.between(a, b).collect()) == [("y", "modified"), ("z", "created")]
