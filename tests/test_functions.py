import pytest
from pyspark.sql import functions as F

from docloom.functions import frontmatter as Y
from docloom.functions import ids as I
from docloom.functions import links as L
from docloom.functions import text as T


@pytest.fixture
def value(spark):
    def of(x, column, kind="string"):
        return spark.createDataFrame([(x,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]

    return of


@pytest.mark.parametrize(("text", "expected"), [("a\nb\n", ["a", "b"]), ("a\r\nb", ["a", "b"]), ("", []), ("\n", [""]), ("a\n\n", ["a", ""])])
def test_lines(value, text, expected):
    assert value(text, T.lines) == expected


@pytest.mark.parametrize(("text", "expected"), [("", 0), ("  ", 0), ("a b c\n\td", 4), ("one", 1)])
def test_words(value, text, expected):
    assert value(text, T.words) == expected


def test_volatile_lines_do_not_change_the_hash(value):
    a = value("---\nid: 1\nlast_updated: x\n---\nbody\n", T.stable_hash)
    assert a == value("---\nid: 1\nlast_updated: y\ncontent_hash: z\nfile_create: q\n---\nbody", T.stable_hash)
    assert a != value("---\nid: 1\n---\nother", T.stable_hash)
    assert value("  last_updated: x\nb", lambda c: T.stable_hash(c, trimmed=True)) == value("b", T.stable_hash)


@pytest.mark.parametrize(
    ("content", "expected"),
    [
        ("---\nid: 1\n---\n", "1"), ('---\nid: "1.2"\n---\n', "1.2"), ("---\nid:\nid: 3\n---\n", "3"), ("---\nid: ''\nid: 4\n---\n", "4"),
        ("no", None), ("---\nother: 1\n---\n", None), ("---\r\nid: 5\r\n---\r\n", "5"), ("---\ntitle: a---b\nid: 1\n---\n", None),
    ],
)
def test_yaml_field(value, content, expected):
    assert value(content, lambda c: Y.field(Y.yaml_text(c), "id")) == expected


def test_bodies(value):
    doc = "---\nid: 1\n---\n\nbody text\n"
    assert value(doc, Y.body) == "\n\nbody text\n"
    assert value(doc, Y.body_after_line) == "body text"
    assert value("plain", Y.body) == value("plain", Y.body_after_line) == "plain"


def test_field_edits(value):
    doc = "---\nid: 1\nstatus: old\n---\nstatus: kept\n"
    assert value(doc, lambda c: Y.update_field(c, "status", F.lit("new"))) == "---\nid: 1\nstatus: new\n---\nstatus: kept\n"
    assert value(doc, lambda c: Y.add_field(c, "x", F.lit("1"))) == "---\nid: 1\nstatus: old\nx: 1\n---\nstatus: kept\n"
    assert value(doc, lambda c: Y.add_first_field(c, "x", F.lit("1"))) == "---\nx: 1\nid: 1\nstatus: old\n---\nstatus: kept\n"
    assert value(doc, lambda c: Y.add_first_field(c, "status", F.lit("1"))) == doc
    assert value(doc, lambda c: Y.remove_field(c, "status")) == "---\nid: 1\n---\n"
    assert value("plain", lambda c: Y.add_field(c, "x", F.lit("1"))) == "plain"


def test_prose_words_leave_fences_out(value):
    assert value("# Head\n\nsome *bold* words\n```\nnot these\n```\nend", Y.count_prose_words) == 5


def test_extract_links(value):
    text = "é [[a]] [[b|alias]] [t](f.md) [x](https://e.org) ![[i.png]] ![alt](i.jpg) [[a]]"
    found = value(text, L.extract)
    assert [(x["link_type"], x["target"], x["text"]) for x in found] == [
        ("wiki", "a", None), ("wiki", "b", "alias"), ("markdown", "f.md", "t"), ("external", "https://e.org", "x"), ("embed", "i.png", None), ("md_embed", "i.jpg", "alt"), ("wiki", "a", None),
    ]
    assert [text.encode()[x["position"] :].startswith(x["raw"].encode()) for x in found] == [True] * 7


def test_normalized_targets(value):
    norm = lambda kind: lambda c: L.normalized(c, F.lit(kind))
    assert value("doc#part", norm("wiki")) == "doc.md"
    assert value("a.png", norm("wiki")) == "a.png"
    assert value("doc", norm("embed")) == "doc"
    assert value("x\\|y", L.bare_name) == "x"


def test_link_conversion(value):
    assert value("[[a]] [[b|c]] ![[d]]", L.to_markdown) == "[a](a.md) [c](b.md) ![[d]]"
    assert value("[[a]] [[a|x]] [t](a.md) [[ab]]", lambda c: L.rename(c, "a", "z")) == "[[z]] [[z|x]] [t](z.md) [[ab]]"


def test_ids(value):
    assert value("1.02.3", I.parts) == [1, 2, 3]
    assert value("1.x", I.parts) is None
    assert value("1.2.3", I.parent) == "1.2" and value("1", I.parent) is None
    assert value("1.2.3", I.ancestors) == ["1", "1.2"] and value("1", I.ancestors) == []
    assert value("1.2. name", I.numeric_prefix) == "1.2" and value("name", I.numeric_prefix) is None
    assert value("A > B >  > C", I.breadcrumb) == ["A", "B", "C"]


def test_labels(value):
    assert value(1536, T.file_size_label, "long") == "1.50 KB" and value(12, T.file_size_label, "long") == "12 B"
    assert value(59.0, T.age_label, "double") == "59s" and value(7200.0, T.age_label, "double") == "2h"
    assert value("same", lambda c: T.similarity(c, F.lit("same"))) == 1.0


@pytest.mark.parametrize(("text", "good"), [("2024-01-02", True), ("2024-01-02 03:04:05", True), ("2024-01-02T03:04:05Z", True), ("soon", False)])
def test_parse_date(value, text, good):
    assert (value(text, Y.parse_date) is not None) == good
