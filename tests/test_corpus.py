"""Phases, rules, links, graph and rewrites over a small hand-written corpus with known answers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docloom.operators import diff, export, graph, links, lint, registry, rewrite, schema, search, stats, verify
from docloom.sources import corpus


def doc(id_, title, parent, body, extra="", kind="hoja", status="activo"):
    return f"---\nid: {id_}\ntitle: {title}\nparent: {parent}\nbreadcrumb: A > {id_}\ntype: {kind}\nstatus: {status}\n{extra}---\n{body}"


WORDS = " ".join(["word"] * 60)
FILES = {
    "0. Master.md": doc("0", "Master", "0", WORDS + "\n"),
    "1 One.md": doc("1", "One", "0", f"# One\n[[1.1 Sub]] {WORDS}\n| Doc | Nietos |\n|---|---|\n| [[1 One]] | 5 |\n", "parent_id: Nowhere\nchildren_count: 2\n"),
    "1.1 Sub.md": doc("1.1", "Sub", "1", f"# Sub\n### Deep\n{WORDS}\n```\ncode\n```\n# Sub\n", "parent_id: X1\n"),
    "1.2 Two.md": doc("1.2", "sub", "1", "TODO ![[gone]] ![](no.png) [[1.1 sub]] [[nothing]]  \nend", 'content_hash: "abc"\nlast_updated: 2020-01-01\n'),
    "d/9.9 Lost.md": doc("1.2", "Lost", "7.7", f"{WORDS}\n| a | b |\n| 1 | 2 |\nafter [[d/x|y]]\n```mermaid\nfoo\n```\n```\n", kind="raro", status="odd"),
    "d/none.md": "just text\n",
    "TRAP_x.md": "bad",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(p, c, datetime(2024, 1, 1)) for p, c in FILES.items()]
    all_ = corpus.documents(spark.createDataFrame(rows, "path string, content string, mtime timestamp"))
    return corpus.without_tests(all_).cache()


def paths(df):
    return sorted(r["path"] for r in df.collect())


@pytest.mark.parametrize(
    ("phase", "expected"),
    [
        (1, []), (2, ["d/none.md"]), (3, ["1.2 Two.md"]), (4, ["d/9.9 Lost.md"]), (5, []), (6, ["d/9.9 Lost.md"]), (7, ["d/9.9 Lost.md"]), (8, ["1.2 Two.md"]),
        (9, ["1.2 Two.md", "1.2 Two.md", "1.2 Two.md", "d/9.9 Lost.md"]), (10, ["1.2 Two.md"]), (11, ["1.2 Two.md"]), (12, ["d/9.9 Lost.md"]), (13, ["d/9.9 Lost.md"]),
        (14, ["d/9.9 Lost.md"]), (15, ["1.1 Sub.md", "1.1 Sub.md"]), (16, ["1.2 Two.md", "d/none.md"]), (17, ["1.2 Two.md"]), (18, ["1.1 Sub.md"]), (20, []), (21, ["1.2 Two.md"]),
    ],
)
def test_phases(docs, phase, expected):
    assert paths(verify.PHASES[phase][1](docs)) == expected


def test_case_errors_and_broken_links(docs):
    found = {(r["severity"], r["detail"]) for r in verify.internal_links(docs).where("path = '1.2 Two.md'").collect()}
    assert found == {("error", "1.1 sub -> 1.1 Sub"), ("warning", "nothing"), ("warning", "gone")}


def test_phase_names():
    assert verify.phase_number("21") == 21 and verify.phase_number("LINKS") == 9 and verify.phase_number("22") is None and verify.phase_number("x") is None


def test_summary_has_every_phase(docs):
    rows = verify.summary(docs).collect()
    assert len(rows) == 21 and not [r for r in rows if r["phase"] == 4][0]["passed"]
    assert len(verify.summary(docs, quick=True).collect()) == 18


def test_empty_corpus_fails_the_first_phase(docs):
    assert verify.file_count(docs.limit(0)).count() == 1


@pytest.mark.parametrize(
    ("rule", "expected"),
    [
        ("L001", [("d/none.md", 1)]), ("L002", [("1.1 Sub.md", 11)]), ("L003", [("1.2 Two.md", 11)]), ("L004", [("1.2 Two.md", None)]), ("L005", []),
        ("L006", [("1.1 Sub.md", 13), ("d/9.9 Lost.md", 16)]), ("L007", [("1.1 Sub.md", 16)]), ("L008", []), ("L009", [("d/9.9 Lost.md", 10)]),
        ("L010", [("1.2 Two.md", 11)]), ("L011", []), ("L012", []), ("L013", [("1 One.md", 15)]), ("L014", []),
    ],
)
def test_rules(docs, rule, expected):
    assert sorted((r["path"], r["line"]) for r in lint.RULES[rule](docs).collect()) == expected


def test_fix_settles_what_it_can(docs):
    fixed = rewrite.lint_fix(docs)
    again = corpus.documents(fixed.withColumn("mtime", F.current_timestamp()))
    assert lint.trailing_whitespace(again).count() == lint.final_newline(again).count() == 0


def test_link_statuses(docs):
    got = {(r["path"], r["target"]): r["status"] for r in links.classify(docs).collect()}
    assert got["1 One.md", "1.1 Sub"] == "valid"
    assert got["1 One.md", "1 One"] == "circular"
    assert got["1.2 Two.md", "nothing"] == "broken"
    assert got["d/9.9 Lost.md", "d/x|y"] == "nonstandard"


def test_roles(docs):
    got = {r["node"]: (r["is_root"], r["orphan_reason"]) for r in graph.roles(docs).collect()}
    assert got["0. Master"] == (True, "no_parent") and got["1.1 Sub"] == (False, "missing_parent")


@pytest.fixture(scope="module")
def family(spark):
    rows = [("r", None), ("a", "r"), ("b", "r"), ("a2", "a"), ("a1", "a"), ("x", "gone")]
    files = [(f"{n}.md", f"---\nid: 1\n{f'parent_id: {p}' if p else ''}\n---\n[[a1]]\n", datetime(2024, 1, 1)) for n, p in rows]
    return corpus.documents(spark.createDataFrame(files, "path string, content string, mtime timestamp"))


def test_tree_is_preorder(family):
    rows = graph.tree(family).orderBy("sort_path").collect()
    assert [r["node"] for r in rows] == ["r", "a", "a1", "a2", "b", "x"]
    assert [r["depth"] for r in rows] == [0, 1, 2, 2, 1, 0]
    assert [r["is_last"] for r in rows if r["depth"]] == [False, False, True, True]
    assert [r["node"] for r in graph.tree(family, orphans_only=True).collect()] == ["x"]
    assert sorted(r["node"] for r in graph.tree(family, kind="module_root").collect()) == ["a", "r"]


def test_trace(family):
    got = {(r["ref_type"], r["source"], r["target"], r["depth"]) for r in graph.trace(family, "a", 3, True).collect()}
    assert got == {("parent", "a", "r", 1), ("child", "a", "a1", 1), ("child", "a", "a2", 1), ("link", "a", "a1", 1)}


def test_cycles(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "c"), ("e", "e")], "src string, dst string")
    assert sorted(r["path"] for r in graph.cycles(pairs, 4).collect()) == [["a", "b", "c"], ["c", "d"]]


def test_closure_ends_on_a_cycle(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert [(r["other"], r["depth"]) for r in graph.closure(start, pairs, 10).collect()] == [("b", 1)]


def test_mermaid(spark):
    pairs = spark.createDataFrame([("a b", "c", "hierarchy"), ("c", "d", "link"), ("c", "d", "link")], "src string, dst string, kind string")
    assert graph.mermaid(pairs).first()[0] == "graph TD\n    a_b --> c\n    c -.-> d"


def test_health_and_audit(docs):
    overall = stats.health(docs).where("metric = 'overall'").first()
    assert 0 <= overall["value"] <= 100 and overall["grade"] in "ABCDF"
    findings = stats.audit(docs)
    assert [r["title"] for r in findings.orderBy("rank").collect()] == ["broken links", "links with a path", "lint warnings"]
    assert stats.audit_score(findings).first()["score"] == 100 - 2 * (4 + 3 + 2)


def test_coverage_keeps_empty_buckets(docs):
    got = {r["name"]: r["n"] for r in stats.coverage(docs).collect()}
    assert len(got) == 8 and sum(got.values()) == 6 and got["1001+"] == 0


def test_sync_states(docs):
    out = {r["path"]: r for r in rewrite.sync(docs, "2030-01-01 00:00:00").collect()}
    assert out["1.2 Two.md"]["state"] == "update" and 'last_updated: "2030-01-01 00:00:00"' in out["1.2 Two.md"]["new_content"]
    assert out["1 One.md"]["state"] == "initialize" and "content_hash:" in out["1 One.md"]["new_content"]
    assert out["d/none.md"]["state"] == "unchanged"
    done = corpus.documents(rewrite.sync(docs, "2030-01-01 00:00:00").select("path", F.col("new_content").alias("content"), F.current_timestamp().alias("mtime")))
    assert verify.hash_integrity(done).count() == 0


def test_fix_tables(docs):
    assert [r["text"] for r in rewrite.fix_tables(docs).collect()] == ["| [[1 One]] | 2 |"]


def test_schema(docs):
    got = {(r["path"], r["field"], r["violation"]) for r in schema.violations(docs).collect()}
    assert ("d/none.md", "id", "missing_required") in got and ("1 One.md", "status", "invalid_value") in got
    assert schema.from_mapping({"fields": [{"name": "n", "type": "integer", "required": True}]})[0].kind == "integer"


def test_search(docs):
    lines = verify.line_table(docs)
    hit = search.search(lines, "todo", ignore_case=True).collect()
    assert [(r["path"], r["start"], r["length"]) for r in hit] == [("1.2 Two.md", 0, 4)]
    assert search.search(lines, r"T.DO", regex=True).count() == 1
    assert search.search(lines, "word", most=2).count() == 2


def test_diff(docs, spark):
    new = docs.where("path <> '1 One.md'").withColumn("content", F.when(F.col("path") == "1.2 Two.md", "x").otherwise(F.col("content")))
    new = new.unionByName(docs.limit(1).withColumn("path", F.lit("new.md")).withColumn("file_name", F.lit("new.md")))
    got = {(r["file_name"], r["change"]) for r in diff.corpora(docs, new).collect()}
    assert got == {("1 One.md", "deleted"), ("1.2 Two.md", "modified"), ("new.md", "added")}


def test_pipeline_statuses(docs):
    stages = [("no frontmatter", lambda d: (~F.col("has_fm"), "skip")), ("todo", lambda d: (F.contains("content", F.lit("TODO")), "abort"))]
    got = {r["path"]: r["status"] for r in rewrite.pipeline(docs, stages).collect()}
    assert got["d/none.md"] == "skip" and got["1.2 Two.md"] == "abort" and got["1 One.md"] == "continue"


def test_export(docs, tmp_path):
    written = export.write_files(docs, f"file://{tmp_path}").collect()
    assert len(written) == 6 and (tmp_path / "d/none.md").read_text() == "just text\n"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["0. Master.md", "1 One.md", "1.1 Sub.md", "1.2 Two.md", "d"]
    assert export.write_zip(docs, str(tmp_path / "all.zip")) == 6
    assert "# Sub" in export.single_text(export.compiled(docs)).first()["text"]


def test_registry_and_config():
    r = registry.builtins()
    assert r.get("v") is verify.summary and r.get("nope") is None and "deps" in r.names("graph")
    assert registry.batch_file("# no\n\nset a 'b c'\n") == [["set", "a", "b c"]]
    assert registry.Config.of({"min_words": 5}, {"DOCLOOM_STRICT": "true", "DOCLOOM_MIN_SECTIONS": "7"}) == registry.Config(min_words=5, strict=True, min_sections=7)
