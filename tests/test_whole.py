"""Queries over whole tables: nothing is left out by id, size or number."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import export, graph, links, lint, schema, stats, verify
from docloom.operators import registry as commands
from docloom.plans import registry, tables
from docloom.sources import corpus

SMALL = "/root/testdata/sf0.01"


def test_corpus_holds_every_text(spark):
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.format_string("c/Cust-%d.md", "doc_id").alias("path"), "text")
    files = tables.files(spark, SMALL)
    assert files.count() == texts.count() + 31
    assert texts.join(files, "path").where(F.contains("content", F.col("text"))).count() == texts.count() == 1000


def test_diff_compares_every_document(spark):
    got = {r["change"]: r["n"] for r in registry.QUERIES["diff"](spark, SMALL).groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = range(1000)
    assert got == {"deleted": sum(i % 7 == 3 for i in ids), "modified": sum(i % 7 != 3 and i % 5 == 2 for i in ids), "added": sum(i % 11 == 5 for i in ids)}


def test_long_cycles_are_found(spark):
    ring = [(i, (i + 1) % 9) for i in range(9)]
    pairs = spark.createDataFrame([*ring, (8, 20), (20, 21), (21, 22), (22, 20), (22, 30), (40, 0), (31, 31), (50, 60), (60, 50), (22, 50)], "src long, dst long")
    got = {r["node"]: r["component"] for r in graph.cyclic(pairs).collect()}
    assert got == {**dict.fromkeys(range(9), 0), 20: 20, 21: 20, 22: 20, 50: 50, 60: 50}


def test_compiled_counts_the_whole_body(spark):
    files = [("a.md", "---\ntitle: a\n---\n" + "\n".join(["line"] * 80), datetime(2024, 1, 1))]
    docs = corpus.documents(spark.createDataFrame(files, "path string, content string, mtime timestamp"))
    assert export.compiled(docs).select(F.length("section")).first()[0] == 80 * 5 - 1
    assert len(export.single_text(export.compiled(docs), preview=50).first()["text"].split("\n")) == 50
    long = tables.docs(spark, SMALL).where("length(content) > 20000").select("path")
    n = registry.QUERIES["compiled"](spark, SMALL).join(long, "path").agg(F.min("n")).first()[0]
    assert n is not None and n > 15000


def _docs(spark, contents):
    rows = [(f"{n}.md", c, datetime(2024, 1, 1)) for n, c in contents.items()]
    return corpus.documents(spark.createDataFrame(rows, "path string, content string, mtime timestamp"))


def test_types_beyond_are_counted(spark):
    docs = _docs(spark, {f"d{i}": f"---\nid: {i}\ntype: t{i}\n---\n" for i in range(17)})
    assert [r["n"] for r in stats.by_type(docs).where("doc_type is null").collect()] == [2]
    assert stats.by_type(docs, 17).count() == 17


def test_all_kinds_are_returned(spark):
    assert {r["ref_type"] for r in registry.QUERIES["trace"](spark, SMALL).collect()} == {"child", "parent", "backlink"}
    docs = _docs(spark, {"a": "---\nid: 1\n---\n" + " ".join(f"[[x{i}]]" for i in range(11)), "b": "[[x]]"})
    assert [(r["path"], r["kind"], r["n"]) for r in schema.predictions(docs, "2024-02-20").collect()] == [("a.md", "broken_link_risk", 11)]


def test_deep_and_cyclic_nodes_stay_in_the_tree(spark):
    contents = {f"n{i:02d}": f"---\nid: 1\n{f'parent_id: n{i - 1:02d}' if i else ''}\n---\n" for i in range(16)}
    contents |= {a: f"---\nid: 1\nparent_id: {b}\n---\n" for a, b in (("x", "y"), ("y", "x"), ("z", "x"))}
    got = {r["node"]: (r["depth"], r["doc_kind"], r["is_orphan"]) for r in graph.tree(_docs(spark, contents)).collect()}
    assert len(got) == 19 and got["n15"] == (15, "leaf", False)
    assert {got[n] for n in "xyz"} == {(0, "cyclic", True)}


ODD = {
    "c/Cust-1": "[[ust-1]] [[t-2]] [[C/]] [[#part]] [[.m]] [[st-9]] [[1]] [[x]] [[d/e]] [y](-1.md) [z](1.mdx)\n```\n[[gone]]\n```\n[[gone]]",
    "Cust-2": "[[CUST]] [[m]] [[c/cust-1|a]] [[Cust-2]] [[Cust-22]]", "12 ΑΣ": "[[ας]] [[2 ΑΣ]] [[12 ας]] [[12 α]] [[2 α]] [[σ.m]] [[ς.m]] [[İ]]",
}


def _pairwise(docs):
    """Status of each link by comparing its name with every file."""
    files = [(r["s"], r["p"]) for r in docs.select(F.lower("stem").alias("s"), F.lower("path").alias("p")).collect()]
    table = links.link_table(docs).withColumn("low", F.lower("name")).withColumn("out", (F.col("kind") == "wiki") & F.contains(F.substring_index("target", "|", 1), F.lit("/")))
    fits = lambda x, s, p: s.endswith(x) or x in p or (x[:1] in set("0123456789") - {""} and s.startswith(x))
    status = lambda r: "nonstandard" if r["out"] else "circular" if r["target"] == r["stem"] else "valid" if any(fits(r["low"], *f) for f in files) else "broken"
    return sorted((r["path"], r["target"], status(r)) for r in table.collect())


def test_names_are_resolved_as_by_comparing_each_pair(spark):
    docs = _docs(spark, ODD)
    got = links.classify(docs)
    assert sorted((r["path"], r["target"], r["status"]) for r in got.collect()) == _pairwise(docs)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_totals_compare_no_name_with_each_path(spark):
    docs = _docs(spark, ODD)
    got = links.totals(docs)
    status = [s for _, _, s in _pairwise(docs)]
    assert got.first()["valid"] == status.count("valid") and got.first()["broken"] == status.count("broken")
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def _plans(spark):
    """Plans of the queries that ran, by number."""
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {found.apply(i).executionId(): found.apply(i).physicalPlanDescription() for i in range(found.size())}


@pytest.mark.parametrize("name", ["audit", "audit_score", "gate"])
def test_no_query_compares_names_with_each_path(spark, name):
    docs, before = _docs(spark, ODD), set(_plans(spark))
    broken = [s for _, _, s in _pairwise(docs)].count("broken")
    run = {"audit": stats.audit, "audit_score": lambda d: stats.audit_score(stats.audit(d)), "gate": commands.gate}[name]
    rows = run(docs).collect()
    assert broken > 0 and {"audit": lambda: rows[0]["n"], "audit_score": lambda: broken, "gate": lambda: rows[0]["broken_links"]}[name]() == broken
    ran = [p for i, p in _plans(spark).items() if i not in before]
    assert ran and not [p for p in ran if re.search(r"NestedLoopJoin.*LeftSemi", p)]


LINES = {
    "a": "x \r\ny\t\r\r\n" + "z" * 801 + "\n ![](i.png) \n```\n# no\n[[no]]\n~~~\n| a |\n|---|\n|---|\n",
    "b": "# A\n### C\n[[a]]\n| a | b |\n```\n|---|\n```\n| x |\n|---|\n |---| \n| y |\n\n|---|\n# a", "c": "\u0085 \n \u2028\n", "d": "",
}


def _rows(df):
    return sorted(repr(tuple(r)) for r in df.select("path", *[c for c in df.columns if c != "path"]).collect())


def test_only_documents_with_fences_are_sorted(spark):
    docs = _docs(spark, LINES)
    plan = links.link_table(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Contains(content" in plan and "```" in plan
    assert [(r["path"], r["line"]) for r in links.link_table(docs).collect()] == [("b.md", 3)]
    assert {(r["path"], r["line_no"]) for r in lint.prose(docs).collect() if r["path"] == "b.md"} == {("b.md", i) for i in (1, 2, 3, 4, 8, 9, 10, 11, 12, 13, 14)}


@pytest.mark.parametrize("run", [stats.audit, lambda d: stats.audit_score(stats.audit(d))])
def test_rules_over_single_lines_share_a_pass(spark, run):
    docs, alone = _docs(spark, LINES), ["L003", "L005", "L010"]
    both = lint.lint(docs, alone)
    assert both._jdf.queryExecution().executedPlan().toString().count("Generate") <= 2
    assert _rows(both) == _rows(lint.RULES["L003"](docs).union(lint.RULES["L005"](docs)).union(lint.RULES["L010"](docs)))
    assert {(r["code"], r["path"], r["line"]) for r in both.collect()} == {("L003", "a.md", 1), ("L003", "a.md", 2), ("L005", "a.md", 3), ("L003", "a.md", 4), ("L010", "a.md", 4), ("L003", "b.md", 10), ("L003", "c.md", 1), ("L003", "c.md", 2)}
    assert sorted((r["line"], r["code"]) for r in lint.lint(docs, ["L009", "L011"]).where("path = 'b.md'").collect()) == [(4, "L009"), (10, "L011"), (13, "L009")]
    assert run(docs).count() >= 1


def test_verify_is_the_union_of_its_phases(spark):
    docs = _docs(spark, {**ODD, **LINES, "none": None, "few": "w " * 49, "many": "w\u2003" * 50})
    assert _rows(verify.verify(docs)) == sorted(x for _, phase in verify.PHASES.values() for x in _rows(phase(docs)))
    assert {r["path"]: r["detail"] for r in verify.PHASES[16][1](docs).where("path in ('few.md', 'many.md')").collect()} == {"few.md": "49"}
    for n in (1, 3, 50):
        assert docs.where(text.has_words(F.col("content"), n) != (text.words(F.col("content")) >= n)).count() == 0
