"""Typed frontmatter, generated texts, backups, histories and hooks on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from docloom.operators import export, history, registry, reports, rewrite
from docloom.sources import corpus

NOW = dt.datetime(2024, 1, 1)


def docs(spark, **contents):
    rows = [(f"{k}.md", v, NOW) for k, v in contents.items()]
    return corpus.documents(spark.createDataFrame(rows, "path string, content string, mtime timestamp"))


def test_typed_frontmatter(spark):
    d = docs(
        spark,
        good="  \n---\nid: 1.2\ntitle: \"T: x # y\" # note\nparent: ~\ntags: [a, 'b c', ]\nactors:\n  - x\n  - \"y z\"\nchildren_count: 3\ntype: hoja\n---\n\nbody",
        twice="---\nid: 1\nid: 2\ntitle: a\n---\n", alias="---\nid: 1\ntitle: a\ntype: x\ndoc_type: y\n---\n", number="---\nid: 1\ntitle: a\nchildren_count: many\n---\n",
        noid="---\ntitle: a\n---\n", notitle="---\nid: 1\ntitle:\n---\n", none="text", open="---\nid: 1\n", badid="---\nid: 1.x\ntitle: a\n---\n",
        blank="---\nid: 1\ntitle: ''\n---\n", nested="---\nid: 1\ntitle: a\nx:\n  id: 2\n---\n", empty="",
    )
    out = {r["path"][:-3]: r for r in corpus.parsed(d).collect()}
    good = out["good"]
    assert (good["id"], good["title"], good["parent"], good["tags"], good["actors"], good["children_count"]) == ("1.2", "T: x # y", None, ["a", "b c"], ["x", "y z"], 3)
    assert (good["doc_type"], good["references"], good["body"], good["parse_error"], good["valid"]) == ("hoja", None, "body", None, True)
    errors = {k: r["parse_error"] for k, r in out.items()}
    assert errors["twice"] == errors["alias"] == "duplicate field" and errors["number"] == "no number"
    assert errors["noid"] == "missing field: id" and errors["notitle"] == "missing field: title"
    assert errors["none"] == errors["open"] == errors["empty"] == "missing frontmatter"
    assert errors["badid"] is None and not out["badid"]["valid"] and not out["blank"]["valid"] and out["nested"]["valid"]
    assert tuple(corpus.validity(corpus.parsed(d)).first()) == (12, 2, 8)


def test_pieces_make_the_text(spark, tmp_path):
    d = docs(spark, b="---\ntitle: B\n---\nbody b\n", a="---\ntitle: A\n---\nbody a\n", draft="---\ndraft: true\n---\n")
    file = tmp_path / "out.md"
    n = reports.write_text(reports.compiled(d, "now"), str(file))
    text = file.read_text()
    assert n == len(text.encode())
    assert text.startswith("# Contents\n\n- [A](#a)\n- [B](#b)\n") and text.index("body a") < text.index("body b") and "draft" not in text
    reports.write_text(reports.readme(d, "P"), str(file))
    assert file.read_text() == "# P\n\n- documents: 3\n- words: 16\n- modules: 1\n\n| module | documents |\n|---|---|\n| sin_modulo | 3 |\n"


def test_empty_corpus_has_its_heads(spark, tmp_path):
    d = docs(spark, a="x").where("path = ''")
    reports.write_text(reports.readme(d, "P"), str(tmp_path / "r"))
    assert "- documents: 0\n- words: 0\n- modules: 0" in (tmp_path / "r").read_text()
    assert tuple(reports.compiled_summary(d).first()) == (0, 0, 0)


def test_readme_orders_modules(spark, tmp_path):
    d = docs(spark, a="module: x", b="module: y", c="module: y")
    reports.write_text(reports.readme(d, "P", stats=False), str(tmp_path / "r"))
    assert (tmp_path / "r").read_text().endswith("| y | 2 |\n| x | 1 |\n")


def test_backup_and_restore(spark, tmp_path):
    (tmp_path / "a.md").write_text("old")
    paths = spark.createDataFrame([("a.md",), ("none.md",)], "path string")
    assert dict(map(tuple, export.backup_files(paths, str(tmp_path)).collect())) == {"a.md": True, "none.md": False}
    (tmp_path / "a.md").write_text("new")
    assert dict(map(tuple, export.restore_files(paths, str(tmp_path)).collect())) == {"a.md": True, "none.md": False}
    assert (tmp_path / "a.md").read_text() == "old"
    assert dict(map(tuple, export.remove_backups(paths, str(tmp_path)).collect())) == {"a.md": True, "none.md": False}
    assert [p.name for p in tmp_path.iterdir()] == ["a.md"]


def test_hooks_and_variables(spark):
    changed = spark.createDataFrame([("a.md",)], "path string")
    found = registry.hook_commands(changed, "# no\n\n lint $FILE \nsee $FILE $FILE").orderBy("seq").collect()
    assert [r["command"] for r in found] == ["lint a.md", "see a.md a.md"]
    assert registry.hook_commands(changed, "# nothing").count() == 0
    assert registry.custom_vars(["A=1", "B = x=y", "none"]) == {"A": "1", "B": "x=y"}


def test_heal(spark):
    d = docs(spark, a="---\nid: 1\n  last_updated: 2020\n---\nlast_updated: 1\n", b="---\nid: 1\n---\n", c="text  \nx\t\n")
    dates = {r["path"]: (r["content"], r["healed"]) for r in rewrite.heal_dates(d, "now").collect()}
    assert dates["a.md"] == ("---\nid: 1\nlast_updated: now\n---\nlast_updated: 1\n", True)
    assert dates["b.md"] == ("---\nid: 1\nlast_updated: now\n---\n", True) and dates["c.md"] == ("text  \nx\t\n", False)
    assert rewrite.heal_whitespace(d).where("path = 'c.md'").first()["content"] == "text\nx"
    fixed = {r["path"]: (r["content"], r["fixes"]) for r in rewrite.auto_fix(d, "now").collect()}
    assert fixed == {"c.md": ("text\nx\n", ["lint"])}


def test_history(spark):
    runs = spark.createDataFrame([(i % 5 > 0, 2.0, 10) for i in range(10)], "success boolean, seconds double, docs long")
    assert tuple(history.stats(runs).first()) == (10, 80.0, 2.0, 5.0)
    assert [r["suggestion"] for r in history.suggestions(history.stats(runs)).collect()] == ["validate before commands", "cache what is read"]
    assert tuple(history.stats(runs.where("docs < 0")).first()) == (0, 0.0, 0.0, 0.0)
    assert tuple(history.batch_rate(runs.where("docs < 0").select("success")).first()) == (0, 0, 100.0)


def test_severities_and_alerts(spark):
    issues = spark.createDataFrame([("error",), ("info",), ("hint",), ("warning",), ("error",)], "severity string")
    assert {r["severity"]: r["n"] for r in reports.by_severity(reports.at_least(issues, "warning")).collect()} == {"error": 2, "warning": 1}
    levels = spark.createDataFrame([(80.0,), (79.9,), (60.0,), (40.0,), (39.9,)], "s double").select(reports.alert(F.col("s")).alias("a")).collect()
    assert [r["a"] for r in levels] == ["none", "warning", "warning", "high", "critical"]
