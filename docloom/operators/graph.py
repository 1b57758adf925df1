"""Dependency graph, traversal, hierarchy and cycles over edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import frontmatter as Y
from docloom.functions import ids as I
from docloom.functions import links as L
from docloom.functions import text as T
from docloom.plans.scratch import Rounds


def parents(docs: DataFrame) -> DataFrame:
    """(node, parent) by file stems; no row for a missing or null parent."""
    pairs = docs.select(F.col("stem").alias("node"), Y.first_field(F.col("content"), "parent_id").alias("parent"))
    return pairs.where("parent is not null and parent not in ('null', '')")


def edges(docs: DataFrame) -> DataFrame:
    """(src, dst, kind): parent to child, and links with their raw targets; links to oneself are left out."""
    up = parents(docs).select(F.col("parent").alias("src"), F.col("node").alias("dst"), F.lit("hierarchy").alias("kind"))
    stems = F.transform(L.all_of(F.col("content"), L.MARKDOWN_FILE, 2), lambda t: F.when(~t.startswith("http"), F.regexp_replace(F.substring_index(t, "/", -1), r"\.md$", "")))
    out = docs.select(F.col("stem").alias("src"), F.explode(F.concat(L.all_of(F.col("content"), L.WIKI), F.array_compact(stems))).alias("dst"))
    return up.unionByName(out.where("src <> dst").withColumn("kind", F.lit("link")))


def nodes(pairs: DataFrame) -> DataFrame:
    """(node): the distinct ends of edges (src, dst), so that a link makes the nodes that it names."""
    return pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()


def roles(docs: DataFrame) -> DataFrame:
    """(node, is_root, is_leaf, orphan_reason, invalid_parent) by the hierarchy alone."""
    up = parents(docs).groupBy("node").agg(F.max("parent").alias("parent"))
    nodes = docs.select(F.col("stem").alias("node")).distinct()
    down = parents(docs).select(F.col("parent").alias("node")).distinct().withColumn("has_child", F.lit(True))
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    joined = nodes.join(up, "node", "left").join(down, "node", "left").join(known, "parent", "left")
    reason = F.when(F.col("parent").isNull(), "no_parent").when(F.col("known").isNull(), "missing_parent")
    return joined.select(
        "node", F.col("parent").isNull().alias("is_root"), F.col("has_child").isNull().alias("is_leaf"), reason.alias("orphan_reason"),
        F.when(reason == "missing_parent", F.col("parent")).alias("invalid_parent"),
    )


def impact(docs: DataFrame, node: str) -> DataFrame:
    """(node, relation): children of `node`, and documents with a link whose target contains it."""
    children = parents(docs).where(F.col("parent") == node).select("node", F.lit("child").alias("relation"))
    linking = edges(docs).where((F.col("kind") == "link") & F.contains("dst", F.lit(node))).select(F.col("src").alias("node"), F.lit("reference").alias("relation"))
    return children.union(linking.distinct())


def closure(start: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """(node, other, depth): pairs (src, dst) followed from start (node), one join per step, each pair of ends at its least
    depth. A row carries its path, so cycles end; the plan grows by one join a step."""
    frontier = start.select("node", F.array("node").alias("path"))
    found = []
    for i in range(1, depth + 1):
        step = frontier.join(pairs, F.element_at("path", -1) == pairs.src).where(~F.array_contains("path", F.col("dst")))
        frontier = step.select("node", F.concat("path", F.array("dst")).alias("path"))
        found.append(frontier.select("node", F.element_at("path", -1).alias("other"), F.lit(i).alias("depth")))
    return reduce(DataFrame.union, found).groupBy("node", "other").agg(F.min("depth").alias("depth"))


def trace(docs: DataFrame, node: str, depth: int = 3, backlinks: bool = False, most: int = 100) -> DataFrame:
    """(source, target, ref_type, depth): ancestors, descendants, outgoing links, and links to the node if asked for; links
    are cut at `most` references in all, in order of their names."""
    spark = docs.sparkSession
    start = spark.createDataFrame([(node,)], "node string")
    up = parents(docs).select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    rise = closure(start, up, depth)
    below = closure(start, down, depth).select(F.col("other").alias("target"), "depth")
    child = below.join(up, below.target == up.src).select(F.col("dst").alias("source"), "target", F.lit("child").alias("ref_type"), "depth")
    over = rise.select("other", "depth").union(start.select("node", F.lit(0)))
    parent = over.join(up, over.other == up.src).where(F.col("depth") < depth).select(F.col("other").alias("source"), F.col("dst").alias("target"), F.lit("parent").alias("ref_type"), (F.col("depth") + 1).alias("depth"))
    name = F.trim(F.substring_index(F.substring_index("dst", "/", -1), "|", 1))
    wiki = docs.select(F.col("stem").alias("src"), F.explode(L.all_of(F.col("content"), L.WIKI)).alias("dst")).select("src", name.alias("dst")).where("src <> dst")
    links = wiki.where(F.col("src") == node).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("link").alias("ref_type"), F.lit(1).alias("depth"))
    if backlinks:
        back = wiki.where(F.col("dst") == node).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("backlink").alias("ref_type"), F.lit(1).alias("depth"))
        links = links.union(back)
    return parent.union(child).union(links.orderBy(F.desc("ref_type"), "source", "target").limit(most))


def tree(docs: DataFrame, depth: int | None = None, kind: str | None = None, orphans_only: bool = False, root: str | None = None) -> DataFrame:
    """The hierarchy in preorder: (node, depth, parent, doc_kind, children, is_last, above_last, is_orphan, words, sort_path).

    Roots have no parent, or one that isn't there. Children are sorted by name; a node's sort path is the names from the
    root, so ordering by it is preorder; `above_last` says of each ancestor from the root whether it is its parent's last.
    Built level by level with one join each, until a level is empty or `depth` is reached; each level is written, so the plan
    does not grow. Nodes on or below a cycle have no root: without `depth` and `kind` they follow as orphans of depth 0 and
    kind "cyclic". `kind` prunes subtrees, `orphans_only` does not. `root` keeps the files whose names start with it; depths
    are then those of their numbers below it.
    """
    if root is not None:
        docs = docs.where(F.col("stem").startswith(root))
    up = parents(docs).groupBy("node").agg(F.max("parent").alias("parent"))
    words = docs.groupBy(F.col("stem").alias("node")).agg(F.max(T.words(F.col("content"))).alias("words"))
    nodes = words.join(up, "node", "left")
    below = up.groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.max("node").alias("last_child"))
    known = words.select(F.col("node").alias("parent"), F.lit(True).alias("known")).join(below.select("parent", "last_child"), "parent", "left")
    nodes = nodes.join(known, "parent", "left").join(below.select(F.col("parent").alias("node"), "children"), "node", "left")
    rounds = Rounds(docs.sparkSession)
    nodes = rounds.write(nodes.withColumn("children", F.coalesce("children", F.lit(0))))
    last_root = nodes.where("known is null").agg(F.max("node").alias("last_root"))  # one row
    is_orphan = F.col("parent").isNotNull() & F.col("known").isNull()

    def with_kind(df: DataFrame, level: int) -> DataFrame:
        name = F.when(F.lit(level == 0) & F.col("node").startswith("0."), "master").when((F.col("children") > 0) & F.lit(level <= 1), "module_root").when(F.col("children") > 0, "branch").otherwise("leaf")
        df = df.withColumn("doc_kind", name).withColumn("depth", F.lit(level))
        return df.where(F.col("doc_kind") == kind) if kind else df

    none = F.array().cast("array<boolean>")
    roots = nodes.where("known is null").crossJoin(F.broadcast(last_root)).withColumn("is_last", F.col("node") == F.col("last_root")).drop("last_root", "last_child")
    level = rounds.write(with_kind(roots.withColumns({"sort_path": F.array("node"), "above_last": none}), 0))
    levels, i = [level], 0
    while (depth is None or i < depth) and not level.isEmpty():
        i += 1
        above = level.select(F.col("node").alias("parent"), F.col("sort_path").alias("_path"), F.concat("above_last", F.array("is_last")).alias("above_last"))
        found = nodes.where("known").join(above, "parent").withColumns({"sort_path": F.concat("_path", F.array("node")), "is_last": F.col("node") == F.col("last_child")})
        level = rounds.write(with_kind(found.drop("_path", "last_child"), i))
        levels.append(level)
        if len(levels) > 32:  # a deep tree's levels become one table
            levels = [rounds.write(reduce(DataFrame.unionByName, levels))]
    out = reduce(DataFrame.unionByName, levels).withColumn("is_orphan", is_orphan)
    if depth is None and kind is None:
        lost = nodes.join(out.select("node"), "node", "left_anti").drop("last_child")
        lost = lost.withColumns({"sort_path": F.array("node"), "doc_kind": F.lit("cyclic"), "depth": F.lit(0), "is_orphan": F.lit(True), "is_last": F.lit(False), "above_last": none})
        out = out.unionByName(lost)
    if root is not None:
        out = out.withColumn("depth", F.greatest(F.lit(0), I.dots(F.col("node")) - F.lit(root_dots(root))).cast("int"))
    out = out.where("is_orphan") if orphans_only else out
    return out.select("node", "depth", "parent", "doc_kind", "children", "is_last", "above_last", "is_orphan", "words", "sort_path")


def root_dots(root: str) -> int:
    """Dots among the leading digits and dots of a root's name."""
    lead = root[: len(root) - len(root.lstrip("0123456789."))]
    return lead.count(".")


def tree_text(nodes: DataFrame) -> DataFrame:
    """One line per node of `tree`, with its prefix: a column for each level above its own, blank below a last node."""
    n = F.greatest(F.col("depth") - 1, F.lit(0))
    columns = F.transform(F.slice("above_last", F.lit(1), n), lambda last: F.when(last, "    ").otherwise("│   "))
    missing = F.repeat(F.lit("    "), F.greatest(n - F.size("above_last"), F.lit(0)))
    bar = F.when(F.col("depth") == 0, "").otherwise(F.concat(F.array_join(columns, ""), missing, F.when(F.col("is_last"), "└── ").otherwise("├── ")))
    return nodes.select("sort_path", F.concat(bar, "node").alias("line"))


def tree_totals(nodes: DataFrame) -> DataFrame:
    """One row: nodes, deepest depth, orphans, words."""
    return nodes.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), F.count_if("is_orphan").alias("orphans"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))


def trace_totals(references: DataFrame) -> DataFrame:
    """One row over rows of `trace`: references, distinct documents, impact (the others than the start), deepest depth."""
    ends = references.select(F.explode(F.array("source", "target")).alias("node"))
    n = ends.agg(F.count_distinct("node").alias("documents"))
    one = references.agg(F.count(F.lit(1)).alias("references"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    return one.crossJoin(F.broadcast(n)).withColumn("impact", F.greatest(F.col("documents") - 1, F.lit(0)))  # one row each


def graph_totals(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes (known or named by an edge), edges, edges by kind."""
    named = nodes.select("node").union(pairs.select("src")).union(pairs.select("dst")).agg(F.count_distinct("node").alias("nodes"))
    kinds = pairs.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("kind") == "hierarchy").alias("hierarchy"), F.count_if(F.col("kind") == "link").alias("links"))
    return named.crossJoin(F.broadcast(kinds))  # one row each


def level_order(nodes: DataFrame) -> DataFrame:
    """(node, depth, place): rows of `tree` with their place in breadth-first order, numbered within each depth."""
    from pyspark.sql import Window

    return nodes.select("node", "depth", F.row_number().over(Window.partitionBy("depth").orderBy("sort_path")).alias("place"))


def post_order(nodes: DataFrame) -> DataFrame:
    """(node, key): ordering by key gives children before their parents, siblings by name."""
    step = lambda end, name: F.struct(F.lit(end).alias("end"), name.alias("name"))
    return nodes.select("node", F.concat(F.transform("sort_path", lambda x: step(False, x)), F.array(step(True, F.lit("")))).alias("key"))


def subtree(nodes: DataFrame, node: str) -> DataFrame:
    """Rows of `tree` at or below a node."""
    return nodes.where(F.array_contains("sort_path", node))


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.where("children = 0")


def peel(pairs: DataFrame, rounds: int) -> DataFrame:
    """Edges that may lie on a cycle: ends without an incoming or without an outgoing edge are removed, round by round."""
    for _ in range(rounds):
        pairs = pairs.join(pairs.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(pairs.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    return pairs


def cycles(pairs: DataFrame, longest: int = 4) -> DataFrame:
    """Distinct simple cycles of up to `longest` nodes, each an array that starts with its least node."""
    edges_ = peel(pairs.select("src", "dst").where("src <> dst").distinct(), 2)
    paths = edges_.where("dst > src").select(F.array("src", "dst").alias("path"), F.col("dst").alias("last"))
    found = None
    for i in range(2, longest + 1):
        closed = paths.join(edges_, (F.col("last") == F.col("src")) & (F.col("dst") == F.get("path", F.lit(0)))).select("path")
        found = closed if found is None else found.union(closed)
        if i < longest:
            step = paths.join(edges_, F.col("last") == F.col("src")).where((F.col("dst") > F.get("path", F.lit(0))) & ~F.array_contains("path", F.col("dst")))
            paths = step.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last"))
    return found.distinct()


def _spread(pairs: DataFrame, labels: DataFrame, rounds: Rounds) -> DataFrame:
    """(node, label): labels follow the edges (src, dst) until no node gets a smaller one. Only nodes whose label fell in
    the last round send theirs on."""
    fresh = labels
    while not fresh.isEmpty():
        sent = pairs.join(fresh, pairs.src == fresh.node).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("new"))
        merged = rounds.write(labels.join(sent, "node", "left").select("node", F.least("label", "new").alias("label"), F.coalesce(F.col("new") < F.col("label"), F.lit(False)).alias("fell")))
        labels, fresh = merged.select("node", "label"), merged.where("fell").select("node", "label")
    return labels


def cyclic(pairs: DataFrame) -> DataFrame:
    """(node, component): every node on a cycle of whatever length, with the least node of its strongly connected component.

    Edges that cannot lie on a cycle are peeled to a fixed point. Each node then takes the least node that reaches it; where
    that node is its own label, what reaches it back within its label is its component. Both steps repeat on the rest.
    """
    rounds = Rounds(pairs.sparkSession)
    left = rounds.write(pairs.select("src", "dst").where("src <> dst").distinct())
    nodes = left.select(F.col("src").alias("node"))
    found = rounds.write(nodes.select("node", F.col("node").alias("component")).limit(0))
    n = left.count()
    while n:
        before = None
        while n and n != before:
            before, left = n, rounds.write(peel(left, 1))
            n = left.count()
        if not n:
            break
        both = left.select(F.col("src").alias("node")).union(left.select(F.col("dst").alias("node"))).distinct()
        labels = _spread(left, both.withColumn("label", F.col("node")), rounds)
        a, b = labels.toDF("src", "la"), labels.toDF("dst", "lb")
        inside = rounds.write(left.join(a, "src").join(b, "dst").where("la = lb").select("src", "dst", F.col("la").alias("label")))
        back = rounds.write(labels.where("node = label"))
        seen = back
        while not back.isEmpty():
            step = inside.join(back.select(F.col("node").alias("dst"), "label"), ["dst", "label"]).select(F.col("src").alias("node"), "label").distinct()
            back = rounds.write(step.join(seen, "node", "left_anti"))
            seen = rounds.write(seen.unionByName(back))
        own = seen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label")
        found = rounds.write(found.union(seen.join(own, "label").select("node", F.col("label").alias("component"))))
        gone = seen.select("node")
        left = rounds.write(left.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti"))
        n = left.count()
    return found


def id_tree(docs: DataFrame) -> DataFrame:
    """(doc_id, parent_id, depth, module, is_leaf) with parents derived from the ids themselves."""
    own = docs.where(I.parts(F.col("doc_id")).isNotNull()).select("doc_id").distinct()
    own = own.select("doc_id", I.parent(F.col("doc_id")).alias("parent_id"), I.depth(F.col("doc_id")).cast("long").alias("depth"), I.module(F.col("doc_id")).alias("module"))
    inner = own.where("parent_id is not null").select(F.col("parent_id").alias("doc_id")).distinct().withColumn("inner", F.lit(True))
    return own.join(inner, "doc_id", "left").select("doc_id", "parent_id", "depth", "module", F.col("inner").isNull().alias("is_leaf"))


def mermaid(pairs: DataFrame) -> DataFrame:
    """One row: a Mermaid graph of distinct edges (src, dst, kind). The text is as long as the graph."""
    arrow = F.when(F.col("kind") == "hierarchy", " --> ").otherwise(" -.-> ")
    line = F.concat(F.lit("    "), T.node_id(F.col("src")), arrow, T.node_id(F.col("dst")))
    return pairs.select(line.alias("line")).distinct().agg(F.concat(F.lit("graph TD\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("mermaid"))
