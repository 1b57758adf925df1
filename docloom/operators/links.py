"""Link classification and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import links as L
from docloom.functions import text as T
from docloom.operators import lint
from docloom.plans.scratch import Rounds

STATUSES = ("valid", "broken", "circular", "nonstandard", "external")
#: First characters of a name by which the places in paths are found where it may be.
GRAM = 3


def link_table(docs: DataFrame, include_external: bool = False) -> DataFrame:
    """(path, stem, line, target, name, kind): wiki and Markdown links outside fenced blocks. Embeds and images count too."""
    opens = F.contains("text", F.lit("["))
    lines = lint.prose(docs.where(F.contains("content", F.lit("["))), opens)
    stems = F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=.)\.[^.]*$", "")
    wiki = F.transform(L.all_of(F.col("text"), L.WIKI), lambda t: F.struct(F.lit("wiki").alias("kind"), t.alias("target")))
    markdown = F.transform(L.all_of(F.col("text"), L.MARKDOWN, 2), lambda t: F.struct(F.lit("markdown").alias("kind"), t.alias("target")))
    found = lines.select("path", stems.alias("stem"), F.col("line_no").alias("line"), F.explode(F.concat(wiki, markdown)).alias("l"))
    found = found.select("path", "stem", "line", "l.kind", "l.target", L.bare_name(F.col("l.target")).alias("name"))
    return found if include_external else found.where((F.col("kind") == "wiki") | ~L.is_external(F.col("target")))


def classify(docs: DataFrame, include_external: bool = False) -> DataFrame:
    """link_table with `status`.

    Links are written once. Names are resolved once each, not once per link: first by equality with a stem, then, for those
    that are left, by the looser rules of `loosely_found`.
    """
    rounds = Rounds(docs.sparkSession, "links")
    links = link_table(docs, include_external)
    own = (F.col("target") == F.col("stem")) | F.col("target").endswith(F.concat(F.lit("/"), F.col("stem")))
    path_in_name = (F.col("kind") == "wiki") & F.contains(F.substring_index("target", "|", 1), F.lit("/"))
    settled = F.when((F.col("kind") == "markdown") & L.is_external(F.col("target")), "external").when(path_in_name, "nonstandard").when(own, "circular")
    marked = rounds.write(links.withColumn("settled", settled).withColumn("low", F.lower("name")).drop("stem"))
    names = marked.where("settled is null").select("low").distinct()
    files = docs.select(F.lower("stem").alias("s"), F.lower("path").alias("p"))
    stems = files.select(F.col("s").alias("low")).distinct()
    rest = rounds.write(names.join(stems, "low", "left_anti"))
    found = names.join(stems, "low", "left_semi").union(loosely_found(rest, files)).withColumn("found", F.lit(True))
    status = F.coalesce("settled", F.when(F.col("found"), "valid").otherwise("broken"))
    return marked.join(found, "low", "left").select("path", "line", "kind", "target", "name", status.alias("status"))


def loosely_found(names: DataFrame, files: DataFrame) -> DataFrame:
    """Those of the distinct `names` (low) that fit one of `files` (s, p): the stem s ends with the name, or starts with it
    where the name starts with a digit, or the path p contains it.

    No name is compared with each path. The names' first characters, and the lengths of the names that start so, say which
    substrings of a path could be names; these substrings and the names are joined by equality. `names` is read before, for
    the sizes of its names below GRAM.
    """
    sizes_below = sorted(r["n"] for r in names.select(F.least(F.length("low"), F.lit(GRAM)).alias("n")).distinct().collect())  # GRAM + 1 at most
    gram = F.substring("low", 1, GRAM)
    sizes = names.groupBy(gram.alias("gram")).agg(F.collect_set(F.length("low")).alias("sizes"))
    # a stem is part of its path, unless lower case depends on what follows
    apart = files.where(~F.contains("p", F.col("s"))).select(F.col("s").alias("text"), F.lit(True).alias("is_stem"))
    texts = files.select(F.col("p").alias("text"), F.lit(False).alias("is_stem")).union(apart)
    at = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), lambda i: F.struct(i.alias("i"), F.substring(F.col("text"), i, F.lit(k)).alias("gram")))
    # names shorter than a gram are grams of their own; the empty name is in every path
    empty = F.array(F.struct(F.lit(1).alias("i"), F.lit("").alias("gram")))
    places = texts.select("text", "is_stem", F.explode(F.concat(empty, *[at(k) for k in sizes_below if k])).alias("x")).select("text", "is_stem", "x.*")
    could = places.join(sizes, "gram").withColumn("size", F.explode("sizes")).withColumn("low", F.substring(F.col("text"), F.col("i"), F.col("size")))
    could = could.where(F.length("low") == F.col("size"))
    end = (F.col("i") + F.col("size") == F.length("text") + 1) | (F.col("size") == 0)
    fits = ~F.col("is_stem") | end | ((F.col("i") == 1) & F.col("low").rlike("^[0-9]"))
    return names.join(could.where(fits).select("low").distinct(), "low", "left_semi")


def totals(docs: DataFrame, include_external: bool = False) -> DataFrame:
    """One row: links by status, and the share of valid and external ones as health."""
    n = {s: F.count_if(F.col("status") == s) for s in STATUSES}
    all_ = F.count(F.lit(1))
    health = F.when(all_ == 0, 100.0).otherwise((n["valid"] + n["external"]) / all_ * 100)
    return classify(docs, include_external).agg(all_.alias("links"), *[c.alias(s) for s, c in n.items()], F.round(health, 6).alias("health"))


def references(docs: DataFrame, target: str) -> DataFrame:
    """(path, line, fragment): lines with a link to `target`, with or without an alias."""
    lines = lint.line_table(docs.where(F.contains("content", F.lit(f"[[{target}"))))
    hit = F.contains("text", F.lit(f"[[{target}]]")) | F.contains("text", F.lit(f"[[{target}|"))
    return lines.where(hit).select("path", F.col("line_no").alias("line"), F.substring("text", 1, 50).alias("fragment"))


def unresolved(docs: DataFrame) -> DataFrame:
    """Internal links of the typed extraction whose target is no known path and no known file name."""
    found = docs.select("path", F.explode(L.extract(F.col("content"))).alias("l")).where("l.link_type in ('wiki', 'markdown')")
    found = found.select("path", L.normalized(F.col("l.target"), F.col("l.link_type")).alias("target")).where("target <> ''")
    by_path = docs.select(F.col("path").alias("target")).distinct()
    by_name = docs.select(F.col("file_name").alias("name")).distinct()
    left = found.join(by_path, "target", "left_anti").withColumn("name", F.substring_index("target", "/", -1))
    return left.join(by_name, "name", "left_anti").select("path", "target")


def unique_targets(docs: DataFrame) -> DataFrame:
    """(path, targets): distinct internal targets of each document."""
    internal = F.filter(L.extract(F.col("content")), lambda x: (x["link_type"] == "wiki") | (x["link_type"] == "markdown"))
    return docs.select("path", F.array_sort(F.array_distinct(F.transform(internal, lambda x: T.trim(x["target"])))).alias("targets"))
