"""Aggregates over the corpus: statistics, coverage, health, audit, modules, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import frontmatter as Y
from docloom.functions import ids as I
from docloom.functions import links as L
from docloom.functions import text as T
from docloom.operators import links, lint, verify

#: Coverage buckets by words: name, least, most (fixed values).
BUCKETS = (
    ("0", 0, 0), ("1-50", 1, 50), ("51-100", 51, 100), ("101-200", 101, 200), ("201-300", 201, 300), ("301-500", 301, 500),
    ("501-1000", 501, 1000), ("1001+", 1001, None),
)
#: Weights of the eight 50-word classes below 350 words and of the rest (fixed values).
CLASS_WEIGHTS = (0.0, 0.1, 0.25, 0.4, 0.55, 0.7, 0.85, 1.0)


def _words(content: str = "content") -> Column:
    return T.words(F.col(content))


def module_id(docs: DataFrame) -> DataFrame:
    return docs.withColumn("module_id", F.substring_index("doc_id", ".", 1))


def project(docs: DataFrame) -> DataFrame:
    """One row: documents, healthy ones, body words, links, broken links, modules, deepest id."""
    d = module_id(docs).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("fm_closed").alias("healthy"), F.sum(T.words(Y.body(F.col("content")))).alias("words"),
        F.count_distinct("module_id").alias("modules"), F.coalesce(F.max(I.depth(F.col("doc_id"))), F.lit(0)).cast("long").alias("max_depth"),
    )
    wiki = lint.prose(docs.where(F.contains("content", F.lit("[[")))).select(F.explode(L.all_of(F.col("text"), L.WIKI_NAME)).alias("t"))
    name = wiki.select(F.lower(T.trim(F.substring_index(F.substring_index("t", "#", 1), "/", -1))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    stems = docs.select(F.lower("stem").alias("stem")).distinct()
    exact = name.join(stems, name.name == stems.stem, "left_anti")
    lost = exact.join(stems, F.contains(stems.stem, exact.name), "left_anti")
    counts = name.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("links")).crossJoin(lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("broken")))
    return d.crossJoin(counts)  # one row each


def by_module(docs: DataFrame) -> DataFrame:
    return module_id(docs).where("module_id is not null").groupBy("module_id").agg(F.count(F.lit(1)).alias("documents"), F.sum(T.words(Y.body(F.col("content")))).alias("words"))


def by_status(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.coalesce("status", F.lit("sin_status")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def by_type(docs: DataFrame, most: int = 15) -> DataFrame:
    """The most frequent types, and, where there are more, a row with a null type and the number of types beyond."""
    counts = docs.groupBy(F.coalesce("doc_type", F.lit("sin_tipo")).alias("doc_type")).agg(F.count(F.lit(1)).alias("n"))
    beyond = counts.agg((F.count(F.lit(1)) - most).alias("n")).where("n > 0").select(F.lit(None).cast("string").alias("doc_type"), "n")
    return counts.orderBy(F.desc("n"), "doc_type").limit(most).union(beyond)


def sizes(docs: DataFrame) -> DataFrame:
    return docs.agg(F.sum("size").alias("bytes"), F.round(F.avg("size"), 6).alias("average"), T.file_size_label(F.sum("size")).alias("label"))


def recent(df: DataFrame, time: str, as_of: Column, n: int = 10, key: str = "path") -> DataFrame:
    """The n latest rows with their age."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp(F.col(time))
    return df.orderBy(F.desc(time), key).limit(n).select(key, time, T.age_label(age).alias("age"))


def activity(df: DataFrame, time: str) -> DataFrame:
    """(month, n, bar): rows per month, and a bar of up to 30 for the busiest."""
    months = df.groupBy(F.date_format(time, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    top = F.max("n").over(Window.partitionBy())  # a row per month
    return months.select("month", "n", F.floor(F.col("n") * 30 / top).cast("long").alias("bar"), T.sparkline_level(F.col("n"), top).alias("level"))


def bucket(n: Column) -> Column:
    out = F.when(n <= BUCKETS[0][2], BUCKETS[0][0])
    for name, _, most in BUCKETS[1:-1]:
        out = out.when(n <= most, name)
    return out.otherwise(BUCKETS[-1][0])


def coverage(df: DataFrame, words: Column | None = None) -> DataFrame:
    """(name, least, most, n): every bucket, empty ones too."""
    spark = df.sparkSession
    dim = spark.createDataFrame(BUCKETS, "name string, least long, most long")
    n = df.groupBy(bucket(_words() if words is None else words).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(F.broadcast(n), "name", "left").select("name", "least", "most", F.coalesce("n", F.lit(0)).alias("n"))  # a row per bucket


def coverage_summary(df: DataFrame, words: Column | None = None) -> DataFrame:
    """One row: files, words, whole average, and the percentage of files in buckets from 201 words on."""
    w = _words() if words is None else words
    n, total = F.count(F.lit(1)), F.sum(w)
    percent = F.when(n == 0, 0.0).otherwise(F.round(F.count_if(w >= 201) / n * 100, 6))
    return df.agg(n.alias("files"), F.coalesce(total, F.lit(0)).alias("words"), F.when(n == 0, 0).otherwise(F.floor(total / n)).cast("long").alias("average"), percent.alias("percent"))


def coverage_classes(df: DataFrame, words: Column | None = None) -> DataFrame:
    """One row: documents in each 50-word class, percentages, and the weighted score."""
    w = _words() if words is None else words
    level = F.least(F.floor(w / 50), F.lit(7))
    n = F.count(F.lit(1))
    score = F.when(n == 0, 0).otherwise(F.round(F.sum(F.element_at(F.array(*[F.lit(x) for x in CLASS_WEIGHTS]), (level + 1).cast("int"))) / n * 100)).cast("long")
    share = lambda c: F.when(n == 0, 0.0).otherwise(F.round(c / n * 100, 6))
    classes = [F.count_if(level == i).alias(f"c{i}") for i in range(8)]
    return df.agg(n.alias("total"), *classes, share(F.count_if(level == 7)).alias("acceptable"), share(F.count_if(level == 0)).alias("critical"), score.alias("score"))


def modules(docs: DataFrame) -> DataFrame:
    """(module, documents, words, average, health) by the `module:` field; documents without one are "sin_modulo"."""
    module = F.coalesce(Y.first_field(F.col("content"), "module"), F.lit("sin_modulo"))
    g = docs.groupBy(module.alias("module")).agg(F.count(F.lit(1)).alias("documents"), F.sum(_words()).alias("words"))
    average = F.floor(F.col("words") / F.col("documents")).cast("long")
    health = F.when(average <= 50, 40).when(average <= 200, 70).when(average <= 500, 90).otherwise(100)
    return g.select("module", "documents", "words", average.alias("average"), health.cast("long").alias("health"))


def module_children(docs: DataFrame, module: str) -> DataFrame:
    """(path) of the documents of one module."""
    return docs.where(F.coalesce(Y.first_field(F.col("content"), "module"), F.lit("sin_modulo")) == module).select("path")


def module_registry(docs: DataFrame) -> DataFrame:
    """(module, documents, words, healthy, coverage, max_depth, root_doc) by the ids' first number."""
    d = docs.where(I.parts(F.col("doc_id")).isNotNull()).withColumn("w", T.words(Y.body(F.col("content")))).withColumn("depth", I.depth(F.col("doc_id")))
    healthy = F.col("title").isNotNull() & (F.col("w") >= 50)
    n = F.count(F.lit(1))
    return d.groupBy(I.module(F.col("doc_id")).alias("module")).agg(
        n.alias("documents"), F.sum("w").alias("words"), F.count_if(healthy).alias("healthy"), F.round(F.count_if(healthy) / n * 100, 6).alias("coverage"),
        F.max("depth").cast("long").alias("max_depth"), F.min(F.when(F.col("depth") == 1, F.col("doc_id"))).alias("root_doc"),
    )


def registry_totals(modules_: DataFrame) -> DataFrame:
    """One row over `module_registry`: modules, documents, and the mean of the modules' coverages (0 without modules)."""
    return modules_.agg(F.count(F.lit(1)).alias("modules"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.round(F.coalesce(F.avg("coverage"), F.lit(0.0)), 4).alias("coverage"))


def quick(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("files"), F.sum(_words()).alias("words"), F.sum("size").alias("bytes"), F.count_if("has_fm").alias("with_frontmatter"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def band(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 70, "good").when(score >= 50, "warning").otherwise("critical")


def health(docs: DataFrame) -> DataFrame:
    """(metric, value, weight, status), and the overall row with its grade; metadata has the coverage's value."""
    q = quick(docs)
    cover = F.when(F.col("files") == 0, 100).otherwise(F.floor(F.col("with_frontmatter") / F.col("files") * 100))
    average = F.when(F.col("files") == 0, 0).otherwise(F.floor(F.col("words") / F.col("files")))
    structure = F.when(average >= 500, 100).when(average >= 300, 85).when(average >= 100, 60).otherwise(30)
    base = q.select(cover.cast("double").alias("coverage"), F.lit(95.0).alias("links"), structure.cast("double").alias("structure"), cover.cast("double").alias("metadata"))
    weights = {"coverage": 1.0, "links": 0.8, "structure": 1.2, "metadata": 0.5}
    overall = F.round(sum(F.col(k) * w for k, w in weights.items()) / sum(weights.values()))
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value"), F.lit(w).alias("weight")) for k, w in weights.items()], F.struct(F.lit("overall").alias("metric"), overall.alias("value"), F.lit(None).cast("double").alias("weight")))
    return base.select(F.explode(rows).alias("m")).select("m.*").withColumn("status", band(F.col("value"))).withColumn("grade", F.when(F.col("metric") == "overall", grade(F.col("value"))))


def audit(docs: DataFrame, most: int = 10) -> DataFrame:
    """(seq, category, severity, title, n, affected, rank): up to five findings and their order by severity; `affected` names
    the first `most` files. Links and issues are written once; a finding is a count and a top-`most` of them."""
    from docloom.plans.scratch import Rounds

    rounds = Rounds(docs.sparkSession, "audit")
    status = rounds.write(links.classify(docs).select("status", "path"))
    issue = rounds.write(lint.lint(docs).select("severity", "path"))
    low = rounds.write(docs.where(~T.has_words(F.col("content"), 100)).select("path"))

    def finding(df: DataFrame, seq: int, category: str, severity: int, title: str, named: bool = True, over: int = 0) -> DataFrame:
        first = df.select("path").distinct().orderBy("path").limit(most if named else 0)  # bounded
        affected = first.agg(F.array_sort(F.collect_list("path")).alias("affected"))
        one = df.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > over)
        made = one.crossJoin(F.broadcast(affected))  # one row each
        return made.select(F.lit(seq).alias("seq"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(title).alias("title"), "n", "affected")

    parts = [
        finding(status.where("status = 'broken'"), 1, "links", 4, "broken links"), finding(status.where("status = 'nonstandard'"), 2, "links", 3, "links with a path"),
        finding(issue.where("severity = 'error'"), 3, "content", 4, "lint errors"), finding(issue.where("severity = 'warning'"), 4, "content", 2, "lint warnings", False),
        finding(low, 5, "content", 3, "little content", True, 10),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("severity"), "seq")))  # five rows at most


def audit_score(findings: DataFrame) -> DataFrame:
    """One row: 100 less two for each point of severity, and the minutes of work."""
    minutes = F.when(F.col("severity") >= 5, 60).when(F.col("severity") == 4, 30).when(F.col("severity") == 3, 15).when(F.col("severity") == 2, 5).otherwise(2)
    return findings.agg(F.greatest(F.lit(0), 100 - F.coalesce(F.sum("severity"), F.lit(0)) * 2).cast("long").alias("score"), F.coalesce(F.sum(minutes), F.lit(0)).cast("long").alias("minutes"))


def report(docs: DataFrame) -> DataFrame:
    """One row: documents, body words, whole average, wiki links."""
    words = T.words(Y.body(F.col("content")))
    n = F.count(F.lit(1))
    wiki = F.size(L.all_of(F.col("content"), L.WIKI))
    return docs.agg(n.alias("documents"), F.sum(words).alias("words"), F.floor(F.sum(words) / n).cast("long").alias("average"), F.sum(wiki).cast("long").alias("wiki_links"))


def report_modules(docs: DataFrame) -> DataFrame:
    """(module_id, n) sorted by number; what is no number counts as 0."""
    g = module_id(docs).where("module_id is not null").groupBy("module_id").agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.coalesce(F.col("module_id").try_cast("int"), F.lit(0)), "module_id")


def dashboard(docs: DataFrame, only: str = "all") -> DataFrame:
    """(id, phase, severity, path, detail): issues numbered by severity and phase; `only`: all, errors, warnings."""
    issues = verify.verify(docs)
    if only != "all":
        issues = issues.where(F.col("severity") == only.rstrip("s"))
    return issues.withColumn("id", F.format_string("%s%02d", F.when(F.col("severity") == "error", "E").otherwise("W"), "phase"))


def dashboard_score(docs: DataFrame) -> DataFrame:
    return verify.summary(docs).agg(F.round(F.count_if("passed") / F.count(F.lit(1)) * 100, 6).alias("health"))
