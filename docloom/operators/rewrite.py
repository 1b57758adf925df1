"""Text rewrites: each returns the table with a new `content`, or the changes it would make; nothing is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import frontmatter as Y
from docloom.functions import ids as I
from docloom.functions import links as L
from docloom.functions import text as T
from docloom.operators import graph, lint

CHANGES = "path string, field string, old_value string, new_value string"


def sync(docs: DataFrame, as_of: str, force: bool = False, children: bool = False) -> DataFrame:
    """docs with `state` (initialize, unchanged, update) by the stored hash, the new content, and `changes`.

    Without a stored hash one is added and the date stays; an equal hash changes nothing; a different one, or `force`,
    renews the date and the hash. With `children`, a differing children_count is corrected.
    """
    content = F.col("content")
    stored = Y.first_field(content, "content_hash")
    base = docs.withColumn("stored", stored).withColumn("now_hash", T.stable_hash(content)).withColumn("old_date", F.coalesce(Y.first_field(content, "last_updated"), F.lit("N/A")))
    changed = F.lit(force) | (F.col("stored").isNotNull() & (F.col("stored") != F.col("now_hash")))
    can = ~F.contains(content, F.lit("content_hash:")) & F.contains(content, F.lit("---\n"))
    state = F.when(changed, "update").when(F.col("stored").isNull() & can, "initialize").otherwise("unchanged")
    quoted = lambda name, v: F.concat(F.lit(f'{name}: "'), v, F.lit('"'))
    dated = T.replace_first(content, Y.FIELD_PATTERNS["last_updated"], quoted("last_updated", F.lit(as_of)))
    renewed = T.replace_first(dated, Y.FIELD_PATTERNS["content_hash"], quoted("content_hash", F.col("now_hash")))
    begun = Y.add_first_field(content, "content_hash", F.concat(F.lit('"'), F.col("now_hash"), F.lit('"')))
    change = lambda field, old, new: F.struct(F.lit(field).alias("field"), old.alias("old_value"), new.alias("new_value"))
    found = [
        F.when(F.col("state") == "update", change("last_updated", F.col("old_date"), F.lit(as_of))),
        F.when(F.col("stored").isNotNull() & (F.col("stored") != F.col("now_hash")), change("content_hash", F.col("stored"), F.col("now_hash"))),
    ]
    out = base.withColumn("state", state)
    new = F.when(F.col("state") == "update", renewed).when(F.col("state") == "initialize", begun).otherwise(content)
    if children:
        counts = graph.parents(docs).groupBy(F.col("parent").alias("stem")).agg(F.count(F.lit(1)).alias("actual"))
        out = out.join(counts, "stem", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
        said = Y.first_field(content, "children_count")
        wrong = said.isNotNull() & (said.try_cast("long") != F.col("actual"))
        found.append(F.when(wrong, change("children_count", said, F.col("actual").cast("string"))))
        new = F.when(wrong, T.replace_first(new, Y.FIELD_PATTERNS["children_count"], F.concat(F.lit("children_count: "), F.col("actual").cast("string")))).otherwise(new)
    return out.withColumn("new_content", new).withColumn("changes", F.array_compact(F.array(*found))).select("path", "state", "changes", "new_content")


def changes(synced: DataFrame) -> DataFrame:
    return synced.select("path", F.explode("changes").alias("c")).select("path", "c.*")


def fix_dates(docs: DataFrame, hours: int = 24) -> DataFrame:
    """Changes of last_updated that is a day or more off the file's time; a date that can't be read counts as 1970."""
    said = Y.first_field(F.col("content"), "last_updated")
    seconds = F.coalesce(Y.parse_date(F.col("said")), F.lit(0))
    late = docs.withColumn("said", said).where("said is not null").where(F.floor(F.abs(F.unix_timestamp("mtime") - seconds) / 3600) >= hours)
    new = F.date_format("mtime", "yyyy-MM-dd HH:mm:ss")
    return late.select("path", F.lit("last_updated").alias("field"), F.col("said").alias("old_value"), new.alias("new_value"))


def fix_hashes(docs: DataFrame) -> DataFrame:
    said, now = Y.first_field(F.col("content"), "content_hash"), T.stable_hash(F.col("content"))
    return docs.where(said.isNotNull() & (said != now)).select("path", F.lit("content_hash").alias("field"), said.alias("old_value"), now.alias("new_value"))


def fix_tables(docs: DataFrame) -> DataFrame:
    """(path, line_no, text): table rows with the Nietos column set to the true count."""
    wrong = lint.table_counts(docs).join(lint.descendants(docs), "id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> claimed")
    rows = lint.line_table(docs).join(wrong, ["path", "line_no"])
    # the count is the last number cell of the row
    return rows.select("path", "line_no", F.regexp_replace("text", r"\d+(\s*\|\s*)$", F.concat(F.col("n").cast("string"), F.lit("$1"))).alias("text"))


def set_field(docs: DataFrame, name: str, value: str) -> DataFrame:
    """The first `name:` replaced; unchanged where there is none."""
    return docs.withColumn("content", Y.update_field(F.col("content"), name, F.lit(value)))


def add_field(docs: DataFrame, name: str, value: str) -> DataFrame:
    return docs.withColumn("content", Y.add_first_field(F.col("content"), name, F.lit(value)))


def remove_field(docs: DataFrame, name: str) -> DataFrame:
    return docs.withColumn("content", Y.remove_field(F.col("content"), name))


def lint_fix(docs: DataFrame) -> DataFrame:
    """(path, content) of documents that fixing changes."""
    new = lint.fix(F.col("content"))
    return docs.where(new != F.col("content")).select("path", new.alias("content"))


def rename_links(docs: DataFrame, old: str, new: str) -> DataFrame:
    return docs.withColumn("content", L.rename(F.col("content"), old, new))


def archivable(docs: DataFrame, statuses: str = "deprecated,obsolete,archived") -> DataFrame:
    """Documents whose status contains one of the list, and their ids."""
    parts = F.array(*[F.lit(s.strip().lower()) for s in statuses.split(",")])
    status = F.lower(Y.first_field(F.col("content"), "status"))
    return docs.where(F.exists(parts, lambda s: F.contains(status, s))).select("path", "stem", status.alias("status"), Y.first_field(F.col("content"), "document_id").alias("document_id"))


def mark_archived(docs: DataFrame, ids: list[str], mark: str = " (ARCHIVADO)") -> DataFrame:
    """References to archived documents marked, id by id: wiki links, links in single brackets, and parent fields, in this
    order, so the brackets inside a wiki link are marked as well."""
    content = F.col("content")
    for i in ids:
        for a in (f"[[{i}]]", f"[{i}]", f"parent_id: {i}"):
            content = F.replace(content, F.lit(a), F.lit(a + mark))
    return docs.withColumn("content", content)


def restorable(docs: DataFrame, present: DataFrame, pattern: str | None = None) -> DataFrame:
    """Archived documents with `conflict` where a file of that name is there already."""
    old = docs.where(F.contains("path", F.lit("_archived/")))
    if pattern:
        old = old.where(F.col("path").rlike(pattern))
    there = present.where(~F.contains("path", F.lit("_archived/"))).select("file_name", F.lit(True).alias("there")).distinct()
    return old.join(there, "file_name", "left").select("path", "file_name", F.col("there").isNotNull().alias("conflict"))


def move_module(docs: DataFrame, document_id: str, module: str) -> DataFrame:
    new = T.replace_first(F.col("content"), r"module:[^\n]*", F.lit(f"module: {module}"))
    mine = Y.first_field(F.col("content"), "document_id") == document_id
    return docs.withColumn("content", F.when(mine, new).otherwise(F.col("content")))


def next_id(docs: DataFrame, prefix: str) -> DataFrame:
    """One row: the next free id below a prefix, by count, and its parent."""
    n = F.count_if(F.col("doc_id").startswith(prefix + "."))
    new = F.concat(F.lit(prefix + "."), (n + 1).cast("string"))
    return docs.agg(new.alias("doc_id"), I.parent(new).alias("parent"))


def substitute(template: Column, values: dict[str, Column | str]) -> Column:
    """{{NAME}} replaced by its value."""
    for name, v in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.lit(v) if isinstance(v, str) else v)
    return template


def healed_date(content: Column, now: str) -> Column:
    """The content with `last_updated` of its frontmatter set to `now`, or added at its end; null without a closed one."""
    yaml, rest = Y.yaml_text(content), F.substring(content, Y.closing_offset(content) + 4, F.length(content))
    line = f"last_updated: {now}"
    mark = r"(?m)^[ \t]*last_updated:.*$"
    return F.concat(F.lit("---"), F.when(yaml.rlike(mark), F.regexp_replace(yaml, mark, line)).otherwise(F.concat(yaml, F.lit(line + "\n"))), rest)


def heal_dates(docs: DataFrame, now: str) -> DataFrame:
    """(path, content, healed): every document with its date set; unchanged, and not healed, without a closed frontmatter."""
    new = docs.select("path", "content", healed_date(F.col("content"), now).alias("new"))
    return new.select("path", F.coalesce("new", "content").alias("content"), F.col("new").isNotNull().alias("healed"))


def heal_whitespace(docs: DataFrame) -> DataFrame:
    """(path, content): lines without white space at their ends, and no final line end."""
    return docs.select("path", F.array_join(F.transform(T.lines(F.col("content")), T.trim_end), "\n").alias("content"))


def auto_fix(docs: DataFrame, now: str) -> DataFrame:
    """(path, content, fixes) of documents that the fixes safe to automate change: lint's, then the date. `fixes` names them."""
    d = docs.select("path", "content", lint.fix(F.col("content")).alias("new")).where("new <> content")
    d = d.select("path", "new", healed_date(F.col("new"), now).alias("dated"))
    return d.select("path", F.coalesce("dated", "new").alias("content"), F.array_compact(F.array(F.lit("lint"), F.when(F.col("dated").isNotNull(), "date"))).alias("fixes"))


def pipeline(docs: DataFrame, stages: list[tuple[str, Callable[[DataFrame], tuple[Column, str]]]]) -> DataFrame:
    """Runs stages over rows: each gives a condition and skip or abort for rows that meet it. Adds `status` and
    `messages`; a row that was skipped or aborted meets no further stage."""
    out = docs.withColumn("status", F.lit("continue")).withColumn("messages", F.array().cast("array<string>"))
    for name, stage in stages:
        hit, verdict = stage(out)
        live = (F.col("status") == "continue") & hit
        out = out.withColumn("messages", F.when(live, F.array_append("messages", F.lit(name))).otherwise(F.col("messages")))
        out = out.withColumn("status", F.when(live, F.lit(verdict)).otherwise(F.col("status")))
    return out


def incremental(current: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of `current` (path, mtime, content) that `known` (path, mtime, hash) has not, or has with another time and hash."""
    old = known.select("path", F.col("mtime").alias("old_mtime"), F.col("hash").alias("old_hash"))
    joined = current.withColumn("hash", F.sha2("content", 256)).join(old, "path", "left")
    return joined.where("old_mtime is null or (old_mtime <> mtime and old_hash <> hash)").drop("old_mtime", "old_hash")


def latest_trend(events: DataFrame, key: str, time: str, value: str, n: int = 5) -> DataFrame:
    """(key, recent, overall): mean of the last n values of each key against the mean of all."""
    w = Window.partitionBy(key).orderBy(F.desc(time))
    ranked = events.withColumn("_r", F.row_number().over(w))
    return ranked.groupBy(key).agg(F.round(F.avg(F.when(F.col("_r") <= n, F.col(value))), 6).alias("recent"), F.round(F.avg(value), 6).alias("overall"))
