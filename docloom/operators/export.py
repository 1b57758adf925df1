"""Sinks: compiled documents, indexes, files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import frontmatter as Y
from docloom.functions import text as T

#: Format -> extension and media type (fixed values).
FORMATS = {
    "markdown": ("md", "text/markdown"), "json": ("json", "application/json"), "html": ("html", "text/html"), "yaml": ("yaml", "application/yaml"),
    "csv": ("csv", "text/csv"), "plain": ("txt", "text/plain"), "latex": ("tex", "application/x-latex"),
}


def compiled(docs: DataFrame, module_prefix: str | None = None) -> DataFrame:
    """(path, title, module, anchor, section): what a compiled document holds, drafts left out, each section whole."""
    d = docs.where(~Y.is_draft(F.col("content"))).withColumn("module", Y.first_field(F.col("content"), "module"))
    if module_prefix:
        d = d.where(F.col("stem").startswith(module_prefix))
    text = F.when(Y.closing_offset(F.col("content")).isNull(), F.col("content")).otherwise(T.trim(Y.body(F.col("content"))))
    title = F.coalesce(Y.first_field(F.col("content"), "title"), F.col("stem"))
    return d.select("path", title.alias("title"), "module", T.slug(F.col("stem")).alias("anchor"), text.alias("section"))


def contents(sections: DataFrame) -> DataFrame:
    """(path, line): the table of contents, one line per document."""
    return sections.select("path", F.concat(F.lit("- ["), "title", F.lit("](#"), "anchor", F.lit(")")).alias("line"))


def index(docs: DataFrame, module: str | None = None, rename: tuple[str, str] | None = None) -> DataFrame:
    """(path, target, title, words, hash): the export's index; with a module filter and a file-name prefix replaced."""
    d = docs if module is None else docs.where(F.contains(Y.first_field(F.col("content"), "module"), F.lit(module)))
    name = F.col("file_name")
    if rename:
        name = F.when(name.startswith(rename[0]), F.concat(F.lit(rename[1]), F.substring(name, F.lit(len(rename[0]) + 1), F.length(name)))).otherwise(name)
    return d.select("path", name.alias("target"), Y.first_field(F.col("content"), "title").alias("title"), T.words(F.col("content")).alias("words"), T.sha16(F.col("content")).alias("hash"))


def metadata(docs: DataFrame, modules: tuple[str, ...] = (), prefix_rename: bool = False) -> DataFrame:
    """(id, title, module, word_count, exported_as, path): what an export writes about each file. A module filter keeps modules
    that contain one of the names and stems that start with one; renaming puts the module before the file's name."""
    module = Y.first_field(F.col("content"), "module")
    d = docs.withColumn("module", module)
    if modules:
        hit = F.lit(False)
        for m in modules:
            hit = hit | F.coalesce(F.contains("module", F.lit(m)), F.lit(False)) | F.col("stem").startswith(m)
        d = d.where(hit)
    name = F.col("file_name")
    if prefix_rename:
        name = F.coalesce(F.concat(F.translate("module", " .", "_-"), F.lit("_"), "file_name"), name)
    title = F.coalesce(Y.first_field(F.col("content"), "title"), F.col("stem"))
    return d.select(F.col("stem").alias("id"), title.alias("title"), "module", T.words(F.col("content")).alias("word_count"), name.alias("exported_as"), "path")


def index_totals(entries: DataFrame) -> DataFrame:
    """One row over `metadata`: files, distinct modules, words."""
    return entries.agg(F.count(F.lit(1)).alias("total_files"), F.count_distinct("module").alias("modules"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"))


def token_budget(docs: DataFrame, most: int) -> DataFrame:
    """Documents in order of path as long as their estimated tokens (four characters each) stay in the budget (an
    extension). The running sum sorts (path, tokens) in one task, which a budget for one export allows."""
    cost = F.ceil(F.length("content") / 4).cast("long")
    rows = docs.select("path", cost.alias("tokens"))
    return rows.withColumn("total", F.sum("tokens").over(Window.orderBy("path"))).where(F.col("total") <= most)


def to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def markdown_row(columns: list[str]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[T.escape_markdown(F.col(c).cast("string")) for c in columns]), F.lit(" |"))


def html_section(title: Column, text: Column) -> Column:
    escape = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<section><h2>"), escape(title), F.lit("</h2><pre>"), escape(text), F.lit("</pre></section>"))


def single_text(sections: DataFrame, preview: int | None = None) -> DataFrame:
    """One row with everything, in order of path, or the first `preview` lines of that. It is as long as the corpus: meant
    for small ones; write_files scales."""
    parts = F.array_sort(F.collect_list(F.struct("path", "title", "section")))
    text = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("# "), p["title"], F.lit("\n\n"), p["section"])), "\n\n")
    shown = text if preview is None else F.array_join(F.slice(T.lines(text), 1, preview), "\n")
    return sections.agg(shown.alias("text"))


def write_files(docs: DataFrame, root: str) -> DataFrame:
    """Writes each document to root/path, under a temporary name first; returns (path, bytes) of what was written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import pyarrow.fs as pafs

        fs, where = pafs.FileSystem.from_uri(root)
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target = f"{where}/{path}"
                folder, name = target.rsplit("/", 1)
                fs.create_dir(folder, recursive=True)
                raw = (content or "").encode()
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(raw)
                fs.move(part, target)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return docs.select("path", "content").mapInArrow(run, "path string, bytes long")


def _each(paths: DataFrame, root: str, act, schema: str) -> DataFrame:
    """act(file system, target) for every path below root, in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        fs, where = pafs.FileSystem.from_uri(root)
        for batch in batches:
            done = [act(fs, f"{where}/{p}") for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(done, pa.bool_())], names=["path", "done"])

    return paths.select("path").mapInArrow(run, schema)


def _backup_name(target: str) -> str:
    folder, slash, name = target.rpartition("/")
    return folder + slash + (name.rsplit(".", 1)[0] if "." in name[1:] else name) + ".md.bak"


def backup_files(paths: DataFrame, root: str) -> DataFrame:
    """(path, done): copies each file below root to its backup; not done where there is no file."""
    return _each(paths, root, lambda fs, t: _copied(fs, t, _backup_name(t)), "path string, done boolean")


def restore_files(paths: DataFrame, root: str) -> DataFrame:
    """(path, done): copies each backup over its file; not done where there is no backup."""
    return _each(paths, root, lambda fs, t: _copied(fs, _backup_name(t), t), "path string, done boolean")


def remove_backups(paths: DataFrame, root: str) -> DataFrame:
    """(path, done): removes backups; not done where there is none. A task that runs again finds none."""
    return _each(paths, root, lambda fs, t: _removed(fs, _backup_name(t)), "path string, done boolean")


def _there(fs, name: str) -> bool:
    from pyarrow.fs import FileType

    return fs.get_file_info(name).type == FileType.File


def _copied(fs, source: str, target: str) -> bool:
    """Copies under a temporary name first."""
    import uuid

    if not _there(fs, source):
        return False
    part = f"{target}.{uuid.uuid4().hex}"
    fs.copy_file(source, part)
    fs.move(part, target)
    return True


def _removed(fs, name: str) -> bool:
    found = _there(fs, name)
    if found:
        fs.delete_file(name)
    return found


def write_zip(docs: DataFrame, file: str) -> int:
    """Streams the documents, in order of path, into one local ZIP on the driver; returns their number. One file has one
    writer, so this is for corpora that fit a disk."""
    import zipfile

    n = 0
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        for row in docs.select("path", "content").orderBy("path").toLocalIterator():
            z.writestr(row["path"], row["content"])
            n += 1
    return n
