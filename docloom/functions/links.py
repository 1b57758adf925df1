"""Link functions over Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as T

#: Link patterns (fixed values).
WIKI = r"\[\[([^\]]+)\]\]"
WIKI_NAME = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
MARKDOWN = r"\[([^\]]+)\]\(([^)]+)\)"
MARKDOWN_FILE = r"\[([^\]]+)\]\(([^)]+\.md)\)"
EMBED = r"!\[\[([^\]]+)\]\]"
IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
IMAGE_NO_ALT = r"!\[\]\([^)]+\)"
MERMAID = r"```mermaid\s*([\s\S]*?)```"
TABLE_ROW = r"^\|.+\|$"
TABLE_SEPARATOR = r"(?U)^\|[-:\s|]+\|$"
UNESCAPED_PIPE = r"\[\[[^\]\|\\]+\|[^\]]+\]\]"


def all_of(content: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(group))


def is_external(target: Column) -> Column:
    return target.startswith("http://") | target.startswith("https://")


def extract(content: Column) -> Column:
    """Links of a text as structs (position in bytes, link_type, target, text, raw), by position.

    Wiki and Markdown links directly after '!' are embeds. The position of a repeated raw link is its own: texts before
    each match are taken from the split at all earlier ones.
    """
    spec = [("embed", EMBED, 1, None), ("md_embed", IMAGE, 2, 1), ("wiki", r"(?<!!)\[\[([^\]|]+)(?:\|([^\]]+))?\]\]", 1, 2), ("markdown", r"(?<!!)\[([^\]]+)\]\(([^)]+)\)", 2, 1)]

    def of(kind: str, pattern: str, target: int, label: int | None) -> Column:
        raws, targets = all_of(content, pattern, 0), all_of(content, pattern, target)
        labels = all_of(content, pattern, label) if label else F.transform(raws, lambda _: F.lit(None).cast("string"))
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<position:bigint,link_type:string,target:string,text:string,raw:string>>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            here = F.call_function("locate", x["raw"], content, a["at"])
            name = F.when(F.lit(kind == "markdown") & is_external(x["target"]), "external").otherwise(kind)
            link = F.struct(
                F.octet_length(F.substring(content, F.lit(1), here - 1)).cast("long").alias("position"), name.alias("link_type"),
                x["target"].alias("target"), F.nullif(x["text"], F.lit("")).alias("text"), x["raw"].alias("raw"),
            )
            return F.struct((here + F.length(x["raw"])).alias("at"), F.array_append(a["out"], link).alias("out"))

        zipped = F.transform(F.arrays_zip(raws.alias("raw"), targets.alias("target"), labels.alias("text")), lambda z: F.struct(z["raw"].alias("raw"), z["target"].alias("target"), z["text"].alias("text")))
        return F.aggregate(zipped, start, step, lambda a: a["out"])

    return F.array_sort(F.flatten(F.array(*[of(*s) for s in spec])))


def normalized(target: Column, link_type: Column) -> Column:
    """The target without its anchor, with '.md' where an internal link names no extension."""
    bare = F.substring_index(target, "#", 1)
    internal = ~link_type.isin("embed", "md_embed", "external") & ~is_external(bare)
    return F.when(internal & ~bare.contains("."), F.concat(bare, F.lit(".md"))).otherwise(bare)


def bare_name(target: Column) -> Column:
    """Alias, path and anchor gone, in this order."""
    name = F.substring_index(F.replace(target, F.lit("\\|"), F.lit("|")), "|", 1)
    return T.trim(F.substring_index(F.substring_index(name, "/", -1), "#", 1))


def to_markdown(content: Column) -> Column:
    """Wiki links as Markdown links."""
    with_alias = F.regexp_replace(content, r"(?<!!)\[\[([^\]|]+)\|([^\]]+)\]\]", "[$2]($1.md)")
    return F.regexp_replace(with_alias, r"(?<!!)\[\[([^\]|]+)\]\]", "[$1]($1.md)")


def rename(content: Column, old: str, new: str) -> Column:
    """Wiki and Markdown links to `old` point to `new`."""
    for a, b in ((f"[[{old}]]", f"[[{new}]]"), (f"[[{old}|", f"[[{new}|"), (f"[[{old}#", f"[[{new}#"), (f"({old})", f"({new})"), (f"({old}.md)", f"({new}.md)")):
        content = F.replace(content, F.lit(a), F.lit(b))
    return content
