"""Named operators: plugins, aliases and categories; batch command files; configuration."""

from __future__ import annotations

import os
import shlex
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame

Operator = Callable[[DataFrame], DataFrame]


@dataclass
class Registry:
    """Operators by name and alias."""

    operators: dict[str, tuple[Operator, str]] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, operator: Operator, category: str = "general", aliases: tuple[str, ...] = ()) -> Registry:
        self.operators[name] = (operator, category)
        self.aliases.update(dict.fromkeys(aliases, name))
        return self

    def get(self, name: str) -> Operator | None:
        found = self.operators.get(self.aliases.get(name, name))
        return found[0] if found else None

    def names(self, category: str | None = None) -> list[str]:
        return sorted(n for n, (_, c) in self.operators.items() if category in (None, c))


def builtins() -> Registry:
    from docloom.operators import graph, links, lint, stats, verify

    r = Registry()
    r.add("verify", verify.summary, "check", ("v",)).add("lint", lint.lint, "check", ("l",)).add("links", links.totals, "check")
    r.add("audit", stats.audit, "check").add("health", stats.health, "report", ("h",)).add("stats", stats.project, "report", ("s",))
    r.add("coverage", stats.coverage, "report").add("modules", stats.modules, "report").add("report", stats.report, "report")
    r.add("deps", graph.edges, "graph", ("d",)).add("tree", graph.tree, "graph", ("t",))
    return r


def batch_file(text: str) -> list[list[str]]:
    """Commands of a batch file: one a line, blank lines and lines with # left out."""
    return [shlex.split(x) for x in map(str.strip, text.splitlines()) if x and not x.startswith("#")]


def hook_file(text: str) -> list[str]:
    """Commands of a hook file: one a line, blank lines and lines with # left out."""
    return [x for x in map(str.strip, text.splitlines()) if x and not x.startswith("#")]


def hook_commands(events: DataFrame, hooks: str) -> DataFrame:
    """(path, seq, command): the hooks of each changed path with $FILE filled in; nothing is run."""
    from pyspark.sql import functions as F

    lines = F.array(*[F.lit(x) for x in hook_file(hooks)]).cast("array<string>")
    out = events.select("path", F.posexplode(lines).alias("seq", "command"))
    return out.withColumn("command", F.replace("command", F.lit("$FILE"), F.col("path")))


def custom_vars(pairs: list[str]) -> dict[str, str]:
    """NAME=value arguments; those without = are left out, the value may hold further ones."""
    return {k.strip(): v.strip() for k, sign, v in (x.partition("=") for x in pairs) if sign}


def gate(docs: DataFrame) -> DataFrame:
    """One row: whether verify, lint and links pass, as a build gate would ask."""
    from pyspark.sql import functions as F

    from docloom.operators import links, lint, verify

    v = verify.summary(docs).agg(F.sum("errors").alias("verify_errors"))
    one = v.crossJoin(lint.summary(docs).select(F.col("errors").alias("lint_errors"))).crossJoin(links.totals(docs).select(F.col("broken").alias("broken_links")))
    return one.withColumn("passed", (F.col("verify_errors") == 0) & (F.col("lint_errors") == 0) & (F.col("broken_links") == 0))


@dataclass(frozen=True)
class Config:
    """Thresholds; from a mapping, then the environment (DOCLOOM_*)."""

    data_dir: str = "."
    output_dir: str = "out"
    min_words: int = 300
    min_sections: int = 3
    strict: bool = False

    @classmethod
    def of(cls, mapping: dict | None = None, env: dict | None = None) -> Config:
        out = replace(cls(), **{k: v for k, v in (mapping or {}).items() if k in {f.name for f in fields(cls)}})
        for f in fields(cls):
            raw = (env if env is not None else os.environ).get(f"DOCLOOM_{f.name.upper()}")
            if raw is not None:
                kind = type(getattr(out, f.name))
                out = replace(out, **{f.name: raw.lower() in ("1", "true") if kind is bool else kind(raw)})
        return out
