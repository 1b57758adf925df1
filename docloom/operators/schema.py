"""Frontmatter schema validation, predictions and fix routing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import links as L


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "string"  # string, integer, boolean, date, array, enum
    required: bool = False
    values: tuple[str, ...] = ()
    default: str | None = None
    column: str | None = None


#: The default schema (fixed values).
DEFAULT = (
    Field("id", required=True, column="doc_id"), Field("title", required=True), Field("parent"), Field("breadcrumb"),
    Field("status", "enum", values=("draft", "active", "deprecated", "archived", "reviewed"), default="draft"), Field("created", "date"),
    Field("last_updated", "date"), Field("author"), Field("domain"), Field("tags", "array"), Field("priority"),
)


def from_mapping(spec: dict) -> tuple[Field, ...]:
    """A schema from a parsed YAML mapping {fields: [{name, type, required, values, default}]}."""
    return tuple(Field(f["name"], f.get("type", "string"), f.get("required", False), tuple(f.get("values", ())), f.get("default")) for f in spec["fields"])


def _fits(value: Column, kind: str) -> Column:
    if kind == "integer":
        return value.rlike(r"^[+-]?\d+$")
    if kind == "boolean":
        return value.isin("true", "false")
    if kind == "date":
        return (F.octet_length(value) >= 10) & (F.substring(value, 5, 1) == "-")
    return F.lit(True)


def violations(docs: DataFrame, schema: tuple[Field, ...] = DEFAULT) -> DataFrame:
    """(path, field, violation, suggestion): one pass; the rules are one array of conditions."""
    checks = []
    for f in schema:
        name = f.column or f.name
        value = F.col(name) if name in docs.columns else F.lit(None).cast("string")
        issue = lambda kind, hint, n=f.name: F.struct(F.lit(n).alias("field"), F.lit(kind).alias("violation"), F.lit(hint).cast("string").alias("suggestion"))
        if f.required:
            checks.append(F.when(value.isNull(), issue("missing_required", f"{f.name}: {f.default}" if f.default else None)))
        checks.append(F.when(value.isNotNull() & ~_fits(value, f.kind), issue("wrong_type", None)))
        if f.values:
            checks.append(F.when(value.isNotNull() & ~value.isin(*f.values), issue("invalid_value", "one of: " + ", ".join(f.values))))
    return docs.select("path", F.explode(F.array_compact(F.array(*checks))).alias("v")).select("path", "v.*")


def defaults(docs: DataFrame, schema: tuple[Field, ...] = DEFAULT) -> DataFrame:
    """(path, field, default): optional fields that are missing and have a default."""
    found = [F.when(F.col(f.column or f.name).isNull(), F.struct(F.lit(f.name).alias("field"), F.lit(f.default).alias("default"))) for f in schema if f.default and not f.required]
    return docs.select("path", F.explode(F.array_compact(F.array(*found))).alias("d")).select("path", "d.*")


def predictions(docs: DataFrame, as_of: str, stale_days: int = 30, many_links: int = 10) -> DataFrame:
    """(path, kind, confidence, n): documents that go stale, and documents with many links."""
    day = F.when(F.col("last_updated").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date("last_updated"))
    age = F.datediff(F.lit(as_of).cast("date"), day)
    stale = docs.withColumn("n", age).where(F.col("n") > stale_days)
    stale = stale.select("path", F.lit("stale_document").alias("kind"), F.when(F.col("n") > 60, "high").otherwise("medium").alias("confidence"), F.col("n").cast("long").alias("n"))
    linked = docs.withColumn("n", F.size(L.extract(F.col("content")))).where(F.col("n") > many_links)
    return stale.unionByName(linked.select("path", F.lit("broken_link_risk").alias("kind"), F.lit("low").alias("confidence"), F.col("n").cast("long").alias("n")))


CONFIDENCE = {"low": 25, "medium": 50, "high": 75, "certain": 95}

#: Repairs by anomaly: action, whether it is safe to automate, urgency (fixed values).
ROUTES = (
    ("date_drift", "sync dates", True, "medium"), ("hash_mismatch", "sync hashes", True, "high"), ("broken_link", "fix links", False, "critical"),
    ("case_sensitive_link", "fix case", True, "high"), ("nietos_mismatch", "sync all", True, "high"), ("children_mismatch", "sync children", True, "high"),
    ("trailing_whitespace", "lint fix", True, "low"), ("missing_final_newline", "lint fix", True, "low"), ("code_no_language", "manual", False, "low"),
    ("missing_frontmatter", "add frontmatter", False, "critical"), ("breadcrumb_inconsistent", "sync breadcrumbs", True, "medium"),
)
#: Which anomaly a phase or rule finds.
ANOMALIES = {
    "2": "missing_frontmatter", "5": "breadcrumb_inconsistent", "8": "date_drift", "9": "broken_link", "20": "children_mismatch", "21": "hash_mismatch",
    "L003": "trailing_whitespace", "L004": "missing_final_newline", "L006": "code_no_language", "L013": "nietos_mismatch",
}


def routed(issues: DataFrame, code: str) -> DataFrame:
    """Issues with their anomaly and the repair for it; `code` is the column of the phase or rule."""
    spark = issues.sparkSession
    routes = spark.createDataFrame([(k, *r) for k, a in ANOMALIES.items() for r in ROUTES if r[0] == a], "code string, anomaly string, action string, auto_safe boolean, urgency string")
    return issues.withColumn("code", F.col(code).cast("string")).join(F.broadcast(routes), "code")  # eleven rows


#: Exit codes by kind of error, and kinds one can go on after (fixed values).
EXIT_CODES = {"general": 1, "io": 10, "not_found": 11, "yaml": 20, "validation": 21, "id": 30, "date": 31, "link": 32, "config": 90, "internal": 99}
