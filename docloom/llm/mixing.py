"""Mixing sources to target weights by Poisson replication, in DataFrame expressions only.

A source of z characters that should make up the share w of a mixture of T characters is to be repeated w T / z times on
average: its rate. Each document draws its number of copies from a Poisson distribution with that mean, by inverting the
distribution function at a uniform number that is a hash of the seed and doc_id. So draws need no state, repeat on every
run and executor, and don't depend on how rows are partitioned. Means over `CHUNK` are drawn as sums of independent
parts with smaller means, so that no term underflows. The copies are shuffled globally: dealt to partitions by a hash of
seed, document and copy, and sorted by it within, so any prefix of the partitions is a sample of the mixture.

A hot source costs nothing extra: its size is an aggregation with map-side sums, its rate is joined by broadcast where the
sources are few (counted first), and by a join that splits hot keys where they are not.

Defined results: a null source is the source "". Null texts have no characters and are never drawn more often than their
source. A source without characters has rate 0. Rows with equal doc_id draw alike, rows with a null doc_id by their
texts. A source that `weights` does not name has weight 0. An empty table gives an empty result. Extra columns are kept, but
for the names copy_no and shuffle_key, which are replaced.

Very many rows of one doc_id, or of one text without an id, would share a shuffle key; the rows are therefore dealt by that
key and a hash of the row's text and place in its input, so that they spread, and sorted within a partition by the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import join_small, let

#: Means are split into parts of at most so much; a part's distribution function is an array of TERMS entries.
CHUNK = 16.0
TERMS = 90
#: Places that rows with one shuffle key are dealt to.
SPREAD = 256
#: Share of a source without explicit weights: its size to this power.
POWER = 0.7


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of a hash of the parts."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float = 1.0) -> DataFrame:
    """(_mix_source, rate): mean copies of a document per source. The mixture has `total` times the characters of docs."""
    size = docs.groupBy(F.coalesce("source", F.lit("")).alias("_mix_source")).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("z"))
    if weights is None:
        weight = F.pow("z", F.lit(POWER))
    else:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("_mix_source")), F.lit(0.0)) if weights else F.lit(0.0)
    weighed = size.withColumn("w", F.when(F.col("z") > 0, weight).otherwise(0.0))
    sums = weighed.agg(F.sum("z").alias("zz"), F.sum("w").alias("ww"))
    rate = F.when((F.col("z") > 0) & (F.col("ww") > 0), F.col("w") / F.col("ww") * F.col("zz") * total / F.col("z")).otherwise(0.0)
    return weighed.crossJoin(F.broadcast(sums)).select("_mix_source", rate.alias("rate"))  # sums is one row


def distribution(mean: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS - 1 of a Poisson variable, for means up to CHUNK."""
    start = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("sums"))

    def step(a: Column, k: Column) -> Column:
        term = a["term"] * mean / k
        return F.struct(term.alias("term"), F.array_append(a["sums"], F.element_at(a["sums"], -1) + term).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda a: a["sums"])


def name_of(docs: DataFrame) -> Column:
    """What a row's draws depend on: its doc_id, or its text where that is null."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def copies(parts: Column, sums: Column, seed: int, name: Column) -> Column:
    """Number of copies of a row: for each part, how many values of the distribution function lie below its draw."""
    draw = lambda j: let(uniform(F.lit(f"draw{seed}"), name, j.cast("string")), lambda u: F.size(F.filter(sums, lambda s: s < u)))
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda a, j: a + draw(j))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float = 1.0, seed: int = 11) -> DataFrame:
    """docs with its rows repeated as drawn and shuffled, and the columns copy_no (from 1) and shuffle_key."""
    rates = source_rates(docs, weights, total)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / CHUNK).cast("int"))
    tables = rates.withColumn("_mix_parts", parts).select("_mix_source", "_mix_parts", distribution(F.col("rate") / F.col("_mix_parts")).alias("_mix_sums"))
    at = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(SPREAD))
    named = docs.drop("copy_no", "shuffle_key").withColumns({"_mix_source": F.coalesce("source", F.lit("")), "_mix_name": name_of(docs), "_mix_at": at})
    drawn = join_small(named, tables, ["_mix_source"])
    counted = drawn.withColumn("_mix_n", copies(F.col("_mix_parts"), F.col("_mix_sums"), seed, F.col("_mix_name"))).drop("_mix_source", "_mix_parts", "_mix_sums").where(F.col("_mix_n") > 0)
    many = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).drop("_mix_n")
    key = F.md5(F.concat_ws(":", F.lit(f"place{seed}"), F.col("_mix_name"), F.col("copy_no").cast("string")))
    keyed = many.withColumn("shuffle_key", F.substring(key, 1, 16)).drop("_mix_name")
    return keyed.repartition("shuffle_key", "_mix_at").drop("_mix_at").sortWithinPartitions("shuffle_key")


ORACLE_SQL = f"""
WITH size AS (SELECT coalesce(source, '') s, sum(length(coalesce(text, '')))::DOUBLE z FROM documents GROUP BY 1),
weighed AS (SELECT s, z, CASE WHEN z > 0 THEN pow(z, {POWER}) ELSE 0 END w FROM size),
rates AS (SELECT s, CASE WHEN z > 0 THEN w / (SELECT sum(w) FROM weighed) * (SELECT sum(z) FROM weighed) / z ELSE 0 END rate FROM weighed),
parts AS (SELECT s, greatest(1, ceil(rate / {CHUNK})::INT) m, rate / greatest(1, ceil(rate / {CHUNK})) mean FROM rates),
terms AS (SELECT s, k, CASE WHEN mean > 0 THEN exp(-mean + k * ln(mean) - lgamma(k + 1)) ELSE (k = 0)::INT END term FROM parts, range({TERMS}) t(k)),
cdf AS (SELECT s, k, sum(term) OVER (PARTITION BY s ORDER BY k) c FROM terms),
draws AS (
  SELECT d.doc_id, d.source, d.text, name, p.s, (('0x' || substr(md5('draw11:' || name || ':' || j), 1, 13))::BIGINT + 0.5) / pow(2, 52) u, j
  FROM (SELECT *, row_number() OVER () rn, coalesce(doc_id::VARCHAR, 'null ' || md5(coalesce(text, ''))) AS name FROM documents) d JOIN parts p ON p.s = coalesce(d.source, ''), range(1, 100) r(j) WHERE j <= p.m
),
counted AS (
  SELECT doc_id, source, text, name, sum((SELECT count(*) FROM cdf WHERE cdf.s = draws.s AND cdf.c < draws.u))::INT n FROM draws GROUP BY ALL
)
SELECT doc_id, source, copy_no::INT AS copy_no, substr(md5('place11:' || name || ':' || copy_no), 1, 16) AS shuffle_key, text
FROM counted, range(1, 1000) c(copy_no) WHERE copy_no <= n
"""
