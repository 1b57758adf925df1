"""Quality rules with risk-controlled cutoffs, in DataFrame expressions only.

Base statistics of each text (a word is a run of anything but ASCII white space) feed a few rules: "a text whose
feature is at or over the cutoff is rejected". The cutoffs are not set by hand. Labelled rows are the holdout, and for
each stratum and rule the candidate cutoffs are tested from the mildest on: a cutoff holds if the exact binomial tail
P(Bin(n, risk / rules) <= rejected good rows) is at most delta / (strata * rules). Testing in that fixed order stops at
the first failure, so the order needs no further correction; dividing by the number of strata and rules (Bonferroni)
covers the rest. With probability 1 - delta or more, no stratum loses more than `risk` of its good texts to the rules.

Defined results: a null text counts as empty (no words, so base_failed). A null or unknown stratum, and any stratum
whose good holdout rows could not certify a single cutoff even with no false rejection, belongs to the pooled stratum
"", which is tested like the others. No labelled rows: no cutoff is certified and only the base rule rejects. Repeated
rows and repeated ids are judged row by row. Extra columns are kept and never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACE, Scratch, join_small, let

#: Rule name -> candidate cutoffs, mildest first. A text is rejected if its feature is at or over the cutoff.
RULES = {
    "symbol_share": [2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05],
    "upper_share": [0.95, 0.9, 0.8, 0.6, 0.5, 0.4, 0.3],
    "dup_line_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2],
    "repeat_share": [0.3, 0.25, 0.2, 0.15, 0.1],
    "echo_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1],
}
RISK = 0.05
DELTA = 0.05
WINDOW = 8
#: Labelled rows for certifying when one in five is to stay free for checking the risk.
FOLD = "pmod(crc32(cast(doc_id as string)), 5) <> 0"


def _shifted(values: Column, step: int) -> tuple[Column, Column]:
    """The array without its last `step` elements, and without its first."""
    n = F.size(values) - step
    return F.slice(values, F.lit(1), n), F.slice(values, F.lit(step + 1), n)


def _repeat_words(hashed: Column) -> Column:
    """Words that lie in windows of eight words which occur twice or more in the text, each counted once.

    A window's key is built by doubling: pairs of word hashes, pairs of pairs, pairs of those. Only texts in which
    some key is repeated go on to sort the keys and to add up what the repeated windows cover.
    """

    def double(keys: Column, step: int) -> Column:
        return F.zip_with(*_shifted(keys, step), lambda a, b: F.xxhash64(a, b))

    def covered(keys: Column) -> Column:
        placed = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def starts(s: Column) -> Column:
            last = F.size(s) - 1
            twin = lambda i: ((i > 0) & (F.get(s, i - 1)["k"] == F.get(s, i)["k"])) | ((i < last) & (F.get(s, i + 1)["k"] == F.get(s, i)["k"]))
            return F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), last), twin), lambda i: F.get(s, i)["i"]))

        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(placed, lambda s: let(starts(s), total))

    def of_keys(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(covered(keys))

    whole = let(double(hashed, 1), lambda h2: let(double(h2, 2), lambda h4: let(double(h4, 4), of_keys)))
    return F.when(F.size(hashed) <= WINDOW, F.lit(0).cast("long")).otherwise(whole)


def _echoes(hashed: Column) -> Column:
    """Words that equal the word before them."""
    same = F.zip_with(*_shifted(hashed, 1), lambda a, b: a == b)
    return F.when(F.size(hashed) < 2, F.lit(0).cast("long")).otherwise(F.size(F.filter(same, lambda x: x)).cast("long"))


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds word counts and the features that the rules read; drops the text, so that what follows moves few bytes."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.transform(F.array_remove(F.split(t, SPACE), ""), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    chars = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("long")
    counted = docs.select(
        *[c for c in docs.columns if c != text],
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"), _echoes(w).alias("e"))).alias("_w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("_l"),
        chars(SPACE).alias("word_chars"),
        (F.length(t) - chars("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.length(t) - chars(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return (
        counted.withColumns({"n_words": F.col("_w.n"), "n_repeat_words": F.col("_w.r"), "n_echoes": F.col("_w.e"), "n_lines": F.col("_l.n"), "n_dup_lines": F.col("_l.d")})
        .drop("_w", "_l")
        .withColumns({
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
            "symbol_share": share(F.col("n_symbols"), F.col("n_words")),
            "upper_share": share(F.col("n_upper"), F.col("word_chars")),
            "dup_line_share": share(F.col("n_dup_lines"), F.col("n_lines")),
            "repeat_share": share(F.col("n_repeat_words"), F.col("n_words")),
            "echo_share": share(F.col("n_echoes"), F.col("n_words")),
        })
    )


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """Exact P(Bin(n, p) <= k), summed in logarithms; 1 where k is over the mean, which no test here passes."""
    step = math.log(p / (1 - p))
    zero = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + F.lit(step)
        return F.struct(term.alias("term"), (F.greatest(acc["total"], term) + F.log1p(F.exp(-F.abs(acc["total"] - term)))).alias("total"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(F.aggregate(terms, zero, add, lambda acc: acc["total"])))


def least_rows(strata: int, rules: int, risk: float, delta: float) -> int:
    """Good rows without which no cutoff can be certified."""
    return math.ceil(math.log(delta / (strata * rules)) / math.log1p(-risk / rules))


def certified_cutoffs(
    holdout: DataFrame, stratum: str = "stratum", rules: dict[str, list[float]] | None = None, risk: float = RISK, delta: float = DELTA
) -> DataFrame:
    """One row per stratum: good rows `n_good`, and `cut_<rule>`, the strictest certified cutoff or null.

    `holdout` has the features, `stratum` and `quality` (1: good). All counts are one aggregation with map-side
    sums, so a hot stratum is no hot task.
    """
    rules = rules or RULES
    counts = [F.sum((F.col(r) >= c).cast("long")).alias(f"{r}_{i}") for r, cs in rules.items() for i, c in enumerate(cs)]
    good = holdout.where(F.col("quality") == 1)
    per = good.groupBy(F.coalesce(F.col(stratum), F.lit("")).alias("stratum")).agg(F.count(F.lit(1)).alias("n_good"), *counts)
    most = per.where(F.col("n_good") >= least_rows(2, len(rules), risk, delta)).count() + 1
    need = least_rows(most, len(rules), risk, delta)
    pooled = F.when(F.col("n_good") >= need, F.col("stratum")).otherwise(F.lit(""))
    summed = per.groupBy(pooled.alias("stratum")).agg(*[F.sum(c).alias(c) for c in per.columns if c != "stratum"])
    level = delta / (most * len(rules))
    cuts = []
    for r, cs in rules.items():
        tests = F.array(*[
            F.struct(F.lit(float(c)).alias("cut"), (binomial_tail(F.col("n_good"), F.col(f"{r}_{i}"), risk / len(rules)) <= level).alias("holds"))
            for i, c in enumerate(cs)
        ])
        start = F.struct(F.lit(None).cast("double").alias("cut"), F.lit(True).alias("open"))
        fold = lambda a, x: F.struct(F.when(a["open"] & x["holds"], x["cut"]).otherwise(a["cut"]).alias("cut"), (a["open"] & x["holds"]).alias("open"))
        cuts.append(F.aggregate(tests, start, fold, lambda a: a["cut"]).alias(f"cut_{r}"))
    return summed.select("stratum", "n_good", *cuts)


def apply_cutoffs(stats: DataFrame, cutoffs: DataFrame, stratum: str, rules: dict[str, list[float]] | None = None) -> DataFrame:
    """Adds `rule_failed` (names of the rules that reject the row) and `kept`."""
    rules = rules or RULES
    cols = [f"cut_{r}" for r in rules]
    own = cutoffs.select(F.col("stratum").alias("_s"), F.struct(*cols).alias("_own"))
    pool = cutoffs.where(F.col("stratum") == "").agg(F.first(F.struct(*cols)).alias("_pool"))
    joined = join_small(stats.withColumn("_s", F.coalesce(F.col(stratum), F.lit(""))), own, ["_s"]).crossJoin(F.broadcast(pool))
    cut = lambda r: F.when(F.col("_own").isNotNull(), F.col(f"_own.cut_{r}")).otherwise(F.col(f"_pool.cut_{r}"))
    failed = F.array_compact(F.array(*[F.when(F.col(r) >= cut(r), F.lit(r)) for r in rules]))
    return joined.withColumn("rule_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("rule_failed") == 0)).drop("_s", "_own", "_pool")


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", holdout_rows: str = "true",
    risk: float = RISK, delta: float = DELTA, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of `docs` (doc_id, text, a stratum column): base statistics, base_failed, rule_failed, kept, and
    the columns named in `carry`.

    Cutoffs come from all labelled rows, or from those that `holdout_rows` selects, as FOLD does. The texts are read once: their statistics are written to a scratch table, and labels are joined to that.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    stats = scratch.table(base_statistics(docs.select("doc_id", *carry, F.col(stratum).alias("_stratum"), "text")), "stats")
    marks = labels.select("doc_id", "quality").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    holdout = stats.where(F.expr(holdout_rows)).join(marks, "doc_id").withColumn("stratum", F.col("_stratum"))
    cutoffs = scratch.table(certified_cutoffs(holdout, risk=risk, delta=delta), "cutoffs")
    return scratch.finish(apply_cutoffs(stats, cutoffs, "_stratum").withColumnRenamed("_stratum", "stratum"))


def oracle_sql(risk: float = RISK, delta: float = DELTA, fold: bool = True) -> str:
    """quality_verdicts in DuckDB SQL, from the tables documents and labels, with the cutoffs of FOLD or of all labelled
    rows; the verdict's rules joined by commas."""
    n_rules = len(RULES)
    level = f"{delta} / ((SELECT most FROM limits) * {n_rules})"
    least = f"ceil(ln({delta} / (CAST(%s AS DOUBLE) * {n_rules})) / ln(1 - {risk / n_rules}))"
    cuts = ", ".join(f"('{r}', {i}, {c})" for r, cs in RULES.items() for i, c in enumerate(cs))
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in RULES) + " END"
    tail = f"""CASE WHEN k > n_good * {risk / n_rules} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1)
      + i * ln({risk / n_rules}) + (n_good - i) * ln(1 - {risk / n_rules}))) FROM range(0, 100000) r(i) WHERE i <= k) END"""
    failed = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {r} >= c.cuts['{r}'] THEN '{r}' END" for r in RULES) + "], lambda x: x IS NOT NULL), ',')"
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, range(8) r(o) GROUP BY 1),
n AS (SELECT w.doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_echoes,
  len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {share("n_symbols", "n_words")} AS symbol_share, {share("n_upper", "word_chars")} AS upper_share,
  {share("n_dup_lines", "n_lines")} AS dup_line_share, {share("n_repeat_words", "n_words")} AS repeat_share, {share("n_echoes", "n_words")} AS echo_share FROM n),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * length(s))), lambda c, i:
    CASE WHEN (CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(s, (i // 8)::INT + 1, 1))) ELSE c END) % 2 = 1
      THEN xor((CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(s, (i // 8)::INT + 1, 1))) ELSE c END) // 2, 3988292384)
      ELSE (CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(s, (i // 8)::INT + 1, 1))) ELSE c END) // 2 END), 4294967295) AS crc
  FROM (SELECT doc_id, doc_id::VARCHAR AS s FROM labels WHERE quality = 1)),
good AS (SELECT f.* FROM f JOIN crc USING (doc_id) WHERE {"crc % 5 <> 0" if fold else "true"}),
per AS (SELECT lang, count(*) AS n FROM good GROUP BY 1),
limits AS (SELECT count(*) + 1 AS most FROM per WHERE n >= {least % "2"}),
strata AS (SELECT lang, CASE WHEN n >= {least % "(SELECT most FROM limits)"} THEN lang ELSE '' END AS stratum FROM per),
cut(rule, i, cut) AS (VALUES {cuts}),
counted AS (SELECT stratum, rule, i, cut, count(*) AS n_good, count(*) FILTER ({value} >= cut) AS k FROM good JOIN strata USING (lang), cut GROUP BY ALL),
tested AS (SELECT stratum, rule, i, cut, {tail} <= {level} AS holds FROM counted),
kept AS (SELECT stratum, rule, cut, bool_and(holds) OVER (PARTITION BY stratum, rule ORDER BY i) AS ok FROM tested),
best AS (SELECT stratum, rule, min(cut)::DOUBLE AS cut FROM kept WHERE ok GROUP BY 1, 2),
c AS (SELECT s.stratum, map_from_entries(list((rule, cut)) FILTER (rule IS NOT NULL)) AS cuts FROM (SELECT DISTINCT stratum FROM strata) s LEFT JOIN best USING (stratum) GROUP BY 1),
v AS (SELECT f.*, {failed} AS rules FROM f LEFT JOIN c ON c.stratum = CASE WHEN f.lang IN (SELECT stratum FROM strata) THEN f.lang ELSE '' END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(rules, '') = '' AS kept, coalesce(rules, '') AS rules FROM v
"""
