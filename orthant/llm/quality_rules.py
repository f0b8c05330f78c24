"""Quality rules whose cutoffs carry a proven limit on false rejections.

Base: counts over a text's words (runs of anything but space and \\t-\\r) and lines; a text fails where it
has under 20 words or over 30 in 100 of its words stand in repeated 8-word windows.

Method: each rule rejects texts whose value (a ratio of counts) exceeds a cutoff. For every stratum
(a language) and rule the cutoffs are tested from the most lenient on, against labelled holdouts: a
cutoff is safe if the exact binomial tail P(Bin(n, limit) <= k) of its k false rejections among n good
texts is at most delta divided by the number of strata times rules (Bonferroni). The first unsafe
cutoff ends the sequence (fixed-sequence testing, so the cutoffs of one sequence need no further
correction) and the strictest safe one is used; a stratum with too few labels rejects nothing. The
rules share the stratum's limit equally, so together they reject at most `limit` of good texts, with
probability 1 - delta.

All of it is DataFrame code: no Python runs on the executors. Counts are made once per text, in one
row, and checkpointed (some 100 bytes a text); holdouts are summed per stratum before the shuffle.

Edge cases: a null text counts as empty, has 0 words and fails; a null stratum is one of its own;
repeated rows are each judged; a text's label is good if any of its rows in the labels is; an id that
is null joins no label; without labels no rule rejects anything; extra columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import checkpoint, crc32_sql, table

WINDOW = 8
LIMIT, DELTA = 0.02, 0.05
_WS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

#: rule -> (value, as SQL over the counts; cutoffs from lenient to strict)
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.125)),
    "capitals": ("n_upper / word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25)),
    "lines": ("n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25)),
    "repeats": ("n_repeat_words / n_words", (0.3, 0.275, 0.25, 0.225, 0.2, 0.175, 0.15, 0.125)),
}


def _pairs(hashes: Column, step: int) -> Column:
    """Hashes of windows twice as long as those of `hashes`, which have `step` words."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_upper of each text."""
    without = F.col("_text")
    for symbol in _SYMBOLS:
        without = F.replace(without, F.lit(symbol))
    step = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    step = step.withColumn("_trim", F.btrim("_text", F.lit(_WS)))
    step = step.withColumn("_words", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", r"[\x20\x09-\x0D]+")))
    step = step.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(_WS)) != ""))
    step = step.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.octet_length("_text") - F.octet_length(without)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.octet_length("_text") - F.octet_length(F.regexp_replace("_text", "[A-Z]+", ""))).cast("long").alias("n_upper"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h1"),
    )
    step = step.withColumn("_h2", _pairs(F.col("_h1"), 1)).drop("_h1")
    step = step.withColumn("_h4", _pairs(F.col("_h2"), 2)).drop("_h2")
    step = step.withColumn("_h8", _pairs(F.col("_h4"), 4)).drop("_h4")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    step = step.withColumn("_sorted", F.when(F.size(F.array_distinct("_h8")) == F.size("_h8"), none).otherwise(F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_h8")
    near = lambda x, k, by: F.coalesce(F.get(F.col("_sorted"), k + by)["h"] == x["h"], F.lit(False))
    flagged = F.transform("_sorted", lambda x, k: F.when(near(x, k, -1) | near(x, k, 1), x["i"]))
    step = step.withColumn("_at", F.when(F.size("_sorted") == 0, F.array().cast("array<int>")).otherwise(F.sort_array(F.array_compact(flagged)))).drop("_sorted")
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("_at", start, lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n")), lambda s: s["n"])
    return step.withColumn("n_repeat_words", covered.cast("long")).drop("_at")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _value(rule: str) -> Column:
    over, under = RULES[rule][0].split(" / ")
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


def _tail(limit: float) -> Column:
    """P(Bin(n, limit) <= k), in logarithms; 1 where k is above the mean, which no test could pass."""
    odds = limit / (1 - limit)
    n, k = F.col("n").cast("double"), F.col("k")
    first = n * F.lit(math.log1p(-limit))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i * odds)
        return F.struct(term.alias("term"), (F.greatest(s["sum"], term) + F.log1p(F.exp(-F.abs(s["sum"] - term)))).alias("sum"))

    start = F.struct(first.alias("term"), first.alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), start, add, lambda s: F.exp(s["sum"]))
    return F.when(k > n * limit, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(total)


def safe_cutoffs(holdout: DataFrame, stratum: str, limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff: the strictest safe cutoff of each rule, where there is one. holdout: counts of good texts."""
    rejected = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(i).alias("at"), F.lit(c).alias("cutoff"), F.sum((_value(r) > c).cast("long")).alias("k")) for r, (_, cuts) in RULES.items() for i, c in enumerate(cuts)))
    summed = checkpoint(holdout.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), rejected.alias("tests")))
    strata = max(1, summed.count())
    share, level = limit / len(RULES), delta / (strata * len(RULES))
    tests = summed.select(stratum, "n", F.explode("tests").alias("t")).select(stratum, "n", "t.*")
    tests = tests.withColumn("safe", _tail(share) <= level)
    unsafe = F.coalesce(F.min(F.when(~F.col("safe"), F.col("at"))), F.lit(2**31 - 1))
    ends = tests.groupBy(stratum, "rule").agg(unsafe.alias("end"), F.collect_list(F.struct("at", "cutoff")).alias("cuts"))
    best = F.array_max(F.filter("cuts", lambda c: c["at"] < F.col("end")))["cutoff"]
    return ends.select(stratum, "rule", best.alias("cutoff")).where("cutoff is not null")


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang", limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """key, stratum, the counts, base_failed and kept. labels: key and quality (1: good); good ones among rows whose crc32(key) mod 5 is not 0 calibrate."""
    made = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"), F.col(text).alias("_body"))
    made = checkpoint(counts(made, "_body", ("_key", "_stratum")).withColumn("base_failed", base_failed()))
    good = labels.where("quality = 1").select(F.col(key).alias("_key")).where(F.pmod(F.crc32(F.col("_key").cast("string").cast("binary")), F.lit(5)) != 0).distinct()
    cutoffs = safe_cutoffs(made.where(~F.col("base_failed")).join(good, "_key", "left_semi"), "_stratum", limit, delta)
    by_stratum = cutoffs.groupBy("_stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cuts"))
    over = [F.coalesce(_value(r) > F.col("_cuts")[r], F.lit(False)) for r in RULES]
    rejected = over[0]
    for x in over[1:]:
        rejected = rejected | x
    return made.join(by_stratum, "_stratum", "left").select(
        F.col("_key").alias(key), F.col("_stratum").alias(stratum), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept")
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """The same in DuckDB: windows are joined as texts, the tail is summed from log-gamma terms."""
    tests = ", ".join(f"('{r}', {i}, CAST({c!r} AS DOUBLE))" for r, (_, cuts) in RULES.items() for i, c in enumerate(cuts))
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN CASE WHEN {v.split(' / ')[1]} > 0 THEN CAST({v.split(' / ')[0]} AS DOUBLE) / {v.split(' / ')[1]} ELSE 0 END" for r, (v, _) in RULES.items()) + " END"
    share = LIMIT / len(RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p : p + {WINDOW - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d WHERE len(w) >= {WINDOW})),
twice AS (SELECT doc_id, x FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + {WINDOW})) AS q FROM win JOIN twice USING (doc_id, x)) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
c AS (
  SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS BIGINT) AS n_upper, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)
),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
bits AS (SELECT b.*, doc_id IN (SELECT doc_id FROM good) AND NOT base_failed AND fold <> 0 AS used FROM b JOIN (SELECT doc_id, {crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 AS fold FROM documents) USING (doc_id)),
rules(rule, stage, cutoff) AS (VALUES {tests}),
k AS (SELECT lang, rule, stage, cutoff, count(*) AS n, count(*) FILTER (WHERE {value} > cutoff) AS k FROM bits, rules WHERE used GROUP BY ALL),
p AS (SELECT k.*, CASE WHEN k > n * {share!r} THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - CASE WHEN i = n THEN 0 ELSE lgamma(n - i + 1) END + i * ln({share!r}) + (n - i) * ln(1 - {share!r}))) FROM unnest(range(0, k + 1)) AS u(i)) END AS tail FROM k),
s AS (SELECT *, tail <= {DELTA!r} / ((SELECT count(DISTINCT lang) FROM k) * {len(RULES)}) AS safe FROM p),
e AS (SELECT lang, rule, coalesce(min(CASE WHEN NOT safe THEN stage END), 1000) AS stop FROM s GROUP BY ALL),
cut AS (SELECT lang, rule, arg_max(cutoff, stage) AS cutoff FROM s JOIN e USING (lang, rule) WHERE stage < stop GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id FROM b JOIN cut USING (lang) WHERE {value} > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM b
"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": _oracle()}
