"""Quality rules whose cutoffs keep the share of good documents lost under a proven limit."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineout.llm.common import GAP, WORD, held_out, stored

SYMBOLS = r"[#*$%&|<>]"

# Each rule: a measure, larger is worse, and the cutoffs to try. A document fails
# a rule if its measure is above the cutoff.
GRID = {
    "symbol_share": tuple(i / 50 for i in range(1, 21)),
    "dup_line_share": tuple(i / 20 for i in range(1, 17)),
    "repeat_share": tuple(i / 20 for i in range(1, 17)),
    "word_length": tuple(i / 2 for i in range(10, 30)),
}
LIMIT = 0.02  # share of good documents that all rules together may lose, per stratum
RISK = 0.05  # chance that the limit is broken in any stratum


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts that the rules use, from whole texts; null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    split = docs.select(
        "doc_id", "lang", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.char_length(text) - F.regexp_count(text, F.lit(GAP))).cast("long").alias("word_chars"),
        (F.regexp_count(text, F.lit("\n")) + 1).cast("long").alias("n_lines"),
    )
    # Windows of three words as (hash, place), in hash order: equal windows stand side by side.
    hashed = split.withColumn("windows", F.when(F.size("words") >= 3, F.transform(
        F.sequence(F.lit(1), F.size("words") - 2),
        lambda i: F.struct(F.xxhash64(F.get("words", i - 1), F.lit("\x00"), F.get("words", i), F.lit("\x00"), F.get("words", i + 1)).alias("h"), i.alias("i")),
    )))
    ordered = hashed.select(
        "doc_id", "lang", "n_symbols", "word_chars", F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"), F.sort_array("windows").alias("windows"),
    )
    twice = F.filter("windows", lambda w, j: (w["h"] == F.get("windows", j - 1)["h"]) | (w["h"] == F.get("windows", j + 1)["h"]))
    placed = ordered.withColumn("at", F.sort_array(F.transform(twice, lambda w: w["i"])))
    # Each repeated window covers up to three words, less what the next one covers.
    covered = F.transform("at", lambda i, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - i, F.lit(3))))
    repeats = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")
    return placed.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", repeats.alias("n_repeat_words"))


def with_rule_measures(df: DataFrame) -> DataFrame:
    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return df.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words"),
    })


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def most_losses(trials: Column, limit: float, alpha: Column) -> Column:
    """The most losses x among ``trials`` at which P(Binomial(trials, limit) <= x) <= alpha; -1 if none.

    This is the exact one-sided bound: with x losses or fewer, the upper
    confidence bound of the loss rate is at most ``limit``.
    """
    odds = math_log(limit / (1 - limit))

    def step(state: Column, i: Column) -> Column:
        total = state["total"] + F.exp(state["log_term"])
        going = state["going"] & (total <= alpha)
        log_term = state["log_term"] + F.log((trials - i) / (i + 1)) + odds
        return F.struct(
            F.when(going, total).otherwise(state["total"]).alias("total"),
            F.coalesce(log_term, F.lit(-1e308)).alias("log_term"), going.alias("going"),
            F.when(going, i).otherwise(state["most"]).alias("most"),
        )

    start = F.struct(
        F.lit(0.0).alias("total"), (trials * math_log(1 - limit)).alias("log_term"), F.lit(True).alias("going"), F.lit(-1).cast("long").alias("most"),
    )
    # The mean is far above any bound that can hold, so it ends the sum.
    places = F.sequence(F.lit(0).cast("long"), F.ceil(trials * limit).cast("long"))
    return F.aggregate(places, start, step, lambda s: s["most"])


def math_log(x: float) -> Column:
    return F.log(F.lit(float(x)))


def certified_cutoffs(
    labelled: DataFrame, grid: Mapping[str, tuple[float, ...]] = GRID, limit: float = LIMIT, risk: float = RISK
) -> DataFrame:
    """One row per stratum (``lang``) with a struct per rule: the strictest certified cutoff, else null.

    ``labelled`` holds good held-out documents with the rules' measures. The
    limit is split evenly over the rules and the risk over all strata and rules
    (Bonferroni). A rule's cutoffs are tested by the exact binomial bound in fixed
    sequence, from the loosest on until one fails, which needs no further
    correction; losses only grow along it, so the last that holds is the answer.
    """
    lost = [
        F.count_if(F.col(rule) > cut).alias(f"{rule}_{i}") for rule, cuts in grid.items() for i, cut in enumerate(cuts)
    ]
    counted = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("trials"), *lost)
    counted = counted.withColumn("alpha", F.lit(risk) / (F.count(F.lit(1)).over(W.partitionBy(F.lit(0))) * len(grid)))
    most = counted.withColumn("most", most_losses(F.col("trials"), limit / len(grid), F.col("alpha")))
    cutoffs = []
    for rule, cuts in grid.items():
        chosen = F.lit(None).cast("double")
        for i, cut in reversed(list(enumerate(cuts))):
            chosen = F.when(F.col(f"{rule}_{i}") <= F.col("most"), F.lit(cut)).otherwise(chosen)
        cutoffs.append(chosen.alias(f"{rule}_cut"))
    return most.select(F.col("lang").alias("stratum"), "trials", *cutoffs)


def quality_rules(
    docs: DataFrame, labels: DataFrame, grid: Mapping[str, tuple[float, ...]] = GRID, limit: float = LIMIT, risk: float = RISK
) -> DataFrame:
    """One row per document: its counts, ``base_failed``, the rules' verdict and ``kept``.

    Strata are the values of ``lang``, null among them. Cutoffs come from
    documents labelled good (quality 1 in any label row) that pass the base rules
    and lie outside the fifth held out by crc32 of the id, so that fifth stays
    free to measure the loss. A stratum without enough labels to certify a cutoff
    loses nothing to that rule. Null and empty texts have no words and fail the
    base. Rows are judged one by one: repeated rows and ids give repeated rows.
    """
    seen = stored(measures(docs))
    rated = with_rule_measures(seen)
    good = labels.filter("quality = 1").select("doc_id").distinct()
    usable = rated.filter(~base_failed()).filter(~held_out(F.col("doc_id")))
    cutoffs = certified_cutoffs(usable.join(good, "doc_id", "left_semi"), grid, limit, risk)
    judged = rated.join(cutoffs, rated["lang"].eqNullSafe(cutoffs["stratum"]), "left")
    fails = F.lit(False)
    for rule in grid:
        fails = fails | F.coalesce(F.col(rule) > F.col(f"{rule}_cut"), F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & ~fails).alias("kept"),
    )


def op6_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_rules(docs, labels)


def _sql() -> str:
    counts = ",\n  ".join(
        f"count(*) FILTER ({rule} > {cut!r}::DOUBLE) AS {rule}_{i}" for rule, cuts in GRID.items() for i, cut in enumerate(cuts)
    )
    chosen = ",\n  ".join(
        "CASE " + " ".join(f"WHEN {rule}_{i} <= most THEN {cut!r}::DOUBLE" for i, cut in enumerate(cuts)) + f" END AS {rule}_cut"
        for rule, cuts in GRID.items()
    )
    fails = " OR ".join(f"coalesce({rule} > {rule}_cut, false)" for rule in GRID)
    limit = LIMIT / len(GRID)
    return r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM {documents}),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
line_counts AS (
 SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
 FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
words AS (SELECT r, w, row_number() OVER (PARTITION BY r ORDER BY i) AS i FROM (
  SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM docs)),
windows AS (SELECT r, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY r ORDER BY i)),
counted AS (SELECT r, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS twice FROM windows),
covered AS (SELECT r, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM counted),
word_counts AS (SELECT r, count(*) AS n_words, count(*) FILTER (c) AS n_repeat_words FROM covered GROUP BY r),
seen AS (
 SELECT doc_id, lang, coalesce(n_words, 0) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
 FROM docs LEFT JOIN line_counts USING (r) LEFT JOIN word_counts USING (r)),
rated AS (
 SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  coalesce(n_symbols::DOUBLE / nullif(word_chars, 0), 0) AS symbol_share, coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) AS dup_line_share,
  coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0) AS repeat_share, coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0) AS word_length
 FROM seen),
-- the table of crc32, to leave the same fifth out
crc_step AS (SELECT i AS n, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v
 FROM (SELECT unnest(range(0, 256))::BIGINT AS i)),
crc_table AS (SELECT list(v ORDER BY n) AS t FROM crc_step),
fold AS (
 SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
   lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 5 = 0 AS held
 FROM (SELECT DISTINCT doc_id FROM docs WHERE doc_id IS NOT NULL), crc_table),
labelled AS (
 SELECT rated.* FROM rated JOIN fold USING (doc_id)
 WHERE NOT base_failed AND NOT held AND doc_id IN (SELECT doc_id FROM {labels} WHERE quality = 1)),
losses AS (
 SELECT lang AS stratum, count(*) AS trials,
  COUNTS
 FROM labelled GROUP BY lang),
terms AS (
 SELECT stratum, i, sum(exp(lgamma(trials + 1) - lgamma(i + 1) - lgamma(trials - i + 1) + i * ln(LIMIT) + (trials - i) * ln(1 - LIMIT)))
   OVER (PARTITION BY stratum ORDER BY i) AS chance
 FROM (SELECT stratum, trials, unnest(range(0, CAST(ceil(trials * LIMIT) AS BIGINT) + 1)) AS i FROM losses)),
bounds AS (SELECT stratum, max(i) AS most FROM terms WHERE chance <= RISK / ((SELECT count(*) FROM losses) * RULES) GROUP BY stratum),
cutoffs AS (
 SELECT losses.stratum,
  CHOSEN
 FROM losses LEFT JOIN bounds ON losses.stratum IS NOT DISTINCT FROM bounds.stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (FAILS) AS kept
FROM rated LEFT JOIN cutoffs ON lang IS NOT DISTINCT FROM stratum
""".replace("COUNTS", counts).replace("CHOSEN", chosen).replace("FAILS", fails).replace("LIMIT", f"{limit!r}::DOUBLE").replace("RISK", f"{RISK!r}::DOUBLE").replace("RULES", str(len(GRID)))


OP6_SQL = _sql()
