"""Accept or reject URLs: fixed rules first, else the ratio of two character language models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lineout.llm.common import LOWER, UPPER, lower_ascii, stored

ORDER = 4
ESCAPE = 4  # weight of the shorter context in each smoothed estimate
UNIT = 1_000_000  # log ratios are added up as integer millionths
STEP = UNIT // 100  # resolution of the calibrated cutoff
SALTS = 16


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (
    Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"), Rule("block", "com/de/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct (text, verdict); null if none does."""
    found = F.lit(None)
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(urls: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per character of ``body``: the ``ORDER`` characters that end there, with begin marks."""
    padded = F.concat(F.lit("\x02" * (ORDER - 1)), F.col("body"), F.lit("\x03"))
    at = F.sequence(F.lit(1), F.char_length("body") + 1)
    return urls.select(*keep, padded.alias("padded"), F.explode(at).alias("at")).select(
        *keep, F.substring(F.col("padded"), F.col("at"), F.lit(ORDER)).alias("gram")
    )


def gram_weights(grams: DataFrame) -> DataFrame:
    """Integer log ratio (gram, weight) of each gram seen, from columns gram, accepted, rejected (counts).

    Each class has a model that predicts the gram's last character from up to
    ``ORDER - 1`` characters before it: p_k = (count + E * p_(k-1)) / (context + E),
    from one even chance over the characters known up to the longest context.
    """
    out = grams
    known = grams.agg(F.countDistinct(F.substring("gram", -1, 1)).alias("n")).scalar()
    for k in range(1, ORDER + 1):
        tail, context = F.substring("gram", -k, k), F.substring("gram", -k, k - 1)
        counts = grams.groupBy(tail.alias(f"t{k}")).agg(F.sum("accepted").alias(f"a{k}"), F.sum("rejected").alias(f"r{k}"))
        totals = grams.groupBy(context.alias(f"c{k}")).agg(F.sum("accepted").alias(f"ca{k}"), F.sum("rejected").alias(f"cr{k}"))
        out = out.join(counts, tail == F.col(f"t{k}")).join(totals, context == F.col(f"c{k}"))

    def log_chance(count: str, context: str) -> Column:
        p = F.lit(1.0) / (known + 1)
        for k in range(1, ORDER + 1):
            p = (F.col(f"{count}{k}") + ESCAPE * p) / (F.col(f"{context}{k}") + ESCAPE)
        return F.log(p)

    weight = F.round((log_chance("a", "ca") - log_chance("r", "cr")) * UNIT).cast("long")
    return out.select("gram", weight.alias("weight"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    A rule's verdict holds where one fits. URLs with a rule also teach the two
    models (all but 3 of 16, by md5 of the id), and those held out set the
    cutoff: the lowest hundredth with the best mean of accepted and rejected
    URLs judged rightly. Other URLs are allowed if their log-likelihood
    difference per character reaches it. ``score`` is in millionths.

    A null url has empty host and path and an empty text to judge. If either
    class has no URL to learn from, or none held out, the cutoff is 0. Every row
    is judged on its own, so repeated rows and ids give repeated results. The
    grams are pre-aggregated before they are shuffled, and the table of weights is
    dealt ``SALTS`` times so that a gram of every URL is spread over tasks.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    body = F.coalesce(F.regexp_replace(F.col("url"), r"(?s)^.*?://", ""), F.lit(""))
    read = pages.select("page_id", host.alias("host"), path.alias("path"), body.alias("body"))
    ruled = read.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.translate("body", UPPER, LOWER).alias("body"),
        F.col("fit.text").alias("rule"), F.col("fit.verdict").alias("ruled"),
    )
    held = F.substring(F.md5(F.col("page_id").cast("string")), 1, 1).isin("0", "1", "2")
    teaches = F.col("ruled").isNotNull() & ~F.coalesce(held, F.lit(False))
    # Equal texts have equal scores: score each once.
    bodies = stored(ruled.groupBy("body").agg(
        F.count_if(teaches & (F.col("ruled") == "allow")).alias("accepted"),
        F.count_if(teaches & (F.col("ruled") == "block")).alias("rejected"),
        F.count_if(~teaches & (F.col("ruled") == "allow")).alias("good"),
        F.count_if(~teaches & (F.col("ruled") == "block")).alias("bad"),
    ))
    counted = _grams(bodies, ["accepted", "rejected"]).groupBy("gram").agg(
        F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected")
    )
    weights = gram_weights(stored(counted)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    seen = _grams(bodies, ["body", "good", "bad"]).withColumn("salt", F.pmod(F.xxhash64("body"), F.lit(SALTS)).cast("int"))
    scored = seen.join(weights, ["gram", "salt"]).groupBy("body").agg(
        F.floor(F.sum("weight") / F.count("weight")).alias("score"), F.max("good").alias("good"), F.max("bad").alias("bad"),
    )
    scored = stored(scored)
    steps = scored.filter("good + bad > 0").groupBy(F.floor(F.col("score") / STEP).alias("step")).agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad")
    )
    everywhere = W.partitionBy(F.lit(0))
    upward = W.orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    right = (
        (F.sum("good").over(everywhere) - F.coalesce(F.sum("good").over(upward), F.lit(0))) / F.sum("good").over(everywhere)
        + F.coalesce(F.sum("bad").over(upward), F.lit(0)) / F.sum("bad").over(everywhere)
    )
    cut = steps.filter("step IS NOT NULL").select("step", F.when((F.sum("good").over(everywhere) > 0) & (F.sum("bad").over(everywhere) > 0), right).alias("right"))
    cut = cut.filter("right IS NOT NULL").agg(F.max_by("step", F.struct("right", -F.col("step"))).alias("step"))
    taught = bodies.agg(((F.sum("accepted") > 0) & (F.sum("rejected") > 0)).alias("taught"))
    cutoff = F.when(taught.select("taught").scalar(), cut.select("step").scalar() * STEP)
    verdict = F.when(F.col("ruled").isNotNull(), F.col("ruled")).when(F.col("score") >= F.coalesce(cutoff, F.lit(0)), "allow").otherwise("block")
    return ruled.join(scored.select("body", "score"), "body").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op4_url_filter(pages: DataFrame) -> DataFrame:
    return judge_urls(pages)


OP4_SQL = r"""
WITH read AS (
 SELECT page_id,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw_host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
  translate(coalesce(regexp_replace(url, '(?s)^.*?://', ''), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
 FROM {pages}),
hosts AS (SELECT *, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM read),
ruled AS (
 SELECT *, CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
 FROM hosts),
kinds AS (
 SELECT ruled.*, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled,
  coalesce(substr(md5(CAST(page_id AS VARCHAR)), 1, 1) IN ('0', '1', '2'), false) AS held FROM ruled),
bodies AS (
 SELECT body, count(*) FILTER (NOT held AND ruled = 'allow') AS accepted, count(*) FILTER (NOT held AND ruled = 'block') AS rejected,
  count(*) FILTER (held AND ruled = 'allow') AS good, count(*) FILTER (held AND ruled = 'block') AS bad FROM kinds GROUP BY body),
padded AS (SELECT *, chr(2) || chr(2) || chr(2) || body || chr(3) AS p, unnest(range(1, length(body) + 2)) AS i FROM bodies),
seen AS (SELECT body, good, bad, accepted, rejected, substr(p, CAST(i AS INT), 4) AS gram FROM padded),
grams AS (SELECT gram, sum(accepted) AS a, sum(rejected) AS r FROM seen GROUP BY gram),
wide AS (
 SELECT gram,
  sum(a) OVER (PARTITION BY right(gram, 1)) AS a1, sum(r) OVER (PARTITION BY right(gram, 1)) AS r1, sum(a) OVER () AS ca1, sum(r) OVER () AS cr1,
  sum(a) OVER (PARTITION BY right(gram, 2)) AS a2, sum(r) OVER (PARTITION BY right(gram, 2)) AS r2,
  sum(a) OVER (PARTITION BY substr(gram, 3, 1)) AS ca2, sum(r) OVER (PARTITION BY substr(gram, 3, 1)) AS cr2,
  sum(a) OVER (PARTITION BY right(gram, 3)) AS a3, sum(r) OVER (PARTITION BY right(gram, 3)) AS r3,
  sum(a) OVER (PARTITION BY substr(gram, 2, 2)) AS ca3, sum(r) OVER (PARTITION BY substr(gram, 2, 2)) AS cr3,
  a AS a4, r AS r4, sum(a) OVER (PARTITION BY substr(gram, 1, 3)) AS ca4, sum(r) OVER (PARTITION BY substr(gram, 1, 3)) AS cr4,
  1.0 / ((SELECT count(DISTINCT right(gram, 1)) FROM grams) + 1)::DOUBLE AS p0 FROM grams),
weights AS (
 SELECT gram, CAST(round((
   ln((a4 + 4 * (a3 + 4 * (a2 + 4 * (a1 + 4 * p0) / (ca1 + 4)) / (ca2 + 4)) / (ca3 + 4)) / (ca4 + 4))
   - ln((r4 + 4 * (r3 + 4 * (r2 + 4 * (r1 + 4 * p0) / (cr1 + 4)) / (cr2 + 4)) / (cr3 + 4)) / (cr4 + 4))) * 1000000) AS BIGINT) AS weight
 FROM wide),
scored AS (
 SELECT body, max(good) AS good, max(bad) AS bad, CAST(floor(sum(weight)::DOUBLE / count(*)) AS BIGINT) AS score
 FROM seen JOIN weights USING (gram) GROUP BY body),
steps AS (SELECT CAST(floor(score / 10000.0::DOUBLE) AS BIGINT) AS step, sum(good) AS good, sum(bad) AS bad FROM scored WHERE good + bad > 0 GROUP BY 1),
rights AS (
 SELECT step, (sum(good) OVER () - coalesce(sum(good) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(good) OVER ()
  + coalesce(sum(bad) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / sum(bad) OVER () AS r,
  sum(good) OVER () > 0 AND sum(bad) OVER () > 0 AS known FROM steps),
cutoff AS (
 SELECT CASE WHEN (SELECT sum(accepted) > 0 AND sum(rejected) > 0 FROM bodies)
  THEN (SELECT step * 10000 FROM rights WHERE known ORDER BY r DESC, step LIMIT 1) END AS c)
SELECT page_id, host, path, rule,
 CASE WHEN ruled IS NOT NULL THEN ruled WHEN score >= coalesce((SELECT c FROM cutoff), 0) THEN 'allow' ELSE 'block' END AS verdict, score
FROM kinds JOIN scored USING (body)
"""
