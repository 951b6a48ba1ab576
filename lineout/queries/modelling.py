"""Fitted models, most on small settings, and their tables against SQL.

A forest has no SQL equivalent, so those queries have no SQL; each trains and
scores on all cleaned rows and returns a small table of results.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineout import schema as S
from lineout.operators import additive, bagging, bayes, evaluate, features, machines, models, neighbours, reports, sampling
from lineout.queries.registry import query, rounded
from lineout.sources.write import materialise

SMALL = {"trees": 20, "depth": 6}


def _parts(t, required=S.CATEGORIES) -> tuple[DataFrame, DataFrame]:
    """Training rows, stored by themselves because fits read them again and again, and hold-out rows of the split table."""
    table = t.split.dropna(subset=list(required)) if required else t.split
    return materialise(table.filter(F.col("split") == "train")), sampling.out_of_training(table)


@query("p8_prediction_frame")
def _(t):
    train, rest = _parts(t)
    model = models.forest(*models.FEATURE_SETS["model 5"], **SMALL).fit(train)
    return models.score_hits(model, rest, "fits").select("fits", F.col("hit").alias("actuals"))


@query("f3_formula_features", """
WITH r AS (SELECT * FROM clean WHERE fielding_team IS NOT NULL),
 l AS (SELECT list(DISTINCT stand ORDER BY stand) AS stands, list(DISTINCT home_team ORDER BY home_team) AS teams FROM r)
SELECT row_key, hit, CAST(2 + len(stands) + len(teams) AS INTEGER) AS width, hit_speed AS x0, hit_angle AS x1,
 CAST(stand = 'L' AS DOUBLE) AS x2, CAST(stand = 'R' AS DOUBLE) AS x3,
 CAST(4 + list_position(teams, home_team) AS BIGINT) AS team_place, CAST(1 AS DOUBLE) AS team_flags
FROM r, l""")
def _(t):
    df = t.clean.dropna(subset=["fielding_team"])
    measures = VectorAssembler(inputCols=["hit_speed", "hit_angle"], outputCol="measures")
    stages = [measures, *models.one_hot_features(["measures"], ["stand", "home_team"])]
    x = vector_to_array("features")
    rows = Pipeline(stages=stages).fit(df).transform(df).select("row_key", "hit", x.alias("x"))
    teams = F.slice("x", F.lit(5), F.size("x") - 4)
    return rows.select(
        "row_key", "hit", F.size("x").alias("width"), *[F.col("x")[i].alias(f"x{i}") for i in range(4)],
        (4 + F.array_position(teams, F.lit(1.0))).alias("team_place"),
        F.aggregate(teams, F.lit(0.0), lambda a, b: a + b).alias("team_flags"),
    )


@query("c1_hit_forests")
def _(t):
    train, rest = _parts(t)
    tables = []
    for name, (numeric, categorical) in models.FEATURE_SETS.items():
        mtry = 2 if name == "model 5" else None
        model = models.forest(numeric, categorical, mtry=mtry, **SMALL).fit(train)
        scored = materialise(models.score_hits(model, rest).select("split", "hit", "p"))
        test = scored.filter(F.col("split") == "test")
        best = evaluate.best_cutoff(evaluate.roc_curve(test))
        fitted = evaluate.apply_cutoff(scored, best)
        tables.append(evaluate.metrics(fitted, by=["split"]).withColumn("model", F.lit(name)))
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def _type_metrics(model, rest):
    return evaluate.class_metrics(models.score_classes(model, rest), "hit_type", "fit")


@query("c2_type_forest")
def _(t):
    train, rest = _parts(t)
    numeric, categorical = models.TYPE_FEATURES
    model = models.forest([*numeric, "hor_angle"], categorical, "hit_type", mtry=3, **SMALL).fit(
        train.dropna(subset=["hor_angle"]))
    return _type_metrics(model, rest.dropna(subset=["hor_angle"]))


@query("c3_hits_only_forest")
def _(t):
    train, rest = _parts(t)
    model = models.hits_only_forest(**SMALL).fit(models.only_hits(train))
    return _type_metrics(model, models.only_hits(rest))


@query("c4_two_stage")
def _(t):
    train, rest = _parts(t)
    first = models.forest(*models.TYPE_FEATURES, **SMALL).fit(train)
    second = models.hits_only_forest(**SMALL).fit(models.only_hits(train))
    return evaluate.class_metrics(models.score_two_stage(first, second, rest), "hit_type", "fit")


@query("c5_class_probabilities")
def _(t):
    train, rest = _parts(t)
    model = models.forest(*models.TYPE_FEATURES, "hit_type", **SMALL).fit(train)
    return models.score_classes(model, rest).select("row_key", "fit", "fit_probabilities")


@query("c6_impurity_importance")
def _(t):
    train, _ = _parts(t)
    numeric, categorical = models.FEATURE_SETS["model 1"]
    model = models.forest(numeric, categorical, **SMALL).fit(train)
    return models.importance(model, numeric, categorical, t.spark)


@query("c6_permutation_importance")
def _(t):
    train, rest = _parts(t)
    numeric, categorical = models.FEATURE_SETS["model 5"]
    model = models.forest(numeric, categorical, **SMALL).fit(train)
    return models.permutation_importance(model, rest, [*numeric, *categorical])


@query("c6_donor_rows", """
WITH o AS (SELECT row_key, hit_speed, md5('donor42|' || row_key) AS h FROM clean)
SELECT row_key, hit_speed, coalesce(lead(hit_speed) OVER w, first_value(hit_speed) OVER w) AS donor
FROM o WINDOW w AS (PARTITION BY substr(h, 1, 2) ORDER BY h)""")
def _(t):
    rows = models.donor_rows(t.clean.select("row_key", "hit_speed"), ["hit_speed"])
    return rows.select("row_key", "hit_speed", F.col("_donor.hit_speed").alias("donor"))


@query("c7_error_by_trees")
def _(t):
    train, rest = _parts(t)
    return models.error_by_trees(train, rest, [5, 10, 20], *models.FEATURE_SETS["model 3"], depth=5)


# As many trees as published, of bounded depth; ten share a bag and a fit, to stay within a minute or two here.
BAGGED = {"trees": 501, "depth": 10, "per_bag": 10}


@query("c7_oob_error_by_trees")
def _(t):
    train, _ = _parts(t)
    numeric, categorical = models.FEATURE_SETS["model 3"]
    return bagging.oob_error(bagging.fit_bagged(train, numeric, categorical, **BAGGED), train)


@query("c7_bag_counts", f"""
WITH e AS (SELECT list_value({', '.join(f"'{edge}'" for edge in bagging.bag_edges())}) AS edges),
 drawn AS (SELECT tree, substr(md5('bag42|' || tree || '|' || row_key), 1, 8) AS h FROM split, (SELECT unnest([1, 2, 3, 4, 5]) AS tree) WHERE split = 'train'),
 counted AS (SELECT tree, len(list_filter(edges, lambda edge: edge <= h)) AS n FROM drawn, e)
SELECT CAST(tree AS INTEGER) AS tree, CAST(n AS INTEGER) AS n, CAST(count(*) AS BIGINT) AS rows FROM counted GROUP BY tree, n""")
def _(t):
    train = t.split.filter(F.col("split") == "train").select("row_key", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("tree"))
    return train.select("tree", bagging.bag_count("row_key", F.col("tree")).alias("n")).groupBy("tree", "n").agg(F.count(F.lit(1)).alias("rows"))


# Five threshold rules stand for trees, so that votes, shares and running errors have SQL.
_RULES = ("hit_speed > 70", "hit_angle BETWEEN -10 AND 35", "hit_distance_sc > 150", "hit_speed > 95", "stand = 'L'")
_RULE_VOTES = f"voted AS (SELECT row_key, hit, [{', '.join(f'CAST({r} AS INTEGER)' for r in _RULES)}] AS votes FROM split WHERE split = 'train')"


def _rule_votes(t) -> DataFrame:
    train = t.split.filter(F.col("split") == "train")
    return train.select("row_key", "hit", F.array(*[F.expr(rule).cast("int") for rule in _RULES]).alias("votes"))


@query("c5_shares_of_votes", f"""
WITH {_RULE_VOTES}
SELECT row_key, len(list_filter(votes, lambda v: v = 0)) / 5e0 AS out_share, len(list_filter(votes, lambda v: v = 1)) / 5e0 AS hit_share FROM voted""")
def _(t):
    share = bagging.shares("votes", 2)
    return _rule_votes(t).select("row_key", share[0].alias("out_share"), share[1].alias("hit_share"))


@query("c7_running_errors", f"""
WITH {_RULE_VOTES},
 e AS (SELECT list_value({', '.join(f"'{edge}'" for edge in bagging.bag_edges())}) AS edges),
 each AS (SELECT row_key, hit, unnest(votes) AS vote, generate_subscripts(votes, 1) AS tree FROM voted),
 outside AS (SELECT row_key, hit, tree, CASE WHEN substr(md5('bag42|' || tree || '|' || row_key), 1, 8) < edges[1] THEN vote END AS vote FROM each, e),
 counted AS (SELECT *, coalesce(sum(vote) OVER w, 0) AS ones, count(vote) OVER w AS n FROM outside WINDOW w AS (PARTITION BY row_key ORDER BY tree))
SELECT CAST(tree AS INTEGER) AS trees, CAST(count(*) AS BIGINT) AS rows,
 round(avg(CASE WHEN CAST(2 * ones > n AS INTEGER) <> hit THEN 1e0 ELSE 0e0 END), 6) AS error FROM counted WHERE n > 0 GROUP BY tree""")
def _(t):
    outside = bagging.out_of_bag(_rule_votes(t), "row_key", "hit")
    return rounded(bagging.running_errors(outside, "row_key", "hit", 2), "error")


@query("c5_vote_shares")
def _(t):
    train, rest = _parts(t)
    model = bagging.fit_bagged(train, *models.TYPE_FEATURES, "hit_type", trees=101, depth=10, per_bag=3)
    return bagging.score_shares(model, rest).select("row_key", "fit", "fit_probabilities")


@query("c6_oob_importance")
def _(t):
    train, _ = _parts(t)
    numeric, categorical = models.FEATURE_SETS["model 5"]
    model = bagging.fit_bagged(train, numeric, categorical, trees=101, depth=10, mtry=2, per_bag=3)
    return bagging.oob_importance(model, train, [*numeric, *categorical])


@query("c8_tune_mtry")
def _(t):
    train, rest = _parts(t)
    return models.tune_mtry(train, rest, *models.FEATURE_SETS["model 5"], trees=10, depth=5)


@query("c9_feature_count_error")
def _(t):
    train, _ = _parts(t)
    return models.feature_count_error(train, S.SCALED, folds=5, **SMALL)


_RANGES = {"hit_angle": (-90.0, 90.0), "hit_speed": (20.0, 120.0)}


@query("c10_spline_logit")
def _(t):
    train, rest = _parts(t)
    model = models.spline_logit(_RANGES, S.CATEGORIES, pieces=8, iterations=30).fit(train)
    return evaluate.metrics(models.predict_only(model, rest), by=["split"])


_SMOOTHS = (additive.Smooth("hit_angle", -90.0, 90.0, 7), additive.Smooth("hit_speed", 20.0, 120.0, 7))


@query("c10_additive_model")
def _(t):
    train, rest = _parts(t)
    fit = additive.fit_logistic(train, "hit", _SMOOTHS, S.CATEGORIES)
    fitted = additive.predict_logistic(fit, rest, "chance").withColumn("fit", (F.col("chance") > 0.5).cast("int"))
    return evaluate.metrics(fitted.drop("p"), by=["split"])


def _pieces_sql(at: str, pieces: int, rest: str = "t") -> str:
    """Values of the cubic pieces over interval and position, written out once for all."""
    arms = (f"pow(1 - {rest}, 3) / 6", f"(3 * pow({rest}, 3) - 6 * pow({rest}, 2) + 4) / 6",
            f"(3 * pow(1 - {rest}, 3) - 6 * pow(1 - {rest}, 2) + 4) / 6", f"pow({rest}, 3) / 6")
    return f"CASE {at} " + " ".join(f"WHEN {i} THEN {arm}" for i, arm in enumerate(arms)) + " ELSE 0e0 END"


# One row per training row and column of the design: the constant, then ten pieces of each measure.
_DESIGN = f"""held AS (SELECT row_key, hit, least(greatest(hit_angle, -90e0), 90e0) AS a, least(greatest(hit_speed, 20e0), 120e0) AS s
  FROM split WHERE split = 'train'),
 placed AS (SELECT row_key, hit, (a + 90) / (180e0 / 7) AS ua, (s - 20) / (100e0 / 7) AS us FROM held),
 cut AS (SELECT row_key, hit, ua, us, least(floor(ua), 6) AS ka, least(floor(us), 6) AS ks FROM placed),
 design AS (SELECT row_key, hit, 0 AS j, 1e0 AS x FROM cut
  UNION ALL SELECT row_key, hit, 1 + j, {_pieces_sql('CAST(j - ka AS INTEGER)', 7, '(ua - ka)')} FROM cut, (SELECT unnest(range(10)) AS j)
  UNION ALL SELECT row_key, hit, 11 + j, {_pieces_sql('CAST(j - ks AS INTEGER)', 7, '(us - ks)')} FROM cut, (SELECT unnest(range(10)) AS j))"""


@query("c10_cross_products", f"""
WITH {_DESIGN},
 filled AS (SELECT row_key, hit, list(x ORDER BY j) AS x FROM design GROUP BY row_key, hit),
 pairs AS (SELECT i, j, sum(x[i + 1] * x[j + 1]) AS value FROM filled, (SELECT unnest(range(21)) AS i), (SELECT unnest(range(21)) AS j)
  WHERE i <= j GROUP BY i, j),
 sides AS (SELECT j AS i, sum(x * hit) AS value FROM design GROUP BY j)
SELECT CAST(i * 21 - i * (i - 1) // 2 + j - i AS INTEGER) AS place, round(value + 1e-9, 3) AS value FROM pairs
UNION ALL SELECT CAST(231 + i AS INTEGER), round(value + 1e-9, 3) FROM sides""")
def _(t):
    train, _ = _parts(t, ())
    design = additive.Design(_SMOOTHS)
    sums = additive.cross_products(design.read(train, "hit"), design).filter(F.col("place") < 252)
    return sums.select("place", F.round(F.col("value") + 1e-9, 3).alias("value"))


_NUMERIC, _CATEGORICAL = ("hit_angle", "hit_speed"), ("stand", "home_team", "fielding_team")
_BAYES = """train AS (SELECT * FROM split WHERE split = 'train'),
 moments AS (SELECT hit_type AS class, count(*) AS n, avg(hit_angle) AS ma, stddev_samp(hit_angle) AS sa,
  avg(hit_speed) AS ms, stddev_samp(hit_speed) AS ss FROM train GROUP BY 1),
 pairs AS (SELECT hit_type AS class, 'stand' AS feature, stand AS level FROM train
  UNION ALL SELECT hit_type, 'home_team', home_team FROM train
  UNION ALL SELECT hit_type, 'fielding_team', fielding_team FROM train WHERE fielding_team IS NOT NULL),
 shares AS (SELECT class, feature, level, count(*) / sum(count(*)) OVER (PARTITION BY class, feature) AS share
  FROM pairs GROUP BY 1, 2, 3)"""


@query("c11_bayes_moments", f"""
WITH {_BAYES}
SELECT CAST(class AS INTEGER) AS class, CAST(n AS BIGINT) AS n, round(ma, 6) AS mean_hit_angle, round(sa, 6) AS sd_hit_angle,
 round(ms, 6) AS mean_hit_speed, round(ss, 6) AS sd_hit_speed FROM moments""")
def _(t):
    train = t.split.filter(F.col("split") == "train")
    table = bayes.class_moments(train, "hit_type", _NUMERIC)
    return rounded(table, *[c for c in table.columns if c not in ("class", "n")])


@query("c11_bayes_shares", f"""
WITH {_BAYES} SELECT CAST(class AS INTEGER) AS class, feature, level, round(share, 6) AS share FROM shares""")
def _(t):
    train = t.split.filter(F.col("split") == "train")
    return rounded(bayes.level_shares(train, "hit_type", _CATEGORICAL), "share")


@query("c11_naive_bayes", f"""
WITH {_BAYES},
 tests AS (SELECT row_key, hit_type, hit_angle, hit_speed, stand, home_team, fielding_team FROM split WHERE split = 'test'),
 terms AS (SELECT row_key, tests.hit_type, class, ln(n / (SELECT sum(n) FROM moments))
  + ln(CASE WHEN exp(-0.5 * pow((hit_angle - ma) / sa, 2)) / (sa * sqrt(2 * pi())) > 0
     THEN exp(-0.5 * pow((hit_angle - ma) / sa, 2)) / (sa * sqrt(2 * pi())) ELSE 0.001 END)
  + ln(CASE WHEN exp(-0.5 * pow((hit_speed - ms) / ss, 2)) / (ss * sqrt(2 * pi())) > 0
     THEN exp(-0.5 * pow((hit_speed - ms) / ss, 2)) / (ss * sqrt(2 * pi())) ELSE 0.001 END) AS part,
  stand, home_team, fielding_team FROM tests, moments),
 scores AS (SELECT row_key, hit_type, terms.class, part + ln(coalesce(a.share, 0.001)) + ln(coalesce(b.share, 0.001))
  + CASE WHEN fielding_team IS NULL THEN 0 ELSE ln(coalesce(c.share, 0.001)) END AS score FROM terms
  LEFT JOIN shares a ON a.class = terms.class AND a.feature = 'stand' AND a.level = stand
  LEFT JOIN shares b ON b.class = terms.class AND b.feature = 'home_team' AND b.level = home_team
  LEFT JOIN shares c ON c.class = terms.class AND c.feature = 'fielding_team' AND c.level = fielding_team)
SELECT row_key, hit_type, CAST(arg_max(class, score) AS INTEGER) AS fit FROM scores GROUP BY row_key, hit_type""")
def _(t):
    train, rest = _parts(t, list(_NUMERIC))
    test = rest.filter(F.col("split") == "test")
    fitted = bayes.fit_naive_bayes(train, "hit_type", _NUMERIC, _CATEGORICAL)
    return bayes.predict_naive_bayes(test, fitted, _NUMERIC, _CATEGORICAL).select("row_key", "hit_type", "fit")


_MACHINE = (("hit_angle", "hit_speed"), ("stand", "home_team", "fielding_team"))


@query("c12_kernel_svm")
def _(t):
    train, rest = _parts(t, ())
    return reports.contingency(machines.predict(machines.fit(train, *_MACHINE), rest), "hit_type", "fit")


@query("c12_landmark_kernel", """
WITH train AS (SELECT * FROM split WHERE split = 'train'),
 sd AS (SELECT stddev_samp(hit_angle) AS sa, stddev_samp(hit_speed) AS ss FROM train),
 marks AS (SELECT *, row_number() OVER (ORDER BY md5('landmark|' || row_key)) AS place FROM train QUALIFY place <= 32),
 k AS (SELECT q.row_key, m.place, exp(-0.5e0 * (pow((q.hit_angle - m.hit_angle) / sa, 2) + pow((q.hit_speed - m.hit_speed) / ss, 2)
   + CASE WHEN q.stand IS NOT DISTINCT FROM m.stand THEN 0e0 ELSE 2e0 END
   + CASE WHEN q.home_team IS NOT DISTINCT FROM m.home_team THEN 0e0 ELSE 2e0 END
   + CASE WHEN q.fielding_team IS NOT DISTINCT FROM m.fielding_team THEN 0e0 ELSE 2e0 END)) AS v FROM split q, marks m, sd)
SELECT row_key, round(max(v) FILTER (place = 1), 6) AS first, round(max(v), 6) AS nearest, round(sum(v), 6) AS total FROM k GROUP BY row_key""")
def _(t):
    train, _ = _parts(t, ())
    machine = machines.fit(train, *_MACHINE, gamma=0.5, landmarks=32, rounds=0)
    total = F.aggregate("kernel", F.lit(0.0), lambda a, b: a + b)
    rows = machines.landmark_kernel(machine, t.split)
    return rounded(rows.select(
        "row_key", F.col("kernel")[0].alias("first"), F.array_max("kernel").alias("nearest"), total.alias("total")), "first", "nearest", "total")


@query("c13_tune_svm")
def _(t):
    return machines.tune(_parts(t, ())[0], *_MACHINE, landmarks=64)


_NEAR = """train AS (SELECT row_key, hit_type, hit_angle, hit_speed, stand, home_team, fielding_team FROM split WHERE split = 'train'),
 sd AS (SELECT stddev_samp(hit_angle) AS sa, stddev_samp(hit_speed) AS ss FROM train),
 near AS (SELECT q.row_key, q.hit_type, min({'d': pow((q.hit_angle - t.hit_angle) / sa, 2) + pow((q.hit_speed - t.hit_speed) / ss, 2)
   + CASE WHEN q.stand IS NOT DISTINCT FROM t.stand THEN 0e0 ELSE 0.05e0 END
   + CASE WHEN q.home_team IS NOT DISTINCT FROM t.home_team THEN 0e0 ELSE 0.05e0 END
   + CASE WHEN q.fielding_team IS NOT DISTINCT FROM t.fielding_team THEN 0e0 ELSE 0.05e0 END,
   'k': t.row_key, 'c': t.hit_type}, 5) AS five
  FROM split q, train t, sd WHERE q.split <> 'train' GROUP BY q.row_key, q.hit_type)"""


def _neighbours(t) -> DataFrame:
    train, rest = _parts(t, ())
    return neighbours.nearest(train, rest, ("hit_angle", "hit_speed"), ("stand", "home_team", "fielding_team"))


@query("c14_nearest_neighbours", f"""
WITH {_NEAR} SELECT row_key, list_transform(five, lambda x: x.k)[1] AS first, list_aggregate(list_transform(five, lambda x: x.k), 'string_agg', '|') AS keys,
 round(five[5].d, 6) AS reach FROM near""")
def _(t):
    keys = F.transform("neighbours", lambda x: x["key"])
    return rounded(_neighbours(t).select(
        "row_key", keys[0].alias("first"), F.array_join(keys, "|").alias("keys"), F.col("neighbours")[4]["distance"].alias("reach")), "reach")


@query("c14_neighbour_vote", f"""
WITH {_NEAR},
 each AS (SELECT row_key, hit_type, unnest(five).c AS c, generate_subscripts(five, 1) AS place FROM near),
 votes AS (SELECT row_key, hit_type, c, count(*) AS n, min(place) AS place FROM each GROUP BY ALL)
SELECT row_key, hit_type, arg_max(c, {{'n': n, 'p': -place}}) AS fit, CAST(max(n) AS INTEGER) AS votes FROM votes GROUP BY row_key, hit_type""")
def _(t):
    return neighbours.vote(_neighbours(t)).select("row_key", "hit_type", "fit", "votes")
