"""Learner state: mastery as an ordered fold of interactions, aggregate points, ability profile, weak concepts.

The interaction log is `events`: purchase is a right answer, error a wrong one, view a study step. State is
derived from the log, never updated in place; the fold of one key runs inside one sorted array, in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.plans.catalogue import Catalogue
from corpusloom.sources.tables import events_log, table

catalogue = Catalogue()
query = catalogue.query
QUERIES, ORACLES = catalogue.queries, catalogue.oracles

# Weights and thresholds of the mastery model.
QUIZ_ALPHA, STUDY_ALPHA = 0.15, 0.10
MASTERED, STABLE, UNLOCK, WEAK = 0.8, 0.7, 0.6, 0.3
DIFFICULTY_WEIGHT = {"easy": 0.8, "hard": 1.2}  # others: 1
WEAK_LIMIT = 10


def half_up(x: Column, places: int = 4) -> Column:
    """Rounding that every engine repeats bit by bit."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / F.lit(scale)


def ema(old: Column, signal: Column, alpha: float) -> Column:
    return half_up(F.lit(alpha) * signal + F.lit(1 - alpha) * old)


def folded(log: DataFrame, keys: list[str], order: list[str], signal: Column, step, start: Column) -> Column:
    """Aggregate expression: step over the signals of a key in order."""
    items = F.array_sort(F.collect_list(F.struct(*order, signal.alias("s"))))
    return F.aggregate(items, start, lambda acc, x: step(acc, x["s"]))


_FOLD = """WITH RECURSIVE e AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 1.0 ELSE 0.0 END::DOUBLE AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
FROM events WHERE event_type IN ('purchase', 'error')),
f AS (SELECT user_id, n, floor((0.15::DOUBLE * s + 0.85::DOUBLE * 0.0::DOUBLE) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS m, s::BIGINT AS right_n FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, floor((0.15::DOUBLE * e.s + 0.85::DOUBLE * f.m) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE, f.right_n + e.s::BIGINT FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
"""


def quiz_mastery(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, mastery, attempts, correct): moving average of right answers, rounded at every step."""
    log = events_log(spark, d).filter(F.col("event_type").isin("purchase", "error")).withColumn("right", (F.col("event_type") == "purchase").cast("double"))
    fold = folded(log, ["user_id"], ["ts", "event_id"], F.col("right"), lambda acc, s: ema(acc, s, QUIZ_ALPHA), F.lit(0.0))
    return log.groupBy("user_id").agg(fold.alias("mastery"), F.count(F.lit(1)).alias("attempts"), F.sum("right").cast("long").alias("correct"))


@query(_FOLD + "SELECT user_id, arg_max(m, n) AS mastery, max(n) AS attempts, max(right_n) AS correct FROM f GROUP BY 1")
def mastery_fold(spark: SparkSession, d: str) -> DataFrame:
    return quiz_mastery(spark, d)


@query(f"""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view'),
f AS (SELECT user_id, n, 0.1::DOUBLE AS m FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n,
CASE WHEN m >= {MASTERED} THEN m ELSE floor((0.1::DOUBLE + 0.9::DOUBLE * m) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, arg_max(m, n) AS mastery, max(n) AS steps FROM f GROUP BY 1""")
def study_fold(spark: SparkSession, d: str) -> DataFrame:
    """Mastery from study steps alone; steps no longer count once it is mastered."""
    log = events_log(spark, d).filter("event_type = 'view'")
    step = lambda acc, s: F.when(acc >= MASTERED, acc).otherwise(ema(acc, F.lit(1.0), STUDY_ALPHA))
    return log.groupBy("user_id").agg(folded(log, ["user_id"], ["ts", "event_id"], F.lit(1.0), step, F.lit(0.0)).alias("mastery"), F.count(F.lit(1)).alias("steps"))


def priority(m: Column, attempts: Column) -> Column:
    return F.when(m >= MASTERED, "completed").when(m < WEAK, "high").when(m < STABLE, "medium").otherwise("low")


def action(m: Column, attempts: Column) -> Column:
    return F.when(m >= MASTERED, "review").when(attempts == 0, "quiz").when(m < WEAK, "study").otherwise("quiz")


@query(_FOLD + f"""SELECT user_id, m AS mastery, CASE WHEN m >= {MASTERED} THEN 'completed' WHEN m < {WEAK} THEN 'high' WHEN m < {STABLE} THEN 'medium' ELSE 'low' END AS priority,
CASE WHEN m >= {MASTERED} THEN 'review' WHEN m < {WEAK} THEN 'study' ELSE 'quiz' END AS action FROM (SELECT user_id, arg_max(m, n) AS m FROM f GROUP BY 1)""")
def mastery_labels(spark: SparkSession, d: str) -> DataFrame:
    """Priority and next action of each learner's concept."""
    m = quiz_mastery(spark, d)
    return m.select("user_id", "mastery", priority(F.col("mastery"), F.col("attempts")).alias("priority"), action(F.col("mastery"), F.col("attempts")).alias("action"))


@query(f"""SELECT c_nationkey AS kb_id, floor(10000.0 * sum(CASE WHEN m >= {MASTERED} THEN 2 WHEN m >= {WEAK} THEN 1 ELSE 0 END) / (2 * count(*)) + 0.5) / 10000 AS completion,
floor(10000.0 * count(*) FILTER (WHERE m >= {STABLE}) / count(*) + 0.5) / 10000 AS stable, floor(10.0 * sum(p) / count(*) + 0.5) / 10000 AS average
FROM (SELECT c_nationkey, round(greatest(0, least(10000, c_acctbal)) / 10)::BIGINT AS p, round(greatest(0, least(10000, c_acctbal)) / 10)::BIGINT / 1000.0 AS m FROM customer) GROUP BY 1""")
def completion(spark: SparkSession, d: str) -> DataFrame:
    """Completion (weights 1, 0.5, 0), share that is stable and average of a base's concepts (account balances as levels)."""
    p = F.round(F.greatest(F.lit(0.0), F.least(F.lit(10000.0), F.col("c_acctbal"))) / 10).cast("long")
    c = table(spark, d, "customer", "c_nationkey", "c_acctbal").withColumn("p", p).withColumn("m", F.col("p") / F.lit(1000.0))
    n, m = F.count(F.lit(1)), F.col("m")
    weight = F.sum(F.when(m >= MASTERED, 2).when(m >= WEAK, 1).otherwise(0))
    share = lambda a, b, scale=10000.0: F.floor(F.lit(scale) * a / b + 0.5) / 10000
    return c.groupBy(F.col("c_nationkey").alias("kb_id")).agg(share(weight, 2 * n).alias("completion"), share(F.count_if(m >= STABLE), n).alias("stable"), share(F.sum("p"), n, 10.0).alias("average"))


@query(f"""SELECT c_nationkey AS kb_id, concept, mastery, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY mastery, attempts DESC, concept) AS n FROM
(SELECT c_nationkey, c_mktsegment || (c_custkey % 40) AS concept, min(greatest(0, c_acctbal) / 10000) AS mastery, sum(c_custkey % 4)::BIGINT AS attempts FROM customer GROUP BY ALL)
WHERE mastery < {WEAK} AND NOT (attempts = 0 AND mastery = 0)) WHERE n <= {WEAK_LIMIT}""")
def weak_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The ten weakest concepts of each base: lowest mastery, then most attempts, then text; untouched ones left out."""
    concept = F.concat("c_mktsegment", (F.col("c_custkey") % 40).cast("string"))
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal").groupBy(F.col("c_nationkey").alias("kb_id"), concept.alias("concept"))
    points = c.agg(F.min(F.greatest(F.lit(0.0), F.col("c_acctbal")) / 10000).alias("mastery"), F.sum(F.col("c_custkey") % 4).alias("attempts"))
    weak = points.filter((F.col("mastery") < WEAK) & ~((F.col("attempts") == 0) & (F.col("mastery") == 0)))
    place = F.row_number().over(Window.partitionBy("kb_id").orderBy("mastery", F.desc("attempts"), "concept"))
    return weak.withColumn("place", place).filter(F.col("place") <= WEAK_LIMIT).select("kb_id", "concept", "mastery", "place")


# -- profile -----------------------------------------------------------------------------------


def difficulty_weight(label: Column) -> Column:
    """How much an attempt at a quiz of that difficulty moves theta."""
    weight = F.lit(1.0)
    for name, w in DIFFICULTY_WEIGHT.items():
        weight = F.when(F.lower(F.trim(label)) == name, w).otherwise(weight)
    return weight


def profile_step(acc: Column, x: Column, weight: Column) -> Column:
    """One attempt with accuracy x at a quiz of a weight: recent accuracy, low streak, frustration, theta (4 decimals), attempts and ability."""
    first = acc["n"] == 0
    recent = F.when(first, x).otherwise(0.7 * acc["recent"] + 0.3 * x)
    low = F.when(x < 0.3, acc["low"] + 1).when(x < 0.5, F.greatest(F.lit(0), acc["low"] - 1)).otherwise(F.lit(0))
    change = F.when(x < 0.3, 0.15).when(x < 0.5, 0.05).otherwise(-0.05)
    frustration = F.least(F.lit(1.0), F.greatest(F.lit(0.0), acc["frustration"] + change))
    move = F.least(F.lit(0.25), F.greatest(F.lit(-0.25), (x - 0.6) * weight - 0.15 * frustration))
    theta = half_up(F.least(F.lit(2.0), F.greatest(F.lit(-2.0), acc["theta"] + move)))
    n = acc["n"] + 1
    up = (n >= 3) & (recent >= 0.8)
    down = (n >= 3) & (recent <= 0.4) & (acc["ability"] == 2)
    ability = F.when(up, F.least(F.lit(2), acc["ability"] + 1)).when(down, F.lit(1)).otherwise(acc["ability"])
    return F.struct(n.alias("n"), recent.alias("recent"), low.alias("low"), frustration.alias("frustration"), theta.alias("theta"), ability.alias("ability"))


def plan_of(ability: Column, frustration: Column, recent: Column) -> Column:
    """Shares of easy, medium and hard questions."""
    return F.when((ability == 0) | (frustration > 0.7), "0.8/0.2/0.0").when(ability == 2, "0.1/0.4/0.5").when(recent < 0.5, "0.5/0.4/0.1").otherwise("0.3/0.5/0.2")


_DAY_WEIGHT = "CASE WHEN count(*) >= 3 THEN 1.2 WHEN count(*) = 1 THEN 0.8 ELSE 1.0 END::DOUBLE"
_H = lambda x: f"(floor(({x}) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE)"


def _profile_sql() -> str:
    change = "CASE WHEN e.x < 0.3 THEN 0.15 WHEN e.x < 0.5 THEN 0.05 ELSE -0.05 END::DOUBLE"
    fr = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, f.frustration + {change}))"
    recent = f"CASE WHEN f.n = 0 THEN e.x ELSE 0.7::DOUBLE * f.recent + 0.3::DOUBLE * e.x END"
    return f"""WITH RECURSIVE a AS (SELECT user_id, CAST(ts AS DATE) AS day, 1.0::DOUBLE * count(*) FILTER (WHERE event_type = 'purchase') / count(*) AS x, {_DAY_WEIGHT} AS w FROM events WHERE event_type IN ('purchase', 'error') GROUP BY ALL),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM a),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0.5::DOUBLE AS recent, 0 AS low, 0.0::DOUBLE AS frustration, 0.0::DOUBLE AS theta, 1 AS ability FROM e
UNION ALL SELECT user_id, n, recent, low, frustration, {_H("least(2.0::DOUBLE, greatest(-2.0::DOUBLE, theta + least(0.25::DOUBLE, greatest(-0.25::DOUBLE, (x - 0.6::DOUBLE) * w - 0.15::DOUBLE * frustration))))")},
CASE WHEN n >= 3 AND recent >= 0.8 THEN least(2, ability + 1) WHEN n >= 3 AND recent <= 0.4 AND ability = 2 THEN 1 ELSE ability END FROM
(SELECT e.user_id, f.n + 1 AS n, {recent} AS recent, CASE WHEN e.x < 0.3 THEN f.low + 1 WHEN e.x < 0.5 THEN greatest(0, f.low - 1) ELSE 0 END AS low, {fr} AS frustration, f.theta, f.ability, e.x, e.w
FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.n + 1))
SELECT user_id, n AS attempts, recent AS recent_accuracy, low AS low_streak, frustration, theta, ability,
CASE WHEN ability = 0 OR frustration > 0.7 THEN '0.8/0.2/0.0' WHEN ability = 2 THEN '0.1/0.4/0.5' WHEN recent < 0.5 THEN '0.5/0.4/0.1' ELSE '0.3/0.5/0.2' END AS plan
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS back FROM f) WHERE back = 1"""


@query(_profile_sql())
def profile_fold(spark: SparkSession, d: str) -> DataFrame:
    """Learner profiles (ability 0 beginner, 1 intermediate, 2 advanced) from daily quizzes (three answers or more: hard; one: easy), with their difficulty plan."""
    return profiles(spark, d)


def profiles(spark: SparkSession, d: str) -> DataFrame:
    log = events_log(spark, d).filter(F.col("event_type").isin("purchase", "error"))
    daily = log.groupBy("user_id", F.to_date("ts").alias("day")).agg((F.lit(1.0) * F.count_if(F.col("event_type") == "purchase") / F.count(F.lit(1))).alias("x"), F.count(F.lit(1)).alias("n"))
    label = F.when(F.col("n") >= 3, "hard").when(F.col("n") == 1, "easy").otherwise("medium")
    daily = daily.withColumn("w", difficulty_weight(label))
    start = F.struct(F.lit(0).alias("n"), F.lit(0.5).alias("recent"), F.lit(0).alias("low"), F.lit(0.0).alias("frustration"), F.lit(0.0).alias("theta"), F.lit(1).alias("ability"))
    p = daily.groupBy("user_id").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("day", "x", "w"))), start, lambda acc, e: profile_step(acc, e["x"], e["w"])).alias("p"))
    return p.select(
        "user_id",
        F.col("p.n").cast("long").alias("attempts"),
        F.col("p.recent").alias("recent_accuracy"),
        F.col("p.low").alias("low_streak"),
        F.col("p.frustration").alias("frustration"),
        F.col("p.theta").alias("theta"),
        F.col("p.ability").alias("ability"),
        plan_of(F.col("p.ability"), F.col("p.frustration"), F.col("p.recent")).alias("plan"),
    )


# -- quiz scoring ------------------------------------------------------------------------------

_RIGHT = "(l_discount >= 0.05)"


@query(f"""SELECT l_orderkey AS quiz_id, count(*) AS questions, count(*) FILTER (WHERE {_RIGHT}) AS correct, floor(1000.0 * count(*) FILTER (WHERE {_RIGHT}) / count(*) + 0.5) / 1000 AS score,
coalesce(sum(l_linenumber) FILTER (WHERE {_RIGHT}), 0)::BIGINT AS earned, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY 1""")
def score_quiz(spark: SparkSession, d: str) -> DataFrame:
    """Score of each submitted quiz (order), plain and weighted (line numbers as points)."""
    line, right = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_discount"), F.col("l_discount") >= 0.05
    n = F.count(F.lit(1))
    return line.groupBy(F.col("l_orderkey").alias("quiz_id")).agg(n.alias("questions"), F.count_if(right).alias("correct"), (F.floor(F.lit(1000.0) * F.count_if(right) / n + 0.5) / 1000).alias("score"), F.coalesce(F.sum(F.when(right, F.col("l_linenumber"))), F.lit(0)).alias("earned"), F.sum("l_linenumber").alias("total"))


@query(f"SELECT l_orderkey AS quiz_id, l_returnflag AS section, count(*) AS questions, count(*) FILTER (WHERE {_RIGHT}) AS correct FROM lineitem GROUP BY 1, 2")
def section_scores(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_discount")
    return line.groupBy(F.col("l_orderkey").alias("quiz_id"), F.col("l_returnflag").alias("section")).agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("l_discount") >= 0.05).alias("correct"))


@query(f"SELECT l_orderkey AS quiz_id, l_partkey % 50 AS concept, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS wrong FROM lineitem WHERE NOT {_RIGHT} GROUP BY 1, 2")
def wrong_by_concept(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the wrong questions of each quiz, by concept."""
    line = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_discount").filter("NOT (l_discount >= 0.05)")
    return line.groupBy(F.col("l_orderkey").alias("quiz_id"), (F.col("l_partkey") % 50).alias("concept")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")), ",").alias("wrong"))


@query(f"""SELECT l_orderkey AS quiz_id, 1.0 * count(*) FILTER (WHERE {_RIGHT}) / count(*) < 0.3 OR count(*) FILTER (WHERE NOT {_RIGHT} AND l_linenumber <= 5) >= 4 AS encourage FROM lineitem GROUP BY 1""")
def encouragement(spark: SparkSession, d: str) -> DataFrame:
    """An easy next quiz is due below a score of 0.3 or with four wrong answers among the first five."""
    line, right = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_discount"), F.col("l_discount") >= 0.05
    low = F.lit(1.0) * F.count_if(right) / F.count(F.lit(1)) < 0.3
    return line.groupBy(F.col("l_orderkey").alias("quiz_id")).agg((low | (F.count_if(~right & (F.col("l_linenumber") <= 5)) >= 4)).alias("encourage"))


@query("""WITH w AS (SELECT o_orderkey, (o_orderkey % 30 + 1) AS total, unnest(['choice', 'multiple', 'boolean', 'blank']) AS kind, unnest([10, 4, 3, 3]) AS weight FROM orders),
s AS (SELECT *, total * weight // 20 AS base, total * weight % 20 AS rest FROM w),
r AS (SELECT *, total - sum(base) OVER (PARTITION BY o_orderkey) AS spare, row_number() OVER (PARTITION BY o_orderkey ORDER BY rest DESC, weight DESC, kind) AS place FROM s)
SELECT o_orderkey AS quiz_id, kind, (base + CASE WHEN place <= spare THEN 1 ELSE 0 END)::BIGINT AS questions FROM r""")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    """Largest-remainder split of a paper's questions over four kinds; ties by weight, then by name."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(w).alias("weight")) for k, w in (("choice", 10), ("multiple", 4), ("boolean", 3), ("blank", 3))))
    q = table(spark, d, "orders", "o_orderkey").select("o_orderkey", (F.col("o_orderkey") % 30 + 1).alias("total"), F.explode(kinds).alias("k")).select("o_orderkey", "total", "k.*")
    q = q.withColumn("base", F.expr("total * weight div 20")).withColumn("rest", F.col("total") * F.col("weight") % 20)
    by = Window.partitionBy("o_orderkey")
    spare = F.col("total") - F.sum("base").over(by)
    place = F.row_number().over(by.orderBy(F.desc("rest"), F.desc("weight"), "kind"))
    return q.select(F.col("o_orderkey").alias("quiz_id"), "kind", (F.col("base") + F.when(place <= spare, 1).otherwise(0)).alias("questions"))
