"""What to do next per document: state from joined tables, status, urgency, completion, actions, the most urgent ones of a base.

A document is a customer, its base the nation; a quiz is an order, an answer a line, a concept a part's group. An order
marked finished stands for a summary, an urgent one for a question asked. Concepts of a base follow one another in groups of
five: one is locked while the one before it is below the unlocking level in that base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.learner import MASTERED, STABLE, UNLOCK, WEAK
from corpusloom.plans.catalogue import Catalogue
from corpusloom.sources.tables import table

catalogue = Catalogue()
query = catalogue.query
QUERIES, ORACLES = catalogue.queries, catalogue.oracles

# Priorities of actions, score limits, shares of completion, urgency.
PRIORITY = {"summary": 100, "keypoints": 95, "review": 85, "quiz": 80, "qa": 65, "challenge": 55}
FIRST_QUIZ, RETRY_QUIZ, AIMED_QA, CALM_REVIEW = 86, 88, 72, 50
LOW_SCORE, EASY_SCORE, QA_SCORE, HIGH_SCORE, CHALLENGE_TRIES = 0.65, 0.45, 0.75, 0.82, 2
SHARES = {"summary": 0.14, "keypoints": 0.14, "quiz": 0.08, "qa": 0.04, "mastery": 0.6}
CHALLENGE_URGENCY, LEAST_URGENCY = 30, 5
FOCUS, SHOWN, GROUP = 3, 5, 5
PRACTICE = {"beginner": "easy", "intermediate": "medium", "advanced": "medium"}
CHALLENGE = {"beginner": "medium", "intermediate": "hard", "advanced": "hard"}


def tenth(x: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)) * 10 + 0.5) / 10


def status() -> Column:
    """blocked, ready_for_practice, needs_practice, ready_for_challenge, on_track: the first that holds."""
    c = F.col
    ready = (c("attempts") >= CHALLENGE_TRIES) & (c("avg_score") >= HIGH_SCORE) & (c("stable") >= 0.7)
    return (
        F.when(~c("has_summary") | ~c("has_keypoints"), "blocked")
        .when(c("attempts") == 0, "ready_for_practice")
        .when((c("avg_score") < LOW_SCORE) | (F.size("weak") > 0), "needs_practice")
        .when(ready, "ready_for_challenge")
        .otherwise("on_track")
    )


def urgency() -> Column:
    c, zero = F.col, F.lit(0.0)
    u = F.when(c("has_summary"), zero).otherwise(35.0) + F.when(c("has_keypoints"), zero).otherwise(30.0)
    u = u + F.when(c("attempts") == 0, 20.0).when(c("avg_score") < LOW_SCORE, (LOW_SCORE - c("avg_score")) * 40).otherwise(zero)
    u = u + F.least(F.lit(15.0), 4.0 * F.size("weak")) + F.when((c("asked") == 0) & c("has_keypoints"), 5.0).otherwise(zero)
    u = F.when(c("status") == "ready_for_challenge", F.least(u, F.lit(float(CHALLENGE_URGENCY)))).otherwise(u)
    return tenth(F.greatest(F.lit(float(LEAST_URGENCY)), u))


def completion() -> Column:
    c, one = F.col, lambda x: F.least(x / 2.0, F.lit(1.0))
    parts = {"summary": F.when(c("has_summary"), 1.0).otherwise(0.0), "keypoints": F.when(c("has_keypoints"), 1.0).otherwise(0.0), "quiz": one(c("attempts")), "qa": one(c("asked")), "mastery": c("mastered")}
    total = F.lit(0.0)
    for name, share in SHARES.items():
        total = total + share * parts[name]
    return tenth(100 * total)


def actions(ability: str = "intermediate") -> Column:
    """Actions (priority, rank, type, difficulty, focus) of a document, the most important first."""
    c = F.col
    focus, tried = c("focus"), c("attempts") > 0
    none = F.array().cast("array<string>")

    def act(when: Column, kind: str, priority: int, difficulty=None, most: int = 0) -> Column:
        level = (difficulty if isinstance(difficulty, Column) else F.lit(difficulty)).cast("string")
        fields = F.struct(F.lit(priority).alias("priority"), F.lit(PRIORITY[kind]).alias("rank"), F.lit(kind).alias("type"), level.alias("difficulty"), (F.slice(focus, 1, most) if most else none).alias("focus"))
        return F.when(when, fields)

    points, has_focus = c("has_keypoints"), F.size(focus) > 0
    low = tried & (c("avg_score") < LOW_SCORE)
    first_qa = points & (c("asked") == 0) & (c("status") != "ready_for_challenge")
    fit = points & (c("attempts") >= CHALLENGE_TRIES) & (c("avg_score") >= HIGH_SCORE) & (c("stable") >= 0.7)
    found = F.array_compact(
        F.array(
            act(~c("has_summary"), "summary", PRIORITY["summary"]),
            act(~points, "keypoints", PRIORITY["keypoints"]),
            act(points & has_focus, "review", PRIORITY["review"], most=FOCUS),
            act(points & ~tried, "quiz", FIRST_QUIZ, PRACTICE[ability], 2),
            act(points & low, "quiz", RETRY_QUIZ, F.when(c("avg_score") < EASY_SCORE, "easy").otherwise(PRACTICE[ability]), 2),
            act(first_qa, "qa", PRIORITY["qa"], most=1),
            act(points & ~first_qa & has_focus & (c("avg_score") < QA_SCORE), "qa", AIMED_QA, most=2),
            act(fit, "challenge", PRIORITY["challenge"], CHALLENGE[ability]),
        )
    )
    calm = F.array(act(F.lit(True), "review", CALM_REVIEW, most=1))
    return F.reverse(F.array_sort(F.when(F.size(found) > 0, found).otherwise(calm)))


def state(spark: SparkSession, d: str) -> DataFrame:
    """(kb, doc_id, has_summary, has_keypoints, attempts, avg_score, asked, mastered, stable, weak, focus) of every document.

    Scores are thousandths until they are averaged. Of a document's concepts with one name the weakest counts, of equals the
    most attempted. Weak concepts that are locked are left out; where nothing else is, the ones that lock them are the focus.
    """
    docs = table(spark, d, "customer", "c_custkey", "c_nationkey").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("kb"))
    quiz = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    line = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_discount").join(quiz.select("o_orderkey", F.col("o_custkey").alias("doc_id")), F.col("l_orderkey") == F.col("o_orderkey"))
    line = line.select("doc_id", F.col("l_orderkey").alias("quiz"), (F.col("l_partkey") % 50).alias("concept"), (F.col("l_discount") >= 0.05).alias("right"))
    n, right = F.count(F.lit(1)), F.count_if(F.col("right"))
    by_concept = line.groupBy("doc_id", "quiz", "concept").agg(n.alias("n"), right.alias("right"))  # one exchange for scores and concepts
    scores = by_concept.groupBy("doc_id", "quiz").agg(F.floor(1000.0 * F.sum("right") / F.sum("n") + 0.5).alias("score"))
    scores = scores.groupBy("doc_id").agg(n.alias("attempts"), (F.sum("score") / n / 1000.0).alias("avg_score"))
    own = by_concept.withColumn("level", F.floor(10000.0 * F.col("right") / F.col("n") + 0.5) / 10000)
    own = own.groupBy("doc_id", "concept").agg(F.min("level").alias("level"), F.sum("right").alias("right"), F.sum("n").alias("n"))
    placed = own.join(docs, "doc_id")
    of_base = placed.groupBy("kb", "concept").agg((F.sum("right") / F.sum("n") >= UNLOCK).alias("open"))
    before = F.lag("concept").over(Window.partitionBy("kb", F.floor(F.col("concept") / GROUP)).orderBy("concept"))
    open_before = F.lag("open").over(Window.partitionBy("kb", F.floor(F.col("concept") / GROUP)).orderBy("concept"))
    locks = of_base.select("kb", "concept", F.when(~open_before, before).alias("lock"))
    # a row a base and concept: sent to the tasks, since the few keys would bring many rows each to few of them
    placed = placed.join(F.broadcast(locks), ["kb", "concept"])
    name = lambda x: F.concat(F.lit("concept "), F.lpad(x.cast("string"), 2, "0"))
    level = F.col("level")
    weak = F.array_sort(F.collect_list(F.when((level < WEAK) & F.col("lock").isNull(), F.struct(level, name(F.col("concept")).alias("concept")))))
    behind = F.array_sort(F.collect_set(F.when((level < WEAK) & F.col("lock").isNotNull(), name(F.col("lock")))))
    mastery = placed.groupBy("doc_id").agg(
        (F.floor(10000.0 * F.sum(F.when(level >= MASTERED, 2).when(level >= WEAK, 1).otherwise(0)) / (2 * n) + 0.5) / 10000).alias("mastered"),
        (F.floor(10000.0 * F.count_if(level >= STABLE) / n + 0.5) / 10000).alias("stable"),
        F.transform(weak, lambda x: x["concept"]).alias("weak"),
        behind.alias("behind"),
    )
    seen = quiz.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("has_summary"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("asked"))
    all_ = docs.join(seen, "doc_id", "left").join(scores, "doc_id", "left").join(mastery, "doc_id", "left")
    empty = F.array().cast("array<string>")
    filled = all_.fillna(False, ["has_summary"]).fillna(0, ["asked", "attempts"]).fillna(0.0, ["avg_score", "mastered", "stable"])
    filled = filled.withColumn("has_keypoints", F.col("weak").isNotNull()).withColumn("weak", F.coalesce("weak", empty)).withColumn("behind", F.coalesce("behind", empty))
    return filled.withColumn("focus", F.slice(F.when(F.size("weak") > 0, F.col("weak")).otherwise(F.col("behind")), 1, FOCUS)).drop("behind")


def judged(spark: SparkSession, d: str) -> DataFrame:
    out = state(spark, d).withColumn("status", status())
    return out.withColumn("urgency", urgency()).withColumn("completion", completion()).withColumn("actions", actions())


_STATE = f"""WITH line AS (SELECT o_custkey AS doc_id, l_orderkey AS quiz, l_partkey % 50 AS concept, l_discount >= 0.05 AS ok FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
scores AS (SELECT doc_id, count(*) AS attempts, sum(score) / count(*) / 1000.0::DOUBLE AS avg_score FROM (SELECT doc_id, quiz, floor(1000.0::DOUBLE * count(*) FILTER (ok) / count(*) + 0.5) AS score FROM line GROUP BY 1, 2) GROUP BY 1),
byq AS (SELECT doc_id, quiz, concept, count(*) AS n, count(*) FILTER (ok) AS r, floor(10000.0::DOUBLE * count(*) FILTER (ok) / count(*) + 0.5) / 10000 AS level FROM line GROUP BY 1, 2, 3),
own AS (SELECT doc_id, concept, min(level) AS level, sum(n) AS n, sum(r) AS r FROM byq GROUP BY 1, 2),
base AS (SELECT c_nationkey AS kb, concept, sum(r)::DOUBLE / sum(n) >= {UNLOCK} AS open FROM own JOIN customer ON c_custkey = doc_id GROUP BY 1, 2),
locks AS (SELECT kb, concept, CASE WHEN NOT lag(open) OVER w THEN lag(concept) OVER w END AS lock FROM base WINDOW w AS (PARTITION BY kb, concept // {GROUP} ORDER BY concept)),
mastery AS (SELECT doc_id, floor(10000.0::DOUBLE * sum(CASE WHEN level >= {MASTERED} THEN 2 WHEN level >= {WEAK} THEN 1 ELSE 0 END) / (2 * count(*)) + 0.5) / 10000 AS mastered, floor(10000.0::DOUBLE * count(*) FILTER (level >= {STABLE}) / count(*) + 0.5) / 10000 AS stable,
coalesce(list('concept ' || lpad(o.concept::VARCHAR, 2, '0') ORDER BY level, o.concept) FILTER (level < {WEAK} AND lock IS NULL), []) AS weak, list_sort(coalesce(list(DISTINCT 'concept ' || lpad(lock::VARCHAR, 2, '0')) FILTER (level < {WEAK} AND lock IS NOT NULL), [])) AS behind
FROM own o JOIN customer ON c_custkey = doc_id JOIN locks l ON l.kb = c_nationkey AND l.concept = o.concept GROUP BY 1),
seen AS (SELECT o_custkey AS doc_id, bool_or(o_orderstatus = 'F') AS s, count(*) FILTER (o_orderpriority = '1-URGENT') AS asked FROM orders GROUP BY 1),
state AS (SELECT c_nationkey AS kb, c_custkey AS doc_id, coalesce(s, false) AS has_summary, weak IS NOT NULL AS has_keypoints, coalesce(attempts, 0) AS attempts, coalesce(avg_score, 0) AS avg_score, coalesce(asked, 0) AS asked, coalesce(mastered, 0) AS mastered, coalesce(stable, 0) AS stable,
coalesce(weak, []) AS weak, (CASE WHEN len(weak) > 0 THEN weak ELSE coalesce(behind, []) END)[1:{FOCUS}] AS focus FROM customer LEFT JOIN seen ON seen.doc_id = c_custkey LEFT JOIN scores ON scores.doc_id = c_custkey LEFT JOIN mastery ON mastery.doc_id = c_custkey),
st AS (SELECT *, CASE WHEN NOT has_summary OR NOT has_keypoints THEN 'blocked' WHEN attempts = 0 THEN 'ready_for_practice' WHEN avg_score < {LOW_SCORE} OR len(weak) > 0 THEN 'needs_practice' WHEN attempts >= 2 AND avg_score >= {HIGH_SCORE} AND stable >= 0.7 THEN 'ready_for_challenge' ELSE 'on_track' END AS status FROM state),
u AS (SELECT *, CASE WHEN has_summary THEN 0 ELSE 35 END + CASE WHEN has_keypoints THEN 0 ELSE 30 END + CASE WHEN attempts = 0 THEN 20 WHEN avg_score < {LOW_SCORE} THEN ({LOW_SCORE}::DOUBLE - avg_score) * 40 ELSE 0 END + least(15, 4 * len(weak)) + CASE WHEN asked = 0 AND has_keypoints THEN 5 ELSE 0 END AS raw FROM st),
j AS (SELECT *, floor(least(100, greatest({LEAST_URGENCY}, CASE WHEN status = 'ready_for_challenge' THEN least(raw, {CHALLENGE_URGENCY}) ELSE raw END)) * 10 + 0.5) / 10 AS urgency,
floor(least(100, 100 * (0.14::DOUBLE * has_summary::INT + 0.14::DOUBLE * has_keypoints::INT + 0.08::DOUBLE * least(attempts / 2, 1) + 0.04::DOUBLE * least(asked / 2, 1) + 0.6::DOUBLE * mastered)) * 10 + 0.5) / 10 AS completion,
list_filter([CASE WHEN NOT has_summary THEN '100 summary' END, CASE WHEN NOT has_keypoints THEN '095 keypoints' END, CASE WHEN has_keypoints AND len(focus) > 0 THEN '085 review' END, CASE WHEN has_keypoints AND attempts = 0 THEN '086 quiz' END,
CASE WHEN has_keypoints AND attempts > 0 AND avg_score < {LOW_SCORE} THEN '088 quiz' END, CASE WHEN has_keypoints AND asked = 0 AND status <> 'ready_for_challenge' THEN '065 qa' WHEN has_keypoints AND len(focus) > 0 AND avg_score < {QA_SCORE} THEN '072 qa' END,
CASE WHEN has_keypoints AND attempts >= 2 AND avg_score >= {HIGH_SCORE} AND stable >= 0.7 THEN '055 challenge' END], lambda x: x IS NOT NULL) AS found FROM u),
judged AS (SELECT *, CASE WHEN len(found) > 0 THEN list_reverse_sort(found) ELSE ['050 review'] END AS acts FROM j)"""


@query(f"{_STATE} SELECT kb, doc_id, attempts, floor(1000 * avg_score + 0.5) / 1000 AS avg_score, len(weak)::INT AS weak, stable, status, urgency, completion, array_to_string(list_transform(acts, lambda x: x[5:]), ',') AS actions FROM judged")
def recommendation_status(spark: SparkSession, d: str) -> DataFrame:
    """Status, urgency, completion and actions of every document."""
    return judged(spark, d).select("kb", "doc_id", "attempts", (F.floor(1000 * F.col("avg_score") + 0.5) / 1000).alias("avg_score"), F.size("weak").alias("weak"), "stable", "status", "urgency", "completion", F.array_join(F.col("actions.type"), ",").alias("actions"))


@query(f"""{_STATE}, r AS (SELECT *, acts[1][5:] AS action, acts[1][:3]::INT AS priority, row_number() OVER (PARTITION BY kb ORDER BY urgency DESC, acts[1][:3] DESC, doc_id) AS place FROM judged)
SELECT kb, doc_id, place, urgency, action, priority, CASE WHEN action = 'quiz' THEN CASE WHEN attempts > 0 AND avg_score < {EASY_SCORE} THEN 'easy' ELSE 'medium' END WHEN action = 'challenge' THEN 'hard' END AS difficulty,
array_to_string(CASE action WHEN 'review' THEN CASE WHEN priority = 50 THEN focus[1:1] ELSE focus END WHEN 'quiz' THEN focus[1:2] WHEN 'qa' THEN focus[1:CASE WHEN priority = 65 THEN 1 ELSE 2 END] ELSE [] END, '|') AS focus,
CASE WHEN status = 'needs_practice' AND len(focus) > 0 THEN status || ': ' || focus[1] ELSE status END AS summary FROM r WHERE place <= {SHOWN}""")
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    """The five documents of each base to turn to, by urgency, then by their first action: that action with its difficulty and focus."""
    j = judged(spark, d).withColumn("act", F.element_at("actions", 1))
    place = F.row_number().over(Window.partitionBy("kb").orderBy(F.desc("urgency"), F.desc("act.priority"), "doc_id"))
    said = F.when((F.col("status") == "needs_practice") & (F.size("focus") > 0), F.concat("status", F.lit(": "), F.get("focus", F.lit(0)))).otherwise(F.col("status"))
    top = j.withColumn("place", place).filter(F.col("place") <= SHOWN)
    return top.select("kb", "doc_id", "place", "urgency", F.col("act.type").alias("action"), F.col("act.priority").alias("priority"), F.col("act.difficulty").alias("difficulty"), F.array_join("act.focus", "|").alias("focus"), said.alias("summary"))
