"""Relational analytics: progress roll-ups, activity feed, listings, scope statistics, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.plans.catalogue import Catalogue
from corpusloom.sources.tables import attempts, table

catalogue = Catalogue()
query = catalogue.query
QUERIES, ORACLES = catalogue.queries, catalogue.oracles


def page_bounds(offset: int, limit: int, most: int = 100) -> tuple[int, int]:
    """Offset of at least 0; limit from 1 to `most` (0 means 1)."""
    return max(0, int(offset)), min(most, max(1, int(limit)))


def page(df: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    """One page in a total order, with the total and whether more follow."""
    offset, limit = page_bounds(offset, limit)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)  # one row


_ATTEMPTS = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"


@query(f"SELECT c_nationkey AS kb_id, count(*) AS attempts, round(avg(l_discount), 3) AS avg_score, max(l_shipdate) AS last_attempt FROM {_ATTEMPTS} GROUP BY 1")
def progress_by_kb(spark: SparkSession, d: str) -> DataFrame:
    """Attempts joined to quizzes and documents, rolled up per knowledge base."""
    return attempts(spark, d).groupBy(F.col("c_nationkey").alias("kb_id")).agg(F.count(F.lit(1)).alias("attempts"), F.round(F.avg("l_discount"), 3).alias("avg_score"), F.max("l_shipdate").alias("last_attempt"))


@query(f"""SELECT (SELECT count(*) FROM customer) AS documents, (SELECT count(*) FROM orders) AS quizzes,
count(*) AS attempts, round(avg(l_discount), 3) AS avg_score, max(l_shipdate) AS last_attempt FROM {_ATTEMPTS}""")
def progress_global(spark: SparkSession, d: str) -> DataFrame:
    """The same over everything, as one row."""
    one = lambda t, name: table(spark, d, t).agg(F.count(F.lit(1)).alias(name))
    all_attempts = attempts(spark, d).agg(F.count(F.lit(1)).alias("attempts"), F.round(F.avg("l_discount"), 3).alias("avg_score"), F.max("l_shipdate").alias("last_attempt"))
    return one("customer", "documents").crossJoin(one("orders", "quizzes")).crossJoin(all_attempts)  # one row each


@query(f"SELECT coalesce(c_nationkey, -1) AS kb_id, count(*) AS attempts, round(avg(l_discount), 3) AS avg_score, grouping(c_nationkey)::INT AS is_total FROM {_ATTEMPTS} GROUP BY GROUPING SETS ((), (c_nationkey))")
def progress_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Per-base rows and the total (base -1) from one pass."""
    rolled = attempts(spark, d).rollup("c_nationkey").agg(F.count(F.lit(1)).alias("attempts"), F.round(F.avg("l_discount"), 3).alias("avg_score"), F.grouping("c_nationkey").cast("int").alias("is_total"))
    return rolled.withColumn("kb_id", F.coalesce("c_nationkey", F.lit(-1))).drop("c_nationkey")


@query("""SELECT n_nationkey AS kb_id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS documents,
(SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey) AS quizzes FROM nation""")
def kb_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Documents and quizzes of each knowledge base, zero where there are none."""
    docs = table(spark, d, "customer", "c_custkey", "c_nationkey")
    n_docs = docs.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("documents"))
    n_quiz = table(spark, d, "orders", "o_custkey").join(docs, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("quizzes"))
    out = table(spark, d, "nation", "n_nationkey").join(n_docs, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(n_quiz, F.col("n_nationkey") == F.col("k"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(F.col("n_nationkey").alias("kb_id"), zero("documents"), zero("quizzes"))


@query("""SELECT coalesce(kb, c_nationkey) AS kb_id, count(*) AS questions FROM
(SELECT o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 25 END AS kb FROM orders) LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def question_count_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Questions per base: their own base, else that of their document (orders as questions, some with a base)."""
    asked = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 25).alias("kb"))
    docs = table(spark, d, "customer", "c_custkey", "c_nationkey")
    return asked.join(docs, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.coalesce("kb", "c_nationkey").alias("kb_id")).agg(F.count(F.lit(1)).alias("questions"))


@query("""WITH q AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 25 END AS kb FROM orders)
SELECT n_nationkey AS kb_id, count(q.o_orderkey) AS questions FROM nation LEFT JOIN (SELECT q.*, c_nationkey FROM q LEFT JOIN customer ON o_custkey = c_custkey) q
ON q.kb = n_nationkey OR q.c_nationkey = n_nationkey GROUP BY 1""")
def question_count_or(spark: SparkSession, d: str) -> DataFrame:
    """Questions per base, counted where either their own base or their document's is it: as a union of two equi-keys, not an OR join."""
    asked = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 25).alias("kb"))
    docs = table(spark, d, "customer", "c_custkey", "c_nationkey")
    both = asked.join(docs, F.col("o_custkey") == F.col("c_custkey"), "left")
    keys = F.array_distinct(F.array_compact(F.array(F.col("kb").cast("long"), F.col("c_nationkey").cast("long"))))
    counts = both.select(F.explode(keys).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "nation", "n_nationkey").join(counts, F.col("n_nationkey") == F.col("k"), "left").select(F.col("n_nationkey").alias("kb_id"), F.coalesce("n", F.lit(0)).alias("questions"))


def activity_page(spark: SparkSession, d: str, offset: int, limit: int) -> DataFrame:
    """A newest-first page over typed branches; each branch brings its newest offset + limit rows only."""
    events = table(spark, d, "events")
    names = {"click": "question_asked", "purchase": "quiz_attempt", "error": "quiz_failed", "view": "summary_generated", "signup": "document_uploaded"}
    feed = None
    for kind, name in names.items():
        newest = events.filter(F.col("event_type") == kind).select("event_id", "ts", "user_id", F.lit(name).alias("type")).orderBy(F.desc("ts"), F.desc("event_id")).limit(offset + limit)
        feed = newest if feed is None else feed.unionByName(newest)
    return feed.orderBy(F.desc("ts"), F.desc("event_id")).offset(offset).limit(limit)


@query("""SELECT event_id, ts, user_id, CASE event_type WHEN 'click' THEN 'question_asked' WHEN 'purchase' THEN 'quiz_attempt' WHEN 'error' THEN 'quiz_failed'
WHEN 'view' THEN 'summary_generated' ELSE 'document_uploaded' END AS type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 5""")
def activity_feed_page(spark: SparkSession, d: str) -> DataFrame:
    return activity_page(spark, d, 5, 20)


@query("SELECT doc_id, lang, n_chars, total, total > 30 AS has_more FROM (SELECT *, count(*) OVER () AS total FROM documents WHERE lang = 'en' AND lower(text) LIKE '%the%') ORDER BY n_chars DESC, doc_id DESC LIMIT 20 OFFSET 10")
def docs_filter_sort_page(spark: SparkSession, d: str) -> DataFrame:
    """Filtered, case-insensitively searched, sorted and paged document listing."""
    docs = table(spark, d, "documents", "doc_id", "lang", "n_chars", "text").filter((F.col("lang") == "en") & F.col("text").ilike("%the%"))
    return page(docs.drop("text"), 10, 20, F.desc("n_chars"), F.desc("doc_id"))


@query("SELECT source, count(*) FILTER (WHERE n_chars >= 500) AS ready, count(*) FILTER (WHERE n_chars < 100) AS error, count(*) FILTER (WHERE n_chars >= 100 AND n_chars < 500) AS processing FROM documents GROUP BY 1")
def docs_status_counts(spark: SparkSession, d: str) -> DataFrame:
    """The task centre: documents by status per base."""
    docs, n = table(spark, d, "documents", "source", "n_chars"), F.col("n_chars")
    return docs.groupBy("source").agg(F.count_if(n >= 500).alias("ready"), F.count_if(n < 100).alias("error"), F.count_if((n >= 100) & (n < 500)).alias("processing"))


@query("SELECT source AS kb_id, count(*) AS n_docs, sum(ceil(n_chars / 850.0))::BIGINT AS n_chunks, sum(1 + n_chars // 3000)::BIGINT AS n_pages FROM documents WHERE n_chars >= 100 GROUP BY 1")
def scope_stats(spark: SparkSession, d: str) -> DataFrame:
    """Size of each retrieval scope over ready documents."""
    docs = table(spark, d, "documents", "source", "n_chars").filter("n_chars >= 100")
    return docs.groupBy(F.col("source").alias("kb_id")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.ceil(F.col("n_chars") / F.lit(850.0))).alias("n_chunks"), F.sum(1 + F.floor(F.col("n_chars") / F.lit(3000))).alias("n_pages"))


@query("SELECT source, sha256(text) AS file_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def dup_hash(spark: SparkSession, d: str) -> DataFrame:
    """Uploads with equal content within a base: the first is kept, the others short-circuit."""
    docs = table(spark, d, "documents", "source", "doc_id", "text").select("source", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"))
    return docs.groupBy("source", "file_hash").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")


@query("""SELECT conv_id, n_messages, first_turn, last_turn, total, total > 15 AS has_more FROM (SELECT conv_id, count(*) AS n_messages, min(turn) AS first_turn, max(turn) AS last_turn,
count(*) OVER () AS total FROM conversations GROUP BY 1) ORDER BY last_turn DESC, conv_id DESC LIMIT 10 OFFSET 5""")
def session_page(spark: SparkSession, d: str) -> DataFrame:
    """Sessions, newest first, id as tie-break."""
    s = table(spark, d, "conversations", "conv_id", "turn").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    return page(s, 5, 10, F.desc("last_turn"), F.desc("conv_id"))


# Messages looked at and kept whole; characters of a recent line, an older line, the recent block, the summary, the history; older lines.
FETCHED, RECENT, LINE, OLDER_LINE, OLDER_LINES = 24, 6, 220, 90, 4
RECENT_BUDGET, SUMMARY_BUDGET, HISTORY_BUDGET = 1600, 700, 2400
RECENT_HEAD, OLDER_HEAD = "[Recent messages]", "[Earlier conversation summary]"


def shortened(text: Column, most: Column | int) -> Column:
    """A text on one line, cut to at most so many characters, dots included."""
    t, most = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), F.lit(most) if isinstance(most, int) else most
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, F.lit(1), most - 3)), F.lit("...")))


def fitted(lines: Column, most: int) -> Column:
    """Lines joined as long as they fit in so many characters; the first that does not is shortened, if at least seven are left."""

    def add(state: Column, line: Column) -> Column:
        so_far = state["text"]
        start = F.when(so_far == "", so_far).otherwise(F.concat(so_far, F.lit("\n")))
        whole, room = F.concat(start, line), most - F.char_length(start)
        cut = F.when(room > 6, F.concat(start, shortened(line, room))).otherwise(so_far)
        fits = F.char_length(whole) <= most
        return F.when(state["full"] | (line == ""), state).otherwise(F.struct(F.when(fits, whole).otherwise(cut).alias("text"), (~fits).alias("full")))

    return F.aggregate(lines, F.struct(F.lit("").alias("text"), F.lit(False).alias("full")), add, lambda s: s["text"])


# The SQL leaves the budgets out: with these roles (at most nine characters) no block reaches its budget; tests/test_history.py has those that do.
@query(rf"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS back FROM conversations QUALIFY back <= {FETCHED}),
t AS (SELECT *, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t, CASE WHEN back <= {RECENT} THEN {LINE} ELSE {OLDER_LINE} END AS most FROM m),
l AS (SELECT *, trim(role || ': ' || CASE WHEN length(t) > most THEN rtrim(left(t, most - 3)) || '...' ELSE t END) AS line FROM t)
SELECT conv_id, count(*) FILTER (WHERE back > {RECENT}) AS older, CASE WHEN count(*) > {RECENT} THEN '{OLDER_HEAD} messages=' || (count(*) FILTER (WHERE back > {RECENT})) || ', user=' || (count(*) FILTER (WHERE back > {RECENT} AND role = 'user'))
|| ', assistant=' || (count(*) FILTER (WHERE back > {RECENT} AND role = 'assistant')) || ' ' || string_agg(line, ' ' ORDER BY back DESC) FILTER (WHERE back > {RECENT} AND back <= {RECENT + OLDER_LINES}) || ' ' ELSE '' END
|| '{RECENT_HEAD} ' || string_agg(line, ' ' ORDER BY back DESC) FILTER (WHERE back <= {RECENT}) AS history FROM l GROUP BY 1""")
def history_window(spark: SparkSession, d: str) -> DataFrame:
    """Conversation context of the last 24 messages: counts and the last lines of older ones, then the recent ones, each block in its budget.

    No more than 24 messages of a conversation are collected.
    """
    by = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    m = table(spark, d, "conversations").withColumn("back", F.row_number().over(by)).filter(F.col("back") <= FETCHED)
    old = F.col("back") > RECENT
    line = F.trim(F.concat(F.coalesce("role", F.lit("")), F.lit(": "), shortened(F.col("text"), F.when(old, OLDER_LINE).otherwise(LINE))))
    rows = m.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("place"), line.alias("line")))).alias("rows"),
        F.count_if(old).alias("older"),
        F.count_if(old & (F.col("role") == "user")).alias("asked"),
        F.count_if(old & (F.col("role") == "assistant")).alias("answered"),
    )
    within = lambda low, high: F.transform(F.filter("rows", lambda x: x["place"].between(-high, -low)), lambda x: x["line"])
    counts = F.format_string(f"{OLDER_HEAD} messages=%d, user=%d, assistant=%d", "older", "asked", "answered")
    summary = F.when(F.col("older") > 0, fitted(F.concat(F.array(counts), within(RECENT + 1, RECENT + OLDER_LINES)), SUMMARY_BUDGET))
    recent = F.concat(F.lit(f"{RECENT_HEAD}\n"), fitted(within(1, RECENT), RECENT_BUDGET))
    return rows.select("conv_id", "older", shortened(F.concat_ws("\n", summary, recent), HISTORY_BUDGET).alias("history"))


# -- recommendations ---------------------------------------------------------------------------


@query("""SELECT user_id, type, priority, value FROM (SELECT user_id, event_type AS type, (event_id % 7)::BIGINT AS priority, value,
row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 7 DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def best_action_per_type(spark: SparkSession, d: str) -> DataFrame:
    """Keep the action of highest priority per type; of equals the later."""
    e = table(spark, d, "events").withColumn("priority", F.col("event_id") % 7)
    best = e.groupBy("user_id", F.col("event_type").alias("type")).agg(F.max(F.struct("priority", "event_id", "value")).alias("b"))
    return best.select("user_id", "type", "b.priority", "b.value")


@query("SELECT o_custkey AS doc_id, max(o_orderdate) AS newest, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS summary FROM orders GROUP BY 1")
def summary_cache(spark: SparkSession, d: str) -> DataFrame:
    """The newest summary of each document."""
    best = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("b"))
    return best.select("doc_id", F.col("b.o_orderdate").alias("newest"), F.col("b.o_orderkey").alias("summary"))


@query("""SELECT o_orderkey AS quiz_id, o_custkey AS doc_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Quizzes that remain when the documents of one base go: an anti-join, not row deletes."""
    gone = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("doc_id"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("quiz_id"), F.col("o_custkey").alias("doc_id")).join(gone, "doc_id", "left_anti")
