"""What surrounds an answer: numbered context, the better of two tries, hit identities, guarded updates, the lexical store's upkeep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import lexical as lx
from corpusloom.operators.retrieval import ORACLES as RETRIEVAL
from corpusloom.operators.retrieval import bm25_topk, top
from corpusloom.plans.catalogue import Catalogue
from corpusloom.sources.tables import table

catalogue = Catalogue()
query = catalogue.query

# Characters of a snippet, of a hit's content that tells it, of a fragment that says nothing; items of a queue.
SNIPPET_CHARS, IDENTITY_CHARS, TOO_SHORT, QUEUE = 400, 160, 3, 5


def visible(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"\s", ""))


def sources_and_context(hits: DataFrame, clean: Callable[[Column], Column] = F.trim) -> DataFrame:
    """Of hits(question, rank, source, text): per question the sources by rank, with snippets, and the numbered context.

    A snippet is the cleaned head of its text, empty if it says too little. A question's hits are few: the ranked ones.
    """
    head = clean(F.substring("text", 1, SNIPPET_CHARS))
    snippet = F.when(visible(head) <= TOO_SHORT, "").otherwise(head)
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Source: "), F.col("source"), F.lit("\n"), clean(F.col("text")))
    rows = hits.select("question", F.struct("rank", "source", snippet.alias("snippet"), block.alias("block")).alias("h"))
    ranked = rows.groupBy("question").agg(F.sort_array(F.collect_list("h")).alias("hits"))
    return ranked.select("question", F.transform("hits", lambda h: F.struct(h["source"].alias("source"), h["snippet"].alias("snippet"))).alias("sources"), F.array_join(F.transform("hits", lambda h: h["block"]), "\n\n").alias("context"))


@query(f"""SELECT question, count(*) AS n_sources, string_agg(source, ',' ORDER BY rank) AS sources,
md5(string_agg(CASE WHEN length(regexp_replace(trim(substring(text, 1, {SNIPPET_CHARS})), '\\s', '', 'g')) <= {TOO_SHORT} THEN '' ELSE trim(substring(text, 1, {SNIPPET_CHARS})) END, '|' ORDER BY rank)) AS snippets_md5,
md5(string_agg('[' || rank || '] Source: ' || source || chr(10) || trim(text), chr(10) || chr(10) ORDER BY rank)) AS context_md5
FROM ({RETRIEVAL['bm25_topk']}) JOIN documents ON id = doc_id GROUP BY question""")
def answer_context(spark: SparkSession, d: str) -> DataFrame:
    """Sources and numbered context of each benchmark question's hits."""
    docs = table(spark, d, "documents", "doc_id", "source", "text")
    hits = bm25_topk(spark, d).join(docs, F.col("id") == F.col("doc_id"))
    out = sources_and_context(hits)
    snippets = F.array_join(F.transform("sources", lambda s: s["snippet"]), "|")
    names = F.array_join(F.transform("sources", lambda s: s["source"]), ",")
    return out.select("question", F.size("sources").cast("long").alias("n_sources"), names.alias("sources"), F.md5(snippets.cast("binary")).alias("snippets_md5"), F.md5(F.col("context").cast("binary")).alias("context_md5"))


def coverage_rank(hard: Column, groups: Column, chars: Column, hits: Column) -> Column:
    """What tries are compared by: hard questions want many sources first, others many characters."""
    return F.when(hard, F.struct(groups.alias("a"), chars.alias("b"), hits.alias("c"))).otherwise(F.struct(chars.alias("a"), groups.alias("b"), hits.alias("c")))


@query(f"""WITH h AS (SELECT question, rank, length(text) AS n, source FROM ({RETRIEVAL['bm25_topk']}) JOIN documents ON id = doc_id),
t AS (SELECT question, coalesce(sum(n) FILTER (rank <= 2), 0) AS c1, count(DISTINCT source) FILTER (rank <= 2) AS g1, count(*) FILTER (rank <= 2) AS h1,
coalesce(sum(n) FILTER (rank > 2), 0) AS c2, count(DISTINCT source) FILTER (rank > 2) AS g2, count(*) FILTER (rank > 2) AS h2 FROM h GROUP BY question)
SELECT question, CASE WHEN {lx.complex_sql('text')} THEN (g2, c2, h2) >= (g1, c1, h1) ELSE (c2, g2, h2) >= (c1, g1, h1) END AS second_kept
FROM t JOIN benchmark ON question = item_id""")
def better_try(spark: SparkSession, d: str) -> DataFrame:
    """Whether the second of two tries (here the first two hits against the rest) covers at least as much and is kept."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.char_length("text").alias("n"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("question"), lx.is_complex(F.col("text")).alias("hard"))
    hits = bm25_topk(spark, d).join(docs, F.col("id") == F.col("doc_id"))
    tries = []
    for i, of in ((1, F.col("rank") <= 2), (2, F.col("rank") > 2)):
        tries += [F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0)).alias(f"c{i}"), F.count_distinct(F.when(of, F.col("source"))).alias(f"g{i}"), F.count_if(of).alias(f"h{i}")]
    both = hits.groupBy("question").agg(*tries).join(asked, "question")
    first, second = (coverage_rank(F.col("hard"), F.col(f"g{i}"), F.col(f"c{i}"), F.col(f"h{i}")) for i in (1, 2))
    return both.select("question", (second >= first).alias("second_kept"))


def hit_identity(doc: Column, page: Column, chunk: Column, text: Column) -> Column:
    """What tells hits apart: document, page and chunk, or without both of these the head of the content."""
    doc, page, chunk = (F.coalesce(x.cast("string"), F.lit("")) for x in (doc, page, chunk))
    last = F.when((doc != "") & ((chunk != "") | (page != "")), chunk).otherwise(F.substring(F.trim(text), 1, IDENTITY_CHARS))
    return F.struct(doc.alias("doc"), page.alias("page"), last.alias("last"))


@query(f"""SELECT conv_id, count(*) AS n_hits, count(DISTINCT (conv_id, coalesce(page::VARCHAR, ''), CASE WHEN page IS NULL THEN substring(trim(text), 1, {IDENTITY_CHARS}) ELSE '' END)) AS n_different
FROM (SELECT conv_id, text, CASE WHEN role = 'user' THEN turn // 4 END AS page FROM conversations) GROUP BY conv_id""")
def distinct_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a conversation, before and after those of one identity count once."""
    m = table(spark, d, "conversations").withColumn("page", F.when(F.col("role") == "user", F.expr("turn div 4")))
    one = hit_identity(F.col("conv_id"), F.col("page"), F.lit(None), F.coalesce("text", F.lit("")))
    return m.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_hits"), F.count_distinct(one).alias("n_different"))


def guarded(results: DataFrame, points: DataFrame, unlocked: DataFrame) -> DataFrame:
    """results(point, ...) with `reason`: missing_binding without a known point, locked if the point is not unlocked, else null.

    Results without a point, often a large part, join nothing: their one key would bring them all to one task.
    """
    known = points.select(F.col("point").alias("k")).distinct()
    free = unlocked.select(F.col("point").alias("u")).distinct()
    none = results.filter("point is null").withColumn("reason", F.lit("missing_binding"))
    both = results.filter("point is not null").join(known, F.col("point") == F.col("k"), "left").join(free, F.col("point") == F.col("u"), "left")
    named = F.when(F.col("u").isNull(), "locked").when(F.col("k").isNull(), "missing_binding")
    return both.withColumn("reason", named).drop("k", "u").unionByName(none)


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'A' THEN l_partkey END AS point, l_discount, l_tax FROM lineitem),
f AS (SELECT DISTINCT o.l_partkey AS point FROM lineitem o WHERE o.l_linestatus = 'F'),
g AS (SELECT a.*, CASE WHEN a.point IS NULL THEN 'missing_binding' WHEN f.point IS NULL THEN 'locked' WHEN p.p_partkey IS NULL THEN 'missing_binding' END AS reason
FROM a LEFT JOIN part p ON p.p_partkey = a.point LEFT JOIN f ON f.point = a.point)
SELECT l_orderkey AS quiz, coalesce(reason, 'updated') AS outcome, count(*) AS n FROM g GROUP BY ALL""")
def guarded_updates(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of each quiz's answers: a line is an answer, its part the point; parts with a finished line are unlocked."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    answers = lines.select("l_orderkey", F.when(F.col("l_returnflag") != "A", F.col("l_partkey")).alias("point"))
    unlocked = lines.filter("l_linestatus = 'F'").select(F.col("l_partkey").alias("point"))
    out = guarded(answers, table(spark, d, "part").select(F.col("p_partkey").alias("point")), unlocked)
    return out.groupBy(F.col("l_orderkey").alias("quiz"), F.coalesce("reason", F.lit("updated")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey AS quiz, l_suppkey AS point, min_by(l_discount, (l_linenumber, l_partkey, l_discount, l_tax)) AS old_level, max_by(l_tax, (l_linenumber, l_partkey, l_discount, l_tax)) AS new_level FROM lineitem GROUP BY ALL")
def mastery_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Per quiz and point the first old and the last new level of its answers in order."""
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_discount", "l_tax")
    order = F.struct("l_linenumber", "l_partkey", "l_discount", "l_tax")
    return rows.groupBy(F.col("l_orderkey").alias("quiz"), F.col("l_suppkey").alias("point")).agg(F.min_by("l_discount", order).alias("old_level"), F.max_by("l_tax", order).alias("new_level"))


@query(f"""SELECT p_brand AS path, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS place, p_partkey AS item FROM part
WHERE p_retailprice < 1400 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F') QUALIFY place <= {QUEUE}""")
def learnable_queue(spark: SparkSession, d: str) -> DataFrame:
    """The first unlocked items of each path that are not completed, by step: parts of a brand, completed from a price on."""
    unlocked = table(spark, d, "lineitem", "l_partkey", "l_linestatus").filter("l_linestatus = 'F'").select(F.col("l_partkey").alias("p_partkey"))
    items = table(spark, d, "part", "p_partkey", "p_brand", "p_size", "p_retailprice").filter("p_retailprice < 1400").join(unlocked, "p_partkey", "left_semi")
    return top(items, ["p_brand"], QUEUE, F.col("p_size"), F.col("p_partkey")).select(F.col("p_brand").alias("path"), F.col("rank").cast("long").alias("place"), F.col("p_partkey").alias("item"))


# -- the lexical store: entries(doc_id, kb_id, source, text, tokens, version) -------------------------

VERSION = "v2"


def without_documents(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """The store without the entries of documents gone(doc_id)."""
    return entries.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def changed(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """The store after changes(doc_id, new_source, new_kb), one a document: nulls leave a field as it is."""
    both = entries.join(changes.select("doc_id", "new_source", "new_kb"), "doc_id", "left")
    return both.withColumn("source", F.coalesce("new_source", "source")).withColumn("kb_id", F.coalesce("new_kb", "kb_id")).drop("new_source", "new_kb")


def retokenised(entries: DataFrame, version: str = VERSION) -> DataFrame:
    """The store with tokens made anew where they are missing or of another version."""
    stale = F.col("tokens").isNull() | ~F.col("version").eqNullSafe(version)
    return entries.withColumn("tokens", F.when(stale, lx.tokens(F.col("text"))).otherwise(F.col("tokens"))).withColumn("version", F.lit(version))


@query(f"""SELECT kb_id, source, count(*) AS entries, sum(n)::BIGINT AS tokens, min(version) AS version FROM
(SELECT CASE WHEN doc_id % 7 = 1 THEN 'moved' ELSE lang END AS kb_id, CASE WHEN doc_id % 11 = 2 THEN 'renamed' ELSE source END AS source,
CASE WHEN doc_id % 3 = 0 THEN 1 ELSE len({lx.tokens_sql('text')}) END AS n, '{VERSION}' AS version FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) GROUP BY ALL""")
def lexical_maintenance(spark: SparkSession, d: str) -> DataFrame:
    """Deletion, renaming, moving and backfill on a store in which a third of the entries has tokens of this version."""
    old = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("kept"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("stale")))
    version = F.when(F.col("doc_id") % 3 == 0, VERSION).when(F.col("doc_id") % 3 == 1, "v1")
    entries = table(spark, d, "documents").select("doc_id", F.col("lang").alias("kb_id"), "source", "text", old.alias("tokens"), version.alias("version"))
    left = without_documents(entries, table(spark, d, "labels").filter("toxic = 1"))
    ids = table(spark, d, "documents", "doc_id").distinct()
    moves = ids.select("doc_id", F.when(F.col("doc_id") % 11 == 2, "renamed").alias("new_source"), F.when(F.col("doc_id") % 7 == 1, "moved").alias("new_kb")).filter("new_source is not null or new_kb is not null")
    out = retokenised(changed(left, moves))
    return out.groupBy("kb_id", "source").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.size("tokens")).alias("tokens"), F.min("version").alias("version"))


QUERIES: dict[str, Callable] = catalogue.queries
ORACLES: dict[str, str] = catalogue.oracles
