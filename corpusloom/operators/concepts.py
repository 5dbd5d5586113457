"""Concepts: extraction from lines, exact clusters, near-equal pairs, merged clusters, post-processing.

A document's first line with text stands for its concept; the knowledge base is its source.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import keys
from corpusloom.functions.cleaning import once
from corpusloom.operators.components import connected
from corpusloom.operators.ordering import followers
from corpusloom.operators.retrieval import squared_distance, stored
from corpusloom.plans.catalogue import Catalogue
from corpusloom.sources.tables import shared_folder, table

catalogue = Catalogue()
query = catalogue.query

# Thresholds of merging and post-processing.
MIN_KEY, MIN_JACCARD, MAX_DISTANCE = 4, 0.45, 0.22
MIN_TEXT, MAX_TEXT, MAX_EXPLANATION = 4, 40, 80


def head(text: Column) -> Column:
    """The first line that is not blank."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"([^\s][^\n]*)", 1)


_HEAD = r"regexp_extract(coalesce(text, ''), '([^\s][^\n]*)', 1)"
_POINTS = f"SELECT doc_id, source AS kb, {_HEAD} AS concept, n_chars, lang, text FROM documents"


def points(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "source", "text", "n_chars", "lang")
    return docs.select("doc_id", F.col("source").alias("kb"), head(F.col("text")).alias("concept"), "n_chars", "lang")


@query(f"SELECT doc_id, concept, {keys.plain_sql('concept')} AS plain, {keys.comparison_key_sql('concept')} AS key FROM ({_POINTS})")
def concept_keys(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("concept")
    return points(spark, d).select("doc_id", "concept", keys.plain(c).alias("plain"), keys.comparison_key(c).alias("key"))


def keyed(spark: SparkSession, d: str) -> DataFrame:
    """Points with the key of their cluster; a point without a key is alone."""
    p = points(spark, d).withColumn("key", keys.soft_key(F.col("concept")))
    return p.withColumn("cluster", F.when(F.col("key") == "", F.concat(F.lit("#"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("="), "key")))


_KEYED = f"SELECT *, CASE WHEN key = '' THEN '#' || doc_id ELSE '=' || key END AS cluster FROM (SELECT *, {keys.comparison_key_sql('concept')} AS key FROM ({_POINTS}))"


@query(f"""SELECT kb, min(doc_id) AS representative, count(*) AS members, arg_min(concept, doc_id) AS concept, max(n_chars % 101)::BIGINT AS mastery,
sum(n_chars % 7)::BIGINT AS attempts, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs FROM ({_KEYED}) GROUP BY kb, cluster""")
def exact_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of equal keys per base: the earliest point represents; best mastery, summed attempts, all languages."""
    p = keyed(spark, d).groupBy("kb", "cluster")
    out = p.agg(
        F.min("doc_id").alias("representative"),
        F.count(F.lit(1)).alias("members"),
        F.min_by("concept", "doc_id").alias("concept"),
        F.max(F.col("n_chars") % 101).alias("mastery"),
        F.sum(F.col("n_chars") % 7).alias("attempts"),
        F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"),
    )
    return out.drop("cluster")


def member_map(spark: SparkSession, d: str) -> DataFrame:
    """(kb, doc_id, representative) of every point: two shuffles on the key, no group is collected."""
    p = keyed(spark, d).select("kb", "cluster", "doc_id")
    least = p.groupBy("kb", "cluster").agg(F.min("doc_id").alias("representative"))
    return p.join(least, ["kb", "cluster"]).select("kb", "doc_id", "representative")


_MEMBERS = f"SELECT kb, doc_id, min(doc_id) OVER (PARTITION BY kb, cluster) AS representative FROM ({_KEYED})"


@query(_MEMBERS)
def cluster_members(spark: SparkSession, d: str) -> DataFrame:
    return member_map(spark, d)


@query(f"""WITH m AS ({_MEMBERS}), e AS (SELECT kb, doc_id AS a, lead(doc_id) OVER (PARTITION BY kb ORDER BY doc_id) AS b FROM m)
SELECT DISTINCT e.kb, x.representative AS from_id, y.representative AS to_id FROM e JOIN m x ON e.a = x.doc_id JOIN m y ON e.b = y.doc_id WHERE x.representative <> y.representative""")
def collapse_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between consecutive points, moved to representatives; loops and repeats go."""
    p = points(spark, d).select("kb", "doc_id")
    after = followers(p, "kb", "doc_id", ["doc_id"], 1, "doc_id")
    edges = after.select("kb", F.col("doc_id").alias("a"), F.col("_next")[0]["doc_id"].alias("b")).filter("b is not null")
    m = member_map(spark, d)
    of = lambda k, name: m.select(F.col("doc_id").alias(k), F.col("representative").alias(name))
    return edges.join(of("a", "from_id"), "a").join(of("b", "to_id"), "b").filter("from_id <> to_id").select("kb", "from_id", "to_id").distinct()


@query(f"""WITH m AS ({_MEMBERS}), l AS (SELECT conv_id, turn, turn * 13 + conv_id AS doc_id FROM conversations)
SELECT conv_id, representative, min(turn) AS first_place FROM l JOIN m USING (doc_id) GROUP BY 1, 2""")
def collapse_ids(spark: SparkSession, d: str) -> DataFrame:
    """Lists of points (one per conversation) as representatives, each at its first place."""
    lists = table(spark, d, "conversations", "conv_id", "turn").withColumn("doc_id", F.col("turn") * 13 + F.col("conv_id"))
    return lists.join(member_map(spark, d), "doc_id").groupBy("conv_id", "representative").agg(F.min("turn").alias("first_place"))


#: Representatives of one block; columns of a dense product at a time, and rows; of a rarer bigram the meetings are counted one by one.
BLOCK, WIDTH, TILE, RARE = 4096, 2048, 512, 3000
#: Pairs of a task where tasks are few, tasks at most, and rows of a batch that leaves one.
PAIRS, TASKS, ROWS = 1 << 20, 8192, 1 << 16
#: What rounding to six places may add.
_EPS = 1e-6


def _codes(sets: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bigram as a number, bigrams of each row) of sets written one bigram after the other."""
    c = np.frombuffer("".join(sets).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, 2).astype(np.int64)
    n = np.array([len(x) // 2 for x in sets], dtype=np.int64)
    return np.repeat(np.arange(len(sets)), n), c[:, 0] << 21 | c[:, 1], n


def _span(n: np.ndarray, m: np.ndarray, t: int, least: float) -> slice:
    """Which of the sizes m, ascending, are near enough to those of a tile of the sizes n for a Jaccard of `least`."""
    if not least:
        return slice(0, len(m))
    return slice(int(np.searchsorted(m, least * n[t])), int(np.searchsorted(m, n[t : t + TILE][-1] / least, side="right")))


def shared_counts(left: list[str], right: list[str], least: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shared bigrams of each pair, bigrams of each left set, of each right one): frequent bigrams as products of matrices, rare ones by their meetings.

    With `least`, sets stand by size, and pairs whose sizes rule that Jaccard out may count too little.
    """
    (x, gx, nx), (y, gy, ny) = _codes(left), _codes(right)
    both = np.intersect1d(gx, gy)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if not len(both):
        return out, nx, ny
    x, gx = x[np.isin(gx, both)], np.searchsorted(both, gx[np.isin(gx, both)])
    y, gy = y[np.isin(gy, both)], np.searchsorted(both, gy[np.isin(gy, both)])
    meetings = np.bincount(gx, minlength=len(both)) * np.bincount(gy, minlength=len(both))
    place = np.empty(len(both), dtype=np.int64)
    place[np.argsort(-meetings, kind="stable")] = np.arange(len(both))
    gx, gy, dense = place[gx], place[gy], int((meetings * RARE > out.size).sum())
    for lo in range(0, dense, WIDTH):
        hi = min(lo + WIDTH, dense)
        a, b = (np.zeros((n, hi - lo), dtype=np.float32) for n in out.shape)
        some, more = (gx >= lo) & (gx < hi), (gy >= lo) & (gy < hi)
        a[x[some], gx[some] - lo] = b[y[more], gy[more] - lo] = 1
        for t in range(0, len(left), TILE):
            near = _span(nx, ny, t, least)
            out[t : t + TILE, near] += a[t : t + TILE] @ b[near].T
    x, gx, y, gy = x[gx >= dense], gx[gx >= dense] - dense, y[gy >= dense], gy[gy >= dense] - dense
    order, n = np.argsort(gy, kind="stable"), np.bincount(gy, minlength=len(both) - dense)
    y, start = y[order], np.cumsum(n) - n
    for lo in range(0, len(x), TILE):
        many = n[gx[lo : lo + TILE]]
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[gx[lo : lo + TILE]], many)
        np.add.at(out.reshape(-1), np.repeat(x[lo : lo + TILE], many) * len(right) + y[at], 1)
    return out, nx, ny


def local_roots(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest place that each is connected with, after the links (x, y) too."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while (root != root[root]).any():
            root = root[root]


def _pairs_of(stars: bool, most: float | None) -> Callable:
    """Of the representatives of one or two blocks: pairs that reach the limit, tile by tile, or a star for each set that they connect."""
    least = MIN_JACCARD - _EPS

    def told(kb: pa.Scalar, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = ["kb", "a", "b"] if stars else ["kb", "a", "b", "both", "any", *([] if most is None else ["distance"])]
        for lo in range(0, len(columns[0]), ROWS):
            part = [pa.array(c[lo : lo + ROWS]) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.repeat(kb, len(part[0])), *part], names)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by("n")
        kb, side, two = rows["kb"][0], rows["_side"].to_numpy(), rows["_i"][0] != rows["_j"][0]
        left, right = (rows.filter(pa.array(side == k)) for k in (0, 1)) if two else (rows, rows)
        ids, ids_b = left["id"].to_numpy(), right["id"].to_numpy()
        if not len(ids) or not len(ids_b):
            return
        shared, n, m = shared_counts(left["grams"].to_pylist(), right["grams"].to_pylist(), least)
        if most is not None:
            u, v = (np.array(t["vector"].to_pylist(), dtype=np.float64).T for t in (left, right))
        root = np.arange(len(ids) + (len(ids_b) if two else 0))
        for t in range(0, len(ids), TILE):
            near = _span(n, m, t, least)
            s = shared[t : t + TILE, near]
            fits = s >= least * (n[t : t + TILE, None] + m[near] - s)
            if not two:
                fits &= ids[t : t + TILE, None] < ids_b[near]
            i, j = np.nonzero(fits)
            of = s[i, j].astype(np.int64)
            i, j, d = i + t, j + near.start, None
            if most is not None:
                d = np.zeros(len(i))
                for x, y in zip(u, v, strict=True):  # in the order of the vector, as a fold adds
                    d += (x[i] - y[j]) ** 2
                close = d <= most + _EPS
                i, j, of, d = i[close], j[close], of[close], d[close]
            if stars:
                # the same rounding as that of the pairs
                close = np.floor(of / (n[i] + m[j] - of) * 1e6 + 0.5) >= MIN_JACCARD * 1e6 - 1e-3
                close &= True if d is None else np.floor(d * 1e6 + 0.5) <= most * 1e6 + 1e-3
                root = local_roots(root, i[close], j[close] + (len(ids) if two else 0))
            else:
                yield from told(kb, np.minimum(ids[i], ids_b[j]), np.maximum(ids[i], ids_b[j]), of, n[i] + m[j] - of, *(() if d is None else (d,)))
        if stars:
            every, some = np.concatenate([ids, ids_b]) if two else ids, np.flatnonzero(root != np.arange(len(root)))
            yield from told(kb, every[root[some]], every[some])

    return pairs


def _compared(reps: DataFrame, stars: bool, most: float | None = None) -> DataFrame:
    """Pairs of reps(kb, id, key[, vector]) of a base, or stars that connect what they connect.

    Keys share most of their bigrams with most keys of their language, so no prefix of them is rare and a join on bigrams
    meets nearly all pairs many times. Each base is cut into blocks by size of the sets instead; a pair of blocks whose sizes are
    near enough is one small group, whose pairs are counted in memory and leave it at most once: what is shuffled is each set
    once a block that it may be near to. Work grows faster than bytes, so the number of tasks comes from the pairs.
    """
    rows = stored(reps.withColumn("grams", F.array_join(keys.bigrams(F.col("key")), "")).drop("key"), "bigrams").withColumn("n", F.floor(F.char_length("grams") / 2))
    by = Window.partitionBy("kb")
    cells = rows.groupBy("kb", "n").agg(F.count(F.lit(1)).alias("_many"))
    cells = stored(cells.withColumn("_start", F.sum("_many").over(by.orderBy("n")) - F.col("_many")).withColumn("_all", F.sum("_many").over(by)), "sizes")
    spread = F.sequence(F.floor(F.col("_start") / BLOCK), F.floor((F.col("_start") + F.col("_many") - 1) / BLOCK))
    blocks = cells.select("kb", "n", F.explode(spread).alias("_own")).groupBy("kb", "_own").agg(F.min("n").alias("_lo"), F.max("n").alias("_hi"))
    other = blocks.select("kb", *(F.col(c).alias(f"{c}_b") for c in ("_own", "_lo", "_hi")))
    least = MIN_JACCARD - _EPS
    near = (F.col("_lo") * least <= F.col("_hi_b")) & (F.col("_lo_b") * least <= F.col("_hi"))
    blocks = blocks.join(other, "kb").filter(near).groupBy("kb", "_own").agg(F.min("_own_b").alias("_from"), F.max("_own_b").alias("_to"))
    many = cells.agg(F.sum(F.col("_many") * F.col("_all").cast("double"))).first()[0] or 0
    own = F.floor((F.col("_start") + F.pmod(F.xxhash64("id"), F.col("_many"))) / BLOCK)
    rows = rows.join(F.broadcast(cells.drop("_all")), ["kb", "n"]).withColumn("_own", own).drop("_start", "_many").join(F.broadcast(blocks), ["kb", "_own"])
    rows = rows.withColumn("_other", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")
    rows = rows.select("*", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") > F.col("_other")).cast("int").alias("_side")).drop("_own", "_other")
    rows = rows.repartition(int(min(TASKS, many / 2 // PAIRS + 1)), "kb", "_i", "_j")
    kind = "kb string, a long, b long" + ("" if stars else ", both long, any long" + ("" if most is None else ", distance double"))
    return rows.groupBy("kb", "_i", "_j").applyInArrow(_pairs_of(stars, most), kind)


def representatives(spark: SparkSession, d: str) -> DataFrame:
    """(kb, id, key): the earliest point of each key long enough to compare. Heads and keys are computed once a row."""
    docs = table(spark, d, "documents", "doc_id", "source", "text").filter("source is not null").select("doc_id", F.col("source").alias("kb"), "text")
    heads = once(docs, {"concept": head(F.col("text"))}).select("doc_id", "kb", "concept")
    found = once(heads, {"key": keys.soft_key(F.col("concept"))}).select("doc_id", "kb", "key")
    return found.filter(F.char_length("key") >= MIN_KEY).groupBy("kb", "key").agg(F.min("doc_id").alias("id"))


def near_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(kb, a, b, similarity): representatives whose keys' bigram Jaccard reaches the limit."""
    return _reaching(_compared(representatives(spark, d), False)).select("kb", "a", "b", "similarity")


def _reaching(pairs: DataFrame) -> DataFrame:
    """Pairs with their similarity to six places. Halves go up, counted in integers, which gives what rounding the quotient as a decimal does."""
    millionths = F.expr("(2000000 * both + `any`) div (2 * `any`)")
    return pairs.withColumn("similarity", millionths / F.lit(1e6)).filter(F.col("similarity") >= MIN_JACCARD)


def _grouped(stars: DataFrame) -> DataFrame:
    """(kb, id, component) of stars(kb, a, b), which are written once."""
    spark = stars.sparkSession
    path = f"{shared_folder(spark)}/stars-{uuid.uuid4().hex}"
    stars.write.parquet(path)
    kept = spark.read.schema(stars.schema).parquet(path)
    where = kept.select("kb", F.explode(F.array("a", "b")).alias("id")).distinct()
    return where.join(connected(kept.select("a", "b")), "id").select("kb", "id", "component")


_PAIRS = f"""WITH r AS (SELECT kb, key, min(doc_id) AS id FROM ({_KEYED}) WHERE length(key) >= {MIN_KEY} GROUP BY 1, 2), s AS (SELECT kb, id, {keys.bigrams_sql('key')} AS g FROM r)
SELECT kb, a, b, similarity FROM (SELECT x.kb, x.id AS a, y.id AS b, round(len(list_intersect(x.g, y.g)) / len(list_distinct(x.g || y.g)), 6) AS similarity
FROM s x JOIN s y ON x.kb = y.kb AND x.id < y.id) WHERE similarity >= {MIN_JACCARD}"""


@query(_PAIRS)
def bigram_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(spark, d)


@query(f"""WITH RECURSIVE p AS ({_PAIRS}), e AS (SELECT kb, a, b FROM p UNION SELECT kb, b, a FROM p), t AS (SELECT kb, a AS id, a AS c FROM e UNION SELECT t.kb, e.b, t.c FROM t JOIN e ON t.id = e.a)
SELECT kb, id, min(c) AS component FROM t GROUP BY 1, 2""")
def merged_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Connected groups of near-equal representatives."""
    return _grouped(_compared(representatives(spark, d), True))


def semantic_pairs(pairs: DataFrame, vectors: DataFrame, most: float = MAX_DISTANCE) -> DataFrame:
    """Of pairs(kb, a, b, similarity) of concepts that pass the text gate, those whose vectors(id, vector) are close; with their distance.

    The gate comes first: it is a join on rare bigrams, where a search for the nearest vectors of every concept would
    compare each with all others of its base. A search for six neighbours would only lose some of these pairs.
    """
    of = lambda k: vectors.select(F.col("id").alias(k), F.col("vector").alias(f"{k}_vector"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("distance", F.round(squared_distance(F.col("a_vector"), F.col("b_vector")), 6))
    return both.filter(F.col("distance") <= most).select("kb", "a", "b", "similarity", "distance")


#: The distance of the query on the test tables, whose vectors have nothing to do with their texts.
QUERY_DISTANCE = 2.0
_SEMANTIC = f"""SELECT kb, a, b, similarity, distance FROM (SELECT p.*, round(list_sum(list_transform(list_zip(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), lambda v: (v[1] - v[2]) * (v[1] - v[2]))), 6) AS distance
FROM ({_PAIRS}) p JOIN embeddings x ON p.a = x.vec_id JOIN embeddings y ON p.b = y.vec_id) WHERE distance <= {QUERY_DISTANCE}"""


def with_vectors(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return representatives(spark, d).join(vectors.filter("vector is not null"), "id")


@query(_SEMANTIC)
def semantic_gate(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of concepts alike in text and in vector: a pair's distance is told where its bigrams are compared."""
    pairs = _reaching(_compared(with_vectors(spark, d), False, QUERY_DISTANCE)).withColumn("distance", F.round("distance", 6))
    return pairs.filter(F.col("distance") <= QUERY_DISTANCE).select("kb", "a", "b", "similarity", "distance")


@query(f"""WITH RECURSIVE p AS ({_SEMANTIC}), e AS (SELECT kb, a, b FROM p UNION SELECT kb, b, a FROM p), t AS (SELECT kb, a AS id, a AS c FROM e UNION SELECT t.kb, e.b, t.c FROM t JOIN e ON t.id = e.a)
SELECT kb, id, min(c) AS component FROM t GROUP BY 1, 2""")
def semantic_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Connected groups of concepts alike in text and in vector."""
    return _grouped(_compared(with_vectors(spark, d), True, QUERY_DISTANCE))


def representative_of(asked: DataFrame, members: DataFrame) -> DataFrame:
    """asked(kb, text) with the representative that each text means, or null.

    members(kb, concept, doc_id, representative). Best way of matching first: the representative's own text, a member's,
    their comparison keys, their soft keys; of equals the smallest representative.
    """
    ways = [F.trim, keys.comparison_key, keys.soft_key]
    each = lambda text: F.array(*(F.struct(F.lit(i).alias("way"), f(text).alias("key")) for i, f in enumerate(ways)))
    own = (F.col("doc_id") != F.col("representative")).cast("int")
    known = members.select("kb", own.alias("other"), "representative", F.explode(each(F.col("concept"))).alias("k")).select("kb", "k.way", "k.key", "other", "representative")
    known = known.filter("key <> ''").groupBy("kb", "way", "key").agg(F.min(F.struct("other", "representative")).alias("m"))
    wanted = asked.select("kb", "text").distinct()
    tried = wanted.withColumn("k", F.explode(each(F.col("text")))).select("kb", "text", "k.way", "k.key")
    best = tried.join(known, ["kb", "way", "key"]).groupBy("kb", "text").agg(F.min(F.struct("way", "m.other", "m.representative")).alias("best"))
    return asked.join(best, ["kb", "text"], "left").withColumn("representative", F.col("best.representative")).drop("best")


@query(f"""WITH m AS (SELECT p.kb, p.concept, m.doc_id, m.representative, (m.doc_id <> m.representative)::INT AS other FROM ({_MEMBERS}) m JOIN ({_POINTS}) p USING (doc_id)),
k AS (SELECT kb, other, representative, unnest([0, 1, 2]) AS way, unnest([trim(concept), {keys.comparison_key_sql('concept')}, {keys.comparison_key_sql('concept')}]) AS key FROM m),
a AS (SELECT doc_id, source AS kb, upper({_HEAD}) || '。' AS text FROM documents WHERE doc_id % 100 = 0),
t AS (SELECT doc_id, kb, unnest([0, 1, 2]) AS way, unnest([trim(text), {keys.comparison_key_sql('text')}, {keys.comparison_key_sql('text')}]) AS key FROM a)
SELECT a.doc_id, min_by(k.representative, struct_pack(w := k.way, o := k.other, r := k.representative)) AS representative FROM a LEFT JOIN t USING (doc_id) LEFT JOIN k ON t.kb = k.kb AND t.way = k.way AND t.key = k.key AND k.key <> '' GROUP BY 1""")
def concept_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The representatives of concepts asked for in capitals with a mark at the end: every document whose id is divisible by 100, against all."""
    p = points(spark, d)
    members = member_map(spark, d).join(p.select("doc_id", "concept"), "doc_id")
    asked = p.filter("doc_id % 100 = 0").select("doc_id", "kb", F.concat(keys.capitals(F.col("concept")), F.lit("。")).alias("text"))
    return representative_of(asked, members).select("doc_id", "representative")


# Phrases too general for a concept, and what looks like a heading.
GENERIC = "重要概念 核心概念 关键概念 关键知识点 核心知识点 相关知识点 主要内容 核心内容 重点内容 本节内容 知识点总结 学习目标".split()
HEADINGS = [
    r"^第[一二三四五六七八九十0-9]+[章节部分]",
    r"^\d+(?:\.\d+){0,3}$",
    r"^(引言|绪论|总结|小结|习题|参考文献)$",
]
#: Characters up to which a text that only holds such a phrase is as general as the phrase.
GENERIC_CHARS = 12
_FRONT, _BACK = r"^[\-\u2022\u00b7•·,，;；:：]+", "[，,；;。.!！?？：:]+$"
_FRONT_SQL = _FRONT.replace(r"\u2022\u00b7", "")  # the other engine writes code points otherwise; both marks follow
_CUT_END = "[ ，,；;。.!！?？：:]+$"


def concept_text(line: Column) -> Column:
    """A candidate's text: single spaces, no bullets before it, no marks after it."""
    t = F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), r"\s+", " "))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(t, _FRONT, "")), _BACK, ""))


def explanation_text(text: Column, explanation: Column) -> Column:
    """An explanation of up to 80 characters, or null where it says no more than the concept itself."""
    whole = F.trim(F.regexp_replace(explanation, r"\s+", " "))
    cut = F.when(F.char_length(whole) > MAX_EXPLANATION, F.regexp_replace(F.substring(whole, 1, MAX_EXPLANATION), _CUT_END, "")).otherwise(whole)
    a, b = keys.plain(text), keys.plain(cut)
    same = (a != "") & ((a == b) | ((F.contains(b, a) | F.contains(a, b)) & (b != "") & (F.abs(F.char_length(a) - F.char_length(b)) <= 8)))
    return F.when((cut != "") & ~same, cut)


_LINES = r"SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS place FROM documents"
_CONCEPT = f"trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(coalesce(line, ''), '\\s+', ' ', 'g')), '{_FRONT_SQL}', '')), '{_BACK}', ''))"


@query(f"""WITH c AS (SELECT doc_id, place, {_CONCEPT} AS t FROM ({_LINES})),
p AS (SELECT *, {keys.plain_sql('t')} AS plain, {keys.comparison_key_sql('t')} AS key FROM c),
f AS (SELECT *, CASE WHEN key = '' THEN 'empty' WHEN length(plain) < {MIN_TEXT} OR length(plain) > {MAX_TEXT} THEN 'length' WHEN regexp_matches(t, '{"|".join(HEADINGS)}') THEN 'heading'
WHEN length(plain) <= {GENERIC_CHARS} AND regexp_matches(plain, '{"|".join(GENERIC)}') THEN 'generic' ELSE 'kept' END AS verdict FROM p),
g AS (SELECT *, min(place) FILTER (WHERE verdict = 'kept') OVER (PARTITION BY doc_id, key) AS first_kept FROM f),
r AS (SELECT *, CASE WHEN place > first_kept THEN 'duplicate' ELSE verdict END AS final FROM g)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE final = 'empty') AS empty, count(*) FILTER (WHERE final = 'length') AS length, count(*) FILTER (WHERE final = 'heading') AS heading,
count(*) FILTER (WHERE final = 'generic') AS generic, count(*) FILTER (WHERE final = 'duplicate') AS duplicate, count(*) FILTER (WHERE final = 'kept') AS kept FROM r GROUP BY 1""")
def keypoint_postprocess(spark: SparkSession, d: str) -> DataFrame:
    """Lines as candidate concepts: why each goes, counted per document (the strict mode's diagnostics).

    A candidate whose key was kept before is a duplicate whatever else it is; one without a key is empty.
    """
    lines = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return postprocessed(lines).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), *(F.count_if(F.col("verdict") == x).alias(x) for x in VERDICTS))


VERDICTS = ("empty", "length", "heading", "generic", "duplicate", "kept")


def postprocessed(lines: DataFrame) -> DataFrame:
    """lines(doc_id, place, line) with the text of the candidate and its verdict.

    Candidates are computed once; the first kept place of a key comes from a window over the lines of one document that have it.
    """
    t = once(lines, {"t": concept_text(F.col("line"))})
    t = once(t, {"plain": keys.plain(F.col("t"))})
    t = once(t, {"key": F.regexp_replace("plain", keys.LEFT_OUT, "")})
    n = F.char_length("plain")
    heading = F.col("t").rlike("|".join(HEADINGS))
    generic = (n <= GENERIC_CHARS) & F.col("plain").rlike("|".join(GENERIC))
    own = F.when(F.col("key") == "", "empty").when((n < MIN_TEXT) | (n > MAX_TEXT), "length").when(heading, "heading").when(generic, "generic").otherwise("kept")
    judged = once(t, {"verdict": own})
    first = F.min(F.when(F.col("verdict") == "kept", F.col("place"))).over(Window.partitionBy("doc_id", "key"))
    out = judged.withColumn("first_kept", first)
    return out.withColumn("verdict", F.when(F.col("place") > F.col("first_kept"), "duplicate").otherwise(F.col("verdict"))).select("doc_id", "place", "line", "t", "verdict")


QUERIES: dict[str, Callable] = catalogue.queries
ORACLES: dict[str, str] = catalogue.oracles
