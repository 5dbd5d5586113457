"""From what a learner asked to the concepts it is about: equal texts, texts that contain it, nearest vectors; guarded study updates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from corpusloom.operators import concepts, learner, retrieval
from corpusloom.plans.catalogue import Catalogue
from corpusloom.sources.tables import table

catalogue = Catalogue()
query = catalogue.query
QUERIES, ORACLES = catalogue.queries, catalogue.oracles

#: Nearest vectors looked at, and how near they have to be.
NEAREST, MOST = 3, 1.0


def bare(text: Column) -> Column:
    """Lower case without marks."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}_\s]", "")


#: Pieces of k characters, of w in a row the one with the least hash, by which needles of k + w - 1 characters or more are looked for.
KINDS = [(1, 1), (2, 1), (3, 1), (4, 2), (6, 5)]
_LEAST = [k + w - 1 for k, w in KINDS]
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def marks(text: str, kind: int) -> np.ndarray:
    """Hashes of the pieces that stand for a text: a text that contains a needle, long enough for the kind, has all marks of the needle."""
    k, w = KINDS[kind]
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(c) < k + w - 1:
        return np.zeros(0, dtype=np.int64)
    h = np.full(len(c) - k + 1, kind, dtype=np.uint64)
    for i in range(k):
        h = (h ^ c[i : len(c) - k + 1 + i]) * _MIX[0]
        h ^= h >> np.uint64(29)
    h = h * _MIX[1]
    h ^= h >> np.uint64(32)
    least = h[: len(h) - w + 1]
    for i in range(1, w):
        least = np.minimum(least, h[i : len(h) - w + 1 + i])
    return np.unique(least).view(np.int64)


@F.pandas_udf(ArrayType(LongType()))
def _marks(texts: pd.Series, kinds: pd.Series) -> pd.Series:
    """Marks of each text, of all kinds whose bits are set."""
    return pd.Series([np.concatenate([np.zeros(0, dtype=np.int64), *(marks(t, i) for i in range(len(KINDS)) if k >> i & 1)]) for t, k in zip(texts, kinds, strict=True)], dtype=object)


def containing(asked: DataFrame, points: DataFrame) -> DataFrame:
    """(id, point) of asked(id, scope, needle) and points(scope, point, text): all points of the scope whose text contains the needle.

    A needle is looked for under its rarest mark in that scope, so pieces that many points share bring candidates only for needles
    without a rarer one. Texts are marked only for lengths of needles that their scope asks for; marks move without the
    texts, which meet the needles once, by point. An empty needle is in every text and finds nothing here.
    """
    n = F.char_length("needle")
    kind = F.lit(0)
    for i, least in enumerate(_LEAST):
        kind = F.when(n >= least, 1 << i).otherwise(kind)
    asked = asked.filter("needle <> '' and scope is not null").withColumn("kind", kind)
    key = F.xxhash64("scope", "mark").alias("key")
    wanted = asked.select("id", "scope", "needle", F.explode(_marks("needle", "kind")).alias("mark")).select("id", "scope", "needle", key)
    kinds = asked.groupBy("scope").agg(F.bit_or("kind").alias("kinds"))
    held = points.join(kinds, "scope").select("scope", "point", F.explode(_marks(F.coalesce("text", F.lit("")), "kinds")).alias("mark")).select("scope", "point", key)
    df = held.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    tried = wanted.select("id", "scope", F.xxhash64("needle").alias("of"), "key").join(df, "key", "left")
    rarest = tried.groupBy("id", "scope", "of").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key")).alias("g")).filter("g.df > 0")
    rarest = asked.select("id", "scope", "needle", F.xxhash64("needle").alias("of")).join(rarest, ["id", "scope", "of"]).select("id", "scope", "needle", F.col("g.key").alias("key"))
    met = held.join(rarest, ["scope", "key"]).select("scope", "point", "id", "needle")
    return met.join(points.select("scope", "point", "text"), ["scope", "point"]).filter(F.contains("text", F.col("needle"))).select("id", "point")


def by_text(asked: DataFrame, points: DataFrame) -> DataFrame:
    """(id, point, way) of asked(id, scope, focus): the first point with that very text, else the first whose bare text is or contains the bare focus."""
    texts = points.select("scope", "point", "text")
    same = asked.select("id", "scope", F.trim("focus").alias("text")).filter("text <> ''").join(texts, ["scope", "text"]).select("id", "point", F.lit(1).alias("way"))
    rest = asked.join(same.select("id").distinct(), "id", "left_anti")  # where the very text is found, none that contains it counts
    inside = containing(rest.select("id", "scope", bare(F.col("focus")).alias("needle")), texts.select("scope", "point", bare(F.col("text")).alias("text")))
    found = same.unionByName(inside.withColumn("way", F.lit(2))).groupBy("id").agg(F.min(F.struct("way", "point")).alias("b"))
    return found.select("id", "b.point", F.when(F.col("b.way") == 1, "exact").otherwise("contains").alias("way"))


def by_vector(asked: DataFrame, points: DataFrame) -> DataFrame:
    """(id, point, place) of asked(scope, id, target) and points(scope, id, vector): up to three nearest within the distance."""
    near = retrieval.nearest(points, asked.withColumnRenamed("id", "question"), NEAREST, MOST)
    return near.select(F.col("question").alias("id"), F.col("id").alias("point"), F.col("rank").alias("place"))


def studied(hits: DataFrame, points: DataFrame, unlocked: DataFrame, representative: DataFrame) -> DataFrame:
    """points(point, mastery) that hits(point) move, after their step, and whether they were locked: (point, before, after, locked).

    A hit counts for its cluster's representative(point, representative), once; a locked one changes nothing.
    """
    at = hits.join(representative, "point", "left").select(F.coalesce("representative", "point").alias("point")).distinct()
    open_ = unlocked.select("point").distinct().withColumn("_open", F.lit(True))
    moved = points.join(at, "point").join(open_, "point", "left")
    after = F.when(F.col("mastery") >= learner.MASTERED, F.col("mastery")).otherwise(learner.ema(F.col("mastery"), F.lit(1.0), learner.STUDY_ALPHA))
    locked = F.col("_open").isNull()
    return moved.select("point", F.col("mastery").alias("before"), F.when(locked, F.col("mastery")).otherwise(after).alias("after"), locked.alias("locked"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Each concept asked for in its base: as it stands, its beginning with marks, by a piece of it, by something else."""
    p = concepts.points(spark, d)
    form, c = F.col("doc_id") % 4, F.col("concept")
    focus = F.when(form == 0, c).when(form == 1, F.concat(F.substring(c, 1, 20), F.lit("?!"))).when(form == 2, F.substring(c, 4, 12)).otherwise(F.concat(c, F.lit(" zzz")))
    return p.select(F.col("doc_id").alias("id"), F.col("kb").alias("scope"), focus.alias("focus"))


_BARE = lambda x: f"regexp_replace(lower(trim({x})), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"
_MATCHED = f"""p AS ({concepts._POINTS}), a AS (SELECT doc_id AS id, kb, CASE doc_id % 4 WHEN 0 THEN concept WHEN 1 THEN substring(concept, 1, 20) || '?!' WHEN 2 THEN substring(concept, 4, 12) ELSE concept || ' zzz' END AS focus FROM p),
f AS (SELECT id, (SELECT min(doc_id) FROM p WHERE p.kb = a.kb AND p.concept = trim(focus) AND trim(focus) <> '') AS same, (SELECT min(doc_id) FROM p WHERE p.kb = a.kb AND {_BARE('focus')} <> '' AND contains({_BARE('p.concept')}, {_BARE('focus')})) AS inside FROM a),
m AS (SELECT id, coalesce(same, inside) AS point, CASE WHEN same IS NOT NULL THEN 'exact' ELSE 'contains' END AS way FROM f WHERE coalesce(same, inside) IS NOT NULL)"""


@query(f"WITH {_MATCHED} SELECT * FROM m")
def focus_matches(spark: SparkSession, d: str) -> DataFrame:
    """The concept that each question's focus names."""
    points = concepts.points(spark, d).select(F.col("kb").alias("scope"), F.col("doc_id").alias("point"), F.col("concept").alias("text"))
    return by_text(_asked(spark, d), points)


@query(f"""WITH {_MATCHED}, h AS (SELECT DISTINCT point FROM m), s AS (SELECT d.doc_id AS point, n_chars % 101 / 100.0::DOUBLE AS before, n_chars < 300 AS locked FROM documents d JOIN h ON d.doc_id = h.point)
SELECT point, before, CASE WHEN locked OR before >= {learner.MASTERED} THEN before ELSE floor((0.1::DOUBLE * 1.0::DOUBLE + 0.9::DOUBLE * before) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE END AS after, locked FROM s""")
def study_updates(spark: SparkSession, d: str) -> DataFrame:
    """Mastery of the concepts asked about after the questions; those of short documents are locked."""
    docs = table(spark, d, "documents", "doc_id", "n_chars").withColumnRenamed("doc_id", "point")
    none = docs.limit(0).select("point", F.col("point").alias("representative"))
    return studied(focus_matches(spark, d), docs.select("point", (F.col("n_chars") % 101 / 100.0).alias("mastery")), docs.filter("n_chars >= 300"), none)


@query("""WITH l AS (SELECT user_id, event_type || '-' || (k % 20) AS concept, ts, event_id FROM (SELECT *, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('error', 'click')))
SELECT user_id, concept, n, place FROM (SELECT user_id, concept, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min((ts, event_id))) AS place FROM l WHERE concept IS NOT NULL GROUP BY 1, 2) WHERE place <= 10""")
def frequent_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The ten concepts that a learner got wrong most often, of equals the one seen first: what stands in where no mastery is known."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "props").filter(F.col("event_type").isin("error", "click"))
    k = F.expr("try_cast(get_json_object(props, '$.k') AS bigint)")
    counts = e.withColumn("concept", F.concat_ws("-", "event_type", (k % 20).cast("string"))).filter(k.isNotNull()).groupBy("user_id", "concept").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "event_id")).alias("first"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "first"))
    return counts.withColumn("place", place).filter("place <= 10").select("user_id", "concept", "n", "place")
