"""Documents and bases removed, moved, created: one change set, carried to every table that hangs on it, published in one switch.

Tables are a dict of DataFrames. Nothing is updated in place: a change gives the tables as they are afterwards, by semi- and
anti-joins with the change set, and `publish_all` writes them as one version.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.catalogue import Catalogue
from corpusloom.sources import versions
from corpusloom.sources.tables import table

catalogue = Catalogue()
query = catalogue.query
QUERIES, ORACLES = catalogue.queries, catalogue.oracles

#: Tables with doc_id and kb, tables by their parent's key, and the graph of a base.
CHILDREN = ("quizzes", "keypoints", "vectors", "sessions")
GRANDCHILDREN = {"attempts": ("quizzes", "quiz_id"), "messages": ("sessions", "session_id")}
GRAPH = "edges"

Tables = dict[str, DataFrame]


def _without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(F.col(key).alias("_gone")).distinct(), F.col(key) == F.col("_gone"), "left_anti")


def documents_removed(tables: Tables, gone: DataFrame) -> Tables:
    """The tables without the documents of gone(doc_id), all that belongs to them, and the graphs of their bases."""
    docs = tables["documents"].join(gone.select("doc_id").distinct(), "doc_id", "left_semi")
    return _removed(tables, docs.select("doc_id"), docs.select("kb"), None)


def _removed(tables: Tables, docs: DataFrame, graphs: DataFrame, bases: DataFrame | None) -> Tables:
    """Rows of the given documents, and of the given bases where these go as well, leave every table; with them what hangs on those rows."""
    out = {}
    for name in ("documents", *CHILDREN):
        out[name] = _without(tables[name], docs, "doc_id")
        if bases is not None:
            out[name] = _without(out[name], bases, "kb")
    for name, (parent, key) in GRANDCHILDREN.items():
        out[name] = tables[name].join(out[parent].select(key).distinct(), key, "left_semi")
    out[GRAPH] = _without(tables[GRAPH], graphs, "kb")
    return {k: out.get(k, v) for k, v in tables.items()}


def documents_moved(tables: Tables, moves: DataFrame) -> Tables:
    """The tables after moves(doc_id, kb, name): null keeps a base or a name. A new base reaches every child; both bases lose their graphs."""
    new = moves.select(F.col("doc_id").alias("_doc"), F.col("kb").alias("_kb"), F.col("name").alias("_name"))
    joined = lambda df: df.join(new, F.col("doc_id") == F.col("_doc"), "left").withColumn("_old", F.col("kb"))
    docs = joined(tables["documents"]).withColumn("kb", F.coalesce("_kb", "kb")).withColumn("name", F.coalesce("_name", "name"))
    out = {"documents": docs.drop("_doc", "_kb", "_name", "_old")}
    for name in CHILDREN:
        out[name] = joined(tables[name]).withColumn("kb", F.coalesce("_kb", "kb")).drop("_doc", "_kb", "_name", "_old")
    touched = docs.filter("kb <> _old").select(F.explode(F.array("kb", "_old")).alias("kb"))
    out[GRAPH] = _without(tables[GRAPH], touched, "kb")
    return {k: out.get(k, v) for k, v in tables.items()}


def bases_removed(tables: Tables, asked: DataFrame, cascade: bool) -> tuple[Tables, DataFrame]:
    """The tables without the bases of asked(kb), and (kb, removed): a base with documents stays unless all goes with it."""
    held = tables["documents"].select("kb").distinct().withColumn("_held", F.lit(True))
    answer = asked.select("kb").distinct().join(held, "kb", "left").select("kb", (F.col("_held").isNull() | F.lit(cascade)).alias("removed"))
    goes = answer.filter("removed").select("kb")
    docs = tables["documents"].join(goes, "kb", "left_semi").select("doc_id")
    out = _removed(tables, docs, goes, goes)
    out["bases"] = _without(tables["bases"], goes, "kb")
    return out, answer


def bases_created(bases: DataFrame, asked: DataFrame) -> DataFrame:
    """(kb, user_id, name) with the asked (user_id, name) added: once each, nothing where the user has that name; ids follow the largest."""
    wanted = asked.select("user_id", F.trim("name").alias("name")).filter("name <> ''").distinct().join(bases.select("user_id", "name"), ["user_id", "name"], "left_anti")
    top = bases.agg(F.coalesce(F.max("kb"), F.lit(-1)).alias("_top"))
    numbered = wanted.withColumn("_n", F.xxhash64("user_id", "name")).withColumn("_n", F.pmod("_n", F.lit(1 << 40)))
    return bases.unionByName(numbered.join(F.broadcast(top)).select((F.col("_top") + 1 + F.col("_n")).alias("kb"), "user_id", "name"))  # one row


def bases_renamed(bases: DataFrame, renames: DataFrame) -> DataFrame:
    """(kb, user_id, name, refused) after renames(kb, to): refused where another base of the user has, or is to have, that name."""
    new = renames.select(F.col("kb").alias("_kb"), F.trim("to").alias("_to"))
    both = bases.join(new, F.col("kb") == F.col("_kb"), "left")
    taken = bases.select(F.col("kb").alias("_other"), F.col("user_id").alias("_user"), F.col("name").alias("_name"))
    taken = taken.unionByName(both.filter(F.col("_to").isNotNull()).select(F.col("kb").alias("_other"), F.col("user_id").alias("_user"), F.col("_to").alias("_name")))
    clash = both.join(taken, (F.col("user_id") == F.col("_user")) & (F.col("_to") == F.col("_name")) & (F.col("kb") > F.col("_other")), "left_semi").select("kb")
    clash = clash.unionByName(both.join(bases.select(F.col("kb").alias("_other"), F.col("user_id").alias("_user"), F.col("name").alias("_name")), (F.col("user_id") == F.col("_user")) & (F.col("_to") == F.col("_name")) & (F.col("kb") != F.col("_other")), "left_semi").select("kb")).distinct()
    out = both.join(clash.withColumn("_bad", F.lit(True)).withColumnRenamed("kb", "_k"), F.col("kb") == F.col("_k"), "left")
    refused = F.coalesce("_bad", F.lit(False))
    return out.select("kb", "user_id", F.when(refused | F.col("_to").isNull(), F.col("name")).otherwise(F.col("_to")).alias("name"), refused.alias("refused"))


def with_default(tables: Tables, defaults: DataFrame, names: tuple[str, ...] = ("documents", *CHILDREN)) -> Tables:
    """Rows without a base get their user's: defaults(user_id, default_kb) and the tables' user_id."""
    d = defaults.select(F.col("user_id").alias("_user"), "default_kb")
    fill = lambda df: df.join(d, F.col("user_id") == F.col("_user"), "left").withColumn("kb", F.coalesce("kb", "default_kb")).drop("_user", "default_kb")
    return {k: fill(v) if k in names and "user_id" in v.columns else v for k, v in tables.items()}


def publish_all(tables: Tables, path: str) -> int:
    """Write all tables as the next version: readers see it once its marker is there. Its number."""
    spark = next(iter(tables.values())).sparkSession
    n = (versions._versions(spark, path) or [-1])[-1] + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/v={n}/{name}")
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={n}/_SUCCESS")
    marker.getFileSystem(spark._jsc.hadoopConfiguration()).create(marker, True).close()
    return n


def read_all(spark: SparkSession, path: str) -> Tables:
    """The newest version's tables."""
    n = versions._versions(spark, path)[-1]
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={n}")
    found = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder) if f.isDirectory()]
    return {name: spark.read.parquet(f"{path}/v={n}/{name}") for name in sorted(found)}


# -- over the test tables ----------------------------------------------------------------------


def library(spark: SparkSession, d: str) -> Tables:
    """Customers as documents of their nation's base, orders as quizzes, lines as attempts, documents' ids as concepts, vectors, conversations as sessions; rows hang on the customer of equal id."""
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").cast("long").alias("kb"), F.col("c_name").alias("name"))
    home = docs.select("doc_id", "kb")
    child = lambda df, key: df.join(home, F.col(key) == F.col("doc_id"))
    return {
        "bases": table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("kb"), F.col("n_name").alias("name")),
        "documents": docs,
        "quizzes": child(table(spark, d, "orders", "o_orderkey", "o_custkey"), "o_custkey").select(F.col("o_orderkey").alias("quiz_id"), "doc_id", "kb"),
        "attempts": table(spark, d, "lineitem", "l_orderkey", "l_linenumber").select(F.col("l_orderkey").alias("quiz_id"), F.col("l_linenumber").alias("number")),
        "keypoints": child(table(spark, d, "documents", "doc_id").withColumnRenamed("doc_id", "point"), "point").select("point", "doc_id", "kb"),
        "vectors": child(table(spark, d, "embeddings", "vec_id"), "vec_id").select("vec_id", "doc_id", "kb"),
        "sessions": child(table(spark, d, "conversations", "conv_id").distinct(), "conv_id").select(F.col("conv_id").alias("session_id"), "doc_id", "kb"),
        "messages": table(spark, d, "conversations", "conv_id", "turn").select(F.col("conv_id").alias("session_id"), "turn"),
        GRAPH: home.select("kb", F.col("doc_id").alias("from_id"), (F.col("doc_id") + 1).alias("to_id")),
    }


_LIBRARY = """documents AS (SELECT c_custkey AS doc_id, c_nationkey AS kb, c_name AS name, c_mktsegment AS segment FROM customer),
quizzes AS (SELECT o_orderkey AS quiz_id, doc_id, kb FROM orders JOIN documents ON o_custkey = doc_id), attempts AS (SELECT l_orderkey AS quiz_id FROM lineitem),
keypoints AS (SELECT t.doc_id, kb FROM {docs} t JOIN documents d ON t.doc_id = d.doc_id), vectors AS (SELECT doc_id, kb FROM embeddings JOIN documents ON vec_id = doc_id),
sessions AS (SELECT DISTINCT conv_id AS session_id, doc_id, kb FROM conversations JOIN documents ON conv_id = doc_id), messages AS (SELECT conv_id AS session_id FROM conversations), edges AS (SELECT kb FROM documents)""".replace("{docs}", "(SELECT doc_id FROM main.documents)")


def counted(tables: Tables) -> DataFrame:
    """(name, rows) of tables."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def _counts_sql(conditions: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS rows FROM {name} WHERE {c}" for name, c in conditions.items())


_KEPT = "doc_id NOT IN (SELECT doc_id FROM documents WHERE segment = 'BUILDING')"
_HANGS = {"attempts": "quiz_id IN (SELECT quiz_id FROM quizzes WHERE {})", "messages": "session_id IN (SELECT session_id FROM sessions WHERE {})"}


@query(f"WITH {_LIBRARY} " + _counts_sql({"bases": "true"} | {k: _KEPT for k in ("documents", *CHILDREN)} | {k: v.format(_KEPT) for k, v in _HANGS.items()} | {GRAPH: "kb NOT IN (SELECT kb FROM documents WHERE segment = 'BUILDING')"}).replace("FROM bases", "FROM nation"))
def document_removal(spark: SparkSession, d: str) -> DataFrame:
    """What each table keeps when the documents of one segment go."""
    gone = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("doc_id"))
    return counted(documents_removed(library(spark, d), gone))


@query(f"""WITH {_LIBRARY}, moved AS (SELECT *, CASE WHEN segment = 'MACHINERY' THEN (kb + 1) % 25 ELSE kb END AS new FROM documents), touched AS (SELECT unnest([kb, new]) AS kb FROM moved WHERE kb <> new),
{", ".join(f"{t}_m AS (SELECT t.*, new FROM {t} t JOIN moved m ON t.doc_id = m.doc_id)" for t in CHILDREN)}
SELECT 'documents' AS name, new AS kb, count(*) AS rows FROM moved GROUP BY 2 {" ".join(f"UNION ALL SELECT '{t}', new, count(*) FROM {t}_m GROUP BY 2" for t in CHILDREN)}
UNION ALL SELECT 'edges', kb, count(*) FROM edges WHERE kb NOT IN (SELECT kb FROM touched) GROUP BY 2""")
def document_move(spark: SparkSession, d: str) -> DataFrame:
    """Rows by base after the documents of one segment moved to the next base."""
    c = table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'")
    moves = c.select(F.col("c_custkey").alias("doc_id"), ((F.col("c_nationkey") + 1) % 25).cast("long").alias("kb"), F.lit(None).cast("string").alias("name"))
    after, out = documents_moved(library(spark, d), moves), None
    for name in ("documents", *CHILDREN, GRAPH):
        one = after[name].groupBy("kb").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "kb", "rows")
        out = one if out is None else out.unionByName(one)
    return out


_OUTSIDE = "kb NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"


@query(f"WITH {_LIBRARY}, bases AS (SELECT n_nationkey AS kb FROM nation) " + _counts_sql({k: _OUTSIDE for k in ("bases", "documents", *CHILDREN, GRAPH)} | {k: v.format(_OUTSIDE) for k, v in _HANGS.items()}))
def base_removal(spark: SparkSession, d: str) -> DataFrame:
    """What each table keeps when the bases of one region go with all they hold."""
    asked = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("kb"))
    return counted(bases_removed(library(spark, d), asked, True)[0])


@query("SELECT n_nationkey AS kb, count(c_custkey) = 0 AS removed FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' AND c_acctbal > 9000 GROUP BY 1")
def base_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Bases that may go alone: those without documents (here of one segment and a large balance)."""
    t = library(spark, d)
    few = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING' AND c_acctbal > 9000").select(F.col("c_custkey").alias("doc_id"))
    t["documents"] = t["documents"].join(few, "doc_id", "left_semi")
    return bases_removed(t, t["bases"], False)[1]


