"""Merkle manifest of a table: leaves per row, a tree of 16 children a node per source, one root above the sources.

A parent is stored with its preimage, the concatenated digests of its children. Paths of preimages are joined from the
root down to the lowest parents, and every leaf joins the path of its own parent once: cutting a leaf's own 64 characters out of
a preimage leaves its siblings, putting a digest in their place and hashing folds the path towards the root.
Places in a tree come from one sort by ranges and counts per range, so a source may hold any share of the rows.

Defined edge cases: a null field is `-`, an empty text `0:`; rows with equal source and doc_id are ordered by their
leaves (null doc_ids first), so repeated rows are leaves of their own; a row without doc_id is never tampered with;
very long texts are hashed by one expression in place and never leave their row; further columns are neither hashed nor
returned; an empty table has no leaves and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discarded, written

#: Children of a node, and the bits of one step of a place.
FAN, STEP = 16, 4
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of the SQL that the tests and the driver compare with: 16^5 rows a source, 16^3 sources.
SQL_LEVELS, SQL_TOP_LEVELS = 5, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(f) for f in fields)), 256)


def placed(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """df with `_place` (from 0, in the order, within its tree) and `_many` (rows of the tree).

    One sort by ranges of (tree, order); the windows see one row per tree and range.
    """
    kept = written(df.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    kept = kept.withColumn("_range", F.shiftright("_at", 33))
    spans = kept.groupBy(F.col(tree).alias("_of"), F.col("_range").alias("_in")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy("_of")
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.withColumn("_before", before).withColumn("_many", F.sum("_rows").over(whole))
    both = kept.join(spans, F.col(tree).eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_in")))
    return both.withColumn("_place", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_of", "_in", "_first", "_rows", "_before")


def levels(nodes: DataFrame) -> list[DataFrame]:
    """Parents level by level, as tables (tree, _place, _many, digest, preimage): nodes are (tree, _place, _many, digest).

    A tree is done at the level where it has one node; each level is written, a sixteenth of the one below.
    """
    out, now = [], nodes
    while not now.filter("_many > 1").isEmpty():
        runs = now.filter("_many > 1").groupBy("tree", F.shiftright("_place", STEP).alias("_place"))
        parents = runs.agg(F.max("_many").alias("_many"), F.sort_array(F.collect_list(F.struct("_place", "digest"))).alias("run"))
        parents = parents.withColumn("_many", F.ceil(F.col("_many") / FAN)).withColumn("preimage", F.array_join(F.col("run.digest"), ""))
        now = written(parents.select("tree", "_place", "_many", F.sha2("preimage", 256).alias("digest"), "preimage"), "level")
        out.append(now)
    return out


def _step(place: Column, preimage: Column) -> Column:
    """One step of a path: where the child's digest begins in the parent's preimage (from 1), and the preimage."""
    return F.struct((place.bitwiseAND(FAN - 1) * DIGEST + 1).cast("int").alias("at"), preimage.alias("preimage"))


PATH = "array<struct<at:int,preimage:string>>"


def with_paths(nodes: DataFrame, parents: list[DataFrame], top: DataFrame | None) -> DataFrame:
    """nodes (tree, _place, _many, digest, ...) with `path`, the steps from a node's parent to the root, and the `tree_root` they pass.

    top has (tree, tree_root, above): the path of each tree's root (None: nothing is above). Paths go down a level at a time.
    """
    path = None
    for below in [*reversed(parents), nodes]:
        roots = below.filter("_many = 1")
        if top is None:
            roots = roots.withColumn("tree_root", F.col("digest")).withColumn("path", F.array().cast(PATH))
        else:
            roots = roots.join(top.withColumnRenamed("tree", "_tree"), F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree").withColumnRenamed("above", "path")
        if path is None:
            now = roots
        else:
            up = path.select(F.col("tree").alias("_tree"), F.col("_place").alias("_up"), F.col("preimage").alias("_preimage"), F.col("tree_root"), F.col("path").alias("_above"))
            inner = below.filter("_many > 1").join(up, F.col("tree").eqNullSafe(F.col("_tree")) & (F.shiftright("_place", STEP) == F.col("_up")))
            inner = inner.withColumn("path", F.concat(F.array(_step(F.col("_place"), F.col("_preimage"))), "_above"))
            now = inner.drop("_tree", "_up", "_preimage", "_above").unionByName(roots)
        path = now
    return path


def siblings(path: Column) -> Column:
    """The digests beside a node's own and its ancestors', level by level: every preimage without the own 64 characters."""
    rest = lambda s: F.concat(F.substring(s["preimage"], F.lit(1), s["at"] - 1), F.substring(s["preimage"], s["at"] + DIGEST, F.length(s["preimage"])))
    return F.array_join(F.transform(path, rest), "")


def folded(path: Column, digest: Column) -> Column:
    """The root that a digest leads to along a path: put in its place in each preimage, hashed."""
    return F.aggregate(path, digest, lambda acc, s: F.sha2(F.overlay(s["preimage"], acc, s["at"], F.lit(DIGEST)), 256))


def manifest(leaves: DataFrame) -> DataFrame:
    """(tree, key, leaf, altered) with `subroot`, `root` and `path`: trees in the order of their names (null first), leaves by key, then leaf."""
    sorted_leaves = placed(leaves, "tree", ["key", "leaf"]).withColumn("digest", F.col("leaf"))
    parents = levels(sorted_leaves.select("tree", "_place", "_many", "digest"))
    lone = [x.filter("_many = 1").select("tree", "digest") for x in [sorted_leaves, *parents]]
    subroots = lone[0]
    for x in lone[1:]:
        subroots = subroots.unionByName(x)
    tops = placed(subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), "digest"), "tree", ["name"])
    above = levels(tops.select("tree", "_place", "_many", "digest"))
    root = (above[-1] if above else tops).select("digest").first()
    up = with_paths(tops, above, None).select(F.col("name").alias("tree"), F.col("digest").alias("tree_root"), F.col("path").alias("above"))
    out = with_paths(sorted_leaves, parents, written(up, "tops"))
    return out.withColumnRenamed("tree_root", "subroot").withColumn("root", F.lit(root and root["digest"]).cast("string"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    fields = [F.col(f) for f in FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    altered = F.when(tampered, leaf([*fields[:-1], F.translate("text", UPPER, LOWER)]))
    hashed = written(docs.select(F.col("source").alias("tree"), F.col("doc_id").alias("key"), leaf(fields).alias("leaf"), altered.alias("altered")), "leaves")
    out = manifest(hashed)
    discarded(hashed)
    folding = folded(F.col("path"), F.coalesce("altered", "leaf"))
    out = out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folding.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_tree(name: str, first: str, depth: int) -> str:
    """CTEs name1..: each level of 16 children from the one before; a tree of one node stays as it is, without a preimage."""
    out, before = [], first
    for k in range(1, depth + 1):
        run = "string_agg(d, '' ORDER BY place)"
        out.append(f"{name}{k} AS (SELECT tree, place // {FAN} AS place, (max(many) + {FAN - 1}) // {FAN} AS many, CASE WHEN max(many) = 1 THEN min(d) ELSE sha256({run}) END AS d, CASE WHEN max(many) > 1 THEN {run} END AS p FROM {before} GROUP BY ALL)")
        before = f"{name}{k}"
    return ",\n".join(out)


def _sql_fold() -> str:
    """CTEs that follow every leaf through both trees: proof so far, digest so far."""
    out, before = [], "start"
    steps = [(f"t{k}", "tree", "place", k) for k in range(1, SQL_LEVELS + 1)] + [(f"s{k}", "0", "top_place", k) for k in range(1, SQL_TOP_LEVELS + 1)]
    for i, (table, tree, place, k) in enumerate(steps):
        at = f"((f.{place} // {FAN ** (k - 1)}) % {FAN}) * {DIGEST}"
        join = f"x.tree IS NOT DISTINCT FROM {'f.tree' if tree == 'tree' else tree} AND x.place = f.{place} // {FAN**k}"
        rest = f"substr(x.p, 1, {at}) || substr(x.p, {at} + {DIGEST + 1})"
        fold = f"sha256(substr(x.p, 1, {at}) || f.now || substr(x.p, {at} + {DIGEST + 1}))"
        out.append(f"f{i} AS (SELECT f.* REPLACE (CASE WHEN x.p IS NULL THEN f.proof ELSE f.proof || {rest} END AS proof, CASE WHEN x.p IS NULL THEN f.now ELSE {fold} END AS now) FROM {before} f JOIN {table} x ON {join})")
        before = f"f{i}"
    return ",\n".join(out)


def oracle() -> str:
    """The same manifest in DuckDB SQL, level by level; CRC-32 by its table, built from the polynomial."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    hashed = lambda text: "sha256(" + " || ".join([*(value(c) for c in FIELDS[:-1]), value(text)]) + ")"
    byte = "list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"
    return f"""
WITH crcs AS (SELECT list_transform(range(256), lambda i: {byte}) AS t),
d AS (SELECT source AS tree, doc_id, {hashed("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {hashed(f"translate(text, '{UPPER}', '{LOWER}')")} END AS altered FROM documents CROSS JOIN crcs),
t0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS many, leaf AS d FROM d),
{_sql_tree("t", "t0", SQL_LEVELS)},
s0 AS (SELECT 0 AS tree, tree AS name, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, count(*) OVER () AS many, d FROM t{SQL_LEVELS}),
{_sql_tree("s", "s0", SQL_TOP_LEVELS)},
start AS (SELECT t0.doc_id, t0.leaf, t0.tree, t0.place, s0.place AS top_place, s0.d AS subroot, (SELECT d FROM s{SQL_TOP_LEVELS}) AS root, '' AS proof, coalesce(altered, leaf) AS now FROM t0 JOIN s0 ON s0.name IS NOT DISTINCT FROM t0.tree),
{_sql_fold()}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, now AS folded_root, now = root AS verified FROM f{SQL_LEVELS + SQL_TOP_LEVELS - 1}
"""
