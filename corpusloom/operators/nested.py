"""Nested documents: lenient JSON, deep merge, pruning, forbidden keys, typed overrides, sources of messages.

What parses is handled by Spark's own JSON and VARIANT functions. Python sees only what they cannot express: texts that
are JSON in Python's notation, and merges of objects whose keys are not known beforehand, row by row in Arrow batches. The
test tables hold no such documents: each query writes them from columns first.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.plans.catalogue import Catalogue
from corpusloom.sources.tables import table

catalogue = Catalogue()
query = catalogue.query
QUERIES, ORACLES = catalogue.queries, catalogue.oracles

# Words for yes and no in overrides; fields that sources of messages no longer have.
YES, NO = ["1", "true", "yes", "on"], ["0", "false", "no", "off"]
DROPPED = ["asset_path", "caption", "bbox", "modality", "block_id"]
PRESETS = {"fast": (3, 8), "balanced": (4, 12), "deep": (6, 20)}
MODES = ["normal", "explain"]


# -- lenient JSON ------------------------------------------------------------------------------


def json_block(text: Column) -> Column:
    """From the first bracket to the last of a text: of an array, else of an object; else null."""
    found = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
    return F.coalesce(found(r"(?s)\[.*\]"), found(r"(?s)\{.*\}"))


@F.pandas_udf(StringType())
def _literal(text: pd.Series) -> pd.Series:
    """Python literals as JSON; null for what is none."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(ast.literal_eval(x), ensure_ascii=False)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return text.map(one)


def lenient(text: Column) -> Column:
    """The JSON that a text is, or has a block of, or writes in Python's notation; else null. Only the last kind leaves the JVM."""
    ok = lambda x: F.try_parse_json(x).isNotNull()
    block = json_block(text)
    rest = F.when(~F.coalesce(ok(text), F.lit(False)) & ~F.coalesce(ok(block), F.lit(False)), block)
    return F.coalesce(F.when(ok(text), text), F.when(ok(block), block), _literal(rest))


_FORM = "(conv_id + turn) % 5"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Messages as a model would answer with them: JSON, JSON among words, a list, Python's notation, cut off."""
    m = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    whole = F.to_json(F.struct("role", "turn", F.col("text").alias("text")))
    short = F.concat(F.lit("{'role': '"), F.coalesce("role", F.lit("")), F.lit("', 'turn': "), F.col("turn").cast("string"), F.lit(", 'text': None}"))
    form = (F.col("conv_id") + F.col("turn")) % 5
    said = F.when(form == 0, whole).when(form == 1, F.concat(F.lit("Here you are:\n"), whole, F.lit("\nDone."))).when(form == 2, F.concat(F.lit("```["), whole, F.lit("]```"))).when(form == 3, short).otherwise(F.substring(whole, 1, 12))
    return m.select("conv_id", "turn", said.alias("said"))


@query(f"""SELECT conv_id, turn, CASE WHEN {_FORM} < 4 THEN coalesce(role, CASE WHEN {_FORM} = 3 THEN '' END) END AS role, CASE WHEN {_FORM} < 4 THEN 2 * turn END AS twice, CASE WHEN {_FORM} < 3 THEN length(text) END AS n FROM conversations""")
def lenient_json(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the answers that can be read: an object, or the first of a list."""
    v = F.try_parse_json(lenient(F.col("said")))
    field = lambda name, kind: F.coalesce(F.try_variant_get(v, f"$.{name}", kind), F.try_variant_get(v, f"$[0].{name}", kind))
    read = _answers(spark, d).select("conv_id", "turn", field("role", "string").alias("role"), field("turn", "bigint").alias("t"), field("text", "string").alias("text"))
    return read.select("conv_id", "turn", "role", (2 * F.col("t")).alias("twice"), F.char_length("text").alias("n"))


# -- merging and pruning -----------------------------------------------------------------------


def _merged(base: dict, patch: dict) -> dict:
    out = dict(base)
    for key, value in patch.items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = _merged(out[key], value) if both else value
    return out


def _pruned(value: dict) -> dict:
    inner = {k: _pruned(v) if isinstance(v, dict) else v for k, v in value.items()}
    return {k: v for k, v in inner.items() if v != {} or not isinstance(value[k], dict)}


def _object(text: str | None) -> dict:
    """A JSON object; what is none counts as the empty one."""
    try:
        value = json.loads(text) if text else {}
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


@F.pandas_udf(StringType())
def deep_merge(base: pd.Series, patch: pd.Series) -> pd.Series:
    """JSON objects merged key by key, the second over the first, nested objects alike."""
    return pd.Series([json.dumps(_merged(_object(a), _object(b)), ensure_ascii=False) for a, b in zip(base, patch, strict=True)])


@F.pandas_udf(StringType())
def override_merge(base: pd.Series, patch: pd.Series) -> pd.Series:
    """JSON objects merged key by key on the first level only; null in the second takes a key away."""
    return pd.Series([json.dumps({k: v for k, v in (_object(a) | _object(b)).items() if v is not None or k not in _object(b)}, ensure_ascii=False) for a, b in zip(base, patch, strict=True)])


@F.pandas_udf(StringType())
def prune_empty(value: pd.Series) -> pd.Series:
    """A JSON object without empty objects in it, and without those that become empty by that."""
    return value.map(lambda x: None if x is None else json.dumps(_pruned(_object(x)), ensure_ascii=False))


def allowed(value: Column, schema: str) -> Column:
    """A JSON object without the keys that a schema does not have, on any level, and without nulls."""
    return F.to_json(F.from_json(value, schema))


SETTINGS = "qa struct<retrieval_preset: string, top_k: int, fetch_k: int, mode: string>, quiz struct<count: int, difficulty: string>"
DEFAULTS = '{"qa": {"retrieval_preset": "balanced", "mode": "normal"}, "quiz": {"count": 5, "difficulty": "medium"}}'


def effective(user: Column, base: Column) -> Column:
    """Settings as a struct: defaults under a learner's under a base's, forbidden keys and empty objects left out; a preset fills what is unset."""
    tidy = lambda x: prune_empty(allowed(x, SETTINGS))
    return F.from_json(deep_merge(deep_merge(F.lit(DEFAULTS), tidy(user)), tidy(base)), SETTINGS)


def _settings(spark: SparkSession, d: str) -> DataFrame:
    """Customers' settings as JSON, some with keys that are no longer allowed, and those of their nations."""
    i, n = F.col("c_custkey"), F.col("c_nationkey")
    user = F.struct(
        F.struct(F.when(i % 3 == 0, "fast").alias("retrieval_preset"), F.when(i % 5 == 0, 7).alias("top_k"), F.when(i % 4 == 0, "shout").alias("mode"), F.when(i % 2 == 0, 1).alias("legacy")).alias("qa"),
        F.struct(F.when(i % 7 == 0, i % 9).alias("count")).alias("quiz"),
        F.when(i % 2 == 1, "x").alias("theme"),
    )
    base = F.struct(F.struct(F.when(n % 4 == 0, " DEEP ").alias("retrieval_preset"), F.when(n % 3 == 0, 15).alias("fetch_k")).alias("qa"), F.struct(F.when(n % 2 == 0, "hard").alias("difficulty")).alias("quiz"))
    return table(spark, d, "customer", "c_custkey", "c_nationkey").select(i.alias("user_id"), F.to_json(user).alias("user"), F.when(n % 5 == 1, "not json").otherwise(F.to_json(base)).alias("base"))


@query("""WITH s AS (SELECT c_custkey AS user_id, lower(trim(CASE WHEN c_nationkey % 4 = 0 AND c_nationkey % 5 <> 1 THEN ' DEEP ' WHEN c_custkey % 3 = 0 THEN 'fast' ELSE 'balanced' END)) AS preset, c_custkey, c_nationkey FROM customer)
SELECT user_id, preset, CASE WHEN c_custkey % 5 = 0 THEN 7 WHEN preset = 'fast' THEN 3 WHEN preset = 'deep' THEN 6 ELSE 4 END AS top_k, CASE WHEN c_nationkey % 3 = 0 AND c_nationkey % 5 <> 1 THEN 15 WHEN preset = 'fast' THEN 8 WHEN preset = 'deep' THEN 20 ELSE 12 END AS fetch_k,
'normal' AS mode, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 9 ELSE 5 END AS questions, CASE WHEN c_nationkey % 2 = 0 AND c_nationkey % 5 <> 1 THEN 'hard' ELSE 'medium' END AS difficulty FROM s""")
def settings_merge(spark: SparkSession, d: str) -> DataFrame:
    """Effective settings of every learner in a base."""
    s = _settings(spark, d).select("user_id", effective(F.col("user"), F.col("base")).alias("s"))
    preset = F.lower(F.trim(F.coalesce("s.qa.retrieval_preset", F.lit("balanced"))))
    by = lambda at: F.when(preset == "fast", PRESETS["fast"][at]).when(preset == "deep", PRESETS["deep"][at]).otherwise(PRESETS["balanced"][at])
    mode = F.when(F.col("s.qa.mode").isin(MODES), F.col("s.qa.mode")).otherwise(MODES[0])
    return s.select("user_id", preset.alias("preset"), F.coalesce("s.qa.top_k", by(0)).alias("top_k"), F.coalesce("s.qa.fetch_k", by(1)).alias("fetch_k"), mode.alias("mode"), F.col("s.quiz.count").alias("questions"), F.col("s.quiz.difficulty").alias("difficulty"))


# -- typed overrides ---------------------------------------------------------------------------


def coerced(value: Column, kind: str) -> Column:
    """A VARIANT as boolean, bigint, double or string; null where that is not allowed. Booleans are no numbers; numbers written without a point are booleans."""
    what, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    is_bool = what == "BOOLEAN"
    if kind == "boolean":
        word = F.lower(F.trim(text))
        number = F.when(what == "BIGINT", F.try_variant_get(value, "$", "bigint") != 0)
        return F.when(is_bool, F.try_variant_get(value, "$", "boolean")).when(what == "STRING", F.when(word.isin(YES), True).when(word.isin(NO), False)).otherwise(number)
    if kind == "bigint":
        whole = F.try_variant_get(value, "$", "double").cast("bigint")
        return F.when(is_bool, None).when(what == "STRING", F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("bigint"))).otherwise(whole)
    if kind == "double":
        return F.when(is_bool, None).otherwise(text.try_cast("double"))
    return F.when(what != "VOID", text)


@query("""WITH e AS (SELECT event_id, event_type, value, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), f AS (SELECT *, event_id % 6 AS form FROM e)
SELECT event_id, CASE form WHEN 0 THEN k > 50 WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN CASE k WHEN 1 THEN true WHEN 0 THEN false END WHEN 4 THEN k <> 0 END AS as_bool, CASE form WHEN 3 THEN k WHEN 4 THEN k WHEN 5 THEN trunc(value)::BIGINT END AS as_int,
round(CASE form WHEN 3 THEN k WHEN 4 THEN k WHEN 5 THEN value END::DOUBLE, 6) AS as_double FROM f""")
def override_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of overrides in several notations (booleans, words, numbers as texts, numbers), read by type."""
    e = table(spark, d, "events", "event_id", "value", "props").withColumn("k", F.expr("try_cast(get_json_object(props, '$.k') AS bigint)"))
    form = F.col("event_id") % 6
    text = F.when(form == 0, F.when(F.col("k") > 50, "true").otherwise("false")).when(form == 1, '" YES "').when(form == 2, '"off"').when(form == 3, F.concat(F.lit('" '), F.col("k").cast("string"), F.lit('"'))).when(form == 4, F.col("k").cast("string")).otherwise(F.col("value").cast("string"))
    v = e.select("event_id", F.try_parse_json(text).alias("v"))
    return v.select("event_id", coerced(F.col("v"), "boolean").alias("as_bool"), coerced(F.col("v"), "bigint").alias("as_int"), F.round(coerced(F.col("v"), "double"), 6).alias("as_double"))


@query("""SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 9 ELSE c_nationkey END AS top_k, CASE WHEN c_custkey % 3 = 0 THEN 'dense' ELSE 'hybrid' END AS mode FROM customer""")
def override_patches(spark: SparkSession, d: str) -> DataFrame:
    """Kept overrides with a change over them: null takes a key away, what is not named stays."""
    i = F.col("c_custkey")
    kept = F.to_json(F.struct(F.col("c_nationkey").alias("top_k"), F.lit("hybrid").alias("mode")))
    change = F.when(i % 4 == 0, '{"top_k": null}').when(i % 4 == 1, '{"top_k": 9}').otherwise("{}")
    mode = F.when(i % 3 == 0, '{"mode": "dense"}').otherwise("[]")
    m = table(spark, d, "customer", "c_custkey", "c_nationkey").select(i.alias("user_id"), F.from_json(override_merge(override_merge(kept, change), mode), "top_k int, mode string").alias("m"))
    return m.select("user_id", "m.top_k", "m.mode")


# -- sources of messages -----------------------------------------------------------------------

SOURCE = "struct<source: string, snippet: string, doc_id: string, kb_id: string, page: bigint, chunk: bigint>"


def parsed_sources(text: Column) -> Column:
    """A message's sources: the objects of a JSON list whose fields have their types (numbers may be written as texts); null where there is none."""
    items = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")

    def one(v: Column) -> Column:
        at = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
        kind = lambda name: F.coalesce(F.schema_of_variant(at(name)), F.lit("VOID"))
        word = lambda name, missing: F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(missing).cast("string"))
        number = lambda name: F.when(kind(name).isin("BIGINT", "STRING"), F.trim(F.try_variant_get(v, f"$.{name}", "string")).try_cast("bigint"))
        absent = lambda name: at(name).isNull()
        texts = [kind("source") == "STRING", kind("snippet") == "STRING"]
        known = (texts[0] | absent("source")) & (texts[1] | absent("snippet"))
        for name in ("doc_id", "kb_id"):
            known = known & kind(name).isin("STRING", "VOID")
        for name in ("page", "chunk"):
            known = known & ((kind(name) == "VOID") | number(name).isNotNull())
        fields = [word("source", "").alias("source"), word("snippet", "").alias("snippet"), word("doc_id", None).alias("doc_id"), word("kb_id", None).alias("kb_id"), number("page").alias("page"), number("chunk").alias("chunk")]
        return F.when(F.schema_of_variant(v).startswith("OBJECT") & known, F.struct(*fields))

    found = F.filter(F.transform(items, one), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found)


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """Messages with their sources as JSON: the message before each answer, beside entries that are no sources; some are no list."""
    m = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    page = F.when(F.col("turn") % 4 == 3, F.concat(F.lit('"'), F.col("turn").cast("string"), F.lit('"'))).otherwise(F.col("turn").cast("string"))
    good = F.concat(F.lit('{"source": "conversation", "snippet": '), F.to_json(F.array(F.substring(before, 1, 60))).substr(F.lit(2), F.length(F.to_json(F.array(F.substring(before, 1, 60)))) - 2), F.lit(', "doc_id": "'), F.col("conv_id").cast("string"), F.lit('", "page": '), page, F.lit(', "caption": "c", "bbox": [1, 2]}'))
    listed = F.concat(F.lit("["), good, F.lit(', 5, "x", {"source": "s", "page": "p. 1"}, {"source": null}]'))
    sources = F.when(F.col("conv_id") % 6 == 0, good).when(F.col("conv_id") % 6 == 1, F.substring(listed, 1, 30)).otherwise(listed)
    return m.select("conv_id", "turn", "role", before.alias("before"), sources.alias("sources"))


@query("""SELECT conv_id, turn, CASE WHEN ok THEN 1 ELSE 0 END AS n, CASE WHEN ok THEN turn END AS page, CASE WHEN ok THEN md5(substring(before, 1, 60)) END AS snippet_md5
FROM (SELECT *, role = 'assistant' AND before IS NOT NULL AND conv_id % 6 > 1 AS ok FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations))""")
def message_sources(spark: SparkSession, d: str) -> DataFrame:
    """Messages with the sources of answers, parsed leniently; questions have none."""
    s = F.when(F.col("role") == "assistant", parsed_sources(F.col("sources")))
    m = _cited(spark, d).select("conv_id", "turn", s.alias("s"))
    first = F.get("s", F.lit(0))
    return m.select("conv_id", "turn", F.coalesce(F.size("s"), F.lit(0)).alias("n"), first["page"].alias("page"), F.md5(first["snippet"].cast("binary")).alias("snippet_md5")).withColumn("n", F.when(F.col("n") < 0, 0).otherwise(F.col("n")))


def pruned_items(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """df with `pruned`, a JSON list without some fields of its objects (or of those under "questions"), null where nothing goes, and `removed`, how many went."""
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", pruned string, removed int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x in pdf[column]:
                try:
                    value = json.loads(x) if x else None
                except ValueError:
                    value = None
                items = value.get("questions") if isinstance(value, dict) else value
                gone = sum(item.pop(f, gone_) is not gone_ for gone_ in [object()] for item in (items if isinstance(items, list) else []) if isinstance(item, dict) for f in fields)
                out.append((json.dumps(value, ensure_ascii=False) if gone else None, gone))
            yield pdf[names].assign(pruned=[o[0] for o in out], removed=[o[1] for o in out])

    return df.mapInPandas(run, schema)


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 6 > 1 THEN 2 ELSE 0 END AS removed, CASE WHEN conv_id % 6 > 1 THEN 5 END AS items FROM conversations""")
def pruned_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources without the fields of pictures: how many fields went, how many items are left."""
    p = pruned_items(_cited(spark, d).select("conv_id", "turn", "sources"), "sources", DROPPED)
    return p.select("conv_id", "turn", "removed", F.json_array_length("pruned").alias("items"))
