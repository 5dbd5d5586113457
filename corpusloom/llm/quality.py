"""Quality rules by weak supervision, in DataFrame functions only.

Each rule looks at one statistic of a text and votes good (+1), bad (-1) or abstains (0).
Expectation-maximisation over the counts of vote patterns (at most 3^rules rows, however large the
corpus) estimates every rule's accuracy and the share of good documents without labels; a document
stays if its posterior probability of being good reaches the threshold.

Defined edge cases: a null text counts as empty; a text without words gets n_words 0 and is rejected;
repeated rows and equal doc_ids are judged row by row; further columns of the input pass through
`quality_filter` untouched; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, SPACES, clean_text, written

MIN_WORDS, MAX_REPEAT_PERCENT, THRESHOLD, ROUNDS = 50, 50, 0.5, 12
#: Prior belief in a rule, as so many votes on good and on bad documents with the given accuracies; it keeps EM from swapping the classes.
PRIOR_ON_GOOD, PRIOR_ON_BAD, PRIOR_VOTES, PRIOR_GOOD = 0.99, 0.4, 50.0, 0.8


@dataclass(frozen=True)
class Rule:
    """Votes bad where `bad` holds, else good where `good` holds, else abstains (SQL over the statistics)."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 50", "n_words >= 100"),
    Rule("word_length", "10 * word_chars < 25 * n_words OR word_chars > 12 * n_words", "word_chars >= 3 * n_words AND word_chars <= 9 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols < n_words"),
    Rule("dup_lines", "n_dup_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines", "n_lines >= 2 AND 10 * n_dup_lines < n_lines"),
    Rule("repeats", "10 * n_repeat_words > 3 * n_words", "20 * n_repeat_words < 3 * n_words"),
    Rule("capitals", "10 * n_capitals > 3 * word_chars", "10 * n_capitals < word_chars"),
    Rule("exclamations", "5 * n_exclamations > n_words", "50 * n_exclamations < n_words"),
    Rule("marks", "3 * n_marks > n_words", "10 * n_marks < n_words"),
    Rule("line_ends", "n_words > 0 AND 10 * n_ended_lines < n_lines", "2 * n_ended_lines >= n_lines AND n_lines > 0"),
    Rule("line_words", "n_words < 2 * n_lines", "n_words >= 5 * n_lines AND n_lines > 0"),
)

#: Characters rare in running prose.
MARKS = "!#$%&()*+/<=>?@[]^_{|}~"
BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def with_statistics(docs: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """Add the statistics the rules read, as columns named prefix + name; no shuffle."""
    p = prefix
    t = clean_text(docs, text)
    trimmed = F.btrim(t, F.lit(SPACES))
    df = docs.withColumn(f"{p}words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)))
    df = df.withColumn(f"{p}lines", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    words, lines = F.col(f"{p}words"), F.col(f"{p}lines")
    n = F.size(words)
    # three-word windows as (hash, place), sorted so that equal windows are neighbours
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    df = df.withColumn(f"{p}n_words", n.cast("long")).withColumn(f"{p}h", hashed)
    h = F.col(f"{p}h")
    triples = F.zip_with(F.zip_with(h, F.slice(h, 2, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b)), F.slice(h, 3, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn(f"{p}h3", F.slice(triples, 1, F.greatest(n - 2, F.lit(0))))
    h3 = F.col(f"{p}h3")
    placed = F.sort_array(F.transform(h3, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn(f"{p}placed", F.when(F.size(F.array_distinct(h3)) < F.size(h3), placed))
    placed = F.col(f"{p}placed")
    same = F.zip_with(placed, F.slice(placed, 2, F.size(placed)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn(f"{p}at", F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))
    at = F.col(f"{p}at")
    # a repeated window at i covers words i to i + 2; overlapping windows count each word once
    covered = F.aggregate(F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x)
    ended = F.filter(lines, lambda x: F.rtrim(x).rlike(r"[.!?:;\"”»]\s*$"))
    stats = {
        "word_chars": F.char_length(F.array_join(words, "")),
        "n_symbols": _without(t, "#*$%&|<>"),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(F.when(F.size(placed) > 0, covered), F.lit(0)),
        "n_capitals": _without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_exclamations": _without(t, "!"),
        "n_marks": _without(t, MARKS),
        "n_ended_lines": F.size(ended),
    }
    df = df.withColumns({p + k: v.cast("long") for k, v in stats.items()})
    return df.drop(*(p + k for k in ("words", "lines", "h", "h3", "placed", "at")))


def _statistic_names() -> list[str]:
    return ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclamations", "n_marks", "n_ended_lines"]


def with_votes(df: DataFrame, rules: tuple[Rule, ...] = RULES, prefix: str = "_q_") -> DataFrame:
    """Add one tinyint column per rule, prefix + "v" + number, holding -1, 0 or +1."""
    names = _statistic_names()

    def sql(condition: str) -> Column:
        for name in sorted(names, key=len, reverse=True):
            condition = condition.replace(name, f"`{prefix}\0{names.index(name)}`")
        for i, name in enumerate(names):
            condition = condition.replace(f"\0{i}`", f"{name}`")
        return F.expr(condition)

    vote = lambda r: F.when(sql(r.bad), -1).when(sql(r.good), 1).otherwise(0).cast("tinyint")
    return df.withColumns({f"{prefix}v{j}": vote(r) for j, r in enumerate(rules)})


@dataclass(frozen=True)
class Model:
    """What EM found: the share of good documents and, for each rule that votes, its accuracy on good and on bad ones."""

    good: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def posterior(self, votes: list[Column]) -> Column:
        logit = F.lit(math.log(self.good / (1 - self.good)))
        for a, b, v in zip(self.on_good, self.on_bad, votes, strict=True):
            logit = logit + F.when(v > 0, math.log(a / (1 - b))).when(v < 0, math.log((1 - a) / b)).otherwise(0.0)
        return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)), 9)


def fit(votes: DataFrame, columns: list[str], rounds: int = ROUNDS) -> Model:
    """EM over the distinct vote patterns of all rows; only sums over patterns reach the driver."""
    patterns = written(votes.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")), "vote-patterns")
    model = Model(PRIOR_GOOD, (PRIOR_ON_GOOD,) * len(columns), (PRIOR_ON_BAD,) * len(columns))
    n = F.col("n").cast("double")
    share = lambda right, votes, prior: min(0.999, max(0.001, ((right or 0) + prior * PRIOR_VOTES) / ((votes or 0) + PRIOR_VOTES)))
    for _ in range(rounds):
        q = model.posterior([F.col(c) for c in columns])
        total = lambda when, x, name: F.sum(F.when(when, n * x).otherwise(0.0)).alias(name)
        sums = [F.sum(n * F.col("q")).alias("good"), F.sum(n).alias("n")]
        for c in columns:
            v, good = F.col(c), F.col("q")
            sums += [total(v > 0, good, f"gg_{c}"), total(v != 0, good, f"g_{c}"), total(v < 0, 1 - good, f"bb_{c}"), total(v != 0, 1 - good, f"b_{c}")]
        s = patterns.withColumn("q", q).agg(*sums).first()
        model = Model(share(s["good"], s["n"], PRIOR_GOOD), tuple(share(s[f"gg_{c}"], s[f"g_{c}"], PRIOR_ON_GOOD) for c in columns), tuple(share(s[f"bb_{c}"], s[f"b_{c}"], PRIOR_ON_BAD) for c in columns))
    return model


def judged(docs: DataFrame, text: str = "text", prefix: str = "_q_", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with statistics, base_failed, posterior and kept as prefixed columns.

    The statistics are computed once and written to the shared folder, since EM reads all of them first.
    """
    df = with_votes(with_statistics(docs, text, prefix), prefix=prefix)
    columns = [f"{prefix}v{j}" for j in range(len(RULES))]
    if keep is not None:
        df = df.select(*keep, *(c for c in df.columns if c.startswith(prefix)))
    df = written(df, "quality")
    model = fit(df.select(*columns), columns)
    n, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
    df = df.withColumn(f"{prefix}base_failed", failed).withColumn(f"{prefix}posterior", model.posterior([F.col(c) for c in columns]))
    return df.withColumn(f"{prefix}kept", ~failed & (F.col(f"{prefix}posterior") >= threshold))


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that pass the base rules and whose posterior reaches the threshold."""
    prefix = "_q_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return judged(docs, text, prefix).filter(F.col(f"{prefix}kept")).select(*(f"`{c}`" for c in docs.columns))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = judged(docs, keep=["doc_id"])
    return out.select("doc_id", *(F.col(f"_q_{c}").alias(c) for c in [*BASE_COLUMNS, "base_failed", "kept", "posterior"]))


def _posterior_sql() -> str:
    logit = " + ".join(["ln(m.good / (1 - m.good))", *(f"CASE WHEN v{j} > 0 THEN ln(m.a{j} / (1 - m.b{j})) WHEN v{j} < 0 THEN ln((1 - m.a{j}) / m.b{j}) ELSE 0 END" for j in range(len(RULES)))])
    return f"round(1 / (1 + exp(-({logit}))), 9)"


def oracle() -> str:
    """The same statistics, votes and EM rounds in DuckDB SQL."""
    k = range(len(RULES))
    votes = ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS v{j}" for j, r in enumerate(RULES))
    names = ", ".join(f"v{j}" for j in k)
    final = _posterior_sql()
    rounds = [f"m0 AS (SELECT {PRIOR_GOOD}::DOUBLE AS good, " + ", ".join(f"{PRIOR_ON_GOOD}::DOUBLE AS a{j}, {PRIOR_ON_BAD}::DOUBLE AS b{j}" for j in k) + ")"]
    share = lambda right, votes, prior: f"least(0.999, greatest(0.001, (coalesce(sum({right}), 0) + {prior * PRIOR_VOTES}) / (coalesce(sum({votes}), 0) + {PRIOR_VOTES})))"
    for i in range(ROUNDS):
        acc = ", ".join(f"{share(f'CASE WHEN v{j} > 0 THEN n * q ELSE 0 END', f'CASE WHEN v{j} <> 0 THEN n * q ELSE 0 END', PRIOR_ON_GOOD)} AS a{j}, {share(f'CASE WHEN v{j} < 0 THEN n * (1 - q) ELSE 0 END', f'CASE WHEN v{j} <> 0 THEN n * (1 - q) ELSE 0 END', PRIOR_ON_BAD)} AS b{j}" for j in k)
        rounds.append(f"m{i + 1} AS (SELECT {share('n * q', 'n', PRIOR_GOOD)} AS good, {acc} FROM (SELECT p.*, {final} AS q FROM patterns p, m{i} m))")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, struct_pack(a := words[i], b := words[i + 1], c := words[i + 2]) AS x
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM
  (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
s AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::BIGINT AS n_capitals,
  (length(t) - length(translate(t, '!', '')))::BIGINT AS n_exclamations,
  (length(t) - length(translate(t, '{MARKS}', '')))::BIGINT AS n_marks,
  len(list_filter(lines, lambda x: regexp_matches(x, '[.!?:;"”»]\s*$')))::BIGINT AS n_ended_lines
  FROM w LEFT JOIN r USING (doc_id)),
v AS (SELECT *, {votes} FROM s),
patterns AS (SELECT {names}, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
{", ".join(rounds)}
SELECT doc_id, {", ".join(BASE_COLUMNS)}, failed AS base_failed, NOT failed AND posterior >= {THRESHOLD} AS kept, posterior
FROM (SELECT v.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS failed, {final} AS posterior FROM v, m{ROUNDS} m)
"""
