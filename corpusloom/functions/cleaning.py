"""Text cleaning and fragment quality as JVM expressions: regular expressions and array functions, no row-wise Python.

Only Unicode NFKC needs Python (`lexical.nfkc`, Arrow batches); callers put it first where they want it.
Line predicates are written once as SQL text for either engine, so Spark and DuckDB can be compared.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin terms that are never noise, punctuation of Chinese text, thresholds by mode.
SAFE_TERMS = "ai api app cpu css dna html http https id ip js json pdf ppt pptx python sdk sql tcp txt ui url utf wifi xml".split()
PUNCTUATION = {",": "，", ".": "。", ";": "；", ":": "：", "!": "！", "?": "？"}
LOW_SCORE = {"balanced": 0.18, "conservative": 0.12, "aggressive": 0.24, "structure_preserving": 0.20}
SHIFT = {"conservative": 0.05, "aggressive": -0.05}
MANY_PAIRS, PAIR_SHARE = 6, 0.35

_CJK = "一-鿿"
_PAIR = f"([{_CJK}])([A-Za-z]{{1,8}})"
_SAFE = rf"\b((?i:{'|'.join(sorted(SAFE_TERMS, key=len, reverse=True))})|[A-Z]{{1,6}}|WiFi|iOS|macOS|OpenAI)\b"


class Dialect:
    """The few functions whose names differ between the engines."""

    def __init__(self, spark: bool):
        self.spark = spark

    def match(self, x: str, pattern: str) -> str:
        p = pattern.replace("'", "''")
        return f"regexp_like({x}, r\"{pattern}\")" if self.spark else f"regexp_matches({x}, '{p}')"

    def replace(self, x: str, pattern: str, new: str) -> str:
        p = pattern.replace("'", "''")
        return f"regexp_replace({x}, r\"{pattern}\", '{new}')" if self.spark else f"regexp_replace({x}, '{p}', '{new}', 'g')"


SPARK, DUCKDB = Dialect(True), Dialect(False)


def noise_line(line: str, near: str, single: str, d: Dialect) -> str:
    """SQL: whether a line is a short scrap of Latin letters. near: a neighbour has ideographs; single: the only line."""
    words = f"trim({d.replace(line, '[^A-Za-z]+', ' ')})"
    unsafe = d.replace(words, _SAFE, "")
    n = f"(length({words}) - length(replace({words}, ' ', '')) + 1)"
    eligible = f"NOT {single} AND length({line}) <= 32 AND {d.match(line, '^[A-Za-z][A-Za-z .,_-]{0,31}$')} AND NOT {d.match(line, '(?i)https?://|www[.]')} AND {d.match(unsafe, '[A-Za-z]')}"
    joined = f"({d.match(line, '[A-Za-z][._-][A-Za-z]')} AND length({line}) <= 18 AND NOT contains({line}, ' ') AND {d.match(unsafe, r'\b[A-Za-z]{1,6}\b')})"
    small = f"({n} <= 3 AND {d.match(words, r'\b([a-z][A-Za-z]?|[A-Z][a-z])\b')} AND {near} AND length({line}) <= 14)"
    scraps = f"({n} <= 3 AND NOT {d.match(words, '[A-Za-z]{5}')} AND {unsafe} = {words})"
    mixed = f"({d.match(words, '[a-z]')} AND {d.match(words, '[A-Z]')} AND length({words}) <= 8)"
    lower = f"({words} = lower({words}) AND {near} AND (length({words}) >= 9 OR {d.match(words, '[b-df-hj-np-tv-z]{4}')}))"
    one = f"({mixed} OR length({words}) <= 3 OR {lower})"
    return f"({eligible} AND ({joined} OR CASE WHEN {n} >= 2 THEN {small} OR {scraps} ELSE {one} END))"


def normalised(text: Column) -> Column:
    """Line feeds only, plain spaces, no invisible or control characters, no trailing blanks, at most one blank line in a row."""
    steps = [(r"\r\n?", "\n"), ("[ 　]", " "), ("[​-‏⁠﻿]", ""), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), (r"[ \t]+(?=\n|$)", ""), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")]
    text = F.coalesce(text, F.lit(""))
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


def lines_of(text: Column) -> Column:
    """Lines that are not blank, trimmed."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def noise_flags(lines: str) -> Column:
    """Of an array column of lines: whether each is noise, in view of its neighbours."""
    neighbour = lambda i: f"coalesce({SPARK.match(f'get({lines}, {i})', f'[{_CJK}]')}, false)"
    near = f"({neighbour('i - 1')} OR {neighbour('i + 1')})"
    return F.expr(f"transform({lines}, (x, i) -> {noise_line('x', near, f'(size({lines}) <= 1)', SPARK)})")


def without_noise(text: Column, lines: str) -> Column:
    """The lines of an array column that are not noise, joined again."""
    kept = F.filter(F.arrays_zip(F.col(lines).alias("line"), noise_flags(lines).alias("noise")), lambda x: ~x["noise"])
    return F.array_join(F.transform(kept, lambda x: x["line"]), "\n")


def merged(text: Column) -> Column:
    """Broken lines joined: hyphenated words, a comma at the end, a short line that goes on in lower case."""
    text = F.regexp_replace(text, r"(?<=[A-Za-z])-\n(?=[A-Za-z]{2})", "")
    text = F.regexp_replace(text, rf"(?<=[，、])\n(?=[{_CJK}])", "")
    text = F.regexp_replace(text, r"(?<=[，、,])\n(?=\S)", " ")
    return F.regexp_replace(text, r"(?m)^([A-Za-z ]{0,25}[A-Za-z0-9])\n(?=[a-z].{0,17}$)", "$1 ")


def chinese_punctuation(text: Column) -> Column:
    """ASCII marks after an ideograph become Chinese ones; repeated ones become one; no space stands before a mark."""
    text = F.regexp_replace(text, r"[ \t]+(?=[，。！？；：,.;!?])", "")
    for mark, new in PUNCTUATION.items():
        text = F.regexp_replace(text, rf"(?m)(?<=[{_CJK}])[ \t]*\{mark}[ \t]*(?=[{_CJK}])", new)
        text = F.regexp_replace(text, rf"(?m)(?<=[{_CJK}])[ \t]*\{mark}(?=$|[\s”’」』】）)])", new)
    return F.regexp_replace(text, "([，。！？；：]){2,}", "$1")


def without_annotations(text: Column, force: bool = False) -> Column:
    """Ideographs without Latin annotations stuck to them, where these are many or a large share."""
    pairs, all_ = F.regexp_count(text, F.lit(_PAIR)), F.regexp_count(text, F.lit(f"[{_CJK}]"))
    due = F.lit(force) | (pairs >= MANY_PAIRS) | (pairs >= PAIR_SHARE * F.greatest(all_, F.lit(1)))
    return F.when((pairs > 0) & due, F.regexp_replace(text, _PAIR, "$1")).otherwise(text)


def short_lines_merged(text: Column) -> Column:
    """Runs of lines of one or two visible characters become one line, blank lines between them included."""
    return F.regexp_replace(text, r"(?m)(?<=^\S{1,2})\n+(?=\S{1,2}$)", "")


def once(df, columns: dict[str, Column]):
    """df with columns that are computed once a row.

    A generator stands between them and their uses: without it filters and projections repeat them, inside lambdas once for every element.
    """
    name = "_once"
    while name in {c.lower() for c in df.columns}:
        name = f"_{name}"
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {k.lower() for k in columns}]
    rows = df.select(*kept, F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias(name))
    return rows.select(*kept, *(F.col(f"{name}.`{k}`").alias(k) for k in columns))


def cleaned(df, source: str = "text", target: str = "text", structure: bool = False, pdf: bool = False):
    """df with the cleaned text. structure: lines stay as they are broken; pdf: annotations and short lines too."""
    text = normalised(F.col(source))
    if pdf:
        text = short_lines_merged(without_annotations(text))
    lines = "_lines"
    while lines in {c.lower() for c in df.columns}:
        lines = f"_{lines}"
    df = once(df, {lines: lines_of(text)})
    out = F.col(target) if structure else chinese_punctuation(merged(F.col(target)))
    return df.withColumn(target, without_noise(F.col(source), lines)).withColumn(target, out).drop(lines)


def quality_columns(lines: str, normal: str, mode: str = "balanced") -> dict[str, Column]:
    """score and low of a text, given array column `lines` and normalised text column `normal`."""
    visible = F.char_length(F.regexp_replace(normal, r"\s", ""))
    n, sizes = F.size(lines), F.transform(lines, lambda x: F.char_length(F.regexp_replace(x, r"\s", "")))
    share = lambda a: F.size(a) / F.greatest(n, F.lit(1))
    single, short = share(F.filter(sizes, lambda x: x <= 1)), share(F.filter(sizes, lambda x: x <= 4))
    noise = share(F.filter(noise_flags(lines), lambda x: x))
    mean = F.aggregate(sizes, F.lit(0), lambda s, x: s + x) / F.greatest(n, F.lit(1))
    breaks = (F.char_length(normal) - F.char_length(F.replace(normal, F.lit("\n")))) / F.greatest(visible, F.lit(1))
    score = 0.35 + F.least(F.lit(0.28), visible / 1400.0) + F.least(F.lit(0.18), mean / 36.0) - 0.35 * single - 0.22 * short - 0.45 * noise - F.least(F.lit(0.15), 4 * breaks)
    score = score - F.when(visible <= 3, 0.32).when(visible <= 8, 0.18).otherwise(0.0) + SHIFT.get(mode, 0.0)
    score = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    low = (visible <= 3) | ((single >= 0.48) & (n >= 3)) | ((short >= 0.8) & (mean < 6) & (n >= 3)) | ((noise >= 0.5) & (n >= 2)) | (score < LOW_SCORE[mode])
    return {"score": F.round(score, 6), "low": low}
