"""Lexical analysis as Column expressions: tokens with stopword fallback, overlap, query classes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The default stopwords.
STOPWORDS = (
    "a an and are as at be by for from in is it of on or that the to with 与 且 了 于 以 们 但 你 其 和 在 将 就 并 并且 很 把 是 有 及 或 我 所以 等 而 被 让 该 这 这个 这些 那 那个 那些 都 通过 进行 以及"
).split()

# Question classes (English and Chinese wording), as case-insensitive patterns, any of which tells the class.
CLASSES = {
    "summary": [
        r"\b(summary|summari[sz]e|overview|recap|synopsis)\b",
        r"(总结|概括|归纳|梳理|总览|综述|提炼|总结一下|概述)",
        r"(全文|整篇|本章|这一章|这章|本节|这节).{0,12}(讲了什么|主要内容|核心内容|重点)",
    ],
    "compare": [
        r"\b(compare|comparison|contrast|different(?:ce|ces)?|vs\.?|versus|similarit(?:y|ies))\b",
        r"(比较|对比|区别|差异|异同|不同点|相同点)",
    ],
    "relation": [
        r"\b(relation|relationship|related|association|interact(?:ion)?)\b",
        r"(关系|联系|关联|相互作用)",
    ],
    "list": [
        r"\b(list|enumerate|identify|examples?|types?|kinds?|categories?)\b",
        r"(列举|列出|有哪些|有什么|举例|类型|种类|类别|包括哪些)",
    ],
    "steps": [
        r"\b(step(?:s)?|procedure|process|workflow|how to)\b",
        r"(步骤|流程|过程|如何|怎么做|怎么计算|怎样)",
    ],
    "causes": [
        r"\b(cause|causes|reason|reasons|why|because)\b",
        r"(原因|为什么|成因|导致|引起)",
    ],
    "pros_cons": [
        r"\b(pros?\s+and\s+cons|advantages?|disadvantages?|strengths?|weaknesses?|trade[- ]?offs?)\b",
        r"(优缺点|利弊|优势|劣势|好处|坏处|取舍)",
    ],
}
COMPLEX = ("compare", "relation", "list", "steps", "causes", "pros_cons")
CONJUNCTIONS = [
    r"(分别|同时|以及|并且|一方面|另一方面)",
    r"\b(and|or|while|whereas|both)\b",
]

_WORD = r"[a-z0-9_]+|[一-鿿]"
_LONG_WORD = r"[a-z0-9_]{2,}|[一-鿿]"
_SQL_WORD = r"[a-z0-9_]+|[\x{4e00}-\x{9fff}]"


#: Bytes of text that a task holds as Python strings at a time.
_BLOCK = 1 << 20


@F.arrow_udf(StringType())
def _nfkc(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        parts, at = [pa.array([], pa.string())], 0
        while at < len(batch):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BLOCK, side="right")))
            parts.append(pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in batch.slice(at, stop - at).to_pylist()], pa.string()))
            at = stop
        yield pa.concat_arrays(parts)
        del batch, parts
        pa.default_memory_pool().release_unused()


def nfkc(text: Column | str) -> Column:
    """Unicode NFKC, which Spark's own functions lack. ASCII, which it leaves as it is, does not go to Python."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_nfkc(F.when(F.octet_length(t) != F.char_length(t), t)), t)


def normalised(text: Column) -> Column:
    """Analyzer normal form but for NFKC: no zero-width characters, control characters and white space as one space, lower case."""
    t = F.regexp_replace(text, r"[​-‏⁠﻿]", "")
    return F.lower(F.trim(F.regexp_replace(t, r"[\x00-\x20\x7f 　]+", " ")))


def raw_tokens(text: Column) -> Column:
    """Words of ASCII letters, digits and underscores, single ideographs; words of one character are dropped."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_LONG_WORD})"), F.lit(1))


def tokens(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Tokens without stopwords, or with them where nothing else is left; null counts as empty."""
    def chosen(raw: Column) -> Column:
        kept = F.filter(raw, lambda t: ~t.isin(*stopwords))
        return F.when(F.size(kept) == 0, raw).otherwise(kept)

    # over an array of one, so that the words are extracted once
    return F.transform(F.array(raw_tokens(F.coalesce(text, F.lit("")))), chosen)[0]


def raw_tokens_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '{_SQL_WORD}'), lambda t: length(t) > 1 OR regexp_matches(t, '[^a-z0-9_]'))"


def tokens_sql(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    kept = f"list_filter({raw_tokens_sql(text)}, lambda t: NOT list_contains([{stop}], t))"
    return f"CASE WHEN len({kept}) = 0 THEN {raw_tokens_sql(text)} ELSE {kept} END"


def words(text: Column) -> Column:
    """Distinct words or ideographs of a text (words of one character count)."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({_WORD})"), F.lit(1)))


def overlap(a: Column, b: Column) -> Column:
    """Distinct words or ideographs that two texts share."""
    return F.size(F.array_intersect(words(a), words(b)))


def overlap_sql(a: str, b: str) -> str:
    words = lambda t: f"list_distinct(regexp_extract_all(lower(coalesce({t}, '')), '{_SQL_WORD}'))"
    return f"len(list_intersect({words(a)}, {words(b)}))"


def any_of(patterns: list[str]) -> str:
    """One case-insensitive pattern of several, for either engine."""
    return "(?i)" + "|".join(patterns)


def is_class(text: Column, name: str) -> Column:
    return text.rlike(any_of(CLASSES[name]))


def is_complex(text: Column) -> Column:
    out = F.lit(False)
    for name in COMPLEX:
        out = out | is_class(text, name)
    return out


def is_multi_part(text: Column) -> Column:
    """Two marks that end a part, two that separate, or a conjunction."""
    return (F.regexp_count(text, F.lit("[；;?？]")) >= 2) | (F.regexp_count(text, F.lit("[，,、；;]")) >= 2) | text.rlike(any_of(CONJUNCTIONS))


def is_medium(text: Column, rewritten: Column | bool = False) -> Column:
    return F.lit(rewritten) | (F.char_length(text) > 40) | is_multi_part(text)


def class_sql(text: str, name: str) -> str:
    return f"regexp_matches({text}, '{any_of(CLASSES[name])}')"


def complex_sql(text: str) -> str:
    return "(" + " OR ".join(class_sql(text, n) for n in COMPLEX) + ")"


def multi_part_sql(text: str) -> str:
    return f"(len(regexp_extract_all({text}, '[；;?？]')) >= 2 OR len(regexp_extract_all({text}, '[，,、；;]')) >= 2 OR regexp_matches({text}, '{any_of(CONJUNCTIONS)}'))"
