"""Comparison keys of short concept texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.lexical import nfkc

# List prefixes, trailing marks, and what a comparison key leaves out.
PREFIXES = [
    r"^\s*\d+\s*[.)、．]\s*",
    r"^\s*[A-Za-z]\s*[.)、．]\s*",
    r"^\s*[（(]\s*[0-9一二三四五六七八九十百零]+\s*[)）]\s*",
    r"^\s*[一二三四五六七八九十百零]+\s*[、.．]\s*",
]
TAIL = r"[。；;，,：:、 ]+$"
LEFT_OUT = r"[\s\-_—·•、，,。；;：:()（）\[\]{}<>《》\"'“”‘’]+"
# Prefixes as often as they come: one pattern of them all.
_PREFIX = "^(?:" + "|".join(p.removeprefix("^") for p in PREFIXES) + ")+"
_LETTER = r"0-9a-z㐀-䶿一-鿿豈-﫿぀-ヿ가-힯"


def plain(text: Column) -> Column:
    """NFKC, lower case, single spaces, no list prefixes however many, no trailing marks."""
    t = F.trim(F.regexp_replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), r"\s+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(t, _PREFIX, ""), TAIL, ""))


def comparison_key(text: Column) -> Column:
    return F.regexp_replace(plain(text), LEFT_OUT, "")


def soft_key(text: Column) -> Column:
    """The comparison key without a structural particle between two letters."""
    return F.regexp_replace(comparison_key(text), f"(?<=[{_LETTER}])的(?=[{_LETTER}])", "")


# Letters whose capitals are several letters in full, and the single capital that keys lower again to the same letter.
_ALONE = "ß" + "".join(c for c in map(chr, range(0x1F80, 0x2000)) if len(c.upper()) > 1 and len(c.title()) == 1)
_CAPITAL = "ẞ" + "".join(c.title() for c in _ALONE[1:])


def capitals(text: Column) -> Column:
    """In capitals, one for each character: a letter without a single capital stays."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.char_length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, _ALONE, _CAPITAL))), "")


def plain_sql(text: str) -> str:
    t = f"trim(regexp_replace(lower(coalesce({text}, '')), '\\s+', ' ', 'g'))"
    return f"trim(regexp_replace(regexp_replace({t}, '{_PREFIX}', ''), '{TAIL}', ''))"


def comparison_key_sql(text: str) -> str:
    out = LEFT_OUT.replace("'", "''")
    return f"regexp_replace({plain_sql(text)}, '{out}', '', 'g')"


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; a single character stands for itself."""
    # over an array of one, so that the characters are told apart once; a substring by its place would count from the start each time
    pairs = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda x, y: F.concat(x, y))
    found = F.transform(F.array(F.split(text, "")), lambda c: F.when(F.size(c) > 1, pairs(c)).otherwise(F.filter(c, lambda x: x != "")))[0]
    return F.array_distinct(found)


def bigrams_sql(text: str) -> str:
    return f"CASE WHEN length({text}) = 0 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, greatest(length({text}) - 1, 1) + 1), lambda i: substring({text}, i, 2))) END"


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
