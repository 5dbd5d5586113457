"""Cleaning, fragment quality, page edges, markup blocks, chunks and even samples of documents and pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import cleaning as cl
from corpusloom.functions.lexical import nfkc
from corpusloom.operators.ordering import ranked
from corpusloom.plans.catalogue import Catalogue
from corpusloom.sources.tables import table

catalogue = Catalogue()
query = catalogue.query

# Chunk size and overlap, separators from coarse to fine, page edges.
SIZE, OVERLAP = 1000, 150
SEPARATORS = ["\n\n", "\n", "。", "！", "？", "；", "，", ",", " "]
PAGE = 3000
SAMPLE = 15


@query()
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """Every document cleaned, NFKC first."""
    docs = table(spark, d, "documents", "doc_id", "text").withColumn("text", nfkc("text"))
    return cl.cleaned(docs).select("doc_id", F.char_length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


_SPACE = "[\\t\\n\\x0b\\f\\r ]"
_NORMAL = "coalesce(text, '')"
for _p, _n in [("\\r\\n?", "' || chr(10) || '"), ("[\\x{00a0}\\x{3000}]", " "), ("[\\x{200b}-\\x{200f}\\x{2060}\\x{feff}]", ""), ("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", ""), ("[ \\t]+(\\n|$)", "\\1"), ("\\n{3,}", "' || chr(10) || chr(10) || '"), ("^\\s+|\\s+$", "")]:
    _NORMAL = f"regexp_replace({_NORMAL}, '{_p}', '{_n}', 'g')"
_CJK_AT = lambda i: f"coalesce(regexp_matches(ls[{i}], '[一-鿿]'), false)"


@query(f"""WITH n AS (SELECT doc_id, {_NORMAL} AS t FROM documents),
l AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ls FROM n),
f AS (SELECT doc_id, t, ls, length(regexp_replace(t, '\\s', '', 'g')) AS visible, len(ls) AS n, list_transform(ls, lambda x: length(regexp_replace(x, '\\s', '', 'g'))) AS sizes,
len(list_filter(range(1, len(ls) + 1), lambda i: {cl.noise_line("ls[i]", f"({_CJK_AT('i - 1')} AND i > 1 OR {_CJK_AT('i + 1')})", "(len(ls) <= 1)", cl.DUCKDB)})) / greatest(len(ls), 1) AS noise FROM l),
g AS (SELECT *, len(list_filter(sizes, lambda x: x <= 1)) / greatest(n, 1) AS single, len(list_filter(sizes, lambda x: x <= 4)) / greatest(n, 1) AS short, coalesce(list_sum(sizes), 0) / greatest(n, 1) AS mean,
(length(t) - length(replace(t, chr(10), ''))) / greatest(visible, 1) AS breaks FROM f),
s AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE greatest(0, least(1, 0.35::DOUBLE + least(0.28::DOUBLE, visible / 1400.0::DOUBLE) + least(0.18::DOUBLE, mean / 36.0::DOUBLE) - 0.35::DOUBLE * single - 0.22::DOUBLE * short - 0.45::DOUBLE * noise
- least(0.15::DOUBLE, 4 * breaks) - CASE WHEN visible <= 3 THEN 0.32::DOUBLE WHEN visible <= 8 THEN 0.18::DOUBLE ELSE 0 END)) END AS score FROM g)
SELECT doc_id, n AS lines, round(score, 6) AS score, visible <= 3 OR (single >= 0.48 AND n >= 3) OR (short >= 0.8 AND mean < 6 AND n >= 3) OR (noise >= 0.5 AND n >= 2) OR score < 0.18 AS low FROM s""")
def fragment_quality(spark: SparkSession, d: str) -> DataFrame:
    """Score and verdict of every document as a fragment."""
    docs = cl.once(table(spark, d, "documents", "doc_id", "text"), {"normal": cl.normalised(F.col("text"))}).drop("text")
    docs = cl.once(docs, {"lines": cl.lines_of(F.col("normal"))})
    q = cl.quality_columns("lines", "normal")
    return docs.select("doc_id", F.size("lines").alias("n"), q["score"].alias("score"), q["low"].alias("low")).withColumnRenamed("n", "lines")


def edge_key(line: Column) -> Column:
    return F.lower(F.regexp_replace(line, r"\s", ""))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def last_line(text: Column) -> Column:
    """What follows the last line feed, found from the end: a pattern that ends there is tried from every character of every line."""
    return F.substring_index(text, "\n", -1)


_EDGES = """SELECT doc_id, source, list_distinct([regexp_extract(text, '^[^\\n]*'), regexp_extract(text, '[^\\n]*$')]) AS es FROM documents"""
_KEYS = f"""SELECT source, lower(regexp_replace(e, '\\s', '', 'g')) AS key, count(DISTINCT doc_id) AS pages FROM (SELECT source, doc_id, unnest(es) AS e FROM ({_EDGES}))
WHERE length(regexp_replace(e, '\\s', '', 'g')) BETWEEN 2 AND 26 AND NOT regexp_matches(e, '^\\s*(第?\\s*\\d{{1,4}}\\s*页?|[0-9]{{1,4}})\\s*$') GROUP BY 1, 2 HAVING pages >= 2"""


def edge_keys(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "source", "text")
    first, last = first_line(F.col("text")), last_line(F.col("text"))
    edges = docs.select("source", "doc_id", F.explode(F.array_distinct(F.array(first, last))).alias("e"))
    n = F.char_length(F.regexp_replace("e", r"\s", ""))
    edges = edges.filter((n >= 2) & (n <= 26) & ~F.col("e").rlike(r"^\s*(第?\s*\d{1,4}\s*页?|[0-9]{1,4})\s*$"))
    pages = edges.select("source", "doc_id", edge_key(F.col("e")).alias("key")).distinct()
    return pages.groupBy("source", "key").agg(F.count(F.lit(1)).alias("pages")).filter("pages >= 2")


@query(_KEYS)
def repeated_edges(spark: SparkSession, d: str) -> DataFrame:
    """First and last lines that recur among a source's pages (documents)."""
    return edge_keys(spark, d)


#: What is cut from both ends of a page, so that its first and last lines have text.
_BLANKS = " \t\n\r"


@query(rf"""WITH k AS ({_KEYS}), p AS (SELECT doc_id, source, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents),
e AS (SELECT *, lower(regexp_replace(regexp_extract(t, '^[^\n]*'), '\s', '', 'g')) AS a, lower(regexp_replace(regexp_extract(t, '[^\n]*$'), '\s', '', 'g')) AS b FROM p),
f AS (SELECT e.*, x.pages IS NOT NULL AS first, y.pages IS NOT NULL AND contains(t, chr(10)) AS last FROM e LEFT JOIN k x ON e.source = x.source AND a = x.key LEFT JOIN k y ON e.source = y.source AND b = y.key),
r AS (SELECT *, CASE WHEN first THEN regexp_replace(t, '^[^\n]*', '') ELSE t END AS u FROM f)
SELECT doc_id, first::BIGINT + last::BIGINT AS removed, md5(trim(regexp_replace(CASE WHEN last THEN regexp_replace(u, '[^\n]*$', '') ELSE u END, '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS text_md5 FROM r""")
def edge_noise_removed(spark: SparkSession, d: str) -> DataFrame:
    """Documents without their first and last lines where these recur in their source; how many lines went."""
    docs = table(spark, d, "documents", "doc_id", "source", "text").select("doc_id", "source", F.btrim(F.coalesce("text", F.lit("")), F.lit(_BLANKS)).alias("t"))
    docs = docs.withColumn("a", edge_key(first_line(F.col("t")))).withColumn("b", edge_key(last_line(F.col("t"))))
    known = edge_keys(spark, d)
    of = lambda k, name: known.select("source", F.col("key").alias(k), F.lit(True).alias(name))
    both = docs.join(of("a", "first"), ["source", "a"], "left").join(of("b", "last"), ["source", "b"], "left")
    first, last = F.coalesce("first", F.lit(False)), F.coalesce("last", F.lit(False)) & F.contains("t", F.lit("\n"))
    # both cuts by length: the last line, where it goes, follows a line feed, which stays
    start = F.when(first, F.char_length(first_line(F.col("t")))).otherwise(0)
    end = F.char_length("t") - F.when(last, F.char_length(last_line(F.col("t")))).otherwise(0)
    left = F.substring("t", start + 1, end - start)
    left = F.btrim(F.regexp_replace(left, r"\n{3,}", "\n\n"), F.lit(_BLANKS))
    return both.select("doc_id", (first.cast("long") + last.cast("long")).alias("removed"), F.md5(left.cast("binary")).alias("text_md5"))


_TAGS = r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->"


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS text_md5 FROM pages""")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Visible text of every page."""
    t = F.regexp_replace(F.coalesce("html", F.lit("")), _TAGS, " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"[ \t\n\x0b\f\r]+", " "))
    return table(spark, d, "pages").select("page_id", F.md5(t.cast("binary")).alias("text_md5"))


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most size characters, cut after the coarsest separator that fits; each begins with the tail of the last."""
    pieces, start, n = [], 0, len(text)
    while n - start > size:
        end = start + size
        for s in SEPARATORS:
            at = text.rfind(s, start + overlap + 1, end)
            if at >= 0:
                end = at + len(s)
                break
        pieces.append(text[start:end])
        start = max(start + 1, end - overlap)
    pieces.append(text[start:])
    return [p for p in (x.strip() for x in pieces) if p]


def chunks_of(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk, content) of docs(doc_id, text); chunks are numbered from 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, c, piece) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True) for c, piece in enumerate(split_text(t or ""), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk int, content string")


@query()
def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(table(spark, d, "documents", "doc_id", "text")).select("doc_id", "chunk", F.char_length("content").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query()
def chunk_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with page numbers and modality, as the index stores them."""
    c = chunks_of(table(spark, d, "documents", "doc_id", "text"))
    return c.select("doc_id", "chunk", (F.floor((F.col("chunk") - 1) * (SIZE - OVERLAP) / PAGE) + 1).alias("page"), F.lit("text").alias("modality"), F.array(F.concat_ws(":", "doc_id", "chunk")).alias("block_ids"))


@query(f"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id FROM r WHERE n <= {SAMPLE} OR list_contains(list_transform(range(0, {SAMPLE}), lambda x: x * n // {SAMPLE}), i)""")
def even_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifteen documents of each source at even distances (a sampling operator)."""
    r = ranked(table(spark, d, "documents", "doc_id", "source"), "source", "doc_id").withColumnRenamed("_place", "i").withColumnRenamed("_many", "n")
    places = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE - 1)), lambda x: F.floor(x * F.col("n") / SAMPLE))
    return r.filter((F.col("n") <= SAMPLE) | F.array_contains(places, F.col("i").cast("long"))).select("source", "doc_id")


QUERIES: dict[str, Callable] = catalogue.queries
ORACLES: dict[str, str] = catalogue.oracles
