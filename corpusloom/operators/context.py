"""Passages around hits: previews of sources, context of quizzes from seed passages, with what was left out and why.

A document is laid out in blocks (its lines), chunks (runs of lines of so many characters) and pages; a hit names a chunk. Texts are
widened, merged, cleaned and judged in column expressions; only what has to look at passages one after another, near copies
and the character budget of one paper (at most 24 seeds), runs in Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import cleaning as cl
from corpusloom.functions import lexical as lx
from corpusloom.operators import retrieval
from corpusloom.operators.answers import hit_identity, visible
from corpusloom.plans.catalogue import Catalogue
from corpusloom.sources.tables import table

catalogue = Catalogue()
query = catalogue.query

# Captions, what a cut text ends in, limits of seeds, neighbours, widening, copies and previews.
CAPTION = r"(?i)^\s*(图|表|figure|fig\.?|table)\s*[\(（]?\s*[0-9一二三四五六七八九十A-Za-z]+"
TRUNCATED = "\n[... truncated]"
SEED_CHARS, CAPTION_CHARS, POOR_SEED = 80, 120, 0.14
NEAR, WIDE, LEAST = 2, 4, 220
BROKEN, BEFORE_BROKEN = 18, 60
COPY, COPY_CHARS = 0.94, 40
SIDECAR_BONUS, SIDECAR_STAYS = 0.08, 0.02
PREVIEW_SPAN, PASSAGE_SPAN, AROUND, WHOLE_AROUND = 16, 14, 220, 260
PASSAGE, TARGET = 900, 900
CHUNK, PAGE = 800, 3000


def format_hint(source: Column) -> Column:
    """The lower-cased extension of a file's name, or null."""
    name = F.lower(F.trim(source))
    return F.coalesce(F.nullif(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1), F.lit("")), F.when(name.startswith("."), name))


def spaced(text: Column) -> Column:
    """Line feeds only, no blanks before them, single blanks, at most one blank line in a row, trimmed."""
    for pattern, new in [(r"\r\n?", "\n"), (r"\x00", ""), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "), (r"^\s+|\s+$", "")]:
        text = F.regexp_replace(F.coalesce(text, F.lit("")), pattern, new)
    return text


def merged_lines(text: Column) -> Column:
    """Short lines joined to the line before them, unless that is long or ends a sentence, or they begin a list or a caption."""
    lines = F.transform(F.split(spaced(text), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        new = F.concat(acc, F.array(x))
        joins = (F.char_length(x) <= BROKEN) & (F.char_length(last) <= BEFORE_BROKEN) & ~last.rlike(r"[。！？；;:：]$") & ~x.rlike(r"^[-•*]\s*") & ~x.rlike(CAPTION)
        blank = F.when(F.coalesce(last, F.lit("")) != "", new).otherwise(acc)
        return F.when(x == "", blank).when(F.coalesce(last, F.lit("")) == "", new).when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), x)))).otherwise(new)

    out = F.array_join(F.aggregate(lines, F.array().cast("array<string>"), step), "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def truncated(text: Column, most: int) -> Column:
    """At most so many characters; a longer text says that it was cut."""
    cut = F.concat(F.regexp_replace(F.substring(text, 1, max(0, most - 16)), r"\s+$", ""), F.lit(TRUNCATED)) if most > 24 else F.substring(text, 1, most)
    return F.when(F.char_length(text) <= most, text).otherwise(cut)


def widened(sizes: Column, left: Column, right: Column, wanted: Column, span: int, after: bool) -> Column:
    """(left, right), widened by one on both sides until so many visible characters, or the whole page, or a span beyond the limit.

    sizes: visible characters of a page's blocks; places from 0. after: the step that passes the span still counts.
    """
    n = F.size(sizes)
    low, high = lambda s: F.greatest(left - s, F.lit(0)), lambda s: F.least(right + s, n - 1)

    def stop(s: Column) -> Column:
        seen = F.aggregate(F.slice(sizes, low(s) + 1, high(s) - low(s) + 1), F.lit(0), lambda a, x: a + x)
        whole = (low(s) == 0) & (high(s) == n - 1)
        far = (s > 0) & (high(s) - low(s) > span) if after else high(s + 1) - low(s + 1) > span
        return (seen >= wanted) | whole | far

    s = F.element_at(F.filter(F.sequence(F.lit(0), F.lit(span + 2)), stop), 1)
    return F.struct(low(s).alias("left"), high(s).alias("right"))


# -- layout ------------------------------------------------------------------------------------


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ord, block_id, page, chunk, text): the lines of every document, in its order."""
    # whole texts are dealt by document: windows and groups over a document's lines need no further exchange
    lines = table(spark, d, "documents", "doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    before = F.coalesce(F.sum(F.char_length("text") + 1).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("at", before)
    return lines.select("doc_id", "ord", F.concat_ws(":", "doc_id", "ord").alias("block_id"), (F.floor(F.col("at") / PAGE) + 1).alias("page"), (F.floor(F.col("at") / CHUNK) + 1).alias("chunk"), "text")


def entries(b: DataFrame) -> DataFrame:
    """(doc_id, chunk, place, page, block_ids, content): a document's chunks in their order, with the blocks they come from."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "block_id", "text")))  # the lines of one chunk
    c = b.groupBy("doc_id", "chunk").agg(F.min("page").alias("page"), rows.alias("r"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "chunk"))
    return c.select("doc_id", "chunk", place.alias("place"), "page", F.transform("r", lambda x: x["block_id"]).alias("block_ids"), F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("content"))


def pages(b: DataFrame) -> DataFrame:
    """(doc_id, page, ids, texts): a page's blocks in their order, texts tidied."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "block_id", spaced(F.col("text")).alias("text"))))
    return b.groupBy("doc_id", "page").agg(rows.alias("r")).select("doc_id", "page", F.transform("r", lambda x: x["block_id"]).alias("ids"), F.transform("r", lambda x: x["text"]).alias("texts"))


def with_passage(df: DataFrame, name: str, block_ids: Column, wanted: int, span: int, after: bool) -> DataFrame:
    """df(ids, texts, ...) with the blocks of a page from the first to the last of those given, widened; null if none of them is on the page.

    Places, sizes and bounds are computed once a row each: as one expression every step of the widening would compute all of them again.
    """
    ids, texts = F.col("ids"), F.col("texts")
    at = F.transform(F.filter(F.arrays_zip(ids.alias("id"), F.sequence(F.lit(0), F.size(ids) - 1).alias("i")), lambda x: F.array_contains(block_ids, x["id"])), lambda x: x["i"])
    df = cl.once(df, {"_at": at, "_sizes": F.transform(texts, visible)})
    df = cl.once(df, {"_first": F.array_min("_at"), "_last": F.array_max("_at")})
    df = cl.once(df, {"_w": F.when(F.size("_at") > 0, widened(F.col("_sizes"), F.col("_first"), F.col("_last"), F.lit(wanted), span, after))})
    part = F.filter(F.slice(texts, F.col("_w.left") + 1, F.col("_w.right") - F.col("_w.left") + 1), lambda x: x != "")
    return cl.once(df, {name: F.array_join(part, "\n\n")}).drop("_at", "_sizes", "_first", "_last", "_w")


# -- previews ----------------------------------------------------------------------------------


def said(text: Column, asked: Column) -> Column:
    """Whether a text has the whole wording, or half of its words of two characters or more; no wording is always there."""
    low, q = F.lower(text), F.lower(asked)
    words = F.filter(F.split(q, r"\s+"), lambda w: F.char_length(w) >= 2)
    hits = F.size(F.filter(words, lambda w: low.contains(w)))
    return (F.coalesce(q, F.lit("")) == "") | low.contains(q) | ((F.size(words) > 0) & (hits >= F.greatest(F.lit(1), F.floor(F.size(words) / 2))))


def snippet(text: Column, asked: Column, around: int = AROUND) -> Column:
    """The characters around the first place of a wording, whatever its case, or the head of the text."""
    t, q = spaced(text), F.lower(F.trim(F.coalesce(asked, F.lit(""))))
    at = F.when(q == "", 0).otherwise(F.position(q, F.lower(t)))
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.substring(t, start, at + F.char_length(q) + around - start)).otherwise(F.substring(t, F.lit(1), F.lit(2 * around)))


def tidy(df: DataFrame, name: str, pdf: bool = False) -> DataFrame:
    """df with a text column cleaned."""
    df = cl.cleaned(df.withColumn(name, lx.nfkc(F.coalesce(F.col(name), F.lit("")))), name, name, pdf=pdf)
    return cl.once(df, {name: F.col(name)})


def judged(df: DataFrame, name: str) -> DataFrame:
    """df with <name>_score and <name>_low of a text column."""
    df = cl.once(df, {f"_{name}_normal": cl.normalised(F.col(name))})
    df = cl.once(df, {f"_{name}_lines": cl.lines_of(F.col(f"_{name}_normal"))})
    q = cl.quality_columns(f"_{name}_lines", f"_{name}_normal")
    return df.withColumns({f"{name}_score": q["score"], f"{name}_low": q["low"]}).drop(f"_{name}_normal", f"_{name}_lines")


def previews(asked: DataFrame, e: DataFrame, p: DataFrame, texts: DataFrame) -> DataFrame:
    """(request, matched_by, page, chunk, snippet) of asked(request, doc_id, block_id, chunk, page, wording), all but doc_id optional.

    The first chunk that fits by block, else by chunk, by page, by wording (which every way asks for if there is one), with its
    page's blocks around it; else the whole text. A snippet that says nothing after cleaning is empty.
    """
    t = e.select(F.col("doc_id").alias("_doc"), F.struct("place", "page", "chunk", "block_ids", "content").alias("e"))
    both = asked.join(t, F.col("doc_id") == F.col("_doc"), "left")
    fits = said(F.col("e.content"), F.trim(F.coalesce("wording", F.lit(""))))
    way = (
        F.when(F.get("e.block_ids", F.lit(0)) == F.col("block_id"), 1)
        .when(F.col("e.chunk") == F.col("chunk"), 2)
        .when(F.col("e.page") == F.col("page"), 3)
        .when(F.trim(F.coalesce("wording", F.lit(""))) != "", 4)
    )
    found = F.when(fits & way.isNotNull(), F.struct(way.alias("way"), F.col("e.place").alias("place"), F.col("e").alias("e")))
    best = both.groupBy("request", "doc_id", "wording").agg(F.min(found).alias("b"))
    best = best.join(p.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), "ids", "texts"), (F.col("doc_id") == F.col("_d")) & (F.col("b.e.page") == F.col("_p")), "left").drop("_d", "_p")
    best = best.join(texts.select(F.col("doc_id").alias("_d"), F.col("text").alias("_whole")), F.col("doc_id") == F.col("_d"), "left").drop("_d")
    best = with_passage(best, "_around", F.col("b.e.block_ids"), max(LEAST, int(TARGET * 0.4)), PREVIEW_SPAN, True)
    near = F.coalesce(F.nullif(F.col("_around"), F.lit("")), F.col("b.e.content"))
    cut = F.when(F.col("b").isNotNull(), snippet(near, F.col("wording"))).otherwise(snippet(F.col("_whole"), F.col("wording"), WHOLE_AROUND))
    names = F.array(*(F.lit(x) for x in ("block_id", "chunk", "page", "query")))
    out = best.select("request", F.coalesce(F.get(names, F.col("b.way") - 1), F.lit("text")).alias("matched_by"), F.col("b.e.page").alias("page"), F.col("b.e.chunk").alias("chunk"), cut.alias("snippet"))
    out = judged(tidy(out, "snippet"), "snippet")
    return out.withColumn("snippet", F.when(F.col("snippet_low"), "").otherwise(F.col("snippet"))).drop("snippet_score", "snippet_low")


@query()
def source_previews(spark: SparkSession, d: str) -> DataFrame:
    """A preview of every document, asked for by block, chunk, page, wording (its longest word, or one that it does not have) or nothing."""
    docs, b = table(spark, d, "documents", "doc_id", "text"), blocks(spark, d)
    i, form = F.col("doc_id"), F.col("doc_id") % 6
    words = F.filter(F.split(F.col("text"), r"[^\p{L}]+"), lambda w: w != "")
    longest = F.element_at(F.sort_array(F.transform(words, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w")))), -1)["w"]
    asked = docs.select(
        i.alias("request"),
        "doc_id",
        F.when(form == 0, F.concat_ws(":", i, F.lit(0))).alias("block_id"),
        F.when(form == 1, 2).alias("chunk"),
        F.when(form == 2, 1).alias("page"),
        F.when(form == 3, longest).when(form == 4, "zzzz").alias("wording"),
    )
    return previews(asked, entries(b), pages(b), docs).select("request", "matched_by", "page", "chunk", F.char_length("snippet").alias("n"), F.md5(F.col("snippet").cast("binary")).alias("snippet_md5"))


# -- hits --------------------------------------------------------------------------------------


def without_poor_hits(hits: DataFrame, name: str = "text") -> DataFrame:
    """Hits cleaned, those of low quality left out; one that cleaning empties keeps its text."""
    kept = hits.withColumn("_raw", F.col(name))
    kept = judged(tidy(kept, name), name).filter(~F.col(f"{name}_low"))
    return kept.withColumn(name, F.when(F.col(name) == "", F.col("_raw")).otherwise(F.col(name))).drop("_raw", f"{name}_score", f"{name}_low")


@query()
def clean_hits(spark: SparkSession, d: str) -> DataFrame:
    """The hits of each benchmark question that are worth showing."""
    docs = table(spark, d, "documents", "doc_id", "text")
    hits = retrieval.bm25_topk(spark, d).join(docs, F.col("id") == F.col("doc_id"))
    return without_poor_hits(hits).select("question", "rank", "id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# -- seeds of a quiz ---------------------------------------------------------------------------


def focus_seeds(hits: DataFrame, wanted: int) -> DataFrame:
    """The first hits(paper, part, rank, doc_id, page, chunk, text) of different identity: by part (focus concepts in their order, the whole question last), then rank."""
    one = hit_identity(F.col("doc_id"), F.col("page"), F.col("chunk"), F.coalesce("text", F.lit("")))
    first = hits.withColumn("_one", one).withColumn("_n", F.row_number().over(Window.partitionBy("paper", "_one").orderBy("part", "rank"))).filter("_n = 1")
    place = F.row_number().over(Window.partitionBy("paper").orderBy("part", "rank"))
    return first.withColumn("seed", place).filter(F.col("seed") <= wanted).drop("_one", "_n", "part", "rank")


def per_focus(wanted: int, n: Column) -> Column:
    """How many hits each of n focus concepts is searched for."""
    return F.greatest(F.lit(4), F.least(F.lit(wanted), F.ceil(F.lit(wanted) / n) + 2))


def seed_quality(df: DataFrame, name: str, source: str) -> DataFrame:
    """df with the seed's cleaned text in place, `score`, and `drop`, why it is no seed (or null); ocr and page_quality are optional columns."""
    df = judged(tidy(df.withColumn(name, spaced(F.col(name))), name), name)
    n, t = visible(F.col(name)), F.col(name)
    caption = t.rlike(CAPTION)
    score = F.col(f"{name}_score") - F.when(n < SEED_CHARS, 0.2).otherwise(0.0) - F.when(caption & (n < CAPTION_CHARS), 0.25).otherwise(0.0)
    if "ocr" in df.columns:
        score = score - F.when(F.coalesce("ocr", F.lit(False)), 0.06).otherwise(0.0)
    if "page_quality" in df.columns:
        q = F.col("page_quality")
        score = score - F.when(q < 0.45, F.least(F.lit(0.12), (0.45 - q) * 0.3)).otherwise(0.0)
    lines = F.size(cl.lines_of(t))
    df = df.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    poor = (F.col("score") < POOR_SEED) & ((lines >= 2) | (n <= 4))
    drop = F.when(t == "", "empty").when(poor, "low_quality").when((lines >= 2) & F.col(f"{name}_low"), "too_fragmented").when(caption & (n < SEED_CHARS), "short_caption")
    return df.withColumn("drop", drop).drop(f"{name}_score", f"{name}_low")


def neighbours(seeds: DataFrame, e: DataFrame) -> DataFrame:
    """seeds(doc_id, chunk, ...) with `neighbour`, the text of the chunks around: two on each side, those of its page if they say enough, else four; and from_chunk, to_chunk."""
    order = Window.partitionBy("doc_id").orderBy("place").rowsBetween(-WIDE, WIDE)
    near = e.join(seeds.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("_near", F.collect_list(F.struct("place", "page", "chunk", "content")).over(order))
    near = near.select(F.col("doc_id").alias("_d"), F.col("chunk").alias("_c"), F.col("place").alias("_place"), F.col("page").alias("_page"), "_near")
    both = seeds.join(near, (F.col("doc_id") == F.col("_d")) & (F.col("chunk") == F.col("_c")), "left")
    join = lambda rows: merged_lines(F.array_join(F.transform(rows, lambda x: x["content"]), "\n\n"))
    enough = min(LEAST, TARGET // 2)
    two = F.filter("_near", lambda x: F.abs(x["place"] - F.col("_place")) <= NEAR)
    both = cl.once(both, {"_two": two, "_same": F.filter(two, lambda x: x["page"] == F.col("_page"))})
    both = cl.once(both, {"_sel": F.when((F.size("_same") > 0) & (visible(join("_same")) >= enough), F.col("_same")).otherwise(F.col("_two"))})
    both = cl.once(both, {"_sel": F.when(visible(join("_sel")) < enough, F.col("_near")).otherwise(F.col("_sel"))})
    chunks = F.transform("_sel", lambda x: x["chunk"])
    both = cl.once(both, {"neighbour": join("_sel"), "from_chunk": F.coalesce(F.array_min(chunks), F.col("chunk")), "to_chunk": F.coalesce(F.array_max(chunks), F.col("chunk"))})
    out = tidy(both.drop("_d", "_c", "_place", "_page", "_near", "_two", "_same", "_sel"), "neighbour")
    return out.withColumn("neighbour", truncated(F.col("neighbour"), int(TARGET * 1.35)))


def sidecar(seeds: DataFrame, e: DataFrame, p: DataFrame) -> DataFrame:
    """seeds(doc_id, chunk, ...) with `laid_out`, the blocks of its page around its own."""
    of = e.select(F.col("doc_id").alias("_d"), F.col("chunk").alias("_c"), F.col("page").alias("_page"), "block_ids")
    both = seeds.join(of, (F.col("doc_id") == F.col("_d")) & (F.col("chunk") == F.col("_c")), "left").drop("_d", "_c")
    both = both.join(p.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), "ids", "texts"), (F.col("doc_id") == F.col("_d")) & (F.col("_page") == F.col("_p")), "left")
    both = with_passage(both, "_around", F.col("block_ids"), min(320, TARGET // 2), PASSAGE_SPAN, False)
    both = cl.once(both, {"laid_out": merged_lines(F.col("_around"))})
    out = tidy(both.drop("_around", "_d", "_p", "_page", "block_ids", "ids", "texts"), "laid_out", pdf=True)
    return out.withColumn("laid_out", truncated(F.col("laid_out"), int(TARGET * 1.35)))


def chosen(df: DataFrame) -> DataFrame:
    """df with `mode` and `passage`: the best of neighbour, laid_out and text (the first of equals; a laid-out one has a bonus and stays more easily), and `passage_score`."""
    for name in ("neighbour", "laid_out", "text"):
        df = judged(df, name)
    has = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    option = lambda mode, name: F.struct(F.lit(mode).alias("mode"), F.col(name).alias("passage"), F.col(f"{name}_score").alias("score"))
    first = F.when(has("neighbour"), option("neighbour", "neighbour"))
    side = option("laid_out", "laid_out")
    second = F.when(has("laid_out") & (first.isNull() | (side["score"] + SIDECAR_BONUS > first["score"])), side).otherwise(first)
    raw = option("seed", "text")
    stays = second["score"] + F.when(second["mode"] == "laid_out", SIDECAR_STAYS).otherwise(0.0)
    best = F.when(has("text") & (second.isNull() | (raw["score"] > stays)), raw).otherwise(second)
    df = df.withColumn("_best", best)
    df = df.withColumns({"mode": F.col("_best.mode"), "passage": F.col("_best.passage"), "passage_score": F.greatest("_best.score", "score")})
    return df.drop("_best", *(f"{n}_{x}" for n in ("neighbour", "laid_out", "text") for x in ("score", "low")))


_NOT_WORD = re.compile(r"[^\w一-鿿]+")


def compared(text: str) -> str:
    return _NOT_WORD.sub("", re.sub(r"\s+", " ", text.strip().lower()))


def copies(key: str, seen: list[str]) -> bool:
    """Whether a passage's key is empty, equals one seen, or, both being long, is alike to it."""
    if not key or key in seen:
        return True
    if len(key) <= COPY_CHARS:
        return False
    alike = (SequenceMatcher(None, key, s) for s in seen if len(s) > COPY_CHARS and 2 * min(len(s), len(key)) >= COPY * (len(s) + len(key)))
    return any(m.quick_ratio() >= COPY and m.ratio() >= COPY for m in alike)


def composed(passages: list[dict], budget: int, interleave: bool) -> tuple[str, int]:
    """Passages (seed, quality, doc_id, source, text) within a budget: by seed, of one base in turn over its documents; the last one is cut if it does not fit."""
    order = sorted(passages, key=lambda x: (x["seed"], -x["quality"]))
    if interleave:
        turn: dict = {}
        for x in order:
            turn.setdefault(x["doc_id"], []).append(x)
        place = {d: i for i, d in enumerate(turn)}
        order = sorted(order, key=lambda x: (turn[x["doc_id"]].index(x), place[x["doc_id"]]))
    parts, total = [], 0
    for x in order:
        segment, gap = f"来源: {x['source']}\n{x['text']}", 2 if parts else 0
        left = budget - total - gap
        if left <= 0 or (len(segment) > left and left <= COPY_CHARS):
            break
        if len(segment) > left:
            segment = segment[: left - 16].rstrip() + TRUNCATED
        parts.append(segment)
        total += gap + len(segment)
    return "\n\n".join(parts), len(parts)


CONTEXT = "paper long, context string, seeds int, filtered int, used int, rebuilt int, fallback boolean, dropped string, modes string"


def contexts(seeds: DataFrame, e: DataFrame, p: DataFrame, budget: Column, interleave: bool = True) -> DataFrame:
    """The context of every paper from its seeds(paper, seed, doc_id, page, chunk, source, text), with counts of what was left out and how passages were built.

    A paper all of whose seeds are refused takes them all the same (fallback).
    """
    s = seed_quality(seeds.withColumn("budget", budget), "text", "source")
    s = s.withColumn("_any", F.max(F.col("drop").isNull()).over(Window.partitionBy("paper")))
    s = s.withColumn("_works", F.col("drop").isNull() | ~F.col("_any"))
    s = chosen(sidecar(neighbours(s, e), e, p))
    rows = F.struct("seed", "doc_id", "source", "drop", "_works", "mode", "passage", "passage_score", "text", "budget")
    papers = s.groupBy("paper").agg(F.array_sort(F.collect_list(rows)).alias("rows"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for paper, found in zip(pdf["paper"], pdf["rows"], strict=True):
                drops, modes, seen, kept = {}, {}, [], []
                for x in found:
                    if x["drop"]:
                        drops[x["drop"]] = drops.get(x["drop"], 0) + 1
                    if not x["_works"] or not x["passage"] or copies(key := compared(x["passage"]), seen):
                        continue
                    seen.append(key)
                    modes[x["mode"]] = modes.get(x["mode"], 0) + 1
                    kept.append({"seed": x["seed"], "quality": x["passage_score"], "doc_id": x["doc_id"], "source": x["source"], "text": x["passage"]})
                text, used = composed(kept, int(found[0]["budget"]), interleave)
                counts = lambda c: ",".join(f"{k}={c[k]}" for k in sorted(c))
                rebuilt = sum(n for m, n in modes.items() if m != "seed")
                out.append((paper, text, len(found), sum(drops.values()), used, rebuilt, all(x["drop"] for x in found) or not kept, counts(drops), counts(modes)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CONTEXT.split(", ")])

    return papers.mapInPandas(build, CONTEXT)


WANTED = 12


@query()
def quiz_contexts(spark: SparkSession, d: str) -> DataFrame:
    """A paper for each benchmark item in the base of the document of equal id: seeds by its first long words, filled up by its whole text, and their context."""
    b = blocks(spark, d)
    e, p = entries(b), pages(b)
    home = table(spark, d, "documents", "doc_id", "source")
    ident = F.struct("doc_id", "chunk")
    chunks = e.join(home, "doc_id").select(F.col("source").alias("scope"), ident.alias("id"), lx.tokens(F.col("content")).alias("tokens"))
    asked = table(spark, d, "benchmark").join(home, F.col("item_id") == F.col("doc_id")).select(F.col("item_id").alias("paper"), F.col("source").alias("scope"), lx.tokens(F.col("text")).alias("tokens"))
    focus = F.slice(F.array_distinct(F.filter("tokens", lambda w: F.char_length(w) >= 6)), 1, 3)
    asked = asked.withColumn("focus", focus).withColumn("n", F.size("focus"))
    parts = F.concat(F.transform("focus", lambda w, i: F.struct(i.alias("part"), F.array(w).alias("tokens"), F.when(F.col("n") == 1, WANTED).otherwise(per_focus(WANTED, F.col("n"))).alias("k"))), F.array(F.struct(F.lit(9).alias("part"), F.col("tokens").alias("tokens"), F.lit(WANTED).cast("bigint").alias("k"))))
    parts = asked.select("scope", "paper", F.explode(parts).alias("q")).select("scope", F.struct("paper", "q.part").alias("question"), "q.tokens", "q.k")
    hits = retrieval.bm25(chunks, parts.drop("k"), WANTED).join(parts.select("scope", "question", "k"), ["scope", "question"]).filter(F.col("rank") <= F.col("k"))
    hits = hits.select(F.col("question.paper").alias("paper"), F.col("question.part").alias("part"), "rank", "scope", F.col("id.doc_id").alias("doc_id"), F.col("id.chunk").alias("chunk"))
    hits = hits.join(e.select("doc_id", "chunk", "page", F.col("content").alias("text")), ["doc_id", "chunk"])
    seeds = focus_seeds(hits, WANTED).withColumn("source", F.concat(F.col("scope"), F.lit("/"), F.col("doc_id").cast("string"))).drop("scope")
    out = contexts(seeds, e, p, F.least(F.lit(16000), F.lit(7000 + 900 * 5)))
    return out.select("paper", F.char_length("context").alias("n"), "seeds", "filtered", "used", "rebuilt", "fallback", "dropped", "modes", F.md5(F.col("context").cast("binary")).alias("context_md5"))


QUERIES: dict[str, Callable] = catalogue.queries
ORACLES: dict[str, str] = catalogue.oracles
