"""Concept graph and learning path: rule edges, an acyclic graph, order, depth, stages, minutes, modules.

A concept is a line of a document; the knowledge base is the document's source. What is sequential by nature (greedy
edge choice, topological order) runs per document, which is bounded by one text; all else, edges between documents
included, is joins, windows and aggregates.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import lexical as lx
from corpusloom.functions.cleaning import once
from corpusloom.operators import learner
from corpusloom.operators.ordering import followers
from corpusloom.plans.catalogue import Catalogue
from corpusloom.sources import versions
from corpusloom.sources.tables import table

catalogue = Catalogue()
query = catalogue.query

# Confidences, cues, degrees, stage cuts, minutes.
STRONG, MEDIUM, LIGHT = 0.55, 0.46, 0.38
BASIC, ADVANCED = "定义|概念|基础|术语|简介|入门|原理", "应用|算法|推导|案例|实现|实践|优化|综合"
NEAR_DOCUMENTS = 3
MAX_OUT, MAX_IN = 4, 3
STAGES = ["foundation", "intermediate", "advanced", "application"]
CUTS = {"beginner": (0.45, 0.7, 0.88), "intermediate": (0.3, 0.6, 0.82), "advanced": (0.2, 0.5, 0.78)}
MINUTES = (8, 14, 22, 30)
MODULE, MODULE_PART = 8, 6
MAX_SHIFT = 2
NUMERALS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}


def cjk_number(text: Column) -> Column:
    """Chinese numerals up to the hundreds."""
    digit = F.create_map(*(F.lit(x) for kv in NUMERALS.items() for x in kv))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("now"))

    def step(acc: Column, c: Column) -> Column:
        hundred, ten = c == "百", c == "十"
        now = F.when(hundred, 0).when(ten, F.greatest(acc["now"], F.lit(1)) * 10).otherwise(acc["now"] + F.coalesce(digit[c], F.lit(0)))
        return F.struct((acc["total"] + F.when(hundred, F.greatest(acc["now"], F.lit(1)) * 100).otherwise(0)).alias("total"), now.alias("now"))

    return F.aggregate(F.split(text, ""), zero, step, lambda acc: acc["total"] + acc["now"])


def order_number(text: Column) -> Column:
    """The number that a text begins with, as 3. or 第3章 or 三、"""
    digits = F.coalesce(F.nullif(F.regexp_extract(text, r"^\s*第\s*(\d{1,9})\s*[章节篇条]", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"^\s*(\d{1,9})\s*[.、)\-:]", 1), F.lit("")))
    cjk = F.nullif(F.regexp_extract(text, r"^\s*([一二三四五六七八九十百零两]+)\s*[、.]", 1), F.lit(""))
    return F.coalesce(digits.cast("int"), F.when(cjk.isNotNull(), cjk_number(cjk)))


def points(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, place, text, n): the lines with text of every document, numbered."""
    # whole texts are dealt by document, once for all windows and groups over a document's lines
    lines = table(spark, d, "documents", "doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    t = F.trim(F.regexp_replace("line", r"\s+", " "))
    return lines.select("doc_id", "place", t.alias("text"), F.char_length(t).alias("n")).filter("n > 0")


_POINTS = r"""SELECT doc_id, place, t AS text, length(t) AS n FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS place,
trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS t FROM documents) WHERE length(t) > 0"""


def lines_of(text: Column) -> Column:
    """The lines with text of one document, as an array of (place, text): those of `points`."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("place"), F.trim(F.regexp_replace(line, r"\s+", " ")).alias("text")))
    return F.filter(lines, lambda x: x["text"] != "")


def says(text: Column, cues: str) -> Column:
    """Whether a text holds one of the cues. Each is looked for as it is: a pattern of all would be tried from every character."""
    return reduce(or_, (F.contains(text, F.lit(c)) for c in cues.split("|")))


def edges_of(p: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, *keep, from_place, to_place, confidence, rank): each point with the next two of its document, the best rule per pair.

    rank: 1 for numbers, 2 for a basic and an advanced point, 3 for shared words; of equally sure rules the first.
    What the rules look at is computed once a point, before the points meet.
    """
    text = F.col("text")
    p = once(p.select("doc_id", *keep, "place", "text"), {"words": lx.words(text), "number": order_number(text), "basic": says(text, BASIC), "advanced": says(text, ADVANCED)})
    by = Window.partitionBy("doc_id").orderBy("place")
    row = F.struct("place", "words", "number", "advanced")
    pairs = p.select("doc_id", *keep, F.col("place").alias("from_place"), "words", "number", "basic", F.array(*(F.lead(row, i).over(by) for i in (1, 2))).alias("next"))
    pairs = pairs.select("doc_id", *keep, "from_place", "words", "number", "basic", F.posexplode("next").alias("offset", "to")).filter("to is not null")
    pairs = once(pairs, {"shared": F.size(F.array_intersect("words", F.col("to.words")))}).drop("words")
    a, b, shared = F.col("number"), F.col("to.number"), F.col("shared")
    numbered = F.when(a < b, F.when(b - a <= 1, STRONG).otherwise(MEDIUM))
    cue = F.when((shared >= 2) & F.col("basic") & F.col("to.advanced"), STRONG)
    local = F.when((F.col("offset") == 0) & (shared >= 2), MEDIUM).when((F.col("offset") == 1) & (shared >= 3), LIGHT)
    pairs = pairs.withColumn("numbered", numbered).withColumn("cue", cue).withColumn("confidence", F.greatest("numbered", "cue", local)).filter("confidence is not null")
    rank = F.when(F.col("numbered") == F.col("confidence"), 1).when(F.col("cue") == F.col("confidence"), 2).otherwise(3)
    return pairs.select("doc_id", *keep, "from_place", F.col("to.place").alias("to_place"), "confidence", rank.alias("rank"))


_NUMBER = lambda t: f"coalesce(try_cast(nullif(regexp_extract({t}, '^\\s*第\\s*(\\d{{1,9}})\\s*[章节篇条]', 1), '') AS INT), try_cast(nullif(regexp_extract({t}, '^\\s*(\\d{{1,9}})\\s*[.、)\\-:]', 1), '') AS INT))"
_EDGES = f"""WITH p AS ({_POINTS}), q AS (SELECT doc_id, place AS a, text AS l, unnest([lead(place) OVER w, lead(place, 2) OVER w]) AS b, unnest([lead(text) OVER w, lead(text, 2) OVER w]) AS r, unnest([1, 2]) AS o
FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
s AS (SELECT *, {lx.overlap_sql('l', 'r')} AS shared, {_NUMBER('l')} AS x, {_NUMBER('r')} AS y FROM q WHERE b IS NOT NULL)
SELECT doc_id, a AS from_place, b AS to_place, greatest(n, c, w) AS confidence, CASE WHEN n = confidence THEN 1 WHEN c = confidence THEN 2 ELSE 3 END AS rank FROM (SELECT *,
CASE WHEN x < y THEN CASE WHEN y - x <= 1 THEN 0.55::DOUBLE ELSE 0.46::DOUBLE END END AS n,
CASE WHEN shared >= 2 AND regexp_matches(l, '{BASIC}') AND regexp_matches(r, '{ADVANCED}') THEN 0.55::DOUBLE END AS c,
CASE WHEN o = 1 AND shared >= 2 THEN 0.46::DOUBLE WHEN o = 2 AND shared >= 3 THEN 0.38::DOUBLE END AS w FROM s) WHERE confidence IS NOT NULL"""


@query(_EDGES)
def rule_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges_of(points(spark, d))


def rim(line: Column, many: Column) -> Column:
    """Whether a line, numbered from 0, is one of the first or last of its document's, which may lead to another document."""
    return (line < NEAR_DOCUMENTS) | (line >= many - NEAR_DOCUMENTS)


def cross_edges(p: DataFrame) -> DataFrame:
    """(kb, from_doc, from_place, to_doc, to_place, confidence) of p(kb, doc_id, place, text[, rim]): weak edges between documents.

    Points stand in one order per base, by document and place. A numbered or basic point leads to those of the next
    three that belong to another document and share two words with it. Only the first three and last three points of
    a document can be part of such a pair: where points between them are left out, six of one document remain.
    """
    text, edge = F.col("text"), p
    if "rim" not in p.columns:
        by = Window.partitionBy("doc_id")
        edge = p.withColumn("_first", F.row_number().over(by.orderBy("place"))).withColumn("_many", F.count(F.lit(1)).over(by))
        edge = edge.withColumn("rim", rim(F.col("_first") - 1, F.col("_many")))
    edge = edge.filter("rim").select("kb", "doc_id", "place", "text")
    after = followers(edge, "kb", "doc_id", ["doc_id", "place"], NEAR_DOCUMENTS, "doc_id", "place", "text")
    after = after.filter(F.exists("_next", lambda x: x["doc_id"] != F.col("doc_id"))).select("kb", F.col("doc_id").alias("from_doc"), F.col("place").alias("from_place"), "text", "_next")
    # what the rules look at is computed once, only for points before another document's
    after = once(after, {"leads": order_number(text).isNotNull() | says(text, BASIC), "words": lx.words(text)}).filter("leads")
    pairs = after.select("kb", "from_doc", "from_place", "words", F.explode("_next").alias("to")).filter("to.doc_id <> from_doc")
    pairs = pairs.filter(F.size(F.array_intersect("words", lx.words(F.col("to.text")))) >= 2)
    return pairs.select("kb", "from_doc", "from_place", F.col("to.doc_id").alias("to_doc"), F.col("to.place").alias("to_place"), F.lit(LIGHT).alias("confidence"))


@query(f"""WITH p AS (SELECT d.source AS kb, doc_id, place, (place + 1) || '. ' || t.text AS text FROM ({_POINTS}) t JOIN documents d USING (doc_id)),
q AS (SELECT *, unnest([lead(doc_id) OVER w, lead(doc_id, 2) OVER w, lead(doc_id, 3) OVER w]) AS y, unnest([lead(place) OVER w, lead(place, 2) OVER w, lead(place, 3) OVER w]) AS b,
unnest([lead(text) OVER w, lead(text, 2) OVER w, lead(text, 3) OVER w]) AS r FROM p WINDOW w AS (PARTITION BY kb ORDER BY doc_id, place))
SELECT kb, doc_id AS from_doc, place AS from_place, y AS to_doc, b AS to_place, 0.38::DOUBLE AS confidence FROM q WHERE y <> doc_id AND {lx.overlap_sql('text', 'r')} >= 2""")
def cross_document_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between the documents of a base, of points numbered by their places (the test texts carry no numbers)."""
    kbs = table(spark, d, "documents", "doc_id", "source").withColumnRenamed("source", "kb")
    p = points(spark, d).join(kbs, "doc_id")
    return cross_edges(p.withColumn("text", F.concat((F.col("place") + 1).cast("string"), F.lit(". "), F.col("text"))))


def acyclic(edges: list[tuple], max_out: int = MAX_OUT, max_in: int = MAX_IN) -> list[tuple]:
    """Pairs of edges (confidence, rank, a, b), surest first, then by rank, while degrees allow and no cycle closes."""
    out: dict[int, set[int]] = {}
    into: dict[int, int] = {}
    kept = []
    for _, _, a, b in sorted(set(edges), key=lambda e: (-e[0], *e[1:])):
        if a == b or b in out.get(a, ()) or len(out.get(a, ())) >= max_out or into.get(b, 0) >= max_in:
            continue
        todo, seen = [b], {b}
        while todo and a not in seen:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        if a in seen:
            continue
        out.setdefault(a, set()).add(b)
        into[b] = into.get(b, 0) + 1
        kept.append((a, b))
    return kept


def topological(nodes: list[int], edges: list[tuple[int, int]], rank=None) -> list[int]:
    """First in, first out among nodes without open prerequisites, or by rank; nodes in cycles come last, in order."""
    need = dict.fromkeys(nodes, 0)
    after: dict[int, list[int]] = {}
    for a, b in edges:
        need[b] += 1
        after.setdefault(a, []).append(b)
    key = rank or (lambda x: 0)
    ready = deque(sorted(x for x in nodes if not need[x]))
    heap = [(key(x), x) for x in ready]
    heapq.heapify(heap)
    out = []
    while heap if rank else ready:
        x = heapq.heappop(heap)[1] if rank else ready.popleft()
        out.append(x)
        for y in sorted(after.get(x, ())):
            need[y] -= 1
            if not need[y]:
                heapq.heappush(heap, (key(y), y)) if rank else ready.append(y)
    return out + sorted(set(nodes) - set(out))


def bounded_insert(anchor: list, order: list, edges: list[tuple], shift: int = MAX_SHIFT) -> list:
    """The anchor's order with new items, in topological order, where that order has them: after their prerequisites, before their dependents.

    An item of the anchor that has moved by `shift` places already is not moved further, unless prerequisites and
    dependents leave no other place. Where a later item comes too late for both, it follows its prerequisites. The same
    items leave the anchor as it is.
    """
    present, step = set(order), {x: i for i, x in enumerate(order)}
    out = list(dict.fromkeys(x for x in anchor if x in present))
    if not out or len(out) == len(present):
        return out or list(order)
    home = {x: i for i, x in enumerate(out)}
    before: dict = {}
    after: dict = {}
    for a, b in edges:
        before.setdefault(b, set()).add(a)
        after.setdefault(a, set()).add(b)
    for x in (y for y in order if y not in home):
        place = {y: i for i, y in enumerate(out)}
        low = max((place[y] + 1 for y in before.get(x, ()) if y in place), default=0)
        high = max(low, min((place[y] for y in after.get(x, ()) if y in place), default=len(out)))
        moved = max((place[y] + 1 for y, i in home.items() if place[y] - i >= shift), default=0)
        wanted = sum(step[y] < step[x] for y in out)
        floor = max(low, moved) if max(low, moved) <= high else low
        out.insert(min(max(wanted, floor), high), x)
    return out


def modules(steps: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    """Module of each item, from 0: connected parts in order of their first step, large ones cut; one module where nothing is linked."""
    if not links:
        return dict.fromkeys(steps, 0)
    root = {x: x for x in steps}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    parts: dict[int, list[int]] = {}
    for x in steps:
        parts.setdefault(find(x), []).append(x)
    out: dict[int, int] = {}
    n = 0
    for part in parts.values():
        size = len(part) if len(part) <= MODULE else MODULE_PART
        for i, x in enumerate(part):
            out[x] = n + i // size
        n += -(-len(part) // size)
    return out


def paths(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, place, step, depth, prerequisites, dependents) of every point, from the greedy acyclic graph of its document."""
    p = points(spark, d)
    e = edges_of(p).select("doc_id", F.struct("confidence", "rank", "from_place", "to_place").alias("e"))
    nodes = p.groupBy("doc_id").agg(F.array_sort(F.collect_list("place")).alias("nodes"))  # the lines of one document
    graphs = nodes.join(e.groupBy("doc_id").agg(F.collect_list("e").alias("edges")), "doc_id", "left")

    def order(batches):
        for pdf in batches:
            rows = []
            for doc_id, places, found in zip(pdf["doc_id"], pdf["nodes"], pdf["edges"], strict=True):
                links = acyclic([(x["confidence"], x["rank"], x["from_place"], x["to_place"]) for x in (found if found is not None else [])])
                into: dict[int, list[int]] = {}
                outs: dict[int, int] = {}
                for a, b in links:
                    into.setdefault(b, []).append(a)
                    outs[a] = outs.get(a, 0) + 1
                depth: dict[int, int] = {}
                steps = topological(list(places), links)
                module = modules(steps, links)
                for step, x in enumerate(steps, 1):
                    depth[x] = 1 + max((depth[y] for y in into.get(x, ())), default=-1)
                    rows.append((doc_id, x, step, depth[x], len(into.get(x, ())), outs.get(x, 0), module[x]))
            yield pd.DataFrame(rows, columns=["doc_id", "place", "step", "depth", "prerequisites", "dependents", "module"])

    return graphs.mapInPandas(order, "doc_id long, place int, step int, depth int, prerequisites int, dependents int, module int")


@query()
def topo_order(spark: SparkSession, d: str) -> DataFrame:
    return paths(spark, d)


def difficulty(n: Column, pre: Column, out: Column, explained: Column) -> Column:
    """From the lengths of text and explanation, prerequisites and dependents."""
    one = lambda x: F.least(x, F.lit(1.0))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.05), 0.18 + 0.34 * one(n / 80) + 0.24 * one(pre / 3) + 0.14 * one(explained / 120) + 0.1 * one(out / 4))), 3)


def importance(mastery: Column, pre: Column, out: Column) -> Column:
    one = lambda x: F.least(x, F.lit(1.0))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.05), 0.22 + 0.42 * one(out / 5) + 0.2 * one(pre / 3) + 0.16 * (1 - mastery))), 3)


def stage(depth: Column, deepest: Column, hard: Column, ability: str = "intermediate") -> Column:
    c = 0.55 * depth / F.greatest(deepest, F.lit(1)) + 0.45 * hard
    low, mid, high = CUTS[ability]
    return F.when(c < low, STAGES[0]).when(c < mid, STAGES[1]).when(c < high, STAGES[2]).otherwise(STAGES[3])


def minutes(stage_name: Column, hard: Column, n: Column, mastery: Column, explained: Column) -> Column:
    base = F.lit(MINUTES[3])
    for s, m in zip(STAGES[:3], MINUTES[:3], strict=True):
        base = F.when(stage_name == s, m).otherwise(base)
    raw = base + F.least(F.floor(n / 20), F.lit(4)) + F.least(F.floor(explained / 60), F.lit(4)) + F.bround(6 * hard, 0)
    return F.greatest(F.lit(5), F.bround(raw * (1 - F.least(F.lit(0.55), 0.45 * mastery)), 0).cast("int"))


def items(spark: SparkSession, d: str) -> DataFrame:
    """Path items: steps with difficulty, importance, mastery, stage, minutes, module, and whether they are milestones; a line's explanation is the next one.

    Milestones are the last step of each stage and the item of each module that matters most.
    """
    explained = F.coalesce(F.lead("n").over(Window.partitionBy("doc_id").orderBy("place")), F.lit(0))
    p = paths(spark, d).join(points(spark, d).select("doc_id", "place", "n", explained.alias("explained")), ["doc_id", "place"])
    p = p.withColumn("mastery", (F.col("n") % 101) / 100.0)
    p = p.withColumn("difficulty", difficulty(F.col("n"), F.col("prerequisites"), F.col("dependents"), F.col("explained"))).withColumn("importance", importance(F.col("mastery"), F.col("prerequisites"), F.col("dependents")))
    deepest = F.max("depth").over(Window.partitionBy("doc_id"))
    p = p.withColumn("stage", stage(F.col("depth"), deepest, F.col("difficulty")))
    p = p.withColumn("minutes", minutes(F.col("stage"), F.col("difficulty"), F.col("n"), F.col("mastery"), F.col("explained"))).drop("explained")
    last = F.col("step") == F.max("step").over(Window.partitionBy("doc_id", "stage"))
    best = F.row_number().over(Window.partitionBy("doc_id", "module").orderBy(F.desc("importance"), "step")) == 1
    return p.withColumn("milestone", last | best)


@query()
def path_items(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d)


@query()
def anchored_order(spark: SparkSession, d: str) -> DataFrame:
    """Paths whose lines of under 20 characters are new: the order of the others is kept, the new ones are put in."""
    p = paths(spark, d).join(points(spark, d).select("doc_id", "place", "n"), ["doc_id", "place"])
    return anchored(p.select("doc_id", "place", "step"), edges_of(points(spark, d)), p.filter("n >= 20").select("doc_id", "place", "step"))


def anchored(steps: DataFrame, edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, place, shown): where each point of a path (doc_id, place, step) is shown, given the saved order of earlier ones."""
    ordered = lambda df, name: df.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "place"))), lambda x: x["place"]).alias(name))
    links = edges.groupBy("doc_id").agg(F.collect_list(F.struct("from_place", "to_place")).alias("links"))
    whole = ordered(steps, "order").join(ordered(anchors, "anchor"), "doc_id", "left").join(links, "doc_id", "left")

    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, order, anchor, found in zip(pdf["doc_id"], pdf["order"], pdf["anchor"], pdf["links"], strict=True):
                pairs = [(x["from_place"], x["to_place"]) for x in (found if found is not None else [])]
                shown = bounded_insert([] if anchor is None else list(anchor), list(order), pairs)
                rows += [(doc_id, x, i) for i, x in enumerate(shown, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "place", "shown"])

    return whole.mapInPandas(run, "doc_id long, place int, shown int")


def saved_order(steps: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """The order to show, from the anchors kept at a path; they are written anew only if the order has changed."""
    old = versions.current(steps.sparkSession, path)
    shown = anchored(steps, edges, steps.limit(0) if old is None else old.withColumnRenamed("shown", "step"))
    versions.publish(shown, path)
    return versions.current(steps.sparkSession, path)


@query()
def stage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Stages in their fixed order: items, minutes, share mastered, the milestone (the last of their items that is one: the last step)."""
    s = items(spark, d).groupBy("doc_id", "stage")
    out = s.agg(F.count(F.lit(1)).alias("items"), F.sum("minutes").alias("minutes"), F.round(F.avg((F.col("mastery") >= learner.MASTERED).cast("double")), 3).alias("mastered"), F.max_by("place", F.when(F.col("milestone"), F.col("step"))).alias("milestone"))
    return out.withColumn("position", F.array_position(F.array(*(F.lit(x) for x in STAGES)), F.col("stage")).cast("int"))


@query()
def module_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Modules: items, minutes and the item that matters most."""
    return items(spark, d).groupBy("doc_id", "module").agg(F.count(F.lit(1)).alias("items"), F.sum("minutes").alias("minutes"), F.max_by("place", F.struct("importance", -F.col("step"))).alias("milestone"))


@query()
def path_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of each path: items, completed ones and their share, minutes, stages, modules, the first stage with open items."""
    i, done = items(spark, d), F.col("mastery") >= learner.MASTERED
    number = F.array_position(F.array(*(F.lit(x) for x in STAGES)), F.col("stage"))
    open_stage = F.min(F.when(~done, F.struct(number.alias("n"), F.col("stage").alias("stage"))))["stage"]
    return i.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(done).alias("completed"),
        F.round(F.avg(done.cast("double")), 4).alias("completion"),
        F.sum("minutes").alias("minutes"),
        F.countDistinct("stage").alias("stages"),
        F.countDistinct("module").alias("modules"),
        F.coalesce(open_stage, F.lit("completed")).alias("current_stage"),
    )


@query(f"""WITH e AS ({_EDGES}), m AS (SELECT doc_id, place, (n % 101) / 100.0 AS mastery FROM ({_POINTS}))
SELECT m.doc_id, m.place FROM m WHERE NOT EXISTS (SELECT 1 FROM e JOIN m x ON e.doc_id = x.doc_id AND e.from_place = x.place WHERE e.doc_id = m.doc_id AND e.to_place = m.place AND x.mastery < 0.6)""")
def unlocked(spark: SparkSession, d: str) -> DataFrame:
    """Points whose prerequisites (by rule edges) are all mastered to 0.6."""
    p = points(spark, d)
    low = p.filter((F.col("n") % 101) / 100.0 < 0.6).select("doc_id", F.col("place").alias("from_place"))
    blocked = edges_of(p).join(low, ["doc_id", "from_place"]).select("doc_id", F.col("to_place").alias("place"))
    return p.select("doc_id", "place").join(blocked, ["doc_id", "place"], "left_anti")


QUERIES: dict[str, Callable] = catalogue.queries
ORACLES: dict[str, str] = catalogue.oracles
