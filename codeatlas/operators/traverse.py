"""Traversals.  Each keeps the frontier as a DataFrame, joins it with the edges once a hop, and
cuts lineage in the shared folder; loops on the driver run over hops only."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEPENDENCY_KINDS, EDGE_KINDS, check_kinds, kind_ord
from ..session import cut


def directed(edges: DataFrame, direction: str, kinds: list[str] | None) -> DataFrame:
    """(at, next, kind, way): downstream, upstream or both."""
    check_kinds(kinds, EDGE_KINDS)
    rows = edges.filter(F.col("kind").isin(kinds)) if kinds else edges
    down = F.struct(F.col("source").alias("at"), F.col("target").alias("next"), F.lit("downstream").alias("way"))
    up = F.struct(F.col("target").alias("at"), F.col("source").alias("next"), F.lit("upstream").alias("way"))
    ways = {"downstream": [down], "upstream": [up], "both": [down, up]}[direction]
    return rows.select("kind", F.explode(F.array(*ways)).alias("w")).select("w.at", "w.next", "kind", "w.way")


def neighbours(edges: DataFrame, start: str, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
    return directed(edges, direction, kinds).filter(F.col("at") == start).select(F.col("next").alias("id"), "kind", F.col("way").alias("direction"))


def explore(edges: DataFrame, entities: DataFrame, start: str, direction: str = "downstream", depth: int = 2, kinds: list[str] | None = None, entity_kinds: list[str] | None = None) -> DataFrame:
    """(id, depth, parent, kind): the breadth-first tree; a node's parent is the smallest of those
    that reach it first.  Entities of other kinds than ``entity_kinds`` are not entered; nodes
    of the hierarchy are.  Depth -1 has no bound."""
    links = directed(edges, direction, kinds)
    if entity_kinds:
        closed = entities.filter(~F.col("kind").isin(entity_kinds)).select(F.col("id").alias("next"))
        links = links.join(closed, "next", "left_anti").select("at", "next", "kind", "way")
    fronts = [edges.sparkSession.createDataFrame([(start, 0, None, None)], "id string, depth int, parent string, kind string")]
    for hop in count(1):
        if 0 <= depth < hop:
            break
        front = fronts[-1].select(F.col("id").alias("at"))
        found = links.join(front, "at").groupBy(F.col("next").alias("id")).agg(F.min(F.struct(F.col("at"), kind_ord(F.col("kind")).alias("o"), F.col("kind"))).alias("m"))
        for seen in fronts:
            found = found.join(seen.select("id"), "id", "left_anti")
        found = cut(found.select("id", F.lit(hop).alias("depth"), F.col("m.at").alias("parent"), F.col("m.kind").alias("kind")))
        if not found.limit(1).count():
            break
        fronts.append(found)
        if len(fronts) > 16:  # long chains: what was seen before becomes one table
            fronts = [cut(reduce(DataFrame.unionByName, fronts[:-1])), fronts[-1]]
    return reduce(DataFrame.unionByName, fronts)


def impact_radius(edges: DataFrame, start: str, direction: str = "upstream", depth: int = 3, kinds: list[str] | None = None, most: int = 100) -> DataFrame:
    """(id, depth, path): what is reached over dependency edges, first discovery first, at most
    ``most``; the path lists predecessors and edge kinds from the start."""
    links = directed(edges, direction, kinds or DEPENDENCY_KINDS)
    fronts = [edges.sparkSession.createDataFrame([(start, 0, [])], "id string, depth int, path array<struct<id:string,kind:string>>")]
    for hop in range(1, depth + 1):
        front = fronts[-1].select(F.col("id").alias("at"), "path")
        found = links.join(front, "at").groupBy(F.col("next").alias("id")).agg(F.min(F.struct("at", kind_ord(F.col("kind")).alias("o"), "kind", "path")).alias("m"))
        for seen in fronts:
            found = found.join(seen.select("id"), "id", "left_anti")
        step = F.concat("m.path", F.array(F.struct(F.col("m.at").alias("id"), F.col("m.kind").alias("kind"))))
        fronts.append(cut(found.select("id", F.lit(hop).alias("depth"), step.alias("path"))))
    return reduce(DataFrame.unionByName, fronts).filter("depth > 0").orderBy("depth", "id").limit(most)


def reached(edges: DataFrame, roots: list[str], direction: str = "upstream", depth: int = 2, kinds: list[str] | None = None) -> DataFrame:
    """(root, id, depth): what each root reaches over dependency edges, in one search for all roots."""
    links = directed(edges, direction, kinds or DEPENDENCY_KINDS).select("at", "next").distinct()
    fronts = [edges.sparkSession.createDataFrame([(r, r, 0) for r in sorted(set(roots))], "root string, id string, depth int")]
    for hop in range(1, depth + 1):
        found = links.join(fronts[-1].select("root", F.col("id").alias("at")), "at").select("root", F.col("next").alias("id")).distinct()
        for seen in fronts:
            found = found.join(seen.select("root", "id"), ["root", "id"], "left_anti")
        fronts.append(cut(found.select("root", "id", F.lit(hop).alias("depth"))))
    return reduce(DataFrame.unionByName, fronts)


def find_paths(edges: DataFrame, source: str, target: str, hops: int = 5, most: int = 3, kinds: list[str] | None = None) -> DataFrame:
    """(path, length): the shortest simple paths, by length, then by ids; source to itself has none.
    Only vertices that can still reach the target within the hops that are left are entered."""
    links = directed(edges, "downstream", kinds).select("at", "next").distinct()
    back = explore(edges, edges, target, "upstream", hops, kinds).select(F.col("id").alias("next"), F.col("depth").alias("left"))
    links = cut(links.join(back, "next"))
    spark = edges.sparkSession
    grown = spark.createDataFrame([([source],)], "path array<string>")
    found = spark.createDataFrame([], "path array<string>, length int")
    for hop in range(1, hops + 1):
        ahead = grown.withColumn("at", F.element_at("path", -1)).join(links.filter(F.col("left") <= hops - hop), "at").filter("NOT array_contains(path, next)")
        ahead = cut(ahead.select(F.concat("path", F.array("next")).alias("path"), "next"))
        found = found.unionByName(ahead.filter(F.col("next") == target).select("path", F.lit(hop).alias("length")))
        if found.count() >= most:
            break
        grown = ahead.filter(F.col("next") != target).select("path")
    return found.orderBy("length", "path").limit(most)


def slice_between(edges: DataFrame, ids: list[str], depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that connect the ids: for every pair a shortest undirected path within
    ``depth`` edges, that with the smallest ids from its end.  One search runs for all ids at once."""
    if len(set(ids)) < 2:
        raise ValueError("two ids at least")
    links = directed(edges, "both", None).select("at", "next").distinct()
    spark = edges.sparkSession
    seen = spark.createDataFrame([(i, i, 0, None) for i in sorted(set(ids))], "root string, id string, depth int, parent string")
    for hop in range(depth):
        front = seen.filter(F.col("depth") == hop).select("root", F.col("id").alias("at"))
        found = links.join(front, "at").groupBy("root", F.col("next").alias("id")).agg(F.min("at").alias("parent")).join(seen.select("root", "id"), ["root", "id"], "left_anti")
        seen = cut(seen.unionByName(found.select("root", "id", F.lit(hop + 1).alias("depth"), "parent")))
    path = seen.filter(F.col("id").isin(ids) & (F.col("root") < F.col("id"))).select("root", F.col("id").alias("end"), "id", "parent")
    nodes, steps = path.select("id"), path.select("id", "parent")
    for _ in range(depth):
        path = path.select("root", "end", F.col("parent").alias("id")).filter("id IS NOT NULL").join(seen.select("root", "id", "parent"), ["root", "id"])
        nodes, steps = nodes.unionByName(path.select("id")), steps.unionByName(path.select("id", "parent"))
    steps = steps.filter("parent IS NOT NULL").distinct()
    either = steps.select(F.explode(F.array(F.struct(F.col("id").alias("source"), F.col("parent").alias("target")), F.struct(F.col("parent").alias("source"), F.col("id").alias("target")))).alias("s")).select("s.*").distinct()
    kept = edges.join(either, ["source", "target"]).groupBy("source", "target").agg(F.min(F.struct(kind_ord(F.col("kind")).alias("o"), "kind")).alias("m")).select("source", "target", "m.kind")
    return nodes.distinct(), kept


def fetch(entities: DataFrame, ids: list[str]) -> DataFrame:
    """(id, name, kind, hierarchy_path, siblings): entities and how many share their place."""
    wanted = entities.filter(F.col("id").isin(ids)).select("id", "name", "kind", "hierarchy_path")
    places = entities.join(F.broadcast(wanted.select("hierarchy_path").distinct()), "hierarchy_path", "left_semi").groupBy("hierarchy_path").agg((F.count(F.lit(1)) - 1).alias("siblings"))
    return wanted.join(places, "hierarchy_path")


def fetch_node(entities: DataFrame, path: str) -> DataFrame:
    """(children, entity_count) of a hierarchy node."""
    below = entities.filter(F.col("hierarchy_path").startswith(path + "/") | (F.col("hierarchy_path") == path))
    child = F.regexp_extract(F.substring(F.col("hierarchy_path"), len(path) + 2, 10_000), "^[^/]+", 0)
    return below.agg(F.array_join(F.sort_array(F.collect_set(F.nullif(child, F.lit("")))), ",").alias("children"), F.count(F.lit(1)).alias("entity_count"))


#: Parts of an entity that can be asked for (fixed values).
FIELDS = ["features", "source", "deps", "hierarchy"]


def project(entities: DataFrame, edges: DataFrame, ids: list[str], fields: list[str], sources: DataFrame | None = None, source_max_lines: int | None = None) -> DataFrame:
    """(id, name, kind, file) of the ids and the ``fields`` asked for: features, deps (sorted (way, kind, id)),
    hierarchy, source (lines of ``sources`` (file, content), ``source_max_lines`` at most).  An unknown field is an error."""
    unknown = sorted(set(fields) - set(FIELDS))
    if unknown:
        raise ValueError(f"unknown fields {unknown}, known are {FIELDS}")
    out, kept = entities.filter(F.col("id").isin(ids)), ["id", "name", "kind", "file"]
    if "features" in fields:
        out, kept = out.withColumn("features", F.col("semantic_features")), [*kept, "features"]
    if "hierarchy" in fields:
        out, kept = out.withColumn("hierarchy", F.col("hierarchy_path")), [*kept, "hierarchy"]
    if "deps" in fields:
        near = directed(edges, "both", DEPENDENCY_KINDS).filter(F.col("at").isin(ids)).distinct()
        near = near.groupBy(F.col("at").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("way"), F.col("kind"), F.col("next").alias("id")))).alias("deps"))
        out, kept = out.join(near, "id", "left"), [*kept, "deps"]
    if "source" in fields:
        if sources is None:
            raise ValueError("source needs the files' contents")
        out = out.join(sources.select("file", "content"), "file", "left").withColumn("source", source_slice(F.col("content"), F.col("line_start"), F.col("line_end"), source_max_lines))
        kept = [*kept, "source"]
    return out.select(kept)


def source_slice(content, line_start, line_end, most: int | None = None):
    """The lines of an entity as a column."""
    n = line_end - line_start + 1
    return F.array_join(F.slice(F.split(content, "\n"), line_start, F.least(n, F.lit(most)) if most else n), "\n")


def within_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """Rows (id, score, tokens) while their running sum stays within the budget; ``ranked`` is a list
    already cut to a top k."""
    total = F.sum("tokens").over(Window.orderBy(F.round("score", 9).desc(), "id").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("running", total).filter(F.col("running") <= budget)


def context_pack(entities: DataFrame, edges: DataFrame, query: str, scope: str = "", budget: int = 4000, depth: int = 1, k: int = 10) -> DataFrame:
    """(id, role, score, tokens, running): search hits and their neighbours, cut to a token budget.  A row
    has two tokens at least, so no more than half the budget's number of rows can fit."""
    from .search import filtered, search_auto

    hits = cut(search_auto(filtered(entities, scope), query, k))
    near = hits.select("id")
    for _ in range(depth):
        links = directed(edges, "both", None)
        near = near.unionByName(links.join(near.select(F.col("id").alias("at")), "at", "left_semi").select(F.col("next").alias("id")).filter("NOT startswith(id, 'h:')")).distinct()
    rows = near.join(hits, "id", "left").join(entities, "id")
    size = F.ceil((F.length("id") + F.length("name") + F.length(F.array_join("semantic_features", ", "))) / 4) + 1
    rows = rows.select("id", F.when(F.col("score").isNull(), "neighbour").otherwise("hit").alias("role"), F.coalesce("score", F.lit(0.0)).alias("score"), size.cast("long").alias("tokens"))
    return within_budget(rows.orderBy(F.round("score", 9).desc(), "id").limit(budget // 2 + 1), budget)
