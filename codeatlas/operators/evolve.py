"""Incremental maintenance: changes are rows (op, path, from_path), results are new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_regex
from ..schema import CodeGraph
from ..session import cut
from .graph import containment, data_flow, edges_of, module_entities, populate_dependencies


def hidden(path: Column, ignored: list[str]) -> Column:
    out = F.lit(False)
    for regex in filter(None, map(glob_regex, ignored)):
        out = out | path.rlike(regex)
    return out


def keep_changes(changes: DataFrame, extensions: list[str], ignored: list[str]) -> DataFrame:
    """Changes of source files that aren't ignored.  A rename to an ignored place or to a name that is no
    source is a deletion; one from such a name to a source is an addition."""
    good = lambda c: F.col(c).rlike(r"\.(" + "|".join(extensions) + ")$") & ~hidden(F.col(c), ignored)
    to, was, renamed = good("path"), F.coalesce(good("from_path"), F.lit(False)), F.col("op") == "renamed"
    op = F.when(renamed & ~to, F.when(was, "deleted")).when(renamed & ~was, "added").when(to, F.col("op"))
    out = changes.select(op.alias("op"), F.when(renamed & ~to, F.col("from_path")).otherwise(F.col("path")).alias("path"), "from_path").filter("op IS NOT NULL")
    return out.withColumn("from_path", F.when(F.col("op") == "renamed", F.col("from_path")))


def newly_ignored(entities: DataFrame, ignored: list[str]) -> DataFrame:
    """Deletions of files that are in the graph and now ignored."""
    return _deletions(entities.filter(hidden(F.col("file"), ignored)))


def vanished(entities: DataFrame, files: DataFrame) -> DataFrame:
    """Deletions of files that are in the graph and not in ``files`` (path) any more."""
    return _deletions(entities.join(files.select(F.col("path").alias("file")), "file", "left_anti"))


def _deletions(entities: DataFrame) -> DataFrame:
    return entities.select(F.lit("deleted").alias("op"), F.col("file").alias("path"), F.lit(None).cast("string").alias("from_path")).distinct()


def apply_renames(graph: CodeGraph, renames: DataFrame) -> CodeGraph:
    """Ids, files, edge ends and references follow (path, from_path); places in the hierarchy stay."""
    moves = renames.select(F.col("from_path").alias("file"), F.col("path").alias("new_file"))
    renamed = lambda c: F.when(F.col("new_file").isNotNull(), F.concat("new_file", F.substring(F.col(c), F.length("file") + 1, F.length(F.col(c))))).otherwise(F.col(c))
    moved = graph.entities.join(moves, "file", "left").withColumn("new_id", renamed("id"))
    ids = moved.filter("new_file IS NOT NULL").select(F.col("id").alias("old"), "new_id")
    entities = moved.withColumn("id", F.col("new_id")).withColumn("file", F.coalesce("new_file", "file")).select(graph.entities.columns)
    edges = graph.edges.join(ids.withColumnsRenamed({"old": "source", "new_id": "s"}), "source", "left").join(ids.withColumnsRenamed({"old": "target", "new_id": "t"}), "target", "left")
    edges = edges.select(F.coalesce("s", "source").alias("source"), F.coalesce("t", "target").alias("target"), "kind")
    references = graph.references
    if references is not None:
        references = references.join(moves, "file", "left").withColumn("source", renamed("source")).withColumn("file", F.coalesce("new_file", "file")).select("source", "file", "name", "kind")
    return CodeGraph(entities, edges, references)


def merge_versions(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """(id, status) in touched files: added, removed, kept."""
    o = old.join(touched.select("file"), "file", "left_semi").filter("kind <> 'module'").select("id", F.lit(1).alias("o"))
    n = new.select("id", F.lit(1).alias("n"))
    return o.join(n, "id", "full").select("id", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("kept").alias("status"))


def apply_changes(graph: CodeGraph, changes: DataFrame, parsed: DataFrame, raw: DataFrame | None = None) -> CodeGraph:
    """The graph after deletions, renames, modifications and additions, in this order.  ``parsed``
    has the entities of all files that are new or modified, ``raw`` their references; those that were
    there keep features, path and source of features, new ones take a sibling's path.  Modules of
    touched and renamed files are made anew and keep theirs.  References of touched files are taken
    from ``raw``, and all edges are resolved again: names elsewhere may have become known, unknown or
    ambiguous.  Without references (a graph that has none) edges between entities that are left stay;
    data flow and containment are made again if the graph had any."""
    deleted = changes.filter("op = 'deleted'").select(F.col("path").alias("file")).distinct()
    graph = CodeGraph(graph.entities.join(deleted, "file", "left_anti").select(graph.entities.columns), graph.edges, graph.references)
    renames = changes.filter("op = 'renamed'").select("path", "from_path")
    graph = apply_renames(graph, renames)
    touched = changes.filter("op IN ('modified', 'added')").select(F.col("path").alias("file")).distinct()
    before = graph.entities.join(touched, "file", "left_semi").filter("kind <> 'module'")
    keep = before.select("id", F.col("semantic_features").alias("f0"), F.col("hierarchy_path").alias("h0"), F.col("feature_source").alias("s0"))
    sibling = before.groupBy("file").agg(F.min("hierarchy_path").alias("h1"))
    fresh = parsed.join(touched, "file", "left_semi").join(keep, "id", "left").join(sibling, "file", "left")
    fresh = fresh.withColumns({"semantic_features": F.coalesce("f0", "semantic_features"), "feature_source": F.coalesce("s0", "feature_source"), "hierarchy_path": F.coalesce("h0", "h1", "hierarchy_path")}).select(graph.entities.columns)
    had = graph.entities.filter("kind = 'module'").select("file")
    again = touched.unionByName(renames.select(F.col("path").alias("file")).join(had, "file", "left_semi")).distinct()
    old_modules = graph.entities.filter("kind = 'module'").join(again, "file", "left_semi")
    stay = graph.entities.join(touched, "file", "left_anti").join(old_modules.select("id"), "id", "left_anti").select(graph.entities.columns)
    entities = stay.unionByName(fresh)
    modules = module_entities(entities.join(again, "file", "left_semi"))
    kept = old_modules.groupBy("file").agg(F.first("semantic_features").alias("f0"), F.min("hierarchy_path").alias("h0"), F.min("feature_source").alias("feature_source"))
    place = entities.groupBy("file").agg(F.min("hierarchy_path").alias("h1"))
    modules = modules.join(kept, "file", "left").join(place, "file", "left").withColumns({"semantic_features": F.coalesce("f0", F.array().cast("array<string>")), "hierarchy_path": F.coalesce("h0", "h1")}).drop("f0", "h0", "h1")
    entities = cut(entities.unionByName(modules, allowMissingColumns=True))
    references = graph.references
    if references is not None:
        gone = touched.unionByName(deleted).distinct()
        references = references.join(gone, "file", "left_anti").select("source", "file", "name", "kind")
        if raw is not None:
            references = references.unionByName(populate_dependencies(entities.join(touched, "file", "left_semi"), raw.join(touched, "file", "left_semi")))
        references = cut(references)
        return CodeGraph(entities, cut(edges_of(entities, references)), references)
    left = entities.select("id")
    had = {r.kind for r in graph.edges.select("kind").distinct().collect()}  # at most the ten kinds
    edges = graph.edges.filter("kind NOT IN ('data_flow', 'contains')").join(left.withColumnRenamed("id", "source"), "source", "left_semi").join(left.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "kind")
    out = edges.unionByName(data_flow(entities, edges)) if "data_flow" in had else edges
    return CodeGraph(entities, out.unionByName(containment(entities)) if "contains" in had else out)


def stale(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """(id) that stayed in modified files and have features."""
    kept = merge_versions(old, new, touched).filter("status = 'kept'")
    return old.filter("size(semantic_features) > 0").join(kept, "id", "left_semi").select("id")


def merge_features(new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New entities with the old features and paths by id, and one row of counts: restored, orphaned, new."""
    o = old.select("id", F.col("semantic_features").alias("f0"), F.col("hierarchy_path").alias("h0"))
    out = new.join(o, "id", "left").withColumns({"semantic_features": F.when(F.size("f0") > 0, F.col("f0")).otherwise(F.col("semantic_features")), "hierarchy_path": F.coalesce(F.nullif("h0", F.lit("")), F.col("hierarchy_path"))})
    both = old.filter("size(semantic_features) > 0").select("id", F.lit(1).alias("o")).join(new.select("id", F.lit(1).alias("n")), "id", "full")
    counts = both.agg(F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("restored"), F.count_if(F.col("n").isNull()).alias("orphaned"), F.count_if(F.col("o").isNull()).alias("new"))
    return out.select(new.columns), counts


def changeset_hash(changes: DataFrame) -> DataFrame:
    """One row: a digest of all changes whatever their order: the sorted digests of (op, path, size,
    mtime) by 256 groups, and of those."""
    row = F.sha2(F.concat_ws("|", "op", "path", F.col("size").cast("string"), F.col("mtime").cast("string")), 256)
    groups = changes.select(row.alias("h")).groupBy(F.substring("h", 1, 2).alias("g")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return groups.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("changeset"))


def diff_report(changes: DataFrame) -> DataFrame:
    return changes.groupBy("op").agg(F.count(F.lit(1)).alias("files"))
