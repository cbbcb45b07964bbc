"""The hierarchy as materialised paths, and rollups over their prefixes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_regex
from ..session import cut
from .order import numbered


def structural_path(file: Column) -> Column:
    """One part: its stem; two: directory/stem; more: directory/subdirectory/stem."""
    parts = F.split(file, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    n = F.size(parts)
    return F.when(n == 1, stem).when(n == 2, F.concat_ws("/", parts[0], stem)).otherwise(F.concat_ws("/", parts[0], F.get(parts, F.lit(1)), stem))


def prefixes(path: Column) -> Column:
    """All paths from the first part down to the whole."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def nodes(entities: DataFrame) -> DataFrame:
    """(node_id, path, level, name, parent_id) of every node that holds entities."""
    # Paths first: a node is shared by many entities.
    paths = entities.filter("hierarchy_path <> ''").select("hierarchy_path").distinct().select(F.explode(prefixes(F.col("hierarchy_path"))).alias("path")).distinct()
    parts = F.split("path", "/")
    parent = F.when(F.size(parts) > 1, F.concat(F.lit("h:"), F.regexp_replace("path", "/[^/]*$", "")))
    return paths.select(F.concat(F.lit("h:"), "path").alias("node_id"), "path", F.size(parts).alias("level"), F.element_at(parts, -1).alias("name"), parent.alias("parent_id"))


def entity_counts(entities: DataFrame) -> DataFrame:
    """(path, entity_count) of each subtree: leaves are counted first, then their prefixes."""
    leaves = entities.filter("hierarchy_path <> ''").groupBy("hierarchy_path").agg(F.count(F.lit(1)).alias("n"))
    return leaves.select(F.explode(prefixes(F.col("hierarchy_path"))).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("entity_count"))


def feature_rows(entities: DataFrame) -> DataFrame:
    """(path, feature) of each subtree, distinct: features of a place first, then of the places above, so
    that no row holds a subtree."""
    leaves = entities.filter("hierarchy_path <> ''").select("hierarchy_path", F.explode("semantic_features").alias("feature")).distinct()
    return leaves.select(F.explode(prefixes(F.col("hierarchy_path"))).alias("path"), "feature").distinct()


def feature_counts(entities: DataFrame) -> DataFrame:
    """(path, feature, n): of how many entities of each subtree it is a feature."""
    rows = entities.filter("hierarchy_path <> ''").select("hierarchy_path", F.explode(F.array_distinct("semantic_features")).alias("feature"))
    leaves = rows.groupBy("hierarchy_path", "feature").agg(F.count(F.lit(1)).alias("n"))
    return leaves.select(F.explode(prefixes(F.col("hierarchy_path"))).alias("path"), "feature", "n").groupBy("path", "feature").agg(F.sum("n").alias("n"))


def features(entities: DataFrame) -> DataFrame:
    """(path, features) of each subtree, sorted and distinct; ``feature_rows`` has the same in rows."""
    return feature_rows(entities).groupBy("path").agg(F.sort_array(F.collect_list("feature")).alias("features"))


def grounding(entities: DataFrame) -> DataFrame:
    """(path, grounded): the longest common directory of the files below each node, from the
    first and last directory in order."""
    folder = F.when(F.instr("file", "/") > 0, F.regexp_replace("file", "/[^/]*$", "")).otherwise(F.lit(""))
    up = entities.filter("hierarchy_path <> ''").select("hierarchy_path", F.split(folder, "/").alias("d")).distinct()
    up = up.groupBy("hierarchy_path").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).select(F.explode(prefixes(F.col("hierarchy_path"))).alias("path"), "lo", "hi")
    ends = up.groupBy("path").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    same = F.filter(F.sequence(F.lit(1), F.least(F.size("lo"), F.size("hi"))), lambda i: F.slice("lo", 1, i) == F.slice("hi", 1, i))
    return ends.select("path", F.array_join(F.slice("lo", 1, F.greatest(F.size(same), F.lit(0))), "/").alias("grounded"))


def apply_assignments(entities: DataFrame, assigned: DataFrame) -> DataFrame:
    """Entities with new paths from (key, path): key is an id, else a name that is unique; a
    module's path goes to all entities of its file."""
    by_id = assigned.select(F.col("key").alias("id"), F.col("path").alias("by_id"))
    unique = entities.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only")).filter("n = 1")
    left = assigned.join(entities.select(F.col("id").alias("key")), "key", "left_anti")
    by_name = left.join(unique, left.key == unique.name).select(F.col("only").alias("id"), F.col("path").alias("by_name"))
    out = entities.join(by_id, "id", "left").join(by_name, "id", "left").withColumn("own", F.coalesce("by_id", "by_name"))
    modules = out.filter("kind = 'module' AND own IS NOT NULL").groupBy("file").agg(F.max("own").alias("of_file"))
    out = out.join(modules, "file", "left").withColumn("hierarchy_path", F.coalesce("own", "of_file", "hierarchy_path"))
    return out.select(entities.columns)


def file_clusters(entities: DataFrame, target: int = 70) -> DataFrame:
    """Module files in order, cut into runs of ``target``: (cluster, files, representatives), the
    latter three evenly spaced."""
    files = entities.filter("kind = 'module'").select("file").distinct()
    rows = numbered(files, ["file"]).withColumn("cluster", F.expr(f"pos div {target}"))
    out = rows.groupBy("cluster").agg(F.sort_array(F.collect_list("file")).alias("f"))
    pick = F.array_distinct(F.array(F.element_at("f", 1), F.element_at("f", F.expr("cast(size(f) div 2 as int) + 1")), F.element_at("f", -1)))
    return out.select("cluster", F.size("f").alias("files"), F.array_join(pick, ",").alias("representatives"))


def best_paths(items: DataFrame, tree: DataFrame, least: float = 0.05, depth: int = 3) -> DataFrame:
    """(id, best_path): the top-down walk that takes the most similar area, at least ``least``, and then
    children while strictly more similar.  ``items`` (id, features), ``tree`` (path, features) or
    (path, feature).  An item meets the areas, and then only the children of the place it has come to."""
    rows = tree.select("path", F.explode(F.array_distinct("features")).alias("f")) if "features" in tree.columns else tree.select("path", F.col("feature").alias("f"))
    wanted = items.select("id", F.size(F.array_distinct("features")).alias("k"), F.explode(F.array_distinct("features")).alias("f"))
    return _walk(cut(wanted), rows, least, depth)


def _walk(wanted: DataFrame, rows: DataFrame, least: float, depth: int, without: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, best_path) for ``wanted`` (id, k features in all, f) in ``rows`` (path, f and more), distinct by
    path and f; ``without`` corrects the rows (id, path, f, m features in all) where an item meets a place."""
    level, above = F.size(F.split("path", "/")), F.regexp_replace("path", "/[^/]*$", "")
    sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("m"))
    below = cut(rows.join(sizes, "path").withColumns({"level": level, "above": F.when(level > 1, above)}).filter(F.col("level") <= depth))
    done, here = [], None
    for k in range(1, depth + 1):
        places = below.filter(F.col("level") == k).drop("level")
        met = wanted.join(places, "f") if here is None else wanted.join(here.select("id", F.col("path").alias("above"), F.col("sim").alias("was")), "id").join(places, ["f", "above"])
        met = without(met) if without else met
        sim = F.count(F.lit(1)) / (F.first("k") + F.first("m") - F.count(F.lit(1)))
        was = [] if here is None else [F.first("was").alias("was")]
        sims = met.groupBy("id", "path").agg(sim.alias("sim"), *was).filter(F.col("sim") >= least if here is None else F.col("sim") > F.col("was"))
        best = sims.groupBy("id").agg(F.min(F.struct((-F.col("sim")).alias("s"), "path")).alias("b"))
        here = cut(best.select("id", "b.path", (-F.col("b.s")).alias("sim")))
        done.append(here.select("id", F.struct(F.lit(k).alias("level"), "path").alias("p")))
    return reduce(DataFrame.unionByName, done).groupBy("id").agg(F.max("p").alias("p")).select("id", F.col("p.path").alias("best_path"))


def resolve_scope(entities: DataFrame, scope: str) -> DataFrame:
    """(id) of a scope for lifting, the first reading that fits: ``*`` or ``all`` are the entities without
    features, modules aside; a file glob; a place in the hierarchy and what lies below, if there is any; ids
    separated by commas.  Ids that are not there are left out."""
    scope = scope.strip()
    if scope == "*" or scope.lower() == "all":
        return entities.filter("kind <> 'module' AND coalesce(size(semantic_features), 0) <= 0").select("id")
    regex = glob_regex(scope) if set("*?") & set(scope) else None
    if regex:
        return entities.filter(F.col("file").rlike(regex)).select("id")
    below = entities.filter((F.col("hierarchy_path") == scope) | F.startswith("hierarchy_path", F.lit(scope + "/")))
    if scope and below.limit(1).count():
        return below.select("id")
    return entities.filter(F.col("id").isin([i.strip() for i in scope.split(",")])).select("id")


def in_scope(path: Column, scope: str) -> Column:
    """Empty or ``.``: all; else any of the comma-separated paths or what lies below; unknown
    paths match nothing."""
    parts = [p.strip() for p in scope.split(",")]
    if scope.strip() in ("", ".") or "." in parts:
        return F.lit(True)
    some = [(path == p) | path.startswith(p + "/") for p in parts if p]
    out = F.lit(False)
    for s in some:
        out = out | s
    return out


def three_levels(path: Column) -> Column:
    """Whether a path has exactly three parts, none blank."""
    parts = F.split(path, "/")
    return (F.size(parts) == 3) & F.forall(parts, lambda p: F.trim(p) != "")


def coverage(entities: DataFrame) -> DataFrame:
    """(area, lifted, total) with modules, as areas count them."""
    area = F.substring_index("hierarchy_path", "/", 1)
    return entities.filter("hierarchy_path <> ''").groupBy(area.alias("area")).agg(F.count_if(F.size("semantic_features") > 0).alias("lifted"), F.count(F.lit(1)).alias("total"))


def coverage_overall(entities: DataFrame) -> DataFrame:
    """One row (lifted, total) without modules."""
    return entities.filter("kind <> 'module'").agg(F.count_if(F.size("semantic_features") > 0).alias("lifted"), F.count(F.lit(1)).alias("total"))


def unlifted_by_file(entities: DataFrame) -> DataFrame:
    """(file, unlifted): how many entities of each file have no features, without modules; files with most
    come first in order of (unlifted, file)."""
    rows = entities.filter("kind <> 'module' AND coalesce(size(semantic_features), 0) <= 0")
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("unlifted")).orderBy(F.desc("unlifted"), "file")


def display_info(entities: DataFrame, ids: list[str]) -> DataFrame:
    """(id, name, description) of entities and of hierarchy nodes (``h:`` and a path); unknown ids are left out."""
    own = entities.filter(F.col("id").isin(ids)).select("id", "name", F.concat("kind", F.lit(" in "), "file").alias("description"))
    paths = [i[2:] for i in ids if i.startswith("h:")]
    counted = entity_counts(entities).filter(F.col("path").isin(paths)).join(grounding(entities), "path")
    about = F.concat(F.lit("hierarchy node ("), F.col("entity_count").cast("string"), F.lit(" entities"), F.when(F.col("grounded") != "", F.concat(F.lit(", grounded: "), "grounded")).otherwise(""), F.lit(")"))
    return own.unionByName(counted.select(F.concat(F.lit("h:"), "path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), about.alias("description")))


def reroute(entities: DataFrame, tree: DataFrame, drifted: DataFrame, threshold: float = 0.5, least: float = 0.05, depth: int = 3) -> DataFrame:
    """Entities with new paths where their drift (id, drift) is over the threshold: the top-down walk of
    ``best_paths`` in a tree without what the entity itself gave; without such a path the old one stays.
    ``tree`` has counts (path, feature, n): how many entities below a path have a feature."""
    moving = cut(entities.join(drifted.filter(F.col("drift") > threshold).select("id").distinct(), "id").select("id", "hierarchy_path", F.array_distinct("semantic_features").alias("fs")))
    own = moving.select("id", "fs", F.explode(prefixes(F.col("hierarchy_path"))).alias("path")).select("id", "path", F.explode("fs").alias("f"), F.lit(1).alias("mine"))
    counts = tree.select("path", F.col("feature").alias("f"), "n")
    lost = own.join(counts.filter("n = 1"), ["path", "f"]).groupBy("id", "path").agg(F.count(F.lit(1)).alias("lost"))
    own, lost = cut(own), cut(lost)

    def without(met: DataFrame) -> DataFrame:
        met = met.join(own, ["id", "path", "f"], "left").filter(F.col("n") > F.coalesce("mine", F.lit(0)))
        return met.join(lost, ["id", "path"], "left").withColumn("m", F.col("m") - F.coalesce("lost", F.lit(0)))

    wanted = moving.select("id", F.size("fs").alias("k"), F.explode("fs").alias("f"))
    best = _walk(wanted, counts, least, depth, without)
    out = entities.join(best, "id", "left").withColumn("hierarchy_path", F.coalesce("best_path", "hierarchy_path"))
    return out.select(entities.columns)


def route_new(entities: DataFrame, new: DataFrame, tree: DataFrame) -> DataFrame:
    """``entities`` whose members of ``new`` (id) are moved to the most similar place of ``tree`` (path,
    features); those without features stay, and all do while no place has three levels."""
    if not tree.filter(three_levels(F.col("path"))).limit(1).count():
        return entities
    items = entities.join(new.select("id").distinct(), "id", "left_semi").filter("size(semantic_features) > 0").select("id", F.col("semantic_features").alias("features"))
    moved = best_paths(items, tree)
    return entities.join(moved, "id", "left").withColumn("hierarchy_path", F.coalesce("best_path", "hierarchy_path")).select(entities.columns)
