"""Construction and integrity of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEPENDENCY_KINDS


def insert(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by id: a new row replaces the old one; of several new rows the last by line wins."""
    order = Window.partitionBy("id").orderBy(F.col("line_start").desc_nulls_last(), F.col("line_end").desc_nulls_last())
    new = new.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
    return entities.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def remove(entities: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the entities ``ids[id]`` and the edges at them."""
    kept = edges.join(ids.select(F.col("id").alias("source")), "source", "left_anti")
    kept = kept.join(ids.select(F.col("id").alias("target")), "target", "left_anti")
    return entities.join(ids, "id", "left_anti"), kept.select(edges.columns)


def module_entities(entities: DataFrame, suffix: str = "") -> DataFrame:
    """A module for every file, id ``file:stem`` with the last line of its entities, where that
    id is free."""
    name = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    files = entities.filter("kind <> 'module'").groupBy("file").agg(F.max("line_end").alias("line_end"))
    out = files.select(F.concat("file", F.lit(":"), name, F.lit(suffix)).alias("id"), F.lit("module").alias("kind"), name.alias("name"), "file", F.lit(1).alias("line_start"), "line_end")
    return out.join(entities.select("id"), "id", "left_anti").select("id", "kind", "name", "file", "line_start", "line_end")


def populate_dependencies(entities: DataFrame, raw: DataFrame, broadcast_imports: bool = False) -> DataFrame:
    """References (source, file, name, kind) from raw ones (file, kind, caller, callee, module):
    the caller's last name is joined with the file's entities; imports belong to entities that
    mention the symbol, or with ``broadcast_imports`` to all of a file without call sites."""
    owner = entities.select("file", F.col("name").alias("caller_name"), F.col("id").alias("source"), "kind").withColumnRenamed("kind", "entity_kind")
    last = lambda c: F.regexp_extract(c, r"([^.:/]+)$", 1)
    called = raw.filter("kind <> 'imports'").withColumn("caller_name", last("caller")).join(owner, ["file", "caller_name"])
    called = called.filter("kind <> 'composes' OR entity_kind = 'module'").select("source", "file", last("callee").alias("name"), "kind")
    imported = raw.filter("kind = 'imports'").select("file", last("callee").alias("name"))
    used = called.select("source", "file", "name").distinct().join(imported, ["file", "name"]).select("source", "file", "name", F.lit("imports").alias("kind"))
    out = called.unionByName(used)
    if broadcast_imports:
        silent = imported.join(called.select("file").distinct(), "file", "left_anti")
        out = out.unionByName(owner.join(silent, "file").select("source", "file", "name", F.lit("imports").alias("kind")))
    return out.distinct()


def resolve(entities: DataFrame, references: DataFrame) -> DataFrame:
    """Edges of references (source, file, name, kind): the same file's entity of that name (the
    greatest id), else the only one of that name in other files; ambiguous names give none.
    Names are counted before the join, so that a common name costs a row and not its product."""
    local = entities.groupBy("file", "name").agg(F.max("id").alias("local"), F.count(F.lit(1)).alias("here"))
    named = entities.groupBy("name").agg(F.count(F.lit(1)).alias("all"), F.min("id").alias("low"), F.max("id").alias("high"))
    out = references.join(local, ["file", "name"], "left").join(named, "name")
    in_file = F.when(F.col("local") != F.col("source"), F.col("local"))
    elsewhere = F.when(F.col("all") - F.coalesce("here", F.lit(0)) == 1, F.when((F.col("here").isNull()) | (F.col("low") != F.col("local")), F.col("low")).otherwise(F.col("high")))
    return out.select("source", F.coalesce(in_file, elsewhere).alias("target"), "kind").filter("target IS NOT NULL").distinct()


def data_flow(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """For each invocation a -> b: a -> b if b has parameters, b -> a if b returns something."""
    called = entities.select(F.col("id").alias("target"), (F.size("signature.parameters") > 0).alias("takes"), F.col("signature.return_type").isNotNull().alias("gives"))
    calls = edges.filter("kind = 'invokes'").select("source", "target").distinct().join(called, "target")
    ways = F.array_compact(F.array(F.when(F.col("takes"), F.struct(F.col("source").alias("s"), F.col("target").alias("t"))), F.when(F.col("gives"), F.struct(F.col("target").alias("s"), F.col("source").alias("t")))))
    return calls.select(F.explode(ways).alias("w")).select(F.col("w.s").alias("source"), F.col("w.t").alias("target"), F.lit("data_flow").alias("kind")).distinct()


def containment(entities: DataFrame) -> DataFrame:
    """Edges from hierarchy nodes to their children and entities."""
    from .hierarchy import nodes

    inner = nodes(entities).filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("source"), F.col("node_id").alias("target"))
    leaves = entities.filter("hierarchy_path <> ''").select(F.concat(F.lit("h:"), "hierarchy_path").alias("source"), F.col("id").alias("target"))
    return inner.unionByName(leaves).withColumn("kind", F.lit("contains"))


def edges_of(entities: DataFrame, references: DataFrame) -> DataFrame:
    """All edges of a graph: resolved references, data flow, containment."""
    edges = resolve(entities, references)
    return edges.unionByName(data_flow(entities, edges)).unionByName(containment(entities))


def metadata(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts."""
    area = F.substring_index("hierarchy_path", "/", 1)
    e = entities.agg(
        F.count(F.lit(1)).alias("total_entities"),
        F.count_distinct("file").alias("total_files"),
        F.count_distinct(F.when(F.col("hierarchy_path") != "", area)).alias("functional_areas"),
        F.count_if((F.size("semantic_features") > 0) & (F.col("kind") != "module")).alias("lifted_entities"),
    )
    d = edges.agg(
        F.count(F.lit(1)).alias("total_edges"),
        F.count_if(F.col("kind").isin(DEPENDENCY_KINDS)).alias("dependency_edges"),
        F.count_if(F.col("kind") == "contains").alias("containment_edges"),
        F.count_if(F.col("kind") == "data_flow").alias("data_flow_edges"),
    )
    return e.join(F.broadcast(d))  # one row each


def issues(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Integrity: edges with a missing end, and ids without a colon: (issue, subject)."""
    known = entities.select(F.col("id").alias("end"))
    ends = edges.filter("kind <> 'contains'").select("source", "target", "kind", F.explode(F.array("source", "target")).alias("end"))
    subject = F.concat("source", F.lit("->"), "target", F.lit(" "), "kind")
    dangling = ends.join(known, "end", "left_anti").select(F.lit("dangling_edge").alias("issue"), subject.alias("subject")).distinct()
    odd = entities.filter("instr(id, ':') = 0").select(F.lit("bad_id").alias("issue"), F.col("id").alias("subject"))
    return dangling.unionByName(odd)


def orphans(entities: DataFrame, edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """More of integrity: (issue, subject) of containment whose end is no entity or node, and, given
    ``files`` (path), of entities in files that are not there."""
    from .hierarchy import nodes

    known = entities.select("id").unionByName(nodes(entities).select(F.col("node_id").alias("id")))
    ends = edges.filter("kind = 'contains'").select(F.explode(F.array("source", "target")).alias("id")).distinct()
    out = ends.join(known, "id", "left_anti").select(F.lit("orphan_node").alias("issue"), F.col("id").alias("subject"))
    if files is not None:
        lost = entities.select("file").distinct().join(files.select(F.col("path").alias("file")), "file", "left_anti")
        out = out.unionByName(lost.select(F.lit("missing_file").alias("issue"), F.col("file").alias("subject")))
    return out


def edges_for(edges: DataFrame, entity_id: str) -> DataFrame:
    return edges.filter((F.col("source") == entity_id) | (F.col("target") == entity_id))


def area_invocations(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Invocations between areas: count, and up to three names of those called."""
    area = entities.select("id", F.substring_index("hierarchy_path", "/", 1).alias("area"), "name")
    out = edges.filter("kind = 'invokes'").join(area.select(F.col("id").alias("source"), F.col("area").alias("source_area")), "source")
    out = out.join(area.select(F.col("id").alias("target"), F.col("area").alias("target_area"), "name"), "target").filter("source_area <> '' AND target_area <> '' AND source_area <> target_area")
    names = out.groupBy("source_area", "target_area", "name").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("source_area", "target_area").orderBy("name"))
    # Each task leaves at most three names of a pair of areas.
    few = names.select("source_area", "target_area", "name").withColumn("r", rank).filter("r <= 3").groupBy("source_area", "target_area").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("samples"))
    return names.groupBy("source_area", "target_area").agg(F.sum("n").alias("calls")).join(few, ["source_area", "target_area"])
