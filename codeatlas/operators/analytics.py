"""Coupling health, cycles, clones, snapshots."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code import code_tokens
from ..functions.text import clean_score, glob_regex
from ..schema import DEPENDENCY_KINDS
from ..session import cut, ship

#: Thresholds of the health report (fixed values).
GOD_DEGREE, UNSTABLE, HUB_DEGREE = 10, 0.7, 8


def health(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, ca, ce, instability, centrality, god, unstable, stable, hub) of every entity but modules;
    each edge counts at both ends in one pass."""
    ends = edges.filter(F.col("kind").isin(DEPENDENCY_KINDS)).select(
        F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")
    )
    degree = ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.i").alias("ca"), F.sum("e.o").alias("ce"))
    n = entities.agg(F.count(F.lit(1)).alias("n"))
    out = entities.filter("kind <> 'module'").select("id").join(degree, "id", "left").na.fill(0, ["ca", "ce"]).join(F.broadcast(n))
    total = F.col("ca") + F.col("ce")
    instability = F.when(total == 0, F.lit(0.0)).otherwise(F.col("ce") / F.nullif(total, F.lit(0)))
    out = out.withColumn("instability", instability).withColumn("centrality", F.when(F.col("n") <= 1, F.lit(0.0)).otherwise(total / (F.col("n") - 1)))
    low, i = 1.0 - UNSTABLE, F.col("instability")
    return out.select(
        "id", "ca", "ce", "instability", "centrality",
        ((total >= GOD_DEGREE) & ((i > UNSTABLE) | (i < low))).alias("god"),
        ((i > UNSTABLE) & (F.col("ce") > 0)).alias("unstable"),
        ((i < low) & (F.col("ca") > 0)).alias("stable"),
        (total >= HUB_DEGREE).alias("hub"),
    )


def health_summary(report: DataFrame) -> DataFrame:
    mean = lambda c: clean_score(F.coalesce(F.avg(c), F.lit(0.0)))
    return report.agg(
        F.count(F.lit(1)).alias("entities"), mean("instability").alias("avg_instability"), mean("centrality").alias("avg_centrality"),
        F.count_if("god").alias("god_objects"), F.count_if("unstable").alias("highly_unstable"), F.count_if("stable").alias("highly_stable"), F.count_if("hub").alias("hubs"),
    )


def cycles(edges: DataFrame, longest: int = 20, least: int = 2) -> DataFrame:
    """(cycle array, length): elementary cycles of ``least`` to ``longest`` entities, each from its
    smallest id.  Vertices that lie on no cycle are peeled off first; then paths that start at
    their smallest id grow by one edge a round, in the shared folder."""
    links = edges.select("source", "target").distinct()
    size = -1
    while True:
        links = cut(links.join(links.select(F.col("source").alias("target")).distinct(), "target", "left_semi").join(links.select(F.col("target").alias("source")).distinct(), "source", "left_semi").select("source", "target"))
        now = links.count()
        if now == size:
            break
        size = now
    step = links.select(F.col("source").alias("last"), F.col("target").alias("next"))
    grown = links.filter("source < target").select(F.col("source").alias("start"), F.array("source", "target").alias("path"))
    found = links.filter("source = target").select(F.array("source").alias("cycle"))
    for _ in range(2, longest + 1):
        ahead = grown.withColumn("last", F.element_at("path", -1)).join(step, "last").filter("next >= start")
        ahead = cut(ahead)
        found = found.unionByName(ahead.filter("next = start").select(F.col("path").alias("cycle")))
        grown = ahead.filter("next > start AND NOT array_contains(path, next)").select("start", F.concat("path", F.array("next")).alias("path"))
        if not grown.limit(1).count():
            break
    return found.withColumn("length", F.size("cycle")).filter(F.col("length").between(least, longest))


def _members(found: DataFrame, entities: DataFrame) -> DataFrame:
    """(cycle, id, file, area) of the members that are entities; a cycle is its own key."""
    own = entities.select("id", "file", F.substring_index("hierarchy_path", "/", 1).alias("area"))
    return found.select("cycle", F.explode("cycle").alias("id")).join(own, "id")


def cycle_areas(found: DataFrame, entities: DataFrame) -> DataFrame:
    """(area, cycles, entities): each cycle counts once an area."""
    return _members(found, entities).groupBy("area").agg(F.count_distinct("cycle").alias("cycles"), F.count_distinct("id").alias("entities"))


def cycle_summary(found: DataFrame, entities: DataFrame) -> DataFrame:
    """One row (cycles, entities, files, areas): all cycles, and what their members have, each once;
    zeros where there are none."""
    facts = _members(found, entities).agg(F.count_distinct("id").alias("entities"), F.count_distinct("file").alias("files"), F.count_distinct("area").alias("areas"))
    # Both sides are a single row.
    return found.agg(F.count(F.lit(1)).alias("cycles")).join(F.broadcast(facts))


def cycle_lengths(found: DataFrame) -> DataFrame:
    """(length, cycles): how many cycles have each length."""
    return found.groupBy(F.size("cycle").alias("length")).agg(F.count(F.lit(1)).alias("cycles"))


def sort_cycles(found: DataFrame, entities: DataFrame, by: str = "length") -> DataFrame:
    """Cycles with ``files`` and ``members``, the most by ``by`` (length, file_count or entity_count) first,
    then by the cycle."""
    order = {"length": "length", "file_count": "files", "entity_count": "members"}[by]
    facts = _members(found, entities).groupBy("cycle").agg(F.count_distinct("file").alias("files"), F.count_distinct("id").alias("members"))
    return found.join(facts, "cycle", "left").na.fill(0, ["files", "members"]).orderBy(F.desc(order), "cycle")


def filter_cycles(found: DataFrame, entities: DataFrame, area_prefix: str = "", cross_file: bool = False, cross_area: bool = False, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Cycles with a member in an area of the comma-separated prefixes, over several files, over
    several areas; those whose members' files all fit one of the globs ``ignored`` are left out."""
    if ignored:
        hidden = F.lit(False)
        for regex in filter(None, map(glob_regex, ignored)):
            hidden = hidden | F.coalesce(F.col("file").rlike(regex), F.lit(False))
        seen = _members(found, entities).groupBy("cycle").agg(F.bool_and(hidden).alias("all")).filter("all")
        found = found.join(seen.select("cycle"), "cycle", "left_anti")
    fits = F.lit(not area_prefix)
    for p in filter(None, (x.strip() for x in area_prefix.split(","))):
        fits = fits | F.col("area").startswith(p)
    facts = _members(found, entities).groupBy("cycle").agg(F.count_distinct("file").alias("files"), F.count_distinct("area").alias("areas"), F.bool_or(fits).alias("fits"))
    keep = facts.filter("fits").filter(f"files > {int(cross_file)} AND areas > {int(cross_area)}")
    return found.join(keep.select("cycle"), "cycle", "left_semi")


def semantic_clones(entities: DataFrame, threshold: float = 0.6, common: int = 20, top: int = 50) -> DataFrame:
    """(a, b, similarity) of entities in different files whose features' Jaccard similarity reaches
    the threshold.  Features of more than ``common`` entities make no candidates; the shared rare
    features must reach the threshold over the larger set, then the exact similarity decides.
    Features are compared by 64-bit hashes, made once; a feature has at most ``common`` squared pairs, and
    only pairs that pass the bound by numbers meet with their sets."""
    own = cut(entities.select("id", "file", F.array_distinct(F.transform("semantic_features", lambda f: F.xxhash64(f))).alias("fs")))
    rows = own.select("id", "file", F.size("fs").alias("n"), F.explode("fs").alias("f"))
    rare = rows.groupBy("f").agg(F.count(F.lit(1)).alias("c")).filter(f"c between 2 and {common}").select("f")
    rows = cut(rows.join(rare, "f"))
    one = rows.select("f", F.col("id").alias("a"), F.col("file").alias("a_file"), F.col("n").alias("a_n"))
    two = rows.select("f", F.col("id").alias("b"), F.col("file").alias("b_file"), F.col("n").alias("b_n"))
    size = F.greatest("a_n", "b_n")
    pairs = one.join(two, "f").filter((F.col("a") < F.col("b")) & (F.col("a_file") != F.col("b_file")) & (F.least("a_n", "b_n") / size >= threshold))
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max(size).alias("m")).filter(F.col("shared") / F.col("m") >= threshold).select("a", "b")
    side = lambda x: own.select(F.col("id").alias(x), F.col("fs").alias(f"{x}_fs"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("a_fs", "b_fs"))
    sim = both / (F.size("a_fs") + F.size("b_fs") - both)
    return pairs.select("a", "b", sim.alias("s")).filter(F.col("s") >= threshold).select("a", "b", F.round("s", 3).alias("similarity")).orderBy(F.desc("similarity"), "a", "b").limit(top)


#: The window hash of token clones (fixed values).
BASE, MODULUS = 256, 1_000_000_007


def window_hashes(tokens: list[int], width: int) -> list[int]:
    """Polynomial hashes of the windows of ``width`` tokens, by one pass over all windows for each place."""
    row = np.asarray(tokens, dtype=np.int64) % MODULUS
    out = np.zeros(max(0, len(row) - width + 1), dtype=np.int64)
    for k in range(width if len(out) else 0):
        out = (out * BASE + row[k : k + len(out)]) % MODULUS
    return out.tolist()


def tokenized(files: DataFrame) -> DataFrame:
    """(id, tokens) of sources (id, content), for ``token_clones``."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "tokens": [code_tokens(t) for t in f["content"]]})

    return files.select("id", "content").mapInPandas(run, "id string, tokens array<int>")


def token_clones(sources: DataFrame, width: int = 20, threshold: float = 0.7, least: int = 15, top: int = 50) -> DataFrame:
    """(a, b, shared, similarity) of sources (id, tokens array<int>) by shared distinct window hashes
    over the smaller number of windows; the ``top`` pairs by similarity, a and b.

    Sources of equal hashes and lengths are a class, compared once.  The smaller source of a pair must
    share enough of its hashes, so that one of its rarest few is among them: only these look for
    partners, and windows that a large part of the sources share seldom do.  The best ``top`` pairs of
    classes hold the best pairs of sources, and of each class the ``top`` + 1 smallest ids are enough.
    Null or short tokens have no windows and no clones; a repeated id is compared as the sources it has."""
    ship(sources.sparkSession)

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            hs = [sorted(set(window_hashes([int(v) for v in t], width))) for t in f["tokens"]]
            names = [hashlib.sha256(f"{len(t)} {h}".encode()).hexdigest() for t, h in zip(f["tokens"], hs, strict=True)]
            yield pd.DataFrame({"id": f["id"], "k": names, "w": [len(t) - width + 1 for t in f["tokens"]], "hs": hs})

    rows = cut(sources.filter(F.size("tokens") >= width).select("id", "tokens").mapInPandas(hashed, "id string, k string, w long, hs array<long>"))
    ranked = rows.select("k", "id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("id"))).filter(F.col("r") <= top + 1)
    members = cut(ranked.groupBy("k").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    classes = cut(rows.groupBy("k").agg(F.first("w").alias("w"), F.first("hs").alias("hs")))
    need = F.greatest(F.lit(1), F.lit(least - width + 1), F.ceil(F.col("w") * threshold - 1e-9)).cast("int")
    all_hashes = classes.select("k", "w", F.explode("hs").alias("h"))
    counts = all_hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    by_rarity = all_hashes.join(counts, "h").groupBy("k", "w").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("s"))
    rarest = by_rarity.select(F.col("k").alias("ka"), F.col("w").alias("wa"), F.explode(F.slice("s", 1, F.greatest(F.lit(0), F.size("s") - need + 1))).alias("x"))
    rarest = rarest.select("ka", "wa", F.col("x.h").alias("h"))
    larger = (F.col("wa") < F.col("w")) | ((F.col("wa") == F.col("w")) & (F.col("ka") < F.col("k")))
    found = rarest.join(all_hashes, "h").filter(larger).select("ka", F.col("k").alias("kb")).distinct()
    side = lambda x: classes.select(F.col("k").alias(f"k{x}"), F.col("w").alias(f"w{x}"), F.col("hs").alias(f"hs{x}"))
    found = found.join(side("a"), "ka").join(side("b"), "kb").select("ka", "kb", F.size(F.array_intersect("hsa", "hsb")).cast("long").alias("shared"), F.least("wa", "wb").alias("w"))
    own = members.filter("size(ids) > 1").join(classes, "k").select(F.col("k").alias("ka"), F.col("k").alias("kb"), F.size("hs").cast("long").alias("shared"), "w")
    found = found.unionByName(own).withColumn("s", F.least(F.lit(1.0), F.col("shared") / F.col("w"))).filter((F.col("s") >= threshold) & (F.col("shared") + width - 1 >= least))
    ids = lambda x: members.select(F.col("k").alias(f"k{x}"), F.col("ids").alias(f"ids{x}"))
    found = found.select("ka", "kb", "shared", F.round("s", 3).alias("similarity")).join(ids("a"), "ka").join(ids("b"), "kb")
    low, high = F.col("idsa")[0], F.col("idsb")[0]
    second = F.when(F.col("ka") == F.col("kb"), F.col("idsb")[1]).otherwise(F.greatest(low, high))
    best = found.orderBy(F.desc("similarity"), F.least(low, high), second).limit(top)
    pairs = best.select("ka", "kb", "shared", "similarity", F.explode("idsa").alias("x"), "idsb").select("ka", "kb", "shared", "similarity", "x", F.explode("idsb").alias("y"))
    pairs = pairs.filter("ka <> kb OR x < y").filter("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", "similarity").orderBy(F.desc("similarity"), "a", "b").limit(top)


def hot_spots(edges: DataFrame, top: int = 10) -> DataFrame:
    """(id, links) of the entities with most invocations, imports and inheritance in and out."""
    ends = edges.filter("kind IN ('invokes', 'imports', 'inherits')").select(F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("links")).orderBy(F.desc("links"), "id").limit(top)


def module_features(entities: DataFrame) -> DataFrame:
    """(file, features): the sorted distinct features of a file's entities; files without any are left out."""
    rows = entities.filter("kind <> 'module'").select("file", F.explode("semantic_features").alias("f"))
    return rows.groupBy("file").agg(F.sort_array(F.collect_set("f")).alias("features"))


def snapshot_groups(entities: DataFrame, per_entity: int = 3, per_group: int = 5) -> DataFrame:
    """(hierarchy_path, entities, sample): the groups of a snapshot, with a few entities and features.  Each
    task leaves at most ``per_group`` rows a group to the sample, however large the group is."""
    own = entities.filter("kind <> 'module' AND hierarchy_path <> ''")
    rank = F.row_number().over(Window.partitionBy("hierarchy_path").orderBy("id"))
    line = F.concat("name", F.lit(": "), F.array_join(F.slice("semantic_features", 1, per_entity), ", "))
    few = own.select("hierarchy_path", "id", line.alias("l")).withColumn("r", rank).filter(F.col("r") <= per_group)
    few = few.groupBy("hierarchy_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "l"))), lambda x: x.l), "; ").alias("sample"))
    return own.groupBy("hierarchy_path").agg(F.count(F.lit(1)).alias("entities")).join(few, "hierarchy_path")


def skeleton(edges: DataFrame, entities: DataFrame, per_folder: int = 5) -> DataFrame:
    """(folder, entity, links): of each folder the ``per_folder`` entities with most dependencies."""
    ends = edges.filter(F.col("kind").isin(DEPENDENCY_KINDS)).select(F.explode(F.array("source", "target")).alias("id"))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    folder = F.when(F.instr("file", "/") > 0, F.regexp_replace("file", "/[^/]*$", "")).otherwise(F.lit(""))
    rows = entities.filter("kind <> 'module'").select("id", folder.alias("folder")).join(degree, "id")
    rank = F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("links"), "id"))
    return rows.withColumn("r", rank).filter(F.col("r") <= per_folder).select("folder", F.col("id").alias("entity"), "links")


def trimmed_snapshot(entities: DataFrame, budget: int = 30_000) -> tuple[DataFrame, int]:
    """The largest snapshot within a token budget: features go 3, 2, 1, 0 until it fits."""
    for few in (3, 2, 1, 0):
        groups = snapshot_groups(entities, few)
        tokens = groups.agg(F.sum(F.length("sample") + F.length("hierarchy_path")).alias("c")).first().c or 0
        if tokens / 4 + 500 <= budget or few == 0:
            return groups, few
    raise AssertionError
