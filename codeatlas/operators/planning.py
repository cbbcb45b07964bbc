"""Orders and batches for rebuilding or changing a graph."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEPENDENCY_KINDS
from ..session import Table, cut, ship
from .order import closed, labelled, numbered

#: Rows of an order that one task follows at once.
BLOCK = 1 << 16
#: Entities and edges of an order, at most, that the driver follows.
ON_DRIVER = 1 << 22
#: Slices by source, at most, in which a large graph's edges are numbered: a slice's shuffles go before the next.
SLICES = 4
#: Greater than an entity's label.
LAST = (1 << 63) - 1


def topological_levels(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): an entity's level is one above the highest level it depends on; entities on or
    behind cycles have level -1.  Level by level, until no entity is ready: each entity counts what it
    still waits for, and only edges of the last level's entities are followed; a round writes one table."""
    links = edges.filter(F.col("kind").isin(DEPENDENCY_KINDS)).select("source", "target").distinct().filter("source <> target")
    known = cut(entities.select("id").distinct())
    links = cut(links.join(known.select(F.col("id").alias("source")), "source", "left_semi").join(known.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target"))
    waits = links.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    state = known.join(waits, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    state = cut(state.withColumn("level", F.when(F.col("n") == 0, 0)))
    for level in count():
        ready = state.filter(F.col("level") == level).select(F.col("id").alias("target"))
        if not ready.limit(1).count():
            break
        met = links.join(ready, "target").groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("m"))
        left = F.col("n") - F.coalesce("m", F.lit(0))
        state = state.join(met, "id", "left").select("id", left.alias("n"), F.coalesce("level", F.when(left == 0, level + 1)).alias("level"))
        state = cut(state)
    return state.select("id", F.coalesce("level", F.lit(-1)).alias("level"))


def kahn(ids: list[str], edges: list[tuple[str, str]], largest_first: bool = False) -> list[str]:
    """The exact order on the driver, for a scope of bounded size: targets before sources, of those
    that are ready the smallest id (or the largest); cyclic leftovers follow in order."""
    known = set(ids)
    waits: dict[str, set[str]] = {i: set() for i in ids}
    users = defaultdict(set)
    for s, t in set(edges):
        if s != t and s in known and t in known:
            waits[s].add(t)
            users[t].add(s)
    key = (lambda s: tuple(-ord(c) for c in s) + (1,)) if largest_first else (lambda s: s)
    heap = [(key(i), i) for i in ids if not waits[i]]
    heapq.heapify(heap)
    out = []
    while heap:
        _, i = heapq.heappop(heap)
        out.append(i)
        for s in users[i]:
            waits[s].discard(i)
            if not waits[s]:
                heapq.heappush(heap, (key(s), s))
    return out + sorted(known - set(out))


def kahn_numbered(n: int, sources: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """The order of ``kahn`` for the ids 0 to n - 1 and distinct edges, in arrays: 12 bytes an edge."""
    real = sources != targets
    sources, targets = sources[real], targets[real]
    users = sources[np.argsort(targets, kind="stable")]
    ends = np.concatenate([[0], np.cumsum(np.bincount(targets, minlength=n))])
    waits = np.bincount(sources, minlength=n)
    heap = np.flatnonzero(waits == 0).tolist()
    out, k = np.empty(n, dtype=np.int64), 0
    while heap:
        i = heapq.heappop(heap)
        out[k] = i
        k += 1
        own = users[ends[i] : ends[i + 1]]
        waits[own] -= 1
        for s in own[waits[own] == 0].tolist():
            heapq.heappush(heap, s)
    left = np.ones(n, dtype=bool)
    left[out[:k]] = False
    out[k:] = np.flatnonzero(left)
    return out


def topological_order(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(pos, id): the order of ``kahn`` for all entities.  The driver follows at most ``ON_DRIVER`` entities
    and edges; the order of more comes from ``heap_paths``, and no more than counts go to the driver."""
    known = labelled(entities.select("id").distinct(), ["id"], "k")
    ids, pairs = known.df, edges.filter(F.col("kind").isin(DEPENDENCY_KINDS)).select("source", "target")
    n, slices, links = ids.count(), [], None
    for i in range(among := min(SLICES, 1 + n // max(ON_DRIVER, 1))):
        part = pairs.filter(F.pmod(F.xxhash64("source"), F.lit(among)) == i)
        for end in ("source", "target"):
            part = part.join(ids.select(F.col("id").alias(end), F.col("k").alias(end[0])), end).drop(end)
        slices.append(Table(part.filter("s <> t")))
        links = slices[-1].df if links is None else links.unionByName(slices[-1].df)
    if max(n, links.count()) <= ON_DRIVER:
        labels = np.sort(ids.select("k").toArrow()["k"].to_numpy())
        rows = links.distinct().toArrow()
        order = labels[kahn_numbered(len(labels), *(np.searchsorted(labels, rows[c].to_numpy()) for c in "st"))]
        places = entities.sparkSession.createDataFrame(pa.table({"pos": pa.array(range(len(order)), pa.int64()), "k": pa.array(order, pa.int64())}))
    else:
        tables = heap_paths(ids.select("k"), links)
        paths = tables[0].df
        for table in tables[1:]:
            paths = paths.unionByName(table.df)
        places = closed(labelled(paths, [F.col("path")[0], "path"], "at").df.select("k", "at"), "at")
        slices += tables
    for table in slices:
        table.drop()
    return places.join(ids, "k").select("pos", "id")


def heap_paths(labels: DataFrame, links: DataFrame) -> list[Table]:
    """Tables (k, path) of all ``labels`` (k): in order of the paths, which are compared entry by entry, these are
    in the order that a heap over ``links`` (s, t; t before s) gives.

    A label waits in the heap from when the last of its targets has left it, and until it leaves itself only smaller
    ones do.  So the nearest greater one before it is that target, or else the nearest greater one before
    that.  A path is the chain of these: the greatest path of a target, of it what is greater than the
    label, and the label.  Paths are made level by level, as long as a label waits for one that is ready; a level's paths are
    numbered, so that a link carries a number.  Cyclic leftovers come last, in order.  A path has at most an entry a level."""
    waits = links.groupBy(F.col("s").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    users = links.select(F.col("t").alias("k"), F.lit(True).alias("used")).distinct()
    begin = labels.join(waits, "k", "left").join(users, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("used", F.lit(False)).alias("used"))
    state, out = Table(begin.withColumn("path", F.when(F.col("n") == 0, F.array("k")))), []
    while True:
        ready = state.df.filter("n = 0")
        out.append(Table(ready.select("k", "path")))
        used = ready.filter("used").select("k", "path")
        if not used.limit(1).count():
            break
        level = labelled(used, [F.col("path")[0], "path"], "at")
        met = links.join(level.df.select(F.col("k").alias("t"), "at"), "t").groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.max("at").alias("at"))
        met = met.join(level.df.select("at", F.col("path").alias("last")), "at").select(F.col("s").alias("k"), "m", "last")
        left, best = F.col("n") - F.coalesce("m", F.lit(0)), F.greatest("path", "last")
        own = F.concat(F.filter(best, lambda x: x > F.col("k")), F.array("k"))
        rows = state.df.filter("n > 0").join(met, "k", "left").select("k", left.alias("n"), "used", F.when(left == 0, own).otherwise(best).alias("path"))
        state, before = Table(rows), state
        before.drop()
        level.drop()
    out.append(Table(state.df.filter("n > 0").select("k", F.array(F.lit(LAST), "k").alias("path"))))
    state.drop()
    return out


def reconstruction_batches(ordered: DataFrame, size: int = 8, block: int = BLOCK) -> DataFrame:
    """(area, island, batch, n) from (pos, area): a batch ends where the area changes and at ``size``.
    A null area is an area.  Rows are numbered along the whole order and looked at in blocks that also
    see the row before them; the blocks' numbers of islands and last beginnings are then added up."""
    rows = numbered(ordered.select(F.col("pos").alias("at"), "area"), ["at"]).withColumn("block", F.expr(f"pos div {block}"))
    before = rows.filter(F.pmod("pos", F.lit(block)) == block - 1).select("pos", "area", F.expr("block + 1").alias("block"), F.lit(False).alias("own"))
    w = Window.partitionBy("block").orderBy("pos")
    rows = rows.select("pos", "area", "block", F.lit(True).alias("own")).unionByName(before)
    rows = rows.withColumn("new", (F.col("pos") == 0) | ~F.col("area").eqNullSafe(F.lag("area").over(w))).filter("own")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    begin = F.when(F.col("new"), F.col("pos"))
    rows = rows.select("block", "pos", "area", F.count_if("new").over(upto).alias("i"), F.max(begin).over(upto).alias("b"))
    sums = rows.groupBy("block").agg(F.max("i").alias("n"), F.max("b").alias("last"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("islands"), F.max("last").over(earlier).alias("last"))
    rows = rows.join(sums, "block").withColumn("first", F.coalesce("b", "last"))
    rows = rows.select("area", (F.col("i") + F.col("islands")).alias("island"), F.floor((F.col("pos") - F.col("first")) / size).cast("int").alias("batch"))
    return rows.groupBy("area", "island", "batch").agg(F.count(F.lit(1)).alias("n"))


def test_coverage(entities: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(id) of tests that touch a target and are none themselves."""
    is_test = (F.col("kind") == "test") | F.col("name").startswith("test_") | F.col("name").startswith("Test") | F.contains(F.col("file"), F.lit("test"))
    touching = edges.join(targets.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id")).distinct()
    return entities.filter(is_test).select("id").join(touching, "id", "left_semi").join(targets, "id", "left_anti")


def token_batches(sizes: list[tuple[str, int]], budget: int = 8000, most: int = 50) -> list[list[str]]:
    """Greedy batches of a page of entities: a batch ends before the tokens pass the budget, or at
    ``most`` entities."""
    out, batch, used = [], [], 0
    for i, n in sizes:
        if batch and (used + n > budget or len(batch) >= most):
            out.append(batch)
            batch, used = [], 0
        batch.append(i)
        used += n
    return [*out, batch] if batch else out


def batch_ends(tokens: list[int], budget: int, most: int) -> np.ndarray:
    """For every row, the row after the last one of the greedy batch that would begin there."""
    sums = np.concatenate([[0], np.cumsum(np.asarray(tokens, dtype=np.int64))])
    at = np.arange(len(tokens))
    fits = np.searchsorted(sums, sums[:-1] + budget, side="right") - 1
    return np.maximum(at + 1, np.minimum(np.minimum(fits, at + most), len(tokens)))


def token_batches_by_area(entities: DataFrame, budget: int = 8000, most: int = 50, block: int = BLOCK) -> DataFrame:
    """(area, batch, n, tokens): the same greedy rule over each place's entities in order of id.

    A batch has at most ``most`` entities, so of a block of rows only the first ``most`` can be where the
    first batch of the block begins.  Each block finds, for each of them, where in the next block the
    batches go on; an area's blocks are then followed one after the other, in these few numbers a block,
    and every block makes its batches.  Null and negative tokens count as none; a null area is an area."""
    ship(entities.sparkSession)
    block, most = max(block, most), max(most, 1)
    tokens = F.greatest(F.coalesce(F.col("tokens").cast("long"), F.lit(0)), F.lit(0))
    rows = numbered(entities.select("area", "id", tokens.alias("t")), ["id", "t"], ["area"])
    own = F.struct(F.expr(f"pos div {block}").alias("block"), F.lit(1).alias("own"))
    ahead = F.when((F.col("pos") >= block) & (F.pmod("pos", F.lit(block)) < most), F.struct(F.expr(f"pos div {block} - 1").alias("block"), F.lit(0).alias("own")))
    rows = rows.select("area", "pos", "t", F.explode(F.array_compact(F.array(own, ahead))).alias("x"))
    blocks = rows.groupBy("area", "x.block").agg(F.sum("x.own").alias("own"), F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("r"))
    blocks = cut(blocks.select("area", "block", "own", F.transform("r", lambda x: x.t).alias("ts")))

    def ways(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for n, ts in zip(f["own"], f["ts"], strict=True):
                ends, leave, count = batch_ends(ts, budget, most).tolist(), [0] * n, [0] * n
                for i in range(n - 1, -1, -1):
                    inside = ends[i] < n
                    leave[i] = leave[ends[i]] if inside else ends[i] - n
                    count[i] = count[ends[i]] + 1 if inside else 1
                out.append((leave[:most], count[:most]))
            yield pd.DataFrame({"area": f["area"], "block": f["block"], "leave": [x for x, _ in out], "count": [x for _, x in out]})

    def follow(f: pd.DataFrame) -> pd.DataFrame:
        entry, batch, out = 0, 0, []
        f = f.sort_values("block")
        for leave, count in zip(f["leave"], f["count"], strict=True):
            out.append((entry, batch))
            if entry < len(leave):  # else the batch that came in takes all that is left
                entry, batch = int(leave[entry]), batch + int(count[entry])
        return pd.DataFrame({"a": f["area"], "b": f["block"], "entry": [x for x, _ in out], "first": [x for _, x in out]})

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for area, n, ts, i, batch in zip(f["area"], f["own"], f["ts"], f["entry"], f["first"], strict=True):
                ends = batch_ends(ts, budget, most).tolist()
                while i < n:
                    out.append((area, batch, ends[i] - i, int(sum(ts[i : ends[i]]))))
                    i, batch = ends[i], batch + 1
            yield pd.DataFrame(out, columns=["area", "batch", "n", "tokens"])

    area = entities.select("area").schema[0].dataType.simpleString()
    found = blocks.select("area", "block", "own", "ts").mapInPandas(ways, f"area {area}, block long, leave array<int>, count array<int>")
    found = found.groupBy("area").applyInPandas(follow, f"a {area}, b long, entry int, first int")
    rows = blocks.join(found, F.col("area").eqNullSafe(F.col("a")) & (F.col("block") == F.col("b"))).select("area", "own", "ts", "entry", "first")
    return rows.mapInPandas(batches, f"area {area}, batch int, n int, tokens long")


#: Tokens of instructions a batch, entities a batch, characters a token, output tokens an entity, and the part
#: that synthesis adds (fixed values).
PROMPT, PER_BATCH, CHARS, ANSWER, SYNTHESIS = 500, 25, 4, 30, 5


def lift_cost(sources: DataFrame, batches: int, input_price: float, output_price: float) -> DataFrame:
    """One row: entities that need lifting of ``sources`` (source_text, lifted), those that rules lifted,
    batches (their share of ``batches``), input and output tokens, and the cost at prices a million
    tokens.  A null text has no tokens, a null mark counts as not lifted; nothing costs nothing."""
    need = ~F.coalesce(F.col("lifted"), F.lit(False))
    tokens = F.floor(F.octet_length(F.coalesce("source_text", F.lit(""))) / CHARS)
    out = sources.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(need).alias("to_lift"),
        F.coalesce(F.sum(F.when(need, tokens)), F.lit(0)).cast("long").alias("tokens"),
    )
    out = out.withColumn("batches", F.when(F.col("n") == 0, F.lit(0)).otherwise(F.ceil(F.lit(batches) * (F.col("to_lift") / F.nullif("n", F.lit(0))))).cast("long"))
    mean = F.coalesce(F.expr("tokens div nullif(to_lift, 0)"), F.lit(0))
    out = out.withColumn("i", (PROMPT + mean * PER_BATCH) * F.col("batches")).withColumn("o", F.col("to_lift") * ANSWER)
    out = out.select("to_lift", (F.col("n") - F.col("to_lift")).alias("auto_lifted"), "batches", F.expr(f"i + i div {SYNTHESIS}").alias("input_tokens"), F.expr(f"o + o div {SYNTHESIS}").alias("output_tokens"))
    return out.withColumn("cost", F.col("input_tokens") / 1_000_000 * input_price + F.col("output_tokens") / 1_000_000 * output_price)


def plan_change(entities: DataFrame, edges: DataFrame, goal: str, scope: str = "", most: int = 15, reach: int = 50) -> dict:
    """For a goal in words: the ``most`` best hits (relevant), their order for changes (largest ready id
    first), for each hit how many entities and files depend on it within two steps, ``reach`` at
    most, the tests that touch the hits, and the share of entities that are lifted, in percent.  One search
    upwards runs for all hits at once."""
    from .hierarchy import coverage_overall
    from .search import filtered, search_auto
    from .traverse import reached

    hits = search_auto(filtered(entities, scope).filter("kind <> 'module'"), goal, most)
    found = hits.join(entities.select("id", "file", "semantic_features"), "id").collect()
    found = sorted(found, key=lambda r: (-round(r.score, 9), r.id))
    ids = [r.id for r in found]
    near = reached(edges, ids, "upstream", 2).filter("depth > 0")
    rank = F.row_number().over(Window.partitionBy("root").orderBy("depth", "id"))
    near = near.withColumn("r", rank).filter(F.col("r") <= reach).join(entities.select("id", "file"), "id", "left")
    impact = {r.root: r for r in near.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files")).collect()}
    among = edges.filter(F.col("source").isin(ids) & F.col("target").isin(ids) & F.col("kind").isin(DEPENDENCY_KINDS)).select("source", "target").distinct().collect()
    tests = sorted(r.id for r in test_coverage(entities, edges, entities.filter(F.col("id").isin(ids)).select("id")).collect())
    whole = coverage_overall(entities).first()
    return {
        "goal": goal,
        "relevant": [{"id": r.id, "file": r.file, "features": r.semantic_features, "score": r.score} for r in found],
        "order": kahn(ids, [tuple(r) for r in among], largest_first=True),
        "impact": [{"id": i, "upstream": impact[i].n if i in impact else 0, "files": impact[i].files if i in impact else 0} for i in ids],
        "tests": tests,
        "lifted": 100.0 * whole.lifted / whole.total if whole.total else 100.0,
    }
