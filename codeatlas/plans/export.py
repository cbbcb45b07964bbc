"""Texts for other tools: DOT, Mermaid, pipe tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import analytics
from ..operators import graph as build
from ..operators.hierarchy import nodes
from ..session import cut

#: Shapes by kind, styles and arrows by edge (fixed values).
SHAPES = {
    "function": "ellipse", "method": "ellipse", "class": "box", "page": "tab", "layout": "tab", "component": "box3d", "hook": "ellipse", "store": "cylinder",
    "module": "component", "controller": "hexagon", "route": "hexagon", "model": "box", "service": "ellipse", "middleware": "trapezium", "test": "diamond",
}
STYLES = {
    "invokes": "solid", "imports": "dashed", "inherits": "bold", "composes": "solid", "renders": "solid", "reads_state": "dashed", "writes_state": "bold",
    "dispatches": "solid", "data_flow": "dashed", "contains": "dotted",
}
ARROWS = {
    "invokes": "-->", "composes": "-->", "renders": "-->", "dispatches": "-->", "imports": "-.->", "data_flow": "-.->", "reads_state": "-.->",
    "inherits": "==>", "writes_state": "==>",
}
FOLDER, LIFTED, BARE = "#e0e0ff", "#e0ffe0", "#ffffff"


def _quoted(c):
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _choose(column: str, table: dict[str, str], other: str):
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def dot_lines(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): the lines of a DOT graph, hierarchy nodes and their links, entities, edges; sort by
    part and write between ``digraph {`` and ``}``."""
    def box(node, shape, colour, label):
        return F.concat(F.lit("  "), _quoted(node), F.lit(" [shape="), shape, F.lit(', style=filled, fillcolor="'), colour, F.lit('", label='), _quoted(label), F.lit("];"))

    tree = nodes(entities)
    folders = tree.select(F.lit(0).alias("part"), box(F.col("node_id"), F.lit("folder"), F.lit(FOLDER), F.col("name")).alias("line"))
    below = tree.filter("parent_id IS NOT NULL").select(F.lit(1).alias("part"), F.concat(F.lit("  "), _quoted(F.col("parent_id")), F.lit(" -> "), _quoted(F.col("node_id")), F.lit(" [style=dotted];")).alias("line"))
    colour = F.when(F.size("semantic_features") > 0, LIFTED).otherwise(BARE)
    own = entities.select(F.lit(2).alias("part"), box(F.col("id"), _choose("kind", SHAPES, "ellipse"), colour, F.col("name")).alias("line"))
    arcs = edges.select(F.lit(3).alias("part"), F.concat(F.lit("  "), _quoted(F.col("source")), F.lit(" -> "), _quoted(F.col("target")), F.lit(" [style="), _choose("kind", STYLES, "solid"), F.lit(", label="), _quoted(F.col("kind")), F.lit("];")).alias("line"))
    return folders.unionByName(below).unionByName(own).unionByName(arcs)


def mermaid_lines(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, place, line): the lines of a Mermaid flowchart, sorted by part and place: a subgraph for each
    hierarchy node within its parent's, entities in theirs, then dependency edges.  In ``place`` each
    level ends with a character below all others, so that a subgraph's lines stay together."""
    safe = lambda c: F.translate(c, ":/. -", "_____")
    at = lambda path: F.concat(F.replace(path, F.lit("/"), F.lit("\x01")), F.lit("\x01"))
    pad = lambda path: F.repeat(F.lit("  "), F.size(F.split(path, "/")))
    tree = nodes(entities)
    begin = tree.select(F.lit(0).alias("part"), at(F.col("path")).alias("place"), F.concat(pad(F.col("path")), F.lit("subgraph "), safe(F.col("node_id")), F.lit("["), _quoted(F.col("name")), F.lit("]")).alias("line"))
    end = tree.select(F.lit(0).alias("part"), F.concat(at(F.col("path")), F.lit("\uffff")).alias("place"), F.concat(pad(F.col("path")), F.lit("end")).alias("line"))
    label = _quoted(F.concat("name", F.lit("\0("), "kind", F.lit(")")))
    own = entities.filter("hierarchy_path <> ''").select(
        F.lit(0).alias("part"), F.concat(at(F.col("hierarchy_path")), F.lit("\x00"), "id").alias("place"),
        F.concat(pad(F.col("hierarchy_path")), F.lit("  "), safe(F.col("id")), F.lit("["), F.replace(label, F.lit("\0"), F.lit("\\n")), F.lit("]")).alias("line"),
    )
    arcs = edges.filter("kind <> 'contains'").select(F.lit(1).alias("part"), F.lit("").alias("place"), F.concat(F.lit("  "), safe(F.col("source")), F.lit(" "), _choose("kind", ARROWS, "-->"), F.lit("|"), F.col("kind"), F.lit("| "), safe(F.col("target"))).alias("line"))
    return begin.unionByName(own).unionByName(end).unionByName(arcs)


def change_plan_text(plan: dict) -> str:
    """A change plan (``planning.plan_change``) as text: hits, order, impact, tests and how much is lifted."""
    out = [f'## Change Plan for: "{plan["goal"]}"', "", "### Relevant Entities (by relevance)", ""]
    for i, r in enumerate(plan["relevant"], 1):
        about = '"' + ", ".join(r["features"]) + '"' if r["features"] else "(no features)"
        out.append(f"{i}. `{r['id']}` ({r['file']}) \u2014 {about} ({r['score']:.2f})")
    if plan["order"]:
        out += ["", "### Modification Order (dependency-safe)", "", *(f"{i}. `{x}`" for i, x in enumerate(plan["order"], 1))]
    if plan["impact"]:
        many = lambda n, word: f"{n} {word}{'' if n == 1 else 's'}"
        out += ["", "### Impact Radius", "", *(f"- `{x['id']}`: {many(x['upstream'], 'upstream dependent')} across {many(x['files'], 'file')}" for x in plan["impact"])]
    if plan["tests"]:
        out += ["", "### Related Tests", "", *(f"- `{x}`" for x in plan["tests"])]
    if plan["lifted"] < 100:
        out += ["", f"Note: {plan['lifted']:.0f}% lifting coverage. Results improve with full lifting."]
    return "\n".join(out) + "\n"


def health_lines(report: DataFrame, top: int = 10) -> DataFrame:
    """(part, place, line): the lines of a health report, sorted by part and place: counts first, then the
    ``top`` god objects by degree and the ``top`` most unstable entities."""
    counts = report.agg(F.count(F.lit(1)).alias("entities"), *(F.count_if(c).alias(c) for c in ("god", "unstable", "stable", "hub")))
    said = F.array(*(F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in counts.columns))
    out = counts.select(F.lit(0).alias("part"), F.posexplode(said).alias("place", "line"))
    percent = F.round(F.col("instability") * 100).cast("long").cast("string")
    line = F.concat("id", F.lit(": in "), F.col("ca").cast("string"), F.lit(", out "), F.col("ce").cast("string"), F.lit(", instability "), percent, F.lit("%"))
    for part, mark, order in ((1, "god", [F.desc(F.col("ca") + F.col("ce")), "id"]), (2, "unstable", [F.desc("instability"), F.desc("ce"), "id"])):
        few = report.filter(mark).orderBy(*order).limit(top)
        rank = F.row_number().over(Window.orderBy(*order)) - 1  # over ``top`` rows
        out = out.unionByName(few.select(F.lit(part).alias("part"), rank.alias("place"), line.alias("line")))
    return out


def pipe_table(name: str, df: DataFrame) -> str:
    """A small result as a pipe table: a header with the row count and column names, then rows."""
    rows = df.collect()  # a result for reading
    out = [f"{name}[{len(rows)}|]{{{'|'.join(df.columns)}}}:"]
    return "\n".join(out + ["  " + "|".join("" if v is None else str(v) for v in r) for r in rows])


def _walk(found: DataFrame) -> list:
    """The rows of a bounded exploration, children below their parents by id."""
    rows = found.collect()
    below: dict = {}
    for r in rows:
        below.setdefault(r.parent, []).append(r)
    out, stack = [], [r for r in rows if r.parent is None]
    while stack:
        r = stack.pop()
        out.append(r)
        stack += sorted(below.get(r.id, []), key=lambda x: x.id, reverse=True)
    return out


def _capped(lines: list[str], most: int | None) -> str:
    if most is not None and len(lines) > most:
        lines = [*lines[:most], f"... {len(lines) - most} more lines"]
    return "\n".join(lines)


def tree_text(found: DataFrame, most: int | None = None) -> str:
    """An explored tree, children below their parents by id, two spaces a level, at most ``most`` lines and
    a line that says how many are left out; ``found`` is the result of a bounded exploration."""
    return _capped(["  " * r.depth + r.id for r in _walk(found)], most)


def compact_text(found: DataFrame, entities: DataFrame, direction: str = "downstream", most: int | None = None) -> str:
    """The same tree as lines ``id | kind | direction | depth | file``."""
    named = found.join(entities.select("id", "file"), "id", "left")
    lines = [f"{r.id} | {r.kind or 'root'} | {direction if r.depth else 'origin'} | {r.depth} | {r.file or ''}" for r in _walk(named)]
    return _capped(lines, most)


def cycle_lines(found: DataFrame, entities: DataFrame, top: int = 20) -> DataFrame:
    """(part, place, line) of a cycle report: counts, how many cycles each length and area has, and the ``top``
    longest."""
    facts = analytics.cycle_summary(found, entities)
    said = F.array(*(F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in ("cycles", "entities", "files", "areas")))
    out = facts.select(F.lit(0).alias("part"), F.posexplode(said).alias("place", "line"))
    lengths = analytics.cycle_lengths(found).select(F.lit(1).alias("part"), F.col("length").alias("place"), F.concat(F.lit("length "), F.col("length").cast("string"), F.lit(": "), F.col("cycles").cast("string")).alias("line"))
    few = found.orderBy(F.desc("length"), "cycle").limit(top)
    rank = F.row_number().over(Window.orderBy(F.desc("length"), "cycle")) - 1  # over ``top`` rows
    first = F.concat(F.array_join("cycle", " -> "), F.lit(" -> "), F.element_at("cycle", 1))
    return out.unionByName(lengths).unionByName(few.select(F.lit(2).alias("part"), rank.alias("place"), first.alias("line")))


def snapshot_lines(entities: DataFrame, edges: DataFrame, features: int = 3, links: bool = True) -> DataFrame:
    """(section, place, line) of a snapshot: counts, areas with eight features, groups of entities with
    ``features`` each, and with ``links`` the most connected entities of folders and of the whole."""
    counts = build.metadata(entities, edges)
    said = F.array(*(F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in ("total_entities", "total_files", "functional_areas", "lifted_entities", "total_edges")))
    out = counts.select(F.lit(0).alias("section"), F.posexplode(said).alias("p", "line")).select("section", F.col("p").cast("string").alias("place"), "line")
    rows = entities.filter("hierarchy_path <> ''").select(F.substring_index("hierarchy_path", "/", 1).alias("area"), F.explode("semantic_features").alias("f")).distinct()
    rank = F.row_number().over(Window.partitionBy("area").orderBy("f"))
    areas = rows.withColumn("r", rank).filter("r <= 8").groupBy("area").agg(F.array_join(F.sort_array(F.collect_list("f")), ", ").alias("fs"))
    out = out.unionByName(areas.select(F.lit(1).alias("section"), F.col("area").alias("place"), F.concat("area", F.lit(": "), "fs").alias("line")))
    groups = analytics.snapshot_groups(entities, features)
    out = out.unionByName(groups.select(F.lit(2).alias("section"), F.col("hierarchy_path").alias("place"), F.concat("hierarchy_path", F.lit(" ("), F.col("entities").cast("string"), F.lit("): "), "sample").alias("line")))
    if links:
        near = analytics.skeleton(edges, entities)
        out = out.unionByName(near.select(F.lit(3).alias("section"), "folder", F.concat("folder", F.lit(": "), "entity", F.lit(" "), F.col("links").cast("string")).alias("line")).withColumnRenamed("folder", "place"))
        hot = analytics.hot_spots(edges)
        out = out.unionByName(hot.select(F.lit(4).alias("section"), F.col("id").alias("place"), F.concat("id", F.lit(" "), F.col("links").cast("string")).alias("line")))
    return out


def snapshot(entities: DataFrame, edges: DataFrame, budget: int = 30_000) -> tuple[str, int]:
    """(text, tokens): the fullest snapshot within a token budget: features go 3, 2, 1, 0, then links go; what
    is left is returned even beyond the budget.  Lines are counted before any come to the driver."""
    tokens, lines = 0, None
    for features, links in ((3, True), (2, True), (1, True), (0, True), (0, False)):
        lines = cut(snapshot_lines(entities, edges, features, links))
        tokens = (lines.agg(F.sum(F.length("line") + 1)).first()[0] or 0) // 4 + 500
        if tokens <= budget:
            break
    return "\n".join(r.line for r in lines.orderBy("section", "place", "line").collect()), tokens


def repository_info(name: str, files: DataFrame, entities: DataFrame, edges: DataFrame) -> str:
    """A paragraph about a repository for prompts: languages by files, counts, areas."""
    languages = files.groupBy("language").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "language").collect()  # a row a language
    m = build.metadata(entities, edges).first()
    areas = [r[0] for r in entities.filter("hierarchy_path <> ''").groupBy(F.substring_index("hierarchy_path", "/", 1).alias("a")).count().orderBy(F.desc("count"), "a").limit(20).collect()]
    spoken = ", ".join(f"{r.language} ({r.n})" for r in languages)
    return f"Repository: {name}\nLanguages: {spoken}\nEntities: {m.total_entities} in {m.total_files} files, {m.total_edges} edges\nAreas: {', '.join(areas)}\n"
