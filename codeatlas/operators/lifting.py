"""Semantic features: rules that give them, texts that carry them, and their critique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import drift, split_words
from ..schema import CodeGraph
from ..session import cut
from .order import numbered

#: Words of the critic (fixed values).
VAGUE = ["handle", "process", "manage", "deal", "do", "run", "execute", "perform", "work", "utilize"]
DETAIL = ["loop", "iterate", "array", "index", "variable", "pointer", "mutex", "allocate", "deallocate", "malloc", "free", "increment", "decrement"]
MINOR, MAJOR = 0.3, 0.7


def normalise_features(features: Column) -> Column:
    return F.sort_array(F.array_distinct(F.filter(F.transform(features, lambda f: F.lower(F.trim(f))), lambda f: f != "")))


def parse_lines(texts: DataFrame) -> DataFrame:
    """(name, features) of lines ``name | f1, f2`` in (text): thinking blocks, blank lines, comments
    and fences are skipped."""
    plain = F.regexp_replace("text", r"(?s)<think>.*?</think>", "")
    lines = texts.select(F.explode(F.split(plain, "\n")).alias("l")).select(F.trim("l").alias("l"))
    lines = lines.filter("l <> '' AND NOT startswith(l, '#') AND NOT startswith(l, '```') AND instr(l, '|') > 0")
    name = F.trim(F.substring_index("l", "|", 1))
    features = normalise_features(F.split(F.regexp_replace("l", r"^[^|]*\|", ""), ","))
    return lines.select(name.alias("name"), features.alias("features")).filter("name <> '' AND size(features) > 0")


def critique(entities: DataFrame) -> DataFrame:
    """(id, feature, issue): duplicate (whatever the case), too_short, too_long, vague_verb,
    implementation_detail; a feature that is too short is not looked at for the last two."""
    rows = entities.select("id", F.posexplode("semantic_features").alias("pos", "feature"), "semantic_features")
    words = F.filter(F.split(F.lower("feature"), r"\s+"), lambda w: w != "")
    first = F.array_position(F.transform("semantic_features", F.lower), F.lower("feature")) - 1
    enough = F.size(words) >= 2
    found = F.array_compact(F.array(
        F.when(first < F.col("pos"), F.lit("duplicate")),
        F.when(F.size(words) < 2, F.lit("too_short")),
        F.when(F.size(words) > 10, F.lit("too_long")),
        F.when(enough & F.get(words, F.lit(0)).isin(VAGUE), F.lit("vague_verb")),
        F.when(enough & F.arrays_overlap(words, F.array(*map(F.lit, DETAIL))), F.lit("implementation_detail")),
    ))
    return rows.select("id", "feature", F.explode(found).alias("issue"))


def drift_zones(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, drift, zone) of entities in both: minor under 0.3, borderline, route over 0.7."""
    both = old.select("id", F.col("features").alias("o")).join(new.select("id", F.col("features").alias("n")), "id")
    d = drift(F.col("o"), F.col("n"))
    return both.select("id", F.round(d, 6).alias("drift"), F.when(d < MINOR, "minor").when(d <= MAJOR, "borderline").otherwise("route").alias("zone"))


def matcher(rule: dict) -> Column:
    """The condition of a rule: all of its parts hold.  Parts: kind, name_exact, name_regex,
    max_lines, max_branches, max_loops, max_calls, starts_uppercase, min_length, source_contains_any,
    file_stem, path_contains."""
    out = F.lit(True)
    stem = F.regexp_extract("file", r"([^/]+)$", 1)
    tests = {
        "kind": lambda v: F.col("kind").isin(v if isinstance(v, list) else [v]),
        "name_exact": lambda v: F.lower("name").isin([x.lower() for x in (v if isinstance(v, list) else [v])]),
        "name_regex": lambda v: F.col("name").rlike(v),
        "max_lines": lambda v: F.col("lines") <= v,
        "max_branches": lambda v: F.col("branches") <= v,
        "max_loops": lambda v: F.col("loops") <= v,
        "max_calls": lambda v: F.col("calls") <= v,
        "starts_uppercase": lambda v: F.col("name").rlike(r"^\p{Lu}") == F.lit(v),
        "min_length": lambda v: F.octet_length("name") >= v,
        "source_contains_any": lambda v: F.exists(F.array(*map(F.lit, v)), lambda x: F.contains(F.col("source"), x)),
        "file_stem": lambda v: F.substring_index(stem, ".", 1) == v,
        "path_contains": lambda v: F.contains(F.col("file"), F.lit(v)),
    }
    for part, value in rule["match"].items():
        out = out & tests[part](value)
    return out


def classify(entities: DataFrame, rules: list[dict]) -> DataFrame:
    """Entities with the kind of the first rule that fits, by (priority, order): only functions and
    classes change; ``skip`` keeps the kind and ends the search; ``tag`` adds a tag and goes on.  The
    rules become one CASE expression."""
    check_rules(rules)
    ordered = sorted(rules, key=lambda r: r.get("priority", 100))
    kind, tags = F.col("kind"), []
    for r in reversed([r for r in ordered if r["action"] != "tag"]):
        kind = F.when(matcher(r), F.lit(r["kind"]) if r["action"] == "reclassify" else F.col("kind")).otherwise(kind)
    stopped = F.lit(False)
    for r in ordered:
        if r["action"] == "tag":
            tags.append(F.when(matcher(r) & ~stopped, F.lit(r["tag"])))
        else:
            stopped = stopped | matcher(r)
    open_ = F.col("kind").isin("function", "class")
    out = entities.withColumn("new_kind", F.when(open_, kind).otherwise(F.col("kind")))
    return out.withColumn("tags", F.when(open_, F.array_compact(F.array(*tags))).otherwise(F.array().cast("array<string>")) if tags else F.array().cast("array<string>"))


def check_rules(rules: list[dict]) -> None:
    """Ids are unique, actions known, patterns compile, templates use known names."""
    import re

    ids = [r["id"] for r in rules]
    if len(set(ids)) < len(ids):
        raise ValueError("rule ids must be unique")
    for r in rules:
        if r.get("action", "features") not in ("reclassify", "skip", "tag", "features"):
            raise ValueError(f"unknown action in {r['id']}")
        if "name_regex" in r["match"]:
            re.compile(r["match"]["name_regex"])
        for t in r.get("features", []):
            unknown = set(re.findall(r"\{(\w+)\}", t)) - {"name", "name_lower", "parent", "parent_lower", "field", "verb", "kind"}
            if unknown:
                raise ValueError(f"unknown variables {unknown} in {r['id']}")
            if "{field}" in t and not r.get("strip_prefix"):
                raise ValueError(f"{r['id']} needs strip_prefix")
            if "{verb}" in t and set(r.get("prefix_verb", {})) < set(r.get("strip_prefix", ["?"])):
                raise ValueError(f"{r['id']} needs a verb for each prefix")


def expand(template: str, rule: dict) -> Column:
    """A feature template as a column: the first prefix that fits is stripped for {field} and {verb}."""
    name = F.col("name")
    field, verb = name, F.lit("")
    for p in reversed(rule.get("strip_prefix", [])):
        field = F.when(name.startswith(p), F.substring(name, F.lit(len(p) + 1), F.length(name))).otherwise(field)
        verb = F.when(name.startswith(p), F.lit(rule.get("prefix_verb", {}).get(p, ""))).otherwise(verb)
    values = {"name": name, "name_lower": split_words(name), "parent": F.coalesce("parent_class", F.lit("")), "parent_lower": split_words(F.coalesce("parent_class", F.lit(""))), "field": split_words(field), "verb": verb, "kind": F.col("kind")}
    out = F.lit(template)
    for k, v in values.items():
        if "{" + k + "}" in template:
            out = F.replace(out, F.lit("{" + k + "}"), v)
    return F.trim(out)


def auto_lift(entities: DataFrame, rules: list[dict]) -> DataFrame:
    """(id, rule, confidence, features): the first rule that fits gives features; confidence is
    accept, review or reject by the structural counters, and accept for rules without gates."""
    check_rules([r | {"action": "features"} for r in rules])
    gates = {"max_branches", "max_loops", "max_calls", "max_lines"}
    by_size = F.when((F.col("branches") > 1) | (F.col("loops") > 0), "reject").when((F.col("branches") == 0) & (F.col("calls") <= 2), "accept").otherwise("review")
    chosen = F.lit(None).cast("struct<rule:string,confidence:string,features:array<string>>")
    for r in reversed(sorted(rules, key=lambda r: r.get("priority", 100))):
        confidence = by_size if gates & set(r["match"]) else F.lit("accept")
        made = F.struct(F.lit(r["id"]).alias("rule"), confidence.alias("confidence"), normalise_features(F.array(*(expand(t, r) for t in r["features"]))).alias("features"))
        chosen = F.when(matcher(r), made).otherwise(chosen)
    return entities.withColumn("m", chosen).filter("m IS NOT NULL").select("id", "m.rule", "m.confidence", "m.features")


def submit_features(entities: DataFrame, submitted: DataFrame) -> DataFrame:
    """Entities with the features of (key, features): key is an id, else ``file:name`` of all that match."""
    new = submitted.select("key", normalise_features(F.col("features")).alias("new"))
    by_id = new.join(entities.select(F.col("id").alias("key")), "key")
    rest = new.join(entities.select(F.col("id").alias("key")), "key", "left_anti")
    named = entities.select("id", F.concat("file", F.lit(":"), "name").alias("key")).join(rest, "key").select("id", "new")
    out = entities.join(by_id.withColumnRenamed("key", "id").unionByName(named).dropDuplicates(["id"]), "id", "left")
    return out.withColumn("semantic_features", F.coalesce("new", "semantic_features")).select(entities.columns)


def check_routing(decisions: DataFrame, pending: DataFrame, paths: DataFrame, seen: str | None = None) -> DataFrame:
    """(id, decision, problem): a decision must be pending, and ``keep`` or an existing path of three
    levels; the problem is null where it may be applied.  Decisions for another revision than that of
    ``pending`` are an error."""
    from .hierarchy import three_levels

    if seen is not None and seen != revision(pending):
        raise ValueError("the queue has changed since the decisions were made")

    rows = decisions.join(pending.select("id", F.lit(True).alias("p")), "id", "left").join(paths.select(F.col("path").alias("decision"), F.lit(True).alias("known")), "decision", "left")
    problem = F.when(F.col("p").isNull(), "not pending").when(F.col("decision") == "keep", None).when(~three_levels(F.col("decision")), "not three levels").when(F.col("known").isNull(), "unknown path")
    return rows.select("id", "decision", problem.alias("problem"))


def finalize(graph: CodeGraph, pending: DataFrame) -> CodeGraph:
    """The end of a lifting session: entities of ``pending`` (id) take the most similar place by their
    features, modules take all their files' features, and containment is made again."""
    from .analytics import module_features
    from .graph import containment
    from .hierarchy import best_paths, features

    entities = graph.entities
    items = entities.join(pending.select("id").distinct(), "id", "left_semi").filter("size(semantic_features) > 0").select("id", F.col("semantic_features").alias("features"))
    entities = entities.join(best_paths(items, features(entities)), "id", "left").withColumn("hierarchy_path", F.coalesce("best_path", "hierarchy_path")).select(graph.entities.columns)
    whole = module_features(entities).withColumnRenamed("features", "f0")
    of_module = F.when(F.col("kind") == "module", F.coalesce("f0", F.array().cast("array<string>"))).otherwise(F.col("semantic_features"))
    entities = cut(entities.join(whole, "file", "left").withColumn("semantic_features", of_module).select(graph.entities.columns))
    return CodeGraph(entities, graph.edges.filter("kind <> 'contains'").unionByName(containment(entities)), graph.references)


def routing_page(pending: DataFrame, tree: DataFrame, page: int = 0, size: int = 20) -> tuple[DataFrame, str]:
    """(id, features, candidate) of a page of ``pending`` (id, features) in order of id, with the most similar
    place of ``tree`` (path, features), and the queue's revision: decisions are for the queue that was seen."""
    from .hierarchy import best_paths

    rows = numbered(pending.select("id", "features"), ["id"]).filter(F.col("pos").between(page * size, (page + 1) * size - 1))
    best = best_paths(rows.select("id", "features"), tree).withColumnRenamed("best_path", "candidate")
    return rows.join(best, "id", "left").select("id", "features", "candidate"), revision(pending)


def revision(pending: DataFrame) -> str:
    """A digest of the queue's ids, whatever their order."""
    row = pending.agg(F.count(F.lit(1)).alias("n"), F.sum(F.crc32(F.col("id").cast("binary"))).alias("a"), F.bit_xor(F.xxhash64("id")).alias("b")).first()
    return f"{row.n}-{row.a or 0}-{row.b or 0}"


#: Entities that must be lifted, and their share, before a hierarchy is made (fixed values).
LIFTED_LEAST, LIFTED_SHARE, SYNTHESIS_PAGE = 20, 0.3, 8


def hierarchy_allowed(entities: DataFrame) -> bool:
    """Whether enough is lifted for a hierarchy by features."""
    from .hierarchy import coverage_overall

    row = coverage_overall(entities).first()
    return row.lifted >= LIFTED_LEAST and row.lifted >= LIFTED_SHARE * row.total


def synthesis_page(entities: DataFrame, page: int = 0, size: int = SYNTHESIS_PAGE) -> DataFrame:
    """(file, features) of a page of files with features, in order of file."""
    from .analytics import module_features

    rows = numbered(module_features(entities), ["file"])
    return rows.filter(F.col("pos").between(page * size, (page + 1) * size - 1)).select("file", "features")


def submit_synthesis(entities: DataFrame, submitted: DataFrame) -> DataFrame:
    """Entities whose modules have the features of (file, text), separated by commas, instead of theirs.
    Files are equal, or one path is the other's end; of several that fit the longest, then the first decides.
    Files of one name meet, so that no pair of all files is made."""
    name = lambda c: F.substring_index(c, "/", -1)
    new = submitted.select(F.col("file").alias("asked"), normalise_features(F.split("text", ",")).alias("new"), name("file").alias("name"))
    modules = entities.filter("kind = 'module'").select("id", "file", name("file").alias("name"))
    fits = (F.col("file") == F.col("asked")) | F.endswith("file", F.concat(F.lit("/"), "asked")) | F.endswith("asked", F.concat(F.lit("/"), "file"))
    best = F.min(F.struct((-F.length("asked")).alias("n"), "asked", "new")).alias("m")
    found = modules.join(new, "name").filter(fits).groupBy("id").agg(best).select("id", "m.new")
    out = entities.join(found, "id", "left")
    return out.withColumn("semantic_features", F.coalesce("new", "semantic_features")).select(entities.columns)
