"""Queries of what keeps a graph up to date: changes, renames, routing, lifting sessions, stores, extraction."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import analytics, evolve, hierarchy, lifting, planning, traverse
from ..operators import graph as build
from ..schema import CodeGraph
from ..session import cut, shared_dir
from ..sources import files as store
from ..sources.extract import extract
from ..streaming.sync import reverted
from . import export
from .queries import _AUTO, _TRANSITIONS, QUERY, _bfs, _cycles, stored_graph
from .registry import ORACLES, query
from .tables import GRAPH_SQL, entities, graph, read


def folder(spark, name):
    """A place of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def text(*parts):
    """Columns and literals one after the other as text."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query("SELECT id, name, line_start FROM entities WHERE NOT (kind = 'model' AND line_start % 5 = 0) UNION ALL SELECT id, 'new ' || name, line_start + 7 FROM entities WHERE kind = 'model' AND line_start % 5 = 0 UNION ALL SELECT 'new:' || id, name, line_start FROM entities WHERE kind = 'service'")
def insert_entities(spark, sf):
    """Some parts come twice, the last by line wins; suppliers come under other ids."""
    e = entities(spark, sf)
    again = e.filter("kind = 'model' AND line_start % 5 = 0").withColumn("name", text("new ", F.col("name")))
    more = e.filter("kind = 'service'").withColumn("id", text("new:", F.col("id")))
    return build.insert(e, again.unionByName(again.withColumn("line_start", F.col("line_start") + 7)).unionByName(more)).select("id", "name", "line_start")


_CALLS = "o AS (SELECT e.id AS source, e.file, c_name AS name, o_custkey AS k FROM orders JOIN entities e ON e.id = 'order:' || o_orderkey JOIN customer ON c_custkey = o_custkey)"


@query("WITH " + _CALLS + " SELECT DISTINCT source, file, name, 'invokes' AS kind FROM o UNION ALL SELECT DISTINCT source, file, name, 'imports' FROM o WHERE k % 3 = 0")
def populate_references(spark, sf):
    """Orders call customers by qualified names, and a third of the customers are imported by their files; what
    is composed belongs to modules alone, of which there are none."""
    e = entities(spark, sf).select("id", "kind", "name", "file")
    at = e.select(F.col("id").alias("i"), "file")
    calls = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(at, F.col("i") == text("order:", F.col("o_orderkey")))
    none = F.lit(None).cast("string").alias("module")
    row = lambda kind, caller, callee: calls.select("file", F.lit(kind).alias("kind"), caller.alias("caller"), callee.alias("callee"), none, "o_custkey")
    caller = text("Sales::Order#", F.col("o_orderkey"))
    raw = row("invokes", caller, text("crm.", F.col("c_name"))).unionByName(row("imports", F.lit(""), text("a/b/", F.col("c_name"))).filter("o_custkey % 3 = 0")).unionByName(row("composes", caller, F.col("c_name")))
    return build.populate_dependencies(e, raw.drop("o_custkey"))


@query("SELECT * FROM edges WHERE source = 'part:7' OR target = 'part:7'")
def edges_for(spark, sf):
    return build.edges_for(graph(spark, sf).edges, "part:7")


@query("WITH f AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 50 % 4 = 1 THEN 'g/f' ELSE 'f' END || c_custkey % 50 || '.py' AS file FROM customer) SELECT file || ':run_' || k AS id, file, NULL AS target FROM f UNION ALL SELECT a.file || ':run_' || a.k, NULL, b.file || ':run_' || b.k FROM f a JOIN f b ON b.k = a.k + 1", with_graph=False)
def rename_files(spark, sf):
    """Fifty files of functions that call the next one; every fourth file moves, and ids and ends follow."""
    k = F.col("c_custkey")
    at = lambda k: text("f", k % 50, ".py")
    name = lambda k: text(at(k), ":run_", k)
    customers = read(spark, sf, "customer").select("c_custkey")
    links = customers.join(customers.select((k - 1).alias("before")), k == F.col("before")).select(name(k).alias("source"), name(k + 1).alias("target"), F.lit("invokes").alias("kind"))
    moved = customers.select((k % 50).alias("j")).distinct().filter("j % 4 = 1").select(text("f", F.col("j"), ".py").alias("from_path"), text("g/f", F.col("j"), ".py").alias("path"))
    g = evolve.apply_renames(CodeGraph(customers.select(name(k).alias("id"), at(k).alias("file")), links), moved)
    none = F.lit(None).cast("string")
    return g.entities.select("id", "file", none.alias("target")).unionByName(g.edges.select(F.col("source").alias("id"), none.alias("file"), "target"))


@query("""WITH c AS (SELECT ['added', 'modified', 'deleted', 'renamed'][c_custkey % 4 + 1] AS op, CASE WHEN c_custkey % 5 = 0 THEN 'gen/f' ELSE 'src/f' END || c_custkey || ['.py', '.txt', '.rs'][c_custkey % 3 + 1] AS path,
CASE WHEN c_custkey % 4 = 3 THEN CASE WHEN c_custkey % 11 = 0 THEN 'gen/f' ELSE 'old/f' END || c_custkey || CASE WHEN c_custkey % 7 = 0 THEN '.md' ELSE '.py' END END AS from_path FROM customer),
g AS (SELECT *, regexp_matches(path, '[.](py|rs)$') AND NOT starts_with(path, 'gen/') AS new, from_path IS NOT NULL AND regexp_matches(from_path, '[.](py|rs)$') AND NOT starts_with(from_path, 'gen/') AS old FROM c)
SELECT op, path, NULL AS from_path FROM g WHERE op <> 'renamed' AND new UNION ALL SELECT 'renamed', path, from_path FROM g WHERE op = 'renamed' AND new AND old
UNION ALL SELECT 'added', path, NULL FROM g WHERE op = 'renamed' AND new AND NOT old UNION ALL SELECT 'deleted', from_path, NULL FROM g WHERE op = 'renamed' AND NOT new AND old""", with_graph=False)  # fmt: skip
def keep_changes(spark, sf):
    k = F.col("c_custkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values)).cast("int") + 1)
    op = pick(["added", "modified", "deleted", "renamed"])
    path = text(F.when(k % 5 == 0, "gen/f").otherwise("src/f"), k, pick([".py", ".txt", ".rs"]))
    old = F.when(op == "renamed", text(F.when(k % 11 == 0, "gen/f").otherwise("old/f"), k, F.when(k % 7 == 0, ".md").otherwise(".py")))
    return evolve.keep_changes(read(spark, sf, "customer").select(op.alias("op"), path.alias("path"), old.alias("from_path")), ["py", "rs"], ["gen/*"])


@query("SELECT DISTINCT 'ignored' AS why, file AS path FROM entities WHERE starts_with(file, 'ASIA/') UNION ALL SELECT DISTINCT 'vanished', file FROM entities WHERE starts_with(file, 'PARTS/')")
def lost_files(spark, sf):
    """Files that are newly ignored, and files that are not there any more."""
    e = entities(spark, sf)
    there = e.filter("NOT startswith(file, 'PARTS/')").select(F.col("file").alias("path"))
    return evolve.newly_ignored(e, ["ASIA/*"]).select(F.lit("ignored").alias("why"), "path").unionByName(evolve.vanished(e, there).select(F.lit("vanished").alias("why"), "path"))


@query("SELECT id FROM entities WHERE starts_with(file, 'ASIA/') AND line_start % 3 <> 0 AND line_start % 4 <> 0")
def stale_features(spark, sf):
    """Files of Asia were modified; a third of the entities is gone, and a quarter had no features."""
    e = entities(spark, sf)
    old = e.withColumn("semantic_features", F.when(F.col("line_start") % 4 != 0, F.col("semantic_features")).otherwise(F.array().cast("array<string>")))
    return evolve.stale(old, e.filter("line_start % 3 <> 0"), e.filter("startswith(file, 'ASIA/')").select("file").distinct())


@query("SELECT DISTINCT 'modified' AS op, file AS path FROM entities WHERE NOT starts_with(file, 'PARTS/')")
def reverted_files(spark, sf):
    paths = entities(spark, sf).select(F.col("file").alias("path"))
    return reverted(paths, paths.filter("startswith(path, 'PARTS/')").distinct()).select("op", "path")


@query("WITH n AS (SELECT name, count(*) AS c FROM entities GROUP BY name) SELECT id, CASE WHEN kind = 'model' AND line_start % 10 = 0 THEN 'New/id/' || line_start WHEN kind IN ('model', 'service') AND c = 1 THEN 'New/name/' || left(name, 3) ELSE hierarchy_path END AS hierarchy_path FROM entities JOIN n USING (name)")
def apply_assignments(spark, sf):
    """Some parts get places by id; parts and suppliers by name, where one entity has it."""
    e = entities(spark, sf)
    by_id = e.filter("kind = 'model' AND line_start % 10 = 0").select(F.col("id").alias("key"), text("New/id/", F.col("line_start")).alias("path"))
    by_name = e.filter("kind IN ('model', 'service')").select(F.col("name").alias("key"), text("New/name/", F.substring("name", 1, 3)).alias("path")).distinct()
    return hierarchy.apply_assignments(e, by_id.unionByName(by_name)).select("id", "hierarchy_path")


@query("SELECT id, CASE line_start % 4 WHEN 0 THEN 'keep' WHEN 1 THEN hierarchy_path WHEN 2 THEN 'PARTS/none' ELSE 'A/b/c' END AS decision, CASE WHEN line_start % 3 = 0 THEN 'not pending' WHEN line_start % 4 IN (0, 1) THEN NULL WHEN line_start % 4 = 2 THEN 'not three levels' ELSE 'unknown path' END AS problem FROM entities WHERE kind = 'model'")
def check_routing(spark, sf):
    e, n = entities(spark, sf), F.col("line_start") % 4
    parts = e.filter("kind = 'model'")
    decision = F.when(n == 0, "keep").when(n == 1, F.col("hierarchy_path")).when(n == 2, "PARTS/none").otherwise("A/b/c")
    return lifting.check_routing(parts.select("id", decision.alias("decision")), parts.filter("line_start % 3 <> 0").select("id"), e.select(F.col("hierarchy_path").alias("path")).distinct())


@query("""WITH up AS (SELECT id, kind, line_start, semantic_features, array_to_string(list_slice(string_split(hierarchy_path, '/'), 1, i), '/') AS path FROM entities, range(1, 4) t(i)),
uf AS (SELECT DISTINCT id, path, unnest(semantic_features) AS f FROM up), cnt AS (SELECT path, f, count(*) AS n FROM uf GROUP BY ALL), tm AS (SELECT path, count(*) AS m FROM cnt GROUP BY path),
it AS (SELECT DISTINCT id, unnest(semantic_features) AS f FROM entities WHERE kind = 'class' AND line_start % 40 = 0), nn AS (SELECT id, count(*) AS k FROM it GROUP BY id),
own AS (SELECT uf.* FROM uf JOIN nn USING (id)), lost AS (SELECT own.id, path, count(*) AS lost FROM own JOIN cnt USING (path, f) WHERE n = 1 GROUP BY ALL),
met AS (SELECT it.id, cnt.path, count(*) AS met FROM it JOIN cnt USING (f) LEFT JOIN own ON own.id = it.id AND own.path = cnt.path AND own.f = it.f WHERE n > CASE WHEN own.id IS NULL THEN 0 ELSE 1 END GROUP BY ALL),
sims AS (SELECT id, path, len(string_split(path, '/')) AS level, met.met::DOUBLE / (k + m - coalesce(lost, 0) - met.met) AS sim FROM met JOIN nn USING (id) JOIN tm USING (path) LEFT JOIN lost USING (id, path)),
l1 AS (SELECT * FROM sims WHERE level = 1 AND sim >= 0.05 QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, path) = 1),
l2 AS (SELECT s.* FROM sims s JOIN l1 ON l1.id = s.id AND regexp_replace(s.path, '/[^/]*$', '') = l1.path AND s.level = 2 AND s.sim > l1.sim QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY s.sim DESC, s.path) = 1),
l3 AS (SELECT s.* FROM sims s JOIN l2 ON l2.id = s.id AND regexp_replace(s.path, '/[^/]*$', '') = l2.path AND s.level = 3 AND s.sim > l2.sim QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY s.sim DESC, s.path) = 1)
SELECT e.id, coalesce(l3.path, l2.path, l1.path, e.hierarchy_path) AS hierarchy_path FROM entities e LEFT JOIN l1 USING (id) LEFT JOIN l2 USING (id) LEFT JOIN l3 USING (id)""")  # fmt: skip
def reroute_drifted(spark, sf):
    """Every fortieth customer has drifted and takes the best place by others' features."""
    e = cut(entities(spark, sf))
    drifted = e.filter("kind = 'class'").select("id", F.when(F.col("line_start") % 40 == 0, 0.9).otherwise(0.2).alias("drift"))
    return hierarchy.reroute(e, hierarchy.feature_counts(e), drifted).select("id", "hierarchy_path")


@query("WITH p AS (SELECT DISTINCT array_to_string(list_slice(string_split(hierarchy_path || '/more', '/'), 1, i), '/') AS path FROM entities, range(1, 5) t(i) UNION SELECT 'a/ /b') SELECT path, len(string_split(path, '/')) = 3 AND len(list_filter(string_split(path, '/'), lambda x: trim(x) = '')) = 0 AS fits FROM p")
def three_levels(spark, sf):
    paths = entities(spark, sf).select(F.explode(hierarchy.prefixes(text(F.col("hierarchy_path"), "/more"))).alias("path"))
    return paths.unionByName(spark.createDataFrame([("a/ /b",)], "path string")).distinct().select("path", hierarchy.three_levels(F.col("path")).alias("fits"))


@query("""SELECT 'all' AS scope, id FROM entities WHERE line_start % 3 = 0 UNION ALL SELECT 'glob', id FROM entities WHERE regexp_matches(file, '^PARTS/Brand#1.$') UNION ALL SELECT 'place', id FROM entities WHERE starts_with(hierarchy_path || '/', 'ASIA/INDIA/')
UNION ALL SELECT 'ids', id FROM entities WHERE id IN ('part:7', 'order:9')""")
def resolve_scope(spark, sf):
    e = entities(spark, sf).withColumn("semantic_features", F.when(F.col("line_start") % 3 > 0, F.col("semantic_features")))
    asked = {"all": "ALL", "glob": "PARTS/Brand#1?", "place": "ASIA/INDIA", "ids": "part:7, order:9,none"}
    some = [hierarchy.resolve_scope(e, scope).select(F.lit(name).alias("scope"), "id") for name, scope in asked.items()]
    return some[0].unionByName(some[1]).unionByName(some[2]).unionByName(some[3])


@query("SELECT ['python', 'rust', 'typescript', 'java', NULL, 'kotlin'][doc_id % 6 + 1] AS language, count(*) AS files FROM documents GROUP BY 1", with_graph=False)
def detect_languages(spark, sf):
    """Languages by the ends of names, whatever their case."""
    end = F.element_at(F.array(*map(F.lit, ["py", "rs", "tsx", "JAVA", "txt", "kt"])), (F.col("doc_id") % 6).cast("int") + 1)
    path = text("d.x/", F.col("doc_id"), ".", end)
    return store.detect_languages(read(spark, sf, "documents").select(store.language_of(path).alias("language")))


@query("SELECT 'a/' || id AS id, file, NULL AS target FROM entities UNION ALL SELECT source, kind, target FROM edges")
def saved_graph(spark, sf):
    """Written and read back, with forward slashes in ids."""
    g = graph(spark, sf)
    rest = {"parent_class": "string", "feature_source": "string", "signature": "struct<parameters: array<struct<name: string, type_annotation: string>>, return_type: string>"}
    e = g.entities.withColumn("id", text("a\\", F.col("id"))).withColumns({c: F.lit(None).cast(t) for c, t in rest.items()})
    g = store.load(spark, store.save(CodeGraph(e, g.edges), folder(spark, "graph"), "v0"))
    return g.entities.select("id", "file", F.lit(None).cast("string").alias("target")).unionByName(g.edges.select(F.col("source").alias("id"), F.col("kind").alias("file"), "target"))


@query("SELECT 'part:' || vec_id AS entity_id, 0 AS feature_ord, round(embedding[1]::DOUBLE, 6) AS first_value, len(embedding)::INT AS dim FROM embeddings", with_graph=False)
def saved_vectors(spark, sf):
    path = folder(spark, "vectors")
    rows = read(spark, sf, "embeddings").select(text("part:", F.col("vec_id")).alias("entity_id"), F.lit(0).alias("feature_ord"), F.col("embedding").alias("vector"), F.lit("f").alias("fingerprint"))
    store.save_vectors(rows, path)
    back = store.load_vectors(spark, path)
    return back.select("entity_id", "feature_ord", F.round(F.element_at("vector", 1).cast("double"), 6).alias("first_value"), F.size("vector").alias("dim"))


@query("SELECT id, array_to_string(semantic_features, ',') AS features FROM entities WHERE line_start % 2 = 0")
def saved_queue(spark, sf):
    """A queue that was written, and written again in the place of the first."""
    path, rows = folder(spark, "queue"), entities(spark, sf).select("id", "line_start", F.col("semantic_features").alias("features"))
    store.save_queue(rows, path)
    store.save_queue(rows.filter("line_start % 2 = 0"), path)
    return store.load_queue(spark, path).select("id", F.array_join("features", ",").alias("features"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(replace(text, ' ', chr(10)), chr(10)), doc_id % 5 + 1, doc_id % 5 + 1 + least(doc_id % 4, 1)), chr(10)) AS source FROM documents", with_graph=False)
def source_slices(spark, sf):
    """Lines of sources, two at most; words stand for lines."""
    start = (F.col("doc_id") % 5 + 1).cast("int")
    lines = traverse.source_slice(F.replace("text", F.lit(" "), F.lit("\n")), start, start + (F.col("doc_id") % 4).cast("int"), 2)
    return read(spark, sf, "documents").select("doc_id", lines.alias("source"))


@query("SELECT array_to_string(list_sort(list(DISTINCT split_part(hierarchy_path, '/', 2))), ',') AS children, count(*) AS entity_count FROM entities WHERE starts_with(hierarchy_path, 'ASIA/')")
def fetch_node(spark, sf):
    return traverse.fetch_node(entities(spark, sf), "ASIA")


@query(GRAPH_SQL + " SELECT id, array_to_string(semantic_features, ',') AS features, best_path AS candidate FROM entities LEFT JOIN (" + ORACLES["best_path_routing"] + ") b USING (id) WHERE kind = 'model' ORDER BY id LIMIT 20 OFFSET 20", with_graph=False)
def routing_page(spark, sf):
    e = entities(spark, sf)
    page, _ = lifting.routing_page(e.filter("kind = 'model'").select("id", F.col("semantic_features").alias("features")), hierarchy.features(e), 1)
    return page.withColumn("features", F.array_join("features", ","))


_BASE = r"regexp_extract(file, '([^/]+?)(\.[^./]*)?$', 1)"


@query(GRAPH_SQL + " SELECT id, CASE WHEN kind = 'model' THEN coalesce(best_path, hierarchy_path) ELSE hierarchy_path END AS hierarchy_path, array_to_string(semantic_features, ',') AS features FROM entities LEFT JOIN (" + ORACLES["best_path_routing"] + f") b USING (id) UNION ALL SELECT file || ':' || {_BASE}, NULL, array_to_string(list_sort(list(DISTINCT f)), ',') FROM (SELECT file, unnest(semantic_features) AS f FROM entities) GROUP BY file", with_graph=False)
def finalize_session(spark, sf):
    """The end of a session in which all parts wait for a place."""
    g = graph(spark, sf)
    whole = cut(g.entities.unionByName(build.module_entities(g.entities), allowMissingColumns=True))
    done = lifting.finalize(CodeGraph(whole, g.edges), whole.filter("kind = 'model'").select("id")).entities
    return done.select("id", "hierarchy_path", F.array_join("semantic_features", ",").alias("features"))


@query("SELECT file, array_to_string(list_sort(list(DISTINCT f)), ',') AS features FROM (SELECT file, unnest(semantic_features) AS f FROM entities) GROUP BY file ORDER BY file LIMIT 8 OFFSET 8")
def synthesis_page(spark, sf):
    return lifting.synthesis_page(entities(spark, sf), 1).select("file", F.array_join("features", ",").alias("features"))


@query(f"SELECT DISTINCT file || ':' || {_BASE} AS id, CASE WHEN starts_with(file, 'PARTS/') THEN NULL WHEN contains(file, 'ASIA/') THEN 'deep' ELSE 'read b,x' END AS features FROM entities")
def submit_synthesis(spark, sf):
    """Nations by the end of their files' paths; for Asia also by region, which is longer and wins."""
    modules = build.module_entities(entities(spark, sf)).withColumn("semantic_features", F.lit(None).cast("array<string>"))
    place = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    end = place.select(F.col("n_name").alias("file"), F.lit("X, Read B , read b,").alias("text"))
    deep = place.filter("r_name = 'ASIA'").select(F.concat_ws("/", "r_name", "n_name").alias("file"), F.lit("deep").alias("text"))
    return lifting.submit_synthesis(modules, end.unionByName(deep)).select("id", F.array_join("semantic_features", ",").alias("features"))


@query("SELECT id, CASE kind WHEN 'service' THEN 'a,b' WHEN 'class' THEN 'by name' ELSE array_to_string(semantic_features, ',') END AS features FROM entities")
def submit_features(spark, sf):
    """Suppliers by id, customers by file and name."""
    e = entities(spark, sf)
    by_id = e.filter("kind = 'service'").select(F.col("id").alias("key"), F.array(*map(F.lit, [" B ", "a", "b", ""])).alias("features"))
    named = e.filter("kind = 'class'").select(F.concat_ws(":", "file", "name").alias("key"), F.array(F.lit("By Name")).alias("features"))
    return lifting.submit_features(e, by_id.unionByName(named)).select("id", F.array_join("semantic_features", ",").alias("features"))


@query("SELECT 'hot[' || count(*) || '|]{id|links}:' || chr(10) || string_agg('  ' || id || '|' || links, chr(10) ORDER BY links DESC, id) AS table_text FROM (" + ORACLES["hot_spots"] + ")", with_graph=False)
def pipe_table(spark, sf):
    return spark.createDataFrame([(export.pipe_table("hot", analytics.hot_spots(graph(spark, sf).edges)),)], "table_text string")


@query(_AUTO + """, u1 AS (SELECT DISTINCT au.id AS root, source AS id FROM au JOIN edges ON target = au.id WHERE source <> au.id), u2 AS (SELECT DISTINCT root, source AS id FROM u1 JOIN edges ON target = u1.id WHERE source <> root),
un AS (SELECT root, id, min(depth) AS depth FROM (SELECT *, 1 AS depth FROM u1 UNION ALL SELECT *, 2 FROM u2) GROUP BY ALL), few AS (SELECT root, un.id, file FROM un LEFT JOIN entities USING (id) QUALIFY row_number() OVER (PARTITION BY root ORDER BY depth, un.id) <= 50),
im AS (SELECT root, count(*) AS n, count(DISTINCT file) AS files FROM few GROUP BY root)
SELECT au.id, (row_number() OVER (ORDER BY au.id DESC) - 1)::INT AS place, round(score, 6) AS score, coalesce(n, 0) AS upstream, coalesce(files, 0) AS files FROM au LEFT JOIN im ON root = au.id""")  # fmt: skip
def plan_change(spark, sf):
    """The plan's order of changes, its hits' scores, and how many depend on them; no hit depends on another
    here, so that the greatest id comes first."""
    g = stored_graph(spark, sf)
    plan = planning.plan_change(cut(g.entities), g.edges, QUERY)
    place, near = {x: i for i, x in enumerate(plan["order"])}, {x["id"]: x for x in plan["impact"]}
    rows = [(r["id"], place[r["id"]], float(round(r["score"], 6)), near[r["id"]]["upstream"], near[r["id"]]["files"]) for r in plan["relevant"]]
    return spark.createDataFrame(rows, "id string, place int, score double, upstream long, files long")


#: A source of each of six languages, with @ for a customer's number.
SOURCES = [
    ("typescript", "export class Box@ {\n}\nexport function go@(a: number) {\n  return stop@(a);\n}\n"),
    ("go", "type T@ struct {\n}\nfunc Go@(a int) int {\n\treturn stop@(a)\n}\n"),
    ("java", "class A@ {\n  int go@(int a) {\n    return stop@(a);\n  }\n}\n"),
    ("rust", "struct S@ {\n}\nfn go@() {\n    stop@();\n}\n"),
    ("ruby", "class R@\n  def go@\n    stop@(1)\n  end\nend\n"),
    ("javascript", "const s@Slice = createSlice({\n  reducers: {\n    add@: (state) => {},\n  },\n});\nfunction go@() {\n  const send = useDispatch();\n  send(add@());\n  stop@(useSelector(pick@));\n}\n"),
]


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 6 AS l, 'f' || c_custkey AS f FROM customer),
e AS (SELECT f || ':' || ['Box', 'T', 'A', 'S', 'R'][l + 1] || k AS a, 'class' AS b FROM c WHERE l < 5 UNION ALL SELECT f || ':' || CASE WHEN l = 1 THEN 'Go' ELSE 'go' END || k, 'function' FROM c WHERE l IN (0, 1, 3, 5)
UNION ALL SELECT f || ':' || CASE WHEN l = 2 THEN 'A' ELSE 'R' END || k || '::go' || k, 'method' FROM c WHERE l IN (2, 4) UNION ALL SELECT f || ':s' || k || 'Slice', 'store' FROM c WHERE l = 5 UNION ALL SELECT f || ':s' || k || 'Slice::add' || k, 'function' FROM c WHERE l = 5),
d AS (SELECT f || ' ' || CASE l WHEN 1 THEN 'Go' WHEN 2 THEN 'A' || k || '.go' WHEN 4 THEN 'R' || k || '.go' ELSE 'go' END || k AS a, 'invokes' AS b, 'stop' || k AS c FROM c
UNION ALL SELECT f || ' go' || k, unnest(['invokes', 'invokes', 'invokes', 'invokes', 'reads_state', 'reads_state', 'dispatches']), unnest(['useDispatch', 'send', 'add' || k, 'useSelector', 'useSelector', 'pick' || k, 'add' || k]) FROM c WHERE l = 5)
SELECT a AS subject, b AS kind, NULL AS target FROM e UNION ALL SELECT * FROM d""", with_graph=False)  # fmt: skip
def lexical_extract(spark, sf):
    """Entities and references of sources in six languages, a file a customer."""
    k = F.col("c_custkey")
    pick = lambda j: F.replace(F.element_at(F.array(*(F.lit(s[j]) for s in SOURCES)), (k % 6).cast("int") + 1), F.lit("@"), k.cast("string"))
    found, raw = extract(read(spark, sf, "customer").select(text("f", k).alias("path"), pick(0).alias("language"), pick(1).alias("content")))
    own = found.select(F.col("id").alias("subject"), "kind", F.lit(None).cast("string").alias("target"))
    return own.unionByName(raw.select(F.concat_ws(" ", "file", "caller").alias("subject"), "kind", F.col("callee").alias("target")))


@query("SELECT id, CASE WHEN kind = 'class' THEN coalesce(best_path, hierarchy_path) ELSE hierarchy_path END AS hierarchy_path FROM entities LEFT JOIN (" + ORACLES["best_path_routing"] + ") b USING (id)")
def route_new(spark, sf):
    """Customers are new and go to the most similar place."""
    e = entities(spark, sf)
    return hierarchy.route_new(e, e.filter("kind = 'class'").select("id"), hierarchy.features(e)).select("id", "hierarchy_path")


@query(_TRANSITIONS + """ SELECT 0 AS part, unnest(range(4))::INT AS place, unnest(['cycles: ' || (SELECT count(*) FROM cy), 'entities: ' || count(DISTINCT m), 'files: ' || count(DISTINCT length(m)), 'areas: ' || count(DISTINCT substr(m, 1, 1))]) AS line FROM (SELECT unnest(cycle) AS m FROM cy)
UNION ALL SELECT 1, length::INT, 'length ' || length || ': ' || count(*) FROM cy GROUP BY length
UNION ALL SELECT * FROM (SELECT 2, (row_number() OVER (ORDER BY length DESC, cycle) - 1)::INT AS place, array_to_string(cycle, ' -> ') || ' -> ' || cycle[1] FROM cy ORDER BY place LIMIT 20)""", with_graph=False)  # fmt: skip
def cycle_report(spark, sf):
    found, e = _cycles(spark, sf)
    return export.cycle_lines(found, e)


def _groups_sql(few: int) -> str:
    """The snapshot's groups with ``few`` features an entity."""
    return f"SELECT {few} AS few, hierarchy_path, count(*) AS entities, string_agg(CASE WHEN r <= 5 THEN name || ': ' || array_to_string(list_slice(semantic_features, 1, {few}), ', ') END, '; ' ORDER BY r) AS sample FROM ranked GROUP BY hierarchy_path"


@query("WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY hierarchy_path ORDER BY id) AS r FROM entities), g AS (" + " UNION ALL ".join(map(_groups_sql, (3, 2, 1, 0))) + "), size AS (SELECT few, sum(length(sample) + length(hierarchy_path)) / 4.0 + 500 AS tokens FROM g GROUP BY few), best AS (SELECT coalesce(max(few) FILTER (tokens <= 6000), 0) AS few FROM size) SELECT few, hierarchy_path, entities, sample FROM g WHERE few = (SELECT few FROM best)")
def trimmed_snapshot(spark, sf):
    """The fullest groups within 6,000 tokens, or those without features."""
    groups, few = analytics.trimmed_snapshot(cut(entities(spark, sf)), 6000)
    return groups.select(F.lit(few).alias("few"), "hierarchy_path", "entities", "sample")


@query("SELECT 'functions' AS asked, id, hops FROM (SELECT 'order:1' AS id, 0 AS hops) UNION ALL SELECT 'functions', target, 1 FROM edges WHERE source = 'order:1' AND kind = 'imports' UNION ALL SELECT 'depends', id, hops FROM (SELECT 'supplier:1' AS id, 0 AS hops UNION ALL SELECT source, 1 FROM edges WHERE target = 'supplier:1' AND kind = 'composes')")
def explore_filtered(spark, sf):
    """One way with an edge filter and a kind filter: only parts below an order, and what is above a supplier."""
    g = stored_graph(spark, sf)
    down = traverse.explore(g.edges, g.entities, "order:1", "downstream", 2, ["imports", "composes"], ["function", "model"])
    up = traverse.explore(g.edges, g.entities, "supplier:1", "upstream", 2, ["composes"])
    return down.select(F.lit("functions").alias("asked"), "id", F.col("depth").alias("hops")).unionByName(up.select(F.lit("depends").alias("asked"), "id", F.col("depth").alias("hops")))


@query(_bfs("order:7", "source", "target", 2) + ", pa AS (SELECT mn.id, mn.depth, (SELECT min(source) FROM edges JOIN mn p ON p.id = source AND p.depth = mn.depth - 1 WHERE target = mn.id) AS parent FROM mn) SELECT string_agg(repeat('  ', depth) || id, chr(10) ORDER BY CASE depth WHEN 0 THEN ['order:7'] WHEN 1 THEN ['order:7', id] ELSE ['order:7', parent, id] END) AS tree FROM pa")
def explored_tree(spark, sf):
    g = stored_graph(spark, sf)
    tree = export.tree_text(traverse.explore(g.edges, g.entities, "order:7", "downstream", 2))
    return spark.createDataFrame([(tree,)], "tree string")
