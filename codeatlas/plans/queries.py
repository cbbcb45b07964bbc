"""A query for each operator over the driver's tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions.text import structural_signals
from ..operators import analytics, evolve, lifting, planning, search, traverse
from ..operators import graph as build
from ..operators import hierarchy as tree
from ..operators.order import numbered
from ..schema import CodeGraph
from ..session import cut, shared_dir
from ..sources.extract import enclosing_scopes, extract_entities
from ..sources.files import load, save
from ..streaming.sync import apply_stream, event_counts
from . import export
from .build import build as build_graph
from .build import parsed
from .registry import ORACLES, QUERIES, query  # noqa: F401
from .tables import entities, graph, read

DEPS = "('imports', 'invokes', 'inherits', 'composes', 'renders', 'reads_state', 'writes_state', 'dispatches', 'data_flow')"
QUERY = "red widget economy"


def stored_graph(spark, sf):
    """The graph with its edges written once, for operators that read them hop by hop."""
    g = graph(spark, sf)
    return CodeGraph(g.entities, cut(g.edges))


_HEALTH = f"""WITH ends AS (SELECT source AS id, 1 AS o, 0 AS i FROM edges WHERE kind IN {DEPS} UNION ALL SELECT target, 0, 1 FROM edges WHERE kind IN {DEPS}),
deg AS (SELECT id, CAST(sum(i) AS BIGINT) AS ca, CAST(sum(o) AS BIGINT) AS ce FROM ends GROUP BY id),
h0 AS (SELECT e.id, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce FROM entities e LEFT JOIN deg USING (id) WHERE kind <> 'module'),
h1 AS (SELECT *, CASE WHEN ca + ce = 0 THEN 0.0 ELSE CAST(ce AS DOUBLE) / (ca + ce) END AS instability, CAST(ca + ce AS DOUBLE) / ((SELECT count(*) FROM entities) - 1) AS centrality FROM h0),
health AS (SELECT *, ca + ce >= 10 AND (instability > 0.7::DOUBLE OR instability < 1.0::DOUBLE - 0.7::DOUBLE) AS god, instability > 0.7::DOUBLE AND ce > 0 AS unstable, instability < 1.0::DOUBLE - 0.7::DOUBLE AND ca > 0 AS stable, ca + ce >= 8 AS hub FROM h1)
"""


@query(_HEALTH + "SELECT id, ca, ce, round(instability, 6) AS instability, round(centrality, 6) AS centrality FROM health ORDER BY ca + ce DESC, id LIMIT 20")
def health_top(spark, sf):
    g = graph(spark, sf)
    top = analytics.health(g.entities, g.edges).orderBy((F.col("ca") + F.col("ce")).desc(), "id").limit(20)
    return top.select("id", "ca", "ce", F.round("instability", 6).alias("instability"), F.round("centrality", 6).alias("centrality"))


@query(_HEALTH + "SELECT id, ca, ce FROM health")
def degree_in_out(spark, sf):
    g = graph(spark, sf)
    return analytics.health(g.entities, g.edges).select("id", "ca", "ce")


@query(_HEALTH + "SELECT id, round(instability, 6) AS instability, round(centrality, 9) AS centrality FROM health")
def instability_centrality(spark, sf):
    g = graph(spark, sf)
    return analytics.health(g.entities, g.edges).select("id", F.round("instability", 6).alias("instability"), F.round("centrality", 9).alias("centrality"))


@query(_HEALTH + "SELECT id, god, unstable, stable, hub FROM health")
def health_issues(spark, sf):
    g = graph(spark, sf)
    return analytics.health(g.entities, g.edges).select("id", "god", "unstable", "stable", "hub")


@query(_HEALTH + "SELECT count(*) AS entities, round(avg(instability), 6) AS avg_instability, round(avg(centrality), 6) AS avg_centrality, count_if(god)::BIGINT AS god_objects, count_if(unstable)::BIGINT AS highly_unstable, count_if(stable)::BIGINT AS highly_stable, count_if(hub)::BIGINT AS hubs FROM health")
def health_summary(spark, sf):
    g = graph(spark, sf)
    return analytics.health_summary(analytics.health(g.entities, g.edges))


@query(_HEALTH + "SELECT id, round(instability, 6) AS instability, ce FROM health WHERE unstable ORDER BY instability DESC, ce DESC, id LIMIT 10")
def top_unstable(spark, sf):
    g = graph(spark, sf)
    h = analytics.health(g.entities, g.edges).filter("unstable").orderBy(F.desc("instability"), F.desc("ce"), "id").limit(10)
    return h.select("id", F.round("instability", 6).alias("instability"), "ce")


@query(f"SELECT count(*) AS total_entities, count(DISTINCT file) AS total_files, count(DISTINCT split_part(hierarchy_path, '/', 1)) AS functional_areas, count_if(len(semantic_features) > 0 AND kind <> 'module')::BIGINT AS lifted_entities, (SELECT count(*) FROM edges) AS total_edges, (SELECT count(*) FROM edges WHERE kind IN {DEPS}) AS dependency_edges, (SELECT count_if(kind = 'contains')::BIGINT FROM edges) AS containment_edges, (SELECT count_if(kind = 'data_flow')::BIGINT FROM edges) AS data_flow_edges FROM entities")
def graph_metadata(spark, sf):
    g = graph(spark, sf)
    return build.metadata(g.entities, g.edges)


@query("SELECT DISTINCT 'dangling_edge' AS issue, source || '->' || target || ' ' || kind AS subject FROM edges WHERE source NOT IN (SELECT id FROM entities WHERE kind <> 'service') OR target NOT IN (SELECT id FROM entities WHERE kind <> 'service')")
def dangling_edges(spark, sf):
    """As if the suppliers had been lost."""
    g = graph(spark, sf)
    return build.issues(g.entities.filter("kind <> 'service'"), g.edges)


@query("WITH a AS (SELECT id, split_part(hierarchy_path, '/', 1) AS area, name FROM entities), x AS (SELECT s.area AS source_area, t.area AS target_area, t.name FROM edges JOIN a s ON s.id = source JOIN a t ON t.id = target WHERE edges.kind = 'invokes' AND s.area <> t.area) SELECT source_area, target_area, count(*) AS calls, array_to_string(list_slice(list_sort(list(DISTINCT name)), 1, 3), ',') AS samples FROM x GROUP BY ALL")
def area_invocations(spark, sf):
    g = graph(spark, sf)
    return build.area_invocations(g.entities, g.edges)


_REFS = """WITH refs AS (
  SELECT e.id AS source, e.file, c_name AS name, 'invokes' AS kind FROM orders JOIN entities e ON e.id = 'order:' || o_orderkey JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT e.id, e.file, p_name, 'imports' FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l JOIN entities e ON e.id = 'order:' || l_orderkey JOIN part ON p_partkey = l_partkey
  UNION ALL SELECT e.id, e.file, e.name, 'composes' FROM entities e WHERE kind = 'class'),
loc AS (SELECT file, name, max(id) AS local FROM entities GROUP BY ALL),
nm AS (SELECT name, file, id FROM entities),
uniq AS (SELECT r.source, r.file, r.name, r.kind, (SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM nm WHERE nm.name = r.name AND nm.file <> r.file) AS elsewhere FROM (SELECT DISTINCT * FROM refs) r)
"""


@query(_REFS + "SELECT DISTINCT u.source, coalesce(CASE WHEN local <> u.source THEN local END, elsewhere) AS target, u.kind FROM uniq u LEFT JOIN loc ON loc.file = u.file AND loc.name = u.name WHERE coalesce(CASE WHEN local <> u.source THEN local END, elsewhere) IS NOT NULL")
def resolve_unique_name(spark, sf):
    g = graph(spark, sf)
    at = g.entities.select(F.col("id").alias("source"), "file")
    name = lambda k, c: F.concat(F.lit(f"{k}:"), F.col(c).cast("string"))
    calls = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(name("order", "o_orderkey").alias("source"), F.col("c_name").alias("name"), F.lit("invokes").alias("kind"))
    uses = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct().join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(name("order", "l_orderkey").alias("source"), F.col("p_name").alias("name"), F.lit("imports").alias("kind"))
    own = g.entities.filter("kind = 'class'").select(F.col("id").alias("source"), "name", F.lit("composes").alias("kind"))
    return build.resolve(g.entities, calls.unionByName(uses).unionByName(own).join(at, "source"))


@query("WITH called AS (SELECT id, line_start % 3 > 0 AS takes, line_start % 2 = 0 AS gives FROM entities) SELECT DISTINCT * FROM (SELECT source, target, 'data_flow' AS kind FROM edges JOIN called ON id = target WHERE kind = 'invokes' AND takes UNION ALL SELECT target, source, 'data_flow' FROM edges JOIN called ON id = target WHERE kind = 'invokes' AND gives)")
def data_flow_edges(spark, sf):
    """Signatures are made up from line numbers: parameters where they aren't divisible by 3, a
    result where they are even."""
    g = graph(spark, sf)
    p = F.struct(F.lit("x").alias("name"), F.lit(None).cast("string").alias("type_annotation"))
    params = F.when(F.col("line_start") % 3 > 0, F.array(p)).otherwise(F.array().cast("array<struct<name:string,type_annotation:string>>"))
    e = g.entities.withColumn("signature", F.struct(params.alias("parameters"), F.when(F.col("line_start") % 2 == 0, F.lit("int")).alias("return_type")))
    return build.data_flow(e, g.edges)


@query("WITH p AS (SELECT DISTINCT hierarchy_path AS h FROM entities), n AS (SELECT DISTINCT array_to_string(list_slice(string_split(h, '/'), 1, i), '/') AS path FROM p, range(1, 4) t(i) WHERE i <= len(string_split(h, '/'))) SELECT 'h:' || regexp_replace(path, '/[^/]*$', '') AS source, 'h:' || path AS target, 'contains' AS kind FROM n WHERE contains(path, '/') UNION ALL SELECT 'h:' || hierarchy_path, id, 'contains' FROM entities")
def containment_edges(spark, sf):
    return build.containment(entities(spark, sf))


@query("WITH f AS (SELECT file, max(line_end) AS line_end FROM entities GROUP BY file) SELECT file || ':' || regexp_extract(file, '([^/]+?)(\\.[^./]*)?$', 1) AS id, 'module' AS kind, regexp_extract(file, '([^/]+?)(\\.[^./]*)?$', 1) AS name, file, 1 AS line_start, line_end FROM f")
def module_entities(spark, sf):
    return build.module_entities(entities(spark, sf))


@query("WITH f AS (SELECT DISTINCT file FROM entities UNION SELECT 'main.py' UNION SELECT 'a/b/c/d.tar.gz'), s AS (SELECT file, string_split(file, '/') AS p FROM f) SELECT file, CASE WHEN len(p) = 1 THEN regexp_replace(p[1], '\\.[^.]*$', '') WHEN len(p) = 2 THEN p[1] || '/' || regexp_replace(p[2], '\\.[^.]*$', '') ELSE p[1] || '/' || p[2] || '/' || regexp_replace(p[len(p)], '\\.[^.]*$', '') END AS path FROM s")
def hierarchy_paths(spark, sf):
    files = entities(spark, sf).select("file").union(spark.createDataFrame([("main.py",), ("a/b/c/d.tar.gz",)], "file string")).distinct()
    return files.select("file", tree.structural_path(F.col("file")).alias("path"))


_UP = "WITH up AS (SELECT id, semantic_features, array_to_string(list_slice(string_split(hierarchy_path, '/'), 1, i), '/') AS path FROM entities, range(1, 4) t(i)) "


@query(_UP + "SELECT path, count(*) AS entity_count FROM up GROUP BY path")
def hierarchy_rollup(spark, sf):
    return tree.entity_counts(entities(spark, sf))


@query(_UP + "SELECT path, array_to_string(list_sort(list(DISTINCT f)), ',') AS features FROM (SELECT path, unnest(semantic_features) AS f FROM up) GROUP BY path")
def hierarchy_features(spark, sf):
    return tree.features(entities(spark, sf)).select("path", F.array_join("features", ",").alias("features"))


@query("WITH up AS (SELECT array_to_string(list_slice(string_split(hierarchy_path, '/'), 1, i), '/') AS path, string_split(regexp_replace(file, '/[^/]*$', ''), '/') AS d FROM entities, range(1, 4) t(i)), e AS (SELECT path, min(d) AS lo, max(d) AS hi FROM up GROUP BY path) SELECT path, array_to_string(list_slice(lo, 1, len(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda i: list_slice(lo, 1, i) = list_slice(hi, 1, i)))), '/') AS grounded FROM e")
def lca_grounding(spark, sf):
    return tree.grounding(entities(spark, sf))


@query("SELECT split_part(hierarchy_path, '/', 1) AS area, count_if(len(semantic_features) > 0)::BIGINT AS lifted, count(*) AS total FROM entities GROUP BY 1")
def area_coverage(spark, sf):
    return tree.coverage(entities(spark, sf))


@query("SELECT id, hierarchy_path FROM entities WHERE hierarchy_path = 'PARTS/Brand#1' OR starts_with(hierarchy_path, 'PARTS/Brand#1/') OR hierarchy_path = 'ASIA' OR starts_with(hierarchy_path, 'ASIA/')")
def scope_filter(spark, sf):
    return search.filtered(entities(spark, sf), "PARTS/Brand#1, ASIA, nowhere").select("id", "hierarchy_path")


@query("WITH items AS (SELECT DISTINCT id, unnest(semantic_features) AS f FROM entities), nn AS (SELECT id, count(*) AS n FROM items GROUP BY id), " + _UP.removeprefix("WITH ").rstrip() + ", tr AS (SELECT DISTINCT path, unnest(semantic_features) AS f FROM up), tm AS (SELECT path, count(*) AS m FROM tr GROUP BY path), sims AS (SELECT id, path, len(string_split(path, '/')) AS level, count(*)::DOUBLE / (any_value(n) + any_value(m) - count(*)) AS sim FROM items JOIN tr USING (f) JOIN nn USING (id) JOIN tm USING (path) GROUP BY id, path), l1 AS (SELECT * FROM sims WHERE level = 1 AND sim >= 0.05 QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, path) = 1), l2 AS (SELECT s.* FROM sims s JOIN l1 ON l1.id = s.id AND regexp_replace(s.path, '/[^/]*$', '') = l1.path AND s.level = 2 AND s.sim > l1.sim QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY s.sim DESC, s.path) = 1), l3 AS (SELECT s.* FROM sims s JOIN l2 ON l2.id = s.id AND regexp_replace(s.path, '/[^/]*$', '') = l2.path AND s.level = 3 AND s.sim > l2.sim QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY s.sim DESC, s.path) = 1) SELECT l1.id, coalesce(l3.path, l2.path, l1.path) AS best_path FROM l1 LEFT JOIN l2 USING (id) LEFT JOIN l3 USING (id)")
def best_path_routing(spark, sf):
    e = entities(spark, sf)
    return tree.best_paths(e.select("id", F.col("semantic_features").alias("features")), tree.feature_rows(e))


@query("WITH f AS (SELECT DISTINCT file FROM entities), r AS (SELECT file, (row_number() OVER (ORDER BY file) - 1) // 20 AS cluster FROM f), l AS (SELECT cluster, list_sort(list(file)) AS f FROM r GROUP BY cluster) SELECT cluster, len(f)::INT AS files, array_to_string(CASE WHEN len(f) = 1 THEN [f[1]] WHEN len(f) = 2 THEN [f[1], f[2]] ELSE [f[1], f[len(f) // 2 + 1], f[len(f)]] END, ',') AS representatives FROM l")
def file_clusters(spark, sf):
    e = entities(spark, sf)
    return tree.file_clusters(build.module_entities(e), 20)


_TOKENS = "WITH tk AS (SELECT DISTINCT id, unnest(list_filter(regexp_split_to_array(lower(f), '\\s+'), lambda x: x <> '')) AS token FROM (SELECT id, unnest(semantic_features) AS f FROM entities)), idf AS (SELECT token, count(*) AS df, greatest(0.0, ln((SELECT count(*) FROM entities)::DOUBLE / (1 + count(*)))) AS idf FROM tk GROUP BY token)"


@query(_TOKENS + " SELECT token, df, round(idf, 9) AS idf FROM idf")
def idf_table(spark, sf):
    return search.idf(entities(spark, sf)).select("token", "df", F.round("idf", 9).alias("idf"))


def _score_sql(text: str, weighted: bool) -> str:
    """The lexical score of a text column in SQL."""
    terms = QUERY.split()
    w = lambda t: f"coalesce((SELECT idf FROM idf WHERE token = '{t}'), 1.0)" if weighted else "1.0"
    own = f"list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda x: x <> '')"
    total = "(" + " + ".join(w(t) for t in terms) + ")"
    overlap = " + ".join(f"CASE WHEN list_contains({own}, '{t}') THEN {w(t)} ELSE 0.0 END" for t in terms)
    sim = lambda t: f"coalesce(list_max(list_transform({own}, lambda x: 1 - levenshtein(x, '{t}')::DOUBLE / greatest(length(x), {len(t)}))), 0.0)"
    edit = " + ".join(f"CASE WHEN {sim(t)} > 0.6::DOUBLE THEN {sim(t)} ELSE 0.0 END" for t in terms)
    return f"(0.4::DOUBLE * ({overlap}) / {total} + 0.2::DOUBLE * CASE WHEN contains(lower({text}), '{QUERY}') THEN 0.5 ELSE 0.0 END + 0.4::DOUBLE * ({edit}) / {len(terms)})"


_FEATURES = _TOKENS + f", fe AS (SELECT id, unnest(semantic_features) AS f FROM entities), sc AS (SELECT f, {_score_sql('f', True)} AS s FROM (SELECT DISTINCT f FROM fe)), ft AS (SELECT id, sum(s) AS score, array_to_string(list_sort(list(f)), ',') AS matched FROM fe JOIN sc USING (f) WHERE s > 0.05::DOUBLE GROUP BY id)"
_SNIPPETS = f", sn AS (SELECT * FROM (SELECT id, 2 * {_score_sql('name', False)} + {_score_sql('file', False)} + 0.5 * {_score_sql('hierarchy_path', False)} AS score FROM entities) WHERE score > 0.05::DOUBLE)"


@query(_FEATURES + " SELECT id, round(score, 6) AS score, matched FROM ft ORDER BY round(score, 9) DESC, id LIMIT 15")
def search_features(spark, sf):
    out = search.search_features(entities(spark, sf), QUERY, 15)
    return out.select("id", F.round("score", 6).alias("score"), "matched")


@query(_TOKENS + _SNIPPETS + " SELECT id, round(score, 6) AS score FROM sn ORDER BY round(score, 9) DESC, id LIMIT 15")
def search_snippets(spark, sf):
    return search.search_snippets(entities(spark, sf), QUERY, 15).select("id", F.round("score", 6).alias("score"))


_AUTO = _FEATURES + _SNIPPETS + ", f30 AS (SELECT id, score AS f FROM ft ORDER BY round(score, 9) DESC, id LIMIT 30), s30 AS (SELECT id, score AS s FROM sn ORDER BY round(score, 9) DESC, id LIMIT 30), au AS (SELECT id, coalesce(f, 0) + 0.5 * coalesce(s, 0) AS score FROM f30 FULL JOIN s30 USING (id) ORDER BY round(coalesce(f, 0) + 0.5 * coalesce(s, 0), 9) DESC, id LIMIT 15)"


@query(_AUTO + " SELECT id, round(score, 6) AS score FROM au")
def search_auto(spark, sf):
    return search.search_auto(entities(spark, sf), QUERY, 15).select("id", F.round("score", 6).alias("score"))


_COS = "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), vs AS (SELECT 'part:' || vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q)"


def _vectors(spark, sf):
    return read(spark, sf, "embeddings").select(F.concat(F.lit("part:"), F.col("vec_id").cast("string")).alias("id"), F.col("embedding").alias("vector"))


def _first_vector(spark, sf):
    return read(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


@query(_COS + " SELECT id, round(score, 6) AS score FROM vs WHERE score > 0 ORDER BY score DESC, id LIMIT 20")
def vector_topk(spark, sf):
    return search.vector_scores(_vectors(spark, sf), _first_vector(spark, sf), 20).select("id", F.round("score", 6).alias("score"))


@query(_AUTO + "," + _COS.removeprefix("WITH ") + ", v20 AS (SELECT id, score FROM vs WHERE score > 0 ORDER BY score DESC, id LIMIT 20), a AS (SELECT id, 1 - (row_number() OVER (ORDER BY score DESC, id) - 1)::DOUBLE / count(*) OVER () AS a FROM v20), b AS (SELECT id, 1 - (row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1)::DOUBLE / count(*) OVER () AS b FROM au) SELECT id, round(0.6 * coalesce(a, 0) + 0.4 * coalesce(b, 0), 6) AS score FROM a FULL JOIN b USING (id) ORDER BY round(0.6 * coalesce(a, 0) + 0.4 * coalesce(b, 0), 9) DESC, id LIMIT 12")
def hybrid_rerank(spark, sf):
    e = entities(spark, sf)
    out = search.hybrid(search.search_auto(e, QUERY, 15), search.vector_scores(_vectors(spark, sf), _first_vector(spark, sf), 20), 12)
    return out.select("id", F.round("score", 6).alias("score"))


@query("WITH o AS (SELECT id, md5(array_to_string(list_transform(semantic_features, lambda f: lower(trim(f))), chr(10))) AS h FROM entities WHERE line_start % 7 <> 0), n AS (SELECT id, md5(array_to_string(list_transform(CASE WHEN line_start % 5 = 0 THEN list_append(semantic_features, 'new') ELSE semantic_features END, lambda f: lower(trim(f))), chr(10))) AS h FROM entities WHERE line_start % 11 <> 0) SELECT id, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'pruned' WHEN o.h = n.h THEN 'kept' ELSE 'changed' END AS status FROM o FULL JOIN n USING (id)")
def embed_sync_status(spark, sf):
    e = entities(spark, sf).select("id", "line_start", F.col("semantic_features").alias("features"))
    new = e.filter("line_start % 11 <> 0").withColumn("features", F.when(F.col("line_start") % 5 == 0, F.concat("features", F.array(F.lit("new")))).otherwise(F.transform("features", F.upper)))
    return search.embedding_status(e.filter("line_start % 7 <> 0"), new)


_NEAR = "WITH ch AS (SELECT id FROM entities WHERE id IN ('order:1', 'order:2', 'customer:5')), wy AS (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges), n1 AS (SELECT DISTINCT b AS id FROM wy WHERE a IN (SELECT id FROM ch)), n2 AS (SELECT DISTINCT b AS id FROM wy WHERE a IN (SELECT id FROM n1)), nr AS (SELECT id, min(h)::INT AS hops FROM (SELECT id, 0 AS h FROM ch UNION ALL SELECT id, 1 FROM n1 UNION ALL SELECT id, 2 FROM n2) GROUP BY id)"


def _changed(g):
    return g.entities.filter(F.col("id").isin("order:1", "order:2", "customer:5")).select("id")


@query(_NEAR + " SELECT id, hops FROM nr")
def change_proximity(spark, sf):
    g = stored_graph(spark, sf)
    return search.change_nearness(g.edges, _changed(g))


@query(_FEATURES + "," + _NEAR.removeprefix("WITH ") + ", big AS (SELECT id, score FROM ft ORDER BY round(score, 9) DESC, id LIMIT 100) SELECT id, round(score * CASE hops WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 WHEN 2 THEN 1.5 ELSE 1.0 END, 6) AS score FROM big LEFT JOIN nr USING (id) ORDER BY round(score * CASE hops WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 WHEN 2 THEN 1.5 ELSE 1.0 END, 9) DESC, id LIMIT 10")
def proximity_boost(spark, sf):
    g = stored_graph(spark, sf)
    hits = search.search_features(g.entities, QUERY, 100).select("id", "score")
    return search.boosted(hits, search.change_nearness(g.edges, _changed(g)), 10).select("id", F.round("score", 6).alias("score"))


@query("WITH o AS (SELECT id, semantic_features AS o, list_concat(list_slice(semantic_features, 1, line_start % 3), ['x' || line_start % 4]) AS n FROM entities), d AS (SELECT id, 1 - len(list_intersect(o, n))::DOUBLE / len(list_distinct(list_concat(o, n))) AS d FROM o) SELECT id, round(d, 6) AS drift, CASE WHEN d < 0.3::DOUBLE THEN 'minor' WHEN d <= 0.7::DOUBLE THEN 'borderline' ELSE 'route' END AS zone FROM d")
def drift_zones(spark, sf):
    e = entities(spark, sf)
    new = e.select("id", F.concat(F.slice("semantic_features", 1, F.col("line_start") % 3), F.array(F.concat(F.lit("x"), (F.col("line_start") % 4).cast("string")))).alias("features"))
    return lifting.drift_zones(e.select("id", F.col("semantic_features").alias("features")), new)


@query("SELECT avg(CASE WHEN r BETWEEN 1 AND 1 THEN 1.0 ELSE 0.0 END) AS acc_1, avg(CASE WHEN r BETWEEN 1 AND 3 THEN 1.0 ELSE 0.0 END) AS acc_3, avg(CASE WHEN r BETWEEN 1 AND 5 THEN 1.0 ELSE 0.0 END) AS acc_5, avg(CASE WHEN r BETWEEN 1 AND 10 THEN 1.0 ELSE 0.0 END) AS acc_10, round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE / r ELSE 0.0 END), 9) AS mrr FROM (SELECT event_id % 13 AS r FROM events)", with_graph=False)
def acc_at_k_mrr(spark, sf):
    out = search.retrieval_metrics(read(spark, sf, "events").select((F.col("event_id") % 13).alias("rank")))
    return out.withColumn("mrr", F.round("mrr", 9))


@query("SELECT target AS id, kind, 'downstream' AS direction FROM edges WHERE source = 'part:7' UNION ALL SELECT source, kind, 'upstream' FROM edges WHERE target = 'part:7'")
def neighbors(spark, sf):
    return traverse.neighbours(graph(spark, sf).edges, "part:7")


def _bfs(start: str, at: str, nxt: str, depth: int) -> str:
    return f"WITH bf(id, depth) AS (SELECT '{start}', 0 UNION SELECT {nxt}, depth + 1 FROM bf JOIN edges ON {at} = bf.id WHERE depth < {depth}), mn AS (SELECT id, min(depth)::INT AS depth FROM bf GROUP BY id)"


@query(_bfs("order:7", "source", "target", 3) + " SELECT mn.id, mn.depth, (SELECT min(source) FROM edges JOIN mn p ON p.id = source AND p.depth = mn.depth - 1 WHERE target = mn.id) AS parent FROM mn")
def explore_bfs(spark, sf):
    g = stored_graph(spark, sf)
    return traverse.explore(g.edges, g.entities, "order:7", "downstream", 3).select("id", "depth", "parent")


@query(_bfs("supplier:3", "target", "source", 2) + " SELECT id, depth FROM mn WHERE depth > 0 ORDER BY depth, id LIMIT 100")
def impact_radius(spark, sf):
    return traverse.impact_radius(stored_graph(spark, sf).edges, "supplier:3", "upstream", 2).select("id", "depth")


@query("WITH target AS (SELECT min(e2.target) AS t FROM edges e1 JOIN edges e2 ON e2.source = e1.target WHERE e1.source = 'order:7'), pt(path, last, n) AS (SELECT ['order:7'], 'order:7', 0 UNION ALL SELECT list_append(path, e.target), e.target, n + 1 FROM pt JOIN (SELECT DISTINCT source, target FROM edges) e ON e.source = last WHERE n < 3 AND NOT list_contains(path, e.target)) SELECT array_to_string(path, ' ') AS path, n::INT AS length FROM pt WHERE last = (SELECT t FROM target) ORDER BY n, path LIMIT 3")
def shortest_paths_k(spark, sf):
    e = stored_graph(spark, sf).edges
    first = e.filter("source = 'order:7'").select(F.col("target").alias("source"))
    target = e.join(first, "source", "left_semi").agg(F.min("target")).first()[0]
    return traverse.find_paths(e, "order:7", target, 3, 3).select(F.array_join("path", " ").alias("path"), "length")


@query("WITH wy AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), s0 AS (SELECT unnest(['order:1', 'order:2', 'supplier:5']) AS root, unnest(['order:1', 'order:2', 'supplier:5']) AS id, NULL::VARCHAR AS parent), s1 AS (SELECT root, b AS id, min(a) AS parent FROM s0 JOIN wy ON a = s0.id WHERE NOT EXISTS (SELECT 1 FROM s0 x WHERE x.root = s0.root AND x.id = b) GROUP BY ALL), s2 AS (SELECT root, b AS id, min(a) AS parent FROM s1 JOIN wy ON a = s1.id WHERE NOT EXISTS (SELECT 1 FROM s0 x WHERE x.root = s1.root AND x.id = b) AND NOT EXISTS (SELECT 1 FROM s1 x WHERE x.root = s1.root AND x.id = b) GROUP BY ALL), s3 AS (SELECT root, b AS id, min(a) AS parent FROM s2 JOIN wy ON a = s2.id WHERE NOT EXISTS (SELECT 1 FROM s0 x WHERE x.root = s2.root AND x.id = b) AND NOT EXISTS (SELECT 1 FROM s1 x WHERE x.root = s2.root AND x.id = b) AND NOT EXISTS (SELECT 1 FROM s2 x WHERE x.root = s2.root AND x.id = b) GROUP BY ALL), se AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3), p0 AS (SELECT root, id, parent FROM se WHERE id IN ('order:1', 'order:2', 'supplier:5') AND root < id), p1 AS (SELECT se.* FROM p0 JOIN se ON se.root = p0.root AND se.id = p0.parent), p2 AS (SELECT se.* FROM p1 JOIN se ON se.root = p1.root AND se.id = p1.parent), p3 AS (SELECT se.* FROM p2 JOIN se ON se.root = p2.root AND se.id = p2.parent) SELECT id FROM p0 UNION SELECT id FROM p1 UNION SELECT id FROM p2 UNION SELECT id FROM p3")
def slice_between(spark, sf):
    g = stored_graph(spark, sf)
    return traverse.slice_between(g.edges, ["order:1", "order:2", "supplier:5"], 3)[0]


@query(_AUTO + ", sz AS (SELECT au.id, au.score, CAST(ceil((length(au.id) + length(name) + length(array_to_string(semantic_features, ', '))) / 4.0) + 1 AS BIGINT) AS tokens FROM au JOIN entities e ON e.id = au.id), rn AS (SELECT *, sum(tokens) OVER (ORDER BY round(score, 9) DESC, id ROWS UNBOUNDED PRECEDING) AS running FROM sz) SELECT id, tokens, CAST(running AS BIGINT) AS running FROM rn WHERE running <= 100")
def context_pack_budget(spark, sf):
    e = entities(spark, sf)
    size = F.ceil((F.length("id") + F.length("name") + F.length(F.array_join("semantic_features", ", "))) / 4) + 1
    rows = search.search_auto(e, QUERY, 15).join(e, "id").select("id", "score", size.cast("long").alias("tokens"))
    return traverse.within_budget(rows, 100).select("id", "tokens", "running")


@query("WITH w AS (SELECT id, name, kind, hierarchy_path FROM entities WHERE id IN ('part:7', 'order:9', 'customer:3')) SELECT w.*, (SELECT count(*) - 1 FROM entities e WHERE e.hierarchy_path = w.hierarchy_path) AS siblings FROM w")
def fetch_siblings(spark, sf):
    return traverse.fetch(entities(spark, sf), ["part:7", "order:9", "customer:3"])


_TRANSITIONS = "WITH RECURSIVE tr AS (SELECT DISTINCT event_type AS source, nxt AS target FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL), pt(start, path, last) AS (SELECT source, [source, target], target FROM tr WHERE source < target UNION ALL SELECT start, list_append(path, t.target), t.target FROM pt JOIN tr t ON t.source = last WHERE t.target > start AND NOT list_contains(path, t.target)), cy AS (SELECT path AS cycle, len(path) AS length FROM pt JOIN tr ON tr.source = last AND tr.target = start WHERE len(path) <= 4)"


def _transitions(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf, "events").select(F.col("event_type").alias("source"), F.lead("event_type").over(w).alias("target")).filter("target IS NOT NULL").distinct()


@query(_TRANSITIONS + " SELECT array_to_string(cycle, '>') AS cycle, length::INT AS length FROM cy", with_graph=False)
def cycles_bounded(spark, sf):
    return analytics.cycles(_transitions(spark, sf), 4).select(F.array_join("cycle", ">").alias("cycle"), "length")


def _cycles(spark, sf):
    """Cycles of event types, a type's file being its length and its area its first letter."""
    from ..session import cut

    t = _transitions(spark, sf)
    e = t.select(F.col("source").alias("id")).unionByName(t.select(F.col("target").alias("id"))).distinct()
    e = e.select("id", F.length("id").cast("string").alias("file"), F.concat(F.substring("id", 1, 1), F.lit("/x")).alias("hierarchy_path"))
    return cut(analytics.cycles(t, 4)), e


@query(_TRANSITIONS + " SELECT substr(m, 1, 1) AS area, count(DISTINCT cycle) AS cycles, count(DISTINCT m) AS entities FROM (SELECT cycle, unnest(cycle) AS m FROM cy) GROUP BY 1", with_graph=False)
def cycle_area_stats(spark, sf):
    return analytics.cycle_areas(*_cycles(spark, sf))


@query(_TRANSITIONS + " SELECT (SELECT count(*) FROM cy) AS cycles, count(DISTINCT m) AS entities, count(DISTINCT length(m)) AS files, count(DISTINCT substr(m, 1, 1)) AS areas FROM (SELECT unnest(cycle) AS m FROM cy)", with_graph=False)
def cycle_summary(spark, sf):
    return analytics.cycle_summary(*_cycles(spark, sf))


@query(_TRANSITIONS + " SELECT length::INT AS length, count(*) AS cycles FROM cy GROUP BY 1", with_graph=False)
def cycle_lengths(spark, sf):
    return analytics.cycle_lengths(_cycles(spark, sf)[0])


@query(_TRANSITIONS + " SELECT array_to_string(cycle, '>') AS cycle FROM cy WHERE len(list_filter(cycle, lambda m: substr(m, 1, 1) IN ('p', 's'))) > 0 AND len(list_distinct(list_transform(cycle, lambda m: length(m)))) > 1 AND len(list_distinct(list_transform(cycle, lambda m: substr(m, 1, 1)))) > 1", with_graph=False)
def cycle_filters(spark, sf):
    return analytics.filter_cycles(*_cycles(spark, sf), "p, s", True, True).select(F.array_join("cycle", ">").alias("cycle"))


_WORDS = "WITH d AS (SELECT doc_id::VARCHAR AS id, source AS file, list_distinct(list_transform(range(0, (len(ws) // 8)), lambda i: array_to_string(ws[i * 8 + 1:i * 8 + 8], ' '))) AS fs FROM (SELECT doc_id, source, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM documents)), r AS (SELECT id, unnest(fs) AS f FROM d), rare AS (SELECT f FROM r GROUP BY f HAVING count(*) BETWEEN 2 AND 20), pr AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM r a JOIN r b ON a.f = b.f AND a.id < b.id JOIN rare ON rare.f = a.f GROUP BY ALL)"


@query(_WORDS + " SELECT a, b, round(s, 3) AS similarity FROM (SELECT a, b, len(list_intersect(x.fs, y.fs))::DOUBLE / len(list_distinct(list_concat(x.fs, y.fs))) AS s FROM pr JOIN d x ON x.id = a JOIN d y ON y.id = b WHERE x.file <> y.file AND shared::DOUBLE / greatest(len(x.fs), len(y.fs)) >= 0.6::DOUBLE) WHERE s >= 0.6::DOUBLE ORDER BY similarity DESC, a, b LIMIT 50", with_graph=False)
def semantic_clones(spark, sf):
    """Documents as entities of their source, runs of eight words as features."""
    runs = F.transform(F.regexp_extract_all("text", F.lit(r"[^ ]+(?: +[^ ]+){7}"), F.lit(0)), lambda x: F.regexp_replace(x, " +", " "))
    docs = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("file"), runs.alias("semantic_features"))
    return analytics.semantic_clones(docs)


@query("WITH d AS (SELECT doc_id::VARCHAR AS g, list_transform(list_filter(string_split(text, ' '), lambda x: x <> ''), lambda x: length(x)::BIGINT) AS t FROM documents), h AS (SELECT g, unnest(list_distinct(list_transform(range(1, len(t) - 18), lambda i: list_reduce(t[i:i + 19], lambda a, v: (a * 256 + v) % 1000000007)))) AS h FROM d WHERE len(t) >= 20), n AS (SELECT g, len(t) - 19 AS w FROM d WHERE len(t) >= 20), p AS (SELECT a.g AS a, b.g AS b, count(*) AS shared FROM h a JOIN h b ON a.h = b.h AND a.g < b.g GROUP BY ALL) SELECT a, b, shared, round(least(1.0, shared::DOUBLE / least(x.w, y.w)), 3) AS similarity FROM p JOIN n x ON x.g = a JOIN n y ON y.g = b WHERE shared::DOUBLE / least(x.w, y.w) >= 0.7::DOUBLE ORDER BY similarity DESC, a, b LIMIT 50", with_graph=False)
def token_clones(spark, sf):
    """Documents as sources, the lengths of their words as tokens."""
    words = F.filter(F.split("text", " "), lambda x: x != "")
    tokens = F.transform(words, F.length)
    return analytics.token_clones(read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), tokens.alias("tokens")))


@query("SELECT id, count(*) AS links FROM (SELECT source AS id FROM edges WHERE kind IN ('invokes', 'imports', 'inherits') UNION ALL SELECT target FROM edges WHERE kind IN ('invokes', 'imports', 'inherits')) GROUP BY id ORDER BY links DESC, id LIMIT 10")
def hot_spots(spark, sf):
    return analytics.hot_spots(graph(spark, sf).edges)


@query("SELECT file, array_to_string(list_sort(list(DISTINCT f)), ',') AS features FROM (SELECT file, unnest(semantic_features) AS f FROM entities) GROUP BY file")
def module_features(spark, sf):
    return analytics.module_features(entities(spark, sf)).select("file", F.array_join("features", ",").alias("features"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY hierarchy_path ORDER BY id) AS r FROM entities) SELECT hierarchy_path, count(*) AS entities, string_agg(CASE WHEN r <= 5 THEN name || ': ' || array_to_string(list_slice(semantic_features, 1, 3), ', ') END, '; ' ORDER BY r) AS sample FROM r GROUP BY hierarchy_path")
def snapshot_groups(spark, sf):
    return analytics.snapshot_groups(entities(spark, sf))


@query("SELECT id, CASE kind WHEN 'function' THEN CASE WHEN EXISTS (SELECT 1 FROM edges x WHERE x.source = entities.id AND x.kind = 'imports') THEN 2 ELSE 1 END WHEN 'model' THEN CASE WHEN EXISTS (SELECT 1 FROM edges x WHERE x.source = entities.id) THEN 1 ELSE 0 END ELSE 0 END AS level FROM entities")
def topo_levels(spark, sf):
    g = graph(spark, sf)
    return planning.topological_levels(g.entities, g.edges)


@query("WITH o AS (SELECT id, split_part(hierarchy_path, '/', 1) || line_start % 3 AS area, row_number() OVER (ORDER BY file, id) AS pos FROM entities WHERE kind <> 'function'), f AS (SELECT *, CASE WHEN area = lag(area) OVER (ORDER BY pos) THEN 0 ELSE 1 END AS new FROM o), i AS (SELECT *, sum(new) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM f), b AS (SELECT *, (row_number() OVER (PARTITION BY island ORDER BY pos) - 1) // 8 AS batch FROM i) SELECT area, CAST(island AS BIGINT) AS island, batch, count(*) AS n FROM b GROUP BY ALL")
def reconstruct_batches(spark, sf):
    e = numbered(entities(spark, sf).filter("kind <> 'function'"), ["file", "id"])
    area = F.concat(F.substring_index("hierarchy_path", "/", 1), (F.col("line_start") % 3).cast("string"))
    return planning.reconstruction_batches(e.select("id", area.alias("area"), "pos"))


@query("SELECT DISTINCT e.id FROM entities e JOIN edges ON source = e.id WHERE target IN ('part:7', 'part:8') AND (e.kind = 'test' OR starts_with(name, 'test_') OR starts_with(name, 'Test') OR contains(file, 'test') OR line_start % 2 = 0)")
def test_coverage(spark, sf):
    """Orders of even lines count as tests."""
    g = graph(spark, sf)
    e = g.entities.withColumn("kind", F.when((F.col("line_start") % 2 == 0) & (F.col("kind") == "function"), "test").otherwise(F.col("kind")))
    return planning.test_coverage(e, g.edges, spark.createDataFrame([("part:7",), ("part:8",)], "id string"))


@query("""WITH it AS (SELECT hierarchy_path AS area, row_number() OVER (PARTITION BY hierarchy_path ORDER BY id) AS rn, length(name) AS t FROM entities),
fd(area, rn, batch, n, tokens) AS (SELECT area, 1::BIGINT, 0, 1, t::BIGINT FROM it WHERE rn = 1 UNION ALL SELECT it.area, it.rn, CASE WHEN fd.tokens + it.t > 60 OR fd.n >= 5 THEN fd.batch + 1 ELSE fd.batch END, CASE WHEN fd.tokens + it.t > 60 OR fd.n >= 5 THEN 1 ELSE fd.n + 1 END, CASE WHEN fd.tokens + it.t > 60 OR fd.n >= 5 THEN it.t ELSE fd.tokens + it.t END FROM fd JOIN it ON it.area = fd.area AND it.rn = fd.rn + 1)
SELECT area, batch::INT AS batch, max(n)::INT AS n, max(tokens)::BIGINT AS tokens FROM fd GROUP BY area, batch""")
def token_batches(spark, sf):
    e = entities(spark, sf).select(F.col("hierarchy_path").alias("area"), "id", F.length("name").alias("tokens"))
    return planning.token_batches_by_area(e, 60, 5)


_CHANGE = "WITH ch AS (SELECT event_id, 'f' || user_id AS path, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS op, event_id AS size, user_id AS mtime FROM events)"


def _changes(spark, sf):
    op = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return read(spark, sf, "events").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), op.alias("op"), F.col("event_id").alias("size"), F.col("user_id").alias("mtime"))


@query(_CHANGE + ", g AS (SELECT sha256(op || '|' || path || '|' || size || '|' || mtime) AS h FROM ch), s AS (SELECT sha256(string_agg(h, '' ORDER BY h)) AS h FROM g GROUP BY substr(h, 1, 2)) SELECT sha256(string_agg(h, '' ORDER BY h)) AS changeset FROM s", with_graph=False)
def changeset_hash(spark, sf):
    return evolve.changeset_hash(_changes(spark, sf))


@query(_CHANGE + " SELECT op, count(*) AS files FROM ch GROUP BY op", with_graph=False)
def diff_report(spark, sf):
    return evolve.diff_report(_changes(spark, sf))


@query("WITH o AS (SELECT id FROM entities WHERE kind <> 'function' AND file IN (SELECT DISTINCT file FROM entities WHERE kind = 'class')), n AS (SELECT CASE WHEN line_start % 4 = 0 THEN id || 'b' ELSE id END AS id FROM entities WHERE kind = 'class') SELECT id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'kept' END AS status FROM (SELECT id FROM o UNION SELECT id FROM n) LEFT JOIN o USING (id) LEFT JOIN n USING (id)")
def merge_versions(spark, sf):
    e = entities(spark, sf)
    new = e.filter("kind = 'class'").withColumn("id", F.when(F.col("line_start") % 4 == 0, F.concat("id", F.lit("b"))).otherwise(F.col("id")))
    return evolve.merge_versions(e, new, e.filter("kind = 'class'").select("file").distinct())


_TREE = """WITH k AS (SELECT c_custkey AS k, c_custkey % 7 = 0 AS gone, c_custkey % 5 = 1 AS changed, c_custkey % 11 = 3 AS moved FROM customer),
f AS (SELECT k, changed, CASE WHEN moved AND NOT changed THEN 'g' ELSE 'f' END || k || '.py' AS file FROM k WHERE NOT gone),
d AS (SELECT file || ':run_' || k AS id, file, k FROM f UNION ALL SELECT file || ':extra_' || k, file, NULL FROM f WHERE changed),
c AS (SELECT s.file || ':run_' || s.k AS source, t.file || ':run_' || t.k AS target FROM f s JOIN f t ON t.k = s.k + CASE WHEN s.changed THEN 3 ELSE 1 END)"""


def _changed_tree(spark, sf):
    """A file a customer, whose function calls the next customer's; every seventh is deleted, of the others
    every fifth is changed, and of the rest every eleventh renamed: (before, changes, parse)."""
    k = F.col("c_custkey")
    at = lambda letter: F.concat(F.lit(letter), k.cast("string"), F.lit(".py"))
    body = lambda ahead: F.concat(F.lit("def run_"), k.cast("string"), F.lit("():\n    return run_"), (k + ahead).cast("string"), F.lit("()\n"))
    customers = read(spark, sf, "customer").select("c_custkey")
    files = lambda rows, text: rows.select(at("f").alias("path"), F.lit("python").alias("language"), text.alias("content"))
    op = F.when(k % 7 == 0, "deleted").when(k % 5 == 1, "modified").when(k % 11 == 3, "renamed")
    changes = customers.select(op.alias("op"), F.when(op == "renamed", at("g")).otherwise(at("f")).alias("path"), F.when(op == "renamed", at("f")).alias("from_path")).filter("op IS NOT NULL")
    new = files(customers.filter(op == "modified"), F.concat(body(3), F.lit("\ndef extra_"), k.cast("string"), F.lit("():\n    pass\n")))
    return build_graph(files(customers, body(1))), changes, lambda rows: parsed(new.join(rows.select("path"), "path", "left_semi"))


@query(_TREE + " SELECT id, 'function' AS kind, '' AS target FROM d UNION ALL SELECT source, 'invokes', target FROM c", with_graph=False)
def apply_changes(spark, sf):
    """Functions and calls of a tree after deletions, changes and renames."""
    before, changes, parse = _changed_tree(spark, sf)
    return _functions_and_calls(evolve.apply_changes(before, changes, *parse(changes.filter("op = 'modified'"))))


def _functions_and_calls(g):
    functions = g.entities.filter("kind = 'function'").select("id", "kind", F.lit("").alias("target"))
    return functions.unionByName(g.edges.filter("kind = 'invokes'").select(F.col("source").alias("id"), "kind", "target"))


@query(_TREE + " SELECT id, 'function' AS kind, '' AS target FROM d UNION ALL SELECT source, 'invokes', target FROM c", with_graph=False)
def stream_apply(spark, sf):
    """The same through a stream of changes over saved versions; the last version's rows."""
    before, changes, parse = _changed_tree(spark, sf)
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    save(before, f"{folder}/graph", "v0")
    changes.coalesce(1).write.json(f"{folder}/feed")
    feed = spark.readStream.schema("op string, path string, from_path string").json(f"{folder}/feed")
    apply_stream(feed, f"{folder}/graph", lambda rows: parse(rows.filter("op = 'modified'")), f"{folder}/progress").awaitTermination()
    return _functions_and_calls(load(spark, f"{folder}/graph/v1"))


@query("SELECT count_if(line_start % 3 <> 0 AND line_start % 2 = 0)::BIGINT AS restored, count_if(line_start % 3 <> 0 AND line_start % 2 <> 0)::BIGINT AS orphaned, count_if(line_start % 3 = 0 AND line_start % 2 = 0)::BIGINT AS new FROM entities")
def merge_features(spark, sf):
    e = entities(spark, sf)
    return evolve.merge_features(e.filter("line_start % 2 = 0"), e.filter("line_start % 3 <> 0"))[1]


@query("SELECT DISTINCT e.id FROM entities e WHERE e.line_start % 9 <> 0 EXCEPT SELECT id FROM entities WHERE kind = 'service'")
def remove_cascade(spark, sf):
    """What is left of the entities after suppliers and every ninth line are taken out."""
    g = graph(spark, sf)
    return build.remove(g.entities, g.edges, g.entities.filter("kind = 'service' OR line_start % 9 = 0").select("id"))[0].select("id")


_SIGNALS = "SELECT conv_id, turn, len(regexp_extract_all(text, '\\b(if|else|match|switch|case|when|elif|elsif)\\b'))::BIGINT AS branches, len(regexp_extract_all(text, '\\b(for|while|loop|each)\\b'))::BIGINT AS loops, 0::BIGINT AS early_returns, len(regexp_extract_all(text, '\\b[a-zA-Z_]\\w*\\s*\\('))::BIGINT AS calls, CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END::BIGINT AS lines FROM (SELECT conv_id, turn, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS text FROM conversations)"


@query(_SIGNALS, with_graph=False)
def structural_counts(spark, sf):
    c = read(spark, sf, "conversations").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "x"))
    s = structural_signals(F.col("text"))
    return c.select("conv_id", "turn", *(v.alias(k) for k, v in s.items()))


@query("WITH sc AS (SELECT 'u' || user_id AS file, 's' || event_id AS scope, event_id % 500 AS first, event_id % 500 + user_id % 40 AS last FROM events WHERE event_type = 'click'), ca AS (SELECT DISTINCT 'u' || user_id AS file, event_id % 500 AS row FROM events WHERE event_type = 'view') SELECT file, row, scope FROM (SELECT ca.file, ca.row, scope, row_number() OVER (PARTITION BY ca.file, ca.row ORDER BY last - first, scope) AS r FROM ca JOIN sc ON sc.file = ca.file AND ca.row BETWEEN first AND last) WHERE r = 1", with_graph=False)
def enclosing_scope(spark, sf):
    ev = read(spark, sf, "events").withColumn("file", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    scopes = ev.filter("event_type = 'click'").select("file", F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("scope"), (F.col("event_id") % 500).alias("first"), (F.col("event_id") % 500 + F.col("user_id") % 40).alias("last"))
    calls = ev.filter("event_type = 'view'").select("file", (F.col("event_id") % 500).alias("row")).distinct()
    return enclosing_scopes(calls, scopes)


RULES = [
    {"id": "big", "priority": 5, "action": "tag", "tag": "late", "match": {"name_regex": "9$"}},
    {"id": "shop", "priority": 10, "action": "reclassify", "kind": "controller", "match": {"kind": "class", "path_contains": "ASIA"}},
    {"id": "keep", "priority": 15, "action": "skip", "match": {"name_regex": "#.*7$"}},
    {"id": "rest", "priority": 20, "action": "reclassify", "kind": "route", "match": {"kind": "function", "min_length": 10}},
]


@query("SELECT id, CASE WHEN kind NOT IN ('function', 'class') THEN kind WHEN kind = 'class' AND contains(file, 'ASIA') THEN 'controller' WHEN regexp_matches(name, '#.*7$') THEN kind WHEN kind = 'function' AND strlen(name) >= 10 THEN 'route' ELSE kind END AS new_kind, CASE WHEN kind IN ('function', 'class') AND regexp_matches(name, '9$') THEN 'late' ELSE '' END AS tags FROM entities")
def classify_rules(spark, sf):
    return lifting.classify(entities(spark, sf), RULES).select("id", "new_kind", F.array_join("tags", ",").alias("tags"))


LIFTS = [
    {"id": "customer", "priority": 10, "match": {"name_regex": "^Customer#"}, "strip_prefix": ["Customer#"], "features": ["serve customer {field}"]},
    {"id": "plain", "priority": 20, "match": {"kind": "model", "max_branches": 3}, "features": ["describe {name_lower}", "hold {kind}"]},
]


@query("WITH x AS (SELECT *, line_start % 3 AS branches, line_start % 2 AS loops, line_start % 5 AS calls FROM entities WHERE kind IN ('class', 'model')) SELECT id, CASE WHEN kind = 'class' THEN 'customer' ELSE 'plain' END AS rule, CASE WHEN kind = 'class' THEN 'accept' WHEN branches > 1 OR loops > 0 THEN 'reject' WHEN branches = 0 AND calls <= 2 THEN 'accept' ELSE 'review' END AS confidence, CASE WHEN kind = 'class' THEN 'serve customer ' || substr(name, 10) ELSE 'describe ' || name || ',hold model' END AS features FROM x")
def auto_lift(spark, sf):
    e = entities(spark, sf).filter("kind IN ('class', 'model')").withColumns({"branches": F.col("line_start") % 3, "loops": F.col("line_start") % 2, "calls": F.col("line_start") % 5, "parent_class": F.lit(None).cast("string")})
    return lifting.auto_lift(e, LIFTS).select("id", "rule", "confidence", F.array_join("features", ",").alias("features"))


@query("""WITH x AS (SELECT id, list_concat(semantic_features, [upper(semantic_features[1]), 'deal with ' || name, 'free the index of ' || lower(name), 'utilize']) AS s FROM entities),
y AS (SELECT id, s, unnest(s) AS feature, generate_subscripts(s, 1) AS pos FROM x),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(feature), '\\s+'), lambda v: v <> '') AS ws FROM y)
SELECT id, feature, 'duplicate' AS issue FROM w WHERE list_contains(list_transform(s[1:pos - 1], lambda f: lower(f)), lower(feature))
UNION ALL SELECT id, feature, 'too_short' FROM w WHERE len(ws) < 2 UNION ALL SELECT id, feature, 'too_long' FROM w WHERE len(ws) > 10
UNION ALL SELECT id, feature, 'vague_verb' FROM w WHERE len(ws) > 1 AND ws[1] IN ('handle', 'process', 'manage', 'deal', 'do', 'run', 'execute', 'perform', 'work', 'utilize')
UNION ALL SELECT id, feature, 'implementation_detail' FROM w WHERE len(ws) > 1 AND list_has_any(ws, ['loop', 'iterate', 'array', 'index', 'variable', 'pointer', 'mutex', 'allocate', 'deallocate', 'malloc', 'free', 'increment', 'decrement'])""")
def feature_critic(spark, sf):
    more = F.concat("semantic_features", F.array(F.upper(F.element_at("semantic_features", 1)), F.concat(F.lit("deal with "), "name"), F.concat(F.lit("free the index of "), F.lower("name")), F.lit("utilize")))
    return lifting.critique(entities(spark, sf).select("id", more.alias("semantic_features")))


@query("WITH l AS (SELECT trim(unnest(string_split(regexp_replace(name || ' | ' || array_to_string(semantic_features, ', ') || ',  ' || upper(name) || chr(10) || '# note | x' || chr(10) || '<think>a | b</think>', '<think>.*?</think>', '', 'gs'), chr(10)))) AS l FROM entities) SELECT trim(split_part(l, '|', 1)) AS name, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(regexp_replace(l, '^[^|]*\\|', ''), ','), lambda f: lower(trim(f))), lambda f: f <> ''))), ',') AS features FROM l WHERE l <> '' AND NOT starts_with(l, '#') AND contains(l, '|')")
def parse_line_features(spark, sf):
    e = entities(spark, sf)
    text = F.concat("name", F.lit(" | "), F.array_join("semantic_features", ", "), F.lit(",  "), F.upper("name"), F.lit("\n# note | x\n<think>a | b</think>"))
    return lifting.parse_lines(e.select(text.alias("text"))).select("name", F.array_join("features", ",").alias("features"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 6) AS value FROM events GROUP BY ALL", with_graph=False)
def hourly_events(spark, sf):
    return event_counts(read(spark, sf, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"')) AS links FROM pages", with_graph=False)
def page_links(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("links"))


@query()
def topo_exact(spark, sf):
    """The exact order of all entities by all dependencies."""
    g = graph(spark, sf)
    return planning.topological_order(g.entities, g.edges)


@query("SELECT p || x.suffix AS id, x.kind, x.line_start, x.line_end, x.parent_class FROM (SELECT 'c' || conv_id || '_' || turn || '.py' AS p FROM conversations), (VALUES (':C', 'class', 1, 3, NULL), (':C::m', 'method', 2, 3, 'C'), (':f', 'function', 5, 6, NULL)) x(suffix, kind, line_start, line_end, parent_class)", with_graph=False)
def python_extract(spark, sf):
    """A file a message, with the message as a comment's words."""
    words = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9 ]", " ")
    content = F.concat(F.lit("class C:\n    def m(self, a: int) -> int:\n        return f(a)\n\ndef f(x):\n    return '"), words, F.lit("'\n"))
    rows = read(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), content.alias("content"))
    return extract_entities(rows).select("id", "kind", "line_start", "line_end", "parent_class")


_LABEL = "replace(replace({}, '\\', '\\\\'), '\"', '\\\"')"
_NODES = "WITH n AS (SELECT DISTINCT array_to_string(list_slice(string_split(hierarchy_path, '/'), 1, i), '/') AS path FROM (SELECT DISTINCT hierarchy_path FROM entities), range(1, 4) t(i) WHERE i <= len(string_split(hierarchy_path, '/'))), nd AS (SELECT path, 'h:' || path AS id, len(string_split(path, '/')) AS level, string_split(path, '/')[-1] AS name FROM n)"


@query(_NODES + " SELECT 0 AS part, '  \"' || id || '\" [shape=folder, style=filled, fillcolor=\"#e0e0ff\", label=\"' || name || '\"];' AS line FROM nd"
       " UNION ALL SELECT 1, '  \"' || regexp_replace(id, '/[^/]*$', '') || '\" -> \"' || id || '\" [style=dotted];' FROM nd WHERE level > 1"
       " UNION ALL SELECT 2, '  \"' || " + _LABEL.format("id") + " || '\" [shape=' || CASE kind WHEN 'class' THEN 'box' WHEN 'model' THEN 'box' ELSE 'ellipse' END || ', style=filled, fillcolor=\"#e0ffe0\", label=\"' || " + _LABEL.format("name") + " || '\"];' FROM entities"
       " UNION ALL SELECT 3, '  \"' || " + _LABEL.format("source") + " || '\" -> \"' || " + _LABEL.format("target") + " || '\" [style=' || CASE kind WHEN 'invokes' THEN 'solid' WHEN 'imports' THEN 'dashed' WHEN 'composes' THEN 'solid' ELSE '?' END || ', label=\"' || kind || '\"];' FROM edges")  # fmt: skip
def dot_export(spark, sf):
    g = graph(spark, sf)
    return export.dot_lines(g.entities, g.edges)


@query(_NODES + ", x AS (SELECT path, id, level, name, replace(path, '/', chr(1)) || chr(1) AS place FROM nd)"
       " SELECT 0 AS part, hex(place) AS place, repeat('  ', level) || 'subgraph ' || translate(id, ':/. -', '_____') || '[\"' || name || '\"]' AS line FROM x"
       " UNION ALL SELECT 0, hex(place || chr(65535)), repeat('  ', level) || 'end' FROM x"
       " UNION ALL SELECT 0, hex(replace(hierarchy_path, '/', chr(1)) || chr(1)) || '00' || hex(id), repeat('  ', len(string_split(hierarchy_path, '/'))) || '  ' || translate(id, ':/. -', '_____') || '[\"' || " + _LABEL.format("name") + " || '\\n(' || kind || ')\"]' FROM entities"
       " UNION ALL SELECT 1, '', '  ' || translate(source, ':/. -', '_____') || CASE kind WHEN 'invokes' THEN ' -->|' WHEN 'composes' THEN ' -->|' WHEN 'imports' THEN ' -.->|' ELSE '?' END || kind || '| ' || translate(target, ':/. -', '_____') FROM edges")  # fmt: skip
def mermaid_export(spark, sf):
    g = graph(spark, sf)
    return export.mermaid_lines(g.entities, g.edges).withColumn("place", F.hex("place"))


_HITS = _AUTO.replace("LIMIT 30", "LIMIT 20").replace("LIMIT 15", "LIMIT 10")


@query(_HITS + ", near AS (SELECT id FROM au UNION SELECT target FROM edges WHERE source IN (SELECT id FROM au) UNION SELECT source FROM edges WHERE target IN (SELECT id FROM au)), sz AS (SELECT e.id, CASE WHEN au.id IS NULL THEN 'neighbour' ELSE 'hit' END AS role, coalesce(au.score, 0.0) AS score, CAST(ceil((length(e.id) + length(e.name) + length(array_to_string(e.semantic_features, ', '))) / 4.0) + 1 AS BIGINT) AS tokens FROM near JOIN entities e ON e.id = near.id LEFT JOIN au ON au.id = e.id), rn AS (SELECT *, CAST(sum(tokens) OVER (ORDER BY round(score, 9) DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM sz) SELECT id, role, round(score, 6) AS score, tokens, running FROM rn WHERE running <= 1000")
def context_pack(spark, sf):
    g = stored_graph(spark, sf)
    return traverse.context_pack(cut(g.entities), g.edges, QUERY, budget=1000).withColumn("score", F.round("score", 6))


@query("SELECT count_if(len(semantic_features) > 0 AND line_start % 3 > 0)::BIGINT AS lifted, count(*) AS total FROM entities")
def coverage_overall(spark, sf):
    return tree.coverage_overall(_third_unlifted(spark, sf))


def _third_unlifted(spark, sf):
    """As if every third line's entities had no features."""
    return entities(spark, sf).withColumn("semantic_features", F.when(F.col("line_start") % 3 > 0, F.col("semantic_features")))


@query("SELECT file, count(*) AS unlifted FROM entities WHERE line_start % 3 = 0 GROUP BY file")
def unlifted_by_file(spark, sf):
    return tree.unlifted_by_file(_third_unlifted(spark, sf))


@query(_UP + " SELECT id, name, kind || ' in ' || file AS description FROM entities WHERE id IN ('part:7', 'order:9') UNION ALL SELECT 'h:' || path, string_split(path, '/')[-1], 'hierarchy node (' || count(*) || ' entities' || CASE path WHEN 'ASIA' THEN ', grounded: ASIA)' ELSE ')' END FROM up WHERE path IN ('ASIA', 'PARTS/Brand#1') GROUP BY path")
def display_info(spark, sf):
    out = tree.display_info(entities(spark, sf), ["part:7", "order:9", "h:ASIA", "h:PARTS/Brand#1", "h:nowhere", "none"])
    return out.withColumn("description", F.regexp_replace("description", ", grounded: PARTS", ""))


@query("WITH ids AS (SELECT unnest(['part:7', 'order:9']) AS i), n AS (SELECT i, 'downstream' AS way, kind, target AS id FROM edges JOIN ids ON source = i UNION SELECT i, 'upstream', kind, source FROM edges JOIN ids ON target = i) SELECT id, name, file, array_to_string(semantic_features, ',') AS features, (SELECT string_agg(way || ' ' || kind || ' ' || n.id, ',' ORDER BY way, kind, n.id) FROM n WHERE n.i = entities.id) AS deps FROM entities WHERE id IN ('part:7', 'order:9')")
def project_fields(spark, sf):
    g = graph(spark, sf)
    out = traverse.project(g.entities, g.edges, ["part:7", "order:9"], ["features", "deps"])
    return out.select("id", "name", "file", F.array_join("features", ",").alias("features"), F.array_join(F.transform("deps", lambda d: F.concat_ws(" ", d.way, d.kind, d.id)), ",").alias("deps"))


@query("WITH scoped AS (SELECT * FROM entities WHERE starts_with(hierarchy_path, 'PARTS/') AND kind = 'model' AND line_end >= 1 AND line_start <= 800), " + _AUTO.removeprefix("WITH ").replace("FROM entities", "FROM scoped") + " SELECT id, round(score, 6) AS score FROM au")
def search_entry(spark, sf):
    """The one entry with a scope, kinds and lines."""
    found = search.search(entities(spark, sf), QUERY, 15, scope="PARTS", kinds="model, bogus", lines=(1, 800))
    return found.withColumn("score", F.round("score", 6))


@query("WITH deg AS (SELECT id, count(*) AS links FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id), r AS (SELECT CASE WHEN contains(file, '/') THEN regexp_replace(file, '/[^/]*$', '') ELSE '' END AS folder, e.id AS entity, links FROM entities e JOIN deg USING (id)) SELECT folder, entity, links FROM r QUALIFY row_number() OVER (PARTITION BY folder ORDER BY links DESC, entity) <= 5")
def snapshot_skeleton(spark, sf):
    g = graph(spark, sf)
    return analytics.skeleton(g.edges, g.entities)


_REPORT_LINE = "id || ': in ' || ca || ', out ' || ce || ', instability ' || CAST(round(instability * 100) AS BIGINT) || '%'"


@query(_HEALTH + f"""SELECT 0 AS part, unnest(range(5))::INT AS place, unnest(['entities: ' || count(*), 'god: ' || count_if(god), 'unstable: ' || count_if(unstable), 'stable: ' || count_if(stable), 'hub: ' || count_if(hub)]) AS line FROM health
UNION ALL SELECT * FROM (SELECT 1, (row_number() OVER (ORDER BY ca + ce DESC, id) - 1)::INT AS place, {_REPORT_LINE} FROM health WHERE god ORDER BY place LIMIT 10)
UNION ALL SELECT * FROM (SELECT 2, (row_number() OVER (ORDER BY instability DESC, ce DESC, id) - 1)::INT AS place, {_REPORT_LINE} FROM health WHERE unstable ORDER BY place LIMIT 10)""")
def health_report(spark, sf):
    g = graph(spark, sf)
    return export.health_lines(analytics.health(g.entities, g.edges))


@query("""WITH u AS (SELECT count(*) AS n, count(*) FILTER (kind <> 'class') AS need, CAST(sum(length(name) // 4) FILTER (kind <> 'class') AS BIGINT) AS t FROM entities),
v AS (SELECT *, CAST(ceil(40 * (need::DOUBLE / n)) AS BIGINT) AS batches FROM u), w AS (SELECT *, (500 + t // need * 25) * batches AS i, need * 30 AS o FROM v)
SELECT need AS to_lift, n - need AS auto_lifted, batches, i + i // 5 AS input_tokens, o + o // 5 AS output_tokens, round((i + i // 5) / 1000000 * 3.0::DOUBLE + (o + o // 5) / 1000000 * 15.0::DOUBLE, 6) AS cost FROM w""")
def lift_cost(spark, sf):
    """Names stand for sources, and customers for what rules lift."""
    e = entities(spark, sf).select(F.col("name").alias("source_text"), (F.col("kind") == "class").alias("lifted"))
    return planning.lift_cost(e, 40, 3.0, 15.0).withColumn("cost", F.round("cost", 6))
