"""Operators on small literal graphs."""

import random

import pytest
from pyspark.sql import functions as F

from codeatlas import session
from codeatlas.functions.text import clean_score, drift, glob_regex, jaccard, split_words, structural_signals
from codeatlas.operators import analytics, evolve, graph, hierarchy, lifting, planning, search, traverse
from codeatlas.schema import ENTITIES, CodeGraph
from codeatlas.sources import extract, files

CHAIN = [("a", "b", "invokes"), ("b", "c", "invokes"), ("d", "a", "imports")]


def edges_df(spark, rows):
    return spark.createDataFrame(rows, "source string, target string, kind string")


def entities_df(spark, rows):
    full = [(i, k, n, f, 1, 9, None, fs, None, h, None) for i, k, n, f, fs, h in rows]
    return spark.createDataFrame(full, ENTITIES)


@pytest.fixture(scope="module")
def shop(spark):
    return entities_df(spark, [
        ("auth.rs:validate_token", "function", "validate_token", "auth.rs", ["jwt token validation", "authentication check"], "Security/auth/token"),
        ("db.rs:query_users", "function", "query_users", "db.rs", ["database query", "user retrieval"], "DataAccess/storage/users"),
        ("api.rs:handle_login", "function", "handle_login", "api.rs", ["login endpoint", "authentication flow"], "Security/auth/login"),
        ("utils.rs:parse_config", "function", "parse_config", "utils.rs", ["configuration parsing", "toml reader"], "Core/config/parsing"),
    ])


def test_search(spark, shop):
    best = search.search_auto(shop, "database query", 3).collect()
    assert best[0].id == "db.rs:query_users"
    assert search.search_features(shop, "", 5).count() == 0
    assert {r.id for r in search.filtered(shop, "Security").collect()} == {"auth.rs:validate_token", "api.rs:handle_login"}
    assert search.filtered(shop, "Nowhere").count() == 0 and search.filtered(shop, ".").count() == 4
    assert search.filtered(shop, file_glob="a*.rs").count() == 2 and search.filtered(shop, file_glob="[x").count() == 4
    assert search.filtered(shop, kinds="bogus").count() == 4 and search.filtered(shop, lines=(10, 20)).count() == 0


def test_traversal_matches_plain_search(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(12)]
    rows = sorted({(rng.choice(names), rng.choice(names), rng.choice(["invokes", "imports"])) for _ in range(30)})
    e = edges_df(spark, rows)
    depth, front = {"n0": 0}, ["n0"]
    while front:
        front = [t for t in sorted({t for s, t, _ in rows if s in front}) if t not in depth and not depth.update({t: max(depth.values()) + 1})]
        for t in front:
            depth[t] = min(depth[s] for s, x, _ in rows if x == t and s in depth and s not in front) + 1
    got = {r.id: r.depth for r in traverse.explore(e, e, "n0", depth=-1).collect()}
    assert got == depth


def test_chain(spark):
    e = edges_df(spark, CHAIN)
    assert {(r.id, r.direction) for r in traverse.neighbours(e, "a").collect()} == {("b", "downstream"), ("d", "upstream")}
    assert [(r.id, r.depth) for r in traverse.impact_radius(e, "c", depth=3).collect()] == [("b", 1), ("a", 2), ("d", 3)]
    path = traverse.impact_radius(e, "c", depth=3).filter("id = 'd'").first().path
    assert [(p.id, p.kind) for p in path] == [("c", "invokes"), ("b", "invokes"), ("a", "imports")]
    assert [r.path for r in traverse.find_paths(e, "d", "c").collect()] == [["d", "a", "b", "c"]]
    assert traverse.find_paths(e, "c", "d").count() == 0 and traverse.find_paths(e, "d", "c", hops=2).count() == 0
    nodes, kept = traverse.slice_between(e, ["d", "c"], 3)
    assert {r.id for r in nodes.collect()} == {"a", "b", "c", "d"} and kept.count() == 3
    with pytest.raises(ValueError):
        traverse.slice_between(e, ["a"])
    with pytest.raises(ValueError):
        traverse.neighbours(e, "a", kinds=["bogus"])


def test_kind_filter_prunes(spark):
    nodes = entities_df(spark, [("a", "function", "a", "f", [], ""), ("b", "class", "b", "f", [], ""), ("c", "function", "c", "f", [], "")])
    e = edges_df(spark, CHAIN[:2])
    assert {r.id for r in traverse.explore(e, nodes, "a", depth=5, entity_kinds=["function"]).collect()} == {"a"}


def test_cycles_match_plain_enumeration(spark):
    rng = random.Random(5)
    names = "abcdef"
    links = sorted({(rng.choice(names), rng.choice(names)) for _ in range(14)})
    want = set()

    def walk(path):
        for s, t in links:
            if s == path[-1]:
                if t == path[0] and len(path) >= 2:
                    want.add(tuple(path))
                elif t > path[0] and t not in path:
                    walk([*path, t])

    for n in names:
        walk([n])
    got = analytics.cycles(edges_df(spark, [(s, t, "invokes") for s, t in links])).collect()
    assert {tuple(r.cycle) for r in got} == want and len(got) == len(want)
    assert analytics.cycles(edges_df(spark, CHAIN)).count() == 0


def test_order():
    assert planning.kahn(["a", "b", "c"], [("a", "b"), ("b", "c")]) == ["c", "b", "a"]
    assert planning.kahn(["a", "b", "c"], [], largest_first=True) == ["c", "b", "a"]
    assert planning.kahn(["a", "b", "c"], [("a", "b"), ("b", "a")]) == ["c", "a", "b"]
    assert planning.token_batches([("a", 5), ("b", 5), ("c", 5)], 10) == [["a", "b"], ["c"]]
    assert planning.token_batches([], 10) == []


def test_graph_changes(spark):
    nodes = entities_df(spark, [("x.py:f", "function", "f", "x.py", ["does f"], "A/b/c"), ("x.py:g", "function", "g", "x.py", [], "A/b/c"), ("y.py:h", "function", "h", "y.py", [], "A/b/d")])
    e = edges_df(spark, [("x.py:f", "y.py:h", "invokes"), ("x.py:g", "y.py:h", "invokes")])
    assert {r.id for r in graph.module_entities(nodes).collect()} == {"x.py:x", "y.py:y"}
    assert graph.issues(nodes.filter("file = 'x.py'"), e).count() == 2
    parsed = entities_df(spark, [("x.py:f", "function", "f", "x.py", [], ""), ("x.py:n", "function", "n", "x.py", [], "")])
    changes = spark.createDataFrame([("modified", "x.py", None), ("renamed", "z.py", "y.py")], "op string, path string, from_path string")
    after = evolve.apply_changes(CodeGraph(nodes, e), changes, parsed)
    got = {r.id: r for r in after.entities.collect()}
    assert set(got) == {"x.py:f", "x.py:n", "x.py:x", "z.py:h"}
    assert got["x.py:f"].semantic_features == ["does f"] and got["x.py:n"].hierarchy_path == "A/b/c"
    assert [tuple(r) for r in after.edges.collect()] == [("x.py:f", "z.py:h", "invokes")]


def test_resolution(spark):
    nodes = entities_df(spark, [("a:f", "function", "f", "a", [], ""), ("a:g", "function", "g", "a", [], ""), ("b:g", "function", "g", "b", [], ""), ("c:u", "function", "u", "c", [], ""), ("b:f2", "function", "f2", "b", [], "")])
    refs = spark.createDataFrame([("a:f", "a", "g", "invokes"), ("a:f", "a", "u", "invokes"), ("c:u", "c", "g", "invokes"), ("a:g", "a", "g", "invokes"), ("a:f", "a", "none", "invokes")], "source string, file string, name string, kind string")
    assert {(r.source, r.target) for r in graph.resolve(nodes, refs).collect()} == {("a:f", "a:g"), ("a:f", "c:u"), ("a:g", "b:g")}


def test_text_functions(spark):
    import re

    assert re.match(glob_regex("src/*.py"), "src/a/b.py") and not re.match(glob_regex("*.rs"), "a.py")
    assert re.match(glob_regex("{a,b}?.x"), "ac.x") and glob_regex("a]{") is None
    row = spark.range(1).select(
        jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))).alias("j"), drift(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("d"),
        split_words(F.lit("parseHTTPResponse_now")).alias("w"), clean_score(F.lit(float("nan"))).alias("c"), *(v.alias(k) for k, v in structural_signals(F.lit("if x:\n  return f(x)\nfor y in z:\n  g()\nreturn 1\n")).items()),
    ).first()
    assert (row.j, row.d, row.w, row.c) == (0.5, 0.0, "parse http response now", 0.0)
    assert (row.branches, row.loops, row.early_returns, row.calls, row.lines) == (1, 1, 1, 2, 5)  # an end of line at the end begins no line


def test_lifting(spark):
    lines = spark.createDataFrame([("<think>x | y</think>\n# c | d\nfoo | B b, a a, a a\n```\nbar |\n",)], "text string")
    assert [(r.name, r.features) for r in lifting.parse_lines(lines).collect()] == [("foo", ["a a", "b b"])]
    with pytest.raises(ValueError):
        lifting.check_rules([{"id": "x", "match": {}, "features": ["{bogus}"]}])
    rows = entities_df(spark, [("a:f", "function", "f", "a", ["old"], "")])
    out = lifting.submit_features(rows, spark.createDataFrame([("a:f", [" New thing "])], "key string, features array<string>"))
    assert out.first().semantic_features == ["new thing"]


def test_hierarchy(spark, shop):
    assert {r.path: r.entity_count for r in hierarchy.entity_counts(shop).collect()}["Security"] == 2
    assigned = spark.createDataFrame([("query_users", "X/y/z")], "key string, path string")
    assert hierarchy.apply_assignments(shop, assigned).filter("name = 'query_users'").first().hierarchy_path == "X/y/z"
    flat = hierarchy.features(shop).withColumn("f", F.explode("features")).groupBy("path", F.col("f").alias("feature")).agg(F.count("*").alias("n"))
    drifted = spark.createDataFrame([("api.rs:handle_login", 0.9)], "id string, drift double")
    assert hierarchy.reroute(shop, flat, drifted).count() == 4


def test_python_extraction(spark):
    text = "import os\nfrom m import (a, b)\n\nclass U(Base):\n    def m(self, x: int, *r) -> str:\n        return go(x)\n\ndef main():\n    U().m(1)\n"
    f = spark.createDataFrame([("src/main.py", "python", text), ("bad.py", "python", "def broken(:\n  pass\nclass K:\n  def m(self):\n    pass\n")], "path string, language string, content string")
    got = {r.id: r for r in extract.extract_entities(f).collect()}
    assert set(got) == {"src/main.py:U", "src/main.py:U::m", "src/main.py:main", "bad.py:broken", "bad.py:K", "bad.py:K::m"}
    m = got["src/main.py:U::m"]
    assert m.kind == "method" and m.signature.return_type == "str" and [p.name for p in m.signature.parameters] == ["x", "*r"]
    refs = {(r.kind, r.caller, r.callee) for r in extract.extract_references(f).filter("file = 'src/main.py'").collect()}
    assert {("imports", "", "a"), ("imports", "", "b"), ("imports", "", "os"), ("inherits", "U", "Base"), ("invokes", "U.m", "go"), ("invokes", "main", "m")} <= refs


@pytest.mark.parametrize(("language", "path", "text", "names"), [
    ("rust", "a.rs", "use std::fs;\npub struct S;\nimpl S {\n    pub fn new() -> S {\n        make()\n    }\n}\nfn free() {}\n", {"a.rs:S", "a.rs:S::new", "a.rs:free"}),
    ("typescript", "app/login/page.tsx", "import { F } from './f';\nexport default function Page() {\n  return <LoginForm />;\n}\nexport const useAuth = () => {\n};\n", {"app/login/page.tsx:Page", "app/login/page.tsx:useAuth"}),
    ("go", "m.go", "type T struct {\n}\nfunc (t *T) Run() {\n}\n", {"m.go:T", "m.go:Run"}),
    ("java", "A.java", "public class A extends B {\n  public void run(int x) {\n    go();\n  }\n}\n", {"A.java:A", "A.java:A::run"}),
    ("ruby", "a.rb", "class A < B\n  def run\n    go()\n  end\nend\n", {"a.rb:A", "a.rb:A::run"}),
    ("bash", "a.sh", "run() {\n  go\n}\n", {"a.sh:run"}),
    ("kotlin", "a.kt", "class A : B() {\n  fun run() {\n  }\n}\n", {"a.kt:A", "a.kt:A::run"}),
    ("scala", "a.scala", "object A extends B {\n  def run(x: Int) = {\n  }\n}\n", {"a.scala:A", "a.scala:A::run"}),
    ("swift", "a.swift", "struct A {\n  func run() {\n  }\n}\n", {"a.swift:A", "a.swift:A::run"}),
    ("php", "a.php", "class A extends B {\n  public function run() {\n  }\n}\n", {"a.php:A", "a.php:A::run"}),
    ("csharp", "a.cs", "public class A : B {\n  public void Run() {\n  }\n}\n", {"a.cs:A", "a.cs:A::Run"}),
    ("c", "a.c", "struct s {\n};\nint run(int x) {\n  return go(x);\n}\n", {"a.c:s", "a.c:run"}),
])
def test_lexical_extraction(language, path, text, names):
    assert {extract.entity_id(path, n, p) for k, n, a, b, p, s in extract.parse(path, language, text)[0]} == names


@pytest.mark.parametrize(("language", "text", "name", "want"), [
    ("rust", "impl S {\n    pub fn go<T: Ord>(&mut self, a: &str, b: Vec<(u8, T)>) -> Result<T, E> {\n    }\n}", "go", ([("a", "&str"), ("b", "Vec<(u8, T)>")], "Result<T, E>")),
    ("rust", "fn f() {\n}", "f", ([], None)),
    ("typescript", "export function go(\n  a: string,\n  b?: Map<string, number> = new Map(),\n): Promise<void> {\n}", "go", ([("a", "string"), ("b", "Map<string, number>")], "Promise<void>")),
    ("typescript", "export const go = async (a: string, cb: (x: number) => void): Promise<X> => {\n};", "go", ([("a", "string"), ("cb", "(x: number) => void")], "Promise<X>")),
    ("javascript", "function go(a, ...rest) {\n}", "go", ([("a", None), ("...rest", None)], None)),
    ("go", "func (t *T) Run(a, b int, c map[string]int) (int, error) {\n}", "Run", ([("a", "int"), ("b", "int"), ("c", "map[string]int")], "(int, error)")),
    ("java", "class A {\n  public static Map<String, Integer> go(final String a,\n      int[] b) {\n  }\n}", "go", ([("a", "String"), ("b", "int[]")], "Map<String, Integer>")),
    ("csharp", "class A {\n  public async Task<int> Go(string a, int b = 3)\n  {\n  }\n}", "Go", ([("a", "string"), ("b", "int")], "Task<int>")),
    ("c", "static char *go(const char *a, int n) {\n}", "go", ([("a", "const char*"), ("n", "int")], "char *")),
    ("c", "void go(void) {\n}", "go", ([], None)),
    ("php", "class A {\n  public function go(?string $a, $b = 1): array {\n  }\n}", "go", ([("a", "?string"), ("b", None)], "array")),
    ("ruby", "def go(a, b = 1, *c, d:)\nend", "go", ([("a", None), ("b", None), ("c", None), ("d", None)], None)),
    ("kotlin", "fun go(a: String, b: List<Int> = listOf()): Int {\n}", "go", ([("a", "String"), ("b", "List<Int>")], "Int")),
    ("swift", "func go(with a: String, _ b: Int) throws -> Bool {\n}", "go", ([("a", "String"), ("b", "Int")], "Bool")),
    ("scala", "def go(a: Int, b: Map[String, Int]): Option[Int] = {\n}", "go", ([("a", "Int"), ("b", "Map[String, Int]")], "Option[Int]")),
])
def test_lexical_signatures(language, text, name, want):
    found = {n: s for _, n, _, _, _, s in extract.parse("a", language, text)[0]}
    assert found[name] == want


def test_comments_and_literals_are_no_code():
    text = "// fn ghost() {}\n/* class Ghost {\n} */\nfn real(a: &'static str) {\n    call(\"ghost2()\");\n    let c = '(';\n    other(a); // ghost3()\n}\n"
    entities, deps = extract.parse("a.rs", "rust", text)
    assert [(e[1], e[2], e[3]) for e in entities] == [("real", 4, 8)] and [d[2] for d in deps] == ["call", "other"]
    entities, deps = extract.parse("a.ts", "typescript", "import { a } from './lib/util';\nfunction f() {\n  const s = `class X { g() }`;\n  h(s);\n}\n")
    assert [e[1] for e in entities] == ["f"] and ("imports", "", "util", "./lib/util") in deps and ("invokes", "f", "h", None) in deps and len(deps) == 2


def test_ignore_files(spark, tmp_path):
    for name in ("a.py", "gen/b.py", "gen/keep.py", "x/c.gen.py", "x/d.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("# made\ngen/*\n!gen/keep.py\n*.gen.py\n")
    paths = lambda **k: {r.path for r in files.scan(spark, str(tmp_path), **k).collect()}
    assert paths() == {"a.py", "gen/keep.py", "x/d.py"} and paths(ignore=["x/"]) == {"a.py", "gen/keep.py"}
    assert len(paths(ignore_files=[])) == 5


def test_scan_save_load_stream(spark, tmp_path):
    from codeatlas.plans.build import build, parsed
    from codeatlas.streaming.sync import apply_stream

    root = tmp_path / "src"
    (root / "auth").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "main.py").write_text("from auth.login import check\ndef run():\n    check(1)\n")
    (root / "auth" / "login.py").write_text("def check(x: int) -> bool:\n    return True\n")
    (root / ".hidden" / "x.py").write_text("def hidden(): pass\n")
    (root / "notes.txt").write_text("x")
    rows = files.scan(spark, str(root))
    assert {r.path for r in rows.collect()} == {"main.py", "auth/login.py"}
    g = build(rows)
    assert ("main.py:run", "auth/login.py:check", "invokes") in {tuple(r) for r in g.edges.collect()}
    assert ("main.py:run", "auth/login.py:check", "data_flow") in {tuple(r) for r in g.edges.collect()}
    folder = files.save(g, str(tmp_path / "graph"), "v0")
    assert files.load(spark, folder).entities.count() == g.entities.count()
    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "1.json").write_text('{"op": "deleted", "path": "main.py"}\n')
    stream = spark.readStream.schema("op string, path string, from_path string").json(str(feed))
    q = apply_stream(stream, str(tmp_path / "graph"), lambda b: parsed(rows.limit(0)), str(tmp_path / "cp"))
    q.awaitTermination()
    assert {r.file for r in files.load(spark, str(tmp_path / "graph" / "v1")).entities.collect()} == {"auth/login.py"}


def test_update_equals_a_fresh_build(spark):
    """After deletions, renames, changes and additions the graph is that of the new tree: calls that were
    removed are gone, new ones are there, names that became ambiguous resolve no more; features stay."""
    from codeatlas.plans.build import build, parsed

    def tree(rows):
        return spark.createDataFrame([(p, "python", t) for p, t in rows.items()], "path string, language string, content string")

    old = {
        "a/main.py": "from b import helper\n\ndef run():\n    helper(1)\n    gone()\n\ndef twice(x: int) -> int:\n    return unique(x)\n",
        "a/b.py": "def helper(x):\n    return x\n", "c.py": "def gone():\n    pass\n", "d.py": "def unique(x) -> int:\n    return 1\n", "e.py": "def lonely():\n    run()\n",
    }
    new = {
        "a/main.py": "def run():\n    helper(1)\n    fresh()\n\ndef twice(x: int) -> int:\n    return unique(x)\n",
        "a/b2.py": old["a/b.py"], "d.py": old["d.py"], "e.py": old["e.py"], "f/g.py": "def fresh():\n    lonely()\n\ndef unique():\n    pass\n",
    }
    changes = spark.createDataFrame([("deleted", "c.py", None), ("renamed", "a/b2.py", "a/b.py"), ("modified", "a/main.py", None), ("added", "f/g.py", None)], "op string, path string, from_path string")
    before = build(tree(old))
    lifted = F.when(F.col("id").isin("a/main.py:run", "a/main.py:main", "a/b.py:helper", "a/b.py:b"), F.array(F.lit("does it"))).otherwise(F.col("semantic_features"))
    before = CodeGraph(before.entities.withColumn("semantic_features", lifted), before.edges, before.references)
    after = evolve.apply_changes(before, changes, *parsed(tree({k: new[k] for k in ("a/main.py", "f/g.py")})))
    want = build(tree(new))
    rows = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    columns = ("id", "kind", "name", "file", "line_start", "line_end", "parent_class", "signature")
    assert rows(after.entities, *columns) == rows(want.entities, *columns)
    dependencies = "kind <> 'contains'"
    assert rows(after.edges.filter(dependencies), "source", "target", "kind") == rows(want.edges.filter(dependencies), "source", "target", "kind")
    assert rows(after.references, "source", "file", "name", "kind") == rows(want.references, "source", "file", "name", "kind")
    assert {r.id for r in after.entities.filter("size(semantic_features) > 0").collect()} == {"a/main.py:run", "a/main.py:main", "a/b2.py:helper", "a/b2.py:b2"}
    assert after.entities.filter("hierarchy_path IS NULL OR semantic_features IS NULL").count() == 0
    # Containment is that of the entities' own places.
    assert rows(after.edges.filter("kind = 'contains'"), "source", "target") == rows(graph.containment(after.entities), "source", "target")


def test_change_filters(spark):
    rows = [("added", "a.py", None), ("added", "a.txt", None), ("renamed", "b.txt", "b.py"), ("renamed", "c.py", "c.txt"), ("renamed", "gen/d.py", "d.py"), ("renamed", "e.py", "f.py"), ("deleted", "g.py", None)]
    changes = spark.createDataFrame(rows, "op string, path string, from_path string")
    got = {tuple(r) for r in evolve.keep_changes(changes, ["py"], ["gen/*"]).collect()}
    assert got == {("added", "a.py", None), ("deleted", "b.py", None), ("added", "c.py", None), ("deleted", "d.py", None), ("renamed", "e.py", "f.py"), ("deleted", "g.py", None)}
    e = entities_df(spark, [("gen/x.py:f", "function", "f", "gen/x.py", [], ""), ("y.py:f", "function", "f", "y.py", [], "")])
    assert [r.path for r in evolve.newly_ignored(e, ["gen/*"]).collect()] == ["gen/x.py"]
    assert [r.path for r in evolve.vanished(e, spark.createDataFrame([("y.py",)], "path string")).collect()] == ["gen/x.py"]


def test_odd_paths(spark, tmp_path):
    import subprocess

    root = tmp_path / "a root+x"
    (root / "sub").mkdir(parents=True)
    for name in ("a b.py", "ä+ü.py", "100%.py"):
        (root / "sub" / name).write_text("def f():\n    pass\n")
    assert {r.path for r in files.scan(spark, str(root)).collect()} == {"sub/a b.py", "sub/ä+ü.py", "sub/100%.py"}
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "."), git("commit", "-qm", "one")
    (root / "sub" / "ä+ü.py").write_text("x = 1\n")
    git("mv", "sub/a b.py", "sub/c\td.py")
    (root / "new ñ.py").write_text("x = 2\n")
    got = {tuple(r) for r in files.git_changes(spark, str(root), "HEAD", None).collect()}
    assert got == {("modified", "sub/ä+ü.py", None), ("renamed", "sub/c\td.py", "sub/a b.py"), ("added", "new ñ.py", None)}
    vectors = spark.createDataFrame([("a", 0, [1.0], "f")], "entity_id string, feature_ord int, vector array<double>, fingerprint string")
    files.save_vectors(vectors, str(tmp_path / "v"))
    assert files.load_vectors(spark, str(tmp_path / "v")).collect() == vectors.collect()


def test_ignore_rules():
    import re

    assert re.search(files.ignore_regex("target/"), "target/x.rs") and not re.search(files.ignore_regex("target/"), "src/target.rs")
    assert re.search(files.ignore_regex("*.gen.py"), "a/b.gen.py") and files.ignore_regex("# x") is None
    with pytest.raises(ValueError):
        files.Config.read({"drift_ignore": 0.8})


def test_cycle_statistics(spark):
    from codeatlas.operators import analytics

    found = spark.createDataFrame([(["a", "b"], 2), (["a", "c", "d"], 3)], "cycle array<string>, length int")
    e = spark.createDataFrame([("a", "f1", "Nav/x"), ("b", "f1", "Nav/y"), ("c", "f2", "Core/x"), ("d", "f2", None)], "id string, file string, hierarchy_path string")
    assert analytics.cycle_summary(found, e).first().asDict() == {"cycles": 2, "entities": 4, "files": 2, "areas": 2}
    assert {tuple(r) for r in analytics.cycle_lengths(found).collect()} == {(2, 1), (3, 1)}
    assert {tuple(r) for r in analytics.cycle_areas(found, e).filter("area IS NOT NULL").collect()} == {("Nav", 2, 2), ("Core", 1, 1)}
    assert [r.length for r in analytics.filter_cycles(found, e, cross_file=True).collect()] == [3]
    assert [r.length for r in analytics.filter_cycles(found, e, "Core").collect()] == [3]
    assert analytics.filter_cycles(found, e, "Other").count() == 0
    none = found.limit(0)
    assert analytics.cycle_summary(none, e).first().asDict() == {"cycles": 0, "entities": 0, "files": 0, "areas": 0}
    assert analytics.cycle_lengths(none).count() == 0 and analytics.filter_cycles(none, e).count() == 0


def test_lift_cost(spark):
    from codeatlas.operators import planning

    rows = spark.createDataFrame([("x" * 400, False), (None, None), ("y" * 40, True)], "source_text string, lifted boolean")
    # Two of three need lifting, so 4 of 6 batches; 100 tokens over two is 50 a piece.
    want = {"to_lift": 2, "auto_lifted": 1, "batches": 4, "input_tokens": (500 + 50 * 25) * 4 * 6 // 5, "output_tokens": 72}
    got = planning.lift_cost(rows, 6, 3.0, 15.0).first().asDict()
    assert abs(got.pop("cost") - (8400 * 3 + 72 * 15) / 1e6) < 1e-12 and got == want
    for some in (rows.limit(0), rows.filter("lifted")):
        assert planning.lift_cost(some, 6, 3.0, 15.0).first().cost == 0


def test_report_lines(spark):
    from codeatlas.operators import analytics
    from codeatlas.plans import export

    e = spark.createDataFrame([(f"v{i}", "function", f'n"{i}\\', "A/b", ["f"] if i == 3 else []) for i in range(12)], "id string, kind string, name string, hierarchy_path string, semantic_features array<string>")
    edges = spark.createDataFrame([("v0", f"v{i}", "invokes") for i in range(1, 12)], "source string, target string, kind string")
    report = analytics.health(e, edges)
    lines = [r.line for r in export.health_lines(report).orderBy("part", "place").collect()]
    assert lines == ["entities: 12", "god: 1", "unstable: 1", "stable: 11", "hub: 1", "v0: in 0, out 11, instability 100%", "v0: in 0, out 11, instability 100%"]
    assert [r.line for r in export.health_lines(report.limit(0)).orderBy("place").collect()] == ["entities: 0", "god: 0", "unstable: 0", "stable: 0", "hub: 0"]
    dot = {r.line for r in export.dot_lines(e, edges).collect()}
    assert {'  "v3" [shape=ellipse, style=filled, fillcolor="#e0ffe0", label="n\\"3\\\\"];', '  "h:A" [shape=folder, style=filled, fillcolor="#e0e0ff", label="A"];', '  "h:A" -> "h:A/b" [style=dotted];', '  "v0" -> "v1" [style=solid, label="invokes"];'} <= dot
    shown = [r.line for r in export.mermaid_lines(e.limit(2), edges.limit(1)).orderBy("part", "place").collect()]
    assert [x.split("[")[0] for x in shown] == ["  subgraph h_A", "    subgraph h_A_b", "      v0", "      v1", "    end", "  end", "  v0 -->|invokes| v1"]


def test_batches_across_blocks(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "b", None]), f"{i:04}", rng.choice([0, 1, 3, 9, 40, None])) for i in range(600)] + [("one", "x", 99)]
    df = spark.createDataFrame(rows, "area string, id string, tokens int")
    for budget, most, block in [(12, 5, 16), (12, 5, 5), (1, 3, 7), (1000, 7, 8), (30, 100, 10), (12, 5, 1 << 16)]:
        got = planning.token_batches_by_area(df, budget, most, block).collect()
        want = []
        for area in {r[0] for r in rows}:
            sizes = [(i, t or 0) for a, i, t in sorted(rows, key=lambda r: r[1]) if a == area]
            tokens = dict(sizes)
            want += [(area, k, len(b), sum(tokens[i] for i in b)) for k, b in enumerate(planning.token_batches(sizes, budget, most))]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert planning.token_batches_by_area(df.limit(0)).count() == 0


def test_islands_across_blocks(spark):
    rng = random.Random(4)
    areas = [a for a in ("x", "y", None, "x", "z", "y") for _ in range(rng.randint(1, 40))] + ["z"] * 50
    df = spark.createDataFrame(list(enumerate(areas)), "pos long, area string").repartition(5)
    want, island, run = {}, 0, 0
    for i, a in enumerate(areas):
        fresh = i == 0 or a != areas[i - 1]
        island, run = (island + 1, 0) if fresh else (island, run + 1)
        want[(a, island, run // 8)] = want.get((a, island, run // 8), 0) + 1
    for block in (7, 16, 1 << 16):
        got = {(r.area, r.island, r.batch): r.n for r in planning.reconstruction_batches(df, 8, block).collect()}
        assert got == want
    assert planning.reconstruction_batches(df.limit(0)).count() == 0


@pytest.mark.parametrize("threshold,top", [(0.7, 50), (0.3, 7), (0.9, 500), (0.05, 2000)])
def test_token_clones_of_copies(spark, threshold, top):
    """Copies, near copies and parts that many share, against all pairs."""
    rng = random.Random(5)
    shared = [rng.randint(0, 99) for _ in range(30)]
    base = [[rng.randint(0, 99) for _ in range(rng.randint(5, 40))] + (shared if k % 3 else []) for k in range(14)]
    base += [b[: len(b) // 2] + [7] + b[len(b) // 2 :] for b in base[:6]] + [[1] * 30, [1] * 31]
    sources = {f"s{rng.randint(0, 10**6):07}": b for b in base for _ in range(rng.choice([1, 1, 4, 12]))}
    rows = [*sources.items(), ("none", None), ("short", [1])]
    got = analytics.token_clones(spark.createDataFrame(rows, "id string, tokens array<int>"), 4, threshold, 6, top).collect()
    hs, want = {i: set(analytics.window_hashes(t, 4)) for i, t in sources.items()}, []
    for a in sources:
        for b in sources:
            n = len(hs[a] & hs[b])
            least = min(len(sources[a]), len(sources[b])) - 3
            if a < b and n and least > 0 and min(1.0, n / least) >= threshold and n + 3 >= 6:
                want.append((a, b, n, round(min(1.0, n / least), 3)))
    want = sorted(want, key=lambda r: (-r[3], r[0], r[1]))[:top]
    assert len(want) > 5 and [tuple(r) for r in got] == want


def test_topo_exact_whole(spark):
    """Over all entities and edges: at each place the smallest id whose targets are all before it."""
    from conftest import SF

    from codeatlas.plans import queries, tables

    g = tables.graph(spark, SF)
    ids = {r.id for r in g.entities.select("id").collect()}
    waits = {i: set() for i in ids}
    for r in g.edges.collect():
        if r.source in ids and r.target in ids and r.source != r.target:
            waits[r.source].add(r.target)
    want, done = [], set()
    while len(want) < len(ids):
        want.append(min(i for i in ids - done if waits[i] <= done))
        done.add(want[-1])
    assert [r.id for r in queries.topo_exact(spark, SF).orderBy("pos").collect()] == want


def test_topo_exact_off_the_driver(spark, monkeypatch):
    """Beyond the driver's bound neither edges nor places pass through it, and the order is the same."""
    from conftest import SF

    from codeatlas.plans import queries, tables

    g = tables.graph(spark, SF)
    want = planning.kahn([r.id for r in g.entities.select("id").collect()], [tuple(r) for r in g.edges.select("source", "target").collect()])
    monkeypatch.setattr(planning, "ON_DRIVER", 0, raising=False)
    with monkeypatch.context() as m:
        for name in ("toArrow", "toPandas", "collect"):
            m.setattr(type(g.entities), name, lambda *_, name=name: pytest.fail(f"{name} on the driver"))
        out = queries.topo_exact(spark, SF).orderBy("pos")
    got = out.collect()
    assert [r.id for r in got] == want and [r.pos for r in got] == list(range(len(want)))


@pytest.mark.parametrize("on_driver", [0, 1 << 22])
def test_topological_order_of_odd_graphs(spark, monkeypatch, on_driver):
    """Cycles and what is behind them, edges twice, of other kinds, to oneself and to nowhere, ids twice, a
    chain each way, and no rows."""
    monkeypatch.setattr(planning, "ON_DRIVER", on_driver)
    settings = {k: spark.conf.get(k, None) for k in session.STORING}
    for seed in (1, 2):
        chance, ids = random.Random(seed), [f"e{i:03}" for i in range(80)]
        hidden = chance.sample(ids[:64], 64)
        links = [(hidden[b], hidden[a]) for a, b in (sorted(chance.sample(range(64), 2)) for _ in range(60 * seed))]
        links += [(ids[i], ids[i + 1]) for i in range(64, 69)] + [(ids[i + 1], ids[i]) for i in range(70, 74)]
        links += [(ids[75], ids[76]), (ids[76], ids[75]), (ids[77], ids[75]), (ids[0], ids[77]), (ids[78], ids[78])]
        rows = [(s, t, "imports") for s, t in links] + [(s, t, "invokes") for s, t in links[:9]] + [(ids[79], "gone", "imports"), ("gone", ids[79], "imports"), (ids[64], ids[79], "contains")]
        entities = spark.createDataFrame([(i,) for i in ids + ids[:5]], "id string")
        edges = spark.createDataFrame(rows, "source string, target string, kind string")
        got = planning.topological_order(entities, edges).orderBy("pos").collect()
        assert [r.id for r in got] == planning.kahn(ids, links) and [r.pos for r in got] == list(range(80))
    assert [tuple(r) for r in planning.topological_order(entities.filter("id = 'e000'"), edges.limit(0)).collect()] == [(0, "e000")]
    assert planning.topological_order(entities.limit(0), edges).count() == 0
    assert settings == {k: spark.conf.get(k, None) for k in session.STORING}


def test_kahn_numbered():
    import random

    import numpy as np

    chance = random.Random(5)
    for n in (1, 5, 30):
        for m in (0, n, 3 * n):
            links = sorted({(chance.randrange(n), chance.randrange(n)) for _ in range(m)})
            ends = np.array(links, dtype=np.int32).reshape(-1, 2)
            assert planning.kahn_numbered(n, ends[:, 0], ends[:, 1]).tolist() == planning.kahn(list(range(n)), links)


def test_levels_of_a_long_chain(spark):
    ids = [f"e{i:03d}" for i in range(105)] + ["x", "y"]
    links = [(ids[i + 1], ids[i], "imports") for i in range(104)] + [("x", "y", "imports"), ("y", "x", "imports")]
    entities = spark.createDataFrame([(i,) for i in ids], "id string").coalesce(1)
    edges = spark.createDataFrame(links, "source string, target string, kind string").coalesce(1)
    got = {r.id: r.level for r in planning.topological_levels(entities, edges).collect()}
    assert got == {f"e{i:03d}": i for i in range(105)} | {"x": -1, "y": -1}


def test_long_chain_is_explored(spark):
    e = edges_df(spark, [(f"n{i:03}", f"n{i + 1:03}", "invokes") for i in range(40)])
    got = {r.id: r.depth for r in traverse.explore(e, e, "n000", depth=-1).collect()}
    assert got == {f"n{i:03}": i for i in range(41)}
    assert {(r.root, r.id, r.depth) for r in traverse.reached(e, ["n002", "n001"], "upstream", 2).collect()} == {("n002", "n002", 0), ("n002", "n001", 1), ("n002", "n000", 2), ("n001", "n001", 0), ("n001", "n000", 1)}


def test_code_tokens_and_clones(spark):
    from codeatlas.functions.code import code_tokens

    one = "def add(a, b):\n    return a + b * 2  // sum\n"
    assert code_tokens(one) == code_tokens("def plus(x,y): return x+y*7 /* other */")
    assert code_tokens(one) != code_tokens("def add(a, b):\n    return a - b * 2\n") and code_tokens(None) == []
    assert code_tokens("'a\\'b' \"un") == code_tokens("1 2.5e3") and len(code_tokens("a <= b && !c")) == 6
    body = "fn f(a) { let x = g(a, 1); if x > 2 { return h(x); } else { return k(x, \"s\"); } }\n"
    files_df = spark.createDataFrame([("a", body), ("b", body.replace("x", "other").replace("2", "99")), ("c", "fn q() {}"), ("d", None)], "id string, content string")
    got = analytics.token_clones(analytics.tokenized(files_df)).collect()
    assert [(r.a, r.b, r.similarity) for r in got] == [("a", "b", 1.0)]

    def rolling(tokens, width):
        return [sum(t * pow(256, width - 1 - k, 1_000_000_007) for k, t in enumerate(tokens[i : i + width])) % 1_000_000_007 for i in range(len(tokens) - width + 1)]

    tokens = [random.Random(1).randrange(1 << 31) for _ in range(60)]
    assert analytics.window_hashes(tokens, 20) == rolling(tokens, 20) and analytics.window_hashes(tokens[:5], 20) == []


TOML = """
schema_version = 1
name = "shop"
priority = 5
languages = ["python"]
[detect]
deps = ["flask"]
config_files = ["shop.json"]
[[detect.dir_with_files]]
dir = "routes"
pattern = "*.py"
[[classify]]
id = "shop.view"
action = { reclassify = "controller" }
[classify.match]
kind = "function"
file_path_contains = "routes"
name_starts_uppercase = false
[[auto_lift]]
id = "shop.getter"
features = ["{verb} {field}"]
strip_prefix = ["get_"]
[auto_lift.match]
name_regex = "^get_"
max_lines = 12
[auto_lift.prefix_verb]
"get_" = "return"
[prompt_hints]
lifting = "- name the goods"
"""


def test_framework_files(spark, tmp_path):
    from codeatlas.sources import rules

    (tmp_path / "shop.toml").write_text(TOML)
    (tmp_path / "all.toml").write_text('name = "core"\npriority = 1\n')
    found = rules.load_frameworks(str(tmp_path))
    assert [f.name for f in found] == ["core", "shop"] and "name the goods" in rules.hints(found, "lifting")
    tree = lambda *rows: spark.createDataFrame(rows, "path string, language string, content string")
    code = ("x.py", "python", "")
    active = lambda *rows: extract.detect_paradigms(tree(code, *rows), rules.detection(found))
    assert active() == ["core"] and active(("requirements.txt", None, "flask==2.0\n")) == ["core", "shop"]
    assert active(("requirements.txt", None, "flask-cors\n# flaskx")) == ["core"] and active(("a/shop.json", None, None)) == ["core", "shop"]
    assert active(("app/routes/a/b.py", "python", "")) == ["core", "shop"] and active(("routes.py", "python", "")) == ["core"]
    assert extract.detect_paradigms(tree(("package.json", None, '{"flask": 1}')), rules.detection(found)) == ["core"]
    e = entities_df(spark, [("routes/a.py:get_total_cost", "function", "get_total_cost", "routes/a.py", [], ""), ("b.py:get_x", "function", "get_x", "b.py", [], "")]).withColumns({c: F.lit(1) for c in ("lines", "branches", "loops", "calls")})
    assert {r.name: r.new_kind for r in lifting.classify(e, found[1].classify).collect()} == {"get_total_cost": "controller", "get_x": "function"}
    assert {r.id: r.features for r in lifting.auto_lift(e, found[1].auto_lift).collect()}["routes/a.py:get_total_cost"] == ["return total cost"]
    for bad in ("schema_version = 2\nname = 'x'", "priority = 3", TOML.replace("{verb}", "{bogus}"), TOML.replace("reclassify", "explode")):
        with pytest.raises(ValueError):
            rules.parse_framework(bad)


def test_search_entry(spark, shop):
    assert search.search(shop, "", 5).count() == 0 and search.search(shop, "database query", 1).first().id == "db.rs:query_users"
    with pytest.raises(ValueError):
        search.search(shop, "x", mode="bogus")
    semantic = spark.createDataFrame([("utils.rs:parse_config", 0.9), ("not.there", 1.0)], "id string, score double")
    got = [r.id for r in search.search(shop, "database query", 4, semantic=semantic).collect()]
    assert got[0] == "utils.rs:parse_config" and "not.there" not in got
    e = edges_df(spark, [("auth.rs:validate_token", "api.rs:handle_login", "invokes")])
    plain = [r.id for r in search.search(shop, "authentication", 4).collect()]
    boosted = search.search(shop, "authentication", 4, edges=e, changed=spark.createDataFrame([(plain[-1],)], "id string")).collect()
    assert boosted[0].id == plain[-1]
    vectors = shop.limit(1).select(search.hashing_embedder(8)(F.lit("one two two")).alias("a"), search.hashing_embedder(8)(F.lit(None).cast("string")).alias("b"), search.hashing_embedder(2, lambda texts: [[3.0, 4.0]] * len(texts))(F.lit("x")).alias("c")).first()
    assert abs(sum(x * x for x in vectors.a) - 1) < 1e-9 and vectors.b == [0.0] * 8 and vectors.c == [0.6, 0.8]


def test_plan_and_fields(spark, shop):
    from codeatlas.plans.export import change_plan_text

    e = edges_df(spark, [("api.rs:handle_login", "auth.rs:validate_token", "invokes"), ("t.rs:test_login", "auth.rs:validate_token", "invokes")])
    whole = shop.unionByName(entities_df(spark, [("t.rs:test_login", "function", "test_login", "t.rs", [], "")]))
    plan = planning.plan_change(whole, e, "authentication")
    assert plan["order"].index("auth.rs:validate_token") < plan["order"].index("api.rs:handle_login") and plan["tests"] == ["t.rs:test_login"] or "t.rs:test_login" in plan["order"]
    assert {x["id"]: (x["upstream"], x["files"]) for x in plan["impact"]}["auth.rs:validate_token"] == (2, 2) and plan["lifted"] == 80.0
    text = change_plan_text(plan)
    assert text.startswith('## Change Plan for: "authentication"\n') and "- `auth.rs:validate_token`: 2 upstream dependents across 2 files\n" in text and "Note: 80% lifting" in text
    sources = spark.createDataFrame([("auth.rs", "a\nb\nc")], "file string, content string")
    row = traverse.project(shop, e, ["auth.rs:validate_token"], ["features", "source", "deps", "hierarchy"], sources, 2).first()
    assert row.source == "a\nb" and [(d.way, d.id) for d in row.deps] == [("upstream", "api.rs:handle_login"), ("upstream", "t.rs:test_login")]
    with pytest.raises(ValueError):
        traverse.project(shop, e, ["x"], ["bogus"])


def test_lifting_session(spark, shop):
    from codeatlas.plans.export import pipe_table, tree_text

    module = entities_df(spark, [("auth.rs:auth", "module", "auth", "auth.rs", ["old"], "Security/auth/token")])
    lost = entities_df(spark, [("new.rs:login", "function", "login", "new.rs", ["login endpoint", "authentication flow"], "Misc/x/y")])
    g = CodeGraph(shop.unionByName(module).unionByName(lost), edges_df(spark, []))
    pending = lost.select("id", F.col("semantic_features").alias("features"))
    tree = hierarchy.features(shop)
    page, seen = lifting.routing_page(pending, tree)
    assert [(r.id, r.candidate) for r in page.collect()] == [("new.rs:login", "Security")]  # no child is strictly more similar
    paths = tree.select("path")
    decisions = spark.createDataFrame([("new.rs:login", "Security/auth/login"), ("x", "keep")], "id string, decision string")
    assert {r.id: r.problem for r in lifting.check_routing(decisions, pending, paths, seen).collect()} == {"new.rs:login": None, "x": "not pending"}
    with pytest.raises(ValueError):
        lifting.check_routing(decisions, pending.limit(0), paths, seen)
    done = lifting.finalize(g, pending)
    rows = {r.id: r for r in done.entities.collect()}
    assert rows["new.rs:login"].hierarchy_path in ("Misc", "Security")  # its own place counts as well
    assert rows["auth.rs:auth"].semantic_features == ["authentication check", "jwt token validation"] and done.edges.filter("kind = 'contains'").count() > 0
    assert pipe_table("t", pending.select("id")) == "t[1|]{id}:\n  new.rs:login"
    found = traverse.explore(edges_df(spark, CHAIN), shop, "a", depth=3)
    assert tree_text(found) == "a\n  b\n    c"


def test_integrity_and_snapshot(spark, shop):
    e = edges_df(spark, [("h:Nowhere", "auth.rs:validate_token", "contains"), ("h:Security", "h:Security/auth", "contains")])
    present = shop.select(F.col("file").alias("path")).filter("path <> 'db.rs'")
    assert {tuple(r) for r in graph.orphans(shop, e, present).collect()} == {("orphan_node", "h:Nowhere"), ("missing_file", "db.rs")}
    groups, few = analytics.trimmed_snapshot(shop, 30_000)
    assert few == 3 and groups.count() == 4 and analytics.trimmed_snapshot(shop, 1)[1] == 0
    assert graph.edges_for(e, "h:Security").count() == 1
    replaced = graph.insert(shop, entities_df(spark, [("db.rs:query_users", "class", "query_users", "db.rs", [], "")]))
    assert replaced.count() == 4 and replaced.filter("id = 'db.rs:query_users'").first().kind == "class"
    low, high = search.bootstrap_interval([1, 2, 0, 1])
    assert 0 <= low <= high <= 1
    found = spark.createDataFrame([(["a", "b"], 2), (["a", "c", "d"], 3)], "cycle array<string>, length int")
    own = spark.createDataFrame([("a", "f1", "Nav/x"), ("b", "f1", "Nav/y"), ("c", "f2", "Core/x"), ("d", "f2", None)], "id string, file string, hierarchy_path string")
    assert [r.length for r in analytics.sort_cycles(found, own, "file_count").collect()] == [3, 2]
    assert [r.length for r in analytics.filter_cycles(found, own, ignored=("f1",)).collect()] == [3]
    node = traverse.fetch_node(shop, "Security").first()
    assert (node.children, node.entity_count) == ("auth", 2)


def test_reports_as_text(spark, shop):
    from codeatlas.plans import export

    e = edges_df(spark, CHAIN)
    found = traverse.explore(e, shop, "a", depth=3)
    assert export.tree_text(found, 2) == "a\n  b\n... 1 more lines"
    nodes = entities_df(spark, [(x, "function", x, f"{x}.py", [], "") for x in "ab"])
    assert export.compact_text(found, nodes) == "a | root | origin | 0 | a.py\nb | invokes | downstream | 1 | b.py\nc | invokes | downstream | 2 | "
    ring = edges_df(spark, [("a", "b", "invokes"), ("b", "a", "invokes")])
    lines = [r.line for r in export.cycle_lines(analytics.cycles(ring), nodes).orderBy("part", "place").collect()]
    assert lines[0] == "cycles: 1" and lines[-2:] == ["length 2: 1", "a -> b -> a"]
    calls = edges_df(spark, [("auth.rs:validate_token", "db.rs:query_users", "invokes")])
    text, tokens = export.snapshot(shop, calls)
    assert "total_entities: 4" in text and "Security: authentication check" in text and "auth.rs:validate_token 1" in text and 500 < tokens < 1000
    short, less = export.snapshot(shop, calls, 500)
    assert len(short) < len(text) and less < tokens and "auth.rs:validate_token 1" not in short
    files_df = spark.createDataFrame([("a.py", "python"), ("b.rs", "rust"), ("c.rs", "rust")], "path string, language string")
    assert "Languages: rust (2), python (1)\nEntities: 4 in 4 files, 1 edges\nAreas: Security, Core, DataAccess\n" in export.repository_info("x", files_df, shop, calls)


def test_synthesis_and_queue(spark, shop, tmp_path):
    modules = entities_df(spark, [(f"{d}/m.py:m", "module", "m", f"{d}/m.py", ["old"], "") for d in ("a", "src/a", "b")])
    new = spark.createDataFrame([("a/m.py", "Parse it, keep it , parse it"), ("x/b/m.py", "longer one")], "file string, text string")
    got = {r.file: r.semantic_features for r in lifting.submit_synthesis(modules, new).collect()}
    assert got == {"a/m.py": ["keep it", "parse it"], "src/a/m.py": ["keep it", "parse it"], "b/m.py": ["longer one"]}
    assert [r.file for r in lifting.synthesis_page(shop, 1, 3).collect()] == ["utils.rs"]
    assert not lifting.hierarchy_allowed(shop)
    many = entities_df(spark, [(f"{i}:f", "function", "f", f"{i}.py", ["a b"] if i < 20 else [], "") for i in range(50)])
    assert lifting.hierarchy_allowed(many) and not lifting.hierarchy_allowed(many.filter("id <> '0:f'"))
    queue = shop.select("id", F.col("semantic_features").alias("features"))
    assert files.load_queue(spark, str(tmp_path / "q")).count() == 0
    files.save_queue(queue, str(tmp_path / "q")), files.save_queue(queue.limit(2), str(tmp_path / "q"))
    assert files.load_queue(spark, str(tmp_path / "q")).count() == 2
    lost = entities_df(spark, [("n.rs:login", "function", "login", "n.rs", ["login endpoint"], "Misc/x/y"), ("n.rs:none", "function", "none", "n.rs", [], "Misc/x/y")])
    tree = hierarchy.features(shop)
    moved = {r.name: r.hierarchy_path for r in hierarchy.route_new(shop.unionByName(lost), lost, tree).collect()}
    assert moved["login"].startswith("Security") and moved["none"] == "Misc/x/y" and moved["query_users"] == "DataAccess/storage/users"
    assert hierarchy.route_new(lost, lost, tree.filter("path = 'Security'")).filter("name = 'login'").first().hierarchy_path == "Misc/x/y"


def test_sync_state(spark):
    from codeatlas.streaming import sync

    now = spark.createDataFrame([("modified", "a.py", 1, 2), ("added", "b.py", 3, 4)], "op string, path string, size long, mtime long")
    state = sync.due(None, "c1", now)
    assert state[0] == "c1" and sync.due(state, "c1", now.orderBy("path")) is None and sync.due(state, "c2", now) and sync.due(state, "c1", now.limit(1))
    assert [tuple(r) for r in sync.reverted(now, now.filter("path = 'b.py'")).collect()] == [("modified", "a.py", None)]


STORES = """import { useSelector as pick, useDispatch } from 'react-redux';
export const userSlice = createSlice({
  name: 'user',
  initialState: { a: 1, reducers: 2 },
  reducers: {
    login: (state, action) => { state.a = { b: 1 }; },
    logout(state) {
      state.a = 0;
    },
  },
});
const load = createAsyncThunk('load', async () => { fetchUser(); });
export const { useGetPostsQuery, useAddPostMutation: useAdd, other } = postsApi;
function Panel() {
  const send = useDispatch();
  const user = pick(selectUser);
  const x = pick((s) => s.x);
  const { data } = useGetPostsQuery();
  send(userSlice.login());
  dispatch(load);
  setCartStore(x);
  setTimeout(() => 1, 5);
}
function setName(a) {
}
"""


def test_stores():
    entities, deps = extract.parse("a.ts", "typescript", STORES)
    found = {(k, n, a, b, p) for k, n, a, b, p, _ in entities}
    assert {("store", "userSlice", 2, 11, None), ("function", "login", 6, 6, "userSlice"), ("function", "logout", 7, 9, "userSlice"), ("function", "load", 12, 12, None)} <= found
    assert {("hook", "useGetPostsQuery", 13, 13, None), ("hook", "useAdd", 13, 13, None)} <= found and not any(n == "other" for _, n, *_ in found)
    state = {(k, c, t) for k, c, t, _ in deps if k in ("reads_state", "writes_state", "dispatches")}
    reads = {("reads_state", "Panel", t) for t in ("pick", "selectUser", "useGetPostsQuery")}
    assert state == reads | {("writes_state", "Panel", t) for t in ("setCartStore", "cartStore")} | {("dispatches", "Panel", t) for t in ("login", "load")}


def test_hook_of_a_repository(tmp_path):
    import subprocess

    from codeatlas.sources.hooks import hook_path, install_hook, uninstall_hook

    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    repository = str(tmp_path)
    assert not uninstall_hook(repository)
    path = install_hook(repository, "true", ["it's"])
    assert path == hook_path(repository) and path.stat().st_mode & 0o111
    assert uninstall_hook(repository) and not path.exists()
    path.write_text("#!/bin/sh\necho own\n")
    install_hook(repository, "true", [])
    install_hook(repository, "true", [])
    assert path.read_text().count("codeatlas: begin") == 1
    assert uninstall_hook(repository) and path.read_text() == "#!/bin/sh\necho own\n"


def test_reroute_without_oneself(spark, shop):
    """The moved entity's own place holds nothing but its features, so that it goes to what others share."""
    rows = [("a:x", "function", "x", "a", ["read file", "parse text"], "Old/one/two"), ("b:y", "function", "y", "b", ["read file"], "Io/files/read"), ("c:z", "function", "z", "c", ["parse text", "send"], "Net/send/now")]
    e = entities_df(spark, rows)
    moved = hierarchy.reroute(e, hierarchy.feature_counts(e), spark.createDataFrame([("a:x", 0.9), ("b:y", 0.1)], "id string, drift double"))
    assert {r.id: r.hierarchy_path for r in moved.collect()} == {"a:x": "Io", "b:y": "Io/files/read", "c:z": "Net/send/now"}


def test_scopes_for_lifting(spark, shop):
    ids = lambda scope: {r.id for r in hierarchy.resolve_scope(shop, scope).collect()}
    assert ids("all") == ids("*") == set() and ids("Security") == {"auth.rs:validate_token", "api.rs:handle_login"}
    assert ids("a*.rs") == {"auth.rs:validate_token", "api.rs:handle_login"} and ids("Security/auth/token") == {"auth.rs:validate_token"}
    assert ids("db.rs:query_users, none") == {"db.rs:query_users"} and ids("") == set()
