"""Operators over small graphs, lists and sources."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestar.operators import catalog, context, dense, fusion, graph, lexical, parse, relate
from lodestar.plans.ingestion import ingest
from lodestar.schemas import TABLES, create_tables
from lodestar.sources import files, tables


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("login", "jwt", "CALLS", 0.9, 1), ("login", "users", "CALLS", 0.85, 2), ("auth", "login", "CONTAINS", 1.0, 3)]
    return spark.createDataFrame(rows, "src string, dst string, relation_type string, confidence double, seq long")


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([("login", "method"), ("jwt", "function"), ("users", "class"), ("auth", "class")], "id string, symbol_type string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_graph_neighbours(spark, edges, nodes):
    assert graph.counts(nodes, edges).first().asDict() == {"node_count": 4, "edge_count": 3}
    assert ids(graph.callers(edges, "jwt")) == ["login"] and ids(graph.callees(edges, "login")) == ["jwt", "users"]
    assert ids(graph.dependents(edges, "users")) == ["login"] and ids(graph.dependencies(edges, "nobody")) == []
    assert ids(graph.phantom_nodes(nodes.where("id <> 'jwt'"), edges)) == ["jwt"]


def test_graph_searches(spark, edges, nodes):
    seed = spark.createDataFrame([("auth", "auth")], "root string, id string")
    assert [(r["id"], r["level"]) for r in graph.neighborhood(edges, seed).orderBy("level", "id").collect()] == [("login", 1), ("jwt", 2), ("users", 2)]
    assert graph.neighborhood(edges, seed, limit=2).count() == 2
    assert [(r["id"], r["kind"]) for r in graph.impact(edges, "jwt").collect()] == [("login", "direct")]
    found, inside = graph.subgraph(edges, spark.createDataFrame([("jwt",)], "id string"), depth=1)
    assert ids(found) == ["jwt", "login"] and inside.count() == 1
    assert ids(graph.default_roots(nodes)) == ["auth", "users"]
    assert len(ids(graph.default_roots(nodes.where("symbol_type = 'method'")))) == 1


def test_graph_with_cycle(spark):
    e = spark.createDataFrame([("a", "b", "CALLS", 1.0, 1), ("b", "a", "CALLS", 1.0, 2), ("a", "a", "USES", 1.0, 3), ("a", "b", "USES", 0.5, 4)], "src string, dst string, relation_type string, confidence double, seq long")
    assert {(r["id"], r["level"]) for r in graph.impact(e, "a").collect()} == {("a", 1), ("b", 1)} or graph.impact(e, "a").count() == 1
    assert {(r["src"], r["dst"], r["relation_type"]) for r in graph.collapsed(e).collect()} == {("a", "b", "USES"), ("b", "a", "CALLS"), ("a", "a", "USES")}
    assert graph.first_edges(e).count() == 4


def test_bm25_finds_the_class(spark):
    docs = spark.createDataFrame([(1, "class AuthService login user"), (2, "def parse_config path"), (3, "order repository save"), (4, "readme of the project")], "id int, t string")
    index = lexical.build_index(docs, "id", F.col("t"))
    asked = spark.createDataFrame([("q", "auth"), ("q", "service"), ("none", "zzz")], "query_id string, term string")
    found = lexical.search(index, asked).collect()
    assert [r["id"] for r in found] == [1] and found[0]["score"] > 0
    assert lexical.search(lexical.build_index(docs.limit(0), "id", F.col("t")), asked).count() == 0


def test_dense_batch_equals_single(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").limit(200)
    q = v.where("vec_id in (3, 5)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    batch = dense.nearest_batch(v, q, k=7)
    vec = v.where("vec_id = 3").first()["embedding"]
    one = dense.nearest(v, F.array(*map(F.lit, vec)), k=7)
    assert [r["id"] for r in batch.where("query_id = 3").orderBy("rank").collect()] == [r["id"] for r in one.collect()]


def test_fusion(spark):
    lists = [spark.createDataFrame(x, "query_id string, id string, rank int") for x in ([("q", "a", 1), ("q", "b", 2)], [("q", "b", 1), ("q", "c", 2)])]
    assert [r["id"] for r in fusion.fused_ranking(lists, 5).orderBy("rank").collect()] == ["b", "a", "c"]
    flat = fusion.minmax(spark.createDataFrame([("q", 2.0), ("q", 2.0)], "query_id string, score double"))
    assert [r["normalized"] for r in flat.collect()] == [0.0, 0.0]


def test_exact_name_outranks_score(spark):
    c = spark.createDataFrame([("q", "x", 0.5, "login", "Auth.login"), ("q", "y", 0.8, "other", "Auth.other")], "query_id string, id string, score double, name string, full string")
    boost = fusion.rerank_boost(F.lit("login"), F.array(F.lit("login")), F.lit("LOCATION"), F.col("name"), F.col("full"), F.lit("method"), F.lit(False))
    assert [r["id"] for r in fusion.reranked(c.withColumn("boost", boost), 1).collect()] == ["x"]


def test_context_keeps_to_its_budget(spark):
    rows = [("q", i, f"A.f{i}", "a.py", i, i + 1, "function", "python", None, "x" * 100 if i else "[REDACTED]") for i in range(30)]
    p = spark.createDataFrame(rows, "query_id string, rank int, qualified_name string, file_path string, start_line int, end_line int, symbol_type string, language string, documentation string, code_snippet string")
    q = spark.createDataFrame([("q", "how?", "FLOW")], "query_id string, text string, intent string")
    text = context.assembled(q, p, p.where("rank > 27"), "demo", budget=900).first()["context"]
    assert text.startswith("REPOSITORY: demo") and text.count("• ") == 30 and "REDACTED" not in text
    assert 1 <= text.count("--- FUNCTION") < 10


def test_citations_and_history(spark):
    c = spark.createDataFrame([("q", "a.py", 1, 1), ("q", "a.py", 1, 2), ("q", "b.py", 1, 3)], "query_id string, file_path string, start_line int, rank int")
    assert sorted(r["rank"] for r in context.citations(c, "query_id", ["rank"]).collect()) == [1, 3]
    m = spark.createDataFrame([(1, t) for t in range(15)], "conv_id int, turn int")
    assert sorted(r["turn"] for r in context.history(m).collect()) == [6, 7, 8, 9]


PY = 'import os\n\nclass A:\n    """Doc."""\n\n    def f(self):\n        return g(os.getcwd())\n\n    @router.get("/x")\n    async def h(self):\n        return self.f()\n\ndef g(v):\n    return v\n'


def test_parse_python_spans_and_edges(spark):
    f = spark.createDataFrame([("r", "a.py", "python", PY), ("r", "bad.py", "python", "class Q:\n    def m(self):\n        x = (\n"), ("r", "e.py", "python", None)], "repository_id string, path string, language string, content string")
    parsed = parse.parse_files(f)
    symbols = parse.symbols_of(parsed)
    got = {(r["file_path"], r["symbol_type"], r["qualified_name"], r["start_line"], r["end_line"]) for r in symbols.collect()}
    assert {("a.py", "class", "A", 3, 11), ("a.py", "method", "A.f", 6, 7), ("a.py", "function", "g", 13, 14), ("a.py", "endpoint", "GET /x", 10, 11), ("bad.py", "method", "Q.m", 2, 3), ("e.py", "file", "e.py", 1, 1)} <= got
    edges = {(r["source_name"], r["relation_type"], r["target_name"]) for r in relate.relationships(parsed, symbols).collect()}
    assert {("A.f", "CALLS", "g"), ("A.f", "CALLS", "getcwd"), ("A.h", "CALLS", "f"), ("A", "IMPORTS", "os"), ("GET /x", "ROUTES_TO", "A.h"), ("a.py", "CONTAINS", "A")} <= edges


TS = """import { x, y as z } from 'lib';
import 'side';
// class Fake { }
interface Shape { area(): number; }
enum Color { Red, Green }
export class App extends Base {
  name = "}{";
  constructor(private a: number) { super(a); this.init(); }
  async start<T>(v: T) { return x(v); }
  get size(): number { return this.items.map(i => i.len()); }
}
export async function main() {
  new App(1).start();
  function inner() { return g(); }
}
main();
"""
JAVA = """package a;
import java.util.List;
import static a.b.C.*;
public class Main extends Base {
  @GetMapping("/all")
  public List<String> all(int n) throws Exception {
    String s = "} {"; /* } */
    return helper(new Foo(n), s.trim());
  }
  Main() { init(); }
  interface Inner { void run(); }
  enum E { A, B }
}
"""
GO = """package main
import (
  "fmt"
  m "math"
)
type Point struct {
  X int
}
func (p Point) Norm() float64 { return m.Sqrt(p.X) }
func main() {
  if true { fmt.Println(call(1)) }
}
"""
C = """#include <stdio.h>
#define F(x) (x)
struct node { int v; };
int add(int a, int b);
static int *make(struct node *n) {
  char c = '}';
  for (int i = 0; i < 3; i++) { printf("%d", add(1, 2)); }
  return 0;
}
"""
CPP = """#include <vector>
namespace n {
class Box : public Base {
 public:
  int get() const { return compute(v); }
  void set(int);
};
void Box::set(int x) { v = std::max(x, 1); }
}
"""


@pytest.mark.parametrize(
    "language,source,symbols,imports,calls",
    [
        ("typescript", TS, ["interface Shape 4 4", "enum Color 5 5", "class App 6 11", "method App.constructor 8 8", "method App.start 9 9", "method App.size 10 10", "function main 12 15", "function inner 14 14"],
         ["lib", "side"], ["init 8", "x 9", "map 10", "len 10", "start 13", "g 14", "main 16"]),
        ("java", JAVA, ["class Main 4 13", "method Main.all 6 9", "endpoint GET /all 6 9", "method Main.Main 10 10", "interface Inner 11 11", "method Inner.run 11 11", "enum E 12 12"],
         ["java.util.List", "a.b.C.*"], ["helper 8", "trim 8", "init 10"]),
        ("go", GO, ["struct Point 6 8", "method Norm 9 9", "function main 10 12"], ["fmt", "math"], ["Sqrt 9", "Println 11", "call 11"]),
        ("c", C, ["struct node 3 3", "function make 5 9"], ["#include <stdio.h>"], ["printf 7", "add 7"]),
        ("cpp", CPP, ["class Box 3 7", "function get 5 5", "function set 8 8"], ["#include <vector>"], ["compute 5", "max 8"]),
        ("javascript", "class A { m() { b(); } static n(x) { return x.y(); } }\nfunction f(a) { return `}`; }\nk(", ["class A 1 1", "method A.m 1 1", "method A.n 1 1", "function f 2 2"], [], ["b 1", "y 1", "k 3"]),
    ],
)
def test_languages_with_braces(language, source, symbols, imports, calls):
    got = parse.parse_file("f", language, source)
    assert [f"{s['symbol_type']} {s['qualified_name']} {s['start_line']} {s['end_line']}" for s in got["symbols"]] == symbols
    assert [i["module"] for i in got["imports"]] == imports and [f"{c['callee']} {c['line']}" for c in got["calls"]] == calls
    assert all(s["end_column"] > 0 for s in got["symbols"])


def test_parse_other_languages():
    java = "class Main {\n  public void run() {\n    if (x) {\n    }\n  }\n}\n"
    assert [(s["qualified_name"], s["start_line"], s["end_line"]) for s in parse.parse_file("M.java", "java", java)["symbols"]] == [("Main", 1, 6), ("Main.run", 2, 5)]
    assert parse.parse_file("x.txt", None, "a\nb")["symbols"][0]["end_line"] == 2
    assert [(s["qualified_name"], s["end_line"]) for s in parse.parse_file("a.js", "javascript", "function f()\n{ x('}') }\nclass A {\n")["symbols"]] == [("f", 2), ("A", 3)]
    assert parse.route_of('@GetMapping("/a")') == ("GET", "/a") and parse.route_of('@RequestMapping("/b")') == ("GET", "/b") and parse.route_of("@x") is None


def test_scan_to_index(spark, tmp_path):
    for name, text in {"src/app.py": PY, "node_modules/lib.js": "x", "README.md": "# Hi", ".env": "TOKEN=abcdefgh12345678", "img.png": "p"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bin.py").write_bytes(b"\0\1")
    found = files.scan(spark, str(tmp_path), "r1")
    assert [r["path"] for r in files.listing(found).collect()] == [".env", "README.md", "src/app.py"]
    repo = ingest(found)
    counts = repo.counters().first()
    assert counts["file_count"] == 3 and counts["symbol_count"] == 6 and counts["relationship_count"] > 5
    assert repo.vectors.where(F.size("vector") != 384).count() == 0
    asked = spark.createDataFrame([("q", "getcwd")], "query_id string, term string")
    assert lexical.search(repo.postings, asked).count() >= 1


def test_zip_members(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name in ("top/a.py", "top/b/c.py", "top/../evil", "/abs"):
            z.writestr(name, "x")
    a = spark.createDataFrame([("one", bytearray(data.getvalue())), ("two", bytearray(b"junk"))], "archive string, content binary")
    got = {(r["archive"], r["path"], r["error"]) for r in files.zip_members(a).collect()}
    assert got == {("one", "a.py", None), ("one", "b/c.py", None), ("two", None, "no archive")}


def test_tables_by_repository(spark, tmp_path):
    path = str(tmp_path / "symbols")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "repository_id string, n int")
    tables.append(rows, path)
    tables.replace_repositories(rows.where("repository_id = 'a'").withColumn("n", F.lit(5)), path)
    assert {(r["repository_id"], r["n"]) for r in tables.load(spark, path).collect()} == {("a", 5), ("b", 2)}
    assert tables.load(spark, path, "b").count() == 1 and tables.drop_everywhere(spark, str(tmp_path), "a") == ["symbols"]
    assert tables.load(spark, path).count() == 1


def test_as_of_takes_the_first_of_equal_states(spark):
    e = spark.createDataFrame([("k", 5), ("k", 1), ("z", 9)], "k string, at int")
    s = spark.createDataFrame([("k", 3, "x", 1), ("k", 3, "y", 2), ("k", 6, "w", 3)], "k string, since int, v string, tie int")
    assert {(r["k"], r["at"], r["v"]) for r in relate.as_of(e, s, ["k"], "at", "since", "v", "tie").collect()} == {("k", 5, "x"), ("k", 1, None), ("z", 9, None)}


def test_search_over_a_repository_and_its_missing_parts(spark):
    from lodestar import session
    from lodestar.plans import search

    source = "class AuthService:\n    \"\"\"Checks users.\"\"\"\n\n    def login(self, name):\n        return find_user(name)\n\ndef find_user(name):\n    return name\n"
    repo = ingest(files.classified(spark.createDataFrame([("r", "src/auth.py", source.encode()), *(("r", f"src/f{i}.py", f"def other{i}(x):\n    return x\n".encode()) for i in range(8))], "repository_id string, path string, bytes binary")))
    asked = spark.createDataFrame([(1, "Where is AuthService.login implemented?"), (2, "zzz")], "query_id int, text string")
    repo.symbols, edges = session.written(repo.symbols, "symbols"), session.written(graph.endpoints(repo.edges.withColumn("seq", F.col("line"))), "edges")
    found = search.retrieve(asked, repo.symbols, repo.postings, repo.vectors, edges)
    names = [r["qualified_name"] for r in found.candidates.where("query_id = 1").orderBy("rank").collect()]
    assert names[0].startswith("AuthService")
    stats = {(r["query_id"], r["stage"]): r["hits"] for r in found.stats().collect()}
    assert stats[1, "lexical"] > 0 and stats[1, "names"] + stats[1, "dense"] > 0 and len(stats) == 12
    prompt = {r["query_id"]: r["prompt"] for r in found.prompts("demo", spark.createDataFrame([(1, 0, "USER: hi")], "query_id int, order int, line string")).collect()}
    assert prompt[1].startswith("CONVERSATION HISTORY:\nUSER: hi\n\nREPOSITORY: demo\nQUESTION: Where") and "PRIMARY EVIDENCE" in prompt[1] and "INSTRUCTION: " in prompt[1]
    bare = search.retrieve(asked, repo.symbols, None, None, None)
    answers = {r["query_id"]: (r["answer"], r["confidence"]) for r in bare.answers().collect()}
    assert answers[2] == (search.NO_EVIDENCE, "NOT_FOUND") and bare.neighbors.count() == 0


def test_status_moves_forward_and_reindexing_is_refused(spark):
    from lodestar.operators import catalog
    from lodestar.schemas import REPOSITORIES

    rows = spark.createDataFrame([("a", "PARSING", "u"), ("b", "READY", ""), ("c", "FAILED", "u"), ("d", "READY", "u")], "id string, status string, source_url string")
    full = rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in ((f.name, f.dataType) for f in spark.createDataFrame([], REPOSITORIES).schema)))
    moved = {r["id"]: r for r in catalog.with_status(full, spark.createDataFrame([("a", "FAILED", None, "x" * 3000), ("d", "PARSING", "no", None), ("c", "QUEUED", "again", None)], "id string, status string, detail string, error string")).collect()}
    assert moved["a"]["status"] == "FAILED" and len(moved["a"]["error_message"]) == 2000 and moved["a"]["indexing_finished_at"]
    assert moved["d"]["status"] == "READY" and moved["c"]["status"] == "QUEUED" and moved["c"]["status_detail"] == "again"
    after, answer = catalog.reindex(full, full.select("id"))
    assert {r["id"]: r["accepted"] for r in answer.collect()} == {"a": False, "b": False, "c": True, "d": True}
    assert {r["id"]: (r["status"], r["file_count"]) for r in after.collect()} == {"a": ("PARSING", None), "b": ("READY", None), "c": ("QUEUED", 0), "d": ("QUEUED", 0)}
    assert {r["id"] for r in catalog.ready(after).collect()} == {"b"}
    ids = spark.createDataFrame([("ABCDEF00-1111-2222-3333-444455556666",), ("abcdef00111122223333444455556666",), ("x",)], "i string").select(catalog.point_id(F.col("i")).alias("p")).collect()
    assert [r["p"] for r in ids] == ["abcdef00-1111-2222-3333-444455556666"] * 2 + [None]


def test_dense_batch_leaves_out_what_has_no_vector(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", None), (None, [1.0, 0.0]), ("d", [1.0]), ("e", [0.0, 1.0])], "vec_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.1]), (2, None)], "query_id int, vector array<double>")
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in dense.nearest_batch(v, q, 2).collect())
    assert got == [(1, 1, "a"), (1, 2, "b")]


def test_a_damaged_archive_fails_alone(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("top/a.py", "x = 1\n" * 500)
    good = data.getvalue()
    at = good.index(b"a.py") + 10
    bad = good[:at] + bytes(b ^ 255 for b in good[at : at + 12]) + good[at + 12 :]
    rows = spark.createDataFrame([("good", good), ("bad", bad), ("none", b"xx")], "archive string, content binary")
    got = {r["archive"]: (r["path"], r["error"]) for r in files.zip_members(rows).collect()}
    assert got["good"] == ("a.py", None) and got["bad"][1].startswith("unreadable") and got["none"][1] == "no archive"


def test_nodes_that_are_shown(spark):
    symbols = spark.createDataFrame([("s1", "a.run", "method", "a.py")], "id string, qualified_name string, symbol_type string, file_path string")
    shown = graph.shown_nodes(spark.createDataFrame([("s1",), ("os.path",)], "id string"), symbols)
    assert sorted(map(tuple, shown.collect())) == [("os.path", "os.path", "external", ""), ("s1", "a.run", "method", "a.py")]


def test_collection_info(spark):
    r = catalog.collection_info(spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "vector array<double>")).first()
    assert (r["points"], r["least_dimensions"], r["dimensions"]) == (2, 1, 2)


def test_tables_are_created_once(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS made")
    try:
        create_tables(spark, "made")
        create_tables(spark, "made")
        assert {r["tableName"] for r in spark.sql("SHOW TABLES IN made").collect()} == set(TABLES) and "repository_id" in spark.table("made.symbols").columns
    finally:
        spark.sql("DROP DATABASE made CASCADE")


def test_graph_around_an_answer(spark):
    from lodestar.plans import search

    symbols = spark.createDataFrame([(f"s{i}", "function", f"name{i}", f"m.name{i}", "python", "a.py", 1, 2, None, "code") for i in range(8)], "id string, symbol_type string, symbol_name string, qualified_name string, language string, file_path string, start_line int, end_line int, documentation string, code string")
    edges = spark.createDataFrame([("s0", "s1", "CALLS"), ("s1", "s2", "CALLS"), ("s2", "s3", "CALLS"), ("s6", "s7", "CALLS")], "src string, dst string, relation_type string")
    found = search.retrieve(spark.createDataFrame([("q", "where is `name0`")], "query_id string, text string"), symbols, None, None, edges)
    nodes, kept = search.answer_graph(found, edges)
    assert sorted(map(tuple, nodes.collect())) == [("s0", 0), ("s1", 1), ("s2", 2)] and sorted((r["src"], r["dst"]) for r in kept.collect()) == [("s0", "s1"), ("s1", "s2")]
