"""What keeps jobs small in memory and work spread, with the same results."""

from pyspark.sql import functions as F

from tessera.functions import extract_rust
from tessera.functions.text import parse_query
from tessera.operators import graph, retrieve, traverse
from tessera.operators.resolve import resolve
from tessera.plans import queries
from tessera.sources import tree
from tessera.tables import SMALL, small_broadcasts, written

FILES = "path string, lang string, content string"
RUST = """mod a; // } not here
mod b;
#[cfg(x)]
pub struct S { x: u8 }
impl S {
    fn go(&self) { self.stop(); let s = "}"; let c = '}'; }
    fn stop(&self) {}
}
/* }
; */
const A: [u8; 2] = [1, 2];
use crate::a::{f as g,
    h};
fn run<'a>(x: &'a str) { g(); }
) macro_rules! m { (x) => { y } }
mod c;
"""


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_resolved_tables_hold_no_joins(spark):
    """each group of languages is resolved into tables of its own, so no plan grows with the number of languages or rounds."""
    rows = [("a.ts", "js", "export function f() {}\n"), ("b.ts", "js", "import { f } from './a';\nexport function run() { f(); }\n"), ("p/a.py", "python", "def f():\n    f()\n"), ("src/lib.rs", "rust", "fn f() { f(); }\n"), ("A.java", "java", "class A { void f() { f(); } }\n"), ("a/a.go", "go", "package a\n\nfunc f() { f() }\n")]
    r = resolve(written(tree.facts_of(spark.createDataFrame(rows, FILES)), "facts"), spark.createDataFrame([], "root string, module string"))
    for table in (r.sites, r.imports, r.structural, r.issues):
        assert "Join" not in plan(table) and "Aggregate" not in plan(table)
    assert r.sites.count() == 5 and r.imports.count() == 1


def test_broadcasts_are_small_and_the_setting_comes_back(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    bound = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold
    with small_broadcasts(spark):
        assert bound() <= SMALL
    assert spark.conf.get(key) == before


def test_pieces_read_as_the_whole(spark, monkeypatch):
    """a large Rust source is read in pieces, with the lines, columns and facts of the whole."""
    source = "".join(RUST.replace("mod ", f"mod m{i}").replace("struct S", f"struct S{i}").replace("run", f"run{i}") for i in range(20))
    assert len(list(extract_rust.pieces(source, 200))) > 20
    assert "".join(p for p, _, _ in extract_rust.pieces(source, 200)) == source
    whole = extract_rust.extract("src/lib.rs", source)
    for size in (1, 50, 200, 10**6):
        parts = [extract_rust.extract("src/lib.rs", p).moved(line, start) for p, line, start in extract_rust.pieces(source, size)]
        no_seq = lambda rows: [{k: v for k, v in r.items() if k != "seq"} for r in rows]
        for what in ("symbols", "calls", "imports", "bindings", "heritage"):
            assert no_seq(r for p in parts for r in getattr(p, what)) == no_seq(getattr(whole, what))
        seqs = [r["seq"] for p in parts for r in p.imports]
        assert len(set(seqs)) == len(seqs)
    monkeypatch.setattr(tree, "PIECE", 50)
    rows = [("src/lib.rs", "rust", "".join(f"mod m{i};\nuse crate::m{i}::f as f{i};\npub fn g{i}() {{ f{i}(); }}\n" for i in range(30)))] + [(f"src/m{i}.rs", "rust", "pub fn f() {}\n") for i in range(30)]
    files = spark.createDataFrame(rows, FILES)
    cut = written(tree.facts_of(files, spread=True), "facts")
    assert cut.where("path = 'src/lib.rs'").count() > 10
    one, many = resolve(written(tree.facts_of(files), "facts")), resolve(cut)
    for table in ("sites", "imports", "structural", "issues"):
        assert sorted(getattr(one, table).collect()) == sorted(getattr(many, table).collect())
    assert many.sites.count() == 30 and many.imports.count() == 30


def test_files_of_one_partition_are_read_by_many_tasks(spark):
    """a table of one split doesn't make extraction one task."""
    files = spark.createDataFrame([(f"s{i}.py", "python", "def f():\n    pass\n") for i in range(64)], FILES).coalesce(1)
    read = written(tree.facts_of(files, spread=True), "facts").inputFiles()
    assert len(read) > 8


def tables(spark, folder, lineitem, orders):
    """lineitem (order, part, supplier, number) and orders (order, customer) with empty tables of the others, as parquet."""
    kinds = {
        "lineitem": (lineitem, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
        "orders": (orders, "o_orderkey long, o_custkey long"),
        "customer": ([], "c_custkey long, c_nationkey int"),
        "supplier": ([], "s_suppkey long, s_nationkey int"),
        "nation": ([], "n_nationkey int, n_regionkey int"),
    }
    for name, (rows, schema) in kinds.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_edges_are_grouped_by_keys_and_once(spark, tmp_path):
    """first sites and pools of keys are those of names, with nulls and repeated rows; called pairs are not made distinct again."""
    lines = [(1, 1, 1, 2), (1, 1, 1, 1), (2, 1, 1, 1), (None, 1, 1, 1), (3, None, 2, 1), (None, None, 2, 3), (None, None, None, 4), (2, 1, 2, 5)]
    d = tables(spark, tmp_path, lines, [(1, 1), (2, 1), (None, 1), (None, None)])
    sites = queries.call_sites(spark, d)
    want = {(r["src"], r["dst"]): sorted({(x["line"] is not None, x["line"], x["column"]) for x in r["at"]}, key=str) for r in sites.groupBy("src", "dst").agg(F.collect_set(F.struct("line", "column")).alias("at")).collect()}
    got = queries._by_keys(spark, d, graph.calls_with_sites).collect()
    assert {(r["src"], r["dst"]): sorted({(x["line"] is not None, x["line"], x["column"]) for x in r["sites"]}, key=str) for r in got} == want and len(got) == len(want)
    first = queries._by_keys(spark, d, graph.first_sites).where("src is not null and dst is not null").collect()
    assert sorted(map(tuple, first)) == sorted((a, b, *min(x[1:] for x in at if x[0])) for (a, b), at in want.items() if a and b)
    edges = plan(queries.edges(spark, d))
    assert edges.count("Aggregate") == 5  # three kinds of calls, those with a null, the structural facts
    pool = spark.createDataFrame([("order::1",), ("part::1",)], "node string")
    assert plan(queries._inside(spark, d, pool)).count("Aggregate") == 2
    assert sorted(map(tuple, queries._inside(spark, d, pool).collect())) == [("order::1", "part::1", "CALLS", 1, 1)]
    place = [("a", "b", 3, -1), ("a", "b", 3, 2), ("a", "b", -4, 7), ("a", "c", -(2**31), 2**31 - 1), ("a", "c", -(2**31), -(2**31)), ("d", "c", 2**31 - 1, 2**31 - 1)]
    found = graph.first_sites(spark.createDataFrame(place, "src string, dst string, line int, column int")).collect()
    assert sorted(map(tuple, found)) == [("a", "b", -4, 7), ("a", "c", -(2**31), -(2**31)), ("d", "c", 2**31 - 1, 2**31 - 1)]


def test_walks_take_edges_as_they_come(spark, monkeypatch):
    """Steps of a walk aren't grouped; repeated edges and rings change nothing."""
    plans = {}

    def spy(df, tag):
        plans.setdefault(tag, plan(df))
        return written(df, tag)

    monkeypatch.setattr(traverse, "written", spy)
    edges = spark.createDataFrame([("b", "a"), ("b", "a"), ("c", "b"), ("a", "c"), ("d", "a"), ("d", "b"), ("x", "y")], "src string, dst string")
    rows = traverse.impact(edges, spark.createDataFrame([("a",)], "node string"))
    assert sorted(map(tuple, rows.collect())) == [("b", 1), ("c", 2), ("d", 1)]
    assert "Aggregate" not in plans["impact-steps"]


def test_only_postings_of_the_query_are_written(spark, tmp_path):
    """what no term of the query matches isn't written; the evidence is that of all postings."""
    rows = [(i, f"Order {w} reaching things x{i}\nplain text", "en", "src/Find.py") for i, w in enumerate(["reach", "paths", "th", "orders", "unrelated"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    every, some = retrieve.postings(queries._facts(spark, str(tmp_path))), queries._posted(spark, str(tmp_path))
    query = parse_query(queries.QUERY)
    assert 0 < some.count() < every.count() and "plain" not in {r["term"] for r in some.select("term").collect()}
    assert sorted(map(str, retrieve.term_evidence(some, query).drop("fields").collect())) == sorted(map(str, retrieve.term_evidence(every, query).drop("fields").collect()))


def test_kept_and_full_facts_are_compared_in_one_pass(spark, tmp_path):
    """each document's terms are made once for the kept and once for the full facts."""
    rows = [(i, f"text {i}") for i in range(80)] + [(5, "text 5"), (10, "twice"), (11, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.incremental_equals_full(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [(0, "rows"), (80, "total")]
    assert plan(out).count("Generate") <= 1 and plan(out).count("Union") == 1
