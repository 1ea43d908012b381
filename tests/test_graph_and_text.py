import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import evidence
from tessera.functions.text import morphology, parse_query, strip_procedure, terms
from tessera.operators import graph, retrieve, traverse
from tessera.operators.unique import resolve_unique
from tessera.sources.git import hunk_fields
from tessera.streaming.incremental import changed_paths, same_files


def edges_of(spark, rows):
    return spark.createDataFrame([(a, b, "CALLS", k, 1) for k, (a, b) in enumerate(rows)], "src string, dst string, kind string, line int, column int")


def queue_walk(rows, roots, budget):
    """node -> (depth, via) as a queue gives them."""
    order = {}
    for k, (a, b) in enumerate(rows):
        order.setdefault(b, []).append((a, k))
    seen = dict.fromkeys(sorted(roots), (0, None))
    queue = sorted(roots)
    while queue:
        if len(seen) >= budget:
            break
        node = queue.pop(0)
        for a, _ in sorted(order.get(node, [])):
            if a not in seen:
                seen[a] = (seen[node][0] + 1, node)
                queue.append(a)
    return seen


@pytest.mark.parametrize("budget", [1, 3, 7, 20, 500])
def test_impact_within_budget_is_a_queue(spark, budget):
    rng = random.Random(budget)
    rows = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(90)]
    out, cut_short = traverse.impact_within_budget(edges_of(spark, rows), spark.createDataFrame([("n1",), ("n5",)], "node string"), budget)
    want = queue_walk(rows, {"n1", "n5"}, budget)
    assert {r["node"]: (r["depth"], r["via"]) for r in out.collect()} == {k: v for k, v in want.items() if v[0]}
    assert cut_short == (len(want) >= budget)


def test_trace(spark):
    rows = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("x", "y")]
    calls = edges_of(spark, rows)
    assert traverse.trace(calls, "a", "d") == ["a", "b", "d"]
    assert traverse.trace(calls, "a", "a") == ["a"]
    assert traverse.trace(calls, "a", "y") is None


def test_components_and_pool(spark):
    pool = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    inside = graph.pool_edges(edges_of(spark, [("a", "b"), ("b", "c"), ("d", "z")]), pool)
    got = {r["node"]: r["component"] for r in traverse.pool_components(inside, pool).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}


def test_unique_or_nothing(spark):
    refs = spark.createDataFrame([("one",), ("two",), ("none",), (None,)], "name string")
    found = spark.createDataFrame([("one", "t1"), ("one", "t1"), ("two", "t1"), ("two", "t2")], "name string, target string")
    got = {r["name"]: (r["target"], r["status"]) for r in resolve_unique(refs, found, ["name"]).collect()}
    assert got == {"one": ("t1", "EDGE"), "two": (None, "AMBIGUOUS"), "none": (None, "UNRESOLVED"), None: (None, "UNRESOLVED")}


def test_terms_agree(spark):
    texts = ["fooBar baz_qux", "HTTPServer get the x", "", "naïve Été2go", "a1B2 parseURLPath"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(terms(F.col("t")).alias("w"))
    assert [r["w"] for r in rows.collect()] == [evidence.terms(t) for t in texts]


def test_query_words():
    assert morphology("stories") == {"story"} and morphology("running") == {"runn", "runne", "run"} and morphology("class") == set()
    assert strip_procedure("Without running tests, find the router. Do not use network").strip() == "find the router."
    q = parse_query("Without reading, explain how requests reaches handlers")
    assert [t for t, _ in q.terms] == ["handlers", "reaches", "requests"] and q.flow_intent and not q.test_intent
    assert parse_query("do not run tests").terms == []


def test_find_order(spark):
    names = ["matchRoute", "dispatchHandler", "retryBackoff", "routeTable"]
    symbols = spark.createDataFrame([(f"src/r.ts::{n}", n, "src/r.ts", "function") for n in names] + [("tests/r.test.ts::matchRouteTest", "matchRouteTest", "tests/r.test.ts", "function")], "canonical string, name string, path string, kind string")
    rows = [(r["canonical"], evidence.terms(r["name"]), evidence.terms(r["path"]), [], [], [], evidence.terms(r["name"]), []) for r in symbols.collect()]
    facts = spark.createDataFrame(rows, "canonical string, identifier array<string>, path array<string>, declaration array<string>, comments array<string>, strings array<string>, body array<string>, test array<string>")
    edges = edges_of(spark, [("src/r.ts::matchRoute", "src/r.ts::dispatchHandler")])
    posted = retrieve.postings(facts)
    got = [r["name"] for r in retrieve.ranked(symbols, posted, edges, "match a route").orderBy(*retrieve.best_first()).collect()]
    assert got[0] == "matchRoute" and got.index("matchRouteTest") > 0 and "retryBackoff" not in got
    exact = retrieve.ranked(symbols, posted, edges, "routeTable").orderBy(*retrieve.best_first()).first()
    assert exact["name"] == "routeTable" and exact["lexical"] > retrieve.EXACT
    assert retrieve.ranked(symbols, posted, edges, "").count() == 5


def test_snapshots(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "path string, sha string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "path string, sha string")
    assert {tuple(r) for r in changed_paths(a, b).collect()} == {("y", "modified"), ("z", "deleted"), ("w", "added")}
    assert same_files(a, a) and not same_files(a, b)


def test_hunk_header(spark):
    row = spark.createDataFrame([("@@ -4,2 +3,0 @@",)], "h string").select(*hunk_fields(F.col("h"))).first()
    assert tuple(row) == (4, 2, 3, 0)


def test_evidence_kinds():
    code, comments, strings = evidence.split_kinds('a(); // one two\n/* three */ b("four \\" five") # six\n"""seven"""')
    assert "a();" in code and "b(" in code and comments.split() == ["one", "two", "three", "six", "seven"] and strings.split() == ["four", '\\"', "five"]
