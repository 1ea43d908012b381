"""Queries of the engine's own operators over the driver's tables, each with SQL for the same rows.

The tables have no source code, so a dependency graph and search facts are read out of them: node keys are
`table::id`; orders call their parts and customer, parts their suppliers; customers and nations extend,
suppliers implement. Documents are symbols, with terms from their words.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import NON_PRODUCTION, STOP, morphology, non_production, parse_query, terms
from ..operators import graph, retrieve, traverse
from ..operators.unique import resolve_unique
from ..tables import written
from . import trees


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _key(table: str, column: str):
    return F.concat(F.lit(f"{table}::"), F.col(column).cast("string"))


_STOPS = ", ".join(f"'{w}'" for w in STOP)


def _terms_sql(x: str) -> str:
    low = f"lower(regexp_replace({x}, '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'))"
    return f"list_filter(list_sort(list_distinct(regexp_split_to_array({low}, '[^\\p{{L}}\\p{{N}}]+'))), lambda w: strlen(w) >= 2 and w not in ({_STOPS}))"


_TERMS_OF_NAME = _terms_sql("name")


# --- the graph ---------------------------------------------------------------------------------------------


def _calls(spark: SparkSession, d: str) -> list[tuple[str, str, DataFrame]]:
    """(table of src, table of dst, src, dst, line, column of every call, by their keys)."""
    line = _t(spark, d, "lineitem")
    at = [F.col("l_orderkey").cast("int").alias("line"), F.col("l_linenumber").cast("int").alias("column")]
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"), F.col("o_orderkey").cast("int").alias("line"), F.lit(0).alias("column"))
    return [
        ("order", "part", line.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), *at)),
        ("part", "supplier", line.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), *at)),
        ("order", "customer", orders),
    ]


def _named(a: str, b: str, rows: DataFrame) -> DataFrame:
    return rows.withColumns({"src": _key(a, "src"), "dst": _key(b, "dst")})


def call_sites(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, line, column of every call."""
    return reduce(DataFrame.unionByName, (_named(*part) for part in _calls(spark, d)))


def _by_keys(spark: SparkSession, d: str, grouped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """grouped(call_sites), which groups by src and dst: the keys are grouped before they are named, as numbers move and sort cheaper.

    Pairs of two tables never meet, except those with a null: these are named first.
    """
    known = F.col("src").isNotNull() & F.col("dst").isNotNull()
    parts = _calls(spark, d)
    rows = reduce(DataFrame.unionByName, (_named(a, b, grouped(part.where(known))) for a, b, part in parts))
    return rows.unionByName(grouped(reduce(DataFrame.unionByName, (_named(a, b, part.where(~known)) for a, b, part in parts))))


def structural(spark: SparkSession, d: str) -> DataFrame:
    def rows(table: str, src: str, key: str, dst: str, ref: str, kind: str) -> DataFrame:
        return _t(spark, d, table).select(_key(src, key).alias("src"), _key(dst, ref).alias("dst"), F.lit(kind).alias("kind"), F.col(key).cast("int").alias("line"), F.lit(0).alias("column"))

    out = rows("customer", "customer", "c_custkey", "nation", "c_nationkey", "EXTENDS")
    out = out.unionByName(rows("nation", "nation", "n_nationkey", "region", "n_regionkey", "EXTENDS"))
    return out.unionByName(rows("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "IMPLEMENTS"))


def links(spark: SparkSession, d: str) -> DataFrame:
    """src, dst of every edge, as often as it is called: for walks, which need neither sites nor grouping."""
    return call_sites(spark, d).select("src", "dst").unionByName(structural(spark, d).select("src", "dst"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.with_structural(_by_keys(spark, d, graph.first_sites), structural(spark, d))


SITES = """sites as (
    select 'order::' || l_orderkey as src, 'part::' || l_partkey as dst, l_orderkey::int as line, l_linenumber::int as col from lineitem
    union all select 'part::' || l_partkey, 'supplier::' || l_suppkey, l_orderkey::int, l_linenumber::int from lineitem
    union all select 'order::' || o_orderkey, 'customer::' || o_custkey, o_orderkey::int, 0 from orders
)"""
FACTS = """structural as (
    select 'customer::' || c_custkey as src, 'nation::' || c_nationkey as dst, 'EXTENDS' as kind, c_custkey::int as line, 0 as col from customer
    union all select 'nation::' || n_nationkey, 'region::' || n_regionkey, 'EXTENDS', n_nationkey::int, 0 from nation
    union all select 'supplier::' || s_suppkey, 'nation::' || s_nationkey, 'IMPLEMENTS', s_suppkey::int, 0 from supplier
)"""
EDGES = f"""{SITES}, {FACTS}, edges as (
    select src, dst, 'CALLS' as kind, min(line * 100 + col) // 100 as line, min(line * 100 + col) % 100 as col from sites group by src, dst
    union select src, dst, kind, line, col from structural
)"""


def materialize_calls(spark, d):
    out = _by_keys(spark, d, graph.calls_with_sites)
    return out.select("src", "dst", F.array_join(F.transform("sites", lambda s: F.concat_ws(":", s["line"], s["column"])), ",").alias("sites"), F.size("sites").cast("long").alias("n_sites"))


MATERIALIZE_CALLS = f"""with {SITES}, u as (select distinct * from sites)
select src, dst, string_agg(line || ':' || col, ',' order by line, col) as sites, count(*) as n_sites from u group by src, dst"""


def call_sites_min(spark, d):
    return _by_keys(spark, d, graph.first_sites)


CALL_SITES_MIN = f"""with {SITES} select src, dst, (min(line * 100 + col) // 100)::int as line, (min(line * 100 + col) % 100)::int as "column" from sites group by src, dst"""


def dependencies_union(spark, d):
    return edges(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"), F.sum(F.col("line").cast("long")).alias("line_sum"))


DEPENDENCIES_UNION = f"with {EDGES} select kind, count(*) as n, count(distinct src) as sources, sum(line)::bigint as line_sum from edges group by kind"


def impact_depth(spark, d):
    """All that depends on region 0, by depth, without a budget."""
    root = spark.createDataFrame([("region::0",)], "node string")
    return traverse.impact(links(spark, d), root).select("node", "depth")


IMPACT_DEPTH = f"""with recursive {EDGES}, reach as (
    select 'region::0' as node, 0 as depth
    union
    select e.src, r.depth + 1 from reach r join (select distinct src, dst from edges) e on e.dst = r.node
) select node, min(depth)::int as depth from reach where depth > 0 group by node"""


def impact_by_depth(spark, d):
    """Number of nodes of each table at each depth from region 1."""
    root = spark.createDataFrame([("region::1",)], "node string")
    rows = traverse.impact(links(spark, d), root)
    return rows.groupBy("depth", F.substring_index("node", "::", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


IMPACT_BY_DEPTH = f"""with recursive {EDGES}, reach as (
    select 'region::1' as node, 0 as depth
    union
    select e.src, r.depth + 1 from reach r join (select distinct src, dst from edges) e on e.dst = r.node
), least as (select node, min(depth)::int as depth from reach where depth > 0 group by node)
select depth, split_part(node, '::', 1) as kind, count(*) as n from least group by 1, 2"""


def impact_budget(spark, d):
    rows, _ = traverse.impact_within_budget(edges(spark, d), spark.createDataFrame([("region::0",)], "node string"))
    return rows.select("node", "depth", "via", "kind")


def _budget_sql(levels: int = 6, budget: int = 500) -> str:
    """The walk written out level by level: children of nodes in their turns, the first edge admits, parents after the budget don't expand."""
    out = [f"with {EDGES}, k(kind, rank) as (values ('CALLS', 1), ('EXTENDS', 2), ('IMPLEMENTS', 3)), f0 as (select 'region::0' as node, 0 as depth, null as via, null as kind, 1::bigint as turn), seen0 as (select node from f0)"]
    for n in range(1, levels + 1):
        out.append(f"""ch{n} as (
    select e.src as node, f.turn as pt, e.dst as via, e.kind, row_number() over (partition by e.src order by f.turn, k.rank, e.line, e.col) as rk
    from f{n - 1} f join edges e on e.dst = f.node join k on k.kind = e.kind where e.src not in (select node from seen{n - 1})
), pp{n} as (select pt, count(*) as n from ch{n} where rk = 1 group by pt),
op{n} as (select pt from (select pt, coalesce(sum(n) over (order by pt rows between unbounded preceding and 1 preceding), 0) as b from pp{n}) where b + (select count(*) from seen{n - 1}) < {budget}),
f{n} as (select node, {n} as depth, via, kind, row_number() over (order by pt, node) as turn from ch{n} where rk = 1 and pt in (select pt from op{n})),
seen{n} as (select node from seen{n - 1} union all select node from f{n})""")
    return ", ".join(out) + " " + " union all ".join(f"select node, depth, via, kind from f{n}" for n in range(1, levels + 1))


IMPACT_BUDGET = _budget_sql()


def trace_path(spark, d):
    """A call path from an order to a supplier of one of its parts: its hops."""
    calls = call_sites(spark, d).select("src", "dst").distinct()
    first = calls.where("dst like 'supplier::%'").agg(F.min(F.struct("dst", "src")).alias("e")).first()["e"]
    start = calls.where(F.col("dst") == first["src"]).agg(F.min("src")).first()[0]
    path = traverse.trace(calls, start, first["dst"]) or []
    return spark.createDataFrame([(start, first["dst"], len(path) - 1)], "start string, finish string, hops int")


TRACE_PATH = f"""with recursive {SITES}, calls as (select distinct src, dst from sites),
ends as (select src as p, dst as s from calls where dst like 'supplier::%' order by dst, src limit 1),
begin as (select min(c.src) as o from calls c join ends e on c.dst = e.p),
reach as (select o as node, 0 as depth from begin union select c.dst, r.depth + 1 from reach r join calls c on c.src = r.node where r.depth < 6)
select (select o from begin) as start, (select s from ends) as finish, min(depth)::int as hops from reach where node = (select s from ends)"""


def importer_closure(spark, d):
    """Everything that reaches nation 3 or nation 7, and the two."""
    roots = spark.createDataFrame([("nation::3",), ("nation::7",)], "node string")
    return traverse.closure(links(spark, d), roots)


IMPORTER_CLOSURE = f"""with recursive {EDGES}, reach as (
    select unnest(['nation::3', 'nation::7']) as node union select e.src from reach r join edges e on e.dst = r.node
) select distinct node from reach"""


def _pool(spark, d):
    """64 nodes: those with most dependents among their kind, the kinds taking turns; ties by name."""
    # edges are counted without their sites
    called = _by_keys(spark, d, lambda sites: sites.select("src", "dst").distinct()).select("dst")
    dst = called.unionByName(structural(spark, d).distinct().select("dst"))
    many = dst.groupBy(F.col("dst").alias("canonical")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy(F.substring_index("canonical", "::", 1)).orderBy(F.desc("n"), "canonical"))
    # none of a kind after its first 64 can be in the pool, so no task sorts a whole kind
    ranked = many.withColumn("rank", rank).where(F.col("rank") <= retrieve.POOL)
    return written(retrieve.top_pool(ranked.withColumn("turn", 1 / F.col("rank")), "turn").select(F.col("canonical").alias("node")), "pool")


def _inside(spark: SparkSession, d: str, pool: DataFrame) -> DataFrame:
    """The edges with both ends in the pool: only their sites are grouped, not all."""
    return graph.dependencies(graph.pool_edges(call_sites(spark, d), pool), graph.pool_edges(structural(spark, d), pool))


POOL = """pool as (
    select node from (select dst as node, row_number() over (partition by split_part(dst, '::', 1) order by count(*) desc, dst) as rk from edges group by dst) order by rk, node limit 64
)"""


def semi_pool_edges(spark, d):
    return _inside(spark, d, _pool(spark, d)).select("src", "dst", "kind")


SEMI_POOL_EDGES = f"with {EDGES}, {POOL} select src, dst, kind from edges where src in (select node from pool) and dst in (select node from pool)"


def components_pool(spark, d):
    pool = _pool(spark, d)
    return traverse.pool_components(_inside(spark, d, pool), pool)


COMPONENTS_POOL = f"""with recursive {EDGES}, {POOL}, inside as (select src, dst from edges where src in (select node from pool) and dst in (select node from pool)),
both_ways as (select src as a, dst as b from inside union select dst, src from inside),
reach as (select node, node as low from pool union select x.b, r.low from reach r join both_ways x on x.a = r.node)
select node, min(low) as component from reach group by node"""


def two_hop_sums(spark, d):
    pool = _pool(spark, d).withColumn("s", F.length("node") / 16.0)
    out = traverse.two_hop_sums(_inside(spark, d, pool.select("node")), pool.select("node", "s"))
    return out.select("node", F.round("direct", 6).alias("direct"), F.round("two_hop", 6).alias("two_hop"))


TWO_HOP_SUMS = f"""with {EDGES}, {POOL}, s as (select node, length(node) / 16.0::double as s from pool),
inside as (select src, dst from edges where src in (select node from pool) and dst in (select node from pool)),
w as (select src as a, dst as b from inside union all select dst, src from inside),
direct as (select a, sum(s) as v from w join s on s.node = w.b group by a),
two as (select x.a, sum(s) as v from w x join w y on x.b = y.a and x.a <> y.b join s on s.node = y.b group by x.a)
select s.node, round(coalesce(direct.v, 0), 6)::double as direct, round(coalesce(two.v, 0), 6)::double as two_hop from s left join direct on direct.a = s.node left join two on two.a = s.node"""


def anti_visited(spark, d):
    """Suppliers that no part of region 0's customers' orders needs: frontier minus what was seen."""
    root = spark.createDataFrame([("region::0",)], "node string")
    near = traverse.impact(links(spark, d), root, max_depth=2)
    every = _t(spark, d, "supplier").select(_key("supplier", "s_suppkey").alias("node"))
    return every.join(near.select("node"), "node", "left_anti")


ANTI_VISITED = """select 'supplier::' || s_suppkey as node from supplier where not exists (
    select 1 from nation where n_nationkey = s_nationkey and n_regionkey = 0)"""


# --- resolution --------------------------------------------------------------------------------------------


def unique_resolution(spark, d):
    """References by name to parts and customers: an edge where just one has the name."""
    names = _t(spark, d, "part").select(F.col("p_name").alias("name")).union(_t(spark, d, "customer").select("c_name")).union(_t(spark, d, "supplier").select("s_name")).distinct()
    found = _t(spark, d, "part").select(F.col("p_name").alias("name"), _key("part", "p_partkey").alias("target"))
    found = found.unionByName(_t(spark, d, "customer").select(F.col("c_name").alias("name"), _key("customer", "c_custkey").alias("target"))).distinct()
    return resolve_unique(names, found, ["name"])


UNIQUE_RESOLUTION = """with names as (select p_name as name from part union select c_name from customer union select s_name from supplier),
found as (select p_name as name, 'part::' || p_partkey as target from part union select c_name, 'customer::' || c_custkey from customer),
n as (select names.name, count(distinct target) as n_targets, min(target) as t from names left join found using (name) group by names.name)
select name, n_targets, case when n_targets = 1 then t end as target, case n_targets when 0 then 'UNRESOLVED' when 1 then 'EDGE' else 'AMBIGUOUS' end as status from n"""


def endpoint_join(spark, d):
    """Edges to parts and customers by name, where the name stands for one of them only."""
    symbols = _t(spark, d, "part").select(F.col("p_name").alias("canonical")).unionAll(_t(spark, d, "customer").select("c_name"))
    unique = graph.unique_symbols(symbols)
    to_part = _t(spark, d, "lineitem").join(_t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_name").alias("dst"))
    to_customer = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("dst"))
    rows = to_part.unionAll(to_customer).join(unique.select(F.col("canonical").alias("dst")), "dst", "left_semi")
    return rows.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


ENDPOINT_JOIN = """with s as (select p_name as name from part union all select c_name from customer), u as (select name from s group by name having count(*) = 1),
e as (select p_name as dst from lineitem join part on l_partkey = p_partkey union all select c_name from orders join customer on o_custkey = c_custkey)
select dst, count(*) as n from e where dst in (select name from u) group by dst"""


def narrowest_span(spark, d):
    """Line numbers of every order against the spans of its items; the narrowest that holds one wins."""
    from ..engine import narrowest

    items = _t(spark, d, "lineitem").select(F.concat(F.lit("order"), "l_orderkey").alias("path"), F.col("l_linenumber").alias("changed")).distinct()
    ends = items.groupBy("path").agg(F.min("changed").alias("lo"), F.max("changed").alias("hi"))
    span = lambda name, lo, hi: ends.select("path", F.concat("path", F.lit(f"::{name}")).alias("canonical"), lo.alias("line"), hi.alias("end_line"))
    spans = span("outer", F.col("lo"), F.col("hi")).unionByName(span("inner", F.col("lo") + 1, F.col("hi") - 1)).where("line <= end_line")
    return narrowest(items.withColumn("hunk", F.col("changed").cast("long")), spans)


NARROWEST_SPAN = """with items as (select distinct 'order' || l_orderkey as path, l_linenumber as changed from lineitem),
ends as (select path, min(changed) as lo, max(changed) as hi from items group by path)
select changed::bigint as hunk, path, path || case when changed > lo and changed < hi then '::inner' else '::outer' end as canonical from items join ends using (path)"""


def likely_tests(spark, d):
    """Parts as symbols, some in test folders, some marked as tests: those that may test the first plain one."""
    from ..functions import evidence

    part = _t(spark, d, "part").select(_key("part", "p_partkey").alias("canonical"), "p_name", "p_size", "p_brand", "p_partkey")
    folder = F.when(F.col("p_size") % 5 == 0, F.lit("tests/")).otherwise(F.lit("src/"))
    name = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("test_"), F.replace("p_name", F.lit(" "), F.lit("_")))).otherwise(F.replace("p_name", F.lit(" "), F.lit("_")))
    symbols = part.select("canonical", name.alias("name"), F.concat(folder, F.replace("p_brand", F.lit(" "), F.lit("_"))).alias("path"), "p_size", "p_partkey")
    search = symbols.select("canonical", terms(F.col("name")).alias("identifier"), F.when(F.col("p_size") % 7 == 0, terms(F.col("name"))).otherwise(F.array().cast("array<string>")).alias("test"))
    line = _t(spark, d, "lineitem")
    sites = line.select(_key("part", "l_partkey").alias("src"), _key("part", "l_suppkey").alias("dst"))
    target = symbols.where("p_size % 5 <> 0 and p_size % 7 <> 0").orderBy("p_partkey").select("canonical", "name").first()
    return retrieve.likely_tests(symbols, search, sites, target["canonical"], evidence.terms(target["name"]))


LIKELY_TESTS = f"""with p as (
    select p_partkey, 'part::' || p_partkey as canonical, case when p_size % 7 = 0 then 'test_' else '' end || replace(p_name, ' ', '_') as name,
        case when p_size % 5 = 0 then 'tests/' else 'src/' end || replace(p_brand, ' ', '_') as path, p_size % 5 = 0 or p_size % 7 = 0 as is_test from part
), t as (select * from p where not is_test order by p_partkey limit 1),
near as (select distinct l_suppkey as other from lineitem, t where l_partkey = t.p_partkey union select distinct l_partkey from lineitem, t where l_suppkey = t.p_partkey),
words as (select canonical, unnest({_TERMS_OF_NAME}) as term from p),
shared as (select w.canonical, count(*) as k from words w join words o on o.term = w.term and o.canonical = (select canonical from t) group by 1),
scored as (select p.canonical, case when p.path = t.path then 100 else 0 end + case when p.p_partkey in (select other from near) then 300 else 0 end + 25 * least(4, coalesce(k, 0)) as score
    from p cross join t left join shared on shared.canonical = p.canonical where p.is_test)
select canonical, score::int as score from scored where score >= 50"""


# --- text and retrieval ------------------------------------------------------------------------------------

QUERY = "find the thing that reaches an order of thtion"


def _symbols(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select(
        F.concat(F.lit("doc::"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("canonical"),
        F.coalesce(F.regexp_extract("text", r"[\p{L}\p{N}]+", 0), F.lit("")).alias("name"),
        F.coalesce("source", F.lit("")).alias("path"),
        F.lit("function").alias("kind"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("lang", F.lit("")).alias("lang"),
    )


def _facts(spark, d) -> DataFrame:
    s = _symbols(spark, d)
    none = F.array().cast("array<string>")
    return s.select("canonical", terms(F.col("name")).alias("identifier"), terms(F.col("path")).alias("path"), terms(F.split("text", "\n")[0]).alias("declaration"), terms(F.col("lang")).alias("comments"), none.alias("strings"), terms(F.col("text")).alias("body"), none.alias("test"))


def _posted(spark, d) -> DataFrame:
    """The postings of QUERY's terms; those of all others aren't written."""
    return written(retrieve.matching(retrieve.postings(_facts(spark, d)), parse_query(QUERY)), "postings")


DOCS = f"""s as (
    select 'doc::' || lpad(doc_id::varchar, 9, '0') as canonical, coalesce(regexp_extract(text, '[\\p{{L}}\\p{{N}}]+'), '') as name, coalesce(source, '') as path,
        coalesce(text, '') as text, coalesce(lang, '') as lang from documents
), facts as (
    select canonical, 'identifier' as field, unnest({_terms_sql('name')}) as term from s
    union all select canonical, 'path', unnest({_terms_sql('path')}) from s
    union all select canonical, 'declaration', unnest({_terms_sql("split_part(text, chr(10), 1)")}) from s
    union all select canonical, 'comments', unnest({_terms_sql('lang')}) from s
    union all select canonical, 'body', unnest({_terms_sql('text')}) from s
)"""


def tokenize_terms(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", "turn", terms(F.coalesce("text", F.lit(""))).alias("t"))
    return rows.select("conv_id", "turn", F.array_join("t", " ").alias("terms"), F.size("t").cast("long").alias("n"))


TOKENIZE_TERMS = f"""with x as (select conv_id, turn, {_terms_sql("coalesce(text, '')")} as t from conversations)
select conv_id, turn, coalesce(array_to_string(t, ' '), '') as terms, len(t)::bigint as n from x"""

def morphology_query(spark, d):
    """Other forms of every distinct term of the conversations."""

    def each(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([",".join(sorted(morphology(w))) for w in b.column(0).to_pylist()], pa.string())], ["token", "variants"])

    found = _t(spark, d, "conversations").select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("token")).distinct()
    return found.mapInArrow(each, "token string, variants string")


MORPHOLOGY = f"""with t as (select distinct unnest({_terms_sql("coalesce(text, '')")}) as token from conversations), n as (select token, strlen(token) as n, left(token, -3) as b3, left(token, -2) as b2 from t),
v as (
    select token, case when n > 5 and token like '%ies' then b3 || 'y' when n > 5 and token like '%es' then b2 when n > 4 and token like '%s' and token not like '%ss' then left(token, -1) end as v from n
    union select token, unnest([b3, b3 || 'e']) from n where n > 5 and token like '%ing'
    union select token, left(b3, -1) from n where n > 5 and token like '%ing' and length(b3) > 2 and right(b3, 1) = substr(right(b3, 2), 1, 1)
    union select token, unnest([b2, b2 || 'e']) from n where n > 4 and token like '%ed'
    union select token, b3 from n where n > 6 and (token like '%tion' or token like '%sion')
) select t.token, coalesce(string_agg(v, ',' order by v) filter (v is not null and strlen(v) >= 3 and v <> t.token), '') as variants from t left join v on v.token = t.token group by t.token"""

# QUERY by hand: its words less the stop words, with the forms that their endings give; "reaches" asks for flow
_TERMS = "('find', []::varchar[]), ('order', []), ('reaches', ['reach']), ('that', []), ('thing', []), ('thtion', [])"
_RANKING = f"""q as (select * from (values {_TERMS}) as q(t, vs)), vocab as (select distinct term from facts),
matched as (
    select term, t, case when term = t then 1.0 when strlen(t) >= 4 and (starts_with(term, t) or starts_with(t, term)) then 0.82
        when len(list_filter(vs, lambda v: term = v or (strlen(v) >= 4 and (starts_with(term, v) or starts_with(v, term))))) > 0 then 0.62 else 0.0 end::double as ql from vocab, q
), hits as (select canonical, t, field, max(ql) as ql from facts join matched using (term) where ql > 0 group by all),
w(field, wt, cv) as (values ('identifier', 3.5::double, 1.0::double), ('path', 2.2, 1.0), ('declaration', 1.7, 0.8), ('test', 0.9, 0.5), ('comments', 0.8, 0.45), ('strings', 0.65, 0.35), ('body', 0.25, 0.18)),
ev as (select canonical, t, max(wt * ql) as best, max(cv * ql) as cover, count(*) as k from hits join w using (field) group by all),
df as (select t, count(*) as df from ev group by t), total as (select count(*) as n from s),
per as (select canonical, sum(least(8.0, least(3.0, ln((n - df + 0.5) / (df + 0.5) + 1)) * (best + least(0.36, 0.12 * (k - 1))))) as contribution, sum(cover) / 6 as coverage, count(*) as matched
    from ev join df using (t), total group by canonical),
lex as (select canonical, path, name, matched, coverage, contribution / matched * (0.35 + 0.65 * coverage) + 12.0 * coverage * coverage + 0.7 as lexical
    from per join s using (canonical) where matched >= 2)"""


def query_terms(spark, d):
    """What every turn of a conversation would ask for as a query: its terms and intents."""

    def each(batches):
        import pyarrow as pa

        for b in batches:
            asked = [parse_query(t or "") for t in b.column(2).to_pylist()]
            cols = [pa.array([" ".join(t for t, _ in q.terms) for q in asked], pa.string()), pa.array([q.test_intent for q in asked]), pa.array([q.flow_intent for q in asked])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["conv_id", "turn", "terms", "test_intent", "flow_intent"])

    rows = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(each, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, terms string, test_intent boolean, flow_intent boolean")


QUERY_TERMS = r"""with clauses as (
    select conv_id, turn, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[^.;\n]*[.;\n]|[^.;\n]+'), lambda c: trim(c, ' ' || chr(9) || chr(10) || chr(13))) as cs from conversations
), kept as (
    select conv_id, turn, array_to_string(list_filter(list_transform(cs, lambda c: case
        when not (starts_with(c, 'without ') or starts_with(c, 'do not ') or starts_with(c, 'don''t ') or starts_with(c, 'stop once ')) then c
        when contains(c, ',') then substr(c, instr(c, ',') + 1) end), lambda c: c is not null), ' ') as text from clauses
), words as (select *, coalesce(regexp_extract_all(text, '[\p{L}\p{N}_]+'), []) as w from kept)
select conv_id, turn, coalesce(array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform(w, lambda x: string_split(x, '_'))), lambda t: strlen(t) >= 2 and t not in (
        'a', 'an', 'the', 'and', 'or', 'with', 'to', 'on', 'in', 'from', 'by', 'at', 'of', 'for', 'where', 'when', 'how', 'what', 'is', 'are', 'be', 'it', 'does', 'do', 'get', 'gets',
        'explain', 'identify', 'main', 'code', 'repository', 'enough', 'once')))), ' '), '') as terms,
    len(list_filter(w, lambda x: x in ('test', 'tests', 'spec', 'specs', 'fixture', 'fixtures'))) > 0 as test_intent,
    contains(text, 'flow') or contains(text, 'incoming') or contains(text, 'path') or contains(text, 'reaches') or contains(text, 'through') as flow_intent
from words"""


def doc_frequency(spark, d):
    ev = retrieve.term_evidence(_posted(spark, d), parse_query(QUERY))
    return ev.groupBy(F.col("qterm").alias("term")).agg(F.count(F.lit(1)).alias("df"))


DOC_FREQUENCY = f"with {DOCS}, {_RANKING} select t as term, df from df"


def lexical_score(spark, d):
    rows = retrieve.lexical(_symbols(spark, d), _posted(spark, d), QUERY)
    return rows.select("canonical", "matched", F.round("coverage", 6).alias("coverage"), F.round("lexical", 6).alias("lexical"))


LEXICAL_SCORE = f"with {DOCS}, {_RANKING} select canonical, matched, round(coverage, 6) as coverage, round(lexical, 6) as lexical from lex"


def rank_topk(spark, d):
    rows = retrieve.lexical(_symbols(spark, d), _posted(spark, d), QUERY).withColumn("lexical", F.round("lexical", 6))
    top = rows.orderBy(F.desc("lexical"), F.desc("matched"), "canonical").limit(retrieve.SHOWN)
    return top.select("canonical", "lexical", F.row_number().over(W.orderBy(F.desc("lexical"), F.desc("matched"), "canonical")).alias("rank"))


RANK_TOPK = f"""with {DOCS}, {_RANKING}, r as (select canonical, round(lexical, 6) as lexical, (row_number() over (order by round(lexical, 6) desc, matched desc, canonical))::int as rank from lex)
select * from r where rank <= 20"""


def file_area_rerank(spark, d):
    rows = retrieve.lexical(_symbols(spark, d), _posted(spark, d), QUERY).withColumn("score", F.round("lexical", 6))
    return retrieve.file_area(retrieve.top_pool(rows, "score")).select("canonical", F.round("area", 6).alias("area"))


FILE_AREA_RERANK = f"""with {DOCS}, {_RANKING}, pool as (select canonical, path, coverage, round(lexical, 6) as score from lex order by round(lexical, 6) desc, canonical limit 64),
v as (select *, greatest(score, 0) * greatest(coverage, 0.25) as worth from pool), r as (select *, row_number() over (partition by path order by worth desc, canonical) as rk from v),
f as (select path, max(worth) as best, coalesce(sum(worth) filter (rk in (2, 3)), 0) as support from r group by path)
select canonical, round(least(0.75, 0.35 * support / greatest(1.0, best)), 6) as area from pool join f using (path)"""


def runner_up_confidence(spark, d):
    """Whether the first two results call for a warning, without any confirmed edge."""
    rows = retrieve.lexical(_symbols(spark, d), _posted(spark, d), QUERY).withColumn("score", F.round("lexical", 6)).withColumn("structural", F.lit(0.0))
    first = rows.orderBy(*retrieve.best_first()).limit(2).collect()
    limited = [(first[0]["canonical"], retrieve.limited_confidence(first))] if first else []
    return spark.createDataFrame(limited, "canonical string, limited boolean")


RUNNER_UP = f"""with {DOCS}, {_RANKING}, r as (select canonical, path, coverage, round(lexical, 6) as score, row_number() over o as rk, lead(round(lexical, 6)) over o as nxt, lead(path) over o as npath from lex
    window o as (order by round(lexical, 6) desc, matched desc, canonical))
select canonical, coalesce(nxt >= 0.88 * score and npath <> path, false) or coverage < 0.72 as limited from r where rk = 1"""


def nonproduction_paths(spark, d):
    p = _t(spark, d, "pages")
    return p.select("page_id", non_production(F.coalesce("url", F.lit(""))).alias("non_production"))


_NP = ", ".join(f"'{w}'" for w in NON_PRODUCTION)
NONPRODUCTION = f"""with u as (select page_id, lower(coalesce(url, '')) as u from pages)
select page_id, len(list_filter(string_split(u, '/'), lambda p: p in ({_NP}))) > 0 or contains(u, '.test.') or contains(u, '.test-') or contains(u, '.spec.') or ends_with(u, '_test.go') as non_production from u"""


# --- snapshots ---------------------------------------------------------------------------------------------


def _edited(docs: DataFrame) -> DataFrame:
    text = F.when(F.col("doc_id") % 10 == 0, F.concat(F.col("text"), F.lit("!"))).otherwise(F.col("text"))
    return docs.where("doc_id % 37 <> 0").withColumn("text", text)


def _snapshot(docs: DataFrame) -> DataFrame:
    return docs.select(_key("doc", "doc_id").alias("path"), F.sha2("text", 256).alias("sha"))


def snapshot_changes(spark, d):
    """added, modified and deleted paths between two snapshots."""
    from ..streaming.incremental import changed_paths

    docs = _t(spark, d, "documents")
    return changed_paths(_snapshot(docs), _snapshot(_edited(docs)))


SNAPSHOT_CHANGES = """select 'doc::' || doc_id as path, case when doc_id % 37 = 0 then 'deleted' else 'modified' end as change from documents where doc_id % 37 = 0 or (doc_id % 10 = 0 and text is not null)"""


def incremental_equals_full(spark, d):
    """Facts kept for unchanged paths and made anew for changed ones, against facts made anew for all."""
    from ..streaming.incremental import changed_paths, refresh_rows

    docs = _t(spark, d, "documents").select(_key("doc", "doc_id").alias("path"), "doc_id", "text")
    after = _edited(docs)
    facts = lambda x: x.select("path", terms(F.coalesce("text", F.lit(""))).alias("terms"))
    changes = written(changed_paths(docs.select("path", F.sha2("text", 256).alias("sha")), after.select("path", F.sha2("text", 256).alias("sha"))), "changes")
    kept = refresh_rows(facts(docs), changes, facts(after.join(changes.select("path"), "path", "left_semi")))
    full = facts(after)
    # what one side has more often than the other counts as often, in one pass over both
    both = kept.withColumn("side", F.lit(1)).unionByName(full.withColumn("side", F.lit(-1)))
    rows = both.groupBy("path", "terms").agg(F.abs(F.sum("side")).alias("more"), F.count_if(F.col("side") > 0).alias("kept"))
    zero = F.lit(0).cast("long")
    sums = rows.agg(F.coalesce(F.sum("more"), zero).alias("rows"), F.coalesce(F.sum("kept"), zero).alias("total"))
    return sums.select(F.inline(F.array(*(F.struct(F.col(c).alias("differences"), F.lit(c).alias("part")) for c in ("rows", "total")))))


INCREMENTAL = "select 0::bigint as differences, 'rows' as part union all select count(*), 'total' from documents where doc_id % 37 <> 0"

_HUNKS = [(1, "@@ -4,2 +3,0 @@"), (2, "@@ -1 +1 @@ fn"), (3, "@@ -10,3 +12,4 @@"), (4, "@@ -0,0 +1,3 @@")]


def hunk_headers(spark, d):
    from ..sources.git import hunk_fields

    rows = spark.createDataFrame(_HUNKS, "id int, header string")
    return rows.select("id", *hunk_fields(F.col("header")))


HUNK_HEADERS = f"""with h(id, header) as (values {', '.join(map(str, _HUNKS))}), p as (select id, regexp_extract(header, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@', ['a', 'b', 'c', 'd']) as x from h)
select id::int as id, x.a::int as old_start, coalesce(try_cast(x.b as int), 1) as old_count, x.c::int as new_start, coalesce(try_cast(x.d as int), 1) as new_count from p"""


# --- sources -----------------------------------------------------------------------------------------------
# A few sources of our own, with what is to be found in them: expectations by reading, not an independent oracle.

_SOURCES = {
    "web/api.ts": "import make, { fetchAll as all } from './data';\nimport type { Row } from './data';\n\nexport function list() {\n  all();\n  make();\n  unknown();\n}\n\nexport class Cache extends Base implements Row {\n  load() { this.fill(); }\n  fill() {}\n}\n\nclass Base {}\n",
    "web/data.ts": "export function fetchAll() {}\nexport default function make() { fetchAll(); }\nexport interface Row {}\n",
    "job/run.py": "from .steps import clean as c\n\n\ndef main():\n    c()\n    report()\n\n\ndef report():\n    print(1)\n",
    "job/steps.py": "def clean():\n    pass\n",
    "src/lib.rs": "mod util;\nuse crate::util::twice;\npub fn top() { twice(); }\n",
    "src/util.rs": "pub fn twice() { once(); once(); }\nfn once() {}\n",
    "srv/main.go": "package main\n\ntype S struct{}\n\nfunc (s *S) Run() { s.stop() }\nfunc (s *S) stop() {}\nfunc main() { start() }\nfunc start() {}\n",
    "lib/A.java": "package lib;\n\nclass A implements I {\n  void go() { step(); }\n  void step() {}\n}\n\ninterface I {}\n",
}


def _golden(spark):
    from ..operators.resolve import resolve
    from ..sources import tree

    rows = [(p, tree.language(p), t) for p, t in _SOURCES.items()]
    facts = written(tree.facts_of(spark.createDataFrame(rows, "path string, lang string, content string")), "golden")
    return facts, resolve(facts, spark.createDataFrame([], "root string, module string"))


def golden_symbols(spark, d):
    return _golden(spark)[0].select(F.inline("symbols")).select("canonical", "kind", "line", "end_line", "column")


GOLDEN_SYMBOLS = """select * from (values
    ('web/api.ts::list', 'function', 4, 8, 8), ('web/api.ts::Cache', 'class', 10, 13, 8), ('web/api.ts::Cache.load', 'method', 11, 11, 3), ('web/api.ts::Cache.fill', 'method', 12, 12, 3),
    ('web/api.ts::Base', 'class', 15, 15, 1), ('web/data.ts::fetchAll', 'function', 1, 1, 8), ('web/data.ts::make', 'function', 2, 2, 16), ('web/data.ts::Row', 'type', 3, 3, 8),
    ('job/run.py::main', 'function', 4, 6, 1), ('job/run.py::report', 'function', 9, 10, 1), ('job/steps.py::clean', 'function', 1, 2, 1),
    ('src/lib.rs::top', 'function', 3, 3, 1), ('src/util.rs::twice', 'function', 1, 1, 1), ('src/util.rs::once', 'function', 2, 2, 1),
    ('srv/main.go::S', 'type', 3, 3, 6), ('srv/main.go::S.Run', 'method', 5, 5, 1), ('srv/main.go::S.stop', 'method', 6, 6, 1), ('srv/main.go::main', 'function', 7, 7, 1), ('srv/main.go::start', 'function', 8, 8, 1),
    ('lib/A.java::A', 'class', 3, 6, 1), ('lib/A.java::A.go', 'method', 4, 4, 3), ('lib/A.java::A.step', 'method', 5, 5, 3), ('lib/A.java::I', 'type', 8, 8, 1)
) as t(canonical, kind, line, end_line, "column")"""


def golden_calls(spark, d):
    return _golden(spark)[1].sites.select("src", "dst", "line", "column")


GOLDEN_CALLS = """select * from (values
    ('web/api.ts::list', 'web/data.ts::fetchAll', 5, 3), ('web/api.ts::list', 'web/data.ts::make', 6, 3), ('web/api.ts::Cache.load', 'web/api.ts::Cache.fill', 11, 12), ('web/data.ts::make', 'web/data.ts::fetchAll', 2, 34),
    ('job/run.py::main', 'job/steps.py::clean', 5, 5), ('job/run.py::main', 'job/run.py::report', 6, 5), ('src/lib.rs::top', 'src/util.rs::twice', 3, 16), ('src/util.rs::twice', 'src/util.rs::once', 1, 18), ('src/util.rs::twice', 'src/util.rs::once', 1, 26),
    ('srv/main.go::S.Run', 'srv/main.go::S.stop', 5, 21), ('srv/main.go::main', 'srv/main.go::start', 7, 15), ('lib/A.java::A.go', 'lib/A.java::A.step', 4, 15)
) as t(src, dst, line, "column")"""


def golden_hierarchy(spark, d):
    return _golden(spark)[1].structural.select("src", "kind", "dst")


GOLDEN_HIERARCHY = "select * from (values ('web/api.ts::Cache', 'EXTENDS', 'web/api.ts::Base'), ('web/api.ts::Cache', 'IMPLEMENTS', 'web/data.ts::Row'), ('lib/A.java::A', 'IMPLEMENTS', 'lib/A.java::I')) as t(src, kind, dst)"


def golden_imports(spark, d):
    return _golden(spark)[1].imports


GOLDEN_IMPORTS = "select * from (values ('web/api.ts', 'web/data.ts'), ('job/run.py', 'job/steps.py'), ('src/lib.rs', 'src/util.rs')) as t(src, dst)"


def golden_issues(spark, d):
    return _golden(spark)[1].issues.select("status", "source", "name", "line")


GOLDEN_ISSUES = "select * from (values ('UNRESOLVED', 'web/api.ts', 'Row', 2), ('UNRESOLVED', 'web/api.ts::list', 'unknown', 7), ('UNRESOLVED', 'job/run.py::report', 'print', 10)) as t(status, source, name, line)"


_REQUESTS = [("web/a.ts", "./data"), ("web/a.ts", "./data.js"), ("web/a.ts", "../x/y.jsx"), ("web/a.ts", "../../out"), ("web/a.ts", "react"), ("job/p/run.py", ".steps"), ("job/p/run.py", "..lib.util"), ("job/p/run.py", "os")]


def module_candidates(spark, d):
    """Files that a relative module may mean, by tier."""
    from ..functions import extract_js, extract_python

    rows = []
    for path, module in _REQUESTS:
        found = extract_js.module_paths(path, module) if path.endswith(".ts") else [(0, p) for p in extract_python.module_paths(path, module)]
        rows += [(path, module, tier, p) for tier, p in found]
    return spark.createDataFrame(rows, "path string, module string, tier int, candidate string")


MODULE_CANDIDATES = """with e as (select unnest(['ts', 'tsx', 'js', 'jsx']) as e)
select 'web/a.ts' as path, './data' as module, 0 as tier, 'web/data.' || e as candidate from e union all select 'web/a.ts', './data', 0, 'web/data/index.' || e from e
union all select 'web/a.ts', './data.js', 0, 'web/data.js' union all select 'web/a.ts', './data.js', 1, 'web/data.' || e from e union all select 'web/a.ts', './data.js', 2, 'web/data/index.' || e from e
union all select 'web/a.ts', '../x/y.jsx', 0, 'x/y.jsx' union all select 'web/a.ts', '../x/y.jsx', 1, 'x/y.' || e from e where e in ('tsx', 'jsx') union all select 'web/a.ts', '../x/y.jsx', 2, 'x/y/index.' || e from e where e in ('tsx', 'jsx')
union all select * from (values ('job/p/run.py', '.steps', 0, 'job/p/steps.py'), ('job/p/run.py', '.steps', 0, 'job/p/steps/__init__.py'), ('job/p/run.py', '..lib.util', 0, 'job/lib/util.py'), ('job/p/run.py', '..lib.util', 0, 'job/lib/util/__init__.py'))"""


def structural_rerank(spark, d):
    """Corroboration of a pool's members by the edges inside it; a node's score is the length of its name."""
    nodes = _pool(spark, d)
    pool = {r["node"]: float(len(r["node"])) for r in nodes.collect()}
    inside = _inside(spark, d, nodes).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).collect()
    bonus = retrieve.structural_bonus(pool, [(r["src"], r["dst"], r["n"]) for r in inside])
    return spark.createDataFrame([(k, float(v)) for k, v in bonus.items()], "node string, structural double").withColumn("structural", F.round("structural", 6))


STRUCTURAL_RERANK = f"""with recursive {EDGES}, {POOL}, inside as (select src, dst from edges where src in (select node from pool) and dst in (select node from pool)),
s as (select node, length(node)::double / (select greatest(1, max(length(node))) from pool) as s from pool),
w as (select src as a, dst as b from inside union all select dst, src from inside),
reach as (select node, node as low from pool union select x.b, r.low from reach r join w x on x.a = r.node),
comp as (select node, min(low) as c from reach group by node),
mass as (select c, case when count(*) > 1 then least(3.0, greatest(0.0, (sum(s) - 1) * 0.55)) else 0 end as bonus from comp join s using (node) group by c),
direct as (select a, sum(s) as v from w join s on s.node = w.b group by a),
two as (select x.a, sum(s) as v from w x join w y on x.b = y.a and x.a <> y.b join s on s.node = y.b group by x.a)
select s.node, round(least(6.0, 2.4 * least(2.5, coalesce(direct.v, 0)) + 0.35 * least(3.0, coalesce(two.v, 0)) + bonus), 6)::double as structural
from s join comp using (node) join mass using (c) left join direct on direct.a = s.node left join two on two.a = s.node"""


def lexer_split(spark, d):
    """Words of code, comments and strings in the pages' HTML, as evidence counts."""
    from ..functions.evidence import split_kinds

    def each(batches):
        import pyarrow as pa

        for b in batches:
            parts = [split_kinds(h or "") for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([len(p[k].split()) for p in parts], pa.int64()) for k in range(3))], ["page_id", "code", "comments", "strings"])

    return _t(spark, d, "pages").select("page_id", "html").mapInArrow(each, "page_id long, code long, comments long, strings long")


_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_QUOTED = "|".join(rf"{q}(?:\\.|[^{q}])*(?:{q}|\z)" for q in (r"\x22", r"\x27", "`"))
_TRIPLE = "|".join(rf"{q}{{3}}.*?(?:{q}{{3}}|\z)" for q in (r"\x22", r"\x27"))
_PIECES = rf"//[^\n]*|/\*.*?(?:\*/|\z)|#[^\n]*|{_TRIPLE}|{_QUOTED}"
LEXER_SPLIT = rf"""with p as (select page_id, coalesce(html, '') as h, regexp_extract_all(coalesce(html, ''), '{_PIECES}', 0, 's') as ps from pages),
c as (select page_id, h, list_filter(ps, lambda x: starts_with(x, '//') or starts_with(x, '/*') or starts_with(x, '#')) as cs,
    list_filter(ps, lambda x: not (starts_with(x, '//') or starts_with(x, '/*') or starts_with(x, '#'))) as ss from p),
t as (select page_id, regexp_replace(h, '{_PIECES}', '', 'gs') as code,
    array_to_string(list_transform(cs, lambda x: case when starts_with(x, '/*') and ends_with(x, '*/') and length(x) > 3 then substr(x, 3, length(x) - 4) when starts_with(x, '#') then substr(x, 2) else substr(x, 3) end), ' ') as comments,
    array_to_string(list_transform(ss, lambda x: case
        when left(x, 3) in (repeat(chr(34), 3), repeat(chr(39), 3)) then case when length(x) > 5 and ends_with(x, left(x, 3)) then substr(x, 4, length(x) - 6) else substr(x, 4) end
        when length(x) > 1 and ends_with(x, left(x, 1)) then substr(x, 2, length(x) - 2) else substr(x, 2) end), ' ') as strings from c)
select page_id, len(regexp_extract_all(code, '[^{_SPACE}]+'))::bigint as code, coalesce(len(regexp_extract_all(comments, '[^{_SPACE}]+')), 0)::bigint as comments, coalesce(len(regexp_extract_all(strings, '[^{_SPACE}]+')), 0)::bigint as strings from t"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        unique_resolution, endpoint_join, materialize_calls, call_sites_min, dependencies_union, impact_depth, impact_by_depth, impact_budget, trace_path, importer_closure,
        semi_pool_edges, components_pool, two_hop_sums, anti_visited, narrowest_span, likely_tests, tokenize_terms, query_terms, doc_frequency, lexical_score,
        rank_topk, file_area_rerank, runner_up_confidence, nonproduction_paths, snapshot_changes, incremental_equals_full, hunk_headers,
        golden_symbols, golden_calls, golden_hierarchy, golden_imports, golden_issues, lexer_split, module_candidates, structural_rerank,
    )
} | {"morphology": morphology_query} | trees.QUERIES

ORACLE_SQL = {
    "unique_resolution": UNIQUE_RESOLUTION, "endpoint_join": ENDPOINT_JOIN, "materialize_calls": MATERIALIZE_CALLS, "call_sites_min": CALL_SITES_MIN, "dependencies_union": DEPENDENCIES_UNION,
    "impact_depth": IMPACT_DEPTH, "impact_by_depth": IMPACT_BY_DEPTH, "impact_budget": IMPACT_BUDGET, "lexer_split": LEXER_SPLIT, "trace_path": TRACE_PATH, "importer_closure": IMPORTER_CLOSURE, "semi_pool_edges": SEMI_POOL_EDGES, "components_pool": COMPONENTS_POOL,
    "two_hop_sums": TWO_HOP_SUMS, "anti_visited": ANTI_VISITED, "narrowest_span": NARROWEST_SPAN, "likely_tests": LIKELY_TESTS, "tokenize_terms": TOKENIZE_TERMS, "query_terms": QUERY_TERMS,
    "morphology": MORPHOLOGY, "doc_frequency": DOC_FREQUENCY, "lexical_score": LEXICAL_SCORE, "rank_topk": RANK_TOPK, "file_area_rerank": FILE_AREA_RERANK, "runner_up_confidence": RUNNER_UP,
    "nonproduction_paths": NONPRODUCTION, "snapshot_changes": SNAPSHOT_CHANGES, "incremental_equals_full": INCREMENTAL, "hunk_headers": HUNK_HEADERS,
    "golden_symbols": GOLDEN_SYMBOLS, "golden_calls": GOLDEN_CALLS, "golden_hierarchy": GOLDEN_HIERARCHY, "golden_imports": GOLDEN_IMPORTS, "golden_issues": GOLDEN_ISSUES, "module_candidates": MODULE_CANDIDATES, "structural_rerank": STRUCTURAL_RERANK,
} | trees.ORACLE_SQL
