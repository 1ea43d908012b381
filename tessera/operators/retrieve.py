"""find: fielded relevance over search facts, with corroboration from confirmed edges and from the file.

Postings are a table of their own, sorted by term. Query terms meet the distinct stored terms first, and only
the matching ones are joined with the postings; what they find is written once, for the frequencies and for the
scores. The reranking steps work on a pool of the best 64, which is all that ever reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import Query, non_production, parse_query
from ..tables import written
from .graph import pool_edges

FIELDS = ["identifier", "path", "declaration", "comments", "strings", "body", "test"]
WEIGHT = {"identifier": 3.5, "path": 2.2, "declaration": 1.7, "test": 0.9, "comments": 0.8, "strings": 0.65, "body": 0.25}
COVERAGE = {"identifier": 1.0, "path": 1.0, "declaration": 0.8, "test": 0.5, "comments": 0.45, "strings": 0.35, "body": 0.18}
POOL = 64
SHOWN = 20
EXACT = 1_000_000.0


def postings(facts: DataFrame) -> DataFrame:
    """canonical, field, term of facts, whose columns named in FIELDS are arrays of terms."""
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("terms")) for f in FIELDS))
    return facts.select("canonical", F.explode(rows).alias("x")).select("canonical", "x.field", F.explode("x.terms").alias("term"))


def by_term(posted: DataFrame) -> DataFrame:
    """Postings clustered by term, so that a reader skips the parts without a term it looks for."""
    return posted.repartitionByRange("term", "canonical").sortWithinPartitions("term", "canonical")


def quality(value: Column, term: str, variants: list[str]) -> Column:
    """How well a stored term matches a query term: equal, prefix of one another, a variant, not at all (0)."""

    def prefix(t: str) -> Column:
        if len(t.encode()) < 4:
            return F.lit(False)
        return value.startswith(t) | F.lit(t).startswith(value)

    other = F.lit(False)
    for v in variants:
        other = other | (value == v) | prefix(v)
    return F.when(value == term, 1.0).when(prefix(term), 0.82).when(other, 0.62).otherwise(0.0)


def matching(posted: DataFrame, query: Query) -> DataFrame:
    """The postings whose term matches a term of the query, which are all that it looks at: for a query over texts without stored postings."""
    if not query.terms:
        return posted
    hit = F.lit(False)
    for t, v in query.terms:
        hit = hit | (quality(F.col("term"), t, v) > 0)
    return posted.where(hit)


def _of_field(table: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col("field"))


def term_evidence(posted: DataFrame, query: Query) -> DataFrame:
    """canonical, qterm, best, cover, n_fields, fields: each matched query term of each symbol."""
    each = F.array(*(F.struct(F.lit(t).alias("qterm"), quality(F.col("term"), t, v).alias("q")) for t, v in query.terms))
    matched = posted.select("term").distinct().select("term", F.explode(each).alias("x")).select("term", "x.qterm", "x.q").where("q > 0")
    hits = posted.join(matched, "term").groupBy("canonical", "qterm", "field").agg(F.max("q").alias("q"))
    return hits.groupBy("canonical", "qterm").agg(
        F.max(_of_field(WEIGHT) * F.col("q")).alias("best"),
        F.max(_of_field(COVERAGE) * F.col("q")).alias("cover"),
        F.count(F.lit(1)).alias("n_fields"),
        F.collect_set("field").alias("fields"),
    )


def lexical(symbols: DataFrame, posted: DataFrame, text: str) -> DataFrame:
    """From symbols and their postings: canonical, name, path, kind, matched, coverage, lexical, fields of every admitted symbol."""
    query = parse_query(text)
    symbols = symbols.select("canonical", "name", "path", "kind")
    if not query.terms:
        return symbols.select("*", F.lit(0).cast("long").alias("matched"), F.lit(0.0).alias("coverage"), F.lit(1.0).alias("lexical"), F.array().cast("array<string>").alias("fields"))
    many = len(query.terms)
    evidence = written(term_evidence(posted, query), "evidence")
    frequency = evidence.groupBy("qterm").agg(F.count(F.lit(1)).alias("df"))
    total = symbols.agg(F.count(F.lit(1)).alias("n"))
    idf = F.least(F.lit(3.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    weighted = evidence.join(frequency, "qterm").join(F.broadcast(total))  # one row
    contribution = F.least(F.lit(8.0), idf * (F.col("best") + F.least(F.lit(0.36), 0.12 * (F.col("n_fields") - 1))))
    found = weighted.groupBy("canonical").agg(F.sum(contribution).alias("contribution"), F.sum("cover").alias("cover"), F.count(F.lit(1)).alias("matched"), F.array_distinct(F.flatten(F.collect_list("fields"))).alias("fields"))
    low = text.strip().lower()
    exact = (F.lower("canonical") == low) | (F.col("name") == text) | (F.lower("name") == low)
    rows = symbols.join(found, "canonical", "left").withColumn("matched", F.coalesce("matched", F.lit(0)).cast("long"))
    rows = rows.where((F.col("matched") >= (2 if many >= 4 else 1)) | exact)
    coverage = F.coalesce("cover", F.lit(0.0)) / many
    mean = F.coalesce("contribution", F.lit(0.0)) / F.greatest(F.col("matched"), F.lit(1))
    score = mean * (0.35 + 0.65 * coverage) + 12.0 * coverage * coverage
    if not query.test_intent:
        score = score - F.when(non_production(F.col("path")), 8.0).otherwise(0.0)
    if query.flow_intent:
        score = score + F.when(F.col("kind").isin("function", "method"), 0.7).when(F.col("kind") == "class", 0.15).otherwise(-0.8)
    score = score + F.when(exact, EXACT).otherwise(0.0)
    return rows.select("canonical", "name", "path", "kind", "matched", coverage.alias("coverage"), score.alias("lexical"), F.coalesce("fields", F.array().cast("array<string>")).alias("fields"))


def top_pool(rows: DataFrame, score: str, size: int = POOL) -> DataFrame:
    """The best rows by score; ties by canonical."""
    return rows.orderBy(F.desc(score), "canonical").limit(size)


def structural_bonus(pool: dict[str, float], edges: list[tuple[str, str, int]]) -> dict[str, float]:
    """Corroboration of each pool member from (src, dst, number of parallel edges) inside the pool."""
    top = max([1.0, *(max(s, 0.0) for s in pool.values())])
    share = {k: max(s, 0.0) / top for k, s in pool.items()}
    near: dict[str, list[str]] = {k: [] for k in pool}
    for a, b, n in edges:
        near[a] += [b] * n
        near[b] += [a] * n
    group: dict[str, float] = {}
    seen: set[str] = set()
    for start in sorted(pool):
        if start in seen:
            continue
        members, queue = {start}, [start]
        while queue:
            for other in near[queue.pop()]:
                if other not in members:
                    members.add(other)
                    queue.append(other)
        seen |= members
        if len(members) > 1:
            bonus = min(3.0, max(0.0, (sum(share[m] for m in sorted(members)) - 1.0) * 0.55))
            group |= dict.fromkeys(members, bonus)
    out = {}
    for k in pool:
        direct = min(2.5, sum(share[o] for o in near[k]))
        two = min(3.0, sum(share[p] for o in near[k] for p in near[o] if p != k))
        out[k] = min(6.0, 2.4 * direct + 0.35 * two + group.get(k, 0.0))
    return out


def best_first() -> list[Column]:
    """The order of results."""
    return [F.desc("score"), F.desc("matched"), F.asc("canonical")]


def ranked(symbols: DataFrame, posted: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """All admitted symbols with lexical, structural and area parts and the score, in no order; best_first() sorts them."""
    spark = symbols.sparkSession
    rows = written(lexical(symbols, posted, text), "lexical")
    pool = {r["canonical"]: r["lexical"] for r in top_pool(rows, "lexical").select("canonical", "lexical").collect()}
    names = spark.createDataFrame([(k,) for k in pool], "node string")
    inside = pool_edges(edges, names).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 64 * 64 rows
    bonus = structural_bonus(pool, [(r["src"], r["dst"], r["n"]) for r in inside])
    table = spark.createDataFrame([(k, float(v)) for k, v in bonus.items()], "canonical string, structural double")
    rows = rows.join(F.broadcast(table), "canonical", "left").withColumn("structural", F.coalesce("structural", F.lit(0.0))).withColumn("score", F.col("lexical") + F.col("structural"))
    area = file_area(top_pool(rows, "score"))
    rows = rows.join(F.broadcast(area.select("canonical", "area")), "canonical", "left").withColumn("area", F.coalesce("area", F.lit(0.0)))
    return rows.withColumn("score", F.col("score") + F.col("area"))


def file_area(pool: DataFrame) -> DataFrame:
    """Add area: the bonus of a file whose second and third symbols of the pool also match (score, coverage, path)."""
    worth = F.greatest("score", F.lit(0.0)) * F.greatest("coverage", F.lit(0.25))
    rows = pool.withColumn("_worth", worth).withColumn("_rank", F.row_number().over(W.partitionBy("path").orderBy(F.desc("_worth"), "canonical")))
    file = rows.groupBy(F.col("path").alias("_path")).agg(F.max("_worth").alias("_best"), F.sum(F.when(F.col("_rank").isin(2, 3), F.col("_worth")).otherwise(0.0)).alias("_support"))
    bonus = F.least(F.lit(0.75), 0.35 * F.col("_support") / F.greatest(F.lit(1.0), F.col("_best")))
    return rows.join(file, rows["path"] == file["_path"]).withColumn("area", bonus).drop("_worth", "_rank", "_path", "_best", "_support")


def limited_confidence(first: list) -> bool:
    """Whether the first rows of ranked() call for a warning."""
    if not first or first[0]["lexical"] >= EXACT:
        return False
    top = first[0]
    close = len(first) > 1 and first[1]["score"] >= 0.88 * top["score"] and first[1]["path"] != top["path"]
    return close or (top["structural"] < 0.2 and top["coverage"] < 0.72)


TEST_PARTS = ["test", "tests", "spec", "specs"]


def likely_tests(symbols: DataFrame, search: DataFrame, sites: DataFrame, canonical: str, name_terms: list[str]) -> DataFrame:
    """canonical, score of test symbols near one symbol: 100 for its file, 300 for a call either way, 25 for each of up to four shared words of the name; 50 at least.

    symbols has canonical, name, path; search has canonical and the terms of identifier and test. A symbol that is a test itself has none.
    """
    part = F.exists(F.split("path", "/"), lambda p: p.isin(TEST_PARTS) | p.contains(".test.") | p.contains(".spec."))
    low = F.lower("name")
    words = search.select("canonical", F.col("identifier").alias("_words"), (F.size("test") > 0).alias("_tested"))
    rows = symbols.select("canonical", "name", "path").join(words, "canonical", "left")
    rows = rows.withColumn("_test", part | (F.coalesce("_tested", F.lit(False)) & ((low == "test") | low.startswith("test_"))))
    own = rows.where(F.col("canonical") == canonical).agg(F.max("path").alias("_own"), F.max("_test").alias("_is_test"))  # one row
    near = sites.where(F.col("src") == canonical).select(F.col("dst").alias("canonical")).union(sites.where(F.col("dst") == canonical).select("src")).distinct().withColumn("_near", F.lit(300))
    name = F.array(*map(F.lit, name_terms)).cast("array<string>")
    shared = F.least(F.lit(4), F.size(F.array_intersect(F.coalesce("_words", F.array().cast("array<string>")), name))) * 25
    tests = rows.where(F.col("_test") & (F.col("canonical") != canonical)).join(F.broadcast(own)).where("not _is_test")
    score = F.when(F.col("path") == F.col("_own"), 100).otherwise(0) + F.coalesce("_near", F.lit(0)) + shared
    return tests.join(near, "canonical", "left").withColumn("score", score).where("score >= 50").select("canonical", "score")
