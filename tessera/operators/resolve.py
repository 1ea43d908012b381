"""Facts of source files to edges and issues, by joins under the rule of the unique candidate.

Every reference meets its candidates by an equi-join on natural keys; candidates are counted by key before
the join, so a popular name costs one row and not one per pair. What isn't provable becomes an issue, never
a guess.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import small_broadcasts, written
from . import graph, traverse

UNRESOLVED, AMBIGUOUS = "UNRESOLVED", "AMBIGUOUS"


@dataclass
class Resolved:
    """sites (src, dst, line, column), imports (src, dst), structural (src, dst, kind, line, column), issues."""

    sites: DataFrame
    imports: DataFrame
    structural: DataFrame
    issues: DataFrame


def exploded(facts: DataFrame, what: str) -> DataFrame:
    return facts.select("path", "lang", F.inline(what))


def counted(rows: DataFrame, keys: list[str], target: str, name: str) -> DataFrame:
    """Per key: name_n distinct targets, and the only one."""
    return rows.groupBy(*keys).agg(F.countDistinct(target).alias(f"{name}_n"), F.min(target).alias(name))


def issue_rows(rows: DataFrame, status: Column, source: str, name: str, detail: Column) -> DataFrame:
    return rows.select(status.alias("status"), F.col(source).alias("source"), "line", "column", F.col(name).alias("name"), detail.alias("detail"))


def modules(facts: DataFrame, paths: DataFrame) -> DataFrame:
    """Imports with n, the number of files (path of paths) they may mean, and target where it is one. Only the first tier that has files counts."""
    imports = exploded(facts, "imports")
    files = paths.select(F.col("path").alias("_file"))
    tried = imports.select("path", "seq", F.inline("candidates").alias("tier", "_file")).join(files, "_file", "left_semi")
    hits = tried.groupBy("path", "seq", "tier").agg(F.countDistinct("_file").alias("n"), F.min("_file").alias("target"))
    best = hits.groupBy("path", "seq").agg(F.min(F.struct("tier", "n", "target")).alias("b")).select("path", "seq", "b.n", "b.target")
    out = imports.drop("candidates").join(best, ["path", "seq"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("target", F.when(F.col("n") == 1, F.col("target")))


def _exports(facts: DataFrame, symbols: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exports, ambiguous): what a JS/TS file offers to callers: path, exported, is_default, canonical; and names it can't offer for sure."""
    own = symbols.where("lang = 'js'")
    functions = own.where("kind = 'function'")
    named = functions.where("exported").select("path", F.col("name").alias("exported"), F.lit(False).alias("is_default"), "canonical")
    default = own.where("is_default").select("path", F.lit("").alias("exported"), F.lit(True).alias("is_default"), "canonical")
    direct = written(named.unionByName(default), "direct-exports")
    # export { local as name }: a local function, or one hop through an import of that name
    lists = exploded(facts, "exports").where("not type_only")
    bound = exploded(facts, "bindings").join(imports.where("not type_only").select("path", "seq", "n", "target"), ["path", "seq"])
    hop = lists.join(bound.select("path", "local", "imported", F.col("is_default").alias("_d"), "n", "target"), ["path", "local"])
    from_import = hop.where("n = 1").join(direct.select(F.col("path").alias("target"), F.col("exported").alias("imported"), F.col("is_default").alias("_d"), "canonical"), ["target", "imported", "_d"]).select("path", "exported", "local", "canonical")
    from_local = lists.join(functions.select("path", F.col("name").alias("local"), "canonical"), ["path", "local"]).select("path", "exported", "local", "canonical")
    # candidates count with their number: the same function twice isn't unique
    found = from_local.unionByName(from_import).groupBy("path", "exported", "local").agg(F.count(F.lit(1)).alias("k"), F.min("canonical").alias("canonical"))
    unsure = found.where("k > 1").select("path", "exported").unionByName(hop.where("n > 1").select("path", "exported"))
    listed = found.where("k = 1").select("path", "exported", F.lit(False).alias("is_default"), "canonical")
    # export { a as b } from: one hop to what the module itself declares
    again = exploded(facts, "reexports").join(imports.select("path", "seq", "n", "target"), ["path", "seq"])
    passed = again.where("n = 1").join(direct.where("not is_default").select(F.col("path").alias("target"), F.col("exported").alias("local"), "canonical"), ["target", "local"]).select("path", "exported", F.lit(False).alias("is_default"), "canonical")
    unsure = unsure.unionByName(again.where("n > 1").select("path", "exported"))
    return direct.unionByName(listed).unionByName(passed), unsure.distinct()


def bindings(facts: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Each imported name with what it can be called for: path, local, symbol, state (RESOLVED, UNRESOLVED, AMBIGUOUS), position."""
    rows = exploded(facts, "bindings").where("lang in ('js', 'python')").join(imports.select("path", "seq", "n", "target", "type_only", "line", "column"), ["path", "seq"])
    exports, unsure = _exports(facts, symbols, imports)
    python = symbols.where("lang = 'python' and kind = 'function'").select("path", F.col("name").alias("exported"), F.lit(False).alias("is_default"), "canonical")
    offered = exports.unionByName(python).groupBy("path", "exported", "is_default").agg(F.count(F.lit(1)).alias("k"), F.min("canonical").alias("symbol"))
    rows = rows.join(offered.withColumnsRenamed({"path": "target", "exported": "imported"}), ["target", "imported", "is_default"], "left")
    rows = rows.join(unsure.select(F.col("path").alias("target"), F.col("exported").alias("imported"), F.lit(False).alias("is_default"), F.lit(True).alias("unsure")), ["target", "imported", "is_default"], "left")
    state = (
        F.when(F.col("type_only"), UNRESOLVED)
        .when(F.col("target").isNotNull() & F.col("unsure"), AMBIGUOUS)
        .when(F.col("k") == 1, "RESOLVED")
        .when((F.col("k") > 1) | (F.col("n") > 1), AMBIGUOUS)
        .otherwise(UNRESOLVED)
    )
    return rows.withColumn("state", state).withColumn("symbol", F.when(F.col("state") == "RESOLVED", F.col("symbol")))


def _import_issues(imports: DataFrame, bound: DataFrame) -> DataFrame:
    real = imports.where("not coalesce(unsupported = 'REEXPORT', false)")
    js = F.col("lang") == "js"
    missing = F.when(F.col("relative"), F.when(F.col("module").rlike(r"^\.+$"), "a package import that names no module can't be followed").otherwise("the relative module isn't in the tree")).otherwise("only relative modules are followed")
    out = issue_rows(real.where("n = 0"), F.lit(UNRESOLVED), "path", "module", missing)
    out = out.unionByName(issue_rows(real.where("n > 1"), F.lit(AMBIGUOUS), "path", "module", F.lit("several files could be this module")))
    out = out.unionByName(issue_rows(real.where("unsupported = 'NAMESPACE' or wildcard"), F.lit(UNRESOLVED), "path", "module", F.when(js, "whole-module imports aren't followed").otherwise("star imports aren't followed")))
    why = F.when(F.col("type_only"), "imported as a type only, it can't be called").when(F.col("target").isNotNull(), "the module doesn't offer this name exactly once").otherwise("its module isn't known")
    return out.unionByName(issue_rows(bound.where("state <> 'RESOLVED'"), F.col("state"), "path", "local", why))


_BLOCKED = {
    "SHADOWED": "a local name may hide it",
    "NO_CLASS": "used on this outside a class that is indexed",
    "MANY_BINDINGS": "the receiver has several constructor bindings before this call",
    "REASSIGNED": "the receiver is assigned again",
    "NO_RECEIVER": "not called on the instance of an own impl block",
    "SHADOWED_CLASS": "a local name may hide the receiver's class",
}


def path_of(column: str) -> Column:
    """The file of a canonical name; a path is its own."""
    return F.substring_index(column, "::", 1)


def _only(facts: DataFrame, paths: DataFrame) -> DataFrame:
    """facts whose references (calls, heritage) are left in the files of paths alone; what can be referred to stays."""
    marked = facts.join(paths.select("path", F.lit(True).alias("_mine")), "path", "left")
    none = lambda c: F.array().cast(facts.schema[c].dataType)
    return marked.select(*(F.when(F.col("_mine"), F.col(c)).otherwise(none(c)).alias(c) if c in ("calls", "heritage") else c for c in facts.columns))


def affected(old: DataFrame, new: DataFrame, changed: DataFrame, imports: DataFrame, go_modules: DataFrame | None = None) -> DataFrame:
    """path of every file that may resolve otherwise after the files of changed (path) went from old facts to new ones.

    These are the files themselves, all that import them, directly or not (imports: src, dst before the change),
    and those that see them without an import edge: files of a changed Go package and those that import its
    folder, files of a changed Java package and those that import from it, and all Rust files where a module
    was declared or is no longer. The set of files is the same before and after.
    """
    paths = traverse.closure(imports.select("src", "dst"), changed.select(F.col("path").alias("node"))).select(F.col("node").alias("path"))
    for facts in (old, new):
        touched = facts.join(changed.select("path"), "path", "left_semi")
        folders = touched.where("lang = 'go'").select(_folder().alias("dir")).distinct()
        paths = paths.unionByName(facts.where("lang = 'go'").withColumn("dir", _folder()).join(folders, "dir", "left_semi").select("path"))
        paths = paths.unionByName(_go_imports(facts, go_modules, known=False).join(folders, "dir", "left_semi").select("path"))
        packages = touched.where("lang = 'java'").select(F.coalesce("package", F.lit("")).alias("package")).distinct()
        java = facts.where("lang = 'java'").withColumn("package", F.coalesce("package", F.lit("")))
        paths = paths.unionByName(java.join(packages, "package", "left_semi").select("path"))
        named = exploded(facts, "imports").where("lang = 'java'").select("path", F.explode(F.array("module", F.regexp_extract("module", r"^(.*)\.[^.]+$", 1))).alias("package"))
        paths = paths.unionByName(named.join(packages, "package", "left_semi").select("path"))
    declared = [exploded(f.join(changed.select("path"), "path", "left_semi"), "imports").where("lang = 'rust' and unsupported = 'MOD'").select("path", "module") for f in (old, new)]
    if not declared[0].exceptAll(declared[1]).unionAll(declared[1].exceptAll(declared[0])).isEmpty():
        paths = paths.unionByName(new.where("lang = 'rust'").select("path"))
    return paths.distinct()


def resolve(facts: DataFrame, go_modules: DataFrame | None = None, only: DataFrame | None = None) -> Resolved:
    """Edges and issues of the facts of all languages; go_modules has the folders (root) and names (module) of go.mod files.

    With only (path), edges and issues of these files alone, against what all files offer.
    """
    if only is not None:
        part = resolve(written(_only(facts, only), "facts-only"), go_modules)
        own = lambda rows, c: rows.withColumn("path", path_of(c)).join(only.select("path"), "path", "left_semi").drop("path")
        return Resolved(own(part.sites, "src"), own(part.imports, "src"), own(part.structural, "src"), own(part.issues, "source"))
    with small_broadcasts(facts.sparkSession):
        paths = facts.select("path").distinct()
        there = {r["lang"] for r in facts.select("lang").distinct().collect()}
        groups = [g for g in _GROUPS if there & set(g)]
        # a group by itself: small plans, and no joins for languages that aren't there
        of = lambda g: facts if len(groups) == 1 else written(facts.where(F.col("lang").isin(*g)), f"facts-{g[0]}")
        parts = [_of_group(of(g), paths, g, go_modules) for g in groups or _GROUPS[:1]]
    return Resolved(*(reduce(DataFrame.unionByName, rows) for rows in zip(*((r.sites, r.imports, r.structural, r.issues) for r in parts))))


# languages that never refer to one another's files, but for those of one group
_GROUPS = (("js", "python"), ("rust",), ("go",), ("java",))


def _of_group(facts: DataFrame, paths: DataFrame, group: tuple[str, ...], go_modules: DataFrame | None) -> Resolved:
    """Edges and issues of the facts of a group's languages; paths (path) are all files. The tables are written."""
    lang = group[0]
    symbols = written(exploded(facts, "symbols"), "symbols")
    calls = written(exploded(facts, "calls"), "calls")
    # JS/TS: two symbols of one canonical name make no calls
    if lang == "js":
        once = graph.unique_symbols(symbols.where("lang = 'js'"))
        calls = calls.where("lang <> 'js'").unionByName(calls.where("lang = 'js'").join(once.select(F.col("canonical").alias("source")), "source", "left_semi").select(*calls.columns))
    why = F.element_at(F.create_map(*(F.lit(x) for kv in _BLOCKED.items() for x in kv)), F.col("blocked"))
    issues = [issue_rows(calls.where("blocked is not null"), F.lit(UNRESOLVED), "source", "name", why)]
    issues.append(issue_rows(calls.where("how = 'other' and blocked is null"), F.lit(UNRESOLVED), "source", "name", F.lit("what this is called on isn't modelled")))
    open_calls = calls.where("blocked is null and how <> 'other'")
    edges = facts.where("false").select(F.col("path").alias("src"), F.col("path").alias("dst"))
    hierarchy = edges.select("src", "dst", F.lit("").alias("kind"), F.lit(0).alias("line"), F.lit(0).alias("column"))
    if lang == "go":
        parts = [_go_calls(facts, symbols, go_modules, open_calls)]
        issues.append(_go_import_issues(facts, go_modules))
    elif lang == "java":
        parts = [_java_calls(facts, symbols, open_calls)]
        edges, more = _java_imports(facts, symbols)
        issues.append(more)
        hierarchy, more = _hierarchy(facts, symbols, _java_types(facts, symbols).select("path", "name", F.col("n").cast("long").alias("n"), "only", F.lit(False).alias("unsure"), F.lit("java").alias("lang")))
        issues.append(more)
    else:
        imports = written(modules(facts, paths), "imports")
        if lang == "rust":
            bound, edges, more = _rust_uses(facts, symbols, imports)
            issues.append(more)
            bound = written(bound, "bindings")
            parts = []
        else:
            bound = written(bindings(facts, symbols, imports), "bindings")
            issues.append(_import_issues(imports, bound))
            edges = imports.where("n = 1 and (lang = 'js' or not module rlike '^\\\\.+$')").select(F.col("path").alias("src"), F.col("target").alias("dst"))
            parts = [_constructed(symbols, imports, facts, open_calls)]
            scope = _types_in_scope(facts, symbols, imports, ["class", "type"], True).withColumn("lang", F.lit("js"))
            hierarchy, more = _hierarchy(facts, symbols, scope)
            issues.append(more)
        parts += [_direct(facts, symbols, bound.select("path", "local", "symbol", "state"), open_calls), _self(symbols, open_calls)]
    sites = reduce(DataFrame.unionByName, (part[0] for part in parts))
    issues += [part[1] for part in parts]
    ends = graph.unique_symbols(symbols)
    return Resolved(
        written(graph.with_both_ends(sites, ends).select("src", "dst", "line", "column").distinct(), "sites"),
        written(edges.distinct(), "import-edges"),
        written(graph.with_both_ends(hierarchy, ends).select("src", "dst", "kind", "line", "column").distinct(), "hierarchy"),
        written(reduce(DataFrame.unionByName, issues).distinct(), "issues"),
    )


def _edges(rows: DataFrame, target: str) -> DataFrame:
    return rows.select(F.col("source").alias("src"), F.col(target).alias("dst"), "line", "column")


def _by_count(rows: DataFrame, n: Column, target: str, none: str, many: str) -> tuple[DataFrame, DataFrame]:
    """Edges of the rows with one target, issues of the others."""
    rows = written(rows.select("source", "name", "line", "column", F.coalesce(n, F.lit(0)).alias("_n"), target), "candidates")
    status = F.when(F.col("_n") == 0, UNRESOLVED).otherwise(AMBIGUOUS)
    detail = F.when(F.col("_n") == 0, none).otherwise(many)
    return _edges(rows.where("_n = 1"), target), issue_rows(rows.where("_n <> 1"), status, "source", "name", detail)


def _direct(facts: DataFrame, symbols: DataFrame, bound: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain calls. JS/TS unites local functions and bindings; in Python a binding takes the place of local functions."""
    rows = calls.where("how = 'direct' and lang in ('js', 'python', 'rust')")
    local = counted(symbols.where("kind = 'function'"), ["path", "name"], "canonical", "own")
    per = bound.groupBy("path", F.col("local").alias("name")).agg(
        F.countDistinct("symbol").alias("b_n"),
        F.min("symbol").alias("b"),
        F.max(F.col("state") == AMBIGUOUS).alias("b_unsure"),
        F.max(F.col("state") == UNRESOLVED).alias("b_missing"),
    )
    shadow = facts.select("path", F.explode("module_shadowed").alias("name")).distinct().withColumn("hidden", F.lit(True))
    rows = rows.join(local, ["path", "name"], "left").join(per, ["path", "name"], "left").join(shadow, ["path", "name"], "left")
    js, is_bound = F.col("lang") == "js", F.col("b_n").isNotNull()
    zero = F.lit(0)
    failed = F.coalesce(F.col("b_unsure") | F.col("b_missing"), F.lit(False))
    hidden = F.coalesce("hidden", F.lit(False))
    bound_n = F.when(failed, zero).otherwise(F.coalesce("b_n", zero))
    bound_one = F.when(~failed, F.col("b"))
    own_n = F.coalesce("own_n", zero)
    same = (own_n == 1) & (bound_n == 1) & (F.col("own") == bound_one)
    n = F.when(js, own_n + bound_n - F.when(same, 1).otherwise(0)).when(is_bound, bound_n).when(hidden, zero).otherwise(own_n)
    target = F.when(js, F.coalesce(F.when(own_n == 1, F.col("own")), bound_one)).when(is_bound, bound_one).otherwise(F.col("own"))
    rows = rows.withColumn("_n", n).withColumn("_target", target).withColumn("_bound", is_bound).withColumn("_failed", failed).withColumn("_hidden", hidden)
    rows = written(rows.select("source", "name", "line", "column", "lang", "_n", "_target", "_bound", "_failed", "_hidden", "b_unsure"), "direct")
    issues = issue_rows(rows.where("_failed"), F.when(F.col("b_unsure"), AMBIGUOUS).otherwise(UNRESOLVED), "source", "name", F.lit("its import isn't settled"))
    issues = issues.unionByName(issue_rows(rows.where("_n = 0 and _hidden and lang = 'python'"), F.lit(UNRESOLVED), "source", "name", F.lit("an assignment in the module may hide it")))
    issues = issues.unionByName(issue_rows(rows.where("_n = 0 and not _bound and not (_hidden and lang = 'python')"), F.lit(UNRESOLVED), "source", "name", F.lit("neither a function here nor a settled import")))
    issues = issues.unionByName(issue_rows(rows.where("_n > 1"), F.lit(AMBIGUOUS), "source", "name", F.lit("several functions have this name")))
    return _edges(rows.where("_n = 1"), "_target"), issues


def _methods(symbols: DataFrame) -> DataFrame:
    return symbols.where("kind = 'method'").select("path", "owner", "name", "is_static", "canonical")


def _self(symbols: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """this.m() and the like: a method of the same class in the same file; JS/TS also looks at static."""
    own = symbols.where("kind = 'method' and (lang in ('js', 'python') or lang = 'rust' and inherent and not is_static)")
    found = own.groupBy("path", "owner", "name", "is_static").agg(F.count(F.lit(1)).alias("k"), F.min("canonical").alias("target"))
    rows = calls.where("how = 'self' and lang in ('js', 'python', 'rust')").join(found, ["path", "owner", "name", "is_static"], "left")
    return _by_count(rows, F.col("k"), "target", "its class has no such method", "its class has several such methods")


def _offered_types(symbols: DataFrame, kinds: list[str]) -> DataFrame:
    own = symbols.where((F.col("lang") == "js") & F.col("kind").isin(kinds))
    named = own.where("exported").select("path", F.col("name").alias("imported"), F.lit(False).alias("is_default"), "canonical")
    return named.unionByName(own.where("is_default").select("path", F.lit("").alias("imported"), F.lit(True).alias("is_default"), "canonical"))


def _types_in_scope(facts: DataFrame, symbols: DataFrame, imports: DataFrame, kinds: list[str], with_types: bool) -> DataFrame:
    """JS/TS names of types in each file: path, name, n distinct canonicals, only one, unsure."""
    local = symbols.where((F.col("lang") == "js") & F.col("kind").isin(kinds)).select("path", "name", "canonical", F.lit(False).alias("unsure"))
    used = imports.where("lang = 'js'") if with_types else imports.where("lang = 'js' and not type_only")
    names = exploded(facts, "bindings").join(used.select("path", "seq", "n", "target"), ["path", "seq"])
    unsure = names.where("n > 1").select("path", F.col("local").alias("name"), F.lit(None).cast("string").alias("canonical"), F.lit(True).alias("unsure"))
    taken = names.where("n = 1").join(_offered_types(symbols, kinds).withColumnRenamed("path", "target"), ["target", "imported", "is_default"]).select("path", F.col("local").alias("name"), "canonical", F.lit(False).alias("unsure"))
    every = local.unionByName(unsure).unionByName(taken)
    return every.groupBy("path", "name").agg(F.countDistinct("canonical").alias("n"), F.min("canonical").alias("only"), F.max("unsure").alias("unsure"))


def _constructed(symbols: DataFrame, imports: DataFrame, facts: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """x.m() after `const x = new C()`: a method of C that isn't static."""
    scope = _types_in_scope(facts, symbols, imports, ["class"], False).withColumnRenamed("name", "cls")
    rows = calls.where("how = 'constructed'").join(scope, ["path", "cls"], "left")
    n = F.coalesce("n", F.lit(0))
    unsure = F.coalesce("unsure", F.lit(False)) | (n > 1)
    issues = issue_rows(rows.where(unsure), F.lit(AMBIGUOUS), "source", "name", F.lit("the constructed class isn't settled"))
    issues = issues.unionByName(issue_rows(rows.where(~unsure & (n == 0)), F.lit(UNRESOLVED), "source", "name", F.lit("the constructed class isn't in the index")))
    known = rows.where(~unsure & (n == 1)).withColumn("_path", F.substring_index("only", "::", 1)).withColumn("_class", F.substring_index("only", "::", -1))
    found = _methods(symbols).where("not is_static").groupBy(F.col("path").alias("_path"), F.col("owner").alias("_class"), "name").agg(F.count(F.lit(1)).alias("k"), F.min("canonical").alias("target_m"))
    sites, more = _by_count(known.join(found, ["_path", "_class", "name"], "left"), F.col("k"), "target_m", "the constructed class has no such method", "the constructed class has several such methods")
    return sites, issues.unionByName(more)


def _hierarchy(facts: DataFrame, symbols: DataFrame, scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """EXTENDS and IMPLEMENTS of TypeScript and Java, from the types in scope of each file: path, lang, name, n, only, unsure."""
    rows = exploded(facts, "heritage")
    rows = rows.join(scope.withColumnRenamed("name", "target"), ["path", "lang", "target"], "left")
    n = F.coalesce("n", F.lit(0))
    ok = (n == 1) & ~F.coalesce("unsure", F.lit(False))
    edges = rows.where(ok).select(F.col("source").alias("src"), F.col("only").alias("dst"), "kind", "line", "column")
    unsure = F.coalesce("unsure", F.lit(False)) | (n > 1)
    source = F.when(F.col("lang") == "java", F.col("path")).otherwise(F.col("source"))
    bad = rows.where(~ok).withColumn("source", source)
    return edges, issue_rows(bad, F.when(unsure, AMBIGUOUS).otherwise(UNRESOLVED), "source", "target", F.when(unsure, "several types could be meant").otherwise("no type in scope is known by this name"))


# --- Rust --------------------------------------------------------------------------------------------------


def _rust_positions(facts: DataFrame, imports: DataFrame) -> DataFrame:
    """path, root, segments: the module that each file is, from crate roots along declarations with one source file."""
    name = F.element_at(F.split("path", "/"), -1)
    slashes = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    root = name.isin("lib.rs", "main.rs") | (F.col("path").startswith("src/bin/") & (slashes == 2))
    seen = frontier = written(facts.where("lang = 'rust'").where(root).select("path").distinct().select("path", F.col("path").alias("root"), F.array().cast("array<string>").alias("segments")), "rust-modules")
    steps = imports.where("lang = 'rust' and unsupported = 'MOD' and n = 1").select("path", F.col("module").alias("_name"), F.col("target").alias("_next"))
    while not frontier.isEmpty():  # one level of nesting each time
        reached = frontier.join(steps, "path").select(F.col("_next").alias("path"), "root", F.concat("segments", F.array("_name")).alias("segments"))
        reached = reached.groupBy("path", "root").agg(F.min("segments").alias("segments"))
        frontier = written(reached.join(seen, ["path", "root"], "left_anti"), "rust-modules")
        seen = seen.unionByName(frontier)
    return written(seen, "rust-positions")


def _rust_uses(facts: DataFrame, symbols: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bindings, import edges, issues) of Rust's mod and use."""
    mods = imports.where("lang = 'rust' and unsupported = 'MOD'")
    inline = imports.where("lang = 'rust' and unsupported = 'INLINE'")
    status = F.when(F.col("n") == 0, UNRESOLVED).otherwise(AMBIGUOUS)
    issues = issue_rows(mods.where("n <> 1"), status, "path", "module", F.when(F.col("n") == 0, "the module has no source file").otherwise("the module has several source files"))
    issues = issues.unionByName(issue_rows(inline, F.lit(UNRESOLVED), "path", "module", F.lit("modules with a body here aren't entered")))
    globs = imports.where("lang = 'rust' and unsupported = 'GLOB'").withColumn("name", F.lit("*"))
    issues = issues.unionByName(issue_rows(globs, F.lit(UNRESOLVED), "path", "name", F.lit("glob uses aren't followed")))
    uses = imports.where("lang = 'rust' and unsupported = 'USE'").drop("n", "target")
    uses = uses.withColumn("_base", F.substring_index("module", "|", 1)).withColumn("_rest", F.substring_index("module", "|", -1))
    uses = uses.withColumn("_rest", F.when(F.col("_rest") == "", F.array().cast("array<string>")).otherwise(F.split("_rest", "::")))
    at = _rust_positions(facts, imports)
    here = F.when(F.col("_base") == "crate", F.array().cast("array<string>")).when(F.col("_base") == "self", F.col("segments")).when(F.size("segments") > 0, F.slice("segments", F.lit(1), F.size("segments") - 1))
    tried = uses.where("_base <> 'external'").join(at, "path").withColumn("_at", F.concat(here, F.col("_rest"))).where("_at is not null").select("path", "seq", "root", "_at")
    hit = tried.join(at.select("root", F.col("segments").alias("_at"), F.col("path").alias("_file")), ["root", "_at"])
    hit = hit.groupBy("path", "seq").agg(F.countDistinct("_file").alias("n"), F.min("_file").alias("target"))
    uses = uses.join(hit, ["path", "seq"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("name", F.lit("use"))
    status = F.when(F.col("n") == 0, UNRESOLVED).otherwise(AMBIGUOUS)
    why = F.when(F.col("_base") == "external", "paths that don't begin with crate, self or super aren't followed").when(F.col("n") == 0, "the path leads to no declared module").otherwise("the path leads to several modules")
    issues = issues.unionByName(issue_rows(uses.where("n <> 1"), status, "path", "name", why))
    functions = symbols.where("lang = 'rust' and kind = 'function'").groupBy(F.col("path").alias("target"), F.col("name").alias("imported")).agg(F.count(F.lit(1)).alias("k"), F.min("canonical").alias("symbol"))
    rows = exploded(facts, "bindings").where("lang = 'rust'").drop("lang").join(uses.select("path", "seq", "n", "target", "line", "column"), ["path", "seq"]).withColumn("target", F.when(F.col("n") == 1, F.col("target"))).join(functions, ["target", "imported"], "left")
    state = F.when(F.col("k") == 1, "RESOLVED").when((F.col("k") > 1) | (F.col("n") > 1), AMBIGUOUS).otherwise(UNRESOLVED)
    rows = rows.withColumn("state", state).withColumn("symbol", F.when(F.col("state") == "RESOLVED", F.col("symbol")))
    issues = issues.unionByName(issue_rows(rows.where("n = 1 and state <> 'RESOLVED'"), F.col("state"), "path", "local", F.lit("the module doesn't have exactly one function of this name")))
    edges = mods.where("n = 1").select("path", "target").unionByName(uses.where("n = 1").select("path", "target"))
    return rows.select("path", "local", "symbol", "state"), edges.select(F.col("path").alias("src"), F.col("target").alias("dst")), issues


# --- Go ----------------------------------------------------------------------------------------------------


def _folder(path: str = "path") -> Column:
    return F.when(F.instr(F.col(path), "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def _go_imports(facts: DataFrame, go_modules: DataFrame | None, known: bool = True) -> DataFrame:
    """Go imports with dir and pkg of the one package they lead to: the nearest go.mod above the file counts. Unless known, dir is given without a package too."""
    rows = exploded(facts, "imports").where("lang = 'go'").drop("candidates").withColumnRenamed("module", "_import")
    if go_modules is None:
        return rows.select("*", F.lit(None).cast("string").alias("dir"), F.lit(None).cast("string").alias("pkg"))
    parts = F.split(_folder(), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    near = rows.select("path").distinct().select("path", F.explode(F.array_distinct(above)).alias("root")).join(go_modules, "root")
    near = near.groupBy("path").agg(F.max_by(F.struct("root", "module"), F.length("root")).alias("m"))
    rows = rows.join(near, "path", "left")
    prefix = F.concat("m.module", F.lit("/"))
    rest = F.when(F.startswith(F.col("_import"), prefix), F.ltrim(F.substr("_import", F.length(prefix) + 1), F.lit("/")))
    rows = rows.withColumn("dir", F.when(F.col("m.root") == "", rest).otherwise(F.concat("m.root", F.lit("/"), rest)))
    packages = facts.where("lang = 'go'").groupBy(_folder().alias("dir")).agg(F.countDistinct("package").alias("_p"), F.min("package").alias("pkg")).where("_p = 1").drop("_p")
    rows = rows.join(packages, "dir", "left").drop("m")
    return rows.withColumn("dir", F.when(F.col("pkg").isNotNull(), F.col("dir"))) if known else rows


def _go_import_issues(facts: DataFrame, go_modules: DataFrame | None) -> DataFrame:
    return issue_rows(_go_imports(facts, go_modules).where("pkg is null"), F.lit(UNRESOLVED), "path", "_import", F.lit("no single package of this tree is imported by this path"))


def _go_calls(facts: DataFrame, symbols: DataFrame, go_modules: DataFrame | None, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Functions of the own package, methods of proven types, exported functions of imported packages."""
    files = facts.where("lang = 'go'").select("path", _folder().alias("dir"), F.col("package").alias("pkg"))
    own = symbols.where("lang = 'go'").join(files, "path")
    functions = own.where("kind = 'function'").groupBy("dir", "pkg", F.col("name").alias("_called")).agg(F.count(F.lit(1)).alias("k"), F.min("canonical").alias("target"))
    methods = own.where("kind = 'method'").groupBy("dir", "pkg", F.col("owner").alias("cls"), F.col("name").alias("_called")).agg(F.count(F.lit(1)).alias("k"), F.min("canonical").alias("target"))
    names = exploded(facts, "bindings").where("lang = 'go'").select("path", "seq", "local", "is_default")
    alias = _go_imports(facts, go_modules).where("pkg is not null").join(names, ["path", "seq"])
    # of several imports under one name the last counts
    alias = alias.groupBy("path", F.when(F.col("is_default"), F.col("pkg")).otherwise(F.col("local")).alias("receiver")).agg(F.max_by(F.struct("dir", "pkg"), "seq").alias("to"))
    go = calls.where("lang = 'go'").join(files, "path").withColumn("_called", F.when(F.col("how") == "direct", F.col("name")).otherwise(F.col("member")))
    far = go.where("how in ('far_method', 'package')").join(alias, ["path", "receiver"], "left").withColumn("dir", F.col("to.dir")).withColumn("pkg", F.col("to.pkg"))
    parts = [
        go.where("how = 'direct'").join(functions, ["dir", "pkg", "_called"], "left"),
        go.where("how = 'method'").join(methods, ["dir", "pkg", "cls", "_called"], "left"),
        far.where("how = 'far_method'").join(methods, ["dir", "pkg", "cls", "_called"], "left"),
        far.where("how = 'package'").join(functions, ["dir", "pkg", "_called"], "left").withColumn("k", F.when(F.col("_called").rlike(r"^\p{Lu}"), F.col("k"))),
    ]
    sites, issues = None, None
    for part in parts:
        s, i = _by_count(part, F.col("k"), "target", "no target is proven for this call", "several targets could be meant")
        sites, issues = (s, i) if sites is None else (sites.unionByName(s), issues.unionByName(i))
    return sites, issues


# --- Java --------------------------------------------------------------------------------------------------


def _java_symbols(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    return symbols.where("lang = 'java'").join(facts.select("path", "package"), "path")


def _java_import_targets(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Single-type imports with the types of that package and name: path, seq, local, n, only, its file."""
    types = _java_symbols(facts, symbols).where("kind in ('class', 'type')").select(F.col("package").alias("module"), F.col("name").alias("imported"), "canonical", F.col("path").alias("_file"))
    rows = exploded(facts, "imports").where("lang = 'java' and not coalesce(unsupported = 'STATIC', false) and not wildcard").drop("candidates")
    rows = rows.join(exploded(facts, "bindings").select("path", "seq", "local", "imported"), ["path", "seq"])
    found = types.groupBy("module", "imported").agg(F.countDistinct("canonical").alias("n"), F.min("canonical").alias("only"), F.min("_file").alias("target"))
    return rows.join(found, ["module", "imported"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _java_types(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Types in scope of a Java file: those of its package and its single-type imports."""
    types = _java_symbols(facts, symbols).where("kind in ('class', 'type')").select("package", "name", "canonical")
    files = facts.where("lang = 'java'").select("path", "package")
    wanted = exploded(facts, "heritage").where("lang = 'java'").select("path", F.col("target").alias("name"))
    wanted = wanted.unionByName(exploded(facts, "calls").where("lang = 'java' and how = 'class'").select("path", F.col("cls").alias("name"))).distinct()
    # only names that are referred to are looked up, so a package of many files isn't multiplied
    near = wanted.join(files, "path").join(types, ["package", "name"]).select("path", "name", "canonical")
    imported = _java_import_targets(facts, symbols).where("n = 1").select("path", F.col("local").alias("name"), F.col("only").alias("canonical"))
    return near.unionByName(imported).groupBy("path", "name").agg(F.countDistinct("canonical").alias("n"), F.min("canonical").alias("only"))


def _java_imports(facts: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = _java_import_targets(facts, symbols)
    edges = rows.where("n = 1").select(F.col("path").alias("src"), F.col("target").alias("dst"))
    status = F.when(F.col("n") == 0, UNRESOLVED).otherwise(AMBIGUOUS)
    issues = issue_rows(rows.where("n <> 1"), status, "path", "imported", F.when(F.col("n") == 0, "the imported type isn't in the index").otherwise("several types have the imported name"))
    static = _java_static(facts, symbols)
    edges = edges.unionByName(static.where("t_n = 1").select(F.col("path").alias("src"), F.col("file").alias("dst")))
    bad = static.where("t_n <> 1 or m_n <> 1 or m_n is null")
    many = (F.col("t_n") > 1) | (F.coalesce("m_n", F.lit(0)) > 1)
    return edges, issues.unionByName(issue_rows(bad, F.when(many, AMBIGUOUS).otherwise(UNRESOLVED), "path", "imported", F.when(many, "several members could be meant by the static import").otherwise("the static import's member isn't in the index")))


def _java_static(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Static imports with the type (t_n, file) and the static methods of the name (m_n, method) in a class without supertypes."""
    own = _java_symbols(facts, symbols)
    rows = exploded(facts, "imports").where("lang = 'java' and unsupported = 'STATIC' and not wildcard").drop("candidates").join(exploded(facts, "bindings").select("path", "seq", "local", "imported"), ["path", "seq"])
    rows = rows.withColumn("_package", F.regexp_extract("module", r"^(.*)\.[^.]+$", 1)).withColumn("_type", F.substring_index("module", ".", -1))
    types = own.where("kind in ('class', 'type')").groupBy(F.col("package").alias("_package"), F.col("name").alias("_type")).agg(F.countDistinct("canonical").alias("t_n"), F.min("path").alias("file"), F.max("hierarchy").alias("_h"))
    methods = own.where("kind = 'method' and is_static and not hierarchy").groupBy(F.col("path").alias("file"), F.col("owner").alias("_type"), F.col("name").alias("imported")).agg(F.count(F.lit(1)).alias("m_n"), F.min("canonical").alias("method"), F.max("arity").alias("arity_m"), F.max("varargs").alias("varargs_m"))
    rows = rows.join(types, ["_package", "_type"], "left").join(methods, ["file", "_type", "imported"], "left")
    return rows.withColumn("t_n", F.coalesce("t_n", F.lit(0)))


def _java_calls(facts: DataFrame, symbols: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Own methods by arity, else a static import; Class.m() by arity. Issues carry the file as their source."""
    own = symbols.where("lang = 'java' and kind = 'method'")
    methods = own.where("not varargs").groupBy("path", "owner", "name", "arity").agg(F.count(F.lit(1)).alias("k"), F.min("canonical").alias("target"))
    named = own.groupBy("path", "owner", "name").agg(F.count(F.lit(1)).alias("named"))
    owners = own.groupBy("path", "owner").agg(F.max("hierarchy").alias("inherits"))
    near = calls.where("lang = 'java' and how in ('direct', 'self')").withColumn("path_", F.col("path"))
    near = near.join(methods, ["path", "owner", "name", "arity"], "left").join(named, ["path", "owner", "name"], "left").join(owners, ["path", "owner"], "left")
    static = _java_static(facts, symbols).where("m_n = 1 and not varargs_m").groupBy("path", F.col("local").alias("name")).agg(F.countDistinct("method").alias("s_n"), F.min("method").alias("s_one"), F.min("arity_m").alias("s_arity"))
    near = near.join(static, ["path", "name"], "left")
    inherits = F.coalesce("inherits", F.lit(False))
    open_ = ~inherits | (F.col("arity") == 0)
    k = F.when(open_, F.coalesce("k", F.lit(0))).otherwise(0)
    by_import = (F.col("how") == "direct") & F.col("named").isNull() & ~inherits & (F.col("s_n") == 1) & (F.col("s_arity") == F.col("arity"))
    target = F.when(F.col("named").isNotNull(), F.col("target")).otherwise(F.col("s_one"))
    near = written(near.select("path", "source", "name", "line", "column", F.when(F.col("named").isNotNull(), k).when(by_import, 1).otherwise(0).alias("_n"), target.alias("_target")), "java-near")
    sites = _edges(near.where("_n = 1"), "_target")
    bad = near.where("_n <> 1").withColumn("source", F.col("path"))
    issues = issue_rows(bad, F.when(F.col("_n") > 1, AMBIGUOUS).otherwise(UNRESOLVED), "source", "name", F.when(F.col("_n") > 1, "several methods take these arguments").otherwise("no method here surely takes this call"))
    far = calls.where("lang = 'java' and how = 'class'").join(_java_types(facts, symbols).withColumnRenamed("name", "cls"), ["path", "cls"], "left")
    far = far.withColumn("_file", F.substring_index("only", "::", 1)).withColumn("_class", F.substring_index("only", "::", -1)).join(owners.withColumnsRenamed({"inherits": "i_own"}), ["path", "owner"], "left")
    statics = own.where("is_static and not varargs and not hierarchy").groupBy(F.col("path").alias("_file"), F.col("owner").alias("_class"), "name", "arity").agg(F.count(F.lit(1)).alias("k"), F.min("canonical").alias("target"))
    far = far.join(statics, ["_file", "_class", "name", "arity"], "left")
    ok = (F.coalesce("n", F.lit(0)) == 1) & ~F.coalesce("i_own", F.lit(False))
    far = written(far.select("path", "source", "name", "line", "column", "target", F.when(ok, F.coalesce("k", F.lit(0))).otherwise(0).alias("_n")), "java-far")
    sites = sites.unionByName(_edges(far.where("_n = 1"), "target"))
    bad = far.where("_n <> 1").withColumn("source", F.col("path"))
    return sites, issues.unionByName(issue_rows(bad, F.when(F.col("_n") > 1, AMBIGUOUS).otherwise(UNRESOLVED), "source", "name", F.lit("not one static method of one class in scope")))
