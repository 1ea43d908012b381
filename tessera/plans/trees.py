"""Queries that write sources out of the driver's tables and read their graph back, each with SQL for the same edges.

Suppliers are modules with functions and classes, nations are the packages that hold them, and every customer
is a file that refers to the first supplier of its nation, or to `nothing` where the nation has none. SQL knows
from the keys alone which edges must come out, so extraction, resolution and refreshing are held against an
independent oracle in all five languages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve
from ..sources import tree
from ..streaming.incremental import refresh_rows
from ..tables import small_broadcasts, written


def _text(template: str):
    """A text with {column} places filled in."""
    parts = []
    for k, piece in enumerate(template.replace("{", "\0{").replace("}", "\0").split("\0")):
        parts.append(F.col(piece[1:]).cast("string") if k and piece.startswith("{") else F.lit(piece.replace("«", "{").replace("»", "}")))
    return F.concat(*parts)


def _files(rows: DataFrame, lang: str, path: str, content) -> DataFrame:
    return rows.select(_text(path).alias("path"), F.lit(lang).alias("lang"), (_text(content) if isinstance(content, str) else content).alias("content"))


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(suppliers k, n, r; customers c, n, r, k with k null where there is none; nations n, r)."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    nation = read("nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    supplier = read("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n")).join(F.broadcast(nation), "n")
    first = supplier.groupBy("n").agg(F.min("k").alias("k"))
    customer = read("customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n")).join(F.broadcast(nation), "n").join(first, "n", "left")
    return supplier, customer, nation


def _lines(suppliers: DataFrame, nations: DataFrame, line) -> DataFrame:
    """n, lines: a text of one line or more for each supplier of a nation, in order of the keys; empty without any."""
    held = suppliers.withColumn("line", line).groupBy("n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "").alias("lines"))
    return nations.join(held, "n", "left").withColumn("lines", F.coalesce("lines", F.lit("")))


def js_files(spark: SparkSession, d: str) -> DataFrame:
    """Functions reach customers through barrels: re-exported (even keys) or imported and listed under another name (odd ones)."""
    s, c, n = _tables(spark, d)
    even = F.col("k") % 2 == 0
    line = F.when(even, _text("export « f{k} » from './s{k}';\n")).otherwise(_text("import « f{k} » from './s{k}';\nexport « f{k} as h{k} »;\n"))
    name = F.when(even, F.lit("f")).otherwise(F.lit("h"))
    out = _files(s, "js", "s{k}.ts", "export function f{k}() «»\nexport class S{k} «\n  go() « this.stop(); »\n  stop() «»\n»\n")
    out = out.unionByName(_files(_lines(s, n, line), "js", "n{n}.ts", "{lines}"))
    known = c.where("k is not null").withColumn("name", name)
    out = out.unionByName(_files(known, "js", "c{c}.ts", "import « {name}{k} as reach » from './n{n}';\nimport « S{k} » from './s{k}';\nexport function run() « reach(); const x = new S{k}(); x.go(); »\n"))
    return out.unionByName(_files(c.where("k is null"), "js", "c{c}.ts", "import « nothing » from './n{n}';\nexport function run() « nothing(); »\n"))


def python_files(spark: SparkSession, d: str) -> DataFrame:
    s, c, _ = _tables(spark, d)
    out = _files(s, "python", "p/s{k}.py", "class S:\n    def go(self):\n        self.stop()\n\n    def stop(self):\n        pass\n\n\ndef f{k}():\n    pass\n")
    out = out.unionByName(_files(c.where("k is not null"), "python", "p/q/c{c}.py", "from ..s{k} import f{k} as reach\n\n\ndef run():\n    reach()\n    own()\n\n\ndef own():\n    pass\n"))
    return out.unionByName(_files(c.where("k is null"), "python", "p/q/c{c}.py", "def run():\n    nothing()\n"))


def go_files(spark: SparkSession, d: str) -> DataFrame:
    """Region 1 is a module of its own inside the outer one; every third customer goes by the outer name, which fails there."""
    s, c, _ = _tables(spark, d)
    out = _files(s, "go", "r{r}/n{n}/s{k}.go", "package n{n}\n\nfunc F{k}() « help{k}() »\nfunc help{k}() «»\n\ntype T{k} struct«»\n\nfunc (t *T{k}) Go() « t.Stop() »\nfunc (t *T{k}) Stop() «»\n")
    module = F.when((F.col("r") == 1) & (F.col("c") % 3 != 0), F.lit("ex.com/one")).otherwise(_text("ex.com/top/r{r}"))
    known = c.where("k is not null").withColumn("m", module)
    out = out.unionByName(_files(known, "go", "r{r}/c{c}/c.go", 'package c{c}\n\nimport "{m}/n{n}"\n\nfunc Run(t *n{n}.T{k}) «\n\tn{n}.F{k}()\n\tt.Go()\n\tn{n}.help{k}()\n»\n'))
    return out.unionByName(_files(c.where("k is null"), "go", "r{r}/c{c}/c.go", "package c{c}\n\nfunc Run() « nothing() »\n"))


def go_modules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("", "ex.com/top"), ("r1", "ex.com/one")], "root string, module string")


def java_files(spark: SparkSession, d: str) -> DataFrame:
    s, c, n = _tables(spark, d)
    out = _files(s, "java", "src/n{n}/S{k}.java", "package n{n};\npublic class S{k} «\n  public static int help(int x) « return x; »\n  public static int more(int x) « return help(x); »\n»\n")
    out = out.unionByName(_files(s, "java", "src/n{n}/D{k}.java", "package n{n};\nclass D{k} extends S{k} implements I{n} «»\n"))
    out = out.unionByName(_files(n, "java", "src/n{n}/I{n}.java", "package n{n};\ninterface I{n} «»\n"))
    out = out.unionByName(_files(c.where("k is not null"), "java", "src/c/C{c}.java", "package c;\nimport n{n}.S{k};\nimport static n{n}.S{k}.more;\nclass C{c} «\n  void run() « S{k}.help(1); more(2); »\n»\n"))
    return out.unionByName(_files(c.where("k is null"), "java", "src/c/C{c}.java", "package c;\nclass C{c} «\n  void run() « nothing(); »\n»\n"))


def rust_files(spark: SparkSession, d: str) -> DataFrame:
    s, c, n = _tables(spark, d)
    out = _files(s, "rust", "src/n{n}/s{k}.rs", "pub struct T;\nimpl T «\n    pub fn a(&self) « self.b(); »\n    fn b(&self) «»\n»\npub fn f{k}() «»\n")
    out = out.unionByName(_files(_lines(s, n, _text("mod s{k};\nuse self::s{k}::f{k};\npub fn go{k}() « f{k}(); »\n")), "rust", "src/n{n}.rs", "{lines}"))
    out = out.unionByName(_files(c.where("k is not null"), "rust", "src/c{c}.rs", "use crate::n{n}::s{k}::f{k} as reach;\npub fn run() « reach(); »\n"))
    out = out.unionByName(_files(c.where("k is null"), "rust", "src/c{c}.rs", "pub fn run() « nothing(); »\n"))
    mods = n.select(_text("mod n{n};\n").alias("m")).unionByName(c.select(_text("mod c{c};\n").alias("m")))
    # in order, put together by their beginnings first, all of one length: no task sorts all of them
    root = mods.groupBy(F.substring("m", 1, 8).alias("k")).agg(F.array_join(F.array_sort(F.collect_list("m")), "").alias("line"))
    root = root.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "").alias("all"))
    return out.unionByName(_files(root, "rust", "src/lib.rs", "{all}"))


FILES = {"js": js_files, "python": python_files, "go": go_files, "java": java_files, "rust": rust_files}


def rows_of(r: resolve.Resolved) -> DataFrame:
    """kind, src, dst: calls, imports, hierarchy, and the open references to `nothing`."""
    out = r.sites.select(F.lit("CALLS").alias("kind"), "src", "dst").unionByName(r.imports.select(F.lit("IMPORTS").alias("kind"), "src", "dst"))
    out = out.unionByName(r.structural.select("kind", "src", "dst"))
    return out.unionByName(r.issues.where("name = 'nothing'").select(F.lit("OPEN").alias("kind"), F.col("source").alias("src"), F.col("status").alias("dst"))).distinct()


def _tree(lang: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        files = written(FILES[lang](spark, d), f"files-{lang}")
        facts = written(tree.facts_of(files, spread=True), f"tree-{lang}")
        return rows_of(resolve.resolve(facts, go_modules(spark)))

    query.__name__ = f"tree_{lang}"
    query.__doc__ = f"Edges of the sources in {lang} that the tables are written out as."
    return query


def incremental_edges(spark: SparkSession, d: str) -> DataFrame:
    """All languages' edges after the functions of suppliers with even keys got another name: the affected files resolved again, the rest kept.

    AFFECTED rows name the JS and Python files that were.
    """
    with small_broadcasts(spark):
        files = written(reduce(DataFrame.unionByName, (f(spark, d) for f in FILES.values())), "incremental-files")
        supplier = F.col("path").rlike(r"(^|/)[sS]\d*[02468]\.(ts|py|go|java|rs)$")
        edited = files.where(supplier).withColumn("content", F.regexp_replace("content", r"(function |def |func |fn )([fF])(\d)", "$1x$3"))
        edited = edited.withColumn("content", F.when(F.col("lang") == "java", F.regexp_replace("content", "int help", "int xelp")).otherwise(F.col("content")))
        facts = written(tree.facts_of(files, spread=True), "incremental-facts")
        modules = go_modules(spark)
        old = resolve.resolve(facts, modules)
        changed = written(edited.select("path"), "incremental-changed")
        after = written(refresh_rows(facts, changed, tree.facts_of(edited, spread=True).select(*facts.columns)), "incremental-after")
        touched = written(resolve.affected(facts, after, changed, old.imports, modules), "incremental-affected")
        part = resolve.resolve(after, modules, only=touched)
        kept = rows_of(old).withColumn("path", resolve.path_of("src")).join(touched, "path", "left_anti").drop("path")
        named = touched.where("path rlike '(ts|py)$'").select(F.lit("AFFECTED").alias("kind"), F.col("path").alias("src"), F.lit("").alias("dst"))
        return written(kept.unionByName(rows_of(part)).unionByName(named), "incremental-edges")


_BASE = """s as (select s_suppkey as k, s_nationkey as n, n_regionkey as r from supplier join nation on n_nationkey = s_nationkey),
c as (select c_custkey as c, c_nationkey as n, n_regionkey as r, (select min(s_suppkey) from supplier where s_nationkey = c_nationkey) as k from customer join nation on n_nationkey = c_nationkey)"""


def _select(kind: str, src: str, dst: str, table: str, where: str = "true") -> str:
    return f"select '{kind}' as kind, {src} as src, {dst} as dst from {table} where {where}"


def _sql(lang: str, live: str = "true") -> list[str]:
    """The rows of a language; `live` tells which suppliers' functions can still be found."""
    known = "k is not null"
    if lang == "js":
        out = [
            _select("CALLS", "'s' || k || '.ts::S' || k || '.go'", "'s' || k || '.ts::S' || k || '.stop'", "s"),
            _select("CALLS", "'c' || c || '.ts::run'", "'s' || k || '.ts::f' || k", "c", f"{known} and {live}"),
            _select("CALLS", "'c' || c || '.ts::run'", "'s' || k || '.ts::S' || k || '.go'", "c", known),
            _select("IMPORTS", "'n' || n || '.ts'", "'s' || k || '.ts'", "s"),
            _select("IMPORTS", "'c' || c || '.ts'", "'n' || n || '.ts'", "c"),
            _select("IMPORTS", "'c' || c || '.ts'", "'s' || k || '.ts'", "c", known),
            _select("OPEN", "'c' || c || '.ts'", "'UNRESOLVED'", "c", "k is null"),
            _select("OPEN", "'c' || c || '.ts::run'", "'UNRESOLVED'", "c", "k is null"),
        ]
    elif lang == "python":
        out = [
            _select("CALLS", "'p/s' || k || '.py::S.go'", "'p/s' || k || '.py::S.stop'", "s"),
            _select("CALLS", "'p/q/c' || c || '.py::run'", "'p/s' || k || '.py::f' || k", "c", f"{known} and {live}"),
            _select("CALLS", "'p/q/c' || c || '.py::run'", "'p/q/c' || c || '.py::own'", "c", known),
            _select("IMPORTS", "'p/q/c' || c || '.py'", "'p/s' || k || '.py'", "c", known),
            _select("OPEN", "'p/q/c' || c || '.py::run'", "'UNRESOLVED'", "c", "k is null"),
        ]
    elif lang == "go":
        s, c = "'r' || r || '/n' || n || '/s' || k || '.go::", "'r' || r || '/c' || c || '/c.go::Run'"
        found = f"{known} and not (r = 1 and c % 3 = 0)"
        f = f"case when {live} then 'F' else 'x' end"
        out = [
            _select("CALLS", f"{s}' || {f} || k", f"{s}help' || k", "s"),
            _select("CALLS", f"{s}T' || k || '.Go'", f"{s}T' || k || '.Stop'", "s"),
            _select("CALLS", c, f"{s}F' || k", "c", f"{found} and {live}"),
            _select("CALLS", c, f"{s}T' || k || '.Go'", "c", found),
            _select("OPEN", c, "'UNRESOLVED'", "c", "k is null"),
        ]
    elif lang == "java":
        s, c = "'src/n' || n || '/S' || k || '.java::S' || k || '.", "'src/c/C' || c || '.java"
        out = [
            _select("CALLS", f"{s}more'", f"{s}help'", "s", live),
            _select("CALLS", f"{c}::C' || c || '.run'", f"{s}help'", "c", f"{known} and {live}"),
            _select("CALLS", f"{c}::C' || c || '.run'", f"{s}more'", "c", known),
            _select("IMPORTS", f"{c}'", "'src/n' || n || '/S' || k || '.java'", "c", known),
            _select("EXTENDS", "'src/n' || n || '/D' || k || '.java::D' || k", "'src/n' || n || '/S' || k || '.java::S' || k", "s"),
            _select("IMPLEMENTS", "'src/n' || n || '/D' || k || '.java::D' || k", "'src/n' || n || '/I' || n || '.java::I' || n", "s"),
            _select("OPEN", f"{c}'", "'UNRESOLVED'", "c", "k is null"),
        ]
    else:
        s = "'src/n' || n || '/s' || k || '.rs"
        out = [
            _select("CALLS", f"{s}::T.a'", f"{s}::T.b'", "s"),
            _select("CALLS", "'src/n' || n || '.rs::go' || k", f"{s}::f' || k", "s", live),
            _select("CALLS", "'src/c' || c || '.rs::run'", f"{s}::f' || k", "c", f"{known} and {live}"),
            _select("IMPORTS", "'src/lib.rs'", "'src/n' || n_nationkey || '.rs'", "nation"),
            _select("IMPORTS", "'src/lib.rs'", "'src/c' || c || '.rs'", "c"),
            _select("IMPORTS", "'src/n' || n || '.rs'", f"{s}'", "s"),
            _select("IMPORTS", "'src/c' || c || '.rs'", f"{s}'", "c", known),
            _select("OPEN", "'src/c' || c || '.rs::run'", "'UNRESOLVED'", "c", "k is null"),
        ]
    return out


_ODD = "k % 2 = 1"
_AFFECTED = [
    _select("AFFECTED", "'s' || k || '.ts'", "''", "s", "k % 2 = 0"),
    _select("AFFECTED", "'p/s' || k || '.py'", "''", "s", "k % 2 = 0"),
    "select distinct 'AFFECTED', 'n' || n || '.ts', '' from s where k % 2 = 0",
    # through the nation's barrel, or straight from the supplier
    _select("AFFECTED", "'c' || c || '.ts'", "''", "c", "n in (select n from s where k % 2 = 0)"),
    _select("AFFECTED", "'p/q/c' || c || '.py'", "''", "c", "k % 2 = 0"),
]

QUERIES = {f"tree_{lang}": _tree(lang) for lang in FILES} | {"incremental_edges": incremental_edges}
ORACLE_SQL = {f"tree_{lang}": f"with {_BASE} " + " union all ".join(_sql(lang)) for lang in FILES}
ORACLE_SQL["incremental_edges"] = f"with {_BASE} " + " union all ".join([x for lang in FILES for x in _sql(lang, _ODD)] + _AFFECTED)
