"""The index of a source tree: tables of files, facts, edges, issues and search evidence, and questions to them.

    index = Index.open(spark, root)
    print(index.find("where are routes matched"))
    print(index.inspect("src/router.ts::match"))
    print(index.trace("main", "leaf"), index.impact("leaf"), index.impact_diff())

An index is kept as Parquet below the tree, with a manifest of its files and their checksums. sync() compares
content hashes: a changed set of paths builds anew; changed contents replace the facts of these files, and only
the files that may resolve otherwise after that are resolved again.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import threading
import uuid
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import evidence
from .functions.text import parse_query
from .operators import graph, resolve, retrieve, traverse
from .sources import git, tree
from .streaming.incremental import changed_paths, refresh_rows, same_files
from .tables import written

STATE = ".tessera"
VERSION = 2
TABLES = ("files", "facts", "search", "postings", "modules", "symbols", "sites", "imports", "structural", "issues", "dependencies")
LISTED = 8
TESTS_LISTED = 3
SOURCE_LINES, SOURCE_TAIL, SOURCE_WIDTH, COMMENT_LINES = 24, 4, 180, 3


class SelectorError(ValueError):
    """No symbol, or more than one, goes by the given name."""


def search_facts(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Search evidence of every symbol; of two symbols of one canonical name, which are in one file, the last leaves its row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(evidence.SCHEMA))

    def each(batches):
        for b in batches:
            rows = [r for path, content, symbols in zip(*(b.column(k).to_pylist() for k in range(3))) for r in {r["canonical"]: r for r in evidence.of_file(path, content, symbols)}.values()]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").join(facts.select("path", "symbols"), "path").mapInArrow(each, evidence.SCHEMA)


class Index:
    def __init__(self, spark: SparkSession, root: str, folder: str):
        self.spark, self.root, self.folder = spark, os.path.abspath(root), folder

    # --- making and keeping -------------------------------------------------------------------------------

    @classmethod
    def build(cls, spark: SparkSession, root: str) -> Index:
        index = cls(spark, root, "")
        index._publish(tree.files_of(spark, index.root))
        return index

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Index:
        """The kept index brought up to date, or a new one if none can be read."""
        index = cls._kept(spark, root)
        if index is None:
            return cls.build(spark, root)
        index.sync()
        return index

    @classmethod
    def _kept(cls, spark: SparkSession, root: str) -> Index | None:
        """The kept index if its version, checksums and structure hold; anything unreadable is none."""
        state = os.path.join(os.path.abspath(root), STATE)
        try:
            with open(os.path.join(state, "current.json")) as f:
                manifest = json.load(f)
            folder = os.path.join(state, manifest["folder"])
            if manifest["version"] != VERSION or manifest["checksums"] != _checksums(folder):
                return None
            index = cls(spark, root, folder)
            return index if index.sound() else None
        except Exception:
            return None

    def sound(self) -> bool:
        """Whether every file has its facts, every symbol lies in its file, and symbols and search evidence name the same."""
        one = lambda df, c: df.select(c).distinct()
        named = resolve.exploded(self.facts, "symbols").select("path", "canonical")
        wrong = one(self.files, "path").exceptAll(one(self.facts, "path")).unionAll(one(self.facts, "path").exceptAll(one(self.files, "path")))
        wrong = wrong.unionAll(named.where(resolve.path_of("canonical") != F.col("path")).select("path"))
        wrong = wrong.unionAll(one(named, "canonical").exceptAll(one(self.search, "canonical"))).unionAll(one(self.search, "canonical").exceptAll(one(named, "canonical")))
        return wrong.isEmpty()

    def _publish(self, files: DataFrame, fresh: dict[str, DataFrame] | None = None) -> None:
        """Write all tables to a new folder and make it current by one rename. fresh has tables that needn't be made from the files."""
        state = os.path.join(self.root, STATE)
        os.makedirs(state, exist_ok=True)
        name = f"index-{uuid.uuid4().hex[:12]}"
        at = os.path.join(state, name)
        fresh = fresh or {}
        read = lambda table: self.spark.read.parquet(f"file://{at}/{table}")

        def write(table: str, made) -> None:
            (fresh[table] if table in fresh else made()).write.mode("overwrite").parquet(f"file://{at}/{table}")

        write("files", lambda: files)
        write("facts", lambda: tree.facts_of(read("files")))
        write("search", lambda: search_facts(read("files"), read("facts")))
        write("postings", lambda: retrieve.by_term(retrieve.postings(read("search"))))
        write("modules", lambda: tree.go_modules(self.spark, self.root).coalesce(1))
        write("symbols", lambda: resolve.exploded(read("facts"), "symbols").dropDuplicates())
        resolved = None if "sites" in fresh else resolve.resolve(read("facts"), read("modules"))
        for table in ("sites", "imports", "structural", "issues"):
            write(table, lambda table=table: getattr(resolved, table))
        write("dependencies", lambda: graph.dependencies(read("sites"), read("structural")))
        made = os.path.join(state, f".{name}.json")
        with open(made, "w") as f:
            json.dump({"version": VERSION, "folder": name, "checksums": _checksums(at)}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(made, os.path.join(state, "current.json"))
        old, self.folder = self.folder, at
        for table in TABLES:
            self.__dict__.pop(table, None)
        if old and os.path.dirname(old) == state:
            shutil.rmtree(old, ignore_errors=True)
        self._exclude()

    def _exclude(self) -> None:
        """Keep the state folder out of git's sight; not being able to is no failure."""
        path = os.path.join(self.root, ".git", "info", "exclude")
        try:
            text = open(path).read() if os.path.exists(path) else ""
            if f"/{STATE}/" not in text.split("\n") and os.path.isdir(os.path.dirname(path)):
                with open(path, "a") as f:
                    f.write(("" if not text or text.endswith("\n") else "\n") + f"/{STATE}/\n")
        except OSError:
            pass

    def sync(self) -> str:
        """Bring the tables up to date: "same", "refreshed" or "rebuilt"."""
        now = written(tree.files_of(self.spark, self.root), "tree")
        changes = written(changed_paths(self.files, now), "changes")
        context = sorted(map(tuple, self.modules.collect())) != sorted(map(tuple, tree.go_modules(self.spark, self.root).collect()))
        if changes.isEmpty() and not context:
            return "same"
        if context or not same_files(self.files, now):
            self._publish(now)
            return "rebuilt"
        self._refresh(now, changes.select("path"))
        return "refreshed"

    def refresh(self, path: str) -> str:
        """Take in one changed file, "refreshed"; a path that the index doesn't have as a file builds all anew, "rebuilt"."""
        relative = os.path.relpath(os.path.join(self.root, path), self.root).replace(os.sep, "/")
        known = not self.files.where(F.col("path") == relative).isEmpty()
        if not known or not os.path.isfile(os.path.join(self.root, relative)):
            self._publish(tree.files_of(self.spark, self.root))
            return "rebuilt"
        one = written(tree.read_files(self.spark, self.root, [relative]), "file")
        self._refresh(refresh_rows(self.files, one, one.select(*self.files.columns)), one.select("path"))
        return "refreshed"

    def _refresh(self, now: DataFrame, changed: DataFrame) -> None:
        """Publish tables for the files of now, of which only changed (path) differ in content."""
        fresh = now.join(changed, "path", "left_semi")
        new = written(tree.facts_of(fresh), "facts")
        facts = written(refresh_rows(self.facts, changed, new.select(*self.facts.columns)), "facts")
        touched = written(resolve.affected(self.facts, facts, changed, self.imports, self.modules), "affected")
        part = resolve.resolve(facts, self.modules, only=touched)
        kept = lambda table, c, paths: getattr(self, table).withColumn("_path", resolve.path_of(c)).join(paths.select(F.col("path").alias("_path")), "_path", "left_anti").drop("_path")
        found = search_facts(fresh, new)
        found = written(found, "search")
        tables = {
            "facts": facts,
            "search": kept("search", "canonical", changed).unionByName(found),
            "postings": retrieve.by_term(kept("postings", "canonical", changed).unionByName(retrieve.postings(found))),
            "symbols": kept("symbols", "canonical", changed).unionByName(resolve.exploded(new, "symbols").dropDuplicates()),
            "modules": self.modules,
        }
        for table, c in (("sites", "src"), ("imports", "src"), ("structural", "src"), ("issues", "source")):
            tables[table] = kept(table, c, touched).unionByName(getattr(part, table))
        tables["dependencies"] = kept("dependencies", "src", touched).unionByName(graph.dependencies(part.sites, part.structural))
        self._publish(now, tables)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"file://{self.folder}/{name}")

    files = cached_property(lambda self: self._table("files"))
    facts = cached_property(lambda self: self._table("facts"))
    search = cached_property(lambda self: self._table("search"))
    postings = cached_property(lambda self: self._table("postings"))
    symbols = cached_property(lambda self: self._table("symbols"))
    sites = cached_property(lambda self: self._table("sites"))
    imports = cached_property(lambda self: self._table("imports"))
    structural = cached_property(lambda self: self._table("structural"))
    issues = cached_property(lambda self: self._table("issues"))
    modules = cached_property(lambda self: self._table("modules"))  # go.mod folders and names
    dependencies = cached_property(lambda self: self._table("dependencies"))

    # --- the graph ----------------------------------------------------------------------------------------

    def defining_file(self, canonical: str) -> str | None:
        row = self.listed().where(F.col("canonical") == canonical).select("path").first()
        return row and row["path"]

    def imported_files(self, path: str) -> DataFrame:
        """path of the files that a file imports, sorted."""
        return self.imports.where(F.col("src") == path).select(F.col("dst").alias("path")).distinct().orderBy("path")

    def callers(self, canonical: str) -> DataFrame:
        """canonical of those that call a symbol, sorted."""
        return self.sites.where(F.col("dst") == canonical).select(F.col("src").alias("canonical")).distinct().orderBy("canonical")

    def callees(self, canonical: str) -> DataFrame:
        """canonical of those that a symbol calls, sorted."""
        return self.sites.where(F.col("src") == canonical).select(F.col("dst").alias("canonical")).distinct().orderBy("canonical")

    def call_sites(self, src: str, dst: str) -> DataFrame:
        """line, column of the calls of dst in src, sorted."""
        return self.sites.where((F.col("src") == src) & (F.col("dst") == dst)).select("line", "column").orderBy("line", "column")

    def dependents(self, canonical: str) -> DataFrame:
        """src, kind, line, column of the edges that lead to a symbol, sorted."""
        return self.dependencies.where(F.col("dst") == canonical).select("src", "kind", "line", "column").orderBy("src", graph.kind_order(), "line", "column")

    # --- symbols ------------------------------------------------------------------------------------------

    def listed(self) -> DataFrame:
        """Symbols with the path of their file."""
        return self.symbols.withColumn("path", F.substring_index("canonical", "::", 1))

    @staticmethod
    def line(s) -> str:
        return f"{s['canonical']} [{s['kind']} {s['path']}:{s['line']}:{s['column']}]"

    def select(self, name: str):
        """The one symbol of a canonical name, or else of a plain name."""
        rows = self.listed().where((F.col("canonical") == name) | (F.col("name") == name)).orderBy("canonical", "line").collect()
        found = [r for r in rows if r["canonical"] == name] or rows
        if not found:
            raise SelectorError(f"No symbol matches '{name}'.")
        if len(found) > 1:
            raise SelectorError("\n".join([f"Target '{name}' is ambiguous; name one of:", *(f"- {self.line(r)}" for r in found)]))
        return found[0]

    def _lines(self, nodes: DataFrame) -> list:
        """Symbol rows of a frame with node, in order of their names, with its other columns."""
        return self.listed().join(nodes.withColumnRenamed("node", "canonical"), "canonical").orderBy("canonical").collect()

    # --- questions ----------------------------------------------------------------------------------------

    def _nothing(self) -> str | None:
        if self.files.isEmpty():
            *most, last = (f".{e}" for e in tree.LANGUAGES)
            return f"No supported source files. Supported: {', '.join(most)}, and {last}."
        return None

    def ranked(self, query: str) -> DataFrame:
        """All that find() admits, with the parts of each score, in no order."""
        return retrieve.ranked(self.listed(), self.postings, self.dependencies, query)

    def diagnose(self, query: str) -> DataFrame:
        """What find() goes by: term, df, idf of the query's terms joined to each shown row's evidence and parts of the score."""
        rows = written(self.ranked(query).orderBy(*retrieve.best_first()).limit(retrieve.SHOWN), "shown")
        evidence_rows = written(retrieve.term_evidence(self.postings, parse_query(query)), "evidence")
        total = F.lit(self.symbols.count())
        df = evidence_rows.groupBy("qterm").agg(F.count(F.lit(1)).alias("df"))
        idf = F.least(F.lit(3.0), F.log((total - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
        parts = evidence_rows.join(rows.select("canonical"), "canonical", "left_semi").join(df.withColumn("idf", idf), "qterm").withColumnRenamed("fields", "term_fields")
        return rows.join(parts, "canonical", "left").orderBy(*retrieve.best_first(), "qterm")

    def find(self, query: str) -> str:
        if message := self._nothing():
            return message
        rows = written(self.ranked(query), "ranked")
        at = self.listed().groupBy("canonical").agg(F.min(F.struct("line", "column")).alias("at"))
        first = rows.orderBy(*retrieve.best_first()).limit(retrieve.SHOWN).join(at, "canonical").select(*rows.columns, "at.line", "at.column").orderBy(*retrieve.best_first()).collect()
        if not first:
            return f"Nothing found for '{query}'."
        total = rows.count()
        out = []
        if retrieve.limited_confidence(first):
            out.append("Confidence is limited: several areas are close, or few confirmed edges support the leader. Read the first results as alternatives.")
        if total > len(first):
            out.append(f"The top {len(first)} of {total} matches:")
        out.append(f"{len(first)} symbol(s):")
        out += [f"{self.line(r)} [{' + '.join(f for f in retrieve.FIELDS if f in r['fields']) or 'all symbols'}; score {r['score']:.3f}]" for r in first]
        return "\n".join(out)

    def _sites(self, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], str]:
        """What to print of the call sites of each pair; one job for all."""
        if not pairs:
            return {}
        wanted = self.spark.createDataFrame(sorted(set(pairs)), "src string, dst string")
        found = self.sites.join(wanted, ["src", "dst"]).groupBy("src", "dst").agg(F.sort_array(F.collect_set(F.struct("line", "column"))).alias("at"))
        out = dict.fromkeys(pairs, "")
        for r in found.select("src", "dst", F.size("at").alias("n"), F.slice("at", 1, LISTED).alias("at")).collect():
            path = r["src"].split("::")[0]
            shown = ", ".join(f"{path}:{a['line']}:{a['column']}" for a in r["at"])
            more = f", … {r['n'] - LISTED} more" if r["n"] > LISTED else ""
            out[r["src"], r["dst"]] = f" [call{'s' * (r['n'] > 1)} at {shown}{more}]"
        return out

    def _evidence(self, rows: list) -> list[str]:
        """A line for each row of an impact that names its edge."""
        sites = self._sites([(r["canonical"], r["via"]) for r in rows if r["_kind"] == "CALLS"])
        at = lambda r: sites[r["canonical"], r["via"]] if r["_kind"] == "CALLS" else f" [declared at {r['canonical'].split('::')[0]}:{r['_line']}:{r['_column']}]"
        return [f"- {r['canonical']} {r['_kind']} {r['via']}{at(r)}" for r in rows]

    @staticmethod
    def _bounded(title: str, items: list[str], what: str) -> list[str]:
        out = [f"{title}:" + (" none" if not items else "")]
        out += [f"- {i}" for i in items[:LISTED]]
        return out + ([f"- … {len(items) - LISTED} more {what}"] if len(items) > LISTED else [])

    def source_window(self, symbol) -> list[str]:
        """The numbered lines of a symbol, with the comment above it, the middle of a long one left out."""
        try:
            lines = open(os.path.join(self.root, symbol["path"]), encoding="utf-8").read().splitlines()
        except (OSError, UnicodeDecodeError):
            return ["Source context: unavailable"]
        start = symbol["line"] - 1
        if start >= len(lines):
            return ["Source context: unavailable (the symbol lies outside the current source)"]
        first = start
        while first > 0 and start - first < COMMENT_LINES:
            above = lines[first - 1].lstrip()
            if not (above.startswith(("//", "/*", "*", "#", '"""', "'''")) or above.endswith("*/")):
                break
            first -= 1
        end = min(symbol["end_line"], len(lines))

        def shown(a: int, b: int) -> list[str]:
            rows = []
            for k in range(a, b):
                text = lines[k].rstrip()
                rows.append(f"{k + 1:>5} | {text[:SOURCE_WIDTH]}{'…' if len(text) > SOURCE_WIDTH else ''}")
            return rows

        out = [f"Source context ({first + 1}-{end}):"]
        if end - first <= SOURCE_LINES:
            return out + shown(first, end)
        head = SOURCE_LINES - SOURCE_TAIL
        return [*out, *shown(first, first + head), f"  … {end - first - SOURCE_LINES} source lines omitted …", *shown(end - SOURCE_TAIL, end)]

    def likely_tests(self, symbol) -> DataFrame:
        """canonical, score of test symbols near a symbol, best first."""
        found = retrieve.likely_tests(self.listed(), self.search, self.sites, symbol["canonical"], evidence.terms(symbol["name"]))
        return found.orderBy(F.desc("score"), "canonical")

    def inspect(self, name: str) -> str:
        if message := self._nothing():
            return message
        s = self.select(name)
        me = s["canonical"]
        callers = self._lines(self.sites.where(F.col("dst") == me).select(F.col("src").alias("node")).distinct())
        callees = self._lines(self.sites.where(F.col("src") == me).select(F.col("dst").alias("node")).distinct())
        out = [self.line(s), f"Defining file: {s['path']}", *self.source_window(s)]
        sites = self._sites([(r["canonical"], me) for r in callers[:LISTED]] + [(me, r["canonical"]) for r in callees[:LISTED]])
        out += self._bounded("Direct callers", [self.line(r) + sites.get((r["canonical"], me), "") for r in callers], "callers")
        out += self._bounded("Direct callees", [self.line(r) + sites.get((me, r["canonical"]), "") for r in callees], "callees")
        out += self._bounded("Imports of the file", [r["dst"] for r in self.imports.where(F.col("src") == s["path"]).orderBy("dst").collect()], "imports")
        tests = self.likely_tests(s).limit(TESTS_LISTED).collect()
        if tests:
            lines = {r["canonical"]: self.line(r) for r in self._lines(self.spark.createDataFrame([(t["canonical"],) for t in tests], "node string"))}
            out += ["Tests that may be relevant (by likeness, not by edges):", *(f"- {lines[t['canonical']]}" for t in tests)]
        issues = self.issues.where(F.col("source") == me).orderBy("line", "column", "name").collect()
        out += self._bounded("Open outgoing calls", [f"{i['status']} {i['line']}:{i['column']} '{i['name']}' — {i['detail']}" for i in issues], "issues")
        return "\n".join(out)

    def trace(self, start: str, end: str) -> str:
        if message := self._nothing():
            return message
        a, b = self.select(start)["canonical"], self.select(end)["canonical"]
        path = traverse.trace(self.sites.select("src", "dst"), a, b)
        if path is None:
            return f"No confirmed call path from {a} to {b} is known. Dynamic and unresolved calls aren't part of the graph."
        sites = self._sites(list(zip(path, path[1:])))
        return "\n".join([f"Call path ({len(path) - 1} calls):", *path, *(f"- {x} CALLS {y}{sites[x, y]}" for x, y in zip(path, path[1:]))])

    def _impact(self, roots: list[str]) -> tuple[list, bool]:
        rows, cut_short = traverse.impact_within_budget(self.dependencies, self.spark.createDataFrame([(r,) for r in roots], "node string"))
        return self._lines(rows.withColumnsRenamed({"line": "_line", "column": "_column", "kind": "_kind"})), cut_short

    def _levels(self, rows: list, cut_short: bool) -> list[str]:
        out = []
        for depth in sorted({r["depth"] for r in rows}):
            level = [r for r in rows if r["depth"] == depth]
            out += [f"Depth {depth}:", *(f"- {self.line(r)}" for r in level)]
        return [*out, f"Affected symbols: {len(rows)}" + (f" (stopped at {traverse.BUDGET})" if cut_short else "")]

    def impact(self, name: str) -> str:
        if message := self._nothing():
            return message
        s = self.select(name)
        rows, cut_short = self._impact([s["canonical"]])
        out = [f"Confirmed impact of {s['canonical']}", *self._levels(rows, cut_short)]
        direct = [r for r in rows if r["depth"] == 1]
        if direct:
            out += ["Evidence:", *self._evidence(direct)]
        hidden = self.issues.where(F.col("name") == s["name"]).orderBy("source", "line", "column").collect()
        if hidden:
            out += ["Completeness: incomplete, these open references may hide dependents:", *(f"- {i['status']} {i['source']}:{i['line']}:{i['column']} '{i['name']}' — {i['detail']}" for i in hidden)]
        else:
            out.append("Completeness: no open reference has this name; dynamic and framework dependencies lie outside the graph.")
        return "\n".join(out)

    def impact_diff(self) -> str:
        """The impact of the working tree's changes against HEAD."""
        if message := self._nothing():
            return message
        git.require_head(self.root)
        ours = lambda p: p == STATE or p.startswith(STATE + "/")
        changes = [(k, p) for k, p in git.changes(self.root) if not ours(p)]
        modified = [p for k, p in changes if k == "M" and tree.language(p)]
        unsupported = [f"{k} {p}" for k, p in changes if not tree.language(p)]
        unmapped = [f"{k} {p}" for k, p in changes if k != "M" and tree.language(p)]
        untracked = [p for p in git.untracked(self.root) if tree.language(p) and not ours(p)]
        spark = self.spark
        wanted = spark.createDataFrame([(p,) for p in modified], "path string")
        hunks = git.hunks(spark, self.root).join(wanted, "path", "left_semi").withColumn("hunk", F.monotonically_increasing_id()).cache()
        old = tree.facts_of(spark.createDataFrame([(p, tree.language(p), git.at_head(self.root, p)) for p in modified], "path string, lang string, content string"))
        old_spans = resolve.exploded(old, "symbols").select("path", "canonical", "line", "end_line")
        new_spans = self.listed().select("path", "canonical", "line", "end_line")
        fresh = narrowest(expand(hunks, "new"), new_spans).select("hunk", "path", F.col("canonical").alias("node"), F.lit(None).cast("string").alias("gone"))
        unique = graph.unique_symbols(self.symbols).withColumn("_now", F.lit(True))
        before = narrowest(expand(hunks, "old"), old_spans).join(unique, "canonical", "left")
        stale = before.select("hunk", "path", F.when(F.col("_now"), F.col("canonical")).alias("node"), F.when(F.col("_now").isNull(), F.col("canonical")).alias("gone"))
        hits = fresh.unionByName(stale).cache()
        exact = sorted(r[0] for r in hits.where("node is not null").select("node").distinct().collect())
        gone = sorted(r[0] for r in hits.where("gone is not null").select("gone").distinct().collect())
        loose = sorted({r[0] for r in hunks.join(hits.select("hunk").distinct(), "hunk", "left_anti").select("path").distinct().collect()} | ({*modified} - {r[0] for r in hunks.select("path").distinct().collect()}))
        whole = sorted(r[0] for r in new_spans.where(F.col("path").isin(loose)).select("canonical").distinct().collect() if r[0] not in exact) if loose else []
        roots = exact + whole
        rows, cut_short = self._impact(roots) if roots else ([], False)
        out = ["Impact of the working tree against HEAD"]
        for title, items in (("Changed symbols", exact), ("Symbols of files changed outside any symbol", whole), ("Deleted symbols", gone), ("Files not mapped to symbols", unmapped), ("Unsupported files", unsupported), ("Untracked source files", untracked)):
            out += [f"{title}:" + (" none" if not items else ""), *(f"- {i}" for i in items)]
        out += self._levels(rows, cut_short)
        out += self._evidence([r for r in rows if r["depth"] == 1])
        out.append(f"Total changed symbols: {len(exact)}")
        open_issues = self.issues.where(F.split("source", "::")[0].isin(modified)).orderBy("source", "line", "column").collect() if modified else []
        reasons = sorted({
            *(f"changes of {p} lie outside its symbols, all of them were taken" for p in loose),
            *(f"{c} is gone" for c in gone),
            *(f"{p} is no plain modification" for p in unmapped),
            *(f"{u} has no supported language" for u in unsupported),
            *(f"{p} isn't tracked" for p in untracked),
            *(f"{i['source'].split('::')[0]} has open references" for i in open_issues),
            *(["the walk stopped at its budget"] if cut_short else []),
        })
        out.append("Completeness: incomplete:" if reasons else "Completeness: every change was mapped")
        out += [f"- {r}" for r in reasons]
        out += [f"- {i['status']} {i['source']}:{i['line']}:{i['column']} '{i['name']}' — {i['detail']}" for i in open_issues]
        return "\n".join(out)


def _checksums(folder: str) -> dict[str, str]:
    """SHA-256 of every data file below a folder, by its path there."""
    out = {}
    for at, _, names in os.walk(folder):
        for n in names:
            if n.endswith(".parquet"):
                with open(os.path.join(at, n), "rb") as f:
                    out[os.path.relpath(os.path.join(at, n), folder)] = hashlib.file_digest(f, "sha256").hexdigest()
    return out


class Live:
    """One index for several threads: every question is asked after a sync, one at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self._index, self._lock = Index.open(spark, root), threading.Lock()

    def ask(self, question: str, *names: str) -> str:
        """find, inspect, trace, impact or impact_diff with their arguments."""
        if question not in ("find", "inspect", "trace", "impact", "impact_diff"):
            raise ValueError(f"no such question: {question}")
        with self._lock:
            self._index.sync()
            return getattr(self._index, question)(*names)


def expand(hunks: DataFrame, side: str) -> DataFrame:
    """hunk, path, changed: every line of one side of the hunks."""
    lines = F.sequence(F.col(f"{side}_start"), F.col(f"{side}_start") + F.col(f"{side}_count") - 1)
    return hunks.where(F.col(f"{side}_count") > 0).select("hunk", "path", F.explode(lines).alias("changed"))


def narrowest(changed: DataFrame, spans: DataFrame) -> DataFrame:
    """hunk, path, canonical: of each changed line the narrowest span that holds it; the path joins, the span filters."""
    inside = changed.join(spans, "path").where("changed between line and end_line")
    best = inside.groupBy("hunk", "path", "changed").agg(F.min(F.struct((F.col("end_line") - F.col("line")).alias("w"), "canonical")).alias("m"))
    return best.select("hunk", "path", "m.canonical").distinct()
