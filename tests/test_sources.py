"""Small sources of our own through extraction and resolution, and the index over a tree."""

import subprocess

import pytest

from tessera.engine import Index, SelectorError
from tessera.operators.resolve import resolve
from tessera.sources import tree
from tessera.tables import written


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """These tables have a few rows each."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def resolved(spark, files):
    rows = [(p, tree.language(p), t) for p, t in files.items()]
    r = resolve(written(tree.facts_of(spark.createDataFrame(rows, "path string, lang string, content string")), "facts"))
    calls = {(x["src"], x["dst"]) for x in r.sites.collect()}
    return calls, {tuple(x) for x in r.imports.collect()}, {(x["src"], x["kind"], x["dst"]) for x in r.structural.collect()}, {(x["status"], x["source"], x["name"]) for x in r.issues.collect()}


def test_python(spark):
    calls, imports, _, issues = resolved(spark, {
        "pkg/a.py": "from .b import leaf as l, missing\nimport os\nfrom .two import x\n\n\ndef run(callback):\n    l()\n    callback()\n    missing()\n    os.getcwd()\n\n\nclass C:\n    def go(me):\n        me.step()\n        me.nothing()\n\n    def step(self):\n        self = None\n        self.go()\n\n    @staticmethod\n    def s(x):\n        x.step()\n",
        "pkg/b.py": "hidden = 1\n\n\ndef leaf():\n    inner(leaf())\n\n\ndef inner(x):\n    hidden()\n    y = x\n    y()\n",
        "pkg/two.py": "def x(): pass\n",
        "pkg/two/__init__.py": "def x(): pass\n",
        "broken.py": "def ok():\n    return ok2()\n\ndef ok2(): pass\n\ndef bad(:\n",
    })
    assert calls == {("pkg/a.py::run", "pkg/b.py::leaf"), ("pkg/a.py::C.go", "pkg/a.py::C.step"), ("pkg/b.py::leaf", "pkg/b.py::inner"), ("pkg/b.py::leaf", "pkg/b.py::leaf"), ("broken.py::ok", "broken.py::ok2")}
    assert imports == {("pkg/a.py", "pkg/b.py")}
    assert {("AMBIGUOUS", "pkg/a.py", ".two"), ("UNRESOLVED", "pkg/a.py", "os"), ("UNRESOLVED", "pkg/a.py", "missing"), ("UNRESOLVED", "pkg/a.py::run", "missing"), ("UNRESOLVED", "pkg/a.py::run", "callback"), ("UNRESOLVED", "pkg/b.py::inner", "hidden"), ("UNRESOLVED", "pkg/b.py::inner", "y"), ("UNRESOLVED", "pkg/a.py::C.s", "step")} <= issues


def test_typescript(spark):
    calls, imports, kinds, issues = resolved(spark, {
        "src/a.ts": "import { leaf as l, gone } from './leaf.js';\nimport mk from './make';\nimport type { T } from './leaf';\nimport * as ns from './leaf';\nexport const run = () => { l(); mk(); gone(); const s = new Store(); s.save(); let t = new Store(); t.save(); };\nclass Store { save() { this.check(); } check() {} static check() {} static make() { this.check(); } }\nfunction outer(leaf) { leaf(); const w = () => { hidden(); }; }\nexport function viaBarrel() { passed(); }\nimport { passed } from './barrel';\n",
        "src/leaf.ts": "export function leaf() {}\nexport interface T {}\nexport class Impl<X> extends Base<X> implements T {}\nclass Base<X> {}\n",
        "src/make.ts": "export default function mk2() {}\n",
        "src/barrel.ts": "export { leaf as passed } from './leaf';\n",
        "src/far.ts": "import { passed } from './barrel2';\nfunction f() { passed(); }\n",
        "src/barrel2.ts": "export { passed } from './barrel';\n",
    })
    assert calls == {("src/a.ts::run", "src/leaf.ts::leaf"), ("src/a.ts::run", "src/make.ts::mk2"), ("src/a.ts::run", "src/a.ts::Store.save"), ("src/a.ts::viaBarrel", "src/leaf.ts::leaf")}
    # the class has two methods called check: one of each kind, under one canonical name
    assert ("src/a.ts", "src/leaf.ts") in imports and ("src/barrel.ts", "src/leaf.ts") in imports
    assert kinds == {("src/leaf.ts::Impl", "EXTENDS", "src/leaf.ts::Base"), ("src/leaf.ts::Impl", "IMPLEMENTS", "src/leaf.ts::T")}
    assert {("UNRESOLVED", "src/a.ts", "gone"), ("UNRESOLVED", "src/a.ts", "T"), ("UNRESOLVED", "src/a.ts::outer", "leaf"), ("UNRESOLVED", "src/a.ts", "./leaf"), ("UNRESOLVED", "src/far.ts::f", "passed")} <= issues


@pytest.mark.parametrize(("files", "status"), [({"m.js": "export function m() {}", "m.ts": "export function m() {}"}, "EDGE"), ({"m.ts": "export function m() {}", "m.tsx": "export function m() {}"}, "AMBIGUOUS"), ({"m/index.ts": "export function m() {}"}, "EDGE"), ({}, "UNRESOLVED")])
def test_module_tiers(spark, files, status):
    calls, _, _, issues = resolved(spark, files | {"use.ts": "import { m } from './m.js';\nexport function f() { m(); }"})
    assert (len(calls) == 1) == (status == "EDGE")
    assert status == "EDGE" or (status, "use.ts", "./m.js") in issues


def test_java(spark):
    calls, imports, kinds, issues = resolved(spark, {
        "src/p/A.java": "package p;\nimport q.Util;\nimport static q.Util.twice;\nclass A {\n  int f;\n  void run(int n) { one(); this.one(); Util.help(n); twice(n); over(1); over(); f(); Runnable r = () -> one(); new Object() { void z() { one(); } }; }\n  void one() {}\n  void over() {}\n  void over(int x) {}\n  void f() {}\n}\ninterface I extends J {}\ninterface J {}\nenum E implements J { X, Y; void m() {} }\n",
        "src/q/Util.java": "package q;\npublic class Util {\n  public static void help(int x) {}\n  public static int twice(int x) { return x; }\n}\n",
        "src/p/B.java": "package p;\nclass B extends A {\n  void g() { h(1); k(); }\n  void h(int x) {}\n  void k() {}\n}\n",
    })
    a = "src/p/A.java::A."
    assert calls == {(a + "run", a + "one"), (a + "run", "src/q/Util.java::Util.help"), (a + "run", "src/q/Util.java::Util.twice"), (a + "run", a + "over(int)"), (a + "run", a + "over()"), ("src/p/B.java::B.g", "src/p/B.java::B.k")}
    assert ("src/p/A.java", "src/q/Util.java") in imports
    assert kinds == {("src/p/A.java::I", "EXTENDS", "src/p/A.java::J"), ("src/p/A.java::E", "IMPLEMENTS", "src/p/A.java::J"), ("src/p/B.java::B", "EXTENDS", "src/p/A.java::A")}
    assert ("UNRESOLVED", "src/p/B.java", "h") in issues


def test_index_of_a_tree(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "__init__.py").write_text("def entry():\n    return middle()\n\n\ndef middle():\n    return leaf_value()\n\n\ndef leaf_value():\n    return 1\n")
    (tmp_path / "pkg" / "test_leaf.py").write_text("def test_leaf_value():\n    pass\n")
    git("init")
    git("add", ".")
    git("commit", "-m", "x")
    index = Index.open(spark, str(tmp_path))
    assert "pkg/__init__.py::leaf_value" in index.find("leaf_value").split("\n")[1]
    assert "Depth 2:\n- pkg/__init__.py::entry" in index.impact("leaf_value")
    assert "Call path (2 calls)" in index.trace("entry", "leaf_value")
    assert "middle" in index.inspect("pkg/__init__.py::leaf_value") and "test_leaf_value" in index.inspect("pkg/__init__.py::leaf_value")
    with pytest.raises(SelectorError):
        index.inspect("nobody")
    assert index.sync() == "same"
    (tmp_path / "pkg" / "__init__.py").write_text("def entry():\n    return middle()\n\n\ndef middle():\n    return 2\n\n\ndef leaf_value():\n    return 1\n")
    assert index.sync() == "refreshed"
    fresh = Index.build(spark, str(tmp_path))
    for table in ("facts", "postings", "symbols", "sites", "imports", "structural", "issues", "search", "dependencies"):
        columns = sorted(getattr(fresh, table).columns)
        assert sorted(map(str, getattr(index, table).select(*columns).collect())) == sorted(map(str, getattr(fresh, table).select(*columns).collect()))
    report = fresh.impact_diff()
    assert "Changed symbols:\n- pkg/__init__.py::middle" in report and "pkg/__init__.py::entry" in report
    (tmp_path / "pkg" / "more.py").write_text("def more():\n    pass\n")
    assert Index.open(spark, str(tmp_path)).symbols.where("name = 'more'").count() == 1
    (tmp_path / "go.mod").write_text("module example.com/y\n")
    assert fresh.open(spark, str(tmp_path)).sync() == "same"  # open() took the new module name in
    (tmp_path / "go.mod").write_text("module example.com/z\n")
    assert Index(spark, str(tmp_path), Index.open(spark, str(tmp_path)).folder).modules.first()["module"] == "example.com/z"
    assert "/.tessera/" in (tmp_path / ".git" / "info" / "exclude").read_text()


def test_many_callers_cost_no_more_jobs(spark, tmp_path):
    calls = "".join(f"def caller{k:02d}():\n    target()\n\n\n" for k in range(50))
    (tmp_path / "a.py").write_text(f"def target():\n    pass\n\n\n{calls}")
    index = Index.build(spark, str(tmp_path))

    def jobs(question):
        group = f"jobs-{question}"
        spark.sparkContext.setJobGroup(group, group)
        text = getattr(index, question)("target")
        spark.sparkContext.setJobGroup("", "")
        return text, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    text, n = jobs("inspect")
    assert "caller07" in text and "… 42 more callers" in text and n < 50
    assert sum("[call at a.py:" in line for line in text.split("\n")) == 8
    assert index.impact("target").count("CALLS a.py::target [call at") == 50
    assert index.callers("a.py::target").count() == 50 and index.callees("a.py::caller00").first()["canonical"] == "a.py::target"
    assert [tuple(r) for r in index.call_sites("a.py::caller00", "a.py::target").collect()] == [(6, 5)]
    assert index.dependents("a.py::target").first()["kind"] == "CALLS" and index.defining_file("a.py::target") == "a.py"
    shown = index.diagnose("target").collect()
    assert shown[0]["canonical"] == "a.py::target" and shown[0]["qterm"] == "target" and shown[0]["df"] >= 1


def test_a_refresh_is_a_build(spark, tmp_path):
    """One changed file of each language: tables after refresh() equal those of a new build."""
    files = {
        "a.ts": "export function one() {}\n",
        "b.ts": "export { one as two } from './a';\n",
        "c.ts": "import { two } from './b';\nexport function run() { two(); }\n",
        "p/m.py": "def f():\n    pass\n",
        "p/n.py": "from .m import f\n\n\ndef g():\n    f()\n",
        "go.mod": "module ex.com/x\n",
        "k/k.go": "package k\n\nfunc Do() {}\n",
        "main.go": 'package main\n\nimport "ex.com/x/k"\n\nfunc main() { k.Do() }\n',
        "q/U.java": "package q;\npublic class U { public static void help(int x) {} }\n",
        "q/V.java": "package q;\nclass V { void run() { U.help(1); } }\n",
        "src/lib.rs": "mod u;\nuse crate::u::f;\npub fn top() { f(); }\n",
        "src/u.rs": "pub fn f() {}\n",
    }
    for path, text in files.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    index = Index.build(spark, str(tmp_path))
    assert index.sites.count() == 5
    edits = {"a.ts": "export function uno() {}\n", "p/m.py": "def h():\n    pass\n", "k/k.go": "package kk\n\nfunc Do() {}\n", "q/U.java": "package r;\npublic class U { public static void help(int x) {} }\n", "src/lib.rs": "use crate::u::f;\npub fn top() { f(); }\n"}
    for path, text in edits.items():
        (tmp_path / path).write_text(text)
    assert index.refresh("a.ts") == "refreshed" and index.sites.count() == 4
    assert index.sync() == "refreshed" and index.sites.count() == 0
    fresh = Index.build(spark, str(tmp_path))
    for table in ("facts", "search", "postings", "symbols", "sites", "imports", "structural", "issues", "dependencies"):
        columns = sorted(getattr(fresh, table).columns)
        assert sorted(map(str, getattr(index, table).select(*columns).collect())) == sorted(map(str, getattr(fresh, table).select(*columns).collect())), table
    assert index.refresh("gone.py") == "rebuilt"


def test_a_damaged_index_is_built_anew(spark, tmp_path):
    (tmp_path / "a.py").write_text("def f():\n    g()\n\n\ndef g():\n    pass\n")
    index = Index.build(spark, str(tmp_path))
    assert index.sound() and Index._kept(spark, str(tmp_path)) is not None
    part = next((tmp_path / ".tessera").glob("index-*/sites/*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    assert Index._kept(spark, str(tmp_path)) is None
    assert Index.open(spark, str(tmp_path)).sites.count() == 1


def test_hunks_with_lines_that_look_like_headers(spark, tmp_path):
    from tessera.sources.git import hunks

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    lines = [f"line {k}" for k in range(20)]
    (tmp_path / "a.py").write_text("\n".join(lines) + "\n")
    git("init")
    git("add", ".")
    git("commit", "-m", "x")
    lines[2], lines[15] = "++ b/other.py", "changed"
    (tmp_path / "a.py").write_text("\n".join(lines) + "\n")
    assert sorted((r["path"], r["new_start"]) for r in hunks(spark, str(tmp_path)).collect()) == [("a.py", 3), ("a.py", 16)]


def test_ignored_files_below_a_work_tree(tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    (tmp_path / "sub").mkdir()
    for name in ("a.py", "b.py"):
        (tmp_path / "sub" / name).write_text("x = 1\n")
    git("init")
    git("add", "-f", ".")
    git("commit", "-m", "x")
    (tmp_path / ".gitignore").write_text("b.py\n")
    assert tree.list_sources(str(tmp_path / "sub")) == ["a.py"] and tree.list_sources(str(tmp_path)) == ["sub/a.py"]


def test_rust(spark):
    calls, imports, _, issues = resolved(spark, {
        "src/lib.rs": "mod util;\nmod two;\npub mod inner { pub fn x() {} }\nuse crate::util::{leaf as l, missing};\nuse std::fmt;\n\npub fn run(cb: fn()) {\n    l();\n    cb();\n    missing();\n    println!(\"{}\", l());\n    let own = 1;\n    own();\n    A::new().go();\n}\n",
        "src/util.rs": "pub fn leaf() { deep(leaf()); }\nfn deep(x: ()) {}\npub struct S;\nimpl S {\n    pub fn a(&self) { self.b(); self.b(); self.t(); }\n    fn b(&self) {}\n    fn stat() { self.b(); }\n}\nimpl T for S { fn t(&self) { self.b(); } }\nmod child;\n",
        "src/util/child.rs": "use super::leaf;\nuse self::grand::g;\nmod grand;\nfn c() { leaf(); g(); }\n",
        "src/util/child/grand.rs": "pub fn g() {}\n",
        "src/two.rs": "",
        "src/two/mod.rs": "",
    })
    assert calls == {("src/lib.rs::run", "src/util.rs::leaf"), ("src/util.rs::leaf", "src/util.rs::deep"), ("src/util.rs::leaf", "src/util.rs::leaf"), ("src/util.rs::S.a", "src/util.rs::S.b"), ("src/util/child.rs::c", "src/util.rs::leaf"), ("src/util/child.rs::c", "src/util/child/grand.rs::g")}
    assert {("src/lib.rs", "src/util.rs"), ("src/util.rs", "src/util/child.rs"), ("src/util/child.rs", "src/util.rs")} <= imports
    assert {("AMBIGUOUS", "src/lib.rs", "two"), ("UNRESOLVED", "src/lib.rs", "inner"), ("UNRESOLVED", "src/lib.rs", "use"), ("UNRESOLVED", "src/lib.rs", "missing"), ("UNRESOLVED", "src/lib.rs::run", "cb"), ("UNRESOLVED", "src/lib.rs::run", "own")} <= issues


def test_go(spark):
    files = {
        "app/main.go": "package main\n\nimport (\n\t\"example.com/x/store\"\n\talias \"example.com/x/two\"\n\t\"fmt\"\n)\n\ntype Local struct{ n int }\n\nfunc (l *Local) Go() { l.Step(); l.n.Other() }\nfunc (l *Local) Step() {}\nfunc (Local) Unnamed() {}\n\nfunc run(s store.Store, p *Local, f func()) {\n\ts.Save()\n\tp.Step()\n\thelper()\n\tf()\n\tstore.New(helper())\n\tstore.hidden()\n\talias.Do()\n\tfmt.Println()\n\tx := taken()\n\tx.y().z()\n\tvar v Local\n\tv.Go()\n\tgo func() { helper() }()\n}\n\nfunc helper() {}\nfunc taken() {}\n",
        "store/store.go": "package store\n\ntype Store struct{}\n\nfunc (s Store) Save() {}\nfunc New(x int) {}\nfunc hidden() {}\n",
        "two/a.go": "package two\nfunc Do() {}\n",
        "two/b.go": "package two_test\n",
    }
    rows = [(p, tree.language(p), t) for p, t in files.items()]
    facts = written(tree.facts_of(spark.createDataFrame(rows, "path string, lang string, content string")), "facts")
    r = resolve(facts, spark.createDataFrame(tree.module_of("", "// x\nmodule example.com/x\n"), "root string, module string"))
    m = "app/main.go::"
    assert {(x["src"], x["dst"]) for x in r.sites.collect()} == {(m + "Local.Go", m + "Local.Step"), (m + "run", "store/store.go::Store.Save"), (m + "run", m + "Local.Step"), (m + "run", m + "helper"), (m + "run", "store/store.go::New"), (m + "run", m + "Local.Go")}
    issues = {(x["status"], x["source"], x["name"]) for x in r.issues.collect()}
    assert {("UNRESOLVED", "app/main.go", "example.com/x/two"), ("UNRESOLVED", "app/main.go", "fmt"), ("UNRESOLVED", m + "run", "taken"), ("UNRESOLVED", m + "run", "f"), ("UNRESOLVED", m + "run", "store"), ("UNRESOLVED", m + "run", "alias"), ("UNRESOLVED", m + "run", "z")} <= issues
