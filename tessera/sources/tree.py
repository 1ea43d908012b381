"""A source tree as a table of files.

Paths are listed on the driver: Spark's own readers skip names that begin with _ or a dot, so that
`__init__.py` would be missing. Contents are read by the tasks.
"""

from __future__ import annotations

import hashlib
import os
import subprocess

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract_go, extract_java, extract_js, extract_python, extract_rust
from ..functions.facts import SCHEMA

LANGUAGES = {"ts": "js", "tsx": "js", "js": "js", "jsx": "js", "py": "python", "rs": "rust", "go": "go", "java": "java"}
EXTRACTORS = {"js": extract_js.extract, "python": extract_python.extract, "rust": extract_rust.extract, "go": extract_go.extract, "java": extract_java.extract}
PIECE = 1 << 18  # characters
AT_ONCE = 20_000  # facts in a batch, but for one file
PRUNED = {".git", "node_modules", "target", "dist", "build", "vendor", ".tessera"}


def language(path: str) -> str | None:
    return LANGUAGES.get(path.rsplit(".", 1)[-1]) if "." in path.rsplit("/", 1)[-1] else None


def in_work_tree(root: str) -> bool:
    """Whether root lies in a git work tree: at its top, below it, or in a linked one."""
    try:
        done = subprocess.run(["git", "-C", root, "rev-parse", "--is-inside-work-tree"], capture_output=True, timeout=60)
    except FileNotFoundError:  # no git here
        return False
    return done.stdout.strip() == b"true"


def list_sources(root: str) -> list[str]:
    """Supported files below root, sorted, hidden ones too; what git ignores is left out where root is in a work tree."""
    found = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in PRUNED)
        at = os.path.relpath(folder, root).replace(os.sep, "/")
        found += [n if at == "." else f"{at}/{n}" for n in names if language(n)]
    if found and in_work_tree(root):
        done = subprocess.run(["git", "-C", root, "-c", "core.excludesFile=", "check-ignore", "--no-index", "-z", "--stdin"], input="\0".join(found).encode(), capture_output=True, timeout=120)
        ignored = set(done.stdout.decode("utf-8", "surrogateescape").split("\0"))
        found = [f for f in found if f not in ignored]
    return sorted(found)


def files_of(spark: SparkSession, root: str) -> DataFrame:
    """path, lang, sha, content of every source file; one that isn't UTF-8 fails the job."""
    return read_files(spark, root, list_sources(root))


def read_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """path, lang, sha, content of the files at paths below root."""
    rows = spark.createDataFrame([(p, language(p)) for p in paths], "path string, lang string").repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism)))

    def read(batches):
        for b in batches:
            texts, shas = [], []
            for p in b.column(0).to_pylist():
                with open(os.path.join(root, p), "rb") as f:
                    raw = f.read()
                texts.append(raw.decode("utf-8"))
                shas.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shas, pa.string()), pa.array(texts, pa.string())], ["path", "lang", "sha", "content"])

    return rows.mapInArrow(read, "path string, lang string, sha string, content string")


def facts_of(files: DataFrame, spread: bool = False) -> DataFrame:
    """One row of facts per file (path, lang, content), by the extractor of its language.

    With spread the files are dealt out to tasks first, however few partitions they come in, and a Rust source of
    more than PIECE characters is read in pieces, so that no task holds a large file's tokens: it has a row of facts
    for each piece. Lines are those of the whole file, and `seq` is unique in it.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def each(batches):
        for b in batches:
            rows, held = [], 0
            for path, lang, content, line, seq in zip(*(b.column(k).to_pylist() for k in range(5))):
                facts = EXTRACTORS[lang](path, content)
                rows.append(facts.moved(line, seq).row(lang))
                held += facts.size()
                if held > AT_ONCE:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def cut(batches):
        for b in batches:
            for path, lang, content in zip(*(b.column(k).to_pylist() for k in range(3))):
                for piece, line, start in extract_rust.pieces(content, PIECE):
                    yield pa.RecordBatch.from_pydict({"path": [path], "lang": [lang], "content": [piece], "line": pa.array([line], pa.int32()), "seq": pa.array([start], pa.int32())})

    files = files.select("path", "lang", "content")
    whole = lambda rows: rows.select("*", F.lit(0).alias("line"), F.lit(0).alias("seq"))
    if not spread:
        return whole(files).mapInArrow(each, SCHEMA)
    large = (F.col("lang") == "rust") & (F.length("content") > PIECE)
    pieces = whole(files.where(~large)).unionByName(files.where(large).mapInArrow(cut, "path string, lang string, content string, line int, seq int"))
    return pieces.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "path", "line").mapInArrow(each, SCHEMA)


def go_modules(spark: SparkSession, root: str) -> DataFrame:
    """root (folder), module of every go.mod below root that names one."""
    rows = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(d for d in folders if d != ".git")
        if "go.mod" in names:
            at = os.path.relpath(folder, root).replace(os.sep, "/")
            with open(os.path.join(folder, "go.mod"), encoding="utf-8") as f:
                rows += module_of("" if at == "." else at, f.read())
    return spark.createDataFrame(rows, "root string, module string")


def module_of(folder: str, text: str) -> list[tuple[str, str]]:
    for line in map(str.strip, text.split("\n")):
        if line.startswith("module "):
            name = line[7:].strip()
            return [(folder, name)] if name and not any(c.isspace() for c in name) else []
    return []
