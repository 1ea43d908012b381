"""Search evidence of symbols: the words of the code, comments and strings around each."""

from __future__ import annotations

import re

from .text import STOP

SPAN_BYTES = 12_000
LINES_ABOVE = 4
DECLARATION_LINES = 3
TEST_PATHS = {"test", "tests", "spec", "specs"}
TEST_MARKS = ("#[test]", "describe(", "it(", "test_")
FIELDS = ("identifier", "path", "declaration", "comments", "strings", "body", "test")
SCHEMA = "canonical string, path_of string, " + ", ".join(f"{f} array<string>" for f in FIELDS)

_STOP = set(STOP)
_PIECE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|#[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|([\"'`])(?:\\.|(?!\1).)*(?:\1|\Z)", re.S)
_CASE = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")


def terms(text: str) -> list[str]:
    """Sorted distinct index terms of a text, as functions.text.terms() gives them."""
    found = {t for w in re.findall(r"[^\W_]+", text) for t in _CASE.sub(" ", w).lower().split() if len(t.encode()) >= 2 and t not in _STOP}
    return sorted(found)


def split_kinds(text: str) -> tuple[str, str, str]:
    """(code, comments, strings) of a stretch of source in any language; # begins a comment everywhere."""
    code, comments, strings = [], [], []
    at = 0
    for m in _PIECE.finditer(text):
        code.append(text[at : m.start()])
        piece = m.group(0)
        if piece.startswith("//"):
            comments.append(piece[2:])
        elif piece.startswith("/*"):
            comments.append(piece[2:-2] if piece.endswith("*/") and len(piece) > 3 else piece[2:])
        elif piece.startswith("#"):
            comments.append(piece[1:])
        elif piece.startswith(('"""', "'''")):
            comments.append(piece[3:-3] if len(piece) > 5 and piece.endswith(piece[:3]) else piece[3:])
        else:
            strings.append(piece[1:-1] if len(piece) > 1 and piece.endswith(piece[0]) else piece[1:])
        at = m.end()
    return "".join([*code, text[at:]]), " ".join(comments), " ".join(strings)


def of_file(path: str, source: str, symbols: list[dict]) -> list[dict]:
    """One row per symbol (canonical, name, line, end_line) of a file."""
    raw = source.encode()
    starts = [0, *(m.end() for m in re.finditer(b"\n", raw))]
    at_line = lambda k: starts[k] if k < len(starts) else len(raw)
    words = terms(path)
    rows = []
    for s in symbols:
        first, last = s["line"] - 1, s["end_line"] - 1
        start = at_line(max(0, first - LINES_ABOVE))
        end = min(at_line(last + 1), start + SPAN_BYTES)
        text = lambda a, b: raw[a:b].decode("utf-8", "ignore")
        code, comments, strings = split_kinds(text(start, end))
        declared = split_kinds(text(start, min(end, at_line(first + DECLARATION_LINES))))[0]
        above = text(start, at_line(first))
        tested = bool(TEST_PATHS & set(words)) or any(m in above for m in TEST_MARKS)
        rows.append({
            "canonical": s["canonical"], "path_of": path, "identifier": terms(s["name"]), "path": words, "declaration": terms(declared), "comments": terms(comments),
            "strings": terms(strings), "body": terms(code), "test": terms(f"{s['name']} {declared}") if tested else [],
        })
    return rows
