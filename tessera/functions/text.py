"""Terms of stored values and of queries. Stored values are tokenised by Spark, the few words of a query here."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP = sorted("a an the and or with to on in from by at of for where when how what is are be it does do gets get".split())
QUERY_STOP = sorted({*STOP, "explain", "identify", "main", "code", "repository", "enough", "once"})
NON_PRODUCTION = sorted(f"{w}{s}" for w in ("benchmark", "demo", "example", "fixture", "sample", "spec", "test") for s in ("", "s"))
TEST_WORDS = {"test", "tests", "spec", "specs", "fixture", "fixtures"}
FLOW_WORDS = frozenset(("flow", "incoming", "path", "reaches", "through"))
PROCEDURAL = ("without ", "do not ", "don't ", "stop once ")


def terms(value: Column) -> Column:
    """Sorted distinct index terms: runs of letters and digits, split where lower case meets upper, in lower case, no stop words, two bytes at least."""
    split = F.split(F.lower(F.regexp_replace(value, r"(?<=\p{Ll})(?=\p{Lu})", " ")), r"[^\p{L}\p{N}]+")
    kept = F.filter(split, lambda t: (F.octet_length(t) >= 2) & ~t.isin(STOP))
    return F.array_sort(F.array_distinct(kept))


def non_production(path: Column) -> Column:
    low = F.lower(path)
    parts = F.exists(F.split(low, "/"), lambda p: p.isin(NON_PRODUCTION))
    return parts | low.contains(".test.") | low.contains(".test-") | low.contains(".spec.") | low.endswith("_test.go")


def morphology(token: str) -> set[str]:
    """Other forms of a query token; lengths count bytes."""
    n = len(token.encode())
    out = []
    if n > 5 and token.endswith("ies"):
        out.append(token[:-3] + "y")
    elif n > 5 and token.endswith("es"):
        out.append(token[:-2])
    elif n > 4 and token.endswith("s") and not token.endswith("ss"):
        out.append(token[:-1])
    if n > 5 and token.endswith("ing"):
        base = token[:-3]
        out += [base, base + "e"]
        if len(base) > 2 and base[-1] == base[-2]:
            out.append(base[:-1])
    if n > 4 and token.endswith("ed"):
        out += [token[:-2], token[:-2] + "e"]
    if n > 6 and token.endswith(("tion", "sion")):
        out.append(token[:-3])
    return {v for v in out if len(v.encode()) >= 3 and v != token}


def strip_procedure(query: str) -> str:
    """The query in lower case without clauses about how to work rather than what to find."""
    kept = []
    for clause in re.findall(r"[^.;\n]*[.;\n]|[^.;\n]+", query.lower()):
        trimmed = clause.strip()
        if trimmed.startswith(PROCEDURAL):
            _, comma, task = trimmed.partition(",")
            kept += [task] if comma else []
        else:
            kept.append(trimmed)
    return " ".join(kept)


@dataclass
class Query:
    raw: str
    terms: list[tuple[str, list[str]]] = field(default_factory=list)  # (term, variants), by term
    test_intent: bool = False
    flow_intent: bool = False


def parse_query(query: str) -> Query:
    text = strip_procedure(query)
    words = re.findall(r"\w+", text)
    found = {t for w in words for t in w.split("_") if len(t.encode()) >= 2 and t not in QUERY_STOP}
    return Query(query, [(t, sorted(morphology(t))) for t in sorted(found)], any(w in TEST_WORDS for w in words), any(f in text for f in FLOW_WORDS))
