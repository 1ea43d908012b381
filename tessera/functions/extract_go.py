"""Symbols and raw references of Go sources."""

from __future__ import annotations

import re

from .facts import Facts
from .lex import Source

_KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_PLAIN = re.compile(r"[A-Za-z0-9_.]+")


class _Reader:
    def __init__(self, path: str, text: str):
        self.out, self.s, self.path = Facts(path), Source(text, "go"), path
        self.t = self.s.tokens
        self.out.package = ""

    def read(self) -> Facts:
        k = 0
        while k < len(self.t):
            k = max(k + 1, self.top(k))
        return self.out

    def top(self, k: int) -> int:
        w = self.s.word
        if w(k) == "package":
            self.out.package = w(k + 1)
            return k + 2
        if w(k) == "import":
            if w(k + 1) == "(":
                j, stop = k + 2, self.t[k + 1].partner
                while j < stop:
                    j = self.import_spec(j)
                return stop + 1
            return self.import_spec(k + 1)
        if w(k) == "func":
            return self.function(k)
        if w(k) == "type":
            if w(k + 1) == "(":
                j, stop = k + 2, self.t[k + 1].partner
                while j < stop:
                    j = self.type_spec(j, stop)
                return stop + 1
            return self.type_spec(k + 1, len(self.t))
        return self.s.after(k) if self.t[k].kind == "op" and self.t[k].text in ("(", "{", "[") else k + 1

    def import_spec(self, k: int) -> int:
        start, alias = k, None
        if self.s.is_word(k) or self.s.word(k) in (".", "_"):
            alias, k = self.s.word(k), k + 1
        if k < len(self.t) and self.t[k].kind == "string":
            path = self.t[k].text[1:-1]
            bound = [] if alias in (".", "_") else [(alias or "", path, alias is None)]
            self.out.imported(path, self.t[start].line, self.t[start].column, [], bound)
        return max(k + 1, start + 1)

    def type_spec(self, k: int, stop: int) -> int:
        """One type; returns the place after it: the line that isn't its own any more."""
        if not self.s.is_word(k):
            return k + 1
        j = k + 1
        while j < stop:
            if self.t[j].line > self.s.place(self.t[j - 1].end - 1)[0] or self.s.word(j) == ";":
                break
            j = self.s.after(j) if self.t[j].kind == "op" and self.t[j].text in ("(", "{", "[") else j + 1
        last = self.t[j - 1]
        self.out.symbol(f"{self.path}::{self.s.word(k)}", self.s.word(k), None, "type", self.t[k].line, self.s.place(last.end - 1)[0], self.t[k].column)
        return j + (self.s.word(j) == ";")

    def names(self, k: int, stop: int) -> set[str]:
        """Identifiers between k and stop, without package qualifiers and fields of selectors."""
        return {self.t[j].text for j in range(k, stop) if self.s.is_word(j) and self.t[j].text not in _KEYWORDS and self.s.word(j + 1) != "."} | {self.t[j].text for j in range(k, stop) if self.s.is_word(j) and self.s.word(j + 1) == "." and self.t[j].text not in _KEYWORDS}

    def typed(self, names: list[str], first: int, stop: int, into: dict[str, str]) -> None:
        text = self.s.text[self.t[first].start : self.t[stop - 1].end].strip().lstrip("*").strip() if stop > first else ""
        if _PLAIN.fullmatch(text):
            into.update(dict.fromkeys(names, text))

    def parameters(self, k: int, into: dict[str, str]) -> None:
        waiting: list[str] = []
        j, stop = k + 1, self.t[k].partner
        while j < stop:
            first = j
            while j < stop and self.s.word(j) != ",":
                j = self.s.after(j) if self.t[j].kind == "op" and self.t[j].text in ("(", "{", "[") else j + 1
            if j - first == 1:
                waiting.append(self.s.word(first))
            elif self.s.is_word(first) and self.s.word(first + 1) != "." and self.s.word(first) not in _KEYWORDS:
                self.typed([*waiting, self.s.word(first)], first + 1, j, into)
                waiting = []
            else:
                waiting = []
            j += 1

    def open_body(self, k: int) -> int:
        while k < len(self.t):
            if self.s.word(k) == "{":
                if self.s.word(k - 1) in ("interface", "struct"):
                    k = self.s.after(k)
                    continue
                return k
            if self.t[k].line > self.t[k - 1].line:
                return -1
            k = self.s.after(k) if self.t[k].kind == "op" and self.t[k].text in ("(", "[") else k + 1
        return -1

    def function(self, start: int) -> int:
        k, owner, receiver = start + 1, None, None
        if self.s.word(k) == "(":
            ids = [self.s.word(j) for j in range(k + 1, self.t[k].partner) if self.s.is_word(j)]
            k = self.s.after(k)
            if len(ids) < 2:  # an unnamed receiver isn't indexed
                body = self.open_body(k + 1)
                return self.s.after(body) if body >= 0 else k
            owner, receiver = ids[-1], ids[0]
        if not self.s.is_word(k):
            return k + 1
        name = self.s.word(k)
        params = self.s.after(k + 1) if self.s.word(k + 1) == "[" else k + 1
        if self.s.word(params) != "(":
            return k + 1
        types: dict[str, str] = {}
        shadowed = {x for x in self.names(params + 1, self.t[params].partner)}
        self.parameters(params, types)
        if receiver:
            shadowed.add(receiver)
            types[receiver] = owner
        body = self.open_body(self.s.after(params))
        last = self.t[body].partner if body >= 0 else self.t[params].partner
        calls: list[tuple] = []
        if body >= 0:
            self.local_types(body + 1, self.t[body].partner, types)
            self.body(body + 1, self.t[body].partner, shadowed, calls)
        canonical = f"{self.path}::{owner}.{name}" if owner else f"{self.path}::{name}"
        self.out.symbol(canonical, name, owner, "method" if owner else "function", self.t[start].line, self.t[last].line, self.t[start].column)
        for kind, called, member, line, column in calls:
            how, cls, via, blocked = "other", None, None, None
            if kind == "direct":
                how, blocked = "direct", "SHADOWED" if called in shadowed else None
            elif kind == "receiver":
                kept = types.get(called)
                if called == receiver:
                    how, cls = "method", owner
                elif kept is not None:
                    via, dot, cls = kept.partition(".")
                    how = "far_method" if dot else "method"
                    cls, via = (cls, via) if dot else (via, None)
                else:
                    how, via = "package", called
            self.out.call(canonical, called, how, line, column, owner=owner, blocked=blocked, cls=cls, receiver=via, member=member)
        return last + 1

    def local_types(self, k: int, stop: int, into: dict[str, str]) -> None:
        """`var x T` of the function's own scope; nested blocks aren't looked into."""
        while k < stop:
            if self.s.word(k) == "var":
                specs = [(k + 1, None)]
                if self.s.word(k + 1) == "(":
                    specs = [(j, self.t[k + 1].partner) for j in range(k + 2, self.t[k + 1].partner) if self.t[j].line > self.t[j - 1].line or j == k + 2]
                for j, end in specs:
                    names = []
                    while self.s.is_word(j):
                        names.append(self.s.word(j))
                        j += 1
                        if self.s.word(j) != ",":
                            break
                        j += 1
                    first = j
                    while j < (end or stop) and self.s.word(j) not in ("=", ";", ")") and self.t[j].line == self.t[first - 1].line:
                        j += 1
                    self.typed(names, first, j, into)
            k = self.s.after(k) if self.t[k].kind == "op" and self.t[k].text in ("{", "(", "[") else k + 1

    def statement_end(self, k: int, stop: int, header: bool) -> int:
        while k < stop:
            x = self.t[k]
            if x.text == ";" or header and x.text == "{":
                return k
            if x.line > self.s.place(self.t[k - 1].end - 1)[0] and (self.t[k - 1].kind != "op" or self.t[k - 1].text in (")", "]", "}", "++", "--")):
                return k
            k = self.s.after(k) if x.kind == "op" and x.text in ("(", "[", "{") else k + 1
        return stop

    def body(self, k: int, stop: int, shadowed: set[str], calls: list[tuple]) -> None:
        """Calls between k and stop; function literals and the arguments of calls aren't entered."""
        w = self.s.word
        while k < stop:
            x = self.t[k]
            if x.text == "func" and x.kind == "word":
                body = self.open_body(self.s.after(k + 1) if w(k + 1) == "(" else k + 1)
                k = self.s.after(body) if body >= 0 else k + 1
                continue
            if x.text == ":=":
                first = k
                while first > 0 and (self.s.is_word(first - 1) or w(first - 1) == ",") and self.t[first - 1].line == x.line and w(first - 1) not in _KEYWORDS:
                    first -= 1
                if w(k + 1) != "range":
                    end = self.statement_end(k + 1, stop, w(first - 1) in ("if", "for", "switch"))
                    if not (w(end - 1) == ")" and w(end - 2) == "type"):
                        shadowed |= self.names(first, end)
                k += 1
                continue
            if x.text == "var" and x.kind == "word":
                end = self.s.after(k + 1) if w(k + 1) == "(" else self.statement_end(k + 1, stop, False)
                shadowed |= self.names(k + 1, end)
                k += 1
                continue
            if x.kind == "word" and x.text not in _KEYWORDS and w(k - 1) != ".":
                k = self.chain(k, calls)
                continue
            k += 1

    def chain(self, k: int, calls: list[tuple]) -> int:
        """Read a name with its selectors and calls; of a chain the outermost call counts. Returns the place after it."""
        w = self.s.word
        parts, simple, found, j = [w(k)], True, None, k + 1
        at = self.t[k]
        while j < len(self.t):
            if w(j) == "." and self.s.is_word(j + 1):
                parts.append(w(j + 1))
                j += 2
            elif w(j) == "." and w(j + 1) == "(":
                simple, j = False, self.s.after(j + 1)
            elif w(j) == "[" and self.t[j].line == self.t[j - 1].line:
                simple, j = False, self.s.after(j)
                parts = parts if len(parts) > 1 or found else [*parts, ""]
            elif w(j) == "(" and self.t[j].line == self.s.place(self.t[j - 1].end - 1)[0]:
                if simple and len(parts) == 1:
                    found = ("direct", parts[0], None)
                elif simple and len(parts) == 2:
                    found = ("receiver", parts[0], parts[1])
                else:
                    found = ("chained" if parts[-1] else "other", parts[-1], None)
                simple, j = False, self.s.after(j)
            else:
                break
        if found:
            calls.append((*found, at.line, at.column))
        return j


def extract(path: str, source: str) -> Facts:
    return _Reader(path, source).read()
