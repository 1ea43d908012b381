"""Symbols and raw references of Java sources: top-level types, their direct methods, and what method bodies call."""

from __future__ import annotations

from .facts import Facts
from .lex import Source

_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "strictfp", "default", "transient", "volatile", "sealed"}
_NOT_CALLED = {"if", "for", "while", "switch", "catch", "synchronized", "return", "new", "throw", "assert", "try", "else", "do", "case", "yield", "super", "this"}


class _Reader:
    def __init__(self, path: str, text: str):
        self.out, self.s, self.path = Facts(path), Source(text, "java"), path
        self.t = self.s.tokens
        self.out.package = ""

    def read(self) -> Facts:
        k = 0
        while k < len(self.t):
            k = max(k + 1, self.top(k))
        return self.out

    def annotation(self, k: int) -> int:
        """Past an annotation at k."""
        k += 1
        while self.s.word(k) == ".":
            k += 2
        return self.s.after(k) if self.s.word(k) == "(" else k

    def top(self, k: int) -> int:
        w = self.s.word
        if w(k) in ("package", "import"):
            return self.named(k)
        start, j = k, k
        while w(j) in _MODIFIERS or (w(j).startswith("@") and w(j) != "@interface") or w(j) == "@":
            j = self.annotation(j) if w(j).startswith("@") else j + 1
        if w(j) in ("class", "interface", "enum") and self.s.is_word(j + 1):
            return self.type(start, j)
        if w(j) in ("record", "@interface") or (w(j) == "@" and w(j + 1) == "interface"):
            while j < len(self.t) and w(j) not in ("{", ";"):
                j += 1
            return self.s.after(j) if w(j) == "{" else j + 1
        return self.s.after(k) if self.t[k].kind == "op" and self.t[k].text in ("{", "(", "[") else k + 1

    def named(self, k: int) -> int:
        start, j = k, k + 1
        static = self.s.word(j) == "static"
        j += static
        parts, wild = [], False
        while j < len(self.t) and self.s.word(j) != ";":
            if self.s.is_word(j):
                parts.append(self.s.word(j))
            wild |= self.s.word(j) == "*"
            j += 1
        at = self.t[start]
        if self.t[start].text == "package":
            self.out.package = ".".join(parts)
        elif parts and not wild:
            self.out.imported(".".join(parts[:-1]), at.line, at.column, [], [(parts[-1], parts[-1], False)], unsupported="STATIC" if static else None)
        return j + 1

    def type(self, start: int, k: int) -> int:
        kind, name = self.s.word(k), self.s.word(k + 1)
        body = k + 2
        while body < len(self.t) and self.s.word(body) != "{":
            body += 1
        if body >= len(self.t):
            return body
        canonical = f"{self.path}::{name}"
        before = len(self.out.heritage)
        self.heritage(k + 2, body, canonical, kind)
        inherits = len(self.out.heritage) > before or any(self.s.word(j) in ("extends", "implements") for j in range(self.s.skip_angles(k + 2), body))
        end = self.t[self.t[body].partner]
        self.out.symbol(canonical, name, None, "class" if kind == "class" else "type", self.t[start].line, end.line, self.t[start].column, hierarchy=inherits)
        stop = self.t[body].partner
        first = body + 1
        if kind == "enum":  # constants end at the first ; of the body
            while first < stop and self.s.word(first) != ";":
                first = self.s.after(first) if self.t[first].kind == "op" and self.t[first].text in ("(", "{", "[") else first + 1
        self.members(name, first, stop, inherits)
        return self.s.after(body)

    def heritage(self, k: int, stop: int, source: str, kind: str) -> None:
        k = self.s.skip_angles(k)
        relation, expect = "", False
        while k < stop:
            x = self.s.word(k)
            if x in ("extends", "implements", "permits"):
                relation, expect = {"extends": "EXTENDS", "implements": "IMPLEMENTS", "permits": ""}[x], True
            elif x == ",":
                expect = True
            elif expect and self.s.is_word(k):
                after = self.s.skip_angles(k + 1)
                if self.s.word(after) == ".":  # a scoped name
                    while after < stop and self.s.word(after) not in (",", "implements", "extends", "permits"):
                        after += 1
                elif relation:
                    self.out.heritage.append(dict(source=source, target=x, kind=relation, line=self.t[k].line, column=self.t[k].column))
                expect, k = False, after
                continue
            k += 1

    def parameters(self, k: int) -> list[tuple[str, str, bool]]:
        """(type, name, varargs) of the list at k."""
        out, j, stop = [], k + 1, self.t[k].partner
        first = j
        while j <= stop:
            if j == stop or self.s.word(j) == ",":
                words = [x for x in range(first, j)]
                while words and (self.s.word(words[0]).startswith("@") or self.s.word(words[0]) == "final"):
                    words = [x for x in words if x >= (self.annotation(words[0]) if self.s.word(words[0]).startswith("@") else words[0] + 1)]
                if words:
                    name = max((x for x in words if self.s.is_word(x)), default=words[-1])
                    text = "".join(self.s.word(x) for x in words if x < name)
                    text += "".join(self.s.word(x) for x in words if x > name)
                    if self.s.word(name) != "this":
                        out.append((text, self.s.word(name), "..." in text))
                first = j + 1
            j = max(j + 1, self.s.skip_angles(j)) if self.s.word(j) == "<" else self.s.after(j) if self.t[j].kind == "op" and self.t[j].text in ("(", "[", "{") and j < stop else j + 1
        return out

    def members(self, owner: str, k: int, stop: int, inherits: bool) -> None:
        methods, fields = [], set()
        while k < stop:
            start, j, static = k, k, False
            while self.s.word(j) in _MODIFIERS or self.s.word(j).startswith("@"):
                if self.s.word(j) == "static":
                    static = True
                j = self.annotation(j) if self.s.word(j).startswith("@") else j + 1
            if self.s.word(j) in ("class", "interface", "enum", "record"):
                while j < stop and self.s.word(j) != "{":
                    j += 1
                k = self.s.after(j) if j < stop else stop
                continue
            if self.s.word(j) == "{":
                k = self.s.after(j)
                continue
            j = self.s.skip_angles(j)
            name = -1
            while j < stop and self.s.word(j) not in (";", "{", "=", "("):
                if self.s.is_word(j):
                    name = j
                elif self.s.word(j) == ",":
                    fields.add(self.s.word(name))
                j = max(j + 1, self.s.skip_angles(j)) if self.s.word(j) == "<" else self.s.after(j) if self.s.word(j) == "[" else j + 1
            if self.s.word(j) == "(" and name == j - 1:
                params = self.parameters(j)
                has_type = name > start and any(self.s.is_word(x) and self.s.word(x) not in _MODIFIERS for x in range(start, name))
                end = self.s.after(j)
                while end < stop and self.s.word(end) not in ("{", ";"):
                    end += 1
                body = end if self.s.word(end) == "{" else -1
                last = self.t[body].partner if body >= 0 else end
                if has_type or self.s.word(name) != owner:
                    methods.append((start, self.s.word(name), params, body, last, static))
                k = last + 1
                continue
            if name >= 0:
                fields.add(self.s.word(name))
            while j < stop and self.s.word(j) != ";":
                if self.s.word(j) == "," and self.s.is_word(j + 1) and self.s.word(j + 2) in ("=", ",", ";"):
                    fields.add(self.s.word(j + 1))
                j = self.s.after(j) if self.t[j].kind == "op" and self.t[j].text in ("(", "{", "[") else j + 1
            k = j + 1
        names = [m[1] for m in methods]
        for start, name, params, body, last, static in methods:
            label = f"{owner}.{name}"
            if names.count(name) > 1:
                label += "(" + ",".join(p[0] for p in params) + ")"
            canonical = f"{self.path}::{label}"
            at, end = self.t[start], self.t[min(last, len(self.t) - 1)]
            self.out.symbol(canonical, name, owner, "method", at.line, end.line, at.column, is_static=static, arity=len(params), varargs=any(p[2] for p in params), hierarchy=inherits)
            if body >= 0:
                shadowed = {p[1] for p in params} | fields
                found: list[tuple] = []
                self.body(body + 1, self.t[body].partner, shadowed, found)
                for how, cls, called, line, column, arity in found:
                    blocked = None
                    if how in ("direct", "self") and called in shadowed or how == "class" and cls in shadowed:
                        blocked = "SHADOWED"
                    self.out.call(canonical, called, how, line, column, owner=owner, blocked=blocked, cls=cls, arity=arity)

    def arity(self, k: int) -> int:
        n, j, stop = 0, k + 1, self.t[k].partner
        while j < stop:
            n = n or 1
            if self.s.word(j) == ",":
                n += 1
            j = self.s.after(j) if self.t[j].kind == "op" and self.t[j].text in ("(", "{", "[") else max(j + 1, self.s.skip_angles(j)) if self.s.word(j) == "<" and self.s.is_word(j - 1) and self.s.word(j - 1)[:1].isupper() else j + 1
        return n

    def body(self, k: int, stop: int, shadowed: set[str], out: list[tuple]) -> None:
        """Calls between k and stop; lambdas, local types and the arguments of calls aren't entered."""
        w = self.s.word
        while k < stop:
            x = self.t[k]
            if x.kind == "word" and x.text in ("class", "interface", "enum", "record") and self.s.is_word(k + 1) and w(k - 1) != ".":
                while k < stop and w(k) != "{":
                    k += 1
                k = self.s.after(k) if k < stop else stop
                continue
            if w(k + 1) == "->" and x.kind == "word":
                k = self.after_lambda(k + 1, stop)
                continue
            if x.text == "(" and x.kind == "op" and w(self.s.after(k)) == "->":
                k = self.after_lambda(self.s.after(k), stop)
                continue
            if x.kind == "word" and x.text == "new":
                j = k + 1
                while self.s.is_word(j) or w(j) == ".":
                    j += 1
                j = self.s.skip_angles(j)
                if w(j) == "(":
                    self.body(j + 1, self.t[j].partner, shadowed, out)
                    j = self.s.after(j)
                    if w(j) == "{":  # an anonymous class
                        j = self.s.after(j)
                elif w(j) == "[":
                    self.body(j + 1, self.t[j].partner, shadowed, out)
                    j = self.s.after(j)
                if w(j) == "." and self.s.is_word(j + 1) and w(j + 2) == "(":
                    out.append(("other", None, w(j + 1), x.line, x.column, self.arity(j + 2)))
                    j = self.s.after(j + 2)
                k = j
                continue
            if x.kind == "word" and x.text not in _NOT_CALLED or x.text in ("this", "super"):
                first, j = k, k
                chain = [x.text]
                simple = True
                if w(j + 1) == "(" and x.text not in ("this", "super"):
                    out.append(("direct", None, x.text, x.line, x.column, self.arity(j + 1)))
                    j = self.s.after(j + 1)
                    simple = False
                else:
                    j += 1
                while w(j) == "." and self.s.is_word(self.s.skip_angles(j + 1)):
                    m = self.s.skip_angles(j + 1)
                    if w(m + 1) == "(":
                        how, cls = "other", None
                        if simple and chain == ["this"]:
                            how = "self"
                        elif simple and len(chain) == 1 and chain[0] != "super":
                            how, cls = "class", chain[0]
                        # the outermost call of a chain is the one that is seen
                        out[:] = [c for c in out if not (c[3], c[4]) == (self.t[first].line, self.t[first].column)] if not simple else out
                        out.append((how, cls, w(m), self.t[first].line, self.t[first].column, self.arity(m + 1)))
                        j, simple = self.s.after(m + 1), False
                    else:
                        chain.append(w(m))
                        j = m + 1
                after = self.s.skip_angles(j)
                while w(after) == "[" and w(after + 1) == "]":
                    after += 2
                if simple and len(chain) >= 1 and self.s.is_word(after) and w(after + 1) in ("=", ";", ",", ":", ")") and w(after) not in ("instanceof",) and x.text not in ("return", "throw"):
                    shadowed.add(w(after))
                    j = after + 1
                k = max(j, k + 1)
                continue
            k += 1

    def after_lambda(self, arrow: int, stop: int) -> int:
        if self.s.word(arrow + 1) == "{":
            return self.s.after(arrow + 1)
        k = arrow + 1
        while k < stop and self.s.word(k) not in (",", ";", ")", "]", "}"):
            k = self.s.after(k) if self.t[k].kind == "op" and self.t[k].text in ("(", "{", "[") else k + 1
        return k


def extract(path: str, source: str) -> Facts:
    return _Reader(path, source).read()
