"""Symbols and raw references of Rust sources: items at the top of a file and the methods of impl blocks for plain types."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

from .facts import Facts
from .lex import Source

_KEYWORDS = set("if match while for return in loop fn move as let mut ref else unsafe async await dyn impl where use pub crate super break continue const static struct enum trait type mod box yield".split())
# what Source passes over or pairs, and places where an item can end
_MARKS = re.compile(r"""//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|"(?:\\(?s:.)|[^"\\\n])*"?|'(?:\\.[^']*|[^'\\])'|[()\[\]{}]|;(?=\n)""")
_ITEMS = {"fn", "struct", "enum", "trait", "impl", "mod"}


def module_files(path: str, name: str) -> list[str]:
    """Where the source of a module declared in path may lie."""
    folder, file = posixpath.split(path)
    stem = file.rsplit(".", 1)[0]
    if stem not in ("lib", "main", "mod"):
        folder = posixpath.join(folder, stem)
    return [posixpath.join(folder, f"{name}.rs"), posixpath.join(folder, name, "mod.rs")]


def use_items(text: str) -> list[tuple[str, list[str], str, str, bool]]:
    """(base, modules, imported, local, glob) of the items of a use declaration's text without `use` and `;`."""
    base = next((b for b in ("crate", "self", "super") if text.startswith(b + "::")), "external")
    rest = text[len(base) + 2 :] if base != "external" else text
    prefix, items = "", [rest]
    if "::{" in rest:
        prefix, _, tail = rest.partition("::{")
        items = tail[: tail.rfind("}")].split(",") if "}" in tail else tail.split(",")
    out = []
    for item in map(str.strip, items):
        if not item:
            continue
        parts = [p for p in prefix.split("::") if p] + item.split("::")
        glob = parts[-1] == "*"
        if glob:
            parts.pop()
        if not parts:
            continue
        words = parts.pop().split()
        imported = words[0] if words else ""
        local = words[2] if len(words) > 2 and words[1] == "as" else imported
        out.append((base, parts, imported, local, glob))
    return out


class _Reader:
    def __init__(self, path: str, text: str):
        self.out, self.s, self.path = Facts(path), Source(text, "rust"), path
        self.t = self.s.tokens

    def read(self) -> Facts:
        k = 0
        while k < len(self.t):
            k = max(k + 1, self.item(k))
        return self.out

    def head(self, k: int) -> int:
        """Past visibility and qualifiers."""
        while self.s.word(k) in ("pub", "unsafe", "async", "default", "extern", "const") or (k < len(self.t) and self.t[k].kind == "string"):
            if self.s.word(k) == "const" and self.s.word(k + 1) not in ("fn", "unsafe", "async", "extern"):
                return k
            k += 1
            if self.s.word(k - 1) == "pub" and self.s.word(k) == "(":
                k = self.s.after(k)
        return k

    def block(self, k: int) -> int:
        """The next { at this level, or -1 at a ;."""
        while k < len(self.t):
            if self.s.word(k) == "{":
                return k
            if self.s.word(k) == ";":
                return -1
            k = self.s.after(k) if self.t[k].kind == "op" and self.t[k].text in ("(", "[") else k + 1
        return -1

    def item(self, k: int) -> int:
        w = self.s.word
        if w(k) == "#":
            j = k + 1 + (w(k + 1) == "!")
            return self.s.after(j) if w(j) == "[" else k + 1
        j = self.head(k)
        if w(j) == "fn" and self.s.is_word(j + 1):
            return self.function(k, j, None, False)
        if w(j) in ("struct", "enum", "trait") and self.s.is_word(j + 1):
            body = self.block(j + 2)
            end = self.t[body].partner if body >= 0 else next((x for x in range(j, len(self.t)) if w(x) == ";"), len(self.t) - 1)
            self.out.symbol(f"{self.path}::{w(j + 1)}", w(j + 1), None, "type", self.t[k].line, self.t[end].line, self.t[k].column)
            return end + 1
        if w(j) == "impl":
            return self.impl(j)
        if w(j) == "mod" and self.s.is_word(j + 1):
            inline = w(j + 2) == "{"
            self.out.imported(w(j + 1), self.t[k].line, self.t[k].column, [] if inline else [(0, p) for p in module_files(self.path, w(j + 1))], [], unsupported="INLINE" if inline else "MOD")
            return self.s.after(j + 2) if inline else j + 2
        if w(j) == "use":
            end = next((x for x in range(j, len(self.t)) if w(x) == ";"), len(self.t) - 1)
            plain = j == k or (j == k + 1 and w(k) == "pub")  # a restricted visibility isn't read
            if plain and j + 1 < len(self.t):
                for base, modules, imported, local, glob in use_items(self.s.text[self.t[j + 1].start : self.t[end].start].strip()):
                    self.out.imported("::".join(modules), self.t[k].line, self.t[k].column, [], [] if glob else [(local, imported, False)], unsupported="GLOB" if glob else "USE", relative=base != "external", wildcard=False)
                    self.out.imports[-1]["module"] = f"{base}|" + "::".join(modules)
            return end + 1
        body = self.block(k) if w(k) in ("macro_rules", "extern", "static", "const", "type", "union") else -2
        if body >= 0:
            return self.s.after(body)
        return self.s.after(k) if self.t[k].kind == "op" and self.t[k].text in ("{", "(", "[") else k + 1

    def impl(self, k: int) -> int:
        body = self.block(k)
        if body < 0:
            return k + 1
        j = self.s.skip_angles(k + 1)
        split = [x for x in range(j, body) if self.s.word(x) == "for" and self.s.word(x + 1) != "<"]
        first = split[0] + 1 if split else j
        stop = next((x for x in range(first, body) if self.s.word(x) == "where"), body)
        if stop - first == 1 and self.s.is_word(first):
            m, end = body + 1, self.t[body].partner
            while m < end:
                n = self.head(m)
                if self.s.word(m) == "#" and self.s.word(m + 1) == "[":
                    m = self.s.after(m + 1)
                elif self.s.word(n) == "fn" and self.s.is_word(n + 1):
                    m = self.function(m, n, self.s.word(first), not split)
                else:
                    m = self.s.after(m) if self.t[m].kind == "op" and self.t[m].text in ("{", "(", "[") else m + 1
        return self.s.after(body)

    def function(self, start: int, k: int, owner: str | None, inherent: bool) -> int:
        name = self.s.word(k + 1)
        params = self.s.skip_angles(k + 2)
        if self.s.word(params) != "(":
            return k + 2
        body = self.block(self.s.after(params))
        if body < 0:  # a signature is no function item with a body
            return self.s.after(params)
        shadowed: set[str] = set()
        instance = False
        j, stop = params + 1, self.t[params].partner
        while j < stop:
            first = j
            while j < stop and self.s.word(j) != ",":
                j = self.s.after(j) if self.t[j].kind == "op" and self.t[j].text in ("(", "[", "{") else max(j + 1, self.s.skip_angles(j)) if self.s.word(j) == "<" else j + 1
            words = [x for x in range(first, j)]
            colon = next((x for x in words if self.s.word(x) == ":"), None)
            if colon is None and words and self.s.word(words[-1]) == "self":
                instance = True
            shadowed |= {self.s.word(x) for x in words if self.s.is_word(x) and (colon is None or x < colon)} - {"mut", "ref", "self"}
            j += 1
        calls: list[tuple] = []
        self.body(body + 1, self.t[body].partner, shadowed, calls)
        canonical = f"{self.path}::{owner}.{name}" if owner else f"{self.path}::{name}"
        self.out.symbol(canonical, name, owner, "method" if owner else "function", self.t[start].line, self.t[self.t[body].partner].line, self.t[start].column, is_static=not instance, inherent=inherent)
        for called, how, line, column in calls:
            blocked = None
            if how == "self" and not (owner and inherent and instance):
                blocked = "NO_RECEIVER"
            elif how == "direct" and called in shadowed:
                blocked = "SHADOWED"
            self.out.call(canonical, called, how, line, column, owner=owner, blocked=blocked)
        return self.s.after(body)

    def body(self, k: int, stop: int, shadowed: set[str], calls: list[tuple]) -> None:
        w = self.s.word
        while k < stop:
            x = self.t[k]
            if x.kind == "word" and x.text in _ITEMS and (self.s.is_word(k + 1) or x.text == "impl"):
                if x.text != "impl":
                    shadowed.add(w(k + 1))
                block = self.block(k)
                k = self.s.after(block) if block >= 0 else k + 2
                continue
            if x.text == "let" and w(k - 1) not in ("if", "while", "&&", "||"):
                j = k + 1
                depth = 0
                while j < stop and not (depth == 0 and w(j) in (":", "=", ";")):
                    depth += (w(j) in ("(", "[", "{")) - (w(j) in (")", "]", "}"))
                    if self.s.is_word(j) and w(j) not in ("mut", "ref", "box"):
                        shadowed.add(w(j))
                    j += 1
                k = j
                continue
            if x.kind == "word" and w(k + 1) == "!" and w(k + 2) in ("(", "[", "{"):  # a macro's tokens aren't calls
                k = self.s.after(k + 2)
                continue
            if x.kind == "op" and x.text == "(":
                self.call(k, calls)
            k += 1

    def call(self, k: int, calls: list[tuple]) -> None:
        w = self.s.word
        p = k - 1
        if p < 0:
            return
        if w(p) == ">":  # turbofish
            first = self.start_of(p)
            if first < p:
                calls.append((self.s.text[self.t[first].start : self.t[p].end], "other", self.t[first].line, self.t[first].column))
            return
        if self.t[p].kind == "word" and w(p) not in _KEYWORDS:
            if w(p - 1) == "fn":
                return
            first = self.start_of(p)
            how = "direct" if first == p else "self" if first == p - 2 and w(first) == "self" and w(p - 1) == "." else "other"
            name = w(p) if how != "other" else self.s.text[self.t[first].start : self.t[p].end]
            calls.append((name, how, self.t[first].line, self.t[first].column))
        elif self.t[p].kind == "op" and w(p) in (")", "]") and self.t[p].partner >= 0 and w(self.t[p].partner - 1) not in ("if", "match", "while", "for", "#"):
            first = self.start_of(p)
            if first < self.t[p].partner or w(p) == ")":
                calls.append((self.s.text[self.t[first].start : self.t[p].end], "other", self.t[first].line, self.t[first].column))

    def start_of(self, k: int) -> int:
        w = self.s.word
        while True:
            if self.t[k].kind == "op" and w(k) in (")", "]") and self.t[k].partner >= 0:
                k = self.t[k].partner
                if k and (self.t[k - 1].kind == "word" and w(k - 1) not in _KEYWORDS or w(k - 1) in (")", "]", ">")) and w(k - 2) != "!":
                    k -= 1
                    continue
            elif w(k) == ">":
                depth, j = 0, k
                while j >= 0:
                    depth += (w(j) == ">") - (w(j) == "<")
                    if depth == 0:
                        break
                    j -= 1
                if j <= 0 or self.t[j].text != "<":
                    return k
                k = j
                if w(k - 1) == "::":
                    k -= 2
                    continue
                if self.s.is_word(k - 1):
                    k -= 1
                    continue
                return k
            if k > 1 and w(k - 1) in (".", "::", "?"):
                k -= 2 if w(k - 1) != "?" else 1
                if w(k) == "?":
                    k -= 1
                continue
            return k


def extract(path: str, source: str) -> Facts:
    return _Reader(path, source).read()


def pieces(source: str, size: int) -> Iterator[tuple[str, int, int]]:
    """(text, lines before, characters before) of parts of a source, which end between items at the top of the file once they have size characters."""
    start = line = 0
    open_: list[str] = []
    for m in _MARKS.finditer(source):
        x = m[0]
        if x in "([{":
            open_.append(x)
            continue
        if x in ")]}":
            opener = "([{"[")]}".index(x)]
            if opener in open_:  # a stray bracket closes up to its opener, as in Source
                del open_[len(open_) - 1 - open_[::-1].index(opener) :]
        if not open_ and x in ";}" and source.startswith("\n", m.end()) and m.end() - start >= size:
            text = source[start : m.end() + 1]
            yield text, line, start
            start, line = m.end() + 1, line + text.count("\n")
    if start < len(source) or not source:
        yield source[start:], line, start
