"""Symbols and raw references of JavaScript and TypeScript sources.

Top-level functions, classes, interfaces, callables bound to a variable, and the methods of classes are
symbols. A body's facts stop at nested functions, arrows, methods and classes. Calls inside the
substitutions of template strings aren't seen.
"""

from __future__ import annotations

import posixpath

from .facts import Facts, normal_path
from .lex import Source

EXTENSIONS = ("ts", "tsx", "js", "jsx")
_NOT_CALLED = {"if", "for", "while", "switch", "catch", "with", "return", "typeof", "function", "await", "of", "in", "case", "delete", "void", "throw", "do", "else", "yield", "instanceof", "constructor"}
_MODIFIERS = {"public", "private", "protected", "static", "async", "get", "set", "readonly", "override", "abstract", "declare", "accessor"}


def module_paths(path: str, module: str) -> list[tuple[int, str]]:
    """(tier, file) candidates of a relative module; only the first tier with a hit counts."""
    if not module.startswith(("./", "../")):
        return []
    base = normal_path("/".join([*path.split("/")[:-1], module]))
    if base is None:
        return []
    stem, ext = posixpath.splitext(base)
    ext = ext[1:]
    if ext in EXTENSIONS:
        others = {"js": EXTENSIONS, "jsx": ("tsx", "jsx")}.get(ext, ())
        return [(0, base), *((1, f"{stem}.{e}") for e in others), *((2, f"{stem}/index.{e}") for e in others)]
    return [(0, f"{stem}.{e}") for e in EXTENSIONS] + [(0, f"{base}/index.{e}") for e in EXTENSIONS]


class _Reader:
    def __init__(self, path: str, text: str):
        self.out, self.s = Facts(path), Source(text, "js")
        self.t = self.s.tokens
        self.path, self.typed = path, not path.endswith((".js", ".jsx"))

    # --- top level ---------------------------------------------------------------------------------------

    def read(self) -> Facts:
        k = 0
        while k < len(self.t):
            k = max(k + 1, self.statement(k))
        return self.out

    def statement(self, k: int) -> int:
        """Read the top-level statement at k; returns where the next may start."""
        w = self.s.word
        if self.t[k].kind == "string":
            return k + 1
        if w(k) == "import" and w(k + 1) not in ("(", "."):
            return self.import_statement(k)
        exported = default = False
        if w(k) == "export":
            exported = True
            if w(k + 1) == "{" or (w(k + 1) == "type" and w(k + 2) == "{"):
                return self.export_list(k)
            k += 1
            if w(k) == "default":
                default, k = True, k + 1
        start = k
        if w(k) == "async" and w(k + 1) == "function":
            k += 1
        if w(k) == "function":
            return self.function(start, k, exported, default)
        if w(k) == "class":
            return self.class_(k, exported, default)
        if w(k) == "interface" and self.s.is_word(k + 1):
            return self.interface(k, exported)
        if w(k) in ("const", "let", "var") and not default:
            return self.variables(k, exported)
        if w(k) == "abstract" and w(k + 1) == "class":
            return self.skip_to_body(k)
        if self.t[k].text in "([{" and self.t[k].kind == "op":
            return self.s.after(k)
        return k + 1

    def skip_to_body(self, k: int) -> int:
        while k < len(self.t) and self.s.word(k) not in ("{", ";"):
            k = self.s.after(k) if self.t[k].text in ("(", "[") and self.t[k].kind == "op" else k + 1
        return self.s.after(k) if k < len(self.t) and self.s.word(k) == "{" else k + 1

    def body_of(self, params: int) -> int:
        """The { of the body that follows the parameter list at params, past a return type; -1 without one."""
        k = self.s.after(params)
        if self.s.word(k) == ":":
            k += 1
            while k < len(self.t):
                x = self.s.word(k)
                if x == "{" and self.s.word(k - 1) not in (":", "|", "&", "=>", "<", ","):
                    break
                if x in (";", ")", "=", ","):
                    return -1
                k = self.s.after(k) if x in ("(", "[", "{") and self.t[k].kind == "op" else max(k + 1, self.s.skip_angles(k))
        return k if k < len(self.t) and self.s.word(k) == "{" else -1

    def params_from(self, k: int) -> int:
        """The ( of a parameter list at k, past type parameters."""
        k = self.s.skip_angles(k)
        return k if self.s.word(k) == "(" else -1

    def function(self, start: int, k: int, exported: bool, default: bool) -> int:
        if self.s.word(k + 1) == "*" or not self.s.is_word(k + 1):
            return self.skip_to_body(k)
        params = self.params_from(k + 2)
        body = self.body_of(params) if params >= 0 else -1
        if body < 0:
            return k + 2
        self.callable(start, self.s.word(k + 1), None, "function", params, body, exported, default)
        return self.s.after(body)

    def callable(self, start: int, name: str, owner: str | None, kind: str, params: int, body: int, exported=False, default=False, static=False, last: int | None = None) -> None:
        """Add a function or method and what its body refers to; params may be a single name, body an expression up to last."""
        end = self.t[self.t[body].partner] if last is None else self.t[last]
        end_line = self.s.place(max(end.start, end.end - 1))[0]
        canonical = f"{self.path}::{owner}.{name}" if owner else f"{self.path}::{name}"
        at = self.t[start]
        self.out.symbol(canonical, name, owner, kind, at.line, end_line, at.column, exported, default, static)
        b = _Body(self)
        if self.s.word(params) == "(":
            b.parameters(params)
        elif self.s.is_word(params):
            b.shadowed.add(self.s.word(params))
        b.walk(body + 1, self.t[body].partner) if last is None else b.walk(body, last + 1)
        for name_, receiver, how, line, column in b.calls:
            blocked, cls = None, None
            if how == "receiver":
                known = [x for x in b.bindings if x[0] == receiver and x[2:] <= (line, column)]
                if not known:
                    how = "other"
                else:
                    how, cls = "constructed", known[0][1]
                    if len(known) > 1:
                        blocked = "MANY_BINDINGS"
                    elif receiver in b.reassigned:
                        blocked = "REASSIGNED"
                    elif cls in b.shadowed:
                        blocked = "SHADOWED_CLASS"
            elif how == "direct" and name_ in b.shadowed:
                blocked = "SHADOWED"
            elif how == "self" and not owner:
                blocked = "NO_CLASS"
            self.out.call(canonical, name_, how, line, column, owner=owner, blocked=blocked, cls=cls, receiver=receiver, is_static=static)

    def heritage(self, k: int, stop: int, source: str, first: str) -> None:
        """Names of the clauses between k and stop."""
        kind, expect = first, False
        while k < stop:
            x = self.s.word(k)
            if x in ("extends", "implements"):
                kind, expect = ("IMPLEMENTS" if x == "implements" else "EXTENDS"), True
            elif x == ",":
                expect = True
            elif expect and self.s.is_word(k):
                after = self.s.skip_angles(k + 1)
                if self.s.word(after) not in (".", "("):
                    self.out.heritage.append(dict(source=source, target=x, kind=kind, line=self.t[k].line, column=self.t[k].column))
                else:
                    while after < stop and self.s.word(after) not in (",", "implements"):
                        after += 1
                expect = False
                k = after
                continue
            k += 1

    def open_brace(self, k: int) -> int:
        while k < len(self.t) and self.s.word(k) != "{":
            if self.s.word(k) == ";":
                return -1
            k = max(k + 1, self.s.skip_angles(k))
        return k if k < len(self.t) else -1

    def class_(self, k: int, exported: bool, default: bool) -> int:
        name = self.s.word(k + 1)
        body = self.open_brace(k + 1)
        if body < 0:
            return k + 1
        if not self.s.is_word(k + 1) or name in ("extends", "implements"):
            return self.s.after(body)
        end = self.t[self.t[body].partner]
        self.out.symbol(f"{self.path}::{name}", name, None, "class", self.t[k].line, end.line, self.t[k].column, exported, default)
        if self.typed:
            self.heritage(k + 2, body, f"{self.path}::{name}", "EXTENDS")
        self.members(name, body + 1, self.t[body].partner)
        return self.s.after(body)

    def members(self, owner: str, k: int, stop: int) -> None:
        while k < stop:
            start = k
            static = False
            while self.s.word(k) == "@":  # a decorator isn't part of the member
                k += 2
                while self.s.word(k) == ".":
                    k += 2
                if self.s.word(k) == "(":
                    k = self.s.after(k)
                start = k
            while self.s.word(k) in _MODIFIERS and self.s.word(k + 1) not in ("(", "=", ";", ":", "<", "?", "!"):
                static |= self.s.word(k) == "static"
                k += 1
            if self.s.word(k) == "*":
                k += 1
            if k >= stop:
                return
            named = self.s.is_word(k) or self.t[k].kind == "string"
            after = k + 1
            if self.s.word(k) == "[":
                named, after = True, self.s.after(k)
            params = self.params_from(after + (self.s.word(after) == "?")) if named else -1
            body = self.body_of(params) if params >= 0 else -1
            if 0 <= body < stop:
                name = self.s.text[self.t[k].start : self.t[after - 1].end]
                self.callable(start, name, owner, "method", params, body, static=static)
                k = self.s.after(body)
                continue
            line = None
            while k < stop:  # a field or a signature: up to ; or a line that begins something new
                x = self.t[k]
                if x.text == ";":
                    k += 1
                    break
                if line is not None and x.line > line and self.t[k - 1].text not in ("=", "=>", ",", "+", "|", "&", ":", "?", "&&", "||") and x.text not in (".", "?.", "=", "|", "&", "?", ":", "+", ")", "&&", "||"):
                    break
                k = self.s.after(k) if x.kind == "op" and x.text in ("(", "[", "{") else k + 1
                line = self.t[k - 1].line if k else None

    def interface(self, k: int, exported: bool) -> int:
        name, body = self.s.word(k + 1), self.open_brace(k + 2)
        if body < 0:
            return k + 1
        self.out.symbol(f"{self.path}::{name}", name, None, "type", self.t[k].line, self.t[self.t[body].partner].line, self.t[k].column, exported)
        self.heritage(k + 2, body, f"{self.path}::{name}", "EXTENDS")
        return self.s.after(body)

    def variables(self, k: int, exported: bool) -> int:
        k += 1
        while k < len(self.t):
            name = k
            if not self.s.is_word(k):
                k = self.s.after(k) if self.t[k].text in ("{", "[") else k + 1
                name = -1
            else:
                k += 1
            while k < len(self.t) and self.s.word(k) not in ("=", ",", ";"):  # a type
                if self.t[k].line > self.t[k - 1].line and self.s.word(k - 1) not in (":", "|", "&", "=>"):
                    return k
                k = self.s.after(k) if self.t[k].text in ("(", "[", "{") and self.t[k].kind == "op" else max(k + 1, self.s.skip_angles(k))
            if self.s.word(k) == "=":
                k = self.value(name, k + 1, exported)
            if self.s.word(k) != ",":
                return k
            k += 1
        return k

    def value(self, name: int, k: int, exported: bool) -> int:
        """The initialiser at k: a symbol if it is a function or arrow; returns its end."""
        first = k
        if self.s.word(k) == "async":
            k += 1
        if self.s.word(k) == "function" and self.s.word(k + 1) != "*":
            params = self.params_from(k + 1 + self.s.is_word(k + 1))
            body = self.body_of(params) if params >= 0 else -1
            if body >= 0:
                if name >= 0:
                    self.callable(name, self.s.word(name), None, "function", params, body, exported)
                return self.s.after(body)
        arrow = self.arrow(k)
        if arrow >= 0:
            params = self.s.skip_angles(k)
            if self.s.word(arrow + 1) == "{":
                end = self.s.after(arrow + 1)
                if name >= 0:
                    self.callable(name, self.s.word(name), None, "function", params, arrow + 1, exported)
                return end
            end = self.expression_end(arrow + 1)
            if name >= 0 and end > arrow + 1:
                self.callable(name, self.s.word(name), None, "function", params, arrow + 1, exported, last=end - 1)
            return end
        return self.expression_end(first)

    def arrow(self, k: int) -> int:
        """The => of an arrow function whose parameters start at k, or -1."""
        k = self.s.skip_angles(k)
        if self.s.is_word(k) and self.s.word(k + 1) == "=>":
            return k + 1
        if self.s.word(k) != "(":
            return -1
        j = self.s.after(k)
        if self.s.word(j) == "=>":
            return j
        if self.s.word(j) == ":":  # a return type
            for m in range(j + 1, min(j + 60, len(self.t))):
                if self.s.word(m) == "=>":
                    return m
                if self.s.word(m) in (";", "{", "}", ")"):
                    return -1
        return -1

    def expression_end(self, k: int) -> int:
        """Where the expression at k ends: before a , ; or closing bracket, or a line that can't continue it."""
        first = k
        while k < len(self.t):
            x = self.t[k]
            if x.kind == "op" and x.text in (",", ";", ")", "]", "}"):
                return k
            if k > first and x.line > self.s.place(self.t[k - 1].end - 1)[0] and x.kind in ("word", "string", "number") and (self.t[k - 1].kind != "op" or self.t[k - 1].text in (")", "]", "}")) and x.text not in ("instanceof", "in", "of", "as"):
                return k
            k = self.s.after(k) if x.kind == "op" and x.text in ("(", "[", "{") else k + 1
        return k

    # --- imports and exports -----------------------------------------------------------------------------

    def names(self, k: int) -> list[tuple[str, str, bool]]:
        """(local, imported, type) of the specifiers in the braces at k."""
        out, j, stop = [], k + 1, self.t[k].partner
        while j < stop:
            typed = self.s.word(j) == "type" and self.s.is_word(j + 1) and self.s.word(j + 1) != "as"
            j += typed
            first = last = self.s.word(j)
            if self.s.word(j + 1) == "as":
                last = self.s.word(j + 2)
            out.append((last, first, typed))
            while j < stop and self.s.word(j) != ",":
                j += 1
            j += 1
        return out

    def import_statement(self, k: int) -> int:
        start, type_only = k, False
        k += 1
        if self.s.word(k) == "type" and self.s.word(k + 1) not in ("from", ",", "="):
            type_only, k = True, k + 1
        bindings: list[tuple[str, str, bool]] = []
        unsupported = None
        while k < len(self.t) and self.t[k].kind != "string":
            if self.s.word(k) == "{":
                bindings += [(local, name, False) for local, name, _ in self.names(k)]
                k = self.s.after(k)
            elif self.s.word(k) == "*":
                unsupported, k = "NAMESPACE", k + 3
            elif self.s.word(k) in ("from", ","):
                k += 1
            elif self.s.word(k) in (";", "="):
                return k + 1
            else:
                bindings.append((self.s.word(k), "", True))
                k += 1
        if k >= len(self.t):
            return k
        module = self.t[k].text[1:-1]
        self.out.imported(module, self.t[start].line, self.t[start].column, module_paths(self.path, module), bindings, type_only, unsupported, relative=module.startswith(("./", "../")))
        return k + 1

    def export_list(self, k: int) -> int:
        start, type_only = k, self.s.word(k + 1) == "type"
        k += 1 + type_only
        names = [(name, local) for local, name, typed in self.names(k) if not typed]
        after = self.s.after(k)
        if self.s.word(after) == "from" and after + 1 < len(self.t) and self.t[after + 1].kind == "string":
            module = self.t[after + 1].text[1:-1]
            if not type_only:
                seq = self.out.imported(module, self.t[start].line, self.t[start].column, module_paths(self.path, module), [], unsupported="REEXPORT")
                self.out.reexports += [dict(seq=seq, local=a, exported=b) for a, b in names]
            return after + 2
        self.out.exports += [dict(local=a, exported=b, type_only=type_only) for a, b in names]
        return after


class _Body:
    """Calls, bindings and shadowed names of one callable."""

    def __init__(self, reader: _Reader):
        self.r, self.s, self.t = reader, reader.s, reader.t
        self.calls: list[tuple] = []
        self.bindings: list[tuple] = []  # name, class, line, column
        self.reassigned: set[str] = set()
        self.shadowed: set[str] = set()

    def parameters(self, k: int) -> None:
        self.pattern(k + 1, self.t[k].partner)

    def pattern(self, k: int, stop: int) -> None:
        """Bound names between k and stop: not keys, not shorthand properties, not types."""
        in_object = self.s.word(k - 1) == "{"
        while k < stop:
            x = self.t[k]
            if x.kind == "op" and x.text in ("{", "[", "("):
                self.pattern(k + 1, x.partner)
                k = x.partner + 1
            elif x.text == ":" and not in_object:  # a type, up to the next parameter or default
                k += 1
                while k < stop and self.s.word(k) not in (",", "="):
                    k = self.s.after(k) if self.t[k].kind == "op" and self.t[k].text in ("(", "[", "{") else max(k + 1, self.s.skip_angles(k))
            elif x.kind == "word":
                key = in_object and self.s.word(k - 1) in ("{", ",") and self.s.word(k + 1) in (":", ",", "}", "=")
                if not key and self.s.word(k - 1) != "." and x.text not in ("this", "public", "private", "protected", "readonly", "true", "false", "null", "new"):
                    self.shadowed.add(x.text)
                k += 1
            else:
                k += 1

    def walk(self, k: int, stop: int) -> None:
        w = self.s.word
        declared = 0  # declarators may follow a comma at the level of a const, let or var
        while k < stop:
            x = self.t[k]
            if x.kind == "word" and w(k - 1) not in (".", "?."):
                if x.text == "function":
                    statement = w(k - 1) in ("{", "}", ";", ")", "async") or k == 0 or self.t[k - 1].line < x.line
                    named = k + 1 + (w(k + 1) == "*")
                    if statement and self.s.is_word(named) and w(k - 1) not in ("=", "(", ",", "return", ":"):
                        if w(k + 1) != "*":
                            self.shadowed.add(w(named))
                    k = self.r.skip_to_body(k)
                    continue
                if x.text == "class":
                    if self.s.is_word(k + 1) and w(k - 1) not in ("=", "(", ",", "return", ":"):
                        self.shadowed.add(w(k + 1))
                    k = self.r.skip_to_body(k)
                    continue
                arrow = self.r.arrow(k) if w(k + 1) == "=>" else -1
                if arrow >= 0:
                    k = self.after_arrow(arrow)
                    continue
                if x.text in ("const", "let", "var") and (self.s.is_word(k + 1) or w(k + 1) in ("{", "[")):
                    k, declared = self.declarator(k + 1, x.text), 1
                    continue
                if w(k + 1) == "(" and w(k - 1) in ("{", ",", "get", "set", "async", "*") and x.text not in _NOT_CALLED:
                    body = self.r.body_of(k + 1)
                    if body >= 0:  # a method of an object literal
                        k = self.s.after(body)
                        continue
                if w(k + 1) == "=" and w(k - 1) not in ("const", "let", "var"):
                    self.reassigned.add(x.text)
                if "++" in (w(k + 1), w(k - 1)) or "--" in (w(k + 1), w(k - 1)):
                    self.reassigned.add(x.text)
            if x.kind == "op":
                if x.text == "(":
                    if self.r.arrow(k) >= 0:
                        k = self.after_arrow(self.r.arrow(k))
                        continue
                    self.call(k)
                if x.text == ";":
                    declared = 0
                if x.text == "," and declared and self.s.is_word(k + 1) and w(k + 2) in ("=", ",", ";", ":"):
                    k = self.declarator(k + 1, "")
                    continue
                if x.text in ("(", "[", "{"):
                    self.walk(k + 1, x.partner)
                    k = x.partner + 1
                    continue
            k += 1

    def after_arrow(self, arrow: int) -> int:
        return self.s.after(arrow + 1) if self.s.word(arrow + 1) == "{" else max(arrow + 1, self.r.expression_end(arrow + 1))

    def declarator(self, k: int, keyword: str) -> int:
        w = self.s.word
        if not self.s.is_word(k):
            if w(self.s.after(k)) not in ("of", "in"):
                self.pattern(k + 1, self.t[k].partner)
            return self.s.after(k)
        if w(k + 1) in ("of", "in"):
            return k + 1
        self.shadowed.add(w(k))
        j = k + 1
        if w(j) == ":":
            while j < len(self.t) and w(j) not in ("=", ";", ","):
                j = self.s.after(j) if self.t[j].kind == "op" and self.t[j].text in ("(", "[", "{") else max(j + 1, self.s.skip_angles(j))
        if w(j) == "=" and w(j + 1) == "new" and self.s.is_word(j + 2) and w(j + 3) not in (".",) and keyword == "const":
            end = self.s.skip_angles(j + 3)
            end = self.s.after(end) if w(end) == "(" else end
            if w(end) not in (".", "?.", "[", "("):
                self.bindings.append((w(k), w(j + 2), self.t[k].line, self.t[k].column))
        return j + 1 if w(j) == "=" else j

    def start_of(self, k: int) -> int:
        """First token of the postfix chain that ends at token k."""
        while True:
            x = self.t[k]
            if x.kind == "op" and x.text in (")", "]") and x.partner >= 0:
                k = x.partner
                before = self.t[k - 1] if k else None
                joined = before is not None and ((before.kind == "word" and before.text not in _NOT_CALLED) or (before.kind == "op" and before.text in (")", "]")) or before.kind == "string")
                if joined:
                    k -= 1
                    continue
            if k and self.s.word(k - 1) in (".", "?."):
                k -= 2
                continue
            if k and self.s.word(k - 1) == "new":
                k -= 1
            return k

    def call(self, k: int) -> None:
        """Record the call whose arguments open at k, if it is one."""
        w = self.s.word
        p = k - 1
        if p < 0:
            return
        if w(p) == ">":  # type arguments
            depth = 0
            while p >= 0:
                depth += (w(p) == ">") - (w(p) == "<")
                if depth == 0:
                    break
                if self.t[p].text in (";", "{", "}", "(", ")"):
                    return
                p -= 1
            p -= 1
            if not self.s.is_word(p):
                return
        x = self.t[p]
        if w(p) == "?.":
            p -= 1
            x = self.t[p]
        if x.kind == "word":
            if w(p - 1) in (".", "?."):
                owner = p - 2
                first = self.start_of(owner)
                if self.t[first].text == "new" and self.new_ends_after(first, p):
                    return
                alone = first == owner and self.t[owner].kind == "word"
                how = "self" if alone and w(owner) == "this" else "receiver" if alone and w(owner) != "super" else "other"
                self.calls.append((x.text, w(owner) if how == "receiver" else None, how, self.t[first].line, self.t[first].column))
                return
            if w(p - 1) == "new" or x.text in _NOT_CALLED:
                return
            how = "other" if x.text in ("super", "import") else "direct"
            self.calls.append((x.text, None, how, x.line, x.column))
        elif x.kind == "op" and x.text in (")", "]") and x.partner >= 0:
            if x.text == ")" and w(x.partner - 1) in ("if", "for", "while", "switch", "with", "catch"):
                return
            first = self.start_of(p)
            self.calls.append((self.s.text[self.t[first].start : x.end], None, "other", self.t[first].line, self.t[first].column))

    def new_ends_after(self, first: int, p: int) -> bool:
        """Whether the chain from `new` at first reaches the word p without arguments of its own: then p is what is constructed."""
        return not any(self.t[j].kind == "op" and self.t[j].text in ("(", "[") for j in range(first, p))


def extract(path: str, source: str) -> Facts:
    return _Reader(path, source).read()
