"""A tolerant tokeniser for languages with braces: comments go, strings are one token, brackets know their partner."""

from __future__ import annotations

import re
from dataclasses import dataclass

_WORD = re.compile(r"[^\W\d][\w$]*|[$#@][\w$]+|\d[\w.]*")
_OPERATORS = ["===", "!==", "...", "**=", "<<=", ">>=", "&&=", "||=", "??=", "=>", "==", "!=", "<=", ">=", "&&", "||", "??", "?.", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "::", "->", ":=", "<-", ".."]
_OPEN, _CLOSE = "([{", ")]}"
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield"}


@dataclass
class Token:
    kind: str  # word, string, number, op
    text: str
    start: int
    end: int
    line: int
    column: int  # 1-based, in bytes
    partner: int = -1  # place of the matching bracket; for an unclosed one the last token


class Source:
    """Text with its tokens and positions."""

    def __init__(self, text: str, lang: str):
        self.text, self.lang = text, lang
        self._lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.tokens: list[Token] = []
        self._scan()
        self._pair()

    def place(self, at: int) -> tuple[int, int]:
        import bisect

        line = bisect.bisect_right(self._lines, at)
        return line, len(self.text[self._lines[line - 1] : at].encode()) + 1

    def _add(self, kind: str, start: int, end: int) -> None:
        line, column = self.place(start)
        self.tokens.append(Token(kind, self.text[start:end], start, end, line, column))

    def _scan(self) -> None:
        t, i, n = self.text, 0, len(self.text)
        js = self.lang == "js"
        while i < n:
            c = t[i]
            if c.isspace():
                i += 1
            elif t.startswith("//", i):
                i = self._until("\n", i)
            elif t.startswith("/*", i):
                end = t.find("*/", i + 2)
                i = n if end < 0 else end + 2
            elif c == '"' or (c == "'" and self.lang != "rust") or (c == "`" and self.lang in ("js", "go")):
                j = i + 1
                raw = c == "`" and self.lang == "go"
                while j < n and t[j] != c and (c == "`" or t[j] != "\n"):
                    j += 2 if t[j] == "\\" and not raw else 1
                self._add("string", i, min(n, j + 1))
                i = min(n, j + 1)
            elif c == "'" and self.lang == "rust":
                m = re.compile(r"'(?:\\.[^']*|[^'\\])'").match(t, i)
                i = m.end() if m else i + 1  # else a lifetime: its name follows as a word
            elif js and c == "/" and self._regex_here():
                m = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\n])*\]|[^/\\\n\[])+/\w*").match(t, i)
                if m:
                    self._add("string", i, m.end())
                    i = m.end()
                else:
                    self._add("op", i, i + 1)
                    i += 1
            elif m := _WORD.match(t, i):
                self._add("number" if c.isdigit() else "word", i, m.end())
                i = m.end()
            else:
                op = next((o for o in _OPERATORS if t.startswith(o, i)), c)
                self._add("op", i, i + len(op))
                i += len(op)

    def _until(self, what: str, at: int) -> int:
        end = self.text.find(what, at)
        return len(self.text) if end < 0 else end

    def _regex_here(self) -> bool:
        if not self.tokens:
            return True
        last = self.tokens[-1]
        if last.kind == "op":
            return last.text not in (")", "]", "}")
        return last.kind == "word" and last.text in _BEFORE_REGEX

    def _pair(self) -> None:
        stack: list[int] = []
        for k, t in enumerate(self.tokens):
            if t.kind != "op":
                continue
            if t.text in _OPEN:
                t.partner = len(self.tokens) - 1
                stack.append(k)
            elif t.text in _CLOSE and stack:
                if self.tokens[stack[-1]].text == _OPEN[_CLOSE.index(t.text)]:
                    t.partner = stack.pop()
                    self.tokens[t.partner].partner = k
                else:  # a stray bracket: close up to its opener, if there is one
                    for d in range(len(stack) - 1, -1, -1):
                        if self.tokens[stack[d]].text == _OPEN[_CLOSE.index(t.text)]:
                            t.partner = stack[d]
                            self.tokens[stack[d]].partner = k
                            del stack[d:]
                            break

    def word(self, k: int) -> str:
        return self.tokens[k].text if 0 <= k < len(self.tokens) else ""

    def is_word(self, k: int) -> bool:
        return 0 <= k < len(self.tokens) and self.tokens[k].kind == "word"

    def after(self, k: int) -> int:
        """The place after the bracket group that opens at k."""
        return self.tokens[k].partner + 1

    def skip_angles(self, k: int) -> int:
        """The place after a <...> group at k, or k if there is none."""
        if self.word(k) != "<":
            return k
        depth, j = 0, k
        while j < len(self.tokens):
            x = self.tokens[j].text
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if depth == 0:
                    return j + 1
            elif x in ("{", ";"):
                return k
            elif x in "([" and self.tokens[j].kind == "op":
                j = self.tokens[j].partner
            j += 1
        return k
