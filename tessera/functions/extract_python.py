"""Symbols and raw references of Python sources, by the standard library's parser."""

from __future__ import annotations

import ast

from .facts import Facts, normal_path

DYNAMIC, SHADOWED = "DYNAMIC", "SHADOWED"


def _parse(source: str) -> list[ast.stmt]:
    """Top-level statements; where the file as a whole has a syntax error, those blocks that can be read alone."""
    try:
        return ast.parse(source).body
    except (SyntaxError, ValueError, RecursionError):
        pass
    lines = source.split("\n")
    starts = [i for i, s in enumerate(lines) if s[:1].strip() and not s.startswith(("#", ")", "]", "}", "else", "elif", "except", "finally"))]
    out: list[ast.stmt] = []
    k = 0
    while k < len(starts):
        end = k + 1
        if lines[starts[k]].startswith("@"):  # a decorator belongs to what follows it
            while end < len(starts) and lines[starts[end]].startswith("@"):
                end += 1
            end = min(end + 1, len(starts))
        stop = starts[end] if end < len(starts) else len(lines)
        try:
            out += ast.parse("\n" * starts[k] + "\n".join(lines[starts[k] : stop])).body
        except (SyntaxError, ValueError, RecursionError):
            pass
        k = end
    return out


def module_paths(path: str, module: str) -> list[str]:
    """Files that a relative module may be."""
    dots = len(module) - len(module.lstrip("."))
    rest = module[dots:]
    if not dots or not rest:
        return []
    base = path.split("/")[:-1]
    if dots - 1 > len(base):
        return []
    base = base[: len(base) - (dots - 1)] + rest.split(".")
    full = normal_path("/".join(base))
    return [f"{full}.py", f"{full}/__init__.py"] if full else []


def _parameters(a: ast.arguments) -> list[str]:
    every = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
    return [x.arg for x in every]


class _Body(ast.NodeVisitor):
    """Calls and local bindings of one function body; nested definitions only bind their name."""

    def __init__(self, source: str, shadowed: set[str]):
        self.source, self.shadowed, self.calls = source, shadowed, []

    def visit_FunctionDef(self, node):
        self.shadowed.add(node.name)

    visit_AsyncFunctionDef = visit_ClassDef = visit_FunctionDef

    def _bind(self, *targets) -> None:
        self.shadowed.update(t.id for t in targets if isinstance(t, ast.Name))

    def visit_Assign(self, node):
        self._bind(*node.targets)
        self.generic_visit(node)

    def visit_AugAssign(self, node):
        self._bind(node.target)
        self.generic_visit(node)

    visit_AnnAssign = visit_AugAssign

    def visit_Import(self, node):
        self.shadowed.update((a.asname or a.name).split(".")[0] for a in node.names)

    visit_ImportFrom = visit_Import

    def visit_Call(self, node):
        f = node.func
        at = (node.lineno, node.col_offset + 1)
        if isinstance(f, ast.Name):
            self.calls.append((f.id, None, "direct", *at))
        elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
            self.calls.append((f.attr, f.value.id, "receiver", *at))
        else:
            self.calls.append((ast.get_source_segment(self.source, f) or "<dynamic>", None, "other", *at))
        self.generic_visit(node)


def extract(path: str, source: str) -> Facts:
    out = Facts(path)
    shadow: set[str] = set()

    def function(node, owner: str | None) -> None:
        names = _parameters(node.args)
        decorated = {d.id for d in node.decorator_list if isinstance(d, ast.Name)}
        receiver = names[0] if owner and names and not decorated & {"staticmethod", "classmethod"} else None
        shadowed = set(names) - {receiver}
        body = _Body(source, shadowed)
        for statement in node.body:
            body.visit(statement)
        canonical = f"{path}::{owner}.{node.name}" if owner else f"{path}::{node.name}"
        out.symbol(canonical, node.name, owner, "method" if owner else "function", node.lineno, node.end_lineno, node.col_offset + 1)
        for name, who, how, line, column in body.calls:
            blocked, how = None, how
            if how == "receiver":
                if receiver is not None and who == receiver and receiver not in body.shadowed:
                    how = "self"
                else:
                    how = "other"
            elif how == "direct" and name in body.shadowed:
                blocked = SHADOWED
            out.call(canonical, name, how, line, column, owner=owner, blocked=blocked)

    for node in _parse(source):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            function(node, None)
        elif isinstance(node, ast.ClassDef):
            out.symbol(f"{path}::{node.name}", node.name, None, "class", node.lineno, node.end_lineno, node.col_offset + 1)
            for child in node.body:
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    function(child, node.name)
        elif isinstance(node, ast.Import):
            for a in node.names:
                out.imported(a.name, node.lineno, a.col_offset + 1, [], [])
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            bindings = [(a.asname or a.name, a.name, False) for a in node.names if a.name != "*"]
            out.imported(module, node.lineno, node.col_offset + 1, [(0, p) for p in module_paths(path, module)], bindings, wildcard=any(a.name == "*" for a in node.names), relative=node.level > 0)
        elif isinstance(node, (ast.Assign, ast.AugAssign, ast.AnnAssign)):
            shadow.update(t.id for t in getattr(node, "targets", None) or [node.target] if isinstance(t, ast.Name))
    out.module_shadowed = sorted(shadow)
    return out
