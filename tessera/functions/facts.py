"""What every extractor gives for a file, and its Spark schema."""

from __future__ import annotations

import posixpath

SCHEMA = """path string, lang string, package string, module_shadowed array<string>,
symbols array<struct<canonical:string,name:string,owner:string,kind:string,line:int,end_line:int,column:int,exported:boolean,is_default:boolean,is_static:boolean,arity:int,varargs:boolean,hierarchy:boolean,inherent:boolean>>,
calls array<struct<source:string,name:string,how:string,line:int,column:int,owner:string,blocked:string,cls:string,receiver:string,is_static:boolean,arity:int,member:string>>,
imports array<struct<seq:int,module:string,line:int,column:int,type_only:boolean,unsupported:string,wildcard:boolean,relative:boolean,candidates:array<struct<tier:int,path:string>>>>,
bindings array<struct<seq:int,local:string,imported:string,is_default:boolean>>,
exports array<struct<local:string,exported:string,type_only:boolean>>,
reexports array<struct<seq:int,local:string,exported:string>>,
heritage array<struct<source:string,target:string,kind:string,line:int,column:int>>"""


def normal_path(path: str) -> str | None:
    """A repository-relative path without . and ..; None if it is empty, absolute or leaves the repository."""
    if path.startswith("/"):
        return None
    out = posixpath.normpath(path) if path else "."
    return None if out == "." or out.startswith("..") else out


class Facts:
    def __init__(self, path: str):
        self.path, self.package, self.module_shadowed = path, None, []
        self.symbols, self.calls, self.imports, self.bindings, self.exports, self.reexports, self.heritage = ([] for _ in range(7))

    def symbol(self, canonical, name, owner, kind, line, end_line, column, exported=False, is_default=False, is_static=False, arity=None, varargs=False, hierarchy=False, inherent=False) -> None:
        self.symbols.append(dict(canonical=canonical, name=name, owner=owner, kind=kind, line=line, end_line=end_line, column=column, exported=exported, is_default=is_default, is_static=is_static, arity=arity, varargs=varargs, hierarchy=hierarchy, inherent=inherent))

    def call(self, source, name, how, line, column, owner=None, blocked=None, cls=None, receiver=None, is_static=False, arity=None, member=None) -> None:
        self.calls.append(dict(source=source, name=name, how=how, line=line, column=column, owner=owner, blocked=blocked, cls=cls, receiver=receiver, is_static=is_static, arity=arity, member=member))

    def imported(self, module, line, column, candidates, bindings, type_only=False, unsupported=None, wildcard=False, relative=False) -> int:
        seq = len(self.imports)
        self.imports.append(dict(seq=seq, module=module, line=line, column=column, type_only=type_only, unsupported=unsupported, wildcard=wildcard, relative=relative, candidates=[dict(tier=t, path=p) for t, p in candidates]))
        self.bindings += [dict(seq=seq, local=lo, imported=im, is_default=d) for lo, im, d in bindings]
        return seq

    def size(self) -> int:
        return len(self.symbols) + len(self.calls) + len(self.imports) + len(self.bindings) + len(self.exports) + len(self.reexports) + len(self.heritage)

    def moved(self, line: int, seq: int) -> Facts:
        """These facts with lines and seq counted on from what comes before in the file."""
        if line or seq:
            for rows, by in (((self.symbols, self.calls, self.imports, self.heritage), {"line": line, "end_line": line, "seq": seq}), ((self.bindings, self.reexports), {"seq": seq})):
                for r in (r for some in rows for r in some):
                    r |= {k: r[k] + n for k, n in by.items() if k in r}
        return self

    def row(self, lang: str) -> dict:
        keys = ("path", "package", "module_shadowed", "symbols", "calls", "imports", "bindings", "exports", "reexports", "heritage")
        return {k: getattr(self, k) for k in keys} | {"lang": lang}
