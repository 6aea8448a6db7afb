"""Python texts, by the standard library's syntax tree."""

from __future__ import annotations

import ast
import re
import warnings

from symgraph.extract.records import Found
from symgraph.extract.registry import extractor

_INTERFACES = {"ABC", "ABCMeta", "Protocol"}
_ENUMS = {"Enum", "IntEnum", "StrEnum", "Flag", "IntFlag"}
_CONSTANT = re.compile(r"[A-Z][A-Z0-9_]+$")


def _dotted(e: ast.AST | None) -> str:
    if isinstance(e, ast.Attribute):
        left = _dotted(e.value)
        return f"{left}.{e.attr}" if left else e.attr
    if isinstance(e, ast.Name):
        return e.id
    if isinstance(e, ast.Subscript):
        return _dotted(e.value)
    if isinstance(e, ast.Call):
        return _dotted(e.func)
    return ""


class _Walk:
    def __init__(self, found: Found, module: str):
        self.f, self.module, self.aliases = found, module, {}

    def name(self, dotted: str) -> str:
        """A dotted name with its first part as it was imported."""
        head, _, tail = dotted.partition(".")
        full = self.aliases.get(head, head)
        return f"{full}.{tail}" if tail else full

    def body(self, stmts: list[ast.stmt], parent: str, scope: str, in_class: bool, in_function: bool = False, enum: bool = False) -> None:
        for s in stmts:
            if isinstance(s, (ast.Import, ast.ImportFrom)):
                self.imports(s, parent)
            elif isinstance(s, ast.ClassDef):
                self.klass(s, parent, scope)
            elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.function(s, parent, scope, in_class)
            elif isinstance(s, (ast.Assign, ast.AnnAssign)):
                if not in_function:
                    self.assign(s, parent, scope, in_class, enum)
                self.calls(s, parent)
            elif isinstance(s, (ast.If, ast.Try, ast.With, ast.For, ast.While)):
                inner = [x for part in ("body", "orelse", "finalbody") for x in getattr(s, part, [])] + [x for h in getattr(s, "handlers", []) for x in h.body]
                self.body(inner, parent, scope, in_class, in_function, enum)
                for e in (getattr(s, "test", None), getattr(s, "iter", None), *[i.context_expr for i in getattr(s, "items", [])]):
                    if e is not None:
                        self.calls(e, parent)
            elif type(s).__name__ == "TypeAlias":
                self.f.node("type_alias", s.name.id, s.lineno, s.end_lineno, f"{scope}.{s.name.id}", parent=parent)
            else:
                self.calls(s, parent)

    def imports(self, s: ast.Import | ast.ImportFrom, parent: str) -> None:
        base = "." * getattr(s, "level", 0) + (getattr(s, "module", None) or "")
        for a in s.names:
            full = f"{base}.{a.name}" if isinstance(s, ast.ImportFrom) and base.strip(".") else base + a.name if isinstance(s, ast.ImportFrom) else a.name
            self.aliases[a.asname or a.name.split(".")[0]] = full if a.asname or isinstance(s, ast.ImportFrom) else a.name.split(".")[0]
            self.f.node("import", a.asname or a.name, s.lineno, s.end_lineno, full, parent=parent)
            self.f.ref(parent, full, "imports", s.lineno)

    def decorators(self, owner: str, items: list[ast.expr]) -> list[str]:
        out = []
        for e in items:
            name = _dotted(e)
            if name:
                out.append(name)
                d = self.f.node("decorator", name, e.lineno, e.end_lineno, self.name(name), parent=owner)
                self.f.edge(d, owner, "depends_on", 1.0, e.lineno)
        return out

    def klass(self, s: ast.ClassDef, parent: str, scope: str) -> None:
        bases = [b for b in map(_dotted, s.bases) if b]
        last = {b.split(".")[-1] for b in bases} | {_dotted(k.value).split(".")[-1] for k in s.keywords if k.arg == "metaclass"}
        kind = "enum" if last & _ENUMS else "interface" if last & _INTERFACES else "class"
        q = f"{scope}.{s.name}"
        id_ = self.f.node(kind, s.name, s.lineno, s.end_lineno, q, ast.get_docstring(s, False), parent, bases=bases)
        for b in bases:
            self.f.ref(id_, self.name(b), "implements" if b.split(".")[-1] in _INTERFACES else "extends", s.lineno)
        self.decorators(id_, s.decorator_list)
        self.body(s.body, id_, q, True, enum=kind == "enum")

    def function(self, s: ast.FunctionDef | ast.AsyncFunctionDef, parent: str, scope: str, in_class: bool) -> None:
        marks = [_dotted(d).split(".")[-1] for d in s.decorator_list]
        kind = "property" if in_class and set(marks) & {"property", "cached_property", "setter"} else "method" if in_class else "function"
        args = [*s.args.posonlyargs, *s.args.args, *s.args.kwonlyargs]
        seen = "private" if s.name.startswith("__") and not s.name.endswith("__") else "protected" if s.name.startswith("_") and not s.name.startswith("__") else "public"
        meta = {"visibility": seen, "is_async": isinstance(s, ast.AsyncFunctionDef), "parameters": [{"name": a.arg, "type": ast.unparse(a.annotation) if a.annotation else None} for a in args]}
        q = f"{scope}.{s.name}"
        id_ = self.f.node(kind, s.name, s.lineno, s.end_lineno, q, ast.get_docstring(s, False), parent, **meta)
        for a in args:
            if a.annotation is not None and _dotted(a.annotation):
                self.f.ref(id_, self.name(_dotted(a.annotation)), "has_type", s.lineno)
        if s.returns is not None and _dotted(s.returns):
            self.f.ref(id_, self.name(_dotted(s.returns)), "returns_type", s.lineno)
        self.decorators(id_, s.decorator_list)
        self.body(s.body, id_, q, False, True)

    def assign(self, s: ast.Assign | ast.AnnAssign, parent: str, scope: str, in_class: bool, enum: bool) -> None:
        value = ast.unparse(s.value)[:200] if s.value is not None else None
        for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
            if isinstance(t, ast.Name):
                constant = (not in_class and _CONSTANT.match(t.id)) or enum
                kind = "constant" if constant else "property" if in_class else "variable"
                id_ = self.f.node(kind, t.id, s.lineno, s.end_lineno, f"{scope}.{t.id}", parent=parent, value=value)
                if isinstance(s, ast.AnnAssign) and _dotted(s.annotation):
                    self.f.ref(id_, self.name(_dotted(s.annotation)), "has_type", s.lineno)

    def calls(self, node: ast.AST, parent: str) -> None:
        for e in ast.walk(node):
            if isinstance(e, ast.Call):
                name = _dotted(e.func)
                last = name.split(".")[-1]
                if name:
                    self.f.ref(parent, self.name(name), "instantiates" if last[:1].isupper() and not last.isupper() else "calls", e.lineno)


@extractor("python")
def extract(path: str, text: str, language: str) -> Found:
    f = Found(path, language)
    module = re.sub(r"(?:/__init__)?\.pyi?$", "", path).replace("/", ".")
    root = f.node("file", path.rsplit("/", 1)[-1], 1, text.count("\n") + 1, path)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        f.error(getattr(e, "lineno", None), f"{type(e).__name__}: {e}", node_type="module")
        return f
    _Walk(f, module).body(tree.body, root, module, False)
    return f
