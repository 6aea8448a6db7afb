"""JavaScript, TypeScript, PHP, Go and Rust texts, by declaration patterns over masked text and bracket spans."""

from __future__ import annotations

import re
from dataclasses import dataclass

from symgraph.extract.masking import Lines, closing, mask
from symgraph.extract.records import Found
from symgraph.extract.registry import extractor


@dataclass(frozen=True)
class Rule:
    """A declaration: its kind, its pattern (group ``name``), whether it has a body, and where it may stand."""

    kind: str
    pattern: re.Pattern
    body: bool = False
    inside: tuple[str, ...] = ()  # kinds of the owner; empty: not inside a type
    anywhere: bool = False


def _r(kind: str, pattern: str, body: bool = False, inside: tuple[str, ...] = (), anywhere: bool = False) -> Rule:
    return Rule(kind, re.compile(pattern, re.M), body, inside, anywhere)


_TYPES = ("class", "interface", "trait", "enum")
_W = r"(?P<name>[A-Za-z_$][\w$]*)"
_NOT = r"(?!(?:if|for|while|switch|catch|return|function|else|do|new|throw|typeof|await|with|super|constructor_)\b)"
_SCRIPT = [
    _r("class", rf"\bclass\s+{_W}", True),
    _r("function", rf"\bfunction\s*\*?\s*{_W}\s*(?:<[^>(]*>)?\(", True, anywhere=True),
    _r("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+{_W}\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\b|(?:\([^()]*\)|[\w$]+)\s*(?::[^=\n]+)?=>)", True),
    _r("method", rf"^[ \t]*(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*\*?\s*{_NOT}{_W}\s*(?:<[^>(]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{{;\n]+)?\{{", True, ("class",)),
    _r("property", rf"^[ \t]*(?:(?:public|private|protected|static|readonly|declare)\s+)*{_NOT}{_W}\s*[?!]?\s*(?::[^=;\n]+)?(?:=[^;\n]*)?;", False, ("class",)),
    _r("constant", rf"^(?:export\s+)?const\s+{_W}\s*(?::[^=\n]+)?=(?!\s*(?:async\s+)?(?:function\b|\([^()]*\)\s*(?::[^=\n]+)?=>|[\w$]+\s*=>))"),
    _r("variable", rf"^(?:export\s+)?(?:let|var)\s+{_W}\s*(?::[^=\n]+)?[=;](?!\s*(?:async\s+)?function\b)"),
]
RULES = {
    "javascript": _SCRIPT,
    "typescript": [
        *_SCRIPT,
        _r("interface", rf"\binterface\s+{_W}", True),
        _r("enum", rf"\benum\s+{_W}", True),
        _r("type_alias", rf"^\s*(?:export\s+)?type\s+{_W}\s*(?:<[^=]*>)?="),
        _r("property", rf"^[ \t]*(?:readonly\s+)?{_W}\??\s*:[^;\n]+[;,]?$", False, ("interface",)),
        _r("decorator", rf"^[ \t]*@{_W}", anywhere=True),
    ],
    "php": [
        _r("namespace", r"^namespace\s+(?P<name>[\w\\]+)"),
        _r("class", rf"\bclass\s+{_W}(?=\s*(?:extends|implements|\{{|$))", True),
        _r("interface", rf"^\s*interface\s+{_W}", True),
        _r("trait", rf"^\s*trait\s+{_W}", True),
        _r("enum", rf"^\s*enum\s+{_W}", True),
        _r("method", rf"\bfunction\s+&?{_W}\s*\(", True, _TYPES),
        _r("function", rf"^\s*function\s+&?{_W}\s*\(", True),
        _r("property", r"\b(?:public|private|protected|var)\s+(?:static\s+|readonly\s+)?(?:[?\w\\|]+\s+)?\$(?P<name>\w+)", False, _TYPES),
        _r("constant", rf"\bconst\s+(?:[\w\\]+\s+)?{_W}\s*=", anywhere=True),
    ],
    "go": [
        _r("package", rf"^package\s+{_W}"),
        _r("class", rf"^type\s+{_W}(?:\[[^\]]*\])?\s+struct\b", True),
        _r("interface", rf"^type\s+{_W}(?:\[[^\]]*\])?\s+interface\b", True),
        _r("type_alias", rf"^type\s+{_W}\s+(?!struct\b|interface\b)=?\s*\S"),
        _r("function", rf"^func\s+{_W}\s*(?:\[[^\]]*\])?\(", True),
        _r("method", rf"^func\s+\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*{_W}\s*\(", True),
        _r("constant", rf"^const\s+{_W}\b"),
        _r("variable", rf"^var\s+{_W}\b"),
        _r("property", rf"^[ \t]+{_W}\s+[\w*\[\].]+(?:\s+`)?", False, ("class",)),
    ],
    "rust": [
        _r("class", rf"\b(?:struct|union)\s+{_W}", True),
        _r("enum", rf"\benum\s+{_W}", True),
        _r("interface", rf"\btrait\s+{_W}", True),
        _r("impl", r"^[ \t]*(?:unsafe\s+)?impl\b(?:<[^>]*>)?\s*(?:(?P<trait>[\w:]+)(?:<[^>]*>)?\s+for\s+)?(?P<name>[\w:]+)", True),
        _r("method", rf"\bfn\s+{_W}", True, ("impl", "interface")),
        _r("function", rf"^(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe|extern)\s+)*fn\s+{_W}", True),
        _r("type_alias", rf"^(?:pub\s+)?type\s+{_W}"),
        _r("constant", rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const|static(?:\s+mut)?)\s+{_W}\s*:", anywhere=True),
        _r("property", rf"^[ \t]+(?:pub(?:\([^)]*\))?\s+)?{_W}\s*:[^:]", False, ("class",)),
    ],
}
_IMPORTS = {
    "javascript": (re.compile(r"^[ \t]*import\s+(?P<type>type\s+)?(?:(?P<names>[^'\";]+?)\s+from\s+)?['\"](?P<module>[^'\"]+)['\"]", re.M), re.compile(r"\brequire\(\s*['\"](?P<module>[^'\"]+)['\"]\s*\)"), re.compile(r"\bimport\(\s*['\"](?P<module>[^'\"]+)['\"]\s*\)"), re.compile(r"^[ \t]*export\s+(?:\*|\{[^}]*\})\s*(?:as\s+\w+\s+)?from\s+['\"](?P<module>[^'\"]+)['\"]", re.M)),
    "php": (re.compile(r"^use\s+(?:function\s+|const\s+)?(?P<module>[\w\\]+)(?:\s+as\s+(?P<names>\w+))?\s*;", re.M),),
    "go": (re.compile(r"^import\s+(?:(?P<names>[\w.]+)\s+)?\"(?P<module>[^\"]+)\"", re.M), re.compile(r"^\t(?:(?P<names>[\w.]+)\s+)?\"(?P<module>[\w./-]+)\"$", re.M)),
    "rust": (re.compile(r"^[ \t]*(?:pub\s+)?use\s+(?P<module>[\w:]+)", re.M),),
}
_IMPORTS["typescript"] = _IMPORTS["javascript"]
_HEADS = re.compile(r"\bextends\s+(?P<extends>[\w$\\., ]+?)(?=\s+implements\b|\s*\{|$)|\bimplements\s+(?P<implements>[\w$\\., ]+?)(?=\s*\{|$)")
_CALL = re.compile(r"(?<![\w$])(?P<new>new\s+)?(?P<name>\\?[A-Za-z_][\w$]*(?:(?:\.|->|::|\\)[A-Za-z_]\w*)*)(?P<mac>!)?\s*\(")
_NO_CALL = frozenset("if for while switch catch return function fn func match foreach elseif array list isset empty unset echo print typeof await import require super match else and or not in as use".split())


def _doc(text: str, start: int) -> str | None:
    """The comment that ends right above the line of an offset."""
    head = text[: text.rfind("\n", 0, start) + 1]
    head = re.sub(r"(?:[ \t]*(?:#\[[^\n]*\]|@[\w.]+(?:\([^\n]*\))?)[ \t]*\n)+$", "", head)
    m = re.search(r"(?:[ \t]*/\*\*(?:[^*]|\*(?!/))*\*/|(?:[ \t]*(?:///?|#)[^\n]*\n)*[ \t]*(?:///?|#(?!\[))[^\n]*)[ \t]*\n$", head)
    return m[0].strip() if m else None


@extractor("javascript", "typescript", "php", "go", "rust")
def extract(path: str, text: str, language: str) -> Found:
    f = Found(path, language)
    lines, masked = Lines(text), mask(text, language)
    root = f.node("file", path.rsplit("/", 1)[-1], 1, text.count("\n") + 1, path)
    spans: list[tuple[int, int, str, str, str]] = []  # start, end, kind, id, qualified name
    found = sorted(((m.start("name"), r, m) for r in RULES[language] for m in r.pattern.finditer(masked)), key=lambda x: x[0])
    stem = re.sub(r"\.\w+$", "", path.rsplit("/", 1)[-1])
    space, joint = "", "\\" if language == "php" else "::" if language == "rust" else "."
    seen: set[tuple[int, str]] = set()
    types: dict[str, str] = {}
    for at, rule, m in found:
        owner = next((s for s in reversed(spans) if s[0] < at < s[1]), None)
        in_type = owner is not None and owner[2] in (*_TYPES, "impl")
        if rule.inside and not (in_type and owner[2] in rule.inside):
            continue
        if not rule.inside and not rule.anywhere and owner is not None and (in_type or owner[2] in ("function", "method")) and rule.kind != "class":
            continue
        name = m["name"].split("::")[-1] if rule.kind == "impl" else m["name"]
        line = lines.at(m.start() + len(m[0]) - len(m[0].lstrip()))
        if (at, name) in seen:
            continue
        seen.add((at, name))
        end = at
        if rule.body:
            brace, semi = masked.find("{", m.end() - 1), masked.find(";", m.end())
            if brace >= 0 and (semi < 0 or brace < semi or language == "go"):
                end = closing(masked, brace)
        if rule.kind == "impl":
            spans.append((m.start(), end, "impl", types.get(name, root), name))
            if m["trait"]:
                f.ref(types.get(name, root), m["trait"], "implements", line)
            continue
        if rule.kind == "namespace":
            space = name
        base = owner[4] if in_type else types.get(m.groupdict().get("owner") or "") and m["owner"] or (space or stem)
        q = f"{base}{'::' if language == 'php' and rule.kind in ('method', 'property') else joint}{name}"
        parent = owner[3] if in_type else types.get(m.groupdict().get("owner") or "", root)
        id_ = f.node(rule.kind, name, line, lines.at(end) if end > at else line, q, _doc(text, m.start() + len(m[0]) - len(m[0].lstrip())), parent)
        if rule.kind in _TYPES:
            types[name] = id_
            head = masked[m.end() : masked.find("{", m.end()) if "{" in masked[m.end() :] else len(masked)]
            for h in _HEADS.finditer(head + "{"):
                for kind in ("extends", "implements"):
                    for b in (h[kind] or "").split(","):
                        f.ref(id_, b.strip().lstrip("\\"), kind, line)
        if rule.body and end > at:
            spans.append((m.start(), end, rule.kind, id_, name if rule.kind in _TYPES else q))
    for k, pattern in enumerate(_IMPORTS[language]):
        for m in pattern.finditer(text):
            if masked[m.start() : m.end()].strip():
                line, groups = lines.at(m.start() + len(m[0]) - len(m[0].lstrip())), m.groupdict()
                kind = "imports_type" if groups.get("type") else ("imports", "imports", "dynamic_imports", "re_exports")[k] if language in ("javascript", "typescript") else "imports"
                f.node("import", (groups.get("names") or m["module"]).strip(), line, qualified=m["module"], parent=root)
                f.ref(root, m["module"], kind, line)
    for m in _CALL.finditer(masked):
        name = m["name"]
        if name.split(".")[0] in _NO_CALL or name.startswith("console."):
            continue
        owner = next((s for s in reversed(spans) if s[0] < m.start() < s[1] and s[2] != "impl"), None)
        if owner and masked[: m.start()].rstrip().endswith(("function", "func", "fn")):
            continue
        if any(a[0] == m.start("name") for a in found):
            continue
        f.ref(owner[3] if owner else root, re.split(r"->", name)[-1] if "->" in name else name, "instantiates" if m["new"] else "calls", lines.at(m.start()))
    if language in ("javascript", "typescript"):
        for m in re.finditer(r"^[ \t]*export\s+(?:default\s+)?(?:abstract\s+|async\s+)?(?:class|function\*?|const|let|var|interface|enum|type)\s+([\w$]+)", masked, re.M):
            f.node("export", m[1], lines.at(m.start() + len(m[0]) - len(m[0].lstrip())), parent=root)
    return f
