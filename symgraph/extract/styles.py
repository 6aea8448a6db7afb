"""Style sheets: classes, ids, variables, mixins, functions and their uses."""

from __future__ import annotations

import re

from symgraph.extract.masking import Lines, closing, mask
from symgraph.extract.records import Found
from symgraph.extract.registry import extractor

MAX_CHARS, MAX_FIRST_LINE = 500_000, 10_000  # larger sheets are tool output
_PRELUDE = re.compile(r"(?:^|[;{}])\s*([^;{}@]+)\{")
_AT = {
    "css_keyframes": re.compile(r"@(?:-\w+-)?keyframes\s+(?P<name>[\w-]+)"),
    "css_media_query": re.compile(r"@media\s+(?P<name>[^{]+?)\s*\{"),
    "css_layer": re.compile(r"@layer\s+(?P<name>[\w.-]+)"),
    "css_font_face": re.compile(r"(?P<name>@font-face)\b"),
    "scss_mixin": re.compile(r"@mixin\s+(?P<name>[\w-]+)"),
    "scss_function": re.compile(r"@function\s+(?P<name>[\w-]+)"),
}
_USES = (
    ("css_uses_variable", re.compile(r"var\(\s*(--[\w-]+)"), "css_variable", 0.9),
    ("css_keyframes_used_by", re.compile(r"animation(?:-name)?\s*:\s*([\w-]+)"), "css_keyframes", 0.85),
    ("scss_includes_mixin", re.compile(r"@include\s+([\w-]+)"), "scss_mixin", 0.9),
    ("scss_extends", re.compile(r"@extend\s+([.%][\w-]+)"), None, 0.9),
)


@extractor("css", "scss")
def extract(path: str, text: str, language: str) -> Found:
    f = Found(path, language)
    root = f.node("file", path.rsplit("/", 1)[-1], 1, text.count("\n") + 1, path)
    if len(text) > MAX_CHARS or len(text.split("\n", 1)[0]) > MAX_FIRST_LINE:
        f.error(1, "sheet too large to be written by hand", "warning")
        return f
    masked, lines, by = mask(text, language), Lines(text), {}

    def add(kind: str, name: str, at: int, end: int | None = None, parent: str | None = None) -> str:
        key = (kind, name)
        if key not in by:
            by[key] = f.node(kind, name, lines.at(at), lines.at(end) if end else None, parent=parent)
        return by[key]

    spans = []
    for kind, pattern in _AT.items():
        for m in pattern.finditer(masked):
            end = closing(masked, m.start()) if "{" in masked[m.start() :] else m.end()
            id_ = add(kind, m["name"].strip(), m.start(), end)
            spans.append((m.start(), end, kind, id_))
    for m in _PRELUDE.finditer(masked):
        at = m.start(1)
        for n in re.finditer(r"(?P<sign>[.#%])(?P<name>-?[A-Za-z_][\w-]*)", m[1]):
            kind = {".": "css_class", "#": "css_id", "%": "scss_placeholder"}[n["sign"]]
            id_ = add(kind, n["name"], at + n.start(), closing(masked, m.end() - 1))
            for a, b, outer, owner in spans:
                if a < at < b and outer in ("css_media_query", "css_layer"):
                    f.edge(owner, id_, "css_media_contains" if outer == "css_media_query" else "css_layer_contains", 1.0, lines.at(at))
    for m in re.finditer(r"(?:^|[;{\s])(--[\w-]+)\s*:", masked):
        add("css_variable", m[1], m.start(1))
    if language == "scss":
        for m in re.finditer(r"(?:^|[;{\s])(\$[\w-]+)\s*:", masked):
            add("scss_variable", m[1], m.start(1))
        for m in re.finditer(r"(?<![\w-])(\$[\w-]+)(?!\s*:)", masked):
            if ("scss_variable", m[1]) in by:
                f.edge(root, by["scss_variable", m[1]], "scss_uses_variable", 0.9, lines.at(m.start()))
    for m in re.finditer(r"@(import|use|forward)\s+(?:url\()?[\"']([^\"']+)[\"']", text):
        f.node("import", m[2], lines.at(m.start()), parent=root)
        f.ref(root, m[2], "scss_forwards" if m[1] == "forward" else "imports", lines.at(m.start()))
    for kind, pattern, target, conf in _USES:
        for m in pattern.finditer(masked):
            name = m[1]
            t = target or ("css_class" if name[0] == "." else "scss_placeholder")
            hit = by.get((t, name.lstrip(".%")))
            if hit:
                f.edge(root, hit, kind, conf, lines.at(m.start()))
            else:
                f.ref(root, name, kind, lines.at(m.start()))
    return f
