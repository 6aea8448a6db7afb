"""Framework detectors: routes, models, components and their links, by declared patterns.

Every detector adds to what a file's extractor found. Links to things in other files point at
``__unresolved__:kind:name`` and are resolved by joins on names (symgraph.operators.matching).
"""

from __future__ import annotations

import re

from symgraph.extract.masking import Lines
from symgraph.extract.records import Found
from symgraph.extract.registry import detector

VERBS = ("get", "post", "put", "patch", "delete", "options", "head")
_Q = r"['\"`](?P<path>[^'\"`]*)['\"`]"


class _File:
    def __init__(self, text: str, found: Found, framework: str):
        self.text, self.found, self.framework, self.lines = text, found, framework, Lines(text)
        self.own = [n for n in found.nodes if n["kind"] in ("function", "method", "class", "variable", "constant", "property")]

    def line(self, m: re.Match, group: int | str = 0) -> int:
        return self.lines.at(m.start(group))

    def all(self, pattern: str, flags: int = 0):
        return re.compile(pattern, re.M | flags).finditer(self.text)

    def add(self, kind: str, name: str, line: int, **meta) -> str:
        return self.found.node(kind, name, line, framework=self.framework, **meta)

    def route(self, method: str, path: str, line: int, handler: str | None = None, confidence: float = 0.9, **meta) -> str:
        id_ = f"{self.found.path}:{line}:route:{method}:{path}"
        self.found.nodes.append({"id": id_, "kind": "route", "name": f"{method} {path}", "qualified_name": f"{method} {path}", "start_line": line, "end_line": line, "docblock": None, "metadata": {"framework": self.framework, "http_method": method, "url_pattern": path, **meta}})
        self.found.edge(self.found.nodes[0]["id"], id_, "contains", 1.0, line)
        if handler:
            self.found.edge(id_, handler, "routes_to", confidence, line)
        return id_

    def below(self, line: int, gap: int = 5, kinds: tuple[str, ...] = ("function", "method")) -> str | None:
        """The nearest definition that starts 0 to ``gap`` lines below."""
        near = [n for n in self.own if n["kind"] in kinds and 0 <= n["start_line"] - line <= gap]
        return min(near, key=lambda n: n["start_line"])["id"] if near else None

    def named(self, name: str, kinds: tuple[str, ...] | None = None) -> str | None:
        return next((n["id"] for n in self.found.nodes if n["name"] == name and (kinds is None or n["kind"] in kinds)), None)

    def around(self, line: int, kinds: tuple[str, ...] = ("function", "method", "class")) -> str:
        """The narrowest definition that holds a line, else the file."""
        held = [n for n in self.own if n["kind"] in kinds and n["start_line"] <= line <= n["end_line"]]
        return min(held, key=lambda n: n["end_line"] - n["start_line"])["id"] if held else self.found.nodes[0]["id"]

    def last_above(self, kind: str, line: int) -> str:
        above = [n for n in self.found.nodes if n["kind"] == kind and n["start_line"] <= line]
        return max(above, key=lambda n: n["start_line"])["id"] if above else self.found.nodes[0]["id"]

    def far(self, kind: str, name: str) -> str:
        return f"__unresolved__:{kind}:{name}"


@detector("express", "javascript", "typescript")
def express(path: str, text: str, found: Found) -> None:
    if "express" not in text:
        return
    f = _File(text, found, "express")
    for m in f.all(rf"\b(?P<app>app|router|\w*[Rr]outer|server|api)\.(?P<verb>{'|'.join(VERBS)}|all)\s*\(\s*{_Q}\s*(?P<rest>[^\n]*)"):
        line = f.line(m)
        name = re.search(r"([A-Za-z_$][\w$]*)\s*\)?\s*;?\s*$", m["rest"])
        handler = f.named(name[1], ("function", "method", "variable")) if name else None
        near = [n for n in f.own if n["kind"] in ("function", "method") and abs(n["start_line"] - line) <= 2]
        handler = handler or (min(near, key=lambda n: (abs(n["start_line"] - line), n["start_line"]))["id"] if near else None)
        f.route("ANY" if m["verb"] == "all" else m["verb"].upper(), m["path"], line, handler, 0.8)
    for m in f.all(r"\b(?:app|router|\w*[Rr]outer)\.use\s*\(\s*(?:['\"`](?P<at>[^'\"`]*)['\"`]\s*,\s*)?(?P<name>[A-Za-z_$][\w$.]*)"):
        f.add("middleware", m["name"], f.line(m), mount=m["at"])


@detector("nextjs", "javascript", "typescript")
def nextjs(path: str, text: str, found: Found) -> None:
    m = re.search(r"(?:^|/)(app|pages)/(.*)\.(?:[cm]?[jt]sx?)$", path)
    if not m or not re.search(r"\bnext\b|['\"]use (?:client|server)['\"]|\bexport\b", text):
        return
    f = _File(text, found, "nextjs")
    folder, base = (m[2].rsplit("/", 1) if "/" in m[2] else ("", m[2]))
    side = "client" if re.match(r"\s*['\"]use client['\"]", text) else "server"
    parts = [x for x in folder.split("/") if x and not re.fullmatch(r"\(.*\)|@.*", x)]
    if m[1] == "app" and base in ("page", "layout", "loading", "error", "route", "template", "not-found"):
        url = "/" + "/".join(parts)
        if base == "route":
            for v in f.all(r"\bexport\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"):
                f.route(v[1], url, f.line(v), f.named(v[1]), 0.95, side=side)
        else:
            f.route("GET", url, 1, None, file_type=base, side=side)
    elif m[1] == "pages" and not base.startswith("_"):
        url = "/" + "/".join([*parts, *([] if base == "index" else [base])])
        f.route("ANY" if parts[:1] == ["api"] else "GET", url, 1, None, side=side)


@detector("react", "javascript", "typescript")
def react(path: str, text: str, found: Found) -> None:
    tag = re.compile(r"<\s*([A-Z][\w.]*)[\s/>]")
    if not (tag.search(text) or "createContext" in text or re.search(r"\buse[A-Z]\w*\(", text)):
        return
    f = _File(text, found, "react")
    rows = text.split("\n")
    for n in list(f.own):
        if n["kind"] not in ("function", "class", "variable", "constant"):
            continue
        body = "\n".join(rows[n["start_line"] - 1 : n["end_line"]])
        if re.match(r"use[A-Z]", n["name"]):
            f.add("hook", n["name"], n["start_line"])
        elif n["name"][:1].isupper() and (tag.search(body) or re.search(r"<[a-z]+[\s>]", body) and "return" in body):
            c = f.add("component", n["name"], n["start_line"])
            for h in dict.fromkeys(re.findall(r"\b(use[A-Z]\w*)\s*\(", body)):
                found.edge(c, f.named(h, ("hook", "function")) or f.far("hook", h), "uses_hook", 0.8, n["start_line"])
            for t in dict.fromkeys(tag.findall(body)):
                if t != n["name"]:
                    found.edge(c, f.far("component", t), "renders", 0.7, n["start_line"])
    for m in f.all(r"\b(?P<name>[A-Za-z_$][\w$]*)\s*=\s*(?:React\.)?createContext\b"):
        f.add("provider", m["name"], f.line(m))
    for m in f.all(r"\buseContext\s*\(\s*(?P<name>[\w$]+)"):
        found.edge(f.around(f.line(m)), f.named(m["name"], ("provider",)) or f.far("provider", m["name"]), "consumes_context", 0.85, f.line(m))
    for m in f.all(r"<\s*(?P<name>[\w$]+)\.Provider\b"):
        found.edge(f.around(f.line(m)), f.named(m["name"], ("provider",)) or f.far("provider", m["name"]), "provides_context", 0.85, f.line(m))


@detector("vue", "javascript", "typescript")
def vue(path: str, text: str, found: Found) -> None:
    if not (path.endswith(".vue") or re.search(r"\bdefineComponent\b|\bdefineStore\b|\bcreateRouter\b|from ['\"]vue['\"]", text)):
        return
    f = _File(text, found, "vue")
    if path.endswith(".vue"):
        base = re.sub(r"\.vue$", "", path.rsplit("/", 1)[-1])
        name = "".join(x[:1].upper() + x[1:] for x in re.split(r"[-_]", path.rsplit("/", 2)[-2] if base == "index" and "/" in path else base))
        c = f.add("component", name, 1)
        t = re.search(r"<template[^>]*>([\s\S]*)</template>", text)
        for tag in dict.fromkeys(re.findall(r"<([A-Z]\w+|[a-z]+(?:-[a-z0-9]+)+)[\s/>]", t[1] if t else "")):
            found.edge(c, f.far("component", "".join(x[:1].upper() + x[1:] for x in tag.split("-"))), "renders", 0.85, 1)
        for prop in dict.fromkeys(re.findall(r"\s:([\w-]+)=", t[1] if t else "")):
            found.edge(c, f.far("prop", prop), "passes_prop", 0.85, 1)
        for event in dict.fromkeys(re.findall(r"\s@([\w-]+)", t[1] if t else "")):
            found.edge(c, f.far("event", event), "listens_to", 0.85, 1)
    for m in f.all(r"\bdefineStore\s*\(\s*['\"](?P<name>[^'\"]+)['\"]"):
        f.add("module", m["name"], f.line(m), store=True)
    for m in f.all(r"\b(?P<name>use[A-Z]\w*Store)\s*\("):
        found.edge(f.last_above("module", f.line(m)), f.far("store", m["name"]), "uses_hook", 0.8, f.line(m))
    for m in f.all(r"\bpath\s*:\s*['\"](?P<path>/[^'\"]*)['\"]"):
        f.route("GET", m["path"], f.line(m))
    for m in f.all(r"\bcomponent\s*:\s*(?:\(\)\s*=>\s*import\(\s*['\"](?P<lazy>[^'\"]+)['\"]\)|(?P<name>[A-Z]\w*))"):
        found.edge(f.last_above("route", f.line(m)), f.far("component", m["name"] or m["lazy"]), "renders", 0.85, f.line(m))
    for kind, word in (("provides_context", "provide"), ("consumes_context", "inject")):
        for m in f.all(rf"\b{word}\s*\(\s*['\"](?P<key>[^'\"]+)['\"]"):
            found.edge(f.around(f.line(m)), f.far("context", m["key"]), kind, 0.85, f.line(m))


@detector("angular", "typescript")
def angular(path: str, text: str, found: Found) -> None:
    if "@angular" not in text and not re.search(r"@(?:Component|Injectable|NgModule|Directive|Pipe)\(", text):
        return
    f = _File(text, found, "angular")
    kinds = {"Component": "component", "Injectable": "provider", "NgModule": "module", "Directive": "component", "Pipe": "provider"}
    for m in f.all(r"@(?P<mark>Component|Injectable|NgModule|Directive|Pipe)\s*\("):
        owner = f.below(f.line(m), 40, ("class",))
        if owner:
            name = owner.rsplit(":", 1)[-1]
            sel = re.search(r"selector\s*:\s*['\"]([^'\"]+)", text[m.end() : m.end() + 600])
            f.add(kinds[m["mark"]], name, f.line(m), mark=m["mark"], selector=sel[1] if sel else None)
    for m in f.all(r"\bconstructor\s*\((?P<args>[^)]*)\)"):
        for t in re.findall(r":\s*([A-Z]\w*)", m["args"]):
            found.edge(f.around(f.line(m), ("class",)), f.far("service", t), "depends_on", 0.95, f.line(m))
    for m in f.all(r"\binject\s*\(\s*(?P<name>[A-Z]\w*)\s*\)"):
        found.edge(f.around(f.line(m), ("class",)), f.far("service", m["name"]), "depends_on", 0.95, f.line(m))
    for m in f.all(r"\bpath\s*:\s*['\"](?P<path>[^'\"]*)['\"]"):
        r = f.route("GET", "/" + m["path"].lstrip("/"), f.line(m))
        near = text[max(0, m.start() - 50) : m.end() + 300]
        for kind, conf, pattern in (("renders", 0.92, r"\bcomponent\s*:\s*(\w+)"), ("dynamic_imports", 0.88, r"\bload(?:Children|Component)\s*:[^'\"]*['\"]([^'\"]+)"), ("depends_on", 0.90, r"\bcan\w+\s*:\s*\[\s*(\w+)")):
            hit = re.search(pattern, near)
            if hit:
                found.edge(r, f.far("component" if kind == "renders" else "module", hit[1]), kind, conf, f.line(m))


@detector("flask", "python")
def flask(path: str, text: str, found: Found) -> None:
    if "flask" not in text.lower():
        return
    f = _File(text, found, "flask")
    for m in f.all(rf"@(?P<obj>\w+)\.route\(\s*{_Q}(?P<rest>[^)]*)\)"):
        verbs = re.search(r"methods\s*=\s*[\[(]([^\])]*)", m["rest"])
        for v in re.findall(r"\w+", verbs[1]) if verbs else ["GET"]:
            f.route(v.upper(), m["path"], f.line(m), f.below(f.line(m)), owner=m["obj"])
    for m in f.all(r"^(?P<name>\w+)\s*=\s*Blueprint\("):
        f.add("module", m["name"], f.line(m), component_type="blueprint")
    for m in f.all(r"\b(?P<app>\w+)\.register_blueprint\(\s*(?P<name>\w+)"):
        found.edge(found.nodes[0]["id"], f.far("blueprint", m["name"]), "depends_on", 0.8, f.line(m))
    for m in f.all(r"@\w+\.(?P<hook>errorhandler|before_request|after_request|teardown_request|teardown_appcontext)\b"):
        f.add("middleware" if "request" in m["hook"] else "listener", m["hook"], f.line(m))
    for m in f.all(r"\brender_template\(\s*['\"](?P<t>[^'\"]+)['\"]"):
        found.edge(f.around(f.line(m)), f.far("template", m["t"]), "renders", 0.85, f.line(m))


@detector("fastapi", "python")
def fastapi(path: str, text: str, found: Found) -> None:
    if "fastapi" not in text and "pydantic" not in text:
        return
    f = _File(text, found, "fastapi")
    for m in f.all(rf"@(?P<obj>\w+)\.(?P<verb>{'|'.join(VERBS)}|trace|websocket)\(\s*{_Q}"):
        f.route("WEBSOCKET" if m["verb"] == "websocket" else m["verb"].upper(), m["path"], f.line(m), f.below(f.line(m)), owner=m["obj"])
    for m in f.all(r"^(?P<name>\w+)\s*=\s*APIRouter\("):
        f.add("module", m["name"], f.line(m), component_type="router")
    for m in f.all(r"\.include_router\(\s*(?P<name>[\w.]+)"):
        found.edge(found.nodes[0]["id"], f.far("router", m["name"].split(".")[-1]), "depends_on", 0.8, f.line(m))
    for m in f.all(r"\bDepends\(\s*(?P<name>[\w.]+)"):
        found.edge(f.around(f.line(m)), f.named(m["name"]) or f.far("dependency", m["name"]), "depends_on", 0.85, f.line(m))
    for n in list(f.own):
        bases = {b.split(".")[-1] for b in n["metadata"].get("bases", [])}
        if n["kind"] == "class" and bases & {"BaseModel", "BaseSettings"}:
            f.add("model", n["name"], n["start_line"], component_type="pydantic")
    for m in f.all(r"@\w+\.middleware\(|\.add_middleware\(\s*(?P<name>[\w.]+)"):
        f.add("middleware", m["name"] or "http", f.line(m))
    for m in f.all(r"@\w+\.exception_handler\(\s*(?P<name>[\w.]+)"):
        f.add("listener", m["name"], f.line(m))


@detector("django", "python")
def django(path: str, text: str, found: Found) -> None:
    if "django" not in text and not path.endswith(("urls.py", "models.py")):
        return
    f = _File(text, found, "django")
    roles = (("model", ("Model",)), ("controller", ("View", "ViewSet", "ModelViewSet", "APIView", "TemplateView", "ListView", "DetailView", "CreateView", "UpdateView", "DeleteView")), ("model", ("Serializer", "ModelSerializer")))
    for n in list(f.own):
        if n["kind"] == "class":
            last = {b.split(".")[-1] for b in n["metadata"].get("bases", [])}
            role = next((r for r, names in roles if last & set(names)), None)
            if role:
                f.add(role, n["name"], n["start_line"])
    for m in f.all(r"^[ \t]+(?P<name>\w+)\s*=\s*(?:models\.)?(?P<kind>ForeignKey|OneToOneField|ManyToManyField)\(\s*['\"]?(?P<to>[\w.]+)"):
        owner = f.around(f.line(m), ("class",))
        to = owner.rsplit(":", 1)[-1] if m["to"] == "self" else m["to"].split(".")[-1]
        found.edge(owner, f.far("model", to), "depends_on", 0.75, f.line(m), relation=m["kind"])
    for m in f.all(r"\b(?:re_path|path|url)\(\s*r?['\"](?P<path>[^'\"]*)['\"]\s*,\s*(?P<view>include\(\s*['\"][^'\"]+['\"]|[\w.]+)"):
        inc = re.search(r"['\"]([^'\"]+)", m["view"]) if m["view"].startswith("include") else None
        r = f.route("ANY", m["path"], f.line(m), include=inc[1] if inc else None)
        if not inc:
            found.edge(r, f.far("view", m["view"].removesuffix(".as_view").split(".")[-1]), "routes_to", 0.8, f.line(m))
    for m in f.all(r"@receiver\(\s*(?P<name>[\w.]+)"):
        e = f.add("listener", m["name"], f.line(m))
        found.edge(e, f.far("event", m["name"].split(".")[-1]), "listens_to", 0.9, f.line(m))
    chain = re.search(r"\bMIDDLEWARE\s*=\s*\[([^\]]*)\]", text)
    if chain:
        before = None
        for m in re.finditer(r"['\"]([\w.]+)['\"]", chain[1]):
            now = f.add("middleware", m[1], f.lines.at(chain.start(1) + m.start()))
            if before:
                found.edge(before, now, "depends_on", 0.9, None)
            before = now


@detector("laravel", "php")
def laravel(path: str, text: str, found: Found) -> None:
    if not re.search(r"\bIlluminate\\|\bRoute::|\bEloquent\b|extends\s+(?:Model|Controller)\b", text):
        return
    f = _File(text, found, "laravel")
    roles = (("model", r"(?:Model|Authenticatable|Pivot)$"), ("event", r"Event$|\\Events\\"), ("listener", r"Listener$|ShouldQueue$|\\Listeners\\"), ("middleware", r"Middleware$|\\Middleware\\"), ("provider", r"ServiceProvider$"), ("controller", r"Controller$"))
    for r in list(found.refs):
        if r["kind"] in ("extends", "implements"):
            role = next((k for k, p in roles if re.search(p, r["name"])), None)
            if role:
                f.add(role, r["source_id"].rsplit(":", 1)[-1], r["line_number"])
    for m in f.all(r"\$this->(?P<kind>hasOne|hasMany|belongsTo|belongsToMany|morphOne|morphMany|hasManyThrough|hasOneThrough|morphToMany)\(\s*\\?(?P<to>[\w\\]+)::class"):
        found.edge(f.around(f.line(m), ("class",)), f.far("model", m["to"].split("\\")[-1]), "depends_on", 0.75, f.line(m), relation=m["kind"])
    prefix = "/api" if re.search(r"(?:^|/)api[^/]*\.php$", path) else ""
    rest = {"resource": ("GET:", "GET:/create", "POST:", "GET:/{id}", "GET:/{id}/edit", "PUT:/{id}", "DELETE:/{id}"), "apiResource": ("GET:", "POST:", "GET:/{id}", "PUT:/{id}", "DELETE:/{id}")}
    for m in f.all(rf"\bRoute::(?P<verb>{'|'.join(VERBS)}|any|match|resource|apiResource)\(\s*(?:\[[^\]]*\]\s*,\s*)?{_Q}\s*,\s*(?P<to>\[[^\]]*\]|['\"][^'\"]*['\"]|\\?[\w\\]+::class)?"):
        url = prefix + "/" + m["path"].strip("/")
        for row in rest.get(m["verb"], (("ANY" if m["verb"] in ("any", "match") else m["verb"].upper()) + ":",)):
            verb, tail = row.split(":", 1)
            r = f.route(verb, url + tail, f.line(m))
            ctrl = re.search(r"([\w\\]+)(?:::class|@)", m["to"] or "")
            act = re.search(r"['\"](\w+)['\"]\s*\]|@(\w+)", m["to"] or "")
            if ctrl:
                found.edge(r, f.far("controller", ctrl[1].split("\\")[-1] + ("@" + (act[1] or act[2]) if act else "")), "routes_to", 0.85, f.line(m))
    for m in f.all(r"(?P<event>[A-Z]\w*)::class\s*=>\s*\[(?P<to>[^\]]*)\]"):
        for listener in re.findall(r"(\w+)::class", m["to"]):
            found.edge(f.far("event", m["event"]), f.far("listener", listener), "dispatches_event", 0.9, f.line(m))
            found.edge(f.far("listener", listener), f.far("event", m["event"]), "listens_to", 0.9, f.line(m))


@detector("symfony", "php")
def symfony(path: str, text: str, found: Found) -> None:
    if "Symfony\\" not in text and "Doctrine\\" not in text and "#[Route(" not in text and "#[ORM\\" not in text:
        return
    f = _File(text, found, "symfony")
    for m in f.all(rf"#\[Route\(\s*(?:path:\s*)?{_Q}(?P<rest>[^\]]*)\]"):
        verbs = re.search(r"methods:\s*\[([^\]]*)", m["rest"])
        for v in re.findall(r"\w+", verbs[1]) if verbs else ["ANY"]:
            f.route(v.upper(), m["path"], f.line(m), f.below(f.line(m), 6))
    for mark, kind in (("ORM\\\\Entity", "model"), ("AsCommand", "controller"), ("AsController", "controller")):
        for m in f.all(rf"#\[{mark}\b"):
            owner = f.below(f.line(m), 8, ("class",))
            if owner:
                f.add(kind, owner.rsplit(":", 1)[-1], f.line(m))
    for m in f.all(r"#\[ORM\\(?P<kind>ManyToOne|OneToMany|OneToOne|ManyToMany)\([^\]]*targetEntity:\s*(?P<to>\w+)"):
        found.edge(f.around(f.line(m), ("class",)), f.far("model", m["to"]), "depends_on", 0.8, f.line(m), relation=m["kind"])
    for m in f.all(r"#\[AsEventListener\((?:\s*event:)?\s*(?P<name>[\w\\]+)"):
        e = f.add("listener", m["name"], f.line(m))
        found.edge(e, f.far("event", m["name"].split("\\")[-1]), "listens_to", 0.95, f.line(m))
    for m in f.all(r"->dispatch\(\s*new\s+\\?(?P<name>[\w\\]+)"):
        found.edge(f.around(f.line(m)), f.far("event", m["name"].split("\\")[-1]), "dispatches_event", 0.85, f.line(m))
    for m in f.all(r"->render\w*\(\s*['\"](?P<t>[^'\"]+)['\"]"):
        found.edge(f.around(f.line(m)), f.far("template", m["t"]), "renders", 0.85, f.line(m))


@detector("tailwind", "css", "scss", "javascript", "typescript")
def tailwind(path: str, text: str, found: Found) -> None:
    f = _File(text, found, "tailwind")
    root = found.nodes[0]["id"]
    if re.search(r"(?:^|/)tailwind\.config\.[cm]?[jt]s$", path):
        content = re.search(r"\bcontent\s*:\s*\[([^\]]*)\]", text)
        for g in re.findall(r"['\"]([^'\"]+)['\"]", content[1] if content else ""):
            found.edge(root, f.far("glob", g), "tailwind_source_scans", 1.0, f.lines.at(content.start()))
        for m in f.all(r"\b(?P<part>colors|spacing|fontFamily|screens)\s*:\s*\{(?P<body>[^{}]*)\}"):
            ns = {"colors": "color", "spacing": "spacing", "fontFamily": "font", "screens": "breakpoint"}[m["part"]]
            for key in re.findall(r"['\"]?([\w-]+)['\"]?\s*:", m["body"]):
                found.edge(root, f.add("tailwind_theme_token", f"--{ns}-{key}", f.line(m)), "tailwind_theme_defines", 1.0, f.line(m))
        return
    if found.language not in ("css", "scss"):
        return
    for m in f.all(r"@theme\b[^{]*\{(?P<body>[^}]*)\}"):
        for p in re.finditer(r"(--[\w-]+)\s*:", m["body"]):
            line = f.lines.at(m.start("body") + p.start())
            found.edge(root, f.add("tailwind_theme_token", p[1], line), "tailwind_theme_defines", 1.0, line)
    for m in f.all(r"@utility\s+(?P<name>[\w-]+)"):
        f.add("tailwind_utility", m["name"], f.line(m))
    for m in f.all(r"@apply\s+(?P<names>[^;}]+)"):
        owner = f.last_above("css_class", f.line(m))
        for name in m["names"].split():
            found.edge(owner, f.far("utility", name), "tailwind_applies", 0.9, f.line(m))
    for m in f.all(r"@source\s+['\"](?P<glob>[^'\"]+)['\"]"):
        found.edge(root, f.far("glob", m["glob"]), "tailwind_source_scans", 1.0, f.line(m))


# Names of variables that are HTTP clients.
CLIENTS = frozenset(("http", "client", "api", "request", "req", "$http", "httpClient", "apiClient", "axiosInstance", "httpService", "apiService", "fetcher"))


def api_calls(text: str) -> list[tuple[str, str, int, float]]:
    """(url, method, line, confidence) of the HTTP calls in a script."""
    lines, out = Lines(text), []
    url = r"(?:'(?P<a>[^'\n]+)'|\"(?P<b>[^\"\n]+)\"|`(?P<t>[^`]+)`)"

    def put(m: re.Match, method: str, plain: float, template: float) -> None:
        g = m.groupdict()
        out.append((re.sub(r"\$\{[^}]+\}", "{param}", g.get("a") or g.get("b") or g["t"]), method, lines.at(m.start()), template if g.get("t") else plain))

    for m in re.finditer(rf"\bfetch\s*\(\s*{url}", text):
        verb = re.search(r"\bmethod\s*:\s*['\"](\w+)", text[m.end() : m.end() + 500].split(";")[0])
        put(m, verb[1].upper() if verb else "GET", 0.9, 0.7)
    for m in re.finditer(rf"(?P<who>[A-Za-z_$][\w$]*)\s*\.\s*(?P<verb>{'|'.join(VERBS)})\s*(?:<[^>]*>)?\s*\(\s*{url}", text):
        who = m["who"]
        if who == "axios":
            put(m, m["verb"].upper(), 0.9, 0.7)
        elif who == "$":
            put(m, m["verb"].upper(), 0.85, 0.85)
        elif who in CLIENTS or re.search(r"(?:client|http|api|service|request)$", who, re.I):
            put(m, m["verb"].upper(), 0.85, 0.65)
    for m in re.finditer(r"(?:axios|\$\.ajax)\s*\(\s*\{(?P<body>[^}]*)\}", text):
        u = re.search(r"\burl\s*:\s*['\"]([^'\"]+)", m["body"])
        v = re.search(r"\b(?:method|type)\s*:\s*['\"](\w+)", m["body"])
        if u:
            out.append((u[1], v[1].upper() if v else "UNKNOWN", lines.at(m.start()), 0.85))
    for m in re.finditer(r"\.open\s*\(\s*['\"](?P<verb>[A-Z]+)['\"]\s*,\s*['\"](?P<a>[^'\"]+)['\"]", text):
        out.append((m["a"], m["verb"], lines.at(m.start()), 0.8))
    return out
