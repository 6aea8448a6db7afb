"""Module resolvers: import texts to files, by candidate paths joined with the table of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes a module's path may lack, in order of preference.
SUFFIXES = {
    "javascript": ["", ".js", ".mjs", ".cjs", ".jsx", ".ts", "/index.js", "/index.ts"],
    "typescript": ["", ".ts", ".tsx", ".d.ts", ".js", ".vue", "/index.ts", "/index.js"],
    "python": [".py", ".pyi", "/__init__.py"],
    "php": [".php"],
    "css": ["", ".css", ".scss"],
    "scss": ["", ".scss", ".sass", ".css", "/_index.scss"],
    "go": [""],
    "rust": [".rs", "/mod.rs"],
}
# Modules of the languages' own libraries that are named without a path.
BUILT_IN = {
    "javascript": r"^(?:node:.*|assert|buffer|child_process|cluster|crypto|dns|events|fs|http|https|net|os|path|process|querystring|readline|stream|string_decoder|timers|tls|url|util|v8|vm|zlib)(?:/.*)?$",
    "go": r"^[a-z0-9]+(?:/[a-z0-9]+)*$",
    "rust": r"^(?:std|core|alloc)(?:::.*)?$",
    "python": r"^(?:abc|argparse|ast|asyncio|base64|collections|contextlib|copy|csv|dataclasses|datetime|enum|functools|hashlib|io|itertools|json|logging|math|os|pathlib|re|shutil|string|subprocess|sys|tempfile|threading|time|typing|unittest|urllib|uuid|warnings)(?:\..*)?$",
}


def _joined(base: Column, rel: Column) -> Column:
    """A relative path joined to a folder, with . and .. resolved."""
    parts = F.filter(F.concat(F.split(base, "/"), F.split(rel, "/")), lambda x: (x != "") & (x != "."))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))), "/")


def candidates(imports: DataFrame, language: str, alias: dict[str, str] | None = None) -> DataFrame:
    """(from_file, module, candidate, place, confidence, strategy): the paths a module name may mean."""
    m = F.col("module")
    folder = F.regexp_replace("from_file", r"[^/]*$", "")
    root = F.substring_index("from_file", "/", 1)
    rel = m.startswith(".")
    bases: list[tuple[Column, Column, float, str]] = []
    if language in ("javascript", "typescript", "css", "scss"):
        bases.append((rel | F.lit(language in ("css", "scss")), _joined(folder, m), 0.95, "relative"))
        for prefix, target in (alias or {"@/": "src/", "~/": "src/"}).items():
            bases.append((m.startswith(prefix), F.concat(root, F.lit("/" + target), F.substring(m, len(prefix) + 1, 10_000)), 0.85, "alias"))
        bases.append((~rel, F.concat(root, F.lit("/node_modules/"), m), 0.80, "package"))
        if language == "scss":
            bases.append((F.lit(True), F.regexp_replace(_joined(folder, m), r"([^/]+)$", "_$1"), 0.95, "partial"))
    elif language == "python":
        dots = F.length(F.regexp_extract(m, r"^(\.*)", 1))
        tail = F.replace(F.regexp_replace(m, r"^\.+", ""), F.lit("."), F.lit("/"))
        up = F.when(dots > 1, F.repeat(F.lit("../"), dots - 1)).otherwise("")
        bases += [(rel, _joined(folder, F.concat(up, tail)), 0.95, "relative"), (~rel, _joined(folder, tail), 0.9, "sibling"), (~rel, _joined(root, tail), 0.9, "package"), (~rel, _joined(F.concat(root, F.lit("/src")), tail), 0.9, "package")]
    elif language == "php":
        path = F.replace(m, F.lit("\\"), F.lit("/"))
        for prefix, target in (alias or {"App/": "app/"}).items():
            bases.append((path.startswith(prefix), F.concat(root, F.lit("/" + target), F.substring(path, len(prefix) + 1, 10_000)), 0.85, "psr4"))
    elif language == "rust":
        path = F.replace(m, F.lit("::"), F.lit("/"))
        bases += [(path.startswith("crate/"), F.concat(root, F.lit("/src/"), F.substring(path, 7, 10_000)), 1.0, "crate"), (path.startswith("self/"), _joined(folder, F.substring(path, 6, 10_000)), 1.0, "self"), (path.startswith("super/"), _joined(F.concat(folder, F.lit("..")), F.substring(path, 7, 10_000)), 1.0, "super")]
    elif language == "go":
        bases.append((F.lit(True), _joined(root, F.regexp_replace(m, r"^[^/]+\.[^/]+/[^/]+/[^/]+/?", "")), 1.0, "module"))
    rows = []
    for k, (when, base, conf, how) in enumerate(bases):
        for j, suffix in enumerate(SUFFIXES[language]):
            rows.append(F.when(when, F.struct(F.concat(base, F.lit(suffix)).alias("candidate"), F.lit(100 * k + j).alias("place"), F.lit(conf).alias("confidence"), F.lit(how).alias("strategy"))))
    return imports.select("from_file", "module", F.explode(F.array_compact(F.array(*rows))).alias("c")).select("from_file", "module", "c.*")


def resolve_modules(imports: DataFrame, files: DataFrame, language: str, alias: dict[str, str] | None = None) -> DataFrame:
    """(from_file, module, path, confidence, strategy): every import with the first candidate that is a file.

    Modules of the language's own library are ``builtin``; what no file answers is ``external``
    with half confidence. Candidates are joined with distinct file paths; the best is a minimum.
    """
    i = imports.select("from_file", "module").distinct()
    c = candidates(i, language, alias)
    known = files.select(F.col("file_path").alias("candidate")).distinct()
    best = c.join(known, "candidate").groupBy("from_file", "module").agg(F.min(F.struct("place", "candidate", "confidence", "strategy")).alias("b"))
    own = F.col("module").rlike(BUILT_IN[language]) if language in BUILT_IN else F.lit(False)
    out = i.join(best, ["from_file", "module"], "left")
    return out.select(
        "from_file", "module", F.col("b.candidate").alias("path"),
        F.when(F.col("b").isNotNull(), F.col("b.confidence")).when(own, 0.9 if language in ("go", "rust") else 0.3 if language == "python" else 1.0).otherwise(0.5).alias("confidence"),
        F.when(F.col("b").isNotNull(), F.col("b.strategy")).when(own, "builtin").otherwise("external").alias("strategy"),
    )


def resolve_styles(imports: DataFrame, files: DataFrame, language: str) -> DataFrame:
    """As resolve_modules; what is left is looked up by base name: 0.7 if one file has it, else 0.5 and the first path."""
    found = resolve_modules(imports, files, language)
    base = lambda c: F.regexp_replace(F.regexp_extract(c, r"_?([^/]+)$", 1), r"\.\w+$", "")
    names = files.filter(F.col("file_path").rlike(r"\.(?:css|scss|sass)$")).select("file_path", base(F.col("file_path")).alias("name")).distinct().groupBy("name").agg(F.count("*").alias("n"), F.min("file_path").alias("first"))
    out = found.withColumn("name", F.when(F.col("path").isNull(), base(F.col("module")))).join(names, "name", "left")
    return out.select("from_file", "module", F.coalesce("path", "first").alias("path"), F.when(F.col("first").isNotNull() & F.col("path").isNull(), F.when(F.col("n") == 1, 0.7).otherwise(0.5)).otherwise(F.col("confidence")).alias("confidence"), F.when(F.col("first").isNotNull() & F.col("path").isNull(), "basename").otherwise(F.col("strategy")).alias("strategy"))
