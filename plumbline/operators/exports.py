"""Exports and imports of whole JavaScript and TypeScript files, over several lines too, and exports that nothing wires up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import imports as I

# Forms of exports (declared, listed, default) and of imports (clause and source).
DECLARED = r"export\s+(?:async\s+)?(?:abstract\s+)?(?:function\*?|class|const|let|var|type|interface|enum)\s+([A-Za-z_$][\w$]*)"
LISTED = r"export\s*(?:type\s*)?\{([^}]+)\}"
DEFAULT = r"export\s+default\s+(?:(?:async\s+)?(?:function\*?|class)\s+)?([A-Za-z_$][\w$]*)"
COMMON, COMMON_LIST = r"(?:module\.)?exports\.([A-Za-z_$][\w$]*)\s*=", r"module\.exports\s*=\s*\{([^{}]*)\}"
NOT_NAMES = ("function", "class", "async", "new")
IMPORTS = [
    r"import\s*(?:type\s+)?(?:[\w$]+\s*,\s*)?\{([^}]+)\}\s*from\s*['\"]([^'\"]+)['\"]",
    r"import\s+(?:type\s+)?([\w$]+)\s*(?:,\s*(?:\{[^}]*\}|\*\s*as\s+[\w$]+)\s*)?from\s*['\"]([^'\"]+)['\"]",
    r"import\s*(?:[\w$]+\s*,\s*)?\*\s*as\s+([\w$]+)\s+from\s*['\"]([^'\"]+)['\"]",
    r"(?:const|let|var)\s*\{([^}]+)\}\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"(?:const|let|var)\s+([\w$]+)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"(?:const|let|var)\s*\{([^}]+)\}\s*=\s*await\s+import\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"(?:const|let|var)\s+([\w$]+)\s*=\s*await\s+import\(\s*['\"]([^'\"]+)['\"]\s*\)",
]
PASSED_ON = [r"export\s*\{[^}]*\}\s*from\s*['\"]([^'\"]+)['\"]", r"export\s*\*\s*(?:as\s+[\w$]+\s+)?from\s*['\"]([^'\"]+)['\"]"]
BARE = r"import\s*['\"]([^'\"]+)['\"]"
# Names of what is made to be routed, lines that route it, and shares of unwired names that make an error and a warning.
CRUD = r"(?i)^(?:create|add|insert|new|register|store|save|get|find|fetch|read|load|retrieve|show|list|search|browse|index|update|edit|modify|patch|change|set|delete|remove|destroy|revoke|drop|unregister|purge)"
ROUTED = [r"\.\s*(?:GET|POST|PUT|PATCH|DELETE|get|post|put|patch|delete)\s*\(\s*['\"][^'\"]+['\"]\s*,([^\n;]*)", r"HandleFunc\s*\(\s*\"[^\"]+\"\s*,([^\n;]*)", r"@\w+\.\s*(?:get|post|put|patch|delete)\s*\([^\n]*\n(?:[^\n]*\n){0,3}?\s*(?:async\s+)?def\s+(\w+)"]
ERROR_SHARE, WARNING_SHARE = 0.5, 0.2
SCRIPTS = ("javascript", "typescript")


def _split(clause: Column) -> Column:
    """Names of a list in brackets, before any alias."""
    parts = F.transform(F.split(clause, ","), lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"^\s+|\s+$", ""), r"^type\s+", ""), r"\s*(?:\bas\s|:)[\s\S]*$", ""))
    return F.filter(parts, lambda p: p.rlike(r"^[A-Za-z_$][\w$]*$"))


def _code(content: Column) -> Column:
    """``content`` without lines that are remarks."""
    return F.regexp_replace(content, r"(?m)^[ \t]*(?://|\*|/\*).*$", "")


def exports(files: DataFrame) -> DataFrame:
    """path, name, is_default, line of every export of ``files`` (path, language, content): declared, listed, passed on, default, and of CommonJS.

    A name that is exported in several ways is told once, at its first form. Null contents and other languages have none.
    """
    text = _code(F.col("content"))
    all_ = lambda p, i=1: F.regexp_extract_all("text", F.lit(p), i)
    one = lambda p, order, default: F.transform(all_(p), lambda n: F.struct(n.alias("name"), F.lit(default).alias("is_default"), F.lit(order).alias("order")))
    many = lambda p, order: F.transform(F.flatten(F.transform(all_(p), _split)), lambda n: F.struct(n.alias("name"), F.lit(False).alias("is_default"), F.lit(order).alias("order")))
    found = F.concat(one(DECLARED, 0, False), many(LISTED, 1), one(DEFAULT, 2, True), one(COMMON, 3, False), many(COMMON_LIST, 4))
    rows = files.where(F.col("language").isin(*SCRIPTS) & F.col("content").isNotNull()).select("path", text.alias("text"))
    rows = rows.select("path", "text", F.explode(found).alias("e")).select("path", "text", "e.*").where(~F.col("name").isin(*NOT_NAMES))
    first = rows.groupBy("path", "name").agg(F.min(F.struct("order", "is_default")).alias("f"), F.first("text").alias("text"))
    # the line on which the first statement of its form that holds the name begins
    forms = [DECLARED, LISTED, DEFAULT, COMMON, COMMON_LIST]
    heads = [f[: f.index("([")] + r"(?:[^{}]*?(?<![\w$]))?" * (i in (1, 4)) for i, f in enumerate(forms)]
    head = F.coalesce(*(F.when(F.col("f.order") == i, F.lit(h)) for i, h in enumerate(heads)))
    where = F.concat(F.lit(r"(?s)^(.*?)(?:"), head, F.lit(")"), F.regexp_replace("name", r"\$", r"\\\$"), F.lit(r"(?![\w$])"))
    before = F.expr("regexp_extract(text, __where, 1)")
    return first.withColumn("__where", where).select("path", "name", F.col("f.is_default").alias("is_default"), F.size(F.split(before, "\n")).alias("line"))


def imports(files: DataFrame) -> DataFrame:
    """path, spec, names of every import, require, dynamic import, passing on and bare import; passing on and bare imports bind no name."""
    rows = files.where(F.col("language").isin(*SCRIPTS) & F.col("content").isNotNull()).select("path", _code(F.col("content")).alias("text"))
    pairs = []
    for pattern in IMPORTS:
        clauses, specs = (F.regexp_extract_all("text", F.lit(pattern), i) for i in (1, 2))
        pairs.append(F.zip_with(clauses, specs, lambda c, s: F.struct(s.alias("spec"), _split(c).alias("names"))))
    for pattern in (*PASSED_ON, BARE):
        pairs.append(F.transform(F.regexp_extract_all("text", F.lit(pattern), 1), lambda s: F.struct(s.alias("spec"), F.array().cast("array<string>").alias("names"))))
    return rows.select("path", F.explode(F.concat(*pairs)).alias("i")).select("path", "i.*")


def dead(files: DataFrame) -> DataFrame:
    """path, line, name of exports that no file imports by name and that their own file says once only."""
    out = exports(files)
    bound = imports(files).select(F.explode("names").alias("name")).distinct()
    scripts = files.where(F.col("language").isin(*SCRIPTS) & F.col("content").isNotNull())
    words = scripts.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"([A-Za-z_$][\w$]*)"), 1)).alias("name")).groupBy("path", "name").agg(F.count("*").alias("n")).where("n > 1")
    return out.join(bound, "name", "left_anti").join(words, ["path", "name"], "left_anti").select("path", "line", "name")


def routed(files: DataFrame) -> DataFrame:
    """name: what any file of any language hands to a route, the handler and what stands before it."""
    given = F.flatten(F.array(*(F.regexp_extract_all("content", F.lit(p), 1) for p in ROUTED)))
    names = F.flatten(F.transform(given, lambda g: F.regexp_extract_all(g, F.lit(r"([A-Za-z_$][\w$]*)"), 1)))
    return files.where("language is not null and content is not null").select(F.explode(names).alias("name")).distinct()


def unwired(files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """path, line, name, folder of exports with a name of create, read, update or delete in files that nothing imports, which no route is handed: two anti joins."""
    scripts = files.where(F.col("language").isin(*SCRIPTS))
    reached = I.edges(imports(files), scripts, aliases).select(F.col("target").alias("path")).distinct()
    made = exports(files).where(F.col("name").rlike(CRUD))
    left = made.join(reached, "path", "left_anti").join(routed(files), "name", "left_anti")
    return left.select("path", "line", "name", _folder("path").alias("folder"))


def _folder(path: str) -> Column:
    return F.when(F.col(path).contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def unwired_findings(files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """folder, unwired, total, consistency, severity: by the share of a folder's such names that nothing wires up."""
    made = exports(files).where(F.col("name").rlike(CRUD)).groupBy(_folder("path").alias("folder")).agg(F.count("*").alias("total"))
    left = unwired(files, aliases).groupBy("folder").agg(F.count("*").alias("unwired"))
    share = F.col("unwired") / F.col("total")
    severity = F.when(share >= ERROR_SHARE, "error").when(share >= WARNING_SHARE, "warning").otherwise("info")
    return left.join(made, "folder").select("folder", "unwired", "total", F.floor((1 - share) * 100 + 0.5).cast("int").alias("consistency"), severity.alias("severity"))
