"""Declared dependencies that nothing imports, and imports that nothing declares, for four ecosystems.

A file belongs to the nearest module above it and an import to the longest declared name that covers it. Both are prefixes, so paths are
taken apart into their prefixes and joined by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Modules that come with a language.
NODE = ("assert", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "dns", "domain", "events", "fs", "http", "http2", "https", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "sys", "timers", "tls", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib")
PYTHON = ("os", "sys", "re", "json", "math", "datetime", "collections", "itertools", "functools", "pathlib", "typing", "abc", "io", "time", "logging", "copy", "hashlib", "base64", "subprocess", "threading", "multiprocessing", "socket", "http", "urllib", "email", "html", "xml", "csv", "sqlite3", "unittest", "argparse", "configparser", "dataclasses", "enum", "contextlib", "inspect", "asyncio", "concurrent", "signal", "shutil", "glob", "tempfile", "pickle", "struct", "textwrap", "string", "operator", "warnings")
RUST = ("std", "core", "alloc", "self", "super", "crate")
# Tools that are used without an import, names that stand for no package, files that only name packages.
TOOLS = ("@types/", "eslint", "prettier", "tsup", "vitest", "typescript", "jest", "mocha", "webpack", "rollup", "vite", "babel", "postcss", "tailwindcss", "autoprefixer", "lint-staged", "husky")
ALIAS = r"^#|^virtual:|^vite/|^next/|^\$|^server-only$|^client-only$"
FIXTURE = r"(?i)(?:fixtures?|testdata|__fixtures__|__mocks__)[/\\]"
BUILD = r"(?i)(?:^|[/\\])(?:webpack|vite|rollup|esbuild|tsup|babel|jest|vitest|tailwind|postcss|rspack|metro|next|nuxt|svelte|astro|gulpfile|gruntfile|karma|playwright|cypress)\.config\.[cm]?[jt]sx?$"
JS = (r"(?:import|from)\s+['\"]([^./][^'\"]*)['\"]", r"require\(\s*['\"]([^./][^'\"]*)['\"]\s*\)", r"import\(\s*['\"]([^./][^'\"]*)['\"]\s*\)")
# How many unused packages make a finding, and an error.
PYTHON_LEAST, JS_ERROR = 3, 6
ECOSYSTEM = {"javascript": "npm", "typescript": "npm", "go": "go", "python": "pypi", "rust": "cargo"}


def _package(spec: Column) -> Column:
    """The package of an npm import: its first segment, or two of a scope."""
    return F.when(spec.startswith("@"), F.regexp_extract(spec, r"^([^/]*(?:/[^/]*)?)", 1)).otherwise(F.regexp_extract(spec, r"^([^/]*)", 1))


def _prefixes(path: Column) -> Column:
    """All segment prefixes of a path, the empty one first."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def imports(files: DataFrame) -> DataFrame:
    """project, path, ecosystem, spec: what each file of ``files`` (project, path, language, content) imports from outside, each once.

    Remark lines import nothing. Relative imports, modules of the language and, for Go, paths without a dot are left out.
    """
    content, lang = F.col("content"), F.col("language")
    found = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), 1)
    code = F.regexp_replace(content, r"(?m)^[ \t]*(?://|\*|/\*).*$", "")
    js = F.filter(F.flatten(F.array(*(found(code, p) for p in JS))), lambda s: ~_package(s).isin(*NODE) & ~s.startswith("node:") & ~s.startswith("@/") & ~s.startswith("~"))
    blocks = found(code, r"(?m)^import\s*\(([\s\S]*?)\)")
    go = F.concat(found(code, r"(?m)^import\s+\"([^\"]+)\""), F.flatten(F.transform(blocks, lambda b: found(b, r"(?m)^\s*(?:\w+\s+)?\"([^\"]+)\""))))
    go = F.filter(go, lambda s: s.contains(".") & ~s.rlike("^https?://"))
    py = F.filter(F.transform(found(content, r"(?m)^(?:import|from)\s+(\w+)"), F.lower), lambda s: ~s.isin(*PYTHON))
    rust = F.filter(found(content, r"(?m)^use\s+(\w+)"), lambda s: ~s.isin(*RUST))
    specs = F.when(lang.isin("javascript", "typescript") & ~F.col("path").rlike(FIXTURE), F.transform(js, _package)).when(lang == "go", go).when(lang == "python", py).when(lang == "rust", rust)
    ecosystem = F.coalesce(*(F.when(lang == k, F.lit(v)) for k, v in ECOSYSTEM.items()))
    return files.where("content is not null").select("project", "path", ecosystem.alias("ecosystem"), F.explode(F.array_distinct(specs)).alias("spec"))


def nearest(files: DataFrame, modules: DataFrame) -> DataFrame:
    """project, path, dir, opaque: the module above each file (project, path) with the longest folder; files without one are left out.

    ``modules`` has project, dir ("" for the root) and opaque, which says that what it declares is not known.
    """
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    above = files.select("project", "path", F.explode(_prefixes(folder)).alias("dir"))
    return above.join(modules.select("project", "dir", "opaque"), ["project", "dir"]).groupBy("project", "path").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "opaque")).alias("m")).select("project", "path", "m.dir", "m.opaque")


def check(files: DataFrame, declared: DataFrame, modules: DataFrame) -> DataFrame:
    """project, dir, ecosystem, kind (unused or missing), dep.

    ``declared`` has project, dir, ecosystem, kind and dep; ``modules`` project, dir, module, opaque of Go modules. Only Go has modules below
    the root; the others declare at the root, dir "". Go files under a module that could not be read are left out, and a module without files
    claims nothing unused; its indirect requirements cover imports but need not be used. Imports of the project's own modules are never missing.
    For Python and Rust nothing is missing: a module's name is not its package's.
    """
    found = imports(files)
    kinds = files.select("project", "path", "language").where(F.col("language") == "go")
    at = nearest(kinds, modules).where(~F.col("opaque"))
    placed = found.where("ecosystem <> 'go'").withColumn("dir", F.lit("")).unionByName(found.where("ecosystem = 'go'").join(at.select("project", "path", "dir"), ["project", "path"]))
    used = placed.select("project", "dir", "ecosystem", "spec").distinct()

    # an import is covered by a declared name that is one of its prefixes; npm, Python and Rust names are whole
    names = F.when(F.col("ecosystem") == "go", F.slice(_prefixes(F.col("spec")), F.lit(2), 1000000)).otherwise(F.array("spec"))
    spelled = used.select("project", "dir", "ecosystem", "spec", F.explode(names).alias("name"))
    known = declared.withColumn("name", F.when(F.col("ecosystem") == "cargo", F.regexp_replace("dep", "-", "_")).otherwise(F.col("dep")))
    touched = spelled.join(known.select("project", "dir", "ecosystem", "name").distinct(), ["project", "dir", "ecosystem", "name"])

    quoted = F.flatten(F.array(*(F.regexp_extract_all("content", F.lit(p), 1) for p in (r"['\"]([^'\"]+)['\"]",))))
    named = files.where(F.col("path").rlike(BUILD) & F.col("content").isNotNull()).select("project", F.explode(F.transform(quoted, _package)).alias("name")).distinct().withColumn("ecosystem", F.lit("npm")).withColumn("dir", F.lit(""))
    credited = touched.select("project", "dir", "ecosystem", "name").unionByName(named.select("project", "dir", "ecosystem", "name")).distinct()
    needed = known.where(~F.col("kind").isin("indirect", "self"))
    needed = needed.where((F.col("ecosystem") != "npm") | ~F.coalesce(*(F.when(F.col("dep").contains(t), F.lit(True)) for t in TOOLS), F.lit(False)))
    seen = at.select("project", "dir").distinct().withColumn("ecosystem", F.lit("go"))
    go = needed.where("ecosystem = 'go'").join(seen, ["project", "dir", "ecosystem"], "left_semi")
    unused = needed.where("ecosystem <> 'go'").unionByName(go).join(credited, ["project", "dir", "ecosystem", "name"], "left_anti").select("project", "dir", "ecosystem", F.lit("unused").alias("kind"), "dep").distinct()

    own = spelled.where("ecosystem = 'go'").join(modules.where("module <> ''").select("project", F.col("module").alias("name")).distinct(), ["project", "name"]).select("project", "dir", "ecosystem", "spec")
    covered = touched.select("project", "dir", "ecosystem", "spec").unionByName(own).distinct()
    open_ = used.where("ecosystem in ('npm', 'go')").join(covered, ["project", "dir", "ecosystem", "spec"], "left_anti").where((F.col("ecosystem") == "go") | ~F.col("spec").rlike(ALIAS))
    # only projects that declare anything in the ecosystem are held to it
    held = declared.where("ecosystem = 'npm'").select("project", "ecosystem").unionByName(modules.select("project", F.lit("go").alias("ecosystem"))).distinct()
    missing = open_.join(held, ["project", "ecosystem"], "left_semi").select("project", "dir", "ecosystem", F.lit("missing").alias("kind"), F.col("spec").alias("dep"))
    return unused.unionByName(missing)


def findings(rows: DataFrame, monorepos: DataFrame | None = None) -> DataFrame:
    """project, ecosystem, kind, count, severity, confidence of ``check``'s rows. ``monorepos`` names projects whose missing packages may be their own."""
    dep = F.when((F.col("ecosystem") == "go") & (F.col("kind") == "missing"), F.array_join(F.slice(F.split("dep", "/"), 1, 3), "/")).otherwise(F.col("dep"))
    mono = rows.select("project").distinct() if monorepos is None else monorepos
    mono = mono.select("project", F.lit(monorepos is not None).alias("mono"))
    out = rows.withColumn("dep", dep).groupBy("project", "ecosystem", "kind").agg(F.count_distinct("dep").alias("count")).join(mono, "project", "left").withColumn("mono", F.coalesce("mono", F.lit(False)))
    js, missing = F.col("ecosystem") == "npm", F.col("kind") == "missing"
    severity = F.when(missing, F.when(js & F.col("mono"), "warning").otherwise("error")).otherwise(F.when(js & (F.col("count") >= JS_ERROR), "error").otherwise("warning"))
    confidence = F.when(missing, F.when(js, F.when(F.col("mono"), 0.4).otherwise(0.75)).otherwise(0.8)).otherwise(F.when(js, 0.75).when(F.col("ecosystem") == "pypi", 0.65).otherwise(0.7))
    return out.where((F.col("ecosystem") != "pypi") | (F.col("count") >= PYTHON_LEAST)).select("project", "ecosystem", "kind", "count", severity.alias("severity"), confidence.alias("confidence"))
