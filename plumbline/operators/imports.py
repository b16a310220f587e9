"""The import graph of a table of files: extraction, resolution, in-degrees, dead files and exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import stored
from plumbline.operators.similarity import bind, holds

# Endings tried for a specifier without one, endings that stand for others, and index files, in order.
ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
MAPPED = {".js": [".ts", ".tsx", ".js", ".jsx"], ".jsx": [".tsx", ".jsx"], ".mjs": [".mts", ".mjs"], ".cjs": [".cts", ".cjs"]}
INDEXES = ["index.ts", "index.tsx", "index.js", "index.jsx", "index.mjs"]

_ENDING = r"\.(?:ts|tsx|js|jsx|mjs|cjs)$"
_FROM = r"^\s*(import|export)\s+(?:type\s+)?(.*?)\s*(?:from\s*)?['\"]([^'\"]+)['\"]"
_REQUIRE = r"(?:const|let|var)\s+(.*?)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]"
_EXPORT = r"^\s*export\s+(default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\*?|class|const|let|var|type|interface|enum)\s+([A-Za-z_$][\w$]*)"


def _names(clause: Column) -> Column:
    """Names that an import clause binds, before any alias."""
    parts = F.transform(F.split(F.regexp_replace(clause, r"[{}]", ","), ","), lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), r"^type\s+", ""), r"\s+as\s+.*$", ""))
    return F.filter(parts, lambda p: p != "")


def imports(lines: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, spec, names) of each import, re-export and require that stands on one line; re-exports bind no name."""

    def found(t: Column) -> Column:
        hit = lambda p, i: F.regexp_extract(t, p, i)
        from_spec, req_spec = hit(_FROM, 3), hit(_REQUIRE, 2)
        clause = F.when(hit(_FROM, 1) == "import", hit(_FROM, 2)).when(req_spec != "", hit(_REQUIRE, 1)).otherwise("")
        return F.struct(F.when(from_spec != "", from_spec).otherwise(req_spec).alias("spec"), _names(clause).alias("names"))

    # every form holds one of these words, which are sooner looked for than five patterns
    return _taken(lines, [path], text, ("import", "export", "require"), found).where("spec <> ''").select(F.col(path).alias("path"), "spec", "names")


def exports(lines: DataFrame, path: str = "path", line: str = "line", text: str = "text") -> DataFrame:
    """(path, line, name, is_default) of each declaration that is exported where it stands."""
    found = lambda t: F.struct(F.regexp_extract(t, _EXPORT, 2).alias("name"), (F.regexp_extract(t, _EXPORT, 1) != "").alias("is_default"))
    return _taken(lines, [path, line], text, ("export",), found).where("name <> ''").select(F.col(path).alias("path"), F.col(line).alias("line"), "name", "is_default")


def _taken(lines: DataFrame, keep: list[str], text: str, words: tuple[str, ...], found: Callable[[Column], Column]) -> DataFrame:
    """``keep`` and the fields of ``found`` of lines that hold one of ``words``.

    The text is bound and exploded from, so that no filter is pushed into the expression that the text comes from.
    """
    some = F.explode_outer(bind(F.col(text), lambda t: F.when(holds(t, words), F.array(found(t)))))
    return lines.select(*keep, some.alias("__found")).where("__found is not null").select(*keep, "__found.*")


def normal_path(path: Column) -> Column:
    """``path`` without empty and ``.`` segments, each ``..`` taking the segment before it."""
    step = lambda a, s: F.when(s.isin("", "."), a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def base_key(path: Column) -> Column:
    """The name by which an unresolved specifier meets files: the last segment without ending, or the folder of an index file."""
    bare = F.regexp_replace(path, _ENDING, "")
    last = F.regexp_extract(bare, r"([^/]*)/*$", 1)
    folder = F.regexp_extract(bare, r"([^/]+)/+index/*$", 1)
    return F.when((last == "index") & (folder != ""), folder).otherwise(last)


def _target(path: Column, spec: Column, aliases: dict[str, str] | None) -> Column:
    """The path that ``spec`` names from ``path``, before any ending; null for bare packages and protocols."""
    folder = F.regexp_extract(path, r"^(.*/)[^/]*$", 1)
    target = F.when(spec.startswith("."), normal_path(F.concat(folder, spec)))
    for pattern, place in reversed((aliases or {}).items()):
        prefix = pattern.replace("*", "")
        target = F.when(spec.startswith(prefix), normal_path(F.concat(F.lit(place.replace("*", "")), F.substr(spec, F.lit(len(prefix) + 1))))).otherwise(target)
    return F.when(~spec.contains(":"), target)


def _ending(spec: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(spec, r"([^/]*)$", 1), r"^[^.].*(\.[^.]+)$", 1)


def _listed(whole: Column, end: Column) -> Column:
    """Paths that a target with an ending may stand for, best first."""
    stem = whole.substr(F.lit(1), F.length(whole) - F.length(end))
    none = F.array().cast("array<string>")
    mapped = none
    for given, stands in MAPPED.items():
        mapped = F.when(end == given, F.array(*(F.concat(stem, F.lit(s)) for s in stands))).otherwise(mapped)
    added = F.when(end == "", F.array(*(F.concat(whole, F.lit(s)) for s in ENDINGS))).otherwise(none)
    inside = F.array(*(F.concat(whole, F.lit("/" + s)) for s in INDEXES))
    inside_stem = F.when(end != "", F.array(*(F.concat(stem, F.lit("/" + s)) for s in INDEXES))).otherwise(none)
    return F.when(whole.isNotNull(), F.concat(mapped, F.array(whole), added, inside, inside_stem))


def candidates(path: Column, spec: Column, aliases: dict[str, str] | None = None) -> Column:
    """Paths that ``spec`` may stand for, best first; null for bare packages and protocols."""
    # bound, as the target would be worked out anew for each candidate
    return bind(F.struct(_target(path, spec, aliases).alias("target"), _ending(spec).alias("ending")), lambda at: _listed(at["target"], at["ending"]))


#: Endings of everything that ``candidates`` may add or put in place of another.
_KNOWN = r"\.(?:ts|tsx|js|jsx|mjs|cjs|mts|cts)$"


def _stem(path: Column) -> Column:
    """``path`` without a known ending, and then without the name of an index file."""
    bare = F.regexp_replace(path, _KNOWN, "")
    return F.when(bare != path, F.regexp_replace(bare, "/index$", "")).otherwise(path)


def _stems(target: Column, ending: Column) -> Column:
    """The distinct stems of all ``candidates`` of a target: one or two, where the candidates are up to sixteen."""
    cut = target.substr(F.lit(1), F.length(target) - F.length(ending))
    both = lambda p: (p, F.regexp_replace(p, "/index$", ""))
    return F.array_distinct(F.when(ending == "", F.array(_stem(target), *both(target))).otherwise(F.array(_stem(target), target, *both(cut))))


def resolve(found: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(path, spec, target) of distinct imports; target is the first candidate that is a file, else null.

    Imports meet files by the stem that they share, one or two rows for each import; the place of the file in the list
    of candidates then tells. An import that stands for no path meets none under a stem of its own, so that no null key grows hot.
    """
    rows = found.select("path", "spec", _target(F.col("path"), F.col("spec"), aliases).alias("aim"), _ending(F.col("spec")).alias("ending"))
    stems = F.when(F.col("aim").isNotNull(), _stems(F.col("aim"), F.col("ending"))).otherwise(F.array(F.concat(F.lit("//"), F.col("path"))))
    tried = rows.select("path", "spec", "aim", "ending", F.explode(stems).alias("stem"))
    named = files.select(F.col("path").alias("target"), _stem(F.col("path")).alias("stem"))
    place = bind(F.array_position(_listed(F.col("aim"), F.col("ending")), F.col("target")), lambda at: F.when(at > 0, F.struct(at.alias("place"), F.col("target"))))
    met = tried.join(named, "stem", "left").select("path", "spec", F.when(F.col("target").isNotNull(), place).alias("hit"))
    return met.groupBy("path", "spec").agg(F.min("hit").alias("hit")).select("path", "spec", F.col("hit.target").alias("target"))


def edges(found: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Distinct (path, target): resolved imports, and for the others every file of that base name; none to itself.

    Only what is not resolved meets names. ``files`` may repeat a path.
    """
    seen = stored(resolve(found, files, aliases))
    left = seen.where("target is null").select("path", base_key(F.col("spec")).alias("key"))
    names = files.select(F.col("path").alias("target"), base_key(F.col("path")).alias("key"))
    by_name = left.join(names, "key").select("path", "target")
    return seen.where("target is not null").select("path", "target").unionByName(by_name).where("path <> target").distinct()


def in_degree(files: DataFrame, links: DataFrame) -> DataFrame:
    """(path, in_degree) of every file."""
    counts = links.groupBy(F.col("target").alias("path")).agg(F.count("*").alias("in_degree"))
    return files.select("path").distinct().join(counts, "path", "left").fillna(0, ["in_degree"])


#: Names of exports up to which they are broadcast.
FEW_NAMES = 100_000


def dead_exports(lines: DataFrame, path: str = "path", line: str = "line", text: str = "text") -> DataFrame:
    """Exports (path, line, name) that no file imports by name and whose own file does not use the name again."""
    bound = imports(lines, path, text).select(F.explode("names").alias("name")).distinct()
    left = stored(exports(lines, path, line, text).join(bound, "name", "left_anti").select("path", "line", "name"))
    words = lines.select(F.col(path).alias("path"), F.explode(F.regexp_extract_all(F.col(text), F.lit(r"([A-Za-z_$][\w$]*)"), F.lit(1))).alias("name"))
    # few names meet the words where these lie; of many, each file's meet its own words
    names = left.select("name").distinct()
    some = words.join(F.broadcast(names), "name", "left_semi") if names.limit(FEW_NAMES + 1).count() <= FEW_NAMES else words.join(left.select("path", "name").distinct(), ["path", "name"], "left_semi")
    again = some.groupBy("path", "name").agg(F.count("*").alias("n")).where("n > 1")
    return left.join(again, ["path", "name"], "left_anti").select("path", "line", "name")
