"""Architectural choices of files on four axes and error paths of functions, voted on a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import vote as V
from plumbline.operators.similarity import bind, holds

# Files that are judged, and files that may hold queries.
NOT_JUDGED = r"(?i)(?:test|spec|mock|fixture|__test__|__mocks__|\.test\.|\.spec\.)|(?:\.config\.|\.d\.ts$|node_modules|dist/|build/)"
REPOSITORY = r"(?i)(?:repository|repo|store|dal|model|query)"
# Fixed values: (axis, pattern, languages or all, expression); of several on one axis the first listed is the file's.
AXES = [
    ("data_access", "repository", None, r"\b(?:store|repo|repository)\.\w+\s*\("),
    ("data_access", "raw_sql", None, r"(?i)(?:SELECT|INSERT|UPDATE|DELETE)\s+(?:FROM|INTO|SET|\*)\b"),
    ("data_access", "orm", None, r"\.(?:Where|Find|Create|Save|Delete|First|Preload|findOne|findMany|findAll|objects\.filter)\s*\(\s*(?!['\"`]/)"),
    ("data_access", "direct_db", None, r"\b(?:db|pool|client)\.\s*(?:Query|Exec|QueryRow|query|execute|raw)\s*\("),
    ("data_access", "http_client", None, r"\b(?:fetch|axios|http\.(?:Get|Post|Put)|requests\.(?:get|post))\s*\("),
    ("error_handling", "wrap_with_context", ("go",), r"fmt\.Errorf\([^)]*%w"),
    ("error_handling", "raw_propagation", ("go",), r"return\s+(?:\w+,\s*)?err\b"),
    ("error_handling", "swallow", ("go",), r"\b_\s*=\s*\w+\.\w+\("),
    ("error_handling", "http_error_response", ("go",), r"echo\.NewHTTPError|http\.Error|c\.JSON\(\s*http\.Status"),
    ("error_handling", "wrap_with_context", ("javascript", "typescript"), r"new\s+(?:\w+)?Error\([^)]*\+|throw\s+new\s+\w*Error\("),
    ("error_handling", "swallow", ("javascript", "typescript"), r"catch\s*\([^)]*\)\s*\{\s*(?://.*\n\s*)?(?:console\.(?:log|warn)|logger\.\w+)[^}]*\}"),
    ("error_handling", "http_error_response", ("javascript", "typescript"), r"res\.status\(\d+\)\.json|\.json\(\s*\{[^}]*error"),
    ("error_handling", "result_type", ("javascript", "typescript"), r"Result<|Either<|\.ok\(|\.err\("),
    ("error_handling", "swallow", ("python",), r"except[^:]*:\s*\n\s*(?:pass|\.\.\.)(?!\w)"),
    ("error_handling", "exception_throw", ("python",), r"raise\s+\w+"),
    ("configuration", "env_direct", None, r"(?:process\.env\.\w+|os\.Getenv\(|os\.environ|import\.meta\.env\.\w+|env::var\()"),
    ("configuration", "config_struct_di", None, r"\b(?:cfg|config|settings)\.\w+"),
    ("dependency_injection", "constructor_injection", ("go",), r"func\s+New\w+\s*\([^)]*\)\s*\*"),
    ("dependency_injection", "constructor_injection", ("javascript", "typescript"), r"constructor\s*\([^)]*(?:private|readonly|public)\s+\w+"),
    ("dependency_injection", "constructor_injection", ("javascript", "typescript"), r"(?:create|make|build)\w+\s*\([^)]*(?:store|repo|service|client)"),
]
# Words of which every match of a pattern holds one, in the order of AXES; the one that heeds no case has none.
WORDS = [
    ("store.", "repo.", "repository."), (), (".Where", ".Find", ".Create", ".Save", ".Delete", ".First", ".Preload", ".find", ".objects.filter"), ("db.", "pool.", "client."), ("fetch", "axios", "http.", "requests."),
    ("fmt.Errorf(",), ("return",), ("_",), ("echo.NewHTTPError", "http.Error", "c.JSON("), ("Error(",), ("catch",), ("res.status(", ".json("), ("Result<", "Either<", ".ok(", ".err("), ("except",), ("raise",),
    ("process.env.", "os.Getenv(", "os.environ", "import.meta.env.", "env::var("), ("cfg.", "config.", "settings."), ("func",), ("constructor",), ("create", "make", "build"),
]
OUTSIDE_REPOSITORIES = ("raw_sql", "direct_db")
# Order in which a single body's ties are broken, and how many places count.
BODY_ORDER = ("raw_sql", "direct_db", "http_client", "orm", "repository")
MOST_PLACES = 3
# Error paths in the order in which ties are broken.
SHAPES = {
    "throws": r"\b(?:throw\s+new\s+\w+|throw\s+\w+|raise\s+\w+|panic\s*\()",
    "result_type": r"\b(?:Result\.(?:fail|ok|err)|Err\s*\(|Ok\s*\(|Either\.(?:left|right)|Result<|Either<)",
    "tuple": r"\breturn\s+[^;{}\n]+,\s*(?:err|error|Err)\b",
    "result_object": r"\breturn\s+\{[^{}]*\b(?:error|err)\b\s*:",
    "null_sentinel": r"\breturn\s+(?:null|undefined|None)\b",
}
STRONG_THROW, ANY_THROW, NEW_THROW = r"\b(?:throw\s+new\s+\w+|raise\s+\w+|panic\s*\()", r"\bthrow\s+\w+", r"\bthrow\s+new\s+\w+"
SHAPE_LANGUAGES = ("javascript", "typescript", "python", "go", "rust")


def _meets(content: Column, pattern: str, languages: tuple[str, ...] | None, name: str, words: tuple[str, ...]) -> Column:
    hit = holds(content, words)
    if languages:
        hit = F.col("language").isin(*languages) & hit
    hit = hit & content.rlike(pattern)
    return hit & ~F.col("path").rlike(REPOSITORY) if name in OUTSIDE_REPOSITORIES else hit


def _choices(content: Column) -> Column:
    """(axis, pattern) of the axes that a file decides, as an array; null where it shows nothing but how it injects."""
    first = {a: F.coalesce(*(F.when(_meets(content, p, langs, name, words), F.lit(name)) for (axis, name, langs, p), words in zip(AXES, WORDS, strict=True) if axis == a)) for a in dict.fromkeys(axis for axis, *_ in AXES)}
    told = lambda a, c: F.struct(F.lit(a).alias("axis"), c.alias("pattern"))
    shown = F.filter(F.array(*(told(a, c) for a, c in first.items() if a != "dependency_injection")), lambda x: x["pattern"].isNotNull())
    injected = F.array(told("dependency_injection", F.coalesce(first["dependency_injection"], F.lit("no_di"))))
    return bind(shown, lambda s: F.when(F.size(s) > 0, F.concat(s, injected)))


def profiles(files: DataFrame) -> DataFrame:
    """path, folder, axis, pattern of ``files`` (path, language, content): one row for each axis on which a file shows a choice.

    Files that show nothing of data access, error handling or configuration have no row; the others that inject nothing have ``no_di``.
    """
    judged = files.where(F.col("language").isNotNull() & F.col("content").isNotNull() & ~F.col("path").rlike(NOT_JUDGED))
    # bound, as the content would be written out anew for each pattern; outer, as a plain explode first asks for the size of what it is given and so works it out again
    each = judged.select("path", F.explode_outer(bind(F.col("content"), _choices)).alias("x")).where("x is not null")
    return each.select("path", _folder("path").alias("folder"), "x.*")


def _folder(path: str) -> Column:
    return F.when(F.col(path).contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def _flags(rows: DataFrame, keys: list[str], least: int, weight: Column | None = None) -> DataFrame:
    """Votes of three files or more with a dominant share of .7: keys, dominant, dominant_count, total, consistency, deviators, severity."""
    # with a share of .7 no two patterns tie, so any number of a file does for their order
    votes = V.vote(rows.withColumn("__order", F.crc32("path")), keys, "pattern", "__order", weight).where("flagged")
    away = F.col("total") - F.col("dominant_count")
    return votes.select(*keys, "dominant", "dominant_count", "total", "consistency", away.alias("deviators"), F.when(away >= least, "error").otherwise("warning").alias("severity"))


def axis_findings(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """Folders with a dominant choice on an axis that some of their files do not share; three such files are an error."""
    return _flags(rows, ["axis", "folder"], 3, weight)


def data_access(content: Column, path: Column) -> Column:
    """The choice of a single body: by places, three at most, and of equally many the more telling; null without one."""
    counts = []
    for axis, name, _, p in AXES:
        if axis == "data_access":
            n = F.least(F.regexp_count(content, F.lit(p)), F.lit(MOST_PLACES))
            n = F.when(path.rlike(REPOSITORY), 0).otherwise(n) if name in OUTSIDE_REPOSITORIES else n
            counts.append(F.struct(n.alias("n"), F.lit(-BODY_ORDER.index(name)).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["name"])


def has_data_access(content: Column, path: Column, name: Column) -> Column:
    """Whether a body still shows a choice at all, however seldom."""
    return F.coalesce(*(F.when(name == n, content.rlike(p) & (~path.rlike(REPOSITORY) if n in OUTSIDE_REPOSITORIES else F.lit(True))) for axis, n, _, p in AXES if axis == "data_access"), F.lit(True))


def _bare(body: Column) -> Column:
    for pattern in (r"(?m)//.*$", r"(?s)/\*.*?\*/", r"(?m)^\s*#.*$"):
        body = F.regexp_replace(body, pattern, "")
    return body


def return_shape(body: Column) -> Column:
    """The error path that a body uses most; null without one. A caught error that is thrown on counts where there is nothing else."""
    return bind(_bare(body), _shape)  # bound, as remarks would be taken out anew for each form


def _shape(text: Column) -> Column:
    count = lambda p: F.regexp_count(text, F.lit(p))
    others = {n: count(p) for n, p in SHAPES.items() if n != "throws"}
    rest = sum(others.values(), F.lit(0))
    throws = count(STRONG_THROW) + F.when(rest > 0, 0).otherwise(count(ANY_THROW) - count(NEW_THROW))
    best = F.array_max(F.array(*(F.struct(n.alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, n) in enumerate(({"throws": throws} | others).items()))))
    return F.when(best["n"] > 0, best["name"])


def has_shape(body: Column, name: Column) -> Column:
    return bind(_bare(body), lambda text: F.coalesce(*(F.when(name == n, text.rlike(p)) for n, p in SHAPES.items()), F.lit(True)))


def shape_findings(functions: DataFrame) -> DataFrame:
    """Folders whose files agree on an error path but for some: folder, dominant, ...; five such files are an error.

    A file's path is that of its first function with one. ``functions`` has path, language, start_line and body.
    """
    rows = functions.where(F.col("language").isin(*SHAPE_LANGUAGES) & ~F.col("path").rlike(NOT_JUDGED)).withColumn("pattern", return_shape(F.col("body"))).where("pattern is not null")
    files = rows.groupBy("path").agg(F.min_by("pattern", "start_line").alias("pattern")).withColumn("folder", _folder("path"))
    return _flags(files, ["folder"], 5)


# Words that join asynchronous work.
AWAIT, THEN = r"\bawait\s+", r"\.\s*then\s*\("


def async_counts(content: Column) -> tuple[Column, Column]:
    """Lines that await and lines that chain, remarks and types left out."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.trim(x))
    code = F.filter(lines, lambda x: ~(x.startswith("//") | x.startswith("*")))
    waits = F.size(F.filter(code, lambda x: x.rlike(AWAIT)))
    thens = F.size(F.filter(code, lambda x: x.rlike(THEN) & ~x.rlike(r"type\s|interface\s")))
    return waits, thens


def async_style(content: Column) -> Column:
    waits, thens = async_counts(content)
    share = waits / (waits + thens)
    return F.when(waits + thens >= 2, F.when(share > 0.7, "async_await").when(share < 0.3, "then_chains").otherwise("mixed"))


def has_async(content: Column, name: Column) -> Column:
    waits, thens = async_counts(content)
    return F.coalesce(F.when(name == "async_await", waits > 0), F.when(name == "then_chains", thens > 0), F.when(name == "mixed", (waits > 0) & (thens > 0)), F.lit(True))
