"""How files write their imports, on eight axes, voted on a folder.

Each axis is decided from rows of lines: where import sections begin and end, which blank lines part them, and what is sorted
inside. All axes end in one long table (path, axis, pattern).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import vote as V
from plumbline.operators.architecture import NOT_JUDGED
from plumbline.operators.graph import stored

# Axes and their patterns.
AXES = {
    "path_style": ("relative", "alias"), "go_grouping": ("grouped", "flat"), "go_ordering": ("ordered", "unordered"), "py_path_style": ("absolute", "relative"),
    "rust_glob": ("glob", "explicit"), "py_wildcard": ("wildcard", "explicit"), "rust_use_path": ("crate", "relative"), "rust_grouping": ("grouped", "flat"),
}
# Lines of imports by language.
JS_IMPORT, JS_FROM, JS_REQUIRE = r"^import\s+(?!type\s)", r"from\s+[\"']([^\"']+)[\"']", r"require\(\s*[\"']([^\"']+)[\"']\s*\)"
GO_OPEN, GO_CLOSE, GO_PATH, GO_SINGLE = r"^\s*import\s*\(", r"^\s*\)", r"\"([^\"]+)\"|`([^`]+)`", r"^\s*import\s+(?:(?:[A-Za-z_]\w*|\.|_)\s+)?[\"`]([^\"`]+)[\"`]"
PY_FROM, PY_RELATIVE, PY_ABSOLUTE, PY_STAR = r"^\s*from\s+\S+\s+import\s+", r"^\s*from\s+\.", r"^\s*from\s+([A-Za-z_][\w.]*)\s+import", r"^\s*from\s+\S+\s+import\s+\*"
RUST_USE, RUST_HEAD, RUST_PUBLIC = r"^(?:pub(?:\s*\([^)]*\))?\s+)?use\s+", r"^(?:pub(?:\s*\([^)]*\))?\s+)?use\s+(?:::)?(\w+)", r"^pub(?:\s*\([^)]*\))?\s+use\s"
RUST_GLOB, RUST_TARGET, RUST_BARE = r"use\s[^;]*(?:::\*|\{[^}]*\*)", r"([A-Za-z_]\w*)::\*", r"(?:^|[^:])\*"
REMARK = r"^\s*(?://|/\*|\*)"


def _lines(files: DataFrame, *languages: str) -> DataFrame:
    """path, row, text, blanks (blank lines up to the row) of judged files of some languages."""
    judged = files.where(F.col("language").isin(*languages) & F.col("content").isNotNull() & ~F.col("path").rlike(NOT_JUDGED))
    # dealt out as files, so that their lines need not be
    rows = judged.select("path", "content").repartition("path").select("path", F.posexplode(F.split("content", "\n")).alias("row", "text"))
    w = Window.partitionBy("path").orderBy("row")
    return rows.withColumn("blanks", F.sum((F.trim(F.regexp_replace("text", r"\s", "")) == "").cast("int")).over(w))


def _told(sums: DataFrame, *axes: tuple[str, str, Column]) -> DataFrame:
    """path, axis, pattern of (condition, axis, pattern), all from one pass over the sums of files."""
    told = (F.when(F.expr(condition), F.struct(F.lit(axis).alias("axis"), pattern.alias("pattern"))) for condition, axis, pattern in axes)
    return sums.select("path", F.explode(F.array_compact(F.array(*told))).alias("x")).select("path", "x.*")


def _majority(a: str, a_name: str, b: str, b_name: str) -> Column:
    """The name of the larger count; a tie goes to the first."""
    return F.when(F.col(a) >= F.col(b), a_name).otherwise(b_name)


def _js(files: DataFrame) -> DataFrame:
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    rows = _lines(files, "javascript", "typescript").where(~F.col("text").rlike(REMARK)).select("path", text.alias("text"))
    code = F.split("text", r"(?<!:)//")[0]
    specs = F.when(F.col("text").rlike(JS_IMPORT), F.slice(F.regexp_extract_all("text", F.lit(JS_FROM), 1), 1, 1)).otherwise(F.regexp_extract_all(code, F.lit(JS_REQUIRE), 1))
    each = rows.select("path", F.explode(specs).alias("spec"))
    near, alias = F.col("spec").rlike(r"^\.\.?/"), F.col("spec").rlike("^[@~]/")
    sums = each.groupBy("path").agg(F.count_if(near).alias("relative"), F.count_if(alias).alias("alias")).where("relative + alias >= 3")
    return sums.select("path", F.lit("path_style").alias("axis"), _majority("relative", "relative", "alias", "alias").alias("pattern"))


def _go_specs(files: DataFrame) -> DataFrame:
    """path, row, spec, blanks of Go imports, in blocks and alone."""
    rows = _lines(files, "go").where(~F.col("text").rlike(REMARK))
    after = F.regexp_replace("text", GO_OPEN, "")
    opens = F.col("text").rlike(GO_OPEN)
    event = F.when(opens, F.when(after.contains(")"), "shut").otherwise("open")).when(F.col("text").rlike(GO_CLOSE), "shut")
    past = Window.partitionBy("path").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.last(event, ignorenulls=True).over(past) == "open", F.lit(False)))
    quoted = lambda t: F.coalesce(F.nullif(F.regexp_extract(t, GO_PATH, 1), F.lit("")), F.nullif(F.regexp_extract(t, GO_PATH, 2), F.lit("")))
    spec = F.when(F.col("inside"), F.when(~F.col("text").rlike(GO_CLOSE), quoted(F.col("text")))).when(opens, quoted(after)).otherwise(F.nullif(F.regexp_extract("text", GO_SINGLE, 1), F.lit("")))
    return rows.select("path", "row", spec.alias("spec"), "blanks").where("spec is not null")


def _go(files: DataFrame) -> DataFrame:
    specs = _go_specs(files)
    w = Window.partitionBy("path").orderBy("row")
    parted = F.coalesce(F.col("blanks") > F.lag("blanks").over(w), F.lit(False))
    rows = specs.withColumn("parted", parted).withColumn("fell", F.coalesce(~parted & (F.col("spec") < F.lag("spec").over(w)), F.lit(False)))
    outside = F.split("spec", "/")[0].contains(".")
    sums = rows.groupBy("path").agg(F.count("*").alias("n"), F.count_if(outside).alias("outside"), F.max("parted").alias("parted"), F.max("fell").alias("fell"))
    return _told(sums, ("outside > 0 and outside < n", "go_grouping", F.when(F.col("parted"), "grouped").otherwise("flat")), ("n >= 3", "go_ordering", F.when(F.col("fell"), "unordered").otherwise("ordered")))


def _python(files: DataFrame) -> DataFrame:
    bare = F.regexp_replace("content", r"(?s)\"\"\".*?(?:\"\"\"|\z)|'''.*?(?:'''|\z)", "")
    rows = _lines(files.withColumn("content", bare), "python").where(F.col("text").rlike(PY_FROM))
    own = F.array_contains(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), F.split(F.regexp_extract("text", PY_ABSOLUTE, 1), r"\.")[0])
    near = F.col("text").rlike(PY_RELATIVE)
    sums = rows.groupBy("path").agg(F.count_if(near).alias("relative"), F.count_if(~near & F.col("text").rlike(PY_ABSOLUTE) & own).alias("absolute"), F.count("*").alias("n"), F.count_if(F.col("text").rlike(PY_STAR)).alias("stars"))
    return _told(sums, ("relative + absolute >= 2", "py_path_style", _majority("relative", "relative", "absolute", "absolute")), ("stars > 0 or n >= 2", "py_wildcard", F.when(F.col("stars") > 0, "wildcard").otherwise("explicit")))


def _uses(files: DataFrame) -> DataFrame:
    """path, row, end_row, text (first line), whole, blanks of top-level uses, followed to their semicolon; remarks are blanked."""
    # a remark over several lines goes but for its line breaks
    shorn = F.regexp_replace(F.regexp_replace("content", r"//[^\n]*", "//"), r"/\*(?:[^*]|\*(?!/))*\*/", "/**/")
    rows = _lines(files.withColumn("content", shorn), "rust").withColumn("text", F.regexp_replace(F.regexp_replace("text", "//$", ""), r"/\*\*/", ""))
    to_end = Window.partitionBy("path").orderBy("row").rowsBetween(0, Window.unboundedFollowing)
    upto = Window.partitionBy("path").orderBy("row")
    rows = rows.withColumn("stop", F.min(F.when(F.col("text").contains(";"), F.col("row"))).over(to_end))
    rows = rows.withColumn("begin", F.last(F.when(F.col("text").rlike(RUST_USE), F.struct("row", "stop")), ignorenulls=True).over(upto)).where(F.col("begin").isNotNull() & (F.col("row") <= F.coalesce(F.col("begin.stop"), F.col("row"))))
    found = rows.groupBy("path", F.col("begin.row").alias("row"), F.col("begin.stop").alias("end_row")).agg(F.array_sort(F.collect_list(F.struct(F.col("row").alias("r"), "text", "blanks"))).alias("l"))
    whole = F.array_join(F.transform("l", lambda x: x["text"]), "\n")
    return found.select("path", "row", "end_row", F.regexp_replace(F.col("l")[0]["text"], r"\s+$", "").alias("text"), whole.alias("whole"), F.col("l")[0]["blanks"].alias("blanks"), F.element_at("l", -1)["blanks"].alias("end_blanks"))


def _rust(files: DataFrame) -> DataFrame:
    rows = _uses(files).withColumn("head", F.regexp_extract("text", RUST_HEAD, 1)).withColumn("glob", F.col("whole").rlike(RUST_GLOB))
    targets = F.regexp_extract_all("whole", F.lit(RUST_TARGET), 1)
    variants = ~F.col("whole").rlike(RUST_BARE) & (F.size(targets) > 0) & F.forall(targets, lambda t: t.rlike("^[A-Z]"))
    idiom = F.col("glob") & (variants | F.col("head").isin("super", "self") | ((F.col("head") != "crate") & F.col("whole").rlike(r"\bprelude\b")))
    w = Window.partitionBy("path").orderBy("row")
    origin = F.when(F.col("head").isin("crate", "super", "self"), "internal").when(F.col("head").isin("std", "core", "alloc"), "std").when(F.col("head") != "", "external")
    rows = rows.withColumn("idiom", idiom).withColumn("parted", F.coalesce(F.col("blanks") > F.lag("end_blanks").over(w), F.lit(False))).withColumn("origin", origin)
    plain = ~F.col("idiom") & ~F.col("text").rlike(RUST_PUBLIC)
    sums = rows.groupBy("path").agg(
        F.count_if(~F.col("idiom")).alias("n"), F.count_if(~F.col("idiom") & F.col("glob")).alias("globs"), F.count_if(plain & (F.col("head") == "crate")).alias("crate"), F.count_if(plain & F.col("head").isin("super", "self")).alias("relative"),
        F.count_distinct("origin").alias("origins"), F.max("parted").alias("parted"),
    )
    return _told(
        sums, ("globs > 0 or n >= 2", "rust_glob", F.when(F.col("globs") > 0, "glob").otherwise("explicit")), ("crate + relative >= 2", "rust_use_path", _majority("crate", "crate", "relative", "relative")),
        ("origins >= 2", "rust_grouping", F.when(F.col("parted"), "grouped").otherwise("flat")),
    )


def classify(files: DataFrame) -> DataFrame:
    """path, axis, pattern of ``files`` (path, language, content): every axis that a file decides. Null contents and test files decide nothing."""
    return _js(files).unionByName(_go(files)).unionByName(_python(files)).unionByName(_rust(files))


def findings(rows: DataFrame) -> DataFrame:
    """axis, folder, dominant, dominant_count, total, consistency, deviators, severity, confidence; folder is null for an axis without a convention.

    An axis with three files or more is judged. Where its patterns are near uniform over all files no convention is there to deviate from;
    else folders of three files with a share of .7 flag the others, three of them as a warning.
    """
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit("."))
    # both the gate and the votes need counts alone; counted once, as files would be taken apart anew for each
    dist = stored(V.distribution(rows.withColumn("folder", folder).withColumn("__order", F.crc32("path")), ["axis", "folder"], "pattern", "__order"))
    gate = V.gated(dist.groupBy("axis", "pattern").agg(F.sum("cnt").alias("count")), "axis").where("total >= 3")
    none = gate.where("no_convention").select("axis", F.lit(None).cast("string").alias("folder"), F.lit(None).cast("string").alias("dominant"), F.lit(None).cast("long").alias("dominant_count"), "total", F.col("score").alias("consistency"), F.lit(None).cast("long").alias("deviators"), F.lit("warning").alias("severity"), "confidence")
    votes = V.decided(dist, ["axis", "folder"]).where("flagged")
    away = F.col("total") - F.col("dominant_count")
    some = votes.join(gate.where("not no_convention").select("axis", "confidence"), "axis").select("axis", "folder", "dominant", "dominant_count", "total", "consistency", away.alias("deviators"), F.when(away >= 3, "warning").otherwise("info").alias("severity"), "confidence")
    return some.unionByName(none)
