"""Conventions that a team declares in prose, as hints that seed votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Files that are read, those before win where two say the same with the same confidence.
SOURCES = ("CLAUDE.md", "AGENTS.md", "AGENT.md", ".cursorrules", ".claude/instructions.md")
# Fixed values: (category, pattern, label, phrases).
PHRASES = [
    ("architectural_consistency", "repository", "repository pattern", ("repository pattern", "repository-pattern", "use repositories", "repository classes", "repo pattern")),
    ("architectural_consistency", "raw_sql", "raw SQL queries", ("raw sql", "raw queries", "direct sql", "db.query")),
    ("architectural_consistency", "orm", "ORM methods", ("orm", "prisma", "typeorm", "sequelize")),
    ("architectural_consistency", "exception_throw", "typed errors (throw)", ("throw typed", "throw errors", "typed exceptions", "typed errors", "throw an error")),
    ("architectural_consistency", "result_type", "Result<T> returns", ("result<", "result type", "result-type")),
    ("architectural_consistency", "http_error_response", "HTTP error response objects", ("error response object", "{ error }", "error json")),
    ("naming_conventions", "camelCase", "camelCase", ("camelcase",)),
    ("naming_conventions", "PascalCase", "PascalCase", ("pascalcase",)),
    ("naming_conventions", "snake_case", "snake_case", ("snake_case", "snake-case")),
    ("naming_conventions", "kebab-case", "kebab-case", ("kebab-case", "kebab case")),
    ("naming_conventions", "SCREAMING_SNAKE", "SCREAMING_SNAKE", ("screaming snake", "screaming_snake")),
    ("async_patterns", "async_await", "async/await", ("async/await", "async await", "use async await")),
    ("async_patterns", "then_chain", ".then() chains", (".then chain", "promise chain", ".then()")),
    ("async_patterns", "callback", "callbacks", ("callback style", "use callbacks")),
    ("export_style", "named", "named exports", ("named exports", "named export only", "no default exports", "avoid default exports")),
    ("export_style", "default", "default exports", ("default exports", "default export", "use default exports")),
    ("import_style", "alias", "path alias", ("path alias", "alias imports", "@/ imports", "use aliases")),
    ("import_style", "relative", "relative paths", ("relative imports", "relative paths", "use relative")),
    ("return_shape_consistency", "throws", "throw on error", ("throw on error", "throw instead of return", "throws on error")),
    ("return_shape_consistency", "result_type", "Result<T>/Either", ("result<", "result type", "either<", "either type", "result/either")),
    ("return_shape_consistency", "tuple", "tuple (value, error)", ("tuple return", "(value, error)", "value, err")),
    ("return_shape_consistency", "result_object", "{ error } return object", ("{ error }", "error return shape", "error object return", "error-object return")),
    ("return_shape_consistency", "null_sentinel", "null/undefined sentinel", ("null sentinel", "undefined sentinel", "return null on error")),
    ("logging_consistency", "structured", "structured logger", ("structured logger", "structured logging", "winston", "pino", "bunyan", "log4js", "use a structured logger")),
    ("logging_consistency", "console", "console.*", ("console.log", "console logging", "use console")),
    ("logging_consistency", "debug_pkg", "debug() package", ("debug package", "use debug()")),
    ("logging_consistency", "python_logging", "Python logging module", ("python logging", "logging.getLogger")),
    ("logging_consistency", "go_slog", "Go slog", ("slog", "log/slog", "go slog")),
    ("state_management_consistency", "redux", "Redux", ("redux", "use redux", "redux toolkit", "rtk")),
    ("state_management_consistency", "zustand", "Zustand", ("zustand", "use zustand")),
    ("state_management_consistency", "mobx", "MobX", ("mobx", "use mobx")),
    ("state_management_consistency", "jotai", "Jotai", ("jotai", "use jotai")),
    ("state_management_consistency", "recoil", "Recoil", ("recoil", "use recoil")),
    ("state_management_consistency", "context", "React Context", ("react context", "context api", "use context")),
    ("state_management_consistency", "local_state", "local component state", ("local state", "usestate", "component state")),
    ("test_structure_consistency", "bdd_nested", "describe/it (BDD)", ("describe/it", "describe / it", "bdd style tests", "nested describe")),
    ("test_structure_consistency", "flat_test", "flat test()", ("flat test", "test() function", "use test()")),
    ("test_structure_consistency", "framework_mocks", "framework mocks", ("jest.fn", "vi.fn", "vitest mocks", "jest mocks")),
    ("test_structure_consistency", "sinon", "sinon mocks", ("sinon", "use sinon")),
    ("test_structure_consistency", "manual", "manual stubs", ("manual stubs", "manual mocks")),
    ("security_posture", "auth_required", "auth required on all routes", ("require auth", "require authentication", "all endpoints require auth", "all routes require auth", "all routes authenticated", "authenticated endpoints", "auth on all routes", "every endpoint requires authentication", "require login", "all endpoints must be authenticated")),
]
# Headings that promise conventions, lines that command, words before a phrase that turn it round.
CONVENTIONS = r"\b(conventions?|patterns?|architecture|style|standards?|rules?|guidelines?)\b"
COMMANDS = r"(?i)^(?:-\s+)?(?:use|always|prefer|require|enforce|must)\b"
NEGATED = r"(don'?t|do not|avoid|never|no\s|dont|instead of)\s*$|(don'?t|do not|avoid|never|dont)\s+\w*\s*$"
BASE, HEADED, COMMANDED, MOST = 0.5, 0.2, 0.2, 0.95


def _says(line: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a lower-case line holds one of the phrases (single words as whole words) without a negation right before it."""
    out = F.lit(False)
    for phrase in map(str.lower, phrases):
        word = phrase.replace("_", "").isalnum()
        hit = line.rlike(rf"\b{phrase}\b") if word else line.contains(phrase)
        out = out | (hit & ~F.substring(line, F.lit(1), F.locate(phrase, line) - 1).rlike(NEGATED))
    return out


def hints(files: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """project, category, pattern, label, source, line, text, confidence of ``files`` (project, source, content).

    A phrase in prose counts .5, under a heading of conventions .2 more, in a line that commands .2 more, .95 at most. What is
    declared several times counts where its confidence is highest, then by the order of ``sources``, then by line. Other files and null contents say nothing.
    """
    rows = files.where(F.col("source").isin(*sources) & F.col("content").isNotNull()).select("project", "source", F.posexplode(F.split("content", "\n")).alias("at", "raw"))
    rows = rows.withColumn("text", F.regexp_replace("raw", r"^\s+|\s+$", "")).where("text <> ''")
    title = F.regexp_extract("text", r"^#{1,6}\s+(.+?)\s*$", 1)
    w = Window.partitionBy("project", "source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("heading", F.last(F.nullif(title, F.lit("")), ignorenulls=True).over(w)).where(title == "")
    low = F.lower("text")
    said = F.array_compact(F.array(*(F.when(_says(low, phrases), F.struct(F.lit(c).alias("category"), F.lit(p).alias("pattern"), F.lit(label).alias("label"))) for c, p, label, phrases in PHRASES)))
    sure = F.lit(BASE) + F.when(F.lower(F.coalesce("heading", F.lit(""))).rlike(CONVENTIONS), HEADED).otherwise(0.0)
    sure = F.when(F.col("text").rlike(COMMANDS), F.least(F.lit(MOST), sure + COMMANDED)).otherwise(sure)
    each = rows.select("project", "source", (F.col("at") + 1).alias("line"), F.substring("text", 1, 200).alias("text"), F.round(sure, 2).alias("confidence"), F.explode(said).alias("h")).select("project", "h.*", "source", "line", "text", "confidence")
    rank = F.coalesce(*(F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(sources)))
    best = F.min_by(F.struct("label", "source", "line", "text", "confidence"), F.struct(-F.col("confidence"), rank, "line"))
    return each.groupBy("project", "category", "pattern").agg(best.alias("b")).select("project", "category", "pattern", "b.*")


def top(found: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """The one hint of each project and category that seeds its votes: the highest confidence, ties by source, line and pattern."""
    rank = F.coalesce(*(F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(sources)), F.lit(len(sources)))
    best = F.min_by(F.struct("pattern", "label", "source", "line", "confidence"), F.struct(-F.col("confidence"), rank, "line", "pattern"))
    return found.groupBy("project", "category").agg(best.alias("b")).select("project", "category", "b.*")


def seeded(votes: DataFrame, found: DataFrame, boost: float = 1.5) -> DataFrame:
    """project, category, grp, dominant, raw_dominant, total, declared, matches of counted patterns (project, category, grp, pattern, cnt, weight) with their declared one.

    A declared pattern counts ``boost`` times, or 1 + its confidence where no file has it; ``matches`` says whether the files by themselves prefer it, null where
    nothing is declared. Ties go to the smaller pattern.
    """
    asked = top(found).select("project", "category", F.col("pattern").alias("declared"), "confidence")
    rows = votes.join(asked, ["project", "category"], "left")
    own = rows.select("project", "category", "grp", "pattern", "cnt", F.when(F.col("pattern") == F.col("declared"), F.col("weight") * boost).otherwise(F.col("weight")).alias("boosted"), "declared")
    groups = rows.groupBy("project", "category", "grp", "declared", "confidence").agg(F.max(F.col("pattern") == F.col("declared")).alias("seen")).where("not seen")
    unseen = groups.select("project", "category", "grp", F.col("declared").alias("pattern"), F.lit(0).cast("long").alias("cnt"), (F.lit(1.0) + F.col("confidence")).alias("boosted"), "declared")
    pick = lambda c: F.min_by("pattern", F.struct(-F.col(c), "pattern"))
    out = own.unionByName(unseen).groupBy("project", "category", "grp").agg(pick("boosted").alias("dominant"), pick("cnt").alias("raw_dominant"), F.sum("cnt").alias("total"), F.first("declared").alias("declared"))
    return out.withColumn("matches", F.col("raw_dominant") == F.col("declared"))
