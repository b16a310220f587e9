"""Source trees as a table of files, what they skip, and the dependencies that manifests declare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.code import glob_regex, language

# Folders that are never read, vendored files, and the largest file and line.
SKIPPED = ["node_modules", ".git", "dist", "build", ".next", ".nuxt", "target", "vendor", "__pycache__", ".venv", "venv", "coverage", ".turbo", ".cache", ".idea", ".vscode"]
VENDORED = r"(?i)\.min\.(js|mjs|cjs|css)$|\.bundle\.(js|mjs|cjs)$"
MAX_BYTES, MAX_LINE = 1 << 20, 2000


def _relative(root: str):
    return F.regexp_replace(F.col("path"), r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")


def _small_file(spark: SparkSession, path: str) -> str | None:
    """The text of one small file, hidden ones too (Spark's readers leave them out); null where there is none."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(sc._jsc.hadoopConfiguration())
    if not system.exists(at):
        return None
    stream = system.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def ignore_rules(spark: SparkSession, root: str, names: tuple[str, ...] = (".gitignore",)) -> list[tuple[str, bool]]:
    """(regular expression over relative paths, keeps) of the ignore files at the root, in order; a later rule wins.

    A rule without a slash holds at any depth, one that ends in a slash for folders; ``!`` takes back.
    """
    rules = []
    for name in names:
        for line in map(str.strip, (_small_file(spark, f"{root.rstrip('/')}/{name}") or "").splitlines()):
            if not line or line.startswith("#"):
                continue
            keeps, line = line.startswith("!"), line.removeprefix("!")
            folder, body = line.endswith("/"), line.strip("/")
            inner = glob_regex(body)[1:-1]
            start = "^" if "/" in line.rstrip("/") else "^(?:.*/)?"
            rules.append((f"{start}{inner}{'/.*' if folder else '(?:/.*)?'}$", keeps))
    return rules


def files(spark: SparkSession, root: str, with_skipped: bool = False) -> DataFrame:
    """path, rel_path, language, content, line_count of the source files below ``root``.

    Names, ignore rules and sizes are filtered before any content is read. With ``with_skipped`` files that are too large,
    vendored or have too long a line are rows too, with a ``skipped`` reason and no content. Empty files are no rows, as
    Spark's readers skip them.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).withColumn("rel_path", _relative(root)).withColumn("language", language(F.col("path")))
    kept = found.where(F.col("language").isNotNull() & ~F.arrays_overlap(F.split("rel_path", "/"), F.array(*map(F.lit, SKIPPED))))
    ignored = F.lit(False)
    for rule, keeps in ignore_rules(spark, root):
        ignored = F.when(F.col("rel_path").rlike(rule), not keeps).otherwise(ignored)
    kept = kept.where(~ignored)
    early = F.when(F.col("length") > MAX_BYTES, "too large").when(F.col("rel_path").rlike(VENDORED), "vendored")
    kept = kept.withColumn("early", early) if with_skipped else kept.where(early.isNull()).withColumn("early", F.lit(None).cast("string"))
    text = kept.select("path", "rel_path", "language", "early", F.when(F.col("early").isNull(), F.decode("content", "UTF-8")).alias("content"))
    lines = F.split("content", "\n", -1)
    text = text.withColumn("skipped", F.coalesce("early", F.when(F.exists(lines, lambda x: F.length(x) > MAX_LINE), "long line"))).drop("early")
    if not with_skipped:
        return text.where("skipped is null").drop("skipped").withColumn("line_count", F.size(lines))
    return text.withColumn("line_count", F.when(F.col("skipped").isNull(), F.size(lines))).withColumn("content", F.when(F.col("skipped").isNull(), F.col("content")))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, name, content of the manifests below ``root``, and of the root's .env.example."""
    names = ["package.json", "go.mod", "Cargo.toml", "requirements.txt"]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(names) + "}").load(root)
    kept = found.withColumn("rel_path", _relative(root)).where(~F.arrays_overlap(F.split("rel_path", "/"), F.array(*map(F.lit, SKIPPED))))
    rows = kept.select("rel_path", F.regexp_extract("rel_path", "([^/]*)$", 1).alias("name"), F.decode("content", "UTF-8").alias("content"))
    env = _small_file(spark, f"{root.rstrip('/')}/.env.example")
    return rows if env is None else rows.unionByName(spark.createDataFrame([(".env.example", ".env.example", env)], rows.schema))


def declared(found: DataFrame) -> DataFrame:
    """(rel_path, ecosystem, kind, dep, version) that ``manifests`` declare; broken JSON declares nothing."""
    kinds = ["dependencies", "devDependencies", "peerDependencies"]
    parsed = F.from_json("content", ", ".join(f"{k} map<string,string>" for k in kinds))
    js = found.where("name = 'package.json'").withColumn("j", parsed)
    out = None
    for kind in kinds:
        part = js.select("rel_path", F.lit("npm").alias("ecosystem"), F.lit(kind).alias("kind"), F.explode(F.col("j")[kind]).alias("dep", "version"))
        out = part if out is None else out.unionByName(part)
    lines = found.where("name <> 'package.json'").select("rel_path", "name", F.posexplode(F.split("content", "\r?\n")).alias("at", "text"))
    lines = lines.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    # the section or block that a line stands in: of a TOML file, or of a go.mod
    opened = F.when(F.col("name") == "Cargo.toml", F.nullif(F.regexp_extract("text", r"^\[([^\]]+)\]", 1), F.lit(""))).when(F.col("text").rlike(r"^\w+ \($"), F.regexp_extract("text", r"^(\w+) \($", 1)).when(F.col("text") == ")", F.lit("-"))
    w = Window.partitionBy("rel_path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.last(opened, ignorenulls=True).over(w))
    get = lambda p, i: F.regexp_extract("text", p, i)
    go = r"^(?:require )?([^\s()/]+\.[^\s()]*) (v\S+)(\s*//\s*indirect)?$"
    in_go = (F.col("name") == "go.mod") & F.col("text").rlike(go) & (F.col("section").eqNullSafe("require") | F.col("text").startswith("require "))
    toml = r"^([A-Za-z0-9_-]+)\s*=\s*(?:\"([^\"]*)\"|\{.*?(?:version\s*=\s*\"([^\"]*)\")?.*\})"
    in_cargo = (F.col("name") == "Cargo.toml") & F.col("section").rlike("dependencies$") & F.col("text").rlike(toml)
    py = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*((?:[=<>!~]=?.*)?)$"
    bare = F.trim(F.regexp_replace("text", r"\s+#.*$|;.*$", ""))
    in_py = (F.col("name") == "requirements.txt") & ~F.col("text").rlike("^(#|-|$)") & bare.rlike(py)
    env = r"^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=(.*)$"
    in_env = (F.col("name") == ".env.example") & F.col("text").rlike(env)
    rows = [
        lines.where(in_go).select("rel_path", F.lit("go").alias("ecosystem"), F.when(get(go, 3) != "", "indirect").otherwise("require").alias("kind"), get(go, 1).alias("dep"), get(go, 2).alias("version")),
        lines.where(in_cargo).select("rel_path", F.lit("cargo").alias("ecosystem"), F.col("section").alias("kind"), get(toml, 1).alias("dep"), F.coalesce(F.nullif(get(toml, 2), F.lit("")), F.regexp_extract("text", r"version\s*=\s*\"([^\"]*)\"", 1)).alias("version")),
        lines.where(in_py).select("rel_path", F.lit("pypi").alias("ecosystem"), F.lit("requires").alias("kind"), F.lower(F.regexp_extract(bare, py, 1)).alias("dep"), F.regexp_extract(bare, py, 2).alias("version")),
        lines.where(in_env).select("rel_path", F.lit("env").alias("ecosystem"), F.lit("variable").alias("kind"), get(env, 1).alias("dep"), F.trim(get(env, 2)).alias("version")),
    ]
    for part in rows:
        out = out.unionByName(part)
    return out
