"""Workflows of functions as sequences of operations, and functions whose workflows are nearly the same."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.code import non_shippable

# Operations and their patterns, the first that fits a line names it.
OPERATIONS = [
    ("INPUT", r"(?i)(?:req\.params|req\.query|req\.body|c\.Param|c\.QueryParam|c\.Bind|c\.FormValue|request\.args|request\.form|request\.json|request\.GET|request\.POST|r\.URL\.Query|web::Path|web::Query|web::Json)"),
    ("AUTH", r"(?i)(?:requireAuth|isAuthenticated|\.verify(?:Token|Jwt|JWT)?\(|jwt\.verify\(|session\.(?:user|get)\b|req\.user\b|currentUser\(|getCurrentUser\(|middleware.*auth|authMiddleware|use\(.*auth|@(?:login_required|permission_classes)|AuthGuard|hasPermission\()"),
    ("VALIDATE", r"(?i)(?:validate|schema\.parse|\.validate\(|zod\.|joi\.|assert|ensure|check.*(?:nil|null|empty|valid)|guard|sanitize)"),
    ("RETURN_ERR", r"(?i)(?:return\s+(?:nil|null|None),?\s*(?:err|fmt\.Errorf|errors\.)|throw\s+new|raise\s+|return\s+(?:err|error)|res\.status\(\d{3,}\)|c\.JSON\(\d{3,}|http\.Error)"),
    ("RETURN_OK", r"(?i)(?:return\s+c\.JSON\(2|return\s+res\.(?:json|send|status\(2)|return\s+(?:Ok|Some|jsonify)|c\.JSON\(http\.Status(?:OK|Created))"),
    ("CACHE_READ", r"(?i)(?:redis\.get\(|cache\.get\(|memcache\.get\(|lru\.get\(|localStorage\.getItem\(|sessionStorage\.getItem\(|\.hget\(|memo\.get\(|cacheClient\.get\()"),
    ("CACHE_WRITE", r"(?i)(?:redis\.set\(|cache\.set\(|memcache\.set\(|lru\.put\(|localStorage\.setItem\(|sessionStorage\.setItem\(|\.hset\(|memo\.set\(|cacheClient\.set\()"),
    ("QUERY", r"(?i)(?:SELECT\s|\.find\(|\.findOne\(|\.findAll\(|\.get\(|repo\.(?:Get|Find|List|Load)|db\.Query(?:Row)?\(|\.query\(|cursor\.execute.*SELECT|\.Where\(.*\.First\(|\.Where\(.*\.Find\()"),
    ("MUTATE", r"(?i)(?:INSERT\s|UPDATE\s|DELETE\s|\.save\(|\.create\(|\.insert\(|repo\.(?:Create|Save|Store|Insert)|db\.Exec\(|cursor\.execute.*(?:INSERT|UPDATE|DELETE)|\.Remove\(|\.Delete\(|\.destroy\()"),
    ("METRICS", r"(?i)(?:prometheus\.|statsd\.|metrics\.(?:inc|record|observe|set|gauge|counter|timer|histogram)|\.(?:Inc|Dec|Observe|Record)\b.*(?:counter|gauge|histogram|timer)|\bhistogram\.\w+\(|\bgauge\.\w+\(|\bcounter\.\w+\(|NewHistogram\(|NewCounter\(|NewGauge\()"),
    ("EMIT", r"(?i)(?:emitter\.emit\(|eventBus\.(?:emit|publish|send)\(|bus\.publish\(|socket\.emit\(|io\.emit\(|broker\.publish\(|publisher\.publish\(|pubsub\.publish\(|kafkaProducer\.send\()"),
    ("API_CALL", r"(?i)(?:fetch\(|axios\.|http\.(?:Get|Post|Put|Delete)\(|\.request\(|requests\.(?:get|post|put|delete)|grpc\.|client\.\w+\()"),
    ("RETRY", r"(?i)(?:\bretry\s*\(|\.retry\s*\(|\bbackoff\s*\(|pRetry\(|retryAsync\(|withRetry\(|exponentialBackoff|\bretries\s*:)"),
    ("LOCK", r"(?i)(?:mutex\.Lock\(|sync\.Mutex|sync\.RWMutex|\.Lock\(\)|\.RLock\(\)|\.acquire\(\)|Semaphore\(|withLock\(|\bsemaphore\.|\basync_lock\b|Mutex::lock)"),
    ("RESOURCE", r"(?i)(?:defer\s|\.Close\(|\.close\(|fs\.open|os\.Open|with\s+open|try.*finally|\.release\(|\.dispose\(|\.end\()"),
    ("LOG", r"(?i)(?:console\.(?:log|warn|error|info|debug)|log\.(?:Info|Warn|Error|Debug|Printf|Println)|logger\.|logging\.|slog\.)"),
    ("SERIALIZE", r"(?i)(?:JSON\.stringify\(|\.toJSON\(|\.serialize\(|json\.Marshal\(|proto\.Marshal\(|msgpack\.encode\()"),
    ("DESERIALIZE", r"(?i)(?:JSON\.parse\(|\.fromJSON\(|\.parse\(.*['\"]\{|json\.Unmarshal\(|proto\.Unmarshal\(|msgpack\.decode\()"),
    ("AGGREGATE", r"(?i)(?:\.reduce\(|\.reduceRight\(|groupBy\(|\.aggregate\(|partitionBy\(|collect::<[A-Za-z]|\.fold\()"),
    ("LOOP", r"(?i)(?:^for\s|^for\(|\.forEach\(|\.map\(|\.filter\(|while\s|while\(|\.each\(|range\s)"),
    ("BRANCH", r"(?i)(?:^if\s|^if\(|^else\s|^else\{|switch\s|switch\(|case\s|match\s|\?\s)"),
    ("TRANSFORM", r"(?i)(?:\.sort\(|\.slice\(|\.splice\(|strings\.|strconv\.|fmt\.Sprintf|\.trim\(|\.split\(|\.join\()"),
]
# Operations that tell nothing by themselves; what makes a shared run telling; the share that must be shared; domains that are not compared.
FILLER = ("TRANSFORM", "BRANCH", "LOOP")
DISTINCT_OPS, LONG_RUN, LEAST_OPS, SHARE = 2, 6, 3, 0.8
NO_DOMAIN = ("general", "request_handling")


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def _named(text: Column) -> Column:
    return F.when(~text.isin("", "{", "}", ")"), F.coalesce(*(F.when(text.rlike(p), F.lit(name)) for name, p in OPERATIONS)))


def operation(line: Column) -> Column:
    """The operation of one line; null for lines without one."""
    return _named(_trimmed(line))


_BLANKS = " \t\n\x0b\f\r"
# as Spark reads them: letters, digits and blanks are those of ASCII, words end as in any script, a dot takes no line separator
_COMPILED = [(name, re.compile("(?ai:" + p.removeprefix("(?i)").replace(".*", "[^\\n\\r\\u0085\\u2028\\u2029]*").replace(r"\b", r"(?u:\b)") + ")")) for name, p in OPERATIONS]
# No pattern tells numbers of the same first digit and of three digits or more apart.
_NUMBER = re.compile(r"([0-9])([0-9]{1,2})[0-9]*")


@lru_cache(65536)
def _operation(line: str) -> str | None:
    return next((name for name, p in _COMPILED if p.search(line)), None)


def sequence_of(body: str) -> list[str]:
    """Operations of a body in order; runs of one operation are one. Lines that are alike but for their numbers are looked at once, and so are short bodies."""
    alike = _NUMBER.sub(lambda m: m[1] + "0" * len(m[2]), body)
    return list((_alike_sequence if len(alike) <= ALIKE_CHARS else _sequence)(alike))


def _sequence(alike: str) -> tuple[str, ...]:
    out: list[str] = []
    for line in alike.split("\n"):
        text = line.strip(_BLANKS)
        if text not in ("", "{", "}", ")"):
            found = _operation(text)
            if found and (not out or out[-1] != found):
                out.append(found)
    return tuple(out)


#: Characters of a body that is kept with its operations.
ALIKE_CHARS = 2000
_alike_sequence = lru_cache(8192)(_sequence)


@F.pandas_udf(T.ArrayType(T.StringType()))
def sequence(body: pd.Series) -> pd.Series:
    """``sequence_of`` of each body; null has none."""
    return body.map(lambda b: None if b is None else sequence_of(b))


def _shared_run(a: list[str], b: list[str]) -> list[str]:
    """A longest common subsequence; walking back, the first sequence is left before the second where both ways are as long."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif table[i - 1][j] >= table[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


@F.pandas_udf(T.ArrayType(T.StringType()))
def shared_run(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_shared_run(list(x), list(y)) for x, y in zip(a, b, strict=True)])


def telling(run: Column) -> Column:
    """Whether a shared run says something: two operations that are no filler, or six of any kind."""
    return (F.size(F.filter(run, lambda x: ~x.isin(*FILLER))) >= DISTINCT_OPS) | (F.size(run) >= LONG_RUN)


def classes(functions: DataFrame) -> DataFrame:
    """domain, sequence, id, functions, files, shipped: functions (path, domain, body, or their sequence in its place) with the same sequence of three operations or more."""
    rows = functions.where(~F.col("domain").isin(*NO_DOMAIN)).select("path", "domain", F.col("sequence") if "sequence" in functions.columns else sequence(F.col("body")).alias("sequence"))
    # counted by file first: distinct files need no second copy of the rows, and no second look at their bodies
    files = rows.groupBy("domain", "sequence", "path").agg(F.count("*").alias("n"))
    out = files.groupBy("domain", "sequence").agg(F.sum("n").alias("functions"), F.count("*").alias("files"), F.min("path").alias("first_path"), F.max("path").alias("last_path"), F.sum(F.when(non_shippable(F.col("path")), 0).otherwise(F.col("n"))).alias("shipped"))
    return out.where(F.size("sequence") >= LEAST_OPS).withColumn("id", F.xxhash64("domain", "sequence"))


def _keys(rows: DataFrame) -> DataFrame:
    """Prefix keys of each sequence: its rarest (operation, how manieth) pairs, as many as a partner must share one of."""
    numbered = F.transform("sequence", lambda x, i: F.concat_ws("#", x, F.size(F.filter(F.slice(F.col("sequence"), F.lit(1), i + 1), lambda y: y == x))))
    tokens = rows.select("domain", "id", "sequence", F.explode(numbered).alias("token"))
    df = tokens.groupBy("domain", "token").agg(F.count("*").alias("df"))
    ordered = tokens.join(df, ["domain", "token"]).groupBy("domain", "id", "sequence").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda t: t["token"]).alias("tokens"))
    n = F.size("sequence")
    prefix = n - F.ceil(n * F.lit(8) / 10).cast("int") + 1
    return ordered.select("domain", "id", "sequence", F.explode(F.slice("tokens", F.lit(1), prefix)).alias("token"))


def similar(found: DataFrame) -> DataFrame:
    """domain, a, b, similarity, run: pairs of classes (``classes``) that share .8 of the longer sequence by a telling run, each class with itself where it spans two files.

    Functions of one sequence are one row, so copies make no pairs of their own. Candidates share one of their rarest
    operations: two sequences of which .8 is common must, so no pair is lost. Pairs of functions in one file or outside what is shipped
    count for nothing: a pair of classes stands for two files at least, one of them shipped.
    """
    keyed = _keys(found)
    size = F.size("sequence")
    left = keyed.select("domain", "token", F.col("id").alias("a"), F.col("sequence").alias("sa"))
    right = keyed.select("domain", "token", F.col("id").alias("b"), F.col("sequence").alias("sb"))
    near = (5 * F.least(F.size("sa"), F.size("sb")) >= 4 * F.greatest(F.size("sa"), F.size("sb"))) & (F.col("a") < F.col("b"))
    pairs = left.join(right, ["domain", "token"]).where(near).select("domain", "a", "b", "sa", "sb").distinct()
    pairs = pairs.withColumn("run", shared_run("sa", "sb")).withColumn("longest", F.greatest(F.size("sa"), F.size("sb")))
    pairs = pairs.where(10 * F.size("run") >= 8 * F.col("longest"))
    own = found.select("domain", F.col("id").alias("a"), F.col("id").alias("b"), F.col("sequence").alias("run"), size.alias("longest")).where("files >= 2" if "files" in found.columns else "true")
    every = pairs.select("domain", "a", "b", "run", "longest").unionByName(own).where(telling(F.col("run")))
    ends = lambda side: found.select(F.col("id").alias(side), F.col("first_path").alias(f"{side}_first"), F.col("last_path").alias(f"{side}_last"), F.col("shipped").alias(f"{side}_shipped"))
    met = every.join(ends("a"), "a").join(ends("b"), "b").where((F.col("a_shipped") + F.col("b_shipped") > 0) & ((F.col("a_first") != F.col("b_last")) | (F.col("a_last") != F.col("b_first"))))
    return met.select("domain", "a", "b", F.round(F.size("run") / F.col("longest"), 6).alias("similarity"), "run")
