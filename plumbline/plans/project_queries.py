"""Dependencies and declared conventions of projects written out from customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import dependencies as D
from plumbline.operators import exports as X
from plumbline.operators import import_style as S
from plumbline.operators import intent as I
from plumbline.plans.registry import query

_GO = ["github.com/acme/sdk/v2/sub", "github.com/lost/lib/x", "example.com/{}/svc/inner/util", "github.com/inner/only", "net/http"]
_JS = ["react", "lodash/fp", "@acme/ui/button", "lost-pkg", "node:fs", "./x", "fs"]
_PY = ["os", "flask", "numpy", "lost"]
_DIRS = ["", "svc/", "svc/inner/", "broken/"]
_DECLARED = [
    ("", "go", "require", "github.com/acme/sdk"), ("", "go", "indirect", "github.com/deep/dep"), ("", "go", "require", "github.com/idle/lib"), ("svc/inner", "go", "require", "github.com/inner/only"),
    *[("", "npm", "dependencies", d) for d in ("react", "lodash", "@acme/ui", "left-pad", "typescript")], *[("", "pypi", "requires", d) for d in ("flask", "numpy", "requests")],
]


def _pick(values, key):
    return F.get(F.array(*map(F.lit, values)), key.cast("int"))


def _tables(t):
    """(files, declared, modules): each nation is a project, each customer a file of it."""
    key, project = F.col("c_custkey"), F.format_string("n%d", "c_nationkey")
    go = F.concat(F.lit('package x\n\nimport (\n\t"fmt"\n\tq "'), F.regexp_replace(_pick(_GO, key % 5), r"\{\}", project), F.lit('"\n)\n\n// import "github.com/not/this"\n'))
    js = F.concat(F.lit('// import gone from "gone";\nimport x from "'), _pick(_JS, key % 7), F.lit('";\nexport const y = require("'), _pick(_JS, key % 7), F.lit('");\n'))
    py = F.concat(F.lit('import sys\nfrom '), _pick(_PY, key % 4), F.lit(" import thing\n"))
    kind = key % 3
    text = F.when(kind == 0, go).when(kind == 1, js).otherwise(py)
    path = F.concat(_pick(_DIRS, F.floor(key / 3) % 4), F.lit("f"), key.cast("string"), F.when(kind == 0, ".go").when(kind == 1, ".ts").otherwise(".py"))
    files = t("customer").select(project.alias("project"), path.alias("path"), F.when(kind == 0, "go").when(kind == 1, "typescript").otherwise("python").alias("language"), text.alias("content"))
    nations = t("customer").select(project.alias("project")).distinct()
    rows = F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("dir", "ecosystem", "kind", "dep"), d))) for d in _DECLARED)))
    home = F.concat(F.lit("example.com/"), F.col("project"))
    modules = F.explode(F.array(*(F.struct(F.lit(d).alias("dir"), m.alias("module"), F.lit(o).alias("opaque")) for d, m, o in (("", home, False), ("svc/inner", F.concat(home, F.lit("/svc/inner")), False), ("broken", F.lit(""), True)))))
    return files, nations.select("project", rows.alias("d")).select("project", "d.*"), nations.select("project", modules.alias("m")).select("project", "m.*")


# The SQL never reads a file: which import stands where follows from the keys, and what it means is written down for each one.
_SQL = """f as (select 'n' || cast(c_nationkey as varchar) as project, c_custkey % 3 as kind, c_custkey % 5 as g, c_custkey % 7 as j, c_custkey % 4 as p, cast(floor(c_custkey / 3) as bigint) % 4 as d from customer),
go as (select project, g, case when d = 2 then 'svc/inner' else '' end as dir from f where kind = 0 and d <> 3),
n as (select distinct project from f),
rows as (
  select distinct project, dir, 'go' as ecosystem, 'missing' as kind, case g when 0 then 'github.com/acme/sdk/v2/sub' when 1 then 'github.com/lost/lib/x' else 'github.com/inner/only' end as dep from go where g = 1 or (g = 0 and dir <> '') or (g = 3 and dir = '')
  union all select project, '', 'go', 'unused', 'github.com/idle/lib' from n where project in (select project from go where dir = '')
  union all select project, '', 'go', 'unused', 'github.com/acme/sdk' from n where project in (select project from go where dir = '') and project not in (select project from go where dir = '' and g = 0)
  union all select project, 'svc/inner', 'go', 'unused', 'github.com/inner/only' from n where project in (select project from go where dir <> '') and project not in (select project from go where dir <> '' and g = 3)
  union all select distinct project, '', 'npm', 'missing', 'lost-pkg' from f where kind = 1 and j = 3
  union all select project, '', 'npm', 'unused', dep from n, (values (0, 'react'), (1, 'lodash'), (2, '@acme/ui'), (-1, 'left-pad')) v(k, dep) where project not in (select project from f where kind = 1 and j = k)
  union all select project, '', 'pypi', 'unused', dep from n, (values (1, 'flask'), (2, 'numpy'), (-1, 'requests')) v(k, dep) where project not in (select project from f where kind = 2 and p = k))"""


@query(f"with {_SQL} select * from rows")
def dependency_check(t):
    """Unused and missing dependencies of every project and module."""
    return D.check(*_tables(t))


@query(f"""with {_SQL}, c as (select project, ecosystem, kind, count(distinct case when ecosystem = 'go' and kind = 'missing' then array_to_string(string_split(dep, '/')[1:3], '/') else dep end) as count from rows group by all)
select project, ecosystem, kind, count, case when kind = 'missing' then 'error' when ecosystem = 'npm' and count > 5 then 'error' else 'warning' end as severity,
  case when kind = 'missing' then case when ecosystem = 'npm' then 0.75 else 0.8 end when ecosystem = 'npm' then 0.75 when ecosystem = 'pypi' then 0.65 else 0.7 end as confidence from c where ecosystem <> 'pypi' or count > 2""")
def dependency_findings(t):
    return D.findings(D.check(*_tables(t)))


_AGENTS = ["- Use the repository pattern for data.", "We format with care; transforms are fine.", "Do not use default exports.", "prefer async/await over callbacks"]
_RULES = ["Always use zustand.", "Throw typed errors, e.g. where db.query fails.", "Use the repository pattern.", "Never require auth here.", "All endpoints require auth."]


def _declarations(t):
    key = F.col("c_custkey")
    agents = F.concat(F.lit("# Project\n\n"), F.when(key % 3 == 0, "## Code conventions\n").otherwise("## Notes\n"), _pick(_AGENTS, key % 4), F.lit("\n"))
    rules = F.concat(F.lit("## Rules\n"), _pick(_RULES, key % 5), F.lit("\n"))
    both = F.explode(F.array(F.struct(F.lit("AGENTS.md").alias("source"), agents.alias("content")), F.struct(F.when(key % 2 == 0, "CLAUDE.md").otherwise("README.md").alias("source"), rules.alias("content"))))
    return t("customer").select(key.alias("project"), both.alias("b")).select("project", "b.*")


_HINTS = """a as (select c_custkey as project, c_custkey % 4 as k, case when c_custkey % 3 = 0 then 0.2 else 0 end as more from customer), r as (select c_custkey as project, c_custkey % 5 as k from customer where c_custkey % 2 = 0),
said as (select project, 'architectural_consistency' as category, 'repository' as pattern, 'AGENTS.md' as source, 4 as line, 0.7 + more as confidence, 1 as rank from a where k = 0
  union all select project, 'async_patterns', 'async_await', 'AGENTS.md', 4, 0.7 + more, 1 from a where k = 3
  union all select project, 'state_management_consistency', 'zustand', 'CLAUDE.md', 2, 0.9, 0 from r where k = 0
  union all select project, 'architectural_consistency', p, 'CLAUDE.md', 2, 0.7, 0 from r, (values ('exception_throw'), ('raw_sql')) v(p) where k = 1
  union all select project, 'architectural_consistency', 'repository', 'CLAUDE.md', 2, 0.9, 0 from r where k = 2
  union all select project, 'security_posture', 'auth_required', 'CLAUDE.md', 2, 0.7, 0 from r where k = 4)"""


@query(f"""with {_HINTS} select project, category, pattern, source, line, round(confidence, 2)::double as confidence from said
qualify row_number() over (partition by project, category, pattern order by round(confidence, 2) desc, rank) = 1""")
def intent_hints(t):
    """What each project declares, once; the SQL states what each written line says."""
    return I.hints(_declarations(t)).select("project", "category", "pattern", "source", "line", "confidence")


@query(f"""with {_HINTS} select project, category, pattern, round(confidence, 2)::double as confidence from said
qualify row_number() over (partition by project, category order by round(confidence, 2) desc, rank, pattern) = 1""")
def intent_seeds(t):
    """The one declared pattern of each project and category that seeds its votes."""
    return I.top(I.hints(_declarations(t))).select("project", "category", "pattern", "confidence")


def _import_files(t):
    """Files of imports, one for each order: Go and Python by turns, in 24 folders."""
    key = F.col("o_orderkey")
    flat, loose, star = key * 7 % 10 >= 8, key * 3 % 11 >= 9, key * 3 % 11 == 0
    own = F.when(loose, '\t"os"\n\t"fmt"\n').otherwise('\t"fmt"\n\t"os"\n')
    go = F.concat(F.lit("package x\n\nimport (\n"), own, F.when(flat, "").otherwise("\n"), F.lit('\tlib "zeta.io/x/y"\n)\n\n// import "a/remark"\nvar s = "no/import"\n'))
    near = F.lit("from .a import b\nfrom ..c import d\n")
    far = F.lit("from imp.a import b\nfrom imp.c import d\n")
    py = F.concat(F.lit('"""\nfrom .doc import gone\n"""\nfrom os import path\n'), F.when(flat, far).otherwise(near), F.when(star, "from .z import *\n").otherwise(""))
    path = F.concat(F.format_string("imp/m%d/f%d", F.col("o_custkey") % 24, key), F.when(key % 2 == 0, ".go").otherwise(".py"))
    return t("orders").select(path.alias("path"), F.when(key % 2 == 0, "go").otherwise("python").alias("language"), F.when(key % 2 == 0, go).otherwise(py).alias("content"))


_STYLES = """k as (select 'imp/m' || cast(o_custkey % 24 as varchar) as folder, 'imp/m' || cast(o_custkey % 24 as varchar) || '/f' || cast(o_orderkey as varchar) || case when o_orderkey % 2 = 0 then '.go' else '.py' end as path, o_orderkey % 2 = 0 as go, o_orderkey * 7 % 10 >= 8 as flat, o_orderkey * 3 % 11 >= 9 as loose, o_orderkey * 3 % 11 = 0 as star from orders),
styles as (select folder, path, 'go_grouping' as axis, case when flat then 'flat' else 'grouped' end as pattern from k where go union all select folder, path, 'go_ordering', case when loose then 'unordered' else 'ordered' end from k where go
  union all select folder, path, 'py_path_style', case when flat and not star then 'absolute' when flat then 'absolute' else 'relative' end from k where not go union all select folder, path, 'py_wildcard', case when star then 'wildcard' else 'explicit' end from k where not go)"""


@query(f"with {_STYLES} select path, axis, pattern from styles")
def import_styles(t):
    """Every axis that a file of imports decides; the SQL knows how each was written."""
    return S.classify(_import_files(t))


@query(f"""with {_STYLES}, n as (select axis, folder, pattern, count(*) as c from styles group by all), g as (select axis, folder, sum(c)::bigint as total, max(c) as dominant_count, arg_max(pattern, c) as dominant from n group by 1, 2)
select axis, folder, dominant, dominant_count, total, cast(floor(dominant_count / total * 100 + 0.5) as bigint) as consistency, total - dominant_count as deviators, case when total - dominant_count >= 3 then 'warning' else 'info' end as severity
from g where total >= 3 and dominant_count / total >= 0.7 and dominant_count < total""")
def import_style_votes(t):
    """Folders that agree on an axis but for some of their files; every axis has a convention over all files here."""
    return S.findings(S.classify(_import_files(t))).drop("confidence")


def _crud_files(t):
    """A file for each order that exports two names and imports one of a later order of its folder over several lines; some are routed in a Go file."""
    key, later = F.col("o_orderkey"), F.col("o_orderkey") + 24 * (F.col("o_custkey") % 3 + 1)
    text = F.format_string('// export function gone() {}\nimport {\n  save%d,\n  type Row,\n} from "./s%d";\n\nexport async function save%d(a) {\n  return a;\n}\nfunction render%d() {}\nexport {\n  render%d as shown,\n};\n', later, later, key, key, key)
    own = F.struct(F.format_string("crud/m%d/s%d.ts", key % 24, key).alias("path"), F.lit("typescript").alias("language"), text.alias("content"))
    routes = F.struct(F.format_string("crud/r%d.go", key).alias("path"), F.lit("go").alias("language"), F.format_string('r.POST("/x", auth, h.save%d)\n', key).alias("content"))
    return t("orders").select(F.explode(F.when(F.col("o_custkey") % 5 == 0, F.array(own, routes)).otherwise(F.array(own))).alias("f")).select("f.*")


_WIRED = "o as (select o_orderkey as k, o_custkey as c from orders), left_over as (select 'crud/m' || cast(k % 24 as varchar) as folder, k from o where c % 5 <> 0 and k not in (select k + 24 * (c % 3 + 1) from o))"


@query(f"with {_WIRED} select folder || '/s' || cast(k as varchar) || '.ts' as path, 7 as line, 'save' || cast(k as varchar) as name from left_over")
def unwired_exports(t):
    """Names of create, read, update or delete that no file imports and no route is handed."""
    return X.unwired(_crud_files(t)).select("path", "line", "name")


@query(f"""with {_WIRED}, n as (select 'crud/m' || cast(k % 24 as varchar) as folder, count(*) as total from o group by 1), u as (select folder, count(*) as unwired from left_over group by 1)
select folder, unwired, total, cast(floor((1 - unwired / total) * 100 + 0.5) as int) as consistency, case when unwired / total >= 0.5 then 'error' when unwired / total >= 0.2 then 'warning' else 'info' end as severity from u join n using (folder)""")
def unwired_export_findings(t):
    return X.unwired_findings(_crud_files(t))
