"""Import graph and experiment queries over stand-ins for files and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import experiments as X
from plumbline.operators import imports as I
from plumbline.operators.graph import stored
from plumbline.plans import standin
from plumbline.plans.registry import query

# Line k of file o imports file o + 24 * k of its own folder, and the fifth one a file of the next folder.
_TO = "l_orderkey + case l_linenumber when 5 then 1 else 24 * l_linenumber end"
_NAME = "replace(" + standin._case(f"({_TO}) * 7 + 3", standin.NAMES) + f", '@', cast({_TO} as string))"
_HOME = f"case l_linenumber when 5 then '../m' || cast(({_TO}) % 24 as string) else '.' end"
_BARE = r"regexp_replace(" + _NAME + r", '(/index)?[.](test[.])?[a-z]+$', '')"
_SPEC = f"case l_linenumber when 6 then 'react' when 4 then './gone/' || {_BARE} else {_HOME} || '/' || {_BARE} || case l_linenumber when 3 then '.js' else '' end end"
_IMPORTS = f"imports as (select {standin.PATH} as path, {_SPEC} as spec from lineitem)"
# Each folder holds files of both kinds below it too, so an importer's folder is that of its path.
_FILES = f"files as (select distinct {standin.PATH} as path from lineitem)"
_LIST = lambda items, stem: ", ".join(f"{stem} || '{x}'" for x in items)
_RESOLVED = f"""{_IMPORTS}, {_FILES}, d as (select distinct path, spec, regexp_replace(path, '[^/]*$', '') f from imports),
s as (select *, case when spec like './%' then f || spec[3:] when spec like '../%' then regexp_replace(f, '[^/]+/$', '') || spec[4:] end target from d),
l as (select path, spec, case when target like '%.js' then [{_LIST(I.MAPPED['.js'], 'target[:-4]')}] else [] end || [target] || case when regexp_matches(target, '[.][a-z]+$') then [] else [{_LIST(I.ENDINGS, 'target')}] end
 || [{_LIST(I.INDEXES, "target || '/'")}] || case when regexp_matches(target, '[.][a-z]+$') then [{_LIST(I.INDEXES, "regexp_replace(target, '[.][a-z]+$', '') || '/'")}] else [] end as tried from s where target is not null),
c as (select path, spec, unnest(tried) cand, generate_subscripts(tried, 1) pos from l),
h as (select c.path, spec, arg_min(cand, pos) target from c join files g on g.path = c.cand group by all), resolved as (select path, spec, h.target from d left join h using (path, spec))"""
_KEY = lambda c: f"case when regexp_matches({c}, '[^/]/index[.](ts|tsx|js|jsx|mjs|cjs)$') then regexp_extract({c}, '([^/]+)/index[.][a-z]+$', 1) else regexp_extract(regexp_replace({c}, '[.](ts|tsx|js|jsx|mjs|cjs)$', ''), '([^/]*)$', 1) end"
_EDGES = f"""{_RESOLVED}, edges as (select path, target from resolved where target is not null union select r.path, f.path from resolved r join files f on {_KEY('f.path')} = {_KEY('r.spec')} where r.target is null), e as (select distinct * from edges where path <> target)"""


def _imports(t):
    return t("lineitem").select(F.expr(standin.PATH).alias("path"), F.expr(_SPEC).alias("spec"))


def _files(t):
    return stored(t("lineitem").select(F.expr(standin.PATH).alias("path")).distinct())  # several steps read it


@query(f"with {_RESOLVED} select * from resolved")
def import_resolution(t):
    """Which file each specifier stands for: endings, index files, parent folders; null for packages and missing files."""
    return I.resolve(_imports(t), _files(t))


@query(f"with {_EDGES} select files.path, count(e.path) as in_degree from files left join e on e.target = files.path group by 1")
def import_in_degree(t):
    files = _files(t)
    return I.in_degree(files, I.edges(_imports(t), files))


_ROOT = r"(^|/)(index|main|app|server)\.[A-Za-z0-9]+$"


@query(f"with {_EDGES} select files.path from files anti join e on e.target = files.path where not regexp_matches(files.path, '{_ROOT}')")
def dead_files(t):
    """Files that nothing imports and that are no entry."""
    files = _files(t)
    return files.where(~F.col("path").rlike(_ROOT)).join(I.edges(_imports(t), files).select(F.col("target").alias("path")), "path", "left_anti")


@query(f"""with {standin.LINES}, x as (select path, line, regexp_extract(text, 'export (?:default )?(?:function|const) ([A-Za-z]+)', 1) as name from lines), w as (select path, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*')) as name from lines)
select path, line, name from x where name <> '' and name not in (select regexp_extract(text, '^(?:import|const) ([a-z]+) (?:from|= require)', 1) from lines) and (select count(*) from w where w.path = x.path and w.name = x.name) <= 1""")
def dead_export_names(t):
    return I.dead_exports(standin.lines(t))


RUNS = "runs as (select l_suppkey % 40 task, case l_partkey % 3 when 0 then 'T' when 1 then 'P' else 'C' end arm, l_extendedprice * case l_partkey % 3 when 0 then 0.6 else 1 end cost, l_quantity > case l_partkey % 3 when 0 then 15 else 20 end passed from lineitem)"
ROUNDS = 400
_AGG = "sum(cost) / nullif(sum(passes), 0) ecpp, sum(passes) / sum(runs) rate"
_BOOT = f"""with {RUNS}, s as (select task, arm, sum(cost) cost, sum(passed::int)::double passes, count(*)::double runs from runs group by 1, 2), k as (select task, row_number() over (order by task) - 1 i, count(*) over () n from (select distinct task from s)),
d as (select r round, ('0x' || substr(md5(r || ':' || i), 1, 8))::bigint % n i from k, range(1, {ROUNDS + 1}) q(r)), b as (select round, arm, {_AGG} from d join k using (i) join s using (task) group by 1, 2 union all select 0, arm, {_AGG} from s group by arm),
p as (select c.arm, c.round, t.ecpp / c.ecpp ratio, c.rate - t.rate diff from b c join b t on t.round = c.round and t.arm = 'T' where c.arm <> 'T'),
o as (select arm, max(ratio) filter (round = 0) ratio, quantile_cont(ratio, 0.025) filter (round > 0) ratio_low, quantile_cont(ratio, 0.975) filter (round > 0) ratio_high, count(ratio) filter (round > 0) rounds_used, max(diff) filter (round = 0) diff, quantile_cont(diff, 0.025) filter (round > 0) diff_low, quantile_cont(diff, 0.975) filter (round > 0) diff_high from p group by 1)"""
_SHOWN = ["ratio", "ratio_low", "ratio_high", "diff", "diff_low", "diff_high"]


def _contrasts(t):
    task = F.col("l_partkey") % 3 == 0
    arm = F.when(task, "T").when(F.col("l_partkey") % 3 == 1, "P").otherwise("C")
    runs = t("lineitem").select((F.col("l_suppkey") % 40).alias("task"), arm.alias("arm"), (F.col("l_extendedprice") * F.when(task, 0.6).otherwise(1)).alias("cost"), (F.col("l_quantity") > F.when(task, 15).otherwise(20)).alias("passed"))
    return X.contrasts(X.task_sums(runs, "task", "arm", "cost", "passed"), "T", ["P", "C"], ROUNDS)


@query(_BOOT + " select arm, rounds_used, " + ", ".join(f"round({c}, 6) as {c}" for c in _SHOWN) + ", diff_high <= 0.05 as not_inferior, diff_high <= 0.05 and ratio_high < 1 as wins from o")
def bootstrap_contrasts(t):
    """Cluster bootstrap of the cost ratio and the success difference, tasks drawn with replacement."""
    return _contrasts(t).select("arm", "rounds_used", *(F.round(c, 6).alias(c) for c in _SHOWN), "not_inferior", "wins")


@query(_BOOT + " select bool_and(diff_high <= 0.05 and ratio_high < 1) as overall_win, count(*) filter (diff_high <= 0.05 and ratio_high < 1) as won from o")
def gatekeeping(t):
    """The claim holds where every contrast wins."""
    return _contrasts(t).agg(F.bool_and("wins").alias("overall_win"), F.count_if("wins").alias("won"))


@query("""with f as (select l_orderkey, min(l_linenumber) filter (l_quantity > 35) first from lineitem group by 1)
select l_orderkey as run, count(*) filter (first is null or l_linenumber <= first) as attempts, first is not null as passed, first is not null and count(*) filter (l_linenumber <= first) > 1 as flaky from lineitem join f using (l_orderkey) group by l_orderkey, first""")
def acceptance_gate(t):
    runs = t("lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("attempt"), (F.col("l_quantity") > 35).alias("ok"))
    return X.acceptance(runs, ["run"], "ok", "attempt")


RATES = {"input": 3e-6, "output": 15e-6, "cache_write": 3.75e-6, "cache_read": 0.3e-6}


@query("select l_orderkey as run, round(sum(l_quantity * 3e-6 + l_linenumber * 15e-6 + l_suppkey * 3.75e-6 + l_partkey * 0.3e-6), 9) as cost from lineitem group by 1")
def run_costs(t):
    tokens = dict(zip(RATES, map(F.col, ("l_quantity", "l_linenumber", "l_suppkey", "l_partkey"))))
    return t("lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.round(F.sum(X.run_cost(tokens, RATES)), 9).alias("cost"))
