"""Operation sequences against all pairs, and inputs handed on over calls."""

import itertools
import random

from pyspark.sql import functions as F

from plumbline.operators import calls as C
from plumbline.operators import functions as FN
from plumbline.operators import sequences as S
from plumbline.operators import taint


def shared(a, b):
    """The length of a longest common subsequence, by the plain recurrence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_shared_run_is_one_of_the_longest():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        run = S._shared_run(a, b)
        assert len(run) == shared(a, b)
        for side in (a, b):
            left = iter(side)
            assert all(x in left for x in run)
    assert S._shared_run(list("ab"), list("ba")) == ["a"]  # walking back, b of the first is left first


def test_operations(spark):
    lines = {
        "const id = req.body.id;": "INPUT", "if (!isAuthenticated(u)) {": "AUTH", "schema.validate(x)": "VALIDATE", "throw new Error(e)": "RETURN_ERR", "return res.json(x)": "RETURN_OK", "cache.get(k)": "CACHE_READ", "redis.set(k, v)": "CACHE_WRITE",
        "rows = db.query(q)": "QUERY", "user.save()": "MUTATE", "metrics.inc(1)": "METRICS", "bus.publish(e)": "EMIT", "await axios.post(u)": "API_CALL", "withRetry(f)": "RETRY", "mu.Lock()": "LOCK", "defer f()": "RESOURCE", "logger.info(x)": "LOG",
        "JSON.stringify(x)": "SERIALIZE", "JSON.parse(x)": "DESERIALIZE", "xs.reduce(f)": "AGGREGATE", "\t for x in y {": "LOOP", "if x {": "BRANCH", "s.trim()": "TRANSFORM", "x = 1": None, "}": None, "": None,
    }
    got = spark.createDataFrame([(k,) for k in lines], "l string").select("l", S.operation(F.col("l")).alias("o")).collect()
    assert {r.l: r.o for r in got} == lines
    body = "if a\nif b\nx.trim()\n}\nif c"
    assert spark.createDataFrame([(body,)], "b string").select(S.sequence(F.col("b")).alias("s")).first().s == ["BRANCH", "TRANSFORM", "BRANCH"]


def test_no_pair_is_lost(spark):
    rng = random.Random(2)
    names = [n for n, _ in S.OPERATIONS][:9] + ["BRANCH", "LOOP"]
    rows = {}
    for _ in range(150):
        base = tuple(rng.choice(names) for _ in range(rng.randint(3, 14)))
        rows[base] = None
        edited = list(base)
        edited[rng.randrange(len(edited))] = rng.choice(names)
        rows[tuple(edited)] = None
    found = spark.createDataFrame([("d", list(s), 1, 1, f"p{k}", f"p{k}", 1, k) for k, s in enumerate(rows)], "domain string, sequence array<string>, functions long, files long, first_path string, last_path string, shipped long, id long")
    got = {(r.a, r.b): r.similarity for r in S.similar(found).collect()}
    want = {}
    for (i, a), (j, b) in itertools.combinations(enumerate(rows), 2):
        n = shared(a, b)
        if 10 * n >= 8 * max(len(a), len(b)):
            run = S._shared_run(list(a), list(b))
            if n >= 6 or sum(x not in S.FILLER for x in run) >= 2:
                want[i, j] = round(n / max(len(a), len(b)), 6)
    assert len(want) > 50 and got == want


def test_one_file_and_unshipped_functions_count_for_nothing(spark):
    body = "const id = req.params.id;\nstore.save(id);\nreturn res.json(id);"
    rows = [("src/a.js", "x", body), ("src/a.js", "x", body + "\n"), ("tests/b.js", "y", body), ("tests/c.js", "y", body), ("src/d.js", "z", body), ("src/e.js", "z", body), ("src/f.js", "general", body), ("src/g.js", "general", body)]
    got = S.similar(S.classes(spark.createDataFrame(rows, "path string, domain string, body string"))).collect()
    assert [r.domain for r in got] == ["z"] and got[0].similarity == 1.0


CALLER = """export function handle(req, res) {
  const id = req.params.id;
  const name = req.query.name;
  const cured = req.body.cured;
  save(
    wrap(1, [2, 3]),
    id.trim(),
  );
  run(name, "a, b");
  run("x", name);
  run(other);
  erase(cured);
  schema.parse(cured);
  handle(id);
}
"""
CALLEES = """export function save(first, second) {
  const clean = first + 1;
  db.Exec(second);
}
function run(command, label) {
  exec(command);
  schema.parse(label);
  eval(label);
}
function erase(path) {
  fs.writeFile(path, "");
  return path;
}
"""


def test_calls_hand_inputs_on(spark):
    files = spark.createDataFrame([("a.js", "javascript", CALLER), ("b.js", "javascript", CALLEES), ("c.js", "javascript", "function run(command) {\n  const x = command + 1;\n  return x;\n}\n"), ("d.js", "javascript", None)], "path string, language string, content string")
    rows = taint.call_flows(FN.extract(files), C.extract(files)).collect()
    assert sorted((r.function, r.line, r.callee, r.place, r.variable, r.source, r.source_line, tuple(r.categories), r.confidence) for r in rows) == [
        ("handle", 5, "save", 1, "id", "URL parameter", 2, ("sql_injection",), 0.75),
        ("handle", 9, "run", 0, "name", "query parameter", 3, ("command_injection",), 0.5),
    ]
    got = {r.name: (r.reaching, r.categories) for r in taint.summaries(FN.extract(files)).collect()}
    assert got == {"save": ([1], ["sql_injection"]), "run": ([0], ["command_injection"]), "erase": ([0], ["path_traversal"])}


def test_lines_are_looked_at_once(spark):
    """Lines that are alike but for their numbers share one look; numbers that tell something do not."""
    S._operation.cache_clear()
    body = "\n".join(["  run%d(id)" % n for n in range(5000, 6000)] + ["res.status(404)", "res.status(40)", "x.save(1)", "return c.JSON(2)", "return c.JSON(34)", "\u00e9retry (", "retry ("])
    assert S.sequence_of(body) == ["RETURN_ERR", "MUTATE", "RETURN_OK", "RETRY"]
    assert S._operation.cache_info().misses == 8
    lines = spark.createDataFrame([(x,) for x in set(body.split("\n"))], "t string").select("t", S.operation(F.col("t")).alias("o")).collect()
    assert all(S.sequence_of(r.t) == ([r.o] if r.o else []) for r in lines)


def test_bodies_alike_but_for_numbers_are_read_once():
    from plumbline.operators import sequences as S

    S._alike_sequence.cache_clear()
    bodies = [f"validate(a)\nrun1{k}00(a)\nfor x in y:\nreturn jsonify({k + 1000})" for k in range(5)]
    assert len({tuple(S.sequence_of(b)) for b in bodies}) == 1 and S._alike_sequence.cache_info().misses <= 5
    assert S.sequence_of(bodies[0]) == S.sequence_of(bodies[0]) and S._alike_sequence.cache_info().hits >= 2
