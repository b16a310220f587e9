"""Cognitive complexity of bodies, tiers and typical values."""

import random
import time

import pytest

from plumbline.operators import complexity as X

CASES = [
("javascript","if (!a) return err();\nif (!b) return err();\nif (!c) return err();\nreturn ok();",3),
("javascript","if (a) {\n if (b) {\n if (c) return ok();\n }\n}\nreturn err();",6),
("javascript","if (a) { x(); } else { y(); }",2),
("javascript","if (a) { x(); } else if (b) { y(); } else { z(); }",4),   # if1 + else1 + if1(level0) + else1
("javascript","if (a && b || c) x();",3),
("javascript","for (let i = 0; i < 3; i++) {\n  while (x) { y(); }\n}",1+2),
("javascript","switch (x) {\n case 1: a(); break;\n case 2: if (b) c();\n default: d();\n}",1+2+2),
("javascript","try { a(); } catch (e) { if (e) b(); }",1+2),
("javascript","do { a(); } while (b);\nif (c) d();",2),
("javascript","const x = a ? b : c;\nconst y = p?.q ?? r;",1),
("javascript","list.forEach((x) => {\n  if (x) { y(x); }\n});",1),
("javascript","if (a)\n  for (const x of xs)\n    if (x) y();\nz();\nif (q) r();",1+2+3+1),
("javascript","if (a) { if (b) { c(); } else { d(); } }",1+2+1),
("javascript","// if (a) && b\nconst s = 'if (x) || y';",0),
("javascript","if (a)\n  x()\nelse\n  y()\nif (b) z()",1+1+1),
("go","if err != nil {\n return err\n}\nfor i := 0; i < n; i++ {\n if a && b {\n  x()\n } else {\n  y()\n }\n}",1+1+2+1),
("go","if a {\n x()\n} else if b {\n y()\n} else {\n if c {\n z()\n }\n}",1+2+4-1),
("go","switch x {\ncase 1:\n a()\ndefault:\n b()\n}\nselect {\ncase <-c:\n}",1+2+1+1),
("rust","match x {\n  A => 1,\n  B if y => { if z { 2 } else { 3 } }\n}",1+2+2+1),
("rust","match x {\n A => if y { 1 } else { 2 },\n B => 3,\n}",1+2+2+1),
("rust","let f = || 1;\nloop {\n  while let Some(x) = it.next() {\n    if x > 1 && y { break; }\n  }\n}",1+2+3+1),
("python","if a:\n    for x in y:\n        while z:\n            pass\nelif b and c:\n    if d:\n        pass\nelse:\n    pass\n",1+2+3+1+1+1),
("python","try:\n    a()\nexcept E:\n    if b:\n        c()\nx = [i for i in y if i]\nz = a if b else c\nw = (i for i in y)\n",1+2+1+1),
("python","s = 'if x and y'  # if z\nreturn {k: [v for v in q] for k in p}\n",1+2),
]


@pytest.mark.parametrize(("language", "body", "want"), CASES)
def test_scores(language, body, want):
    assert X.score_of(body, language) == want


def test_no_language():
    assert X.score_of("if (a) b();", "cobol") is None and X.score_of("", "go") == 0


@pytest.mark.parametrize("body", ["if (a) " * 50000 + "b();", "{" * 100000, "if (a) {" * 30000 + "}" * 30000, "a && " * 100000])
def test_long_bodies(body):
    start = time.time()
    X.score_of(body, "javascript")
    assert time.time() - start < 10


def test_report_and_typical(spark):
    rng = random.Random(2)
    rows = [(f"p{k % 7}", f"f{k}", k, rng.choice([0, 3, 6, 7, 9, 10, 11, 15, 16, 40])) for k in range(400)]
    frame = spark.createDataFrame(rows, "path string, name string, start_line int, complexity int")
    got = X.report(frame).collect()
    for severity, low, high, cap, confidence in (("error", 16, 99, 30, 0.9), ("warning", 11, 15, 30, 0.75), ("info", 7, 10, 20, 0.5)):
        tier = sorted((-c, p, line, n) for p, n, line, c in rows if low <= c <= high)
        assert [(-r.complexity, r.path, r.line, r.name) for r in sorted((r for r in got if r.severity == severity and r.rank), key=lambda r: r.rank)] == tier[:cap]
        rest = [r for r in got if r.severity == severity and r.rank is None]
        assert [(r.rolled_up, r.complexity, r.lowest, r.confidence) for r in rest] == ([(len(tier) - cap, -tier[cap][0], -tier[-1][0], round(max(0.3, confidence - 0.2), 2))] if len(tier) > cap else [])
    typical = {r.path: (r.functions, r.median, r.p90, r.max) for r in X.typical(frame, ["path"]).collect()}
    for path in {r[0] for r in rows}:
        values = sorted(r[3] for r in rows if r[0] == path)
        assert typical[path] == (len(values), values[len(values) // 2], values[max(0, int(len(values) * 0.9) - 1)], values[-1])


def test_bodies_alike_but_for_numbers_are_scored_once():
    from plumbline.operators import complexity as X

    X._alike_score.cache_clear()
    bodies = [f"if (a{k} > {10**k}) {{ b(); }} else if (c && {k}) {{ d(); }}" for k in range(5)]
    assert [X.score_of(b, "go") for b in bodies] == [X._score(b, "go") for b in bodies]
    assert X._alike_score.cache_info().misses == 1 and X.score_of("x = 1\n" * 1000, "go") == 0
    assert X._alike_score.cache_info().misses == 1  # a long body is not kept
