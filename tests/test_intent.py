"""Declared conventions: phrases, headings, negations, repetitions, and the votes they seed."""

import pytest

from plumbline.operators import intent as I


def said(spark, text, source="AGENTS.md"):
    rows = I.hints(spark.createDataFrame([("p", source, text)], "project string, source string, content string")).collect()
    return {(r.pattern, r.line, r.confidence) for r in rows}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("We use prisma.", {("orm", 1, 0.5)}),
        ("## Conventions\n\n- Use Prisma", {("orm", 3, 0.9)}),
        ("## History\nalways prisma", {("orm", 2, 0.7)}),
        ("reformat and transform", set()),
        ("Do not use default exports", set()),
        ("avoid default exports", {("named", 1, 0.5)}),
        ("never prisma, but typeorm", {("orm", 1, 0.5)}),  # the second word of the same pattern is not negated
        ("# Style\nUse camelCase\n# Other\ncamelCase", {("camelCase", 2, 0.9)}),
        ("#Style\nUse camelCase", {("camelCase", 2, 0.7)}),  # no heading without a blank
        ("require auth on all", {("auth_required", 1, 0.7)}),
        ("", set()),
        ("result<T> or { error }", {("result_type", 1, 0.5), ("http_error_response", 1, 0.5), ("result_object", 1, 0.5)}),
    ],
)
def test_lines(spark, text, want):
    assert said(spark, text) == want


def test_one_of_several(spark):
    rows = [("p", ".cursorrules", "## Rules\nUse redux"), ("p", "AGENTS.md", "## Rules\n\nUse redux"), ("p", "CLAUDE.md", "redux"), ("p", "README.md", "## Rules\nUse mobx"), ("q", "CLAUDE.md", None)]
    got = I.hints(spark.createDataFrame(rows, "project string, source string, content string")).collect()
    assert [(r.project, r.pattern, r.source, r.line, r.confidence, r.label) for r in got] == [("p", "redux", "AGENTS.md", 3, 0.9, "Redux")]


def test_seeded_votes(spark):
    found = spark.createDataFrame([("p", "export_style", "named", "named exports", "AGENTS.md", 1, 0.9), ("q", "export_style", "named", "named exports", "AGENTS.md", 1, 0.9)], "project string, category string, pattern string, label string, source string, line int, confidence double")
    votes = spark.createDataFrame([("p", "export_style", "a", "named", 3, 3.0), ("p", "export_style", "a", "default", 4, 4.0), ("q", "export_style", "a", "default", 1, 1.0), ("q", "export_style", "b", "default", 2, 2.0), ("r", "export_style", "a", "default", 2, 2.0)], "project string, category string, grp string, pattern string, cnt long, weight double")
    got = {(r.project, r.grp): (r.dominant, r.raw_dominant, r.total, r.declared, r.matches) for r in I.seeded(votes, found).collect()}
    assert got == {("p", "a"): ("named", "default", 7, "named", False), ("q", "a"): ("named", "default", 1, "named", False), ("q", "b"): ("default", "default", 2, "named", False), ("r", "a"): ("default", "default", 2, None, None)}
