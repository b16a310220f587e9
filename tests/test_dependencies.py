"""Dependencies of hand-written projects in four ecosystems."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import dependencies as D
from plumbline.operators.code import language

FILES = [
    ("a", "src/x.ts", 'import React from "react";\nimport "./own";\nimport fs from "fs";\nimport p from "node:path";\nconst l = require("lodash/fp");\nconst m = await import("@scope/pkg/deep");\n// import gone from "gone";\nimport z from "@/alias"; import v from "virtual:x";\nexport { q } from "missing-one";\n'),
    ("a", "fixtures/y.js", 'import bad from "not-there";\n'),
    ("a", "webpack.config.js", 'module.exports = { loader: "ts-loader", alias: require.resolve("buffer/") };\n'),
    ("b", "main.go", 'package main\n\nimport (\n\t"fmt"\n\tsdk "github.com/org/sdk/sub/v2"\n\t// "github.com/x/remark"\n)\nimport "example.com/b/tools/inner"\n'),
    ("b", "tools/t.go", 'package tools\n\nimport "github.com/other/lib/a/b"\nimport "github.com/org/sdk/sub"\n'),
    ("b", "broken/deep/u.go", 'package u\n\nimport "github.com/never/seen"\n'),
    ("b", "toolsy/v.go", 'package v\n\nimport "github.com/org/sdkx"\n'),
    ("c", "m.py", "import os, sys\nfrom Flask import x\nimport numpy as np\n    import inner\n"),
    ("c", "l.rs", "use std::io;\nuse serde_json::Value;\nuse crate::x;\n"),
    ("c", "null.py", None),
]
DECLARED = [
    ("a", "", "npm", "dependencies", "react"), ("a", "", "npm", "dependencies", "lodash"), ("a", "", "npm", "dependencies", "@scope/pkg"), ("a", "", "npm", "devDependencies", "ts-loader"), ("a", "", "npm", "dependencies", "buffer"), ("a", "", "npm", "dependencies", "unused-one"), ("a", "", "npm", "devDependencies", "eslint-plugin-x"), ("a", "", "npm", "self", "a"),
    ("b", "", "go", "require", "github.com/org/sdk"), ("b", "", "go", "indirect", "github.com/deep/dep"), ("b", "", "go", "require", "github.com/old/thing"), ("b", "tools", "go", "require", "github.com/other/lib"), ("b", "idle", "go", "require", "github.com/idle/dep"),
    ("c", "", "pypi", "requires", "flask"), ("c", "", "pypi", "requires", "requests"), ("c", "", "cargo", "dependencies", "serde-json"), ("c", "", "cargo", "dependencies", "tokio"),
]
MODULES = [("b", "", "example.com/b", False), ("b", "tools", "example.com/b/tools", False), ("b", "broken", "", True), ("b", "idle", "example.com/b/idle", False)]


@pytest.fixture(scope="module")
def tables(spark):
    files = spark.createDataFrame(FILES, "project string, path string, content string").withColumn("language", language(F.col("path")))
    return files, spark.createDataFrame(DECLARED, "project string, dir string, ecosystem string, kind string, dep string"), spark.createDataFrame(MODULES, "project string, dir string, module string, opaque boolean")


def test_check(tables):
    got = sorted(tuple(r) for r in D.check(*tables).collect())
    assert got == [
        ("a", "", "npm", "missing", "missing-one"), ("a", "", "npm", "unused", "unused-one"),
        ("b", "", "go", "missing", "github.com/org/sdkx"), ("b", "", "go", "unused", "github.com/old/thing"), ("b", "tools", "go", "missing", "github.com/org/sdk/sub"),
        ("c", "", "cargo", "unused", "tokio"), ("c", "", "pypi", "unused", "requests"),
    ]


def test_findings(spark, tables):
    rows = D.check(*tables)
    got = {(r.project, r.ecosystem, r.kind): (r["count"], r.severity, r.confidence) for r in D.findings(rows).collect()}
    assert got == {("a", "npm", "missing"): (1, "error", 0.75), ("a", "npm", "unused"): (1, "warning", 0.75), ("b", "go", "missing"): (2, "error", 0.8), ("b", "go", "unused"): (1, "warning", 0.7), ("c", "cargo", "unused"): (1, "warning", 0.7)}
    mono = {(r.project, r.ecosystem, r.kind): (r.severity, r.confidence) for r in D.findings(rows, spark.createDataFrame([("a",)], "project string")).collect()}
    assert mono["a", "npm", "missing"] == ("warning", 0.4) and mono["b", "go", "missing"] == ("error", 0.8)


def test_nearest_takes_whole_segments(tables):
    files, _, modules = tables
    got = {r.path: (r.dir, r.opaque) for r in D.nearest(files.where("project = 'b'"), modules).collect()}
    assert got == {"main.go": ("", False), "tools/t.go": ("tools", False), "broken/deep/u.go": ("broken", True), "toolsy/v.go": ("", False)}


def test_empty(spark, tables):
    files, declared, modules = tables
    assert D.check(files.limit(0), declared.limit(0), modules.limit(0)).count() == 0
