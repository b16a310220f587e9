"""Import styles of hand-written files on eight axes, and their votes."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import import_style as S
from plumbline.operators.code import language

FILES = {
    "a/one.ts": ('import a from "./a";\nimport type T from "./t";\nimport b from "@/b";\n// import c from "./c";\nconst d = require("../d"), e = require("./e"); // require("@/f")\nimport r from "react";\n', {"path_style": "relative"}),
    "a/two.ts": ('import a from "@/a";\nimport b from "~/b";\nimport c from "@/c";\n', {"path_style": "alias"}),
    "a/few.ts": ('import a from "@/a";\nimport b from "./b";\n', {}),
    "b/grouped.go": ('package b\n\nimport (\n\t"fmt"\n\t"os"\n\n\t"github.com/x/y"\n)\n\nvar s = "not/an/import"\n', {"go_grouping": "grouped", "go_ordering": "ordered"}),
    "b/flat.go": ('import (\n\t"os"\n\t// "a/remark"\n\tx "github.com/x/y"\n\t`fmt`\n)\n', {"go_grouping": "flat", "go_ordering": "unordered"}),
    "b/parts.go": ('import (\n\t"z"\n\n\t"a"\n\t"b"\n)\n', {"go_ordering": "ordered"}),
    "b/single.go": ('import "fmt"\nimport _ "github.com/x/y"\nimport ( "os" )\nvar s = "x"\n', {"go_grouping": "flat", "go_ordering": "ordered"}),
    "pkg/sub/m.py": ('"""\nfrom .doc import no\n"""\nfrom . import a\nfrom ..b import c\nfrom pkg.d import e\nfrom os import path\n# from .x import y\n', {"py_path_style": "relative", "py_wildcard": "explicit"}),
    "pkg/sub/abs.py": ("from pkg.a import b\nfrom sub.c import *\n", {"py_path_style": "absolute", "py_wildcard": "wildcard"}),
    "pkg/one.py": ("from os import path\nimport sys\n", {}),
    "c/a.rs": ("use std::io;\n\nuse serde::{\n    Serialize,\n\n    Deserialize,\n};\nuse crate::x::y;\nuse super::z;\n/*\nuse crate::no;\n*/\nmod t {\n    use super::*;\n}\n", {"rust_glob": "explicit", "rust_use_path": "crate", "rust_grouping": "grouped"}),
    "c/b.rs": ("use std::io;\nuse serde::{\n    A,\n\n    B,\n};\nuse rayon::prelude::*;\nuse crate::m::Kind::*;\n", {"rust_glob": "explicit", "rust_grouping": "flat"}),
    "c/d.rs": ("use crate::m::*;\npub use self::child::Item;\nuse self::a;\nuse super::b;\n", {"rust_glob": "glob", "rust_use_path": "relative"}),
    "c/e.rs": ("use super::*;\n", {}),
    "tests/x.test.ts": ('import a from "@/a";\nimport b from "@/b";\nimport c from "@/c";\n', {}),
    "n/null.go": (None, {}),
}


@pytest.fixture(scope="module")
def found(spark):
    frame = spark.createDataFrame([(p, c) for p, (c, _) in FILES.items()], "path string, content string").withColumn("language", language(F.col("path")))
    out = {}
    for r in S.classify(frame).collect():
        out.setdefault(r.path, {})[r.axis] = r.pattern
    return out


@pytest.mark.parametrize("path", FILES)
def test_files(found, path):
    assert found.get(path, {}) == FILES[path][1]


def test_findings(spark):
    rows = [(f"d/f{k}", "rust_glob", "glob" if k < 2 else "explicit") for k in range(12)] + [(f"e/f{k}", "rust_glob", "explicit") for k in range(9)] + [(f"d/f{k}", "py_wildcard", "wildcard" if k % 2 else "explicit") for k in range(10)] + [("d/x", "go_ordering", "ordered"), ("d/y", "go_ordering", "unordered")]
    got = sorted(map(tuple, S.findings(spark.createDataFrame(rows, "path string, axis string, pattern string")).collect()), key=str)
    assert [(g[0], g[1], g[2], g[3], g[4], g[5], g[6], g[7]) for g in got] == [("py_wildcard", None, None, None, 10, 50, None, "warning"), ("rust_glob", "d", "explicit", 10, 12, 83, 2, "info")]
