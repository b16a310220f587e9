"""Trees, ignore rules and manifests on generated folders."""

import json

from pyspark.sql import functions as F

from plumbline.operators import code as C
from plumbline.sources import repo


def tree(root, content):
    for name, text in content.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_files(spark, tmp_path):
    tree(tmp_path, {
        "src/a.ts": "one\ntwo", "src/b.mts": "x", "src/c.CTS": "upper case is no extension", "lib/d.py": "pass", "lib/.venv/e.py": "no", "coverage/f.js": "no", "lib/jquery.min.js": "v", "big.js": "y" * (repo.MAX_BYTES + 1),
        "long.go": "z" * 2001, "out/g.rs": "no", "src/out/h.rs": "no", "keep/i.js": "taken back", "skip1.js": "no", "docs/j.js": "no", "src/docs/k.js": "only the root's docs go", ".gitignore": "# remark\nout/\nskip?.js\n*.tmp\n/docs\nkeep/*\n!keep/i.js\n",
    })
    got = {r.rel_path: r for r in repo.files(spark, str(tmp_path)).collect()}
    assert set(got) == {"src/a.ts", "src/b.mts", "lib/d.py", "keep/i.js", "src/docs/k.js"}
    assert got["src/a.ts"].line_count == 2 and got["src/b.mts"].language == "typescript" and got["lib/d.py"].line_count == 1
    every = {r.rel_path: r for r in repo.files(spark, str(tmp_path), with_skipped=True).collect()}
    assert {k: r.skipped for k, r in every.items() if r.skipped} == {"lib/jquery.min.js": "vendored", "big.js": "too large", "long.go": "long line"}
    assert every["big.js"].content is None and set(every) == set(got) | {"lib/jquery.min.js", "big.js", "long.go"}


def test_manifests(spark, tmp_path):
    tree(tmp_path, {
        "package.json": json.dumps({"name": "x", "dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}), "web/package.json": "{broken", "node_modules/z/package.json": json.dumps({"dependencies": {"q": "1"}}),
        "go.mod": "module m.org/x\n\ngo 1.21\n\nrequire one.org/a v1.2.3\n\nrequire (\n\ttwo.org/b v0.1.0\n\tthree.org/c v2.0.0 // indirect\n)\n\nexclude (\n\tfour.org/d v1.0.0\n)\n",
        "Cargo.toml": '[package]\nname = "x"\nversion = "1"\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.2", features = ["full"] }\n[dev-dependencies]\nrand = "0.8"\n',
        "requirements.txt": "# remark\nNumpy==1.2\nrequests[socks] >= 2 # why\n-r other.txt\nplain\nold ; python_version < '3'\n", ".env.example": "API_URL=http://x\n# no\nexport KEY = 1\n",
    })
    got = {(r.ecosystem, r.kind, r.dep, r.version) for r in repo.declared(repo.manifests(spark, str(tmp_path))).collect()}
    assert got == {
        ("npm", "dependencies", "a", "^1"), ("npm", "devDependencies", "b", "2"), ("go", "require", "one.org/a", "v1.2.3"), ("go", "require", "two.org/b", "v0.1.0"), ("go", "indirect", "three.org/c", "v2.0.0"),
        ("cargo", "dependencies", "serde", "1.0"), ("cargo", "dependencies", "tokio", "1.2"), ("cargo", "dev-dependencies", "rand", "0.8"),
        ("pypi", "requires", "numpy", "==1.2"), ("pypi", "requires", "requests", ">= 2"), ("pypi", "requires", "plain", ""), ("pypi", "requires", "old", ""), ("env", "variable", "API_URL", "http://x"), ("env", "variable", "KEY", "1"),
    }


def test_globs():
    import re

    cases = [("**/*.ts", "a/b.ts", True), ("**/*.ts", "b.ts", True), ("*.ts", "a/b.ts", False), ("src/**", "src/a/b", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("[!a]b", "cb", True), ("[!a]b", "ab", False), ("a.b+c", "a.b+c", True), ("a.b", "axb", False)]
    for glob, path, want in cases:
        assert bool(re.match(C.glob_regex(glob), path)) == want, (glob, path)


def test_classifiers(spark):
    rows = spark.createDataFrame([("fooBar", "//x"), ("FOO_BAR", ""), ("Foo", ""), ("foo_bar", ""), ("foo-bar", ""), ("9", "")], "name string, body string")
    assert [r[0] for r in rows.select(C.naming(rows.name)).collect()] == ["camelCase", "SCREAMING_SNAKE", "PascalCase", "snake_case", "kebab-case", None]
    texts = spark.createDataFrame([("pw password=abcdefgh1 x",), ("redis://u:pass@h",), ("-----BEGIN PRIVATE KEY-----\nab\n-----END PRIVATE KEY-----",), ("sk-ant-api03-abcdefghijklmnop",), ("plain text: ok",)], "t string")
    assert [r[0] for r in texts.select(C.mask_secrets(texts.t)).collect()] == ["pw password=[masked] x", "redis://u:[masked]@h", "[masked]", "[masked]", "plain text: ok"]
    assert [r[0] for r in spark.createDataFrame([("hello",), ("the quick brown fox jumps",)], "t string").select(C.hash31(F.col("t"))).collect()] == [99162322, _java("the quick brown fox jumps")]


def _java(text):
    h = 0
    for c in text:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h - 2**32 if h >= 2**31 else h


def test_git_history(spark, tmp_path):
    import subprocess

    from plumbline.sources import gitlog

    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@example.org", *args], check=True, capture_output=True)

    git("init", "-q")
    for n, name in enumerate(("a.ts", "ü b.ts", "a.ts")):
        (tmp_path / name).write_text(str(n))
        git("add", "-A")
        git("commit", "-qm", f"c{n}")
    (tmp_path / "a.ts").write_text("changed")
    (tmp_path / "new.ts").write_text("x")
    for size in (1, 100):
        rows = {r.path: (r.commits, r.authors) for r in gitlog.file_history(gitlog.touches(spark, str(tmp_path), size)).collect()}
        assert rows == {"a.ts": (2, 1), "ü b.ts": (1, 1)}
    assert sorted(r.path for r in gitlog.changed(spark, str(tmp_path)).collect()) == ["a.ts", "new.ts"]
