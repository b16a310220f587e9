from pyspark.sql import functions as F

from plumbline.operators import imports as I

SPECS = ["./b", "./b.js", "../b.jsx", "./b.mjs", "./b.cjs", "./b.ts", "./index", "./index.js", "./b/index", "../x.gen", "./b.test", "./.env", ".", "..", "./b.tsx/", "./index/index.ts", "./a.mts"]


def test_few_stems_cover_every_candidate(spark):
    rows = spark.createDataFrame([("src/m/a.ts", s) for s in SPECS], "path string, spec string")
    aim, ending = I._target(F.col("path"), F.col("spec"), None), I._ending(F.col("spec"))
    rows = rows.select("spec", I.candidates(F.col("path"), F.col("spec")).alias("all"), I._stems(aim, ending).alias("stems"))
    for r in rows.select("*", F.transform("all", I._stem).alias("met")).collect():
        assert set(r.met) <= set(r.stems) and len(r.stems) <= 4 < len(r["all"]), r


def test_links_of_repeated_files_and_imports(spark):
    found = spark.createDataFrame([("a/x.ts", "./y", []), ("a/x.ts", "./y", []), ("a/x.ts", "./z.js", []), ("a/x.ts", "react", []), ("a/x.ts", "lib/only", [])], "path string, spec string, names array<string>")
    files = spark.createDataFrame([(p,) for p in ("a/x.ts", "a/y/index.ts", "a/y.tsx", "a/y.tsx", "a/z.ts", "b/only.ts", "c/only/index.ts")], "path string")
    assert {tuple(r) for r in I.resolve(found, files).collect()} == {("a/x.ts", "./y", "a/y.tsx"), ("a/x.ts", "./z.js", "a/z.ts"), ("a/x.ts", "react", None), ("a/x.ts", "lib/only", None)}
    assert sorted(tuple(r) for r in I.edges(found, files).collect()) == [("a/x.ts", t) for t in ("a/y.tsx", "a/z.ts", "b/only.ts", "c/only/index.ts")]
