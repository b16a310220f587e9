"""Exports and imports over several lines, dead and unwired names."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import exports as E
from plumbline.operators.code import language

A = """export async function createUser(a) {
  return helper(a);
}
export const one = 1, two = 2;
function helper(x) { return x; }
function listed() {}
export {
  listed,
  helper as renamed,
};
// export const remark = 1;
export default class Main {}
"""
B = """import Main, {
  createUser,
  type Shape,
  one as first,
} from "./a";
import * as ns from './c';
import "./side";
const { x, y: z } = require("./c");
const lazy = await import("./d.js");
export { deep } from "./e";
export * from './f';
module.exports = { saveAll, other: 1 };
exports.getAll = createUser;
"""
FILES = [("src/a.ts", A), ("src/b.js", B), ("src/c.ts", "export function deleteC() {}\n"), ("src/d.js", "export let loadD = 1;\n"), ("src/e.ts", "export const deep = 1;\nexport function addE() {}\n"), ("src/f.ts", "export type F = 1;\n"), ("api/lone.ts", "export function updateLone() {}\nexport function saveLone() {}\nexport function render() {}\nexport const removeLone = 1;\n"), ("api/routes.py", '@app.post("/x")\n@guard\ndef updateLone():\n    pass\n'), ("api/main.go", 'r.POST("/y", auth, h.saveLone)\n'), ("n.ts", None), ("src/side.ts", "x = 1\n")]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, content string").withColumn("language", language(F.col("path")))


def test_exports(files):
    got = {(r.path, r.name): (r.is_default, r.line) for r in E.exports(files).collect()}
    assert {n: v for (p, n), v in got.items() if p == "src/a.ts"} == {"createUser": (False, 1), "one": (False, 4), "listed": (False, 7), "helper": (False, 7), "Main": (True, 12)}
    assert {n for (p, n) in got if p == "src/b.js"} == {"deep", "saveAll", "other", "getAll"}


def test_imports(files):
    got = sorted((r.spec, tuple(r.names)) for r in E.imports(files).where("path = 'src/b.js'").collect())
    assert got == [("./a", ("Main",)), ("./a", ("createUser", "Shape", "one")), ("./c", ("ns",)), ("./c", ("x", "y")), ("./d.js", ("lazy",)), ("./e", ()), ("./f", ()), ("./side", ())]


def test_dead(files):
    got = {(r.path, r.name) for r in E.dead(files).collect()}
    # helper and listed stand twice in their own file, createUser and one are imported, deep is told twice
    assert got == {("src/b.js", "deep"), ("src/b.js", "saveAll"), ("src/b.js", "other"), ("src/b.js", "getAll"), ("src/c.ts", "deleteC"), ("src/d.js", "loadD"), ("src/e.ts", "deep"), ("src/e.ts", "addE"), ("src/f.ts", "F"), ("api/lone.ts", "updateLone"), ("api/lone.ts", "saveLone"), ("api/lone.ts", "render"), ("api/lone.ts", "removeLone")}


def test_unwired(files):
    assert {(r.path, r.line, r.name) for r in E.unwired(files).collect()} == {("api/lone.ts", 4, "removeLone"), ("src/b.js", 12, "saveAll"), ("src/b.js", 13, "getAll")}
    got = {r.folder: (r.unwired, r.total, r.consistency, r.severity) for r in E.unwired_findings(files).collect()}
    assert got == {"api": (1, 3, 67, "warning"), "src": (2, 7, 71, "warning")}
