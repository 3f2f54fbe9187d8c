"""Text corpora derived from the test tables.

The tables hold prose, web pages and relational rows but no source trees, so
trees are derived from their rows: every row becomes one file, whose text is
built from the row's values.  Each corpus is a projection written in the SQL
subset that Spark and DuckDB share, so both engines see the same files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.sources.tables import as_files, spread


@dataclass(frozen=True)
class Part:
    """Files made from one table: SQL for repository, path and text, and a filter."""

    table: str
    repo: str
    path: str
    text: str
    where: str = "true"

    def sql(self) -> str:
        return (f"SELECT {self.repo} AS repo, {self.path} AS path, {self.text} AS text "
                f"FROM {self.table} WHERE {self.where}")


def literal(text: str) -> str:
    """A SQL string literal that reads the same in both dialects."""
    pieces = [f"'{p}'" for p in text.split("'")]
    return pieces[0] if len(pieces) == 1 else "concat(" + ", chr(39), ".join(pieces) + ")"


def fill(template: str, **values: str) -> str:
    """SQL that replaces ``@name`` marks of a template by SQL expressions."""
    out = literal(template)
    for name, expression in values.items():
        out = f"replace({out}, '@{name}', {expression})"
    return out


def cases(selector: str, branches: dict[int, str], otherwise: str) -> str:
    whens = " ".join(f"WHEN {value} THEN {sql}" for value, sql in branches.items())
    return f"CASE {selector} {whens} ELSE {otherwise} END"


ORDER_FILE = """import { part } from "../../parts/p_@PART.js";
const again = require("../../parts/p_@PART");
import fs from "fs";
// import { old } from "../../parts/p_0.js";
export async function price_@ORDER(qty: number) {
  return qty * @QTY;
}
"""

PART_FILES = {
    0: (".ts", """import { brand } from "./p_@PREV.js";
export interface Shape_@KEY { id: string; }
export class Widget_@KEY {
  getName(id: string): string { return "@NAME"; }
  format(a) {
  if (a) {
}
export const make_@KEY = (a, b) => a;
"""),
    1: (".py", """from .p_@PREV import base
import os
class Widget_@KEY(Base):
    def name(self):
        return "@NAME"
# def hidden():
async def load_@KEY(x):
"""),
    2: (".go", """package parts
func (w *Widget) Name_@KEY() string {
func New_@KEY(a int) *Widget {
type Widget_@KEY struct {
"""),
    3: (".rs", """pub struct Widget_@KEY {
pub(crate) async fn load_@KEY(x: u8) {
impl Widget_@KEY {
let x = 1;
"""),
    4: (".java", """public final class Widget_@KEY {
  public String getName(String id) {
    if (id) {
    } else if (x) {
  else if (x) {
private static int count(int a) {
class Plain_@KEY {
"""),
    5: (".md", """# @NAME
## @BRAND
plain text
* item
####### seven
"""),
    6: (".js", """const base = require('./p_@PREV');
export default function make_@KEY(a) {
const arrow_@KEY = async x => x;
async getUser(id) {
  return import("./p_@PREV");
"""),
    7: (".kt", """data class Point_@KEY(val x: Int)
enum class Kind_@KEY {
fun load() {
"""),
}


def _part_file(n: int) -> str:
    return fill(PART_FILES[n][1], KEY="cast(p_partkey AS string)", NAME="p_name", BRAND="p_brand",
                PREV="cast(p_partkey - 16 AS string)")


CODE = [
    Part("lineitem", "'repo_' || cast(l_partkey % 16 AS string)",
         "'src/orders/o_' || cast(l_orderkey AS string) || '/l' || cast(l_linenumber AS string) || '_p' || "
         "cast(l_partkey AS string) || '_s' || cast(l_suppkey AS string) || '_q' || "
         "cast(cast(l_quantity AS int) AS string) || '.ts'",
         fill(ORDER_FILE, PART="cast(l_partkey AS string)", ORDER="cast(l_orderkey AS string)",
              QTY="cast(cast(l_quantity AS int) AS string)")),
    Part("part", "'repo_' || cast(p_partkey % 16 AS string)",
         "'src/parts/p_' || cast(p_partkey AS string) || " +
         cases("p_size % 8", {n: f"'{ext}'" for n, (ext, _) in PART_FILES.items()}, "''"),
         cases("p_size % 8", {n: _part_file(n) for n in PART_FILES}, "''")),
]

_C = "cast(c_custkey AS string)"
CONFIG = [
    Part("customer", "'nation_' || cast(c_nationkey AS string)", cases("c_custkey % 12", {
        0: f"'services/c_{{}}/.env.' || lower(c_mktsegment)",
        1: "'services/c_{}/id_rsa'",
        2: "'services/c_{}/Server.KEY'",
        3: "'services/c_{}/.kube/config'",
        4: "'node_modules/c_{}/index.js'",
        5: "'services/dist/c_{}.js'",
        6: "'services/c_{}/run.log'",
        7: "'a/b/c/d/e/f/g/c_{}.ts'",
        8: "'assets/c_{}.bin'",
        9: "'services/c_{}/keep.log'",
        10: "'tmp/c_{}.py'",
    }, "'services/c_{}/main.py'").replace("{}", f"' || {_C} || '"),
         "CASE WHEN c_custkey % 12 = 8 THEN concat('bin', chr(0), c_name) ELSE "
         "concat('owner = ', c_name, chr(10), 'segment = ', c_mktsegment, chr(10)) END"),
    Part("nation", "'nation_' || cast(n_nationkey AS string)", "'.gitignore'",
         "CASE n_nationkey % 3 WHEN 0 THEN concat('# logs', chr(10), '*.log', chr(10), '!keep.log', chr(10), '/tmp/', chr(10)) "
         "WHEN 1 THEN concat('!dist', chr(10), '[z-a]*.py', chr(10), 'services/**/run.log', chr(10)) "
         "ELSE concat('assets/', chr(10), '!assets/*.bin', chr(10)) END"),
]

_REPO = "'cust_' || cast(c_custkey AS string)"
_TWELVE = ", ".join(f'"dep{i}": "^{i}.0.0"' for i in range(12))
MANIFEST = [
    Part("customer", _REPO, "'package.json'",
         "CASE WHEN c_custkey % 7 = 0 THEN '{broken' "
         "WHEN c_custkey % 5 = 0 THEN '{\"description\": \"no name\"}' "
         "ELSE concat('{\"name\": \"', lower(c_mktsegment), '-', cast(c_custkey AS string), '\", \"version\": \"1.', "
         "cast(c_nationkey AS string), '.0\", \"dependencies\": {', "
         f"CASE WHEN c_custkey % 4 = 0 THEN '{_TWELVE}' ELSE concat('\"', lower(c_mktsegment), '\": \"1\"') END, "
         "'}, \"devDependencies\": {\"tester\": \"2\"}, \"scripts\": {\"build\": \"b\", \"test\": \"t\"}}') END",
         "c_custkey % 3 <> 2"),
    *[Part("customer", _REPO, f"'{name}'", "c_name", f"c_custkey % {mod} = {rem}")
      for name, mod, rem in [("requirements.txt", 4, 0), ("pyproject.toml", 6, 0), ("go.mod", 5, 1),
                             ("Cargo.toml", 7, 2), ("pom.xml", 9, 3), ("build.gradle.kts", 6, 3),
                             ("composer.json", 11, 4), ("Gemfile", 13, 5), ("Dockerfile", 3, 1),
                             ("docker-compose.yaml", 6, 1), ("nested/go.mod", 2, 0)]],
    Part("customer", _REPO, "'README.md'",
         "concat('# ', c_name, chr(10), chr(10), 'Segment ', c_mktsegment, chr(10), 'a', chr(10), 'b', chr(10), 'c')",
         "c_custkey % 8 = 1"),
]

DOCS = [Part("documents", "source", "lang || '/doc_' || cast(doc_id AS string) || '.txt'", "text")]

PAGES = [Part("pages", "split_part(url, '/', 3)",
              "'site/' || regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) || '/Page_' || "
              "cast(page_id AS string) || CASE WHEN page_id % 3 = 0 THEN '.HTM' ELSE '.html' END", "html")]

_BASE_TEXT = ("concat('name: ', p_name, chr(10), 'brand: ', p_brand, chr(10), 'type: ', p_type, chr(10), "
              "'size: ', cast(p_size AS string), chr(10))")
_STAGED_TEXT = f"CASE WHEN p_partkey % 10 IN (1, 5) THEN replace({_BASE_TEXT}, 'brand: ', 'label: ') ELSE {_BASE_TEXT} END"
_WORKING_TEXT = (f"CASE WHEN p_partkey % 10 IN (3, 5) THEN concat({_STAGED_TEXT}, 'stock: 1', chr(10), 'stock: 1') "
                 f"ELSE {_STAGED_TEXT} END")
_PART_REPO = "'shop_' || cast(p_partkey % 7 AS string)"
_PART_PATH = "'lib/p_' || cast(p_partkey AS string) || '.yml'"
BASE = [Part("part", _PART_REPO, _PART_PATH, _BASE_TEXT, "p_partkey % 10 NOT IN (8, 9)")]
STAGED = [Part("part", _PART_REPO, _PART_PATH, _STAGED_TEXT, "p_partkey % 10 NOT IN (2, 8)")]
WORKING = [Part("part", _PART_REPO, _PART_PATH, _WORKING_TEXT, "p_partkey % 10 <> 4")]

# Groups of five files around one module: it imports itself, and others name it by a shorter, a longer and the whole path.
_T = "cast(c_custkey - c_custkey % 5 AS string)"
MODULES = [
    Part("customer", "'group_' || cast((c_custkey - c_custkey % 5) % 16 AS string)", cases("c_custkey % 5", {
        0: f"'pkg/src/lib/mod_' || {_T} || '.ts'",
        1: f"'use_' || {_C} || '.js'",
        2: f"'deep/pkg/src/app/use_' || {_C} || '.cjs'",
        3: f"'pkg/src/app/use_' || {_C} || '.tsx'",
    }, f"'pkg/src/lib/mod_' || {_T} || '.md'"), cases("c_custkey % 5", {
        0: fill('import { own } from "./mod_@T.js";\nexport const own = 1;\n', T=_T),
        1: fill('const lib = require("./lib/mod_@T");\n', T=_T),
        2: fill('const lib = require("../lib/mod_@T.js");\n', T=_T),
        3: fill('import a from "../lib/mod_@T";\nimport b from "../lib/mod_@T.ts";\n', T=_T),
    }, "'# notes'")),
]

_WIDE = fill("name: @NAME\nsize: @SIZE\nend: size: @SIZE\nlast", NAME="p_name", SIZE="cast(p_size AS string)")
WINDOWS = [Part("part", _PART_REPO, "'win/p_' || cast(p_partkey AS string) || '.ini'",
                f"CASE WHEN p_partkey % 2 = 0 THEN replace({_WIDE}, chr(10), chr(13) || chr(10)) ELSE {_WIDE} END")]

CORPORA = {
    "docs": DOCS, "pages": PAGES, "code": CODE, "config": CONFIG, "manifest": MANIFEST,
    "base": BASE, "staged": STAGED, "working": WORKING, "modules": MODULES, "windows": WINDOWS,
}


def corpus_sql(name: str) -> str:
    """The corpus as a query over the test tables (``repo, path, text``)."""
    return " UNION ALL ".join(part.sql() for part in CORPORA[name])


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The corpus as a ``files`` table."""
    out = None
    for part in CORPORA[name]:
        table = spark.read.parquet(f"{sf_dir}/{part.table}.parquet").filter(part.where)
        used = [c for c in table.columns if c in f"{part.repo} {part.path} {part.text}"]
        rows = spread(table.select(*used))
        files = as_files(rows, F.expr(part.repo), F.expr(part.path), F.expr(part.text))
        out = files if out is None else out.unionByName(files)
    return out
