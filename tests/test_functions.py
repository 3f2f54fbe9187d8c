"""Row fixtures for the column functions."""

import pytest
from pyspark.sql import functions as F

from codequarry.functions import ignore_rules as ig
from codequarry.functions import imports as im
from codequarry.functions import paths, text, tokens
from codequarry.functions.symbols import symbol_array


def values(spark, rows, schema, expression):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in frame.orderBy("i").select(expression).collect()]


def test_path_parts(spark):
    rows = [(".env",), ("b.test.ts",), ("a.d/README",), ("..foo",), ("a/b/c.py",)]
    assert values(spark, rows, "p string", paths.extension(F.col("p"))) == ["", ".ts", "", ".foo", ".py"]
    assert values(spark, rows, "p string", paths.dirname(F.col("p"))) == [".", ".", "a.d", ".", "a/b"]
    assert values(spark, rows[-1:], "p string", paths.ancestors(F.col("p"))) == [["a", "a/b"]]
    assert values(spark, rows[-1:], "p string", paths.path_suffixes(F.col("p"))) == [["c.py", "b/c.py", "a/b/c.py"]]


def test_normalize_and_escape(spark):
    rows = [("src/tools/.././utils//x.js",), ("a/b/",), ("./",), ("../x",), ("a/../../x",), ("..foo",), ("/etc",),
            ("..\\x",)]
    assert values(spark, rows, "p string", paths.normalize(F.col("p")))[:5] == [
        "src/utils/x.js", "a/b/", "./", "../x", "../x"]
    assert values(spark, rows, "p string", paths.escapes_root(F.col("p"))) == [
        False, False, False, True, True, False, True, True]


def test_sensitive(spark):
    secret = [".env", ".env.production", "server.key", "id_rsa", "credentials.json", "secrets.json",
              "service_account.json", ".npmrc", ".pypirc", "keys.kdbx", "keystore.jks", "x/.KEY", "a/.kube/config",
              "h/.aws/credentials", "A/ID_RSA", "my.id_rsa"]
    plain = ["index.ts", "package.json", "x.keys", "a/.Kube/config", "env", "my_id_rsa", ".envrc"]
    got = values(spark, [(p,) for p in secret + plain], "p string", paths.is_sensitive(F.col("p")))
    assert got == [True] * len(secret) + [False] * len(plain)


def test_binary_sniff_and_decoding(spark):
    rows = [(bytearray(b"x" * 511 + b"\0"),), (bytearray(b"x" * 512 + b"\0"),), (bytearray(b"\x50\x05"),),
            (bytearray(b"\xff\xfea"),)]
    assert values(spark, rows, "c binary", text.has_nul(F.col("c"))) == [True, False, False, False]
    assert values(spark, rows, "c binary", text.decode_utf8(F.col("c")))[3] == "��a"


def test_text_helpers(spark):
    rows = [("﻿  a\tb 　\n",), ("x" * 201,), ("",)]
    assert values(spark, rows, "t string", text.js_trim(F.col("t")))[0] == "a\tb"
    assert values(spark, rows, "t string", text.truncate(F.col("t"), 200))[1] == "x" * 200 + "..."
    assert values(spark, rows, "t string", text.line_count(F.col("t"))) == [2, 1, 1]


def test_replace_is_literal(spark):
    rows = [("aXbXc", "X", "$&$$"), ("abc", "q", "z"), ("aaaa", "aa", "b"), ("é1é", "1", "ü")]
    first = text.replace_first(F.col("t"), F.col("a"), F.col("b"))
    assert values(spark, rows, "t string, a string, b string", first) == ["a$&$$bXc", "abc", "baa", "éüé"]
    count = text.occurrences(F.col("t"), F.col("a"))
    assert values(spark, rows, "t string, a string, b string", count) == [2, 0, 2, 1]


def test_tokens(spark):
    rows = [("the cat_sat the\tx Cat. The",), ("",), ("...",)]
    assert values(spark, rows, "t string", tokens.tokens(F.col("t"))) == [
        ["the", "cat", "sat", "the\tx", "cat", "the"], [], []]
    counts = values(spark, rows, "t string", tokens.term_counts(tokens.tokens(F.col("t"))))
    assert [tuple(c) for c in counts[0]] == [("cat", 2), ("sat", 1), ("the", 2), ("the\tx", 1)]
    assert counts[1:] == [[], []]
    # raw tokens: the cat sat the\tx Cat The, and "" / "" / two sides of "..." are both ""
    assert values(spark, rows, "t string", tokens.field_length(F.col("t"))) == [6, 1, 1]


SYMBOLS = [
    (".ts", "export abstract class A<T> {", ("class", "export abstract class A<T>")),
    (".ts", "export default async function *gen(a) {", ("function", "export default async function *gen(a)")),
    (".js", "const f = async x => x", ("function", "const f = async x => x")),
    (".ts", "  getUser(id: string): Promise<U> { return 1 }", ("method", "getUser(id: string): Promise<U>")),
    (".ts", "  format(a) {", ("method", "format(a)")),
    (".ts", "  for (const a of b) {", None),
    (".ts", "  public async foo() {", None),
    (".ts", "// class A {", None),
    (".ts", "let a = 1;", None),
    (".py", "class A(B):", ("class", "class A(B)")),
    (".py", "  class Inner:", None),
    (".py", "async def f(x):", ("function", "async def f(x)")),
    (".py", "    def g(self):", ("method", "def g(self)")),
    (".go", "func (w *W) Name() string {", ("method", "func (w *W) Name() string")),
    (".go", "func New(a int) *W {", ("function", "func New(a int) *W")),
    (".go", "type W struct {", ("struct", "type W struct")),
    (".rs", "pub(crate) async fn load(x: u8) {", ("fn", "pub(crate) async fn load(x: u8)")),
    (".rs", "let x = 1;", None),
    (".java", "class Foo {", ("class", "class Foo")),
    (".java", "public final class Bar {", ("class", "public final class Bar")),
    (".kt", "enum class E {", ("enum class", "enum class E")),
    (".java", "private static int count(int a) {", None),
    (".java", "static int count(int a) {", ("function", "static int count(int a)")),
    (".java", "else if (x) {", None),
    (".md", "## Two  ", ("h2", "## Two")),
    (".markdown", "# One", ("h1", "# One")),
    (".md", "####### seven", None),
    (".txt", "class A {", None),
]


def test_symbols(spark):
    got = values(spark, [(e, line) for e, line, _ in SYMBOLS], "e string, t string",
                 symbol_array(F.col("t"), F.col("e")))
    found = [(s[0]["kind"], s[0]["signature"]) if s else None for s in got]
    for (ext, line, want), have in zip(SYMBOLS, found):
        assert have == want, (ext, line)


IMPORTS = [
    (".ts", 'import { a } from "./x.js";', "./x.js"),
    (".ts", "import './side.css'", "./side.css"),
    (".ts", 'export * from "../y"', "../y"),
    (".js", "const a = require( 'q' )", "q"),
    (".js", 'await import("./dyn")', "./dyn"),
    (".ts", '} from "./multi"', None),
    (".ts", '// import "./no"', None),
    (".py", "from ..m import x", "..m"),
    (".py", "import a.b as c", "a.b"),
    (".py", "from . import x", "."),
    (".go", 'import "fmt"', None),
]


def test_specifiers(spark):
    got = values(spark, [(e, line) for e, line, _ in IMPORTS], "e string, t string",
                 im.import_array(F.col("t"), F.col("e")))
    assert [g[0]["specifier"] if g else None for g in got] == [want for *_, want in IMPORTS]


def test_resolution(spark):
    rows = [("src/a/b.ts", "./x.js"), ("src/a/b.py", ".m"), ("src/a/b.py", "..m.n"), ("src/b.py", "."),
            ("src/a/b.ts", "fs"), ("src/a.ts", "/abs/q"), ("a/b.py", "...x"), ("a/b.ts", "../../c")]
    assert values(spark, rows, "f string, s string", im.resolve_import(F.col("f"), F.col("s"))) == [
        "src/a/x.js", "src/a/m", "src/m.n", "src/", None, "src/abs/q", "../x", "../c"]


@pytest.mark.parametrize("patterns, cases", [
    ((), {"node_modules/foo.js": True, ".git/config": True, ".env": True, "src/index.ts": False,
          "a/DIST/x": True, "distx/a": False, "a.PEM": True}),
    (("*.log", "/top", "dir/", "**/x", "!keep.log"), {
        "a/b.log": True, "a/keep.log": False, "top/a": True, "a/top": False, "dir/a": True, "dir": False,
        "a/b/x": True, "x": True}),
    (("!dist",), {"dist/a.js": False, "build/a.js": True}),
    (("# note", "", "\\#odd", "a/**", "!a/b", "q?.[ch]", "end "), {
        "#odd": True, "a/c": True, "a/b": False, "q1.c": True, "q12.c": False, "q1.d": False, "end": True}),
    (("docs/", "!docs/keep.md"), {"docs/keep.md": True}),
    (("a/**/b",), {"a/b": True, "a/x/y/b": True, "c/a/b": False}),
])
def test_ignore(spark, patterns, cases):
    got = values(spark, [(p,) for p in cases], "p string", ig.is_ignored(F.col("p"), patterns=patterns))
    assert dict(zip(cases, got)) == cases
