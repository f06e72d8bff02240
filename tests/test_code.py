"""Golden code map and extraction."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import extract as X
from shelfspark.plans.explore import explore

# path, line, name, kind, exported, doc
SYMBOLS = [
    ("list.js", 4, "listJars", "function", True, "List the jars. Mentions kilnbrick once."),
    ("pantry/jar/jar.go", 5, "Seal", "function", True, "Seal closes a jar.\nThe stamp is brimstone wax."),
    ("pantry/jar/jar.go", 9, "sealNote", "function", False, ""),
    ("pantry/jar/jar.go", 13, "cool", "function", False, ""),
    ("pantry/shelf/shelf.go", 6, "Place", "function", True, "Place sets a jar on the shelf."),
    ("web/format.js", 2, "formatOunces", "function", True, ""),
    ("python/label.py", 1, "print_label", "function", True, "Print it on cedarwood."),
    ("rust/src/lib.rs", 2, "weigh_crate", "function", True, "Weigh a crate. The mark is unique-token-alpha."),
    ("rust/src/lib.rs", 6, "mark_crate", "function", False, ""),
]
EDGES = [
    ("list.js", '{ formatOunces } from "./web/format.js";'), ("pantry/shelf/shelf.go", "example.com/pantry/jar"), ("src/pantry.gleam", "gleam/io"),
]
COMMITS = [
    ("4a7dc663", "fix the wax stamp on the jar", 18), ("aaaa0001", "leave unique-token-beta in the notes", 15),
    ("aaaa0002", "stamp unique-token-alpha on the label", 8), ("e3cea18b", "add the pantry jar and shelf", 1),
]
CASES = {
    "seal": (["Seal", "sealNote"], [], ["pantry/shelf/shelf.go"], []),
    "brimstone": (["Seal"], [], ["pantry/shelf/shelf.go"], []),
    "formatOunces": (["formatOunces"], [], ["list.js"], []),
    "cedarwood": (["print_label"], [], [], []),
    "unique-token-alpha": (["weigh_crate"], [], [], ["aaaa0002"]),
    "unique-token-beta": ([], [], [], ["aaaa0001"]),
    "wax stamp notes": (["Seal"], [], ["pantry/shelf/shelf.go"], ["4a7dc663"]),
    "jar": (["listJars", "Seal", "Place", "sealNote", "cool"], ["list.js", "pantry/shelf/shelf.go"], ["pantry/shelf/shelf.go"], ["4a7dc663", "e3cea18b"]),
    "mark_crate": (["mark_crate", "weigh_crate"], [], [], []),
    "cool": (["cool"], [], ["pantry/shelf/shelf.go"], []),
    "  ": ([], [], [], []),
}


def test_golden_map(spark):
    symbols = spark.createDataFrame(
        [("", p, i, n, k, line, d, e) for i, (p, line, n, k, e, d) in enumerate(SYMBOLS)],
        "checkout string, file_path string, seq int, name string, kind string, line int, doc string, exported boolean",
    )
    # package names would add path hits, so they stay empty
    files = spark.createDataFrame([("", p, "") for p in {s[0] for s in SYMBOLS}], "checkout string, path string, package_name string")
    edges = spark.createDataFrame([("", a, b, "import") for a, b in EDGES], "checkout string, from_file string, to_path string, edge_type string")
    commits = spark.createDataFrame(
        [("", h, s, "", dt.datetime(2026, 10, d)) for h, s, d in COMMITS], "checkout string, hash string, subject string, body string, authored_at timestamp"
    )
    queries = spark.createDataFrame([(q, "", q) for q in CASES], "query_id string, checkout string, text string")
    out = {k: v.collect() for k, v in explore(symbols, files, edges, commits, queries).items()}

    def column(section, query, name):
        return [r[name] for r in sorted((r for r in out[section] if r.query_id == query), key=lambda r: r["rank"])]

    for query, (names, imports, importers, hashes) in CASES.items():
        assert column("symbols", query, "name") == names, query
        assert column("imports", query, "from_file") == imports, query
        assert column("importers", query, "from_file") == importers, query
        assert column("commits", query, "hash") == hashes, query


GO_LIKE = """import "fmt"
use crate::thing;

// Adds one.
// Second line.
pub fn add(a) {
}
# type of thing
class of Things
@decorator

/* Block
 * text */
export default async function Run() {}
def plain():
    '''Doc here.
    More.'''
type Shape struct
"""


def files(spark, **content):
    rows = [("", k.replace("__", "/").replace("_", "."), v) for k, v in content.items()]
    return spark.createDataFrame(rows, "checkout string, path string, content string")


def test_generic_extraction(spark):
    symbols, edges = X.extract(files(spark, src__a_zig=GO_LIKE, notes_md=GO_LIKE))
    got = [(r.name, r.kind, r.line, r.exported, r.doc) for r in symbols.orderBy("line").collect()]
    assert got == [
        ("add", "function", 6, True, "Adds one.\nSecond line."), ("Run", "function", 14, True, "Block\ntext"),
        ("plain", "function", 15, False, "Doc here.\nMore."), ("Shape", "type", 18, True, ""),
    ]
    assert [r.to_path for r in edges.collect()] == ["fmt", "crate::thing"]


GLEAM = """import gleam/io

/// A bin.
pub type Bin {
  Full(Int)
  Empty
}

pub const size = 3

pub fn note_bin(b) {
  fn_inner
}

fn hidden() { 1 }
type Alias = Int
"""


def test_gleam_plug_in(spark):
    symbols, edges = X.extract(files(spark, src__p_gleam=GLEAM))
    got = [(r.name, r.kind, r.exported) for r in symbols.orderBy("seq").collect()]
    assert got == [
        ("Bin", "type", True), ("Full", "constructor", True), ("Empty", "constructor", True), ("size", "constant", True),
        ("note_bin", "function", True), ("hidden", "function", False), ("Alias", "type", False),
    ]
    assert symbols.where("name = 'Bin'").first()["doc"] == "A bin."
    assert [r.to_path for r in edges.collect()] == ["gleam/io"]


def test_empty_plug_in_falls_back(spark):
    symbols, _ = X.extract(files(spark, a_zz="pub fn x()"), {".zz": lambda path, content: ([], [])})
    assert [r.name for r in symbols.collect()] == ["x"]


@pytest.mark.parametrize("lines,line,want", [
    (["// far"] + [""] * 8 + ["fn x"], 10, ""), (["# one", "fn x"], 2, "one"), (["code", "fn x"], 2, ""),
    (["/* a", " * b */", "fn x"], 3, "a\nb"), (["b */", "fn x"], 2, ""), (["// x"] * 40 + ["fn x"], 41, "\n".join(["x"] * 24)),
])
def test_comment_above(spark, lines, line, want):
    df = spark.createDataFrame([("\n".join(lines), [line])], "content string, at array<int>")
    assert df.select(X.docs_at(F.col("content"), F.col("at"))).first()[0] == [want]


def test_docstring_below(spark):
    content = 'def a():\n\n    """One.\n\n    Two. """\n@x\ndef b():\n    pass\n# c\n\n@y\ndef c():\n    \'\'\'no\'\'\'\n'
    df = spark.createDataFrame([(content, [1, 7, 12])], "content string, at array<int>")
    assert df.select(X.docs_at(F.col("content"), F.col("at"))).first()[0] == ["One.\nTwo.", "", "c"]


def test_scan_stays_in_the_jvm(spark):
    plan = X.generic_edges(files(spark, a_zig=GO_LIKE))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_binary_and_line_numbers(spark):
    from shelfspark.functions import paths as P

    df = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"a\x00b"),), (bytearray(b"\xff\xfe"),), (bytearray(b""),)], "c binary")
    assert [r.b for r in df.select(P.is_binary_content(F.col("c")).alias("b")).collect()] == [False, True, True, False]


def test_explore_searches_symbols_once(spark, monkeypatch):
    from shelfspark.plans import explore as plan

    symbols = spark.createDataFrame([("", "src/a.py", 1, "load", "def", 1, "load it", True)],
                                    "checkout string, file_path string, seq int, name string, kind string, line int, doc string, exported boolean")
    files = spark.createDataFrame([("", "src/a.py", "pkg")], "checkout string, path string, package_name string")
    edges = spark.createDataFrame([("", f"src/{c}.py", "lib/load", "import") for c in "abb"], "checkout string, from_file string, to_path string, edge_type string")
    commits = spark.createDataFrame([], "checkout string, hash string, authored_at timestamp, subject string, body string")
    asked = spark.createDataFrame([(1, "", "load")], "query_id int, checkout string, text string")
    cut = []
    monkeypatch.setattr(plan, "cut_lineage", lambda df: cut.append(df) or df.localCheckpoint())
    out = plan.explore(symbols, files, edges, commits, asked)
    assert len(cut) == 2 and [r.file_path for r in out["symbols"].collect()] == ["src/a.py"]
    assert [(r.from_file, r.to_path, r["rank"]) for r in out["importers"].orderBy("rank").collect()] == [("src/a.py", "lib/load", 1), ("src/b.py", "lib/load", 2)]
