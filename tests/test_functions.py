"""Column functions on small cases."""

from __future__ import annotations

import sqlite3

from lakewright.code import docstrings, extract, types
from lakewright.functions import format as fmt
from lakewright.functions import names, requirements, text, urls, versions, wheels
from lakewright.functions.porter import stem
from lakewright.operators import changelog, diff, search, symbols
from lakewright.plans import contract
from pyspark.sql import functions as F


def column(spark, values, f, kind="string"):
    """f over one column of values, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("r")).collect()]


def test_sanitize(spark):
    cases = {"red NEAR blue": "red blue", 'half "open': "half open", "": "", "  x  ": "x", "a OR OR b": "a OR b", "OR x": "OR x", "a Or b": "a Or b", "a and b": "a b", "NOT": "NOT"}
    assert column(spark, list(cases), search.sanitize) == list(cases.values())
    assert [search.sanitize_text(q) for q in cases] == list(cases.values())


def test_versions(spark):
    pairs = [("5.2.0", "5.1.3", 1), ("5.1.3", "5.2.0", -1), ("5.2.0", "5.2.0", 0), ("10.0.0", "9.9.9", 1), ("1.0", "1.0.1", -1), ("1.0", "1", 0), ("1.0rc1", "1.0", 0), ("", "0", 0), ("x.2", "0.2", 0)]
    df = spark.createDataFrame(pairs, "a string, b string, want int")
    assert [r for r in df.select("*", versions.compare(F.col("a"), F.col("b")).alias("got")).collect() if r.got != r.want] == []


def test_requirements(spark):
    cases = {
        "kettle-valve (<7,>=3)": ("kettle-valve", "<7,>=3", None),
        'SteamPipe (!=0.4.1,>=0.2) ; extra == "boiler"': ("SteamPipe", "!=0.4.1,>=0.2", "boiler"),
        "pressure<8.12.0,>=8.9.5": ("pressure", "<8.12.0,>=8.9.5", None),
        "gauge~=4.0": ("gauge", "~=4.0", None),
        "whistle": ("whistle", "", None),
        "engine[coal]>=9": ("engine", ">=9", None),
        "pkg @ https://x/y#z": ("pkg", "https://x/y#z", None),
        'tender ; python_version < "3.9"': ("tender", "", None),
        "broken (>=1": ("broken", "", None),
    }
    got = column(spark, list(cases), requirements.requirement)
    assert [(r["name"], r["constraint"], r["extra"]) for r in got] == list(cases.values())


def test_maintainers(spark):
    cases = [
        ("", "Ines <ines@rails.test>, Olaf <olaf@rails.test>", None, None, [("Ines", "ines@rails.test"), ("Olaf", "olaf@rails.test")]),
        (None, "q@rails.test", None, None, [("", "q@rails.test")]),
        ("Uma", "u@rails.test", None, None, [("Uma", "u@rails.test")]),
        (None, "Vale, Rosa <rosa@rails.test>", None, None, [("Vale, Rosa", "rosa@rails.test")]),
        ("K, L; M", None, None, None, [("K", ""), ("L", ""), ("M", "")]),
        (None, None, None, "T <t@rails.test>", [("T", "t@rails.test")]),
        (None, None, "T", None, [("T", "")]),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, a string, ae string, m string, me string")
    got = [r.p for r in df.orderBy("i").select(requirements.maintainers(F.col("a"), F.col("ae"), F.col("m"), F.col("me")).alias("p")).collect()]
    assert [None if p is None else [tuple(x) for x in p] for p in got] == [c[4] for c in cases]


def test_wheels(spark):
    files = ["a-1-py3-none-any.whl", "a-1-cp39-cp39-manylinux2014_x86_64.whl", "a-1-1-cp39-cp39-macosx_11_0_universal2.whl", "a-1.tar.gz", "a-1-cp39-cp39-win_amd64.whl"]
    assert column(spark, files, wheels.platform_tag) == ["any", "manylinux2014_x86_64", "macosx_11_0_universal2", "", "win_amd64"]
    assert column(spark, files, wheels.module_format) == ["py3-none-any", "platform-specific", "platform-specific", None, "platform-specific"]


def test_format(spark):
    assert column(spark, [512, 1536, 1048576, 1280, 1331, 2**40 * 3], fmt.human_bytes, "bigint") == ["512 B", "1.5 KB", "1.0 MB", "1.2 KB", "1.3 KB", "3.0 TB"]
    assert column(spark, [45, 1234, 1500000, 712000000, 2500000000, 1250], fmt.human_count, "bigint") == ["45", "1.2K", "1M", "712M", "2.5B", "1.2K"]
    assert column(spark, ["x" * 28, "y" * 29], fmt.cell) == ["x" * 28, "y" * 27 + "…"]


def test_urls(spark):
    cases = ["https://x", "HTTP://x", "javascript:alert(1)", "java\tscript:x", "/a/b", ":x", "mailto:a@b", None, "data:image/png;base64,x", "a/b:c", "https://x\n", "\t https://x \r\n"]
    assert column(spark, cases, urls.is_link) == [True, True, False, False, True, False, True, False, False, True, True, True]
    assert column(spark, ["data:image/png;x", "data:image/svg+xml;x", "x.png"], urls.is_image) == [True, False, True]


def test_names(spark):
    assert column(spark, ["signal", "b..c", "-b", "b", "", "b_"], names.valid_name) == [True, False, False, True, False, False]
    assert column(spark, ["rail/yard/__init__.py", "hump.py", "rail/spur.pyi"], names.module_name) == ["rail.yard", "hump", "rail.spur"]
    assert column(spark, ["rail/test_hump.py", "rail/tests/spur.py", "tests/spur.py", "rail/hump.py", "rail/conftest.py"], names.is_test_module) == [True, True, False, False, True]


def test_porter_matches_fts5():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter ascii')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, row)")
    words = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer conformabli radically differentli vileli analogousli operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption communism activate angulariti homologous effective bowdlerize probate rate cease controll roll running requests flying dying".split()
    for w in words:
        con.execute("DELETE FROM t")
        con.execute("INSERT INTO t VALUES (?)", (w,))
        assert con.execute("SELECT term FROM v").fetchone()[0] == stem(w), w


def test_search(spark):
    rows = [("boilers", "Steam for Engines", 90), ("valve", "A tiny pressure regulator", 70), ("valve-spring", "Two Metal Coils for Valve", 8), ("boiler-plate", "Rolls boilers steel", 3), ("fébrile", "x", 0)]
    df = spark.createDataFrame(rows, "name string, summary string, downloads bigint")
    found = lambda q, **k: [r.name for r in search.search(df, q, **k).collect()]
    assert found("boilers") == ["boilers", "boiler-plate"]
    assert found("valve") == ["valve", "valve-spring"]
    assert found("tiny pressure") == ["valve"] and found("pressure tiny") == [] and found("tiny pre") == ["valve"] and found("tin pressure") == []
    assert found('"') == [] and found("febrile") == ["fébrile"] and found("") == []
    assert found("coils for va") == ["valve-spring"] and found("spring two") == []
    assert found("engine", stemmed=True) == ["boilers"]
    for q in ("boilers", "tiny pre", "pressure tiny", "va"):
        assert [r.name for r in search.search_postings(search.postings(df), df, q).collect()] == found(q)


def test_index_is_read_by_token(spark, tmp_path):
    """An index that was written sorted by token is read by filters that reach the scan."""
    df = spark.createDataFrame([("valve", "A tiny regulator", 7)], "name string, summary string, downloads bigint")
    search.write_postings(search.postings(df), str(tmp_path / "index"))
    found = search.search_postings(spark.read.parquet(str(tmp_path / "index")), df, "tiny reg")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,tiny)" in plan and "StringStartsWith(token,reg)" in plan and [r.name for r in found.collect()] == ["valve"]


def test_changelog(spark):
    md = "# Changelog\n\n## [Unreleased]\nsoon\n\n## [1.1.0] - 2023-06-20\n### Added\n- x\n\n## v1.0.0\nfirst\n"
    rst = "Version 2.0\n-----------\nReleased 2024-01-02\n\n- big\n\n1.9\n===\n\nold\n"
    df = spark.createDataFrame([("md", md), ("rst", rst), ("one", "## 1.0.0\nx"), ("none", None)], "k string, t string")
    got = {(r.k, r.ord): (r.version, r.tag_name, r.date, r.body) for r in changelog.parse(df, ["k"], "t").collect()}
    assert got == {
        ("md", 1): ("1.1.0", "1.1.0", "2023-06-20", "### Added\n- x"), ("md", 2): ("1.0.0", "v1.0.0", "", "first"),
        ("rst", 1): ("2.0", "2.0", "2024-01-02", "-----------\n\n- big"), ("rst", 2): ("1.9", "1.9", "", "===\n\nold"),
    }


def test_compare_names(spark):
    got = column(spark, ["Valve, boilers,valve", "", "b..c", ",", "p,q,r,s,t,u"], diff.parse_names)
    assert [(r["names"], r["problem"]) for r in got] == [
        (["valve", "boilers"], None), (None, "query parameter 'pkgs' is required"), (None, "invalid package name: b..c"), (None, "no valid package names provided"), (None, "too many packages, max 5"),
    ]


def test_docstrings():
    google = docstrings.parse("Do it.\n\n    Args:\n        x (int): the x\n            and more\n        *rest: others\n\n    Returns:\n        str: text\n\n    Raises:\n        ValueError: if bad\n    ")
    assert google["style"] == "google" and google["params"] == [("x", "int", "the x and more"), ("rest", "", "others")]
    assert google["returns"] == ("str", "text") and google["raises"] == [("ValueError", "if bad")]
    numpy = docstrings.parse("Sum.\n\n    Parameters\n    ----------\n    a, b : int, optional\n        numbers\n\n    Returns\n    -------\n    int\n        the sum\n    ")
    assert numpy["style"] == "numpy" and numpy["params"] == [("a", "int", "numbers"), ("b", "int", "numbers")] and numpy["returns"] == ("int", "the sum")
    sphinx = docstrings.parse("Go.\n\n:param int x: the x\n  goes on\n:param y: the y\n:type y: str\n:returns: all\n:rtype: list\n:raises KeyError: none\n")
    assert sphinx["style"] == "sphinx" and sphinx["params"] == [("x", "int", "the x goes on"), ("y", "str", "the y")] and sphinx["returns"] == ("list", "all") and sphinx["raises"] == [("KeyError", "none")]
    assert docstrings.parse("Plain.\n---\n")["style"] == "plain"
    assert docstrings.prose("Do it.\n\nArgs:\n    x: y\n\nAfter.") == "Do it.\n\nAfter."
    assert docstrings.first_paragraph("pkg.mod\n~~~~~~~\n\n.. note:: x\n   more\n\nThis says\nsomething.\n\nMore.") == "This says\nsomething."


def test_extract():
    got = extract.extract("m", '__all__ = ["a"]\n__all__.append("B")\n__all__ += base.__all__\n__all__.remove("a")\nfrom . import base\nfrom .x import *\nimport os.path as p\n\ntype V = int | None\n\n@dataclass\nclass B(Generic[T]):\n    n: int\n    c: ClassVar[int] = 1\n    _: KW_ONLY\n    k: str = field(default="q")\n    s: InitVar[int] = 0x1F\n\nif True:\n    def a(x, /, y: int = 1, *, z="s") -> None: ...\n\ndef broken(:\n    pass\n\nx, y = 1, 2\n')
    by = {s["path"]: s for s in got["symbols"]}
    assert got["exports"] == ["B"] and got["export_refs"] == ["base"] and got["parse_errors"] == 1
    assert by["m.a"]["signature"] == 'def a(x, /, y: int = 1, *, z="s") -> None'
    assert by["m.B.__init__"]["signature"] == 'def __init__(n: int, *, k: str = "q", s: int = 0x1F)'
    assert by["m.V"]["kind"] == "type_alias" and by["m.x"]["kind"] == "attribute" and by["m.B"]["bases"] == ["Generic[T]"]
    assert [(i["source"], i["level"], i["star"]) for i in got["imports"]] == [("", 1, False), ("x", 1, True), ("os.path", 0, False)]


def test_udtf(spark):
    extract.register(spark)
    got = spark.sql("SELECT path, kind FROM extract_symbols('m', 'def f(): ...')").collect()
    assert [tuple(r) for r in got] == [("m.f", "function")]


def test_collapse(spark):
    rows = [
        ("f", 1, "overload", "s0", None), ("f", 2, "overload", "s1", "first"), ("f", 3, "function", "s2", "doc"), ("f", 5, "function", "s3", None),
        ("g", 4, "overload", "t0", None), ("g", 6, "overload", "t1", "said"), ("h", 0, "function", "u0", None), ("h", 7, "function", "u1", None),
    ]
    df = spark.createDataFrame(rows, "name string, ord int, kind string, signature string, docstring string")
    got = {r.name: (r["ord"], r.signature, r.docstring, r.overloads) for r in symbols.collapse_functions(df, ["name"]).collect()}
    assert got == {"f": (1, "s2", "doc", ["s0", "s1"]), "g": (4, "t0", "said", ["t1"]), "h": (0, "u1", None, [])}


def test_collapse_attributes(spark):
    rows = [("x", 0, "attribute", "1", False, "int", None), ("x", 1, "attribute", "2", True, None, "text"), ("x", 2, "attribute", "3", False, None, None), ("p", 3, "property", None, False, "str", None), ("p", 4, "attribute", "4", False, None, "more"), ("i", 5, "attribute", "5", True, None, None), ("i", 6, "attribute", "6", True, None, None)]
    df = spark.createDataFrame(rows, "name string, ord int, kind string, value string, instance boolean, annotation string, docstring string")
    got = {r.name: (r.kind, r.value, r.instance, r.annotation, r.docstring, r["ord"]) for r in symbols.collapse_attributes(df, ["name"]).collect()}
    assert got == {"x": ("attribute", "3", False, "int", "text", 0), "p": ("property", None, False, "str", "more", 3), "i": ("attribute", "6", True, None, None, 5)}


def test_type_param(spark):
    assert column(spark, ["typing.TypeVar('T')", "NewType('U', int)", "make('x')", None], symbols.is_type_param) == [True, True, False, False]


def test_text(spark):
    assert column(spark, ["text/plain", "*/*", "", None, "text/plain;q=0.5, application/json;q=0.4", "text/*;q=2, application/json"], text.prefers_text) == [True, False, False, False, True, False]
    assert column(spark, [".. note:: x", "plain", None], text.looks_like_rst) == [True, False, False]
    row = spark.sql("SELECT DATE '2024-01-03' AS a, DATE '2024-02-01' AS b, DATE '2023-12-31' AS c")
    assert tuple(row.select(text.range_label(F.col("a"), F.col("b")), text.range_label(F.col("c"), F.col("b"))).first()) == ("Jan 3 – Feb 1, 2024", "Dec 31, 2023 – Feb 1, 2024")
    df = spark.createDataFrame([("x", "int", "1", False, False), ("y", "int", "", True, False)], "n string, a string, d string, p boolean, w boolean")
    assert [r[0] for r in df.select(text.attribute_signature(*[F.col(c) for c in "nadpw"])).collect()] == ["x: int = 1", "property y: int [read-only]"]


def test_types_and_contract(spark):
    assert types.classify("int | None | typing.List[str]") == {"kind": "union", "name": "Union", "args": ["int", "None", "typing.List[str]"]}
    assert types.classify("typing.Optional[int]")["kind"] == "optional" and types.classify("'Fwd'")["kind"] == "string" and types.classify("a b")["kind"] == "unknown"
    assert contract.json_schema(spark.createDataFrame([], "a bigint, b array<string>").schema) == {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "string"}}}, "required": []}
