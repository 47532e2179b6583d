"""Modules with many broken statements."""

from __future__ import annotations

import time

from lakewright.code import extract


def test_many_broken_statements():
    source = "import first\n" + "".join(f'print "{i}"\n\ndef f{i}(x): ...\n' for i in range(200)) + "import last\n"
    got = extract.extract("m", source)
    assert [s["name"] for s in got["symbols"]] == [f"f{i}" for i in range(200)]
    assert got["parse_errors"] == 200 and [i["source"] for i in got["imports"]] == ["first", "last"]


def test_statements_that_no_line_is_named_for():
    source = 'import a\n\n@dec\ndef f(x: int = 1): ...\n\nbad = "\0"\n\nclass C:\n    y = 2\n\ntry:\n    import b\nexcept ImportError:\n    b = None\n'
    got = extract.extract("m", source)
    assert [s["path"] for s in got["symbols"]] == ["m.f", "m.C", "m.C.y", "m.b"]
    assert got["symbols"][0]["signature"] == "def f(x: int = 1)" and got["parse_errors"] == 1 and [i["source"] for i in got["imports"]] == ["a", "b"]
    deep = "x = 1\ny = " + "(" * 5000 + "1" + ")" * 5000 + "\nz = 2\n"
    got = extract.extract("m", deep)
    assert [s["name"] for s in got["symbols"]] == ["x", "z"] and got["parse_errors"] == 1
    assert extract.extract("m", "")["parse_errors"] == 0 and extract.extract("m", "\0")["parse_errors"] == 1


def test_recovery_is_linear():
    """Broken functions between good ones, Python 2 prints, and a module that opens brackets and strings at the margin."""
    source = "".join(f"def good{i}(a):\n    return a\n\ndef bad{i}(:\n    pass\n\nprint 'x{i}'\n\n" for i in range(4000))
    began = time.process_time()
    tree, lost = extract.parse(source)
    assert time.process_time() - began < 5
    assert [f.name for f in tree.body if hasattr(f, "name")] == [f"good{i}" for i in range(4000)] and lost == 8000
    assert tree.body[-3].lineno == 3999 * 8 + 1


def test_statements_that_go_on_at_the_margin():
    source = 'x = [\n1,\n2,\n]\ntext = """\nplain\ndef no(): pass\n"""\nprint "old"\n\ncall(\n"a",\n)\ny = 3\nopen_ = (1,\nz = 4\n@dec\ndef f(): ...\n'
    tree, lost = extract.parse(source)
    names = [getattr(n, "name", None) or (n.targets[0].id if hasattr(n, "targets") else type(n).__name__) for n in tree.body]
    assert names == ["x", "text", "Pass", "Expr", "y", "Pass", "z", "f"] and lost == 2
    assert [n.lineno for n in tree.body] == [1, 5, 9, 11, 14, 15, 16, 18]


def test_a_class_with_many_broken_methods():
    methods = "".join(f"    @dec\n    def good{i}(self):\n        return {i}\n\n    def bad{i}(self:\n        pass\n\n    print 'x'\n" for i in range(1500))
    source = f'import a\n\nclass C(Base):\n    """About C."""\n\n{methods}\n    class Inner:\n        y = 1\n\ndef after(): ...\nz = (\n'
    began = time.process_time()
    got = extract.extract("m", source)
    assert time.process_time() - began < 5
    names = [s["path"] for s in got["symbols"]]
    assert names[0] == "m.C" and [n for n in names if ".good" in n] == [f"m.C.good{i}" for i in range(1500)] and {"m.C.Inner.y", "m.after"} <= set(names)
    assert got["symbols"][0]["docstring"] == "About C." and got["parse_errors"] == 3001
    assert got["symbols"][1]["signature"] == "def good0()" and got["symbols"][1]["decorators"] == ["dec"]
