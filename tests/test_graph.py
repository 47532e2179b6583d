"""Chains longer than sixteen steps, and cycles."""

from __future__ import annotations

from lakewright.operators import graph


def test_inherit_long_chain(spark):
    chain = [(i, "top" if i == 0 else "mid" if i == 40 else None) for i in range(75)]
    ring = [(100 + i, None) for i in range(3)] + [(110, None), (111, None), (112, "in a ring"), (120, None), (121, None)]
    nodes = spark.createDataFrame(chain + ring, "node long, init string")
    edges = [(i, i - 1) for i in range(1, 75)] + [(100, 101), (101, 102), (102, 100), (110, 111), (111, 112), (112, 110), (120, 100), (121, 999)]
    got = {r.node: r.init for r in graph.inherit(nodes, spark.createDataFrame(edges, "child long, parent long"), "init").collect()}
    want = {i: "mid" if i >= 40 else "top" for i in range(75)} | {100: None, 101: None, 102: None, 110: "in a ring", 111: "in a ring", 112: "in a ring", 120: None, 121: None}
    assert got == want


def test_star_names_long_chain(spark):
    exports = spark.createDataFrame([("m20", "x"), ("m0", "y")], "module string, name string")
    stars = spark.createDataFrame([(f"m{i}", f"m{i + 1}") for i in range(20)] + [("m20", "m0")], "module string, source string")
    got = {(r.module, r.name) for r in graph.star_names(exports, stars).collect()}
    assert got == {(f"m{i}", n) for i in range(21) for n in "xy"}


def _search(defs: dict, imports: list, stars: dict, module: str, name: str, seen: set, depth: int = 0):
    """A walk that tries one way after the other, as a reader of the source would."""
    if depth > 16 or (module, name) in seen:
        return None
    seen.add((module, name))
    if defs.get((module, name)) == graph.DEFINED:
        return module, name
    own = sorted((o, s, n, b) for m, b, s, n, o in imports if m == module and b is not None)
    for _, source, to, bound in own:
        if bound == name and (got := _search(defs, imports, stars, source, to, seen, depth + 1)):
            return got
    for _, source in sorted((o, s) for m, b, s, n, o in imports if m == module and b is None):
        if name in stars.get(source, ()) and (got := _search(defs, imports, stars, source, name, seen, depth + 1)):
            return got
    return (module, name) if (module, name) in defs else None


def _lookup(spark, defs, imports, stars, wanted):
    d = spark.createDataFrame([(*k, v) for k, v in defs.items()], "module string, name string, way int")
    i = spark.createDataFrame(imports, "module string, bound string, source string, name string, ord int")
    s = spark.createDataFrame([(m, n) for m, names in stars.items() for n in names], "module string, name string")
    got = graph.lookup(d, i, spark.createDataFrame(wanted, "module string, name string"), s).collect()
    return {(r.module, r.name): (r.def_module, r.def_name) for r in got}


def test_lookup_in_order(spark):
    """A first import that leads nowhere, an attribute behind an import, a list that a star import stays in, a listed private name."""
    defs = {("a", "X"): 0, ("t", "Y"): graph.ATTRIBUTE, ("x", "Y"): 0, ("s", "shown"): 0, ("s", "hidden"): 0, ("s", "_own"): 0, ("t", "Z"): graph.ATTRIBUTE}
    imports = [("p", "X", "z", "X", 1), ("p", "X", "a", "X", 2), ("t", "Y", "x", "Y", 1), ("t", "Z", "x", "none", 1), ("q", None, "s", None, 1)]
    wanted = [("p", "X"), ("t", "Y"), ("t", "Z"), ("q", "shown"), ("q", "hidden"), ("q", "_own")]
    got = _lookup(spark, defs, imports, {"s": ["shown", "_own"]}, wanted)
    assert got == {("p", "X"): ("a", "X"), ("t", "Y"): ("x", "Y"), ("t", "Z"): ("t", "Z"), ("q", "shown"): ("s", "shown"), ("q", "_own"): ("s", "_own")}


def test_lookup_random_graphs(spark):
    import random

    draw = random.Random(7)
    for _ in range(2):
        mods, names = [f"m{i}" for i in range(9)], ["a", "b", "_c"]
        defs = {(draw.choice(mods), draw.choice(names)): draw.choice([0, 3, 4, 4]) for _ in range(7)}
        imports = [(draw.choice(mods), *((None, draw.choice(mods), None) if draw.random() < 0.3 else (draw.choice(names), draw.choice(mods), draw.choice(names))), o) for o in range(40)]
        stars = {m: draw.sample(names, draw.randint(0, 3)) for m in mods}
        wanted = [(m, n) for m in mods for n in names]
        want = {w: f for w in wanted if (f := _search(defs, imports, stars, *w, set()))}
        assert _lookup(spark, defs, imports, stars, wanted) == want


def test_inherited_fields(spark):
    field = lambda n, v: {"name": n, "value": v}
    rows = [(i, [field(f"f{i % 6}", str(i)), field("x", f"x{i}")] if i % 3 else []) for i in range(45)]
    rows += [(100, [field("a", "1")]), (101, [field("b", "2"), field("b", "3")]), (102, []), (110, [field("c", "4")]), (111, []), (120, None)]
    edges = [(i, i - 1) for i in range(1, 45)] + [(101, 100), (102, 101), (100, 102), (110, 999), (111, 110), (120, None)]
    got = graph.inherited_fields(spark.createDataFrame(rows, "node long, fields array<struct<name:string,value:string>>"), spark.createDataFrame(edges, "child long, parent long"))
    got = {r.node: None if r.fields is None else [(f.name, f.value) for f in r.fields] for r in got.collect()}
    held: dict = {}
    for i, own in rows[:45]:
        held |= {f["name"]: f["value"] for f in own}
        assert got[i] == list(held.items())
    assert [got[k] for k in (100, 101, 102, 110, 111, 120)] == [None] * 6


def test_constructors(spark):
    schema = "node long, init string, dataclass boolean, fields array<struct<name:string,value:string>>"
    rows = [(1, None, True, [("a", "1")]), (2, None, False, None), (3, None, True, [("a", "3")]), (4, "own", None, None), (5, None, None, None), (6, None, True, None), (7, None, None, None)]
    edges = spark.createDataFrame([(2, 1), (3, 2), (5, 4), (6, 99), (7, 6)], "child long, parent long")
    got = {r.node: (r.origin, r.init, None if r.fields is None else [tuple(f) for f in r.fields]) for r in graph.constructors(spark.createDataFrame(rows, schema), edges).collect()}
    fine = [("a", "3")]
    assert got == {1: (1, None, [("a", "1")]), 2: (1, None, [("a", "1")]), 3: (3, None, fine), 4: (4, "own", None), 5: (4, "own", None), 6: (6, None, None), 7: (6, None, None)}


def test_publish_takes_the_import_that_leads_somewhere(spark):
    """A package that imports X from a module without it, then from the one that has it, publishes X; a name that is an attribute at home is imported first."""
    from lakewright.operators import exports

    modules = spark.createDataFrame([("p", True, False, False), ("p._z", False, False, False), ("p._a", False, False, False)], "module string, public boolean, listed boolean, partial boolean")
    definitions = spark.createDataFrame([("p._a", "X", True, 0), ("p._z", "Y", True, 0), ("p", "Y", True, graph.ATTRIBUTE)], "module string, name string, public boolean, way int")
    rows = [("p", "X", "p._z", "X", False, True, 1), ("p", "X", "p._a", "X", False, True, 2), ("p", "Y", "p._z", "Y", False, True, 3)]
    imports = spark.createDataFrame(rows, "module string, bound string, source string, name string, explicit boolean, exported boolean, ord int")
    none = spark.createDataFrame([], "module string, name string")
    refs = spark.createDataFrame([], "module string, source string")
    tables = {"modules": modules, "names": none, "refs": refs, "definitions": definitions, "imports": imports}
    listed = exports.export_names(**tables)
    got = exports.publish(modules, listed, exports.settle(modules, listed, definitions, refs), imports, exports.star_sets(**tables)).collect()
    assert ("p", "X", "copy", "p._a.X") in {tuple(r) for r in got}
