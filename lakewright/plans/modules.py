"""Queries over generated modules: collapsed definitions, exports, stubs, content, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..code import docstrings, types
from ..operators import exports, fuzzy, graph, symbols, text_sinks
from ..shared import spread
from .catalog import query, read


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _pick(values: list[str | None], index: Column) -> Column:
    """The value at a place that a column tells, modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def _sql_list(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_pick(values: list[str | None], index: str) -> str:
    return f"{_sql_list(values)}[({index}) % {len(values)} + 1]"


# --- definitions of one name ----------------------------------------------------------------------

_FUNCTIONS = """d AS (SELECT p_partkey // 5 AS name, p_partkey AS ord, CASE WHEN p_size % 3 = 0 THEN 'overload' ELSE 'function' END AS kind, 's' || p_partkey AS signature, CASE WHEN p_size % 4 = 0 THEN p_name END AS docstring FROM part)"""


@query(f"""
WITH {_FUNCTIONS}, p AS (
  SELECT *, min(ord) OVER (PARTITION BY name) AS first, row_number() OVER (PARTITION BY name ORDER BY kind = 'overload', CASE WHEN kind <> 'overload' AND docstring IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN kind = 'overload' THEN ord ELSE -ord END) AS r FROM d)
SELECT name, first AS ord, signature, coalesce(docstring, (SELECT arg_min(d.docstring, d.ord) FROM d WHERE d.name = p.name AND d.kind = 'overload' AND d.ord <> p.ord AND d.docstring IS NOT NULL)) AS docstring,
  coalesce((SELECT string_agg(d.signature, ',' ORDER BY d.ord) FROM d WHERE d.name = p.name AND d.kind = 'overload' AND d.ord <> p.ord), '') AS overloads
FROM p WHERE r = 1""")
def collapse_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11: five definitions a name, implementations, overloads and docstrings among them at random."""
    rows = read(spark, sf_dir, "part").select(
        F.expr("p_partkey div 5").alias("name"), F.col("p_partkey").alias("ord"), F.when(F.col("p_size") % 3 == 0, "overload").otherwise("function").alias("kind"),
        F.concat(F.lit("s"), _s("p_partkey")).alias("signature"), F.when(F.col("p_size") % 4 == 0, F.col("p_name")).alias("docstring"),
    )
    return symbols.collapse_functions(rows, ["name"]).select("name", "ord", "signature", "docstring", F.array_join("overloads", ",").alias("overloads"))


@query("""
WITH RECURSIVE d AS (
  SELECT p_partkey // 6 AS name, p_partkey AS ord, CASE WHEN p_size % 4 = 0 THEN 'property' ELSE 'attribute' END AS kind, 'v' || p_partkey AS value, p_size % 4 = 1 AS instance,
    CASE WHEN p_size % 3 = 0 THEN p_brand END AS annotation, CASE WHEN p_size % 5 = 0 THEN p_type END AS docstring, row_number() OVER (PARTITION BY p_partkey // 6 ORDER BY p_partkey) AS r FROM part),
f AS (
  SELECT name, r, kind, value, instance, annotation, docstring, ord FROM d WHERE r = 1
  UNION ALL SELECT name, r, CASE WHEN stays THEN k0 ELSE kind END, CASE WHEN stays THEN v0 ELSE value END, CASE WHEN stays THEN i0 ELSE instance END,
    CASE WHEN stays THEN coalesce(a0, annotation) ELSE coalesce(annotation, a0) END, CASE WHEN stays THEN coalesce(d0, docstring) ELSE coalesce(docstring, d0) END, ord
  FROM (SELECT d.name, d.r, d.kind, d.value, d.instance, d.annotation, d.docstring, f.ord, f.kind AS k0, f.value AS v0, f.instance AS i0, f.annotation AS a0, f.docstring AS d0,
      (f.kind = 'property' AND d.kind <> 'property') OR (d.instance AND NOT f.instance) AS stays FROM f JOIN d ON d.name = f.name AND d.r = f.r + 1))
SELECT name, kind, value, instance, annotation, docstring, ord FROM f QUALIFY row_number() OVER (PARTITION BY name ORDER BY r DESC) = 1""")
def collapse_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13: six definitions a name, properties, instance attributes, types and texts among them at random."""
    size = F.col("p_size")
    rows = read(spark, sf_dir, "part").select(
        F.expr("p_partkey div 6").alias("name"), F.col("p_partkey").alias("ord"), F.when(size % 4 == 0, "property").otherwise("attribute").alias("kind"), F.concat(F.lit("v"), _s("p_partkey")).alias("value"),
        (size % 4 == 1).alias("instance"), F.when(size % 3 == 0, F.col("p_brand")).alias("annotation"), F.when(size % 5 == 0, F.col("p_type")).alias("docstring"),
    )
    return symbols.collapse_attributes(rows, ["name"])


_BASES = ["object", "ABC", "abc.ABC", "Protocol", "Generic[T]", "typing.Protocol[T]", "typing_extensions.Protocol", "mylib.Protocol", "typing.abc.ABC", "Base", "typing.Generic[K, V]", "abc.Protocol", "other.ABC", "objects"]


@query(f"""
SELECT p_partkey, regexp_replace(regexp_replace(split_part({_sql_pick(_BASES, "p_partkey")}, '[', 1), '^typing\\.', ''), '^typing_extensions\\.', '') IN ('object', 'ABC', 'abc.ABC', 'Protocol', 'Generic') AS inert FROM part""")
def inert_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-26: bases with and without module prefixes."""
    return read(spark, sf_dir, "part").select("p_partkey", symbols.is_inert_base(_pick(_BASES, F.col("p_partkey"))).alias("inert"))


_OWN = ["typing.final", "cache", "a.b.trace(1)", "staticmethod"]
_MORE = ["final", "functools.cache", "trace", "classmethod", "x.final(2)"]


@query(f"""
WITH d AS (SELECT p_partkey, unnest([1, 2, 3, 4]) AS ord, unnest([{_sql_pick(_OWN, "p_partkey")}, {_sql_pick(_OWN, "p_size")}, {_sql_pick(_MORE, "p_partkey")}, {_sql_pick(_MORE, "p_size + 1")}]) AS dec FROM part),
n AS (SELECT *, regexp_extract(split_part(dec, '(', 1), '([^.]*)$', 1) AS bare, ord <= 2 AS own FROM d)
SELECT p_partkey, string_agg(dec, ',' ORDER BY ord) AS decorators FROM n a WHERE own OR NOT EXISTS (SELECT 1 FROM n b WHERE b.p_partkey = a.p_partkey AND b.ord < a.ord AND b.bare = a.bare) GROUP BY 1""")
def decorator_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-06: decorators of source and stub, those of a name that is there left out."""
    k, size = F.col("p_partkey"), F.col("p_size")
    own, more = F.array(_pick(_OWN, k), _pick(_OWN, size)), F.array(_pick(_MORE, k), _pick(_MORE, size + 1))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(symbols.joined_decorators(own, more), ",").alias("decorators"))


# --- exports --------------------------------------------------------------------------------------

#: Ten shapes of a package: which modules have lists (complete or not), what these name and refer to, and imports as (module, bound, source, name, explicit, exported).
LISTED = [(2, "", False), (3, "", True), (4, "", False), (4, "._core", False)]
NAMED = [(2, "", "f"), (3, "", "g"), (4, "._core", "f")]
REFERRED = [(4, "", "._core")]
IMPORTED = [
    (0, "", "f", "._core", "f", False, True), (1, "", None, "._core", None, False, True), (2, "", "f", "._core", "f", False, True), (2, "", "g", "._core", "g", False, True), (3, "", "f", "._core", "f", False, True),
    (3, "", "g", "._core", "g", False, True), (4, "", None, "._core", None, False, True), (5, "", "a", ".api", "a", False, True), (5, "", "f", "._core", "f", True, True), (6, "", "a", ".api", "a", True, True),
    (7, ".api", "ff", "._core", "f", False, True), (7, "", "f", "._core", "f", False, True), (8, "", None, "._core", None, False, True), (8, ".api", None, "._core", None, False, True), (8, "._core", None, "._extra", None, False, True),
    (9, "", "x", "._missing", "x", False, True), (9, "", "f", "._core", "f", False, False),
]
DEFINED = [("", "top"), ("._core", "f"), ("._core", "g"), ("._core", "_h"), ("._extra", "e"), (".api", "a"), (".api", "_b")]
OPEN = {"": True, "._core": False, ".api": True, "._extra": False}
#: What the shapes publish by the rules, as (shape, module, name, kind, target).
PUBLISHED = [
    (0, "", "f", "copy", "._core.f"), (1, "", "f", "copy", "._core.f"), (1, "", "g", "copy", "._core.g"), (2, "", "f", "copy", "._core.f"), (3, "", "g", "copy", "._core.g"), (3, "", "f", "copy", "._core.f"),
    (4, "", "f", "copy", "._core.f"), (5, "", "f", "copy", "._core.f"), (6, "", "a", "alias", ".api.a"), (7, "", "f", "copy", "._core.f"), (7, ".api", "ff", "alias", ".f"),
    *[(8, "", n, "copy", t) for n, t in (("f", "._core.f"), ("g", "._core.g"), ("e", "._extra.e"))], *[(8, ".api", n, "alias", f".{n}") for n in "fge"],
]


def _package_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of one package of four modules for each part, of the shape that its key's last digit tells."""
    parts = spread(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.concat(F.lit("p"), _s("p_partkey")).alias("p"), (F.col("p_partkey") % 10).cast("int").alias("shape"))

    def each(rows: list[tuple], schema: str, paths: tuple[str, ...], by_shape: bool = True) -> DataFrame:
        few = F.broadcast(spark.createDataFrame(rows, schema))  # a fixed number of rows
        out = parts.join(few, "shape") if by_shape else parts.join(few.withColumn("one", F.lit(1)), F.col("one") == F.least(F.lit(1), F.col("shape") + 1))
        return out.select(*[F.concat("p", c).alias(c) if c in paths else F.col(c) for c in few.columns if c != "shape"])

    listed = each(LISTED, "shape int, module string, partial boolean", ("module",))
    modules = each([(m, o) for m, o in OPEN.items()], "module string, public boolean", ("module",), False).join(listed, "module", "left")
    modules = modules.select("module", "public", F.col("partial").isNotNull().alias("listed"), F.coalesce("partial", F.lit(False)).alias("partial"))
    names = each(NAMED, "shape int, module string, name string", ("module",))
    refs = each(REFERRED, "shape int, module string, source string", ("module", "source"))
    defined = each(DEFINED, "module string, name string", ("module",), False).join(modules.select("module", "listed"), "module")
    defined = defined.join(names.withColumn("in_list", F.lit(True)), ["module", "name"], "left")
    definitions = defined.select("module", "name", F.when(F.col("listed"), F.coalesce("in_list", F.lit(False))).otherwise(~F.col("name").startswith("_")).alias("public"))
    imports = each(IMPORTED, "shape int, module string, bound string, source string, name string, explicit boolean, exported boolean", ("module", "source"))
    return {"modules": modules, "names": names, "refs": refs, "definitions": definitions, "imports": imports}


def _settled(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = _package_tables(spark, sf_dir)
    stars = exports.star_sets(**t)
    names = exports.export_names(**t, stars=stars)
    return t | {"stars": stars, "exports": names, "settled": exports.settle(t["modules"], names, t["definitions"], t["refs"])}


def _published(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    t = _settled(spark, sf_dir)
    return exports.publish(t["modules"], t["exports"], t["settled"], t["imports"], t["stars"]), t


_EXPECTED = ", ".join(str(x) for x in PUBLISHED)
_PUBLISHED = f"published AS (SELECT 'p' || p_partkey || m AS module, name, kind, 'p' || p_partkey || t AS target FROM part JOIN (VALUES {_EXPECTED}) v(shape, m, name, kind, t) ON p_partkey % 10 = shape)"


@query(f"WITH {_PUBLISHED} SELECT * FROM published")
def export_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-03, GRF-04, GRF-05: what ten shapes of packages publish: by lists, partial lists, references, stars, renames and marked imports."""
    return _published(spark, sf_dir)[0]


@query("""
SELECT 'p' || p_partkey || m AS module, name, m IN ('', '.api') AND NOT starts_with(name, '_') AND NOT (name = 'top' AND p_partkey % 10 IN (2, 4)) AS published
FROM part, (VALUES ('', 'top'), ('._core', 'f'), ('._core', 'g'), ('._core', '_h'), ('._extra', 'e'), ('.api', 'a'), ('.api', '_b')) d(m, name)""")
def settled_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-04: which definitions are public where they stand; a complete list without them hides them."""
    return _settled(spark, sf_dir)["settled"].select("module", "name", "published")


@query("""
SELECT 'p' || p_partkey AS module, name, CASE WHEN name = 'f' AND p_partkey % 10 <> 6 THEN 'p' || p_partkey || '._core.f' END AS target FROM part, (VALUES ('f'), ('zz')) s(name)""")
def stub_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-06: stub definitions whose import leads somewhere give their types to it, the others join the module."""
    t = _package_tables(spark, sf_dir)
    stubs = t["modules"].filter("public AND NOT contains(module, '.')").select("module", F.explode(F.array(F.lit("f"), F.lit("zz"))).alias("name"))
    return exports.settle_stubs(stubs, t["definitions"], t["imports"])


@query("SELECT count_if(p_partkey % 10 = 9)::BIGINT AS dangling, count_if(p_partkey % 10 = 0)::BIGINT AS duplicates FROM part")
def export_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25: an alias to nothing planted in one shape and a second copy in another are found, and nothing else."""
    published, t = _published(spark, sf_dir)
    core = t["definitions"].filter("name = 'g'").select("module", F.regexp_extract("module", r"^p(\d+)", 1).try_cast("long").alias("k"))
    lost = core.filter("k % 10 = 9").select("module", F.lit("x").alias("name"), F.lit("alias").alias("kind"), F.concat("module", F.lit(".none")).alias("target"))
    again = core.filter("k % 10 = 0").select(F.concat("module", F.lit(".again")).alias("module"), F.lit("f").alias("name"), F.lit("copy").alias("kind"), F.concat("module", F.lit(".f")).alias("target"))
    return exports.audit(published.unionByName(lost).unionByName(again), t["definitions"])


# --- imports in order, bases with fields ------------------------------------------------------------

_DRAWN = "((p_partkey * 7919 + p_size * 104729 + {j} * 15485863) % 1000003)"


def _drawn(j: int) -> str:
    """A number that a part and j tell, in both dialects."""
    return _DRAWN.format(j=j)


_MODULE = "concat('p', CAST({pkg} AS STRING), '.m', CAST({at} AS STRING))"
_OWN_PACKAGE = "CAST(floor(p_partkey / 8) AS BIGINT)"
_HERE = _MODULE.format(pkg=_OWN_PACKAGE, at="p_partkey % 8")
_STATEMENTS, _NAMES = 3, 3
#: Three import statements a module: from which of the package's eight, a star or a name bound to another.
_IMPORTS = " UNION ALL ".join(
    f"SELECT {_HERE} AS module, CASE WHEN {_drawn(10 + j)} % 4 > 0 THEN concat('n', CAST({_drawn(20 + j)} % {_NAMES} AS STRING)) END AS bound, {_MODULE.format(pkg=_OWN_PACKAGE, at=_drawn(j) + ' % 8')} AS source, "
    f"CASE WHEN {_drawn(10 + j)} % 4 > 0 THEN concat('n', CAST({_drawn(30 + j)} % {_NAMES} AS STRING)) END AS name, {j} AS ord FROM part"
    for j in range(1, _STATEMENTS + 1)
)
#: Every other module knows a name: as a definition, from a stub alone, or as an attribute.
_KNOWN = f"SELECT {_HERE} AS module, concat('n', CAST({_drawn(50)} % {_NAMES} AS STRING)) AS name, CASE {_drawn(51)} % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 4 END AS way FROM part WHERE {_drawn(52)} % 2 = 0"
_STARRED = " UNION ALL ".join(f"SELECT {_HERE} AS module, 'n{n}' AS name FROM part WHERE {_drawn(60 + n)} % 3 > 0" for n in range(_NAMES))
_ASKED = " UNION ALL ".join(f"SELECT {_HERE} AS module, 'n{n}' AS name FROM part" for n in range(_NAMES))


@query(f"""
WITH RECURSIVE imps AS ({_IMPORTS}), defs AS ({_KNOWN}), stars AS ({_STARRED}), asked AS ({_ASKED}),
edges AS (SELECT module, bound AS name, source, name AS target, 100 + ord AS code FROM imps WHERE bound IS NOT NULL
  UNION ALL SELECT i.module, s.name, i.source, s.name, 200 + ord FROM imps i JOIN stars s ON s.module = i.source WHERE bound IS NULL),
go AS (
  SELECT module AS m0, name AS n0, module AS m, name AS n, []::INT[] AS path, [concat(module, ':', name)] AS seen FROM asked
  UNION ALL SELECT m0, n0, e.source, e.target, list_append(path, e.code), list_append(seen, concat(e.source, ':', e.target))
  FROM go JOIN edges e ON e.module = go.m AND e.name = go.n LEFT JOIN defs d ON d.module = go.m AND d.name = go.n AND d.way = 0
  WHERE d.module IS NULL AND len(path) < 16 AND NOT list_contains(seen, concat(e.source, ':', e.target)))
SELECT m0 AS module, n0 AS name, m AS def_module, n AS def_name, len(path)::INT AS hops FROM go JOIN defs ON defs.module = go.m AND defs.name = go.n
QUALIFY row_number() OVER (PARTITION BY m0, n0 ORDER BY list_append(path, CASE WHEN way = 0 THEN 0 ELSE 300 + way END)) = 1""")
def import_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-02: packages of eight modules that import from one another at random, in order, with dead ends, cycles, lists and attributes."""
    spread(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").createOrReplaceTempView("lakewright_part")
    imports, known, starred, asked = (spark.sql(x.replace("FROM part", "FROM lakewright_part")) for x in (_IMPORTS, _KNOWN, _STARRED, _ASKED))
    return graph.lookup(known, imports, asked, starred)


@query("""
WITH c AS (
  SELECT p_partkey AS k, p_partkey // 50 AS g, p_partkey % 50 AS i, CASE WHEN p_size % 9 = 0 THEN 'own' || p_partkey END AS init, p_size % 4 > 1 AS dataclass, p_size % 4 > 0 AS collects, p_size, p_brand FROM part),
whole AS (SELECT g FROM c GROUP BY g HAVING min(i) = 0 AND g % 7 NOT IN (3, 5)),
f AS (SELECT k, g, i, 2 * i AS at, 'f' || (p_size % 7) AS name, 'v' || k AS value FROM c WHERE collects UNION ALL SELECT k, g, i, 2 * i + 1, 'g' || (k % 11), p_brand FROM c WHERE collects),
own AS (SELECT c.k, f.name, min(f.at) AS place, arg_max(f.value, f.at) AS value FROM c JOIN whole USING (g) JOIN f ON f.g = c.g AND f.i <= c.i GROUP BY ALL),
fields AS (SELECT k, string_agg(name || '=' || value, ',' ORDER BY place) AS fields FROM own GROUP BY k),
far AS (SELECT c.k, o.k AS origin, CASE WHEN o.i <= c.i THEN c.i - o.i ELSE c.i + 4 - o.i END AS steps FROM c JOIN c o ON o.g = c.g AND (o.i <= c.i OR (c.g % 7 = 3 AND o.i IN (1, 2, 3) AND EXISTS (SELECT 1 FROM c r WHERE r.g = c.g AND r.i = 3) AND EXISTS (SELECT 1 FROM c r WHERE r.g = c.g AND r.i = 0)))
  WHERE o.init IS NOT NULL OR o.dataclass)
SELECT c.k AS node, n.origin, o.init, CASE WHEN o.k IS NOT NULL AND o.init IS NULL AND w.g IS NOT NULL THEN coalesce(fields, '') END AS fields
FROM c LEFT JOIN (SELECT k, arg_min(origin, steps) AS origin FROM far GROUP BY k) n USING (k) LEFT JOIN c o ON o.k = n.origin LEFT JOIN whole w ON w.g = o.g LEFT JOIN fields ON fields.k = o.k""")
def dataclass_constructors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-07: chains of fifty classes with fields that are declared again; of seven chains one hangs on a cycle of four and one on an unknown base."""
    part, k, size = read(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    field = lambda n, v: F.struct(n.alias("name"), v.alias("value"))
    own = F.array(field(F.concat(F.lit("f"), _s(size % 7)), F.concat(F.lit("v"), _s(k))), field(F.concat(F.lit("g"), _s(k % 11)), F.col("p_brand")))
    classes = part.select(k.alias("node"), F.when(size % 9 == 0, F.concat(F.lit("own"), _s(k))).alias("init"), (size % 4 > 1).alias("dataclass"), F.when(size % 4 > 0, own).alias("fields"))
    chain = F.floor(k / 50) % 7
    base = F.when(k % 50 > 0, k - 1).when(chain == 3, k + 3).when(chain == 5, F.lit(-1))
    edges = part.select(k.alias("child"), base.cast("long").alias("parent")).filter("parent IS NOT NULL")
    found = graph.constructors(classes, edges)
    return found.select("node", "origin", "init", F.array_join(F.transform("fields", lambda x: F.concat(x["name"], F.lit("="), x["value"])), ",").alias("fields"))


# --- content, kinds, lists --------------------------------------------------------------------------


@query("""
SELECT 'part' AS module, p_name || '-' || p_partkey AS name, 'function' AS kind FROM part UNION ALL SELECT 'supplier', s_name, 'class' FROM supplier
UNION ALL SELECT 'customer', c_name, 'exception' FROM customer UNION ALL SELECT 'nation', n_name, 'constant' FROM nation""")
def union_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-03: functions, classes, exceptions and constants of their modules, one table of each kind."""
    of = lambda table, name: read(spark, sf_dir, table).select(F.lit(table).alias("module"), name.alias("name"))
    part = of("part", F.concat_ws("-", F.col("p_name"), _s("p_partkey")))
    return symbols.all_kinds(function=part, **{"class": of("supplier", F.col("s_name"))}, exception=of("customer", F.col("c_name")), constant=of("nation", F.col("n_name")))


@query("""
WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'top' || c_custkey ELSE 'a.b' || c_custkey END AS module, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END AS docstring FROM customer),
n AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), a AS (SELECT o_custkey, count(*) AS c FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1)
SELECT module, n.o_custkey IS NOT NULL AS has_names, coalesce(c, 0) AS re_exports, n.o_custkey IS NOT NULL OR coalesce(c, 0) > 0 OR (docstring <> '' AND NOT contains(module, '.')) IS TRUE AS kept
FROM m LEFT JOIN n ON n.o_custkey = c_custkey LEFT JOIN a ON a.o_custkey = c_custkey""")
def module_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL-27, AGG-23: modules with names, with re-exports, or with a docstring at the top level."""
    module = lambda k: F.when(k % 2 == 0, F.concat(F.lit("top"), _s(k))).otherwise(F.concat(F.lit("a.b"), _s(k)))
    modules = read(spark, sf_dir, "customer").select(module(F.col("c_custkey")).alias("module"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise("").alias("docstring"))
    orders = read(spark, sf_dir, "orders").withColumn("module", module(F.col("o_custkey")))
    found = symbols.module_content(modules, orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderpriority LIKE '1%'"))
    return found.select("module", "has_names", "re_exports", "kept")


@query("""
WITH f AS (SELECT l_orderkey, l_returnflag || l_linestatus AS v, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, string_agg(v, ',' ORDER BY first, v) AS vs FROM f GROUP BY 1""")
def distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-24: distinct values in the order in which they first stand."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("v"), "l_linenumber")
    return exports.in_order(rows, ["l_orderkey"], "v", "l_linenumber").select("l_orderkey", F.array_join("values", ",").alias("vs"))


# --- docs and stubs ---------------------------------------------------------------------------------

_STUBS = """stubs AS (SELECT p_brand || '.f' || p_partkey AS path, p_type AS returns FROM part WHERE p_size % 2 = 0)"""


@query(f"""
WITH {_STUBS}, aliases AS (SELECT 'al.' || s AS path, b AS target FROM (SELECT DISTINCT p_brand AS b, replace(p_brand, '#', '') AS s FROM part)),
reach AS (SELECT path, returns, 0 AS own FROM stubs UNION ALL SELECT aliases.path || substr(stubs.path, length(target) + 1), returns, 1 FROM stubs JOIN aliases ON starts_with(stubs.path, target || '.')),
s AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'al.' || replace(p_brand, '#', '') ELSE 'src' END || '.f' || p_partkey AS path, p_brand || '.f' || p_partkey AS origin, CASE WHEN p_partkey % 5 = 0 THEN 'int' END AS src, CASE WHEN p_partkey % 4 = 0 THEN 'str' ELSE '' END AS doc FROM part)
SELECT s.path, coalesce(src, nullif(doc, ''), nullif(coalesce(a.returns, b.returns), '')) AS returns, coalesce(a.path, b.path) IS NOT NULL AS stubbed
FROM s LEFT JOIN (SELECT path, any_value(returns) AS returns FROM reach GROUP BY 1) a ON a.path = s.path LEFT JOIN (SELECT path, any_value(returns) AS returns FROM reach GROUP BY 1) b ON b.path = s.origin""")
def stub_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-06, SYM-08, SYM-09: return types of source, docstring and stub, the stub found by path, by an alias of its module, or by origin."""
    part, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    own = F.concat(F.lit(".f"), _s(k))
    stubs = part.filter("p_size % 2 = 0").select(F.concat("p_brand", own).alias("path"), F.col("p_type").alias("returns"))
    plain = F.replace("p_brand", F.lit("#"), F.lit(""))
    aliases = part.select(F.concat(F.lit("al."), plain).alias("path"), F.col("p_brand").alias("target")).distinct()
    rows = part.select(
        F.concat(F.when(k % 3 == 0, F.concat(F.lit("al."), plain)).otherwise("src"), own).alias("path"), F.concat("p_brand", own).alias("origin"),
        F.when(k % 5 == 0, "int").alias("returns"), F.when(k % 4 == 0, "str").otherwise("").alias("doc_returns"),
    )
    return symbols.with_stubs(rows, stubs, aliases).select("path", "returns", "stubbed")


@query("""
WITH p AS (SELECT o_orderkey AS f, unnest([1, 2, 3, 4]) AS ord, unnest(['a', 'b', 'args', 'c']) AS name, unnest(['positional', 'any', 'var_positional', 'keyword']) AS kind, unnest([CASE WHEN o_orderkey % 2 = 0 THEN 'int' END, NULL, NULL, CASE WHEN o_orderkey % 3 = 0 THEN 'str' END]) AS src, unnest([NULL, '1', NULL, '2']) AS dflt FROM orders),
t AS (SELECT f, ord, name, kind, dflt, coalesce(src, CASE WHEN name IN ('a', 'b') AND f % 5 = 0 THEN 'Doc' END, CASE WHEN name = 'b' AND f % 7 = 0 THEN 'Stub' END) AS type FROM p)
SELECT f AS o_orderkey, string_agg(CASE kind WHEN 'var_positional' THEN '*' ELSE '' END || name || coalesce(': ' || type, '') || CASE WHEN dflt IS NULL THEN '' WHEN type IS NULL THEN '=' || dflt ELSE ' = ' || dflt END || CASE name WHEN 'a' THEN ', /' ELSE '' END, ', ' ORDER BY ord) AS signature FROM t GROUP BY 1""")
def documented_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-05, SYM-08: parameters typed by source, docstring, then stub, and the signature written anew."""
    k = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders")
    param = lambda n, name, kind, note, default: F.struct(F.lit(n).alias("ord"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), note.cast("string").alias("annotation"), F.lit(default).cast("string").alias("default"))
    rows = F.array(param(1, "a", "positional", F.when(k % 2 == 0, "int"), None), param(2, "b", "any", F.lit(None), "1"), param(3, "args", "var_positional", F.lit(None), None), param(4, "c", "keyword", F.when(k % 3 == 0, "str"), "2"))
    params = orders.select("o_orderkey", F.explode(rows).alias("p")).select("o_orderkey", "p.*")
    said = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit("text").alias("description"), F.lit(i).alias("ord")) for i, (n, t) in enumerate((("a", "Doc"), ("b", "Doc"), ("b", "Later"), ("c", "")))])
    docs = orders.filter(k % 5 == 0).select("o_orderkey", F.explode(said).alias("d")).select("o_orderkey", "d.*")
    stubs = orders.filter(k % 7 == 0).select("o_orderkey", F.lit("b").alias("name"), F.lit("Stub").alias("annotation"))
    return symbols.rendered(symbols.documented_params(params, docs, stubs, ["o_orderkey"]), ["o_orderkey"])


@query("""
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, coalesce(b.p_brand, a.p_brand) AS annotation, coalesce(a.p_name, b.p_name) AS docstring, coalesce(a.v, b.v) AS value, a.p_partkey IS NULL AS stub_only
FROM (SELECT *, 'a' AS v FROM part WHERE p_size % 3 <> 0) a FULL JOIN (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'stub' END AS p_brand, p_type AS p_name, 'b' AS v FROM part WHERE p_size % 5 <> 0) b ON a.p_partkey = b.p_partkey""")
def stub_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-08: members of source and bundled stub."""
    part, none = read(spark, sf_dir, "part"), F.array().cast("array<string>")
    base = part.filter("p_size % 3 <> 0").select("p_partkey", F.col("p_brand").alias("annotation"), F.lit(None).cast("string").alias("returns"), F.col("p_name").alias("docstring"), F.lit("a").alias("value"), none.alias("decorators"))
    stub = part.filter("p_size % 5 <> 0").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "stub").alias("annotation"), F.lit(None).cast("string").alias("returns"), F.col("p_type").alias("docstring"), F.lit("b").alias("value"), none.alias("decorators"))
    return symbols.merge_stub_members(base, stub, ["p_partkey"]).select("p_partkey", "annotation", "docstring", "value", "stub_only")


@query("""
WITH a AS (SELECT s_suppkey, 'm' || (s_suppkey % 7) AS module, s_suppkey % 2 = 0 AS is_init, s_name AS path FROM supplier), b AS (SELECT s_suppkey, 'm' || (s_suppkey % 7) AS module, s_suppkey % 3 = 0 AS is_init, s_name || 'i' AS path FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, a.path AS source_path, b.path AS stub_path FROM a FULL JOIN b ON a.s_suppkey = b.s_suppkey AND a.module = b.module AND a.is_init = b.is_init""")
def file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-07: source and stub files of a module; a folder's __init__ pairs with one alone."""
    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").withColumn("module", F.concat(F.lit("m"), _s(k % 7)))
    a = rows.select("s_suppkey", "module", (k % 2 == 0).alias("is_init"), F.col("s_name").alias("path"))
    b = rows.filter(k % 5 != 0).select("s_suppkey", "module", (k % 3 == 0).alias("is_init"), F.concat("s_name", F.lit("i")).alias("path"))
    return symbols.pair_files(a, b, ["s_suppkey"]).select("s_suppkey", "source_path", "stub_path")


@query("""
SELECT p_brand, module, path FROM (SELECT p_brand, 'm' || (p_partkey % 9) AS module, p_name || p_partkey AS path, row_number() OVER (PARTITION BY p_brand, p_partkey % 9 ORDER BY (p_size % 4 = 0) DESC, p_name || p_partkey) AS r FROM part) WHERE r = 1""")
def file_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-11: one file a module, __init__ first."""
    rows = read(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("m"), _s(F.col("p_partkey") % 9)).alias("module"), (F.col("p_size") % 4 == 0).alias("is_init"), F.concat("p_name", _s("p_partkey")).alias("path"))
    return symbols.work_list(rows, ["p_brand"]).select("p_brand", "module", "path")


@query("SELECT o_orderkey, 'c' || o_custkey AS target FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'BUILDING')")
def live_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-09: aliases whose target is there."""
    published = read(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.concat(F.lit("c"), _s("c_custkey")).alias("path"))
    return symbols.live_aliases(read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("c"), _s("o_custkey")).alias("target")), published)


@query("""
SELECT p_partkey, coalesce(d, CASE WHEN t IS NULL THEN y END, '') AS return_text FROM (
  SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name END AS d, CASE WHEN p_size % 3 = 0 THEN p_type END AS t, CASE WHEN p_size % 5 < 3 THEN p_brand END AS y FROM part)""")
def return_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SYM-08: what a docstring says of what is returned, or yielded where it names no return at all."""
    size = F.col("p_size")
    rows = read(spark, sf_dir, "part").select(
        "p_partkey", F.when(size % 4 == 0, F.col("p_name")).alias("doc_returns_text"), F.when(size % 3 == 0, F.col("p_type")).alias("doc_returns"), F.when(size % 5 < 3, F.col("p_brand")).alias("doc_yields_text")
    )
    return symbols.return_notes(rows).select("p_partkey", "return_text")


# --- listings ---------------------------------------------------------------------------------------

_SYMBOLS = """s AS (SELECT 'pkg.' || replace(p_brand, '#', '') || '.n' || p_partkey AS path, 'n' || p_partkey AS name, p_type AS kind, 'def n(' || p_size || ')' AS signature, p_partkey AS ord FROM part)"""


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol for each part, its brand the module, its type the kind."""
    name = F.concat(F.lit("n"), _s("p_partkey"))
    return read(spark, sf_dir, "part").select(
        F.concat(F.lit("pkg."), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("."), name).alias("path"), name.alias("name"), F.col("p_type").alias("kind"), F.concat(F.lit("def n("), _s("p_size"), F.lit(")")).alias("signature"), F.col("p_partkey").alias("ord")
    )


@query(f"WITH {_SYMBOLS} SELECT path, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY path, ord) AS r FROM s) WHERE r <= 8")
def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-12: the first eight of each kind."""
    return symbols.palette(_symbols(spark, sf_dir)).select("path", "kind")


@query(f"""
WITH {_SYMBOLS} SELECT path, round(CASE WHEN contains(lower(path), 'n11') THEN 0 ELSE least(levenshtein(name, 'n11')::DOUBLE / greatest(length(name), 3, 1), levenshtein(lower(path), 'n11')::DOUBLE / greatest(length(path), 3, 1)) END, 6) AS score FROM s
WHERE contains(lower(path), 'n11') OR least(levenshtein(name, 'n11')::DOUBLE / greatest(length(name), 3, 1), levenshtein(lower(path), 'n11')::DOUBLE / greatest(length(path), 3, 1)) <= 0.4""")
def fuzzy_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-13: names near a query."""
    return symbols.fuzzy(_symbols(spark, sf_dir), "N11").select("path", F.round("score", 6).alias("score"))


_TYPED = "SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN concat('N', CAST(s_suppkey * 13 AS STRING)) WHEN 1 THEN concat('pkg.brnad', CAST(s_suppkey % 60 AS STRING), '.n', CAST(s_suppkey * 7 AS STRING)) WHEN 2 THEN concat(CAST(s_suppkey AS STRING), '.n') ELSE concat('nn', CAST(s_suppkey * 5 AS STRING)) END AS query FROM supplier"


@query(f"""
WITH {_SYMBOLS}, q AS ({_TYPED.replace("AS STRING", "AS VARCHAR")}), d AS (
  SELECT query, path, CASE WHEN contains(lower(path), lower(query)) THEN 0 ELSE least(levenshtein(name, lower(query))::DOUBLE / greatest(length(name), length(query), 1), levenshtein(lower(path), lower(query))::DOUBLE / greatest(length(path), length(query), 1)) END AS score FROM q, s)
SELECT query, path, round(score, 6) AS score FROM d WHERE score <= 0.4""")
def fuzzy_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-13: a query for each supplier, mistyped in four ways, through blocks of tries."""
    read(spark, sf_dir, "supplier").select("s_suppkey").createOrReplaceTempView("lakewright_supplier")
    asked = spark.sql(_TYPED.replace("FROM supplier", "FROM lakewright_supplier"))
    return fuzzy.near(_symbols(spark, sf_dir).select("path", "name"), asked).select("query", "path", F.round("score", 6).alias("score"))


_PREFIXES = "SELECT DISTINCT concat('pkg.', replace(p_brand, '#', ''), CASE WHEN p_partkey % 3 = 0 THEN concat('.n', CAST(p_partkey AS STRING)) WHEN p_partkey % 7 = 0 THEN '.n' ELSE '' END) AS prefix FROM part"


@query(f"""
WITH {_SYMBOLS}, a AS (SELECT 'pkg.Brand1.al' || p_partkey AS path, 'pkg.' || replace(p_brand, '#', '') || '.n' || p_partkey AS target FROM part WHERE p_size % 3 = 0), p AS ({_PREFIXES.replace("AS STRING", "AS VARCHAR")})
SELECT prefix, path, NULL AS via FROM p JOIN s ON path = prefix OR starts_with(path, prefix || '.') UNION ALL SELECT prefix, s.path, a.path FROM p JOIN a ON a.path = prefix OR starts_with(a.path, prefix || '.') JOIN s ON s.path = a.target""")
def prefix_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SYM-11, JOIN-11, JOIN-12: all below each of many prefixes, aliases included."""
    own = _symbols(spark, sf_dir)
    aliases = read(spark, sf_dir, "part").filter("p_size % 3 = 0").select(F.concat(F.lit("pkg.Brand1.al"), _s("p_partkey")).alias("path"), F.concat(F.lit("pkg."), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".n"), _s("p_partkey")).alias("target"))
    read(spark, sf_dir, "part").select("p_partkey", "p_brand").createOrReplaceTempView("lakewright_brands")
    return symbols.below_each(own, aliases, spark.sql(_PREFIXES.replace("SELECT DISTINCT", "SELECT").replace("FROM part", "FROM lakewright_brands"))).select("prefix", "path", "via")  # made distinct there


@query(f"""
WITH {_SYMBOLS}, a AS (SELECT 'pkg.Brand1.al' || p_partkey AS path, 'pkg.' || replace(p_brand, '#', '') || '.n' || p_partkey AS target FROM part WHERE p_size % 3 = 0)
SELECT path, NULL AS via FROM s WHERE path = 'pkg.Brand1' OR starts_with(path, 'pkg.Brand1.') UNION ALL SELECT s.path, a.path FROM a JOIN s ON s.path = a.target""")
def prefix_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SYM-11, FIL-09: all below a prefix, and what aliases there stand for."""
    own = _symbols(spark, sf_dir)
    aliases = read(spark, sf_dir, "part").filter("p_size % 3 = 0").select(F.concat(F.lit("pkg.Brand1.al"), _s("p_partkey")).alias("path"), F.concat(F.lit("pkg."), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".n"), _s("p_partkey")).alias("target"))
    return symbols.below(own, aliases, "pkg.Brand1").select("path", "via")


@query(f"WITH {_SYMBOLS} SELECT path || chr(9) || kind || chr(9) || signature AS line FROM s")
def symbol_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-12: symbols as lines of text."""
    return text_sinks.symbols_tsv(_symbols(spark, sf_dir))


@query(f"""
WITH {_SYMBOLS} SELECT kind, '{{"name":"' || kind || '","symbols":[' || string_agg('{{"path":"' || path || '","kind":"' || kind || '","signature":"' || signature || '"}}', ',' ORDER BY path) || ']}}' AS json FROM s GROUP BY kind""")
def docs_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-10: one JSON document a module."""
    return text_sinks.docs_json(_symbols(spark, sf_dir), "kind")


# --- types and docstrings -----------------------------------------------------------------------------

_TYPES = ["int", "typing.Optional[str]", "int | None | str", "Callable[[int], str]", "Literal['a', 'b']", "tuple[int, ...]", "'Forward'", "None", "x y", "a.b.C[int, str]"]


@query(f"""
SELECT p_partkey, {_sql_list(["simple", "optional", "union", "callable", "literal", "tuple", "string", "none", "unknown", "generic"])}[p_partkey % 10 + 1] AS kind, [0, 1, 3, 2, 2, 2, 0, 0, 0, 2][p_partkey % 10 + 1] AS args FROM part""")
def type_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SYM-06: kinds of type expressions, all ten of them."""
    found = read(spark, sf_dir, "part").select("p_partkey", types.type_expression(_pick(_TYPES, F.col("p_partkey"))).alias("t"))
    return found.select("p_partkey", "t.kind", F.size("t.args").alias("args"))


@query("""
SELECT c_custkey, ['google', 'numpy', 'sphinx'][c_custkey % 3 + 1] AS style, 'text of ' || c_name AS text, 'x' AS param, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE 'int' END AS type, 'the ' || c_mktsegment AS description, 'gone wrong' AS raised FROM customer""")
def docstring_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-04, TXT-05, TXT-06, TXT-07, TXT-08: parameters and errors of three styles, and the prose without them."""
    k, text, about = F.col("c_custkey") % 3, F.concat(F.lit("text of "), "c_name"), F.concat(F.lit("the "), "c_mktsegment")
    google = F.concat(text, F.lit("\n\n\tArgs:\n\t    x (int): "), about, F.lit("\n\n\tRaises:\n\t    ValueError: gone wrong\n\t"))
    numpy = F.concat(text, F.lit("\n\n    Parameters\n    ----------\n    x : int\n        "), about, F.lit("\n\n    Raises\n    ------\n    ValueError\n        gone wrong\n    "))
    sphinx = F.concat(text, F.lit("\n\n    :param x: "), about, F.lit("\n    :raises ValueError: gone wrong\n    "))
    raw = F.when(k == 0, google).when(k == 1, numpy).otherwise(sphinx)
    parsed = read(spark, sf_dir, "customer").select("c_custkey", docstrings.parse_docstring(raw).alias("d"), docstrings.docstring_prose(raw).alias("prose"))
    first = F.col("d.params")[0]
    return parsed.select("c_custkey", "d.style", F.trim("prose").alias("text"), first["name"].alias("param"), first["type"].alias("type"), first["description"].alias("description"), F.col("d.raises")[0]["description"].alias("raised"))


# --- sources of ten shapes ----------------------------------------------------------------------------

SHAPES = [
    "from dataclasses import dataclass, field, KW_ONLY\n\n@dataclass\nclass D:\n    a: int\n    b: str = 'x'\n    _: KW_ONLY\n    c: float = field(default=1.5)\n    d: ClassVar[int] = 0\n",
    "class A:\n    class B(Base, metaclass=M):\n        def f(self, x): ...\n        class _C:\n            y = 1\n",
    "@overload\ndef g(x: int) -> int: ...\n@typing.overload\ndef g(x: str) -> str: ...\ndef g(x):\n    return x\n",
    "if sys.version_info > (3,):\n    def new(a, /, b): ...\nelse:\n    def old(): ...\nwith guard:\n    LIMIT: Final = 3\n",
    "try:\n    from ._fast import run\nexcept ImportError:\n    run = None\nfinally:\n    done = True\n",
    "@app.route('/x', methods=['GET'])\n@functools.cache\nasync def view(req, /, *, q: int = 1, **more) -> 'Reply': ...\n",
    "class P:\n    @property\n    def v(self) -> int: ...\n    @v.setter\n    def v(self, x): ...\n    @staticmethod\n    def s(a): ...\n    @classmethod\n    def c(cls, a): ...\n",
    'print "x"\ndef ok(): pass\nexec "y"\nX = 1\nraise E, "z"\ndef too(*, k): pass\n',
    "type V = int | None\na, b = 1, 2\nc = d = [\n    3,\n    4,\n]\n_hidden = 0\n",
    "class I:\n    def __init__(self, n: int = 0, *args, **kw):\n        self.n = n\n        self.m: str = ''\n    def __len__(self): ...\n    def _own(self): ...\n",
]
EXPECTED = [
    (0, "D", "class", "class D"), (0, "D.__init__", "dataclass_init", "def __init__(a: int, b: str = 'x', *, c: float = 1.5)"), (0, "D.a", "attribute", None), (0, "D.b", "attribute", None), (0, "D._", "attribute", None), (0, "D.c", "attribute", None), (0, "D.d", "attribute", None),
    (1, "A", "class", "class A"), (1, "A.B", "class", "class B(Base)"), (1, "A.B.f", "method", "def f(x)"), (1, "A.B._C", "class", "class _C"), (1, "A.B._C.y", "attribute", None),
    (2, "g", "overload", "def g(x: int) -> int"), (2, "g", "overload", "def g(x: str) -> str"), (2, "g", "function", "def g(x)"),
    (3, "new", "function", "def new(a, /, b)"), (3, "old", "function", "def old()"), (3, "LIMIT", "attribute", None), (4, "run", "attribute", None), (4, "done", "attribute", None),
    (5, "view", "function", "async def view(req, /, *, q: int = 1, **more) -> 'Reply'"),
    (6, "P", "class", "class P"), (6, "P.v", "property", None), (6, "P.s", "method", "def s(a)"), (6, "P.c", "method", "def c(a)"),
    (7, "ok", "function", "def ok()"), (7, "X", "attribute", None), (7, "too", "function", "def too(*, k)"),
    (8, "V", "type_alias", None), (8, "a", "attribute", None), (8, "b", "attribute", None), (8, "c", "attribute", None), (8, "d", "attribute", None), (8, "_hidden", "attribute", None),
    (9, "I", "class", "class I"), (9, "I.__init__", "method", "def __init__(n: int = 0, *args, **kw)"), (9, "I.n", "attribute", None), (9, "I.m", "attribute", None), (9, "I.__len__", "method", "def __len__()"), (9, "I._own", "method", "def _own()"),
]
_ROWS = ", ".join("({}, '{}', '{}', {})".format(n, p, k, "NULL" if s is None else "'" + s.replace("'", "''") + "'") for n, p, k, s in EXPECTED)


@query(f"""
SELECT 'm' || p_partkey || '.' || path AS path, kind, signature, NOT regexp_matches(path, '(^|\\.)_[^.]*$') OR regexp_matches(path, '\\.__[a-z]+__$') AS public, CASE WHEN p_partkey % 10 = 7 THEN 3 ELSE 0 END AS lost
FROM part JOIN (VALUES {_ROWS}) v(shape, path, kind, signature) ON p_partkey % 10 = shape""")
def module_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LEX-01, PAR-01, SYM-01, SYM-02, SYM-03, SYM-04, SYM-05: dataclasses, nested classes, overloads, branches, decorators, properties, statements of an older
    language, aliases and attributes of instances, as each of ten sources has them."""
    from ..code import extract

    sources = spread(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.concat(F.lit("m"), _s("p_partkey")).alias("module"), _pick(SHAPES, F.col("p_partkey")).alias("source"))
    parsed = extract.modules(sources, parsed=extract.only("parse_errors", "symbols", symbols=("path", "kind", "signature", "public")))
    return parsed.select(F.col("parsed.parse_errors").alias("lost"), F.explode("parsed.symbols").alias("s")).select("s.path", "s.kind", "s.signature", "s.public", "lost")
