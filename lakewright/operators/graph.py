"""Import and inheritance graphs: iterated joins over edge tables, until the frontier is empty; lookups are bounded in rounds.

Each round is one equi-join on the frontier alone, cut off by a reliable checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut_lineage, met_by_key

MOST_HOPS = 16


def import_source(module: Column, is_package: Column, level: Column, source: Column) -> Column:
    """The module that an import names: level dots up from the importing package, then source."""
    parts = F.split(module, r"\.")
    up = F.size(parts) - level + F.when(is_package, 1).otherwise(0)
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(up, F.lit(0))), ".")
    joined = F.when(source == "", base).otherwise(F.concat_ws(".", F.when(base != "", base), source))
    return F.when(level == 0, source).otherwise(joined)


#: Ways to go on from a name in a module, in the order in which they are tried.
DEFINED, NAMED, STAR, STUB, ATTRIBUTE = range(5)
_STEP = "struct<way:int,ord:long,source:string,name:string>"


def lookup(definitions: DataFrame, imports: DataFrame, wanted: DataFrame, stars: DataFrame | None = None) -> DataFrame:
    """(module, name, def_module, def_name, hops) of what names stand for, through imports.

    definitions (module, name, and `way`: DEFINED, STUB or ATTRIBUTE, the first if there is no such column); imports (module, bound,
    source, name, and `ord`: the place in the module, by source and name if there is no such column), bound null for a star import;
    wanted (module, name); stars (module, name): what a star import of a module binds, all open names if it is not given.

    In a module a definition comes first, then the named imports in their order, then the star imports that bring the name, then what
    stubs alone know, then attributes. An import that leads nowhere, or back to where one has been, gives way to the next: of all
    paths of sixteen hops at most the least one by the ways taken is the answer. A frontier row carries its path, which names the places on it, and the least that was found for it; of
    rows that reach one place in a round only that of the least path goes on (a greater one that could
    end where this one cannot would pass a place of this one, which goes on from there by itself), and none that a found path precedes.
    """
    way = F.col("way").cast("int") if "way" in definitions.columns else F.lit(DEFINED)
    ends = definitions.select(F.col("module").alias("m"), F.col("name").alias("n"), way.alias("_way")).groupBy("m", "n").agg(F.min("_way").alias("_way"))
    order = (F.col("ord") if "ord" in imports.columns else F.lit(0)).cast("long")
    step = lambda way, name: F.struct(F.lit(way).alias("way"), order.alias("ord"), F.col("source").alias("source"), F.col(name).alias("name"))
    named = imports.filter("bound IS NOT NULL").select(F.col("module").alias("m"), F.col("bound").alias("n"), step(NAMED, "name").alias("_step")).distinct()
    whole = imports.filter("bound IS NULL").select(F.col("module").alias("m"), "source", order.alias("ord")).distinct()
    if stars is not None:
        brings = stars.select(F.col("module").alias("source"), F.col("name").alias("n")).distinct()
        named = named.unionByName(whole.join(met_by_key(brings), "source").select("m", "n", step(STAR, "n").alias("_step")))
    named, ends = cut_lineage(named), cut_lineage(ends)
    at = wanted.select("module", "name").distinct().withColumns({"m": F.col("module"), "n": F.col("name"), "path": F.expr(f"CAST(array() AS array<{_STEP}>)"), "_best": F.expr(f"CAST(NULL AS array<{_STEP}>)")})
    settled = []
    for hop in range(MOST_HOPS + 1):
        here = at.join(met_by_key(ends), ["m", "n"], "left")
        last = F.struct(F.col("_way").alias("way"), F.lit(0).cast("long").alias("ord"), F.lit("").alias("source"), F.lit("").alias("name"))
        found = here.filter("_way IS NOT NULL").select("module", "name", F.array_append("path", last).alias("path"), F.col("m").alias("def_module"), F.col("n").alias("def_name"), F.lit(hop).alias("hops"))
        least = F.min_by(F.struct("path", "def_module", "def_name", "hops"), F.struct("path"))
        settled.append(cut_lineage(found.groupBy("module", "name").agg(least.alias("b")).select("module", "name", "b.*")))
        if hop == MOST_HOPS:
            break
        open_ = here.filter(f"_way IS NULL OR _way > {STAR}").drop("_way")
        moved = open_.join(met_by_key(named), ["m", "n"])
        if stars is None:
            moved = moved.unionByName(open_.filter("NOT startswith(n, '_')").join(met_by_key(whole), "m").withColumn("_step", step(STAR, "n")).drop("source", "ord"))
        # where one has been are the places of the path, and the first one
        to = F.col("_step")
        been = ((to["source"] == F.col("module")) & (to["name"] == F.col("name"))) | F.exists("path", lambda p: (p["source"] == to["source"]) & (p["name"] == to["name"]))
        moved = moved.filter(~been).select("module", "name", to["source"].alias("m"), to["name"].alias("n"), F.array_append("path", to).alias("path"), "_best")
        known = settled[-1].select("module", "name", F.col("path").alias("_new"))
        moved = moved.join(met_by_key(known), ["module", "name"], "left").withColumn("_best", F.least("_best", "_new")).filter("_best IS NULL OR path < _best")
        at = cut_lineage(moved.groupBy("module", "name", "m", "n").agg(F.min("path").alias("path"), F.first("_best").alias("_best")))
        if at.isEmpty():
            break
    best = reduce(DataFrame.unionByName, settled).groupBy("module", "name").agg(F.min_by(F.struct("def_module", "def_name", "hops"), "path").alias("b"))
    return best.select("module", "name", "b.*")


def grown(known: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """known and all rows that steps lead to, each once; step gives the rows next to those of a frontier. Ends on cycles.

    A round joins the frontier alone and writes what is new; what is known is read from the files of all rounds, brought together
    every sixteen of them. Rounds are as many as the longest chain.
    """
    known = frontier = cut_lineage(known.select(*keys).distinct())
    rounds = 0
    while True:
        frontier = cut_lineage(step(frontier).select(*keys).distinct().join(met_by_key(known), keys, "left_anti"))
        if frontier.isEmpty():
            return known
        known, rounds = known.unionByName(frontier), rounds + 1
        if rounds % 16 == 0:
            known = cut_lineage(known)


def star_names(exports: DataFrame, stars: DataFrame) -> DataFrame:
    """(module, name): what `from module import *` brings, stars of stars included."""
    return grown(exports, lambda new: stars.join(met_by_key(new.withColumnRenamed("module", "source")), "source"), ["module", "name"])


def publish_once(exports: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of all places that export a definition, the first by order is where it is published; the others are aliases of it."""
    place = Window.partitionBy(*key).orderBy(*order)
    return exports.withColumn("published", F.row_number().over(place) == 1)


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All nodes that reach a seed over child -> parent edges, seeds included. Ends on cycles: a node enters once."""
    return grown(seeds, lambda new: edges.join(met_by_key(new.withColumnRenamed("node", "parent")), "parent").select(F.col("child").alias("node")), ["node"])


def inherit(classes: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """classes (node, value) with the value of the nearest ancestor that has one, along single bases (child, parent).

    Each round doubles the stretch that a row has looked along: a class without a value points at its parent, then at
    what that one points at. Rows leave once they have a value, or no ancestor is left. A round in which none leaves
    is the last: what still points on lies on a cycle or below one without a value, and has none. So rounds are as many as the longest chain doubles.
    """
    at = classes.join(edges.select(F.col("child").alias("node"), F.col("parent").alias("up")), "node", "left")
    at = cut_lineage(at.select("node", F.col(value).alias("v"), F.when(F.col(value).isNull(), F.col("up")).alias("up")))
    left, before = at.filter("up IS NOT NULL").count(), None
    while left and left != before:
        ahead = at.select(F.col("node").alias("up"), F.col("v").alias("_v"), F.col("up").alias("_up"))
        moved = at.filter("up IS NOT NULL").join(met_by_key(ahead), "up", "left").select("node", F.col("_v").alias("v"), F.col("_up").alias("up"))
        at = cut_lineage(at.filter("up IS NULL").unionByName(moved))
        left, before = at.filter("up IS NOT NULL").count(), left
    return at.select("node", F.col("v").alias(value))


def _overlaid(base: Column, own: Column) -> Column:
    """The fields of base, those that own has, too, with own's values, then the others of own: an ordered map of both."""
    renewed = F.transform(base, lambda x: F.coalesce(F.try_element_at(F.filter(own, lambda y: y["name"] == x["name"]), F.lit(-1)), x))
    return F.concat(renewed, F.filter(own, lambda y: ~F.exists(base, lambda x: x["name"] == y["name"])))


def inherited_fields(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, fields) of classes (node, fields: array of (name, value)) with the fields of all bases, along single bases (child, parent).

    Fields of a base come first; one that is declared again keeps its place and takes the new value. A base that is no class of
    the table is unknown, and so are the fields of all below it, of cycles and of what is below those: null. Laying ordered maps over one another
    is associative, so each round doubles the stretch of bases that a row has gathered, as in `inherit`.
    """
    kind = classes.schema["fields"].dataType.simpleString()
    none = F.expr(f"CAST(array() AS {kind})")
    own = F.aggregate(F.coalesce("fields", none), none, lambda held, x: _overlaid(held, F.array(x)))
    up = edges.select(F.col("child").alias("node"), F.lit(True).alias("_has"), F.col("parent").alias("up"))
    at = classes.select("node", own.alias("fields")).join(up, "node", "left")
    # a base without a name is unknown from the start
    at = cut_lineage(at.select("node", "fields", "up", (F.col("_has").isNull() | F.col("up").isNotNull()).alias("known")))
    left, before = at.filter("known AND up IS NOT NULL").count(), None
    while left and left != before:
        ahead = at.select(F.col("node").alias("up"), F.col("fields").alias("_fields"), F.col("up").alias("_up"), F.col("known").alias("_known"))
        moved = at.filter("known AND up IS NOT NULL").join(met_by_key(ahead), "up", "left")
        moved = moved.select("node", _overlaid(F.col("_fields"), F.col("fields")).alias("fields"), F.col("_up").alias("up"), F.coalesce("_known", F.lit(False)).alias("known"))
        at = cut_lineage(at.filter("NOT known OR up IS NULL").unionByName(moved))
        left, before = at.filter("known AND up IS NOT NULL").count(), left
    return at.select("node", F.when(F.col("known") & F.col("up").isNull(), F.col("fields")).alias("fields"))


def constructors(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, origin, init, fields) of classes (node, init, dataclass: generates one, fields: null of a plain class): the nearest class along the bases that has a
    constructor or generates one, its init if that is written, else the fields it is generated from; null if these cannot be known."""
    fields = inherited_fields(classes.select("node", "fields"), edges)
    has = F.col("init").isNotNull() | F.coalesce("dataclass", F.lit(False))
    rows = classes.select("node", "init", "dataclass").join(met_by_key(fields), "node")
    value = F.when(has, F.struct(F.col("node").alias("origin"), F.col("init").alias("init"), F.when(F.col("init").isNull(), F.col("fields")).alias("fields")))
    return inherit(rows.select("node", value.alias("made")), edges, "made").select("node", "made.origin", "made.init", "made.fields")
