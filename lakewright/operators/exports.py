"""What a module publishes: names by export list and imports, one place for each definition, aliases elsewhere.

Tables: modules (module, public, listed: has an export list, partial: of which parts cannot be read); names (module, name) of the
lists; refs (module, source) of `source.__all__` in them; definitions (module, name, public: by the module's own rule, stub_only);
imports (module, bound, source, name, explicit, exported, and ord: the place in the module), bound null for a star import; `stars` are
the star sets, which bound what star imports bring. Definitions may have a `way` (see graph.lookup): attributes come after imports. All are joined by module and name; only the sets of
star imports take rounds, as many as the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import met_by_key
from . import graph


def _open(name: str):
    return ~F.col(name).startswith("_")


def star_sets(modules: DataFrame, names: DataFrame, refs: DataFrame, definitions: DataFrame, imports: DataFrame) -> DataFrame:
    """(module, name) that a star import of each module binds: a complete list and those it refers to, else all public names, imports and stars of stars included."""
    free = modules.filter("NOT listed OR partial").select("module")
    inside = imports.join(free, "module", "left_semi")
    own = names.select("module", "name").unionByName(definitions.join(free, "module", "left_semi").filter(_open("name")).select("module", "name"))
    bound = inside.filter(F.col("bound").isNotNull() & F.col("exported") & _open("bound")).select("module", F.col("bound").alias("name"))
    stars = inside.filter("bound IS NULL").select("module", "source", F.lit(True).alias("filtered"))
    edges = refs.select("module", "source", F.lit(False).alias("filtered")).unionByName(stars).distinct()
    return graph.grown(own.unionByName(bound), lambda new: edges.join(met_by_key(new.withColumnRenamed("module", "source")), "source").filter(~F.col("filtered") | _open("name")), ["module", "name"])


def export_names(modules: DataFrame, names: DataFrame, refs: DataFrame, definitions: DataFrame, imports: DataFrame, stars: DataFrame | None = None) -> DataFrame:
    """(module, name) that each public module publishes besides its own definitions' rule: a complete list as it is; otherwise what is listed,
    and public names imported from private modules, or marked `name as name`. stars are the star sets, if these are known."""
    sets = star_sets(modules, names, refs, definitions, imports) if stars is None else stars
    public = modules.filter("public").select("module", (F.col("listed") & ~F.col("partial")).alias("complete"))
    whole = public.filter("complete").join(sets, "module").select("module", "name")
    rest = public.filter("NOT complete").select("module")
    listed = names.select("module", "name").unionByName(refs.join(sets.withColumnRenamed("module", "source"), "source").select("module", "name"))
    known = modules.select(F.col("module").alias("source"), F.col("public").alias("open"))
    taken = imports.filter("exported").join(known, "source").filter("NOT open OR explicit").join(rest, "module", "left_semi")
    starred = taken.filter("bound IS NULL").join(sets.select(F.col("module").alias("source"), F.col("name").alias("n")), "source").select("module", F.col("n").alias("name"))
    bound = taken.filter("bound IS NOT NULL").select("module", F.col("bound").alias("name"))
    return whole.unionByName(listed.join(rest, "module", "left_semi")).unionByName(starred.unionByName(bound).filter(_open("name"))).distinct()


def settle(modules: DataFrame, exports: DataFrame, definitions: DataFrame, refs: DataFrame) -> DataFrame:
    """definitions with `published`: by their own rule, unless the module's list has references or unreadable parts; then by the names that turned out."""
    referring = refs.select("module").distinct().withColumn("_refers", F.lit(True))
    rows = definitions.join(modules.select("module", F.col("public").alias("_open"), "listed", "partial"), "module").join(referring, "module", "left")
    rows = rows.join(exports.select("module", "name").withColumn("_seen", F.lit(True)), ["module", "name"], "left")
    late = F.col("listed") & (F.col("partial") | F.coalesce("_refers", F.lit(False)))
    seen = F.coalesce("_seen", F.lit(False))
    rows = rows.withColumn("published", F.col("_open") & F.when(late, seen | (F.col("partial") & _open("name"))).otherwise(F.col("public")))
    return rows.drop("_open", "_refers", "_seen", "listed", "partial")


def publish(modules: DataFrame, exports: DataFrame, settled: DataFrame, imports: DataFrame, stars: DataFrame | None = None) -> DataFrame:
    """(module, name, kind, target) of exports that the module does not define itself: `copy` at one place for a definition that is not
    published where it stands, the module of the fewest dots, then the first, its own name before another; `alias` elsewhere. Names that lead nowhere go."""
    defined = settled.select("module", "name").distinct()
    asked = exports.join(defined, ["module", "name"], "left_anti")
    found = graph.lookup(_ways(settled), _ordered(imports), asked, stars).select("module", "name", "def_module", "def_name")
    home = settled.filter("published").select(F.col("module").alias("def_module"), F.col("name").alias("def_name")).distinct().withColumn("_home", F.lit(True))
    found = found.join(home, ["def_module", "def_name"], "left").withColumn("_home", F.coalesce("_home", F.lit(False)))
    dots = F.length("module") - F.length(F.replace("module", F.lit("."), F.lit("")))
    place = Window.partitionBy("def_module", "def_name").orderBy(dots, "module", F.col("name") != F.col("def_name"), "name")
    found = found.withColumn("_at", F.row_number().over(place)).withColumn("_copy", F.first(F.concat_ws(".", "module", "name")).over(place))
    copied = ~F.col("_home") & (F.col("_at") == 1)
    origin = F.concat_ws(".", "def_module", "def_name")
    return found.select("module", "name", F.when(copied, "copy").otherwise("alias").alias("kind"), F.when(F.col("_home") | copied, origin).otherwise(F.col("_copy")).alias("target"))


def _ways(definitions: DataFrame) -> DataFrame:
    return definitions.select("module", "name", *[c for c in ("way",) if c in definitions.columns])


def _ordered(imports: DataFrame) -> DataFrame:
    return imports.select("module", "bound", "source", "name", *[c for c in ("ord",) if c in imports.columns])


def settle_stubs(stub_definitions: DataFrame, definitions: DataFrame, imports: DataFrame, stars: DataFrame | None = None) -> DataFrame:
    """stub_definitions (module, name) that a module's source only imports, or does not know, with what becomes of them: the definition their types
    go to, if the import leads to one elsewhere; else they join the module (target null)."""
    asked = stub_definitions.select("module", "name").distinct()
    found = graph.lookup(_ways(definitions), _ordered(imports), asked, stars).filter("def_module <> module")
    found = found.select("module", "name", F.concat_ws(".", "def_module", "def_name").alias("target"))
    return asked.join(found, ["module", "name"], "left")


def audit(published: DataFrame, definitions: DataFrame) -> DataFrame:
    """(dangling, duplicates): aliases whose target is no definition or copy, and definitions that are copied in more than one module."""
    places = definitions.select(F.concat_ws(".", "module", "name").alias("target")).unionByName(published.filter("kind = 'copy'").select(F.concat_ws(".", "module", "name").alias("target"))).distinct()
    zero = F.lit(0).cast("long")
    dangling = published.filter("kind = 'alias'").join(places, "target", "left_anti").select(F.lit(1).cast("long").alias("dangling"), zero.alias("duplicates"))
    twice = published.filter("kind = 'copy'").groupBy("target").agg(F.count_distinct("module").alias("n")).filter("n > 1").select(zero.alias("dangling"), F.lit(1).cast("long").alias("duplicates"))
    return dangling.unionByName(twice).agg(F.coalesce(F.sum("dangling"), zero).alias("dangling"), F.coalesce(F.sum("duplicates"), zero).alias("duplicates"))


def in_order(lists: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, values): the distinct values of each key in the order in which they first stand. What is collected are a key's distinct values."""
    first = lists.groupBy(*keys, value).agg(F.min(order).alias("_first"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", value))), lambda x: x[value]).alias("values"))
