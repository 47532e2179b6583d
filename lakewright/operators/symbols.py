"""Symbol tables: overloads, stubs, aliases, flat listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..shared import met_by_key, spread

#: Decorators that a reader should know, by the name shown; the names of builtin exceptions without the suffix.
SERVED = {
    "abstractmethod": "abstractmethod", "abstractclassmethod": "abstractmethod", "abstractstaticmethod": "abstractmethod", "final": "final", "override": "override",
    "contextmanager": "contextmanager", "asynccontextmanager": "asynccontextmanager", "dataclass": "dataclass", "deprecated": "deprecated", "lru_cache": "lru_cache", "cache": "cache",
}
EXCEPTIONS = ("BaseExceptionGroup", "ExceptionGroup", "KeyboardInterrupt", "StopIteration", "StopAsyncIteration")
#: Names whose subscript makes a value a type, callees that make a type parameter, and bases that say nothing.
GENERICS = (
    "Annotated", "AsyncIterable", "AsyncIterator", "Awaitable", "Callable", "ClassVar", "Collection", "Container", "Coroutine", "DefaultDict", "Deque", "Dict", "Final", "FrozenSet", "Generator",
    "Iterable", "Iterator", "List", "Literal", "Mapping", "MutableMapping", "MutableSequence", "MutableSet", "Optional", "Sequence", "Set", "Tuple", "Type", "Union", "dict", "frozenset", "list", "set", "tuple", "type",
)
TYPE_PARAMS = ("TypeVar", "TypeVarTuple", "ParamSpec", "NewType")
INERT = ("object", "ABC", "abc.ABC", "Protocol", "Generic")
TYPING = ("typing.", "typing_extensions.")
MOST_LISTED = 500
#: Rows below a path from which on they are not moved to one task.
HOT = 1 << 16


def last_name(dotted: Column) -> Column:
    """The last dotted part before any call or subscript."""
    return F.element_at(F.split(F.regexp_replace(dotted, r"(?s)[(\[].*$", ""), r"\."), -1)


def served_decorators(decorators: Column) -> Column:
    """Names shown for decorators, each once, in order; `cache` only of functools."""
    table = F.create_map(*[F.lit(x) for kv in SERVED.items() for x in kv])
    head = lambda d: F.regexp_replace(d, r"(?s)\(.*$", "")
    fit = F.filter(decorators, lambda d: (last_name(d) != "cache") | head(d).isin("cache", "functools.cache"))
    return F.array_distinct(F.filter(F.transform(fit, lambda d: F.try_element_at(table, last_name(d))), lambda d: d.isNotNull()))


def method_kind(decorators: Column) -> Column:
    kinds = F.transform(decorators, lambda d: F.regexp_extract(last_name(d), "^(?:abstract)?(classmethod|staticmethod)$", 1))
    return F.coalesce(F.try_element_at(F.filter(kinds, lambda k: k != ""), F.lit(1)), F.lit(""))


def is_type_param(value: Column) -> Column:
    return F.coalesce(value.contains("(") & last_name(value).isin(*TYPE_PARAMS), F.lit(False))


def is_constant(name: Column, annotation: Column, value: Column) -> Column:
    """ALL_CAPS names, TypeAlias annotations, CamelCase names of typing generics; no dunders and no type parameters."""
    caps = (name == F.upper(name)) & (name != F.lower(name))
    alias = F.element_at(F.split(F.regexp_replace(F.coalesce(annotation, F.lit("")), "^[\"']+|[\"']+$", ""), r"\."), -1) == "TypeAlias"
    camel = name.rlike(r"^\p{Lu}") & ~name.contains("_") & F.coalesce(value, F.lit("")).contains("[")
    generic = camel & F.coalesce(F.element_at(F.split(F.regexp_replace(value, r"(?s)\[.*$", ""), r"\."), -1).isin(*GENERICS), F.lit(False))
    return ~names.is_dunder(name) & ~is_type_param(value) & (caps | alias | generic)


def is_exception_name(base: Column) -> Column:
    name = last_name(base)
    return name.isin(*EXCEPTIONS) | name.rlike("(Error|Exception|Warning|Exit)$")


def is_inert_base(base: Column) -> Column:
    """Whether a base class adds neither fields nor a constructor; prefixes of the typing modules may stand before its name, no others."""
    name = F.regexp_replace(base, r"(?s)\[.*$", "")
    for prefix in TYPING:
        name = F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 1 << 20)).otherwise(name)
    return name.isin(*INERT)


def joined_decorators(own: Column, more: Column) -> Column:
    """own in order, then those of more whose last dotted name none before has."""
    add = lambda done, d: F.when(F.exists(done, lambda x: _bare(x) == _bare(d)), done).otherwise(F.concat(done, F.array(d)))
    none = F.array().cast("array<string>")
    return F.aggregate(F.coalesce(more, none), F.coalesce(own, none), add)


def _bare(decorator: Column) -> Column:
    """A decorator's name without arguments or module path."""
    return F.element_at(F.split(F.regexp_replace(decorator, r"(?s)\(.*$", ""), r"\."), -1)


def collapse_functions(functions: DataFrame, keys: list[str]) -> DataFrame:
    """One row a name, at the place of its first definition: the last implementation with a docstring, else the last, else the first
    overload; with the signatures of the other overloads in order, and without a docstring of its own that of the first overload that has one.

    What is collected are the definitions of one name.
    """
    is_impl = F.col("kind") != "overload"
    rank = F.struct(is_impl.cast("int"), (is_impl & F.col("docstring").isNotNull()).cast("int"), F.when(is_impl, F.col("ord")).otherwise(-F.col("ord")))
    keep = [c for c in functions.columns if c not in keys]
    overloads = F.array_sort(F.collect_list(F.when(~is_impl, F.struct("ord", "signature", "docstring"))))
    found = functions.groupBy(*keys).agg(F.max_by(F.struct(*keep), rank).alias("f"), overloads.alias("o"), F.min("ord").alias("first"))
    others = F.filter("o", lambda o: o["ord"] != F.col("f.ord"))
    said = F.try_element_at(F.filter(F.transform(others, lambda o: o["docstring"]), lambda d: d.isNotNull()), F.lit(1))
    columns = [F.coalesce("f.docstring", said).alias(c) if c == "docstring" else F.col("first").alias(c) if c == "ord" else F.col(f"f.{c}") for c in keep]
    return found.select(*keys, *columns, F.transform(others, lambda o: o["signature"]).alias("overloads"))


def collapse_last(items: DataFrame, keys: list[str]) -> DataFrame:
    """The last item of a name, at the place of the first."""
    keep = [c for c in items.columns if c not in (*keys, "ord")]
    return items.groupBy(*keys).agg(F.max_by(F.struct(*keep), "ord").alias("i"), F.min("ord").alias("ord")).select(*keys, "i.*", "ord")


def collapse_attributes(attributes: DataFrame, keys: list[str]) -> DataFrame:
    """One row a name, at the place of its first definition. Definitions are taken in order and a later one wins, but a property stays
    one, and an instance attribute gives way to the class's own; the winner takes type and text it lacks from the other.

    What is collected are the definitions of one name in one class or module.
    """
    fields = ("kind", "value", "instance", "annotation", "docstring")
    row = F.struct("ord", *[F.coalesce("instance", F.lit(False)).alias(c) if c == "instance" else F.col(c) for c in fields])
    listed = attributes.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("a"))

    def merge(done: Column, new: Column) -> Column:
        stays = ((done["kind"] == "property") & (new["kind"] != "property")) | (new["instance"] & ~done["instance"])
        pick = lambda c: F.when(stays, done[c]).otherwise(new[c])
        fill = lambda c: F.when(stays, F.coalesce(done[c], new[c])).otherwise(F.coalesce(new[c], done[c]))
        return F.struct(done["ord"].alias("ord"), *[(fill if c in ("annotation", "docstring") else pick)(c).alias(c) for c in fields])

    rest = F.slice("a", F.lit(2), F.greatest(F.size("a") - 1, F.lit(0)))
    return listed.select(*keys, F.aggregate(rest, F.col("a")[0], merge).alias("w")).select(*keys, *[f"w.{c}" for c in fields], "w.ord")


def with_doc_params(params: DataFrame, doc_params: DataFrame, keys: list[str]) -> DataFrame:
    """Parameters with type and text of the docstring where the source has none; of a name that a docstring repeats, the first by `ord`."""
    docs = doc_params.groupBy(*keys, "name").agg(F.min_by(F.struct("type", "description"), "ord").alias("_d"))
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    joined = params.join(docs, [*keys, "name"], "left")
    return joined.withColumns({"annotation": F.coalesce("annotation", blank("_d.type")), "description": F.col("_d.description")}).drop("_d")


def stub_paths(stubs: DataFrame, aliases: DataFrame) -> DataFrame:
    """stubs (path, ...), and once more under each alias (path, target) of a symbol or of what it stands in; a path's own stub goes first, then the first by path."""
    parts = F.split("path", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    below = stubs.withColumn("target", F.explode(above)).join(aliases.select(F.col("path").alias("_alias"), "target"), "target")
    reached = below.withColumn("_of", F.col("path")).withColumn("path", F.concat("_alias", F.expr("substring(path, length(target) + 1)"))).drop("target", "_alias")
    both = stubs.withColumn("_own", F.struct(F.lit(0).alias("own"), F.col("path").alias("of"))).unionByName(reached.withColumn("_own", F.struct(F.lit(1).alias("own"), F.col("_of").alias("of"))).drop("_of"))
    keep = [c for c in stubs.columns if c != "path"]
    return both.groupBy("path").agg(F.min_by(F.struct(*keep), "_own").alias("s")).select("path", "s.*")


def with_stubs(symbols: DataFrame, stubs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Symbols (path, origin, returns, doc_returns, ...) with what they return: as the source says, else the docstring, else the stub that
    stands at the published path, or else at the origin. aliases (path, target) of the stub package count as paths of their targets."""
    stubs = stubs if aliases is None else stub_paths(stubs.select("path", "returns"), aliases)
    by_path = stubs.select(F.col("path"), F.struct("returns").alias("_p"))
    by_origin = stubs.select(F.col("path").alias("origin"), F.struct("returns").alias("_o"))
    both = symbols.join(by_path, "path", "left").join(by_origin, "origin", "left").withColumn("_s", F.coalesce("_p", "_o"))
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    said = F.coalesce("returns", given("doc_returns"), given("_s.returns"))
    return both.withColumns({"returns": said, "stubbed": F.col("_s").isNotNull()}).drop("_p", "_o", "_s")


def documented_params(params: DataFrame, doc_params: DataFrame, stub_params: DataFrame, keys: list[str]) -> DataFrame:
    """Parameters (keys, ord, name, kind, annotation, default) with types by precedence: source, docstring, stub; and texts of the docstring."""
    found = with_doc_params(params, doc_params, keys)
    stub = stub_params.select(*keys, "name", F.nullif("annotation", F.lit("")).alias("_stub")).groupBy(*keys, "name").agg(F.max("_stub").alias("_stub"))
    return found.join(stub, [*keys, "name"], "left").withColumn("annotation", F.coalesce("annotation", "_stub")).drop("_stub")


def rendered(params: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, signature): the parameter list as the types now say. What is collected are the parameters of one function."""
    star = F.when(F.col("kind") == "var_positional", "*").when(F.col("kind") == "var_keyword", "**").otherwise("")
    typed = F.coalesce("annotation", F.lit("")) != ""
    default = F.when(F.col("default").isNull(), "").when(typed, F.concat(F.lit(" = "), "default")).otherwise(F.concat(F.lit("="), "default"))
    text = F.concat(star, "name", F.when(typed, F.concat(F.lit(": "), "annotation")).otherwise(""), default)
    listed = params.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "kind", text.alias("text")))).alias("p"))

    def marked(p: Column, i: Column) -> Column:
        before, after = F.get(F.col("p"), i - 1)["kind"], F.get(F.col("p"), i + 1)["kind"]
        no_star = ~F.exists(F.slice("p", F.lit(1), i), lambda q: q["kind"] == "var_positional")
        bare = (p["kind"] == "keyword") & no_star & ~F.coalesce(before == "keyword", F.lit(False))
        slash = (p["kind"] == "positional") & ~F.coalesce(after == "positional", F.lit(False))
        return F.concat(F.when(bare, "*, ").otherwise(""), p["text"], F.when(slash, ", /").otherwise(""))

    return listed.select(*keys, F.array_join(F.transform("p", marked), ", ").alias("signature"))


def return_notes(functions: DataFrame) -> DataFrame:
    """functions (returns, doc_returns, doc_yields, ...) with return_text: what the docstring says of what is returned, or of what is yielded if it says nothing of that."""
    return functions.withColumn("return_text", F.coalesce("doc_returns_text", F.when(F.col("doc_returns_text").isNull() & F.col("doc_returns").isNull(), F.col("doc_yields_text")), F.lit("")))


def all_kinds(**kinds: DataFrame) -> DataFrame:
    """(module, name, kind) of the tables of a module's functions, classes, exceptions and constants together."""
    parts = [df.select("module", "name", F.lit(kind).alias("kind")) for kind, df in kinds.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def module_content(modules: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """modules (module, docstring) with has_names (symbols of its own), re_exports (its aliases) and kept: one of both, or a docstring at the top level."""
    names = symbols.select("module").distinct().withColumn("_named", F.lit(True))
    again = aliases.groupBy("module").agg(F.count("*").alias("_re"))
    out = modules.join(names, "module", "left").join(again, "module", "left")
    out = out.withColumns({"has_names": F.coalesce("_named", F.lit(False)), "re_exports": F.coalesce("_re", F.lit(0))}).drop("_named", "_re")
    summary = (F.coalesce("docstring", F.lit("")) != "") & ~F.col("module").contains(".")
    return out.withColumn("kept", F.col("has_names") | (F.col("re_exports") > 0) | summary)


def merge_stub_members(base: DataFrame, stub: DataFrame, keys: list[str]) -> DataFrame:
    """Members of source and bundled stub: types of the stub first, texts and defaults of the source first, decorators of both; what only one has stays."""
    taken = ("annotation", "returns", "docstring", "value", "decorators")
    s = stub.select(*keys, *[F.col(c).alias(f"_{c}") for c in taken], F.lit(True).alias("_in_stub"))
    both = base.withColumn("_in_base", F.lit(True)).join(s, keys, "full_outer")
    first = lambda a, b: F.coalesce(a, b).alias(a.removeprefix("_"))
    columns = [first("_annotation", "annotation"), first("_returns", "returns"), F.coalesce("docstring", "_docstring").alias("docstring"), F.coalesce("value", "_value").alias("value")]
    return both.select(*keys, *columns, joined_decorators(F.col("decorators"), F.col("_decorators")).alias("decorators"), F.col("_in_base").isNull().alias("stub_only"))


def pair_files(sources: DataFrame, stubs: DataFrame, keys: list[str]) -> DataFrame:
    """Modules with their source and stub files; a folder's __init__ pairs only with one."""
    a = sources.select(*keys, "module", "is_init", F.col("path").alias("source_path"))
    b = stubs.select(*keys, "module", "is_init", F.col("path").alias("stub_path"))
    return a.join(b, [*keys, "module", "is_init"], "full_outer")


def work_list(files: DataFrame, keys: list[str]) -> DataFrame:
    """One file a module: __init__ files first, then by path."""
    first = Window.partitionBy(*keys, "module").orderBy(F.desc("is_init"), "path")
    return files.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def live_aliases(aliases: DataFrame, published: DataFrame) -> DataFrame:
    """Aliases whose target exists."""
    return aliases.join(published.select(F.col("path").alias("target")).distinct(), "target", "left_semi")


def listing(symbols: DataFrame, q: str = "", kind: str = "", limit: int = MOST_LISTED) -> DataFrame:
    """Symbols by path and kind whose path holds q in any case, of one kind if asked."""
    fit = symbols
    if q:
        fit = fit.filter(F.lower("path").contains(q.lower()))
    if kind:
        fit = fit.filter(F.col("kind") == kind)
    return fit.orderBy("path", "kind", "ord").limit(min(max(limit, 0), MOST_LISTED)).select("path", "kind", F.regexp_replace("signature", r"[\t\r\n]", " ").alias("signature"))


def below(symbols: DataFrame, aliases: DataFrame, prefix: str) -> DataFrame:
    """Symbols at or under a dotted prefix, and those that an alias there stands for."""
    at = F.lit(prefix)
    own = symbols.filter(names.under(F.col("path"), at)).withColumn("via", F.lit(None).cast("string"))
    there = aliases.filter(names.under(F.col("path"), at)).select(F.col("path").alias("via"), "target")
    reached = symbols.join(there, (F.col("path") == F.col("target"))).drop("target")
    return own.unionByName(reached.select(*own.columns))


def _steps(path: str) -> Column:
    """A dotted path and all paths above it."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def below_each(symbols: DataFrame, aliases: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, via, columns of symbols): `below` for any number of prefixes (prefix).

    What is at or below a prefix has it among the paths above it, so each symbol and alias meets its prefixes in an equi-join of as many rows as
    paths have parts; nothing is compared with all prefixes. A path above more than HOT rows would fill one task, so such paths, of which there are few,
    are met where the rows are, and all others by key. The empty prefix is above all.
    """
    asked = spread(prefixes.select("prefix"), "prefix").distinct()
    root = F.broadcast(asked.filter("prefix = ''"))  # one row at most
    named = asked.filter("prefix <> ''")

    def met(rows: DataFrame) -> DataFrame:
        above = rows.select(F.explode(F.slice(_steps("path"), 1, F.size(F.split("path", r"\.")) - 1)).alias("prefix"))
        hot = above.groupBy("prefix").count().filter(F.col("count") > HOT).select("prefix")
        steps = rows.withColumn("prefix", F.explode(_steps("path")))
        here = steps.join(F.broadcast(met_by_key(named).join(hot, "prefix", "left_semi")), "prefix")
        others = spread(steps.join(F.broadcast(hot), "prefix", "left_anti"), "prefix").join(met_by_key(named), "prefix")
        return others.unionByName(here).unionByName(rows.crossJoin(root))

    own = met(symbols).withColumn("via", F.lit(None).cast("string"))
    there = met(aliases.select("path", "target")).select(F.col("path").alias("via"), "target", "prefix")
    reached = spread(symbols, "path").join(met_by_key(spread(there, "target")), F.col("path") == F.col("target"))
    columns = ["prefix", "via", *symbols.columns]
    return own.select(*columns).unionByName(reached.select(*columns))


def resolve(paths: DataFrame, symbols: DataFrame) -> DataFrame:
    """The longest symbol at or above each dotted path, by joining its exploded prefixes instead of comparing all pairs."""
    prefixes = paths.select("dotted", F.explode(_steps("dotted")).alias("path"))
    hits = prefixes.join(met_by_key(symbols.select("path", "kind")), "path")
    return hits.groupBy("dotted").agg(F.max_by(F.struct("path", "kind"), F.length("path")).alias("s")).select("dotted", "s.*")


def palette(symbols: DataFrame, each: int = 8) -> DataFrame:
    """The first few symbols of each kind."""
    place = Window.partitionBy("kind").orderBy("path", "ord")
    return symbols.withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= each).drop("_r")


def fuzzy(symbols: DataFrame, q: str, threshold: float = 0.4) -> DataFrame:
    """Symbols whose name or path is near a query: contained, or by edit distance relative to the longer of the two."""
    low = F.lit(q.lower())
    off = lambda c: F.levenshtein(F.lower(c), low) / F.greatest(F.length(c), F.length(low), F.lit(1))
    score = F.when(F.lower("path").contains(q.lower()), 0.0).otherwise(F.least(off(F.col("name")), off(F.col("path"))))
    return symbols.withColumn("score", score).filter(F.col("score") <= threshold).orderBy("score", "path")
