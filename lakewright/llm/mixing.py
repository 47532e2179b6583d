"""Mixing sources to target weights by hierarchical budgeting; DataFrame operations only.

Weights run down a tree of domains, languages and sources. A node's budget is dealt
to its children by weight; a child that has fewer tokens than its share gets all it
has, and what it leaves goes to its siblings. As a child's tokens are those of all
its leaves, a shortage first stays among siblings and reaches their parent's
siblings only if the whole parent runs short. Each leaf then gives the prefix of its
seeded epochs that fills its budget: an epoch is all its documents in an order of
their own, by hash of seed, epoch and id.

Leaves, languages and domains are aggregates of one row each; those of one parent are ordered in
one task, a narrow row for each source of a language at most, which sorts and spills where sources are
millions. In a leaf, tokens are added up by buckets of the hash first, and those by their first digit,
so that no task orders more than a bucket of one leaf, or 256 sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._work import Scratch, unused

#: Hex digits of the hash that make a bucket: 4096 of them in each leaf and epoch, 16 groups of 256.
DIGITS = 3
#: Fixed pattern: a token, for counting.
TOKEN = r"[^\x20\x09-\x0D]+"
#: Weights of the query's tree; what has none weighs 1. Domains are four groups of sources.
WEIGHTS = {"lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "domain": {"d0": 3, "d1": 2, "d2": 2, "d3": 1}}
SEED = 17
EPOCHS = 2
#: The budget as a share of all tokens, in thousandths.
PER_MILLE = 900
UNNAMED = "-"


def domain_of_source(source: Column) -> Column:
    """The query's domains: the number in a source's name modulo 4."""
    number = F.regexp_extract(source, r"([0-9]{1,9})", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("long") % 4).cast("string"))).otherwise(F.lit(UNNAMED))


def _named(name: Column) -> Column:
    return F.coalesce(name.cast("string"), F.lit(UNNAMED))


def _weight(level: str, name: Column, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1).cast("long")
    for key, w in sorted(weights.get(level, {}).items()):
        out = F.when(name == key, F.lit(w).cast("long")).otherwise(out)
    return out


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (parent, name, has, weight, budget of the parent) with `gets`: the parent's budget by weight, at most `has` each.

    In the order of has / weight the first ones get all they have while that is less than their share of what
    is left; the others share the rest. Whole numbers throughout; what rounding leaves goes to the largest remainders.
    """
    order = Window.partitionBy(*parent).orderBy((F.col("has") / F.col("weight")), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*parent)
    big = lambda c: F.col(c).cast("decimal(38,0)")
    nodes = nodes.withColumns({"has_before": F.coalesce(F.sum("has").over(before), F.lit(0)), "weight_left": F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    nodes = nodes.withColumn("full", big("has") * big("weight_left") <= (big("budget") - big("has_before")) * big("weight"))
    # the full ones come first: has / weight ascends, and so does what a unit of weight gets once all before are full
    nodes = nodes.withColumn("full", F.min(F.col("full").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("has"))).over(group), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(group)
    nodes = nodes.withColumns({"rest": F.col("budget") - taken, "open_weight": open_weight})
    nodes = nodes.withColumn("part", F.when(F.col("full"), F.col("has")).otherwise(F.expr("CAST(CAST(rest AS DECIMAL(38,0)) * weight div open_weight AS BIGINT)")))
    nodes = nodes.withColumn("remainder", F.when(F.col("full"), F.lit(-1)).otherwise(F.expr("CAST(CAST(rest AS DECIMAL(38,0)) * weight % open_weight AS BIGINT)")))
    spare = F.col("rest") - F.sum(F.when(~F.col("full"), F.col("part"))).over(group)
    place = F.row_number().over(Window.partitionBy(*parent).orderBy(F.desc("remainder"), name))
    nodes = nodes.withColumns({"spare": spare, "place": place})
    extra = F.when(~F.col("full") & (F.col("place") <= F.col("spare")) & (F.col("part") < F.col("has")), F.lit(1)).otherwise(F.lit(0))
    return nodes.withColumn("gets", F.col("part") + extra)


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], epochs: int, per_mille: int) -> DataFrame:
    """leaves (domain, lang, source, tokens) with `gets`, their token budgets."""
    has = (F.col("tokens") * epochs).alias("has")
    leaves = leaves.select("domain", "lang", "source", "tokens", has)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("has").alias("has"))
    domains = leaves.groupBy("domain").agg(F.sum("has").alias("has"), F.sum("tokens").alias("tokens"))
    domains = domains.withColumns({"all": F.lit(0), "budget": F.expr(f"sum(tokens) OVER () * {per_mille} div 1000"), "weight": _weight("domain", F.col("domain"), weights)}).drop("tokens")
    got = _share(domains, ["all"], "domain").select("domain", F.col("gets").alias("budget"))
    langs = langs.join(got, "domain").withColumn("weight", _weight("lang", F.col("lang"), weights))
    got = _share(langs, ["domain"], "lang").select("domain", "lang", F.col("gets").alias("budget"))
    sources = leaves.join(got, ["domain", "lang"]).withColumn("weight", _weight("source", F.col("source"), weights))
    return _share(sources, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", "gets")


def mix(
    spark: SparkSession,
    docs: DataFrame,
    weights: dict[str, dict[str, int]] = WEIGHTS,
    seed: int = SEED,
    epochs: int = EPOCHS,
    per_mille: int = PER_MILLE,
    domain: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens, take_tokens) of every document taken, once for each epoch.

    take_tokens is n_tokens but for the last document of a leaf, which is cut to the leaf's budget. The budget is
    per_mille thousandths of all tokens; a leaf gives at most `epochs` times what it has. weights: by level
    (domain, lang, source) and name, whole and positive; 1 for a name not listed. Null languages and sources are
    a name of their own, `-`. Null and blank texts have no tokens and are never taken; a text of any length counts whole. Rows of the
    same id and text stand next to each other in an epoch, each taken by itself; rows of an id but different texts likewise, the
    shorter first. Rows without an id stand last. Tokens are runs between blanks here, whatever a later tokenizer makes of them.
    An empty table gives an empty one; other columns do not matter, whatever their names.
    """
    rows, _ = _taken(spark, docs, weights, seed, epochs, per_mille, domain, id_col, text_col, lang_col, source_col)
    return rows.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "take_tokens")


def _taken(spark: SparkSession, docs: DataFrame, weights, seed: int, epochs: int, per_mille: int, domain: Column | None, id_col: str, text_col: str, lang_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(what `mix` returns, with th, a hash of the text; all rows with tokens as doc_id, domain, lang, source, n_tokens, th)."""
    source = _named(F.col(f"`{source_col}`"))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (domain_of_source(source) if domain is None else _named(domain)).alias("domain"),
        _named(F.col(f"`{lang_col}`")).alias("lang"),
        source.alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(TOKEN)), F.lit(0)).cast("long").alias("n_tokens"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("th"),
    ).filter("n_tokens > 0")
    scratch = Scratch(spark, "mixing")
    counted = rows = scratch.table(rows)
    leaf = ["domain", "lang", "source"]
    budgets = leaf_budgets(rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")), weights, epochs, per_mille)
    order = F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"), F.lit(":"), F.col("doc_id").cast("string")).cast("binary")), F.lit("g"))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("h", order).withColumn("bucket", F.substring("h", 1, DIGITS))
    key = [*leaf, "epoch", "bucket"]
    # tokens before each bucket, in whole epochs and in buckets of its own epoch
    buckets = rows.groupBy(*key).agg(F.sum("n_tokens").alias("n"))
    buckets = buckets.withColumn("group", F.substring("bucket", 1, 1))
    ahead = lambda n, keys, by: F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = buckets.groupBy(*leaf, "epoch", "group").agg(F.sum("n").alias("n")).withColumn("before", ahead("n", [*leaf, "epoch"], "group")).drop("n")
    buckets = buckets.withColumn("ahead", ahead("n", [*leaf, "epoch", "group"], "bucket")).join(groups, [*leaf, "epoch", "group"]).join(budgets, leaf)
    buckets = buckets.withColumn("left", F.col("gets") - F.col("tokens") * F.col("epoch") - F.col("before") - F.col("ahead")).filter("left > 0").select(*key, "left")
    rows = rows.join(buckets, key)
    inside = Window.partitionBy(*key).orderBy("h", "doc_id", "n_tokens", "th").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", F.col("left") - F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).filter("left > 0")
    return rows.select("doc_id", *leaf, "epoch", "n_tokens", F.least("n_tokens", "left").alias("take_tokens"), "th"), counted


def oracle_sql(weights: dict[str, dict[str, int]] = WEIGHTS, seed: int = SEED, epochs: int = EPOCHS, per_mille: int = PER_MILLE) -> str:
    """The same for DuckDB over the view documents."""

    def weight(level: str) -> str:
        cases = "".join(f" WHEN '{k}' THEN {w}" for k, w in sorted(weights.get(level, {}).items()))
        return f"CASE {level}{cases} ELSE 1 END" if cases else "1"

    def share(nodes: str, parent: str, name: str) -> str:
        return f"""
  SELECT *, part + CASE WHEN NOT is_full AND place <= rest - sum(CASE WHEN NOT is_full THEN part ELSE 0 END) OVER (PARTITION BY {parent}) AND part < has THEN 1 ELSE 0 END AS gets FROM (
  SELECT *, row_number() OVER (PARTITION BY {parent} ORDER BY remainder DESC, {name}) AS place FROM (
  SELECT *, CASE WHEN is_full THEN has ELSE rest * weight // open_weight END AS part, CASE WHEN is_full THEN -1 ELSE rest * weight % open_weight END AS remainder FROM (
  SELECT *, budget - sum(CASE WHEN is_full THEN has ELSE 0 END) OVER (PARTITION BY {parent}) AS rest, sum(CASE WHEN NOT is_full THEN weight END) OVER (PARTITION BY {parent}) AS open_weight FROM (
  SELECT *, min(fits) OVER (PARTITION BY {parent} ORDER BY has / weight, {name} ROWS UNBOUNDED PRECEDING) = 1 AS is_full FROM (
  SELECT *, (has * weight_left <= (budget - has_before) * weight)::INT AS fits FROM (
  SELECT *, coalesce(sum(has) OVER (PARTITION BY {parent} ORDER BY has / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS has_before,
    sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER (PARTITION BY {parent} ORDER BY has / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
  FROM ({nodes})))))))"""

    return f"""
WITH counted AS (
  SELECT doc_id, coalesce(lang, '{UNNAMED}') AS lang, coalesce(source, '{UNNAMED}') AS source,
    CASE WHEN regexp_extract(source, '([0-9]{{1,9}})', 1) <> '' THEN 'd' || (regexp_extract(source, '([0-9]{{1,9}})', 1)::BIGINT % 4) ELSE '{UNNAMED}' END AS domain,
    coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0) AS n_tokens FROM documents),
docs AS (SELECT * FROM counted WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {epochs} AS has FROM docs GROUP BY ALL),
domains AS ({share(f"SELECT domain, 0 AS top, sum(has)::BIGINT AS has, {weight('domain')} AS weight, (SELECT sum(tokens)::BIGINT * {per_mille} // 1000 FROM leaves) AS budget FROM leaves GROUP BY domain", "top", "domain")}),
langs AS ({share(f"SELECT l.domain, l.lang, sum(l.has)::BIGINT AS has, {weight('lang')} AS weight, any_value(d.gets)::BIGINT AS budget FROM leaves l JOIN domains d USING (domain) GROUP BY l.domain, l.lang", "domain", "lang")}),
sources AS ({share(f"SELECT l.domain, l.lang, l.source, l.tokens, l.has, {weight('source')} AS weight, g.gets::BIGINT AS budget FROM leaves l JOIN langs g USING (domain, lang)", "domain, lang", "source")}),
ordered AS (SELECT docs.*, epoch, coalesce(md5('{seed}:' || epoch || ':' || doc_id), 'g') AS h FROM docs, range({epochs}) e(epoch)),
placed AS (
  SELECT o.*, s.gets - s.tokens * o.epoch - coalesce(sum(o.n_tokens) OVER (PARTITION BY o.domain, o.lang, o.source, o.epoch ORDER BY h, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM ordered o JOIN sources s USING (domain, lang, source))
SELECT doc_id, domain, lang, source, epoch::INT AS epoch, n_tokens::BIGINT AS n_tokens, least(n_tokens, room)::BIGINT AS take_tokens FROM placed WHERE room > 0"""


def select_mixture(
    spark: SparkSession, docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, seed: int = SEED, per_mille: int = PER_MILLE, domain: Column | None = None,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """The documents of one epoch's mixture, with their columns; the last of a leaf is cut to its tokens, joined by single blanks.

    A row is known by its id and a hash of its text, language and source. Of rows that are equal in these, as many stay as were taken,
    so no leaf goes beyond its budget. Other columns stay as they are, whatever their names; the rest is as `mix` says.
    """
    taken, counted = _taken(spark, docs, weights, seed, 1, per_mille, domain, id_col, text_col, lang_col, source_col)
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    lang, source = _named(F.col(f"`{lang_col}`")), _named(F.col(f"`{source_col}`"))
    own, row, k, n, c, take, many = (unused(docs, f"_{x}") for x in ("id", "row", "key", "n", "count", "take", "many"))
    kind = [F.col("doc_id").alias(own), F.xxhash64("th", "lang", "source").alias(row)]
    # equal rows stand next to each other in a leaf, so all that are taken are whole but the last one
    taken = taken.groupBy(*kind).agg(F.max("n_tokens").alias(n), F.count("*").alias(c), F.min("take_tokens").alias(take))
    total = counted.groupBy(*kind).agg(F.count("*").alias(many)).filter(F.col(many) > 1)
    total = total.select(F.col(own).alias(f"{own}2"), F.col(row).alias(f"{row}2"), many)
    taken = taken.join(total, F.col(own).eqNullSafe(F.col(f"{own}2")) & (F.col(row) == F.col(f"{row}2")), "left").select(own, F.col(row).alias(k), n, c, take, many)
    taken = Scratch(spark, "mixture").table(taken)
    found = docs.withColumn(row, F.xxhash64(F.xxhash64(text), lang, source)).join(taken, key.eqNullSafe(F.col(own)) & (F.col(row) == F.col(k)))
    # of one kind of equal rows in a leaf at most, some stay or one is cut; those are counted off
    split = F.col(many).isNotNull() & ((F.col(c) < F.col(many)) | (F.col(take) < F.col(n)))
    if not taken.filter(split).isEmpty():
        place = unused(docs, "_place")
        several = found.filter(split).withColumn(place, F.row_number().over(Window.partitionBy(key, row).orderBy(F.lit(0)))).filter(F.col(place) <= F.col(c))
        several = several.withColumn(take, F.when(F.col(place) < F.col(c), F.col(n)).otherwise(F.col(take))).drop(place)
        found = found.filter(~split).unionByName(several)
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), 1, F.col(take).cast("int")), " ")
    return found.withColumn(text_col, F.when(F.col(take) < F.col(n), cut).otherwise(text)).select(*[F.col(f"`{x}`") for x in docs.columns])
