"""Phrase-prefix search: all words next to each other and in order in one field, the last as a prefix."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.porter import stem

#: Operators that are taken out of a query, in this order.
OPERATORS = ("OR", "AND", "NOT", "NEAR")


def sanitize(query: Column) -> Column:
    """Without quotes, and without operators that stand between blanks in all upper or all lower case."""
    out = F.replace(F.trim(query), F.lit('"'), F.lit(""))
    for op in OPERATORS:
        for word in (op, op.lower()):
            out = F.replace(out, F.lit(f" {word} "), F.lit(" "))
    return F.trim(out)


def sanitize_text(query: str) -> str:
    """The same for one query on the driver."""
    out = query.strip().replace('"', "")
    return reduce(lambda s, w: s.replace(f" {w} ", " "), [w for op in OPERATORS for w in (op, op.lower())], out).strip()


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, accents of Latin letters taken off."""
    plain = F.regexp_replace(F.lower(F.translate(text, _ACCENTED, _PLAIN)), r"\p{M}", "")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != "")


#: Latin letters with accents and the same without.
_ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñçÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝÑÇ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuyyncAAAAAAEEEEIIIIOOOOOUUUUYNC"


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems(words: pa.Array) -> pa.Array:
    """Each distinct word of a batch is stemmed once; the others stay numbers in Arrow, not objects."""
    flat = words.flatten().dictionary_encode()
    known = pa.array([None if w is None else stem(w) for w in flat.dictionary.to_pylist()], pa.string())
    ends = pc.cumulative_sum(pc.cast(pc.fill_null(pc.list_value_length(words), 0), pa.int32()))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.combine_chunks() if isinstance(ends, pa.ChunkedArray) else ends])
    return pa.ListArray.from_arrays(offsets, known.take(flat.indices), mask=words.is_null())


def matches(field: Column, query: list[str]) -> Column:
    """Whether a token array holds the query as a phrase, its last word as a prefix."""
    n = len(query)

    def here(word: Column, i: Column) -> Column:
        fits = [F.coalesce(F.get(field, i + k) == q, F.lit(False)) for k, q in enumerate(query[:-1])]
        return reduce(lambda a, b: a & b, fits, F.coalesce(F.get(field, i + n - 1).startswith(query[-1]), F.lit(False)))

    return F.exists(F.filter(field, here), lambda _: F.lit(True))


def search(packages: DataFrame, query: str, limit: int = 10, stemmed: bool = False) -> DataFrame:
    """Packages whose name or summary holds the query; the exact name first, then by downloads, ties by name.

    The scan keeps three columns and one filter; only the limit's rows are sorted. For many queries, see postings.
    """
    limit = min(max(limit, 1), 100)
    words = [w for w in _split(sanitize_text(query)) if w]
    if not words:
        return packages.limit(0)
    name, summary = tokens(F.col("name")), tokens(F.col("summary"))
    if stemmed:
        name, summary, words = stems(name), stems(summary), [stem(w) for w in words]
    exact = F.when(F.lower("name") == query.lower(), 0).otherwise(1)
    hits = packages.select("*", name.alias("_n"), summary.alias("_s")).filter(matches(F.col("_n"), words) | matches(F.col("_s"), words))
    return hits.orderBy(exact, F.desc("downloads"), "name").limit(limit).select(*packages.columns)


def _split(query: str) -> list[str]:
    import re
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    return [w for w in re.split(r"[\W_]+", plain) if w]


def postings(packages: DataFrame, stemmed: bool = False) -> DataFrame:
    """The inverted index: (token, name, field, pos); to be written bucketed or sorted by token."""
    parts = []
    for field in ("name", "summary"):
        words = tokens(F.col(field))
        words = stems(words) if stemmed else words
        parts.append(packages.select(F.col("name"), F.lit(field).alias("field"), F.posexplode(words).alias("pos", "token")))
    return parts[0].unionByName(parts[1]).select("token", "name", "field", "pos")


def write_postings(index: DataFrame, path: str, files: int | None = None) -> None:
    """Writes an index in ranges of tokens, sorted, so that a filter on tokens reads few files and few groups of rows of them."""
    dealt = index.repartitionByRange("token") if files is None else index.repartitionByRange(files, "token")
    dealt.sortWithinPartitions("token", "name").write.mode("overwrite").parquet(path)


def search_postings(index: DataFrame, packages: DataFrame, query: str, limit: int = 10, stemmed: bool = False) -> DataFrame:
    """The same search through the index: token by token, each a filter that is pushed to the scan."""
    words = _split(sanitize_text(query))
    words = [stem(w) for w in words] if stemmed else words
    if not words:
        return packages.limit(0)
    at = None
    for k, word in enumerate(words):
        fits = F.col("token").startswith(word) if k == len(words) - 1 else F.col("token") == word
        rows = index.filter(fits).select("name", "field", (F.col("pos") - k).alias("start")).distinct()
        at = rows if at is None else at.join(rows, ["name", "field", "start"], "left_semi")
    found = packages.join(at.select("name").distinct(), "name", "left_semi")
    exact = F.when(F.lower("name") == query.lower(), 0).otherwise(1)
    return found.orderBy(exact, F.desc("downloads"), "name").limit(min(max(limit, 1), 100)).select(*packages.columns)
