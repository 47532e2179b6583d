"""Requirement specifiers, licences, maintainers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns: the extra a marker names, and the first character of a constraint without parentheses.
EXTRA = r'extra\s*==\s*"([^"]+)"'
OPERATOR = "[><=!~]"
#: Which operators give a lower bound, in the order they are asked.
LOWER_BOUNDS = (">=", "~=", "===", "==", ">")


def strip_extras(name: Column) -> Column:
    return F.when(name.endswith("]"), F.trim(F.regexp_replace(name, r"(?s)\[.*$", ""))).otherwise(name)


def requirement(raw: Column) -> Column:
    """struct(name, constraint, extra): extra is null for what is always required.

    Forms, in the order tried: `name @ url`, `name (constraint)`, `name<op>constraint`, bare name.
    """
    spec = F.trim(F.substring_index(raw, ";", 1))
    marker = F.when(raw.contains(";"), F.regexp_replace(raw, r"(?s)^[^;]*;", ""))
    at, opened = F.instr(spec, "@"), F.instr(spec, "(")
    shut = F.length(spec) - F.instr(F.reverse(spec), ")") + 1
    op = F.length(F.regexp_extract(spec, f"(?s)^(.*?){OPERATOR}", 1)) + 1
    has_op = spec.rlike(OPERATOR)
    cut = F.when(at > 1, at).when(opened > 0, opened).when(has_op, op)
    name = F.when(cut.isNull(), spec).otherwise(F.substring(spec, F.lit(1), cut - 1))
    constraint = (
        F.when(at > 1, F.substring(spec, at + 1, F.length(spec)))
        .when(opened > 0, F.when(spec.contains(")") & (shut > opened), F.substring(spec, opened + 1, shut - opened - 1)).otherwise(""))
        .when(has_op, F.substring(spec, op, F.length(spec)))
        .otherwise("")
    )
    extra = F.when(marker.rlike(EXTRA), F.regexp_extract(marker, EXTRA, 1))
    return F.struct(strip_extras(F.trim(name)).alias("name"), F.trim(constraint).alias("constraint"), extra.alias("extra"))


def dependency_tree(requires: Column) -> Column:
    """struct(required, extras): requirements in order, those of an extra under its name."""
    parsed = F.transform(F.coalesce(requires, F.array().cast("array<string>")), requirement)
    plain = lambda d: F.struct(d["name"].alias("name"), d["constraint"].alias("constraint"))
    required = F.transform(F.filter(parsed, lambda d: d["extra"].isNull()), plain)
    extras = F.array_distinct(F.transform(F.filter(parsed, lambda d: d["extra"].isNotNull()), lambda d: d["extra"]))
    grouped = F.transform(extras, lambda e: F.struct(e, F.transform(F.filter(parsed, lambda d: d["extra"] == e), plain)))
    return F.struct(required.alias("required"), F.map_from_entries(grouped).alias("extras"))


def python_minimum(requires_python: Column) -> Column:
    """The lower bound of a specifier: by operator in order, the first clause that has it; a trailing .* goes."""
    clauses = F.transform(F.split(requires_python, ","), lambda x: F.trim(x))
    found = []
    for op in LOWER_BOUNDS:
        first = F.try_element_at(F.filter(clauses, lambda c: c.startswith(op)), F.lit(1))
        value = F.regexp_replace(F.trim(F.substring(first, F.lit(len(op) + 1), F.length(first))), r"\.\*$", "")
        found.append(F.when(value != "", value))
    return F.coalesce(*found, F.lit(""))


def license_name(expression: Column, classifiers: Column, raw: Column) -> Column:
    """The expression, else the last part of the first licence classifier of three parts, else the field if short, else its first line."""
    of_class = F.try_element_at(F.filter(classifiers, lambda c: c.startswith("License :: ") & (F.size(F.split(c, " :: ")) >= 3)), F.lit(1))
    text = F.trim(raw)
    lines = F.transform(F.split(text, "\n", 5), lambda x: F.trim(x))
    first = F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(1))
    return F.coalesce(
        F.when(F.trim(expression) != "", F.trim(expression)),
        F.element_at(F.split(of_class, " :: "), -1),
        F.when((text != "") & (F.octet_length(text) <= 128), text),
        F.when(F.octet_length(first) <= 80, first),
        F.lit(""),
    )


def split_names(names: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(names, F.lit("")), "[,;]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def split_emails(field: Column) -> Column:
    """Entries of an address list. A comma ends one only outside <> and after something with @ or >.

    One left fold over the comma-separated pieces: a piece joins the entry before it as long as that one is not complete.
    """
    pieces = F.split(F.coalesce(field, F.lit("")), ",")
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    whole = lambda s: (count(s, "<") <= count(s, ">")) & (F.trim(s) != "") & (s.contains("@") | s.contains(">"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, piece: Column) -> Column:
        now = F.when(acc["open"].isNull(), piece).otherwise(F.concat(acc["open"], F.lit(","), piece))
        return F.when(whole(now), F.struct(F.array_append(acc["done"], now).alias("done"), F.lit(None).cast("string").alias("open"))).otherwise(
            F.struct(acc["done"].alias("done"), now.alias("open"))
        )

    return F.aggregate(pieces, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def _entry(entry: Column, fallback: Column) -> Column:
    angle = r"(?s)^(.*?)\s*<([^>]+)>\s*$"
    name = F.when(entry.rlike(angle), F.trim(F.regexp_extract(entry, angle, 1))).when(entry.contains("@"), "").otherwise(entry)
    email = F.when(entry.rlike(angle), F.trim(F.regexp_extract(entry, angle, 2))).when(entry.contains("@"), entry).otherwise("")
    return F.struct(F.when((name == "") & fallback.isNotNull(), fallback).otherwise(name).alias("name"), email.alias("email"))


def _of_emails(emails: Column, names: Column) -> Column:
    named = split_names(names)
    entries = F.transform(split_emails(emails), lambda e, i: F.when(F.trim(e) != "", _entry(F.trim(e), F.get(named, i))))
    return F.filter(entries, lambda m: m.isNotNull() & ((m["name"] != "") | (m["email"] != "")))


def maintainers(author: Column, author_email: Column, maintainer: Column, maintainer_email: Column) -> Column:
    """array of (name, email): from the author's addresses, else the author's names, else the maintainer's likewise."""
    of_names = lambda c: F.transform(split_names(c), lambda n: F.struct(n.alias("name"), F.lit("").alias("email")))
    some = lambda a: F.when(F.size(a) > 0, a)
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(given(author_email) & (F.size(_of_emails(author_email, author)) > 0), _of_emails(author_email, author))
        .when(given(author), of_names(author))
        .otherwise(F.coalesce(F.when(given(maintainer_email), some(_of_emails(maintainer_email, maintainer))), F.when(given(maintainer), of_names(maintainer))))
    )
