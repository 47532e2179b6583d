"""Package, version, module and archive names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns: names and versions that are accepted.
NAME = r"^[a-zA-Z0-9]([a-zA-Z0-9._-]*[a-zA-Z0-9])?$"
VERSION = r"^[a-zA-Z0-9][a-zA-Z0-9._+!~-]*$"
MOST_VERSION = 128
#: Name stems of test modules and folders, and of files that run a build.
TEST_DIRS = ("tests", "test")
SCRIPTS = ("setup", "conftest", "ez_setup", "distribute_setup")
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*$"


def valid_name(name: Column) -> Column:
    """Whether a name may be looked up: the allowed characters, no two dots in a row."""
    return F.coalesce(name.rlike(NAME) & ~name.contains(".."), F.lit(False))


def valid_version(version: Column) -> Column:
    return F.coalesce(version.rlike(VERSION) & (F.length(version) <= MOST_VERSION), F.lit(False))


def import_name(name: Column) -> Column:
    """The module that a distribution name suggests."""
    return F.translate(F.lower(name), "-.", "__")


def module_name(path: Column) -> Column:
    """a/b/c.py -> a.b.c; a folder's __init__ is the folder."""
    plain = F.regexp_replace(path, r"\.pyi?$", "")
    return F.regexp_replace(F.regexp_replace(plain, r"(^|/)__init__$", ""), "/", ".")


def source_path(path: Column) -> Column:
    """Where the source of a stub file stands: .pyi -> .py, x_stubs/ or x-stubs/ -> x/."""
    return F.regexp_replace(F.regexp_replace(path, r"\.pyi$", ".py"), r"^([^/]+?)[-_]stubs/", "$1/")


def cache_key(family: str, name: Column, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(family), F.lower(name), *parts)


def is_dunder(name: Column) -> Column:
    return (F.length(name) > 4) & name.startswith("__") & name.endswith("__")


def is_private_member(name: Column) -> Column:
    return name.startswith("_") & ~is_dunder(name)


def is_public(name: Column, exports: Column) -> Column:
    """By the export list if there is one, else by the leading underscore."""
    return F.when(exports.isNotNull(), F.array_contains(exports, name)).otherwise(~name.startswith("_"))


def under(path: Column, prefix: Column) -> Column:
    """Whether a dotted path is the prefix or below it; all are below the empty one."""
    return (F.coalesce(prefix, F.lit("")) == "") | (path == prefix) | path.startswith(F.concat(prefix, F.lit(".")))


def is_test_module(path: Column, has_test_files: Column | bool = True) -> Column:
    """Test files by name, and all of a tests folder that holds some; the first segment never counts as such a folder."""
    parts = F.split(path, "/")
    base = F.element_at(parts, -1)
    named = base.rlike(r"^test_.*\.pyi?$") | base.rlike(r"_test\.pyi?$") | base.rlike(r"^(conftest|tests)\.pyi?$")
    folders = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    return (F.size(parts) > 1) & (named | (F.lit(has_test_files) & F.exists(folders, lambda p: p.isin(*TEST_DIRS))))


def is_private_module(path: Column) -> Column:
    """Whether any segment but the first begins with an underscore; __init__ files do not count."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.startswith("_") & ~p.rlike(r"^__init__\.pyi?$"))


def importable_path(path: Column) -> Column:
    """Files of a source archive that can be imported: identifiers all the way, no build scripts at the top."""
    parts = F.split(F.regexp_replace(path, r"\.pyi?$", ""), "/")
    scripts = (F.size(parts) == 1) & parts[0].isin(*SCRIPTS)
    tests = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(*TEST_DIRS, "docs", "doc", "examples"))
    return path.rlike(r"\.pyi?$") & F.forall(parts, lambda p: p.rlike(IDENTIFIER)) & ~scripts & ~tests


def safe_path(path: Column) -> Column:
    """Archive members that stay inside the folder they are unpacked to."""
    return ~(path.startswith("/") | path.contains("\\") | path.contains("\0") | F.exists(F.split(path, "/"), lambda p: p == ".."))
