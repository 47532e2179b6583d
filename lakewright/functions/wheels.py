"""Tags in archive file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHEEL, SDIST = "bdist_wheel", "sdist"
#: What marks a platform's own wheel.
PLATFORM = "manylinux|musllinux|macosx|win|linux"
FLAGS = ("pure_python", "linux_x86_64", "linux_arm64", "macos_x86_64", "macos_arm64", "windows_x86_64", "musl")


def _parts(filename: Column) -> Column:
    return F.split(F.regexp_replace(filename, r"\.whl$", ""), "-")


def platform_tag(filename: Column) -> Column:
    """The last of at least five parts, else empty."""
    parts = _parts(filename)
    return F.when(F.size(parts) >= 5, F.element_at(parts, -1)).otherwise("")


def is_platform_specific(platform: Column) -> Column:
    return F.lower(platform).rlike(PLATFORM)


def platform_flag(tag: Column, flag: str) -> Column:
    """Whether a platform tag speaks for one of FLAGS; of the families, the first that fits decides."""
    p = F.lower(tag)
    many, musl, mac = p.contains("manylinux"), p.contains("musllinux"), p.contains("macosx")
    linux_x86, linux_arm = many & p.contains("x86_64"), many & p.contains("aarch64")
    taken = (p == "any") | linux_x86 | linux_arm
    tests = {
        "pure_python": p == "any",
        "linux_x86_64": linux_x86,
        "linux_arm64": linux_arm & ~linux_x86,
        "musl": musl & ~taken,
        "macos_x86_64": mac & ~taken & ~musl & (p.contains("universal2") | p.contains("x86_64")),
        "macos_arm64": mac & ~taken & ~musl & (p.contains("universal2") | p.contains("arm64")),
        "windows_x86_64": (p.contains("win_amd64") | p.contains("win32")) & ~taken & ~musl & ~mac,
    }
    return tests[flag]


def module_format(filename: Column) -> Column:
    """python-abi-platform of a wheel, or platform-specific; null for names of fewer than five parts."""
    parts = _parts(filename)
    tag = F.array_join(F.slice(parts, F.size(parts) - 2, 3), "-")
    return F.when(F.size(parts) >= 5, F.when(is_platform_specific(F.element_at(parts, -1)), "platform-specific").otherwise(tag))


def is_pure(filename: Column) -> Column:
    return filename.contains("none-any")


def sdist_rank(filename: Column) -> Column:
    return F.when(filename.rlike(r"\.(tar\.gz|tgz)$"), 0).when(filename.endswith(".zip"), 1).otherwise(2)
