"""URL allow-lists, and project links by key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schemes of links, raster images that a data URL may hold, and keys of project links in order.
LINK_SCHEMES = ("", "http", "https", "mailto", "ftp", "tel")
RASTER = ("image/png;", "image/gif;", "image/jpeg;", "image/webp;")
DOC_KEYS = ("documentation", "docs", "doc")
REPO_KEYS = ("source", "source code", "repository", "homepage", "github")
GITHUB_KEYS = ("source", "repository", "source code", "github", "homepage", "code")
GITLAB_KEYS = ("source", "repository", "source code", "gitlab", "homepage", "code")
#: Fixed patterns: an owner and a repository, and a project path.
GITHUB = r"(?i)github\.com[/:]([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)"
GITLAB = r"(?i)gitlab\.com/([A-Za-z0-9_.\-/]+?)(?:\.git|/?$)"


def _usable(url: Column) -> Column:
    return url.isNotNull() & ~url.rlike(r"[\x00-\x1F\x7F]") & ~url.startswith(":")


def scheme(url: Column) -> Column:
    """The lower-case scheme, empty for a relative URL, null for one with control characters or an empty scheme."""
    url = F.regexp_replace(url, r"^\s+|\s+$", "")
    return F.when(_usable(url), F.lower(F.regexp_extract(url, r"^([^:/?#]+):", 1)))


def is_link(url: Column) -> Column:
    return F.coalesce(scheme(url).isin(*LINK_SCHEMES), F.lit(False))


def is_image(url: Column) -> Column:
    rest = F.lower(F.regexp_replace(F.trim(url), r"^[^:]*:", ""))
    raster = F.lit(False)
    for prefix in RASTER:
        raster = raster | rest.startswith(prefix)
    return F.coalesce(scheme(url).isin("", "http", "https") | ((scheme(url) == "data") & raster), F.lit(False))


def safe_links(links: Column) -> Column:
    """A map of links without those that may not be one."""
    return F.map_filter(links, lambda _, url: is_link(url))


def by_key(links: Column, keys: tuple[str, ...], skip_blank: bool = False) -> Column:
    """The first of the keys, whatever their case; of keys that differ in case alone, the last in order of the key."""
    entries = F.transform(F.array_sort(F.map_entries(links)), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    found = []
    for key in keys:
        value = F.try_element_at(F.filter(entries, lambda e: e["k"] == key), F.lit(-1))["v"]
        found.append(F.when(value != "", value) if skip_blank else value)
    return F.coalesce(*found, F.lit(""))


def doc_url(links: Column) -> Column:
    return by_key(links, DOC_KEYS)


def repo_url(links: Column) -> Column:
    return by_key(links, REPO_KEYS, skip_blank=True)


def _candidates(links: Column, keys: tuple[str, ...]) -> Column:
    entries = F.array_sort(F.map_entries(links))
    named = F.array(*[F.try_element_at(F.filter(entries, lambda e: F.lower(e["key"]) == key), F.lit(-1))["value"] for key in keys])
    return F.filter(F.concat(named, F.transform(entries, lambda e: e["value"])), lambda v: v.isNotNull())


def github_repo(links: Column) -> Column:
    """struct(owner, repo) of the first link that has them: by key in order, then any; null without one."""
    hit = F.try_element_at(F.filter(_candidates(links, GITHUB_KEYS), lambda v: v.rlike(GITHUB)), F.lit(1))
    repo = F.regexp_replace(F.regexp_extract(hit, GITHUB, 2), r"\.git$", "")
    return F.when(hit.isNotNull(), F.struct(F.regexp_extract(hit, GITHUB, 1).alias("owner"), repo.alias("repo")))


def gitlab_path(links: Column) -> Column:
    """The project path of the first link with one that has a slash; null without."""
    paths = F.transform(F.filter(_candidates(links, GITLAB_KEYS), lambda v: v.rlike(GITLAB)), lambda v: F.regexp_replace(F.regexp_extract(v, GITLAB, 1), "/$", ""))
    return F.try_element_at(F.filter(paths, lambda p: p.contains("/")), F.lit(1))


def shown_links(links: Column, doc: Column, home: Column, home_label: str = "Index page") -> Column:
    """Links (array of struct(label, url)) with the documentation before them and the index page after them, unless their URLs are there."""
    missing = lambda url: ~F.exists(links, lambda link: link["url"] == url)
    entry = lambda label, url: F.array(F.struct(F.lit(label).alias("label"), url.alias("url")))
    none = F.array().cast("array<struct<label: string, url: string>>")
    before = F.when((F.coalesce(doc, F.lit("")) != "") & missing(doc), entry("Documentation", doc)).otherwise(none)
    # the page may be the documentation that was just put there
    after = F.when(missing(home) & ~((F.coalesce(doc, F.lit("")) != "") & (doc == home)), entry(home_label, home)).otherwise(none)
    return F.concat(before, links, after)
