"""Docstrings: their style, and what their sections say."""

from __future__ import annotations

import inspect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Section names of the two sectioned styles, and the fields that tell the third.
NUMPY_SECTIONS = (
    "parameters", "params", "other parameters", "returns", "return", "yields", "yield", "receives", "raises", "raise", "warns",
    "warnings", "see also", "notes", "references", "examples", "attributes", "methods",
)
GOOGLE_SECTIONS = ("Args", "Arguments", "Returns", "Return", "Raises", "Yields", "Yield", "Examples", "Example", "Note", "Notes", "Attributes", "Todo", "References", "Parameters", "Params")
SPHINX_FIELDS = (":param ", ":type ", ":returns:", ":rtype:")
_NUMPY = r"(?im)^[ \t]*(" + "|".join(NUMPY_SECTIONS) + r")[ \t]*\n[ \t]*-{3,}[ \t]*$"
_GOOGLE = r"(?m)^\s*(" + "|".join(GOOGLE_SECTIONS) + r"):\s*$"

ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "type", "description")])
SAID = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "description")])
PARSED = T.StructType([
    T.StructField("style", T.StringType()), T.StructField("text", T.StringType()), T.StructField("params", T.ArrayType(ENTRY)),
    T.StructField("returns", SAID), T.StructField("yields", SAID), T.StructField("raises", T.ArrayType(SAID)),
])


def style(raw: Column) -> Column:
    """sphinx, numpy, google or plain, in this order."""
    sphinx = F.lit(False)
    for field in SPHINX_FIELDS:
        sphinx = sphinx | raw.contains(field)
    return F.when(sphinx, "sphinx").when(raw.rlike(_NUMPY), "numpy").when(raw.rlike(_GOOGLE), "google").otherwise("plain")


def style_of(raw: str) -> str:
    if any(f in raw for f in SPHINX_FIELDS):
        return "sphinx"
    return "numpy" if re.search(_NUMPY, raw) else "google" if re.search(_GOOGLE, raw) else "plain"


def clean(raw: str) -> str:
    """Without common indentation and blank ends, tabs as blanks."""
    return inspect.cleandoc(raw.expandtabs())


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def _blocks(lines: list[str]) -> Iterator[tuple[str, str]]:
    """(head, rest) of entries: a head has the least indentation, what is deeper belongs to it."""
    filled = [x for x in lines if x.strip()]
    if not filled:
        return
    base = min(map(_indent, filled))
    head, rest = "", []
    for line in filled:
        if _indent(line) == base:
            if head:
                yield head, " ".join(rest)
            head, rest = line.strip(), []
        else:
            rest.append(line.strip())
    yield head, " ".join(rest)


def _join(*parts: str) -> str:
    return " ".join(p for p in parts if p)


def _google(text: str) -> dict:
    out: dict = {"params": [], "returns": None, "yields": None, "raises": []}
    section, body = None, []

    def done() -> None:
        if section in ("Args", "Arguments", "Parameters", "Params"):
            for head, rest in _blocks(body):
                m = re.match(r"(\*{0,2}\w+)\s*(?:\(([^)]*)\))?\s*:\s*(.*)", head)
                if m:
                    out["params"].append((m[1].lstrip("*"), (m[2] or "").strip(), _join(m[3].strip(), rest)))
        elif section in ("Returns", "Return", "Yields", "Yield"):
            said = _join(*[x.strip() for x in body])
            m = re.match(r"([\w.\[\], |]+?):\s+(.*)", said, re.S)
            out["returns" if section[0] == "R" else "yields"] = ((m[1].strip(), m[2].strip()) if m else ("", said)) if said else None
        elif section == "Raises":
            for head, rest in _blocks(body):
                kind, _, why = head.partition(":")
                out["raises"].append((kind.strip(), _join(why.strip(), rest)))

    for line in text.split("\n"):
        m = re.fullmatch(r"\s*(" + "|".join(GOOGLE_SECTIONS) + r"):\s*", line)
        if m:
            done()
            section, body = m[1], []
        elif section:
            if line.strip() and _indent(line) == 0:
                done()
                section, body = None, []
            else:
                body.append(line)
    done()
    return out


def _numpy(text: str) -> dict:
    out: dict = {"params": [], "returns": None, "yields": None, "raises": []}
    lines = text.split("\n")
    heads = [i for i in range(len(lines) - 1) if lines[i].strip().lower() in NUMPY_SECTIONS and re.fullmatch(r"-{3,}", lines[i + 1].strip())]
    for i, end in zip(heads, [*heads[1:], len(lines)], strict=True):
        name, entries = lines[i].strip().lower(), list(_blocks(lines[i + 2 : end]))
        if name in ("parameters", "params", "other parameters"):
            for head, rest in entries:
                names, _, kind = head.partition(":")
                kind = re.sub(r",\s*optional\s*$", "", kind.strip())
                out["params"] += [(n.strip().lstrip("*"), kind, rest) for n in names.split(",") if n.strip()]
        elif name in ("returns", "return", "yields", "yield") and entries:
            head, rest = entries[0]
            kind = head.partition(":")[2].strip() or head
            out["returns" if name[0] == "r" else "yields"] = (kind, rest)
        elif name in ("raises", "raise"):
            out["raises"] += [(head, rest) for head, rest in entries]
    return out


def _sphinx(text: str) -> dict:
    params: dict[str, list[str]] = {}
    returns, raises, last = ["", ""], [], None
    said = False
    for line in text.split("\n"):
        m = re.match(r"\s*:(\w+)((?:\s+[^:]*)?):\s*(.*)", line)
        if m:
            field, arg, rest = m[1], m[2].split(), m[3].strip()
            last = None
            if field in ("param", "parameter", "arg", "argument") and arg:
                last = params.setdefault(arg[-1].lstrip("*"), ["", ""])
                last[0] = " ".join(arg[:-1]) or last[0]
                last[1] = rest
            elif field == "type" and arg:
                params.setdefault(arg[-1].lstrip("*"), ["", ""])[0] = rest
            elif field in ("returns", "return"):
                returns[1], last, said = rest, returns, True
            elif field == "rtype":
                returns[0], said = rest, True
            elif field in ("raises", "raise", "except", "exception"):
                last = [" ".join(arg), rest]
                raises.append(last)
        elif last is not None and line.strip():
            last[1] = _join(last[1], line.strip())
        else:
            last = None
    return {"params": [(n, t, d) for n, (t, d) in params.items()], "returns": tuple(returns) if said else None, "yields": None, "raises": [tuple(r) for r in raises]}


def parse(raw: str) -> dict:
    """Style, cleaned text, parameters, returns, yields and raises of a docstring."""
    text = clean(raw)
    kind = style_of(text)
    got = {"google": _google, "numpy": _numpy, "sphinx": _sphinx}.get(kind, lambda _: {"params": [], "returns": None, "yields": None, "raises": []})(text)
    return {"style": kind, "text": text} | got


def prose(raw: str) -> str:
    """The text without its structured sections and fields, blank lines at most one in a row."""
    text = clean(raw)
    kind, keep, skip = style_of(text), [], False
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if kind == "google":
            if re.fullmatch(r"\s*(Args|Arguments|Parameters|Params|Returns|Return|Yields|Yield|Raises):\s*", line):
                skip = True
                continue
            skip = skip and (not line.strip() or _indent(line) > 0)
        elif kind == "numpy":
            under = i + 1 < len(lines) and re.fullmatch(r"\s*-{3,}\s*", lines[i + 1])
            if under and line.strip().lower() in NUMPY_SECTIONS:
                skip = line.strip().lower() in ("parameters", "params", "other parameters", "returns", "return", "yields", "yield", "raises", "raise")
        elif kind == "sphinx":
            if re.match(r"\s*:(param|parameter|arg|argument|type|returns?|rtype|raises?|except|exception)\b[^:]*:", line):
                skip = True
                continue
            skip = skip and bool(line.strip()) and _indent(line) > 0
        if not skip:
            keep.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(keep)).strip()


def first_paragraph(text: str) -> str:
    """The first paragraph that is neither a title with its line nor a directive."""
    para: list[str] = []
    directive = False
    for raw in text.split("\n"):
        line = raw.strip()
        if not para and line.startswith(".. "):
            directive = True
        elif directive and (not line or raw[:1].isspace()):
            continue
        elif not line:
            directive = False
            if para:
                break
        elif len(para) <= 1 and re.fullmatch(r"([=\-~^\"'`#*+:._])\1{2,}", line):
            directive, para = False, []
        else:
            directive = False
            para.append(line)
    return "\n".join(para)


@F.pandas_udf(PARSED)
def parse_docstring(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(x or "") for x in raw], columns=PARSED.names)


@F.pandas_udf(T.StringType())
def docstring_prose(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else prose(x))


@F.pandas_udf(T.StringType())
def docstring_summary(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else first_paragraph(clean(x)))
