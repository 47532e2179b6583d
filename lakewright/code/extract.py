"""Symbols, imports and export lists of Python modules.

A module's source goes through the standard parser. Where it fails, top-level statements
are parsed in runs, and in one that has an error the statement around it is blanked,
so that one bad statement costs itself alone; how many were lost is counted.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _A, _B, _I = T.StringType(), T.ArrayType(T.StringType()), T.BooleanType(), T.IntegerType()
PARAM = T.StructType([T.StructField(n, _S) for n in ("name", "kind", "annotation", "default")])
SYMBOL = T.StructType([
    T.StructField("path", _S), T.StructField("parent", _S), T.StructField("name", _S), T.StructField("kind", _S), T.StructField("ord", _I), T.StructField("signature", _S),
    T.StructField("params", T.ArrayType(PARAM)), T.StructField("returns", _S), T.StructField("annotation", _S), T.StructField("value", _S), T.StructField("docstring", _S),
    T.StructField("decorators", _A), T.StructField("bases", _A), T.StructField("instance", _B), T.StructField("public", _B),
])
IMPORT = T.StructType([T.StructField("source", _S), T.StructField("level", _I), T.StructField("name", _S), T.StructField("alias", _S), T.StructField("star", _B)])
MODULE = T.StructType([
    T.StructField("docstring", _S), T.StructField("exports", _A), T.StructField("export_refs", _A), T.StructField("dynamic_exports", _B), T.StructField("parse_errors", _I),
    T.StructField("symbols", T.ArrayType(SYMBOL)), T.StructField("imports", T.ArrayType(IMPORT)),
])
#: Decorators that make a property, and names of dataclass fields that make no parameter.
PROPERTY = ("property", "cached_property", "abstractproperty")


#: What the parser says where a text ends inside brackets or a string.
_OPEN = re.compile(r"was never closed|unterminated triple-quoted|EOF in multi-line|unexpected EOF")
_FAILURES = (SyntaxError, ValueError, RecursionError, MemoryError)


def parse(source: str) -> tuple[ast.Module, int]:
    """(tree, statements lost).

    A sound source is parsed once. Of any other, growing runs of top-level statements are parsed; a run that fails is
    cut before the statement with the error, and that one is mended alone. So an error costs what stands around it, not the module.
    """
    try:
        return ast.parse(source), 0
    except _FAILURES:
        pass
    lines = source.split("\n")
    starts = _starts(lines)
    if not starts:
        return ast.Module([], []), 1
    lost = int(any(x.strip() and not x.lstrip().startswith("#") for x in lines[: starts[0]]))
    body, more = _runs(lines, starts, len(lines))
    return ast.Module(body, []), lost + more


def _runs(lines: list[str], starts: list[int], end: int, margin: str = "") -> tuple[list[ast.stmt], int]:
    """(the statements that begin at some lines, statements lost); all of them have one margin."""
    body: list[ast.stmt] = []
    lost = 0
    ends = [*starts[1:], end]
    k, run = 0, 16
    while k < len(starts):
        stop = min(k + run, len(starts))
        found, error = _attempt(lines, starts[k], ends[stop - 1], margin)
        if found is None and stop - k > 1:
            line = getattr(error, "lineno", None)
            cut = max(bisect_right(starts, starts[k] + line - 1 - bool(margin)) - 1, k) if line else k
            stop, run = min(cut, stop - 1), 1
            found = _attempt(lines, starts[k], starts[stop], margin)[0] if stop > k else None
            if found is None:
                continue
        elif found is None:
            width = 1
            while found is None and _OPEN.search(str(error)) and k + width < len(starts):  # what stands in brackets or a string may begin at the margin
                width *= 2
                stop = min(k + width, len(starts))
                found, error = _attempt(lines, starts[k], ends[stop - 1], margin)
            if found is None:
                stop = k + 1
                found, more = _mended(lines, starts[k], ends[k], margin)
                lost += more
            run = 1
        else:
            run *= 2
        body += found
        k = stop
    return body, lost


def _attempt(lines: list[str], start: int, end: int, margin: str = "") -> tuple[list[ast.stmt] | None, Exception | None]:
    """(the statements of some lines, with the numbers that they have in the module, or none; the error)."""
    head = ["if 1:"] if margin else []
    try:
        tree = ast.increment_lineno(ast.parse("\n".join(head + lines[start:end])), start - len(head))
        return tree.body[0].body if margin else tree.body, None
    except _FAILURES as error:
        return None, error


def _starts(lines: list[str], start: int = 0, end: int | None = None, margin: str = "") -> list[int]:
    """The lines at which statements of a margin begin, decorators included."""
    starts: list[int] = []
    decorated = False
    at = len(margin)
    for i in range(start, len(lines) if end is None else end):
        line = lines[i]
        if line.strip() and line.startswith(margin) and line[at] not in " \t#)]}" and not re.match(r"(else|elif|except|finally)\b", line[at:]):
            if not decorated:
                starts.append(i)
            decorated = line[at] == "@"
    return starts


#: Lines of a class from which on its members are mended one by one.
LONG_CLASS = 64


def _members(lines: list[str], start: int, end: int, margin: str) -> tuple[list[ast.stmt], int] | None:
    """A long class whose head is sound, with its members mended each for itself; none if it is something else."""
    at = start
    while at < end and not lines[at].startswith(f"{margin}class "):
        at += 1
    inner = next((x[: len(x) - len(x.lstrip())] for x in lines[at + 1 : end] if x.strip() and not x.lstrip().startswith("#")), "")
    if end - start < LONG_CLASS or at == end or not lines[at].rstrip().endswith(":") or len(inner) <= len(margin):
        return None
    found, _ = _attempt([*lines[: at + 1], f"{inner}pass"], start, at + 2, margin)
    starts = _starts(lines, at + 1, end, inner)
    if not found or len(found) != 1 or not starts:
        return None
    found[0].body, lost = _runs(lines, starts, end, inner)
    if not found[0].body:
        return None
    found[0].end_lineno = max(n.end_lineno for n in found[0].body)
    return found, lost


def _mended(lines: list[str], start: int, end: int, margin: str = "") -> tuple[list[ast.stmt], int]:
    """One statement, with `pass` in the place of each statement in it that an error is in; nothing where that does not help."""
    members = _members(lines, start, end, margin)
    if members is not None:
        return members
    lost, own = 0, lines[start:end]
    while True:
        found, error = _attempt(own, 0, len(own), margin)
        if found is not None:
            for n in found:
                ast.increment_lineno(n, start)
            return found, lost
        line = getattr(error, "lineno", None)
        line = line - bool(margin) if line else None
        at = min(max(line - 1, 0), len(own) - 1) if line else -1
        while at >= 0 and not own[at].strip():
            at -= 1
        if at < 0:
            return [], lost + 1
        depth = len(own[at]) - len(own[at].lstrip())
        stop = at + 1
        while stop < len(own) and (not own[stop].strip() or len(own[stop]) - len(own[stop].lstrip()) > depth):
            stop += 1
        blank = [" " * depth + "pass"] + [""] * (stop - at - 1)
        if own[at:stop] == blank:
            return [], lost + 1
        own = own[:at] + blank + own[stop:]
        lost += 1


class _Module:
    def __init__(self, module: str, source: str):
        self.module, self.source = module, source
        # columns of the tree count bytes: the lines as such, split once
        self.lines = [line + b"\n" for line in source.encode("utf-8", "surrogatepass").split(b"\n")]
        self.symbols: list[dict] = []
        self.imports: list[dict] = []
        self.exports: list[str] | None = None
        self.refs: list[str] = []
        self.dynamic = False

    def text(self, node: ast.AST | None) -> str | None:
        """An expression as written, on one line."""
        if node is None:
            return None
        segment = self.segment(node) or ast.unparse(node)
        return " ".join(segment.split()) if not isinstance(node, ast.Constant) else segment

    def segment(self, node: ast.AST) -> str:
        """What stands in the source for a node; its cost does not grow with the module."""
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            return self.lines[first][node.col_offset : node.end_col_offset].decode("utf-8", "surrogatepass")
        inner = self.lines[first + 1 : last]
        return b"".join([self.lines[first][node.col_offset :], *inner, self.lines[last][: node.end_col_offset]]).decode("utf-8", "surrogatepass")

    def add(self, parent: str, name: str, kind: str, **more) -> None:
        row = {"path": f"{parent}.{name}", "parent": parent, "name": name, "kind": kind, "ord": len(self.symbols)}
        self.symbols.append(row | more)

    def params(self, args: ast.arguments, bound: bool) -> list[dict]:
        out = []
        plain = [(a, "positional") for a in args.posonlyargs] + [(a, "any") for a in args.args]
        defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
        for (a, kind), d in zip(plain, defaults, strict=True):
            out.append((a, kind, d))
        if bound and out:
            out = out[1:]
        if args.vararg:
            out.append((args.vararg, "var_positional", None))
        out += [(a, "keyword", d) for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
        if args.kwarg:
            out.append((args.kwarg, "var_keyword", None))
        return [{"name": a.arg, "kind": k, "annotation": self.text(a.annotation), "default": self.text(d)} for a, k, d in out]

    def function(self, parent: str, node: ast.FunctionDef | ast.AsyncFunctionDef, in_class: bool) -> None:
        decorators = [self.text(d) for d in node.decorator_list]
        last = [d.split("(")[0].rsplit(".", 1)[-1] for d in decorators]
        if in_class and any(d in PROPERTY for d in last):
            self.add(parent, node.name, "property", annotation=self.text(node.returns), docstring=ast.get_docstring(node, clean=False), decorators=decorators)
            return
        if in_class and any(d in ("setter", "deleter") for d in last):
            return
        params = self.params(node.args, in_class and "staticmethod" not in last)
        sign = signature(node.name, params, self.text(node.returns), isinstance(node, ast.AsyncFunctionDef))
        kind = "overload" if "overload" in last else "method" if in_class else "function"
        self.add(parent, node.name, kind, signature=sign, params=params, returns=self.text(node.returns), docstring=ast.get_docstring(node, clean=False), decorators=decorators)
        if in_class and node.name in ("__init__", "__new__"):
            for sub in ast.walk(node):
                for target in sub.targets if isinstance(sub, ast.Assign) else [sub.target] if isinstance(sub, ast.AnnAssign) else []:
                    if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self":
                        note = self.text(sub.annotation) if isinstance(sub, ast.AnnAssign) else None
                        self.add(parent, target.attr, "attribute", annotation=note, value=self.text(sub.value), instance=True)

    def klass(self, parent: str, node: ast.ClassDef) -> None:
        path = f"{parent}.{node.name}"
        decorators, bases = [self.text(d) for d in node.decorator_list], [self.text(b) for b in node.bases]
        sign = f"class {node.name}" + (f"({', '.join(bases)})" if bases else "")
        self.add(parent, node.name, "class", signature=sign, docstring=ast.get_docstring(node, clean=False), decorators=decorators, bases=bases)
        if any(d.split("(")[0].rsplit(".", 1)[-1] == "dataclass" for d in decorators):
            self.dataclass(path, node)
        self.body(path, node.body, True)

    def dataclass(self, path: str, node: ast.ClassDef) -> None:
        """The constructor that a dataclass's fields make."""
        params, keyword = [], False
        for s in node.body:
            if not isinstance(s, ast.AnnAssign) or not isinstance(s.target, ast.Name):
                continue
            note = self.text(s.annotation) or ""
            head = note.split("[")[0].rsplit(".", 1)[-1]
            if head == "ClassVar":
                continue
            if head == "KW_ONLY":
                keyword = True
                continue
            options = {k.arg: k.value for k in s.value.keywords} if isinstance(s.value, ast.Call) and (self.text(s.value.func) or "").rsplit(".", 1)[-1] == "field" else None
            off = lambda name: options is not None and isinstance(options.get(name), ast.Constant) and options[name].value is False  # noqa: E731, B023
            if off("init"):
                continue
            own = options is not None and isinstance(options.get("kw_only"), ast.Constant) and options["kw_only"].value is True
            default = self.text(s.value) if options is None else self.text(options.get("default")) or ("..." if "default_factory" in options else None)
            inner = note[note.index("[") + 1 : -1] if head == "InitVar" and "[" in note else note
            params.append({"name": s.target.id, "kind": "keyword" if own or (keyword and not off("kw_only")) else "any", "annotation": inner, "default": default})
        params.sort(key=lambda p: p["kind"] == "keyword")
        self.add(path, "__init__", "dataclass_init", signature=signature("__init__", params, None, False), params=params)

    def assign(self, parent: str, target: ast.expr, note: ast.expr | None, value: ast.expr | None, in_class: bool) -> None:
        if isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self.assign(parent, t, None, None, in_class)
        elif isinstance(target, ast.Name):
            if target.id == "__all__" and not in_class:
                self.exports, self.refs, self.dynamic = [], [], False
                self.all_add(value)
            else:
                self.add(parent, target.id, "attribute", annotation=self.text(note), value=self.text(value), instance=False)

    def all_add(self, value: ast.expr | None) -> None:
        """Names of an expression that makes or extends __all__; what cannot be read makes the list open."""
        self.exports = self.exports if self.exports is not None else []
        if isinstance(value, (ast.List, ast.Tuple, ast.Set)):
            for e in value.elts:
                if isinstance(e, ast.Constant) and isinstance(e.value, str):
                    if e.value not in self.exports:
                        self.exports.append(e.value)
                elif isinstance(e, ast.Starred):
                    self.all_add(e.value)
                else:
                    self.dynamic = True
        elif isinstance(value, ast.BinOp) and isinstance(value.op, ast.Add):
            self.all_add(value.left)
            self.all_add(value.right)
        elif isinstance(value, ast.Attribute) and value.attr == "__all__":
            self.refs.append(self.text(value.value) or "")
        elif isinstance(value, ast.Call) and isinstance(value.func, ast.Name) and value.func.id in ("list", "tuple", "sorted") and len(value.args) == 1:
            self.all_add(value.args[0])
        else:
            self.dynamic = True

    def all_drop(self, value: ast.expr) -> None:
        if isinstance(value, (ast.List, ast.Tuple)):
            gone = [e.value for e in value.elts if isinstance(e, ast.Constant)]
        else:
            gone = [value.value] if isinstance(value, ast.Constant) else []
        self.exports = [n for n in self.exports or [] if n not in gone]

    def body(self, parent: str, statements: list[ast.stmt], in_class: bool) -> None:
        for i, s in enumerate(statements):
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.function(parent, s, in_class)
            elif isinstance(s, ast.ClassDef):
                self.klass(parent, s)
            elif isinstance(s, ast.Assign):
                for t in s.targets:
                    self.assign(parent, t, None, s.value, in_class)
            elif isinstance(s, ast.AnnAssign):
                self.assign(parent, s.target, s.annotation, s.value, in_class)
            elif isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name) and s.target.id == "__all__" and not in_class:
                (self.all_add if isinstance(s.op, ast.Add) else self.all_drop)(s.value)
            elif isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) and isinstance(s.value.func, ast.Attribute) and self.text(s.value.func.value) == "__all__" and s.value.args:
                arg = s.value.args[0]
                {"extend": self.all_add, "append": lambda a: self.all_add(ast.List([a])), "remove": self.all_drop}.get(s.value.func.attr, lambda _: None)(arg)
            elif isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str) and i and self.symbols and isinstance(statements[i - 1], (ast.Assign, ast.AnnAssign)):
                self.symbols[-1].setdefault("docstring", s.value.value)  # a string after an attribute describes it
            elif isinstance(s, ast.Import) and not in_class:
                self.imports += [{"source": a.name, "level": 0, "name": None, "alias": a.asname, "star": False} for a in s.names]
            elif isinstance(s, ast.ImportFrom) and not in_class:
                self.imports += [{"source": s.module or "", "level": s.level, "name": None if a.name == "*" else a.name, "alias": a.asname, "star": a.name == "*"} for a in s.names]
            elif hasattr(ast, "TypeAlias") and isinstance(s, ast.TypeAlias):
                self.add(parent, s.name.id, "type_alias", annotation="TypeAlias", value=self.text(s.value))
            elif isinstance(s, (ast.If, ast.Try, ast.With)):
                for part in (s.body, *(h.body for h in getattr(s, "handlers", [])), getattr(s, "orelse", []), getattr(s, "finalbody", [])):
                    self.body(parent, part, in_class)


def signature(name: str, params: list[dict], returns: str | None, is_async: bool) -> str:
    """A def line; / after the last positional-only, * before the first keyword-only without a *args."""
    parts: list[str] = []
    kinds = [p["kind"] for p in params]
    for i, p in enumerate(params):
        if p["kind"] == "keyword" and "var_positional" not in kinds[:i] and (i == 0 or kinds[i - 1] != "keyword"):
            parts.append("*")
        star = {"var_positional": "*", "var_keyword": "**"}.get(p["kind"], "")
        note = f": {p['annotation']}" if p["annotation"] else ""
        default = "" if p["default"] is None else f" = {p['default']}" if note else f"={p['default']}"
        parts.append(f"{star}{p['name']}{note}{default}")
        if p["kind"] == "positional" and (i + 1 == len(params) or kinds[i + 1] != "positional"):
            parts.append("/")
    return f"{'async ' * is_async}def {name}({', '.join(parts)})" + (f" -> {returns}" if returns else "")


def extract(module: str, source: str) -> dict:
    """Everything a module defines, imports and exports."""
    source = re.sub("\r\n?", "\n", source)
    tree, lost = parse(source)
    out = _Module(module, source)
    out.body(module, tree.body, False)
    for s in out.symbols:
        name = s["name"]
        if s["parent"] == module:
            s["public"] = name in out.exports if out.exports is not None and not out.dynamic else not name.startswith("_")
        else:
            s["public"] = not name.startswith("_") or (len(name) > 4 and name.startswith("__") and name.endswith("__"))
    rows = [{n: s.get(n) for n in SYMBOL.names} for s in out.symbols]
    docstring = ast.get_docstring(tree, clean=False) if tree.body else None
    return {"docstring": docstring, "exports": out.exports, "export_refs": out.refs, "dynamic_exports": out.dynamic, "parse_errors": lost, "symbols": rows, "imports": out.imports}


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.IntegerType: pa.int32()}[type(kind)]


#: Modules that are turned into Arrow at once.
AT_ONCE = 256


def only(*fields: str, symbols: tuple[str, ...] = ()) -> T.StructType:
    """The part of MODULE that a query reads: some of its fields, and of each symbol some."""
    own = T.ArrayType(T.StructType([SYMBOL[n] for n in symbols]))
    return T.StructType([T.StructField(n, own) if n == "symbols" and symbols else MODULE[n] for n in fields])


def modules(sources: DataFrame, module: str = "module", source: str = "source", parsed: T.StructType = MODULE) -> DataFrame:
    """sources with a struct `parsed` of each module, of the fields that are asked for (see `only`). One row in, one row out; Arrow batches, no shuffle."""
    fields = [f for f in sources.schema if f.name != source]
    names = [f.name for f in fields]
    kind = _arrow(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(a, AT_ONCE)
                found = [extract(m or "", s or "") for m, s in zip(part.column(module).to_pylist(), part.column(source).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(found, kind)], names=[*names, "parsed"])

    return sources.mapInArrow(run, T.StructType([*fields, T.StructField("parsed", parsed)]))


def symbols(parsed: DataFrame, keys: list[str]) -> DataFrame:
    return parsed.select(*keys, F.explode("parsed.symbols").alias("s")).select(*keys, "s.*")


def imports(parsed: DataFrame, keys: list[str]) -> DataFrame:
    return parsed.select(*keys, F.explode("parsed.imports").alias("i")).select(*keys, "i.*")


def parse_totals(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Files, statements lost, and files that lost any."""
    return parsed.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("parsed.parse_errors").cast("bigint").alias("errors"), F.count_if(F.col("parsed.parse_errors") > 0).alias("broken"))


class ExtractSymbols:
    """UDTF: SELECT * FROM extract_symbols('module', 'source')."""

    def eval(self, module: str, source: str):
        for s in extract(module, source)["symbols"]:
            yield s["path"], s["kind"], s["signature"], s["docstring"], s["public"]


def register(spark) -> None:
    """Makes extract_symbols a table function of the session."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("extract_symbols", udtf(ExtractSymbols, returnType="path string, kind string, signature string, docstring string, public boolean"))
