
from __future__ import annotations

import ast
import contextlib
import re
import signal
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jsread

#: What lines must look like.
NAME = r"[A-Za-z_$][\w$]*"
STATIC_IMPORT = r"""^\s*import\s+(?:(?:type\s+)?([^"']*?)\s+from\s+)?["']([^"']+)["']"""
REQUIRE = rf"""\b(?:const|let|var)\s+({NAME})\s*=\s*require\(\s*["']([^"']+)["']\s*\)"""
DYNAMIC_IMPORT = r"""\bimport\(\s*["']([^"']+)["']\s*\)"""
EXPORT = rf"^\s*export\s+(?:default\s+)?(?:async\s+)?(function|class|const|let|var|interface|type)\s+({NAME})"
EXPORT_LIST = r"^\s*export\s*\{([^}]+)\}"
FUNCTIONS = (
    rf"^\s*(?:export\s+)?(?:async\s+)?function\s+({NAME})\s*\([^)]*\)",
    rf"^\s*(?:export\s+)?(?:const|let|var)\s+({NAME})\s*=[^=]*=>",
    rf"^\s*(?:export\s+)?(?:const|let|var)\s+({NAME})\s*=\s*(?:async\s+)?function\b",
)
CLASS = rf"^\s*(?:export\s+)?class\s+({NAME})"
TYPES = rf"^\s*(?:export\s+)?(interface|type)\s+({NAME})"
PY_IMPORT, PY_FROM = r"^import\s+(\S.*)$", r"^from\s+([.\w]+)\s+import\s+(\S.*)$"
PY_CLASS, PY_DEF = r"^(\s*)class\s+([A-Za-z_]\w*)\s*(?:\([^)]*\))?:", r"^(\s*)(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\([^)]*\)\s*:"
ROUTE = r"""\b(?:app|router)\.(get|post|put|patch|delete)\(\s*["'](/[^"']*)["']"""
PY_ROUTE = r"""^\s*@\w+\.(get|post|put|patch|delete|route)\(\s*["'](/[^"']*)["']"""


def numbered(files: DataFrame) -> DataFrame:
    """Lines of files (path, content), from 1."""
    rows = files.select("path", F.posexplode(F.split("content", "\r\n|\r|\n")).alias("line", "text"))
    return rows.withColumn("line", F.col("line") + 1)


def _alias(part: Column) -> Column:
    """The last name of `a as b`."""
    return F.trim(F.element_at(F.split(F.trim(part), r"\s+as\s+"), -1))


def specifiers(clause: Column) -> Column:
    """31: names that an import clause binds: default, namespace, then those in braces."""
    first = F.trim(F.element_at(F.split(clause, ","), 1))
    default = F.when(first.rlike(f"^{NAME}$"), F.array(first))
    star = F.regexp_extract(clause, rf"\*\s+as\s+({NAME})", 1)
    named = F.filter(F.transform(F.split(F.regexp_extract(clause, r"\{([^}]+)\}", 1), ","), _alias), lambda x: x != "")
    none = F.expr("cast(array() as array<string>)")
    return F.concat(F.coalesce(default, none), F.when(star != "", F.array(star)).otherwise(none), named)


def js_imports(lines: DataFrame) -> DataFrame:
    """27: static, required and dynamic imports with what they bind and how sure they are."""
    text = F.col("text")
    near = lambda yes, no: F.when(F.col("source").startswith("."), yes).otherwise(no)
    found = lambda p, kind, source, names: lines.filter(text.rlike(p)).select("path", "line", F.lit(kind).alias("kind"), F.regexp_extract(text, p, source).alias("source"), names.alias("specifiers"))
    static = found(STATIC_IMPORT, "static", 2, specifiers(F.regexp_extract(text, STATIC_IMPORT, 1)))
    required = found(REQUIRE, "commonjs", 2, F.array(F.regexp_extract(text, REQUIRE, 1)))
    dynamic = found(DYNAMIC_IMPORT, "dynamic", 1, F.expr("cast(array() as array<string>)"))
    return static.union(required).withColumn("confidence", near(1.0, 0.9)).union(dynamic.withColumn("confidence", near(0.8, 0.2)))


def js_exports(lines: DataFrame) -> DataFrame:
    """27: names that a line exports, with their kind."""
    word = F.regexp_extract("text", EXPORT, 1)
    kind = F.when(word.isin("const", "let", "var"), "variable").otherwise(word)
    own = lines.filter(F.col("text").rlike(EXPORT)).select("path", "line", F.regexp_extract("text", EXPORT, 2).alias("name"), kind.alias("kind"))
    names = F.transform(F.split(F.regexp_extract("text", EXPORT_LIST, 1), ","), _alias)
    listed = lines.filter(F.col("text").rlike(EXPORT_LIST)).select("path", "line", F.explode(names).alias("name"), F.lit("unknown").alias("kind"))
    return own.union(listed.filter("name <> ''"))


def js_symbols(lines: DataFrame) -> DataFrame:
    """27, 28: functions, classes, interfaces and types; hooks and components by their names."""
    kinds = [(p, 1, "function") for p in FUNCTIONS] + [(CLASS, 1, "class"), (TYPES, 2, None)]
    out = None
    for pattern, group, kind in kinds:
        name = F.regexp_extract("text", pattern, group)
        what = F.lit(kind) if kind else F.regexp_extract("text", pattern, 1)
        rows = lines.filter(F.col("text").rlike(pattern)).select("path", "line", name.alias("name"), what.alias("kind"), F.trim("text").alias("signature"), F.col("text").rlike(r"^\s*export\b").alias("exported"))
        out = rows if out is None else out.union(rows)
    hook, pascal = F.col("name").rlike("^use[A-Z]"), (F.col("kind") == "function") & F.col("name").rlike("^[A-Z]")
    return out.withColumn("kind", F.when(hook & (F.col("kind") == "function"), "hook").when(pascal, "component").otherwise(F.col("kind"))).dropDuplicates(["path", "line", "name", "kind"])


def routes(lines: DataFrame) -> DataFrame:
    """36: HTTP routes with a literal path."""
    either = lambda g: F.coalesce(F.nullif(F.regexp_extract("text", ROUTE, g), F.lit("")), F.nullif(F.regexp_extract("text", PY_ROUTE, g), F.lit("")))
    return lines.select("path", "line", F.upper(either(1)).alias("method"), either(2).alias("route")).filter("route is not null")


def todo_warnings(lines: DataFrame) -> DataFrame:
    """30."""
    return lines.filter(F.col("text").rlike(r"(?i)\b(TODO|FIXME)\b")).select("path", "line")


def _python_by_lines(path: str, content: str) -> list[tuple]:
    """29: imports and symbols by patterns; a def is a method while the lines stay inside a class by indentation."""
    out, inside = [], None
    for number, line in enumerate(re.split(r"\r\n|\r|\n", content), 1):
        bare = line.strip()
        if inside is not None and bare and len(line) - len(line.lstrip()) <= inside:
            inside = None
        if m := re.match(PY_IMPORT, bare):
            out += [(path, number, "import", re.split(r"\s+as\s+", part.strip())[0], bare) for part in m[1].split(",") if part.strip()]
        if m := re.match(PY_FROM, bare):
            out.append((path, number, "import", m[1], bare))
        if m := re.match(PY_CLASS, line):
            inside = len(m[1])
            out.append((path, number, "class", m[2], bare))
        if m := re.match(PY_DEF, line):
            out.append((path, number, "method" if inside is not None and len(m[1]) > inside else "function", m[2], bare))
    return out


def _python_by_tree(path: str, content: str) -> list[tuple]:
    """33, 35: the same facts, and calls and bases, from the syntax tree."""
    tree, lines, out = ast.parse(content), content.splitlines(), []

    def walk(node: ast.AST, inside: bool) -> None:
        for child in ast.iter_child_nodes(node):
            at = getattr(child, "lineno", 0)
            text = lines[at - 1].strip() if 0 < at <= len(lines) else ""
            if isinstance(child, ast.Import):
                out.extend((path, at, "import", a.name, text) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.append((path, at, "import", "." * child.level + (child.module or ""), text))
            elif isinstance(child, ast.ClassDef):
                out.append((path, at, "class", child.name, text))
                out.extend((path, at, "inheritance", ast.unparse(b), text) for b in child.bases)
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append((path, at, "method" if inside else "function", child.name, text))
            elif isinstance(child, ast.Call) and isinstance(child.func, ast.Name | ast.Attribute):
                out.append((path, at, "call", ast.unparse(child.func), text))
            walk(child, isinstance(child, ast.ClassDef))

    walk(tree, False)
    return out


@contextlib.contextmanager
def _within(seconds: float) -> Iterator[None]:
    """46: raises TimeoutError in the worker after so many seconds."""

    def late(*_: object) -> None:
        raise TimeoutError

    old = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, old)


def _facts(files: DataFrame, first, second, most_chars: int, seconds: float, more: str = "") -> DataFrame:
    """Rows (path, line, kind, name, signature), and more, of the first engine, else of the second; a file that takes too long
    gives one row of kind `unparsed`. Files are parsed in as many tasks as there are partitions."""
    schema = "path string, line int, kind string, name string, signature string" + (more and ", " + more)
    fields = [f.split() for f in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                if content is None:
                    continue
                try:
                    with _within(seconds):
                        try:
                            rows += (first if len(content) <= most_chars else second)(path, content)
                        except (SyntaxError, ValueError, RecursionError):
                            rows += second(path, content)
                except TimeoutError:
                    rows.append((path, 0, "unparsed", "", "timeout"))
            yield pd.DataFrame({n: pd.Series([r[i] if i < len(r) else None for r in rows], dtype="Int32" if kind == "int" else object) for i, (n, kind) in enumerate(fields)})

    return files.select("path", "content").mapInPandas(run, schema)


def python_facts(files: DataFrame, engine: str = "tree", most_chars: int = 2_000_000, seconds: float = 5) -> DataFrame:
    """29, 33, 34, 35, 46: (path, line, kind, name, signature) of Python files (path, content).

    The tree engine falls back to patterns where a file doesn't parse or is over the size limit (34)."""
    return _facts(files, _python_by_tree if engine == "tree" else _python_by_lines, _python_by_lines, most_chars, seconds)


_JS = "form string, end int, exported boolean, scope string, specifiers array<string>"


def js_facts(files: DataFrame, most_chars: int = 2_000_000, seconds: float = 5) -> DataFrame:
    """32, 35, 36, 46: facts of JavaScript and TypeScript files (path, content), read by descent.

    Rows (path, line, kind, name, signature, form, end, exported, scope, specifiers): imports of any length with what they bind (form
    static, commonjs or dynamic), exports and re-exports, top-level functions, hooks, components, classes, variables and types with their last line, methods,
    bases, calls with the symbol they stand in, and routes. A file over the size limit or the time gives one row `unparsed`."""
    big = lambda path, content: [(path, 0, "unparsed", "", "size")]
    return _facts(files, jsread.facts, big, most_chars, seconds, _JS)


#: What decides where an object ends: whole strings, braces, escapes, and a quotation mark that isn't closed.
JSON_MARK = re.compile(r'"(?:\\.|[^"\\])*"|[{}]|\\.|"', re.S)


def _json_object(text: str | None) -> str | None:
    if text is None or (start := text.find("{")) < 0:
        return None
    depth = 0
    for m in JSON_MARK.finditer(text, start):
        mark = m[0]
        if mark == '"':
            return None
        if mark in "{}":
            depth += 1 if mark == "{" else -1
            if not depth:
                return text[start : m.end()]
    return None


def json_object(text: Column) -> Column:
    """64: the first balanced JSON object in noisy text; null without one. Texts that are one object, or hold none, don't go to Python."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([_json_object(x) for x in s], dtype=object)

    bare = F.trim(text)
    whole = bare.startswith("{") & bare.endswith("}") & F.try_parse_json(bare).isNotNull()
    return F.when(whole, bare).otherwise(F.pandas_udf(run, "string")(F.when(text.contains("{") & ~F.coalesce(whole, F.lit(False)), text)))
