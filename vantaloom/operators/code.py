"""Python sources: symbol chunks, structural facts and generation scores.

Parsing needs Python's own parser, so these operators map Arrow batches; nothing is
shuffled, and a source never meets another one.
"""

from __future__ import annotations

import ast
import os
import subprocess
import sys
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantaloom.sources.runtime import ship_package

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
# The lines before a class's fields and before its method signatures.
FIELDS_MARK, METHODS_MARK = "# 字段", "# 方法签名"

CHUNK_SCHEMA = "path string, ord int, kind string, qualname string, start_line int, end_line int, is_overview boolean, text string"


@dataclass
class Symbol:
    """One chunk of a source."""

    kind: str
    qualname: str
    start: int
    end: int
    text: str
    overview: bool = False


class SourceChunker:
    """Cuts one source into a module overview, functions, classes, methods and constants.

    Definitions within other statements (``if``, ``try``, ``with``) are not entered.
    """

    def __init__(self, path: str, source: str):
        self.path, self.source, self.lines = path, source, source.splitlines()
        self.symbols: list[Symbol] = []

    def run(self) -> list[Symbol]:
        try:
            tree = ast.parse(self.source)
        except (SyntaxError, ValueError):
            whole = f"[source {self.path}:1 | whole-file (parse failed)]\n{self.source}"
            return [Symbol("whole-file", "", 1, max(1, len(self.lines)), whole)]
        if doc := ast.get_docstring(tree):
            self.symbols.append(Symbol("module", "", 1, 1, f"[source {self.path}:1 | module overview]\n{doc}", True))
        self._visit(tree.body, (), False)
        return self.symbols

    def _visit(self, body: list[ast.stmt], outer: tuple[str, ...], of_class: bool) -> None:
        for node in body:
            if isinstance(node, FUNCTIONS):
                self._emit(node, "method" if of_class else "function", (*outer, node.name))
                self._visit(node.body, (*outer, node.name), False)
            elif isinstance(node, ast.ClassDef):
                self._overview(node, (*outer, node.name))
                self._visit(node.body, (*outer, node.name), True)
            elif isinstance(node, ast.Assign | ast.AnnAssign) and not of_class:
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                upper = [t.id for t in targets if isinstance(t, ast.Name) and t.id.isupper()]
                if upper:
                    self._emit(node, "constant", (",".join(upper),))

    def _span(self, node: ast.AST) -> tuple[int, int]:
        decorated = [d.lineno for d in getattr(node, "decorator_list", [])]
        return min([node.lineno, *decorated]), node.end_lineno or node.lineno

    def _decorators(self, node: ast.AST) -> list[str]:
        numbers = [n for d in getattr(node, "decorator_list", []) for n in range(d.lineno, (d.end_lineno or d.lineno) + 1)]
        return [self.lines[n - 1].strip() for n in numbers]

    def _head(self, node: ast.AST, kind: str, name: str) -> str:
        return "[source {}:{}-{} | {} {}]".format(self.path, *self._span(node), kind, name)

    def _emit(self, node: ast.AST, kind: str, name: tuple[str, ...]) -> None:
        full = ".".join(name)
        text = "\n".join([self._head(node, kind, full), *self._decorators(node), ast.get_source_segment(self.source, node) or ""])
        self.symbols.append(Symbol(kind, full, *self._span(node), text))

    def _overview(self, node: ast.ClassDef, name: tuple[str, ...]) -> None:
        sections = [self._decorators(node), [d] if (d := ast.get_docstring(node)) else []]
        segments = [ast.get_source_segment(self.source, x) for x in node.body if isinstance(x, ast.Assign | ast.AnnAssign)]
        signatures = [self.lines[x.lineno - 1].strip() for x in node.body if isinstance(x, FUNCTIONS)]
        for mark, own in ((FIELDS_MARK, [s.strip() for s in segments if s]), (METHODS_MARK, signatures)):
            sections.append([mark, *("    " + x for x in own)] if own else [])
        if any(sections):
            full = ".".join(name)
            self.symbols.append(Symbol("class", full, *self._span(node), "\n".join([self._head(node, "class", full), *sum(sections, [])])))


def _map(df: DataFrame, columns: list[str], schema: str, rows: Callable[..., Iterator[tuple]]) -> DataFrame:
    """Map rows to rows with plain Python, batch by batch."""
    ship_package(df.sparkSession)
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for args in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in rows(*args)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(arrow.types)], names=arrow.names)

    return df.select(*columns).mapInArrow(run, schema)


def python_chunks(sources: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Symbol chunks of Python sources (path, text)."""

    def rows(name: str, source: str | None) -> Iterator[tuple]:
        for i, s in enumerate(SourceChunker(name, source or "").run()):
            yield name, i, s.kind, s.qualname, s.start, s.end, s.overview, s.text

    return _map(sources, [path, text], CHUNK_SCHEMA, rows)


def find_symbol(chunks: DataFrame, name: str) -> DataFrame:
    """The first chunk of each source that defines a name."""
    own = chunks.where((F.substring_index("qualname", ".", -1) == name) | F.array_contains(F.split("qualname", ","), name))
    return own.groupBy("path").agg(F.min_by(F.struct("kind", "qualname", "start_line", "text"), "ord").alias("s")).select("path", "s.*")


class Facts:
    """Structural questions to one parsed source; comments and plain strings never answer them."""

    def __init__(self, tree: ast.Module):
        self.nodes = list(ast.walk(tree))
        self.constants = {}
        for node in self.nodes:
            if isinstance(node, ast.Assign | ast.AnnAssign) and isinstance(node.value, ast.Constant):
                for target in self._targets(node):
                    if isinstance(target, ast.Name):
                        self.constants[target.id] = node.value.value

    def all(self, *kinds: type) -> Iterator:
        return (n for n in self.nodes if isinstance(n, kinds))

    @staticmethod
    def _targets(node: ast.Assign | ast.AnnAssign) -> list[ast.expr]:
        return node.targets if isinstance(node, ast.Assign) else [node.target]

    @staticmethod
    def label(node: ast.expr | None) -> str | None:
        """The last name of an expression: of a name, an attribute, or the function of a call."""
        if isinstance(node, ast.Call):
            node = node.func
        return {ast.Name: lambda: node.id, ast.Attribute: lambda: node.attr}.get(type(node), lambda: None)()

    def holds(self, node: ast.expr, wanted) -> bool:
        """Whether an expression is the wanted literal, or a name bound to it; no value is wanted for None."""
        if wanted is None:
            return True
        if isinstance(node, ast.Name):
            return node.id in self.constants and self.constants[node.id] == wanted
        return isinstance(node, ast.Constant) and node.value == wanted

    def ask(self, check: dict) -> bool:
        """The answer to one check; ``not`` turns it around. An unknown kind raises ValueError."""
        answer = getattr(self, f"is_{check['kind']}", None)
        if answer is None:
            raise ValueError(f"unknown kind of check: {check['kind']}")
        return answer(check) != bool(check.get("not"))

    def is_import(self, c: dict) -> bool:
        return any(n.module == c.get("module") and set(c["names"]) <= {a.name for a in n.names} for n in self.all(ast.ImportFrom))

    def is_imports(self, c: dict) -> bool:
        return set(c["names"]) <= {a.name for n in self.all(ast.Import, ast.ImportFrom) for a in n.names}

    def is_call(self, c: dict) -> bool:
        return c["name"] in {self.label(n) for n in self.all(ast.Call)}

    def is_kwarg(self, c: dict) -> bool:
        return any(k.arg == c["name"] and self.holds(k.value, c.get("value")) for n in self.all(ast.Call) for k in n.keywords)

    def is_dict_entry(self, c: dict) -> bool:
        entries = (e for n in self.all(ast.Dict) for e in zip(n.keys, n.values, strict=True))
        return any(isinstance(k, ast.Constant) and k.value == c["key"] and self.holds(v, c.get("value")) for k, v in entries)

    def is_pair(self, c: dict) -> bool:
        return self.is_kwarg(c | {"name": c["key"]}) or self.is_dict_entry(c)

    def is_func(self, c: dict) -> bool:
        own = lambda f: {a.arg for a in [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs, f.args.vararg, f.args.kwarg] if a}
        return any(f.name == c["name"] and set(c.get("args") or ()) <= own(f) for f in self.all(*FUNCTIONS))

    def is_class(self, c: dict) -> bool:
        wanted = c.get("decorator")
        return any(n.name == c["name"] and (wanted is None or wanted in map(self.label, n.decorator_list)) for n in self.all(ast.ClassDef))

    def is_field(self, c: dict) -> bool:
        fields = lambda n: {self.label(t) for x in n.body if isinstance(x, ast.Assign | ast.AnnAssign) for t in self._targets(x)}
        return any(n.name == c["class"] and set(c["names"]) <= fields(n) for n in self.all(ast.ClassDef))

    def is_assign(self, c: dict) -> bool:
        method = c.get("method")
        within = self.nodes if method is None else [x for f in self.all(*FUNCTIONS) if f.name == method for x in ast.walk(f)]
        return any(self.label(t) == c["target"] and not isinstance(t, ast.Call) for n in within if isinstance(n, ast.Assign | ast.AnnAssign) for t in self._targets(n))

    def is_name(self, c: dict) -> bool:
        part = {ast.Name: "id", ast.Attribute: "attr", ast.keyword: "arg", ast.arg: "arg", ast.alias: "name", ast.ClassDef: "name", ast.FunctionDef: "name", ast.AsyncFunctionDef: "name"}
        used = {getattr(n, part[type(n)]) for n in self.nodes if type(n) in part}
        keys = {k.value for n in self.all(ast.Dict) for k in n.keys if isinstance(k, ast.Constant) and isinstance(k.value, str)}
        return c["name"] in used | keys

    def is_compare(self, c: dict) -> bool:
        return any({c["left"], c["right"]} <= {x.id for x in (n.left, *n.comparators) if isinstance(x, ast.Name)} for n in self.all(ast.Compare))

    def is_pow2_buggy(self, c: dict) -> bool:
        """``1 << n.bit_length()``, which is too large by a factor of two for powers of two."""
        bad = ast.dump(ast.parse("1 << n.bit_length()", mode="eval").body)
        return any(ast.dump(n) == bad for n in self.all(ast.BinOp))


def check_facts(code: str | None, facts: list[dict]) -> list[tuple[str, bool]]:
    """(desc, ok) of each fact: all its checks hold. Code that fails to parse, or is empty, holds none."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError):
        tree = None
    asked = Facts(tree) if tree is not None and tree.body else None
    return [(f["desc"], asked is not None and all(asked.ask(c) for c in f["checks"])) for f in facts]


def fact_table(answers: DataFrame, facts: dict[str, list[dict]] | list[dict], key: str = "task_id", code: str = "code") -> DataFrame:
    """(task_id, parses, fact, ok) for each fact of the task of a row; a list of facts is asked of every row."""

    def rows(name: str, text: str | None) -> Iterator[tuple]:
        try:
            parses = bool(ast.parse(text or "") is not None)
        except (SyntaxError, ValueError):
            parses = False
        for desc, ok in check_facts(text, facts if isinstance(facts, list) else facts.get(name, [])):
            yield name, parses, desc, ok

    return _map(answers, [key, code], "task_id string, parses boolean, fact string, ok boolean", rows)


def run_source(code: str, check: str | None = None, timeout: float = 10) -> dict:
    """Run a source in a child process, then an optional check; ``timed_out`` is apart from failure.

    Not part of any registered query: it runs code.
    """
    with tempfile.TemporaryDirectory() as folder:
        main = os.path.join(folder, "main.py")
        mark = os.path.join(folder, "passed")
        tail = f"\n{check}\nopen({mark!r}, 'w').close()\n" if check else ""
        with open(main, "w", encoding="utf-8") as f:
            f.write(code + tail)
        try:
            done = subprocess.run([sys.executable, main], capture_output=True, text=True, timeout=timeout, cwd=folder)
        except subprocess.TimeoutExpired:
            return {"ok": False, "timed_out": True, "check_ok": False, "out": "", "err": "timeout"}
        return {"ok": done.returncode == 0, "timed_out": False, "check_ok": os.path.exists(mark), "out": done.stdout, "err": done.stderr}


def generation_summary(results: DataFrame) -> DataFrame:
    """One row: parsed, facts hit, pass@1 over runnable tasks, timeouts, and fixes of failed runs.

    ``results``: task_id, parses, facts_hit, facts_all, runnable, run_ok, timed_out, fixed.
    """
    failed = "runnable and not run_ok and not timed_out"
    return results.agg(
        F.count("*").alias("n_tasks"), F.count_if("parses").alias("parsed"), F.sum("facts_hit").cast("long").alias("facts_hit"), F.sum("facts_all").cast("long").alias("facts_all"),
        F.round(F.coalesce(F.try_divide(F.sum("facts_hit").cast("double"), F.sum("facts_all")), F.lit(0.0)), 6).alias("fact_ratio"), F.count_if("runnable").alias("n_runnable"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.expr("runnable and run_ok")).cast("double"), F.count_if("runnable")), F.lit(0.0)), 6).alias("pass_at_1"),
        F.count_if(F.expr("runnable and timed_out")).alias("timeouts"), F.round(F.try_divide(F.count_if(F.expr(f"{failed} and fixed")).cast("double"), F.count_if(F.expr(failed))), 6).alias("fix_rate"),
    )
