"""Operators over program source and texts that need Python's own parsers: symbols, review, diffs, fuzzy blocks."""

from __future__ import annotations

import ast
import difflib
import hashlib
import hmac
import shlex
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.session import ship

SYMBOLS = "file string, type string, name string, line long, docstring string, args array<string>, decorators array<string>, bases array<string>"
ISSUES = "file string, line long, severity string, message string"
#: Fixed value: a function longer than this many lines is reported.
LONG_FUNCTION = 50


def _name(node: ast.AST) -> str:
    return ast.unparse(node)


def symbols_of(file: str, source: str) -> list[tuple]:
    """Classes and functions in order of appearance; none of what doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            is_class = isinstance(node, ast.ClassDef)
            args = [] if is_class else [a.arg for a in node.args.args]
            out.append((file, "class" if is_class else "function", node.name, node.lineno, ast.get_docstring(node), args, [_name(d) for d in node.decorator_list], [_name(b) for b in node.bases] if is_class else []))
    return sorted(out, key=lambda r: (r[3], r[2]))


def review(file: str, source: str) -> list[tuple]:
    """Unused imports, functions without docstring, long functions and magic numbers; never an error."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(file, int(getattr(e, "lineno", 0) or 0), "warning", "does not parse")]
    out, used = [], {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)}
    for node in ast.walk(tree):
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            out += [(file, node.lineno, "warning", f"unused import {a.asname or a.name}") for a in node.names if (a.asname or a.name).split(".")[0] not in used]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            if ast.get_docstring(node) is None and not node.name.startswith("_"):
                out.append((file, node.lineno, "info", f"no docstring: {node.name}"))
            if (node.end_lineno or node.lineno) - node.lineno + 1 > LONG_FUNCTION:
                out.append((file, node.lineno, "warning", f"long function: {node.name}"))
        elif isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool) and abs(node.value) > 100:
            out.append((file, node.lineno, "info", f"magic number {node.value}"))
    return sorted(out, key=lambda r: (r[1], r[3]))


def _map(files: DataFrame, f, schema: str) -> DataFrame:
    ship(files.sparkSession)
    names = [c.strip().split(" ")[0] for c in schema.replace("array<string>", "arr").split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([r for file, source in zip(pdf.file, pdf.source.fillna("")) for r in f(file, source)], columns=names)

    return files.select("file", "source").mapInPandas(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    """A row for each class and function of files (file, source)."""
    return _map(files, symbols_of, SYMBOLS)


def code_review(files: DataFrame) -> DataFrame:
    """A row for each finding in files (file, source)."""
    return _map(files, review, ISSUES)


def unified_diff(old: Column, new: Column, context: int = 3) -> Column:
    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(difflib.unified_diff((x or "").split("\n"), (y or "").split("\n"), "a", "b", n=context, lineterm="")) for x, y in zip(a, b)])

    return diff(old, new)


def fuzzy_block(text: Column, block: str, least: float = 0.8) -> Column:
    """First line and ratio of the window of lines most like a block, both compared without trailing white space and with tabs as spaces."""
    wanted = [x.rstrip().replace("\t", "    ") for x in block.split("\n")]
    n = len(wanted)

    block = "\n".join(wanted)
    names = sorted(set(block))
    most = np.array([block.count(c) for c in names], dtype=np.int64)
    at = np.full(0x110000, len(names), dtype=np.uint8 if len(names) < 256 else np.int32)
    at[[ord(c) for c in names]] = np.arange(len(names))

    def bounds(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each n lines from a line on: the characters that they share with the block, whatever the order, and all of both; twice the one by the other bounds the ratio, as ``quick_ratio`` does."""
        sizes = np.array([len(x) for x in rows], dtype=np.int64)
        points = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        width = len(names) + 1
        cells = np.repeat(np.arange(len(rows)) * width, sizes) + at[points]
        counts = np.bincount(cells, minlength=len(rows) * width).reshape(len(rows), width)[:, :-1]
        k = min(n, len(rows))
        runs = lambda x: np.concatenate([np.zeros_like(x[:1]), np.cumsum(x, axis=0)])
        sums, lengths = runs(counts), runs(sizes)
        sums, lengths = sums[k:] - sums[:-k], lengths[k:] - lengths[:-k] + k - 1
        if "\n" in names:
            sums[:, names.index("\n")] += k - 1
        return np.minimum(sums, most).sum(axis=1), lengths + len(block)

    @F.pandas_udf("line long, ratio double")
    def best(texts: pd.Series) -> pd.DataFrame:
        out = []
        matcher, known = difflib.SequenceMatcher(autojunk=False), {}  # ratios of texts of this batch
        matcher.set_seq2(block)
        for t in texts:
            rows = [x.rstrip().replace("\t", "    ") for x in (t or "").split("\n")]
            shared, both = bounds(rows)
            bound = np.where(both > 0, 2.0 * shared / np.maximum(both, 1), 1.0)
            found = (-1, 0.0)
            for k in np.lexsort((np.arange(len(bound)), -bound)).tolist():  # the likeliest first; of equal ratios the first line counts
                if bound[k] < found[1] or bound[k] == 0:
                    break
                if bound[k] == found[1] and k > found[0]:
                    continue
                own = "\n".join(rows[k : k + n])
                if own not in known:
                    matcher.set_seq1(own)
                    known[own] = matcher.ratio()
                if known[own] > found[1] or (known[own] == found[1] > 0 and k < found[0]):
                    found = (k, known[own])
            out.append(found if found[1] >= least else (-1, found[1]))
        return pd.DataFrame(out, columns=["line", "ratio"])

    return best(text)


def hmac_hex(text: Column, key: str, algorithm: str = "sha256") -> Column:
    @F.pandas_udf("string")
    def sign(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hmac.new(key.encode(), x.encode(), getattr(hashlib, algorithm)).hexdigest())

    return sign(text)


def command_split(text: Column) -> Column:
    """Words of a command line with quotes; plain white space where quotes don't close."""

    @F.pandas_udf("array<string>")
    def split(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[str]:
            try:
                return shlex.split(x or "")
            except ValueError:
                return (x or "").split()

        return s.map(one)

    return split(text)


def changed_range(old: Column, new: Column) -> Column:
    """(start, old_end, new_end) of what differs between two texts: without their common prefix and suffix."""

    @F.pandas_udf("start long, old_end long, new_end long")
    def span(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a.fillna(""), b.fillna("")):
            n = min(len(x), len(y))
            s = next((k for k in range(n) if x[k] != y[k]), n)
            e = next((k for k in range(n - s) if x[-1 - k] != y[-1 - k]), n - s)
            out.append((s, len(x) - e, len(y) - e))
        return pd.DataFrame(out, columns=["start", "old_end", "new_end"])

    return span(old, new)
