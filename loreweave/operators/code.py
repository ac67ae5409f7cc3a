"""Facts of source code: symbols, imports and calls with the definition they stand in, and differences of texts."""

from __future__ import annotations

import ast
import difflib
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plain_path
from ..session import table

FACTS = "id bigint, fact string, name string, owner string, line_no int, end_line int"


def python_facts(source: str) -> list[tuple[str, str, str, int, int]]:
    """(fact, name, owner, line, end) of each definition, import and call of a source text; nothing if it doesn't parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found = []
    stack: list[tuple[ast.AST, str]] = [(tree, "")]
    while stack:
        node, owner = stack.pop()
        inner = owner
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            inner = f"{owner}.{node.name}" if owner else node.name
            first = min([node.lineno, *(x.lineno for x in node.decorator_list)])
            found.append(("class" if isinstance(node, ast.ClassDef) else "function", node.name, owner, first, node.end_lineno or first))
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            module = getattr(node, "module", None) or ""
            found.extend(("import", f"{module}.{a.name}".strip("."), owner, node.lineno, node.end_lineno or node.lineno) for a in node.names)
        elif isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if name:
                found.append(("call", name, owner, node.lineno, node.end_lineno or node.lineno))
        stack.extend((c, inner) for c in ast.iter_child_nodes(node))
    return sorted(found, key=lambda f: (f[3], f[4], f[0], f[1]))


def facts(chunks: DataFrame) -> DataFrame:
    """Facts of every record with Python source; the parser needs the text as it is, so it runs per record in Arrow batches."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(key, *f) for key, text in zip(pdf["id"], pdf["content"]) for f in python_facts(text)]
            if rows:
                yield pd.DataFrame(rows, columns=["id", "fact", "name", "owner", "line_no", "end_line"])

    return chunks.where("id is not null and content is not null").select("id", "content").mapInPandas(parse, FACTS)


def _python(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("kind = 'code' and file_path like '%.py'").select("id", "project", plain_path(F.col("file_path")).alias("path"), "content").dropDuplicates(["id"])


def code_facts(spark: SparkSession, d: str) -> DataFrame:
    return facts(_python(spark, d))


def called_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of a project and how often it calls them: what is defined and never called, and what is called and not defined, too."""
    f = code_facts(spark, d).join(_python(spark, d).select("id", "project"), "id")
    defined = f.where("fact in ('function', 'class')").groupBy("project", "name").agg(F.count("*").alias("definitions"))
    called = f.where("fact = 'call'").groupBy("project", "name").agg(F.count("*").alias("calls"))
    both = defined.join(called, ["project", "name"], "full_outer").select("project", "name", F.coalesce("definitions", F.lit(0)).alias("definitions"), F.coalesce("calls", F.lit(0)).alias("calls"))
    status = F.when(F.col("definitions") == 0, "undefined").when(F.col("calls") == 0, "unused").when(F.col("definitions") > 1, "ambiguous").otherwise("linked")
    return both.withColumn("status", status)


def unified_diff(before: str | None, after: str | None, most: int) -> str:
    """Unified difference of two texts, cut to ``most`` characters."""
    lines = difflib.unified_diff((before or "").splitlines(), (after or "").splitlines(), "before", "after", lineterm="")
    return "\n".join(lines)[:most]


def diffs(pairs: DataFrame, key: str, before: str, after: str, most: int = 20_000) -> DataFrame:
    """Differences of the two texts of each row; a null text counts as empty."""

    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([unified_diff(x, y, most) for x, y in zip(a, b)], dtype=object)

    return pairs.select(key, diff(before, after).alias("diff"))


QUERIES = {"code_facts": code_facts, "called_symbols": called_symbols}
SQL: dict[str, str] = {}
