"""The parse job: one Arrow pass that parses each snippet once and returns raw facts.

Every statistic over the facts is computed by Spark afterwards.
"""

from __future__ import annotations

import ast
import sys
import warnings
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

FACTS = T.StructType(
    [
        T.StructField("parse_ok", T.BooleanType()),
        T.StructField("names", T.ArrayType(T.StringType())),
        T.StructField("node_counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("func_lens", T.ArrayType(T.IntegerType())),
        T.StructField("max_depth", T.IntegerType()),
        T.StructField("n_import", T.LongType()),
        T.StructField("n_from", T.LongType()),
        T.StructField("pkgs", T.ArrayType(T.StringType())),
    ]
)
_FACTS_ARROW = pa.struct(
    [
        ("parse_ok", pa.bool_()),
        ("names", pa.list_(pa.string())),
        ("node_counts", pa.map_(pa.string(), pa.int64())),
        ("func_lens", pa.list_(pa.int32())),
        ("max_depth", pa.int32()),
        ("n_import", pa.int64()),
        ("n_from", pa.int64()),
        ("pkgs", pa.list_(pa.string())),
    ]
)

PYTHON_GRAMMAR = "%d.%d.%d" % sys.version_info[:3]


def facts_of(code: str) -> dict:
    """Facts of one snippet. The walk is iterative, so deep trees cost memory, never the stack."""
    facts = {
        "parse_ok": False, "names": [], "node_counts": [], "func_lens": [],
        "max_depth": 0, "n_import": 0, "n_from": 0, "pkgs": [],
    }
    try:
        root = ast.parse(code)
    except Exception:
        return facts
    counts: Counter = Counter()
    level = [root]
    depth = -1
    while level:
        depth += 1
        below = []
        kinds = list(map(type, level))
        counts.update(kinds)
        for node, kind in zip(level, kinds):
            if kind is ast.Name:
                facts["names"].append(node.id)
                # Its only child is a context without children.
                below.append(node.ctx)
                continue
            if kind is ast.alias:
                facts["names"].append(node.asname or node.name.rpartition(".")[2])
            elif kind is ast.FunctionDef or kind is ast.AsyncFunctionDef:
                facts["func_lens"].append(node.body[-1].end_lineno + 1 - node.lineno)
            elif kind is ast.Import:
                facts["n_import"] += 1
                facts["pkgs"] += [a.name.partition(".")[0] for a in node.names]
            elif kind is ast.ImportFrom:
                facts["n_from"] += 1
                facts["pkgs"].append((node.module or "").partition(".")[0])
            for name in kind._fields:
                value = getattr(node, name, None)
                if isinstance(value, list):
                    below += [v for v in value if isinstance(v, ast.AST)]
                elif isinstance(value, ast.AST):
                    below.append(value)
        level = below
    facts.update(parse_ok=True, max_depth=depth, node_counts=[(kind.__name__, n) for kind, n in counts.items()])
    return facts


@F.arrow_udf(FACTS)
def _parse(codes: pa.Array) -> pa.Array:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return pa.array([facts_of(code.as_py()) for code in codes], type=_FACTS_ARROW)


def syntax_facts(normalised_code: Column | str) -> Column:
    """Facts struct of newline-normalised, non-null code."""
    return _parse(normalised_code)


def with_syntax_facts(df: DataFrame, code: str = "code", out: str = "facts") -> DataFrame:
    from snippetry.functions.text import normalise_newlines

    return df.withColumn(out, syntax_facts(normalise_newlines(F.col(code))))
