"""Operators as SQL functions: what has no built-in expression, registered for a session's SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.similarity import DIFF, matched_ratio, matched_percent, word_differences
from foliospark.operators.code import formatted_as
from foliospark.operators.tables import table_markdown

#: Names under which the functions are registered, with their arguments.
FUNCTIONS = ("sm_ratio(a, b)", "matched_share(a, b)", "html_table_to_md(html)", "format_code_as(class, text, json_form)", "word_diff(words_a, words_b)", "round_as_read(value, digits)")


def by_row(f: Callable) -> Callable:
    """A function of single values as one of columns; a row with a null gives a null."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns)])

    return run


def register(spark: SparkSession) -> tuple[str, ...]:
    """Make the functions callable in spark.sql(...); nulls give nulls. Returns their signatures.

    sm_ratio: ratio of the sequence matcher; matched_share: percentage of a in matching blocks; html_table_to_md: an HTML table as a pipe table;
    format_code_as: a piece of code laid out by its class; word_diff: differences of two arrays of words; round_as_read: a double
    rounded by its exact value, ties to even.
    """
    names = [c.split()[0] for c in DIFF.split(", ")]
    of = T.StructType([T.StructField(n, T.StringType() if c.endswith("string") else T.IntegerType()) for n, c in zip(names, DIFF.split(", "))])
    functions = {
        "sm_ratio": (matched_ratio, T.DoubleType()), "matched_share": (matched_percent, T.DoubleType()), "html_table_to_md": (table_markdown, T.StringType()),
        "format_code_as": (lambda kind, text, form: formatted_as(kind, text, form) or formatted_as("plain", text, ""), T.StringType()),
        "word_diff": (lambda a, b: [dict(zip(names, d)) for d in word_differences(list(a), list(b))], T.ArrayType(of)),
        "round_as_read": (lambda value, digits: float(round(value, int(digits))), T.DoubleType()),
    }
    for name, (f, kind) in functions.items():
        spark.udf.register(name, F.pandas_udf(by_row(f), kind))
    return FUNCTIONS
