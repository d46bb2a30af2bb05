"""Running a decoder over a DataFrame: valid rows, issues, or both."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.core import Decoder, published
from ..sources import json as json_source
from ..sources.nodes import Json, Typed
from .issues import explode_issues
from .outcome import NO_ISSUES, issue, let, unbound

VALUE, ISSUES = "value", "issues"


@dataclass(frozen=True)
class Result:
    """`all` has the input's columns, value (null where there are issues) and issues; input columns of these
    two names give way."""

    all: DataFrame
    inputs: tuple[str, ...]

    def valid(self, expand: bool = True) -> DataFrame:
        good = self.all.where(F.size(ISSUES) == 0)
        kind = good.schema[VALUE].dataType
        if expand and kind.typeName() == "struct":
            return good.select(*(F.col(f"{VALUE}.`{n}`").alias(n) for n in kind.names))
        return good.select(VALUE)

    def issues(self, *keys: str) -> DataFrame:
        """A row per issue with the key columns of its input row."""
        return explode_issues(self.all, ISSUES, *keys)


def _with_outcome(df: DataFrame, own: list[str], outcome: Column) -> Result:
    """`own` columns, value and issues. A projection makes the outcome, with generated code, and it goes through a generator
    of one row: filters on value or issues and functions of them then read it, where without one they would
    evaluate it anew; filters on other columns still get below."""
    kept = [c for c in own if c not in (VALUE, ISSUES)]
    columns = [F.col(f"`{c}`") for c in kept]
    held = "_outcome"
    while held in own:
        held += "_"
    with patient(df.sparkSession):
        return Result(df.select(*columns, outcome.alias(held)).select(*columns, F.inline(F.array(held)).alias(VALUE, ISSUES)), tuple(kept))


@contextmanager
def patient(spark: SparkSession, rounds: int = 2000):
    """Each bound outcome takes the analyser a round to resolve, and a long chain more than it has by default."""
    name = "spark.sql.analyzer.maxIterations"
    before = spark.conf.get(name)
    spark.conf.set(name, max(rounds, int(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _run(df: DataFrame, decoder: Decoder, node) -> Result:
    def outcome() -> Column:
        made = decoder.compile(node)
        if made.whole is not None:
            return let(made.whole, lambda p: F.struct(p.getField("value").alias(VALUE), published(p.getField("issues")).alias(ISSUES)))
        return F.struct(made.value.alias(VALUE), published(made.issues()).alias(ISSUES))

    try:
        return _with_outcome(df, df.columns, outcome())
    except AnalysisException as e:
        if not of_python(e):
            raise
        with unbound():
            return _with_python(df, df.columns, outcome())


def of_python(e: AnalysisException) -> bool:
    """Whether a plan was refused for a Python function in it: a normal form, or a caller's own."""
    return "PYTHON_UDF" in (e.getCondition() or "") or "Python UDF" in str(e)


def _with_python(df: DataFrame, own: list[str], outcome: Column) -> Result:
    kept = [c for c in own if c not in (VALUE, ISSUES)]
    out = df.withColumn("_outcome", outcome).select(*(F.col(f"`{c}`") for c in kept), F.col("_outcome.value").alias(VALUE), F.col("_outcome.issues").alias(ISSUES))
    return Result(out, tuple(kept))


def decode(df: DataFrame, decoder: Decoder, column: str | None = None) -> Result:
    """Decodes a typed column, or the whole row as an object."""
    if column is not None:
        return _run(df, decoder, Typed(df[column], df.schema[column].dataType))
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return _run(df, decoder, Typed(row, df.schema))


def decode_json(df: DataFrame, decoder: Decoder, column: str, lossless: bool = False, limit: int | None = None) -> Result:
    """Decodes a column of JSON text. Text that is not JSON (null included) is one issue at the root,
    with line and column in lossless mode. Rows over `limit` bytes are no matter of issues: they are
    marked by the column `too_large` and neither read nor told about."""
    if limit is not None and limit < 0:
        raise ValueError("a limit cannot be negative")
    text = F.col(column).cast("string")
    own = df.columns
    if limit is not None:
        df = df.withColumn("too_large", F.coalesce(F.octet_length(text) > limit, F.lit(False)))
        own = df.columns
        text = F.when(~F.col("too_large"), text)
    tree = (json_source.lossless if lossless else json_source.fast)(text)
    refusal = lambda at: F.array(issue("invalid_format", (), at, "invalid_format.json"))
    if lossless:
        not_json = let(json_source.place(text), lambda at: refusal({"line": at["line"].cast("string"), "column": at["column"].cast("string")}))
    else:
        not_json = refusal({})

    def closed(root: Json, value: Column, issues: Column) -> Column:
        issues = F.when(root.missing, not_json).otherwise(published(issues))
        if limit is not None:
            issues = F.when(~F.col("too_large"), issues).otherwise(F.expr(NO_ISSUES))
        return F.struct(F.when(~root.missing, value).alias(VALUE), issues.alias(ISSUES))

    def judged(root: Json) -> Column:
        return let(decoder.compile(root).packed(), lambda made: closed(root, made.getField("value"), made.getField("issues")))

    try:
        return _with_outcome(df, own, Json(tree, lossless).bound(judged))
    except AnalysisException as e:
        if not of_python(e):
            raise
        root = Json(F.col("_tree"), lossless, bind=False)
        with unbound():
            made = decoder.compile(root)
        return _with_python(df.withColumn("_tree", tree), own, closed(root, made.value, made.issues()))


def outcome_column(decoder: Decoder, column: Column, dtype) -> Column:
    """struct(value, issues) for use inside other expressions."""
    return decoder.compile(Typed(column, dtype)).packed()
