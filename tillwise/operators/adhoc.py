"""Ad-hoc SELECT texts over a set of tables, behind a gate."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

from tillwise.fixed_values import CLAUSE_ERROR, REFLECTIVE_WORDS, REFUSED_WORDS, SELECT_ERROR, TABLE_ERROR, WORD_ERROR

#: Views are swapped and texts analyzed by one thread at a time, so that calls never see each other's tables.
_ANALYSIS = Lock()
_FILES = "spark.sql.runSQLOnFiles"
#: Kinds of parsed plan nodes that a text may hold. All others are refused: table functions, scripts, commands, names from expressions.
_ALLOWED = {
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit",
    "Offset", "OneRowRelation", "Pivot", "Project", "Sample", "Sort", "SubqueryAlias", "Union", "Unpivot", "UnresolvedHaving",
    "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedWith",
    "Window", "WithWindowDefinition",
}
_REFUSED_EXPRESSIONS = {"ExpressionWithUnresolvedIdentifier"}


def check_select(text: str) -> str:
    """The trimmed text, or ValueError. A refused word counts anywhere, also inside a name."""
    trimmed = text.strip()
    upper = trimmed.upper()
    if not upper.startswith("SELECT"):
        raise ValueError(SELECT_ERROR)
    for word in REFUSED_WORDS + REFLECTIVE_WORDS:
        if word in upper:
            raise ValueError(WORD_ERROR.format(word=word))
    return trimmed


def run_select(tables: dict[str, DataFrame], text: str, run_id: str) -> DataFrame:
    """Run Spark SQL text over the given tables and no others, with ``:run_id`` bound."""
    checked = check_select(text)
    spark = next(iter(tables.values())).sparkSession
    check_plan(spark, checked, set(tables))
    with _ANALYSIS, _no_files(spark), _temp_views(spark, tables):
        return spark.sql(checked, args={"run_id": run_id})


def check_plan(spark: SparkSession, text: str, known: set[str]) -> None:
    """ValueError unless the parsed text, with all its subqueries, holds allowed nodes and reads known tables only.

    What is checked is the tree that Spark's own parser makes of the text. Names given by WITH are known where they can be
    seen: in the later ones of their list and in the query below it, never in their own definition.
    """
    _check_node(spark._jsparkSession.sessionState().sqlParser().parsePlan(text), {name.lower() for name in known})


def _items(sequence) -> Iterator:
    """The items of a Scala sequence."""
    every = sequence.iterator()
    while every.hasNext():
        yield every.next()


def _check_node(node, known: set[str]) -> None:
    kind = node.getClass().getSimpleName().rstrip("$")
    if kind not in _ALLOWED:
        raise ValueError(CLAUSE_ERROR.format(name=kind))
    if kind == "UnresolvedRelation":
        name = ".".join(_items(node.multipartIdentifier()))
        if name.lower() not in known:
            raise ValueError(TABLE_ERROR.format(name=name))
    if kind == "UnresolvedWith":
        known = set(known)
        for named in _items(node.cteRelations()):
            _check_node(named.productElement(1), known)
            known.add(named.productElement(0).lower())
    else:
        for expression in _items(node.expressions()):
            _check_expression(expression)
        for query in _items(node.subqueries()):
            _check_node(query, known)
    for child in _items(node.children()):
        _check_node(child, known)


def _check_expression(expression) -> None:
    kind = expression.getClass().getSimpleName()
    if kind in _REFUSED_EXPRESSIONS:
        raise ValueError(CLAUSE_ERROR.format(name=kind))
    if kind == "UnresolvedFunction":
        name = ".".join(_items(expression.nameParts())).upper()
        for word in REFLECTIVE_WORDS:
            if word in name:
                raise ValueError(WORD_ERROR.format(word=word))
    for child in _items(expression.children()):
        _check_expression(child)


@contextmanager
def _no_files(spark: SparkSession) -> Iterator[None]:
    """Refuse paths in place of tables while a text is analyzed."""
    before = spark.conf.get(_FILES)
    spark.conf.set(_FILES, "false")
    try:
        yield
    finally:
        spark.conf.set(_FILES, before)


@contextmanager
def _temp_views(spark: SparkSession, tables: dict[str, DataFrame]) -> Iterator[None]:
    """Name the tables while a text is analyzed; put back the caller's views of the same names."""
    shown = {view.name for view in spark.catalog.listTables() if view.isTemporary}
    replaced = {name: spark.table(name) for name in tables if name in shown}
    try:
        for name, frame in tables.items():
            frame.createOrReplaceTempView(name)
        yield
    finally:
        for name in tables:
            if name in replaced:
                replaced[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)
