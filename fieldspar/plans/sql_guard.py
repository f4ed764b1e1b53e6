"""A read-only guard for SQL: one query, allowed tables and columns only, and a bounded limit."""

from __future__ import annotations

from collections.abc import Mapping, Set
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import SparkSession

from fieldspar.sources.schemas import SCHEMAS

DEFAULT_LIMIT, MAX_LIMIT = 200, 1000

#: Logical operators that read; any other one, such as a command, is refused.
READS = frozenset((
    "Project", "Filter", "Aggregate", "Sort", "Join", "Union", "Intersect", "Except", "Distinct", "GlobalLimit", "LocalLimit", "SubqueryAlias", "UnresolvedRelation",
    "UnresolvedWith", "UnresolvedSubqueryColumnAliases", "UnresolvedHaving", "OneRowRelation", "Window", "WithWindowDefinition", "Offset", "UnresolvedInlineTable", "LocalRelation", "LateralJoin", "Pivot", "Unpivot",
))


#: Functions that a statement may call: they compute from their arguments and nothing else.
FUNCTIONS = frozenset((
    "abs", "avg", "ceil", "ceiling", "coalesce", "concat", "concat_ws", "contains", "count", "count_if", "date", "date_add", "date_diff", "date_format", "date_sub", "date_trunc", "datediff", "day", "dense_rank", "endswith", "extract",
    "first", "first_value", "floor", "greatest", "hour", "if", "ifnull", "lag", "last", "last_value", "lead", "least", "left", "length", "like", "lower", "ltrim", "max", "max_by", "mean", "median", "min", "min_by", "minute", "mod", "month",
    "nullif", "nvl", "percentile", "quarter", "rank", "replace", "right", "round", "row_number", "rtrim", "sign", "sqrt", "startswith", "std", "stddev", "substr", "substring", "sum", "to_date", "trim", "trunc", "upper", "variance", "year",
))


class Refused(ValueError):
    """The statement may not run."""


@dataclass(frozen=True)
class Guarded:
    """A statement that may run, and the tables that it names."""

    sql: str
    tables: frozenset[str]
    limit: int


def _seq(items: object) -> list:
    return [items.apply(i) for i in range(items.size())]


def _nodes(plan: object) -> list:
    """All nodes of an unresolved plan, with those of subqueries and named parts."""
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        found.append(node)
        todo += _seq(node.children().toSeq()) + [x for x in _seq(node.innerChildren().toSeq()) if hasattr(x, "nodeName")] + _seq(node.subqueries().toSeq())
    return found


def _expressions(nodes: list) -> list:
    """All expressions of the nodes, with those below them."""
    found, todo = [], [e for n in nodes for e in _seq(n.expressions().toSeq())]
    while todo:
        e = todo.pop()
        found.append(e)
        todo += _seq(e.children().toSeq())
    return found


def _resolves(spark: SparkSession, sql: str, columns: Mapping[str, Set[str]]) -> None:
    """Refuse a statement that needs more than the listed columns, by resolving it against empty tables that have just these."""
    own = spark.newSession()
    for table, names in columns.items():
        known = {f.name.lower(): f.dataType.simpleString() for f in spark.createDataFrame([], SCHEMAS[table]).schema} if table in SCHEMAS else {}
        own.createDataFrame([], ", ".join(f"`{c}` {known.get(c.lower(), 'string')}" for c in sorted(names))).createOrReplaceTempView(table)
    try:
        own.sql(sql)
    except (AnalysisException, ParseException) as error:
        raise Refused("columns not allowed, or not there") from error
    finally:
        for table in columns:
            own.catalog.dropTempView(table)


def guard(spark: SparkSession, sql: str, tables: Set[str], columns: Mapping[str, Set[str]] | Set[str] | None = None, *, default: int = DEFAULT_LIMIT, most: int = MAX_LIMIT) -> Guarded:
    """The statement with a limit between 1 and ``most``, or Refused.

    It is parsed by Spark and its unresolved plan is walked: every node, function and table must be
    listed.  With columns - of each table, or one set for all - stars are refused and names are then
    resolved per table, so that no alias stands for a column that isn't allowed.  Nothing is run.
    """
    text = sql.strip().rstrip(";")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as error:
        raise Refused("not one valid statement") from error
    nodes = _nodes(plan)
    for node in nodes:
        if node.nodeName() not in READS:
            raise Refused(f"{node.nodeName()} is not allowed")
    defined = {r._1().lower() for n in nodes if n.nodeName() == "UnresolvedWith" for r in _seq(n.cteRelations().toSeq())}
    named = {".".join(_seq(n.multipartIdentifier().toSeq())).lower() for n in nodes if n.nodeName() == "UnresolvedRelation"}
    allowed = {t.lower() for t in tables}
    if defined & allowed:
        raise Refused("a named part hides a table")
    named = frozenset(named - defined)
    if named - allowed:
        raise Refused(f"tables not allowed: {sorted(named - allowed)}")
    for e in _expressions(nodes):
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            name = ".".join(_seq(e.nameParts().toSeq())).lower()
            if name not in FUNCTIONS:
                raise Refused(f"{name} is not allowed")
        if columns is not None and kind.startswith("UnresolvedStar"):
            raise Refused("a star is not allowed")
    if columns is not None:
        _resolves(spark, text, columns if isinstance(columns, Mapping) else {t: columns for t in tables})
    limit, top = default, plan
    while top.nodeName() in ("UnresolvedWith",):
        top = top.child()
    if top.nodeName() == "GlobalLimit":
        try:
            limit = int(top.limitExpr().toString())
        except ValueError:
            raise Refused("the limit must be a number") from None
    limit = max(1, min(limit, most))
    return Guarded(f"SELECT * FROM ({text}) LIMIT {limit}", named, limit)
