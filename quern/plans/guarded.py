"""Running accepted statements over registered views."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.gate import CALL_REFUSED, PATH_REFUSED, REFUSED, gate

# Fixed value: the row limit that a caller may ask for; without one all rows are returned.
USUAL_LIMIT = 100
# The nodes that the plan of a parsed query may have, and expressions that reach into the JVM.
QUERY_NODES = {
    "Aggregate", "CTERelationRef", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join",
    "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "PipeOperator", "Project",
    "Repartition", "RepartitionByExpression", "Sample", "Sort", "SubqueryAlias", "Tail", "Union", "Unpivot",
    "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedOrdinal", "UnresolvedRelation",
    "UnresolvedSubqueryColumnAliases", "UnresolvedTVFAliases", "UnresolvedTableValuedFunction", "UnresolvedWith",
    "UnresolvedQualify", "WithWindowDefinition",
}
DENIED_EXPRESSIONS = ["org.apache.spark.sql.catalyst.expressions.CallMethodViaReflection"]


class Refused(ValueError):
    """The statement does not pass the gate, or Spark cannot resolve it."""


def _each(found) -> Iterator:
    at = found.iterator()
    while at.hasNext():
        yield at.next()


def plan_nodes(plan) -> Iterator:
    """All nodes of a parsed plan, with those of its subqueries and common table expressions."""
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        yield node
        for more in (node.children(), node.innerChildren(), node.subqueries()):
            waiting.extend(_each(more))


def parsed_relations(spark: SparkSession, text: str) -> list[list[str]]:
    """The names of the relations that a query reads, or a refusal: what does not parse alone, and any node of no query.

    Spark's own parser reads the statement, and its plan is searched node by node.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as error:
        raise Refused(str(error)) from error
    names = []
    for node in plan_nodes(plan):
        kind = node.getClass().getSimpleName().rstrip("$")
        if kind not in QUERY_NODES:
            raise Refused(REFUSED)
        if kind == "UnresolvedRelation":
            names.append(list(_each(node.multipartIdentifier())))
    return names


def _run(spark: SparkSession, clean_sql: str, limit: int | None) -> DataFrame:
    """The rows of a statement that passed the gate.

    The text must parse as a query by itself. It is then placed inside FROM, where only a query can stand,
    and the resolved query is searched for expressions that no statement may use. A name of several parts
    that resolves although the catalog has no such table is a file read by its path.
    """
    text = clean_sql.rstrip().rstrip(";")
    relations = parsed_relations(spark, text)
    try:
        rows = spark.sql(f"SELECT * FROM (\n{text}\n)")
    except (ParseException, AnalysisException) as error:
        raise Refused(str(error)) from error
    resolved = rows._jdf.queryExecution().analyzed().toJSON()
    if any(f'"class":"{name}"' in resolved for name in DENIED_EXPRESSIONS):
        raise Refused(CALL_REFUSED)
    for parts in relations:
        if len(parts) > 1 and not spark.catalog.tableExists(".".join(f"`{p.replace('`', '``')}`" for p in parts)):
            raise Refused(PATH_REFUSED)
    return rows if limit is None else rows.limit(limit)


def run_guarded(spark: SparkSession, sql: str, limit: int | None = None) -> tuple[DataFrame, list[str]]:
    """The rows of one gated SELECT, and the gate's warnings.

    All rows, unless the caller asks for a ``limit``.
    """
    verdict = gate(spark.range(1).select(F.col("id").alias("stmt_id"), F.lit(sql).alias("sql"))).first()
    if not verdict["allowed"]:
        raise Refused(verdict["reason"])
    return _run(spark, verdict["clean_sql"], limit), list(verdict["warnings"])


def run_all(
    spark: SparkSession, statements: DataFrame, limit: int | None = None
) -> Iterator[tuple[object, DataFrame | None, list[str], str | None]]:
    """(stmt_id, rows or None, warnings, refusal) for each statement, as each is its own Spark query.

    Statements pass the driver one by one; their rows do not.
    """
    for verdict in gate(statements).drop("sql").toLocalIterator():
        if not verdict["allowed"]:
            yield verdict["stmt_id"], None, [], verdict["reason"]
            continue
        try:
            rows = _run(spark, verdict["clean_sql"], limit)
        except Refused as refusal:
            yield verdict["stmt_id"], None, [], str(refusal)
        else:
            yield verdict["stmt_id"], rows, list(verdict["warnings"]), None
