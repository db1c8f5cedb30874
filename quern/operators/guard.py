"""What a query that a user sends may do, told by the plan of Spark's own parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: nodes of a parsed query that only read; anything else is refused
READING = frozenset(
    """Aggregate Deduplicate Distinct Except Filter Generate GlobalLimit Having Intersect Join LateralJoin Limit LocalLimit LocalRelation Offset
    OneRowRelation OneRowRelation$ ParameterizedQuery Pivot PlanWithUnresolvedIdentifier Project Range RepartitionByExpression Repartition Sample Sort Subquery SubqueryAlias Tail Union
    UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedWith
    Unpivot UnpivotTranspose View Window WithCTE WithWindowDefinition""".split()
)
#: functions that run code of the caller's choice
CALLING = ("reflect", "java_method", "try_reflect", "try_java_method")


def _all(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _below(plan):
    """The plan, its children, its CTEs and the plans of subqueries in its expressions."""
    todo, seen = [plan], 0
    while todo:
        node = todo.pop()
        yield node
        seen += 1
        if seen > 10_000:
            raise ValueError("the query is too large")
        todo += _all(node.children())
        todo += [x for x in _all(node.innerChildren()) if hasattr(x, "subqueries")]
        todo += _all(node.subqueries())


def _calls(expression, found: set[str]) -> None:
    if expression.getClass().getSimpleName() == "UnresolvedFunction":
        found.add(_all(expression.nameParts())[-1].lower())
    for child in _all(expression.children()):
        _calls(child, found)


def refusal(spark: SparkSession, text: str) -> str | None:
    """Why a query isn't run: it does not parse, or does something other than reading; None if it only reads.

    Words in names, columns and literals don't matter, and writes are seen wherever they stand.
    """
    from pyspark.errors import PySparkException

    if not text or not text.strip():
        return "empty"
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except (PySparkException, Exception) as e:  # noqa: B014  py4j's errors are not all of PySpark's
        return f"not a query: {str(e).strip().splitlines()[0][:120]}"
    for node in _below(plan):
        name = node.getClass().getSimpleName()
        if name not in READING:
            return f"not reading: {name}"
        called: set[str] = set()
        for e in _all(node.expressions()):
            _calls(e, called)
        if bad := called & set(CALLING):
            return f"calls {min(bad)}"
    return None


def answered(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """The rows of a query over tables named {so}, if it only reads."""
    if why := refusal(spark, text.format(**{name: name for name in tables}) if tables else text):
        raise PermissionError(why)
    return spark.sql(text, **tables) if tables else spark.sql(text)
