"""A read-only SQL door and schema look-up."""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from lakevec.errors import Validation

#: Fixed names of Spark's plans: statements that change something or run another text, and look-ups that are commands by form only.
_CHANGES = ("Command", "ParsedStatement")
_LOOKUPS = re.compile(r"(Show|Describe)\w*|ExplainCommand")
#: Fixed names of functions that call Java methods by name, as Spark spells them, and of the class that all of them become.
_CALLS = ("reflect", "try_reflect", "java_method")
_CALL_CLASS = "CallMethodViaReflection"


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    """The result of one query or look-up. The text goes through Spark's parser first; a plan that holds a command, an insert or any other
    change at any depth is refused unrun, as are texts in texts and calls of Java methods: by name in the parsed expressions, whatever their
    spelling, and by class in the analyzed ones, so that no view, function or alias hides them."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise Validation(f"not a query: {e}") from None
    kinds = [spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{c}") for c in _CHANGES]
    for n, (p, name) in enumerate(_nodes(plan)):
        lookup = n == 0 and _LOOKUPS.fullmatch(name)
        if "ExecuteImmediate" in name or name == "CompoundBody" or not lookup and any(k.isInstance(p) for k in kinds):
            raise Validation(f"only queries are allowed, not {name}")
        if _called(p, name) in _CALLS:
            raise Validation("Java methods may not be called")
    found = spark.sql(sql)
    if any(name == _CALL_CLASS for _, name in _nodes(found._jdf.queryExecution().analyzed())):
        raise Validation("Java methods may not be called")
    return found


def _called(node, name: str) -> str | None:
    """The last part of the name of a function that is not resolved yet, in lower case."""
    if name == "UnresolvedFunction":
        return node.nameParts().last().lower()
    return node.name().last().lower() if name == "UnresolvedTableValuedFunction" else None


def _nodes(root):
    """(node, class name) of a plan, of all plans and expressions below it, and of the plans inside of these."""
    kind = {n: root.getClass().getClassLoader().loadClass(f"org.apache.spark.sql.catalyst.{n}") for n in ("trees.TreeNode", "plans.QueryPlan", "expressions.PlanExpression")}
    todo = [root]
    while todo:
        node = todo.pop()
        if not hasattr(node, "getClass") or not kind["trees.TreeNode"].isInstance(node):
            continue
        yield node, node.getClass().getSimpleName()
        below = [node.children(), node.innerChildren()]
        if kind["plans.QueryPlan"].isInstance(node):
            below.append(node.expressions())
        if kind["expressions.PlanExpression"].isInstance(node):
            todo.append(node.plan())
        todo += [found.apply(k) for found in below for k in range(found.size())]


def schema_of(df: DataFrame) -> DataFrame:
    """(position, column_name, data_type) of a table."""
    rows = [(i, n, t) for i, (n, t) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string")
