"""Configured MERGE, INSERT and SELECT texts, as Spark's own parser reads them.

A MERGE text becomes the clauses of a merge, with its columns named ``tgt.`` and ``src.``
whatever the text calls its tables; an INSERT text gives the columns of the staged page and
its placeholders; a SELECT text the names that come out of it.  Nothing is analysed, so the
tables need not exist.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

from tidemark.functions.sqltext import with_predicate, without_hints
from tidemark.spec import Clause, TargetSpec


class StatementError(ValueError):
    """Text that Spark cannot parse, or that says what a merge of pages cannot do."""


@dataclass(frozen=True)
class Merge:
    target: str
    staging: str
    #: Columns that the two are joined by.
    keys: tuple[str, ...]
    clauses: tuple[Clause, ...]


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    placeholders: int


def _session(spark: SparkSession | None) -> SparkSession:
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("statements are read by a session's parser; there is none")
    return spark


def _plan(spark: SparkSession | None, text: str):
    try:
        # Hints are another database's; Spark takes them after SELECT alone.
        return _session(spark)._jsparkSession.sessionState().sqlParser().parsePlan(without_hints(text))
    except ParseException as e:
        raise StatementError(str(e).strip().splitlines()[0]) from e


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _items(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _table(plan) -> tuple[str, str]:
    """(name, what its columns are called by) of a relation."""
    alias = None
    if _kind(plan) == "SubqueryAlias":
        alias, plan = plan.alias(), plan.child()
    if _kind(plan) != "UnresolvedRelation":
        raise StatementError("a merge is between two named tables")
    parts = _items(plan.multipartIdentifier())
    return ".".join(parts), alias or parts[-1]


class _Names:
    """Rewrites the columns of an expression to ``tgt`` and ``src``."""

    def __init__(self, spark: SparkSession, target: str, source: str):
        self.jvm, self.sides = spark._jvm, {target.lower(): "tgt", source.lower(): "src"}
        if len(self.sides) < 2:
            raise StatementError("the tables of a merge need different names")

    def _seq(self, items: list):
        return self.jvm.scala.jdk.javaapi.CollectionConverters.asScala(self.jvm.java.util.ArrayList(items)).toSeq()

    def side(self, attribute, bare: str | None = None) -> tuple[str, list[str]]:
        """(tgt or src, the column's parts); ``bare`` is where a column without a table belongs."""
        first, *rest = _items(attribute.nameParts())
        if rest and first.lower() in self.sides:
            return self.sides[first.lower()], rest
        if bare is None:
            raise StatementError(f"column '{first}' must name its table")
        return bare, [first, *rest]

    def rewritten(self, e, bare: str | None = None):
        if _kind(e) == "UnresolvedAttribute":
            side, rest = self.side(e, bare)
            return self.jvm.org.apache.spark.sql.catalyst.analysis.UnresolvedAttribute(self._seq([side, *rest]))
        children = _items(e.children())
        return e.withNewChildren(self._seq([self.rewritten(c, bare) for c in children])) if children else e

    def sql(self, e, bare: str | None = None) -> str:
        return self.rewritten(e, bare).sql()


def _conjuncts(e) -> Iterator:
    if _kind(e) == "And":
        for c in _items(e.children()):
            yield from _conjuncts(c)
    else:
        yield e


def _keys(condition, names: _Names) -> tuple[str, ...]:
    keys = []
    for e in _conjuncts(condition):
        sides = [names.side(c) for c in _items(e.children()) if _kind(c) == "UnresolvedAttribute"] if _kind(e) == "EqualTo" else []
        columns = {side: rest for side, rest in sides}
        if len(columns) < 2 or len(columns["tgt"]) > 1 or columns["tgt"][0].lower() != columns["src"][0].lower():
            raise StatementError(f"a merge joins equal columns of one name, not ON {e.sql()}")
        keys.append(columns["tgt"][0])
    return tuple(keys)


def merge(text: str, spark: SparkSession | None = None) -> Merge:
    """A MERGE text as clauses.  Values of an insert may name source columns alone."""
    spark, plan = _session(spark), _plan(spark, text)
    if _kind(plan) != "MergeIntoTable":
        raise StatementError("not a MERGE statement")
    (target, t), (staging, s) = _table(plan.targetTable()), _table(plan.sourceTable())
    names, clauses = _Names(spark, t, s), []
    if not plan.notMatchedBySourceActions().isEmpty():
        raise StatementError("a page cannot tell which rows its source lacks: WHEN NOT MATCHED BY SOURCE")
    for when, actions in (("matched", plan.matchedActions()), ("not_matched", plan.notMatchedActions())):
        for action in _items(actions):
            kind = _kind(action)
            do = {"DeleteAction": "delete", "UpdateAction": "update", "UpdateStarAction": "update", "InsertAction": "insert", "InsertStarAction": "insert"}[kind]
            bare = "src" if do == "insert" else None
            condition = names.sql(action.condition().get(), bare) if action.condition().isDefined() else None
            columns = None
            if kind in ("UpdateAction", "InsertAction"):
                columns = {names.side(a.key(), "tgt")[1][0]: names.sql(a.value(), bare) for a in _items(action.assignments())}
            clauses.append(Clause(when, do, condition, columns))
    return Merge(target, staging, _keys(plan.mergeCondition(), names), tuple(clauses))


def insert(text: str, spark: SparkSession | None = None) -> Insert:
    """``INSERT INTO t (columns) VALUES (?, ...)``; without a column list ``columns`` is empty."""
    plan = _plan(spark, text)
    if _kind(plan) != "InsertIntoStatement":
        raise StatementError("not an INSERT statement")
    values = [v for row in _items(plan.query().rows()) for v in _items(row)] if _kind(plan.query()) == "UnresolvedInlineTable" else []
    return Insert(_table(plan.table())[0], tuple(_items(plan.userSpecifiedCols())), sum(_kind(v) == "PosParameter" for v in values))


def _output(plan) -> list | None:
    """The expressions that a query puts out: its outermost list."""
    kind = _kind(plan)
    if kind == "Project":
        return _items(plan.projectList())
    if kind == "Aggregate":
        return _items(plan.aggregateExpressions())
    if kind in ("GlobalLimit", "LocalLimit", "Sort", "Distinct", "UnresolvedWith", "UnresolvedHaving", "SubqueryAlias", "Offset", "UnresolvedHint", "WithWindowDefinition", "Union", "Except", "Intersect"):
        return _output(_items(plan.children())[0])
    return None


def select_list(text: str, spark: SparkSession | None = None) -> list[str]:
    """Names of a source query's columns: of an alias, a column, or else the expression's text; ``*`` for a star."""
    out = _output(_plan(spark, with_predicate(text, "1 = 1")))
    if out is None:
        raise StatementError("not a SELECT statement")
    named = lambda e: e.name() if _kind(e) == "Alias" else _items(e.nameParts())[-1] if _kind(e) == "UnresolvedAttribute" else "*" if _kind(e) == "UnresolvedStar" else e.sql()
    return [named(e) for e in out]


def resolved(spec: TargetSpec, spark: SparkSession | None = None) -> TargetSpec:
    """A target whose texts, where it has some, have become columns, keys and clauses."""
    if spec.targetInsert:
        spec = dataclasses.replace(spec, insertColumns=insert(spec.targetInsert, spark).columns, targetInsert="")
    if spec.targetMerge:
        found = merge(spec.targetMerge, spark)
        spec = dataclasses.replace(spec, merge=found.clauses, mergeKeys=found.keys, targetMerge="")
    return spec
