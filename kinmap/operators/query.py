"""Typed discovery queries: a bounded JSON expression becomes one Column, never text.

What may be asked is data: SCHEMA names each field, its kind, and the columns it stands for; a kind is a table of
operators, each with the rule that its operand must meet and the Column it makes. An expression is first flattened
into a list of steps, where all budgets are checked, and the steps are then folded into a Column.
"""

from __future__ import annotations

import json
import math
import operator as op
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import partial, reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Budgets of an expression (levels, parts of a junction, conditions, bytes) and of a page of results.
DEEPEST, WIDEST, MOST_LEAVES, MOST_BYTES = 12, 32, 64, 20_000
MOST_ROWS, MOST_OFFSET = 5_000, 100_000


class QueryError(ValueError):
    """Malformed, over budget, or of an unknown field."""


class UnsupportedQuery(QueryError):
    """A known field whose evidence isn't there."""


@dataclass
class AnnotationTerms:
    """Assertions: id column, field, value, ontology_id, state, and exact_resolver (whether the exact resolver made it).

    small: whether they are few beside the pairs they are asked of, so that they are sent to the pairs.
    """

    rows: DataFrame
    id: str
    small: bool = False

    def eligible(self, name: str) -> DataFrame:
        """id and its canonical terms: accepted ones; unreviewed ones of the exact resolver where none is accepted."""
        rows = self.rows.filter(F.col("field") == name)
        accepted = F.max((F.col("state") == "accepted").cast("int"))
        by_id = rows.groupBy(F.col(self.id).alias("_id")).agg(accepted.alias("_any"), F.collect_set(F.struct("value", "ontology_id", "state", "exact_resolver")).alias("_all"))
        kept = F.filter("_all", lambda x: (x["state"] == "accepted") | ((x["state"] == "unreviewed") & x["exact_resolver"] & (F.col("_any") == 0)))
        term = lambda x: F.coalesce(F.nullif(x["ontology_id"], F.lit("")), F.lower(x["value"]))
        words = lambda x: F.array(F.lower(x["value"]), F.lower(F.coalesce(x["ontology_id"], F.lit(""))))
        out = by_id.withColumn("_kept", kept).select("_id", F.array_distinct(F.transform("_kept", term)).alias("terms"), F.array_distinct(F.flatten(F.transform("_kept", words))).alias("words"))
        return F.broadcast(out) if self.small else out


# --- operands -------------------------------------------------------------------------------------------------------


def number(value: Any, low: float = -math.inf, high: float = math.inf) -> float:
    if type(value) not in (int, float) or not math.isfinite(value) or not low <= value <= high:
        raise QueryError(f"a finite number from {low} to {high} is wanted")
    return float(value)


def count(value: Any) -> int:
    if type(value) is not int or value < 0:
        raise QueryError("a whole number from 0 is wanted")
    return value


def flag(value: Any) -> bool:
    if type(value) is not bool:
        raise QueryError("true or false is wanted")
    return value


def yes(value: Any) -> bool:
    if value is not True:
        raise QueryError("only true is wanted")
    return value


def word(value: Any) -> str:
    if not isinstance(value, str) or not value.strip():
        raise QueryError("a text that isn't blank is wanted")
    return value.strip()


def member(value: Any, of: tuple[str, ...]) -> str:
    if not isinstance(value, str) or value not in of:
        raise QueryError(f"one of {', '.join(of)} is wanted")
    return value


# --- kinds of field -------------------------------------------------------------------------------------------------

#: Operator to (rule of its operand, Column of a name and the operand).
Operators = dict[str, tuple[Callable[[Any], Any], Callable[[str, Any], Column]]]
# Names of the comparisons.
COMPARISONS = {"eq": op.eq, "gt": op.gt, "gte": op.ge, "lt": op.lt, "lte": op.le}


def _missing_as(name: str, default: Any) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def _measure(rule: Callable[[Any], Any], column: Callable[[str], Column]) -> Operators:
    """A number of the edge."""
    return {k: (rule, lambda name, x, f=f: f(column(name), F.lit(x))) for k, f in COMPARISONS.items()}


def _either_end() -> Operators:
    """A number that one end of the edge must have."""
    return {k: (count, lambda name, x, f=f: f(F.col(name + "_a"), F.lit(x)) | f(F.col(name + "_b"), F.lit(x))) for k, f in COMPARISONS.items()}


def _two_ends(column: Callable[[str], Column]) -> Operators:
    """A text of either end: equal to a given one at one end, or alike or unlike at both."""
    ends = lambda name: (column(name + "_a"), column(name + "_b"))
    return {
        "eq": (word, lambda name, x: reduce(op.or_, [c == x for c in ends(name)])),
        "same": (yes, lambda name, _: op.eq(*ends(name))),
        "different": (yes, lambda name, _: op.ne(*ends(name))),
    }


def _lists(kind: str, name: str) -> list[Column]:
    return [F.coalesce(F.col(f"_{kind}_{name}_{s}"), F.array().cast("array<string>")) for s in "ab"]


def _both_known(name: str) -> Column:
    return reduce(op.and_, [F.size(x) > 0 for x in _lists("terms", name)])


def _annotated() -> Operators:
    """Reviewed terms of either end: a term or part of one at one end, or a shared or no shared term at both."""
    words = lambda name: F.concat(*_lists("words", name))
    return {
        "eq": (word, lambda name, x: F.array_contains(words(name), x.lower())),
        "contains": (word, lambda name, x: F.exists(words(name), lambda w: F.contains(w, F.lit(x.lower())))),
        "same": (yes, lambda name, _: _both_known(name) & F.arrays_overlap(*_lists("terms", name))),
        "different": (yes, lambda name, _: _both_known(name) & ~F.arrays_overlap(*_lists("terms", name))),
    }


def _independence(name: str, wanted: bool) -> Column:
    """Overlap evidence that the policy doesn't exclude, or the independent family's own mark."""
    holds = (F.col(name).isNotNull() & ~_missing_as("excluded", False)) | _missing_as("in_independent", False)
    return holds if wanted else ~holds


CLASSES = ("none", "minor", "major", "exact")
SHARE = _measure(partial(number, low=0, high=1), F.col)
FREE = _measure(number, F.col)


@dataclass(frozen=True)
class Field:
    """column: what its operators are given; mark: what using it is noted as."""

    column: str
    operators: Operators
    mark: str = ""


# Names of the fields.
SCHEMA = {
    "edge.q_value": Field("q", SHARE),
    "edge.p_value": Field("p", SHARE),
    "edge.score": Field("score", FREE),
    "edge.score_percentile": Field("percentile", SHARE),
    "edge.text_percentile": Field("text_percentile", SHARE, "text"),
    "edge.overlap_coefficient": Field("overlap_coefficient", _measure(partial(number, low=0, high=1), partial(_missing_as, default=0))),
    "edge.shared_count": Field("shared_count", _measure(number, partial(_missing_as, default=0))),
    "edge.independent": Field("overlap_class", {"eq": (flag, _independence)}, "independence"),
    "edge.overlap_classification": Field("overlap_class", {"eq": (partial(member, of=CLASSES), lambda name, x: _missing_as(name, "none") == x)}),
    "node.sample_count": Field("sample_count", _either_end()),
    "node.platform": Field("platform", _two_ends(F.col)),
    "topology.community": Field("community", _two_ends(partial(_missing_as, default="unknown"))),
    "node.tissue": Field("tissue", _annotated(), "annotation"),
    "node.disease": Field("disease", _annotated(), "annotation"),
    "node.organism": Field("organism", _annotated(), "annotation"),
}
ALIASES = {"node.tissue_system": "node.tissue"}
UNAVAILABLE = ("explanation.feature_or_pathway", "snapshot.diff")


# --- expressions ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Step:
    """A junction of the last `parts` results, or, with no parts, a condition."""

    name: str
    parts: int = 0
    operator: str = ""
    operand: Any = None


def _entry(value: Any) -> tuple[str, Any]:
    if not isinstance(value, Mapping) or len(value) != 1:
        raise QueryError(f"an object of one key is wanted, not {value!r:.80}")
    return next(iter(value.items()))


def _parts(name: str, body: Any) -> list:
    """The expressions below a junction."""
    if name == "not":
        return [body]
    if not isinstance(body, list | tuple) or not 0 < len(body) <= WIDEST:
        raise QueryError(f"{name} takes a list of 1 to {WIDEST} expressions")
    return list(body)


def flatten(ast: Any, aliases: Mapping[str, str]) -> list[Step]:
    """The expression's steps, each junction after its parts, with every budget checked."""
    out: list[Step] = []
    todo: list[tuple[Any, int]] = [(ast, 0)]
    while todo:
        value, depth = todo.pop()
        if depth > DEEPEST:
            raise QueryError(f"more than {DEEPEST} levels")
        name, body = _entry(value)
        if name in JUNCTIONS:
            below = _parts(name, body)
            out.append(Step(name, len(below)))
            todo += [(x, depth + 1) for x in below]
        elif name == "all" and body is True:
            out.append(Step("all"))
        elif name in UNAVAILABLE:
            raise UnsupportedQuery(f"{name} has no evidence in a snapshot")
        else:
            out.append(Step(aliases.get(name, name), 0, *_entry(body)))
    if sum(x.operator != "" for x in out) > MOST_LEAVES:
        raise QueryError(f"more than {MOST_LEAVES} conditions")
    return out[::-1]


JUNCTIONS: dict[str, Callable[[list[Column]], Column]] = {
    "and": partial(reduce, op.and_),
    "or": partial(reduce, op.or_),
    "not": lambda parts: ~parts[0],
}


def _condition(step: Step) -> Column:
    if step.name not in SCHEMA:
        raise QueryError(f"no field {step.name}")
    named = SCHEMA[step.name]
    if step.operator not in named.operators:
        raise QueryError(f"{step.name} takes {', '.join(named.operators)}, not {step.operator}")
    rule, make = named.operators[step.operator]
    try:
        return make(named.column, rule(step.operand))
    except QueryError as e:
        raise QueryError(f"{step.name}: {e}") from None


def fold(steps: list[Step]) -> Column:
    held: list[Column] = []
    for step in steps:
        if step.parts:
            held, below = held[: -step.parts], held[-step.parts :]
            held.append(JUNCTIONS[step.name](below))
        else:
            held.append(F.lit(True) if step.name == "all" else _condition(step))
    return held[0]


@dataclass
class Compiled:
    condition: Column
    steps: list[Step] = field(default_factory=list)
    terms: AnnotationTerms | None = None
    canonical: str = ""

    def _marked(self, mark: str) -> Iterator[Field]:
        return (f for x in self.steps if (f := SCHEMA.get(x.name)) and f.mark == mark)

    @property
    def fields(self) -> set[str]:
        """Annotation fields that it asks for."""
        return {f.column for f in self._marked("annotation")}

    @property
    def leaves(self) -> int:
        return sum(x.operator != "" for x in self.steps)

    @property
    def uses_text(self) -> bool:
        return any(self._marked("text"))

    @property
    def uses_independence(self) -> bool:
        return any(self._marked("independence"))


def compile_query(ast: Mapping, terms: AnnotationTerms | None = None, aliases: Mapping[str, str] | None = None) -> Compiled:
    """The query's condition. aliases maps other dialects' field names to this one's."""
    canonical = json.dumps(ast, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    if len(canonical.encode()) > MOST_BYTES:
        raise QueryError(f"more than {MOST_BYTES} bytes")
    steps = flatten(ast, ALIASES | dict(aliases or {}))
    out = Compiled(fold(steps), steps, terms, canonical)
    if out.fields and terms is None:
        raise UnsupportedQuery("the snapshot has no annotations")
    return out


def execute(edges: DataFrame, query: Compiled, limit: int = 500, offset: int = 0, probe: bool = False) -> DataFrame:
    """Rows of edges that the query holds for, by q, score and pair; one more than limit with probe, to tell whether more follow."""
    if not 1 <= limit <= MOST_ROWS or not 0 <= offset <= MOST_OFFSET:
        raise QueryError("limit or offset out of range")
    for name in sorted(query.fields):
        own = query.terms.eligible(name)
        for s in "ab":
            edges = edges.join(own.select(F.col("_id").alias(s), F.col("terms").alias(f"_terms_{name}_{s}"), F.col("words").alias(f"_words_{name}_{s}")), s, "left")
    return edges.filter(query.condition).orderBy("q", "score", "a", "b").offset(offset).limit(limit + probe)
