"""Rules around changes: actions, triggers, constraints, row-level authorisation, cached results."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Action:
    """Queries are tried in order; the first that yields something is handed to ``run``. None from a query is no match."""

    queries: list[Callable[[dict], object]]
    run: Callable[[object, dict], object]
    stop_on_match: bool = False


@dataclass
class Pipeline:
    """Triggers and their ordered actions; errors run the error actions of the trigger, last to first."""

    actions: dict[str, list[Action]] = field(default_factory=dict)

    def trigger(self, name: str, context: dict | None = None) -> object:
        context, result = context if context is not None else {}, None
        try:
            for action in self.actions.get(name, []):
                matched = next((m for q in action.queries if (m := q(context)) is not None and not (isinstance(m, DataFrame) and m.isEmpty())), None)
                if matched is None:
                    continue
                result = action.run(matched, context)
                context["result"] = result
                if action.stop_on_match:
                    break
        except Exception as e:
            handlers = self.actions.get(name + "-error", [])
            if not handlers:
                raise
            for action in reversed(handlers):
                result = action.run(e, context)
        return result


class Triggers:
    """Hooks on the added and removed statements of a change: before it, and after it is written."""

    def __init__(self):
        self.before: list[Callable] = []
        self.after: list[Callable] = []

    def commit(self, st: DataFrame, added: DataFrame, removed: DataFrame, write: Callable[[DataFrame], None]) -> DataFrame:
        """Before-hooks return further (added, removed); the whole change is one write."""
        from .update import add, remove

        for hook in self.before:
            more, less = hook(added, removed)
            added, removed = added.unionByName(more), removed.unionByName(less)
        out = add(remove(st, removed), added)
        write(out)
        for hook in self.after:
            hook(added, removed)
        return out


def violations(st: DataFrame, p: str, unique: bool = False, at_least: int = 0, at_most: int | None = None, subjects: DataFrame | None = None) -> DataFrame:
    """(s, rule, n) where a property breaks a rule: a value two subjects share, or too few or too many values."""
    mine = st.where(F.col("p") == p)
    counted = mine.groupBy("s").agg(F.count("*").alias("n"))
    if subjects is not None:
        counted = subjects.select("s").distinct().join(counted, "s", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bad = F.col("n") < at_least
    bad = bad | (F.col("n") > at_most) if at_most is not None else bad
    out = counted.where(bad).select("s", F.lit("cardinality").alias("rule"), "n")
    if unique:
        shared = mine.groupBy("o").agg(F.countDistinct("s").alias("n")).where("n > 1")
        out = out.unionByName(mine.join(shared, "o").select("s", F.lit("unique").alias("rule"), "n").distinct())
    return out


def allowed(st: DataFrame, required: DataFrame, held: DataFrame, priority: int = 0) -> DataFrame:
    """Statements whose required tokens are all held.

    required: (p, token, priority), p null for every property. Tokens of lower priority than ``priority`` don't bind.
    """
    binding = required.where(F.col("priority") >= priority).join(held.select("token"), "token", "left_anti")
    blocked = binding.where("p is not null").select("p").distinct()
    everything = binding.where("p is null").select("token").limit(1)
    return st.join(blocked, "p", "left_anti").join(F.broadcast(everything), how="left_anti")


class QueryCache:
    """Results by query text and version, the least recently used unpersisted first."""

    def __init__(self, capacity: int = 100):
        self.capacity, self.held = capacity, OrderedDict()

    def get(self, text: str, version: object, run: Callable[[], DataFrame]) -> DataFrame:
        key = (text, version)
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        self.held[key] = run().persist()
        if len(self.held) > self.capacity:
            self.held.popitem(last=False)[1].unpersist()
        return self.held[key]
