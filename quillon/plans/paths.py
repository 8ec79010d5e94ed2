"""Paths compiled to DataFrames.

A node set is a DataFrame: resources have ``id``, statements and their objects have s, p, o and otype. A path is
navigated for all nodes at once: a step from a resource to its statements is a join on s, from an object to the
statements of the resource it names a join on o. A predicate of resources or statements is worked out over all
statements, its property filtered in the scan, whatever the nodes it is asked of, and becomes one semi-join by key, so
predicates side by side add their scans and never multiply them. Names of classes and properties become semi-joins with the
closure of the schema. Statements that stand twice are one node: they are made distinct where nodes are counted, added up or numbered,
and in the result, not in every scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import xpath
from ..model import RDF, TYPE, datatype_of, lang_of
from .pathlang import Binary, Call, Literal, Path, Step, Variable, parse

KEY, CONTEXT = "__key", "__context"
COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@dataclass
class Nodes:
    level: str  # document, resource, statement, object, value
    df: DataFrame | None
    single: bool = False  # all nodes share one context
    every: bool = False  # all resources

    def value(self) -> Column:
        return F.col({"resource": "id", "value": "v"}.get(self.level, "o"))

    def identity(self) -> Column:
        if self.level == "resource":
            return F.col("id")
        return F.col("v") if self.level == "value" else F.concat_ws("\x01", "s", "p", "o", "otype")

    def order(self) -> list[Column]:
        if self.level == "resource":
            return [F.col("id")]
        if self.level == "value":
            return [F.col("v")]
        return [F.col("s"), (F.col("p") == TYPE).cast("int"), F.col("p"), F.col("o"), F.col("otype")]


class Engine:
    """Evaluates paths over statements; ``prefixes`` maps the prefixes of names to namespaces."""

    def __init__(self, st: DataFrame, prefixes: dict[str, str], variables: dict | None = None):
        self.st = st.select("s", "p", "o", "otype")
        self.prefixes = {"rdf": RDF} | prefixes
        self.variables = variables or {}
        self._below: dict[str, DataFrame] = {}

    def below(self, kind: str) -> DataFrame:
        if kind not in self._below:
            self._below[kind] = (schema.subclasses if kind == "class" else schema.subproperties)(self.st)
        return self._below[kind]

    def uri(self, name: str) -> str:
        prefix, _, local = name.rpartition(":")
        return self.prefixes[prefix] + local if prefix else local

    def select(self, path: str) -> DataFrame:
        """Distinct nodes of a path, their string value in ``value``."""
        out = self.run(parse(path))
        df = out.df.withColumn("value", out.value())
        return df.drop(KEY, CONTEXT).distinct()

    def run(self, expr) -> Nodes:
        if isinstance(expr, Binary) and expr.op == "|":
            a, b = self.run(expr.left), self.run(expr.right)
            columns = [c for c in a.df.columns if c in b.df.columns]
            return Nodes(a.level, a.df.select(*columns).unionByName(b.df.select(*columns)).distinct())
        if isinstance(expr, Call) and expr.name == "filtered":
            out = self.run(expr.args[0])
            out = Nodes(out.level, out.df.withColumn(CONTEXT, F.lit("")), KEY not in out.df.columns)
            for p in expr.args[1:]:
                out = self.filter(out, p)
            return out
        if isinstance(expr, Call) and expr.name == "id":
            wanted = expr.args[0]
            values = self.run(wanted).df.select(F.explode(F.split(self.run(wanted).value(), r"\s+")).alias("id")) if isinstance(wanted, Path) else None
            known = self.resources()
            found = known.join(values.distinct(), "id", "left_semi") if values is not None else known.where(F.col("id").isin(str(wanted.value).split()))
            return Nodes("resource", found.withColumn(CONTEXT, F.lit("")), True)
        if isinstance(expr, Path):
            return self.walk(Nodes("document", None), expr)
        raise SyntaxError(f"not a node set: {expr}")

    def resources(self) -> DataFrame:
        """Every subject, and every object that is a resource."""
        return self.st.select(F.col("s").alias("id")).unionByName(self.st.where("otype = 'R'").select(F.col("o").alias("id"))).distinct()

    def free(self, here: Nodes, path: Path) -> Nodes:
        """Where a predicate's path sets out: all resources or statements, keyed, if it goes down from there; else the nodes themselves."""
        if not path.steps or path.steps[0].axis != "child" or KEY not in here.df.columns:
            return here
        if here.level == "resource":
            return Nodes("resource", None)
        if here.level == "statement":
            return Nodes("statement", self.st.withColumn(KEY, here.identity()))
        return here

    def walk(self, nodes: Nodes, path: Path) -> Nodes:
        for step in path.steps:
            nodes = self.step(nodes, step)
        return nodes

    def step(self, nodes: Nodes, step: Step) -> Nodes:
        if step.axis == "attribute":
            return self.attribute(nodes, step.test)
        if step.axis == "self":
            out = nodes
        elif step.axis == "parent":
            out = self.parent(nodes)
        elif step.axis == "descendant":
            out = self.test(self.descend(nodes, step.test), step.test)
        else:
            out = self.test(self.child(nodes, step.test), step.test)
        for p in step.predicates:
            out = self.filter(out, p)
        return out

    def carry(self, df: DataFrame) -> list[str]:
        return [KEY] if KEY in df.columns else []

    def child(self, nodes: Nodes, test: str) -> Nodes:
        if nodes.level == "document":
            if test == "*" or test.endswith("()") or test.endswith(":*"):
                return Nodes("resource", self.resources().withColumn(CONTEXT, F.lit("")), True, test == "*")
            return Nodes("resource", schema.instances(self.st, self.uri(test), self.below("class")).select(F.col("s").alias("id")).withColumn(CONTEXT, F.lit("")), True)
        if nodes.df is None:
            return Nodes("statement", self.st.withColumn(KEY, F.col("s")).withColumn(CONTEXT, F.concat_ws("\x01", KEY, "s")))
        keep = self.carry(nodes.df)
        if nodes.level == "statement":
            return Nodes("object", nodes.df.withColumn(CONTEXT, nodes.identity()))
        if nodes.level == "resource":
            left = nodes.df.select(*keep, F.col("id").alias("s"))
        else:
            left = nodes.df.where("otype = 'R'").select(*keep, F.col("o").alias("s"))
        joined = left.distinct().join(self.st.select("s", "p", "o", "otype"), "s")
        return Nodes("statement", joined.withColumn(CONTEXT, F.concat_ws("\x01", *keep, "s")))

    def descend(self, nodes: Nodes, test: str) -> Nodes:
        """Statements at any depth below; a resource is expanded once, so cycles end."""
        if nodes.level == "document":
            return Nodes("statement", self.st.select("s", "p", "o", "otype").withColumn(CONTEXT, F.lit("")))
        pairs = self.st.where("otype = 'R'").select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()
        start = nodes.df.select(F.col("id" if nodes.level == "resource" else "o").alias("a"))
        inside = schema.reachable(pairs, start)
        return Nodes("statement", self.st.join(inside.withColumnRenamed("a", "s"), "s", "left_semi").select("s", "p", "o", "otype").withColumn(CONTEXT, F.lit("")))

    def parent(self, nodes: Nodes) -> Nodes:
        if nodes.level == "object":
            return Nodes("statement", nodes.df)
        keep = self.carry(nodes.df)
        return Nodes("resource", nodes.df.select(*keep, F.col("s").alias("id")).distinct().withColumn(CONTEXT, F.lit("")))

    def test(self, nodes: Nodes, test: str) -> Nodes:
        df = nodes.df
        if nodes.level == "statement":
            if test.endswith(":*"):
                df = df.where(F.col("p").startswith(self.prefixes[test[:-2]]))
            elif test not in ("*", "node()"):
                df = schema.property_statements(df, self.uri(test), self.below("property"))
        elif nodes.level == "object":
            if test == "text()":
                df = df.where("otype <> 'R'")
            elif test == "*":
                df = df.where("otype = 'R'")
            elif test != "node()":
                typed = schema.instances(self.st, self.uri(test), self.below("class")).withColumnRenamed("s", "o")
                df = df.where("otype = 'R'").join(typed, "o", "left_semi")
        elif nodes.level == "resource" and test.endswith(":*"):
            typed = self.st.where((F.col("p") == TYPE) & F.col("o").startswith(self.prefixes[test[:-2]])).select(F.col("s").alias("id"))
            df = df.join(typed, "id", "left_semi")
        return Nodes(nodes.level, df)

    def attribute(self, nodes: Nodes, name: str) -> Nodes:
        v = {
            "xml:lang": lambda: lang_of(F.col("otype")),
            "rdf:datatype": lambda: datatype_of(F.col("otype")),
            "uri": lambda: F.col("id" if nodes.level == "resource" else "p"),
            "rdf:about": lambda: F.col("id" if nodes.level == "resource" else "o"),
        }[name]()
        return Nodes("value", nodes.df.withColumn("v", v).where("v is not null"))

    # predicates

    def keyed(self, nodes: Nodes) -> Nodes:
        return Nodes(nodes.level, nodes.df.withColumn(KEY, nodes.identity()))

    def filter(self, nodes: Nodes, expr) -> Nodes:
        """The nodes a predicate holds for."""
        outer = nodes.df.columns
        marked = nodes.df.withColumn("__outer", F.col(KEY)) if KEY in outer else nodes.df
        here = Nodes(nodes.level, marked.withColumn(KEY, nodes.identity()), nodes.single, nodes.every)
        out = self.holds(here, expr).df
        if "__outer" in out.columns:
            out = out.drop(KEY).withColumnRenamed("__outer", KEY)
        return Nodes(nodes.level, out.select(*outer), nodes.single)

    def keys(self, here: Nodes, expr) -> DataFrame | None:
        """Keys of nodes that an expression holds for, here or elsewhere; None where that depends on the nodes here."""
        if isinstance(expr, Binary) and expr.op in ("and", "or"):
            a, b = self.keys(here, expr.left), self.keys(here, expr.right)
            if a is None or b is None:
                return None
            return a.distinct().join(b.distinct(), KEY) if expr.op == "and" else a.unionByName(b)
        if isinstance(expr, Binary) and expr.op in COMPARE:
            if any(isinstance(x, Call) and x.name in ("position", "last") for x in (expr.left, expr.right)):
                return None
            return self.compared(here, expr).select(KEY)
        if isinstance(expr, Path):
            return self.walk(self.free(here, expr), expr).df.select(KEY)
        return None

    def holds(self, here: Nodes, expr) -> Nodes:
        df = here.df
        if (keys := self.keys(here, expr)) is not None:
            if here.every and set(df.columns) == {"id", KEY, CONTEXT} and self.below_here(expr):
                found = keys.distinct().select(F.col(KEY).alias("id"), KEY, F.lit("").alias(CONTEXT))  # who has statements is a resource
                return Nodes(here.level, found, here.single)
            return Nodes(here.level, self.among(df, keys), here.single)
        if isinstance(expr, Literal) and isinstance(expr.value, float):
            return self.positioned(here, "=", expr)
        if isinstance(expr, Binary) and expr.op == "and":
            return self.holds(self.holds(here, expr.left), expr.right)
        if isinstance(expr, Binary) and expr.op == "or":
            keys = self.holds(here, expr.left).df.select(KEY).unionByName(self.holds(here, expr.right).df.select(KEY)).distinct()
            return Nodes(here.level, df.join(keys, KEY, "left_semi"))
        if isinstance(expr, Call) and expr.name == "not":
            keys = self.keys(here, expr.args[0])
            keys = self.holds(here, expr.args[0]).df.select(KEY) if keys is None else keys
            return Nodes(here.level, df.join(keys.distinct(), KEY, "left_anti"), here.single)
        if isinstance(expr, Call) and expr.name in ("true", "false"):
            return here if expr.name == "true" else Nodes(here.level, df.where(F.lit(False)))
        if isinstance(expr, Call) and expr.name == "last" or isinstance(expr, Call) and expr.name == "position":
            return self.positioned(here, "=", expr) if expr.name == "last" else here
        if isinstance(expr, Binary) and expr.op in COMPARE:
            for a, b, flip in ((expr.left, expr.right, False), (expr.right, expr.left, True)):
                if isinstance(a, Call) and a.name == "position":
                    op = expr.op.translate(str.maketrans("<>", "><")) if flip else expr.op
                    return self.positioned(here, op, b)
        value, frame = self.value(here, expr)
        return self.semi(here, frame.where(xpath.boolean(value)))

    def semi(self, here: Nodes, frame: DataFrame) -> Nodes:
        return Nodes(here.level, self.among(here.df, frame.select(KEY)))

    @staticmethod
    def among(df: DataFrame, keys: DataFrame) -> DataFrame:
        """Rows with one of the keys. An inner join with distinct keys: a semi-join would be pushed into every branch of a union, and copied there."""
        return df.join(keys.distinct(), KEY).select(*df.columns)

    def below_here(self, expr) -> bool:
        """Whether an expression asks only for what lies below a node by child steps."""
        if isinstance(expr, Binary):
            sides = [x for x in (expr.left, expr.right) if not self.constant(x)]
            return bool(sides) and all(self.below_here(x) for x in sides)
        return isinstance(expr, Path) and bool(expr.steps) and expr.steps[0].axis == "child"

    def positioned(self, here: Nodes, op: str, wanted) -> Nodes:
        last = isinstance(wanted, Call) and wanted.name == "last"
        if here.single and (last and op == "=" or isinstance(wanted, Literal) and op in ("=", "<", "<=") and wanted.value == int(wanted.value)):
            # the first or last few of one context: top rows of each partition, never all rows in one task
            rows = here.df.distinct()
            if last:
                return Nodes(here.level, rows.orderBy(*[c.desc() for c in here.order()]).limit(1))
            n = int(wanted.value) - (op == "<")
            if n < 1:
                return Nodes(here.level, rows.where(F.lit(False)))
            top = rows.orderBy(*here.order()).limit(n)
            return Nodes(here.level, top.orderBy(*here.order()).offset(n - 1) if op == "=" else top)
        group = Window.partitionBy(CONTEXT)
        df = here.df.distinct().withColumn("__n", F.row_number().over(group.orderBy(*here.order())))
        if last:
            df = df.withColumn("__last", F.count("*").over(group))
            other = F.col("__last")
        else:
            other = F.lit(wanted.value)
        return Nodes(here.level, df.where(COMPARE[op](F.col("__n").cast("double"), other.cast("double"))).drop("__n", "__last"))

    def compared(self, here: Nodes, expr: Binary) -> DataFrame:
        """Keys for which some pair of values compares; numbers where an order or a number is asked for."""
        for one, other, op in ((expr.left, expr.right, expr.op), (expr.right, expr.left, expr.op.translate(str.maketrans("<>", "><")))):
            if isinstance(other, Variable) and isinstance(self.variables[other.name], DataFrame):
                return self.against(here, one, op, self.variables[other.name])
        a, left = self.value(here, expr.left, every=True)
        b, right = self.value(here, expr.right, every=True)
        left, right = left.select(KEY, a.alias("__a")), right.select(KEY, b.alias("__b"))
        both = left.join(right, KEY) if not self.constant(expr.right) else left.withColumn("__b", self.literal(expr.right))
        number = expr.op in ("<", "<=", ">", ">=") or any(isinstance(x, Literal) and isinstance(x.value, float) or isinstance(x, Call) and x.name in xpath.NUMBERS for x in (expr.left, expr.right))
        x, y = (xpath.number(F.col(c)) if number else F.col(c).cast("string") for c in ("__a", "__b"))
        return both.where(COMPARE[expr.op](x, y))

    def against(self, here: Nodes, expr, op: str, nodes: DataFrame) -> DataFrame:
        """Keys for which some value compares with some node of a variable: by its values, or by the least and most of them."""
        a, left = self.value(here, expr, every=True)
        left = left.select(KEY, a.alias("__a"))
        if op == "=":
            return left.join(nodes, left["__a"].cast("string") == nodes["v"], "left_semi")
        if op == "!=":
            ends = nodes.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
            x, lo, hi = F.col("__a").cast("string"), F.col("lo"), F.col("hi")
        else:
            ends = nodes.select(xpath.number(F.col("v")).alias("n")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
            x, lo, hi = xpath.number(F.col("__a")), F.col("lo"), F.col("hi")
        both = left.join(F.broadcast(ends))  # one row
        return both.where(COMPARE[op](x, lo) | COMPARE[op](x, hi))

    @staticmethod
    def constant(expr) -> bool:
        return isinstance(expr, (Literal, Variable))

    def literal(self, expr) -> Column:
        value = expr.value if isinstance(expr, Literal) else self.variables[expr.name]
        if isinstance(value, DataFrame):  # as a string: its first node's
            first = value.agg(F.min("v")).first()[0]
            value = "" if first is None else first
        return F.lit(value)

    def value(self, here: Nodes, expr, every: bool = False) -> tuple[Column, DataFrame]:
        """An expression's value per node: a column, and a frame with the keys. every: all values of a path, else its first."""
        if self.constant(expr):
            return self.literal(expr), here.df.select(KEY)
        if isinstance(expr, Path):
            out = self.walk(self.free(here, expr) if every else here, expr)
            frame = out.df.select(KEY, out.value().alias("__v"))
            return F.col("__v"), frame.distinct() if every else here.df.select(KEY).join(frame.groupBy(KEY).agg(F.min("__v").alias("__v")), KEY, "left")
        if isinstance(expr, Call) and expr.name == "count":
            out = self.walk(self.free(here, expr.args[0]), expr.args[0])
            frame = out.df.select(KEY, out.identity().alias("__i")).distinct().groupBy(KEY).agg(F.count("*").alias("__v"))
            return F.coalesce("__v", F.lit(0)).cast("double"), here.df.select(KEY).join(frame, KEY, "left")
        if isinstance(expr, Call) and expr.name == "sum":
            out = self.walk(self.free(here, expr.args[0]), expr.args[0])
            frame = out.df.select(KEY, out.identity().alias("__i"), out.value().alias("__v")).distinct().groupBy(KEY).agg(F.sum(xpath.number(F.col("__v"))).alias("__v"))
            return F.coalesce("__v", F.lit(0.0)), here.df.select(KEY).join(frame, KEY, "left")
        name, args = (expr.op, (expr.left, expr.right)) if isinstance(expr, Binary) else (expr.name, expr.args or (Path(False, (Step("self", "node()"),)),))
        frame, columns = here.df.select(KEY).distinct(), []
        for i, arg in enumerate(args):
            v, other = self.value(here, arg)
            if self.constant(arg):
                columns.append(v)
                continue
            frame = frame.join(other.select(KEY, v.alias(f"__{i}")).distinct(), KEY)
            columns.append(F.col(f"__{i}"))
        return xpath.FUNCTIONS[name](*columns), frame
