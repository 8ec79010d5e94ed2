"""The object language: patterns in braces that select resources and shape them into nested documents.

    { id : ?c, name, "where" : nation.name, "orders" : { id : ?o, status where(customer = ?c) }
      where(segment = 'BUILDING' and balance > 10) orderby(name) limit(5) offset(2) }

An unquoted key must be present and is returned; a quoted key only names a value; ``*`` is every property;
``optional(a, b)`` returns properties without asking for them; ``[expr]`` keeps a list. Every filter is a set of ids,
so conjunction, disjunction and negation are semi-joins, unions and anti-joins. A nested pattern is tied to the one
around it by a label, grouped on its own side first and then joined, so independent branches never multiply.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""(?:\s|/\*.*?\*/|//[^\n]*|\#[^\n]*)*(?:(?P<string>"(?:[^"]|"")*"|'(?:[^']|'')*')|(?P<number>\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|(?P<label>\?\w+)|(?P<uri><[^>\s]+>)|(?P<name>[A-Za-z_][\w-]*(?::[\w-]+)?)|(?P<op>!=|==|<=|>=|[{}\[\](),:.=<>+*/%-]))""", re.S)
CLAUSES = ("where", "limit", "offset", "groupby", "orderby")


@dataclass
class Value:
    value: object


@dataclass
class Prop:
    names: list[str]
    label: str | None = None


@dataclass
class Label:
    name: str


@dataclass
class Op:
    op: str
    args: list


@dataclass
class Item:
    key: str | None
    value: object
    required: bool = False
    optional: bool = False
    listed: bool = False


@dataclass
class Pattern:
    items: list[Item] = field(default_factory=list)
    label: str | None = None
    star: bool = False
    clauses: dict = field(default_factory=dict)


class Parser:
    LEVELS = (("or",), ("and",), ("not",), ("in",), ("=", "==", "!=", "<", "<=", ">", ">=", "is"), ("+", "-"), ("*", "/", "%"))

    def __init__(self, text: str):
        self.items, at, text = [], 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SyntaxError(f"pattern: unexpected {text[at:at + 12]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str | None:
        return self.items[self.at + ahead][1] if self.at + ahead < len(self.items) else None

    def word(self) -> str:
        return (self.peek() or "").lower()

    def take(self, wanted: str | None = None) -> str:
        got = self.peek()
        if got is None or wanted and got.lower() != wanted:
            raise SyntaxError(f"pattern: expected {wanted or 'more'}, found {got!r}")
        self.at += 1
        return got

    def pattern(self) -> Pattern:
        out = Pattern()
        self.take("{")
        while self.peek() != "}":
            kind, text = self.items[self.at]
            if text == ",":
                self.take()
            elif text == "*":
                self.take()
                out.star = True
            elif kind == "name" and self.word() in CLAUSES and self.peek(1) == "(":
                name = self.take().lower()
                self.take("(")
                out.clauses[name] = self.expr(0)
                self.take(")")
            elif kind == "name" and self.word() == "optional" and self.peek(1) == "(":
                self.take()
                self.take("(")
                while self.peek() != ")":
                    name = self.take()
                    out.items.append(Item(name, Prop([name]), optional=True))
                    if self.peek() == ",":
                        self.take()
                self.take(")")
            elif kind == "name" and self.word() == "id" and self.peek(1) == ":":
                self.take()
                self.take(":")
                out.label = self.take()[1:]
            else:
                quoted = kind == "string"
                key = self.string(self.take()) if quoted else self.take().strip("<>")
                item = Item(key, Prop([key]), required=not quoted)
                if self.peek() == ":":
                    self.take()
                    if self.peek() == "{":
                        item.value = self.pattern()
                    elif self.peek() == "[":
                        self.take()
                        item.value, item.listed = self.expr(0), True
                        self.take("]")
                    else:
                        item.value = self.expr(0)
                out.items.append(item)
        self.take("}")
        return out

    @staticmethod
    def string(text: str) -> str:
        return text[1:-1].replace(text[0] * 2, text[0])

    def expr(self, level: int):
        if level == len(self.LEVELS):
            return self.primary()
        if self.LEVELS[level] == ("not",):
            if self.word() == "not":
                self.take()
                return Op("not", [self.expr(level)])
            return self.expr(level + 1)
        left = self.expr(level + 1)
        while self.word() in self.LEVELS[level] or level == 3 and self.word() == "not" and (self.peek(1) or "").lower() == "in":
            op = self.take().lower()
            if op == "is":
                negated = self.word() == "not" and bool(self.take())
                self.take("null")
                left = Op("not", [Op("is null", [left])]) if negated else Op("is null", [left])
            elif op in ("in", "not"):
                if op == "not":
                    self.take("in")
                self.take("(")
                options = []
                while self.peek() != ")":
                    options.append(self.expr(4))
                    if self.peek() == ",":
                        self.take()
                self.take(")")
                left = Op("in", [left, *options]) if op == "in" else Op("not", [Op("in", [left, *options])])
            else:
                right = self.expr(level + 1)
                left = Op({"==": "="}.get(op, op), [left, right])
        return left

    def primary(self):
        kind, text = self.items[self.at] if self.at < len(self.items) else (None, None)
        if text == "(":
            self.take()
            out = self.expr(0)
            self.take(")")
            return out
        if text == "-":
            self.take()
            return Op("-", [Value(0.0), self.primary()])
        self.take()
        if kind == "string":
            return Value(self.string(text))
        if kind == "number":
            return Value(float(text))
        if kind == "label":
            if self.peek() == ".":
                self.take()
                return Prop(self.names(), text[1:])
            return Label(text[1:])
        if kind in ("name", "uri"):
            if self.word() == "(" and kind == "name":
                self.take("(")
                args = []
                while self.peek() != ")":
                    args.append(self.expr(0))
                    if self.peek() == ",":
                        self.take()
                self.take(")")
                return Op(text.lower(), args)
            if text.lower() in ("true", "false", "null"):
                return Value({"true": True, "false": False, "null": None}[text.lower()])
            self.at -= 1
            return Prop(self.names())
        raise SyntaxError(f"pattern: unexpected {text!r}")

    def names(self) -> list[str]:
        out = [self.take().strip("<>")]
        while self.peek() == ".":
            self.take()
            out.append(self.take().strip("<>"))
        return out


ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide, "%": F.try_mod}
COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


class Objects:
    """Runs patterns over statements; names without a namespace get ``ns``. ``functions`` maps names to column builders."""

    def __init__(self, st: DataFrame, ns: str, functions: dict | None = None):
        self.st = st.dropDuplicates(["s", "p", "o", "otype"])
        self.ns = ns
        self.functions = {"upper": F.upper, "lower": F.lower, "isref": lambda x: x.rlike("^[a-z]+:")} | (functions or {})

    def register(self, name: str, build) -> None:
        self.functions[name.lower()] = build

    def uri(self, name: str) -> str:
        return name if ":" in name else self.ns + name

    # values: frames (id, v, otype)

    def prop(self, names: list[str]) -> DataFrame:
        """Values of a property path; every step but the last follows resources."""
        out = self.st.where(F.col("p") == self.uri(names[0])).select(F.col("s").alias("id"), F.col("o").alias("v"), "otype")
        for name in names[1:]:
            nxt = self.st.where(F.col("p") == self.uri(name)).select(F.col("s").alias("v"), F.col("o").alias("w"), F.col("otype").alias("kind"))
            out = out.where("otype = 'R'").join(nxt, "v").select("id", F.col("w").alias("v"), F.col("kind").alias("otype"))
        return out

    def value(self, expr, subjects: DataFrame) -> DataFrame:
        """(id, v) of an expression for some subjects; without a value there is no row."""
        if isinstance(expr, Prop):
            return self.prop(expr.names).select("id", "v")
        if isinstance(expr, Label):
            return subjects.select("id", F.col("id").alias("v"))
        if isinstance(expr, Value):
            return subjects.select("id", F.lit(expr.value).alias("v"))
        numeric = expr.op in ARITHMETIC
        frame = None
        for i, arg in enumerate(expr.args):
            v = F.col("v").cast("string").try_cast("double") if numeric else F.col("v")
            one = self.value(arg, subjects).select("id", v.alias(f"v{i}"))
            frame = one if frame is None else frame.join(one, "id")
        build = ARITHMETIC[expr.op] if numeric else self.functions[expr.op]
        return frame.select("id", build(*[F.col(f"v{i}") for i in range(len(expr.args))]).alias("v")).where("v is not null")

    # filters: frames (id)

    def ids(self, expr, subjects: DataFrame) -> DataFrame:
        """Subjects a condition holds for."""
        if isinstance(expr, Op) and expr.op == "and":
            return self.ids(expr.args[1], self.ids(expr.args[0], subjects))
        if isinstance(expr, Op) and expr.op == "or":
            return self.ids(expr.args[0], subjects).union(self.ids(expr.args[1], subjects)).distinct()
        if isinstance(expr, Op) and expr.op == "not":
            return subjects.join(self.ids(expr.args[0], subjects), "id", "left_anti")
        if isinstance(expr, Op) and expr.op == "is null":
            return subjects.join(self.value(expr.args[0], subjects), "id", "left_anti")
        if isinstance(expr, Op) and expr.op == "in":
            options = [x.value for x in expr.args[1:]]
            numbers = all(isinstance(x, float) for x in options)
            v = F.col("v").cast("string").try_cast("double") if numbers else F.col("v").cast("string")
            return subjects.join(self.value(expr.args[0], subjects).where(v.isin(options)), "id", "left_semi")
        if isinstance(expr, Op) and expr.op in COMPARE:
            a, b = expr.args
            number = expr.op not in ("=", "!=") or any(isinstance(x, Value) and isinstance(x.value, float) or isinstance(x, Op) and x.op in ARITHMETIC for x in (a, b))
            cast = (lambda c: c.cast("string").try_cast("double")) if number else (lambda c: c.cast("string"))
            left = self.value(a, subjects)
            if isinstance(b, Value):
                return subjects.join(left.where(COMPARE[expr.op](cast(F.col("v")), F.lit(b.value))), "id", "left_semi")
            right = self.value(b, subjects).withColumnRenamed("v", "w")
            return subjects.join(left.join(right, "id").where(COMPARE[expr.op](cast(F.col("v")), cast(F.col("w")))), "id", "left_semi")
        return subjects.join(self.value(expr, subjects), "id", "left_semi")

    @staticmethod
    def ties(expr) -> tuple[list[tuple[list[str], str]], object]:
        """Equalities of a property with a label, and what is left of a condition."""
        if isinstance(expr, Op) and expr.op == "and":
            a, left = Objects.ties(expr.args[0])
            b, right = Objects.ties(expr.args[1])
            rest = [x for x in (left, right) if x is not None]
            return a + b, (Op("and", rest) if len(rest) == 2 else rest[0] if rest else None)
        if isinstance(expr, Op) and expr.op == "=":
            for x, y in (expr.args, expr.args[::-1]):
                if isinstance(x, Prop) and isinstance(y, Label):
                    return [(x.names, y.name)], None
        return [], expr

    def run(self, text: str) -> DataFrame:
        """A row per resource: id, and an array per key (a scalar where an expression is computed)."""
        return self.build(Parser(text).pattern())[0]

    def build(self, pattern: Pattern) -> tuple[DataFrame, list]:
        subjects = self.st.select(F.col("s").alias("id")).distinct()
        for item in pattern.items:
            if item.required:
                subjects = subjects.join(self.st.where(F.col("p") == self.uri(item.key)).select(F.col("s").alias("id")), "id", "left_semi")
        ties, rest = self.ties(pattern.clauses["where"]) if "where" in pattern.clauses else ([], None)
        if rest is not None:
            subjects = self.ids(rest, subjects)
        out = subjects
        if pattern.star:
            stars = self.st.groupBy(F.col("s").alias("id"), "p").agg(F.array_sort(F.collect_list("o")).alias("o"))
            out = out.join(stars.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "o")))).alias("properties")), "id", "left")
        for item in pattern.items:
            if isinstance(item.value, Pattern):
                inner, tied = self.build(item.value)
                names, label = tied[0]
                keys = self.prop(names).select("id", F.col("v").alias("__outer"))
                nested = inner.join(keys, "id").groupBy("__outer").agg(F.array_sort(F.collect_list(F.struct(*inner.columns))).alias(item.key))
                out = out.join(nested.withColumnRenamed("__outer", "id"), "id", "inner" if item.required else "left")
            else:
                values = self.value(item.value, subjects)
                out = out.join(values.groupBy("id").agg(F.array_sort(F.collect_list("v")).alias(item.key)), "id", "left")
        c = pattern.clauses
        if "groupby" in c:
            key = c["groupby"].names
            out = out.join(self.prop(key).select("id", F.col("v").alias("key")), "id").groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        if "orderby" in c:
            first = self.value(c["orderby"], subjects).groupBy("id").agg(F.min("v").alias("__order"))
            out = out.join(first, "id", "left").orderBy(F.col("__order").asc_nulls_last(), "id").drop("__order")
        if "offset" in c:
            out = out.offset(int(c["offset"].value))
        if "limit" in c:
            out = out.limit(int(c["limit"].value))
        return out, ties


def shaped(values: Column, empty: str = "null", listed: bool = False) -> Column:
    """JSON of an array by the document rule: one value alone, several as a list; none as null or an empty list."""
    if listed:
        return F.to_json(F.coalesce(values, F.array()))
    none = {"null": F.lit(None), "list": F.lit("[]")}[empty]
    single = F.to_json(F.slice(values, 1, 1))
    return F.when(F.coalesce(F.size(values), F.lit(0)) == 0, none).when(F.size(values) == 1, F.substring(single, F.lit(2), F.char_length(single) - 2)).otherwise(F.to_json(values))
