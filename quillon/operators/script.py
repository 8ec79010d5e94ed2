"""Update scripts: an XML dialect whose instructions select nodes by path and change them all at once.

Instructions: variable, remove, update, replace, rename, append, insert-before, insert-after, if, for-each, template,
call-template, include, message. Content is built from property elements, element, attribute (language, datatype or
resource of the property), text, value-of and copy-of. ``to-graph`` puts what is added into a context. Inside for-each,
``$current`` is the set of nodes looped over; instructions apply to all of them together.
"""

from __future__ import annotations

import logging
import xml.etree.ElementTree as ET
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import COLUMNS, RDF
from ..plans.pathlang import Path, Step, Variable, parse
from ..plans.paths import KEY, Engine, Nodes
from . import update as up

log = logging.getLogger(__name__)
XML = "{http://www.w3.org/XML/1998/namespace}"


class Stop(Exception):
    """A message that ends the script."""


class Script:
    def __init__(self, st: DataFrame, prefixes: dict[str, str], load: Callable[[str], str] | None = None):
        self.st, self.prefixes, self.load = st, prefixes, load
        self.variables: dict = {}
        self.current: Nodes | None = None
        self.templates: dict[str, ET.Element] = {}

    def run(self, text: str) -> DataFrame:
        root = ET.fromstring(text)
        for e in root.iter():
            if self.local(e) == "template":
                self.templates[e.get("name")] = e
        for e in root:
            self.instruction(e)
        return self.st

    @staticmethod
    def local(e: ET.Element) -> str:
        return e.tag.rsplit("}", 1)[-1]

    def engine(self) -> Engine:
        return Engine(self.st, self.prefixes, self.variables)

    def select(self, text: str) -> Nodes:
        expr = parse(text)
        if isinstance(expr, Variable) and expr.name == "current":
            return self.current
        if isinstance(expr, Path) and not expr.absolute and self.current is not None:
            return self.engine().walk(self.current, expr)
        return self.engine().run(expr)

    @staticmethod
    def subjects(nodes: Nodes) -> DataFrame:
        return nodes.df.select(F.col("id" if nodes.level == "resource" else "s").alias("s")).distinct()

    def statements(self, nodes: Nodes) -> DataFrame:
        """Selected statements; a resource stands for all of its own."""
        if nodes.level == "resource":
            return self.st.join(self.subjects(nodes), "s", "left_semi").select(*COLUMNS)
        return nodes.df.select("s", "p", "o", "otype").distinct().withColumn("ctx", F.lit(""))

    def instruction(self, e: ET.Element) -> None:
        kind = self.local(e)
        getattr(self, "do_" + kind.replace("-", "_"))(e)

    def do_variable(self, e):
        nodes = self.select(e.get("select"))
        self.variables[e.get("name")] = nodes.df.select(nodes.value().cast("string").alias("v")).distinct()

    def do_remove(self, e):
        graph, old = e.get("to-graph"), self.statements(self.select(e.get("select")))
        self.st = up.remove(self.st, old.withColumn("ctx", F.lit(graph)), scoped=True) if graph else up.remove(self.st, old)

    def do_update(self, e):
        self.st = up.replace_values(self.st, self.statements(self.select(e.get("select"))), F.lit((e.text or "").strip()))

    def do_rename(self, e):
        self.st = up.rename_property(self.st, self.statements(self.select(e.get("select"))), self.engine().uri((e.text or "").strip()))

    def do_append(self, e):
        nodes = self.select(e.get("select"))
        new = self.content(e, self.subjects(nodes), e.get("to-graph") or "")
        if new is not None:
            self.st = up.add(self.st, new)

    do_insert_before = do_insert_after = do_append

    def do_replace(self, e):
        nodes = self.select(e.get("select"))
        subjects, old = self.subjects(nodes), self.statements(nodes)
        new = self.content(e, subjects, e.get("to-graph") or "")
        self.st = up.remove(self.st, old)
        if new is not None:
            self.st = up.add(self.st, new)

    def do_if(self, e):
        expr = parse(e.get("test"))
        here = self.current or Nodes("document", None)
        holds = not self.engine().walk(here, expr).df.isEmpty() if isinstance(expr, Path) else not self.engine().run(expr).df.isEmpty()
        if holds:
            for child in e:
                self.instruction(child)

    def do_for_each(self, e):
        outer, self.current = self.current, self.select(e.get("select"))
        for child in e:
            self.instruction(child)
        self.current = outer

    def do_template(self, e):
        self.templates[e.get("name")] = e

    def do_call_template(self, e):
        for child in self.templates[e.get("name")]:
            self.instruction(child)

    def do_include(self, e):
        for child in ET.fromstring(self.load(e.get("href"))):
            self.instruction(child)

    def do_message(self, e):
        text = "".join(e.itertext()).strip()
        log.info("%s", text)
        if e.get("terminate") == "yes":
            raise Stop(text)

    # content

    def content(self, e: ET.Element, subjects: DataFrame, ctx: str) -> DataFrame | None:
        """Statements that the children of an instruction describe, for all subjects."""
        parts = [self.property(child, subjects, ctx) for child in e]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def property(self, e: ET.Element, subjects: DataFrame, ctx: str) -> DataFrame:
        kind = self.local(e)
        if kind == "copy-of":
            nodes = self.select(e.get("select"))
            said = self.statements(nodes).select("p", "o", "otype").distinct().withColumn("__k", F.lit(0))
            return subjects.withColumn("__k", F.lit(0)).join(said, "__k").select("s", "p", "o", "otype", F.lit(ctx).alias("ctx"))
        p = self.engine().uri(e.get("name")) if kind == "element" else e.tag[1:].replace("}", "")
        marks = {self.attribute_name(a.get("name")): (a.text or "").strip() for a in e if self.local(a) == "attribute"}
        marks |= {self.attribute_name(k): v for k, v in e.attrib.items() if k != "name"}
        otype = "R" if "resource" in marks else marks.get("datatype") or marks.get("lang") or "L"
        source = next((x for x in e if self.local(x) == "value-of"), None)
        if source is not None:
            engine = self.engine()
            here = Nodes("resource", subjects.select(F.col("s").alias("id"), F.col("s").alias(KEY)))
            expr = parse(source.get("select"))
            expr = Path(False, (Step("self", "node()"),)) if isinstance(expr, Variable) and expr.name == "current" else expr
            value, frame = engine.value(here, expr, every=True)
            return frame.select(F.col(KEY).alias("s"), F.lit(p).alias("p"), value.cast("string").alias("o"), F.lit(otype).alias("otype"), F.lit(ctx).alias("ctx"))
        text = "".join([(e.text or ""), *("".join(x.itertext()) for x in e if self.local(x) == "text")]).strip()
        return subjects.select("s", F.lit(p).alias("p"), F.lit(marks.get("resource", text)).alias("o"), F.lit(otype).alias("otype"), F.lit(ctx).alias("ctx"))

    @staticmethod
    def attribute_name(name: str) -> str:
        return {RDF + "resource": "resource", RDF + "datatype": "datatype", "http://www.w3.org/XML/1998/namespacelang": "lang"}.get(name.lstrip("{").replace("}", ""), name.rsplit(":", 1)[-1])
