"""Statement formats: N-Triples and its change log, RDF/XML, RDF JSON, nested JSON documents, and a plain XML markup.

Line formats are parsed with built-in functions; XML and nested documents by Arrow-batched kernels over whole files.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import COLUMNS, FIRST, NIL, RDF, REST, SCHEMA, TYPE

LINE = r'^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z][\w-]*)|\^\^<?([^\s>.]+(?:\.[^\s>.]+)*)>?)?)\s*\.\s*$'


def unescaped(text: Column) -> Column:
    """Backslash escapes are JSON's, but for eight-digit ones."""
    safe = F.regexp_replace(text, r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1")
    return F.when(F.contains(text, F.lit("\\")), F.element_at(F.from_json(F.concat(F.lit('["'), safe, F.lit('"]')), "array<string>"), 1)).otherwise(text)


def escaped(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Statements of N-Triples lines; blank lines and comments are skipped, other bad lines are errors."""
    line = F.col(column)
    part = lambda i: F.regexp_extract(line, LINE, i)
    blank = lambda x: F.concat(F.lit("bnode:"), F.substring(x, F.lit(3), F.char_length(x)))
    real = lines.where(~line.rlike(r"^\s*(#.*)?$"))
    ok = F.when(line.rlike(LINE), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not an N-Triples line: "), line)).cast("boolean"))
    other = [c for c in lines.columns if c != column]
    return real.where(ok).select(
        F.when(part(2) != "", blank(part(2))).otherwise(part(1)).alias("s"),
        part(3).alias("p"),
        F.when(part(5) != "", blank(part(5))).when(line.rlike(r'>\s+"'), unescaped(part(6))).otherwise(part(4)).alias("o"),
        F.when(part(7) != "", part(7)).when(part(8) != "", part(8)).when(line.rlike(r'>\s+"'), "L").otherwise("R").alias("otype"),
        F.lit("").alias("ctx"),
        *other,
    )


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def to_line(s: Column, p: Column, o: Column, otype: Column) -> Column:
    """One N-Triples line; a URI with white space is an error."""
    term = lambda x: F.when(x.startswith("bnode:"), F.concat(F.lit("_:"), F.substring(x, F.lit(7), F.char_length(x)))).when(x.rlike(r"[\s<>]"), F.raise_error(F.concat(F.lit("bad URI: "), x))).otherwise(F.concat(F.lit("<"), x, F.lit(">")))
    text = F.concat(F.lit('"'), escaped(o), F.lit('"'))
    value = F.when(otype == "R", term(o)).when(otype == "L", text).when(F.contains(otype, F.lit(":")), F.concat(text, F.lit("^^<"), otype, F.lit(">"))).otherwise(F.concat(text, F.lit("@"), otype))
    return F.concat_ws(" ", term(s), F.concat(F.lit("<"), p, F.lit(">")), value, F.lit("."))


def write_ntriples(st: DataFrame, path: str) -> None:
    st.select(to_line(*[F.col(c) for c in COLUMNS[:4]]).alias("value")).write.mode("overwrite").text(path)


def parse_log(lines: DataFrame, column: str = "value", order: str = "line", source: str | None = None) -> DataFrame:
    """Operations (seq, op, s, p, o, otype, ctx) of a change log.

    A directive holds for the next statement line only: ``#!remove ctx`` makes it a removal, ``#!graph ctx`` names
    its context. Lines are ordered within a source (a file), never across sources.
    """
    w = Window.partitionBy(*([source] if source else [])).orderBy(order)
    line = F.col(column)
    kept = lines.where(line.rlike(r"^\s*#!(remove|graph)") | ~line.rlike(r"^\s*(#.*)?$"))
    before = kept.withColumn("__before", F.lag(line).over(w))
    mark = F.when(F.col("__before").rlike(r"^\s*#!"), F.col("__before"))
    marked = before.select(column, F.col(order).alias("seq"), mark.alias("__mark")).where(~line.rlike(r"^\s*#"))
    parsed = parse_lines(marked, column)
    return parsed.select("seq", F.when(F.col("__mark").rlike("#!remove"), "remove").otherwise("add").alias("op"), *COLUMNS[:4], F.coalesce(F.regexp_extract("__mark", r"#!(?:remove|graph)\s*(\S*)", 1), F.lit("")).alias("ctx"))


def to_log(ops: DataFrame) -> DataFrame:
    """Blocks of log lines (txn, seq, value), each transaction between its begin and end."""
    text = to_line(*[F.col(c) for c in COLUMNS[:4]])
    mark = F.when(F.col("op") == "remove", F.concat(F.lit("#!remove "), "ctx")).when(F.col("ctx") != "", F.concat(F.lit("#!graph "), "ctx"))
    body = ops.select("txn", "seq", F.explode(F.filter(F.array(F.struct(F.lit(0).alias("i"), mark.alias("value")), F.struct(F.lit(1).alias("i"), text.alias("value"))), lambda x: x["value"].isNotNull())).alias("x")).select("txn", "seq", "x.*")
    ends = ops.groupBy("txn").agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
    frame = ends.select("txn", F.explode(F.array(F.struct(F.col("a").alias("seq"), F.lit(-1).alias("i"), F.lit("#begin").alias("value")), F.struct(F.col("b").alias("seq"), F.lit(2).alias("i"), F.lit("#end").alias("value")))).alias("x")).select("txn", "x.*")
    return body.unionByName(frame)


# documents: a file or a row is a whole graph


def _rows(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=COLUMNS, dtype=object)


def parse_documents(texts: DataFrame, parse, column: str = "value") -> DataFrame:
    """Statements of texts that are documents each, by a parser of one document."""

    def run(batches):
        for b in batches:
            yield _rows([r for text in b[column] if text is not None for r in parse(text)])

    return texts.select(column).mapInPandas(run, SCHEMA)


def rdfxml(text: str) -> list[tuple]:
    """Node elements, property elements, property attributes, and nested nodes."""
    out: list[tuple] = []
    xml = "{http://www.w3.org/XML/1998/namespace}"
    name = lambda tag: tag[1:].replace("}", "")
    serial = iter(range(1 << 60))

    def node(e: ET.Element) -> str:
        s = e.get(f"{{{RDF}}}about") or (f"bnode:{e.get(f'{{{RDF}}}nodeID')}" if e.get(f"{{{RDF}}}nodeID") else f"bnode:d{next(serial)}")
        if e.get(f"{{{RDF}}}ID"):
            s = "#" + e.get(f"{{{RDF}}}ID")
        if name(e.tag) != RDF + "Description":
            out.append((s, TYPE, name(e.tag), "R", ""))
        for k, v in e.attrib.items():
            if not k.startswith((f"{{{RDF}}}", xml)):
                out.append((s, name(k), v, "L", ""))
        for child in e:
            value(s, child)
        return s

    def value(s: str, e: ET.Element) -> None:
        p = name(e.tag)
        if (r := e.get(f"{{{RDF}}}resource")) is not None:
            out.append((s, p, r, "R", ""))
        elif (r := e.get(f"{{{RDF}}}nodeID")) is not None:
            out.append((s, p, f"bnode:{r}", "R", ""))
        elif e.get(f"{{{RDF}}}parseType") == "Collection":
            cells = [f"bnode:c{next(serial)}" for _ in e]
            out.append((s, p, cells[0] if cells else NIL, "R", ""))
            for i, item in enumerate(e):
                out.append((cells[i], FIRST, node(item), "R", ""))
                out.append((cells[i], REST, cells[i + 1] if i + 1 < len(cells) else NIL, "R", ""))
        elif len(e):
            out.append((s, p, node(e[0]), "R", ""))
        else:
            out.append((s, p, e.text or "", e.get(f"{{{RDF}}}datatype") or e.get(f"{xml}lang") or "L", ""))

    root = ET.fromstring(text)
    for e in [root] if name(root.tag) != RDF + "RDF" else root:
        node(e)
    return out


def to_rdfxml(rows: list[tuple]) -> str:
    """One document of statements (s, p, o, otype)."""
    root = ET.Element(f"{{{RDF}}}RDF")
    of: dict[str, ET.Element] = {}
    for s, p, o, otype in rows:
        if s not in of:
            of[s] = ET.SubElement(root, f"{{{RDF}}}Description", {f"{{{RDF}}}nodeID": s[6:]} if s.startswith("bnode:") else {f"{{{RDF}}}about": s})
        cut = max(p.rfind("#"), p.rfind("/"), p.rfind(":")) + 1
        e = ET.SubElement(of[s], f"{{{p[:cut]}}}{p[cut:]}")
        if otype == "R":
            e.set(f"{{{RDF}}}nodeID" if o.startswith("bnode:") else f"{{{RDF}}}resource", o[6:] if o.startswith("bnode:") else o)
        else:
            e.text = o
            if ":" in otype:
                e.set(f"{{{RDF}}}datatype", otype)
            elif otype != "L":
                e.set("{http://www.w3.org/XML/1998/namespace}lang", otype)
    return ET.tostring(root, encoding="unicode")


MARKUP = "urn:markup:"


def markup(text: str) -> list[tuple]:
    """A plain XML form: resources with properties whose values are text, resources, lists or XML."""
    out: list[tuple] = []
    serial = iter(range(1 << 60))
    for r in ET.fromstring(text):
        for e in r:
            s, p = r.get("id"), e.get("name")
            kind = e.get("kind", "literal")
            if kind == "list":
                items = list(e)
                cells = [f"bnode:l{next(serial)}" for _ in items]
                out.append((s, p, cells[0] if cells else NIL, "R", ""))
                for i, item in enumerate(items):
                    out.append((cells[i], FIRST, item.text or "", "R" if item.get("kind") == "resource" else "L", ""))
                    out.append((cells[i], REST, cells[i + 1] if i + 1 < len(cells) else NIL, "R", ""))
            elif kind == "xml":
                out.append((s, p, "".join(ET.tostring(x, encoding="unicode") for x in e), RDF + "XMLLiteral", ""))
            else:
                out.append((s, p, e.text or "", "R" if kind == "resource" else e.get("type", "L"), ""))
    return out


def to_markup(rows: list[tuple]) -> str:
    root, of = ET.Element("graph"), {}
    for s, p, o, otype in rows:
        if s not in of:
            of[s] = ET.SubElement(root, "resource", {"id": s})
        e = ET.SubElement(of[s], "property", {"name": p})
        if otype == "R":
            e.set("kind", "resource")
        elif otype == RDF + "XMLLiteral":
            e.set("kind", "xml")
            e.extend(ET.fromstring(f"<x>{o}</x>"))
            continue
        elif otype != "L":
            e.set("type", otype)
        e.text = o
    return ET.tostring(root, encoding="unicode")


def write_documents(st: DataFrame, write, parts: int) -> DataFrame:
    """``parts`` documents (value) by a writer of one; a resource's statements stay in one document."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(COLUMNS[:4])[COLUMNS[:4]].itertuples(index=False, name=None)
        return pd.DataFrame({"value": [write(list(rows))]})

    return st.withColumn("part", F.pmod(F.xxhash64("s"), F.lit(parts))).groupBy("part").applyInPandas(run, "value string")


def to_rdfjson(st: DataFrame) -> DataFrame:
    """(s, value): a JSON document for each resource, its properties with lists of typed values."""
    kind = F.when(F.col("o").startswith("bnode:") & (F.col("otype") == "R"), "bnode").when(F.col("otype") == "R", "uri").otherwise("literal")
    item = F.struct(kind.alias("type"), F.col("o").alias("value"), F.when((F.length("otype") > 1) & ~F.contains("otype", F.lit(":")), F.col("otype")).alias("lang"), F.when(F.contains("otype", F.lit(":")), F.col("otype")).alias("datatype"))
    props = st.groupBy("s", "p").agg(F.array_sort(F.collect_list(item)).alias("values"))
    whole = props.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "values")))).alias("m"))
    return whole.select("s", F.to_json(F.create_map("s", "m")).alias("value"))


def from_rdfjson(texts: DataFrame, column: str = "value") -> DataFrame:
    kind = "map<string,map<string,array<struct<type:string,value:string,lang:string,datatype:string>>>>"
    flat = texts.select(F.explode(F.from_json(column, kind)).alias("s", "m")).select("s", F.explode("m").alias("p", "values")).select("s", "p", F.explode("values").alias("v"))
    otype = F.when(F.col("v.type").isin("uri", "bnode"), "R").otherwise(F.coalesce("v.datatype", "v.lang", F.lit("L")))
    return flat.select("s", "p", F.col("v.value").alias("o"), otype.alias("otype"), F.lit("").alias("ctx"))


def nested(text: str, ns: str = "") -> list[tuple]:
    """Nested JSON: objects are resources (``id`` or a blank node), lists keep their order, URI-like strings are resources."""
    out: list[tuple] = []
    serial = iter(range(1 << 60))

    def term(v) -> tuple[str, str]:
        if isinstance(v, dict):
            return resource(v), "R"
        if isinstance(v, list):
            cells = [f"bnode:j{next(serial)}" for _ in v]
            for i, x in enumerate(v):
                o, kind = term(x)
                out.append((cells[i], FIRST, o, kind, ""))
                out.append((cells[i], REST, cells[i + 1] if i + 1 < len(v) else NIL, "R", ""))
            return (cells[0] if cells else NIL), "R"
        if isinstance(v, bool):
            return str(v).lower(), "http://www.w3.org/2001/XMLSchema#boolean"
        if isinstance(v, (int, float)):
            return repr(v), "http://www.w3.org/2001/XMLSchema#" + ("integer" if isinstance(v, int) else "double")
        return str(v), "R" if re.match(r"^(https?://|urn:|bnode:|mailto:)\S+$", str(v)) else "L"

    def resource(d: dict) -> str:
        s = str(d["id"]) if "id" in d else f"bnode:j{next(serial)}"
        for k, v in d.items():
            if k not in ("id", "shared") and v is not None:
                o, kind = term(v)
                out.append((s, k if ":" in k else ns + k, o, kind, ""))
        return s

    data = json.loads(text)
    for d in data if isinstance(data, list) else [*data.get("shared", []), *([data] if set(data) - {"shared"} else [])]:
        resource(d)
    return out


def to_nested(st: DataFrame) -> DataFrame:
    """(s, value): a JSON document for each resource; values that are resources stay references, lists come whole.

    Resources that several others refer to are marked ``shared``.
    """
    inner = st.where(F.col("p").isin(FIRST, REST)).select("s").distinct()
    heads = st.join(inner.select(F.col("s").alias("o")), "o", "left_semi").where(~F.col("p").isin(FIRST, REST)).select(F.col("o").alias("s")).distinct()
    from ..operators.update import list_order

    items = list_order(st, heads).groupBy("head").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"])).alias("items"))
    plain = st.join(inner, "s", "left_anti").join(items.withColumnRenamed("head", "o"), "o", "left")
    text = F.coalesce("items", F.to_json(F.array("o")))
    value = F.when(F.col("items").isNotNull() | (F.col("o") == NIL), F.coalesce("items", F.lit("[]"))).otherwise(F.substring(text, F.lit(2), F.char_length(text) - 2))
    props = plain.withColumn("v", value).groupBy("s", "p").agg(F.array_sort(F.collect_list("v")).alias("v"))
    pair = F.concat(F.lit('"'), escaped(F.col("p")), F.lit('":'), F.when(F.size("v") == 1, F.element_at("v", 1)).otherwise(F.concat(F.lit("["), F.array_join("v", ","), F.lit("]"))))
    refs = st.where("otype = 'R'").groupBy(F.col("o").alias("s")).agg((F.count("*") > 1).alias("shared"))
    docs = props.withColumn("pair", pair).groupBy("s").agg(F.array_join(F.array_sort(F.collect_list("pair")), ",").alias("body"))
    return docs.join(refs, "s", "left").select("s", F.coalesce("shared", F.lit(False)).alias("shared"), F.concat(F.lit('{"id":"'), escaped(F.col("s")), F.lit('",'), "body", F.lit("}")).alias("value"))


def sniff(name: str, head: str) -> str:
    """Format of a document by its name, else by its first characters."""
    for end, kind in ((".nt", "ntriples"), (".rdf", "rdfxml"), (".json", "nested"), (".ttl", "turtle")):
        if name.lower().endswith(end):
            return kind
    text = head.lstrip()
    if text.startswith("<?xml") or re.match(r"<[A-Za-z]", text):
        return "rdfxml" if re.search(r"<(\w+:)?RDF\b", text) else "markup" if re.search(r"<graph\b", text) else "rdfxml"
    if text.startswith(("{", "[")):
        return "rdfjson" if re.search(r'"type"\s*:\s*"(uri|literal|bnode)"', text) else "nested"
    return "ntriples"


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Statements of a file or folder in any of the formats."""
    if kind is None:
        head = spark.read.format("binaryFile").load(path).select("path", F.substring(F.col("content").cast("string"), 1, 2000).alias("head")).first()
        kind = sniff(head.path, head.head)
    if kind == "turtle":
        raise NotImplementedError("Turtle is not supported; convert to N-Triples")
    if kind == "ntriples":
        return read_ntriples(spark, path)
    whole = spark.read.text(path, wholetext=True)
    return from_rdfjson(whole) if kind == "rdfjson" else parse_documents(whole, {"rdfxml": rdfxml, "markup": markup, "nested": nested}[kind])


def build(resources: dict) -> list[tuple]:
    """Statements of a dictionary {subject: {property: value or list}}; nested dictionaries are blank nodes."""
    return [r for s, props in resources.items() for r in nested(json.dumps({"id": s} | props))]


class StatementSource:
    """Statements kept anywhere Spark reads: parquet, csv, json, orc or jdbc, with columns s, p, o, otype, ctx."""

    def __init__(self, spark: SparkSession, kind: str = "parquet", **options):
        self.spark, self.kind, self.options = spark, kind, options

    def load(self, path: str | None = None) -> DataFrame:
        reader = self.spark.read.format(self.kind).options(**self.options)
        return (reader.schema(SCHEMA) if self.kind in ("csv", "json") else reader).load(path).select(*COLUMNS)

    def save(self, st: DataFrame, path: str | None = None, mode: str = "overwrite") -> None:
        """Sorted by property within files, so a scan for one property skips the rest."""
        writer = st.sortWithinPartitions("p", "s").write.format(self.kind).options(**self.options).mode(mode)
        writer.save(path)
