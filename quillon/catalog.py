"""Named queries over the shared tables, and the same questions as SQL over the base tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import data, model, schema
from .data import BASE, NS, graph, table
from .functions import text as tx
from .functions import xpath as xp
from .model import TRIPLE, TYPE, XSD
from .operators import fulltext as ft
from .operators import relational as rel
from .operators import rules, scan
from .operators import update as up
from .plans.objects import Objects, shaped
from .plans.paths import Engine
from .sources import formats

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PREFIXES = {"q": NS}
B, N = BASE, NS


def query(name: str, sql: str | None = None):
    def put(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def path(st: DataFrame, text: str, variables: dict | None = None) -> DataFrame:
    return Engine(st, PREFIXES, variables).select(text)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q["path_flagship"](spark, sf_dir)


def key_of(column: str) -> F.Column:
    """The number at the end of a resource's URI."""
    return F.substring_index(F.col(column), "/", -1).cast("long")


CUSTOMER_ST = f"""
    SELECT '{B}customer/' || c_custkey AS s, '{TYPE}' AS p, '{N}Customer-' || c_mktsegment AS o, 'R' AS otype FROM customer
    UNION ALL SELECT '{B}customer/' || c_custkey, '{N}name', c_name, 'L' FROM customer
    UNION ALL SELECT '{B}customer/' || c_custkey, '{N}segment', c_mktsegment, 'L' FROM customer
    UNION ALL SELECT '{B}customer/' || c_custkey, '{N}nation', '{B}nation/' || c_nationkey, 'R' FROM customer
    UNION ALL SELECT '{B}customer/' || c_custkey, '{N}balance', CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR), '{XSD}integer' FROM customer"""
NATION_ST = f"""
    SELECT '{B}nation/' || n_nationkey AS s, '{TYPE}' AS p, '{N}Nation' AS o, 'R' AS otype FROM nation
    UNION ALL SELECT '{B}nation/' || n_nationkey, '{N}name', n_name, 'L' FROM nation
    UNION ALL SELECT '{B}nation/' || n_nationkey, '{N}region', '{B}region/' || n_regionkey, 'R' FROM nation"""
REGION_ST = f"""
    SELECT '{B}region/' || r_regionkey AS s, '{TYPE}' AS p, '{N}Region' AS o, 'R' AS otype FROM region
    UNION ALL SELECT '{B}region/' || r_regionkey, '{N}name', r_name, 'L' FROM region"""

# scans


@query("scan_pattern", f"SELECT '{B}customer/' || c_custkey AS s, '{N}segment' AS p, c_mktsegment AS o, 'L' AS otype FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    return scan.pattern(graph(spark, d, "customer", "nation"), p=NS + "segment", o="BUILDING").select(*TRIPLE)


@query("scan_by_position", f"SELECT s, p, o, otype FROM ({NATION_ST}) WHERE p = '{N}region' AND otype = 'R'")
def _(spark, d):
    return scan.by_position(graph(spark, d, "nation", "region"), {1: NS + "region", 3: "R"}).select(*TRIPLE)


@query("scan_contains", f"SELECT '{B}nation/' || k AS s, k IN (SELECT n_nationkey FROM nation) AS found FROM range(0, 40) t(k)")
def _(spark, d):
    asked = spark.range(40).select(F.concat(F.lit(B + "nation/"), "id").alias("s"))
    return scan.contains(graph(spark, d, "nation"), asked)


@query("scan_size", "SELECT count(*) AS subjects, 5 * count(*) AS statements FROM customer")
def _(spark, d):
    return scan.size(graph(spark, d, "customer"))


@query("scan_graph", f"SELECT s, p, o, otype FROM ({REGION_ST})")
def _(spark, d):
    both = graph(spark, d, "nation").unionByName(graph(spark, d, "region").withColumn("ctx", F.lit("context:regions")))
    return scan.graph(both, "context:regions").select(*TRIPLE)


@query("scan_subject_star", f"SELECT c.* FROM ({CUSTOMER_ST}) c JOIN customer k ON c.s = '{B}customer/' || k.c_custkey WHERE k.c_mktsegment = 'MACHINERY' AND k.c_acctbal > 9000")
def _(spark, d):
    st = graph(spark, d, "customer")
    rich = path(st, "/*[q:segment='MACHINERY' and q:balance > 900000]").select(F.col("id").alias("s"))
    return scan.star(st, rich).select(*TRIPLE)


@query("scan_reified", f"SELECT '{B}nation/' || n_nationkey AS s, n_name AS o, 'urn:fact:' || n_nationkey AS statement FROM nation WHERE n_regionkey = 1")
def _(spark, d):
    names = table(spark, d, "nation").where("n_regionkey = 1")
    about = model.triplify(
        names,
        F.concat(F.lit("urn:fact:"), "n_nationkey"),
        {model.RDF + "subject": (data.uri("nation", F.col("n_nationkey")), "R"), model.RDF + "predicate": (F.lit(NS + "name"), "R"), model.RDF + "object": (F.col("n_name"), "L")},
    )
    return scan.reified(graph(spark, d, "nation").unionByName(about)).select("s", "o", "statement")


# formats: each writes the graph of nations and reads it again


def _nations(spark, d):
    return graph(spark, d, "nation")


@query("sink_ntriples", f"""SELECT '<' || s || '> <' || p || '> ' || CASE WHEN otype = 'R' THEN '<' || o || '>' ELSE '"' || o || '"' END || ' .' AS value FROM ({NATION_ST})""")
def _(spark, d):
    return _nations(spark, d).select(formats.to_line(*[F.col(c) for c in TRIPLE]).alias("value"))


@query("src_ntriples", NATION_ST)
def _(spark, d):
    return formats.parse_lines(Q["sink_ntriples"](spark, d)).select(*TRIPLE)


@query("src_rdfxml", NATION_ST)
def _(spark, d):
    return formats.parse_documents(formats.write_documents(_nations(spark, d), formats.to_rdfxml, 4), formats.rdfxml).select(*TRIPLE)


@query("src_xml_markup", NATION_ST)
def _(spark, d):
    return formats.parse_documents(formats.write_documents(_nations(spark, d), formats.to_markup, 4), formats.markup).select(*TRIPLE)


@query("src_rdfjson", NATION_ST)
def _(spark, d):
    return formats.from_rdfjson(formats.to_rdfjson(_nations(spark, d))).select(*TRIPLE)


@query("src_sjson", f"SELECT s, p, o, otype FROM ({NATION_ST})")
def _(spark, d):
    return formats.parse_documents(formats.to_nested(_nations(spark, d)), formats.nested).select(*TRIPLE)


@query("sink_rdfjson", f"""SELECT '{B}region/' || r_regionkey AS s, '{{"{B}region/' || r_regionkey || '":{{"{N}name":[{{"type":"literal","value":"' || r_name || '"}}],"{TYPE}":[{{"type":"uri","value":"{N}Region"}}]}}}}' AS value FROM region""")
def _(spark, d):
    return formats.to_rdfjson(graph(spark, d, "region"))


@query("sink_sjson", f"""SELECT '{B}region/' || r_regionkey AS s, false AS shared, '{{"id":"{B}region/' || r_regionkey || '","{N}name":"' || r_name || '","{TYPE}":"{N}Region"}}' AS value FROM region""")
def _(spark, d):
    return formats.to_nested(graph(spark, d, "region"))


@query("sink_rdfxml")
def _(spark, d):
    return formats.write_documents(_nations(spark, d), formats.to_rdfxml, 4)


@query("sink_xml_markup")
def _(spark, d):
    return formats.write_documents(_nations(spark, d), formats.to_markup, 4)


@query("src_ntriples_log", f"SELECT '{B}nation/' || n_nationkey AS s, n_name AS o FROM nation WHERE n_regionkey <> 2")
def _(spark, d):
    """A log that says all nations' names, then takes those of one region back."""
    names = table(spark, d, "nation")
    ops = names.select(F.lit(1).alias("txn"), F.col("n_nationkey").cast("long").alias("seq"), F.lit("add").alias("op"), data.uri("nation", F.col("n_nationkey")).alias("s"), F.lit(NS + "name").alias("p"), F.col("n_name").alias("o"), F.lit("L").alias("otype"), F.lit("").alias("ctx"), "n_regionkey")
    back = ops.where("n_regionkey = 2").withColumn("op", F.lit("remove")).withColumn("txn", F.lit(2)).withColumn("seq", F.col("seq") + 100)
    lines = formats.to_log(ops.unionByName(back)).select("value", (F.col("txn") * 1_000_000 + F.col("seq") * 10 + F.col("i")).alias("line"))
    return up.replay(formats.parse_log(lines).withColumn("version", F.col("seq"))).select("s", "o")


@query("sink_log_append", "SELECT 3 * count(*) + 2 * count(DISTINCT n_regionkey) - count(*) AS n_lines FROM nation")
def _(spark, d):
    names = table(spark, d, "nation")
    ops = names.select(F.col("n_regionkey").alias("txn"), F.col("n_nationkey").alias("seq"), F.lit("add").alias("op"), data.uri("nation", F.col("n_nationkey")).alias("s"), F.lit(NS + "name").alias("p"), F.col("n_name").alias("o"), F.lit("L").alias("otype"), F.lit("context:a").alias("ctx"))
    return formats.to_log(ops).agg(F.count("*").alias("n_lines"))


@query("src_sniff", "SELECT * FROM (VALUES ('a.nt', 'ntriples'), ('b', 'rdfxml'), ('c', 'nested')) t(name, kind)")
def _(spark, d):
    found = [("a.nt", formats.sniff("a.nt", "")), ("b", formats.sniff("b", "<rdf:RDF>")), ("c", formats.sniff("c", '{"id": 1}'))]
    return spark.createDataFrame(found, "name string, kind string")


@query("src_builder", "SELECT 'urn:a' AS s, 'urn:p' AS p, 'x' AS o, 'L' AS otype UNION ALL SELECT 'urn:a', 'urn:q', 'urn:b', 'R'")
def _(spark, d):
    return model.statements(spark, formats.build({"urn:a": {"urn:p": "x", "urn:q": "urn:b"}})).select(*TRIPLE)


# composition


@query("model_union", f"SELECT s, p, o, otype FROM ({NATION_ST}) UNION SELECT s, p, o, otype FROM ({REGION_ST})")
def _(spark, d):
    return model.union(graph(spark, d, "nation"), graph(spark, d, "region"), graph(spark, d, "nation")).select(*TRIPLE)


@query("model_view", f"SELECT s, p, o, otype FROM ({CUSTOMER_ST}) WHERE p = '{N}name'")
def _(spark, d):
    model.view(graph(spark, d, "customer"), "names_of_customers", f"p = '{NS}name'")
    return spark.table("names_of_customers").select(*TRIPLE)


@query("model_txn", f"SELECT '{B}nation/' || n_nationkey AS s, CASE WHEN n_regionkey = 3 THEN lower(n_name) ELSE n_name END AS o FROM nation WHERE n_regionkey <> 4")
def _(spark, d):
    st = graph(spark, d, "nation")
    names = st.where(F.col("p") == NS + "name")
    of = lambda k: names.join(path(st, f"/*[q:region/@rdf:about='{BASE}region/{k}']").select(F.col("id").alias("s")), "s", "left_semi")
    t = model.Transaction(names)
    t.remove(of(4)).remove(of(3)).add(of(3).withColumn("o", F.lower("o"))).remove(of(2)).add(of(2))
    return t.view().select("s", "o")


@query("model_exclude_deleted", f"SELECT s, p, o, otype FROM ({NATION_ST})")
def _(spark, d):
    gone = graph(spark, d, "region").withColumn("ctx", F.lit("context:del:1"))
    return model.without_deleted(graph(spark, d, "nation").unionByName(gone)).select(*TRIPLE)


@query("model_filter_unique", f"SELECT s, p, o, otype FROM ({REGION_ST})")
def _(spark, d):
    return model.unique(graph(spark, d, "region", "region")).select(*TRIPLE)


# paths


def paths(name: str, text: str, sql: str, *tables: str, level: str = "value", variables: dict | None = None):
    """A query that is one path; its result is the column ``value``."""

    def run(spark, d):
        return path(graph(spark, d, *tables), text, variables).select(F.col("value").alias(level)).distinct()

    Q[name], SQL[name] = run, sql


C = ("customer", "nation", "region")
paths("path_flagship", "/q:Customer-BUILDING/q:nation/*/q:name/text()", "SELECT DISTINCT n_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'", *C)
paths("path_select", "/*[q:segment='BUILDING']", f"SELECT '{B}customer/' || c_custkey AS value FROM customer WHERE c_mktsegment = 'BUILDING'", *C)
paths("path_project", "/*[q:region]", f"SELECT '{B}nation/' || n_nationkey AS value FROM nation", *C)
paths("path_child_step", "/q:Nation/q:region/*/q:name", "SELECT DISTINCT r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey", *C)
paths("path_parent_step", "/q:Nation/q:region/*/q:name[.='ASIA']/..", f"SELECT '{B}region/' || r_regionkey AS value FROM region WHERE r_name = 'ASIA' AND r_regionkey IN (SELECT n_regionkey FROM nation)", *C)
paths("path_attr_step", "/q:Customer-BUILDING/*/@rdf:datatype", f"SELECT '{XSD}integer' AS value", *C)
paths("path_self_step", "/q:Nation/q:name[.!='NATION_8']", "SELECT n_name AS value FROM nation WHERE n_name <> 'NATION_8'", *C)
paths("path_type_test", "/q:Party", f"SELECT '{B}customer/' || c_custkey AS value FROM customer UNION ALL SELECT '{B}supplier/' || s_suppkey FROM supplier", "customer", "supplier", "classes")
paths("path_kind_test", "/q:Nation/*/text()", "SELECT n_name AS value FROM nation", *C)
paths("path_ns_wildcard", "/q:Region/q:*", "SELECT r_name AS value FROM region", "region")
paths("path_positional", "/q:Nation[position() <= 3]/q:name", f"SELECT n_name AS value FROM (SELECT n_name, row_number() OVER (ORDER BY '{B}nation/' || n_nationkey) AS r FROM nation) WHERE r <= 3", *C)
paths("path_variable", "/*[q:segment=$segment]/q:name", "SELECT c_name AS value FROM customer WHERE c_mktsegment = 'FURNITURE'", *C, variables={"segment": "FURNITURE"})
paths("path_id", f"id('{BASE}nation/3 {BASE}nation/4')", f"SELECT '{B}nation/' || n_nationkey AS value FROM nation WHERE n_nationkey IN (3, 4)", "nation")
paths("pred_and", "/*[q:segment='BUILDING' and q:balance > 500000]", f"SELECT '{B}customer/' || c_custkey AS value FROM customer WHERE c_mktsegment = 'BUILDING' AND round(c_acctbal * 100) > 500000", *C)
paths("pred_or", "/*[q:segment='BUILDING' or q:balance < 0]", f"SELECT '{B}customer/' || c_custkey AS value FROM customer WHERE c_mktsegment = 'BUILDING' OR round(c_acctbal * 100) < 0", *C)
paths("pred_eq_ne", "/q:Nation[q:region/*/q:name != 'ASIA']/q:name", "SELECT n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'", *C)
paths("pred_compare", "/*[q:balance >= 900000]/q:name", "SELECT c_name AS value FROM customer WHERE round(c_acctbal * 100) >= 900000", *C)
paths("pred_not", "/q:Nation[not(q:region/*/q:name='ASIA')]/q:name", "SELECT n_name AS value FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')", *C)
paths("set_union_nodes", "/q:Region/q:name | /q:Nation/q:name", "SELECT r_name AS value FROM region UNION SELECT n_name FROM nation", *C)
paths("path_descendant", "//q:name", "SELECT r_name AS value FROM region UNION ALL SELECT n_name FROM nation", "nation", "region")
paths("join_closure", "/q:Nation[q:name='NATION_8']//q:name", "SELECT n_name AS value FROM nation WHERE n_name = 'NATION_8' UNION SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_8'", "nation", "region")
paths("win_last", "(/q:Nation)[last()]", f"SELECT max('{B}nation/' || n_nationkey) AS value FROM nation", "nation")
paths("fn_contains", "/q:Nation[contains(q:name, '_1')]/q:name", "SELECT n_name AS value FROM nation WHERE contains(n_name, '_1')", *C)
paths("fn_starts_with", "/q:Nation[starts-with(q:name, 'NATION_2')]/q:name", "SELECT n_name AS value FROM nation WHERE starts_with(n_name, 'NATION_2')", *C)
paths("fn_string_length", "/q:Nation[string-length(q:name) > 8]/q:name", "SELECT n_name AS value FROM nation WHERE length(n_name) > 8", *C)
paths("fn_count", "/*[count(q:nation) = 1]/q:name", "SELECT c_name AS value FROM customer", *C)
paths("fn_sum", "/*[sum(q:balance) > 900000]/q:name", "SELECT c_name AS value FROM customer WHERE round(c_acctbal * 100) > 900000", *C)
paths("arith_path", "/*[q:balance div 2 > 450000]/q:name", "SELECT c_name AS value FROM customer WHERE round(c_acctbal * 100) / 2 > 450000", *C)


@query("path_prop_test", f"SELECT '{B}customer/' || c_custkey AS s, c_name AS o FROM customer UNION ALL SELECT '{B}customer/' || c_custkey, c_mktsegment FROM customer")
def _(spark, d):
    said = model.statements(spark, [(NS + "name", model.SUBPROPERTY, NS + "label", "R", ""), (NS + "segment", model.SUBPROPERTY, NS + "label", "R", "")])
    return schema.property_statements(graph(spark, d, "customer").unionByName(said), NS + "label").select("s", "o")


@query("path_to_statements", f"SELECT s, p, o, otype FROM ({NATION_ST}) WHERE s IN (SELECT '{B}nation/' || n_nationkey FROM nation WHERE n_name = 'NATION_8')")
def _(spark, d):
    st = graph(spark, d, "nation")
    return scan.star(st, path(st, "/*[q:name='NATION_8']").select(F.col("id").alias("s"))).select(*TRIPLE)


@query("path_get_resource", f"SELECT '{B}nation/' || n_nationkey AS s FROM nation WHERE starts_with(n_name, 'NATION_2')")
def _(spark, d):
    return path(graph(spark, d, "nation"), "/*/q:name[starts-with(., 'NATION_2')]/..").select(F.col("id").alias("s"))


@query("path_kind_fns", "SELECT 'resource' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'predicate', 3 * count(*) FROM nation")
def _(spark, d):
    e = Engine(graph(spark, d, "nation"), PREFIXES)
    one = e.select("/q:Nation").agg(F.count("*").alias("n")).select(F.lit("resource").alias("kind"), "n")
    return one.unionByName(e.select("/q:Nation/*").agg(F.count("*").alias("n")).select(F.lit("predicate").alias("kind"), "n"))


# object language


def objects(name: str, text: str, sql: str, *tables: str, columns: list[str] | None = None):
    """A query that is one pattern; arrays come as joined text."""

    def run(spark, d):
        out = Objects(graph(spark, d, *tables), NS).run(text)
        return out.select(*[F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c) if dict(out.dtypes)[c].startswith("array") else F.col(c) for c in columns or out.columns])

    Q[name], SQL[name] = run, sql


objects("con_prop_name_filter", "{ name, segment where(segment = 'BUILDING') }", f"SELECT '{B}customer/' || c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'BUILDING'", *C)
objects("con_prop_quoted", '{ segment, "label" : name }', f"SELECT '{B}customer/' || c_custkey AS id, c_mktsegment AS segment, c_name AS label FROM customer", *C)
objects("pred_in", "{ name where(segment in ('BUILDING', 'MACHINERY')) }", f"SELECT '{B}customer/' || c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", *C)
objects("pred_not_in", "{ segment where(segment not in ('BUILDING', 'MACHINERY')) }", f"SELECT '{B}customer/' || c_custkey AS id, c_mktsegment AS segment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')", *C)
objects("pred_is_null", "{ name where(segment is null) }", f"SELECT '{B}nation/' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT '{B}region/' || r_regionkey, r_name FROM region", *C)
objects("filter_simple", "{ name where(name = 'NATION_8') }", f"SELECT '{B}nation/' || n_nationkey AS id, n_name AS name FROM nation WHERE n_name = 'NATION_8'", *C)
objects("filter_complex", "{ name where(not (balance < 500000) and (segment = 'BUILDING' or segment = 'FURNITURE')) }", f"SELECT '{B}customer/' || c_custkey AS id, c_name AS name FROM customer WHERE round(c_acctbal * 100) >= 500000 AND c_mktsegment IN ('BUILDING', 'FURNITURE')", *C)
objects("project_path", '{ segment, "where" : nation.region.name }', f"SELECT '{B}customer/' || c_custkey AS id, c_mktsegment AS segment, r_name AS \"where\" FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", *C)
objects("arith", '{ segment, "next" : balance + 1 }', f"SELECT '{B}customer/' || c_custkey AS id, c_mktsegment AS segment, CAST(CAST(round(c_acctbal * 100) + 1 AS BIGINT) AS VARCHAR) AS next FROM customer", *C)
objects("orderby", "{ name, region orderby(name) limit(4) offset(2) }", f"SELECT '{B}nation/' || n_nationkey AS id, n_name AS name, '{B}region/' || n_regionkey AS region FROM nation ORDER BY n_name LIMIT 4 OFFSET 2", "nation")
objects("con_optional", "{ name optional(segment) }", f"SELECT '{B}customer/' || c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT '{B}nation/' || n_nationkey, n_name, NULL FROM nation", "customer", "nation")
objects("join_label", "{ id : ?r, name, \"nations\" : { id : ?n, region where(region = ?r) } where(name = 'ASIA') }", f"SELECT '{B}region/' || r_regionkey AS id, r_name AS name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region WHERE r_name = 'ASIA'", "nation", "region")


def _nested_counts(spark, d):
    out = Objects(graph(spark, d, "nation", "region"), NS).run('{ id : ?r, name, "nations" : { id : ?n, region where(region = ?r) } where(name = \'ASIA\') }')
    return out.select("id", F.array_join("name", "|").alias("name"), F.size("nations").alias("n"))


Q["join_label"] = _nested_counts


def _whole(spark, d):
    out = Objects(graph(spark, d, *C), NS).run('{ segment, "next" : balance + 1 }')
    return out.select("id", F.element_at("segment", 1).alias("segment"), F.element_at("next", 1).cast("long").cast("string").alias("next"))


Q["arith"] = _whole


@query("con_nested", f"SELECT '{B}region/' || r_regionkey AS id, string_agg(n_name, '|' ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark, d):
    out = Objects(graph(spark, d, "nation", "region"), NS).run('{ id : ?r, nations : { id : ?n, "name" : name where(region = ?r) } }'.replace("nations :", '"nations" :'))
    return out.where("nations is not null").select("id", F.array_join(F.array_sort(F.flatten(F.transform("nations", lambda x: x["name"]))), "|").alias("nations"))


@query("con_star", f"SELECT '{B}nation/' || n_nationkey AS id, '{N}name=' || n_name || ';{N}region={B}region/' || n_regionkey || ';{TYPE}={N}Nation' AS properties FROM nation")
def _(spark, d):
    out = Objects(graph(spark, d, "nation"), NS).run("{ * }")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return out.select("id", text.alias("properties"))


@query("con_select", f"SELECT '{B}order/' || o_orderkey AS id, o_orderstatus AS status, c_name AS buyer FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND round(o_totalprice * 100) > 30000000")
def _(spark, d):
    out = Objects(graph(spark, d, "orders", "customer"), NS).run("{ status, \"buyer\" : customer.name where(customer.segment = 'BUILDING' and total > 30000000) }")
    return out.select("id", F.array_join("status", "|").alias("status"), F.array_join("buyer", "|").alias("buyer"))


@query("con_shape", f"""SELECT '{B}region/' || r_regionkey AS id, CASE count(n_nationkey) WHEN 0 THEN NULL WHEN 1 THEN '"' || min(n_name) || '"' ELSE '["' || string_agg(n_name, '","' ORDER BY n_name) || '"]' END AS doc FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey""")
def _(spark, d):
    st = graph(spark, d, "nation", "region")
    names = rel.object_subject(st, NS + "region", NS + "name")
    few = st.where(F.col("p") == NS + "region").select("s", F.col("o").alias("id")).join(st.where(F.col("p") == NS + "name").select("s", F.col("o").alias("v")), "s")
    lists = few.groupBy("id").agg(F.array_sort(F.collect_list("v")).alias("v"))
    assert names.columns == ["s", "via", "o", "otype"]
    return path(st, "/q:Region").select("id").join(lists, "id", "left").select("id", shaped(F.col("v")).alias("doc"))


for _name, _text in (("con_id", "{ id : ?x, name }"), ("con_dict", "{ name }")):
    objects(_name, _text, f"SELECT '{B}nation/' || n_nationkey AS id, n_name AS name FROM nation", "nation")
objects("con_list", '{ "names" : [name] where(region is not null) }'.replace("where(region is not null)", "where(not (region is null))"), f"SELECT '{B}nation/' || n_nationkey AS id, n_name AS names FROM nation", "nation")
objects("project_field", '{ "of" : region where(name = \'NATION_8\') }', f"SELECT '{B}nation/' || n_nationkey AS id, '{B}region/' || n_regionkey AS \"of\" FROM nation WHERE n_name = 'NATION_8'", "nation")


@query("udf_register", f"SELECT '{B}nation/' || n_nationkey AS id, reverse(n_name) AS back FROM nation")
def _(spark, d):
    o = Objects(graph(spark, d, "nation"), NS)
    o.register("backwards", F.reverse)
    return o.run('{ region, "back" : backwards(name) }').select("id", F.array_join("back", "|").alias("back"))


# joins


@query("join_inner", "SELECT n_regionkey AS k, count(*) AS n, 1 AS m FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("k"), "n_name")
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), "r_name")
    return rel.cogroup(n, r, "k").select("k", F.size("left").cast("long").alias("n"), F.size("right").alias("m"))


def _sides(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return c, o


Q["join_anti"] = lambda spark, d: rel.anti(*_sides(spark, d), "k")
SQL["join_anti"] = "SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"
Q["join_semi"] = lambda spark, d: rel.semi(*_sides(spark, d), "k")
SQL["join_semi"] = "SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"
Q["join_outer"] = lambda spark, d: rel.outer(*_sides(spark, d), "k")
SQL["join_outer"] = "SELECT c_custkey AS k, c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey"
Q["join_merge"] = lambda spark, d: _sides(spark, d)[0].join(_sides(spark, d)[1].hint("merge"), "k")
SQL["join_merge"] = "SELECT c_custkey AS k, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey"
Q["join_iteration"] = lambda spark, d: _sides(spark, d)[0].join(_sides(spark, d)[1], "k")
SQL["join_iteration"] = SQL["join_merge"]


@query("join_cross", "SELECT r_name, n_name FROM region, nation")
def _(spark, d):
    """Both sides are dimension tables of a fixed size."""
    return table(spark, d, "region").select("r_name").crossJoin(table(spark, d, "nation").select("n_name"))


@query("join_object_subject", f"SELECT '{B}customer/' || c_custkey AS s, '{B}nation/' || n_nationkey AS via, n_name AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    return rel.object_subject(graph(spark, d, "customer", "nation"), NS + "nation", NS + "name").select("s", "via", "o")


@query("join_condition", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def _(spark, d):
    st = graph(spark, d, "orders", "customer")
    at = lambda p: st.where(F.col("p") == p)
    done = at(NS + "status").where("o = 'F'").select(F.col("s").alias("order"))
    buyer = at(NS + "customer").select(F.col("s").alias("order"), F.col("o").alias("customer"))
    name = at(NS + "name").select(F.col("s").alias("customer"), F.col("o").alias("c_name"))
    joined = rel.by_label([(done, {"order": "order"}), (buyer, {"order": "order", "customer": "customer"}), (name, {"customer": "customer", "c_name": "c_name"})])
    return joined.select(key_of("order").alias("o_orderkey"), "c_name")


@query("join_dependent", "SELECT c_custkey AS k, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(spark, d):
    c, _ = _sides(spark, d)
    return rel.dependent(c, table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), "k", F.col("o_totalprice") > 300000)


# grouping


def _group(spark, d):
    n = table(spark, d, "nation").select("n_regionkey", "n_name")
    return rel.group_nested(n, "n_regionkey").select("n_regionkey", F.array_join(F.transform("rows", lambda r: r["n_name"]), "|").alias("names"))


Q["group_unordered"], SQL["group_unordered"] = _group, "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1"


@query("get_nested_column", "SELECT n_name FROM nation")
def _(spark, d):
    return rel.nested_column(rel.group_nested(table(spark, d, "nation").select("n_regionkey", "n_name"), "n_regionkey"), "rows", "n_name")


@query("group_columns", "SELECT * FROM (VALUES ('n_regionkey', 'int'), ('rows', 'array<struct<n_name:string>>')) t(name, kind)")
def _(spark, d):
    return spark.createDataFrame(rel.group_nested(table(spark, d, "nation").select("n_regionkey", "n_name"), "n_regionkey").dtypes, "name string, kind string")


@query("agg_count", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    return scan.pattern(graph(spark, d, "customer"), p=NS + "segment").groupBy(F.col("o").alias("segment")).agg(F.count("*").alias("n"))


@query("agg_sum", "SELECT c_mktsegment AS segment, CAST(sum(round(c_acctbal * 100)) AS BIGINT) AS total FROM customer GROUP BY 1")
def _(spark, d):
    st = graph(spark, d, "customer")
    seg, bal = (st.where(F.col("p") == NS + p).select("s", F.col("o").alias(p)) for p in ("segment", "balance"))
    return seg.join(bal, "s").groupBy("segment").agg(F.sum(F.col("balance").try_cast("long")).alias("total"))


@query("agg_min_max", "SELECT min(round(c_acctbal * 100)) AS low, max(round(c_acctbal * 100)) AS high FROM customer")
def _(spark, d):
    return rel.number_range(scan.pattern(graph(spark, d, "customer"), p=NS + "balance"), F.col("o"))


@query("agg_facet_count", "SELECT o_orderpriority AS topic, count(DISTINCT o_custkey) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND o_orderpriority <> '1-URGENT' GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders")
    topics = model.triplify(o, data.uri("customer", F.col("o_custkey")), {NS + "topic": (F.col("o_orderpriority"), "L")})
    return rel.facets(topics, NS + "topic", ["1-URGENT"])


@query("agg_distinct", f"SELECT DISTINCT '{B}nation/' || c_nationkey AS o FROM customer")
def _(spark, d):
    return scan.pattern(graph(spark, d, "customer"), p=NS + "nation").select("o").distinct()


# order


@query("win_position", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, count(*) OVER (PARTITION BY conv_id) AS size FROM conversations")
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    return rel.positions(c, ["conv_id"], ["turn"]).select("conv_id", "turn", F.col("position").cast("long").alias("position"), "size")


Q["win_size"], SQL["win_size"] = (lambda spark, d: rel.positions(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"]).where("is_last").select("conv_id", "size")), "SELECT conv_id, count(*) AS size FROM conversations GROUP BY 1"


@query("win_latest_revision", "SELECT conv_id, arg_max(role, turn) AS role FROM conversations GROUP BY 1")
def _(spark, d):
    return rel.latest(table(spark, d, "conversations"), ["conv_id"], "turn", "role")


@query("win_priority_rules", "SELECT conv_id, coalesce(max(turn) FILTER (WHERE role = 'assistant' AND length(text) > 200), max(turn) FILTER (WHERE role = 'assistant'), max(turn)) AS turn FROM conversations GROUP BY 1")
def _(spark, d):
    spoke = F.col("role") == "assistant"
    return rel.by_rules(table(spark, d, "conversations"), ["conv_id"], "turn", "turn", [spoke & (F.length("text") > 200), spoke, F.lit(True)])


@query("sort_doc", f"SELECT s, p, o, row_number() OVER (ORDER BY s, p, o) AS n FROM ({NATION_ST})")
def _(spark, d):
    from pyspark.sql import Window

    # a report over a dimension table of a fixed size
    return graph(spark, d, "nation").select("s", "p", "o", F.row_number().over(Window.orderBy("s", "p", "o", "otype")).cast("long").alias("n"))


@query("sort_key", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def _(spark, d):
    return table(spark, d, "customer").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(50).select("c_custkey", "c_name")


@query("limit_offset", "SELECT n_name FROM nation ORDER BY n_name LIMIT 5 OFFSET 3")
def _(spark, d):
    return table(spark, d, "nation").orderBy("n_name").offset(3).limit(5).select("n_name")


# sets

Q["set_union_all"], SQL["set_union_all"] = (lambda spark, d: rel.union_all(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))), "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"
Q["set_union_distinct"], SQL["set_union_distinct"] = (lambda spark, d: Q["set_union_all"](spark, d).distinct()), "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"
Q["set_intersect"], SQL["set_intersect"] = (lambda spark, d: table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))), "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"
Q["set_difference"], SQL["set_difference"] = (lambda spark, d: table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").select("o_custkey"))), "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders"
objects("set_union_ast", "{ name where(name = 'NATION_8' or region.name = 'EUROPE') }", f"SELECT '{B}nation/' || n_nationkey AS id, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_8' OR r_name = 'EUROPE'", "nation", "region")


@query("set_triple_diff", "SELECT c_nationkey AS k, 'delete' AS op FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1 UNION ALL SELECT s_nationkey, 'insert' FROM supplier WHERE s_acctbal > 5000 AND s_nationkey NOT IN (SELECT c_nationkey FROM customer) GROUP BY 1")
def _(spark, d):
    old = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return rel.diff(old, table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")), ["k"])


from . import catalog_more  # noqa: E402, F401  the rest of the queries
from . import catalog_each  # noqa: E402, F401, I001
