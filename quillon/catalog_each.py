"""Queries of their own for operators that resemble others, each with inputs that would tell them apart, and value checks of functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import data, model
from .catalog import NATION_ST, PREFIXES, REGION_ST, B, N, path, query
from .catalog_more import POST, _index, column, script
from .data import NS, graph, table
from .functions import text as tx
from .functions import xpath as xp
from .model import TRIPLE, TYPE, XSD
from .operators import fulltext as ft
from .operators import relational as rel
from .operators import rules, scan
from .operators import update as up
from .plans.objects import Objects
from .plans.paths import Engine
from .sources import formats

# joins, groups and projections


@query("join_left_inner", "SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS k FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def _(spark, d):
    """Distinct left rows that have a match, however often both sides repeat the key."""
    left = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("k"))
    return rel.semi(left, table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), "k").distinct()


@query("set_except", f"SELECT s, p, o, otype FROM ({NATION_ST}) WHERE s NOT IN (SELECT '{B}nation/' || c_nationkey FROM customer)")
def _(spark, d):
    served = graph(spark, d, "customer").where(F.col("p") == NS + "nation").select(F.col("o").alias("s"))
    return rel.anti(graph(spark, d, "nation"), served, "s").select(*TRIPLE)


@query("filter_label", f"SELECT '{B}nation/' || n_nationkey AS subject, n_name AS object FROM nation WHERE n_name > 'NATION_2'")
def _(spark, d):
    """A filter's subject and object under labels that a later step refers to."""
    named = scan.pattern(graph(spark, d, "nation"), p=NS + "name").select(F.col("s").alias("subject"), F.col("o").alias("object"))
    return named.where(F.col("object") > "NATION_2")


@query("project_star", f"SELECT '{B}region/' || r_regionkey AS id, 2 AS n, r_name AS name FROM region")
def _(spark, d):
    out = Objects(graph(spark, d, "region"), NS).run("{ * }")
    return out.select("id", F.size("properties").alias("n"), F.element_at(F.element_at("properties", NS + "name"), 1).alias("name"))


@query("group_ordered", "SELECT c_nationkey AS k, count(*) AS n, min(c_name) AS first FROM customer GROUP BY 1")
def _(spark, d):
    """Groups of sorted input: the first row of each is the first in order."""
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_name")
    return rel.group_nested(rows, "k").select("k", F.size("rows").cast("long").alias("n"), F.element_at(F.array_sort(F.transform("rows", lambda r: r["c_name"])), 1).alias("first"))


# full text

TERMS = "(SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, term FROM {0} WHERE term IN ('of', 'and', 'with')) GROUP BY 1)".replace("{0}", POST)


@query("ft_parse", f"SELECT doc_id AS doc FROM {TERMS} WHERE n = 3")
def _(spark, d):
    """Three words are parsed to a query that asks for each of them."""
    return ft.search(_index(spark, d), ft.parse("of and with", "text")).select("doc")


@query("ft_query_norm", f"WITH p AS {POST}, c AS (SELECT count(*) AS n FROM documents), w AS (SELECT term, ln(n / (count(*) + 1.0)) + 1 AS idf FROM p, c WHERE term IN ('of', 'and', 'with') GROUP BY term, n) SELECT round(1 / sqrt(sum(idf * idf)), 9) AS scale FROM w")
def _(spark, d):
    """One over the length of the query's weights."""
    i = _index(spark, d)
    df = i.document_frequency().where("field = 'text' and term in ('of', 'and', 'with')")
    idf = F.log(F.lit(float(i.documents)) / (F.col("df") + 1.0)) + 1
    return df.agg(F.round(1 / F.sqrt(F.sum(idf * idf)), 9).alias("scale"))


@query("ft_find_field", "SELECT doc_id AS doc FROM documents WHERE source = 'src3'")
def _(spark, d):
    return ft.search(_index(spark, d), ft.Term("source", "src3")).select("doc")


@query("fn_search", f"SELECT doc_id FROM (SELECT DISTINCT doc_id FROM {POST} WHERE term = 'stor') UNION ALL SELECT doc_id + 1000000000 FROM documents WHERE contains(text, 'stor')")
def _(spark, d):
    """The same word by the index, and without one by looking through the texts."""
    docs = table(spark, d, "documents")
    by_index = ft.search(_index(spark, d), ft.parse("stor", "text")).select(F.col("doc").alias("doc_id"))
    return by_index.unionByName(ft.linear(docs, "text", "stor").select((F.col("doc_id") + 1_000_000_000).alias("doc_id")))


# changes

script("xu_append", "<append select=\"/q:Nation[q:region/*/q:name='ASIA']\"><q:note>far</q:note></append>", f"{NATION_ST} UNION ALL {REGION_ST} UNION ALL SELECT '{B}nation/' || n_nationkey, '{N}note', 'far', 'L' FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')", "nation", "region")
script("xu_element", "<append select=\"/q:Region[q:name='EUROPE']\"><element name=\"q:size\"><attribute name=\"rdf:datatype\">" + XSD + "integer</attribute><text>7</text></element></append>", f"{REGION_ST} UNION ALL SELECT '{B}region/' || r_regionkey, '{N}size', '7', '{XSD}integer' FROM region WHERE r_name = 'EUROPE'", "region")
script("xu_remove", "<remove select=\"/q:Region[q:name='ASIA']/q:name\"/><remove select=\"/q:Region[q:name='EUROPE']\"/>", f"SELECT * FROM ({REGION_ST}) WHERE s <> (SELECT '{B}region/' || r_regionkey FROM region WHERE r_name = 'EUROPE') AND o <> 'ASIA'", "region")


@query("upd_res_query", f"{NATION_ST} UNION ALL SELECT '{B}nation/' || n_nationkey, p, o, 'L' FROM nation, (VALUES ('{N}tag', 'one'), ('{N}tag', 'two')) t(p, o) WHERE n_regionkey = 3")
def _(spark, d):
    """Two properties for every resource that a path selects."""
    st = graph(spark, d, "nation")
    picked = path(st, f"/*[q:region/@rdf:about='{B}region/3']").select(F.col("id").alias("s"))
    return up.append_to(st, picked, [(NS + "tag", "one", "L"), (NS + "tag", "two", "L")]).select(*TRIPLE)


@query("xu_literal", f"{NATION_ST} UNION ALL SELECT '{B}nation/' || n_nationkey, '{N}text', 'in ' || n_name || '!', 'L' FROM nation")
def _(spark, d):
    """A template of literal text around a value of the resource."""
    st = graph(spark, d, "nation")
    named = scan.pattern(st, p=NS + "name").select("s", F.lit(NS + "text").alias("p"), F.concat(F.lit("in "), "o", F.lit("!")).alias("o"), F.lit("L").alias("otype"), F.lit("").alias("ctx"))
    return up.add(st, named).select(*TRIPLE)


@query("upd_add_batch", f"SELECT s, p, o, otype FROM ({NATION_ST}) UNION SELECT s, p, o, otype FROM ({REGION_ST}) UNION SELECT '{B}region/' || r_regionkey, '{N}name', r_name, 'en' FROM region")
def _(spark, d):
    """Statements that are there already are no second ones; the same text in a language is another."""
    st, more = graph(spark, d, "nation"), graph(spark, d, "region")
    tagged = scan.pattern(more, p=NS + "name").withColumn("otype", F.lit("en"))
    return up.add(up.add(st, more.unionByName(more)), tagged.unionByName(more)).select(*TRIPLE)


@query("upd_dom_edit", f"SELECT s, CASE WHEN p = '{N}name' THEN '{N}title' ELSE p END AS p, o, otype FROM ({REGION_ST}) WHERE s <> '{B}region/0' UNION ALL SELECT '{B}region/9', '{N}title', 'NOWHERE', 'L'")
def _(spark, d):
    """A node inserted, one removed and a property replaced, one after the other."""
    st = graph(spark, d, "region")
    st = up.remove_resources(st, path(st, f"id('{B}region/0')").select(F.col("id").alias("s")))
    st = up.rename_property(st, scan.pattern(st, p=NS + "name"), NS + "title")
    return up.add(st, model.statements(spark, [(B + "region/9", NS + "title", "NOWHERE", "L", "")])).select(*TRIPLE)


@query("ctx_add", "SELECT event_id // 100 AS version, count(*) AS n FROM events WHERE event_type <> 'purchase' GROUP BY 1")
def _(spark, d):
    """What each transaction's context has been given."""
    log = data.events(spark, d).where("op = 'add'").withColumn("ctx", up.transaction_context("m", F.col("version")))
    return log.select(up.context_parts(F.col("ctx"))["version"].cast("long").alias("version")).groupBy("version").agg(F.count("*").alias("n"))


@query("hist_get_context", f"SELECT s || ' ' || o AS line FROM ({REGION_ST}) WHERE p = '{N}name'")
def _(spark, d):
    """One graph's statements as a document, the others left out."""
    names = scan.pattern(graph(spark, d, "region"), p=NS + "name").withColumn("ctx", F.lit("context:names"))
    both = graph(spark, d, "nation").unionByName(names)
    lines = scan.graph(both, "context:names").select(formats.to_line(*[F.col(x) for x in TRIPLE]).alias("value"))
    return formats.parse_lines(lines).select(F.concat_ws(" ", "s", "o").alias("line"))


@query("trig_hooks", f"SELECT 'removed' AS hook, '{B}region/1' AS s UNION ALL SELECT 'added', '{B}region/' || r_regionkey FROM region WHERE r_regionkey <> 1")
def _(spark, d):
    """A hook before the change withdraws one resource; one after it sees what was added and removed."""
    st, seen = graph(spark, d, "region"), []
    hooks = rules.Triggers()
    hooks.before.append(lambda a, r: (a.limit(0), a.where(F.col("s") == B + "region/1")))
    hooks.after.append(lambda a, r: seen.append((a, r)))
    hooks.commit(st, st.limit(0), st.limit(0), lambda x: None)
    hooks.commit(st.limit(0), st, st.where(F.col("s") == B + "region/1"), lambda x: None)
    a, r = seen[-1]
    added = a.join(r.select("s").distinct(), "s", "left_anti").select(F.lit("added").alias("hook"), "s").distinct()
    return r.select(F.lit("removed").alias("hook"), "s").distinct().unionByName(added)


@query("fn_parse_rdf", f"SELECT s, p, o, otype FROM ({REGION_ST})")
def _(spark, d):
    """Text of statements in a column, a few lines a row."""
    lines = graph(spark, d, "region").groupBy("s").agg(F.concat_ws("\n", F.collect_list(formats.to_line(*[F.col(x) for x in TRIPLE]))).alias("doc"))
    return formats.parse_lines(lines.select(F.explode(F.split("doc", "\n")).alias("value"))).select(*TRIPLE)


@query("fn_serialize_rdf", f"SELECT '<{B}region/' || r_regionkey || '> <{N}name> \"' || r_name || '\" .' AS line FROM region")
def _(spark, d):
    return scan.pattern(graph(spark, d, "region"), p=NS + "name").select(F.trim(formats.to_line(*[F.col(x) for x in TRIPLE])).alias("line"))


@query("fn_patch", "SELECT n_nationkey, 'a' || chr(10) || lower(n_name) || chr(10) || 'z' AS text FROM nation")
def _(spark, d):
    """A given list of operations, not one from a diff, is applied."""
    rows = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("a\n"), "n_name", F.lit("\nz")).alias("old"), F.concat(F.lit("a\n"), F.lower("n_name"), F.lit("\nz")).alias("new"))
    return rows.withColumn("ops", tx.diff_json("old", "new")).select("n_nationkey", tx.patch_json("old", "ops").alias("text"))


@query("fn_generate_patch", "SELECT n_nationkey, n_nationkey % 2 = 0 AS changed FROM nation")
def _(spark, d):
    """No operations where nothing changed."""
    new = F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name"))
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", new.alias("new")).withColumn("ops", tx.diff_json("n_name", "new"))
    return rows.select("n_nationkey", (F.size(F.from_json("ops", "array<string>")) > 0).alias("changed"))


@query("udf_ext_map", f"SELECT '{B}nation/' || n_nationkey AS id, upper(substr(n_name, 1, 3)) || '-' || length(n_name) AS tag FROM nation")
def _(spark, d):
    """Two functions of an application's own in one query."""
    o = Objects(graph(spark, d, "nation"), NS)
    o.register("stem", lambda x: F.upper(F.substring(x, 1, 3)))
    o.register("size", lambda x: F.length(x).cast("string"))
    out = o.run('{ region, "a" : stem(name), "b" : size(name) }')
    return out.select("id", F.concat(F.array_join("a", "|"), F.lit("-"), F.array_join("b", "|")).alias("tag"))


CONTENT = {"text": lambda c: tx.quote(c), "base64": lambda c: F.unbase64(c).cast("string"), "upper": F.upper}


@query("udf_custom_content", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN replace(n_name, '&', '&amp;') WHEN 1 THEN n_name ELSE upper(n_name || 'x') END AS content FROM nation")
def _(spark, d):
    """Each row's content goes through the processor that its format names."""
    rows = table(spark, d, "nation").withColumn("format", F.when(F.col("n_regionkey") == 0, "text").when(F.col("n_regionkey") == 1, "base64").otherwise("upper"))
    raw = F.when(F.col("format") == "base64", F.base64("n_name")).when(F.col("format") == "upper", F.concat("n_name", F.lit("x"))).otherwise(F.col("n_name"))
    picked = F.coalesce(*[F.when(F.col("format") == k, f(F.col("raw"))) for k, f in CONTENT.items()])
    return rows.withColumn("raw", raw).select("n_nationkey", picked.alias("content"))


# values of functions

column("isref", "customer", "c_custkey", lambda: F.expr("CASE WHEN c_nationkey % 2 = 0 THEN 'R' ELSE 'L' END") == "R", "c_nationkey % 2 = 0")
column("fn_number", "customer", "c_custkey", lambda: xp.number(F.concat(F.lit(" "), F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.when(F.col("c_nationkey") == 3, "x").otherwise(""))), "CASE WHEN c_nationkey = 3 THEN NULL ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) END")
column("fn_flatten", "nation", "n_nationkey", lambda: F.array_join(F.flatten(F.array(F.array("n_name", F.lit("a")), F.array(F.lower("n_name")))), "|"), "n_name || '|a|' || lower(n_name)")
column("fn_base64", "customer", "c_custkey", lambda: F.base64("c_name"), "to_base64(encode(c_name))")
column("fn_escape_url", "customer", "c_custkey", lambda: F.url_encode(F.concat("c_name", F.lit("/&x=1"))), "replace(c_name, '#', '%23') || '%2F%26x%3D1'")
column("fn_true_false", "nation", "n_nationkey", lambda: F.when(F.col("n_regionkey") == 1, F.lit(True)).otherwise(F.lit(False)), "n_regionkey = 1")
column("fn_string_to_nodeset", "customer", "c_custkey", lambda: F.concat_ws("|", F.filter(F.array("c_name", F.nullif("c_mktsegment", F.lit("BUILDING"))), lambda x: x.isNotNull())), "c_name || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE '|' || c_mktsegment END")
column("fn_html_truncate", "pages", "page_id", lambda: tx.truncated(F.concat(F.lit("<b>"), F.lit("one two three four</b> "), F.col("page_id").cast("string")), 3), "'<b>one two three</b>'")
column("fn_fix_links", "nation", "n_nationkey", lambda: tx.fixed_links(F.concat(F.lit('<a href="site:'), "n_name", F.lit('">x</a>')), "site:", "/base/"), "'<a href=\"/base/' || n_name || '\">x</a>'")


@query("fn_map", "SELECT r_name AS value FROM region UNION SELECT lower(r_name) FROM region")
def _(spark, d):
    """An expression worked out for each node of a set, the results one set."""
    names = Engine(graph(spark, d, "region"), PREFIXES).select("/q:Region/q:name")
    return names.select(F.explode(F.array("value", F.lower("value"))).alias("value")).distinct()


@query("scan_exists", f"SELECT '{B}nation/' || n_nationkey AS s, n_nationkey IN (SELECT c_nationkey FROM customer) AS there FROM nation")
def _(spark, d):
    said = scan.pattern(graph(spark, d, "customer"), p=NS + "nation").select(F.col("o").alias("s")).distinct().withColumn("there", F.lit(True))
    return scan.pattern(graph(spark, d, "nation"), p=TYPE).select("s").join(said, "s", "left").select("s", F.coalesce("there", F.lit(False)).alias("there"))


@query("agg_first_nonempty", f"SELECT c_custkey AS k, coalesce(nullif(c_mktsegment, 'BUILDING'), c_name) AS v FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), "c_name").alias("v"))


script("xu_variable", "<variable name=\"n\" select=\"/q:Region[q:name!='ASIA']/q:name\"/><remove select=\"/q:Region[q:name=$n]\"/>", f"SELECT * FROM ({REGION_ST}) WHERE s IN (SELECT '{B}region/' || r_regionkey FROM region WHERE r_name = 'ASIA')", "region")
