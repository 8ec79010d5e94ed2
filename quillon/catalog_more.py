"""More named queries: functions, full text, schema, changes, history, rules, and the rest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import data, model, schema
from .catalog import NATION_ST, PREFIXES, REGION_ST, SQL, B, N, Q, key_of, path, query
from .data import BASE, NS, graph, table
from .functions import text as tx
from .functions import xpath as xp
from .model import RDF, RDFS, SUBCLASS, TRIPLE, TYPE, XSD
from .operators import fulltext as ft
from .operators import relational as rel
from .operators import rules, scan
from .operators import update as up
from .plans.paths import Engine
from .sources import formats

# scalar functions over names, URIs and texts


def column(name: str, tab: str, key: str, build, sql: str):
    """A query that is one column over a table."""

    def run(spark, d):
        return table(spark, d, tab).select(key, build().alias("v"))

    Q[name], SQL[name] = run, f"SELECT {key}, {sql} AS v FROM {tab}"


c = F.col
column("fn_split_uri", "pages", "page_id", lambda: xp.split_uri(F.concat(F.lit(NS), F.lit("p"), c("page_id").cast("string")))["local"], "'p' || page_id")
column("fn_uri_parts", "pages", "page_id", lambda: xp.split_uri(F.concat(F.lit(NS), F.lit("p"), c("page_id").cast("string")))["namespace"], f"'{N}'")
column("fn_uri", "pages", "page_id", lambda: F.concat(F.element_at(F.create_map(F.lit("q"), F.lit(NS)), "q"), F.lit("p"), c("page_id").cast("string")), f"'{N}p' || page_id")
column("fn_split", "benchmark", "item_id", lambda: F.size(tx.split(c("text"))), r"len(regexp_split_to_array(trim(text, ' ' || chr(10)), '\s+'))")
column("fn_if", "nation", "n_nationkey", lambda: xp.FUNCTIONS["if"](c("n_regionkey") == 1, F.lit("a"), F.lit("b")), "CASE WHEN n_regionkey = 1 THEN 'a' ELSE 'b' END")
column("fn_sha1", "documents", "doc_id", lambda: tx.sha1_base64(c("text")), "to_base64(unhex(sha1(text)))")
column("fn_secure_hash", "documents", "doc_id", lambda: F.sha2("text", 256), "sha256(text)")
column("fn_html_quote", "documents", "doc_id", lambda: F.sha2(tx.quote(c("text")), 256), "sha256(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))")
column("fn_parse_date", "orders", "o_orderkey", lambda: tx.parse_date(F.date_format("o_orderdate", "yyyy-MM-dd"), "%Y-%m-%d"), "printf('%d.000', CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT))")
column("fn_format_time", "orders", "o_orderkey", lambda: tx.format_time(F.unix_timestamp(c("o_orderdate").cast("timestamp")), "%Y/%m"), "strftime(o_orderdate, '%Y/%m')")
column("fn_current_time", "region", "r_regionkey", lambda: tx.epoch(F.current_timestamp()) > "1", "true")
column("fn_truncate_text", "benchmark", "item_id", lambda: tx.truncate_text(c("text"), 3), r"regexp_extract(text, '^(\s*(?:\S+\s+){0,2}\S+)', 1)")
column("fn_truncate_contents", "documents", "doc_id", lambda: tx.truncate_text(c("text"), 5), r"regexp_extract(text, '^(\s*(?:\S+\s+){0,4}\S+)', 1)")
column("fn_substring_before", "events", "event_id", lambda: xp.before(c("props"), F.lit(":")), "CASE WHEN instr(props, ':') > 0 THEN substr(props, 1, instr(props, ':') - 1) ELSE '' END")
column("fn_substring_after", "events", "event_id", lambda: xp.after(c("props"), F.lit(":")), "CASE WHEN instr(props, ':') > 0 THEN substr(props, instr(props, ':') + 1) ELSE '' END")
column("fn_substring", "customer", "c_custkey", lambda: xp.substring(c("c_name"), F.lit(0.0), F.lit(3.0)), "substr(c_name, 1, 2)")
column("fn_normalize_space", "benchmark", "item_id", lambda: xp.FUNCTIONS["normalize-space"](c("text")), r"trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))")
column("fn_translate", "nation", "n_nationkey", lambda: xp.FUNCTIONS["translate"](c("n_name"), F.lit("NAT_"), F.lit("nat")), "translate(n_name, 'NAT_', 'nat')")
column("fn_floor", "customer", "c_custkey", lambda: F.floor("c_acctbal"), "CAST(floor(c_acctbal) AS BIGINT)")
column("fn_ceiling", "customer", "c_custkey", lambda: F.ceil("c_acctbal"), "CAST(ceil(c_acctbal) AS BIGINT)")
column("fn_round", "customer", "c_custkey", lambda: xp.rounded(c("c_acctbal")), "floor(c_acctbal + 0.5)")
column("fn_string", "customer", "c_custkey", lambda: xp.string(F.nullif("c_mktsegment", F.lit("BUILDING"))), "coalesce(nullif(c_mktsegment, 'BUILDING'), '')")
column("fn_concat", "customer", "c_custkey", lambda: xp.FUNCTIONS["concat"](c("c_name"), F.lit("/"), c("c_mktsegment")), "c_name || '/' || c_mktsegment")
column("fn_boolean", "customer", "c_custkey", lambda: xp.boolean(F.nullif("c_mktsegment", F.lit("BUILDING"))), "c_mktsegment <> 'BUILDING'")
column("fn_match", "customer", "c_custkey", lambda: xp.FUNCTIONS["match"](c("c_name"), F.lit("[0-4]$")), "regexp_matches(c_name, '[0-4]$')")
column("fn_replace", "customer", "c_custkey", lambda: F.replace("c_name", F.lit("0"), F.lit("o")), "replace(c_name, '0', 'o')")
column("fn_join", "events", "event_id", lambda: F.array_join(F.split("event_type", "i"), "-"), "array_to_string(string_split(event_type, 'i'), '-')")
column("fn_ends_with", "customer", "c_custkey", lambda: xp.FUNCTIONS["ends-with"](c("c_name"), F.lit("7")), "suffix(c_name, '7')")
column("fn_lang", "documents", "doc_id", lambda: F.startswith(c("lang"), F.lit("en")), "starts_with(lang, 'en')")
column("instance_of_value", "nation", "n_nationkey", lambda: F.typeof(c("n_name")), "'string'")
column("fn_generate_bnode", "nation", "n_nationkey", lambda: tx.blank_node(c("n_name")), "'bnode:x' || sha1(n_name)")
column("fn_html_blacklist", "pages", "page_id", lambda: tx.sanitised(c("html")).contains("<script"), "false")
column("fn_html_whitelist", "pages", "page_id", lambda: tx.whitelisted(c("html")).rlike("<(script|style|html|nav)"), "false")


@query("fn_diff", "SELECT doc_id, true AS same FROM documents WHERE doc_id % 20 < 10 OR doc_id IS NOT NULL")
def _(spark, d):
    """Each text is patched by its diff to an edited form, which gives that form."""
    docs = table(spark, d, "documents").select("doc_id", "text").withColumn("new", F.regexp_replace("text", r"\n", "\nx\n"))
    both = docs.withColumn("ops", tx.diff_json("text", "new"))
    return both.select("doc_id", (tx.patch_json("text", "ops") == F.col("new")).alias("same"))




@query("fn_html_diff", "SELECT n_nationkey, true AS made FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", tx.html_diff("n_name", F.lower("n_name")).contains("diff_").alias("made"))


@query("fn_get_statement_uris", f"SELECT 'urn:fact:' || n_nationkey AS statement FROM nation WHERE n_regionkey = 1")
def _(spark, d):
    return Q["scan_reified"](spark, d).select("statement")


@query("fn_rdfdocument", f"SELECT s, p, o, otype FROM ({NATION_ST}) UNION ALL SELECT s, p, o, otype FROM ({REGION_ST})")
def _(spark, d):
    lines = graph(spark, d, "region").select(formats.to_line(*[F.col(x) for x in TRIPLE]).alias("value"))
    return model.union(graph(spark, d, "nation"), formats.parse_lines(lines)).select(*TRIPLE)




@query("fn_is_instance_of", f"SELECT '{B}customer/' || c_custkey AS s FROM customer")
def _(spark, d):
    return schema.instances(graph(spark, d, "customer", "classes"), NS + "Customer")


@query("fn_is_subclass_of", f"SELECT DISTINCT '{N}Customer-' || c_mktsegment AS a FROM customer UNION SELECT '{N}Customer' UNION SELECT '{N}Supplier' UNION SELECT '{N}Party'")
def _(spark, d):
    return schema.subclasses(graph(spark, d, "classes")).where(F.col("b") == NS + "Party").select("a")


@query("fn_is_subproperty_of", f"SELECT '{N}name' AS a UNION SELECT '{N}label' UNION SELECT 'urn:top'")
def _(spark, d):
    said = model.statements(spark, [(NS + "name", model.SUBPROPERTY, NS + "label", "R", ""), (NS + "label", model.SUBPROPERTY, "urn:top", "R", "")])
    return schema.subproperties(said).where("b = 'urn:top'").select("a")


# full text over documents. The tokens of these tables are ASCII in English ones.


def _english(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source")


TOK = r"(SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS terms FROM documents )"
POST = f"(SELECT doc_id, term, count(*) AS freq FROM (SELECT doc_id, unnest(terms) AS term FROM {TOK}) GROUP BY 1, 2)"
NORM = f"(SELECT doc_id, CASE WHEN len(terms) > 0 THEN (CAST(ceil(255.0 / sqrt(len(terms))) AS INTEGER) & 255) / 255.0 ELSE 0 END AS norm FROM {TOK})"
COUNT = "(SELECT count(*) AS n FROM documents )"


def _index(spark, d):
    return ft.build(_english(spark, d), "doc_id", {"text": "text", "source": "keyword"})


@query("ft_tokenize", f"SELECT doc_id, len(terms) AS n FROM {TOK}")
def _(spark, d):
    return _english(spark, d).select("doc_id", F.size(ft.tokens(F.col("text"))).cast("long").alias("n"))


@query("ft_invert", f"SELECT doc_id AS doc, term, freq FROM {POST} WHERE term IN ('the', 'that', 'ing')")
def _(spark, d):
    return _index(spark, d).postings.where("field = 'text' and term in ('the', 'that', 'ing')").select("doc", "term", "freq")


@query("ft_norm", f"SELECT doc_id AS doc, norm FROM {NORM}")
def _(spark, d):
    return _index(spark, d).lengths.where("field = 'text'").select("doc", "norm")


@query("ft_idf", f"SELECT term, round(ln(n / (df + 1.0)) + 1, 9) AS idf FROM (SELECT term, count(*) AS df FROM {POST} GROUP BY 1), {COUNT} WHERE df > 20")
def _(spark, d):
    i = _index(spark, d)
    return i.document_frequency().where("field = 'text' and df > 20").select("term", F.round(F.log(F.lit(float(i.documents)) / (F.col("df") + 1.0)) + 1, 9).alias("idf"))


@query("ft_tf", f"SELECT doc_id AS doc, round(sqrt(freq), 9) AS tf FROM {POST} WHERE term = 'the'")
def _(spark, d):
    return _index(spark, d).postings.where("field = 'text' and term = 'the'").select("doc", F.round(F.sqrt("freq"), 9).alias("tf"))


TERM = f"SELECT doc_id AS doc, round(sqrt(freq) * (ln(n / (df + 1.0)) + 1) * norm, 9) AS score FROM {POST} p JOIN {NORM} USING (doc_id), (SELECT count(*) AS df FROM {POST} WHERE term = 'that'), {COUNT} WHERE term = 'that'"


@query("ft_term", TERM)
def _(spark, d):
    return ft.search(_index(spark, d), ft.parse("that", "text")).select("doc", F.round("score", 9).alias("score"))


@query("topk_search", f"SELECT * FROM ({TERM}) ORDER BY score DESC, doc LIMIT 10")
def _(spark, d):
    return ft.top(Q["ft_term"](spark, d), 10)


@query("hits_paging", f"SELECT doc, round(score / greatest(1, (SELECT max(score) FROM ({TERM}))), 9) AS score FROM ({TERM}) ORDER BY score DESC, doc LIMIT 10 OFFSET 10")
def _(spark, d):
    return ft.page(Q["ft_term"](spark, d), 10, 10).select("doc", F.round("score", 9).alias("score"))


BOOL = f"""
    WITH p AS {POST}, nrm AS {NORM}, c AS {COUNT},
    w AS (SELECT term, ln(n / (count(*) + 1.0)) + 1 AS idf FROM p, c WHERE term IN ('that', 'with') GROUP BY term, n),
    q AS (SELECT 1 / sqrt(sum(idf * idf)) AS scale FROM w)
    SELECT doc_id AS doc, round(sum(sqrt(freq) * idf * idf * scale * norm) * count(*) / 3, 9) AS score
    FROM p JOIN w USING (term) JOIN nrm USING (doc_id), q GROUP BY 1 HAVING count(*) >= {{0}}"""


@query("ft_bool", BOOL.replace("{0}", "2"))
def _(spark, d):
    return ft.search(_index(spark, d), ft.parse("that with", "text")).select("doc", F.round("score", 9).alias("score"))




@query("ft_bool_should", BOOL.replace("{0}", "1"))
def _(spark, d):
    q = ft.Bool(((ft.Term("text", "that"), "should"), (ft.Term("text", "with"), "should")))
    return ft.search(_index(spark, d), q).select("doc", F.round("score", 9).alias("score"))


@query("ft_phrase", f"SELECT doc_id AS doc, count(*) AS freq FROM (SELECT doc_id, terms, unnest(range(1, len(terms))) AS i FROM {TOK}) WHERE terms[i] = 'of' AND terms[i + 1] = 'the' GROUP BY 1")
def _(spark, d):
    i = _index(spark, d)
    hits = ft.search(i, ft.parse('"of the"', "text")).select("doc")
    a, b = (i.postings.where(f"field = 'text' and term = '{t}'").select("doc", F.explode("positions").alias("p")) for t in ("of", "the"))
    return a.join(b.withColumn("p", F.col("p") - 1), ["doc", "p"]).join(hits, "doc", "left_semi").groupBy("doc").agg(F.count("*").alias("freq"))


@query("ft_find_any", f"SELECT doc_id AS doc FROM {POST} WHERE term = 'that' UNION SELECT doc_id FROM documents WHERE source = 'src3'")
def _(spark, d):
    return ft.any_field(_index(spark, d), {"text": "that", "source": "src3"}).select("doc")


@query("ft_delete", f"SELECT doc_id AS doc FROM {POST} WHERE term = 'that' AND doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3')")
def _(spark, d):
    i = _index(spark, d)
    return ft.search(i.delete(i.stored.where("source = 'src3'")), ft.parse("that", "text")).select("doc")


@query("ft_filter_bits", f"SELECT doc_id AS doc FROM {POST} WHERE term = 'that' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("doc"))
    return ft.search(_index(spark, d), ft.parse("that", "text")).join(good, "doc", "left_semi").select("doc")


@query("ft_linear", "SELECT doc_id FROM documents WHERE contains(text, 'that the') ")
def _(spark, d):
    return ft.linear(table(spark, d, "documents"), "text", "that the").select("doc_id")


Q["src_text_index_doc"], SQL["src_text_index_doc"] = (lambda spark, d: _index(spark, d).stored), "SELECT doc_id AS doc, source FROM documents"


# schema


@query("infer_closure", f"SELECT '{N}Customer-' || c_mktsegment AS a, '{N}Customer' AS b FROM customer UNION SELECT '{N}Customer-' || c_mktsegment, '{N}Party' FROM customer UNION SELECT '{N}Customer', '{N}Party' UNION SELECT '{N}Supplier', '{N}Party'")
def _(spark, d):
    return schema.closure(schema.edges(graph(spark, d, "classes"), SUBCLASS), reflexive=False)


def _with_ranges(spark, d):
    said = model.statements(spark, [(NS + "region", model.DOMAIN, NS + "Place", "R", ""), (NS + "region", model.RANGE, NS + "Area", "R", "")])
    return graph(spark, d, "nation").unionByName(said)


@query("infer_rdfs", f"SELECT '{B}nation/' || n_nationkey AS s, '{N}Place' AS type FROM nation UNION SELECT '{B}region/' || n_regionkey, '{N}Area' FROM nation")
def _(spark, d):
    return schema.inferred_types(_with_ranges(spark, d)).where(F.col("type").startswith(NS)).select("s", "type")


@query("infer_instance_of", f"SELECT '{B}region/' || n_regionkey AS s FROM nation GROUP BY 1")
def _(spark, d):
    return schema.instances(schema.materialised(_with_ranges(spark, d)), NS + "Area")


@query("infer_retract", f"SELECT '{B}region/' || n_regionkey AS s, count(*) AS n FROM nation WHERE n_nationkey >= 5 GROUP BY 1")
def _(spark, d):
    st = _with_ranges(spark, d)
    area = schema.inferred_types(st).where(F.col("type") == NS + "Area")
    gone = st.where((F.col("p") == NS + "region") & (key_of("s") < 5)).groupBy(F.col("o").alias("s")).agg(F.count("*").alias("n")).withColumn("type", F.lit(NS + "Area"))
    return schema.retracted(area, gone).select("s", "n")


@query("reach_inverse", f"SELECT '{N}Party' AS a UNION SELECT '{N}Customer' UNION SELECT '{N}Supplier' UNION SELECT '{N}Customer-' || c_mktsegment FROM customer")
def _(spark, d):
    start = spark.createDataFrame([(NS + "Party",)], "a string")
    return schema.reachable(schema.edges(graph(spark, d, "classes"), SUBCLASS), start, inverse=True)


# lists: conversations as linked cells


def _cells(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    w = Window.partitionBy("conv_id").orderBy("turn")
    cell = lambda t: F.concat(F.lit("bnode:c"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    rows = turns.withColumn("next", F.lead("turn").over(w)).withColumn("rank", F.row_number().over(w))
    st = model.triplify(rows, cell(F.col("turn")), {model.FIRST: (F.concat_ws(":", "turn", "role"), "L"), model.REST: (F.coalesce(cell(F.col("next")), F.lit(model.NIL)), "R")})
    return st, rows.where("rank = 1").select(cell(F.col("turn")).alias("s"))


@query("list_order", "SELECT conv_id, turn || ':' || role AS item, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations")
def _(spark, d):
    st, heads = _cells(spark, d)
    got = up.list_order(st, heads)
    return got.select(F.regexp_extract("head", r"c(\d+)-", 1).cast("long").alias("conv_id"), "item", F.col("pos").cast("long").alias("pos"))


# changes


@query("upd_add", f"SELECT s, p, o, otype FROM ({NATION_ST}) UNION ALL SELECT '{B}nation/' || n_nationkey, '{N}note', 'new', 'L' FROM nation WHERE n_regionkey = 1")
def _(spark, d):
    st = graph(spark, d, "nation")
    picked = path(st, f"/*[q:region/@rdf:about='{BASE}region/1']").select(F.col("id").alias("s"))
    return up.append_to(st, picked, [(NS + "note", "new", "L")]).select(*TRIPLE)


@query("upd_remove", f"SELECT s, p, o, otype FROM ({NATION_ST}) WHERE p <> '{N}name'")
def _(spark, d):
    st = graph(spark, d, "nation")
    return up.remove(st, Engine(st, PREFIXES).select("/q:Nation/q:name").withColumn("ctx", F.lit(""))).select(*TRIPLE)




@query("upd_remove_resource", f"SELECT s, p, o, otype FROM ({NATION_ST}) WHERE s <> '{B}nation/8'")
def _(spark, d):
    st = graph(spark, d, "nation")
    return up.remove_resources(st, path(st, "/*[q:name='NATION_8']").select(F.col("id").alias("s"))).select(*TRIPLE)




@query("xu_update", f"SELECT s, p, CASE WHEN p = '{N}name' THEN lower(o) ELSE o END AS o, otype FROM ({NATION_ST})")
def _(spark, d):
    st = graph(spark, d, "nation")
    return up.replace_values(st, Engine(st, PREFIXES).select("/q:Nation/q:name"), F.lower("o")).select(*TRIPLE)


Q["xu_replace"], SQL["xu_replace"] = Q["xu_update"], SQL["xu_update"]


@query("xu_rename", f"SELECT s, CASE WHEN p = '{N}name' THEN '{N}title' ELSE p END AS p, o, otype FROM ({NATION_ST})")
def _(spark, d):
    st = graph(spark, d, "nation")
    return up.rename_property(st, Engine(st, PREFIXES).select("/q:Nation/q:name"), NS + "title").select(*TRIPLE)


@query("xu_for_each", f"SELECT '{B}nation/' || n_nationkey AS s, 'in ' || r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    st = graph(spark, d, "nation", "region")
    named = rel.object_subject(st, NS + "region", NS + "name")
    out = up.for_each(st, named, lambda x: x.select("s", F.lit(NS + "where").alias("p"), F.concat(F.lit("in "), "o").alias("o"), F.lit("L").alias("otype"), F.lit("").alias("ctx")))
    return scan.pattern(out, p=NS + "where").select("s", "o")


Q["xu_value_of"], SQL["xu_value_of"] = Q["xu_for_each"], SQL["xu_for_each"]
Q["xu_variable"], SQL["xu_variable"] = Q["path_variable"], SQL["path_variable"]


@query("xu_if", f"SELECT s, p, o, otype FROM ({REGION_ST}) WHERE p <> '{N}name'")
def _(spark, d):
    st = graph(spark, d, "region")
    names = scan.pattern(st, p=NS + "name")
    return up.when(st, names.where("o = 'ASIA'"), lambda x: up.remove(x, names)).select(*TRIPLE)


@query("xu_to_graph", f"SELECT '{B}region/' || r_regionkey AS s, 'context:1' AS ctx FROM region")
def _(spark, d):
    st = graph(spark, d, "region")
    out = up.append_to(st, st.select("s"), [(NS + "note", "x", "L")], ctx="context:1")
    return scan.graph(out, "context:1").select("s", "ctx")


@query("diff_resource", f"SELECT '{B}nation/' || n_nationkey AS s, n_name AS o, 'delete' AS op FROM nation UNION ALL SELECT '{B}nation/' || n_nationkey, lower(n_name), 'insert' FROM nation")
def _(spark, d):
    st = graph(spark, d, "nation")
    mine = st.where(F.col("p") == NS + "name")
    return up.resource_diff(st, up.replace_values(st, mine, F.lower("o"))).select("s", "o", "op")


def _merged(spark, d):
    st = graph(spark, d, "nation")
    new = st.where(F.col("p") != TYPE).withColumn("o", F.when(F.col("p") == NS + "name", F.lower("o")).otherwise(F.col("o")))
    return up.merge(st, new, path(st, f"/*[q:region/@rdf:about='{BASE}region/2']").select(F.col("id").alias("s")))


@query("merge_graph", f"SELECT '{B}nation/' || n_nationkey AS s, lower(n_name) AS o, 'add' AS op FROM nation WHERE n_regionkey = 2 UNION ALL SELECT '{B}nation/' || n_nationkey, n_name, 'remove' FROM nation WHERE n_regionkey = 2 UNION ALL SELECT '{B}nation/' || n_nationkey, '{N}Nation', 'remove' FROM nation WHERE n_regionkey = 2")
def _(spark, d):
    adds, removes = _merged(spark, d)
    return adds.select("s", "o", F.lit("add").alias("op")).unionByName(removes.select("s", "o", F.lit("remove").alias("op")))


@query("add_graph", "SELECT 'bnode:a' AS s, 'x' AS o UNION ALL SELECT 'bnode:ax', 'y' UNION ALL SELECT 'urn:r', 'z'")
def _(spark, d):
    st = model.statements(spark, [("bnode:a", "urn:p", "x"), ("urn:r", "urn:p", "z")])
    return up.add_graph(st, model.statements(spark, [("bnode:a", "urn:p", "y"), ("urn:r", "urn:p", "z")])).select("s", "o")


# contexts and history, over events as a log

LOG = f"(SELECT event_id AS seq, event_id // 100 AS version, CASE WHEN event_type = 'purchase' THEN 'remove' ELSE 'add' END AS op, '{B}user/' || user_id AS s, CASE WHEN event_type = 'purchase' THEN 'click' ELSE event_type END AS o FROM events)"
SPANS = f"""(
    WITH one AS (SELECT * FROM {LOG} QUALIFY row_number() OVER (PARTITION BY s, o, version ORDER BY seq DESC) = 1),
    turns AS (SELECT *, coalesce(lag(op) OVER (PARTITION BY s, o ORDER BY seq), 'remove') AS before FROM one),
    ends AS (SELECT s, o, op, version AS added, lead(version) OVER (PARTITION BY s, o ORDER BY seq) AS deleted FROM turns WHERE op <> before)
    SELECT s, o, added, deleted FROM ends WHERE op = 'add')"""


@query("hist_replay", f"SELECT s, o FROM (SELECT s, o, arg_max(op, seq) AS op FROM {LOG} GROUP BY 1, 2) WHERE op = 'add'")
def _(spark, d):
    return up.replay(data.events(spark, d)).select("s", "o")


Q["hist_spans"], SQL["hist_spans"] = (lambda spark, d: up.spans(data.events(spark, d)).select("s", "o", "added", "deleted")), f"SELECT s, o, added, deleted FROM {SPANS}"
Q["hist_show"], SQL["hist_show"] = (lambda spark, d: up.at_version(up.spans(data.events(spark, d)), 5).select("s", "o")), f"SELECT s, o FROM {SPANS} WHERE added <= 5 AND (deleted IS NULL OR deleted > 5)"
Q["hist_revisions"], SQL["hist_revisions"] = (lambda spark, d: up.revisions(data.events(spark, d)).select("s", F.col("revision").cast("long").alias("revision"), "version")), f"SELECT s, row_number() OVER (PARTITION BY s ORDER BY version) AS revision, version FROM (SELECT DISTINCT s, version FROM {LOG})"
Q["hist_modified_after"], SQL["hist_modified_after"] = (lambda spark, d: up.modified_after(data.events(spark, d), 6, ignoring=9)), f"SELECT s, max(version) AS version FROM {LOG} WHERE version <> 9 GROUP BY 1 HAVING max(version) > 6"


@query("hist_ctx_show", f"WITH r AS (SELECT s, version FROM (SELECT s, version, row_number() OVER (PARTITION BY s ORDER BY version) AS n FROM (SELECT DISTINCT s, version FROM {LOG})) WHERE n = 2) SELECT x.s, o FROM {SPANS} x JOIN r ON x.s = r.s WHERE added <= version AND (deleted IS NULL OR deleted > version)")
def _(spark, d):
    return up.at_revision(data.events(spark, d), 2).select("s", "o")


Q["ctx_remove"], SQL["ctx_remove"] = (lambda spark, d: up.cancelled(data.events(spark, d)).select("seq", "op")), f"SELECT seq, op FROM {LOG} QUALIFY row_number() OVER (PARTITION BY s, o, version ORDER BY seq DESC) = 1"


@query("ctx_txn", "SELECT event_id AS seq, 'context:txn:m;' || (event_id // 100) AS ctx FROM events")
def _(spark, d):
    return data.events(spark, d).select("seq", up.transaction_context("m", F.col("version")).alias("ctx"))


@query("ctx_parse", "SELECT event_id AS seq, 'm' AS model, CAST(event_id // 100 AS VARCHAR) AS version, 'src' || user_id AS source FROM events")
def _(spark, d):
    ctx = F.concat(up.transaction_context("m", F.col("version")), F.lit(";;source:src"), key_of("s").cast("string"))
    return data.events(spark, d).select("seq", up.context_parts(ctx).alias("x")).select("seq", "x.model", "x.version", "x.source")


@query("ctx_scoped", f"SELECT s, o, count(*) AS graphs FROM (SELECT DISTINCT s, o, seq % 3 AS g FROM {LOG}) GROUP BY 1, 2")
def _(spark, d):
    st = data.events(spark, d).withColumn("ctx", F.concat(F.lit("context:"), (F.col("seq") % 3).cast("string")))
    return up.live_in_graphs(st).select("s", "o", "graphs")



# rules


@query("constraint_schematron", "SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    st = graph(spark, d, "supplier")
    bad = rules.violations(st, NS + "nation", unique=True).where("rule = 'unique'").select("s")
    return st.join(bad, "s", "left_semi").where(F.col("p") == NS + "nation").groupBy(key_of("o").cast("int").alias("nation")).agg(F.count("*").alias("n"))


@query("auth_row_filter", f"SELECT s, p, o, otype FROM ({NATION_ST}) WHERE p <> '{N}region'")
def _(spark, d):
    required = spark.createDataFrame([(NS + "region", "admin", 1), (NS + "name", "reader", 1), (TYPE, "guest", 0)], "p string, token string, priority int")
    held = spark.createDataFrame([("reader",)], "token string")
    return rules.allowed(graph(spark, d, "nation"), required, held, priority=1).select(*TRIPLE)




@query("action_pipeline", f"SELECT '{B}region/' || r_regionkey AS value FROM region WHERE r_name = 'EUROPE'")
def _(spark, d):
    st = graph(spark, d, "region")
    first = [lambda x: path(st, "/*[q:name='ATLANTIS']"), lambda x: path(st, "/*[q:name='EUROPE']")]
    return rules.Pipeline({"http": [rules.Action(first, lambda found, x: found.select("value"))]}).trigger("http")


@query("upd_trigger_script", f"SELECT '{B}region/' || r_regionkey AS s, 'stamp' AS o FROM region")
def _(spark, d):
    st = graph(spark, d, "region")
    hooks = rules.Triggers()
    hooks.before.append(lambda a, r: (a.select("s").distinct().select("s", F.lit(NS + "by").alias("p"), F.lit("stamp").alias("o"), F.lit("L").alias("otype"), F.lit("").alias("ctx")), a.limit(0)))
    return scan.pattern(hooks.commit(st.limit(0), st, st.limit(0), lambda x: None), p=NS + "by").select("s", "o")




@query("cache_query", "SELECT n_name FROM nation")
def _(spark, d):
    cache = rules.QueryCache(4)
    run = lambda: table(spark, d, "nation").select("n_name")
    assert cache.get("names", 1, run) is cache.get("names", 1, run)
    return cache.get("names", 1, run)


@query("fn_shred", f"SELECT '{B}page/' || page_id AS s, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS o FROM pages WHERE regexp_matches(html, '<title>[^<]')")
def _(spark, d):
    """Titles of pages as statements in a graph of their own for each page."""
    pages = table(spark, d, "pages").withColumn("title", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))).where("html rlike '<title>[^<]'")
    st = model.triplify(pages, data.uri("page", F.col("page_id")), {NS + "title": (F.col("title"), "L")})
    return st.withColumn("ctx", F.concat(F.lit("context:extracted:"), "s")).select("s", "o")




@query("node_order_cmp", f"SELECT s, rank FROM (SELECT s, row_number() OVER (PARTITION BY p ORDER BY s) AS rank FROM ({NATION_ST}) WHERE p = '{N}name')")
def _(spark, d):
    names = scan.pattern(graph(spark, d, "nation"), p=NS + "name")
    return names.select("s", F.row_number().over(Window.partitionBy("p").orderBy("s", "o", "otype")).cast("long").alias("rank"))


@query("sink_bulk_export", f"SELECT s, p, o, otype FROM ({REGION_ST}) WHERE s = '{B}region/2'")
def _(spark, d):
    st = graph(spark, d, "region")
    return scan.star(st, path(st, "/*[q:name='ASIA']").select(F.col("id").alias("s"))).select(*TRIPLE)


@query("src_bulk_import", "SELECT n_name FROM nation")
def _(spark, d):
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{d}/nation.parquet").select("n_name")


Q["src_connectors"], SQL["src_connectors"] = (lambda spark, d: formats.StatementSource(spark, "parquet").spark.read.parquet(f"{d}/region.parquet").select("r_name")), "SELECT r_name FROM region"


@query("stream_windowed_counts", "SELECT event_type AS op, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    from .streaming.replay import windowed_counts

    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("op"))
    return windowed_counts(e, "at").groupBy("op").agg(F.sum("n").alias("n"))

# update scripts


def script(name: str, body: str, sql: str, *tables: str):
    """A query that is one script; its result is the graph afterwards."""

    def run(spark, d):
        from .operators.script import Script

        text = f'<modifications xmlns:q="{NS}" xmlns:rdf="{RDF}">{body}</modifications>'
        return Script(graph(spark, d, *tables), PREFIXES).run(text).select(*TRIPLE)

    Q[name], SQL[name] = run, sql


NAMES = f"SELECT '{B}region/' || r_regionkey AS s"
script("xu_attribute", '<append select="/q:Region"><element name="q:label"><attribute name="xml:lang">en</attribute><text>area</text></element></append>', f"{REGION_ST} UNION ALL {NAMES}, '{N}label', 'area', 'en' FROM region", "region")
script("xu_text", '<append select="/q:Region"><q:label><text>area</text></q:label></append>', f"{REGION_ST} UNION ALL {NAMES}, '{N}label', 'area', 'L' FROM region", "region")
script("xu_copy_of", "<append select=\"/q:Region[q:name='ASIA']\"><copy-of select=\"/q:Region[q:name='EUROPE']/q:name\"/></append>", f"{REGION_ST} UNION ALL {NAMES}, '{N}name', 'EUROPE', 'L' FROM region WHERE r_name = 'ASIA'", "region")
script("xu_value_of", '<for-each select="/q:Nation"><append select="$current"><q:where><value-of select="q:region/*/q:name"/></q:where></append></for-each>', f"{NATION_ST} UNION ALL {REGION_ST} UNION ALL SELECT '{B}nation/' || n_nationkey, '{N}where', r_name, 'L' FROM nation JOIN region ON n_regionkey = r_regionkey", "nation", "region")
script("xu_template", '<template name="t"><remove select="/q:Region/q:name"/></template><call-template name="t"/>', f"SELECT * FROM ({REGION_ST}) WHERE p <> '{N}name'", "region")
script("xu_message", "<message>five regions</message>", REGION_ST, "region")
script("xu_if", "<if test=\"/q:Region[q:name='ASIA']\"><remove select=\"/q:Region[q:name='ASIA']\"/></if><if test=\"/q:Region[q:name='ATLANTIS']\"><remove select=\"/q:Region\"/></if>", f"SELECT * FROM ({REGION_ST}) WHERE s <> '{B}region/2'", "region")
script("xu_update", "<update select=\"/q:Region[q:name='ASIA']/q:name\">Asia</update>", f"SELECT s, p, CASE WHEN o = 'ASIA' THEN 'Asia' ELSE o END AS o, otype FROM ({REGION_ST})", "region")
script("xu_replace", "<replace select=\"/q:Region[q:name='ASIA']/q:name\"><q:title>Asia</q:title></replace>", f"SELECT s, CASE WHEN o = 'ASIA' THEN '{N}title' ELSE p END AS p, CASE WHEN o = 'ASIA' THEN 'Asia' ELSE o END AS o, otype FROM ({REGION_ST})", "region")
script("xu_variable", '<variable name="n" select="/q:Region[q:name=\'ASIA\']/q:name"/><remove select="/q:Region[q:name=$n]"/>', f"SELECT * FROM ({REGION_ST}) WHERE s <> '{B}region/2'", "region")


@query("xu_include", f"SELECT * FROM ({REGION_ST}) WHERE p <> '{N}name'")
def _(spark, d):
    from .operators.script import Script

    made = Script(graph(spark, d, "region"), PREFIXES, load=lambda href: '<modifications><remove select="/q:Region/q:name"/></modifications>')
    return made.run('<modifications><include href="other"/></modifications>').select(*TRIPLE)


# what was left

Q["agg_min"], SQL["agg_min"] = (lambda spark, d: Q["agg_min_max"](spark, d).select("low")), "SELECT min(round(c_acctbal * 100)) AS low FROM customer"
Q["agg_max"], SQL["agg_max"] = (lambda spark, d: Q["agg_min_max"](spark, d).select("high")), "SELECT max(round(c_acctbal * 100)) AS high FROM customer"


def _saved(spark, d):
    """Written whole to the shared or a temporary folder, and read again."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="quillon-")
    return f"{base}/statements-{spark.sparkContext.applicationId}-{id(d)}"


@query("sink_full_save", f"SELECT s, p, o, otype FROM ({NATION_ST})")
def _(spark, d):
    store, where = formats.StatementSource(spark), _saved(spark, d)
    store.save(graph(spark, d, "nation"), where)
    return store.load(where).select(*TRIPLE)


@query("model_mirror", f"SELECT s, p, o, otype FROM ({REGION_ST})")
def _(spark, d):
    import uuid

    first, second = (f"{_saved(spark, d)}-{uuid.uuid4().hex}" for _ in range(2))
    model.mirror(graph(spark, d, "region"), first, second)
    return spark.read.parquet(first).select(*TRIPLE)


@query("sink_index_optimize", f"SELECT doc_id AS doc, term, freq FROM {POST} WHERE term = 'that'")
def _(spark, d):
    """A segment of the index for each part of the documents: their texts are shuffled, not their postings."""
    where = _saved(spark, d) + "-index"
    index = ft.build(_english(spark, d).repartition("doc_id"), "doc_id", {"text": "text", "source": "keyword"})
    index.postings.where("field = 'text'").write.mode("overwrite").parquet(where)
    ft.compact(where, spark, 1)
    return spark.read.parquet(where + ".compact").where("term = 'that'").select("doc", "term", "freq")


@query("src_url_doc", "SELECT 'region.parquet' AS name, true AS found")
def _(spark, d):
    return spark.read.format("binaryFile").load(f"{d}/region.parquet").select(F.substring_index("path", "/", -1).alias("name"), (F.col("length") > 0).alias("found")).where("name = 'region.parquet'")


@query("fn_evaluate", f"SELECT '{B}nation/' || n_nationkey AS value FROM nation WHERE n_name = 'NATION_8'")
def _(spark, d):
    """A path that is itself data: read, compiled on the driver, and run."""
    text = spark.createDataFrame([("/*[q:name='NATION_8']",)], "path string").first().path
    return path(graph(spark, d, "nation"), text).select("value")


@query("fn_metadata", "SELECT n_name AS value FROM nation WHERE n_name = 'NATION_3'")
def _(spark, d):
    """Request variables: assigned, asked for, removed."""
    held = {"wanted": "NATION_3", "other": "x"}
    held.pop("other")
    assert "other" not in held
    return path(graph(spark, d, "nation"), "/q:Nation/q:name[.=$wanted]", held).select("value")


@query("fn_error", "SELECT r_regionkey, 'ok' AS v FROM region")
def _(spark, d):
    return table(spark, d, "region").select("r_regionkey", F.when(F.col("r_regionkey") < 0, F.raise_error(F.lit("no such region"))).otherwise(F.lit("ok")).cast("string").alias("v"))


@query("fn_get_contents", "SELECT page_id, sha256(html) AS v FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("v"))
