"""Queries over sources, sinks and the text-table toolbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import text as fn
from tagloom.operators import tables
from tagloom.operators.corpus import merged, segment, token_counts
from tagloom.plans.fixtures import documents
from tagloom.plans.registry import query
from tagloom.sources import readers, writers
from tagloom.sources.workspace import fresh_path, load


def written_tsv(spark, df):
    writers.write_tsv(df, path := fresh_path(spark))
    return path


@query("scan_tsv", "SELECT CAST(c_custkey AS VARCHAR) AS c0, c_name AS c1, c_mktsegment AS c2, 3 AS arity FROM customer")
def scan_tsv(spark, sf_dir):
    path = written_tsv(spark, load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    return readers.read_tsv(spark, path).select(*(F.get("cols", i).alias(f"c{i}") for i in range(3)), F.size("cols").alias("arity"))


@query("scan_lines", "SELECT p_type AS line, count(*) AS n FROM part GROUP BY 1")
def scan_lines(spark, sf_dir):
    writers.write_lines(load(spark, sf_dir, "part"), "p_type", path := fresh_path(spark))
    return readers.read_lines(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query("scan_set", "SELECT DISTINCT p_brand AS line FROM part")
def scan_set(spark, sf_dir):
    writers.write_lines(load(spark, sf_dir, "part"), "p_brand", path := fresh_path(spark))
    return readers.read_set(spark, path)


@query("scan_dict", "SELECT p_type AS key, max(p_size) AS value FROM part GROUP BY 1")
def scan_dict(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select("p_type", "p_size").orderBy("p_size").coalesce(1)
    return readers.read_dict(spark, written_tsv(spark, rows), "int")


@query("scan_jsonl", "SELECT CAST(doc_id AS VARCHAR) || '@0' AS id, length(text) AS n FROM documents")
def scan_jsonl(spark, sf_dir):
    writers.write_json_lines(documents(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit("@0")).alias("id"), "text"), path := fresh_path(spark))
    return readers.read_json_lines(spark, path, "id string, text string").select("id", F.length("text").cast("long").alias("n"))


@query("scan_search_log", "SELECT CAST(user_id AS VARCHAR) AS uid, event_type AS query, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY ALL")
def scan_search_log(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("user_id").cast("string").alias("uid"), F.col("event_type").alias("query"), F.from_json("props", "k long").alias("props"))).alias("line"))
    broken = rows.limit(1).select(F.lit('{"uid": "1", "query": ').alias("line"))
    writers.write_lines(rows.unionByName(broken), "line", path := fresh_path(spark))
    return readers.read_search_log(spark, path, "uid string, query string, props struct<k:long>").groupBy("uid", "query").agg(F.count("*").alias("n"), F.sum("props.k").alias("k"))


@query(
    "clicks_grouped",
    "SELECT CAST(user_id AS VARCHAR) AS uid, event_type AS query, string_agg('e' || event_id, ',' ORDER BY 'e' || event_id) AS titles FROM events WHERE event_type <> 'error' GROUP BY ALL",
)
def clicks_grouped(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("q"), F.lit("product"), F.concat(F.lit("e"), "event_id").alias("title"), F.lit("u"))
    grouped = readers.click_groups(readers.read_tsv(spark, written_tsv(spark, e)))
    return grouped.select("uid", "query", F.array_join(F.transform("clicks", lambda c: c["title"]), ",").alias("titles"))


@query("index_from_tsv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS text FROM documents")
def index_from_tsv(spark, sf_dir):
    return readers.index_source_tsv(readers.read_tsv(spark, written_tsv(spark, load(spark, sf_dir, "documents").select("doc_id", "lang", "source"))))


@query(
    "index_field_weighted",
    r"""WITH f AS (SELECT p_partkey AS doc_id, unnest(regexp_extract_all(lower(p_name), '(\p{L}+)', 1)) AS term, 2.0 AS w FROM part
UNION ALL SELECT p_partkey, unnest(regexp_extract_all(lower(p_type), '(\p{L}+)', 1)), 0.5 FROM part WHERE true)
SELECT doc_id, term, round(CAST(sum(w) AS DOUBLE), 6) AS tf FROM f GROUP BY ALL""",
)
def index_field_weighted(spark, sf_dir):
    return readers.index_source_fields(load(spark, sf_dir, "part"), "p_partkey", {"p_name": 2.0, "p_type": 0.5}, fn.words).withColumn("tf", F.round("tf", 6))


@query("index_from_dir")
def index_from_dir(spark, sf_dir):
    writers.write_lines(load(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(" 软件项目")).alias("x")), "x", path := fresh_path(spark))
    return token_counts(readers.index_source_dir(spark, path), tokenize=fn.units)


@query("page_charset", "SELECT page_id, coalesce(nullif(regexp_extract(substr(html, 1, 3000), 'charset=\"?([-a-zA-Z0-9]+)', 1), ''), 'utf-8') AS charset FROM pages")
def page_charset(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", fn.charset("html").alias("charset"))


@query("graph_round_trip", "SELECT 'coocc' AS tp, n_name AS u, CAST(n_regionkey AS VARCHAR) AS v, n_nationkey / 4 AS w FROM nation")
def graph_round_trip(spark, sf_dir):
    nation = load(spark, sf_dir, "nation")
    edges = nation.select(F.lit("coocc").alias("tp"), F.col("n_name").alias("u"), F.col("n_regionkey").cast("string").alias("v"), (F.col("n_nationkey") / 4).alias("w"))
    writers.write_graph(nation.select(F.col("n_name").alias("node")), edges, path := fresh_path(spark))
    nodes, back = writers.read_graph(spark, path)
    return back.join(nodes, F.col("u") == F.col("node"), "left_semi")


@query("save_dict", "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_regionkey AS value FROM nation WHERE n_regionkey <> 0")
def save_dict(spark, sf_dir):
    writers.write_dict(load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("value")), path := fresh_path(spark), zeros=False)
    return readers.read_dict(spark, path, "int")


@query("rows_in_set", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def rows_in_set(spark, sf_dir):
    chosen = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return tables.rows_in_set(load(spark, sf_dir, "orders"), "o_custkey", chosen).select("o_orderkey", "o_orderpriority")


@query("merge_union_all", "SELECT n_name AS line FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
def merge_union_all(spark, sf_dir):
    n, r = load(spark, sf_dir, "nation").select(F.col("n_name").alias("line")), load(spark, sf_dir, "region").select(F.col("r_name").alias("line"))
    return tables.merge(n, r, n)


@query("merge_texts", r"SELECT length(regexp_replace(text, '[\r\n]+', ' ', 'g')) AS n, count(*) AS c FROM documents GROUP BY 1")
def merge_texts(spark, sf_dir):
    return merged(documents(spark, sf_dir)).groupBy(F.length("line").cast("long").alias("n")).agg(F.count("*").alias("c"))


@query(
    "zip_join",
    "WITH a AS (SELECT c_name, row_number() OVER (ORDER BY c_name) AS n FROM customer), b AS (SELECT s_name, row_number() OVER (ORDER BY s_name) AS n FROM supplier) SELECT c_name, s_name FROM a JOIN b USING (n)",
)
def zip_join(spark, sf_dir):
    return tables.zip_rows(load(spark, sf_dir, "customer").select("c_name"), load(spark, sf_dir, "supplier").select("s_name"), ["c_name"], ["s_name"])


@query("distinct_rows", "SELECT DISTINCT p_type AS line FROM part WHERE p_type <> ''")
def distinct_rows(spark, sf_dir):
    return tables.distinct_rows(load(spark, sf_dir, "part").select(F.col("p_type").alias("line")), "line")


@query("split_by_arity", "SELECT 2 + n_regionkey % 2 AS arity, count(*) AS n FROM nation GROUP BY 1")
def split_by_arity(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    rows = n.select(F.when(F.col("n_regionkey") % 2 == 1, F.array("n_name", "n_name", "n_name")).otherwise(F.array("n_name", "n_name")).alias("cols"))
    parts = [df.agg(F.lit(k).alias("arity"), F.count("*").alias("n")) for k, df in tables.split_by_arity(rows).items()]
    return tables.merge(*parts)


@query("sort_rows", "SELECT row_number() OVER (ORDER BY CAST(o_totalprice AS INTEGER) DESC, o_orderkey DESC) AS place, o_orderkey FROM orders ORDER BY 1 LIMIT 100")
def sort_rows(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.array(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.round("o_totalprice").cast("int").cast("string")).alias("cols"))
    placed = tables.numbered(tables.sort_rows(o, 1), [F.col("cols")[1].cast("int").desc(), F.col("cols")[0].desc()], "place").where("place <= 100")
    return placed.select(F.col("place").cast("long").alias("place"), F.col("cols")[0].cast("long").alias("o_orderkey"))


@query("sample_rows")
def sample_rows(spark, sf_dir):
    return tables.sample_rows(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), 100, 7)


@query("set_product", "SELECT n_name || r_name AS line FROM nation, region")
def set_product(spark, sf_dir):
    return tables.set_product(load(spark, sf_dir, "nation"), load(spark, sf_dir, "region"), "n_name", "r_name")


@query("freq_sort", "SELECT p_type AS key, count(*) AS value, row_number() OVER (ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY 1")
def freq_sort(spark, sf_dir):
    counted = load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("key")).agg(F.count("*").alias("value"))
    return tables.numbered(tables.by_value(counted, "key", "value"), [F.col("value").desc(), F.col("key")], "place").select("key", "value", F.col("place").cast("long").alias("place"))


@query("mini_sql_select", "SELECT n_name AS c0, CAST(n_regionkey AS VARCHAR) || '-' || CAST(n_nationkey AS VARCHAR) AS c1 FROM nation WHERE n_regionkey > 1")
def mini_sql_select(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select(F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("cols"))
    return tables.run_command({"nation.txt": n}, "select x[1], concat(x[2], '-', x[0]) from nation.txt where cast(x[2] as int) > 1 to out.txt")


@query("mini_sql_union", "SELECT lower(n_name) AS c0 FROM nation UNION ALL SELECT lower(r_name) FROM region WHERE lower(r_name) <> 'asia'")
def mini_sql_union(spark, sf_dir):
    n, r = load(spark, sf_dir, "nation").select(F.array("n_name").alias("cols")), load(spark, sf_dir, "region").select(F.array("r_name").alias("cols"))
    return tables.run_command({"a": n, "b": r}, 'SELECT lower(x[0]) FROM a+b WHERE lower(x[0]) <> "ASIA"')


@query("mini_sql_to", "SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS k FROM nation WHERE n_regionkey = 2")
def mini_sql_to(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select(F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("cols"))
    path = tables.save_command({"nation.txt": n}, "select x[1], x[0] from nation.txt where x[2] = '2' to found.txt", fresh_path(spark))
    return readers.read_tsv(spark, path).select(F.col("cols")[0].alias("name"), F.col("cols")[1].alias("k"))


# -- corpus and text functions


@query(
    "segment_docs",
    r"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS ls FROM documents)),
s AS (SELECT doc_id, i, regexp_replace(line, '^[\s\x{0B}\x{85}\p{Z}]+|[\s\x{0B}\x{85}\p{Z}]+$', '', 'g') AS line FROM l),
c AS (SELECT *, CASE WHEN line = '' OR starts_with(line, '---------------') THEN 1 ELSE 0 END AS cut FROM s),
g AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM c),
p AS (SELECT doc_id, g, string_agg(line, '' ORDER BY i) AS text FROM g WHERE cut = 0 GROUP BY ALL)
SELECT CAST(doc_id AS VARCHAR) || '@' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS VARCHAR) AS id, replace(regexp_replace(text, ' {2,}', '  ', 'g'), 'ﬁ', 'fi') AS text FROM p""",
)
def segment_docs(spark, sf_dir):
    return segment(documents(spark, sf_dir), "doc_id")


@query("token_counts", r"WITH u AS (SELECT doc_id, unnest(regexp_extract_all(lower(regexp_replace(text, ' +', ' ', 'g')), '([0-9A-Za-z]+|[^0-9A-Za-z])', 1)) AS term FROM documents) SELECT doc_id, term, count(*) AS tf FROM u WHERE NOT regexp_matches(term, '^[\s\x{0B}\x{85}\p{Z}]*$') GROUP BY ALL")
def count_tokens(spark, sf_dir):
    return token_counts(documents(spark, sf_dir))


@query("unit_cut", "SELECT doc_id, len(regexp_extract_all(text, '([0-9A-Za-z]+|[^0-9A-Za-z])', 1)) AS n, md5(array_to_string(regexp_extract_all(text, '([0-9A-Za-z]+|[^0-9A-Za-z])', 1), '|')) AS h FROM documents")
def unit_cut(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(fn.units("text")).cast("long").alias("n"), F.md5(F.array_join(fn.units("text"), "|").cast("binary")).alias("h"))


@query("is_cjk", "SELECT r_name AS s, false AS cjk FROM region UNION ALL SELECT r_name || '软件', false FROM region UNION ALL SELECT repeat('软件', 1 + r_regionkey), true FROM region")
def is_cjk(spark, sf_dir):
    r = load(spark, sf_dir, "region")
    s = r.select(F.col("r_name").alias("s")).union(r.select(F.concat("r_name", F.lit("软件")))).union(r.select(F.expr("repeat('软件', 1 + r_regionkey)")))
    return s.select("s", fn.is_cjk("s").alias("cjk"))


@query("regex_extract", r"SELECT page_id, coalesce(regexp_extract(html, '(?sm)<title>(.*?)</title>', 1), '') AS title FROM pages")
def regex_extract(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", fn.first_group("html", "<title>(.*?)</title>").alias("title"))


@query("page_hrefs", r"SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"?([a-zA-Z0-9\-_:/.%]+)', 1)) AS href FROM pages".replace('\\"', '"'))
def page_hrefs(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.explode(fn.hrefs("html")).alias("href")).distinct()


@query("page_links")
def page_links(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id", "url", F.explode(fn.hrefs("html")).alias("href"))
    return p.select("page_id", fn.absolute("url", "href").alias("link")).distinct()


@query("anchor_texts", r"SELECT page_id, anchor, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a.+?>(.+?)</a>', 1)) AS anchor FROM pages) GROUP BY ALL")
def anchor_texts(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.explode(fn.anchors("html")).alias("anchor")).groupBy("page_id", "anchor").agg(F.count("*").alias("n"))


@query("log_sum_exp", "WITH m AS (SELECT c_mktsegment, max(c_acctbal) AS m FROM customer GROUP BY 1) SELECT c_mktsegment, round(any_value(m) + ln(sum(exp(c_acctbal - m))), 6) AS lse FROM customer JOIN m USING (c_mktsegment) GROUP BY 1")
def log_sum_exp(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal")
    peak = c.groupBy("c_mktsegment").agg(F.max("c_acctbal").alias("m"))
    return c.join(peak, "c_mktsegment").groupBy("c_mktsegment").agg(F.round(F.first("m") + F.log(F.sum(F.exp(F.col("c_acctbal") - F.col("m")))), 6).alias("lse"))


@query("join_chunk", "SELECT p_partkey, replace(array_to_string(string_split(p_type, ' '), '-'), '-', ' ') AS s, replace(array_to_string(string_split(p_type, ' '), '-') || '-软件', '-', '') AS c FROM part")
def join_chunk(spark, sf_dir):
    toks = F.split("p_type", " ")
    return load(spark, sf_dir, "part").select("p_partkey", fn.join_chunk(toks).alias("s"), fn.join_chunk(F.concat(toks, F.array(F.lit("软件")))).alias("c"))


@query("time_decay_days", "SELECT event_id, round(greatest((1800000000 - greatest(epoch(ts), 1000000000)) / 86400.0, 0), 6) AS days FROM events")
def time_decay_days(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.round(fn.days_since(F.lit(1.8e9), F.col("ts").cast("timestamp").cast("double").cast("string"), F.lit(None).cast("string")), 6).alias("days"))


@query("escape_html", """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS h FROM pages""")
def escape_html(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.md5(fn.escape_html("html").cast("binary")).alias("h"))


@query("normal_query", "SELECT r_name AS q, lower(r_name) AS n FROM region UNION ALL SELECT '。' || r_name || '。。', lower(r_name) FROM region")
def normal_query(spark, sf_dir):
    r = load(spark, sf_dir, "region").select(F.col("r_name").alias("q"))
    q = r.union(r.select(F.concat(F.lit("。"), "q", F.lit("。。"))))
    return q.select("q", fn.normal_query("q").alias("n"))
