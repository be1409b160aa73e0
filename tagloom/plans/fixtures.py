"""Stand-ins made from the input tables: token tables, dictionary, knowledge base, graph, impressions - and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.text import words
from tagloom.operators.corpus import token_counts
from tagloom.sources.workspace import load

#: Words of documents (tokens t: doc_id, pos from 1, term) and their counts (tf).
TOKENS = r"""t AS (SELECT doc_id, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '(\p{L}+)', 1) AS l FROM documents)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)"""

#: BM25 tables of words.
INDEX = TOKENS + """,
dl AS (SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS dl FROM tf GROUP BY 1),
n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
idf AS (SELECT term, count(*) AS df, ln(greatest(((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5), 1.0001)) AS idf FROM tf GROUP BY 1)"""

#: Dictionary: the 30 commonest words of three letters or more, and the first two words of each benchmark item.
ENTRIES = r"""entries AS (SELECT surface FROM (SELECT term AS surface, sum(tf) AS c FROM tf WHERE length(term) >= 3 AND regexp_matches(term, '^[a-z]+$') GROUP BY 1 ORDER BY c DESC, term LIMIT 30)
UNION SELECT DISTINCT lower(regexp_extract(text, '^([A-Za-z]+ [A-Za-z]+)', 1)) FROM benchmark WHERE regexp_matches(text, '^[A-Za-z]+ [A-Za-z]+'))"""


def documents(spark, sf_dir: str) -> DataFrame:
    """Documents; those of a file too small to give every core a task are dealt evenly, larger inputs stay as they are."""
    docs, cores = load(spark, sf_dir, "documents").select("doc_id", "text"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def word_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenize=words)


def entries(spark, sf_dir: str, tf: DataFrame | None = None) -> DataFrame:
    """surface and weight of the dictionary."""
    tf = word_counts(spark, sf_dir) if tf is None else tf
    common = tf.where(F.col("term").rlike("^[a-z]{3,}$")).groupBy("term").agg(F.sum("tf").alias("c")).orderBy(F.col("c").desc(), "term").limit(30).select(F.col("term").alias("surface"))
    heads = load(spark, sf_dir, "benchmark").select(F.lower(F.regexp_extract("text", "^([A-Za-z]+ [A-Za-z]+)", 1)).alias("surface")).where("surface <> ''")
    return common.union(heads).distinct().withColumn("weight", F.lit(1).cast("long"))


#: Triples, mentions and isA of regions, nations and suppliers.
TRIPLES = """triples AS (SELECT n_name AS s, 'region' AS p, '<a href="/e/' || r_name || '">' || r_name || '</a>' AS o, 0 AS pos FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT n_name, 'DESC', n_name || ' lies in ' || r_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT s_name, 'nation', '<a href="/e/' || n_name || '">' || n_name || '</a>', 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT s_name, 'CATEGORY_ZH', 'supplier', 1 FROM supplier
UNION ALL SELECT s_name, '出生日期', CAST(1950 + s_suppkey % 50 AS VARCHAR) || '-01-02', 2 FROM supplier
UNION ALL SELECT s_name, '逝世日期', '2010', 3 FROM supplier WHERE s_acctbal < 0)"""
MENTIONS = """mentions AS (SELECT n_name AS m, n_name AS e, 0 AS pos FROM nation UNION ALL SELECT lower(n_name), n_name, 0 FROM nation UNION ALL SELECT r_name, r_name, 0 FROM region
UNION ALL SELECT s_name, s_name, 0 FROM supplier UNION ALL SELECT s_name, n_name, 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
ISA = """isa AS (SELECT s_name AS e, 'supplier of ' || n_name AS concept, 0.9 AS score FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_name, 'company', 0.5 FROM supplier)"""
NODES = """nodes AS (SELECT n_name AS node FROM nation UNION ALL SELECT lower(n_name) FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT s_name FROM supplier)"""


def knowledge(spark, sf_dir: str) -> dict[str, DataFrame]:
    """triples, mentions, isa and nodes."""
    for t in ("region", "nation", "supplier"):
        load(spark, sf_dir, t).createOrReplaceTempView(f"_kb_{t}")
    named = {}
    for name, cte in (("triples", TRIPLES), ("mentions", MENTIONS), ("isa", ISA), ("nodes", NODES)):
        body = cte[len(name) + 5 : -1]
        for t in ("region", "nation", "supplier"):
            body = body.replace(f"FROM {t}", f"FROM _kb_{t} {t}").replace(f"JOIN {t}", f"JOIN _kb_{t} {t}")
        named[name] = spark.sql(body.replace("AS VARCHAR", "AS STRING").replace("0.9 AS score", "0.9D AS score").replace("0.5 FROM", "0.5D FROM"))
    return named


#: Edges of the tag graph: nations and regions, suppliers and nations, and nations of a region.
EDGES = """edges AS (SELECT 'KGm' AS tp, n_name AS u, r_name AS v, CAST(0.9 AS DOUBLE) AS w FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'KGm', r_name, n_name, 0.8 FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'KG', s_name, n_name, 0.9 FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'KGi', n_name, s_name, 0.95 FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'coocc', a.n_name, b.n_name, 0.7 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name
UNION ALL SELECT 'other', r_name, 'nowhere', 1.0 FROM region)"""


def edges(spark, sf_dir: str) -> DataFrame:
    nation, region, supplier = (load(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    of_region = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    of_nation = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    a, b = nation.select(F.col("n_name").alias("u"), F.col("n_regionkey").alias("k")), nation.select(F.col("n_name").alias("v"), F.col("n_regionkey").alias("k"))

    def edge(df: DataFrame, tp: str, u: str, v: str, w: float) -> DataFrame:
        return df.select(F.lit(tp).alias("tp"), F.col(u).alias("u"), F.col(v).alias("v"), F.lit(w).alias("w"))

    out = edge(of_region, "KGm", "n_name", "r_name", 0.9).unionByName(edge(of_region, "KGm", "r_name", "n_name", 0.8))
    out = out.unionByName(edge(of_nation, "KG", "s_name", "n_name", 0.9)).unionByName(edge(of_nation, "KGi", "n_name", "s_name", 0.95))
    return out.unionByName(edge(a.join(b, "k").where("u < v"), "coocc", "u", "v", 0.7)).unionByName(edge(region.withColumn("x", F.lit("nowhere")), "other", "r_name", "x", 1.0))


#: Impressions: for each order the lines as results; those returned count as clicked.
RESULTS = """results AS (SELECT CAST(o_custkey AS VARCHAR) AS uid, o_orderpriority AS query, l_orderkey AS imp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank, 'Part ' || CAST(l_partkey AS VARCHAR) || ' ' AS title, 'http://p/' || CAST(l_partkey AS VARCHAR) AS url,
l_extendedprice / 1000 AS bm25, l_quantity AS f6, l_discount AS f8, l_tax AS f13, CASE l_linestatus WHEN 'O' THEN 'blog' ELSE 'wiki' END AS doc_type, CAST(epoch(l_shipdate) AS DOUBLE) AS modified, l_returnflag AS flag
FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CLICKS = """clicks AS (SELECT DISTINCT uid, query, upper(title) AS title, CASE WHEN rank % 2 = 0 THEN url ELSE ' ' END AS url FROM results WHERE flag = 'R')"""


#: Rows of results that a task sorts, as planned.
TASK_ROWS = 1 << 19


def row_tasks(spark, sf_dir: str) -> int:
    """Tasks for the lines of orders, so that the rows of one are bounded whatever the number of shuffle partitions."""
    return max(spark.sparkContext.defaultParallelism, -(-load(spark, sf_dir, "lineitem").count() // TASK_ROWS))


def results(spark, sf_dir: str, rated=None) -> DataFrame:
    """uid, query, imp, rank, title, url, bm25, f6, f8, f13, doc_type, modified, flag.

    ``rated`` may add columns to the lines, of which it sees the features too, before they meet their orders.
    """
    n, lines = row_tasks(spark, sf_dir), load(spark, sf_dir, "lineitem")
    features = {
        "bm25": F.col("l_extendedprice") / 1000, "f6": F.col("l_quantity"), "f8": F.col("l_discount"), "f13": F.col("l_tax"), "doc_type": F.when(F.col("l_linestatus") == "O", "blog").otherwise("wiki"), "modified": F.col("l_shipdate").cast("timestamp").cast("double"),
    }
    known = lines.columns
    lines = rated(lines.withColumns(features)).drop(*features) if rated else lines
    added = [c for c in lines.columns if c not in known]
    lines = lines.repartition(n, "l_orderkey").join(load(spark, sf_dir, "orders").repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    part = F.col("l_partkey").cast("string")
    return lines.select(
        F.col("o_custkey").cast("string").alias("uid"), F.col("o_orderpriority").alias("query"), F.col("l_orderkey").alias("imp"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long").alias("rank"), F.concat(F.lit("Part "), part, F.lit(" ")).alias("title"), F.concat(F.lit("http://p/"), part).alias("url"),
        *(c.alias(name) for name, c in features.items()), F.col("l_returnflag").alias("flag"), *added,
    )


def clicks(shown: DataFrame) -> DataFrame:
    """uid, query, title, url of the results that were clicked."""
    return shown.where("flag = 'R'").select("uid", "query", F.upper("title").alias("title"), F.when(F.col("rank") % 2 == 0, F.col("url")).otherwise(" ").alias("url")).distinct()
