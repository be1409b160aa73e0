"""Queries over dictionaries, phrases, relations and the knowledge base."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import text as fn
from tagloom.operators import dictionary, kb, phrases, relations
from tagloom.plans.fixtures import ENTRIES, ISA, MENTIONS, NODES, TOKENS, TRIPLES, documents, entries, knowledge, word_counts
from tagloom.plans.registry import query
from tagloom.sources.workspace import load, settle

#: Spans of the dictionary in texts, case kept or not: doc_id, i (unit from 1), k (units), s (start), e (end), surface.
SPANS = r"""u AS (SELECT doc_id, unnest(l) AS unit, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all({text}, '([0-9A-Za-z]+|[^0-9A-Za-z])', 1) AS l FROM documents)),
p AS (SELECT *, CAST(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - length(unit) AS s, lead(unit, 1) OVER w AS u2, lead(unit, 2) OVER w AS u3 FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, s, 1 AS k, unit AS surface FROM p UNION ALL SELECT doc_id, i, s, 3, unit || u2 || u3 FROM p WHERE u3 IS NOT NULL),
spans AS (SELECT doc_id, i, k, s, s + length(surface) AS e, surface FROM c SEMI JOIN {entries} USING (surface))"""
MATCH = f"WITH {TOKENS}, {ENTRIES}, {SPANS.format(text='text', entries='entries')}"
UPPER = f"WITH {TOKENS}, {ENTRIES}, upper_entries AS (SELECT upper(replace(surface, 'ß', 'ss')) AS surface, max(surface) AS tag FROM entries GROUP BY 1), {SPANS.format(text="upper(replace(text, 'ß', 'ss'))", entries='upper_entries')}"


@query("dict_match", f"{MATCH} SELECT doc_id, s AS start, e AS \"end\", surface FROM spans")
def dict_match(spark, sf_dir):
    return dictionary.match(documents(spark, sf_dir), settle(entries(spark, sf_dir)))


@query("doc_tag_counts", f"{MATCH} SELECT doc_id, surface, count(*) AS n FROM spans GROUP BY ALL")
def doc_tag_counts(spark, sf_dir):
    return dictionary.counts(documents(spark, sf_dir), settle(entries(spark, sf_dir)))


@query("tag_documents", f"{UPPER} SELECT doc_id, string_agg(CAST(e + i + k - 1 AS VARCHAR) || ':' || tag, ',' ORDER BY e + i + k - 1, k DESC, tag) AS tags FROM spans JOIN upper_entries USING (surface) GROUP BY 1")
def tag_documents(spark, sf_dir):
    found = dictionary.tag(documents(spark, sf_dir), settle(entries(spark, sf_dir)))
    return found.select("doc_id", F.array_join(F.transform("tags", lambda x: F.concat(x["end_index"].cast("string"), F.lit(":"), x["tag"])), ",").alias("tags"))


@query("dict_stats", "SELECT count(*) AS num_items, CAST(sum(w) AS BIGINT) AS sum_items, round(ln(sum(w)), 6) AS log_sum_items FROM (SELECT p_name, max(p_size) AS w FROM part GROUP BY 1)")
def dict_stats(spark, sf_dir):
    part = load(spark, sf_dir, "part").groupBy(F.col("p_name").alias("surface")).agg(F.max("p_size").cast("long").alias("weight"))
    return dictionary.stats(part).withColumn("log_sum_items", F.round("log_sum_items", 6))


@query("dict_upsert", "SELECT n_name AS surface, CASE WHEN n_regionkey = 1 THEN 7 ELSE n_nationkey END AS weight FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT r_name, 0 FROM region")
def dict_upsert(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    own = n.select(F.col("n_name").alias("surface"), F.col("n_nationkey").alias("weight"))
    changes = n.where("n_regionkey in (1, 2)").select(F.col("n_name").alias("surface"), F.when(F.col("n_regionkey") == 1, 7).alias("weight"))
    now = dictionary.upsert(own, changes)
    return now.unionByName(dictionary.lookup(now, load(spark, sf_dir, "region").select(F.col("r_name").alias("surface"))))


@query("dict_load", "SELECT DISTINCT lower(trim(p_type)) AS surface FROM part")
def dict_load(spark, sf_dir):
    return dictionary.load_entries(load(spark, sf_dir, "part").select(F.concat(F.lit(" "), "p_type", F.lit("\t")).alias("node"))).select("surface")


# -- phrases

#: Words of the lines of documents: lines ln (line, t: tokens).
LINES = r"""ln AS (SELECT row_number() OVER () AS line, regexp_extract_all(lower(x), '(\p{L}+)', 1) AS t FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents)),
w AS MATERIALIZED (SELECT line, unnest(t) AS token, generate_subscripts(t, 1) AS i, len(t) AS n FROM ln),
uni AS MATERIALIZED (SELECT token, count(*) AS n FROM w GROUP BY 1),
x AS MATERIALIZED (SELECT *, lead(token, 1) OVER o AS t2, lead(token, 2) OVER o AS t3, lead(token, 3) OVER o AS t4, lead(token, 4) OVER o AS t5 FROM w WINDOW o AS (PARTITION BY line ORDER BY i)),
pl AS MATERIALIZED (SELECT token || ' ' || t2 AS chunk, 2 AS k, t3 AS nx, token AS prefix, t2 AS last FROM x WHERE t2 IS NOT NULL UNION ALL SELECT token || ' ' || t2 || ' ' || t3, 3, t4, token || ' ' || t2, t3 FROM x WHERE t3 IS NOT NULL
UNION ALL SELECT token || ' ' || t2 || ' ' || t3 || ' ' || t4, 4, t5, token || ' ' || t2 || ' ' || t3, t4 FROM x WHERE t4 IS NOT NULL),
g AS MATERIALIZED (SELECT chunk, k, any_value(prefix) AS prefix, any_value(last) AS last, count(*) AS n FROM pl GROUP BY chunk, k)"""
ENTROPY = """f0 AS MATERIALIZED (SELECT chunk, k, coalesce(nx, 'EOS') AS nx, count(*) AS n FROM pl GROUP BY ALL),
f1 AS MATERIALIZED (SELECT chunk, nx, CAST(sum(n) AS DOUBLE) AS n FROM (SELECT chunk, nx, n FROM f0 UNION ALL SELECT chunk, 'EOS', sum(n) FROM f0 WHERE k = 4 GROUP BY 1) GROUP BY ALL),
ent AS MATERIALIZED (SELECT chunk, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS entropy FROM f1 GROUP BY 1 HAVING ln(sum(n)) - sum(n * ln(n)) / sum(n) > 1e-12)"""
PMI = """pre AS MATERIALIZED (SELECT chunk AS prefix, n AS np FROM g UNION ALL SELECT token, n FROM uni),
pmi AS MATERIALIZED (SELECT chunk, g.n AS n, ln((g.n / np) / (uni.n / (SELECT CAST(sum(n) AS DOUBLE) FROM uni))) AS pmi FROM g JOIN pre USING (prefix) JOIN uni ON uni.token = g.last WHERE ln((g.n / np) / (uni.n / (SELECT CAST(sum(n) AS DOUBLE) FROM uni))) > 0)"""


def lines(spark, sf_dir):
    """tokens of every line of every document."""
    return documents(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("x")).select(fn.words("x").alias("tokens"))


@query("unigram_counts", f"WITH {LINES} SELECT token, n FROM uni")
def unigram_counts(spark, sf_dir):
    return phrases.unigrams(lines(spark, sf_dir))


@query("ngram_counts", f"WITH {LINES} SELECT chunk, n FROM g")
def ngram_counts(spark, sf_dir):
    return phrases.rated(lines(spark, sf_dir), glue=" ")


@query("right_entropy", f"WITH {LINES}, {ENTROPY} SELECT chunk, round(entropy, 6) AS entropy FROM ent")
def right_entropy(spark, sf_dir):
    return phrases.rated(lines(spark, sf_dir), entropy=True, glue=" ").select("chunk", F.round("entropy", 6).alias("entropy"))


@query("chunk_pmi", f"WITH {LINES}, {PMI} SELECT chunk, round(pmi, 6) AS pmi FROM pmi")
def chunk_pmi(spark, sf_dir):
    return phrases.rated(lines(spark, sf_dir), pmi=True, glue=" ").select("chunk", F.round("pmi", 6).alias("pmi"))


@query("new_words", f"WITH {LINES}, {ENTROPY}, {PMI} SELECT chunk AS surface, n, round(pmi, 6) AS pmi, round(entropy, 6) AS entropy FROM pmi JOIN ent USING (chunk) WHERE n >= 2 AND pmi >= 0.5 AND entropy >= 0.5")
def new_words(spark, sf_dir):
    found = phrases.new_words(lines(spark, sf_dir), min_freq=2, min_pmi=0.5, min_entropy=0.5)
    return found.select("surface", "n", F.round("pmi", 6).alias("pmi"), F.round("entropy", 6).alias("entropy"))


@query(
    "phrase_topk",
    r"""WITH src AS (SELECT row_number() OVER () AS line, regexp_extract_all(lower(x), '(\p{L}+)', 1) AS t FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents) WHERE length(x) >= 10 AND regexp_matches(x, '[a-zA-Z一-龥]{2,}')),
pad AS (SELECT line, list_concat(['^'], t, ['$']) AS t FROM src),
w AS (SELECT line, unnest(t) AS a, generate_subscripts(t, 1) AS i FROM pad),
x AS (SELECT *, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY line ORDER BY i)),
g1 AS (SELECT a, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY 1), g2 AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM x WHERE b IS NOT NULL GROUP BY ALL), g3 AS (SELECT a, b, c, CAST(count(*) AS DOUBLE) AS n FROM x WHERE c IS NOT NULL GROUP BY ALL),
r AS (SELECT p.a, p.b, p.n AS n2, ln(p.n) - ln((SELECT sum(n) FROM g2)) - (ln(x.n) - ln((SELECT sum(n) FROM g1))) - (ln(y.n) - ln((SELECT sum(n) FROM g1))) AS pmi, greatest(x.n, y.n) AS m FROM g2 p JOIN g1 x ON x.a = p.a JOIN g1 y ON y.a = p.b),
ok AS (SELECT * FROM r WHERE m > 3 AND pmi >= 2 AND regexp_matches(a || b, '^\p{L}+$')),
l AS (SELECT ok.a, ok.b, sum(-(g3.n / ok.n2) * ln(g3.n / ok.n2)) AS hl, sum(-(g3.n / q.n) * ln(g3.n / q.n)) AS hlr FROM ok JOIN g3 ON g3.b = ok.a AND g3.c = ok.b JOIN g2 q ON q.a = g3.a AND q.b = g3.b GROUP BY ALL),
s AS (SELECT ok.a, ok.b, sum(-(g3.n / ok.n2) * ln(g3.n / ok.n2)) AS hr, sum(-(g3.n / q.n) * ln(g3.n / q.n)) AS hrl FROM ok JOIN g3 ON g3.a = ok.a AND g3.b = ok.b JOIN g2 q ON q.a = g3.b AND q.b = g3.c GROUP BY ALL),
z AS (SELECT a, b, (pmi - least(coalesce(hlr, 0), coalesce(hrl, 0)) + least(coalesce(hl, 0), coalesce(hr, 0))) * n2 AS score FROM ok LEFT JOIN l USING (a, b) LEFT JOIN s USING (a, b))
SELECT a || b AS phrase, round(score, 4) AS score FROM z ORDER BY round(score, 6) DESC, a, b LIMIT 1000""",
)
def phrase_topk(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("x")).where(F.length("x") >= 10).where(F.col("x").rlike("[a-zA-Z一-龥]{2,}"))
    return phrases.top_phrases(rows.select(fn.words("x").alias("tokens")), allowed=F.col("phrase").rlike(r"^\p{L}+$")).withColumn("score", F.round("score", 4))


@query("textrank")
def textrank(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    return phrases.text_rank(rows.select(F.struct("doc_id", "line").alias("sentence"), fn.words("x").alias("tokens"))).select("sentence.doc_id", "sentence.line", "token", "weight").withColumn("weight", F.round("weight", 6))


# -- relations

BASKETS = """tags AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p_brand) AS pos, p_brand AS tag FROM lineitem JOIN part ON l_partkey = p_partkey)"""
FOLD = BASKETS + """,
walk AS (SELECT doc, pos AS i, pos AS j, tag AS cur, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b FROM tags
UNION ALL SELECT r.doc, r.i, t.pos, CASE WHEN contains(r.cur, t.tag) OR contains(t.tag, r.cur) THEN r.cur ELSE least(r.cur, t.tag) END,
CASE WHEN contains(r.cur, t.tag) OR contains(t.tag, r.cur) THEN NULL ELSE least(r.cur, t.tag) END, CASE WHEN contains(r.cur, t.tag) OR contains(t.tag, r.cur) THEN NULL ELSE greatest(r.cur, t.tag) END
FROM walk r JOIN tags t ON t.doc = r.doc AND t.pos = r.j + 1 WHERE t.pos <= r.i + 10)"""
WEIGHTS = """two AS (SELECT a, b, count(*) AS n FROM pairs GROUP BY ALL), one AS (SELECT u, sum(n) AS m FROM (SELECT a AS u, n FROM two UNION ALL SELECT b, n FROM two) GROUP BY 1),
twoway AS (SELECT a AS u, b AS v, n FROM two UNION ALL SELECT b, a, n FROM two)"""


def baskets(spark, sf_dir):
    """tags: brands of an order's lines in order."""
    rows = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "p_brand"))), lambda x: x["p_brand"]).alias("tags"))


@query("cooc_weights", f"WITH RECURSIVE {FOLD}, pairs AS (SELECT a, b FROM walk WHERE a IS NOT NULL), {WEIGHTS} SELECT u, v, round(CAST(n AS DOUBLE) / m, 6) AS w FROM twoway JOIN one USING (u)")
def cooc_weights(spark, sf_dir):
    return relations.cooccurrence(baskets(spark, sf_dir)).withColumn("w", F.round("w", 6))


@query("cooc_symmetric", f"WITH {BASKETS}, pairs AS (SELECT least(x.tag, y.tag) AS a, greatest(x.tag, y.tag) AS b FROM tags x JOIN tags y ON x.doc = y.doc AND y.pos > x.pos AND y.pos <= x.pos + 3 WHERE NOT contains(x.tag, y.tag) AND NOT contains(y.tag, x.tag)), {WEIGHTS} SELECT u, v, round(CAST(n AS DOUBLE) / m, 6) AS w FROM twoway JOIN one USING (u) WHERE n > 2 AND CAST(n AS DOUBLE) / m >= 0.01")
def cooc_symmetric(spark, sf_dir):
    return relations.cooccurrence(baskets(spark, sf_dir), window=3, min_count=2, min_weight=0.01, mode="symmetric").withColumn("w", F.round("w", 6))


@query("cooc_tag_vocab", f"WITH {TOKENS} SELECT term FROM tf GROUP BY 1 HAVING count(*) > 2 AND ln((SELECT count(*) FROM documents) / count(*)) > 2 AND length(term) > 1 AND NOT regexp_matches(term, '^[0-9]+$')")
def cooc_tag_vocab(spark, sf_dir):
    return relations.tag_vocabulary(word_counts(spark, sf_dir), documents(spark, sf_dir).count())


#: Turns of conversations as segments of a file; tags are the rarer words, sorted.
TURNS = r"""c AS (SELECT conv_id AS file, row_number() OVER (ORDER BY conv_id, turn, role) - 1 AS i, list_distinct(regexp_extract_all(lower(text), '(\p{L}+)', 1)) AS l FROM conversations),
ct AS (SELECT file, i, unnest(l) AS tag FROM c), ok AS (SELECT tag FROM ct GROUP BY 1 HAVING count(*) > 2 AND ln((SELECT count(*) FROM conversations) / count(*)) > 3 AND length(tag) > 1),
seg AS (SELECT file, i, tag, row_number() OVER (PARTITION BY i ORDER BY tag) AS pos FROM ct SEMI JOIN ok USING (tag)),
files AS (SELECT DISTINCT file, i FROM c),
part3 AS (SELECT f.i, f.file, k, CASE k WHEN 0 THEN 5 * greatest(0, CAST(floor((f.i - 6) / 5.0) AS BIGINT)) ELSE f.i - k END AS j FROM files f, (VALUES (0), (1), (2)) v(k) WHERE f.i > 0 AND k < f.i),
mates AS (SELECT p.i, p.k, p.j FROM part3 p JOIN files a ON a.i = 5 * greatest(0, CAST(floor((p.i - 6) / 5.0) AS BIGINT)) AND a.file = p.file JOIN files o ON o.i = p.j AND o.file = p.file),
walk AS (SELECT m.i, m.k, m.j, s.pos AS s, CAST(0 AS BIGINT) AS at, s.tag AS cur, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b FROM mates m JOIN seg s ON s.i = m.i
UNION ALL SELECT r.i, r.k, r.j, r.s, t.pos, CASE WHEN contains(r.cur, t.tag) OR contains(t.tag, r.cur) THEN r.cur ELSE least(r.cur, t.tag) END,
CASE WHEN contains(r.cur, t.tag) OR contains(t.tag, r.cur) THEN NULL ELSE least(r.cur, t.tag) END, CASE WHEN contains(r.cur, t.tag) OR contains(t.tag, r.cur) THEN NULL ELSE greatest(r.cur, t.tag) END
FROM walk r JOIN seg t ON t.i = r.j AND t.pos = r.at + 1)"""


@query(
    "cooc_segments",
    f"WITH RECURSIVE {TURNS}, pairs AS (SELECT a, b FROM walk WHERE a IS NOT NULL), {WEIGHTS}, cut AS (SELECT a, b FROM two WHERE n < 20 ORDER BY n DESC, a, b LIMIT 1), keep AS (SELECT a, b, n FROM two WHERE n >= 20 UNION ALL SELECT a, b, n FROM two JOIN cut USING (a, b)), kb AS (SELECT a AS u, b AS v, n FROM keep UNION ALL SELECT b, a, n FROM keep) SELECT u, v, round(CAST(n AS DOUBLE) / m, 6) AS w FROM kb JOIN one USING (u) WHERE CAST(n AS DOUBLE) / m >= 0.001",
)
def cooc_segments(spark, sf_dir):
    turns = relations.with_order(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id", "turn", "role"])
    words = turns.select(F.col("conv_id").alias("file"), "i", F.explode(F.array_distinct(fn.words("text"))).alias("term"))
    n = turns.count()
    vocab = relations.tag_vocabulary(words.select(F.col("i").alias("doc_id"), "term"), n, min_idf=3.0)
    tags = words.join(vocab, "term", "left_semi").groupBy("file", "i").agg(F.array_sort(F.collect_list("term")).alias("tags"))
    every = settle(turns.select(F.col("conv_id").alias("file"), "i").join(tags.drop("file"), "i", "left").select("file", "i", F.coalesce("tags", F.array().cast("array<string>")).alias("tags")))
    return relations.segment_edges(settle(relations.segment_pairs(every)), 20, 0.001).withColumn("w", F.round("w", 6))


@query(
    "kg_link_edges",
    f"""WITH {TRIPLES}, {MENTIONS}, {NODES}, f AS (SELECT m, count(*) AS k, min_by(e, pos) AS e FROM mentions GROUP BY 1), l AS (SELECT DISTINCT m, k, e FROM f SEMI JOIN (SELECT node AS m FROM nodes) x USING (m) WHERE NOT regexp_matches(e, '[歌影]')),
t AS (SELECT m, k, unnest(regexp_extract_all(o, '<a.+?>(.+?)</a>', 1)) AS t FROM l JOIN triples ON s = e), y AS (SELECT * FROM t WHERE t <> m AND t IN (SELECT node FROM nodes))
SELECT 'KG' AS tp, m AS u, t AS v, round(0.5 + CAST(0.5 AS DOUBLE) / k, 6) AS w FROM y UNION ALL SELECT 'KGi', t, m, round(0.5 + CAST(0.5 AS DOUBLE) / k, 6) FROM y""",
)
def kg_link_edges(spark, sf_dir):
    k = knowledge(spark, sf_dir)
    return relations.link_edges(k["nodes"], k["mentions"], k["triples"]).withColumn("w", F.round("w", 6))


@query("kg_mention_edges", f"WITH {MENTIONS}, {NODES}, f AS (SELECT m, min_by(e, pos) AS e FROM mentions GROUP BY 1 HAVING m IN (SELECT node FROM nodes)) SELECT 'KGm' AS tp, a.m AS u, b.m AS v, CAST(1 AS DOUBLE) AS w FROM f a JOIN f b ON a.e = b.e AND a.m <> b.m")
def kg_mention_edges(spark, sf_dir):
    k = knowledge(spark, sf_dir)
    return relations.mention_edges(k["nodes"], k["mentions"])


#: Words are part names and their first and last words; classes must be words.
TYPES = """ty AS (SELECT DISTINCT p_name AS word FROM part), vw AS (SELECT word FROM ty UNION SELECT DISTINCT string_split(p_name, ' ')[-1] FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[1] FROM part), sp AS (SELECT word, string_split(word, ' ') AS t FROM vw),
suf AS (SELECT word, array_to_string(t[i:], ' ') AS class FROM (SELECT word, t, unnest(generate_series(1, len(t))) AS i FROM sp)), isa_s AS (SELECT word, class FROM suf SEMI JOIN (SELECT word AS class FROM vw) x USING (class))"""


def type_words(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_name").distinct()
    toks = F.split("p_name", " ")
    every = p.select(F.col("p_name").alias("word")).union(p.select(F.element_at(toks, -1))).union(p.select(toks[0])).distinct()
    return every.select("word", F.split("word", " ").alias("tokens"))


@query("isa_suffix", f"WITH {TYPES} SELECT word, class FROM isa_s")
def isa_suffix(spark, sf_dir):
    w = type_words(spark, sf_dir)
    return relations.suffixes(w, w, glue=" ")


@query(
    "isa_ngram",
    f"WITH {TYPES}, st AS (SELECT word, t, unnest(generate_series(1, len(t))) AS i FROM sp), ng AS (SELECT word, t, i, unnest(generate_series(i, len(t))) AS j FROM st) SELECT word, array_to_string(t[i:j], ' ') AS class FROM ng WHERE array_to_string(t[i:j], ' ') IN (SELECT word FROM vw)",
)
def isa_ngram(spark, sf_dir):
    w = type_words(spark, sf_dir)
    return relations.token_ngrams(w, w, glue=" ")


@query("isa_classes", f"WITH {TYPES} SELECT class, count(*) AS n, string_agg(DISTINCT word, ',' ORDER BY word) AS words FROM isa_s GROUP BY 1 HAVING count(*) >= 2")
def isa_classes(spark, sf_dir):
    w = type_words(spark, sf_dir)
    return relations.classes(relations.suffixes(w, w, glue=" "), 2).withColumn("words", F.array_join("words", ","))


@query("isa_triples", f"WITH {TYPES} SELECT DISTINCT word AS s, 'isA' AS p, class AS o FROM isa_s WHERE word <> class")
def isa_triples(spark, sf_dir):
    w = type_words(spark, sf_dir)
    return relations.triples(relations.suffixes(w, w, glue=" "))


@query("isa_soft")
def isa_soft(spark, sf_dir):
    w = type_words(spark, sf_dir)
    pos = w.select(F.explode("tokens").alias("token")).distinct().withColumn("tag", F.when(F.col("token").endswith("ed"), "v").otherwise("n"))
    return relations.soft_classes(w, pos, glue=" ")


@query(
    "kos_components",
    f"""WITH RECURSIVE {TYPES}, e AS (SELECT class AS a, word AS b FROM isa_s WHERE class <> word UNION SELECT word, class FROM isa_s WHERE class <> word), r AS (SELECT DISTINCT a AS node, a AS x FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.x = e.a),
root AS (SELECT node, min(x) AS root FROM r GROUP BY 1), seeds AS (SELECT r_name AS word FROM region UNION SELECT min(word) FROM vw), hit AS (SELECT DISTINCT root FROM root JOIN seeds ON node = word),
mem AS (SELECT class, class AS node FROM isa_s UNION SELECT class, word FROM isa_s)
SELECT class, bool_or(coalesce(root.root IN (SELECT root FROM hit), false) OR node IN (SELECT word FROM seeds)) AS seeded FROM mem LEFT JOIN root USING (node) GROUP BY 1""",
)
def kos_components(spark, sf_dir):
    w = type_words(spark, sf_dir)
    seeds = load(spark, sf_dir, "region").select(F.col("r_name").alias("word")).union(w.agg(F.min("word")))
    return relations.seeded_classes(settle(relations.suffixes(w, w, glue=" ")), seeds)


@query(
    "taxonomy_closure",
    """WITH RECURSIVE e AS (SELECT 'root' AS p, r_name AS c FROM region UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT p AS a, c AS d, 1 AS k FROM e UNION SELECT a, c, k + 1 FROM r JOIN e ON p = d) SELECT a AS ancestor, d AS descendant, CAST(min(k) AS BIGINT) AS depth FROM r GROUP BY ALL""",
)
def taxonomy_closure(spark, sf_dir):
    r, n, c = (load(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    tree = r.select(F.lit("root").alias("parent"), F.col("r_name").alias("child"))
    tree = tree.unionByName(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child")))
    return relations.closure(tree.unionByName(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("parent"), F.col("c_name").alias("child"))))


# -- knowledge base

ASKED = "asked AS (SELECT s_name AS e FROM supplier)"
AGES = "k AS (SELECT s, bool_or(p = '逝世日期') AS dead, min(CASE WHEN p = '出生日期' THEN regexp_extract(o, '(\\d{4})', 1) END) AS born FROM triples GROUP BY 1), age AS (SELECT s, '年龄' AS p, CAST(2020 - CAST(born AS INTEGER) AS VARCHAR) || '岁' AS o FROM k WHERE NOT dead AND born <> '')"


def asked(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select(F.col("s_name").alias("e"))


def text_list(df, column):
    return df.withColumn(column, F.array_join(column, "|"))


@query("kb_entities", f"WITH {MENTIONS} SELECT m, string_agg(e, '|' ORDER BY pos, e) AS entities FROM mentions GROUP BY 1")
def kb_entities(spark, sf_dir):
    m = knowledge(spark, sf_dir)["mentions"]
    return text_list(kb.entities_of(m.select("m"), m), "entities")


@query("kb_mentions", f"WITH {MENTIONS} SELECT e, string_agg(m, '|' ORDER BY m) AS mentions FROM mentions WHERE e IN (SELECT n_name FROM nation) GROUP BY 1")
def kb_mentions(spark, sf_dir):
    return text_list(kb.mentions_of(load(spark, sf_dir, "nation").select(F.col("n_name").alias("e")), knowledge(spark, sf_dir)["mentions"]), "mentions")


@query("kb_description", f"WITH {TRIPLES} SELECT n_name AS e, max(o) AS description FROM nation JOIN triples ON s = n_name AND p = 'DESC' GROUP BY 1 UNION ALL SELECT s_name, '' FROM supplier")
def kb_description(spark, sf_dir):
    every = asked(spark, sf_dir).union(load(spark, sf_dir, "nation").select("n_name"))
    return kb.description_of(every, knowledge(spark, sf_dir)["triples"])


@query("kb_categories", f"WITH {TRIPLES} SELECT s AS e, string_agg(o, '|' ORDER BY pos) AS \"values\" FROM triples WHERE p = 'CATEGORY_ZH' GROUP BY 1")
def kb_categories(spark, sf_dir):
    return text_list(kb.categories_of(asked(spark, sf_dir), knowledge(spark, sf_dir)["triples"]), "values")


@query("kb_types", "SELECT s_name AS e, 'debtor|supplier' AS types FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT s_name, 'supplier' FROM supplier WHERE s_acctbal >= 0")
def kb_types(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    types = s.select(F.col("s_name").alias("e"), F.lit("supplier").alias("type")).union(s.where("s_acctbal < 0").select("s_name", F.lit("debtor")))
    return text_list(kb.types_of(asked(spark, sf_dir), types), "types")


@query("kb_values", f"WITH {TRIPLES} SELECT s AS e, string_agg(o, '|' ORDER BY pos) AS \"values\" FROM triples WHERE p = '出生日期' GROUP BY 1")
def kb_values(spark, sf_dir):
    return text_list(kb.values_of(asked(spark, sf_dir), knowledge(spark, sf_dir)["triples"], kb.BORN), "values")


@query("kb_properties", f"WITH {TRIPLES}, {ASKED} SELECT e, p, string_agg(o, '|' ORDER BY pos) AS \"values\" FROM triples JOIN asked ON s = e GROUP BY ALL")
def kb_properties(spark, sf_dir):
    return text_list(kb.properties_of(asked(spark, sf_dir), knowledge(spark, sf_dir)["triples"]), "values")


@query("kb_inverse", f"WITH {TRIPLES} SELECT o AS e, p, s FROM triples WHERE o = 'supplier'")
def kb_inverse(spark, sf_dir):
    return kb.inverse_of(spark.range(1).select(F.lit("supplier").alias("e")), knowledge(spark, sf_dir)["triples"])


@query("kb_clicks", "SELECT s_name AS e, coalesce(n, 0) AS n FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON s_suppkey = l_suppkey")
def kb_clicks(spark, sf_dir):
    n = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    names = load(spark, sf_dir, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_name").alias("e"), "n")
    return kb.clicks_of(asked(spark, sf_dir), names)


@query("kb_age", f"WITH {TRIPLES}, {AGES} SELECT * FROM age")
def kb_age(spark, sf_dir):
    return kb.ages(knowledge(spark, sf_dir)["triples"], 2020)


@query("kb_triples", rf"WITH {TRIPLES}, {ASKED}, {AGES} SELECT s AS e, p, regexp_replace(o, '<a.+?>(.+?)</a>', '\1', 'g') AS o FROM triples WHERE s IN (SELECT e FROM asked) UNION ALL SELECT s, p, o FROM age")
def kb_triples(spark, sf_dir):
    return kb.triples_of(asked(spark, sf_dir), knowledge(spark, sf_dir)["triples"], 2020)


@query("kb_triples_linked", f"WITH {TRIPLES}, {ASKED}, {AGES} SELECT s AS e, p, o FROM triples WHERE s IN (SELECT e FROM asked) UNION ALL SELECT s, p, o FROM age")
def kb_triples_linked(spark, sf_dir):
    return kb.triples_of(asked(spark, sf_dir), knowledge(spark, sf_dir)["triples"], 2020, links=True)


@query("kb_concepts", f"WITH {ISA} SELECT e, string_agg(concept, '|' ORDER BY score DESC, concept) AS concepts FROM isa GROUP BY 1")
def kb_concepts(spark, sf_dir):
    return text_list(kb.concepts_of(asked(spark, sf_dir), knowledge(spark, sf_dir)["isa"]), "concepts")


@query("kb_scored_concepts", f"WITH {ISA} SELECT e, concept, CAST(score AS DOUBLE) AS score FROM isa")
def kb_scored_concepts(spark, sf_dir):
    return kb.scored_concepts_of(asked(spark, sf_dir), knowledge(spark, sf_dir)["isa"])


@query("kb_by_concept", f"WITH {ISA} SELECT concept, string_agg(e, '|' ORDER BY e) AS entities FROM isa GROUP BY 1")
def kb_by_concept(spark, sf_dir):
    isa = knowledge(spark, sf_dir)["isa"]
    return text_list(kb.entities_with(isa.select("concept"), isa), "entities")


@query("kb_is_entity", "SELECT n_name AS m, true AS is_entity FROM nation UNION ALL SELECT c_name, false FROM customer")
def kb_is_entity(spark, sf_dir):
    every = load(spark, sf_dir, "nation").select(F.col("n_name").alias("m")).union(load(spark, sf_dir, "customer").select("c_name"))
    return kb.is_entity(every, knowledge(spark, sf_dir)["mentions"])
