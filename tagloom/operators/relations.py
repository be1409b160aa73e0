"""Relation mining: co-occurrence, links of a knowledge base, and isA candidates."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import anchors
from tagloom.operators.tables import numbered
from tagloom.sources.workspace import discard, settle

WINDOW = 10


def _fold(first: Column, following: Column) -> Column:
    """Pairs of ``first`` with each of the following tags, in code-point order.

    Tags of which one holds the other are passed over.  The running tag becomes the smaller of each pair, which is
    then compared with the next one.
    """
    empty = F.array().cast("array<struct<a:string,b:string>>")

    def step(state: Column, tag: Column) -> Column:
        skip = tag.contains(state["cur"]) | state["cur"].contains(tag)
        low, high = F.least(state["cur"], tag), F.greatest(state["cur"], tag)
        return F.when(skip, state).otherwise(F.struct(low.alias("cur"), F.concat(state["pairs"], F.array(F.struct(low.alias("a"), high.alias("b")))).alias("pairs")))

    return F.aggregate(following, F.struct(first.alias("cur"), empty.alias("pairs")), step, lambda s: s["pairs"])


def _symmetric(first: Column, following: Column) -> Column:
    """Each following tag with the first one, unless one holds the other."""
    open_ = F.filter(following, lambda t: ~(t.contains(first) | first.contains(t)))
    return F.transform(open_, lambda t: F.struct(F.least(first, t).alias("a"), F.greatest(first, t).alias("b")))


def pair_counts(docs: DataFrame, tags: str = "tags", window: int = WINDOW, mode: str = "reference") -> DataFrame:
    """a, b and n of tags within ``window`` of each other (0: anywhere behind) in a document's list."""
    size = F.lit(window) if window else F.size(tags)
    make = _fold if mode == "reference" else _symmetric
    pairs = F.flatten(F.transform(tags, lambda t, i: make(t, F.slice(tags, i + 2, size))))
    return docs.select(F.explode(pairs).alias("p")).groupBy("p").agg(F.count("*").alias("n")).select("p.a", "p.b", "n")


def pair_weights(pairs: DataFrame, min_count: int = 0, min_weight: float = 0.0) -> DataFrame:
    """u, v, w both ways: the share of u's pairs that are with v; counts must exceed ``min_count``."""
    ends = pairs.select(F.col("a").alias("u"), "n").unionByName(pairs.select(F.col("b").alias("u"), "n")).groupBy("u").agg(F.sum("n").alias("total"))
    chosen = pairs.where(F.col("n") > min_count)
    both = chosen.select(F.col("a").alias("u"), F.col("b").alias("v"), "n").unionByName(chosen.select(F.col("b").alias("u"), F.col("a").alias("v"), "n"))
    return both.join(ends, "u").select("u", "v", (F.col("n") / F.col("total")).alias("w")).where(F.col("w") >= min_weight)


def cooccurrence(docs: DataFrame, tags: str = "tags", window: int = WINDOW, min_count: int = 0, min_weight: float = 0.0, mode: str = "reference") -> DataFrame:
    """Weighted co-occurrence edges u, v, w of tag lists."""
    return pair_weights(pair_counts(docs, tags, window, mode), min_count, min_weight)


def tag_vocabulary(tf: DataFrame, total: int, min_df: int = 2, min_idf: float = 2.0) -> DataFrame:
    """term of more than one character, not all digits, that over ``min_df`` documents hold and few enough of them."""
    df = tf.groupBy("term").agg(F.count_distinct("doc_id").alias("df"))
    return df.where((F.col("df") > min_df) & (F.log(F.lit(float(total)) / F.col("df")) > min_idf) & (F.length("term") > 1) & ~F.col("term").rlike("^[0-9]+$")).select("term")


def segment_pairs(segments: DataFrame, mode: str = "reference") -> DataFrame:
    """a, b and n of tags of each segment with those of up to three earlier ones of its file.

    ``segments`` has file, i (order over all files) and tags (sorted).  In the mode 'reference' the partners of segment
    i > 0 are the oldest one still held, i - 1 and i - 2; the oldest is 5 * max(0, (i - 6) div 5), and if it is of
    another file the segment counts nothing.  Otherwise they are itself, i - 1 and i - 2.
    """
    held = segments.select("file", "i", "tags")
    other = held.select(F.col("file").alias("ofile"), F.col("i").alias("j"), F.col("tags").alias("otags"))
    oldest = F.lit(5) * F.greatest(F.lit(0), F.floor((F.col("i") - 6) / 5)).cast("long")
    if mode == "reference":
        wanted = held.where("i > 0").select("*", oldest.alias("first"), F.explode(F.expr("filter(array(struct(0 as k, 5 * greatest(0L, floor((i - 6) / 5)) as j), struct(1 as k, i - 1 as j), struct(2 as k, i - 2 as j)), x -> x.k < i)")).alias("x"))
        anchor = other.select(F.col("j").alias("first"), F.col("ofile").alias("afile"))
        joined = wanted.join(anchor, "first").where("afile = file").withColumn("j", F.col("x.j")).join(other, "j")
        # a partner of another file ends the row of partners
        joined = joined.where("ofile = file")
    else:
        wanted = held.select("*", F.explode(F.array(F.col("i"), F.col("i") - 1, F.col("i") - 2)).alias("j"))
        joined = wanted.join(other, "j").where("ofile = file")
    make = _fold if mode == "reference" else _symmetric
    pairs = joined.select(F.explode(F.flatten(F.transform("tags", lambda t: make(t, F.col("otags"))))).alias("p"))
    return pairs.groupBy("p").agg(F.count("*").alias("n")).select("p.a", "p.b", "n")


def segment_edges(pairs: DataFrame, least: int = 100, min_weight: float = 0.2) -> DataFrame:
    """u, v, w of pairs that occur ``least`` times, and of the first one below in order of count; weights as shares."""
    ends = pairs.select(F.col("a").alias("u"), "n").unionByName(pairs.select(F.col("b").alias("u"), "n")).groupBy("u").agg(F.sum("n").alias("total"))
    below = pairs.where(F.col("n") < least).orderBy(F.col("n").desc(), "a", "b").limit(1)
    chosen = pairs.where(F.col("n") >= least).unionByName(below)
    both = chosen.select(F.col("a").alias("u"), F.col("b").alias("v"), "n").unionByName(chosen.select(F.col("b").alias("u"), F.col("a").alias("v"), "n"))
    return both.join(ends, "u").select("u", "v", (F.col("n") / F.col("total")).alias("w")).where(F.col("w") >= min_weight)


def link_edges(nodes: DataFrame, mentions: DataFrame, triples: DataFrame, barred: str = "[歌影]") -> DataFrame:
    """tp, u, v, w from mentions (m, e, pos) and triples (s, p, o) whose objects hold links.

    A node's first entity, unless its name is barred, links it to every node that its triples link to: KG there and
    KGi back, with weight 0.5 + 0.5 / number of its entities.
    """
    several = mentions.groupBy("m").agg(F.count("*").alias("k"), F.min_by("e", "pos").alias("e")).where(~F.col("e").rlike(barred))
    linked = several.join(nodes.select(F.col("node").alias("m")), "m", "left_semi").join(triples.select(F.col("s").alias("e"), "o"), "e")
    targets = linked.select("m", "k", F.explode(anchors("o")).alias("t")).where("t <> m").join(nodes.select(F.col("node").alias("t")), "t", "left_semi")
    w = F.lit(0.5) + F.lit(0.5) / F.col("k")
    return targets.select(F.lit("KG").alias("tp"), F.col("m").alias("u"), F.col("t").alias("v"), w.alias("w")).unionByName(targets.select(F.lit("KGi").alias("tp"), F.col("t").alias("u"), F.col("m").alias("v"), w.alias("w")))


def mention_edges(nodes: DataFrame, mentions: DataFrame, barred: str = "[歌影]") -> DataFrame:
    """KGm edges of weight 1 between nodes whose first entity is the same, each way."""
    first = mentions.groupBy("m").agg(F.min_by("e", "pos").alias("e")).where(~F.col("e").rlike(barred)).join(nodes.select(F.col("node").alias("m")), "m", "left_semi")
    other = first.select("e", F.col("m").alias("v"))
    return first.join(other, "e").where("m <> v").select(F.lit("KGm").alias("tp"), F.col("m").alias("u"), "v", F.lit(1.0).alias("w"))


# -- isA


def suffixes(words: DataFrame, valid: DataFrame, tokens: str = "tokens", glue: str = "") -> DataFrame:
    """word, class: the endings of a word's tokens (all of it included) that are valid."""
    ends = F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.array_join(F.slice(tokens, i, F.size(tokens)), glue))
    made = words.where(F.size(tokens) > 0).select("word", F.explode(ends).alias("class"))
    return made.join(valid.select(F.col("word").alias("class")).distinct(), "class", "left_semi").select("word", "class")


def token_ngrams(words: DataFrame, valid: DataFrame, tokens: str = "tokens", glue: str = "") -> DataFrame:
    """word, class: all runs of a word's tokens that are valid."""
    n = F.size(tokens)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(tokens, i, k), glue))))
    made = words.where(n > 0).select("word", F.explode(runs).alias("class"))
    return made.join(valid.select(F.col("word").alias("class")).distinct(), "class", "left_semi").select("word", "class")


def soft_valid(candidates: DataFrame, pos: DataFrame) -> DataFrame:
    """Candidates (class, tokens) that look like names of classes by the parts of speech (token, tag) of their tokens.

    Two characters at least; the last token a noun or verb, the first no verb; no token but the last of one character.
    """
    numbered_ = candidates.select("class", "tokens", F.element_at("tokens", 1).alias("first"), F.element_at("tokens", -1).alias("last"))
    named = numbered_.join(pos.select(F.col("token").alias("first"), F.col("tag").alias("ftag")), "first").join(pos.select(F.col("token").alias("last"), F.col("tag").alias("ltag")), "last")
    long_ = F.forall(F.expr("slice(tokens, 1, size(tokens) - 1)"), lambda t: F.length(t) >= 2)
    return named.where((F.length("class") >= 2) & F.col("ltag").rlike("^[nv]") & ~F.col("ftag").startswith("v") & long_).select("class", "tokens")


def soft_classes(words: DataFrame, pos: DataFrame, tokens: str = "tokens", glue: str = "") -> DataFrame:
    """word, class with soft validity; classes that are found become words themselves until nothing is new."""
    known = settle(words.select("word", F.col(tokens).alias("tokens")))
    todo, out = known, None
    while True:  # classes are endings of words, so they get shorter and come to an end
        ends = F.transform(F.sequence(F.lit(1), F.size("tokens")), lambda i: F.slice("tokens", i, F.size("tokens")))
        made = todo.where(F.size("tokens") > 0).select("word", F.explode(ends).alias("tokens")).withColumn("class", F.array_join("tokens", glue))
        valid = soft_valid(made.select("class", "tokens").distinct(), pos)
        found = settle(made.join(valid.select("class").distinct(), "class", "left_semi").select("word", "class", "tokens").distinct())
        out = found if out is None else out.unionByName(found)
        todo = settle(found.select(F.col("class").alias("word"), "tokens").distinct().join(known.select("word"), "word", "left_anti"))
        if not todo.limit(1).count():
            break
        known = known.unionByName(todo)
    return out.select("word", "class").distinct()


def classes(pairs: DataFrame, least: int = 0) -> DataFrame:
    """class and its words, for classes with ``least`` words at least."""
    return pairs.groupBy("class").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("word")).alias("words")).where(F.col("n") >= least)


def triples(pairs: DataFrame) -> DataFrame:
    """Different (s, isA, o), no word being its own class."""
    return pairs.where("word <> class").select(F.col("word").alias("s"), F.lit("isA").alias("p"), F.col("class").alias("o")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges (a, b): the smallest node of its component.

    Minimum labels travel along edges and then to the label's own label, so that chains shorten by half in each round.
    """
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    while True:
        theirs = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        near = labels.join(theirs, "node").select("node", F.least("root", "near").alias("root"))
        jump = near.join(labels.select(F.col("node").alias("root"), F.col("root").alias("far")), "root").select("node", F.least("root", "far").alias("root"))
        after = settle(jump)
        moved = after.join(labels.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count()
        discard(labels)
        labels = after
        if not moved:
            break
    return labels


def seeded_classes(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """class and ``seeded``: whether the class or one of its words is in a component (class - word) with a seed word."""
    edges = pairs.where("word <> class").select(F.col("class").alias("a"), F.col("word").alias("b"))
    roots = connected(edges)
    with_seed = roots.join(seeds.select(F.col("word").alias("node")).distinct(), "node", "left_semi").select("root").distinct().withColumn("hit", F.lit(True))
    flagged = roots.join(with_seed, "root", "left").select("node", F.coalesce("hit", F.lit(False)).alias("hit"))
    members = pairs.select("class", F.explode(F.array("class", "word")).alias("node")).distinct()
    alone = seeds.select(F.col("word").alias("node"), F.lit(True).alias("own")).distinct()
    rated = members.join(flagged, "node", "left").join(alone, "node", "left").select("class", (F.coalesce("hit", F.lit(False)) | F.coalesce("own", F.lit(False))).alias("hit"))
    return rated.groupBy("class").agg(F.bool_or("hit").alias("seeded"))


def closure(edges: DataFrame) -> DataFrame:
    """Different (ancestor, descendant, depth) of a taxonomy (parent, child), depth the fewest steps."""
    step = settle(edges.select("parent", "child").distinct())
    known = settle(step.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).cast("long").alias("depth")))
    front = known
    for depth in count(2):  # ends, since each pair is new once
        reached = front.join(step, F.col("descendant") == F.col("parent")).select("ancestor", F.col("child").alias("descendant")).distinct()
        front = settle(reached.join(known.select("ancestor", "descendant"), ["ancestor", "descendant"], "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if not front.limit(1).count():
            break
        known = settle(known.unionByName(front))
    return known


def with_order(segments: DataFrame, order: list) -> DataFrame:
    """Segments with ``i``, their number over all files from 0."""
    return numbered(segments, order, "_n").withColumn("i", (F.col("_n") - 1).cast("long")).drop("_n")
