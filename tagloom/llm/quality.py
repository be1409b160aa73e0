"""Weakly supervised quality rules.

Each rule votes good or bad or abstains.  Expectation-maximisation over the counts of vote patterns estimates how
often each rule votes rightly on good and on bad texts; the posterior probability of good then replaces the demand
that all rules pass.  Texts stay in the JVM: only DataFrame expressions touch them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import materialize

#: Blanks between words, and the characters that count as symbols.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 3
#: Rounds of estimation; it ends before if no figure moves by more than TOLERANCE.
ROUNDS = 50
TOLERANCE = 1e-6


@dataclass(frozen=True)
class Rule:
    """A vote: ``bad`` and ``good`` are SQL conditions on the measures; abstains where neither holds."""

    name: str
    bad: str
    good: str


#: Production rules on the measures of :func:`measure`.  Where the lack of a defect says little, a rule abstains.
RULES = (
    Rule("length", "n_words < 50", "false"),
    Rule("word_size", "n_words > 0 and (word_chars < 2.5 * n_words or word_chars > 12 * n_words)", "word_chars between 3 * n_words and 10 * n_words and n_words > 0"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words and n_words > 0"),
    Rule("symbol_share", "100 * n_symbols > 3 * word_chars", "200 * n_symbols <= word_chars and n_words > 0"),
    Rule("lines", "n_lines > 2 and 10 * n_dup_lines > 3 * n_lines", "false"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", "false"),
)


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every row, as longs.

    Null and empty texts measure 0 throughout.  n_repeat_words counts words in windows of three that occur at least
    twice in the text: windows are sorted by hash with their places, neighbours of equal hash found, and the words
    they cover added up without counting any twice.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    split = docs.select(*(F.col(f"`{c}`") for c in keep), body.alias("_t"), F.filter(F.split(body, BLANKS), lambda w: w != "").alias("_w"))
    hashed = F.expr(f"""transform(slice(_w, 1, greatest(size(_w) - {WINDOW - 1}, 0)), (w, i) -> struct(xxhash64(w, _w[i + 1], _w[i + 2]) as h, i as i))""")
    lines = F.filter(F.split("_t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    # repeats are looked for only where a window hash occurs twice
    wide = split.select(*keep, "_t", "_w", F.sort_array(hashed).alias("_s"), lines.alias("_l"))
    twice = F.expr("sort_array(transform(filter(_s, (x, i) -> (i > 0 and _s[i - 1].h = x.h) or (i < size(_s) - 1 and _s[i + 1].h = x.h)), x -> x.i))")
    covered = F.expr(f"aggregate(_p, struct(0L as n, {-WINDOW} as last), (a, p) -> struct(a.n + least({WINDOW}, p - a.last) as n, p as last), a -> a.n)")
    out = wide.select(*keep, "_t", "_w", "_l", twice.alias("_p"))
    return out.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.expr("aggregate(_w, 0L, (a, w) -> a + length(w))").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def vote(rule: Rule) -> Column:
    """1 for good, 0 for bad, -1 where the rule abstains."""
    return F.when(F.expr(rule.bad), 0).when(F.expr(rule.good), 1).otherwise(-1)


@dataclass
class Estimate:
    """prior: share of good texts; good, bad: for each rule the chance that it votes good, on good and on bad texts."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = ROUNDS) -> Estimate:
    """Expectation-maximisation over (votes, count) patterns.

    Rules start as right in eight of ten votes, and as many votes are added to the counts, so that they keep their
    sense.  Without patterns the start is returned.
    """
    start, weight = 0.8, 10.0
    now = Estimate(0.7, (start,) * rules, (1 - start,) * rules)
    for _ in range(rounds if patterns else 0):
        total = mass = 0.0
        hits = [[[0.0, 0.0] for _ in range(rules)] for _ in range(2)]
        for votes, n in patterns:
            p = posterior(now, votes)
            total, mass = total + n, mass + n * p
            for r, v in enumerate(votes):
                if v >= 0:
                    for k, share in ((0, p), (1, 1 - p)):
                        hits[k][r][0] += n * share * v
                        hits[k][r][1] += n * share
        scale = max(weight, total / 20)
        rate = lambda k, r, a: (hits[k][r][0] + scale * a) / (hits[k][r][1] + scale)
        after = Estimate((mass + weight * 0.7) / (total + weight), tuple(rate(0, r, start) for r in range(rules)), tuple(rate(1, r, 1 - start) for r in range(rules)))
        moved = max(abs(a - b) for a, b in zip((now.prior, *now.good, *now.bad), (after.prior, *after.good, *after.bad), strict=True))
        now = after
        if moved < TOLERANCE:
            break
    return now


def posterior(e: Estimate, votes: tuple[int, ...]) -> float:
    odds = math.log(e.prior / (1 - e.prior)) + sum(math.log(g / b) if v else math.log((1 - g) / (1 - b)) for g, b, v in zip(e.good, e.bad, votes, strict=True) if v >= 0)
    return 1 / (1 + math.exp(-odds))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the measures and ``p_good``, the posterior probability that the text is good, of every row.

    Texts are read once; their measures are kept in the shared folder.  There are at most 3 ** len(rules) vote patterns,
    whatever the input, and only their counts come to the driver.  Repeated rows stay and count as often as they
    occur; an empty table gives an empty one; other columns are left out.
    """
    measured = materialize(measure(docs, text, keep))
    names = [f"_v{i}" for i in range(len(rules))]
    counted = measured.select(*(vote(r).alias(n) for r, n in zip(rules, names, strict=True))).groupBy(*names).count().collect()
    e = estimate(sorted((tuple(r[:-1]), r[-1]) for r in counted), len(rules))
    odds = F.lit(math.log(e.prior / (1 - e.prior)))
    for r, g, b in zip(rules, e.good, e.bad, strict=True):
        odds = odds + F.when(vote(r) == 1, math.log(g / b)).when(vote(r) == 0, math.log((1 - g) / (1 - b))).otherwise(0.0)
    return measured.withColumn("p_good", 1 / (1 + F.exp(-odds)))
