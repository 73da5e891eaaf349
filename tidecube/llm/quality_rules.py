"""Quality rules: an ordered decision list of threshold conjunctions, learned from labelled text statistics.

Everything is DataFrame work: the statistics are built-in functions on the text column, and learning reads only
histograms (feature, bin, label) that Spark counts; the driver sees a few hundred counts a step, however many rows
are labelled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecube.llm.common import SPACES, WORD, written

WINDOW = 8
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Statistics that rules may test, each a ratio or size of one text.
FEATURES = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "upper_ratio", "digit_ratio", "bang_ratio")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once a row, wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), body), 0)


def window_hashes(hashes: Column) -> Column:
    """One hash for each window of WINDOW words, from the hashes of the words."""
    at = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
    return F.when(F.size(hashes) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), at)).otherwise(F.array().cast("array<bigint>"))


def placed(windows: Column) -> Column:
    """Windows with their places, equal ones side by side."""
    return F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def repeated_starts(s: Column) -> Column:
    """Places of windows that are found twice or more, ascending; s: placed windows."""
    equal = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    marked = F.transform(s, lambda x, j: F.when(F.when(j > 0, equal(x, j - 1)).otherwise(False) | equal(x, j + 1), x["i"]))
    return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))


def covered(starts: Column) -> Column:
    """Words under windows of WINDOW words that begin at ascending starts."""
    new = F.transform(starts, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - x, F.lit(WINDOW))))
    return F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a window found twice or more, the first finding included. Most texts repeat no window; only
    the others sort their windows."""
    sorted_out = lambda g: let(placed(g), lambda s: let(repeated_starts(s), covered))
    return let(window_hashes(hashes), lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), sorted_out(g)).otherwise(F.lit(0).cast("long")))


def text_statistics(docs: DataFrame, also: list[str] = []) -> DataFrame:
    """doc_id, the columns `also` and the statistics of every text (null: no words)."""
    text = F.coalesce("text", F.lit(""))
    count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    words = F.transform(F.filter(F.split(text, SPACES), lambda w: w != ""), lambda w: F.xxhash64(w))
    of_words = let(
        words,
        lambda h: F.struct(F.size(h).cast("long").alias("n_words"), F.size(F.array_distinct(h)).alias("n_distinct"), repeated_words(h).alias("n_repeat_words")),
    )
    dup_lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    rows = docs.select(
        "doc_id",
        *also,
        of_words.alias("of_words"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        count(SYMBOLS).cast("long").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        count("0123456789").alias("n_digits"),
        count("!").alias("n_bang"),
    )
    return rows.select("doc_id", *also, "of_words.*", "word_chars", "n_symbols", "n_dup_lines", "n_upper", "n_digits", "n_bang")


def with_ratios(rows: DataFrame, also: list[str] = []) -> DataFrame:
    """text_statistics with the ratios of FEATURES."""
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return rows.select(
        "doc_id", *also, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        over("word_chars", "n_words").alias("mean_word"),
        over("n_symbols", "n_words").alias("symbol_ratio"),
        over("n_dup_lines", "n_words").alias("dup_line_ratio"),
        over("n_repeat_words", "n_words").alias("repeat_ratio"),
        over("n_distinct", "n_words").alias("distinct_ratio"),
        over("n_upper", "word_chars").alias("upper_ratio"),
        over("n_digits", "word_chars").alias("digit_ratio"),
        over("n_bang", "n_words").alias("bang_ratio"),
    )


@dataclass
class Rule:
    """A conjunction of (feature, op, threshold); rejects what satisfies all of them."""

    conditions: list[tuple[str, str, float]] = field(default_factory=list)

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, at in self.conditions:
            out = out & (F.col(name) > at if op == ">" else F.col(name) <= at)
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{n} {o} {a:.6g}" for n, o, a in self.conditions)


def as_column(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: the first rule that fires rejects, else keep. True: kept."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule.column(), F.lit(False)).otherwise(out)
    return out


def learn_rules(
    labelled: DataFrame,
    features: tuple[str, ...] = FEATURES,
    bins: int = 32,
    max_rules: int = 8,
    max_conditions: int = 4,
    min_precision: float = 0.95,
    min_covered: int = 5,
) -> list[Rule]:
    """Sequential covering over labelled(doc_id, the features, bad 0/1).

    Two thirds of the rows grow rules, one third prunes them; which, follows a hash of doc_id. A rule grows by the
    condition with the best information gain among thresholds halfway between quantiles of every feature, until it covers no
    good row, gains nothing or has max_conditions. Of its beginnings that cover min_covered rows, min_precision of them
    bad, on the growing and the pruning rows together, the one with the best (p - n) / (p + n) on the pruning rows is
    taken, the shortest of equals; covered rows leave, and the next rule is grown. Rows with a null label are ignored.
    Without bad or without good rows there is nothing to learn and the list is empty.
    """
    rows = labelled.where("bad is not null").select("doc_id", "bad", *features)
    cuts = rows.select(*[F.percentile_approx(F.col(f).cast("double"), [i / bins for i in range(bins + 1)], 10000).alias(f) for f in features]).first()
    cuts = {f: sorted(set(cuts[f] or [])) for f in features}
    cuts = {f: [(a + b) / 2 for a, b in zip(c, c[1:])] for f, c in cuts.items()}
    #: bin of a value: thresholds below it, so that value > cuts[k] is bin > k
    bin_of = lambda f: F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts[f]]), lambda c: F.col(f) > c)) if cuts[f] else F.lit(0)
    rows = rows.select(
        F.when(F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2, "grow").otherwise("prune").alias("part"),
        F.col("bad").cast("int").alias("bad"),
        *[bin_of(f).cast("int").alias(f) for f in features],
    )
    #: equal rows are one row with a weight
    rows = written(rows.groupBy("part", "bad", *features).agg(F.count("*").alias("n")), "labelled")
    as_bins = lambda r: Rule([(f, o, cuts[f].index(a)) for f, o, a in r.conditions])

    def histogram(where: Column) -> dict:
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in features]))
        found: dict = {f: {} for f in features}
        for r in rows.where(where & (F.col("part") == "grow")).select("bad", "n", pairs.alias("x")).groupBy("x.f", "x.b", "bad").agg(F.sum("n").alias("n")).collect():
            found[r["f"]].setdefault(r["b"], [0, 0])[r["bad"]] += r["n"]
        return found

    def counts(where: Column) -> dict:
        got = {("grow", 0): 0, ("grow", 1): 0, ("prune", 0): 0, ("prune", 1): 0}
        for r in rows.where(where).groupBy("part", "bad").agg(F.sum("n").alias("n")).collect():
            got[r["part"], r["bad"]] = r["n"]
        return got

    def best(hist: dict) -> tuple[float, tuple | None, int, int]:
        out = (0.0, None, 0, 0)
        for f in features:
            total = [sum(v[k] for v in hist[f].values()) for k in (0, 1)]
            if not total[1]:
                continue
            base, low = math.log2(total[1] / sum(total)), [0, 0]
            for k, at in enumerate(cuts[f]):
                low = [low[j] + hist[f].get(k, [0, 0])[j] for j in (0, 1)]
                for op, (n, p) in (("<=", low), (">", [total[0] - low[0], total[1] - low[1]])):
                    if 2 * p >= min_covered and n + p < sum(total):
                        gain = p * (math.log2((p + 0.5) / (p + n + 1.0)) - base)
                        if gain > out[0] + 1e-9:
                            out = (gain, (f, op, at), n, p)
        return out

    taken: list[Rule] = []
    left = F.lit(True)
    for _ in range(max_rules):
        rule = Rule()
        for _ in range(max_conditions):
            gain, condition, n, _p = best(histogram(left & as_bins(rule).column()))
            if condition is None:
                break
            rule.conditions.append(condition)
            if n == 0:
                break
        if not rule.conditions:
            break
        worth = []
        for k in range(1, len(rule.conditions) + 1):
            c = counts(left & as_bins(Rule(rule.conditions[:k])).column())
            p, n = c["prune", 1], c["prune", 0]
            bad, good = c["grow", 1] + p, c["grow", 0] + n
            if bad + good >= min_covered and bad >= min_precision * (bad + good):
                worth.append(((p - n) / (p + n) if p + n else -1.0, -k))
        if not worth:
            break
        rule = Rule(rule.conditions[: -max(worth)[1]])
        taken.append(rule)
        left = left & ~as_bins(rule).column()
    return taken


def judge_quality(docs: DataFrame, labels: DataFrame, also: list[str] = []) -> tuple[DataFrame, list[Rule]]:
    """Statistics, base_failed and kept for every row of docs(doc_id, text), and the learned decision list.

    labels(doc_id, quality): quality 0 is bad, 1 good; null is no label. base_failed: under 20 words, or over 30 % of
    words in repeated windows. kept: not base_failed, and no rule rejects it. Null and empty texts have no words and
    fail; a doc_id that is there several times is judged row by row; extra columns but `also` are dropped; an empty table gives an
    empty result. All labelled rows that pass the base limits take part in learning, as counts.
    """
    stats = with_ratios(written(text_statistics(docs, also), "statistics"), also)
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rules = learn_rules(stats.where(~failed).join(known, "doc_id").withColumn("bad", (F.col("quality") == 0).cast("int")))
    out = stats.withColumn("base_failed", failed).withColumn("kept", ~failed & as_column(rules))
    return out, rules
