"""Quality rules: a decision list, learned by sequential covering, that runs as one ordered Spark conditional.

Each rule is a conjunction of thresholds on document statistics and says "reject"; the first rule that fits
decides, and a document that fits none is kept. `learn` grows a rule condition by condition (FOIL gain) on two
thirds of the labelled rows, prunes its last conditions on the other third, keeps it only where it is precise there,
removes what it covers and goes on. `expression` turns the list into F.when(...).when(...).otherwise(keep). Which third a row belongs to
follows from its hashed doc_id, and nothing else depends on the rows' order, so the same rows give the same list however they are partitioned.

Statistics are built-in functions over the whole text. Edge cases: a null or empty text has no words and all
statistics 0, so it fails the base rules; with no labels, one class only or no precise rule the list is empty
and the base rules decide alone; repeated rows are judged alike; null labels are not learned from; extra columns pass through `judge` and
of a clashing name the input's column is replaced by the operator's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselum.llm.common import WHITE, bind, fresh, once, table, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "upper_ratio", "mark_ratio", "digit_ratio")
#: Labelled rows that a list is learned from, at most; those with the smallest hashed doc_id.
MAX_LABELLED = 20_000
#: Of the hash that deals labelled rows to growing and pruning.
SEED = 7


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.above else F.col(self.feature) < self.threshold

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        return data[self.feature] >= self.threshold if self.above else data[self.feature] < self.threshold


Rule = tuple[Condition, ...]


def _sum(col: Column) -> Column:
    return F.aggregate(col, F.lit(0).cast("long"), lambda a, x: a + x)


def _repeated(w: Column, h: Column) -> Column:
    """Words inside windows that occur twice or more: equal hashes meet by sorting, the words decide, then spans are summed."""
    order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def twin(p: Column, q: Column) -> Column:
        return (p["h"] == q["h"]) & (F.slice(w, p["i"] + 1, WINDOW) == F.slice(w, q["i"] + 1, WINDOW))

    def starts(order: Column) -> Column:
        n = F.size(order)
        hit = F.transform(
            order,
            lambda p, j: F.when(
                F.when(j > 0, twin(p, F.get(order, j - 1))).otherwise(False) | F.when(j < n - 1, twin(p, F.get(order, j + 1))).otherwise(False), p["i"]
            ),
        )
        return F.sort_array(F.array_compact(hit))

    def covered(at: Column) -> Column:
        return _sum(F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))).cast("long")))

    return bind(order, lambda o: bind(starts(o), covered))


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base statistics and the features of FEATURES."""
    def counts(t: Column, w: Column, h: Column, lines: Column) -> Column:
        # what goes when a class of characters is deleted
        without = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(t, WHITE, "")).cast("long").alias("word_chars"),
            without(SYMBOLS).cast("long").alias("n_symbols"),
            F.size(lines).alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_repeated(w, h)).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).alias("distinct"),
            F.regexp_count(t, F.lit("\\p{Lu}")).alias("upper"),
            without("!?").alias("marks"),
            without("0123456789").alias("digits"),
        )

    def hashes(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - WINDOW, F.lit(0)))
        return F.when(F.size(w) >= WINDOW, F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))

    def lines(t: Column) -> Column:
        return F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)

    whole = bind(F.coalesce(F.col(text), F.lit("")), lambda t: bind(words(t), lambda w: bind(hashes(w), lambda h: bind(lines(t), lambda x: counts(t, w, h, x)))))
    (s,) = fresh(df, "_s")
    df = df.withColumn(s, once(whole))
    df = df.withColumns({k: F.col(f"{s}.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")})
    per = lambda c, by: F.when(F.col(by) > 0, F.col(c) / F.col(by)).otherwise(0.0)
    return df.withColumns(
        {
            "mean_word": per("word_chars", "n_words"),
            "symbol_ratio": per("n_symbols", "n_words"),
            "dup_line_ratio": per("n_dup_lines", f"{s}.n_lines"),
            "repeat_ratio": per("n_repeat_words", "n_words"),
            "distinct_ratio": per(f"{s}.distinct", "n_words"),
            "upper_ratio": per(f"{s}.upper", "word_chars"),
            "mark_ratio": per(f"{s}.marks", "n_words"),
            "digit_ratio": per(f"{s}.digits", "word_chars"),
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    ).drop(s)


def _grow(data: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    on, rule = np.ones(len(bad), bool), []
    while len(rule) < most and (~bad[on]).any():
        pos, neg, best = bad[on].sum(), (~bad[on]).sum(), (1e-9, None)
        for name, x in data.items():
            order = np.argsort(x[on], kind="stable")
            v, b = x[on][order], bad[on][order]
            edge = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(edge):
                continue
            p_low = np.concatenate([[0], np.cumsum(b)])[edge]
            n_low = edge - p_low
            for above, p, n in ((False, p_low, n_low), (True, pos - p_low, neg - n_low)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / (p + n)) - np.log2(pos / (pos + neg))), -np.inf)
                if gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (float(gain[k]), Condition(name, above, float((v[edge[k]] + v[edge[k] - 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        on &= best[1].holds(data)
    return tuple(rule)


def _counts(rule: Rule, data: dict[str, np.ndarray], bad: np.ndarray) -> tuple[int, int]:
    on = np.ones(len(bad), bool)
    for c in rule:
        on &= c.holds(data)
    return int(bad[on].sum()), int((~bad[on]).sum())


def learn(data: dict[str, np.ndarray], bad: np.ndarray, grow: np.ndarray | None = None, *, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9, min_cover: int = 2) -> list[Rule]:
    """The ordered rejecting rules. data: a column per feature; bad: which rows are to be rejected; grow: which rows rules grow on, the others
    prune them (two of three in the rows' order, if not given).

    A rule stays if (p + 1) / (p + n + 2) on the pruning rows and p / (p + n) on all rows reach min_precision (the
    former less a tenth, as few rows meet it) and it covers min_cover bad pruning rows.
    """
    bad = bad.astype(bool)
    part = np.arange(len(bad)) % 3 < 2 if grow is None else grow
    left, out = np.ones(len(bad), bool), []
    while len(out) < max_rules:
        g, h = left & part, left & ~part
        if not bad[g].any() or not (~bad[g]).any():
            break
        pick = lambda m: ({k: v[m] for k, v in data.items()}, bad[m])
        rule = _grow(*pick(g), max_conditions)
        if not rule:
            break
        worth = []
        for k in range(len(rule), 0, -1):
            p, n = _counts(rule[:k], *pick(h))
            worth.append(((p - n) / (p + n) if p + n else -1.0, k))
        # the shortest of the best
        rule = rule[: min(k for value, k in worth if value == max(worth)[0])]
        p, n = _counts(rule, *pick(h))
        pa, na = _counts(rule, *pick(left))
        if p < min_cover or (p + 1) / (p + n + 2) < min_precision - 0.1 or pa / max(1, pa + na) < min_precision:
            break
        out.append(rule)
        on = np.ones(len(bad), bool)
        for c in rule:
            on &= c.holds(data)
        left &= ~on
    return out


def expression(rules: list[Rule]) -> Column:
    """True where the list keeps a document: the ordered conditional."""
    out = None
    for rule in rules:
        cond = rule[0].column()
        for c in rule[1:]:
            cond = cond & c.column()
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, **how) -> list[Rule]:
    """Learn a list from labels (doc_id, quality) of docs; at most max_labelled labels, chosen by hashed
    doc_id, are learned from; should documents share ids, twice as many rows at most reach the driver, as statistics, those of the smallest
    hashed doc_id and then of the smallest statistics."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_labelled rows at most
    order = F.xxhash64("doc_id")
    rows = statistics(joined).where(~F.col("base_failed")).select("quality", (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(3)) < 2).alias("_grow"), *FEATURES, order.alias("_order"))
    rows = rows.orderBy("_order", "quality", *FEATURES).limit(2 * max_labelled).collect()
    if not rows:
        return []
    data = {f: np.array([float(r[f]) for r in rows]) for f in FEATURES}
    return learn(data, np.array([r["quality"] == 0 for r in rows]), np.array([r["_grow"] for r in rows]), **how)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with their statistics, base_failed and kept."""
    return statistics(docs).withColumn("kept", ~F.col("base_failed") & expression(rules))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
