"""Toxicity: a linear classifier trained with a counterfactual penalty.

Features are the words of a whole text and their six-character beginnings (of group terms the words only), present or not. From at most MAX_LABELLED
training rows the FEATURES strongest by penalised log-odds are kept, and logistic regression is fitted to them on the driver. Each
training sentence that names a group (IDENTITY) is also taken with every other term of its lists swapped in, and without the term, and the squared
change of the linear score (before the logistic function) is penalised; so the weights of neutral mentions of groups are pulled together and what tells toxic texts apart must
lie in the other words. Scoring is one narrow pass over all texts.

Edge cases: a null text counts as empty and is scored by the bias; null labels are not learned from; with no labels, or
one class only, every score is the smoothed share of toxic rows; of documents that share a labelled doc_id that with the smallest hashed text is learned from; a null doc_id counts as the empty string for the
held-out rule; repeated rows get equal scores; clashing columns are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselum.llm.common import cut, ship, table

#: Labelled rows that are learned from, at most; those with the smallest hashed doc_id.
MAX_LABELLED = 20_000
#: Features of the model, at most: those of the strongest log-odds.
FEATURES = 4096
PREFIX = 6
#: Log-odds of a feature over their standard error, at least.
MIN_STRENGTH = 2.5
THRESHOLD = 0.7
#: Of squared score changes under swaps, beside a mean log loss.
PENALTY = 1.0
#: Terms that may stand in each other's place, by language and axis.
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("old", "young", "elderly", "disabled", "deaf", "blind"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
)
_TERMS = frozenset(t for g in IDENTITY for t in g)
#: What may stand in a term's place, of all lists that have it.
_OTHERS = {t: sorted({x for g in IDENTITY if t in g for x in g} - {t}) for t in _TERMS}
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def features(text: str) -> set[str]:
    """The words of a text, and "beginning~" of the longer ones that don't name a group: a swap changes the words only."""
    found = set(_WORD.findall(text.lower()))
    return found | {f"{w[:PREFIX]}~" for w in found - _TERMS if len(w) > PREFIX}


def swaps(text: str) -> Counter:
    """(term, other) of each sentence of the text that names term, with other of one of its lists in its place."""
    out: Counter = Counter()
    for sentence in _SENTENCE.split(text.lower()):
        for term in set(_WORD.findall(sentence)) & _OTHERS.keys():
            out.update((term, other) for other in _OTHERS[term])
    return out


@dataclass
class Model:
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str) -> float:
        z = self.bias + sum(map(self.weights.__getitem__, self.weights.keys() & features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def train(rows: list[list[int]], toxic: np.ndarray, n: int, pairs: dict[tuple[int, int], float], *, penalty: float = PENALTY, ridge: float = 1e-4, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights of n features. rows: the features of each row; pairs: how often a feature is swapped for another.

    Minimises the mean log loss (toxic rows weigh as much as the others where they are fewer) plus
    ridge * |w|^2 plus penalty * (w_a - w_b)^2 for each pair that is swapped, the squared change of a sentence's score, and
    penalty * w_a^2 for each term of the pairs, that of the sentence without it. A pair's share doesn't depend on how many others there are.
    """
    lengths = np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), lengths)
    col = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(row) else np.zeros(0, np.int64)
    share = max(1, toxic.sum()) / len(toxic)
    weight = np.where(toxic > 0, max(1.0, (1 - share) / share), 1.0)
    weight /= weight.sum()
    # either direction of a swap changes the score alike
    both = sorted({(min(p), max(p)) for p in pairs})
    a, b = (np.array([p[i] for p in both], np.int64) for i in (0, 1))
    terms = np.unique(np.append(a, b))
    w, bias, m, v = np.zeros(n), float(np.log(share / max(1e-6, 1 - share))), np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        z = bias + np.bincount(row, w[col], len(rows))
        e = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - toxic)
        g = np.bincount(col, e[row], n) + 2 * ridge * w
        if len(a):
            d = 2 * penalty * (w[a] - w[b])
            g += np.bincount(a, d, n) - np.bincount(b, d, n)
            g[terms] += 2 * penalty * w[terms]
        g = np.append(g, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return float(bias), w


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def fit(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, n_features: int = FEATURES, **how) -> Model:
    """Learn from labels (doc_id, toxic) of docs (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))  # a row per label, however many documents share its id
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(one.alias("one"))
    sample = cut(sample.select(F.col("one.text").alias("text"), F.col("toxic").cast("int").alias("toxic")))
    counted = dict(sample.groupBy("toxic").count().collect())
    n_toxic, n_clean = counted.get(1, 0), sum(counted.values()) - counted.get(1, 0)
    prior = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    if not n_toxic or not n_clean:
        return Model(float(np.log(prior / (1 - prior))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for t, y in zip(_texts(b, "text"), b.column(b.schema.get_field_index("toxic")).to_pylist(), strict=True):
                by[y == 1].update(features(t))
            if len(by[0]) + len(by[1]) > 500_000:
                yield emit(by)
                by = (Counter(), Counter())
        yield emit(by)

    def emit(by) -> pa.RecordBatch:
        names = list(by[0].keys() | by[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([by[1][k] for k in names], pa.int64()), pa.array([by[0][k] for k in names], pa.int64())], ["feature", "a", "b"])

    a, b = F.col("a"), F.col("b")
    odds = F.log((a + 0.5) / (n_toxic + 1)) - F.log((b + 0.5) / (n_clean + 1))
    # log-odds over their standard error
    strength = F.abs(odds) / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    counts = sample.mapInArrow(count, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where((a + b >= 3) & (strength >= MIN_STRENGTH))
    names = [r[0] for r in counts.orderBy(strength.desc(), "feature").limit(n_features).select("feature").collect()]
    names = list(dict.fromkeys([*names, *(t for g in IDENTITY for t in g)]))
    at = {k: i for i, k in enumerate(names)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b, "text")
            swapped = [[[at[x], at[y], n] for (x, y), n in swaps(t).items()] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([sorted(at[k] for k in at.keys() & features(t)) for t in texts], pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.list_(pa.int32()))), b.column(b.schema.get_field_index("toxic"))], ["x", "swaps", "toxic"]
            )

    rows = sample.mapInArrow(vectors, "x array<int>, swaps array<array<int>>, toxic int").collect()
    pairs: Counter = Counter()
    for r in rows:
        for x, y, n in r["swaps"]:
            pairs[x, y] += n
    rows.sort(key=lambda r: (r["toxic"], r["x"]))  # sums of floats follow the order
    bias, w = train([r["x"] for r in rows], np.array([r["toxic"] == 1 for r in rows], float), len(names), pairs, **how)
    return Model(bias, {k: float(w[i]) for k, i in at.items() if abs(w[i]) > 1e-9})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the column score: 0 to 1, higher for likelier toxic texts."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c.lower() != "score"]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([model.score(t) for t in _texts(b, "text")], pa.float64())], [*b.schema.names, "score"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", score double")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return score(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
