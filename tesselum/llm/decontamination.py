"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

A test item is found in a document that holds at least THRESHOLD of its distinct shingles of five words. A banded MinHash of whole
documents can't see an item of thirty shingles in a text of twenty thousand (their Jaccard similarity is 0.0015), so
the sketch is one-sided: items are partitioned by size, and the items of a class, of at most u shingles, are sketched by
their floor((1 - THRESHOLD) * u) + 1 least shingles: those that the fewest items have, then those of the smallest hashes. A document that lacks
all of an item's sketch lacks more than the item may lack, whichever shingles the sketch takes, so looking the documents' shingle hashes up in
the sketches misses nothing, whatever the lengths; and a shingle that many items share, such as a stock opening of questions, is in few
sketches, so that a document with it meets few items. What is found is verified on the words themselves.

The sketches are broadcast while they take at most BROADCAST bytes, else joined by shuffle; so are the verified pairs and items. Texts are
compared in lower case, as runs of letters and digits. Only DataFrame functions run on the executors.

Edge cases: null and empty items match nothing, as do null and empty documents; an item of fewer than five words is one shingle, of
all its words, sought among the documents' runs of as many; equal items all match; repeated documents all match; without documents
or items there are no rows; other columns, clashing or not, pass through `clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselum.llm.common import bind, cut, fresh, join_split, once, table

SHINGLE, THRESHOLD = 5, 0.8
#: Bytes that are broadcast at once, at most.
BROADCAST = 32 << 20
#: Bytes that a row of hashes and ids takes beside what strings it has.
ROW = 64


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _runs(w: Column, k: int | Column, make) -> Column:
    """make(start) of each run of k words; none where there are fewer."""
    at = F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))
    return F.when(F.size(w) >= k, F.transform(at, make))


def _hashes(w: Column, k: int) -> Column:
    return F.coalesce(_runs(w, k, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])), F.array().cast("array<bigint>"))


def _shingles(w: Column, k: int | Column) -> Column:
    return F.coalesce(F.array_distinct(_runs(w, k, lambda i: F.array_join(F.slice(w, i + 1, k), " "))), F.array().cast("array<string>"))


def _fits(df: DataFrame, *strings: str) -> bool:
    """Whether df may be broadcast: its rows and the bytes of its strings, and arrays of strings, are counted."""
    size = F.lit(ROW)
    for c in strings:
        kind = dict(df.dtypes)[c]
        size = size + F.coalesce(F.aggregate(c, F.lit(0), lambda a, x: a + F.octet_length(x) + 16) if kind.startswith("array") else F.octet_length(F.col(c).cast("string")), F.lit(0))
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST


def prepare(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, k, shingles, hashes): the distinct shingles of items with a word, and how many words each has."""
    k = lambda w: F.least(F.size(w), F.lit(SHINGLE))
    rows = items.select(F.col(item_id).alias("item"), once(words(F.col(text))).alias("w")).where(F.size("w") > 0)
    rows = rows.select("item", k(F.col("w")).alias("k"), once(_shingles(F.col("w"), k(F.col("w")))).alias("shingles"))
    # of a shingle's words, as documents hash theirs
    parts = F.transform("shingles", lambda s: bind(F.split(s, " "), lambda w: F.xxhash64(*[F.get(w, F.lit(j)) for j in range(SHINGLE)])))
    short = F.transform("shingles", lambda s: bind(F.split(s, " "), _short_hash))
    return rows.withColumn("hashes", F.when(F.col("k") == SHINGLE, parts).otherwise(short))


def _short_hash(w: Column) -> Column:
    out = F.xxhash64(F.get(w, F.lit(0)))
    for k in range(2, SHINGLE):
        out = F.when(F.size(w) == k, F.xxhash64(*[F.get(w, F.lit(j)) for j in range(k)])).otherwise(out)
    return out


def sketches(prepared: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item, h): per size class [u/2, u) of items, the floor((1 - threshold) * u) + 1 least hashes of each, by how many items have them."""
    n = F.size("hashes")
    top = F.pow(F.lit(2), F.floor(F.log2(n.cast("double"))) + 1) - 1
    take = F.least(F.floor((1 - threshold) * top + 1e-9).cast("int") + 1, n)
    # equal items, and rows that share an id, are told apart by all their hashes
    rows = prepared.select("item", F.xxhash64("hashes").alias("set"), take.alias("take"), F.explode("hashes").alias("h")).distinct()
    rows = cut(rows)
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    ranked = join_split(rows, often, "h").select("item", "set", "take", F.struct(F.coalesce("often", F.lit(1)).alias("often"), "h").alias("s"))
    least = ranked.groupBy("item", "set", "take").agg(F.collect_list("s").alias("s"))  # an item's own shingles
    return least.select("item", F.explode(F.slice(F.array_sort("s"), F.lit(1), F.col("take"))).alias("s")).select("item", "s.h").distinct()


def search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text hash, item, containment): every document and item with containment of threshold or more.

    The text hash tells apart rows that share a doc_id.
    """
    prepared = cut(prepare(items, item_id, item_text))
    lengths = sorted(r[0] for r in prepared.select("k").distinct().collect()) or [SHINGLE]  # 1 to 5
    sketch = cut(sketches(prepared, threshold))
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body"))
    hashes = bind(words(F.col("body")), lambda w: F.array_distinct(F.concat(*[_hashes(w, k) for k in lengths])))
    found = rows.select("doc", F.xxhash64("body").alias("mark"), F.explode(hashes).alias("h"))
    pairs = cut(found.join(F.broadcast(sketch) if _fits(sketch, "item") else sketch, "h").select("doc", "mark", "item").distinct())
    # verification: the candidates' texts meet their items; a text is moved only where the pairs are too many to broadcast
    pairs = pairs.toDF("d", "m", "item")
    sought = rows.withColumn("mark", F.xxhash64("body")).join(F.broadcast(pairs) if _fits(pairs, "d", "item") else pairs, F.col("doc").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
    wanted = prepared.select("item", "k", "shingles")
    both = sought.join(F.broadcast(wanted) if _fits(wanted, "item", "shingles") else wanted, "item")
    held = bind(words(F.col("body")), lambda w: F.size(F.array_intersect("shingles", _shingles(w, F.col("k")))))
    out = both.select("doc", "mark", "item", once(held / F.size("shingles")).alias("containment"))
    return out.where(F.col("containment") >= threshold).distinct()


def leaks(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """Per document that holds items: doc_id, n_items, item_ids (sorted) and the greatest containment."""
    found = search(docs, items, **how)
    return found.groupBy("doc").agg(F.count_distinct("item").alias("n_items"), F.sort_array(F.collect_set("item")).alias("item_ids"), F.max("containment").alias("max_containment")).withColumnRenamed("doc", "doc_id")


def clean(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without the rows that hold an item."""
    bad = cut(search(docs, items, doc_id=doc_id, text=text, **how).select("doc", "mark").distinct())
    one, its = fresh(docs, "_bad_doc", "_bad_mark")
    bad = bad.toDF(one, its)
    return docs.join(F.broadcast(bad) if _fits(bad, one) else bad, F.col(doc_id).eqNullSafe(F.col(one)) & (F.xxhash64(text) == F.col(its)), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "containment")


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE [] END"
#: Items of the tables have five words or more.
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest({_SHINGLES}) AS s FROM d), bs AS (SELECT item_id, unnest({_SHINGLES}) AS s FROM b),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS c FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, c / n AS containment FROM c JOIN n USING (item_id) WHERE c / n >= 0.8
"""
