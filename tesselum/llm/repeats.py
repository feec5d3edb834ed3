"""Suffix-array deduplication: maximal repeats of MIN bytes and more, with all their occurrences.

Every string of MIN bytes holds an anchor: the rightmost least hash among its K-byte grams (winnowing). Anchors are a
sparse set of positions, some 1 in 77, that depends on the bytes around alone, so the occurrences of a repeat hold the same
anchors. Occurrences of an anchor whose gram occurs once are dropped after a grouped count; the others meet in these steps:

1. equal contexts (all the bytes that a MIN-byte string around the anchor can reach) are counted: they repeat as a whole;
2. of the distinct contexts of a gram an enhanced suffix array is built, over the bytes from the anchor on. A stack
   scan of its common-prefix lengths gives the tree of intervals; in each, the members are ordered by what stands to the left,
   and where their left extensions part, the strings from there to the interval's depth are maximal repeats: `maximal_repeats`
   returns each with all its occurrences. Those of MIN bytes or more are covered;
3. a gram with more than GROUP distinct contexts is not given to one task: its windows of MIN bytes are hashed and
   counted by group instead, in as many tasks as there are.

Covered ranges go back to all occurrences by context, and are united per document.

Edge cases: null texts count as empty; texts below MIN bytes have nothing to remove; repeated rows are each other's copies and
go whole where they have MIN bytes; an empty table gives no rows; rows that share a doc_id, or have none, are told apart by
their texts; clashing columns are replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselum.llm.common import cut, free, shared_dir, ship, table

MIN, K = 200, 48
#: Distinct contexts of a gram that one suffix array takes.
GROUP = 5_000
_CHUNK = 1 << 20
_LOW = np.uint64((1 << 21) - 1)
_rng = np.random.default_rng(20_240_611)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 14)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, r in (("up", _BASE), ("down", inverse)):
            out = np.full(size, r, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def _grams(b: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings of b."""
    n = len(b)
    up, down = _pow(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[b] * up, dtype=np.uint64)])
    h = (total[k:] - total[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minima of all w-long windows: running minima of blocks, forth and back."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    rows = full.reshape(-1, w)
    forth = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], forth[w - 1 : n])


def anchors(data: bytes, least: int = MIN, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes) of the anchors: in each string of `least` bytes, the rightmost least k-gram."""
    n, w = len(data), least - k + 1
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    b = np.frombuffer(data, np.uint8)
    at, hashes = [], []
    for start in range(0, n - least + 1, _CHUNK):
        part = b[start : start + _CHUNK + least - 1]
        h = _grams(part, k)
        low = _sliding_min((h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64)), w)
        i = (_LOW - (low & _LOW)).astype(np.int64)
        i = i[np.concatenate([[True], i[1:] != i[:-1]])]
        at.append(i + start)
        hashes.append(h[i])
    p, h = np.concatenate(at), np.concatenate(hashes)
    keep = np.concatenate([[True], p[1:] != p[:-1]])
    return p[keep], h[keep]


def context(data: bytes, p: int, least: int = MIN, k: int = K) -> tuple[int, bytes]:
    """How many bytes stand before the anchor at p, and all bytes that strings of `least` bytes around it reach."""
    left = min(p, least - k)
    return left, data[p - left : p + least]


# ------------------------------------------------------------------ the enhanced suffix array


def _words(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows as a matrix of bytes, padded with zeros, and as big-endian words for sorting."""
    width8 = -(-width // 8) * 8
    m = np.frombuffer(b"".join(r.ljust(width8, b"\0") for r in rows), np.uint8).reshape(len(rows), width8)
    return m, m.view(">u8").astype(np.uint64)


def _common(m: np.ndarray, length: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common-prefix lengths of the rows i and j of m."""
    unlike = m[i] != m[j]
    return np.minimum(np.where(unlike.any(axis=1), unlike.argmax(axis=1), m.shape[1]), np.minimum(length[i], length[j]))


def intervals(lcp: list[int], least: int) -> tuple[list[int], list[int], list[int]]:
    """The common-prefix interval tree of a suffix array, by a stack scan: depths, first and last members.

    lcp[i] is the common prefix of members i and i + 1. Intervals below `least` are left out.
    """
    depth, first, last, stack = [], [], [], []
    for i, x in enumerate([*lcp, -1]):
        start = i
        while stack and stack[-1][0] > x:
            d, start = stack.pop()
            if d >= least:
                depth.append(d)
                first.append(start)
                last.append(i)
        if x >= 0 and (not stack or stack[-1][0] < x):
            stack.append((x, start))
    return depth, first, last


def maximal_repeats(group: np.ndarray, left: list[int], text: list[bytes], least: int = MIN, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(repeat, member, lo, hi): the maximal repeats of `least` bytes and more, each with all its occurrences.

    group: which members share a gram (equal numbers together); left: the bytes before the anchor in each text; lo and hi
    count from the anchor. The interval tree over the bytes from the anchor on gives sets of members with a common right extension;
    in each, the interval tree over the bytes to the left gives those that share a left extension, and differ before it.
    Such a set is a maximal repeat if its right extensions part at the interval's depth too; else a deeper interval has it.
    """
    n = len(text)
    right, key = _words([t[x:] for t, x in zip(text, left, strict=True)], least)
    before, back = _words([t[:x][::-1] for t, x in zip(text, left, strict=True)], least - k)
    n_right, n_left = np.array([len(t) - x for t, x in zip(text, left, strict=True)]), np.array(left)
    order = np.lexsort((n_right, *key.T[::-1], group))
    rank = np.argsort(order)
    i, j = order[:-1], order[1:]
    lcp = np.where(group[i] == group[j], _common(right, n_right, i, j), -1) if n > 1 else np.zeros(0, np.int64)
    # one scan for all groups: a common prefix of -1 closes whatever is open
    depth, first, last = (np.array(x, np.int64) for x in intervals(lcp.tolist(), k))
    out: list[tuple[np.ndarray, ...]] = []
    repeats = 0
    for part in _parts(last - first + 1):
        node, at = _flat(part, first, last)
        member = order[at]
        by = np.lexsort((n_left[member], *back[member].T[::-1], node))
        node, member = node[by], member[by]
        shared = np.where(node[1:] == node[:-1], _common(before, n_left, member[:-1], member[1:]), -1)
        far, a, b = (np.array(x, np.int64) for x in intervals(shared.tolist(), 0))
        deep = depth[node[a]] if len(a) else far
        keep = far + deep >= least
        far, deep, a, b = far[keep], deep[keep], a[keep], b[keep]
        if not len(a):
            continue
        ranks = np.append(rank[member], 0)
        edges = np.stack([a, b + 1], axis=1).ravel()
        low, high = np.minimum.reduceat(ranks, edges)[::2], np.maximum.reduceat(ranks, edges)[::2]
        parted = _common(right, n_right, order[low], order[high]) == deep
        far, deep, a, b = far[parted], deep[parted], a[parted], b[parted]
        for some in _parts(b - a + 1):
            which, at = _flat(some, a, b)
            out.append((which + repeats, member[at], -far[which], deep[which]))
        repeats += len(a)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _parts(size: np.ndarray, most: int = 1 << 18) -> list[np.ndarray]:
    """The numbers of intervals of these sizes, in parts of about `most` members."""
    total = np.cumsum(size)
    return [x for x in np.split(np.arange(len(size)), np.searchsorted(total, np.arange(most, total[-1], most))) if len(x)] if len(size) else []


def _flat(part: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each member of the intervals `part`: the interval and the member's place."""
    size = (last - first + 1)[part]
    owner = np.repeat(part, size)
    return owner, first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)


def reach(member: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each member's least lo and greatest hi; as all its ranges hold the anchor, that is their union."""
    by = np.argsort(member, kind="stable")
    member, lo, hi = member[by], lo[by], hi[by]
    start = np.flatnonzero(np.concatenate([[True], member[1:] != member[:-1]])[: len(member)])
    if not len(start):
        return member, lo, hi
    return member[start], np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start)


# ------------------------------------------------------------------ Spark


def _same(doc: str, mark: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col("mark") == F.col(mark))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, mark, text): mark tells apart rows that share a doc_id."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).cast("string").alias("text"))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, pos, gram, ctx = [], [], [], []
        for i, t in enumerate(b.column(2)):
            data = (t.as_py() or "").encode()
            p, h = anchors(data)
            row.append(np.full(len(p), i))
            pos.append(p)
            gram.append(h)
            for q in p.tolist():
                left, part = context(data, q)
                ctx.append(xxhash.xxh64_intdigest(part, left))
        if not row:
            continue
        at = pa.array(np.concatenate(row))
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(pos).astype(np.int64)), pa.array(np.concatenate(gram).view(np.int64)), pa.array(np.array(ctx, np.uint64).view(np.int64))],
            ["doc", "mark", "pos", "gram", "ctx"],
        )


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, at: array<struct<pos, gram, ctx, hot>>) to the contexts' bytes."""
    for b in batches:
        rows = []
        for t, at in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            data = (t.as_py() or "").encode()
            rows += [(x["gram"], x["ctx"], x["hot"], *context(data, x["pos"])) for x in at]
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], ["gram", "ctx", "hot", "before", "bytes"])


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram (gram, ctx, before, bytes) to covered ranges (gram, ctx, lo, hi); whole grams are taken at once."""
    wait: list[pa.RecordBatch] = []
    size = 0

    def done(rows: pa.Table) -> pa.RecordBatch:
        gram = rows.column("gram").to_numpy()
        number = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]]))
        _, *found = maximal_repeats(number, rows.column("before").to_pylist(), rows.column("bytes").to_pylist())
        member, lo, hi = reach(*found)
        return pa.RecordBatch.from_arrays([pa.array(gram[member]), pa.array(rows.column("ctx").to_numpy()[member]), pa.array(lo.astype(np.int64)), pa.array(hi.astype(np.int64))], ["gram", "ctx", "lo", "hi"])

    for b in batches:
        wait.append(b)
        size += b.num_rows
        if size >= 20_000:
            rows = pa.Table.from_batches(wait)
            gram = rows.column("gram").to_numpy()
            edge = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if gram[0] != gram[-1] else 0
            if edge:
                yield done(rows.slice(0, edge))
                wait, size = rows.slice(edge).to_batches(), rows.num_rows - edge
    if size:
        yield done(pa.Table.from_batches(wait))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of MIN bytes of contexts: (gram, ctx, lo, w1, w2), lo from the anchor, w1 and w2 their hash of 128 bits."""
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            rows = []
            for gram, ctx, before, data in zip(*(c.to_pylist() for c in whole.slice(start, 500).columns), strict=True):
                for o in range(len(data) - MIN + 1):
                    w = hashlib.blake2b(data[o : o + MIN], digest_size=16).digest()
                    rows.append((gram, ctx, o - before, int.from_bytes(w[:8], "little", signed=True), int.from_bytes(w[8:], "little", signed=True)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["gram", "ctx", "lo", "w1", "w2"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, ranges) to the digest, the spans and what is left."""
    for b in batches:
        out = []
        for t, ranges in zip(b.column(1), b.column(2), strict=True):
            data = (t.as_py() or "").encode()
            spans, kept = [], data
            if ranges.is_valid and len(ranges.values):
                lo, hi = (np.asarray(ranges.values.field(i)) for i in (0, 1))
                lo, hi = np.maximum(lo, 0), np.minimum(hi, len(data))
                by = np.argsort(lo, kind="stable")
                lo, hi = lo[by], np.maximum.accumulate(hi[by])
                new = np.concatenate([[True], lo[1:] > hi[:-1]])
                starts, ends = lo[new], hi[np.append(new[1:], True)]
                spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
                edges = [0, *[x for s in spans for x in s], len(data)]
                kept = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            out.append((len(data), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in spans]))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span)
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([o[i] for o in out], kinds[i]) for i in range(5)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/repeats-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): what repeats of MIN bytes leave of each text."""
    spark = docs.sparkSession
    ship(spark)
    rows = _keyed(docs, doc_id, text)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found, path = _written(rows.mapInArrow(_anchor_rows, f"doc {id_type}, mark long, pos long, gram long, ctx long"))
    # anchors whose gram occurs again; counts are combined before they are dealt out, hot grams are split in the join
    counts = cut(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    occurring = cut(found.join(counts, "gram", "left_semi"))
    _delete(spark, path)
    del counts, found
    free(spark)
    contexts = cut(occurring.groupBy("gram", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "mark", "doc")).alias("one")))
    several = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    several = cut(several)
    hot = not several.where(F.col("m") > group).isEmpty()
    chosen = contexts.join(several, "gram").select("one.*", "gram", "ctx", (F.col("m") > group).alias("hot"))
    per_doc = chosen.groupBy("doc", "mark").agg(F.collect_list(F.struct("pos", "gram", "ctx", "hot")).alias("at")).withColumnRenamed("mark", "m")
    parts = rows.join(per_doc, _same("doc", "m")).select("text", "at").mapInArrow(_context_rows, "gram long, ctx long, hot boolean, before int, bytes binary")
    if hot:
        parts = cut(parts)
        chosen = per_doc = several = None
        free(spark)  # the texts that were dealt out
    cold = parts.where(~F.col("hot")).select("gram", "ctx", "before", "bytes")
    covered = cold.repartition("gram").sortWithinPartitions("gram", "ctx").mapInArrow(_suffix_rows, "gram long, ctx long, lo long, hi long")
    if hot:
        windows = cut(parts.where("hot").select("gram", "ctx", "before", "bytes").mapInArrow(_window_rows, "gram long, ctx long, lo long, w1 long, w2 long"))
        again = cut(windows.groupBy("gram", "lo", "w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
        covered = covered.union(windows.join(again, ["gram", "lo", "w1", "w2"], "left_semi").select("gram", "ctx", "lo", (F.col("lo") + MIN).alias("hi")))
    whole = contexts.where("n > 1").select("gram", "ctx", F.lit(K - MIN).cast("long").alias("lo"), F.lit(MIN).cast("long").alias("hi"))
    # all ranges of a context hold its anchor, so their union is one range
    covered = cut(covered.union(whole).groupBy("gram", "ctx").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    parts = cold = windows = again = chosen = per_doc = several = contexts = whole = None
    free(spark)
    ranges = occurring.join(covered, ["gram", "ctx"]).select("doc", "mark", (F.col("pos") + F.col("lo")).alias("lo"), (F.col("pos") + F.col("hi")).alias("hi"))
    ranges = ranges.groupBy("doc", "mark").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")).withColumnRenamed("mark", "m")
    out = rows.join(ranges, _same("doc", "m"), "left").select("doc_id", "text", "ranges")
    return out.mapInArrow(_removed, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
