"""SimHash near-duplicates: a self-join of binary tries under a Hamming budget.

A document's fingerprint has a bit for each of 64 that more than half of its word shingles' hashes set. Distinct
fingerprints that differ in at most BUDGET bits are linked. Of BUDGET + c blocks of bits c must be equal in such a pair, so
for each choice of c blocks the fingerprints are permuted to begin with them and dealt out by them; c follows the number of
fingerprints, so that few share a value by chance. In each deal the fingerprints, sorted, are a binary trie, and pairs of nodes are walked down together from the nodes of equal first blocks: a pair of children on
unlike branches adds a differing bit, and a pair over the budget is pruned. Small pairs of nodes end in exact
comparison. A deal yields a spanning forest of its links, never all pairs; components join the forests.

A block value shared by very many fingerprints is dealt as pairs of hashed groups of bounded size, so that every two
fingerprints still meet. Exact copies are one fingerprint from the start.

Edge cases: null, empty and blank texts have the fingerprint zero, linked like any other; texts of fewer words than a shingle
are one shingle; a null doc_id keeps its row and takes the smallest id of its component (null if there is none); repeated rows share
a component; an empty table gives no rows; clashing columns are replaced.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselum.llm.common import cut, free, fresh, join_split, ship, table
from tesselum.operators.components import components

SHINGLE, BUDGET, SEED = 4, 4, 42
STAGE_SHINGLE, STAGE_BUDGET, STAGE_WORDS, STAGE_WIDE = 5, 7, 8, 88
#: Fingerprints that are compared in one deal, at most half of it from each of two groups.
GROUP = 20_000
#: Minima of hashed shingles, in bands that two texts must share one of: of pairs similar by 0.8 one in 17,000 shares none.
BANDS, ROWS = 32, 6
#: Of the minima two texts must share, of eight bits each, to be compared: six standard deviations below what 0.8 gives.
ALIKE = 120
#: Texts of a band that are all paired at once, at most; of more each is paired with its neighbours and the first, and what is left in unlike components after that is compared with all in one task.
FEW = 8
#: Bytes of texts whose shingles one task compares all with all, about; half of it from each of two groups.
TEXTS = 16 << 20
#: Texts that are broadcast by their hash, at most.
BROADCAST = 1_000_000
#: Pairs, of all, for each part into which a text's partners are dealt.
LEAVES = 500
#: Hashes of a text that travel in one row, at most, so that a batch of rows is bounded.
PIECE = 1024
_PAIRS = 1 << 20  # compared at once
_BYTES = 8 << 20  # of record batches that are sent at once, about
_HELD = 32 << 20  # of record batches that are held until whole keys are done, about, if these are no larger
_SMALL = 64  # pairs of keys in a pair of nodes that are compared at once


def _majority(hashes: np.ndarray) -> np.ndarray:
    """The eight bytes of the bits that more than half of the hashes set."""
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), bitorder="little")


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a whole text."""
    w = text.encode().lower().split()  # of bytes, lower() and split() know ASCII only
    if not w:
        return 0
    data = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k, h = min(shingle, len(w)), xxhash.xxh64_intdigest
    hashes = np.array([h(data[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())], np.uint64)  # noqa: B905
    return int(_majority(hashes).view(np.uint64)[0])


def word_fingerprint(text: str) -> int:
    """The unsigned fingerprint of the distinct words, each with the weight 1 + ln(times)."""
    times = Counter(text.encode().lower().split())
    if not times:
        return 0
    hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in times], np.uint64)
    weight = 1 + np.log(np.array(list(times.values()), float))
    total = np.zeros(64)
    for start in range(0, len(hashes), 1 << 16):
        part = slice(start, start + (1 << 16))
        total += weight[part] @ np.unpackbits(hashes[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * total > weight.sum(), bitorder="little").view(np.uint64)[0])


def wide_fingerprint(text: str, shingle: int, words: int) -> list[int]:
    """`words` further fingerprint words (signed), of as many independent hashes of each shingle."""
    w = text.encode().lower().split()
    n = max(1, len(w) - shingle + 1)
    hashes = np.array([xxhash.xxh3_64_intdigest(b" ".join(w[i : i + shingle])) for i in range(n)], np.uint64)
    out = []
    for k in range(words):
        h = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        out.append(int(_majority(h).view(np.int64)[0]))
    return out


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs, without its text, with the fingerprint as a signed long `fp`."""
    ship(docs.sparkSession)
    keep = [c for c in docs.columns if c.lower() not in ("fp", text.lower())]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py() or "", shingle) for t in b.column(b.num_columns - 1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], [*b.schema.names[:-1], "fp"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, schema + "fp long")


def blocks(budget: int, equal: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of budget + equal blocks of the 64 bits."""
    n = budget + equal
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def spread(n: int, budget: int, crowd: int = 2_000) -> int:
    """How many blocks a deal takes as equal, so that n random fingerprints come to `crowd` per value of them at most."""
    equal = 1
    while equal < 4 and n >> min(equal * (64 // (budget + equal)), 62) > crowd:
        equal += 1
    return equal


def _block(fp: Column, block: tuple[int, int]) -> Column:
    a, w = block
    return F.shiftrightunsigned(fp, 64 - a - w).bitwiseAND((1 << w) - 1)


def permuted(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """The fingerprints with their blocks in this order."""
    out, at = np.zeros(len(fp), np.uint64), 64
    for a, w in order:
        at -= w
        out |= ((fp >> np.uint64(64 - a - w)) & np.uint64((1 << w) - 1)) << np.uint64(at)
    return out


class Forest:
    """Union-find over 0..n-1 that takes arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.root[a], self.root[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root != (up := self.root[self.root])).any():
                self.root = up


def _expand(la, na, lb, nb):
    """All index pairs of the node pairs [la, la + na) x [lb, lb + nb)."""
    size = na * nb
    owner = np.repeat(np.arange(len(size)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return la[owner] + k // nb[owner], lb[owner] + k % nb[owner]


def trie_join(keys: np.ndarray, first: int, budget: int, forest: Forest, wide: np.ndarray | None = None, wide_budget: int = 0) -> None:
    """Link in forest all pairs of the sorted uint64 keys that agree in their first bits and differ in at most budget bits.

    wide: a row of further fingerprint words per key, of which linked pairs differ in at most wide_budget bits.
    """
    n = len(keys)
    if n < 2:
        return
    top = keys >> np.uint64(64 - first) if first else np.zeros(n, np.uint64)
    lo = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
    hi = np.append(lo[1:], n)
    #: pairs of nodes, as ranges of sorted keys: (depth, la, ha, lb, hb, differing bits so far)
    stack = [(first, lo, hi, lo, hi, np.zeros(len(lo), np.int64))]
    while stack:
        depth, la, ha, lb, hb, err = stack.pop()
        na, nb = ha - la, hb - lb
        small = (na * nb <= _SMALL) | (depth == 64)
        if small.any():
            at = np.flatnonzero(small)
            sizes = np.cumsum(na[at] * nb[at])
            for part in np.split(at, np.searchsorted(sizes, np.arange(_PAIRS, sizes[-1], _PAIRS))):
                if len(part):
                    i, j = _expand(la[part], na[part], lb[part], nb[part])
                    ok = (i < j) & (forest.root[i] != forest.root[j])
                    i, j = i[ok], j[ok]
                    ok = np.bitwise_count(keys[i] ^ keys[j]) <= budget
                    if wide is not None:
                        i, j = i[ok], j[ok]
                        ok = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1) <= wide_budget
                    forest.link(i[ok], j[ok])
        go = ~small
        if not go.any():
            continue
        la, ha, lb, hb, err = (x[go] for x in (la, ha, lb, hb, err))
        if len(la) > _PAIRS:
            for part in np.array_split(np.arange(len(la)), len(la) // _PAIRS + 1):
                stack.append((depth, *(x[part] for x in (la, ha, lb, hb, err))))
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)

        def middle(low, high, bit=bit):
            split = (keys[low] | (bit - np.uint64(1))) & ~(bit - np.uint64(1)) | bit
            return np.clip(np.searchsorted(keys, split), low, high)

        ma, mb = middle(la, ha), middle(lb, hb)
        same = la == lb
        new = [
            np.concatenate(x)
            for x in zip(
                (la, ma, lb, mb, err),  # 0 with 0
                (ma, ha, mb, hb, err),  # 1 with 1
                (la, ma, mb, hb, err + 1),  # 0 with 1
                (ma[~same], ha[~same], lb[~same], mb[~same], err[~same] + 1),  # 1 with 0; of a node with itself, the same pair
                strict=True,
            )
        ]
        keep = (new[0] < new[1]) & (new[2] < new[3]) & (new[4] <= budget) & ~((new[0] == new[2]) & (new[1] - new[0] == 1))
        if keep.any():
            stack.append((depth + 1, *(x[keep] for x in new)))


def _deal(batches: Iterator[pa.RecordBatch], deals: list, budget: int, wide_budget: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by deal and prefix to the forests of their links; whole prefixes are taken at once."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        names = ("deal", "a", "b", "fp", "node")
        deal, a, b, fp, node = (rows.column(k).to_numpy() for k in names)
        fp = fp.view(np.uint64)
        wide = None
        if wide_budget >= 0:
            wide = rows.column("wide").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(fp), -1)
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        kinds, which = np.unique(np.stack([deal, a, b], axis=1), axis=0, return_inverse=True)
        for k, (d, _, _) in enumerate(kinds):
            at = np.flatnonzero(which.ravel() == k)
            order, first = deals[d]
            keys = permuted(fp[at], order)
            by = np.argsort(keys, kind="stable")
            at, keys = at[by], keys[by]
            forest = Forest(len(keys))
            trie_join(keys, first, budget, forest, None if wide is None else wide[at], wide_budget)
            far = np.flatnonzero(forest.root != np.arange(len(keys)))
            u.append(node[at[far]])
            v.append(node[at[forest.root[far]]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    wait, size = [], 0
    for batch in batches:
        wait.append(batch)
        size += batch.num_rows
        if size >= 200_000:
            rows = pa.Table.from_batches(wait)
            ends = np.stack([rows.column(k).to_numpy() for k in ("deal", "prefix", "a", "b")])
            unlike = np.flatnonzero((ends != ends[:, -1:]).any(axis=0))
            if len(unlike):
                edge = int(unlike[-1]) + 1
                yield done(rows.slice(0, edge))
                wait, size = rows.slice(edge).to_batches(), rows.num_rows - edge
    if size:
        yield done(pa.Table.from_batches(wait))


def links(nodes: DataFrame, budget: int = BUDGET, *, n: int | None = None, wide_budget: int = -1, group: int = GROUP) -> DataFrame:
    """(u, v): per deal, a spanning forest of the pairs of nodes whose fingerprints are within the budget.

    nodes: node and fp (longs) and, where wide_budget isn't negative, wide (array<long> of one length for all). n: how many there are.
    """
    ship(nodes.sparkSession)
    n = nodes.count() if n is None else n
    equal = spread(n, budget)
    parts = blocks(budget, equal)
    chosen = list(combinations(range(len(parts)), equal))
    # per deal: the order of the blocks, and the bits of those that are taken as equal
    deals = [([parts[i] for i in c] + [p for i, p in enumerate(parts) if i not in c], sum(parts[i][1] for i in c)) for c in chosen]

    def prefix(c: tuple[int, ...]) -> Column:
        out = F.lit(0).cast("long")
        for i in c:
            out = F.shiftleft(out, parts[i][1]).bitwiseOR(_block(F.col("fp"), parts[i]))
        return out

    wide = ["wide"] if wide_budget >= 0 else []
    deal = F.explode(F.array(*[F.struct(F.lit(k).alias("deal"), prefix(c).alias("prefix")) for k, c in enumerate(chosen)])).alias("d")
    rows = nodes.select("node", "fp", *wide, deal).select("d.deal", "d.prefix", "node", "fp", *wide)
    # values that more than `group` nodes share: few, as each holds that many
    half = max(1, group // 2)
    hot = rows.groupBy("deal", "prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group)
    hot = cut(hot.select("deal", "prefix", F.ceil(F.col("n") / half).cast("int").alias("groups")))
    if hot.isEmpty():
        dealt = rows.withColumns({"a": F.lit(-1), "b": F.lit(-1)})
    else:
        rows = rows.join(hot, ["deal", "prefix"], "left")
        own = F.coalesce(F.pmod(F.xxhash64("node"), F.col("groups")).cast("int"), F.lit(-1))
        other = F.when(F.col("groups").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("groups") - 1))
        rows = rows.withColumn("own", own).withColumn("other", F.explode(other))
        dealt = rows.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})
    dealt = dealt.select("deal", "prefix", "a", "b", "node", "fp", *wide)
    by = ["deal", "prefix", "a", "b"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda batches: _deal(batches, deals, budget, wide_budget), "u long, v long")


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """docs, without its text, with fp (signed long), fingerprint (hex) and component_id."""
    rows = cut(fingerprints(docs, text, shingle))
    least = cut(rows.groupBy("fp").agg(F.min(doc_id).alias("low")))
    roots = components(links(least.select(F.col("fp").alias("node"), "fp"), budget))
    of = cut(least.join(roots, least["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    # components, and fingerprints of copies, may be as large as the table
    label = cut(join_split(of.select("fp", "root"), of.groupBy("root").agg(F.min("low").alias("component_id")), "root", "inner").drop("root"))
    out = join_split(rows.drop("component_id", "fingerprint"), label, "fp")
    return out.withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))


def shingle_hashes(text: str, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word shingles of a text."""
    w = text.encode().lower().split()
    k, h = min(shingle, len(w)), np.array([xxhash.xxh64_intdigest(x, SEED) for x in w], np.uint64)
    out = np.full(max(1, len(w) - shingle + 1), k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
        out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xD6E8FEB86659FD93))


def _constants(n: int, seed: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


_TURN, _TIMES = _constants(BANDS * ROWS, 1), _constants(BANDS * ROWS, 1000) | np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * ROWS hashes of the shingles."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 1024):
        out = np.minimum(out, ((hashes[start : start + 1024, None] ^ _TURN) * _TIMES).min(axis=0))
    return out


def bands(low: np.ndarray) -> np.ndarray:
    """A key for each band of minima, of which two equal ones mean equal minima."""
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ low[k::ROWS]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
    return out


def sketch(low: np.ndarray) -> bytes:
    """Eight mixed bits of each of the minima."""
    return (low * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).tobytes()


def _whole(batches: Iterator[pa.RecordBatch], key: str, done) -> Iterator[pa.RecordBatch]:
    """done(rows) of rows sorted by key, with whole keys at once."""
    wait, size, held = [], 0, 0
    for batch in batches:
        wait.append(batch)
        size += batch.num_rows
        held += batch.nbytes
        if size >= 200_000 or held >= _HELD:
            rows = pa.Table.from_batches(wait)
            k = rows.column(key).to_numpy()
            unlike = np.flatnonzero(k != k[-1])
            if len(unlike):
                edge = int(unlike[-1]) + 1
                yield from done(rows.slice(0, edge))
                wait, size = rows.slice(edge).to_batches(), rows.num_rows - edge
                held = sum(b.nbytes for b in wait)
    if size:
        yield from done(pa.Table.from_batches(wait))


def _repeated(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h and node, those whose h two nodes or more have, once each."""
    h, node = rows.column("h").to_numpy(), rows.column("node").to_numpy()
    new = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1]))
    rows, h = rows.filter(pa.array(new)), h[new]
    like = h[1:] == h[:-1]
    yield from rows.filter(pa.array(np.append(False, like) | np.append(like, False))).to_batches()


def _met(rows: pa.Table, more: bool) -> Iterator[pa.RecordBatch]:
    """(u, v) of rows (h, node, root) of one h and unlike roots: each with the first of its h, in the order of nodes; or (more) with the first and
    its neighbours in an order of the h's own, and of a few all with each other. Never more than FEW pairs for a row."""
    h, node, root = (rows.column(k).to_numpy() for k in ("h", "node", "root"))
    key = (node ^ h).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) if more else node
    by = np.lexsort((key, h))
    h, node, root = h[by], node[by], root[by]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(start, len(h)))
    first, size = np.repeat(start, size), np.repeat(size, size)
    k = np.arange(len(h))
    pairs = [(k, first)]
    for back in range(1, FEW if more else 1):
        ok = (k - back >= first) & ((size <= FEW) | (back == 1))
        pairs.append((k[ok], k[ok] - back))
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    ok = root[i] != root[j]
    both = np.unique(np.stack([node[i[ok]], node[j[ok]]], axis=1), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])


def _hashed(rows: DataFrame, make, schema: str) -> DataFrame:
    """make(row, hashes) -> record batches, for the first row of each mark in a task. rows: mark, further columns, _text last."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches:
            wait, size = [], 0
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:-1] in seen:
                    continue
                seen.add(row[:-1])
                hashes = shingle_hashes(row[-1] or "")
                for made in make(row[:-1], hashes):
                    wait.append(pa.RecordBatch.from_arrays(made, names))
                    size += wait[-1].nbytes
                    if size > _BYTES:
                        yield from pa.Table.from_batches(wait).combine_chunks().to_batches()
                        wait, size = [], 0
            if wait:
                yield from pa.Table.from_batches(wait).combine_chunks().to_batches()

    return rows.mapInArrow(run, schema)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hub, part, leaf (its own set first), mark and place, a piece of a set each, to the (u, v) of leaves similar to their hub by 4/5."""
    hub: tuple = ()
    own: list[np.ndarray] = []
    whole = np.zeros(0, np.uint64)
    now, last, shared, size, found = None, None, 0, 0, []

    def close() -> None:
        if now is not None and 9 * shared >= 4 * (len(whole) + size):
            found.append((now[3], now[0]))

    for b in batches:
        sets = b.column("hashes")
        values, ends = sets.flatten().to_numpy().view(np.uint64), np.cumsum([0, *sets.value_lengths().to_pylist()])
        for k, row in enumerate(zip(*(b.column(c).to_pylist() for c in ("hub", "part", "leaf", "mark", "at", "n")), strict=True)):
            if row == last:
                continue  # the same text from another task
            last, mine = row, values[ends[k] : ends[k + 1]]
            if row[:4] != now and now is not None:
                close()
                now = None
            if not row[2]:
                if row[:2] != hub:
                    hub, own = row[:2], []
                own.append(mine.copy())
            elif row[:2] == hub:
                if now is None:
                    if own:
                        whole, own = np.concatenate(own), []
                    now, shared, size = row[:4], 0, row[5]
                shared += int((whole[np.minimum(np.searchsorted(whole, mine), len(whole) - 1)] == mine).sum())
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["u", "v"])
        found.clear()
    close()
    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["u", "v"])


def _dealt(pairs: DataFrame, n: int) -> DataFrame:
    """(mark, some, roles): to which tasks (hub, part) the texts of n distinct pairs (u, v) go, as leaf (u) or as hub (v), by text, as JSON.

    A hub is in as many parts as it has partners at most, and in one for each LEAVES pairs of all; so parts are bounded whatever a hub's partners,
    and no more is sent than twice the leaves. A hub's roles are told apart (some) by thousands, a leaf has no more than its round's pairs.
    """
    parts = 1 + n // LEAVES
    part = F.pmod(F.xxhash64("u"), F.lit(parts)).cast("int").alias("part")
    role = lambda leaf: F.struct(F.col("v").alias("hub"), "part", F.lit(leaf).alias("leaf")).alias("role")
    dealt = pairs.select("u", "v", part)
    roles = dealt.select(F.col("u").alias("mark"), F.lit(0).alias("some"), role(1)).union(dealt.select(F.col("v").alias("mark"), F.floor(F.col("part") / 4096).cast("int"), role(0)).distinct())
    return cut(roles.groupBy("mark", "some").agg(F.to_json(F.collect_list("role")).alias("roles")), forget=True)


def similar(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of the distinct pairs (u, v) of marks, materialised, those whose texts' shingles have a similarity of 4/5 or more. rows: mark and _text.

    Only the sets of the texts of pairs move, each hub's to few tasks. Of copies a task sends one.
    """
    n = pairs.count()
    wanted = _dealt(pairs, n)
    texts = (rows.join(F.broadcast(wanted), "mark") if 2 * n <= BROADCAST else join_split(rows, wanted, "mark", "inner")).select("mark", "some", "roles", "_text")

    def sets(row: tuple, hashes: np.ndarray):
        at = np.arange(0, len(hashes), PIECE)
        pieces = pa.array([hashes[a : a + PIECE].view(np.int64) for a in at], pa.list_(pa.int64()))
        same = lambda v, t: pa.array(np.full(len(at), v), t)
        for r in json.loads(row[2]):
            yield [same(r["hub"], pa.int64()), same(r["part"], pa.int32()), same(r["leaf"], pa.int32()), same(row[0], pa.int64()), pa.array(at, pa.int64()), same(len(hashes), pa.int64()), pieces]

    made = _hashed(texts, sets, "hub long, part int, leaf int, mark long, at long, n long, hashes array<long>")
    made = made.repartition("hub", "part").sortWithinPartitions("hub", "part", "leaf", "mark", "at")
    return cut(made.mapInArrow(_compared, "u long, v long").distinct(), forget=True)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hub, part and leaf (its own sketch first) to the (u, v) of leaves whose sketches agree with the hub's in ALIKE bytes or more."""
    hub, own = None, None
    for b in batches:
        found = []
        for h, part, leaf, mark, sketch_ in zip(*(b.column(c).to_pylist() for c in ("hub", "part", "leaf", "mark", "sketch")), strict=True):
            mine = np.frombuffer(sketch_, np.uint8)
            if not leaf:
                hub, own = (h, part), mine
            elif hub == (h, part) and int((own == mine).sum()) >= ALIKE:
                found.append((mark, h))
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["u", "v"])


def promising(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the pairs (u, v) those whose sketches agree in ALIKE bytes or more, materialised. nodes: mark and sketch."""
    pairs = cut(pairs.distinct(), forget=True)
    roles = nodes.select("mark", "sketch").join(_dealt(pairs, pairs.count()), "mark")
    each = roles.select("mark", "sketch", F.explode(F.from_json("roles", "array<struct<hub: bigint, part: int, leaf: int>>")).alias("r")).select("r.hub", "r.part", "r.leaf", "mark", "sketch")
    each = each.repartition("hub", "part").sortWithinPartitions("hub", "part", "leaf", "mark")
    out = cut(each.mapInArrow(_agreeing, "u long, v long"), forget=True)
    free(nodes.sparkSession)
    return out


def _unlike(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (u, v) of unlike components. known: (node, root)."""
    few = known.count() <= BROADCAST
    for side in "uv":
        of = known.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
        pairs = pairs.join(F.broadcast(of), side, "left") if few else join_split(pairs, of, side)
    return pairs.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")


def _spread(keys: DataFrame) -> DataFrame:
    """keys (h, node) with a key of their own for each some GROUP / 2 nodes of one that more than GROUP have; its least node goes to each of them. band: the h before."""
    many = keys.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where(F.col("n") > GROUP)
    hot = cut(many.select("h", "least", F.ceil(F.col("n") / max(1, GROUP // 2)).cast("int").alias("parts")), forget=True)
    if hot.isEmpty():
        return keys.withColumn("band", F.col("h"))
    own = F.when(F.col("parts").isNotNull(), F.xxhash64("h", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))).otherwise(F.col("h"))
    least = hot.select("h", "least", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return keys.join(hot, "h", "left").select(own.alias("h"), "node", F.col("h").alias("band")).union(least.select(F.xxhash64("h", "part"), "least", "h"))


def _agree(sketches: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
    """Those of the ascending j whose sketches agree with that of i in ALIKE bytes or more. sketches: a column for each text."""
    if not len(j):
        return j
    part = sketches[:, j] if 4 * len(j) < j[-1] - j[0] else sketches[:, j[0] : j[-1] + 1]
    near = (part == sketches[:, i : i + 1]).view(np.uint8).sum(axis=0, dtype=np.uint8) >= ALIKE
    return j[near if len(near) == len(j) else near[j - j[0]]]


def _columns(sketches: list[bytes]) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1).T)


def _one_each(forest: Forest, i: int, j: np.ndarray) -> np.ndarray:
    """One of j for each tree; these are linked with i."""
    j = j[np.unique(forest.root[j], return_index=True)[1]]
    forest.link(np.full(len(j), i), j)
    return j


def _ends(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    u = np.concatenate([np.zeros(0, np.int64), *(np.full(len(j), i) for i, j in found)])
    v = np.concatenate([np.zeros(0, np.int64), *(j for _, j in found)])
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])


def _apart(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """(u, v): a spanning forest of all rows (deal, side, node, root, sketch) of one deal, unlike roots and, where a deal has two, unlike sides whose sketches agree in ALIKE bytes or more."""
    deal, side, node, root = (rows.column(k).to_numpy() for k in ("deal", "side", "node", "root"))
    sketches, found = rows.column("sketch").to_pylist(), []
    by = np.lexsort((root, deal))
    for at in np.split(by, np.flatnonzero(np.diff(deal[by])) + 1):
        r, s, own = root[at], side[at], _columns([sketches[k] for k in at])
        both, forest = bool(s.any() and not s.all()), Forest(len(at))
        for i, end in enumerate(np.searchsorted(r, r, "right").tolist()):
            j = end + np.flatnonzero((forest.root[end:] != forest.root[i]) & ((s[end:] != s[i]) | (not both)))
            j = _agree(own, i, j)
            if len(j):
                found.append((node[at[i]], node[at[_one_each(forest, i, j)]]))
    yield _ends(found)


def _linked(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """(u, v): a spanning forest of all texts of one deal, unlike roots and, where a deal has two, unlike sides that are similar by 4/5 or more.

    rows (deal, side, node, root, at, sketch, hashes) are pieces of sets, sorted by deal, node and at; copies come more than once.
    """
    deal, node, at = (rows.column(k).to_numpy() for k in ("deal", "node", "at"))
    new = np.append(True, (deal[1:] != deal[:-1]) | (node[1:] != node[:-1]) | (at[1:] != at[:-1]))
    rows = rows.filter(pa.array(new)).combine_chunks()
    deal, side, node, root, at = (rows.column(k).to_numpy() for k in ("deal", "side", "node", "root", "at"))
    sets, edges, found = rows.column("hashes"), np.flatnonzero(np.append(True, deal[1:] != deal[:-1])).tolist(), []
    for low, high in zip(edges, [*edges[1:], len(deal)], strict=True):
        first = low + np.flatnonzero(at[low:high] == 0)
        pieces = sets.slice(low, high - low).combine_chunks()
        lengths = pieces.value_lengths().to_numpy()
        size = np.add.reduceat(lengths, first - low).astype(np.int64)
        start = np.cumsum(size) - size
        known, ids = np.unique(pieces.flatten().to_numpy(), return_inverse=True)
        mine, s, own = np.zeros(len(known), bool), side[first], _columns(rows.column("sketch").take(pa.array(first)).to_pylist())
        both, forest = bool(s.any() and not s.all()), Forest(len(first))
        _, least, of = np.unique(root[first], return_index=True, return_inverse=True)
        forest.root = least[of]
        for i in range(len(first) - 1):
            rest = slice(i + 1, None)
            sized = (5 * size[rest] >= 4 * size[i]) & (4 * size[rest] <= 5 * size[i])
            j = i + 1 + np.flatnonzero((forest.root[rest] != forest.root[i]) & sized & ((s[rest] != s[i]) | (not both)))
            j = _agree(own, i, j)
            if not len(j):
                continue
            mine[ids[start[i] : start[i] + size[i]]] = True
            total = np.cumsum(size[j])
            shared = [np.zeros(0, np.int64)]
            for part in np.split(j, np.searchsorted(total, np.arange(_PAIRS, total[-1], _PAIRS))):
                if len(part):
                    ahead = np.cumsum(size[part]) - size[part]
                    k = np.arange(size[part].sum()) + np.repeat(start[part] - ahead, size[part])
                    shared.append(np.add.reduceat(mine[ids[k]], ahead, dtype=np.int64))
            mine[ids[start[i] : start[i] + size[i]]] = False
            j = j[9 * np.concatenate(shared) >= 4 * (size[i] + size[j])]
            if len(j):
                found.append((node[first[i]], node[first[_one_each(forest, i, j)]]))
    yield _ends(found)


def _all_pairs(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows (key, node, further columns) with deal and side: once if their key has one group, else once for each group, so that every two of a key meet. groups: key and groups."""
    own = F.pmod(F.xxhash64("node"), F.col("groups")).cast("int")
    dealt = rows.join(groups, key).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    deal = F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")).alias("deal")
    return dealt.select(*rows.columns, deal, F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))


def _rest(shared: DataFrame, known: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v), materialised: links of all texts of unlike components that share a band of more than FEW texts.

    No pair is a row. First sketches are compared, band by band, and a task tells which texts hang together by pairs that agree in ALIKE bytes or more: a
    spanning forest. Then the shingles of the texts of each such cluster go to one task, which compares all of these pairs and again gives a forest. Only bands with unlike
    components take part. Bands of more than GROUP texts, and clusters of more texts or more than TEXTS bytes, are dealt as pairs of groups, so that every two texts meet.
    """
    half = max(1, GROUP // 2)
    rooted = shared.select("band", "node").join(known, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where((F.col("n") > FEW) & (F.col("low") < F.col("high")))
    mixed = cut(mixed.select("band", F.when(F.col("n") > GROUP, F.ceil(F.col("n") / half)).otherwise(1).cast("int").alias("groups")), forget=True)
    if mixed.isEmpty():
        return known.limit(0).toDF("u", "v")
    # a text's sketch is joined once, with the list of the deals that it goes to
    roles = _all_pairs(rooted, mixed, "band").groupBy("node", "root").agg(F.collect_set(F.struct("deal", "side")).alias("deals"))
    each = nodes.select(F.col("mark").alias("node"), "sketch").join(roles, "node").select(F.explode("deals").alias("d"), "node", "root", "sketch").select("d.deal", "d.side", "node", "root", "sketch")
    each = each.repartition("deal").sortWithinPartitions("deal")
    near = components(each.mapInArrow(lambda batches: _whole(batches, "deal", _apart), "u long, v long"))
    free(nodes.sparkSession)
    if near.isEmpty():
        return known.limit(0).toDF("u", "v")
    members = near.select("node", F.col("root").alias("cluster")).union(near.select("root", "root").distinct())
    members = cut(members.join(known, "node", "left").select("node", "cluster", F.coalesce("root", "node").alias("root")), forget=True)
    few = 2 * members.count() <= BROADCAST

    def its_text(of: DataFrame) -> DataFrame:
        of = of.withColumnRenamed("node", "mark")
        return texts.join(F.broadcast(of), "mark") if few else join_split(texts, of, "mark", "inner")

    sizes = its_text(members.select("node", "cluster")).groupBy("mark", "cluster").agg(F.max(F.coalesce(F.octet_length("_text"), F.lit(0))).alias("size")).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    large = (F.col("n") > GROUP) | (F.col("size") > TEXTS)
    sizes = cut(sizes.select("cluster", F.when(large, F.ceil(F.greatest(F.col("n") / half, 2 * F.col("size") / TEXTS))).otherwise(1).cast("int").alias("groups")), forget=True)
    wanted = _all_pairs(members, sizes, "cluster").groupBy("node", "root").agg(F.to_json(F.collect_list(F.struct("deal", "side"))).alias("deals"))
    wanted = cut(wanted, forget=True)

    def sets(row: tuple, hashes: np.ndarray):
        mark, root, deals = row
        at = np.arange(0, len(hashes), PIECE)
        pieces = pa.array([hashes[a : a + PIECE].view(np.int64) for a in at], pa.list_(pa.int64()))
        same = lambda v, t: pa.array([v] * len(at), t)
        own = sketch(minima(hashes))
        for d in json.loads(deals):
            yield [same(d["deal"], pa.int64()), same(d["side"], pa.int32()), same(mark, pa.int64()), same(root, pa.int64()), pa.array(at, pa.int64()), same(own, pa.binary()), pieces]

    made = _hashed(its_text(wanted).select("mark", "root", "deals", "_text"), sets, "deal long, side int, node long, root long, at long, sketch binary, hashes array<long>")
    made = made.repartition("deal").sortWithinPartitions("deal", "node", "at")
    out = cut(made.mapInArrow(lambda batches: _whole(batches, "deal", _linked), "u long, v long"), forget=True)
    free(nodes.sparkSession)
    return out


def completed(found: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The links found with those of all texts that share a band of minima and aren't in one component. nodes: mark, bands and sketch; texts: mark and _text.

    First each text meets one other, the least of all that are first in one of its bands, so that large groups are together with a pair for each
    text. Then it meets its neighbours, a few pairs of a text at a time, four times as many in each round, until none of unlike components is left. Last, where a band still holds unlike
    components, all texts of these are compared, in tasks that give links only. What the rounds hand on forgets how it was made, so that plans don't grow.
    """
    spark = nodes.sparkSession
    keys = _spread(nodes.select(F.explode("bands").alias("h"), F.col("mark").alias("node"))).repartition("h").sortWithinPartitions("h", "node")
    shared = cut(keys.mapInArrow(lambda batches: _whole(batches, "h", _repeated), "h long, node long, band long"))
    free(spark)

    def met(more: bool) -> DataFrame:
        known = components(found)
        few = known.count() <= BROADCAST
        # a broadcast leaves the rows where and as they are: those of a band together
        rooted = shared.join(F.broadcast(known) if few else known, "node", "left").select("h", "node", F.coalesce("root", "node").alias("root"))
        if not few:
            rooted = rooted.repartition("h").sortWithinPartitions("h")
        return rooted.mapInArrow(lambda batches: _whole(batches, "h", lambda t: _met(t, more)), "u long, v long")

    def checked(pairs: DataFrame) -> DataFrame:
        out = cut(found.union(similar(pairs, texts)), forget=True)
        free(spark)
        return out

    found = checked(promising(met(False).groupBy("u").agg(F.min("v").alias("v")), nodes))
    left, most = cut(met(True).distinct(), forget=True), 4
    while not left.isEmpty():
        # of a text at most FEW pairs for each band
        ranked = left.withColumn("_k", F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "v"), "v")))
        found = checked(promising(ranked.where(F.col("_k") <= most).select("u", "v"), nodes))
        left, most = cut(_unlike(ranked.where(F.col("_k") > most).select("u", "v"), components(found)), forget=True), 4 * most
    return cut(found.union(_rest(shared, components(found), nodes, texts)), forget=True)


def distinct(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id.

    Texts are linked if their distinct shingles of STAGE_SHINGLE words have a similarity of 0.8 or more. Fingerprints propose most pairs:
    those of such shingles differ in a sixth of their bits at that similarity, beyond what a trie join can prune, while those of single
    words, dampened so that common words don't decide, differ in few; so the trie join runs on the latter, within STAGE_BUDGET bits, and of the pairs that it meets those are
    proposed whose STAGE_WORDS * 64 bits over shingles differ in at most STAGE_WIDE. Copies that they miss, such as those with a passage
    added or cut off, share a band of minima, whatever the edit. The shingles of all that is proposed, but for pairs that sketches show to be far apart, are compared, by 64-bit hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            out: list[list] = [[], [], [], []]
            for mark, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if mark in seen:  # a copy: its text's features are there already
                    made = (None,) * 4
                else:
                    seen.add(mark)
                    low = minima(shingle_hashes(text or ""))
                    fp = int(np.uint64(word_fingerprint(text or "")).view(np.int64))
                    made = (fp, wide_fingerprint(text or "", STAGE_SHINGLE, STAGE_WORDS), sketch(low), bands(low).view(np.int64))
                for o, m in zip(out, made, strict=True):
                    o.append(m)
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(o, t) for o, t in zip(out, kinds, strict=True))], ["doc", "mark", *features])

    features = ("fp", "wide", "sketch", "bands")
    marked = rows.select("doc", F.xxhash64("_text").alias("mark"), "_text")
    made = cut(marked.mapInArrow(run, f"doc {kind}, mark long, fp long, wide array<long>, sketch binary, bands array<long>"))
    # a node per distinct text, so that texts that share an id stay apart
    least = cut(made.groupBy("mark").agg(F.min("doc").alias("low"), *[F.first(c, ignorenulls=True).alias(c) for c in features]), forget=True)
    free(spark)
    texts = marked.select("mark", "_text")
    found = similar(promising(links(least.select(F.col("mark").alias("node"), "fp", "wide"), STAGE_BUDGET, wide_budget=STAGE_WIDE), least), texts)
    free(spark)
    found = completed(found, least, texts)
    roots = components(found).withColumnRenamed("node", "mark")
    of = cut(least.select("mark", "low").join(roots, "mark", "left").select("mark", "low", F.coalesce("root", "mark").alias("root")))
    # the smallest doc_id stands for the component; one without any, its first text
    best = of.groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "mark")).alias("best"))
    stay = best.select("best.mark", F.col("best.low").alias("stay"))
    counts = made.groupBy("doc", "mark").agg(F.count(F.lit(1)).alias("times"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    stay = cut(counts.join(stay, "mark").where(same("doc", "stay")).select("doc", F.col("mark").alias("m"), "times"))
    mark, times, one, its = fresh(docs, "_mark", "_times", "_stay", "_stay_mark")
    out = docs.withColumn(mark, F.xxhash64(F.col(text).cast("string")))
    out = out.join(stay.toDF(one, its, times), F.col(doc_id).eqNullSafe(F.col(one)) & (F.col(mark) == F.col(its)))
    once_each = out.where(F.col(times) > 1).dropDuplicates([doc_id, mark])
    return out.where(F.col(times) == 1).unionByName(once_each).select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return group(docs).select("doc_id", "fingerprint", "component_id")
