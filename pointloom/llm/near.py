"""Exact n-gram Jaccard join and its components (operator 9), by set-relation skipping.

A document is the set of its distinct ``N``-word shingles; documents with a Jaccard similarity of at
least ``PERCENT`` per cent are linked. The steps, each over all documents:

1. Sets are hashed and documents with equal sets fold into one, by digest.
2. The document frequency of every shingle is counted in buckets of shingles (six bytes for each), and those that occur at
   least twice go back to their block of documents. So each set knows its prefix, the n - ceil(0.75 n) + 1
   rarest of its shingles, of which two linked sets share one. A set with as many shingles of its own is linked with nothing.
3. Prefix entries meet by shingle; a list is walked in order of set size, and neighbours whose sizes rule out
   a link start a new block, so lists skip by block. Blocks of documents and buckets pass on
   one entry for each block with its size range and a spanning forest, never pairs: a shingle that a third of all
   documents hold costs a row for each block of documents, in its count (step 2) as in its list. Components of these
   candidate edges are closed worlds: each link lies inside one. Small worlds share tasks of about ``TASK_SHINGLES``.
   A large one is first compared with a few pivots, in parts of bounded size: sets drawn by digest, then the sets that
   lie closest to those. Sets linked through pivots are one body, whose members need no comparison with each other; only
   the rest, usually few, meet each other and the body, a block of at most ``BLOCK`` sets with another in a task of its own.
4. Within a task, sets are joined in order of size through an index of prefixes with exact frequencies. A
   pair already connected is skipped. An answer is derived from that of a similar set where possible: with
   o = |y & r| known and x like r, |y & x| lies between o - |r - x| and o + |x - r|, which often settles the pair unseen.
5. Components of the links, carried to all documents through the digests.

Shingles are 64-bit hashes of their words (sets by their 128-bit digests): the result is exact unless two hashes
collide. Defined results: null text and text without words have an empty
set and are linked with nothing; a null doc_id counts as larger than all others; sets are told apart by their digests, so
documents with null or repeated ids are linked by their texts alone; repeated rows are returned as often as they
come; empty tables give empty results; texts may be of any length; extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.llm.common import SPACE, released, ship, shuffle_partitions, spare, stored, table
from pointloom.llm.components import connected_components

N = 5
#: Linked when 100 * intersection >= PERCENT * union; written as 7 * intersection >= 3 * (sum of sizes) below.
PERCENT = 75
#: Shingles and documents in a block of documents, and shingles in a bucket: what a task holds at a time.
BLOCK_SHINGLES, BLOCK_DOCS, BUCKET_SHINGLES = 2_000_000, 60_000, 4_000_000
#: Occurrences in a block of documents from which a shingle is sent on as a count.
FOLD = 16
_ROUGH = 1 << 20
#: Sets and shingles per block of a large candidate component; shingles that small components share a task at.
BLOCK, BLOCK_SUM, TASK_SHINGLES = 256, 2_000_000, 1_000_000
#: Pivots of a large component in each of the two rounds.
PIVOTS = 8
#: Size of the filter that spares most texts the last reading.
FILTER_BYTES = 1 << 20
_NULL_ID = (1 << 63) - 1

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _P), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, n: int = N) -> np.ndarray:
    """The sorted set of a text's shingles (the whole sequence if it has fewer words)."""
    if not text:
        return np.zeros(0, np.uint64)
    b = np.frombuffer(text, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edges = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    first, last = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(first):
        return np.zeros(0, np.uint64)
    lower = np.where((b >= 65) & (b <= 90), b + np.uint8(32), b).astype(np.uint64) + np.uint64(1)
    up, down = _powers(len(b))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lower * up)])
    words = _mixed((sums[last] - sums[first]) * down[first])
    k = min(n, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = out * _P + words[j : len(words) - k + 1 + j]
    return np.unique(_mixed(out + np.uint64(k)))


def digest(s: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist())


def prefix_size(n):
    """Two linked sets share one of their so many first shingles."""
    return n - (3 * n + 3) // 4 + 1


def linked(overlap: int, a: int, b: int) -> bool:
    return 7 * overlap >= 3 * (a + b)


class Forest:
    """Union-find over any keys."""

    def __init__(self):
        self.up: dict = {}

    def find(self, a):
        up = self.up
        root = a
        while (p := up.get(root, root)) != root:
            root = p
        while a != root:
            up[a], a = root, up.get(a, a)
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _runs(tokens: np.ndarray, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, forest: Forest, edges: list):
    """Fold the entries of each shingle into blocks of sizes that may link; joins go to ``edges``.

    Returns the entries (tokens, ids, lo, hi) that stand for the blocks.
    """
    order = np.lexsort((lo, tokens))
    tokens, ids, lo, hi = tokens[order], ids[order], lo[order], hi[order]
    same = np.concatenate([tokens[1:] == tokens[:-1], [False]])
    if not same.any():
        return tokens, ids, lo, hi
    keep = np.ones(len(tokens), bool)
    hi = hi.copy()
    ids_, lo_, hi_ = ids.tolist(), lo.tolist(), hi.tolist()
    head = -1
    for i in np.flatnonzero(same).tolist():
        if head < 0 or i != at or tokens[i] != tokens[head]:
            head = i
        at = i + 1
        if 4 * hi_[head] >= 3 * lo_[at]:  # some size of the block may link with this one's
            if forest.union(ids_[head], ids_[at]):
                edges.append((ids_[head], ids_[at]))
            hi_[head] = max(hi_[head], hi_[at])
            keep[at] = False
        else:
            head = at
    return tokens[keep], ids[keep], lo[keep], np.array(hi_, np.int32)[keep]


def _binary(batch: pa.RecordBatch, k: int) -> list[bytes | None]:
    return batch.column(k).cast(pa.binary()).to_pylist()


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document (doc_id, text, fingerprint) with its digest and set size."""
    for batch in batches:
        sets = [shingles(x) for x in _binary(batch, 1)]
        a = np.array([(*(digest(s) if len(s) else (0, 0)), len(s)) for s in sets], np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(a[:, k]) for k in range(3)]], names=["doc_id", "print", "d1", "d2", "n"])


_ROWS = "key long, block long, kind int, a binary, b binary, c binary"
_ROW_NAMES = ["key", "block", "kind", "a", "b", "c"]


def _shingles_by_bucket(buckets: int):
    """Blocks of documents: their shingles by bucket (kind 0: 32 bits of each, place of its document; kind 2: those found
    more than ``FOLD`` times, and how often), and their digests, sizes and places of the shingles of kind 2 (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = iter(range(TaskContext.get().partitionId() << 32, (TaskContext.get().partitionId() + 1) << 32))
        held, size = {}, 0

        def block() -> pa.RecordBatch:
            name, sets = next(number), list(held.values())
            tokens = np.concatenate(sets)
            place = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
            bucket = ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            low = tokens.astype(np.uint32)
            # A frequent shingle goes to its bucket as a count; its places stay with the block. Few shingles pass the rough count.
            rough = np.bincount(low & np.uint32(_ROUGH - 1), minlength=_ROUGH) > FOLD
            maybe = np.flatnonzero(rough[low & np.uint32(_ROUGH - 1)])
            maybe = maybe[np.lexsort((low[maybe], bucket[maybe]))]
            new = np.concatenate([[True], (low[maybe[1:]] != low[maybe[:-1]]) | (bucket[maybe[1:]] != bucket[maybe[:-1]])])[: len(maybe)]
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(maybe)))
            often = times > FOLD
            folded = maybe[np.repeat(often, times)]
            alone = np.ones(len(tokens), bool)
            alone[folded] = False
            order = np.flatnonzero(alone)
            order = order[np.argsort(bucket[order], kind="stable")]
            heads = maybe[first[often]]
            rows = []
            for kind, t, p, k in ((0, low[order], place[order], bucket[order]), (2, low[heads], times[often].astype(np.uint32), bucket[heads])):
                ends = np.searchsorted(k, np.arange(buckets + 1))
                rows += [(j, name, kind, t[x:y].tobytes(), p[x:y].tobytes(), None) for j, (x, y) in enumerate(zip(ends, ends[1:], strict=False)) if y > x]
            rows.append((name % buckets, name, 1, np.array([d[0] for d in held], np.int64).tobytes(), np.array([len(s) for s in sets], np.int32).tobytes(), place[folded].tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_ROW_NAMES)

        for batch in batches:
            for s in map(shingles, _binary(batch, 0)):
                if len(s):
                    d = digest(s)
                    if d not in held:
                        held[d] = s
                        size += len(s)
                if size >= BLOCK_SHINGLES or len(held) >= BLOCK_DOCS:
                    yield block()
                    held.clear()
                    size = 0
        if held:
            yield block()

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: back to each block go its shingles that occur twice or more, with their frequency."""
    out = [(-1, r.block, 1, r.a, r.b, r.c) for r in pdf[pdf["kind"] == 1].itertuples()]
    part = pdf[pdf["kind"] != 1]
    if len(part):
        tokens = [np.frombuffer(x, np.uint32) for x in part["a"]]
        counts = [np.frombuffer(b, np.uint32) if k == 2 else np.ones(len(t), np.uint32) for t, b, k in zip(tokens, part["b"], part["kind"], strict=True)]
        _, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
        often = np.bincount(inverse, np.concatenate(counts).astype(np.float64)).astype(np.int64)[inverse]
        bucket = int(part["key"].iloc[0])
        at, high = 0, np.uint64(bucket << 32)
        for r, t in zip(part.itertuples(), tokens, strict=True):
            f = often[at : at + len(t)]
            kept = f > 1
            if kept.any():
                names = t[kept].astype(np.uint64) | high
                places = r.b if r.kind == 2 else np.frombuffer(r.b, np.uint16)[kept].tobytes()
                out.append((bucket, r.block, r.kind, names.tobytes(), places, f[kept].astype(np.uint32).tobytes()))
            at += len(t)
    return pd.DataFrame(out, columns=_ROW_NAMES)


_ENTRIES = "bucket int, tokens binary, ids binary, lo binary, hi binary, edges binary"
_ENTRY_NAMES = ["bucket", "tokens", "ids", "lo", "hi", "edges"]


def _prefixes(buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One block of documents: its prefix entries by bucket, folded."""
        head, part = pdf[pdf["kind"] == 1].iloc[0], pdf[pdf["kind"] == 0]
        ids, sizes = np.frombuffer(head["a"], np.int64), np.frombuffer(head["b"], np.int32)
        tokens, place, often = (np.frombuffer(b"".join(part[c]), t) for c, t in (("a", np.uint64), ("b", np.uint16), ("c", np.uint32)))
        many = pdf[pdf["kind"] == 2].sort_values("key")
        if len(many):  # buckets in order, so the block's places of these shingles come in order
            names, times, f = (np.frombuffer(b"".join(many[c]), t) for c, t in (("a", np.uint64), ("b", np.uint32), ("c", np.uint32)))
            tokens, often = np.concatenate([tokens, np.repeat(names, times)]), np.concatenate([often, np.repeat(f, times)])
            place = np.concatenate([place, np.frombuffer(head["c"], np.uint16)])
        order = np.lexsort((tokens, often, place))
        tokens, place = tokens[order], place[order].astype(np.int64)
        n = np.bincount(place, minlength=len(ids))
        # A document's own shingles come first in its prefix; what is left of the prefix are its rarest shared ones.
        left = prefix_size(sizes.astype(np.int64)) - (sizes - n)
        rank = np.arange(len(place)) - (np.cumsum(n) - n)[place]
        kept = rank < left[place]
        forest, edges = Forest(), []
        tokens, ids, lo, hi = _runs(tokens[kept], ids[place[kept]], sizes[place[kept]], sizes[place[kept]], forest, edges)
        bucket = (_mixed(tokens) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for k in range(buckets):
            o, mine = order[ends[k] : ends[k + 1]], edges[k::buckets]
            if len(o) or mine:
                rows.append((k, tokens[o].tobytes(), ids[o].tobytes(), lo[o].tobytes(), hi[o].tobytes(), np.array(mine, np.int64).tobytes()))
        return pd.DataFrame(rows, columns=_ENTRY_NAMES)

    return run


def _candidates(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: a spanning forest of its candidate edges."""
    joined = [b"".join(pdf[c]) for c in _ENTRY_NAMES[1:]]
    tokens, ids, lo, hi = (np.frombuffer(x, t) for x, t in zip(joined, (np.uint64, np.int64, np.int32, np.int32), strict=False))
    forest, edges = Forest(), []
    for a, b in np.frombuffer(joined[4], np.int64).reshape(-1, 2).tolist():
        if forest.union(a, b):
            edges.append((a, b))
    if len(tokens):
        _runs(tokens, ids, lo, hi, forest, edges)
    return pd.DataFrame(np.array(edges, np.int64).reshape(-1, 2), columns=["a", "b"])


def links_within(ids: list[int], sets: list[np.ndarray], blocks: list[int] | None = None, bodies: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect all linked sets (a spanning forest of them). ``blocks``: only pairs of unlike blocks are looked at.

    ``bodies``: sets of one body (not negative) are known to be connected.
    """
    flat = np.concatenate(sets)
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    shared_from = int((counts == 1).sum())  # ranks below occur in one set only
    ranks = [np.sort(r) for r in np.split(rank[inverse], np.cumsum([len(s) for s in sets])[:-1])]
    order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), ids[k]))
    sizes = [len(sets[k]) for k in order]
    lists: dict[int, list[int]] = {}
    forest, out, mark = Forest(), [], np.zeros(len(counts), bool)
    lead: list[tuple[int, int] | None] = [None] * len(order)
    heads: dict[int, int] = {}
    for y, k in enumerate(order if bodies else ()):
        if bodies[k] >= 0:
            forest.union(heads.setdefault(bodies[k], y), y)
    for y, k in enumerate(order):
        r, n = ranks[k], sizes[y]
        prefix = r[: prefix_size(n)]
        prefix = prefix[prefix >= shared_from].tolist()
        if not prefix:
            continue
        smallest = bisect_left(sizes, (3 * n + 3) // 4)  # smaller sets can't link: their block of each list is skipped
        found: set[int] = set()
        for t in prefix:
            own = lists.setdefault(t, [])
            if own and own[-1] >= smallest:
                found.update(own[bisect_left(own, smallest) :] if own[0] < smallest else own)
            own.append(y)
        if not found:
            continue
        known: dict[int, int] = {}
        mark[r] = True
        for x in sorted(found):
            if (blocks is not None and blocks[order[x]] == blocks[k]) or forest.find(x) == forest.find(y):
                continue
            m, sure = sizes[x], False
            if lead[x] is not None and lead[x][0] in known:
                like, common = lead[x]
                if not linked(known[like] + m - common, m, n):
                    continue  # derived: too few in common
                sure = linked(known[like] - (sizes[like] - common), m, n)
            if not sure:
                known[x] = int(np.count_nonzero(mark[ranks[order[x]]]))
            if sure or linked(known[x], m, n):
                forest.union(x, y)
                out.append((ids[order[x]], ids[k]))
                if not sure and lead[y] is None:
                    lead[y] = (x, known[x])
        mark[r] = False
    return out


def _edges(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(np.array(pairs, np.int64).reshape(-1, 2), columns=["a", "b"])


def _verified(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links inside each of the small components of one task."""
    out = []
    for _, group in pdf.groupby("cluster", sort=False):
        if len(group) > 1:
            out += links_within(group["node"].tolist(), [np.frombuffer(x, np.uint64) for x in group["shingles"]])
    return _edges(out)


def _verified_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links inside one block of a large component's rest, or between two blocks."""
    same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
    return _edges(links_within(pdf["node"].tolist(), sets, None if same else pdf["block"].tolist(), pdf["body"].tolist()) if len(sets) > 1 else [])


def _against(members: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Sets of a part of a large component against its pivots: (cluster, node, near: sum of similarities, links)."""
    out = []
    heads = [(p, np.frombuffer(x, np.uint64)) for p, x in zip(pivots["pivot"], pivots["head"], strict=True)]
    for r in members.itertuples():
        s, near, links = np.frombuffer(r.shingles, np.uint64), 0.0, []
        for p, h in heads:
            common = len(np.intersect1d(s, h, assume_unique=True))
            near += common / (len(s) + len(h) - common)
            if p != r.node and linked(common, len(s), len(h)):
                links.append(p)
        out.append((r.cluster, r.node, near, links))
    return pd.DataFrame(out, columns=["cluster", "node", "near", "links"])


def _large(held: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Links of the large components of ``held`` (cluster, blocks, node, shingles), and the tables they read.

    Work is in proportion to the sets, but for the rest that no pivot connects: its blocks meet each other and the body's.
    """
    part = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    big, near, links = held.where("blocks > 1").withColumn("part", part), None, None
    used: list[DataFrame] = []
    for order in (F.xxhash64("node"), F.desc("near")):
        rows = big if near is None else big.join(near, ["cluster", "node"])
        first = F.row_number().over(Window.partitionBy("cluster").orderBy(order, "node"))
        names = rows.select("cluster", "node", "blocks", *(["near"] if near is not None else [])).withColumn("_k", first).where(F.col("_k") <= PIVOTS)
        pivots = big.select("cluster", "node", "shingles").join(names.select("cluster", "node", "blocks"), ["cluster", "node"])
        pivots = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pivots = pivots.select(F.col("cluster").alias("home"), F.col("part").alias("place"), F.col("node").alias("pivot"), F.col("shingles").alias("head"))
        each = big.groupBy("cluster", "part").cogroup(pivots.groupBy("home", "place")).applyInPandas(_against, "cluster long, node long, near double, links array<long>")
        found = stored(each)
        used.append(found)
        near = found.select("cluster", "node", "near")
        more = found.select("cluster", "node", F.explode("links").alias("pivot"))
        links = more if links is None else links.unionByName(more)
    bodies = connected_components(links.select(F.col("node").alias("a"), F.col("pivot").alias("b")), loops=False)
    marked = stored(used[-1].select("cluster", "node").join(bodies.withColumnRenamed("component", "body"), "node", "left"))
    sizes = marked.where("body IS NOT NULL").groupBy("cluster", "body").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("n", "body")).alias("m")).select("cluster", F.col("m.body").alias("main"))
    sets = stored(big.join(marked, ["cluster", "node"]).join(main, "cluster", "left").select("cluster", "node", "shingles", F.coalesce("body", F.lit(-1).cast("long")).alias("body"), F.coalesce(F.col("body") == F.col("main"), F.lit(False)).alias("inside"), "n"))
    count = lambda c: F.ceil(F.greatest(F.count_if(c) / BLOCK, F.sum(F.when(c, F.col("n")).otherwise(0)) / BLOCK_SUM)).cast("int")
    shape = sets.groupBy("cluster").agg(count(~F.col("inside")).alias("rest"), count(F.col("inside")).alias("core"))
    rows = sets.join(shape, "cluster").where("rest > 0")
    own = F.when(F.col("inside"), F.col("rest") + F.pmod(F.xxhash64("node"), F.col("core"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rest"))).cast("int")
    others = F.when(F.col("inside"), F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("core") - 1))
    spread = rows.withColumn("block", own).withColumn("other", F.explode(others))
    spread = spread.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "body", "shingles")
    pairs = spread.groupBy("cluster", "i", "j").applyInPandas(_verified_blocks, "a long, b long")
    return pairs.unionByName(links.select(F.col("node").alias("a"), F.col("pivot").alias("b"))), [*used, marked, sets]


def _sets(bits: np.ndarray):
    """Sets of the documents that may head a candidate set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            may = np.array([zlib.crc32(str(i).encode()) for i in ids], np.int64) % (8 * len(bits))
            part = batch.filter(pa.array((bits[may >> 3] >> (may & 7) & 1).astype(bool)))
            sets = [shingles(x) for x in _binary(part, 1)]
            digests = np.array([digest(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "d1", "d2", "shingles"])

    return run


def _filter_of(members: DataFrame) -> np.ndarray:
    """Bits of the members' ids, in a table of fixed size; it spares most texts, never a member."""
    place = F.crc32(F.col("rep").cast("string").cast("binary")) % (8 * FILTER_BYTES)
    words = members.select(F.floor(place / 32).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int")).alias("m"))
    found = words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    bits = np.zeros(FILTER_BYTES // 4, np.uint32)
    bits[found.column("w").to_numpy()] = found.column("m").to_numpy().astype(np.uint32)
    return bits.view(np.uint8)


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))


def _print(docs: DataFrame) -> Column:
    """Fingerprint of a whole row: its text, then its other columns (those that can be hashed)."""
    others = [F.col(f"`{f.name}`") for f in docs.schema if f.name != "text" and not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.concat(F.md5(F.col("text").cast("string").cast("binary")), F.xxhash64(*others).cast("string"))


def _components(docs: DataFrame, mark: Column) -> tuple[DataFrame, DataFrame]:
    """Facts of each row (doc_id, print, d1, d2, n), and the component of each set that is not empty (d1, d2, rep, print, component).

    ``rep`` and ``print`` are the smallest row of the set. A set is a node of its own, whatever ids its documents have.
    """
    spark = docs.sparkSession
    marked = docs.select(_key().alias("doc_id"), F.col("text").cast("string").alias("text"), mark.alias("print"))
    rows = marked.select("doc_id", "text")
    info = stored(marked.mapInArrow(_facts, "doc_id long, print string, d1 long, d2 long, n long"))
    least = info.where("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "print")).alias("m"), F.max("n").alias("n"))
    reps = stored(least.select("d1", "d2", F.col("m.doc_id").alias("rep"), F.col("m.print").alias("print"), "n", F.monotonically_increasing_id().alias("node")))
    buckets = max(shuffle_partitions(spark), -(-(info.agg(F.sum("n")).first()[0] or 0) // BUCKET_SHINGLES))
    tokens = rows.select("text").mapInArrow(_shingles_by_bucket(buckets), _ROWS)
    shared = tokens.repartition(buckets, "key").groupBy("key").applyInPandas(_shared, _ROWS)
    entries = shared.groupBy("block").applyInPandas(_prefixes(buckets), _ENTRIES)
    edges = stored(entries.groupBy("bucket").applyInPandas(_candidates, "a long, b long"))
    clusters = connected_components(edges, loops=False)

    members = stored(reps.join(clusters.withColumnsRenamed({"node": "d1", "component": "cluster"}), "d1").select("d1", "d2", "rep", "node", "n", "cluster"))
    released(edges)
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SUM)).cast("int").alias("blocks")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), blocks).where("size > 1").drop("size")
    asked = members.join(sizes, "cluster").select("d1", "d2", "rep", "node", "n", "cluster", "blocks")
    sets = rows.mapInArrow(_sets(_filter_of(members)), "rep long, d1 long, d2 long, shingles binary").join(asked, ["d1", "d2", "rep"])
    # Repeated rows bring their set again; the join has dealt them by the same columns.
    once = sets.groupBy("d1", "d2", "rep").agg(*[F.first(c).alias(c) for c in ("node", "n", "cluster", "blocks", "shingles")])
    held = stored(once.select("node", "n", "cluster", "blocks", "shingles"))
    shape = held.agg(F.sum("n"), F.count_if(F.col("blocks") > 1)).first()
    tasks = max(shuffle_partitions(spark), -(-(shape[0] or 0) // TASK_SHINGLES))
    task = F.pmod(F.xxhash64("cluster"), F.lit(tasks)).cast("int")
    small = held.where("blocks = 1").select(task.alias("task"), "cluster", "node", "shingles")
    links, used = small.groupBy("task").applyInPandas(_verified, "a long, b long"), []
    if shape[1]:
        more, used = _large(held)
        links = links.unionByName(more)
    links = stored(links)
    found = connected_components(links, loops=False)
    released(links, held, members, *used)
    return info, reps.join(found, "node", "left").select("d1", "d2", "rep", "print", F.coalesce("component", "node").alias("component"))


def joined(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text)."""
    info, sets = _components(docs, F.lit(""))
    names = sets.join(sets.groupBy("component").agg(F.min("rep").alias("name")), "component").select("d1", "d2", "name")
    out = info.join(names, ["d1", "d2"], "left")

    def shown(c):
        return F.when(c != _NULL_ID, c)

    return out.select(shown(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), shown(F.coalesce("name", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: smallest doc_id, then smallest fingerprint of the row; same columns.

    So which row stays does not depend on how rows are dealt, unless rows are alike in every column. Texts without words
    are linked with nothing, so all their rows stay. The other texts are shuffled once: the semi-join
    and the removal of repeated rows share one key.
    """
    mark, names = _print(docs), spare(docs.columns, "_key", "_print")
    _, sets = _components(docs, mark)
    heads = sets.groupBy("component").agg(F.min(F.struct("rep", "print")).alias("m"))
    heads = stored(heads.select(F.col("m.rep").alias(names[0]), F.col("m.print").alias(names[1])))
    worded = F.coalesce(F.col("text").cast("string").rlike(f"[^{SPACE}]"), F.lit(False))
    kept = docs.where(worded).withColumns(dict(zip(names, (_key(), mark), strict=True))).join(heads, names, "left_semi")
    return kept.dropDuplicates(names).select(*[F.col(f"`{c}`") for c in docs.columns]).unionAll(docs.where(~worded))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(x, k) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, r.k FROM reach r JOIN e ON e.x = r.x),
m AS (SELECT x AS doc_id, min(k) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

ship(__name__)
