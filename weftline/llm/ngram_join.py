"""N-gram Jaccard join by chosen paths.

A text's set holds the hashes of its n-grams of words (lower-cased, see
``common.words``); a text of fewer than n words has one gram of all of them.
Texts with equal sets form one node.  Each set is embedded as ``HASHES`` minwise
samples.  A run starts at a root that chooses two of the samples; sets that share
a chosen sample meet in a bucket.  Buckets of more than ``LEAF`` sets choose two
samples again, each by its own seed, as often as it takes; small ones are searched
by brute force.  From level ``SURE`` on, a bucket whose sets resemble one another
on average by nearly the threshold is searched by brute force too: its pairs are
mostly results, and splitting it would only repeat them.  Runs repeat until a pair
at the threshold is found with probability ``recall``, further ones for the sets
whose paths went deeper; more similar pairs are found more surely.  In a leaf, pairs
pass a filter on sample agreement and then are verified exactly on whole texts.
Every pair is verified in the first leaf that both its sets are in, so that links
can be counted where they are found: no pair is ever shuffled, only each node's
link count and one edge to a neighbour.

Defined cases: texts without words, such as punctuation only, are compared as whole
texts: they equal their exact copies and resemble nothing else; a null text is an
empty one; a null doc_id counts as -2**63; rows that repeat are separate documents,
linked as copies; an empty table gives an empty result; columns of any name pass.

Scale: buckets hold (bucket, set digest).  A leaf that stays larger than ``BLOCK``
sets, or, where texts are read, ``BLOCK_GRAMS``, is split into blocks, and each pair
of blocks is a task's group; nothing is cut off.  Lookups by a hot bucket, digest,
vertex or label broadcast only keys with more than a thousandth of all rows.  Texts
that share no candidate pair stay where they are, by a Bloom filter of bounded size;
the others move once to their candidates and then to the leaves that own one of their pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, give_back, held_by, lower, mix64, packed, salted_lookup, saved, sliced, span_hashes, texts, unpacked, words

HASHES = 64
LEAF = 256
BLOCK = 512
#: Grams that the sets of one block should hold where their texts are read.
BLOCK_GRAMS = 2_000_000
#: Levels that are split by size alone, and how near a bucket's mean similarity must come to the threshold below them.
SURE = 3
NEAR = 0.8
#: Sets of a bucket whose pairs show its mean similarity.
SAMPLE = 64
BRANCH = 2
_NO_ID = -(2**63)
_rng = np.random.default_rng(5)
_A = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_MULT = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def gram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 48-bit gram hashes of all rows, end to end, and each row's offset in them."""
    data, off = texts(column)
    rows = len(off) - 1
    start, end, row = words(data, off)
    h = span_hashes(lower(data), start, end)
    count = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    gram = np.zeros(len(h), np.uint64)
    for k in range(n):
        gram[: len(h) - k] += h[k:] * _MULT[k] if k else h * _MULT[0]
    keep = np.zeros(len(h), bool)
    inside = np.arange(len(h)) - first[row]
    keep[inside + n <= count[row]] = True
    # rows of fewer than n words: one gram that sums all of them by place
    short = (count < n) & (count > 0)
    if short.any():
        in_short = short[row]
        place = inside[in_short]
        sums = np.zeros(rows, np.uint64)
        np.add.at(sums, row[in_short], h[in_short] * _MULT[place])
        gram[first[short]] = sums[short] + np.uint64(1)
        keep[first[short]] = True
    gram, row = mix64(gram[keep]) >> np.uint64(16), row[keep]
    key = np.sort((row.astype(np.uint64) << np.uint64(48)) | gram)
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    sizes = np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=rows)
    return key & np.uint64((1 << 48) - 1), np.concatenate(([0], np.cumsum(sizes)))


def minwise(grams: np.ndarray, off: np.ndarray) -> np.ndarray:
    """rows x HASHES samples; rows without grams are all 0."""
    out = np.zeros((len(off) - 1, HASHES), np.uint32)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        g = (grams ^ (grams >> np.uint64(16))).astype(np.uint32)
        at = off[full]
        for i in range(HASHES):
            out[full, i] = np.minimum.reduceat(g * _A[i] + _B[i], at)
    return out


def _small(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, column):
        for at in range(0, b.num_rows, 60_000):  # row numbers take 16 bits of a sort key
            yield b.slice(at, 60_000)


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches, "text"):
            grams, off = gram_sets(batch.column(2), n)
            sig = minwise(grams, off)
            raw = grams.astype("<u8").tobytes()
            digests = [hashlib.blake2b(raw[a * 8 : b * 8], digest_size=16).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            data, at = texts(batch.column(2))
            for r in np.flatnonzero(np.diff(off) == 0).tolist():  # no words: the text itself is compared
                digests[r] = hashlib.blake2b(data[at[r] : at[r + 1]].tobytes(), digest_size=16, person=b"text").digest()
            columns = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(np.diff(off).astype(np.int32)), pa.array([x.tobytes() for x in sig], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "digest", "grams", "sig"])

    return run


def runs_for(threshold: float, recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met in a leaf of that depth with probability ``recall``."""
    f = 1.0
    for _ in range(depth):
        f = 1 - (1 - threshold * f) ** BRANCH
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - f))) if f < 1 else 1


def _choice(node: np.ndarray) -> np.ndarray:
    """len(node) x BRANCH numbers of samples that each node chooses by its seed."""
    h = mix64(node[:, None] ^ mix64(np.arange(HASHES, dtype=np.uint64) + np.uint64(1)))
    return np.argpartition(h, BRANCH, 1)[:, :BRANCH]


def _children(node: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """len(node) x BRANCH buckets below each node that the set goes to."""
    pick = _choice(node)
    value = np.take_along_axis(sig, pick, 1).astype(np.uint64)
    return mix64(mix64(node[:, None] + pick.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ value)


def _sig_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _root(first: int, last: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix64(np.arange(first, last, dtype=np.uint64) + np.uint64(77))
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _sig_matrix(batch.column(1))
            out = np.concatenate([_children(np.full(len(sig), r), sig) for r in roots], 1)
            index = pa.array(np.repeat(np.arange(len(sig)), out.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).view(np.int64)), batch.column(0).take(index)], names=["bucket", "digest"])

    return run


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = _sig_matrix(batch.column(2))
        out = _children(batch.column(0).to_numpy().view(np.uint64), sig)
        index = pa.array(np.repeat(np.arange(len(sig)), BRANCH))
        yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).view(np.int64)), batch.column(1).take(index)], names=["bucket", "digest"])


def _resemblance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket and the mean agreement of its sampled sets' signatures."""
    for batch in _groups(batches, 1):
        bucket, sig = batch.column(0).to_numpy(), _sig_matrix(batch.column(1))
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        last = np.concatenate((first[1:], [len(bucket)]))
        mean = []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            n = b - a
            same = sum(int((np.unique(c, return_counts=True)[1].astype(np.int64) ** 2).sum()) for c in sig[a:b].T)
            mean.append((same / HASHES - n) / (n * (n - 1)) if n > 1 else 1.0)
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(mean, pa.float64())], names=["bucket", "mean"])


def _grow(sigs: DataFrame, first: int, last: int, threshold: float) -> tuple[list[DataFrame], DataFrame | None, int]:
    """Leaves (bucket, digest, n) of the runs from ``first`` to ``last``, the sets that went beyond ``SURE``, and the depth."""
    rows = sigs.mapInArrow(_root(first, last), "bucket long, digest binary")
    done, deep, level = [], None, 1
    while True:
        rows = saved(rows, f"paths-{level}")
        total = rows.count()
        counts = saved(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").withColumn("n", F.col("rows")), f"sizes-{level}")
        sized = saved(salted_lookup(rows, counts, ["bucket"], "rows", total).where("n is not null"), f"sized-{level}")
        done.append(sized.where(F.col("n") <= LEAF))
        if not counts.where(F.col("n") > LEAF).limit(1).count():
            return done, deep, level
        big = sized.where(F.col("n") > LEAF).join(sigs, "digest").select("bucket", "digest", "sig", "n")
        if level >= SURE:
            big = saved(big, f"big-{level}")
            few = big.where(F.pmod(F.xxhash64("digest", "bucket"), F.col("n")) < SAMPLE).select("bucket", "sig")
            mean = few.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_resemblance, "bucket long, mean double")
            mean = counts.where(F.col("n") > LEAF).select("bucket", "rows").join(mean, "bucket")
            big = salted_lookup(big, saved(mean, f"means-{level}"), ["bucket"], "rows", total)
            alike = F.coalesce(F.col("mean") >= NEAR * threshold, F.lit(False))
            done.append(big.where(alike).select("bucket", "digest", "n"))
            big = saved(big.where(~alike), f"apart-{level}")
            if not big.limit(1).count():
                return done, deep, level
            deep = big.select("digest") if deep is None else deep.unionByName(big.select("digest"))
        rows = big.select("bucket", "digest", "sig").mapInArrow(_descend, "bucket long, digest binary")
        level += 1


def leaves(sets: DataFrame, threshold: float, recall: float) -> DataFrame:
    """bucket, digest, n: leaf buckets of two or more sets and how many they hold."""
    sigs = sets.where("grams > 0").select("digest", "sig")
    runs = runs_for(threshold, recall, SURE)
    done, deep, level = _grow(sigs, 0, runs, threshold)
    if deep is not None:  # longer paths part more pairs, so their sets take more runs
        more = runs_for(threshold, recall, level)
        done += _grow(sigs.join(saved(deep.distinct(), "deep"), "digest", "left_semi"), runs, more, threshold)[0]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int = 3, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Join sorted batches into pieces of whole groups; the first ``keys`` columns name a group."""
    held: list[pa.RecordBatch] = []
    size = 0

    def piece(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < most:
            continue
        whole = piece(held)
        cols = [whole.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        same = np.ones(whole.num_rows - 1, bool)
        for c in cols:
            same &= c[1:] == c[:-1]
        borders = np.flatnonzero(~same)
        if len(borders):
            at = int(borders[-1]) + 1
            yield whole.slice(0, at)
            held = [whole.slice(at)]
        else:
            held = [whole]
        size = held[0].nbytes if len(borders) == 0 else 0
    if held:
        yield piece(held)
        held.clear()
    give_back()


def _nibbles(sig: np.ndarray) -> np.ndarray:
    """rows x HASHES / 16 words of four bits of every sample."""
    four = ((sig * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint64).reshape(len(sig), -1, 16)
    return np.bitwise_or.reduce(four << (np.uint64(4) * np.arange(16, dtype=np.uint64)), 2)


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many nibbles are equal."""
    d = x ^ y
    d |= d >> np.uint64(2)
    d |= d >> np.uint64(1)
    return HASHES - np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            small = [x.tobytes() for x in _nibbles(_sig_matrix(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(small, pa.binary())], names=["digest", "grams", "sketch"])


class _Lists:
    """Lists of numbers, end to end; which of several lists' elements another list holds is one lookup in a table of marks."""

    def __init__(self, off: np.ndarray, flat: np.ndarray):
        self.off, self.size = off, np.diff(off)
        self.values, dense = np.unique(flat, return_inverse=True)
        self.dense = dense.astype(np.int32).reshape(-1)
        self.mark = np.zeros(len(self.values), bool)

    def held(self, a: int, others: np.ndarray) -> np.ndarray:
        """How many elements of each of ``others`` list ``a`` holds."""
        size = self.size[others]
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(self.off[others] - first, size)
        own = self.dense[self.off[a] : self.off[a + 1]]
        self.mark[own] = True
        hit = np.concatenate(([0], np.cumsum(self.mark[self.dense[at]])))
        self.mark[own] = False
        return hit[first + size] - hit[first]


def _by_first(i: np.ndarray, j: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each distinct i, its js, and their places, in parts whose lists (of ``size``) hold about ``most`` elements."""
    order = np.argsort(i, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], i[order][1:] != i[order][:-1]))).tolist() if len(i) else []
    for a, b in zip(cuts, [*cuts[1:], len(i)], strict=True):
        held = np.cumsum(size[j[order[a:b]]])
        while a < b:
            to = a + max(1, int(np.searchsorted(held, most, "right")))
            at = order[a:to]
            yield int(i[at[0]]), j[at], at
            held = held[to - a :] - held[to - a - 1]
            a = to


def _pairs(batch: pa.RecordBatch, threshold: float, slack: float, owned: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of candidate pairs within the groups of a piece; with ``owned``, of those whose first bucket it is."""
    bucket, lo, hi = (batch.column(i).to_numpy() for i in range(3))
    blk, grams = batch.column(4).to_numpy(), batch.column(5).to_numpy()
    sketch = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(len(bucket), -1)
    new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate((first, [len(bucket)])))
    out_i, out_j = [], []
    least = (threshold + (1 - threshold) / 16 - slack) * HASHES  # nibbles agree by chance once in 16

    def test(i: np.ndarray, j: np.ndarray) -> None:
        ok = (np.minimum(grams[i], grams[j]) >= threshold * np.maximum(grams[i], grams[j])) & ((lo[i] == hi[i]) | (blk[i] != blk[j]))
        i, j = i[ok], j[ok]
        for at in range(0, len(i), 200_000):
            a, b = i[at : at + 200_000], j[at : at + 200_000]
            good = _agreement(sketch[a], sketch[b]) >= least
            out_i.append(a[good])
            out_j.append(b[good])

    for g in np.unique(size):  # all groups of one size at a time
        if g < 2:
            continue
        at = first[size == g]
        x, y = np.triu_indices(int(g), 1)
        step = max(1, 500_000 // len(x))
        for k in range(0, len(at), step):
            test((at[k : k + step, None] + x).reshape(-1), (at[k : k + step, None] + y).reshape(-1))
    i, j = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (out_i, out_j))
    if not len(i) or not owned:
        return i, j
    # a pair belongs to the least bucket that both are in: they share none of their earlier ones
    earlier = batch.column(7)
    lists = _Lists(earlier.offsets.to_numpy().astype(np.int64) - earlier.offsets[0].as_py(), earlier.flatten().to_numpy())
    own = np.ones(len(i), bool)
    for a, others, at in _by_first(i, j, lists.size):
        own[at] = lists.held(a, others) == 0
    return i[own], j[own]


_MEMBER = "bucket long, lo int, hi int, digest binary, blk int, grams int, sketch binary"


def _placed(rows: DataFrame, blocks: Column, carry: list[str]) -> DataFrame:
    """Rows (bucket, digest, grams, sketch, ``carry``) sorted in groups of (bucket, lo, hi): each pair of a bucket's blocks is one."""
    rows = rows.withColumn("blocks", F.greatest(blocks, F.lit(1)).cast("int")).withColumn("blk", F.pmod(F.xxhash64("digest"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("bucket", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "digest", "blk", "grams", "sketch", *carry)
    return rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")


def _partners(threshold: float, slack: float, owned: bool, keep: tuple[str, ...]):
    """``keep`` columns of the rows that have a candidate pair in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            i, j = _pairs(batch, threshold, slack, owned)
            if len(i):
                yield batch.select(keep).take(pa.array(np.unique(np.concatenate((i, j)))))

    return run


def _verify(threshold: float, slack: float, n: int):
    """Exact links within groups: digest, links (documents), root (one linked or transitively linked set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches):
            i, j = _pairs(batch, threshold, slack, True)
            if not len(i):
                continue
            rows = np.unique(np.concatenate((i, j)))
            parts, sizes = [], np.zeros(batch.num_rows, np.int64)
            for part in _small([pa.RecordBatch.from_arrays([pa.array(rows), batch.column(9).take(pa.array(rows))], names=["row", "text"])], "text"):
                grams, off = gram_sets(part.column(1), n)
                parts.append(grams)
                sizes[part.column(0).to_numpy()] = np.diff(off)
            sets = _Lists(np.concatenate(([0], np.cumsum(sizes))), np.concatenate(parts))
            docs = batch.column(8).to_numpy()
            linked = np.zeros(len(i), bool)
            for a, others, at in _by_first(i, j, sizes):
                shared = sets.held(a, others)
                linked[at] = shared >= threshold * (sizes[a] + sizes[others] - shared)
            i, j = i[linked], j[linked]
            if not len(i):
                continue
            links = np.zeros(batch.num_rows, np.int64)
            np.add.at(links, i, docs[j])
            np.add.at(links, j, docs[i])
            root = np.arange(batch.num_rows)  # least row of each component: labels fall along links until none changes
            while True:
                low = np.minimum(root[i], root[j])
                before = root.copy()
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
                root = root[root]
                if (root == before).all():
                    break
            found = np.flatnonzero(links)
            digests = batch.column(3)
            yield pa.RecordBatch.from_arrays([digests.take(pa.array(found)), pa.array(links[found]), digests.take(pa.array(root[found]))], names=["digest", "links", "root"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """digest, label: the least digest that each vertex of (digest, root) edges is connected to.

    Labels spread along edges and then along themselves, so that chains halve at
    every round; every round's table is written, which cuts lineage.  Vertices of many
    edges and labels of many vertices are looked up by broadcast, so none is a hot task.
    """
    both = edges.select(F.col("digest").alias("a"), F.col("root").alias("b")).where("a <> b")
    both = saved(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    total = both.count()
    label = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"), F.count(F.lit(1)).alias("degree")), "labels")
    vertices = label.count()
    while True:
        near = salted_lookup(both, label.select(F.col("a").alias("b"), F.col("label").alias("theirs"), "degree"), ["b"], "degree", total)
        near = near.groupBy("a").agg(F.min("theirs").alias("theirs"))
        spread = label.join(near, "a").select("a", "degree", F.least("label", "theirs").alias("label"), F.col("label").alias("old"))
        held = spread.groupBy("label").agg(F.count(F.lit(1)).alias("held"))
        far = held.join(label.select(F.col("a").alias("label"), F.col("label").alias("beyond")), "label")
        spread = salted_lookup(spread, far, ["label"], "held", vertices)
        spread = saved(spread.select("a", "degree", F.least("label", F.coalesce("beyond", "label")).alias("label"), "old"), "labels")
        label = spread.select("a", "label", "degree")
        if not spread.where("label <> old").limit(1).count():
            return label.select(F.col("a").alias("digest"), "label")


def similarity_classes(docs: DataFrame, n: int = 3, threshold: float = 0.5, recall: float = 0.99, slack: float = 0.25) -> DataFrame:
    """doc_id, th, class_id, class_th, set_id, n_grams, n_links: one row per row of ``docs``.

    Documents are linked if their sets' Jaccard similarity is at least ``threshold``.
    ``n_links`` counts a document's links, copies included.  A class is a connected
    component; its id is its least doc_id.  ``th`` hashes the text; (class_id,
    class_th) name the row that represents the class.  ``set_id`` is equal just for
    equal sets.  ``slack``: how far sample agreement may fall short of the threshold
    before exact verification is spared; four standard deviations.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    rows = saved(keyed.mapInArrow(_signatures(n), "doc_id long, th long, digest binary, grams int, sig binary"), "signatures")
    sets = saved(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("doc_id", "th")).alias("rep"), F.first("grams").alias("grams"), F.first("sig").alias("sig")), "sets")
    small = sets.where("grams > 0").select("digest", "grams", "sig").mapInArrow(_sketches, "digest binary, grams int, sketch binary")
    # sketches alone first: which sets of a leaf have a candidate there
    member = leaves(sets, threshold, recall).join(small, "digest")
    blocks = F.when(F.col("n") > BLOCK, F.ceil(F.col("n") / BLOCK)).otherwise(1)
    met = _placed(member, blocks, ["n"]).mapInArrow(_partners(threshold, slack, False, ("bucket", "digest", "n")), "bucket long, digest binary, n long")
    # then which leaf owns their pairs: the first that both are in
    mine = saved(met, "met").groupBy("digest").agg(F.sort_array(F.collect_set(F.struct("bucket", "n"))).alias("mine"))
    mine = mine.join(small, "digest").join(sets.select("digest", "docs", "rep"), "digest")
    mine = saved(mine.select("digest", "grams", "sketch", "docs", "rep.doc_id", "rep.th", "mine"), "mine")
    placed = mine.select("*", F.posexplode("mine").alias("at", "leaf"))
    placed = placed.select("digest", "grams", "sketch", "docs", "doc_id", "th", "leaf.bucket", "leaf.n", F.expr("transform(slice(mine, 1, at), x -> x.bucket)").alias("earlier"))
    near = _placed(placed, blocks, ["earlier"])
    near = near.mapInArrow(_partners(threshold, slack, True, ("bucket", "digest", "grams")), "bucket long, digest binary, grams int")
    near = saved(saved(near, "near").distinct(), "owners")
    # whole texts of these alone, where their first document lies
    sizes = near.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("grams").alias("total")).withColumn("n", F.col("rows"))
    near = salted_lookup(near, sizes, ["bucket"], "rows", near.count()).select("bucket", "digest", F.col("n").alias("m"), "total")
    near = placed.join(near, ["digest", "bucket"])
    need = mine.join(near.select("digest").distinct(), "digest", "left_semi").select("doc_id", "th")
    text = keyed.where(held_by(need, ["doc_id", "th"])).dropDuplicates(["doc_id", "th"])
    full = _placed(near.join(text, ["doc_id", "th"]), F.ceil(F.greatest(F.col("m") / BLOCK, F.col("total") / BLOCK_GRAMS)), ["earlier", "docs", "text"])
    found = saved(full.mapInArrow(_verify(threshold, slack, n), "digest binary, links long, root binary"), "links")
    linked = found.groupBy("digest").agg(F.sum("links").alias("links")).join(components(found.select("digest", "root")), "digest", "left")
    known = sets.select("digest", "docs", "rep").join(linked, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    known = saved(known, "nodes")
    heads = known.groupBy("label").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("nodes"))
    known = salted_lookup(known, heads, ["label"], "nodes", known.count())
    known = known.select("digest", "docs", F.col("head.doc_id").alias("class_id"), F.col("head.th").alias("class_th"), (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = salted_lookup(rows.select("doc_id", "th", "digest", "grams"), known, ["digest"], "docs", rows.count())
    real = F.when(F.col("doc_id") != _NO_ID, F.col("doc_id"))
    return out.select(real.alias("doc_id"), "th", "class_id", "class_th", F.lower(F.hex("digest")).alias("set_id"), F.col("grams").alias("n_grams"), "n_links")


def one_per_class(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that represent their classes, unchanged: those of least doc_id.

    Rows that repeat a representative's doc_id and text give one of them.
    """
    kept = similarity_classes(docs, **options).select(F.col("class_id").alias("id"), F.col("class_th").alias("th")).distinct()
    keyed = docs.select(F.coalesce(col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(F.coalesce(col("text"), F.lit(""))).alias("th"), packed(docs))
    return unpacked(keyed.join(kept, ["id", "th"], "left_semi").dropDuplicates(["id", "th"]), docs)
