"""Toxic spans by a linear-chain conditional random field.

Tokens are words (see ``common.words``), lower-cased; their features are the word
and its prefixes of 3 to 6 bytes, hashed.  The chain has two states.  Labels of
tokens come from labelled documents: in a toxic document, tokens that carry a
feature which only toxic documents hold more often than chance allows are toxic,
all others aren't.  The field is fitted on windows of such sequences; documents
are scored from its forward-backward marginals: the evidence -sum log(1 - p) and
the largest marginal go through a logistic map that is fitted on whole documents.

Defined cases: a null or empty text has no tokens and gets the score of no
evidence; a null doc_id is held out, as its text is empty, with remainder 0;
several labels of one doc_id count as toxic if any is; without a labelled
document of each class the score is the smoothed share of toxic labels.  Scores
depend on the text alone.

Scale: the fit reads at most ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled documents
(chosen by a hash of the doc_id), whatever the size of the corpus, within
``MOST_TOXIC_BYTES`` and ``MOST_CLEAN_BYTES`` of text.  Where a class has more, its
longest texts give excerpts of equal size, so that none drops out for another's
length.  One task fits, so that the driver's memory holds no texts; the field comes
back to it.  Scoring is one pass without a shuffle, with 4 MB of weights broadcast.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import code_points, give_back, lower, mix64, sliced, span_hashes, texts, words
from .ngram_join import gram_sets, minwise

#: Labelled documents of each class that the fit may read, and their bytes.
MOST_TOXIC, MOST_TOXIC_BYTES = 1500, 4 << 20
MOST_CLEAN, MOST_CLEAN_BYTES = 4500, 12 << 20
#: Bytes of one window of an excerpt, and the least that a text may be cut to.
EXCERPT, LEAST_BYTES = 512, 2048
BITS = 20
WINDOW = 32
PREFIXES = (3, 4, 5, 6)
_CLIP = 15.0


@dataclass
class Field:
    """Weights by feature slot, transition odds, and the document-level logistic map."""

    weights: np.ndarray  # 2 ** BITS, float32
    bias: float
    move: np.ndarray  # 2 x 2 potentials, from state x to state
    doc: np.ndarray  # intercept, evidence, top marginal

    def emissions(self, slots: list[np.ndarray]) -> np.ndarray:
        total = np.full(len(slots[0]), self.bias)
        for s in slots:
            total += self.weights[s]
        return np.exp(np.clip(total, -_CLIP, _CLIP))


def token_features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Hash slots of each token: the word, then one array for each prefix length.

    A prefix as long as the word or longer falls on the word itself.
    """
    mask = np.uint64((1 << BITS) - 1)
    size = end - start
    out = [(span_hashes(data, start, end) & mask).astype(np.int32)]
    longest = max(PREFIXES)
    padded = np.concatenate((data, np.zeros(longest, np.uint8)))
    code = np.zeros(len(start), np.uint64)
    for k in range(longest):
        byte = padded[start + k].astype(np.uint64)
        code = np.where(k < size, code * np.uint64(257) + byte + np.uint64(1), code)
        if k + 1 in PREFIXES:
            out.append((mix64(code + np.uint64((k + 1) << 56)) & mask).astype(np.int32))
    return out


def _chunks(row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For tokens sorted by row: chunk and place of each, and each row's first chunk and count."""
    n = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    inside = np.arange(len(row)) - first[row]
    count = -(-n // WINDOW)
    at = np.concatenate(([0], np.cumsum(count)))[:-1]
    return at[row] + inside // WINDOW, inside % WINDOW, at, count


def marginals(e: np.ndarray, row: np.ndarray, rows: int, move: np.ndarray) -> np.ndarray:
    """P(toxic) of each token; ``e`` are emission odds, ``row`` is sorted."""
    return messages(e, row, rows, move)[0]


def transitions(before: np.ndarray, e: np.ndarray, after: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Expected number of steps from state to state: sums of the pairwise marginals of neighbours."""
    (oo, ot), (to, tt) = move
    right = e * after
    pairs = [np.full(len(e), oo), ot * right, to * before, tt * before * right]
    total = sum(pairs)
    return np.array([float((x / total).sum()) for x in pairs]).reshape(2, 2)


def messages(e: np.ndarray, row: np.ndarray, rows: int, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of each token, and what reaches it from before and from after, as odds of state 1.

    Forward-backward in ratio form.  Rows are cut into chunks of WINDOW tokens that
    run in step: first each chunk's transfer matrix, then the chain of chunks, then
    the tokens inside.  A virtual token of state 0 precedes every row.
    """
    if len(e) == 0:
        return np.zeros(0), np.zeros(0), np.zeros(0)
    chunk, place, first, count = _chunks(row, rows)
    total = int(count.sum())
    odds = np.ones((WINDOW, total))
    there = np.zeros((WINDOW, total), bool)
    odds[place, chunk], there[place, chunk] = e, True
    (oo, ot), (to, tt) = move
    p00, p01, p10, p11 = np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)
    for k in range(WINDOW):
        on = there[k]
        n00, n01 = oo * p00 + to * p10, oo * p01 + to * p11
        n10, n11 = odds[k] * (ot * p00 + tt * p10), odds[k] * (ot * p01 + tt * p11)
        p00, p01, p10, p11 = np.where(on, n00, p00), np.where(on, n01, p01), np.where(on, n10, p10), np.where(on, n11, p11)
    # rows by falling length: in step k, only a prefix of them still has a k-th chunk
    order = np.argsort(-count, kind="stable")
    most = int(count.max())
    alive = np.searchsorted(-count[order], -np.arange(most), "left")  # rows with more than k chunks
    enter, leave = np.zeros(total), np.ones(total)
    r = np.zeros(rows)
    for k in range(most):
        c = first[order[: alive[k]]] + k
        enter[c] = r[: alive[k]]
        r[: alive[k]] = (p10[c] + p11[c] * r[: alive[k]]) / (p00[c] + p01[c] * r[: alive[k]])
    b = np.ones(rows)
    for k in range(most - 1, -1, -1):
        c = first[order[: alive[k]]] + k
        leave[c] = b[: alive[k]]
        b[: alive[k]] = (p01[c] + p11[c] * b[: alive[k]]) / (p00[c] + p10[c] * b[: alive[k]])
    ratio, left, right = (np.empty((WINDOW, total)) for _ in range(3))
    r = enter
    for k in range(WINDOW):
        left[k] = r
        r = np.where(there[k], odds[k] * (ot + tt * r) / (oo + to * r), r)
        ratio[k] = r
    b = leave
    for k in range(WINDOW - 1, -1, -1):
        ratio[k] *= b
        right[k] = b
        x = odds[k] * b
        b = np.where(there[k], (to + tt * x) / (oo + ot * x), b)
    m = ratio[place, chunk]
    return m / (1 + m), left[place, chunk], right[place, chunk]


def _document_evidence(p: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """rows x 3: one, log evidence, logit of the largest marginal."""
    p = np.minimum(p, 1 - 1e-9)
    total = np.bincount(row, -np.log1p(-p), minlength=rows)
    top = np.full(rows, 1e-6)
    np.maximum.at(top, row, p)
    return np.stack([np.ones(rows), np.log(total + 1e-4), np.clip(np.log(top / (1 - top)), -12, 12)], 1)


def _unlike(labelled: list[tuple[str, bool]], least: int = 32) -> list[tuple[str, bool]]:
    """The first of every group of near copies of one class, as copies aren't independent evidence.

    Copies agree with an earlier text of their class in ``least`` of 64 minwise samples of 3-grams.
    """
    kept: list[tuple[str, bool]] = []
    seen = {c: np.zeros((sum(y == c for _, y in labelled), 64), np.uint32) for c in (False, True)}
    count = {False: 0, True: 0}
    for batch in sliced([pa.RecordBatch.from_arrays([pa.array([x for x, _ in labelled], pa.large_string()), pa.array(range(len(labelled)))], names=["text", "n"])]):
        grams, off = gram_sets(batch.column(0), 3)
        for n, sample in zip(batch.column(1).to_pylist(), minwise(grams, off), strict=True):
            c = labelled[n][1]
            if ((seen[c][: count[c]] == sample).sum(1) < least).all():
                seen[c][count[c]] = sample
                count[c] += 1
                kept.append(labelled[n])
    return kept


def _indicative(slots: list[np.ndarray], row: np.ndarray, toxic: np.ndarray, odds: float) -> np.ndarray:
    """True for slots whose share of toxic documents is beyond chance, tested as often as there are slots.

    ``odds``: how many times a toxic document of the sample counts against a clean one in the whole.
    """
    d1, d0 = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for lo, hi in _pieces(row):
        for s in slots:
            pairs = np.unique(row[lo:hi].astype(np.int64) << BITS | s[lo:hi])
            slot, yes = pairs & ((1 << BITS) - 1), toxic[pairs >> BITS]
            np.add.at(d1, slot[yes], 1)
            np.add.at(d0, slot[~yes], 1)
    n, base = d1 + d0, toxic.mean()
    used = int((n > 0).sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        share = d1 / n
        gain = n * (np.where(d1 > 0, share * np.log(share / base), 0) + np.where(d0 > 0, (1 - share) * np.log((1 - share) / (1 - base)), 0))
    # beside the test, most documents of the whole that hold the feature are toxic
    return (n > 0) & (share > base) & (d1 * odds > d0) & (gain > np.log(used + 1.0))


def _pieces(seq: np.ndarray, most: int = 1 << 17) -> list[tuple[int, int]]:
    """Cuts of a sorted array into ranges of about ``most`` places that split no value."""
    cuts = [0]
    while cuts[-1] < len(seq):
        at = min(cuts[-1] + most, len(seq))
        cuts.append(len(seq) if at == len(seq) else max(int(np.searchsorted(seq, seq[at])), int(np.searchsorted(seq, seq[cuts[-1]], "right"))))
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def expected(e: np.ndarray, seq: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and expected transitions of all sequences, a range at a time, so that little memory is held.

    What is observed less these is the gradient of the log likelihood by the logs of emissions and of ``move``.
    """
    out, steps = np.empty(len(e)), np.zeros((2, 2))
    for lo, hi in _pieces(seq):
        own = seq[lo:hi] - seq[lo]
        out[lo:hi], before, after = messages(e[lo:hi], own, int(own[-1]) + 1, move)
        steps += transitions(before, e[lo:hi], after, move)
    return out, steps


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = ridge * np.array([0.01, *[1.0] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - penalty * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(labelled: list[tuple[str, bool]], totals: tuple[int, int] | None = None, rounds: int = 40) -> Field:
    """Fit on (text, toxic) pairs; ``totals`` are the true counts of clean and toxic labels."""
    clean_n, toxic_n = totals or (sum(not y for _, y in labelled), sum(bool(y) for _, y in labelled))
    labelled = _unlike(labelled)
    toxic = np.array([y for _, y in labelled], bool)
    prior = np.log((toxic_n + 0.5) / (clean_n + 0.5))
    nothing = Field(np.zeros(1 << BITS, np.float32), -_CLIP, np.array([[1.0, 1.0], [1.0, 1.0]]), np.array([prior, 0.0, 0.0]))
    if not toxic.any() or toxic.all():
        return nothing
    parts, rows, base = [], [], 0
    for batch in sliced([pa.RecordBatch.from_arrays([pa.array([x for x, _ in labelled], pa.large_string())], names=["text"])]):
        data, off = texts(batch.column(0))
        data = lower(data)
        start, end, row = words(data, off)
        parts.append(token_features(data, start, end))
        rows.append((row + base).astype(np.int32))
        base += batch.num_rows
    row = np.concatenate(rows)
    slots = [np.concatenate(x) for x in zip(*parts, strict=True)]
    del parts, rows
    odds = toxic_n / toxic.sum() / (max(clean_n, 1) / (~toxic).sum())
    sure = _indicative(slots, row, toxic, odds)
    y = np.zeros(len(row), bool)
    for s in slots:
        y |= sure[s]
    y &= toxic[row]
    if not y.any():
        return nothing
    # windows: all that hold toxic tokens, and three times as many of clean documents
    chunk, place, _, count = _chunks(row, len(toxic))
    has = np.bincount(chunk, y, minlength=int(count.sum())) > 0
    clean = np.repeat(~toxic, count)
    pick = mix64(np.arange(len(clean), dtype=np.uint64))
    pick[~clean] = np.iinfo(np.uint64).max
    wanted = has.copy()
    wanted[np.argsort(pick, kind="stable")[: min(int(clean.sum()), 3 * int(has.sum()) + 100)]] = True
    use = wanted[chunk]
    where = chunk[use]
    seq = np.cumsum(np.concatenate(([0], where[1:] != where[:-1])))
    s, t = [x[use] for x in slots], y[use]
    del chunk, place, use, where
    # features compacted to those in use
    used = np.zeros(1 << BITS, bool)
    for x in s:
        used[x] = True
    ids, at = np.flatnonzero(used), (np.cumsum(used) - 1).astype(np.int32)
    flat = [at[x] for x in s]
    del s
    w, bias, move = np.zeros(len(ids)), -4.0, np.zeros((2, 2))
    g_w, g_b, g_m = np.full(len(ids), 1e-3), 1e-3, np.full((2, 2), 1e-3)
    before = np.concatenate(([False], t[:-1]))
    before[np.concatenate(([True], seq[1:] != seq[:-1]))] = False
    seen = np.array([[np.sum(~before & ~t), np.sum(~before & t)], [np.sum(before & ~t), np.sum(before & t)]], float)
    for _ in range(rounds):
        total = np.full(len(t), bias)
        for f in flat:
            total += w[f]
        p, due = expected(np.exp(np.clip(total, -_CLIP, _CLIP)), seq, np.exp(move))
        gap = t - p
        gradient = np.zeros(len(ids))
        for f in flat:
            gradient += np.bincount(f, gap, minlength=len(ids))
        gradient -= 0.05 * w
        g_w += gradient**2
        w += 0.5 * gradient / np.sqrt(g_w)
        b = gap.sum()
        g_b += b * b
        bias += 0.5 * b / np.sqrt(g_b)
        step = (seen - due) - 0.05 * move
        g_m += step**2
        move = np.clip(move + 0.2 * step / np.sqrt(g_m), -3, 3)
    weights = np.zeros(1 << BITS, np.float32)
    weights[ids] = w
    field = Field(weights, float(bias), np.exp(move), np.zeros(3))
    parts, step = [], 256  # documents at a time
    for a in range(0, len(toxic), step):
        lo, hi = np.searchsorted(row, (a, a + step))
        own, n = row[lo:hi] - a, min(step, len(toxic) - a)
        parts.append(_document_evidence(marginals(field.emissions([x[lo:hi] for x in slots]), own, n, field.move), own, n))
    x = np.concatenate(parts)
    balance = np.where(toxic, toxic_n / toxic.sum(), clean_n / (~toxic).sum())
    field.doc = _fit_logistic(x, toxic.astype(float), balance)
    return field


def score_texts(column: pa.Array, field: Field, cut: float = 0.5) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores, and for each text its toxic runs of tokens with code point offsets and top marginal."""
    data, off = texts(column)
    n = len(off) - 1
    start, end, row = words(data, off)
    p = marginals(field.emissions(token_features(lower(data), start, end)), row, n, field.move)
    x = _document_evidence(p, row, n) @ field.doc
    spans: list[list[dict]] = [[] for _ in range(n)]
    at = np.flatnonzero(p >= cut)
    if len(at):
        points = np.concatenate(([0], np.cumsum(code_points(data))))
        new = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(row[at]) > 0)))
        group = np.flatnonzero(new)
        last = np.concatenate((group[1:], [len(at)])) - 1
        tops = np.maximum.reduceat(p[at], group)
        a, z, r = start[at[group]], end[at[last]], row[at[group]]
        base = points[off[r]]
        for k, i, j, q in zip(r.tolist(), (points[a] - base).tolist(), (points[z] - base).tolist(), tops.tolist(), strict=True):
            spans[k].append({"start": i, "end": j, "p": q})
    return 1 / (1 + np.exp(-np.clip(x, -40, 40))), spans


def remainder(doc_id: str = "doc_id"):
    """crc32 of the doc_id as text, modulo 5; a null doc_id's text is empty."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def fit_on(docs: DataFrame, labels: DataFrame) -> Field:
    """Fit on a bounded sample of the labelled documents whose remainder isn't 0."""
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder() != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in y.groupBy("toxic").count().collect()}  # two rows at most
    order = F.xxhash64("doc_id")
    parts = [y.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(n) for c, n in ((True, MOST_TOXIC), (False, MOST_CLEAN))]
    chosen = parts[0].unionByName(parts[1])  # 6000 narrow rows at most, whatever the corpus: safe to broadcast
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    most = F.when(F.col("toxic"), MOST_TOXIC_BYTES).otherwise(MOST_CLEAN_BYTES)
    found = _excerpts(found, _levels(found, most))
    size = F.sum(F.octet_length("text")).over(_by_class())  # beyond ``most`` only where doc_ids repeat
    kept = found.withColumn("_size", size).where(F.col("_size") <= most).select("doc_id", "text", "toxic")
    return _fit_in_worker(kept, (counts.get(False, 0), counts.get(True, 0)))


def _fit_in_worker(kept: DataFrame, totals: tuple[int, int]) -> Field:
    """``fit`` on the rows of ``kept`` (doc_id, text, toxic) in one task: the driver sees neither texts nor what the fit holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((d, t.decode("utf-8", "replace"), c) for b in batches for d, t, c in zip(*[x.to_pylist() for x in b.columns], strict=True))
        field = fit([(t, c) for _, t, c in rows], totals)
        del rows
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(field)], pa.binary())], names=["field"])

    rows = kept.select("doc_id", F.col("text").cast("binary").alias("text"), "toxic").repartition(1)
    made = rows.mapInArrow(run, "field binary").collect()  # 4 MB, or no row where no task ran
    return pickle.loads(made[0]["field"]) if made else fit([], totals)


def _levels(found: DataFrame, most: Column) -> dict[bool, int]:
    """By class, the bytes above which texts are cut so that all fit into ``most``; no entry where they fit whole."""
    from pyspark.sql import Window as W

    by = W.partitionBy("toxic").orderBy("_size")
    sizes = found.groupBy("toxic", F.octet_length("text").cast("long").alias("_size")).agg(F.count(F.lit(1)).alias("_n"))
    shorter = F.coalesce(F.sum(F.col("_size") * F.col("_n")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("_n").over(by.rowsBetween(0, W.unboundedFollowing))
    share = F.floor((most - shorter) / left)
    over = sizes.withColumn("_share", share).where(F.col("_share") < F.col("_size"))
    # shares fall from the first size that doesn't fit on, so the largest is that one's
    return {r["toxic"]: max(LEAST_BYTES, r["_level"]) for r in over.groupBy("toxic").agg(F.max("_share").alias("_level")).collect()}


def _excerpt(text: bytes, most: int) -> bytes:
    """``most`` bytes at most: windows spread evenly over the text, without the words that their borders split."""
    if len(text) <= most:
        return text
    n = max(1, most // EXCERPT)
    size = most // n - 1
    out = []
    for i in range(n):
        at = i * (len(text) - size) // max(1, n - 1)
        piece = text[at : at + size]
        if at and not text[at - 1 : at].isspace() and len(parts := piece.split(None, 1)) == 2:
            piece = parts[1]
        if at + size < len(text) and not text[at + size : at + size + 1].isspace() and len(parts := piece.rsplit(None, 1)) == 2:
            piece = parts[0]
        out.append(piece)
    return b"\n".join(out).decode(errors="ignore").encode()


def _excerpts(found: DataFrame, levels: dict[bool, int]) -> DataFrame:
    """``found`` (doc_id, text, toxic) with the texts above their class's level cut to it."""
    if not levels:
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            toxic = batch.column(2).to_pylist()
            cut = [_excerpt(t.encode(), levels[c]) if c in levels else t.encode() for t, c in zip(batch.column(1).to_pylist(), toxic, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.binary()).cast(pa.string()), batch.column(2)], names=["doc_id", "text", "toxic"])

    return found.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, text string, toxic boolean")


def _by_class():
    from pyspark.sql import Window as W

    return W.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(W.unboundedPreceding, 0)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, held_out, score, predicted, spans: one row per row of ``docs``."""
    var = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            s, spans = score_texts(batch.column(2), var.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(spans, SPANS)], names=["doc_id", "held_out", "score", "predicted", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder() == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start: long, end: long, p: double>>")


def clean_documents(docs: DataFrame, field: Field, cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``cut``, unchanged; columns may have any names."""
    var = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, f"c{at}"):
            s, _ = score_texts(batch.column(at), var.value)
            yield batch.filter(pa.array(s < cut))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
