"""SentencePiece encoding and decoding with sampled segmentations.

The pieces of a model span a lattice over each normalised text: every path from
its start to its end is a segmentation.  ``sample`` draws the top k segmentations
under Gumbel perturbation, which is sampling without replacement from the paths'
distribution.  The search is A*: a region of paths that share a prefix and avoid
some next pieces is known by its mass, which backward sums give; its perturbed
maximum is drawn before its paths are.  Masses are logarithms, and that of a region is
summed over the pieces left in it, so the unlikeliest path is found once k asks for it.  The region of the largest
maximum yields the next sample and is split along that sample's path.  Each sample
has its log probability and the log of its inclusion probability, given the
(k+1)-th maximum (Kool et al., 2019).  All draws follow from the row key, the
sample's number and the place in the text, never from partitions.

Lattices factorise: no piece crosses a border between two bytes that are adjacent in no
piece, so texts are cut there, equal stretches share one lattice, and stretches of
one slice of rows run in step.  Whole texts are covered, whatever their length.

Texts are normalised by the model's own rules, whichever they are.  Piece weights: a
unigram model's scores are log probabilities, and a user's symbol has the weight that
the model gives it.  A BPE model's scores are ranks; they count as Zipf's law,
log p = -power * log(rank + 1) + const.  A character without a piece is spelled by its
byte pieces, each as likely as the last rank; a model that has none gives its unknown
piece once for a run of such characters.

Defined cases: null texts and those that normalise to nothing have no pieces and one
empty segmentation of probability 1; a text with fewer than k segmentations yields all
of them, with inclusion 1; U+2581 counts as a space, as the model treats it; bytes that
aren't UTF-8 are U+FFFD; a null key seeds as 0; rows that repeat give the same samples.
Decoding drops the space that the model adds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, col, mix64, sliced, span_hashes, uniform

#: The model that is read where neither a call nor the session's spark.weftline.sentencepiece names one.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose lattices are built at once; more would miss the CPU's caches.
SLICE = 512 << 10
_END = 255  # ends a stretch; never a byte of UTF-8
_SPACE = "▁".encode()


class Pieces:
    """A model's pieces as a byte trie, with log weights."""

    def __init__(self, proto: bytes, power: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.byte_id = np.zeros(256, np.int32)
        spelled, scores = {}, {}
        self.spelling: list[bytes] = [b""] * n
        self.sp, self.unknown = sp, sp.unk_id()
        self.leads, self.trails = sp.normalize(b"a").startswith(_SPACE), sp.normalize(b"a").endswith(_SPACE)
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:-1], 16)
                self.byte_id[b] = i
                self.spelling[i] = bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.spelling[i] = sp.id_to_piece(i).replace("▁", " ").encode()
                spelled[self.spelling[i]], scores[i] = i, sp.get_score(i)
        self.spells = any(sp.is_byte(i) for i in range(n))
        if not self.spells:
            self.byte_id[:] = self.unknown
            self.spelling[self.unknown] = sp.decode([self.unknown]).encode()
        score = np.array([scores.get(i, 0.0) for i in range(n)])
        known = np.array(sorted(scores), np.int64)
        if score.size and (score == np.rint(score)).all():
            rank = np.argsort(np.argsort(-score[known], kind="stable")) + 1.0
            total = np.log(np.sum((np.arange(1, len(known) + 257) + 1.0) ** -power))
            self.weight = np.full(n, -power * np.log(len(known) + 257.0) - total)
            self.weight[known] = -power * np.log(rank + 1) - total
        else:
            self.weight = np.full(n, score.min() - 10)
            self.weight[known] = score[known]
            own, best = known[score[known] == 0], score[score < 0].max()  # a user's symbols have no score
            self.weight[own] = [len(self.spelling[i].decode()) * best - 0.1 for i in own]
            self.weight *= power
        self.byte_weight = float(self.weight[self.byte_id].min())
        self.length = np.array([len(x) for x in self.spelling], np.int64)
        self.flat = np.frombuffer(b"".join(self.spelling), np.uint8)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        # nodes in order of creation; only those with children have a row of the table
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        self.adjacent = np.zeros((256, 256), bool)
        for text, i in spelled.items():
            at = 0
            for b in text:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    piece.append(-1)
                at = children[at][b]
            piece[at] = i
            for a, b in zip(text, text[1:], strict=False):
                self.adjacent[a, b] = True
        self.piece = np.array(piece, np.int32)
        inner = [k for k, c in enumerate(children) if c]
        self.row = np.full(len(children), -1, np.int32)
        self.row[inner] = np.arange(len(inner))
        # by byte first: the rows of frequent pieces come early, so what texts read lies close together
        table = np.full((256, len(inner)), -1, np.int32)
        for r, k in enumerate(inner):
            table[list(children[k]), r] = list(children[k].values())
        self.table, self.rows = table.ravel(), len(inner)

    def normalized(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts as the model normalises them; null counts as empty."""
        done = [self.sp.normalize(x).replace(_SPACE, b" ") if x else b"" for x in column.cast(pa.large_binary()).to_pylist()]
        return np.frombuffer(b"".join(done), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in done], dtype=np.int64)))


class Lattices:
    """The lattices of distinct stretches, end to end in one buffer; nodes are its places."""

    def __init__(self, buf: np.ndarray, base: np.ndarray, pieces: Pieces):
        n = len(buf)
        head = code_points(buf) & (buf != _END)
        deg = np.zeros(n, np.int32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        src = np.flatnonzero(head)
        # a character's own length, to know whether a piece spells just it
        width = np.where(buf[src] < 0x80, 1, np.where(buf[src] < 0xE0, 2, np.where(buf[src] < 0xF0, 3, 4)))
        wide = np.zeros(n, np.int8)
        wide[src] = width
        alone = np.zeros(n, bool)
        every = src
        column = buf.astype(np.int64) * pieces.rows
        node: np.ndarray | int = 0
        depth = 0
        while len(src):
            nxt = pieces.table.take(column.take(src + depth) + node)
            on = np.flatnonzero(nxt >= 0)
            src, nxt = src.take(on), nxt.take(on)
            depth += 1
            piece = pieces.piece.take(nxt)
            hit = np.flatnonzero(piece >= 0)
            s = src.take(hit)
            if depth <= 4:
                alone[s[wide.take(s) == depth]] = True
            slot = deg.take(s)
            found.append((s, slot, s + depth, piece.take(hit)))
            deg[s] = slot + 1
            row = pieces.row.take(nxt)
            go = np.flatnonzero(row >= 0)
            src, node = src.take(go), row.take(go)
        s = every[~alone[every]]
        found.append((s, deg[s], s + wide[s], np.full(len(s), -1, np.int32)))
        deg[s] += 1
        self.deg = deg
        # nodes by place in their stretches; the edges of one place lie together
        place = np.arange(n) - np.repeat(base, np.diff(np.concatenate((base, [n]))))
        live = np.flatnonzero(deg)
        p = place[live]
        order = live[np.argsort(p.astype(np.uint16) if len(p) and p.max() < 65536 else p, kind="stable")]
        cuts = np.concatenate(([0], np.cumsum(np.bincount(p)))) if len(p) else np.zeros(1, np.int64)
        degs = deg[order]
        ends = np.concatenate(([0], np.cumsum(degs, dtype=np.int64)))
        m, starts = int(ends[-1]), ends[:-1]
        self.ptr = np.zeros(n, np.int64)
        self.ptr[order] = starts
        self.last = np.full(n, -1, np.int64)
        self.last[order] = ends[1:] - 1
        self.dst, self.piece = np.zeros(m, np.int64), np.zeros(m, np.int32)
        self.src = np.repeat(order, degs)
        for a, slot, b, piece in found:
            at = self.ptr.take(a) + slot
            self.dst[at], self.piece[at] = b, piece
        w = pieces.weight[self.piece]
        spelled = np.flatnonzero(self.piece < 0)
        w[spelled] = pieces.byte_weight * (self.dst[spelled] - self.src[spelled] if pieces.spells else 1)
        # backward sums, nodes of one place at a time, the last first
        beta = np.zeros(n)
        self.log_q = np.empty(m)
        for k in range(len(cuts) - 2, -1, -1):
            lo, hi = int(cuts[k]), int(cuts[k + 1])
            if lo == hi:
                continue
            a, b = int(ends[lo]), int(ends[hi])
            x = w[a:b] + beta.take(self.dst[a:b])
            if b - a == hi - lo:
                beta[order[lo:hi]] = x
                self.log_q[a:b] = 0
                continue
            at, d = starts[lo:hi] - a, degs[lo:hi]
            top = np.maximum.reduceat(x, at)
            total = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, d)), at))
            beta[order[lo:hi]] = total
            self.log_q[a:b] = x - np.repeat(total, d)
        cum = np.exp(self.log_q)
        nodes = np.flatnonzero(degs > 1)
        for j in range(1, int(degs.max()) if m else 0):
            nodes = nodes[degs[nodes] > j]
            e = starts[nodes] + j
            cum[e] += cum[e - 1]
        #: The share of the edges before each one of its node; -1 for the first.
        self.below = np.concatenate(([-1.0], cum[:-1])) if m else cum
        self.below[starts] = -1
        self.rest, self.known = np.empty(m), np.zeros(m, bool)

    def others(self, edge: np.ndarray) -> np.ndarray:
        """Log of the share of the paths through each edge's node that take another edge."""
        new = np.zeros(len(self.known), bool)
        new[edge] = True  # paths share most of their edges, so each is computed once
        new = np.flatnonzero(new & ~self.known)
        self.rest[new], self.known[new] = self._others(new), True
        return self.rest.take(edge)

    def _others(self, edge: np.ndarray) -> np.ndarray:
        ptr, d, own = self.ptr[self.src[edge]], self.deg[self.src[edge]], self.log_q[edge]
        out = np.full(len(edge), -np.inf)
        far = own < -1e-3
        out[far] = np.log(-np.expm1(own[far]))
        out[d < 2] = -np.inf
        at = np.flatnonzero(~far & (d > 1))  # here 1 - q has few digits, or none
        for j in range(int(d[at].max()) if len(at) else 0):
            at = at[d[at] > j]
            on = at[ptr[at] + j != edge[at]]
            out[on] = np.logaddexp(out[on], self.log_q[ptr[on] + j])
        return out


def _rows(pos: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each of the sorted places, and the rows' first ones and their end."""
    first = np.searchsorted(pos, off)
    return np.repeat(np.arange(len(off) - 1), np.diff(first)), first


class Slice:
    """Texts of one slice: their buffer, stretches and lattices."""

    def __init__(self, data: np.ndarray, off: np.ndarray, pieces: Pieces, lead: bool = True):
        rows = len(off) - 1
        size = np.diff(off)
        full = size > 0
        self.off = np.concatenate(([0], np.cumsum(size + (full & lead))))
        self.buf = np.full(self.off[-1], 32, np.uint8)  # texts that aren't normalised yet get a leading space
        body = np.ones(len(self.buf), bool)
        body[self.off[:-1][full & lead]] = False
        self.buf[body] = data
        self.pieces, self.rows = pieces, rows
        if not len(self.buf):
            self.start = np.zeros(0, np.int64)
            return
        cut = code_points(self.buf).copy()
        cut[1:] &= ~pieces.adjacent[self.buf[:-1], self.buf[1:]]
        cut[self.off[:-1][full]] = True
        self.start = np.flatnonzero(cut)
        end = np.concatenate((self.start[1:], [len(self.buf)]))
        self.row = _rows(self.start, self.off)[0]
        size = end - self.start
        _, first, which = np.unique(span_hashes(self.buf, self.start, end), return_index=True, return_inverse=True)
        twin = np.repeat(self.start[first[which]] - self.start, size)  # to the same place in the first of its kind
        if (size[first[which]] != size).any() or (self.buf[np.arange(len(self.buf)) + twin] != self.buf).any():
            seen: dict[bytes, int] = {}  # hashes clash, so bytes decide
            which = np.array([seen.setdefault(self.buf[a:b].tobytes(), len(seen)) for a, b in zip(self.start.tolist(), end.tolist(), strict=True)])
            _, first = np.unique(which, return_index=True)
        length = size[first]
        base = np.concatenate(([0], np.cumsum(length + 1)))[:-1]
        total = int((length + 1).sum())
        joined = np.full(total, _END, np.uint8)
        index = np.arange(total) - np.repeat(base, length + 1)
        inside = index < np.repeat(length, length + 1)
        joined[inside] = self.buf[(index + np.repeat(self.start[first], length + 1))[inside]]
        self.lattice = Lattices(joined, base, pieces)
        self.delta = base[which] - self.start  # from a place in the texts to a node


def _walk(s: Slice, x: np.ndarray, delta: np.ndarray, key: np.ndarray, edge_at: np.ndarray) -> None:
    """Draw paths from places ``x`` to their stretches' ends into ``edge_at``."""
    t = s.lattice
    while len(x):
        e = t.last.take(x + delta)
        on = e >= 0
        if not on.all():
            on = np.flatnonzero(on)
            x, delta, key, e = x.take(on), delta.take(on), key.take(on), e.take(on)
        r = uniform(mix64(key + x.astype(np.uint64)))
        # from the last edge down, as long pieces are the likely ones
        go = np.flatnonzero(r <= t.below.take(e))
        while len(go):
            e[go] -= 1
            go = go[r.take(go) <= t.below.take(e.take(go))]
        edge_at[x] = e
        x = t.dst.take(e) - delta


def _gumbel_below(mass: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The maximum of a region of log mass ``mass`` given that it lies below ``top``."""
    with np.errstate(over="ignore", divide="ignore"):
        z = np.log(-np.log(u)) - mass
        return -np.maximum(-top, z) - np.log1p(np.exp(-np.abs(top + z)))  # logaddexp, which has no vector form; top is finite


class Samples:
    """Up to k segmentations of each text of a slice, best perturbed value first."""

    def __init__(self, s: Slice, keys: np.ndarray, k: int):
        self.slice, self.found = s, []
        rows = s.rows
        t = getattr(s, "lattice", None)
        plain = lambda n: mix64(keys + np.uint64(0x51ED270B) * np.uint64(n + 1))
        salt = lambda n: plain(n) - s.off[:-1].astype(np.uint64)  # noqa: E731  added to a place in the slice, it gives that in the row
        top = -np.log(-np.log(uniform(mix64(keys ^ np.uint64(0xA5A5A5A5)))))
        self.gumbel = [top]
        self.log_p: list[np.ndarray] = []
        self.next = np.full(rows, -np.inf)
        if t is None:
            self.found.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            self.log_p.append(np.zeros(rows))
            return
        regions: list[np.ndarray] = []
        taken: dict[tuple[int, int, int], list[int]] = {}
        edge_at = np.full(len(s.buf), -1, np.int64)
        _walk(s, s.start, s.delta, salt(0)[s.row], edge_at)
        self._add(edge_at, np.full(rows, -1), top, salt(100), regions)
        for n in range(1, k + 1):
            best, which, place = np.full(rows, -np.inf), np.full(rows, -1), np.zeros(rows, np.int64)
            for i, g in enumerate(regions):
                if not len(g):
                    continue
                row = self.rows_of[i]
                first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                high = np.maximum.reduceat(g, first)
                r = row[first]
                better = high > best[r]
                if better.any():
                    # the first place that attains the maximum
                    full = np.full(rows, np.inf)
                    full[r] = high
                    hits = np.flatnonzero(g == full[row])
                    _, at = np.unique(row[hits], return_index=True)
                    where = np.zeros(rows, np.int64)
                    where[row[hits[at]]] = hits[at]
                    rb = r[better]
                    best[rb], which[rb], place[rb] = high[better], i, where[rb]
            self.next = best
            if n == k:
                break
            alive = np.flatnonzero(which >= 0)
            if not len(alive):
                break
            edge_at = np.full(len(s.buf), -1, np.int64)
            x0 = np.full(rows, -1)
            step = np.zeros(rows, np.int64)
            u = uniform(mix64(plain(200 + n)))
            v = uniform(mix64(plain(300 + n)))
            for r in alive.tolist():
                i, j = int(which[r]), int(place[r])
                pos, edge = self.found[i]
                x, e = int(pos[j]), int(edge[j])
                out = taken.setdefault((i, r, j), [e])
                node = int(t.src[e])
                a, b = int(t.ptr[node]), int(t.ptr[node] + t.deg[node])
                free = [y for y in range(a, b) if y not in out]
                log_q = t.log_q[free]
                share = np.cumsum(np.exp(log_q - log_q.max()))
                nth = min(int(np.searchsorted(share, u[r] * share[-1], "right")), len(free) - 1)
                pick = free[nth]
                out.append(pick)
                mass = self.before[i][j] + np.logaddexp.reduce(np.delete(log_q, nth))
                regions[i][j] = _gumbel_below(np.array([mass]), best[r : r + 1], v[r : r + 1])[0] if len(free) > 1 else -np.inf
                x0[r], step[r] = x, pick
            for i in range(len(self.found)):
                pos, edge = self.found[i]
                row = self.rows_of[i]
                keep = (which[row] == i) & (pos < x0[row])
                edge_at[pos[keep]] = edge[keep]
            edge_at[x0[alive]] = step[alive]
            own = np.searchsorted(s.start, x0[alive], "right") - 1
            rest = (x0[s.row] >= 0) & (s.start > x0[s.row])
            x = np.concatenate((t.dst[step[alive]] - s.delta[own], s.start[rest]))
            delta = np.concatenate((s.delta[own], s.delta[rest]))
            key = np.concatenate((salt(n)[alive], salt(n)[s.row[rest]]))
            _walk(s, x, delta, key, edge_at)
            self.gumbel.append(np.where(which >= 0, best, -np.inf))
            self._add(edge_at, x0, best, salt(100 + n), regions)

    rows_of: list[np.ndarray]

    def _add(self, edge_at: np.ndarray, after: np.ndarray, top: np.ndarray, key: np.ndarray, regions: list[np.ndarray]) -> None:
        s, t = self.slice, self.slice.lattice
        if not self.found:
            self.rows_of, self.before = [], []
        pos = np.flatnonzero(edge_at >= 0)
        edge = edge_at[pos]
        row, first = _rows(pos, s.off)
        log_q = t.log_q.take(edge)
        before, whole = np.zeros(len(log_q)), np.zeros(s.rows)
        for r in np.flatnonzero(np.diff(first)).tolist():  # sums of each row alone, so that slices don't change their rounding
            a, b = first[r], first[r + 1]
            run = np.cumsum(log_q[a:b])
            before[a + 1 : b], whole[r] = run[:-1], run[-1]
        self.log_p.append(whole)
        mass = np.full(len(pos), -np.inf)
        new = pos > after[row]
        mass[new] = before[new] + t.others(edge[new])
        regions.append(_gumbel_below(mass, top[row], uniform(mix64(key[row] + pos.astype(np.uint64)))))
        self.found.append((pos, edge))
        self.rows_of.append(row)
        self.before.append(before)

    def ids(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of sample i of all rows, end to end, and the rows' offsets."""
        s = self.slice
        pos, edge = self.found[i]
        if not len(pos):
            return np.zeros(0, np.int32), np.zeros(s.rows + 1, np.int64)
        t = s.lattice
        ids = t.piece.take(edge)
        out = np.flatnonzero(ids < 0)  # pieces that no text spells, for which there are others
        if not len(out):
            return ids, np.searchsorted(pos, s.off)
        count = np.ones(len(ids), np.int64)
        count[out] = t.dst[edge[out]] - t.src[edge[out]]
        if not s.pieces.spells:  # the unknown piece, once for each run
            again = (ids[1:] < 0) & (ids[:-1] < 0) & (self.rows_of[i][1:] == self.rows_of[i][:-1])
            count = np.where(np.concatenate(([False], again)), 0, 1)
        ids = np.repeat(ids, count)
        ahead = np.concatenate(([0], np.cumsum(count)))
        spelled = np.flatnonzero(ids < 0)
        inside = spelled - np.repeat(ahead[out], count[out])
        ids[spelled] = s.pieces.byte_id[s.buf[np.repeat(pos[out], count[out]) + inside]]
        return ids, ahead[np.searchsorted(pos, s.off)]

    def log_inclusion(self, i: int) -> np.ndarray:
        """Log of the chance that sample i's segmentation is among k, given the next perturbed value."""
        with np.errstate(all="ignore"):
            z = self.log_p[i] - self.next
            out = np.where(z < -20, z, np.log(-np.expm1(-np.exp(np.minimum(z, 30)))))
        return np.where(np.isneginf(self.next), 0.0, out)


def decoded(ids: np.ndarray, pieces: Pieces) -> np.ndarray:
    """The bytes that ids spell, the model's own space included."""
    n = pieces.length[ids]
    end = np.cumsum(n)
    if not len(ids):
        return np.zeros(0, np.uint8)
    return pieces.flat[np.arange(end[-1]) + np.repeat(pieces.start[ids] - (end - n), n)]


_cache: dict[tuple[int, float], Pieces] = {}


def _pieces(var, power: float) -> Pieces:
    at = (hash(var.value), power)
    if at not in _cache:
        _cache[at] = Pieces(var.value, power)
    return _cache[at]


def _spells(ids: np.ndarray, at: np.ndarray, s: Slice, p: Pieces) -> np.ndarray:
    """Whether each row's ids decode to its normalised text."""
    raw = decoded(ids, p)
    if len(raw) == len(s.buf) and np.array_equal(np.concatenate(([0], np.cumsum(p.length[ids])))[at], s.off) and np.array_equal(raw, s.buf):
        return np.ones(s.rows, bool)
    end = np.concatenate(([0], np.cumsum(p.length[ids])))[at].tolist()
    off = s.off.tolist()
    return np.array([np.array_equal(raw[end[r] : end[r + 1]], s.buf[off[r] : off[r + 1]]) for r in range(s.rows)], bool)


def _model(docs: DataFrame, path: str | None):
    with open(path or docs.sparkSession.conf.get("spark.weftline.sentencepiece", MODEL), "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())  # half a megabyte, whatever the data


DIGESTS = "n_samples int, n_pieces array<int>, log_prob array<double>, log_inclusion array<double>, ids_sha256 array<string>, round_trip boolean"


def sample(docs: DataFrame, key: str = "doc_id", k: int = 2, power: float = 1.0, seed: int = 0, model: str | None = None, carry: tuple[str, ...] = (), ids: bool = False, each: bool = False) -> DataFrame:
    """``key``, ``carry`` and k segmentations per row, without a shuffle.

    Digests of little-endian 32-bit ids by default; with ``ids``, also the first
    sample's ids, as an array ``pieces``; with ``each``, those of all samples, as an
    array ``samples`` of arrays.  ``round_trip``: all samples decode to the normalised text.
    """
    var = _model(docs, model)
    names = [key, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(var, power)
        for batch in sliced(batches, "_text", SLICE):
            s = Slice(*p.normalized(batch.column(len(names) + 1)), p, lead=False)
            keys = mix64(pc.fill_null(batch.column(len(names)), 0).to_numpy().view(np.uint64) + np.uint64(seed))
            found = Samples(s, keys, k)
            rows = range(s.rows)
            out: list[list[list]] = [[[] for _ in rows] for _ in range(4)]
            same = np.ones(s.rows, bool)
            lists, drawn = [], []
            for i in range(len(found.found)):
                x, at = found.ids(i)
                raw, cut = x.astype("<i4").tobytes(), at.tolist()
                valid = ~np.isneginf(found.gumbel[i])
                same &= ~valid | _spells(x, at, s, p)
                lp, inc = found.log_p[i].tolist(), found.log_inclusion(i).tolist()
                for r in np.flatnonzero(valid).tolist():
                    out[0][r].append(cut[r + 1] - cut[r])
                    out[1][r].append(lp[r])
                    out[2][r].append(inc[r])
                    out[3][r].append(hashlib.sha256(raw[4 * cut[r] : 4 * cut[r + 1]]).hexdigest())
                if each or (ids and i == 0):
                    lists.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())))
                drawn.append(valid)
            columns = [*batch.columns[: len(names)], pa.array([len(v) for v in out[0]], pa.int32()), pa.array(out[0], pa.list_(pa.int32()))]
            columns += [pa.array(out[1], pa.list_(pa.float64())), pa.array(out[2], pa.list_(pa.float64())), pa.array(out[3], pa.list_(pa.string())), pa.array(same)]
            labels = [*[f"c{i}" for i in range(len(names))], "n_samples", "n_pieces", "log_prob", "log_inclusion", "ids_sha256", "round_trip"]
            if ids:
                columns.append(lists[0])
                labels.append("pieces")
            if each:
                has = np.array(drawn).T
                order = (np.arange(s.rows)[:, None] + s.rows * np.arange(len(drawn)))[has]
                cut = np.concatenate(([0], np.cumsum(has.sum(1))))
                columns.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.concat_arrays(lists).take(pa.array(order))))
                labels.append("samples")
            yield pa.RecordBatch.from_arrays(columns, names=labels)

    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    rows = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(names)], col(key).cast("long").alias("_key"), col("text").alias("_text"))
    out = rows.mapInArrow(run, f"{kinds}, {DIGESTS}" + ", pieces array<int>" * ids + ", samples array<array<int>>" * each)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *out.columns[len(names) :])


def decode(rows: DataFrame, key: str, column: str = "pieces", model: str | None = None) -> DataFrame:
    """``key`` and text from arrays of ids; a null array gives null."""
    var = _model(rows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(var, 1.0)
        for batch in batches:
            made = []
            for v in batch.column(1):
                x = None if not v.is_valid else decoded(np.asarray(v.values, np.int64), p).tobytes()
                if x is not None:
                    x = x[1:] if p.leads and x[:1] == b" " else x[:-1] if p.trails and x[-1:] == b" " else x
                made.append(x if x is None else x.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=[key, "text"])

    return rows.select(key, column).mapInArrow(run, f"`{key}` {rows.select(key).schema[0].dataType.simpleString()}, text string")


def encode_best(docs: DataFrame, key: str = "doc_id", model: str | None = None) -> DataFrame:
    """``key`` and the model's own best segmentation as ids."""
    var = _model(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=var.value)
        for batch in sliced(batches):
            ids = sp.encode([x or "" for x in batch.column(1).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "pieces"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {docs.select(key).schema[0].dataType.simpleString()}, pieces array<int>")
