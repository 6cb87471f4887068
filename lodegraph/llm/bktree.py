"""BK-tree under the unrestricted Damerau-Levenshtein distance, searched for many queries at once.

The distance (insertion, deletion, replacement, and transposition of letters
that may have edits between them) is a true metric, so that an entry within the
radius r of a query lies below a node at distance d only in the branches d - r
to d + r.  The root is the empty text: its branches are the lengths.

Nodes and queries are code arrays; a level of the tree is searched for all
queries of a batch with one vectorised distance computation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: Distances are told apart up to this value: min(distance, FAR) is a metric too, and needs only a band of the table.
FAR = 24
#: Cells of the tables of one chunk of pairs.
_CELLS = 1 << 24


def encode(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points padded with 0, lengths)."""
    lengths = np.fromiter(map(len, texts), np.int32, len(texts))
    width = int(lengths.max(initial=0)) or 1
    codes = np.zeros((len(texts), width), np.uint32)
    for i, t in enumerate(texts):
        if t:
            codes[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    return codes, lengths


def _distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, far: int) -> np.ndarray:
    """min(distance, far) of the pairs (a[i], b[i]), by Lowrance and Wagner's recurrence within far of the diagonal."""
    pairs, n, m = len(la), int(la.max(initial=0)), int(lb.max(initial=0))
    symbols, flat = np.unique(np.concatenate([a[:, :n].ravel(), b[:, :m].ravel()]), return_inverse=True)
    a, b = flat[: pairs * n].reshape(pairs, n), flat[pairs * n :].reshape(pairs, m)
    at = np.arange(pairs)
    # Cell (i, j) of the table lies at row i + 1 and column j - i + band + 1; a column of `far` is on either side.
    band = min(far, max(n, m))
    width = 2 * band + 3
    table = np.full((n + 2, width, pairs), far, np.int16)
    for j in range(min(m, band) + 1):
        table[1, j + band + 1] = min(j, far)
    last_row = np.zeros((len(symbols), pairs), np.int32)
    cells = table.reshape(-1)
    for i in range(1, n + 1):
        if i <= band:
            table[i + 1, band + 1 - i] = min(i, far)
        low = max(1, i - band)
        last_col = np.zeros(pairs, np.int32)
        # an equal letter before the band can only give `far`
        ai = a[:, i - 1]
        for j in range(low, min(m, i + band) + 1):
            bj = b[:, j - 1]
            k = last_row[bj, at]
            same = ai == bj
            # the cell before both transposed letters, if the band has it
            column = last_col - k + band + 1
            inside = (k > 0) & (last_col > 0) & (column >= 0) & (column < width)
            swap = np.where(inside, cells[(k * width + np.where(inside, column, 0)) * pairs + at], far) + (i - k) + (j - last_col) - 1
            c = j - i + band + 1
            best = table[i, c] + (1 - same.view(np.int8))
            np.minimum(best, table[i + 1, c - 1] + 1, out=best)
            np.minimum(best, table[i, c + 1] + 1, out=best)
            table[i + 1, c] = np.minimum(np.minimum(best, swap), far)
            last_col[same] = j
        last_row[ai, at] = i
    c = lb - la + band + 1
    inside = (c > 0) & (c < width - 1)
    return np.where(inside, table[la + 1, np.where(inside, c, 0), at], far).astype(np.int32)


def distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, far: int = FAR) -> np.ndarray:
    """min(distance, far) of the pairs (a[i], b[i]); pairs of like lengths share a chunk, and no chunk has more than _CELLS cells or one pair."""
    out = np.empty(len(la), np.int32)
    order = np.lexsort((lb, la))
    start = 0
    while start < len(order):
        # lengths grow along the order: the size of a chunk is that of its last pair's table
        end = min(len(order), start + 8192)
        while True:
            s = order[start:end]
            n, m = int(la[s].max()), int(lb[s].max())
            most = max(1, _CELLS // ((n + 2) * (2 * min(far, max(n, m)) + 3)))
            if len(s) <= most:
                break
            end = start + min(most, max(1, len(s) // 2))
        out[s] = _distances(a[s], la[s], b[s], lb[s], far)
        start = end
    return out


def distance(a: str, b: str) -> int:
    """The same distance of two short texts."""
    n, m = len(a), len(b)
    table = [[n + m] * (m + 2) for _ in range(n + 2)]
    for j in range(m + 1):
        table[1][j + 1] = j
    last_row: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        row, above, last_col = table[i + 1], table[i], 0
        row[1] = i
        for j, y in enumerate(b, 1):
            k = last_row.get(y, 0)
            swap = table[k][last_col] + i - k + j - last_col - 1
            row[j + 1] = min(above[j] + (x != y), row[j] + 1, above[j + 1] + 1, swap)
            if x == y:
                last_col = j
        last_row[x] = i
    return table[-1][-1]


class BKTree:
    """A tree over distinct texts."""

    def __init__(self, texts: Sequence[str]):
        self.texts = list(dict.fromkeys(texts))
        self.codes, self.lengths = encode(["", *self.texts])  # node 0 is the empty text
        self.item = [-1]
        parent, edge, node = [], [], []
        todo = [(0, np.arange(1, len(self.texts) + 1))]
        while todo:
            heads = np.concatenate([np.full(len(rest), h) for h, rest in todo])
            rests = np.concatenate([rest for _, rest in todo])
            if not len(rests):
                break
            d = distances(self.codes[heads], self.lengths[heads], self.codes[rests], self.lengths[rests])
            todo, at = [], 0
            order = np.lexsort((rests, d, heads))
            heads, rests, d = heads[order], rests[order], d[order]
            cut = np.flatnonzero(np.diff(heads) | np.diff(d)) + 1
            for at, end in zip([0, *cut], [*cut, len(rests)], strict=True):
                parent.append(heads[at])
                edge.append(d[at])
                node.append(rests[at])
                todo.append((rests[at], rests[at + 1 : end]))
        order = np.lexsort((edge, parent)) if parent else np.array([], int)
        self.edge, self.node = np.array(edge, np.int32)[order], np.array(node, np.int64)[order]
        self.first = np.searchsorted(np.array(parent, np.int64)[order], np.arange(len(self.texts) + 2))

    def within(self, queries: Sequence[str], radius: int) -> list[list[tuple[int, int]]]:
        """For each query every (place in texts, distance) with distance <= radius; visits are counted in .visited."""
        out: list[list[tuple[int, int]]] = [[] for _ in queries]
        # a text longer than every entry by more than the radius is near none
        reach = int(self.lengths.max()) + radius
        near = [i for i, t in enumerate(queries) if len(t) <= reach]
        codes, lengths = encode([queries[i] for i in near])
        q, n = np.arange(len(near)), np.zeros(len(near), np.int64)
        self.visited = 0
        while len(q):
            self.visited += len(q)
            top = not n.any()
            d = np.minimum(lengths[q], FAR) if top else distances(codes[q], lengths[q], self.codes[n], self.lengths[n])
            if not top:
                for i in np.flatnonzero(d <= radius):
                    out[near[q[i]]].append((int(n[i]) - 1, int(d[i])))
            begin, end = self.first[n], self.first[n + 1]
            size = end - begin
            who = np.repeat(np.arange(len(q)), size)
            child = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[who]
            keep = np.abs(self.edge[child] - d[who]) <= radius
            q, n = q[who[keep]], self.node[child[keep]]
        return out

    def nearest(self, queries: Sequence[str], radius: int, agrees: Callable[[int, int], bool] = lambda query, place: True) -> list[list[tuple[int, int]]]:
        """For each query the agreeing entries at its smallest distance <= radius that has one.

        Radii are tried in turn, each for the queries that are still without an
        agreeing entry: the result is that of all entries within the radius.
        """
        out: list[list[tuple[int, int]]] = [[] for _ in queries]
        open_ = list(range(len(queries)))
        for r in range(radius + 1):
            for i, hits in zip(open_, self.within([queries[i] for i in open_], r), strict=True):
                out[i] = [h for h in hits if h[1] == r and agrees(i, h[0])]
            open_ = [i for i in open_ if not out[i]]
            if not open_:
                break
        return out
