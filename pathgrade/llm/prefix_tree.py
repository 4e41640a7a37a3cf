"""Sets in one global order as a prefix tree, and the links among the sets of one cell. Numpy only; a cell is bounded."""

from __future__ import annotations

import numpy as np


def needed(a, b, percent: int):
    """The smallest overlap with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


class PrefixTree:
    """Sorted sequences of numbers; a node is a run of sequences with a common beginning, its edge what they share beyond the parent.

    Nodes are numbered level by level, the children of one side by side. A probe walks all live nodes of a level at
    once: an edge's overlap with the probe is counted once for all sequences below it, and a subtree is abandoned when
    even its longest sequence has too little left to make up the overlap that its shortest one needs.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.order = np.array(sorted(range(len(sets)), key=lambda k: sets[k].tobytes()), np.int64)
        own = [sets[k] for k in self.order]
        self.size = np.array([len(s) for s in own], np.int64)
        values, codes = np.unique(np.concatenate(own), return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum(self.size)])
        self.sets = [codes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.flag = np.zeros(len(values), bool)
        self._build()

    def _build(self) -> None:
        lo, hi, start, end, leaf, first, count = [], [], [], [], [], [], []
        edges, level = [], [(0, len(self.sets), 0)]
        made = 1
        while level:
            below = []
            for a, b, depth in level:
                head, tail = self.sets[a], self.sets[b - 1]
                m = min(len(head), len(tail))
                differ = np.flatnonzero(head[depth:m] != tail[depth:m])
                stop = depth + int(differ[0]) if len(differ) else m
                edges.append(head[depth:stop])
                k = a
                while k < b and len(self.sets[k]) == stop:  # sequences that end here sort first
                    k += 1
                cuts = []
                if k < b:
                    heads = np.array([s[stop] for s in self.sets[k:b]])
                    cuts = [k, *(k + 1 + np.flatnonzero(np.diff(heads))).tolist(), b]
                kids = max(0, len(cuts) - 1)
                for x, v in ((lo, a), (hi, b), (end, stop), (leaf, k), (first, made), (count, kids)):
                    x.append(v)
                made += kids
                below += [(x, y, stop) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            level = below
        self.lo, self.hi, self.end, self.leaf, self.first, self.count = (np.array(x, np.int64) for x in (lo, hi, end, leaf, first, count))
        self.edge = np.concatenate([*edges, np.zeros(0, np.int64)])
        self.at = np.concatenate([[0], np.cumsum([len(e) for e in edges])])
        self.longest = np.array([self.size[a:b].max() for a, b in zip(lo, hi, strict=True)])
        self.shortest = np.array([self.size[a:b].min() for a, b in zip(lo, hi, strict=True)])

    def linked(self, k: int, label: np.ndarray | None = None) -> np.ndarray:
        """Places (in the tree's order) of the sequences that link with that at place k; of those with its label none need be found."""
        probe, n = self.sets[k], int(self.size[k])
        self.flag[probe] = True
        node, overlap, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(node):
            width = self.at[node + 1] - self.at[node]
            upto = np.cumsum(width)
            where = np.arange(upto[-1]) + np.repeat(self.at[node] - upto + width, width)
            hits = np.concatenate([[0], np.cumsum(self.flag[self.edge[where]])])
            overlap = overlap + hits[upto] - hits[upto - width]
            live = overlap + np.minimum(self.longest[node] - self.end[node], n - overlap) >= needed(n, self.shortest[node], self.percent)
            if label is not None:
                live &= np.array([(label[a:b] != label[k]).any() for a, b in zip(self.lo[node], self.hi[node], strict=True)], bool)
            node, overlap = node[live], overlap[live]
            enough = overlap >= needed(n, self.end[node], self.percent)
            found += [np.arange(a, b) for a, b in zip(self.lo[node[enough]], self.leaf[node[enough]], strict=True)]
            kids = self.count[node]
            upto = np.cumsum(kids)
            if not len(node) or not upto[-1]:
                break
            node, overlap = np.arange(upto[-1]) + np.repeat(self.first[node] - upto + kids, kids), np.repeat(overlap, kids)
        self.flag[probe] = False
        out = np.concatenate([*found, np.zeros(0, np.int64)])
        return out[out != k]


def links(ids: np.ndarray, component: np.ndarray, sets: list[np.ndarray], hub: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the components of a cell as all its links would: fewer than it has sets. Hubs are tried first."""
    tree = PrefixTree(sets, percent)
    ids, label = ids[tree.order], np.unique(component[tree.order], return_inverse=True)[1]
    found = []
    for k in np.argsort(~hub[tree.order], kind="stable"):
        if (label == label[k]).all():
            continue
        for j in tree.linked(int(k), label):
            if label[j] != label[k]:
                found.append((int(ids[k]), int(ids[j])))
                label[label == label[j]] = label[k]
    return found
