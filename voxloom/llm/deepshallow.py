"""Order of many suffixes by their first ``length`` bytes: deep-shallow sorting, all groups at once.

1. Multikey quicksort with symbols of eight bytes: each group is split by a median of three into
   less, equal and greater, and the equal ones go on at the next symbol. Every round splits all groups together, in numpy.
2. A group that is equal to the shallow depth and has at most ``MOST`` members goes to a blind trie. It branches where two of its members first
   differ; a member walks down by the branching symbols alone, is compared with the one leaf that it meets, and joins
   it or makes a branch at the first difference. Larger groups are split on until they are small or equal to the end.

Suffixes equal over the whole length stay together, marked as such.
"""

from __future__ import annotations

import numpy as np

#: Symbols of eight bytes up to which quicksort alone is used.
SHALLOW = 4
#: Members of a group that a blind trie takes.
MOST = 32
SYMBOL = 8


def symbols_at(data: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from there as a big-endian number, zeros beyond the end."""
    padded = np.r_[data, np.zeros(SYMBOL, np.uint8)]
    out = np.zeros(len(data), np.uint64)
    for k in range(SYMBOL):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


class Symbols:
    """The symbols of suffixes that begin at ``starts``, as far as ``length`` bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, length: int):
        self.at, self.starts, self.n = symbols_at(data), starts, -(-length // SYMBOL)
        self.cut = np.uint64(8 * (SYMBOL * self.n - length))

    def get(self, which: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Symbol number ``depth`` of each suffix."""
        place = self.starts[which] + SYMBOL * depth
        s = self.at[np.minimum(place, len(self.at) - 1)]
        return np.where(depth == self.n - 1, s >> self.cut, s) if self.cut else s

    def first_difference(self, a: np.ndarray, b: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first symbol from ``depth`` on where suffixes differ, ``n`` where none does."""
        out = depth.copy()
        live = np.arange(len(a))
        while len(live):
            live = live[out[live] < self.n]
            same = self.get(a[live], out[live]) == self.get(b[live], out[live])
            live = live[same]
            out[live] += 1
        return out


def suffix_order(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int, shallow: int = SHALLOW, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): suffixes by group and first ``length`` bytes; same: it equals the one before in both.

    ``group`` ascends; each suffix has ``length`` bytes before the end of ``data``.
    """
    sym = Symbols(data, starts, length)
    order, same = np.arange(len(starts)), np.zeros(len(starts), bool)
    slot = np.arange(len(starts))  # places of the suffixes that aren't settled yet
    label = np.cumsum(np.r_[False, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    depth = np.zeros(int(label[-1]) + 1 if len(label) else 0, np.int64)
    while True:
        size = np.bincount(label, minlength=len(depth))
        whole = (size > 1) & (depth == sym.n)
        small = (size > 1) & ~whole & (depth >= shallow) & (size <= most)
        first = np.r_[True, label[1:] != label[:-1]]
        same[slot] |= whole[label] & ~first if len(slot) else False
        if small.any():
            mine = small[label]
            got, equal = blind_tries(sym, order[slot[mine]], _dense(label[mine]), depth[small])
            order[slot[mine]], same[slot[mine]] = got, equal
        on = ((size > 1) & ~whole & ~small)[label] if len(slot) else np.zeros(0, bool)
        if not on.any():
            return order, same
        depth = depth[(size > 1) & ~whole & ~small]
        slot, label = slot[on], _dense(label[on])
        label, depth = _split(sym, order, slot, label, depth)


def _dense(label: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[False, label[1:] != label[:-1]])


def _split(sym: Symbols, order: np.ndarray, slot: np.ndarray, label: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round of multikey quicksort over all groups; ``order`` is changed in place."""
    who = order[slot]
    key = sym.get(who, depth[label])
    size = np.bincount(label)
    start = np.cumsum(size) - size
    a, b, c = key[start], key[start + size // 2], key[start + size - 1]
    pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[label]
    side = (key > pivot).astype(np.int64) * 2 + (key == pivot)
    count = np.bincount(label * 3 + side, minlength=3 * len(size))
    begin = np.cumsum(count) - count
    to = np.empty(len(slot), np.int64)
    for k in range(3):
        m = np.flatnonzero(side == k)
        mine = count[k::3]
        to[m] = begin[label[m] * 3 + k] + np.arange(len(m)) - (np.cumsum(mine) - mine)[label[m]]
    out = np.empty_like(who)
    out[to] = who
    order[slot] = out
    there = count > 0
    return np.repeat(np.arange(there.sum()), count[there]), (np.repeat(depth, 3) + (np.arange(len(count)) % 3 == 1))[there]


class Tries:
    """Blind tries of many groups. Nodes 0..m-1 are the members as leaves, the others branch at ``depth``; children are linked lists."""

    def __init__(self, sym: Symbols, who: np.ndarray, group: np.ndarray):
        m = len(who)
        self.sym, self.who, self.leaves = sym, who, m
        self.depth = np.full(2 * m, sym.n)
        self.child, self.next = np.full(2 * m, -1), np.full(2 * m, -1)
        self.symbol = np.zeros(2 * m, np.uint64)
        self.used = m
        self.root = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])

    def at(self, members: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return self.sym.get(self.who[members], depth)

    def matching(self, node: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the child that ``symbol`` leads to, or else any; how many children have smaller symbols)."""
        cur = self.child[node]
        out, less = cur.copy(), np.zeros(len(node), np.int64)
        live = np.arange(len(node))
        while len(live):
            have = self.symbol[cur]
            hit = have == symbol[live]
            out[live[hit]] = cur[hit]
            less[live] += have < symbol[live]
            cur = self.next[cur]
            live, cur = live[cur >= 0], cur[cur >= 0]
        return out, less

    def walk(self, members: np.ndarray, group: np.ndarray, to: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(node, parent): down from the root to a leaf, or to the first node not above depth ``to``."""
        node, parent = self.root[group], np.full(len(members), -1)
        to = np.full(len(members), self.sym.n) if to is None else to
        live = np.flatnonzero(self.depth[node] < to)
        while len(live):
            here = node[live]
            parent[live] = here
            node[live], _ = self.matching(here, self.at(members[live], self.depth[here]))
            live = live[self.depth[node[live]] < to[live]]
        return node, parent

    def insert(self, new: np.ndarray, like: np.ndarray, group: np.ndarray, depth: np.ndarray) -> None:
        """At most one new leaf in each group; ``like``: the leaf that it was compared with; ``depth``: where they differ."""
        node, parent = self.walk(new, group, depth)
        self.symbol[new] = self.at(new, depth)
        there = self.depth[node] == depth
        self.next[new[there]] = self.child[node[there]]
        self.child[node[there]] = new[there]
        new, like, group, depth, node, parent = (x[~there] for x in (new, like, group, depth, node, parent))
        branch = self.used + np.arange(len(new))
        self.used += len(new)
        self.depth[branch], self.symbol[branch], self.next[branch] = depth, self.symbol[node], self.next[node]
        at_root = parent < 0
        self.root[group[at_root]] = branch[at_root]
        rest = np.flatnonzero(~at_root)
        head = self.child[parent[rest]] == node[rest]
        self.child[parent[rest[head]]] = branch[rest[head]]
        rest = rest[~head]
        before = self.child[parent[rest]]
        while len(rest):
            found = self.next[before] == node[rest]
            self.next[before[found]] = branch[rest[found]]
            rest, before = rest[~found], self.next[before[~found]]
        self.child[branch], self.next[node], self.next[new] = node, new, -1
        self.symbol[node] = self.at(like, depth)

    def ranks(self, members: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The place in order of each leaf, all groups in a row."""
        node, columns = self.root[group], [group]
        live = np.flatnonzero(node >= self.leaves)
        while len(live):
            here = node[live]
            node[live], less = self.matching(here, self.at(members[live], self.depth[here]))
            column = np.zeros(len(members), np.int64)
            column[live] = less
            columns.append(column)
            live = live[node[live] >= self.leaves]
        out = np.empty(len(members), np.int64)
        out[np.lexsort(columns[::-1])] = np.arange(len(members))
        return out


def blind_tries(sym: Symbols, who: np.ndarray, group: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(who in order, same) for groups whose members are equal up to ``depth``, a number for each group."""
    tries = Tries(sym, who, group)
    like = np.full(len(who), -1)
    like[tries.root] = tries.root
    rest = np.flatnonzero(like < 0)
    while len(rest):
        leaf, _ = tries.walk(rest, group[rest])
        differ = sym.first_difference(who[rest], who[leaf], depth[group[rest]])
        equal = differ == sym.n
        like[rest[equal]] = leaf[equal]
        rest, leaf, differ = rest[~equal], leaf[~equal], differ[~equal]
        if len(rest):
            g = group[rest]
            lead = np.r_[True, g[1:] != g[:-1]]
            new = rest[lead]
            tries.insert(new, leaf[lead], g[lead], differ[lead])
            like[new] = new
            rest = rest[~lead]
    own = np.flatnonzero(like == np.arange(len(who)))
    rank = np.empty(len(who), np.int64)
    rank[own] = tries.ranks(own, group[own])
    rank = rank[like]
    order = np.argsort(rank, kind="stable")
    rank = rank[order]
    return who[order], np.r_[False, rank[1:] == rank[:-1]]
