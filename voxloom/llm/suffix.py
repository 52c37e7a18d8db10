"""A suffix automaton over any hashable symbols, built online."""

from __future__ import annotations


class SuffixAutomaton:
    """Recognises every factor of the sequences fed to it; states are at most twice the symbols."""

    __slots__ = ("last", "length", "link", "next")

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def __len__(self) -> int:
        return len(self.length)

    def begin(self) -> None:
        """What follows is a new sequence: no factor reaches across."""
        self.last = 0

    def extend(self, c) -> int:
        """Append ``c``; the length of the longest suffix, now, that ended somewhere before as well."""
        nxt, link, length, p = self.next, self.link, self.length, self.last
        q = nxt[p].get(c)
        if q is not None:
            if length[q] != length[p] + 1:
                q = self._clone(p, c, q)
            self.last = q
            return length[q]
        self.last = new = len(length)
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return length[link[new]]

    def _clone(self, p: int, c, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(length)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def statistics(self, symbols):
        """The length of the longest suffix, at each of ``symbols``, that the automaton recognises."""
        nxt, link, length, at, n = self.next, self.link, self.length, 0, 0
        for c in symbols:
            while at and c not in nxt[at]:
                at = link[at]
                n = length[at]
            to = nxt[at].get(c)
            if to is not None:
                at, n = to, n + 1
            yield n

    def phrases(self, symbols) -> int:
        """Cross-parsing: how many longest matches, or single unknown symbols, make up ``symbols``."""
        return self.parsed(symbols)[0]

    def parsed(self, symbols, most: int | None = None) -> tuple[int, int]:
        """(phrases, symbols read): of all ``symbols``, or up to where over ``most`` phrases are needed."""
        nxt, at, n, root = self.next, 0, 0, True
        left = iter(symbols)
        for c in left:
            to = nxt[at].get(c)
            if to is None:
                if most is not None and n >= most:  # the phrase before is one too many, or the next is
                    return n + 1, len(symbols) - left.__length_hint__()
                if not root:
                    n += 1  # the phrase before ends
                to = nxt[0].get(c)
                if to is None:  # a phrase of its own
                    n += 1
                    at, root = 0, True
                    continue
            at, root = to, False
        return n + (not root), len(symbols)
