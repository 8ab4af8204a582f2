"""Suffix automaton over words, with the smallest document of each state."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class Automaton:
    """All word sequences of some passages, each passage with the number of its document.

    Built online (Blumer et al. 1985); passages are kept apart by symbols that no
    word has.  ``least`` has, for each state, the smallest document in which the
    state's sequences stand.
    """

    def __init__(self, passages: Iterable[tuple[int, Sequence[str]]]):
        self.symbol: dict[str, int] = {}
        nxt: list[dict[int, int]] = [{}]
        link, length, least = [-1], [0], [1 << 63]
        symbol, last, gap = self.symbol, 0, -1
        for document, words in passages:
            codes = [symbol.setdefault(w, len(symbol)) for w in words]
            codes.append(gap)
            gap -= 1
            for c in codes:
                new = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                least.append(document if c >= 0 else 1 << 63)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    if length[p] + 1 == length[q]:
                        link[new] = q
                    else:
                        clone = len(nxt)
                        nxt.append(nxt[q].copy())
                        length.append(length[p] + 1)
                        link.append(link[q])
                        least.append(1 << 63)
                        while p >= 0 and nxt[p].get(c) == q:
                            nxt[p][c] = clone
                            p = link[p]
                        link[q] = link[new] = clone
                last = new
        for state in sorted(range(1, len(nxt)), key=length.__getitem__, reverse=True):
            up = link[state]
            if least[state] < least[up]:
                least[up] = least[state]
        self.next, self.link, self.length, self.least = nxt, link, length, least

    def shared(self, words: Sequence[str], window: int, below: int) -> list[tuple[int, int]]:
        """Maximal [from, to) spans of ``words`` covered by windows that stand in a document smaller than ``below``.

        Streams matching statistics: after each word the longest sequence ending
        there that the automaton knows, held at ``window`` words at most.
        """
        nxt, link, length, least = self.next, self.link, self.length, self.least
        state = matched = 0
        out: list[tuple[int, int]] = []
        for i, w in enumerate(words):
            c = self.symbol.get(w, None)
            if c is None:
                state = matched = 0
                continue
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(c)
            if to is None:
                matched = 0
                continue
            state = to
            matched += 1
            if matched >= window:
                matched = window
                while length[link[state]] >= window:
                    state = link[state]
                if least[state] < below:
                    a = i + 1 - window
                    if out and out[-1][1] >= a:
                        out[-1] = (out[-1][0], i + 1)
                    else:
                        out.append((a, i + 1))
        return out
