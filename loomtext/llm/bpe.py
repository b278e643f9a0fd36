"""Byte-pair merging of many words at once on flat numpy arrays."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np

#: Words of more symbols are merged rank by rank, all places of a rank at once, shorter ones each by its own lowest pair.
LONG_WORD = 200
#: Places in a word that a pair's rank is coded with; more than LONG_WORD.
_PLACES = 256
_NONE = np.int64(1) << np.int64(40)
#: Places of one rank that are looked at together where a merge may bring up a lower rank.
_AT_ONCE = 1024


class PairTable:
    """Merge rules as sorted int64 pair keys, looked up by binary search.

    `pairs` holds (left id, right id, rank, merged id). The lowest rank merges first, the leftmost pair on ties.
    """

    def __init__(self, pairs: Sequence[tuple[int, int, int, int]]) -> None:
        table = np.asarray(pairs, dtype=np.int64).reshape(-1, 4)
        self.base = int(table[:, [0, 1, 3]].max(initial=0)) + 2
        keys = table[:, 0] * self.base + table[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], table[order, 2], table[order, 3]
        made_at = np.full(self.base + 1, -1, np.int64)
        np.maximum.at(made_at, table[:, 3], table[:, 2])
        late = np.unique(np.concatenate([table[made_at[table[:, k]] >= table[:, 2], k] for k in (0, 1)]))
        #: Ranks of rules whose symbol is part of a rule that doesn't rank behind them.
        self.overtaken = frozenset(table[np.isin(table[:, 3], late), 2].tolist())

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged ids; a pair without a rule gets _NONE."""
        if not len(self.keys):
            return np.full(len(left), _NONE), np.zeros(len(left), np.int64)
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = (self.keys[at] == keys) & (left >= 0) & (right >= 0) & (right < self.base)  # else a key stands for another pair
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def _in_order(self, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge long words rank by rank: a round takes the lowest rank of all words and merges all its places at once.

        Places of one rank that overlap merge from the left. Where a merge makes a pair that doesn't rank behind it, what
        lies behind in its word waits, as that pair comes next. Symbols stay where they are, linked to their neighbours,
        so that a round costs what it merges.
        """
        n, owner, ends = len(sym), np.repeat(np.arange(len(lens)), lens), np.cumsum(lens)
        sym, alive = sym.copy(), np.ones(n, bool)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - lens] = -1
        rank, made = np.full(n, _NONE), np.zeros(n, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def note(at: np.ndarray) -> None:
            """Look up the pairs that begin at these places and list them by rank."""
            rank[at] = _NONE
            at = at[after[at] >= 0]
            rank[at], made[at] = self._find(sym[at], sym[after[at]])
            at = at[rank[at] < _NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            found, first = np.unique(rank[at], return_index=True)
            for r, places in zip(found.tolist(), np.split(at, first[1:])):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(places)

        note(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            lists = waiting.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            if r in self.overtaken and len(at) > _AT_ONCE:
                waiting[r], at = [at[_AT_ONCE:]], at[:_AT_ONCE]
                heapq.heappush(ranks, r)
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            start = np.concatenate([[True], after[at[:-1]] != at[1:]])
            run = np.flatnonzero(start)[np.cumsum(start) - 1]
            every, at = at, at[(np.arange(len(at)) - run) % 2 == 0]
            if r in self.overtaken:
                # the first place in its word that makes a pair of no higher rank is merged, all behind it waits
                new, left, right = made[at], before[at], after[after[at]]
                beside = np.where(left >= 0, sym[left], -1)
                joins = np.flatnonzero(right[:-1] == at[1:]) + 1
                beside[joins] = new[joins - 1]
                low = (self._find(beside, new)[0] <= r) | (self._find(new, np.where(right >= 0, sym[right], -1))[0] <= r)
                if low.any():
                    stop = np.full(len(lens), n, np.int64)
                    np.minimum.at(stop, owner[at[low]], at[low])
                    later, at = every[every > stop[owner[every]]], at[at <= stop[owner[at]]]
                    if r not in waiting:
                        heapq.heappush(ranks, r)
                    waiting[r] = [later, *waiting.get(r, [])]
            gone = after[at]
            sym[at] = made[at]
            alive[gone] = False
            then = after[gone]
            after[at] = then
            before[then[then >= 0]] = at[then >= 0]
            left = before[at]
            note(np.unique(np.concatenate([left[left >= 0], at])))
        return sym[alive], np.bincount(owner[alive], minlength=len(lens)).astype(np.int64)

    def merge(self, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every word to its final symbols; `sym` holds the words behind one another, `lens` their lengths.

        A round finds each word's lowest-ranked pair, merges its leftmost place and sets finished words aside, until
        none is left. Symbols below 0 never merge. Returns the same form in the same order.
        """
        sym, lens = np.asarray(sym, np.int64), np.asarray(lens, np.int64)
        owner = np.arange(len(lens))
        done_owner, done_lens, done_sym = [], [], []

        def aside(own: np.ndarray, many: np.ndarray, symbols: np.ndarray) -> None:
            done_owner.append(own)
            done_lens.append(many)
            done_sym.append(symbols)

        long, empty = lens > LONG_WORD, lens == 0
        if long.any():
            aside(owner[long], *self._in_order(sym[np.repeat(long, lens)], lens[long])[::-1])
        if long.any() or empty.any():
            aside(owner[empty], lens[empty], sym[:0])
            apart = long | empty
            sym, owner, lens = sym[np.repeat(~apart, lens)], owner[~apart], lens[~apart]
        ends = np.cumsum(lens)
        rank, made = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        rank[:-1], made[:-1] = self._find(sym[:-1], sym[1:])
        rank[ends - 1] = _NONE
        while len(owner):
            starts = ends - lens
            place = np.arange(len(sym)) - np.repeat(starts, lens)
            lowest = np.minimum.reduceat(rank * _PLACES + place, starts)
            done = lowest >= _NONE * _PLACES
            if done.any():
                over = np.repeat(done, lens)
                aside(owner[done], lens[done], sym[over])
                sym, rank, made = sym[~over], rank[~over], made[~over]
                owner, lens, lowest = owner[~done], lens[~done], lowest[~done]
                if not len(owner):
                    break
                starts = np.cumsum(lens) - lens
            at = starts + lowest % _PLACES
            sym[at] = made[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, rank, made = sym[stay], rank[stay], made[stay]
            at = at - np.arange(len(at))  # one symbol went from each word before
            lens = lens - 1
            ends = np.cumsum(lens)
            last = at == ends - 1
            rank[at[last]] = _NONE
            here = at[~last]
            rank[here], made[here] = self._find(sym[here], sym[here + 1])
            before = at[at > ends - lens] - 1
            rank[before], made[before] = self._find(sym[before], sym[before + 1])
        if not done_owner:
            return sym, lens
        own, many, symbols = np.concatenate(done_owner), np.concatenate(done_lens), np.concatenate(done_sym)
        order = np.argsort(own, kind="stable")
        first = (np.cumsum(many) - many)[order]
        many = many[order]
        return symbols[np.arange(len(symbols)) + np.repeat(first - (np.cumsum(many) - many), many)], many
