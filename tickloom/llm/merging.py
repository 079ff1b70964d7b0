"""Pair merging of one long sequence, for vocabularies that merge adjacent pairs by rank.

Short sequences are merged many at a time in numpy rounds by their own modules.  A sequence of very many
symbols would make every such round as long as itself, so here its places lie in one bucket per rank, a
round takes the lowest rank and all of its places from left to right, and ranks are looked up again only
beside a merged place.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np

#: Symbols are below 2**20, so that a pair is one 64-bit number.
SHIFT = 20
_GONE = -1


def group_places(ranks: np.ndarray, none: int) -> dict[int, list[int]]:
    """Places by rank, ascending within each; places of rank `none` are left out."""
    at = np.flatnonzero(ranks != none)
    if not len(at):
        return {}
    order = at[np.argsort(ranks[at], kind="stable")]
    found = ranks[order]
    cuts = np.flatnonzero(np.diff(found)) + 1
    return {int(ranks[part[0]]): part.tolist() for part in np.split(order, cuts)}


def merge_sequence(symbols: list[int], places: dict[int, list[int]], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """The symbols left when no known pair remains.

    `places` holds the first place of every known pair by rank, ascending; `pairs` gives (rank, merged
    symbol) of `left << SHIFT | right`.  The lowest rank goes first, and of one rank the leftmost place;
    a merge that makes a pair of a lower rank hands over to that rank at once.  Negative symbols never merge.
    """
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ranks = sorted(places)  # a sorted list is a heap

    def offer(left: int, right: int) -> int:
        found = pairs.get(symbols[left] << SHIFT | symbols[right]) if symbols[left] >= 0 and symbols[right] >= 0 else None
        if found is None:
            return 1 << 62
        if found[0] not in places:
            places[found[0]] = []
            heappush(ranks, found[0])
        heappush(places[found[0]], left)
        return found[0]

    while ranks:
        rank = ranks[0]
        bucket = places[rank]
        while bucket:
            i = heappop(bucket)
            j = after[i]
            if symbols[i] < 0 or j >= n or symbols[j] < 0:
                continue
            found = pairs.get(symbols[i] << SHIFT | symbols[j])
            if found is None or found[0] != rank:
                continue  # a neighbour was merged since
            symbols[i], symbols[j] = found[1], _GONE
            k = after[j]
            after[i] = k
            lowest = 1 << 62
            if k < n:
                before[k] = i
                lowest = offer(i, k)
            if before[i] >= 0:
                lowest = min(lowest, offer(before[i], i))
            if lowest < rank:
                break
        else:
            del places[rank]
            heappop(ranks)
    return [s for s in symbols if s != _GONE]
