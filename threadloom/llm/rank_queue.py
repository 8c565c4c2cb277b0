"""Byte-pair merging with a hierarchical-bitmap rank queue, over many pieces laid end to end."""

from __future__ import annotations

from array import array

import numpy as np

FEW = 12  # positions of one rank that are merged one by one; more are merged as arrays


class RankQueue:
    """Merges by the ranks of a vocabulary. A byte that is no token is an error where it occurs.

    All pieces form one linked list of symbols that is cut at the borders of pieces. The queue holds, per rank, the
    positions whose pair had that rank when it was noted. Two levels of bits tell which ranks have positions:
    ``words[w]`` has a bit per rank of 256, ``summary`` a bit per word that isn't zero; find-first-set in both gives
    the lowest rank. Its positions are merged together, from left to right in each piece; positions whose pair has
    changed since are stale and skipped. Where a merge makes a pair of lower rank, the later positions of its piece
    wait until that one is done, so each piece is merged as if it were alone: always the lowest rank, the leftmost of
    equals.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.border = max(ranks.values()) + 1  # the symbol at index n: it makes no pair
        self.base = self.border + 1
        self.pairs = {left * self.base + right: rank for token, rank in ranks.items() for cut in range(1, len(token))
                      if (left := ranks.get(token[:cut])) is not None
                      and (right := ranks.get(token[cut:])) is not None}
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.values = np.append(np.fromiter(self.pairs.values(), np.int32, len(keys))[order], np.int32(-1))
        self.words = [0] * ((self.base >> 8) + 1)  # all zero between calls
        self.singles = np.array([ranks.get(bytes([b]), self.border) for b in range(256)], np.int32)
        self.doubles = self.ranks_of(np.repeat(self.singles, 256), np.tile(self.singles, 256))

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where they make no token."""
        wanted = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.values[at], np.int32(-1))

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, none of them empty, and where each piece's ids begin; the last entry is their number."""
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        line = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(line)
        stops = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        starts = np.concatenate(([0], stops[:-1]))
        if (self.singles[line] == self.border).any():
            raise KeyError("a byte that is no token")
        symbol = np.append(self.singles[line], np.int32(self.border))  # -1 where a symbol was merged into another
        after = np.arange(1, n + 2, dtype=np.int32)
        after[stops - 1] = n
        after[n] = n
        before = np.arange(-1, n, dtype=np.int32)
        before[starts] = n
        pair = np.full(n + 1, -1, np.int32)  # rank of the pair whose left symbol is here
        pair[:n - 1] = self.doubles[line[:-1].astype(np.int32) << 8 | line[1:]]
        pair[stops - 1] = -1
        self._merge(symbol, after, before, pair, starts)
        left = symbol[:n] >= 0
        return symbol[:n][left], np.concatenate(([0], np.cumsum(left)[stops - 1]))

    def _merge(self, symbol, after, before, pair, starts) -> None:
        words, summary, lists = self.words, 0, {}
        rank_of, base = self.pairs.get, self.base
        symbols, afters, befores, ranks = map(memoryview, (symbol, after, before, pair))

        def note(rank: int, positions: bytes) -> None:
            nonlocal summary
            if rank in lists:
                lists[rank].frombytes(positions)
            else:
                lists[rank] = array("i", positions)
                words[rank >> 8] |= 1 << (rank & 255)
                summary |= 1 << (rank >> 8)

        def note_one(rank: int, position: int) -> None:
            nonlocal summary
            if rank in lists:
                lists[rank].append(position)
            else:
                lists[rank] = array("i", (position,))
                words[rank >> 8] |= 1 << (rank & 255)
                summary |= 1 << (rank >> 8)

        def note_all(found: np.ndarray, positions: np.ndarray) -> None:
            real = found >= 0
            found, positions = found[real], positions[real]
            if not len(found):
                return
            order = np.argsort(found, kind="stable")
            found, raw = found[order], positions[order].tobytes()
            first = np.concatenate(([0], np.flatnonzero(found[1:] != found[:-1]) + 1))
            cuts = (first * 4).tolist()
            for rank, a, b in zip(found[first].tolist(), cuts, [*cuts[1:], len(raw)], strict=True):
                note(rank, raw[a:b])

        note_all(pair[:-1], np.arange(len(pair) - 1, dtype=np.int32))
        while summary:
            w = (summary & -summary).bit_length() - 1
            bits = words[w]
            rank = w << 8 | (bits & -bits).bit_length() - 1
            words[w] = bits = bits & bits - 1
            if not bits:
                summary &= summary - 1
            waiting = lists.pop(rank)

            if len(waiting) <= FEW:
                waiting = sorted(waiting)
                for k, i in enumerate(waiting):
                    if ranks[i] != rank:
                        continue
                    middle, previous = afters[i], befores[i]
                    end = afters[middle]
                    symbols[i], symbols[middle], ranks[middle] = rank, -1, -1
                    afters[i], befores[end] = end, i
                    ranks[i] = right = rank_of(rank * base + symbols[end], -1)
                    ranks[previous] = left = rank_of(symbols[previous] * base + rank, -1)
                    if right >= 0:
                        note_one(right, i)
                    if left >= 0:
                        note_one(left, previous)
                    if (0 <= left < rank or 0 <= right < rank) and k + 1 < len(waiting):
                        note(rank, array("i", waiting[k + 1:]).tobytes())
                        break
                continue

            noted = np.sort(np.frombuffer(waiting, np.int32))
            at = noted = noted[pair[noted] == rank]
            follows = after[at[:-1]] == at[1:]
            if follows.any():  # of pairs that share a symbol every second one, from the left
                k = np.arange(len(at))
                heads = np.concatenate(([True], ~follows))
                at = at[(k - np.maximum.accumulate(np.where(heads, k, 0))) % 2 == 0]
            middle = after[at]
            end = after[middle]
            previous, beside = before[at], symbol[before[at]]
            touching = np.flatnonzero(end[:-1] == at[1:])
            previous[touching + 1], beside[touching + 1] = at[touching], rank
            right, left = np.split(self.ranks_of(
                np.concatenate((np.full(len(at), rank, np.int32), beside)),
                np.concatenate((symbol[end], np.full(len(at), rank, np.int32)))), 2)
            lower = np.minimum(right.view(np.uint32), left.view(np.uint32)) < rank
            held = lower.any()
            if held:  # in each piece, up to the first merge that makes a lower rank
                owner = np.searchsorted(starts, at, "right")
                seen = np.cumsum(lower) - lower
                go = seen == seen[np.searchsorted(owner, owner)]
                at, middle, end, previous, right, left = (x[go] for x in (at, middle, end, previous, right, left))
            symbol[at], symbol[middle], pair[middle] = rank, -1, -1
            after[at], before[end] = end, at
            pair[at] = right
            pair[previous] = left
            note_all(np.concatenate((right, left)), np.concatenate((at, previous)))
            if held and len(rest := noted[pair[noted] == rank]):
                note(rank, rest.tobytes())
