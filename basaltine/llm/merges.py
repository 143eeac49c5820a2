"""Byte-pair merging of many short sequences at once, on ragged numpy arrays.

The sequences lie one after another in one array of symbols. In every round each sequence takes its pair of lowest
rank: all its occurrences from the left (or only the first one), and all sequences at once. Sequences without a
further pair leave the array. Only pairs beside a merge are looked up again.
"""

from __future__ import annotations

import numpy as np

#: The rank of a pair that does not merge.
NEVER = np.iinfo(np.int32).max


class MergeTable:
    """Pairs of symbols to the rank of their merge and the symbol that it makes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray, symbols: int):
        keys = left.astype(np.int64) * symbols + right
        order = np.argsort(keys)
        self.symbols, self.keys = symbols, keys[order]
        self.rank, self.made = rank[order].astype(np.int32), made[order].astype(np.int32)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.int64) * self.symbols + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.rank[at], NEVER), self.made[at]


def merged(table: MergeTable, symbols: np.ndarray, lengths: np.ndarray, first_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The symbols left of each sequence: (all of them, one sequence after another; how many each has).

    ``first_only`` merges only a sequence's leftmost pair of the lowest rank in a round, for tables where a merge can
    make a pair of lower rank than its own.
    """
    symbols, lengths = symbols.astype(np.int32), lengths.astype(np.int64)
    whose = np.arange(len(lengths))
    done_symbols, done_whose, done_lengths = [], [], []
    # rank and result of the pair that starts at each place; none at a sequence's end
    rank, made = np.full(len(symbols), NEVER, np.int32), np.zeros(len(symbols), np.int32)
    inner = np.ones(len(symbols), bool)
    inner[np.cumsum(lengths)[lengths > 0] - 1] = False
    at = np.flatnonzero(inner)
    if len(at):
        rank[at], made[at] = table.find(symbols[at], symbols[at + 1])
    while len(symbols):
        starts = np.cumsum(lengths) - lengths
        some = lengths > 0
        lowest = np.full(len(lengths), NEVER, np.int32)
        lowest[some] = np.minimum.reduceat(rank, starts[some])
        live = lowest < NEVER
        if not live.all():
            stay = np.repeat(live, lengths)
            done_symbols.append(symbols[~stay])
            done_whose.append(whose[~live])
            done_lengths.append(lengths[~live])
            symbols, rank, made = symbols[stay], rank[stay], made[stay]
            lengths, whose, lowest = lengths[live], whose[live], lowest[live]
            if not len(symbols):
                break
            starts = np.cumsum(lengths) - lengths
        hits = np.flatnonzero(rank == np.repeat(lowest, lengths))
        if first_only:
            owner = np.searchsorted(starts, hits, "right") - 1
            hits = hits[np.r_[True, owner[1:] != owner[:-1]]]
        else:
            # of overlapping pairs every other one merges, from the left
            run = np.cumsum(np.r_[True, np.diff(hits) != 1])
            lead = hits[np.r_[True, np.diff(hits) != 1]]
            hits = hits[(hits - lead[run - 1]) % 2 == 0]
        owner = np.searchsorted(starts, hits, "right") - 1
        symbols[hits] = made[hits]
        keep = np.ones(len(symbols), bool)
        keep[hits + 1] = False
        np.subtract.at(lengths, owner, 1)
        # pairs beside the merges, in the places after removal
        new = hits - np.arange(len(hits))
        symbols, rank, made = symbols[keep], rank[keep], made[keep]
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(lengths) - 1] = True
        first = np.zeros(len(symbols), bool)
        first[np.cumsum(lengths) - lengths] = True
        again = np.unique(np.r_[new, new[~first[new]] - 1])
        rank[again] = NEVER
        again = again[~last[again]]
        rank[again], made[again] = table.find(symbols[again], symbols[again + 1])
    if not done_whose:
        return symbols, lengths
    whose, lengths = np.concatenate(done_whose), np.concatenate(done_lengths)
    symbols = np.concatenate(done_symbols)
    order = np.argsort(whose, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    picks = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(symbols))
    return symbols[picks], sizes
