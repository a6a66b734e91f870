"""Simple-8b: varying counts of small numbers in 64-bit words, by a 4-bit selector.

Numbers are coded in blocks of BLOCK values; every block starts at a word of its
own, whose offset is kept, so that all blocks decode together in array steps. A
value of more than 30 bits is an escape: a word with selector 15, then the value
itself as one raw word.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
# The published Simple-8b selectors 0 to 14, as (values in the word, bits of each).
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30)]
ESCAPE = 15
_COUNTS = np.array([n for n, _ in SELECTORS] + [1], np.int64)


def _all_of(fits: np.ndarray, count: int) -> np.ndarray:
    """For each place of a row, whether it and the count - 1 places after it are all true."""
    out, width = fits, 1
    while width < count:
        more = min(width, count - width)
        out = out[:, : out.shape[1] - more] & out[:, more:]
        width += more
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): the words of all blocks, and the first word of each block and the end."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    starts = np.arange(0, n, BLOCK)
    ends = np.minimum(starts + BLOCK, n)
    end = np.repeat(ends, ends - starts)
    chosen = np.full((len(starts), BLOCK), ESCAPE, np.int8)
    held = np.zeros(chosen.size, np.uint64)
    held[:n] = values
    # What lies beyond a block's end fits any selector.
    fits = np.ones((len(starts), BLOCK + SELECTORS[0][0]), bool)
    for s in range(len(SELECTORS) - 1, -1, -1):  # selectors that hold more win, so they are set last
        count, bits = SELECTORS[s]
        fits[:, :BLOCK] = held.reshape(-1, BLOCK) < np.uint64(1 << bits)
        if fits[:, :BLOCK].any():
            chosen[_all_of(fits, count)[:, :BLOCK]] = s
    chosen = chosen.reshape(-1)[:n]
    step = np.minimum(np.arange(n) + _COUNTS[chosen], end)
    heads, place = [], starts
    while len(place):  # all blocks go forward together, a word each time
        heads.append(place)
        after = step[place]
        place = after[after < end[place]]
    head = np.sort(np.concatenate(heads))
    block = head // BLOCK
    selector = chosen[head].astype(np.int64)
    size = 1 + (selector == ESCAPE)
    slot = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(selector == s)
        word = np.full(len(mine), s << 60, np.uint64)
        for j in range(count if bits else 0):
            source = head[mine] + j
            inside = source < end[head[mine]]
            word |= np.where(inside, values[np.minimum(source, n - 1)], np.uint64(0)) << np.uint64(j * bits)
        words[slot[mine]] = word
    escaped = np.flatnonzero(selector == ESCAPE)
    words[slot[escaped]] = np.uint64(ESCAPE << 60)
    words[slot[escaped] + 1] = values[head[escaped]]
    return words, np.concatenate([slot[np.searchsorted(block, np.arange(len(starts)))], [len(words)]])


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values of the blocks whose words start at the offsets."""
    if not n:
        return np.zeros(0, np.uint64)
    raw = np.zeros(len(words), bool)  # the second words of escapes; only a few words can be such
    selector = (words >> np.uint64(60)).astype(np.int64)
    for i in np.flatnonzero(selector == ESCAPE).tolist():
        if not raw[i]:
            raw[i + 1] = True
    coded = np.flatnonzero(~raw)
    selector = selector[coded]
    block = np.searchsorted(offsets, coded, side="right") - 1
    # Where each word's values begin inside its block.
    upto = np.cumsum(_COUNTS[selector])
    first = np.searchsorted(block, np.arange(len(offsets) - 1))
    begin = upto - _COUNTS[selector]
    begin = begin - begin[first][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(selector == s)
        for j in range(count if bits and len(mine) else 0):
            to = begin[mine] + j
            inside = to < end[mine]
            out[to[inside]] = (words[coded[mine[inside]]] >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1)
    escaped = np.flatnonzero(selector == ESCAPE)
    out[begin[escaped]] = words[coded[escaped] + 1]
    return out
