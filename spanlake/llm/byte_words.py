"""A table-driven byte transducer over UTF-8 texts, and the hash table that takes its word spans."""

from __future__ import annotations

import numpy as np

WHITE = b" \t\n\x0b\x0c\r"
SPLIT = 0xFF  # stands between texts; no UTF-8 text holds it

#: States: between words, inside a word, and inside a word with one to three bytes of a code point to come.
BETWEEN, INSIDE, ONE_MORE = 0, 1, 2
STATE_BITS = 3
#: What a transition puts out, above the state's bits.
STARTS, ENDS, CAPITAL, POINT, SYMBOL = (1 << (STATE_BITS + k) for k in range(5))

SLICE = 1 << 21  # bytes that are read at a time
LANE = 256  # bytes of a lane; all lanes of a slice take their steps together
WARM_UP = 4  # bytes before a lane that fix its state


def transitions(symbols: bytes) -> np.ndarray:
    """`table[state * 256 + byte]`: the next state, and what the step puts out. A byte that no UTF-8 text has at its place
    is taken as the first of a code point."""
    table = np.zeros((5, 256), dtype=np.uint8)
    for state in range(5):
        for byte in range(256):
            if byte == SPLIT or byte in WHITE:
                out = BETWEEN | (ENDS if state else 0) | (0 if byte == SPLIT else POINT)
            elif state >= ONE_MORE and 0x80 <= byte < 0xC0:
                out = state - 1
            else:
                more = 1 if 0xC2 <= byte < 0xE0 else 2 if 0xE0 <= byte < 0xF0 else 3 if 0xF0 <= byte < 0xF5 else 0
                out = (INSIDE + more) | POINT | (STARTS if state == BETWEEN else 0)
                out |= (CAPITAL if 0x41 <= byte <= 0x5A else 0) | (SYMBOL if byte in symbols else 0)
            table[state, byte] = out
    return table.reshape(-1)


def transduce(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What the transducer puts out at each byte of `data`, which starts between words.

    The bytes stand in lanes of `LANE`; step k reads byte k of every lane by one look-up. A lane first reads the last bytes of the one
    before without putting anything out: no code point is longer, so they fix its state.
    """
    lanes = -(-len(data) // LANE)
    held = np.full(lanes * LANE, SPLIT, dtype=np.uint8)
    held[: len(data)] = data
    steps = np.ascontiguousarray(held.reshape(lanes, LANE).T)
    state = np.zeros(lanes, dtype=np.intp)
    before = np.full((WARM_UP, lanes), SPLIT, dtype=np.uint8)
    before[:, 1:] = steps[LANE - WARM_UP :, :-1]
    for row in before:
        state = (table.take((state << 8) | row) & 7).astype(np.intp)
    out = np.empty_like(steps)
    for k in range(LANE):
        table.take((state << 8) | steps[k], out=out[k])
        state = (out[k] & 7).astype(np.intp)
    return np.ascontiguousarray(out.T).reshape(-1)[: len(data)]


def _chunks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; `data` has eight more bytes than places."""
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


_KEPT = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)  # the first k of eight bytes
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _word_part(places: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k to 8k + 7 of each word, zero behind its end."""
    return places[starts + 8 * k] & _KEPT[np.minimum(lengths - 8 * k, 8)]


def first_of_each(data: np.ndarray, texts: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of the word spans hold a word that no earlier taken span of the same text holds.

    All spans are inserted into one open-addressing table together: a free slot goes to one of the spans that ask for it, a span whose slot holds
    the same word of the same text is a repeat, and the others go on to the next slot. Equal hashes are never taken for equal words: text, length
    and every byte are compared.
    """
    n = len(starts)
    taken = np.zeros(n, dtype=bool)
    if not n:
        return taken
    places = _chunks(np.concatenate([data, np.zeros(8, dtype=np.uint8)]))
    hashes = (texts.astype(np.uint64) + np.uint64(1)) * _MIX ^ lengths.astype(np.uint64)
    rows, k = np.arange(n), 0
    while len(rows):
        mixed = (hashes[rows] ^ _word_part(places, starts[rows], lengths[rows], k)) * _MIX
        hashes[rows] = mixed ^ (mixed >> np.uint64(29))
        k += 1
        rows = rows[lengths[rows] > 8 * k]
    bits = max(4, int(2 * n - 1).bit_length())
    mask = (1 << bits) - 1
    slots = ((hashes * _MIX) >> np.uint64(64 - bits)).astype(np.int64)
    table = np.full(1 << bits, -1, dtype=np.int64)
    todo = np.arange(n)
    while len(todo):
        at = slots[todo]
        free = table[at] < 0
        table[at[free]] = todo[free]
        holder = table[at]
        mine = holder == todo
        taken[todo[mine]] = True
        rest, holder = todo[~mine], holder[~mine]
        same = (hashes[rest] == hashes[holder]) & (texts[rest] == texts[holder]) & (lengths[rest] == lengths[holder])
        check, k = np.flatnonzero(same), 0
        while len(check):
            a, b = rest[check], holder[check]
            equal = _word_part(places, starts[a], lengths[a], k) == _word_part(places, starts[b], lengths[b], k)
            same[check[~equal]] = False
            k += 1
            check = check[equal & (lengths[a] > 8 * k)]
        todo = rest[~same]
        slots[todo] = (slots[todo] + 1) & mask
    return taken


def _pieces(texts: list[bytes]):
    """`(rows, parts)` of about `SLICE` bytes; a longer text comes in several parts, cut before a white byte."""
    rows, parts, held = [], [], 0
    for row, text in enumerate(texts):
        start = 0
        while start < len(text):
            end = min(start + SLICE, len(text))
            while end < len(text) and text[end] not in WHITE:
                end += 1
            rows.append(row)
            parts.append(text[start:end] if end - start < len(text) else text)
            held += end - start
            start = end
            if held >= SLICE:
                yield rows, parts
                rows, parts, held = [], [], 0
    if parts:
        yield rows, parts


COUNTS = ("words", "distinct_words", "capitals", "code_points", "symbols")


def measure(texts: list[bytes], symbols: bytes) -> np.ndarray:
    """One row of `COUNTS` for each text: words are runs of bytes that are not ASCII white space, capitals are A-Z."""
    table = transitions(symbols)
    sums = np.zeros((len(texts), len(COUNTS)), dtype=np.int64)
    longer: dict[int, set[bytes]] = {}
    for rows, parts in _pieces(texts):
        which = np.array(rows, dtype=np.int64)
        joined = bytes([SPLIT]).join(parts) + bytes([SPLIT])
        data = np.frombuffer(joined, dtype=np.uint8)
        out = transduce(data, table)
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts = np.flatnonzero((out & STARTS) != 0)
        stops = np.flatnonzero((out & ENDS) != 0)
        part = np.searchsorted(ends, starts, side="right")
        first = first_of_each(data, part, starts, stops - starts)
        several = [k for k, row in enumerate(rows) if len(parts[k]) < len(texts[row])]
        for k in several:
            mine = first & (part == k)
            longer.setdefault(rows[k], set()).update(joined[a:b] for a, b in zip(starts[mine].tolist(), stops[mine].tolist(), strict=True))
        per_part = np.zeros((len(parts), len(COUNTS)), dtype=np.int64)
        per_part[:, 0] = np.bincount(part, minlength=len(parts))
        per_part[:, 1] = np.bincount(part[first], minlength=len(parts))
        for column, mark in ((2, CAPITAL), (4, SYMBOL)):
            per_part[:, column] = np.bincount(np.searchsorted(ends, np.flatnonzero((out & mark) != 0), side="right"), minlength=len(parts))
        points = np.add.reduceat((out & POINT) != 0, np.concatenate(([0], ends[:-1])), dtype=np.int64)
        per_part[:, 3] = points
        np.add.at(sums, which, per_part)
    for row, words in longer.items():
        sums[row, 1] = len(words)
    return sums
