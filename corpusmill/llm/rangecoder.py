"""Adaptive context-mixing range coder for blocks of token ids, many blocks in step.

A block is coded on its own: its model starts afresh, and its sorted distinct ids stand before the payload. The probability
of the next id is a mixture of three predictions:

- order 2: the id that last followed the same two ids, with a confidence of 0 to 3 (how often it was right in a row),
- order 1: the same after the one id before,
- order 0: the frequencies of the block's ids so far, taken anew at positions 256, 512, 1024 and so on.

The weights of orders 2 and 1 are learned for each pair of confidences, and apart for predictions that agree; order 0 has
the rest, so every id of the block can always be coded. The three are added up for every id, and one subdivision of the
range codes it: with w the weights and F, C the order-0 frequencies and their sums before an id s,

    width(s) = w0 F(s) + TOTAL (w2 [s = p2] + w1 [s = p1]),   start(s) = w0 C(s) + TOTAL (w2 [p2 < s] + w1 [p1 < s]).

The range has 62 bits at most and gives up a word of 32 whenever it falls below 30, so a token makes one word at most.

All blocks of a group advance together, a token of each at a time, as NumPy vectors; a block's bytes don't depend on the
group.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
#: Order-0 frequencies of a block sum to TOTAL, which bounds its distinct ids; weights sum to TOTAL too.
TOTAL_BITS = 12
TOTAL = 1 << TOTAL_BITS
ORDER2_BITS = 11
FIRST_SCALE = 256
#: A predictor's entry: the id, and the confidence above it.
ID_MASK, CONFIDENCE = 0x3FFF, 14
#: Both weights of a class stand in one number, each in 16 bits of which the upper 12 count; they move by 1/32 a token.
RATE = 5
HALVES = np.uint32(0x07FF07FF)
FULL = 63 << 10 >> RATE
#: What the weights gain when the order-1 prediction, the order-2 prediction, or both were right (they share it).
GAIN = np.array([0, FULL, FULL << 16, (FULL // 2) << 16 | FULL // 2], np.uint32)
FIRST_WEIGHTS = np.uint32(6400 << 16 | 6400)
#: Steps between looks at the room left for words; a step makes one at most.
CHECK_ROOM = 64
#: Bytes of model state in a group.
GROUP_BYTES = 160_000_000

#: The range's bits below the word that leaves next; what the range keeps to at least; a word.
LOW_BITS, WORD_BITS = 30, 32
_LEAST, _LOW, _WORD = np.int64(1 << LOW_BITS), np.int64((1 << LOW_BITS) - 1), np.int64((1 << WORD_BITS) - 1)


class Model:
    """State of a group of blocks, one lane each; lanes are sorted by length, longest first."""

    def __init__(self, alphabets: list[int], decoding: bool):
        self.lanes, self.width = len(alphabets), max(alphabets)
        n, w = self.lanes, self.width
        self.sizes = np.array(alphabets)
        lane = np.arange(n)
        self.at0, self.at2, self.at_mix, self.at_slot = lane * w, lane << ORDER2_BITS, lane * 32, lane << TOTAL_BITS
        self.count = np.zeros(n * w, np.int32)
        self.order1 = np.zeros(n * w, np.uint16)
        self.order2 = np.zeros(n << ORDER2_BITS, np.uint16)
        self.mix = np.full(n * 32, FIRST_WEIGHTS, np.uint32)
        self.last = np.zeros(n, np.uint16)
        self.last2 = np.zeros(n, np.uint16)
        self.decoding = decoding
        self.scale(np.empty((0, n), np.uint16))

    def narrow(self, n: int) -> None:
        """Go on with the first n lanes."""
        self.lanes = n
        for name in ("at0", "at2", "at_mix", "at_slot", "last", "last2", "sizes"):
            setattr(self, name, getattr(self, name)[:n])

    def scale(self, new: np.ndarray) -> None:
        """Frequencies from the counts, to which new ids (a row a step) are added first: each id of the alphabet gets at
        least 1, the commonest takes what is left."""
        n, w = self.lanes, self.width
        self.table = np.empty((n, w), np.uint32)
        if self.decoding:
            self.slots = np.empty(n << TOTAL_BITS, np.uint16)
        for k in range(0, n, 256):
            to = min(n, k + 256)
            own = self.count[k * w : to * w]
            if len(new):
                own += np.bincount((new[:, k:to] + self.at0[: to - k]).ravel(), minlength=len(own)).astype(np.int32)
            count, size = own.reshape(to - k, w), self.sizes[k:to, None]
            share = ((TOTAL - size) / np.maximum(1, count.sum(axis=1, keepdims=True))).astype(np.float32)
            freq = (count * share).astype(np.int32)
            freq += np.arange(w) < size
            freq[np.arange(to - k), count.argmax(axis=1)] += TOTAL - freq.sum(axis=1)
            if (freq < 0).any():
                raise ArithmeticError("frequencies exceed their total")
            cum = np.cumsum(freq, axis=1, dtype=np.int32) - freq
            self.table[k:to] = (cum << 16 | freq).view(np.uint32)
            if self.decoding:
                self.slots[k << TOTAL_BITS : to << TOTAL_BITS] = np.repeat(np.tile(np.arange(w, dtype=np.uint16), to - k), freq.ravel())
        self.table = self.table.ravel()

    def predict(self) -> None:
        """Both predictions and the weights."""
        self.k2 = self.at2 + ((self.last * np.uint16(2503) + self.last2 * np.uint16(40503)) >> (16 - ORDER2_BITS))
        self.k1 = self.at0 + self.last
        self.e2, self.e1 = self.order2.take(self.k2), self.order1.take(self.k1)
        self.p2, self.p1 = self.e2 & ID_MASK, self.e1 & ID_MASK
        self.c2, self.c1 = self.e2 >> CONFIDENCE, self.e1 >> CONFIDENCE
        self.agree = self.p1 == self.p2
        self.km = self.at_mix + ((self.c2 << 2) + self.c1 + (self.agree.view(np.uint8) << 4))
        self.m = self.mix.take(self.km)
        self.w2, self.w1 = (self.m >> 20).view(np.int32), (self.m >> 4 & 0xFFF).view(np.int32)
        self.w0 = TOTAL - self.w2 - self.w1
        self.w2 <<= TOTAL_BITS
        self.w1 <<= TOTAL_BITS

    def place(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, width) of ids in the mixture."""
        cf = self.table.take(self.at0 + sym)
        self.hit2, self.hit1 = self.p2 == sym, self.p1 == sym
        start = self.w0 * (cf >> 16).view(np.int32) + self.w2 * (self.p2 < sym) + self.w1 * (self.p1 < sym)
        width = self.w0 * (cf & 0xFFFF).view(np.int32) + self.w2 * self.hit2 + self.w1 * self.hit1
        return start, width

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids whose interval of the mixture holds the values."""
        edges = []
        for p, w, other, w_other in ((self.p2, self.w2, self.p1, self.w1), (self.p1, self.w1, self.p2, self.w2)):
            cf = self.table.take(self.at0 + p)
            low = self.w0 * (cf >> 16).view(np.int32) + w_other * (other < p)
            edges.append((low, low + self.w0 * (cf & 0xFFFF).view(np.int32) + w + w_other * self.agree))
        (low2, high2), (low1, high1) = edges
        past2, past1 = value >= high2, value >= high1
        rest = (value - self.w2 * past2 - self.w1 * past1) / self.w0.astype(np.float64)
        out = self.slots.take(self.at_slot + np.minimum(rest.astype(np.int32), TOTAL - 1))
        np.copyto(out, self.p1, where=(value >= low1) & ~past1)
        np.copyto(out, self.p2, where=(value >= low2) & ~past2)
        return out

    def learn(self, sym: np.ndarray) -> None:
        """After place(sym)."""
        right = (self.hit2.view(np.uint8) << 1) | self.hit1.view(np.uint8)
        self.mix[self.km] = self.m - (self.m >> RATE & HALVES) + GAIN.take(right)
        for table, key, c, hit in ((self.order2, self.k2, self.c2, self.hit2), (self.order1, self.k1, self.c1, self.hit1)):
            table[key] = sym | (np.minimum(c + hit.view(np.uint8), 3) * hit << CONFIDENCE)
        self.last2, self.last = self.last, sym


def alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct ids, each id's place among them)."""
    most = int(ids.max())
    if most >= 1 << 20:
        letters, places = np.unique(ids, return_inverse=True)
        return letters, places.astype(np.uint16)
    there = np.zeros(most + 1, bool)
    there[ids] = True
    letters = np.flatnonzero(there)
    place = np.empty(most + 1, np.uint16)
    place[letters] = np.arange(len(letters))
    return letters.astype(np.int32), place[ids]


def groups(sizes: list[int], alphabets: list[int]) -> list[list[int]]:
    """Blocks to code together, longest first, within the bound of state."""
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    out: list[list[int]] = []
    widest = 0
    for k in order:
        widest = max(widest, alphabets[k])
        if out and (len(out[-1]) + 1) * (widest * 12 + TOTAL * 2 + (2 << ORDER2_BITS) + BLOCK * 5) <= GROUP_BYTES:
            out[-1].append(k)
        else:
            out.append([k])
            widest = alphabets[k]
    return out


def encode(blocks: list[np.ndarray]) -> list[tuple[np.ndarray, bytes]]:
    """(sorted distinct ids, payload) of each block of 1 to BLOCK ids."""
    split = [alphabet(b) for b in blocks]
    out: list = [None] * len(blocks)
    for group in groups([len(b) for b in blocks], [len(a) for a, _ in split]):
        lens = np.array([len(blocks[k]) for k in group])
        syms = np.zeros((len(group), int(lens[0])), np.uint16)
        for lane, k in enumerate(group):
            syms[lane, : lens[lane]] = split[k][1]
        words, used = _encode_group(np.ascontiguousarray(syms.T), lens, Model([len(split[k][0]) for k in group], False))
        for lane, k in enumerate(group):
            out[k] = split[k][0], words[lane, : used[lane]].astype("<u4").tobytes()
    return out


def _encode_group(syms: np.ndarray, lens: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    n = m.lanes
    room = len(syms) * 5 // 16 + CHECK_ROOM + 4
    words = np.zeros((n, room), np.int64)
    flat, to = words.ravel(), np.arange(n) * room
    low, rng = np.zeros(n, np.int64), np.full(n, 1 << LOW_BITS + WORD_BITS, np.int64)
    scaled, scale_at = 0, FIRST_SCALE

    def flush(upto: int) -> None:
        """End lanes from upto on: two words settle the value."""
        lane = slice(upto, m.lanes)
        flat[to[lane]] = low[lane] >> LOW_BITS
        flat[to[lane] + 1] = (low[lane] & _LOW) << WORD_BITS - LOW_BITS
        to[lane] += 2

    for t in range(len(syms)):
        if lens[m.lanes - 1] <= t:
            live = int(np.searchsorted(-lens, -t, side="left"))
            flush(live)
            m.narrow(live)
        if t == scale_at:
            m.scale(syms[scaled:t, : m.lanes])
            scaled, scale_at = t, 2 * t
        if t % CHECK_ROOM == 0 and (to - np.arange(n) * room).max() + CHECK_ROOM + 4 > room:
            more = room // 2 + CHECK_ROOM
            words = np.pad(words, ((0, 0), (0, more)))
            room += more
            flat, to = words.ravel(), to + np.arange(n) * more
        k = m.lanes
        sym = syms[t, :k]
        m.predict()
        start, width = m.place(sym)
        m.learn(sym)
        lo, ra = low[:k], rng[:k]
        r = ra >> 2 * TOTAL_BITS
        lo += r * start
        np.multiply(r, width, out=ra)
        i = np.flatnonzero(ra < _LEAST)
        if len(i):
            value, at = lo[i], to[i]
            flat[at] = value >> LOW_BITS
            lo[i] = (value & _LOW) << WORD_BITS
            ra[i] = ra[i] << WORD_BITS
            to[i] = at + 1
    flush(0)
    for col in range(room - 1, 0, -1):  # a word of over 32 bits carries into the one before
        words[:, col - 1] += words[:, col] >> WORD_BITS
    words &= _WORD
    return words, to - np.arange(n) * room


def decode(blocks: list[tuple[int, np.ndarray, bytes]]) -> list[np.ndarray]:
    """Ids of blocks given as (number of ids, sorted distinct ids, payload)."""
    out: list = [None] * len(blocks)
    for group in groups([b[0] for b in blocks], [len(b[1]) for b in blocks]):
        lens = np.array([blocks[k][0] for k in group])
        m = Model([len(blocks[k][1]) for k in group], True)
        syms = np.ascontiguousarray(_decode_group([blocks[k][2] for k in group], lens, m).T)
        for lane, k in enumerate(group):
            out[k] = blocks[k][1][syms[lane, : lens[lane]]]
    return out


def _decode_group(payloads: list[bytes], lens: np.ndarray, m: Model) -> np.ndarray:
    n = m.lanes
    sizes = np.array([len(p) // 4 for p in payloads])
    words = np.frombuffer(b"".join(payloads) + b"\0" * 8, "<u4").astype(np.int64)
    begin = np.append(0, np.cumsum(sizes))[:-1]
    rest = WORD_BITS - LOW_BITS
    code = (words[begin] << LOW_BITS) | (words[begin + 1] >> rest)
    words = ((words[:-1] & (1 << rest) - 1) << LOW_BITS) | (words[1:] >> rest)  # the bits that come in at a time
    pos = begin + 1
    rng = np.full(n, 1 << LOW_BITS + WORD_BITS, np.int64)
    syms = np.zeros((int(lens[0]), n), np.uint16)
    scaled, scale_at = 0, FIRST_SCALE
    for t in range(len(syms)):
        if lens[m.lanes - 1] <= t:
            m.narrow(int(np.searchsorted(-lens, -t, side="left")))
        if t == scale_at:
            m.scale(syms[scaled:t, : m.lanes])
            scaled, scale_at = t, 2 * t
        k = m.lanes
        m.predict()
        co, ra = code[:k], rng[:k]
        r = ra >> 2 * TOTAL_BITS
        sym = m.find((co // r).astype(np.int32))
        start, width = m.place(sym)
        m.learn(sym)
        co -= r * start
        np.multiply(r, width, out=ra)
        syms[t, :k] = sym
        i = np.flatnonzero(ra < _LEAST)
        if len(i):
            at = pos[i]
            co[i] = (co[i] << WORD_BITS) | words[at]
            ra[i] = ra[i] << WORD_BITS
            pos[i] = at + 1
    return syms
