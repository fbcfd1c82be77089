"""An adaptive context-mixing range coder for blocks of token ids.

Every block starts from an empty model and names its ids by their order of first appearance. For each id the
model has an order-2 prediction (by a hash of the two ids before), an order-1 prediction (what last followed the
id before) and order-0 counts: the ids seen so far stand in one row by classes of their counts, the most
frequent class first. One 7-way symbol says that the order-2 or the order-1 prediction holds, that the id is
new, or of which class it is; its probabilities mix the adaptive counts of two contexts: how often order 1 has
held in a row, and how often orders 1 and 2 have. Inside a class, ids of about equal counts are equally likely.
New ids follow in a second stream: an adaptive symbol for their magnitude, then the rest.

Symbols drive a range coder with a 48-bit window and 16-bit words. Window and range are integers held in
doubles, exactly. Many blocks are coded in step, one numpy lane a block: lane operations replace a loop over ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 2048
#: Blocks coded in step.
LANES = 4096
#: The most ids a block may have, as counts of two contexts must sum below 2 ** 15.
MAX_BLOCK = 4000
#: Symbols: classes of counts above 24, above 7, above 2 and up to 2, a new id, the order-1 id and the order-2 id.
_NEW, _ORDER_1, _ORDER_2 = 4, 5, 6
_SYMBOL = np.array([_NEW] + [3 - (c > 2) - (c > 7) - (c > 24) for c in range(1, MAX_BLOCK + 2)], np.int64)
#: Whether one more occurrence takes an id with this count to the next class.
_RISES = np.append(_SYMBOL[1:] != _SYMBOL[:-1], False)
_RISES[0] = False
#: A context has eight 16-bit fields that move as one 128-bit item: sums of the counts of all symbols before symbol 0, 1, ..., and of all seven.
_ITEM = np.complex128
_FRESH = np.arange(8, dtype=np.uint16).view(_ITEM)
#: What a symbol adds to its context.
_STEP = 4
_STEPS = np.array([[_STEP * (k > s) for k in range(8)] for s in range(8)], np.uint16).view(_ITEM).ravel()
_ONES, _HIGH = np.uint64(0x0001000100010001), np.uint64(0x8000800080008000)
_15, _48 = np.uint64(15), np.uint64(48)
#: Slots of order 2, an id and in the low two bits how often it held in a row, up to 3; 0 times for none.
_SLOT_BITS, _NONE = 8, 0xFFFC
_1, _2, _3, _4 = map(np.uint16, (1, 2, 3, 4))
_UNMET = np.array([0, 0, 0xFFFF, 0], np.uint16)
_HASH_1, _HASH_2 = np.uint16(40503), np.uint16(30011)
_SLOT_SHIFT = np.uint16(16 - _SLOT_BITS)
_LEAST, _TOP = 2.0**32, 2.0**48 - 1
_FACTOR = np.array([1.0, 65536.0])
#: After the magic number: version, bits of an id, ids, ids coded (with padding), different ids, a checksum, words of the symbols and of the new ids.
_HEADER = struct.Struct("<4sBBHHHIII")
MAGIC, VERSION = b"CMRC", 2


class CorruptBlock(ValueError):
    pass


def _checksum(ids: np.ndarray, fields: tuple, payload: bytes) -> int:
    """CRC-32 of the ids as 32-bit little-endian, then the header without checksum, then what follows it."""
    return zlib.crc32(payload, zlib.crc32(_HEADER.pack(MAGIC, VERSION, *fields[:4], 0, *fields[4:]), zlib.crc32(ids.tobytes())))


class _Counts:
    """Adaptive counts of 7 symbols, mixed from contexts: ``sizes`` says how many of each kind a lane has."""

    def __init__(self, n: int, sizes: tuple[int, ...]) -> None:
        self.n, self.fields = n, np.arange(n, dtype=np.int64) * 8
        self.tables = [np.repeat(_FRESH, n * k) for k in sizes]
        self.at = [np.arange(n, dtype=np.int64) * k for k in sizes]

    def mix(self, *contexts: np.ndarray) -> None:
        self.places = [at[: self.n] + c for at, c in zip(self.at, contexts, strict=True)]
        self.got = [table.take(place).view(np.uint64) for table, place in zip(self.tables, self.places, strict=True)]
        self.sums = self.got[0] + self.got[1] if len(self.got) > 1 else self.got[0]
        self.total = self.sums.view(np.uint16)[7::8]

    def share(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts before the symbols, and theirs."""
        fields, at = self.sums.view(np.uint16), self.fields[: self.n] + symbol
        before = fields.take(at)
        at += 1
        return before, fields.take(at) - before

    def find(self, part: np.ndarray) -> np.ndarray:
        """The symbols whose counts hold ``part``: one less than fields that are not above it, compared side by side."""
        each = part.view(np.uint64) * _ONES | _HIGH
        over = (each - self.sums[::2] & _HIGH) >> _15
        over += (each - self.sums[1::2] & _HIGH) >> _15
        return (over * _ONES >> _48).view(np.int64) - 1

    def add(self, symbol: np.ndarray) -> None:
        step = _STEPS.take(symbol).view(np.uint64)
        for table, place, got in zip(self.tables, self.places, self.got, strict=True):
            table[place] = (got + step).view(_ITEM)


class _Model:
    """The predictions of ``n`` blocks of ``different`` ids at most."""

    def __init__(self, n: int, different: int) -> None:
        room = (different + 3) // 32 * 32 + 40  # lanes a power of two apart would share few places of a cache
        self.at = np.arange(n, dtype=np.int64) * room
        # four 16-bit fields of each id: its place in the row, its count, what followed it last, how often in a row
        info = np.empty((room, 4), np.uint16)
        info[:] = _UNMET
        info[:, 0] = np.arange(room)
        self.info = np.tile(info.view(np.uint64).reshape(-1), n)
        self.row = np.tile(np.arange(room, dtype=np.uint16), n)
        # where the classes begin in the row, by symbol; the place of a new id, which ends the last class; and three more
        self.starts = np.tile(np.array([0, 0, 0, 0, 0, 1, 2, 3], np.uint16), n)
        self.ends = self.starts.view(np.uint64)[1::2]
        self.at_start = np.arange(n, dtype=np.int64) * 8
        self.two = np.full(n << _SLOT_BITS, _NONE, np.uint16)
        self.at_two = np.arange(n, dtype=np.int64) << _SLOT_BITS
        self.counts = _Counts(n, (8, 32))
        self.last = np.tile(_UNMET, (n, 1))  # what is known of the id before
        self.at_last = None
        self.before = self.before_2 = np.zeros(n, np.uint16)

    def predict(self) -> None:
        self.id1, self.c1 = self.last[:, 2].copy(), self.last[:, 3].copy()
        self.slot = self.at_two + ((self.before * _HASH_1 + self.before_2 * _HASH_2) >> _SLOT_SHIFT)
        e = self.two.take(self.slot)
        self.id2, self.c2 = e >> _2, e & _3
        order_1 = self.c1 + (self.id1 == self.id2) * _4
        self.counts.mix(order_1, order_1 * _4 + self.c2)

    def learn_order(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Takes down that ``x`` follows the ids before; returns what is known of it, with the fields of ``info``."""
        self.hit1, self.hit2 = self.id1 == x, self.id2 == x
        if self.at_last is not None:
            self.last[:, 2] = x
            self.last[:, 3] = np.minimum(self.c1, _2) * self.hit1 + _1
            self.info[self.at_last] = self.last.view(np.uint64).reshape(-1)
        self.two[self.slot] = x * _4 + np.minimum(self.c2, _2) * self.hit2 + _1
        self.at_last = self.at + place
        return self.info.take(self.at_last).view(np.uint16).reshape(-1, 4)

    def part_of(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a symbol's ids begin in the row and how many it has; a new id is the next one there, and the rest have one."""
        at = self.at_start + symbol
        start = self.starts.take(at)
        at += 1
        return start, self.starts.take(at) - start

    def update(self, x: np.ndarray, known: np.ndarray, symbol: np.ndarray) -> None:
        self.counts.add(symbol)
        count = known[:, 1]
        self.ends += (count == 0) * _ONES
        rising = np.flatnonzero(_RISES.take(count))
        if len(rising):  # the id changes places with the first of its class, which then belongs to the next
            at = self.at_start.take(rising) + _SYMBOL.take(count.take(rising))
            first, place, base = self.starts.take(at), known[:, 0].take(rising), self.at.take(rising)
            self.starts[at] = first + _1
            other = self.row.take(base + first)
            self.row[base + place] = other
            self.row[base + first] = x.take(rising)
            self.info.view(np.uint16)[(base + other) * 4] = place
            known[rising, 0] = first
        known[:, 1] += _1
        self.last = known
        self.before_2, self.before = self.before, x


class _Writer:
    """Window and range of ``n`` lanes, and the words that have left the window."""

    def __init__(self, n: int, words: int) -> None:
        self.low, self.size = np.zeros(n), np.full(n, _TOP)
        self.words = np.empty((words + 4) * n, np.int32)  # lanes side by side, as they go on at about the same pace
        self.n, self.at = n, np.arange(n, dtype=np.int64)

    def narrow(self, before: np.ndarray, own: np.ndarray, total: np.ndarray, m: int) -> None:
        r = np.floor(self.size[:m] / total)
        self.low[:m] += r * before
        self.size[:m] = r * own

    def pick(self, part: np.ndarray, of: np.ndarray, m: int) -> None:
        r = np.floor(self.size[:m] / of)
        self.low[:m] += r * part
        self.size[:m] = r

    def shift(self, m: int) -> None:
        """Words leave windows whose range has become short; a word may hold a carry in its 17th bit."""
        low, size, at = self.low[:m], self.size[:m], self.at[:m]
        short = size < _LEAST
        more = _FACTOR.take(short.view(np.uint8))
        size *= more
        word = (low * 2.0**-32).astype(np.int32)
        self.words[at] = word
        at += short * self.n
        word *= short
        low -= word * _LEAST
        low *= more
        rest = np.flatnonzero(size < _LEAST)
        if len(rest):
            word = (low[rest] * 2.0**-32).astype(np.int32)
            self.words[at[rest]] = word
            at[rest] += self.n
            low[rest] = (low[rest] - word * _LEAST) * 65536.0
            size[rest] *= 65536.0

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """All lanes' words one after the other, and how many each has."""
        for _ in range(3):
            word = (self.low * 2.0**-32).astype(np.int32)
            self.words[self.at] = word
            self.at += self.n
            self.low = (self.low - word * _LEAST) * 65536.0
        counts = self.at // self.n
        rows = np.ascontiguousarray(self.words[: int(counts.max()) * self.n].reshape(-1, self.n).T)
        return _carried(np.concatenate([row[:k] for row, k in zip(rows, counts.tolist(), strict=True)]), counts), counts


class _Source:
    def __init__(self, words: np.ndarray, starts: np.ndarray) -> None:
        self.words = np.concatenate([words.astype(np.float64), np.zeros(8)])
        at = starts.astype(np.int64)
        self.value = (self.words.take(at) * 65536.0 + self.words.take(at + 1)) * 65536.0 + self.words.take(at + 2)
        self.size, self.at = np.full(len(at), _TOP), at + 3

    def ask(self, total: np.ndarray, m: int) -> np.ndarray:
        self.r = np.floor(self.size[:m] / total)
        return np.minimum(np.floor(self.value[:m] / self.r), total - 1.0)

    def narrow(self, before: np.ndarray, own: np.ndarray, m: int) -> None:
        self.value[:m] -= self.r * before
        self.size[:m] = self.r * own

    def shift(self, m: int) -> None:
        value, size, at = self.value[:m], self.size[:m], self.at[:m]
        short = size < _LEAST
        more = _FACTOR.take(short.view(np.uint8))
        value *= more
        value += self.words.take(at, mode="clip") * short
        at += short
        size *= more
        rest = np.flatnonzero(size < _LEAST)
        if len(rest):
            value[rest] = value[rest] * 65536.0 + self.words.take(at[rest], mode="clip")
            at[rest] += 1
            size[rest] *= 65536.0


def _carried(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """16-bit words from sums that may hold a carry in their 17th bit; a carry may run on through words of ones."""
    over = np.flatnonzero(words >> 16)
    words &= 0xFFFF
    while len(over):  # no carry leaves a block, as its window starts at 0
        words[over - 1] += 1
        over = over[words[over - 1] >> 16 != 0] - 1
        words[over] &= 0xFFFF
    return words.astype("<u2")


def _named(ids: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(blocks, steps) -> (steps, blocks) of numbers of first appearance, and each block's different ids in that order."""
    n, steps = ids.shape
    names, new = np.empty((steps, n), np.uint16), []
    wide = bits > 20
    table = np.empty(0 if wide else 1 << bits, np.int32)
    back = np.arange(steps - 1, -1, -1, dtype=np.int32)
    for k in range(n):
        x = ids[k]
        if wide:
            _, first, inverse = np.unique(x, return_index=True, return_inverse=True)
            at = first[inverse]
        else:
            table[x[::-1]] = back
            at = table.take(x)
        is_new = at == back[::-1]
        names[:, k] = (np.cumsum(is_new) - 1).take(at)
        new.append(x[is_new])
    return names, new


def _encode(ids: np.ndarray, bits: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], list[int]]:
    """ids (blocks, steps) -> words of all blocks' symbols and how many each has, the same for new ids, and how many different ids."""
    n, steps = ids.shape
    by_step, new = _named(ids, bits)
    model, out = _Model(n, max(map(len, new))), _Writer(n, 2 * steps)
    order_1, order_2 = np.full(n, _ORDER_1), np.full(n, _ORDER_2)
    for t in range(steps):
        x = by_step[t]
        model.predict()
        known = model.learn_order(x, x)
        symbol = np.where(model.hit2, order_2, np.where(model.hit1, order_1, _SYMBOL.take(known[:, 1])))
        out.narrow(*model.counts.share(symbol), model.counts.total, n)
        start, size = model.part_of(symbol)
        out.pick((known[:, 0] - start) * (symbol <= _NEW), size, n)
        out.shift(n)
        model.update(x, known, symbol)
    del model, by_step
    return out.close(), _encode_new(new, bits), [len(x) for x in new]


def _magnitudes(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The least id and the number of ids of each magnitude: six by the highest bit, and one for all that are less."""
    least = np.array([0] + [1 << k for k in range(bits - 6, bits + 1)], np.int64)
    return least[:7], np.diff(least)


def _encode_new(new: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in new])
    order = np.argsort(-sizes, kind="stable")
    table = np.zeros((sizes.max(), len(new)), np.int32)
    for k, i in enumerate(order):
        table[: sizes[i], k] = new[i]
    least, many = _magnitudes(bits)
    counts, out, zero = _Counts(len(new), (1,)), _Writer(len(new), 4 * len(table)), np.zeros(len(new), np.int64)
    falling = sizes[order]
    for t in range(len(table)):
        m = int(np.searchsorted(-falling, -t))
        x = table[t, :m].astype(np.int64)
        kind = np.maximum(np.frexp(x)[1] - (bits - 6), 0).astype(np.int64)
        counts.n = m
        counts.mix(zero[:m])
        out.narrow(*counts.share(kind), counts.total, m)
        out.shift(m)
        rest = x - least.take(kind)
        if bits > 16:
            out.pick(rest >> 16, (many.take(kind) + 65535) >> 16, m)
            out.shift(m)
            out.pick(rest & 65535, np.minimum(many.take(kind), 65536), m)
        else:
            out.pick(rest, many.take(kind), m)
        out.shift(m)
        counts.add(kind)
    words, lengths = out.close()
    ends = np.cumsum(lengths)
    back = np.argsort(order)
    return np.concatenate([words[ends[k] - lengths[k] : ends[k]] for k in back]), lengths[back]


def _decode(words: np.ndarray, starts: np.ndarray, new_words: np.ndarray, new_starts: np.ndarray, steps: int, bits: int, different: np.ndarray) -> np.ndarray:
    """The inverse: ids (blocks, steps) of the blocks whose words begin at ``starts``."""
    n = len(starts)
    model, source = _Model(n, int(different.max())), _Source(words, starts)
    names = np.empty((steps, n), np.uint16)
    most, last = np.uint16(different.max() - 1), len(model.row) // n - 1
    for t in range(steps):
        model.predict()
        symbol = model.counts.find(source.ask(model.counts.total, n).astype(np.int64))
        source.narrow(*model.counts.share(symbol), n)
        start, size = model.part_of(symbol)
        part = source.ask(np.maximum(size, 1), n)
        source.narrow(part, 1.0, n)
        source.shift(n)
        x = model.row.take(model.at + np.minimum(part.astype(np.int64) + start, last))
        x = np.where(symbol == _ORDER_2, model.id2, np.where(symbol == _ORDER_1, model.id1, x))
        x = np.minimum(x, most)  # of a corrupt block
        names[t] = x
        model.update(x, model.learn_order(x, x), symbol)
    new = _decode_new(new_words, new_starts, different, bits)
    return np.take_along_axis(new, np.minimum(names.T, new.shape[1] - 1), axis=1)


def _decode_new(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order]
    least, many = _magnitudes(bits)
    counts, source, zero = _Counts(len(sizes), (1,)), _Source(words, starts[order]), np.zeros(len(sizes), np.int64)
    out = np.zeros((len(sizes), int(sizes.max())), np.uint32)
    for t in range(out.shape[1]):
        m = int(np.searchsorted(-falling, -t))
        counts.n = m
        counts.mix(zero[:m])
        kind = counts.find(source.ask(counts.total, m).astype(np.int64))
        source.narrow(*counts.share(kind), m)
        source.shift(m)
        rest = np.zeros(m)
        for sizes_of in ([(many.take(kind) + 65535) >> 16, np.minimum(many.take(kind), 65536)] if bits > 16 else [many.take(kind)]):
            part = source.ask(sizes_of, m)
            source.narrow(part, 1.0, m)
            source.shift(m)
            rest = rest * 65536.0 + part
        out[:m, t] = least.take(kind) + rest.astype(np.int64)
        counts.add(kind)
    return out[np.argsort(order)]


def encode_blocks(ids: np.ndarray, block_ids: int = BLOCK_IDS, lanes: int = LANES) -> list[bytes]:
    """Cuts ids into blocks of ``block_ids`` and codes each on its own, with a header and checksum."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if not len(ids):
        return []
    if int(ids.max()) >= 1 << 29 or block_ids > MAX_BLOCK:
        raise ValueError(f"ids must be below 2 ** 29, and blocks have {MAX_BLOCK} of them at most")
    bits = max(8, int(ids.max()).bit_length())
    steps = min(block_ids, len(ids))
    blocks = -(-len(ids) // steps)
    out = []
    for first in range(0, blocks, lanes):
        part = ids[first * steps : (first + lanes) * steps]
        if len(part) % steps:
            part = np.append(part, np.full(steps - len(part) % steps, ids[-1], np.uint32))
        (words, counts), (new, new_counts), different = _encode(part.reshape(-1, steps), bits)
        for k, (end, n, new_end, m, d) in enumerate(zip(np.cumsum(counts), counts, np.cumsum(new_counts), new_counts, different, strict=True)):
            own = ids[(first + k) * steps : (first + k + 1) * steps]
            fields, payload = (bits, len(own), steps, d, int(n), int(m)), words[end - n : end].tobytes() + new[new_end - m : new_end].tobytes()
            out.append(_HEADER.pack(MAGIC, VERSION, *fields[:4], _checksum(own, fields, payload), *fields[4:]) + payload)
    return out


def decode_blocks(blocks: list[bytes], lanes: int = LANES) -> list[np.ndarray]:
    """The ids of each block; raises CorruptBlock where one is cut short or fails its checksum."""
    parsed = []
    for k, b in enumerate(blocks):
        if len(b) < _HEADER.size:
            raise CorruptBlock(f"block {k} is cut short")
        magic, version, bits, n, steps, different, crc, words, new = _HEADER.unpack_from(b)
        if magic != MAGIC or version != VERSION or n > steps or not 0 < different <= steps <= MAX_BLOCK or not 8 <= bits <= 29 or words < 3 or len(b) != _HEADER.size + 2 * (words + new):
            raise CorruptBlock(f"block {k} has a wrong header or length")
        parsed.append((steps, bits, n, different, crc, np.frombuffer(b, "<u2", words, _HEADER.size), np.frombuffer(b, "<u2", new, _HEADER.size + 2 * words)))
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    kinds: dict[tuple[int, int], list[int]] = {}
    for k, p in enumerate(parsed):
        kinds.setdefault(p[:2], []).append(k)
    for (steps, bits), members in kinds.items():
        for first in range(0, len(members), lanes):
            group = members[first : first + lanes]
            both = []
            for part in (5, 6):
                sizes = np.array([len(parsed[k][part]) for k in group])
                both += [np.concatenate([parsed[k][part] for k in group]), np.cumsum(sizes) - sizes]
            ids = _decode(*both, steps, bits, np.array([parsed[k][3] for k in group]))
            for k, row in zip(group, ids, strict=True):
                own = np.ascontiguousarray(row[: parsed[k][2]], dtype="<u4")
                steps_k, bits_k, n, different, crc, first_words, new_words = parsed[k]
                if _checksum(own, (bits_k, n, steps_k, different, len(first_words), len(new_words)), blocks[k][_HEADER.size :]) != crc:
                    raise CorruptBlock(f"block {k} fails its checksum")
                out[k] = own
    return out
