"""Static range asymmetric numeral system (rANS) over integer symbols, in independent interleaved blocks.

A shared table gives every symbol a share of 2**PROBABILITY_BITS slots.  A block deals its symbols to lanes that
are coded side by side, each with a state of its own, into one stream of 32-bit words.  Checkpoints keep the
lane states and the place in the stream every few steps, so decoding can begin at any of them; checksums cover
the stream and the symbols.
"""

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

PROBABILITY_BITS = 20
LANES, INTERVAL = 2048, 256
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_HEAD = "<4sHHIQIIII"
MAGIC, VERSION = b"RNSB", 1


@dataclass
class Table:
    """Slots of each symbol: ``frequencies`` sum to 2**PROBABILITY_BITS, absent symbols have none."""

    symbols: np.ndarray
    frequencies: np.ndarray
    first: np.ndarray = field(init=False)

    def __post_init__(self):
        self.first = np.cumsum(self.frequencies) - self.frequencies
        self.place = np.zeros(int(self.symbols.max(initial=0)) + 1, np.int64)
        self.place[self.symbols] = np.arange(len(self.symbols))

    @classmethod
    def of_counts(cls, symbols: np.ndarray, counts: np.ndarray) -> "Table":
        """Shares in proportion to the counts, at least one slot each."""
        order = np.argsort(symbols)
        symbols, counts = np.asarray(symbols, np.int64)[order], np.asarray(counts, np.float64)[order]
        slots = 1 << PROBABILITY_BITS
        if len(symbols) > slots:
            raise ValueError("more symbols than slots")
        free = slots - len(symbols)
        exact = counts / counts.sum() * free
        shares = np.floor(exact).astype(np.int64)
        rest = free - int(shares.sum())
        shares[np.argsort(shares - exact, kind="stable")[:rest]] += 1
        return cls(symbols, shares + 1)

    def by_slot(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each slot its symbol, the symbol's frequency and the slot's place within the symbol."""
        if not hasattr(self, "_by_slot"):
            at = np.repeat(np.arange(len(self.symbols)), self.frequencies)
            within = np.arange(1 << PROBABILITY_BITS) - self.first[at]
            self._by_slot = self.symbols[at].astype(np.uint32), self.frequencies[at].astype(np.uint64), within.astype(np.uint64)
        return self._by_slot


def encode_block(symbols: np.ndarray, table: Table, lanes: int = LANES, interval: int = INTERVAL) -> bytes:
    """One self-contained block; all symbols must be in the table."""
    n = len(symbols)
    steps = -(-n // lanes)
    index = np.full(steps * lanes, int(np.argmax(table.frequencies)) if n else 0, np.int64)
    index[:n] = table.place[symbols]
    if n and not np.array_equal(table.symbols[index[:n]], symbols):
        raise ValueError("a symbol is not in the table")
    index = index.reshape(steps, lanes)
    f_all, c_all = table.frequencies.astype(np.uint64), table.first.astype(np.uint64)
    bits, full = np.uint64(PROBABILITY_BITS), np.uint64(63 - PROBABILITY_BITS)
    x = np.full(lanes, _LOW)
    words: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
    states = np.zeros((-(-steps // interval), lanes), np.uint64)
    for t in range(steps - 1, -1, -1):
        f = f_all[index[t]]
        over = x >= (f << full)
        words[t] = x[over].astype(np.uint32)  # keeps the low 32 bits
        x = np.where(over, x >> _WORD, x)
        q = x // f
        x = (q << bits) + (x - q * f) + c_all[index[t]]
        if t % interval == 0:
            states[t // interval] = x
    sizes = np.array([len(w) for w in words], np.int64)
    offsets = (np.cumsum(sizes) - sizes)[::interval].astype("<u4")
    body = offsets.tobytes() + states.astype("<u8").tobytes() + (np.concatenate(words) if steps else np.zeros(0)).astype("<u4").tobytes()
    head = struct.pack(_HEAD, MAGIC, VERSION, PROBABILITY_BITS, lanes, n, interval, len(states), zlib.crc32(symbols.astype("<u4").tobytes()), zlib.crc32(body))
    return head + body


def decode_block(block: bytes, table: Table, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Symbols ``begin`` to ``end`` of a block, decoded from the checkpoint before ``begin``.

    The stream's checksum is always verified, the symbols' when the whole block is decoded.
    """
    magic, version, bits, lanes, n, interval, points, crc, body_crc = struct.unpack_from(_HEAD, block)
    body = memoryview(block)[struct.calcsize(_HEAD):]
    if (magic, version, bits) != (MAGIC, VERSION, PROBABILITY_BITS) or zlib.crc32(body) != body_crc:
        raise ValueError("a block is damaged")
    end = n if end is None else min(end, n)
    if begin >= end:
        return np.zeros(0, np.uint32)
    offsets = np.frombuffer(body, "<u4", points)
    states = np.frombuffer(body, "<u8", points * lanes, 4 * points).reshape(points, lanes)
    stream = np.frombuffer(body, "<u4", offset=4 * points + 8 * points * lanes)
    symbol_of, frequency_of, within = table.by_slot()
    point = begin // (lanes * interval)
    first, last = point * interval, -(-end // lanes)
    x, at = states[point].astype(np.uint64), int(offsets[point])
    shift, mask = np.uint64(PROBABILITY_BITS), np.uint64((1 << PROBABILITY_BITS) - 1)
    out = np.empty((last - first, lanes), np.uint32)
    for t in range(last - first):
        slot = (x & mask).astype(np.int64)
        out[t] = symbol_of[slot]
        x = frequency_of[slot] * (x >> shift) + within[slot]
        need = np.flatnonzero(x < _LOW)
        if len(need):
            x[need] = (x[need] << _WORD) | stream[at:at + len(need)]
            at += len(need)
    got = out.ravel()[begin - first * lanes:end - first * lanes]
    if begin == 0 and end == n and zlib.crc32(got.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's symbols do not match their checksum")
    return got
