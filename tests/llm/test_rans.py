"""Exact round trips, random access and damage."""

import numpy as np
import pytest

from locusweave.llm import rans


def skewed(n, seed=0, most=5000):
    rng = np.random.default_rng(seed)
    return np.minimum(rng.zipf(1.3, n), most).astype(np.uint32) + 7


@pytest.mark.parametrize("n", [0, 1, 5, 511, 512, 513, 100_000])
@pytest.mark.parametrize("lanes", [1, 16, 512])
def test_round_trip(n, lanes):
    if lanes == 1 and n > 1000:
        n = 1000
    s = skewed(max(n, 1))
    table = rans.Table.of_counts(*np.unique(s, return_counts=True))
    block = rans.encode_block(s[:n], table, lanes, interval=8)
    assert np.array_equal(rans.decode_block(block, table), s[:n])


def test_close_to_entropy_and_random_access():
    s = skewed(300_000)
    symbols, counts = np.unique(s, return_counts=True)
    table = rans.Table.of_counts(symbols, counts)
    block = rans.encode_block(s, table)
    p = counts / counts.sum()
    assert 8 * len(block) < 1.06 * len(s) * -(p * np.log2(p)).sum()
    for a, b in ((0, 10), (131_000, 131_100), (262_143, 262_145), (299_999, 400_000), (5, 5)):
        assert np.array_equal(rans.decode_block(block, table, a, b), s[a:b])


def test_one_symbol_and_vocabulary_sized_tables():
    s = np.full(5000, 3, np.uint32)
    table = rans.Table.of_counts(np.array([3]), np.array([5000]))
    assert np.array_equal(rans.decode_block(rans.encode_block(s, table), table), s)
    all_ids = np.arange(50_257, dtype=np.uint32)
    table = rans.Table.of_counts(all_ids, np.r_[10**12, np.ones(50_256)])
    assert table.frequencies.sum() == 1 << rans.PROBABILITY_BITS and table.frequencies.min() >= 1
    assert np.array_equal(rans.decode_block(rans.encode_block(all_ids, table), table), all_ids)


def test_damage_is_noticed():
    s = skewed(1000)
    table = rans.Table.of_counts(*np.unique(s, return_counts=True))
    block = bytearray(rans.encode_block(s, table))
    block[-3] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.decode_block(bytes(block), table)
    with pytest.raises(ValueError, match="not in the table"):
        rans.encode_block(np.array([1], np.uint32), table)
