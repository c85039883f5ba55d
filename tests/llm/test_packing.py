import os
import platform
import subprocess
import sys

import numpy as np
import pytest

from tessella.llm import packing as P
from tessella.llm import textscan as S


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 1000])
@pytest.mark.parametrize("most", [1, 2, 3, 4, 15, 16, 255, 256, 65536, (1 << 32) - 1])
def test_counts_come_back(n, most):
    rng = np.random.default_rng(n + most)
    values = rng.integers(0, most, n, endpoint=True)
    assert P.unpack_counts(P.pack_counts(values)).tolist() == values.tolist()
    values[: n // 2] = 1
    assert P.unpack_counts(P.pack_counts(values)).tolist() == values.tolist()
    assert P.unpack_ascending(P.pack_ascending(np.sort(values))).tolist() == sorted(values.tolist())


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000])
@pytest.mark.parametrize("bits", [1, 7, 8, 13, 40, 48, 63])
def test_sorted_values_come_back(n, bits):
    values = np.sort(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) >> np.uint64(63 - bits))
    packed = P.pack_sorted(values, bits)
    assert (P.unpack_sorted(packed) == values).all() and len(packed) < 12 + n * (bits + 16) / 8


@pytest.mark.parametrize("bits", [3, 20, 54, 64])
def test_the_order_sorts(bits):
    keys = np.random.default_rng(bits).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2) >> np.uint64(64 - bits)
    order = P.sorting_order(keys, bits)
    assert sorted(order.tolist()) == list(range(5000)) and (keys[order] == np.sort(keys)).all()
    near = np.repeat(np.arange(5, dtype=np.uint64), 3)[::-1]  # told apart by the bits that the places take
    assert (near[P.sorting_order(near)] == np.sort(near)).all()


def test_word_hashes_do_not_hang_on_the_parts_they_are_worked_out_in(monkeypatch):
    raw = np.frombuffer(b" ".join([b"abc", b"x" * 5000, b"de", b"abc", b"y" * 40, b"de"] * 30), np.uint8)
    with np.errstate(over="ignore"):
        found = S.scan(raw, np.array([0, 11, 11, len(raw)]))
        want = found.word_hashes()
        for size in (1, 7, 64, 5000):
            monkeypatch.setattr(S, "HASH_BYTES", size)
            assert (found.word_hashes() == want).all()
    assert len(set(want.tolist())) <= 6


_HEAP = """
import re
from tessella.llm import packing as P

def held():
    return sum(map(int, re.findall("Pss_Anon: *([0-9]+)", open("/proc/self/smaps_rollup").read()))) >> 10

before = held()
made = [bytes(2000) for _ in range(100_000)]
kept = made[::100]  # the heap cannot shrink from its end
del made
assert list(P.column_batches(iter([]))) == []
print(held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup") or platform.libc_ver()[0] != "glibc", reason="needs glibc's heap and its figures")
def test_freed_memory_is_given_back():
    """Of 200 MB, 2 are in use; without giving back the process keeps them all."""
    assert int(subprocess.run([sys.executable, "-c", _HEAP], capture_output=True, text=True, check=True).stdout) < 50
