"""External induced sorting against plain sorting, and its memory."""

import random
import subprocess
import sys

import numpy as np

from rillstore.llm import induced


def joined(texts):
    return np.concatenate([np.r_[np.frombuffer(x, np.uint8).astype(np.uint16) + 1, 0] for x in texts]).astype(np.uint16)


def test_order_and_common_prefixes(tmp_path):
    rnd, levels = random.Random(9), 0
    for _ in range(250):
        width = rnd.choice([2, 3, 6, 20])
        letters = rnd.choice([b"a", b"ab", b"abc", bytes(range(256)), b"\0\xff"])
        src = bytes(rnd.choices(letters, k=200))
        texts = [src[(a := rnd.randrange(199)) : a + rnd.randint(1, 90)] if rnd.random() < 0.6 else bytes(rnd.choices(letters, k=rnd.randint(1, 45))) for _ in range(rnd.randint(1, 14))]
        t, depth, bound = joined(texts), [], rnd.choice([16, 64, 100, 1 << 18])
        ends = np.flatnonzero(t == 0)
        end = {p: int(ends[np.searchsorted(ends, p)]) for p in range(len(t))}
        want = sorted((p for p in range(len(t)) if t[p]), key=lambda p: (t[p : end[p]].tolist() + [0], end[p]), reverse=True)
        got = [(p, q) for b in induced.falling_suffixes(t, str(tmp_path), width, bound, depth) for p, q in zip(*(x.tolist() for x in b), strict=True)]
        assert [p for p, _ in got] == want
        for (a, _), (b, q) in zip(got, got[1:], strict=False):
            x, y = t[a : end[a]][:width], t[b : end[b]][:width]
            n = min(len(x), len(y))
            assert q == int(np.argmin(np.r_[x[:n] == y[:n], False]))
        levels = max(levels, len(depth))
        seen, starts, at = set(), [], 0
        for x in texts:
            for i in range(len(x) - width + 1):
                starts += [at + i] * (x[i : i + width] in seen)
                seen.add(x[i : i + width])
            at += len(x) + 1
        assert np.flatnonzero(induced.repeats(t, str(tmp_path), width, bound)).tolist() == starts
    assert levels >= 3  # names of names of names


BEYOND = """
import random, resource, sys, tempfile
import numpy as np
from rillstore.llm import induced
rnd, width, bound = random.Random(3), 100, 1 << 14
with tempfile.TemporaryDirectory() as folder:
    src = rnd.randbytes(40_000).translate(bytes(97 + i % 16 for i in range(256)))
    n, first, want = 0, set(), []
    with open(folder + "/t", "wb") as f:
        for _ in range(1200):
            a = rnd.randrange(39_000)
            x = bytearray(src[a : a + 900])
            x[rnd.randrange(900)] = 122
            for i in range(len(x) - width + 1):
                h = hash(bytes(x[i : i + width]))
                want += [n + i] * (h in first)
                first.add(h)
            f.write(np.r_[np.frombuffer(bytes(x), np.uint8).astype(np.uint16) + 1, 0].astype(np.uint16).tobytes())
            n += len(x) + 1
    del first
    want = np.array(want)
    t = np.memmap(folder + "/t", np.uint16, "r")
    assert n > 50 * bound
    used = int(next(l for l in open("/proc/self/status") if l.startswith("VmData")).split()[1]) * 1024
    resource.setrlimit(resource.RLIMIT_DATA, (used + (24 << 20), used + (24 << 20)))
    assert (np.flatnonzero(induced.repeats(t, folder, width, bound)) == want).all()
"""


def test_a_text_far_beyond_its_memory():
    """A text of 1.08 million symbols, 65 times the bound of tuples, under 24 MB of further memory; one array of its positions takes 8.6 MB, and sorting in memory some 60 bytes a symbol."""
    subprocess.run([sys.executable, "-c", BEYOND], check=True, timeout=300)
