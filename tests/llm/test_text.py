import random

import numpy as np
import pyarrow as pa

from foliogrid.llm import _text as T
from tests.llm.conftest import LONG, alnum, spaced


def texts():
    rng = random.Random(3)
    chars = "abAB019 \n\t.-_é漢😀\x0b\x1c\x85"
    return ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(400)] + [None, "", LONG, "y" * 700_000, "z " * 5]


def test_words_equal_the_patterns():
    rows = texts()
    for kind, pattern in ((T.SPACED, spaced), (T.ALNUM_ANY, alnum)):
        seen = {}
        for step in (64, T.STEP):
            got = []
            for _, _, data, offsets in T.text_steps(pa.array(rows), step):
                w = T.split_words(data, offsets, kind)
                for a, b in zip(w.first[:-1], w.first[1:]):
                    own = [T.LOWER[np.frombuffer(w.word(i), np.uint8)].tobytes().decode() for i in range(a, b)]
                    got.append(own)
                    for x, h in zip(own, w.hashes[a:b]):
                        assert seen.setdefault(x, h) == h
            assert got == [pattern(t) for t in rows]
        assert len(set(seen.values())) == len(seen)


def test_grams_depend_on_words_in_order():
    h = np.arange(1, 9, dtype=np.uint64)
    g = T.grams(h, 3)
    assert len(set(g)) == 6 and T.grams(h[2:5], 3)[0] == g[2] and T.grams(h[:2], 3).size == 0
    assert T.grams(h[[1, 0, 2]], 3)[0] != g[0]


def test_sliced_and_wide_columns():
    a = pa.array(["aa b", None, "c", "d e f"])
    for col in (a.slice(1), a.cast(pa.large_string()).slice(1), pa.chunked_array([a.slice(1, 1), a.slice(2)])):
        (i, j, data, offsets), = T.text_steps(col)
        assert (i, j, list(T.split_words(data, offsets, T.SPACED).first)) == (0, 3, [0, 0, 1, 4])
