"""The classifier's document statistics against plain Python."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from graphjobs.llm import quality  # noqa: E402

TEXTS = [None, "", " ", "One two  two. two!\n\nThree | four, 5 é\x01", "word " * 300, "a", "$$ {x} [y] # ~ <b> tab\there", "Ünï cödé\nléss"]


def by_hand(text):
    data = (text or "").encode()
    if not data:
        return [0.0] * len(quality.FEATURES)
    words = "".join(chr(b) for b in data).translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words if w]
    n, k, count = len(data), len(words), Counter(words)

    def share(chars):
        return sum(b in chars for b in data) / n

    lines = data.count(10) + 1
    distinct = len(count) / k if k else 0.0
    return [
        math.log1p(n), math.log1p(k), n / max(1, k), share(range(65, 91)), share(range(48, 58)), share(b".,;:'\"()-?"), share(b"#$%&*@^~<>{}[]\\/_=+`"),
        share(b"!"), share(b"|"), share(b" \t\n\r\v\f"), share([b for b in range(32) if b not in (9, 10, 11, 12, 13)]), share(range(128, 256)),
        math.log1p(lines), math.log1p(n / lines), distinct, max(count.values()) / k if k else 0.0,
        sum(a == b for a, b in zip(words, words[1:])) / (k - 1) if k > 1 else 0.0,
        -sum(c / n * math.log2(c / n) for c in Counter(data).values()), (data.count(44) + data.count(46)) / max(1, k), distinct * math.log1p(k),
    ]


def test_statistics():
    got = quality.statistics(pa.array(TEXTS))
    assert np.allclose(got, [by_hand(t) for t in TEXTS])
    assert np.allclose(quality.statistics(pa.array(["x", *TEXTS])[1:]), got)
