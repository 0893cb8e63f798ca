"""Texts far longer than any batch: token counts over white space, pieces within bounded memory."""

import os
import random
import subprocess
import sys

import numpy as np
import pytest

from tessera.llm import pieces, token_counts

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def encoding():
    sys.path.insert(0, os.path.dirname(token_counts.VOCABULARY))
    from public_tokenizers import PATTERN

    with open(token_counts.VOCABULARY, "rb") as f:
        return token_counts._encoding(f.read(), PATTERN)


def test_long_white_space_is_cut_as_the_pattern_cuts_it(encoding):
    rng = random.Random(2)
    white = "   \t\n\r  　\x0b\x85 "
    for _ in range(3000):
        text = "".join(rng.choice((rng.choice(white) * rng.randint(1, 12), "".join(rng.choices(white, k=7)), "ab", "!", "7", "é", "\x1c", "don't")) for _ in range(rng.randint(0, 8)))
        for long in (1, 2, 5):
            assert token_counts.encoded_length(encoding, text, long) == len(encoding.encode_ordinary(text)), repr(text)


@pytest.mark.parametrize("run", [" ", "\t", "\n", "\r\n", "  "])
def test_a_million_white_space_characters_are_counted(encoding, run):
    n = 1_000_000 // len(run)
    short, long = (token_counts.encoded_length(encoding, f"ab{run * k}cd") for k in (60_000 // len(run), n))
    assert short == len(encoding.encode_ordinary(f"ab{run * (60_000 // len(run))}cd")) and short < long <= n * len(run) + 3
    assert token_counts.encoded_length(encoding, run * n) in range(1, n * len(run) + 1)


def test_a_text_of_white_space_does_not_end_the_query(spark):
    docs = spark.createDataFrame([(1, "ab" + " " * 1_200_000 + "cd"), (2, "ab cd"), (3, "\n" * 1_000_001)], "doc_id long, text string")
    assert token_counts.histogram(token_counts.encoded_lengths(docs)).agg({"docs": "sum"}).first()[0] == 3


@pytest.fixture(scope="module")
def lattice():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Lattice(f.read(), 1.0)


@pytest.mark.parametrize("chars", [1, 7, 100, 5000])
def test_blocks_change_no_piece(monkeypatch, lattice, chars):
    rng = random.Random(3)
    words = ["there", "is", " ", "   ", "▁", "▁▁a", "naïve", "日本語", "x" * 30, "\n", "€uro", "z" * 700]
    texts = ["".join(rng.choice(words) + rng.choice(("", " ", "  ")) for _ in range(rng.randint(0, 60))) for _ in range(25)] + ["", " ", "   a", "a   "]
    keys = np.arange(len(texts), dtype=np.uint64) * np.uint64(12345)
    monkeypatch.setattr(pieces, "CHARS", 10**9)
    want, ends = lattice.encode(texts, keys)
    monkeypatch.setattr(pieces, "CHARS", chars)
    monkeypatch.setattr(pieces, "TOGETHER", 11)
    got = lattice.encode(texts, keys)
    assert (got[0] == want).all() and (got[1] == ends).all()
    for t, a, b in zip(texts, np.append(0, ends), ends):
        assert lattice.spells(want[a:b], t) and lattice.decode(want[a:b]) == t
        assert not lattice.spells(want[a:b], t + "x") and (not t or not lattice.spells(want[a:b], "x" + t[1:]) or t[0] == "x")


def test_memory_does_not_follow_the_lattice_of_the_text():
    code = """
import random, resource
import numpy as np
from tessera.llm import pieces
lattice = pieces.Lattice(open(pieces.MODEL, "rb").read(), 1.0)
rng = random.Random(1)
text = " ".join("".join(rng.choices("etaoinshrdlu", k=20)) for _ in range(500_000))
lattice.encode([text[:3_000_000]], np.zeros(1, np.uint64))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
ids, _ = lattice.encode([text], np.zeros(1, np.uint64))
assert lattice.spells(ids, text)
print(len(text), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    chars, more = map(int, out.stdout.split())
    assert chars > 10_000_000 and more < 120, out.stdout
