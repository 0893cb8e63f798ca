"""Spelling variants against brute force over all pairs, with small filters, and on odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import bloom, variants
from tessera.llm.hashing import mix

DOCS = "doc_id long, text string, word string"


def counted(rows, every=31):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    return {w: c for w, c in n.items() if c >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(n, times=10):
    out, form = {}, {}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
        out[w] = [n[w], len(near)]
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (*out[w], form[w], n[form[w]] if form[w] else None, root)
    return out


def got(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    """Families of misspelled words, of which one word makes a third of all."""
    rng = random.Random(3)
    letters = "abcdeéïßÿ÷"
    roots = ["".join(rng.choices(letters, k=rng.randint(7, 11))) for _ in range(25)]
    words = []
    for w in roots:
        words += [w] * rng.choice((1, 40, 600))
        for _ in range(30):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            words += [rng.choice((w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]))] * rng.choice((1, 2, 4, 45))
    words += ["Aaaaaaaa"] * (len(words) // 2) + ["aaaaaaa", "AAAAAAA"] * 3
    rng.shuffle(words)
    return [(i, "  ".join(words[a : a + 50]) + rng.choice(("", "!", " 12short×"))) for i, a in enumerate(range(0, len(words), 50))]


@pytest.mark.parametrize("every", [31, 3, 0])
def test_vocabulary_and_groups_against_brute_force(spark, rows, every):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS)
    words = variants.vocabulary(docs, every=every)
    n = counted(rows, every)
    assert {r.word: r.n for r in words.collect()} == n
    want = grouped(n)
    assert got(variants.variants(words)) == want
    assert sum(v[2] is not None for v in want.values()) > 50


def test_forms_are_followed_to_the_end(spark):
    n = {"aaaaaaaa": 5_000_000_000_000, "aaaaaaab": 400_000_000_000, "aaaaaabb": 30_000, "aaaaabbb": 3_000, "aaaabbbb": 7, "aaabbbb": 7, "zaaabbbb": 7, "aaaaaaac": 400_000_000_000}
    want = grouped(n)
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert got(variants.variants(words)) == want
    assert want["aaaabbbb"][4] == "aaaaaaaa" and want["aaabbbb"][2] is None


def test_passes_and_parts_change_nothing(spark, rows):
    words = variants.vocabulary(spark.createDataFrame([(*r, "") for r in rows], DOCS))
    sizes = Counter(len(r.word) for r in words.collect())
    parted, todo = variants.passes(sizes, 128)
    assert len(todo) > 3 and max(parted.values()) > 1 and all(sum(p.values()) * bloom.BLOCK_BYTES <= 128 for p in todo)
    assert got(variants.variants(words, filter_bytes=128)) == grouped({r.word: r.n for r in words.collect()})


def test_edits_of_a_long_word_come_in_pieces(monkeypatch, spark):
    monkeypatch.setattr(variants, "EDITS", 3)
    letters = np.array([[1, 2, 2, 5], [3, 3, 3, 3]], np.uint64)
    alphabet = np.arange(1, 7, dtype=np.uint64)
    made = [(size, int(r), int(i), int(c), int(h)) for size, *rest in variants.edits(letters, alphabet) for r, i, c, h in zip(*rest)]
    for size, r, i, c, h in made:
        w = letters[r].tolist()
        new = w[:i] + ([c] if c else []) + w[i + 1 :]
        assert len(new) == size and int(variants._hashes(np.array([new], np.uint64))[0]) == h
    assert sorted(m[:4] for m in made if not m[3]) == [(3, 0, 0, 0), (3, 0, 1, 0), (3, 0, 3, 0), (3, 1, 0, 0)]
    assert sum(m[3] > 0 for m in made) == (6 - 1) + 2 * (6 - 2) + (6 - 5) + 4 * (6 - 3)


def test_filter_has_what_was_put_in_and_little_else(spark):
    h = mix(np.arange(20_000, dtype=np.uint64))
    blocks = {0: 10_000 // bloom.PER_BLOCK, 3: 1}
    parts = spark.range(0, 10_010, 1, 7)
    held = bloom.built(parts, lambda part: (np.where(part.column(0).to_numpy() < 10_000, 0, 3), h[part.column(0).to_numpy()]), blocks)
    assert len(bloom.found(held[0], h[:10_000])) == 10_000 and len(bloom.found(held[0], h[10_000:])) < 30
    assert set(bloom.found(held[3], h[9_990:10_020])) >= set(range(10, 20)) and held[3].shape == (1, 8)
    assert bloom.partial(np.zeros(0, int), np.zeros(0, np.uint64), {}).num_rows == 0


def test_odd_rows(spark):
    long = "a" * 3000
    rows = [(1, None), (2, ""), (None, "nulliden nulliden nullidex nullidex"), (3, "twicerow twicerow"), (3, "twicerow twicerow"), (4, f"{long} {long} {long}b {long}b {'b' + long} {'b' + long}"), (5, "ABCÀÉÿxy abcÀÉÿxy ×÷×÷×÷×"), (6, "tie word " * 30_000)]
    docs = spark.createDataFrame([(*r, None) for r in rows], DOCS)
    n = counted(rows)
    assert got(variants.variants(variants.vocabulary(docs))) == grouped(n) and long in n and "twicerow" in n
    assert variants.variants(variants.vocabulary(docs.limit(0))).count() == 0
    alone = spark.createDataFrame([("lonelyword", 5)], "word string, n long")
    assert got(variants.variants(alone)) == {"lonelyword": (5, 0, None, None, "lonelyword")}


def test_one_partition_or_many(spark, rows):
    words = variants.vocabulary(spark.createDataFrame([(*r, "") for r in rows], DOCS))
    assert got(variants.variants(words.repartition(1))) == got(variants.variants(words.repartition(9)))
