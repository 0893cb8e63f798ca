"""Collocations and their trie against brute force: small rooms, steps and bursts, odd rows and counts beyond 64 bits."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import collocations as C
from tessera.llm import hat_trie

DOCS = "doc_id long, text string, lang string, n long, phrase string"


def counted(rows, longest=4):
    """(lang, words) -> count, and lang -> words, from (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in range(1, longest + 1):
                f.update(("und" if lang is None else lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return f, n


def best(f, n, least=30, top=2000):
    """All rows of the result, by brute force."""
    found, kept = {k: a for k, a in f.items() if a >= least}, defaultdict(list)
    for (lang, w), a in found.items():
        if len(w) > 1:
            inside = any(len(x) > len(w) and g == lang and any(x[i : i + len(w)] == w for i in range(len(x))) and 100 * b >= 80 * a for (g, x), b in found.items())
            if not inside:
                score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
                kept[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in kept.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1)}


def result(spark, rows, top=2000, **more):
    docs = spark.createDataFrame([(i, *r, 7, "clash") for i, r in enumerate(rows)], DOCS).repartition(3)
    return {tuple(r) for r in C.collocations(*C.phrase_counts(docs, **more), top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["the", "The", "of", "é", "É", "a b", "x\x00y", "日本", "new", "york", "-", "2"]
    fixed = ["new york of the", "the of", "日本 É é", "2 - 2 - 2 - 2"]
    out = []
    for _ in range(400):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(4)]
        out.append(("".join(p + rng.choice([" ", "\t ", ". ", ",", "\n", "\r\n", ";", "\x0b", "?!", " "]) for p in parts), rng.choice(["en", "en", "en", "fr", None, ""])))
    return out + [("same passage in a third of all rows, new york", "en")] * 200


@pytest.mark.parametrize("more", [{}, {"room": 40, "step": 30, "burst": 2}, {"filter_bytes": 64, "room": 10}])
def test_against_brute_force(spark, rows, more):
    f, n = counted(rows)
    want = best(f, n, 6)
    assert len(want) > 60 and any(lang == "und" for lang, *_ in want)
    assert result(spark, rows, least=6, **more) == want


@pytest.mark.parametrize("top", [1, 7])
def test_the_best_of_each_language(spark, rows, top):
    assert result(spark, rows, top=top) == best(*counted(rows), top=top)


def test_words_known_by_a_task_are_bounded(spark, monkeypatch, rows):
    monkeypatch.setattr(C, "KNOWN", 4)
    monkeypatch.setattr(C, "LANGS", 1)
    want = counted(rows)[0]
    for order in (1, 2, 3, 4):
        got = Counter()
        for lang in ("en", "und"):
            monkeypatch.setattr(C.bloom, "found", lambda table, h: np.arange(len(h)))  # all pass
            c = C.PhraseCount(lang, order, None, None, 2) if order > 1 else C.WordCount(lang)
            for _ in c.read(C.GAP.join(t.encode() for t, g in rows if ("und" if g is None else g) == lang), 25):
                if c.full or c.size > 30:
                    for part in c.spilled(0 if c.full else 15):
                        got.update({(g, tuple(p.split(" "))): k for g, p, k in zip(*(x.to_pylist() for x in part.columns[:3]))})
            for part in c.spilled(0):
                for g, p, k, *prefix in zip(*(x.to_pylist() for x in part.columns)):
                    got[g, tuple(p.split(" "))] += k
                    assert prefix == ([" ".join(p.split(" ")[:2])] if order > 2 else [])
        assert got == Counter({k: a for k, a in want.items() if len(k[1]) == order and k[0] in ("en", "und") and "" not in k[1]})


@pytest.mark.parametrize("order", [1, 2, 4])
def test_many_languages_share_one_room(monkeypatch, order):
    rng = random.Random(6)
    rows = [(" ".join(rng.choices("abcdefgh", k=40)), f"l{rng.randrange(9)}") for _ in range(300)]
    monkeypatch.setattr(C, "KNOWN", 12)
    monkeypatch.setattr(C, "LANGS", 3)
    monkeypatch.setattr(C.bloom, "found", lambda table, h: np.arange(len(h)))  # all pass
    batches = [pa.RecordBatch.from_arrays([pa.array([g for _, g in part]), pa.array([t for t, _ in part])], ["lang", "text"]) for part in (rows[a : a + 50] for a in range(0, 300, 50))]
    got = Counter()
    for part in C._runs(order, None, None, 10**6, 100, 4)(iter(batches)):
        for g, p, k in zip(*(x.to_pylist() for x in part.columns[:3])):
            got[g, tuple(p.split(" "))] += k
    assert got == Counter({k: n for k, n in counted(rows)[0].items() if len(k[1]) == order})


@pytest.mark.parametrize("order", [2, 3, 4])
def test_trie_bursts_and_spills_sorted_subtrees(order):
    rng, want = np.random.default_rng(order), Counter()
    trie = hat_trie.HatTrie(order, 3)
    out = Counter()
    for _ in range(40):
        w = rng.zipf(1.6, (60, order)) % 9 + 1
        w[0] = hat_trie.WORD - rng.integers(0, 3, order)
        want.update(map(tuple, w.tolist()))
        rest = np.zeros(len(w), np.int64)
        for j in range(1, order):
            rest = rest << hat_trie.BITS | w[:, j]
        pairs = np.unique(np.stack([w[:, 0], rest]), axis=1, return_counts=True)
        trie.add(*pairs[0], pairs[1])
        assert trie.size == sum(trie.sizes.values())
        if trie.size > 50:
            largest = max(trie.sizes, key=lambda k: (trie.sizes[k], -k))
            first, rest, counts = trie.spill(25)
            assert first[0] == largest and trie.size <= 25
            for key in np.unique(first):
                assert (np.diff(rest[first == key]) > 0).all() and key not in trie.root
            for *p, k in zip(*trie.words(first, rest), counts):
                out[tuple(map(int, p))] += int(k)
    assert order == 2 or any(isinstance(n, hat_trie.Branch) for n in trie.root.values())
    first, rest, counts = trie.spill()
    for *p, k in zip(*trie.words(first, rest), counts):
        out[tuple(map(int, p))] += int(k)
    assert out == want and trie.size == 0 and not trie.root


def test_products_beyond_64_bits_are_exact(spark):
    big = 9_000_000_000_000_000_000
    rows = [("x", "a", 1, big), ("x", "b", 1, big - 1), ("x", "a b", 2, big - 3), ("x", "c", 1, big), ("x", "b c", 2, big // 3), ("x", "a b c", 3, big // 3 - 1)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, size int, a long")
    got = C.collocations(counts, spark.createDataFrame([("x", big)], "lang string, n long")).collect()
    f = {("x", tuple(p.split())): a for _, p, _, a in rows}
    assert {tuple(r) for r in got} == {(a, b, c, d, e, g, h, i) for a, b, c, d, e, g, h, i in best(f, {"x": big})}
    assert len(got) == 2


def test_odd_rows(spark):
    rows = [(None, "en"), ("", "en"), (" \t .,\n", None), ("a b " * 100_000, "en"), ("x" * 300_000 + " y", "fr"), ("lone\n" * 50, "de"), ("dup dup", "und")] + [("twice told", None)] * 30
    assert result(spark, rows, step=1000) == best(*counted(rows)) != set()
    assert result(spark, []) == set() and result(spark, [("no frequent word", "en")]) == set()
