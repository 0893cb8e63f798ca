"""Collocations: phrases whose words stand together more often than their parts would.

Phrases are counted order by order, single words first. For each order every task walks its texts once and counts into
burst tries (hat_trie.py), one for each language: words get ids of the task's own, positions become phrases of ids, and
containers count them. A task that holds ROOM entries spills its largest subtrees as sorted runs, rows of language,
phrase, count and prefix, with words spelled out; what it holds at its end follows. Runs are shuffled by language and prefix,
the first two words, and summed there. So a frequent phrase leaves a task as one row, memory is bounded, and no
dictionary of all words is needed anywhere.

A phrase is counted only where both of its parts that are one word shorter are frequent, which a phrase that is itself
frequent can't fail. Which parts are frequent is asked of a blocked Bloom filter of at most FILTER bytes: it lets all
frequent ones through and some others, which the sums then drop. A filter that fills up prunes less and loses nothing.
A long text goes through in parts of STEP bytes, cut between words; the last words of a part are carried over.

Scores are exact: products are decimals of 38 digits. The best phrases of a language are ranked in two rounds, first by
parts of the language, so no task sorts one whole.

Nulls and edges: a null text is empty and gives nothing; a null language is ``und``; repeated rows count again; ties go
by count, then by bytes of the phrase; a long text takes some 12 bytes of memory for each of its own and no more beside
its batch; columns beside text and language play no part; an empty table gives an empty table; a language in which no
phrase is frequent gives no row.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .common import drop_staged, staged
from .hashing import U, mix, powers
from .hat_trie import BITS, BURST, HatTrie

#: Entries of a task's tries; bytes of a filter; bytes of text taken at once; distinct words
#: that a task knows when it takes up a language, or comes to know in one; languages.
ROOM, FILTER, STEP, KNOWN, LANGS = 1_500_000, 64 << 20, 4 << 20, 1 << 20, 64
#: Rows put out at once.
ROWS = 1 << 17
#: Parts of a language for the first round of ranking.
PARTS = 64
#: A byte that no text has: between pieces. What ends a piece.
GAP = b"\xff"
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
TABLE = bytes.maketrans(ENDS + b"\t", GAP * len(ENDS) + b" ")
UNKNOWN = "und"
RUNS = "lang string, phrase string, n bigint"
P = U(0x9E3779B97F4A7C55)


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    return np.fromiter((zlib.crc32(w, seed) for w in words), U, len(words))


def _joined(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of phrases, from those of their words."""
    out = np.zeros(len(hashes[0]), U)
    with np.errstate(over="ignore"):
        for h in hashes:
            out = (out + h) * P
    return mix(out)


class Words(dict):
    """Ids of frequent words from 1 on, given as they come; 0: between pieces, or not frequent."""

    def __init__(self, lang: str, table: np.ndarray):
        self.lang, self.table = lang, table
        self.renew()

    def renew(self) -> None:
        self.clear()
        self[GAP] = 0
        self.names, self.hashes = [b""], [np.zeros(1, U)]

    def learn(self, words: list[bytes]) -> None:
        h = word_hashes(self.lang, words)
        known = bloom.found(self.table, h)
        self.update(dict.fromkeys(words, 0))
        self.update((words[i], len(self.names) + n) for n, i in enumerate(known.tolist()))
        self.names += [words[i] for i in known.tolist()]
        self.hashes = [np.concatenate((*self.hashes, h[known]))]

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        self.learn([w for w in set(tokens) if w not in self])
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def _parts(text: bytes, step: int) -> Iterator[list[bytes]]:
    """Words and gaps of ``text``, about ``step`` bytes at once."""
    text, a = text.lower().translate(TABLE), 0
    while a < len(text):
        b = min((x for c in (b" ", GAP) if (x := text.find(c, a + step)) >= 0), default=len(text))
        yield text[a:b].replace(GAP, b" " + GAP + b" ").split()
        a = b


class WordCount:
    """Single words of one language in a task: one container."""

    order, full, known = 1, False, 0

    def __init__(self, lang: str):
        self.lang, self.counts = lang, Counter()

    @property
    def size(self) -> int:
        return len(self.counts)

    def read(self, text: bytes, step: int) -> Iterator[None]:
        """Count the words of ``text``; stops after each part, so that the caller can make room."""
        for tokens in _parts(text, step):
            self.counts.update(tokens)
            self.counts.pop(GAP, None)
            yield

    def spilled(self, keep: int) -> Iterator[pa.RecordBatch]:
        words = sorted(self.counts) if self.size > keep else []
        for a in range(0, len(words), ROWS):
            some = words[a : a + ROWS]
            names = pa.array(some, pa.binary()).cast(pa.string())
            yield _rows(self.lang, names, pa.array([self.counts[w] for w in some], pa.int64()))
        if words:
            self.counts = Counter()


def _rows(lang: str, phrase: pa.Array, n: pa.Array, *prefix: pa.Array) -> pa.RecordBatch:
    langs = pa.DictionaryArray.from_arrays(np.zeros(len(n), np.int8), [lang]).cast(pa.string())
    return pa.RecordBatch.from_arrays([langs, phrase, n, *prefix], ["lang", "phrase", "n", "prefix"][: 3 + len(prefix)])


class PhraseCount:
    """Phrases of one order and language in a task."""

    #: Set while all that was counted must be put out, as words get new ids.
    full = False

    def __init__(self, lang: str, order: int, words: np.ndarray, parts: np.ndarray, burst: int):
        """words, parts: the filters of frequent words and of frequent phrases one word shorter."""
        self.lang, self.order, self.parts = lang, order, parts
        self.words, self.trie = Words(lang, words), HatTrie(order, burst)

    @property
    def size(self) -> int:
        return self.trie.size

    @property
    def known(self) -> int:
        return len(self.words)

    def read(self, text: bytes, step: int) -> Iterator[None]:
        """Count the phrases of ``text``; stops after each part, so that the caller can make room."""
        tail, held = np.zeros(0, np.int64), []
        for tokens in _parts(text, step):
            if len(self.words) > KNOWN:
                self.full = True
                yield
                self.full = False
                self.words.renew()
                tail = self.words.ids(held)
            ids = np.concatenate((tail, self.words.ids(tokens)))
            self._count(ids)
            tail = ids[max(0, len(ids) - self.order + 1) :]
            held = [self.words.names[i] if i else GAP for i in tail.tolist()]
            yield

    def _count(self, ids: np.ndarray) -> None:
        k = self.order
        alive = ids > 0
        if k > 2:
            m = max(0, len(ids) - k + 2)
            start = np.flatnonzero(np.logical_and.reduce([alive[j : j + m] for j in range(k - 1)]))
            h = self.words.hashes[0]
            start = start[bloom.found(self.parts, _joined([h[ids[start + j]] for j in range(k - 1)]))]
            alive = np.zeros(m, bool)
            alive[start] = True
        start = np.flatnonzero(alive[:-1] & alive[1:])
        first, rest = ids[start], np.zeros(len(start), np.int64)
        for j in range(1, k):
            rest = rest << BITS | ids[start + j]
        if k < 4:
            packed, counts = np.unique(first << BITS * (k - 1) | rest, return_counts=True)
            self.trie.add(packed >> BITS * (k - 1), packed & (1 << BITS * (k - 1)) - 1, counts)
            return
        order = np.lexsort((rest, first))
        first, rest = first[order], rest[order]
        new = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])))) if len(first) else np.zeros(0, np.int64)
        self.trie.add(first[new], rest[new], np.diff(np.append(new, len(first))))

    def spilled(self, keep: int) -> Iterator[pa.RecordBatch]:
        first, rest, counts = self.trie.spill(keep)
        names = pa.array(self.words.names, pa.binary()).cast(pa.string()) if len(first) else None
        for a in range(0, len(first), ROWS):
            at = slice(a, a + ROWS)
            words = [names.take(pa.array(w)) for w in self.trie.words(first[at], rest[at])]
            phrase = pc.binary_join_element_wise(*words, " ")
            yield _rows(self.lang, phrase, pa.array(counts[at]), *([pc.binary_join_element_wise(*words[:2], " ")] if self.order > 2 else []))


def _runs(order: int, words, parts, room: int, step: int, burst: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, WordCount | PhraseCount] = {}
        filters = [x and x.value for x in (words, parts)]

        def spill(keep: int) -> Iterator[pa.RecordBatch]:
            left = sum(c.size for c in held.values())
            for c in sorted(held.values(), key=lambda c: -c.size):
                if left <= keep:
                    break
                before = c.size
                yield from c.spilled(max(0, before - (left - keep)))
                left -= before - c.size

        for batch in batches:
            lang, text = batch.column(0), batch.column(1)
            for name in pc.unique(lang).to_pylist():
                if sum(c.known for c in held.values()) > KNOWN or name not in held and len(held) >= LANGS:
                    yield from spill(0)
                    held.clear()
                if name not in held:
                    held[name] = WordCount(name) if order == 1 else PhraseCount(name, order, *filters, burst)
                counter = held[name]
                for _ in counter.read(GAP.join(text.filter(pc.equal(lang, name)).cast(pa.binary()).to_pylist()), step):
                    if counter.full:
                        yield from counter.spilled(0)
                    elif sum(c.size for c in held.values()) > room:
                        yield from spill(room // 2)
        yield from spill(0)

    return run


def _filter(phrases: DataFrame, limit: int):
    """The broadcast filter of (lang, phrase) rows, of at most ``limit`` bytes."""
    blocks = min(max(1, limit // bloom.BLOCK_BYTES), phrases.count() // bloom.PER_BLOCK + 1)

    def hashed(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        rows = [word_hashes(lang, phrase.encode().split(b" ")) for lang, phrase in zip(*(c.to_pylist() for c in part.columns))]
        h = np.array(rows, U).reshape(len(rows), -1)
        return np.zeros(len(rows), np.int64), (_joined(list(h.T)) if h.shape[1] > 1 else h[:, 0]) if rows else np.zeros(0, U)

    return phrases.sparkSession.sparkContext.broadcast(bloom.built(phrases.select("lang", "phrase"), hashed, {0: blocks})[0])


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 30, longest: int = 4, room: int = ROOM, filter_bytes: int = FILTER, step: int = STEP, burst: int = BURST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a): phrases of 1 to ``longest`` words that occur ``least`` times or more within pieces; and
    (lang, n), the words of each language. Both written."""
    rows = docs.where(F.col(f"`{text}`").isNotNull()).select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    counts = total = words = parts = None
    sent = []
    for order in range(1, longest + 1):
        # a phrase of up to two words is its own prefix
        by = ["lang", "prefix"] if order > 2 else ["lang", "phrase"]
        runs = rows.mapInArrow(_runs(order, words, parts, room, step, burst), RUNS + ", prefix string" * (order > 2)).repartition(*by)
        summed = runs.groupBy(*dict.fromkeys([*by, "phrase"])).agg(F.sum("n").alias("a"))
        if order == 1:
            every = staged(summed)
            total = staged(every.groupBy("lang").agg(F.sum("a").alias("n")))
            summed = every
        here = staged(summed.where(F.col("a") >= least).select("lang", "phrase", F.lit(order).alias("size"), "a"))
        if order == 1:
            drop_staged(every)
        counts = here if counts is None else counts.unionByName(here)
        if order == longest or not here.take(1):
            break
        parts = _filter(here, filter_bytes)
        sent.append(parts)
        words = words or parts
    for table in sent:
        table.destroy()
    return counts, total


def _floor(top: Column, times: int, below: Column) -> Column:
    """floor(times * top / below) without overflow."""
    return F.call_function("div", top.cast("decimal(20,0)") * F.lit(times).cast("decimal(10,0)"), below.cast("decimal(21,0)"))


def collocations(counts: DataFrame, total: DataFrame, top: int = 2000, covered: int = 80, parts: int = PARTS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of the phrases of two words or more, without those that a longer one has
    ``covered`` percent of, the ``top`` of each language by the score of the cut that scores lowest."""
    words = counts.where("size > 1").withColumn("w", F.split("phrase", " "))
    piece = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cut = words.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("left"), piece(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    known = lambda c, n: counts.select("lang", F.col("phrase").alias(c), F.col("a").alias(n))
    cut = cut.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"])
    score = _floor(F.col("a"), 2_000_000, F.col("l").cast("decimal(20,0)") + F.col("r"))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s"))

    longer = words.where("size > 2").select("lang", "a", "w", F.col("size").alias("of"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = longer.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("of") - F.col("m") + 1)).alias("at")).select("lang", piece(F.col("at"), F.col("m")).alias("phrase"), "a")
    cover = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    share = F.col("most").cast("decimal(20,0)") * F.lit(100) >= F.col("a").cast("decimal(20,0)") * F.lit(covered)
    kept = scored.join(cover, ["lang", "phrase"], "left").where(~F.coalesce(share, F.lit(False)))

    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = kept.select("lang", "phrase", "a", "s.l", "s.r", "s.score", F.pmod(F.xxhash64("phrase"), F.lit(parts)).alias("part"))
    for by in (["lang", "part"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return rows.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: Whole documents, production parameters.
SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, doc_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
total as (select lang, sum(len(w))::bigint as n from words group by 1),
phrases as (
  select lang, k as size, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as a
  from words, unnest(range(1, 5)) as s(k), unnest(range(1, len(w) - k + 2)) as t(i)
  group by 1, 2, 3 having count(*) >= 30
),
cut as (
  select lang, phrase, size, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') as lefts, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') as rights
  from phrases, unnest(range(1, size)) as s(k) where size > 1
),
scored as (
  select c.lang, c.phrase, c.a, l.a as l, r.a as r, k, ((2000000::hugeint * c.a) // (l.a::hugeint + r.a))::bigint as score
  from cut c join phrases l on l.lang = c.lang and l.phrase = c.lefts join phrases r on r.lang = c.lang and r.phrase = c.rights
),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
cover as (
  select lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') as phrase, max(a) as most
  from phrases, unnest(range(2, size)) as s(m), unnest(range(1, size - m + 2)) as t(i) where size > 2 group by 1, 2
),
kept as (select s.* from lowest s left join cover c using (lang, phrase) where most is null or 100::hugeint * most < 80::hugeint * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join total using (lang) qualify rank <= 2000
"""
