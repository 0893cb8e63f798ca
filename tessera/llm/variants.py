"""Groups of spelling variants by neighbourhoods of one edit, guided by Bloom filters.

(1) Runs of letters are counted as words. (2) The vocabulary fills blocked Bloom filters, one for each length, which are
broadcast. (3) A task makes, for its words, every deletion and every replacement by a later letter of the vocabulary's
alphabet, as hashes only, each from the word's own in one step, and probes the filter of the edit's length: so each
unordered pair of near words is made once, an insertion being the other word's deletion. (4) Only positives become
strings and are shuffled to a join with the vocabulary, which removes the false ones. (5) Each word takes its most
frequent neighbour as its form if that is frequent enough, and forms are followed to their ends, doubling each round.

Filters are bounded: a pass broadcasts at most FILTER bytes; a larger vocabulary goes in more passes over shards of
lengths, and a length that alone is larger is parted by hash. So memory doesn't grow with the vocabulary, and no edit
is dropped. The edits of one word are made in pieces of EDITS; a word has no more neighbours than edits (some two
thousand at ten letters), which bounds every group here. The noise (deletion of one letter of some runs) is the
contract's; ``every=0`` leaves it out.

Nulls and edges: a null or empty text has no runs; a null key is taken as empty in the noise; repeated rows count again;
ties of frequent neighbours go to the smallest in code-point order; a long text is one row of its runs, a long run one
word, in time proportional to its letters times the alphabet; columns beside key and text play no part; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import ascii_lower, drop_staged, staged
from .hashing import BASE, INVERSE, U, powers

#: The letters of a word, once A-Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
#: Bytes of filters in one pass; edits made at once.
FILTER, EDITS = 32 << 20, 1 << 20


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7, occurrences: int = 2, every: int = 31) -> DataFrame:
    """(word, n): the words of ``least`` letters or more that occur ``occurrences`` times or more, and how often."""
    runs = F.regexp_extract_all(ascii_lower(F.col(f"`{text}`")), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("k"), F.explode(runs).alias("run"))
    if every:
        rows = rows.withColumn("h", F.crc32(F.concat("k", F.lit(":"), "run")))
        at = F.pmod("h", F.length("run")).cast("int")
        without = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
        rows = rows.withColumn("run", F.when(F.col("h") % every == 0, without).otherwise(F.col("run")))
    return rows.where(F.length("run") >= least).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= occurrences)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, letters) of the words of each length, letters one row a word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), n).astype(U)


def _hashes(letters: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (letters * powers(BASE, letters.shape[1])).sum(1, dtype=U)


def _hashed(parted: dict[int, int], shards: dict[tuple[int, int], int]) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]:
    """Shard and hash of a batch's words; shard -1: of another pass."""

    def run(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        words = part.column(0).to_pylist()
        shard, h = np.full(len(words), -1, np.int64), np.zeros(len(words), U)
        for at, letters in _by_length(words):
            n = letters.shape[1]
            h[at] = _hashes(letters)
            parts = (h[at] % U(parted[n])).astype(int)
            shard[at] = [shards.get((n, p), -1) for p in parts]
        return shard, h

    return run


def edits(letters: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, word, place, letter, hash) of the deletions (letter 0) and of the replacements by a later letter of all words,
    in pieces; equal deletions of a run of one letter are made once."""
    n, size = letters.shape
    p = powers(BASE, size)
    with np.errstate(over="ignore"):
        below = np.concatenate((np.zeros((n, 1), U), np.cumsum(letters * p, 1, dtype=U)), 1)
        h = below[:, -1]
        for i in range(size):
            rows = np.flatnonzero(letters[:, i] != letters[:, i - 1]) if i else np.arange(n)
            gone = below[rows, i] + (h[rows] - below[rows, i + 1]) * U(INVERSE)
            yield size - 1, rows, np.full(len(rows), i), np.zeros(len(rows), U), gone
            step = max(1, EDITS // max(1, n))
            for a in range(0, len(alphabet), step):
                some = alphabet[a : a + step]
                rows, which = np.nonzero(some[None, :] > letters[:, i : i + 1])
                yield size, rows, np.full(len(rows), i), some[which], h[rows] + (some[which] - letters[rows, i]) * p[i]


def _probe(parted: dict[int, int], shards: dict[tuple[int, int], int], tables, alphabet: np.ndarray) -> Callable:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            words, counts = part.column(0).to_pylist(), part.column(1).to_numpy()
            for at, letters in _by_length(words):
                step = max(1, EDITS // (letters.shape[1] + len(alphabet)))
                for a in range(0, len(at), step):
                    where, near = [], []
                    for size, rows, places, new, h in edits(letters[a : a + step], alphabet):
                        for p in range(parted.get(size, 0)):
                            if (size, p) in shards:
                                mine = np.flatnonzero(h % U(parted[size]) == p) if parted[size] > 1 else np.arange(len(h))
                                hit = mine[bloom.found(tables.value[shards[size, p]], h[mine])]
                                for r, i, c in zip(rows[hit].tolist(), places[hit].tolist(), new[hit].tolist()):
                                    w = words[at[a + r]]
                                    where.append(at[a + r])
                                    near.append(f"{w[:i]}{chr(c) if c else ''}{w[i + 1 :]}")
                    if near:
                        yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in where]), pa.array(counts[where]), pa.array(near)], ["word", "n", "near"])

    return run


def passes(sizes: dict[int, int], limit: int = FILTER) -> tuple[dict[int, int], list[dict[tuple[int, int], int]]]:
    """For numbers of words by length: the parts of each length, and the blocks of each (length, part) in each pass."""
    need = {n: max(1, -(-words // bloom.PER_BLOCK)) for n, words in sizes.items()}
    most = max(1, limit // bloom.BLOCK_BYTES)
    parted = {n: -(-blocks // most) for n, blocks in need.items()}
    out, room = [], 0
    for n in sorted(sizes):
        for p in range(parted[n]):
            blocks = -(-need[n] // parted[n])
            if blocks > room:
                out.append({})
                room = most
            out[-1][n, p] = blocks
            room -= blocks
    return parted, out


def near_pairs(words: DataFrame, filter_bytes: int = FILTER) -> DataFrame:
    """(word, n, near, near_n): each unordered pair of ``words`` (word, n) that one edit parts, once; written."""
    spark = words.sparkSession
    sizes = {r[0]: r[1] for r in words.groupBy(F.length("word")).count().collect()}
    letters = [r[0] for r in words.select(F.explode(F.array_distinct(F.split("word", "")))).distinct().collect()]
    alphabet = np.sort(np.array([ord(c) for c in letters if c], U))
    parted, todo = passes(sizes, filter_bytes)
    positive = None
    for blocks in todo:
        shards = {s: i for i, s in enumerate(blocks)}
        tables = spark.sparkContext.broadcast(bloom.built(words.select("word"), _hashed(parted, shards), {i: blocks[s] for s, i in shards.items()}))
        got = staged(words.select("word", "n").mapInArrow(_probe(parted, shards, tables, alphabet), "word string, n bigint, near string"))
        tables.destroy()
        positive = got if positive is None else positive.unionByName(got)
    if positive is None:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).where("false")
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = staged(positive.join(known, "near").select("word", "n", "near", "near_n"))
    drop_staged(positive)
    return pairs


def _ends(forms: DataFrame) -> DataFrame:
    """(word, root): pointers (word, form) followed to their ends."""
    at = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        far = at.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = staged(at.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        drop_staged(at)
        at = step
        if not step.where("moved").take(1):
            return step.select("word", "root")


def variants(words: DataFrame, times: int = 10, filter_bytes: int = FILTER) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each of ``words`` (word, n): how many words are one edit away; the most
    frequent of these if it occurs ``times`` as often or more; and where forms lead at last, the word itself if nowhere."""
    words = staged(words.select("word", "n"))
    pairs = near_pairs(words, filter_bytes)
    both = pairs.select(F.explode(F.array(F.struct("word", F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")).alias("o")), F.struct(F.col("near").alias("word"), F.struct((-F.col("n")).alias("m"), F.col("word").alias("w")).alias("o")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("o").alias("o"))
    strong = -F.col("o.m") >= times * F.col("n")
    out = staged(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(strong, F.col("o.w")).alias("form"), F.when(strong, -F.col("o.m")).alias("form_n")))
    drop_staged(words, pairs)
    return out.join(_ends(out.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


#: Whole documents, production parameters. The checksum is worked out byte by byte; near words are found by equal deletions.
SQL = """
with recursive tab as (
  select list(list_reduce(list_concat([i::ubigint], list_transform(range(8), lambda k: k::ubigint)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from range(256) as r(i)
),
runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) as run from documents
),
bytes as (
  select run, t, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from runs, tab
),
summed as (
  select run, xor(list_reduce(list_concat([4294967295::ubigint], list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::ubigint)),
                              lambda c, b: xor(c >> 8, t[((xor(c, b)) % 256 + 1)::bigint])), 4294967295::ubigint) as h
  from bytes
),
noisy as (
  select case when h % 31 = 0 then run[1:(h % len(run))::bigint] || run[(h % len(run))::bigint + 2:] else run end as word from summed
),
v as (select word, count(*) as n from noisy where len(word) >= 7 group by 1 having count(*) >= 2),
d as (select word, n, i, word[1:i - 1] || word[i + 1:] as s from v, unnest(range(1, len(word) + 1)) as r(i)),
pairs as (
  select a.word, b.word as near, b.n as near_n from d a join d b on a.s = b.s and a.i = b.i and a.word <> b.word
  union select d.word, v.word, v.n from d join v on v.word = d.s
  union select v.word, d.word, d.n from d join v on v.word = d.s
),
best as (select word, count(*) as n_near, arg_min(near, (-near_n, near)) as form, max(near_n) as form_n from pairs group by 1),
w as (
  select v.word, v.n, coalesce(n_near, 0)::bigint as n_near, case when form_n >= 10 * v.n then form end as form, case when form_n >= 10 * v.n then form_n end as form_n
  from v left join best using (word)
),
ends as (
  select word, word as root, 0 as step from w
  union all select e.word, w.form, step + 1 from ends e join w on w.word = e.root where w.form is not null
)
select w.*, root from w join (select word, arg_max(root, step) as root from ends group by 1) using (word)
"""
