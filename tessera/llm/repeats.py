"""Suffix-array dedup of long repeated byte strings, over all documents.

A string of ``size`` bytes that starts at two places is removed at both. Strings are routed by content so that equal
ones meet: each is known by the least hash of its grams of ``size // 2`` bytes, and neighbouring strings with the same
least hash are one stretch. (1) Every text is cut into its stretches, of which only hashes go on. (2) A least hash that
occurs once has no repeats, unless a gram with that hash is in the stretch twice, as in text that repeats itself.
(3) If all stretches of a least hash are equal, all their strings are repeated. (4) Only where they differ, or may
repeat within themselves, is text looked at: one copy of each distinct stretch goes to the shard of its least hash, and
the shard's suffix and common-prefix order (induced.py: external induced sorting) tells which strings start elsewhere
too. (5) The strings found are laid back over the documents.

Least hashes are joined and counted, never gathered by key. Where the distinct stretches of one least hash have more
than HOT bytes (a passage that stands in very many documents, each time among other text), they are cut again, by the
least hash of longer grams, halfway to ``size`` each time: the longer the gram, the fewer strings share it, and at
``size`` itself all strings of a hash are equal. So no key gathers more than HOT bytes in a task. A shard is a run of
the rows of one task, written to a mapped file as they come and cut between least hashes at SHARD bytes; sorting it
takes bounded memory and files.

Stretches count as equal if two independent 64-bit hashes agree; strings found by the order are compared byte by byte.
Rows are known by key and hash of the text, which any scan gives again, so a retry or another split of the input changes
nothing.

Nulls and edges: a null text counts as an empty one; texts shorter than ``size`` lose nothing; rows equal in key and
text repeat each other and get the same result (their stretches are counted once for each row); a null key is a key;
very long texts are cut whole; a match never crosses from one text into another; other columns are kept by
``remove_repeats``. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, small_or_shuffled, staged
from .hashing import BASE, INVERSE, U, batches, mix, powers
from .induced import MEMORY, Space, repeated

SIZE, SHARD, HOT = 400, 2 << 20, 2 << 20


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours: prefix and suffix minima of blocks of w."""
    n = len(h) - w + 1
    blocks = -(-len(h) // w)
    x = np.full(blocks * w, U(0xFFFFFFFFFFFFFFFF))
    x[: len(h)] = h
    x = x.reshape(blocks, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _again(h: np.ndarray, least: np.ndarray, a: np.ndarray, b: np.ndarray, w: int) -> np.ndarray:
    """For each stretch, whether more than one of its grams has the least hash; some stretches at a time."""
    out = np.empty(len(a), bool)
    for i in range(0, len(a), 2048):
        at = slice(i, i + 2048)
        n = b[at] - a[at] + w
        starts = np.cumsum(n) - n
        where = np.repeat(a[at] - starts, n) + np.arange(n.sum())
        out[at] = np.add.reduceat(h[where] == np.repeat(least[at], n), starts, dtype=np.int64) > 1
    return out


def stretches(text: bytes, size: int, k: int) -> tuple[np.ndarray, ...]:
    """Least hash of grams of ``k`` bytes, hash of the stretch, first and last start, and whether it may repeat itself, of
    each stretch of a text of ``size`` bytes or more."""
    w = size - k + 1
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U)
        np.cumsum((t.astype(U) + U(1)) * powers(BASE, n), out=sums[1:])
        h = mix((sums[k:] - sums[:-k]) * powers(INVERSE, n)[: n - k + 1])
    least = _least(h, w)
    cuts = np.flatnonzero(np.diff(least)) + 1
    a = np.concatenate(([0], cuts))
    b = np.concatenate((cuts, [len(least)])) - 1
    whole = np.fromiter((xxhash.xxh3_64_intdigest(text[i : j + size]) for i, j in zip(a.tolist(), b.tolist())), U, len(a))
    return least[a], whole, a, b, _again(h, least[a], a, b, w)


def _cut(size: int, k: int):
    """(least, whole, id, n, a, b, again) from rows (id, text, n)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in batches(part.column(1), 4 << 20, lambda t: len(t.as_buffer()) if t.is_valid else 0):
                texts = [t.as_py() or b"" for t in part.column(1)[at]]
                found = [(i, *stretches(t, size, k)) for i, t in enumerate(texts, at.start) if len(t) >= size]
                if found:
                    cols = [np.concatenate([f[i] for f in found]) for i in range(1, 6)]
                    row = pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), part.column(0).take(row), part.column(2).take(row), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32)), pa.array(cols[4])],
                        ["least", "whole", "id", "n", "a", "b", "again"],
                    )

    return run


def _copy(size: int):
    """(least, whole, n, bytes) of the stretches wanted of each text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for text, wanted in zip(part.column(0), part.column(1)):
                t, w = text.as_py() or b"", wanted.as_py()
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([x[c] for x in w], pa.int64()) for c in ("least", "whole", "n")), pa.array([t[x["a"] : x["b"] + size] for x in w], pa.binary())],
                    ["least", "whole", "n", "bytes"],
                )

    return run


class _Shard:
    """Stretches that are sorted together, in a file as they come."""

    def __init__(self, size: int, memory: int):
        self.size, self.memory, self.held = size, memory, 0
        self.rows: list[tuple[int, int, int]] = []
        self.folder = tempfile.TemporaryDirectory(prefix="tessera-")
        self.file = open(os.path.join(self.folder.name, "text"), "wb")

    def add(self, least: int, whole: int, text: bytes) -> None:
        t = np.zeros(len(text) + 1, np.uint16)
        t[:-1] = np.frombuffer(text, np.uint8)
        t[:-1] += 1
        t.tofile(self.file)
        self.rows.append((least, whole, len(text)))
        self.held += len(text)

    def solve(self) -> pa.RecordBatch:
        """(least, whole, lo, hi): ranges of starts that are repeated."""
        self.file.close()
        least, whole, lengths = np.array(self.rows, np.int64).T
        with self.folder:
            t = np.asarray(np.memmap(self.file.name, np.uint16, "r"))
            out = []
            for i, starts in enumerate(repeated(t, lengths, self.size, Space(self.folder.name, self.memory))):
                if len(starts):
                    cuts = np.flatnonzero(np.diff(starts) > 1)
                    lo, hi = starts[np.append(0, cuts + 1)], starts[np.append(cuts, len(starts) - 1)]
                    out.append((np.full(len(lo), least[i]), np.full(len(lo), whole[i]), lo.astype(np.int32), hi.astype(np.int32)))
            del t
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, d) for d in (np.int64, np.int64, np.int32, np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["least", "whole", "lo", "hi"])


def _sorted(size: int, shard: int, memory: int):
    """(least, whole, lo, hi) from the rows of a task, which come sorted by least hash."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for part in parts:
            for m, w, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                if held and held.held >= shard and m != last:
                    yield held.solve()
                    held = None
                held, last = held or _Shard(size, memory), m
                held.add(m, w, x.as_py())
        if held:
            yield held.solve()

    return run


def _found(rows: DataFrame, size: int, k: int, broadcast_rows: int, shard: int, memory: int, hot: int) -> DataFrame:
    """(id, a, b): ranges of repeated starts in the texts of ``rows`` (id, text, n), text standing ``n`` times."""
    kind = rows.schema["id"].dataType.simpleString()
    cut = staged(rows.mapInArrow(_cut(size, k), f"least bigint, whole bigint, id {kind}, n bigint, a int, b int, again boolean"))
    kinds = cut.groupBy("least").agg(F.sum("n").alias("n"), (F.min("whole") != F.max("whole")).alias("differ"), F.max("again").alias("again"))
    kinds = kinds.where("n > 1 or again").select("least", (F.col("differ") | F.col("again")).alias("look"))
    used = staged(cut.drop("again").join(kinds, "least"))
    drop_staged(cut)
    plain = used.where("not look").select("id", "a", "b")

    each = staged(used.where("look").groupBy("least", "whole").agg(F.sum("n").alias("n"), F.min(F.struct("id", "a", "b")).alias("one")))
    long = F.col("one.b") - F.col("one.a")
    large = staged(each.groupBy("least").agg(F.sum(long + size).alias("bytes")).where(F.col("bytes") > hot).select("least", F.lit(True).alias("hot")))
    wanted = each.groupBy("one.id").agg(F.collect_list(F.struct("least", "whole", "n", "one.a", "one.b")).alias("wanted"))
    texts = rows.join(small_or_shuffled(wanted, each.count(), broadcast_rows), "id").select("text", "wanted")
    copies = texts.mapInArrow(_copy(size), "least bigint, whole bigint, n bigint, bytes binary")
    # a stretch that occurs twice is repeated throughout
    full = each.where("n > 1").select("least", "whole", F.lit(0).alias("lo"), long.alias("hi"))
    rest = None
    if k < size and (n_large := large.count()):
        copies = staged(copies.join(small_or_shuffled(large, n_large, broadcast_rows), "least", "left"))
        again = copies.where("hot").select(F.struct("least", "whole").alias("id"), F.col("bytes").alias("text"), "n")
        rest = _found(again, size, k + max(1, (size - k) // 2), broadcast_rows, shard, memory, hot).select("id.least", "id.whole", F.col("a").alias("lo"), F.col("b").alias("hi"))
        copies = copies.where("hot is null")
    found = copies.select("least", "whole", "bytes").repartition("least").sortWithinPartitions("least").mapInArrow(_sorted(size, shard, memory), "least bigint, whole bigint, lo int, hi int")
    found = found if rest is None else found.unionByName(rest)
    found = staged(found.join(full.select("least", "whole"), ["least", "whole"], "left_anti").unionByName(full))
    looked = used.where("look").join(found, ["least", "whole"]).select("id", (F.col("a") + F.col("lo")).alias("a"), (F.col("a") + F.col("hi")).alias("b"))
    out = staged(plain.unionByName(looked))
    drop_staged(used, each, large, found)
    return out


def repeated_ranges(docs: DataFrame, rid: str, text: str, size: int = SIZE, broadcast_rows: int = 500_000, shard: int = SHARD, memory: int = MEMORY, hot: int = HOT) -> DataFrame:
    """(rid, ranges): for each ``rid`` with repeats, the ranges (from, to) of bytes to remove, in order and apart."""
    own = docs.select(F.col(rid).alias("id"), F.col(text).cast("binary").alias("text"), F.lit(1).cast("bigint").alias("n"))
    starts = _found(own, size, max(1, size // 2), broadcast_rows, shard, memory, hot).select("id", "a", (F.col("b") + size).alias("b"))
    in_order = Window.partitionBy("id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    fresh = starts.withColumn("new", (F.col("a") > F.coalesce(F.max("b").over(in_order), F.lit(-1))).cast("int"))
    run = F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    merged = fresh.withColumn("run", run).groupBy("id", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.groupBy(F.col("id").alias("rid")).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("ranges"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the remaining bytes, binary) instead of ``text``;
    columns of these names are replaced."""
    add = ("n_bytes", "n_removed", "n_spans", "kept")
    rest = [c for c in docs.columns if c != text and c not in add]
    own = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("__rp_text"), F.struct(F.col(f"`{key}`").alias("k"), F.xxhash64(f"`{text}`").alias("t")).alias("__rp_rid"))
    ranges = repeated_ranges(own, "__rp_rid", "__rp_text", size)
    out = own.join(ranges.withColumnRenamed("rid", "__rp_rid").withColumnRenamed("ranges", "__rp_ranges"), "__rp_rid", "left")
    body = F.coalesce(F.col("__rp_text"), F.lit("")).cast("binary")
    n = F.octet_length(body)
    gone = F.coalesce(F.col("__rp_ranges"), F.array().cast("array<struct<a:int,b:int>>"))
    removed = F.aggregate(gone, F.lit(0).cast("bigint"), lambda s, x: s + x["b"] - x["a"])
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda x: x["b"]))
    ends = F.concat(F.transform(gone, lambda x: x["a"]), F.array(n))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substr(body, a + 1, b - a))
    # bytes may be cut within a character, so they are joined as digits
    kept = F.when(F.size(gone) == 0, body).otherwise(F.unhex(F.array_join(F.transform(pieces, lambda x: F.hex(x)), "")))
    return out.select(*[F.col(f"`{c}`") for c in rest], n.cast("bigint").alias("n_bytes"), removed.alias("n_removed"), F.size(gone).cast("bigint").alias("n_spans"), kept.alias("kept"))


def brute_force(texts: list[str | None], size: int = SIZE) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans and kept_sha256 of each text, by counting every string; for tests."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for t in raw:
        for i in range(len(t) - size + 1):
            seen[t[i : i + size]] = seen.get(t[i : i + size], 0) + 1
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out
