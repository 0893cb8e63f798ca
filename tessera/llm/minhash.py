"""MinHash near-dedup with b-bit signatures.

A document's set holds the hashes (64 bits) of its distinct shingles. Documents of equal sets are one class. Each class
has PERMUTATIONS minima; BANDS bands of them put it into buckets, and buckets of the same members count once. Of each
minimum the low BITS bits are packed into a signature; the share of equal fields of two signatures, found by bit
counts and corrected for the chance 2**-BITS of equal low bits, estimates their similarity. Pairs of a bucket that are
estimated at ``threshold - SLACK`` or more (SLACK is five standard deviations) are candidates, and their full sets
decide.

No bucket's pairs are written out. Classes that buckets connect, directly or by way of others, are a neighbourhood; each
class belongs to one. A neighbourhood of at most CLOSE classes and CLOSE_SHINGLES shingles goes to a task as a whole:
starting anywhere, a search compares each class it reaches with those not reached yet, first by signature, then on full
sets (bit rows of the frequent shingles, short lists of the rare ones), so exactly the classes joined by links end up
together, and one row for each comes out. A larger neighbourhood is settled in rounds over its buckets. The first
proposes, in each bucket, the links of its most central member (nearest to the field-wise most frequent values).
Confirmed links join classes to components. In each later round, the members outside a bucket's largest component
propose their nearest members of other components that haven't been tried, twice as many as the round before, until
such a round proposes nothing: then each pair of a bucket that looks similar enough is in one component or was compared
on full sets. To bound memory, the first round reads a bucket in blocks of BLOCK members; the central member of the first
block goes with each further block. For the later rounds a bucket of more members is dealt into half blocks, and each two
of these make a part that stands for a bucket of its own, so that every pair of members meets in one.

With 40 bands of 5 rows a pair of similarity 0.8 shares no bucket with a chance of 3e-6 at most, and a chance link would
need another path to be missed as well.

Nulls and edges: null texts and texts without words have an empty set, 0 shingles, and are linked with nothing; a text
of fewer words than a shingle has one, all its words; rows of a null id get a null component and are kept; rows that
repeat an id belong to one document for ``component_id``, each row getting the component of its own text. Ties go to the
smaller id; very long texts are shingled whole. Columns beside key and text are kept by ``near_dedup``. An empty table
gives an empty table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, small_or_shuffled, staged
from .common import staged as write
from .components import components
from .hashing import U, batches, mix, shingle_sets

ROWS, BANDS, BITS = 5, 40, 2
PERMUTATIONS = ROWS * BANDS
SLACK, BLOCK = 0.18, 50_000
CLOSE, CLOSE_SHINGLES, RARE = 20_000, 4_000_000, 16
#: Bytes of the bit rows of a neighbourhood, and rows of them that are compared at once.
BIT_BYTES, AT_ONCE = 64 << 20, 1024
FIELDS = -(-PERMUTATIONS * BITS // 64)
LOW = U(int("01" * 32, 2))


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=U))
    return (x[:n] >> U(32)).astype(np.uint32), (x[n:] >> U(32)).astype(np.uint32) | np.uint32(1)


XOR, TIMES = _constants(PERMUTATIONS)


def minima(s: np.ndarray) -> np.ndarray:
    """PERMUTATIONS minima of the hashes ``s``, a slice of them at a time."""
    x = (s >> U(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        low = np.minimum(low, ((x[i : i + 512, None] ^ XOR) * TIMES).min(axis=0))
    return low


def pack(low: np.ndarray) -> np.ndarray:
    """Rows of minima as rows of FIELDS words of 64 / BITS low-bit fields each."""
    per = 64 // BITS
    v = np.zeros((len(low), FIELDS * per), U)
    v[:, :PERMUTATIONS] = low & ((1 << BITS) - 1)
    return np.bitwise_or.reduce(v.reshape(len(low), FIELDS, per) << (np.arange(per, dtype=U) * U(BITS)), axis=2)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimates of the rows ``b`` against the row ``a``."""
    x = a ^ b
    differ = np.bitwise_count((x | (x >> U(1))) & LOW).sum(axis=-1, dtype=np.int64)
    c = 2.0**-BITS
    return ((1 - differ / PERMUTATIONS) - c) / (1 - c)


def _sign(shingle: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [(t or "").encode() for t in part.column(1).to_pylist()]
            n, cls, sigs, bands = [], [], [], []
            for at in batches(texts):
                for s in shingle_sets(texts[at], shingle):
                    n.append(len(s))
                    if not len(s):
                        cls.append(None), sigs.append(None), bands.append(None)
                        continue
                    with np.errstate(over="ignore"):
                        cls.append(int(mix(np.array([mix(s * U(3)).sum(dtype=U) ^ mix(s + U(len(s))).sum(dtype=U) * U(5)], U)).view(np.int64)[0]))
                        low = minima(s)
                        b = np.arange(BANDS, dtype=U)
                        for j in range(ROWS):
                            b = mix(b * U(0x9E3779B97F4A7C15) + low[j::ROWS].astype(U))
                    sigs.append(pack(low[None])[0].tobytes())
                    bands.append(b.view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["key", "t", "n", "cls", "sig", "bands"])

    return run


def _runs(parts: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[dict, bool]]:
    """Columns of the rows of each bucket, from rows that come sorted by bucket; at most ``block`` rows at once. The flag
    says that the bucket goes on from the block before."""
    held, before, size = [], None, 0
    for part in parts:
        bucket = part.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            for c in range(a, b, block):
                m = min(b, c + block) - c
                if held and (bucket[a] != before[0] or size + m > block):
                    yield pa.Table.from_batches(held), before[1]
                    held, size, before = [], 0, (bucket[a], bucket[a] == before[0])
                elif not held:
                    before = (bucket[a], False)
                held.append(part.slice(c, m))
                size += m
    if held:
        yield pa.Table.from_batches(held), before[1]


def _in_parts(member: DataFrame, block: int) -> DataFrame:
    """``member`` (bucket, node) with a bucket of more than ``block`` members as several: one for each two of its half
    blocks, so that each two members have one in common."""
    n = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    n = n.select("bucket", F.ceil(2 * F.col("n") / block).alias("halves"))
    halves, own = F.col("halves"), F.pmod(F.xxhash64("node", "bucket"), F.col("halves"))
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), halves - 1), lambda j: j != own)
    parts = F.when(halves.isNull(), F.array("bucket")).otherwise(F.transform(others, lambda j: F.xxhash64("bucket", F.least(j, own), F.greatest(j, own))))
    return member.join(n, "bucket", "left").select(F.explode(parts).alias("bucket"), "node")


def _fields(sig: np.ndarray) -> np.ndarray:
    """Each field of each row as a number."""
    per = 64 // BITS
    return ((sig[:, :, None] >> (np.arange(per, dtype=U) * U(BITS))) & U((1 << BITS) - 1)).reshape(len(sig), -1)[:, :PERMUTATIONS].astype(np.uint8)


def _propose(least: float, reach: int, block: int):
    """Candidate pairs of each bucket; ``reach`` 0: links of the central member, else so many from each outsider (there
    buckets are read whole)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for rows, goes_on in _runs(parts, sys.maxsize if reach else block):
            node = rows.column("node").to_numpy()
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), U).reshape(-1, FIELDS)
            comp = rows.column("comp").to_numpy()
            if goes_on and hub is not None:
                node, sig, comp = np.append(node, hub[0]), np.vstack((sig, hub[1][None])), np.append(comp, hub[2])
            if len(node) < 2:
                hub = (node[0], sig[0], comp[0]) if not goes_on else hub
                continue
            x, y = [], []
            if not reach:
                if len(node) == 2:
                    h = 0
                else:
                    f = _fields(sig)
                    common = np.argmax([(f == v).sum(axis=0) for v in range(1 << BITS)], axis=0)
                    h = int(np.argmax((f == common).sum(axis=1)))
                if not goes_on:
                    hub = (node[h], sig[h], comp[h])
                ok = (similarity(sig[h], sig) >= least) & (comp != comp[h])
                x, y = [np.full(ok.sum(), node[h])], [node[ok]]
            else:
                ids, at, many = np.unique(comp, return_inverse=True, return_counts=True)
                tried = rows.column("tried").to_pylist()
                for i in np.flatnonzero(at != np.argmax(many)):
                    est = similarity(sig[i], sig)
                    est[comp == comp[i]] = -1
                    if tried[i]:
                        est[np.isin(node, tried[i])] = -1
                    best = np.argsort(-est, kind="stable")[:reach]
                    best = best[est[best] >= least]
                    x.append(np.full(len(best), node[i]))
                    y.append(node[best])
            x, y = np.concatenate(x or [np.zeros(0, np.int64)]), np.concatenate(y or [np.zeros(0, np.int64)])
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y), pa.int64()), pa.array(np.maximum(x, y), pa.int64())], ["x", "y"])

    return run


def _confirm(shingle: int, percent: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray] = ("", np.zeros(0, U))
        for part in parts:
            ok = []
            for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                if a != last[0]:
                    last = (a, shingle_sets([a.encode()], shingle)[0])
                s, t = last[1], shingle_sets([b.encode()], shingle)[0]
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ok, pa.bool_())], ["x", "y", "ok"])

    return run


def closure(sets: list[np.ndarray], sig: np.ndarray, percent: int) -> np.ndarray:
    """For each set the index of the first one that links lead to."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    values, number, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    # the shingles that more classes have than RARE get a column of bits, the most frequent ones if all won't fit
    room = max(64, 8 * BIT_BYTES // n)
    least = RARE if (many > RARE).sum() <= room else int(np.partition(many, -room)[-room])
    common = many > least
    place = np.cumsum(common) - 1
    bits = np.zeros((n, max(1, -(-int(common.sum()) // 64))), U)
    at = common[number]
    col = place[number[at]]
    np.bitwise_or.at(bits, (owner[at], col // 64), U(1) << (col % 64).astype(U))
    # the owners of each rare shingle, one after another
    rare = ~common[number]
    by = np.argsort(number[rare], kind="stable")
    owners, shingles = owner[rare][by], number[rare][by]
    first = np.searchsorted(shingles, np.arange(len(values) + 1))
    start = np.concatenate(([0], np.cumsum(size)))
    root, left = np.full(n, -1), np.arange(n)
    while len(left):
        seed = left[0]
        root[seed] = seed
        left, todo = left[1:], [seed]
        while todo and len(left):
            x = todo.pop()
            near = left[similarity(sig[x], sig[left]) >= percent / 100 - SLACK]
            if not len(near):
                continue
            both = np.concatenate([np.bitwise_count(bits[near[i : i + AT_ONCE]] & bits[x]).sum(axis=1, dtype=np.int64) for i in range(0, len(near), AT_ONCE)])
            own = number[start[x] : start[x + 1]]
            own = own[~common[own]]
            if len(own):
                a, m = first[own], first[own + 1] - first[own]
                shared = owners[np.repeat(a - (np.cumsum(m) - m), m) + np.arange(m.sum())]
                both = both + np.bincount(shared, minlength=n)[near]
            hit = near[100 * both >= percent * (size[x] + size[near] - both)]
            if len(hit):
                root[hit] = seed
                todo += hit.tolist()
                left = left[root[left] < 0]
    return root


def _settle(shingle: int, percent: int):
    """(node, root) from rows (super, node, sig, text) that come sorted by super and node."""

    def solve(rows: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        node = np.array([r[0] for r in rows], np.int64)
        texts = [r[2] for r in rows]
        sets = [s for at in batches(texts) for s in shingle_sets(texts[at], shingle)]
        return node, node[closure(sets, np.frombuffer(b"".join(r[1] for r in rows), U).reshape(-1, FIELDS), percent)]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last = [], None
        for part in parts:
            nodes, roots = [], []
            for top, node, sig, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3)):
                if top != last and rows:
                    a, b = solve(rows)
                    nodes.append(a), roots.append(b)
                    rows = []
                last = top
                rows.append((node, sig, text.as_py().encode()))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(roots))], ["node", "root"])
        if rows:
            a, b = solve(rows)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["node", "root"])

    return run


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, broadcast_rows: int = 2_000_000, close: int = CLOSE, block: int = BLOCK, made: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(signed, roots). signed: (key, t, n, cls) for each row, t being the hash of its text; roots: (node, root) for the classes linked with another.
    ``made`` takes the tables written on the way, for drop_staged() once both have been used."""
    made = [] if made is None else made

    def staged(df: DataFrame) -> DataFrame:
        made.append(write(df))
        return made[-1]

    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    signed = staged(own.withColumn("t", F.xxhash64("text")).mapInArrow(_sign(shingle), f"key {kind}, t bigint, n bigint, cls bigint, sig binary, bands array<bigint>"))
    classes = signed.where("cls is not null").groupBy(F.col("cls").alias("node")).agg(F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("rows"))
    in_bucket = staged(classes.select("node", F.explode("bands").alias("bucket")))
    shape = in_bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("b")).where("n > 1")
    buckets = staged(shape.groupBy("n", "a", "b").agg(F.min("bucket").alias("bucket")).select("bucket"))
    member = staged(in_bucket.join(buckets, "bucket"))
    hub = member.groupBy("bucket").agg(F.min("node").alias("x"))
    around = staged(components(member.join(hub, "bucket").select("x", F.col("node").alias("y"))).withColumnRenamed("root", "super"))
    n_nodes = around.count()
    marked = small_or_shuffled(around.select("node"), n_nodes, broadcast_rows)
    info = signed.where("cls is not null").select(F.col("cls").alias("node"), "n", "sig", "key").join(marked, "node", "left_semi")
    # any of the equal signatures, and one of the texts, stands for a class
    info = staged(info.groupBy("node").agg(F.first("sig").alias("sig"), F.first("n").alias("n"), F.min("key").alias("key")))
    sig, pick = info.select("node", "sig"), info.select(F.col("node").alias("cls"), "key")
    texts = own.withColumn("t", F.xxhash64("text")).join(small_or_shuffled(pick, n_nodes, broadcast_rows), "key").select("key", "text", "t", "cls")
    # a key that repeats may stand for several texts: the class is worked out again, so that each gets its own
    texts = staged(texts.mapInArrow(_classed(shingle), "node bigint, was bigint, text string").where("node = was").drop("was").dropDuplicates(["node"]))
    size = around.join(info.select("node", "n"), "node").groupBy("super").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    large = staged(size.where((F.col("m") > close) | (F.col("s") > CLOSE_SHINGLES)).select("super"))
    n_large = large.count()
    whole = around.join(small_or_shuffled(large, n_large, broadcast_rows), "super", "left_anti") if n_large else around
    whole = whole.join(sig, "node").join(texts, "node").select("super", "node", "sig", "text").repartition("super").sortWithinPartitions("super", "node")
    settled = staged(whole.mapInArrow(_settle(shingle, percent), "node bigint, root bigint"))
    if not n_large:
        return signed.select("key", "t", "n", "cls"), settled
    nodes = around.join(small_or_shuffled(large, n_large, broadcast_rows), "super", "left_semi").select("node")
    member = staged(member.join(nodes, "node"))

    comp, links, tried, reach = None, None, None, 0
    while True:
        if comp is None:
            rows = member.join(sig, "node").withColumn("comp", F.col("node")).withColumn("tried", F.lit(None).cast("array<bigint>"))
        else:
            state = staged(member.join(comp, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("comp")))
            mixed = state.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
            rows = state.join(mixed, "bucket").join(sig, "node").join(tried, "node", "left")
        rows = rows.select("bucket", "node", "sig", "comp", "tried").repartition("bucket").sortWithinPartitions("bucket", "node")
        pairs = staged(rows.mapInArrow(_propose(percent / 100 - SLACK, reach, block), "x bigint, y bigint").distinct())
        if not reach:
            member = staged(_in_parts(member, block))
        if not pairs.take(1):
            if reach:
                break
            reach = 3
            continue
        at = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}"))
        both = pairs.join(at("x"), "x").join(at("y"), "y").select("x", "y", "tx", "ty")
        checked = staged(both.mapInArrow(_confirm(shingle, percent), "x bigint, y bigint, ok boolean"))
        failed = checked.where("not ok")
        failed = failed.select(F.col("x").alias("node"), F.col("y").alias("other")).unionByName(failed.select(F.col("y").alias("node"), F.col("x").alias("other")))
        if tried is not None:
            failed = failed.unionByName(tried.select("node", F.explode("tried").alias("other")))
        tried = staged(failed.groupBy("node").agg(F.collect_set("other").alias("tried")))
        good = checked.where("ok").select("x", "y")
        links = good if links is None else links.unionByName(good)
        comp = staged(components(links))
        reach = max(3, reach * 2)
    if comp is None:
        comp = nodes.select("node", F.col("node").alias("root")).limit(0)
    return signed.select("key", "t", "n", "cls"), settled.unionByName(comp)


def _classed(shingle: int):
    sign = _sign(shingle)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            own = pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2)], ["key", "text", "t"])
            for got in sign(iter([own])):
                yield pa.RecordBatch.from_arrays([got.column(3), part.column(3), part.column(1)], ["node", "was", "text"])

    return run


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(key, t, n_shingles, component_id): for each row, the size of its set, and the smallest key that links lead to
    (its own if there are none)."""
    made: list[DataFrame] = []
    signed, comp = link(docs, key, text, shingle, percent, made=made)
    rooted = signed.join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("key", "t", "n", "cls", F.coalesce("root", "cls").alias("root"))
    rooted = staged(rooted)
    drop_staged(*made)
    least = rooted.where("root is not null").groupBy("root").agg(F.min("key").alias("least"))
    out = rooted.join(least, "root", "left")
    return out.select("key", "t", F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("least", "key")).alias("component_id"))


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, broadcast_rows: int = 2_000_000) -> DataFrame:
    """``docs`` with one row left of each component, that of its smallest key (of several texts of that key, the one of
    least hash). Texts move only if the keys to drop are too many to broadcast."""
    found = near_components(docs, key, text, shingle, percent).where("key is not null")
    rows = found.groupBy("key", "t").agg(F.first("component_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    first = rows.where("key = component_id").groupBy("key", "component_id").agg(F.min("t").alias("t"))
    rows = staged(rows.join(first.withColumn("stays", F.lit(True)), ["key", "component_id", "t"], "left"))
    drop = rows.where("stays is null").select(F.col("key").alias("__nd_key"), F.col("t").alias("__nd_t"))
    same = (F.col(f"`{key}`") == F.col("__nd_key")) & (F.xxhash64(f"`{text}`") == F.col("__nd_t"))
    out = docs.join(small_or_shuffled(drop, drop.count(), broadcast_rows), same, "left_anti")
    twice = rows.where("stays and n > 1").select(F.col("key").alias("__nd_key"), F.col("t").alias("__nd_t"))
    if twice.take(1):
        mark = small_or_shuffled(twice, twice.count(), broadcast_rows)
        out = out.join(mark, same, "left_anti").unionByName(out.join(mark, same, "left_semi").dropDuplicates([key, text]))
    return out


#: Brute force over all pairs, for whole documents and shingles of 4 words.
SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
),
s as (
  select distinct doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') as g
  from w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as r(i) where len(w) > 0
),
n as (select doc_id, count(*) as n from s group by 1),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from common join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
reach as (select x as doc_id, x as other from links union select doc_id, y from reach join links on other = x),
comp as (select doc_id, min(other) as m from reach group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m, d.doc_id))::bigint as component_id,
       d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) as kept
from documents d left join n using (doc_id) left join comp using (doc_id)
"""
