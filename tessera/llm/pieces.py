"""SentencePiece encoding by forward filtering and backward sampling, and its lossless decoding.

A text becomes ``▁`` and the text with each space as ``▁``, as the model does. No piece goes from other characters into
``▁``, so the lattice falls apart at the start of each run of spaces: its chunks (spaces and the word after them) are
independent. The forward pass sums, for each distinct chunk of a batch, the weights of all its segmentations up to each
character; the backward pass then draws, for all occurrences at once, the last piece, the one before it, and so on,
with the chance that the forward sums give it. The random numbers are a hash of (seed, row key, number of the chunk in
the text, step), so a row's segmentation does not depend on its partition, its neighbours or a retry.

The model is BPE and has merge ranks, not probabilities; a piece of rank r weighs 1 / (r + OFFSET) (Zipf), to the power
``sharpness``. Characters without a piece, and a ``▁`` that the text itself has, go to the model's byte pieces, which
makes decoding lossless for any text.

Nulls and edges: a null text gives null ids and null back; an empty text gives no pieces; a null key counts as the text
'null'; rows equal in key and text get the same segmentation. A lone surrogate can't be in a Spark string. A very long
text is encoded whole: blocks of chunks of some CHARS characters are drawn one after another, so that lattices take some
45 MB whatever the text, which itself takes some eight times its bytes; of a chunk of more than LONGEST characters (text
without spaces) only the sums at each block's start are kept, and the others worked out again on the way back. Other columns are kept by ``encode`` and ``decode``; a column that has the name
of the result is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back
from .hashing import BASE, U, batches, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
OFFSET, SHARPNESS, SEED = 2.7, 1.0, 1
SPACE = "▁"
#: Chunks of more characters than this go place by place, in blocks of so many places; the lattice is the same.
LONGEST, PLACES = 512, 1 << 14
#: Characters of chunks that are drawn together; pieces that are decoded together.
CHARS, TOGETHER = 1 << 18, 1 << 18
#: The last character before a run of spaces, at whose start a text can be cut.
CUT = re.compile("[^ ] ")
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Stands for a ▁ of the text itself while chunks are cut: a lone surrogate, which no text can hold.
OWN = chr(0xD800)
BYTES_OF = 1 << 24
SLOTS = 20


def _chance(seed, step: int):
    """A number in [0, 1) for each seed, of 24 bits."""
    with np.errstate(over="ignore"):
        return (mix(seed + U(step) * U(0xD1B54A32D192ED03)) >> U(40)).astype(np.float32) * np.float32(2.0**-24)


class Pieces:
    """Pieces by the hash of their characters, for many lookups at once: slot tables of which each piece is in one."""

    def __init__(self, ids: dict[str, int], weight: dict[str, float]):
        self.key = np.array([self.hash(p) for p in ids], U)
        self.id = np.array(list(ids.values()), np.int64)
        self.weight = np.array([weight[p] for p in ids])
        self.tables: list[tuple[U, np.ndarray]] = []
        left, k = np.arange(len(self.key)), 0
        while len(left):
            k += 1
            times = mix(np.array([k], U))[0] | U(1)
            with np.errstate(over="ignore"):
                slot = (self.key[left] * times) >> U(64 - SLOTS)
            _, first = np.unique(slot, return_index=True)
            table = np.full(1 << SLOTS, -1, np.int32)
            table[slot[first]] = left[first]
            self.tables.append((times, table))
            left = np.delete(left, first)

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for i, c in enumerate(piece):
            h += (ord(c) + 1) * pow(BASE, i, 1 << 64)
        return h & ((1 << 64) - 1)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(at, piece): which of the hashes are of pieces, and of which; later tables are asked only where a slot is taken by another."""
        where, found = [], []
        at = np.arange(len(h))
        for times, table in self.tables:
            with np.errstate(over="ignore"):
                got = table[(h * times) >> U(64 - SLOTS)]
            full = np.flatnonzero(got >= 0)
            got, at, h = got[full], at[full], h[full]
            hit = self.key[got] == h
            where.append(at[hit]), found.append(got[hit])
            at, h = at[~hit], h[~hit]
        return np.concatenate(where), np.concatenate(found)


class Lattice:
    """Vocabulary of a model, the lattices of chunks, and the ways back."""

    def __init__(self, model: bytes, sharpness: float):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.byte = {}
        self.text: list[bytes] = []
        ids: dict[str, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte[value] = i
                self.text.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.text.append(b"")
            else:
                ids[piece] = i
                self.text.append(piece.replace(SPACE, " ").encode())
        first = min(ids.values())
        self.weight = {p: (i, (i - first + 1 + OFFSET) ** -sharpness) for p, i in ids.items()}
        self.rare = (n + OFFSET) ** -sharpness
        self.longest = max(map(len, ids))
        self.pieces = Pieces(ids, {p: w for p, (_, w) in self.weight.items()})

    def chances(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rank of each chunk by length, its number of characters, and the first node of each place; for each node (a place
        of a chunk: first node of the place + rank) and length of the last piece, the cumulative chance and the piece.

        Nodes lie place by place, longer chunks first, so that the forward sums of all chunks are whole slices."""
        x = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        by = np.argsort(-size, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        start, longest = (np.cumsum(size) - size)[by], int(size.max())
        many = np.searchsorted(-size[by], -np.arange(longest + 1), side="right")
        many[0] = len(by)
        base = np.cumsum(many) - many
        width = self.longest
        cum, ids = np.full((int(many.sum()), width), np.float32(2.0)), np.zeros((int(many.sum()), width), np.int32)
        codes, f = [], [np.ones(len(by))]
        for j in range(1, longest + 1):
            n, most = int(many[j]), min(width, j)
            codes.append(x[start[:n] + (j - 1)].astype(U))
            w, h = np.zeros((most, n)), np.zeros(n, U)
            mine = ids[base[j] : base[j] + n]
            for m in range(1, most + 1):
                with np.errstate(over="ignore"):
                    h = h * U(BASE) + (codes[j - m][:n] + U(1))
                at, got = self.pieces.find(h)
                w[m - 1, at] = self.pieces.weight[got]
                mine[at, m - 1] = self.pieces.id[got]
            bare = np.flatnonzero(w[0] == 0)
            if len(bare):
                own = codes[-1][bare].astype(np.int64)
                own[own == ord(OWN)] = ord(SPACE)
                w[0, bare] = self.rare ** (1 + (own > 0x7F) + (own > 0x7FF) + (own > 0xFFFF))
                mine[bare, 0] = BYTES_OF + own
            for m in range(1, most + 1):
                w[m - 1] *= f[j - m][:n]
            np.cumsum(w, axis=0, out=w)
            total = w[-1].copy()
            w /= total
            w[w >= 1 - 1e-7] = 2.0
            cum[base[j] : base[j] + n, :most] = w.T
            small = np.flatnonzero(total < 1e-150)
            if len(small):  # far into long chunks: only the ratios of the last sums are used again
                total[small] *= 1e150
                for m in range(1, min(width, j) + 1):
                    f[j - m][small] *= 1e150
            f.append(total)
            if j > width:
                f[j - width - 1] = codes[j - width - 1] = None
        return rank, size, base, cum, ids

    def _ends(self, chunk: str, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """For the places a + 1 .. b of one chunk: weight and piece of each length that ends there."""
        n, width, low = b - a, self.longest, max(0, a - self.longest)
        x = np.frombuffer(chunk[low:b].encode("utf-32-le", "surrogatepass"), np.uint32)
        w, ids, h = np.zeros((n, width)), np.zeros((n, width), np.int32), np.zeros(n, U)
        padded = np.concatenate((np.zeros(width, U), x.astype(U) + U(1)))[-(n + width) :]
        for m in range(1, width + 1):
            with np.errstate(over="ignore"):
                h = h * U(BASE) + padded[width - m + 1 : width - m + 1 + n]
            at, got = self.pieces.find(h)
            at, got = at[at + a + 1 >= m], got[at + a + 1 >= m]
            w[at, m - 1] = self.pieces.weight[got]
            ids[at, m - 1] = self.pieces.id[got]
        bare = np.flatnonzero(w[:, 0] == 0)
        own = x[a - low :][bare].astype(np.int64)
        own[own == ord(OWN)] = ord(SPACE)
        w[bare, 0] = self.rare ** (1 + (own > 0x7F) + (own > 0x7FF) + (own > 0xFFFF))
        ids[bare, 0] = BYTES_OF + own
        return w, ids

    def _sums(self, w: np.ndarray, near: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """From the weights of a block of places and the sums of the places before it: the sums of these and of its own
        places, how often they had been multiplied by 1e150, and what the next block goes on from."""
        n, width = w.shape
        f, scaled = np.concatenate((near, np.zeros(n))), np.zeros(n, np.int32)
        w, near = w[:, ::-1].copy(), near.copy()
        for j in range(n):
            total = float(w[j] @ near)
            near[:-1] = near[1:]
            near[-1] = total
            if total < 1e-150:
                near *= 1e150
                times += 1
            f[width + j], scaled[j] = near[-1], times
        return f, scaled, near, times

    def long_chunk(self, chunk: str, seeds: np.ndarray) -> list[np.ndarray]:
        """The pieces of a long chunk, from the last to the first, for each seed."""
        n, width = len(chunk), self.longest
        near, times, starts = np.zeros(width), 0, []
        near[-1] = 1.0  # the sum at place 0
        scaled_before = np.zeros(width, np.int32)
        for a in range(0, n, PLACES):
            starts.append((near, times, scaled_before))
            _, scaled, near, times = self._sums(self._ends(chunk, a, min(n, a + PLACES))[0], near, times)
            # the sums that go on were brought to the last place's scale
            scaled_before = np.full(width, times, np.int32)
        out, places, steps = [[] for _ in seeds], np.full(len(seeds), n), np.zeros(len(seeds), np.int64)
        for a in range((n - 1) // PLACES * PLACES, -1, -PLACES):
            near, times, before = starts.pop()
            w, ids = self._ends(chunk, a, min(n, a + PLACES))
            f, scaled, _, _ = self._sums(w, near, times)
            scaled = np.concatenate((before, scaled))
            back = np.arange(len(w))[:, None] + (width - 1) - np.arange(width)[None, :]
            level = scaled[back]
            w *= f[back] * 1e150 ** (level[:, :1] - level).astype(float)
            np.cumsum(w, axis=1, out=w)
            w /= w[:, -1:]
            w[w >= 1 - 1e-7] = 2.0
            cum = w.astype(np.float32)
            for s, seed in enumerate(seeds):
                place, step, got = int(places[s]), int(steps[s]), []
                while place > a:
                    m = int(np.argmax(cum[place - 1 - a] > _chance(seed, step)))
                    got.append(ids[place - 1 - a, m])
                    place, step = place - m - 1, step + 1
                out[s].append(np.array(got, np.int32))
                places[s], steps[s] = place, step
        return [np.concatenate(o).astype(np.int64) for o in out]

    @staticmethod
    def _chunks(text: str) -> Iterator[tuple[int, list[str]]]:
        """Chunks of ``text``, of some CHARS characters at once, each time with the number of the first."""
        a = number = 0
        while a < len(text):
            cut = CUT.search(text, a + CHARS - 1) if len(text) - a > CHARS else None
            b = cut.start() + 1 if cut else len(text)
            chunks = CHUNK.findall((SPACE if a == 0 else "") + text[a:b].replace(SPACE, OWN).replace(" ", SPACE))
            yield number, chunks
            number, a = number + len(chunks), b

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts one after another, and where each text's end."""
        parts, size, block, room = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64), [], CHARS

        def draw() -> None:
            ids, ends = self._drawn([c for _, _, c in block], np.array([i for i, _, _ in block]), np.array([n for _, n, _ in block]), keys)
            parts.append(ids)
            np.add.at(size, [i for i, _, _ in block], np.diff(ends, prepend=0))
            block.clear()

        for i, text in enumerate(texts):
            for number, chunks in self._chunks(text):
                block.append((i, number, chunks))
                room -= sum(map(len, chunks))
                if room <= 0:
                    draw()
                    room = CHARS
        if block:
            draw()
        return np.concatenate(parts), np.cumsum(size)

    def _drawn(self, lists: list[list[str]], text: np.ndarray, first: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of lists of chunks one after another, and where each list's end; the text of each, and its first chunk's number."""
        number: dict[str, int] = {}
        at = [number.setdefault(c, len(number)) for chunks in lists for c in chunks]
        of_text = list(map(len, lists))
        chunks = list(number)
        rank, size, base, cum, ids = self.chances([c if len(c) <= LONGEST else c[:1] for c in chunks])
        at, of_text = np.array(at), np.array(of_text)
        ends = np.cumsum(of_text)
        row = np.repeat(np.arange(len(lists)), of_text)
        with np.errstate(over="ignore"):
            seed = mix(keys[text[row]] + (first[row] + np.arange(len(at)) - (ends - of_text)[row]).astype(U) * U(0x9E3779B97F4A7C15))
        who, what, steps, apart = [], [], np.zeros(len(at), np.int64), {}
        long = np.array([len(c) > LONGEST for c in chunks])
        for c in np.flatnonzero(long):
            whose = np.flatnonzero(at == c)
            apart.update(zip(whose.tolist(), self.long_chunk(chunks[c], seed[whose])))
        for i, got in apart.items():
            steps[i] = len(got)
        left = np.flatnonzero(~long[at])
        place, rank = size[at[left]], rank[at[left]]
        step = 0
        while len(left):
            u = _chance(seed[left], step)
            node = base[place] + rank
            m = np.argmax(cum[node] > u[:, None], axis=1)
            who.append(left.astype(np.int32)), what.append(ids[node, m])
            steps[left] += 1
            place = place - m - 1
            more = place > 0
            left, place, rank = left[more], place[more], rank[more]
            step += 1
        stop = np.cumsum(steps)
        out = np.empty(stop[-1], np.int64)
        for s, (w, p) in enumerate(zip(who, what)):
            out[stop[w] - 1 - s] = p
        for i, got in apart.items():
            out[stop[i] - len(got) : stop[i]] = got[::-1]
        ends_at = np.concatenate(([0], stop))[ends]
        wide = np.flatnonzero(out >= BYTES_OF)
        if len(wide):
            runs = [[self.byte[b] for b in chr(x - BYTES_OF).encode()] for x in out[wide]]
            more = np.array([len(r) for r in runs])
            width = np.ones(len(out), np.int64)
            width[wide] = more
            full = np.repeat(out, width)
            start = np.cumsum(width)[wide] - more
            for i, r in zip(start, runs):
                full[i : i + len(r)] = r
            ends_at = np.concatenate(([0], np.cumsum(width)))[ends_at]
            out = full
        return out.astype(np.int32), ends_at

    def spelled(self, ids: np.ndarray | list[int]) -> Iterator[bytes]:
        """What the pieces stand for, a leading space included, part by part."""
        ids = np.asarray(ids, np.int32)
        for a in range(0, len(ids), TOGETHER):
            yield b"".join(map(self.text.__getitem__, ids[a : a + TOGETHER].tolist()))

    def decode(self, ids: np.ndarray | list[int]) -> str:
        return b"".join(self.spelled(ids))[1:].decode("utf-8", "replace")

    def spells(self, ids: np.ndarray | list[int], text: str) -> bool:
        """Whether decode() gives ``text``."""
        want, at = (" " + text).encode() if text else b"", 0
        for part in self.spelled(ids):
            if not want.startswith(part, at):
                return False
            at += len(part)
        return at == len(want)


_kept: dict[int, Lattice] = {}


def _lattice(model: bytes, sharpness: float) -> Lattice:
    """One for each worker."""
    if (key := hash((model, sharpness))) not in _kept:
        _kept[key] = Lattice(model, sharpness)
    return _kept[key]


def _sent(df: DataFrame, model: str):
    """The model, read on the driver (0.5 MB), for every task."""
    with open(model, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "pieces", model: str = MODEL, seed: int = SEED, sharpness: float = SHARPNESS, check: str | None = None) -> DataFrame:
    """``docs`` with the column ``out``: the ids of the pieces of a sampled segmentation; ``check`` names a column that says
    whether they were decoded to the text again."""
    sent = _sent(docs, model)
    kept = [c for c in docs.columns if c not in (out, check)]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.xxhash64(F.lit(seed), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))).alias("__sp_key"))
    added = [T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(check, T.BooleanType())] if check else [])]
    schema = T.StructType([docs.schema[c] for c in kept] + added)
    i_text = kept.index(text)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        lattice = _lattice(sent.value, sharpness)
        for part in parts:
            for at in batches(part.column(i_text), 1 << 20, lambda t: len(t.as_py() or "")):
                piece = part.slice(at.start, at.stop - at.start)
                texts = piece.column(i_text).to_pylist()
                ids, ends = lattice.encode([t or "" for t in texts], piece.column(piece.num_columns - 1).to_numpy().view(U))
                ends = np.append(0, ends)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append([t is None for t in texts], False)), pa.array(ids))
                columns = [*piece.columns[:-1], lists]
                if check:
                    columns.append(pa.array([t is None or lattice.spells(ids[a:b], t) for t, a, b in zip(texts, ends[:-1], ends[1:])]))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, pieces: str = "pieces", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``df`` with the column ``out``: the text that the ids in ``pieces`` stand for."""
    sent = _sent(df, model)
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.StringType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(sent.value, SHARPNESS)
        for part in parts:
            column = part.column(kept.index(pieces))
            for at in batches(column, 1 << 20, lambda p: len(p) if p.is_valid else 0):
                texts = [lattice.decode(p.values.to_numpy()) if p.is_valid else None for p in column[at]]
                yield pa.RecordBatch.from_arrays([*part.slice(at.start, len(texts)).columns, pa.array(texts, pa.string())], schema.names)

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)
