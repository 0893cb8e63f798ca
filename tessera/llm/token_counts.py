"""Token counts as an exact histogram of encoded lengths.

Each text is encoded once, as ordinary text, where it lies; only its length goes on, and the counts by length are
written once for all that is asked of them. Documents are counted by length,
and sums from the right over the histogram answer, for a context limit at any length: how many documents and tokens lie
beyond, what total is left if each text is cut there, which share of documents fits. The sums are taken in two levels
(blocks of lengths, then within a block), so no task sees the whole histogram.

Nulls and edges: a null text counts as an empty one, of length 0; repeated rows count each time; very long texts are
encoded whole, in some ten times their bytes of memory; no other column is looked at. An empty table gives an empty
histogram. A run of LONG or more white-space characters, on which the encoder's pattern would overflow its stack, is cut
out as the pattern itself would cut it, and goes to the encoder as the one piece that it is.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

#: Ranks of a public byte-level BPE, in tiktoken's format.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 1024
#: White-space characters in a row that are given to the encoder as a piece of their own.
LONG = 100_000
#: White space of the encoder's pattern.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_encodings: dict[int, object] = {}


def _encoding(ranks: bytes, pattern: str):
    """One encoder for each worker."""
    import tiktoken

    if (key := hash((ranks, pattern))) not in _encodings:
        of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encodings[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=of, special_tokens={})
    return _encodings[key]


def encoded_length(encoding, text: str, long: int = LONG) -> int:
    """Tokens of ``text``. Of a run of white space before other text, the pattern leaves the last character to the next piece."""
    n = done = 0
    for run in re.finditer(f"[{WHITE}]{{{long},}}", text) if len(text) >= long else ():
        a, b = run.span()
        last = int(b < len(text))
        n += len(encoding.encode_ordinary(text[done:a])) + (len(encoding._encode_single_piece(text[a : b - last])) if b - last > a else 0)
        done = b - last
    return n + len(encoding.encode_ordinary(text[done:]))


def encoded_lengths(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """(n_tokens): the length of each row's encoded text. ``vocabulary`` is read on the driver and broadcast (0.8 MB)."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks.value, pattern)
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([encoded_length(encoding, t) if t else 0 for t in part.column(0).to_pylist()], pa.int64())], ["n_tokens"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "n_tokens bigint")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, docs, docs_over, tokens, tokens_over, total, truncated_total, fit_share), one row for each length L that occurs.

    docs: of length L; docs_over: longer; tokens: in the documents of length L; tokens_over: in longer ones; total: in
    all; truncated_total: what is left if each text is cut at L; fit_share: share of documents of length L at most.
    """
    counts = staged(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))).withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    blocks = counts.groupBy("block").agg(F.sum("docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.partitionBy(F.lit(1)).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in ("bd", "bt")], *[F.sum(c).over(every).alias(f"{c}_all") for c in ("bd", "bt")])
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c, after: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(after)
    out = counts.join(blocks, "block").withColumn("docs_over", over("docs", "bd_after")).withColumn("tokens_over", over("tokens", "bt_after"))
    return out.select(
        "n_tokens", "docs", "docs_over", "tokens", "tokens_over", F.col("bt_all").alias("total"),
        (F.col("bt_all") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_total"),
        (1 - F.col("docs_over") / F.col("bd_all")).alias("fit_share"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_over, tokens_over, truncated_total, total) for each context limit, whether or not a text has that length."""
    spark: SparkSession = hist.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(int(x),) for x in limits], "context bigint"))
    short, long = F.col("n_tokens") <= F.col("context"), F.col("n_tokens") > F.col("context")
    sums = wanted.join(hist, F.lit(True), "left").groupBy("context").agg(
        F.coalesce(F.sum(F.when(long, F.col("docs"))), F.lit(0)).alias("docs_over"), F.coalesce(F.sum(F.when(long, F.col("tokens"))), F.lit(0)).alias("tokens_over"),
        F.coalesce(F.sum(F.when(short, F.col("tokens"))), F.lit(0)).alias("kept"), F.coalesce(F.max("total"), F.lit(0)).alias("total"),
    )
    return sums.select("context", "docs_over", "tokens_over", (F.col("kept") + F.col("context") * F.col("docs_over")).alias("truncated_total"), "total")


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of the documents does not exceed."""
    wanted = F.broadcast(hist.sparkSession.createDataFrame([(float(x),) for x in shares], "share double"))
    return wanted.join(hist, F.col("fit_share") >= F.col("share") - 1e-12, "left").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
