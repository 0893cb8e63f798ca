"""Secret scans: fixed patterns, and a battery of randomness tests with control of false discoveries; SQL functions only.

Patterns, each leftmost and non-overlapping by itself: an assignment of 8 or more characters to a word such as
``password`` or ``api_key``; an access key id of 16 or more characters; 32 or more lower-case hexadecimal digits.

The battery looks at tokens of MIN_TOKEN or more characters of the base-64 alphabets, joined by nothing else. Each
token's encoding is inferred (hexadecimal, base 32, base 64), its characters become numbers, and three tests of uniform,
independent numbers follow: chi-squared of the counts against a uniform alphabet, runs above and below the middle, and
correlation of each number with the next. The Cauchy combination of the three p-values is the token's randomness.
The reference for what isn't random is the running text of all documents: the letters of each whole text that stand in no
such token, one after the other, cut into stretches whose lengths are REFERENCE (fewer than 28 letters at the end of a
text are left over). Every stretch is tested as a token is, and counted by randomness within its class of length, which
gives every token an empirical p-value against "as ordinary words are". Benjamini-Hochberg at ALPHA over all tokens
decides; classes of longer tokens, where the tests tell more, weigh in proportion to length (the weights average 1 over
the tokens, so the control holds).
Those that pass are spans of kind ``random``. Counts are kept by cell (class, randomness bin), of which there is a fixed
number, so what is broadcast does not grow with the data.

Nulls and edges: a null text is scanned as an empty one; each row of ``docs`` gives one row, repeated rows too, if they
come from a table that is read in the same order each time; very long texts are scanned whole; other columns play no
part. An empty table gives an empty one. Positions count code points, from 0, the end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: The patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

MIN_TOKEN, ALPHA, BINS, CLASSES = 20, 0.01, 64, 4
#: A length within each class of lengths 20-39, 40-79, 80-159 and 160 or more.
REFERENCE = (28, 56, 112, 224)
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: What is no running text: tokens, and all but letters.
ASIDE = rf"{TOKEN}|[^A-Za-z0-9+/_-]+|[0-9+/_-]+"

#: The alphabets in the order of their digits.
HEX_LOWER, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BASE64_URL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often it stands in the body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def upper_tail(z: Column) -> Column:
    """1 - Phi(z) by the rational approximation 26.2.17 of Abramowitz and Stegun, in nested form; error below 1e-7."""
    poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))

    def tail(z: Column) -> Column:
        side = let(1 / (1 + 0.2316419 * F.abs(z)), poly) * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        return F.when(z >= 0, side).otherwise(1 - side)

    return let(z, tail)


def randomness(token: Column) -> Column:
    """Struct (alphabet, p): the size of the inferred alphabet and the combined p-value of the three tests."""
    digits = (
        F.when(token.rlike(r"^[0-9a-f]+$"), F.lit(HEX_LOWER)).when(token.rlike(r"^[0-9A-F]+$"), F.lit(HEX_UPPER)).when(token.rlike(r"^[A-Z2-7]+$"), F.lit(BASE32))
        .when(token.rlike(r"[-_]"), F.lit(BASE64_URL)).otherwise(F.lit(BASE64))
    )
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)
    without = lambda s, part: F.length(F.replace(s, part, F.lit(""))).cast("double")

    def letters(digits: Column) -> Column:
        # a character outside the inferred alphabet (both kinds of base 64 mixed) counts as its last digit
        s = F.when(digits == BASE64_URL, F.translate(token, "+/", "__")).otherwise(token)
        return F.struct(digits.alias("digits"), s.alias("s"), F.split(s, "").alias("chars"), F.length(digits).cast("double").alias("a"), F.length(s).cast("double").alias("n"))

    def numbers(t: Column) -> Column:
        place = lambda c: (F.instr(t["digits"], c) - 1).cast("double")
        bits = F.when(t["a"] == 16, "0" * 8 + "1" * 8).when(t["a"] == 32, "0" * 16 + "1" * 16).otherwise("0" * 32 + "1" * 32)
        return F.struct(
            t["a"].alias("a"), t["n"].alias("n"), F.call_function("translate", t["s"], t["digits"], bits).alias("high"), F.transform(t["chars"], place).alias("x"),
            F.transform(F.array_distinct(t["chars"]), lambda c: F.struct(place(c).alias("v"), (t["n"] - without(t["s"], c)).alias("m"))).alias("counts"),
        )

    def sums(t: Column) -> Column:
        step = lambda acc, v: F.struct(v.alias("last"), (acc["sum"] + acc["last"] * v).alias("sum"))
        changes = t["n"] - (without(t["high"], F.lit("01")) + without(t["high"], F.lit("10"))) / 2
        return F.struct(
            t["a"].alias("a"), t["n"].alias("n"), (F.element_at(t["x"], 1) + F.element_at(t["x"], -1)).alias("ends"),
            (t["n"] - without(t["high"], F.lit("1"))).alias("n1"), (1 + changes).alias("runs"),
            total(F.transform(t["counts"], lambda c: c["m"] * c["m"])).alias("squares"),
            total(F.transform(t["counts"], lambda c: c["v"] * c["m"])).alias("sx"),
            total(F.transform(t["counts"], lambda c: c["v"] * c["v"] * c["m"])).alias("sxx"),
            F.aggregate(t["x"], F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"]).alias("sxy"),
        )

    def moments(t: Column) -> Column:
        a, n, m = t["a"], t["n"], t["sx"] / t["n"]
        return F.struct(
            a.alias("a"), n.alias("n"), F.greatest(a / n * t["squares"] - n, F.lit(0.0)).alias("chi"),
            t["runs"].alias("runs"), (2 * t["n1"] * (n - t["n1"]) / n + 1).alias("mean"),
            (t["sxx"] - n * m * m).alias("c0"), (t["sxy"] - m * (2 * t["sx"] - t["ends"]) + (n - 1) * m * m).alias("c1"),
        )

    def scores(t: Column) -> Column:
        k, n, mean = t["a"] - 1, t["n"], t["mean"]
        z1 = (F.pow(t["chi"] / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
        z2 = let((mean - 1) * (mean - 2) / (n - 1), lambda var: F.when(var > 0, F.abs(t["runs"] - mean) / F.sqrt(var)).otherwise(F.lit(8.0)))
        z3 = F.when(t["c0"] > 0, F.abs(t["c1"] / t["c0"]) * F.sqrt(n)).otherwise(F.lit(8.0))
        ps = F.transform(F.array(upper_tail(z1), 2 * upper_tail(z2), 2 * upper_tail(z3)), lambda p: F.tan((0.5 - F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-15), p))) * math.pi))
        return F.struct(t["a"].cast("int").alias("alphabet"), F.greatest(F.lit(1e-15), 0.5 - F.atan(total(ps) / 3) / math.pi).alias("p"))

    return let(let(let(let(let(digits, letters), numbers), sums), moments), scores)


def _matches(text: Column, pattern: str, groups: int = 0) -> Column:
    """Array of (gap, hit, own): each match with the code points between it and the one before; own: its last group."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = F.regexp_extract_all(text, F.lit(pattern), F.lit(groups)) if groups else hits
    rows = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), own.alias("own")), lambda m: F.struct(m["gap"].alias("gap"), m["hit"].alias("hit"), m["own"].alias("own")))
    return F.when(text.rlike(pattern), rows)


def _reference(text: Column) -> Column:
    """The running text in stretches: whole rounds of the lengths REFERENCE, then what is left, longest first."""
    starts = [1 + sum(REFERENCE[:i]) for i in range(len(REFERENCE))]
    cuts = "|".join(f".{{{n}}}" for n in (sum(REFERENCE), *reversed(REFERENCE)))
    parts = F.regexp_extract_all(F.regexp_replace(text, ASIDE, ""), F.lit(cuts), F.lit(0))
    each = lambda p: F.when(F.length(p) == sum(REFERENCE), F.array(*[F.substr(p, F.lit(i), F.lit(n)) for i, n in zip(starts, REFERENCE)])).otherwise(F.array(p))
    return F.flatten(F.transform(parts, each))


def _cell(p: Column, n: Column) -> tuple[Column, Column]:
    """Class (doubling of length) and bin of randomness (0: most random)."""
    return F.least(F.lit(CLASSES - 1), F.floor(F.log2(n / MIN_TOKEN)).cast("int")), F.least(F.lit(BINS - 1), F.floor(-4 * F.log10(p)).cast("int"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """(rid, key, spans): a row for each row of ``docs``; spans: array of (start, kind_no, end, kind) in order."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = F.array(
        F.struct(F.lit(0).alias("kind"), _matches(body, ASSIGN, 2).alias("m")),
        F.struct(F.lit(1).alias("kind"), _matches(body, ACCESS).alias("m")),
        F.struct(F.lit(2).alias("kind"), _matches(body, HEX).alias("m")),
        F.struct(F.lit(3).alias("kind"), _matches(body, TOKEN).alias("m")),
    )
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{key}`").alias("key"), F.filter(found, lambda x: x["m"].isNotNull()).alias("f"))
    rows = rows.select("rid", "key", F.explode_outer("f").alias("f")).select("rid", "key", "f.kind", F.posexplode_outer("f.m").alias("pos", "m"))
    token = F.col("kind") == 3
    rows = rows.select("rid", "key", "kind", "pos", "m.gap", F.length("m.hit").alias("n"), F.length("m.own").alias("own"), F.when(token, F.col("m.hit")).alias("token"))
    tested = rows.withColumn("t", F.when(F.col("token").isNotNull(), randomness(F.col("token"))))
    cls, b = _cell(F.col("t.p"), F.col("n"))
    tested = tested.select("rid", "key", "kind", "pos", "gap", "n", "own", F.when(token, cls).alias("cls"), F.when(token, b).alias("bin"))
    tested = staged(tested)

    stretches = docs.select(F.explode(_reference(body)).alias("s")).select(F.length("s").alias("n"), randomness(F.col("s")).alias("t"))
    ordinary = stretches.groupBy(cls.alias("cls"), b.alias("bin")).agg(F.count(F.lit(1)).alias("words"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("chars"))
    tokens = tested.where("kind = 3").groupBy("cls", "bin").agg(F.lit(0).cast("bigint").alias("words"), F.count(F.lit(1)).alias("n"), F.sum("n").alias("chars"))
    cells = staged(ordinary.unionByName(tokens).groupBy("cls", "bin").agg(F.sum("words").alias("words"), F.sum("n").alias("n"), F.sum("chars").alias("chars")))
    # CLASSES * BINS rows at most from here on
    by_class = Window.partitionBy("cls")
    cells = cells.withColumn("p0", (1 + F.sum("words").over(by_class.orderBy("bin"))) / (1 + F.sum("words").over(by_class)))
    all_cells = Window.partitionBy(F.lit(1))
    cells = cells.withColumn("weight", F.sum("chars").over(by_class) / F.sum("n").over(by_class) / (F.sum("chars").over(all_cells) / F.sum("n").over(all_cells)))
    cells = cells.where("n > 0").withColumn("q", F.col("p0") / F.col("weight"))
    ordered = Window.partitionBy(F.lit(1)).orderBy("q").rangeBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("ok", F.col("q") <= alpha * F.sum("n").over(ordered) / F.sum("n").over(all_cells))
    chosen = cells.withColumn("cut", F.max(F.when(F.col("ok"), F.col("q"))).over(all_cells)).where("q <= cut").select("cls", "bin", F.lit(True).alias("found"))

    judged = tested.join(F.broadcast(chosen), ["cls", "bin"], "left")
    by_kind = Window.partitionBy("rid", "kind").orderBy("pos")
    end = F.sum(F.col("gap") + F.col("n")).over(by_kind.rowsBetween(Window.unboundedPreceding, 0))
    placed = judged.repartition("rid").withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))
    good = F.when(F.col("kind") == 0, F.col("own") >= 8).when(F.col("kind") == 3, F.coalesce("found", F.lit(False))).otherwise(F.col("kind") < 3)
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.when(good, F.struct(F.col("start"), F.col("kind").alias("kind_no"), F.col("end"), name.alias("kind")))
    return placed.groupBy("rid").agg(F.first("key").alias("key"), F.array_sort(F.collect_list(span)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
