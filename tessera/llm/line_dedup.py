"""Line dedup by winnowing over line hashes.

A unit is a line with something other than white space in it; blank lines are kept and never compared. (1) Each text
becomes its lines' hashes and numbers of words, once. (2) Over the hashes of grams of ``gram`` lines, the minimum of
every ``window`` neighbours is a fingerprint, so that two copies of any run of ``gram + window - 1`` lines have one in
common; a shorter run of ``min_words`` words or more is a fingerprint as a whole. Fingerprints that one place only has
end here. (3) From the places of the others, the window's runs that pass through are compared with the earliest place
that holds the same run; runs that overlap chain, which extends each match in both directions as far as it goes.
(4) Lines covered by a run that an earlier place holds are deleted; the first stays.

A run counts if it has ``gram + window - 1`` lines, or fewer that have ``min_words`` words or more together, however
they fall on lines. Places are ordered by (key, hash of the text, line).

Nulls and edges: a null text stays null and has no lines; an empty text stays empty; rows equal in key and text are one
document and get the same result; a null key sorts first; very long texts take time in proportion to their lines.
Columns beside key and text are kept as they are, but those named like an added column. An empty table gives an empty
table.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, small_or_shuffled, staged

#: The operator's own columns carry this prefix, so that none of the caller's can clash.
P = "__ld_"
RUN = "array<struct<start:int,size:int,fp:bigint,at:int>>"


def is_unit(line: Column) -> Column:
    return line.rlike(r"\S")


def _key(docs: DataFrame, key: str, text: str) -> Column:
    return F.struct(F.col(f"`{key}`").alias("k"), F.xxhash64(f"`{text}`").alias("t"))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(rid, h, h2, words): two hashes and the number of words of each unit, in order."""
    units = F.filter(F.split(F.col(f"`{text}`"), "\n", -1), is_unit)
    rows = docs.where(F.col(f"`{text}`").isNotNull()).select(_key(docs, key, text).alias("rid"), units.alias("u")).where(F.size("u") > 0)
    return rows.select(
        "rid",
        F.transform("u", lambda x: F.xxhash64(x)).alias("h"),
        F.transform("u", lambda x: F.xxhash64(F.lit(7), x)).alias("h2"),
        F.transform("u", lambda x: F.regexp_count(x, F.lit(r"\S+"))).alias("words"),
    )


def _runs(lines: DataFrame, gram: int, window: int, min_words: int) -> DataFrame:
    """(rid, h, h2, r): each run that counts, r being its start, size, fingerprint and the line ``at`` which that stands."""
    t = gram + window - 1
    n, none = F.size("h"), F.array().cast(RUN)
    grams = F.when(n >= gram, F.transform(F.sequence(F.lit(0), n - gram), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(gram)])))
    lines = lines.withColumn("grams", grams)

    def minimum(i: Column) -> Column:
        low = F.least(*[F.get("grams", i + k) for k in range(window)])
        place = reduce(lambda rest, k: F.when(F.get("grams", i + k) == low, i + k).otherwise(rest), range(window - 1, -1, -1), i)
        return F.struct(i.alias("start"), F.lit(t).alias("size"), low.alias("fp"), place.alias("at"))

    total = lambda i, m: reduce(add, [F.get("words", i + k) for k in range(m)])
    short = lambda m: F.transform(
        F.filter(F.sequence(F.lit(0), n - m), lambda i: total(i, m) >= min_words),
        lambda i: F.struct(i.alias("start"), F.lit(m).alias("size"), F.xxhash64(F.lit(m), *[F.get("h", i + k) for k in range(m)]).alias("fp"), i.alias("at")),
    )
    long = F.when(n >= t, F.transform(F.sequence(F.lit(0), n - t), minimum)).otherwise(none)
    runs = F.concat(long, *[F.when(n >= m, short(m)).otherwise(none) for m in range(1, t)])
    return lines.select("rid", "h", "h2", F.explode(runs).alias("r"))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = 2, window: int = 2, min_words: int = 40, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(rid, lines): by document, the lines to delete as positions from 0 among its lines that aren't blank."""
    lines = staged(_lines(docs, key, text))
    runs = _runs(lines, gram, window, min_words)
    # a place is known by a hash of document and line; one that has several runs counts once
    place = F.xxhash64("rid", "r.at")
    shared = staged(runs.groupBy(F.col("r.fp").alias("fp")).agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("fp"))
    content = lambda h: F.xxhash64(F.col("r.size"), F.slice(h, F.col("r.start") + 1, F.col("r.size")))
    each = runs.select("rid", "r.start", "r.size", "r.fp", F.struct(content("h").alias("a"), content("h2").alias("b")).alias("g"))
    at_shared = staged(each.join(small_or_shuffled(shared, shared.count(), broadcast_rows), "fp", "left_semi").select("rid", "start", "size", "g").distinct())
    drop_staged(lines, shared)
    first = at_shared.groupBy("g").agg(F.min(F.struct("rid", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = at_shared.join(first, "g").where(F.struct("rid", "start") > F.col("first"))
    gone = later.select("rid", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("line"))
    found = staged(gone.groupBy("rid").agg(F.collect_set("line").alias("lines")))
    drop_staged(at_shared)
    return found


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often it stands in the body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, gone: Column) -> Column:
    """``text`` without the units numbered in ``gone``; each line is looked at once."""

    def rest(lines: Column) -> Column:
        units = F.array_compact(F.transform(lines, lambda x, i: F.when(is_unit(x), i)))
        drop = let(units, lambda u: F.transform(gone, lambda k: F.get(u, k)))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    return let(F.split(text, "\n", -1), rest)


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = 2, window: int = 2, min_words: int = 40) -> DataFrame:
    """``docs`` with the later repeated runs of lines deleted from ``text``; ``lines_before`` and ``lines_removed`` are
    added, and stand for those names if ``docs`` has them."""
    rid, gone = f"{P}rid", f"{P}gone"
    found = repeated_lines(docs, key, text, gram, window, min_words).select(F.col("rid").alias(rid), F.col("lines").alias(gone))
    body = F.col(f"`{text}`")
    # sorted on both sides at every size: what is found grows with the documents
    out = docs.withColumn(rid, _key(docs, key, text)).join(found.hint("merge"), rid, "left")
    counts = {
        "lines_before": F.coalesce(F.size(F.filter(F.split(body, "\n", -1), is_unit)), F.lit(0)),
        "lines_removed": F.coalesce(F.size(gone), F.lit(0)),
    }
    kept = [F.when(F.col(gone).isNull(), body).otherwise(_without(body, F.col(gone))).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c not in counts]
    return out.select(*kept, *[v.alias(k) for k, v in counts.items()])


#: Whole documents, production parameters. Runs are compared as text here.
SQL = r"""
with units as (
  select doc_id, line, len(regexp_extract_all(line, '\S+')) as words,
         row_number() over (partition by doc_id order by pos) - 1 as i
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null)
  where length(regexp_replace(line, '\s+', '', 'g')) > 0
),
near as (
  select doc_id, i, line, words,
         lead(line, 1) over w as l1, words + lead(words, 1) over w as both_words,
         lead(line, 2) over w as l2
  from units window w as (partition by doc_id order by i)
),
runs as (
  select doc_id, i, 1 as size, line as g from near where words >= 40
  union all select doc_id, i, 2, line || chr(10) || l1 from near where l1 is not null and both_words >= 40
  union all select doc_id, i, 3, line || chr(10) || l1 || chr(10) || l2 from near where l2 is not null
),
later as (
  select doc_id, i, size from (
    select *, row_number() over (partition by size, g order by doc_id, i) as rn from runs
  ) where rn > 1
),
gone as (select distinct doc_id, i + unnest(range(size)) as i from later)
select d.doc_id, coalesce(u.n, 0)::int as lines_before, coalesce(g.n, 0)::int as lines_removed,
       sha256(coalesce(k.kept, '')) as kept_sha256
from documents d
left join (select doc_id, count(*) n from units group by 1) u using (doc_id)
left join (select doc_id, count(*) n from gone group by 1) g using (doc_id)
left join (
  select doc_id, string_agg(line, chr(10) order by i) kept from units anti join gone using (doc_id, i) group by 1
) k using (doc_id)
"""
