"""Queries for measurements, with line items as pixels of the frame of their supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import measure as M
from .registry import query
from .views import sql, view

K = ["frame_id"]
Y = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"


def px(s, d):
    return view(s, d, "pixels")


def rounded(df, *keys, n=9):
    return df.select(*keys, *[F.round(c, n).alias(c) if t == "double" else c for c, t in df.dtypes if c not in keys])


HSV = "hv as (select *, greatest(r, g, b) as val, greatest(r, g, b) - least(r, g, b) as dd from pixels), hs as (select *, case when dd = 0 then 0.0 when val = r then case when g < b then (g - b) / dd + 6 else (g - b) / dd end when val = g then (b - r) / dd + 2 else (r - g) / dd + 4 end * 60 as hue, coalesce(dd / nullif(val, 0), 0.0) as sat from hv)"
LIN = "ln as (select *, {r} as lr, {g} as lg, {b} as lb from pixels)".format(**{c: f"case when {c} <= 0.04045 then {c} / 12.92 else pow(({c} + 0.055) / 1.055, 2.4) end" for c in "rgb"})
XYZ = f"{LIN}, xz as (select *, 0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb as cx, 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb as cy, 0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb as cz from ln)"
FF = lambda c, w: f"case when {c} / {w} > 216.0 / 24389 then cbrt({c} / {w}) else (24389.0 / 27 * ({c} / {w}) + 16) / 116 end"
LAB = f"{XYZ}, ff as (select *, {FF('cx', 0.95047)} as fx, {FF('cy', 1.0)} as fy, {FF('cz', 1.08883)} as fz from xz), lab as (select *, 116 * fy - 16 as lab_l, 500 * (fx - fy) as lab_a, 200 * (fy - fz) as lab_b from ff)"


@query("c1_hsv", sql(f"with {HSV} select frame_id, count(*) as n, round(avg(hue), 9) as hue, round(avg(sat), 9) as sat, round(avg(val), 9) as val from hs group by 1", "pixels"))
def c1(s, d):
    return rounded(M.with_hsv(px(s, d)).groupBy(*K).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("hue", "sat", "val")]), *K)


@query("c2_channel_stats", sql("select frame_id, count(r) as n, round(avg(r), 9) as mean, round(var_pop(r), 9) as variance, min(r) as low, max(r) as high, round(stddev_pop(r), 9) as std, round(quantile_cont(r, 0.05), 9) as p5, round(quantile_cont(r, 0.5), 9) as median, round(quantile_cont(r, 0.95), 9) as p95 from pixels group by 1", "pixels"))
def c2(s, d):
    return rounded(M.channel_stats(px(s, d), K, "r"), *K)


HIST = "hh as (select frame_id, least(15, floor(r * 16))::int as bin, count(*) as n from pixels group by all), hist as (select *, n / sum(n) over (partition by frame_id) as p, sum(n) over (partition by frame_id order by bin) / sum(n) over (partition by frame_id) as cdf from hh)"


@query("c3_hist", sql(f"with {HIST} select frame_id, bin, n, round(p, 9) as p, round(cdf, 9) as cdf from hist", "pixels"))
def c3(s, d):
    return rounded(M.hist(px(s, d), K, "r", 16), *K)


@query("c3_entropy", sql(f"with {HIST} select frame_id, round(-sum(p * log2(p)), 9) as entropy from hist group by 1", "pixels"))
def c3b(s, d):
    return rounded(M.entropy(M.hist(px(s, d), K, "r", 16), K), *K)


@query("c3_cdf_percentile", sql(f"with {HIST} select frame_id, round((min(bin) + 0.5) / 16, 9) as value from hist where cdf >= 0.9 - 1e-12 group by 1", "pixels"))
def c3c(s, d):
    return rounded(M.cdf_percentile(M.hist(px(s, d), K, "r", 16), K, 0.9, 16), *K)


@query("c4_hist_shape", sql("with m as (select frame_id, avg(r) as m from pixels group by 1) select frame_id, round(avg(pow(r - m, 3)) / pow(var_pop(r), 1.5), 9) as skew, round(avg(pow(r - m, 4)) / pow(var_pop(r), 2) - 3, 9) as kurtosis, round(quantile_cont(r, 0.95) - quantile_cont(r, 0.05), 9) as spread from pixels join m using (frame_id) group by 1", "pixels"))
def c4(s, d):
    return rounded(M.hist_shape(px(s, d), K, "r"), *K)


@query("c5_circular_mean", sql(f"with {HSV}, a as (select frame_id, sum(sat * cos(radians(hue))) as c, sum(sat * sin(radians(hue))) as s, sum(sat) as w from hs group by 1) select frame_id, round((degrees(atan2(s, c)) + 360) % 360, 9) as mean, round(1 - sqrt(c * c + s * s) / w, 9) as variance from a", "pixels"))
def c5(s, d):
    return rounded(M.circular_mean(M.with_hsv(px(s, d)), K, "hue", F.col("sat")), *K)


def hue_hist(bins: int) -> str:
    """hh (frame_id, bin, p): shares of equal bins of hue."""
    return f"{HSV}, hn as (select frame_id, least({bins - 1}, floor(hue / 360.0 * {bins}))::int as bin, count(*) as n from hs where hue between 0 and 360 group by 1, 2), hh as (select frame_id, bin, n / sum(n) over (partition by frame_id) as p from hn)"


PEAKS = f"""
with {hue_hist(12)},
filled as (select frame_id, bin, coalesce(p, 0.0) as p from (select distinct frame_id from hh) cross join (select unnest(range(12))::int as bin) left join hh using (frame_id, bin)),
near as (
  select f.frame_id, f.bin, f.p, b.p as before, a.p as after
  from filled f join filled b on b.frame_id = f.frame_id and b.bin = (f.bin + 11) % 12 join filled a on a.frame_id = f.frame_id and a.bin = (f.bin + 1) % 12
)
select frame_id, bin, round(p, 9) as p, rank from (
  select *, row_number() over (partition by frame_id order by p desc, bin) as rank from near where p >= before and p >= after and (p > before or p > after)
) where rank <= 3
"""


@query("c6_hue_peaks", sql(PEAKS.strip(), "pixels"))
def c6(s, d):
    return rounded(M.hue_peaks(M.hist(M.with_hsv(px(s, d)), K, "hue", 12, 0.0, 360.0), K, 12), *K)


@query("c7_lab_summary", sql(f"with {LAB} select frame_id, " + ", ".join(f"round(avg({c}), 9) as mean_{c}, round(stddev_pop({c}), 9) as std_{c}" for c in ("lab_l", "lab_a", "lab_b")) + ", round(avg(sqrt(lab_a * lab_a + lab_b * lab_b)), 9) as chroma from lab group by 1", "pixels"))
def c7(s, d):
    return rounded(M.lab_summary(px(s, d), K), *K)


@query("c8_exposure", sql(f"with y as (select frame_id, {Y} as y from pixels), e as (select frame_id, avg((y < 0.25)::int) as shadows, avg((y between 0.25 and 0.75)::int) as mids, avg((y > 0.75)::int) as highs, avg((y <= 0.02)::int) as crushed, avg((y >= 0.98)::int) as blown, quantile_cont(y, 0.5) as median from y group by 1) select frame_id, round(shadows, 9) as shadows, round(mids, 9) as mids, round(highs, 9) as highs, round(crushed, 9) as crushed, round(blown, 9) as blown, round(median, 9) as median, round(ln(0.5) / ln(least(0.99, greatest(0.01, median))), 9) as gamma from e", "pixels"))
def c8(s, d):
    return rounded(M.exposure(px(s, d), K), *K)


@query("c9_contrast", sql(f"with y as (select frame_id, {Y} as y from pixels) select frame_id, round(stddev_pop(y), 9) as rms, round((max(y) - min(y)) / (max(y) + min(y)), 9) as michelson, round(quantile_cont(y, 0.95) - quantile_cont(y, 0.05), 9) as span, round(log2(greatest(quantile_cont(y, 0.95), 1e-4) / greatest(quantile_cont(y, 0.05), 1e-4)), 9) as stops from y group by 1", "pixels"))
def c9(s, d):
    return rounded(M.contrast(px(s, d), K), *K)


@query("c10_white_balance", sql("with pm as (select frame_id, avg(r) as r, avg(g) as g, avg(b) as b from pixels group by 1), " + XYZ.replace("from pixels)", "from pm)") + ", n as (select *, (cx / (cx + cy + cz) - 0.3320) / (0.1858 - cy / (cx + cy + cz)) as n from xz) select frame_id, round(g / r, 9) as gain_r, round(g / b, 9) as gain_b, round(449 * pow(n, 3) + 3525 * pow(n, 2) + 6823.3 * n + 5520.33, 3) as kelvin, round(g - (r + b) / 2, 9) as tint from n", "pixels"))
def c10(s, d):
    return rounded(M.white_balance(px(s, d), K), *K).withColumn("kelvin", F.round("kelvin", 3))


@query("c11_tone_curve", sql(f"with y as (select frame_id, {Y} as y from pixels), q as (select frame_id, unnest(range(16))::int as i, unnest(quantile_cont(y, [{', '.join(f'{i}/15.0' for i in range(16))}])) as q from y group by frame_id) select frame_id, i, round(i / 15.0, 9) as p, round(q, 9) as q, round((coalesce(lead(q) over w, q) - coalesce(lag(q) over w, q)) * 15 / case when i in (0, 15) then 1 else 2 end, 9) as slope from q window w as (partition by frame_id order by i)", "pixels"))
def c11(s, d):
    return rounded(M.tone_curve(px(s, d), K, M.luminance()), *K)


@query("c12_colourfulness", sql("select frame_id, round(sqrt(var_pop(r - g) + var_pop((r + g) / 2 - b)) + 0.3 * sqrt(pow(avg(r - g), 2) + pow(avg((r + g) / 2 - b), 2)), 9) as colourfulness from pixels group by 1", "pixels"))
def c12(s, d):
    return rounded(M.colourfulness(px(s, d), K), *K)


@query("c13_zone_tints", sql(f"with z as (select frame_id, case when {Y} < 1.0 / 3 then 'shadows' when {Y} < 2.0 / 3 then 'mids' else 'highs' end as zone, r, g, b from pixels) select frame_id, zone, round(avg(r - g), 9) as red, round(avg(b - g), 9) as blue, round(count(*) / sum(count(*)) over (partition by frame_id), 9) as share from z group by 1, 2", "pixels"))
def c13(s, d):
    return rounded(M.zone_tints(px(s, d), K), *K, "zone")


@query("c14_mask_summary", sql(f"select frame_id, round(avg((r > g and g > b)::int), 9) as share, round(avg({Y}) filter (r > g and g > b), 9) as mean, round(stddev_pop({Y}) filter (r > g and g > b), 9) as spread, avg((r > g and g > b)::int) >= 0.005 as detected from pixels group by 1", "pixels"))
def c14(s, d):
    return rounded(M.mask_summary(px(s, d), K, (F.col("r") > F.col("g")) & (F.col("g") > F.col("b"))), *K)


def lloyd(rounds: int) -> str:
    """The rounds one after another; a frame whose centres hold still drops out."""
    away = " + ".join(f"(p.{c} - c.{c}) * (p.{c} - c.{c})" for c in "rgb")
    still = " and ".join(f"abs({c} - {c}0) <= 1e-4 + 1e-5 * abs({c}0)" for c in "rgb")
    return ",".join(
        f"""
a{t} as materialized (
  select frame_id, colour, count(*) as m, avg(r) as r, avg(g) as g, avg(b) as b from (
    select p.frame_id, p.r, p.g, p.b, list_min(list_transform(cs, lambda c: {{'d': floor(({away}) * 1e12 + 0.5), 'colour': c.colour}})).colour as colour
    from pixels p join (select frame_id, list({{'colour': colour, 'r': r, 'g': g, 'b': b}}) as cs from c{t} where not done group by 1) using (frame_id)
  ) group by 1, 2
),
c{t + 1} as materialized (
  select frame_id, colour, r, g, b, n, bool_and({still}) over (partition by frame_id) as done from (
    select c.frame_id, c.colour, coalesce(a.r, c.r) as r, coalesce(a.g, c.g) as g, coalesce(a.b, c.b) as b, c.r as r0, c.g as g0, c.b as b0, coalesce(m, 0) as n
    from c{t} c left join a{t} a using (frame_id, colour) where not done
  ) union all select * from c{t} where done
)"""
        for t in range(rounds)
    )


#: From the largest colour on, one near to a colour that stays gives its share to the first such.
PALETTE = f"""
with seeds as (
  select frame_id, (least(5, floor(r * 6)) * 6 + least(5, floor(g * 6))) * 6 + least(5, floor(b * 6)) as cell, count(*) as n, avg(r) as r, avg(g) as g, avg(b) as b
  from pixels group by 1, 2
),
c0 as materialized (
  select frame_id, row_number() over (partition by frame_id order by n desc, cell) as colour, r, g, b, 0::bigint as n, false as done
  from seeds qualify colour <= 6
),{lloyd(12)},
found as (select frame_id, list([{{'colour': colour, 'r': r, 'g': g, 'b': b, 'n': n}}] order by n desc, colour) as found from c12 where n > 0 group by 1),
merged as (
  select frame_id, unnest(list_reduce(found, lambda kept, x:
    case when len(list_filter(kept, lambda y: (y.r - x[1].r) * (y.r - x[1].r) + (y.g - x[1].g) * (y.g - x[1].g) + (y.b - x[1].b) * (y.b - x[1].b) < 0.06 * 0.06)) = 0 then list_append(kept, x[1])
         else list_transform(kept, lambda y: {{'colour': y.colour, 'r': y.r, 'g': y.g, 'b': y.b,
                'n': y.n + case when y.colour = list_filter(kept, lambda z: (z.r - x[1].r) * (z.r - x[1].r) + (z.g - x[1].g) * (z.g - x[1].g) + (z.b - x[1].b) * (z.b - x[1].b) < 0.06 * 0.06)[1].colour then x[1].n else 0 end}}) end)) as c
  from found
),
shares as (
  select frame_id, c.colour as seed, c.r as r, c.g as g, c.b as b, c.n as n, c.n / sum(c.n) over (partition by frame_id) as share,
         case when greatest(c.r, c.g, c.b) < 1e-6 then 0.0 else (greatest(c.r, c.g, c.b) - least(c.r, c.g, c.b)) / greatest(c.r, c.g, c.b) end as saturation
  from merged
),
palette as (
  select *, (row_number() over (partition by frame_id order by n desc, round(r * 0.2126 + g * 0.7152 + b * 0.0722, 9), seed))::int as colour,
         case when share >= 0.3 then 'dominant' when saturation >= 0.45 and share < 0.12 then 'accent' else 'secondary' end as role
  from shares
)
"""


@query("c17_palette", sql(f"{PALETTE.strip()} select frame_id, colour, round(r, 9) as r, round(g, 9) as g, round(b, 9) as b, round(share, 9) as share, round(saturation, 9) as saturation, role from palette", "pixels"))
def c17(s, d):
    return rounded(M.palette(px(s, d), K), *K)


@query("c19_grid_regions", sql(f"with c as (select frame_id, floor(x * 4 / 8.0) * 4 + floor(y * 4 / 16.0) as cell, avg({Y}) as m from pixels group by all) select frame_id, count(*) as cells, round(1 / (1 + stddev_pop(m)), 9) as uniformity from c group by 1", "pixels"))
def c19(s, d):
    return rounded(M.grid_regions(px(s, d), K, 4, 8, 16), *K)


@query("c20_joint_entropy", sql("with c as (select frame_id, least(7, floor(r * 8)) * 64 + least(7, floor(g * 8)) * 8 + least(7, floor(b * 8)) as code, count(*) as n from pixels group by all), p as (select frame_id, n / sum(n) over (partition by frame_id) as p from c) select frame_id, round(-sum(p * log2(p)), 9) as entropy from p group by 1", "pixels"))
def c20(s, d):
    return rounded(M.joint_entropy(px(s, d), K), *K)


@query("c24_assemble", "with p(param, lo, hi) as (values ('q', 5.0, 40.0), ('d', 0.02, 0.08)), l as (select l_orderkey as k, l_linenumber as i, l_suppkey as t, unnest(['q', 'd']) as param, unnest([l_quantity, l_discount]) as cur, unnest([l_quantity * 1.25, l_tax]) as rec from lineitem), c as (select k, i, t, param, round_even(least(hi, greatest(lo, cur)), 4) as current, round_even(least(hi, greatest(lo, rec)), 4) as recommended from l join p using (param)) select *, round_even(recommended - current, 4) + 0.0 as delta from c")
def c24(s, d):
    each = F.array(F.struct(F.lit("q").alias("param"), F.col("l_quantity").alias("current"), (F.col("l_quantity") * 1.25).alias("recommended")), F.struct(F.lit("d").alias("param"), F.col("l_discount").alias("current"), F.col("l_tax").alias("recommended")))
    long = view(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_suppkey").alias("t"), F.explode(each).alias("e")).select("k", "i", "t", "e.*")
    return M.assemble(long, s.createDataFrame([("q", 5.0, 40.0), ("d", 0.02, 0.08)], "param string, lo double, hi double")).withColumn("delta", F.col("delta") + 0.0)


@query("c27_bucket", sql("select frame_id, x, y, r, case when r < 0.25 then 'low' when r < 0.75 then 'mid' else 'high' end as level from pixels", "pixels"))
def c27(s, d):
    return px(s, d).select("frame_id", "x", "y", "r", M.bucket(F.col("r"), [(0.25, "low"), (0.75, "mid")], "high").alias("level"))


@query("c28_quantise", "select event_id, least(100.0, greatest(-100.0, round_even(value * 1.0037, 0))) as slider, round_even(value / 99.7, 2) as ratio, least(5.0, greatest(-5.0, round_even(value / 49.7 * 20, 0) / 20)) as stops, least(40000.0, greatest(1500.0, round_even(value * 101.3 / 50, 0) * 50)) as kelvin, round_even(value * 10.3, 0) % 360 as degrees from events")
def c28(s, d):
    v = F.col("value")
    kinds = {"slider": v * 1.0037 / 100, "ratio": v / 99.7, "stops": v / 49.7, "kelvin": v * 101.3, "degrees": v * 10.3}
    return view(s, d, "events").select("event_id", *[M.quantise(c, k).alias(k) for k, c in kinds.items()])


PROFILES = {"calm": {"r": 0.3, "g": 0.5}, "warm": {"r": 0.8, "b": 0.2}, "cold": {"b": 0.8, "g": 0.4}}


@query("c29_mood", sql("with a as (select frame_id, avg(r) as r, avg(g) as g, avg(b) as b from pixels group by 1), c as (select frame_id, unnest(['calm', 'warm', 'cold']) as mood, round(unnest([1 - (abs(r - 0.3) + abs(g - 0.5)) / 2, 1 - (abs(r - 0.8) + abs(b - 0.2)) / 2, 1 - (abs(b - 0.8) + abs(g - 0.4)) / 2]), 9) as c from a), r as (select *, row_number() over w as rn, lead(c) over w as nx from c window w as (partition by frame_id order by c desc, mood desc)) select frame_id, mood, round(c, 9) as closeness, round(c - nx, 9) as margin from r where rn = 1", "pixels"))
def c29(s, d):
    axes = px(s, d).groupBy(*K).agg(*[F.avg(c).alias(c) for c in "rgb"])
    return rounded(M.mood(axes, K, ["r", "g", "b"], PROFILES), *K)


@query("c32_flatten_features", "select l_orderkey as k, l_linenumber as i, l_partkey as t, unnest(['q', 'd']) as name, unnest([l_quantity, l_discount]) as value from lineitem")
def c32(s, d):
    m = F.create_map(F.lit("q"), F.col("l_quantity"), F.lit("d"), F.col("l_discount"), F.lit("bad"), F.lit(float("nan")), F.lit("none"), F.lit(None).cast("double"))
    return M.flatten_map(view(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("t"), m.alias("m")), ["k", "i", "t"], "m")


ZONES = f"lu as (select *, {Y} as lum from pixels), t as (select *, least(1.0, greatest(0.0, (lum - 0.15) / 0.3)) as a, least(1.0, greatest(0.0, (lum - 0.55) / 0.3)) as c from lu), z as (select *, 1 - a * a * (3 - 2 * a) as sz, c * c * (3 - 2 * c) as hz from t), zz as (select *, 1 - sz - hz as mz from z)"


@query("c33_soft_zones", sql(f"with {ZONES} select frame_id, round(sum(sz * (r - b)) / nullif(sum(sz), 0), 9) as shadows, round(sum(mz * (r - b)) / nullif(sum(mz), 0), 9) as mids, round(sum(hz * (r - b)) / nullif(sum(hz), 0), 9) as highs, round(avg(sz), 9) as w_shadows, round(avg(mz), 9) as w_mids, round(avg(hz), 9) as w_highs from zz group by 1", "pixels"))
def c33(s, d):
    return rounded(M.soft_zones(px(s, d), K, F.col("r") - F.col("b")), *K)


@query("c34_hue_bands", sql(f"with {HSV}, e as (select *, abs((hue - centre + 540) % 360 - 180) as away from hs, (values ('red', 0.0), ('orange', 30.0), ('yellow', 60.0), ('green', 120.0), ('aqua', 180.0), ('blue', 240.0), ('magenta', 300.0)) b(band, centre) where sat > 0.1), w as (select *, case when away < 45 then cos(radians(away / 45 * 90)) else 0.0 end as w from e) select frame_id, band, round(avg(w), 9) as presence, round(sum(w * sat) / nullif(sum(w), 0), 9) as sat from w group by 1, 2", "pixels"))
def c34(s, d):
    return rounded(M.hue_bands(px(s, d), K), *K, "band")


@query("c40_space_summary", sql(f"with {XYZ}, y as (select *, 0.299 * r + 0.587 * g + 0.114 * b as yy from xz) select frame_id, round(avg(r) / (avg(r) + avg(g) + avg(b)), 9) as red_ratio, round(avg(cx), 9) as cx, round(avg(cy), 9) as cy, round(avg(cz), 9) as cz, round(avg((r - yy) * 0.713 + 0.5), 9) as cr, round(avg((b - yy) * 0.564 + 0.5), 9) as cb from y group by 1", "pixels"))
def c40(s, d):
    rows = M.with_ycrcb(M.with_xyz(px(s, d)))
    out = rows.groupBy(*K).agg((F.avg("r") / (F.avg("r") + F.avg("g") + F.avg("b"))).alias("red_ratio"), *[F.avg(c).alias(c) for c in ("cx", "cy", "cz", "cr", "cb")])
    return rounded(out, *K)


STATS = """
pairs as (
  select x.frame_id, avg(sqrt((x.lab_l - y.lab_l) ** 2 + (x.lab_a - y.lab_a) ** 2 + (x.lab_b - y.lab_b) ** 2)) as distance
  from lab x join lab y on x.frame_id = y.frame_id and x.colour < y.colour group by 1
)
select frame_id, round(-sum(share * log2(share)), 9) as diversity, round(coalesce(any_value(distance), 0.0), 9) as distance
from lab left join pairs using (frame_id) group by 1
"""


@query("c18_palette_stats", sql(f"{PALETTE.strip()}, {LAB.replace('from pixels)', 'from palette)')}, {STATS.strip()}", "pixels"))
def c18(s, d):
    return rounded(M.palette_stats(M.palette(px(s, d), K), K), *K)


GP = "g as (select l_orderkey as k, unnest(['q', 'd', 'z']) as param, unnest([l_quantity, l_discount, l_tax]) as cur from lineitem), lim(param, lo, hi) as (values ('q', 5.0, 40.0), ('d', 0.02, 0.08), ('m', 0.0, 1.0))"


def params(s):
    return s.createDataFrame([("q", 5.0, 40.0), ("d", 0.02, 0.08), ("m", 0.0, 1.0)], "param string, lo double, hi double")


def grades(s, d):
    each = F.array(*[F.struct(F.lit(n).alias("param"), F.col(c).alias("current")) for n, c in (("q", "l_quantity"), ("d", "l_discount"), ("z", "l_tax"))])
    return view(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.explode(each).alias("e")).select("k", "e.*")


@query("c25_validate_grades", f"with {GP} select k, 'missing' as problem, count(*) as n from (select distinct k, lim.param from g, lim except select k, param from g) group by 1 union all select k, 'unexpected', count(*) from g where param not in (select param from lim) group by 1 union all select k, 'range', count(*) from g join lim using (param) where cur not between lo and hi group by 1")
def c25(s, d):
    return M.validate_grades(grades(s, d), ["k"], params(s))


@query("c26_sanitise", f"with {GP} select k, count(*) filter (param = 'z') as ignored, count(*) filter (param <> 'z' and cur not between lo and hi) as clamped from g left join lim using (param) group by 1")
def c26(s, d):
    text = lambda c: F.concat(F.col(c).cast("decimal(20,6)").cast("string"), F.lit("K"))
    each = F.create_map(*[x for n, c in (("q", "l_quantity"), ("d", "l_discount"), ("z", "l_tax")) for x in (F.lit(n), text(c))])
    maps = view(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.map_filter(each, lambda _, x: x.isNotNull()).alias("m"))
    return M.sanitise(maps, ["k"], "m", params(s))[1]


@query("c41_caveats", sql("with a as (select frame_id, round(avg(r), 9) as r, round(avg(g), 9) as g from pixels group by 1) select frame_id, concat_ws('; ', case when r > 0.51 then 'bright red' end, case when g < 0.49 then 'little green' end) as notes from a", "pixels"))
def c41(s, d):
    a = px(s, d).groupBy(*K).agg(*[F.round(F.avg(c), 9).alias(c) for c in "rg"])
    return a.select(*K, M.caveats(a, [(F.col("r") > 0.51, "bright red"), (F.col("g") < 0.49, "little green")]).alias("notes"))


HARMONY = f"""
with {hue_hist(72)},
hues(template, place, target, size, hue) as (values {", ".join(f"('{n}', {i}, {j}, {len(hues)}, {float(o)}::double)" for i, (n, hues) in enumerate(M.HARMONIES.items()) for j, o in enumerate(hues))}),
top as (select frame_id, arg_max(bin, (p, -bin)) as top from hh group by 1),
turned as (select frame_id, p, (bin - top + 72) % 72 as rel from hh join top using (frame_id)),
apart as (select t.frame_id, t.rel, t.p, h.*, abs((t.rel * 5.0::double - hue + 900.0) % 360.0 - 180.0) as d from turned t cross join hues h),
mass as (
  select frame_id, template, place, size, sum(p * w) as mass
  from (select frame_id, rel, template, place, size, any_value(p) as p, greatest(0.0, 1.0 - min(d) / 25.0) as w from apart group by 1, 2, 3, 4, 5) group by 1, 2, 3, 4
),
used as (select frame_id, template, count(*) as used from (select frame_id, template, target from apart where d <= 25.0 group by 1, 2, 3 having round(sum(p), 12) >= 0.05) group by 1, 2),
fits as (select frame_id, template, place, round(mass * coalesce(used, 0) / size, 9) as fit from mass left join used using (frame_id, template))
select frame_id, arg_max(template, (fit, -place)) as template, max(fit) as fit from fits group by 1
"""


@query("c16_harmony", sql(HARMONY.strip(), "pixels"))
def c16(s, d):
    return M.harmony(M.hist(M.with_hsv(px(s, d)), K, "hue", 72, 0.0, 360.0), K)


@query("c31_tone", sql(f"with y as (select frame_id, {Y} as lum from pixels) select frame_id, round(log2(greatest(quantile_cont(lum, 0.5), 1e-4) / 0.18), 9) as stops, round(avg(lum), 9) as brightness, round(quantile_cont(lum, 0.01), 9) as black, round(quantile_cont(lum, 0.99), 9) as white, round(avg((lum <= 0.01)::int), 9) as dark_share, round(avg((lum >= 0.99)::int), 9) as bright_share from y group by 1", "pixels"))
def c31(s, d):
    return rounded(M.tone(px(s, d), K), *K)


@query("c35_zone_balance", sql(f"with {ZONES}, e as (select frame_id, sz, mz, hz, unnest(['r', 'g', 'b']) as channel, unnest([r - lum, g - lum, b - lum]) as v from zz) select frame_id, channel, round(sum(sz * v) / nullif(sum(sz), 0), 9) as shadows, round(sum(mz * v) / nullif(sum(mz), 0), 9) as mids, round(sum(hz * v) / nullif(sum(hz), 0), 9) as highs from e group by 1, 2", "pixels"))
def c35(s, d):
    return rounded(M.zone_balance(px(s, d), K), *K, "channel")


@query("c39_vibrance", sql(f"with {HSV} select frame_id, round(avg(sat), 9) as mean_sat, round(coalesce(sum((1 - sat) * sat) / nullif(sum(1 - sat), 0), 0.0), 9) as muted_sat from hs group by 1", "pixels"))
def c39(s, d):
    return rounded(M.vibrance(px(s, d), K), *K)


@query("c42_audit_documents", "select event_id, unnest(case when event_id % 2 = 0 then ['missing tone', 'unexpected pixel_dump', 'forbidden pixel_dump'] else ['long tone'] end) as problem from events")
def c42(s, d):
    tone = F.lit("[" + ",".join("1" * 70) + "]")
    doc = F.when(F.col("event_id") % 2 == 0, F.lit('{"look": "a", "pixel_dump": "b"}')).otherwise(F.concat(F.lit('{"look": "a", "tone": '), tone, F.lit("}")))
    return M.audit_documents(view(s, d, "events").select("event_id", doc.alias("j")), ["event_id"], "j", ["look", "tone"], "pixel")
