"""Measurements of channel tables (group, r, g, b in 0..1), for all groups in one job."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

#: sRGB to XYZ (D65), the white point, and the weights of luminance.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
LUMA = (0.2126, 0.7152, 0.0722)


def luminance(r: Column | str = "r", g: Column | str = "g", b: Column | str = "b") -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return LUMA[0] * c(r) + LUMA[1] * c(g) + LUMA[2] * c(b)


def with_hsv(df: DataFrame) -> DataFrame:
    """``df`` with hue (degrees), sat and val."""
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    rows = df.withColumn("val", top).withColumn("d_h", top - low)
    r, g, b, d = F.col("r"), F.col("g"), F.col("b"), F.col("d_h")
    hue = F.when(d == 0, 0.0).when(F.col("val") == r, F.pmod((g - b) / d, F.lit(6.0))).when(F.col("val") == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    return rows.withColumn("hue", hue).withColumn("sat", F.coalesce(F.try_divide(d, F.col("val")), F.lit(0.0))).drop("d_h")


def linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def with_xyz(df: DataFrame) -> DataFrame:
    rows = df.withColumns({f"lin_{c}": linear(F.col(c)) for c in "rgb"})
    return rows.withColumns({n: sum((w * F.col(f"lin_{c}") for w, c in zip(ws[1:], "gb")), ws[0] * F.col("lin_r")) for n, ws in zip(("cx", "cy", "cz"), TO_XYZ)}).drop("lin_r", "lin_g", "lin_b")


def with_lab(df: DataFrame) -> DataFrame:
    """``df`` with lab_l, lab_a, lab_b."""
    f = lambda t: F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116)
    rows = with_xyz(df).withColumns({f"f{n}": f(F.col(n) / w) for n, w in zip(("cx", "cy", "cz"), WHITE)})
    return rows.withColumn("lab_l", 116 * F.col("fcy") - 16).withColumn("lab_a", 500 * (F.col("fcx") - F.col("fcy"))).withColumn("lab_b", 200 * (F.col("fcy") - F.col("fcz"))).drop("fcx", "fcy", "fcz", "cx", "cy", "cz")


def with_ycrcb(df: DataFrame) -> DataFrame:
    y = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    return df.withColumn("yy", y).withColumn("cr", (F.col("r") - F.col("yy")) * 0.713 + 0.5).withColumn("cb", (F.col("b") - F.col("yy")) * 0.564 + 0.5)


def channel_stats(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, n, mean, median, variance, std, low, high, p5, p95); the variance is of the population."""
    p = F.percentile(column, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    rows = df.groupBy(*keys).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.var_pop(column).alias("variance"), F.min(column).alias("low"), F.max(column).alias("high"), p.alias("p"))
    return rows.withColumn("std", F.sqrt("variance")).withColumn("p5", F.col("p")[0]).withColumn("median", F.col("p")[1]).withColumn("p95", F.col("p")[2]).drop("p")


def hist(df: DataFrame, keys: list[str], column: str, bins: int, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(keys, bin, n, p, cdf): equal bins, the last one closed; values outside are left out."""
    c = F.col(column)
    at = F.when(c.between(lo, hi), F.least(F.lit(bins - 1), F.floor((c - lo) / (hi - lo) * bins))).cast("int")
    # what is outside goes by its count: a condition on the column would be worked out beside the column, several times a row
    rows = df.groupBy(*keys, at.alias("bin")).agg(F.count(at).alias("n")).where("n > 0")
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("p", F.col("n") / F.sum("n").over(w))
    return rows.withColumn("cdf", F.sum("n").over(w.orderBy("bin")) / F.sum("n").over(w))


def entropy(h: DataFrame, keys: list[str]) -> DataFrame:
    return h.groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def cdf_percentile(h: DataFrame, keys: list[str], q: float, bins: int, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(keys, value): centre of the first bin whose cdf is at least ``q``."""
    return h.where(F.col("cdf") >= q - 1e-12).groupBy(*keys).agg(F.min("bin").alias("bin")).select(*keys, (lo + (F.col("bin") + 0.5) * (hi - lo) / bins).alias("value"))


def hist_shape(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.skewness(column), F.lit(0.0)).alias("skew"), F.coalesce(F.kurtosis(column), F.lit(0.0)).alias("kurtosis"), (F.percentile(column, F.lit(0.95)) - F.percentile(column, F.lit(0.05))).alias("spread"))


def circular_mean(df: DataFrame, keys: list[str], angle: str, weight: Column) -> DataFrame:
    """(keys, mean, variance) of degrees: variance is 1 less the length of the mean vector."""
    a = F.radians(angle)
    rows = df.groupBy(*keys).agg(F.sum(weight * F.cos(a)).alias("c"), F.sum(weight * F.sin(a)).alias("s"), F.sum(weight).alias("w"))
    return rows.select(*keys, F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0)).alias("mean"), (1 - F.coalesce(F.try_divide(F.sqrt(F.col("c") ** 2 + F.col("s") ** 2), F.col("w")), F.lit(0.0))).alias("variance"))


def hue_peaks(h: DataFrame, keys: list[str], bins: int, n: int = 3) -> DataFrame:
    """(keys, bin, p, rank): bins not below either neighbour on the circle and above one, the ``n`` largest."""
    p = F.map_from_entries(F.collect_list(F.struct("bin", "p")))
    rows = h.groupBy(*keys).agg(p.alias("of_h")).withColumn("p_h", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("of_h", i), F.lit(0.0))))
    around = F.transform("p_h", lambda x, i: F.struct((-x).alias("less"), i.alias("bin"), x.alias("p"), F.get("p_h", (i + bins - 1) % bins).alias("before"), F.get("p_h", (i + 1) % bins).alias("after")))
    peaks = F.filter(around, lambda x: (x["p"] >= x["before"]) & (x["p"] >= x["after"]) & ((x["p"] > x["before"]) | (x["p"] > x["after"])))
    rows = rows.select(*keys, F.posexplode(F.slice(F.array_sort(peaks), 1, n)).alias("i_h", "o"))
    return rows.select(*keys, "o.bin", "o.p", (F.col("i_h") + 1).alias("rank"))


def lab_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    chroma = F.sqrt(F.col("lab_a") ** 2 + F.col("lab_b") ** 2)
    return with_lab(df).groupBy(*keys).agg(*[F.avg(c).alias(f"mean_{c}") for c in ("lab_l", "lab_a", "lab_b")], *[F.stddev_pop(c).alias(f"std_{c}") for c in ("lab_l", "lab_a", "lab_b")], F.avg(chroma).alias("chroma"))


def exposure(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, shadows, mids, highs, crushed, blown, median, gamma)."""
    y = luminance()
    share = lambda c: F.avg(c.cast("double"))
    rows = df.groupBy(*keys).agg(share(y < 0.25).alias("shadows"), share((y >= 0.25) & (y <= 0.75)).alias("mids"), share(y > 0.75).alias("highs"), share(y <= 0.02).alias("crushed"), share(y >= 0.98).alias("blown"), F.percentile(y, F.lit(0.5)).alias("median"))
    return rows.withColumn("gamma", F.log(F.lit(0.5)) / F.log(F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("median")))))


def contrast(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rms, michelson, span, stops)."""
    y = luminance()
    p = F.percentile(y, F.array(F.lit(0.05), F.lit(0.95)))
    rows = df.groupBy(*keys).agg(F.stddev_pop(y).alias("rms"), F.max(y).alias("hi"), F.min(y).alias("lo"), p.alias("p"))
    return rows.select(*keys, "rms", F.coalesce(F.try_divide(F.col("hi") - F.col("lo"), F.col("hi") + F.col("lo")), F.lit(0.0)).alias("michelson"), (F.col("p")[1] - F.col("p")[0]).alias("span"), F.log2(F.greatest(F.col("p")[1], F.lit(1e-4)) / F.greatest(F.col("p")[0], F.lit(1e-4))).alias("stops"))


def white_balance(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gain_r, gain_b, kelvin, tint): grey-world gains against green; McCamy's temperature of the mean colour."""
    mean = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in "rgb"])
    xyz = with_xyz(mean).withColumn("sum_w", F.col("cx") + F.col("cy") + F.col("cz"))
    n = (F.try_divide("cx", "sum_w") - 0.3320) / (0.1858 - F.try_divide("cy", "sum_w"))
    rows = xyz.withColumn("n_w", n)
    kelvin = 449 * F.col("n_w") ** 3 + 3525 * F.col("n_w") ** 2 + 6823.3 * F.col("n_w") + 5520.33
    return rows.select(*keys, F.try_divide("g", "r").alias("gain_r"), F.try_divide("g", "b").alias("gain_b"), kelvin.alias("kelvin"), (F.col("g") - (F.col("r") + F.col("b")) / 2).alias("tint"))


def tone_curve(df: DataFrame, keys: list[str], column: Column, points: int = 16) -> DataFrame:
    """(keys, i, p, q, slope): quantiles at ``points`` shares, with the slope between their neighbours."""
    shares = [i / (points - 1) for i in range(points)]
    rows = df.groupBy(*keys).agg(F.percentile(column, F.array(*[F.lit(x) for x in shares])).alias("qs")).select(*keys, F.posexplode("qs").alias("i", "q"))
    w = Window.partitionBy(*keys).orderBy("i")
    before, after = F.coalesce(F.lag("q").over(w), F.col("q")), F.coalesce(F.lead("q").over(w), F.col("q"))
    steps = F.when((F.col("i") == 0) | (F.col("i") == points - 1), 1).otherwise(2)
    return rows.select(*keys, "i", (F.col("i") / (points - 1)).alias("p"), "q", ((after - before) * (points - 1) / steps).alias("slope"))


def colourfulness(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, colourfulness) by Hasler and Suesstrunk."""
    rg, yb = F.col("r") - F.col("g"), (F.col("r") + F.col("g")) / 2 - F.col("b")
    rows = df.groupBy(*keys).agg(F.var_pop(rg).alias("a"), F.var_pop(yb).alias("b_"), F.avg(rg).alias("c"), F.avg(yb).alias("d"))
    return rows.select(*keys, (F.sqrt(F.col("a") + F.col("b_")) + 0.3 * F.sqrt(F.col("c") ** 2 + F.col("d") ** 2)).alias("colourfulness"))


def zone_tints(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, zone, share, red, blue): how far the means of red and blue are from green in shadows, mids and highs."""
    y = luminance()
    zone = F.when(y < 1 / 3, "shadows").when(y < 2 / 3, "mids").otherwise("highs")
    rows = df.withColumn("zone", zone).groupBy(*keys, "zone").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("r") - F.col("g")).alias("red"), F.avg(F.col("b") - F.col("g")).alias("blue"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).drop("n")


def mask_summary(df: DataFrame, keys: list[str], rule: Column, least: float = 0.005) -> DataFrame:
    """(keys, share, detected, mean, spread) of the rows for which ``rule`` holds."""
    y = luminance()
    rows = df.groupBy(*keys).agg(F.avg(rule.cast("double")).alias("share"), F.avg(F.when(rule, y)).alias("mean"), F.stddev_pop(F.when(rule, y)).alias("spread"))
    return rows.withColumn("detected", F.col("share") >= least)


def grid_regions(df: DataFrame, keys: list[str], g: int, width: int, height: int) -> DataFrame:
    """(keys, cells, uniformity): 1 / (1 + deviation of the mean luminance of the cells of a g x g grid)."""
    cell = F.floor(F.col("x") * g / width) * g + F.floor(F.col("y") * g / height)
    rows = df.groupBy(*keys, cell.alias("cell")).agg(F.avg(luminance()).alias("m"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), (1 / (1 + F.stddev_pop("m"))).alias("uniformity"))


def joint_entropy(df: DataFrame, keys: list[str], bins: int = 8) -> DataFrame:
    """(keys, entropy) of the joint histogram of three channels."""
    at = lambda c: F.least(F.lit(bins - 1), F.floor(F.col(c) * bins))
    rows = df.groupBy(*keys, (at("r") * bins * bins + at("g") * bins + at("b")).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    return rows.groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def bucket(c: Column, bounds: list[tuple[float, str]], last: str) -> Column:
    """Label of the first bound that ``c`` is below."""
    return reduce(lambda w, b: w.when(c < b[0], b[1]), bounds[1:], F.when(c < bounds[0][0], bounds[0][1])).otherwise(last)


def quantise(c: Column, kind: str) -> Column:
    """slider -100..100, ratio to hundredths, stops to twentieths within 5, kelvin to fifties, degrees in 0..359, centred x - 0.5."""
    clip = lambda x, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), x))
    return {
        "slider": clip(F.bround(c * 100), -100.0, 100.0), "ratio": F.bround(c, 2), "stops": clip(F.bround(c * 20) / 20, -5.0, 5.0),
        "kelvin": clip(F.bround(c / 50) * 50, 1500.0, 40000.0), "degrees": F.pmod(F.bround(c), F.lit(360.0)), "centred": clip(F.bround((c - 0.5) * 200), -100.0, 100.0),
    }[kind]


def soft_zones(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(keys, shadows, mids, highs, w_shadows, w_mids, w_highs): means of ``value`` by weights that sum to 1 for each row."""
    y = luminance()
    step = lambda a, b: (lambda t: t * t * (3 - 2 * t))(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (y - a) / (b - a))))
    rows = df.withColumn("v_z", value).withColumn("s_z", 1 - step(0.15, 0.45)).withColumn("h_z", step(0.55, 0.85)).withColumn("m_z", 1 - F.col("s_z") - F.col("h_z"))
    mean = lambda w: F.try_divide(F.sum(F.col(w) * F.col("v_z")), F.sum(w))
    return rows.groupBy(*keys).agg(mean("s_z").alias("shadows"), mean("m_z").alias("mids"), mean("h_z").alias("highs"), F.avg("s_z").alias("w_shadows"), F.avg("m_z").alias("w_mids"), F.avg("h_z").alias("w_highs"))


#: Centres of the hue bands in degrees.
BANDS = (("red", 0.0), ("orange", 30.0), ("yellow", 60.0), ("green", 120.0), ("aqua", 180.0), ("blue", 240.0), ("magenta", 300.0))


def hue_bands(df: DataFrame, keys: list[str], width: float = 45.0, gate: float = 0.1) -> DataFrame:
    """(keys, band, presence, sat): weight of each band by the cosine of the distance of hues, of rows above the gate of saturation."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.lit(c).alias("centre")) for n, c in BANDS]))
    rows = with_hsv(df).where(F.col("sat") > gate).withColumn("b_h", each).select("*", "b_h.band", "b_h.centre")
    away = F.abs(F.pmod(F.col("hue") - F.col("centre") + 180, F.lit(360.0)) - 180)
    w = F.when(away < width, F.cos(F.radians(away / width * 90))).otherwise(0.0)
    return rows.withColumn("w_h", w).groupBy(*keys, "band").agg(F.avg("w_h").alias("presence"), F.try_divide(F.sum(F.col("w_h") * F.col("sat")), F.sum("w_h")).alias("sat"))


def flatten_map(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, name, value) of a map of numbers, finite ones only."""
    rows = df.select(*keys, F.explode(column).alias("name", "value"))
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < math.inf))


def assemble(long: DataFrame, params: DataFrame) -> DataFrame:
    """(.., current, recommended, delta): values clamped to (param, lo, hi) and rounded to 4; the delta is of the rounded values."""
    rows = long.join(F.broadcast(params), "param")
    clamp = lambda c: F.bround(F.least(F.col("hi"), F.greatest(F.col("lo"), F.col(c))), 4)
    return rows.withColumn("current", clamp("current")).withColumn("recommended", clamp("recommended")).withColumn("delta", F.bround(F.col("recommended") - F.col("current"), 4)).drop("lo", "hi")


def mood(df: DataFrame, keys: list[str], axes: list[str], profiles: dict[str, dict[str, float]]) -> DataFrame:
    """(keys, mood, closeness, margin): the profile of the least mean distance over the axes; margin to the next."""
    close = [F.struct((1 - sum((F.abs(F.col(a) - v) for a, v in p.items()), F.lit(0.0)) / len(p)).alias("c"), F.lit(n).alias("n")) for n, p in profiles.items()]
    rows = df.withColumn("s_m", F.sort_array(F.transform(F.array(*close), lambda x: F.struct(F.round(x["c"], 9).alias("c"), x["n"].alias("n"))), False))
    return rows.select(*keys, F.col("s_m")[0]["n"].alias("mood"), F.col("s_m")[0]["c"].alias("closeness"), (F.col("s_m")[0]["c"] - F.col("s_m")[1]["c"]).alias("margin"))


#: Centres that are sent to the tasks; of more the rows are shuffled.
SENT_CENTRES = 600_000


def palette(df: DataFrame, keys: list[str], k: int = 6, levels: int = 6, rounds: int = 12, near: float = 0.06) -> DataFrame:
    """(keys, colour, r, g, b, share, saturation, role): the main colours of each group, numbered by share, then luminance.

    Lloyd's rounds for all groups at once begin at the means of the ``k`` fullest cells of a grid of ``levels`` a channel
    and end, group by group, when no centre moves. Then, from the largest on, a colour nearer than ``near`` to one that
    stays gives its share to the first of these. A centre is a row, so a round is one scan with partial sums, and only
    groups that still move take part; centres are written each round."""
    cell = lambda c: F.least(F.lit(levels - 1), F.floor(F.col(c) * levels))
    seeds = df.groupBy(*keys, ((cell("r") * levels + cell("g")) * levels + cell("b")).alias("cell")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in "rgb"])
    ranked = seeds.withColumn("colour", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "cell"))).where(F.col("colour") <= k)
    centres = staged(ranked.select(*keys, "colour", *"rgb", F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("done")))
    away = lambda x, y: sum(((x[c] - y[c]) * (x[c] - y[c]) for c in "gb"), (x["r"] - y["r"]) * (x["r"] - y["r"]))
    own = {c: F.col(c) for c in "rgb"}
    df, few = staged(df.select(*keys, *"rgb")), centres.count() <= SENT_CENTRES
    for _ in range(rounds):
        open_ = centres.where("not done")
        if not open_.take(1):
            break
        # one row of plain columns a group: a distance is worked out once, and code stays short enough to be compiled
        lists = open_.groupBy(*keys).agg(*[F.max(F.when(F.col("colour") == i, F.col(c))).alias(f"{c}_{i}") for i in range(1, k + 1) for c in "rgb"])
        rows = df.select(*keys, *"rgb").join(F.broadcast(lists) if few else lists, keys)
        apart = F.array(*[F.floor(away(own, {c: F.col(f"{c}_{i}") for c in "rgb"}) * 1e12 + 0.5) for i in range(1, k + 1)])
        nearest = F.array_position(apart, F.array_min(apart)).cast("int")
        means = rows.groupBy(*keys, nearest.alias("colour")).agg(F.count(F.lit(1)).alias("m"), *[F.avg(c).alias(f"{c}1") for c in "rgb"])
        moved = open_.join(means, [*keys, "colour"], "left").select(*keys, "colour", *[F.coalesce(f"{c}1", c).alias(c) for c in "rgb"], *[F.col(c).alias(f"{c}0") for c in "rgb"], F.coalesce("m", F.lit(0)).alias("n"))
        still = [F.abs(F.col(c) - F.col(f"{c}0")) <= 1e-4 + 1e-5 * F.abs(f"{c}0") for c in "rgb"]
        done = F.bool_and(still[0] & still[1] & still[2]).over(Window.partitionBy(*keys))
        centres = staged(moved.select(*keys, "colour", *"rgb", "n", done.alias("done")).unionByName(centres.where("done")))

    item = F.struct((-F.col("n")).alias("m"), "colour", *"rgb", "n")
    found = centres.where("n > 0").groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("found"))
    first = lambda kept, c: F.array_position(F.transform(kept, lambda x: away(x, c) < near * near), True)
    into = lambda kept, c: F.transform(kept, lambda x, i: F.when(i + 1 == first(kept, c), x.withField("n", x["n"] + c["n"])).otherwise(x))
    none = F.filter("found", lambda x: F.lit(False))
    kept = F.aggregate("found", none, lambda kept, c: F.when(first(kept, c) > 0, into(kept, c)).otherwise(F.array_append(kept, c)))
    rows = found.select(*keys, F.explode(kept).alias("c")).select(*keys, "c.colour", *[f"c.{c}" for c in "rgb"], "c.n")
    rows = rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    high = F.greatest(*"rgb")
    saturation = F.when(high < 1e-6, 0.0).otherwise((high - F.least(*"rgb")) / high)
    luma = F.round(luminance(), 9)
    role = F.when(F.col("share") >= 0.3, "dominant").when((F.col("saturation") >= 0.45) & (F.col("share") < 0.12), "accent").otherwise("secondary")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), luma, "colour"))
    return rows.withColumn("saturation", saturation).select(*keys, number.alias("colour"), *"rgb", "share", "saturation", role.alias("role"))


def palette_stats(colours: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, diversity, distance): entropy of the shares and mean distance in Lab of the pairs of a palette, which is a few rows."""
    lab = with_lab(colours).select(*keys, "colour", "share", "lab_l", "lab_a", "lab_b")
    other = lab.select(*keys, *[F.col(c).alias(f"{c}2") for c in ("colour", "lab_l", "lab_a", "lab_b")])
    away = F.sqrt(sum(((F.col(c) - F.col(f"{c}2")) ** 2 for c in ("lab_a", "lab_b")), (F.col("lab_l") - F.col("lab_l2")) ** 2))
    pairs = lab.join(other, keys).where("colour < colour2").groupBy(*keys).agg(F.avg(away).alias("distance"))
    return lab.groupBy(*keys).agg((-F.sum(F.col("share") * F.log2("share"))).alias("diversity")).join(pairs, keys, "left").na.fill(0.0, ["distance"])


def validate_grades(long: DataFrame, keys: list[str], params: DataFrame) -> DataFrame:
    """(keys, problem, n): missing and unexpected parameters, and values out of (param, lo, hi)."""
    wanted = long.select(*keys).distinct().withColumn("w", F.lit(1)).join(F.broadcast(params.select("param").withColumn("w", F.lit(1))), "w").drop("w")
    put = lambda rows, what: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit(what))
    missing = put(wanted.join(long, [*keys, "param"], "left_anti"), "missing")
    odd = put(long.join(F.broadcast(params), "param", "left_anti"), "unexpected")
    out = put(long.join(F.broadcast(params), "param").where(~F.col("current").between(F.col("lo"), F.col("hi"))), "range")
    return missing.unionByName(odd).unionByName(out)


def parse_value(text: Column) -> Column:
    """The number at the start of a text such as ``4200K`` or ``-3.5 dB``; null if there is none."""
    return F.regexp_extract(F.trim(text), r"^([-+]?[0-9]*\.?[0-9]+)", 1).try_cast("double")


def sanitise(payloads: DataFrame, keys: list[str], values: str, params: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values, report): numbers of a map of texts clamped to (param, lo, hi); report counts ignored and clamped ones by key."""
    rows = payloads.select(*keys, F.explode(values).alias("param", "text")).withColumn("raw", parse_value(F.col("text"))).join(F.broadcast(params), "param", "left")
    good = F.col("lo").isNotNull() & F.col("raw").isNotNull()
    value = F.least("hi", F.greatest("lo", "raw"))
    report = rows.groupBy(*keys).agg(F.count_if(~good).alias("ignored"), F.count_if(good & (value != F.col("raw"))).alias("clamped"))
    return rows.where(good).select(*keys, "param", value.alias("value")), report


def caveats(df: DataFrame, rules: list[tuple[Column, str]]) -> Column:
    """Notes whose rule holds, in order, joined by semicolons."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules])), "; ")


def tone(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, stops, brightness, black, white, dark_share, bright_share): readings of luminance; stops are of the median against 0.18."""
    y = luminance()
    p = F.percentile(y, F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99)))
    rows = df.groupBy(*keys).agg(p.alias("p"), F.avg(y).alias("brightness"), F.avg((y <= 0.01).cast("double")).alias("dark_share"), F.avg((y >= 0.99).cast("double")).alias("bright_share"))
    return rows.select(*keys, F.log2(F.greatest(F.col("p")[1], F.lit(1e-4)) / 0.18).alias("stops"), "brightness", F.col("p")[0].alias("black"), F.col("p")[2].alias("white"), "dark_share", "bright_share")


def zone_balance(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, channel, shadows, mids, highs): offsets of red, green and blue from luminance in soft zones."""
    out = None
    for c in "rgb":
        rows = soft_zones(df, keys, F.col(c) - luminance()).select(*keys, F.lit(c).alias("channel"), "shadows", "mids", "highs")
        out = rows if out is None else out.unionByName(rows)
    return out


def vibrance(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean_sat, muted_sat): mean saturation, plain and weighted by how muted a row is."""
    muted = 1 - F.col("sat")
    return with_hsv(df).groupBy(*keys).agg(F.avg("sat").alias("mean_sat"), F.coalesce(F.try_divide(F.sum(muted * F.col("sat")), F.sum(muted)), F.lit(0.0)).alias("muted_sat"))


#: Hue harmonies and the hues in degrees that belong to them, counted from the dominant one.
HARMONIES = {
    "monochromatic": (0,),
    "complementary": (0, 180),
    "analogous": (0, 30, 330),
    "triadic": (0, 120, 240),
    "split_complementary": (0, 150, 210),
    "tetradic": (0, 90, 180, 270),
}


def harmony(h: DataFrame, keys: list[str], bins: int = 72, tolerance: float = 25.0, least: float = 0.05) -> DataFrame:
    """(keys, template, fit): the harmony that a hue histogram (bin, p) fits best, turned to its dominant bin. Fit: the mass
    near the harmony's hues, falling from 1 at a hue to 0 at ``tolerance``, times the share of its hues with a mass of
    ``least`` or more within ``tolerance``. Ties go to the harmony that is named first. The tables joined are of fixed size."""
    spark, width = h.sparkSession, 360.0 / bins
    apart = lambda rel, hue: abs((rel * width - hue + 180.0) % 360.0 - 180.0)
    near = [(n, rel, max(0.0, 1.0 - min(apart(rel, o) for o in hues) / tolerance)) for n, hues in HARMONIES.items() for rel in range(bins)]
    at = [(n, i, rel) for n, hues in HARMONIES.items() for i, o in enumerate(hues) for rel in range(bins) if apart(rel, o) <= tolerance]
    names = [(n, i, len(HARMONIES[n])) for i, n in enumerate(HARMONIES)]
    near = F.broadcast(spark.createDataFrame(near, "template string, rel int, weight double"))
    at = F.broadcast(spark.createDataFrame(at, "template string, target int, rel int"))
    names = F.broadcast(spark.createDataFrame(names, "template string, place int, size int"))
    top = h.groupBy(*keys).agg(F.max(F.struct("p", (-F.col("bin")).alias("low"))).alias("top"))
    rows = h.join(top, keys).select(*keys, "p", F.pmod(F.col("bin") + F.col("top.low"), F.lit(bins)).cast("int").alias("rel"))
    mass = rows.join(near, "rel").groupBy(*keys, "template").agg(F.sum(F.col("p") * F.col("weight")).alias("mass"))
    used = rows.join(at, "rel").groupBy(*keys, "template", "target").agg(F.sum("p").alias("p")).where(F.round("p", 12) >= least).groupBy(*keys, "template").agg(F.count(F.lit(1)).alias("used"))
    fits = mass.join(used, [*keys, "template"], "left").join(names, "template").withColumn("fit", F.round(F.col("mass") * F.coalesce("used", F.lit(0)) / F.col("size"), 9))
    best = fits.groupBy(*keys).agg(F.max(F.struct("fit", (-F.col("place")).alias("place"), "template")).alias("b"))
    return best.select(*keys, "b.template", "b.fit")


def audit_documents(df: DataFrame, keys: list[str], document: str, sections: list[str], forbidden: str, longest: int = 64) -> DataFrame:
    """(keys, problem): sections that a JSON object lacks or that aren't known, keys that hold a forbidden token, arrays that are too long."""
    parsed = df.select(*keys, F.from_json(document, "map<string,string>").alias("m"))
    names = F.map_keys("m")
    known = F.array(*[F.lit(s) for s in sections])
    lost = F.transform(F.array_except(known, names), lambda s: F.concat(F.lit("missing "), s))
    odd = F.transform(F.array_except(names, known), lambda s: F.concat(F.lit("unexpected "), s))
    bad = F.transform(F.filter(names, lambda s: s.rlike(forbidden)), lambda s: F.concat(F.lit("forbidden "), s))
    long = F.transform(F.map_keys(F.map_filter("m", lambda k, v: F.coalesce(F.size(F.from_json(v, "array<string>")), F.lit(0)) > longest)), lambda s: F.concat(F.lit("long "), s))
    return parsed.select(*keys, F.explode(F.concat(lost, odd, bad, long)).alias("problem"))
