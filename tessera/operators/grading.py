"""Grades of channel tables (group, r, g, b in 0..1): sections of measures, style scores, measured and recommended
parameters, summaries, and the readings of neutral, split and masked tones. Each is one aggregate over the rows and
arithmetic over the one row that is left of each group; empty groups have no row, a zone without rows counts as 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .measure import bucket, luminance, with_hsv, with_lab, with_xyz, with_ycrcb

#: Hue bands in degrees, the chroma box of skin, and the tones a look aims at.
TEAL, ORANGE, BLUE = (160.0, 210.0), (15.0, 55.0), (200.0, 260.0)
SKIN_CR, SKIN_CB = (133.0 / 255, 173.0 / 255), (77.0 / 255, 127.0 / 255)
STYLES = {
    "commercial": {"temp": 5900.0, "contrast": 0.36, "vibrance": 16.0, "clarity": 12.0, "teal_orange": 0.45, "shadow_lift": 0.08, "tint": 0.0, "curve": "gentle_s"},
    "cinematic": {"temp": 6200.0, "contrast": 0.30, "vibrance": 6.0, "clarity": 6.0, "teal_orange": 0.80, "shadow_lift": 0.18, "tint": 0.0, "curve": "filmic"},
    "natural": {"temp": 6300.0, "contrast": 0.28, "vibrance": 5.0, "clarity": 4.0, "teal_orange": 0.15, "shadow_lift": 0.05, "tint": 0.0, "curve": "linear"},
    "moody": {"temp": 6700.0, "contrast": 0.33, "vibrance": -4.0, "clarity": 7.0, "teal_orange": 0.55, "shadow_lift": 0.22, "tint": 0.0, "curve": "filmic"},
    "vintage": {"temp": 5600.0, "contrast": 0.24, "vibrance": -6.0, "clarity": 2.0, "teal_orange": 0.35, "shadow_lift": 0.26, "tint": 4.0, "curve": "faded"},
}
#: Ratio of red to blue of a neutral surface by colour temperature.
KELVIN = ((2000, 3.30), (2500, 2.42), (3000, 1.92), (3500, 1.60), (4000, 1.39), (4500, 1.24), (5000, 1.13), (5500, 1.05), (6500, 1.00), (7500, 0.92), (9000, 0.84), (11000, 0.77), (12000, 0.74))

POINTS = 64
EXTRA = {"p1": 0.01, "p2": 0.02, "p5": 0.05, "median": 0.5, "p95": 0.95, "p98": 0.98, "p99": 0.99}


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), c))


def bell(c: Column, at: float, width: float) -> Column:
    return F.exp(-((c - at) ** 2) / (2 * width * width))


def turned(s: Column, c: Column) -> Column:
    """The angle of (c, s) in degrees from 0 to 360, 0 where there is none."""
    return F.coalesce(F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)), F.lit(0.0))


def apart(a: Column, b: Column) -> Column:
    """Distance of two angles on the circle, 0 to 180 degrees."""
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def smoothstep(c: Column, lo: float, hi: float) -> Column:
    t = clamp((c - lo) / (hi - lo))
    return t * t * (3 - 2 * t)


def sections(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measures): all that the scores and grades below need, one row a group. ``q`` has the quantiles of luminance
    at ``POINTS`` equal steps; local contrast is the caller's to join, as it needs neighbours."""
    y, hue, sat, a, b = (F.col(c) for c in ("y_g", "hue", "sat", "lab_a", "lab_b"))
    rows = with_lab(with_ycrcb(with_hsv(df))).withColumn("y_g", luminance())
    share = lambda c: F.avg(c.cast("double"))
    mean = lambda c, v: F.coalesce(F.avg(F.when(c, v)), F.lit(0.0))
    within = lambda c, band: (c >= band[0]) & (c <= band[1])
    mass = lambda band: F.sum(F.when(within(hue, band), sat).otherwise(0.0)) / (F.sum(sat) + 1e-8)
    angle = lambda c, w: turned(F.sum(F.when(c, w * F.sin(F.radians(hue)))), F.sum(F.when(c, w * F.cos(F.radians(hue)))))
    rg, yb = F.col("r") - F.col("g"), (F.col("r") + F.col("g")) / 2 - F.col("b")
    spread = F.sqrt(F.var_pop(rg) + F.var_pop(yb)) + 0.3 * F.sqrt(F.avg(rg) ** 2 + F.avg(yb) ** 2)
    skin = within(F.col("cr"), SKIN_CR) & within(F.col("cb"), SKIN_CB) & ((hue <= 50) | (hue >= 340)) & (sat > 0.1) & (y > 0.15) & (y < 0.98)
    zones = {"shadows": y < 0.33, "mids": (y >= 0.33) & (y <= 0.66), "highs": y > 0.66}
    shares = [i / (POINTS - 1) for i in range(POINTS)] + list(EXTRA.values())
    out = rows.groupBy(*keys).agg(
        F.avg(y).alias("mean_y"), F.stddev_pop(y).alias("std_y"), F.percentile(y, F.array(*[F.lit(x) for x in shares])).alias("q"),
        share(y < 0.25).alias("shadow"), share(y > 0.75).alias("high"), share(y < 0.02).alias("clip_lo"), share(y > 0.98).alias("clip_hi"),
        F.avg(sat).alias("mean_sat"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_lab_b"), *[F.avg(c).alias(c) for c in "rgb"], spread.alias("colourfulness"),
        mass(TEAL).alias("teal"), mass(ORANGE).alias("orange"),
        *[(F.coalesce(F.avg(F.when(within(hue, band), v)) - F.avg(v), F.lit(0.0)) * 100).alias(f"{n}_{p}") for n, band in (("orange", ORANGE), ("blue", BLUE)) for p, v in (("sat", sat), ("lum", y))],
        *[c for n, z in zones.items() for c in (angle(z, sat).alias(f"{n}_hue"), mean(z, sat).alias(f"{n}_sat"), mean(z, (a + b) / 2).alias(f"{n}_warmth"), mean(z, b).alias(f"{n}_b"))],
        share(skin).alias("skin_share"), angle(skin, F.lit(1.0)).alias("skin_hue"), mean(skin, sat).alias("skin_sat"), mean(skin, y).alias("skin_lum"),
    )
    out = out.withColumns({n: F.col("q")[POINTS + i] for i, n in enumerate(EXTRA)}).withColumn("q", F.slice("q", 1, POINTS))
    out = with_xyz(out).withColumn("sum_g", F.col("cx") + F.col("cy") + F.col("cz") + 1e-8)
    n = F.col("n_g")
    out = out.withColumn("n_g", (F.col("cx") / F.col("sum_g") - 0.3320) / (0.1858 - F.col("cy") / F.col("sum_g") + 1e-8))
    out = out.withColumn("kelvin", clamp(449 * n**3 + 3525 * n**2 + 6823.3 * n + 5520.33, 1000, 40000)).drop("cx", "cy", "cz", "sum_g", "n_g")
    return with_curve(out).withColumn("contrast", F.col("p95") - F.col("p5")).withColumn("stops", F.log2((F.col("p99") + 1e-4) / (F.col("p1") + 1e-4))).withColumn("detected", F.col("skin_share") >= 0.005)


def with_curve(df: DataFrame) -> DataFrame:
    """``df`` with black, white, gamma, s_curve and rolloff of its quantiles ``q``. Sums of slopes between neighbours
    telescope, so each band needs its ends only; gamma is fitted to the logarithms of the points inside the range."""
    n = POINTS - 1
    q = lambda i: F.col("q")[i]
    band = lambda lo, hi: (q(hi + 1) + q(hi) - q(lo) - q(lo - 1)) / 2
    lo, hi, top = -(-2 * n // 5), 3 * n // 5, -(-85 * n // 100)
    last = q(n) - q(n - 1)
    mean = ((q(1) - q(0)) + band(1, n - 1) + last) * n / POINTS + 1e-8
    mid, high = band(lo, hi) * n / (hi - lo + 1), (band(top, n - 1) + last) * n / (n - top + 1)
    unit = F.transform("q", lambda v, i: F.struct(F.log(i / n).alias("p"), ((v - q(0)) / F.greatest(q(n) - q(0), F.lit(1e-6))).alias("v")))
    inside = F.filter(F.slice(unit, 2, n - 1), lambda e: (e["v"] > 1e-3) & (e["v"] < 1))
    fold = lambda f: F.aggregate(inside, F.lit(0.0), lambda s, e: s + f(e))
    gamma = F.when(F.size(inside) < 4, 1.0).otherwise(clamp(fold(lambda e: e["p"] * F.log(e["v"])) / (fold(lambda e: e["p"] * e["p"]) + 1e-8), 0.2, 5))
    return df.withColumns({"black": q(0), "white": q(n), "gamma": gamma, "s_curve": mid / mean - 1, "rolloff": clamp((mean - high) / mean)})


def style_scores(sec: DataFrame) -> DataFrame:
    """``sec`` with a score from 0 to 1 for each look; ``local_contrast`` is read for the last one, ``hdr``."""
    c = F.col
    split = clamp((c("highs_b") - c("shadows_b")) / 25)
    rows = sec.withColumn("s_teal_orange", clamp(2 * F.sqrt(c("teal") * c("orange")) + 0.4 * split)).withColumn("lift_g", clamp(c("p2") * 4))
    dark, pale = 1 - c("mean_y"), 1 - c("mean_sat")
    return rows.withColumns({
        "s_vintage": clamp(0.4 * c("lift_g") + 0.3 * pale + 0.3 * bell(c("mean_lab_b"), 15, 12)),
        "s_commercial": clamp(0.35 * clamp(c("mean_y") * 1.4) + 0.35 * clamp(c("mean_sat") * 2.2) + 0.3 * clamp(c("std_y") * 4)),
        "s_natural": clamp(0.4 * bell(c("mean_lab_b"), 3, 10) + 0.3 * bell(c("mean_sat"), 0.3, 0.18) + 0.3 * bell(c("std_y"), 0.2, 0.12)),
        "s_low_key": clamp(0.6 * dark + 0.4 * c("shadow")),
        "s_high_key": clamp(0.5 * c("mean_y") + 0.3 * c("high") + 0.2 * (1 - clamp(c("std_y") * 4))),
        "s_moody": clamp(0.4 * dark + 0.3 * pale + 0.3 * bell(c("mean_lab_b"), -8, 12)),
        "s_film": clamp(0.4 * c("s_teal_orange") + 0.3 * c("lift_g") + 0.3 * bell(c("mean_sat"), 0.35, 0.2)),
        "s_hdr": clamp(0.5 * clamp((F.log2((c("p98") + 1e-4) / (c("p2") + 1e-4)) - 4) / 6) + 0.5 * clamp(c("local_contrast") * 12)),
    }).drop("lift_g")


def first_best(scores: list[tuple[str, Column]]) -> Column:
    """Structs (score, name) from the best on; equal scores keep the order given."""
    each = [F.struct(s.alias("score"), F.lit(-i).alias("place"), F.lit(n).alias("name")) for i, (n, s) in enumerate(scores)]
    return F.sort_array(F.array(*each), False)


def choose_style(scored: DataFrame) -> DataFrame:
    """``scored`` with style and style_confidence: the best of five looks, natural if none reaches 0.25."""
    c = F.col
    looks = [("commercial", c("s_commercial")), ("cinematic", F.greatest("s_teal_orange", "s_film")), ("natural", c("s_natural")), ("moody", c("s_moody")), ("vintage", c("s_vintage"))]
    rows = scored.withColumn("b_g", first_best(looks)[0])
    return rows.withColumn("style_confidence", c("b_g.score")).withColumn("style", F.when(c("b_g.score") < 0.25, "natural").otherwise(c("b_g.name"))).drop("b_g")


def naturalness() -> Column:
    return F.when(F.col("detected"), clamp(0.6 * bell(apart(F.col("skin_hue"), F.lit(25.0)), 0, 20) + 0.4 * bell(F.col("skin_sat"), 0.4, 0.25))).otherwise(0.0)


def readings() -> tuple[dict[str, Column], dict[str, Column]]:
    """(numbers, labels): the state of a frame by parameter, from the columns of ``style_scores`` and given local_contrast and laplacian."""
    c, yes = F.col, lambda x: x.cast("double")
    curve = F.when(c("s_curve") > 0.25, "strong_s").when(c("s_curve") > 0.08, "soft_s").when(c("s_curve") < -0.15, "faded").when(c("black") > 0.06, "lifted").otherwise("linear")
    skin = lambda x: F.when(c("detected"), x).otherwise(0.5)
    numbers = {
        "white_balance.temperature": c("kelvin"), "white_balance.tint": clamp(c("mean_a") / 60, -1) * 50,
        "primary.exposure": F.log2((c("mean_y") + 1e-3) / 0.45), "primary.contrast": (c("contrast") - 0.3) / 0.3 * 50,
        "primary.highlights": (c("high") - 0.2) * 150 - c("rolloff") * 30, "primary.shadows": (c("black") - 0.03) * 300 + (0.3 - c("shadow")) * 40,
        "primary.whites": (c("white") - 0.95) * 300, "primary.blacks": (c("black") - 0.02) * 300, "primary.gamma": c("gamma"),
        "presence.vibrance": (richness() - 0.4) * 100, "presence.saturation": (c("mean_sat") - 0.35) * 100, "presence.clarity": c("local_contrast") * 200,
        "presence.texture": c("laplacian") * 500, "presence.dehaze": (0.24 - c("contrast")) * 250,
        "tone_curve.shadow_lift": c("black"), "tone_curve.midtone": c("median") - 0.5, "tone_curve.highlight_rolloff": c("rolloff"), "tone_curve.contrast_strength": c("contrast") / 0.5,
        **{f"color_wheels.{w}_temp": c(f"{z}_warmth") / 25 * 100 for w, z in WHEELS}, **{f"color_wheels.{w}_strength": c(f"{z}_sat") for w, z in WHEELS},
        "split_toning.shadow_hue": c("shadows_hue"), "split_toning.shadow_sat": c("shadows_sat") * 100, "split_toning.highlight_hue": c("highs_hue"), "split_toning.highlight_sat": c("highs_sat") * 100,
        **{f"hsl.{b}": c(b) for b in ("orange_sat", "orange_lum", "blue_sat", "blue_lum")},
        "subject.skin_present": yes(c("detected")), "subject.skin_warmth": skin(clamp((40 - c("skin_hue")) / 60 + 0.5)), "subject.skin_luminance": skin(c("skin_lum")), "subject.subject_pop": clamp(c("local_contrast") * 10),
        "creative_style.cinematic": F.greatest("s_teal_orange", "s_film"), **{f"creative_style.{n}": c(f"s_{n}") for n in ("commercial", "natural", "moody")},
        "quality.highlight_clipping": yes(c("clip_hi") > 0.01), "quality.shadow_crush": yes(c("clip_lo") > 0.02), "quality.dynamic_range": c("stops"),
    }
    return numbers, {"tone_curve.curve_type": curve, "quality.noise_risk": bucket(c("mean_y"), [(0.2, "high"), (0.32, "medium")], "low")}


WHEELS = (("lift", "shadows"), ("gamma", "mids"), ("gain", "highs"))


def richness() -> Column:
    """Colourfulness of channels on 0..255, as a share of 110."""
    return clamp(F.col("colourfulness") * 255 / 110)


def measure(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, param, value, label): the 45 measured parameters, a row each; flags are 0 or 1, curve and noise are labels."""
    numbers, labels = readings()
    each = [F.struct(F.lit(n).alias("param"), v.alias("value"), F.lit(None).cast("string").alias("label")) for n, v in numbers.items()]
    each += [F.struct(F.lit(n).alias("param"), F.lit(None).cast("double").alias("value"), v.alias("label")) for n, v in labels.items()]
    return scored.select(*keys, F.explode(F.array(*each)).alias("e")).select(*keys, "e.*")


def recommend(styled: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, style, targets, curve, notes): ``targets`` maps each adjustable parameter to the state to grade toward; notes
    are in a fixed order, or say that little is to do. Needs the columns of ``choose_style``."""
    c, cur = F.col, readings()[0]
    aim = {k: F.create_map(*[F.lit(x) for n, s in STYLES.items() for x in (n, s[k])])[c("style")] for k in next(iter(STYLES.values()))}
    sep, lift = aim["teal_orange"], aim["shadow_lift"]
    steps = {
        "kelvin_aim": aim["temp"] - F.when(c("detected") & (naturalness() > 0.8), 150.0).otherwise(0.0),
        "tint_aim": cur["white_balance.tint"] * 0.4 + aim["tint"],
        "d_exposure": clamp(F.log2((F.when(c("detected"), 0.47).otherwise(0.45) + 1e-3) / (c("mean_y") + 1e-3)), -0.6, 0.6),
        "d_contrast": clamp((aim["contrast"] - c("contrast")) * 180, -30, 35),
        "d_high": -clamp(c("clip_hi") * 400, 0, 40),
        "d_shadow": clamp(c("clip_lo") * 300 + lift * 35, -20, 40),
        "d_vibrance": clamp(aim["vibrance"] + (0.4 - richness()) * 28, -12, 30),
        "d_clarity": clamp(aim["clarity"] + (0.05 - c("local_contrast")) * 120, 0, 25),
        "d_haze": clamp((0.24 - c("contrast")) * 45, 0, 12),
        "teal_heavy": (clamp(c("teal") * 3) > 0.5) & (clamp(c("orange") * 3) < 0.4),
        "sep": sep, "cool": clamp(sep * 0.55, 0, 0.7), "mild": clamp(sep * 0.2, 0, 0.3),
    }
    rows = styled.withColumns(steps)
    warm = F.when(c("teal_heavy"), clamp(clamp(c("sep") * 0.6, 0, 0.8) + 0.2)).otherwise(clamp(c("sep") * 0.6, 0, 0.8))
    base = F.when(c("detected") & (c("skin_lum") < 0.5), clamp((0.5 - c("skin_lum")) * 30, 0, 15)).otherwise(0.0)
    rows = rows.withColumn("warm", warm).withColumn("d_skin", F.when(c("teal_heavy"), clamp(base + 8, 0, 18)).otherwise(base))
    warm, clarity = c("warm"), cur["presence.clarity"] + c("d_clarity")
    targets = {
        "white_balance.temperature": c("kelvin_aim"), "white_balance.tint": c("tint_aim"),
        "primary.exposure": cur["primary.exposure"] + c("d_exposure"), "primary.contrast": cur["primary.contrast"] + c("d_contrast"),
        "primary.highlights": cur["primary.highlights"] + c("d_high"), "primary.shadows": cur["primary.shadows"] + c("d_shadow"),
        "primary.whites": cur["primary.whites"] + clamp((0.97 - c("white")) * 220, -15, 20),
        "primary.blacks": cur["primary.blacks"] + clamp((0.03 - c("black")) * 140 - lift * 20, -22, 12),
        "primary.gamma": c("gamma") + (1 - c("gamma")) * 0.3,
        "presence.vibrance": cur["presence.vibrance"] + c("d_vibrance"), "presence.saturation": cur["presence.saturation"] + clamp((0.32 - c("mean_sat")) * 40, 0, 10),
        "presence.clarity": clarity, "presence.texture": cur["presence.texture"] + clamp(aim["clarity"] * 0.6, 0, 15),
        "presence.dehaze": F.greatest(F.lit(0.0), cur["presence.dehaze"] - c("d_haze") * (250 / 45)),
        "tone_curve.shadow_lift": clamp(lift, 0, 0.4), "tone_curve.midtone": cur["tone_curve.midtone"] + clamp((0.45 - c("mean_y")) * 0.5, -0.2, 0.2),
        "tone_curve.highlight_rolloff": clamp(0.3 + c("clip_hi") * 3), "tone_curve.contrast_strength": clamp(aim["contrast"] + 0.15),
        "color_wheels.lift_temp": -c("cool") * 100, "color_wheels.lift_strength": c("cool"), "color_wheels.gamma_temp": c("mild") * 100,
        "color_wheels.gamma_strength": c("mild"), "color_wheels.gain_temp": warm * 100, "color_wheels.gain_strength": warm,
        "split_toning.shadow_hue": F.lit(210.0), "split_toning.shadow_sat": c("cool") * 40, "split_toning.highlight_hue": F.lit(40.0), "split_toning.highlight_sat": warm * 40,
        "hsl.orange_sat": c("orange_sat") + 8, "hsl.orange_lum": c("orange_lum") + c("d_skin"), "hsl.blue_sat": c("blue_sat") + (10 * c("sep") + 3), "hsl.blue_lum": c("blue_lum") - 8 * c("sep"),
        "subject.skin_warmth": clamp(0.45 + c("sep") * 0.25 + F.greatest(F.lit(0.0), clamp((6500 - c("kelvin_aim")) / 3000, -1)) * 0.3),
        "subject.skin_luminance": F.when(c("detected"), clamp(0.5 + (0.52 - c("skin_lum")))).otherwise(0.5), "subject.subject_pop": clamp(0.4 + clarity / 400 + c("sep") * 0.2),
    }
    shift = c("kelvin") - c("kelvin_aim")
    #: Notes to the editor and when they are due.
    due = [
        (shift > 400, "Increase warmth"), (shift < -400, "Reduce warmth"), (F.abs(c("tint_aim") - cur["white_balance.tint"]) > 6, "Neutralise tint"),
        (c("d_high") < -8, "Recover highlights"), (c("d_shadow") > 8, "Open up shadows"), (F.abs(c("d_exposure")) > 0.12, "Adjust exposure"),
        (c("d_contrast") > 8, "Add contrast"), (c("d_contrast") < -8, "Soften contrast"), (c("d_vibrance") > 8, "Boost vibrance"),
        (c("d_clarity") > 8, "Add clarity for perceived sharpness"), (c("d_haze") > 4, "Cut haze for punch"), (c("teal_heavy"), "Increase orange in highlights"),
        (c("sep") > 0.4, "Establish teal-orange separation"), (c("d_skin") > 4, "Brighten skin (orange luminance)"), (c("sep") > 0.4, "Deepen background blues for separation"),
    ]
    notes = F.array_compact(F.array(*[F.when(w, F.lit(t)) for w, t in due]))
    notes = F.when(F.size(notes) == 0, F.array(F.lit("Image is already well balanced; minimal changes."))).otherwise(notes)
    return rows.select(*keys, "style", F.create_map(*[x for n, v in targets.items() for x in (F.lit(n), v)]).alias("targets"), aim["curve"].alias("curve"), notes.alias("notes"))


def grade_summary(scored: DataFrame, keys: list[str], fit: Column | None = None) -> DataFrame:
    """(keys, brightness, contrast, temperature, colourfulness, skin, split, mood, top_styles, overall, confidence): labels of
    the measures, the three best looks, and how decided they are; ``fit`` of a harmony takes two fifths of the confidence."""
    c = F.col
    named = [("teal-orange", "teal_orange"), ("vintage", "vintage"), ("commercial", "commercial"), ("natural", "natural"), ("HDR", "hdr"), ("low-key", "low_key"), ("high-key", "high_key"), ("moody", "moody"), ("film", "film")]
    split = clamp(F.least(clamp(c("shadows_sat") * 2.5), clamp(c("highs_sat") * 2.5)) * (apart(c("shadows_hue"), c("highs_hue")) / 180) * 2)
    mids = F.greatest(F.lit(0.0), 1 - c("shadow") - c("high"))
    quality = clamp(0.5 * bell(c("mean_y"), 0.45, 0.18) + 0.3 * clamp(mids) + 0.2 * clamp(1 - 4 * (c("clip_lo") + c("clip_hi"))))
    rows = scored.withColumn("looks", first_best([(n, c(f"s_{s}")) for n, s in named]))
    best = c("looks")[0]
    confidence = 0.5 * best["score"] + 0.5 * quality if fit is None else 0.4 * fit + 0.3 * best["score"] + 0.3 * quality
    out = rows.select(
        *keys, bucket(c("mean_y"), [(0.2, "very dark"), (0.4, "dark"), (0.6, "balanced"), (0.8, "bright")], "very bright").alias("brightness"),
        bucket(c("contrast"), [(0.2, "flat/low"), (0.4, "moderate"), (0.65, "high")], "very high").alias("contrast"),
        bucket(c("kelvin"), [(3500, "very warm"), (5000, "warm"), (6500, "neutral-warm"), (8000, "neutral-cool")], "cool").alias("temperature"),
        bucket(richness(), [(0.2, "muted"), (0.45, "moderate"), (0.7, "vivid")], "very vivid").alias("colourfulness"),
        F.when(c("detected"), bucket(naturalness(), [(0.35, "unnatural"), (0.6, "acceptable"), (0.8, "natural")], "very natural")).otherwise("no significant skin detected").alias("skin"),
        split.alias("split"), best["name"].alias("mood"), F.array_join(F.transform(F.slice("looks", 1, 3), lambda e: e["name"]), ", ").alias("top_styles"), clamp(confidence).alias("confidence"),
    )
    return out.withColumn("overall", F.concat_ws(", ", "brightness", F.concat("contrast", F.lit(" contrast")), "temperature", F.concat("mood", F.lit(" look"))))


def slider(c: Column, lo: float = -100.0, hi: float = 100.0) -> Column:
    """``c`` as a whole step of a slider."""
    return F.bround(clamp(c, lo, hi)).cast("int")


def degrees(c: Column) -> Column:
    return F.pmod(F.bround(c), F.lit(360.0)).cast("int")


def ratio_to_kelvin(c: Column) -> Column:
    """Colour temperature of a ratio of red to blue: straight lines between the points of ``KELVIN``, its ends beyond them."""
    x = clamp(c, KELVIN[-1][1], KELVIN[0][1])
    pieces = [(x >= r1, k1 + (x - r1) / (r0 - r1) * (k0 - k1)) for (k0, r0), (k1, r1) in zip(KELVIN, KELVIN[1:])]
    return reduce(lambda w, p: w.when(*p), pieces[1:-1], F.when(*pieces[0])).otherwise(pieces[-1][1])


def neutral_white_balance(df: DataFrame, keys: list[str], neutral: float = 0.25) -> DataFrame:
    """(keys, temperature, tint, coverage, confidence) of the rows near grey. Rows weigh less the more saturated they are,
    clipped ones nothing. Where these weights are under 2 % of the rows all that aren't clipped count, else all rows; the
    sums of all three are taken in one pass. Confidence falls with few neutral rows and with how coloured they are."""
    y, sat = F.col("y_g"), F.col("sat")
    inside = ((y > 0.05) & (y < 0.95)).cast("double")
    weights = {"near": (1 - smoothstep(sat, neutral * 0.6, neutral * 1.8)) * inside, "open": inside, "all": F.lit(1.0)}
    rows = with_hsv(df).withColumn("y_g", luminance()).withColumns({f"w_{n}": w for n, w in weights.items()})
    sums = [F.struct(F.sum(f"w_{n}").alias("w"), *[F.sum(F.col(f"w_{n}") * F.col(c)).alias(c) for c in ("r", "g", "b", "sat")]).alias(n) for n in weights]
    s = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    s = s.withColumn("s", F.when(F.col("near.w") >= 0.02 * F.col("n"), F.col("near")).when(F.col("open.w") > 0, F.col("open")).otherwise(F.col("all")))
    mean = {c: F.when(F.col("s.w") < 1, 0.0).otherwise(F.try_divide(F.col(f"s.{c}"), F.col("s.w"))) for c in ("r", "g", "b", "sat")}
    level = F.greatest((mean["r"] + mean["g"] + mean["b"]) / 3, F.lit(1e-6))
    share = F.col("s.w") / F.col("n")
    temperature = F.bround(ratio_to_kelvin(mean["r"] / F.greatest(mean["b"], F.lit(1e-6))) / 50) * 50
    confidence = clamp(share / 0.25) * (0.4 + 0.6 * clamp(1 - mean["sat"] / neutral))
    return s.select(*keys, temperature.cast("int").alias("temperature"), slider(((mean["r"] + mean["b"]) / 2 - mean["g"]) / level * 250).alias("tint"), F.round(clamp(share), 3).alias("coverage"), F.round(confidence, 2).alias("confidence"))


def split_strength(df: DataFrame, keys: list[str], full: float = 0.4) -> DataFrame:
    """(keys, shadow_hue, shadow_sat, high_hue, high_sat, separation, balance, strength): tints of soft shadows and highlights.
    Strength is of the weaker end and grows with the distance of the hues up to 120 degrees; an end of weight under 1 is 0."""
    y = luminance()
    rows = with_hsv(df).withColumn("y_g", y).withColumn("w_shadow", 1 - smoothstep(y, 0.15, 0.55)).withColumn("w_high", smoothstep(y, 0.45, 0.85))
    a = F.radians("hue")
    parts = [F.struct(F.sum(w).alias("w"), F.sum(F.col(w) * F.col("sat")).alias("sat"), F.sum(F.col(w) * F.col("sat") * F.cos(a)).alias("c"), F.sum(F.col(w) * F.col("sat") * F.sin(a)).alias("s")).alias(w[2:]) for w in ("w_shadow", "w_high")]
    s = rows.groupBy(*keys).agg(F.percentile("y_g", F.lit(0.5)).alias("median"), *parts)
    for e in ("shadow", "high"):
        hue = F.when((F.col(f"{e}.w") < 1) | (F.col(f"{e}.sat") < 1e-6), 0).otherwise(degrees(turned(F.col(f"{e}.s"), F.col(f"{e}.c"))))
        sat = F.when(F.col(f"{e}.w") < 1, 0).otherwise(slider(F.try_divide(F.col(f"{e}.sat"), F.col(f"{e}.w")) / full * 100, 0))
        s = s.withColumn(f"{e}_hue", hue).withColumn(f"{e}_sat", sat)
    s = s.withColumn("separation", apart(F.col("shadow_hue"), F.col("high_hue")).cast("int"))
    return s.select(*keys, "shadow_hue", "shadow_sat", "high_hue", "high_sat", "separation", slider((F.col("median") - 0.5) / 0.5 * 100).alias("balance"), slider(F.least("shadow_sat", "high_sat") * clamp(F.col("separation") / 120.0), 0).alias("strength"))


def mask_tone(df: DataFrame, keys: list[str], least: float = 0.005, reference: float = 25.0) -> DataFrame:
    """(keys, detected, coverage, hue, saturation, luminance, tone, warmth) of the rows that may be skin: warm hue, some
    saturation, neither dark nor blown, red over green over blue. Zeros and ``none`` where under ``least`` of the rows are."""
    r, g, b, hue, sat, val = (F.col(c) for c in ("r", "g", "b", "hue", "sat", "val"))
    rule = (hue >= 0) & (hue <= 50) & (sat >= 0.15) & (sat <= 0.7) & (val >= 0.2) & (val <= 0.98) & (r > g) & (g > b) & (r - g > 0.035)
    a = F.radians("hue")
    s = with_hsv(df).groupBy(*keys).agg(
        F.avg(rule.cast("double")).alias("coverage"), F.avg(F.when(rule, sat)).alias("m_sat"), F.avg(F.when(rule, luminance())).alias("m_lum"),
        turned(F.sum(F.when(rule, sat * F.sin(a))), F.sum(F.when(rule, sat * F.cos(a)))).alias("m_hue"),
    )
    depth = bucket(F.col("m_lum"), [(0.28, "deep"), (0.45, "medium-deep"), (0.62, "medium"), (0.78, "light")], "fair")
    warmth = bucket(F.col("m_hue"), [(18.0, "ruddy"), (30.0, "warm"), (40.0, "neutral")], "sallow")
    found = F.col("coverage") >= least
    put = lambda c, n, none=0: F.when(found, c).otherwise(none).alias(n)
    return s.select(
        *keys, found.alias("detected"), F.round("coverage", 3).alias("coverage"), put(degrees(F.col("m_hue")), "hue"), put(slider(F.col("m_sat") * 100, 0), "saturation"),
        put(slider(F.col("m_lum") * 100, 0), "luminance"), put(F.concat_ws(" ", depth, warmth), "tone", "none"), put(slider((reference - F.col("m_hue")) / 20 * 100), "warmth"),
    )
