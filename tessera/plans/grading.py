"""Queries for grades, with line items as pixels of the frame of their supplier; local contrast is the mean deviation within columns of a frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grading as G
from ..operators import measure as M
from .measurement import HSV, K, LAB, Y, px, rounded
from .registry import query
from .views import sql

clip = lambda x, lo=0.0, hi=1.0: f"least({hi}::double, greatest({lo}::double, {x}))"
bell = lambda x, at, w: f"exp(-pow({x} - ({at}), 2) / (2.0 * {w} * {w}))"
angle = lambda s, c: f"coalesce((degrees(atan2({s}, {c})) + 360) % 360, 0.0)"
apart = lambda a, b: f"abs((({a}) - ({b}) + 540) % 360 - 180)"

ZONES = {"shadows": "lum < 0.33", "mids": "lum >= 0.33 and lum <= 0.66", "highs": "lum > 0.66"}
SKIN = "(cr between 133.0 / 255 and 173.0 / 255 and cb between 77.0 / 255 and 127.0 / 255 and (hue <= 50 or hue >= 340) and sat > 0.1 and lum > 0.15 and lum < 0.98)"
AGG = ", ".join(
    [
        "frame_id, avg(lum) as mean_y, stddev_pop(lum) as std_y",
        "quantile_cont(lum, [" + ", ".join([f"{i}/63.0" for i in range(64)] + ["0.01", "0.02", "0.05", "0.5", "0.95", "0.98", "0.99"]) + "]) as q",
        "avg((lum < 0.25)::int) as shadow, avg((lum > 0.75)::int) as high, avg((lum < 0.02)::int) as clip_lo, avg((lum > 0.98)::int) as clip_hi",
        "avg(sat) as mean_sat, avg(lab_a) as mean_a, avg(lab_b) as mean_lab_b, avg(r) as r, avg(g) as g, avg(b) as b",
        "sqrt(var_pop(r - g) + var_pop((r + g) / 2 - b)) + 0.3 * sqrt(pow(avg(r - g), 2) + pow(avg((r + g) / 2 - b), 2)) as colourfulness",
        "coalesce(sum(sat) filter (hue between 160 and 210), 0) / (sum(sat) + 1e-8) as teal, coalesce(sum(sat) filter (hue between 15 and 55), 0) / (sum(sat) + 1e-8) as orange",
    ]
    + [f"coalesce(avg({v}) filter (hue between {a} and {z}) - avg({v}), 0) * 100 as {n}_{p}" for n, a, z in (("orange", 15, 55), ("blue", 200, 260)) for p, v in (("sat", "sat"), ("lum", "lum"))]
    + [f"{angle(f'sum(sat * sin(radians(hue))) filter ({z})', f'sum(sat * cos(radians(hue))) filter ({z})')} as {n}_hue, coalesce(avg(sat) filter ({z}), 0) as {n}_sat, coalesce(avg((lab_a + lab_b) / 2) filter ({z}), 0) as {n}_warmth, coalesce(avg(lab_b) filter ({z}), 0) as {n}_b" for n, z in ZONES.items()]
    + [f"avg({SKIN}::int) as skin_share, {angle(f'sum(sin(radians(hue))) filter ({SKIN})', f'sum(cos(radians(hue))) filter ({SKIN})')} as skin_hue, coalesce(avg(sat) filter ({SKIN}), 0) as skin_sat, coalesce(avg(lum) filter ({SKIN}), 0) as skin_lum"]
)
LINEAR = "case when {c} <= 0.04045 then {c} / 12.92 else pow(({c} + 0.055) / 1.055, 2.4) end"
SLOPE = "list_transform(range(1, 65), lambda i: case when i = 1 then (q[2] - q[1]) * 63 when i = 64 then (q[64] - q[63]) * 63 else (q[i + 1] - q[i - 1]) * 63 / 2 end)"
UNIT = "list_filter(list_transform(range(2, 64), lambda i: {'p': ln((i - 1) / 63.0), 'v': (q[i] - q[1]) / greatest(q[64] - q[1], 1e-6)}), lambda e: e.v > 1e-3 and e.v < 1)"
SEC = (
    f"{HSV}, {LAB.replace('from pixels', 'from hs')}, gx as (select *, {Y} as lum, (r - (0.299 * r + 0.587 * g + 0.114 * b)) * 0.713 + 0.5 as cr, (b - (0.299 * r + 0.587 * g + 0.114 * b)) * 0.564 + 0.5 as cb from lab), "
    "lc as (select frame_id, avg(sd) as local_contrast, avg(v) as laplacian from (select frame_id, x, stddev_pop(lum) as sd, var_pop(lum) as v from gx group by all) group by 1), "
    f"ag as (select {AGG} from gx group by frame_id), "
    f"wb as (select *, {', '.join(LINEAR.format(c=c) + f' as l{c}' for c in 'rgb')} from ag), "
    "wx as (select *, 0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb as cx, 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb as cy, 0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb as cz from wb), "
    "wn as (select *, (cx / (cx + cy + cz + 1e-8) - 0.3320) / (0.1858 - cy / (cx + cy + cz + 1e-8) + 1e-8) as nn from wx), "
    f"wt as (select *, {SLOPE} as slopes, {UNIT} as unit from wn), "
    "sec as (select * exclude (slopes, unit), q[1] as black, q[64] as white, q[65] as p1, q[66] as p2, q[67] as p5, q[68] as median, q[69] as p95, q[70] as p98, q[71] as p99, p95 - p5 as contrast, log2((p99 + 1e-4) / (p1 + 1e-4)) as stops, skin_share >= 0.005 as detected, "
    f"{clip('449 * pow(nn, 3) + 3525 * pow(nn, 2) + 6823.3 * nn + 5520.33', 1000, 40000)} as kelvin, "
    f"case when len(unit) < 4 then 1.0 else {clip('list_sum(list_transform(unit, lambda e: e.p * ln(e.v))) / (list_sum(list_transform(unit, lambda e: e.p * e.p)) + 1e-8)', 0.2, 5)} end as gamma, "
    f"list_avg(slopes) + 1e-8 as slope, list_avg(slopes[27:38]) / slope - 1 as s_curve, {clip('(slope - list_avg(slopes[55:64])) / slope')} as rolloff, local_contrast, laplacian, {clip('colourfulness * 255 / 110')} as rich from wt join lc using (frame_id))"
)
DARK, PALE = "(1 - mean_y)", "(1 - mean_sat)"
SCORED = (
    f"{SEC}, sc as (select *, {clip(f'2 * sqrt(teal * orange) + 0.4 * ' + clip('(highs_b - shadows_b) / 25'))} as s_teal_orange, {clip('p2 * 4')} as lift, "
    f"{clip(f'0.4 * lift + 0.3 * {PALE} + 0.3 * ' + bell('mean_lab_b', 15, 12))} as s_vintage, "
    f"{clip('0.35 * ' + clip('mean_y * 1.4') + ' + 0.35 * ' + clip('mean_sat * 2.2') + ' + 0.3 * ' + clip('std_y * 4'))} as s_commercial, "
    f"{clip('0.4 * ' + bell('mean_lab_b', 3, 10) + ' + 0.3 * ' + bell('mean_sat', 0.3, 0.18) + ' + 0.3 * ' + bell('std_y', 0.2, 0.12))} as s_natural, "
    f"{clip(f'0.6 * {DARK} + 0.4 * shadow')} as s_low_key, {clip('0.5 * mean_y + 0.3 * high + 0.2 * (1 - ' + clip('std_y * 4') + ')')} as s_high_key, "
    f"{clip(f'0.4 * {DARK} + 0.3 * {PALE} + 0.3 * ' + bell('mean_lab_b', -8, 12))} as s_moody, "
    f"{clip('0.4 * s_teal_orange + 0.3 * lift + 0.3 * ' + bell('mean_sat', 0.35, 0.2))} as s_film, "
    f"{clip('0.5 * ' + clip('(log2((p98 + 1e-4) / (p2 + 1e-4)) - 4) / 6') + ' + 0.5 * ' + clip('local_contrast * 12'))} as s_hdr, greatest(s_teal_orange, s_film) as s_cinematic from sec)"
)
STYLED = SCORED + ", st as (select *, greatest(s_commercial, s_cinematic, s_natural, s_moody, s_vintage) as style_confidence, case when style_confidence < 0.25 then 'natural' when s_commercial = style_confidence then 'commercial' when s_cinematic = style_confidence then 'cinematic' when s_natural = style_confidence then 'natural' when s_moody = style_confidence then 'moody' else 'vintage' end as style from sc)"
NATURAL = f"case when detected then {clip('0.6 * ' + bell(apart('skin_hue', 25), 0, 20) + ' + 0.4 * ' + bell('skin_sat', 0.4, 0.25))} else 0 end"
SCORES = ("teal_orange", "vintage", "commercial", "natural", "low_key", "high_key", "moody", "film", "hdr")


def steady(c):
    """A number cut to six places from an offset that no decimal meets; the last bit would turn a tie either way."""
    return F.floor(F.col(c) * 1e6 + 0.3719) / 1e6 + 0.0


def scored(s, d):
    cells = px(s, d).withColumn("y_q", M.luminance()).groupBy(*K, "x").agg(F.stddev_pop("y_q").alias("sd"), F.var_pop("y_q").alias("v"))
    return G.style_scores(G.sections(px(s, d), K).join(cells.groupBy(*K).agg(F.avg("sd").alias("local_contrast"), F.avg("v").alias("laplacian")), K))


@query("c15_style_scores", sql(f"with {SCORED} select frame_id, {', '.join(f'round(s_{n}, 6) as s_{n}' for n in SCORES)}, round({clip('teal * 3')}, 6) as teal, round({clip('orange * 3')}, 6) as orange, round(orange_sat, 6) as orange_sat, round(orange_lum, 6) as orange_lum, round(blue_sat, 6) as blue_sat, round(blue_lum, 6) as blue_lum from sc", "pixels"))
def c15(s, d):
    out = scored(s, d).select(*K, *[f"s_{n}" for n in SCORES], *[G.clamp(F.col(c) * 3).alias(c) for c in ("teal", "orange")], "orange_sat", "orange_lum", "blue_sat", "blue_lum")
    return rounded(out, *K, n=6)


#: Each measured number by parameter, in SQL.
NUMBERS = {
    "white_balance.temperature": "kelvin", "white_balance.tint": clip("mean_a / 60", -1) + " * 50",
    "primary.exposure": "log2((mean_y + 0.001) / 0.45)", "primary.contrast": "(contrast - 0.3) / 0.3 * 50",
    "primary.highlights": "(high - 0.2) * 150 - rolloff * 30", "primary.shadows": "(black - 0.03) * 300 + (0.3 - shadow) * 40",
    "primary.whites": "(white - 0.95) * 300", "primary.blacks": "(black - 0.02) * 300", "primary.gamma": "gamma",
    "presence.vibrance": "(rich - 0.4) * 100", "presence.saturation": "(mean_sat - 0.35) * 100", "presence.clarity": "local_contrast * 200", "presence.texture": "laplacian * 500", "presence.dehaze": "(0.24 - contrast) * 250",
    "tone_curve.shadow_lift": "black", "tone_curve.midtone": "median - 0.5", "tone_curve.highlight_rolloff": "rolloff", "tone_curve.contrast_strength": "contrast * 2",
    "color_wheels.lift_temp": "shadows_warmth * 4", "color_wheels.lift_strength": "shadows_sat", "color_wheels.gamma_temp": "mids_warmth * 4", "color_wheels.gamma_strength": "mids_sat", "color_wheels.gain_temp": "highs_warmth * 4", "color_wheels.gain_strength": "highs_sat",
    "split_toning.shadow_hue": "shadows_hue", "split_toning.shadow_sat": "shadows_sat * 100", "split_toning.highlight_hue": "highs_hue", "split_toning.highlight_sat": "highs_sat * 100",
    "hsl.orange_sat": "orange_sat", "hsl.orange_lum": "orange_lum", "hsl.blue_sat": "blue_sat", "hsl.blue_lum": "blue_lum",
    "subject.skin_present": "detected::int", "subject.skin_warmth": f"case when detected then {clip('(40 - skin_hue) / 60 + 0.5')} else 0.5 end", "subject.skin_luminance": "case when detected then skin_lum else 0.5 end", "subject.subject_pop": clip("local_contrast * 10"),
    "creative_style.cinematic": "s_cinematic", "creative_style.commercial": "s_commercial", "creative_style.natural": "s_natural", "creative_style.moody": "s_moody",
    "quality.highlight_clipping": "(clip_hi > 0.01)::int", "quality.shadow_crush": "(clip_lo > 0.02)::int", "quality.dynamic_range": "stops",
}
LABELS = {
    "tone_curve.curve_type": "case when s_curve > 0.25 then 'strong_s' when s_curve > 0.08 then 'soft_s' when s_curve < -0.15 then 'faded' when black > 0.06 then 'lifted' else 'linear' end",
    "quality.noise_risk": "case when mean_y < 0.2 then 'high' when mean_y < 0.32 then 'medium' else 'low' end",
}
listed = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"


@query("c21_measure", sql(f"with {SCORED}, l as (select frame_id, unnest({listed([*NUMBERS, *LABELS])}) as param, unnest([{', '.join([f'({v})::double' for v in NUMBERS.values()] + ['null'] * len(LABELS))}]) as value, unnest([{', '.join(['null'] * len(NUMBERS) + list(LABELS.values()))}]) as label from sc) select frame_id, param, floor(value * 1e6 + 0.3719) / 1e6 + 0.0 as value, label from l", "pixels"))
def c21(s, d):
    return G.measure(scored(s, d), K).withColumn("value", steady("value"))


@query("c22_choose_style", sql(f"with {STYLED} select frame_id, style, round(style_confidence, 6) as style_confidence from st", "pixels"))
def c22(s, d):
    return rounded(G.choose_style(scored(s, d)).select(*K, "style", "style_confidence"), *K, n=6)


AIMS = "aim(style, a_temp, a_contrast, a_vibrance, a_clarity, a_sep, a_lift, a_tint, curve) as (values ('commercial', 5900.0, 0.36, 16.0, 12.0, 0.45, 0.08, 0.0, 'gentle_s'), ('cinematic', 6200.0, 0.30, 6.0, 6.0, 0.80, 0.18, 0.0, 'filmic'), ('natural', 6300.0, 0.28, 5.0, 4.0, 0.15, 0.05, 0.0, 'linear'), ('moody', 6700.0, 0.33, -4.0, 7.0, 0.55, 0.22, 0.0, 'filmic'), ('vintage', 5600.0, 0.24, -6.0, 2.0, 0.35, 0.26, 4.0, 'faded'))"
AIMED = (
    f"{STYLED}, {AIMS}, rc as (select *, a_temp - case when detected and {NATURAL} > 0.8 then 150 else 0 end as k_aim, ({NUMBERS['white_balance.tint']}) as tint_now, tint_now * 0.4 + a_tint as t_aim, "
    f"{clip('log2((case when detected then 0.47 else 0.45 end + 0.001) / (mean_y + 0.001))', -0.6, 0.6)} as d_exp, {clip('(a_contrast - contrast) * 180', -30, 35)} as d_con, -{clip('clip_hi * 400', 0, 40)} as d_high, {clip('clip_lo * 300 + a_lift * 35', -20, 40)} as d_sha, "
    f"{clip('a_vibrance + (0.4 - rich) * 28', -12, 30)} as d_vib, {clip('a_clarity + (0.05 - local_contrast) * 120', 0, 25)} as d_cla, {clip('(0.24 - contrast) * 45', 0, 12)} as d_haz, "
    f"({clip('teal * 3')} > 0.5 and {clip('orange * 3')} < 0.4) as heavy, {clip('a_sep * 0.55', 0, 0.7)} as cool, {clip('a_sep * 0.2', 0, 0.3)} as mild, case when heavy then {clip(clip('a_sep * 0.6', 0, 0.8) + ' + 0.2')} else {clip('a_sep * 0.6', 0, 0.8)} end as warm, "
    f"case when detected and skin_lum < 0.5 then {clip('(0.5 - skin_lum) * 30', 0, 15)} else 0 end as base, case when heavy then {clip('base + 8', 0, 18)} else base end as d_skin, local_contrast * 200 + d_cla as clarity from st join aim using (style))"
)
now = lambda p, more: f"({NUMBERS[p]}) + {more}"
TARGETS = {
    "white_balance.temperature": "k_aim", "white_balance.tint": "t_aim", "primary.exposure": now("primary.exposure", "d_exp"), "primary.contrast": now("primary.contrast", "d_con"),
    "primary.highlights": now("primary.highlights", "d_high"), "primary.shadows": now("primary.shadows", "d_sha"), "primary.whites": now("primary.whites", clip("(0.97 - white) * 220", -15, 20)),
    "primary.blacks": now("primary.blacks", clip("(0.03 - black) * 140 - a_lift * 20", -22, 12)), "primary.gamma": "gamma + (1 - gamma) * 0.3",
    "presence.vibrance": now("presence.vibrance", "d_vib"), "presence.saturation": now("presence.saturation", clip("(0.32 - mean_sat) * 40", 0, 10)), "presence.clarity": "clarity",
    "presence.texture": now("presence.texture", clip("a_clarity * 0.6", 0, 15)), "presence.dehaze": f"greatest(0.0, {NUMBERS['presence.dehaze']} - d_haz * 250 / 45)",
    "tone_curve.shadow_lift": clip("a_lift", 0, 0.4), "tone_curve.midtone": now("tone_curve.midtone", clip("(0.45 - mean_y) * 0.5", -0.2, 0.2)),
    "tone_curve.highlight_rolloff": clip("0.3 + clip_hi * 3"), "tone_curve.contrast_strength": clip("a_contrast + 0.15"),
    "color_wheels.lift_temp": "-cool * 100", "color_wheels.lift_strength": "cool", "color_wheels.gamma_temp": "mild * 100", "color_wheels.gamma_strength": "mild", "color_wheels.gain_temp": "warm * 100", "color_wheels.gain_strength": "warm",
    "split_toning.shadow_hue": "210", "split_toning.shadow_sat": "cool * 40", "split_toning.highlight_hue": "40", "split_toning.highlight_sat": "warm * 40",
    "hsl.orange_sat": "orange_sat + 8", "hsl.orange_lum": "orange_lum + d_skin", "hsl.blue_sat": "blue_sat + 10 * a_sep + 3", "hsl.blue_lum": "blue_lum - 8 * a_sep",
    "subject.skin_warmth": clip(f"0.45 + a_sep * 0.25 + greatest(0.0, {clip('(6500 - k_aim) / 3000', -1)}) * 0.3"),
    "subject.skin_luminance": f"case when detected then {clip('0.5 + (0.52 - skin_lum)')} else 0.5 end", "subject.subject_pop": clip("0.4 + clarity / 400 + a_sep * 0.2"),
}
NOTES = [
    ("kelvin - k_aim > 400", "Increase warmth"), ("kelvin - k_aim < -400", "Reduce warmth"), ("abs(t_aim - tint_now) > 6", "Neutralise tint"), ("d_high < -8", "Recover highlights"), ("d_sha > 8", "Open up shadows"),
    ("abs(d_exp) > 0.12", "Adjust exposure"), ("d_con > 8", "Add contrast"), ("d_con < -8", "Soften contrast"), ("d_vib > 8", "Boost vibrance"), ("d_cla > 8", "Add clarity for perceived sharpness"),
    ("d_haz > 4", "Cut haze for punch"), ("heavy", "Increase orange in highlights"), ("a_sep > 0.4", "Establish teal-orange separation"), ("d_skin > 4", "Brighten skin (orange luminance)"), ("a_sep > 0.4", "Deepen background blues for separation"),
]


@query("c23_recommend", sql(f"with {AIMED}, l as (select frame_id, unnest({listed(TARGETS)}) as param, unnest([{', '.join(f'({v})::double' for v in TARGETS.values())}]) as recommended from rc) select frame_id, param, floor(recommended * 1e6 + 0.3719) / 1e6 + 0.0 as recommended from l", "pixels"))
def c23(s, d):
    out = G.recommend(G.choose_style(scored(s, d)), K)
    return out.select(*K, F.explode("targets").alias("param", "recommended")).withColumn("recommended", steady("recommended"))


@query("c23_notes", sql(f"with {AIMED} select frame_id, style, curve, coalesce(nullif(concat_ws('; ', {', '.join(f'case when {w} then ' + repr(t) + ' end' for w, t in NOTES)}), ''), 'Image is already well balanced; minimal changes.') as notes from rc", "pixels"))
def c23_notes(s, d):
    return G.recommend(G.choose_style(scored(s, d)), K).select(*K, "style", "curve", F.array_join("notes", "; ").alias("notes"))


LOOKS = {"teal-orange": "teal_orange", "vintage": "vintage", "commercial": "commercial", "natural": "natural", "HDR": "hdr", "low-key": "low_key", "high-key": "high_key", "moody": "moody", "film": "film"}
QUALITY = clip("0.5 * " + bell("mean_y", 0.45, 0.18) + " + 0.3 * greatest(0.0, 1 - shadow - high) + 0.2 * " + clip("1 - 4 * (clip_lo + clip_hi)"))
SPLIT = clip(f"least({clip('shadows_sat * 2.5')}, {clip('highs_sat * 2.5')}) * ({apart('shadows_hue', 'highs_hue')} / 180) * 2")


@query("c30_grade_summary", sql(f"with {SCORED}, lk as (select frame_id, unnest({listed(LOOKS)}) as name, unnest(range({len(LOOKS)})) as place, unnest([{', '.join(f's_{v}' for v in LOOKS.values())}]) as score from sc), tp as (select frame_id, list(name order by score desc, place) as names, max(score) as best from lk group by 1), su as (select frame_id, case when mean_y < 0.2 then 'very dark' when mean_y < 0.4 then 'dark' when mean_y < 0.6 then 'balanced' when mean_y < 0.8 then 'bright' else 'very bright' end as brightness, case when contrast < 0.2 then 'flat/low' when contrast < 0.4 then 'moderate' when contrast < 0.65 then 'high' else 'very high' end as contrast, case when kelvin < 3500 then 'very warm' when kelvin < 5000 then 'warm' when kelvin < 6500 then 'neutral-warm' when kelvin < 8000 then 'neutral-cool' else 'cool' end as temperature, case when rich < 0.2 then 'muted' when rich < 0.45 then 'moderate' when rich < 0.7 then 'vivid' else 'very vivid' end as colourfulness, case when not detected then 'no significant skin detected' when {NATURAL} < 0.35 then 'unnatural' when {NATURAL} < 0.6 then 'acceptable' when {NATURAL} < 0.8 then 'natural' else 'very natural' end as skin, {SPLIT} as split, {QUALITY} as quality from sc) select frame_id, brightness, contrast, temperature, colourfulness, skin, round(split, 6) as split, names[1] as mood, array_to_string(names[1:3], ', ') as top_styles, round({clip('0.5 * best + 0.5 * quality')}, 6) as confidence, brightness || ', ' || contrast || ' contrast, ' || temperature || ', ' || names[1] || ' look' as overall from su join tp using (frame_id)", "pixels"))
def c30(s, d):
    return rounded(G.grade_summary(scored(s, d), K), *K, n=6)


smooth = lambda x, lo, hi: "(" + (t := clip(f"({x} - {lo}) / ({hi} - {lo})")) + f" * {t} * (3 - 2 * {t}))"
STEPS = ((2000, 3.30), (2500, 2.42), (3000, 1.92), (3500, 1.60), (4000, 1.39), (4500, 1.24), (5000, 1.13), (5500, 1.05), (6500, 1.00), (7500, 0.92), (9000, 0.84), (11000, 0.77), (12000, 0.74))


@query("c36_neutral_white_balance", sql(f"with {HSV}, lu as (select *, {Y} as lum from hs), w as (select *, (lum > 0.05 and lum < 0.95)::int as inside, (1 - {smooth('sat', 0.15, 0.45)}) * inside as near from lu), u as (select *, case when sum(near) over p >= 0.02 * count(*) over p then near when sum(inside) over p > 0 then inside::double else 1.0 end as w from w window p as (partition by frame_id)), m as (select frame_id, count(*) as n, sum(w) as sw, case when sum(w) < 1 then 0 else sum(w * r) / sum(w) end as r, case when sum(w) < 1 then 0 else sum(w * g) / sum(w) end as g, case when sum(w) < 1 then 0 else sum(w * b) / sum(w) end as b, case when sum(w) < 1 then 0 else sum(w * sat) / sum(w) end as sat from u group by 1), t(k, rt) as (values {', '.join(f'({k}.0, {r})' for k, r in STEPS)}), ts as (select k as k0, rt as r0, lead(k) over (order by k) as k1, lead(rt) over (order by k) as r1 from t), x as (select *, {clip('r / greatest(b, 1e-6)', 0.74, 3.30)} as rb from m) select frame_id, (round_even((k1 + (rb - r1) / (r0 - r1) * (k0 - k1)) / 50, 0) * 50)::int as temperature, round_even({clip('((r + b) / 2 - g) / greatest((r + g + b) / 3, 1e-6) * 250', -100, 100)}, 0)::int as tint, round(least(1.0, sw / n), 3) as coverage, round({clip('sw / n / 0.25')} * (0.4 + 0.6 * {clip('1 - sat / 0.25')}), 2) as confidence from x join ts on r1 is not null and rb >= r1 and (rb < r0 or r0 = 3.30)", "pixels"))
def c36(s, d):
    return G.neutral_white_balance(px(s, d), K)


ENDS = {"shadow": f"(1 - {smooth('lum', 0.15, 0.55)})", "high": smooth("lum", 0.45, 0.85)}
whole = lambda x, lo=-100, hi=100: f"round_even({clip(x, lo, hi)}, 0)::int"


@query("c37_split_strength", sql(f"with {HSV}, lu as (select *, {Y} as lum from hs), w as (select *, {', '.join(f'{w} as {n}' for n, w in ENDS.items())} from lu), s as (select frame_id, quantile_cont(lum, 0.5) as median, " + ", ".join(f"sum({n}) as {n}_w, sum({n} * sat) as {n}_t, sum({n} * sat * cos(radians(hue))) as {n}_c, sum({n} * sat * sin(radians(hue))) as {n}_s" for n in ENDS) + " from w group by 1), e as (select frame_id, median, " + ", ".join(f"case when {n}_w < 1 or {n}_t < 1e-6 then 0 else round_even({angle(f'{n}_s', f'{n}_c')}, 0)::int % 360 end as {n}_hue, case when {n}_w < 1 then 0 else {whole(f'{n}_t / {n}_w / 0.4 * 100', 0)} end as {n}_sat" for n in ENDS) + f" from s) select frame_id, shadow_hue, shadow_sat, high_hue, high_sat, {apart('shadow_hue', 'high_hue')}::int as separation, {whole('(median - 0.5) / 0.5 * 100')} as balance, {whole('least(shadow_sat, high_sat) * ' + clip('separation / 120.0'), 0)} as strength from e", "pixels"))
def c37(s, d):
    return G.split_strength(px(s, d), K)


MASK = "(hue between 0 and 50 and sat between 0.15 and 0.7 and val between 0.2 and 0.98 and r > g and g > b and r - g > 0.035)"


@query("c38_mask_tone", sql(f"with {HSV}, lu as (select *, {Y} as lum, {MASK} as mk from hs), s as (select frame_id, avg(mk::int) as cov, avg(sat) filter (mk) as ms, avg(lum) filter (mk) as ml, {angle('sum(sat * sin(radians(hue))) filter (mk)', 'sum(sat * cos(radians(hue))) filter (mk)')} as mh, cov >= 0.005 as found from lu group by 1) select frame_id, found as detected, round(cov, 3) as coverage, case when found then round_even(mh, 0)::int % 360 else 0 end as hue, case when found then {whole('ms * 100', 0)} else 0 end as saturation, case when found then {whole('ml * 100', 0)} else 0 end as luminance, case when not found then 'none' else case when ml < 0.28 then 'deep' when ml < 0.45 then 'medium-deep' when ml < 0.62 then 'medium' when ml < 0.78 then 'light' else 'fair' end || ' ' || case when mh < 18 then 'ruddy' when mh < 30 then 'warm' when mh < 40 then 'neutral' else 'sallow' end end as tone, case when found then {whole('(25 - mh) / 20 * 100')} else 0 end as warmth from s", "pixels"))
def c38(s, d):
    return G.mask_tone(px(s, d), K)
