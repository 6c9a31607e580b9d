"""Queries of the profile, component and segment operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docgrid.operators import profiles
from docgrid.plans.fixtures import frame
from docgrid.plans.text_queries import query

_BANDS = """m as (select *, max(v) over (partition by img_id) as m, max(y) over (partition by img_id) + 1 as h from {profile}), r as (select *, y - row_number() over (partition by img_id order by y) as g from m where m > 0 and v >= m * 12e-2),
bands as (select img_id, min(y) as y1, case when max(y) + 1 = max(h) then max(h) - 1 else max(y) + 1 end as y2, avg(v) as score from r group by img_id, g having max(y) + 1 - min(y) >= 6)"""
_TOP = "top as (select *, row_number() over (partition by img_id order by y1) as band from (select * from bands qualify row_number() over (partition by img_id order by score * (y2 - y1) desc, y1) <= 2) t)"
_SPLIT = """one as (select *, count(*) over (partition by img_id) as n from bands), c as (select *, greatest(y1 + 6, y1 + floor((y2 - y1) * 3e-1)) as lo, least(y2 - 6, y1 + floor((y2 - y1) * 7e-1)) as hi from one where n = 1 and y2 - y1 >= 18),
cuts as (select c.img_id, c.y1, c.y2, arg_min(p.y, p.v * 1000 + p.y) as pos from c join {profile} p on p.img_id = c.img_id and p.y >= lo and p.y < hi where hi > lo group by all),
parts as (select img_id, y1, pos as y2 from cuts union all select img_id, pos, y2 from cuts),
splits as (select * from bands b where not exists (select 1 from cuts where cuts.img_id = b.img_id and cuts.y1 = b.y1) union all select parts.img_id, y1, y2, avg(v) from parts join {profile} p on p.img_id = parts.img_id and p.y >= y1 and p.y < y2 group by parts.img_id, y1, y2)"""
_SEP = "mids as (select *, cast(round_even((y1 + y2) / 2, 0) as int) as c from top), nx as (select *, lead(c) over (partition by img_id order by y1) as d from mids), seps as (select nx.img_id, band, arg_min(p.y, p.v * 1000 + p.y) as separator from nx join {profile} p on p.img_id = nx.img_id and p.y between least(c, d) and greatest(c, d) where d is not null group by nx.img_id, band)"

_p = lambda spark, d: profiles.as_arrays(frame(spark, d, "profile"))
_bands = lambda spark, d: profiles.profile_bands(_p(spark, d))


def _top(spark, d):
    return profiles.top_bands(_bands(spark, d))


@query("B1_profile_bands", f"with {_BANDS} select * from bands")
def b1(spark, d):
    return profiles.band_rows(_bands(spark, d))


@query("B2_top_bands", f"with {_BANDS}, {_TOP} select * from top")
def b2(spark, d):
    return profiles.numbered(_top(spark, d), "bands", "band", "b").select("img_id", "b.y1", "b.y2", "b.score", (F.col("band") + 1).alias("band"))


@query("B3_split_wide_bands", f"with {_BANDS}, {_SPLIT} select * from splits")
def b3(spark, d):
    return profiles.band_rows(profiles.split_wide_bands(_bands(spark, d)))


@query("B4_force_bands", f"""with {_BANDS}, few as (select img_id from (select distinct img_id from {{profile}}) k left join (select img_id, count(*) as n from bands group by img_id) c using (img_id) where coalesce(n, 0) < 2),
  ext as (select img_id, min(y) as a, max(y) + 1 as b from m where v > greatest(1, m * 3e-2) group by img_id), s as (select img_id, a, b, greatest(6, cast(round_even((b - a) / 2, 0) as int)) as st from few join ext using (img_id) where b - a >= 12),
  cut as (select img_id, a as y1, least(b, a + st) as y2 from s union all select img_id, a + st, b from s), ok as (select *, count(*) over (partition by img_id) as n from cut where y2 - y1 >= 6), f as (select ok.img_id, y1, y2, avg(v) as score from ok join {{profile}} p on p.img_id = ok.img_id and p.y >= y1 and p.y < y2 where n = 2 group by ok.img_id, y1, y2)
  select * from bands where img_id not in (select img_id from f) union all select * from f""")
def b4(spark, d):
    return profiles.band_rows(profiles.force_bands(_bands(spark, d)))


@query("B5_separators", f"with {_BANDS}, {_TOP}, {_SEP} select * from seps")
def b5(spark, d):
    return profiles.separators(_top(spark, d))


@query("B6_line_bounds", f"""with {_BANDS}, {_TOP}, {_SEP}, sg as (select t.img_id, t.band, coalesce(lag(separator) over (partition by t.img_id order by t.band), 0) as lo, coalesce(separator, 60) as hi from top t left join seps s on s.img_id = t.img_id and s.band = t.band),
  j as (select sg.*, p.y, p.v, max(p.v) over (partition by sg.img_id, band) as mx from sg join {{profile}} p on p.img_id = sg.img_id and p.y >= lo and p.y < hi)
  select img_id, band, greatest(lo, min(y) filter (where v >= greatest(1, mx * 5e-2)) - 4) as top, least(hi, max(y) filter (where v >= greatest(1, mx * 5e-2)) + 5) as bottom from j group by img_id, band, lo, hi""")
def b6(spark, d):
    return profiles.line_bounds(_top(spark, d))


@query("B7_component_lines", """with recursive p as (select * replace (img_id // 8 as img_id) from {parts} where w between 2 and 70 and h between 6 and 70 and area >= 8), c as (select img_id, greatest(1e1, median(h) * 14e-1) as far from p group by img_id having count(*) >= 10),
  a as materialized (select p.*, far, row_number() over (partition by p.img_id order by cy, comp_id, x, y, x + w, y + h, area) as i from p join c on c.img_id = p.img_id), k(img_id, i, s, n, g) as (
    select img_id, i, cy, 1, 1 from a where i = 1
    union all select a.img_id, a.i, case when abs(cy - s / n) > far then cy else s + cy end, case when abs(cy - s / n) > far then 1 else n + 1 end, case when abs(cy - s / n) > far then g + 1 else g end from k join a on a.img_id = k.img_id and a.i = k.i + 1),
  l as (select a.img_id, g, count(*) as n, max(x + w) - min(x) as span, greatest(0, cast(round_even(min(y), 0) as int)) as y1, least(119, cast(round_even(max(y + h), 0) as int)) as y2, sum(area) as area from a join k on k.img_id = a.img_id and k.i = a.i group by a.img_id, g having count(*) >= 3 and max(x + w) - min(x) >= 120),
  o as (select *, span * n + area as s, count(*) over (partition by img_id) as c from l)
  select img_id, y1, y2, s / greatest(1, y2 - y1) as score from o where c >= 2 qualify row_number() over (partition by img_id order by s desc, y1) <= 2""")
def b7(spark, d):
    return profiles.component_lines(frame(spark, d, "parts").withColumn("img_id", F.floor(F.col("img_id") / 8)))


_CS = "(select img_id, case when count(*) >= 8 and abs(degrees(atan(regr_slope(cy, cx)))) <= 15 then degrees(atan(regr_slope(cy, cx))) end as angle from (select * replace (img_id // 8 as img_id) from {parts}) t where w between 3 and 45 and h between 6 and 55 and area >= 10 group by img_id)"
_SS = "(select img_id, case when count(*) filter (where ok) >= 3 then median(a) filter (where ok) end as angle from (select *, degrees(atan2(sy2 - sy1, sx2 - sx1)) as a, abs(sx2 - sx1) >= 30 and abs(degrees(atan2(sy2 - sy1, sx2 - sx1))) <= 15 as ok from {segments}) t group by img_id)"


def _parts8(spark, d):
    return frame(spark, d, "parts").withColumn("img_id", F.floor(F.col("img_id") / 8))


@query("B8_component_skew", f"select * from {_CS} t")
def b8(spark, d):
    return profiles.component_skew(_parts8(spark, d))


@query("B9_segment_skew", f"select * from {_SS} t")
def b9(spark, d):
    return profiles.segment_skew(frame(spark, d, "segments"))


_BX = "select img_id // 8 as img_id, w * 8 as w, h, h as rect_w, w as rect_h, area % 60 - 70 as ra, image_width, image_height from {parts}"
_A1 = "case when rect_w < rect_h then ra + 90 else ra end"


@query("B10_choose_skew", f"""with bx as ({_BX}), a as (select *, case when x > 45 then x - 90 when x < -45 then x + 90 else x end as a from (select *, {_A1} as x from bx) t where w >= image_width * 25e-2 and h >= 3 and not (w > image_width * 95e-2 and h > image_height * 7e-1)),
  best as (select img_id, cast(a as double) as a from a where abs(a) <= 15 qualify row_number() over (partition by img_id order by w * h * w / greatest(1, h) desc, a desc) = 1), k as (select distinct img_id from bx)
  select k.img_id, coalesce(s.angle, b.a, c.angle, 0) as angle, case when s.angle is not null then 'segments' when b.a is not null then 'box' when c.angle is not null then 'components' else 'none' end as skew_from from k left join {_SS} s on s.img_id = k.img_id left join best b on b.img_id = k.img_id left join {_CS} c on c.img_id = k.img_id""")
def b10(spark, d):
    p = _parts8(spark, d)
    boxes = p.select("img_id", (F.col("w") * 8).alias("w"), "h", F.col("h").alias("rect_w"), F.col("w").alias("rect_h"), (F.col("area") % 60 - 70).alias("rect_angle"), "image_width", "image_height")
    # the rectangle's sides are those of the part before it was widened
    boxes = boxes.withColumn("rect_angle", F.col("rect_angle").cast("double"))
    return profiles.choose_skew(p, frame(spark, d, "segments"), boxes, p)


_PAD = "greatest(6, cast(round_even(600 * 2e-2, 0) as int))"


@query("B11_trim_bounds", f"""with pr as (select * replace (img_id // 8 as img_id) from {{parts}}), c as (select img_id, min(x) as lo, max(x + w) as hi from pr where w between 2 and 70 and h between 6 and 70 and area >= 8 group by img_id having count(*) >= 8),
  q as (select img_id, x, sum(area) * 10 as v from pr group by img_id, x), m as (select *, max(v) over (partition by img_id) as m from q), g as (select img_id, min(x) filter (where v >= greatest(255, m * 8e-2)) as lo, max(x) filter (where v >= greatest(255, m * 8e-2)) + 1 as hi from m group by img_id),
  s as (select g.img_id, greatest(0, c.lo - {_PAD}) as cl, least(600, c.hi + {_PAD}) as cr, greatest(0, g.lo - {_PAD}) as gl, least(600, g.hi + {_PAD}) as gr, c.lo as has_c, g.lo as has_g from g left join c using (img_id))
  select img_id, case when has_c is not null and cr - cl >= 150 then cl when has_g is not null and gr - gl >= 150 then gl else 0 end as "left", case when has_c is not null and cr - cl >= 150 then cr when has_g is not null and gr - gl >= 150 then gr else 600 end as "right" from s""")
def b11(spark, d):
    parts = F.collect_list(F.struct("x", "w", "h", "area"))
    df = _parts8(spark, d).groupBy("img_id").agg(F.first("image_width").alias("image_width"), F.first("image_height").alias("image_height"), parts.alias("parts"))
    ink = lambda x: F.aggregate(F.filter("parts", lambda c: c["x"] == x), F.lit(0).cast("long"), lambda t, c: t + c["area"]) * 10
    columns = F.transform(F.array_distinct(F.transform("parts", lambda c: c["x"])), lambda x: F.struct(x.alias("x"), ink(x).cast("double").alias("v")))
    return profiles.trim_bounds(df.withColumn("columns", columns))


@query("B12_fixed_split", """with m as (select *, max(v) over (partition by img_id) as m from {profile}), e as (select img_id, coalesce(min(y) filter (where v >= greatest(1, m * 3e-2)), 0) as a, coalesce(max(y) filter (where v >= greatest(1, m * 3e-2)) + 1, 60) as b from m group by img_id),
  f as (select *, cast(round_even((a + b) / 2, 0) as int) as mid, greatest(2, cast(round_even(greatest(2, b - a) * 16e-2, 0) as int)) as rad, greatest(2, cast(round_even(greatest(2, b - a) * 10e-2, 0) as int)) as ov from e),
  s as (select f.img_id, arg_min(p.y, p.v * 1000 + p.y) as pos from f join {profile} p on p.img_id = f.img_id and p.y >= greatest(a + 1, mid - rad) and p.y < least(b - 1, mid + rad) group by f.img_id), t as (select f.*, coalesce(pos, mid) as pos from f left join s using (img_id))
  select img_id, 1 as line, greatest(0, a - 3) as top, least(60, pos + ov) as bottom from t union all select img_id, 2, greatest(0, pos - ov), least(60, b + 3) from t""")
def b12(spark, d):
    return profiles.fixed_split(_p(spark, d))


@query("B13_orientation_vote", """with g as (select img_id // 40 as img_id, comp_id, 10 as width, avg(local_x) filter (where local_y <= 7) as t, avg(local_x) filter (where local_y > 7 and local_y < 13) as m, avg(local_x) filter (where local_y >= 13) as b, count(*) filter (where local_y <= 7) as nt, count(*) filter (where local_y > 7 and local_y < 13) as nm, count(*) filter (where local_y >= 13) as nb from {glyphs} group by 1, 2),
  s as (select img_id, ((t + b) / 2 - m) / width as s from g where nt >= 2 and nm >= 2 and nb >= 2 and abs(t - b) <= 4), o as (select img_id, sum(s) as score_0, -sum(s) as score_180, count(*) as count_0 from s where abs(s) >= 8e-2 group by img_id)
  select *, count_0 >= 3 and score_180 > 0 and score_180 > score_0 + 2e-1 as rotate from o""")
def b13(spark, d):
    g = frame(spark, d, "glyphs").withColumn("img_id", F.floor(F.col("img_id") / 40))
    return profiles.orientation_vote(g, min_components=3, min_delta=0.2)


@query("B14_region_candidates", "select image_id, x, y, w, h, least(95e-2, 45e-2 + 25e-2 * least(w / h / 10, 1) + 30e-2 * y / 400) as score, 'morphology' as source from {candidates} where w * h >= 500 * 400 * 8e-3 and w / h >= 3 and w >= 175 union all select image_id, 0, y, 500, 400 - y, s, 'bottom_band' from (select distinct image_id from {candidates}) t, (values (263, 66e-2), (216, 69e-2)) b(y, s)")
def b14(spark, d):
    return profiles.region_candidates(frame(spark, d, "candidates"))
