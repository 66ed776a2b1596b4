"""Oracle SQL (DuckDB) for the queries of ``queries.py``, over the same tables."""

from __future__ import annotations

import re

from ..operators.sequence import smoothing_weights

DET = """det as (
  select l_orderkey as image_id,
         cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) as det_idx,
         cast(l_suppkey % 5 as int) as class_id, cast(l_quantity as int) / cast(50 as double) as confidence,
         cast(l_partkey % 60 as double) as x1, cast(l_suppkey % 40 as double) as y1,
         cast(l_partkey % 60 + 10 + l_quantity as double) as x2, cast(l_suppkey % 40 + 20 + l_linenumber as double) as y2
  from lineitem)"""
IMAGES = """images as (
  select o_orderkey as id, case when o_orderkey % 10 < 8 then 'train' when o_orderkey % 10 = 8 then 'valid' else 'test' end as split,
         concat('img_', cast(o_orderkey as varchar), '.jpg') as file_name, 1280 as width, 720 as height
  from orders)"""
ROSTERS = """rosters as (
  select cast(p_partkey % 2 as int) as team_id, cast(p_size as varchar) as number, min(p_name) as player
  from part group by all)"""
READS = """reads as (
  select user_id as tracker_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) as frame_idx, event_type as value
  from events)"""
PATHS = """path as (
  select user_id as tracker_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) as frame_idx, value as x
  from events)"""
CATEGORIES = "categories as (select * from (values (0,'ball'),(1,'goalkeeper'),(2,'player'),(3,'referee'),(4,'number')) t(id, name))"
TEAMS = "teams as (select * from (values (0,'red','#d62728'),(1,'blue','#1f77b4')) t(team_id, team, color))"
COURT = "court as (select cast(k as int) as kp_idx, cast(a as double) as cx, cast(b as double) as cy from (values (0,0,18),(1,10,4),(2,30,0),(3,70,2),(4,94,15),(5,90,40),(6,50,50),(7,8,42)) t(k,a,b))"
KEYPOINTS = COURT + """, keypoints as (
  select o_orderkey as frame_idx, kp_idx, cx, cy, (cx + cy / 10 + o_orderkey % 50) / (cx / 1000 + cy / 500 + 1) as x,
         (cy * 9 / 10 + 5) / (cx / 1000 + cy / 500 + 1) as y,
         cast((o_orderkey + 7 * kp_idx) % 10 as double) / cast(10 as double) as confidence
  from orders cross join court)"""
BOXES = "image_id, det_idx, class_id, confidence, x1, y1, x2, y2"


def _inter(a: str, b: str) -> str:
    return f"(greatest(0.0::double, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0::double, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"


def _area(a: str) -> str:
    return f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))"


def _iou(a: str, b: str) -> str:
    return f"({_inter(a, b)} / ({_area(a)} + {_area(b)} - {_inter(a, b)}))"


def _ios(a: str, b: str) -> str:
    return f"({_inter(a, b)} / least({_area(a)}, {_area(b)}))"


def _centre_in(b: str, z: str) -> str:
    return f"({b}.x1 + {b}.x2) / 2 between {z}.x1 and {z}.x2 and ({b}.y1 + {b}.y2) / 2 between {z}.y1 and {z}.y2"


def _nms(source: str, threshold: float) -> str:
    """CTEs that end in kept(image_id, rk), over ranked."""
    return f"""ranked as (
  select *, row_number() over (partition by image_id order by confidence desc, det_idx) as rk from {source}
), clash as (
  select a.image_id, a.rk, list(b.rk) as others from ranked a join ranked b on a.image_id = b.image_id and b.rk < a.rk
  where {_iou('a', 'b')} > {threshold} group by all
), walk as (
  select image_id, rk, [rk] as held from ranked where rk = 1
  union all
  select w.image_id, r.rk, case when c.others is not null and len(list_intersect(w.held, c.others)) > 0 then w.held else list_append(w.held, r.rk) end
  from walk w join ranked r on r.image_id = w.image_id and r.rk = w.rk + 1
  left join clash c on c.image_id = r.image_id and c.rk = r.rk
), kept as (
  select image_id, unnest(max_by(held, rk)) as rk from walk group by image_id
)"""


PREDICTED = f"""predicted as (
  select r.* from ranked r join kept k on r.image_id = k.image_id and r.rk = k.rk
  where not exists (select 1 from det z where z.image_id = r.image_id and (z.class_id = 3 or z.class_id = 0 and z.confidence > 0.5) and {_centre_in('r', 'z')})
)"""


def _streaks(source: str, keys: str, order: str) -> str:
    return f"""runs as (
  select *, row_number() over (partition by {keys} order by {order}) - row_number() over (partition by {keys}, value order by {order}) as run from {source}
), streaks as (
  select *, row_number() over (partition by {keys}, value, run order by {order}) as streak from runs
)"""


VALIDATED = _streaks("reads", "tracker_id", "frame_idx") + """, locked as (
  select tracker_id, min_by(value, frame_idx) as value, min(frame_idx) as locked_at from streaks where streak = 3 group by tracker_id
)"""

JUMPS = """stepped as (
  select *, {step} as step from path
), mid as (
  select *, median(step) over (partition by tracker_id) as m from stepped
), dev as (
  select *, median(abs(step - m)) over (partition by tracker_id) as mad from mid
), jumps as (
  select tracker_id, frame_idx, {columns}, step, coalesce(step > greatest(0.6, m + {sigma} * mad), false) as jump from dev
), numbered as (
  select *, row_number() over (partition by tracker_id order by frame_idx) - sum(jump::int) over (partition by tracker_id order by frame_idx) as run from jumps
), shorts as (
  select *, jump and sum(jump::int) over (partition by tracker_id, run) <= 18 as short from numbered
), edits as (
  select *, max(short::int) over (partition by tracker_id order by frame_idx rows between 2 preceding and 2 following) = 1 as edited from shorts
)"""


STEP_1D = "abs(x - lag(x) over (partition by tracker_id order by frame_idx))"
STEP_2D = "sqrt(0.0::double + pow(x - lag(x) over (partition by tracker_id order by frame_idx), 2) + pow(y - lag(y) over (partition by tracker_id order by frame_idx), 2))"


def _jumps(step: str = STEP_1D, sigma: float = 3.5, columns: str = "x") -> str:
    return JUMPS.format(sigma=repr(sigma * 1.4826), step=step, columns=columns)


def _filled(source: str) -> str:
    """CTE filled(tracker_id, frame_idx, n, x, was) of a source with gaps in x."""
    return f"""numbered_gaps as (
  select *, row_number() over (partition by tracker_id order by frame_idx) as n from {source}
), ends as (
  select *, last_value(x ignore nulls) over b as v0, last_value(case when x is not null then n end ignore nulls) over b as n0,
         first_value(x ignore nulls) over a as v1, first_value(case when x is not null then n end ignore nulls) over a as n1
  from numbered_gaps
  window b as (partition by tracker_id order by frame_idx rows between unbounded preceding and current row),
         a as (partition by tracker_id order by frame_idx rows between current row and unbounded following)
), filled as (
  select * replace (coalesce(x, v0 + (v1 - v0) * (n - n0) / (n1 - n0), v0, v1) as x) from ends
)"""


def _smooth(source: str) -> str:
    w = "[" + ", ".join("[" + ", ".join(f"{v!r}::double" for v in row) + "]" for row in smoothing_weights()) + "]"
    return f"""windows as (
  select *, row_number() over o as t, count(*) over (partition by tracker_id) as size,
         list(x) over (partition by tracker_id order by frame_idx rows between 4 preceding and 4 following) as mid_9
  from {source} window o as (partition by tracker_id order by frame_idx)
), tails as (
  select tracker_id, list(x order by t) filter (where t <= 9) as head_9, list(x order by t) filter (where t > size - 9) as tail_9 from windows group by tracker_id
), smooth as (
  select * replace (case when size < 9 then x else list_sum(list_transform(range(1, 10), lambda i:
      (case when t <= 4 then head_9 when t > size - 4 then tail_9 else mid_9 end)[i]
      * ({w}[case when t <= 4 then t when t > size - 4 then 9 - (size - t) else 5 end])[i])) end as x)
  from windows join tails using (tracker_id)
)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return f"with {'recursive ' * recursive}" + ",\n".join(parts) + "\n"


def _det(select: str) -> str:
    return _with(DET) + select


VIDEO = "cast(floor(image_id / 500) as bigint)"
FRAMES = f"""players as (
  select image_id, {VIDEO} as video_id, image_id % 500 as frame_idx, det_idx, x1, y1, x2, y2,
         cast(row_number() over (partition by image_id order by det_idx) as int) as tracker_id
  from det where class_id in (1, 2)
), numbers as (
  select {VIDEO} as video_id, image_id % 500 as frame_idx, det_idx, x1, y1, x2, y2, cast(cast(x1 as int) % 3 as varchar) as value
  from det where class_id = 4
), matched as (
  select p.video_id, p.frame_idx, p.tracker_id, n.value,
         row_number() over (partition by p.video_id, p.frame_idx order by {_ios('p', 'n')} desc, p.det_idx, n.det_idx) as pair_rank
  from players p join numbers n on p.video_id = n.video_id and p.frame_idx = n.frame_idx
  where p.frame_idx % 5 = 0 and {_ios('p', 'n')} > 0.9
), crop_teams as (
  select p.video_id, p.tracker_id, p.frame_idx, e.label % 2 as team_id
  from players p join embeddings e on e.vec_id = (p.image_id * 7 + p.det_idx) % 500
), team_of as (
  select video_id, tracker_id, min_by(team_id, frame_idx) as team_id from crop_teams group by all
)"""


def _identity(mode: str) -> str:
    number = "l.value" if mode == "final" else "case when l.locked_at <= p.frame_idx then l.value end"
    return _with(DET, ROSTERS, FRAMES, _streaks("matched", "video_id, tracker_id", "frame_idx, pair_rank"), """locked as (
  select video_id, tracker_id, min_by(value, frame_idx * 1000000 + pair_rank) as value, min(frame_idx) as locked_at from streaks where streak = 3 group by all
)""", f"""named as (
  select p.video_id, p.frame_idx, p.det_idx, p.tracker_id, t.team_id, {number} as number
  from players p left join locked l on p.video_id = l.video_id and p.tracker_id = l.tracker_id
  left join team_of t on p.video_id = t.video_id and p.tracker_id = t.tracker_id
  where {_area('p')} > 100
)""") + "select n.*, r.player, case when n.team_id is not null then '#' || coalesce(n.number, 'None') || ' ' || coalesce(r.player, 'None') end as label from named n left join rosters r on n.team_id = r.team_id and n.number = r.number"


_MERGED = """merged as (
  select image_id, 0 as origin, cast(row_number() over (partition by image_id order by det_idx) as int) as seq, class_id as category_id, x1 as x, y1 as y, x2 - x1 as w, y2 - y1 as h, cast(null as double) as score from det where class_id <> 4
  union all
  select image_id, 1, cast(row_number() over (partition by image_id order by confidence desc, det_idx) as int), 5, x1, y1, x2 - x1, y2 - y1, confidence from predicted
)"""
_JERSEY = "jersey as (select * from det where class_id = 4 and confidence > 0.4)"
_TRUTH_IDS = "row_number() over (order by m.image_id, m.origin, m.seq) - 1"
_LINES = "lines as (select o_orderkey as id, case when o_orderkey % 11 = 0 then '' when o_orderkey % 7 = 0 then '1 0.5 0.5' when o_orderkey % 13 = 0 then 'x 0.1 0.2 0.3 0.4' else concat('  ', o_orderkey % 5, ' 0.', o_orderkey % 10, ' 0.5  0.25 0.', o_orderkey % 9, ' ') end as value from orders)"
_GAPS = "gaps as (select tracker_id, frame_idx, case when frame_idx % 7 not in (3, 4) then x end as x from path)"

MASK_OVERLAP = _det(f"""select p.image_id, p.det_idx as p_idx, n.det_idx as n_idx, (least(p.x2, n.x2, 63) - greatest(p.x1, n.x1) + 1) * (least(p.y2, n.y2, 47) - greatest(p.y1, n.y1) + 1)
  / least((least(63, p.x2) - p.x1 + 1) * (least(47, p.y2) - p.y1 + 1), (least(63, n.x2) - n.x1 + 1) * (least(47, n.y2) - n.y1 + 1)) as ios
from det p join det n on p.image_id = n.image_id where p.class_id in (1, 2) and n.class_id = 4 and p.x1 < n.x2 and n.x1 < p.x2 and p.y1 < n.y2 and n.y1 < p.y2""")


def _filled_2d(source: str) -> str:
    """Both coordinates of a source filled and smoothed one after the other: CTEs fx, sx, fy, sy."""
    own = lambda c: f"src_{c} as (select tracker_id, frame_idx, {c} as x from {source})"
    out = []
    for c in "xy":
        text = ",\n".join([own(c), _filled(f"src_{c}"), _smooth("filled")])
        for name in ("numbered_gaps", "ends", "filled", "windows", "tails", "smooth"):
            text = re.sub(rf"\b{name}\b", f"{name}_{c}", text)
        out.append(text)
    return ",\n".join(out)


def _court_paths() -> str:
    """Both coordinates of the players' positions on the court, cleaned; a track is a video and a number in it."""
    return _with(DET, KEYPOINTS, """support as (select frame_idx from keypoints where confidence > 0.5 group by frame_idx having count(*) >= 4
), placed as (select image_id, (x1 + x2) / 2 as u, y2 as v, cast(image_id % 50 as double) as c, cast(row_number() over (partition by image_id order by det_idx) as int) as nth
  from det where class_id in (1, 2)
), terms as (select *, u / 1000 - 1 as a1, u / 500 - 0.1 as b1, c - u as r1, v / 1000 as a2, v / 500 - 0.9 as b2, 5 - v as r2 from placed join support on frame_idx = image_id
), path as (select cast(floor(image_id / 500) as bigint) * 1000 + nth as tracker_id, image_id % 500 as frame_idx,
  (r1 * b2 - r2 * b1) / (a1 * b2 - a2 * b1) as x, (a1 * r2 - a2 * r1) / (a1 * b2 - a2 * b1) as y from terms)""",
        _jumps(STEP_2D, columns="x, y"), "gaps2 as (select tracker_id, frame_idx, case when not edited then x end as x, case when not edited then y end as y from edits)",
        _filled_2d("gaps2")) + """select cast(floor(e.tracker_id / 1000) as bigint) as video_id, cast(e.tracker_id % 1000 as int) as tracker_id, e.frame_idx as frame,
  round(a.x, 6) as x, round(b.x, 6) as y, e.edited
from edits e join smooth_x a on a.tracker_id = e.tracker_id and a.frame_idx = e.frame_idx join smooth_y b on b.tracker_id = e.tracker_id and b.frame_idx = e.frame_idx"""


def _coco() -> str:
    """The document as text, built section by section."""
    number = lambda v: f"cast({v} as varchar)"
    image = f"""'{{"id":' || {number('id')} || ',"file_name":"' || file_name || '","width":1280,"height":720,"license":null,"date_captured":null}}'"""
    one = f"""'{{"id":' || {number('id')} || ',"image_id":' || {number('image_id')} || ',"category_id":' || {number('category_id')} || ',"bbox":[' || {number('x')} || ',' || {number('y')} || ',' || {number('w')} || ',' || {number('h')} || '],"area":' || {number('area')}
  || ',"segmentation":[],"iscrowd":0' || case when score is null then '' else ',"score":' || {number('score')} end || '}}'"""
    category = """'{"id":' || cast(id as varchar) || ',"name":"' || name || '","supercategory":"none"}'"""
    base = SQL_MERGED
    return f"""with images as (select * from ({_with(IMAGES)} select * from images)), merged_ids as ({base}),
cats as ({_with(CATEGORIES)} select id, name from categories union all select cast(count(*) as int), 'jersey number' from categories)
select '{{"info":{{"description": "merged annotations", "date_created": "2025-11-21"}},"licenses":[],"images":[' || (select string_agg({image}, ',' order by id) from images)
 || '],"annotations":[' || (select string_agg({one}, ',' order by id) from merged_ids) || '],"categories":[' || (select string_agg({category}, ',' order by id) from cats) || ']}}' as json"""


SQL_MERGED = _with(DET, _JERSEY, _nms("jersey", 0.25), PREDICTED, _MERGED, recursive=True) + f"select {_TRUTH_IDS} as id, m.image_id, m.origin, m.seq, m.category_id, m.x, m.y, m.w, m.h, m.w * m.h as area, m.score from merged m"

SQL: dict[str, str] = {
    "class_filter": _det(f"select {BOXES} from det where class_id = 4"),
    "class_in_filter": _det(f"select {BOXES} from det where class_id in (1, 2)"),
    "confidence_filter": _det(f"select {BOXES} from det where confidence > 0.4"),
    "area_filter": _det(f"select {BOXES} from det where (x2 - x1) * (y2 - y1) > 900"),
    "frame_stride": _with(IMAGES) + "select id, split, file_name from images where id % 30 = 0",
    "frame_modulo": _det(f"select {BOXES} from det where image_id % 5 = 0"),
    "first_frame": _det(f"select {BOXES} from det where image_id % 500 = 0"),
    "track_id_assign": _det("select image_id, det_idx, cast(row_number() over (partition by image_id order by det_idx) as int) as tracker_id from det where class_id in (1, 2)"),
    "yolo_to_coco": _det(f"""select image_id, det_idx, xc * 1280 - w * 1280 / 2 as x, yc * 720 - h * 720 / 2 as y, w * 1280 as w, h * 720 as h
from (select *, (x1 + x2) / 2 / 1280 as xc, (y1 + y2) / 2 / 720 as yc, (x2 - x1) / 1280 as w, (y2 - y1) / 720 as h from det)"""),
    "xyxy_to_xywh": _det("select image_id, det_idx, x1 as x, y1 as y, x2 - x1 as w, y2 - y1 as h from det"),
    "xywh_to_xyxy": _det("select image_id, det_idx, x1, y1, x2, y2 from det"),
    "box_area_center": _det("select image_id, det_idx, (x2 - x1) * (y2 - y1) as area, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy from det"),
    "scale_boxes": _det(f"select image_id, det_idx, (x1 + x2) / 2 - (x2 - x1) * 0.4 / 2 as x1, (y1 + y2) / 2 - (y2 - y1) * 0.4 / 2 as y1, (x1 + x2) / 2 + (x2 - x1) * 0.4 / 2 as x2, (y1 + y2) / 2 + (y2 - y1) * 0.4 / 2 as y2 from det"),
    "pad_clip_boxes": _det("select image_id, det_idx, greatest(0.0::double, least(x1 - 10, 64)) as x1, greatest(0.0::double, least(y1 - 10, 48)) as y1, greatest(0.0::double, least(x2 + 10, 64)) as x2, greatest(0.0::double, least(y2 + 10, 48)) as y2 from det"),
    "bottom_center": _det("select image_id, det_idx, (x1 + x2) / 2 as x, y2 as y from det"),
    "point_in_box": _det(f"select p.image_id, n.det_idx as n_idx, p.det_idx as p_idx from det p join det n on p.image_id = n.image_id where p.class_id in (1, 2) and n.class_id = 4 and {_centre_in('n', 'p')}"),
    "pairwise_iou": _det(f"select a.image_id, a.det_idx as a_idx, b.det_idx as b_idx, {_iou('a', 'b')} as iou from det a join det b on a.image_id = b.image_id and a.det_idx < b.det_idx"),
    "pairwise_ios": _det(f"select a.image_id, a.det_idx as a_idx, b.det_idx as b_idx, {_ios('a', 'b')} as ios from det a join det b on a.image_id = b.image_id and a.det_idx < b.det_idx"),
    "match_numbers_to_players": _det(f"""select image_id, p_idx, n_idx, ios, cast(row_number() over (partition by image_id order by ios desc, p_idx, n_idx) as int) as pair_rank
from (select p.image_id, p.det_idx as p_idx, n.det_idx as n_idx, {_ios('p', 'n')} as ios from det p join det n on p.image_id = n.image_id where p.class_id in (1, 2) and n.class_id = 4) where ios > 0.9"""),
    "exclude_centers": _det(f"select image_id, det_idx, x1, y1, x2, y2 from det b where class_id = 4 and not exists (select 1 from det z where z.class_id = 3 and z.image_id = b.image_id and {_centre_in('b', 'z')})"),
    "nms": _with(DET, _nms("det", 0.25), recursive=True) + "select r.image_id, r.det_idx, r.confidence, r.x1, r.y1, r.x2, r.y2 from ranked r join kept k on r.image_id = k.image_id and r.rk = k.rk",
    "filtered_predictions": _with(DET, _JERSEY, _nms("jersey", 0.25), PREDICTED, recursive=True) + "select image_id, det_idx, confidence, x1, y1, x2, y2 from predicted",
    "roster_labels": _with(ROSTERS) + "select p_partkey as part, cast(p_partkey % 2 as int) as team_id, n.number, r.player, '#' || n.number || ' ' || coalesce(r.player, 'None') as label from part, lateral (select cast(p_size + p_partkey % 3 as varchar) as number) n left join rosters r on r.team_id = cast(p_partkey % 2 as int) and r.number = n.number",
    "team_colors": _with(TEAMS) + "select p_partkey as part, t.team, t.color, cast('0x' || substr(color, 2, 2) as int) as red, cast('0x' || substr(color, 4, 2) as int) as green, cast('0x' || substr(color, 6, 2) as int) as blue from part join teams t on t.team_id = p_partkey % 2",
    "category_names": _with(DET, CATEGORIES) + "select image_id, det_idx, coalesce(name, 'unknown') as name from det left join (select * from categories where id <> 3) c on c.id = det.class_id",
    "image_annotations_left": _with(DET, IMAGES) + "select i.id, i.file_name, count(d.det_idx) as n, coalesce(sum((x2 - x1) * (y2 - y1)), 0.0::double) as area from images i left join det d on d.image_id = i.id group by all",
    "annotation_groups": _with(DET, IMAGES) + "select i.id, coalesce(string_agg(cast(d.det_idx as varchar) || ':' || cast(d.class_id as varchar), ',' order by d.det_idx), '') as items from images i left join det d on d.image_id = i.id group by i.id",
    "file_last_wins": _with(IMAGES) + "select 'img_' || cast(id % 1000 as varchar) || '.jpg' as file_name, max(id) as id, max_by(split, id) as split from images group by all",
    "split_first_match": _with(IMAGES) + "select 'img_' || cast(id % 1000 as varchar) || '.jpg' as file_name, min_by(split, case split when 'train' then 1 when 'valid' then 2 else 3 end) as split from images group by all",
    "sequential_ids": _with(IMAGES) + "select id as source_id, row_number() over (order by case split when 'train' then 1 when 'valid' then 2 else 3 end, file_name) - 1 as id from images",
    "merged_annotations": SQL_MERGED,
    "basic_annotations": _with(DET, "predicted as (select * from det where class_id = 4 and confidence > 0.3)", _MERGED) + f"select {_TRUTH_IDS} as id, m.image_id, m.origin, m.seq, m.category_id, m.x, m.y, m.w, m.h, m.w * m.h as area, m.score from merged m",
    "score_labels": _with(DET, CATEGORIES) + "select image_id, det_idx, format('{} {:.2f}', name, confidence) as label from det join categories c on c.id = det.class_id",
    "class_difference": "select p_partkey as part, '2' as classes from part",
    "dense_positions": _with(PATHS) + f"select t, string_agg(cast(x as varchar), ',' order by tracker_id) as points from (select *, frame_idx - 1 as t from path) group by t",
    "new_category": _with(CATEGORIES) + "select id, name from categories union all select cast(count(*) as int), 'jersey number' from categories",
    "referee_id": "select 3 as referee, -1 as absent",
    "dataset_summary": _with(DET, IMAGES) + "select split, count(distinct i.id) as images, count(d.det_idx) as annotations, count(*) filter (where d.class_id = 4) as numbers, count(*) filter (where d.det_idx is null) as unlabelled from images i left join det d on d.image_id = i.id group by split",
    "validated_values": _with(READS, VALIDATED) + "select * from locked",
    "validated_online": _with(READS, VALIDATED) + "select r.tracker_id, r.frame_idx, case when l.locked_at <= r.frame_idx then l.value end as validated from reads r left join locked l using (tracker_id)",
    "validated_final": _with(READS, VALIDATED) + "select r.tracker_id, r.frame_idx, l.value as validated from reads r left join locked l using (tracker_id)",
    "true_runs": _with(PATHS) + """select tracker_id, cast(row_number() over (partition by tracker_id order by min(frame_idx)) as int) as run_id, min(frame_idx) as first, max(frame_idx) as last, count(*) as length
from (select *, n - row_number() over (partition by tracker_id order by frame_idx) as run from (select *, row_number() over (partition by tracker_id order by frame_idx) as n from path) where x > 60) group by tracker_id, run""",
    "path_jumps": _with(PATHS, _jumps()) + f"select tracker_id, frame_idx, step, jump from jumps",
    "path_short_runs": _with(PATHS, _jumps()) + "select tracker_id, frame_idx, jump, short from shorts",
    "path_padded_mask": _with(PATHS, _jumps()) + "select tracker_id, frame_idx, edited from edits",
    "path_interpolate": _with(PATHS, _GAPS, _filled("gaps")) + f"select tracker_id, frame_idx, x from filled",
    "path_smooth": _with(PATHS, _smooth("path")) + f"select tracker_id, frame_idx, x from smooth",
    "path_clean": _with(PATHS, _jumps(), "edited_gaps as (select tracker_id, frame_idx, edited, case when not edited then x end as x from edits)", _filled("edited_gaps"), _smooth("filled")) + f"select tracker_id, frame_idx, edited, x from smooth",
    "path_slice": _with(PATHS) + "select tracker_id, frame_idx, frame_idx - 1 as t, x from path where tracker_id = 1",
    "keypoint_support": _with(KEYPOINTS) + "select frame_idx, count(*) as n from keypoints where confidence > 0.5 group by frame_idx having count(*) >= 4",
    "vertex_match": _with(KEYPOINTS) + f"select frame_idx, kp_idx, x, y as y, cx, cy from keypoints where confidence > 0.5",
    "court_positions": _with(DET, KEYPOINTS, """support as (select frame_idx from keypoints where confidence > 0.5 group by frame_idx having count(*) >= 4
), placed as (select image_id, det_idx, (x1 + x2) / 2 as u, y2 as v, cast(image_id % 50 as double) as c from det join support on frame_idx = image_id where class_id in (1, 2)
), terms as (select *, u / 1000 - 1 as a1, u / 500 - 0.1 as b1, c - u as r1, v / 1000 as a2, v / 500 - 0.9 as b2, 5 - v as r2 from placed)""") + f"select image_id, det_idx, round((r1 * b2 - r2 * b1) / (a1 * b2 - a2 * b1), 6) as court_x, round((a1 * r2 - a2 * r1) / (a1 * b2 - a2 * b1), 6) as court_y from terms",
    "parse_yolo_lines": _with(_LINES, "parts as (select id, regexp_split_to_array(trim(value), '\\s+') as p from lines)") + f"select id, cast(p[1] as int) as class_id, cast(p[2] as double) as xc, cast(p[3] as double) as yc, cast(p[4] as double) as w, cast(p[5] as double) as h from parts where len(p) >= 5 and try_cast(p[1] as int) is not null",
    "rejected_yolo_lines": _with(_LINES, "parts as (select *, regexp_split_to_array(trim(value), '\\s+') as p from lines)") + "select id, value from parts where len(p) < 5 or try_cast(p[1] as int) is null",
    "path_parts": _with(IMAGES) + "select id, 'img_' || cast(id as varchar) as stem, '.jpg' as suffix, 'img_' || cast(id as varchar) || '.xml' as xml_name from images",
    "mask_boxes": _det("select image_id, det_idx, x1, y1, least(63.0::double, x2) as x2, least(47.0::double, y2) as y2, cast((least(63, x2) - x1 + 1) * (least(47, y2) - y1 + 1) as int) as area from det"),
    "mask_overlap": MASK_OVERLAP,
    "mask_identity_pairs": f"select * from ({MASK_OVERLAP}) where ios > 0.9",
    "draw_commands": _det("""select image_id, det_idx, 'box' as kind, x1 as x, y1 as y, x2 - x1 as w, y2 - y1 as h, ['#ff0000', '#00ff00', '#0000ff'][class_id % 3 + 1] as color, cast(null as varchar) as text, 0 as z from det
union all select image_id, det_idx, 'label', (x1 + x2) / 2, y2, 0.0::double, 0.0::double, ['#ff0000', '#00ff00', '#0000ff'][class_id % 3 + 1], '#' || cast(class_id as varchar) || ' None', 2 from det"""),
    "voc_xml": _with(DET, IMAGES, CATEGORIES) + """select i.id, i.file_name, '<annotation>' || chr(10) || '    <filename>' || i.file_name || '</filename>' || chr(10) || '    <size>' || chr(10) || '        <width>1280</width>' || chr(10) || '        <height>720</height>' || chr(10) || '        <depth>3</depth>' || chr(10) || '    </size>' || chr(10)
 || coalesce(string_agg('    <object>' || chr(10) || '        <name>' || name || '</name>' || chr(10) || '        <bndbox>' || chr(10) || '            <xmin>' || cast(x1 as int) || '</xmin>' || chr(10) || '            <ymin>' || cast(y1 as int) || '</ymin>' || chr(10) || '            <xmax>' || cast(x2 as int) || '</xmax>' || chr(10) || '            <ymax>' || cast(y2 as int) || '</ymax>' || chr(10) || '        </bndbox>' || chr(10) || '    </object>', chr(10) order by det_idx) || chr(10), '') || '</annotation>' as xml
from images i left join det d on d.image_id = i.id left join categories c on c.id = d.class_id group by i.id, i.file_name""",
    "court_paths": _court_paths(),
    "team_lock": _with(DET, ROSTERS, FRAMES) + "select * from team_of",
    "team_partition": _with(DET, ROSTERS, FRAMES) + "select p.image_id, p.det_idx, p.tracker_id from players p join team_of t on p.video_id = t.video_id and p.tracker_id = t.tracker_id where t.team_id = 0",
    "best_pairs": _det(f"""select image_id, p_idx, n_idx from (select *, row_number() over (partition by image_id order by ios desc, p_idx, n_idx) as pair_rank
from (select p.image_id, p.det_idx as p_idx, n.det_idx as n_idx, {_ios('p', 'n')} as ios from det p join det n on p.image_id = n.image_id where p.class_id in (1, 2) and n.class_id = 4) where ios > 0.5) where pair_rank <= 2"""),
    "head_slice": _with(IMAGES) + "select id, file_name from images order by id limit 100",
    "early_stop": _det(f"""select video_id, frame_idx, det_idx, class_id from (select *, min(case when class_id = 4 then frame_idx end) over (partition by video_id) as first
from (select {VIDEO} as video_id, image_id % 500 as frame_idx, det_idx, class_id from det)) where first is null or frame_idx <= first"""),
    "video_metadata": "select *, frames / fps as seconds from (select cast(floor(o_orderkey / 500) as bigint) as video_id, 64 as width, 48 as height, 30.0::double as fps, max(o_orderkey % 500) + 1 as frames from orders group by all)",
    "court_lines": _with(COURT) + "select a.kp_idx as a, b.kp_idx as b, a.cx as x, a.cy as y, b.cx as x2, b.cy as y2, '#ffffff' as color, 3 as z from court a join court b on b.kp_idx = (a.kp_idx + 1) % 8",
    "team_draw_commands": _with(DET, ROSTERS, FRAMES) + "select p.image_id, p.det_idx, 'box' as kind, p.x1 as x, p.y1 as y, p.x2 - p.x1 as w, p.y2 - p.y1 as h, case t.team_id when 0 then '#d62728' else '#1f77b4' end as color from players p join team_of t on p.video_id = t.video_id and p.tracker_id = t.tracker_id",
    "labelled_images": _with(DET, IMAGES) + "select i.id, i.file_name, coalesce(d.class_id, -1) as class_id, coalesce(d.det_idx, -1) as det_idx from images i left join det d on d.image_id = i.id",
    # Between the lowest row of the box and the part lie 3 to 11 rows; it stays where that is at most a twentieth of the diagonal.
    "near_segments": _det("select image_id, det_idx, cast((cast(x2 as int) - cast(x1 as int) + 1) * (cast(y2 as int) - cast(y1 as int) + 1) + case when 3 + image_id % 9 <= 0.05 * sqrt(pow(cast(x2 as int) - cast(x1 as int) + 1, 2) + pow(cast(y2 as int) - cast(y1 as int) + 4 + image_id % 9, 2)) then 2 else 0 end as int) as area from det"),
    "random_sample": _with(IMAGES) + "select id, split, file_name from images order by md5('3|' || cast(id as varchar)), id limit 10",
    "coco_json": _coco(),
    "validated_stream": _with(READS, VALIDATED) + "select * from locked",
    "identity_stream": "select video_id, frame_idx, det_idx, tracker_id, number from (" + _identity("online") + ")",
    "player_identity": _identity("final"),
    "player_identity_online": _identity("online"),
}
