"""DuckDB SQL for the queries of plans.queries: the same results from the same tables."""

PX = """px as (select cast(vec_id // 50 as bigint) as image_id, cast(vec_id % 50 as int) as y, cast(i - 1 as int) as x, cast(embedding[i] as double) as v
  from embeddings, unnest(generate_series(1, len(embedding))) t(i))"""
CANVAS = PX + """, canvas as (select image_id, y, x, floor((v - min(v) over w) / (max(v) over w - min(v) over w) * 255) as g from px window w as (partition by image_id))"""
PROFILE = """profile as (select vec_id as image_id, cast(i - 1 as int) as r, cast(embedding[i] as double) as v from embeddings, unnest(generate_series(1, len(embedding))) t(i))"""
PEAKS = PROFILE + """, peaks as (select image_id, r, v from (select *, lag(v) over w as a, lead(v) over w as b from profile window w as (partition by image_id order by r)) where v > a and v > b)"""


def conv(source: str, kernel: str, out: str) -> str:
    """A CTE that correlates a table of pixels with a 3 x 3 kernel, edges repeated."""
    rows = [[float(eval(x)) for x in r.split()] for r in kernel.split(";")]  # noqa: S307 - the kernels below
    values = ", ".join(f"({dy - 1}, {dx - 1}, cast({w} as double))" for dy, r in enumerate(rows) for dx, w in enumerate(r) if w)
    return f"""{out}_n as (select image_id, max(x) as mx, max(y) as my from {source} group by image_id),
    {out}_t as (select p.image_id, p.y, p.x, k.w, cast(greatest(0, least(n.my, p.y + k.dy)) as int) as ty, cast(greatest(0, least(n.mx, p.x + k.dx)) as int) as tx
      from {source} p join {out}_n n using (image_id) cross join (values {values}) k(dy, dx, w)),
    {out} as (select t.image_id, t.y, t.x, sum(q.g * t.w) as g from {out}_t t join {source} q on q.image_id = t.image_id and q.y = t.ty and q.x = t.tx group by t.image_id, t.y, t.x)"""


GAUSS = conv("canvas", "1/16 2/16 1/16;2/16 4/16 2/16;1/16 2/16 1/16", "blurred")
SOBEL = GAUSS + ", " + conv("blurred", "-1 0 1;-2 0 2;-1 0 1", "gx") + ", " + conv("blurred", "-1 -2 -1;0 0 0;1 2 1", "gy") + """,
    edges as (select gx.image_id, gx.y, gx.x, sqrt(gx.g * gx.g + gy.g * gy.g) as g from gx join gy using (image_id, y, x))"""


def rays(source: str, low: int, high: int) -> str:
    """A CTE `ray`: the mean over 360 rays from (32, 25) of a table of pixels."""
    return f"""grid as (select t, r, cast(trunc(r * cos(t * 6.283185307179586e0 / 360) + 32.0) as int) as x, cast(trunc(r * sin(t * 6.283185307179586e0 / 360) + 25.0) as int) as y
      from unnest(generate_series(0, 359)) a(t), unnest(generate_series({low}, {high})) b(r)),
    ray as (select i.image_id, cast(i.r as int) as r, coalesce(s.s, 0) / 360 as v from (select distinct image_id, r from {source}, unnest(generate_series({low}, {high})) b(r)) i
      left join (select image_id, r, sum(g) as s from grid join {source} using (x, y) group by image_id, r) s using (image_id, r))"""


def greedy(peaks: str, distance: int) -> str:
    """A recursive CTE `kept` (image_id, r): greedy suppression of a table of peaks."""
    return f"""kept(image_id, r) as (select image_id, min(r) from {peaks} group by image_id
      union all select k.image_id, (select min(p.r) from {peaks} p where p.image_id = k.image_id and p.r >= k.r + {distance}) from kept k
      where exists (select 1 from {peaks} p where p.image_id = k.image_id and p.r >= k.r + {distance}))"""


RINGS = "rings as (select image_id, list(r order by r) as radii from kept group by image_id)"
POLAR = CANVAS + """, pgrid as (select t, r, cast(floor(r * cos(t * 6.283185307179586e0 / 360) + 32.5) as int) as x, cast(floor(r * sin(t * 6.283185307179586e0 / 360) + 25.5) as int) as y
      from unnest(generate_series(0, 359)) a(t), unnest(generate_series(0, 29)) b(r)),
    polar as (select i.image_id, p.t, p.r, coalesce(c.g, 0) as v from (select distinct image_id from canvas) i cross join pgrid p left join canvas c on c.image_id = i.image_id and c.x = p.x and c.y = p.y)"""
SECTOR = "cast(floor(((degrees(atan2(y - 24.5, x - 31.5)) + 90) - 360 * floor((degrees(atan2(y - 24.5, x - 31.5)) + 90) / 360)) / (360.0 / 16)) as int)"
JOBS = """jobs as (select o_orderkey, 'job-' || o_orderkey as jobId, 'img/' || o_custkey || '.png' as file, o_orderpriority as clientId,
    case when o_orderkey % 13 <> 0 and o_orderkey % 7 <> 0 then cast(o_orderkey % 100 as double) end as mx, case when o_orderkey % 13 <> 0 and o_orderkey % 11 <> 0 then cast(o_orderkey % 90 as double) end as my from orders)"""
AUTOCORRELATION = PROFILE + """, c as (select image_id, r, v - avg(v) over (partition by image_id) as v from profile),
    lags as (select a.image_id, cast(b.r - a.r as int) as lag, sum(a.v * b.v) as v from c a join c b on a.image_id = b.image_id and b.r >= a.r group by 1, 2)"""
DFT = PROFILE + """, c as (select image_id, r, v - avg(v) over w as v, count(*) over w as n from profile window w as (partition by image_id)),
    power as (select image_id, cast(k as int) as k, pow(sum(v * cos(2 * 3.141592653589793e0 * k * r / n)), 2) + pow(sum(v * sin(2 * 3.141592653589793e0 * k * r / n)), 2) as power
      from c, unnest(generate_series(12, 30)) t(k) where k <= n // 2 group by 1, 2)"""
ALGORITHMS = "(values (0, 'RingDetection'), (1, 'UnsharpMasking'), (2, 'PolarRingDetection'), (3, 'SobelRingDetection'), (4, 'AutocorrelationPeriodicity'), (5, 'SecondDerivativeRingDetection'), (6, 'KMeansRingCounter'), (7, 'CNNSegmentation')) a(k, name, )".replace(", )", ")")
CENTROIDS = "(values (0, 10.0, 2.0), (1, 50.0, 8.0), (2, 100.0, 14.0), (3, 200.0, 20.0), (4, 1e6, 1e6)) c(centroid_id, cv, ch)"
POINTS = "points as (select event_id as point_id, value as v, cast(extract(hour from ts) as double) as h from events)"
NEAREST = POINTS + f", near as (select point_id, v, h, arg_min(centroid_id, ((v - cv) * (v - cv) + (h - ch) * (h - ch), centroid_id)) as centroid_id from points cross join {CENTROIDS} group by point_id, v, h)".replace("arg_min(centroid_id, ((v - cv) * (v - cv) + (h - ch) * (h - ch), centroid_id))", "first(centroid_id order by (v - cv) * (v - cv) + (h - ch) * (h - ch), centroid_id)")

SQL = {
    "json_parse": "select event_id, cast(json_extract(props, '$.k') as int) as k from events",
    "message_flatten_defaults": f"with {JOBS} select jobId, file, clientId, coalesce(mx, 0.0) as x, coalesce(my, 0.0) as y from jobs",
    "extension_filter_stem": r"""select page_id, regexp_replace(name, '\.[^.]*$', '') as stem from (select page_id, regexp_extract(url, '([^/]*)$', 1) as name from pages)
      where lower(name) like '%.html' order by name, page_id limit 50""",
    "key_template": "select doc_id, 'processed/' || (doc_id % 28 + 3) || '/' || source || '/' || source || '_' || (doc_id % 7) || '.png' as key, 'https://objects.invalid/' || 'app/results/' || source || '_' || lang || '.png' as url from documents",
    "snake_case_key": f"select d.doc_id, a.name, ltrim(lower(regexp_replace(a.name, '([A-Z])', '_\\1', 'g')), '_') as algo_key from documents d join {ALGORITHMS} on d.doc_id % 8 = a.k",
    "lookup_with_status": "select d.doc_id, l.quality, case when l.doc_id is null then 'ERROR: no label' else 'SUCCESS' end as status from documents d left join labels l using (doc_id)",
    "lookup_chain_two": "select o.o_orderkey, c.c_name, n.n_name from orders o left join customer c on o.o_custkey = c.c_custkey left join nation n on c.c_nationkey = n.n_nationkey",
    "status_summary": """select status, count(*) as n from (select case when message like '%SUCCESS%' then 'SUCCESS' when message like '%WARNING%' then 'WARNING' else 'ERROR' end as status from
      (select case when l.doc_id is null then 'ERROR: missing' when l.quality = 0 then 'WARNING: low' else 'SUCCESS: done' end as message from documents d left join labels l using (doc_id))) group by status""",
    "message_number_extract_sum": r"""select event_type, count(mb) as n, round(sum(mb), 6) as mb from (select event_type, try_cast(nullif(regexp_extract('SUCCESS - Total size: ' || printf('%.2f', value) || ' MB', 'Total size: ([0-9.]+) MB', 1), '') as double) as mb
      from events) group by event_type""",
    "label_distribution": "select quality, toxic, count(*) as n, (select count(distinct quality) from labels) as n_distinct from labels group by quality, toxic order by quality, toxic limit 10",
    "slice_manifest": "select n_name as image, cast(n as int) as n_slices, cast(i as int) as slice_no, 'processed/' || n || '/' || n_name || '/' || n_name || '_' || i || '.png' as key from nation, unnest(generate_series(3, 30)) a(n), unnest(generate_series(1, n)) b(i)",
    "slice_reconcile": """with made as (select n_name as image, i from nation, unnest(generate_series(3, 30)) a(n), unnest(generate_series(1, n)) b(i)), kept as (select image, count(*) as c from made where not (image like 'N%' and i = 30) group by image)
      select image, cast(462 as bigint) as expected, c as actual, c = 462 as complete from kept""",
    "status_first_last": "select doc_id, 'first' as place from (select doc_id from documents order by doc_id limit 10) union all select doc_id, 'last' from (select doc_id from documents order by doc_id desc limit 10)",
    "sector_pixels": f"with {CANVAS} select image_id, least(sector, 15) as sector, count(*) as n, cast(sum(g) as bigint) as total from (select *, {SECTOR} as sector from canvas) group by 1, 2",
    "sector_bbox": f"with {CANVAS} select image_id, least({SECTOR}, 15) as sector, count(*) as n_pixels, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from canvas group by 1, 2",
    "space_saved": f"""with {CANVAS}, box as (select image_id, least({SECTOR}, 15) as sector, (max(x) - min(x) + 1) * (max(y) - min(y) + 1) as kept from canvas group by 1, 2),
      whole as (select image_id, count(*) as n from canvas group by 1)
      select image_id, count(*) as slices, round(100.0 * (count(*) * any_value(n) - sum(kept)) / (count(*) * any_value(n)), 9) as saved from box join whole using (image_id) group by image_id""",
    "listing_by_prefix": "select source as prefix, count(*) as files, cast(sum(n_chars) as bigint) as bytes from documents group by source",
    "subsample_stride": f"""with {CANVAS}, m as (select *, row_number() over (partition by image_id order by y, x) as place, count(*) over (partition by image_id) as n from canvas where g > 127)
      select image_id, y, x, g from m where (place - 1) % greatest(1, n // 500) = 0""",
    "minmax_normalise": f"with {CANVAS} select image_id, y, x, g from canvas",
    "histogram": f"with {CANVAS}, h as (select image_id, cast(g as int) as v, count(*) as n from canvas group by 1, 2) select image_id, v, n, cast(sum(n) over (partition by image_id order by v) as bigint) as cdf from h",
    "histogram_equalise": f"""with {CANVAS}, h as (select image_id, cast(g as int) as v, count(*) as n from canvas group by 1, 2), c as (select *, sum(n) over (partition by image_id order by v) as cdf from h),
      t as (select image_id, v, floor(cast(cdf - min(cdf) over w as double) / cast(max(cdf) over w - min(cdf) over w as double) * 255 + 0.5) as g from c window w as (partition by image_id))
      select p.image_id, p.y, p.x, t.g from canvas p join t on p.image_id = t.image_id and cast(p.g as int) = t.v""",
    "conv3x3_sobel": f"with {CANVAS}, {SOBEL} select image_id, y, x, round(g, 6) as g from edges",
    "ray_profile": f"with {CANVAS}, {rays('canvas', 0, 21)} select image_id, r, round(v, 6) as v from ray",
    "polar_sector_mean": f"with {POLAR} select image_id, cast(least(t // 45, 7) as int) as sector, cast(r as int) as r, round(avg(v), 6) as v from polar group by 1, 2, 3",
    "angular_mean": f"with {POLAR} select image_id, cast(r as int) as r, round(avg(v), 6) as v from polar group by 1, 2",
    "angular_median": f"""with {POLAR}, s as (select t, case when u < 0 then -u - 1 when u >= 360 then 719 - u else u end as u from unnest(generate_series(0, 359)) a(t), unnest(generate_series(t - 2, t + 2)) b(u))
      select p.image_id, cast(s.t as int) as t, cast(p.r as int) as r, median(p.v) as v from s join polar p on p.t = s.u group by 1, 2, 3""",
    "central_difference": f"with {PROFILE} select * from (select image_id, r, round((lead(v) over w - lag(v) over w) / 2, 6) as v from profile window w as (partition by image_id order by r)) where v is not null",
    "local_maxima": f"with {PEAKS} select image_id, r, v from peaks",
    "greedy_suppression": f"with recursive {PEAKS}, {greedy('peaks', 5)}, {RINGS} select image_id, radii, cast(len(radii) as int) as ring_count from rings",
    "second_derivative_rings": f"""with recursive {PROFILE}, d1 as (select * from (select image_id, r, (lead(v) over w - lag(v) over w) / 2 as v from profile window w as (partition by image_id order by r)) where v is not null),
      d2 as (select * from (select image_id, r, (lead(v) over w - lag(v) over w) / 2 as v from d1 window w as (partition by image_id order by r)) where v is not null),
      dp as (select image_id, cast(r - 1 as int) as r from (select *, lag(v) over w as a, lead(v) over w as b from d2 window w as (partition by image_id order by r)) where v > a and v > b and v > 0),
      {greedy('dp', 5)}, {RINGS} select e.vec_id as image_id, coalesce(radii, []) as radii, cast(coalesce(len(radii), 0) as int) as ring_count from embeddings e left join rings on e.vec_id = rings.image_id""",
    "sobel_rings": f"""with recursive {CANVAS}, {SOBEL}, {rays('edges', 3, 23)}, q as (select image_id, r, round(v / max(v) over (partition by image_id), 9) as v from ray),
      qp as (select image_id, r from (select *, lag(v) over w as a, lead(v) over w as b from q window w as (partition by image_id order by r)) where v > a and v > b and v >= 0.5),
      {greedy('qp', 4)}, {RINGS} select i.image_id, coalesce(radii, []) as radii, cast(coalesce(len(radii), 0) as int) as ring_count from (select distinct image_id from canvas) i left join rings using (image_id)""",
    "gaussian_smooth": f"""with {PROFILE}, k as (select d, exp(-0.5 * pow(d / 2.5, 2)) as w from unnest(generate_series(-10, 10)) t(d)), n as (select image_id, max(r) + 1 as n from profile group by 1),
      s as (select p.image_id, p.r, k.w, (p.r + d) - 2 * n * cast(floor(cast(p.r + d as double) / (2 * n)) as int) as m, n from profile p join n using (image_id) cross join k)
      select s.image_id, s.r, round(sum(s.w * q.v) / (select sum(w) from k), 6) as v from s join profile q on q.image_id = s.image_id and q.r = case when m < n then m else 2 * n - 1 - m end group by 1, 2""",
    "vote_consolidate": f"""with recursive {PEAKS}, det as (select image_id // 10 as image_id, image_id % 10 as sector, r as radius from peaks),
      anchors(image_id, a) as (select image_id, min(radius) from det group by 1 union all select k.image_id, (select min(d.radius) from det d where d.image_id = k.image_id and d.radius > k.a + 2) from anchors k
        where exists (select 1 from det d where d.image_id = k.image_id and d.radius > k.a + 2)),
      g as (select k.image_id, k.a, count(distinct sector) as votes, cast(floor(quantile_cont(cast(radius as double), 0.5)) as int) as radius from anchors k join det d on d.image_id = k.image_id and d.radius between k.a and k.a + 2 group by 1, 2)
      select image_id, cast(row_number() over (partition by image_id order by a) as int) as ring, radius, cast(votes as int) as votes from g where votes >= 4""",
    "autocorrelation": f"with {AUTOCORRELATION} select l.image_id, l.lag, round(case when z.v <> 0 then l.v / z.v else l.v end, 6) as v from lags l join lags z on l.image_id = z.image_id and z.lag = 0",
    "dft_power": f"with {DFT} select image_id, k, round(power, 6) as power from power",
    "period_spacing": f"""with {DFT}, b as (select image_id, first(k order by round(power, 6) desc, k) as best_k, 64 / cast(first(k order by round(power, 6) desc, k) as double) as q from power group by 1)
      select image_id, best_k, cast(round_even(q, 0) as int) as spacing from b""",
    "percentile_radius": f"with {CANVAS} select image_id, round(quantile_cont(sqrt((x - 31.5) * (x - 31.5) + (y - 24.5) * (y - 24.5)), 0.87), 6) as r_valid from canvas where g > 127 group by 1",
    "moments_centre": f"with {CANVAS} select image_id, round(sum(x * g) / sum(g), 9) as cx, round(sum(y * g) / sum(g), 9) as cy from canvas where g > 127 group by 1",
    "nearest_centroid": f"with {NEAREST} select point_id, cast(centroid_id as int) as centroid_id from near",
    "lloyd_step": f"""with {NEAREST}, m as (select centroid_id, avg(v) as v, avg(h) as h from near group by 1) select cast(c.centroid_id as int) as centroid_id, round(coalesce(m.v, cv), 9) as v, round(coalesce(m.h, ch), 9) as h from {CENTROIDS} left join m using (centroid_id)""",
    "mask_coverage": f"with {CANVAS} select image_id, round(avg(cast(g > 127 as int)), 9) as coverage from canvas group by 1",
    "patch_grid": f"with {CANVAS} select image_id, y // 20 as patch_y, x // 20 as patch_x, count(*) as n, sum(g) as total from canvas group by 1, 2, 3",
    "unsharp_mask": f"with {CANVAS}, {GAUSS} select c.image_id, c.y, c.x, greatest(0.0, least(255.0, floor(c.g * 2.5 - b.g * 1.5 + 0.5))) as g from canvas c join blurred b using (image_id, y, x)",
    "annotation_explode": """with a as (select vec_id as image_id, s, p, cast(trunc(cast(embedding[s * 8 + p * 2 + 1] as double) * 100) as int) as x, cast(trunc(cast(embedding[s * 8 + p * 2 + 2] as double) * 100) as int) as y
      from embeddings, unnest(generate_series(0, 7)) a(s), unnest(generate_series(0, 3)) b(p)),
      e as (select *, coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2 from a window w as (partition by image_id, s order by p))
      select image_id, cast(s as int) as shape, count(*) as vertices, round(sum(sqrt(cast((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) as double))), 6) as perimeter from e group by 1, 2""",
    "pipeline_envelope": f"""with {JOBS} select jobId, clientId, case when o_orderkey % 17 = 0 then 'FAILED' else 'COMPLETED' end as status, case when o_orderkey % 17 <> 0 then file end as url,
      case when o_orderkey % 17 <> 0 then coalesce(mx, 0.0) end as x, case when o_orderkey % 17 = 0 then 'Failed to download image' end as error from jobs""",
    "stream_parse_available_now": "select event_id, cast(json_extract(props, '$.k') as int) as k from events",
    "url_manifest": "select regexp_extract(url, '([^/]*)$', 1) as filename, 'https://objects.invalid/pages/' || page_id || '.json' as url from pages",
    "image_scan_status": f"with {CANVAS} select 'canvas' || image_id as image, cast((max(y) + 1) * 4 as int) as height, 192 as width, 1 as channels, true as ok from canvas group by image_id union all select 'broken', -1, -1, -1, false",
    "image_slices": f"""with {CANVAS}, img as (select image_id, (max(y) + 1) * 4 as h from canvas group by 1), tall as (select distinct h from img),
      p as (select h, y, x, (degrees(atan2(cast(y - 100 as double), cast(x - 96 as double))) + 90 + 360) % 360 as a from tall, unnest(generate_series(0, h - 1)) t(y), unnest(generate_series(0, 191)) u(x)),
      s as (select h, y, x, cast(n as int) as n, least(cast(floor((a - a % (360.0::double / n)) / (360.0::double / n) + 0.5) as int), n - 1) as k from p, unnest(generate_series(3, 30)) v(n)),
      b as (select h, n, cast(k + 1 as int) as k, min(x) as x0, min(y) as y0, max(x) - min(x) + 1 as w, max(y) - min(y) + 1 as hh from s group by h, n, k)
      select 'canvas' || image_id as image, n as n_slices, k as slice_no, 'processed/' || n || '/canvas' || image_id || '/canvas' || image_id || '_' || k || '.png' as key,
        cast(x0 as int) as x0, cast(y0 as int) as y0, cast(w as int) as w, cast(hh as int) as h, 'SUCCESS' as status from img join b using (h)""",
    "kernel_erode": f"""with {CANVAS}, m as (select image_id, y, x, cast(g > 127 as double) as g from canvas)
      select a.image_id, a.y, a.x, min(b.g) as g from m a join m b on a.image_id = b.image_id and abs(a.y - b.y) + abs(a.x - b.x) <= 1 group by 1, 2, 3""",
    "kernel_dilate": f"""with {CANVAS}, m as (select image_id, y, x, cast(g > 127 as double) as g from canvas)
      select a.image_id, a.y, a.x, max(b.g) as g from m a join m b on a.image_id = b.image_id and abs(a.y - b.y) <= 2 and abs(a.x - b.x) <= 2 group by 1, 2, 3""",
    "kernel_blur": f"""with {CANVAS}, n as (select image_id, max(x) as mx, max(y) as my from canvas group by 1), k as (select d, exp(-0.5 * d * d) / sum(exp(-0.5 * d * d)) over () as w from unnest(generate_series(-2, 2)) t(d)),
      t as (select c.image_id, c.y, c.x, a.w * b.w as w, case when c.y + a.d < 0 then -(c.y + a.d) when c.y + a.d > my then 2 * my - c.y - a.d else c.y + a.d end as ty,
        case when c.x + b.d < 0 then -(c.x + b.d) when c.x + b.d > mx then 2 * mx - c.x - b.d else c.x + b.d end as tx from canvas c join n using (image_id) cross join k a cross join k b)
      select t.image_id, t.y, t.x, round_even(round(sum(t.w * q.g), 9), 0) as g from t join canvas q on q.image_id = t.image_id and q.y = t.ty and q.x = t.tx group by 1, 2, 3""",
    "kernel_gradient": f"""with {CANVAS}, {conv("canvas", "-1 0 1;-2 0 2;-1 0 1", "gx")}, {conv("canvas", "-1 -2 -1;0 0 0;1 2 1", "gy")}
      select gx.image_id, gx.y, gx.x, round(sqrt(gx.g * gx.g + gy.g * gy.g), 6) as g from gx join gy using (image_id, y, x)""",
    "kernel_resize": f"""with {CANVAS}, n as (select image_id, (max(y) + 1) // 2 as h from canvas group by 1)
      select c.image_id, cast(c.y // 2 as int) as y, cast(c.x // 2 as int) as x, round_even(avg(g), 0) as g from canvas c join n using (image_id) where c.y // 2 < h group by 1, 2, 3""",
    "kernel_luma": f"with {CANVAS} select image_id, y, x, round_even(round(0.299 * ((g * 13) % 256) + 0.587 * ((g * 7) % 256) + 0.114 * g, 9), 0) as g from canvas",
    "kernel_peaks": f"""with {PEAKS}, l as (select k.image_id, k.r, k.v, coalesce((select max(p.r) + 1 from profile p where p.image_id = k.image_id and p.r < k.r and p.v > k.v), 0) as a,
        coalesce((select min(p.r) - 1 from profile p where p.image_id = k.image_id and p.r > k.r and p.v > k.v), 100000) as b from peaks k)
      select l.image_id, l.r from l join profile p on p.image_id = l.image_id and p.r between l.a and l.b group by l.image_id, l.r, l.v
      having l.v - greatest(min(case when p.r <= l.r then p.v end), min(case when p.r >= l.r then p.v end)) >= 0.15""",
    "side_tables": """select 'img' || c_custkey as image, c_custkey % 61 + 0.25::double as x, c_custkey % 97 + 0.5::double as y, case when c_custkey % 5 <> 0 then cast(c_custkey % 40 as int) end as rings_count,
      case when c_custkey % 7 <> 0 then cast(c_custkey % 50 as int) end as centre_x, case when c_custkey % 7 <> 0 then cast(c_custkey % 30 as int) end as centre_y from customer""",
    "object_uploads": "select 'copies/' || n_regionkey || '/' || n_nationkey || '.txt' as key, cast(octet_length(encode(n_name)) as bigint) as bytes, true as ok from nation",
    "slow_task_count": "select cast(1000 as bigint) as n, cast(sum(i * 2) as bigint) as total from unnest(generate_series(0, 999)) t(i)",
}
