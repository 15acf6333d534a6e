"""SQL of the ordered steps: recursions that carry a step's state from row to row."""

from __future__ import annotations

from . import fixtures as X

_R = f"WITH RECURSIVE {X.SAMPLES}"
_RATES = "tp, fp, fn, tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS \"precision\", tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS recall"

_LISTS = f"""{X.TRUTH}, {X.FOUND}, {X.TRUE_SEGMENTS},
tl AS (SELECT game_id, list(frame_number ORDER BY frame_number) AS t FROM truth GROUP BY 1),
fl AS (SELECT game_id, list(start_frame ORDER BY start_frame) AS s, list(end_frame ORDER BY start_frame) AS e, list(side ORDER BY start_frame) AS d FROM found GROUP BY 1),
gl AS (SELECT game_id, list(start_frame ORDER BY start_frame) AS gs, list(end_frame ORDER BY start_frame) AS ge, list(side ORDER BY start_frame) AS gd FROM trues GROUP BY 1)"""

SEGMENT_SCORES = f"""{_R}, {_LISTS}, b AS (SELECT * FROM tl JOIN fl USING (game_id)),
r AS (SELECT game_id, 0 AS i, 0 AS tp, 0 AS fp FROM b UNION ALL
  SELECT game_id, i + 1, tp + CASE WHEN tp < len(t) AND e[i + 1] >= t[tp + 1] THEN 1 ELSE 0 END, fp + CASE WHEN tp < len(t) AND e[i + 1] < t[tp + 1] THEN 1 ELSE 0 END FROM r JOIN b USING (game_id) WHERE i < len(e)),
z AS (SELECT game_id, tp, fp, CAST(len(t) - tp AS INT) AS fn FROM r JOIN b USING (game_id) WHERE i = len(e))
SELECT game_id, {_RATES} FROM z"""

SEGMENT_SCORES_BETWEEN = f"""{_R}, {_LISTS}, b AS (SELECT * FROM tl JOIN fl USING (game_id)),
r AS (SELECT game_id, 0 AS i, 0 AS g, 0 AS tp, 0 AS fp, 0 AS fn FROM b UNION ALL
  SELECT game_id, i + 1,
    CASE k WHEN 1 THEN h + 1 WHEN 2 THEN h + w + (CASE WHEN h + w < n THEN 1 ELSE 0 END) ELSE h END,
    tp + CASE WHEN k = 1 OR (k = 2 AND h + w < n) THEN 1 ELSE 0 END, fp + CASE WHEN k = 0 THEN 1 ELSE 0 END, fn + CASE WHEN k = 2 THEN w ELSE 0 END
  FROM (SELECT *, CASE WHEN i = len(e) - 1 OR h >= n THEN 0 WHEN e[i + 1] <= t[h + 1] THEN (CASE WHEN t[h + 1] < e[i + 2] THEN 1 ELSE 0 END) WHEN e[i + 2] < t[h + 1] THEN 0 ELSE 2 END AS k,
      CAST(len(list_filter(t[h + 1:], lambda x: x < e[i + 1])) AS INT) AS w
    FROM (SELECT r.*, b.t, b.e, CAST(len(b.t) AS INT) AS n, CASE WHEN r.g = 0 AND len(b.t) > 0 AND b.s[r.i + 1] >= b.t[1] THEN 1 ELSE r.g END AS h FROM r JOIN b USING (game_id) WHERE r.i < len(b.e)))),
z AS (SELECT game_id, tp, fp, fn FROM r JOIN b USING (game_id) WHERE i = len(e))
SELECT game_id, {_RATES} FROM z"""

AGREEMENT = f"""{_R}, {_LISTS}, b AS (SELECT * FROM gl JOIN fl USING (game_id)),
r AS (SELECT game_id, 0 AS i, 0 AS g, 0.0::DOUBLE AS total, 0 AS extra, 0 AS missed FROM b UNION ALL
  SELECT game_id, CASE WHEN k IN (0, 1, 3) THEN i + 1 ELSE i END, CASE WHEN k IN (2, 3, 4) THEN g + 1 ELSE g END,
    total + CASE WHEN k = 3 THEN (least(ge[g + 1], e[i + 1]) - greatest(gs[g + 1], s[i + 1])) / CAST(e[i + 1] - s[i + 1] AS DOUBLE) ELSE 0 END, extra + CASE WHEN k = 1 THEN 1 ELSE 0 END, missed + CASE WHEN k = 2 THEN 1 ELSE 0 END
  FROM (SELECT *, CASE WHEN g >= len(gs) THEN 0 WHEN e[i + 1] < gs[g + 1] THEN 1 WHEN ge[g + 1] < s[i + 1] THEN 2 WHEN gd[g + 1] = d[i + 1] THEN 3 ELSE 4 END AS k FROM r JOIN b USING (game_id) WHERE i < len(s)))
SELECT game_id, CASE WHEN len(s) = extra THEN 0 ELSE round(100 * total / (len(s) - extra), 6) END AS percent, extra, missed FROM r JOIN b USING (game_id) WHERE i = len(s)"""

ZERO_CROSSINGS = f"""{_R}, {X.smoothing()}, v AS (SELECT game_id, list(value ORDER BY idx) AS v, CAST(count(*) AS INT) AS n FROM smooth GROUP BY 1),
r AS (SELECT game_id, 1 AS pos_, v[1] >= 0 AS sign, CAST([] AS BIGINT[]) AS out FROM v UNION ALL
  SELECT game_id, CASE WHEN hit THEN pos_ + 7 ELSE pos_ + 1 END, CASE WHEN hit THEN now ELSE sign END, CASE WHEN hit THEN list_append(out, CASE WHEN now THEN pos_ * 15 + 1 ELSE (pos_ - 1) * 15 + 1 END) ELSE out END
  FROM (SELECT *, now <> sign AND (list_sum(list_transform(range(1, 8), lambda k: v[least(pos_ + k, n - 1) + 1])) / 7 >= 2.0) <> sign AS hit FROM (SELECT r.*, v.v, v.n, v.v[r.pos_ + 1] >= 0 AS now FROM r JOIN v USING (game_id) WHERE r.pos_ < v.n))),
z AS (SELECT game_id, unnest(out) AS frame_number FROM r JOIN v USING (game_id) WHERE pos_ >= n)
SELECT game_id, frame_number, 'TRANSITION' AS status FROM z"""

TRANSITION_SCORES = ZERO_CROSSINGS.rsplit("\nSELECT", 1)[0] + f""",
{X.TRUTH}, tl AS (SELECT game_id, list(frame_number ORDER BY frame_number) AS t FROM truth GROUP BY 1), dl AS (SELECT game_id, list(frame_number ORDER BY frame_number) AS d FROM z GROUP BY 1),
b AS (SELECT game_id, coalesce(t, []) AS t, coalesce(d, []) AS d, CAST(len(coalesce(t, [])) AS INT) AS n FROM tl FULL JOIN dl USING (game_id)),
m AS (SELECT game_id, 0 AS i, 0 AS g, 0 AS tp, 0 AS fp, 0 AS fn FROM b UNION ALL
  SELECT game_id, i + 1, e, tp + CASE WHEN hit THEN 1 ELSE 0 END, fp + (CASE WHEN NOT hit AND h < n THEN 1 ELSE 0 END) + (CASE WHEN e = n THEN 1 ELSE 0 END), fn + CASE WHEN hit THEN p ELSE greatest(0, p - 1) END
  FROM (SELECT *, CASE WHEN hit THEN h + 1 WHEN h < n AND p > 0 THEN h - 1 ELSE h END AS e FROM (SELECT *, coalesce(h < n AND t[h + 1] - x <= 105, false) AS hit FROM (SELECT *, g + p AS h FROM
    (SELECT m.*, b.t, b.n, b.d[m.i + 1] AS x, CAST(len(list_filter(b.t[m.g + 1:], lambda y: b.d[m.i + 1] - y > 105)) AS INT) AS p FROM m JOIN b USING (game_id) WHERE m.i < len(b.d)))))),
q AS (SELECT game_id, tp, fp, CAST(fn + n - g AS INT) AS fn FROM m JOIN b USING (game_id) WHERE i = len(d))
SELECT game_id, {_RATES} FROM q"""

INHERITED_SIDES = f"""{_R}, m AS (SELECT *, last_value(CASE WHEN motion <> 'STILL' THEN motion END IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  first_value(CASE WHEN motion <> 'STILL' THEN motion END IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM samples),
r AS (SELECT game_id, idx, frame_number, motion, CAST(NULL AS VARCHAR) AS side FROM m WHERE idx = 0 UNION ALL
  SELECT m.game_id, m.idx, m.frame_number, m.motion, CASE WHEN m.motion <> 'STILL' THEN NULL WHEN r.side IS NOT NULL THEN r.side WHEN m.b <> m.a THEN (CASE m.b WHEN 'MOVINGRIGHT' THEN 'RIGHT' ELSE 'LEFT' END) END FROM r JOIN m ON m.game_id = r.game_id AND m.idx = r.idx + 1)
SELECT game_id, idx, frame_number, motion, side FROM r"""

SIMPLE_CANDIDATES = f"""WITH {X.SAMPLES}, m AS (SELECT game_id, idx, motion, lag(motion) OVER (PARTITION BY game_id ORDER BY idx) AS p, last_value(CASE WHEN motion <> 'STILL' THEN motion END IGNORE NULLS) OVER (PARTITION BY game_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM samples)
SELECT game_id, CAST(count(*) FILTER (motion <> 'STILL' AND p = 'STILL' AND b <> motion) AS INT) AS candidates FROM m GROUP BY 1"""


def valid_runs(runs: str) -> str:
    """CTE ``valid`` (game_id, run_id, valid) over a CTE ``runs``."""
    return f"""{runs}, vx AS (SELECT game_id, list(run_id ORDER BY run_id) AS id, list(is_positive ORDER BY run_id) AS p, list(CASE WHEN is_positive THEN max_mag ELSE -min_mag END ORDER BY run_id) AS m, CAST(count(*) AS INT) AS n FROM runs GROUP BY 1),
va AS (SELECT *, coalesce(list_avg(list_transform(list_filter(range(1, n + 1), lambda k: p[k]), lambda k: m[k])), 0) AS ap, coalesce(list_avg(list_transform(list_filter(range(1, n + 1), lambda k: NOT p[k]), lambda k: m[k])), 0) AS an FROM vx),
vr AS (SELECT game_id, 0 AS i, ap, an, 0 AS st, CAST([] AS BOOLEAN[]) AS ok FROM va UNION ALL
  SELECT game_id, CASE WHEN k = 1 THEN i ELSE i + 1 END, CASE WHEN k = 1 AND s THEN fresh ELSE ap END, CASE WHEN k = 1 AND NOT s THEN fresh ELSE an END, CASE WHEN k = 1 THEN i ELSE st END,
    CASE k WHEN 1 THEN ok WHEN 0 THEN list_append(ok, true) WHEN 2 THEN list_append(ok, false) ELSE list_append(ok, x > 0.3 * list_avg(list_transform(list_concat(list_reverse(list_filter(range(st + 1, i + 1), lambda k: ok[k] AND p[k] = s))[1:2], list_filter(range(i + 2, n + 1), lambda k: p[k] = s)[1:2]), lambda k: m[k]))) END
  FROM (SELECT *, CASE WHEN x >= a THEN 0 WHEN len(list_filter(range(i + 2, n + 1), lambda k: p[k] = s AND m[k] > a)) = 0 THEN 1 WHEN x < 0.3 * a THEN 2 ELSE 3 END AS k, list_avg(list_transform(list_filter(range(i + 1, n + 1), lambda k: p[k] = s), lambda k: m[k])) AS fresh
    FROM (SELECT vr.*, va.p, va.m, va.n, va.p[vr.i + 1] AS s, va.m[vr.i + 1] AS x, CASE WHEN va.p[vr.i + 1] THEN vr.ap ELSE vr.an END AS a FROM vr JOIN va USING (game_id) WHERE vr.i < va.n))),
valid AS (SELECT game_id, unnest(id) AS run_id, unnest(ok) AS valid FROM vr JOIN va USING (game_id) WHERE i = n)"""


def dead_band(fraction: float, offset: float) -> str:
    """CTEs up to ``marks`` (game_id, idx, frame_number, status)."""
    ahead = "list_position(list_transform(range(0, 5), lambda k: sd[least(a + k, n - 1) + 1] = o), true)"
    return f"""{_R}, {X.smoothing()}, v AS (SELECT game_id, list(CASE WHEN value <= {fraction - offset} THEN 'RIGHT' WHEN value >= {fraction + offset} THEN 'LEFT' ELSE '' END ORDER BY idx) AS sd, CAST(count(*) AS INT) AS n FROM smooth GROUP BY 1),
r AS (SELECT game_id, 0 AS a, '' AS o, CAST(NULL AS INT) AS place, CAST(NULL AS VARCHAR) AS status FROM v UNION ALL
  SELECT game_id, CASE WHEN here = '' AND o <> '' THEN a + 1 + CAST(coalesce(step - 1, 4) AS INT) ELSE a + 1 END, CASE WHEN settles THEN here WHEN leaves THEN '' ELSE o END,
    CASE WHEN settles THEN a WHEN leaves THEN a - 1 END, CASE WHEN settles THEN here || '_START' WHEN leaves THEN o || '_END' END
  FROM (SELECT *, here <> '' AND o = '' AND sd[least(a + 1, n - 1) + 1] <> '' AND sd[least(a + 2, n - 1) + 1] <> '' AS settles, here = '' AND o <> '' AND step IS NULL AS leaves
    FROM (SELECT r.*, v.sd, v.n, v.sd[r.a + 1] AS here, {ahead} AS step FROM r JOIN v USING (game_id) WHERE r.a < v.n))),
marks AS (SELECT game_id, CAST(place AS BIGINT) AS idx, CAST(place AS BIGINT) * 15 + 1 AS frame_number, status FROM r WHERE place IS NOT NULL)"""


CAMERA_CANDIDATES = f"""{_R}, v AS (SELECT game_id, list(motion ORDER BY idx) AS m, CAST(count(*) AS INT) AS n FROM samples GROUP BY 1),
r AS (SELECT game_id, 0 AS a, 0 AS late, CAST(NULL AS VARCHAR) AS mv, CAST(NULL AS INT) AS st, 0 AS still, 0 AS ag, CAST(NULL AS INT) AS s, CAST(NULL AS INT) AS e, CAST(NULL AS VARCHAR) AS side FROM v UNION ALL
  SELECT game_id, a + 1, CASE WHEN turns AND still > 30 THEN late + 1 ELSE late END, CASE WHEN mv IS NULL THEN nullif(x, 'STILL') WHEN turns THEN x ELSE mv END,
    CASE WHEN mv IS NULL THEN st WHEN x = 'STILL' THEN coalesce(st, a) WHEN x = mv OR turns THEN NULL ELSE st END,
    CASE WHEN turns THEN 0 WHEN mv IS NOT NULL AND x = 'STILL' AND st IS NOT NULL THEN still + 1 ELSE still END,
    CASE WHEN mv IS NULL OR x = 'STILL' THEN ag WHEN x = mv OR turns THEN 0 WHEN st IS NOT NULL THEN ag + 1 ELSE ag END,
    CASE WHEN turns AND still <= 30 THEN st END, CASE WHEN turns AND still <= 30 THEN a - ag - 1 END, CASE WHEN turns AND still <= 30 THEN (CASE x WHEN 'MOVINGLEFT' THEN 'RIGHT' ELSE 'LEFT' END) END
  FROM (SELECT *, coalesce(mv IS NOT NULL AND x <> 'STILL' AND x <> mv AND st IS NOT NULL AND ag + 1 > 1 AND still > 1, false) AS turns FROM (SELECT r.*, v.m[r.a - r.late + 1] AS x FROM r JOIN v USING (game_id) WHERE r.a < v.n))),
cands AS (SELECT game_id, CAST(s AS BIGINT) AS start_idx, CAST(e AS BIGINT) AS end_idx, side FROM r WHERE s IS NOT NULL)"""

ENTRY_RUNS = f"""{_R}, k AS (SELECT game_id, amplitude, row_number() OVER (PARTITION BY game_id ORDER BY amplitude DESC, idx) AS no, floor(round(count(*) OVER (PARTITION BY game_id) * 0.6, 9)) AS k FROM samples),
t AS (SELECT game_id, avg(amplitude) FILTER (no <= k) AS t FROM k GROUP BY 1),
v AS (SELECT game_id, list(amplitude > coalesce(t, 'inf'::DOUBLE) ORDER BY idx) AS strong, CAST(count(*) AS INT) AS n FROM samples JOIN t USING (game_id) GROUP BY 1),
r AS (SELECT game_id, 0 AS a, CAST(NULL AS INT) AS last_, CAST(NULL AS INT) AS found FROM v UNION ALL
  SELECT game_id, CASE WHEN long_ THEN upto ELSE a + 1 END, CASE WHEN hit THEN a ELSE last_ END, CASE WHEN hit THEN a END
  FROM (SELECT *, long_ AND (last_ IS NULL OR a - last_ > 10) AS hit FROM (SELECT *, strong[a + 1] AND upto - 1 - a >= 3 AS long_ FROM
    (SELECT r.*, v.strong, v.n, r.a + CAST(coalesce(list_position(v.strong[r.a + 1:], false) - 1, v.n - r.a) AS INT) AS upto FROM r JOIN v USING (game_id) WHERE r.a < v.n))))
SELECT game_id AS segment_id, CAST(found AS BIGINT) AS frame FROM r WHERE found IS NOT NULL"""

LEADER_CLUSTERS = f"""{_R}, v AS (SELECT game_id, list(event_id ORDER BY idx) AS e, CAST(count(*) AS INT) AS n FROM samples GROUP BY 1),
r AS (SELECT game_id, 0 AS i, 0 AS no, list_transform(range(n), lambda j: -1) AS c FROM v UNION ALL
  SELECT game_id, i + 1, CASE WHEN c[i + 1] < 0 THEN no + 1 ELSE no END,
    CASE WHEN c[i + 1] >= 0 THEN c ELSE list_transform(range(n), lambda j: CASE WHEN c[j + 1] >= 0 THEN c[j + 1] WHEN j = i OR (e[least(i, j) + 1] * 7 + e[greatest(i, j) + 1] * 13) % 120 >= 80 THEN no ELSE -1 END) END
  FROM (SELECT r.*, v.e, v.n FROM r JOIN v USING (game_id) WHERE r.i < v.n))
SELECT game_id, unnest(range(n)) AS image_id, CAST(unnest(c) AS INT) AS cluster FROM r JOIN v USING (game_id) WHERE i = n"""

TRACKED = f"""WITH RECURSIVE {X.BOXES}, seg AS (SELECT game_id AS segment_id, min(frame_number) AS f0, max(frame_number) - min(frame_number) AS len, arg_min(w, frame_number) AS rw, arg_min(h, frame_number) AS rh FROM boxes GROUP BY 1),
f AS (SELECT segment_id, frame_number - f0 AS a, x, (x + y) % 3 <> 0 AS holds, y % 2 = 0 AND x + w <= 130 AND y + h <= 100 AND abs(w - rw) <= 0.75 * rw AND abs(h - rh) <= 0.75 * rh AS starts FROM boxes JOIN seg ON segment_id = game_id),
r AS (SELECT segment_id, 0::BIGINT AS a, false AS running, CAST(NULL AS BIGINT) AS found FROM seg UNION ALL
  SELECT segment_id, CASE WHEN goes OR anew THEN a + 1 ELSE a + 2 END, goes OR anew, CASE WHEN goes OR anew THEN a END
  FROM (SELECT *, NOT goes AND a < len AND starts AS anew FROM (SELECT r.segment_id, r.a, len, r.running AND coalesce(holds, false) AS goes, coalesce(starts, false) AS starts FROM r JOIN seg USING (segment_id) LEFT JOIN f ON f.segment_id = r.segment_id AND f.a = r.a)) WHERE goes OR a < len)
SELECT r.segment_id, f0 + found AS frame, x FROM r JOIN seg USING (segment_id) JOIN f ON f.segment_id = r.segment_id AND f.a = found
UNION ALL SELECT segment_id, -2, NULL FROM r GROUP BY 1 HAVING count(found) = 0"""


def split_windows(windows: str, f: float, apart: float) -> str:
    """CTE ``split``: the smaller of two clusters of a segment's windows, over a CTE ``w``; two-means is the recursion."""
    return f"""{windows}, v AS (SELECT game_id, list(m ORDER BY idx) AS x, list(g ORDER BY idx) AS y, CAST(count(*) AS INT) AS n FROM w GROUP BY 1 HAVING count(*) >= 2),
v0 AS (SELECT *, list_transform(range(1, n + 1), lambda k: (x[k] - list_avg(x)) * (x[k] - list_avg(x)) + (y[k] - list_avg(y)) * (y[k] - list_avg(y))) AS d FROM v),
v1 AS (SELECT *, list_position(d, list_max(d)) AS i FROM v0),
v2 AS (SELECT *, list_transform(range(1, n + 1), lambda k: (x[k] - x[i]) * (x[k] - x[i]) + (y[k] - y[i]) * (y[k] - y[i])) AS e FROM v1),
v3 AS (SELECT *, list_position(e, list_max(e)) AS j FROM v2),
tm AS (SELECT game_id, 0 AS no, x[i] AS ax, y[i] AS ay, x[j] AS bx, y[j] AS by_, CAST([] AS BOOLEAN[]) AS lb, false AS done FROM v3 UNION ALL
  SELECT game_id, no + 1, nax, nay, nbx, nby, nl, no = 99 OR greatest((ax - nax) * (ax - nax) + (ay - nay) * (ay - nay), (bx - nbx) * (bx - nbx) + (by_ - nby) * (by_ - nby)) <= 0.000001
  FROM (SELECT *, coalesce(list_avg(list_transform(list_filter(range(1, n + 1), lambda k: NOT nl[k]), lambda k: x[k])), ax) AS nax, coalesce(list_avg(list_transform(list_filter(range(1, n + 1), lambda k: NOT nl[k]), lambda k: y[k])), ay) AS nay,
      coalesce(list_avg(list_transform(list_filter(range(1, n + 1), lambda k: nl[k]), lambda k: x[k])), bx) AS nbx, coalesce(list_avg(list_transform(list_filter(range(1, n + 1), lambda k: nl[k]), lambda k: y[k])), by_) AS nby
    FROM (SELECT tm.*, v.x, v.y, v.n, list_transform(range(1, v.n + 1), lambda k: (v.x[k] - bx) * (v.x[k] - bx) + (v.y[k] - by_) * (v.y[k] - by_) < (v.x[k] - ax) * (v.x[k] - ax) + (v.y[k] - ay) * (v.y[k] - ay)) AS nl FROM tm JOIN v USING (game_id) WHERE NOT done))),
tc AS (SELECT game_id, lb, len(list_filter(lb, lambda l: NOT l)) AS n0, len(list_filter(lb, lambda l: l)) AS n1, sqrt(ax * ax + ay * ay) AS r0, sqrt(bx * bx + by_ * by_) AS r1 FROM tm WHERE done),
split AS (SELECT game_id AS segment_id, idx, size, s AS start_frame, e AS end_frame FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY idx) AS k FROM w) JOIN tc USING (game_id)
  WHERE least(n0, n1) > 0 AND least(n0, n1) * {f} < greatest(n0, n1) AND greatest(r0, r1) > 0 AND abs(r0 - r1) / greatest(r0, r1) > {apart} AND lb[k] = (n0 >= n1))"""


#: From CTEs ``split`` and ``a`` on: overlapping windows become one, and each has its strongest moment.
STRONGEST_MOMENTS = """sl AS (SELECT *, coalesce(CASE WHEN lag(end_frame) OVER o <= start_frame THEN 1 ELSE 0 END, 1) AS nw FROM split WINDOW o AS (PARTITION BY segment_id ORDER BY start_frame, end_frame)),
si AS (SELECT *, sum(nw) OVER (PARTITION BY segment_id ORDER BY start_frame, end_frame) AS island FROM sl),
sm AS (SELECT segment_id, min(start_frame) AS start_frame, max([start_frame, end_frame])[2] AS end_frame, max(size) AS size FROM si GROUP BY segment_id, island),
sa AS (SELECT *, unnest(generate_series(start_frame, greatest(start_frame, end_frame - size), 5)) AS at_ FROM sm),
sg AS (SELECT sa.*, row_number() OVER (PARTITION BY segment_id, start_frame, end_frame, sa.size ORDER BY later.am - here.am DESC, at_) AS no FROM sa JOIN a here ON here.game_id = segment_id AND here.idx = at_ - start_frame JOIN a later ON later.game_id = segment_id AND later.idx = at_ - start_frame + sa.size),
se AS (SELECT segment_id, CAST(at_ + size // 3 AS BIGINT) AS frame FROM sg WHERE no = 1)
SELECT segment_id, frame FROM se UNION ALL SELECT DISTINCT game_id, CAST(-1 AS BIGINT) FROM a WHERE game_id NOT IN (SELECT segment_id FROM se)"""

MERGE_CLUSTERS = f"""{_R}, r AS (SELECT game_id, list({{'id': CAST(idx AS VARCHAR), 'n': 1, 'h': [CAST(event_id * 3 % 50 AS DOUBLE), CAST(event_id * 7 % 50 AS DOUBLE), CAST(event_id * 11 % 50 AS DOUBLE)]}} ORDER BY idx) AS held, false AS done FROM samples GROUP BY 1 UNION ALL
  SELECT game_id, CASE WHEN stops THEN held ELSE list_append(list_transform(list_filter(range(1, len(held) + 1), lambda k: k <> c.i AND k <> c.j), lambda k: held[k]), {{'id': held[c.i].id || '_' || held[c.j].id, 'n': held[c.i].n + held[c.j].n, 'h': list_transform(range(1, 4), lambda k: (held[c.i].h[k] + held[c.j].h[k]) / 2)}}) END, stops
  FROM (SELECT *, len(held) <= 3 OR c.d >= 1000 AS stops FROM (SELECT game_id, held, list_min(flatten(list_transform(range(1, len(held)), lambda i: list_transform(range(i + 1, len(held) + 1), lambda j: {{'d': sqrt((held[i].h[1] - held[j].h[1]) * (held[i].h[1] - held[j].h[1]) + (held[i].h[2] - held[j].h[2]) * (held[i].h[2] - held[j].h[2]) + (held[i].h[3] - held[j].h[3]) * (held[i].h[3] - held[j].h[3])), 'i': i, 'j': j}})))) AS c FROM r WHERE NOT done))),
f AS (SELECT game_id, unnest(held) AS c FROM r WHERE done)
SELECT game_id, c.id AS id, c.n AS members FROM f"""
