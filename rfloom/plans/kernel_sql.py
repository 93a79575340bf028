"""SQL of the image and trace kernels: each is a sum with a table of weights, so SQL can say it, though not as fast."""

from __future__ import annotations

from rfloom.functions.arrays import sql_rounded
from rfloom.plans.rf_queries import _EVERY_TRACE, _PIXELS, SQL

#: Weights of a Gaussian of sigma 1 cut at 4.
GAUSS = "gauss AS (SELECT k, exp(-0.5 * k * k) / sum(exp(-0.5 * k * k)) OVER () AS w FROM (SELECT CAST(unnest(range(-4, 5)) AS INT) AS k))"

SQL["gaussian_smooth"] = f"""WITH {_PIXELS}, {GAUSS}, fills AS (SELECT vec_id, median(v) AS f FROM pixels GROUP BY vec_id),
down AS (SELECT label, vec_id, y - k AS y, x, sum(w * (v - f)) AS d FROM pixels JOIN fills USING (vec_id), gauss WHERE y - k BETWEEN 0 AND 7 GROUP BY label, vec_id, y - k, x),
across AS (SELECT label, vec_id, y, x - k AS x, sum(w * d) AS d FROM down, gauss WHERE x - k BETWEEN 0 AND 7 GROUP BY label, vec_id, y, x - k)
SELECT label, vec_id, CAST(y * 8 + x AS INT) AS i, {sql_rounded('d + f')} AS v FROM across JOIN fills USING (vec_id)"""


def _polar(angles: int) -> str:
    """Bilinear samples of every image on ``angles`` x 4 points, out to 4 pixels from the middle; reflected at the edge."""
    inside = lambda c: f"CASE WHEN {c} % 16 >= 8 THEN 15 - {c} % 16 ELSE {c} % 16 END"
    return f"""spots AS (SELECT a, j, 4 + j * 4 / 3.0 * sin(radians(a * 360.0 / {angles})) AS py, 4 + j * 4 / 3.0 * cos(radians(a * 360.0 / {angles})) AS px FROM (SELECT unnest(range({angles})) AS a), (SELECT unnest(range(4)) AS j)),
corners AS (
  SELECT a, j, {inside('(CAST(floor(py) AS INT) + 16 + dy)')} AS y, {inside('(CAST(floor(px) AS INT) + 16 + dx)')} AS x, (CASE dy WHEN 1 THEN py - floor(py) ELSE 1 - py + floor(py) END) * (CASE dx WHEN 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) AS w
  FROM spots, (SELECT unnest(range(2)) AS dy), (SELECT unnest(range(2)) AS dx)),
polar AS (SELECT label, vec_id, a, j, sum(w * v) AS v FROM corners JOIN pixels USING (y, x) GROUP BY label, vec_id, a, j)"""


SQL["polar_transform"] = f"WITH {_PIXELS}, {_polar(36)} SELECT label, vec_id, CAST(a * 4 + j AS INT) AS i, {sql_rounded('v')} AS v FROM polar"

SQL["outline_curves"] = f"""WITH {_PIXELS}, {_polar(360)}, e AS (SELECT label, vec_id, a // 10 AS bin, j, avg(v) AS m FROM polar GROUP BY label, vec_id, a // 10, j),
peaks AS (SELECT label, vec_id, max(greatest(m, 0.0)) AS up, min(least(m, 0.0)) AS down FROM e GROUP BY label, vec_id),
sides AS (SELECT label, vec_id, bin, coalesce(avg(greatest(m, 0.0)) / nullif(max(up), 0) * 4, 0.0) AS centre, coalesce(avg(least(m, 0.0)) / nullif(min(down), 0) * 4, 0.0) AS surround FROM e JOIN peaks USING (label, vec_id) GROUP BY label, vec_id, bin)
SELECT label, vec_id, CAST(bin AS INT) AS i, {sql_rounded('centre')} AS v FROM sides UNION ALL SELECT label, vec_id, CAST(36 + bin AS INT), {sql_rounded('surround')} FROM sides
UNION ALL SELECT label, vec_id, CAST(72 + j AS INT), {sql_rounded('avg(m)')} FROM e GROUP BY label, vec_id, j"""

#: Windowed sinc of a low-pass for thinning by two.
FIR = "taps AS (SELECT k, w / sum(w) OVER () AS w FROM (SELECT k, CASE k WHEN 20 THEN 1 ELSE sin(pi() * (k - 20) / 2) / (pi() * (k - 20) / 2) END * (0.54 - 0.46 * cos(2 * pi() * k / 40)) AS w FROM (SELECT unnest(range(41)) AS k)))"
THINNED = f"{FIR}, places AS (SELECT j, least(greatest(2 * j + k - 20, 0), 7) AS src, sum(w) AS w FROM taps, (SELECT unnest(range(4)) AS j) GROUP BY ALL)"

SQL["decimated"] = f"WITH {_PIXELS}, {THINNED} SELECT label, vec_id, CAST(y * 4 + j AS INT) AS i, {sql_rounded('sum(w * v)')} AS v FROM pixels JOIN places ON x = src GROUP BY label, vec_id, y, j"
SQL["decimated_both"] = f"""WITH {_PIXELS}, {THINNED}, down AS (SELECT label, vec_id, j AS y, x, sum(w * v) AS v FROM pixels JOIN places ON y = src GROUP BY label, vec_id, j, x)
SELECT label, vec_id, CAST((y - 1) * 2 + j - 1 AS INT) AS i, {sql_rounded('sum(w * v)')} AS v FROM down JOIN places ON x = src WHERE y IN (1, 2) AND j IN (1, 2) GROUP BY label, vec_id, y, j"""

_WAVES = "waves AS (SELECT label, vec_id, f, g, sum(v * cos(2 * pi() * (f * y + g * x) / 8)) AS re, -sum(v * sin(2 * pi() * (f * y + g * x) / 8)) AS im FROM pixels, (SELECT unnest(range(8)) AS f), (SELECT unnest(range(8)) AS g) GROUP BY label, vec_id, f, g)"
SQL["spectrum"] = f"WITH {_PIXELS}, {_WAVES} SELECT label, vec_id, CAST((f + 4) % 8 * 8 + (g + 4) % 8 AS INT) AS i, {sql_rounded('ln(1 + sqrt(re * re + im * im))')} AS v FROM waves"

_SERIES = f"""{_EVERY_TRACE}, good AS (
  SELECT recording, channel, cell_index, v, len(v) AS n, 1000.0 / nullif(time_ms[2] - time_ms[1], 0) AS rate FROM paths WHERE len(v) >= {{least}} AND len(list_filter(v, lambda a: a IS NULL OR NOT isfinite(a))) = 0)"""
_ON = "p.recording IS NOT DISTINCT FROM q.recording AND p.channel IS NOT DISTINCT FROM q.channel AND p.cell_index IS NOT DISTINCT FROM q.cell_index"

SQL["bandpass"] = f"""WITH {_SERIES.format(least=8)}, long AS (
  SELECT recording, channel, cell_index, n, 3 * n - 2 AS l, rate, m, CASE WHEN m < n - 1 THEN 2 * v[1] - v[n - m] WHEN m < 2 * n - 1 THEN v[m - n + 2] ELSE 2 * v[n] - v[3 * n - 2 - m] END AS s
  FROM (SELECT *, unnest(range(3 * n - 2)) AS m FROM good WHERE rate > 0)),
waves AS (
  SELECT recording, channel, cell_index, any_value(n) AS n, any_value(l) AS l, k, any_value(rate) * k / any_value(l) AS f, sum(s * cos(2 * pi() * k * m / l)) AS re, -sum(s * sin(2 * pi() * k * m / l)) AS im
  FROM (SELECT *, unnest(range(1, l // 2 + 1)) AS k FROM long) GROUP BY recording, channel, cell_index, k),
gains AS (SELECT *, 1 / (1 + power((f * f - 40.0) / (f * 18.0), 10)) * CASE WHEN 2 * k = l THEN 1 ELSE 2 END / l AS gain FROM waves),
back AS (SELECT recording, channel, cell_index, position, sum(gain * (re * cos(2 * pi() * k * (position + n - 1) / l) - im * sin(2 * pi() * k * (position + n - 1) / l))) AS v FROM (SELECT *, unnest(range(n)) AS position FROM gains) GROUP BY recording, channel, cell_index, position)
SELECT p.recording, p.channel, p.cell_index, CAST(q.position AS INT) AS position, {sql_rounded('q.v')} AS v FROM paths p LEFT JOIN back q ON {_ON}"""

SQL["envelope"] = f"""WITH {_SERIES.format(least=1)},
each AS (SELECT recording, channel, cell_index, n, unnest(v) AS s, generate_subscripts(v, 1) - 1 AS m FROM good),
waves AS (SELECT recording, channel, cell_index, any_value(n) AS n, k, sum(s * cos(2 * pi() * k * m / n)) AS re, -sum(s * sin(2 * pi() * k * m / n)) AS im FROM (SELECT *, unnest(range(n // 2 + 1)) AS k FROM each) GROUP BY recording, channel, cell_index, k),
gains AS (SELECT *, CASE WHEN k = 0 OR 2 * k = n THEN 1.0 ELSE 2.0 END / n AS gain FROM waves),
back AS (
  SELECT recording, channel, cell_index, position, sum(gain * (re * cos(2 * pi() * k * position / n) - im * sin(2 * pi() * k * position / n))) AS a, sum(gain * (re * sin(2 * pi() * k * position / n) + im * cos(2 * pi() * k * position / n))) AS b
  FROM (SELECT *, unnest(range(n)) AS position FROM gains) GROUP BY recording, channel, cell_index, position)
SELECT p.recording, p.channel, p.cell_index, CAST(q.position AS INT) AS position, {sql_rounded('sqrt(a * a + b * b)')} AS v FROM paths p LEFT JOIN back q ON {_ON}"""

_CENTRED = f"{_PIXELS}, means AS (SELECT label, i, avg(v) AS m FROM pixels GROUP BY label, i), centred AS (SELECT label, vec_id, i, v - m AS v FROM pixels JOIN means USING (label, i))"
#: Covariances squared again and again: what is left is the leading direction, however close the next one is.
LEADING = f"""{_CENTRED},
cov AS (SELECT a.label, a.i AS p, b.i AS q, sum(a.v * b.v) AS c FROM centred a JOIN centred b USING (label, vec_id) GROUP BY a.label, a.i, b.i),
squared(step, label, p, q, c) AS (
  SELECT 0, label, p, q, c / sum(CASE WHEN p = q THEN c END) OVER (PARTITION BY label) FROM cov
  UNION ALL
  SELECT step, label, p, q, c / sum(CASE WHEN p = q THEN c END) OVER (PARTITION BY label) FROM (
    SELECT a.step + 1 AS step, a.label, a.p, b.q, sum(a.c * b.c) AS c FROM squared a JOIN squared b ON a.label = b.label AND a.q = b.p WHERE a.step < 14 GROUP BY a.step, a.label, a.p, b.q)),
tops AS (SELECT label, arg_max(p, (c, -p)) AS pixel FROM squared WHERE step = 14 AND p = q GROUP BY label)"""
SQL["dominant_pixel"] = f"WITH RECURSIVE {LEADING} SELECT label, pixel FROM tops"
