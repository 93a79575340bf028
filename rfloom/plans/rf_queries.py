"""Queries and SQL of the receptive-field operators.

``embeddings`` serves as a stack of 8 x 8 images: label = cell, vec_id = time,
position = pixel. Curves come from ``outlines`` and ``sta_traces``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rfloom.functions import arrays as A
from rfloom.functions import geometry as G
from rfloom.functions.arrays import rounded, sql_rounded
from rfloom.operators import cellwise, factorisation, graph, pairs, reduction, tensors
from rfloom.operators import statistics as S
from rfloom.tables import finite, join_same, table, written

SIDE = 8
CELL = ["recording", "channel", "cell_index"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_PIXELS = "pixels AS (SELECT label, vec_id, i, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, v FROM (SELECT label, vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS i FROM embeddings))"
_MAPS = f"{_PIXELS}, maps AS (SELECT label, i, y, x, avg(v) AS v FROM pixels GROUP BY ALL)"
_VARS = f"{_PIXELS}, vars AS (SELECT label, i, y, x, var_pop(v) AS vv FROM pixels GROUP BY ALL)"
_OUTLINES = """outs AS (
  SELECT outline_id, any_value(recording) AS recording, any_value(channel) AS channel, any_value(cell_index) AS cell_index, any_value(center) AS center, any_value(surround) AS surround, any_value(in_out) AS in_out, any_value(radius_um) AS radius_um
  FROM outlines GROUP BY outline_id),
whole AS (SELECT *, len(center) AS n FROM outs WHERE list_sum(center) <> 0 AND len(list_filter(center, lambda v: v IS NULL OR NOT isfinite(v))) = 0)"""
_TRACES = "paths AS (SELECT recording, channel, cell_index, any_value(time_ms) AS time_ms, any_value(v) AS v FROM sta_traces GROUP BY recording, channel, cell_index)"
_CELLS = "cells AS (SELECT recording, channel, cell_index, max(quality) AS quality, max(center_x) AS center_x, max(center_y) AS center_y FROM quality WHERE cell_index IS NOT NULL AND isfinite(quality) GROUP BY ALL)"
_CHANNELS = "stims AS (SELECT recording, channel, max(image_w) AS image_w, max(image_h) AS image_h, max(pixel_size) AS pixel_size, max(dt_ms) AS dt_ms, max(post_spike_bins) AS post_spike_bins, max(total_sta_len) AS total_sta_len, max(stimulus_id) AS stimulus_id FROM channels GROUP BY ALL)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    return tensors.long_view(table(spark, folder, "embeddings"), ["label", "vec_id"], "embedding", SIDE)


def maps(spark: SparkSession, folder: str) -> DataFrame:
    """Mean image of each cell."""
    return pixels(spark, folder).groupBy("label", "i", "y", "x").agg(F.avg("v").alias("v"))


def outlines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "outlines").drop("loaded_at").dropDuplicates(["outline_id"])


def whole_outlines(spark: SparkSession, folder: str) -> DataFrame:
    """Outlines whose centre curve has no holes and isn't zero."""
    return outlines(spark, folder).where((A.total("center") != 0) & (F.size(A.clean(F.col("center"))) == F.size("center")))


def every_outline(spark: SparkSession, folder: str) -> DataFrame:
    """All outlines, holes bridged around the circle; null curves where nothing is known."""
    return outlines(spark, folder).withColumns({c: cellwise.bridged(F.col(c)) for c in ("center", "surround")})


def every_trace(spark: SparkSession, folder: str) -> DataFrame:
    """All traces, holes bridged over time."""
    return traces(spark, folder).withColumn("v", cellwise.bridged(F.col("v"), F.col("time_ms")))


def traces(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sta_traces").dropDuplicates(CELL)


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Cells with a finite quality, each once."""
    rows = table(spark, folder, "quality").where(F.col("cell_index").isNotNull() & finite(F.col("quality")))
    return rows.groupBy(*CELL).agg(*[F.max(c).alias(c) for c in ("quality", "center_x", "center_y")])


def stimuli(spark: SparkSession, folder: str) -> DataFrame:
    names = ("image_w", "image_h", "pixel_size", "dt_ms", "post_spike_bins", "total_sta_len", "stimulus_id")
    return table(spark, folder, "channels").groupBy("recording", "channel").agg(*[F.max(c).alias(c) for c in names])


# --- statistics of image stacks -------------------------------------------------------------------


@query(f"WITH {_VARS} SELECT label, {sql_rounded('max(vv) / median(vv)')} AS quality, arg_max(x, (vv, -x, -y)) AS center_x, arg_max(y, (vv, -x, -y)) AS center_y FROM vars GROUP BY label")
def rf_quality(spark, folder):
    return S.rf_quality(pixels(spark, folder), ["label"]).withColumn("quality", rounded(F.col("quality")))


@query(f"WITH {_VARS} SELECT label, y, x, {sql_rounded('vv', 9)} AS var FROM vars")
def variance_map(spark, folder):
    return S.variance_map(pixels(spark, folder), ["label"]).withColumn("var", rounded(F.col("var"), 9))


@query(f"WITH {_PIXELS}, spikes AS (SELECT label, count(*) AS spikes FROM embeddings GROUP BY label) SELECT label, y, x, {sql_rounded('max((v / spikes - 0.5) * (v / spikes - 0.5))', 9)} AS rms FROM pixels JOIN spikes USING (label) GROUP BY label, y, x")
def max_square_deviation(spark, folder):
    spikes = table(spark, folder, "embeddings").groupBy("label").agg(F.count("*").alias("spikes"))
    return S.max_square_deviation(pixels(spark, folder), spikes, ["label"], "spikes").withColumn("rms", rounded(F.col("rms"), 9))


@query(f"""WITH {_VARS}, best AS (SELECT label, arg_max(i, (vv, -x, -y)) AS k FROM vars GROUP BY label), ref AS (SELECT p.label, vec_id, v AS r FROM pixels p JOIN best b ON p.label = b.label AND p.i = b.k)
SELECT label, y, x, {sql_rounded('covar_samp(v, r)', 9)} AS cov FROM pixels JOIN ref USING (label, vec_id) GROUP BY label, y, x""")
def covariance_with_pixel(spark, folder):
    stack = pixels(spark, folder)
    centre = S.rf_quality(stack, ["label"]).select("label", F.col("center_x").alias("x"), F.col("center_y").alias("y"))
    reference = stack.join(centre, ["label", "x", "y"]).select("label", "vec_id", F.col("v").alias("r"))
    return S.covariance_with_reference(stack, reference, ["label"], "vec_id").withColumn("cov", rounded(F.col("cov"), 9))


@query(f"WITH {_PIXELS}, sums AS (SELECT label, vec_id, sum(v) AS s FROM pixels GROUP BY ALL) SELECT label, y, x, {sql_rounded('covar_samp(v, s) - var_samp(v)', 9)} AS total FROM pixels JOIN sums USING (label, vec_id) GROUP BY label, y, x")
def covariance_row_sum(spark, folder):
    return S.covariance_row_sum(pixels(spark, folder), ["label"], "vec_id").withColumn("total", rounded(F.col("total"), 9))


_COV = f"{_PIXELS}, cov AS (SELECT p.label, p.i AS p, q.i AS q, covar_samp(p.v, q.v) AS c FROM pixels p JOIN pixels q ON p.label = q.label AND p.vec_id = q.vec_id AND p.i <= q.i GROUP BY ALL)"


def _edges(spark, folder):
    return reduction.covariance_edges(table(spark, folder, "embeddings"), "label", "embedding", SIDE * SIDE, 0.003)


@query(f"WITH {_COV} SELECT label, p, q, {sql_rounded('c', 9)} AS weight FROM cov WHERE p < q AND abs(c) > 0.003")
def covariance_edges(spark, folder):
    return _edges(spark, folder).withColumn("weight", rounded(F.col("weight"), 9))


@query(f"WITH {_COV}, e AS (SELECT * FROM cov WHERE p < q AND abs(c) > 0.003) SELECT label, node, sign(sum(c)) AS sign, count(*) AS degree FROM (SELECT label, p AS node, c FROM e UNION ALL SELECT label, q, c FROM e) GROUP BY label, node".replace("sign(sum(c)) AS sign", "CAST(sign(sum(c)) AS DOUBLE) AS sign"))
def node_sign(spark, folder):
    return pairs.node_signs(_edges(spark, folder), ["label"])


@query(f"""WITH {_COV}, top AS (SELECT label, q, max(c) AS c, arg_max(p, (c, -p)) AS p FROM cov WHERE p < q GROUP BY label, q)
SELECT label, p, count(*) AS n FROM (SELECT label, CASE WHEN c > 0 THEN p WHEN c = 0 THEN least(p, q) ELSE q END AS p FROM top) GROUP BY label, p""")
def cov_argmax_count(spark, folder):
    return reduction.column_leaders(table(spark, folder, "embeddings"), "label", "embedding", SIDE * SIDE)


@query(f"WITH {_MAPS} SELECT label, y, x, {sql_rounded('v', 9)} AS v FROM maps WHERE x >= 1 AND x < 5 AND y >= 2 AND y < 6")
def square_mask(spark, folder):
    return maps(spark, folder).where(tensors.in_square(F.col("x"), F.col("y"), (3, 4), (4, 4))).select("label", "y", "x", rounded(F.col("v"), 9).alias("v"))


@query(f"WITH {_MAPS} SELECT label, y, x, {sql_rounded('v', 9)} AS v FROM maps WHERE x >= 4 AND x < 8 AND y >= 0 AND y < 4")
def square_mask_shifted(spark, folder):
    inside = tensors.in_square(F.col("x"), F.col("y"), (7, 1), (4, 4), (SIDE, SIDE))
    return maps(spark, folder).where(inside).select("label", "y", "x", rounded(F.col("v"), 9).alias("v"))


@query(f"WITH {_MAPS} SELECT label, y, x, {sql_rounded('v', 9)} AS v FROM maps WHERE sqrt((x - 4) * (x - 4) + (y - 4) * (y - 4)) <= 3")
def circle_mask(spark, folder):
    return maps(spark, folder).where(tensors.in_circle(F.col("x"), F.col("y"), (4, 4), 3)).select("label", "y", "x", rounded(F.col("v"), 9).alias("v"))


@query(f"""WITH {_MAPS}, m AS (SELECT label, quantile_cont(v, 0.9) AS c FROM maps GROUP BY label), box AS (SELECT label, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM maps JOIN m USING (label) WHERE v > c GROUP BY label)
SELECT label, y, x, {sql_rounded('v', 9)} AS v FROM maps JOIN box USING (label) WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1""")
def bbox_crop(spark, folder):
    rows = maps(spark, folder)
    cut = rows.groupBy("label").agg(F.percentile("v", F.lit(0.9)).alias("cut"))
    return tensors.cropped(rows.join(cut, "label"), ["label"], F.col("v") > F.col("cut")).select("label", "y", "x", rounded(F.col("v"), 9).alias("v"))


@query(f"WITH {_MAPS}, m AS (SELECT label, quantile_cont(v, 0.95) AS c FROM maps GROUP BY label) SELECT label, NOT bool_or(v > c AND (y IN (0, 7) OR x IN (0, 7))) AS clear FROM maps JOIN m USING (label) GROUP BY label")
def border_check(spark, folder):
    rows = maps(spark, folder)
    cut = rows.groupBy("label").agg(F.percentile("v", F.lit(0.95)).alias("cut"))
    return tensors.border_is_clear(rows.join(cut, "label"), ["label"], F.col("v") > F.col("cut"), SIDE, SIDE)


@query(f"""WITH {_MAPS}, m AS (SELECT label, median(v) AS f FROM maps GROUP BY label)
SELECT label, y, x, {sql_rounded('v', 9)} AS v FROM maps UNION ALL SELECT label, y, x, {sql_rounded('f', 9)} FROM m, (SELECT unnest(range(-2, 10)) AS y), (SELECT unnest(range(-2, 10)) AS x) WHERE NOT (y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7)""")
def median_padding(spark, folder):
    return tensors.padded(maps(spark, folder), ["label"], SIDE, SIDE, 2).withColumn("v", rounded(F.col("v"), 9))


@query(f"WITH {_MAPS}, e AS (SELECT label, floor(CASE WHEN atan2(y - 4, x - 4) < 0 THEN degrees(atan2(y - 4, x - 4)) + 360 ELSE degrees(atan2(y - 4, x - 4)) END / 45) AS sector, round(sqrt((x - 4) * (x - 4) + (y - 4) * (y - 4))) AS r, v FROM maps) SELECT label, CAST(sector AS BIGINT) AS sector, CAST(r AS BIGINT) AS r, {sql_rounded('avg(v)', 9)} AS mean FROM e GROUP BY ALL")
def polar_bins(spark, folder):
    angle, far = G.polar(F.col("x") - 4, F.col("y") - 4)
    binned = maps(spark, folder).select("label", F.floor(angle / 45).alias("sector"), F.round(far).cast("bigint").alias("r"), "v")
    return binned.groupBy("label", "sector", "r").agg(rounded(F.avg("v"), 9).alias("mean"))


@query(f"""WITH {_MAPS}, e AS (SELECT label, CAST(floor(pmod / 45) AS BIGINT) AS sector, r, avg(v) AS m FROM (SELECT label, CASE WHEN atan2(y - 4, x - 4) < 0 THEN degrees(atan2(y - 4, x - 4)) + 360 ELSE degrees(atan2(y - 4, x - 4)) END AS pmod, round(sqrt((x - 4) * (x - 4) + (y - 4) * (y - 4))) AS r, v FROM maps) GROUP BY ALL),
t AS (SELECT *, max(greatest(m, 0)) OVER (PARTITION BY label) AS up, min(least(m, 0)) OVER (PARTITION BY label) AS down FROM e)
SELECT label, sector, {sql_rounded('coalesce(avg(greatest(m, 0.0)) / nullif(max(up), 0), 0) * 4')} AS center, {sql_rounded('coalesce(avg(least(m, 0.0)) / nullif(min(down), 0), 0) * 4')} AS surround FROM t GROUP BY label, sector""")
def center_outline(spark, folder):
    angle, far = G.polar(F.col("x") - 4, F.col("y") - 4)
    e = maps(spark, folder).groupBy("label", F.floor(angle / 45).alias("sector"), F.round(far).alias("r")).agg(F.avg("v").alias("m"))
    peaks = e.groupBy("label").agg(F.max(F.greatest("m", F.lit(0.0))).alias("up"), F.min(F.least("m", F.lit(0.0))).alias("down"))
    side = lambda f, peak: rounded(F.coalesce(F.avg(f("m", F.lit(0.0))) / F.nullif(F.first(peak), F.lit(0.0)), F.lit(0.0)) * 4)
    return e.join(peaks, "label").groupBy("label", "sector").agg(side(F.greatest, "up").alias("center"), side(F.least, "down").alias("surround"))


@query(f"WITH {_MAPS} SELECT label, CAST(round(sqrt((x - 4) * (x - 4) + (y - 4) * (y - 4))) AS BIGINT) AS r, {sql_rounded('avg(v)', 9)} AS mean FROM maps GROUP BY ALL")
def in_out_profile(spark, folder):
    return maps(spark, folder).groupBy("label", F.round(F.hypot(F.col("x") - 4.0, F.col("y") - 4.0)).cast("bigint").alias("r")).agg(rounded(F.avg("v"), 9).alias("mean"))


@query(f"WITH {_MAPS}, t AS (SELECT label, max(v) AS top FROM maps GROUP BY label) SELECT y, x, {sql_rounded('max(v / nullif(top, 0))')} AS projection FROM maps JOIN t USING (label) GROUP BY y, x")
def max_projection(spark, folder):
    rows = maps(spark, folder)
    top = rows.groupBy("label").agg(F.max("v").alias("top"))
    return rows.join(top, "label").groupBy("y", "x").agg(rounded(F.max(F.col("v") / F.nullif(F.col("top"), F.lit(0.0)))).alias("projection"))


@query(f"WITH {_PIXELS}, m AS (SELECT label, i, sum(v) AS s, median(v) AS med FROM pixels GROUP BY ALL) SELECT label, vec_id, i, {sql_rounded('v - (s / 100 - med)', 9)} AS corrected FROM pixels JOIN m USING (label, i)")
def median_correction(spark, folder):
    rows = pixels(spark, folder)
    sums = rows.groupBy("label", "i").agg(F.sum("v").alias("s"), F.median("v").alias("med"))
    return rows.join(sums, ["label", "i"]).select("label", "vec_id", "i", rounded(F.col("v") - (F.col("s") / 100 - F.col("med")), 9).alias("corrected"))


@query(f"WITH {_PIXELS}, m AS (SELECT label, i, avg(v) AS m FROM pixels GROUP BY ALL) SELECT label, vec_id, {sql_rounded('sum((v - 0.5) * (m - 0.5))', 9)} AS projection FROM pixels JOIN m USING (label, i) GROUP BY label, vec_id")
def signed_projection(spark, folder):
    stack = pixels(spark, folder).withColumnRenamed("vec_id", "t")
    average = maps(spark, folder).select("label", "y", "x", F.col("v").alias("sta"))
    return S.signed_projection(stack, average, ["label"], 0.5).select("label", F.col("t").alias("vec_id"), rounded(F.col("projection"), 9).alias("projection"))


@query(f"WITH {_PIXELS} SELECT label, y, x, {sql_rounded('sum(v * (vec_id % 7)) / nullif(sum(vec_id % 7), 0)', 9)} AS sta FROM pixels GROUP BY label, y, x")
def triggered_average(spark, folder):
    weighted = pixels(spark, folder).withColumn("w", F.col("vec_id") % 7)
    return S.triggered_average(weighted, ["label"], "w").withColumn("sta", rounded(F.col("sta"), 9))


@query(f"WITH {_PIXELS} SELECT label, i, CAST(sign(arg_max(v, (abs(v), v))) AS DOUBLE) AS sign FROM pixels GROUP BY label, i")
def peak_polarity(spark, folder):
    return pixels(spark, folder).groupBy("label", "i").agg(S.polarity(F.col("v")).alias("sign"))


@query(f"WITH {_PIXELS}, l AS (SELECT label, quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM pixels GROUP BY label) SELECT label, CASE WHEN v > hi THEN 'high' WHEN v < lo THEN 'low' ELSE 'middle' END AS side, count(*) AS n FROM pixels JOIN l USING (label) GROUP BY ALL")
def quantile_mask(spark, folder):
    return S.quantile_split(pixels(spark, folder), ["label"], "v", 0.05, 0.95).groupBy("label", "side").agg(F.count("*").alias("n"))


@query(f"WITH {_PIXELS} SELECT CAST(floor(v / 0.01) AS BIGINT) AS bin, count(*) AS n FROM pixels GROUP BY ALL")
def histogram(spark, folder):
    return S.histogram(pixels(spark, folder), "v", 0.01)


@query(f"WITH {_PIXELS} SELECT label, {sql_rounded('median(abs(v))', 9)} AS median_abs, {sql_rounded('max(abs(v))', 9)} AS abs_max FROM pixels GROUP BY label")
def absolute_scale(spark, folder):
    return pixels(spark, folder).groupBy("label").agg(rounded(F.median(F.abs("v")), 9).alias("median_abs"), rounded(F.max(F.abs("v")), 9).alias("abs_max"))


# --- scaling ---------------------------------------------------------------------------------------


@query(f"WITH {_PIXELS}, m AS (SELECT label, avg(v) AS a, stddev_pop(v) AS s FROM pixels GROUP BY label) SELECT label, vec_id, i, {sql_rounded('(v - a) / nullif(s, 0)')} AS z FROM pixels JOIN m USING (label)")
def zscore_global(spark, folder):
    return S.zscored(pixels(spark, folder), ["label"], "v").select("label", "vec_id", "i", rounded(F.col("z")).alias("z"))


@query(f"WITH {_PIXELS}, m AS (SELECT label, i, avg(v) AS a, stddev_pop(v) AS s FROM pixels GROUP BY ALL) SELECT label, vec_id, i, {sql_rounded('(v - a) / nullif(s, 0)')} AS z FROM pixels JOIN m USING (label, i)")
def zscore_column(spark, folder):
    return S.zscored(pixels(spark, folder), ["label", "i"], "v").select("label", "vec_id", "i", rounded(F.col("z")).alias("z"))


_LIST_TAIL = "list_transform(v, lambda a: CAST(a AS DOUBLE))"


@query(f"""WITH {_TRACES}, w AS (SELECT recording, channel, cell_index, list_transform(v, lambda a: CAST(a AS DOUBLE)) AS d FROM paths WHERE len(list_filter(v, lambda a: a IS NULL OR NOT isfinite(a))) = 0 AND len(v) > 0),
s AS (SELECT *, list_avg(d) AS m, list_stddev_pop(list_slice(d, greatest(len(d) - 29, 1), len(d))) AS sd FROM w), e AS (SELECT recording, channel, cell_index, m, sd, unnest(d) AS x, generate_subscripts(d, 1) - 1 AS position FROM s)
SELECT recording, channel, cell_index, CAST(position AS INT) AS position, {sql_rounded('(x - m) / coalesce(nullif(sd, 0), 1)', 4)} AS z FROM e""")
def zscore_tail(spark, folder, traces_of=traces):
    whole = traces_of(spark, folder).where((F.size(A.clean(F.col("v"))) == F.size("v")) & (F.size("v") > 0))
    z = A.tail_zscore(F.transform("v", lambda v: v.cast("double")))
    return whole.select(*CELL, F.posexplode(z).alias("position", "z")).withColumn("z", rounded(F.col("z"), 4))


@query(f"""WITH {_TRACES}, w AS (SELECT * FROM paths WHERE len(list_filter(v, lambda a: a IS NULL OR NOT isfinite(a))) = 0), e AS (SELECT recording, channel, cell_index, CAST(unnest(v) AS DOUBLE) AS x, unnest(time_ms) AS t, generate_subscripts(v, 1) - 1 AS position FROM w),
m AS (SELECT recording, channel, cell_index, avg(x) AS a, stddev_samp(x) AS s FROM e WHERE t > 0 GROUP BY ALL) SELECT recording, channel, cell_index, CAST(position AS INT) AS position, {sql_rounded('(x - a) / nullif(s, 0)', 4)} AS z FROM e LEFT JOIN m USING (recording, channel, cell_index)""")
def zscore_noise(spark, folder, traces_of=traces):
    whole = traces_of(spark, folder).where(F.size(A.clean(F.col("v"))) == F.size("v"))
    return whole.select(*CELL, F.posexplode(A.noise_zscore(F.col("v"), F.col("time_ms"))).alias("position", "z")).withColumn("z", rounded(F.col("z"), 4))


@query(f"WITH {_PIXELS}, m AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM pixels GROUP BY vec_id) SELECT vec_id, i, CAST(CASE WHEN hi = lo THEN 0 ELSE floor((v - lo) / (hi - lo) * 255 + 0.5) END AS SMALLINT) AS grey FROM pixels JOIN m USING (vec_id)")
def minmax_uint8(spark, folder):
    values = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, folder, "embeddings").select("vec_id", F.posexplode(A.minmax_bytes(values)).alias("i", "grey"))


@query(f"WITH {_PIXELS}, m AS (SELECT vec_id, sqrt(sum(v * v)) AS l FROM pixels GROUP BY vec_id) SELECT vec_id, i, {sql_rounded('v / nullif(l, 0)')} AS unit FROM pixels JOIN m USING (vec_id)")
def l2_normalize(spark, folder):
    values = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, folder, "embeddings").select("vec_id", F.posexplode(A.l2_normalised(values)).alias("i", "unit")).withColumn("unit", rounded(F.col("unit")))


@query(f"WITH {_PIXELS}, m AS (SELECT vec_id, max(abs(v)) AS l FROM pixels GROUP BY vec_id) SELECT vec_id, i, {sql_rounded('v / nullif(l, 0)')} AS scaled FROM pixels JOIN m USING (vec_id)")
def row_max_normalise(spark, folder):
    values = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, folder, "embeddings").select("vec_id", F.posexplode(A.row_max_normalised(values)).alias("i", "scaled")).withColumn("scaled", rounded(F.col("scaled")))


@query(f"WITH {_PIXELS}, m AS (SELECT i, avg(v) AS a, stddev_pop(v) AS s FROM pixels GROUP BY i) SELECT vec_id, i, {sql_rounded('(v - a) / nullif(s, 0)')} AS z FROM pixels JOIN m USING (i)")
def standard_scale(spark, folder):
    return S.zscored(pixels(spark, folder), ["i"], "v").select("vec_id", "i", rounded(F.col("z")).alias("z"))


@query(f"WITH {_PIXELS}, m AS (SELECT i, median(v) AS med, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM pixels GROUP BY i) SELECT vec_id, i, {sql_rounded('(v - med) / coalesce(nullif(iqr / 1.3489795003921634, 0), 1)')} AS scaled FROM pixels JOIN m USING (i)")
def robust_scale(spark, folder):
    return S.robust_scaled(pixels(spark, folder), ["i"], "v").select("vec_id", "i", rounded(F.col("scaled")).alias("scaled"))


# --- outlines and traces: no shuffle beyond removing repeated rows ----------------------------------


@query(f"WITH {_OUTLINES}, e AS (SELECT outline_id, n, unnest(center) AS a, unnest(list_concat(center[2:], center[1:1])) AS b FROM whole WHERE n >= 3) SELECT outline_id, {sql_rounded('0.5 * sin(2 * pi() / n) * sum(a * b)', 3)} AS area FROM e GROUP BY outline_id, n")
def radial_area(spark, folder, rows_of=whole_outlines):
    return rows_of(spark, folder).where(F.size("center") >= 3).select("outline_id", rounded(G.radial_area(F.col("center")), 3).alias("area"))


_POINTS = f"""{_OUTLINES}, e AS (SELECT outline_id, n, unnest(center) AS r, generate_subscripts(center, 1) - 1 AS i FROM whole), p AS (SELECT outline_id, r * cos(i * 2 * pi() / n) AS x, r * sin(i * 2 * pi() / n) AS y FROM e),
c AS (SELECT outline_id, x, y, x - avg(x) OVER w AS u, y - avg(y) OVER w AS v, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM p WINDOW w AS (PARTITION BY outline_id)),
m AS (SELECT outline_id, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, sum(u*u) AS suu, sum(v*v) AS svv, sum(u*v) AS suv, sum(u*u*u) AS suuu, sum(v*v*v) AS svvv, sum(u*v*v) AS suvv, sum(v*u*u) AS svuu FROM c GROUP BY outline_id),
k AS (SELECT *, ((suuu + suvv) / 2 * svv - (svvv + svuu) / 2 * suv) / nullif(suu * svv - suv * suv, 0) AS uc, ((svvv + svuu) / 2 * suu - (suuu + suvv) / 2 * suv) / nullif(suu * svv - suv * suv, 0) AS vc FROM m)"""


def _fitted(spark, folder, rows_of=whole_outlines):
    rows = rows_of(spark, folder).select("outline_id", G.vertices(F.col("center")).alias("points"))
    return rows.withColumn("m", G.moments(F.col("points"))).withColumn("circle", G.circle_fit(F.col("m")))


@query(f"WITH {_POINTS} SELECT outline_id, {sql_rounded('uc + mx', 3)} AS xc, {sql_rounded('vc + my', 3)} AS yc, {sql_rounded('sqrt(uc * uc + vc * vc + (suu + svv) / n)', 3)} AS radius FROM k")
def circle_fit(spark, folder, rows_of=whole_outlines):
    return _fitted(spark, folder, rows_of).select("outline_id", *[rounded(F.col(f"circle.{c}"), 3).alias(c) for c in ("xc", "yc", "radius")])


@query(f"WITH {_POINTS} SELECT outline_id, {sql_rounded('max(sqrt((x - uc - k.mx) * (x - uc - k.mx) + (y - vc - k.my) * (y - vc - k.my))) - min(sqrt((x - uc - k.mx) * (x - uc - k.mx) + (y - vc - k.my) * (y - vc - k.my)))', 3)} AS tir, {sql_rounded('sqrt(any_value(uc + k.mx) * any_value(uc + k.mx) + any_value(vc + k.my) * any_value(vc + k.my))', 3)} AS center_shift FROM p JOIN k USING (outline_id) GROUP BY outline_id")
def roundness(spark, folder, rows_of=whole_outlines):
    return _fitted(spark, folder, rows_of).select("outline_id", rounded(G.tir(F.col("points"), F.col("circle")), 3).alias("tir"), rounded(F.hypot("circle.xc", "circle.yc"), 3).alias("center_shift"))


@query(f"WITH {_POINTS}, a AS (SELECT *, (suu + svv) / 2 AS h, sqrt((suu - svv) * (suu - svv) / 4 + suv * suv) AS r FROM k) SELECT outline_id, {sql_rounded('sqrt(greatest(h - r, 0) / nullif(h + r, 0))')} AS tilt, {sql_rounded('(degrees(atan2(2 * suv, suu - svv) / 2) + 180) % 180', 3)} AS angle FROM a")
def tilt_angle(spark, folder, rows_of=whole_outlines):
    return _fitted(spark, folder, rows_of).select("outline_id", rounded(G.tilt(F.col("m"))).alias("tilt"), rounded(G.axis_angle(F.col("m")), 3).alias("angle"))


@query(f"WITH {_OUTLINES} SELECT outline_id, len(center) AS bins, {sql_rounded('list_max(center)')} AS longest, {sql_rounded('list_min(center)')} AS shortest, list_position(center, list_max(center)) - 1 AS first_longest FROM whole".replace("len(center) AS bins", "CAST(len(center) AS INT) AS bins").replace("list_position(center, list_max(center)) - 1", "CAST(list_position(center, list_max(center)) - 1 AS BIGINT)"))
def array_extrema(spark, folder, rows_of=whole_outlines):
    return rows_of(spark, folder).select("outline_id", F.size("center").alias("bins"), rounded(F.array_max("center")).alias("longest"), rounded(F.array_min("center")).alias("shortest"), A.first_argmax(F.col("center")).alias("first_longest"))


@query(f"WITH {_OUTLINES}, e AS (SELECT channel, len(center) AS bins, unnest(center) AS v, generate_subscripts(center, 1) - 1 AS position FROM outs) SELECT channel, CAST(bins AS INT) AS bins, CAST(position AS INT) AS position, {sql_rounded('avg(v)', 3)} AS mean FROM e WHERE isfinite(v) GROUP BY ALL")
def mean_outline(spark, folder):
    return S.explode_mean(outlines(spark, folder).withColumn("bins", F.size("center")), ["channel", "bins"], "center").withColumn("mean", rounded(F.col("mean"), 3))


@query(f"WITH {_OUTLINES}, e AS (SELECT outline_id, unnest(in_out) AS v, unnest(radius_um) AS r FROM outs), t AS (SELECT outline_id, max(v) AS top FROM e WHERE isfinite(v) GROUP BY ALL) SELECT outline_id, count(*) AS inside FROM e JOIN t USING (outline_id) WHERE isfinite(v) AND top > 0 AND v / top >= 0.25 GROUP BY outline_id")
def profile_extent(spark, folder):
    kept = A.below_to_zero(A.clean(F.col("in_out")), 0.25)
    rows = outlines(spark, folder).where(F.array_max(A.clean(F.col("in_out"))) > 0)
    return rows.select("outline_id", F.size(F.filter(kept, lambda v: v > 0)).cast("bigint").alias("inside"))


@query(f"""WITH {_TRACES}, s AS (SELECT recording, channel, cell_index, t, x, lead(t) OVER w AS t1, lead(x) OVER w AS x1 FROM (SELECT recording, channel, cell_index, unnest(time_ms) AS t, CAST(unnest(v) AS DOUBLE) AS x FROM paths) WHERE isfinite(x) WINDOW w AS (PARTITION BY recording, channel, cell_index ORDER BY t)),
g AS (SELECT recording, channel, cell_index, unnest(range(0, 21)) * 20 - 300.0 AS spot FROM paths)
SELECT g.recording, g.channel, g.cell_index, spot, {sql_rounded('coalesce(arg_min(x + (x1 - x) * (spot - t) / (t1 - t), t), 0)', 5)} AS v FROM g LEFT JOIN s ON g.recording = s.recording AND g.channel = s.channel AND g.cell_index = s.cell_index AND t <= spot AND spot <= t1 GROUP BY ALL""")
def resample_linear(spark, folder):
    points = F.filter(F.arrays_zip(F.col("time_ms").alias("x"), F.col("v").alias("y")), lambda p: p["y"].isNotNull() & ~F.isnan(p["y"]))
    rows = traces(spark, folder).withColumn("p", points)
    x, y = F.transform("p", lambda p: p["x"]), F.transform("p", lambda p: p["y"].cast("double"))
    at = A.grid(F.lit(-300.0), F.lit(20.0), 21)
    pairs_ = F.arrays_zip(at.alias("spot"), A.resampled(x, y, at).alias("v"))
    return rows.select(*CELL, F.inline(pairs_)).withColumn("v", rounded(F.col("v"), 5))


@query(f"""WITH {_POINTS}, s AS (SELECT e.outline_id, i, sqrt(power(r * cos(i * 2 * pi() / n) - r2 * cos(j * 2 * pi() / n), 2) + power(r * sin(i * 2 * pi() / n) - r2 * sin(j * 2 * pi() / n), 2)) AS d
FROM e JOIN (SELECT outline_id, (i - 1 + n) % n AS i, r AS r2, i AS j FROM e) USING (outline_id, i)) SELECT outline_id, {sql_rounded('sum(d)', 3)} AS perimeter FROM s GROUP BY outline_id""")
def arc_length(spark, folder, rows_of=whole_outlines):
    rows = rows_of(spark, folder).select("outline_id", G.closed(G.vertices(F.col("center"))).alias("p"))
    steps = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return rows.select("outline_id", rounded(A.total(steps), 3).alias("perimeter"))


@query(f"""WITH {_OUTLINES}, {_TRACES}, f AS (SELECT recording, channel, cell_index, 1 AS k, list_transform(center, lambda a: CAST(a AS DOUBLE)) AS a FROM whole UNION ALL SELECT recording, channel, cell_index, 2, list_transform(v, lambda a: CAST(a AS DOUBLE)) FROM paths),
g AS (SELECT recording, channel, cell_index, flatten(list(a ORDER BY k)) AS a FROM f GROUP BY ALL HAVING count(*) = 2)
SELECT recording, channel, cell_index, position, CASE WHEN isfinite(value) THEN {sql_rounded('value', 4)} END AS value FROM (SELECT recording, channel, cell_index, CAST(generate_subscripts(a, 1) - 1 AS INT) AS position, unnest(a) AS value FROM g)""")
def feature_stack(spark, folder, rows_of=whole_outlines, traces_of=traces):
    """Sample x feature matrix: centre curve and trace of each cell one after another; null at holes."""
    double = lambda c: F.transform(c, lambda v: v.cast("double")).alias("a")
    rows = rows_of(spark, folder).select(*CELL, F.lit(1).alias("k"), double("center")).unionByName(traces_of(spark, folder).select(*CELL, F.lit(2).alias("k"), double("v")))
    stacked = rows.groupBy(*CELL).agg(F.count("*").alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "a"))), lambda s: s["a"])).alias("a"))
    return stacked.where("n = 2").select(*CELL, F.posexplode("a").alias("position", "value")).withColumn("value", F.when(finite(F.col("value")), rounded(F.col("value"), 4)))


# --- cells, channels, recordings --------------------------------------------------------------------


@query(f"WITH {_CELLS} SELECT recording, channel, cell_index, quality FROM cells WHERE quality >= 20")
def quality_gate(spark, folder):
    return cells(spark, folder).where("quality >= 20").select(*CELL, "quality")


@query(f"WITH {_CELLS}, {_CHANNELS} SELECT recording, channel, cell_index, (center_x - image_w / 2) * pixel_size AS x_um, (center_y - image_h / 2) * pixel_size AS y_um FROM cells JOIN stims USING (recording, channel) WHERE center_x IS NOT NULL AND center_y IS NOT NULL")
def px_to_um(spark, folder):
    return _positions(spark, folder).select(*CELL, "x_um", "y_um")


def _positions(spark, folder):
    rows = cells(spark, folder).join(stimuli(spark, folder), ["recording", "channel"]).where("center_x is not null and center_y is not null")
    return rows.withColumns({"x_um": G.px_to_um(F.col("center_x"), F.col("image_w"), F.col("pixel_size")), "y_um": G.px_to_um(F.col("center_y"), F.col("image_h"), F.col("pixel_size"))})


_POSITIONS = f"{_CELLS}, {_CHANNELS}, pos AS (SELECT *, (center_x - image_w / 2) * pixel_size AS x_um, (center_y - image_h / 2) * pixel_size AS y_um, CASE WHEN quality >= 20 THEN quality ELSE 1e-6 END AS w FROM cells JOIN stims USING (recording, channel) WHERE center_x IS NOT NULL AND center_y IS NOT NULL AND pixel_size IS NOT NULL AND image_w IS NOT NULL AND image_h IS NOT NULL)"


@query(f"WITH {_POSITIONS} SELECT recording, cell_index, {sql_rounded('sum(w * x_um) / sum(w)')} AS x_um, {sql_rounded('sum(w * y_um) / sum(w)')} AS y_um, count(*) AS channels FROM pos GROUP BY recording, cell_index")
def locate_across_channels(spark, folder):
    found = S.weighted_positions(_positions(spark, folder), ["recording", "cell_index"], "quality", 20.0)
    return found.withColumns({c: rounded(F.col(c)) for c in ("x_um", "y_um")})


@query(f"WITH {_POSITIONS}, m AS (SELECT recording, cell_index, sum(w * x_um) / sum(w) AS x_um FROM pos GROUP BY ALL) SELECT recording, channel, cell_index, CAST(greatest(least(trunc({sql_rounded('m.x_um / pixel_size + round_even(image_w / 2, 0)')}), image_w - 1), 0) AS INT) AS x_px FROM m JOIN stims USING (recording)")
def um_to_px(spark, folder):
    found = S.weighted_positions(_positions(spark, folder), ["recording", "cell_index"], "quality", 20.0)
    px = G.um_to_px(F.col("x_um"), F.col("image_w"), F.col("pixel_size"))
    return found.join(stimuli(spark, folder), "recording").select(*CELL, F.greatest(F.least(px, F.col("image_w") - 1), F.lit(0)).alias("x_px"))


@query(f"WITH {_CELLS}, {_CHANNELS}, h AS (SELECT recording, channel, CAST(round_even(800 / pixel_size, 0) AS INT) AS cut, image_w FROM stims) SELECT recording, channel, cell_index, cut, CAST(least(image_w + cut - cut // 2, greatest(cut // 2, center_x + cut // 2)) AS INT) AS center FROM cells JOIN h USING (recording, channel) WHERE center_x IS NOT NULL")
def clamp_centers(spark, folder):
    rows = cells(spark, folder).where("center_x is not null").join(stimuli(spark, folder), ["recording", "channel"]).withColumn("cut", G.cut_px(F.lit(800.0), F.col("pixel_size")))
    half = F.floor(F.col("cut") / 2).cast("int")
    return rows.select(*CELL, "cut", G.clamp_centre(F.col("center_x") + half, half, F.col("image_w") + F.col("cut")).cast("int").alias("center"))


@query(f"WITH {_CELLS}, m AS (SELECT recording, cell_index, avg(quality) AS mean_quality FROM cells GROUP BY ALL) SELECT recording, cell_index, {sql_rounded('mean_quality')} AS mean_quality FROM m QUALIFY row_number() OVER (PARTITION BY recording ORDER BY floor(mean_quality * 1e6 + 0.500001) DESC, cell_index) <= 20")
def best_cells(spark, folder):
    mean = cells(spark, folder).groupBy("recording", "cell_index").agg(rounded(F.avg("quality")).alias("mean_quality"))
    order = Window.partitionBy("recording").orderBy(F.desc("mean_quality"), "cell_index")
    return mean.withColumn("r", F.row_number().over(order)).where("r <= 20").drop("r")


@query(f"WITH {_CELLS} SELECT recording, cell_index, max(quality) AS quality FROM cells GROUP BY ALL HAVING max(quality) > 20")
def good_cells(spark, folder):
    return cells(spark, folder).groupBy("recording", "cell_index").agg(F.max("quality").alias("quality")).where("quality > 20")


@query(f"WITH {_CELLS} SELECT recording, cell_index, min(channel) FILTER (quality = top) AS channel, max(quality) AS quality FROM (SELECT *, max(quality) OVER (PARTITION BY recording, cell_index) AS top FROM cells) GROUP BY ALL")
def best_channel(spark, folder):
    return S.best_per_group(cells(spark, folder), ["recording", "cell_index"], "quality", "channel")


@query("SELECT channel FROM channels GROUP BY channel HAVING count(DISTINCT recording) >= 0.3 * (SELECT count(DISTINCT recording) FROM channels)")
def common_channels(spark, folder):
    rows = table(spark, folder, "channels")
    total = rows.agg(F.count_distinct("recording").alias("total"))
    counted = rows.groupBy("channel").agg(F.count_distinct("recording").alias("n"))
    return counted.join(F.broadcast(total), F.col("n") >= 0.3 * F.col("total")).select("channel")


@query("WITH s AS (SELECT r_name AS item, n_nationkey AS owner FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'all', n_nationkey FROM nation) SELECT item FROM s GROUP BY item HAVING count(DISTINCT owner) = (SELECT count(DISTINCT owner) FROM s)")
def channel_intersection(spark, folder):
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    named = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("r_name").alias("item"), F.col("n_nationkey").alias("owner"))
    return S.shared_by_all(named.unionByName(nation.select(F.lit("all").alias("item"), F.col("n_nationkey").alias("owner"))), "item", "owner")


@query(f"WITH {_CELLS} SELECT recording, channel, cell_index FROM cells c WHERE EXISTS (FROM outlines o WHERE o.recording = c.recording AND o.channel = c.channel AND o.cell_index = c.cell_index)")
def semi_join_cells(spark, folder):
    return cells(spark, folder).join(table(spark, folder, "outlines").select(*CELL), CELL, "left_semi").select(*CELL)


@query(f"WITH {_CELLS} SELECT recording, channel, cell_index FROM cells c WHERE NOT EXISTS (FROM sta_traces o WHERE o.recording = c.recording AND o.channel = c.channel AND o.cell_index = c.cell_index)")
def anti_join(spark, folder):
    return cells(spark, folder).join(table(spark, folder, "sta_traces").select(*CELL), CELL, "left_anti").select(*CELL)


@query(f"WITH {_CHANNELS} SELECT DISTINCT q.recording, q.channel, q.cell_index, s.stimulus_id FROM (SELECT *, CAST(regexp_extract(sta_path, '_([0-9]+)/cell_', 1) AS INT) AS stimulus FROM quality WHERE sta_path IS NOT NULL) q JOIN stims s ON q.recording = s.recording AND q.stimulus = s.stimulus_id WHERE q.cell_index IS NOT NULL")
def lookup_join(spark, folder):
    found = F.regexp_extract("sta_path", "_([0-9]+)/cell_", 1)
    rows = table(spark, folder, "quality").where("sta_path is not null and cell_index is not null").withColumn("stimulus_id", F.nullif(found, F.lit("")).cast("int"))
    return rows.join(stimuli(spark, folder).select("recording", "stimulus_id"), ["recording", "stimulus_id"]).select(*CELL, "stimulus_id").distinct()


@query("SELECT channel, count(*) AS n, count(DISTINCT recording) AS recordings FROM (SELECT DISTINCT recording, channel FROM channels) GROUP BY channel")
def value_counts(spark, folder):
    return table(spark, folder, "channels").select("recording", "channel").distinct().groupBy("channel").agg(F.count("*").alias("n"), F.count_distinct("recording").alias("recordings"))


@query("SELECT recording, lower(colour) AS colour, channel FROM channels WHERE colour IS NOT NULL GROUP BY ALL")
def distinct_colours(spark, folder):
    return table(spark, folder, "channels").where("colour is not null").select("recording", F.lower("colour").alias("colour"), "channel").distinct()


@query(f"WITH {_CHANNELS} SELECT recording, min(pixel_size) AS pixel_size, min(dt_ms) AS dt_ms, min((post_spike_bins - total_sta_len) * dt_ms) AS start_ms, max(post_spike_bins * dt_ms) AS end_ms FROM stims GROUP BY recording")
def common_grid(spark, folder):
    rows = stimuli(spark, folder)
    return rows.groupBy("recording").agg(F.min("pixel_size").alias("pixel_size"), F.min("dt_ms").alias("dt_ms"), F.min((F.col("post_spike_bins") - F.col("total_sta_len")) * F.col("dt_ms")).alias("start_ms"), F.max(F.col("post_spike_bins") * F.col("dt_ms")).alias("end_ms"))


@query(f"WITH {_CHANNELS} SELECT recording, channel, CAST(unnest(range(0, total_sta_len)) AS INT) AS bin, (unnest(range(0, total_sta_len)) - (total_sta_len - post_spike_bins)) * dt_ms AS time_ms FROM stims")
def time_axis(spark, folder):
    axis = A.time_axis(F.col("total_sta_len"), F.col("dt_ms"), F.col("total_sta_len") - F.col("post_spike_bins"))
    return stimuli(spark, folder).where("total_sta_len > 0").select("recording", "channel", F.posexplode(axis).alias("bin", "time_ms"))


@query("SELECT recording, channel, concat(root_path, '/', sta_file) AS path, regexp_extract(root_path, '_idx_([0-9]+)$', 1) AS stimulus FROM channels WHERE root_path IS NOT NULL AND sta_file IS NOT NULL GROUP BY ALL")
def path_parts(spark, folder):
    rows = table(spark, folder, "channels").where("root_path is not null and sta_file is not null")
    return rows.select("recording", "channel", F.concat_ws("/", "root_path", "sta_file").alias("path"), F.regexp_extract("root_path", "_idx_([0-9]+)$", 1).alias("stimulus")).distinct()


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, folder):
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT event_id, CAST(least(greatest(ceil(value / 0.5 + 50 / 2), 0), 49) AS BIGINT) AS slot FROM events")
def searchsorted_bin(spark, folder):
    return table(spark, folder, "events").select("event_id", F.least(F.greatest(F.ceil(F.col("value") / 0.5 + 25), F.lit(0)), F.lit(49)).cast("bigint").alias("slot"))


@query("SELECT recording, channel, string_agg(cell, ',' ORDER BY cell_index) AS cells FROM (SELECT DISTINCT recording, channel, cell_index, CAST(cell_index AS VARCHAR) AS cell FROM outlines WHERE cell_index IS NOT NULL) GROUP BY ALL")
def explode_group_concat(spark, folder):
    rows = table(spark, folder, "outlines").where("cell_index is not null").select(*CELL).distinct().withColumn("one", F.array(F.col("cell_index").cast("string")))
    return S.concat_groups(rows, ["recording", "channel"], "cell_index", "one").select("recording", "channel", F.array_join("one", ",").alias("cells"))


@query("SELECT recording, channel, cell_index, 'outline' AS part FROM outlines GROUP BY ALL UNION ALL SELECT recording, channel, cell_index, 'trace' FROM sta_traces GROUP BY ALL")
def union_all(spark, folder):
    parts = [table(spark, folder, name).select(*CELL, F.lit(part).alias("part")).distinct() for name, part in (("outlines", "outline"), ("sta_traces", "trace"))]
    return parts[0].unionByName(parts[1])


# --- pairs, neighbours and graphs of small maps -------------------------------------------------------

_SPOTS = f"{_MAPS}, m AS (SELECT label, quantile_cont(v, 0.6) AS c FROM maps GROUP BY label), spots AS (SELECT label, i, y, x, v FROM maps JOIN m USING (label) WHERE v > c)"


def _spots(spark, folder):
    """Pixels of each mean image above its 0.6 quantile."""
    rows = maps(spark, folder)
    cut = rows.groupBy("label").agg(F.percentile("v", F.lit(0.6)).alias("c"))
    return rows.join(cut, "label").where("v > c").drop("c")


@query(f"""WITH RECURSIVE {_SPOTS}, walk AS (SELECT label, i AS node, i AS component FROM spots
  UNION SELECT s.label, s.i, w.component FROM walk w JOIN spots a ON a.label = w.label AND a.i = w.node JOIN spots s ON s.label = a.label AND abs(s.y - a.y) + abs(s.x - a.x) = 1 WHERE s.i > w.component)
SELECT label, node, min(component) AS component FROM walk GROUP BY label, node""")
def components(spark, folder):
    found = graph.map_components(_spots(spark, folder), ["label"])
    return found.withColumns({c: F.col(c).cast("int") for c in ("node", "component")})


@query(f"""WITH RECURSIVE {_SPOTS}, walk AS (SELECT label, i AS node, i AS component FROM spots
  UNION SELECT s.label, s.i, w.component FROM walk w JOIN spots a ON a.label = w.label AND a.i = w.node JOIN spots s ON s.label = a.label AND abs(s.y - a.y) + abs(s.x - a.x) = 1 WHERE s.i > w.component),
c AS (SELECT label, node, min(component) AS component FROM walk GROUP BY label, node), z AS (SELECT label, component, count(*) AS size FROM c GROUP BY label, component QUALIFY row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, component) = 1)
SELECT label, node, component FROM c JOIN z USING (label, component)""")
def central_island(spark, folder):
    return graph.largest_component(components(spark, folder), ["label"]).select("label", "node", "component")


@query(f"WITH {_SPOTS} SELECT a.label, a.i AS a, b.i AS b FROM spots a JOIN spots b ON a.label = b.label AND ((b.y = a.y AND b.x = a.x + 1) OR (b.x = a.x AND b.y = a.y + 1))")
def pixel_edges(spark, folder):
    return graph.pixel_edges(_spots(spark, folder), ["label"])


@query(f"WITH {_SPOTS}, n AS (SELECT a.label, a.i, count(*) AS n FROM spots a JOIN spots b ON a.label = b.label AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.i <> b.i GROUP BY ALL) SELECT label, s.i, {sql_rounded('v', 9)} AS v FROM spots s JOIN n USING (label, i) WHERE n >= 3")
def neighbour_filter(spark, folder):
    return pairs.drop_singled(_spots(spark, folder), ["label"], 3 / 8).select("label", "i", rounded(F.col("v"), 9).alias("v"))


@query(f"WITH {_MAPS} SELECT label, y + 2 AS y, x - 1 AS x, {sql_rounded('v', 9)} AS v FROM maps")
def image_shift(spark, folder):
    return tensors.shifted(maps(spark, folder), 2, -1).select("label", "y", "x", rounded(F.col("v"), 9).alias("v"))


@query(f"""WITH {_SPOTS}, s AS (SELECT label, x < 4 AS west, i, y, x FROM spots), d AS (SELECT a.label, a.west, a.i, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM s a JOIN s b ON a.label = b.label AND a.west <> b.west GROUP BY ALL)
SELECT label, {sql_rounded('max(d) FILTER (west)')} AS there, {sql_rounded('max(d) FILTER (NOT west)')} AS back, {sql_rounded('max(d)')} AS hausdorff, {sql_rounded('(avg(d) FILTER (west) + avg(d) FILTER (NOT west)) / 2')} AS mean_nearest FROM d GROUP BY label""")
def hausdorff(spark, folder):
    points = _spots(spark, folder).select("label", F.when(F.col("x") < 4, "west").otherwise("east").alias("side"), F.col("i").alias("id"), "x", "y")
    found = pairs.hausdorff(points, ["label"], "side", "west", "east")
    return found.withColumns({c: rounded(F.col(c)) for c in ("there", "back", "hausdorff", "mean_nearest")})


@query(f"WITH {_MAPS}, u AS (SELECT label, i, v / sqrt(sum(v * v) OVER (PARTITION BY label)) AS u FROM maps) SELECT p.label AS a, q.label AS b, {sql_rounded('1 - sum(p.u * q.u)')} AS distance FROM u p JOIN u q ON p.i = q.i AND p.label < q.label GROUP BY ALL")
def cosine_distance(spark, folder):
    flat = maps(spark, folder).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("v"))
    return pairs.cosine_distances(flat, "label", "v").withColumn("distance", rounded(F.col("distance")))


@query(f"""WITH {_MAPS}, o AS (SELECT label, y - 1 AS y, x AS x, v FROM maps), s AS (SELECT label, a.y - b.y AS dy, a.x - b.x AS dx, sum(a.v * b.v) AS score FROM maps a JOIN o b USING (label) GROUP BY ALL)
SELECT label, dy, dx, {sql_rounded('score', 9)} AS score FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY floor(score * 1e9) DESC, dy, dx) = 1""")
def best_shift(spark, folder):
    rows = maps(spark, folder).select("label", "y", "x", "v")
    return pairs.best_shift(rows, tensors.shifted(rows, -1, 0), ["label"]).withColumn("score", rounded(F.col("score"), 9))


@query(f"WITH {_PIXELS}, r AS (SELECT *, row_number() OVER (PARTITION BY label, vec_id ORDER BY v DESC, i) AS k FROM pixels) SELECT label, vec_id, i, {sql_rounded('CASE WHEN k <= 5 THEN v ELSE 0 END', 9)} AS kept FROM r")
def topk_feature_mask(spark, folder):
    cut = F.element_at(F.array_sort(F.transform("embedding", lambda v, i: F.struct((-v.cast("double")).alias("v"), i.alias("i")))), 5)
    rows = table(spark, folder, "embeddings").withColumn("cut", cut)
    kept = F.transform("embedding", lambda v, i: F.when(F.struct((-v.cast("double")).alias("v"), i.alias("i")) <= F.col("cut"), v.cast("double")).otherwise(F.lit(0.0)))
    return rows.select("label", "vec_id", F.posexplode(kept).alias("i", "kept")).withColumn("kept", rounded(F.col("kept"), 9))


# --- linear algebra: sums of bounded matrices ----------------------------------------------------------


@query()
def dominant_pixel(spark, folder):
    return reduction.dominant_pixels(table(spark, folder, "embeddings"), "label", "embedding", SIDE * SIDE)


@query()
def pca_variance(spark, folder):
    return reduction.explained(table(spark, folder, "embeddings"), "label", "embedding", SIDE * SIDE, 10)


@query()
def pca_scores(spark, folder):
    return reduction.projected(table(spark, folder, "embeddings"), ["vec_id", "label"], "embedding", SIDE * SIDE, 10)


def _nmf(spark, folder, **more):
    rows = table(spark, folder, "embeddings")
    return rows, factorisation.factorised(factorisation.gram_of(rows, "embedding", SIDE * SIDE), factorisation.Settings(5, **more))


@query()
def semi_nmf(spark, folder):
    """Non-negative part H of X = W H over all images, with the loss after the last round (driver: one 64 x 64 matrix)."""
    _, found = _nmf(spark, folder)
    return spark.createDataFrame([(k, found.h[k].tolist(), found.losses[-1]) for k in range(len(found.h))], "component int, weights array<double>, loss double")


@query()
def semi_nmf_weights(spark, folder):
    """W's row of every image, from a factorisation whose rows of H are kept apart and scaled."""
    rows, found = _nmf(spark, folder, l1=1e-3, topk=3, sharpen=1.2, decorrelate=1e-3, scale="l2")
    return factorisation.weights_of(rows, ["vec_id"], "embedding", SIDE * SIDE, found.b)


@query()
def nmf_runs(spark, folder):
    """Loss and rounds of factorisations from eight starts."""
    return factorisation.runs(table(spark, folder, "embeddings"), "embedding", SIDE * SIDE, factorisation.Settings(5, noise=0.5), 8).select("run", "rounds", "loss")


@query()
def nmf_consensus(spark, folder):
    """How often two pixels share a component over eight runs."""
    found = written(factorisation.runs(table(spark, folder, "embeddings"), "embedding", SIDE * SIDE, factorisation.Settings(5, noise=0.5), 8), "runs")
    return factorisation.consensus(found)


@query()
def group_pca(spark, folder):
    """Two-stage principal components of two views, the upper and lower halves of each image."""
    halves = table(spark, folder, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("upper"), F.slice("embedding", 33, 32).alias("lower"))
    return factorisation.group_principal(halves, ["vec_id"], {"upper": 32, "lower": 32}, 6)


@query()
def svd_normalised(spark, folder):
    """Truncated SVD of all images, each scaled to length one."""
    return factorisation.principal(table(spark, folder, "embeddings"), ["vec_id"], "embedding", SIDE * SIDE, 10, centred=False, unit=True)


@query()
def complex_pca(spark, folder):
    """Shares of variance of the complex components of all images read as signals."""
    return factorisation.complex_variances(table(spark, folder, "embeddings"), "embedding", SIDE * SIDE, 8)


# --- resampling and image kernels -----------------------------------------------------------------------


@query(f"WITH {_MAPS}, g AS (SELECT unnest(range(12)) AS t) SELECT label, CAST(a.t AS INT) AS y, CAST(b.t AS INT) AS x, {sql_rounded('v', 9)} AS v FROM maps m JOIN g a ON floor(a.t * 7 / 11.0 + 0.5) = m.y JOIN g b ON floor(b.t * 7 / 11.0 + 0.5) = m.x")
def resample_nearest(spark, folder):
    """Images on a 12 x 12 grid: each new pixel looks up its nearest old one (a bounded lookup table)."""
    new = F.sequence(F.lit(0), F.lit(11))
    of = lambda axis: F.filter(new, lambda t: F.floor(t * 7 / 11.0 + 0.5) == F.col(axis))
    rows = maps(spark, folder).select("label", F.explode(of("y")).alias("ny"), "x", "v").select("label", F.col("ny").alias("y"), F.explode(of("x")).alias("nx"), "v")
    return rows.select("label", "y", F.col("nx").alias("x"), rounded(F.col("v"), 9).alias("v"))


@query(f"WITH {_MAPS} SELECT label, y // 2 AS y, x // 2 AS x, {sql_rounded('v', 9)} AS v FROM maps WHERE y % 2 = 0 AND x % 2 = 0".replace("y // 2 AS y, x // 2 AS x", "CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x"))
def strided(spark, folder):
    half = lambda c: (F.col(c) / 2).cast("int").alias(c)
    return maps(spark, folder).where("y % 2 = 0 and x % 2 = 0").select("label", half("y"), half("x"), rounded(F.col("v"), 9).alias("v"))


@query(f"""WITH {_MAPS}, r AS (SELECT angle, d, CAST(round_even(4 + d * cos(radians(angle)), 0) AS INT) AS x, CAST(round_even(4 + d * sin(radians(angle)), 0) AS INT) AS y FROM (SELECT unnest(range(8)) * 45 AS angle), (SELECT unnest(range(6)) AS d))
SELECT label, CAST(angle AS INT) AS angle, CAST(d AS INT) AS d, {sql_rounded('v', 9)} AS v FROM maps JOIN r USING (x, y)""")
def ray_entries(spark, folder):
    """Pixels along rays from the middle; what lies outside is left out, repeated pixels stay."""
    rays = spark.range(48).select((F.floor(F.col("id") / 6) * 45).cast("int").alias("angle"), (F.col("id") % 6).cast("int").alias("d"))
    x, y = (F.bround(4 + F.col("d") * f(F.radians("angle"))).cast("int") for f in (F.cos, F.sin))
    found = maps(spark, folder).join(F.broadcast(rays.select("angle", "d", x.alias("x"), y.alias("y"))), ["x", "y"])
    return found.select("label", "angle", "d", rounded(F.col("v"), 9).alias("v"))


@query(f"""WITH {_POINTS}, area AS (SELECT outline_id, 0.5 * sin(2 * pi() / n) * sum(a * b) AS area FROM (SELECT outline_id, n, unnest(center) AS a, unnest(list_concat(center[2:], center[1:1])) AS b FROM whole) GROUP BY outline_id, n),
far AS (SELECT outline_id, max(sqrt((x - uc - k.mx) ** 2 + (y - vc - k.my) ** 2)) - min(sqrt((x - uc - k.mx) ** 2 + (y - vc - k.my) ** 2)) AS tir FROM p JOIN k USING (outline_id) GROUP BY outline_id),
axes AS (SELECT *, (suu + svv) / 2 AS h, sqrt((suu - svv) * (suu - svv) / 4 + suv * suv) AS r FROM k)
SELECT outline_id, {sql_rounded('area * 1e-6')} AS center_size_mm2, {sql_rounded('tir', 3)} AS tir, {sql_rounded('sqrt((uc + mx) ** 2 + (vc + my) ** 2)', 3)} AS center_shift, {sql_rounded('sqrt(greatest(h - r, 0) / nullif(h + r, 0))')} AS tilt, {sql_rounded('(degrees(atan2(2 * suv, suu - svv) / 2) + 180) % 180', 3)} AS angle
FROM axes JOIN area USING (outline_id) JOIN far USING (outline_id)""")
def rf_stats(spark, folder, rows_of=whole_outlines):
    """All shape statistics of a cell's centre outline in one pass over its row."""
    rows = rows_of(spark, folder).select("outline_id", "center", G.vertices(F.col("center")).alias("points"))
    rows = rows.withColumn("m", G.moments(F.col("points"))).withColumn("circle", G.circle_fit(F.col("m")))
    return rows.select(
        "outline_id", rounded(G.radial_area(F.col("center")) * 1e-6).alias("center_size_mm2"), rounded(G.tir(F.col("points"), F.col("circle")), 3).alias("tir"),
        rounded(F.hypot("circle.xc", "circle.yc"), 3).alias("center_shift"), rounded(G.tilt(F.col("m"))).alias("tilt"), rounded(G.axis_angle(F.col("m")), 3).alias("angle"),
    )


def _images(spark, folder):
    return table(spark, folder, "embeddings").select("label", "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("a"))


@query()
def gaussian_smooth(spark, folder):
    """Every image smoothed, with its own median outside."""
    return _images(spark, folder).select("label", "vec_id", F.posexplode(cellwise.smoothed(F.col("a"), (SIDE, SIDE), 1.0)).alias("i", "v")).withColumn("v", rounded(F.col("v")))


@query()
def polar_transform(spark, folder):
    """Every image sampled bilinearly on 36 angles and 4 radii."""
    return _images(spark, folder).select("label", "vec_id", F.posexplode(cellwise.polar(F.col("a"), (SIDE, SIDE), 4, 36)).alias("i", "v")).withColumn("v", rounded(F.col("v")))


@query()
def outline_curves(spark, folder):
    """Centre, surround and in-out curves of every image (36, 36 and 4 values)."""
    return _images(spark, folder).select("label", "vec_id", F.posexplode(cellwise.outline_curves(F.col("a"), (SIDE, SIDE), 4)).alias("i", "v")).withColumn("v", rounded(F.col("v")))


@query()
def decimated(spark, folder):
    """Every image low-passed and thinned by two along its rows."""
    return _images(spark, folder).select("label", "vec_id", F.posexplode(cellwise.decimated(F.col("a"), (SIDE, SIDE), 2)).alias("i", "v")).withColumn("v", rounded(F.col("v")))


@query()
def decimated_both(spark, folder):
    """Every image thinned by two along columns, then rows, and trimmed by a pixel on each side."""
    return _images(spark, folder).select("label", "vec_id", F.posexplode(cellwise.decimated_both(F.col("a"), (SIDE, SIDE), 2, 1)).alias("i", "v")).withColumn("v", rounded(F.col("v")))


@query()
def spectrum(spark, folder):
    """Logarithmic magnitude of every image's Fourier transform."""
    return _images(spark, folder).select("label", "vec_id", F.posexplode(cellwise.spectrum(F.col("a"), (SIDE, SIDE))).alias("i", "v")).withColumn("v", rounded(F.col("v")))


@query()
def bandpass(spark, folder):
    """Every trace, holes bridged, band-passed between 2 and 20 Hz; one row of nulls where it can't be."""
    whole = every_trace(spark, folder)
    rate = F.lit(1000.0) / F.nullif(F.get("time_ms", F.lit(1)) - F.get("time_ms", F.lit(0)), F.lit(0.0))
    return whole.select(*CELL, F.posexplode_outer(cellwise.band_passed(F.transform("v", lambda v: v.cast("double")), 2.0, 20.0, rate)).alias("position", "v")).withColumn("v", rounded(F.col("v")))


@query()
def envelope(spark, folder):
    """Magnitude of the analytic signal of every trace, holes bridged; one row of nulls where nothing is known."""
    whole = every_trace(spark, folder)
    return whole.select(*CELL, F.posexplode_outer(cellwise.envelope(F.transform("v", lambda v: v.cast("double")))).alias("position", "v")).withColumn("v", rounded(F.col("v")))


# --- every cell: the queries above on all outlines and traces -------------------------------------------

_WHOLE = _OUTLINES[_OUTLINES.index("whole AS") :]


def _sql_around(c: str) -> str:
    """Curve ``c`` with its holes bridged around the circle."""
    known = f"list_filter(range(-len({c}), 2 * len({c})), lambda k: isfinite({c}[(k + len({c})) % len({c}) + 1]))"
    low, high = f"list_max(list_filter({known}, lambda k: k <= i))", f"list_min(list_filter({known}, lambda k: k >= i))"
    value = lambda k: f"{c}[({k} + len({c})) % len({c}) + 1]"
    return f"CASE WHEN len({known}) > 0 THEN list_transform(range(len({c})), lambda i: CASE WHEN isfinite({c}[i + 1]) THEN {c}[i + 1] ELSE {value(low)} + ({value(high)} - {value(low)}) * (i - {low}) / ({high} - {low}) END) END"


_EVERY = f"whole AS (SELECT *, len(center) AS n FROM (SELECT * REPLACE ({_sql_around('center')} AS center, {_sql_around('surround')} AS surround) FROM outs))"
_KNOWN = "list_filter(range(1, len(v) + 1), lambda k: isfinite(v[k]))"
_LOW, _HIGH = f"list_max(list_filter({_KNOWN}, lambda k: k <= i))", f"list_min(list_filter({_KNOWN}, lambda k: k >= i))"
_EVERY_TRACE = f"""{_TRACES.replace("paths AS", "stored AS")}, paths AS (SELECT recording, channel, cell_index, time_ms, CASE WHEN len({_KNOWN}) > 0 THEN list_transform(range(1, len(v) + 1), lambda i: CASE WHEN isfinite(v[i]) THEN CAST(v[i] AS DOUBLE)
  ELSE coalesce(v[{_LOW}] + (CAST(v[{_HIGH}] AS DOUBLE) - v[{_LOW}]) * (time_ms[i] - time_ms[{_LOW}]) / (time_ms[{_HIGH}] - time_ms[{_LOW}]), v[{_LOW}], v[{_HIGH}]) END) END AS v FROM stored)"""


def _for_every(name: str, keys: list[str], stored: str, **sources) -> None:
    """Registers ``name``_all: a row at least for each stored key, nulls where nothing can be computed."""
    whole, all_keys = QUERIES[name], ", ".join(keys)
    rest = lambda df: [c for c in df.columns if c not in keys]

    def run(spark, folder):
        found = whole(spark, folder, **sources)
        return join_same(table(spark, folder, stored).select(*keys).distinct(), found, keys, "left").select(*keys, *rest(found))

    QUERIES[f"{name}_all"] = run
    inner = SQL[name].replace(_WHOLE, _EVERY).replace(_TRACES, _EVERY_TRACE)
    on = " AND ".join(f"k.{c} IS NOT DISTINCT FROM q.{c}" for c in keys)
    SQL[f"{name}_all"] = f"SELECT k.*, q.* EXCLUDE ({all_keys}) FROM (SELECT DISTINCT {all_keys} FROM {stored}) k LEFT JOIN ({inner}) q ON {on}"


for _name in ("radial_area", "circle_fit", "roundness", "tilt_angle", "array_extrema", "arc_length"):
    _for_every(_name, ["outline_id"], "outlines", rows_of=every_outline)
for _name in ("zscore_tail", "zscore_noise"):
    _for_every(_name, CELL, "sta_traces", traces_of=every_trace)
_for_every("feature_stack", CELL, "outlines", rows_of=every_outline, traces_of=every_trace)
_for_every("rf_stats", ["outline_id"], "outlines", rows_of=every_outline)

_AREA = "list_sum(list_transform(range(1, len({c}) + 1), lambda i: {c}[i] * {c}[i % len({c}) + 1])) * 0.5 * sin(2 * pi() / len({c}))"
SQL["rf_stats_all"] = f"""WITH {_OUTLINES.replace(_WHOLE, _EVERY)}, {_CHANNELS}, shapes AS ({SQL["rf_stats_all"]})
SELECT outline_id, {sql_rounded("CASE WHEN len(center) >= 3 THEN " + _AREA.format(c="center") + " * pixel_size * pixel_size * 1e-6 END")} AS center_size_mm2,
  {sql_rounded("CASE WHEN len(surround) >= 3 THEN " + _AREA.format(c="surround") + " * pixel_size * pixel_size * 1e-6 END")} AS surround_size_mm2, tir, center_shift, tilt, angle
FROM shapes JOIN whole USING (outline_id) LEFT JOIN stims USING (recording, channel)"""
_shapes = QUERIES["rf_stats_all"]


def rf_stats_all(spark, folder):
    """Shape statistics of every outline, with the areas of centre and surround scaled by the pixel size as in the reference."""
    size = lambda c: rounded(G.radial_area(F.col(c)) * F.col("pixel_size") * F.col("pixel_size") * 1e-6).alias(f"{c}_size_mm2")
    rows = join_same(every_outline(spark, folder), stimuli(spark, folder).select("recording", "channel", "pixel_size"), ["recording", "channel"], "left")
    return rows.select("outline_id", size("center"), size("surround")).join(_shapes(spark, folder).drop("center_size_mm2"), "outline_id")


QUERIES["rf_stats_all"] = rf_stats_all
