"""Queries and SQL of the whole path from image stacks to shape statistics, and of further operators on stacks, cells and outlines.

As in ``rf_queries``, ``embeddings`` serves as stacks of 8 x 8 images: label =
cell, vec_id = time, position = pixel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rfloom.functions import geometry as G
from rfloom.functions.arrays import rounded, sql_rounded
from rfloom.operators import reduction, smoothing, tensors
from rfloom.operators import statistics as S
from rfloom.plans.kernel_sql import GAUSS, LEADING
from rfloom.plans.pipeline import Pipeline
from rfloom.plans.rf_queries import _PIXELS, QUERIES, SIDE, SQL, _images, pixels, query
from rfloom.tables import scratch, table

# --- quality of the smoothed stack -----------------------------------------------------------------

_SMOOTH = f"""{_PIXELS}, {GAUSS}, fills AS (SELECT label, median(v) AS f FROM pixels GROUP BY label),
down AS (SELECT label, vec_id, y - k AS y, x, sum(w * (v - f)) AS d FROM pixels JOIN fills USING (label), gauss WHERE y - k BETWEEN 0 AND 7 GROUP BY label, vec_id, y - k, x),
across AS (SELECT label, vec_id, y, x - k AS x, sum(w * d) AS d FROM down, gauss WHERE x - k BETWEEN 0 AND 7 GROUP BY label, vec_id, y, x - k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label, y, x ORDER BY vec_id) AS t FROM across),
spread AS (SELECT label, y, x, t - k AS t, w * d AS d FROM ranked, gauss),
smooth AS (SELECT r.label, r.vec_id, r.y, r.x, sum(s.d) + any_value(f) AS v FROM ranked r JOIN spread s ON r.label = s.label AND r.y = s.y AND r.x = s.x AND r.t = s.t JOIN fills ON r.label = fills.label GROUP BY r.label, r.vec_id, r.y, r.x),
vars AS (SELECT label, y, x, var_pop(v) AS vv FROM smooth GROUP BY label, y, x),
quality AS (SELECT label, max(vv) / nullif(median(vv), 0) AS quality, arg_max(x, (vv, -x, -y)) AS center_x, arg_max(y, (vv, -x, -y)) AS center_y FROM vars GROUP BY label)"""

QUERIES["rf_quality_raw"], SQL["rf_quality_raw"] = QUERIES["rf_quality"], SQL["rf_quality"]


def _quality(images: DataFrame) -> DataFrame:
    return S.rf_quality(smoothing.smoothed_stack(images, ["label"], "vec_id", "a", (SIDE, SIDE), 1.0), ["label"])


@query(f"WITH {_SMOOTH} SELECT label, {sql_rounded('quality')} AS quality, center_x, center_y FROM quality")
def rf_quality(spark, folder):
    """Largest over median variance of each smoothed stack, and where it is."""
    return _quality(_images(spark, folder)).withColumn("quality", rounded(F.col("quality")))


@query(f"WITH {_SMOOTH} SELECT label, vec_id, CAST(y * 8 + x AS INT) AS i, {sql_rounded('v', 9)} AS v FROM smooth")
def smoothed_stack(spark, folder):
    return smoothing.smoothed_stack(_images(spark, folder), ["label"], "vec_id", "a", (SIDE, SIDE), 1.0).select("label", "vec_id", "i", rounded(F.col("v"), 9).alias("v"))


# --- the whole path as tasks ------------------------------------------------------------------------

_HALF, _SECTORS = 2, 12


def rf_path(spark, folder: str, store: str) -> Pipeline:
    """quality > window > collapse > reduction > stats, each a table in ``store``; a later run skips what is there."""
    path = Pipeline(spark, store, {"images": _images(spark, folder)}, {"half": _HALF, "sectors": _SECTORS})

    @path.task
    def quality(images):
        return _quality(images)

    @path.task
    def window(images, quality, half):
        long = tensors.long_view(images, ["label", "vec_id"], "a", SIDE).select("label", "vec_id", "y", "x", "v")
        return tensors.windowed(tensors.padded_axes(long, ["label", "vec_id"], SIDE, SIDE, half), quality.select("label", "center_y", "center_x"), ["label"], half)

    @path.task
    def collapse(window, images, half):
        spikes = images.groupBy("label").agg(F.count("*").alias("spikes"))
        reference = window.where((F.col("y") == half) & (F.col("x") == half)).select("label", "vec_id", F.col("v").alias("r"))
        covariance = S.covariance_with_reference(window, reference, ["label"], "vec_id")
        return S.max_square_deviation(window, spikes, ["label"], "spikes").join(covariance, ["label", "y", "x"])

    @path.task
    def reduction(collapse, half, sectors):
        angle, far = G.polar(F.col("x") - half, F.col("y") - half)
        e = collapse.groupBy("label", F.floor(angle * (sectors / 360)).alias("sector"), F.round(far).alias("r")).agg(F.avg("cov").alias("m"))
        peaks = e.groupBy("label").agg(F.max(F.greatest("m", F.lit(0.0))).alias("up"), F.min(F.least("m", F.lit(0.0))).alias("down"))
        side = lambda f, peak: F.coalesce(F.avg(f("m", F.lit(0.0))) / F.nullif(F.first(peak), F.lit(0.0)), F.lit(0.0)) * (half + 1)
        return e.join(peaks, "label").groupBy("label", "sector").agg(side(F.greatest, "up").alias("center"), side(F.least, "down").alias("surround"))

    @path.task
    def stats(reduction, quality, collapse, sectors):
        filled = lambda c: F.transform(F.sequence(F.lit(0), F.lit(sectors - 1)), lambda k: F.coalesce(F.try_element_at(F.map_from_entries(F.collect_list(F.struct("sector", c))), k.cast("bigint")), F.lit(0.0)))
        outlines = reduction.groupBy("label").agg(filled("center").alias("center"), filled("surround").alias("surround"))
        sizes = outlines.select("label", G.radial_area(F.col("center")).alias("center_size"), G.radial_area(F.col("surround")).alias("surround_size"))
        strength = collapse.groupBy("label").agg(F.max("rms").alias("rms"), F.sum("cov").alias("cov"))
        return quality.join(sizes, "label").join(strength, "label")

    return path


_WINDOW = f"""{_SMOOTH},
tall AS (SELECT label, vec_id, y, x, v FROM pixels UNION ALL SELECT label, vec_id, unnest([-2, -1, 8, 9]), x, median(v) FROM pixels GROUP BY label, vec_id, x),
wide AS (SELECT * FROM tall UNION ALL SELECT label, vec_id, y, unnest([-2, -1, 8, 9]), median(v) FROM tall GROUP BY label, vec_id, y),
win AS (SELECT label, vec_id, y - center_y + 2 AS y, x - center_x + 2 AS x, v FROM wide JOIN quality USING (label) WHERE abs(y - center_y) <= 2 AND abs(x - center_x) <= 2)"""
_COLLAPSE = f"""{_WINDOW}, counts AS (SELECT label, count(*) AS spikes FROM embeddings GROUP BY label),
collapsed AS (
  SELECT label, y, x, max((v / spikes - 0.5) * (v / spikes - 0.5)) AS rms, covar_samp(v, r) AS cov
  FROM win JOIN counts USING (label) JOIN (SELECT label, vec_id, v AS r FROM win WHERE y = 2 AND x = 2) USING (label, vec_id) GROUP BY label, y, x)"""
_REDUCTION = f"""{_COLLAPSE},
rings AS (SELECT label, CAST(floor((CASE WHEN atan2(y - 2, x - 2) < 0 THEN degrees(atan2(y - 2, x - 2)) + 360 ELSE degrees(atan2(y - 2, x - 2)) END) * (12 / 360.0)) AS BIGINT) AS sector, round(sqrt((y - 2) * (y - 2) + (x - 2) * (x - 2))) AS r, avg(cov) AS m FROM collapsed GROUP BY ALL),
tops AS (SELECT label, max(greatest(m, 0.0)) AS up, min(least(m, 0.0)) AS down FROM rings GROUP BY label),
curves AS (SELECT label, sector, coalesce(avg(greatest(m, 0.0)) / nullif(max(up), 0), 0.0) * 3 AS center, coalesce(avg(least(m, 0.0)) / nullif(min(down), 0), 0.0) * 3 AS surround FROM rings JOIN tops USING (label) GROUP BY label, sector),
ring AS (
  SELECT g.label, g.sector, coalesce(center, 0.0) AS center, coalesce(surround, 0.0) AS surround
  FROM (SELECT label, sector FROM (SELECT DISTINCT label FROM curves), (SELECT unnest(range(12)) AS sector)) g LEFT JOIN curves c ON c.label = g.label AND c.sector = g.sector)"""


@query(f"WITH {_WINDOW} SELECT label, vec_id, y, x, {sql_rounded('v', 9)} AS v FROM win")
def centred_window(spark, folder):
    """5 x 5 window of each padded stack around its variance maximum."""
    path = rf_path(spark, folder, scratch(spark, "path"))
    path.run(["window"])
    return path.result("window").withColumn("v", rounded(F.col("v"), 9))


@query(f"WITH {_COLLAPSE} SELECT label, y, x, {sql_rounded('rms', 9)} AS rms, {sql_rounded('cov', 9)} AS cov FROM collapsed")
def collapsed_maps(spark, folder):
    """Squared deviation and covariance with the centre pixel in each window."""
    path = rf_path(spark, folder, scratch(spark, "path"))
    path.run(["collapse"])
    return path.result("collapse").withColumns({c: rounded(F.col(c), 9) for c in ("rms", "cov")})


_AREA = "(SELECT label, sum(a.{c} * b.{c}) * 0.5 * sin(2 * pi() / 12) AS {c}_size FROM ring a JOIN ring b USING (label) WHERE b.sector = (a.sector + 1) % 12 GROUP BY label)"


@query(f"""WITH {_REDUCTION} SELECT label, {sql_rounded('quality')} AS quality, center_x, center_y, {sql_rounded('center_size')} AS center_size, {sql_rounded('surround_size')} AS surround_size, {sql_rounded('rms', 9)} AS rms, {sql_rounded('cov', 9)} AS cov
FROM quality JOIN {_AREA.format(c='center')} USING (label) JOIN {_AREA.format(c='surround')} USING (label) JOIN (SELECT label, max(rms) AS rms, sum(cov) AS cov FROM collapsed GROUP BY label) USING (label)""")
def rf_path_stats(spark, folder):
    """All tasks of the path, from the images to the sizes of centre and surround."""
    path = rf_path(spark, folder, scratch(spark, "path"))
    path.run()
    found = path.result("stats")
    return found.withColumns({"quality": rounded(F.col("quality")), "center_size": rounded(F.col("center_size")), "surround_size": rounded(F.col("surround_size")), "rms": rounded(F.col("rms"), 9), "cov": rounded(F.col("cov"), 9)})


@query(f"WITH RECURSIVE {LEADING}, ref AS (SELECT p.label, vec_id, v AS r FROM pixels p JOIN tops l ON p.label = l.label AND p.i = l.pixel) SELECT label, y, x, {sql_rounded('covar_samp(v, r)', 9)} AS cov FROM pixels JOIN ref USING (label, vec_id) GROUP BY label, y, x")
def covariance_dominant(spark, folder):
    """Covariance of every pixel with the most important one of its stack."""
    stack = pixels(spark, folder)
    leading = reduction.dominant_pixels(table(spark, folder, "embeddings"), "label", "embedding", SIDE * SIDE).withColumnRenamed("pixel", "i")
    reference = stack.join(leading, ["label", "i"]).select("label", "vec_id", F.col("v").alias("r"))
    return S.covariance_with_reference(stack, reference, ["label"], "vec_id").withColumn("cov", rounded(F.col("cov"), 9))
