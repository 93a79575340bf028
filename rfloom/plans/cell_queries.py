"""Queries and SQL of further operators on stacks, cells, channels and outlines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rfloom.functions import arrays as A
from rfloom.functions import geometry as G
from rfloom.functions.arrays import rounded, sql_rounded
from rfloom.operators import contours, graph, pairs, tensors
from rfloom.operators import statistics as S
from rfloom.plans.rf_queries import _CELLS, _CHANNELS, _MAPS, _OUTLINES, _PIXELS, _TRACES, CELL, QUERIES, SIDE, SQL, cells, maps, outlines, pixels, query, stimuli, traces, whole_outlines
from rfloom.sources import cubes, settings
from rfloom.tables import finite, table

# --- maps and snippets -------------------------------------------------------------------------------


@query(f"""WITH {_PIXELS}, rms AS (SELECT label, y, x, max((v - 0.5) * (v - 0.5)) AS r FROM pixels GROUP BY label, y, x), frame AS (SELECT label, CAST(fy AS INT) AS y, CAST(fx AS INT) AS x FROM (SELECT DISTINCT label FROM rms), (SELECT unnest(range(10)) AS fy), (SELECT unnest(range(10)) AS fx))
SELECT f.label, f.y, f.x, {sql_rounded('coalesce(r, 0)', 9)} AS rms FROM frame f LEFT JOIN rms r ON f.label = r.label AND f.y = r.y AND f.x = r.x""")
def square_deviation_filled(spark, folder):
    """Largest squared deviation on a 10 x 10 frame; zero outside the image."""
    one = pixels(spark, folder).select("label").distinct().withColumn("spikes", F.lit(1))
    return tensors.framed(S.max_square_deviation(pixels(spark, folder), one, ["label"], "spikes"), ["label"], 10, 10, "rms").withColumn("rms", rounded(F.col("rms"), 9))


@query(f"WITH {_PIXELS}, sta AS (SELECT label, vec_id % 10 AS t, y, x, avg(v) AS m FROM pixels GROUP BY ALL) SELECT label, y, x, {sql_rounded('max((m - 0.5) * (m - 0.5))', 9)} AS rms FROM sta GROUP BY label, y, x")
def snippet_mean_deviation(spark, folder):
    """Mean over snippets per time bin, then the largest squared deviation over the bins."""
    sta = pixels(spark, folder).groupBy("label", (F.col("vec_id") % 10).alias("t"), "y", "x").agg(F.avg("v").alias("m"))
    return sta.groupBy("label", "y", "x").agg(rounded(F.max((F.col("m") - 0.5) * (F.col("m") - 0.5)), 9).alias("rms"))


@query(f"WITH {_PIXELS}, sta AS (SELECT label, i, sum(v * (vec_id % 7)) / nullif(sum(vec_id % 7), 0) AS s FROM pixels GROUP BY label, i) SELECT label, vec_id % 10 AS bin, {sql_rounded('sum(v * s)', 6)} AS kernel FROM pixels JOIN sta USING (label, i) GROUP BY label, vec_id % 10")
def temporal_kernel(spark, folder):
    """The weighted triggered average applied to the snippets: its response per time bin."""
    rows = pixels(spark, folder)
    sta = S.triggered_average(rows.withColumn("w", F.col("vec_id") % 7), ["label"], "w")
    return rows.join(sta, ["label", "y", "x"]).groupBy("label", (F.col("vec_id") % 10).alias("bin")).agg(rounded(F.sum(F.col("v") * F.col("sta"))).alias("kernel"))


@query(f"WITH {_PIXELS} SELECT label, vec_id % 4 AS cluster, y, x, {sql_rounded('sum(v * (1 + vec_id % 5)) / sum(1 + vec_id % 5)', 9)} AS mean FROM pixels GROUP BY ALL")
def weighted_cluster_mean(spark, folder):
    """Mean component of each cluster, weighted by the members' probabilities."""
    weight = 1 + F.col("vec_id") % 5
    rows = pixels(spark, folder).groupBy("label", (F.col("vec_id") % 4).alias("cluster"), "y", "x")
    return rows.agg(rounded(F.sum(F.col("v") * weight) / F.sum(weight), 9).alias("mean"))


@query(f"WITH {_PIXELS}, r AS (SELECT *, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM pixels) SELECT label, count(DISTINCT vec_id) AS kept, {sql_rounded('avg(v)', 9)} AS mean FROM r WHERE n > 10 GROUP BY label")
def drop_first_snippets(spark, folder):
    """Snippets without the first ten of each cell."""
    images = table(spark, folder, "embeddings").withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("n > 10")
    return images.groupBy("label").agg(F.count("*").alias("kept"), rounded(F.avg(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double")) / 64), 9).alias("mean"))


@query(f"WITH {_MAPS}, s AS (SELECT label, i, greatest(v, 0.0) AS v FROM maps), m AS (SELECT label, median(v) AS f FROM s GROUP BY label) SELECT label, i, {sql_rounded('CASE WHEN v = 0 THEN f ELSE v END', 9)} AS v FROM s JOIN m USING (label)")
def zero_to_median(spark, folder):
    """Rectified maps whose zeros become the map's median."""
    rows = maps(spark, folder).select("label", "i", F.greatest("v", F.lit(0.0)).alias("v"))
    fills = rows.groupBy("label").agg(F.median("v").alias("f"))
    return rows.join(fills, "label").select("label", "i", rounded(F.when(F.col("v") == 0, F.col("f")).otherwise(F.col("v")), 9).alias("v"))


@query(f"""WITH {_PIXELS}, tall AS (SELECT label, vec_id, y, x, v FROM pixels UNION ALL SELECT label, vec_id, unnest([-1, 8]), x, median(v) FROM pixels GROUP BY label, vec_id, x),
wide AS (SELECT * FROM tall UNION ALL SELECT label, vec_id, y, unnest([-1, 8]), median(v) FROM tall GROUP BY label, vec_id, y) SELECT label, vec_id, y, x, {sql_rounded('v', 9)} AS v FROM wide""")
def border_median_padding(spark, folder):
    """Every image with a border of one pixel: medians of its columns, then of its rows."""
    return tensors.padded_axes(pixels(spark, folder), ["label", "vec_id"], SIDE, SIDE, 1).withColumn("v", rounded(F.col("v"), 9))


@query(f"WITH {_MAPS}, p AS (SELECT label, i, y, x, v, floor(CASE WHEN atan2(y - 4, x - 4) < 0 THEN degrees(atan2(y - 4, x - 4)) + 360 ELSE degrees(atan2(y - 4, x - 4)) END) AS angle, floor(sqrt((y - 4) * (y - 4) + (x - 4) * (x - 4))) AS far FROM maps) SELECT label, CAST(angle AS BIGINT) AS angle, CAST(far AS BIGINT) AS far, {sql_rounded('arg_max(v, i)', 9)} AS v FROM p GROUP BY label, angle, far")
def polar_scatter(spark, folder):
    """Maps on (angle, distance); of several pixels of one place the last is kept."""
    angle, far = G.polar(F.col("x") - 4, F.col("y") - 4)
    return maps(spark, folder).groupBy("label", F.floor(angle).alias("angle"), F.floor(far).alias("far")).agg(rounded(F.max_by("v", "i"), 9).alias("v"))


@query(f"WITH {_MAPS} SELECT label, i, {sql_rounded('v', 9)} AS v, CAST(row_number() OVER (PARTITION BY label ORDER BY floor(v * 1e9 + 0.500001) DESC, i) AS INT) AS rank FROM maps QUALIFY rank <= 10")
def strongest_pixels(spark, folder):
    """The ten largest pixels of each map in order."""
    rows = maps(spark, folder).select("label", "i", rounded(F.col("v"), 9).alias("v"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("v"), "i"))).where("rank <= 10")


_ROUND = "SELECT s.label, s.i, s.y, s.x, s.v FROM {a} s JOIN {a} b ON s.label = b.label AND abs(s.y - b.y) <= 1 AND abs(s.x - b.x) <= 1 AND s.i <> b.i GROUP BY ALL HAVING count(*) >= 2"


@query(f"""WITH {_MAPS}, m AS (SELECT label, quantile_cont(v, 0.6) AS c FROM maps GROUP BY label), r0 AS (SELECT label, i, y, x, v FROM maps JOIN m USING (label) WHERE v > c), r1 AS ({_ROUND.format(a='r0')}), r2 AS ({_ROUND.format(a='r1')}), few AS (SELECT label FROM r2 GROUP BY label HAVING count(*) <= 22)
SELECT label, i, {sql_rounded('v', 9)} AS v FROM r2 SEMI JOIN few USING (label)""")
def neighbour_filter_twice(spark, folder):
    """Two rounds of dropping pixels with fewer than a quarter of their neighbours; maps with more than 22 pixels left are rejected."""
    rows = maps(spark, folder)
    cut = rows.groupBy("label").agg(F.percentile("v", F.lit(0.6)).alias("c"))
    left = pairs.drop_singled(rows.join(cut, "label").where("v > c").drop("c"), ["label"], 2 / 8, rounds=2)
    few = left.groupBy("label").agg(F.count("*").alias("n")).where("n <= 22").select("label")
    return left.join(few, "label", "left_semi").select("label", "i", rounded(F.col("v"), 9).alias("v"))


_OTSU = f"""{_MAPS}, span AS (SELECT label, min(v) AS lo, max(v) AS hi FROM maps GROUP BY label),
grey AS (SELECT label, i, y, x, CASE WHEN hi = lo THEN 0 ELSE CAST(floor((v - lo) / (hi - lo) * 255 + 0.5) AS INT) END AS g FROM maps JOIN span USING (label)),
hist AS (SELECT label, g, count(*) AS n FROM grey GROUP BY label, g),
sums AS (SELECT label, g, CAST(sum(n) OVER below AS DOUBLE) AS w0, CAST(sum(n * g) OVER below AS DOUBLE) AS s0, CAST(sum(n) OVER whole AS DOUBLE) AS w, CAST(sum(n * g) OVER whole AS DOUBLE) AS s FROM hist WINDOW below AS (PARTITION BY label ORDER BY g), whole AS (PARTITION BY label)),
cuts AS (SELECT label, arg_max(g, (CASE WHEN w = w0 THEN 0 ELSE round(w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)), 3) END, -g)) AS cut FROM sums GROUP BY label),
on_ AS (SELECT label, i, y, x FROM grey JOIN cuts USING (label) WHERE g > cut)"""


@query(f"""WITH RECURSIVE {_OTSU},
walk AS (SELECT label, i AS node, i AS component FROM on_ UNION SELECT s.label, s.i, w.component FROM walk w JOIN on_ a ON a.label = w.label AND a.i = w.node JOIN on_ s ON s.label = a.label AND abs(s.y - a.y) + abs(s.x - a.x) = 1 WHERE s.i > w.component),
c AS (SELECT label, node, min(component) AS component FROM walk GROUP BY label, node), z AS (SELECT label, component FROM c GROUP BY label, component QUALIFY row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, component) = 1)
SELECT label, CAST(any_value(cut) AS INT) AS cut, {sql_rounded('avg(x)')} AS center_x, {sql_rounded('avg(y)')} AS center_y, count(*) AS size FROM c JOIN z USING (label, component) JOIN on_ o ON o.label = c.label AND o.i = c.node JOIN cuts ON cuts.label = c.label GROUP BY label""")
def otsu_center(spark, folder):
    """Middle of the largest region above each map's Otsu threshold."""
    rows = maps(spark, folder)
    grey = S.grey_levels(rows, ["label"], "v")
    cuts = S.otsu_cuts(grey, ["label"], "g")
    on = grey.join(cuts, "label").where("g > cut")
    largest = graph.largest_component(graph.map_components(on, ["label"]), ["label"]).select("label", F.col("node").alias("i"))
    found = on.join(largest, ["label", "i"]).groupBy("label")
    return found.agg(F.first("cut").alias("cut"), rounded(F.avg("x")).alias("center_x"), rounded(F.avg("y")).alias("center_y"), F.count("*").alias("size"))


# --- cells, channels, recordings -----------------------------------------------------------------------


@query(f"WITH {_CELLS} SELECT recording, arg_max(cell_index, (quality, -cell_index)) AS cell_index, max(quality) AS quality FROM cells GROUP BY recording")
def nan_argmax(spark, folder):
    """The cell with the largest quality of each recording; NaN doesn't count."""
    rows = table(spark, folder, "quality").where(F.col("cell_index").isNotNull() & finite(F.col("quality")))
    return rows.groupBy("recording").agg(F.max_by("cell_index", F.struct("quality", -F.col("cell_index"))).alias("cell_index"), F.max("quality").alias("quality"))


@query(f"WITH {_CELLS}, {_CHANNELS} SELECT recording, channel, cell_index, center_x, center_y FROM cells JOIN stims USING (recording, channel) WHERE center_x BETWEEN 30 AND image_w - 31 AND center_y BETWEEN 30 AND image_h - 31")
def inside_border(spark, folder):
    """Cells whose centre is at least 30 pixels from every border."""
    rows = cells(spark, folder).join(stimuli(spark, folder), ["recording", "channel"])
    return rows.where("center_x between 30 and image_w - 31 and center_y between 30 and image_h - 31").select(*CELL, "center_x", "center_y")


@query(f"WITH {_CELLS}, {_CHANNELS} SELECT recording, channel, cell_index, greatest(center_x - image_w / 8, 0.0) AS x_low, least(center_x + image_w / 8, CAST(image_w AS DOUBLE)) AS x_high, greatest(center_y - image_h / 8, 0.0) AS y_low, least(center_y + image_h / 8, CAST(image_h AS DOUBLE)) AS y_high FROM cells JOIN stims USING (recording, channel) WHERE center_x IS NOT NULL AND center_y IS NOT NULL AND image_w IS NOT NULL AND image_h IS NOT NULL")
def zoomed_extent(spark, folder):
    """A quarter of the image around each cell's centre, clipped to the image."""
    rows = cells(spark, folder).join(stimuli(spark, folder), ["recording", "channel"]).where("center_x is not null and center_y is not null and image_w is not null and image_h is not null")
    side = lambda c, size: (F.greatest(F.col(c) - F.col(size) / 8, F.lit(0.0)), F.least(F.col(c) + F.col(size) / 8, F.col(size).cast("double")))
    (xl, xh), (yl, yh) = side("center_x", "image_w"), side("center_y", "image_h")
    return rows.select(*CELL, xl.alias("x_low"), xh.alias("x_high"), yl.alias("y_low"), yh.alias("y_high"))


@query(f"WITH {_CHANNELS} SELECT recording, channel, CAST(k AS INT) AS k, {sql_rounded('k * (image_w - 1) * pixel_size / 9.0')} AS x_um, {sql_rounded('k * (image_h - 1) * pixel_size / 9.0')} AS y_um FROM stims, (SELECT unnest(range(10)) AS k) WHERE image_w IS NOT NULL AND image_h IS NOT NULL AND pixel_size IS NOT NULL")
def resampled_coordinates(spark, folder):
    """Coordinates of each channel's image on ten even points from its first to its last pixel."""
    rows = stimuli(spark, folder).where("image_w is not null and image_h is not null and pixel_size is not null")
    points = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")
    at = lambda size: rounded(F.col("k") * (F.col(size) - 1) * F.col("pixel_size") / 9.0)
    return rows.select("recording", "channel", "image_w", "image_h", "pixel_size", points).select("recording", "channel", "k", at("image_w").alias("x_um"), at("image_h").alias("y_um"))


@query(f"""WITH {_CELLS}, {_OUTLINES}, best AS (SELECT recording, cell_index, min(channel) FILTER (quality = top) AS cluster FROM (SELECT *, max(quality) OVER (PARTITION BY recording, cell_index) AS top FROM cells) GROUP BY ALL)
SELECT cluster, outs.channel, count(*) AS members, count(DISTINCT outs.recording) AS recordings, {sql_rounded('avg(len(center))', 4)} AS bins FROM outs JOIN best ON outs.recording = best.recording AND outs.cell_index = best.cell_index GROUP BY cluster, outs.channel""")
def cluster_membership(spark, folder):
    """Outlines joined with the group their cell belongs to (its best channel), counted per group and channel."""
    best = S.best_per_group(cells(spark, folder), ["recording", "cell_index"], "quality", "channel").select("recording", "cell_index", F.col("channel").alias("cluster"))
    joined = outlines(spark, folder).join(best, ["recording", "cell_index"])
    return joined.groupBy("cluster", "channel").agg(F.count("*").alias("members"), F.count_distinct("recording").alias("recordings"), rounded(F.avg(F.size("center")), 4).alias("bins"))


@query(f"""WITH {_OUTLINES}, areas AS (SELECT outline_id, recording, channel, list_avg(center) AS size FROM whole WHERE recording IS NOT NULL AND channel IS NOT NULL), m AS (SELECT recording, channel, floor(avg(size) * 1e4 + 0.500001) / 1e4 AS size FROM areas GROUP BY recording, channel)
SELECT a.recording, a.channel, arg_min(b.channel, (abs(a.size - b.size), b.channel)) AS closest, {sql_rounded('min(abs(a.size - b.size))', 4)} AS distance FROM m a JOIN m b ON a.recording = b.recording AND a.channel <> b.channel GROUP BY a.recording, a.channel""")
def closest_channel(spark, folder):
    """For each channel of a recording the other one with the most similar mean radius."""
    rows = whole_outlines(spark, folder).where("recording is not null and channel is not null").select("recording", "channel", A.mean(F.transform("center", lambda v: v.cast("double"))).alias("size"))
    mean = rows.groupBy("recording", "channel").agg(rounded(F.avg("size"), 4).alias("size"))
    return pairs.argmin_match(mean, ["recording"], "channel", lambda a, b: F.abs(a - b), "size").select("recording", "channel", "closest", rounded(F.col("distance"), 4).alias("distance"))


@query(f"""WITH {_OUTLINES}, s AS (SELECT outline_id, list_avg(center) AS size FROM whole), m AS (SELECT median(size) AS mid FROM s), d AS (SELECT median(abs(size - mid)) AS mad FROM s, m)
SELECT outline_id, {sql_rounded('0.6744897501960817 * (size - mid) / nullif(mad, 0)', 4)} AS z, abs(0.6744897501960817 * (size - mid) / nullif(mad, 0)) > 3.5 AS outlier FROM s, m, d""")
def robust_outliers(spark, folder):
    """Outlines whose mean radius lies more than 3.5 robust deviations from the median."""
    rows = whole_outlines(spark, folder).select("outline_id", A.mean(F.transform("center", lambda v: v.cast("double"))).alias("size"))
    z = S.robust_z(rows, "size")
    return z.select("outline_id", rounded(F.col("z"), 4).alias("z"), (F.abs("z") > 3.5).alias("outlier"))


_CONTOURS = f"""{_OUTLINES}, vert AS (SELECT outline_id, recording, cell_index, channel, i, r * cos(i * 2 * pi() / n) AS x, r * sin(i * 2 * pi() / n) AS y FROM (SELECT outline_id, recording, cell_index, channel, n, unnest(center) AS r, generate_subscripts(center, 1) - 1 AS i FROM whole)),
two AS (SELECT a.outline_id AS a, b.outline_id AS b FROM whole a JOIN whole b ON a.recording = b.recording AND a.cell_index = b.cell_index AND a.outline_id < b.outline_id),
far AS (SELECT two.a, two.b, p.i AS i, q.i AS j, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) AS d FROM two JOIN vert p ON p.outline_id = two.a JOIN vert q ON q.outline_id = two.b),
there AS (SELECT a, b, max(d) AS m, avg(d) AS v FROM (SELECT a, b, i, min(d) AS d FROM far GROUP BY a, b, i) GROUP BY a, b), back AS (SELECT a, b, max(d) AS m, avg(d) AS v FROM (SELECT a, b, j, min(d) AS d FROM far GROUP BY a, b, j) GROUP BY a, b)"""


@query(f"WITH {_CONTOURS} SELECT a, b, {sql_rounded('greatest(there.m, back.m)', 4)} AS hausdorff, {sql_rounded('(there.v + back.v) / 2', 4)} AS mean_symmetric FROM there JOIN back USING (a, b)")
def contour_distances(spark, folder):
    """Distances between the outlines of one cell in different channels."""
    rows = whole_outlines(spark, folder).select("outline_id", "recording", "cell_index", G.vertices(F.transform("center", lambda v: v.cast("double"))).alias("points"))
    found = contours.distances(rows, ["recording", "cell_index"], "outline_id", "points")
    return found.select("a", "b", rounded(F.col("hausdorff"), 4).alias("hausdorff"), rounded(F.col("mean_symmetric"), 4).alias("mean_symmetric"))


@query(f"WITH RECURSIVE {_CONTOURS}, near AS (SELECT a, b FROM there JOIN back USING (a, b) WHERE (there.v + back.v) / 2 < 15), both_ AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), walk AS (SELECT outline_id AS node, outline_id AS component FROM whole UNION SELECT e.b, w.component FROM walk w JOIN both_ e ON e.a = w.node WHERE e.b > w.component) SELECT node, min(component) AS component FROM walk GROUP BY node")
def contour_groups(spark, folder):
    """Outlines of one cell that are linked by mean distances below 15 um."""
    rows = whole_outlines(spark, folder).select("outline_id", "recording", "cell_index", G.vertices(F.transform("center", lambda v: v.cast("double"))).alias("points"))
    near = contours.distances(rows, ["recording", "cell_index"], "outline_id", "points").where("mean_symmetric < 15").select(F.lit(0).alias("all"), "a", "b")
    nodes = rows.select(F.lit(0).alias("all"), F.col("outline_id").alias("node"))
    return graph.components(nodes, near, ["all"]).select("node", "component")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS first, CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN value END AS second, json_extract_string(props, '$.k') IS NULL AS missing FROM events")
def labelled_arrays(spark, folder):
    """Labelled arrays written as JSON and read back; a null array stays null."""
    k = F.get_json_object("props", "$.k").cast("double")
    data = F.when(k.isNotNull(), F.array(k, F.col("value")))
    text = cubes.to_labelled_json(F.array(F.lit("x")), F.create_map(F.lit("x"), F.array(F.lit(0.0), F.lit(1.0))), data, F.lit("pair"))
    back = table(spark, folder, "events").select("event_id", cubes.from_labelled_json(text).alias("back"))
    return back.select("event_id", F.get("back.data", F.lit(0)).alias("first"), F.get("back.data", F.lit(1)).alias("second"), F.col("back").isNull().alias("missing"))


@query(f"""WITH stims AS (SELECT recording, stimulus_id, max(image_w) AS image_w, max(sta_file) AS sta_file FROM channels GROUP BY ALL), first AS (SELECT recording, min(stimulus_id) AS stimulus_id FROM channels WHERE stimulus_id IS NOT NULL GROUP BY recording),
every_ AS (SELECT recording, channel, max(stimulus_id) AS stimulus_id, max(image_w) AS image_w, max(sta_file) AS sta_file FROM channels GROUP BY recording, channel)
SELECT * FROM every_ WHERE channel <> 'white' OR recording NOT IN (SELECT recording FROM first) UNION ALL SELECT recording, 'white', stimulus_id, image_w, sta_file FROM first JOIN stims USING (recording, stimulus_id)""")
def channels_added(spark, folder):
    """Channels with a white one for each recording, made from its first stimulus (in place of the one it may have)."""
    columns = ["recording", "channel", "colour", "stimulus_id", "image_w", "sta_file"]
    every = table(spark, folder, "channels").groupBy("recording", "channel").agg(*[F.max(c).alias(c) for c in columns[2:]])
    first = every.where("stimulus_id is not null").groupBy("recording").agg(F.min("stimulus_id").alias("stimulus_id"))
    added = first.select("recording", F.lit("white").alias("channel"), F.lit("white").alias("colour"), "stimulus_id")
    return settings.add_channels(every, added).select("recording", "channel", "stimulus_id", "image_w", "sta_file")


@query("""WITH c AS (SELECT recording, count(DISTINCT channel) AS channels, count(DISTINCT stimulus_id) AS stimuli, max(nr_triggers) AS triggers FROM channels GROUP BY recording), q AS (SELECT recording, count(DISTINCT cell_index) AS cells FROM quality WHERE cell_index IS NOT NULL GROUP BY recording), r AS (SELECT recording, max(nr_cells) AS listed FROM recordings GROUP BY recording)
SELECT r.recording, listed, coalesce(channels, 0) AS channels, coalesce(stimuli, 0) AS stimuli, triggers, coalesce(cells, 0) AS cells FROM r LEFT JOIN c USING (recording) LEFT JOIN q USING (recording)""")
def recording_overview(spark, folder):
    """Channels, stimuli, triggers and cells of every recording."""
    stims = table(spark, folder, "channels").groupBy("recording").agg(F.count_distinct("channel").alias("channels"), F.count_distinct("stimulus_id").alias("stimuli"), F.max("nr_triggers").alias("triggers"))
    seen = table(spark, folder, "quality").where("cell_index is not null").groupBy("recording").agg(F.count_distinct("cell_index").alias("cells"))
    listed = table(spark, folder, "recordings").groupBy("recording").agg(F.max("nr_cells").alias("listed"))
    return listed.join(stims, "recording", "left").join(seen, "recording", "left").fillna(0, ["channels", "stimuli", "cells"])


# --- longer paths ------------------------------------------------------------------------------------------


@query(f"""WITH {_PIXELS}, m AS (SELECT label, i, sum(v) AS s, median(v) AS med FROM pixels GROUP BY ALL), corrected AS (SELECT label, vec_id, i, y, x, v - (s / 100 - med) AS v FROM pixels JOIN m USING (label, i)),
sums AS (SELECT label, vec_id, sum(v) AS whole FROM corrected GROUP BY label, vec_id), rows_ AS (SELECT label, y, x, floor((covar_samp(v, whole) - var_samp(v)) * 1e9 + 0.500001) / 1e9 AS total FROM corrected JOIN sums USING (label, vec_id) GROUP BY label, y, x),
cut AS (SELECT label, quantile_cont(total, 0.05) AS lo, quantile_cont(total, 0.95) AS hi FROM rows_ GROUP BY label)
SELECT label, y, x, {sql_rounded('total', 9)} AS total, CASE WHEN total > hi THEN 'high' WHEN total < lo THEN 'low' ELSE 'middle' END AS side, CAST(row_number() OVER (PARTITION BY label ORDER BY total DESC, y, x) AS INT) AS rank FROM rows_ JOIN cut USING (label) QUALIFY rank <= 12""")
def covariance_path(spark, folder):
    """Median-corrected stack, covariance row sums, their quantile sides, and the twelve largest in order."""
    rows = pixels(spark, folder)
    levels = rows.groupBy("label", "i").agg(F.sum("v").alias("s"), F.median("v").alias("med"))
    corrected = rows.join(levels, ["label", "i"]).select("label", "vec_id", "y", "x", (F.col("v") - (F.col("s") / 100 - F.col("med"))).alias("v"))
    totals = S.covariance_row_sum(corrected, ["label"], "vec_id").withColumn("total", rounded(F.col("total"), 9))
    ranked = S.quantile_split(totals, ["label"], "total", 0.05, 0.95).withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("total"), "y", "x")))
    return ranked.where("rank <= 12").select("label", "y", "x", "total", "side", "rank")


@query(f"WITH {_MAPS}, span AS (SELECT label, min(v) AS lo, max(v) AS hi FROM maps GROUP BY label) SELECT label, i, CASE WHEN hi = lo THEN 0 ELSE CAST(floor((v - lo) / (hi - lo) * 255 + 0.5) AS INT) END AS grey FROM maps JOIN span USING (label)")
def grey_maps(spark, folder):
    """Mean images on 0..255 by the range of each whole image."""
    return S.grey_levels(maps(spark, folder), ["label"], "v").select("label", "i", F.col("g").alias("grey"))


@query(f"""WITH stack AS ({SQL["feature_stack"]}), q AS (SELECT position, median(value) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM stack WHERE value IS NOT NULL GROUP BY position)
SELECT recording, channel, cell_index, position, {sql_rounded('(value - med) / coalesce(nullif(iqr / 1.3489795003921634, 0), 1)', 4)} AS scaled FROM stack JOIN q USING (position) WHERE value IS NOT NULL""")
def scaled_features(spark, folder):
    """Sample x feature matrix of all recordings, each feature scaled by its median and quartiles."""
    known = QUERIES["feature_stack"](spark, folder).where("value is not null")
    return S.robust_scaled(known, ["position"], "value").select(*CELL, "position", rounded(F.col("scaled"), 4).alias("scaled"))


@query(f"""WITH {_TRACES}, s AS (SELECT recording, channel, cell_index, t, x, lead(t) OVER w AS t1, lead(x) OVER w AS x1 FROM (SELECT recording, channel, cell_index, unnest(time_ms) AS t, CAST(unnest(v) AS DOUBLE) AS x FROM paths) WHERE isfinite(x) WINDOW w AS (PARTITION BY recording, channel, cell_index ORDER BY t)),
longest AS (SELECT channel, arg_max(time_ms, (len(time_ms), -time_ms[1], -time_ms[2])) AS grid FROM paths WHERE len(time_ms) > 1 GROUP BY channel),
g AS (SELECT recording, p.channel, cell_index, unnest(grid) AS spot, CAST(generate_subscripts(grid, 1) - 1 AS INT) AS position FROM paths p JOIN longest USING (channel))
SELECT g.recording, g.channel, g.cell_index, position, {sql_rounded('coalesce(arg_min(x + (x1 - x) * (spot - t) / (t1 - t), t), 0)', 5)} AS v FROM g LEFT JOIN s ON g.recording = s.recording AND g.channel = s.channel AND g.cell_index = s.cell_index AND t <= spot AND spot <= t1 GROUP BY ALL""")
def aligned_traces(spark, folder):
    """Every trace on the longest time grid of its channel; 0 beyond its own ends."""
    rows = traces(spark, folder)
    grids = rows.where(F.size("time_ms") > 1).groupBy("channel").agg(F.max_by("time_ms", F.struct(F.size("time_ms"), -F.get("time_ms", F.lit(0)), -F.get("time_ms", F.lit(1)))).alias("grid"))
    points = F.filter(F.arrays_zip(F.col("time_ms").alias("x"), F.col("v").alias("y")), lambda p: p["y"].isNotNull() & ~F.isnan(p["y"]))
    both = rows.join(grids, "channel").withColumn("p", points)
    x, y = F.transform("p", lambda p: p["x"]), F.transform("p", lambda p: p["y"].cast("double"))
    return both.select(*CELL, F.posexplode(A.resampled(x, y, F.col("grid"))).alias("position", "v")).withColumn("v", rounded(F.col("v"), 5))
