"""Queries and SQL of the problems on algorithms and texts (3, 5, 6, 7 and 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rfloom.llm import leaks, packing, similarity_clusters, top_items, toxicity
from rfloom.tables import table, written

GROUP = ["recording", "channel"]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 best cells of each recording and channel."""
    return top_items.top_items(table(spark, folder, "quality"), GROUP, "cell_index", "quality", 5).select(*GROUP, "cell_index")


def p3_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best cells of each recording and channel with score and rank."""
    return top_items.top_items(table(spark, folder, "quality"), GROUP, "cell_index", "quality", 20)


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    cells = written(similarity_clusters.features(table(spark, folder, "outlines"), table(spark, folder, "sta_traces")), "curves")
    return similarity_clusters.clusters(cells)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each cluster's smallest outline with every other member."""
    found = _clusters(spark, folder).where("outline_id <> cluster")
    return found.select(F.col("cluster").alias("outline_id_a"), F.col("outline_id").alias("outline_id_b"))


def p5_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Size and three most typical cells of each cluster."""
    return similarity_clusters.described(_clusters(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that needed more than one container."""
    return packing.pack(table(spark, folder, "documents")).where("piece = 1").select("doc_id")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every container with its items, tokens and the room left."""
    return packing.containers(packing.pack(table(spark, folder, "documents")))


def p6_totals(spark: SparkSession, folder: str) -> DataFrame:
    """What all containers hold together: messages, tokens, containers that are too full, and whether at most a twentieth of the room is left."""
    packed = packing.pack(table(spark, folder, "documents"))
    filled = packing.containers(packed).agg(F.sum("items").alias("pieces"), F.sum("tokens").alias("tokens"), F.count_if(F.col("room") < 0).alias("overfull"), (F.sum("room") <= 0.05 * 8192 * F.count("*")).alias("tight"))
    distinct = packed.agg(F.count_distinct("doc_id").alias("messages"), F.count_distinct("doc_id", "piece").alias("distinct_pieces"))
    one = F.lit(1).alias("one")  # one row each
    return distinct.select("*", one).join(filled.select("*", one), "one").drop("one")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Messages that show at least 12 consecutive words of an evaluation item."""
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Substitution-tolerant overlaps of messages and items, with the longest exact run."""
    return leaks.overlaps(table(spark, folder, "documents"), table(spark, folder, "eval_items")).where(f"overlap >= {leaks.SPAN}")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Messages with abusive, hateful or sexually explicit content."""
    return _scored(spark, folder).where("flagged").select("doc_id")


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every message."""
    return _scored(spark, folder)


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rate of such messages per source."""
    return toxicity.rates(_scored(spark, folder))


QUERIES = {f.__name__: f for f in (p3_found, p3_ranked, p5_found, p5_clusters, p6_found, p6_containers, p6_totals, p7_found, p7_overlaps, p8_found, p8_scores, p8_rates)}

_TOP = """SELECT recording, channel, cell_index, {more} FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY recording, channel ORDER BY quality DESC, cell_index) AS INT) AS rank
  FROM (SELECT recording, channel, cell_index, max(quality) + 0.0 AS quality FROM quality WHERE cell_index IS NOT NULL AND isfinite(quality) GROUP BY ALL)) WHERE rank <= {n}"""

SQL = {
    "p3_found": _TOP.format(more="", n=5).replace("cell_index,  FROM", "cell_index FROM"),
    "p3_ranked": _TOP.format(more="quality, rank", n=20),
    "p6_totals": """SELECT count(*) AS messages, CAST(sum(ceil(tokens / 8192)) AS BIGINT) AS distinct_pieces, CAST(sum(ceil(tokens / 8192)) AS BIGINT) AS pieces, CAST(sum(tokens) AS BIGINT) AS tokens,
  CAST(0 AS BIGINT) AS overfull, true AS tight FROM (SELECT doc_id, max(coalesce(octet_length(encode(text)), 0) + 1) AS tokens FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)""",
    "p6_found": "SELECT DISTINCT doc_id FROM documents WHERE octet_length(encode(text)) + 1 > 8192",
}

_CURVE = "SELECT outline_id, {n} AS curve, CAST({x} AS DOUBLE) AS x, CAST({y}[i] AS DOUBLE) AS y FROM (SELECT *, unnest(range(1, len({y}) + 1)) AS i FROM cells{same})"
#: All pairs, curve by curve, read at the same points; with clusters that are groups alike throughout, the smallest alike cell is the cluster's.
SQL["p5_found"] = f"""WITH o AS (SELECT outline_id, any_value(recording) AS recording, any_value(channel) AS channel, any_value(cell_index) AS cell_index, any_value(center) AS center, any_value(surround) AS surround, any_value(in_out) AS in_out, any_value(radius_um) AS radius_um FROM outlines WHERE outline_id IS NOT NULL GROUP BY outline_id),
t AS (SELECT recording, channel, cell_index, any_value(time_ms) AS time_ms, any_value(v) AS v FROM sta_traces GROUP BY recording, channel, cell_index),
cells AS (SELECT o.*, time_ms, v FROM o JOIN t USING (recording, channel, cell_index)),
radii AS (SELECT quantile_disc(list_min(radius_um), 0.5) AS low, quantile_disc(list_max(radius_um), 0.5) AS high FROM outlines),
times AS (SELECT quantile_disc(list_min(time_ms), 0.5) AS low, quantile_disc(list_max(time_ms), 0.5) AS high FROM sta_traces),
raw AS ({_CURVE.format(n=1, x="(i - 1) * 360.0 / len(center)", y="center", same="")} UNION ALL {_CURVE.format(n=2, x="(i - 1) * 360.0 / len(surround)", y="surround", same="")}
  UNION ALL {_CURVE.format(n=3, x="radius_um[i]", y="in_out", same=" WHERE len(radius_um) = len(in_out)")} UNION ALL {_CURVE.format(n=4, x="time_ms[i]", y="v", same=" WHERE len(time_ms) = len(v)")}),
pts AS (SELECT * FROM raw WHERE isfinite(x) AND isfinite(y)),
enough AS (SELECT outline_id, curve FROM pts GROUP BY outline_id, curve HAVING count(*) >= 3),
wrapped AS (SELECT * FROM pts UNION ALL SELECT outline_id, curve, x - 360, y FROM pts WHERE curve <= 2 UNION ALL SELECT outline_id, curve, x + 360, y FROM pts WHERE curve <= 2),
grid AS (SELECT unnest([1, 2]) AS curve, range * 10.0 AS p FROM range(36) UNION ALL SELECT 3, low + (high - low) * range / 31 FROM radii, range(32) UNION ALL SELECT 4, low + (high - low) * range / 39 FROM times, range(40)),
near AS (
  SELECT outline_id, curve, p, max(x) FILTER (x <= p) AS x0, arg_max(y, x) FILTER (x <= p) AS y0, min(x) FILTER (x >= p) AS x1, arg_min(y, x) FILTER (x >= p) AS y1
  FROM enough JOIN grid USING (curve) JOIN wrapped USING (outline_id, curve) GROUP BY outline_id, curve, p),
vals AS (SELECT outline_id, curve, p, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (p - x0) / (x1 - x0) END AS v FROM near),
pairs AS (SELECT a.outline_id AS a, b.outline_id AS b, curve, corr(a.v, b.v) AS c FROM vals a JOIN vals b USING (curve, p) WHERE a.outline_id < b.outline_id GROUP BY ALL),
alike AS (SELECT a, b FROM pairs GROUP BY a, b HAVING count(*) = 4 AND bool_and(coalesce(isfinite(c), false)) AND min(c) >= 0.9)
SELECT min(a) AS outline_id_a, b AS outline_id_b FROM alike GROUP BY b"""
