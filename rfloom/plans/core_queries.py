"""Queries and SQL of the general data-preparation problems (1, 2 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rfloom.functions.arrays import rounded, sql_rounded
from rfloom.operators import compaction, regular_grid, schema_drift
from rfloom.tables import table

SOURCE = ["recording", "channel", "cell_index"]
READING = (SOURCE, "time_max", "sta_single_pixel", "dt_ms")
#: All columns of the exports' table with their types; whole numbers stay whole. The names are the ones that ``p4_records`` takes
#: as approved by hand; ``p4_table`` takes them from the report of changes.
COLUMNS = {
    "channel": ("string", ["channel", "channel_name", "chan", "Channel", "stim_channel", "led"]),
    "time_max": ("double", ["time_max", "Time_Max", "t_max", "peak_ms", "time_max_ms", "timeMax"]),
    "radius": ("double", ["radius", "Radius", "rad", "r_um", "radius_um", "rf_extent"]),
    "quality": ("double", ["quality", "qual", "score", "rf_quality"]),
    "angle": ("double", ["angle"]),
    "center_shift": ("double", ["center_shift"]),
    "tilt": ("double", ["tilt", "Tilt", "axis_ratio"]),
    "n_spikes": ("bigint", ["n_spikes"]),
    "mask_px": ("bigint", ["mask_px"]),
    "rig_temp": ("double", ["rig_temp"]),
}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Components that more than one file holds whole."""
    whole = compaction.compact_components(table(spark, folder, "nmf_files"), table(spark, folder, "channels"))
    return whole.where("n_files > 1").select(*compaction.KEY)


def p1_components(spark: SparkSession, folder: str) -> DataFrame:
    """The consolidated table: every component once, with its file and the number of files that hold it."""
    whole = compaction.compact_components(table(spark, folder, "nmf_files"), table(spark, folder, "channels"))
    total = F.round(F.aggregate("weights", F.lit(0.0), lambda s, w: s + w), 2)
    return whole.select(*compaction.KEY, "file_id", "n_files", F.size("weights").alias("pixels"), total.alias("total_weight"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Grid steps without a usable reading, between a source's first and last: the filled steps of the regular grid."""
    grid = regular_grid.regular_grid(table(spark, folder, "sta_readings"), *READING)
    return grid.where("status = 'filled'").select(*SOURCE, "slot")


def p2_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every source on its regular grid."""
    grid = regular_grid.regular_grid(table(spark, folder, "sta_readings"), *READING)
    return grid.withColumns({c: rounded(F.col(c)) for c in ("grid_time", "value", "increment")})


def p2_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of missing grid steps of each source, however long."""
    return regular_grid.gaps(regular_grid.intervals(table(spark, folder, "sta_readings"), *READING), SOURCE)


def counters(readings: DataFrame) -> DataFrame:
    """Cumulative counters of the readings: the running sum of their magnitudes in thousandths, which a device sets back to zero after every tenth reading."""
    usable = regular_grid.usable_readings(readings, *READING)
    once = usable.groupBy(*SOURCE, "t").agg(F.max("v").alias("v"), F.max("step").alias("dt_ms"))
    order = Window.partitionBy(*SOURCE).orderBy("t")
    numbered = once.withColumn("life", F.floor((F.row_number().over(order) - 1) / 10))
    grown = F.sum(F.round(F.abs("v") * 1000).cast("bigint")).over(Window.partitionBy(*SOURCE, "life").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return numbered.select(*SOURCE, F.col("t").alias("time_max"), "dt_ms", grown.cast("double").alias("sta_single_pixel"))


def p2_counter(spark: SparkSession, folder: str) -> DataFrame:
    """Counters with resets on the regular grid: the increment of every step."""
    grid = regular_grid.regular_grid(counters(table(spark, folder, "sta_readings")), *READING, counter=True)
    return grid.select(*SOURCE, "slot", rounded(F.col("increment"), 3).alias("increment"), rounded(F.col("value"), 3).alias("value"), "status")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of each export against the previous one of its recording."""
    return schema_drift.changes(table(spark, folder, "noise_exports")).drop("recording")


def p4_table(spark: SparkSession, folder: str) -> DataFrame:
    """All exports as one table: every typed column, filled by the names that the report of changes shows it to go by, the rest as JSON, and the text of records that can't be read."""
    exports = table(spark, folder, "noise_exports")
    names = schema_drift.aliases(schema_drift.changes(exports), list(COLUMNS))
    rows = schema_drift.promote(schema_drift.ingest(exports), {column: (kind, names[column]) for column, (kind, _) in COLUMNS.items()})
    return rows.select("recording", "export_file", "cell_index", "valid", *COLUMNS, "rescued", "unread").distinct()


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    """All exports as one table that keeps everything: each approved column, the rest as JSON, and the text of records that can't be read."""
    rows = schema_drift.promote(schema_drift.ingest(table(spark, folder, "noise_exports")), COLUMNS)
    return rows.select("recording", "export_file", "cell_index", "valid", *COLUMNS, "rescued", "unread").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_components, p2_found, p2_grid, p2_gaps, p2_counter, p4_found, p4_table, p4_records)}

_COMPONENTS = r"""
named AS (
  SELECT DISTINCT file_id, written_at, cell_idx, first_component, shape, weights,
    regexp_extract(lower(regexp_replace(trim(w_path), '[\\/]+', '/', 'g')), '([^/]+)/([^/]+)/cell_?([0-9]+)(?:/[^/]*)?$', ['recording', 'channel', 'cell']) AS w
  FROM nmf_files),
pieces AS (
  SELECT coalesce(c.recording, w.recording) AS recording, coalesce(c.channel, w.channel) AS channel, coalesce(cell_idx, CAST(w.cell AS INT)) AS cell_idx,
    CAST(first_component + i AS INT) AS component, file_id, written_at, weights[i * shape[2] + 1 : (i + 1) * shape[2]] AS weights
  FROM (SELECT *, unnest(range(least(shape[1], len(weights) // shape[2]))) AS i FROM named WHERE shape[2] > 0) n
  LEFT JOIN (SELECT DISTINCT recording, channel FROM channels) c ON lower(c.recording) = w.recording AND lower(c.channel) = w.channel)"""

_USABLE = """
steps AS (SELECT recording, channel, cell_index, max(dt_ms) AS step FROM sta_readings WHERE dt_ms > 0 GROUP BY ALL),
usable AS (
  SELECT r.recording, r.channel, r.cell_index, step, time_max AS t, max(sta_single_pixel) AS v, CAST(floor(time_max / step + 0.5) AS BIGINT) AS slot
  FROM sta_readings r JOIN steps s ON r.recording IS NOT DISTINCT FROM s.recording AND r.channel IS NOT DISTINCT FROM s.channel AND r.cell_index IS NOT DISTINCT FROM s.cell_index
  WHERE isfinite(time_max) AND isfinite(sta_single_pixel) GROUP BY ALL)"""


def _grid(usable: str, counter: bool = False) -> str:
    """The regular grid of ``usable`` or of the counters made from it."""
    change, level = ("CASE WHEN v < v0 THEN v ELSE v - v0 END", "CASE WHEN v < v0 THEN 0 ELSE v0 END") if counter else ("v - v0", "v0")
    digits, time = (3, "") if counter else (6, f"{sql_rounded('max(grid_time)')} AS grid_time, ")
    return f"""WITH {_USABLE},
counted AS (
  SELECT recording, channel, cell_index, step, t, slot, CAST(sum(CAST(round(abs(v) * 1000) AS BIGINT)) OVER (PARTITION BY recording, channel, cell_index, life ORDER BY t) AS DOUBLE) AS v
  FROM (SELECT *, (row_number() OVER (PARTITION BY recording, channel, cell_index ORDER BY t) - 1) // 10 AS life FROM usable)),
spans AS (
  SELECT *, lag(t) OVER w AS t0, lag(v) OVER w AS v0, lag(slot) OVER w AS slot0 FROM {usable} WINDOW w AS (PARTITION BY recording, channel, cell_index ORDER BY t)),
cells AS (SELECT *, {change} AS change, {level} AS low, unnest(range(coalesce(slot0, slot), slot + 1)) AS cell FROM spans),
parts AS (
  SELECT recording, channel, cell_index, cell, cell * step AS grid_time,
    coalesce(change * greatest(least(t, cell * step + step / 2) - greatest(t0, cell * step - step / 2), 0.0) / nullif(t - t0, 0), 0.0) AS share,
    CASE WHEN cell = slot THEN v END AS own, CASE WHEN cell = slot THEN abs(t - cell * step) END AS far, t,
    CASE WHEN cell > slot0 AND cell < slot THEN low + change * (cell * step - t0) / (t - t0) END AS level
  FROM cells)
SELECT recording, channel, cell_index, cell AS slot, {time}{sql_rounded('coalesce(arg_min(own, (far, t)) FILTER (own IS NOT NULL), max(level))', digits)} AS value,
  {sql_rounded('sum(share)', digits)} AS increment, CASE WHEN count(own) = 0 THEN 'filled' ELSE 'observed' END AS status
FROM parts GROUP BY recording, channel, cell_index, cell"""


_SQL_TYPES = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT"}


def _first(column: str, answer: str) -> str:
    """The first name of ``column`` whose value can be cast (a value of the wanted kind under the column's own name comes first anyway), or that value."""
    sql = _SQL_TYPES[COLUMNS[column][0]]
    cases = []
    for name in COLUMNS[column][1]:
        text = f"""json_extract_string(j, '$."{name}"')"""
        ok = f"""json_type(j, '$."{name}"') IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'VARCHAR', 'BOOLEAN') AND TRY_CAST({text} AS {sql}) IS NOT NULL"""
        if sql == "BIGINT":
            ok += f" AND TRY_CAST({text} AS DOUBLE) = TRY_CAST({text} AS BIGINT)"
        cases.append(f"WHEN {ok} THEN " + (f"'{name}'" if answer == "name" else f"TRY_CAST({text} AS {sql})"))
    return f"CASE {' '.join(cases)} END"


#: JSON as Spark writes a variant: names sorted, one level of nesting, no zeros after the point.
_TEXT = """regexp_replace(CASE WHEN json_type({v}) = 'OBJECT' THEN '{{' || array_to_string(list_transform(list_sort(json_keys({v})), lambda m: '"' || m || '":' || CAST(json_extract({v}, '$."' || m || '"') AS VARCHAR)), ',') || '}}' ELSE CAST({v} AS VARCHAR) END, '([0-9])[.]0+([],}}]|$)', '\\1\\2', 'g')"""


SQL = {
    "p1_found": f"WITH {_COMPONENTS} SELECT recording, channel, cell_idx, component FROM pieces GROUP BY ALL HAVING count(DISTINCT file_id) > 1",
    "p1_components": f"""WITH {_COMPONENTS}
SELECT recording, channel, cell_idx, component, arg_max(file_id, (written_at, file_id)) AS file_id, count(DISTINCT file_id) AS n_files,
  CAST(len(arg_max(weights, (written_at, file_id))) AS INT) AS pixels, round(list_sum(CAST(arg_max(weights, (written_at, file_id)) AS DOUBLE[])), 2) AS total_weight
FROM pieces GROUP BY recording, channel, cell_idx, component""",
    "p2_found": f"""WITH {_USABLE}, slots AS (SELECT DISTINCT recording, channel, cell_index, slot FROM usable),
ends AS (SELECT *, lead(slot) OVER (PARTITION BY recording, channel, cell_index ORDER BY slot) AS next FROM slots)
SELECT recording, channel, cell_index, unnest(range(slot + 1, next)) AS slot FROM ends WHERE next > slot + 1""",
    "p2_grid": _grid("usable"),
    "p2_gaps": f"""WITH {_USABLE}, slots AS (SELECT DISTINCT recording, channel, cell_index, slot FROM usable),
ends AS (SELECT *, lead(slot) OVER (PARTITION BY recording, channel, cell_index ORDER BY slot) AS next FROM slots)
SELECT recording, channel, cell_index, slot + 1 AS first_slot, next - 1 AS last_slot, next - slot - 1 AS steps FROM ends WHERE next > slot + 1""",
    "p2_counter": _grid("counted", counter=True),
    "p4_found": """WITH recs AS (
  SELECT DISTINCT recording, export_file, CAST(record_json AS JSON) AS j FROM noise_exports WHERE json_valid(record_json) AND json_type(record_json) = 'OBJECT'),
f AS (
  SELECT recording, export_file, cell, name, CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'float' WHEN 'NULL' THEN NULL WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' ELSE lower(t) END AS kind,
    CASE WHEN t = 'NULL' THEN NULL WHEN t IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN 'n' || CAST(CAST(v AS DOUBLE) AS VARCHAR) ELSE t || CAST(v AS VARCHAR) END AS value
  FROM (SELECT recording, export_file, CAST(json_extract_string(j, '$.cell_index') AS BIGINT) AS cell, name, json_extract(j, '$."' || name || '"') AS v, json_type(j, '$."' || name || '"') AS t
        FROM (SELECT *, unnest(json_keys(j)) AS name FROM recs)) WHERE name <> 'cell_index'),
kinds AS (
  SELECT recording, export_file, name, CASE WHEN count(DISTINCT CASE kind WHEN 'integer' THEN 'float' ELSE kind END) > 1 THEN 'mixed' WHEN bool_or(kind = 'float') THEN 'float' ELSE min(kind) END AS kind FROM f GROUP BY ALL),
steps AS (
  SELECT recording, export_file AS file, lag(export_file) OVER (PARTITION BY recording ORDER BY since, export_file) AS previous
  FROM (SELECT recording, export_file, min(exported_at) AS since FROM noise_exports GROUP BY ALL)),
was AS (SELECT file, previous, name, kind FROM steps s JOIN kinds k ON k.export_file = s.previous),
now AS (SELECT file, previous, name, kind FROM steps s JOIN kinds k ON k.export_file = s.file WHERE previous IS NOT NULL),
gone AS (SELECT * FROM was w WHERE NOT EXISTS (FROM now n WHERE n.file = w.file AND n.name = w.name)),
come AS (SELECT * FROM now n WHERE NOT EXISTS (FROM was w WHERE n.file = w.file AND n.name = w.name)),
vals AS (SELECT DISTINCT export_file, name, cell, value FROM f WHERE value IS NOT NULL AND cell IS NOT NULL),
pairs AS (
  SELECT file, old, new, count(*) AS cells, count(*) FILTER (equal) AS equal
  FROM (SELECT g.file, g.name AS old, c.name AS new, a.cell, bool_or(a.value = b.value) AS equal
        FROM gone g JOIN come c ON g.file = c.file JOIN vals a ON a.export_file = g.previous AND a.name = g.name JOIN vals b ON b.export_file = c.file AND b.name = c.name AND a.cell = b.cell GROUP BY ALL) GROUP BY ALL),
renamed AS (SELECT file, old, new FROM pairs WHERE 2 * equal > cells
  QUALIFY row_number() OVER (PARTITION BY file, old ORDER BY equal / cells DESC, equal DESC, new) = 1 AND row_number() OVER (PARTITION BY file, new ORDER BY equal / cells DESC, equal DESC, old) = 1)
SELECT file AS export_file, 'renamed' AS change_kind, old AS field_before, new AS field_after FROM renamed
UNION ALL SELECT file, 'removed', name, '' FROM gone g WHERE NOT EXISTS (FROM renamed r WHERE r.file = g.file AND r.old = g.name)
UNION ALL SELECT file, 'added', '', name FROM come c WHERE NOT EXISTS (FROM renamed r WHERE r.file = c.file AND r.new = c.name)
UNION ALL SELECT n.file, 'retyped', n.name, n.name FROM now n JOIN was w ON n.file = w.file AND n.name = w.name WHERE n.kind <> w.kind""",
    "p4_records": f"""WITH recs AS (
  SELECT recording, export_file, record_json, valid, CASE WHEN valid THEN CAST(record_json AS JSON) END AS j
  FROM (SELECT *, coalesce(CASE WHEN json_valid(record_json) THEN json_type(record_json) = 'OBJECT' END, false) AS valid FROM noise_exports)),
named AS (SELECT *, {', '.join(f'{_first(c, "value")} AS {c}' for c in COLUMNS)}, [{', '.join(_first(c, 'name') for c in COLUMNS)}] AS used FROM recs)
SELECT DISTINCT recording, export_file, CAST(json_extract_string(j, '$.cell_index') AS BIGINT) AS cell_index, valid, {', '.join(COLUMNS)},
  CASE WHEN valid THEN '{{' || array_to_string(list_transform(list_sort(list_filter(json_keys(j), lambda k: k <> 'cell_index' AND NOT coalesce(list_contains(used, k), false))), lambda k: '"' || k || '":' || {_TEXT.format(v="json_extract(j, '$.\"' || k || '\"')")}), ',') || '}}' END AS rescued,
  CASE WHEN NOT valid THEN record_json END AS unread
FROM named""",
}

_PICK = "CAST(max(text) FILTER (col = '{c}') AS {t}) AS {c}"
_CASTABLE = """kind IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'VARCHAR', 'BOOLEAN') AND CASE type WHEN 'BIGINT' THEN TRY_CAST(text AS BIGINT) IS NOT NULL AND TRY_CAST(text AS DOUBLE) = TRY_CAST(text AS BIGINT)
  WHEN 'DOUBLE' THEN TRY_CAST(text AS DOUBLE) IS NOT NULL ELSE text IS NOT NULL END"""
SQL["p4_table"] = f"""WITH RECURSIVE changed AS ({SQL["p4_found"]}),
edges AS (SELECT field_before AS a, field_after AS b FROM changed WHERE change_kind = 'renamed' UNION SELECT field_after, field_before FROM changed WHERE change_kind = 'renamed'),
types AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{_SQL_TYPES[kind]}')" for c, (kind, _) in COLUMNS.items())}) AS t(col, type)),
reach(col, name) AS (SELECT col, col FROM types UNION SELECT r.col, e.b FROM reach r JOIN edges e ON e.a = r.name),
alias AS (SELECT col, type, name, name <> col AS later FROM reach JOIN types USING (col) WHERE name = col OR name IN (SELECT name FROM reach GROUP BY name HAVING count(DISTINCT col) = 1)),
recs AS (
  SELECT row_number() OVER () AS id, *, CASE WHEN valid THEN CAST(record_json AS JSON) END AS j
  FROM (SELECT DISTINCT recording, export_file, record_json, coalesce(CASE WHEN json_valid(record_json) THEN json_type(record_json) = 'OBJECT' END, false) AS valid FROM noise_exports)),
vals AS (SELECT id, name, json_type(j, '$."' || name || '"') AS kind, json_extract_string(j, '$."' || name || '"') AS text FROM (SELECT id, j, unnest(json_keys(j)) AS name FROM recs WHERE valid)),
best AS (SELECT id, col, arg_min(name, (later, name)) AS name, arg_min(text, (later, name)) AS text FROM vals JOIN alias USING (name) WHERE {_CASTABLE} GROUP BY id, col),
wide AS (SELECT id, {', '.join(_PICK.format(c=c, t=_SQL_TYPES[kind]) for c, (kind, _) in COLUMNS.items())}, list(name) AS used FROM best GROUP BY id)
SELECT DISTINCT recording, export_file, CAST(json_extract_string(j, '$.cell_index') AS BIGINT) AS cell_index, valid, {', '.join(COLUMNS)},
  CASE WHEN valid THEN '{{' || array_to_string(list_transform(list_sort(list_filter(json_keys(j), lambda k: k <> 'cell_index' AND NOT coalesce(list_contains(used, k), false))), lambda k: '"' || k || '":' || {_TEXT.format(v="json_extract(j, '$.\"' || k || '\"')")}), ',') || '}}' END AS rescued,
  CASE WHEN NOT valid THEN record_json END AS unread
FROM recs LEFT JOIN wide USING (id)"""
