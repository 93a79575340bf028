"""Rescue-column ingestion of records whose fields drift, and a report of every change.

``ingest`` enforces a target schema: a field of exactly the wanted JSON kind
goes to its typed column; everything else (unknown names, other kinds, nulls)
stays as JSON in ``rescued``, so nothing is lost. ``promote`` replays rescued
values of approved names into typed columns. ``changes`` compares each file
with the one before it in its recording.

All stages are keyed by (file, field) or (file, cell) and combine map-side; a
recording with a third of all rows is only a longer list of files.

Defined results: null, cut-off or non-object records are kept by ``ingest`` with
``valid`` false and have no fields; a field that is null throughout a file has
no type, so it isn't ``retyped``; mixed kinds other than integer and float make
the type ``mixed``; a file without valid records has no fields; repeated records
count once; an empty table gives no changes; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rfloom.tables import written

FILE = ["recording", "export_file", "exported_at"]
#: Target column -> (JSON kind, SQL type).
TARGET = {"channel": ("string", "string"), "time_max": ("float", "double"), "radius": ("float", "double"), "quality": ("float", "double")}


def kind_of(value: Column) -> Column:
    """JSON kind of a variant; null for JSON null."""
    name = F.schema_of_variant(value)
    # a variant forgets the zeros of 120.0; but whole numbers written without a point are BIGINT, unless they are too large for it
    whole = name.startswith("DECIMAL") & name.endswith(",0)") & (F.abs(F.try_variant_get(value, "$", "double")) >= 2.0**63)
    return (
        F.when(name == "STRING", "string")
        .when((name == "BIGINT") | whole, "integer")
        .when(name.startswith("DECIMAL") | (name == "DOUBLE"), "float")
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "BOOLEAN", "boolean")
    )


def _read(records: DataFrame, target: dict[str, tuple[str, str]]) -> DataFrame:
    """FILE columns, cell_index, valid, one typed column per target field, rest (map of what isn't typed), unread. Each record is parsed once."""
    parsed = records.select(*FILE, F.try_parse_json("record_json").alias("record"), F.col("record_json").alias("unread"))
    valid = F.coalesce(F.schema_of_variant("record").startswith("OBJECT"), F.lit(False))
    parsed = parsed.withColumn("valid", valid).withColumn("record", F.when(F.col("valid"), F.col("record"))).withColumn("unread", F.when(~F.col("valid"), F.col("unread")))
    parsed = parsed.withColumn("cell_index", F.try_variant_get("record", "$.cell_index", "bigint"))
    typed = {name: F.when(kind_of(F.variant_get("record", f"$.{name}", "variant")) == kind, F.try_variant_get("record", f"$.{name}", sql)) for name, (kind, sql) in target.items()}
    rows = parsed.withColumns(typed)
    kept = F.array(F.lit("cell_index"), *[F.when(F.col(name).isNotNull(), name) for name in target])
    rest = F.map_filter(F.col("record").cast("map<string,variant>"), lambda name, _: ~F.coalesce(F.array_contains(kept, name), F.lit(False)))
    return rows.select(*FILE, "cell_index", "valid", *target, rest.alias("rest"), "unread")


def ingest(records: DataFrame, target: dict[str, tuple[str, str]] = TARGET) -> DataFrame:
    """FILE columns, cell_index, valid, one typed column per target field, ``rescued`` (JSON), ``rescued_kinds`` (name -> kind as written; the JSON text of 120.0 is 120), ``unread`` (the text of a record that isn't valid)."""
    kinds = F.transform_values("rest", lambda _, v: kind_of(v))
    return _read(records, target).select(*FILE, "cell_index", "valid", *target, F.to_json("rest").alias("rescued"), kinds.alias("rescued_kinds"), "unread")


def fields(records: DataFrame, target: dict[str, tuple[str, str]] = TARGET) -> DataFrame:
    """One row per (record, field), typed and rescued alike: FILE, cell_index, name, kind, value (comparable text)."""
    none, no_text = F.lit(None).cast("variant"), F.lit(None).cast("string")
    typed = [F.struct(F.lit(n).alias("name"), none.alias("v"), F.lit(kind).alias("typed_kind"), F.concat(F.lit("s" if kind == "string" else "n"), F.col(n).cast("string")).alias("typed_value")) for n, (kind, _) in target.items()]
    rescued = F.transform(F.map_entries("rest"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("v"), no_text.alias("typed_kind"), no_text.alias("typed_value")))
    typed_here = F.filter(F.array(*typed), lambda f: f["typed_value"].isNotNull())
    rows = _read(records, target).where("valid").select(*FILE, "cell_index", F.inline(F.concat(typed_here, rescued)))
    rows = rows.withColumn("kind", F.coalesce("typed_kind", kind_of(F.col("v"))))
    number, text = F.try_variant_get("v", "$", "double").cast("string"), F.try_variant_get("v", "$", "string")
    value = F.when(F.col("kind").isin("integer", "float"), F.concat(F.lit("n"), number)).when(F.col("kind") == "string", F.concat(F.lit("s"), text)).when(F.col("kind").isNotNull(), F.concat(F.lit("j"), F.to_json("v")))
    return rows.select(*FILE, "cell_index", "name", "kind", F.coalesce("typed_value", value).alias("value"))


_KINDS = ("string", "integer", "float", "object", "array", "boolean")


def _kind(seen: Column) -> Column:
    """The type of a field from the kinds of its values (an array of them)."""
    has = {k: F.array_contains(seen, k) for k in _KINDS}
    count = sum((has[k].cast("int") for k in ("string", "object", "array", "boolean")), (has["integer"] | has["float"]).cast("int"))
    kind = F.when(count > 1, "mixed").when(has["float"], "float")
    for k in ("string", "integer", "object", "array", "boolean"):
        kind = kind.when(has[k], k)
    return kind


def _compared(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """recording, before, after, name, state ('gone', 'come', 'retyped' or 'kept') of every field of every step: one aggregate."""
    named = rows.groupBy("recording", "export_file", "name").agg(_kind(F.collect_set("kind")).alias("kind"))
    sides = [steps.select("recording", F.col(side).alias("export_file"), "before", "after", F.lit(side).alias("side")) for side in ("before", "after")]
    both = named.join(sides[0].unionByName(sides[1]), ["recording", "export_file"])
    found = both.groupBy("recording", "before", "after", "name").agg(
        *[F.coalesce(F.bool_or(F.col("side") == side), F.lit(False)).alias(f"in_{side}") for side in ("before", "after")],
        *[F.max(F.when(F.col("side") == side, F.col("kind"))).alias(f"kind_{side}") for side in ("before", "after")],
    )
    state = F.when(~F.col("in_after"), "gone").when(~F.col("in_before"), "come").when(F.col("kind_before") != F.col("kind_after"), "retyped").otherwise("kept")
    return found.select("recording", "before", "after", "name", state.alias("state"))


def _renamed(rows: DataFrame, compared: DataFrame) -> DataFrame:
    """recording, before, after, field_before, field_after: gone and new names with equal values in more than half of the cells; of several the likest.

    The values of one cell on both sides of a step meet in one row: as many as it has gone and new fields.
    """
    moved = compared.where("state in ('gone', 'come')").withColumn("export_file", F.when(F.col("state") == "gone", F.col("before")).otherwise(F.col("after")))
    values = rows.where("value is not null and cell_index is not null").select("recording", "export_file", "name", "cell_index", "value")
    met = values.join(moved, ["recording", "export_file", "name"]).groupBy("recording", "before", "after", "cell_index").agg(F.collect_set(F.struct("state", "name", "value")).alias("all"))
    of = lambda state: F.filter("all", lambda f: f["state"] == state)
    crossed = met.select("recording", "before", "after", "cell_index", of("gone").alias("gone"), of("come").alias("come")).where((F.size("gone") > 0) & (F.size("come") > 0))
    crossed = crossed.select("recording", "before", "after", "cell_index", F.explode("gone").alias("g"), "come").select("recording", "before", "after", "cell_index", "g", F.explode("come").alias("c"))
    cells = crossed.groupBy("recording", "before", "after", "cell_index", F.col("g.name").alias("field_before"), F.col("c.name").alias("field_after")).agg(F.bool_or(F.col("g.value") == F.col("c.value")).alias("same"))
    step = ["recording", "before", "after"]
    best = cells.groupBy(*step, "field_before", "field_after").agg(F.count("*").alias("cells"), F.count_if("same").alias("equal")).where("2 * equal > cells").withColumn("share", F.col("equal") / F.col("cells"))
    for one, other in (("field_before", "field_after"), ("field_after", "field_before")):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*step, one).orderBy(F.desc("share"), F.desc("equal"), other))).where("rank = 1").drop("rank")
    return best.select(*step, "field_before", "field_after")


def changes(records: DataFrame, target: dict[str, tuple[str, str]] = TARGET) -> DataFrame:
    """recording, export_file, change_kind, field_before, field_after of every change against the previous file."""
    rows = written(fields(records, target), "fields")
    files = records.groupBy("recording", "export_file").agg(F.min("exported_at").alias("exported_at"))
    order = Window.partitionBy("recording").orderBy("exported_at", "export_file")
    steps = files.select("recording", F.col("export_file").alias("after"), F.lag("export_file").over(order).alias("before")).where("before is not null")
    compared = written(_compared(rows, steps).where("state <> 'kept'"), "compared")
    renamed = written(_renamed(rows, compared), "renamed")
    # a gone and a new name that were found to be one field are one change
    taken = renamed.select("recording", "after", F.explode(F.array(F.struct(F.lit("gone").alias("state"), F.col("field_before").alias("name")), F.struct(F.lit("come").alias("state"), F.col("field_after").alias("name")))).alias("t")).select("recording", "after", "t.state", "t.name")
    alone = compared.join(taken, ["recording", "after", "state", "name"], "left_anti")
    kind = F.when(F.col("state") == "gone", "removed").when(F.col("state") == "come", "added").otherwise("retyped")
    others = alone.select("recording", F.col("after").alias("export_file"), kind.alias("change_kind"), F.when(F.col("state") != "come", F.col("name")).otherwise("").alias("field_before"), F.when(F.col("state") != "gone", F.col("name")).otherwise("").alias("field_after"))
    return others.unionByName(renamed.select("recording", F.col("after").alias("export_file"), F.lit("renamed").alias("change_kind"), "field_before", "field_after"))


def aliases(changed: DataFrame, columns: list[str], most_names: int = 10_000) -> dict[str, list[str]]:
    """Names that each of ``columns`` goes by: itself, then what the ``renamed`` rows of ``changes`` lead to and from, over all files, in order of name.

    Names linked with several columns are approved for none of them but stay
    rescued. Only distinct pairs of names reach the driver; there are as many
    as a schema has fields, and more than ``most_names`` is an error.
    """
    pairs = changed.where("change_kind = 'renamed'").select("field_before", "field_after").distinct().limit(most_names + 1).collect()
    if len(pairs) > most_names:
        raise ValueError(f"more than {most_names} renamings: these are no field names")
    near: dict[str, set[str]] = {}
    for before, after in pairs:
        near.setdefault(before, set()).add(after)
        near.setdefault(after, set()).add(before)
    reached: dict[str, set[str]] = {}
    for column in columns:
        seen, waiting = {column}, [column]
        while waiting:
            new = near.get(waiting.pop(), set()) - seen
            seen |= new
            waiting += new
        reached[column] = seen
    owners: dict[str, int] = {}
    for seen in reached.values():
        for name in seen:
            owners[name] = owners.get(name, 0) + 1
    return {column: [column, *sorted(name for name in seen - {column} if owners[name] == 1)] for column, seen in reached.items()}


def _scalar(value: Column, sql: str) -> Column:
    """A scalar variant as ``sql``; null where the cast would lose something (objects and arrays, broken numbers as whole ones)."""
    cast = F.try_variant_get(value, "$", sql)
    whole = F.try_variant_get(value, "$", "double") == cast.cast("double") if sql in ("int", "bigint") else F.lit(True)
    return F.when(~kind_of(value).isin("object", "array") & whole, cast)


def promote(ingested: DataFrame, approved: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Replays rescued values into typed columns.

    ``approved``: column -> (SQL type, names it goes by, best first). A typed
    value stays; the first approved name whose rescued value is a scalar that can
    be cast fills a null. Only this name leaves ``rescued``: what can't be cast,
    or isn't needed as another value was first, stays there.
    """
    rows = ingested.withColumn("rest", F.try_parse_json("rescued").cast("map<string,variant>"))

    def first(sql: str, names: list[str]) -> Column:
        """struct(name, value) of the best name that has a value; as an array function, so that code doesn't grow with the names."""
        values = F.transform(F.array(*map(F.lit, names)), lambda n: F.struct(n.alias("name"), _scalar(F.try_element_at("rest", n), sql).alias("value")))
        return F.get(F.filter(values, lambda p: p["value"].isNotNull()), F.lit(0))

    have = {column: F.col(column) if column in ingested.columns else F.lit(None).cast(sql) for column, (sql, _) in approved.items()}
    rows = rows.withColumn("used", F.struct(*[F.when(have[column].isNull(), first(*how)).alias(column) for column, how in approved.items()]))
    left = F.map_filter("rest", lambda name, _: ~F.coalesce(F.array_contains(F.array(*[F.col("used")[c]["name"] for c in approved]), name), F.lit(False)))
    filled = {column: F.coalesce(have[column], F.col("used")[column]["value"]) for column in approved}
    return rows.withColumns({**filled, "rescued": F.to_json(left)}).drop("rest", "used")
