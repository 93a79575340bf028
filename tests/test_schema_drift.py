import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rfloom.operators import schema_drift as S
from rfloom.plans import core_queries as queries

SCHEMA = "recording string, export_file string, exported_at timestamp, record_json string"


def exports(spark, files, recording="r"):
    rows = [(recording, name, datetime(2024, 1, 1) + timedelta(days=day), x if isinstance(x, (str, type(None))) else json.dumps(x)) for day, (name, records) in enumerate(files) for x in records]
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return {tuple(r) for r in df.select("export_file", "change_kind", "field_before", "field_after").collect()}


def test_every_kind_of_change(spark):
    a = [{"cell_index": i, "radius": i + 0.5, "channel": "red", "old": i, "kind": 1, "gone": [1]} for i in range(4)]
    b = [{"cell_index": i, "rad": i + 0.5, "channel": {"n": "red"}, "new": i + 7, "kind": 1.5 if i == 1 else 1, "fresh": None} for i in range(4)]
    got = found(S.changes(exports(spark, [("a", a + a[:2]), ("b", b)])))
    assert got == {
        ("b", "renamed", "radius", "rad"), ("b", "retyped", "channel", "channel"), ("b", "retyped", "kind", "kind"),
        ("b", "removed", "old", ""), ("b", "removed", "gone", ""), ("b", "added", "", "new"), ("b", "added", "", "fresh"),
    }


def test_broken_null_and_empty(spark):
    a = [{"cell_index": 1, "x": None}, '{"cell_index": 2, "y": 3', None, "[1, 2]", ""]
    b = [{"cell_index": 1, "x": 4}]
    assert found(S.changes(exports(spark, [("a", a), ("b", b)]))) == set()
    assert found(S.changes(exports(spark, [("a", [None]), ("b", b)]))) == {("b", "added", "", "x")}
    assert found(S.changes(spark.createDataFrame([], SCHEMA))) == set()
    assert S.ingest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rename_needs_more_than_half(spark):
    a = [{"cell_index": i, "p": i} for i in range(4)]
    b = [{"cell_index": i, "q": i if i < 2 else -9} for i in range(4)]
    assert found(S.changes(exports(spark, [("a", a), ("b", b)]))) == {("b", "removed", "p", ""), ("b", "added", "", "q")}


def test_names_are_compared_exactly_and_columns_may_clash(spark):
    a, b = [{"cell_index": 1, "Radius": 2.5}], [{"cell_index": 1, "radius": 2.5}]
    rows = exports(spark, [("a", a), ("b", b)]).withColumn("name", F.lit("z")).withColumn("radius", F.lit(1)).withColumn("kind", F.lit("k"))
    assert found(S.changes(rows)) == {("b", "renamed", "Radius", "radius")}


def test_rescue_is_lossless_and_replayed(spark):
    rows = exports(spark, [("a", [{"cell_index": 1, "radius": 2.5, "channel": "red", "time_max": "7.25", "extra": {"k": [1]}}, {"cell_index": 2, "Radius": 3, "quality": None}])])
    got = {r["cell_index"]: r for r in S.ingest(rows).collect()}
    assert got[1]["radius"] == 2.5 and got[1]["time_max"] is None
    assert json.loads(got[1]["rescued"]) == {"time_max": "7.25", "extra": {"k": [1]}}
    assert json.loads(got[2]["rescued"]) == {"Radius": 3, "quality": None}
    promoted = {r["cell_index"]: r for r in S.promote(S.ingest(rows), {"radius": ("double", ["Radius"]), "time_max": ("double", ["time_max"])}).collect()}
    assert promoted[1]["time_max"] == 7.25 and promoted[2]["radius"] == 3.0
    assert json.loads(promoted[1]["rescued"]) == {"extra": {"k": [1]}}


def test_a_point_makes_a_float_and_large_integers_stay_integers(spark):
    a = ['{"cell_index": 1, "x": 120.0, "y": 12, "z": 123456789012345678901234, "u": 0.0, "w": -7.0}']
    b = ['{"cell_index": 1, "x": 120, "y": 12.0, "z": 1, "u": 0, "w": -7.00}']
    assert found(S.changes(exports(spark, [("a", a), ("b", b)]))) == {("b", "retyped", n, n) for n in "xyu"}
    typed = S.ingest(exports(spark, [("a", ['{"cell_index": 1, "radius": 120.0}'])])).first()
    assert typed["radius"] == 120.0 and typed["rescued"] == "{}"


def test_promotion_removes_only_the_name_that_was_used(spark):
    """Two castable names at once, a typed value beside another name, objects and broken numbers."""
    rows = exports(spark, [("a", [{"cell_index": 1, "Radius": 3, "rad": 4}, {"cell_index": 2, "radius": 2.5, "rad": 7}, {"cell_index": 3, "radius": {"val": 1.5}, "n": 2.5, "rad": None}])])
    approved = {"radius": ("double", ["radius", "Radius", "rad"]), "n": ("bigint", ["n"]), "label": ("string", ["radius"])}
    got = {r["cell_index"]: r for r in S.promote(S.ingest(rows), approved).collect()}
    assert got[1]["radius"] == 3.0 and json.loads(got[1]["rescued"]) == {"rad": 4}
    assert got[2]["radius"] == 2.5 and json.loads(got[2]["rescued"]) == {"rad": 7}
    assert got[3]["radius"] is got[3]["n"] is got[3]["label"] is None
    assert json.loads(got[3]["rescued"]) == {"radius": {"val": 1.5}, "n": 2.5, "rad": None}


def test_the_table_keeps_channels_unknown_fields_and_cut_off_records(spark, tmp_path):
    records = [{"cell_index": 1, "chan": 365, "mask_px": 12, "axis_ratio": 0.5, "fresh": [1]}, {"cell_index": 2, "channel": {"nm": 365}, "led": "red"}, '{"cell_index": 3, "rad', None]
    exports(spark, [("a", records)]).write.parquet(f"{tmp_path}/noise_exports.parquet")
    rows = queries.p4_records(spark, str(tmp_path)).collect()
    got = {r["cell_index"]: r for r in rows if r["valid"]}
    assert (got[1]["channel"], got[1]["mask_px"], got[1]["tilt"]) == ("365", 12, 0.5) and json.loads(got[1]["rescued"]) == {"fresh": [1]}
    assert got[2]["channel"] == "red" and json.loads(got[2]["rescued"]) == {"channel": {"nm": 365}}
    assert [r["unread"] for r in rows if not r["valid"] and r["unread"]] == ['{"cell_index": 3, "rad'] and len(rows) == 4


def test_names_follow_the_report_over_several_files(spark):
    value = lambda i: i + 0.5
    steps = [("a", "radius"), ("b", "rad"), ("c", "r_um"), ("d", "radius")]
    changed = S.changes(exports(spark, [(file, [{"cell_index": i, name: value(i), "note": f"{file}{i}"} for i in range(5)]) for file, name in steps]))
    assert S.aliases(changed, ["radius", "note"]) == {"radius": ["radius", "r_um", "rad"], "note": ["note"]}


def test_a_name_that_leads_to_two_columns_is_approved_for_neither(spark):
    changed = spark.createDataFrame([("r", "f", "renamed", "x", "a"), ("r", "g", "renamed", "b", "x"), ("r", "g", "added", "", "q")], "recording string, export_file string, change_kind string, field_before string, field_after string")
    assert S.aliases(changed, ["a", "b", "q"]) == {"a": ["a"], "b": ["b"], "q": ["q"]}
    assert S.aliases(changed.limit(0), ["a"]) == {"a": ["a"]}


def test_the_consolidated_table_learns_new_names(spark, tmp_path):
    first = [{"cell_index": i, "time_max": i + 0.25, "channel": "red"} for i in range(4)]
    second = [{"cell_index": i, "brand_new": i + 0.25, "channel": "red", "extra": {"k": i}} for i in range(4)]
    exports(spark, [("a", first), ("b", [*second, '{"cell_index": 9, "tim'])]).write.parquet(f"{tmp_path}/noise_exports.parquet")
    rows = queries.p4_table(spark, str(tmp_path)).collect()
    assert len(rows) == 9 and {(r["cell_index"], r["time_max"], r["channel"]) for r in rows if r["valid"]} == {(i, i + 0.25, "red") for i in range(4)}
    assert {r["rescued"] for r in rows if r["valid"]} == {"{}", *(f'{{"extra":{{"k":{i}}}}}' for i in range(4))}
    assert [r["unread"] for r in rows if not r["valid"]] == ['{"cell_index": 9, "tim']
