"""Irregular readings onto a regular grid.

Consecutive usable readings of a source bound an interval; the increment over
it (for counters after detecting resets) is distributed over the grid cells it
overlaps, in proportion to the overlap. Cells inside an interval that hold no
reading of their own are uncovered: they are marked and get the level that the
distributed increments reach at the cell's centre.

A source may be arbitrarily long: it is cut into chunks of ``chunk`` grid
steps and chunks are linked by their first and last readings. The readings of
a chunk travel as one array and are laid on its cells inside the row, so cells
are never shuffled; chunks with very many readings (a count decides) are
sorted by windows instead, which spill. Gaps between chunks are one row each
until Spark expands them.

Defined results: readings with null or non-finite time or value, or so far off
that their step isn't a whole number any more (2^53 steps), are unusable; a
missing step is taken from the source's other rows; a source without a positive
finite step, or without usable readings, has no grid; repeated rows count once;
of several values at one time the largest is used; null keys form a source of
their own; an empty table gives an empty grid; further columns are ignored, whatever their
names; keys may not be called like the result's columns. A gap of more than
``max_gap`` steps (a broken clock: a thousand million by default) isn't
expanded; ``gaps`` lists it like every other one, with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rfloom.tables import finite, join_same, written

#: Grid steps that one row of a gap is expanded into at a time.
_BLOCK = 4096
#: Cells that are computed at a time inside a task.
_CELLS = 500_000
MAX_GAP = 1_000_000_000


def usable_readings(readings: DataFrame, keys: list[str], time: str, value: str, step: str) -> DataFrame:
    """Columns keys, t, v, step of usable readings; a null step is looked up in the source's other rows."""
    good_step = F.when(finite(F.col(step)) & (F.col(step) > 0), F.col(step).cast("double"))
    rows = readings.select(*keys, F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("v"), good_step.alias("step"))
    usable = rows.where(finite(F.col("t")) & finite(F.col("v")))
    steps = rows.where("step is not null").groupBy(*keys).agg(F.max("step").alias("known"))
    lost = usable.where("step is null").drop("step")
    looked_up = join_same(lost, steps, keys).select(*keys, "t", "v", F.col("known").alias("step"))
    known = usable.where("step is not null").unionByName(looked_up)
    return known.where(F.abs(F.col("t") / F.col("step")) < 2.0**53)


def slot_of(t: Column, step: Column) -> Column:
    return F.floor(t / step + F.lit(0.5)).cast("bigint")


def _chunked(readings: DataFrame, keys: list[str], time: str, value: str, step: str, chunk: int) -> DataFrame:
    """key (struct, so that null equals null in joins), chunk, step, t, v."""
    usable = usable_readings(readings, keys, time, value, step)
    return usable.select(F.struct(*keys).alias("key"), F.floor(slot_of(F.col("t"), F.col("step")) / chunk).alias("chunk"), "step", "t", "v").where("chunk is not null")


def _series(chunked: DataFrame) -> DataFrame:
    """key, chunk, step, a: the readings of each chunk as an array (t, v) in the order of time."""
    sets = chunked.groupBy("key", "chunk").agg(F.array_sort(F.collect_set(F.struct("t", "v"))).alias("all"), F.max("step").alias("step"))
    # of equal times only the last (the largest value) stays
    after = F.slice("all", F.lit(2), F.size("all"))
    kept = F.transform(F.filter(F.zip_with("all", after, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["b"].isNull() | (p["a"]["t"] != p["b"]["t"])), lambda p: p["a"])
    return sets.select("key", "chunk", "step", kept.alias("a"))


def _once(chunked: DataFrame) -> DataFrame:
    return chunked.groupBy("key", "chunk", "t").agg(F.max("v").alias("v"), F.max("step").alias("step"))


def _linked(ends: DataFrame) -> DataFrame:
    """Chunks (key, chunk, step, first, last) with the reading before (``prev``) and after (``next``) them."""
    order = Window.partitionBy("key").orderBy("chunk")
    return ends.withColumn("prev", F.lag("last").over(order)).withColumn("next", F.lead("first").over(order))


def _parts(readings: DataFrame, keys: list[str], time: str, value: str, step: str, chunk: int, crowded: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(series of calm chunks, distinct readings of crowded chunks or None, links of all chunks)."""
    chunked = _chunked(readings, keys, time, value, step, chunk)
    full = chunked.groupBy("key", "chunk").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("key", "chunk")
    ends = lambda rows: rows.select("key", "chunk", "step", F.element_at("a", 1).alias("first"), F.element_at("a", -1).alias("last"))
    if not full.take(1):
        series = _series(chunked)
        return series, None, _linked(ends(series))
    full = written(full, "crowded")
    series, once = _series(chunked.join(full, ["key", "chunk"], "left_anti")), _once(chunked.join(full, ["key", "chunk"], "left_semi"))
    here = F.struct("t", "v")
    return series, once, _linked(ends(series).unionByName(once.groupBy("key", "chunk").agg(F.max("step").alias("step"), F.min(here).alias("first"), F.max(here).alias("last"))))


def _increment(v: Column, before: Column, counter: bool) -> Column:
    """The change; for a counter a fall is a reset and the new level is the increment."""
    return F.when(v < before, v).otherwise(v - before) if counter else v - before


def intervals(readings: DataFrame, keys: list[str], time: str, value: str, step: str, counter: bool = False, chunk: int = 4096, crowded: int = 200_000) -> DataFrame:
    """One row per distinct usable reading with its predecessor (null for a source's first).

    Columns: keys, step, slot, t, v, prev_slot, prev_t, prev_v, increment. Chunks
    with more than ``crowded`` readings aren't collected but sorted by windows.
    """
    series, once, links = _parts(readings, keys, time, value, step, chunk, crowded)
    pairs = F.zip_with(F.slice("a", F.lit(1), F.greatest(F.size("a") - 1, F.lit(0))), F.slice("a", F.lit(2), F.size("a")), lambda p, q: F.struct(q["t"].alias("t"), q["v"].alias("v"), p.alias("prev")))
    rows = links.select("key", "step", "first.t", "first.v", "prev").unionByName(series.select("key", "step", F.inline(pairs)))
    if once is not None:
        rows = rows.unionByName(_within(once).select("key", "step", "t", "v", "prev"))
    return rows.select(
        "key.*", "step", slot_of(F.col("t"), F.col("step")).alias("slot"), "t", "v", slot_of(F.col("prev.t"), F.col("step")).alias("prev_slot"),
        F.col("prev.t").alias("prev_t"), F.col("prev.v").alias("prev_v"), _increment(F.col("v"), F.col("prev.v"), counter).alias("increment"),
    )


def _within(once: DataFrame) -> DataFrame:
    """Readings of crowded chunks with their predecessor in the chunk."""
    order = Window.partitionBy("key", "chunk").orderBy("t")
    return once.withColumn("prev", F.lag(F.struct("t", "v")).over(order)).where("prev is not null")


def _expanded(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Each row once per grid step from low to high, in blocks, so that no gap makes one huge array."""
    blocks = rows.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    blocks = blocks.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_high") - F.col("_low")) / _BLOCK))))
    start = F.col("_low") + F.col("_block") * _BLOCK
    return blocks.withColumn("_cell", F.explode(F.sequence(start, F.least(F.col("_high"), start + (_BLOCK - 1))))).drop("_low", "_high", "_block")


def gaps(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first_slot, last_slot, steps of every run of uncovered grid steps, whatever its length."""
    found = spans.where("slot - prev_slot > 1")
    return found.select(*keys, (F.col("prev_slot") + 1).alias("first_slot"), (F.col("slot") - 1).alias("last_slot"), (F.col("slot") - F.col("prev_slot") - 1).alias("steps"))


def uncovered(spans: DataFrame, keys: list[str], max_gap: int = MAX_GAP) -> DataFrame:
    """Grid steps strictly inside an interval: no reading of the source falls on them."""
    found = gaps(spans, keys).where(F.col("steps") <= max_gap)
    return _expanded(found, F.col("first_slot"), F.col("last_slot")).select(*keys, F.col("_cell").alias("slot"))


def _laid(key: pa.Array, step: np.ndarray, lists: pa.Array, prev: pa.Array, next_: pa.Array, counter: bool) -> pa.RecordBatch:
    """The cells from the first to the last reading of each chunk: key, slot, grid_time, value, increment, filled."""
    n, sizes = len(step), np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    own_t, own_v = flat.field("t").to_numpy(), flat.field("v").to_numpy()
    has_prev, has_next = (~np.asarray(x.is_null().to_numpy(zero_copy_only=False), bool) for x in (prev, next_))
    side = lambda x, name: x.field(name).to_numpy(zero_copy_only=False).astype(float)
    # every chunk as one run: the reading before it, its own, the reading after it
    total = sizes + has_prev + has_next
    start = np.cumsum(total) - total
    t, v, row = np.empty(total.sum()), np.empty(total.sum()), np.repeat(np.arange(n), total)
    mine = np.ones(len(t), bool)
    for mask, at, struct in ((has_prev, start, prev), (has_next, start + total - 1, next_)):
        t[at[mask]], v[at[mask]], mine[at[mask]] = side(struct, "t")[mask], side(struct, "v")[mask], False
    t[mine], v[mine] = own_t, own_v
    slot = np.floor(t / step[row] + 0.5).astype(np.int64)
    first = start + has_prev
    low, high = slot[first], slot[first + sizes - 1]
    width = high - low + 1
    base = np.cumsum(width) - width
    cell_row = np.repeat(np.arange(n), width)
    cell = np.arange(width.sum()) - base[cell_row] + low[cell_row]
    centre = cell * step[cell_row]
    # intervals between neighbours of a run, on the cells of the chunk that they touch
    left = np.nonzero(row[1:] == row[:-1])[0]
    right = left + 1
    change = v[right] - v[left]
    reset = (change < 0) & counter
    change = np.where(reset, v[right], change)
    level = np.where(reset, 0.0, v[left])
    r = row[left]
    from_, to = np.maximum(slot[left], low[r]), np.minimum(slot[right], high[r])
    touched = np.maximum(to - from_ + 1, 0)
    of = np.repeat(np.arange(len(left)), touched)
    number = np.arange(touched.sum()) - np.repeat(np.cumsum(touched) - touched, touched) + from_[of]
    out = base[r[of]] + number - low[r[of]]
    half, middle, t0, t1 = step[r[of]] / 2, centre[out], t[left][of], t[right][of]
    share = change[of] * np.maximum(np.minimum(t1, middle + half) - np.maximum(t0, middle - half), 0.0) / (t1 - t0)
    increment = np.bincount(out, weights=share, minlength=len(cell)).astype(float)  # integers if there are no intervals
    inner = (number > slot[left][of]) & (number < slot[right][of])
    value = np.full(len(cell), np.nan)
    value[out[inner]] = (level[of] + change[of] * (middle - t0) / (t1 - t0))[inner]
    # a cell's own reading nearest to its centre comes first
    at = base[row[mine]] + slot[mine] - low[row[mine]]
    order = np.lexsort((own_v, own_t, np.abs(own_t - centre[at]), at))
    chosen = order[np.nonzero(np.diff(at[order], prepend=-1))[0]]
    filled = np.ones(len(cell), bool)
    value[at[chosen]], filled[at[chosen]] = own_v[chosen], False
    return pa.RecordBatch.from_arrays([key.take(pa.array(cell_row)), pa.array(cell), pa.array(centre), pa.array(value), pa.array(increment), pa.array(np.where(filled, "filled", "observed"))], ["key", "slot", "grid_time", "value", "increment", "status"])


def _on_cells(linked: DataFrame, counter: bool) -> DataFrame:
    """key, slot, grid_time, value, increment, status of the cells inside calm chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            step, span = batch["step"].to_numpy(), batch["span"].to_numpy()
            cuts = [0, *(np.nonzero(np.diff(np.cumsum(span) // _CELLS))[0] + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                # pa.concat_arrays copies a slice, so that its buffers start at its own first row
                own = {name: pa.concat_arrays([part[name]]) for name in ("key", "a", "prev", "next")}
                yield _laid(own["key"], step[a:b], own["a"], own["prev"], own["next"], counter)

    span = slot_of(F.element_at("a", -1)["t"], F.col("step")) - slot_of(F.element_at("a", 1)["t"], F.col("step")) + 1
    kind = linked.schema["key"].dataType.simpleString()
    return linked.select("key", "step", "a", "prev", "next", span.alias("span")).mapInArrow(run, f"key {kind}, slot bigint, grid_time double, value double, increment double, status string")


def _crowded_cells(once: DataFrame, links: DataFrame, counter: bool) -> DataFrame:
    """The same for crowded chunks: their intervals are expanded and the shares summed by Spark."""
    inside = _within(once).withColumns({"low": slot_of(F.col("prev.t"), F.col("step")), "high": slot_of(F.col("t"), F.col("step"))})
    own = links.join(once.select("key", "chunk").distinct(), ["key", "chunk"], "left_semi")
    before = own.select("key", "chunk", F.col("first.t").alias("t"), F.col("first.v").alias("v"), "step", "prev", slot_of(F.col("first.t"), F.col("step")).alias("low"))
    behind = own.where("next is not null").select("key", "chunk", F.col("next.t").alias("t"), F.col("next.v").alias("v"), "step", F.col("last").alias("prev"), slot_of(F.col("last.t"), F.col("step")).alias("low"))
    spans = inside.unionByName(before.withColumn("high", F.col("low"))).unionByName(behind.withColumn("high", F.col("low")))
    cells = _expanded(spans, F.col("low"), F.col("high"))
    centre, slot, prev_slot = F.col("_cell") * F.col("step"), slot_of(F.col("t"), F.col("step")), slot_of(F.col("prev.t"), F.col("step"))
    change = _increment(F.col("v"), F.col("prev.v"), counter)
    level = F.when(F.col("v") - F.col("prev.v") == change, F.col("prev.v")).otherwise(F.lit(0.0))
    overlap = F.greatest(F.least("t", centre + F.col("step") / 2) - F.greatest("prev.t", centre - F.col("step") / 2), F.lit(0.0))
    length = F.nullif(F.col("t") - F.col("prev.t"), F.lit(0.0))
    parts = cells.select(
        "key", F.col("_cell").alias("slot"), centre.alias("grid_time"), F.coalesce(change * overlap / length, F.lit(0.0)).alias("share"),
        F.when(F.col("_cell") == slot, F.struct(F.abs(F.col("t") - centre).alias("far"), "t", "v")).alias("near"),
        F.when((F.col("_cell") > prev_slot) & (F.col("_cell") < slot), level + change * (centre - F.col("prev.t")) / length).alias("level"),
    )
    sums = parts.groupBy("key", "slot").agg(F.max("grid_time").alias("grid_time"), F.sum("share").alias("increment"), F.min("near").alias("near"), F.max("level").alias("level"))
    return sums.select("key", "slot", "grid_time", F.coalesce("near.v", "level").alias("value"), "increment", F.when(F.col("near").isNull(), "filled").otherwise("observed").alias("status"))


def regular_grid(readings: DataFrame, keys: list[str], time: str, value: str, step: str, counter: bool = False, chunk: int = 4096, crowded: int = 200_000, max_gap: int = MAX_GAP) -> DataFrame:
    """The regular series: keys, slot, grid_time, value, increment, status ('observed' or 'filled').

    An observed step has the reading nearest to its centre (ties: the earlier
    one); a filled step the level reached by then. For counters the value of a
    filled step after a reset counts from zero.
    """
    series, once, links = _parts(readings, keys, time, value, step, chunk, crowded)
    # both sides take the same columns from the shuffled readings, so that Spark shuffles them once and uses that twice
    joined = series.join(links.select("key", "chunk", "prev", "next", F.col("step").alias("same_step")), ["key", "chunk"])
    cells = _on_cells(joined.withColumn("step", F.coalesce("step", "same_step")), counter)
    if once is not None:
        cells = cells.unionByName(_crowded_cells(once, links, counter))
    # between chunks: whole cells of one interval, all uncovered
    before, first = slot_of(F.col("prev.t"), F.col("step")), slot_of(F.col("first.t"), F.col("step"))
    open_ = links.where(first - before - 1 <= max_gap)
    between = _expanded(open_, before + 1, first - 1)
    change, length = _increment(F.col("first.v"), F.col("prev.v"), counter), F.col("first.t") - F.col("prev.t")
    level = F.when(change == F.col("first.v") - F.col("prev.v"), F.col("prev.v")).otherwise(F.lit(0.0))
    centre = F.col("_cell") * F.col("step")
    filled = between.select(
        "key", F.col("_cell").alias("slot"), centre.alias("grid_time"), (level + change * (centre - F.col("prev.t")) / length).alias("value"),
        (change * F.col("step") / length).alias("increment"), F.lit("filled").alias("status"),
    )
    return cells.unionByName(filled).select("key.*", "slot", "grid_time", "value", "increment", "status")
