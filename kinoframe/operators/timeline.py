"""Timestamps over time: repair, discontinuities, shared origins, cuts and progress.

Folds that have a closed form are windows; those that have none are folds over cells of a stream (``scans.scanned``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinoframe.functions.rational import rescale
from kinoframe.operators.mux import Steps, Written, repaired
from kinoframe.operators.scan import STREAM, ordered, upto
from kinoframe.operators.scans import CELL, same, scanned
from kinoframe.scratch import cut


def monotone_dts(packets: DataFrame, strict: bool = True, cell: int = 1 << 20) -> DataFrame:
    """``dts`` made increasing (or non-decreasing) in packet order, pts lifted to it; a missing dts stays missing, and what
    follows it begins anew.

    Strict: each is at least its predecessor plus one, which is the running maximum of dts less its rank, plus the rank.
    Ranks and maxima are taken in cells of ``cell`` sequence numbers and carried on from cell to cell, so that a long stream
    is not one task.
    """
    lost = F.col("dts").isNull().cast("int")
    rows = packets.withColumn("_cell", F.call_function("div", "seq", F.lit(cell)))
    own = Window.partitionBy(STREAM, "_cell").orderBy("seq")
    rows = rows.withColumn("_run", F.sum(lost).over(upto(own)))
    run = Window.partitionBy(STREAM, "_cell", "_run").orderBy("seq")
    rows = rows.withColumn("_rank", F.row_number().over(run) if strict else F.lit(0)).withColumn("_top", F.max(F.col("dts") - F.col("_rank")).over(upto(run)))
    ends = rows.groupBy(STREAM, "_cell").agg(F.max("_run").alias("_runs"), F.max_by(F.struct(F.col("_rank").alias("n"), F.col("_top").alias("most")), "seq").alias("_end"))
    # what a cell leaves lasts as far as the next cell with a packet without dts
    w = Window.partitionBy(STREAM).orderBy("_cell")
    ends = ends.withColumn("_stretch", F.sum((F.col("_runs") > 0).cast("int")).over(upto(w)))
    each = Window.partitionBy(STREAM, "_stretch").orderBy("_cell")
    ends = ends.withColumn("_total", F.sum("_end.n").over(upto(each)))
    ends = ends.withColumn("_left", F.max(F.col("_end.most") - F.col("_total") + F.col("_end.n")).over(upto(each)) + F.col("_total"))
    ends = ends.select(F.col(STREAM).alias("_stream"), F.col("_cell").alias("_at"), F.lag("_left").over(w).alias("_past"))
    out = rows.join(ends, rows[STREAM].eqNullSafe(ends["_stream"]) & rows["_cell"].eqNullSafe(ends["_at"]))
    fixed = F.greatest(F.when(F.col("_run") == 0, F.col("_past")), F.col("_top")) + F.col("_rank")
    out = out.withColumn("out_dts", F.when(F.col("dts").isNotNull(), fixed).cast("long")).withColumn("out_pts", F.when(F.col("pts").isNotNull(), F.greatest("pts", "out_dts")).cast("long"))
    return out.drop("_cell", "_run", "_rank", "_top", "_stream", "_at", "_past")


def guessed_dts(packets: DataFrame, cell: int = CELL) -> DataFrame:
    """Where dts lies after pts, both become the median of pts, dts and the place after the dts written last; nothing else is
    repaired."""
    rows = packets.withColumn("_timed", F.lit(False)).withColumn("_strict", F.lit(False))
    return scanned(rows, [STREAM], ["pts", "dts", "_timed", "_strict"], Written, repaired, "out_pts long, out_dts long", cell=cell, carry=Steps).drop("_timed", "_strict")


def violations(packets: DataFrame) -> DataFrame:
    """Packets that break the contract of a strict sink: dts after pts, dts not increasing, a pts seen before."""
    again = F.row_number().over(Window.partitionBy(STREAM, "pts").orderBy("seq")) > 1
    marked = packets.withColumn("late_pts", F.col("pts") < F.col("dts")).withColumn("dts_back", F.coalesce(F.col("dts") <= F.lag("dts").over(ordered()), F.lit(False))).withColumn("pts_again", again)
    return marked.where("late_pts or dts_back or pts_again")


def discontinuities(packets: DataFrame, forward_us: int = 10_000_000, back_us: int = 100_000) -> DataFrame:
    """Packets after a jump forward of more than ``forward_us`` or back of more than ``back_us``, with the running offset
    that takes all jumps so far out again."""
    delta = F.col("pts_us") - F.lag("pts_us").over(ordered())
    jump = F.when((delta > forward_us) | (delta < -back_us), delta).otherwise(0)
    return packets.withColumn("jump_us", F.coalesce(jump, F.lit(0))).withColumn("offset_us", -F.sum("jump_us").over(upto(ordered())))


def start_offsets(packets: DataFrame) -> DataFrame:
    """Each asset's packets moved so that its earliest stream starts at zero."""
    # a partial aggregate and a join, not a window: an asset's packets need not meet in one task
    first = packets.groupBy("asset_id").agg(F.min("pts_us").alias("_first"))
    return packets.join(first, "asset_id").withColumn("out_us", F.col("pts_us") - F.col("_first")).drop("_first")


def filled_pts(packets: DataFrame) -> DataFrame:
    """Missing stamps extrapolated: the last one plus the last step (at least 1) for each missing one since.

    The step is that between the last two real stamps; a stream that begins without stamps counts up from zero.
    """
    w = upto(ordered())
    real = F.col("pts_us").isNotNull()
    rows = packets.withColumn("_known", F.last("pts_us", ignorenulls=True).over(w))
    rows = rows.withColumn("_island", F.sum(real.cast("int")).over(w))
    before = F.last("pts_us", ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_delta", F.when(real, F.col("pts_us") - before))
    step = F.greatest(F.coalesce(F.last("_delta", ignorenulls=True).over(w), F.lit(1)), F.lit(1))
    run = F.row_number().over(Window.partitionBy(STREAM, "_island").orderBy("seq"))
    rows = rows.withColumn("_step", step).withColumn("_run", run)
    none = F.col("_known").isNull()
    out = F.when(real, F.col("pts_us")).when(none, F.col("_run") - 1).otherwise(F.col("_known") + (F.col("_run") - 1) * F.col("_step"))
    return rows.withColumn("out_us", out.cast("long")).drop("_known", "_island", "_delta", "_step", "_run")


def shared_origin(packets: DataFrame, bases: DataFrame) -> DataFrame:
    """Stamps less a shared origin, the first delivered dts of the asset, in each stream's own ticks.

    ``bases``: (stream_index, num, den), a row a stream.
    """
    rows = packets.join(bases, STREAM)
    first = rows.groupBy("asset_id").agg(F.min(F.struct("seq", "dts", "num", "den")).alias("o")).select("asset_id", "o.dts", "o.num", "o.den").toDF("asset_id", "o_dts", "o_num", "o_den")
    rows = rows.join(first, "asset_id")
    origin = rescale(F.col("o_dts"), F.col("o_num").cast("long") * F.col("den"), F.col("o_den").cast("long") * F.col("num"))
    return rows.withColumn("out_dts", F.col("dts") - origin).drop("o_dts", "o_num", "o_den")


def spread(rows: DataFrame, value: str, cells: int = 1024) -> Column:
    """The cell of a value: ranges with about as many rows each, so that outliers do not gather the rest in one; null is cell -1.

    Bounds are quantiles within a hundredth of a cell's rows, found in two levels of 32.
    """
    side = int(cells**0.5)
    bounds = sorted(set(rows.approxQuantile(value, [i / (side * side) for i in range(1, side * side)], 0.01 / (side * side)))) if not rows.isEmpty() else []
    groups = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    if not groups:
        return F.when(F.col(value).isNull(), -1).otherwise(0)
    above = lambda bounds: F.size(F.filter(bounds, lambda b: b <= F.col(value)))
    coarse = above(F.array(*[F.lit(g[0]) for g in groups]))
    fine = above(F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), F.greatest(coarse, F.lit(1))))
    return F.when(F.col(value).isNull(), -1).when(coarse == 0, 0).otherwise((coarse - 1) * side + fine)


def positions(rows: DataFrame, group: str, cell: str, order: list) -> DataFrame:
    """``rows`` with ``position``, their number from 1 in a group by cell, then ``order``: counted in their cell, after the
    counts of the cells before it."""
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy(F.col(group).alias("_group"), F.col(cell).alias("_at")).agg(F.count(F.lit(1)).alias("_n")).select("_group", "_at", F.coalesce(before, F.lit(0)).alias("_before"))
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(group, cell).orderBy(*order)))
    out = own.join(counts, own[group].eqNullSafe(counts["_group"]) & own[cell].eqNullSafe(counts["_at"]))
    return out.withColumn("position", F.col("_before") + F.col("_own")).drop("_group", "_at", "_before", "_own")


@dataclass
class Last:
    value: int | None = None

    def then(self, value: int | None) -> tuple[int | None]:
        self.value = self.value if value is None else value
        return (self.value,)

    def after(self, state: Last) -> Last:
        return Last(state.value if self.value is None else self.value)


def interleaved(packets: DataFrame, cells: int = 1024, cell: int = CELL) -> DataFrame:
    """Mux order within an asset: by dts, then stream, then arrival. A packet without dts goes with the one that came before it
    in its stream; those in front of a stream's first dts go first."""
    placed = scanned(packets, ["asset_id", STREAM], ["dts"], Last, Last.then, "_place long", cell=cell, carry=Last)
    rows = cut(placed)  # bounds and counts are of the same rows
    rows = rows.withColumn("_cell", spread(rows, "_place", cells))
    return positions(rows, "asset_id", "_cell", ["_place", STREAM, "seq"]).drop("_place", "_cell")


# --- the queue that holds streams back for the shortest ---


def ends(frames: DataFrame) -> DataFrame:
    """``end`` of frames in ticks of num/den: of sound its pts and the time of its samples, else pts and duration; null without pts."""
    samples = rescale(F.col("samples").cast("long"), F.col("den").cast("long"), F.col("sample_rate").cast("long") * F.col("num")).cast("long")
    sound = (F.col("samples") > 0) & (F.col("sample_rate") > 0)
    return frames.withColumn("end", F.col("pts") + F.when(sound, samples).otherwise(F.col("duration")))


def comparable(packets: DataFrame) -> Column:
    """``end`` ticks of num/den as whole numbers of one unit, the least in which all bases of the table are whole."""
    bases = packets.select("num", "den").distinct().limit(1025).collect()
    if len(bases) > 1024:
        raise ValueError("over 1024 time bases: bring streams to fewer first")
    unit = math.lcm(*[b.den for b in bases if b.den])
    return F.col("end").cast("decimal(20,0)") * F.col("num").cast("decimal(10,0)") * F.call_function("div", F.lit(unit).cast("decimal(38,0)"), F.col("den"))


@dataclass
class Heads:
    """How far each stream has come, of those that limit an asset and of the one a packet belongs to."""

    at: dict[int, int] = field(default_factory=dict)

    def then(self, stream: int, end: Decimal | None, limits: list[int]) -> None:
        if end is not None and (stream not in self.at or self.at[stream] < end):
            self.at[stream] = int(end)

    def after(self, state: Heads) -> Heads:
        keys = {**state.at, **self.at}
        return Heads({k: max(h.at[k] for h in (state, self) if k in h.at) for k in keys})


def released(packets: DataFrame, limiting: list[int], cell: int = CELL) -> DataFrame:
    """What a queue lets go of that keeps all streams of an asset to the shortest of the limiting ones, with ``position``, the
    order in which it does. Packets: asset_id, stream_index, seq (arrival), end (null: not known) in ticks of num/den.

    A packet may go when its end is not past the head, the least of how far the limiting streams have come, once each has
    come anywhere. Streams are queues: what is held back holds back all behind it, also packets without an end, and what never
    may go is lost with them. With each arrival streams are let go in their order. A limiting stream without any end limits
    nothing; if none has one, only what lies in front of a stream's first end goes. An asset without a limiting stream passes as
    it is. The queue has no bound on what it holds.
    """
    rows = cut(packets.withColumn("_end", comparable(packets)))
    named = F.col(STREAM).isin(limiting)
    known = rows.groupBy("asset_id").agg(F.collect_set(F.when(named & F.col("_end").isNotNull(), F.col(STREAM))).alias("_limits"), F.coalesce(F.bool_or(named), F.lit(False)).alias("_held"))
    rows = rows.join(known, same(rows, known, ["asset_id"])).drop(known["asset_id"])

    def step(heads: Heads, stream: int, end: Decimal | None, limits: list[int]) -> tuple[Decimal | None, Decimal | None]:
        heads.then(stream, end, limits)
        head = min(heads.at[s] for s in limits) if limits and all(s in heads.at for s in limits) else None
        need = heads.at.get(stream)
        return (None if need is None else Decimal(need)), (None if head is None else Decimal(head))

    rows = cut(scanned(rows, ["asset_id"], [STREAM, "_end", "_limits"], Heads, step, "_need decimal(38,0), _head decimal(38,0)", cell=cell, carry=Heads))
    # the first arrival at which the head has come as far as a packet needs it
    rows = rows.withColumn("_key", F.col("_need").cast("double"))
    heads = rows.where("_head is not null").groupBy("asset_id", "_head").agg(F.min("seq").alias("_since"))
    marks = heads.select("asset_id", F.col("_head").alias("_need"), F.col("_head").cast("double").alias("_key"), F.col("_since"))
    needs = rows.where("_need is not null").select("asset_id", "_need", "_key").distinct().withColumn("_since", F.lit(None).cast("long"))
    both = marks.unionByName(needs)
    both = both.withColumn("_cell", spread(rows, "_key"))
    later = Window.partitionBy("asset_id", "_cell").orderBy(F.col("_need").desc()).rangeBetween(Window.unboundedPreceding, 0)
    cells = both.groupBy("asset_id", "_cell").agg(F.min("_since").alias("_first"))
    cells = cells.withColumn("_next", F.min("_first").over(Window.partitionBy("asset_id").orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1))).select(F.col("asset_id").alias("_asset"), F.col("_cell").alias("_at"), "_next")
    both = both.withColumn("_own", F.min("_since").over(later))
    both = both.join(cells, both["asset_id"].eqNullSafe(cells["_asset"]) & both["_cell"].eqNullSafe(cells["_at"]))
    when = both.groupBy(F.col("asset_id").alias("_asset"), F.col("_need").alias("_value")).agg(F.min(F.coalesce("_own", "_next")).alias("_goes"))
    rows = rows.join(when, rows["asset_id"].eqNullSafe(when["_asset"]) & rows["_need"].eqNullSafe(when["_value"]), "left")
    free = ~F.col("_held") | F.col("_need").isNull()
    rows = rows.withColumn("_goes", F.when(free, F.col("seq")).when(F.col("_goes").isNotNull(), F.greatest("seq", "_goes"))).where(F.col("_goes").isNotNull())
    rows = rows.withColumn("_cell", F.call_function("div", "_goes", F.lit(cell)))
    extra = ["_end", "_limits", "_held", "_need", "_head", "_key", "_asset", "_value", "_goes", "_cell"]
    return positions(rows, "asset_id", "_cell", ["_goes", STREAM, "seq"]).drop(*extra)


def shortest(packets: DataFrame, limiting: list[int]) -> DataFrame:
    """All streams cut at the earliest end among the limiting ones: what ``released`` lets go, without its order.

    Of each stream that is what lies in front of its first packet that ends later; ``end_us`` may be missing.
    """
    named = F.col(STREAM).isin(limiting)
    last = packets.groupBy("asset_id", STREAM).agg(F.max("end_us").alias("_last"))
    cut_us = last.groupBy("asset_id").agg(F.min(F.when(named, F.col("_last"))).alias("_cut"), F.coalesce(F.bool_or(named), F.lit(False)).alias("_held"))
    rows = packets.join(cut_us, same(packets, cut_us, ["asset_id"])).drop(cut_us["asset_id"])
    over = F.col("_held") & F.col("end_us").isNotNull() & F.coalesce(F.col("end_us") > F.col("_cut"), F.lit(True))
    stop = rows.groupBy("asset_id", STREAM).agg(F.min(F.when(over, F.col("seq"))).alias("_stop"))
    out = rows.join(stop, same(rows, stop, ["asset_id", STREAM])).drop(stop["asset_id"], stop[STREAM])
    return out.where("_stop is null or seq < _stop").drop("_cut", "_held", "_stop")


def progress(packets: DataFrame, active: list[int]) -> DataFrame:
    """Output time of each asset: the least last stamp over active streams, the greatest if none is active."""
    last = packets.groupBy("asset_id", STREAM).agg(F.max("pts_us").alias("mark"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("packets"))
    on = F.col(STREAM).isin(active)
    out = last.groupBy("asset_id").agg(F.coalesce(F.min(F.when(on, F.col("mark"))), F.max("mark")).alias("out_us"), F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))
    return out


def rates(progressed: DataFrame, started_us: int, wall_us: int) -> DataFrame:
    """Bit rate in kbit/s, speed against the wall clock and percent of a total, from a progress row."""
    t = F.col("out_us") - started_us
    return progressed.select("asset_id", F.when(t > 0, F.col("bytes") * 8000 / t).alias("kbps"), (t / F.lit(float(wall_us))).alias("speed"))


def percent(t: Column, total_us: int) -> Column:
    """Share of a total in percent, within 0 to 100; null without a total."""
    return F.lit(None).cast("double") if total_us <= 0 else F.greatest(F.lit(0.0), F.least(F.lit(100.0), t * 100.0 / total_us))


def forced_keys(frames: DataFrame, times_us: list[int]) -> DataFrame:
    """Frames that are made key frames, in order of their stamps: the first at or after the next forced time; a frame takes
    one time at most.

    Of the times that have come by a frame, as many are taken as frames allow: ranks less the greatest lag so far.
    """
    w = Window.partitionBy(STREAM).orderBy("pts_us", "seq")
    come = sum((F.when(F.col("pts_us") >= t, 1).otherwise(0) for t in times_us), F.lit(0))
    rank = F.row_number().over(w)
    rows = frames.withColumn("_rank", rank).withColumn("_taken", F.col("_rank") + F.least(F.lit(0), F.min(come - F.col("_rank")).over(upto(w))))
    return rows.withColumn("forced", F.col("_taken") > F.coalesce(F.lag("_taken").over(w), F.lit(0))).drop("_rank", "_taken")


def limited(packets: DataFrame, stream: int, most: int) -> DataFrame:
    """At most ``most`` packets of a stream, which then ends: the others are cut at its end, as with ``shortest``."""
    n = F.row_number().over(Window.partitionBy("asset_id", STREAM).orderBy("seq"))
    short = packets.withColumn("_n", n).where((F.col(STREAM) != stream) | (F.col("_n") <= most)).drop("_n")
    return shortest(short, [stream])


def trailing_dts(packets: DataFrame, finished: list[int]) -> DataFrame:
    """Of each asset the least last dts among streams that are not finished and have one; null without such a stream."""
    last = packets.groupBy("asset_id", STREAM).agg(F.max_by("dts", "seq").alias("_last"))
    return last.groupBy("asset_id").agg(F.min(F.when(~F.col(STREAM).isin(finished), F.col("_last"))).alias("dts"))
