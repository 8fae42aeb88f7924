"""Bars, their self-similarity, section boundaries, labels and cue pads, for any number of tracks at once.

`by` names the columns that tell tracks apart; windows and folds stay within a track, so none outgrows its bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Seconds a slot; bands of the low end; bars of the kernel, a phrase, the shortest section and the
# shortest track; how far a peak stands out; decibels that decide labels; the confidence below which one is weak.
SLOT_SECONDS, LOW_BANDS, FLOOR_DB = 0.1, 2, -120.0
KERNEL_BARS, PHRASE_BARS, SECTION_BARS, LEAST_BARS, PEAK_SIGMA = 8, 4, 8, 24, 0.8
KICK_FULL_DB, KICK_GONE_DB, RISE_DB, WEAK = 3.0, 9.0, 4.0, 0.35
# The pads in order, their names and colours, and which of them a memory cue leads into.
PADS = [
    ("A", "First beat", "green", False), ("B", "Loop in", "green", False), ("C", "Buildup", "yellow", True), ("D", "Drop", "red", True),
    ("E", "Breakdown", "blue", True), ("F", "Special", "purple", True), ("G", "Outro", "cyan", True), ("H", "Loop out", "orange", False),
]


def slot_means(frames: DataFrame, by: list[str], bands: int, frame_rate: Column) -> DataFrame:
    """(by..., slot, means) from rows (by..., frame, energies): each band's mean over tenths of a second."""
    slot = F.floor(F.col("frame") / F.greatest(F.lit(1.0), frame_rate * SLOT_SECONDS)).cast("int")
    return frames.groupBy(*by, slot.alias("slot")).agg(F.array(*[F.avg(F.col("energies")[k].cast("double")) for k in range(bands)]).alias("means"))


def bar_starts(beats: Column, phase: Column, beats_per_bar: int = 4) -> Column:
    """The times of an array of beats at which bars start."""
    return F.filter(beats, lambda x, i: (i >= phase % beats_per_bar) & ((i - phase) % beats_per_bar == 0))


def bars(starts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., bar, start_seconds, end_seconds) from (by..., bar_starts): a bar ends where the next one starts."""
    pairs = F.transform(F.slice("bar_starts", 1, F.greatest(F.size("bar_starts") - 1, F.lit(0))), lambda x, i: F.struct(x.alias("start_seconds"), F.get("bar_starts", i + 1).alias("end_seconds")))
    return starts.select(*by, F.posexplode(pairs).alias("bar", "x")).select(*by, "bar", "x.*")


def bar_means(slots: DataFrame, spans: DataFrame, by: list[str], bands: int) -> DataFrame:
    """(by..., bar, start_seconds, end_seconds, energies): the mean slot of each bar, zeros for a bar without slots.

    The range join of bars with slots is an equi join on the slots that a bar spans.
    """
    count = slots.groupBy(*by).agg((F.max("slot") + 1).alias("slots_"))
    first = F.greatest(F.floor(F.col("start_seconds") / SLOT_SECONDS), F.lit(0)).cast("int")
    last = F.least(F.ceil(F.col("end_seconds") / SLOT_SECONDS).cast("int"), F.coalesce("slots_", F.lit(0)))
    wanted = spans.join(count, by, "left").withColumn("slot", F.explode_outer(F.when(last > first, F.sequence(first, last - 1)))).drop("slots_")
    means = F.array(*[F.coalesce(F.avg(F.col("means")[k]), F.lit(0.0)) for k in range(bands)])
    return wanted.join(slots, [*by, "slot"], "left").groupBy(*by, "bar", "start_seconds", "end_seconds").agg(means.alias("energies"))


def bar_shape(energies: Column) -> Column:
    """ln(1 + 1000 e) of a band array, scaled to length 1; zeros if silent."""
    logged = F.transform(energies, lambda e: F.log1p(1000 * F.greatest(e, F.lit(0.0))))
    norm = F.sqrt(F.aggregate(logged, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(logged, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def level_db(energies: Column, bands: int | None = None) -> Column:
    """The summed energy of the first `bands` bands, or of all, in decibels from -120 up."""
    some = energies if bands is None else F.slice(energies, 1, bands)
    total = F.aggregate(some, F.lit(0.0), lambda s, x: s + x)
    return F.when(total <= 0, FLOOR_DB).otherwise(F.greatest(20 * F.log10(total), F.lit(FLOOR_DB)))


def checkerboard(cells: DataFrame, by: list[str], kernel: int = KERNEL_BARS) -> DataFrame:
    """(by..., bar, novelty) from rows (by..., bar, band, x) of unit shapes: how much the `kernel` bars on each side of a
    bar's start resemble themselves more than each other. Mean products of blocks are products of summed vectors, so
    two windows do what the quadratic self-similarity matrix would. 0 within `kernel` bars of the ends."""
    w = W.partitionBy(*by, "band").orderBy("bar")
    before, after = F.sum("x").over(w.rowsBetween(-kernel, -1)), F.sum("x").over(w.rowsBetween(0, kernel - 1))
    n, seen = F.count("x").over(w.rowsBetween(0, kernel - 1)), F.count("x").over(w.rowsBetween(-kernel, -1))
    sums = cells.withColumn("b", before).withColumn("a", after).withColumn("full", (n == kernel) & (seen == kernel))
    value = F.sum((F.col("b") * F.col("b") + F.col("a") * F.col("a")) / 2 - F.col("a") * F.col("b")) / (kernel * kernel)
    return sums.groupBy(*by, "bar").agg(F.when(F.bool_and("full"), F.greatest(value, F.lit(0.0))).otherwise(0.0).alias("novelty"))


def boundaries(curve: DataFrame, by: list[str], phrase: int = PHRASE_BARS, apart: int = SECTION_BARS, sigma: float = PEAK_SIGMA) -> DataFrame:
    """(by..., bar, novelty, strength) of section boundaries from rows (by..., bar, novelty).

    Peaks (no lower than both neighbours) of at least `sigma` deviations above the track's mean move to the nearest
    phrase, the one before on ties; of those nearer than `apart` bars to a stronger one only that stays.
    """
    w = W.partitionBy(*by)
    order, v = w.orderBy("bar"), F.col("novelty")
    deviation = F.stddev_pop("novelty").over(w)
    strength = F.when(deviation > 1e-12, (v - F.avg("novelty").over(w)) / deviation).otherwise(0.0)
    marked = curve.withColumn("strength", strength).withColumn("bars_", F.count("*").over(w)).withColumn("before_", F.lag("novelty").over(order)).withColumn("after_", F.lead("novelty").over(order))
    peak = F.coalesce(v >= F.col("before_"), F.lit(True)) & F.coalesce(v >= F.col("after_"), F.lit(True)) & (F.col("strength") >= sigma)
    below = F.floor(F.col("bar") / phrase).cast("int") * phrase
    place = F.when(F.col("bar") - below <= below + phrase - F.col("bar"), below).otherwise(below + phrase)
    found = marked.where(peak).withColumn("place", place).where((F.col("place") > 0) & (F.col("place") < F.col("bars_")))
    ranked = found.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct((-F.col("strength")).alias("rank"), "bar", "place", "novelty", "strength"))).alias("all"))
    kind = "array<struct<rank:double,bar:int,place:int,novelty:double,strength:double>>"
    kept = F.expr(f"aggregate(cast(all as {kind}), cast(array() as {kind}), (kept, x) -> if(exists(kept, k -> abs(k.place - x.place) < {apart}), kept, concat(kept, array(x))))")
    return ranked.select(*by, F.explode(kept).alias("x")).select(*by, F.col("x.place").alias("bar"), "x.novelty", "x.strength")


def section_spans(edges: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., idx, start_bar, bars) between edges (by..., bar), the first bar and the end of (by..., bar_count)."""
    both = counts.where("bar_count > 0").select(*by, F.explode(F.array(F.lit(0), F.col("bar_count"))).alias("bar"))
    inside = edges.select(*by, "bar").join(counts, by).where(F.col("bar") < F.col("bar_count")).select(*by, "bar")
    order = W.partitionBy(*by).orderBy("bar")
    points = both.unionByName(inside).distinct().withColumn("next_", F.lead("bar").over(order)).withColumn("idx", F.row_number().over(order) - 1)
    return points.where("next_ is not null").select(*by, "idx", F.col("bar").alias("start_bar"), (F.col("next_") - F.col("bar")).alias("bars"))


def section_measures(rows: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """(by..., idx, start_bar, bars, start_seconds, end_seconds, low_db, broadband_db, rise_db) of every section.

    rows has (by..., bar, start_seconds, end_seconds, low_db, broadband_db). The rise is the last quarter's mean level
    less the first one's, a quarter being one bar at least. Bars find their section by an equi join on bar numbers.
    """
    each = spans.withColumn("bar", F.explode(F.sequence(F.col("start_bar"), F.col("start_bar") + F.col("bars") - 1))).join(rows, [*by, "bar"])
    quarter, at = F.greatest(F.floor(F.col("bars") / 4), F.lit(1)), F.col("bar") - F.col("start_bar")
    level = F.col("broadband_db")
    rise = F.avg(F.when(at >= F.col("bars") - quarter, level)) - F.avg(F.when(at < quarter, level))
    return each.groupBy(*by, "idx", "start_bar", "bars").agg(F.min("start_seconds").alias("start_seconds"), F.max("end_seconds").alias("end_seconds"), F.avg("low_db").alias("low_db"), F.avg(level).alias("broadband_db"), rise.alias("rise_db"))


def section_labels(sections: DataFrame, by: list[str]) -> DataFrame:
    """Adds `label` and `confidence` to (by..., idx, bars, low_db, broadband_db, rise_db).

    The first section is the intro and the last the outro; of the rest, one near the track's loudest in its low end and
    as a whole is a drop, one that rises without a full low end a build, one whose low end is gone a breakdown, any
    other steady. A confidence is how far the measures are from the threshold that decided. A build that no drop
    follows is steady, with none.
    """
    w, order = W.partitionBy(*by), W.partitionBy(*by).orderBy(F.desc("idx"))
    named = sections.withColumn("low_", F.max("low_db").over(w) - F.col("low_db")).withColumn("broad_", F.max("broadband_db").over(w) - F.col("broadband_db")).withColumn("last_", F.max("idx").over(w))
    low, broad, rise = F.col("low_"), F.col("broad_"), F.col("rise_db")
    margin = lambda distance, scale: F.least(F.abs(distance) / scale, F.lit(1.0))
    ends = margin(F.col("bars").cast("double"), 8.0)
    nearest = F.least(F.abs(KICK_FULL_DB - low), F.abs(low - KICK_GONE_DB), F.abs(rise - RISE_DB))
    rules = [
        (F.col("idx") == 0, "intro", ends), (F.col("idx") == F.col("last_"), "outro", ends),
        ((low <= KICK_FULL_DB) & (broad <= KICK_FULL_DB), "drop", F.least(margin(KICK_FULL_DB - low, KICK_FULL_DB), margin(KICK_FULL_DB - broad, KICK_FULL_DB))),
        ((rise >= RISE_DB) & (low > KICK_FULL_DB), "build", margin(rise - RISE_DB, RISE_DB)), (low >= KICK_GONE_DB, "breakdown", margin(low - KICK_GONE_DB, KICK_GONE_DB)),
    ]
    label, confidence = F.lit("steady"), margin(nearest, KICK_FULL_DB)
    for test, name, sure in reversed(rules):
        label, confidence = F.when(test, name).otherwise(label), F.when(test, sure).otherwise(confidence)
    named = named.withColumn("label", label).withColumn("confidence", confidence)
    # sections run from the last one on, so what is later has been seen
    later = F.coalesce(F.max(F.col("label") == "drop").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    undone = named.withColumn("undone_", (F.col("label") == "build") & ~later)
    return undone.withColumn("label", F.when(F.col("undone_"), "steady").otherwise(F.col("label"))).withColumn("confidence", F.when(F.col("undone_"), 0.0).otherwise(F.col("confidence"))).drop("undone_", "low_", "broad_", "last_")


def bound(name: str, value: str, body: str) -> str:
    """SQL of `body`, in which `name` stands for `value`, evaluated once.

    A column of steps like these is no such thing: filters on what is made of it, as an explode brings its own, take the
    step's text to every place where its name stands, within lambdas too, which then run it for each of their elements.
    """
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def place_cues(tracks: DataFrame, memory_offset: int = 16, loop_bars: int = 4, drop_after: float = 0.2) -> DataFrame:
    """Adds cues, missing_pads and drop_rule_relaxed to rows of one track each with `sections` (an array of structs with
    idx, label, start_bar and broadband_db, by idx), `bar_starts` and `duration_seconds`.

    The eight pads of PADS: the first bar; the first section that is a drop or steady (else the first) as loop; the
    last build before the drop; the first drop after `drop_after` of the track, else the first one (the rule is then
    relaxed); the first breakdown; the loudest section that no pad marks yet (to nine decimals, the last on ties), neither the first nor an intro; the last
    outro; and loop_bars after the loop's start. A pad without a section or bar is missing. Each pad's hot cue is
    followed by a memory cue, memory_offset bars ahead for those that lead in, unless one is on that bar already. Without sections only the first beat is
    marked.
    """
    places = [("0", "null"), ("loop_", "null"), *((f"{c}.start_bar", f"{c}.idx") for c in ("build_", "drop_", "down_", "special_", "outro_")), (f"loop_ + {loop_bars}", "null")]
    pads = ", ".join(
        f"struct({i} as number, '{pad}' as pad, '{name}' as name, '{colour}' as colour, cast({bar} as int) as bar, cast({section} as int) as from_section, greatest(cast({bar} as int) - {memory_offset if leads else 0}, 0) as memory_bar, get(bar_starts, cast({bar} as int)) as time_seconds)"
        for i, ((pad, name, colour, leads), (bar, section)) in enumerate(zip(PADS, places, strict=True), 1)
    )
    cue = "struct('{kind}' as kind, {number} as number, m.p.name as name, m.p.colour as colour, {time} as time_seconds, m.p.{bar} as bar, m.p.from_section as from_section)"
    hot = cue.format(kind="hot", number="m.p.number", time="m.p.time_seconds", bar="bar")
    memory = cue.format(kind="memory", number="size(filter(slice(marked_, 1, i + 1), n -> n.fresh))", time="get(bar_starts, m.p.memory_bar)", bar="memory_bar")
    steps = [
        ("early_", f"coalesce(array_min(filter(transform(bar_starts, (t, i) -> if(t >= duration_seconds * {drop_after!r}D, i, null)), i -> i is not null)), 0)"),
        ("late_", "try_element_at(filter(sections, s -> s.label = 'drop' and s.start_bar >= early_), 1)"),
        ("drop_", "coalesce(late_, try_element_at(filter(sections, s -> s.label = 'drop'), 1))"),
        ("build_", "try_element_at(filter(sections, s -> s.label = 'build' and s.idx < drop_.idx), -1)"),
        ("down_", "try_element_at(filter(sections, s -> s.label = 'breakdown'), 1)"), ("outro_", "try_element_at(filter(sections, s -> s.label = 'outro'), -1)"),
        ("loop_", "coalesce(try_element_at(filter(sections, s -> s.label in ('drop', 'steady')), 1).start_bar, try_element_at(sections, 1).start_bar, 0)"),
        ("taken_", "array_compact(array(drop_.idx, build_.idx, down_.idx, outro_.idx))"),
        ("special_", "array_max(transform(filter(sections, s -> s.idx > 0 and not array_contains(taken_, s.idx) and s.label <> 'intro'), s -> struct(round(s.broadband_db, 9), s.idx, s.start_bar)))"),
        ("all_", f"array({pads})"), ("pads_", "if(size(sections) > 0, all_, slice(all_, 1, 1))"), ("hot_", "filter(pads_, p -> p.time_seconds is not null)"),
        ("marked_", "transform(hot_, (p, i) -> struct(p as p, not exists(slice(hot_, 1, i), q -> q.memory_bar = p.memory_bar) as fresh))"),
    ]
    placed = {
        "cues": f"flatten(transform(marked_, (m, i) -> if(m.fresh, array({hot}, {memory}), array({hot}))))",
        "missing_pads": "if(size(sections) > 0, transform(filter(pads_, p -> p.time_seconds is null), p -> p.pad), cast(array() as array<string>))",
        "drop_rule_relaxed": "late_ is null and drop_ is not null",
    }
    whole = f"struct({', '.join(f'{value} as {name}' for name, value in placed.items())})"
    for name, value in reversed(steps):
        whole = bound(name, value, whole)
    return tracks.withColumn("placed_", F.expr(whole)).withColumns({c: F.col(f"placed_.{c}") for c in placed}).drop("placed_")


def clock(seconds: Column) -> Column:
    """m:ss of a time."""
    whole = F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")
    return F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)


def segmented(bar_rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(boundaries, labelled sections) from rows (by..., bar, start_seconds, end_seconds, energies) of tracks' bars."""
    shapes = bar_rows.select(*by, "bar", F.posexplode(bar_shape(F.col("energies"))).alias("band", "x"))
    edges = boundaries(checkerboard(shapes, by), by)
    counts = bar_rows.groupBy(*by).agg((F.max("bar") + 1).alias("bar_count"))
    levels = bar_rows.select(*by, "bar", "start_seconds", "end_seconds", level_db(F.col("energies"), LOW_BANDS).alias("low_db"), level_db(F.col("energies")).alias("broadband_db"))
    return edges, section_labels(section_measures(levels, section_spans(edges, counts, by), by), by)
