"""What looks doubtful about an analysis: each rule is a predicate and a message over the measured columns.

Rules become one array column a stage, so they cost no join and no second pass; `merged` puts warnings first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .structure import LEAST_BARS, WEAK, clock

# The share of the answer's salience that makes a rival.
RIVAL = 0.85
_KIND = "array<struct<code:string,severity:string,message:string>>"


def finding(code: str, severity: str, message: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"))


def when(test: Column, code: str, severity: str, message: Column) -> Column:
    """An array of the finding where the test holds, else an empty one."""
    return F.when(F.coalesce(test, F.lit(False)), F.array(finding(code, severity, message))).otherwise(F.expr(f"cast(array() as {_KIND})"))


def _said(pattern: str, *parts: Column) -> Column:
    return F.format_string(pattern, *parts)


def format_bpm(bpm: Column) -> Column:
    """A whole tempo without decimals, any other with two."""
    return F.when(F.abs(bpm - F.round(bpm)) < 1e-9, _said("%.0f", bpm)).otherwise(_said("%.2f", bpm))


def octave_rivals(tempo: Column, floor_bpm: float) -> Column:
    """octave-ambiguity: levels not below the floor whose salience comes near the answer's."""
    ratio = lambda r: r["salience"] / F.greatest(tempo["salience"], F.lit(2.2250738585072014e-308))
    rivals = F.filter(tempo["octave_relatives"], lambda r: (r["label"] != "candidate") & (r["bpm"] >= floor_bpm) & (ratio(r) >= RIVAL))
    return F.transform(rivals, lambda r: finding("octave-ambiguity", "warning", _said("%.2f BPM (%s) has %.0f%% of the salience of %s BPM: too little between them to decide the octave", r["bpm"], r["label"], ratio(r) * 100, format_bpm(tempo["bpm"]))))


def better_levels(tempo: Column) -> Column:
    """level-fits-better: grids at two thirds or three halves that match more beats on stronger onsets."""
    answer = F.get(F.filter(tempo["octave_relatives"], lambda r: r["label"] == "candidate"), F.lit(0))
    fits = lambda r: r["label"].isin("two-thirds", "three-halves") & (r["matched_fraction"] > answer["matched_fraction"]) & (r["pulse_ratio"] > answer["pulse_ratio"] * 1.05)
    return F.transform(
        F.filter(tempo["octave_relatives"], fits),
        lambda r: finding("level-fits-better", "warning", _said("a grid at %.2f BPM (%s) matches %.0f%% of its beats at %.2fx the mean novelty, the answer's %.0f%% at %.2fx", r["bpm"], r["label"], r["matched_fraction"] * 100, r["pulse_ratio"], answer["matched_fraction"] * 100, answer["pulse_ratio"])),
    )


def close_runner_up(tempo: Column) -> Column:
    """close-runner-up: the second candidate is strong and no octave relative of the answer."""
    first, second = F.get(tempo["candidates"], F.lit(0)), F.get(tempo["candidates"], F.lit(1))
    ratio = second["weighted_salience"] / F.greatest(first["weighted_salience"], F.lit(2.2250738585072014e-308))
    related = F.exists(F.array(*[F.lit(x) for x in (1.0, 0.5, 2 / 3, 1.5, 2.0)]), lambda x: F.abs(second["bpm"] - tempo["bpm"] * x) < 1)
    return when(~related & (ratio >= RIVAL), "close-runner-up", "warning", _said("%.2f BPM has %.0f%% of the winner's salience and is none of its octave relatives, as where sections differ in tempo", second["bpm"], ratio * 100))


def tempo_findings(tempo: Column, floor_bpm: float, snap_bpm: float, min_bpm: float, max_bpm: float) -> Column:
    """The array of a tempo record's findings, in the rules' order; a record without candidates has no-candidate alone."""
    bpm, grid, spread, bar, shift = tempo["bpm"], tempo["grid"], tempo["stability"], tempo["bar"], tempo["octave_shift"]
    off = F.abs(tempo["bpm_measured"] - F.round(tempo["bpm_measured"]))
    matched = grid["matched_fraction"]
    rules = [
        octave_rivals(tempo, floor_bpm), better_levels(tempo),
        when(F.lit(snap_bpm > 0) & (off > snap_bpm), "non-integer-tempo", "warning", _said("measured %.2f BPM, which is %.2f off the %.0f it was rounded to: more than measuring explains", tempo["bpm_measured"], off, bpm)),
        when(shift.isNotNull(), "metrical-floor-applied", "info", _said("the strongest candidate, %.2f BPM (salience %.3f), was doubled to %.2f (salience %.3f) to clear the metrical floor", shift["from_bpm"], shift["from_salience"], shift["to_bpm"], shift["to_salience"])),
        close_runner_up(tempo),
        when(F.abs(tempo["fourier_bpm"] - bpm) / bpm > 0.01, "estimators-disagree", "warning", _said("the Fourier tempogram peaks at %.2f BPM, autocorrelation gives %s", tempo["fourier_bpm"], format_bpm(bpm))),
        when(grid["pulse_ratio"] < 1.5, "weak-pulse", "warning", _said("novelty on the beats is only %.2fx the track's mean", grid["pulse_ratio"])),
        when(matched < 0.5, "grid-misfit", "warning", _said("only %.0f%% of beats are within %.0f ms of an onset: no constant tempo describes the track", matched * 100, grid["tolerance_ms"])),
        when((matched >= 0.5) & (matched < 0.8), "loose-grid", "warning", _said("%.0f%% of beats are within %.0f ms of an onset: the level rests on a loose grid", matched * 100, grid["tolerance_ms"])),
        when(spread["interquartile_range_bpm"] > 2, "unstable-tempo", "warning", _said("window tempi spread over %.1f BPM around %.2f", spread["interquartile_range_bpm"], spread["median_bpm"])),
        when(spread["octave_split_fraction"] > 0.15, "octave-split-windows", "info", _said("%.0f%% of windows have half or double the tempo", spread["octave_split_fraction"] * 100)),
        when(F.abs(tempo["bpm_unweighted"] - bpm) > 1, "weighting-changed-answer", "warning", _said("without the energy band's weighting the answer is %.2f BPM, not %.2f", tempo["bpm_unweighted"], bpm)),
        when((bpm - min_bpm < 2) | (max_bpm - bpm < 2), "range-edge", "warning", _said(f"%s BPM is at the edge of the searched {min_bpm:.0f}-{max_bpm:.0f} BPM", format_bpm(bpm))),
        when(bar["contrast"] < 1.1, "flat-bar-phase", "info", _said("all beats of the bar carry the same low end (contrast %.2f): beat one is a guess", bar["contrast"])),
    ]
    none = F.array(finding("no-candidate", "warning", F.lit("the salience curve has no peak in the searched range")))
    return F.when(F.size(tempo["candidates"]) == 0, none).otherwise(F.concat(*rules))


def opening_findings(lead_in: Column, energy: Column) -> Column:
    """lead-in-trimmed and energy-band-applied, which come before the tempo's own."""
    applied = F.when(
        energy["centre_bpm"].isNotNull(), _said("energy %.2f is in the %s band, which weights tempi toward %.0f BPM", energy["score"], energy["band"], energy["centre_bpm"])
    ).otherwise(_said("energy %.2f is in the %s band, which weights nothing", energy["score"], energy["band"]))
    trimmed = when(lead_in > 0, "lead-in-trimmed", "info", _said("the first %.2f s, over 60 dB below the peak, were skipped; all times count from there", lead_in))
    return F.concat(trimmed, F.array(finding("energy-band-applied", "info", applied)))


def key_findings(key: Column) -> Column:
    """key-tie or relative-key-tie, tuning-offset and flat-chroma; key has margin, runner_up, relative, tuning_cents, chroma."""
    tie = F.when(key["margin"] < 0.05, F.when(key["runner_up"] == key["relative"], "relative-key-tie").otherwise("key-tie"))
    said = _said("%s is within %.1f%% of %s", key["runner_up"], key["margin"] * 100, key["camelot"])
    mean = F.aggregate(key["chroma"], F.lit(0.0), lambda s, x: s + x) / 12
    spread = F.sqrt(F.aggregate(key["chroma"], F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / 12)
    flatness = F.when(mean > 0, spread / mean).otherwise(0.0)
    ties = F.when(tie.isNotNull(), F.array(F.struct(tie.alias("code"), F.lit("warning").alias("severity"), said.alias("message")))).otherwise(F.expr(f"cast(array() as {_KIND})"))
    return F.concat(
        ties,
        when(F.abs(key["tuning_cents"]) > 15, "tuning-offset", "info", _said("the track is %+.0f cents from A = 440 Hz; pitch classes were shifted to match", key["tuning_cents"])),
        when(flatness < 0.25, "flat-chroma", "warning", _said("pitch classes are nearly uniform (spread %.2f of the mean): the ranking is arbitrary", flatness)),
    )


def structure_findings(structure: Column, drop_after: float) -> Column:
    """The rules about sections and pads; a track of too few bars has track-too-short-to-segment alone."""
    sections = structure["sections"]
    weak = F.filter(sections, lambda s: s["confidence"] < WEAK)
    names = F.array_join(F.transform(weak, lambda s: F.concat(s["label"], F.lit(" at "), clock(s["start_seconds"]))), ", ")
    rules = F.concat(
        when(F.size(structure["boundaries"]) == 0, "no-section-boundaries", "warning", F.lit("no bar differs enough from its neighbours: the track is one section")),
        when(F.size(weak) > 0, "weak-section-label", "warning", _said("%d of %d sections are near another label: %s", F.size(weak), F.size(sections), names)),
        when(~F.exists(sections, lambda s: s["label"] == "drop"), "no-drop-found", "info", F.lit("no section has both a full low end and the track's loudness: the drop pad is empty")),
        when(structure["drop_rule_relaxed"], "drop-rule-relaxed", "warning", F.lit(f"every drop starts in the first {drop_after * 100:.0f} percent of the track: the earliest was taken")),
        when(F.size(structure["missing_pads"]) > 0, "cue-pads-empty", "info", _said("pads %s have no section to mark", F.array_join(structure["missing_pads"], ", "))),
    )
    short = F.array(finding("track-too-short-to-segment", "warning", _said(f"%d bars are too few to find sections in; {LEAST_BARS} are needed", structure["bar_count"])))
    return F.when(structure["bar_count"] < LEAST_BARS, short).otherwise(rules)


def merged(*stages: Column) -> Column:
    """All stages' findings, warnings before infos, else in the stages' and rules' order."""
    every = F.concat(*stages)
    return F.concat(F.filter(every, lambda f: f["severity"] == "warning"), F.filter(every, lambda f: f["severity"] != "warning"))
