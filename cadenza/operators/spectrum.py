"""Measures of magnitude spectra kept as arrays, and of keys from chroma."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The key profiles, from C, for major and minor.
PROFILES = {
    "krumhansl": ([6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88], [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]),
    "temperley": ([0.748, 0.060, 0.488, 0.082, 0.670, 0.460, 0.096, 0.715, 0.104, 0.366, 0.057, 0.400], [0.712, 0.084, 0.474, 0.618, 0.049, 0.460, 0.105, 0.747, 0.404, 0.067, 0.133, 0.330]),
}


def decibels(amplitude: Column) -> Column:
    return 20 * F.log10(F.greatest(amplitude, F.lit(1e-10)))


def log_band_edges(bands: int, low: float, high: float, rate: float, window: int) -> list[tuple[int, float, float, int, int]]:
    """(band, low_hz, high_hz, first bin, end bin) of geometric bands up to Nyquist; every band has a bin at least."""
    top, width = min(high, rate / 2), rate / window
    edges = [low * (top / low) ** (i / bands) for i in range(bands + 1)]
    rows = []
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        first = int(a // width)
        rows.append((i, a, b, first, max(first + 1, -int(-b // width))))
    return rows


def camelot(tonic: Column, minor: Column) -> Column:
    """The wheel's name of a key: 1-12 by fifths, A for minor and B for major."""
    major = F.when(minor, (tonic + 3) % 12).otherwise(tonic)
    return F.concat((((major * 7) % 12 + 7) % 12 + 1).cast("string"), F.when(minor, "A").otherwise("B"))


def camelot_number(name: Column) -> Column:
    """0-23 for the names 1A to 12B, null for others."""
    number, letter = F.regexp_extract(name, "^([0-9]{1,2})([AB])$", 1), F.regexp_extract(name, "^([0-9]{1,2})([AB])$", 2)
    value = F.when(number != "", number.cast("int"))
    return F.when(value.between(1, 12), F.pmod(value - 8, F.lit(12)) * 2 + F.when(letter == "A", 1).otherwise(0))


# The names of the pitch classes.
NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def key_name(tonic: Column, minor: Column) -> Column:
    return F.concat(F.get(F.array(*map(F.lit, NAMES)), tonic % 12), F.when(minor, " minor").otherwise(" major"))


def relative_tonic(tonic: Column, minor: Column) -> Column:
    """The tonic of the key of the other mode with the same notes."""
    return F.pmod(tonic + F.when(minor, 3).otherwise(9), F.lit(12))


def relative_camelot(name: Column) -> Column:
    """A key and its relative share their number on the wheel."""
    return F.concat(F.regexp_extract(name, "^([0-9]+)", 1), F.when(F.right(name, F.lit(1)) == "A", "B").otherwise("A"))


def margin(best: Column, second: Column) -> Column:
    """How far the best correlation is above the second, as a share of its size; 0 if it is 0."""
    return F.when(F.abs(best) > 0, (best - second) / F.abs(best)).otherwise(0.0)


def ranked_keys(chroma: Column, profile: str = "temperley") -> Column:
    """The 24 keys as an array of struct<key:struct<tonic,mode>, camelot, name, correlation> by falling correlation of
    their profiles with 12 pitch-class shares, majors before minors and by tonic on ties; flat shares correlate with 0.

    All keys are literals in one expression: nothing is joined or shuffled.
    """
    keys = []
    for m, weights in enumerate(PROFILES[profile]):
        centre = sum(weights) / 12
        size = sum((w - centre) ** 2 for w in weights) ** 0.5
        for t in range(12):
            number = ((t + 3 * m) % 12 * 7 + 7) % 12 + 1
            turned = ", ".join(f"{(weights[(p - t) % 12] - centre) / size!r}D" for p in range(12))
            keys.append(f"struct({12 * m + t} as place, struct({t} as tonic, '{'minor' if m else 'major'}' as mode) as key, '{number}{'BA'[m]}' as camelot, '{NAMES[t]} {'minor' if m else 'major'}' as name, array({turned}) as w)")
    # centred shares once, then one product a key; weights are centred and scaled already
    centred = F.transform(F.array(chroma), lambda c: F.transform(c, lambda x: x - F.aggregate(c, F.lit(0.0), lambda s, y: s + y) / 12))
    ranked = F.transform(centred, lambda c: F.transform(
        F.expr(f"array({', '.join(keys)})"),
        lambda k: F.struct(k.alias("k"), F.when(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x) > 0, F.aggregate(F.zip_with(c, k["w"], lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x) / F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))).otherwise(0.0).alias("r")),
    ))
    ordered = F.array_sort(F.transform(F.get(ranked, F.lit(0)), lambda x: F.struct((-x["r"]).alias("rank"), x["k"]["place"].alias("place"), x["k"].alias("k"), x["r"].alias("r"))))
    return F.transform(ordered, lambda x: F.struct(x["k"]["key"].alias("key"), x["k"]["camelot"].alias("camelot"), x["k"]["name"].alias("name"), x["r"].alias("correlation")))


def rank_keys(chroma: DataFrame, by: list[str], profile: str = "temperley") -> DataFrame:
    """(by..., tonic, minor, correlation, rank) from rows (by..., pitch, x): Pearson against 24 rotated profiles, 0 if flat."""
    spark = chroma.sparkSession
    rows = [(t, m == 1, p, weights[(p - t) % 12]) for m, weights in enumerate(PROFILES[profile]) for t in range(12) for p in range(12)]
    table = F.broadcast(spark.createDataFrame(rows, "tonic int, minor boolean, pitch int, w double"))  # 288 rows
    x, w = F.col("x"), F.col("w")
    sums = chroma.join(table, "pitch").groupBy(*by, "tonic", "minor").agg(F.sum(x).alias("sx"), F.sum(w).alias("sw"), F.sum(x * w).alias("sxw"), F.sum(x * x).alias("sxx"), F.sum(w * w).alias("sww"))
    vx, vw = 12 * F.col("sxx") - F.col("sx") ** 2, 12 * F.col("sww") - F.col("sw") ** 2
    r = F.when((vx > 1e-12) & (vw > 1e-12), (12 * F.col("sxw") - F.col("sx") * F.col("sw")) / F.sqrt(vx * vw)).otherwise(0.0)
    order = W.partitionBy(*by).orderBy(F.desc("correlation"), "minor", "tonic")
    return sums.select(*by, "tonic", "minor", F.round(r, 9).alias("correlation")).withColumn("rank", F.row_number().over(order))


def summary(bins: DataFrame, by: list[str], hz: str = "hz", power: str = "p") -> DataFrame:
    """(by..., peak_hz, centroid_hz, rolloff_95_hz, high_cutoff_hz): from rows of frequency and power. The peak is the
    last of the strongest from 20 Hz up, the cutoff the last one within 40 dB of the strongest."""
    w = W.partitionBy(*by)
    running = F.sum(power).over(w.orderBy(hz).rowsBetween(W.unboundedPreceding, 0))
    marked = bins.withColumn("run", running).withColumn("all_", F.sum(power).over(w)).withColumn("top", F.max(power).over(w))
    audible = F.max(F.when(F.col(hz) >= 20, F.struct(F.col(power).alias("p"), F.col(hz).alias("hz"))))
    return marked.groupBy(*by).agg(
        F.coalesce(audible["hz"], F.lit(0.0)).alias("peak_hz"),
        (F.sum(F.col(hz) * F.col(power)) / F.sum(power)).alias("centroid_hz"),
        F.min(F.when(F.col("run") >= 0.95 * F.col("all_"), F.col(hz))).alias("rolloff_95_hz"),
        F.max(F.when(F.col(power) >= F.col("top") * 1e-4, F.col(hz))).alias("high_cutoff_hz"),  # 40 dB below the top
    )


def spectrogram(frames: DataFrame, by: list[str], magnitudes: Column, bands: list[tuple[float, float]], bin_hz: float, columns: int, depth_db: float) -> DataFrame:
    """(by..., row, col, db) from rows (by..., frame, frames) with a spectrum each: mean magnitudes of bands over at most
    `columns` stretches of the track in decibels, the highest band in row 0, nothing more than depth_db below the top."""
    rows = []
    for k, (low, high) in enumerate(bands):
        first = int(low // bin_hz)
        size = max(first + 1, -int(-high // bin_hz)) - first
        part = F.slice("spectrum_", first + 1, size)
        rows.append(F.struct(F.lit(len(bands) - 1 - k).alias("row"), (F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.size(part)).alias("e")))
    cells = frames.withColumn("spectrum_", magnitudes).withColumn("col", F.floor(F.col("frame") * F.least(F.lit(columns), F.col("frames")) / F.col("frames")).cast("int"))
    means = cells.select(*by, "col", F.explode(F.array(*rows)).alias("c")).groupBy(*by, F.col("c.row").alias("row"), "col").agg(decibels(F.avg("c.e")).alias("db"))
    return means.withColumn("db", F.greatest(F.col("db"), F.max("db").over(W.partitionBy(*by)) - depth_db))


def _spectral_peaks(bins: DataFrame, by: list[str], bin_hz: float, low: float, high: float, clamp: bool) -> DataFrame:
    """The strict local maxima between two frequencies of rows (by..., i, a), with `semitones` from A = 440 Hz."""
    w = W.partitionBy(*by).orderBy("i")
    marked = bins.withColumn("l_", F.lag("a").over(w)).withColumn("r_", F.lead("a").over(w))
    inside = (F.col("i") * bin_hz >= low) & (F.col("i") * bin_hz <= high)
    shift = 0.5 * (F.col("l_") - F.col("r_")) / (F.col("l_") - 2 * F.col("a") + F.col("r_"))
    shift = F.least(F.greatest(shift, F.lit(-0.5)), F.lit(0.5)) if clamp else shift
    found = marked.where((F.col("a") > F.col("l_")) & (F.col("a") > F.col("r_")) & inside).withColumn("hz_", (F.col("i") + shift) * bin_hz)
    return found.where("hz_ > 0").withColumn("semitones", 12 * F.log2(F.col("hz_") / 440)).withColumn("note_", F.signum("semitones") * F.floor(F.abs("semitones") + 0.5)).drop("l_", "r_", "hz_")


def tuning_buckets(bins: DataFrame, by: list[str], bin_hz: float) -> DataFrame:
    """(by..., a, bucket) of the spectral peaks from 100 to 4000 Hz: whole cents off the nearest semitone, from -50 on."""
    off = F.floor((F.col("semitones") - F.col("note_")) * 100 + 50)
    return _spectral_peaks(bins, by, bin_hz, 100.0, 4000.0, clamp=False).select(*by, "a", F.least(F.greatest(off, F.lit(0)), F.lit(99)).cast("int").alias("bucket"))


def pitch_shares(bins: DataFrame, by: list[str], bin_hz: float) -> DataFrame:
    """(by..., pitch, share): the peaks' energies from 55 to 3000 Hz by pitch class from C, as shares of each spectrum;
    peaks more than a third of a semitone off a note don't count."""
    good = _spectral_peaks(bins, by, bin_hz, 55.0, 3000.0, clamp=True).where(F.abs(F.col("semitones") - F.col("note_")) <= 0.33)
    notes = good.groupBy(*by, F.pmod(F.col("note_").cast("int") + 9, F.lit(12)).alias("pitch")).agg(F.sum(F.col("a") * F.col("a")).alias("e_"))
    return notes.select(*by, "pitch", (F.col("e_") / F.sum("e_").over(W.partitionBy(*by))).alias("share"))
