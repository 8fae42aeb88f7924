"""Tempo and beat grid of one track's novelty curve, in numpy."""

from __future__ import annotations

import functools

import numpy as np

from .options import Options

# Window and hop in seconds of the tempo trace and of the Fourier tempogram, the distance at which a beat
# matches a peak, and the metrical levels that an octave error lands on.
TRACE, FOURIER = (20.0, 10.0), (12.0, 6.0)
TOLERANCE_MS = 50.0
LEVELS = (("half", 0.5), ("two-thirds", 2 / 3), ("candidate", 1.0), ("three-halves", 1.5), ("double", 2.0))


def half_up(x):
    """Rounded with halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def last_max(x: np.ndarray) -> int:
    return len(x) - 1 - int(np.argmax(x[::-1]))


def grid(o: Options) -> np.ndarray:
    return o.min_bpm + o.resolution * np.arange(int(half_up((o.max_bpm - o.min_bpm) / o.resolution)) + 1)


def acf(v: np.ndarray, max_lag: int) -> np.ndarray:
    """Zero-mean autocorrelation over lags 0..max_lag, averaged over the overlap and divided by lag 0's; 0 beyond the curve."""
    out, n = np.zeros(max_lag + 1), len(v)
    if not n:
        return out
    x = v.astype(np.float64) - float(np.mean(v, dtype=np.float32))
    size = 1 << int(2 * n - 1).bit_length()
    spectrum = np.fft.rfft(x, size)
    lags = min(max_lag + 1, n)
    out[:lags] = np.fft.irfft(spectrum * spectrum.conj(), size)[:lags] / (n - np.arange(lags))
    return out / out[0] if out[0] > 1e-12 else np.zeros_like(out)


def at(curve: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The curve at fractional indices by a parabola through the nearest three points, linear at the ends, 0 outside."""
    index, n = np.asarray(index, np.float64), len(curve)
    if n == 0:
        return np.zeros(index.shape)
    near = np.floor(index + 0.5)
    inner = (near >= 1) & (near + 1 < n)
    mid = np.where(inner, near, 1).astype(int).clip(0, n - 1)
    a, b, c = curve[np.maximum(mid - 1, 0)], curve[mid], curve[np.minimum(mid + 1, n - 1)]
    d = index - mid
    bent = b + 0.5 * d * (c - a) + 0.5 * d * d * (c - 2 * b + a)
    return np.where((index < 0) | (index >= n), 0.0, np.where(inner, bent, np.interp(index, np.arange(n), curve)))


def value_at(v: np.ndarray, frame: np.ndarray) -> np.ndarray:
    """A novelty curve at fractional frames: linear, the last value up to one frame beyond it, 0 outside."""
    low = np.floor(frame).astype(np.int64)
    inside = (frame >= 0) & (low < len(v))
    low = np.clip(low, 0, max(0, len(v) - 1))
    a, b = v[low], v[np.minimum(low + 1, len(v) - 1)]
    return np.where(inside, a + (b - a) * (frame - low).astype(v.dtype), 0)


def salience_at(bpm: np.ndarray, salience: np.ndarray, where) -> np.ndarray:
    return at(salience, (np.asarray(where, np.float64) - bpm[0]) / (bpm[1] - bpm[0])) if len(bpm) > 1 else np.zeros(np.shape(where))


def comb(v: np.ndarray, rate: float, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """(bpm, salience): 1/k-weighted mean of the autocorrelation at each beat period's multiples, less `penalty` times
    its value half a period before each."""
    bpm = grid(o)
    curve = acf(v, min(int(np.ceil(60 * rate / o.min_bpm * o.pulses)), max(len(v) - 1, 0)))
    k = np.arange(1, o.pulses + 1)
    lag = (60 * rate / bpm)[:, None]
    teeth = at(curve, lag * k)
    if o.penalty:
        teeth = teeth - o.penalty * at(curve, lag * (k - 0.5))
    return bpm, teeth @ (1 / k) / (1 / k).sum()


@functools.lru_cache(maxsize=4)
def _basis(low: float, high: float, resolution: float, rate: float, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    angle = np.outer(np.arange(size), 2 * np.pi * (low + resolution * np.arange(int(half_up((high - low) / resolution)) + 1)) / 60 / rate)
    return np.cos(angle), np.sin(angle), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)


def magnitudes(x: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """|sum of x[i] * exp(-j * omega * i)| at frequencies between a transform's bins, in radians a sample."""
    angle = np.outer(np.arange(len(x)), omega)
    return np.hypot(x @ np.cos(angle), x @ np.sin(angle))


def fourier(v: np.ndarray, rate: float, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """(bpm, salience): mean magnitude of windowed stretches at each tempo, its peak scaled to 1; 0 for short curves."""
    bpm, (window, hop) = grid(o), (int(half_up(s * rate)) for s in FOURIER)
    if window == 0 or len(v) < window:
        return bpm, np.zeros(len(bpm))
    cosines, sines, hann = _basis(o.min_bpm, o.max_bpm, o.resolution, rate, window)
    stretches = np.lib.stride_tricks.sliding_window_view(v.astype(np.float64), window)[:: max(1, hop)] * hann
    mean = np.hypot(stretches @ cosines, stretches @ sines).mean(axis=0)
    return bpm, mean / mean.max() if mean.max() > 0 else mean


def weight(bpm: np.ndarray, o: Options) -> np.ndarray:
    return np.ones_like(bpm) if o.centre_bpm is None else np.exp(-0.5 * (np.log2(bpm / o.centre_bpm) / o.width_octaves) ** 2)


def _vertex(curve: np.ndarray, i: np.ndarray) -> np.ndarray:
    """How far from index i the parabola through its neighbours peaks, within half a step."""
    a, b, c = curve[i - 1], curve[i], curve[i + 1]
    bend = a - 2 * b + c
    flat = np.abs(bend) <= np.finfo(curve.dtype).eps
    return np.where(flat, 0.0, np.clip(0.5 * (a - c) / np.where(flat, 1, bend), -0.5, 0.5))


def candidates(bpm: np.ndarray, salience: np.ndarray, fourier_salience: np.ndarray, curve: np.ndarray, rate: float, o: Options, most: int = 5, apart: float = 1.0) -> list[dict]:
    """The peaks of greatest weighted salience, placed by a parabola, none within `apart` of a greater one."""
    here = salience[1:-1]
    i = 1 + np.flatnonzero((here > salience[:-2]) & (here >= salience[2:]) & (here > 0))
    if not len(i):
        return []
    place = bpm[i] + _vertex(salience, i) * o.resolution
    weighted = salience[i] * weight(place, o)
    lag = np.maximum(1, np.ceil(60 * rate / place)).astype(int)
    plain = np.where(lag < len(curve), curve[np.minimum(lag, len(curve) - 1)], 0.0)
    transform = salience_at(bpm, fourier_salience, place)
    rows: list[dict] = []
    for j in np.argsort(-weighted, kind="stable").tolist():
        if all(abs(place[j] - r["bpm"]) >= apart for r in rows):
            rows.append({"bpm": float(place[j]), "salience": float(salience[i[j]]), "weighted_salience": float(weighted[j]), "autocorrelation": float(plain[j]), "fourier_salience": float(transform[j])})
        if len(rows) == most:
            break
    return rows


def refined(bpm: np.ndarray, salience: np.ndarray, near: float) -> float:
    """The highest point of the curve within 1 % of `near`, between grid points."""
    if len(bpm) < 3:
        return near
    step = bpm[1] - bpm[0]
    centre = int(half_up((near - bpm[0]) / step))
    reach = max(1, int(half_up(near * 0.01 / step)))
    places = np.arange(max(1, centre - reach), min(len(bpm) - 2, centre + reach) + 1)
    best = min(max(centre, 0), len(bpm) - 1)
    if len(places) and salience[places].max() > salience[best]:
        best = int(places[salience[places].argmax()])
    best = min(max(best, 1), len(bpm) - 2)
    return float(bpm[best] + _vertex(salience, np.array([best]))[0] * step)


def floored(bpm: np.ndarray, salience: np.ndarray, found: float, o: Options) -> tuple[float, dict | None]:
    """(tempo, shift): doubled up to twice while it is below the floor and the double is strong enough."""
    now, shift = found, None
    for _ in range(2 if o.floor_bpm > 0 else 0):
        if not now < o.floor_bpm:
            break
        double = refined(bpm, salience, 2 * now)
        here, there = (float(x) for x in salience_at(bpm, salience, [now, double]))
        if there < o.floor_ratio * here:
            break
        shift = {"from_bpm": shift["from_bpm"] if shift else now, "to_bpm": double, "from_salience": here, "to_salience": there}
        now = double
    return now, shift


def snapped(bpm: float, o: Options) -> float:
    """The whole number that is reported, unless rounding is off."""
    return float(half_up(bpm)) if o.snap_bpm > 0 and np.isfinite(bpm) else bpm


def peak_frames(v: np.ndarray) -> np.ndarray:
    """Fractional frames of the peaks above the curve's mean."""
    if len(v) < 3:
        return np.empty(0)
    here = v[1:-1]
    i = 1 + np.flatnonzero((here > v[:-2]) & (here >= v[2:]) & (here > v.mean(dtype=np.float32)))
    return i + _vertex(v, i) if len(i) else np.empty(0)


def align(v: np.ndarray, rate: float, bpm: float, tolerance_ms: float = TOLERANCE_MS) -> dict:
    """The beat grid of a tempo: the phase with most novelty, and how well its beats meet the curve's peaks."""
    lag = 60 * rate / bpm
    beats = np.arange(max(0, int(np.floor((len(v) - 1) / lag))) + 1) * lag
    steps = max(1, int(np.ceil(lag * 10)))
    offsets, scores = np.arange(steps) * lag / steps, np.empty(steps)
    for a in range(0, steps, 64):
        scores[a : a + 64] = value_at(v, offsets[a : a + 64, None] + beats[None, :]).sum(axis=1, dtype=np.float64)
    best = int(scores.argmax())
    frames, mean = beats + offsets[best], float(v.mean(dtype=np.float32))
    peaks = peak_frames(v)
    distance = np.full(len(frames), np.inf)
    if len(peaks):
        after = np.searchsorted(peaks, frames)
        distance = np.minimum(np.where(after > 0, frames - peaks[np.maximum(after - 1, 0)], np.inf), np.where(after < len(peaks), peaks[np.minimum(after, len(peaks) - 1)] - frames, np.inf))
    near = distance <= tolerance_ms / 1000 * rate
    return {
        "bpm": float(bpm), "offset_seconds": float(offsets[best] / rate), "beats_seconds": (frames / rate).tolist(),
        "pulse_ratio": float(scores[best] / len(frames) / mean) if mean > 0 else 0.0, "matched_fraction": float(near.mean()),
        "mean_absolute_error_ms": float(distance[near].mean() / rate * 1000) if near.any() else None, "tolerance_ms": tolerance_ms,
    }


def bar_phase(beats_seconds: list[float], low: np.ndarray, rate: float, beats: int = 4) -> dict:
    """The beat of the bar with most low-end novelty, and that over the mean of the others."""
    values = value_at(low, np.asarray(beats_seconds) * rate).astype(np.float64)
    means = np.array([values[k::beats].mean() if len(values[k::beats]) else 0.0 for k in range(beats)])
    phase = last_max(means)
    others = (means.sum() - means[phase]) / max(1, beats - 1)
    return {"beats_per_bar": beats, "phase": phase, "contrast": float(means[phase] / others) if others > 0 else 0.0}


def over_time(v: np.ndarray, rate: float, o: Options) -> list[dict]:
    """The strongest tempo of each full window, raised by the metrical floor as the whole track's is."""
    window, hop = (int(half_up(s * rate)) for s in TRACE)
    rows = []
    for start in range(0, len(v) - window + 1, max(1, hop)):
        bpm, salience = comb(v[start : start + window], rate, o)
        i = last_max(salience)
        rows.append({"start_seconds": start / rate, "bpm": floored(bpm, salience, float(bpm[i]), o)[0], "salience": float(salience[i])})
    return rows


def stability(windows: list[float], bpm: float) -> dict:
    """Median and quartile range (nearest ranks) of window tempi, and the shares near bpm and near its double or half."""
    if not windows:
        return {"median_bpm": None, "interquartile_range_bpm": None, "agreeing_fraction": 0.0, "octave_split_fraction": 0.0}
    ordered = np.sort(windows)
    low, mid, high = (float(ordered[int(half_up((len(ordered) - 1) * q))]) for q in (0.25, 0.5, 0.75))
    near = lambda x: np.abs(ordered - x) / x < 0.01
    return {"median_bpm": mid, "interquartile_range_bpm": high - low, "agreeing_fraction": float(near(bpm).mean()), "octave_split_fraction": float((near(2 * bpm) | near(bpm / 2)).mean())}


def best_bpm(v: np.ndarray, rate: float, o: Options) -> tuple[float, float]:
    """The curve's highest point, whether or not it is a peak."""
    bpm, salience = comb(v, rate, o)
    i = last_max(salience)
    return float(bpm[i]), float(salience[i])


def analyse(v: np.ndarray, low: np.ndarray, rate: float, o: Options) -> dict:
    """The whole tempo record of a broadband and a low-band novelty curve; its findings are rules over this record."""
    v, low = v.astype(np.float32), low.astype(np.float32)
    bpm, salience = comb(v, rate, o)
    _, transform = fourier(v, rate, o)
    curve = acf(v, int(np.ceil(60 * rate / (o.min_bpm - o.resolution))) + 1)
    ranked = candidates(bpm, salience, transform, curve, rate, o)
    plain = None
    if o.centre_bpm is not None:
        plain = candidates(bpm, salience, transform, curve, rate, o.unweighted())
    measured, shift = floored(bpm, salience, ranked[0]["bpm"], o) if ranked else (None, None)
    out = {"bpm": None, "bpm_measured": measured, "salience": 0.0, "octave_shift": shift, "candidates": ranked, "candidates_unweighted": plain, "bpm_unweighted": None, "octave_relatives": [], "grid": None, "bar": None, "over_time": over_time(v, rate, o)}
    out["fourier_bpm"] = float(bpm[last_max(transform)])
    out["curve"] = {"bpm": bpm.tolist(), "comb": salience.tolist(), "fourier": transform.tolist()}
    if measured is None:
        return out | {"stability": stability([], 1.0)}
    final = snapped(measured, o)
    if plain:
        out["bpm_unweighted"] = snapped(floored(bpm, salience, plain[0]["bpm"], o)[0], o)
    beat_grid = align(v, rate, final)
    out |= {"bpm": final, "salience": float(salience_at(bpm, salience, final)), "grid": beat_grid, "bar": bar_phase(beat_grid["beats_seconds"], low, rate)}
    for label, ratio in LEVELS:
        level = beat_grid if ratio == 1.0 else align(v, rate, final * ratio)
        both = [float(salience_at(bpm, s, final * ratio)) for s in (salience, transform)]
        out["octave_relatives"].append({"label": label, "bpm": final * ratio, "salience": both[0], "fourier_salience": both[1], "matched_fraction": level["matched_fraction"], "pulse_ratio": level["pulse_ratio"]})
    return out | {"stability": stability([w["bpm"] for w in out["over_time"]], final)}
