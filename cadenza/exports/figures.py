"""Plots as SVG, pictures as PNG, one track's page as HTML and its summary as text."""

from __future__ import annotations

import html
import math
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

# The picture's colours from floor to ceiling, and the plots' sizes and colours.
RAMP = [(0.001, 0.000, 0.014), (0.232, 0.060, 0.437), (0.551, 0.161, 0.506), (0.867, 0.288, 0.409), (0.988, 0.646, 0.240), (0.987, 0.991, 0.750)]
WIDTH, HEIGHT, LEFT, RIGHT, TOP, BOTTOM = 960, 360, 64, 16, 32, 44
INK, GRID, LINES, MARK = "#334155", "#e2e8f0", ("#2563eb", "#c2410c", "#7c3aed", "#059669"), "#94a3b8"
NOTES = {
    "spectrogram.svg": ("Spectrogram", "Time against frequency. Level bands are tones, stripes are onsets, a flat top edge is a lossy source's cutoff."),
    "spectrum.svg": ("Average spectrum", "The whole track in one spectrum; the cliff at its right is where content ends."),
    "novelty.svg": ("Novelty and beat grid", "The curve that tempi are measured on, with the grid over it; lines beside the peaks mean a wrong tempo."),
    "tempo-salience.svg": ("Tempo salience", "Both estimators, each scaled to its own peak; peaks at half and double are the octave's decision."),
    "tempo-over-time.svg": ("Tempo by window", "Independent estimates over twenty seconds each; steps of an octave are sections at another feel."),
    "chroma.svg": ("Pitch classes", "The share of energy by note; nearly equal bars carry no key."),
    "key.svg": ("Keys", "How well each key's profile fits the pitch classes."),
}


def bounds(values) -> tuple[float, float]:
    """Least and greatest finite value; 0 to 1 if there are none or they agree."""
    x = np.asarray([v for v in values if v is not None], float)
    x = x[np.isfinite(x)]
    return (float(x.min()), float(x.max())) if len(x) and x.max() - x.min() > 2.3e-16 else (0.0, 1.0)


def ticks(low: float, high: float, log: bool = False) -> list[float]:
    """Round places between two values: 1, 2 and 5 of each decade, or about six even steps of such a size."""
    if log:
        decades = range(math.floor(math.log10(max(low, 1e-6))), math.floor(math.log10(high)) + 1)
        return [m * 10.0**d for d in decades for m in (1, 2, 5) if low <= m * 10.0**d <= high]
    rough = max(abs(high - low), 1e-300) / 6
    size = 10.0 ** math.floor(math.log10(rough))
    step = next(m * size for m in (1, 2, 5, 10) if m * size >= rough * (1 - 1e-12))
    first = math.ceil(low / step - 1e-9)
    return [i * step for i in range(first, math.floor(high / step + 1e-3) + 1)]


def shown(value: float) -> str:
    size = abs(value)
    return f"{value:.0f}" if size >= 10 else f"{value:.1f}" if size >= 1 else f"{value:.2f}"


def pooled(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` points, each the highest of its stretch, so that no peak is lost."""
    if len(x) <= most:
        return x, y
    stretch = np.arange(len(x)) * most // len(x)
    order = np.lexsort((y, stretch))
    last = order[np.flatnonzero(np.r_[np.diff(stretch[order]) > 0, True])]
    return x[last], y[last]


@dataclass
class Line:
    name: str
    x: np.ndarray
    y: np.ndarray
    filled: bool = False


@dataclass
class Plot:
    """A line plot: series, vertical marks as (x, label or None), and an x range and log axis if asked for."""

    title: str
    x_label: str
    y_label: str
    lines: list[Line] = field(default_factory=list)
    marks: list[tuple[float, str | None]] = field(default_factory=list)
    log_x: bool = False
    x_range: tuple[float, float] | None = None

    def svg(self) -> str:
        x0, x1 = self.x_range or bounds(v for s in self.lines for v in s.x)
        y0, y1 = bounds(v for s in self.lines for v in s.y)
        scale = (lambda v: math.log10(max(v, 1e-6))) if self.log_x else float
        wide, high = WIDTH - LEFT - RIGHT, HEIGHT - TOP - BOTTOM
        px = lambda v: LEFT + (scale(v) - scale(x0)) / (scale(x1) - scale(x0)) * wide
        py = lambda v: TOP + high - (v - y0) / (y1 - y0) * high
        out = [_text(LEFT, 20, self.title, "start", 14)]
        for t in ticks(y0, y1):
            out.append(f'<line x1="{LEFT}" y1="{py(t):.1f}" x2="{LEFT + wide}" y2="{py(t):.1f}" stroke="{GRID}"/>' + _text(LEFT - 8, py(t) + 4, shown(t), "end"))
        for t in ticks(x0, x1, self.log_x):
            out.append(_text(px(t), TOP + high + 16, shown(t) if t < 1000 else f"{t / 1000:g}k"))
        for x, label in self.marks:
            if x0 <= x <= x1:
                out.append(f'<line x1="{px(x):.1f}" y1="{TOP}" x2="{px(x):.1f}" y2="{TOP + high}" stroke="{MARK}" stroke-dasharray="4 3"/>' + (_text(px(x), TOP - 2, label) if label else ""))
        for n, s in enumerate(self.lines):
            x, y = np.asarray(s.x, float), np.asarray(s.y, float)
            keep = np.isfinite(x) & np.isfinite(y) & (x >= x0) & (x <= x1)
            x, y = pooled(x[keep], y[keep], 2 * wide)
            points = " ".join(f"{px(a):.1f},{py(b):.1f}" for a, b in zip(x.tolist(), y.tolist(), strict=True))
            if s.filled and len(x):
                out.append(f'<polygon points="{px(x[0]):.1f},{TOP + high} {points} {px(x[-1]):.1f},{TOP + high}" fill="{LINES[n % 4]}" opacity="0.2"/>')
            out.append(f'<polyline points="{points}" fill="none" stroke="{LINES[n % 4]}" stroke-width="1.2"/>' + (_text(LEFT + wide - 4, TOP + 14 + 14 * n, s.name, "end", colour=LINES[n % 4]) if len(self.lines) > 1 else ""))
        return _svg(out, self.x_label, self.y_label)


def bars(title: str, y_label: str, values: list[tuple[str, float]], highlight: int | None = None) -> str:
    """A bar chart from 0, with one bar set off."""
    low, high = bounds(v for _, v in values)
    y0, y1 = min(low, 0.0), max(high, 0.0)
    wide, tall = WIDTH - LEFT - RIGHT, HEIGHT - TOP - BOTTOM
    py = lambda v: TOP + tall - (v - y0) / max(y1 - y0, 1e-300) * tall
    out = [_text(LEFT, 20, title, "start", 14)]
    out += [f'<line x1="{LEFT}" y1="{py(t):.1f}" x2="{LEFT + wide}" y2="{py(t):.1f}" stroke="{GRID}"/>' + _text(LEFT - 8, py(t) + 4, shown(t), "end") for t in ticks(y0, y1)]
    slot = wide / max(1, len(values))
    for i, (label, v) in enumerate(values):
        top, bottom = py(max(v, 0.0)), py(min(v, 0.0))
        out.append(f'<rect x="{LEFT + (i + 0.12) * slot:.1f}" y="{top:.1f}" width="{slot * 0.76:.1f}" height="{max(bottom - top, 0.5):.1f}" fill="{LINES[1] if i == highlight else LINES[0]}"/>' + _text(LEFT + (i + 0.5) * slot, TOP + tall + 16, label))
    return _svg(out, "", y_label)


def _text(x: float, y: float, text: str, anchor: str = "middle", size: int = 11, colour: str = INK) -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" font-size="{size}" fill="{colour}" text-anchor="{anchor}">{html.escape(text)}</text>'


def _svg(parts: list[str], x_label: str, y_label: str, height: int = HEIGHT) -> str:
    labels = _text(LEFT + (WIDTH - LEFT - RIGHT) / 2, height - 10, x_label) if x_label else ""
    labels += f'<text transform="translate(16,{TOP + (height - TOP - BOTTOM) / 2:.1f}) rotate(-90)" font-size="11" fill="{INK}" text-anchor="middle">{html.escape(y_label)}</text>' if y_label else ""
    axes = f'<path d="M{LEFT} {TOP}V{height - BOTTOM}H{WIDTH - RIGHT}" fill="none" stroke="{MARK}"/>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{height}" viewBox="0 0 {WIDTH} {height}" font-family="system-ui, sans-serif"><rect width="{WIDTH}" height="{height}" fill="white"/>{"".join(parts)}{axes}{labels}</svg>\n'


def ramp(level: np.ndarray) -> np.ndarray:
    """[..., 3] bytes of colours for levels from 0 to 1."""
    stops = np.array(RAMP)
    place = np.clip(level, 0, 1) * (len(stops) - 1)
    low = np.minimum(np.floor(place).astype(int), len(stops) - 2)
    mixed = stops[low] + (stops[low + 1] - stops[low]) * (place - low)[..., None]
    return np.floor(np.clip(mixed, 0, 1) * 255 + 0.5).astype(np.uint8)


def png(pixels: np.ndarray) -> bytes:
    """[row, column, 3] bytes as a file."""
    height, width, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def picture(s: dict) -> bytes:
    """A spectrogram row (see plans.analysis.spectrograms) as PNG."""
    values = np.asarray(s["values"], float).reshape(s["height"], s["width"])
    return png(ramp((values - s["floor_db"]) / max(s["ceiling_db"] - s["floor_db"], 1e-300)))


def clock(seconds: float) -> str:
    whole = int(max(0.0, seconds))
    return f"{whole // 60}:{whole % 60:02d}"


def picture_svg(s: dict, href: str, start: float = 0.0, title: str = "Spectrogram") -> str:
    """Axes around a spectrogram's picture."""
    height = 420
    wide, tall = WIDTH - LEFT - RIGHT, height - TOP - BOTTOM
    low, high, seconds = s["low_hz"], s["high_hz"], max(s["seconds"], 1e-300)
    out = [_text(LEFT, 20, title, "start", 14), f'<image href="{html.escape(href)}" x="{LEFT}" y="{TOP}" width="{wide}" height="{tall}" preserveAspectRatio="none"/>']
    for hz in ticks(low, high, log=True):
        y = TOP + tall - math.log10(hz / low) / math.log10(high / low) * tall
        out.append(f'<line x1="{LEFT}" y1="{y:.1f}" x2="{LEFT + wide}" y2="{y:.1f}" stroke="white" opacity="0.25"/>' + _text(LEFT - 8, y + 4, f"{hz:g}" if hz < 1000 else f"{hz / 1000:g}k", "end"))
    step = next((x for x in (1, 5, 10, 15, 30, 60, 120, 300, 600) if seconds / x <= 12), 1200)
    out += [_text(LEFT + (t - start) / seconds * wide, TOP + tall + 16, clock(t)) for t in np.arange(math.ceil(start / step) * step, start + seconds, step).tolist()]
    out.append(_text(LEFT + wide, 20, f"{s['floor_db']:.0f} to {s['ceiling_db']:.0f} dB", "end"))
    return _svg(out, "time", "frequency (Hz)", height)


def format_bpm(bpm: float | None) -> str:
    return "-" if bpm is None else f"{bpm:.0f}" if abs(bpm - math.floor(bpm + 0.5)) < 1e-9 else f"{bpm:.2f}"


def figures(report: dict, spectrogram: dict | None = None, start: float = 0.0, window: float = 30.0) -> dict[str, bytes]:
    """A track's figures by file name, the page that shows them last; a spectrogram only if its row is given."""
    tempo, key, offset, rate = report["tempo"], report["key"], report["source"]["analysed_start_seconds"] or 0.0, report["settings"]["frame_rate"]
    out: dict[str, bytes] = {}
    if spectrogram:
        out["spectrogram.png"] = picture(spectrogram)
        out["spectrogram.svg"] = picture_svg(spectrogram, "spectrogram.png", offset).encode()
    amplitude = np.asarray(report["average_spectrum"], float)
    hz = np.arange(1, len(amplitude) + 1) * report["source"]["sample_rate"] / report["settings"]["window_size"]
    out["spectrum.svg"] = Plot("Long-term average spectrum", "frequency (Hz)", "level (dB)", [Line("average", hz, 20 * np.log10(np.maximum(amplitude, 1e-10)))], log_x=True, x_range=(20.0, float(hz[-1]))).svg().encode()
    v = np.asarray(report["novelty"], float)
    first = int(max(0.0, start - offset) * rate)
    part = v[first : first + int(window * rate)]
    beats = [offset + b for b in (tempo["grid"]["beats_seconds"] if tempo["grid"] else [])]
    out["novelty.svg"] = Plot(f"Onset novelty and the {format_bpm(tempo['bpm'])} BPM grid", "time (s)", "novelty", [Line("novelty", offset + (first + np.arange(len(part))) / rate, part, True)], [(b, None) for b in beats if start <= b <= start + window]).svg().encode()
    curve = {k: np.asarray(x, float) for k, x in tempo["curve"].items()}
    lines = [Line("autocorrelation comb", curve["bpm"], curve["comb"] / max(curve["comb"].max(), 1e-300)), Line("Fourier tempogram", curve["bpm"], curve["fourier"])]
    out["tempo-salience.svg"] = Plot("Tempo salience", "tempo (BPM)", "salience (peak = 1)", lines, [(c["bpm"], f"{c['bpm']:.1f}") for c in tempo["candidates"]]).svg().encode()
    if tempo["over_time"]:
        x, y = (np.array([w[k] for w in tempo["over_time"]]) for k in ("start_seconds", "bpm"))
        out["tempo-over-time.svg"] = Plot("Tempo per window", "time (s)", "tempo (BPM)", [Line("window estimate", offset + x, y)], [(offset, f"reported {format_bpm(tempo['bpm'])}")]).svg().encode()
    names = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
    out["chroma.svg"] = bars("Pitch classes", "share", list(zip(names, key["chroma"], strict=True)), key["key"]["tonic"]).encode()
    out["key.svg"] = bars("Key correlation", "correlation", [(k["camelot"], k["correlation"]) for k in key["ranked"]], 0).encode()
    out["report.html"] = page(report, out).encode()
    return out


def _table(caption: str, heads: list[str], rows: list[list[str]]) -> str:
    cells = lambda tag, row: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in row) + "</tr>"
    return f"<h2>{html.escape(caption)}</h2><table>{cells('th', heads)}{''.join(cells('td', r) for r in rows)}</table>"


def page(report: dict, made: dict[str, bytes]) -> str:
    """The track's page: findings, tables of candidates, relatives, bands, keys and the spectrum, and the figures."""
    tempo, key, spectrum = report["tempo"], report["key"], report["spectrum"]
    found = "".join(f'<li class="{f["severity"]}"><b>{html.escape(f["code"])}</b> {html.escape(f["message"])}</li>' for f in report["findings"])
    tables = [
        _table("Candidates", ["BPM", "salience", "weighted", "autocorrelation", "Fourier"], [[f"{c['bpm']:.2f}", *(f"{c[k]:.3f}" for k in ("salience", "weighted_salience", "autocorrelation", "fourier_salience"))] for c in tempo["candidates"]]),
        _table("Octave relatives", ["level", "BPM", "salience", "Fourier", "matched", "pulse"], [[r["label"], f"{r['bpm']:.2f}", f"{r['salience']:.3f}", f"{r['fourier_salience']:.3f}", f"{r['matched_fraction'] * 100:.0f}%", f"{r['pulse_ratio']:.2f}x"] for r in tempo["octave_relatives"]]),
        _table("Bands", ["band", "Hz", "BPM", "salience"], [[str(b["band"]), f"{b['low_hz']:.0f}-{b['high_hz']:.0f}", f"{b['bpm']:.2f}", f"{b['salience']:.3f}"] for b in report["bands"]]),
        _table("Keys", ["key", "name", "correlation"], [[k["camelot"], k["name"], f"{k['correlation']:.3f}"] for k in key["ranked"][:6]]),
        _table("Spectrum", ["measure", "value"], [[k, f"{v:.3f}" if k.endswith("share") else f"{v:.0f} Hz"] for k, v in spectrum.items()]),
    ]
    shown_ = "".join(f'<figure><figcaption><b>{html.escape(NOTES[n][0])}</b> {html.escape(NOTES[n][1])}</figcaption>{data.decode() if n != "spectrogram.svg" else f"<img src={chr(34)}{n}{chr(34)}>"}</figure>' for n, data in made.items() if n in NOTES)
    title = html.escape(str(report["source"]["path"]).rsplit("/", 1)[-1])
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{title}</title><style>body{{font-family:system-ui,sans-serif;max-width:60rem;margin:2rem auto}}td,th{{padding:.2rem .8rem;text-align:left}}.warning{{color:#b91c1c}}</style><h1>{title}</h1><p>{format_bpm(tempo["bpm"])} BPM, {html.escape(key["camelot"])} ({html.escape(key["name"])})</p><ul>{found}</ul>{"".join(tables)}{shown_}</html>\n'


def summary(report: dict) -> str:
    """A few lines for a terminal: tempo and key, the grid, windows, rivals, sections, pads and findings."""
    if report.get("error"):
        return f"{report['path']}: {report['error']}\n"
    t, source = report["tempo"], report["source"]
    out = [f"{format_bpm(t['bpm'])} BPM   {report['key']['camelot']}   {clock(source['analysed_seconds'] + 0.5)} analysed"]
    if t["grid"]:
        if abs(t["bpm"] - t["bpm_measured"]) >= 0.005:
            out.append(f"  measured  {t['bpm_measured']:.2f} BPM, {t['bpm'] - t['bpm_measured']:+.2f} to the whole number")
        g, s = t["grid"], t["stability"]
        out.append(f"  grid      {g['matched_fraction'] * 100:.0f}% of beats within {g['tolerance_ms']:.0f} ms, pulse {g['pulse_ratio']:.2f}x, bar phase {t['bar']['phase'] + 1} (contrast {t['bar']['contrast']:.2f})")
        if s["median_bpm"] is not None:
            out.append(f"  windows   median {s['median_bpm']:.2f} BPM, spread {s['interquartile_range_bpm']:.2f} BPM, {s['agreeing_fraction'] * 100:.0f}% agree")
        levels = [f"{format_bpm(r['bpm'])} {r['matched_fraction'] * 100:.0f}%/{r['pulse_ratio']:.1f}x" for r in t["octave_relatives"] if r["label"] != "candidate" and r["pulse_ratio"] > 0]
        others = [f"{c['bpm']:.2f} ({c['salience']:.2f})" for c in t["candidates"] if abs(c["bpm"] - t["bpm"]) > 1][:3]
        out += [f"  levels    {', '.join(levels)}"] * bool(levels) + [f"  also      {', '.join(others)}"] * bool(others)
    for s in (report["structure"] or {}).get("sections", []):
        out.append(f"  {clock(s['start_seconds']):9} {s['label']:10} bar {s['start_bar']:<4} conf {s['confidence'] * 100:3.0f}%  kick {s['low_db']:6.1f} dB  band {s['broadband_db']:6.1f} dB")
    pads = [f"{chr(64 + c['number'])}={clock(c['time_seconds'])} {c['name']}" for c in (report["structure"] or {}).get("cues", []) if c["kind"] == "hot"]
    out += [f"  pads      {', '.join(pads)}"] * bool(pads)
    out += [f"  {'!' if f['severity'] == 'warning' else '-'} {f['code']}: {f['message']}" for f in report["findings"]]
    return "\n".join(out) + "\n"
