"""From audio files over reports to a device, end to end on generated tracks; sources of every format."""

import json
import os
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import collection, structure
from cadenza.plans import library
from cadenza.plans.analysis import analyze, spectrograms
from cadenza.sources import audio, flac, mp3
from cadenza.sources.archive import read_archives


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("audio")
    lead = np.zeros(11025, np.float32)
    (root / "Some Artist - One.wav").write_bytes(audio.encode_wav(np.concatenate([lead, audio.click_train(128, 64)]), 44100))
    (root / "two+2 - Zwei é.WAV").write_bytes(audio.encode_wav(audio.mix(audio.click_train(140, 64), audio.chord([57, 60, 64], 64), 0.3), 44100))
    (root / "short.wav").write_bytes(audio.encode_wav(audio.click_train(128, 5), 44100))
    return root


@pytest.fixture(scope="module")
def reports(spark, folder):
    return analyze(audio.read_audio(spark, str(folder))).persist()


def test_reports_survive_their_files(spark, folder, reports, tmp_path):
    made = library.report_json(reports).withColumn("path", F.concat(collection.stem(F.element_at(F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/"), -1)), F.lit(".json")))
    assert library.write_files(made, str(tmp_path), data="json").count() == 2
    (tmp_path / "bad.json").write_text("{]")
    (tmp_path / "other.json").write_text("{}")
    one = json.loads((tmp_path / "Some Artist - One.json").read_text())
    assert one["tool"] == "cadenza" and one["tempo"]["bpm"] == 128 and len(one["key"]["ranked"]) == 24 and one["settings"]["frame_rate"] == 44100 / 512
    assert one["source"]["lead_in_seconds"] == pytest.approx(0.25, abs=0.011) and len(one["tempo"]["grid"]["beats_seconds"]) > 100 and "curve" not in one["tempo"]
    read = {r.stem: r for r in library.read_reports(spark, str(tmp_path)).collect()}
    assert set(read) == {"Some Artist - One", "two+2 - Zwei é", "bad", "other"} and read["bad"].error and read["other"].error and not read["two+2 - Zwei é"].error

    files = audio.audio_files(spark, str(folder), contents=False)
    assert [r.file_name for r in files.collect()] == ["Some Artist - One.wav", "short.wav", "two+2 - Zwei é.WAV"]
    pairs, skipped = library.paired(files, library.read_reports(spark, str(tmp_path)))
    assert [(r.file_name, r.reason) for r in skipped.collect()] == [("short.wav", "no report")]
    rows = {r.file_name: r for r in library.library(pairs).collect()}
    first = rows["Some Artist - One.wav"]
    assert (first.artist, first.title, first.position, first.device_path, first.bitrate_kbps) == ("Some Artist", "One", 0, "/Contents/Some Artist - One.wav", 705)
    grid = one["tempo"]["grid"]["beats_seconds"]
    assert first.beats[0].time_seconds == pytest.approx(grid[0] + one["source"]["analysed_start_seconds"]) and {b.number_in_bar for b in first.beats} == {1, 2, 3, 4}
    cut = {r.file_name: r for r in library.library(pairs, to_first_beat=True).collect()}["Some Artist - One.wav"]
    assert cut.beats[0].time_seconds == pytest.approx(0, abs=1e-9) and cut.trim_seconds == pytest.approx(one["source"]["trim_to_first_beat_seconds"])


def test_a_device_end_to_end(spark, folder, reports, tmp_path):
    made = library.report_json(reports, pretty=False).withColumn("path", F.concat(collection.stem(F.element_at(F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/"), -1)), F.lit(".json")))
    library.write_files(made, str(tmp_path / "reports"), data="json").count()
    root = tmp_path / "device"
    skipped = library.export(spark, str(folder), str(tmp_path / "reports"), str(root), "2026-01-02", to_first_beat=True, language="german")
    assert [r.file_name for r in skipped.collect()] == ["short.wav"]
    found = sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)
    assert len([f for f in found if f.endswith((".DAT", ".EXT", ".2EX")) and "USBANLZ" in f]) == 6 and not [f for f in found if f.endswith(".part")]
    assert {"PIONEER/rekordbox/export.pdb", "Engine Library/Database2/m.db", "PIONEER/MYSETTING.DAT", "PIONEER/DJMMYSETTING.DAT", "Contents/Some Artist - One.wav", "Contents/two+2 - Zwei é.WAV"} <= set(found)
    con = sqlite3.connect(root / "Engine Library/Database2/m.db")
    rows = con.execute("SELECT title, artist, bpm, length, fileBytes FROM Track ORDER BY id").fetchall()
    size = os.path.getsize(root / "Contents/Some Artist - One.wav")
    assert rows[0] == ("One", "Some Artist", 128, 64, size) and size < os.path.getsize(folder / "Some Artist - One.wav") and rows[1][:3] == ("Zwei é", "two+2", 140)
    assert con.execute("SELECT count(*) FROM PlaylistEntity").fetchone() == (2,)
    seconds = len(audio.decode("x.wav", (root / "Contents/Some Artist - One.wav").read_bytes())[2]) / 44100
    assert abs(seconds - 64) < 1
    with pytest.raises(ValueError):
        library.place_audio(reports, str(root), "symlink", to_first_beat=True)


def test_names_figures_and_summaries(spark, folder, reports, tmp_path):
    plan = {r.path.rsplit("/", 1)[1]: r for r in library.rename_plan(reports).collect()}
    one = next(r for k, r in plan.items() if k.startswith("Some"))
    assert one.target.startswith("128_") and one.target.endswith("_Some%20Artist%20-%20One.wav") or one.target.endswith("_Some Artist - One.wav")
    assert plan["short.wav"].target is None and "30 seconds" in plan["short.wav"].reason
    assert [t for _, t in library.rename_files(library.rename_plan(reports).where("path like '%Some%'"), str(tmp_path), "copy")] == os.listdir(tmp_path)
    tracks = audio.read_audio(spark, str(folder)).where("path like '%Some%'")
    drawn = {r.file: bytes(r.bytes) for r in library.report_figures(reports.where("path like '%Some%'"), spectrograms(tracks)).collect()}
    assert list(drawn)[-1] == "report.html" and len(drawn) == 9 and drawn["spectrogram.png"][:4] == b"\x89PNG" and b"128 BPM" in drawn["novelty.svg"]
    assert struct.unpack_from(">II", drawn["spectrogram.png"], 16) == (1600, 440) and drawn["report.html"].count(b"<table>") == 5
    told = {r.path.rsplit("/", 1)[1]: r.summary for r in library.report_summaries(reports).collect()}
    assert "30 seconds" in told["short.wav"] and any(s.startswith("128 BPM") and "pads" in s for s in told.values())


def test_wav_formats_and_trims():
    x = np.array([[0.5, -0.5]] * 100 + [[0.25, 0.25]] * 100)
    wav = audio.encode_wav(x, 8000, 2)
    rate, channels, mono = audio.decode("a.WAV", wav)
    assert (rate, channels) == (8000, 2) and np.allclose(mono[:100], 0, atol=1e-4) and np.allclose(mono[100:], 0.25, atol=1e-4)
    cut = audio.trim_wav(wav[:12] + b"LIST\x03\0\0\0abc\0" + wav[12:], 100 / 8000)
    assert cut[:44] == audio.encode_wav(x[100:], 8000, 2)[:44] and cut[44:] == wav[44 + 400 :]
    assert len(audio.trim_wav(wav[:-50], 0)) == len(wav) - 50 and len(audio.trim_wav(wav, 99)) == 44
    for bad in (b"", b"RIFFxxxxWAVE", wav[:12] + wav[36:]):
        with pytest.raises(audio.AudioError):
            audio.trim_wav(bad, 0)
    wide = np.array([1 << 22, -(1 << 22)], "<i4").astype("<i4")
    packed = b"".join(int(v).to_bytes(3, "little", signed=True) for v in wide.tolist())
    assert np.allclose(audio.decode("a.wav", audio.wav_file(packed, 44100, 1, 24))[2], [0.5, -0.5])
    with pytest.raises(audio.AudioError, match="MP3"):
        audio.decode("a.mp3", b"")


def test_aiff():
    def chunk(name, data):
        return name + struct.pack(">I", len(data)) + data + bytes(len(data) % 2)

    rate = struct.pack(">HQ", 16383 + 15, 44100 << 48)
    body = np.array([16384, -16384, 8192], ">i2").tobytes()
    plain = chunk(b"COMM", struct.pack(">hIh", 1, 3, 16) + rate) + chunk(b"SSND", bytes(8) + body)
    found = audio.decode("a.AIF", b"FORM" + struct.pack(">I", 4 + len(plain)) + b"AIFF" + plain)
    assert found[:2] == (44100, 1) and np.allclose(found[2], [0.5, -0.5, 0.25])
    swapped = chunk(b"COMM", struct.pack(">hIh", 1, 3, 16) + rate + b"sowt\0\0") + chunk(b"SSND", bytes(8) + np.array([16384, -16384, 8192], "<i2").tobytes())
    assert np.allclose(audio.decode("a.aiff", b"FORM" + struct.pack(">I", 4 + len(swapped)) + b"AIFC" + swapped)[2], [0.5, -0.5, 0.25])
    with pytest.raises(audio.AudioError, match="compressed"):
        audio.decode("a.aiff", b"FORM\0\0\0\0AIFC" + chunk(b"COMM", struct.pack(">hIh", 1, 3, 16) + rate + b"ima4\0\0") + chunk(b"SSND", bytes(9)))


def _flac(channels, code, bits=16):
    """A stream of one frame of verbatim subframes, whose channels are given as they are stored."""
    n = len(channels[0])
    head = bytes([0xFF, 0xF8, 0x74, code << 4 | {16: 8, 24: 12}[bits], 0]) + (n - 1).to_bytes(2, "big")
    head += bytes([flac.crc8(head)])
    text = ""
    for c, values in enumerate(channels):
        wide = bits + ((code == 9 and c == 0) or (code in (8, 10) and c == 1))
        text += "00000010" + "".join(f"{v & ((1 << wide) - 1):0{wide}b}" for v in values)
    text += "0" * (-len(text) % 8)
    frame = head + int(text, 2).to_bytes(len(text) // 8, "big")
    frame += int(flac.crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0]).to_bytes(2, "big")
    info = n.to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | (len(channels) - 1) << 41 | (bits - 1) << 36 | n).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80\x00\x00\x22" + info + frame


@pytest.mark.parametrize("bits", [16, 24])
def test_flac_stereo(bits):
    rng = np.random.default_rng(3)
    top = 1 << (bits - 2)
    left, right = rng.integers(-top, top, 70), rng.integers(-top, top, 70)
    side, mid = left - right, (left + right) >> 1
    for code, stored in ((1, (left, right)), (8, (left, side)), (9, (side, right)), (10, (mid, side))):
        info, offsets, blocks = next(flac.decode([_flac([x.tolist() for x in stored], code, bits)]))
        assert (info.channels, info.bits, offsets) == (2, bits, [0]) and np.array_equal(blocks[0], np.stack([left, right])), code
    rate, channels, x = audio.decode("a.flac", _flac([left.tolist(), right.tolist()], 1, bits))
    assert (rate, channels) == (44100, 2) and np.allclose(x, (left + right) / 2 / (1 << (bits - 1)), atol=1e-6)


def _mp3(frames=800, head=b"\xff\xfb\x90\x00", size=417):
    return (head + bytes(size - 4)) * frames


def test_mp3_seek_tables(spark, tmp_path):
    plain = _mp3()
    table = mp3.seek_table(plain)
    assert len(table) == 401 and table[-1] == 921600 and table[:2] == [417, 1251] and table[-2] <= 799 * 417
    tagged = b"ID3\x04\0\0\0\0\x01\x00" + bytes(128) + b"junk" + b"\xff\xfb\x90\x00" + bytes(20) + b"Info" + bytes(417 - 28) + plain
    assert mp3.seek_table(tagged) == table
    assert mp3.seek_table(b"no frames at all") is None and mp3.seek_table(_mp3(1)) is not None
    assert mp3.seek_table(_mp3(4, b"\xff\xf3\x40\xc0", 208))[-1] == 4 * 576
    (tmp_path / "a.mp3").write_bytes(plain)
    (tmp_path / "b.mp3").write_bytes(b"x")
    rows = {r.path.rsplit("/", 1)[1]: r.seek_table for r in mp3.with_seek_tables(spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")).collect()}
    assert rows == {"a.mp3": table, "b.mp3": None}


def test_tracks_of_archives(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("d/a.wav", audio.encode_wav(audio.sine(440, 0.1), 44100))
        z.writestr("d/b.mp3", b"x")
    rows = {r.path: r for r in audio.decoded(read_archives(spark, str(tmp_path)), "file_name").collect()}
    assert len(rows["a.wav"].samples) == 4410 and "MP3" in rows["b.mp3"].error


def test_excerpts_say_when_they_are_beyond(spark):
    tracks = audio.tracks(spark, {"a": audio.sine(440, 1.0)})
    assert len(audio.excerpt(tracks, 0.25, 0.5).first().samples) == 22050
    late = audio.excerpt(tracks, 2.0).first()
    assert late.samples is None and "1.00 s" in late.error


def test_lead_in_of_windows():
    x = np.concatenate([np.zeros(22050), np.ones(100)]).astype(np.float32)
    assert audio.lead_in_seconds(x, 44100) == 0.5 and audio.lead_in_seconds(x[22050:], 44100) == 0 and audio.lead_in_seconds(np.zeros(10, np.float32), 44100) == 0


def _sections(rows):
    return [(i, label, bar, db) for i, (label, bar, db) in enumerate(rows)]


def _cued(spark, rows, bars=128, **more):
    df = spark.createDataFrame([(_sections(rows), [2.0 * i for i in range(bars)], 2.0 * bars)], "sections array<struct<idx:int,label:string,start_bar:int,broadband_db:double>>, bar_starts array<double>, duration_seconds double")
    return structure.place_cues(df, **more).first()


def test_eight_pads_and_memory_cues(spark):
    whole = [("intro", 0, -20.0), ("build", 16, -12.0), ("drop", 32, -5.0), ("breakdown", 64, -18.0), ("drop", 80, -5.0), ("outro", 112, -15.0)]
    r = _cued(spark, whole)
    assert [(c.number, c.bar) for c in r.cues if c.kind == "hot"] == [(1, 0), (2, 32), (3, 16), (4, 32), (5, 64), (6, 80), (7, 112), (8, 36)]
    assert [(c.number, c.bar) for c in r.cues if c.kind == "memory"] == [(1, 0), (2, 32), (3, 16), (4, 48), (5, 64), (6, 96), (7, 36)]
    assert r.missing_pads == [] and not r.drop_rule_relaxed
    early = _cued(spark, [("intro", 0, -20.0), ("drop", 8, -5.0), ("steady", 16, -9.0), ("drop", 64, -6.0), ("outro", 112, -15.0)])
    assert next(c.bar for c in early.cues if c.name == "Drop") == 64 and early.missing_pads == ["C", "E"]
    relaxed = _cued(spark, [("intro", 0, -20.0), ("drop", 8, -5.0), ("outro", 112, -15.0)])
    assert relaxed.drop_rule_relaxed and relaxed.missing_pads == ["C", "E", "F"]
    none = _cued(spark, [])
    assert [(c.kind, c.bar) for c in none.cues] == [("hot", 0), ("memory", 0)] and none.missing_pads == []


def test_cues_of_a_long_track_taken_apart(spark):
    labels = ["intro", *[("steady", "build", "drop", "breakdown")[i % 4] for i in range(1, 149)], "outro"]
    rows = _sections([(label, 8 * i, -20 + 0.01 * i) for i, label in enumerate(labels)])
    df = spark.createDataFrame([(rows, [2.0 * i for i in range(1200)], 2400.0)], "sections array<struct<idx:int,label:string,start_bar:int,broadband_db:double>>, bar_starts array<double>, duration_seconds double")
    found = structure.place_cues(df).select(F.explode("cues").alias("c")).select("c.*")
    # the filter that an explode brings repeats the steps a few times, not once more for every step that uses one
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_min") <= 3
    assert [(c.number, c.bar) for c in found.collect() if c.kind == "hot"] == [(1, 0), (2, 16), (3, 232), (4, 240), (5, 24), (6, 1184), (7, 1192), (8, 20)]


def test_sections_as_loud_but_for_rounding_leave_the_last_special(spark):
    r = _cued(spark, [("intro", 0, -20.0), ("steady", 16, -9.0), ("steady", 48, -9.0 - 1e-13), ("outro", 112, -15.0)])
    assert next(c.bar for c in r.cues if c.name == "Special") == 48


def _bars(spark, groups):
    rows = [(bar, 2.0 * bar, 2.0 * bar + 2, e) for bar, e in enumerate(e for n, e in groups for _ in range(n))]
    return spark.createDataFrame([(0, *r) for r in rows], "track int, bar int, start_seconds double, end_seconds double, energies array<double>")


def test_sections_of_known_bars(spark):
    edges, _ = structure.segmented(_bars(spark, [(16, [0.5, 0.4, 0.01, 0.01]), (16, [0.01, 0.01, 0.4, 0.5])]), ["track"])
    assert [r.bar for r in edges.collect()] == [16]
    assert structure.segmented(_bars(spark, [(48, [0.2, 0.2, 0.2, 0.2])]), ["track"])[0].count() == 0
    loud, quiet, gone = [0.5, 0.5, 0.5, 0.5], [0.1, 0.1, 0.2, 0.2], [0.005, 0.005, 0.2, 0.2]
    rows = _bars(spark, [(16, quiet), *[(1, [0.02 + i * 0.004, 0.02 + i * 0.004, 0.1 + i * 0.02, 0.1 + i * 0.02]) for i in range(16)], (32, loud), (16, gone), (32, loud), (16, quiet)])
    levels = rows.select("track", "bar", "start_seconds", "end_seconds", structure.level_db(F.col("energies"), 2).alias("low_db"), structure.level_db(F.col("energies")).alias("broadband_db"))
    spans = structure.section_spans(spark.createDataFrame([(0, b) for b in (16, 32, 64, 80, 112)], "track int, bar int"), spark.createDataFrame([(0, 128)], "track int, bar_count int"), ["track"])
    labelled = structure.section_labels(structure.section_measures(levels, spans, ["track"]), ["track"]).orderBy("idx").collect()
    assert [r.label for r in labelled] == ["intro", "build", "drop", "breakdown", "drop", "outro"] and all(0 <= r.confidence <= 1 for r in labelled)


def test_numpy_and_columns_find_the_same_sections(spark):
    from cadenza.plans import structure as plain

    rng = np.random.default_rng(8)
    for bars in (10, 16, 40, 90):
        level = np.repeat(rng.choice([0.02, 0.1, 0.5, 0.9], -(-bars // 8)), 8)[:bars, None]
        slots = np.repeat(level * rng.uniform(0.5, 1, (bars, 8)), 20, axis=0)
        starts = np.arange(bars + 1) * 2.0 + 0.03
        energies = plain.bar_energies(slots, starts)
        rows = [(0, i, float(starts[i]), float(starts[i + 1]), e) for i, e in enumerate(energies.tolist())]
        df = spark.createDataFrame(rows, "track int, bar int, start_seconds double, end_seconds double, energies array<double>")
        own = spark.createDataFrame([(0, i, s) for i, s in enumerate(slots.tolist())], "track int, slot int, means array<double>")
        means = structure.bar_means(own, df.drop("energies"), ["track"], 8).orderBy("bar").collect()
        assert np.allclose([r.energies for r in means], energies)
        edges, found = structure.segmented(df, ["track"])
        want = plain.boundaries(plain.novelty(energies))
        assert sorted((r.bar, round(r.strength, 6)) for r in edges.collect()) == [(b, round(s, 6)) for b, s in want]
        for got, exact in zip(found.orderBy("idx").collect(), plain.sections(energies, starts, [b for b, _ in want]), strict=True):
            assert (got.label, got.start_bar, got.bars) == (exact["label"], exact["start_bar"], exact["bars"]) and abs(got.confidence - exact["confidence"]) < 1e-6 and abs(got.rise_db - exact["rise_db"]) < 1e-6
