"""Device files, read back by parsers written for these tests."""

import io
import sqlite3
import struct
import zlib

import numpy as np
import pytest

from cadenza.exports import analysis_files, device, engine, figures, image, settings
from cadenza.operators import waveform


def _text(data, at):
    lead = data[at]
    if lead & 1:
        return data[at + 1 : at + (lead >> 1)].decode()
    size = struct.unpack_from("<H", data, at + 1)[0]
    return data[at + 4 : at + size].decode("ascii" if lead == 0x40 else "utf-16-le")


def _tables(data):
    """{table: rows as (page, offset)} by walking the file's page links."""
    magic, size, count, _, _, _, _ = struct.unpack_from("<7I", data)
    assert magic == 0 and size == 4096 and len(data) % 4096 == 0
    out = {}
    for n in range(count):
        kind, spare, first, last = struct.unpack_from("<4I", data, 28 + 16 * n)
        assert kind == n and last == spare - 1
        rows = out[device.TABLES[n]] = []
        index = data[first * 4096 : first * 4096 + 4096]
        assert struct.unpack_from("<3I", index)[1:] == (first, n)
        for p in range(first + 1, last + 1):
            page = data[p * 4096 : (p + 1) * 4096]
            _, number, table, after, *_ = struct.unpack_from("<6I", page)
            packed = int.from_bytes(page[24:27], "little")
            present, valid = packed & 0x1FFF, packed >> 13
            assert (number, table, after, present) == (p, n, p + 1, valid)
            for row in range(present):
                group, slot = divmod(row, 16)
                at = 4096 - (group + 1) * 36
                assert struct.unpack_from("<H", page, at + 32)[0] >> slot & 1
                place = struct.unpack_from("<H", page, at + 2 * (15 - slot))[0]
                assert place % 4 == 0
                rows.append(page[0x28 + place :])
    return out


def _track(i, **more):
    t = dict(id=i, sample_rate=44100, file_size=1000 + i, key_id=1, bitrate_kbps=1411, centi_bpm=13800, genre_id=0, album_id=0, artist_id=1, duration_rounded=300, format="wav", date="2026-01-02", analyze_path=f"/PIONEER/USBANLZ/P000/{i:08X}/ANLZ0000.DAT", title=f"Title {i}", file_name=f"t{i}.wav", device_path=f"/Contents/t{i}.wav")
    return t | more


def test_pages_hold_all_rows():
    tracks = [_track(i, title="é" * (i % 40) + f" {i}") for i in range(1, 51)]
    data = device.library(tracks, {"artist": ["A", "Bé", "C" * 200], "genre": ["house"], "album": ["one"], "key": ["8A", "11A"]}, [("All tracks", [t["id"] for t in tracks]), ("two", [3, 1])])
    found = _tables(data)
    assert len(found["tracks"]) == 50 and len(found["colors"]) == 8 and len(found["playlist_entries"]) == 52 and found["columns"] == []
    for n, (row, t) in enumerate(zip(found["tracks"], tracks, strict=True)):
        assert struct.unpack_from("<I", row, 0x48)[0] == t["id"] and struct.unpack_from("<I", row, 0x38)[0] == 13800
        offsets = struct.unpack_from("<22H", row, 0x5C)
        assert offsets[0] == 3 and _text(row, offsets[18]) == t["title"] and _text(row, offsets[21]) == t["device_path"] and _text(row, offsets[8]) == "ON"
        assert all(o % 4 == 0 for o in offsets[1:] if row[o] == 0x90), n
    assert [_text(r, r[9]) for r in found["artists"]] == ["A", "Bé", "C" * 200]
    assert [(struct.unpack_from("<II", r), _text(r, 8)) for r in found["keys"]] == [((1, 1), "8A"), ((2, 2), "11A")]
    assert [struct.unpack_from("<3I", r) for r in found["playlist_entries"][-2:]] == [(1, 3, 2), (2, 1, 2)]
    shifts = [struct.unpack_from("<H", r, 2)[0] for r in found["tracks"]]
    assert shifts[:2] == [0, 0x20]
    with pytest.raises(ValueError):
        device.library([_track(1, title="x" * 5000)], {}, [])


def test_strings_of_each_kind():
    assert device.string("") == b"\x03" and device.string("a" * 126)[0] == 255
    assert device.string("a" * 127) == b"\x40" + struct.pack("<HB", 131, 0) + b"a" * 127
    assert device.string("é") == b"\x90" + struct.pack("<HB", 6, 0) + "é".encode("utf-16-le")


def _sections(data):
    assert data[:4] == b"PMAI"
    head, total = struct.unpack_from(">II", data, 4)
    assert total == len(data)
    at, out = head, []
    while at < len(data):
        size = struct.unpack_from(">I", data, at + 8)[0]
        out.append((data[at : at + 4].decode(), data[at + 12 : at + size]))
        at += size
    return out


def _analysed(beats=16, sections=4):
    rng = np.random.default_rng(2)
    columns = np.stack([rng.integers(0, 32, 3000), *(rng.integers(0, 8, 3000) for _ in range(3))], axis=1)
    grid = [{"time_seconds": 0.25 + i * 60 / 138, "bpm": 138.0, "number_in_bar": i % 4 + 1} for i in range(beats)]
    cues = [{"kind": "hot", "number": 4, "comment": "Drop", "time_seconds": 2.5}, {"kind": "memory", "number": 1, "comment": "", "time_seconds": 0.25}]
    labels = ["intro", "build", "drop", "outro"][:sections]
    return {"device_path": "/Contents/ä.wav", "seek_table": [1, 2, 3], "beats": grid, "cues": cues, "sections": [{"label": x, "start_seconds": i * 1.5, "end_seconds": (i + 1) * 1.5} for i, x in enumerate(labels)], "preview": waveform.pack(columns[:1200]), "detail": waveform.pack(columns)}, columns


def test_analysis_files():
    t, columns = _analysed()
    dat, ext, two = (_sections(f(t)) for f in (analysis_files.dat, analysis_files.ext, analysis_files.two_ex))
    assert [k for k, _ in dat] == ["PPTH", "PVBR", "PQTZ", "PWAV", "PWV2", "PCOB", "PCOB"]
    assert [k for k, _ in ext] == ["PPTH", "PWV3", "PCOB", "PCOB", "PCO2", "PCO2", "PQT2", "PWV5", "PWV4", "PSSI"]
    assert [k for k, _ in two] == ["PPTH", "PWV7", "PWV6", "PWVC"]
    assert dat[0][1][4:].decode("utf-16-be") == "/Contents/ä.wav\0"
    assert struct.unpack(">402I", dat[1][1])[:5] == (0, 1, 2, 3, 0)
    count = struct.unpack_from(">3I", dat[2][1])
    assert count == (0, 0x80000, 16)
    times = [struct.unpack_from(">HHI", dat[2][1], 12 + 8 * i) for i in range(16)]
    rest = [struct.unpack_from(">H", ext[6][1], 44 + 2 * i)[0] for i in range(16)]
    for beat, (number, bpm, ms), micro in zip(t["beats"], times, rest, strict=True):
        assert (number, bpm) == (beat["number_in_bar"], 13800) and abs(ms + micro / 1000 - beat["time_seconds"] * 1000) < 6e-4
    height = columns[:, 0] | np.maximum(np.maximum(columns[:, 3], columns[:, 2] - 2), 0) << 5
    assert ext[1][1][12:] == height.astype(np.uint8).tobytes()
    words = np.frombuffer(ext[7][1][12:], ">u2")
    assert np.array_equal(np.stack([words >> 2 & 31, words >> 13, words >> 10 & 7, words >> 7 & 7], axis=1), columns)
    hot = ext[4][1]
    assert struct.unpack_from(">IHH", hot) == (1, 1, 0) and "Drop".encode("utf-16-be") in hot
    body = ext[9][1]
    size, entries = struct.unpack_from(">IH", body)
    plain = bytes(b ^ (analysis_files.MASK[i % 19] + entries & 255) for i, b in enumerate(body[6:]))
    assert (size, entries) == (24, 4) and [struct.unpack_from(">3H", plain, 14 + 24 * i) for i in range(4)] == [(1, 1, 1), (2, 4, 2), (3, 7, 5), (4, 11, 6)]
    assert len(two[1][1]) == 12 + 3 * 3000 and struct.unpack(">4H", two[3][1])[1:] == tuple(np.frombuffer(two[1][1][12:], np.uint8).reshape(-1, 3).max(0).tolist())
    empty = t | {"beats": [], "cues": [], "sections": [], "preview": b"", "detail": b"", "seek_table": None}
    assert [len(_sections(f(empty))) for f in (analysis_files.dat, analysis_files.ext, analysis_files.two_ex)] == [7, 10, 4]


def test_all_column_packings_agree():
    columns = np.stack(np.meshgrid(np.arange(32), np.arange(8), np.arange(8), np.arange(8), indexing="ij"), axis=-1).reshape(-1, 4)
    assert np.array_equal(analysis_files.unpacked(waveform.pack(columns)), columns)


def test_settings_files():
    made = settings.files(quantize="off", language="german", tempo_range="wide")
    assert len(made) == 4
    for path, data in made.items():
        size = struct.unpack_from("<I", data, 100)[0]
        body = data[104 : 104 + size]
        assert data[:4] == b"\x60\0\0\0" and len(data) == 104 + size + 4
        covered = data[: 104 + size] if "DJM" in path else body
        assert struct.unpack_from("<HH", data, 104 + size) == (settings.crc16(covered), 0)
    body = made["PIONEER/MYSETTING.DAT"][104:144]
    assert body[10] == 0x80 and body[12] == 0x83 and body[36] == 0x83
    assert settings.crc16(b"123456789") == 0x31C3  # the checksum's published check value
    with pytest.raises(ValueError):
        settings.files(colour="red")


def _row(i):
    t, _ = _analysed()
    return t | dict(position=i, device_path=f"/Contents/t{i}.wav", file_name=f"t{i}.wav", sample_rate=44100, duration_seconds=300.4, duration_rounded=300, bpm=174.5, bitrate_kbps=1411, file_size=10, title=f"T{i}", artist="A", genre=None, key_camelot=["4A", "8B", "13A"][i % 3], format="wav")


def _unpacked(data):
    size = struct.unpack_from(">I", data)[0]
    plain = zlib.decompress(data[4:])
    assert len(plain) == size
    return plain


def test_the_sql_library(tmp_path):
    rows = [_row(i) for i in range(3)]
    data = engine.build(rows, [("All tracks", [1, 2, 3]), ("two", [2])], "2026-01-02")
    (tmp_path / "m.db").write_bytes(data)
    con = sqlite3.connect(tmp_path / "m.db")
    one = lambda sql: con.execute(sql).fetchall()
    assert one("PRAGMA integrity_check") == [("ok",)] and one("PRAGMA foreign_key_check") == []
    assert one("SELECT count(*) FROM sqlite_master WHERE type = 'trigger'") == [(24,)] and one("SELECT count(*) FROM sqlite_master WHERE type = 'view'") == [(5,)]
    assert one("SELECT count(*) FROM sqlite_master WHERE type = 'index' AND sql IS NOT NULL") == [(16,)]
    assert one("SELECT id, bpm, key, path, originTrackId FROM Track ORDER BY id") == [(1, 175, 17, "../Contents/t0.wav", 1), (2, 175, 0, "../Contents/t1.wav", 2), (3, 175, None, "../Contents/t2.wav", 3)]
    assert one("SELECT DISTINCT originDatabaseUuid = (SELECT uuid FROM Information) FROM Track") == [(1,)]
    assert one("SELECT id, trackId, nextEntityId FROM PlaylistEntity WHERE listId = 1") == [(1000001, 1, 1000002), (1000002, 2, 1000003), (1000003, 3, 0)]
    assert [r[0] for r in one("SELECT path FROM PlaylistPath ORDER BY position")] == ["two;", "All tracks;"]  # the linked list counts from its end
    track, beats, cues, loops, wave = one("SELECT trackData, beatData, quickCues, loops, overviewWaveFormData FROM Track WHERE id = 1")[0]
    assert struct.unpack_from(">dqi", _unpacked(track)) == (44100.0, int(300.4 * 44100), 17)
    plain = _unpacked(beats)
    assert struct.unpack_from(">ddBq", plain) == (44100.0, 300.4 * 44100, 1, 2)
    sample, number, to_next, _ = struct.unpack_from("<dqii", plain, 25)
    assert (number, to_next) == (-4, 20) and sample == pytest.approx(0.25 * 44100 - 4 * 60 / 174.5 * 44100) and len(plain) == 17 + 2 * (8 + 48)
    assert struct.unpack_from(">q", _unpacked(cues)) == (8,) and len(_unpacked(cues)) == 8 + 8 * 13 + 17 and struct.unpack_from("<q", loops) == (8,) and len(loops) == 8 + 8 * 23
    assert struct.unpack_from(">qq", _unpacked(wave)) == (1024, 1024) and len(_unpacked(wave)) == 24 + 3 * 1025
    assert engine.build(rows, [("All tracks", [1, 2, 3]), ("two", [2])], "2026-01-02") == data
    with pytest.raises(sqlite3.IntegrityError):
        con.execute("UPDATE Track SET id = 9 WHERE id = 1")
    con.execute("UPDATE PerformanceData SET loops = x'00' WHERE trackId = 2")
    assert one("SELECT loops FROM Track WHERE id = 2") == [(b"\0",)]
    con.execute("DELETE FROM PlaylistEntity WHERE trackId = 2 AND listId = 1")
    assert one("SELECT nextEntityId FROM PlaylistEntity WHERE id = 1000001") == [(1000003,)]


def _fat(data):
    """{path: bytes} of a FAT32 volume."""
    sector, per, reserved, fats = struct.unpack_from("<HBHB", data, 11)
    size, root = struct.unpack_from("<I", data, 36)[0], struct.unpack_from("<I", data, 44)[0]
    assert data[510:512] == b"\x55\xaa" and data[82:90] == b"FAT32   " and data[:512] == data[6 * 512 : 7 * 512]
    fat = np.frombuffer(data, "<u4", size * sector // 4, reserved * sector)
    assert np.array_equal(fat, np.frombuffer(data, "<u4", size * sector // 4, (reserved + size) * sector))
    start, unit = (reserved + fats * size) * sector, per * sector

    def content(cluster):
        out = b""
        while 2 <= cluster < 0x0FFFFFF8:
            out += data[start + (cluster - 2) * unit : start + (cluster - 1) * unit]
            cluster = int(fat[cluster])
        return out

    def walk(cluster, above):
        body, name, found = content(cluster), "", {}
        for at in range(0, len(body), 32):
            e = body[at : at + 32]
            if e[0] == 0:
                break
            if e[11] == 0x0F:
                units = e[1:11] + e[14:26] + e[28:32]
                name = units.decode("utf-16-le").split("\0")[0].rstrip("￿") + name
                check = 0
                for c in body[at + 32 * (e[0] & 63) : at + 32 * (e[0] & 63) + 11]:
                    check = ((check >> 1 | (check & 1) << 7) + c) & 255
                assert e[13] == check
                continue
            short = (e[:8].decode().rstrip() + ("." + e[8:11].decode().rstrip() if e[8:11].strip() else "")) if e[11] != 8 else ""
            first, length = struct.unpack_from("<H", e, 20)[0] << 16 | struct.unpack_from("<H", e, 26)[0], struct.unpack_from("<I", e, 28)[0]
            own, name = name or short, ""
            if e[11] == 0x10 and own not in (".", ".."):
                found |= walk(first, f"{above}{own}/")
            elif e[11] == 0x20:
                found[above + own] = content(first)[:length]
        return found

    return walk(root, ""), fat, (len(data) - start) // unit


def test_the_volume_holds_all_files():
    rng = np.random.default_rng(1)
    wanted = {"PIONEER/rekordbox/export.pdb": rng.bytes(9000), "PIONEER/MYSETTING.DAT": b"x", "Contents/A long name, with späces.wav": rng.bytes(5_000_000), "Contents/A long name, with other.wav": rng.bytes(512), "Contents/empty.mp3": b"", "Engine Library/Database2/m.db": rng.bytes(4096)}
    wanted |= {f"Contents/many/file number {i}.txt": bytes([i]) for i in range(90)}
    told, out = [], io.BytesIO()
    size = image.write_image(out, [(p, len(d), lambda d=d: iter([d[: len(d) // 2], d[len(d) // 2 :]])) for p, d in wanted.items()], "my stick!", announce=lambda n, p: told.append(n))
    data = out.getvalue()
    found, fat, clusters = _fat(data)
    assert size == len(data) == 128 << 20 and found == wanted and clusters >= 65525
    assert data[71:82] == b"MY STICK_  " and struct.unpack_from("<I", data, 67)[0] == 0xDEADBEEF and told == sorted(told) and told[-1] == sum(map(len, wanted.values()))
    assert struct.unpack_from("<I", data, 512 + 488)[0] == int((fat[2 : clusters + 2] == 0).sum())
    assert image.image_size(10**9) == -(-(1_120_000_000 + (64 << 20)) // 512) * 512
    for bad in ([("a", 1, lambda: [b""])], [("a", 0, lambda: []), ("a", 0, lambda: [])], [("a", 0, lambda: []), ("a/b", 0, lambda: [])]):
        with pytest.raises(ValueError):
            image.write_image(io.BytesIO(), bad)


def test_plots_keep_peaks_and_escape():
    x, y = np.arange(100_000.0), np.zeros(100_000)
    y[54_321] = 7.0
    px, py = figures.pooled(x, y, 1760)
    assert len(px) == 1760 and py.max() == 7 and px[py.argmax()] == 54_321
    text = figures.Plot("a <b> & c", "x", "y", [figures.Line("l", x, y, True)], [(5.0, "m")]).svg()
    assert "a &lt;b&gt; &amp; c" in text and text.count("<polyline") == 1 and "nan" not in text
    assert figures.ticks(0, 1) == pytest.approx([0, 0.2, 0.4, 0.6, 0.8, 1.0]) and figures.ticks(20, 1000, True) == [20, 50, 100, 200, 500, 1000]
    assert figures.bounds([]) == figures.bounds([float("nan"), 3.0]) == (0.0, 1.0)
    bars = figures.bars("t", "y", [("A", 1.0), ("B", -0.5)], 0)
    assert bars.count("<rect") == 3 and figures.LINES[1] in bars


def test_pictures():
    pixels = figures.ramp(np.array([[0.0, 0.5, 1.0], [-1.0, 2.0, 0.2]]))
    data = figures.png(pixels)
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at = data.index(b"IDAT")
    raw = zlib.decompress(data[at + 4 : at + 4 + struct.unpack_from(">I", data, at - 4)[0]])
    assert np.array_equal(np.frombuffer(raw, np.uint8).reshape(2, 10)[:, 1:].reshape(2, 3, 3), pixels)
    assert pixels[0, 0].tolist() == [0, 0, 4] and pixels[0, 2].tolist() == pixels[1, 1].tolist() == [252, 253, 191]
