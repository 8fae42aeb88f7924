import os

import pytest

from cadenza import __main__ as commands
from cadenza.plans.options import Options
from cadenza.sources import audio


def test_flags_are_the_options():
    args = commands.parser().parse_args(["analyze", "in", "out", "--min-bpm", "90", "--no-trim-lead-in", "--tuning-cents", "12"])
    o = commands.options(args)
    assert (o.min_bpm, o.trim_lead_in, o.tuning_cents, o.profile) == (90.0, False, 12.0, "temperley")
    assert commands.options(commands.parser().parse_args(["rename", "in"])) == Options()


def test_dates(monkeypatch):
    monkeypatch.setenv("SOURCE_DATE_EPOCH", "86400")
    assert commands.export_date(None) == "1970-01-02" and commands.export_date("2026-02-28") == "2026-02-28"
    with pytest.raises(ValueError):
        commands.export_date("2026-02-30")


def test_commands_end_to_end(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A - B.wav").write_bytes(audio.encode_wav(audio.click_train(128, 50), 44100))
    (tmp_path / "in" / "short.wav").write_bytes(audio.encode_wav(audio.click_train(128, 5), 44100))
    given, out, device = (str(tmp_path / n) for n in ("in", "out", "device"))
    assert commands.main(["analyze", given, out]) == 1  # one track is too short
    said = capsys.readouterr().out
    assert "128 BPM" in said and "30 seconds" in said
    assert sorted(os.listdir(out)) == ["A - B", "A - B.json"] and "report.html" in os.listdir(f"{out}/A - B")
    assert commands.main(["rename", given]) == 0 and "-> 128_" in capsys.readouterr().out
    assert commands.main(["export", given, out, device, "--date", "2026-01-02", "--target", "sql", "--audio", "symlink"]) == 0
    assert "skipped short.wav: no report" in capsys.readouterr().err
    assert os.path.islink(f"{device}/Contents/A - B.wav") and os.path.exists(f"{device}/Engine Library/Database2/m.db") and not os.path.exists(f"{device}/PIONEER")
    assert commands.main(["selftest", "140"]) == 0
