"""The players' settings files."""

from __future__ import annotations

import struct

# Fixed values of the format: every setting's choices in the order of their codes, from the code given first, and its
# default.
CHOICES = {
    "quantize": (0x80, ("off", "on"), "on"), "quantize_beat_value": (0x80, ("1", "1/2", "1/4", "1/8"), "1"), "hotcue_autoload": (0x80, ("off", "on", "rekordbox"), "rekordbox"),
    "hotcue_colour": (0x80, ("off", "on"), "on"), "auto_cue": (0x80, ("off", "on"), "on"), "auto_cue_level": (0x80, ("-36", "-42", "-48", "-54", "-60", "-66", "-72", "-78", "memory"), "memory"),
    "time_mode": (0x80, ("elapsed", "remain"), "remain"), "jog_mode": (0x80, ("cdj", "vinyl"), "vinyl"), "tempo_range": (0x80, ("6", "10", "16", "wide"), "16"), "master_tempo": (0x80, ("off", "on"), "off"),
    "sync": (0x80, ("off", "on"), "off"), "play_mode": (0x80, ("continue", "single"), "single"), "phase_meter": (0x80, ("type1", "type2"), "type1"),
    "language": (0x81, ("english", "french", "german", "italian", "dutch", "spanish", "russian", "korean", "chinese-simplified", "chinese-traditional", "japanese", "portuguese", "swedish", "czech", "hungarian", "danish", "greek", "turkish"), "english"),
    "lcd_brightness": (0x81, ("1", "2", "3", "4", "5"), "3"), "waveform": (0x80, ("waveform", "phase-meter"), "waveform"), "waveform_divisions": (0x80, ("time-scale", "phrase"), "phrase"),
    "jog_display_mode": (0x80, ("auto", "info", "simple", "artwork"), "auto"), "beat_jump": (0x80, ("1/2", "1", "2", "4", "8", "16", "32", "64"), "16"), "vinyl_speed_adjust": (0x80, ("touch-release", "touch", "release"), "touch"),
    "jog_lcd_brightness": (0x81, ("1", "2", "3", "4", "5"), "3"),
}
MARK_2, MARK_1 = bytes.fromhex("7856341202000000"), bytes.fromhex("7856341201000000")
# The two files' bodies as bytes, in which a name stands for the code of that setting.
MY_SETTING = [
    *MARK_2, 0x81, "lcd_brightness", "quantize", "auto_cue_level", "language", 1, 0x82, 0x81, 0x81, 1, 1, 1, 0x82, 0x81, "sync", "play_mode", "quantize_beat_value", "hotcue_autoload",
    "hotcue_colour", 0, 0, 0x81, 0, 0, "time_mode", "jog_mode", "auto_cue", "master_tempo", "tempo_range", "phase_meter", 0, 0,
]
MY_SETTING_2 = ["vinyl_speed_adjust", "jog_display_mode", 0x83, "jog_lcd_brightness", "waveform_divisions", 0, 0, 0, 0, 0, "waveform", 0x81, "beat_jump", *[0] * 27]
DEV_SETTING = MARK_1 + bytes([1, 2, 3, 1, 2, 1]) + bytes(18)
DJM_SETTING = MARK_1 + bytes([0x20, 0, 0, 0, 0x81, 0x82, 0x80, 0x80, 0x81, 0x81, 0x80, 0x81, 0x80, 0x80, 0x85, 0x82, 0x80, 0x80, 0x82, 0x84, 0x81, 0x81]) + bytes(22)


def code(name: str, choice: str | None = None) -> int:
    first, choices, default = CHOICES[name]
    return first + choices.index(default if choice is None else choice)


def crc16(data: bytes) -> int:
    """The checksum with polynomial 0x1021 from 0, high bits first."""
    crc = 0
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ (0x1021 if crc & 0x8000 else 0)) & 0xFFFF
    return crc


def _file(brand: str, version: str, data: bytes, whole: bool = False) -> bytes:
    texts = b"".join(x.encode()[:31].ljust(32, b"\0") for x in (brand, "rekordbox", version))
    out = struct.pack("<I", 0x60) + texts + struct.pack("<I", len(data)) + data
    return out + struct.pack("<HH", crc16(out if whole else data), 0)


def files(**choices: str) -> dict[str, bytes]:
    """The four files by path, with the defaults but for the choices."""
    unknown = set(choices) - set(CHOICES)
    if unknown:
        raise ValueError(f"no such settings: {', '.join(sorted(unknown))}")
    body = lambda form: bytes(x if isinstance(x, int) else code(x, choices.get(x)) for x in form)
    return {
        "PIONEER/MYSETTING.DAT": _file("PIONEER", "0.001", body(MY_SETTING)), "PIONEER/MYSETTING2.DAT": _file("PIONEER", "0.001", body(MY_SETTING_2)),
        "PIONEER/DEVSETTING.DAT": _file("PIONEER DJ", "6.7.7", DEV_SETTING), "PIONEER/DJMMYSETTING.DAT": _file("PioneerDJ", "1.000", DJM_SETTING, whole=True),
    }
