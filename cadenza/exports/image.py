"""A FAT32 volume of a set of files, written from front to back without holding it in memory."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable
from typing import BinaryIO

# Sector and cluster sizes, reserved sectors, the volume's id, the date of everything on it (1980-01-01).
SECTOR, RESERVED, FATS, VOLUME_ID, DATE = 512, 32, 2, 0xDEADBEEF, 0x0021
END, ANNOUNCE = 0x0FFFFFFF, 4 << 20


def image_size(payload: int) -> int:
    """Room for the files, an eighth and 64 MB more, 128 MB at least, in whole sectors."""
    return -(-max(payload * 112 // 100 + (64 << 20), 128 << 20) // SECTOR) * SECTOR


def label(text: str) -> bytes:
    """A volume's name: 11 upper-case characters at most."""
    return "".join(c if c.isascii() and (c.isalnum() or c in " -_") else "_" for c in text.upper())[:11].ljust(11).encode()


def _short(name: str, taken: set[bytes]) -> bytes:
    """A name of 8 and 3 characters that no other entry of the folder has."""
    stem, _, ext = name.upper().rpartition(".") if "." in name.strip(".") else (name.upper(), "", "")
    clean = lambda s: "".join(c if c.isascii() and (c.isalnum() or c in "_-") else "_" for c in s if c not in " .")
    stem, ext = clean(stem) or "_", clean(ext)[:3]
    for n in range(10**6):
        tail = f"~{n}" if n else ""
        short = (stem[: 8 - len(tail)] + tail).ljust(8).encode() + ext.ljust(3).encode()
        if short not in taken and (n or (len(stem) <= 8 and short.decode().replace(" ", "") == name.upper().replace(".", ""))):
            taken.add(short)
            return short
    raise ValueError("too many names alike in one folder")


def _entries(name: str, short: bytes, folder: bool, cluster: int, size: int) -> bytes:
    """A folder's entries for a name: its long form in pieces of 13 units, last piece first, and its short one."""
    check = 0
    for c in short:
        check = ((check >> 1 | (check & 1) << 7) + c) & 255
    units = name.encode("utf-16-le")
    out = []
    if short.decode() != name.upper().replace(".", "").ljust(11) or name != name.upper():
        pieces = [units[i : i + 26] for i in range(0, len(units), 26)]
        for i, piece in enumerate(pieces):
            piece = piece if len(piece) == 26 else (piece + b"\0\0").ljust(26, b"\xff")
            out.append(struct.pack("<B10sBBB12sH4s", i + 1 | (0x40 if i == len(pieces) - 1 else 0), piece[:10], 0x0F, 0, check, piece[10:22], 0, piece[22:]))
    return b"".join(reversed(out)) + _entry(short, folder, cluster, size)


def _entry(short: bytes, folder: bool, cluster: int, size: int) -> bytes:
    return struct.pack("<11sBBBHHHHHHHI", short, 0x10 if folder else 0x20, 0, 0, 0, DATE, DATE, cluster >> 16, 0, DATE, cluster & 0xFFFF, size)


def write_image(out: BinaryIO, files: Iterable[tuple[str, int, Callable[[], Iterable[bytes]]]], name: str = "CADENZA", size: int | None = None, announce: Callable[[int, str], None] | None = None) -> int:
    """Writes the volume and returns its size. files are (path, bytes, chunks): chunks() gives a file's content again.

    Files lie in the order given, so databases that come first are found first. announce is told every ANNOUNCE bytes and
    at each file how many bytes of content are written. A file that gives other than its bytes is an error.
    """
    files = list(files)
    total = image_size(sum(n for _, n, _ in files)) if size is None else size // SECTOR * SECTOR
    per = 1 if total < 260 << 20 else 8 if total < 8 << 30 else 32 if total < 32 << 30 else 64
    sectors = total // SECTOR
    fat = -(-(sectors - RESERVED) // (per * SECTOR // 4 + FATS)) + 1
    clusters = (sectors - RESERVED - FATS * fat) // per
    unit = per * SECTOR
    tree: dict[str, dict[str, tuple]] = {"": {}}
    for i, (path, _, _) in enumerate(files):
        parts = [p for p in path.strip("/").split("/") if p]
        if not parts or len(parts[-1]) > 255:
            raise ValueError(f"no file name: {path!r}")
        for depth in range(1, len(parts)):
            above, here = "/".join(parts[: depth - 1]), "/".join(parts[:depth])
            if tree[above].setdefault(parts[depth - 1], ("folder", here)) != ("folder", here):
                raise ValueError(f"a file and a folder of one name: {here}")
            tree.setdefault(here, {})
        above = tree["/".join(parts[:-1])]
        if parts[-1] in above:
            raise ValueError(f"two files of one name: {path}")
        above[parts[-1]] = ("file", i)
    shorts: dict[str, dict[str, bytes]] = {}
    lengths = {}
    for folder, inside in tree.items():
        taken: set[bytes] = set()
        shorts[folder] = {n: _short(n, taken) for n in inside}
        lengths[folder] = sum(len(_entries(n, s, False, 0, 0)) for n, s in shorts[folder].items()) + (64 if folder else 32)
    at, where, chains = 2, {}, []
    for key, n in [*((("folder", f), n) for f, n in lengths.items()), *((("file", i), n) for i, (_, n, _) in enumerate(files))]:
        count = -(-n // unit)
        where[key] = at if count else 0
        chains.append((at, count))
        at += count
    if at - 2 > clusters:
        raise ValueError(f"{at - 2} clusters are needed, the volume has {clusters}")

    text, free = label(name), clusters - (at - 2)
    boot = struct.pack("<3s8sHBHBHHBHHHIIIHHIHH12xBBBI11s8s", b"\xeb\x58\x90", b"MSWIN4.1", SECTOR, per, RESERVED, FATS, 0, 0, 0xF8, 0, 63, 255, 0, sectors, fat, 0, 0, 2, 1, 6, 0x80, 0, 0x29, VOLUME_ID, text, b"FAT32   ")
    boot = boot.ljust(510, b"\0") + b"\x55\xaa"
    info = struct.pack("<I480xIII12xI", 0x41615252, 0x61417272, free, at, 0xAA550000)
    head = [boot, info, bytes(SECTOR - 2) + b"\x55\xaa"]
    written = 0

    def put(data: bytes) -> None:
        nonlocal written
        out.write(data)
        written += len(data)

    for sector in [*head, *[bytes(SECTOR)] * 3, *head]:
        put(sector)
    put(bytes(RESERVED * SECTOR - written))
    for _ in range(FATS):
        began = written
        put(struct.pack("<II", 0x0FFFFFF8, END))
        for first, count in chains:
            for a in range(first, first + count, 1 << 16):
                b = min(a + (1 << 16), first + count)
                nexts = [*range(a + 1, b + 1)]
                if b == first + count:
                    nexts[-1] = END
                put(struct.pack(f"<{len(nexts)}I", *nexts))
        put(bytes(fat * SECTOR - (written - began)))
    for folder, inside in tree.items():
        body = _entry(b".          ", True, where["folder", folder], 0) + _entry(b"..         ", True, where["folder", folder.rpartition("/")[0]] if "/" in folder else 0, 0) if folder else struct.pack("<11sB20x", text, 8)
        for n, key in inside.items():
            body += _entries(n, shorts[folder][n], key[0] == "folder", where[key], files[key[1]][1] if key[0] == "file" else 0)
        put(body + bytes(-len(body) % unit))
    done = told = 0
    for path, n, chunks in files:
        got = 0
        for chunk in chunks():
            put(chunk)
            got += len(chunk)
            if announce and done + got - told >= ANNOUNCE:
                told = done + got
                announce(told, path)
        if got != n:
            raise ValueError(f"{path} gave {got} bytes, not {n}")
        put(bytes(-n % unit))
        done += n
        if announce:
            announce(done, path)
    step = bytes(1 << 20)
    while written < total:
        put(step[: total - written])
    return total
