"""Recordings made from text: the inverse of the packet source, for data that Spark derives and for tests."""

from __future__ import annotations

import struct
from collections.abc import Iterable

PACKET, BODY = 188, 184
#: Names the one-byte alphabet as set 0 and selects it.
LATIN = b"\x1b\x28\x42\x0f"
CAPTION_TAG = bytes([0xFD, 3, 0x00, 0x08, 0x3D])
#: The flag of an adaptation field and the field, by the bytes that it has beyond its length.
FILLED = [bytes([0x30, n]) + (b"\0" + b"\xff" * (n - 1) if n else b"") for n in range(BODY)]


def packets(pid: int, data: bytes) -> bytes:
    """A unit in packets; the first has the start flag, the last is filled up by an adaptation field."""
    first, more = bytes([0x47, 0x40 | pid >> 8, pid & 255]), bytes([0x47, pid >> 8, pid & 255])
    out = []
    for at in range(0, len(data), BODY):
        part = data[at : at + BODY]
        out += [more if at else first, b"\x10" if len(part) == BODY else FILLED[BODY - 1 - len(part)], part]
    return b"".join(out)


def section(table: int, extension: int, body: bytes, number: int = 0) -> bytes:
    n = len(body) + 9
    return bytes([table, 0xB0 | n >> 8, n & 255]) + struct.pack(">H", extension) + bytes([0xC1, number, 0]) + body + b"\0\0\0\0"


def sections(pid: int, *data: bytes) -> bytes:
    return b"".join(packets(pid, b"\0" + d) for d in data)


def association(programs: Iterable[tuple[int, int]]) -> bytes:
    """A section with the PID of the map of each service."""
    return section(0, 1, b"".join(struct.pack(">HH", service, 0xE000 | pid) for service, pid in programs))


def programme_map(service: int, streams: Iterable[tuple[int, int, bytes]]) -> bytes:
    """A section with (kind, pid, descriptors) of the streams of a service."""
    listed = b"".join(bytes([kind, 0xE0 | pid >> 8, pid & 255, 0xF0, len(d)]) + d for kind, pid, d in streams)
    return section(2, service, b"\xe1\x00\xf0\x00" + listed)


def decimal(x: int) -> int:
    return x // 10 << 4 | x % 10


def event(service: int, title: str, day: int, clock: tuple[int, int, int], episode: int = 0, last: int = 0, number: int = 0) -> bytes:
    """A section with one event: a short ASCII title, its start (Modified Julian day), and the episode if there is one."""
    name = LATIN[:3] + title.encode("ascii")
    loop = bytes([0x4D, len(name) + 5]) + b"jpn" + bytes([len(name)]) + name + b"\0"
    if episode:
        loop += bytes([0xD5, 9, 0, 0, 0, 0, 0, episode >> 4, (episode & 15) << 4 | last >> 8, last & 255, 0])
    start = struct.pack(">H", day) + bytes(map(decimal, clock))
    return section(0x4E, service, b"\0\0\0\0\0\x4e" + b"\0\x01" + start + b"\x00\x30\x00" + struct.pack(">H", len(loop)) + loop, number)


def timed(pts: int, payload: bytes) -> bytes:
    """A PES unit with a time; its length is declared where it fits."""
    t = bytes([0x21 | (pts >> 29 & 0x0E), pts >> 22 & 255, pts >> 14 & 0xFE | 1, pts >> 7 & 255, pts << 1 & 0xFE | 1])
    rest = bytes([0x80, 0x80, len(t)]) + t + payload
    return b"\x00\x00\x01\xbd" + struct.pack(">H", len(rest) if len(rest) < 1 << 16 else 0) + rest


def group(number: int, body: bytes) -> bytes:
    return b"\x80\xff\xf0" + bytes([number << 2, 0, 0]) + struct.pack(">H", len(body)) + body


def management(codes: Iterable[str]) -> bytes:
    """A group that announces languages by their ISO codes."""
    codes = list(codes)
    return group(0, b"\x3f" + bytes([len(codes)]) + b"".join(bytes([i << 5 | 0x0A]) + c.encode() + b"\x80" for i, c in enumerate(codes)) + b"\0\0\0")


def statement(text: bytes, number: int = 1) -> bytes:
    """A group with one statement: text codes in a language by its number."""
    unit = b"\x1f\x20" + len(text).to_bytes(3, "big") + text
    return group(number, b"\x3f" + len(unit).to_bytes(3, "big") + unit)


def wait(tenths: int) -> bytes:
    return bytes([0x9D, 0x20, 0x40 | tenths])
