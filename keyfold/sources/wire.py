"""Log entries as bytes: a 4-byte big-endian length and a protocol-buffer message.

The message holds field 1 (set: key 1, value 2, clock 3, node 4) or field 2 (delete: key 1, clock 2, node 3). Fields with
default values are absent, so a null and an empty payload both come back empty, and so does a null node id.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

# Field numbers of the two kinds of entry.
_SET = {"key": 1, "value": 2, "ts": 3, "node_id": 4}
_DEL = {"key": 1, "ts": 2, "node_id": 3}


class CorruptLog(ValueError):
    """A log that ends within an entry, or an entry that isn't one."""


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | None) -> bytes:
    if not value:
        return b""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def encode_entry(op: str, key: str, value: bytes | None, ts: int | None, node_id: str | None) -> bytes:
    """The message without its length."""
    fields, kind = (_SET, 1) if op == "set" else (_DEL, 2)
    have = {"key": (key or "").encode(), "value": value, "ts": ts, "node_id": (node_id or "").encode()}
    body = b"".join(_field(n, have[f]) for f, n in fields.items())
    return _varint(kind << 3 | 2) + _varint(len(body)) + body


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(b) or shift > 63:
            raise CorruptLog("a number ends early")
        n |= (b[at] & 0x7F) << shift
        at += 1
        if b[at - 1] < 0x80:
            return n & ((1 << 64) - 1), at
        shift += 7


def _fields(b: bytes) -> dict[int, bytes | int]:
    out: dict[int, bytes | int] = {}
    at = 0
    while at < len(b):
        tag, at = _read_varint(b, at)
        if tag & 7 == 0:
            out[tag >> 3], at = _read_varint(b, at)
        elif tag & 7 == 2:
            n, at = _read_varint(b, at)
            if at + n > len(b):
                raise CorruptLog("a field ends early")
            out[tag >> 3], at = b[at : at + n], at + n
        else:
            raise CorruptLog(f"unknown wire type {tag & 7}")
    return out


def decode_entry(b: bytes) -> tuple[str, str, bytes | None, int, str]:
    """``op, key, value, ts, node_id`` of a message; raises CorruptLog."""
    top = _fields(b)
    kind = 1 if isinstance(top.get(1), bytes) else 2
    if not isinstance(top.get(kind), bytes):
        raise CorruptLog("neither a set nor a delete")
    names, f = (_SET, _fields(top[1])) if kind == 1 else (_DEL, _fields(top[2]))
    text = lambda name: (f.get(names[name]) or b"").decode("utf-8")
    try:
        key, node = text("key"), text("node_id")
        ts = f.get(names["ts"], 0)
        value = f.get(_SET["value"], b"") if kind == 1 else None
        if not isinstance(ts, int) or isinstance(value, int):
            raise CorruptLog("a field of the wrong kind")
    except (UnicodeDecodeError, AttributeError) as e:
        raise CorruptLog(str(e)) from e
    return ("set" if kind == 1 else "del"), key, value, ts - (1 << 64) if ts >> 63 else ts, node


def frame(message: bytes) -> bytes:
    return struct.pack(">I", len(message)) + message


def frames(f: BinaryIO) -> Iterator[bytes]:
    """Messages of a stream up to its clean end; one that ends within a frame raises CorruptLog."""
    while head := f.read(4):
        if len(head) < 4:
            raise CorruptLog("a length ends early")
        n = struct.unpack(">I", head)[0]
        body = f.read(n)
        if len(body) < n:
            raise CorruptLog("an entry ends early")
        yield body
