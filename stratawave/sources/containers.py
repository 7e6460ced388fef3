"""Files of recorded messages: sqlite, MCAP and the older bag format, read in parts without a library.

A part of a file is read by one task. ``parts`` gives the parts, ``read`` the messages of a
part as (number, nanoseconds, topic, type, bytes, cursor class), and ``listing`` topics with
types, counts and times.
"""

from __future__ import annotations

import bz2
import sqlite3
import struct
from collections.abc import Iterator
from io import BytesIO

from stratawave.sources.messages import Cursor, Packed

#: First bytes of the formats.
SQLITE_MAGIC, MCAP_MAGIC, BAG_MAGIC = b"SQLite format 3\0", b"\x89MCAP0\r\n", b"#ROSBAG V2.0\n"
#: Numbers of the records of MCAP and of bags that are read here.
MCAP_SCHEMA, MCAP_CHANNEL, MCAP_MESSAGE, MCAP_CHUNK = 3, 4, 5, 6
BAG_MESSAGE, BAG_CHUNK, BAG_CONNECTION = 2, 5, 7


def kind_of(path: str) -> str | None:
    """The format of a file, by its first bytes."""
    with open(path, "rb") as f:
        head = f.read(16)
    return next((k for k, magic in (("sqlite", SQLITE_MAGIC), ("mcap", MCAP_MAGIC), ("bag", BAG_MAGIC)) if head.startswith(magic)), None)


def parts(path: str, rows: int) -> list[tuple[int, int]]:
    """Parts of a file: ranges of message ids of a sqlite file, else ranges of its bytes that hold whole records."""
    kind = kind_of(path)
    if kind == "sqlite":
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            low, high = db.execute("SELECT min(id), max(id) FROM messages").fetchone()
        return [] if low is None else [(a, min(a + rows - 1, high)) for a in range(low, high + 1, rows)]
    if kind is None:
        raise ValueError(f"{path} is no recording")
    # a chunk is a part; messages outside of chunks are parts of up to ``rows``
    out, loose = [], 0
    walk, wanted = (mcap_records, MCAP_MESSAGE) if kind == "mcap" else (bag_records, BAG_MESSAGE)
    chunk = MCAP_CHUNK if kind == "mcap" else BAG_CHUNK
    with open(path, "rb") as f:
        for op, start, end in walk(f):
            if op == chunk:
                out.append((start, end))
                loose = 0
            elif op == wanted:
                if 0 < loose < rows:
                    out[-1] = (out[-1][0], end)
                else:
                    out.append((start, end))
                    loose = 0
                loose += 1
    return out


def read(path: str, first: int, last: int) -> Iterator[tuple]:
    kind = kind_of(path)
    if kind == "sqlite":
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            rows = db.execute("SELECT m.id, m.timestamp, t.name, t.type, m.data FROM messages m JOIN topics t ON t.id = m.topic_id WHERE m.id BETWEEN ? AND ? ORDER BY m.timestamp, m.id", (first, last))
            for number, nanos, topic, name, raw in rows:
                yield number, nanos, str(topic), str(name), bytes(raw), Cursor
    elif kind == "mcap":
        yield from mcap_messages(path, first, last)
    else:
        yield from bag_messages(path, first, last)


def listing(path: str) -> list[tuple]:
    """(topic, type, count, first seconds, last seconds) of a file; topics without messages have 0."""
    kind = kind_of(path)
    if kind == "sqlite":
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            return db.execute("SELECT t.name, t.type, count(m.id), min(m.timestamp) * 1e-9, max(m.timestamp) * 1e-9 FROM topics t LEFT JOIN messages m ON t.id = m.topic_id GROUP BY t.name, t.type").fetchall()
    channels = mcap_channels(path) if kind == "mcap" else bag_connections(path)
    found = {(topic, name): [0, None, None] for topic, name in channels.values()}
    for a, b in parts(path, 1 << 60):
        for _, nanos, topic, name, _, _ in read(path, a, b):
            at = found.setdefault((topic, name), [0, None, None])
            at[0] += 1
            at[1] = nanos if at[1] is None else min(at[1], nanos)
            at[2] = nanos if at[2] is None else max(at[2], nanos)
    return [(topic, name, n, a and a * 1e-9, b and b * 1e-9) for (topic, name), (n, a, b) in found.items()]


# ---- MCAP


def mcap_records(f, start: int = len(MCAP_MAGIC), end: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(number, first byte, byte behind) of the records of an open file; a file that was cut off ends at its last whole record."""
    f.seek(0, 2)
    size = f.tell() if end is None else end
    at = start
    while at + 9 <= size:
        f.seek(at)
        op, length = struct.unpack("<BQ", f.read(9))
        if at + 9 + length > size or op in (2, 15):  # the end of the data
            return
        yield op, at, at + 9 + length
        at += 9 + length


class Fields(Packed):
    """Fields of a record: numbers without padding, texts behind their length."""

    def __init__(self, raw: bytes, at: int = 0):
        super().__init__(raw)
        self.at = at


def unpacked(compression: str, raw: bytes, size: int) -> bytes:
    if compression in ("", "none"):
        return raw
    if compression == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(raw, max_output_size=size)
    if compression == "lz4":
        import pyarrow as pa

        return pa.decompress(raw, decompressed_size=size, codec="lz4", asbytes=True)
    if compression == "bz2":
        return bz2.decompress(raw)
    raise ValueError(f"unknown compression {compression}")


def mcap_chunk(body: bytes) -> bytes:
    c = Fields(body)
    c.take("Q"), c.take("Q")
    size, _ = c.take("Q"), c.take("I")
    compression = c.text()
    return unpacked(compression, c.block(c.take("Q")), size)


def mcap_inside(data: bytes) -> Iterator[tuple[int, bytes]]:
    for op, a, b in mcap_records(BytesIO(data), 0, len(data)):
        yield op, data[a + 9 : b]


def mcap_known(op: int, body: bytes, schemas: dict, channels: dict) -> None:
    """Take in a schema or channel."""
    c = Fields(body)
    if op == MCAP_SCHEMA:
        number = c.take("H")
        schemas[number] = c.text()
    elif op == MCAP_CHANNEL:
        number, schema = c.take("H"), c.take("H")
        topic, encoding = c.text(), c.text()
        channels[number] = (topic, schema, encoding)


def mcap_all_channels(path: str) -> tuple[dict, dict]:
    schemas: dict = {}
    channels: dict = {}
    with open(path, "rb") as f:
        for op, a, b in mcap_records(f):
            if op in (MCAP_SCHEMA, MCAP_CHANNEL, MCAP_CHUNK):
                f.seek(a + 9)
                body = f.read(b - a - 9)
                for inner, raw in mcap_inside(mcap_chunk(body)) if op == MCAP_CHUNK else [(op, body)]:
                    mcap_known(inner, raw, schemas, channels)
    return schemas, channels


def mcap_channels(path: str) -> dict:
    schemas, channels = mcap_all_channels(path)
    return {n: (topic, schemas.get(schema, "")) for n, (topic, schema, _) in channels.items()}


def mcap_messages(path: str, first: int, last: int) -> Iterator[tuple]:
    schemas: dict = {}
    channels: dict = {}
    whole = False
    with open(path, "rb") as f:
        for op, a, b in list(mcap_records(f, first, last)):
            f.seek(a + 9)
            body = f.read(b - a - 9)
            inside = mcap_inside(mcap_chunk(body)) if op == MCAP_CHUNK else [(op, body)]
            for place, (inner, raw) in enumerate(inside):
                if inner != MCAP_MESSAGE:
                    mcap_known(inner, raw, schemas, channels)
                    continue
                channel, _, nanos, _ = struct.unpack_from("<HIQQ", raw)
                if (channel not in channels or channels[channel][1] not in schemas) and not whole:
                    # what is not repeated beside the message stands earlier in the file
                    old_schemas, old_channels = mcap_all_channels(path)
                    schemas, channels, whole = old_schemas | schemas, old_channels | channels, True
                topic, schema, encoding = channels[channel]
                yield a + place, nanos, topic, schemas.get(schema, ""), raw[22:], Packed if encoding == "ros1" else Cursor


# ---- bags


def bag_fields(raw: bytes) -> dict[str, bytes]:
    out, at = {}, 0
    while at < len(raw):
        (n,) = struct.unpack_from("<I", raw, at)
        name, _, value = raw[at + 4 : at + 4 + n].partition(b"=")
        out[name.decode()] = value
        at += 4 + n
    return out


def bag_record(f, at: int, size: int) -> tuple[dict[str, bytes], int, int] | None:
    """Header, first byte and byte behind of the data of a record; None where it is not whole."""
    if at + 4 > size:
        return None
    f.seek(at)
    (n,) = struct.unpack("<I", f.read(4))
    if at + 8 + n > size:
        return None
    head = bag_fields(f.read(n))
    (m,) = struct.unpack("<I", f.read(4))
    start = at + 8 + n
    return None if start + m > size else (head, start, start + m)


def bag_walk(f, at: int, size: int) -> Iterator[tuple[dict[str, bytes], int, int, int]]:
    while (found := bag_record(f, at, size)) is not None:
        head, start, end = found
        yield head, at, start, end
        at = end


def bag_records(f, start: int = len(BAG_MAGIC), end: int | None = None) -> Iterator[tuple[int, int, int]]:
    f.seek(0, 2)
    for head, at, _, behind in bag_walk(f, start, f.tell() if end is None else end):
        yield head["op"][0], at, behind


def bag_chunk(head: dict, body: bytes) -> bytes:
    (size,) = struct.unpack("<I", head["size"])
    return unpacked(head["compression"].decode(), body, size)


def bag_connection(head: dict, body: bytes) -> tuple[int, tuple[str, str]]:
    return struct.unpack("<I", head["conn"])[0], (head["topic"].decode(), bag_fields(body)["type"].decode())


def bag_connections(path: str) -> dict:
    """Connections of a file: behind its chunks they are all repeated; in a file that was cut off they stand in the chunks."""
    out: dict = {}
    with open(path, "rb") as f:
        f.seek(0, 2)
        chunks = []
        for head, _, start, end in bag_walk(f, len(BAG_MAGIC), f.tell()):
            at = f.tell()
            if head["op"][0] == BAG_CONNECTION:
                f.seek(start)
                out.update([bag_connection(head, f.read(end - start))])
            elif head["op"][0] == BAG_CHUNK:
                chunks.append((head, start, end))
            f.seek(at)
        for head, start, end in chunks if not out else []:
            f.seek(start)
            data = bag_chunk(head, f.read(end - start))
            for inner, _, a, b in bag_walk(BytesIO(data), 0, len(data)):
                if inner["op"][0] == BAG_CONNECTION:
                    out.update([bag_connection(inner, data[a:b])])
    return out


def bag_messages(path: str, first: int, last: int) -> Iterator[tuple]:
    connections = None
    with open(path, "rb") as f:
        for head, at, start, end in list(bag_walk(f, first, last)):
            f.seek(start)
            body = f.read(end - start)
            chunk = head["op"][0] == BAG_CHUNK
            data = bag_chunk(head, body) if chunk else body
            inside = bag_walk(BytesIO(data), 0, len(data)) if chunk else [(head, at, 0, len(body))]
            for place, (inner, _, a, b) in enumerate(inside):
                if inner["op"][0] != BAG_MESSAGE:
                    continue
                connections = bag_connections(path) if connections is None else connections
                topic, kind = connections[struct.unpack("<I", inner["conn"])[0]]
                seconds, nanos = struct.unpack("<II", inner["time"])
                yield at + place, seconds * 10**9 + nanos, topic, kind, data[a:b], Packed
