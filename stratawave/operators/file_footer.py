"""Parquet footers: read, change and write them without touching the encoded blocks.

The footer is one struct in Thrift's compact protocol. It is held here as nested Python
values, each field as [id, type, value], so that fields this code does not know survive.
"""

from __future__ import annotations

import struct

MAGIC = b"PAR1"
#: Fixed values of the compact protocol.
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def integer(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int):
        if kind in (TRUE, FALSE):
            return kind == TRUE
        if kind == BYTE:
            self.at += 1
            return struct.unpack_from("<b", self.data, self.at - 1)[0]
        if kind in (I16, I32, I64):
            return self.integer()
        if kind == DOUBLE:
            self.at += 8
            return struct.unpack_from("<d", self.data, self.at - 8)[0]
        if kind == BINARY:
            n = self.varint()
            self.at += n
            return self.data[self.at - n : self.at]
        if kind in (LIST, SET):
            head = self.data[self.at]
            self.at += 1
            n, of = head >> 4, head & 15
            if n == 15:
                n = self.varint()
            if of in (TRUE, FALSE):  # elements are bytes of their own
                self.at += n
                return of, [b == TRUE for b in self.data[self.at - n : self.at]]
            return of, [self.value(of) for _ in range(n)]
        if kind == MAP:
            n = self.varint()
            kinds = self.data[self.at] if n else 0
            self.at += bool(n)
            return kinds, [(self.value(kinds >> 4), self.value(kinds & 15)) for _ in range(n)]
        if kind == STRUCT:
            fields, last = [], 0
            while head := self.data[self.at]:
                self.at += 1
                last = last + (head >> 4) if head >> 4 else self.integer()
                fields.append([last, head & 15, self.value(head & 15)])
            self.at += 1
            return fields
        raise ValueError(f"unknown type {kind} in a footer")


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def integer(n: int) -> bytes:
    return varint((n << 1) ^ (n >> 63))


def list_head(of: int, n: int) -> bytes:
    return bytes([n << 4 | of]) if n < 15 else bytes([0xF0 | of]) + varint(n)


def encoded_list(of: int, items: list[bytes]) -> bytes:
    """A list of elements that are encoded already; it can stand as the value of a field."""
    return list_head(of, len(items)) + b"".join(items)


def encoded(kind: int, value) -> bytes:
    if kind in (TRUE, FALSE):
        return b""
    if kind == BYTE:
        return struct.pack("<b", value)
    if kind in (I16, I32, I64):
        return integer(value)
    if kind == DOUBLE:
        return struct.pack("<d", value)
    if kind == BINARY:
        return varint(len(value)) + value
    if kind in (LIST, SET):
        if isinstance(value, bytes):  # encoded already, see encoded_list
            return value
        of, items = value
        head = list_head(of, len(items))
        if of in (TRUE, FALSE):
            return head + bytes(TRUE if x else FALSE for x in items)
        return head + b"".join(encoded(of, x) for x in items)
    if kind == MAP:
        kinds, items = value
        return varint(len(items)) + (bytes([kinds]) if items else b"") + b"".join(encoded(kinds >> 4, k) + encoded(kinds & 15, v) for k, v in items)
    if kind == STRUCT:
        out, last = [], 0
        for number, of, x in value:
            if of in (TRUE, FALSE):
                of = TRUE if x else FALSE
            step = number - last
            out.append(bytes([step << 4 | of]) if 0 < step < 16 else bytes([of]) + integer(number))
            out.append(encoded(of, x))
            last = number
        return b"".join(out) + b"\0"
    raise ValueError(f"unknown type {kind}")


def get(fields: list, number: int, default=None):
    return next((f[2] for f in fields if f[0] == number), default)


def put(fields: list, number: int, kind: int, value) -> None:
    for f in fields:
        if f[0] == number:
            f[2] = value
            return
    fields.append([number, kind, value])
    fields.sort(key=lambda f: f[0])


def drop(fields: list, *numbers: int) -> None:
    fields[:] = [f for f in fields if f[0] not in numbers]


def read_footer(handle) -> list:
    """The footer of an open Parquet file, as nested fields."""
    handle.seek(0, 2)
    end = handle.tell()
    if end < 12:
        raise ValueError("too short for a Parquet file")
    handle.seek(end - 8)
    tail = handle.read(8)
    if tail[4:] != MAGIC:
        raise ValueError("not a Parquet file, or one with an encrypted footer")
    size = struct.unpack("<I", tail[:4])[0]
    handle.seek(end - 8 - size)
    return Reader(handle.read(size)).value(STRUCT)


# numbers of the fields used, by struct: file 2 schema, 3 rows, 4 row groups; row group 1 columns, 3 rows, 5 offset, 6 bytes, 7 ordinal;
# column 2 offset, 3 metadata, 4 to 7 page indexes; metadata 7 bytes, 9 data, 10 index and 11 dictionary page, 14 and 15 bloom filter


def schema_of(footer: list) -> bytes:
    """The schema as bytes: blocks of files whose bytes agree can share a file."""
    return encoded(LIST, get(footer, 2))


def span(column: list) -> tuple[int, int]:
    """Offset and length of a column's encoded pages."""
    meta = get(column, 3)
    starts = [x for x in (get(meta, 9), get(meta, 10), get(meta, 11)) if x]
    return min(starts), get(meta, 7)


def moved(row_group: list, offsets: list[int], ordinal: int) -> list:
    """The row group with its columns at ``offsets``; page indexes and bloom filters, which stay behind, are left out."""
    for column, to in zip(get(row_group, 1)[1], offsets):
        by = to - span(column)[0]
        meta = get(column, 3)
        for number in (9, 10, 11):
            if get(meta, number):
                put(meta, number, I64, get(meta, number) + by)
        drop(meta, 14, 15)
        drop(column, 1, 4, 5, 6, 7)
        put(column, 2, I64, 0)
    put(row_group, 5, I64, offsets[0] if offsets else 4)
    put(row_group, 7, I16, ordinal) if ordinal < 2**15 else drop(row_group, 7)
    return row_group


#: How the least and largest value of a physical type are held, by the type's number.
ORDERED = {1: "<i", 2: "<q", 4: "<f", 5: "<d"}
#: The number of byte arrays among the physical types; of the converted types texts, dates and times, which keep the order of their physical type.
BYTES, PLAINLY_ORDERED = 6, (0, 6, 7, 8, 9, 10)


class Joined:
    """A block made of the pages of many: what it holds so far, by column."""

    def __init__(self, like: list, ordered: list[bool]):
        self.like, self.kind, self.ordered = like, kind_of(like), ordered
        columns = get(like, 1)[1]
        self.pages: list[list] = [[] for _ in columns]
        self.values, self.raw, self.sizes = ([0] * len(columns) for _ in range(3))
        self.bounds: list = [None] * len(columns)
        self.rows = self.bytes = 0

    def takes(self, other: list) -> bool:
        return other is self.like or kind_of(other) == self.kind

    def add(self, rows: int, pages: list, counts: list[tuple[int, int]], statistics: list | None) -> None:
        first = not self.rows
        for i, (page, (values, raw)) in enumerate(zip(pages, counts)):
            self.pages[i].append(page)
            self.values[i] += values
            self.raw[i] += raw
            self.sizes[i] += len(page)
            self.bytes += len(page)
        if statistics is not None:
            for i, found in enumerate(statistics):
                self.bounds[i] = found if first else wider(self.bounds[i], found, self.kind[i][0], self.ordered[i])
        self.rows += rows

    def row_group(self, at: int, ordinal: int) -> list:
        """The block's metadata, with its first page at ``at``."""
        columns = []
        for i, column in enumerate(get(self.like, 1)[1]):
            meta = [list(f) for f in get(column, 3) if f[0] in (1, 2, 3, 4)]
            for number, kind, x in ((5, I64, self.values[i]), (6, I64, self.raw[i]), (7, I64, self.sizes[i]), (9, I64, at)):
                put(meta, number, kind, x)
            if self.bounds[i]:
                put(meta, 12, STRUCT, self.bounds[i])
            columns.append([[2, I64, 0], [3, STRUCT, meta]])
            at += self.sizes[i]
        out = [[1, LIST, (STRUCT, columns)], [2, I64, sum(self.raw)], [3, I64, self.rows], [5, I64, at - self.bytes], [6, I64, self.bytes]]
        return out + [[7, I16, ordinal]] if ordinal < 2**15 else out


def kind_of(row_group: list) -> list[tuple]:
    """What blocks must share for their pages to follow each other: type, path, codec and encodings of the columns."""
    metas = [get(column, 3) for column in get(row_group, 1)[1]]
    return [(get(m, 1), tuple(get(m, 3)[1]), get(m, 4), tuple(get(m, 2)[1])) for m in metas]


def ordered_columns(footer: list) -> list[bool]:
    """For each column of values, whether the order of its values is that of its physical type."""
    leaves = [e for e in get(footer, 2)[1] if not get(e, 5)]
    return [get(e, 6) in PLAINLY_ORDERED or (get(e, 6) is None and get(e, 10) is None) for e in leaves]


def wider(a: list | None, b: list | None, kind: int, ordered: bool) -> list | None:
    """Statistics of both parts: the number of nulls, and the bounds where the values' order is known."""
    if not a or not b:
        return None
    out = []
    if get(a, 3) is not None and get(b, 3) is not None:
        out.append([3, I64, get(a, 3) + get(b, 3)])
    ends = [get(x, n) for x in (a, b) for n in (6, 5)]
    if ordered and (kind in ORDERED or kind == BYTES) and all(x is not None for x in ends):
        key = (lambda x: x) if kind == BYTES else (lambda x: struct.unpack(ORDERED[kind], x)[0])
        out += [[5, BINARY, max(ends[1], ends[3], key=key)], [6, BINARY, min(ends[0], ends[2], key=key)]]
    return out or None
