"""A small writer of the PBF format, for tests only."""

import struct
import zlib


def varint(n):
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def zigzag(n):
    return varint((n << 1) ^ (n >> 63))


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def packed(values, code=varint):
    return b"".join(code(v) for v in values)


def deltas(values):
    last, out = 0, []
    for v in values:
        out.append(v - last)
        last = v
    return packed(out, zigzag)


class Strings:
    def __init__(self):
        self.list = [""]

    def __call__(self, text):
        if text not in self.list:
            self.list.append(text)
        return self.list.index(text)

    def message(self):
        return b"".join(field(1, s.encode()) for s in self.list)


def tag_fields(s, tags):
    return field(2, packed(s(k) for k in tags)) + field(3, packed(s(v) for v in tags.values()))


def units(degrees, granularity=100, offset=0):
    return round((degrees * 1e9 - offset) / granularity)


def dense(s, nodes, granularity=100, offset=0):
    stream = []
    for _, _, _, tags in nodes:
        for k, v in tags.items():
            stream += [s(k), s(v)]
        stream.append(0)
    out = field(1, deltas(n[0] for n in nodes))
    out += field(8, deltas(units(n[2], granularity, offset) for n in nodes))
    out += field(9, deltas(units(n[1], granularity, offset) for n in nodes))
    if any(n[3] for n in nodes):
        out += field(10, packed(stream))
    return field(2, field(2, out))


def plain_nodes(s, nodes):
    group = b"".join(
        field(1, field(1, zz(i)) + tag_fields(s, tags) + field(8, zz(units(lat))) + field(9, zz(units(lon))))
        for i, lon, lat, tags in nodes
    )
    return field(2, group)


def zz(n):
    return (n << 1) ^ (n >> 63)


def ways(s, items):
    return field(2, b"".join(
        field(3, field(1, i) + tag_fields(s, tags) + (field(8, deltas(refs)) if refs else b""))
        for i, tags, refs in items
    ))


def relations(s, items):
    kinds = ("node", "way", "relation")
    return field(2, b"".join(
        field(4, field(1, i) + tag_fields(s, tags) + field(8, packed([0] * len(refs)))
              + field(9, deltas(refs)) + field(10, packed(kinds.index(t) for t in types)))
        for i, tags, refs, types in items
    ))


def blob(kind, data, compress=True):
    body = field(2, len(data)) + field(3, zlib.compress(data)) if compress else field(1, data)
    head = field(1, kind) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def header(*features):
    return blob(b"OSMHeader", b"".join(field(4, f.encode()) for f in features))


def block(s, *groups, granularity=None, offset=None, compress=True):
    data = field(1, s.message()) + b"".join(groups)
    if granularity:
        data += field(17, granularity)
    if offset is not None:
        data += field(19, offset) + field(20, offset)
    return blob(b"OSMData", data, compress)
