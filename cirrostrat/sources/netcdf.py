"""Files of the classic netCDF format (CDF-1, CDF-2 and CDF-5), read by place.

The header tells where each variable lies, so a variable is a view of the
mapped file: taking a box of it reads the pages of that box. Variables with the
unlimited dimension are interleaved by record, which is a stride. Values that
equal a variable's fill value are masked, and packed values are unpacked, as
netCDF libraries do. Files of netCDF-4 are HDF5 files and need that library.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format: type codes with their big-endian types, tags of lists, default fill values.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
FILLS = {"i2": -32767, "i4": -2147483647, "f4": 9.9692099683868690e36, "f8": 9.9692099683868690e36}
MAGIC = {b"CDF\x01": (4, 4), b"CDF\x02": (4, 8), b"CDF\x05": (8, 8)}  # bytes of counts, bytes of places


def is_classic(path: str) -> bool:
    with open(path, "rb") as f:
        return f.read(4) in MAGIC


class _Header:
    """A cursor over a file's header."""

    def __init__(self, file) -> None:
        self.file = file
        self.count_size, self.place_size = MAGIC[file.read(4)]

    def number(self, size: int) -> int:
        return struct.unpack(">q" if size == 8 else ">i", self.file.read(size))[0]

    def count(self) -> int:
        return self.number(self.count_size)

    def name(self) -> str:
        n = self.count()
        out = self.file.read(n).decode()
        self.file.read(-n % 4)
        return out

    def listed(self, tag: int) -> int:
        found, n = self.number(4), self.count()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError("not a classic netCDF header")
        return n

    def attributes(self) -> dict:
        out = {}
        for _ in range(self.listed(ATTRIBUTE)):
            name, kind, n = self.name(), np.dtype(TYPES[self.number(4)]), self.count()
            size = n * kind.itemsize
            data = self.file.read(size)
            self.file.read(-size % 4)
            out[name] = data.decode(errors="replace") if kind.kind == "S" else np.frombuffer(data, kind)
        return out


class Variable:
    """A variable of a file: shape, dtype, attributes, and its values by index."""

    def __init__(self, raw: np.ndarray, attributes: dict) -> None:
        self.raw, self.attributes, self.shape, self.dtype = raw, attributes, raw.shape, raw.dtype

    def __getitem__(self, at) -> np.ma.MaskedArray:
        some = np.array(self.raw[at])
        some = some.astype(some.dtype.newbyteorder("="))
        bad = np.zeros(some.shape, bool)
        default = FILLS.get(some.dtype.str[1:])
        for fill in (self.attributes.get("_FillValue", default), self.attributes.get("missing_value")):
            if fill is not None and some.dtype.kind != "S":
                bad |= some == np.asarray(fill).ravel()[0]
        scale, offset = (self.attributes.get(n) for n in ("scale_factor", "add_offset"))
        if scale is not None or offset is not None:
            some = some * (1.0 if scale is None else float(scale[0])) + (0.0 if offset is None else float(offset[0]))
        return np.ma.MaskedArray(some, bad)


class File:
    """Variables by name. dimensions: name to length."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            h = _Header(f)
            records = h.count()
            names = [(h.name(), h.count()) for _ in range(h.listed(DIMENSION))]
            self.attributes = h.attributes()
            found = []
            for _ in range(h.listed(VARIABLE)):
                name = h.name()
                dims = [h.count() for _ in range(h.count())]
                attributes, kind = h.attributes(), np.dtype(TYPES[h.number(4)])
                h.count()  # its size, which follows from the rest
                found.append((name, dims, attributes, kind, h.number(h.place_size)))
        self._map = np.memmap(path, np.uint8, "r")
        unlimited = {n for n, (_, length) in enumerate(names) if length == 0}
        moving = [(kind.itemsize * int(np.prod([names[d][1] for d in dims[1:]], dtype=np.int64)), v) for v in found for _, dims, _, kind, _ in [v] if dims and dims[0] in unlimited]
        # A record holds all its variables, each to a multiple of four bytes, unless there is one only.
        step = sum(size + -size % 4 for size, _ in moving) if len(moving) > 1 else sum(size for size, _ in moving)
        if records < 0:  # written as a stream: as many as there are
            records = (len(self._map) - min(v[4] for _, v in moving)) // step if moving else 0
        self.dimensions = {name: records if n in unlimited else length for n, (name, length) in enumerate(names)}
        self.variables = {}
        for name, dims, attributes, kind, begin in found:
            shape = tuple(records if d in unlimited else names[d][1] for d in dims)
            inner = np.cumprod([kind.itemsize, *shape[:0:-1]], dtype=np.int64)[::-1].tolist() if shape else []
            strides = (step, *inner[1:]) if dims and dims[0] in unlimited else tuple(inner)
            empty = 0 in shape
            raw = np.zeros(shape, kind) if empty else np.ndarray(shape, kind, self._map, begin, strides)
            self.variables[name] = Variable(raw, attributes)

    def __getitem__(self, name: str) -> Variable:
        return self.variables[name]

    def close(self) -> None:
        self.variables = {}
        self._map = None
