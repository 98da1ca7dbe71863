"""Avro container files without an Avro package: a Python data source and a writer.

Schemas of records of primitives, arrays, maps, nested records and unions with
null are read; codecs null and deflate.  Files are read in splits at their
sync marks.

    spark.dataSource.register(AvroSource)
    spark.read.format("kestrix-avro").load(folder)
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from io import BufferedReader, BytesIO
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MAGIC = b"Obj\x01"
_PRIMITIVES = {"int": T.IntegerType, "long": T.LongType, "float": T.FloatType, "double": T.DoubleType, "string": T.StringType, "boolean": T.BooleanType, "bytes": T.BinaryType}
#: Wider of two numeric branches of a union.
_RANK = ["int", "long", "float", "double"]


def _long(f) -> int:
    shift = value = 0
    while True:
        b = f.read(1)[0]
        value |= (b & 127) << shift
        if b < 128:
            return value >> 1 ^ -(value & 1)
        shift += 7


def _put_long(n: int) -> bytes:
    n = n << 1 ^ n >> 63
    out = bytearray()
    while n & ~127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _kind(s) -> str:
    return "union" if isinstance(s, list) else s if isinstance(s, str) else s["type"] if isinstance(s["type"], str) else _kind(s["type"])


class Schema:
    """An Avro schema with its named types."""

    def __init__(self, text: str | dict):
        self.root = json.loads(text) if isinstance(text, str) else text
        self.names: dict[str, dict] = {}
        self._collect(self.root, "")

    def _collect(self, s, space: str) -> None:
        if isinstance(s, list):
            for x in s:
                self._collect(x, space)
        elif isinstance(s, dict):
            if s.get("type") in ("record", "enum", "fixed"):
                space = s.get("namespace", space)
                self.names[s["name"]] = self.names[f"{space}.{s['name']}"] = s
            for f in s.get("fields", ()):
                self._collect(f["type"], space)
            for k in ("items", "values"):
                if k in s:
                    self._collect(s[k], space)
            if isinstance(s.get("type"), (dict, list)):
                self._collect(s["type"], space)

    def _resolve(self, s):
        while True:
            if isinstance(s, str) and s in self.names:
                s = self.names[s]
            elif isinstance(s, dict) and (isinstance(s.get("type"), (dict, list)) or s.get("type") in self.names):
                s = s["type"]
            else:
                return s

    def spark(self, s=None) -> T.DataType:
        s = self._resolve(self.root if s is None else s)
        kind = _kind(s)
        if kind in _PRIMITIVES:
            return _PRIMITIVES[kind]()
        if kind == "record":
            return T.StructType([T.StructField(f["name"], self.spark(f["type"])) for f in s["fields"]])
        if kind == "array":
            return T.ArrayType(self.spark(s["items"]))
        if kind == "map":
            return T.MapType(T.StringType(), self.spark(s["values"]))
        if kind == "union":
            rest = [b for b in s if b != "null"]
            kinds = [_kind(self._resolve(b)) for b in rest]
            if len(rest) > 1 and "string" in kinds:
                return T.StringType()
            if len(rest) > 1 and all(k in _RANK for k in kinds):
                return _PRIMITIVES[max(kinds, key=_RANK.index)]()
            return self.spark(rest[0]) if rest else T.NullType()
        return T.StringType() if kind == "enum" else T.BinaryType() if kind == "fixed" else T.NullType()

    def read(self, f, s=None):
        s = self._resolve(self.root if s is None else s)
        kind = _kind(s)
        if kind in ("int", "long"):
            return _long(f)
        if kind == "double":
            return struct.unpack("<d", f.read(8))[0]
        if kind == "float":
            return struct.unpack("<f", f.read(4))[0]
        if kind in ("string", "bytes"):
            raw = f.read(_long(f))
            return raw.decode() if kind == "string" else raw
        if kind == "boolean":
            return f.read(1) == b"\x01"
        if kind == "union":
            at = _long(f)
            value = self.read(f, s[at])
            want = self.spark(s)
            return str(value) if value is not None and isinstance(want, T.StringType) else float(value) if isinstance(want, (T.DoubleType, T.FloatType)) and value is not None else value
        if kind == "record":
            return tuple(self.read(f, x["type"]) for x in s["fields"])
        if kind in ("array", "map"):
            out = []
            while n := _long(f):
                if n < 0:
                    n = -n
                    _long(f)
                out += [(self.read(f, "string"), self.read(f, s["values"])) if kind == "map" else self.read(f, s["items"]) for _ in range(n)]
            return dict(out) if kind == "map" else out
        if kind == "enum":
            return s["symbols"][_long(f)]
        return f.read(s["size"]) if kind == "fixed" else None

    def write(self, v, s=None) -> bytes:
        s = self._resolve(self.root if s is None else s)
        kind = _kind(s)
        if kind in ("int", "long"):
            return _put_long(int(v))
        if kind == "double":
            return struct.pack("<d", v)
        if kind == "float":
            return struct.pack("<f", v)
        if kind in ("string", "bytes"):
            raw = v.encode() if kind == "string" else bytes(v)
            return _put_long(len(raw)) + raw
        if kind == "boolean":
            return b"\x01" if v else b"\x00"
        if kind == "union":
            at = s.index("null") if v is None else next(i for i, b in enumerate(s) if b != "null")
            return _put_long(at) + (b"" if v is None else self.write(v, s[at]))
        if kind == "record":
            get = (lambda n: v[n]) if isinstance(v, dict) else (lambda n: getattr(v, n))
            return b"".join(self.write(get(x["name"]), x["type"]) for x in s["fields"])
        if kind == "array":
            return (_put_long(len(v)) + b"".join(self.write(x, s["items"]) for x in v) if v else b"") + b"\x00"
        if kind == "map":
            return (_put_long(len(v)) + b"".join(self.write(k, "string") + self.write(x, s["values"]) for k, x in v.items()) if v else b"") + b"\x00"
        raise ValueError(f"can't write {kind}")


class Columns:
    """Records of a schema straight into Arrow columns and back, by code made for the schema.

    ``known`` is false for schemas with unions of several types; these are read
    record by record.  What is read has the fields' names and Spark's types.
    """

    _ARROW = {"int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "bytes": pa.binary()}

    def __init__(self, schema: Schema):
        self.schema, self.lists = schema, 0
        self.known = True
        try:
            root = schema._resolve(schema.root)
            body, builders = [], []
            if _kind(root) != "record":
                raise NotImplementedError
            for f in root["fields"]:
                builders.append(self._reader(f["type"], body, "  "))
            names = {f"L{i}" for i in range(self.lists)}
            code = "def decode(B, n):\n P = 0\n" + "".join(f" {x} = []; a{x} = {x}.append\n" for x in sorted(names)) + " for _ in range(n):\n" + "\n".join(body or ["  pass"]) + "\n return locals()\n"
            space = {"D": struct.Struct("<d").unpack_from, "S": struct.Struct("<f").unpack_from}
            exec(compile(code, "avro", "exec"), space)  # noqa: S102  made of the schema's structure alone, no text of it gets in
            self._decode, self._fields, self._builders = space["decode"], [f["name"] for f in root["fields"]], builders
        except (NotImplementedError, RecursionError):
            self.known = False

    def _list(self) -> str:
        self.lists += 1
        return f"L{self.lists - 1}"

    @staticmethod
    def _number(name: str, body: list, at: str) -> None:
        body += [f"{at}{name} = B[P]; P += 1", f"{at}if {name} > 127:", f"{at} {name} &= 127; s = 7", f"{at} while True:", f"{at}  c = B[P]; P += 1; {name} |= (c & 127) << s; s += 7", f"{at}  if c < 128: break", f"{at}{name} = {name} >> 1 ^ -({name} & 1)"]

    def _reader(self, s, body: list, at: str):
        """Code that reads a value of s, and a function (lists) -> Arrow array of what it read."""
        s = self.schema._resolve(s)
        kind = _kind(s)
        if kind == "union":
            rest = [b for b in s if b != "null"]
            if len(rest) != 1 or len(s) > 2:
                raise NotImplementedError
            self._number("u", body, at)
            if len(s) == 1:
                return self._reader(rest[0], body, at)
            there = self._list()
            body += [f"{at}if u == {s.index(rest[0])}:", f"{at} a{there}(True)"]
            inner = self._reader(rest[0], body, at + " ")
            body += [f"{at}else: a{there}(False)"]

            def build(v, there=there, inner=inner):
                have = pa.array(v[there], pa.bool_())
                got = inner(v)
                if len(got) == len(have):
                    return got
                # the values there are, at their places
                at, place = 0, []
                for x in v[there]:
                    place.append(at if x else None)
                    at += x
                return got.take(pa.array(place, pa.int64()))

            return build
        if kind in self._ARROW:
            x, arrow = self._list(), self._ARROW[kind]
            if kind in ("int", "long"):
                self._number("v", body, at)
                body.append(f"{at}a{x}(v)")
            elif kind in ("double", "float"):
                body += [f"{at}a{x}({'D' if kind == 'double' else 'S'}(B, P)[0]); P += {8 if kind == 'double' else 4}"]
            elif kind == "boolean":
                body += [f"{at}a{x}(B[P] == 1); P += 1"]
            else:
                self._number("v", body, at)
                body += [f"{at}a{x}(B[P : P + v]); P += v"]
            if kind == "string":
                return lambda v: pa.array(v[x], pa.binary()).cast(pa.string())
            return lambda v: pa.array(v[x], arrow)
        if kind == "record":
            parts = [self._reader(f["type"], body, at) for f in s["fields"]]
            if not parts:
                raise NotImplementedError
            names = [f["name"] for f in s["fields"]]
            return lambda v: pa.StructArray.from_arrays([p(v) for p in parts], names)
        if kind == "array":
            sizes, depth = self._list(), self.lists
            body.append(f"{at}k{depth} = 0")
            body.append(f"{at}while True:")
            self._number(f"n{depth}", body, at + " ")
            body += [f"{at} if n{depth} == 0: break", f"{at} if n{depth} < 0:", f"{at}  n{depth} = -n{depth}"]
            self._number("v", body, at + "  ")
            body += [f"{at} k{depth} += n{depth}", f"{at} for _ in range(n{depth}):"]
            items = self._reader(s["items"], body, at + "  ")
            body.append(f"{at}a{sizes}(k{depth})")
            return lambda v: pa.ListArray.from_arrays(pa.array([0, *accumulate(v[sizes])], pa.int32()), items(v))
        raise NotImplementedError

    def read(self, block: bytes, n: int) -> pa.RecordBatch:
        found = self._decode(block, n)
        return pa.RecordBatch.from_arrays([b(found) for b in self._builders], self._fields)


#: Numbers as they are written, by the number.
_SMALL = [_put_long(i) for i in range(512)]


def _encode(schema: Schema, s, values: pa.Array) -> list[bytes]:
    """Each value of an Arrow array as ``Schema.write`` would write it; what stands for a null outside a union is anything."""
    s = schema._resolve(s)
    kind = _kind(s)
    number = lambda v: _SMALL[v] if 0 <= v < 512 else _put_long(v)
    if kind == "union":
        mark = _put_long(next(i for i, b in enumerate(s) if b != "null"))
        found = [mark + x for x in _encode(schema, next(b for b in s if b != "null"), values)]
        if values.null_count:
            null = _put_long(s.index("null"))
            found = [null if x else y for x, y in zip(values.is_null().to_pylist(), found)]
        return found
    if kind in ("int", "long"):
        return [number(v) for v in values.fill_null(0).to_numpy(zero_copy_only=False).tolist()]
    if kind in ("double", "float"):
        size = 8 if kind == "double" else 4
        raw = values.to_numpy(zero_copy_only=False).astype(f"<f{size}").tobytes()
        return [raw[i : i + size] for i in range(0, len(raw), size)]
    if kind in ("string", "bytes"):
        raw = values.cast(pa.large_binary()).fill_null(b"")
        place, data = np.frombuffer(raw.buffers()[1], "<i8")[raw.offset : raw.offset + len(raw) + 1].tolist(), raw.buffers()[2]
        data = data.to_pybytes() if data else b""
        return [number(j - i) + data[i:j] for i, j in zip(place, place[1:])]
    if kind == "boolean":
        return [b"\x01" if v else b"\x00" for v in values.fill_null(False).to_pylist()]
    if kind == "record":
        return list(map(b"".join, zip(*(_encode(schema, f["type"], v) for f, v in zip(s["fields"], values.flatten())))))
    if kind == "array":
        parts, sizes = _encode(schema, s["items"], values.flatten()), values.value_lengths()
    elif kind == "map":
        # entries of nulls are none
        sizes = pc.list_value_length(values.cast(pa.list_(pa.struct([("key", values.type.key_type), ("value", values.type.item_type)]))))
        entries = values.cast(pa.list_(pa.struct([("key", values.type.key_type), ("value", values.type.item_type)]))).flatten().flatten()
        parts = [k + v for k, v in zip(_encode(schema, "string", entries[0]), _encode(schema, s["values"], entries[1]))]
    else:
        raise ValueError(f"can't write {kind}")
    ends = [0, *accumulate(sizes.fill_null(0).to_pylist())]
    return [number(j - i) + b"".join(parts[i:j]) + b"\x00" if j > i else b"\x00" for i, j in zip(ends, ends[1:])]


def _encoded(schema: Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    """Records of Arrow batches, each as its bytes."""
    for b in batches:
        yield from map(b"".join, zip(*(_encode(schema, f["type"], c) for f, c in zip(schema.root["fields"], b.columns))))


def _header(f) -> tuple[Schema, str, bytes]:
    if f.read(4) != MAGIC:
        raise ValueError("no Avro container file")
    meta = {}
    while n := _long(f):
        if n < 0:
            n = -n
            _long(f)
        for _ in range(n):
            k = f.read(_long(f)).decode()
            meta[k] = f.read(_long(f))
    return Schema(meta["avro.schema"].decode()), meta.get("avro.codec", b"null").decode(), f.read(16)


#: Bytes of a file that one task reads at most, up to the end of the block they end in.
SPLIT = 64 << 20


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or address and the place in it; paths without a scheme are local."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pafs.LocalFileSystem(), os.path.abspath(path))


def _opened(path: str):
    fs, at = _store(path)
    return BufferedReader(fs.open_input_file(at), 1 << 20)


def read_file(path: str, start: int = 0, stop: int | None = None) -> Iterator[tuple]:
    """Records of the blocks of one file that begin in [start, stop): after the first sync mark from start on."""
    for schema, block, n in _blocks(path, start, stop):
        block = BytesIO(block)
        for _ in range(n):
            yield schema.read(block)


def read_batches(path: str, start: int = 0, stop: int | None = None) -> Iterator[pa.RecordBatch | tuple]:
    """The same as an Arrow batch a block, or as records if the schema has no columns."""
    columns = None
    for schema, block, n in _blocks(path, start, stop):
        columns = columns or Columns(schema)
        if columns.known:
            yield columns.read(block, n)
        else:
            block = BytesIO(block)
            for _ in range(n):
                yield schema.read(block)


def _blocks(path: str, start: int, stop: int | None) -> Iterator[tuple[Schema, bytes, int]]:
    with _opened(path) as f:
        schema, codec, sync = _header(f)
        if start > f.tell():
            f.seek(start - 16)  # the mark before a block that begins at start
            if not _skip_past(f, sync):
                return
        while (stop is None or f.tell() < stop) and f.peek(1):
            n = _long(f)
            raw = f.read(_long(f))
            f.read(16)
            yield schema, zlib.decompress(raw, -15) if codec == "deflate" else raw, n


def _skip_past(f, mark: bytes) -> bool:
    tail = b""
    while part := f.read(1 << 16):
        at = (tail + part).find(mark)
        if at >= 0:
            f.seek(at + len(mark) - len(tail) - len(part), 1)
            return True
        tail = (tail + part)[-len(mark) + 1 :]
    return False


def write_file(path: str, schema: str | dict, records, codec: str = "deflate", block: int = 4096, encoded: bool = False) -> None:
    """One file, written beside its place and then moved there; records are bytes already if encoded."""
    s, sync = Schema(schema), os.urandom(16)
    fs, at = _store(path)
    with fs.open_output_stream(f"{at}.tmp") as f:
        meta = {"avro.schema": json.dumps(s.root).encode(), "avro.codec": codec.encode()}
        f.write(MAGIC + _put_long(len(meta)) + b"".join(_put_long(len(k)) + k.encode() + _put_long(len(v)) + v for k, v in meta.items()) + b"\x00" + sync)
        part: list[bytes] = []

        def flush() -> None:
            if part:
                raw = b"".join(part)
                if codec == "deflate":
                    c = zlib.compressobj(wbits=-15)
                    raw = c.compress(raw) + c.flush()
                f.write(_put_long(len(part)) + _put_long(len(raw)) + raw + sync)
                part.clear()

        for r in records:
            part.append(r if encoded else s.write(r))
            if len(part) >= block:
                flush()
        flush()
    fs.move(f"{at}.tmp", at)


def files(path: str) -> list[tuple[str, int]]:
    """Data files at or under a path, with their sizes, as addresses that read_file takes."""
    fs, at = _store(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(at))
    names = sorted((f.base_name, f.size) for f in found if f.base_name.endswith(".avro") and not f.base_name.startswith(("_", ".")))
    return [(f"{path.rstrip('/')}/{n}", size) for n, size in names]


def schema_of(kind: T.DataType, name: str = "Record") -> dict | list | str:
    """The Avro schema of a Spark type; every field may be null."""
    simple = {v: k for k, v in _PRIMITIVES.items()}
    if type(kind) in simple:
        return simple[type(kind)]
    if isinstance(kind, T.StructType):
        return {"type": "record", "name": name, "fields": [{"name": f.name, "type": ["null", schema_of(f.dataType, f"{name}_{f.name}")]} for f in kind.fields]}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": ["null", schema_of(kind.elementType, f"{name}_item")]}
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return {"type": "map", "values": ["null", schema_of(kind.valueType, f"{name}_value")]}
    raise ValueError(f"no Avro type for {kind.simpleString()}")


class AvroSource(DataSource):
    """Reads files and folders in splits; writes a folder with a file a task.

    Places are local paths or addresses of stores that Arrow opens (hdfs://,
    s3://, gs://, file://).
    """

    @classmethod
    def name(cls) -> str:
        return "kestrix-avro"

    def schema(self) -> T.StructType:
        found = files(self.options["path"])
        if not found:
            raise FileNotFoundError(f"no Avro files at {self.options['path']}")
        with _opened(found[0][0]) as f:
            return _header(f)[0].spark()

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema_of(schema), overwrite)


class _Part(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.found, self.split = files(path), split

    def partitions(self):
        return [_Part(p, at, min(at + self.split, size)) for p, size in self.found for at in range(0, size, self.split)]

    def read(self, partition):
        yield from read_batches(partition.path, partition.start, partition.stop)


class _Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _Writer(DataSourceArrowWriter):
    """Every attempt of a task writes a file of its own name, hidden until the job commits."""

    def __init__(self, path: str, schema: dict, overwrite: bool):
        self.path, self.schema = path.rstrip("/"), schema
        fs, at = _store(self.path)
        if overwrite and fs.get_file_info(at).type == pafs.FileType.Directory:
            fs.delete_dir_contents(at)
        fs.create_dir(at, recursive=True)

    def write(self, iterator) -> WriterCommitMessage:
        place = f"{self.path}/_part-{uuid.uuid4().hex}.avro"
        write_file(place, self.schema, _encoded(Schema(self.schema), iterator), encoded=True)
        return _Written(place)

    def commit(self, messages) -> None:
        for m in filter(None, messages):
            fs, at = _store(m.path)
            fs.move(at, at.replace("/_part-", "/part-"))

    def abort(self, messages) -> None:
        for m in filter(None, messages):
            fs, at = _store(m.path)
            fs.delete_file(at)
