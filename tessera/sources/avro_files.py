"""Avro object container files without Spark's Avro module: flat records, arrays, nulls; null and deflate codecs.

Files are read as bytes by Spark and decoded in the tasks; they are written by
the tasks to a folder beside the target, one file a partition, and put in place
when all are complete.  The writing side reaches the stores that pyarrow does.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans import shipping

shipping.by_value(__name__)

_MAGIC, _SYNC = b"Obj\x01", 16
#: Avro's names of the types that have one (fixed values).
_NAMES = {"boolean": T.BooleanType, "int": T.IntegerType, "long": T.LongType, "float": T.FloatType, "double": T.DoubleType, "string": T.StringType, "bytes": T.BinaryType}
_ROWS_A_BLOCK = 4000


def avro_type(kind: T.DataType, nullable: bool):
    """A Spark type as Avro's."""
    if isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": avro_type(kind.elementType, kind.containsNull)}
    else:
        names = [name for name, k in _NAMES.items() if isinstance(kind, k)]
        if not names:
            raise ValueError(f"{kind.simpleString()} cannot be written")
        out = names[0]
    return ["null", out] if nullable else out


def spark_type(kind) -> tuple[T.DataType, bool]:
    """Avro's type as Spark's, and whether it may be null."""
    if isinstance(kind, list):
        rest = [k for k in kind if k != "null"]
        if len(rest) != 1:
            raise ValueError(f"a union of {kind} cannot be read")
        return spark_type(rest[0])[0], "null" in kind
    if isinstance(kind, dict) and kind["type"] == "array":
        element, nullable = spark_type(kind["items"])
        return T.ArrayType(element, nullable), False
    name = kind["type"] if isinstance(kind, dict) else kind
    if name not in _NAMES:
        raise ValueError(f"{kind} cannot be read")
    return _NAMES[name](), False


def _put_long(out: bytearray, n: int) -> None:
    n = n << 1 ^ n >> 63
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def _put(out: bytearray, kind, value) -> None:
    if isinstance(kind, list):
        branch = kind.index("null") if value is None else next(i for i, k in enumerate(kind) if k != "null")
        _put_long(out, branch)
        kind = kind[branch]
    if kind == "null":
        return
    if isinstance(kind, dict):
        if value:
            _put_long(out, len(value))
            for item in value:
                _put(out, kind["items"], item)
        _put_long(out, 0)
    elif kind in ("int", "long"):
        _put_long(out, value)
    elif kind == "boolean":
        out.append(bool(value))
    elif kind in ("float", "double"):
        out += struct.pack("<f" if kind == "float" else "<d", value)
    else:
        raw = value.encode() if kind == "string" else bytes(value)
        _put_long(out, len(raw))
        out += raw


class _Bytes:
    """A place in a file's bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        if len(part) < n:
            raise ValueError("the file ends too soon")
        self.at += n
        return part

    def long(self) -> int:
        shift = value = 0
        while True:
            byte = self.take(1)[0]
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value >> 1 ^ -(value & 1)
            shift += 7

    def value(self, kind):
        if isinstance(kind, list):
            kind = kind[self.long()]
        if isinstance(kind, dict) and kind["type"] == "array":
            out = []
            while n := self.long():
                if n < 0:  # a block with its size in bytes
                    n = -n
                    self.long()
                out += [self.value(kind["items"]) for _ in range(n)]
            return out
        name = kind["type"] if isinstance(kind, dict) else kind
        if name == "null":
            return None
        if name in ("int", "long"):
            return self.long()
        if name == "boolean":
            return self.take(1) == b"\x01"
        if name in ("float", "double"):
            return struct.unpack("<f" if name == "float" else "<d", self.take(4 if name == "float" else 8))[0]
        raw = self.take(self.long())
        return raw.decode() if name == "string" else raw


def _header(data: _Bytes) -> tuple[dict, str, bytes]:
    """Schema, codec and sync mark of a file."""
    if data.take(4) != _MAGIC:
        raise ValueError("not an Avro file")
    meta = {}
    while n := data.long():
        if n < 0:
            n = -n
            data.long()
        for _ in range(n):
            key = data.value("string")
            meta[key] = data.value("bytes")
    return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), data.take(_SYNC)


def decoded(content: bytes) -> Iterator[list[dict]]:
    """The records of a file, block by block."""
    data = _Bytes(content)
    schema, codec, sync = _header(data)
    fields = [(f["name"], f["type"]) for f in schema["fields"]]
    while data.at < len(content):
        n, raw = data.long(), data.take(data.long())
        if codec not in ("null", "deflate"):
            raise ValueError(f"codec {codec} cannot be read")
        block = _Bytes(raw if codec == "null" else zlib.decompress(raw, -15))
        yield [{name: block.value(kind) for name, kind in fields} for _ in range(n)]
        if data.take(_SYNC) != sync:
            raise ValueError("a block does not end where it should")


def encoded(rows: Iterator[list[dict]], schema: dict) -> Iterator[bytes]:
    """A file's bytes: the header, then a deflated block for each list of records."""
    text = json.dumps(schema).encode()
    sync = hashlib.md5(text).digest()
    out = bytearray(_MAGIC)
    _put_long(out, 2)
    for key, value in (("avro.schema", text), ("avro.codec", b"deflate")):
        _put(out, "string", key)
        _put(out, "bytes", value)
    _put_long(out, 0)
    yield bytes(out + sync)
    for block in rows:
        raw = bytearray()
        for record in block:
            for field in schema["fields"]:
                _put(raw, field["type"], record[field["name"]])
        packer = zlib.compressobj(wbits=-15)
        packed = packer.compress(bytes(raw)) + packer.flush()
        out = bytearray()
        _put_long(out, len(block))
        _put_long(out, len(packed))
        yield bytes(out) + packed + sync


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a folder's files; all have the schema of one of them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.avro").load(folder).select("content")

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"schema": [json.dumps(_header(_Bytes(c))[0]) for c in batch.column(0).to_pylist()]})

    first = files.limit(1).mapInArrow(head, "schema string").first()
    if first is None:
        raise FileNotFoundError(f"no Avro files in {folder}")
    kinds = [(f["name"], *spark_type(f["type"])) for f in json.loads(first["schema"])["fields"]]
    schema = T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in kinds])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                for rows in decoded(content):
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.mapInArrow(run, schema)


def write(df: DataFrame, folder: str, record: str, namespace: str) -> None:
    """df as a folder of Avro files; an error if it exists.  Readers see all files or no folder."""
    from pyarrow import fs

    schema = {"type": "record", "name": record, "namespace": namespace, "fields": [{"name": f.name, "type": avro_type(f.dataType, f.nullable)} for f in df.schema]}
    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    store, target = fs.FileSystem.from_uri(uri)
    if store.get_file_info(target).type != fs.FileType.NotFound:
        raise FileExistsError(folder)
    staged = f"{uri.rstrip('/')}.{uuid.uuid4().hex}.tmp"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def blocks() -> Iterator[list[dict]]:
            for batch in batches:
                for first in range(0, batch.num_rows, _ROWS_A_BLOCK):
                    yield batch.slice(first, _ROWS_A_BLOCK).to_pylist()

        place, path = fs.FileSystem.from_uri(staged)
        place.create_dir(path, recursive=True)
        # Each attempt has a name of its own; only those that the driver hears of count.
        name = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        with place.open_output_stream(f"{path}/{name}") as out:
            for part in encoded(blocks(), schema):
                out.write(part)
        yield pa.RecordBatch.from_pydict({"name": [name]})

    written = [r["name"] for r in df.mapInArrow(run, "name string").collect()]  # a name a partition
    place, path = fs.FileSystem.from_uri(staged)
    place.create_dir(path, recursive=True)
    known = {f"{path}/{name}" for name in written}
    for info in place.get_file_info(fs.FileSelector(path)):
        if info.path not in known:
            place.delete_file(info.path)
    if not written:  # the schema stays known
        with place.open_output_stream(f"{path}/part-00000.avro") as out:
            out.write(b"".join(encoded(iter([]), schema)))
    for name in written:
        place.move(f"{path}/{name}", f"{path}/part-{name[:5]}.avro")
    store.move(path, target)
