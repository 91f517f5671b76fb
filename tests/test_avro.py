"""Avro files: the format by hand, round trips, and refusals."""

import json
import zlib

import pytest

from tessera.sources import avro_files, readers, sinks


def test_numbers_by_hand():
    for n, raw in ((0, b"\x00"), (-1, b"\x01"), (1, b"\x02"), (-64, b"\x7f"), (64, b"\x80\x01"), (2**63 - 1, b"\xfe" + b"\xff" * 8 + b"\x01"), (-(2**63), b"\xff" * 9 + b"\x01")):
        out = bytearray()
        avro_files._put_long(out, n)
        assert bytes(out) == raw and avro_files._Bytes(raw).long() == n


def test_a_file_by_hand():
    """A plain file as any writer may make it: no codec named, an array in two blocks, one with its size."""
    schema = json.dumps({"type": "record", "name": "R", "fields": [{"name": "a", "type": ["null", "string"]}, {"name": "b", "type": {"type": "array", "items": "int"}}]}).encode()
    head = b"Obj\x01" + b"\x02" + b"\x16avro.schema" + bytes([(len(schema) << 1 & 0x7F) | 0x80, len(schema) << 1 >> 7]) + schema + b"\x00" + b"s" * 16
    record = b"\x02" + b"\x04hi" + b"\x01\x02\x0a" + b"\x02\x0c" + b"\x00"  # a: "hi"; b: a block of one with its size, then another
    body = record + b"\x00" + b"\x00"  # and a null with an empty array
    data = head + b"\x04" + bytes([len(body) << 1]) + body + b"s" * 16
    assert [r for block in avro_files.decoded(data) for r in block] == [{"a": "hi", "b": [5, 6]}, {"a": None, "b": []}]
    with pytest.raises(ValueError, match="ends too soon"):
        list(avro_files.decoded(data[:-20]))
    with pytest.raises(ValueError, match="where it should"):
        list(avro_files.decoded(data[:-1] + b"x"))
    with pytest.raises(ValueError, match="not an Avro"):
        list(avro_files.decoded(b"PAR1" + data))


def test_blocks_are_deflated():
    schema = {"type": "record", "name": "R", "fields": [{"name": "t", "type": "string"}]}
    parts = list(avro_files.encoded(iter([[{"t": "x" * 5000}], [{"t": "y"}]]), schema))
    assert len(parts) == 3 and len(parts[1]) < 100
    assert [r["t"] for block in avro_files.decoded(b"".join(parts)) for r in block] == ["x" * 5000, "y"]
    assert zlib.decompress(parts[2][2:-16], -15) == b"\x02y"


def test_round_trip(spark, tmp_path):
    rows = [(i, None if i % 3 else f"é{i}\n", i / 7, [i, None, -i] if i % 2 else None, bytes([i % 256]), i % 5 == 0, -i) for i in range(500)] + [(2**62, "", float("inf"), [], b"", None, None)]
    df = spark.createDataFrame(rows, "a long, b string, c double, d array<long>, e binary, f boolean, g int").repartition(4)
    path = str(tmp_path / "t")
    sinks.avro(df, path, "Row", "some.space")
    got = readers.avro(spark, path)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in df.schema]
    plain = lambda frame: sorted(((r.a, r.b, r.c, r.d, bytes(r.e), r.f, r.g) for r in frame.collect()), key=lambda r: r[0])
    assert plain(got) == plain(df)
    with pytest.raises(FileExistsError):
        sinks.avro(df, path, "Row", "some.space")
    sinks.avro(df.limit(0), str(tmp_path / "none"), "Row", "some.space")
    assert readers.avro(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="cannot be written"):
        sinks.avro(spark.sql("select map(1, 2) as m"), str(tmp_path / "map"), "Row", "some.space")
