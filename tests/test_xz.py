import io
import json
import lzma
import random
import struct
import zlib

import pytest

from ledgerloom.sources import files, xz


def _packed(n):
    out = b""
    while n >= 0x80:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def archive(chunks):
    """One xz stream with a block for each chunk, put together from single-block streams."""
    body, records = b"", []
    for chunk in chunks:
        one = lzma.compress(chunk, lzma.FORMAT_XZ, lzma.CHECK_CRC64)
        size = 4 * (struct.unpack("<I", one[-8:-4])[0] + 1)
        index = one[-12 - size:-12]
        unpadded, at = xz._number(index, 2)
        records.append(_packed(unpadded) + _packed(len(chunk)))
        body += one[12:-12 - size]
    index = b"\0" + _packed(len(records)) + b"".join(records)
    index += b"\0" * (-len(index) % 4)
    index += struct.pack("<I", zlib.crc32(index))
    flags = one[6:8]
    back = struct.pack("<I", len(index) // 4 - 1) + flags
    return one[:12] + body + index + struct.pack("<I", zlib.crc32(back)) + back + b"YZ"


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def all_lines(data):
    file = File(data)
    return [line for k, place in enumerate(xz.blocks(file)) for line in xz.owned_lines(file, xz.Block("x", k, place))]


def cut(data, rng, most):
    out = []
    while data:
        n = rng.randrange(1, most)
        out.append(data[:n])
        data = data[n:]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_each_line_has_one_owner_wherever_blocks_end(seed, monkeypatch):
    monkeypatch.setattr(xz, "PIECE", 7)
    rng = random.Random(seed)
    lines = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(30))) for _ in range(40)]
    data = b"\n".join(lines) + rng.choice((b"", b"\n"))
    packed = archive(cut(data, rng, 40))
    assert lzma.decompress(packed) == data
    want = data.split(b"\n")
    assert all_lines(packed) == (want[:-1] if want[-1] == b"" else want)


def test_streams_end_to_end_with_padding():
    parts = [b"one\ntw", b"o\nthree\n", b"four"]
    data = b"".join(archive([p]) + b"\0" * 8 for p in parts)
    assert all_lines(data) == [b"one", b"two", b"three", b"four"]
    assert all_lines(lzma.compress(b"")) == []
    with pytest.raises(ValueError):
        xz.blocks(File(b"no archive at all, but long enough.."))


def test_a_file_of_many_blocks_is_many_tasks_and_the_same_rows(spark, tmp_path):
    rng = random.Random(5)
    data = "".join(json.dumps({"transaction_id": f"t{k}", "name": "é" * rng.randrange(40), "date": "2026-01-05"}) + "\n" for k in range(500))
    data += "not json\n\n"
    (tmp_path / "a.jsonl").write_text(data)
    (tmp_path / "z").mkdir()
    (tmp_path / "z/a.jsonl.xz").write_bytes(archive(cut(data.encode(), rng, 9000)))
    (tmp_path / "z/b.jsonl.xz").write_bytes(lzma.compress(b""))
    rows = files.read_jsonl_xz(spark, str(tmp_path / "z"))
    assert rows.rdd.getNumPartitions() > 4
    columns = ["transaction_id", "name", "date", "_corrupt_record"]
    plain = files.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert sorted(rows.select(columns).collect(), key=str) == sorted(plain.select(columns).collect(), key=str)
    assert {r[0].rsplit("/", 1)[1] for r in rows.select("_file").distinct().collect()} == {"a.jsonl.xz"}
