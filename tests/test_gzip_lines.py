"""Line framing, member spans and restart points against plain Python."""

import gzip
import json
import random
import zlib

import numpy as np
import pytest

from tidemark.sources import gzip_lines as gl
from tidemark.sources.pages import _element, _skip_blank


def lines_of(data):
    found = []
    for line in data.split(b"\n"):
        line = line[:-1] if line.endswith(b"\r") else line
        if line:
            found.append(line)
    return found


def read(path, part=None, limit=1 << 23):
    out = []
    for data, begins, ends in gl.framed(part or gl.Part(str(path), gl.BEGIN, 0, None), limit):
        out += [data[b:e] for b, e in zip(begins, ends)]
    return out


def some_lines(rng, n):
    return b"".join(
        rng.choice([b"", b"x", b"\r", b"{}", b"line %d " % i * rng.randrange(40), bytes(rng.randrange(11, 250) for _ in range(rng.randrange(300)))])
        + rng.choice([b"\n", b"\r\n", b"\n\n"])
        for i in range(n)
    )


def flushed(data, rng, mode):
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out, at = b"", 0
    while at < len(data):
        size = rng.randrange(1, 9000)
        out += packer.compress(data[at : at + size]) + packer.flush(mode)
        at += size
    return out + packer.flush()


def packed(kind, data, rng):
    if kind == "plain":
        return gzip.compress(data)
    if kind == "members":
        cuts = sorted(rng.randrange(len(data)) for _ in range(30))
        return b"".join(gzip.compress(data[a:b]) for a, b in zip([0, *cuts], [*cuts, len(data)])) + b"\0" * 700
    return flushed(data, rng, zlib.Z_FULL_FLUSH if kind == "full" else zlib.Z_SYNC_FLUSH)


@pytest.mark.parametrize("kind", ["plain", "members", "full", "sync"])
def test_parts_hold_every_line_once(tmp_path, monkeypatch, kind):
    monkeypatch.setattr(gl, "READ", 5000)
    monkeypatch.setattr(gl, "BATCH", 7000)
    rng = random.Random(kind)
    for number in range(4):
        data = some_lines(rng, 1200) + rng.choice([b"", b"no line break"])
        path = tmp_path / f"{number}.gz"
        path.write_bytes(packed(kind, data, rng))
        assert read(path) == lines_of(data)
        size, restarts = gl.restart_points(str(path), 10_000)
        assert size == len(data)
        assert (len(restarts) == 1) == (kind == "plain")
        assert all(b.raw_at - a.raw_at >= 10_000 for a, b in zip(restarts, restarts[1:]))
        assert any(r.window is not None for r in restarts) == (kind in ("full", "sync"))
        for restart in restarts:
            with gl.open_file(str(path)) as file:
                assert b"".join(gl.inflate(file, restart)) == data[restart.raw_at :]
        for count in (1, 2, 7, 40):
            parts = gl.parts_of(str(path), size, restarts, count)
            assert [line for part in parts for line in read(path, part)] == lines_of(data)
            assert kind == "plain" or count < 7 or len({p.restart.raw_at for p in parts}) > 1


def test_long_lines_over_many_parts(tmp_path, monkeypatch):
    monkeypatch.setattr(gl, "READ", 100)
    monkeypatch.setattr(gl, "BATCH", 300)
    data = b"a" * 5000 + b"\n" + b"b" * 10 + b"\n" + b"c" * 3000
    path = tmp_path / "x.gz"
    path.write_bytes(gzip.compress(data[:5001]) + gzip.compress(data[5001:]))
    size, restarts = gl.restart_points(str(path), 1)
    for count in (1, 3, 20, 200):
        parts = gl.parts_of(str(path), size, restarts, count)
        assert [line for part in parts for line in read(path, part)] == lines_of(data)
    with pytest.raises(ValueError, match="longer than 5000"):
        read(path, limit=5000)
    assert len(read(path, limit=5001)) == 3


def test_broken_streams(tmp_path):
    whole = gzip.compress(b"line\n" * 5000)
    for name, data in {"cut": whole[:-20], "no-trailer": whole[:-3], "empty": b"", "text": b"line\n", "sum": whole[:-8] + b"x" * 8, "tail": whole + b"junk"}.items():
        path = tmp_path / name
        path.write_bytes(data)
        with pytest.raises((zlib.error, EOFError)):
            read(path)
        with pytest.raises((zlib.error, EOFError)):
            gl.restart_points(str(path), 100)


def plain(line, member):
    """What the scan says, by decoding the line (None: the line is no JSON)."""
    text = line.decode()
    try:
        end, value = _element(text, _skip_blank(text, 0))
    except ValueError:
        return None
    whole = text.strip(" \t\r\n")[:1] == "{" and _skip_blank(text, end) == len(text)
    return whole, value.encode() if value is not None else None


def scan(lines, member="payload"):
    data = b"\n".join(lines)
    ends = np.cumsum([len(line) + 1 for line in lines]) - 1
    begins = ends - [len(line) for line in lines]
    whole, begin, end = gl.member_spans(data, begins, ends, member)
    members = gl._pieces(data, begin, end, begin < 0).to_pylist()
    assert gl._pieces(data, begins, ends).to_pylist() == lines
    return list(zip(whole.tolist(), members))


def value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 6)
    blank = rng.choice(["", "", " ", "\t "])
    if kind < 2:
        return blank + rng.choice(["1", "-2.5e3", "true", "null", "0"]) + blank
    if kind < 6:
        return blank + '"' + "".join(rng.choice(["a", "é", "{", "}", "[", ",", ":", r"\"", r"\\", r"é", "payload", r'\"payload\":']) for _ in range(rng.randrange(6))) + '"' + blank
    if kind < 8:
        names = [rng.choice(['"payload"', '"a"', r'"\"payload"', '"payloads"']) for _ in range(rng.randrange(4))]
        return blank + "{" + blank + ",".join(blank + n + blank + ":" + value(rng, depth + 1) for n in names) + "}" + blank
    return blank + "[" + ",".join(value(rng, depth + 1) for _ in range(rng.randrange(4))) + "]" + blank


def test_member_spans_against_decoding():
    rng = random.Random(5)
    lines = []
    for _ in range(3000):
        line = rng.choice(["", " "]) + value(rng).strip() + rng.choice(["", "", " ", " x", "{}", "}"])
        if rng.random() < 0.7:
            line = line if line.strip().startswith("{") else '{"b":' + line.strip().split(" x")[0] + ', "payload":' + value(rng) + "}"
        if line:
            lines.append(line.encode())
    found = scan(lines)
    seen = 0
    for line, (whole, member) in zip(lines, found):
        wanted = plain(line, "payload")
        if wanted is None:
            continue
        assert whole == wanted[0], line
        if whole:
            seen += 1
            assert (None if member == b"null" else member) == wanted[1], line
    assert seen > 1000


def test_odd_lines():
    lines = [b" ", b"{", b"}", b'{"payload":}', b'{"payload":1', b'"payload":1', b'{"payload"}', b'{"payload" : {"payload":2} }  ', b"[1]", b'{"a":"\\\\","payload":"x"}', b'{"payload":1,"payload":[ 2 ]}']
    found = scan(lines)
    assert [w for w, _ in found] == [False, False, False, True, False, False, True, True, False, True, True]
    assert found[7][1] == b'{"payload":2}' and found[9][1] == b'"x"' and found[10][1] == b"[ 2 ]" and found[3][1] is None
    assert scan([b"{}"]) == [(True, None)]
    blanks = b" " * 1000
    spread = blanks + b'{"payload"' + blanks + b":" + blanks + b"7" + blanks + b"}" + blanks
    assert scan([b"x", spread, blanks, spread + b"x"]) == [(False, None), (True, b"7"), (False, None), (False, b"7")]
    assert scan([b"plain", b'"text"']) == [(False, None)] * 2


def test_data_source_reads_parts(spark, tmp_path):
    rng = random.Random(2)
    files, wanted = [], []
    for number, kind in enumerate(("plain", "members", "sync")):
        rows = [json.dumps({"n": i, "file": number, "payload": {"x": "é" * rng.randrange(50)}}).encode() for i in range(800)]
        path = tmp_path / f"{kind}.gz"
        path.write_bytes(packed(kind, b"\n".join(rows), rng))
        files.append(str(path))
        wanted += [(path.name, row, True, json.dumps(json.loads(row)["payload"]).encode()) for row in rows]

    def rows(frame):
        return sorted((r.file, bytes(r.line), r.whole, bytes(r.member)) for r in frame.collect())

    frame = gl.read_gzip_lines(spark, files, "payload", 1 << 20)
    assert frame.rdd.getNumPartitions() == 3 and rows(frame) == sorted(wanted)
    from tidemark.sources.store import write_text

    index = str(tmp_path / "index.json")
    found = [{"file": r.file, "raw_size": r.raw_size, "restarts": json.loads(r.restarts), "parts": 4} for r in gl.index_files(spark, files, 4, 5000).collect()]
    write_text(spark, index, json.dumps(found))
    frame = gl.read_gzip_lines(spark, files, "payload", 1 << 20, index)
    assert frame.rdd.getNumPartitions() == 12 and rows(frame) == sorted(wanted)
