"""WAV files read in ranges of bytes."""

import struct

import numpy as np
import pytest

from sonagrid.sources import wav


def heard(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.path, r.ch, r.block)):
        key = r.path.rsplit("/", 1)[-1], r.ch
        assert r.n0 == sum(len(x) for x in out.get(key, []))
        out.setdefault(key, []).append(r.samples)
    return {k: np.concatenate(v) for k, v in out.items()}


def test_ranges_give_what_whole_files_do(spark, tmp_path):
    rng = np.random.default_rng(5)
    for name, n, channels, bits in (("a", 1000, 2, 16), ("b", 777, 1, 24), ("c", 1, 3, 8), ("d", 0, 1, 16), ("e", 130, 1, 32)):
        (tmp_path / f"{name}.wav").write_bytes(wav.encode(8000, rng.uniform(-1, 1, (n, channels)), bits))
    # a list chunk of odd length, floats, and a last sample that is cut
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 3, 1, 44100, 176400, 4, 32)
    x = rng.uniform(-1, 1, 50).astype("<f4")
    body = b"WAVE" + struct.pack("<4sI", b"LIST", 3) + b"abc\0" + form + struct.pack("<4sI", b"data", 203) + x.tobytes() + b"\1\2\3"
    (tmp_path / "f.wav").write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)
    want = heard(wav.read(spark, f"file://{tmp_path}", 64))
    for size in (37, 1000, 1 << 20):
        got = heard(wav.read_ranges(spark, f"file://{tmp_path}", 64, size))
        assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in want)
    assert np.array_equal(want["f.wav", 0], x.astype(float)) and ("d.wav", 0) not in want


def test_a_file_of_many_gigabytes(tmp_path):
    """A file with a hole: 6 GB of 16-bit samples with a 64-bit length, of which one range is read."""
    size, at = 6 << 30, 5 << 30
    head = b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + struct.pack("<4sIQQQI", b"ds64", 28, size + 72, size, size // 2, 0)
    head += struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 48000, 96000, 2, 16) + struct.pack("<4sI", b"data", 0xFFFFFFFF)
    with open(tmp_path / "long.wav", "wb") as f:
        f.write(head)
        f.seek(len(head) + at)
        f.write(struct.pack("<h", 1 << 14))
        f.truncate(len(head) + size + 10)
    reader = wav._RangeReader({"path": f"file://{tmp_path}", "block": "65536"})
    parts = reader.partitions()
    assert len(parts) == (len(head) + size + 10 + (64 << 20) - 1) // (64 << 20)
    found = 0
    part = next(p for p in parts if p.begin <= len(head) + at < p.end)
    for batch in reader.read(part):
        assert batch.num_rows == 1
        n0, x = batch.column("n0")[0].as_py(), np.asarray(batch.column("samples")[0].values)
        if n0 * 2 <= at < (n0 + len(x)) * 2:
            found = x[at // 2 - n0]
    assert found == 0.5
    last = [b.column("block")[0].as_py() for b in reader.read(parts[-2])] + [b.column("block")[0].as_py() for b in reader.read(parts[-1])]
    assert last[-1] == size // 2 // 65536 - 1


def test_no_wav_file(spark, tmp_path):
    (tmp_path / "x.wav").write_bytes(b"RIFFxxxx" + b"JUNK" * 9)
    with pytest.raises(Exception, match="not a WAV"):
        wav.read_ranges(spark, f"file://{tmp_path}").count()
