"""Digests of files as streams."""

import hashlib
import resource
import subprocess
import sys

from fieldloom.sources import digests


def test_digests_are_those_of_the_whole_files(spark, tmp_path):
    content = {"a/one.bin": b"x" * 10, "a/empty.bin": b"", "b/two.bin": bytes(range(256)) * 12_289, "b/skip.txt": b"no", "c/é ü.bin": b"\x00\xff"}
    for name, data in content.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = digests.file_digests(spark, str(tmp_path), "*.bin").collect()
    want = [n for n in sorted(content) if n.endswith(".bin") and content[n]]
    assert [r.sha256 for r in got] == [hashlib.sha256(content[n]).hexdigest() for n in want]
    assert [(r.length, r.pieces, r.error) for r in got] == [(len(content[n]), -(-len(content[n]) // digests.PIECE), None) for n in want]
    few = {r.length: r.error for r in digests.file_digests(spark, str(tmp_path), "*.bin", most=10, tasks=2).collect()}
    assert few == {10: None, 2: None, 256 * 12_289: "TOO_LARGE"}


def test_a_large_file_takes_little_memory(tmp_path):
    """A file of 1.5 GB (with holes) in a process that may not grow by its size."""
    big = tmp_path / "big.bin"
    with open(big, "wb") as f:
        f.seek((1536 << 20) - 1)
        f.write(b"!")
    code = f"import resource, sys; sys.path.insert(0, {sys.path[0]!r}); from fieldloom.sources.digests import stream_digest; r = stream_digest('file://{big}'); print(r[0], r[1], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    length, pieces, peak = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120).stdout.split())
    assert length == 1536 << 20 and pieces == 1536 and peak < 600_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss


def test_what_cannot_be_read(tmp_path):
    import pytest

    with pytest.raises(OSError):
        digests.stream_digest(f"file://{tmp_path}/gone")
    (tmp_path / "f").write_bytes(b"12345")
    assert digests.stream_digest(f"file://{tmp_path}/f", most=3) == (5, 1, None, "TOO_LARGE")
