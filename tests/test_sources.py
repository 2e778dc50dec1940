"""File sources that read parts of files, and the sink of files."""

import hashlib
import os
import subprocess
import sys

import pytest

from talkloom.sources import files
from talkloom.sources import sessions as src


def wav(rate, channels, data=b""):
    head = bytearray(44)
    head[22:24], head[24:28] = channels.to_bytes(2, "little"), rate.to_bytes(4, "little")
    return bytes(head) + data


@pytest.fixture
def folder(tmp_path):
    for i in range(30):
        (tmp_path / f"f{i}.wav").write_bytes(wav(8000 + i, 1 + i % 2, bytes(100 * i)))
    (tmp_path / "short.wav").write_bytes(b"x" * 43)
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "zero.wav").write_bytes(wav(0, 1))
    (tmp_path / ".hidden.wav").write_bytes(wav(1, 1))
    (tmp_path / "note.txt").write_bytes(b"note")
    deep = tmp_path / "deep" / "er"
    deep.mkdir(parents=True)
    (deep / "f1.wav").write_bytes(wav(7, 2, bytes(280)))
    return str(tmp_path)


def test_recordings_equal_whole_reads(spark, folder, monkeypatch):
    monkeypatch.setattr(files, "FILES", 7)
    want = sorted(tuple(r) for r in src.recordings(src.files(spark, folder, "*.wav").where("path not like '%hidden%'")).select("filename", "length", "sample_rate", "channels", "duration_ms").collect())
    got = files.read_recordings(spark, folder)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 31
    assert sorted(tuple(r) for r in files.read_recordings(spark, f"file://{folder}").collect()) == want
    assert files.read_recordings(spark, f"{folder}/none").count() == 0


def test_headers_alone_are_read(tmp_path):
    """Twenty files of 1 GB each (sparse): bytes read, by the process's own count."""
    for i in range(20):
        with open(tmp_path / f"f{i}.wav", "wb") as f:
            f.write(wav(16000, 1))
            f.truncate(1 << 30)
    reader = files.Recordings({"path": str(tmp_path)}).reader(files.Recordings({}).schema())
    parts = reader.partitions()
    list(reader.read(parts[0]))  # loads what the reading needs
    before = int(open("/proc/self/io").readline().split()[1])
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 20 and rows[0]["duration_ms"] == ((1 << 30) - 44) // 32
    assert int(open("/proc/self/io").readline().split()[1]) - before < 20 * 4096


def test_large_file_in_little_memory(tmp_path):
    """The digest of 1 GB (sparse) in a process of its own that stays under 200 MB."""
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(1 << 30)
        f.seek(1 << 29)
        f.write(b"middle")
    code = ("import resource, sys; from talkloom.sources import files\n"
            "r = files.Digests({'path': sys.argv[1]}).reader(files.Digests({}).schema())\n"
            "print([x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()][0]['sha256'], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)")
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, env=os.environ)
    assert done.returncode == 0, done.stderr
    sha, most = done.stdout.split()
    want = hashlib.sha256(bytes(1 << 29))
    want.update(b"middle" + bytes((1 << 29) - 6))
    assert sha == want.hexdigest() and int(most) < 200_000


def test_trees_of_ranges(spark, folder):
    got = {r["filename"]: r for r in files.manifest(spark, folder, "*.txt", 3).collect()}
    parts = b"".join(hashlib.sha256(x).digest() for x in (b"not", b"e"))
    assert len(got) == 1 and got["note.txt"]["n_parts"] == 2 and got["note.txt"]["tree_sha256"] == hashlib.sha256(parts).hexdigest()
    assert got["note.txt"]["sha256"] == hashlib.sha256(b"note").hexdigest() and got["note.txt"]["length"] == 4
    every = files.manifest(spark, folder, "*", 1000).collect()
    assert len(every) == 35 and sum(r["filename"] == "f1.wav" for r in every) == 2
    empty = next(r for r in every if r["filename"] == "empty.wav")
    assert empty["n_parts"] == 1 and empty["sha256"] == hashlib.sha256(b"").hexdigest()


def test_ranges_of_a_file_are_tasks_of_their_own():
    pieces = [("a", 10, 0, 0, 4), ("a", 10, 1, 4, 4), ("a", 10, 2, 8, 2), ("b", 1, 0, 0, 1), ("c", 0, 0, 0, 0)]
    assert [len(p.pieces) for p in files.dealt(pieces, size=4)] == [1, 1, 3]
    assert [len(p.pieces) for p in files.dealt(pieces, files=2, size=100)] == [2, 2, 1]


def test_written_files(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("a", b"one"), ("b", b""), ("c", bytes(100_000))], "name string, content binary")
    files.write_files(df, out)
    files.write_files(df.where("name = 'a'"), out)  # again: the same file
    assert sorted(os.listdir(out)) == ["a", "b", "c"] and open(f"{out}/a", "rb").read() == b"one"
    samples = spark.createDataFrame([([1, -2, 40000], 8000, 2), (None, 1, 1)], "s array<int>, r int, c int").select(files.wave("s", "r", "c").alias("content")).collect()
    assert bytes(samples[0]["content"])[40:] == b"\x06\0\0\0\x01\0\xfe\xff\xff\x7f" and len(samples[1]["content"]) == 44


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from talkloom.sources.shared import shared_dir

    context = N(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        shared_dir(N(sparkContext=context))
    context.getCheckpointDir = lambda: "hdfs://shared"
    assert shared_dir(N(sparkContext=context)) == "hdfs://shared"


def test_reports_by_any_name(spark, tmp_path):
    """Names that need escapes, a null and an empty one; a report is one file, without Hadoop's checksum beside it, and what was there goes."""
    from talkloom.sources import sessions

    names = ["a b", "x=1/2:%#?*", "q\"'[]{}^\\", "Отчёт", "", None]
    rows = spark.createDataFrame([(n, f"text {i}\nend") for i, n in enumerate(names)], "name string, body string")
    path = str(tmp_path / "reports")
    for df in (rows, rows.where("name <> 'a b'")):
        sessions.write_reports(df, path)
        got = {(r["name"], r["body"]) for r in sessions.read_reports(spark, path).collect()}
        assert got == {(r["name"] or None, r["body"] + "\n") for r in df.collect()}
    assert len([p for p in (tmp_path / "reports").rglob("*") if p.is_file()]) == len(names) - 2  # a comparison with null drops that row too
