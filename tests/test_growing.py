"""Lines appended to files arrive once: between triggers, after a restart, over rotation and truncation."""

import os

from codelens.sources import growing as G
from codelens.streaming import watchers as W
from tests.test_streaming import _run


def _append(path, text):
    with open(path, "ab") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def test_appended_lines_arrive_once(spark, scratch):
    folder, ckpt = os.path.join(scratch, "out"), os.path.join(scratch, "ckpt")
    os.makedirs(folder)
    a, b = os.path.join(folder, "a.log"), os.path.join(folder, "b.log")

    def new():  # each call is a restart from the checkpoint
        return sorted((r["file"], r["line"]) for r in _run(spark, G.follow_lines(spark, folder, "*.log*"), ckpt=ckpt))

    _append(a, "one\ntwo\nhal")
    _append(b, "")
    assert new() == [("a.log", "one"), ("a.log", "two")]
    assert new() == []
    _append(a, "f\n\nthree\r\n")
    _append(b, b"\xff\xfe bad bytes\n")
    assert new() == [("a.log", ""), ("a.log", "half"), ("a.log", "three"), ("b.log", "�� bad bytes")]
    _append(a, "before rotation\n")
    os.rename(a, a + ".1")  # the old file goes on under its new name, the new one starts at its beginning
    _append(a, "after rotation\n")
    assert new() == [("a.log", "after rotation"), ("a.log.1", "before rotation")]
    os.truncate(b, 0)
    _append(b, "again\n")
    assert new() == [("b.log", "again")]
    os.remove(a + ".1")
    _append(b, "more\n")
    assert new() == [("b.log", "more")]


def test_reader_cases(tmp_path):
    folder = str(tmp_path)
    r = G.GrowingReader("file://" + folder + "/", "*")
    assert r.latestOffset() == {} and r.partitions({}, {}) == []
    long = "x" * (2 * G.BLOCK) + "\n"
    _append(folder + "/a", "ab\n" + long + "tail without end" + "y" * G.BLOCK)
    (first,) = r.partitions({}, r.latestOffset())
    assert [len(line) for _, _, line in r.read(first)] == [2, len(long) - 1]
    os.rename(folder + "/a", folder + "/moved")  # between planning and reading
    assert [start for _, start, _ in r.read(first)] == [0, 3]
    os.remove(folder + "/moved")
    assert list(r.read(first)) == []
    os.mkfifo(folder + "/pipe")
    assert r.latestOffset() == {}


def test_errors_of_growing_output(spark, scratch):
    """The watcher's context reaches over triggers into lines that were appended later."""
    folder, ckpt = os.path.join(scratch, "procs"), os.path.join(scratch, "ckpt2")
    os.makedirs(folder)
    out = []
    for k in range(2):
        _append(os.path.join(folder, "7.stdout.log"), f"step {k}a\nstep {k}b\n")
        _append(os.path.join(folder, "8.stderr.log"), f"Error: {k}\n")
        if k:
            _append(os.path.join(folder, "7.stdout.log"), "Error: boom\n")
        _append(os.path.join(folder, "notes.txt"), "Error: not a process\n")
        out += _run(spark, W.error_stream(G.follow_processes(spark, folder)), ckpt=ckpt)
    assert sorted((r["pid"], r["source"], r["context"]) for r in out) == [
        (7, "stdout", "step 0a\nstep 0b\nstep 1a\nstep 1b\nError: boom"), (8, "stderr", "Error: 0"), (8, "stderr", "Error: 0\nError: 1")]
