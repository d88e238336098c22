"""Sources read back what the tests write from the fixture views; sinks round-trip."""

import json
import os
import random
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import pyarrow as pa
import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from codelens.plans.fixtures import register
from codelens.plans.q_snapshots import snapshot_docs
from codelens.sinks import commits as CL
from codelens.sinks import snapshots as SK
from codelens.sources import files as SF
from codelens.sources import lines as L
from codelens.sources import tree as T
from tests.conftest import SF_SMALL


def _write_tree(spark, root, limit_dirs=None):
    register(spark, SF_SMALL)
    rows = spark.table("files").select("rel_path", "content").collect()
    for r in rows:
        p = os.path.join(root, r.rel_path)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w", encoding="utf-8", newline="") as fh:
            fh.write(r.content)
    return rows


def test_read_tree_and_lines(spark, scratch):
    root = os.path.join(scratch, "tree")
    rows = _write_tree(spark, root)
    extra = {".env": "A=1", "__tests__/t.js": "x()", "a/__init__.py": "", "a/_x.py": "y", ".github/workflows/deep/ci.yml": "on: push"}
    for name, text in extra.items():
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "w") as fh:
            fh.write(text)
    tree = SF.read_tree(spark, root, project_id="p")
    got = {r.rel_path: r.content for r in tree.select("rel_path", "content").collect()}
    # projects share root config names in this single tree: the last write of a path wins
    on_disk = {**{r.rel_path: r.content for r in rows}, **extra}
    assert got == on_disk and tree.count() == len(on_disk)
    assert all(r.size == len(on_disk[r.rel_path].encode()) for r in tree.select("rel_path", "size").collect())
    lines = SF.explode_lines(tree)
    want = sum(len(c.split("\n")) for c in on_disk.values())
    assert lines.count() == want


class Vault:
    """Opens roots of a second scheme: vault:///x is the folder /x."""

    def __call__(self, uri):
        return pafs.SubTreeFileSystem("/", pafs.LocalFileSystem()), unquote(uri.removeprefix("vault://"))


def test_read_tree_takes_any_file(spark, scratch, monkeypatch):
    """Binary, empty, hidden, linked and deep files have rows, pipes and broken links none; the form of the path does not matter."""
    root = os.path.join(scratch, "odd tree")
    files = {"a.png": b"\x89PNG\r\n\xff\x00", "empty": b"", ".env": b"A=1", "_x/__init__.py": b"", "zero.bin": b"a\0b", "d/e/f/g/h/i.txt": "é\n".encode(),
             **{f"many/{i}/x.txt": b"%d" % i for i in range(40)}}
    for name, data in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "wb") as fh:
            fh.write(data)
    os.mkfifo(os.path.join(root, "pipe"))
    os.symlink("empty", os.path.join(root, "link"))
    os.symlink("nowhere", os.path.join(root, "broken"))
    os.symlink("..", os.path.join(root, "d", "up"))
    monkeypatch.setattr(T, "ENTRIES", 7)  # several rounds
    want = {n: (len(d), not (n in ("a.png", "zero.bin"))) for n, d in (files | {"link": b""}).items()}
    for form, opener in ((root, None), ("file://" + root, None), ("vault://" + root, Vault())):
        tree = SF.read_tree(spark, form, **({"open_root": opener} if opener else {})).collect()
        assert {r.rel_path: (r.size, r.is_text) for r in tree} == want and len(tree) == len(want)
        assert {r.rel_path: r.content for r in tree}["d/e/f/g/h/i.txt"] == "é\n"
    assert T.read_file(pafs.LocalFileSystem(), root + "/gone") is None and T._list_folder(pafs.LocalFileSystem(), root + "/gone") == []


@pytest.mark.parametrize("range_bytes", [1, 2, 7, 64, 1 << 20])
def test_lines_by_ranges_equal_the_whole_file(spark, scratch, range_bytes, monkeypatch):
    rng = random.Random(range_bytes)
    texts = ["", "\n", "a", "a\n", "\n\n", "one\ntwo\r\n\n" + "x" * 40 + "\nlast", "é" * 30 + "\n日本\n", "\ufeffmark\nb\n"]
    texts += ["".join(rng.choices("ab\n", k=rng.randint(0, 60))) for _ in range(6)]
    files = []
    for i, t in enumerate(texts):
        path = os.path.join(scratch, f"t{i}.txt")
        with open(path, "wb") as fh:
            fh.write(t.encode())
        files.append(("file://" + path, len(t.encode())))
        with open(path, "ab") as fh:
            fh.write(b"grown\nsince\n")  # a file counts as long as it was when it was listed
    monkeypatch.setattr(L, "BLOCK", 5)
    opener, seen = pafs.FileSystem.from_uri, {}
    for uri, size in files:  # the passes themselves, without a job for each case
        starts = range(0, size + 1, range_bytes)
        ranges = pa.record_batch([[uri] * len(starts), list(starts), [min(s + range_bytes, size + 1) for s in starts], [size] * len(starts)], names=list("abcd"))
        (counted,) = L._count(opener)([ranges])
        n = counted.column(4).to_pylist()
        first = [1 + sum(n[:k]) for k in range(len(n))]
        whole = pa.record_batch([*ranges.columns, pa.array(first), pa.array(n)], names=list("abcdef"))
        seen[uri] = [(x["line_no"], x["line"]) for b in L._read(opener)([whole]) for x in b.to_pylist()]
    for (uri, _), t in zip(files, texts, strict=True):
        assert seen[uri] == list(enumerate(t.split("\n"), 1)), (t, range_bytes)
    if range_bytes == 64:
        got = {}
        for r in L.numbered_lines(spark, [*files, ("file:///no/such/file", 100)], 16).collect():
            got.setdefault(r.file, []).append((r.line_no, r.line))
        assert {f: sorted(x) for f, x in got.items()} == seen


def test_read_logs_globs(spark, scratch):
    root = os.path.join(scratch, "ws")
    os.makedirs(os.path.join(root, "logs"))
    os.makedirs(os.path.join(root, "deep", "logs"))
    with open(os.path.join(root, "app.log"), "w") as fh:
        fh.write("start\nError: boom\nok")
    with open(os.path.join(root, "logs", "x.log"), "w") as fh:
        fh.write("fatal thing\n")
    with open(os.path.join(root, "deep", "logs", "y.log"), "w") as fh:  # not matched: globs are not recursive
        fh.write("error\n")
    df = SF.read_logs(spark, root)
    files = {os.path.basename(r.file) for r in df.select("file").distinct().collect()}
    assert files == {"app.log", "x.log"}
    assert df.where(F.col("line") == "Error: boom").select("line_no").first()[0] == 2
    # overlapping globs (*.log and app.log) still give each file once
    py = SF.read_logs(spark, root, SF.PY_LOG_GLOBS)
    assert py.where(F.col("line") == "Error: boom").count() == 1
    with open(os.path.join(root, "npm-debug.log.1"), "w") as fh:
        fh.write("npm ERR! code 1\n")
    js = SF.read_logs(spark, root, SF.JS_LOG_GLOBS)
    assert js.where(F.col("line") == "npm ERR! code 1").count() == 1


def test_snapshot_store(spark, scratch):
    """Save three, save one of them again and one more, delete one: the reader gives each one's last state, whole."""
    docs = snapshot_docs(spark, SF_SMALL).where("cast(id AS int) <= 4")
    out = os.path.join(scratch, "store")
    SK.save_snapshots(docs.where("id <> '4'"), out)
    SK.save_snapshots(docs.where("id = '4'"), out)
    assert sorted(r.id for r in SF.read_snapshots(spark, out).collect()) == ["1", "2", "3", "4"]
    SK.save_snapshots(docs.where("id = '2'").withColumn("name", F.lit('renamed "2"')), out)
    back = {r.id: r for r in SF.read_snapshots(spark, out).collect()}
    assert len(back) == 4 and back["2"].name == 'renamed "2"'
    for r in docs.collect():
        got = back[r.id]
        assert (got.investigation, got.collaboration, got.project_state, got.created_at) == (r.investigation, r.collaboration, r.project_state, r.created_at)
        assert got.metadata.size > 0 and len(got.metadata.checksum) == 64 and got.updated_at is not None
    # the checksum covers the content, not the time of saving
    want = {r.id: r.metadata.checksum for r in SK.with_metadata(docs).collect()}
    assert {i: r.metadata.checksum for i, r in back.items() if i != "2"} == {i: c for i, c in want.items() if i != "2"}
    SK.delete_from_store(spark.createDataFrame([("3",)], "id string"), out)
    assert sorted(r.id for r in SF.read_snapshots(spark, out).collect()) == ["1", "2", "4"]
    SK.save_snapshots(docs.where("id = '3'"), out)
    assert sorted(r.id for r in SF.read_snapshots(spark, out).collect()) == ["1", "2", "3", "4"]


def _named(docs, i, name):
    return docs.where(F.col("id") == i).withColumn("name", F.lit(name))


def test_store_keeps_concurrent_saves_and_their_order(spark, scratch):
    """Writers that start together each get a number of their own; the higher one counts, whatever time they give."""
    docs = snapshot_docs(spark, SF_SMALL).where("cast(id AS int) <= 6").cache()
    out = os.path.join(scratch, "store")
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda i: SK.save_snapshots(_named(docs, str(i), f"by {i}"), out), range(1, 7)))
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6]
    assert {r.id: r.name for r in SF.read_snapshots(spark, out).collect()} == {str(i): f"by {i}" for i in range(1, 7)}
    late, early = (F.to_timestamp(F.lit(t)) for t in ("2031-01-01 00:00:00", "2001-01-01 00:00:00"))
    SK.save_snapshots(_named(docs, "1", "clock ahead"), out, late)
    SK.save_snapshots(_named(docs, "1", "clock behind"), out, early)
    assert SF.read_snapshots(spark, out).where("id = '1'").first().name == "clock behind"
    assert SF.read_snapshots(spark, out, version=7).where("id = '1'").first().name == "clock ahead"
    # a number is taken once, and rows without a manifest are not read
    commits = CL.Commits(spark, out)
    assert not commits._put(3, {"add": "x"}) and commits._put(9, {"add": commits.version().live[0][1]})
    SK._write(_named(docs, "2", "never committed"), commits.path_of("orphan"))
    assert SF.read_snapshots(spark, out).where("id = '2'").first().name == "by 2"
    assert [x for x in os.listdir(f"{out}/_log") if x.startswith(".") and not x.endswith(".crc")] == []


def test_store_compacts_beside_readers_and_writers(spark, scratch, monkeypatch):
    """A reader of the version before, a save during the compaction and deleted ids are all as without it; files stay few."""
    docs = snapshot_docs(spark, SF_SMALL).where("cast(id AS int) <= 3").cache()
    out = os.path.join(scratch, "store")
    SK.save_snapshots(docs, out)
    SK.delete_from_store(spark.createDataFrame([("3",)], "id string"), out)
    SK.save_snapshots(_named(docs, "1", "one"), out)
    before = SF.read_snapshots(spark, out)  # planned on the version before
    states = SK.last_states

    def meanwhile(rows):
        SK.save_snapshots(_named(docs, "2", "during"), out, compact_at=99)
        return states(rows)

    monkeypatch.setattr(SK, "last_states", meanwhile)
    SK.compact_store(spark, out)
    monkeypatch.undo()
    names = lambda df: {r.id: r.name for r in df.collect()}
    old = {r.id: r.name for r in docs.collect()}
    assert names(before) == {"1": "one", "2": old["2"]}
    assert names(SF.read_snapshots(spark, out)) == {"1": "one", "2": "during"}
    assert [n for n, _ in CL.Commits(spark, out).version().live] == [3, 4]
    for k in range(15):
        SK.save_snapshots(_named(docs, "1", f"save {k}"), out, compact_at=5)
        assert len(CL.Commits(spark, out).version().live) < 5
    SK.compact_store(spark, out, keep_ms=-1000)
    assert names(SF.read_snapshots(spark, out)) == {"1": "save 14", "2": "during"}
    assert len([x for x in os.listdir(f"{out}/_log") if x.endswith(".json")]) <= 5 and len(os.listdir(f"{out}/_states")) <= 5
    assert SK.save_snapshots(docs.where("id = '3'"), out) > 19  # numbers go on
    assert set(names(SF.read_snapshots(spark, out))) == {"1", "2", "3"}


def test_json_export_parses(spark):
    docs = snapshot_docs(spark, SF_SMALL)
    for r in SK.export_json(SK.with_metadata(docs)).limit(50).collect():
        got = json.loads(r.json)
        assert got["snapshot_id"] == r.id and got["name"].startswith('Case "') and "questions" in got["investigation"]
    assert "collaboration" not in json.loads(SK.export_json(docs, collaboration=False).first().json)


def test_read_snapshot_files_skips_bad(spark, scratch):
    d = os.path.join(scratch, "snaps")
    os.makedirs(d)
    for i in range(3):
        with open(os.path.join(d, f"snapshot-{i}.json"), "w") as fh:
            json.dump({"id": str(i), "name": f"s{i}", "version": 1, "metadata": {"tags": ["initial"]}}, fh)
    with open(os.path.join(d, "snapshot-bad.json"), "w") as fh:
        fh.write("{not json")
    with open(os.path.join(d, "other.json"), "w") as fh:
        json.dump({"id": "x"}, fh)
    df = SF.read_snapshots(spark, d)
    assert sorted(r.id for r in df.collect()) == ["0", "1", "2"]


def test_markdown_documents(spark, scratch):
    out = os.path.join(scratch, "md")
    docs = SK.export_markdown(snapshot_docs(spark, SF_SMALL).where("cast(id AS int) < 8"))
    SK.write_documents(docs, "markdown", out)
    for i in range(1, 8):
        folder = os.path.join(out, f"id={i}")
        text = "".join(open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if f.endswith(".txt"))
        assert text.startswith("# Investigation Snapshot: Case") and text.rstrip().endswith("*")
    whole = " ".join(r.markdown for r in docs.collect())
    assert all(x in whole for x in ("### 🔴 missing", "### 🔍 missing", "### ✅ missing", "## 📋 Next Steps", "## 🤝", "## 📊", "- **Resolution:** granted"))
