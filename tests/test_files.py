"""Every file of a folder gives a row, whatever is in it."""

import os

from scriptmill.sources import corpus, files


def test_every_file_gives_a_row(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    (tmp_path / "a.sql").write_text("select 1")
    (tmp_path / "sub" / "empty.sql").write_bytes(b"")
    (tmp_path / "sub" / "deep" / "bad.sql").write_bytes(b"select '\xff\xfe'")
    (tmp_path / "sub" / "blank é.sql").write_text(" \n")
    (tmp_path / "other.txt").write_text("no script")
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / ".hidden.sql").write_text("select 2")
    got = {os.path.relpath(r.path, tmp_path): (r.sql, r.error) for r in corpus.scan_folder_checked(spark, str(tmp_path)).collect()}
    assert got == {
        "a.sql": ("select 1", None), "sub/empty.sql": ("", None), "sub/deep/bad.sql": (None, "not UTF-8 text"),
        "sub/blank é.sql": (" \n", None)}
    assert {os.path.basename(r.path) for r in files.whole_files(spark, f"file://{tmp_path}", "*.txt").collect()} == {"other.txt"}


def test_files_that_cannot_be_opened(tmp_path):
    """What is listed but cannot be read has an error, and the others of its partition are read."""
    for name in ("a", "b", "c"):
        (tmp_path / name).write_text(name)
    reader = files.WholeFilesReader({"path": str(tmp_path)})
    part, = reader.partitions()
    (tmp_path / "b").unlink()
    (tmp_path / "b").mkdir()
    (tmp_path / "c").unlink()
    rows = {os.path.basename(path): (content, error) for path, _, _, content, error in reader.read(part)}
    assert rows["a"] == (b"a", None) and all(rows[x][0] is None and rows[x][1].startswith("unreadable: ") for x in "bc")


def test_files_are_dealt_out_by_bytes_and_number(spark, tmp_path, monkeypatch):
    for i in range(25):
        (tmp_path / f"{i:02}.sql").write_bytes(b"x" * (100 if i == 3 else 10))
    monkeypatch.setattr(files, "PART_BYTES", 60)
    monkeypatch.setattr(files, "PART_FILES", 4)
    parts = files.WholeFilesReader({"path": str(tmp_path)}).partitions()
    assert sorted(p for part in parts for p, _, _ in part.files) == sorted(str(f) for f in tmp_path.iterdir())
    assert all(len(p.files) <= 4 and (len(p.files) == 1 or sum(n for *_, n in p.files) <= 60) for p in parts)
    rows = files.whole_files(spark, str(tmp_path)).collect()
    assert len(rows) == 25 and all(r.length == len(r.content) and r.modificationTime is not None for r in rows)


def test_folder_without_files(spark, tmp_path):
    assert files.whole_files(spark, str(tmp_path)).count() == 0
    assert corpus.scan_folder_checked(spark, str(tmp_path)).count() == 0
