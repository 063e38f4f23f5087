"""Readers, sinks and staging."""

import pytest

from vantaloom.sources import corpus, evalsets, runtime


@pytest.fixture
def folder(tmp_path):
    files = {"a.md": "# A", "b/c.py": "x = 1\n", "b/d.txt": "t", "b/__pycache__/e.py": "no", "input.txt": "no", "z.bin": "no", "b/f.py": "y = 2\n", "b/__init__.py": "", "_p/g.py": "z"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\x00")
    return tmp_path


def test_documents(spark, folder):
    got = corpus.load_documents(spark, [str(folder)]).collect()
    assert [(r["path"].removeprefix(f"file:{folder}/"), r["text"]) for r in got] == [("_p/g.py", "z"), ("a.md", "# A"), ("b/__init__.py", ""), ("b/c.py", "x = 1\n"), ("b/d.txt", "t"), ("b/f.py", "y = 2\n")]


def test_python_sources(spark, folder):
    assert sorted(r["path"] for r in corpus.load_python(spark, [str(folder)], str(folder)).collect()) == ["_p/g.py", "b/__init__.py", "b/c.py", "b/f.py"]
    assert [r["path"] for r in corpus.load_python(spark, [str(folder)], str(folder), 1).collect()] == ["_p/g.py"]


def test_folder_statistics(spark, folder):
    by_folder, largest = corpus.folder_statistics(spark, str(folder), 2)
    assert {r["folder"]: r["n_files"] for r in by_folder.collect()} == {".": 4, "b": 4, "_p": 1}
    assert [r["rel"] for r in largest.collect()] == ["a.md", "bad.md"]


def test_env(spark):
    lines = spark.createDataFrame([(x,) for x in ("# c", "", "A=1", "B = x=y", "A=2", "none", "  C=3  ")], "value string").coalesce(1)
    assert {r["key"]: r["value"] for r in corpus.parse_env(lines).collect()} == {"A": "1", "B": "x=y", "C": "3"}


def test_cache_and_results(spark, tmp_path):
    assert corpus.read_cache(spark, str(tmp_path / "none")) is None
    corpus.append_cache(spark.createDataFrame([("k", "d")], "key string, description string"), str(tmp_path / "c"))
    assert corpus.read_cache(spark, str(tmp_path / "c")).count() == 1
    nested = spark.createDataFrame([(1, {"a": 1})], "id int, m map<string,int>")
    corpus.write_results(nested, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["m"]["a"] == 1


def test_a_corrupt_cache_is_empty(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"PAR1 no parquet at all PAR1")
    assert corpus.read_cache(spark, str(tmp_path / "bad")).collect() == []
    corpus.append_cache(spark.createDataFrame([("k", "d")], "key string, description string"), str(tmp_path / "bad"))
    assert [tuple(r) for r in corpus.read_cache(spark, str(tmp_path / "bad")).collect()] == [("k", "d")]


def test_stage_keeps_schema_and_small_side_falls_back(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    assert sorted(map(tuple, runtime.stage(df, "t").collect())) == [(1, "a"), (2, None)]
    assert "broadcast" in runtime.small_side(df)._jdf.queryExecution().toString().lower()
    assert "broadcast" not in runtime.small_side(df, 1)._jdf.queryExecution().logical().toString().lower()


def test_release_deletes_what_was_staged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "shared_root", lambda s: f"file://{tmp_path}")
    monkeypatch.setattr(runtime, "_staged", [])
    runtime.stage(spark.range(3), "t")
    spark.range(3).write.parquet(runtime.scratch(spark, "u"))
    assert len(list(tmp_path.glob("vantaloom-*"))) == 2
    runtime.release()
    assert not list(tmp_path.glob("vantaloom-*"))


def test_evaluation_sets(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"id": "a", "q": "x?", "gold": ["g", "h"]}\n{"q": "z?", "gold": []}\n{"q": "y?", "gold": ["k"]}\n')
    got = evalsets.read_set(spark, str(tmp_path / "q.json"))
    assert {r["id"]: r["q"] for r in got.collect()} == {"a": "x?", "s01": "y?", "s02": "z?"}
    assert sorted(map(tuple, evalsets.gold_rows(got).collect())) == [("a", "g"), ("a", "h"), ("s01", "k")]
    many = "".join(f'{{"q": "{i:03d}", "gold": ["g"]}}\n' for i in range(120))
    (tmp_path / "m.json").write_text(many)
    assert len({r["id"] for r in evalsets.read_set(spark, str(tmp_path / "m.json")).collect()}) == 120
    (tmp_path / "t.json").write_text('{"id": "t", "facts": [{"desc": "d", "checks": [{"kind": "kwarg", "name": "n", "value": 16, "not": true}]}], "seed": {"a.py": "x"}}\n')
    task = evalsets.read_set(spark, str(tmp_path / "t.json"), evalsets.TASKS).first()
    assert task["facts"][0]["checks"][0]["value"] == "16" and task["facts"][0]["checks"][0]["not"] and task["seed"] == {"a.py": "x"}


def test_tasks_list_what_spark_hides(spark, folder, monkeypatch):
    monkeypatch.setattr(corpus, "_globbed", lambda *_: pytest.fail("the driver listed the folders"))
    (folder / "b" / "deep" / "_q").mkdir(parents=True)
    (folder / "b" / "deep" / "_q" / "_h i.py").write_text("12")
    files, inner = corpus.underscored(spark, [str(folder)])
    at = f"file:{folder}"
    assert files == [(f"{at}/b/__init__.py", 0), (f"{at}/b/deep/_q/_h i.py", 2)] and inner == [f"{at}/_p", f"{at}/b/deep/_q"]
    monkeypatch.undo()
    assert corpus._globbed(spark, [str(folder)], 32) == (files, inner)


def test_a_document_is_a_file_and_not_a_folder(spark, tmp_path, rows):
    from vantaloom.plans import files

    own = [(i, f"text {i}\n", "a b" if i % 2 else None) for i in range(60)] + [(7, "again", "c"), (None, None, "c")]
    spark.createDataFrame(own, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    path = files._tree(spark, str(tmp_path)).removeprefix("file://")
    import pathlib

    made = list(pathlib.Path(path).rglob("*"))
    assert sum(p.is_file() for p in made) == len(own) and sum(p.is_dir() for p in made) == 6
    import hashlib

    digest = lambda t: hashlib.sha1(((t or "") + "\n").encode()).hexdigest()
    assert rows(files.source_documents(spark, str(tmp_path))) == sorted(((i, digest(t)) for i, t, _ in own), key=repr)


def test_tasks_list_and_read_files(spark, folder, monkeypatch, rows):
    """As Spark's binary files and what it hides, but no file passes the driver's index."""
    more = {"v.md": "", "_a=b.md": "1", "k=1/_m.md": "2", "_k=2/n o%20.md": "3", ".git/x.md": "no", ".git/_y.md": "4", ".git/_d/z.md": "5", "x__pycache__/q.md": "6", "x__pycache__/_r.md": "no", "_metadata1/s.md": "7", "t.md._COPYING_": "no", "é/ü.md": "8"}
    for name, text in more.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    roots = [str(folder), f"{folder}/b/"]
    found = [[(r[0], r[1], bytes(r[2])) for r in rows(make(spark, roots).distinct())] for make in (corpus._files, corpus._through_spark)]
    assert found[0] == found[1] and len(found[0]) == len({p for p, *_ in found[0]}) == 17
    monkeypatch.setattr(corpus, "HIDDEN_MB", 0)
    monkeypatch.setattr(corpus, "TASK_FILES", 3)
    for df in (corpus._files(spark, roots), corpus._files(spark, roots, False)):
        assert "binaryfile" not in df._jdf.queryExecution().toString().lower() and df.count() == 17
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus._files(spark, [f"{folder}/none"])
