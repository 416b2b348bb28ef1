from quillspark.sources import corpus


def test_source_files(spark, tmp_path):
    for name, data in {"src/a.py": b"print(1)\n", "src/b.bin": b"x", "node_modules/c.js": b"var a", "src/d.js": b"a\0b", "src/e.go": b"\xff\xfe", "src/f.md": b"  \n ", "src/g.json": b"{" + b" " * 70_000 + b"}", "src/h.ts": b""}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    rows = corpus.source_files(spark, str(tmp_path)).collect()
    assert [(r["path"], r["text"]) for r in rows] == [("src/a.py", "print(1)\n")]


def test_golden(spark, tmp_path):
    p = tmp_path / "golden.jsonl"
    p.write_text('# note\n\n{"q": "where", "expect": ["a.py"]}\n{"q": "never", "expect": [], "mode": "dense"}\n')
    assert [tuple(r) for r in corpus.golden_cases(spark, str(p)).collect()] == [("where", ["a.py"], "all", "prose"), ("never", [], "dense", "negative")]


def test_guarded_slice(spark):
    files = spark.createDataFrame([("r", "a", "1", "x\ny\nz")], "repo_id string, path string, sha string, text string")
    manifest = spark.createDataFrame([("r", "a", "0")], "repo_id string, path string, sha string")
    asked = spark.createDataFrame([("r", "/./a", 2, 5), ("r", "b", 1, 1)], "repo_id string, path string, start int, count int")
    rows = {r["path"]: (r["text"], r["stale"]) for r in corpus.guarded_slice(files, manifest, asked).collect()}
    assert rows == {"a": ("y\nz", True), "b": (None, None)}
