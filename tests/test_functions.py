import re

from pyspark.sql import functions as F

from quillspark.functions import paths, redaction, text, vectors


def column(spark, rows, expression, name="t"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, {name} string").orderBy("i").select(expression).collect()]


def test_symbols(spark):
    asked = ["getUser", "a_b", "a-b", "a.b", "src/x", "HTTP", "A::b", "word", "two words", "", "How does it work?", "9lives"]
    assert column(spark, asked, text.is_symbol(F.col("t"))) == [True] * 7 + [False] * 5


def test_subwords(spark):
    assert column(spark, ["parseHTTPResponse snake_case x 42 ab utf_8 _id2", "", "a_42b __init__"], text.subwords(F.col("t"))) == [["case", "http", "id2", "parse", "response", "snake", "utf"], [], ["42b", "init"]]
    one = spark.createDataFrame([("//", "a/b.ts", "method", "run", "Foo", "Runs.", "run", "run() {}")], "mark string, path string, kind string, symbol string, parent string, context string, symbols string, content string")
    head = text.unit_header(*[F.col(c) for c in ("mark", "path", "kind", "symbol", "parent")])
    assert one.select(text.indexed_text(head, F.col("context"), F.col("symbols"), F.col("content"))).first()[0] == "// file: a/b.ts\n// method: run (in Foo)\nRuns.\nrun\nrun() {}\nfile foo method run"


def test_slug(spark):
    assert column(spark, ["Ödeme Şeması", "--a  b--", "!!!", "x" * 70], text.slug(F.col("t"))) == ["odeme-semasi", "a-b", "repo", "x" * 60]


def test_clip_keeps_characters_whole(spark):
    rows = ["a" * 9 + "é", "a" * 8 + "順序", "a" * 7 + "🙂b", "short"]
    assert column(spark, rows, text.clip_bytes(F.col("t"), 10)) == [x.encode()[:10].decode("utf-8", "ignore") for x in rows]


def test_sizes_and_slices(spark):
    assert column(spark, ["a\nb\nc\nd"], text.line_slice(F.col("t"), 2, 2)) == ["b\nc"]
    assert [r[0] for r in spark.range(1).select(text.human_size(F.lit(2048))).collect()] == ["2.0 KB"]


def test_vectors(spark):
    r = spark.sql("select array(3f, 4f) v, array(0f, 0f) z").select(vectors.norm(F.col("v")), vectors.normalised(F.col("v")), vectors.normalised(F.col("z")), vectors.dot(F.col("v"), F.col("v"))).first()
    assert r[0] == 5 and r[1] == [0.6, 0.8] and r[2] == [0.0, 0.0] and r[3] == 25


def test_paths(spark):
    rows = {
        "src/a.py": True, "node_modules/x/a.js": False, "a/vendor": False, "src/app.min.js": False, "README.md": True, "yarn.lock": False, "Dockerfile": True, ".env.example": True, "x.csv": False, "a/b.tsx": True, "bin/run.sh": False, "noext": False,
        "src/a.ts": True, "docs/README.md": True, "dist/app.min.js": False, "src/types.d.ts": False, "package-lock.json": False, "image.png": False, "Foo.Designer.cs": False, "Connected Services/Svc/Reference.cs": False, "Scripts/bootstrap.bundle.js": False,
        "data/export.csv": False, "schema.proto": True, "Pages/Index.razor": True, "Views/Home/Index.cshtml": True, "db/procs.sql": True, "Content/site.less": True, "x.weird": False, "app.csproj": True, "a.markdown": True, "go.mod": True, "BUILD": True,
    }
    assert column(spark, list(rows), paths.indexable(F.col("t"))) == list(rows.values())
    assert column(spark, ["x.weird"], paths.indexable(F.col("t"), paths.extra_suffixes("weird, .Odd"))) == [True] and paths.extra_suffixes(" weird, .Odd,") == [".odd", ".weird"]
    told = {
        "a/b.tsx": "tsx", "Program.cs": "csharp", "x.unknown": None, "m.sql": None, "PAY.cbl": None, "x.lua": "lua", "x.zig": "zig", "Cart.vue": "vue", "App.svelte": "svelte", "Index.razor": "razor", "Index.cshtml": "razor", "main.tf": "terraform", "X.KT": "kotlin",
        "Dockerfile": "dockerfile", "go.mod": "gomod", "a.json": None, "a.html": None, "a.css": None, "a.csv": None, "Jenkinsfile": "groovy", "a.pyi": "python",
    }
    assert column(spark, list(told), paths.language(F.col("t"))) == list(told.values())
    kinds = {"a.SQL": "code", "b.md": "doc", "c.py": "code", "d.json": "other", "README.mdx": "doc", "main.go": "code", "config.yaml": "other", "PAY.cbl": "code", "Cart.vue": "code", "a.less": "other"}
    assert column(spark, list(kinds), paths.category(F.col("t"))) == list(kinds.values())
    assert column(spark, ["m.sql", "a.py", "x.unknown"], paths.label(F.col("t"))) == ["sql", "python", ""]


def reference_redaction(value):
    """The rules one match after another, by the stdlib."""
    for label, p in redaction.KEYS:
        value = re.sub(p, label, value, flags=re.A)
    value = re.sub(redaction.EMAIL, lambda m: m[0] if re.search(redaction.RESERVED, m[0]) else "[EMAIL]", value, flags=re.A)
    for label, p in redaction.PHONES:
        value = re.sub(p, label, value, flags=re.A)

    def assigned(m):
        head = re.match(r"[A-Z0-9_]+\s*[:=]\s*", m[0])[0]
        v = m[0][len(head) :].strip("\"'")
        ok = len(v) >= 12 and not re.search(r"\s", v) and re.search("[0-9]", v) and re.search("[A-Za-z]", v) and not any(re.search(p, v) for p in redaction.NOT_SECRET)
        return head + "[SECRET]" if ok else m[0]

    return re.sub(redaction.ASSIGNED, assigned, value, flags=re.A)


def test_redaction_agrees_with_the_rules(spark, sf):
    rows = [
        'DB_PASSWORD="hunter2hunter2"', "API_TOKEN=process.env.TOKEN_1234567", "mail a.b@corp.io, x@mail5.example.com.", "see x@example.com.", "call +49 (30) 123 4567 or 555-123-4567", "ghp_" + "a1" * 15, "SECRET: 'short1'", "", "TOKEN=abcdefghijkl9 # note",
    ]
    rows += [r[0] for r in spark.read.parquet(f"{sf}/code_chunks.parquet").select("content").filter("content is not null").limit(300).collect()]
    ascii_rows = [r for r in rows if r.isascii()]
    df = spark.createDataFrame(list(enumerate(ascii_rows)), "i int, t string")
    assert [r["t"] for r in redaction.redacted(df, "t").orderBy("i").collect()] == [reference_redaction(r) for r in ascii_rows]


def test_redactions_by_label(spark):
    text = "DB_PASSWORD=hunter2hunter2\npassword varchar(255)\nAPI_TOKEN=process.env.API_TOKEN_12\nmail a.b@corp.io and x@example.com\nghp_" + "a1" * 15 + "\x01 end"
    row = redaction.redacted(spark.createDataFrame([(1, text), (2, None)], "i int, t string"), "t").orderBy("i").collect()
    assert row[0]["redactions"] == {"[SECRET]": 1, "[EMAIL]": 1, "[API_KEY]": 1}
    assert row[0]["t"] == "DB_PASSWORD=[SECRET]\npassword varchar(255)\nAPI_TOKEN=process.env.API_TOKEN_12\nmail [EMAIL] and x@example.com\n[API_KEY]\x01 end"
    assert row[1]["t"] is None
