"""Files cut into units: names, containers, lines, limits."""

import random

import pytest

from quillspark.operators import chunking, units

PYTHON = '"""Doc."""\nimport os\nfrom a.b import c\n\nX = 1\n\n\n@dec(\n    1)\ndef f(a,\n      b):\n    """x"""\n    return {\n  1: 2}\n\nclass K(Base):\n    """Doc of K."""\n    y = 1\n\n    def m(self):\n        return 1\n\n    @property\n    def n(self):\n        return """\nmulti\n"""\nif X:\n    pass\nelse:\n    pass\n'
TYPESCRIPT = "import { a } from './x';\n// note }\nexport class Foo<T> extends Bar {\n  private x: number = 1;\n\n  constructor(a: string) {\n    super(\"}\");\n  }\n\n  async run(q: string): Promise<void> {\n    if (q) {\n      return;\n    }\n  }\n}\n\nexport const z = (a) => {\n  return a;\n};\ninterface I { a: string }\nexport type T = string;\n"
GO = 'package a\n\nimport (\n\t"fmt"\n\t"x/y"\n)\n\ntype S struct {\n\ta int\n}\n\nfunc (s *S) M(a int) error {\n\treturn nil\n}\n\nfunc F() {\n\tfmt.Println("{")\n}\n'
JAVA = "package a;\n\nimport java.util.List;\n\n/** Doc. */\n@Entity\npublic final class A<T> {\n  private int n = 1;\n\n  public A(int n) {\n    this.n = n;\n  }\n\n  @Override\n  public List<String> names(int k) throws Exception {\n    return null;\n  }\n}\n"


def cut(path, text, category="code", language=None, most=120, least=20):
    return list(units.cut(path, text, category, language, most, least))


def names(rows):
    return [(r[0], r[1], r[2]) for r in rows if r[1]]


def test_declarations():
    assert names(cut("a.py", PYTHON, language="python")) == [("const", "X", ""), ("function", "f", ""), ("class", "K", ""), ("method", "m", "K"), ("method", "n", "K")]
    assert names(cut("a.ts", TYPESCRIPT, language="typescript", most=150)) == [("class", "Foo", ""), ("const", "x", "Foo"), ("method", "constructor", "Foo"), ("method", "run", "Foo"), ("const", "z", ""), ("interface", "I", ""), ("type", "T", "")]
    assert names(cut("a.go", GO, language="go", most=100)) == [("type", "S", ""), ("method", "M", ""), ("function", "F", "")]
    assert names(cut("A.java", JAVA, language="java", most=140)) == [("class", "A", ""), ("const", "n", "A"), ("method", "A", "A"), ("method", "names", "A")]


def test_headers_and_imports():
    rows = cut("a.py", PYTHON, language="python")
    assert rows[3][7] == "# file: a.py\n# method: m (in K)\n# imports: os, a.b"
    assert units.imports(TYPESCRIPT.split("\n")) == ["./x"] and units.imports(GO.split("\n")) == ["fmt", "x/y"] and units.imports(JAVA.split("\n")) == ["java.util.List"]
    long = "def f():\n" + "".join(f"    step_{i} = {i}\n" for i in range(40))
    rows = cut("b.py", long, language="python", most=200)
    assert len(rows) > 2 and all(r[1] == "f" and r[6] == len(rows) and len(r[9].encode()) <= 200 for r in rows) and rows[1][7].split("\n")[1] == f"# function: f [part 2/{len(rows)}]"
    assert all(b[3] == a[4] - units.OVERLAP + 1 for a, b in zip(rows, rows[1:]))


def test_markdown_is_packed_by_sections():
    text = "intro\n\n# A\n" + "word " * 30 + "\n\n## B\n" + "para para\n\n" * 30 + "### D\nd\n# C\nend"
    rows = cut("a.md", text, "doc", most=160)
    assert all(len(r[9].encode()) <= 160 for r in rows)
    assert [(r[1], r[2]) for r in rows if r[4]][0] == ("", "") and ("B", "A") in [(r[1], r[2]) for r in rows] and ("D", "A > B") in [(r[1], r[2]) for r in rows]
    parts = [r for r in rows if r[1] == "B"]
    assert [r[5] for r in parts] == list(range(1, len(parts) + 1)) and len(parts) > 1


def nonblank(text):
    return {i for i, x in enumerate(text.split("\n"), 1) if x.strip()}


@pytest.mark.parametrize("language", [None, "python", "typescript", "go"])
def test_odd_files(language):
    """Empty, one repeated line, many members, unbalanced brackets, random characters, one long line."""
    rng = random.Random(3)
    texts = [
        "", "   \n\n", "x = 1\n" * 500, "class A:\n" + "".join(f"    def m{i}(self):\n        return {i}\n" for i in range(600)), "class A {\n" + "".join(f"  m{i}() {{\n    return {i};\n  }}\n" for i in range(600)) + "}\n", "((((\n{{{\n]]\n'''\n\"\n`\n" * 40,
        "".join(rng.choice("ab{}()[]'\"`#/*\\ \n\t:=;@é") for _ in range(20_000)), "y" * 100_000,
    ]
    for text in texts:
        rows = cut("f", text, "code" if language else "other", language, 2000, 200)
        covered = {i for r in rows for i in range(r[3], r[4] + 1)}
        assert nonblank(text) <= covered
        lines = text.split("\n")
        assert all(r[9] == "\n".join(lines[r[3] - 1 : r[4]]) and (len(r[9].encode()) <= 2000 or r[3] == r[4]) for r in rows)


def test_files_of_a_table(spark):
    rows = [("r", "a.py", 1, 0, "x = 1\ny = 2"), ("r", "a.py", 2, 1, "y = 2\nz = 3"), ("r", "a.py", 6, 2, "def f():\n    return 1"), ("r", "a.py", 6, 2, "def f():\n    return 1"), ("r", "b.md", 1, 0, "# T\ntext"), ("r", "c.json", 1, 0, None), (None, "d.py", 1, 0, "x")]
    files = units.whole_files(spark.createDataFrame(rows, "repo_id string, path string, start_line int, ordinal int, content string").selectExpr("*", "1 as text"))
    assert {r["path"]: r["text"] for r in files.collect()} == {"a.py": "x = 1\ny = 2\nz = 3\n\n\ndef f():\n    return 1", "b.md": "# T\ntext"}
    got = [(r["path"], r["ordinal"], r["kind"], r["symbol"], r["start_line"], r["end_line"]) for r in units.chunk_files(files, 30, 10).orderBy("path", "ordinal").collect()]
    assert got == [("a.py", 0, "const", "x", 1, 2), ("a.py", 1, "const", "z", 3, 7), ("b.md", 0, "section", "T", 1, 2)]
    assert units.chunk_files(files.limit(0)).collect() == []


def test_trails(spark):
    docs = spark.createDataFrame([(1, "# A\n### B\n## C\n# D #\n#no\n####### x"), (2, ""), (3, None)], "id int, text string")
    assert [(r["first_line"], r["trail"]) for r in chunking.section_trails(docs).orderBy("first_line").collect()] == [(1, "A"), (2, "A > B"), (3, "A > C"), (4, "D #")]
