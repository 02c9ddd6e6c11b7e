"""Hand-derived cases of the chunker."""

import pytest

from contextlake.operators.chunking import chunk_code, chunk_files

CASES = {
    "swallowed": ("js", "import { http } from './http';\nconst RETRIES = 3;\n\nexport async function login(user, pass) {\n  if (!user) {\n    throw new Error('x');\n  }\n  return http(user, pass);\n}", [("arrow", "RETRIES", 2, 9)]),
    "short rest": ("js", "function add(a, b) {\n  return a + b;\n}\n\nconst one = () => 1;", [("function", "add", 1, 3)]),
    "too short": ("js", "class P { }\n\nx", [("module", None, 1, 3)]),
    "indent": ("py", "import os\n\ndef load(path):\n    with open(path) as f:\n        return f.read()\n\nclass Store:\n    def get(self):\n        return 1", [("function", "load", 3, 6), ("class", "Store", 7, 9)]),
    "rust": ("rs", "pub struct P {\n    x: i32,\n}\n\nimpl P {\n    pub fn get(&self) -> i32 {\n        self.x\n    }\n}", [("struct", "P", 1, 3), ("impl", "P", 5, 9)]),
    "go": ("go", "package m\n\ntype P struct {\n  x int\n}\n\nfunc (p *P) Get() int {\n  return p.x\n}", [("struct", "P", 3, 5), ("function", "Get", 7, 9)]),
    "java": ("java", "import java.util.List;\npublic class T {\n  public int id() {\n    return 1;\n  }\n}", [("class", "T", 2, 6)]),
    "text": ("md", "# T\n\nhello\n", [("module", None, 1, 4)]),
    "container": ("ts", "class Big {\n  a() {\n    // " + "x" * 900 + "\n    return 1;\n  }\n  b() {\n    // " + "y" * 900 + "\n    return 2;\n  }\n}", [("method", "a", 2, 5), ("method", "b", 6, 9)]),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    language, content, expected = CASES[name]
    assert [(c.kind, c.name, c.start, c.end) for c in chunk_code(content, language)] == expected


def test_table(spark):
    rows = [(1, "js", CASES["short rest"][1], "x"), (2, None, "a\nb", "x"), (3, "py", None, "x"), (4, "py", "", "x"), (1, "js", CASES["short rest"][1], "x")]
    got = chunk_files(spark.createDataFrame(rows, "file_id long, language string, content string, name string")).collect()
    assert sorted((r.file_id, r.chunk_type, r.start_line, r.token_count) for r in got) == [(1, "function", 1, 11), (1, "function", 1, 11), (2, "module", 1, 1)]
    assert chunk_files(spark.createDataFrame([], "file_id long, language string, content string")).count() == 0
