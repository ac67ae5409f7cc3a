"""Units and pieces: hand-made records of every language, the round trip, and limits."""

import random

import pytest

from loreweave.llm import split as S

CASES = {
    "python": ("a.py", '"""top"""\nimport x\n\n# note\n@dec(\n    1\n)\ndef f():\n    """doc\ndef no():\n    """\n    def inner():\n        pass\n\nCODE = """\ndef text():\n"""\n\n# def gone():\n#     x\n\nasync def g():\n    pass\nclass C:\n    pass\n', [4, 22, 24]),
    "go": ("a.go", "package a\n\n// F does\nfunc F() {\n\tgo func() {}()\n}\n\nfunc (r *T) M() {\n}\n/*\nfunc No() {\n}\n*/\n\ntype T struct {\n}\nvar q = `\nfunc text() {}\n`\n", [3, 8, 15]),
    "typescript": ("a.ts", "import x from 'x';\n/** doc */\n@Inject()\nexport class A {\n  m() {}\n}\n\nexport const f = async (a: A) => {\n  const g = () => 1;\n};\ninterface I {\n}\nconst n = 5;\nconst t = `\nfunction no() {\n}`;\ntype U = string;\nenum E { A }\n", [2, 8, 11, 17, 18]),
    "rust": ("a.rs", "use a::b;\n#[derive(Debug)]\n/// doc\npub struct S {\n}\n\nimpl S {\n    fn m() {}\n}\nfn f<'a>(x: &'a str) -> char { '{' }\nmod tests {\n    fn t() {}\n}\n", [2, 7, 10, 11]),
    "java": ("A.java", "import a;\n/**\n * doc\n */\n@Immutable\npublic final class A extends B {\n    void m() { String s = \"}\"; }\n}\n\nenum E {\n}\n// class No {\n\ninterface I {}\n", [2, 10, 14]),
    "c": ("a.c", "#include <a.h>\n#define X 1\nint proto(int a);\n\n/* doc */\nstatic int f(const char *s) {\n    if (s) { return 1; }\n}\nstruct s {\n    int a;\n};\nint g(void)\n{\n}\nenum e { A, B };\nstruct s v = { 1 };\n", [5, 9, 12, 15]),
    "ruby": ("a.rb", "require 'a'\n=begin\ndef no\n=end\n# doc\ndef f(a)\n  x = <<~T\ndef text\n  T\nend\n\nmodule M\n  class C\n  end\nend\n", [2, 12]),
    "bash": ("a.sh", "#!/bin/bash\nset -e\nf() {\n  x=1\n}\ncat <<EOF\ng() {\nEOF\n# doc\nfunction h {\n}\n", [3, 9]),
}


@pytest.mark.parametrize("lang", CASES)
def test_units_by_language(lang):
    path, text, lines = CASES[lang]
    assert [n for n, _ in S.unit_starts(text, "code", lang, path)] == lines
    assert [n for n, _ in S.unit_starts(text.replace("\n", "\r\n"), "code", lang, path)] == lines


def test_headings_of_pages():
    text = "---\ntitle: x\n# no\n---\n# One\ntext\n```\n# no\n```\n<!-- note -->\n## Two\n    # code\n#tag\n###### Six\n"
    assert S.unit_starts(text, "wiki", None, "a.md") == [(5, "One"), (10, "Two"), (14, "Six")]


def rebuilt(parts):
    return "".join("".join(S.split_lines(p[5])[p[6] :])[p[7] :] for p in parts)


@pytest.mark.parametrize("seed", range(12))
def test_pieces_are_within_limits_and_whole(seed):
    rng = random.Random(seed)
    lines = [("    " * rng.randrange(3) + "x" * rng.randrange(120)) if rng.random() > 0.1 else "" for _ in range(rng.randrange(1, 400))]
    for k in range(0, len(lines), 37):
        lines[k] = f"def f{k}():"
    if seed % 3 == 0:
        lines[len(lines) // 2] = "word. " * 9000
    text = ("\r\n" if seed % 2 else "\n").join(lines) + ("\n" if seed % 4 else "")
    parts = S.pieces(text, "code", "python", "a.py")
    assert rebuilt(parts) == text
    if S.oversized(text):
        assert not any(S.oversized(p[5]) for p in parts)
    for before, after in zip(parts, parts[1:]):
        assert after[0] <= before[1] + 1 and (after[6] in (0, 10) or after[6] < 10)


@pytest.mark.parametrize("line", ["word. " * 9000, "x" * 30_000, "y " * 20_000 + "z" * 13_000])
def test_cuts_inside_a_line_share_its_characters(line):
    parts = S.pieces(line, "code", None, "a.txt")
    assert rebuilt(parts) == line and not any(S.oversized(p[5]) for p in parts)
    assert parts[0][7] == 0 and all(100 <= p[7] <= 200 for p in parts[1:])
    assert all(b[5].startswith(a[5][-b[7] :]) for a, b in zip(parts, parts[1:]))


def test_cuts_inside_a_unit_share_ten_lines():
    text = "def f():\n" + "    x = 1\n" * 200 + "def g():\n    pass\n"
    parts = S.pieces(text, "code", "python", "a.py")
    assert [p[6] for p in parts] == [0] + [10] * (len(parts) - 2) + [0]
    assert [p[4] for p in parts] == ["f"] * (len(parts) - 1) + ["g"]


def test_frames(spark):
    big = "# A\n" + "text\n" * 100 + "## B\nend"
    rows = [(1, "wiki", None, "a.md", 0, None, big, 5), (1, "wiki", None, "a.md", 0, None, big, 5), (2, "code", None, None, None, None, None, 5), (3, None, None, None, None, "f", "", 5), (4, "code", "python", "a.py", 11, "f", "x = 1\n" * 81, 5), (None, "code", "python", "a.py", 1, "f", big, 5)]
    df = spark.createDataFrame(rows, "id bigint, kind string, lang string, file_path string, line_start int, func_name string, content string, piece_no int").withColumn("line_end", df_null())
    assert sorted(map(tuple, S.find_units(df).select("id", "line_no").collect())) == [(1, 1), (1, 102), (4, 1)]
    got = S.split_oversized(df).collect()
    assert sorted({r.id for r in got}) == [1, 2, 3, 4]
    assert [(r.line_start, r.line_end) for r in sorted(got, key=lambda r: r.piece_no) if r.id == 4] == [(11, 90), (81, 91)]
    assert S.find_units(df.limit(0)).count() == 0 and S.split_oversized(df.limit(0)).count() == 0


def df_null():
    from pyspark.sql import functions as F

    return F.lit(None).cast("int")
