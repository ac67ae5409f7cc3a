"""Problem 1: oversized index records, cut at natural boundaries.

A separator hierarchy is applied from the top: units (functions, types, modules, headings),
then blank lines, then statements of the least indentation, then lines; a single line beyond
the limit is cut at sentences, words and at last characters. Pieces are packed greedily up
to both limits. Cuts between units share nothing, cuts inside a unit share ``overlap`` lines.

Null content gives one piece as it is; empty content one empty piece. Repeated rows (same
id and content) count once. Line ends (LF, CRLF) stay in the pieces, so that the pieces
without their shared lines and characters are the content again, byte by byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..session import sized_broadcast
from .common import spread

MAX_CHARS, MAX_LINES, OVERLAP, OVERLAP_CHARS = 12_000, 80, 10, 200

# File endings and spellings of the languages whose units are known.
FAMILIES = {
    "python": "py pyi python pyw",
    "script": "js jsx mjs cjs ts tsx javascript typescript",
    "go": "go golang",
    "rust": "rs rust",
    "java": "java kt kotlin scala cs csharp swift",
    "c": "c h cc cpp hpp cxx",
    "ruby": "rb ruby",
    "shell": "sh bash zsh shell",
    "php": "php",
}
BY_NAME = {name: family for family, names in FAMILIES.items() for name in names.split()}

MODS = r"(?:(?:export|default|declare|public|private|protected|internal|static|final|abstract|sealed|async|open|data|partial|unsafe|extern(?:\s+\"[^\"]*\")?|const|inline|virtual|override|pub(?:\([^)]*\))?|crate|strictfp|non-sealed)\s+)*"
UNITS = {
    "python": re.compile(r"(?:async\s+def|def|class)\s+(?P<n>\w+)"),
    "script": re.compile(
        MODS
        + r"(?:function\b\s*\*?\s*(?P<n>[\w$]*)|(?:abstract\s+)?class\b\s*(?P<c>[\w$]*)|(?:interface|enum|namespace|module)\s+(?P<i>[\w$.\"'-]+)\s*(?:extends|<|\{|$)|(?:const\s+)?enum\s+(?P<e>[\w$]+)|type\s+(?P<t>[\w$]+)\s*(?:<[^=]*>)?\s*="
        + r"|(?:const|let|var)\s+(?P<a>[\w$]+)\s*(?::[^=]+(?:=>[^=]+)?)?=\s*(?:async\b\s*)?(?:function\b|class\b|(?:<[^>]*>\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)?|[\w$]+)\s*(?::[^=]+)?(?:=>|$)))"
    ),
    "go": re.compile(r"func\s*(?:\([^)]*\)\s*)?(?P<n>\w+)|type\s+(?P<t>\w+)\s*(?:\[[^\]]*\]\s*)?(?:=\s*)?[\w*\[\](.]"),
    "rust": re.compile(
        MODS + r"(?:fn\s+(?P<n>\w+)|(?:struct|enum|union|trait|mod|type)\s+(?P<t>\w+)|impl\b\s*(?:<[^>{]*>)?\s*(?P<i>[^{]*)|macro_rules!\s*(?P<m>\w+))"
    ),
    "java": re.compile(MODS + r"(?:@interface|class|interface|enum|record|struct|object|trait|protocol|extension|namespace|module|fun|func)\s+(?P<n>\w+)"),
    "c": re.compile(
        r"(?:typedef\s+)?(?:(?:static|const|extern|inline)\s+)*(?:struct|union|enum|class|namespace)\s+(?P<t>\w+)?[^;()=]*(?:\{|$)"
        r"|(?!(?:return|if|else|while|for|switch|do|case|goto|typedef|using)\b)(?:[A-Za-z_][\w:<>,]*[\s*&]+)+(?P<n>[\w:~]+)\s*\([^;={]*(?:\{.*|,|\)|\)\s*(?:const|noexcept|override)?\s*)$"
    ),
    "ruby": re.compile(r"(?:def\s+(?P<n>[\w.?!=]+)|(?:class|module)\s+(?P<t>[\w:]+))"),
    "shell": re.compile(r"(?:function\s+(?P<n>[\w:.-]+)|(?P<t>[\w:.-]+)\s*\(\s*\))\s*(?:\(\s*\))?\s*(?:[{(]|$)"),
    "php": re.compile(MODS + r"(?:function|class|interface|trait|enum|namespace)\s+(?P<n>\w+)"),
}
STRING = r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?"
C_COMMENTS = r"(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))"
TOKENS = {
    "python": r"(?P<text>[rbufRBUF]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)))|(?P<str>" + STRING + r")|(?P<line>\#[^\n]*)|(?P<open>[(\[{])|(?P<close>[)\]}])",
    "script": C_COMMENTS + r"|(?P<text>`(?:\\.|[^`\\])*`?)|(?P<str>" + STRING + r")|(?P<re>(?<=[=(,:;!&|?{}\n])\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)|(?P<open>[(\[{])|(?P<close>[)\]}])",
    "go": C_COMMENTS + r"|(?P<text>`[^`]*`?)|(?P<str>" + STRING + r")|(?P<open>[(\[{])|(?P<close>[)\]}])",
    "rust": C_COMMENTS + r"|(?P<text>b?r(?P<h>\#*)\".*?\"(?P=h)|b?\"(?:\\.|[^\"\\])*\"?)|(?P<str>'(?:\\[^\n]{1,10}?|[^\\'\n])')|(?P<open>[(\[{])|(?P<close>[)\]}])",
    "java": C_COMMENTS + r"|(?P<text>\"\"\".*?(?:\"\"\"|\Z))|(?P<str>" + STRING + r")|(?P<open>[(\[{])|(?P<close>[)\]}])",
    "c": C_COMMENTS + r"|(?P<str>" + STRING + r")|(?P<open>[(\[{])|(?P<close>[)\]}])",
    "ruby": r"(?P<block>^=begin\b.*?(?:^=end\b[^\n]*|\Z))|(?P<here><<[~-]?(?P<q>[\"'`]?)(?P<tag>[A-Za-z_]\w*)(?P=q)[^\n]*\n.*?(?:^[ \t]*(?P=tag)\b|\Z))|(?P<text>%[qQ]?(?:\([^)]*\)|\{[^}]*\}|\[[^\]]*\]))|(?P<str>" + STRING + r")|(?P<line>\#[^\n]*)",
    "shell": r"(?P<here><<-?\s*(?P<q>[\"']?)(?P<tag>[A-Za-z_]\w*)(?P=q)[^\n]*\n.*?(?:^[ \t]*(?P=tag)[ \t\r]*$|\Z))|(?P<str>\"(?:\\.|[^\"\\])*\"?|'[^']*'?|\\.)|(?P<line>(?:^|(?<=[\s;]))\#[^\n]*)|(?P<sub>\$\{[^}\n]*\})|(?P<open>[{])|(?P<close>[}])",
    "php": C_COMMENTS + r"|(?P<str>" + STRING + r")|(?P<open>[(\[{])|(?P<close>[)\]}])",
}
TOKENS = {k: re.compile(v, re.S | re.M) for k, v in TOKENS.items()}
BY_INDENT = {"python", "ruby", "shell"}
ATTRIBUTE = {
    "python": re.compile(r"@"),
    "script": re.compile(r"@[\w$]"),
    "rust": re.compile(r"#!?\["),
    "java": re.compile(r"@(?!interface\b)\w|\[[A-Z]\w*[\](]"),
    "c": re.compile(r"\[\[|__attribute__"),
    "php": re.compile(r"#\["),
}
INLINE_ATTRIBUTE = re.compile(r"(?:@(?!interface\b)[\w.$]+(?:\([^()]*\))?\s+|#\[[^\]]*\]\s*)+")
FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]+(?P<n>.*?)(?:[ \t]+#+)?[ \t]*$|$)")
SENTENCE_END = re.compile(r"[.!?。！？;]\s|[;,}]")


def family_of(lang: str | None, path: str | None) -> str | None:
    """The language family by the path's ending, else by the language as spelled."""
    ending = (path or "").rsplit(".", 1)[-1].lower()
    return BY_NAME.get(ending) or BY_NAME.get((lang or "").strip().lower())


def split_lines(text: str) -> list[str]:
    """Lines with their ends; LF and CRLF only, an end at the very end opens no further line."""
    lines = text.split("\n")
    kept = [x + "\n" for x in lines[:-1]]
    return kept + [lines[-1]] if lines[-1] else kept


def _named(m: re.Match) -> str:
    return next((v.strip() for v in m.groupdict().values() if v), "")


def _wiki_units(lines: list[str]) -> list[tuple[int, str]]:
    units, fence, remark, pending = [], "", False, 0
    front = bool(lines) and lines[0].strip() == "---"
    for n, raw in enumerate(lines, 1):
        line = raw.rstrip("\r\n")
        if front:
            front = not (n > 1 and line.strip() in ("---", "..."))
            continue
        if remark:
            remark = "-->" not in line
            continue
        if fence:
            if line.strip().startswith(fence) and not line.strip().strip(fence[0]):
                fence = ""
            continue
        opened = FENCE.match(line)
        if opened:
            fence, pending = opened.group(1), 0
            continue
        if line.lstrip().startswith("<!--"):
            pending = pending or n
            remark = "-->" not in line
            continue
        m = HEADING.match(line)
        if m:
            units.append((pending or n, m["n"] or ""))
        pending = 0
    return units


def _code_units(text: str, lines: list[str], family: str) -> list[tuple[int, str]]:
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line)
    count = len(lines)
    inside: list[str] = [""] * count  # what the start of a line stands in: c(omment), s(tring) or nothing
    depth_at = [0] * count
    comment_only = [False] * count
    depth, row = 0, 0
    for m in TOKENS[family].finditer(text):
        kind, a, b = m.lastgroup, m.start(), m.end()
        if kind in ("q", "tag", "h"):
            kind = "here" if m.groupdict().get("here") else "text"
        while row + 1 < count and starts[row + 1] <= a:
            row += 1
            depth_at[row] = depth
        if kind == "open":
            depth += 1
        elif kind == "close":
            depth = max(0, depth - 1)
        else:
            first = row
            while row + 1 < count and starts[row + 1] < b:
                row += 1
                depth_at[row] = depth
                inside[row] = "c" if kind == "block" else "s"
            if kind in ("line", "block") and not text[starts[first] : a].strip() and not inside[first]:
                rest = text[b : starts[row] + len(lines[row])].strip()
                comment_only[first] = not rest or kind == "line" or rest.startswith(("//", "/*"))
    while row + 1 < count:
        row += 1
        depth_at[row] = depth
    unit, attribute = UNITS[family], ATTRIBUTE.get(family)
    units: list[tuple[int, str]] = []
    pending, open_attribute = 0, False
    for k, raw in enumerate(lines):
        line = raw.rstrip("\r\n")
        n = k + 1
        if inside[k] == "c":
            continue
        if inside[k] or depth_at[k] > 0 and family not in ("ruby",):
            if not open_attribute:
                pending = 0
            continue
        body = line.strip()
        if not body:
            pending, open_attribute = 0, False
            continue
        indented = line[:1] in " \t"
        if family in BY_INDENT and indented and not comment_only[k]:
            pending = 0
            continue
        if comment_only[k]:
            pending = 0 if family in BY_INDENT and indented else pending or n
            continue
        if attribute and attribute.match(body):
            inline = INLINE_ATTRIBUTE.match(body + " ")
            m = unit.match(body[inline.end() :]) if inline and inline.end() < len(body) else None
            if m:
                units.append((pending or n, _named(m)))
                pending, open_attribute = 0, False
            else:
                pending, open_attribute = pending or n, True
            continue
        m = unit.match(body)
        if m and not (family == "c" and body.endswith(";") and "{" not in body):
            units.append((pending or n, _named(m)))
        pending, open_attribute = 0, False
    return units


def unit_starts(text: str, kind: str | None, lang: str | None, path: str | None) -> list[tuple[int, str]]:
    """(line, name) of each outermost unit in order; names may be empty."""
    lines = split_lines(text)
    if kind == "wiki":
        return _wiki_units(lines)
    family = family_of(lang, path)
    return _code_units(text, lines, family) if family else []


def oversized(text: str, max_chars: int = MAX_CHARS, max_lines: int = MAX_LINES) -> bool:
    return len(text) > max_chars or text.count("\n") + (not text.endswith("\n") and text != "") > max_lines


def _line_cuts(line: str, limit: int, shared: int) -> list[tuple[int, int, int]]:
    """Pieces of one long line: (start, end, characters shared with the piece before), cut after a sentence, else a word, else at the limit.

    What is shared begins with a word where one begins there.
    """
    parts, at, before = [], 0, 0
    while len(line) - at + before > limit:
        room = limit - before
        window = line[at : at + room]
        ends = [m.end() for m in SENTENCE_END.finditer(window, room // 2)]
        cut = ends[-1] if ends else window.rfind(" ") + 1
        end = at + (cut if cut > room // 4 else room)
        parts.append((at - before, end, before))
        begin = max(end - shared, 0)
        word = line.find(" ", begin, end - 1) + 1
        before, at = end - (word if 0 < word < begin + shared // 2 else begin), end
    return [*parts, (at - before, len(line), before)]


def pieces(text: str, kind: str | None, lang: str | None, path: str | None, max_chars: int = MAX_CHARS, max_lines: int = MAX_LINES, overlap: int = OVERLAP, overlap_chars: int = OVERLAP_CHARS):
    """Pieces of one text: (first line, last line, first column, end column or None, name, content, lines and characters shared with the piece before)."""
    lines = split_lines(text)
    if not oversized(text, max_chars, max_lines):
        return [(1, max(1, len(lines)), None, None, None, text, 0, 0)]
    sizes = [len(x) for x in lines]
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    fits = lambda a, b: b - a <= max_lines and total[b] - total[a] <= max_chars
    starts = dict(unit_starts(text, kind, lang, path))
    bounds = sorted({0, *(n - 1 for n in starts)})
    out = []

    def name_at(a: int, b: int) -> str | None:
        return next((starts[n] for n in range(a + 1, b + 1) if starts.get(n)), None)

    def inside(a: int, b: int) -> None:
        """Cut one unit that is over the limits: lines a to b, 0-based, end exclusive."""
        unit, at, before = name_at(a, b), a, 0
        while at < b:
            if sizes[at] > max_chars:
                for x, y, shared in _line_cuts(lines[at], max_chars, min(overlap_chars, max_chars // 4)):
                    out.append((at + 1, at + 1, x, y, unit, lines[at][x:y], 0, shared))
                at, before = at + 1, 0
                continue
            end = at
            while end < b and sizes[end] <= max_chars and fits(at - before, end + 1):
                end += 1
            if end == at:  # the shared lines alone fill the piece
                before -= 1
                continue
            if end < b and sizes[end] <= max_chars:
                low = at + max(1, (end - at) // 3)
                blank = next((k for k in range(end, low, -1) if not lines[k - 1].strip()), 0)
                if not blank:
                    indents = [(len(lines[k]) - len(lines[k].lstrip()), -k) for k in range(low + 1, end + 1) if k < b and lines[k].strip() and lines[k].strip()[0] not in "})]"]
                    blank = -min(indents)[1] if indents else 0
                end = blank or end
            out.append((at - before + 1, end, None, None, unit, "".join(lines[at - before : end]), before, 0))
            before, at = min(overlap, end - at), end

    a = 0
    while a < len(lines):
        nexts = [x for x in bounds if x > a] + [len(lines)]
        end = next((x for x in reversed(nexts) if fits(a, x)), None)
        if end is None:
            inside(a, nexts[0])
            end = nexts[0]
        else:
            out.append((a + 1, end, None, None, name_at(a, end), "".join(lines[a:end]), 0, 0))
        a = end
    return out


def _big(chunks: DataFrame, max_chars: int, max_lines: int) -> Column:
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + F.when(F.col("content").endswith("\n"), 0).otherwise(1)
    return (F.length("content") > max_chars) | (lines > max_lines)


def find_units(chunks: DataFrame, max_chars: int = MAX_CHARS, max_lines: int = MAX_LINES) -> DataFrame:
    """For each oversized record its boundaries: ``id``, ``line_no`` (1 and the first line of each unit), ``unit``."""
    slim = chunks.select("id", "kind", "lang", "file_path", "content").where(F.col("id").isNotNull() & _big(chunks, max_chars, max_lines))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, kind, lang, path, text in pdf[["id", "kind", "lang", "file_path", "content"]].itertuples(index=False, name=None):
                found = {1: ""} | dict(reversed(unit_starts(text, kind, lang, path)))
                rows.extend((key, n, unit) for n, unit in found.items())
            if rows:
                yield pd.DataFrame(rows, columns=["id", "line_no", "unit"])

    found = spread(slim, "id").mapInPandas(scan, "id bigint, line_no int, unit string")
    return found.groupBy("id", "line_no").agg(F.max("unit").alias("unit"))


PIECES = ArrayType(StructType([
    *(StructField(c, IntegerType()) for c in ("piece_no", "n_pieces", "line_start", "line_end", "col_start", "col_end")),
    StructField("func_name", StringType()), StructField("content", StringType()), StructField("shared_lines", IntegerType()), StructField("shared_chars", IntegerType()),
]))


def split_oversized(chunks: DataFrame, max_chars: int = MAX_CHARS, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """All records within the limits: small ones as they are (``piece_no`` 1), oversized ones as pieces.

    Columns: ``id``, ``piece_no``, ``n_pieces``, ``line_start``, ``line_end``, ``col_start``, ``col_end`` (pieces
    of one long line only), ``func_name``, ``content``, ``shared_lines``, ``shared_chars`` (of one long line). Line numbers continue those of the record
    (from 1 where it has none, as wiki rows do).
    """
    base = chunks.select("id", "kind", "lang", "file_path", "line_start", "line_end", "func_name", "content").where("id is not null")
    # only records of repeated ids are shuffled with their texts, as long as these ids are few enough to be sent along
    again = sized_broadcast(base.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    once = base.join(again, "id", "left_anti").unionByName(base.join(again, "id", "left_semi").dropDuplicates(["id"]))

    @F.pandas_udf(PIECES)
    def cut(texts: pd.Series, kinds: pd.Series, langs: pd.Series, paths: pd.Series, firsts: pd.Series, owns: pd.Series) -> pd.Series:
        found = []
        for text, kind, lang, path, first, own in zip(texts, kinds, langs, paths, firsts, owns):
            if text is None:
                found.append(None)
                continue
            parts = pieces(text, kind, lang, path, max_chars, max_lines, overlap)
            shift = int(first) - 1 if first == first and first and first > 0 else 0
            found.append([
                {"piece_no": no, "n_pieces": len(parts), "line_start": a + shift, "line_end": b + shift, "col_start": x, "col_end": y, "func_name": unit or own, "content": content, "shared_lines": lines, "shared_chars": chars}
                for no, (a, b, x, y, unit, content, lines, chars) in enumerate(parts, 1)
            ])
        return pd.Series(found, dtype=object)

    big = F.coalesce(_big(once, max_chars, max_lines), F.lit(False))
    # only oversized texts go through Python, and the table is read as one
    parts = cut(F.when(big, F.col("content")), "kind", "lang", "file_path", "line_start", "func_name")
    none, one, zero = F.lit(None).cast("int"), F.lit(1), F.lit(0)
    small = F.array(F.struct(
        one.alias("piece_no"), one.alias("n_pieces"), "line_start", "line_end", none.alias("col_start"), none.alias("col_end"), "func_name", "content", zero.alias("shared_lines"), zero.alias("shared_chars")
    ))
    return once.select("id", "line_start", "line_end", "func_name", "content", parts.alias("_p")).select("id", F.explode(F.coalesce("_p", small)).alias("p")).select("id", "p.*")


def reassembled(pieces_: DataFrame) -> DataFrame:
    """The contents again from their pieces (``id``, ``content``), shared lines and characters taken out, and whether every piece was within the limits."""
    lines = F.concat(F.lit(r"(?s)\A(?:[^\n]*\n){"), F.col("shared_lines").cast("string"), F.lit("}"))
    own = F.substring(F.regexp_replace("content", lines, F.lit("")), F.col("shared_chars") + 1, F.length("content"))
    parts = F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own"))))  # the pieces of one record
    return pieces_.where("content is not null").groupBy("id").agg(F.array_join(F.transform(parts, lambda p: p["own"]), "").alias("content"), F.bool_and(~_big(pieces_, MAX_CHARS, MAX_LINES) | (F.col("content") == "")).alias("within"))
