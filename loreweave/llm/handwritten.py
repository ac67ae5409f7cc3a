"""Problem 3: files that nobody here wrote by hand.

Three sources of evidence, by file: (1) an inverted index of line hashes, from which the exact
containment of a file in files of other projects follows, however often a line stands, so that an
edited copy of third-party source is found without any mark; (2) marks: comments and paths that
tools and vendored copies leave; (3) token composition: minified scripts and data kept as source.
Each file comes with the evidence that holds for it, the first of them names the reason.

Configuration files are never cases. Null content counts as empty, rows with a null
project or path are no file and are left out, repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoints, spread

#: Classes of equal files that the first round meets on a line.
ANCHORS = 32
COMMENT = r"^[ \t]{0,3}(?:#|//|/\*|\*|--|;|<!--|\"\"\"|'''|%)[^\n]{0,400}?"
HINT = re.compile(r"(?i)generat|génér|gener[ai]|erzeugt|overwritten|emitted by|produced by|created|regenerate|vendored|upstream|bundled|contributors|copied|authors|modificare|automatically|written|lost when")
# Phrases by which tools mark their output.
GENERATED = re.compile(
    COMMENT
    + r"(?:@generated\b|<auto-?generated|\bauto-?(?:matically[ -])?generated\b|\b(?:code|file|source|module|class|stub|parser|schema|bindings?)s? (?:is |was |are |were |has been )?(?:auto(?:matically)?[- ])?generated (?:by|from|with|using|automatically)"
    + r"|^\W*generated (?:by|from|with|using|automatically)\b|\bautomatically (?:created|produced|built|written)\b|\b(?:was|is|were) (?:produced|written|emitted|created) by \S+ from\b|\bemitted by \S+[^\n]*(?:do not|don't)"
    + r"|\b(?:edits?|changes?)\b[^\n]*\b(?:will be |are |get )?(?:overwritten|lost when)|\bregenerate instead of\b|\bdo not (?:edit|modify|touch)\b[^\n]*\bgenerated|\bgenerated\b[^\n]*\bdo not (?:edit|modify|touch)"
    + r"|\bgenerato automaticamente\b|\bnon modificare a mano\b|\bgénéré automatiquement\b|\bautomatisch (?:generiert|erzeugt)|\bgenerado automáticamente\b)",
    re.I | re.M,
)
# Phrases of copies of third parties' sources.
VENDORED = re.compile(
    COMMENT
    + r"(?:\bvendored (?:from|copy)|\bupstream:\s*[\w./-]+@[0-9a-f]{4,}|\bcopied (?:verbatim )?from [\w./-]+ (?:at|@|v\d)|\bbundled copy\b|v?\d+(?:\.\d+)+[^\n]*\(c\)[^\n]*\b(?:contributors|authors)\b)",
    re.I | re.M,
)
SEGMENT = r"(?:^|[/\\])"
VENDOR_PATH = SEGMENT + r"(?:vendor|third[_-]?party|node_modules|bower_components|jspm_packages|Pods|Carthage|site-packages|dist-packages|external|externals|extern|deps|contrib[/\\]+upstream)[/\\]+[^/\\]+[/\\]"
GENERATED_PATH = (
    SEGMENT + r"(?:generated|__generated__|_generated|autogen|auto_generated|autogenerated|gen|gen-src|generated-sources)[/\\]"
    r"|(?:\.pb\.(?:go|h|cc|c|py|js|ts|rs|java|rb)|_pb2(?:_grpc)?\.pyi?|\.(?:gen|g|generated|designer|freezed)\.\w+|_generated\.\w+)$"
)
MINIFIED_PATH = r"(?i)(?:[.-]min|\.bundle|[.-]bundle\.min|\.chunk|[._-](?=[a-f]*\d)[0-9a-f]{8,20})\.(?:js|mjs|cjs|css)$"
CONFIG_PATH = r"(?i)(?:\.(?:json|ya?ml|toml|ini|cfg|conf|properties|env|xml|lock|md|txt|rst)|\.env[\w.-]*)$"

IDENTIFIER = re.compile(r"[A-Za-z_$][\w$]*")
BASE64_RUN = re.compile(r"[A-Za-z0-9+/]{300,}")
CSV_LINE = re.compile(r"[\w.\-]+(?:[,;\t|][\w.\-]*){2,}[,;]?$")
RECORD = re.compile(r"[{\[]\s*[\"']?\w+[\"']?\s*[:,]\s*[\"'\d-]")
MEMBER = re.compile(r"\"[^\"]+\"\s*:\s*(?:\[[^\]]*\]|\{[^}]*\}|-?[\d.]+|\"[^\"]*\"|true|false|null),?$")
DIGIT = re.compile(r"\d")


def composition(text: str) -> tuple[int, int]:
    """Characters of data lines, and of minified code, in one record of a file."""
    data = 0
    long_chars = 0
    for line in text.split("\n"):
        n = len(line)
        if n < 4:
            continue
        if n >= 200:
            long_chars += n
            runs = sum(len(m.group()) for m in BASE64_RUN.finditer(line)) if n >= 300 else 0
            if runs > 0.6 * n or len(RECORD.findall(line)) >= max(8, n / 80) and line.count("(") < n / 200:
                data += n
                continue
        s = line.strip()
        digits = len(DIGIT.findall(s))
        if digits >= 0.33 * len(s) and "=" not in s.rstrip("=[{(") and not s.startswith(("#", "//")) or digits and CSV_LINE.match(s) or s[0:1] == '"' and MEMBER.match(s):
            data += n
    size = len(text)
    minified = 0
    if size >= 120 and data < 0.3 * size and long_chars > 0.5 * size:
        blanks = sum(text.count(c) for c in " \t\n\r")
        if blanks < 0.10 * size:
            names = IDENTIFIER.findall(text)
            if len(names) >= 15 and sum(len(w) == 1 for w in names) >= 0.3 * len(names):
                minified = size
    return data, minified


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text in pdf["content"]:
            text = text or ""
            hint = HINT.search(text) is not None
            data, minified = composition(text)
            rows.append((len(text), bool(hint and GENERATED.search(text)), bool(hint and VENDORED.search(text)), data, minified))
        f = pd.DataFrame(rows, columns=["chars", "generated", "vendored", "data", "minified"])
        yield pd.concat([pdf[["project", "file_path", "id"]].reset_index(drop=True), f], axis=1)


def file_features(chunks: DataFrame) -> DataFrame:
    """One row per code file: sizes, composition and the marks found in it."""
    code = chunks.where("kind = 'code' and project is not null and file_path is not null").select("project", "file_path", "id", "content")
    found = spread(code, "id").mapInPandas(
        _features, "project string, file_path string, id bigint, chars int, generated boolean, vendored boolean, data int, minified int"
    )
    once = found.repartition("project", "file_path").groupBy("project", "file_path", "id").agg(
        *[F.max(c).alias(c) for c in ("chars", "generated", "vendored", "data", "minified")]
    )
    return once.groupBy("project", "file_path").agg(
        F.count("*").alias("n_records"),
        F.sum("chars").alias("chars"),
        F.bool_or("generated").alias("generated"),
        F.bool_or("vendored").alias("vendored"),
        F.sum("data").alias("data"),
        F.sum("minified").alias("minified"),
    )


def file_lines(chunks: DataFrame, min_chars: int = 24) -> DataFrame:
    """The inverted index's postings: hash of each distinct line with project and file; shorter lines stand in any file."""
    lines = F.array_distinct(
        F.transform(F.filter(F.split("content", r"\s*\n\s*"), lambda s: F.length(s) >= min_chars), lambda s: F.xxhash64(F.trim(s)))
    )
    return (
        chunks.where("kind = 'code' and project is not null and file_path is not null")
        .select(F.xxhash64("project").alias("p"), F.xxhash64("project", "file_path").alias("f"), F.explode(lines).alias("h"))
    )


def line_classes(chunks: DataFrame) -> DataFrame:
    """Every file with lines: ``p``, ``f``, its distinct line hashes ``hs`` and the class ``c`` of all files with the same ones."""
    files = file_lines(chunks).groupBy("p", "f").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    return files.withColumn("c", F.xxhash64("hs")).checkpoint()


def _index(files: DataFrame, least: float, min_lines: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes (``c``, ``hs``, ``lines``), the lines each probes (``h``, standing in ``n`` classes), and the postings of lines in several classes.

    An exact prefix filter: a class probes only its rarest lines, one more than it may miss. A line that stands everywhere is probed only by
    files that have little else.
    """
    classes = files.groupBy("c").agg(F.first("hs").alias("hs")).withColumn("lines", F.size("hs")).checkpoint()
    posted = classes.select("c", "lines", F.explode("hs").alias("h"))
    shared = posted.groupBy("h").agg(F.count("*").alias("n")).where("n >= 2").checkpoint()
    kept = posted.join(shared, "h").checkpoint()
    ordered = kept.where(f"lines >= {min_lines}").groupBy("c", "lines").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("x"))
    # lines of no other class come first in the order and find nothing: lines - size(x) of them
    probes = F.expr(f"cast(greatest(size(x) - ceil({least} * lines) + 1, 0) as int)")
    probe = ordered.select("c", "lines", F.explode(F.slice("x", F.lit(1), probes)).alias("y")).select("c", "lines", "y.h", "y.n")
    return classes, probe, kept.select("h", "n", F.col("c").alias("other"), F.col("lines").alias("other_lines"))


def _shares(classes: DataFrame, probe: DataFrame, postings: DataFrame, least: float) -> DataFrame:
    """Pairs of classes (``c``, ``other``) that met on a line, with the exact share of the first one's lines in the second, where it is ``least`` or more."""
    met = probe.drop("n").join(postings.drop("n"), "h").where(f"c <> other and other_lines >= {least} * lines").select("c", "other").distinct()
    there = classes.select(F.col("c").alias("other"), F.col("hs").alias("other_hs"))
    both = met.join(classes, "c").join(there, "other").select("c", "other", "lines", F.size(F.array_intersect("hs", "other_hs")).alias("shared"))
    return both.where(f"shared >= {least} * lines").select("c", "other", (F.col("shared") / F.col("lines")).alias("share"))


def containment(chunks: DataFrame, least: float = 0.6, min_lines: int = 5) -> DataFrame:
    """Pairs of files of different projects with the share of the first one's distinct lines that stand in the second."""
    files = line_classes(chunks)
    pairs = _shares(*_index(files, least, min_lines), least)
    itself = files.where(F.size("hs") >= min_lines).select("c", F.col("c").alias("other"), F.lit(1.0).alias("share")).distinct()
    others = files.select(F.col("c").alias("other_c"), F.col("f").alias("other"), F.col("p").alias("other_p"))
    return pairs.unionByName(itself).withColumnRenamed("other", "other_c").join(files.select("c", "f", "p"), "c").join(others, "other_c").where("p <> other_p").select("f", "other", "other_p", "share")


def copied_files(chunks: DataFrame, vendored: DataFrame, least: float = 0.6, min_lines: int = 5, anchors: int = ANCHORS) -> DataFrame:
    """Files (``f``) of which another project has a copy that is ``vendored`` (by ``f``), or two other projects have one.

    Classes meet, never all pairs of files. Of a line in many classes, first only ``anchors`` of them are met, known copies first: a family of any
    number of edited copies is settled there. Only the classes that this leaves open meet the rest of their lines' postings, so the
    result is that of all pairs.
    """
    files = line_classes(chunks)
    known = vendored.select("f", F.lit(True).alias("known")).distinct()
    held = files.select("f", "p", "c").join(known, "f", "left").groupBy(F.col("c").alias("other"), "p").agg(F.max("known").alias("known")).checkpoint()
    classes, probe, postings = _index(files, least, min_lines)
    probe = probe.checkpoint()
    told = held.groupBy("other").agg(F.max("known").alias("known"))
    popular = postings.where(F.col("n") > anchors).join(told, "other")
    rank = F.row_number().over(Window.partitionBy("h").orderBy(F.col("known").desc_nulls_last(), "other"))
    first = popular.withColumn("k", rank).where(F.col("k") <= anchors).select(postings.columns)  # a limit per line before the shuffle

    def seen(pairs: DataFrame) -> DataFrame:
        """By class: projects that have a copy, the class's own ones among them, and the first and last that have a known one."""
        every = pairs.select("c", "other").unionByName(probed.select("c", F.col("c").alias("other")))
        return every.join(held, "other").groupBy("c").agg(
            F.countDistinct("p").alias("projects"), F.min(F.when(F.col("known"), F.col("p"))).alias("a"), F.max(F.when(F.col("known"), F.col("p"))).alias("b")
        )

    probed = classes.where(F.col("lines") >= min_lines).select("c")
    near = _shares(classes, probe, postings.where(F.col("n") <= anchors).unionByName(first), least).checkpoint()
    settled = seen(near).where("projects >= 3 or a <> b").checkpoint()
    is_open = settled.select("c")
    far = _shares(classes, probe.where(F.col("n") > anchors).join(is_open, "c", "left_anti"), postings.where(F.col("n") > anchors), least)
    probed = probed.join(is_open, "c", "left_anti")
    rest = seen(near.select("c", "other").join(is_open, "c", "left_anti").unionByName(far.select("c", "other")))
    by_class = settled.unionByName(rest)
    return files.select("f", "p", "c").join(by_class, "c").where("projects >= 3 or a <> p or b <> p").select("f")


def not_handwritten(chunks: DataFrame, data_share: float = 0.6, minified_share: float = 0.6, data_chars: int = 200) -> DataFrame:
    """``project``, ``file_path`` as stored, ``reason`` and ``evidence`` of every file that is generated, minified, vendored or data.

    Evidence is an array of containment, mark, path and composition, in this order, whichever hold.
    """
    path = F.col("file_path")
    config, vendor_path, made_path, small_path = (path.rlike(x) for x in (CONFIG_PATH, VENDOR_PATH, GENERATED_PATH, MINIFIED_PATH))
    small = (F.col("minified") >= minified_share * F.col("chars")) & (F.col("minified") > 0)
    data = (F.col("data") >= data_share * F.col("chars")) & (F.col("data") >= data_chars)
    checkpoints(chunks.sparkSession)
    files = file_features(chunks).where(~config).checkpoint().withColumn("f", F.xxhash64("project", "file_path")).withColumn("known", F.col("vendored") | vendor_path)
    copied = copied_files(chunks, files.where("known").select("f")).select("f", F.lit(True).alias("copy"))
    copy = F.coalesce("copy", F.lit(False))
    reason = F.when(copy | F.col("known"), "vendored").when(F.col("generated") | made_path, "generated").when(small_path | small, "minified").when(data, "data")
    evidence = F.array_compact(
        F.array(F.when(copy, "containment"), F.when(F.col("vendored") | F.col("generated"), "mark"), F.when(vendor_path | made_path | small_path, "path"), F.when(small | data, "composition"))
    )
    return files.join(copied, "f", "left").select("project", "file_path", reason.alias("reason"), evidence.alias("evidence")).where("reason is not null")


def evidence_report(files: DataFrame) -> DataFrame:
    """Per project and reason: files, and how many of them each source of evidence holds for and is the only one for."""
    kinds = ("containment", "mark", "path", "composition")
    by = [F.count_if(F.array_contains("evidence", k)).alias(f"by_{k}") for k in kinds] + [F.count_if(F.col("evidence") == F.array(F.lit(k))).alias(f"only_{k}") for k in kinds]
    return files.groupBy("project", "reason").agg(F.count("*").alias("count"), *by)
