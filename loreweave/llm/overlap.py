"""Problem 2: evaluation queries that also stand, exactly or nearly, in the training split.

An exact prefix-filter bipartite join. First the distinct words of the table meet once, over
shingles (a word with its deletions of one letter, or of two from seven letters on): which words
are slips of each other is a property of the vocabulary, not of records. Words are then ordered
by rarity, a word's count with those of its slips. Every required word of a record must be
matched, so a held-out record is looked up under its rarest required word and the slips of that
word, inside its group (project and set of judged files). A training record posts its words by
position: those that have slips, and of the others only its first, since all before it must be
matched by slips. Candidates pass a length filter on required words and are verified word by word.

Records that are equal after canonical spelling form one class; classes are joined, then
expanded to the record pairs the result asks for. Records with a null or wordless query, a
null id or an unknown split are in no pair; repeated rows (same id) count once, the latest
``added_at`` first; a null project is a project of its own.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from ..session import sized_broadcast
from .common import checkpoints, latest
from .tokens import tokenizer_path

# Polite and filling words that may stand around a question.
FILLERS = frozenset(
    "please pls kindly hi hello hey thanks thank you quick one question exactly in this repo repository codebase project here can could would tell "
    "me just actually by the way a an i wonder wondering per favore ciao grazie salve scusa bitte hallo danke por favor hola gracias s il vous plait bonjour merci again now so ok okay "
    "domanda veloce curious know need want to let us".split()
)
# Letters from which on a word is posted in segments instead of with its deletions.
LONG = 20
# How far the counts of two words may be apart: of words of the public vocabulary, and where one is not in it; a word
# that is not in it must stand in one of so many questions to be a word at all.
KNOWN_RATIO, STRANGE_RATIO, STRANGE_SHARE = 50, 12, 1000
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
WORD = re.compile(r"[^\W_]+")


def singular(word: str) -> str:
    """A word without its plural ending; y and ie are one letter here, so that a slip inside -ies stays a slip."""
    if len(word) <= 3 or word.isdigit():
        return word
    stem = word.rstrip("s") if word.endswith("s") else word
    if len(stem) < 2:
        return word
    if stem != word and re.search(r"(?:x|ch|sh|z)e$", stem):
        stem = stem[:-1]
    return stem[:-1] + "ie" if stem.endswith("y") and len(stem) > 3 else stem


def canonical(query: str | None) -> list[str]:
    """Words of a query without case, marks, letter forms, accents, naming style, plural and order."""
    text = unicodedata.normalize("NFKC", query or "")
    if not text.isupper():
        text = CAMEL.sub(" ", text)
    text = unicodedata.normalize("NFKD", text.casefold())
    text = "".join(c for c in text if not unicodedata.combining(c))
    return sorted(singular(w) for w in WORD.findall(text))


def edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or ``most`` + 1 beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


@cache
def vocabulary() -> frozenset[str]:
    """Whole lower-case words of the public byte-level vocabulary, in canonical form: words known whatever the table holds."""
    tokens = (base64.b64decode(line.split()[0]) for line in open(tokenizer_path(), "rb") if line.strip())
    return frozenset(singular(t[1:].decode()) for t in tokens if re.fullmatch(rb" [a-z]{3,}", t))


def two_words(a: str, b: str, known: dict[str, int]) -> bool:
    """Whether two near words are different words and not one with a slip, by measures that don't grow with the table.

    An ending -er (flush, flusher) makes another word, no slip does. Other pairs go by relative frequency: words of the
    public vocabulary are different unless one is so rare beside the other that it must be a slip; a word that is not in
    it needs a second record and a higher share. ``known`` has passed ``_told``.
    """
    short, long = sorted((a, b), key=len)
    if long == short + "er":
        return True
    x, y = sorted((known.get(a, 0), known.get(b, 0)))
    if a in vocabulary() and b in vocabulary():
        return 0 < x and y < KNOWN_RATIO * x
    return 1 < x and y < STRANGE_RATIO * x


def _told(counts: dict[str, int], total: int) -> dict[str, int]:
    """The counts that tell something: of vocabulary words, and of other words that a fixed share of all questions has."""
    return {w: n for w, n in counts.items() if n * STRANGE_SHARE >= total or w in vocabulary()}


def _slip(a: str, b: str, known: dict[str, int]) -> bool:
    """Whether two different words are one word and a slip of it."""
    if min(len(a), len(b)) < 3 or a.isdigit() != b.isdigit() or a.isdigit():
        return False
    allowed = 2 if max(len(a), len(b)) >= 7 else 1
    return edits(a, b, allowed) <= allowed and not two_words(a, b, known)


def same_question(a: list[str], b: list[str], known: dict[str, int], near: dict[str, set[str]] | None = None) -> bool:
    """Whether two canonical word lists are the same words but for slips and filling words.

    Slips of the words of ``b`` are those that ``near`` lists, where it is given, else they follow from the counts in ``known``.
    """
    slip = (lambda w, v: w in near.get(v, ())) if near is not None else (lambda w, v: _slip(w, v, known))
    left, right = list(a), list(b)
    for w in a:
        if w in right:
            left.remove(w)
            right.remove(w)
    for w in list(left):
        match = min((v for v in right if slip(w, v)), key=lambda v: edits(w, v, 2), default=None)
        if match is not None:
            left.remove(w)
            right.remove(match)
    rest = left + right
    content = [w for w in a if w not in FILLER_STEMS]
    if all(spare(w) for w in rest):
        return bool(content) or not rest
    # one name in one word on one side, in several on the other
    one, other = "".join(a).replace("ie", "y"), "".join(b).replace("ie", "y")
    return max(len(a), len(b)) <= 6 and sorted(one) == sorted(other)


FILLER_STEMS = frozenset(singular(w) for w in FILLERS)


@lru_cache(100_000)
def spare(word: str) -> bool:
    """Whether a word may stand on one side alone: a filling word or a slip of one."""
    return word in FILLER_STEMS or len(word) > 4 and any(edits(word, f, 1) <= 1 for f in FILLER_STEMS if len(f) > 4)


def _split(column: Column) -> Column:
    s = F.lower(F.regexp_replace(column, r"[\s\p{Z}_-]+", ""))
    return F.when(s.rlike("^train"), "training").when(s.rlike("^(dev|valid|val$)"), "development").when(s.rlike("^(eval|test)"), "evaluation")


def records(dataset: DataFrame) -> DataFrame:
    """Distinct records with plain split, source, group (project and judged files) and canonical words, written once for all readers."""
    path = lambda r: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(r["path"], r"\\", "/")), "/(\\./)*/*", "/"), r"^(\./)+", "")
    files = F.array_sort(F.array_distinct(F.filter(F.transform("relevant", path), lambda p: p.isNotNull() & (p != ""))))

    @F.pandas_udf("array<string>")
    def words(queries: pd.Series) -> pd.Series:
        return queries.map(canonical)

    # repeated rows meet with what is needed of them only
    slim = dataset.where("id is not null").select(
        "id", _split(F.col("split")).alias("side"), F.lower(F.trim("source")).alias("source"),
        F.unhex(F.md5(F.concat_ws("\u0000", F.coalesce("project", F.lit("\u0001")), F.array_join(F.coalesce(files, F.array()), "\u0000")))).alias("g"),
        words("query").alias("words"),
        F.struct(F.coalesce(-F.unix_micros(F.col("added_at").cast("timestamp")), F.lit(0)).alias("t"), F.xxhash64("query", "split").alias("h")).alias("order"),
    )
    once = latest(slim, ["id"], [F.col("order")]).where("side is not null and size(words) > 0")
    checkpoints(dataset.sparkSession)
    return once.select("id", "side", "source", "g", "words", F.xxhash64("g", F.array_join("words", " ")).alias("cid")).checkpoint()


def _hash(key: str) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@lru_cache(100_000)
def shingles(word: str, probe: bool) -> list[int]:
    """Hashed keys of a word: of any two words that may be a slip of each other, one posts a key that the other probes.

    Words share a deletion of one letter, from seven letters on of two. Very long words, which would have too many, are
    posted in five segments, of which two slips leave one whole, and probe with the segments of all lengths in reach.
    """
    keys = {word}
    if word[:1] == "=":
        return [_hash(word)]
    if 3 <= len(word) <= LONG + 2:
        most = 2 if len(word) >= 7 else 1
        keys |= {"".join(c) for k in range(1, most + 1) for c in itertools.combinations(word, len(word) - k)}
    if len(word) > LONG:
        for n in range(len(word) - 2, len(word) + 3) if probe else (len(word),):
            for i in range(5):
                start, end = n * i // 5, n * (i + 1) // 5
                for d in range(-2, 3) if probe else (0,):
                    if start + d >= 0 and end + d <= len(word):
                        keys.add(f"{n}/{i}/{word[start + d : end + d]}")
    return [_hash(k) for k in keys]


FACTS = StructType([StructField("spare", BooleanType()), StructField("telling", BooleanType()), StructField("posts", ArrayType(LongType())), StructField("probes", ArrayType(LongType()))])


@F.pandas_udf(FACTS)
def _word_facts(words: pd.Series, counts: pd.Series, totals: pd.Series) -> pd.DataFrame:
    rows = [
        (spare(w), w in _told({w: n}, total), *((shingles(w, False), shingles(w, True)) if len(w) >= 3 and not w.isdigit() else ([], [])))
        for w, n, total in zip(words, counts, totals)
    ]
    return pd.DataFrame(rows, columns=["spare", "telling", "posts", "probes"])


@F.pandas_udf(BooleanType())
def _is_slip(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    return pd.Series([_slip(x, y, {x: m, y: n}) for x, y, m, n in zip(a, b, na, nb)], dtype=bool)


def vocabulary_facts(classes: DataFrame) -> DataFrame:
    """Every distinct ``word`` with whether it is ``spare``, its slips (``near``) and its rarity: ``cost``, its count and those of its slips."""
    total = classes.agg(F.count("*").alias("total"))  # one row
    counts = classes.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = counts.join(F.broadcast(total)).withColumn("f", _word_facts("word", "n", "total")).select("word", "n", "f.*").checkpoint()
    told = F.when(F.col("telling"), F.col("n")).otherwise(0)
    posts = words.select(F.col("word").alias("b"), told.alias("nb"), F.col("n").alias("mass"), F.explode("posts").alias("key"))
    probes = words.select(F.col("word").alias("a"), told.alias("na"), F.explode("probes").alias("key"))
    met = probes.join(posts, "key").where("a <> b").select("a", "b", "na", "nb", "mass").distinct()
    near = met.where(_is_slip("a", "b", "na", "nb")).groupBy(F.col("a").alias("word")).agg(F.collect_set("b").alias("near"), F.sum("mass").alias("others"))
    return words.join(near, "word", "left").select(
        "word", "spare", F.coalesce("near", F.array().cast("array<string>")).alias("near"), (F.col("n") + F.coalesce("others", F.lit(0))).alias("cost")
    )


def overlapping_classes(rows: DataFrame) -> DataFrame:
    """Pairs of classes (``train``, ``held``) that ask the same question, by the prefix-filter join."""
    classes = rows.groupBy("cid", "g").agg(
        F.first("words").alias("words"), F.bool_or(F.col("side") == "training").alias("in_train"), F.bool_or(F.col("side") != "training").alias("in_held")
    ).checkpoint()
    both = classes.groupBy("g").agg(F.bool_or("in_train").alias("t"), F.bool_or("in_held").alias("h")).where("t and h").select("g")
    met = classes.join(both, "g", "left_semi")
    facts = sized_broadcast(vocabulary_facts(classes).checkpoint())
    ordered = (
        met.select("cid", F.explode(F.array_distinct("words")).alias("word")).join(facts, "word")
        .groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("cost", "word", "spare", "near"))).alias("x"))
    )
    known = met.join(ordered, "cid").withColumn("need", F.filter("x", lambda w: ~w["spare"])).checkpoint()

    slipping = lambda w: F.size(w["near"]) > 0
    firm = F.filter("need", lambda w: ~slipping(w))
    # A name written as one word meets the same name in several: short queries are posted whole, too.
    joined = F.replace(F.array_join("words", ""), F.lit("ie"), F.lit("y"))
    letters = F.concat(F.lit("="), F.array_join(F.array_sort(F.split(joined, "")), ""))
    whole = F.when(F.size("words") <= 6, F.array(letters)).otherwise(F.array())
    none = F.when(F.size("need") == 0, F.array(F.lit("=="))).otherwise(F.array())
    names = lambda some: F.transform(some, lambda w: w["word"])
    posted = F.concat(names(F.filter("x", slipping)), names(F.slice(firm, 1, 1)), whole, none)
    # the rarest required word and its slips; a record of spare words alone is looked up under all of them
    least = F.when(F.size("need") > 0, F.slice("need", 1, 1)).otherwise(F.col("x"))
    probed = F.concat(names(least), F.flatten(F.transform(least, lambda w: w["near"])), whole, none)
    # A posting is two numbers: the hash of group and word, and the class. Equal groups are checked again with the words.
    train = known.where("in_train").select(F.col("cid").alias("train"), "g", F.explode(F.array_distinct(posted)).alias("word")).select("train", F.xxhash64("g", "word").alias("key"))
    held = known.where("in_held").select(F.col("cid").alias("held"), "g", F.explode(F.array_distinct(probed)).alias("word")).select("held", F.xxhash64("g", "word").alias("key"))
    found = held.join(train, "key").where("train <> held").select("train", "held").distinct()

    slips = F.filter("x", slipping)
    said = known.select("cid", "g", "words", F.size("need").alias("need"), F.map_from_arrays(names(slips), F.transform(slips, lambda w: w["near"])).alias("near"))
    a = said.select(F.col("cid").alias("train"), F.col("g").alias("ga"), F.col("words").alias("a"), F.col("need").alias("na"))
    b = said.select(F.col("cid").alias("held"), F.col("g").alias("gb"), F.col("words").alias("b"), F.col("need").alias("nb"), "near")
    # required words are matched one to one; a short query may also be the same name in other words
    fits = "ga = gb and (na <= size(b) and nb <= size(a) or greatest(size(a), size(b)) <= 6)"
    spell = found.join(a, "train").join(b, "held").where(fits).drop("ga", "gb", "na", "nb")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [same_question(list(x), list(y), {}, {w: set(v) for w, v in dict(near).items()}) for x, y, near in zip(pdf["a"], pdf["b"], pdf["near"])]
            yield pdf.loc[keep, ["train", "held"]]

    same = classes.where("in_train and in_held").select(F.col("cid").alias("train"), F.col("cid").alias("held"))
    return spell.mapInPandas(verify, "train bigint, held bigint").unionByName(same)


def overlapping_records(dataset: DataFrame) -> DataFrame:
    """Record pairs: ``id_a`` < ``id_b``, the training id, the held-out id, its split and source."""
    rows = records(dataset)
    pairs = overlapping_classes(rows)
    train = rows.where("side = 'training'").select(F.col("cid").alias("train"), F.col("id").alias("train_id"))
    held = rows.where("side <> 'training'").select(F.col("cid").alias("held"), F.col("id").alias("held_id"), F.col("side").alias("held_split"), F.col("source").alias("held_source"))
    both = pairs.join(train, "train").join(held, "held")
    return both.select(
        F.least("train_id", "held_id").alias("id_a"), F.greatest("train_id", "held_id").alias("id_b"), "train_id", "held_id", "held_split", "held_source"
    )


def overlap_report(dataset: DataFrame) -> DataFrame:
    """Held-out records per split and source: all of them and those that overlap the training split."""
    rows = records(dataset)
    hit = overlapping_classes(rows).select(F.col("held").alias("cid")).distinct().withColumn("hit", F.lit(1))
    return (
        rows.where("side <> 'training'").join(hit, "cid", "left").groupBy(F.col("side").alias("split"), "source")
        .agg(F.count("*").alias("records"), F.count("hit").alias("overlapping"))
    )


def exact_overlaps(dataset: DataFrame) -> DataFrame:
    """Those of the overlapping record pairs whose questions are the same but for case and white space."""
    said = latest(dataset.where("id is not null").select("id", "query", "added_at", "split"), ["id"], [F.coalesce(-F.unix_micros(F.col("added_at").cast("timestamp")), F.lit(0)), F.xxhash64("query", "split")])
    plain = said.select("id", F.lower(F.trim(F.regexp_replace("query", r"\s+", " "))).alias("q"))
    pairs = overlapping_records(dataset).select("id_a", "id_b")
    both = pairs.join(plain.select(F.col("id").alias("id_a"), F.col("q").alias("qa")), "id_a").join(plain.select(F.col("id").alias("id_b"), F.col("q").alias("qb")), "id_b")
    return both.where("qa = qb").select("id_a", "id_b")
