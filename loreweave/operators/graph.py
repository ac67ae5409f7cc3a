"""Link graphs: degrees, connected components, clusters."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plain_path
from ..session import checkpoints, first_by, sized_broadcast, table
from .audit import mentions, pages


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (the smallest node of it), by alternating large and small stars.

    Each round is two joins by node; the number of rounds grows with the logarithm of the size, and the last one changes nothing.
    Lineage is cut by a checkpoint a round, which the shared checkpoint folder keeps if an executor is lost.
    """
    checkpoints(edges.sparkSession)
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes = pairs.select(F.col(a).alias("node")).union(pairs.select(F.col(b).alias("node"))).distinct()
    e = pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint()
    state = None
    while True:  # until a round changes nothing
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = small.checkpoint()
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def judged_files(spark: SparkSession, d: str) -> DataFrame:
    """Edges of queries to the files they are judged by, as text keys of one project."""
    q = first_by(table(spark, d, "dataset").select("id", "project", "relevant", "added_at"), ["id"], -F.coalesce(F.unix_micros(F.col("added_at").cast("timestamp")), F.lit(0)), F.xxhash64(F.to_json("relevant")))
    refs = q.select("id", "project", F.explode("relevant").alias("r"))
    return refs.select(F.concat(F.lit("q:"), "id").alias("a"), F.concat_ws(":", F.lit("f"), "project", plain_path(F.col("r.path"))).alias("b")).where("b is not null").distinct()


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """Groups of queries and files that hang together: size, and the member with the most edges (the smallest among equals)."""
    e = judged_files(spark, d)
    degree = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
    c = connected_components(e).join(degree, "node")
    return c.groupBy("component").agg(F.count("*").alias("members"), F.sum("degree").alias("degrees"), F.min_by("node", F.struct(-F.col("degree"), F.col("node"))).alias("label"), F.max("degree").alias("top_degree")).where("members > 2")


def degrees(spark: SparkSession, d: str) -> DataFrame:
    """Links out of pages and into files, counted once a page and file."""
    m = mentions(pages(spark, d)).select(F.concat(F.lit("p:"), F.col("id").cast("string")).alias("src"), F.concat(F.lit("f:"), "target").alias("dst")).distinct()
    ends = m.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(m.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("out_links"), F.sum("i").alias("in_links"), F.count("*").alias("total"))


def god_nodes(spark: SparkSession, d: str, top: int = 20) -> DataFrame:
    return degrees(spark, d).orderBy(F.desc("total"), "node").limit(top)


def isolated_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that name no file of any project."""
    files = table(spark, d, "chunks").where("kind = 'code'").select(F.regexp_extract(plain_path(F.col("file_path")), r"([^/]*)$", 1).alias("target")).distinct()
    p = pages(spark, d)
    return p.join(mentions(p).join(files, "target", "left_semi").select("id").distinct(), "id", "left_anti").select("id", "slug")


#: Words in a shingle, and slots of the table of how often shingles occur.
RUN, SLOTS = 5, 1 << 21


def word_hashes(text: Column) -> Column:
    """The hash of each word of a text, in order."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: F.xxhash64(w))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in steps whose arrays stay small beside the worker itself."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def _runs(w: pa.Array, size: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Of lists of word hashes: number of the list and 56-bit hash of each run of ``size`` words, in order."""
    of = np.repeat(np.arange(len(w)), np.asarray(pc.fill_null(pc.list_value_length(w), 0)))
    flat = pc.list_flatten(w).to_numpy(zero_copy_only=False).view(np.uint64)
    last = max(len(flat) - size + 1, 0)
    h = np.zeros(last, np.uint64)
    for i in range(size):
        h = (h + flat[i : i + last]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    inside = of[:last] == of[len(of) - last :]
    return of[:last][inside], (h[inside] >> np.uint64(8)).astype(np.int64)


def _distinct(of: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs once, in order."""
    order = np.lexsort((x, of))
    of, x = of[order], x[order]
    new = np.ones(len(x), bool)
    new[1:] = (of[1:] != of[:-1]) | (x[1:] != x[:-1])
    return of[new], x[new]


def run_classes(hashes: DataFrame) -> np.ndarray:
    """How often runs of words occur, by slots of their hash, as the binary order of the number: 2 MB, however large the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int32)
        for b in _slices(batches):
            slot, times = np.unique(_runs(b.column("w"))[1] & (SLOTS - 1), return_counts=True)
            n[slot] += times.astype(np.int32)
        parts = np.split(n, 16)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(16), pa.int32()), "n": pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, n in zip(b.column("part").to_pylist(), b.column("n")):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(n.as_py()), np.int32).astype(np.int64)
        for part, n in sums.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([np.ceil(np.log2(n + 1)).astype(np.uint8).tobytes()], pa.binary())})

    rows = hashes.mapInArrow(count, "part int, n binary").repartition(16, "part").mapInArrow(total, "part int, n binary").collect()  # 16 rows
    parts = {r.part: np.frombuffer(r.n, np.uint8) for r in rows}
    return np.concatenate([parts.get(i, np.zeros(SLOTS // 16, np.uint8)) for i in range(16)])


def first_runs(hashes: DataFrame, key: str, least: float) -> DataFrame:
    """``x``, ``key``, ``n``, ``i``: of each text's ``n`` distinct runs, rare ones first, those of which two similar texts share one, with their place."""
    classes = run_classes(hashes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            of, x = _runs(b.column("w"))
            of, x = _distinct(of, x | classes[x & (SLOTS - 1)].astype(np.int64) << 56)
            n = np.bincount(of, minlength=b.num_rows)
            i = np.arange(len(x)) - (np.cumsum(n) - n)[of]
            kept = i < (n - np.ceil(n * least - 1e-9) + 1)[of]
            yield pa.RecordBatch.from_pydict({"x": x[kept], key: b.column(key).take(pa.array(of[kept])), "n": n[of[kept]].astype(np.int32), "i": i[kept].astype(np.int32)})

    return hashes.mapInArrow(cut, f"x long, `{key}` {hashes.schema[key].dataType.simpleString()}, n int, i int")


def meeting_pairs(index: DataFrame, key: str, least: float, at_once: int = 1 << 18) -> DataFrame:
    """Pairs of keys that share a run and by their sizes and the run's places can be similar; the postings of one run are paired in bounded steps."""
    kind = index.schema[key].dataType.simpleString()

    def meet(t: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, code = np.unique(t[key].to_numpy(), return_inverse=True)
        x, n, i = (t[c].to_numpy().astype(np.int64) for c in ("x", "n", "i"))
        order = np.lexsort((n, x))
        x, n, i, code = x[order], n[order], i[order], code[order]
        run = np.cumsum(np.r_[0, x[1:] != x[:-1]]) << 32
        more = np.searchsorted(run + n, run + np.floor((n + 1e-9) / least).astype(np.int64), "right") - np.arange(len(n)) - 1
        upto = np.cumsum(more)
        start = 0
        while start < len(n):
            stop = max(int(np.searchsorted(upto, (upto[start - 1] if start else 0) + at_once, "right")), start + 1)
            k = more[start:stop]
            p = np.repeat(np.arange(start, stop), k)
            q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(k) - k, k)
            good = (np.minimum(n[p] - i[p], n[q] - i[q]) >= least / (1 + least) * (n[p] + n[q]) - 1e-9) & (code[p] != code[q])
            both = np.unique(np.minimum(code[p], code[q])[good] * len(keys) + np.maximum(code[p], code[q])[good])
            if len(both):
                yield pa.RecordBatch.from_pydict({"a": pa.array(keys[both // len(keys)]), "b": pa.array(keys[both % len(keys)])})
            start = stop

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").to_numpy()
            cut = int(np.searchsorted(x, x[-1]))  # the last run may go on
            if held and (cut or held[-1].column("x")[0].as_py() != x[0]):
                yield from meet(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            elif cut:
                yield from meet(pa.Table.from_batches([b.slice(0, cut)]))
            held.append(b.slice(cut))
        if held:
            yield from meet(pa.Table.from_batches(held))

    return index.repartition("x").sortWithinPartitions("x").mapInArrow(walk, f"a {kind}, b {kind}").distinct()


def shared_runs(rows: DataFrame) -> DataFrame:
    """The columns but the word hashes ``wa`` and ``wb``, the numbers of their distinct runs and of those in both."""
    rest = [c for c in rows.columns if c not in ("wa", "wb")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sides = [_distinct(*_runs(b.column(c))) for c in ("wa", "wb")]
            na, nb = (np.bincount(of, minlength=b.num_rows) for of, _ in sides)
            of, x = (np.concatenate(v) for v in zip(*sides))
            either = np.bincount(_distinct(of, x)[0], minlength=b.num_rows)
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in rest} | {"na": na, "nb": nb, "both": na + nb - either})

    return rows.mapInArrow(count, "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in rest) + "na long, nb long, both long")


def similar_texts(texts: DataFrame, key: str, text: str, least: float, keep: Sequence[str] = ()) -> DataFrame:
    """``a``, ``b``, ``similarity``: pairs of keys whose texts are similar, a text in one row; columns to ``keep`` of either side end in ``_a`` and ``_b``.

    The join is exact: with shingles in one order for all texts, two similar sets share one of their
    first (1 - least) n + 1 shingles, and sets of too different sizes can't meet. The order
    is by rarity, as far as counts by slot tell it, so few other sets meet. Only those first shingles are shuffled, and
    the texts of pairs that met; shingles are computed where they are needed, never written out. Joins with what grows
    with the table are merges: before it runs, a text is taken for 20 bytes, and all texts would be broadcast.
    """
    low = least - 5e-7  # what is rounded to ``least``
    index = first_runs(texts.select(key, word_hashes(F.col(text)).alias("w")), key, low)
    met = meeting_pairs(index, key, low).checkpoint()
    keys = met.select(F.col("a").alias(key)).union(met.select("b")).distinct()
    wanted = sized_broadcast(keys)
    if wanted is not keys:
        texts = texts.join(wanted, key, "left_semi")
    side = lambda k: texts.select(F.col(key).alias(k), F.col(text).alias(f"t{k}"), *[F.col(c).alias(f"{c}_{k}") for c in keep]).hint("merge")
    full = met.join(side("a"), "a").join(side("b"), "b")
    kept = [f"{c}_{k}" for k in "ab" for c in keep]
    shared = shared_runs(full.select("a", "b", *kept, word_hashes(F.col("ta")).alias("wa"), word_hashes(F.col("tb")).alias("wb")))
    similarity = F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6)
    return shared.select("a", "b", *kept, similarity.alias("similarity")).where(F.col("similarity") >= least).distinct()  # a row twice in the table is one


def first_copies(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``key``, ``text`` and ``h`` (its hash), each text by its smallest key only; all ``key`` and ``h``; those of texts with several keys, and their number ``copies``."""
    checkpoints(docs.sparkSession)
    docs = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text, F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("h"))
    hashes = docs.select(key, "h").distinct().checkpoint()
    classes = hashes.groupBy("h").agg(F.min(key).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    copied = hashes.join(classes.hint("merge"), "h").checkpoint()
    again = sized_broadcast(copied.where(F.col(key) > F.col("first")).select(key, "h"))
    return docs.join(again, [key, "h"], "left_anti"), hashes, copied


def near_duplicate_pages(docs: DataFrame, key: str, text: str, least: float = 0.8) -> DataFrame:
    """Pairs of different texts whose sets of five-word shingles have a Jaccard similarity of at least ``least``.

    Equal texts are one class and joined once, by their smallest key; ``duplicate_pages`` lists the pairs of all keys.
    """
    return similar_texts(first_copies(docs, key, text)[0].select(key, text), key, text, least)


def duplicate_pages(docs: DataFrame, key: str, text: str, least: float = 0.8, at_once: int = 128) -> DataFrame:
    """All pairs of keys with equal texts, however short (similarity 1), or with sets of five-word shingles of a Jaccard similarity of at least ``least``.

    Each text is compared once; its copies stand in blocks of about ``at_once`` keys, and two texts or a text and itself meet block by block,
    so what is shuffled is a small share of the pairs and the pairs of one text fill many tasks.
    """
    texts, hashes, copied = first_copies(docs, key, text)
    several = not hashes.groupBy(key).count().where("count > 1").isEmpty()  # keys with several texts: then a text goes by its hash
    texts = texts.select((F.xxhash64("h") if several else F.col(key)).alias("t"), F.col(key).alias("k"), F.col(text).alias("text"), "h")
    near = similar_texts(texts, "t", "text", least, keep=("k", "h"))
    if copied.isEmpty():
        pairs = near.select(F.col("k_a").alias("x"), F.col("k_b").alias("y"), "similarity")
    else:
        n = F.ceil(F.col("copies") / at_once)
        blocks = copied.select("h", F.col(key).alias("k"), n.alias("n"), F.pmod(F.xxhash64(key), n).alias("i")).groupBy("h", "n", "i").agg(F.collect_list("k").alias("keys")).checkpoint()
        left = blocks.select("h", "i", F.col("keys").alias("xs"), F.explode_outer(F.sequence("i", F.col("n") - 1)).alias("j"))
        own = left.join(blocks.select("h", F.col("i").alias("j"), F.col("keys").alias("ys")).hint("merge"), ["h", "j"])
        own = own.select("i", "j", "ys", F.explode_outer("xs").alias("x")).select("i", "j", "x", F.explode_outer("ys").alias("y")).where("i < j or x < y")
        keys = blocks.select("h", "keys")
        few = sized_broadcast(keys)
        members = lambda k: (few if few is not keys else keys.hint("merge")).select(F.col("h").alias(f"h_{k}"), F.col("keys").alias(f"keys_{k}"))
        all_of = lambda k: F.explode_outer(F.coalesce(f"keys_{k}", F.array(f"k_{k}")))
        near = near.join(members("a"), "h_a", "left").join(members("b"), "h_b", "left").select("similarity", "k_b", "keys_b", all_of("a").alias("x")).select("x", all_of("b").alias("y"), "similarity")
        pairs = near.union(own.select("x", "y", F.lit(1.0)))
    pairs = pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    return pairs.distinct() if several else pairs


def find_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_pages(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def edited_copies(spark: SparkSession, d: str) -> DataFrame:
    """Texts and copies of them without their first line (ids below zero): the pairs that stay similar."""
    docs = table(spark, d, "documents").where("text is not null and doc_id is not null").select("doc_id", "text")
    cut = docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.regexp_replace("text", r"\A[^\n]*\n", "").alias("text")).where("text <> ''")
    return near_duplicate_pages(docs.unionByName(cut), "doc_id", "text")


def duplicate_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the class of its exact copies and the size of that class."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    classes = docs.groupBy("h").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    return docs.join(classes, "h").select("doc_id", "class_id", "copies")


QUERIES = {
    "clusters": clusters, "degrees": degrees, "god_nodes": god_nodes, "isolated_pages": isolated_pages, "find_duplicates": find_duplicates, "edited_copies": edited_copies, "duplicate_classes": duplicate_classes,
}

from .audit import _FILES, _MENTIONS, _PAGES  # noqa: E402

_REL = r"regexp_replace(regexp_replace(replace(r.path, '\', '/'), '/(\./|/)+', '/', 'g'), '^(\./)+', '')"
_EDGES = f"""(select distinct 'q:' || id as a, 'f:' || project || ':' || {_REL} as b from (select id, project, unnest(relevant) as r from (select * from dataset qualify row_number() over (partition by id order by added_at desc nulls last) = 1)))"""
_DEG = f"""(select node, sum(o)::bigint as out_links, sum(i)::bigint as in_links, count(*)::bigint as total from (select 'p:' || id as node, 1 as o, 0 as i from (select distinct id, target from {_MENTIONS}) union all select 'f:' || target, 0, 1 from (select distinct id, target from {_MENTIONS})) group by node)"""
_SH = r"""(select doc_id, len(list_distinct(s)) as n, list_distinct(s) as s from (select doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) as s
  from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from (select min(doc_id) as doc_id, text from documents where text is not null group by text)) where len(w) >= 5))"""
_COPIES = "(select distinct doc_id, md5(text) as h from documents where text is not null and doc_id is not null)"

SQL = {
    "clusters": f"""with recursive e as (select a, b from {_EDGES} where b is not null union all select b, a from {_EDGES} where b is not null), r(node, reach) as (select distinct a, a from e union select r.node, e.b from r join e on r.reach = e.a),
      c as (select node, min(reach) as component from r group by node), dg as (select a as node, count(*) as degree from e group by a)
      select component, count(*)::bigint as members, sum(degree)::bigint as degrees, first(node order by degree desc, node) as label, max(degree)::bigint as top_degree from c join dg using (node) group by component having count(*) > 2""",
    "degrees": f"select * from {_DEG}",
    "god_nodes": f"select * from {_DEG} order by total desc, node limit 20",
    "isolated_pages": f"select id, slug from {_PAGES} where id not in (select id from {_MENTIONS} where target in (select target from {_FILES}))",
    "find_duplicates": f"""with f as (select doc_id as h, n, unnest(s) as x from {_SH.replace("min(doc_id) as doc_id", "md5(text) as doc_id")}), p as (select a.h as ha, b.h as hb, a.n as na, b.n as nb, count(*) as i from f a join f b on a.x = b.x and a.h < b.h group by all),
      q as (select ha, hb, round(i::double / (na + nb - i), 6) as similarity from p where i::double / (na + nb - i) >= 0.8 - 5e-7 union all select distinct h, h, 1.0::double from {_COPIES})
      select distinct least(x.doc_id, y.doc_id) as a, greatest(x.doc_id, y.doc_id) as b, similarity from q join {_COPIES} x on x.h = ha join {_COPIES} y on y.h = hb where x.doc_id <> y.doc_id""",
    "edited_copies": f"""with f as (select doc_id, n, unnest(s) as x from {_SH.replace("documents", "(select doc_id, text from documents union all select * from (select -doc_id - 1, regexp_replace(text, '" + chr(92) + "A[^" + chr(92) + "n]*" + chr(92) + "n', '') as text from documents) where text <> '')")}),
      p as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as i from f a join f b on a.x = b.x and a.doc_id < b.doc_id group by all) select a, b, round(i::double / (na + nb - i), 6) as similarity from p where i::double / (na + nb - i) >= 0.8 - 5e-7""",
    "duplicate_classes": "select doc_id, min(doc_id) over w as class_id, (count(*) over w)::bigint as copies from documents where text is not null window w as (partition by text)",
}
