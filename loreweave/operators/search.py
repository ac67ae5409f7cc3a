"""Keyword, lexical and hybrid search."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.text import first_line_with, keyword_score, lower_score, plain_path, words
from ..session import spread, table

QUESTION = "which backlink graph reads the snapshot store after the nightly retention sweep"
KEYWORDS = ["which", "backlink", "graph", "reads", "the", "snapshot", "store", "after", "the", "nightly", "retention", "sweep"]


def keyword_topk(pages: DataFrame, text: str, keywords: list[str], keys: list[str], k: int = 10) -> DataFrame:
    """Top pages by the sum of word occurrences; ties go to the smaller key."""
    # the lower case of a text is a column of its own, and the cut comes before the filter: else either is computed again and again
    scored = pages.withColumn("_low", F.lower(text)).withColumn("score", lower_score(F.col("_low"), keywords)).drop("_low")
    return scored.orderBy(F.desc("score"), *keys).limit(k).where("score > 0")


def _distinct_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null")


def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    docs = _distinct_docs(spark, d).select("doc_id", "source", "text")
    return keyword_topk(docs, "text", KEYWORDS, ["doc_id"]).select("doc_id", "source", "score")


def _wiki(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "chunks").where("kind = 'wiki'").select("id", "project", plain_path(F.col("file_path")).alias("path"), F.lower(F.trim("lang")).alias("page_type"), "content")
        .dropDuplicates(["id"])
    )


def wiki_recall(spark: SparkSession, d: str) -> DataFrame:
    """Pages of three types by keyword score, with the first matching line as preview."""
    pages = _wiki(spark, d).where("page_type in ('concept', 'entity', 'decision')")
    found = keyword_topk(pages, "content", ["snapshot", "store", "lease"], ["id"], 20)
    return found.select("id", "path", "page_type", "score", first_line_with(F.col("content"), ["snapshot", "store", "lease"]).alias("preview"))


def word_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and documents of every search word that stands in more than one document."""
    split = _distinct_docs(spark, d).select("doc_id", F.explode_outer(words(F.col("text"))).alias("word")).where("word is not null")
    per = split.groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents")).where("documents > 1")


def matching_lines(chunks: DataFrame, pattern: str, per_file: int = 20) -> DataFrame:
    """Lines that match a smart-case pattern, at most ``per_file`` a file, with one line of context on both sides."""
    rx = pattern if any(c.isupper() for c in pattern) else f"(?i){pattern}"
    split = F.split("content", r"\r?\n")
    hits = F.filter(F.transform(split, lambda s, i: F.when(s.rlike(rx), i)), lambda i: i.isNotNull())
    at = chunks.where(F.col("content").rlike(rx)).select("id", "project", "path", "line_start", split.alias("ls"), F.explode(hits).alias("i"))
    line = lambda i: F.coalesce(F.try_element_at("ls", i), F.lit(""))
    rows = at.select(
        "id", "project", "path", (F.greatest(F.col("line_start"), F.lit(1)) + F.col("i")).cast("bigint").alias("line_no"), F.substring(line(F.col("i") + 1), 1, 200).alias("line"),
        F.substring(F.when(F.col("i") > 0, line(F.greatest(F.col("i"), F.lit(1)))).otherwise(""), 1, 200).alias("before"), F.substring(line(F.col("i") + 2), 1, 200).alias("after"),
    )
    rank = F.row_number().over(Window.partitionBy("project", "path").orderBy("line_no", "id"))
    return rows.withColumn("match_no", rank.cast("bigint")).where(f"match_no <= {per_file}")


def _code(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "chunks").where("kind = 'code'")
        .select("id", "project", plain_path(F.col("file_path")).alias("path"), "line_start", "content", "last_modified").dropDuplicates(["id"])
    )


def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return matching_lines(_code(spark, d), r"lease\w* \|\| |retry\(|\bnormalize_\w+lease", 20).select("project", "path", "id", "line_no", "line", "before", "after", "match_no")


def smart_rank(spark: SparkSession, d: str) -> DataFrame:
    """Files by matches, name, definition and recency: matches + 2 for the name, 3 for a definition, 1.5 / (1 + days / 30)."""
    code = _code(spark, d)
    word = "payout"
    n = keyword_score(F.col("content"), [word])
    defined = F.col("content").rlike(rf"(?im)^\s*(def|class|function|func|fn)\s+\w*{word}")
    day = F.to_date(F.max("last_modified"))
    age = F.datediff(F.lit("2026-11-01").cast("date"), day)
    files = code.groupBy("project", "path").agg(F.sum(n).alias("matches"), F.max(defined.cast("int")).alias("defines"), age.alias("days")).where("matches > 0")
    named = F.lower(F.regexp_extract("path", "([^/]*)$", 1)).contains(word)
    recency = F.lit(1.5) / (1 + F.greatest(F.col("days"), F.lit(0)) / 30)
    score = F.col("matches") + F.when(named, 2).otherwise(0) + F.col("defines") * 3 + F.coalesce(recency, F.lit(0.0))
    return files.select("project", "path", "matches", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "project", "path").limit(50)


BUCKETS = 64


def mock_buckets(text: Column) -> Column:
    """The offline embedding before its norm: +1 or -1 per word in one of 64 buckets, by the word's MD5."""
    tails = F.transform(F.split(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), r"\s+"), lambda w: F.conv(F.substring(F.md5(w), 29, 4), 16, 10).cast("int"))
    return F.transform(tails, lambda h: F.struct(F.pmod(h, F.lit(BUCKETS)).alias("b"), F.when(F.pmod(F.shiftright(h, 8), F.lit(2)) == 1, 1).otherwise(-1).alias("s")))


def mock_vectors(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Sparse mock vectors: key, bucket, integer value (zero buckets left out), and the squared norm."""
    parts = docs.where(F.trim(F.regexp_replace(text, r"\s+", " ")) != "").select(key, F.explode_outer(mock_buckets(F.col(text))).alias("p"))
    values = parts.groupBy(key, F.col("p.b").alias("bucket")).agg(F.sum("p.s").alias("value")).where("value <> 0")
    return values


def mock_embed(spark: SparkSession, d: str) -> DataFrame:
    return mock_vectors(_distinct_docs(spark, d), "doc_id", "text").select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.col("value").cast("bigint").alias("value"))


SPACES = re.compile(r"[ \t\n\f\r\v]+")


@lru_cache(200_000)
def _bucket(word: str) -> tuple[int, int]:
    h = hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()
    return h[15] % BUCKETS, 1 if h[14] % 2 == 1 else -1


@F.pandas_udf(ArrayType(FloatType()))
def dense_vector(texts: pd.Series) -> pd.Series:
    """The offline embedding of texts, not normed; null where there is no word or all signs cancel."""

    def one(text: str | None) -> np.ndarray | None:
        out = np.zeros(BUCKETS, dtype=np.float32)
        for word in SPACES.split((text or "").lower()):
            if word:
                b, s = _bucket(word)
                out[b] += s
        return out if out.any() else None

    return texts.map(one)


def nearest_to_question(vectors: DataFrame, key: str, k: int, least: float, question: str = QUESTION) -> DataFrame:
    """Rows by cosine to one question: dot and norm inside the row, no shuffle but the top k."""
    q = vectors.sparkSession.range(1).select(dense_vector(F.lit(question)).alias("q"))  # one row
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    scored = vectors.join(F.broadcast(q)).withColumn("score", F.round(dot("vec", "q") / F.sqrt(dot("vec", "vec") * dot("q", "q")), 6)).drop("q")
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), key).limit(k)


def mock_search(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    """Documents by cosine of the mock vectors to the question; the ``k`` best."""
    v = spread(_distinct_docs(spark, d).select("doc_id", "text"), "doc_id").select("doc_id", dense_vector("text").alias("vec")).where("vec is not null")
    return nearest_to_question(v, "doc_id", k, -1.0).select("doc_id", "score")


def rrf(a: DataFrame, b: DataFrame, key: str, k: int = 60, wa: float = 1.0, wb: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (``rank`` from 1): full outer join, weights over k + rank."""
    both = a.select(key, F.col("rank").alias("ra")).join(b.select(key, F.col("rank").alias("rb")), key, "full_outer")
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(k) + F.col(r)), F.lit(0.0))
    return both.withColumn("rrf", F.round(part(wa, "ra") + part(wb, "rb"), 9))


def ranked(top: DataFrame, *order: Column | str) -> DataFrame:
    """Rank a list that is already cut to a top k."""
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Keyword and mock-vector channels, 30 and 20 of them, fused; which channel found a page stands beside it. ``hybrid_records`` takes a pool by the limit."""
    docs = _distinct_docs(spark, d).select("doc_id", "text")
    words_ = ranked(keyword_topk(docs, "text", KEYWORDS, ["doc_id"], 30).select("doc_id", "score"), F.desc("score"), "doc_id")
    vectors = ranked(mock_search(spark, d), F.desc("score"), "doc_id")
    fused = rrf(words_, vectors, "doc_id")
    channel = F.when(F.col("rb").isNull(), "keyword").when(F.col("ra").isNull(), "vector").otherwise("both")
    return fused.select("doc_id", "rrf", channel.alias("channels")).orderBy(F.desc("rrf"), "doc_id").limit(10)


def preview_budget(spark: SparkSession, d: str, budget: int = 6000) -> DataFrame:
    """Previews of the best pages, cut to a budget of characters that is used up in rank order."""
    docs = _distinct_docs(spark, d).select("doc_id", "text")
    top = ranked(keyword_topk(docs, "text", KEYWORDS, ["doc_id"], 30), F.desc("score"), "doc_id")
    size = F.least(F.length("text"), F.lit(900))
    used = F.sum(size).over(Window.partitionBy(F.lit(1)).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    left = F.greatest(F.lit(budget) - F.coalesce(used, F.lit(0)), F.lit(0))
    return top.select("doc_id", F.col("rank").cast("bigint").alias("rank"), F.least(size, left).cast("bigint").alias("shown_chars"), F.md5(F.substring("text", F.lit(1), F.least(size, left).cast("int"))).alias("preview_md5"))


QUERIES = {
    "keyword_search": keyword_search, "wiki_recall": wiki_recall, "word_frequencies": word_frequencies, "lexical_search": lexical_search, "smart_rank": smart_rank,
    "mock_embed": mock_embed, "mock_search": mock_search, "hybrid_search": hybrid_search, "preview_budget": preview_budget,
}

_KW = " + ".join(f"(length(t) - length(replace(t, '{k}', ''))) // {len(k)}" for k in KEYWORDS)
_PATH = r"regexp_replace(regexp_replace(replace(file_path, '\', '/'), '/(\./|/)+', '/', 'g'), '^(\./)+', '')"
_CODE = f"(select distinct on (id) id, project, {_PATH} as path, line_start, content, last_modified from chunks where kind = 'code')"
_WIKI = f"(select distinct on (id) id, project, {_PATH} as path, lower(trim(lang)) as page_type, content from chunks where kind = 'wiki')"
_TOP = f"select doc_id, source, text, ({_KW})::bigint as score from (select doc_id, source, text, lower(text) as t from documents where text is not null)"
_VEC = r"""select doc_id, b as bucket, sum(s)::bigint as value from (
  select doc_id, ('0x' || substr(md5(w), 31, 2))::int % 64 as b, case when ('0x' || substr(md5(w), 29, 2))::int % 2 = 1 then 1 else -1 end as s
  from (select doc_id, unnest(regexp_split_to_array(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+')) as w from TEXTS))
  group by all having sum(s) <> 0"""
_DOCV = _VEC.replace("TEXTS", r"(select doc_id, text from documents where text is not null and trim(regexp_replace(text, '\s+', ' ', 'g')) <> '')")
_QV = _VEC.replace("TEXTS", f"(select 0 as doc_id, '{QUESTION}' as text)")
_MOCK = f"""with v as ({_DOCV}), q as (select bucket, value as q from ({_QV})),
  s as (select doc_id, sum(value * coalesce(q, 0)) as dot, sum(value * value) as n2 from v left join q using (bucket) group by doc_id)
  select doc_id, round(dot / sqrt(n2::double * (select sum(q * q) from q)::double), 6) as score from s order by score desc, doc_id limit 20"""

SQL = {
    "keyword_search": f"select doc_id, source, score from ({_TOP}) where score > 0 order by score desc, doc_id limit 10",
    "wiki_recall": f"""select id, path, page_type, score, substr(trim(list_filter(regexp_split_to_array(content, '\\r?\\n'), lambda s: regexp_matches(lower(s), 'snapshot|store|lease'))[1]), 1, 160) as preview
      from (select *, ((length(t) - length(replace(t, 'snapshot', ''))) // 8 + (length(t) - length(replace(t, 'store', ''))) // 5 + (length(t) - length(replace(t, 'lease', ''))) // 5)::bigint as score
      from (select *, lower(content) as t from {_WIKI} where page_type in ('concept', 'entity', 'decision'))) where score > 0 order by score desc, id limit 20""",
    "word_frequencies": r"""select word, sum(n)::bigint as occurrences, count(*)::bigint as documents from (
      select word, doc_id, count(*) as n from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{3,}')) as word from documents where text is not null) group by all)
      group by word having count(*) > 1""",
    "lexical_search": f"""select project, path, id, line_no, line, before, after, match_no from (
      select project, path, id, greatest(line_start, 1)::bigint + i - 1 as line_no, substr(ls[i], 1, 200) as line, substr(coalesce(case when i > 1 then ls[i - 1] end, ''), 1, 200) as before, substr(coalesce(ls[i + 1], ''), 1, 200) as after,
        row_number() over (partition by project, path order by greatest(line_start, 1)::bigint + i - 1, id)::bigint as match_no
      from (select *, unnest(range(1, len(ls) + 1)) as i from (select *, regexp_split_to_array(content, '\\r?\\n') as ls from {_CODE}))
      where regexp_matches(ls[i], '(?i)lease\\w* \\|\\| |retry\\(|\\bnormalize_\\w+lease')) where match_no <= 20""",
    "smart_rank": f"""select project, path, matches, round(matches + case when contains(lower(regexp_extract(path, '([^/]*)$', 1)), 'payout') then 2 else 0 end + defines * 3
        + coalesce(1.5::double / (1 + greatest(date '2026-11-01' - day, 0)::double / 30), 0), 6) as score
      from (select project, path, sum((length(lower(content)) - length(replace(lower(content), 'payout', ''))) // 6)::bigint as matches,
        max(regexp_matches(content, '(?im)^\\s*(def|class|function|func|fn)\\s+\\w*payout')::int) as defines, max(last_modified)::date as day from {_CODE} group by all)
      where matches > 0 order by score desc, project, path limit 50""",
    "mock_embed": f"select doc_id, bucket::bigint as bucket, value from ({_DOCV})",
    "mock_search": _MOCK,
    "hybrid_search": f"""with w as (select doc_id, row_number() over (order by score desc, doc_id) as ra from (select * from ({_TOP}) where score > 0 order by score desc, doc_id limit 30)),
      m as (select doc_id, row_number() over (order by score desc, doc_id) as rb from ({_MOCK}))
      select doc_id, round(coalesce(1.0::double / (60 + ra), 0) + coalesce(1.0::double / (60 + rb), 0), 9) as rrf, case when rb is null then 'keyword' when ra is null then 'vector' else 'both' end as channels
      from w full join m using (doc_id) order by rrf desc, doc_id limit 10""",
    "preview_budget": f"""select doc_id, rank, shown_chars, md5(substr(text, 1, shown_chars)) as preview_md5 from (select *, least(size, greatest(6000 - coalesce(sum(size) over (order by rank rows between unbounded preceding and 1 preceding), 0), 0))::bigint as shown_chars
      from (select *, row_number() over (order by score desc, doc_id)::bigint as rank, least(length(text), 900) as size from (select * from ({_TOP}) where score > 0 order by score desc, doc_id limit 30)))""",
}
