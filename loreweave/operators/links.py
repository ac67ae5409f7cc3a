"""Wikilinks: extraction with anchors and labels, resolution of targets, the page graph, audits and rewriting.

A link is ``[[target]]``, ``[[target#anchor]]``, ``[[target|label]]`` or both. Pages are frames with ``slug`` (folders joined by
colons) and ``body``; null bodies hold no links, a page without a slug is no node. The tables name files in plain text, so the queries
here read each mention as a link to the file's stem, and each page names itself and its tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import EDGE, page_slug, plain_path
from ..session import checkpoints, table
from .audit import pages
from .graph import connected_components

WIKILINK = r"\[\[([^\]|#]+)(?:#([^\]|]*))?(?:\|([^\]]*))?\]\]"
FILE_NAME = r"([A-Za-z0-9_-]+)\.(py|go|ts|js|rs|rb|java|sh|c|h|md|yaml)"
MENTION = EDGE + FILE_NAME + EDGE
# Pages that list others; their links are no reason to keep a page, and nothing needs to link to them.
SPECIAL = ("index", "log", "overview")


def wikilinks(page_rows: DataFrame) -> DataFrame:
    """Every link of every page: ``slug``, ``line_no``, ``line``, ``target``, ``anchor``, ``label`` (null where there is none)."""
    lines = page_rows.where("slug is not null").select("slug", F.posexplode(F.split("body", r"\r?\n")).alias("i", "line"))
    found = lines.where(F.col("line").contains("[[")).select("slug", (F.col("i") + 1).cast("bigint").alias("line_no"), "line", F.explode(F.regexp_extract_all("line", F.lit(WIKILINK), 0)).alias("raw"))
    part = lambda n: F.nullif(F.trim(F.regexp_extract("raw", WIKILINK, n)), F.lit(""))
    return found.select("slug", "line_no", "line", part(1).alias("target"), part(2).alias("anchor"), part(3).alias("label")).where("target is not null")


def resolve(links: DataFrame, slugs: DataFrame) -> DataFrame:
    """Links with ``node``, the slug that is the target, else the smallest one that ends with a colon and the target, else null; and ``how``."""
    slugs = slugs.select("slug").where("slug is not null").distinct()
    parts = F.split("slug", ":")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ":"))
    ends = slugs.where("slug like '%:%'").select("slug", F.explode(tails).alias("target")).groupBy("target").agg(F.min("slug").alias("_end"))
    exact = slugs.select(F.col("slug").alias("target"), F.col("slug").alias("_same"))
    how = F.when(F.col("_same").isNotNull(), "exact").when(F.col("_end").isNotNull(), "suffix").otherwise("broken")
    return links.join(exact, "target", "left").join(ends, "target", "left").withColumn("node", F.coalesce("_same", "_end")).withColumn("how", how).drop("_same", "_end")


def rewrite_links(page_rows: DataFrame, renames: DataFrame) -> DataFrame:
    """Pages whose links to ``old`` become links to ``new``, anchors and labels kept: the page's columns, ``replacements`` and the new ``body``.

    A page that several renames touch comes once for each.
    """
    quoted = F.regexp_replace("old", r"([\\.^$|?*+(){}\[\]])", r"\\$1")
    rx = F.concat(F.lit(r"\[\["), quoted, F.lit(r"((?:#[^\]|]+)?(?:\|[^\]]+)?)\]\]"))
    both = page_rows.withColumn("old", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(WIKILINK), 1)))).join(renames, "old")
    new = F.regexp_replace("body", rx, F.concat(F.lit("[["), F.col("new"), F.lit("$1]]")))
    return both.withColumn("replacements", F.regexp_count("body", rx).cast("bigint")).where("replacements > 0").withColumn("body", new)


def linked_pages(spark: SparkSession, d: str) -> DataFrame:
    """The wiki pages with their mentions of files written as links, and a last line that names the page itself and its tags."""
    p = pages(spark, d)
    tags = F.filter(F.transform(F.split(F.regexp_replace("tags", r"^\[|\]$", ""), ","), lambda t: F.trim(t)), lambda t: t != "")
    see = F.concat_ws(", ", F.concat(F.lit("[["), "stem", F.lit("]]")), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("[["), t, F.lit("]]"))), ", "))
    return p.select("id", "slug", "type", "folder", F.concat(F.regexp_replace("body", MENTION, "[[$1#$2|$1.$2]]"), F.lit("\n\nSee also "), see).alias("body"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """What links may resolve to: wiki pages and code files by their path-qualified slugs."""
    path = F.regexp_replace(plain_path(F.col("file_path")), r"\.[^./]*$", "")
    return table(spark, d, "chunks").select(page_slug(path).alias("slug")).distinct()


def _links(spark: SparkSession, d: str) -> DataFrame:
    return wikilinks(linked_pages(spark, d))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    checkpoints(spark)
    return resolve(_links(spark, d), nodes(spark, d)).drop("line").checkpoint()


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).groupBy("slug", "line_no", "target", "anchor", "label").agg(F.count("*").alias("n"))


def resolved_links(spark: SparkSession, d: str) -> DataFrame:
    """Targets with the node they resolve to, how, and how many links and pages name them."""
    return resolve(_links(spark, d).drop("line"), nodes(spark, d)).groupBy("target", "node", "how").agg(F.count("*").alias("links"), F.countDistinct("slug").alias("pages"))


def page_edges(spark: SparkSession, d: str) -> DataFrame:
    """Explicit edges: links that resolve, loops dropped, repeated ones counted."""
    return _resolved(spark, d).where("node is not null and node <> slug").groupBy(F.col("slug").alias("src"), F.col("node").alias("dst")).agg(F.count("*").alias("links"))


def page_backlinks(spark: SparkSession, d: str, most: int = 3) -> DataFrame:
    """Pages that link to a node, by node: occurrences and the first contexts, the node itself left out."""
    r = resolve(_links(spark, d), nodes(spark, d)).where("node is not null and node <> slug")
    context = F.concat(F.lit("L"), F.col("line_no").cast("string"), F.lit(": "), F.substring(F.trim("line"), 1, 160))
    k = F.row_number().over(Window.partitionBy("node", "slug").orderBy("line_no", "target", F.coalesce("anchor", F.lit("")), F.coalesce("label", F.lit(""))))
    rows = r.withColumn("k", k)
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", context.alias("c"))))), lambda x: x["c"]), " / ")
    return rows.groupBy("node", F.col("slug").alias("from_slug")).agg(F.count("*").alias("occurrences"), shown.alias("contexts"))


def page_broken(spark: SparkSession, d: str) -> DataFrame:
    """Targets without a node, from pages that are no lists."""
    r = _resolved(spark, d).where((F.col("how") == "broken") & ~F.col("slug").isin(*SPECIAL))
    return r.groupBy("slug", "target").agg(F.count("*").alias("links"), F.min("line_no").alias("first_line"))


def orphan_pages(page_rows: DataFrame, links: DataFrame) -> DataFrame:
    """Pages nothing links to by three rules: ``any`` (loops and lists count), ``stats`` (neither counts), ``checks`` (loops count, sessions are exempt)."""
    p = page_rows.where(~F.col("slug").isin(*SPECIAL)).select("slug", "type").distinct()
    inbound = links.where("node is not null").select("node", F.col("slug").alias("src")).distinct()
    plain = inbound.where((F.col("node") != F.col("src")) & ~F.col("src").isin(*SPECIAL))
    rule = lambda rows, into, name: rows.join(into.select(F.col("node").alias("slug")).distinct(), "slug", "left_anti").select("slug", F.lit(name).alias("rule"))
    sessions = F.coalesce(F.col("type") == "session", F.lit(False))
    return rule(p, inbound, "any").unionByName(rule(p, plain, "stats")).unionByName(rule(p.where(~sessions), inbound, "checks"))


def page_orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_pages(linked_pages(spark, d), _resolved(spark, d))


def page_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Distinct links out of and into each node, without loops and lists."""
    e = _resolved(spark, d).where((F.col("node") != F.col("slug")) & ~F.col("slug").isin(*SPECIAL)).select("slug", "node").distinct()
    ends = e.select(F.col("slug").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("node", F.lit(0), F.lit(1)))
    return ends.groupBy(F.col("n").alias("node")).agg(F.sum("o").alias("out_links"), F.sum("i").alias("in_links"), F.count("*").alias("total"))


def page_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Groups of pages and files that links join: size, and the member with the most edges."""
    e = _resolved(spark, d).where("node is not null and node <> slug").select(F.col("slug").alias("a"), F.col("node").alias("b")).distinct()
    both = e.select(F.col("a").alias("node")).union(e.select("b"))
    degree = both.groupBy("node").agg(F.count("*").alias("degree"))
    return connected_components(e).join(degree, "node").groupBy("component").agg(F.count("*").alias("members"), F.min_by("node", F.struct(-F.col("degree"), F.col("node"))).alias("label"), F.max("degree").alias("top_degree"))


def link_rename(spark: SparkSession, d: str) -> DataFrame:
    """Dry run of renaming the target that most links name: pages, replacements and the text each would have."""
    checkpoints(spark)
    p = linked_pages(spark, d).checkpoint()
    best = wikilinks(p).groupBy("target").agg(F.count("*").alias("n")).agg(F.min_by("target", F.struct(-F.col("n"), F.col("target"))).alias("old"))  # one row
    return rewrite_links(p, best.select("old", F.concat("old", F.lit("-v2")).alias("new"))).select("id", "slug", "old", "replacements", F.sha2("body", 256).alias("revision"))


def link_report(spark: SparkSession, d: str) -> DataFrame:
    """The graph in figures: nodes, links, edges, broken targets, orphans and groups."""
    r, p = _resolved(spark, d), linked_pages(spark, d)
    e = r.where("node is not null and node <> slug").select("slug", "node").distinct()
    one = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("measure"), "value")
    roots = connected_components(e.select(F.col("slug").alias("a"), F.col("node").alias("b"))).select("component").distinct()
    counts = [
        one(nodes(spark, d), "nodes"), one(r, "links"), one(e, "edges"), one(r.where("how = 'broken'").select("target").distinct(), "broken_targets"),
        one(orphan_pages(p, r).where("rule = 'stats'"), "orphans"), one(roots, "groups"),
    ]
    found = counts[0]
    for more in counts[1:]:
        found = found.unionByName(more)
    return found


def linked_column(text: Column) -> Column:
    """A text with links and code as plain Markdown: labels, else targets; code in backticks and emphasis without their marks."""
    shown = F.regexp_replace(F.regexp_replace(text, r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), r"\[\[([^\]|#]+)(?:#[^\]]*)?\]\]", "$1")
    plain = F.regexp_replace(F.regexp_replace(shown, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"\*\*([^*\n]+)\*\*", "$1")
    return F.regexp_replace(plain, r"`([^`\n]+)`", "$1")


def page_plain_text(spark: SparkSession, d: str) -> DataFrame:
    return linked_pages(spark, d).select("id", F.md5(linked_column(F.col("body"))).alias("text_md5"), F.length(linked_column(F.col("body"))).cast("bigint").alias("chars"))


QUERIES = {
    "page_links": page_links, "resolved_links": resolved_links, "page_edges": page_edges, "page_backlinks": page_backlinks, "page_broken": page_broken, "page_orphans": page_orphans, "page_degrees": page_degrees,
    "page_clusters": page_clusters, "link_rename": link_rename, "link_report": link_report, "page_plain_text": page_plain_text,
}

from .audit import _PAGES, _PATH  # noqa: E402

_LP = rf"""(select id, slug, type, folder, regexp_replace(body, '\b{FILE_NAME}\b', '[[\1#\2|\1.\2]]', 'g') || chr(10) || chr(10) || 'See also ' ||
  concat_ws(', ', '[[' || stem || ']]', array_to_string(list_transform(list_filter(list_transform(string_split(regexp_replace(tags, '^\[|\]$', '', 'g'), ','), lambda t: trim(t)), lambda t: t <> ''), lambda t: '[[' || t || ']]'), ', ')) as body from {_PAGES})"""
_WL = rf"""(select slug, line_no, line, nullif(trim(regexp_extract(raw, '{WIKILINK}', 1)), '') as target, nullif(trim(regexp_extract(raw, '{WIKILINK}', 2)), '') as anchor, nullif(trim(regexp_extract(raw, '{WIKILINK}', 3)), '') as label
  from (select slug, i::bigint as line_no, ls[i] as line, unnest(regexp_extract_all(ls[i], '{WIKILINK}', 0)) as raw from (select slug, ls, unnest(range(1, len(ls) + 1)) as i from (select slug, regexp_split_to_array(body, '\r?\n') as ls from {_LP}))))"""
_NODES = rf"(select distinct replace(regexp_replace(regexp_replace(regexp_replace({_PATH}, '\.[^./]*$', ''), '^wiki/', ''), '\.md$', ''), '/', ':') as slug from chunks)"
_ENDS = f"(select target, min(slug) as node from (select slug, array_to_string(p[i:], ':') as target from (select slug, p, unnest(range(2, len(p) + 1)) as i from (select slug, string_split(slug, ':') as p from {_NODES}))) group by target)"
_R = f"(select l.*, coalesce(n.slug, e.node) as node, case when n.slug is not null then 'exact' when e.node is not null then 'suffix' else 'broken' end as how from {_WL} l left join {_NODES} n on n.slug = l.target left join {_ENDS} e on e.target = l.target)"
_E = f"(select distinct slug as a, node as b from {_R} where node <> slug)"
_ORPHANS = f"""(with p as (select distinct slug, type from {_LP} where slug not in {SPECIAL}), i as (select distinct node, slug as src from {_R} where node is not null)
  select slug, 'any' as rule from p where slug not in (select node from i) union all select slug, 'stats' from p where slug not in (select node from i where node <> src and src not in {SPECIAL})
  union all select slug, 'checks' from p where coalesce(type, '') <> 'session' and slug not in (select node from i))"""
_GROUPS = f"(with recursive e as materialized (select a, b from {_E} union select b, a from {_E}), r(node, reach) as (select distinct a, a from e union select r.node, e.b from r join e on r.reach = e.a) select node, min(reach) as component from r group by node)"

SQL = {
    "page_links": f"select slug, line_no, target, anchor, label, count(*)::bigint as n from {_WL} group by all",
    "resolved_links": f"select target, node, how, count(*)::bigint as links, count(distinct slug)::bigint as pages from {_R} group by all",
    "page_edges": f"select slug as src, node as dst, count(*)::bigint as links from {_R} where node <> slug group by all",
    "page_backlinks": f"""select node, slug as from_slug, count(*)::bigint as occurrences, string_agg('L' || line_no || ': ' || substr(trim(line), 1, 160), ' / ' order by k) filter (k <= 3) as contexts
      from (select *, row_number() over (partition by node, slug order by line_no, target, coalesce(anchor, ''), coalesce(label, '')) as k from {_R} where node <> slug) group by all""",
    "page_broken": f"select slug, target, count(*)::bigint as links, min(line_no) as first_line from {_R} where how = 'broken' and slug not in {SPECIAL} group by all",
    "page_orphans": f"select * from {_ORPHANS}",
    "page_degrees": f"select node, sum(o)::bigint as out_links, sum(i)::bigint as in_links, count(*)::bigint as total from (select a as node, 1 as o, 0 as i from {_E} where a not in {SPECIAL} union all select b, 0, 1 from {_E} where a not in {SPECIAL}) group by node",
    "page_clusters": f"""select component, count(*)::bigint as members, first(node order by degree desc, node) as label, max(degree)::bigint as top_degree from {_GROUPS} join (select node, count(*) as degree from (select a as node from {_E} union all select b from {_E}) group by node) using (node) group by component""",
    "link_rename": rf"""with p as (select * from {_LP}), o as (select target as old from {_WL} group by target order by count(*) desc, target limit 1)
      select id, slug, old, len(regexp_extract_all(body, rx))::bigint as replacements, sha256(regexp_replace(body, rx, '[[' || old || '-v2\1]]', 'g')) as revision from (select *, '\[\[' || old || '((?:#[^\]|]+)?(?:\|[^\]]+)?)\]\]' as rx from p, o) where regexp_matches(body, rx)""",
    "link_report": f"""select 'nodes' as measure, count(*)::bigint as value from {_NODES} union all select 'links', count(*) from {_R} union all select 'edges', count(*) from {_E} union all select 'broken_targets', count(distinct target) from {_R} where how = 'broken'
      union all select 'orphans', count(*) from {_ORPHANS} where rule = 'stats' union all select 'groups', count(distinct component) from {_GROUPS}""",
    "page_plain_text": rf"""select id, md5(t) as text_md5, length(t)::bigint as chars from (select id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '\[\[[^\]|]*\|([^\]]*)\]\]', '\1', 'g'), '\[\[([^\]|#]+)(?:#[^\]]*)?\]\]', '\1', 'g'),
      '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\*\*([^*\n]+)\*\*', '\1', 'g'), '`([^`\n]+)`', '\1', 'g') as t from {_LP})""",
}
