"""Quality audits of wiki pages: header, sections, links to files, orphans, staleness, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import EDGE, body, front_matter, header_field, page_slug, plain_path, slugify, stem, token_estimate
from ..session import running_sum, sized_broadcast, table

TODAY = "2026-11-01"
FILE_MENTION = EDGE + r"([A-Za-z0-9_-]+\.(?:py|go|ts|js|rs|rb|java|sh|c|h|md|yaml))" + EDGE


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Wiki pages with their header fields; repeated rows count once."""
    path = plain_path(F.col("file_path"))
    raw = table(spark, d, "chunks").where("kind = 'wiki'").select("id", "project", path.alias("path"), "content").dropDuplicates(["id"])
    head = front_matter(F.col("content"))
    return raw.select(
        "id", "project", "path", stem(F.col("path")).alias("stem"), page_slug(F.col("path")).alias("slug"), F.regexp_extract("path", r"^wiki/([^/]+)/", 1).alias("folder"),
        header_field(head, "title").alias("title"), F.lower(header_field(head, "type")).alias("type"), header_field(head, "created").try_cast("date").alias("created"),
        header_field(head, "tags").alias("tags"), "content", body(F.col("content")).alias("body"),
    )


def page_headers(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array_join(F.transform(F.split(F.regexp_replace("tags", r"^\[|\]$", ""), ","), lambda t: F.trim(t)), "|")
    return pages(spark, d).select("id", "slug", "title", "type", "created", tags.alias("tag_list"), token_estimate(F.col("content")).alias("tokens"))


def sections(page_rows: DataFrame) -> DataFrame:
    """Sections under level-two headings in page order; what stands before the first has the name ''. Empty preambles are left out."""
    parts = F.split("body", r"(?m)^##[ \t]+")
    cut = page_rows.select("id", F.posexplode(parts).alias("pos", "part"))
    name = F.when(F.col("pos") == 0, F.lit("")).otherwise(F.trim(F.regexp_extract("part", r"^([^\r\n]*)", 1)))
    text = F.when(F.col("pos") == 0, F.col("part")).otherwise(F.regexp_replace("part", r"^[^\r\n]*\r?\n?", ""))
    return cut.select("id", F.col("pos").cast("bigint").alias("pos"), name.alias("section"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("text")).where("pos > 0 or text <> ''")


def page_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections(pages(spark, d)).select("id", "pos", "section", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("text_md5"))


def mentions(page_rows: DataFrame) -> DataFrame:
    """Links of a page: every file it names, by line."""
    lines = page_rows.select("id", "project", "slug", F.posexplode(F.split("body", r"\r?\n")).alias("i", "line"))
    return lines.select("id", "project", "slug", (F.col("i") + 1).cast("bigint").alias("line_no"), "line", F.explode(F.regexp_extract_all("line", F.lit(FILE_MENTION), 1)).alias("target"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("kind = 'code'").select("project", F.regexp_extract(plain_path(F.col("file_path")), r"([^/]*)$", 1).alias("target")).distinct()


def link_status(spark: SparkSession, d: str) -> DataFrame:
    """Links by target: in the page's project, in another one only, or broken."""
    found = mentions(pages(spark, d)).select("id", "project", "target").distinct()
    files = _files(spark, d)
    own = files.withColumn("own", F.lit(1))
    anywhere = files.select("target").distinct().withColumn("known", F.lit(1))
    status = F.when(F.col("own").isNotNull(), "own").when(F.col("known").isNotNull(), "other_project").otherwise("broken")
    return found.join(own, ["project", "target"], "left").join(anywhere, "target", "left").groupBy("target").agg(
        F.count("*").alias("pages"), F.sum((status == "own").cast("bigint")).alias("own"), F.sum((status == "other_project").cast("bigint")).alias("other"), F.sum((status == "broken").cast("bigint")).alias("broken")
    )


def broken_links(spark: SparkSession, d: str) -> DataFrame:
    return mentions(pages(spark, d)).join(_files(spark, d).select("target").distinct(), "target", "left_anti").groupBy("id", "target").agg(F.count("*").alias("occurrences"))


def backlinks(spark: SparkSession, d: str) -> DataFrame:
    """Per target: pages that name it, occurrences, and the first three contexts of its most faithful page."""
    m = mentions(pages(spark, d))
    context = F.concat(F.lit("L"), F.col("line_no").cast("string"), F.lit(": "), F.substring(F.trim("line"), 1, 160))
    rank = F.row_number().over(Window.partitionBy("target", "id").orderBy("line_no", "line"))
    kept = m.withColumn("k", rank).withColumn("context", F.when(F.col("k") <= 3, context))
    per = kept.groupBy("target", "id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "context")))), lambda c: c["context"]), " / ").alias("contexts"))
    best = per.groupBy("target").agg(F.count("*").alias("pages"), F.sum("n").alias("occurrences"), F.min_by(F.struct("id", "contexts"), F.struct(-F.col("n"), "id")).alias("b"))
    return best.select("target", "pages", "occurrences", F.col("b.id").alias("top_page"), F.col("b.contexts").alias("contexts"))


def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Code files of projects with pages that no page names, by three rules: any mention counts; only mentions from the same project; only from pages of knowledge types."""
    page_rows = pages(spark, d)
    m = mentions(page_rows).join(page_rows.select("id", "type"), "id")
    files = _files(spark, d).join(page_rows.select("project").distinct(), "project", "left_semi")
    rule = lambda links, keys, name: files.join(links, keys, "left_anti").groupBy("project").agg(F.count("*").alias("orphans")).withColumn("rule", F.lit(name))
    everywhere = rule(m.select("target").distinct(), ["target"], "any")
    own = rule(m.select("project", "target").distinct(), ["project", "target"], "own_project")
    knowledge = rule(m.where("type in ('concept', 'entity', 'decision')").select("target").distinct(), ["target"], "knowledge_pages")
    return everywhere.unionByName(own).unionByName(knowledge)


def wiki_stats(spark: SparkSession, d: str) -> DataFrame:
    """Pages, characters and tagged pages by project and type, with subtotals."""
    p = pages(spark, d).withColumn("type", F.coalesce("type", F.lit("-")))
    sums = p.rollup("project", "type").agg(F.count("*").alias("pages"), F.sum(F.length("content")).cast("bigint").alias("chars"), F.count("tags").alias("tagged"), F.grouping_id().cast("bigint").alias("level"))
    return sums.select(F.coalesce("project", F.lit("*")).alias("project"), F.when(F.col("level") > 0, "*").otherwise(F.col("type")).alias("type"), "pages", "chars", "tagged", "level")


def lint_issues(spark: SparkSession, d: str, stale_days: int = 120) -> DataFrame:
    """Issues of five checks with their severity."""
    p = pages(spark, d)
    h = p.select("id", "title", "type", "created", "tags", "folder", "path", "stem", "project")
    issue = lambda df, check, severity, detail: df.select("id", F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.alias("detail"))
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in ("title", "type", "created", "tags")])), ",")
    stale = h.where(F.col("created") < F.date_sub(F.lit(TODAY).cast("date"), stale_days))
    wrong = h.where(F.col("type").isNotNull() & ~F.col("folder").contains(F.substring(F.col("type"), F.lit(1), F.greatest(F.length("type") - 1, F.lit(1)))))
    twice = h.join(h.groupBy("project", "stem").agg(F.count("*").alias("n")).where("n > 1"), ["project", "stem"])
    broken = broken_links(h.sparkSession, d).groupBy("id").agg(F.count("*").alias("n"))
    return (
        issue(h.where(missing != ""), "front_matter", "error", missing)
        .unionByName(issue(stale, "stale", "warning", F.col("created").cast("string")))
        .unionByName(issue(wrong, "folder", "warning", F.col("folder")))
        .unionByName(issue(twice, "duplicate_stem", "error", F.col("stem")))
        .unionByName(issue(broken, "broken_links", "warning", F.col("n").cast("string")))
    )


def lint_summary(spark: SparkSession, d: str) -> DataFrame:
    return lint_issues(spark, d).groupBy("check", "severity").agg(F.count("*").alias("issues"), F.countDistinct("id").alias("pages"))


def wiki_tree(spark: SparkSession, d: str, most: int = 5) -> DataFrame:
    """Per folder: pages, the first slugs, and how many are left out."""
    p = pages(spark, d).select("folder", "slug", "id")
    rank = F.row_number().over(Window.partitionBy("folder").orderBy("slug", "id"))
    shown = p.withColumn("k", rank).where(f"k <= {most}").groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "slug"))), lambda s: s["slug"]), ", ").alias("first"))
    counts = p.groupBy("folder").agg(F.count("*").alias("pages"))
    return counts.join(sized_broadcast(shown), "folder").select("folder", "pages", "first", F.greatest(F.col("pages") - most, F.lit(0)).cast("bigint").alias("more"))


def rename_preview(spark: SparkSession, d: str, old: str = "crop_thread.yaml", new: str = "crop_thread_v2.yaml") -> DataFrame:
    """Dry run of renaming a link target: pages, replacements, and the revision of each rewritten page."""
    rx = EDGE + old.replace(".", r"\.") + EDGE
    p = pages(spark, d).where(F.col("content").contains(old))
    rewritten = F.regexp_replace("content", rx, new)
    return p.select("id", "slug", F.regexp_count("content", F.lit(rx)).cast("bigint").alias("replacements"), F.sha2(rewritten, 256).alias("revision")).where("replacements > 0")


def content_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Revision of the whole text, and of the content without the header lines that tools rewrite."""
    p = pages(spark, d)
    head = F.regexp_replace(front_matter(F.col("content")), r"(?m)^(verified|generated|updated):[^\n]*\n?", "")
    return p.select("id", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("revision"), F.sha2(F.concat(head, F.lit("\n---\n"), F.col("body")), 256).alias("content_revision"))


# Sections that pages of a type should have.
EXPECTED = {"concept": ["summary", "decision"], "entity": ["summary", "next steps"], "decision": ["decision", "why now?"], "source": ["summary"]}


def section_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Sections a page of its type should have and has not."""
    p = pages(spark, d)
    have = p.select("id", "type", F.transform(F.regexp_extract_all("body", F.lit(r"(?m)^#{1,6}[ \t]+([^\r\n]*?)[ \t]*$"), 1), lambda h: F.lower(F.trim(h))).alias("have"))
    want = F.create_map(*[x for k, v in EXPECTED.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])
    missing = F.array_except(F.try_element_at(want, F.col("type")), F.col("have"))
    return have.select("id", "type", F.explode(missing).alias("missing"))


def page_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Titles as slugs: plain, cut to 20 characters and stripped again, and whether the file has that name."""
    p = pages(spark, d)
    return p.select("id", slugify(F.col("title")).alias("slug"), slugify(F.col("title"), 20, "page").alias("short"), (slugify(F.col("title")) == F.col("stem")).alias("is_stem"))


def graph_elements(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of the link graph as one list for a viewer, with stable ids."""
    m = mentions(pages(spark, d)).groupBy("slug", "target").agg(F.count("*").alias("weight"))
    page = pages(spark, d).select(F.concat(F.lit("p:"), "slug").alias("id"), F.lit("page").alias("kind")).distinct()
    file = m.select(F.concat(F.lit("f:"), "target").alias("id"), F.lit("file").alias("kind")).distinct()
    nodes = page.unionByName(file).select("id", "kind", F.lit("").alias("source"), F.lit("").alias("target"), F.lit(0).cast("bigint").alias("weight"))
    source, target = F.concat(F.lit("p:"), "slug"), F.concat(F.lit("f:"), "target")
    edges = m.select(F.md5(F.concat_ws(">", source, target)).alias("id"), F.lit("mention").alias("kind"), source.alias("source"), target.alias("target"), "weight")
    return nodes.unionByName(edges)


def context_pages(spark: SparkSession, d: str, budget: int = 4000) -> DataFrame:
    """Pages that fit a project's budget of tokens, newest first; the first one that doesn't fit ends the list."""
    p = pages(spark, d).select("id", "project", token_estimate(F.col("content")).alias("tokens"), (-F.datediff(F.coalesce("created", F.lit("1970-01-01").cast("date")), F.lit("1970-01-01").cast("date"))).alias("age_order"))
    return running_sum(p, "project", ["age_order", "id"], "tokens", "used").where(f"used <= {budget}").select("id", "project", "tokens", F.col("used").cast("bigint").alias("used"))


def delete_preview(spark: SparkSession, d: str) -> DataFrame:
    """For the pages of every project the file whose removal would break most links, and how many pages name it."""
    m = mentions(pages(spark, d)).join(_files(spark, d).select("target").distinct(), "target", "left_semi").groupBy("project", "target").agg(F.countDistinct("id").alias("pages"), F.count("*").alias("links"))
    return m.groupBy("project").agg(F.min_by(F.struct("target", "pages", "links"), F.struct(-F.col("links"), F.col("target"))).alias("b")).select("project", "b.target", "b.pages", "b.links")


VERIFIED = "array<struct<by:string,at:string,content_revision:string,origin:string>>"


def content_revision(text: Column) -> Column:
    """Revision of a page without the header fields that tools and reviews write."""
    head = front_matter(text)
    bare = F.regexp_replace(head, r"(?m)^(verified|generated|updated):[^\n]*(\n[ \t]+[^\n]*)*\n?", "")
    whole = F.concat(F.regexp_replace(bare, r"\n\z", ""), F.lit("\n---\n"), F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---(\r?\n|\z)", ""))
    return F.concat(F.lit("sha256:"), F.sha2(F.when(head == "", text).otherwise(whole), 256))


def trust_tier(text: Column) -> Column:
    """How far a page's present content was checked: by a person, by a process, in an older state only, in an old notation, or not at all."""
    said = F.trim(F.regexp_extract(front_matter(text), r"(?m)^verified:([^\n]*)", 1))
    events = F.coalesce(F.from_json(said, VERIFIED), F.array().cast(VERIFIED))
    now = F.filter(events, lambda e: e["content_revision"] == content_revision(text))
    person = F.exists(now, lambda e: F.coalesce(e["by"].startswith("human:") & (e["origin"] == "local-cli"), F.lit(False)))
    return (
        F.when(said.isin("", "[]"), "unverified").when(person, "human-reviewed").when(F.size(now) > 0, "machine-confirmed")
        .when(F.exists(events, lambda e: e["content_revision"].isNotNull()), "stale").otherwise("legacy")
    )


QUERIES = {
    "section_warnings": section_warnings, "page_slugs": page_slugs, "graph_elements": graph_elements, "context_pages": context_pages, "delete_preview": delete_preview,
    "page_headers": page_headers, "page_sections": page_sections, "link_status": link_status, "broken_links": broken_links, "backlinks": backlinks, "orphans": orphans, "wiki_stats": wiki_stats,
    "lint_issues": lint_issues, "lint_summary": lint_summary, "wiki_tree": wiki_tree, "rename_preview": rename_preview, "content_revisions": content_revisions,
}

_PATH = r"regexp_replace(regexp_replace(replace(file_path, '\', '/'), '/(\./|/)+', '/', 'g'), '^(\./)+', '')"
_HEAD = r"regexp_extract(content, '(?s)\A---\r?\n(.*?)\r?\n---', 1)"
_FIELD = r"nullif(regexp_extract(head, '(?m)^{0}:\s*(.*?)\s*$', 1), '')"
_PAGES = rf"""(select id, project, path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') as stem,
  replace(regexp_replace(regexp_replace(path, '^wiki/', ''), '\.md$', ''), '/', ':') as slug, regexp_extract(path, '^wiki/([^/]+)/', 1) as folder,
  {_FIELD.format('title')} as title, lower({_FIELD.format('type')}) as type, try_cast({_FIELD.format('created')} as date) as created, {_FIELD.format('tags')} as tags,
  content, regexp_replace(content, '(?s)\A---\r?\n.*?\r?\n---\r?\n*', '') as body
  from (select distinct on (id) id, project, {_PATH} as path, {_HEAD} as head, content from chunks where kind = 'wiki'))"""
_MENTIONS = rf"""(select id, project, slug, line_no, line, unnest(regexp_extract_all(line, '\b([A-Za-z0-9_-]+\.(?:py|go|ts|js|rs|rb|java|sh|c|h|md|yaml))\b', 1)) as target
  from (select id, project, slug, ls[i] as line, i::bigint as line_no from (select id, project, slug, ls, unnest(range(1, len(ls) + 1)) as i from (select id, project, slug, regexp_split_to_array(body, '\r?\n') as ls from {_PAGES}))))"""
_FILES = f"(select distinct project, regexp_extract({_PATH}, '([^/]*)$', 1) as target from chunks where kind = 'code')"
_BROKEN = f"(select id, target, count(*)::bigint as occurrences from {_MENTIONS} where target not in (select target from {_FILES}) group by all)"
_SECTIONS = rf"""select id, pos, section, length(text)::bigint as chars, md5(text) as text_md5 from (
  select id, pos, case when pos = 0 then '' else trim(regexp_extract(part, '^([^\r\n]*)', 1)) end as section,
    regexp_replace(case when pos = 0 then part else regexp_replace(part, '^[^\r\n]*\r?\n?', '') end, '^\s+|\s+$', '', 'g') as text
  from (select id, i::bigint - 1 as pos, parts[i] as part from (select id, parts, unnest(range(1, len(parts) + 1)) as i from (select id, regexp_split_to_array(body, '(?m)^##[ \t]+') as parts from {_PAGES}))))
  where pos > 0 or text <> ''"""
_LINT = rf"""(select id, 'front_matter' as "check", 'error' as severity, detail from (select id, concat_ws(',', case when title is null then 'title' end, case when type is null then 'type' end, case when created is null then 'created' end, case when tags is null then 'tags' end) as detail from {_PAGES}) where detail <> ''
  union all select id, 'stale', 'warning', created::varchar from {_PAGES} where created < date '{TODAY}' - 120
  union all select id, 'folder', 'warning', folder from {_PAGES} where type is not null and not contains(folder, substr(type, 1, greatest(length(type) - 1, 1)))
  union all select id, 'duplicate_stem', 'error', stem from (select id, stem, count(*) over (partition by project, stem) as n from {_PAGES}) where n > 1
  union all select id, 'broken_links', 'warning', count(*)::varchar from {_BROKEN} group by id)"""

_SLUG = r"regexp_replace(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, {0}), '-+$', '')"
_WANT = "map {" + ", ".join(f"'{k}': {v}" for k, v in EXPECTED.items()).replace("[", "[").replace('"', "'") + "}"

SQL = {
    "section_warnings": rf"""select id, type, missing from (select id, type, have, unnest(({_WANT})[type]) as missing from (select id, type, list_transform(regexp_extract_all(body, '(?m)^#{{1,6}}[ \t]+([^\r\n]*?)[ \t]*$', 1), lambda h: lower(trim(h))) as have from {_PAGES})) where not list_contains(have, missing)""",
    "page_slugs": f"select id, coalesce(nullif({_SLUG.format(60)}, ''), 'note') as slug, coalesce(nullif({_SLUG.format(20)}, ''), 'page') as short, coalesce(nullif({_SLUG.format(60)}, ''), 'note') = stem as is_stem from {_PAGES}",
    "graph_elements": f"""with m as (select slug, target, count(*)::bigint as weight from {_MENTIONS} group by all) select distinct 'p:' || slug as id, 'page' as kind, '' as source, '' as target, 0::bigint as weight from {_PAGES}
      union all select distinct 'f:' || target, 'file', '', '', 0 from m union all select md5('p:' || slug || '>f:' || target), 'mention', 'p:' || slug, 'f:' || target, weight from m""",
    "context_pages": f"""select id, project, tokens, used from (select id, project, floor(length(content) / 3.5)::bigint as tokens, (sum(floor(length(content) / 3.5)::bigint) over (partition by project order by coalesce(created, date '1970-01-01') desc, id rows unbounded preceding))::bigint as used from {_PAGES}) where used <= 4000""",
    "delete_preview": f"""select project, target, pages, links from (select project, target, count(distinct id)::bigint as pages, count(*)::bigint as links, row_number() over (partition by project order by count(*) desc, target) as r
      from {_MENTIONS} where target in (select target from {_FILES}) group by project, target) where r = 1""",
    "page_headers": rf"""select id, slug, title, type, created, array_to_string(list_transform(string_split(regexp_replace(tags, '^\[|\]$', '', 'g'), ','), lambda t: trim(t)), '|') as tag_list, floor(length(content) / 3.5)::bigint as tokens from {_PAGES}""",
    "page_sections": _SECTIONS,
    "link_status": f"""select target, count(*)::bigint as pages, count(*) filter (status = 'own')::bigint as own, count(*) filter (status = 'other')::bigint as other, count(*) filter (status = 'broken')::bigint as broken
      from (select target, case when (project, target) in (select (project, target) from {_FILES}) then 'own' when target in (select target from {_FILES}) then 'other' else 'broken' end as status
      from (select distinct id, project, target from {_MENTIONS})) group by target""",
    "broken_links": f"select * from {_BROKEN}",
    "backlinks": f"""with m as (select *, row_number() over (partition by target, id order by line_no, line) as k from {_MENTIONS}),
      per as (select target, id, count(*)::bigint as n, coalesce(string_agg('L' || line_no || ': ' || substr(trim(line), 1, 160), ' / ' order by k) filter (k <= 3), '') as contexts from m group by all)
      select target, pages, occurrences, id as top_page, contexts from (select *, count(*) over (partition by target)::bigint as pages, (sum(n) over (partition by target))::bigint as occurrences, row_number() over (partition by target order by n desc, id) as r from per) where r = 1""",
    "orphans": f"""with f as (select * from {_FILES} where project in (select project from {_PAGES})), m as (select m.*, p.type from {_MENTIONS} m join {_PAGES} p using (id))
      select project, count(*)::bigint as orphans, 'any' as rule from f where target not in (select target from m) group by project
      union all select project, count(*)::bigint, 'own_project' from f where not exists (select 1 from m where m.project = f.project and m.target = f.target) group by project
      union all select project, count(*)::bigint, 'knowledge_pages' from f where target not in (select target from m where type in ('concept', 'entity', 'decision')) group by project""",
    "wiki_stats": f"""select coalesce(project, '*') as project, case when level > 0 then '*' else type end as type, pages, chars, tagged, level from (
      select project, type, count(*)::bigint as pages, sum(length(content))::bigint as chars, count(tags)::bigint as tagged, (grouping(project) * 2 + grouping(type))::bigint as level
      from (select * replace (coalesce(type, '-') as type) from {_PAGES}) group by rollup (project, type))""",
    "lint_issues": f"select * from {_LINT}",
    "lint_summary": f'select "check", severity, count(*)::bigint as issues, count(distinct id)::bigint as pages from {_LINT} group by all',
    "wiki_tree": f"""select folder, count(*)::bigint as pages, string_agg(slug, ', ' order by slug, id) filter (k <= 5) as first, greatest(count(*) - 5, 0)::bigint as more
      from (select folder, slug, id, row_number() over (partition by folder order by slug, id) as k from {_PAGES}) group by folder""",
    "rename_preview": rf"""select id, slug, len(regexp_extract_all(content, '\bcrop_thread\.yaml\b'))::bigint as replacements, sha256(regexp_replace(content, '\bcrop_thread\.yaml\b', 'crop_thread_v2.yaml', 'g')) as revision
      from {_PAGES} where regexp_matches(content, '\bcrop_thread\.yaml\b')""",
    "content_revisions": rf"""select id, 'sha256:' || sha256(content) as revision, sha256(regexp_replace({_HEAD}, '(?m)^(verified|generated|updated):[^\n]*\n?', '', 'g') || chr(10) || '---' || chr(10) || body) as content_revision from {_PAGES}""",
}
