"""Wikilinks of pages read from a directory: targets, resolution, audits, rewriting."""

import pytest

from loreweave.functions.text import page_slug
from loreweave.operators import links as L
from loreweave.sources.pages import read_pages

PAGES = {
    "index.md": "# Index\n[[entities:auth-service]] [[lonely]]",
    "entities/auth-service.md": "---\ntype: entity\n---\nUses [[token-store#Keys|the store]] and [[auth-service]].\nSee [[token-store]], [[ token-store ]] and [[missing|gone]].",
    "entities/token-store.md": "---\ntype: entity\n---\nBack to [[entities:auth-service|auth]].",
    "concepts/token-store.md": "---\ntype: concept\n---\nNothing. [[]] [[a b]] [not](a link)",
    "concepts/lonely.md": "---\ntype: concept\n---\nAlone.",
    "sessions/one.md": "---\ntype: session\n---\n[[auth-service]]",
}


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("wiki")
    for name, text in PAGES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    return read_pages(spark, str(root)).select(page_slug("path").alias("slug"), "type", "body", "size").cache()


@pytest.fixture(scope="module")
def resolved(rows):
    return L.resolve(L.wikilinks(rows), rows).cache()


def test_links_with_anchor_and_label(rows):
    got = {(r.slug, r.line_no, r.target, r.anchor, r.label) for r in L.wikilinks(rows).collect()}
    assert ("entities:auth-service", 1, "token-store", "Keys", "the store") in got and ("entities:auth-service", 2, "token-store", None, None) in got
    assert ("entities:auth-service", 2, "missing", None, "gone") in got and ("concepts:token-store", 1, "a b", None, None) in got and len(got) == 9  # the two plain links of a line are one row here


def test_exact_then_smallest_suffix(resolved):
    got = {(r.target, r.node, r.how) for r in resolved.collect()}
    assert got == {
        ("entities:auth-service", "entities:auth-service", "exact"), ("token-store", "concepts:token-store", "suffix"), ("auth-service", "entities:auth-service", "suffix"), ("lonely", "concepts:lonely", "suffix"),
        ("missing", None, "broken"), ("a b", None, "broken"),
    }


def test_orphans_by_three_rules(rows, resolved):
    got = {}
    for r in L.orphan_pages(rows, resolved).collect():
        got.setdefault(r.rule, set()).add(r.slug)
    assert got == {"any": {"entities:token-store", "sessions:one"}, "stats": {"entities:token-store", "sessions:one", "concepts:lonely"}, "checks": {"entities:token-store"}}


def test_rewriting_keeps_anchors_and_labels(spark, rows):
    renames = spark.createDataFrame([("token-store", "vault"), ("nobody", "x"), (None, "y")], "old string, new string")
    got = {r.slug: (r.replacements, r.body) for r in L.rewrite_links(rows, renames).collect()}
    assert set(got) == {"entities:auth-service"}
    n, body = got["entities:auth-service"]
    assert n == 2 and "[[vault#Keys|the store]]" in body and "[[vault]]" in body and "[[missing|gone]]" in body


def test_odd_pages(spark):
    df = spark.createDataFrame([("a", None, 1), (None, "[[a]]", 1), ("b", "", 1), ("a", "[[x.y*]] " * 2000, 1)], "slug string, body string, line int")
    found = L.wikilinks(df)
    assert found.count() == 2000 and L.resolve(found, df).where("node is null").count() == 2000
    assert L.resolve(L.wikilinks(df.limit(0)), df.limit(0)).count() == 0
    again = L.rewrite_links(df, spark.createDataFrame([("x.y*", "z")], "old string, new string")).first()
    assert again.replacements == 2000 and "[[z]]" in again.body
