"""Wrapper induction on generated sites whose main text is known."""

import random
import time

import pytest

from mnemo.llm import wrapper

WORDS = "river stone market letter window garden yellow quiet morning travel number bridge people silver winter history engine forest paper signal".split()


def sentence(rng, least=6, most=18):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(least, most))).capitalize() + f" {rng.randrange(10**6)}."


def site(rng, host, n, names):
    """(url, html, blocks of main text) of n pages of one host; ``names`` gives class names for its elements."""
    menu = [(f"/m{k}", sentence(rng, 1, 3)) for k in range(6)]
    terms, legal, tagline = sentence(rng), sentence(rng, 12, 20), sentence(rng, 4, 8)
    c = {k: names(k) for k in ("top", "menu", "hold", "lead", "main", "foot", "rel", "work")}
    out = []
    for k in range(n):
        title, lead = sentence(rng, 3, 6), sentence(rng)
        body = [sentence(rng, 15, 40) for _ in range(rng.randrange(2, 7))]
        links = "".join(f'<li><a href="/{rng.randrange(999)}">{sentence(rng, 1, 4)}</a></li>' for _ in range(rng.randrange(3, 8)))
        work = f'<div class="{c["work"]}"><p>{body[-1]}</p></div>' if k % 2 else f"<p>{body[-1]}</p>"
        html = (
            f'<html><body><div class="{c["top"]}"><p>{tagline}</p></div><div class="{c["menu"]}">' + "".join(f'<a href="{u}">{t}</a> ' for u, t in menu) + "</div>"
            f'<div class="{c["hold"]}"><h1>{title}</h1><div class="{c["lead"]}">{lead}</div><div class="{c["main"]}">' + "".join(f"<p>{p}</p>" for p in body[:-1]) + f"<p>{terms}</p>{work}</div></div>"
            f'<div class="{c["rel"]}"><ul>{links}</ul></div><div class="{c["foot"]}">{legal}</div></body></html>'
        )
        out.append((f"http://{host}/{k}", html, [title, lead, *body]))
    return out


def pages_of(spark, rows):
    return spark.createDataFrame([(k, u, h) for k, (u, h, *_) in enumerate(rows)], "page_id long, url string, html string")


def scores(spark, rows):
    got = {r["page_id"]: r["text"] for r in wrapper.main_text(pages_of(spark, rows)).collect()}
    hit = said = known = 0
    for k, (_, _, want) in enumerate(rows):
        found = got[k].split("\n\n") if got[k] else []
        hit, said, known = hit + len(set(found) & set(want)), said + len(found), known + len(want)
    return hit / said, hit / known


@pytest.fixture(scope="module")
def sites():
    rng = random.Random(4)
    rows = []
    for host in range(6):
        tag = f"q{rng.randrange(100)}x"
        rows += site(rng, f"h{host}.example.org", 12, (lambda k, t=tag: t + str(sum(map(ord, k)) % 997)) if host % 2 else (lambda k: ""))
    return rows


def test_template_goes_and_every_block_of_the_article_stays(spark, sites):
    precision, recall = scores(spark, sites)
    assert precision >= 0.95 and recall >= 0.95


def test_names_and_tags_are_not_needed(spark, sites, monkeypatch):
    for name in ("NAMED", "BESIDE", "GENERIC", "SPEAKS"):
        monkeypatch.setattr(wrapper, name, frozenset())
    precision, recall = scores(spark, sites)
    assert precision >= 0.95 and recall >= 0.95


def test_copies_of_an_article_are_not_template(spark):
    page = "<html><body><div>Same line.</div><article><h1>One</h1><p>An article that a site has five times over.</p></article></body></html>"
    rows = [(f"http://a.org/{k}", page, []) for k in range(5)]
    got = {r["text"] for r in wrapper.main_text(pages_of(spark, rows)).collect()}
    assert len(got) == 1 and "An article that" in got.pop()


def test_names_inside_words_do_not_drop_text(spark):
    body = '<article><h1>T</h1><div class="related-work"><p>On related work.</p></div><section class="search-methods"><p>On search.</p></section><p>Let <math><mi>x</mi></math> be.</p><div class="content with-sidebar"><p>Kept.</p></div></article>'
    rows = [("http://a.org/1", f"<html><body><div class='comment-list'><p>Reader says.</p></div>{body}<div class='ad-box'>Buy.</div></body></html>", [])]
    assert wrapper.main_text(pages_of(spark, rows)).first()["text"] == "T\n\nOn related work.\n\nOn search.\n\nLet x be.\n\nKept."


@pytest.mark.parametrize(
    ("attrs", "gone"),
    [
        ("class='cookie-notice'", True), ("class=sidebar-left", True), ("id=comments", True), ("class='user-comments'", True), ("class='sponsored-content'", True), ("class='relatedPosts'", True), ("class='ad-slot-1'", True),
        ("class='social_share'", True), ("role=complementary", True), ("class=related-work", False), ("class='post social'", False), ("class='search-methods'", False), ("class=content-with-sidebar", False), ("class='commentary'", False), ("data-role=menu", False),
    ],
)
def test_names_count_where_they_say_nothing_else(attrs, gone):
    node = wrapper.parse(f"<div {attrs}>x</div>").kids[0]
    assert node.named == gone


def test_a_form_around_the_page_does_not_empty_it(spark):
    rows = [(f"http://a.org/{k}", f"<html><body><form><nav><a href=/>Home</a></nav><p>Text {k} of a page that lies in a form.</p><input></form></body></html>", []) for k in range(6)]
    assert wrapper.main_text(pages_of(spark, rows)).where("page_id = 3").first()["text"] == "Text 3 of a page that lies in a form."


def test_result_does_not_depend_on_partitions(spark, sites):
    a = wrapper.main_text(pages_of(spark, sites).repartition(1)).collect()
    b = wrapper.main_text(pages_of(spark, sites).repartition(7, "url")).collect()
    assert sorted(a) == sorted(b)


def test_odd_pages(spark):
    rows = [(0, None, None), (1, "http://a.org", ""), (2, "x", "  "), (3, "http://a.org/b", "<p>One &amp; two<br>three"), (3, "http://a.org/b", "<p>One &amp; two<br>three"), (None, None, "plain"), (4, "u", "<script>x"), (5, "u", "<p hidden>x<p>y")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr("*", "1 AS host", "2 AS wrapper", "3 AS blocks")
    got = sorted((r["page_id"] if r["page_id"] is not None else -1, r["text"], r["n_chars"]) for r in wrapper.main_text(df).collect())
    assert got == [(-1, "plain", 5), (0, "", 0), (1, "", 0), (2, "", 0), (3, "One & two three", 15), (3, "One & two three", 15), (4, "", 0), (5, "y", 1)]
    assert wrapper.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<div></b>" * 50_000, "<div>a" * 50_000, "".join(f"<div>a{i}</div><section>b</section>" for i in range(50_000)), "<b>" * 200_000 + "<p>x" * 1000, "<p>" + "word " * 400_000])
def test_large_and_deep_pages_end_in_seconds(page):
    began = time.perf_counter()
    top, blocks = wrapper.outline(wrapper.parse(page))
    again = wrapper.load(wrapper.dump(top))
    wrapper.merge(again, wrapper.load(wrapper.dump(top)))
    assert set(wrapper.place(top, again)) == {id(s) for _, s in wrapper.preorder(top)}
    assert time.perf_counter() - began < 20 and blocks is not None


def test_matching_counts_the_largest_order_preserving_match():
    tree = lambda t: wrapper.load(wrapper.SEP.join(f"{d}{wrapper.CUT}{x}" for d, x in t))
    a = tree([(0, "r"), (1, "a"), (2, "x"), (1, "b"), (1, "c")])
    b = tree([(0, "r"), (1, "b"), (1, "a"), (2, "x"), (2, "y"), (1, "c")])
    assert wrapper.matching(a, b) == 4
    wrapper.merge(a, b)
    assert [s.label for _, s in wrapper.preorder(a)] == ["r", "b", "a", "x", "y", "b", "c"]
