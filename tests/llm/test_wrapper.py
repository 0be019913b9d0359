"""Main text of pages: odd markup, templates of a host, null and empty pages."""

import random
from itertools import combinations

import pytest

from hopwise.llm import wrapper
from hopwise.llm.wrapper import Matching, Page, Shape, Template, extract_main_text, main_text, node_weight

SHELL = "<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><header><h1>Site</h1></header>{}<aside>side</aside><footer>end</footer></body></html>"


def text(source):
    return main_text(Page(source), None, frozenset())


def test_article_without_its_surroundings():
    body = "<article><h1>T &amp; U</h1><p>One  <b>two</b>\n three<br>four<p>five<div class='share-buttons'>x</div><form>f</form><script>var a='</p>';</script><section id=comments>c</section></article>"
    assert text(SHELL.format(body)) == "T & U\nOne two three four\nfive"


def test_page_without_an_article_and_with_broken_markup():
    assert text("<div>a<p>b<ul><li>c<li>d</ul><div class=ad>no</div><p hidden>no<p style='display:none'>no</div>e<!-- x --><b") == "a\nb\nc\nd\ne"
    assert text("plain &lt;text&gt; &nbsp; here") == "plain <text> here"
    assert text("<p>x</p></div></p><td>y</td>") == "x\ny"
    assert text("<textarea>no</textarea><noscript>no</noscript><p title='a>b'>yes") == "yes"
    assert text("") == "" and text("<") == "<"
    assert len(text("<div>" * 300 + "deep")) == 4


def test_names_drop_what_they_name_and_no_more():
    assert text("<div class='layout has-sidebar'><article class='post comments-open'><div class='article-body with-ads'>yes</div><div class='post-share-buttons'>no</div></article></div>") == "yes"
    assert text("<article>yes</article><article class=comment>no</article><div id='user-comments'><article>no</article></div>") == "yes"
    assert text("<div class='page-banner'><main>yes</main></div><div class=banner>no</div>") == "yes"
    assert text("<div class=shadow>yes</div><div class='loading'>too</div><div class='ad ad-300'>no</div><div id=cookieNotice>no</div>") == "yes\ntoo"


def tree(r, depth=3):
    n = Shape(r.choice(["div", "div.a", "div.b", "p", "p.a", "ul"]))
    n.texts = set(r.sample(range(4), r.randint(0, 2)))
    n.children = [tree(r, depth - 1) for _ in range(r.randint(0, 3))] if depth else []
    return n


def plain_weight(a, b):
    """By all ways to pair children in order."""
    if a.tag != b.tag:
        return 0
    most = 0
    for n in range(min(len(a.children), len(b.children)) + 1):
        for x in combinations(a.children, n):
            for y in combinations(b.children, n):
                w = [plain_weight(c, d) for c, d in zip(x, y, strict=True)]
                most = max(most, sum(w) if all(w) else 0)
    return node_weight(a, b) + most


def test_matching_is_the_heaviest():
    r = random.Random(5)
    for _ in range(400):
        a, b = tree(r), tree(r)
        a.label = b.label = a.tag = b.tag = "div"
        m = Matching(a, b)
        assert m.weight(a, b) == plain_weight(a, b) == sum(node_weight(x, y) for x, y in m.pairs())
        place = {id(c): (id(n), i) for t in (a, b) for n in nodes_of(t) for i, c in enumerate(n.children)}
        at = [(place[id(x)], place[id(y)]) for x, y in m.pairs()[1:]]
        matched = {id(x): id(y) for x, y in m.pairs()}
        assert all(matched[p] == q for (p, _), (q, _) in at)
        assert all((i < k) == (j < n) for ((p, i), (_, j)), ((q, k), (_, n)) in combinations(at, 2) if p == q)


def nodes_of(t):
    out = [t]
    for n in out:
        out += n.children
    return out


def test_long_lists_match_by_labels(monkeypatch):
    monkeypatch.setattr(wrapper, "MANY", 3)
    a, b = Shape("div"), Shape("div")
    a.children, b.children = [Shape(f"p.{c}") for c in "abcdef"], [Shape(f"p.{c}") for c in "xbadzf"]
    m = Matching(a, b)
    assert [(x.label, y.label) for x, y in m.pairs()[1:]] in ([("p.a", "p.a"), ("p.d", "p.d"), ("p.f", "p.f")], [("p.b", "p.b"), ("p.d", "p.d"), ("p.f", "p.f")])
    assert m.weight(a, b) == 2 + 3 * 2


def test_template_takes_in_what_has_no_match_and_survives_its_text_form():
    t = Template()
    for s in ("<div><p>1</p><table></table></div>", "<div><p>2</p><ul><li>x</ul><table></table></div>"):
        t.add(Page(s).shape)
    t = Template.unpacked(t.packed())
    assert [c.label for c in t.root.children[0].children] == ["p", "ul", "table"] and len(t.root.children[0].children[0].texts) == 2
    page = Page("<div><p>3</p><ul><li>y</ul><dl><dt>z</dl></div>")
    named = [t.nodes(page.shape)[id(n)] for n in nodes_of(page.shape)]
    assert len(set(named)) == len(named) and sum(0 <= n < 10 for n in named) == 5


def varied(i):
    """The wrapper's class is another on each page, and so is what stands before it."""
    name = "abcdefgh"[i % 8]
    return f"<div class={name}x><p class=lead{name}>own {i}</p><p class=n{name}>Read our rules</p></div>"


def all_texts(spark, pages, parts=3):
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(parts)
    return [r["text"] for r in sorted(extract_main_text(df).collect(), key=lambda r: r["page_id"])]


def test_the_alignment_decides(spark, monkeypatch):
    t = Template()
    pages = [Page(varied(i)) for i in range(8)]
    for p in pages[:4]:
        t.add(Page(varied(int(p.blocks[0][1].split()[1]))).shape)
    most = max(wrapper.node_counts(t, pages).values())
    assert all_texts(spark, [varied(i) for i in range(8)]) == [f"own {i}" for i in range(8)]
    monkeypatch.setattr(Matching, "pairs", lambda self: [(self.a, self.b)])
    shared = wrapper.node_counts(t, pages)
    assert most == 8 and max(shared.values()) == 1  # nothing is constant without the alignment


def test_result_does_not_depend_on_partitions(spark):
    copies = ["<div>Legal words</div><div>copied</div>"] * 6
    pages = copies + [f"<div>Legal words</div><div>own {i}</div>" for i in range(2)]
    wide = [f"<div>{''.join(f'<div class=c{chr(97 + k // 26)}{chr(97 + k % 26)}>{i} {k}</div>' for k in range(61))}<div class=legal>Legal</div></div>" for i in range(8)]
    for some, parts in ((pages, (1, 6)), (wide, (1, 4))):
        one, many = (all_texts(spark, some, n) for n in parts)
        assert one == many
    assert all("Legal" not in x for x in many)


def test_constants_inside_an_article(spark):
    page = lambda i: f"<article><p>{'word ' * 9}{i}</p><div>Subscribe here</div></article>"
    assert all_texts(spark, [page(i) for i in range(6)]) == [f"{'word ' * 9}{i}" for i in range(6)]
    near = [f"<nav>{i}</nav><article><p>{'one text ' * 9}</p><p>{i}</p></article>" for i in range(9)]  # copies of an article but for a word
    assert all(x.startswith("one text") for x in all_texts(spark, near))


@pytest.mark.parametrize("n", [600, 5000])
def test_deep_pages(spark, n):
    deep = "<div>" * n + "deep<article>" + "<section>" * n + "far"
    assert text(deep) == "far" and text("<div>" * n + "deep") == "deep"
    assert all_texts(spark, [deep + str(i) for i in range(4)]) == [f"far{i}" for i in range(4)]


def test_constant_nodes_of_a_host_are_template(spark):
    page = lambda i: f"<div><div>Our site, since 1999</div><div>own text {i}</div><div>legal words</div></div>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(8)] + [(8, "http://alone.example/", page(8)), (9, None, page(9)), (10, "http://h.example/x", None), (11, "::bad::", ""), (None, None, None)]
    rows += [(12, "http://copies.example/1", page(0)), (13, "http://copies.example/2", page(0)), (14, "http://copies.example/3", page(0))]
    df = spark.createDataFrame([r + ("x", "y") for r in rows], "page_id long, url string, html string, host string, constant string").repartition(3)
    out = {r["page_id"]: r for r in extract_main_text(df).collect()}
    assert len(out) == len(rows)
    for i in range(8):
        assert out[i]["text"] == f"own text {i}" and out[i]["n_chars"] == len(out[i]["text"])
    for i in (8, 9):
        assert out[i]["text"] == f"Our site, since 1999\nown text {i}\nlegal words"
    assert {out[i]["text"] for i in (10, 11, None)} == {""} and out[12]["text"] == out[13]["text"] != ""
    assert extract_main_text(df.where("false")).count() == 0
