import random
import time

import pytest
import regex

from sediment.llm import wrappers as w
from sediment.llm.frames import Scratch

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{x}</style><script>var a="</p>";</script></head><body class="home">
<header>Top</header><nav><ul>%s</ul></nav><div class="ad">Buy</div><article><h1>Head %d</h1><p>One &lt;b&gt;
 two</p>%s<aside>Side</aside><div class="comments"><p>First!</p></div><form><p>Mail</p></form></article><div id="cookie-notice">Ok?</div><footer>End</footer></body></html>"""
ROWS = [
    (k, f"https://Host{k % 2}.example/p/{k}?q", PAGE % ("".join(f"<li><a href='{j}'>m{j}</a></li>" for j in range(k % 4 + 1)), k, "".join(f"<p>more<i>{j}</i></p>" for j in range(k % 3))))
    for k in range(12)
]
WANT = [f"Head {k} One <b> two" + "".join(f" more{j}" for j in range(k % 3)) for k in range(12)]


def test_pages_of_a_host(spark):
    odd = [
        (100, None, None), (101, "", ""), (102, "no url", "just text"), (103, "http://x.example", "<p>a<p>b &copy; c<!-- gone"),
        (104, "//Host0.example/", "<article><div class='promo'>no</div>yes</article><p>out"), (105, "http://x.example", "<script>never closed <p>x"),
        (106, "http://x.example", "<body><p class=ad>buy<p>read</body>"), (107, "http://x.example", "a < b <3 & <b>c</b>d&nbsp;e</nowhere><br>f"),
    ]
    df = spark.createDataFrame([(i, u, h, 3) for i, u, h in [*ROWS, *odd, ROWS[0]]], "page_id long, url string, html string, text int")
    out = w.extract(spark, df).collect()
    assert len(out) == 21 and all(r.by_host for r in out if r.page_id < 100)
    got = {r.page_id: r.text for r in out}
    assert [got[k] for k in range(12)] == WANT
    assert [got[k] for k in range(100, 108)] == ["", "", "just text", "a b © c", "yes", "", "read", "a < b <3 & cd e f"]
    assert w.extract(spark, df.limit(0)).count() == 0


def test_wrappers_accept_the_streams_they_come_from():
    streams = [w.tokens(h)[0] for _, _, h in ROWS]
    now = w.fold(streams[0])
    for s in streams[1:]:
        now = w.align(now, w.fold(s))
    wrapper = w.Wrapper(now)
    for s in streams:
        assert wrapper.kinds(s) == w.direct_kinds(s)
        assert w.Wrapper(w.fold(s)).kinds(s) == w.direct_kinds(s)
    assert wrapper.kinds(["<blink"]) is None and wrapper.kinds(streams[0][:-1]) is None
    assert w._load(w.json.dumps(now)) == now


def test_folding_and_aligning():
    assert w.fold(list("abab")) == [("+", ("a", "b"))] and w.fold(list("aabaab")) == [("+", (("+", ("a",)), "b"))]
    assert w.align(["x", "a", "y"], ["x", "y"]) == ["x", ("?", ("a",)), "y"]
    assert w.align(["x", "a", "y"], ["x", ("+", ("a",)), "y"]) == ["x", ("+", ("a",)), "y"]


def test_words_of_a_class_and_articles_aside_lose_no_main_text():
    def text(page):
        stream, texts = w.tokens(page)
        kinds = w.direct_kinds(stream)
        assert w.Wrapper(stream).kinds(stream) == kinds
        return w.main_text(stream, texts, kinds)

    assert text("<main><p>body</p></main><aside><article>teaser</article></aside>") == "body"
    assert text("<main><p>body</p></main><div class='related'><article>teaser</article></div>") == "body"
    assert text("<p>body</p><article> \n</article>") == "body"
    assert text("<nav>menu</nav><div class='content no-sidebar'><p>body</p></div>") == "body"
    assert text("<p>top</p><article class='post related-topic'><p>body</p><div class='share'>no</div></article>") == "body"
    assert text("<p>top</p><div class='content no-sidebar'><article>body</article></div>") == "body"
    assert text("<article>body<div class='comments'><article class='comment'>first</article></div></article>") == "body"
    assert text("<article role='dialog'>no</article><div role='banner'><article>no</article></div><p>body</p>") == "body"
    assert text("<p>body</p><div class='ad'>buy</div>") == "body"


def test_the_wrapper_decides_by_what_the_host_puts_into_its_slots(spark):
    layout = "<nav>menu</nav><p>Same line</p><div class='content no-sidebar'><p>body %d of the page</p></div>"
    menu = "<nav><b>home %d</b></nav><article><p>text %d</p></article><footer>end</footer>"
    rows = [(k, "http://l.example", layout % k) for k in range(4)]
    rows += [(10 + k, "http://m.example", menu % (k, k)) for k in range(4)]
    rows += [(20, "http://m.example", (menu % (5, 5)).replace("</nav>", "")), (21, "http://alone.example", layout % 9)]
    rows += [(30 + k, "http://c.example", f"<p>one long body that is the same</p><div class='ad'>ad {k}</div>") for k in range(4)]
    out = w.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = {r.page_id: r.text for r in out}
    assert all(r.by_host for r in out)
    assert [got[k] for k in range(4)] == [f"body {k} of the page" for k in range(4)]
    assert [got[10 + k] for k in range(4)] == [f"text {k}" for k in range(4)] and got[20] == "text 5"
    assert got[21] == "Same line"
    assert {got[30 + k] for k in range(4)} == {"one long body that is the same"}


def random_streams(seed, n, length):
    """Streams of one made-up layout with optional, repeated and shuffled parts."""
    rnd = random.Random(seed)
    layout = [rnd.choice(["<p", "</p", "<div", "</div", "#", "<ul", "<li", "<b"]) for _ in range(length)]
    for _ in range(n):
        s = []
        for x in layout:
            if rnd.random() < 0.1:
                continue
            s += [x] * (rnd.choice([1, 1, 1, 3]) if x != "#" else 1)
        yield [x for k, x in enumerate(s) if k == 0 or x != "#" or s[k - 1] != "#"]


def as_regex(items):
    code = {}

    def build(items):
        return "".join(code.setdefault(x, chr(0xE000 + len(code))) if isinstance(x, str) else f"(?:{build(x[1])}){x[0]}" if x[0] != "*" else "[" + build(x[1]) + "]*" for x in items)

    return build(items), code


@pytest.mark.parametrize("most", [4000, 30, 3])
def test_a_wrapper_accepts_all_it_was_made_from_and_what_its_expression_says(most):
    for seed in range(12):
        streams = list(random_streams(seed, 12, 14))
        now = w.fold(streams[0])
        for s in streams[1:]:
            now = w.align(now, w.fold(s), most)
        wrapper, (pattern, code) = w.Wrapper(now), as_regex(now)
        for s in streams:
            slots = wrapper.slots(s)
            assert slots is not None and len(slots) == s.count("#")
            if most > 4000:
                assert slots == sorted(slots)
        for s in [*random_streams(seed + 100, 20, 6), *(s[:-1] for s in streams), *(s[1:] for s in streams)]:
            text = "".join(code.get(x, "!") for x in s)
            assert (wrapper.slots(s) is not None) == bool(regex.fullmatch(pattern, text))


def test_long_pages_take_seconds_and_nothing_is_left_out(spark):
    rnd = random.Random(4)
    tags = ["<p", "</p", "<i", "</i", "<div", "</div", "<b", "</b"]
    one = [rnd.choice(tags) for _ in range(100_000)]
    two = [x for x in one if rnd.random() > 0.01]
    began = time.perf_counter()
    a, b = w.fold(one), w.fold(two)
    both = w.Wrapper(w.align(a, b))
    assert both.slots(one) == [] and both.slots(two) == []
    assert time.perf_counter() - began < 60
    long = "<nav>menu</nav><article>" + "".join(f"<p>{k} <i>x</i></p>" + "<hr>" * (k % 3) for k in range(20_000)) + "</article><footer>end</footer>"
    short = "<nav>menu</nav><article><p>1</p><h2>two</h2></article><footer>end</footer>"
    df = spark.createDataFrame([(1, "http://h.example", long), (2, "http://h.example", short)], "page_id long, url string, html string")
    out = {r.page_id: r for r in w.extract(spark, df).collect()}
    assert out[1].text == " ".join(f"{k} x" for k in range(20_000)) and out[2].text == "1 two" and out[1].by_host and out[2].by_host


def test_the_tree_of_alignments_accepts_every_page_of_a_host(spark):
    rnd = random.Random(6)
    pages = [(k, "http://big.example", "<nav>m</nav><article>" + "".join(rnd.choice(["<p>a</p>", "<ul><li>b</li></ul>", "<h2>c</h2>", "<table><tr><td>d</td></tr></table>"]) for _ in range(rnd.randint(1, 12))) + "</article>") for k in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    (host,) = w.infer_wrappers(Scratch(spark), df, fan=4).collect()
    wrapper = w.Wrapper(w._load(host.wrapper))
    for _, _, h in pages:
        stream = w.tokens(h)[0]
        assert wrapper.slots(stream) is not None


def test_votes_of_the_host_settle_a_slot(spark):
    """Broken pages, in which the article never opens, still give its text; without inference they give everything."""
    page = "<div class=x><b>menu</b></div><article><p>text %d</p></article><div><i>about %d</i></div>"
    rows = [(k, "http://v.example", page % (k, k)) for k in range(12)]
    rows += [(50, "http://v.example", (page % (50, 50)).replace("</article>", ""))]
    got = {r.page_id: r.text for r in w.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"text {k}" for k in [*range(12), 50]}
    stream, texts = w.tokens(rows[-1][2])
    assert w.main_text(stream, texts, w.direct_kinds(stream)) == "text 50 about 50"


def test_text_that_is_the_same_on_all_pages_is_boilerplate_outside_articles(spark):
    page = "<div><a>Home</a><a>About us</a></div><div><p>Story %d begins here and goes on</p></div><div>All rights reserved</div>"
    rows = [(k, "http://s.example", page % k) for k in range(5)] + [(9, "http://t.example", page % 9)]
    got = {r.page_id: r.text for r in w.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(5)] == [f"Story {k} begins here and goes on" for k in range(5)]
    assert got[9] == "HomeAbout us Story 9 begins here and goes on All rights reserved"
