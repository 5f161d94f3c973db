import random
import re

import numpy as np
import pytest

from tidewell.llm import html, urls

PAGE = "page_id bigint, url string, html string, text string, host string"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, ("", "", None, "allow")), ("no scheme", ("", "", None, "allow")), ("http://Example.ORG", ("example.org", "", None, "allow")), ("http://a.example.org/x?q=/es/", ("a.example.org", "/x", "org/", "allow")),
        ("https://example.org/es/1#t", ("example.org", "/es/1", "example.org/es/", "block")), ("https://example.org/ES/1", ("example.org", "/ES/1", "org/", "allow")), ("https://m.example.org/en/12", ("m.example.org", "/en/12", "example.org/en/1", "block")),
        ("https://notexample.org/es/", ("notexample.org", "/es/", "org/", "allow")), ("https://example.org:80/es/", ("example.org:80", "/es/", None, "allow")), ("http://x.com/fr/a", ("x.com", "/fr/a", "com/fr/", "allow")), ("http://x.com/de/", ("x.com", "/de/", "com/de/", "block")), ("http://x.com/de", ("x.com", "/de", None, "allow")),
        ("http:///org/", ("", "/org/", None, "allow")), ("http://casino-win.net/de/", ("casino-win.net", "/de/", None, "block")), ("http://x.net/Ads/1", ("x.net", "/Ads/1", None, "block")),
    ],
)
def test_urls(url, want):
    host, path, rule, verdict, *_ = urls.Index(urls.default_rules(), {}).judge(url)
    assert (host, path, rule, verdict) == want


def test_index_gives_what_running_every_rule_gives():
    rules = urls.default_rules() + [urls.pattern_rule("*track*"), urls.pattern_rule("/a*b/")]
    index, rnd = urls.Index(rules, {"org": 9, "example": 3}), random.Random(3)
    parts = ["org", "com", "example", "es", "en", "1", "ads", "casino", "track", "fr", "de", "x", "ab", "login", "www"]
    ran = 0
    for _ in range(2000):
        url = f"http://{'.'.join(rnd.choices(parts, k=3))}/{'/'.join(rnd.choices(parts, k=2))}{rnd.choice(['', '/', '?sessionid=2'])}"
        host, path = urls.split(url)
        best = None
        for r in rules:
            if re.compile(r.regex, re.DOTALL).match(url.lower() if r.whole else host + path) and (best is None or r.rank > best.rank):
                best = r
        got = index.judge(url)
        assert got[3] == (best.verdict if best else "allow") and got[2] == (best.name if best and not best.whole else None)
        ran += got[5]
    assert ran < 2000 * len(rules) / 3


def test_urls_of_rows(spark):
    frame = spark.createDataFrame([(1, "http://x.com/de/", None, "t", "clash"), (1, "http://x.com/de/", None, "t", "clash"), (None, None, None, None, None)], PAGE)
    got = urls.judged(frame).collect()
    assert [(r["page_id"], r["verdict"]) for r in got] == [(1, "block"), (1, "block"), (None, "allow")]
    assert urls.judged(frame.where("false")).count() == 0


ARTICLE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div class="cookie-notice">We use cookies</div><header><a href="/">Site</a></header><nav><ul><li><a href="/a">Menu</a></ul></nav><!-- ad --><div class="ad">Buy</div>
<main><article><header><h1>Head &eacute;&nbsp;line</h1></header><p><b>First<br>para&#39;s  text<p>Second
 para &lt;b&gt;</p><aside>Related</aside><form>Name <input></form><table><tr><td>x<td>y</table><footer>Share</footer></article>
<section id="comments"><article><p>A comment</p></article></section></main><div class="sidebar">Side</div><footer>&copy; me</footer>"""


def brute_texts(rows, run=8, tag_run=4):
    """(page_id, text) of pages, every host's windows in one dictionary."""
    words, slots, hosts, cut = {}, {}, {}, []
    for page_id, url, markup in rows:
        host = re.split("[/?#]", url.split("://", 1)[1])[0].lower() if url and "://" in url else ""
        owner = page_id if page_id is not None else ("none", markup)
        page = html.Page(markup)
        cut.append((host, page))
        hosts.setdefault(host, set()).add(owner)
        tags = [""] * (tag_run - 1) + page.structure + [""] * (tag_run - 1)
        for j in range(len(tags) - tag_run + 1):
            slots.setdefault((host, *tags[j : j + tag_run]), set()).add(owner)
        own = page.asked()[0]
        for j in range(len(own) - run + 1):
            words.setdefault((host, *own[j : j + run]), set()).add(owner)
    out = []
    for (page_id, *_), (host, page) in zip(rows, cut, strict=True):
        tags = [""] * (tag_run - 1) + page.structure + [""] * (tag_run - 1)
        gone = {n for n, at in enumerate(page.suspects) if len(hosts[host]) == 1 or any(len(slots[(host, *tags[j : j + tag_run])]) > 1 for j in range(at, at + tag_run))}
        own, first, number = page.asked()
        hit = [False] * len(own)
        for j in range(len(own) - run + 1):
            if len(words[(host, *own[j : j + run])]) > 1:
                hit[j : j + run] = [True] * run
        out.append((page_id, page.text(gone, {n for n, a, z in zip(number, first, first[1:], strict=False) if 2 * sum(hit[a:z]) >= z - a})))
    return sorted(out, key=str)


def texts_of(frame, **options):
    return sorted(((r["page_id"], r["text"]) for r in html.extracted(frame, **options).collect()), key=str)


def one_page(markup):
    return html.Page(markup).text(set(range(99)))


def test_article_without_the_rest():
    assert one_page(ARTICLE) == "Head é line\nFirst para's text\nSecond para <b>\nx\ny"


def test_a_block_is_one_and_names_of_content_are_no_suspects():
    assert one_page("<article><p>a<span class='ad'>no</span>b <i>c</i></p></article>") == "ab c"
    assert one_page("<article><p class='social-science'>one</p><section class='reply-to-critics'><p>two</p></section><div class='ad-box'>x</div></article>") == "one\ntwo"
    assert one_page("<div class='page-header'>x</div><article><header class='entry-header'><h1>T</h1></header><p>y</p></article><div id='sidebarLeft'>z</div>") == "T\ny"


def test_host_pages_decide_what_class_names_only_suggest(spark):
    slot = "<body><nav><a>m</a></nav><div class='ad'>unique words {0}</div><article><h1>h{0}</h1><p>text {0}</p></article></body>"
    rows = [(i, "http://h.org/", slot.format(i)) for i in range(3)]
    rows += [(3, "http://h.org/", "<body><article><p>x</p><ul><li>y</li></ul><p class='notice'>a passage that only looks like a notice</p></article></body>")]
    rows += [(9, "http://one.org/", slot.format(9)), (9, "http://one.org/", slot.format(9))]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = dict(texts_of(frame))
    assert got[0] == "h0\ntext 0" and got[9] == "h9\ntext 9" and got[3].endswith("a passage that only looks like a notice")


def test_without_the_array_the_driver_pages_change(spark, sf):
    frame = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/pages.parquet")
    rows = [tuple(r) for r in frame.select("page_id", "url", "html").collect()]
    own = texts_of(frame)
    assert own == brute_texts(rows)
    blind = [(i, html.Page(m).text()) for i, _, m in rows]
    assert sum(a != b for a, b in zip(own, sorted(blind, key=str), strict=True)) > 0.8 * len(rows)


def brute_cover(streams, pages, run):
    seen = {}
    for s, p in zip(streams, pages, strict=True):
        for i in range(len(s) - run + 1):
            seen.setdefault(tuple(s[i : i + run]), set()).add(p)
    return [[any(len(seen[tuple(s[j : j + run])]) > 1 for j in range(max(0, i - run + 1), i + 1) if j + run <= len(s)) for i in range(len(s))] for s in streams]


def test_sparse_suffixes_find_every_longer_run(spark):
    rnd = random.Random(5)
    for total in [*range(1, 21), 60]:  # hosts of a few words, too
        streams = [[f"w{rnd.randrange(4)}" for _ in range(rnd.randrange(total + 1))] for _ in range(4)]
        pages = [html.Page(f"<div>{' '.join(s)}</div>") for s in streams]
        for sparse in (1, 4):
            windows = [html.Windows(p, "h", 3, 4, sparse) for p in pages]
            owners = {}
            for i, w in enumerate(windows):
                for k in w.all().tolist():
                    owners.setdefault(k, set()).add(i)
            repeated = np.array(sorted(k for k, o in owners.items() if len(o) > 1), np.int64)
            got = [w.decide(p, repeated, 3)[2] for w, p in zip(windows, pages, strict=True)]
            full, long = ([sum(m) for m in brute_cover(streams, range(4), n)] for n in (3, 3 + sparse - 1))
            assert all(b - 2 * (sparse - 1) * max(1, len(s) // 6) <= g <= a for g, a, b, s in zip(got, full, long, streams, strict=True))
            assert sparse > 1 or got == full


def test_boilerplate_of_pages_without_markup(spark):
    notice = "this very long notice stands on every page of the site in full"
    rows = [(i, f"http://h.org/{i}", f"<body><div>{notice}</div><div>page {i} tells a story of its own number {i * 7} and no other page does</div></body>", "t", "clash") for i in range(5)]
    rows += [(9, "http://other.org/", f"<body><div>{notice}</div></body>", "t", "c"), (10, None, None, None, None), (11, "http://h.org/e", "", None, None), rows[0], (12, "http://x.org/", "<p>unclosed <b>bold", "t", "c"), (13, "http://x.org/", "a < b & c &amp", "t", "c")]
    rows += [(14, "http://gone.example/x", "<p>Not Found</p>", "t", "c")]
    got = {}
    for r in html.extracted(spark.createDataFrame(rows, PAGE)).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[3] == ["page 3 tells a story of its own number 21 and no other page does"] and len(got[0]) == 2
    assert got[9] == [notice] and got[10] == [""] and got[11] == [""] and got[12] == ["unclosed bold"] and got[13] == ["a < b & c &"] and got[14] == ["Not Found"]
    assert html.extracted(spark.createDataFrame([], PAGE)).count() == 0


def test_passages_shared_by_articles_stay(spark):
    shared = "a passage of more than eight words that several articles of one host all have"
    rows = [(i, "http://h.org/", f"<article><h1>n{i}</h1><p>{shared}</p></article>", None, None) for i in range(4)]
    assert {r["text"] for r in html.extracted(spark.createDataFrame(rows, PAGE)).collect()} == {f"n{i}\n{shared}" for i in range(4)}


def test_partitions_and_broadcast_bound_change_nothing(spark):
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    shared = [" ".join(word() for _ in range(20)) for _ in range(12)]
    kinds = ("<div>{}</div>", "<div class='promo'>{}</div>", "<p class='related'>{}</p>")
    rows = [(i, f"http://h{i % 7 // 6}.x/{i}", f"<div>{shared[i % 12]}</div>{rnd.choice(kinds).format(' '.join(word() for _ in range(30)))}{rnd.choice(kinds).format(word())}") for i in range(60)]
    rows += [rows[5], (61, "http://h0.x/a", None), (None, "http://h0.x/b", rows[7][2]), (None, "http://h9.x/b", rows[7][2]), (62, "http://h0.x/c", ""), (63, "http://h0.x/d", f"<div>{shared[0]} {shared[0]}</div>")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = brute_texts(rows)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for n, aqe, hot in ((1, "true", 50_000), (4, "false", 3), (40, "true", 3), (200, "false", 50_000)):
            spark.conf.set("spark.sql.adaptive.enabled", aqe)
            assert texts_of(frame.repartition(n), sparse=1, hot=hot) == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    whole = texts_of(frame)
    assert whole == texts_of(frame.repartition(13), hot=2)
    assert html.extracted(frame).where("n_covered > 0").count() > 50
