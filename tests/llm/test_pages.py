import random
from itertools import product

from pyspark.sql import functions as F

from siltstone.llm import html_extract, queries, warc

SCHEMA = "record_id long, url string, ts long, kind string, headers map<string,string>"


def slow_resolve(rows, canon):
    fixed, out = set(warc.FIXED), []
    for r in rows:
        if r[3] != "revisit":
            continue
        key = lambda x: (x[2] is not None, x[2] or 0, x[0])
        earlier = [x for x in rows if x[3] == "response" and canon[x[1]] is not None and canon[x[1]] == canon[r[1]] and key(x) < key(r)]
        if not earlier:
            out.append((r[0], "no_response", None, None))
            continue
        f = max(earlier, key=key)
        a, b = r[4] or {}, f[4] or {}
        status = "resolved_unverified"
        for name in ("etag", "last-modified"):
            if a.get(name) and b.get(name):
                status = "resolved" if a[name].removeprefix("W/") == b[name].removeprefix("W/") else "validator_mismatch"
                break
        ok = status.startswith("resolved")
        out.append((r[0], status, f[0] if ok else None, {**b, **{k: v for k, v in a.items() if k not in fixed}} if ok else None))
    return sorted(out, key=str)


def test_canonical_urls(spark):
    cases = {
        "HTTPS://www.Example.com:443/a/b/?utm_source=x&b=2&a=1#top": "example.com/a/b?a=1&b=2",
        "http://example.com": "example.com",
        "http://example.com/?ref=x": "example.com",
        "example.com/A": "example.com/A",
        "": "",
        None: None,
    }
    found = spark.createDataFrame([(u,) for u in cases], "u string").select("u", warc.canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in found} == cases


def test_resolution_against_brute_force(spark):
    r = random.Random(8)
    urls = ["http://hot.example/"] * 8 + [f"http://a.example/{i}" for i in range(10)] + [None]
    rows = []
    for i in range(500):
        kind = r.choice(["response", "revisit", "revisit"])
        headers = {"content-length": str(i), "date": str(i)}
        if r.random() < 0.6:
            headers["etag"] = r.choice(['"1"', 'W/"1"', '"2"'])
        if r.random() < 0.6:
            headers["last-modified"] = r.choice(["x", "y"])
        rows.append((i, r.choice(urls), r.choice([None, *range(60)]), kind, headers if r.random() < 0.9 else None))
    frame = spark.createDataFrame(rows, SCHEMA)
    canon = {u: (u and u.removeprefix("http://").rstrip("/")) for u in urls}
    found = [(x.record_id, x.status, x.response_id, x.headers) for x in warc.resolve(frame).collect()]
    assert sorted(((a, b, c, d and dict(sorted(d.items()))) for a, b, c, d in found), key=str) == sorted(((a, b, c, d and dict(sorted(d.items()))) for a, b, c, d in slow_resolve(rows, canon)), key=str)
    assert warc.resolve(frame.limit(0)).count() == 0


def test_repeated_and_mixed_case_headers(spark):
    rows = [(1, "u", 1, "response", {"ETag": "a", "X": "1", "x": "2"}), (2, "u", 2, "revisit", {"etag": "a", "X": "3"}), (2, "u", 2, "revisit", {"etag": "a", "X": "3"})]
    found = warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.status, r.headers) for r in found] == [("resolved", {"etag": "a", "x": "3"})] * 2


def test_minimum_cut_against_all_labellings():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 9)
        scores = [r.uniform(-2, 2) for _ in range(n)]
        edges = {(a, b): r.uniform(0, 1.5) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5}

        def cost(labels):
            unary = sum(-s if s < 0 and x else s if s > 0 and not x else 0 for s, x in zip(scores, labels, strict=True))
            return unary + sum(c for (a, b), c in edges.items() if labels[a] != labels[b])

        best = min(cost(x) for x in product((False, True), repeat=n))
        assert abs(cost(html_extract.minimum_cut(scores, edges)) - best) < 1e-9


def test_long_chain_of_undecided_blocks():
    n = 4000
    scores = [(-1) ** i * 0.3 + 0.01 * (i % 7) for i in range(n)]
    edges = {(i, i + 1): 0.9 for i in range(n - 1)}
    assert len(html_extract.minimum_cut(scores, edges)) == n


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if(a<b)"</p>"</script></head><body>
<header><a href=/>Site</a><p>A tagline of the site, which says what the site is about.</p></header>
<div class="menu"><ul><li><a href=x>Home</a><li><a href=y>About us</a></ul></div>
<div class='cookie-notice'>We use cookies to make your visit to this site better. By going on you agree.</div>
<div id=content><h1>Real &amp; title</h1><p>First paragraph of the main text, which is rather long and has several words.
<p>Second   paragraph&nbsp;is here<br>with a break. <a href=z>A link</a> inside.<!-- no --><div class="ad">Buy this product now. It is very good.</div><p>Third.</div>
<aside><p>The sidebar goes on and on with words, so that a classifier of words alone would keep it.</p></aside>
<form><label>Name</label><textarea>xx</textarea><button>Send</button></form>
<section class="comments"><h3>Comments</h3><p>I think this is a good article, with many words in it, and I would read it again.</p></section>
<footer>&copy; 2020 Site. All rights reserved.</footer>"""


def test_article_is_kept_and_the_rest_goes():
    want = ["Real & title", "First paragraph of the main text, which is rather long and has several words.", "Second paragraph is here with a break. A link inside.", "Third."]
    assert html_extract.main_text(PAGE) == ("\n".join(want), 4)


def test_words_of_class_and_id():
    text = "This is a paragraph, and it has some words in it, so that it could be content."
    kept = ["content", "entry-header", "main-content", "post", "article-body"]
    gone = ["sponsored-content", "content-sidebar", "adBox1 ad", "post-comments", "site-header", "newsletter signup", "related-articles", "article-footer", "cookie_banner"]
    for name in kept + gone:
        page = f'<body><div class="{name}"><p>{text}</p></div><div><p>Another paragraph that is here, for any page has some.</p></div></body>'
        assert (text in html_extract.main_text(page)[0]) == (name in kept), name
    assert html_extract.main_text(f'<article><header><h1>Title</h1></header><p>{text}</p><aside>{text} More.</aside></article>')[0] == f"Title\n{text}"
    assert html_extract.main_text(f'<p>{text}</p><ul><li><a href="x">One</a></li><li><a href="y">Two words</a></li></ul>')[0] == text


def test_odd_pages(spark):
    odd = [None, "", "   ", "<p", "<!-- open", "<script>never closed", "&lt;b&gt; just text, and a sentence with a few more words.", "<div>" * 5000 + "Deep text, with some words in it." + "</p>" * 5000, "<a href=\"x>y", "\x00", "<p>" * 20000]
    frame = spark.createDataFrame([(i, "u", h, "x") for i, h in enumerate(odd)] + [(None, None, None, None)] * 2, "page_id long, url string, html string, text string")
    rows = html_extract.extract(frame).collect()
    assert len(rows) == len(odd) + 2 and all(r.n_chars == len(r.text) for r in rows)
    by_id = {r.page_id: r.text for r in rows}
    assert by_id[0] == "" and by_id[6].startswith("<b> just") and by_id[7] == "Deep text, with some words in it."
    assert html_extract.extract(frame.limit(0)).count() == 0


def test_pages_table(spark, sf_dir):
    rows = {r.page_id: r.text for r in queries.op2_html_extract(spark, sf_dir).collect()}
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inside = p.html.split("<article>")[1].split("</article>")[0]
        assert rows[p.page_id].replace("\n", " ").split() == [w for w in inside.replace("<", " <").replace(">", "> ").split() if not w.startswith("<")] or "&" in inside
