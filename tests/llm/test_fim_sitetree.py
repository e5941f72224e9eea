"""Fill-in-middle against plain code; main texts of pages against their markup and against entropies from their definition."""

from __future__ import annotations

import hashlib
import html
import math
import re

from pyspark.sql import functions as F

from quarry.llm import fim, sitetree

UNIT = re.compile(fim.UNIT)


def plain_cut(doc_id, text, seed="42", percent=50, first=80):
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < first:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_cuts_and_texts_read_back(spark):
    texts = ["", None, " ", "one", " \t a  b\n", "x <P> y", "<S>", "<< P> <S > <M", "a<P", "P>b", "é日 本 x y", "w " * 60_000, "z" * 300_000, "line\r\nline\x0b\x0cend ", "q'\"\\ $1 \x00 \x1f"]
    rows = [(i * 7 + k, t, "x", 1) for k in range(12) for i, t in enumerate(texts)] + [(None, "a b c d", "y", 2), (3, "same words here", "y", 2), (3, "same words here", "y", 2), (-5, "m n o", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    for plan in (fim.Plan(), fim.Plan(100, 50, "it's")):
        got = fim.restored(fim.fill_in_middle(docs, plan).withColumn("restored", F.lit("old"))).collect()
        want = sorted(((i, *plain_cut(i, t or "", plan.seed, plan.cut_percent, plan.suffix_first_percent), t or "") for i, t, _, _ in rows), key=repr)
        assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in got), key=repr) == want
    digest = fim.fim_digest(docs).where("doc_id = -5").first()
    assert digest["output_sha256"] == hashlib.sha256(plain_cut(-5, "m n o")[4].encode()).hexdigest() and digest["restored_sha256"] == hashlib.sha256(b"m n o").hexdigest()
    assert fim.fim_digest(docs.limit(0)).count() == 0


def texts_of(markup):
    return [t for _, t, _ in sitetree.read(sitetree.parse(markup)).blocks]


def test_declared_noise_goes_and_the_article_stays():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="has-sidebar">
      <header><h1>Site</h1><nav><a href=/>home</a></nav></header><div class="cookie-notice">We use cookies</div>
      <div class="content with-comments"><article class="post"><header><h1>A &amp; B</h1></header><p>one <b>two</b>
      three&nbsp;four<br>five<p>unclosed <i>six<p>seven &lt;p&gt;</p><div class="ad-slot">Buy</div><ul><li>x<li>y</ul><aside>side</aside><form><label>mail</label><button>go</button></form>
      <figure><figcaption>Cap</figcaption></figure><table><tr><td>1<td>2<tr><td>3</table><span class="advert">ad</span> tail <!-- note --> end<script>1 < 2</script></article>
      <section class="comments"><article class="comment"><p>First!</p></article></section></div><aside class="sidebar">more</aside><footer>&copy; us</footer></body></html>"""
    assert texts_of(page) == ["A & B", "one two three four five", "unclosed six", "seven <p>", "x", "y", "Cap", "1 2", "3", "tail end"]
    assert texts_of("<main><p>a</p></main><p>b</p>") == ["a"]
    assert texts_of("<div role=navigation>m</div><div id=content><p>a</p></div><div>z</div>") == ["a"]
    assert texts_of("<p>plain</p><ul><li><a href=x>menu</a></li></ul><div class='site-footer'>f</div>") == ["plain"]
    assert texts_of("<div class='comments'><article><p>only text</p></article></div>") == ["only text"]
    assert texts_of("<article><p>kept &am") == ["kept &am"] and texts_of("<article><p>kept <foo") == ["kept"]
    assert texts_of("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>") == ["yes"]
    assert texts_of("") == [] and texts_of("just text") == ["just text"] and texts_of("<script>x") == [] and texts_of("a < b > c") == ["a < b > c"]
    assert texts_of("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == ["deep"]


def test_given_pages_against_their_markup(spark, testdata):
    pages = spark.read.parquet(str(testdata / "sf0.01" / "pages.parquet"))
    got = {r["page_id"]: r["text"] for r in sitetree.extract(pages).collect()}
    for r in pages.collect():
        inner = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|article)>", inner)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def site(host, n, vary=True):
    """Pages without declared parts: a template around an own text."""
    for i in range(n):
        own = f"Story {host} {i if vary else 0} " + " ".join(f"w{(i if vary else 0) * 31 + k}" for k in range(12))
        yield f"http://{host}/p{i}", f"<div class=a1><span>Welcome to {host}</span><p>Call us now</p></div><div class=b2><h2>Head {i}</h2><p>{own}</p><p>More of {i}</p></div><div class=c3><p>All rights</p><p>Reserved here</p></div>", own, i


def test_templates_of_a_host_go(spark):
    rows, want = [], {}
    for url, page, own, i in [*site("one.example", 8), *site("few.example", 2), *site("copies.example", 6, False)]:
        want[len(rows)] = f"Head {i}\n{own}\nMore of {i}"
        if "one" not in url:  # too few different pages to tell
            host = url.split("/")[2]
            want[len(rows)] = f"Welcome to {host}\nCall us now\n{want[len(rows)]}\nAll rights\nReserved here"
        rows.append((len(rows), url, page, "x", 0))
    for url, page in [(None, "<p>no host</p>"), ("not an address", "<p>odd</p>"), ("http://one.example/q", None), ("http://one.example/r", ""), (None, None)]:
        want[len(rows)] = {"<p>no host</p>": "no host", "<p>odd</p>": "odd"}.get(page, "")
        rows.append((len(rows), url, page, "x", 0))
    long = " ".join(f"v{k}" for k in range(40_000))
    want[len(rows)] = long
    rows += [(len(rows), "http://long.example/", f"<article><p>{long}</p></article>", "x", 0)]
    want[None] = want[0]
    rows += [(None, *rows[0][1:]), rows[0]]
    got = sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string, mark int")).collect()
    assert len(got) == len(rows)
    assert {r["page_id"]: r["text"] for r in got} == want
    assert sitetree.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_importance_from_its_definition(spark):
    pages = [(i, url, page) for i, (url, page, _, _) in enumerate(site("one.example", 5))]
    pages.append((9, "http://one.example/z", pages[0][2].replace("<p>Call us now</p>", "<ul><li>Call</ul>").replace("Story one.example 0", "Story one.example 99")))
    trees = sitetree.page_trees(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {r["path"]: r for r in sitetree.site_tree(trees).collect()}
    facts = [sitetree.page_tree(sitetree.parse(p)) for _, _, p in pages]
    for path in {p for t in facts for p in t}:
        held = [t[path] for t in facts if path in t]
        m = len(held)
        share = [sum(h[0] == o for h in held) / m for o in {h[0] for h in held}]
        presentation = 1.0 if m == 1 else -sum(x * math.log(x, m) for x in share)
        occur = [sum(x in h[2] for h in held) for h in held for x in h[2]]
        content = None if not occur else 1.0 if m == 1 else 1 - sum(math.log(n, m) for n in occur) / len(occur)
        weight = sitetree.DECAY ** (sum(h[1] for h in held) / m)
        r = got[path]
        assert r["pages"] == m and math.isclose(r["presentation"], presentation, abs_tol=1e-9)
        assert (content is None and r["content"] is None) or math.isclose(r["content"], content, abs_tol=1e-9)
        assert math.isclose(r["importance"], presentation if content is None else (1 - weight) * presentation + weight * content, abs_tol=1e-9)
