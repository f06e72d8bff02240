"""Operators over pages: archives and their index, and the extraction of articles."""

import base64
import glob
import gzip
import hashlib
import random
import time

import numpy as np
import pytest

from shelfspark.llm import extraction, warc


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://www.Site{i % 7}.example.org:80/p{i % 50}?q=ü x#top", f"<p>page {i % 90}</p>") for i in range(300)]
    rows += [(1000 + i, None, None) for i in range(5)] + [(None, "ftp://Q.org", "<p>page 3</p>"), (2**60 + 1, "x", "big"), (7, rows[7][1], rows[7][2])]
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, start int, url_key string")


def test_archives_and_index(spark, pages):
    archives, index = warc.archive_and_index(pages)
    first = {}
    rows = pages.collect()
    for r in rows:
        if r.page_id is not None:
            first[r.html or ""] = min(first.get(r.html or "", r.page_id), r.page_id)

    def expected(r):
        data, least = (r.html or "").encode(), first[r.html or ""]
        known = (str(r.page_id), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        return (*known, "response", None) if r.page_id == least else (*known, "revisit", least)

    got = warc.read_index(spark, index)
    key = lambda x: tuple(map(str, x))
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=key) == sorted(
        map(expected, rows), key=key)
    files = glob.glob(archives.replace("file://", "").replace("file:", "") + "/*.txt")
    assert sum(gzip.open(f).read().count(b"WARC/1.1\r\n") for f in files) == len(rows)  # plain members
    keys = [r.url_key for r in got.select("url_key").distinct().collect()]
    assert "org,example,site0,www:80)/p0?q=ü%20x" in keys and "" in keys
    urls = spark.createDataFrame([("http://www.site3.example.org:80/p3?q=ü x",), ("nope://nowhere",), (None,)], "url string")
    hits = warc.look_up(spark, index, urls)
    assert {r.url_key for r in hits.collect()} == {"org,example,site3,www:80)/p3?q=ü%20x", ""}
    for r in warc.fetch(spark, hits, archives).collect():
        html = next(x.html or "" for x in rows if x.page_id == r.page_id)
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html.encode()
    small = warc.build_index(warc.read_archives(spark, archives), index + "-small", block_rows=7)
    assert warc.look_up(spark, small, urls).count() == hits.count()


def test_least_size_and_empty_table(spark, pages):
    archives = warc.write_archives(pages, warc.new_path(spark, "least"), least=6)
    small = [r.record_type for r in warc.read_archives(spark, archives).collect() if r.payload_bytes < 6]
    assert set(small) == {"response"}
    _, index = warc.archive_and_index(pages.limit(0))
    assert warc.read_index(spark, index).count() == 0 and warc.look_up(spark, index, pages.select("url")).count() == 0


def test_damaged_archive_fails():
    content = gzip.compress(b"WARC/1.1\r\nX: 1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    assert warc.parse_record(next(warc._members(content))[2])["x"] == "1"
    with pytest.raises(ValueError, match="ends inside"):
        list(warc._members(content[:-9]))


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu one</a></li><li><a href=b>Menu two</a></li></ul></nav><div class="ad">Buy this now.</div>
<article><h1>Title &amp; more</h1><p><b>Lead text, with <i>some</i> words&#33;<br>next   line.<p>Second &lt;block&gt; of the article.</p></article>
<div class="comments"><div class="comment"><p>I liked it a lot, thanks.</p></div></div><footer>&copy; site</footer>"""


def test_extraction(spark):
    table = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (1, "u", PAGE), (None, "u", PAGE.replace("article>", "main>"))]
    pages = spark.createDataFrame([(*r, "z") for r in table], "page_id long, url string, html string, text string")
    model = extraction.trained(pages)
    got = extraction.extract(pages, model).collect()
    want = "Title & more Lead text, with some words! next line. Second <block> of the article."
    assert sorted((str(r.page_id), r.text) for r in got) == [("1", want), ("1", want), ("2", ""), ("3", ""), ("None", want)]
    assert extraction.extract(pages.limit(0), extraction.trained(pages.limit(0))).count() == 0


def test_an_unclosed_tag_hides_no_article():
    text = lambda page: [b.text for b in extraction.blocks(page)]
    for tag in ("svg", "select", "template", "noscript", "object", "math"):
        assert text(f"<p>before</p><{tag} id=x><article><p>one</p><p>two</p></article>") == ["before", "one", "two"]
        assert text(f"<div><{tag}></div><p>one</p><{tag}>gone</{tag}><p>two</p>") == (
            ["one", "two"] if tag in extraction.SKIPPED else ["one", "gone", "two"])
    for tag in extraction.SKIPPED:
        assert text(f"<p>one</p><{tag}>a<{tag}>b</{tag}>c</{tag} ><!-- <{tag}> --><script>'<{tag}>'</script><{tag}/><p>two</p>") == ["one", "two"]
    for tag in extraction.RAW:
        assert text(f"<p>one</p><{tag}>gone</{tag} x><p>two</p><{tag}><p>gone</p>") == ["one", "two"]
    assert text("<article><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, <object data=f>a plot</object> shows it.</p></article>") == [
        "If x=2, a plot shows it."]


def test_field_on_layouts_it_has_not_seen():
    model = extraction.train(extraction.layout_pages(160))
    right = every = 0
    for features, labels in extraction.layout_pages(60, seed=99):
        got = model.decode([extraction.Block("", frozenset(), "", frozenset(), 0.0, f) for f in features])
        right += sum(int(a) == b for a, b in zip(got, labels))
        every += len(labels)
    assert right > 0.95 * every


def test_viterbi_finds_the_best_labels():
    import itertools

    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(1, 8))
        weights = {f"f{i}": float(rng.normal()) for i in range(n)}
        model = extraction.Field(weights, rng.normal(size=(2, 2)))
        found = [extraction.Block("", frozenset(), "", frozenset(), 0.0, [f"f{i}"]) for i in range(n)]

        def score(y):
            return sum(weights[f"f{i}"] for i in range(n) if y[i]) + sum(model.pairs[a, b] for a, b in zip(y, y[1:]))

        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert abs(score([int(x) for x in model.decode(found)]) - score(best)) < 1e-9
        p1, expected = extraction._marginals(np.array([weights[f"f{i}"] for i in range(n)]), model.pairs)
        total = sum(np.exp(score(y)) for y in itertools.product((0, 1), repeat=n))
        for i in range(n):
            assert abs(p1[i] - sum(np.exp(score(y)) for y in itertools.product((0, 1), repeat=n) if y[i]) / total) < 1e-9


def test_ends_of_tags():
    rng = random.Random(3)
    for _ in range(300):
        page = "".join(rng.choice("ab >\"'<") for _ in range(rng.randint(0, 40)))
        ends = extraction._TagEnds(page)
        for at in range(len(page) + 1):
            i, quote = at, ""
            while i < len(page) and (quote or page[i] != ">"):
                if page[i] == quote:
                    quote = ""
                elif not quote and page[i] in "\"'":
                    quote = page[i]
                i += 1
            assert ends.of(at) == (i if i < len(page) else -1)


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<div class=c><p>x", "<b>", "<!x", "<script ", "</div", "<svg><p>x", "<x1>y", "<script>a</script b ",
                                  "<i><div><b><b></i>", "<!--", "<li><b>x</li "])
def test_malformed_pages_take_linear_time(unit):
    model = extraction.Field({"in:p": 1.0, "name:c": 1.0}, np.zeros((2, 2)))

    def seconds(size):
        start = time.process_time()
        model.text(unit * (size // len(unit)), model.known())
        return time.process_time() - start

    assert seconds(1_600_000) < 16 * max(0.1, seconds(400_000))  # four times the page; quadratic work would be sixteen times


def test_blocks_know_their_ancestors():
    page = "<body><div class='post main'><p id=x>one <b>two</b><p>three</div><aside><ul><li>four<li><i>five</aside>six</body>"
    found = extraction.blocks(page)
    assert [b.text for b in found] == ["one two", "three", "four", "five", "six"]
    assert [b.parent for b in found] == ["p", "p", "li", "li", "body"]
    assert found[0].tags == {"body", "div", "p"} and found[0].names == {"post", "main", "x"} and found[4].tags == {"body"}
    few = extraction.blocks(page, (frozenset(["p"]), frozenset(["main"])))
    assert [b.text for b in few] == [b.text for b in found] and few[0].tags == {"p"} and few[0].names == {"main"} and few[4].names == set()
