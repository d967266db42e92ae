"""Wrapper induction on made-up sites whose article text is known."""

import random
import time

import pytest

from lakeloom.llm import html


def best_matching(a, b):
    """Simple tree matching by plain recursion, without text weights."""
    if a.label != b.label:
        return 0
    m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + best_matching(x, y))
    return 1 + m[-1][-1]


def test_alignment_is_greatest():
    random.seed(3)

    def tree(depth):
        tag = random.choice(["div", "p", "ul"]) if depth else "p"
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(random.randrange(4)) if tag != "p") + f"</{tag}>"

    for _ in range(40):
        a, b = html.parse("<body>" + tree(3) + tree(2) + "</body>"), html.parse("<body>" + tree(3) + tree(2) + "</body>")
        pairs = html.align(a, b)
        assert len(pairs) == best_matching(a, b)
        assert len({y.index for y in pairs.values()}) == len(pairs)


def page(n, paragraphs, article="article", end="</article><footer>&copy; us</footer></body></html>"):
    body = "".join(f"<p>{x}</p>" for x in paragraphs)
    if article == "div":
        end = "</div><div>All content belongs to the owners.</div></body></html>"
    return (
        f"<!DOCTYPE html><html><head><title>t{n}</title><script>var t='</p>';</script><style>p{{}}</style></head><body><div>Welcome to our wonderful site</div><nav><ul><li><a href='/{n}'>m{n}</a><li>x</ul></nav><!-- ad {n} --><div class=\"ad\">buy {n}</div>"
        f"<{article}>{body}{end}"
    )


def test_extract(spark):
    random.seed(1)
    say = lambda: " ".join(random.choices("abc def ghi jkl".split(), k=random.randrange(3, 30)))
    rows, expected = [], {}
    for host, article in (("a.example", "article"), ("b.example", "div")):
        for _ in range(12):
            n = len(rows)
            words = [say() for _ in range(random.randrange(1, 9))]
            rows.append((n, f"https://{host}/x/{n}", page(n, words, article)))
            expected[n] = "\n\n".join(words)
    special = [
        (100, None, "<p>a &lt;b&gt; &amp;amp; &eacute;\n \t c<br>d <i>e</i>f<p>g", "a <b> &amp; é c d ef\n\ng"), (101, "nohost", None, ""), (102, "http://c.example", "", ""), (103, "http://c.example/?x=1", "plain > text < 5", "plain > text < 5"),
        (104, "https://d.example/", "<article><h1>T</h1><p><b>One.<br><p>Two</p><div class='comments'><p>no</p></div><form>f</form><p>Three", "T\n\nOne.\n\nTwo\n\nThree"),
        (105, "https://d.example/2", "<body><header>h</header><main><header><h1>in</h1></header>x<ul><li>1<li>2</ul>y<aside>no</aside></main><footer>f</footer>", "in\n\nx\n\n1\n\n2\n\ny"), (106, "https://a.example", "<div>" * 3000 + "deep", "deep"),
    ]
    rows += [s[:3] for s in special] + [rows[0], (None, "https://b.example/z", rows[13][2])]
    expected |= {s[0]: s[3] for s in special}
    df = spark.createDataFrame([(*r, "kept") for r in rows], "page_id long, url string, html string, host string")
    found = html.extract(df).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.text == (expected[r.page_id] if r.page_id is not None else expected[13]), r.page_id
        assert r.n_chars == len(r.text)


def test_empty(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_lists_are_aligned_exactly():
    notice = "<div>All content belongs to the owners.</div></body>"
    a, b = (html.parse("<body>" + "".join(f"<p>{k} {i}</p>" for i in range(n)) + notice) for k, n in (("a", 400), ("b", 500)))
    twins = html.align(a, b)
    assert len(twins) == 403 and next(twins[n.index].label for n in html.nodes(a) if n.tag == "div") == "div"
    random.seed(8)
    make = lambda n: "<body>" + "".join(f"<{t}>{'<p>x' * random.randrange(3)}</{t}>" for t in random.choices(["div", "ul", "dl", "section"], k=n)) + "</body>"
    for n, m in ((330, 340), (2, 60_000), (700, 200)):
        a, b = html.parse(make(n)), html.parse(make(m))
        pairs = html.align(a, b)
        weight, row = {}, [0] * (len(b.kids[0].kids) + 1)
        for x in a.kids[0].kids:
            above, row = row, [0]
            for j, y in enumerate(b.kids[0].kids):
                key = (x.label, y.label, len(x.kids), len(y.kids))
                w = weight.setdefault(key, 1.25 + 1.25 * min(len(x.kids), len(y.kids)) if x.label == y.label else 0)
                row.append(max(above[j + 1], row[-1], above[j] + w))
        assert sum(1.25 if y.text == x.text else 1 for x in html.nodes(a) if (y := pairs.get(x.index))) == row[-1] + 2.5
        assert len({y.index for y in pairs.values()}) == len(pairs)


def plain(source):
    return html.content(html.parse(source), {}, frozenset(), frozenset())


def test_names_that_only_contain_a_word_of_furniture():
    assert plain('<div id="main" class="layout has-sidebar"><p>Hello</p></div><div class="site-footer">foot</div>') == ["Hello"]
    assert plain('<article><section id="related-work"><p>A</p></section><div class="search-engine">B</div><div class="cookie-banner">C</div><div class="comments">D</div></article>') == ["A", "B"]


@pytest.mark.parametrize("piece", ['<a "', "<a '", "<a", "<![CDATA[", "<!", '<p a="x>', "<a b=\"c'>", "</p>", "<div>", "<div></section>"])
def test_broken_markup_takes_linear_time(piece):
    began = time.process_time()
    html.parse(piece * (400_000 // len(piece)))
    assert time.process_time() - began < 5


@pytest.mark.parametrize("pages", [2, 3, 8])
def test_constant_blocks_of_hosts_without_articles(spark, pages):
    """Unnamed notices and footers that all pages of a small host have are found by the wrapper alone."""
    rows = [(i, f"http://h{pages}.example/{i}", f"<body><div>All about us and our shop</div><div><p>Story {i} of its own</p><p>More {i * i} words</p></div><div>Printed on paper</div></body>") for i in range(pages)]
    rows += [(100, f"http://h{pages}.example/empty", "  "), (101, "http://alone.example/", "<div>Alone</div>")]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {**{i: f"Story {i} of its own\n\nMore {i * i} words" for i in range(pages)}, 100: "", 101: "Alone"}


def test_shuffled_wrappers(spark, monkeypatch):
    monkeypatch.setattr(html, "BROADCAST_BYTES", 0)
    rows = [(i, "http://a.example/", f"<div>Same on all pages</div><p>Text {i}</p>") for i in range(6)]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: f"Text {i}" for i in range(6)}
