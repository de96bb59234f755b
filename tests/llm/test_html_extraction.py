import html as h
import re
import time
from os.path import commonprefix

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from docloom.llm import html_extraction as he


def text(page):
    """The lines of main elements, or the plain ones where there is none."""
    lines = he.lines_of(page)
    return "\n\n".join(t for t, kind in lines if kind == max((k for _, k in lines if k), default=he.PLAIN))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b\n c&nbsp;d</p>", "a\n\nb c d"), ("<article><p>x<b>y</b>z<br>w</article>", "xyz w"),
        ("<nav>n</nav><header>h</header><article><h1>T</h1><p>t</p></article><footer>f</footer>", "T\n\nt"), ("<article>a<div class='ad'>b<div>c</div></div>d</article>", "a\n\nd"),
        ("<main><p>m</p><aside>s</aside><form>f</form></main><p>out</p>", "m"), ("<article><script>var a='</p>';</script><style>x</style><p>t</p><!-- <p>c</p> --></article>", "t"),
        ("<article><p>t</p><section id=comments><p>c</p></section><div class=\"cookie-notice\">n</div></article>", "t"), ("<article><p>a &lt;b&gt; &#233; &unknown;</p></article>", "a <b> é &unknown;"),
        ("<article><div class=ad>unclosed<p>x</article>", ""), ("<article><p>t</p><div class=sidebar>s</article><p>after</p>", "t"), ("<ARTICLE><P CLASS=x>Up</P></ARTICLE>", "Up"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<article><p title='a > b'>q</p></article>", "q"), ("<article>one</article><article class='comment'>two</article>", "one"),
        ("<article class='post has-sidebar'>t</article>", "t"), ("<div class='wrap with-sidebar'><p>s</p><article><p>t</p></article></div>", "t"), ("<form id=f><nav>n</nav><article>t</article></form>", "t"),
        ("<aside><article>teaser</article></aside><p>t</p>", "t"), ("<article><div class=entry-header><h1>T</h1><span>by</span></div><p>t</p></article>", "T\n\nt"),
        ("<article><header><h2>T</h2><p>by</p></header><p>t</p></article>", "T\n\nt"), ("<article><p>t</p><p hidden>h</p><div style='display: none'>h</div></article>", "t"),
        ("<div class=header>site</div><p>t</p>", "t"), ("<article><p title=\"broken>t</p></article>", "t"), ("<p>a</p>" + "<a" * 20_000, "a\n\n" + "<a" * 20_000),
    ],
)
def test_pages(page, want):
    assert text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><section id=discussion><p>d</p></section><h2 id=related-work>r</h2><p id=search-method>s</p><p data-id=share>i</p><div aria-label='the comments of x'>l</div></article>", "d\n\nr\n\ns\n\ni\n\nl"),
        ("<article><a title='the hidden cost of x'>t</a><i title='style=display:none'>u</i><b data-hidden=1>v</b></article>", "tuv"), ("<article><p class=notice>n</p><h2 class='related'>r</h2><div class='related-work'>w</div></article>", "n\n\nr\n\nw"),
        ("<article><div class='ad-slot'>a</div><p class=ad>b</p><div role=navigation>c</div><p style='color:red; DISPLAY : none !important'>d</p>t</article>", "t"),
        ("<article><p class=ad>x<p>real<p>more</article>", "real\n\nmore"), ("<article><ul><li class=ad>x<li>real</ul><p>t</article>", "real\n\nt"), ("<article><ul><li class=ad>x</ul><p>t</article>", "t"),
        ("<article><dl><dt class=ad>x<dd>d</dl><table><tr class=header><th>h<td class=ad>x<td>c</table>t</article>", "d\n\nh\n\nc\n\nt"), ("<article><ul><li class=ad>x<ul><li>y</ul>z<li>t</ul></article>", "t"),
        ("<main><p>lead</p><article><p>a</p></article><p>end</p></main><p>out</p>", "lead\n\na\n\nend"), ("<article>a<aside><article>teaser</article></aside>b</article>", "a\n\nb"),
        ("<div><article><aside>x</div>y</aside>z</article></div>", "z"), ("<section id=discussion><p>d</p></section><div id=sidebar>s</div>", "d"), ("<article><li><ul>" + "<div>" * 9_000 + "<li></li>" * 9_000 + "t</article>", "t"),
    ],
)
def test_article_text_stays(page, want):
    assert text(page) == want


def lcs(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25))
def test_shared_lines_are_a_longest_common_subsequence(a, b):
    places = he.shared_lines(np.array(a, np.int64), np.array(b, np.int64))
    assert len(places) == lcs(a, b) and places == sorted(set(places))
    rest = iter(b)
    assert all(a[p] in rest for p in places)
    halves = he.by_halves(a, b)
    rest = iter(b)
    assert len(halves) == lcs(a, b) and halves == sorted(set(halves)) and all(a[p] in rest for p in halves)


def test_lines_that_repeat_without_end_are_aligned_fast():
    rng = np.random.default_rng(1)
    a, b = (np.concatenate([[k], rng.integers(5, 8, 6_000), [k + 10]]) for k in (1, 2))
    began = time.time()
    assert len(he.shared_lines(a, b)) > 3_000 and len(he.shared_lines(np.full(9_000, 7), np.full(8_000, 7))) == 8_000
    assert time.time() - began < 20


def extract(spark, rows, parts=1):
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, text string, bucket int").repartition(parts)
    return {r["page_id"]: r["text"] for r in he.op10_html_extraction(pages).collect()}


@pytest.mark.parametrize("parts", [1, 4])
def test_template_lines_go_where_no_main_element_is_declared(spark, parts):
    rows = [(i, f"http://a.com/x/{i:03}", f"<div>Site name</div><p>Story {i}</p><p>more {i}</p><div>Imprint</div>") for i in range(60)]
    rows += [(100, "http://b.com/x/001", "<div>Site name</div><p>alone</p>"), (101, None, "<p>no url</p>"), (102, "http://c.com/1", "<article>same</article>"), (103, "http://c.com/2", "<article>same</article>"), (104, "http://c.com/3", None)]
    found = extract(spark, rows, parts)
    assert all(found[i] == f"Story {i}\n\nmore {i}" for i in range(60))
    assert (found[100], found[101], found[102], found[103], found[104]) == ("Site name\n\nalone", "no url", "same", "same", "")


@pytest.mark.parametrize("parts", [1, 4])
def test_copies_keep_their_article(spark, parts):
    def page(k, note=""):
        return f"<div>Site name</div><h1>Title {k}</h1>" + "".join(f"<p>Story {k} has its paragraph {n} of some length</p>" for n in range(5)) + f"<p>{note}</p><div>Imprint</div>"

    rows = [(0, "http://a.com/x", page(1)), (1, "http://a.com/x?print=1", page(1, "Print version"))]
    rows += [(2 + i, f"http://b.com/m/{i:04}", page(2, f"mirror {i}")) for i in range(700)] + [(702, "http://b.com/n", page(3)), (703, "http://b.com/a", page(4))]
    found = extract(spark, rows, parts)
    article = ["\n\n".join([f"Title {k}", *(f"Story {k} has its paragraph {n} of some length" for n in range(5))]) for k in range(5)]
    assert found[0] == f"Site name\n\n{article[1]}\n\nImprint" and found[1] == f"Site name\n\n{article[1]}\n\nPrint version\n\nImprint"
    assert all(found[2 + i] == f"{article[2]}\n\nmirror {i}" for i in range(700))
    assert (found[702], found[703]) == (article[3], article[4])


def test_a_teaser_beside_the_story_is_not_the_article(spark):
    story = "".join(f"<p>Paragraph {n} of the story is long enough to matter</p>" for n in range(4))
    other = "".join(f"<p>Another tale, part {n}, which has nothing in common with it</p>" for n in range(4))
    page = "<div>Site name</div><article>See also: a teaser</article><div id=content>{}</div><div>Imprint</div>"
    found = extract(spark, [(1, "http://a.com/1", page.format(story)), (2, "http://a.com/2", page.format(other)), (3, "http://b.com/1", page.format(story))])
    lines = [f"Paragraph {n} of the story is long enough to matter" for n in range(4)]
    assert found[1] == "\n\n".join(lines)
    assert found[3] == "\n\n".join(["Site name", "See also: a teaser", *lines, "Imprint"])
    nested = extract(spark, [(1, "u/1", "<main><p>intro</p><article>card</article><p>body</p></main>"), (2, "u/2", '<article><div class="social-science">kept</div>t</article>')])
    assert nested == {1: "intro\n\ncard\n\nbody", 2: "kept\n\nt"}


def test_equal_neighbours_go_to_the_page_before(spark):
    rows = [(1, "http://a.com/s/1", "<p>one</p><p>first and second</p><p>tail of it</p>"), (2, "http://a.com/s/2", "<p>own of two</p><p>first and second</p><p>second and third</p>"), (3, "http://a.com/s/3", "<p>three</p><p>second and third</p><p>end of it</p>")]
    assert extract(spark, rows)[2] == "own of two\n\nsecond and third"


def test_pairing_and_deletion_equal_brute_force(spark):
    """A generated site without main elements: every page against all pages of its host, lines by a table of all pairs."""
    rng = np.random.default_rng(5)
    template = [f"Site line {k}" for k in range(6)]
    rows = []
    for i in range(120):
        own = [f"story {i} line {n} {'x' * int(rng.integers(20, 60))}" for n in range(int(rng.integers(3, 7)))]
        shown = [line for line in template if rng.random() < 0.7]
        rows.append((i, f"http://h{i % 2}.com/{'abc'[int(rng.integers(3))]}/{'pqrs'[int(rng.integers(4))]}/{i}", shown[:3] + own + shown[3:]))

    def copies(a, b):
        shared = sum(map(len, set(a) & set(b)))
        return shared >= he.COPY_SHARE * (sum(map(len, set(a))) + sum(map(len, set(b))) - shared)

    def expected(page):
        key = he.url_key(page[1], page[0])
        others = sorted((he.url_key(u, i), lines) for i, u, lines in rows if u.split("/")[2] == page[1].split("/")[2] and i != page[0])
        sides = [[o for o in others if o[0] < key][::-1], [o for o in others if o[0] > key]]
        near = [found for side in sides if (found := next((o for o in side if not copies(o[1], page[2])), None))]
        if not near:
            return page[2]
        other = max(near, key=lambda o: len(commonprefix([o[0], key])))[1]
        return [line for line in page[2] if line not in other]

    found = extract(spark, [(i, u, "".join(f"<div>{line}</div>" for line in lines)) for i, u, lines in rows], 3)
    assert found == {page[0]: "\n\n".join(expected(page)) for page in rows}


def test_pages_of_many_lines_are_compared_by_a_sample():
    lines = [[f"{k} line {n}" for n in range(2_000)] for k in range(2)]
    a, b = (he.sketch_of(he.hashes_of([(t, False) for t in x]), [len(t) for t in x]) for x in lines)
    c = he.sketch_of(he.hashes_of([(t, False) for t in lines[0][:1_900]]), [len(t) for t in lines[0][:1_900]])
    assert he.are_copies(a, c) and not he.are_copies(a, b) and he.unpacked(he.packed(a)) == a and not he.are_copies({}, a)


def test_documents(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r["page_id"]: r for r in he.op10_html_extraction(pages).collect()}
    for row in pages.collect():
        body = re.search("<article>(.*)</article>", row["html"], re.S)[1].replace("<br>", " ")
        blocks = (" ".join(h.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body))
        want = "\n\n".join(b for b in blocks if b)
        assert (found[row["page_id"]]["text"], found[row["page_id"]]["n_chars"]) == (want, len(want))


def test_odd_tables(spark):
    assert extract(spark, []) == {}
    rows = [(None, None, None), (1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, "u", "<p>" + "long word " * 20_000 + "</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert he.op10_html_extraction(pages).count() == 4
