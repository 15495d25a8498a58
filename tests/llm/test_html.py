import time

from latent.llm import html
from tests.llm.conftest import prose

PAGE = """<!DOCTYPE html><html lang="en"><head><title>{t}</title><style>p{{margin:0}}</style>
<script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">{n}</a></li><li><a href="/b">B</a></ul></nav><!-- ad {i} --><div class="ad">{n}</div>
<div id="wrap{i}"><article><h1>{t}</h1><p><b>{t} &amp; more<br><p>{a}</p><ul><li>one {i}<li>two</ul>
<p>{b}</p><aside>see also {n}</aside><form><input>Mail<button>Go</button></form>
<div class="comments"><p>nice {n}</p></div></article></div><div class="sidebar-left"><p>{n}</p></div>
<footer>&copy; {n}</footer></body></html>"""


def page(i):
    fill = {"t": f"Title &lt;{i}&gt;", "n": prose(i, 5), "i": i, "a": prose(50 + i, 40), "b": prose(90 + i, 30)}
    want = [f"Title <{i}>", f"Title <{i}> & more", fill["a"], f"one {i}", "two", fill["b"]]
    return PAGE.format(**fill), "\n".join(want)


SCHEMA = "html string, page_id long, url string, host string, wrapper string, text string"


def test_pages_of_hosts(spark):
    rows, want = [], {}
    for i in range(30):
        body, want[i] = page(i)
        rows.append((body, i, f"https://{'www.' * (i % 2)}Host{i % 3}.org:80/x?y#z", "h", "w", "t"))
    rows += [("", 100, "http://host1.org", "", "", ""), (None, 101, None, "", "", ""),
             ("plain &amp; text", 102, "odd", "", "", ""), (rows[2][0], None, None, "", "", ""), rows[4]]
    want |= {100: "", 101: "", 102: "plain & text", None: want[2]}
    got = html.main_texts(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    assert all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)
    assert html.main_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_wrapper_tells_template_from_content():
    """Unmarked boxes around the article: only the alignment of pages can tell them."""
    def body(i):
        return (f"<html><body><div><p>Follow us for more news every single day</p></div><div>"
                f"<section><p>{prose(i, 80)}</p><div><span>Printed on recycled paper</span></div>"
                f"<p>{prose(70 + i, 60)}</p></section></div><div><a href=x>{prose(i, 30)}</a></div>")
    wrapper = None
    for i in range(12):
        one = html.outline([html.parse(body(i))])
        wrapper = one if wrapper is None else html.merge(wrapper, one)
    assert html.Slot.load(wrapper.dump()).dump() == wrapper.dump()
    assert html.main_text(body(3), wrapper) == prose(3, 80) + "\n" + prose(73, 60)
    other = "<html><body><table><tr><td>" + prose(5, 50) + "<td>cell</table>"
    assert html.main_text(other, wrapper) == prose(5, 50) + "\ncell"


def test_template_on_most_pages_of_any_host():
    """A notice that one page lacks and another alters is template on all others; hosts of two
    pages have a template too."""
    notice = "Printed on recycled paper"

    def body(i, said):
        return (f"<html><body><section><p>{prose(i, 80)}</p>" + said * (i != 5)
                + f"<ul><li>{prose(70 + i, 60)}</ul></section>")
    for n in (2, 5, 40, 300):
        said = [f"<div>{'Other paper' if i == 7 else notice}</div>" for i in range(n)]
        bodies, wrapper = [body(i, said[i]) for i in range(n)], None
        for text in bodies:
            one = html.outline([html.parse(text)])
            wrapper = one if wrapper is None else html.merge(wrapper, one)
        for i in range(min(n, 30)):
            want = [prose(i, 80), *["Other paper"] * (i == 7), prose(70 + i, 60)]
            assert html.main_text(bodies[i], wrapper) == "\n".join(want), (n, i)


def test_hints_on_wrappers_of_the_article():
    """Boxes around a whole page named like parts beside an article, and a whole-page form."""
    inner = ("<{tag}><p>{a}</p><p>{b}</p></{tag}><div class='sidebar'><p>see {n}</p></div>"
             "<div class='comments'><article><p>{n}</p></article></div>")
    for box in ("div class='has-sidebar'", "div class='no-comments'", "form", "div id='share-enabled'",
                "section class='post-with-banner'"):
        for tag in ("article", "div"):
            wrapper, pages = None, []
            for i in range(10):
                fill = {"tag": tag, "a": prose(i, 40), "b": prose(60 + i, 30), "n": prose(i, 4)}
                pages.append(f"<html><body><{box}>{inner.format(**fill)}</{box.split()[0]}></body></html>")
                one = html.outline([html.parse(pages[-1])])
                wrapper = one if wrapper is None else html.merge(wrapper, one)
            for known in (wrapper, None):
                assert html.main_text(pages[3], known) == prose(3, 40) + "\n" + prose(63, 30), (box, tag)
    normal = f"<html><body><div><p>{prose(1, 30)}</p></div><div class='comments'><p>{prose(2, 20)}</p></div>"
    assert html.main_text(normal, None) == prose(1, 30)


def test_copies_keep_their_article():
    body, want = page(1)
    wrapper = html.outline([html.parse(body)])
    for _ in range(20):
        wrapper = html.merge(wrapper, html.outline([html.parse(body)]))
    assert html.main_text(body, wrapper) == want


def test_simple_tree_matching():
    s = lambda label, *kids: html.Slot(label, False, kids=list(kids))
    a = s("a", s("b", s("c"), s("d")), s("e"), s("b"))
    b = s("a", s("b"), s("b", s("c"), s("x"), s("d")), s("e"))
    assert html.agreement(a, b) == 5
    assert html.match(a.kids, b.kids) == [(0, 1), (1, 2)]
    assert html.agreement(a, s("z")) == 0 and html.agreement(a, a) == 6


def test_broken_markup():
    cases = {"<p>a<p>b</div></p>c": "a\nb\nc", "a &am": "a &am", "x < y <b": "x < y", "<p>a&nbsp;&#65;&eacute;": "a Aé",
             "<script>never closed <p>x": "", "<table><tr><td>1<td>2<tr><td>3</table>": "1\n2\n3",
             "<div title='a>b'>t</div>": "t", "<ul><li>a<ul><li>b</ul><li>c</ul>": "a\nb\nc"}
    for source, want in cases.items():
        assert html.main_text(source, None) == want, source


def test_deep_and_unclosed_pages_are_read_in_time(spark):
    deep = "<div>" * 20_000 + "<p>down here</p> and after" + "</div>" * 20_000 + "<p>outside</p>"
    buttons = "<article><p>start" + "<button>x" * 20_000 + "</article>"
    paragraphs = "<article>" + "<p>one two" * 20_000 + "</article>"
    rows = [(i, f"http://{h}.example/{i}", t) for h in ("a", "b") for i, t in enumerate(
        [deep, buttons, paragraphs, "<article><p>plain</article>"], 10 * (h == "b"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    began = time.time()
    got = {r.page_id: r.text for r in html.main_texts(pages).collect()}
    assert time.time() - began < 90 and len(got) == 8
    assert got[2].count("one two") == 20_000 and "start" in got[1] and got[3] == "plain"
    tree = html.parse(deep)
    found, level = [], [(tree, 0)]
    while level:
        node, depth = level.pop()
        assert depth <= html.DEEP + 1
        found += [p[0] for p in node.parts if not isinstance(p, html.Node)]
        level += [(c, depth + 1) for c in node.children()]
    assert "down here" in found and " and after" in found and "outside" in found
