import math
import random
import statistics
from xml.etree import ElementTree

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from deltascape.llm import html_text
from deltascape.llm.html_text import extract, main_text

BODY = "<p>First sentence, of some length. And a second one, longer still!</p><p>Another paragraph; it has text, too.</p>"
TEXT = "First sentence, of some length. And a second one, longer still!\n\nAnother paragraph; it has text, too."
AROUND = [
    "<nav><a href=/>Home</a> <a href=/b>About us</a></nav>", "<header><h2>Site name</h2></header>", "<footer>&copy; Someone. All rights reserved.</footer>", "<aside>Related: one, two, three.</aside>",
    "<div class='ad'>Buy this now, it is cheap. Really!</div>", "<div id=cookie-notice>We use cookies, as all do. Accept?</div>", "<form>Name: <input><button>Send it.</button></form>", "<script>var a = '<p>No text, here.</p>';</script>",
    "<style>p{margin:0}</style>", "<section class='comments'><p>I liked this, a lot. Thanks!</p></section>", "<div role=navigation><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div>", "<!-- <p>a comment, hidden.</p> -->",
]


@pytest.mark.parametrize("extra", AROUND)
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div id=content>{}</div>"])
def test_text_without_what_is_around(extra, wrap):
    page = f"<html><head><title>T</title></head><body>{extra}{wrap.format(BODY)}{extra}</body></html>"
    assert main_text(page) == TEXT


@pytest.mark.parametrize("extra", AROUND)
def test_inside_an_article(extra):
    assert main_text(f"<body><article>{extra}{BODY}{extra}</article></body>") == TEXT


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>a &amp; b &lt;c&gt; &eacute; &#x41;</p></article>", "a & b <c> é A"),
        ("<article><p>  one\n two\t<b>three</b><br>four </p></article>", "one two three four"),
        ("<article><p>one<p>two<ul><li>three<li>four</ul>five</article>", "one\n\ntwo\n\nthree\n\nfour\n\nfive"),
        ("<article><p><b>open. <br><p>next, one.</article>", "open.\n\nnext, one."),
        ("<article><p>cut off, in the mid", "cut off, in the mid"),
        ("<article><p>cut off, <a hre", "cut off,"),
        ("<article>1 < 2, and 3 > 2.</article>", "1 < 2, and 3 > 2."),
        ("<article><h1>Title</h1><p>Text, here.</p></article>", "Title\n\nText, here."),
        ("<article><table><tr><td>a<td>b</table></article>", "a\n\nb"),
        ("", ""),
        (None, ""),
        ("<nav>Only a menu.</nav>", ""),
        ("just words, without any markup.", "just words, without any markup."),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


ODD_ITEMS = "<ul><li>Share<li>Print<li>Mail</ul>"


def test_ratios_decide_in_an_article(monkeypatch):
    """A list of bare labels without class or links goes by its ratios alone, and stays where these are switched off."""
    page = f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1>{ODD_ITEMS}{BODY * 3}</article></body>"
    assert main_text(page) == "Title\n\n" + "\n\n".join([TEXT] * 3)
    monkeypatch.setattr(html_text, "path_ratios", lambda runs: np.full(len(runs), 10.0))
    assert "Share" in main_text(page)


def test_ratios_decide_beside_an_article(monkeypatch):
    """Much text in an element without a name of its own is content also where another element is an article."""
    page = f"<body><article><p>A teaser, and no more.</p></article><div>{BODY * 3}</div><div>Imprint</div></body>"
    assert main_text(page) == "A teaser, and no more.\n\n" + "\n\n".join([TEXT] * 3)
    monkeypatch.setattr(html_text, "path_ratios", lambda runs: np.full(len(runs), 2.0))
    assert "First sentence" not in main_text(page)


def second_implementation(page):
    """The method on well-formed pages without links, by another parser, path by path."""
    found = []  # path, apart, article, heading, text

    def walk(e, path, apart, article):
        path, apart = (*path, e.tag), apart or e.tag in ("nav", "footer", "aside", "form") or e.get("class") in ("ad", "comments")
        article = article or e.tag == "article"
        if e.text and e.text.strip():
            found.append((path, apart, article, e.tag in ("h1", "h2"), " ".join(e.text.split())))
        for child in e:
            walk(child, path, apart, article)

    walk(ElementTree.fromstring(page), (), False, False)
    ratios = []
    for path, apart, *_ in found:
        own = [t for p, a, *_, t in found if (p, a) == (path, apart)]
        ratios.append([math.log2(1 + sum(map(len, own)) / len(own)), math.log2(1 + sum(c in ".,;:!?" for t in own for c in t) / len(own))])
    value = []
    for i, (_, apart, article, *_) in enumerate(found):
        before, after = ratios[max(i - 1, 0)], ratios[min(i + 1, len(found) - 1)]
        length, marks = (0.25 * before[k] + 0.5 * ratios[i][k] + 0.25 * after[k] for k in (0, 1))
        factor = 1 / 12 if apart else 2 if article else 0.5 if any(r and not a for _, a, r, *_ in found) else 1
        value.append(length * (1 + marks) * factor)
    for i in reversed(range(len(found))):
        j = i + 1
        while found[i][3] and j < len(found) and found[j][1:3] == found[i][1:3]:
            value[i] = max(value[i], value[j])
            if found[j][3]:
                break
            j += 1
    bound = min(8.0, max(1.5, 0.5 * statistics.pstdev(value)))
    mean = lambda key: statistics.mean(v for f, v in zip(found, value, strict=True) if f[:2] == key)
    return "\n\n".join(f[4] for f in found if mean(f[:2]) >= bound)


def test_second_implementation():
    rng = random.Random(4)
    words = "a of the house; river, stone. green? moves runs 1920 market".split()
    text = lambda most: " ".join(rng.choice(words) for _ in range(rng.randint(1, most)))

    def made(depth, tags):
        return "".join(f"<{t}{rng.choice(['', '', ' class=%sad%s' % (chr(34), chr(34))])}>{text(30)}{made(depth - 1, tags) if depth and t in ('div', 'section') else ''}</{t}>" for t in rng.choices(tags, k=rng.randint(1, 5)))

    changed = 0
    for _ in range(300):
        inner = made(2, ["h2", "pre", "div", "section", "pre"])
        middle = f"<article><h1>{text(6)}</h1>{inner}</article>" if rng.random() < 0.7 else inner
        page = f"<html><body><nav>{text(4)}</nav>{middle}<footer>{text(12)}</footer><div>{text(3)}</div></body></html>"
        assert main_text(page) == second_implementation(page)
        changed += main_text(page) != "\n\n".join(r.text for r in html_text.blocks(page) if not r.apart)
    assert changed > 20


def test_nothing_is_cut():
    long = "word, " * 50000
    assert main_text(f"<article><p>{long}</p></article>") == long.strip()


@given(st.text(alphabet="<>/abp \"'=&;!-", max_size=300))
def test_any_markup_ends(page):
    assert isinstance(main_text(page), str)


def test_table(spark):
    rows = [(1, "u", f"<article>{BODY}</article>", "x"), (2, None, None, "x"), (None, "v", "", "x"), (1, "u", f"<article>{BODY}</article>", "x")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", len(TEXT)), ("1", len(TEXT)), ("2", 0), ("None", 0)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
