"""HTML extraction on malformed, long and hand-labelled pages, and its labeller against plain loops."""

import math
import time

import numpy as np
import pytest

from lodegraph.llm import html_extract as H


@pytest.fixture(scope="module")
def weights():
    return H.train(pages=300, epochs=10)


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ('<p>a</p><svg class="i"/><p>b</p>', ["a", "b"]),
        ("<p>a<iframe src=x><p>b", ["a", "b"]),
        ("<p>a</p><noscript><p>n</p></noscript><template>t<p>b", ["a", "t", "b"]),
        ("<p title=it's>hello", ["hello"]),
        ('<a href="x>hello</a>', ["hello"]),
        ('<p data-x="a>b" title=\'c>d\'>e</p>', ["e"]),
        ("a < b <3 c", ["a < b <3 c"]),
        ("<p>x<script>if (a</b) '</p>'</script >y</p><style>p", ["xy"]),
        ("<!doctype html><?xml?><!-- a > b --><p>c</p><!-- d", ["c"]),
        ("<p>cut <a hre", ["cut"]),
        ("<P>A&nbsp;B&#33;&amp;lt;</P>", ["A B!&lt;"]),
    ],
)
def test_blocks_of_odd_markup(page, texts):
    assert [t for _, t in H.blocks(page)] == texts


@pytest.mark.parametrize("piece", ["<a x ", '<a b="x>', "<a b='", "<div>", "<div>x", "<svg>", "<!-- ", "</script x", "<iframe x </iframe ", "</", "<a =", "<p>x<table>", "class=<i class=", "<li>y"])
def test_a_malformed_megabyte_is_read_in_one_pass(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    H.blocks(page)
    assert time.process_time() - began < 4


def test_deep_nesting_keeps_text_and_what_follows():
    page = "<div class=top>" + "<div>" * 2000 + "deep" + "</div>" * 2000 + "<p>after</p></div><p>out</p>"
    got = H.blocks(page)
    assert [t for _, t in got] == ["deep", "after", "out"]
    assert got[1][0] == ("div", ".top", "p") and got[2][0] == ("p",)


def test_every_word_of_a_block_counts():
    path, words = ("p",), ["w"] * 200
    one, other = H.vectors([(path, " ".join([*words, "x"]))]), H.vectors([(path, " ".join([*words, "y"]))])
    assert (one != other).any()


def test_labeller_against_plain_loops(weights):
    rng = np.random.default_rng(4)
    page = [(p, t.removeprefix(H.MARK) or " ") for p, t in H.blocks(H.layout(rng))][:12]
    x = H.vectors(page).astype(float)
    hidden = H.HIDDEN
    sig = lambda v: 1 / (1 + math.exp(-v))
    states = {}
    for way, steps in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        h, c = [0.0] * hidden, [0.0] * hidden
        for t in steps:
            z = [sum(x[t][i] * float(weights[f"x{way}"][i, j]) for i in range(H.INPUT)) + sum(h[i] * float(weights[f"h{way}"][i, j]) for i in range(hidden)) + float(weights[f"b{way}"][j]) for j in range(4 * hidden)]
            c = [sig(z[hidden + k]) * c[k] + sig(z[k]) * math.tanh(z[3 * hidden + k]) for k in range(hidden)]
            h = [sig(z[2 * hidden + k]) * math.tanh(c[k]) for k in range(hidden)]
            states[way, t] = h
    slow = [sig(sum(v * float(o) for v, o in zip(states["f", t] + states["b", t], weights["o"])) + float(weights["c"][0])) for t in range(len(x))]
    got = H.probabilities(weights, H.vectors(page)[:, None, :], np.ones((len(page), 1), np.float32))[:, 0]
    assert np.abs(got - slow).max() < 1e-4


def test_pages_together_and_alone_have_equal_labels(weights):
    rng = np.random.default_rng(6)
    pages = [[(p, t.removeprefix(H.MARK) or " ") for p, t in H.blocks(H.layout(rng))] for _ in range(60)] + [[]]
    together = H.label(weights, pages)
    assert all((H.label(weights, [p])[0] == k).all() for p, k in zip(pages, together))


#: Pages written by hand; lines of main text begin with "+".
HAND = [
    """<html><body><div id="top"><a href=/>Daily Heron</a></div><ul id="nav"><li><a href=/n>News</a><li><a href=/s>Sport</a></ul>
    <div id="content"><h1>+River levels fall</h1><p>+After a dry spring the river stands lower than in any year since records began.
    <p>+Farmers said they would wait for rain.</div><div class="sidebar"><p>Most read</p><ul><li>Ten recipes for June</ul></div>
    <div id="footer">Copyright 2019 Daily Heron</div></body></html>""",
    """<body><nav><a href=1>Start</a> <a href=2>Blog</a></nav><main><article><header><h1>+On small tools</h1></header>
    <p>+A tool that does one thing is easy to describe, and what is easy to describe is easy to mend.</p><ul><li>+It starts fast.</li><li>+It stops cleanly.</li></ul>
    <pre>+run --once</pre><p>+That is all.</p></article></main><section id="comments"><p>Great post, thanks!</p><p>I agree with all of it.</p></section>
    <footer><p>Privacy</p></footer></body>""",
    """<body><div class="cookie-banner">We use cookies. <button>Accept</button></div><div class="header"><p>Town paper</p></div>
    <article class="post"><h2>+New bridge opens</h2><p>+The bridge was opened on Monday by the mayor, who crossed it twice.</p>
    <blockquote>+It took nine years.</blockquote></article><div class="ads"><p>Buy shoes now</p></div><form class="newsletter"><label>Your email</label></form></body>""",
]


def test_pages_labelled_by_hand(weights):
    right = total = 0
    for page in HAND:
        marked = H.blocks(page)
        kept = H.label(weights, [[(p, t.removeprefix("+")) for p, t in marked]])[0]
        right += sum(bool(k) == t.startswith("+") for k, (_, t) in zip(kept, marked))
        total += len(marked)
    assert total > 25 and right / total >= 0.9


def test_forms_and_controls_are_left_out_wherever_they_stand(weights):
    body = "<p>The first paragraph of the article says a good deal about it.</p>{}<p>The second paragraph goes on and ends the article.</p>"
    want = "The first paragraph of the article says a good deal about it.\nThe second paragraph goes on and ends the article."
    inside = [
        "<form><p>Enter your email to subscribe</p><select><option>One</option><option>Two</select><button>Go</button></form>",
        "<select><option>One<option>Two</select>",
        '<form class="x"><label>Your name</label><textarea>text here</textarea><p>Send it to us now.</p></form>',
    ]
    for form in inside:
        assert H.extract(weights, [f"<html><body><article>{body.format(form)}</article></body></html>"]) == [want]
    wrapped = f'<html><body><form action="/p.aspx"><article>{body.format("<button>Go</button>")}</article></form></body></html>'
    assert H.extract(weights, [wrapped]) == [want]
