"""Pages of another hand than the generator's, an independent decoder, and pages of megabytes."""

import itertools
import random
import time

import numpy as np
import pytest

from lexmill.llm import html

NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li><li><a href="/c">Contact</a></li></ul></nav>'
FOOT = "<footer><p>&copy; 2024 Example Ltd. All rights reserved.</p></footer>"
PARA = "The committee met on Tuesday to discuss the proposal, and most members agreed that it should go forward. A second reading is planned for the spring."
P = f"<p>{PARA}</p>"
TABLE = "<table><tr><th>Name</th><th>Votes</th></tr><tr><td>Smith</td><td>120</td></tr><tr><td>Jones</td><td>99</td></tr></table>"
PAGES = {
    "table": (f"<html><body>{NAV}<article><h1>Results</h1>{P}{TABLE}{P}</article>{FOOT}</body></html>", ["Results", PARA, "Name", "Votes", "Smith", "120", "Jones", "99", PARA]),
    "code": (f"<html><body>{NAV}<article><h1>How to</h1>{P}<pre><code>for i in range(10):\n    print(i)</code></pre>{P}</article>{FOOT}</body></html>", ["How to", PARA, "for i in range(10): print(i)", PARA]),
    "figure": (f"<html><body>{NAV}<article><h1>A hall</h1>{P}<figure><img src=x><figcaption>The hall in 1920.</figcaption></figure>{P}</article>{FOOT}</body></html>", ["A hall", PARA, "The hall in 1920.", PARA]),
    "terms": (f"<html><body>{NAV}<main><h1>Terms</h1>{P}<dl><dt>Bill</dt><dd>A draft of a law.</dd></dl>{P}</main>{FOOT}</body></html>", ["Terms", PARA, "Bill", "A draft of a law.", PARA]),
    "divs": (f'<div class="nav"><a href=/a>Home</a> <a href=/b>News</a></div><div class="content"><h1>Places</h1>{P}{P}<table><tbody><tr><td>Area</td><td>20 km</td></tr></tbody></table></div><div class="footer">Copyright 2020</div>', ["Places", PARA, PARA, "Area", "20 km"]),
}


@pytest.fixture(scope="module")
def model():
    return html.fitted()


def shown(model, source):
    page = html.Page(source)
    return html.main_text(page, model.odds(html.describe([page])[0]))


@pytest.mark.parametrize("name", sorted(PAGES))
def test_tables_code_figures_and_terms_stay(model, name):
    source, want = PAGES[name]
    assert shown(model, source).split("\n") == want


def test_held_out_pages_of_the_generator(model):
    rng, good, all_, bad = np.random.default_rng(99), 0, 0, 0
    for _ in range(150):
        page = html.Page(html.written_page(rng))
        text = html.main_text(page, model.odds(html.describe([page])[0]))
        all_ += sum(c.isupper() for t in page.text if t for c in t[1])
        good, bad = good + sum(c.isupper() for c in text), bad + sum(c.islower() for c in text)
    assert good > 0.98 * all_ and bad < 0.02 * good


def test_decoding_is_the_best_of_all_closed_sets():
    rnd = random.Random(3)
    for _ in range(60):
        source, depth = "", 0
        for _ in range(rnd.randrange(2, 9)):
            if depth and rnd.random() < 0.4:
                source, depth = source + "</div>", depth - 1
            else:
                source, depth = source + "<div>" + rnd.choice(["", "w" * rnd.randrange(1, 9)]), depth + 1
        page = html.Page(source)
        n = len(page.tag)
        odds = np.array([rnd.uniform(-1, 1) for _ in range(n)])
        gain = odds * np.log1p(page.own)
        best, kept = 0.0, ()
        for size in range(1, n + 1):
            for some in itertools.combinations(range(n), size):
                if all(k == 0 or page.parent[k] in some for k in some) and (value := sum(gain[list(some)])) > best + 1e-12:
                    best, kept = value, some
        want = [t[1] for t in page.text if t and t[0] in kept and not t[1].isspace()]
        assert html.main_text(page, odds).split("\n") == (want or [""])


def test_open_elements_close_in_linear_time():
    for open_, close in (("<div>", "</div>"), ("<x-y>", "</x-y>"), ("<p><b>", "</b>"), ("<ul><li>", "")):
        start = time.time()
        page = html.Page(open_ * 100_000 + "text" + close * 100_000)
        assert time.time() - start < 6 and page.text and max(page.end) <= len(page.tag), open_


def test_a_page_of_megabytes_and_repeated_ids(spark):
    big = f"<html><body>{NAV}<article><h1>Long</h1>{P * 20_000}</article>{FOOT}</body></html>"
    df = spark.createDataFrame([(1, "u", big), (1, "u", big), (1, "u", None), (2, "u", "")], "page_id long, url string, html string")
    rows = html.extract(df).collect()
    assert sorted((r.page_id, r.n_chars) for r in rows) == [(1, 0), (1, len("Long") + 20_000 * (len(PARA) + 1)), (1, len("Long") + 20_000 * (len(PARA) + 1)), (2, 0)]
