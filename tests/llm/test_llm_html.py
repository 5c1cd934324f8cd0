from random import Random

import numpy as np
import pytest

from newsloom.llm import htmltext


@pytest.fixture(scope="module")
def model():
    return htmltext.trained()


def test_blocks():
    found = htmltext.blocks(
        "<title>T</title><div class='ad x'>one<p>two &amp; <b>three<br>four<p>five &lt;b&gt;</div>six<li>a<li>b<!-- no -->"
        "<script>var t='<p>no</p>'</script><style>p{}</style> tail")
    assert [t for _, t in found] == ["T", "one", "two & three four", "five <b>", "six", "a", "b tail"]
    assert "name:ad" in found[1][0] and "tag:p" in found[2][0] and "tag:div" not in found[4][0]


def test_gradients_are_those_of_the_loss():
    m, r = htmltext.Labeller(3), Random(1)
    pages, labels = [], []
    while len(pages) < 3:
        page, marks = htmltext.made_page(r)
        pages.append(htmltext.vectors(htmltext.blocks(page))[:9])
        labels.append(marks[:9])
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}

    def loss():
        p, mask, *_ = m.forward(*m.inputs(pages))
        y = np.zeros_like(p)
        for i, page in enumerate(labels):
            y[i, :len(page)] = page
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    grad = m.gradients(pages, labels)
    for name in ("fx", "fh", "bh", "bb", "out"):
        at = tuple(n // 2 for n in m.w[name].shape)
        kept = m.w[name][at]
        m.w[name][at] = kept + 1e-3
        up = loss()
        m.w[name][at] = kept - 1e-3
        down = loss()
        m.w[name][at] = kept
        assert abs((up - down) / 2e-3 - grad[name][at]) < 1e-4 + 0.02 * abs(grad[name][at])


def test_held_out_pages(model):
    r, wrong, total = Random(1234), 0, 0
    for _ in range(150):
        page, marks = htmltext.made_page(r)
        got = model.label([htmltext.vectors(htmltext.blocks(page))])[0]
        wrong += int((got != np.array(marks)).sum())
        total += len(marks)
    assert wrong < 0.02 * total


def test_labels_do_not_depend_on_the_batch(model):
    r = Random(5)
    pages = [htmltext.vectors(htmltext.blocks(htmltext.made_page(r)[0])) for _ in range(20)]
    together = model.label(pages)
    assert all((model.label([p])[0] == t).all() for p, t in zip(pages, together))


def test_odd_pages(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<p", "x"), (4, "u", "<div>" * 3000, "x"), (4, "u", "<div>" * 3000, "x"),
            (5, "u", "<html><body><nav><a>home</a></nav><article><h1>A&nbsp;b</h1><p>" + "word " * 50_000 + "</p></article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in htmltext.extract(pages).collect()}
    assert [got[i]["text"] for i in (1, 2, 4)] == ["", "", ""]
    assert got[5]["text"] == "A b\n\n" + " ".join(["word"] * 50_000) and got[5]["n_chars"] == len(got[5]["text"])
    assert htmltext.extract(pages.where("false")).collect() == []


def test_given_pages(spark):
    import re
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in htmltext.extract(pages).collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S).group(1)
        want = [" ".join(htmltext.html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", article)]
        assert r["text"] == "\n\n".join(b for b in want if b)


def test_only_whole_elements_are_cut():
    def texts(page):
        return [t for _, t in htmltext.blocks(page)]

    assert texts("<p>a<svg/>b<p>c<svg class='x' />d") == ["ab", "cd"]
    assert texts("<p>a<select-menu>b</select-menu><p>c<object-viewer>d</object-viewer><p>e<svg-icon>f") == ["ab", "cd", "ef"]
    for name in ("svg", "object", "select", "iframe", "noscript", "template"):
        assert texts(f"<p>a<{name} id=x>no</{name.upper()} >b<p>c<{name}>d<p>e") == ["ab", "cd", "e"]
    for name in ("script", "style", "textarea"):
        assert texts(f"<p>a<{name}>no<p>no</{name}>b<p>c<{name}>no<p>no") == ["ab", "c"]
