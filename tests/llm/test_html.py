from __future__ import annotations

import html as entities
import re

import numpy as np

from quire.llm import html


def test_held_out_pages():
    model, pages = html.default_model(), html.labelled_pages(150, seed=404)
    f = np.concatenate([html.features(p) for p, _ in pages])
    y = np.concatenate([y for _, y in pages])
    assert np.mean(model.chain.decode(f, np.array([len(p) for p, _ in pages])) == y) > 0.99


def test_articles_of_the_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    for p in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*(>|$)", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[p.page_id].text == "\n".join(b for b in blocks if b)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_blocks_of_broken_markup():
    found = html.blocks("<p>one <b>two<br>three<p>four &amp; &#233;<!-- <p>no --><script>'</p>'</script> five<li>six<li>seven<a href='x>y'>eight</a>")
    assert [b.text for b in found] == ["one two three", "four & é five", "six", "seveneight"]
    assert html.blocks("") == []
    assert html.blocks("<!-- never ends <p>x") == []


def test_awkward_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "plain words only, no markup here.", "x"), (4, "u", "<article><p>" + "Long text here. " * 20_000 + "</article>", "x"), (4, "u", "<article><p>Again.</p></article>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert len(got) == 5
    assert [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert max(r.n_chars for r in got) == len(("Long text here. " * 20_000).strip())
    assert html.extract(df.limit(0)).collect() == []
