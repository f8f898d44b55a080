import html
import random
import re

import duckdb
import numpy as np
import pytest

from tideline.llm.html_extraction import best_run, default_weights, extract, main_text
from tideline.llm.license_scan import rank, scan_licenses, scan_text
from tideline.llm.license_texts import LEADS, LICENSES, long_texts


def test_best_run_is_the_best():
    rng = random.Random(0)
    for _ in range(300):
        s = np.array([rng.choice([-3, -1, 0, 2, 5]) for _ in range(rng.randrange(12))], float)
        a, b = best_run(s)
        best = max([0.0] + [s[i:j].sum() for i in range(len(s)) for j in range(i + 1, len(s) + 1)])
        assert s[a:b].sum() == pytest.approx(best)


def test_tags_cost_and_furniture_is_known():
    w = default_weights()
    assert all(v < 0 for v in w.tags.values()) and w.other < 0
    for name, attributes in [("div", 'class="ad"'), ("p", "class=advert"), ("section", "id='comments'"), ("aside", ""), ("nav", ""), ("form", ""), ("div", 'class="cookieNotice"'), ("div", 'role="navigation"')]:
        assert w.element(name, attributes) < 0
    for name, attributes in [("div", ""), ("div", 'id="foo"'), ("p", 'class="text"'), ("body", 'class="has-sidebar"'), ("div", 'class="post-content"'), ("td", "")]:
        assert w.element(name, attributes) > 0


def article(source):
    """The article of a page of the test tables, by its own markup."""
    blocks = re.split(r"</?(?:p|h1)>", source.split("<article>", 1)[1].split("</article>", 1)[0])
    texts = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = {r["page_id"]: r["html"] for r in df.collect()}
    found = extract(df).collect()
    assert len(found) == len(pages)
    for r in found:
        assert r["text"] == article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("container", ["<div>", '<div class="post">', "<section>", "<main>", ""])
def test_whole_table_without_articles(container):
    """The pages of the table with another element, or none, in place of the
    article: the scan finds the region by itself."""
    close = f"</{container[1:].split()[0].rstrip('>')}>" if container else ""
    for source in duckdb.execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        other = source[0].replace("<article>", container).replace("</article>", close)
        assert main_text(other) == article(source[0])


CASES = {
    "inlined image": ('<nav>Up</nav><div><p>Before</p><img src="data:image/png;base64,' + "A>" * 100_000 + '" class="ad"><p>After it</p></div>', "Before\n\nAfter it"),
    "quote that never closes": ('<p>One is here</p><a title="x>two and three</a><p>four and five</p>', "One is here\n\ntwo and three\n\nfour and five"),
    "short ends": ("<div><nav>Home page of the paper</nav><h1>Go</h1><p>One two three four five.</p><p>End</p></div><footer>Words at the foot</footer>", "Go\n\nOne two three four five.\n\nEnd"),
    "words of a far menu": ("<div><div>" + "".join(f"<a href=/{k}>Link</a> " for k in range(40)) + "</div><div><p>A story is told here, and it goes on for a while.</p><p>It ends.</p></div></div>", "A story is told here, and it goes on for a while.\n\nIt ends."),
    "surroundings": (
        """<html><head><title>x</title></head><body><header class="top"><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class="layout has-sidebar"><div class="cookie-notice">We use cookies. OK?</div>
        <div class="story-text"><h2>Title one</h2><p>First paragraph here with words.</p><div class="advert">Buy now</div><script>x<y</script><p>Second&nbsp;paragraph &amp; more <a href="x>y">link</a>.</p></div>
        <aside><p>sidebar text that is fairly long with many words in it so that it would be tempting to include</p></aside></div><div id="comments"><p>Nice post this is a reader comment</p></div><form><label>Email</label></form><footer>(c) 2020</footer></body></html>""",
        "Title one\n\nFirst paragraph here with words.\n\nSecond paragraph & more link.",
    ),
    "comments in the article": ("<body><nav>Up</nav><article><h1>T</h1><p>Hi.</p><section class=comments><article class=comment><p>I like this very much</p></article></section></article><footer>f</footer>", "T\n\nHi."),
    "advert between": ("<article><p>a</p><div class='ad'><p>" + "buy " * 300 + "</p></div><p>b</p></article>", "a\n\nb"),
    "unclosed advert": ('<div class="ad">Buy<p>text here', "text here"),
    "form around all": ("<form><main><p>Hello there</p></main></form>", "Hello there"),
    "no markup": ("plain  text\n&lt;b&gt; a < b", "plain text <b> a < b"),
    "inline": ("<p>a<b>b</b>c<br>d <!-- no -->e</p>", "abc d e"),
    "cut": ("<p>a</p><script>b", "a"),
    "lists": ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one\n\ntwo\n\nx\n\ny"),
    "null": (None, ""),
    "empty": ("", ""),
    "nothing": ("<nav>Home</nav><!-- x -->", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_page(name):
    source, want = CASES[name]
    assert main_text(source) == want


def test_broken_markup_is_linear_and_whole():
    for piece in ("<a '", "<a ", """<a "<b '<c """, '<a "<b "', "<a <b '\"", "<!--", "<script>", "<div class=ad>", '<p title="', "</p>", "<", "&"):
        main_text("<p>x</p>" + piece * 20_000)
    rng = random.Random(1)
    for _ in range(200):
        main_text("".join(rng.choice(["<", ">", "p", "/", "div", " ", "'", '"', "<p>", "</p>", "<article>", "</div>", "<nav>", "<!--", "-->", "text", "<td>", "<script>"]) for _ in range(40)))


def test_extract_edge_cases(spark, rows):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", 3), (1, "u", "<p>a</p>", 3), (None, None, None, 4)], "page_id long, url string, html string, n_chars int")
    assert rows(extract(df), "page_id", "text", "n_chars") == [(1, "a", 1), (1, "a", 1), (None, "", 0)]
    assert extract(df.where("false")).count() == 0


def found(text):
    return [(f.license, f.wording) for f in scan_text(text)]


def test_every_text_and_notice_is_its_own():
    for name, (texts, names) in LICENSES.items():
        for t in texts:
            if "*" not in t and not t.startswith("This work"):
                assert found(f"Words before.\n\n{t}\n\nWords after.") == [(name, "text")], name
                assert rank(t)[0][1].name == name or name.startswith("BSD")
        for n in names:
            got = found(f"Words before.\nLicensed under the {n}.")
            assert got and got[0][0] in (name, name.removesuffix("-or-later")), n


def test_licence_differences():
    mit = LICENSES["MIT"][0][0]
    [f] = scan_text("Copyright (c) 2020 Me\n\n" + mit.replace("sell", "vend").replace("merge,", ""))
    assert f.license == "MIT" and sorted(f.missing) == ["merge", "sell"] and f.extra == ("vend",)
    assert found("Licensed under CC BY-NC 4.0.") == [("CC-BY-NC-4.0", "notice")] and found("Licensed under CC BY 4.0.") == [("CC-BY-4.0", "notice")]
    gpl = LICENSES["GPL-3.0"][0][0]
    assert found(gpl.replace("version 3", "version 7")) == [(None, None)]  # a decisive word differs
    assert found(mit + "\n\nAlso released under the ISC License. " + "x " * 3000 + "Released under the MIT License.") == [("MIT", "text"), ("ISC", "notice"), ("MIT", "notice")]
    assert found("no such words") == [] and found(None) == [] and found("All rights reserved, copyright") == [(None, None)]


def test_licences_of_the_table(spark):
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    path = "/root/testdata/sf0.01/documents.parquet"
    want = sorted((i, name) for i, t in duckdb.execute(f"SELECT doc_id, text FROM '{path}'").fetchall() for line, name in lines.items() for _ in range((t or "").count(line)))
    got = sorted((r["doc_id"], r["license"]) for r in scan_licenses(spark.read.parquet(path)).where("license is not null").collect())
    assert want and got == want


def test_scan_edge_cases(spark, rows):
    df = spark.createDataFrame([(1, "MIT License: Released under the MIT License", "z"), (2, None, "z"), (3, "", "z"), (None, "licence " * 30_000, "z")], "doc_id long, text string, license string")
    got = scan_licenses(df).groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in got} == {1, None}
    assert scan_licenses(df.where("false")).count() == 0


def test_notices_that_save_no_bytes():
    filler = "Plain words about a river and its old bridges near the town. " * 13
    for said, name in [("SPDX-License-Identifier: MIT", "MIT"), ("License: MIT", "MIT"), ("Licence: ISC", "ISC"), ("SPDX-License-Identifier: ISC", "ISC"), ("SPDX-License-Identifier: CC0-1.0", "CC0-1.0")]:
        for text in (said, f"{filler}{said}. {filler}"):
            assert found(text) == [(name, "notice")], said


def test_every_lead_with_every_name():
    for name, (_, names) in LICENSES.items():
        for n in names:
            for lead in LEADS:
                for the in ("", "the "):
                    said = f"{lead} {the}{n}"
                    if re.search("licen|spdx", said, re.I):
                        continue
                    assert found(f"Words before.\n{said}.\n\nWords after.") == [(name, "notice")], said
    assert found("Licensed under the MIT License. Covered by ISC.") == [("MIT", "notice"), ("ISC", "notice")]
    assert found("They are subject to change, and mit means with.") == []


def test_whole_texts_far_from_their_cue():
    zlib = LICENSES["Zlib"][0][0]
    paragraphs = re.sub(r" (?=In no event|Permission is|[123]\. )", "\n\n", " ".join(zlib.split()))
    assert paragraphs.count("\n\n") == 5
    filler = "Plain words about a river and its old bridges near the town. " * 20
    for text in (paragraphs, f"{filler}\n\n{paragraphs}\n\n{filler}", " ".join(zlib.split()) + " " + filler):
        assert found(text) == [("Zlib", "text")]
    for name in ("MIT", "BSD-3-Clause", "ISC", "Apache-2.0"):
        spaced = re.sub(r"(?<=[.:;,]) ", "\n\n", " ".join(LICENSES[name][0][0].split()))
        assert found(f"{filler}\n\n{spaced}\n\n{filler}") == [(name, "text")], name
    gpl = LICENSES["GPL-3.0"][0][0]
    assert ("GPL-3.0", "text") in found(gpl.replace("version 3", "version 7") + "\n\n" + filler + gpl)


def test_long_texts():
    filler = "Plain words about a river and its old bridges near the town. " * 300
    for name, t in long_texts().items():
        assert found(t) == [(name, "text")], name
        [f] = scan_text(f"{filler}\n{t.replace('without', 'with no', 2)}\n{filler}")
        assert (f.license, f.wording) == (name, "text") and f.missing == ("without",) * min(2, t.count("without"))
        half = " ".join(t.split()[: len(t.split()) // 2])
        assert (name, "text") not in found(half) or name == "LGPL-3.0"
    gpl = long_texts()["GPL-3.0"]
    other = scan_text(gpl.replace("General Public", "Affero General Public"))
    assert all(f.end - f.start < 10_000 for f in other)  # a decisive word differs
    two = found(f"{long_texts()['Apache-2.0']}\n{filler}\n{long_texts()['MPL-2.0']}")
    assert two == [("Apache-2.0", "text"), ("MPL-2.0", "text")]


def test_wordings_in_comments():
    for name in ("MIT", "BSD-2-Clause", "ISC", "Apache-2.0"):
        lines = LICENSES[name][0][0].splitlines()
        assert found("/*\n" + "\n".join(f" * {line}" for line in lines) + "\n */\nint main;") == [(name, "text")], name


def test_the_first_confirmed_of_the_ranking_wins():
    """A block of two licences: the one that saves more bytes is found first, and both are found."""
    mit, isc = LICENSES["MIT"][0][0], LICENSES["ISC"][0][0]
    ranking = [x.name for _, x in rank(f"{mit} Released under the ISC License.")]
    assert ranking[0] == "MIT"
    assert found(f"{isc}\n\n{mit}") == [("ISC", "text"), ("MIT", "text")]
    assert found(f"Released under the ISC License. {mit}") == [("ISC", "notice"), ("MIT", "text")]
