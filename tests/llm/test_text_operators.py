"""HTML extraction, quality, line dedup, licences, languages."""

import random
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest

from chronolith.llm import html_text as H
from chronolith.llm import language, licences, line_dedup, queries, scratch
from chronolith.llm import quality as Q
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"


def test_pages(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>A</a></li></ul></nav>"
        "<!-- x --><div class='ad'>Buy <div>now</div></div><article><h1>Head &amp; more&amp</h1><p><b>One\n two&nbsp;three<br><p>A.</p><aside>no</aside><p>x &lt;b&gt;</p></article>"
        "<section class=comments><p>I like it</p></section><footer>&copy; me</footer></body></html>"
    )
    assert H.main_text(page) == "Head & more&\nOne two three\nA.\nx <b>"
    assert H.main_text("<nav>only</nav>") == "" == H.main_text("") == H.main_text(None)
    assert H.main_text("<article><div class=ad>open and never closed<p>text stays</p>") == "open and never closed\ntext stays"
    free = "<body><ul><li><a href=x>Home</a></ul><div>" + "Real text. " * 20 + "</div><p>Short.</p><form>Name <input></form><div>tail</div>"
    assert H.main_text(free) == ("Real text. " * 20).strip() + "\nShort."
    rows = [(1, "u", page, 0), (2, None, None, 0), (2, None, None, 0), (3, "u", "<p>" + "long " * 100_000, 0)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, len(H.main_text(page)), 499_999]
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(("page", "text"), [
    ('<article><p data-id="related">keep</p><p id="search-for-gold">gold</p></article>', "keep\ngold"),
    ('<article><p title="a>b">keep</p></article>', "keep"),
    ('<article><div class="ad"><p>Body one.</p><div class="sidebar">BUY NOW</div><p>two</p></article>', "Body one.\ntwo"),
    ('<article><p title="open>keep</p></article>', "keep"),
    ("<article><ul>" + "<li><a href=x>Go</a></li>" * 4 + "</ul><p>text</p><p><a href=x>more</a></p></article>", "Go\nGo\ntext\nmore"),
    ("<article><h1><a href=x>Head</a></h1><p>text</p></article>", "Head\ntext"),
    ("<main><p>a</p><script>if (a<b) '</p>'</script><p>b", "a\nb"),
])
def test_awkward_markup(page, text):
    assert H.main_text(page) == text


class Plain(HTMLParser):
    """Text of an article by the standard library's parser: blocks in order, what stands apart left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.part, self.article, self.out = [], [], 0, []

    def cut(self):
        text = " ".join("".join(self.part).split())
        if text and self.article:
            self.blocks.append(text)
        self.part = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.out:
            self.out += [tag] * (tag == self.out[0])
        elif tag in ("script", "style", "title", "nav", "header", "footer", "aside", "form", "head") or {"ad", "comments", "sidebar", "notice", "cookie"} & set((a.get("class") or "").split()):
            self.cut()
            self.out = [tag]
        elif tag in H.BLOCKS:
            self.cut()
            self.article += tag == "article"
        elif tag == "br":
            self.part.append(" ")

    def handle_endtag(self, tag):
        if self.out:
            if tag == self.out[0]:
                self.out.pop()
        elif tag in H.BLOCKS:
            self.cut()
            self.article -= tag == "article"

    def handle_data(self, data):
        if not self.out:
            self.part.append(data)


def test_pages_match_the_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html or "")
        plain.close()
        plain.cut()
        assert got[r.page_id] == "\n".join(plain.blocks), r.page_id


def test_quality_learns_from_the_training_fold_alone(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in Q.score_documents(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    blind = labels.where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2")
    again = {r.doc_id: r.predicted for r in Q.score_documents(docs, blind).collect()}
    assert again == {i: r.predicted for i, r in got.items()}


def test_quality_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x"), (3, "word " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score_documents(docs, none).collect()} == {0.5}
    assert Q.keep_good(docs, none).count() == 5
    assert Q.score_documents(docs.limit(0), none).count() == 0


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    s, t = sorted((a, b), key=len)
    return len(t) - len(s) == 1 and any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute_lines(rows):
    def near(a, b):
        if a == b:
            return True
        s, t = " ".join(a), " ".join(b)
        by_words = min(len(a), len(b)) >= line_dedup.MIN_WORDS and one_edit(a, b)
        return by_words or max(len(a), len(b)) <= line_dedup.CHAR_WORDS and min(len(s), len(t)) >= line_dedup.MIN_CHARS and one_edit(s, t)

    first, out = {}, {}
    for i, text in sorted(rows):
        for n, line in enumerate(text.split("\n")):
            w = tuple(line.lower().split())
            if w:
                first.setdefault(w, (i, n))
    for i, text in rows:
        kept = []
        for n, line in enumerate(text.split("\n")):
            w = tuple(line.lower().split())
            if not w or not any(p < (i, n) and near(v, w) for v, p in first.items()):
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("hot", [scratch.HOT_ROWS, 2])
def test_lines_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(scratch, "HOT_ROWS", hot)
    rng = random.Random(6)
    vocabulary = "a b c d e f g h".split()
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14))) for _ in range(25)]
    for _ in range(200):
        w = rng.choice(lines).split(" ")
        k = rng.randrange(len(w))
        w[k : k + rng.randint(0, 1)] = [rng.choice(vocabulary + ["A", "z"])] * rng.randint(0, 2)
        lines.append(" ".join(w))
    for _ in range(200):
        w = rng.choice(["Äpfel und Birnen liegen im Korb", "scriptwithoutspacesgoesonandon", *(x for x in lines if len(x) > 15)])
        k = rng.randrange(len(w))
        lines.append(w[:k] + rng.choice(["", "é", " ", w[k : k + 1] + "x"]) + w[k + rng.randint(0, 1) :])
    rows = [(i, "\n".join(rng.choice(["", *lines]) for _ in range(rng.randint(0, 12)))) for i in range(70)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == brute_lines(rows)


def test_line_edge_rows(spark):
    rows = [(2, "x y\n\nx y", 9, 1), (1, "x y", 3, 1), (1, "x y", 3, 1), (3, None, None, 1), (None, "x y", 3, 1), (4, "", 0, 1), (5, "q" * 300_000 + "\nx  Y", 0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, gone int")
    got = sorted((r.doc_id or 0, r.text, r.n_lines, r.n_dropped, r.n_chars) for r in line_dedup.dedup_lines(df).collect() if r.text is None or len(r.text) < 99)
    assert got == [(0, "x y", 1, 0, 3), (1, "x y", 1, 0, 3), (1, "x y", 1, 0, 3), (2, "", 3, 2, 0), (3, None, 0, 0, None), (4, "", 1, 0, 0)]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_one_line_of_many_words_takes_memory_in_proportion(spark):
    """Two near lines of 20,000 words, and two of 100,000 characters without a space."""
    import tracemalloc

    rng = random.Random(4)
    w = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    long = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    rows = [(1, " ".join(w)), (2, " ".join([*w[:9_000], "other", *w[9_001:]])), (3, long), (4, long[:70_000] + "x" + long[70_000:]), (5, " ".join(reversed(w)))]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(1, 0), (2, 1), (3, 0), (4, 1), (5, 0)]
    tracemalloc.start()
    made = sum(len(key) for key, *_ in line_dedup._neighbours(pa.array([rows[0][1]]), np.array([15]), np.array([7])))
    assert made == 40_001
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()


def test_line_query_matches_sql(spark):
    same(queries.op6_line_dedup(spark, SF), connect(SF), queries.ORACLES["op6_line_dedup"])


def test_licences(spark):
    text = "Er then.\nReleased under the MIT License.\nof the in it"
    rows = [(1, text), (2, None), (3, ""), (4, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."), (5, "the license plate of the driver"), (6, "Licensed under the Foo Bar License v9"), (6, "x " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_paragraphs, r.n_unknown, r.licences) for r in licences.document_licences(docs).collect())
    assert got == [(1, 1, 0, "mit"), (2, 0, 0, ""), (3, 0, 0, ""), (4, 2, 0, "apache,cc-by-nc"), (5, 0, 0, ""), (6, 0, 0, ""), (6, 1, 1, "")]
    assert [(r.doc_id, r.line, r.family) for r in licences.licence_paragraphs(docs.where("doc_id = 1")).collect()] == [(1, 1, "mit")]
    known = {"GNU General Public License": "gpl", "CC BY-NC 4.0": "cc-by-nc", "MIT License": "mit", "Apache License": "apache"}
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: ",".join(sorted(f for k, f in known.items() if k in r.text)) for r in d.collect()}
    assert {r.doc_id: r.licences for r in licences.document_licences(d).collect()} == want


def test_short_notices_are_unknown_licences(spark):
    notices = ["All rights reserved.", "Copyright (c) 2019 Jane Doe. All rights reserved.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"]
    ordinary = ["He said all rights were reserved for the king", "and " * 5_000, "mit " * 5_000, "the license plate of the driver"]
    docs = spark.createDataFrame(list(enumerate(notices + ordinary)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_paragraphs, r.n_unknown, r.licences) for r in licences.document_licences(docs).collect())
    assert got == [(i, i < 3, i < 3, "") for i in range(7)]
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: sum("All rights reserved." in x for x in r.text.split("\n")) for r in d.collect()}
    assert sum(want.values()) == 7
    assert {r.doc_id: r.n_unknown for r in licences.document_licences(d).collect()} == want


def test_licences_across_line_ends_and_inside_long_lines(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:"
    before, after = "filler words of a story that goes on " * 300, " and so the story goes on with more words" * 300
    flat = {k: before + v.replace("\n", " ").replace("#", "") + after for k, v in {"gpl": gpl, "bsd": bsd, "": "All rights reserved."}.items()}
    texts = ["Head\n" + gpl, bsd, gpl + "\n\n" + bsd, flat["gpl"], flat["bsd"], flat[""], "She will defend all rights of the workers", before + after, gpl + "\nReleased under the MIT License.\n" + gpl]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_paragraphs, r.n_unknown, r.licences) for r in licences.document_licences(docs).collect())
    assert got == [(0, 1, 0, "gpl"), (1, 1, 0, "bsd"), (2, 2, 0, "bsd,gpl"), (3, 1, 0, "gpl"), (4, 1, 0, "bsd"), (5, 1, 1, ""), (6, 0, 0, ""), (7, 0, 0, ""), (8, 3, 0, "gpl,mit")]
    assert [(r.doc_id, r.line) for r in licences.licence_paragraphs(docs.where("doc_id = 0")).collect()] == [(0, 1)]


def test_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.identify(d).collect()}
    lang = {r.doc_id: r.lang for r in d.collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == lang[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "12 !?", "en"), (4, "the end of it", "en"), (4, "the end of it", "en"), (5, "Ω", None)], "doc_id long, text string, lang string")
    assert sorted((r.doc_id, r.lang_pred) for r in language.identify(odd).collect()) == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "en")]
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", odd.lang.substr(9, 1)).where("lang IS NULL")).collect()} == {"und"}
    assert language.identify(odd.limit(0)).count() == 0
