"""Main text, licence scan and fingerprints on planted cases."""

import random

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from terrascore.llm import htmltext, licenses, merkle

SF = "/root/testdata/sf0.001"


def test_decode_against_every_choice():
    rnd = np.random.default_rng(3)
    for _ in range(40):
        n = 9
        parent = np.array([-1] + [rnd.integers(0, i) for i in range(1, n)])
        odds = rnd.normal(size=n)

        def value(kept):
            return sum(o if k else -o for o, k in zip(odds[1:], kept[1:]))
        best = max(value(k) for m in range(1 << (n - 1)) for k in [[True] + [bool(m >> i & 1) for i in range(n - 1)]]
                   if all(not k[i] or k[parent[i]] for i in range(1, n)))
        kept = htmltext.decode(odds, parent)
        assert kept[0] and all(not kept[i] or kept[parent[i]] for i in range(1, n))
        assert abs(value(kept) - best) < 1e-9


def test_parse_odd_markup():
    texts = lambda h: [t for _, t in htmltext.parse(h)[1]]
    assert texts("<p>a &amp; b<p>c<br>d</p>e <b>f</b>g") == ["a & b", "c d", "e fg"]
    assert texts("<script>var t='</p>'</script>x<!-- y") == ["x"]
    assert texts("<ul><li>1<li>2</ul><div>3</article></div>4") == ["1", "2", "3", "4"]
    assert texts(None) == texts("") == texts("<") [:0] == []
    assert texts("plain  text\n only") == ["plain text only"]


def test_parse_open_and_empty_elements():
    texts = lambda h: [t for _, t in htmltext.parse(h)[1]]
    assert texts("<head><title>t</title><body><article><p>Main text") == ["Main text"]
    assert texts("<html><head><meta charset=x><title>a <b> c</title><link rel=y><p>One<p>Two</html>") == ["One", "Two"]
    assert texts("<head><title>t</title>Bare text<p>more") == ["Bare text", "more"]
    assert texts("<head><title>t<body><p>Main</p><svg><title>no</title></svg>") == ["Main"]
    assert texts("<head>\n<title>t</title><style>p{}</style></head><body><header>Top</header><p>x") == ["Top", "x"]
    assert texts('<p><svg class="i"/>Main text <svg><title>i</title><path d=1></svg>goes on</p>') == ["Main text goes on"]
    assert texts("<p>a<svg><path d=1><p>b</p><svg></svg>c") == ["a", "b", "c"]
    assert texts("<p>a <object data=x>not shown here</object> b</p><object><p>c") == ["a not shown here b", "c"]
    assert texts("<p>a<iframe src=x><p>b<template><p>c<noscript>d") == ["a", "b", "cd"]
    assert texts("<p>a<iframe src='x'/>b<iframe>no</iframe>c<template><p>no</p></template>d") == ["abcd"]
    assert texts("a<script>no") == texts("a<style>no") == texts("a<!-- no") == ["a"]
    assert texts("<svg>" * 20000 + "x") == ["x"]


def test_pages_and_other_layouts(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    trees = htmltext.fit(pages)
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<p>hello world</p>"), (3, "u", "<div>" * 3000 + "deep"),
            (4, "u", "<html><body><div class='menu'><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></div><div class='content'><h1>Title of it</h1>"
             + "<p>This is a long paragraph of the story, with commas, and it goes on for a while so that it is text.</p>" * 6
             + "</div><div class='comments'><p>First! I liked it.</p></div><div class='sidebar'><a href=z>Buy</a></div></body></html>")]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = {(r["page_id"], r["n_chars"]): r["text"] for r in htmltext.extract(odd, trees).collect()}
    assert out[(1, 0)] == ""
    story = next(t for (i, _), t in out.items() if i == 4)
    assert story.startswith("Title of it This is") and "First!" not in story and "Home" not in story and "Buy" not in story
    got = {r["page_id"]: r["text"] for r in htmltext.extract(pages, trees).collect()}
    whole = 0
    for r in pages.collect():
        nodes, runs = htmltext.parse(htmltext.marked(r["html"]), htmltext.MARK)
        whole += got[r["page_id"]] == " ".join(t for at, t in runs if nodes[at][10])
    assert whole >= 0.95 * len(got)
    assert htmltext.main_texts(["<nav><a href=x>Home</a></nav>"], htmltext.fit(pages.where("false"))) == [""]
    assert htmltext.extract(odd, None).count() == len(rows)


def test_fit_draws_pages_with_an_article(spark):
    text = "<div class=menu><a href=x>Home</a></div><p>Some words of a page, and more of them.</p>"
    empty = ["<div>%s</div>", "<script>x='<article>'</script>%s", "<!--<main>m</main>-->%s", "<main id=app> <b></b></main><div>%s</div>"]
    rows = [(i, empty[i % 4] % text) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    # none has an article: the trees come from generated pages
    alone = htmltext.fit(pages, 5)
    assert all("Home" not in t and "Some words of a page" in t for t in htmltext.main_texts([r[1] for r in rows[:4]], alone))
    drawn = {r[0] for r in pages.orderBy(F.xxhash64(F.lit(5), "page_id"), "page_id").limit(5).collect()}
    rare = [i for i in range(400) if i not in drawn][:2]
    some = [(i, f"<script>'<article>'</script><main></main><article>{text * 3}</article><div class=menu>{text}</div>" if i in rare else h) for i, h in rows]
    assert htmltext.parse(htmltext.marked(some[rare[0]][1]))[0][-1][10] == 0
    assert htmltext.fit(spark.createDataFrame(some, "page_id long, html string"), 5) is not None


def test_licences(spark):
    rows = [(1, "Mit  LICENSE, mit license x\nmit\nlicense"), (2, None), (3, ""), (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of the software"),
            (5, "licensed for the apache"), (6, "MİT License"), (7, "x " * 60000 + "general public license"), (7, "x"), (8, "Licensed under CC BY-NC 4.0")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("clash"))
    out = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(df).collect()}
    assert (out[(1, 7)]["n_base"], out[(1, 7)]["first_word"], out[(1, 7)]["last_word"], out[(1, 7)]["labels"]) == (3, 0, 5, "mit")
    assert out[(2, 0)]["first_word"] is None and out[(3, 0)]["labels"] == ""
    assert out[(4, 16)]["labels"] == "mit" and out[(4, 16)]["base_labels"] == "" and 0.9 <= out[(4, 16)]["score"] < 1
    assert out[(5, 4)]["labels"] == "" and out[(6, 2)]["n_base"] == 0
    assert out[(7, 60003)]["base_labels"] == "gpl" and out[(7, 60003)]["last_word"] == 60000
    assert out[(8, 7)]["labels"] == "cc,cc-by-nc"
    assert licenses.scan(df.where("false")).count() == 0


def test_wrapped_licences(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files "
           "(the \"Software\"), to deal\nin the Software without restriction")
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided"
    comment = " * " + isc.replace("\n", "\n * ")
    narrow = "\n".join(" ".join(mit.split()).split(" "))
    far = "\n".join(f"w{i}" for i in range(173)) + "\n"
    broken = isc.replace("any\n", "any\n\n" + "x " * 60 + "\n\n")
    rows = [(1, mit), (2, bsd), (3, isc), (4, "/*\n *\n" + comment + "\n */"), (5, narrow), (6, far + bsd + "\n" + far), (7, broken),
            (8, "title\n\n" + mit + "\n\n" + bsd), (9, mit.replace("\n", "\r\n")), (10, "\n\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["labels"] for r in licenses.scan(df).collect()}
    assert out == {1: "mit", 2: "bsd", 3: "isc", 4: "isc", 5: "mit", 6: "bsd", 7: "", 8: "bsd,mit", 9: "mit", 10: ""}
    # wherever a window begins
    moved = [(n, "\n".join(["x"] * n + isc.split()) + "\ny" * 50) for n in range(90)]
    assert {r["labels"] for r in licenses.scan(spark.createDataFrame(moved, "doc_id long, text string")).collect()} == {"isc"}


def test_join_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    vocabulary = sorted({w for _, t in licenses.TEMPLATES for w in licenses.template_words(t)})
    for threshold in (0.3, 0.5, 0.8):
        got = {(r["doc_id"], r["block"], r["template"], round(r["containment"], 9))
               for r in licenses.matches(licenses.scan_blocks(docs, vocabulary), threshold=threshold).collect()}
        want = set()
        for r in docs.collect():
            for b, line in enumerate(r["text"].split("\n")):
                words = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line.translate(str.maketrans(licenses.UPPER, licenses.LOWER))))
                for k, (_, t) in enumerate(licenses.TEMPLATES):
                    s = set(licenses.template_words(t))
                    if len(s & words) >= threshold * len(s) - 1e-9:
                        want.add((r["doc_id"], b, k, round(len(s & words) / len(s), 9)))
        assert got == want


def test_next_document_and_edges(spark):
    rows = [(5, "a b c"), (4, None), (3, ""), (9, "one two\n\nthree four five six\nseven"), (3, "zz zz"), (None, "last of all"), (9, "one two\n\nthree four five six\nseven")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit("clash"))
    for ranges in (1, 3, 50):
        nxt = merkle.with_next(df, ranges).collect()
        assert len(nxt) == len(rows)
        nines = sorted(r["next_text"] for r in nxt if r["doc_id"] == 9)
        assert nines == ["a b c", rows[3][1]]
        assert [r["next_text"] for r in nxt if r["doc_id"] is None] == [rows[3][1]]
        assert [r["next_text"] for r in nxt if r["doc_id"] == 5] == [""]
    out = merkle.compared(df).collect()
    assert len({r["fingerprint"] for r in out if r["doc_id"] == 9}) == 1
    first = next(r for r in out if r["doc_id"] == 5)
    assert first["edited_sha256"] == hashlib.sha256(b"a b ").hexdigest() or first["n_chars"] == 5
    one = merkle.compared(df.where("doc_id = 5")).collect()[0]
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b a").hexdigest()
    assert merkle.compared(df.where("false")).count() == 0


def test_edits_are_located(spark):
    old = "title\n\n" + " ".join(f"w{i}" for i in range(20)) + "\nsecond one\n\nend"
    new = old.replace("w9", "X").replace("second", "third")
    prints = merkle.fingerprints(spark.createDataFrame([(1, old), (2, new)], "doc_id long, text string"))
    a, b = prints.where("doc_id = 1").select(F.col("sections").alias("old")), prints.where("doc_id = 2").select(F.col("sections").alias("new"))
    pair = a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k")
    assert [tuple(e) for e in merkle.locate_edits(pair).first()["edits"]] == [(1, 0, 1), (1, 1, 0)]
    assert merkle.locate_edits(a.withColumn("new", F.col("old"))).first()["edits"] == []


def test_pages_without_an_article(spark):
    """No page shows its article: menus and footers go all the same."""
    text = [f"The {a} of the harbour was rebuilt in the year {1900 + i}, and since then the {a} has been open to all visitors." for i, a in
            enumerate(("tower", "bridge", "market", "garden", "library", "theatre"))]
    side = ("Home", "Imprint", "Contact us", "copyright 2020")
    pages = [(i, f"u{i}", f'<html><body><div class="nav"><ul>{"".join(f"<li><a href=x>{m}</a></li>" for m in side[:3])}</ul></div><div class="content"><h1>About the {i}th place</h1>'
                          f'{"".join(f"<p>{t}</p>" for t in text[i % 3:i % 3 + 4])}</div><div class="footer"><p>{side[3]}</p></div></body></html>') for i in range(12)]
    pages.append((99, "u", "a\ue000b"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in htmltext.extract(df, htmltext.fit(df)).collect()}
    for i in range(12):
        assert out[i] == " ".join([f"About the {i}th place", *text[i % 3:i % 3 + 4]])
    assert "\ue000" in htmltext.main_texts(["<p>a\ue000b</p>"], None)[0]


def test_pages_with_other_columns_and_repeated_rows(spark):
    page = htmltext.generated_pages(3)[1]
    df = spark.createDataFrame([(1, "u", page, "x", 5), (1, "u", page, "x", 5), (2, None, None, "y", 6)], "page_id long, url string, html string, text string, n_chars long")
    out = htmltext.extract(df, htmltext.fit(df)).collect()
    assert [r["text"] for r in out][:2] == [r["text"] for r in out][1:2] * 2 and sorted(r["n_chars"] for r in out)[0] == 0


def test_notices_wrapped_and_long_lines_like_sql(spark, tmp_path):
    import duckdb

    rnd = random.Random(4)
    filler = [f"w{i}" for i in range(300)]
    wordings = [t for _, t in licenses.TEMPLATES]
    texts = [None, "", "plain text"]
    for k, t in enumerate(wordings):
        words = t.split()
        wrapped = "\n".join(" ".join(words[i:i + 7]) for i in range(0, len(words), 7))
        texts += [t, wrapped, "before\n" + wrapped + "\nafter", " ".join(rnd.choices(filler, k=500)) + " " + t + " " + " ".join(rnd.choices(filler, k=200)),
                  wrapped.replace("\n", "\n\n")]
        scattered = rnd.choices(filler, k=4000)
        for i, w in enumerate(words):
            scattered[i * (4000 // len(words))] = w
        texts.append(" ".join(scattered))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r) for r in licenses.scan(df).collect()}
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = {r[0]: r for r in con.sql(licenses.OP1_SQL).fetchall()}
    assert got == want
    for k, (label, t) in enumerate(licenses.TEMPLATES):
        base = 3 + 6 * k
        assert all(label in got[base + j][6].split(",") for j in (0, 1, 2, 3))
        if len(t.split()) > 12:
            assert label not in got[base + 5][6].split(",")
