"""The parts that run inside Arrow tasks, against plain versions."""
import difflib
import random

import numpy as np
import pytest

from kinsift.llm import arrays, html_extract, license_scan, token_counts

WORDS = ["the", "a", "license", "x", "ab", "abc", "Ünï", "中文", "aaaa", "aaab", "b", "cab", "🙂"]


def test_words_are_split_and_hashed_alike_everywhere():
    texts = [b"The  cat\tsat\x0bon", None, b"", b"  the CAT ", "na ive  x".encode()]
    hashes, first = arrays.word_hashes(texts)
    assert list(np.diff(first)) == [4, 0, 0, 2, 2]
    assert hashes[0] == hashes[first[3]] and hashes[1] == hashes[first[3] + 1]
    alone = arrays.word_hashes([texts[0]])[0]
    assert (alone == hashes[:4]).all()
    assert len(set(arrays.word_hashes([" ".join(f"w{i}" for i in range(50_000)).encode()])[0].tolist())) == 50_000


def test_shingles_of_short_and_long_texts():
    def shingles(text):
        return arrays.shingle_set(arrays.word_hashes([text])[0], 5)

    assert len(shingles(b"")) == 0 and len(shingles(b"a b")) == 1 and len(shingles(b"a b c d e")) == 1
    assert len(shingles(b"a b c d e f")) == 2 and len(shingles(b"a a a a a a a")) == 1
    assert shingles(b"a b")[0] != shingles(b"b a")[0]


def plain_tokens(word, scored, unknown):
    table, text = dict(scored), token_counts.MARK + word
    best = [(0.0, 0)]
    for i in range(1, len(text) + 1):
        options = [(best[j][0] + table[text[j:i]], best[j][1] - 1) for j in range(i) if text[j:i] in table]
        if text[i - 1] not in table:
            width = len(text[i - 1].encode())
            options.append((best[i - 1][0] + unknown * width, best[i - 1][1] - width))
        best.append(max(options))
    return -best[-1][1]


@pytest.mark.parametrize("seed", range(5))
def test_trie_counts_match_plain_dynamic_programming(seed):
    rng = random.Random(seed)
    letters = "abcü中🙂" + token_counts.MARK
    pieces = {"".join(rng.choices(letters, k=rng.randint(1, 5))): -rng.choice([1.0, 2.0, 2.5, 4.0]) for _ in range(60)}
    words = sorted({token_counts.MARK + "".join(rng.choices(letters + "z", k=rng.randint(1, 12))) for _ in range(400)} | {token_counts.MARK + "ab" * 300})
    vocabulary = token_counts.Vocabulary(list(pieces.items()))
    assert token_counts.trie_counts(words, vocabulary).tolist() == [plain_tokens(w[1:], pieces.items(), vocabulary.unknown) for w in words]


def test_counter_forgets_without_changing_counts(monkeypatch):
    vocabulary = token_counts.Vocabulary([("a", -1.0), ("b", -1.5), ("ab", -1.2), (token_counts.MARK, -1.0)])
    texts = [b"ab a b abab", b"zz ab", None, b"", b"a a a"]
    whole = token_counts.Counter(vocabulary).count(texts)
    monkeypatch.setattr(token_counts, "REMEMBERED", 1)
    counter = token_counts.Counter(vocabulary)
    assert [counter.count([t])[0] for t in texts] == whole
    assert whole[2:4] == [(0, 0), (0, 0)]


def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("seed", range(200))
def test_shared_lines_are_a_longest_common_subsequence(seed):
    rng = random.Random(seed)
    a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 14))] for _ in range(2))
    kept = sorted(html_extract.shared(a, b))
    assert len(kept) == plain_lcs(a, b)
    rest = iter(b)
    assert all(a[i] in rest for i in kept)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy now</div>
<article><h1>Title &amp; more</h1><p><b>One  two<br>three &lt;b&gt; caf&eacute; &#x4e2d;<p>Second</p>
<aside>See also</aside><form><p>Name</p></form><div id="comments"><p>First!</p></div><p class="lead">Third</article>
<footer>&copy; me</footer></body></html>"""


def test_main_text_of_broken_and_framed_markup():
    assert html_extract.main_text(PAGE) == "Title & more\n\nOne two three <b> café 中\n\nSecond\n\nThird"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>x") == ""
    assert html_extract.main_text("plain &amp; text") == "plain & text"
    assert html_extract.main_text("<p>a<p>b</div></p>c <unknown x='>'>d</unknown>") == "a\n\nb\n\nc d"


def test_differencing_drops_what_the_neighbour_has_outside_articles():
    own = "<p>Site name</p><p>My own story</p><p>Contact us</p>"
    other = html_extract.digests(html_extract.lines("<p>Site name</p><p>Another</p><p>Contact us</p>"))
    assert html_extract.main_text(own, other) == "My own story"
    assert html_extract.main_text(own) == "Site name\n\nMy own story\n\nContact us"
    assert html_extract.main_text(own, html_extract.digests(html_extract.lines(own))) == html_extract.main_text(own)
    assert html_extract.main_text("<article>" + own + "</article>", other) == html_extract.main_text(own)


def test_differencing_decides_on_pages_with_articles_too():
    site = "<p>Site name</p><article><p>{}</p></article><p>{}</p><p>Contact us</p>"
    other = html_extract.digests(html_extract.lines(site.format("Teaser b", "Another long story of the other page")))
    assert html_extract.main_text(site.format("Teaser a", "My own story stands outside"), other) == "Teaser a\n\nMy own story stands outside"
    teaser = "<article>Short teaser</article><p>The story itself has many more words than its teaser</p>"
    assert html_extract.main_text(teaser) == "Short teaser\n\nThe story itself has many more words than its teaser"
    assert html_extract.main_text("<article>The story itself has many words</article><p>Contact us</p>") == "The story itself has many words"


@pytest.mark.parametrize("name", ["content no-sidebar", "has-sidebar", "ad-free", "social-science", "notice", "layout sidebar-right"])
def test_wrappers_do_not_frame_the_page(name):
    for wrapped in (f'<div class="{name}">{{}}</div>', f'<form id="{name.replace(" ", "_")}">{{}}</form>'):
        page = wrapped.format('<article><p>One story here</p><div class="ad">Buy now</div></article><div class="site-footer">Imprint</div>')
        assert html_extract.main_text(page) == "One story here"
        page = wrapped.format('<p>A long story of ten words or more stands in here alone</p>')
        assert html_extract.main_text(page) == "A long story of ten words or more stands in here alone"
    for mark in ("ad", "left sidebar", "site-footer", "siteFooter", "share", "ad-slot", "cookie-banner-inner"):
        assert html_extract.main_text(f'<div class="{mark}">Frame</div><p>Story of its own</p>') == "Story of its own"


def test_long_pages_stay_fast():
    own = list(range(0, 8000, 2)) + list(range(4000))
    other = list(range(0, 8000, 3)) + list(range(4000))
    assert len(html_extract.shared(own, other)) >= difflib.SequenceMatcher(None, own, other, False).find_longest_match().size


def plain_matches(template, words):
    return plain_lcs(template, words)


@pytest.mark.parametrize("name", list(license_scan.TEMPLATES))
def test_every_template_is_found_in_running_text(name):
    index = license_scan.Index(license_scan.TEMPLATES)
    text = "some prose here before it. " * 30 + license_scan.TEMPLATES[name].upper() + " and some more prose after it"
    hashes = arrays.word_hashes([text.encode()], separators=arrays.PUNCTUATION)[0]
    t = index.names.index(name)
    hits = [h for h in license_scan.scan_words(hashes, index, 0.8) if h[0] == t]
    assert [(h[1], h[2], h[3]) for h in hits] == [(len(index.words[t]), 150, 150 + len(index.words[t]) - 1)]


def test_whole_texts_and_headers_of_further_licenses():
    index = license_scan.Index(license_scan.TEMPLATES)

    def best(text):
        hits = license_scan.scan_words(arrays.word_hashes([text.encode()], separators=arrays.PUNCTUATION)[0], index, 0.8)
        return index.names[max(hits, key=lambda h: h[1])[0]] if hits else None

    assert best("/* This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n"
                " * License as published by the Free Software Foundation; either */") == "lgpl-header"
    assert best("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted. "
                + license_scan.TEMPLATES["isc-text"].split("copies. ")[1]) == "0bsd-text"
    assert best("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License") == "cc-by-sa-4.0-notice"
    assert best("This is free prose about software and its source code.") is None


def test_overlapping_finds_are_dropped_however_many_there_are():
    index = license_scan.Index({"t": " ".join(f"w{i}" for i in range(40))})
    own = [f"w{i}" for i in range(40)]
    once = own[:15] + ["x"] * 5 + own[15:30] + ["y"] * 5 + own[30:] + ["prose"] * 52  # a multiple of the band, so every copy meets the same diagonals
    hashes = arrays.word_hashes([" ".join(once * 100).encode()], separators=arrays.PUNCTUATION)[0]
    assert [h[1:3] for h in license_scan.scan_words(hashes, index, 0.5)] == [(30, 102 * i) for i in range(100)]


@pytest.mark.parametrize("seed", range(40))
def test_edited_wordings_match_brute_force(seed):
    """Every template against every window, without an index, finds the same templates in lightly edited texts."""
    rng = random.Random(seed)
    index = license_scan.Index(license_scan.TEMPLATES)
    name = rng.choice([n for n in index.names if len(index.words[index.names.index(n)]) > 10])
    own = license_scan.TEMPLATES[name].split()
    for _ in range(2):
        i = rng.randrange(len(own))
        own[i:i + 1] = rng.choice([[], [own[i], "extra"], ["other"]])
    text = " ".join(["prose"] * 20 + own + ["more"] * 20)
    hashes = arrays.word_hashes([text.encode()], separators=arrays.PUNCTUATION)[0]
    found = {index.names[h[0]]: h[1] for h in license_scan.scan_words(hashes, index, 0.75)}
    for t, template in enumerate(index.words):
        reach = len(template) + 2 * license_scan.BAND
        most = max(plain_lcs(template.tolist(), hashes[i:i + reach].tolist()) for i in range(0, max(1, len(hashes) - len(template)), 1))
        if index.names[t] in found:
            assert found[index.names[t]] <= most
        if index.names[t] == name and most >= 0.75 * len(template):
            assert found[name] == most
