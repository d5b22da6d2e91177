"""Operators on hand-made rows: nulls in any column, empty and long texts, ties, repeated rows, empty tables, clashing names."""
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinsift.llm import (dealing, decontaminate, html_extract, license_scan, line_dedup, mixing, quality_rules, token_counts,
                         url_filters)
from tests.llm.test_ngram_join import shingles, words

LONG = "one two three four five six seven eight nine ten eleven"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- op4 -------------------------------------------------------------------------------------------------------------

def keyed(df):
    """(doc_id, text, hash of the text) of every row."""
    return [tuple(r) for r in df.select("doc_id", "text", F.hash("text")).collect()]


def plain_pieces(text):
    """Words in lower case with their spans, and the (first, end) of the pieces, word by word."""
    found = [(m.group(), m.span()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w, _ in found]
    stops = [w[-1] in ".!?,;:" or i == len(found) - 1 or "\n" in text[found[i][1][1]:found[i + 1][1][0]] for i, w in enumerate(lower)]
    out, start = [], 0
    for i, stop in enumerate(stops):
        if stop:
            long = i + 1 - start > 16
            for j in range(start, i):
                if long and zlib.crc32(lower[j].encode()) % 8 == 0:
                    out.append((start, j + 1))
                    start = j + 1
            out.append((start, i + 1))
            start = i + 1
    return lower, [s for _, s in found], out


def plain_dedup(rows, least=25, edge=8):
    """rows: (doc_id, text, key); text after dedup and removed spans of each (doc_id, text), comparing words themselves."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = {(d, t): plain_pieces(t) if t is not None else ([], [], []) for d, t, _ in order}
    first, out = {}, {}
    for d, t, _ in order:
        lower, spans, parts = cut[d, t]
        gone = set()
        for start, _ in parts:
            ends = [e for _, e in parts if e - start >= least]
            if not ends:
                break
            end = ends[0]
            doc, a, b = first.setdefault(tuple(lower[start:end]), ((d, t), start, end))
            if (doc, a) == ((d, t), start) or (doc == (d, t) and start < b):
                continue
            theirs, floor = cut[doc][0], b if doc == (d, t) else 0
            left = right = 0
            while left < edge and start - left > floor and a - left > 0 and lower[start - left - 1] == theirs[a - left - 1]:
                left += 1
            while right < edge and end + right < len(lower) and b + right < len(theirs) and lower[end + right] == theirs[b + right]:
                right += 1
            gone |= set(range(start - left, end + right))
        taken = [(spans[i][0], spans[i + 1][0] if i + 1 < len(spans) else len(t)) for i in sorted(gone)]
        merged = []
        for s, e in taken:
            if merged and merged[-1][1] == s:
                merged[-1] = (merged[-1][0], e)
            else:
                merged.append((s, e))
        body = t
        for s, e in reversed(merged):
            body = body[:s] + body[e:]
        out[d, t] = (body, merged)
    return out


PASSAGE = "The quick fox, as it were, jumps over the lazy dog. Nobody knows why; the dog least of all. It sleeps, it dreams of bones, and of summer days by the river."


def dedup_rows():
    draw = random.Random(4)
    names = [f"w{n}" for n in range(300)]
    prose = lambda n: " ".join(draw.choice(names) + draw.choice(["", "", "", "", "", ",", ".", "!\n"]) for _ in range(n))
    mid = prose(70)
    rows = [(n, prose(draw.randrange(60)) + " " + mid + " " + prose(draw.randrange(60))) for n in range(30, 36)]
    return rows + [(1, f"Head\n{PASSAGE}\nshort\nshort"), (2, f"other words {PASSAGE.upper()}  \n tail"), (3, f" x {PASSAGE}\n\n{PASSAGE} {PASSAGE}\nüñ🙂 {PASSAGE}"), (4, None),
                   (5, ""), (None, PASSAGE), (None, "a " + PASSAGE), (6, "x\n" * 3000 + PASSAGE), (1, f"Head\n{PASSAGE}\nshort\nshort"), (1, f"another\n{PASSAGE}"), (7, PASSAGE),
                   (8, "und " * 400), (9, "Und\t" * 300), (10, "no end " * 9 + PASSAGE.replace(".", "").replace(",", "").replace(";", "")),
                   (11, "other " + PASSAGE.replace(".", "").replace(",", "").replace(";", "") + " tail"), (12, " \n "), (13, "y" * 100_000)]


def test_substring_dedup(spark):
    rows = dedup_rows()
    df = spark.createDataFrame([(a, b, "k", 0, 1) for a, b in rows], "doc_id long, text string, row string, hits int, removed int").repartition(3)
    out = line_dedup.dedup_units(df)
    assert out.columns == ["doc_id", "text", "row", "hits", "removed", "original_chars"]
    wanted, got = plain_dedup(keyed(df)), rows_of(out)
    assert sorted(((r[0], r[1], [tuple(s) for s in r[4]], r[5]) for r in got), key=str) == sorted(
        ((a, *wanted[a, b], None if b is None else len(b)) for a, b in rows), key=str)
    left = {(a, b): wanted[a, b][0] for a, b in rows}
    assert left[7, PASSAGE] == "" and left[1, rows[6][1]] != rows[6][1] or left[2, rows[7][1]] == "other words tail"
    assert sum(len(t) < len(b) for (_, b), t in left.items() if b) >= 12
    assert rows_of(line_dedup.dedup_units(df.limit(0))) == []


def test_substring_dedup_of_many_and_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(dealing, "OWNERS", 9)
    monkeypatch.setattr(dealing, "BLOCK_NUMBERS", 20)
    monkeypatch.setattr(dealing, "LARGEST", 1)
    rows = dedup_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = plain_dedup(keyed(df))
    assert sorted(((r.doc_id, r.text, [tuple(s) for s in r.removed]) for r in line_dedup.dedup_units(df).collect()), key=str) == sorted(
        ((a, *wanted[a, b]) for a, b in rows), key=str)


def test_a_passage_goes_from_its_first_word_to_its_last(spark):
    rows = [(1, PASSAGE), (2, f"some other beginning {PASSAGE} and some other end")]
    out = line_dedup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string"))
    # The first piece of the second text begins elsewhere, so its whole units begin later: the words before are found word by word.
    assert {r.doc_id: r.text for r in out.collect()} == {1: PASSAGE, 2: "some other beginning and some other end"}


# --- op5 -------------------------------------------------------------------------------------------------------------

def test_contained_items_match_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 6, 9, 20, 40, 70])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "w1 w2"), (None, items[0][1]), (3, items[3][1]), (103, "Dup dup dup dup dup dup dup dup")]
    docs = []
    for i in range(120):
        body = rng.choices(vocabulary, k=rng.choice([0, 3, 50, 300]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            part = rng.choice(items[:25])[1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = part
        docs.append((i, " ".join(body).upper() if i % 5 == 0 else "\n".join(body)))
    docs += [(500, None), (501, ""), (502, "W1  w2"), (503, "w1 w2 w3"), (None, items[1][1]), (0, docs[0][1]), (504, " ".join(["dup"] * 30)),
             (505, " ".join(rng.choices(vocabulary, k=30_000)) + " " + items[2][1])]
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int").repartition(3)
    b = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, hash string")
    wanted = []
    sets = [(i, shingles(t)) for i, t in items]
    for doc, text in docs:
        has = shingles(text)
        wanted += [(doc, i, len(s & has), len(s)) for i, s in sets if s and 100 * len(s & has) >= 75 * len(s)]
    out = decontaminate.contained_items(d, b)
    assert sorted((r[:4] for r in rows_of(out)), key=str) == sorted(wanted, key=str)
    bad = {doc for doc, *_ in wanted}
    left = decontaminate.without_contaminated(d, b)
    assert left.columns == d.columns
    texts = Counter(r[1] for r in rows_of(left))
    assert texts == Counter(t for i, t in docs if not any(s and 100 * len(s & shingles(t)) >= 75 * len(s) for _, s in sets)) and bad
    assert rows_of(decontaminate.contained_items(d.limit(0), b)) == rows_of(decontaminate.contained_items(d, b.limit(0))) == []


# --- op6, op3, op10 in Spark -----------------------------------------------------------------------------------------

def test_pages(spark):
    page = "<p>Site</p><p>{}</p><p>Contact</p>"
    rows = [(i, f"http://Host.example/a/{i}", page.format(f"story {i}")) for i in range(12)]
    rows += [(50, None, page.format("no url")), (51, "http://alone.example/", page.format("alone")), (52, "http://host.example/b/zz", page.format("far")),
             (53, "http://host.example/a/3", None), (54, "http://host.example/a/4", ""), (None, "x", "<article>in</article>out"), (0, *rows[0][1:]),
             (55, "http://host.example/b/aa", page.format("other"))]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, host string").repartition(3)
    out = html_extract.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = rows_of(out)
    assert len(got) == len(rows) and all(r[3] == len(r[2]) for r in got)
    texts = {(r[0], r[1]): r[2] for r in got}
    whole = "Site\n\n{}\n\nContact"
    assert texts[50, None] == whole.format("no url") and texts[51, rows[13][1]] == whole.format("alone")
    assert texts[None, "x"] == "in" and texts[53, rows[15][1]] == texts[54, rows[16][1]] == ""
    assert texts[52, rows[14][1]] == "far" and texts[55, rows[19][1]] == "other"
    assert [texts[i, rows[i][1]] for i in (0, 7, 11)] == ["story 0", "story 7", "story 11"]
    assert rows_of(html_extract.extract(df.limit(0))) == []


def test_nearest_prefers_the_longer_common_start(spark):
    rows = [("k1", "h", "/x/ab1"), ("k2", "h", "/x/ab12"), ("k3", "h", "/x/ab2"), ("k4", "h", "/x/zz"), ("k5", "h", "/y/zz"), ("k6", "g", "/x/ab1")]
    got = dict(rows_of(html_extract.nearest(spark.createDataFrame(rows, "page_key string, host string, path string"))))
    assert got == {"k1": "k2", "k2": "k1", "k3": "k2", "k4": "k1"}


def test_pages_alone_in_their_folder_get_a_neighbour(spark):
    rows = [("k1", "h", "/2024/05/one/index.html"), ("k2", "h", "/2024/05/two/index.html"), ("k3", "h", "/2024/06/x/"), ("k4", "h", "/2024/06/y/"),
            ("k5", "h", "/about/us"), ("k6", "g", "/en/742/"), ("k7", "g", "/en/913/"), ("k8", "g", ""), ("k9", "alone", "/a/b"),
            ("l1", "q", "/z/a"), ("l2", "q", "/z/b"), ("l3", "q", "/z/deep/er/c"), ("l4", "h", "/2024/05/twin/index.html")]
    df = spark.createDataFrame(rows, "page_key string, host string, path string")
    assert dict(rows_of(html_extract.nearest(df))) == {"k3": "k4", "k4": "k3", "k6": "k7", "k7": "k6", "l1": "l2", "l2": "l1"}
    got = dict(rows_of(html_extract.neighbours(df)))
    assert got.pop("k8") in ("k6", "k7") and got.pop("k5") in ("k1", "k3", "k4") and got.pop("l3") in ("l1", "l2")
    assert got == {"k1": "k2", "k2": "l4", "l4": "k2", "k3": "k4", "k4": "k3", "k6": "k7", "k7": "k6", "l1": "l2", "l2": "l1"}
    page = "<p>Site</p><p>{}</p><p>Contact</p>"
    pages = spark.createDataFrame([(i, f"http://h{p}", page.format(f"story {i}")) for i, (_, _, p) in enumerate(rows[:5])], "page_id long, url string, html string")
    assert sorted(r.text for r in html_extract.extract(pages).collect()) == [f"story {i}" for i in range(5)]


def test_token_counts_and_licenses_of_odd_rows(spark):
    rows = [(1, "ab a"), (None, "ab"), (2, None), (3, ""), (1, "ab a"), (4, "a " * 60_000), (5, "x\nReleased under the mit license! x Released under the MIT License")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, license string").repartition(2)
    scored = [("a", -1.0), ("b", -1.0), ("ab", -1.5), (token_counts.MARK, -1.0)]
    got = rows_of(token_counts.count_tokens(df, scored))
    assert sorted((r for r in got if r[0] != 5), key=str) == sorted([(1, 2, 4), (None, 1, 2), (2, 0, 0), (3, 0, 0), (1, 2, 4), (4, 60_000, 120_000)], key=str)
    assert rows_of(token_counts.count_tokens(df.limit(0), scored)) == rows_of(license_scan.scan_licenses(df.limit(0))) == []
    text = rows[-1][1]
    found = rows_of(license_scan.scan_licenses(df))
    assert [(r[0], r[1], r[2], text[r[5]:r[6]]) for r in found] == [(5, "mit", 1.0, "Released under the mit license"), (5, "mit", 1.0, "Released under the MIT License")]


def test_licenses_of_supplied_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {"apache-2.0": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.",
             "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0."}
    wanted = {(r.doc_id, k) for r in docs.collect() for k, v in lines.items() if v in r.text}
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(docs).where("coverage = 1").collect()}
    assert got == wanted and wanted


# --- op7 -------------------------------------------------------------------------------------------------------------

def test_url_rules(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("a.example.org", "/", "allow"),
             ("example.org", "/en/1", "allow"), ("Com", "", "block"), ("x.com", "/a", "block"), ("com", "/aaa", "allow")]
    urls = ["http://EXAMPLE.org/es/x", "https://b.example.org/en/123?q#f", "http://a.example.org/es/", "http://example.org", "http://notexample.org/es/",
            "ftp://com", "http://q.com?x", "http://x.com/aaa", None, "", "example.org/es/", "http:///es/", "http://example.org./es/", "http://exämple.org/" + "y" * 20_000]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] + [(0, urls[0], "old"), (None, urls[2], None)], "page_id long, url string, rule string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = rows_of(url_filters.filter_urls(df, r))

    def plain(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = [(len(h + p), len(h), v == "block", h.lower() + p, v) for h, p, v in rules if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        return host, path, max(fit)[3] if fit else None, max(fit)[4] if fit else "allow"

    assert sorted(got, key=str) == sorted([(i, u, *plain(u)) for i, u in enumerate(urls)] + [(0, urls[0], *plain(urls[0])), (None, urls[2], *plain(urls[2]))], key=str)
    assert rows_of(url_filters.filter_urls(df.limit(0), r)) == []
    assert {x[3:] for x in rows_of(url_filters.filter_urls(df, r.limit(0)).select("page_id", "host", "path", "rule", "verdict"))} == {(None, "allow")}


# --- op8 -------------------------------------------------------------------------------------------------------------

def plain_targets(words_of):
    names = sorted(words_of, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, full = 1.5 * sum(words_of.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        share = (budget - sum(full.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if weight[s] * share >= 2 * words_of[s]]
        if not over:
            return {**full, **{s: weight[s] * share for s in rest}}
        full.update({s: 2.0 * words_of[s] for s in over})


@pytest.mark.parametrize("seed", [0, 1])
def test_mix_meets_its_targets(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 7)
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "B", "ü", None, "hot", "hot", "hot"]), int(rng.lognormvariate(4, 1.5)) if rng.random() < 0.9 else 0) for i in range(900)]
    rows += [(i, "hot", 33) for i in range(1000, 1200)] + [(5, "B", 10), (5, "B", 10), (None, "B", 4), (2000, "void", 0)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, source string, size int, target double").repartition(3)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and mixing.mix(df).columns == ["doc_id", "source", "size", "source_size", "weight", "target", "rate", "copies"]
    words_of = defaultdict(int)
    for _, source, size in rows:
        words_of[source] += size
    wanted, taken, largest = plain_targets(words_of), defaultdict(int), defaultdict(int)
    for r in got:
        assert math.isclose(r.target, wanted[r.source], rel_tol=1e-9, abs_tol=1e-9) and r.source_size == words_of[r.source]
        assert 0 <= r.copies <= 2 and math.floor(r.rate) <= r.copies <= math.ceil(r.rate)
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= max(1, largest[source] / 4), (source, taken[source], target)
    again = sorted(map(tuple, mixing.mix(df.repartition(5)).select("doc_id", "size", "copies").collect()), key=str)
    assert again == sorted(((r.doc_id, r.size, r.copies) for r in got), key=str)
    rates = {(r.source, r.size): r.rate for r in got if r.size and r.rate < 2}
    for source in ("hot", "B"):
        logs = [(math.log(v) / k[1]) for k, v in rates.items() if k[0] == source]
        assert not logs or max(logs) - min(logs) < 1e-6 + 1e-6 * abs(max(logs))
    assert rows_of(mixing.mix(df.limit(0))) == []


# --- op9 -------------------------------------------------------------------------------------------------------------

def plain_features(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(found[i:i + 8]) for i in range(len(found) - 7)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(found)
    return n, sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_features_and_verdicts(spark):
    rng = random.Random(8)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += [None, "", " \n\t\x0b", "a b c d e f g h " * 2, "a b c d e f g h i j a b c d e f g h i j k", "🙂 ñ#* x y " * 30, "same line here\n" * 40,
              " ".join(rng.choices("abc", k=3000)), "w " * 40_000, texts[0], texts[0]]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, f_words int").repartition(4)
    got = {r.doc_id: r for r in quality_rules.score(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.f_words, r.f_chars, r.f_symbols, r.f_dup_lines, r.f_repeat, r.base_failed) == plain_features(t), t and t[:80]
        assert not (r.base_failed and r.kept)
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)
    assert rows_of(quality_rules.score(df.limit(0))) == rows_of(quality_rules.keep_good(df.limit(0))) == []


def test_label_model_recovers_accuracies():
    """Votes drawn from known accuracies: EM finds them, and its posterior beats the best single rule."""
    rng = random.Random(2)
    rules, right = ["r1", "r2", "r3", "r4", "r5"], [0.95, 0.9, 0.85, 0.8, 0.75]
    truth, patterns = [], Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        vote = tuple(0 if rng.random() < 0.2 else (1 if (rng.random() < a) == good else -1) for a in right)
        truth.append((vote, good))
        patterns[vote] += 1
    model = quality_rules.learn(sorted(patterns.items()), rules)
    assert abs(model["prior"] - 0.8) < 0.04
    for r, a in zip(rules, right):
        assert abs(model["accuracy"][r]["good"] - a) < 0.04 and abs(model["accuracy"][r]["bad"] - a) < 0.12
    up, down, base = quality_rules._odds(model)

    def says(vote):
        return base + sum(up[r] if v > 0 else down[r] if v < 0 else 0 for r, v in zip(rules, vote)) > 0

    mine = sum(says(v) == g for v, g in truth)
    assert mine > max(sum((v[j] >= 0) == g for v, g in truth) for j in range(5))
    assert quality_rules.learn([], rules)["prior"] == 0.9


def test_junk_of_the_supplied_labels_scores_lower(spark):
    sf = "/root/testdata/sf0.01"
    out = quality_rules.score(spark.read.parquet(f"{sf}/documents.parquet")).join(
        spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id")
    share = {r[0]: (r[1], r[2]) for r in out.where("NOT base_failed").groupBy("label").agg(F.avg(F.col("kept").cast("int")), F.count("*")).collect()}
    assert share[1][0] > 0.99 and share[0][0] < 0.5


def test_license_bound_is_never_under_the_alignment_and_spares_hopeless_ones():
    import time

    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(200):
        template, window = rng.integers(0, 9, 12).astype(np.uint64), rng.integers(0, 9, 24).astype(np.uint64)
        matched, _, _ = license_scan.align(template.tolist(), window.tolist())
        assert matched <= license_scan.most_matched(np.unique(template, return_counts=True), window)
    index = license_scan.Index(license_scan.TEMPLATES)
    hashes, _ = license_scan.word_hashes([b"the software is provided as is " * 4000], separators=license_scan.PUNCTUATION)
    start = time.perf_counter()
    license_scan.scan_words(hashes, index, 0.8)
    assert time.perf_counter() - start < 5
