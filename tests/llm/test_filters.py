"""Quality, licences, URL rules, WARC audit, extraction and the pipeline."""

import hashlib
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lakehook.llm import html_extract, license_scan, quality, url_filter, warc_audit
from lakehook.session import scratch_path
from tests.conftest import SMOKE_DIR
from tests.llm.cases import awkward, prose

SF = SMOKE_DIR.replace("sf0.001", "sf0.01")


def planted(spark, n=600):
    rng = random.Random(4)
    rows = [(k, prose(rng, rng.randint(5, 80)) if k % 5 else " ".join(w.upper() + "!!" for w in prose(rng, 40).split()))
            for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, docs.selectExpr("doc_id", "cast(doc_id % 5 <> 0 as int) as quality")


def test_quality_on_held_out_rows(spark):
    docs, labels = planted(spark)
    model = quality.train(docs, labels)
    rows = (quality.score(docs, model).where(quality.remainder("doc_id") == 0).join(labels, "doc_id").collect())
    assert len(rows) > 80
    right = sum((r["score"] >= quality.THRESHOLD) == (r["quality"] == 1) for r in rows)
    assert right >= 0.97 * len(rows)


def test_quality_learns_no_held_out_label(spark):
    docs, labels = planted(spark, 200)
    flipped = labels.withColumn("quality", F.when(quality.remainder("doc_id") == 0, 1 - F.col("quality"))
                                .otherwise(F.col("quality")).cast("int"))
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert a.bias == b.bias and np.array_equal(a.weights, b.weights)


def test_quality_scorer_equals_the_model_on_features():
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=quality.BUCKETS).astype(np.float32), 0.3)
    for text in ("a", "One two, two THREE!!! ß 3x", "x " * 5000, "\x00 \x1c é"):
        f, w = quality.document_features(text)
        odds = model.bias + float((model.weights[f] * w).sum())
        assert abs(quality.Scorer(model).scores([text])[0] - 1 / (1 + np.exp(-odds))) < 1e-4


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    _, labels = planted(spark, 5)
    model = quality.train(docs, labels.limit(0))
    rows = quality.score(docs.drop("score"), model).collect()
    assert len(rows) == docs.count() and all(r["score"] == 0.5 for r in rows)
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.keep_good(docs.limit(0), model).count() == 0


def test_licences(spark):
    mit = next(t for i, t in license_scan.KNOWN if len(t) > 800)
    changed = mit.replace("<year> <copyright holders>", "2020 Someone, Inc.").replace("LIABLE", "liable").replace(
        '"AS IS"', "“as is”").replace("\n\n", "\n \n").replace("sublicense", "sub-licence")
    docs = spark.createDataFrame([(1, mit), (2, changed), (3, changed + " more"), (4, "x\nAll rights  reserved!\ny"),
                                  (5, None), (6, ""), (7, "released under the MIT licence")],
                                 "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["notices"], r["n_notices"]) for r in license_scan.scan(docs).collect()}
    assert got[1][0] == got[2][0] == got[7][0] == "MIT" and got[3][0] is None
    assert got[4] == (None, "LicenseRef-all-rights-reserved", 1) and got[5] == got[6] == (None, None, 0)
    assert license_scan.scan(awkward(spark)).count() == awkward(spark).count()
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_licences_that_a_caller_adds(spark, monkeypatch):
    mine = spark.createDataFrame([("House-1.0", "House Licence\nCopyright 2020 X\nYou may look."), ("Again", "house license you may look"),
                                  ("Not-MIT", "Released under the MIT License."), (None, "nobody's"), ("Empty-Text", None)],
                                 "license string, text string")
    docs = spark.createDataFrame([(1, "HOUSE LICENSE\n(c) 1999 Y\n\nYou may look!"), (2, "Released under the MIT License"), (3, "nobody's"),
                                  (4, "a\nyou may look\nreleased under the mit licence"), (None, None)], "doc_id long, text string")
    for rows in (license_scan.BROADCAST_ROWS, 0):
        monkeypatch.setattr(license_scan, "BROADCAST_ROWS", rows)
        got = {r["doc_id"]: (r["license"], r["notices"]) for r in license_scan.scan(docs, known=mine).collect()}
        assert got[1][0] == "Again" and got[2][0] == "MIT" and got[3][0] is None and got[4] == (None, "MIT")
        assert got[None] == ("Empty-Text", None)


def test_whole_licences_as_distributed(spark):
    import glob

    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0",
             "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    found = {f.rsplit("/", 1)[-1]: f for f in glob.glob("/usr/share/common-licenses/*")}
    texts = [(k, open(found[n], encoding="utf-8", errors="replace").read(), i) for k, (n, i) in enumerate(names.items()) if n in found]
    docs = spark.createDataFrame([(k, t.replace("\n", " \n").upper().replace("https", "http")) for k, t, _ in texts] + [(-1, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(docs).collect()}
    assert all(got[k].startswith(i) for k, _, i in texts)


def page(key, url):
    return (key, url, "x")


def test_url_parts_and_fixed_rules(spark):
    urls = [None, "", "no scheme", "http://WWW.Example.NET/en/x?q#f", "http://example.net?x=/en/", "ftp://a.example.com/de/",
            "https://example.com/DE/", "http://x.org/fr/1", "http://notexample.net/en/", "http://net/", "http://", "a://b#/c"]
    pages = spark.createDataFrame([(k, u, 0) for k, u in enumerate(urls)], "page_id long, url string, host int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: tuple(r)[1:5] for r in url_filter.judge(pages, labels).collect()}
    assert [got[k] for k in range(len(urls))] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("www.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "", None, "allow"),
        ("a.example.com", "/de/", "example.com/de/", "block"), ("example.com", "/DE/", None, "allow"),
        ("x.org", "/fr/1", "org/fr/", "allow"), ("notexample.net", "/en/", "net/", "block"),
        ("net", "/", "net/", "block"), ("", "", None, "allow"), ("b", "", None, "allow")]


def test_mined_url_rules_match_brute_force(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for k in range(800):
        host = rng.choice(["good.example.org", "spam-farm.example.org", "cheap.example.com"])
        path = rng.choice(["news", "bets"])
        bad = host.startswith("spam") and rng.random() < 0.9 or host.startswith("cheap") and path == "bets"
        rows.append((k, f"http://{host}/{path}/{k}"))
        marks.append((k, 0 if bad else 1, 0))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, labels).collect()}
    described = {r["page_id"]: set(r["tokens"]) for r in url_filter.describe(pages).collect()}
    rules = [(set(r["tokens"]), r["confidence"]) for r in url_filter.mine(url_filter.describe(pages), labels).collect()]
    for k, tokens in described.items():
        assert (verdicts[k] == "block") == any(r <= tokens for r, _ in rules)
    for r, sure in rules:
        hits = [k for k, t in described.items() if r <= t]
        assert abs(sum(marks[k][1] == 0 for k in hits) / len(hits) - sure) < 1e-9 and sure >= url_filter.CONFIDENCE
    for k, url in rows:
        assert (verdicts[k] == "block") == ("spam-farm" in url or "cheap" in url and "bets" in url)


def test_every_bad_host_keeps_its_url_rule(spark):
    # one rule a host and name; what else is mined of a host is as confident as these
    hosts = [f"bad{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    rows = [f"https://{h}.example.com/en/{w}.html" for h in hosts for w in ("news", "bets")]
    rows += [f"https://good{k}.example.com/en/{w}.html" for k in range(100) for w in ("news", "bets")]
    rows = [(k, f"{u[:-5]}/{k}") for k, u in enumerate(rows)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, int("//bad" not in u), 0) for k, u in rows], "doc_id long, quality int, toxic int")
    rules = {tuple(r["tokens"]) for r in url_filter.mine(url_filter.describe(pages), labels).collect()}
    assert {(f"{kind}:{h}",) for h in hosts for kind in ("host3", "name")} <= rules
    assert not any(len(r) > 1 and any("bad" in x for x in r) for r in rules)
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, labels).collect()}
    assert all(verdicts[k] == "block" for k, u in rows if "//bad" in u)


def test_long_url_words_are_told_apart(spark):
    long = "w" * 64
    urls = [f"http://h/{long}a", f"http://h/{long}b", f"http://h/?{long}a=1", f"http://h/?{long}b=1", f"http://h/{long}",
            f"{'s' * 16}a://h/", f"{'s' * 16}b://h/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = [tuple(sorted(r["tokens"])) for r in url_filter.describe(pages).collect()]
    assert len(set(rows)) == len(urls) and any(f"path:{long}" in r for r in rows)


def test_url_rules_of_many_tokens(spark):
    # bad are only pages with all four words, any three of which good pages have too
    words = ["aa", "bb", "cc", "dd"]
    rows = [("/".join(words), 0)] * 30 + [("/".join(w for w in words if w != x), 1) for x in words for _ in range(30)]
    pages = spark.createDataFrame([(k, f"http://h.example.org/{w}/{k}") for k, (w, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(k, q, 0) for k, (_, q) in enumerate(rows)], "doc_id long, quality int, toxic int")
    rules = [r["tokens"] for r in url_filter.mine(url_filter.describe(pages), labels).collect()]
    assert rules == [[f"path:{w}" for w in words]]
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, labels).collect()}
    assert all((verdicts[k] == "block") == (q == 0) for k, (_, q) in enumerate(rows))


def test_url_rules_rest_on_more_than_one_page(spark):
    rows = [(k, f"http://only{chr(97 + k)}.example.org/z/{k}") for k in range(10)]
    rows += [(100 + k, f"http://twice.example.org/y/{100 + k}") for k in range(2)]
    rows += [(200 + k, f"http://fine{k % 7}.example.org/z/{200 + k}") for k in range(30)]
    marks = [(k, int(k >= 200), 0) for k, _ in rows] + [(None, 0, 0), (3, None, 1), (999, 0, 1)]
    odd = [(None, "http://twice.example.org/y/5"), (7, None), (100, rows[10][1]), (100, rows[10][1])]
    pages = spark.createDataFrame([(k, u, "t", 1.0, "x") for k, u in rows + odd],
                                  "page_id long, url string, tokens string, confidence double, rule string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = url_filter.judge(pages, labels).collect()
    assert len(got) == len(rows) + len(odd)
    blocked = {r["host"] for r in got if r["verdict"] == "block"}
    assert blocked == {"twice.example.org"}
    alone = {r["host"] for r in url_filter.judge(pages, labels, min_pages=1).collect() if r["verdict"] == "block"}
    assert alone >= {r[1].split("/")[2] for r in rows[:10]}
    for some, marks_ in ((pages.limit(0), labels), (pages, labels.limit(0))):
        assert {r["verdict"] for r in url_filter.judge(some, marks_).collect()} <= {"allow"}


def test_url_rules_hold_on_pages_that_did_not_teach_them(spark):
    rng = random.Random(4)
    rows = []
    for k in range(1200):
        bad = rng.random() < 0.3
        host = f"{rng.choice(['casino', 'pills'])}{rng.randint(0, 5)}" if bad else f"news{rng.randint(0, 40)}"
        rows.append((k, f"http://{host}.example.org/{rng.choice(['a', 'b', 'c'])}/{k}", bad))
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    labels = spark.createDataFrame([(k, int(not bad), 0) for k, _, bad in rows if k % 2], "doc_id long, quality int, toxic int")
    verdict = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, labels).collect()}
    held = [(bad, verdict[k] == "block") for k, _, bad in rows if k % 2 == 0]
    assert sum(b and v for b, v in held) >= 0.95 * max(1, sum(v for _, v in held))
    assert sum(b and v for b, v in held) >= 0.9 * sum(b for b, _ in held)


def test_warc_audit_of_repeated_rows_and_text_keys(spark):
    rows = [("13", "u", "x" * 50)] * 4 + [("7", "u", "lost")] * 2 + [("abc", "u", "text key")] * 2 + [(None, None, None), ("200", "u", "é")]
    pages = spark.createDataFrame([(*r, "f", 1) for r in rows], "page_id string, url string, html string, file string, offset int")
    both = warc_audit.materialise(warc_audit.index(warc_audit.worn(warc_audit.records(pages)), "worn"), "test-worn")
    second = both.where("worn is not null").select("file", "offset", "worn.length", "worn.digest", "id")
    got = warc_audit.audit(both.drop("worn"), second).collect()
    count = lambda i: sorted(r["status"] for r in got if r["id"] == i)
    assert len(got) == len(rows) and count(13) == ["damaged"] * 4 and count(7) == ["missing"] * 2
    assert count(None) == ["ok"] * 3 and count(200) == ["ok"]
    assert len({(r["file"], r["offset"]) for r in got}) == len(rows)


def test_warc_audit_finds_just_the_faults(spark):
    rng = random.Random(7)
    pages = spark.createDataFrame([(k, f"http://h/{k}", prose(rng, rng.randint(0, 400))) for k in range(2500)]
                                  + [(None, None, None), (3, "again", "x")], "page_id long, url string, html string")
    rows = warc_audit.records(pages)
    first = warc_audit.materialise(warc_audit.index(rows), "test-one")
    for r in rows.limit(50).collect():
        head, body = r["record"].split("\r\n\r\n", 1)
        assert f"Content-Length: {len(body.encode()) - 4}" in head
    assert {r["status"] for r in warc_audit.audit(first, first).collect()} == {"ok"}
    hit = F.col("id").isin(17, 1500)
    second = first.where("id is null or id <> 900").withColumn(
        "digest", F.when(hit, F.lit("0" * 64)).otherwise(F.col("digest")))
    got = {r["id"]: r["status"] for r in warc_audit.audit(first, second).collect() if r["status"] != "ok"}
    assert got == {17: "damaged", 1500: "damaged", 900: "missing"}
    back = {r["id"]: r["status"] for r in warc_audit.audit(second, first).collect() if r["status"] != "ok"}
    assert back == {17: "damaged", 1500: "damaged", 900: "extra"}
    assert warc_audit.audit(first.limit(0), first.limit(0)).count() == 0


def test_warc_tree_equals_plain_hashing(spark):
    first = spark.createDataFrame([(0, k * 40_000, 1, f"{k:064d}", k) for k in range(6)],
                                  "file long, offset long, length long, digest string, id long")
    sha = lambda parts: hashlib.sha256("\n".join(parts).encode()).hexdigest()
    ranges = {}
    for k in range(6):
        ranges.setdefault(k * 40_000 // warc_audit.LEAF_RANGE, []).append(f"{k * 40_000}:{k:064d}")
    low = {r: sha(p) for r, p in ranges.items()}
    assert {r["range"]: r["digest"] for r in warc_audit.tree(first)[0].collect()} == low
    node = sha([f"{r}:{d}" for r, d in sorted(low.items())])
    for _ in range(warc_audit.LEVELS - 2):
        node = sha([f"0:{node}"])
    assert warc_audit.tree(first)[-1].first()["digest"] == sha([f"0:{node}"])


ARTICLE = ("<h1>A title</h1><p>First &amp; long enough paragraph of the story, with <a href=x>a link</a> in it.</p>"
           "<p>Second\n  paragraph that goes on for a good while, too.</p>")
TEXT = ("A title\nFirst & long enough paragraph of the story, with a link in it.\n"
        "Second paragraph that goes on for a good while, too.")


def test_extraction_of_planted_pages(spark):
    pages, docs = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "documents"))
    model = html_extract.train(pages, docs, 120)
    frames = ['<nav><a href="/">Home</a> <a href="/n">News</a></nav>', '<div class="cookie-notice">We use cookies.</div>',
              '<header><p>The Daily</p></header>', "<script>var a='<p>no</p>';</script><style>p{}</style>", "<!-- <p>no</p> -->"]
    after = ['<footer><p>Copyright someone.</p></footer>', '<div id="comments"><p>I liked this a lot, thanks!</p></div>',
             '<aside class="sidebar"><p>Most read stories of today.</p></aside>', '<form><label>Mail</label><input></form>']
    for opening, closing in (("<article>", "</article>"), ('<div class="post-content">', "</div>"), ("<main>", "")):
        html = f"<html><body>{''.join(frames)}{opening}{ARTICLE}{closing}{''.join(after)}</body></html>"
        assert html_extract.main_text(html, model) == TEXT
    odd = spark.createDataFrame([(1, "u", None, 0), (2, None, "", 1), (3, "u", "<<<>>> </p></div>", 2), (3, "u", "<p", 3),
                                 (None, "u", "<p>" * 3000 + "x", 4)], "page_id long, url string, html string, text int")
    rows = html_extract.extract(odd, model).collect()
    assert len(rows) == 5 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert {r["text"] for r in rows if r["page_id"] in (1, 2)} == {""}
    assert html_extract.extract(odd.limit(0), model).count() == 0
    whole = html_extract.extract(pages, model).join(pages.select("page_id", "html"), "page_id").collect()
    inside = sum(r["text"].count("\n") + 1 >= r["html"].split("<article>")[1].split("<footer")[0].count("<p>") - 2
                 for r in whole if "<article>" in r["html"])
    assert inside > 0.9 * len(whole)


def test_quotes_in_attributes_and_pages_without_text(spark):
    texts = lambda html: html_extract.parse(html)[1]
    page = "<article><p title=it's>First para.</p><p>Second, isn't long.</p><p>Third.</p></article>"
    assert texts(page) == ["First para.", "Second, isn't long.", "Third."]
    assert texts('<p title="abc>One</p><p>Two</p>') == ["One", "Two"]
    assert texts("<p a=x/y b='1>2' c>Three</p><br/>x <a href=http://x/?a=1>l</a><p\nclass = 'y'>Four<p id>Five") == \
        ["Three", "x l", "Four", "Five"]
    assert html_extract._signs(" class = 'nav-bar x' id=Footer") == {"menu", "foot"}
    # hidden text is judged like any other
    assert texts("<article hidden><p aria-hidden=true>One</p></article>") == ["One"]
    # labelled pages without any text leave the frames to learn from
    pages = spark.createDataFrame([(1, "http://a.b/1.html", ""), (2, "http://a.b/2.html", None)], "page_id long, url string, html string")
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    model = html_extract.train(pages, docs)
    assert [r["text"] for r in html_extract.extract(pages, model).collect()] == ["", ""]
    assert html_extract.main_text(f"<body><nav><a href=/>Home</a></nav><article>{ARTICLE}</article></body>", model) == TEXT


def test_nested_tags_take_time_in_proportion():
    for page in ("<div>" * 50_000 + "x" + "</i>" * 50_000, "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000 + "x",
                 "<b>" * 50_000 + "<div>a</div>" * 5_000, '<p t="' * 50_001 + "x", "<head>" * 50_000 + "x"):
        began = time.process_time()
        root, texts, _ = html_extract.parse(page)
        if texts:
            nodes, _ = html_extract.describe(root, texts)
            assert html_extract.decode(root, nodes, [1.0] * len(nodes), texts) == list(range(len(texts)))
        assert time.process_time() - began < 20


def test_extraction_of_pages_that_omit_the_end_of_head(spark):
    texts = lambda html: html_extract.parse(html)[1]
    for head in ("<head><title>no</title>", "<head><meta charset=utf-8><style>no</style><script>no</script>\n",
                 "<head hidden><title>no</title><noscript>no</noscript>", "<head><noframes>no"):
        for body in ("<body><p>One</p><p>Two</p></body></html>", "<p>One</p><p>Two", "<body hidden=no>"):
            want = [] if "hidden" in body else ["One", "Two"]
            assert texts(f"<html>{head}{body}") == want
            assert texts(f"<html>{head}</head>{body}") == want
    assert texts("<head><title>no</title>One<p>Two") == ["One", "Two"]
    assert texts("<head></head><body><p>One<head><p>Two") == ["One", "Two"]
    pages, docs = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "documents"))
    model = html_extract.train(pages, docs, 120)
    html = f"<html><head><title>T</title><body><nav><a href=/>Home</a></nav><article>{ARTICLE}</article></body></html>"
    assert html_extract.main_text(html, model) == TEXT


def test_decoding_never_contradicts_itself():
    rng = np.random.default_rng(1)
    for _ in range(50):
        html = "".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "some words here ", "<b>", "</b>", "<br>", "<li>"])
                       for _ in range(60))
        root, texts, _ = html_extract.parse(html)
        if texts:
            nodes, x = html_extract.describe(root, texts)
            taken = html_extract.decode(root, nodes, rng.normal(size=len(nodes)).tolist(), texts)
            assert taken == sorted(set(taken)) and all(0 <= b < len(texts) for b in taken)
            assert html_extract.decode(root, nodes, [9.0] * len(nodes), texts) == list(range(len(texts)))
            assert html_extract.decode(root, nodes, [-9.0] * len(nodes), texts) == []


def test_pipeline_stage_by_stage(spark):
    from tests.llm.test_dedup import brute_links, components, shingle_sets

    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    kept = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = scratch_path(spark, f"stage{number}")
        stage(spark, docs, SMOKE_DIR).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if number < 3:
            assert docs.columns == before.columns
        kept.append((before.collect(), docs.collect()))
    norm = lambda t: " ".join((t or "").split())
    (_, good), (_, distinct), (near_in, near_out), (last, pieces) = kept
    assert {r["doc_id"] for r in distinct} == {min(s["doc_id"] for s in good if norm(s["text"]) == norm(r["text"])) for r in good}
    sets = shingle_sets([(r["doc_id"], r["text"]) for r in near_in])
    groups = components(list(sets), brute_links(sets))
    assert {r["doc_id"] for r in near_out} == set(groups.values())
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in last}
    assert corpus_pipeline.run(spark, SMOKE_DIR).count() == len(pieces)


def test_pipeline_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(None, None, 1), (6, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int")
    for rows in (docs, docs.limit(0)):
        folder = scratch_path(spark, "awkward")
        rows.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        pieces = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
        # without usable labels all documents are kept; of equal texts the one with the smallest id, nulls last
        norm = lambda t: " ".join(x for x in re.split(r"[\x20\x09-\x0D]+", t or ""))
        kept = {}
        for r in rows.collect():
            kept.setdefault(norm(r["text"]), []).append(r["doc_id"])
        want = sorted((min((i is None, i or 0) for i in ids) for ids in kept.values()))
        assert sorted((p["doc_id"] is None, p["doc_id"] or 0) for p in pieces if p["start"] == 0) == want
        assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if p["start"] == 0)
