"""Small cases of the operators that work text by text: nulls, empty and long texts, ties, clashing columns, brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnfeat.llm import bpe, decontaminate, fingerprint, html_text, licenses, quality, token_files, url_filter

LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(20_000))
TEXTS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"), (2, ""), (3, None), (5, LONG), (5, LONG), (None, "no identifier here"), (9, "  two  spaces\n\n and\ttabs éÉß don't 42!! "), (10, "一二三   漢字 <|endoftext|> x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_many_url_rules(spark):
    rng = np.random.default_rng(31)
    part = lambda: str(rng.choice(["a", "bb", "ccc", "net", "com"]))
    host = lambda n: ".".join(part() for _ in range(n))
    path = lambda n: "/" + "/".join(part() for _ in range(n))
    rules = [(str(rng.choice(["allow", "block"])), host(int(rng.integers(1, 4))), path(int(rng.integers(0, 4)))) for _ in range(300)]
    urls = [f"http://{host(int(rng.integers(1, 6)))}{path(int(rng.integers(0, 6)))}" for _ in range(400)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.rule_table(spark, rules)).collect()}
    for i, u in enumerate(urls):
        h, p = re.fullmatch(r"http://([^/]*)(.*)", u).groups()
        fits = [(len(x + y), v == "block", x + y, v) for v, x, y in rules if (h == x or h.endswith("." + x)) and p.startswith(y)]
        assert got[i] == (max(fits)[2:] if fits else (None, "allow"))


def test_url_rules_and_edges(spark):
    urls = ["http://a.net/es/x", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com/en/", "http://example.com", "http://x.com/#/en/", None, "no scheme", "http://notexample.com/en/", "http://net/fr/", "ftp://u@b.org:80/p"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "y")], "page_id long, url string, rule string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, url_filter.rule_table(spark)).collect())
    salted = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, url_filter.rule_table(spark), broadcast_rules=0).collect())

    def brute(i, u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        return i, host, path, rule, verdict

    assert got == salted == sorted(brute(i, u) for i, u in [*enumerate(urls), (0, urls[0])])
    assert url_filter.filter_urls(pages.where("false"), url_filter.rule_table(spark)).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, url_filter.rule_table(spark).where("false")).collect()} == {"allow"}


def test_equal_rules_block(spark):
    rules = url_filter.rule_table(spark, [("allow", "com", "/"), ("block", "com", "/"), ("allow", None, "/")])
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.filter_urls(pages, rules).first()["verdict"] == "block"


def test_fingerprints(docs, empty):
    rows = {(r["doc_id"], r["n_chars"]): r for r in fingerprint.compare_with_edits(docs).collect()}
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    for i, (doc, text) in enumerate(order):
        text, other = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        r = rows[doc, len(text)]
        if order[i][0] != 5:
            assert r["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + other[:half]).encode()).hexdigest()
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert len({r["fingerprint"] for r in fingerprint.fingerprints(docs).where("doc_id = 5").collect()}) == 1
    assert fingerprint.compare_with_edits(empty).count() == 0
    assert fingerprint.compare_with_edits(docs.where("doc_id = 1")).first()["near_next"] == 1.0


def test_fingerprint_likeness_falls_with_edits():
    words = [f"t{i}" for i in range(400)]
    a = fingerprint.fingerprint(" ".join(words).encode(), np.zeros(0, np.uint64))
    near = [fingerprint.likeness(a, fingerprint.fingerprint(" ".join(words[: 400 - n] + [f"u{i}" for i in range(n)]).encode(), np.zeros(0, np.uint64))) for n in (0, 20, 100, 400)]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3]


@pytest.mark.parametrize("limit", [1000, 0])
def test_fingerprint_lexicon_counts_distinct_texts(spark, limit):
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(400)]
    one, texts = " ".join(f"one{i}" for i in range(120)), [" ".join(rng.choice(words, 60)) for _ in range(80)]
    texts = [one if i % 3 == 0 else t for i, t in enumerate(texts)] + [texts[1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    distinct = set(texts)
    seen = Counter(x for t in distinct for x in set(fingerprint.terms(t.encode()).tolist()))
    found = fingerprint.lexicon(df, broadcast_texts=limit)
    assert found.tolist() == sorted(x for x, n in seen.items() if n <= 0.2 * len(distinct))
    # A third of the rows are one text; half of it followed by half of another is still like it.
    rows = [r for r in fingerprint.compare_with_edits(df).collect() if r["doc_id"] % 3 == 0 and r["doc_id"] < 80]
    assert len(rows) == 27 and all(r["near_edited"] > 0 for r in rows)


def brute_fingerprint(text, band):
    """Part by part and term by term, in Python's integers."""
    full = (1 << 64) - 1

    def mix(x):
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53), (32, 1)):
            x = (x ^ x >> shift) * factor & full
        return x

    own = set(fingerprint.terms(text.encode()).tolist())
    out = []
    for g, (one_in, n) in enumerate(fingerprint.GROUPS):
        mixed = [mix(t ^ int(fingerprint._SEEDS[g, 0])) for t in (own if g < len(fingerprint.ALL_GROUPS) else own & band)]
        for i in range(n):
            some = [x for x in mixed if x % one_in == i]
            out.append(f"{mix(sum(some) & full) % 16**6:06x}" if some else "-" * 6)
    return "".join(out)


def test_fingerprint_parts(spark):
    rng = np.random.default_rng(9)
    words = [f"p{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 80, 40)]
    seen = Counter(x for t in set(texts) for x in set(fingerprint.terms(t.encode()).tolist()))
    band = {x for x, n in seen.items() if n <= 0.2 * len(set(texts))}
    for r in fingerprint.compare_with_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect():
        own, other = texts[r["doc_id"]], texts[(r["doc_id"] + 1) % len(texts)]
        half = len(own) // 2
        a, b, y = (brute_fingerprint(t, band) for t in (own, other, own[: len(own) - half] + other[:half]))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (a, y)
        for near, z in ((r["near_edited"], y), (r["near_next"], b)):
            parts = [(a[i : i + 6], z[i : i + 6]) for i in range(0, len(a), 6)]
            either = [p for p in parts if p != ("-" * 6, "-" * 6)]
            assert near == pytest.approx(sum(p == q for p, q in either) / len(either))


def test_fingerprint_lexicon_has_no_limit_by_size(spark):
    # 1,200,000 terms, each in one of six texts: all of them are in the band.
    texts = spark.range(6).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(0, 199999), i -> concat('t', id, 'x', i)), ' ')").alias("text"))
    assert len(fingerprint.lexicon(texts)) == 1_200_000


def test_fingerprint_has_no_jump_with_few_band_terms():
    own, other = [f"a{i}" for i in range(100)], [f"b{i}" for i in range(100)]
    band = np.sort(fingerprint.terms(" ".join(other).encode()))
    a, y = (fingerprint.fingerprint(" ".join(x).encode(), band) for x in (own, own[:50] + other[:50]))
    assert fingerprint.likeness(a, y) > 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site"><h1>Site</h1></header><nav><ul><li><a href=1>One</a></li></ul></nav>
<div id="cookie-banner">We use cookies &amp; more</div><article><h1>Title</h1><p>First &lt;para&gt; with <b>bold</b>text
and   space.<p>Second&nbsp;one, long enough to be read as a paragraph.<br>Line</p><div class="ad">Buy</div><ul><li>item</li></ul><form><input><p>Your name</p></form></article>
<section class="comments"><p>A comment that is long enough to look like text of the page, by a reader.</p></section><aside><p>Side text, also rather long, with many words in it.</p></aside><footer>&copy; me</footer><script>var x = "</p>";</script></body>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title\nFirst <para> with boldtext and space.\nSecond one, long enough to be read as a paragraph. Line\nitem"
    assert [html_text.main_text(x) for x in (None, "", "<nav><a>x</a></nav>", "plain")] == ["", "", "", "plain"]
    assert html_text.main_text("<p>a < b and <unclosed 'quote <p>c") != "" and html_text.main_text("<div>" * 3000 + "deep text" + "</div>" * 3000) == "deep text"
    assert len(html_text.main_text("<p>" + LONG + "</p>")) == len(LONG)


def test_minimum_cut_against_all_labellings():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(1, 8))
        a, b = rng.integers(0, 9, n).tolist(), rng.integers(0, 9, n).tolist()
        edges = [(int(i), int(j), float(c)) for i in range(n) for j in range(i) if (c := rng.integers(0, 4))]
        cost = lambda x, a=a, b=b, edges=edges: sum(b[i] if v else a[i] for i, v in enumerate(x)) + sum(c for i, j, c in edges if x[i] != x[j])
        least = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(html_text.minimum_cut(a, b, edges)) == pytest.approx(least)


def test_main_text_by_brute_force(spark):
    """The whole operator on made pages: of all labellings of a page's blocks, the one with the least cost gives the text."""
    rng, model = np.random.default_rng(77), html_text.fitted()
    pages = [x for x in (html_text.training_page(rng) for _ in range(150)) if len(list(html_text.blocks(x))) <= 11]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).collect()}
    wrong = alone = n = 0
    for i, page in enumerate(pages):
        found = list(html_text.blocks(page))
        z = model.odds(found)
        edges = [(a, b, model.smooth[kind]) for a, b, kind in html_text._neighbours(found)]
        cost = lambda x, z=z, edges=edges: sum(np.logaddexp(0, -o if v else o) for o, v in zip(z, x, strict=True)) + sum(w for a, b, w in edges if x[a] != x[b])
        best = min(([bool(k >> j & 1) for j in range(len(found))] for k in range(1 << len(found))), key=cost)
        labels = model.labels(found)
        assert cost(labels) == pytest.approx(cost(best), abs=0.01 * len(found))
        assert got[i] == "\n".join(b.text for b, x in zip(found, labels, strict=True) if x)
        truth = [b.text.startswith("+") for b in found]
        n, wrong = n + len(found), wrong + sum(x != y for x, y in zip(labels, truth, strict=True))
        alone += sum(x != y for x, y in zip(model.labels(found, smooth=False), truth, strict=True))
    assert len(pages) > 20 and wrong <= 0.05 * n and wrong <= alone + 2


def test_cut_overrules_the_classifier():
    # By itself a block of links in a box without a name is boilerplate; among paragraphs of an article it is kept, and alone it isn't.
    model = html_text.Cutter(html_text.fitted().mean, html_text.fitted().scale, html_text.fitted().weights, (0.8,) * len(html_text.fitted().smooth))
    prose = "<p>A sentence that is long enough to be read as a part of the article, with some words more.</p>"
    rng = np.random.default_rng(5)
    n = changed = better = 0
    for _ in range(200):
        found = list(html_text.blocks(html_text.training_page(rng)))
        truth = [b.text.startswith("+") for b in found]
        with_, without = html_text.fitted().labels(found), html_text.fitted().labels(found, smooth=False)
        n += len(found)
        changed += sum(x != y for x, y in zip(with_, without, strict=True))
        better += sum((x == t) - (y == t) for x, y, t in zip(with_, without, truth, strict=True))
    assert changed > 0 and better > 0
    page = f'<article>{prose}{prose}<ul><li><a href="/x">and more</a></li></ul>{prose}{prose}</article>'
    found = list(html_text.blocks(page))
    z = model.odds(found)
    low = html_text.minimum_cut([3.0, 3.0, 0.4, 3.0, 3.0], [0.1, 0.1, 0.9, 0.1, 0.1], [(i, i + 1, 0.8) for i in range(4)])
    assert low == [True] * 5 and len(z) == 5 and html_text.changed_by_cut([page, None])[0] == 5


def test_quality_dictionaries_hold_all_chosen_rows(spark):
    texts = [(i, f"<{i}>" + "".join(chr(97 + (i * j) % 26) for j in range(700))) for i in range(3200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = quality.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    for body in (model.good, model.bad):
        excerpts = [x.decode() for x in body.split(b"\n")]
        assert len(excerpts) == quality.DICTIONARY_ROWS and all(x == dict(texts)[int(x[1 : x.index(">")])][: quality.EXCERPT_BYTES] for x in excerpts)


@pytest.mark.parametrize("most", [700, 9000, 80_000])
def test_quality_compressors_use_every_row_of_a_dictionary(most):
    """A block of each chosen text is found in it, however large the dictionary would be."""
    rng = np.random.default_rng(most)
    texts = [(i, rng.integers(97, 123, int(rng.integers(300, most)), dtype=np.uint8).tobytes()) for i in range(quality.DICTIONARY_ROWS)]
    body = quality.dictionary(texts)
    assert len(body) <= quality.DICTIONARY_BYTES
    parts = body.split(b"\n")
    assert len(parts) == len(texts) and all(p in t for p, (_, t) in zip(parts, texts, strict=True))
    if sum(len(t) for _, t in texts) < quality.DICTIONARY_BYTES - 1000:
        assert parts == [t for _, t in texts]
    good, bad, plain = quality.Model(body, b"", *(np.zeros(1),) * 3).compressors()
    sizes = [(len(good.compress(p[: quality.BLOCK_BYTES])), len(plain.compress(p[: quality.BLOCK_BYTES]))) for p in parts]
    assert all(x < 64 < y for x, y in sizes)


def test_quality_learns_repeated_rows_once(spark):
    rows = [(i, f"text {i} " + ("calm river " if i % 2 else "BUY NOW ") * 20) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    one, many = quality.train(docs, labels), quality.train(docs.union(docs).union(docs), labels.union(labels))
    assert (one.good, one.bad) == (many.good, many.bad) and np.array_equal(one.weights, many.weights)


def test_quality_scores_against_plain_python(spark, docs):
    import math

    import zstandard

    rng = np.random.default_rng(5)
    known = [(i, " ".join(rng.choice(["calm", "river", "stone"] if i % 2 else ["BUY", "NOW", "!!"], 50))) for i in range(60)]
    known_docs = spark.createDataFrame(known, "doc_id long, text string")
    model = quality.train(known_docs, known_docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))

    def brute(text):
        data = (text or "").encode()
        plain = {"level": 5, "write_content_size": False}
        size = lambda body, x: len(zstandard.ZstdCompressor(**({"compression_params": quality._parameters(), "dict_data": zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if body else plain)).compress(x))
        blocks = [data[i : i + 2048] for i in range(0, len(data), 2048)] or [b""]
        g, b, p = ([size(d, x) for x in blocks] for d in (model.good, model.bad, b""))
        n = max(1, len(data))
        x = [(sum(g) - sum(b)) / (sum(g) + sum(b)), sum(g) / n, sum(b) / n, sum(p) / n, math.log(n) / 10, (sum(g) - sum(b)) / n, max((i - j) / max(len(c), 200) for i, j, c in zip(g, b, blocks, strict=True)), n**-0.5]
        z = sum((v - m) / s * w for v, m, s, w in zip(x, model.mean, model.scale, model.weights[:-1], strict=True)) + model.weights[-1]
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    # Compressors that hold a prepared dictionary may differ by a byte or two from those that load it anew.
    for r in quality.score(docs, model).collect():
        assert r["score"] == pytest.approx(brute(r["text"]), abs=0.05) and r["predicted"] == int(r["score"] >= 0.3)


def test_quality_excerpts_of_long_texts():
    long = bytes(range(256)) * 1000
    places = {long.find(quality.excerpt(i, long)[:300]) for i in range(20)}
    assert all(len(quality.excerpt(i, long)) == quality.EXCERPT_BYTES for i in range(20)) and len(places) > 10
    assert quality.excerpt(3, b"short") == b"short"


def test_extract_keeps_columns(spark):
    pages = spark.createDataFrame([(1, None, "<p>x</p>", "old"), (1, "u", None, "old")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in html_text.extract(pages).collect()) == ["", "x"]
    assert html_text.extract(pages.where("false")).count() == 0


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        x = words(t)
        n = min(13, len(x))
        for q in range(len(x) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[q : q + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(i) if i is not None else "null")
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_decontamination_against_brute_force(spark, limit):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(6)]
    some = lambda n: " ".join(rng.choice(words, n))
    items = [(1, some(30)), (2, some(13)), (3, "Xa, yb"), (4, None), (5, "!?"), (None, "lone-item"), (12, some(20)), (1, some(15))]
    docs = [(i, " ".join(["pre", items[i % 2][1][: 20 + 4 * i], some(40), "xa-YB" if i % 3 == 0 else ""])) for i in range(12)] + [(50, None), (51, ""), (51, "lone item"), (None, items[0][1])]
    d = spark.createDataFrame([(i, t, "mine", 7) for i, t in docs], "doc_id long, text string, lang string, n_hit int")
    got = decontaminate.decontaminate(d, spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=limit).collect()
    assert sorted((r["text"] or "", r["doc_id"] or -1, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got) == sorted((t or "", i or -1, *brute_hits(t, items)) for i, t in docs)
    assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in got) and "lang" in got[0].asDict()
    assert decontaminate.decontaminate(d.where("false"), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=limit).count() == 0


def test_quality_learns_and_scores(spark, empty):
    rng = np.random.default_rng(3)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "under", "old", "stone", "bridges", "slowly"], 60))
    rows = [(i, good() if i % 2 else " | ".join(rng.choice(["buy", "cheap", "pills", "now"], 40)).upper(), i % 2) for i in range(300)] + [(1000, None, 1), (1001, "", 0), (1002, LONG, None)]
    docs, labels = spark.createDataFrame([r[:2] + ("x",) for r in rows], "doc_id long, text string, score string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    held = [i for i, _, _ in rows[:300] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i]["predicted"] == i % 2 for i in held]) > 0.95 and len(out) == len(rows)
    assert all(0 <= r["score"] <= 1 for r in out.values())
    for none in (labels.where("false"), labels.where("quality = 1")):
        assert quality.score(docs, quality.train(docs, none)).count() == len(rows)
    assert quality.score(empty, quality.train(empty, labels)).count() == 0


def test_byte_bpe_is_tiktokens(spark, docs, empty):
    import tiktoken

    ranks, pattern = bpe.vocabulary()
    coder = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = bpe.decode(bpe.encode(docs, ranks, pattern), ranks).collect()
    got = sorted((r["doc_id"] or -1, bytes(r["ids"]), bytes(r["bytes"])) for r in out)
    assert got == sorted((i or -1, np.array(coder.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in TEXTS)
    assert bpe.digests(empty, ranks, pattern).count() == 0
    # Equal tables make equal chunks in different tasks; none of their rows is lost.
    assert bpe.digests(docs.coalesce(1).union(docs.coalesce(1)), ranks, pattern).count() == 2 * len(TEXTS)
    with pytest.raises(Exception, match="50257|KeyError"):
        bpe.decode(spark.createDataFrame([(1, bytearray(np.array([50257], "<u4").tobytes()))], "doc_id long, ids binary"), ranks).collect()


def test_units_and_packing():
    for t in ("", " ", "a", " a  b\n c ", "  x  y", "a  ", "\n \n a"):
        assert "".join(bpe.units(t)) == t
    x = np.array([0, 1, 255, 256, 70000, 2**32 - 1], np.uint32)
    assert (bpe.unpack(bpe.pack(x)) == x).all() and len(bpe.unpack(bpe.pack(x[:0]))) == 0
    assert bpe.unpack_bytes(bpe.pack_bytes([b"", b"ab", b"\0"])) == [b"", b"ab", b"\0"] and bpe.unpack_bytes(bpe.pack_bytes([])) == []


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    ids = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 1]
    shards = token_files.write_shards(docs, token_files.encode_words(docs, open(path).read(), 1), f"file://{tmp_path}/s", shard_bytes=1000)
    out = token_files.checksums(shards).collect()
    read = token_files.read_shards(shards).collect()
    assert sorted((r["start"], len(r["ids"]) // r["width"]) for r in read) == sorted((r["start"], r["n_tokens"]) for r in out)
    start, want = 0, []
    for i, x in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        n = ids(x)
        want.append((i, start, len(n), zlib.crc32(np.array(n, "<u4").tobytes())))
        start += len(n)
    assert sorted((tuple(r) for r in out), key=lambda r: r[1]) == want
    paths = [r["path"] for r in shards.collect()]
    assert [x.tolist() for x in token_files.look_up(paths, 9)] == [ids(TEXTS[6][1])]
    assert len(token_files.look_up(paths, 5)) == 2 and len(token_files.look_up(paths, None)) == 1 and token_files.look_up(paths, 77) == []
    shards = token_files.write_shards(empty, token_files.encode_words(empty, open(path).read(), 1), f"file://{tmp_path}/e")
    assert token_files.read_shards(shards).count() == 0 and token_files.checksums(shards).count() == 0


def test_word_tokens_are_the_librarys(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, rng = Tokenizer.from_file(path), np.random.default_rng(12)
    pool = ["ab", "The", "don't", "'LL", "é", "ÀÉÎÕÜß", "ÿ", "x\u0301", "Ω", "漢", "12", "3", "--", "%$", " ", "\n", "\x85", "\u00a0", "\u200b", "×÷", "<|endoftext|>", "<|startoftext|>", "<|", "İ", "ﬁ", "\x7f", "\x01", "¼", "_", "🙂"]
    texts = ["".join(rng.choice(pool, int(n))) for n in rng.integers(0, 14, 600)] + ["a <|endoftext|> b", *map(chr, range(1, 400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for r in token_files.encode_words(docs, open(path).read(), 1).collect():
        assert np.frombuffer(r["ids"], "<u2").tolist() == [*t.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1], texts[r["doc_id"]]


def test_ranges_keep_the_order(spark, monkeypatch):
    from txnfeat.llm import common

    keys = [-(1 << 62), -5, -5, 0, 1, 2, 3, 50, 51, 52, 53, 1 << 62, None]
    docs = spark.createDataFrame([(k, "x" * 100) for k in keys], "k long, text string")
    for steps, size in ((8192, 10_000), (8192, 100), (8, 10), (64, 200)):
        monkeypatch.setattr(common, "STEPS", steps)
        n, part = common.ranges(docs, "k", size)
        got = sorted(((r["k"] is not None, r["k"] or 0), r["p"]) for r in docs.select("k", part.alias("p")).collect())
        assert [p for _, p in got] == sorted(p for _, p in got) and 0 <= got[0][1] and got[-1][1] < n
        assert size < 10_000 and len({p for _, p in got}) > 3 or size == 10_000 and n == 1
    assert common.ranges(docs.where("false"), "k", 10)[0] == 1


def test_shard_with_many_blocks(tmp_path):
    import pyarrow as pa

    w = token_files.ShardWriter(pa.OSFile(str(tmp_path / "x"), "wb"), 4)
    rows = [(i * 3 - 500, np.arange(i % 50, dtype="<u4").tobytes() * 400) for i in range(500)]
    for i, v in rows:
        w.add(token_files.key_of(i), v)
    w.close()
    w.out.close()
    r = token_files.ShardReader(pa.OSFile(str(tmp_path / "x")))
    assert len(r.blocks) > 5 and [(i, v) for i, _, v in r] == rows and r.get(-500) == [rows[0][1]] and r.get(-499) == []
    with pytest.raises(ValueError):
        token_files.ShardWriter(pa.BufferOutputStream(), 4).__class__.add(w, token_files.key_of(-9999), b"")


def test_license_scan(spark, docs, empty):
    mit = dict(licenses.TEMPLATES)["MIT"]
    rows = [(1, "Prose before. released under the MIT license! And after."), (2, LONG + " " + mit + " " + LONG), (3, None), (4, "MIT license"), (5, mit.replace("merge", "marge")), (5, mit), (None, "Licensed under CC BY-NC 4.0."), (7, "licensed under the apache license version 3.0")]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    for limit in (licenses.BROADCAST_ROWS, 0):
        got = {(r["doc_id"], r["license"]): r["containment"] for r in licenses.scan(d, licenses.template_table(spark), broadcast_rows=limit).collect()}
        assert got == {(1, "MIT-notice"): 1.0, (2, "MIT"): 1.0, (5, "MIT"): 1.0, (None, "CC-BY-NC-4.0-notice"): 1.0}
    assert licenses.scan(empty, licenses.template_table(spark)).count() == 0
    assert licenses.scan(d, licenses.template_table(spark, [("short", "two words"), ("none", None)])).count() == 0
    assert not re.search("Python|Arrow|Pandas", licenses.scan(d, licenses.template_table(spark))._jdf.queryExecution().toString())


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, '<a "' * 260_000, "<font>" * 60_000 + "</b>" * 60_000, "<font><p>x</p>" * 30_000, "<a " + "x" * 10**6 + ">", "<a \"'> x" * 120_000, "<div>x" * 60_000, "<" * 10**6, "<a 'b>" + "<i c=\"d>" * 100_000, "<p>some words</p><li><a href=x>y</a></li>" * 20_000],
)
def test_broken_markup_takes_time_in_proportion(page):
    import time

    html_text.fitted()
    t = time.process_time()
    small = page[: len(page) // 8]
    html_text.main_text(small)
    short, t = time.process_time() - t, time.process_time()
    html_text.main_text(page)
    # Eight times the page: 8 times the time; 64 times it, where it is quadratic.
    assert time.process_time() - t < max(24 * short, 1.0)


def test_cut_with_searches_that_end_without_success():
    # A long chain without a source, then one with: the former is searched once, not once for each of its nodes.
    n = 6000
    edges = [(i, i + 1, 1.0) for i in range(n - 1)]
    assert html_text.minimum_cut([0.0] * n, [1.0] * n, edges) == [False] * n
    n = 500
    assert html_text.minimum_cut([0.0] * (n - 1) + [9.0], [0.001] * n, [(i, i + 1, 10.0) for i in range(n - 1)]) == [True] * n
