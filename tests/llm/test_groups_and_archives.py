"""Near duplicates, archives and the pipeline, against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnfeat.llm import near_dups, warc


def brute_components(rows, k):
    def shingles(t):
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()

    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def families(seed=4):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for base in range(6):
        text = rng.choice(words, int(rng.integers(20, 200))).tolist()
        for _ in range(14):
            t = list(text)
            for p in rng.choice(len(t), int(rng.integers(0, 1 + len(t) // 12)), replace=False):
                t[p] = str(rng.choice(words))
            rows.append(" ".join(t))
    rows += [rows[3], rows[3], "one", "ONE", "one two", "", None, "  \n", "same same same same same same", "same same same same same"]
    return [(7 * i % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("k", "block", "limit"), [(4, 400_000, 1_000_000), (5, 2_000, 0)])
def test_near_duplicates_against_brute_force(spark, k, block, limit):
    rows = families()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, key int").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(df, k=k, broadcast_rows=limit, block=block).collect()}
    assert got == brute_components(rows, k)


def test_near_duplicates_nulls_and_repeated_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "lone text"), (2, long), (3, long + " y")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in near_dups.near_duplicates(df).collect()))
    assert got == [(-1, -1, True), (-1, 1, False), (1, 1, True), (1, 1, True), (2, 2, True), (3, 2, False)]
    assert near_dups.near_duplicates(df.where("false")).count() == 0


def test_one_identifier_with_two_texts(spark):
    x, y = (" ".join(f"{p}{i}" for i in range(30)) for p in "xy")
    for rows in ([(5, x), (5, y), (2, y + " z")], [(5, y), (5, x), (2, y + " z"), (None, x + " z"), (None, "x only"), (None, "x only")]):
        got = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        expected = [(5, 5, True), (5, 2, False), (2, 2, True)] + [(None, 5, False), (None, None, True), (None, None, True)][: len(rows) - 3]
        assert sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("block", [400_000, 20_000])
def test_family_on_both_sides_of_the_threshold(spark, block):
    # Copies of one text, each with some of 40 recurring edits: their mutual similarity is from 0.5 to 1.
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        t = list(base)
        for p in rng.choice(40, int(rng.integers(1, 9)), replace=False):
            t[3 * p + 10] = f"edit{p}"
        rows.append((i, " ".join(t)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block=block).collect()}
    assert got == brute_components(rows, 5)


def test_pair_at_the_threshold_with_unlike_sketches(spark):
    # Found by search: eight of ten shingles in common, and sketches that differ in 74 bits.
    texts = [(n, " ".join([*(f"s6147x{j}" for j in range(8)), f"{p}6147"])) for n, p in ((1, "a"), (2, "b"))]
    x, y = (near_dups.signature(near_dups.shingles(t.encode(), 1))[2] for _, t in texts)
    assert sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x, y, strict=True)) == 74
    got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), k=1).collect()}
    assert got == {1: 1, 2: 1}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 120)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in near_dups.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 120), 100)}


def test_odd_sketch_estimates():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for shared, j in ((950, 0.95 / 1.05), (889, 0.8), (667, 0.5)):
        a, b = np.unique(pool[:1000]), np.unique(np.concatenate((pool[:shared], pool[1000 : 2000 - shared])))
        assert near_dups.estimate(near_dups.signature(a)[2], near_dups.signature(b)[2]) == pytest.approx(j, abs=0.16)


PAGES = [(1, "http://a/", "x" * 500), (2, "http://b/\r\nX: y", "x" * 500), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "é" * 50), (8, "u", "é" * 50), (9, "u", "0123456789" * 9_000), (2, "http://b/", "x" * 500), (None, "u", "x" * 500)]


def brute_records():
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        again = h in first and i != first[h]
        out.append((i or -1, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("segment", "limit"), [(64, 0), (1 << 20, 50_000)])
def test_archives_round_trip(spark, tmp_path, segment, limit):
    pages = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    paths = warc.write_archives(warc.record_types(pages, broadcast_revisits=limit), f"file://{tmp_path}/w", segment)
    out = warc.reassemble(warc.read_archives(paths), payloads=True).collect()
    assert sorted(((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=repr) == brute_records()
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in out if r["record_type"] == "response")
    assert warc.reassemble(warc.read_archives(warc.write_archives(warc.record_types(pages.where("false")), f"file://{tmp_path}/e"))).count() == 0


def test_broken_records_are_rows(spark, tmp_path):
    pages = spark.createDataFrame([PAGES[8], PAGES[6], PAGES[7]], "page_id long, url string, html string")
    paths = warc.write_archives(warc.record_types(pages), f"file://{tmp_path}/w", 1000)
    records = warc.read_archives(paths)
    ids = [r["origin"] for r in records.where("segment < 2").collect()]
    assert sorted(ids) == sorted(warc.record_id(p, hashlib.sha256(PAGES[p - 1][2].encode()).hexdigest()) for p in (7, 8, 9))
    assert {r["refers"] for r in records.where("record_type = 'revisit'").collect()} == {warc.record_id(7, hashlib.sha256(PAGES[6][2].encode()).hexdigest())}
    for broken in (records.where("segment <> 5"), records.where("total is null"), records.where("segment <> 1"), records.union(records.where("segment = 3"))):
        out = warc.reassemble(broken).collect()
        assert len(out) == 3 and ["segment" in (r["problem"] or "") for r in out if r["page_id"] not in (7, 8)] == [True]
        assert all(r["payload_bytes"] == 100 and r["problem"] is None for r in out if r["page_id"] in (7, 8))
    out = {r["page_id"]: r for r in warc.reassemble(records.where("page_id is null or page_id <> 7")).collect()}
    assert set(out) == {8, 9} and "missing" in out[8]["problem"] and out[8]["payload_bytes"] is None and out[9]["problem"] is None
    # An archive that is cut in the middle gives what stands before, and tells so.
    main = next(r["path"] for r in paths.collect() if "-main" in r["path"])
    data = open(main.removeprefix("file://"), "rb").read()
    cut = tmp_path / "cut-main.warc.gz"
    cut.write_bytes(data[: len(data) - 20])
    got = warc.reassemble(warc.read_archives(spark.createDataFrame([(f"file://{cut}",)], "path string"))).collect()
    assert any("archive" in (r["problem"] or "") for r in got)


@pytest.mark.parametrize("step", [1, 7, 10_000])
def test_payload_in_pieces(step):
    body = bytes(range(256)) * 50
    raw = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc._chunked(body)
    p = warc.Payload(keep=True)
    for i in range(0, len(raw), step):
        p.feed(raw[i : i + step])
    assert p.close(hashlib.sha256(body).hexdigest())[0] == len(body) and b"".join(p.kept) == body
    p = warc.Payload()
    p.feed(raw[:-3])
    with pytest.raises(ValueError):
        p.close(hashlib.sha256(body).hexdigest())


def test_pipeline_stages(spark, tmp_path):
    import tiktoken

    import corpus_pipeline
    from txnfeat.llm import bpe

    rng = np.random.default_rng(6)
    words = [f"plain{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(words, n))
    docs = [(i, text(60), "en", "s", 0) for i in range(60)]
    docs += [(100 + i, docs[i][1] + " tail", "en", "s", 0) for i in range(5)]
    docs += [(200 + i, " ".join(f"{w}!!" for w in text(60).upper().split()), "en", "s", 0) for i in range(60)]
    item = text(30)
    docs += [(300, "intro " + item, "en", "s", 0), (301, None, None, None, None), (0, *docs[0][1:])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0 if 200 <= i < 300 else 1) for i, *_ in docs], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = {i for i, *_ in docs if i < 60}
    assert left <= set(out) and not {i for i in out if 100 <= i < 301}
    ranks, pattern = bpe.vocabulary()
    coder = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for i, t, *_ in docs[:60]:
        assert out[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() and out[i]["n_tokens"] == len(coder.encode_ordinary(t))
    assert corpus_pipeline.run(spark, str(tmp_path)).where(F.col("doc_id") == 0).count() == 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "tokens"]


def test_pipeline_groups_with_null_and_repeated_identifiers(spark):
    import corpus_pipeline

    words = lambda p, n=40: " ".join(f"{p}{i}" for i in range(n))
    texts = [
        (5, words("a")), (None, words("a")),  # a null identifier never stands for a group with others
        (None, words("b")), (None, words("b") + " tail"), (None, words("b")),  # near and exact copies among null identifiers
        (7, words("c")), (7, words("d")), (7, words("c")),  # one identifier, two documents
        (9, words("d") + " tail"), (3, words("e")), (11, words("e") + " tail"),
        (None, None), (None, ""), (None, ""), (12, ""), (12, ""), (12, None),  # texts without words are linked with nothing
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()]
    b = [x for x in got if x[0] is None and x[1] and x[1].startswith("b0")]
    assert len(b) == 1
    expected = [(5, words("a")), (7, words("c")), (7, words("d")), (3, words("e")), (None, None), (None, ""), (None, ""), (12, ""), (12, None)]
    assert sorted(map(repr, got)) == sorted(map(repr, [*expected, *b]))


def test_pipeline_stages_by_whole_row_sets(spark, tmp_path):
    """Each stage against plain Python over the rows that its predecessor kept (quality: given the fitted model)."""
    import tiktoken
    from test_text_operators import brute_hits

    import corpus_pipeline
    from txnfeat.llm import bpe, quality

    rng = np.random.default_rng(8)
    words = [f"plain{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(words, n))
    docs = [(i, text(60), "en", "s", i) for i in range(50)]
    docs += [(100 + 10 * i + j, docs[i][1] + " tail" * (j + 1), "en", "t", 0) for i in range(5) for j in range(3)]
    docs += [(200 + i, " ".join(f"{w}!!" for w in text(60).upper().split()), None, "s", 0) for i in range(50)]
    items = [(1, text(30)), (2, text(8))]
    docs += [(300, "intro " + items[0][1], "en", "s", 0), (301, text(200) + " " + items[1][1], "en", "s", 0), (302, text(40) + " " + items[1][1], "en", "s", 0), (303, None, None, None, None), (304, "", "en", "s", 0)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 0 if 200 <= i < 300 else 1) for i, *_ in docs], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def after(n, rows):
        return sorted((tuple(r) for r in corpus_pipeline.STAGES[n][1](spark, spark.createDataFrame(rows, kinds).repartition(3), str(tmp_path)).collect()), key=repr)

    model = quality.train(spark.createDataFrame(docs, kinds), labels)
    x = np.array([quality.sizes(*model.compressors(), (r[1] or "").encode()) for r in docs])
    good = sorted((r for r, q in zip(docs, model.scores(x), strict=True) if q >= quality.THRESHOLD), key=repr)
    assert after(0, docs) == good and 0 < len(good) < len(docs)
    kept = brute_components([r[:2] for r in good], 5)
    lone = [r for r in good if kept[r[0]][2]]
    assert after(1, good) == lone and len(lone) < len(good)
    hits = {r[0]: brute_hits(r[1], items) for r in lone}
    clean = [r for r in lone if not (hits[r[0]][1] and 20 * hits[r[0]][1] >= hits[r[0]][0])]
    assert after(2, lone) == clean and len(clean) < len(lone)
    ranks, pattern = bpe.vocabulary()
    coder = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    ids = {r[0]: coder.encode_ordinary(r[1] or "") for r in clean}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert after(3, clean) == sorted(((r[0], len(ids[r[0]]), digest(np.array(ids[r[0]], "<u4").tobytes()), digest((r[1] or "").encode())) for r in clean), key=repr)


def test_pipeline_stages_on_the_edges(spark, tmp_path):
    """Empty tables, a very long text, null columns and other columns with clashing names, through each stage."""
    import corpus_pipeline

    kinds = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, n_hit long, key_ string, text_bytes string"
    long = " ".join(f"long{i}" for i in range(60_000))
    rows = [(1, long, None, None, None, 0.5, False, 7, "k", "t"), (2, None, None, None, None, None, None, None, None, None), (3, "", "en", "s", 0, 0.1, True, 1, "k", "t"), (4, "a few words of a text", "en", "s", 21, 0.1, True, 1, "k", "t")]
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 3, 4], name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
        if name != "tokens":
            assert out.columns == list(corpus_pipeline.COLUMNS)
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out[1]["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest() and out[2]["n_tokens"] == out[3]["n_tokens"] == 0
