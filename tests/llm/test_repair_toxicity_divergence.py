"""Conversation repair, toxicity and source divergence, against brute force."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnfeat.llm import conversations, divergence, toxicity
from txnfeat.llm.common import WordHashes, table

SPACE = " \t\n\x0b\x0c\r"


def brute_audit(roles, faults):
    """Cheapest edits by a search over (place, output so far), least (cost, audit) first: no matrices and no automaton."""
    accepts = lambda out: re.fullmatch(r"(s?(ua)+)?", out)
    begins = lambda out: re.fullmatch(r"s?(ua)*u?", out)
    seen, queue = set(), [(0, "", 0, "")]
    while queue:
        cost, audit, i, out = heapq.heappop(queue)
        if i == len(roles) and accepts(out):
            return cost, audit, out
        if (i, audit) in seen:
            continue
        seen.add((i, audit))
        ways = [(conversations.INSERT, "I", i, c) for c in "ua"]
        if i < len(roles):
            ways.append((3, "D", i + 1, ""))
            if faults[i] in (None, "truncated"):
                more = faults[i] == "truncated"
                ways += [(more, "K", i + 1, roles[i][:1] or "-")] + [(2 + more, "R", i + 1, c) for c in "ua"]
        for c, edit, j, made in ways:
            if begins(out + made) and len(out + made) <= 2 * len(roles) + 2:
                heapq.heappush(queue, (cost + c, audit + edit, j, out + made))


def brute_repair(rows):
    """rows: (turn, role, text) of one conversation, of which nulls are already spaces."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.strip(SPACE)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, _ = brute_audit([r for _, r, _ in rows], faults)
    out, i = [], 0
    for edit in audit:
        role = "assistant" if out and out[-1][0] == "u" else "user"
        if edit == "I":
            out.append(f"{role}:")
            continue
        if edit != "D":
            out.append(f"{rows[i][1] if edit == 'K' else role}:{rows[i][2]}")
        i += 1
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def talk(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(n)]), rng.choice(["user", "assistant", "system", "u", "User", ""]), rng.choice(["", " \n", "a.", "b!", "c", "long?" * 3, "é. ", "x\ty"])) for _ in range(rng.randrange(n + 1))]


COLUMNS = "conv_id long, turn long, role string, text string, gone boolean, part int, no string, key string"
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize(("run_bytes", "run_rows", "range_bytes"), [(4 << 20, 16_384, 8 << 20), (12, 4, 40), (1 << 20, 1, 100)])
def test_repair_against_search(spark, run_bytes, run_rows, range_bytes):
    known = {i: talk(i, 7) for i in range(120)}
    rows = [(i, *r, False, 1, "x", "y") for i, rs in known.items() for r in rs] + [(i, 5, "user", "not told", True, 1, "x", "y") for i in known]
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    got = {r["conv_id"]: tuple(r[c] for c in FIELDS) for r in conversations.repair(df, "gone", run_bytes, run_rows, range_bytes).collect()}
    assert got == {i: brute_repair(rs) for i, rs in known.items()}


def test_repair_of_a_long_conversation_in_pieces(spark):
    """One conversation with most rows: the same result whole and in pieces, and pieces over many tasks."""
    rng = random.Random(3)
    long = [(1, i // 2, rng.choice(["user", "assistant"]), f"{rng.randrange(900)}{rng.choice('.?,')}") for i in range(3000)]
    rows = long + [(i, 0, "user", "hi.") for i in range(2, 40)] + [(None, None, None, None), (None, None, None, None), (50, 0, "user", "y" * 300_000 + ".")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    whole = {r["conv_id"]: tuple(r) for r in conversations.repair(df, range_bytes=1 << 30, run_rows=1 << 20).collect()}
    cut = {r["conv_id"]: tuple(r) for r in conversations.repair(df, run_bytes=500, range_bytes=1000).collect()}
    assert whole == cut and len(cut) == 41
    assert cut[None][1:7] == (0, 2, 0, 0, 1, 6) and cut[None][7] == "DD"
    texts = Counter((r, t) for _, _, r, t in long)
    assert cut[1][3] == sum(n - 1 for n in texts.values())


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([(1, 1, "user", "x", True, 1, "", "")], COLUMNS)
    assert [tuple(r) for r in conversations.repair(df, "gone").collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.repair(df.where("false"), "gone").count() == 0


def test_products_are_associative():
    rng = random.Random(1)
    for _ in range(60):
        codes = bytes(rng.randrange(16) for _ in range(9))
        one = conversations.IDENTITY
        for c in codes:
            one = conversations.product(one, conversations.TURNS[c])
        assert one == conversations.fold(codes) == conversations.product(conversations.fold(codes[:2]), conversations.fold(codes[2:]))


def test_damage(spark):
    rows = [(i, t, "assistant", "a. b? c!") for i in range(30) for t in range(5)] + [(None, 3, None, None), (7, None, "system", "x.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    expected = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        expected += [(conv, turn, "user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)
    got = [tuple(r) for r in conversations.damaged(df).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


SF = "/root/testdata/sf0.1"


def test_toxicity_of_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")
    model = toxicity.train(docs, labels)
    assert 0 < len(model.places) < 20_000
    judged = labels.where(toxicity.held_out()).join(docs, "doc_id")
    rows = toxicity.score(judged, model).select("toxic", "score", "predicted").collect()
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    ranks = s.argsort().argsort() + 1
    auc = (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.98
    p = np.array([r["predicted"] for r in rows])
    assert p[y == 1].mean() > 0.85 and p[y == 0].mean() < 0.01


def test_toxicity_edges(spark):
    bad = [(i, f"some words here vile{i % 3} and more w{i}", 1) for i in range(60)]
    good = [(i, f"some words here and more w{i} x{i % 7}", 0) for i in range(60, 200)]
    docs = spark.createDataFrame([(i, t, 1.0, "z") for i, t, _ in bad + good], "doc_id long, text string, score double, toxic string")
    labels = spark.createDataFrame([(i, x, 1) for i, _, x in bad + good] + [(None, 1, 1), (3, None, 0), (9999, 1, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs.union(docs), labels)
    assert np.array_equal(model.places, toxicity.train(docs, labels).places)
    long = "w " * 400_000
    asked = spark.createDataFrame([(1, "some words here Vile1 and more", 0.0, "a"), (1, "some words here Vile1 and more", 0.0, "a"), (None, None, None, None), (2, "", 0.0, ""), (3, long + "words here vile2 and more", 0.0, ""), (4, long, 0.0, "")], docs.schema)
    rows = toxicity.score(asked, model).collect()
    assert [r["predicted"] for r in rows] == [1, 1, 0, 0, 1, 0] and rows[0]["score"] == rows[1]["score"] and rows[2]["score"] == rows[3]["score"]
    assert toxicity.score(asked.where("false"), model).count() == 0 and rows[0]["toxic"] == "a"
    none = toxicity.train(docs, labels.where("toxic = 1 or toxic is null"))
    assert len({r["score"] for r in toxicity.score(asked, none).collect()}) == 1
    assert toxicity.train(docs.where("false"), labels).constant == 0.0


def test_toxicity_in_shards_learns_the_same_words(spark):
    rows = [(i, ("vile " if i % 4 == 0 else "") + f"common words a{i % 11} b{i % 13}", int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs, docs, shard_rows=50)
    known = WordHashes()
    vile, plain = (model.score(t, model.table(), known) for t in (b"vile common words", b"common words"))
    assert vile > 0.9 and plain < 0.1


def test_ftrl_step_by_hand():
    s = toxicity.State(np.zeros(2), np.zeros(2))
    s.learn(np.array([0, 1]), np.array([0.5, 1.0]), 1, 2.0, 0.1)
    # p = 0.5: gradients -0.5 and -1, rates sigma = |g| / ALPHA, no weight yet.
    assert np.allclose(s.z, [-0.5, -1.0]) and np.allclose(s.n, [0.25, 1.0])
    assert np.allclose(s.weights(np.array([0]), 0.1), 0.4 / ((1 + 0.5) / toxicity.ALPHA)) and s.weights(np.array([0]), 0.6)[0] == 0


def test_toxicity_stretches_give_the_features_of_the_whole(monkeypatch):
    text = " ".join(f"Word{i % 50}" for i in range(400)).encode()
    whole = toxicity.features(text, WordHashes())
    monkeypatch.setattr(toxicity, "CHUNK_BYTES", 37)
    assert np.array_equal(whole, toxicity.features(text, WordHashes()))


def brute_divergence(rows, least_docs, best):
    small = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    docs = [(lang or "", source or "", [small(w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in docs}:
        df, n = Counter(), defaultdict(Counter)
        for _, source, ws in (x for x in docs if x[0] == lang):
            df.update(set(ws))
            n[source].update(ws)
        kept = [w for w in df if df[w] >= least_docs]
        v, every = len(kept), sum(n.values(), Counter())

        def shares(c):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (total + 2 * v) for w in kept}

        p, q = {s: shares(c) for s, c in n.items()}, shares(every)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in n:
            pairs = sorted(((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in n if o != s))
            terms = sorted((-f(p[s][w], q[w]), w.encode()) for w in kept if n[s][w] and p[s][w] > q[w])[:best]
            out += [(lang, s, part, item.decode(), -value, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (value, item) in enumerate(found)]
    return sorted(out)


def test_divergence_against_brute_force(spark):
    rng = random.Random(5)
    words = ["Ärger", "ärger", "THE", "the", "of", "naïve", "日本", "x1y", "o'clock", "ÉTÉ", *[f"w{'abcdefghij'[i]}" for i in range(10)]]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "S1", "é", None])) for _ in range(150)]
    rows += [(None, "en", "none"), ("", "fr", "s1"), ("rare words", "zz", "a"), ("rarer", "zz", "b"), ("x", "alone", "only"), ("the " * 30_000, "en", "s1")] + [("the of", "en", "s2")] * 40
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "text string, lang string, source string, term int, value string").repartition(4)
    for best in (10, 2):
        assert sorted(map(tuple, divergence.audit(df, best=best).collect())) == brute_divergence(rows, 10, best)
    assert divergence.audit(df.where("false")).count() == 0


def test_divergence_shares_beyond_64_bits(spark):
    df = spark.createDataFrame([(9_300_000_000, 10_000_000_000, 5), (3, 10, 2)], "n long, t long, v long")
    got = [r[0] for r in df.select(F.expr(divergence.share("n", "t", "v"))).collect()]
    assert got == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in ((9_300_000_000, 10_000_000_000, 5), (3, 10, 2))]
