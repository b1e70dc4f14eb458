"""Operators between texts: SimHash groups, leaks, substrings, conversations, the pipeline."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("docloom.llm")

import corpus_pipeline  # noqa: E402
from docloom.llm import bwt, chat, decontaminate, near_duplicates, simhash, suffix_dedup  # noqa: E402
from docloom.llm.components import components  # noqa: E402


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    want = {n: r for n, r in groups({x for e in edges for x in e}, edges).items() if n != r}
    assert {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()} == want


def brute_print(text):
    words = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(120)) for _ in range(12)]
    rows = [(None, None), (900, ""), (901, " \t\n"), (902, "One Two"), (903, "one two"), (904, "x " * 20_000)]
    for i in range(120):
        words = base[i % 12].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "edit"
        rows.append((i, " ".join(words)))
    rows.append(rows[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    prints = {d: brute_print(t) for d, t in rows}
    ids = sorted(d for d in prints if d is not None)
    linked = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = groups(ids, linked)
    out = simhash.cluster(simhash.fingerprints(df)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.fp % (1 << 64) == prints[r.doc_id]
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else 900)
    assert simhash.cluster(simhash.fingerprints(df.limit(0))).count() == 0


def test_hot_buckets_lose_no_link(spark):
    rng = random.Random(5)
    values = set()
    for b in [rng.getrandbits(64) for _ in range(8)]:
        for _ in range(120):
            x = b
            for _ in range(rng.randrange(8)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values = sorted(values)
    a = np.array(values, np.uint64)
    linked = [(v, values[j]) for i, v in enumerate(values) for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= 4)]
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    found = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(df, hot=16).distinct().collect()]
    assert groups(values, found) == groups(values, linked)


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"Q{rng.randrange(300)}," for _ in range(n))) for i, n in enumerate([3, 8, 20, 40, 40])] + [(9, None), (10, "..."), (0, "twin item here")]
    docs = [(None, None), (50, ""), (51, "word")]
    for i in range(40):
        words = [f"d{rng.randrange(400)}" for _ in range(60)]
        for _, text in rng.sample(items[:5], 2):
            leak = text.lower().split()
            for _ in range(rng.randrange(3)):
                leak[rng.randrange(len(leak))] = "edited"
            at = rng.randrange(60)
            words[at:at] = leak
        docs.append((i, " ".join(words)))
    want = {}
    for d, text in docs:
        words = decontaminate.tokens(text)
        for item, body in items:
            t = decontaminate.tokens(body)
            k = min(5, len(t))
            if not k:
                continue
            mine = Counter(tuple(t[j : j + k]) for j in range(len(t) - k + 1))
            best = max((decontaminate.similarity(Counter(tuple(words[a + j : a + j + k]) for j in range(len(t) - k + 1)), mine) for a in range(len(words) - len(t) + 1)), default=0)
            if best >= 0.8:
                want[d, item] = max(best, want.get((d, item), 0))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in decontaminate.find_leaks(df, bench).collect():
        got[r.doc_id, r.item_id] = max(r.similarity, got.get((r.doc_id, r.item_id), 0))
    assert got == pytest.approx(want) and len(want) > 20
    left = {r.doc_id for r in decontaminate.drop_leaks(df, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.drop_leaks(df, bench.limit(0)).count() == len(docs) and decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_documents_shorter_than_the_item(spark):
    words = [f"q{i}" for i in range(59)]
    docs = [(1, " ".join(words[:-1])), (2, " ".join(words[5:-5])), (3, " ".join(words[8:-8])), (4, "q1 q2 q3"), (5, " ".join([*words[:20], "x", *words[20:-1]]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "q1 q2 q3 q4")], "item_id long, text string")
    found = {r.doc_id: (r.item_id, round(r.similarity, 6), r.first_word, r.n_words) for r in decontaminate.find_leaks(df, bench).where("item_id = 1").collect()}
    assert found == {1: (1, round(54 / 55, 6), 0, 58), 2: (1, round(45 / 55, 6), 0, 49), 5: (1, round(50 / 60, 6), 0, 59)}
    assert {r.doc_id for r in decontaminate.drop_leaks(df, bench.where("item_id = 1")).collect()} == {3, 4}


def test_multi_index_misses_none():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    index = decontaminate.MultiIndex(prints)
    for fp in prints[:40].tolist():
        for _ in range(5):
            x = fp
            for b in rng.choice(64, rng.integers(0, 22), replace=False).tolist():
                x ^= 1 << b
            assert index.within(x).tolist() == np.flatnonzero(np.bitwise_count(prints ^ np.uint64(x)) <= decontaminate.RADIUS).tolist()


@pytest.mark.parametrize("chunk", [1 << 20, 7, 1])
def test_suffix_order(monkeypatch, chunk):
    monkeypatch.setattr(bwt, "CHUNK", chunk)
    rng = random.Random(6)
    for _ in range(30 if chunk > 1 else 8):
        alphabet = rng.choice([b"ab", b"abcd", bytes(range(1, 256))])
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 9))]
        strings += [strings[0] + b"a", strings[0]] * rng.randrange(2)
        rows = np.concatenate([r for _, r in bwt.suffix_order(strings).read()])
        suffixes = [strings[i][p:] for i, p in zip(bwt.strings_of(rows).tolist(), bwt.places(rows).tolist(), strict=True)]
        assert suffixes == sorted(suffixes) and len(suffixes) == sum(len(s) + 1 for s in strings)
        for a, b, n in zip(suffixes, suffixes[1:], bwt.shared_lengths(rows)[1:].tolist(), strict=False):
            assert os.path.commonprefix([a, b]) == b[:n] and n == len(os.path.commonprefix([a, b]))


def brute_dedup(docs, width):
    out, seen = {}, set()
    for d, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - width + 1):
            if data[p : p + width] in seen:
                gone[p : p + width] = b"\x01" * width
            seen.add(data[p : p + width])
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for i in range(len(gone)) if gone[i] and (not i or not gone[i - 1]))
        out[d] = len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()
    return out


def test_suffix_dedup_against_brute_force(spark):
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdé fgh") for _ in range(400))
    docs = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 700), (4, passage), (5, passage), (6, "ab" * 300)]
    for i in range(7, 60):
        a, b = sorted(rng.randrange(400) for _ in range(2))
        docs.append((i, "".join(rng.choice("abcdé fgh") for _ in range(rng.randrange(200))) + passage[a:b] + rng.choice(["", passage[:150], "x" * 130])))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_spans", F.lit("clash")).repartition(5)
    want = brute_dedup(docs, 100)
    for least, hot in ((1, 1 << 20), (1 << 20, 1 << 20), (1, 3), (1, 0)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_text(df, least_bytes=least, hot_pieces=hot).collect()}
        assert got == want
    odd = spark.createDataFrame([(None, passage), (2, passage), (2, passage), (3, "other " + passage), (3, passage[:250])], "doc_id long, text string").repartition(1)
    for hot in (1 << 20, 0):
        out = suffix_dedup.dedup_text(odd, hot_pieces=hot).collect()
        left = {(r.doc_id, r.n_bytes): r.n_bytes - r.n_removed for r in out}
        n = len(passage.encode())
        assert len(out) == 5 and left == {(None, n): 0, (2, n): n, (3, n + 6): 6 if passage[0] != " " else left[3, n + 6], (3, len(passage[:250].encode())): 0}
    assert suffix_dedup.dedup_text(odd.limit(0)).collect() == []


def test_suffix_dedup_of_many_documents_without_an_id(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(110, 150))) for _ in range(600)] + [None, "", "x" * 120]
    shared = texts[5][:105]
    texts += [shared + "".join(rng.choice("ijkl") for _ in range(60)) for _ in range(5)]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    out = suffix_dedup.dedup_text(df).collect()
    assert 0 <= sum(r.n_removed for r in out) - 5 * 105 - 119 < 20 and {r.text for r in out if r.n_removed} <= {t for t in texts if t and (t.startswith(shared) or t[0] == "x")}


@pytest.mark.parametrize("line", [40, 95, 130])
def test_suffix_dedup_of_a_line_in_many_contexts(spark, line):
    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    common = some(line)
    docs = [(i, some(90) + common + some(rng.choice([90, 200]))) for i in range(1500)]
    docs += [(3000 + i, "q" * (i % 3) + docs[i][1][40:280]) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    want = brute_dedup(docs, 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_text(df, hot_pieces=100).collect()}
    assert got == want and sum(x[1] for x in got.values()) >= 20 * 150


def test_suffix_dedup_chunks_of_one_scan(spark, monkeypatch):
    rng = random.Random(13)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    docs = [(i, base[k : k + 900] + "z" * (i % 4)) for i, k in enumerate(rng.randrange(2100) for _ in range(60))] + [(100, base * 40)]
    rows = [(h, g, d, 0, a) for h, g, d, a in ((rng.randrange(3), rng.randrange(3), rng.randrange(4), rng.randrange(3) << 10) for _ in range(200))]
    cols = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
    stay = list(zip(*(c.tolist() for c in suffix_dedup.collapse(*cols)), strict=True))
    first = {}
    for r in sorted(rows, key=lambda r: r[2:]):
        first.setdefault(r[:2], r)
    assert sorted(r for r in stay if not r[4] & suffix_dedup._GONE) == sorted(first.values())
    assert sorted((r[1], *r[2:4], r[4] & ~suffix_dedup._GONE) for r in stay if r[4] & suffix_dedup._GONE) == sorted(r[1:] for r in set(rows) - set(first.values()))
    want = brute_dedup(docs, 100)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_text(df).collect()}
    assert got == want


def test_only_different_parts_reach_the_suffix_order():
    """Pieces with a passage in common and each its own end: of the equal parts one remains, which nothing repeats."""
    rng = random.Random(4)
    word = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    passage, other = word(120), word(110)
    rows = [(1, k, 0, 7 << 10 | 140, passage + word(20)) for k in range(5)] + [(1, 9, 0, 3 << 10 | 150, word(20) + other + word(20)), (1, 10, 0, 150, other + word(30))]
    equal, parts = suffix_dedup.distinct_parts(rows, 100)
    assert parts == [] and equal == [(k, 0, 7, 127) for k in range(1, 5)] + [(10, 0, 0, 110)]
    # A part that reaches further than another stays for the suffix order.
    rows = [(1, 0, 0, 150, passage + other), (1, 1, 0, 130, passage[:105] + word(25)), (1, 2, 0, 140, passage[10:] + word(30))]
    equal, parts = suffix_dedup.distinct_parts(rows, 100)
    assert equal == [] and [x[:3] for x in parts] == [(0, 0, 0), (1, 0, 0), (2, 0, 0)]


def test_texts_scanned_side_by_side():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab c") for _ in range(n)) for n in (0, 99, 100, 101, 400, 50, 168, 900)] + [b"a" * 700, b"", b"abcd" * 60]
    for gram in suffix_dedup.GRAMS:
        together = list(zip(*(c.tolist() for c in suffix_dedup.pieces(texts, 100, gram)), strict=True))
        alone = [(k, *row[1:]) for k, t in enumerate(texts) for row in zip(*(c.tolist() for c in suffix_dedup.pieces([t], 100, gram)), strict=True)]
        assert together == alone and {row[0] for row in together} == {k for k, t in enumerate(texts) if len(t) >= 100}


def test_chat_round_trip_and_branches(spark):
    texts = ["\\### Assistant: </turn> ok", "<turn><body>", "\\b\\l\\\\", None, "", "a\n</turn>\n<turn>assistant<body>x"]
    turns = [(t, i, "assistant" if i % 2 else "user", x) for t in ("a", "b") for i, x in enumerate(texts, 1)]
    nodes = spark.createDataFrame([(t, n, n - 1 or None, 1.0, r, x) for t, n, r, x in turns], "tree string, node long, parent long, score double, role string, text string")
    out = chat.format_trees(nodes).withColumn("back", chat.parse_turns(F.col("formatted"))).withColumn("loss", F.transform("loss_spans", lambda s: chat.unescape(F.substring(F.col("formatted"), s["s"] + 1, s["e"] - s["s"])))).collect()
    assert len(out) == 2
    for r in out:
        assert [(x.role, x.text) for x in r.back] == [("assistant" if i % 2 else "user", x or "") for i, x in enumerate(texts, 1)]
        assert list(r.loss) == [x or "" for i, x in enumerate(texts, 1) if i % 2]
    tree = [("t", 1, None, 0.0), ("t", 2, 1, 5.0), ("t", 3, 1, 1.0), ("t", 4, 3, 9.0), ("t", 5, 99, 0.5), ("u", 1, None, None)]
    df = spark.createDataFrame(tree, "tree string, node long, parent long, score double")
    paths = {}
    for r in chat.best_paths(df, 2).orderBy("tree", "branch_rank", "pos").collect():
        paths.setdefault((r.tree, r.branch_rank), []).append(r.node)
    assert paths == {("t", 1): [1, 3, 4], ("t", 2): [1, 2], ("u", 1): [1]}
    plan = chat.best_paths(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError):
        chat.branches(spark.createDataFrame([("t", 1, 2, 0.0), ("t", 2, 1, 0.0)], df.schema), rounds_limit=3)
    rows = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (None, 0, None, None)], "conv_id long, turn long, role string, text string")
    assert {(r.tree, r.node, r.text) for r in chat.conversation_nodes(rows).collect()} == {("1", 1, "a"), ("1", 2, "b"), ("null", 1, None)}


def test_near_duplicates_and_pipeline(spark, tmp_path):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["the", f"w{rng.randrange(3000)}", f"v{rng.randrange(3000)}"]) for _ in range(n))
    base = [prose(150) for _ in range(10)]
    item = prose(30)
    docs = [(i, t) for i, t in enumerate(base)] + [(20 + i, t) for i, t in enumerate(base[:5])]
    for i, t in enumerate(base[:5]):
        words = t.split()
        words[40] = "edited"
        docs.append((40 + i, " ".join(words)))
    docs += [(60, base[9] + " " + item + " " + prose(60)), (61, prose(80) + " mail a.b@mail.example.com " + prose(20)), (62, "short"), (63, None), (64, "A! " * 100), docs[0]]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    stay = near_duplicates.near_duplicate_stage(spark, df.where("doc_id < 60"), "")
    assert stay.columns == df.columns and sorted(r.doc_id for r in stay.collect()) == list(range(10))
    for hot in (3, 4096):
        roots = {r.doc: r.root.doc for r in near_duplicates.near_duplicate_groups(df.where("doc_id < 60"), hot=hot).collect()}
        assert all(roots[d] == d % 20 for d in roots)
    df.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = {r.doc_id: r for r in out.collect()}
    assert sorted(rows) == [*range(10), 61] and "[EMAIL]" in rows[61].text and all(r.token_ids for r in rows.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "personal data", "BPE encoding"]
    assert near_duplicates.near_duplicate_stage(spark, df.limit(0), "").count() == 0


def five_word_similarity(a, b):
    one, two = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(one & two) / len(one | two)


def test_pipeline_decides_similarities_around_the_threshold(spark, tmp_path):
    rng = random.Random(9)
    docs, want = [], set()
    for i in range(80):
        words = [rng.choice(["the", f"w{rng.randrange(9000)}", f"v{rng.randrange(9000)}"]) for _ in range(rng.randrange(300, 700))]
        copy = list(words)
        for at in rng.sample(range(len(words)), round(len(words) * rng.uniform(0.018, 0.034))):
            copy[at] = f"edit{rng.randrange(9000)}"
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        want |= {2 * i} if five_word_similarity(docs[-2][1], docs[-1][1]) >= 0.8 else {2 * i, 2 * i + 1}
    assert 100 < len(want) < 140
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want


def test_word_hashes_are_of_the_word_alone():
    rng = random.Random(4)
    words = [bytes(rng.choice(b"ab\0\xff") for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 63, 64, 65, 200]))) for _ in range(10_000)]
    hashes = decontaminate.word_hashes(words).tolist()
    assert len(set(zip(words, hashes, strict=True))) == len(set(words)) == len(set(hashes))
    for k in (0, 1, 4095, 4096, 9999):
        assert decontaminate.word_hash(words[k]) == hashes[k]
    assert decontaminate.word_hashes([]).tolist() == []
    assert near_duplicates.shingle_set([]).tolist() == [] and near_duplicates.outline(" ")[2] == [0]
    few = near_duplicates.shingle_set(words[:3])
    assert len(few) == 1 and near_duplicates.shingle_set(words[:3] * 9).tolist() == sorted(set(decontaminate.shingles(words[:3] * 9, 5).tolist()))


def test_pairs_that_share_only_a_hot_piece_meet(spark):
    rng = random.Random(10)
    pieces = lambda t: set(near_duplicates.outline(t)[2])
    while True:
        words = [f"w{rng.randrange(9000)}" for _ in range(500)]
        copy = list(words)
        for at in rng.sample(range(500), 10):
            copy[at] = f"edit{rng.randrange(9000)}"
        one, two = " ".join(words), " ".join(copy)
        if len(shared := pieces(one) & pieces(two)) == 1 and five_word_similarity(one, two) >= 0.8:
            break
    cuts = [0, *(k + 1 for k, w in enumerate(words) if decontaminate.word_hash(w.encode()) % near_duplicates.CUT == 0)]
    hot = next(" ".join(words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if xxhash.xxh64_intdigest(" ".join(words[a:b]).encode(), simhash.SEED) in shared)
    docs = [(1, one), (2, two)]
    for i in range(3, 60):
        other = hot + " " + " ".join(f"x{rng.randrange(9000)}" for _ in range(rng.choice([4, 495])))
        if shared <= pieces(other):
            docs.append((i, other))
    assert len(docs) > 20
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for least in (3, 10, 4096):
        roots = {r.doc: r.root.doc for r in near_duplicates.near_duplicate_groups(df, hot=least).collect()}
        assert roots == {d: 1 if d == 2 else d for d, _ in docs}


def test_pairs_within_the_radius_that_share_no_piece_meet(spark):
    rng = random.Random(12)
    while True:
        words = [f"w{rng.randrange(9000)}" for _ in range(1500)]
        cuts = [0, *(k + 1 for k, w in enumerate(words) if decontaminate.word_hash(w.encode()) % near_duplicates.CUT == 0)]
        spans = {xxhash.xxh64_intdigest(" ".join(words[a:b]).encode(), simhash.SEED): a for a, b in zip(cuts, cuts[1:], strict=False)}
        copy = list(words)
        for piece in near_duplicates.outline(" ".join(words))[2]:  # an edit in each piece that the text is dealt by
            copy[spans.get(piece, cuts[-1])] = f"edit{rng.randrange(9000)}"
        one, two = " ".join(words), " ".join(copy)
        (_, a, p, *_), (_, b, q, *_) = near_duplicates.outline(one), near_duplicates.outline(two)
        if not set(p) & set(q) and (a ^ b).bit_count() <= simhash.RADIUS and five_word_similarity(one, two) >= 0.8:
            break
    df = spark.createDataFrame([(1, one), (2, two), (3, " ".join(f"x{rng.randrange(9000)}" for _ in range(1500)))], "doc_id long, text string")
    for hot in (1, 4096):
        assert {r.doc: r.root.doc for r in near_duplicates.near_duplicate_groups(df, hot=hot).collect()} == {1: 1, 2: 1, 3: 3}


def test_share_of_similar_windows_within_the_radius():
    rng = random.Random(14)
    near = total = 0
    for _ in range(3000):
        words = [f"w{rng.randrange(5000)}".encode() for _ in range(rng.randrange(15, 61))]
        copy = list(words)
        for at in rng.sample(range(len(words)), rng.randrange(1, 4)):
            copy[at] = b"edit%d" % rng.randrange(5000)
        a, b = (decontaminate.shingles(x, decontaminate.SHINGLE) for x in (words, copy))
        if decontaminate.similarity(Counter(a.tolist()), Counter(b.tolist())) >= decontaminate.SIMILARITY:
            total += 1
            near += int(np.bitwise_count(decontaminate.simhashes(a, len(a))[0] ^ decontaminate.simhashes(b, len(b))[0])) <= decontaminate.RADIUS
    assert total > 200 and near / total > 0.98


def test_leaks_of_odd_rows(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = [(1, item, "x"), (1, item, None), (None, "pre " + item, "x"), (2, "word " * 60_000 + item, "y"), (3, None, "x"), (4, "", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, __found string")
    bench = spark.createDataFrame([("a", item), ("b", item), (None, item), ("c", None)], "item_id string, text string")
    found = [(r.doc_id, r.item_id, r.similarity, r.first_word) for r in decontaminate.find_leaks(df, bench).collect()]
    assert len(found) == 4 * 3 and (2, "b", 1.0, 60_000) in found and (None, None, 1.0, 1) in found
    left = decontaminate.drop_leaks(df, bench)
    assert left.columns == ["doc_id", "text"] and sorted(r.doc_id for r in left.collect()) == [3, 4]
    assert decontaminate.find_leaks(df.limit(0), bench).collect() == [] and decontaminate.find_leaks(df, bench.limit(0)).collect() == []


def test_near_duplicates_of_odd_rows(spark):
    rng = random.Random(15)
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(200))
    near = base.replace(base.split()[50], "edited")
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(30_000))
    docs = [(None, base), (5, near), (5, "another text with words of its own"), (9, long), (8, long + " more"), (None, None), (3, " \t"), (7, base), (7, base)]
    df = spark.createDataFrame([(d, t, "a", "b") for d, t in docs], "doc_id long, text string, __doc string, node string").repartition(3)
    out = near_duplicates.near_duplicate_stage(spark, df, "")
    assert out.columns == ["doc_id", "text", "node"]
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([(5, near), (5, "another text with words of its own"), (8, long + " more"), (3, " \t")])
    assert near_duplicates.near_duplicate_groups(df.limit(0)).collect() == []


def test_simhash_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "one two three four five", 7, "x", "y", 0), (1, "one two three four five", 8, "x", "y", 0)], "doc_id long, text string, fp int, root string, __least string, component_id int")
    out = simhash.cluster(simhash.fingerprints(df)).collect()
    assert len(out) == 2 and {r.component_id for r in out} == {1} and all(r.fp % (1 << 64) == brute_print("one two three four five") for r in out)


def test_chat_of_odd_tables(spark):
    schema = "tree string, node long, parent long, score double, role string, text string, pos string, leaf string"
    long = "x<" * 100_000
    df = spark.createDataFrame([("t", 1, None, 1.0, "user", long, "a", "b"), ("t", 2, 1, 1.0, "assistant", None, "a", "b"), ("t", 3, 1, 1.0, "assistant", "tie", "a", "b")], schema)
    out = chat.format_trees(df).withColumn("back", chat.parse_turns(F.col("formatted"))).collect()
    assert [[(x.role, x.text) for x in r.back] for r in out] == [[("user", long), ("assistant", "")]]
    assert chat.format_trees(df.limit(0)).collect() == []


def test_suffix_dedup_of_very_long_texts(spark):
    rng = random.Random(16)
    part = "".join(rng.choice("abcdefghij ") for _ in range(2000))
    docs = [(1, "".join(rng.choice("abcdefghij ") for _ in range(150_000)) + part), (2, part * 3 + "z" * 300), (3, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_text(df).collect()}
    assert got == brute_dedup(docs, 100)


def test_stages_of_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, "some item of a few words that is looked for")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {"quality rules": 0, "SimHash near-dedup": 1, "benchmark decontamination": 3, "personal data": 3, "BPE encoding": 3}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        assert len(out.collect()) == kept[name] and out.columns[:5] == df.columns
        assert stage(spark, df.limit(0), str(tmp_path)).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the test tables aren't here")
def test_near_duplicates_of_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in df.collect():
        words = (r.text or "").encode().lower().split()
        sets[r.doc_id] = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    empty = sorted(d for d, s in sets.items() if not s)
    pairs = {(a, b) for ds in holders.values() for a in ds for b in ds if a < b} | set(zip(empty, empty[1:]))
    linked = [(a, b) for a, b in pairs if not sets[a] | sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want = groups(sets, linked)
    assert sum(d != r for d, r in want.items()) > 50
    assert {r.doc: r.root.doc for r in near_duplicates.near_duplicate_groups(df).collect()} == want


def test_a_large_group_of_near_copies_in_blocks(spark):
    rng = random.Random(17)
    base = [f"w{rng.randrange(9000)}" for _ in range(300)]
    docs = []
    for i in range(240):
        words = list(base)
        for at in rng.sample(range(150, 300), rng.choice([1, 2, 4, 7, 12])):  # the first half stays, so all share pieces
            words[at] = f"edit{rng.randrange(9000)}"
        docs.append((i, " ".join(words)))
    docs += [(300 + i, " ".join(base[:150] + [f"x{rng.randrange(9000)}" for _ in range(150)])) for i in range(40)]
    for i in range(5):  # groups of their own among the others
        docs.append((400 + i, docs[240 + i][1] + " end"))
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in docs}
    want = groups(sets, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(set(want.values())) > 30
    for hot in (16, 60, 4096):
        assert {r.doc: r.root.doc for r in near_duplicates.near_duplicate_groups(df, hot=hot).collect()} == want
