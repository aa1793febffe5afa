"""Each operator against brute force and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import base64
import hashlib
import re
import tracemalloc
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from brickyard.llm import bpe, components, decontaminate, hnsw, jaccard, pii, quality, substring, toxicity, urlfilter, warc
from brickyard.llm.queries import RANKS

PATH, PATTERN = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(2)


def documents(spark, texts, tmp_path, first=0):
    """A table of documents with columns whose names clash with the operators' own."""
    rows = spark.createDataFrame([(first + k, t, "x", "s", 1) for k, t in enumerate(texts)] + [(None, "a null id", "x", "s", 1)], DOCS)
    wide = rows.withColumns({c: F.lit("clash") for c in ("id", "n", "s1", "key", "block", "part", "score", "hits", "items", "spans", "a", "b", "n_words")})
    wide.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


TEXTS = [
    None, "", " ", "\n\n  x", "it's we'll I'D 'sfoo ''s !'s can't", "a\n b  c\t\td   ", "1234567 ½ ٣", "日本語テキスト é́   x", "\x1c\x85 a", "word " * 3000,
    "x" * 50_000, "<|endoftext|> [INST]", "mail a.b@c.example.org now", "🙂🙂 ok",
]


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_and_round_trips(spark, tmp_path, encoder):
    texts = TEXTS + ["same text"] * 3
    docs = documents(spark, texts, tmp_path)
    got = collected(bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH))
    assert len(got) == len(texts) + 1
    for k, t in enumerate(texts):
        assert np.frombuffer(got[k].ids, np.uint32).tolist() == encoder.encode_ordinary(t or "")
        assert bytes(got[k].decoded).decode() == (t or "") and got[k].n_tokens == len(got[k].ids) // 4
    assert bpe.encode(docs.limit(0), PATH, PATTERN).collect() == []


def test_bpe_cuts_like_the_pattern():
    draw = np.random.default_rng(3)
    signs = list("ab'strevml  \n\t1½é!,|日") + ["'s", "'ll", " '"]
    texts = ["".join(draw.choice(signs, 40)) for _ in range(500)]
    whole, at, ends = bpe.cut(texts)
    stops = [*at[1:].tolist(), len(whole)]
    got = [whole[a:b] for a, b in zip(at.tolist(), stops)]
    assert got == [m for t in texts for m in __import__("regex").findall(PATTERN, t)]
    assert bpe.cut([]) [1].tolist() == [] and bpe.cut(["", ""])[1].tolist() == []


def test_bpe_decode_rejects_unknown_ids(spark):
    bad = spark.createDataFrame([(1, np.array([60_000], np.uint32).tobytes())], "doc_id long, ids binary")
    with pytest.raises(Exception, match="vocabulary|out of bounds|IndexError"):
        bpe.decode(bad, PATH).collect()
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), PATH).first().decoded is None


def brute_components(sets, ids):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(ids, 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((root(i), root(j)))
            up[y] = x
    return {i: root(i) for i in ids}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_copies(seed=1):
    """Random texts, chains of edits and a large group of near copies over a shared passage."""
    draw = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    base = list(draw.choice(words, 120))
    for _ in range(60):
        t = base.copy()
        for _ in range(int(draw.integers(0, 4))):
            t[int(draw.integers(len(t)))] = str(draw.choice(words))
        out.append(" ".join(t))
    chain = list(draw.choice(words, 80))
    for _ in range(12):
        chain = chain.copy()
        chain[int(draw.integers(len(chain)))] = "new"
        out.append(" ".join(chain))
    passage = " ".join(draw.choice(words, 30))
    out += [passage + " " + " ".join(draw.choice(words, int(n))) for n in draw.integers(1, 60, 40)]
    return out + ["short text", "short text", "SHORT  text", "a b c d", None, "", " \t", "one"]


def test_jaccard_join_equals_brute_force(spark, tmp_path):
    texts = near_copies()
    docs = documents(spark, texts, tmp_path)
    got = collected(jaccard.near_duplicates(docs))
    sets = {k: shingles(t) for k, t in enumerate(texts)}
    want = brute_components(sets, range(len(texts)))
    assert {k: (got[k].n_shingles, got[k].component_id) for k in want} == {k: (len(sets[k]), want[k]) for k in want}
    assert got[None].component_id is None and got[None].n_shingles == 1
    assert jaccard.near_duplicates(docs.limit(0)).collect() == []


def test_jaccard_keeps_repeated_ids(spark):
    rows = frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "other words in this one here")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(rows).drop("group_id", "text_hash").collect())) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (2, 2, 2)]


def test_count_tree_loses_no_pair():
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 1 << 62, 300).astype(np.uint64)) for _ in range(300)]
    sets += [np.unique(np.concatenate([s[:280], draw.integers(0, 1 << 62, 15).astype(np.uint64)])) for s in sets[:150]]
    points = np.array([np.frombuffer(jaccard.point(s), np.uint8) for s in sets])
    both = jaccard.overlaps(sets)
    n = np.array([len(s) for s in sets])
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(7 * both >= 3 * (n[:, None] + n), 1)))}
    for of in (np.arange(len(sets)), np.arange(len(sets)) % 50):
        found = {(min(a, b), max(a, b)) for i, j, _ in jaccard.CountTree(points, n, of).pairs() for a, b in zip(i.tolist(), j.tolist())}
        assert {(a, b) for a, b in want if of[a] != of[b]} <= found and len(found) < 3_000 and not any(of[a] == of[b] for a, b in found)
    assert len(want) >= 100


@pytest.mark.parametrize("leaf, cell, block", [(4, 8, 4), (4, 4_096, 2), (16, 4_096, 384)])
def test_jaccard_join_in_small_cells(spark, tmp_path, monkeypatch, leaf, cell, block):
    """Shards cut into bands and parts, and components that blocks of copies leave apart, give the same answer."""
    for name, value in (("LEAF", leaf), ("CELL", cell), ("BLOCK", block)):
        monkeypatch.setattr(jaccard, name, value)
    texts = near_copies(3)
    got = collected(jaccard.near_duplicates(documents(spark, texts, tmp_path)))
    want = brute_components({k: shingles(t) for k, t in enumerate(texts)}, range(len(texts)))
    assert {k: got[k].component_id for k in want} == want


def test_components(spark):
    links = frame(spark, [(k, k + 1) for k in range(40)] + [(50, 51), (51, 50), (60, 60), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 50: 50, 51: 50}
    assert components.connected_components(links.limit(0)).collect() == []


def test_near_vectors_equal_brute_force(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(60, 16))
    x[20:40] = x[:20] + 0.1 * draw.normal(size=(20, 16))
    x[40:45] = x[0]
    x[45] = 3 * x[1]
    rows = [(k, v.astype(np.float32).tolist(), k % 2) for k, v in enumerate(x)]
    odd = [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, [1.0, None], 1), (104, x[0].tolist(), None), (105, [], 1), (106, [1.0, 2.0], 1), (None, x[0].tolist(), 0)]
    vectors = frame(spark, rows + odd, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("rep", "copies", "kind", "shard", "e")})
    got = collected(hnsw.near_duplicates(vectors, shard=20), "vec_id")
    y = np.array([r[1] for r in rows], np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    close = (y @ y.T >= 0.93) & (np.arange(60)[:, None] % 2 == np.arange(60) % 2)
    np.fill_diagonal(close, False)
    assert {k: got[k].n_links for k in range(60)} == dict(enumerate(close.sum(1).tolist()))
    for k in range(60):
        reach, todo = {k}, [k]
        while todo:
            new = set(np.flatnonzero(close[todo.pop()]).tolist()) - reach
            reach |= new
            todo += new
        assert got[k].component_id == min(reach) and got[k].kept == (k == min(reach))
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(100, 107))
    assert got[None].n_links == 0 and got[None].component_id is None
    assert hnsw.near_duplicates(vectors.limit(0)).collect() == []


def test_graph_search_finds_neighbours():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(1500, 24))
    x[700:900] = x[0] + 0.15 * draw.normal(size=(200, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.Graph.unpack(x, hnsw.Graph.build(x).pack())
    q, k = hnsw.pairs_above(graph, x, 0.9)
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(x @ x.T >= 0.9))))
    assert len(want & set(zip(q.tolist(), k.tolist()))) >= 0.9 * len(want)


def test_repeated_passages(spark, tmp_path):
    draw = np.random.default_rng(6)
    text = lambda n: " ".join(f"v{k}" for k in draw.integers(0, 5_000, n))
    passage, short = text(60), text(30)
    texts = [f"{text(80)} {passage} {text(40)}", text(150), f"{passage} {text(90)}", f"{text(30)} {short} {text(60)}", f"{text(60)} {short}", text(70), None, "", "x"]
    texts += [texts[5]] * 2
    edited = passage.split()
    edited[30] = "changed"
    texts.append(f"{text(20)} {' '.join(edited)}")
    got = substring.near_passages(documents(spark, texts, tmp_path)).collect()
    assert {r.doc_id for r in got} | {r.match_id for r in got} == {0, 2, 5, 9, 10, 11}
    whole = {(r.doc_id, r.match_id, r.n_words) for r in got if r.match_id == 5}
    assert whole == {(9, 5, 70), (10, 5, 70)}
    hit = next(r for r in got if (r.doc_id, r.match_id) == (2, 0))
    assert (hit.start_word, hit.n_words, hit.match_start) == (0, 60, 80)
    assert substring.near_passages(documents(spark, [], tmp_path)).collect() == []


def test_passages_around_a_common_sentence_meet(spark, tmp_path):
    """A passage that is mostly a sentence of many documents is found although other documents lie between."""
    draw = np.random.default_rng(8)
    text = lambda n: " ".join(f"v{k}" for k in draw.integers(0, 50_000, n))
    common = text(30)
    around = [(text(10), text(10)) for _ in range(20)]
    texts = [f"{text(40)} {a} {common} {b} {text(40)}" for a, b in around]
    texts += [f"{text(40)} {text(10)} {common} {text(10)} {text(40)}" for _ in range(40)]
    texts += [f"{text(40)} {a} {common} {b} {text(40)}" for a, b in around]
    got = {(r.doc_id, r.match_id, r.start_word, r.n_words) for r in substring.near_passages(documents(spark, texts, tmp_path)).collect()}
    assert got == {(60 + k, k, 40, 50) for k in range(20)}


def test_passages_with_inserted_and_deleted_words(spark, tmp_path):
    draw = np.random.default_rng(9)
    text = lambda n: [f"v{k}" for k in draw.integers(0, 50_000, n)]
    first, second = text(60), text(98)
    texts = [text(30) + first + text(30), text(30) + second + text(30), first[:30] + ["new"] + first[30:], text(20) + second[:49] + second[50:]]
    got = {(r.doc_id, r.match_id, r.start_word, r.n_words) for r in substring.near_passages(documents(spark, [" ".join(t) for t in texts], tmp_path)).collect()}
    assert got == {(2, 0, 0, 61), (3, 1, 20, 97)}


def test_near_passages_against_brute_force(spark, tmp_path):
    """Every edited passage whose shingles, by brute force, are 0.75 similar or more is found."""
    draw = np.random.default_rng(10)
    text = lambda n: [f"v{k}" for k in draw.integers(0, 50_000, n)]
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    texts, want = [], set()
    for _ in range(120):
        passage = text(int(draw.integers(56, 140)))
        copy = list(passage)
        for k in sorted(draw.integers(6, len(passage) - 6, int(draw.integers(1, 5))), reverse=True):
            copy[k : k + int(draw.integers(0, 2))] = text(int(draw.integers(0, 2)))
        x, y = shingles(passage), shingles(copy)
        if min(len(passage), len(copy)) >= 50 and len(x & y) >= 0.75 * len(x | y):
            want.add((len(texts) + 1, len(texts)))
        texts += [text(20) + passage + text(20), text(30) + copy + text(10)]
    got = {(r.doc_id, r.match_id) for r in substring.near_passages(documents(spark, [" ".join(t) for t in texts], tmp_path)).collect()}
    assert len(want) > 60 and want <= got


def test_passages_of_repeated_ids_and_repeated_words(spark):
    """Another text of a copy's id keeps its passages; stretches of one word meet whatever lies around them."""
    draw = np.random.default_rng(11)
    text = lambda n: " ".join(f"v{k}" for k in draw.integers(0, 50_000, n))
    passage, whole = text(60), text(70)
    runs = [f"{text(20)} {'the ' * n}{text(20)}" for n in (60, 55, 400, 30)]
    rows = [(0, whole), (1, whole), (1, f"{text(10)} {passage}"), (2, f"{passage} {text(15)}")] + [(10 + k, t) for k, t in enumerate(runs)]
    got = {(r.doc_id, r.match_id) for r in substring.near_passages(frame(spark, rows, "doc_id long, text string")).collect()}
    assert {(1, 0), (2, 1)} <= got and {a for a, _ in got} == {1, 2, 11, 12}


def test_frequent_marks_chain_every_place(spark):
    """Near copies in a large group, each with edits of its own, are all listed; others around the same sentence are not."""
    draw = np.random.default_rng(12)
    text = lambda n: [f"v{k}" for k in draw.integers(0, 50_000, n)]
    base, sentence = text(150), text(40)
    texts = []
    for _ in range(60):
        t = list(base)
        for k in draw.integers(0, 150, 2):
            t[k : k + int(draw.integers(0, 2))] = text(1)
        texts.append(t)
    texts += [text(20) + sentence + text(20) for _ in range(60)]
    got = {r.doc_id for r in substring.near_passages(frame(spark, [(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")).collect()}
    shingles = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    near = {j for j in range(60) for i in range(j) if len(shingles[i] & shingles[j]) >= 0.75 * len(shingles[i] | shingles[j])}
    assert near <= got and not got & set(range(60, 120)) and len(near) > 20


def test_compact_windows_hold_every_minimum():
    h = np.random.default_rng(7).integers(0, 1 << 62, 60).astype(np.uint64)
    windows = substring.compact_windows(h, 10)
    for a in range(60):
        for b in range(a + 9, 60):
            m = a + int(h[a : b + 1].argmin())
            assert sum(i <= a and b <= j and k == m for i, k, j in windows) == 1


def test_quality_ranks_held_out_documents(spark, tmp_path):
    good = [f"The house number {k} stands by a quiet road. It has {k} windows, and a garden." for k in range(60)]
    bad = [f"BUY!!! {k} NOW $$$ %%% ### !!! {k}" for k in range(60)]
    docs = documents(spark, [x for p in zip(good, bad) for x in p] + [None, ""], tmp_path)
    labels = frame(spark, [(k, 1 - k % 2, 0) for k in range(80)] + [(None, 1, 0), (5_000, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, F.col("doc_id") < 80)
    got = collected(quality.score(docs, model, into="own"))
    assert np.mean([(got[k].own >= 0.3) == (k % 2 == 0) for k in range(80, 120)]) > 0.95
    assert got[120].own == got[121].own and 0 <= got[120].own <= 1
    flat = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {round(r.own, 6) for r in quality.score(docs, flat, into="own").collect()} == {0.3}


def test_toxicity_finds_held_out_words(spark, tmp_path):
    draw = np.random.default_rng(8)
    plain = lambda: " ".join(draw.choice([f"w{k}" for k in range(200)], 30))
    texts = [plain() + (" you vile fool" if k % 5 == 0 else "") for k in range(400)] + [None, ""]
    docs = documents(spark, texts, tmp_path)
    labels = frame(spark, [(k, 1, int(k % 5 == 0)) for k in range(300)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") < 300)
    got = collected(toxicity.score(docs, model, into="own"))
    assert np.mean([(got[k].own >= 0.3) == (k % 5 == 0) for k in range(300, 400)]) > 0.95
    assert got[400].own == got[401].own < 0.3
    nothing = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert len({r.own for r in toxicity.score(docs, nothing, into="own").collect()}) == 1


BENCH = [
    (1, "one two three four five six seven eight nine ten eleven"), (10, "short item"), (2, "Short ITEM"), (3, None), (4, ""), (None, "no id at all"), (5, "größe über alles, 123"),
]


def test_benchmark_search_equals_brute_force(spark, tmp_path, monkeypatch):
    texts = [
        "x one two, THREE four-five six seven eight nine ten y", "two three four five six seven eight nine ten eleven", "one two three four", "a short item; a short-item", None, "", "Größe über alles 123",
        "größe über alles 12", "no id at all", "short " * 2000 + "item",
    ]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: word.findall((t or "").translate(low))
    bench = frame(spark, BENCH, "item_id long, text string")
    docs = documents(spark, texts, tmp_path)
    for limit in (decontaminate.ITEM_CHARS_AT_ONCE, 10):
        monkeypatch.setattr(decontaminate, "ITEM_CHARS_AT_ONCE", limit)
        got = collected(decontaminate.digest(decontaminate.find_benchmark(docs, bench)))
        for k, t in enumerate(texts):
            w, hit, items = words(t), set(), set()
            for item, b in BENCH:
                b = words(b) if item is not None else []
                m = min(10, len(b))
                for i in range(len(b) - m + 1 if m else 0):
                    for j in range(len(w) - m + 1):
                        if w[j : j + m] == b[i : i + m]:
                            hit |= set(range(j, j + m))
                            items.add(str(item))
            digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
            assert tuple(got[k])[1:] == (len(w), len(hit), len(items), digest, bool(hit))
    assert [r.n_hit for r in decontaminate.digest(decontaminate.find_benchmark(docs, bench.limit(0))).collect()] == [0] * (len(texts) + 1)


def test_warc_round_trip_rejects_records_in_payloads(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    long = "ü" * 60
    rows = [(1, "http://a.example/é", fake), (2, "u", fake * 3), (3, "u", None), (4, "u", ""), (5, "u\r\nX: y", long), (9, "u", long), (7, None, long), (8, "u", "short"), (6, "u", "short"), (10, "u", "\r\n\r\n"), (11, "u", fake), (None, "u", "no id")]
    rows += [(100 + k, "u", f"page {k} " + fake * (k % 3)) for k in range(60)]
    pages = frame(spark, rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("file", "place", "step", "size", "value", "block")})
    got = collected(warc.round_trip(pages), "page_id")
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, other in rows if (other or "") == (html or "") and j is not None]
        first = min(same) if same and len(data) >= 100 else i
        want = (i, len(data), hashlib.sha256(data).hexdigest(), "response" if first == i else "revisit", None if first == i else first)
        assert tuple(got[i]) == want
    assert warc.round_trip(pages.limit(0)).collect() == []


@pytest.mark.parametrize("most", [0, 1_000])
def test_warc_read_splits_do_not_matter(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(warc, "SEND_SPLITS", most)
    monkeypatch.setattr(warc, "SEND_PAYLOADS", most)
    pages = frame(spark, [(k, "u", f"payload {k} WARC/1.1\r\nContent-Length: 1\r\n\r\n" * 20) for k in range(50)], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3001")
        assert sorted(r.page_id for r in warc.summary(warc.read(spark, str(tmp_path / "w"))).collect()) == list(range(50))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_url_filter_at_its_time(spark):
    ts = "timestamp"
    events = spark.createDataFrame(
        [
            ("host", "a.example.org", "ads", "add", "2024-01-02"), ("host", "a.example.org", "ads", "remove", "2024-01-05"), ("host", "a.example.org", "ads", "add", "2024-01-09"),
            ("domain", "Example.org", "spam", "add", "2024-01-04"), ("domain", "example.org", "spam", "add", "2024-01-06"), ("domain", "example.org", "spam", "remove", "2024-01-07"),
            ("prefix", "a.example.org/en/", "lang", "add", "2024-01-01"), ("host", None, "x", "add", "2024-01-01"), ("host", "b", "x", "remove", "2024-01-01"), ("host", "t", "x", "add", "2024-01-01"), ("host", "t", "x", "remove", "2024-01-01"),
        ],
        "kind string, key string, category string, action string, ts string",
    ).withColumn("ts", F.col("ts").cast(ts))
    cases = [
        (1, "http://A.example.org:80/en/x?q", "2024-01-02", ["ads", "lang"]), (2, "https://u@a.example.org/fr", "2024-01-05", ["spam"]), (3, "http://a.example.org./", "2024-01-10", ["ads"]), (4, "http://z.a.example.org", "2024-01-06", ["spam"]),
        (5, "http://notexample.org/", "2024-01-06", []), (6, None, "2024-01-06", []), (7, "http://example.org/", None, []), (8, "no url", "2024-01-06", []), (9, "http://t/", "2024-01-02", []), (10, "http://example.org", "2024-01-07", []),
    ]
    captures = spark.createDataFrame([c[:3] for c in cases], "capture_id long, url string, fetched string").withColumn("fetched", F.col("fetched").cast(ts)).withColumn("key", F.lit(1))
    got = {r.capture_id: r for r in urlfilter.evaluate(captures, events).collect()}
    assert {k: (r.categories, r.blocked) for k, r in got.items()} == {c[0]: (c[3], bool(c[3])) for c in cases}
    assert not any(r.blocked for r in urlfilter.evaluate(captures, events.limit(0)).collect())
    plan = urlfilter.evaluate(captures, events)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


PII = [
    "a@b.co, x.y@z@q.org @ a@b", "ip 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 0001.2.3.4", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "tel +49 (30) 1234-567 +1 2", "IBAN GB82 WEST 1234 5698 7654 32",
    "GB82WEST12345698765431", None, "", "9" * 30_000, "a" * 30_000 + "@", "é +380001112233 ü b@c.de", "1" * 5_000 + ".2.3.4",
]


def test_pii_keeps_the_base_spans(spark, tmp_path):
    docs = documents(spark, PII, tmp_path)
    got = collected(pii.digest(docs.select("doc_id", pii.spans(F.col("text")).alias("spans"))))
    for k, t in enumerate(PII):
        t, s = t or "", []
        if len(t) < 10_000:
            s += [(m.start(), 0, f"email:{m.start()}:{m.end()}") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        s += [(m.start(), 1, f"ip:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub(r"[ -]", "", m[0])
            if 14 <= len(d) <= 19 and pii.luhn(d):
                s.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
        s += [(m.start(), 3, f"phone:{m.start()}:{m.end()}") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
        base = ",".join(x[2] for x in sorted(s))
        assert got[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), (k, base)
        assert (got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone) == tuple(sum(x[1] == n for x in s) for n in range(4))
    assert got[4].spans == "iban:5:32" and got[5].spans == ""


def test_pii_masks_and_scores():
    assert pii.mask("write a@b.co or +49 301234567") == "write [EMAIL] or [PHONE]"
    assert pii.mask(None) is None and pii.mask("") == ""
    assert pii.find("call +49 301234567")[0][3] > pii.find("x +49 301234567")[0][3]
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")


def test_bpe_raises_where_the_input_changes_between_its_reads(spark):
    """Words whose order differs between the two reads have other checksums."""
    words = [b"one", b" two", b" three"]
    one, other = (next(bpe._send_positions(1)(iter([pa.record_batch([pa.array([1]), pa.array([t]), pa.array([0], pa.int32())], ["id", "text", "part"])]))) for t in ("one two three", "one three two"))
    rows = [(0, 0, bpe._checksum(bpe._crcs(words)), bpe._pack_ids([np.array([k], np.uint32).tobytes() for k in range(3)]))]
    for positions, good in ((one, True), (other, False)):
        frame = pd.DataFrame(rows + [(0, -1, 0, positions.column(3)[0].as_py())], columns=["block", "bucket", "check", "payload"])
        if good:
            assert np.frombuffer(bpe._assemble(frame).ids[0], np.uint32).tolist() == [0, 1, 2]
        else:
            with pytest.raises(RuntimeError, match="differ"):
                bpe._assemble(frame)


def encoded_block(texts, buckets=3):
    """The rows of one block as the tasks of encode make them."""
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), pa.array([0] * len(texts), pa.int32())], ["id", "text", "part"])
    words = [*bpe._encode_words(PATH, PATTERN)(bpe._send_words(buckets)(iter([batch])))]
    return pa.Table.from_batches(words + [*bpe._send_positions(buckets)(iter([batch]))]).to_pandas()


def decoded_batches(ids):
    batch = pa.record_batch([pa.array(range(len(ids))), pa.array(ids, pa.binary())], ["doc_id", "ids"])
    return [*bpe._take_tokens(PATH, ["doc_id", "ids"], 1, "decoded")(iter([batch]))]


def test_bpe_works_in_pieces_with_the_same_ids(monkeypatch, encoder):
    """Pieces of any size, with edges inside and at the ends of documents, and empty ones on both sides of an edge."""
    texts = ["", None, "one two three four five six", "", "seven", "", "eight  nine\n", "x" * 40, "日本 it's", "", " a" * 9, None]
    for piece in (1, 2, 3, 7, 30, 1 << 17):
        monkeypatch.setattr(bpe, "PIECE", piece)
        got = bpe._assemble(encoded_block(texts))
        assert [np.frombuffer(x, np.uint32).tolist() for x in got.ids] == [encoder.encode_ordinary(t or "") for t in texts]
        assert got.n_tokens.tolist() == [len(x) // 4 for x in got.ids]
        assert [bytes(x).decode() for b in decoded_batches(got.ids.tolist()) for x in b.column(2).to_pylist()] == [t or "" for t in texts]
    assert [len(x) for x in bpe._words([])] == [0, 0, 0] and bpe._assemble(encoded_block(["", None])).n_tokens.tolist() == [0, 0]
    assert [b.column(2).to_pylist() for b in decoded_batches([None, b""])] == [[None, b""]] and decoded_batches([]) == []


def test_bpe_needs_little_memory_for_a_block():
    """Arrays over characters, tokens and ids are made in pieces: a pipeline's executor has several such workers at once."""
    texts = ["a bc de f. " * 130] * 1000
    block, ids = encoded_block(texts), [np.full(1_000, 11, np.uint32).tobytes()] * 1_000

    def peak(work, *args):
        tracemalloc.start()
        try:
            work(*args)
            return tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    assert peak(bpe._words, texts) < 20 and peak(bpe._assemble, block) < 20  # 10 and 14; 51 and 28 over the whole block at once
    assert len(decoded_batches(ids)) > 5


def around_a_line(rng, rows, shared):
    """Surroundings of one mark: ``shared`` shingles from before it on are in all rows, the rest is random or an edited copy of an earlier row's."""
    n = 2 * substring.AROUND + 1
    line = rng.integers(1, 1 << 32, shared, np.uint32)
    out = []
    for k in range(rows):
        a = int(substring.AROUND - rng.integers(8, shared - substring.GRAM))
        row = rng.integers(1, 1 << 32, n, np.uint32)
        if k % 3 == 2:  # an earlier row moved by some places, with a few shingles changed
            d = int(rng.integers(-6, 7))
            row = np.roll(out[int(rng.integers(0, k))], d)
            row[rng.integers(0, n, int(rng.integers(0, 25)))] = rng.integers(1, 1 << 32)
            row[substring.AROUND : substring.AROUND + substring.GRAM] = out[0][substring.AROUND : substring.AROUND + substring.GRAM]
        else:
            row[substring.AROUND - 20 : substring.AROUND - 20 + shared] = line
            row[: int(rng.integers(0, 9))] = 0
        out.append(row)
    return np.stack(out)


def test_frequent_marks_link_every_row_that_has_a_passage():
    for seed, rows in ((1, 40), (2, 200), (3, 200)):
        around = around_a_line(np.random.default_rng(seed), rows, 42)
        ids = np.sort(np.random.default_rng(seed).integers(0, rows, rows))
        real = around != 0

        def holds(h, k):
            return bool(substring._holds(((around[h] == around[k]) & real[h])[None])[0]) or substring._over(around[h], around[k])

        got = substring.link_heads(ids, around)
        assert all(ids[k] < ids[h] and holds(h, k) for h, k in got)
        alike = lambda h, k: len(np.intersect1d(around[h][real[h]], around[k][real[k]])) >= substring.SHARED
        assert {h for h, _ in got} == {h for h in range(rows) if any(ids[k] < ids[h] and alike(h, k) and holds(h, k) for k in range(h))}
        assert len(got) > rows // 10


def test_a_line_in_many_surroundings_is_not_aligned_in_pairs(monkeypatch):
    """A line shorter than a passage in 400 different surroundings: no pair has a passage, and none needs an alignment."""
    rng, calls, over = np.random.default_rng(4), [], substring._over
    around = rng.integers(1, 1 << 32, (400, 2 * substring.AROUND + 1), np.uint32)
    around[:, 25:67] = rng.integers(1, 1 << 32, 42, np.uint32)
    monkeypatch.setattr(substring, "_over", lambda x, y: calls.append(1) or over(x, y))
    assert substring.link_heads(np.arange(400), around) == []
    assert len(calls) <= 400


def test_links_that_are_stars_take_no_round(spark, monkeypatch):
    """Stars, and no links at all, are written once; chains still meet."""
    written, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df: written.append(1) or write(df))
    link = lambda pairs: {r.node: r.component for r in components.connected_components(frame(spark, pairs, "a long, b long")).collect()}
    assert link([]) == {} and len(written) == 1
    assert link([(5, 1), (1, 9), (7, 2)]) == {1: 1, 5: 1, 9: 1, 2: 2, 7: 2} and len(written) == 2
    assert link([(k, k + 1) for k in range(300)] + [(400, 399)]) == dict.fromkeys(range(301), 0) | {399: 399, 400: 399}
