"""Source divergence, Merkle manifests and licence scans against brute force, and on edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brickyard.llm import divergence, licenses, merkle
from brickyard.llm.common import plain_words
from brickyard.llm.license_rules import rules

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
CLASH = ("g", "at", "n", "id", "leaf", "altered", "block", "term", "first", "value", "rank", "part", "item", "p", "none", "total", "size", "found", "score", "labels", "__id", "now")


def documents(spark, rows, clash=CLASH):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in clash}).repartition(3)


# Divergence ---------------------------------------------------------------------------------------------------------


def brute_audit(rows, least, top=10):
    seen, docs = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for _, source, lang, _, text in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang or "", source or ""))
        seen[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * v) for t in kept}

        own = shares(seen[lang, source])
        whole = shares(sum((seen[g] for g in groups if g[0] == lang), Counter()))
        pairs = []
        for g in groups:
            if g[0] == lang and g[1] != source:
                other = shares(seen[g])
                pairs.append((g[1], sum((own[t] - other[t]) ** 2 // (own[t] + other[t]) for t in kept)))
        found = [(t, (own[t] - whole[t]) ** 2 // (own[t] + whole[t])) for t in kept if seen[lang, source][t] and own[t] > whole[t]]
        for part, items, most in (("pair", pairs, None), ("term", found, top)):
            for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                out.append((lang, source, part, item, value, k + 1))
    return sorted(out)


def prose(seed=5):
    draw = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in ("ab", "Cd", "éf", "日g", "x") for b in "abcdefgh"]
    rows = []
    for k in range(160):
        lang, source = [("en", "s1"), ("en", "s2"), ("en", "s3"), ("de", "s1"), (None, "s1"), ("", "s2"), ("en", None), ("xx", "alone")][int(draw.integers(8))]
        odds = draw.dirichlet(np.full(len(words), 0.2))
        rows.append((k, source, lang, 1, " ".join(draw.choice(words, int(draw.integers(0, 60)), p=odds)) + f" rare{'q' * k}"))
    rows += [(200, "s9", "en", 1, None), (201, "s8", "en", 1, ""), (202, "s1", "fr", 1, "12 34 !"), (202, "s2", "fr", 1, "once"), (None, "s1", "en", None, "aba aba"), (7, "s1", "en", 1, "aba " * 30_000 + "z" * 40_000)]
    return rows + rows[:5]


@pytest.mark.parametrize("least", [1, 10])
def test_audit_equals_brute_force(spark, least):
    rows = prose()
    got = sorted(map(tuple, divergence.audit(documents(spark, rows), least, width=1 << 14).collect()))
    assert got == brute_audit(rows, least) and len(got) > 50


def test_long_texts_are_cut_between_words(monkeypatch):
    text = ("Aé1b " * 500 + "x" * 400 + ". ").encode() * 3
    monkeypatch.setattr(divergence, "CHUNK", 64)
    chunks = list(divergence.terms(text))
    assert len(chunks) > 50 and sum(chunks, []) == (["aé".encode(), b"b"] * 500 + [b"x" * 400]) * 3
    assert list(divergence.terms(None)) == list(divergence.terms(b"")) == []


def test_audit_of_crowded_sketch_loses_nothing(spark):
    """A sketch with far fewer cells than there are terms."""
    draw = np.random.default_rng(2)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    names = ["".join(draw.choice(letters, 4)) for _ in range(30_000)]
    rows = [(k, f"s{k % 3}", "en", 1, " ".join(draw.choice(names, 400))) for k in range(300)]
    got = sorted(map(tuple, divergence.audit(documents(spark, rows), 10, width=1 << 14).collect()))
    assert got == brute_audit(rows, 10)


def test_sketch_never_underestimates():
    draw = np.random.default_rng(1)
    words = [str(k).encode() for k in range(50_000)]
    docs = draw.integers(1, 15, len(words))
    sketch = np.zeros(divergence.DEPTH << 14, np.int32)
    for some in np.array_split(np.arange(len(words)), 7):
        places = divergence.cells(b"en", [words[i] for i in some], 1 << 14)
        divergence.add(sketch, places.ravel(), np.tile(docs[some], divergence.DEPTH), 10)
    assert (sketch[divergence.cells(b"en", words, 1 << 14)].min(axis=0) >= np.minimum(docs, 10)).all()
    assert sketch.max() == 10


def test_shares_are_exact_for_large_counts(spark):
    rows = [(0, 10, 3), (9 * 10**14, 10**15, 10**6), (123_456_789_012_345, 987_654_321_098_765, 77), (1, 1, 1)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in rows]


def test_audit_of_an_empty_table(spark):
    assert divergence.audit(documents(spark, [])).collect() == []
    got = divergence.audit(documents(spark, [(1, "a", "en", 1, None), (2, "b", "en", 1, "x")])).collect()
    assert sorted(map(tuple, got)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


# Merkle --------------------------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_manifest(rows):
    """The whole tree as nested lists, each row's path by search."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, brute_leaf(r), r))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
        return out

    def path(tiers, i):
        for nodes in tiers[:-1]:
            run = nodes[i - i % 3 : i - i % 3 + 3]
            yield run[: i % 3], run[i % 3 + 1 :]
            i //= 3

    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, leaf, row) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = [*path(trees[s], i), *path(top, k)]
            odd = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            now = brute_leaf((*row[:4], row[4].replace("\n", "") if odd and row[4] is not None else row[4]))
            for left, right in steps:
                now = h(*left, now, *right)
            out.append((row[0], leaf, trees[s][-1][0], top[-1][0], h(*(x for left, right in steps for x in left + right)), now, now == top[-1][0]))
    return out


def leaves(n):
    draw = np.random.default_rng(4)
    sources = [None, "", "a", "b", "é", "hot"]
    rows = [(int(k * 7 % 1009), sources[min(5, int(draw.integers(12)))], None if k % 11 == 0 else "en", None if k % 13 == 0 else k, None if k % 17 == 0 else f"line {k}\nand é" * (k % 3)) for k in range(n)]
    return rows + [(-5, "lone", "x", 1, "a\n" * 200_000), (None, "a", None, None, None), (None, "a", "x", None, None)] + rows[:4]


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_equals_brute_force(spark, levels):
    rows = leaves(400)
    docs = documents(spark, rows)
    got = [tuple(r) for r in merkle.manifest(docs, merkle.without_newlines(docs), height=levels).collect()]
    want = brute_manifest(rows)
    assert Counter(got) == Counter(want)
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_manifest_of_one_row_and_of_none(spark):
    one = documents(spark, [(3, "s", "en", 1, "x")])
    row = merkle.manifest(one, merkle.without_newlines(one)).collect()[0]
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == h()
    none = documents(spark, [])
    assert merkle.manifest(none, merkle.without_newlines(none)).collect() == []


def test_manifest_finds_any_altered_field(spark):
    docs = spark.createDataFrame([(k, "s", "en", k, f"t{k}") for k in range(30)], DOCS)
    fields = [F.col(c) for c in merkle.FIELDS]
    fields[3] = F.when(F.col("doc_id") == 4, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    assert [r.doc_id for r in merkle.manifest(docs, merkle.leaf(fields)).collect() if not r.verified] == [4]


# Licences ------------------------------------------------------------------------------------------------------------


def brute_scan(text):
    """Every rule tried, every two places compared."""
    words = plain_words((text or "").encode())
    line = b" ".join(words)
    places = []
    for k, r in enumerate(rules()):
        for m in re.finditer(b"(?<![^ ])(?:" + r.pattern.encode() + b")(?![^ ])", line):
            a = line[: m.start()].count(b" ")
            places.append((a, a + len(m[0].split(b" ")), k, r))
    out = []
    for a, b, k, r in places:
        over = [
            1 for c, d, j, s in places
            if c <= a and d >= b and (s.priority < r.priority or s.priority == r.priority and ((d - c) > (b - a) or (c, d) == (a, b) and j < k))
        ]
        if r.base or not over:
            out.append((a, b, k, (r.label, r.kind, a, b, r.weight, r.base)))
    return len(words), [x[3] for x in sorted(out, key=lambda x: x[:3])]


TEXTS = [
    None, "", " \n", "no licence here", "Released under the MIT license.", "under the mit license under the MIT License", "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "SPDX-License-Identifier: GPL-3.0-or-later", "CC BY-NC 4.0 and CC BY NC", "cc-by-nc-sa 4.0", "apache license version 2 apache license version 2.0 cc by nc", "the gnu general public license version 3, see the LICENSE file for details",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Copyright (c) 2019 Somebody. All rights reserved. under the mit licenseé", "éunder the mit license", "word " * 50_000 + "under the mit license", "under the MIT license. " * 3_000, "x" * 300_000,
    "https://creativecommons.org/licenses/by-nc-sa/4.0/ is not https://www.apache.org/licenses/LICENSE-2.0",
]


def test_license_scan_equals_brute_force(spark):
    rows = [(k, "s", "en", 1, t) for k, t in enumerate(TEXTS)] + [(None, None, None, None, "mit license"), (1, "s", "en", 1, "isc license"), (1, "s", "en", 1, "isc license")]
    got = licenses.scan(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 1)}
    for k, t in enumerate(TEXTS):
        if k != 1 and (t is None or t.count("MIT") < 100):
            assert (by[k].n_words, [tuple(x) for x in by[k].found]) == brute_scan(t)
    many = next(k for k, t in enumerate(TEXTS) if t and t.count("MIT") > 100)
    assert sum(x.base for x in by[many].found) == 3_000
    assert sorted((r.doc_id or 0, [x.label for x in r.found]) for r in got if r.doc_id in (None, 1)) == [(0, ["mit"]), (1, []), (1, ["isc"]), (1, ["isc"])]
    assert licenses.scan(documents(spark, [])).collect() == []


def test_license_digest(spark):
    got = licenses.digest(licenses.scan(documents(spark, [(k, "s", "en", 1, t) for k, t in enumerate(TEXTS)]))).collect()
    by = {r.doc_id: r for r in got}
    phrases = {"mit": b"under the mit license".split(), "apache-2": b"apache license version 2".split(), "cc-by-nc": b"cc by nc".split()}
    for k, t in enumerate(TEXTS):
        w = plain_words((t or "").encode())
        at = [(i, label) for label, p in phrases.items() for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        r = by[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_stronger_rules_hide_what_lies_within(spark):
    labels = {k: [x[0] for x in licenses.scan_text(t.encode())[1]] for k, t in {
        "tag": "SPDX-License-Identifier: MIT", "text": TEXTS[12], "sa": "cc by sa 4.0", "two": "GPL-3.0 or the ISC license",
    }.items()}
    assert labels == {"tag": ["mit"], "text": ["mit"], "sa": ["cc-by-sa"], "two": ["gpl-3", "isc"]}


def test_there_are_hundreds_of_rules_in_order():
    table = rules()
    assert len(table) > 300 and [r.priority for r in table] == sorted(r.priority for r in table)
    assert all(r.gates and all(r.gates) and 0 < r.weight <= 1 for r in table)


RULES = rules()


@settings(max_examples=600, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_gates_lose_nothing(data):
    """Whatever text a pattern matches, the keywords in it pick the rule."""
    k = data.draw(st.integers(0, len(RULES) - 1))
    pattern = RULES[k].pattern.replace("[^ ]", "[a-z0-9]")
    text = data.draw(st.from_regex(re.compile(pattern, re.ASCII), fullmatch=True)).encode()
    assert k in licenses.signatures().worth_trying(set(text.split(b" ")))


def test_places_covered_by_others():
    draw = np.random.default_rng(8)
    for _ in range(200):
        n = int(draw.integers(1, 12))
        start = draw.integers(0, 8, n)
        end = start + draw.integers(1, 6, n)
        priority = draw.integers(0, 3, n)
        want = [
            any(
                start[j] <= start[i] and end[j] >= end[i]
                and (priority[j] < priority[i] or priority[j] == priority[i] and ((end[j] - start[j]) > (end[i] - start[i]) or (start[j], end[j]) == (start[i], end[i]) and j < i))
                for j in range(n)
            )
            for i in range(n)
        ]
        assert licenses.covered(start, end, priority).tolist() == want
