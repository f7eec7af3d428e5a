"""The training-data operators against brute force, round trips and odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("trailmark.llm.queries")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from trailmark.llm import ann, fingerprint, langid, license_scan, line_dedup, mixing, ngram_join, packing, pii, toxicity  # noqa: E402

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORDS = [f"w{i}" for i in range(400)]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, spans string, id string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None, 0.5, "x", "y") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [None, "", "   ", "One.", "one.", "x" * 5000, "É è\n\n|\tA b"]
    for k in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            lines = [" ".join(w[i : i + 10]) for i in range(0, len(w), 10)]
            texts.append("\n".join(lines).capitalize() if k % 2 else "\n".join(lines))
    return texts + [texts[-1], texts[10]]


def test_ngram_components(spark, corpus):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for t in corpus:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r for r in ngram_join.similar_components(docs(spark, corpus)).collect()}
    assert {k: r.component_id for k, r in got.items()} == {i: find(i) for i in range(len(sets))}
    assert {k: r.n_shingles for k, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}


def test_bound_never_loses_a_similar_pair():
    rng = np.random.default_rng(1)
    for _ in range(30):
        base = rng.choice(1 << 60, int(rng.integers(1, 200)), replace=False)
        sets = [base] + [np.unique(np.concatenate([base[rng.random(len(base)) < 0.9], rng.choice(1 << 60, int(rng.integers(0, 8)))])) for _ in range(5)]
        sets = [s for s in sets if len(s)]
        n = np.array([len(s) for s in sets])
        bits = []
        for s in sets:
            width = int(ngram_join.bitmap_bits(len(s)))
            bits.append(np.packbits(np.bincount(s & (width - 1), minlength=width).astype(np.uint8) & 1, bitorder="little").tobytes())
        found = {tuple(sorted(p)) for p in zip(*ngram_join.bound_pairs(n, bits, 75), strict=True)}
        for i in range(len(sets)):
            for j in range(i):
                k = len(np.intersect1d(sets[i], sets[j]))
                if 100 * k >= 75 * (n[i] + n[j] - k):
                    assert (j, i) in found


def test_line_dedup(spark, corpus):
    texts = [t for t in corpus]
    seen, want = set(), []
    for t in texts:
        if t is None:
            want.append((None, 0))
            continue
        lines = t.split("\n")
        live = [i for i, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        for k in range(len(live) - 2):
            run = tuple(lines[i].strip(" \t\r\x0b\x0c") for i in live[k : k + 3])
            if run in seen:
                gone |= set(range(live[k], live[k + 2] + 1))
            seen.add(run)
        want.append(("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    got = sorted(line_dedup.dedup_lines(docs(spark, texts)).collect(), key=lambda r: r.doc_id)
    # Copies that share a text and come later lose all; the order of ids decides, as above.
    assert [(r.text, r.lines_removed) for r in got] == want


def test_fingerprint(spark, corpus):
    rows = sorted(fingerprint.edit_report(docs(spark, corpus)).collect(), key=lambda r: r.doc_id)
    texts = [t or "" for t in corpus]
    for i, r in enumerate(rows):
        t, nxt = texts[i], texts[(i + 1) % len(texts)]
        h = len(t) // 2
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest() and r.n_chars == len(t)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_text = {}
    for t, r in zip(texts, rows, strict=True):
        assert by_text.setdefault("\n".join(sorted(t.split("\n"))), r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)


def test_fingerprint_is_homomorphic(spark):
    f = {r.doc_id: r for r in fingerprint.fingerprint(docs(spark, ["a b c d\ne f g h", "e f g h\na b c d", "a b c d", "e f g h"])).collect()}
    pair = spark.createDataFrame([(f[2].fingerprint, f[3].fingerprint, f[0].fingerprint)], "a array<bigint>, b array<bigint>, c array<bigint>")
    row = pair.select(fingerprint.combine(F.col("a"), F.col("b")).alias("s"), fingerprint.combine(F.col("c"), F.col("b"), -1).alias("d")).first()
    assert f[0].fingerprint == f[1].fingerprint == row.s and row.d == f[2].fingerprint


def test_packing_is_exact(spark, corpus):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(TOKENIZER)
    long = " ".join(random.Random(1).choice(["it's", "<|endoftext|>", "naïve", "a.b", "Ünder", "\x1cq", "İx", "word", "42nd"]) for _ in range(9000))
    texts = [*corpus, long]
    rows = packing.pack_documents(docs(spark, texts).repartition(3), TOKENIZER, length=512, open_windows=4).collect()
    at = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = coder.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        at[r.doc_id] = r.start + r.length
        if at[r.doc_id] == len(ids):
            at[r.doc_id] = ("whole", len(ids))[1]
    assert set(at) == set(range(len(texts)))
    sizes = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sizes.get(r.sequence_id, 0)
        sizes[r.sequence_id] = r.offset + r.length
    assert all(n == 512 or n & (n - 1) == 0 for n in sizes.values())


def test_pii_against_plain_patterns():
    rng = random.Random(3)
    pieces = ["a@b.co", "x_y@d.e.f", "+1 (017) 555-7713", "4929348385146306", "1.2.3.4", "999.1.1.1", "@", "..", "-", " ", "4952 9352-5590 3052", "é", "card", "DE89370400440532013000", "1.2.3.4.5.6.7.8", "+", "0"]
    plain = {
        "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
        "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    }
    digits = lambda s: re.sub("[^0-9]", "", s)
    keep = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 14 <= len(digits(s)) <= 19 and pii.luhn(digits(s)),
        "phone": lambda s: 10 <= len(digits(s)) <= 15,
    }
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        want = {(k, *m.span()) for k, p in plain.items() for m in p.finditer(text) if keep[k](m[0])}
        assert {s[:3] for s in pii.spans_of(text) if s[0] in pii.BASE_KINDS} == want
    assert [s[:3] for s in pii.spans_of("iban DE89370400440532013000.")] == [("iban", 5, 27)]


def test_pii_digest_and_mask(spark, corpus):
    frame = docs(spark, [*corpus, "mail me: a.b@c.org or +1 (017) 555-7713"])
    row = pii.digest(pii.find_pii(frame)).orderBy(F.desc("doc_id")).first()
    assert row.spans == "email:9:18,phone:22:39" and row.base_sha256 == hashlib.sha256(row.spans.encode()).hexdigest()
    masked = pii.mask_pii(frame).orderBy(F.desc("doc_id"))
    assert masked.first().text == "mail me: <EMAIL> or <PHONE>" and masked.where("text is null").count() == 1


def test_nearest_vectors(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(1, 8)), 60, 0)])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(400, None), (401, [0.0] * 8), (402, [None] + [1.0] * 7), (403, [float("nan")] * 8), (404, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest_report(frame, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == [i for i in range(360) if i % 20 == 0]
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        order = [j for j in np.lexsort((np.arange(len(x)), -np.round(s, 12))) if j != q][:5]
        hits += len(set(order) & {j for _, j, _ in found})
        assert [k for k, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(abs(v - s[j]) < 1e-9 for _, j, v in found)
    assert hits >= 0.9 * 5 * len(got)
    assert ann.nearest_report(frame.limit(0)).count() == 0


def test_mixing(spark):
    frame = spark.createDataFrame([(i, "w " * (5 + i % 7), "big" if i % 4 else f"small{i % 3}", i) for i in range(2000)], "doc_id bigint, text string, source string, mix_pass int")
    covered = mixing.mix_sources(frame, repetition_limit=1.5, cover=True)
    counts = {r.doc_id: r["count"] for r in covered.groupBy("doc_id").count().collect()}
    assert len(counts) == 2000 and set(counts.values()) <= {1, 2}
    total = frame.agg(F.sum(mixing.count_tokens(F.col("text")))).first()[0]
    fixed = mixing.mix_sources(frame, repetition_limit=1.2)
    assert fixed.agg(F.sum(mixing.count_tokens(F.col("text")))).first()[0] <= total
    mix = mixing.temperature_weights(spark.createDataFrame([("a", 900), ("b", 100)], "source string, tokens bigint"), target_entropy=0.8)
    assert abs(mix.entropy - 0.8 * np.log(2)) < 1e-6
    assert mixing.mix_sources(frame.limit(0), cover=True).count() == 0


def test_language_id_and_toxicity(spark):
    rng = random.Random(4)
    made = {"aa": ["ba", "bo", "lu", "mi"], "zz": ["xyk", "qwr", "ztt"]}
    rows = []
    for i in range(300):
        lang = "aa" if i % 2 else "zz"
        words = ["".join(rng.choice(made[lang]) for _ in range(2)) for _ in range(25)]
        bad = i % 6 == 0
        rows.append((i, " ".join(words + (["grok", "them"] if bad else [])) + ".", lang, "s", None, int(bad)))
    rows += [(300, None, "aa", "s", None, 0), (301, "12 -", None, None, None, 0), (302, "", "aa", "s", None, 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, toxic int")
    told = {r.doc_id: r for r in langid.language_report(frame).collect()}
    assert all(told[i].lang_pred == ("aa" if i % 2 else "zz") for i in range(300))
    assert all(told[i].lang_pred == "und" for i in (300, 301, 302))
    scored = {r.doc_id: r for r in toxicity.toxicity_report(frame.select("doc_id", "text"), frame.select("doc_id", "toxic")).collect()}
    assert all(scored[i].predicted == (i % 6 == 0) for i in range(300)) and all(0 <= r.score <= 1 for r in scored.values())
    field = langid.fit_language_id(frame)
    words = langid.label_words("bolu lumi bami xykqwr zttxyk qwrztt", field)
    assert [w[1] for w in words] == ["aa"] * 3 + ["zz"] * 3
    empty = frame.limit(0)
    assert langid.language_report(empty).count() == 0 and toxicity.toxicity_report(empty, empty.select("doc_id", "toxic")).count() == 0


def enumerated(e, t):
    """(sum of all paths' weights, posteriors) of one sequence."""
    total, want = 0.0, np.zeros(e.shape)
    for path in np.ndindex(*[e.shape[1]] * len(e)):
        w = np.exp(sum(e[i, s] for i, s in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for i, s in enumerate(path):
            want[i, s] += w
    return total, want / total


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    sizes = [5, 1, 6, 2, 7, 3]
    e, t, ends = rng.normal(size=(sum(sizes), 3)), 2 * rng.normal(size=(3, 3)), np.cumsum(sizes)
    want = np.concatenate([enumerated(e[b - n : b], t)[1] for n, b in zip(sizes, ends, strict=True)])
    for block in (1, 2, 3, 256):
        assert np.allclose(langid.forward_backward(e, ends, t, block), want)


def test_long_texts_are_labelled_exactly():
    rng = np.random.default_rng(1)
    e, t = rng.normal(size=(3000, 4)), rng.normal(size=(4, 4)) + 6 * np.eye(4)
    assert np.allclose(langid.forward_backward(e, np.array([3000]), t), langid.forward_backward(e, np.array([3000]), t, 3000))


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(2)
    sizes = [4, 3, 1]
    ends = np.cumsum(sizes)
    e, t, gold = rng.normal(size=(8, 3)), rng.normal(size=(3, 3)), rng.integers(0, 3, 8)

    def loss(e, t):
        out = 0.0
        for n, b in zip(sizes, ends, strict=True):
            own, g = e[b - n : b], gold[b - n : b]
            out += np.log(enumerated(own, t)[0]) - sum(own[i, s] for i, s in enumerate(g)) - sum(t[x, y] for x, y in zip(g, g[1:], strict=False))
        return out

    d, dt = langid.gradient(e, gold, ends, t)
    for x, found in ((e, d), (t, dt)):
        for at in np.ndindex(*x.shape):
            up, down = x.copy(), x.copy()
            up[at] += 1e-5
            down[at] -= 1e-5
            want = (loss(up, t) - loss(down, t)) if x is e else (loss(e, up) - loss(e, down))
            assert abs(want / 2e-5 - found[at]) < 1e-6


def test_license_scan(spark):
    texts = [None, "", "plain words", "a\nReleased under the MIT License.\nb", "This work is licensed under the GNU General Public License, version 2.", "Licensed under CC BY-NC 4.0.\n" + "x\n" * 9 + "Licensed under the Apache License, Version 2.0."]
    got = {(r.doc_id, r.license, r.first_line) for r in license_scan.scan_licenses(docs(spark, texts)).collect()}
    assert got == {(3, "MIT", 1), (4, "GPL-2.0", 0), (5, "CC-BY-NC-4.0", 0), (5, "Apache-2.0", 10)}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
LINES = [f"words {i} of the other text in the file" for i in range(30)]


@pytest.mark.parametrize("name, notice, last", [("MIT", MIT, 4), ("GPL-3.0", GPL, 3), ("MPL-2.0", MPL, 1)])
def test_license_scan_wrapped(name, notice, last):
    for text in (notice, "\n".join([*LINES, notice, *LINES, *LINES, notice, *LINES])):
        starts = [i for i, line in enumerate(text.split("\n")) if line == notice.split("\n")[0]]
        got = [(first + a, first + b, *hit) for first, _, block in license_scan.candidate_blocks(text) for a, b, *hit in license_scan.classify_block(block)]
        assert [(g[0], g[1], g[2], g[4]) for g in got] == [(i, i + last, name, 1.0) for i in starts]


def test_license_scan_ranks_templates_by_saving():
    rnd = random.Random(5)
    words = [w for _, t in license_scan.TEMPLATES for w in license_scan.wording(t)] + ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    for k, (_, text) in enumerate(license_scan.TEMPLATES):
        # Many templates share most of their words, so the own one may come second by a few bytes.
        ranked = license_scan.ranked_templates(text)
        assert {n: saved for saved, n in ranked}[k] >= ranked[0][0] - 3
        for _ in range(20):
            around = prose(rnd.randrange(400)) + "\n" + text + "\n" + prose(rnd.randrange(400))
            assert k in [n for _, n in license_scan.ranked_templates(around)]
    assert license_scan.classify_block("") == []


def test_license_scan_equals_trying_every_template(monkeypatch):
    rnd, cases = random.Random(6), []
    for _ in range(60):
        parts = [rnd.choice(license_scan.TEMPLATES)[1] if rnd.random() < 0.6 else " ".join(rnd.choices(["some", "other", "licensed", "words", "of", "2.0"], k=rnd.randrange(40))) for _ in range(rnd.randrange(1, 9))]
        cases.append("\n".join(parts))
    found = [license_scan.classify_block(c) for c in cases]
    assert sum(map(len, found)) > 60
    monkeypatch.setattr(license_scan, "ranked_templates", lambda block, level=19: [(0, k) for k in range(len(license_scan.TEMPLATES))])
    assert found == [license_scan.classify_block(c) for c in cases]


def test_license_scan_of_several_notices():
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby given, provided that the above copyright notice and this permission notice appear in all copies."
    names = lambda text: [hit[2] for _, _, block in license_scan.candidate_blocks(text) for hit in license_scan.classify_block(block)]
    assert names("Copyright (c) X. All rights reserved.\n\n" + isc) == ["Proprietary", "ISC"]
    assert names("This work is licensed under the GNU Lesser General Public License, version 3.") == ["LGPL-3.0"]
    lines = {
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
        "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.", "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.", "CC-BY-4.0": "Licensed under CC BY 4.0.", "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
        "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.", "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.", "Unlicense": "This is free and unencumbered software released into the public domain.", "Proprietary": "All rights reserved.",
    }
    assert sorted(names(" ".join(lines.values()))) == sorted(lines)


def test_empty_tables(spark, corpus):
    none = docs(spark, corpus).limit(0)
    for frame in (ngram_join.similar_components(none), line_dedup.dedup_lines(none), fingerprint.edit_report(none), packing.pack_documents(none, TOKENIZER), pii.find_pii(none), license_scan.scan_licenses(none)):
        assert frame.count() == 0


def test_pipeline_stages(spark, corpus):
    import corpus_pipeline

    frame = docs(spark, [*corpus, "!!! 12"]).select("doc_id", "text", "lang", "source", "n_chars")
    told = corpus_pipeline.identify_languages(spark, frame, "")
    lettered = {i for i, t in enumerate([*corpus, "!!! 12"]) if any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in told.collect()} == lettered
    lines = corpus_pipeline.remove_repeated_lines(spark, told, "")
    single = corpus_pipeline.keep_one_of_similar(spark, lines, "")
    texts = {r.doc_id: r.text for r in lines.collect()}
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    groups, left = set(), set(sets)
    while left:
        todo = [min(left)]
        groups.add(todo[0])
        while todo:
            i = todo.pop()
            left.discard(i)
            todo += [j for j in left if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert {r.doc_id for r in single.collect()} == groups
    mixed = corpus_pipeline.mix_by_source(spark, single, "")
    assert {r.doc_id for r in mixed.collect()} == groups and tuple(mixed.columns) == corpus_pipeline.COLUMNS
    packed = corpus_pipeline.pack_sequences(spark, mixed, "")
    assert {r.doc_id for r in packed.collect()} == groups


def test_pipeline_mixes_in_order(spark):
    import corpus_pipeline

    frame = spark.createDataFrame([(i, f"word{i} " * (50 if i % 10 else 5), "en", "large" if i % 10 else "small", 1) for i in range(400)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    ids = [r.doc_id for r in corpus_pipeline.mix_by_source(spark, frame, "").collect()]
    first = {d: k for k, d in reversed(list(enumerate(ids)))}
    again = [k for k, d in enumerate(ids) if first[d] != k]
    assert set(first) == set(range(400)) and again and min(again) > max(first.values())
    assert sum(b < a for a, b in zip(ids[:400], ids[1:400], strict=False)) > 100


def test_nearest_vectors_fills_up_from_further_leaves(spark):
    rng = np.random.default_rng(4)
    # One cluster of 300 rows and 30 of 5 each; id 0 has ten vectors, and id 7 is 40 equal rows.
    centres = rng.normal(size=(31, 6)) * 10
    rows = [(i, (centres[0] + rng.normal(size=6)).tolist()) for i in range(1, 300)]
    rows += [(1000 + i, (centres[1 + i // 5] + 0.01 * rng.normal(size=6)).tolist()) for i in range(150)]
    rows += [(0, (centres[5] + 0.01 * rng.normal(size=6)).tolist()) for _ in range(10)] + [rows[6]] * 40
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(1)
    tree = ann.build_index(frame, leaf_size=8).tree
    found = ann.search(frame, frame, ann.Index(tree, 1, 1.0)).groupBy("query_id").count().collect()
    assert len(found) == 450 and {r["count"] for r in found} == {20}
    few = frame.where("vec_id < 1 or vec_id >= 1140")
    found = ann.search(few, few, ann.Index(tree, 1, 1.0)).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in found} == {0: 10, **{i: 19 for i in range(1140, 1150)}}


def test_tree_grows_with_the_rows(spark):
    rng = np.random.default_rng(5)
    # 60 clusters and a very common vector, which no split can part; clashing names of other columns.
    centres = rng.normal(size=(60, 8)) * 5
    x = np.concatenate([centres[rng.integers(0, 60, 3000)] + 0.5 * rng.normal(size=(3000, 8)), np.repeat(centres[:1], 1000, 0)])
    frame = spark.createDataFrame([(i, v.tolist(), "x", i) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, leaf string, query_id bigint").repartition(3)
    small = ann.build_index(frame, sample=800, calibration=150, leaf_size=256, k=5, leaf_rows=10**9)
    large = ann.build_index(frame, sample=800, calibration=150, leaf_size=256, k=5, leaf_rows=60)
    vectors = ann._vectors(frame, "vec_id", "embedding")
    sizes = [r["count"] for r in ann.indexed_rows(vectors.where("vec_id < 3000"), large.tree).groupBy("leaf").count().collect()]
    assert large.tree.leaves > 4 * small.tree.leaves and max(sizes) <= 120
    assert sorted(n for n in large.tree.leaf if n >= 0) == list(range(large.tree.leaves))
    assert large.recall >= 0.95 and large.visits < large.tree.leaves / 4
    hits = 0
    for q, found in spark_lists(ann.search(frame, frame.where("vec_id % 100 = 3"), large, k=5)).items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += sum(v >= np.sort(s)[-5] - 1e-9 for _, _, v in found)
    assert hits >= 0.9 * 5 * 40
    # The bound of the broadcast holds: 8 components of 8 bytes a node.
    assert len(ann.grow(vectors, small.tree, 6, leaf_rows=60, node_bytes=64 * 60).centroids) <= 60


def spark_lists(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_language_id_of_runs_without_blanks():
    rng = random.Random(3)
    snippets = [(lang, ["".join(rng.choices(chars, k=rng.randint(2, 9))) for _ in range(20)]) for lang, chars in (("aa", "abcdefg"), ("zz", "tuvwxyz")) for _ in range(60)]
    field = langid.fit_field(snippets, epochs=4)
    run = "".join(rng.choices("abcdefg", k=100)) + "".join(rng.choices("tuvwxyz", k=2000))
    share, n = langid._Labeller(field).shares([run, "abcde fgabc"])
    assert share[0].argmax() == 1 and share[0, 1] > 0.9 and n[0] > 60 and n[1] == 2
    pieces = langid.split_words(run)
    grams = lambda w: {w[i : i + 3] for i in range(len(w) - 2)}
    assert set().union(*(grams(p.strip(langid.JOINT)) for p in pieces)) == grams(run)
    # Every n-gram and affix of a word counts, whatever its length; a piece has no affixes at its inner ends.
    for word, affixes in (("abcdefgabcdefgabcdefgtuvw", 8), ("ab", 4), ("a", 2), (langid.JOINT + "abcde", 4)):
        inner = f"<{word}>".replace("<" + langid.JOINT, "")
        row, found = langid.features([word, "x"], frozenset())
        assert (row == 0).sum() == len(inner) - 1 + max(0, len(inner) - 2) + affixes and found.max() < langid.SPACE


def test_fingerprint_keeps_every_row(spark):
    rows = [(1, "a b c d"), (None, "x y z"), (2, "q r s t"), (2, "q r s t"), (2, "other words here"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = fingerprint.edit_report(frame).collect()
    assert sorted(((r.doc_id is None, r.doc_id, r.n_chars) for r in got), key=str) == sorted(((i is None, i, len(t or "")) for i, t in rows), key=str)
    one = next(r for r in got if r.doc_id == 1)
    # The order is null, 1, 2; of the texts that share id 2 the least head is taken.
    assert one.edited_sha256 == hashlib.sha256(b"a bot").hexdigest() or one.edited_sha256 == hashlib.sha256(b"a b " + b"othe"[:3]).hexdigest()
    assert fingerprint.fingerprint(frame).count() == len(rows)


def test_likeness_estimates_the_cosine(spark):
    rng = random.Random(8)
    words = [rng.choice(WORDS) for _ in range(3000)]
    texts = [" ".join(words), " ".join(words[:2000] + [rng.choice(WORDS) for _ in range(1000)]), " ".join(words[:1000]), " ".join(rng.choice(WORDS) for _ in range(3000)), ""]

    def grams(t):
        w = t.split()
        return {g: sum(1 for _ in own) for g, own in __import__("itertools").groupby(sorted(zip(w, w[1:], w[2:], strict=False)))}

    prints = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    f = fingerprint.fingerprint(prints)
    pairs = f.toDF("i", "a").crossJoin(f.toDF("j", "b")).select("i", "j", fingerprint.likeness(F.col("a"), F.col("b")).alias("near"))
    for r in pairs.collect():
        x, y = grams(texts[r.i]), grams(texts[r.j])
        dot = lambda p, q: sum(n * q.get(g, 0) for g, n in p.items())
        want = 1.0 if r.i == r.j else (dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5 if x and y else 0.0)
        # 128 lanes of +1 and -1: a standard error of about 0.09.
        assert abs(r.near - want) < 0.35


def test_line_dedup_of_rows_that_share_an_id(spark):
    window = "first line\nsecond line\nthird line"
    frame = spark.createDataFrame([(1, window + "\nhere"), (1, window + "\nthere"), (None, window)], "doc_id bigint, text string")
    removed = sorted(r.lines_removed for r in line_dedup.dedup_lines(frame).collect())
    assert removed == [0, 0, 3]


def test_mixing_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)) if i % 50 else None, "large" if i % 3 else ("small" if i % 2 else None), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, mix_place int")
    tokens = {i: len((t or "").split()) for i, t, _, _ in rows}
    source = {i: s or "" for i, _, s, _ in rows}
    totals = {s: sum(n for i, n in tokens.items() if source[i] == s) for s in set(source.values())}
    mix = mixing.temperature_weights(spark.createDataFrame(list(totals.items()), "source string, tokens bigint"), repetition_limit=1.3)
    share = {s: n / sum(totals.values()) for s, n in totals.items()}
    z = sum(p**mix.exponent for p in share.values())
    for r in mix.plan.collect():
        assert abs(r.weight - share[r.source] ** mix.exponent / z) < 1e-9
        assert abs(r.epochs - mix.budget * r.weight / totals[r.source]) < 1e-6 and r.epochs <= 1.3 + 1e-9
    out = mixing.mix_sources(frame, repetition_limit=1.3)
    got = out.select("doc_id", "mix_pass", "mix_block", "mix_key", "mix_place").collect()
    taken = {s: 0 for s in totals}
    for r in got:
        taken[source[r.doc_id]] += tokens[r.doc_id]
    for r in mix.plan.collect():
        # The part pass stops inside one block at the last row that fits.
        assert taken[r.source] <= mix.budget * r.weight + 1e-6 < taken[r.source] + 41
    again = mixing.mix_sources(frame.repartition(7), repetition_limit=1.3).select("doc_id", "mix_pass", "mix_block", "mix_key", "mix_place").collect()
    order = lambda rows: [(r.mix_pass, r.doc_id) for r in sorted(rows, key=lambda r: (r.mix_pass, r.mix_key, r.mix_place))]
    assert order(got) == order(again)
    first = [i for p, i in order(got) if p == 0]
    assert sum(a > b for a, b in zip(first, first[1:], strict=False)) > len(first) / 3


def test_machine_learns_interactions():
    def made(n, seed):
        rng = np.random.default_rng(seed)
        sets, y = [], []
        for _ in range(n):
            has = rng.random(2) < 0.5
            sets.append(sorted({*rng.integers(100, 600, 40).tolist(), *(np.flatnonzero(has) + 1).tolist()}))
            y.append(float(has[0] == has[1]))
        return np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets), np.array(y)

    machine = toxicity.fit_machine(*made(2000, 1))
    row, bucket, y = made(1000, 2)
    term = machine.slot[bucket]
    logit = machine.logits(row[term >= 0], term[term >= 0], len(y))
    assert ((logit >= 0) == (y == 1)).mean() >= 0.95
    for i in range(20):
        own = term[(row == i) & (term >= 0)]
        pairs = sum(machine.v[p] @ machine.v[q] for k, p in enumerate(own) for q in own[:k])
        assert abs(machine.bias + machine.w[own].sum() + pairs - logit[i]) < 1e-9


def test_toxicity_of_odd_samples(spark):
    frame = docs(spark, ["good words", None, "bad words", "bad words"])
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    for labels in (none, spark.createDataFrame([(0, 0), (1, 0), (2, 0), (2, 0)], none.schema), spark.createDataFrame([(None, 1), (2, 7), (3, 1)], none.schema)):
        scores = toxicity.toxicity_report(frame, labels).collect()
        assert len(scores) == 4 and all(0 <= r.score <= 1 for r in scores)


def test_batched_bounds_are_those_of_a_pair():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    n, bits = [], []
    for _ in range(80):
        s = rng.choice(300, int(rng.integers(1, 200)), replace=False)
        width = int(ngram_join.bitmap_bits(len(s)))
        n.append(len(s))
        bits.append(np.packbits(np.bincount(s & (width - 1), minlength=width).astype(np.uint8) & 1, bitorder="little").tobytes())
    p, q = rng.integers(0, 80, 400), rng.integers(0, 80, 400)
    near = [k for k in range(400) if p[k] != q[k] and min(n[p[k]], n[q[k]]) * 100 >= 75 * max(n[p[k]], n[q[k]])]
    p, q = p[near], q[near]
    got = ngram_join.bounded_rows(np.array(n)[p], np.array(n)[q], pa.array([bits[i] for i in p]), pa.array([bits[i] for i in q]), 75)
    assert got.tolist() == [len(ngram_join.bound_pairs(np.array([n[i], n[j]]), [bits[i], bits[j]], 75)[0]) > 0 for i, j in zip(p, q, strict=True)]


def test_tables_of_many_tasks_are_gathered_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GATHER", 3)
    texts = [f"a b c d e f{i}" for i in range(40)]
    whole = ngram_join.frequency_sketch(docs(spark, texts).coalesce(1), 5)
    assert (ngram_join.frequency_sketch(docs(spark, texts).repartition(16), 5) == whole).all() and whole.sum() == 80


@pytest.mark.parametrize("sized", [0, 30_000])
def test_null_and_shared_ids_and_long_texts(spark, sized):
    """Null ids, rows that share an id, a very long text and names that clash go through every operator."""
    rng = random.Random(3)
    long = "\n".join(" ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(sized // 12)) or None
    rows = [(1, "one two three four five six"), (1, "a different text under the same id"), (None, "one two three four five six"), (None, None), (3, long), (3, long), (4, "")]
    frame = spark.createDataFrame([(i, t, "en", "s", 0, 1.0, "c0", "x") for i, t in rows], "doc_id bigint, text string, lang string, source string, mix_pass int, score double, lang_pred string, lines_before string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1)], "doc_id bigint, toxic int")
    told = langid.language_report(frame).collect()
    assert len(told) == len(rows) and all(r.held_out is not None and (r.doc_id is not None or not r.held_out) for r in told)
    by_text = sorted((str(r.doc_id), r.lang_pred) for r in told)
    lettered = {(str(i), bool(t)) for i, t in rows}
    assert all(p == ("en" if (i, True) in lettered and (i, False) not in lettered else p) for i, p in by_text) and sum(p == "und" for _, p in by_text) == sum(not t for _, t in rows)
    judged = toxicity.toxicity_report(frame, labels).collect()
    assert len(judged) == len(rows) and all(r.held_out is not None and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in judged)
    assert fingerprint.edit_report(frame).count() == len(rows)
    assert ngram_join.similar_components(frame).count() == len(rows)
    assert [(r.n_email, r.spans, r.scores) for r in pii.digest(pii.find_pii(frame)).collect()] == [(0, "", "")] * len(rows)
    noted = frame.withColumn("text", F.when(F.col("text") == "", "MIT License").when(F.col("text").isNull(), "mail a.b@c.de or +49 30 1234567, SPDX-License-Identifier: ISC").otherwise(F.col("text")))
    assert sorted((str(r.doc_id), r.license) for r in license_scan.scan_licenses(noted).collect()) == [("4", "MIT"), *[(str(i), "ISC") for i, t in rows if t is None]] or sized == 0
    assert {(str(r.doc_id), r.spans.count("email"), len(r.scores.split(","))) for r in pii.digest(pii.find_pii(noted)).collect() if r.spans} == {(str(i), 1, 2) for i, t in rows if t is None}
    assert license_scan.scan_licenses(frame).count() == 0
    assert line_dedup.dedup_lines(frame).count() == len(rows)
    mixed = mixing.mix_sources(frame, cover=True)
    assert mixed.count() == len(rows) and mixed.columns.count("mix_pass") == 1
    packed = packing.pack_documents(frame, TOKENIZER)
    assert packed.where("start = 0").count() == len(rows)


def test_rows_without_ids_lie_in_blocks_of_their_own(spark):
    texts = [f"text number {i} of many " + "w " * (i % 50) for i in range(3000)]
    frame = spark.createDataFrame([(None, t, "s") for t in texts], "doc_id bigint, text string, source string")
    mixed = mixing.mix_sources(frame, cover=True)
    assert mixed.count() == len(texts) and mixed.select("mix_block").distinct().count() > 1
    half = mixing.mix_sources(frame, repetition_limit=2.0, budget=20_000)
    assert 0 < half.count() < len(texts)


def test_the_fit_passes_over_rows_beyond_its_work(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, " ".join([*rng.sample(WORDS, 30), *(["idiot"] if i % 3 == 0 else [])]) + (" " + " ".join(WORDS) if i == 7 else "")) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    monkeypatch.setattr(toxicity, "PAIR_WORK", 250 * 31 * 31)
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(frame, toxicity.fit_toxicity(frame, labels)).collect()}
    assert all((scores[i] >= 0.5) == (i % 3 == 0) for i, _ in rows)
    monkeypatch.setattr(toxicity, "PAIR_WORK", 0)
    assert toxicity.score_toxicity(frame, toxicity.fit_toxicity(frame, labels)).select("score").distinct().count() == 1


def test_similar_documents_under_one_id(spark):
    import corpus_pipeline

    same, other = "one two three four five six seven", "quite another text that shares no words"
    rows = [(None, same), (1, same), (1, other), (1, other), (None, "a lone text without any name"), (2, None), (3, "")]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.keep_one_of_similar(spark, frame, "")
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, same), (1, other), (None, "a lone text without any name"), (2, None), (3, "")], key=str)
    empty = frame.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name
