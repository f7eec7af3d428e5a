"""Decontamination, collocations and whitening against brute force and odd inputs."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("trailmark.llm.queries")
from trailmark.llm import collocation, decontamination, whitening  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, n_words bigint, hits string, id string, item_id string, phrase string, x string, chunk string"


def table(spark, rows):
    """rows: (doc_id, text, lang)."""
    return spark.createDataFrame([(i, t, g, 7, "h", "i", "j", "p", "x", "c") for i, t, g in rows], DOCS)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def brute_hits(text, items, size=10):
    own, hit, named = words(text), set(), set()
    for name, item in items:
        w = words(item)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            window = w[i : i + size]
            for j in range(len(own) - len(window) + 1):
                if own[j : j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    named |= {str(name)} if name is not None else set()
    return len(own), hit, sorted(named)


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("ab", "Ba", "é", "żó", "x1", "c") for b in ("", "a", "bc", "7", "ñ")]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, some(rng.choice([12, 14, 30]))) for k in range(12)] + [(20, "Ab"), (21, "c C ñañ"), (22, some(9)), (None, some(11)), (23, None), (24, "!?"), (10, "second text of one id " + some(8)), (25, ""), (26, "w" * 400 + " " + some(12))]
    rows = [(0, None), (1, ""), (2, " ... "), (3, "ab"), (3, "ab"), (None, items[0][1]), (4, "Ab" * 3000)]
    for k in range(60):
        parts = [some(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = words(rng.choice(items)[1])
            at = rng.randint(0, max(0, len(w) - 8))
            parts += [rng.choice([" ", ", ", "\n\n", "--"]).join(w[at : at + rng.randint(5, 14)]), some(rng.randint(0, 4))]
        rows.append((10 + k, rng.choice([" ", ".\n"]).join(parts)))
    rows.append((500, (some(20) + " ") * 800 + items[3][1]))
    return items, rows


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_hits_equal_brute_force(spark, leaks, block_bytes):
    items, rows = leaks
    tests = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id bigint, text string, doc_id int")
    got = decontamination.find_contamination(table(spark, [(i, t, "en") for i, t in rows]), tests, block_bytes=block_bytes).collect()
    found = sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"]), tuple(sorted({p for h in r.hits for p in range(h.first, h.last + 1)}))) for r in got)
    want = []
    for i, t in rows:
        n, hit, named = brute_hits(t, items)
        want.append((str(i), n, len(hit), tuple(named), tuple(sorted(hit))))
    assert found == sorted(want)
    assert sum(r.n_hit > 0 for r in got) > 20 and sum(r.n_hit == 0 for r in got) > 3


def test_long_items_are_cut_into_pieces_without_loss(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 7)
    rng = random.Random(8)
    item = " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(60))
    tests = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    pieces = decontamination.item_strings(tests, "item_id", "text", 10).collect()
    got = {w for p in pieces for w in decontamination.windows_of(bytes(p.stream), 10)}
    assert got == set(decontamination.windows_of(decontamination.stream_of(item.encode()), 10)) and len(pieces) > 5


def test_tables_without_rows(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [(r.n_words, r.n_hit, r.contaminated, r.items_sha256) for r in decontamination.contamination_report(table(spark, [(1, "a b", "en")]), none).collect()] == [(2, 0, False, hashlib.sha256(b"").hexdigest())]
    assert decontamination.contamination_report(table(spark, []), none).count() == 0
    assert collocation.mine_phrases(table(spark, [])).count() == 0
    assert collocation.mine_phrases(table(spark, [(1, None, None), (2, " . ", "en")])).count() == 0
    assert whitening.whitening_report(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_shifts_never_jump_over_an_occurrence():
    rng = random.Random(2)
    for _ in range(40):
        letters = rng.choice(["ab", "abc", "abcdefgh"])
        some = lambda n, letters=letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))
        items = [(str(k), some(rng.randint(1, 14))) for k in range(rng.randint(1, 8))]
        text = some(rng.randint(0, 300)) + " " + rng.choice(items)[1]
        search = decontamination.prepare([(k, decontamination.stream_of(t.encode())) for k, t in items])
        hits, named = search.hits([decontamination.stream_of(text.encode())])
        n, hit, want = brute_hits(text, items)
        assert {p for h in hits[0].as_py() for p in range(h["first"], h["last"] + 1)} == hit and sorted(named[0].as_py()) == want


# Collocations


def brute_phrases(rows, longest, least, percent, top):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f.update((lang or "und", *w[i : i + k]) for i in range(len(w) - k + 1))
    f = {p: c for p, c in f.items() if c >= least}
    out = {}
    for p, a in f.items():
        lang, w = p[0], p[1:]
        if len(w) == 1 or any(q[0] == lang and len(q) > len(p) and any(q[1:][i : i + len(w)] == w for i in range(len(q) - len(w))) and 100 * c >= percent * a for q, c in f.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, rows in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(9)
    vocabulary = [*"abcdefghij", "Éa", "été", "nul\x00l", "x y", "日本"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    rows = [(0, None, "en"), (1, "", "en"), (2, "  ,,; ", None), (None, passage, "en"), (3, passage, "en"), (3, passage, "en"), (4, "a " * 3000, "de"), (5, "b c\tb  c,b c\nb c" * 40, None), (6, "...!!!" * 50 + "a b", "en")]
    for k in range(150):
        text = " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ". ", "\n", "?!"]) for _ in range(rng.randint(1, 80)))
        rows.append((10 + k, rng.choice([text, text + passage, passage + "; " + text, passage.upper()]), rng.choice(["en", "en", "fr", None])))
    return rows


@pytest.mark.parametrize(("longest", "least", "percent", "top"), [(5, 12, 100, 2000), (3, 40, 100, 25), (5, 12, 60, 7)])
def test_phrases_equal_brute_force(spark, prose, longest, least, percent, top):
    got = collocation.mine_phrases(table(spark, prose), longest=longest, min_count=least, percent=percent, top=top).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases(prose, longest, least, percent, top)
    assert len(got) > 20


def test_parse_gives_each_passage_the_same_chunks(spark, monkeypatch):
    monkeypatch.setattr(collocation, "SPACING", 4)
    rng = random.Random(3)
    passage = [rng.choice("abcdefghij") + rng.choice("klm") for _ in range(400)]
    texts = [" ".join([rng.choice("xyz") for _ in range(n)] + passage + ["q"] * m) for n, m in ((0, 0), (17, 3), (50, 9))]
    import pyarrow as pa

    row, chunk = collocation.parse(pa.array(texts, pa.large_string()), 5)
    of = [[c for r, c in zip(row, chunk.to_pylist(), strict=True) if r == k] for k in range(3)]
    assert len(set(of[0][2:-2]) & set(of[1]) & set(of[2])) > 40
    # Each chunk's own tokens, one after the other, are the text; its last four begin the next chunk or are breaks.
    for text, parts in zip(texts, of, strict=True):
        own = [t for p in parts for t in p.split(" ")[:-4]]
        assert own == text.split(" ")
        ends = [" ".join(p.split(" ")[-4:]) for p in parts]
        assert all(b.startswith(e) or "." in e for e, b in zip(ends, parts[1:], strict=False)) and ends[-1] == ". . . ."


def test_a_run_without_triggers_is_cut():
    row, h = np.zeros(5000, np.int64), np.zeros(5000, np.uint64)
    own = collocation.mix(sum(h[:1] * f for f in collocation._FACTORS[:4])) & np.uint64(collocation.SPACING - 1)
    starts = collocation.chunk_starts(row, h, 4)
    assert own[0] == 0 or (np.diff(starts).max() == collocation.LONGEST_CHUNK and starts[0] == 0)


def test_scores_of_large_counts_are_exact(spark):
    a, left, right, n = 312_345_678_901_234, 912_345_678_901_237, 498_765_432_109_871, 987_654_321_098_765_432
    frequent = spark.createDataFrame([("en", "u v", a), ("en", "u", left), ("en", "v", right)], "lang string, phrase string, f bigint")
    got = collocation.scored(frequent, spark.createDataFrame([("en", n)], "lang string, n bigint")).collect()
    assert [(r.a, r.l, r.r, r.n, r.score) for r in got] == [(a, left, right, n, 1000 * a * n // (left * right))]


# Whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id bigint, embedding array<double>, x string, n int")


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 7)) @ np.diag([9, 5, 4, 3, 1, 0.5, 0.1]) @ np.linalg.qr(rng.normal(size=(7, 7)))[0] + 20
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[5].tolist()), (None, x[6].tolist()), (900, None), (901, []), (902, [None] * 7), (903, [float("nan")] * 7), (904, [1.0, float("inf"), *x[0, 2:].tolist()]), (905, [1.0, 2.0])]
    got = whitening.whitening_report(vectors(spark, rows)).collect()
    whole = np.floor(256 * x) + 0
    fit = np.unique(whole, axis=0)
    c = fit - fit.mean(0)
    e, v = np.linalg.eigh(c.T @ c / len(fit))
    e, v = e[::-1], v[:, ::-1]
    assert sorted({r.vec_id for r in got if r.vec_id is not None}) == list(range(300)) and len(got) == 4 * 302
    sums = fit.sum(0).astype(int).tolist()
    signs = {}
    for r in got:
        own = [w for i, w in ([(None, whole[6])] if r.vec_id is None else [(0, whole[0]), (0, whole[5])] if r.vec_id == 0 else [(r.vec_id, whole[r.vec_id])])]
        k = r.component - 1
        match = [w for w in own if sum((len(fit) * int(q) - s) ** 2 for q, s in zip(w, sums, strict=True)) == r.deviation]
        assert match and r.n == len(fit) and abs(r.explained - e[k] / e.sum()) < 1e-12 and r.identity_error < 1e-10
        want = (match[0] - fit.mean(0)) @ v[:, k] / np.sqrt(e[k])
        assert abs(abs(r.whitened) - abs(want)) < 1e-9
        if abs(want) > 1e-6:
            assert signs.setdefault(k, np.sign(want * r.whitened)) == np.sign(want * r.whitened)


def test_nearly_dependent_columns_keep_their_small_singular_values():
    """Gram and Cholesky once would lose them: the square of the ratio is below double precision."""
    rng = np.random.default_rng(1)
    u, v = np.linalg.qr(rng.normal(size=(500, 6)))[0], np.linalg.qr(rng.normal(size=(6, 6)))[0]
    s = np.array([1, 1e-2, 1e-5, 1e-8, 1e-10, 1e-11])
    a = u * s @ v.T
    passes = []

    def gram_of(factors):
        passes.append(len(factors))
        q = whitening.solved(a, factors)
        return q.T @ q

    root = whitening.orthogonalised(gram_of, 500, 6)
    assert np.allclose(np.linalg.svd(root)[1] / s, 1, rtol=1e-4) and len(passes) <= whitening.PASSES
    with pytest.raises(np.linalg.LinAlgError):
        np.linalg.cholesky(a.T @ a)


@pytest.mark.parametrize("rows", [[[1.0, 2.0, 3.0]], [[1.0, 2.0, 3.0]] * 3, [[0.0, 0.0, 0.0], [1.0, 2.0, 0.0]], [[float(i), 2.0 * i, 5.0] for i in range(20)], [[1e300, 0.0, 1.0], [-1e300, 1.0, 0.0]]])
def test_components_without_variance_are_null(spark, rows):
    got = whitening.whitening_report(vectors(spark, list(enumerate(rows)))).collect()
    rank = 1 if len({tuple(r) for r in rows}) > 1 else 0
    assert len(got) == 3 * len(rows)
    assert all((r.whitened is None) == (r.component > rank) for r in got)
    assert all((r.identity_error is None) == (rank == 0) and (r.explained > 0.999 if r.component <= rank else r.explained < 1e-9) for r in got)


def test_fewer_entries_than_components(spark):
    got = whitening.whitening_report(vectors(spark, [(i, [i / 7.0, float(i * i % 5)]) for i in range(9)])).collect()
    assert len(got) == 18 and {r.component for r in got} == {1, 2}
