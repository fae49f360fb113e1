import hashlib
import random
import time

import numpy as np
import plain
import pytest

from gaugesieve.llm import imatch, licenses, quality, secret_scan

KEY = "Zk3vQ8xLr2TfYw7NcJ5hBd9GmSa4PeUo1XiVtKq6"
SECRETS = [
    (1, None, "a"), (2, "", "a"), (3, 'é password = "hunter2hunter2" x', "a"), (4, "token==abc token: short", None),
    (5, f"AKIA{'A1' * 8} AKIAX and {'0123456789abcdef' * 3}", "b"), (6, f"see {KEY} here", "b"), (7, f"ééé {KEY}{KEY}", "b"),
    (8, "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz", "c"), (9, "a" * 300_000 + " api_key:'" + "x" * 9 + "'", "c"),
    (10, "PASSWORD = nothing12345 paſſwd=aaaaaaaaaaaa", "c"), (10, "PASSWORD = nothing12345 paſſwd=aaaaaaaaaaaa", "c")]


def test_secrets_of_awkward_texts(make_docs):
    got = {r.doc_id: r for r in secret_scan.scan_secrets(make_docs(SECRETS)).collect()}
    for i, text, _ in SECRETS:
        spans = plain.base_spans(text)
        assert got[i].base == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        assert set(filter(None, got[i].base.split(","))) <= set(got[i].spans.split(","))
    assert "random:4:44" in got[6].spans and "random:4:84" in got[7].spans and got[8].spans == ""
    assert secret_scan.scan_secrets(make_docs([])).count() == 0


def test_redaction_keeps_rows_and_columns(make_docs):
    docs = make_docs(SECRETS)
    rows = secret_scan.redacted(docs).collect()
    assert len(rows) == len(SECRETS) and secret_scan.redacted(docs).columns == docs.columns
    text = {r.doc_id: r.text for r in rows}
    assert text[6] == "see [SECRET] here" and text[1] is None and text[8] == SECRETS[7][1] and "hunter2" not in text[3]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)


def test_battery_tells_random_strings_from_words():
    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    random_p = [secret_scan.randomness_p("".join(rng.choice(alphabet) for _ in range(40)), "base62") for _ in range(400)]
    assert sum(p < 0.05 for p in random_p) < 0.12 * 400
    for word in ("abcdefghijklmnopqrstuvwxyzabcdefghijklmnop", "aaaaaaaaaaaaaaaaaaaaaaaaB1", "0000000000000000000000000000000a"):
        assert secret_scan.randomness_p(word, secret_scan.encoding_of(word)) < 0.01
    for word in ("internationalizationInternationalization", "1234567890123456", "administrationconference", "misunderstandings"):
        assert secret_scan.ordinary_p(word) > 0.01
    keys = ["".join(rng.choice(alphabet) for _ in range(24)) for _ in range(300)]
    assert sum(secret_scan.ordinary_p(k) < 0.01 for k in keys) > 0.9 * len(keys)


def test_ordinary_p_is_the_tail_of_odd_pairs():
    import math
    rng = random.Random(4)
    for _ in range(60):
        s = "".join(rng.choice("theanr0123Qz") for _ in range(rng.randint(2, 40)))
        k, n = plain.odd_pairs(s, secret_scan.PAIRS), len(s) - 1
        tail = sum(math.comb(n, i) * secret_scan.ODD**i * (1 - secret_scan.ODD) ** (n - i) for i in range(k, n + 1))
        assert secret_scan.ordinary_p(s) == pytest.approx(tail)


def test_discoveries_are_those_of_the_step_up_rule():
    rng = random.Random(6)
    for _ in range(200):
        bins = [rng.choice((0, 0, 0, rng.randrange(64))) for _ in range(rng.randint(1, 80))]
        counts = {(0, b): bins.count(b) for b in bins} | {(3, 0): 5}
        first = secret_scan.discovery_bins(counts, 0.05)
        assert sum(b >= first[0] for b in bins) == plain.step_up([10 ** (-b / 4) for b in bins], 0.05) and first[3] == secret_scan.BINS


def test_planted_keys_are_found_and_prose_is_left_alone(make_docs):
    rng = random.Random(8)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    prose = "the session of the international conference on water resources and regional administration was held there".split()
    rows, keys = [], {}
    for i in range(300):
        words = [rng.choice(prose) for _ in range(40)] + ["Internationalization", "misunderstandings", "1234567890123456", "some-long-hyphenated-name"]
        if i % 3 == 0:
            keys[i] = "".join(rng.choice(alphabet) for _ in range(rng.choice((20, 24, 32, 40, 64))))
            words.insert(rng.randrange(len(words)), keys[i])
        rows.append((i, " ".join(words), "s"))
    got = {r.doc_id: r.spans for r in secret_scan.scan_secrets(make_docs(rows)).collect()}
    found = sum(f"random:{rows[i][1].index(k)}:{rows[i][1].index(k) + len(k)}" in got[i] for i, k in keys.items())
    spans = sum(len(s.split(",")) for s in got.values() if s)
    assert found >= 0.9 * len(keys) and spans - found <= 0.05 * spans


@pytest.mark.parametrize("accent", ["", "é"])
def test_long_texts_are_scanned_in_linear_time(accent):
    rng = random.Random(2)
    strings = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) if i % 2 else "".join(
        rng.choice("ABCDEFGHIJabcdefghijk0123456789") for _ in range(30)) for i in range(500)]
    scanner, index = secret_scan.Scanner(16), licenses.Index()
    notice = " ".join(t for t, _ in licenses.TEMPLATES["mit"][1:2]) + " under the mit license. "
    idf = dict.fromkeys(index.vocabulary, 1.0)

    def seconds(n):
        text = " ".join(accent + s for s in strings * n).encode()
        words = licenses.words_of(((accent + " " + notice) * 20 * n).encode())
        start = time.perf_counter()
        _, base, tested = scanner.scan(text)
        found = index.lookup(words, idf)
        assert len(base) == 250 * n and len(tested) == 250 * n and len(found.base()) == 20 * n and len(found.notices(12, 2, 0.6)) >= 20 * n
        return time.perf_counter() - start
    seconds(1)
    assert seconds(20) < 20 * 4 * max(seconds(1), 0.02)


def test_licenses_of_awkward_texts(make_docs):
    notice = licenses.TEMPLATES["mit"][1][0]
    rows = [(1, None, "a"), (2, "", "a"), (3, "Under the MIT license. Under the MIT-license!", "a"),
            (4, "APACHE License, Version 2.0 and CC BY-NC", None), (5, "x " * 50_000 + notice.capitalize() + ". y", "b"),
            (6, notice.replace("person", "single person"), "b"), (7, "the license of this software is free of charge", "b"),
            (8, "under the mit license under the mit license", "c"), (8, "under the mit license under the mit license", "c"),
            (9, "This work is licensed under the GNU General Public License, version 3.", "c"), (10, "Kelvin K İ mit", "c")]
    got = {r.doc_id: r for r in licenses.scan_licenses(make_docs(rows)).collect()}
    for i, text, _ in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain.license_places(text, licenses.PHRASES)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[5].labels == "mit" and got[5].score == 1.0 and got[5].spans[0].first == 50_000
    assert got[6].labels == "mit" and got[7].labels == "" and got[9].labels == "gpl"
    assert sorted(r.doc_id for r in licenses.scan_licenses(make_docs(rows)).select("doc_id").collect()) == sorted(r[0] for r in rows)
    assert licenses.scan_licenses(make_docs([])).count() == 0


def test_license_labels_agree_with_a_full_alignment(make_docs):
    rng = random.Random(3)
    forms = [(label, text) for label, parts in licenses.TEMPLATES.items() for text, _ in parts]
    rows, planted = [], {}
    for i in range(60):
        label, text = forms[i % len(forms)]
        words = text.split()
        for _ in range(len(words) // 30):  # light damage
            words[rng.randrange(len(words))] = "changed"
        filler = [f"w{rng.randrange(500)}" for _ in range(rng.randint(0, 80))]
        rows.append((i, " ".join(filler + words + filler[::-1]), "s"))
        planted[i] = label
    got = {r.doc_id: r for r in licenses.scan_licenses(make_docs(rows)).collect()}
    for i, text, _ in rows:
        labels = set(filter(None, got[i].labels.split(",")))
        assert labels <= plain.alignment_labels(text, licenses.TEMPLATES, 0.6) | set(filter(None, got[i].base_labels.split(",")))
    assert sum(planted[i] in got[i].labels.split(",") for i in planted) >= 0.9 * len(planted)


def texts_of(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(500)]
    return [(i * 2, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 300))), "s") for i in range(n)]


def test_imatch_edits_and_likeness(make_docs):
    rows = texts_of(5)
    rows += [(1001, rows[3][1], "s"), (1003, rows[3][1], "t"), (1004, None, "s"), (1005, "", "s"), (1006, "?!", "s"), (1007, "é" * 9, "s")]
    got = {r.doc_id: r for r in imatch.imatch(make_docs(rows)).collect()}
    edited = plain.edited_texts([r[:2] for r in rows])
    for i, text, _ in rows:
        assert got[i].n_chars == len(text or "") and got[i].edited_sha256 == hashlib.sha256(edited[i].encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[1001].fingerprint == got[1003].fingerprint == got[6].fingerprint and got[1001].near_next == 1.0
    assert got[1004].fingerprint == got[1005].fingerprint and got[1004].near_next == 1.0
    means = np.mean([[got[i].near_edited, got[i].near_next] for i, _, _ in rows[:60]], axis=0)
    assert means[0] > 0.05 and means[0] > 2 * means[1]


def test_imatch_hashes_the_sorted_lists(make_docs):
    rows = [r[:2] for r in texts_of(11, 50)] + [(201, None), (203, "t1 T1 t2"), (205, "Ünï t3 t3 t4")]
    prints = plain.imatch_prints(rows, imatch.RATES, 1.0, 7.0, 11)
    edited = plain.edited_texts(rows)
    ordered = sorted(i for i, _ in rows)
    text = {i: t or "" for i, t in rows}
    following = {i: text[ordered[(n + 1) % len(ordered)]] for n, i in enumerate(ordered)}

    def shown(p):
        return f"{sum(1 << j for j in p):016x}-" + "".join(f"{(p[j] % 2**64) >> 32:08x}" for j in sorted(p))

    def near(a, b):
        p, q = prints[a], prints[b]
        return len(set(p.values()) & set(q.values())) / len(p.keys() | q.keys()) if p or q else float(a == b)

    for r in imatch.imatch(make_docs([(i, t, "s") for i, t in rows])).collect():
        for t, got in ((text[r.doc_id], r.fingerprint), (edited[r.doc_id], r.edited_fingerprint)):
            assert got == shown(prints[t]) if prints[t] else got.startswith("text-")
        assert r.near_edited == pytest.approx(near(text[r.doc_id], edited[r.doc_id]))
        assert r.near_next == pytest.approx(near(text[r.doc_id], following[r.doc_id]))


def test_order_by_id_in_two_levels(make_docs, monkeypatch):
    monkeypatch.setattr(imatch, "CUTS", 4)
    rows = texts_of(8, 90)
    got = {r.doc_id: (r.text, r.next_text) for r in imatch.with_next(make_docs(rows), "doc_id", "text", rows_per_range=4).collect()}
    assert len(got) == 90
    for n, (i, text, _) in enumerate(rows):
        assert got[i] == (text, rows[(n + 1) % len(rows)][1])


def test_imatch_small_tables_ranges_and_repeats(make_docs):
    assert imatch.imatch(make_docs([])).count() == 0
    one = imatch.imatch(make_docs([(5, "abcd efgh", "s")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcd abcd").hexdigest()
    assert len(imatch.imatch(make_docs([(1, "a b", "s"), (1, "a b", "s"), (None, "c d", "s")])).collect()) == 3
    rows = texts_of(8, 90)
    got = {r.doc_id: (r.text, r.next_text) for r in imatch.with_next(make_docs(rows), "doc_id", "text", rows_per_range=4).collect()}
    for n, (i, text, _) in enumerate(rows):
        assert got[i] == (text, rows[(n + 1) % len(rows)][1])


def test_attention_gradients():
    rng = np.random.default_rng(0)
    w = {"W": rng.normal(size=(4, 3)), "b": rng.normal(size=3), "V": rng.normal(size=(3, 2)), "vb": rng.normal(size=2),
         "U": rng.normal(size=(3, 2)), "ub": rng.normal(size=2), "a": rng.normal(size=2), "c": rng.normal(size=3), "d": np.zeros(1)}
    x, first, y = rng.normal(size=(7, 4)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        z = quality._forward(w, x, first)[0]
        return np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y))

    for name, g in quality._gradients(w, x, first, y, 0.0).items():
        for at in np.ndindex(g.shape):
            kept = w[name][at]
            w[name][at] = kept + 1e-6
            up = loss()
            w[name][at] = kept - 1e-6
            down = loss()
            w[name][at] = kept
            assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_attention_score_is_the_plain_forward_pass():
    rng = np.random.default_rng(3)
    bags = [rng.random((n, quality.FEATURES)).astype(np.float32) for n in (1, 4, 2, 6, 3, 5)]
    model = quality.fit_attention(bags, [0, 1, 0, 1, 1, 0], hidden=3, gates=2, epochs=2)
    for bag, got in zip(bags, model.score(bags)):
        assert got == pytest.approx(plain.attention_score(model, bag), abs=2e-6)


def test_quality_is_learned_and_held_out_rows_are_not_used(spark, make_docs):
    rng = random.Random(2)
    good = ["the quick brown fox jumps over lazy dogs and rests".split(), "a calm river runs through old green hills".split()]
    rows = [(i, " ".join(rng.choice(good[i % 2]) for _ in range(rng.randint(5, 300))) if i % 3 else
             "!!! BUY NOW $$$ " * rng.randint(1, 60), "s") for i in range(240)]
    docs = make_docs([*rows, (900, None, "s"), (901, "", "s"), (902, " ".join(rows[1][1] for _ in range(800)), "s")])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i, _, _ in rows] + [(5, None, 0), (None, 1, 0), (7000, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    import zlib
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    got = {r.doc_id: r for r in quality.score_quality(docs, quality.train(docs, labels)).collect()}
    assert {i for i, r in got.items() if r.held_out and i < 900} == held
    assert all(got[i].predicted == int(i % 3 > 0) for i in held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].score == got[901].score and got[902].predicted == 1
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) AS quality")
    again = {r.doc_id: r.score for r in quality.score_quality(docs, quality.train(docs, flipped)).collect()}
    assert all(again[i] == pytest.approx(got[i].score, abs=1e-5) for i in again)


def test_quality_without_labels_or_documents(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = make_docs([(1, "a b", "s")])
    assert quality.score_quality(docs, quality.train(docs, none)).first().score == 0.5
    assert quality.score_quality(make_docs([]), quality.train(docs, none)).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.score_quality(docs, quality.train(docs, one)).first().predicted == 1


def test_secrets_beside_names_paths_and_patterns(make_docs):
    short = "q7Xr2LmZ9vTb4KwN"
    url = KEY[:20] + "-" + KEY[20:]
    texts = [f"AWS_SECRET_ACCESS_KEY={KEY}", f"GITHUB_PAT=ghp_{KEY[:36]}", f"x?key=AIza{KEY[:35]}&y", f"host/path/ghp_{KEY[:36]}",
             f"é {short} é", f"{'0123456789abcdef' * 2}/{KEY}", f"AKIA{'A1' * 8}/{KEY}==", f"é a/b={url}= x", "a=b=c/d-e_f+g ==="]
    docs = make_docs([(i, t, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: set(r.spans.split(",")) for r in secret_scan.scan_secrets(docs).collect()}
    clean = {r.doc_id: r.text for r in secret_scan.redacted(docs).collect()}
    for i, key in enumerate([KEY, f"ghp_{KEY[:36]}", f"AIza{KEY[:35]}", f"ghp_{KEY[:36]}", short, KEY, KEY, url]):
        assert key[4:] not in clean[i] and "[SECRET]" in clean[i], (i, clean[i])
    assert "random:22:62" in got[0] and "random:11:51" in got[1] and "random:2:18" in got[4] and "random:6:48" in got[7]
    assert got[8] == {""} and clean[8] == texts[8]


def test_pieces_are_the_longest_that_an_alphabet_covers():
    assert secret_scan.pieces_of("a/b-c/d=e==") == [(0, 3), (2, 5), (4, 7), (8, 11)]
    assert secret_scan.pieces_of("===") == [] and secret_scan.pieces_of("=ab-c") == [(1, 5)]
    assert secret_scan.beside(0, 10, [(-2, 1), (3, 5), (4, 6), (9, 12)]) == [(1, 3), (6, 9)]


def test_every_notice_of_a_long_text_has_its_votes(make_docs):
    mit, bsd, gpl = (licenses.TEMPLATES[k][i][0] for k, i in (("mit", 1), ("bsd", 0), ("gpl", 0)))
    rows = [(i, gpl, "s") for i in range(30)] + [(100, f"{mit} {'x ' * 50} {bsd} {'y ' * 50} {gpl}", "s")]
    got = {r.doc_id: r for r in licenses.scan_licenses(make_docs(rows)).collect()}
    assert got[100].labels == "bsd,gpl,mit" and [s.label for s in got[100].spans] == ["mit", "bsd", "gpl"]


def test_fitted_passages_are_bounded(spark, make_docs):
    rows = [(i, f"word{i % 5} " * (64 * (1 + i % 4)), "s") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    taken = []

    def fit(bags, y, **_):
        taken.append((len(bags), sum(map(len, bags))))
        return quality.AttentionModel(None)
    original, quality.fit_attention = quality.fit_attention, fit
    try:
        for bound in (10_000, 30, 0):
            quality.train(make_docs(rows), labels, max_passages=bound)
    finally:
        quality.fit_attention = original
    assert taken[0][0] > 40 and 20 < taken[1][1] <= 30 and taken[2] == (0, 0)
