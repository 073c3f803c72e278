"""Whitening, phrase collocations and secret scans: edge cases on small inputs, brute-force twins."""

import base64
import collections
import hashlib
import json
import math
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from motorlytics.llm import phrase_mining, queries, secret_scan, whitening

SF_SMALL = "/root/testdata/sf0.001"


# ---- 11: whitening ------------------------------------------------------------
def brute_whitening(vectors, k):
    """Exact sums, covariance by numpy's symmetric solver."""
    x = [[math.floor(256 * float(c)) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(col) for col in zip(*fit)]
    c = np.array([[float(Fraction(v * n - s, n)) for v, s in zip(row, sums)] for row in fit])
    values, vecs = np.linalg.eigh(c.T @ c / n)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    all_c = np.array([[float(Fraction(v * n - s, n)) for v, s in zip(row, sums)] for row in x])
    return n, [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x], all_c @ vecs / np.sqrt(values), values / (c ** 2).sum() * n


def check_whitened(df, vectors, k=4):
    n, deviation, white, explained = brute_whitening(vectors, k)
    rows = df.collect()
    assert len(rows) == len(vectors) * k
    got = {(r["vec_id"], r["component"]): r for r in rows}
    signs = [np.sign(got[(0, j + 1)]["whitened"] * white[0][j]) for j in range(k)]
    for i in range(len(vectors)):
        for j in range(k):
            r = got[(i, j + 1)]
            assert (r["n"], r["deviation"]) == (n, deviation[i])
            assert r["whitened"] * signs[j] == pytest.approx(white[i][j], abs=1e-8)
            assert r["explained"] == pytest.approx(explained[j], rel=1e-9)
            assert r["identity_error"] < 1e-10


def test_whitening_equals_symmetric_solver_with_copies(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12) + 5
    v[200:] = v[7]  # a third of all rows is one vector
    df = spark.createDataFrame([(i, [float(c) for c in row], "x", 1) for i, row in enumerate(v)], "vec_id long, embedding array<double>, x string, n int").repartition(7)
    check_whitened(whitening.whiten(df, "embedding", ["vec_id"]), v)


def test_whitening_many_blocks_stack_triangles(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    v = np.random.default_rng(5).normal(size=(500, 6))
    df = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>").repartition(9)
    check_whitened(whitening.whiten(df, "embedding", ["vec_id"]), v)


def test_whitening_rows_that_take_no_part(spark):
    good = [[1.0, 0.0, 2.0], [0.0, 3.0, 1.0], [2.0, 2.0, -1.0], [0.5, -1.0, 0.0], [-0.001, 0.0, 1.0]]
    rows = [(i, v) for i, v in enumerate(good)] + [(None, good[0]), (0, good[0])]
    bad = [(20, None), (21, [1.0, None, 2.0]), (22, [1.0, float("nan"), 0.0]), (23, [1.0, float("inf"), 0.0]), (24, [1.0]), (25, [])]
    df = whitening.whiten(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>"), "embedding", ["vec_id"])
    got = df.collect()
    assert collections.Counter(r["vec_id"] for r in got) == {0: 6, 1: 3, 2: 3, 3: 3, 4: 3, None: 3}
    assert {r["n"] for r in got} == {5} and sum(r["explained"] for r in got if r["vec_id"] == 1) == pytest.approx(1)


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [1.0, 2.0])], [(0, [])]])
def test_whitening_without_variance(spark, rows):
    df = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "embedding", ["vec_id"])
    assert df.columns == ["vec_id", *(n for n, _ in whitening.RESULT)] and df.count() == 0


def test_whitening_rank_one_and_huge_entries(spark):
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(line, "vec_id long, embedding array<double>"), "embedding", ["vec_id"]).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)
    huge = [(i, [1e300 * (i % 2), -1e30, float(i)]) for i in range(4)]
    got = whitening.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), "embedding", ["vec_id"]).collect()
    assert {r["n"] for r in got} == {4} and {r["deviation"] for r in got} == {None}
    assert {abs(round(r["whitened"], 6)) for r in got if r["component"] == 1} == {1.0}


@pytest.mark.parametrize("case", ["random", "graded", "equal", "clusters", "singular", "split"])
def test_qd_solver_against_numpy(case):
    rng = np.random.default_rng(11)
    m = 24
    a = rng.normal(size=(m, m))
    if case == "graded":
        a = a * 10.0 ** -np.arange(m)[None, :] * 1.0
    if case == "equal":
        a = np.eye(m) * 3
    if case == "clusters":
        q = np.linalg.qr(a)[0]
        a = q @ np.diag([5.0] * 6 + [5 - 1e-9] * 6 + [1.0] * 12) @ np.linalg.qr(rng.normal(size=(m, m)))[0]
    if case == "singular":
        a[:, 3:] = a[:, :m - 3] * 2
    if case == "split":
        a[:, :8], a[:8, 8:] = np.vstack([a[:8, :8], np.zeros((m - 8, 8))]), 0
    r = np.linalg.qr(a, mode="r")
    d, e, _ = whitening.bidiagonalise(r)
    s = np.linalg.svd(r, compute_uv=False)
    assert np.allclose(np.sqrt(whitening.squared_singular_values(d, e)), s, rtol=1e-12, atol=1e-12 * s[0])
    values, vectors = whitening.principal(r, 1, 8)
    assert np.allclose(values, (s ** 2)[:len(values)], rtol=1e-11)
    assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-9)
    assert np.allclose(r.T @ (r @ vectors.T), vectors.T * values, atol=1e-7 * values[0])


# ---- 12: phrases --------------------------------------------------------------
def brute_phrases(rows, min_count, top, longest=5):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[(lang, *w[i:i + k])] += 1
    cands = {p: a for p, a in f.items() if len(p) >= 3 and a >= min_count}
    out = collections.defaultdict(list)
    for p, a in cands.items():
        if any(q[0] == p[0] and len(q) > len(p) and 100 * b >= 100 * a and any(q[i:i + len(p) - 1] == p[1:] for i in range(1, len(q) - len(p) + 2)) for q, b in cands.items()):
            continue
        cuts = []
        for k in range(2, len(p)):
            left, right = f[p[:k]], f[(p[0], *p[k:])]
            cuts.append((1000 * a * n[p[0]] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return {(g, i + 1, t.decode(), -a, le, r, n[g], -s) for g, found in out.items() for i, (s, a, t, le, r) in enumerate(sorted(found)[:top])}


def phrase_rows():
    rng = np.random.default_rng(2)
    vocab = ["The", "of", "a", "new york", "ça", "É", "x-y", "日本", "zebra\0", "it's"]
    rows = [(" ".join(rng.choice(vocab, size=rng.integers(0, 30))) + str(rng.choice(["", ". End here", "\tA\t b\n", "!?  "])), str(rng.choice(["en", "fr", "de"]))) for _ in range(150)]
    rows += [("New York is a NEW york is", None), ("new york is", "und"), (None, "en"), ("", None), ("...\n\t ,", "fr")]
    rows += [("one two three four five six seven", "en")] * 12 + [("go go go go go go go", "en")] * 4
    return rows + [("la " * 3000 + "fin" + ". a b" * 2000, "fr")]


@pytest.mark.parametrize("budget,slice_bytes", [(1 << 18, 4 << 20), (40, 500), (1, 64)])
def test_phrases_equal_brute_force(spark, budget, slice_bytes):
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, "p", 3) for r in rows], "text string, lang string, phrase string, f int").repartition(3)
    got = phrase_mining.mine(docs, min_count=6, top=25, budget=budget, slice_bytes=slice_bytes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == brute_phrases(rows, 6, 25)


def test_phrases_with_few_bits_only_keep_more(spark, monkeypatch):
    monkeypatch.setattr(phrase_mining, "BITS", 64)
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert {tuple(r) for r in phrase_mining.mine(docs, min_count=9, top=10, budget=60).collect()} == brute_phrases(rows, 9, 10)


def test_phrases_empty_tables_and_rare_words(spark):
    assert phrase_mining.mine(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrase_mining.mine(spark.createDataFrame([("a b c", "en"), (None, None)], "text string, lang string")).count() == 0


def test_phrases_of_two_words_come_from_the_pair_counts(spark, monkeypatch):
    """Pairs that nothing frequent follows are stored once each, not once for each slice as suffixes."""
    rows = [(f"w{i % 40} x{i % 40}, rare{i}", "en") for i in range(400)]
    stored, sizes = phrase_mining.stored, {}

    def counting(df, name):
        out = stored(df, name)
        sizes[name] = out.count()
        return out
    monkeypatch.setattr(phrase_mining, "stored", counting)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert {tuple(r) for r in phrase_mining.mine(docs, min_count=10, top=50, slice_bytes=200).collect()} == brute_phrases(rows, 10, 50)
    assert sizes["phrase-suffixes"] == 0 and sizes["phrase-pairs"] == 40


@pytest.mark.parametrize("times", [30, 2])
def test_phrases_of_words_with_one_hash(spark, times):
    """plumless and buckeroo have one CRC-32; pairs of either are counted apart."""
    rows = [("plumless cat sat; a plumless", "en")] * 30 + [("buckeroo cat ran; a buckeroo", "en")] * times + [("a plumless cat", "de")] * 30
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert {tuple(r) for r in phrase_mining.mine(docs, min_count=9, top=50).collect()} == brute_phrases(rows, 9, 50)


def test_phrase_scores_pass_64_bits(spark):
    big = [("en", "a", 6 * 10 ** 9), ("en", "b", 7 * 10 ** 9), ("en", "a b", 5 * 10 ** 9)]
    got = phrase_mining.collocations(spark.createDataFrame(big, "lang string, phrase string, f long"), spark.createDataFrame([("en", 10 ** 14)], "lang string, n long")).collect()
    assert [(r["a"], r["score"]) for r in got] == [(5 * 10 ** 9, 1000 * 5 * 10 ** 9 * 10 ** 14 // (42 * 10 ** 18))]


# ---- 13: secrets --------------------------------------------------------------
def tlv(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82, n >> 8, n & 255])
    return bytes([tag]) + size + body


RSA = tlv(0x30, tlv(2, b"\0") + b"".join(tlv(2, bytes([1 + i]) * (130 if i in (0, 2) else 65)) for i in range(8)))
PKCS8 = tlv(0x30, tlv(2, b"\0") + tlv(0x30, tlv(6, b"\x2a\x86\x48\x86") + tlv(5, b"")) + tlv(4, RSA))
EC = tlv(0x30, tlv(2, b"\1") + tlv(4, bytes(range(32))) + tlv(0xA0, tlv(6, b"\x2a\x86\x48")) + tlv(0xA1, tlv(3, bytes(40))))
SSH = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"".join(
    len(x).to_bytes(4, "big") + x for x in (b"\0\0\0\x07ssh-rsa" + bytes(30), bytes(200)))


def b64(data):
    return base64.b64encode(data).decode()


def url64(obj):
    return base64.urlsafe_b64encode(json.dumps(obj).encode()).decode().rstrip("=")


def pem(name, data, head=""):
    body = b64(data)
    return f"-----BEGIN {name}-----\n{head}" + "\n".join(body[i:i + 64] for i in range(0, len(body), 64)) + f"\n-----END {name}-----"


JWT = f"{url64({'alg': 'HS256', 'typ': 'JWT'})}.{url64({'sub': '1'})}.c2lnbmF0dXJl"


def brute_base(text):
    """The base contract, kind by kind."""
    word = "".join
    either = lambda s: word(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s)
    assign = f"({either('password')}|{either('passwd')}|{either('secret')}|{either('token')}|{either('api')}_?{either('key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16])


@pytest.mark.parametrize("key,name", [(RSA, "RSA PRIVATE KEY"), (PKCS8, "PRIVATE KEY"), (EC, "EC PRIVATE KEY"), (SSH, "OPENSSH PRIVATE KEY")])
def test_secret_structures_are_confirmed(key, name):
    kinds = lambda t: [(secret_scan.KINDS[k], t[lo:hi]) for lo, k, hi in secret_scan.find_secrets(t) if k > 2]
    text = f"é see {pem(name, key)} end"
    assert kinds(text) == [("pem", pem(name, key))]
    assert ("key64", b64(key)) in kinds(f'k "{b64(key)}" x')
    if key is not SSH:
        assert ("key16", key.hex()) in kinds(f"<{key.hex()}>") and ("key16", key.hex().upper()) in kinds(f"<{key.hex().upper()}>")
        assert ("key16", key[:-1].hex()) not in kinds(f"<{key[:-1].hex()}>")
    broken = key[:1] + bytes([key[1] ^ 1]) + key[2:] if key is not SSH else key[:18] + b"\xff" + key[19:]
    # a whole key inside the broken one is still a key
    assert ("key64", b64(broken)) not in kinds(f'"{b64(broken)}"') and not [k for k, _ in kinds(pem(name, broken)) if k == "pem"]
    if key is RSA or key is SSH:
        assert kinds(f'"{b64(broken)}"') == [] and kinds(f'"{b64(key[:-3])}"') == []


def test_secret_tokens_need_their_header():
    kinds = lambda t: [t[lo:hi] for lo, k, hi in secret_scan.find_secrets(t) if k == 3]
    assert kinds(f"Bearer {JWT}, more") == [JWT]
    assert kinds(f"{url64({'typ': 'JWT'})}.{url64({'sub': '1'})}.c2ln") == []
    assert kinds(f"{url64({'alg': 'none'})}.{url64({'a': 1})}.") and not kinds(f"{url64({'alg': 'HS256'})}.{url64({'a': 1})}.")
    assert kinds("eyJhbGciOiJ.IUzI1NiJ9.xx eyJ" + "a" * 5000 + "." + "b" * 5000) == []


BASE_TEXTS = ["", "password: hunter2hunter2", "PassWord\" =  'abcdefghijkl'", "token = secret: abcdefghijklmnop", "token==abcdefghijkl", "apikey=a api_key = abcdefghijkl.mn",
              "ſecret=abcdefghijkl toKen=abcdefghijkl", "AKIA" + "A" * 14 + " AKIA" + "B" * 13 + " xAKIAKIA" + "9" * 14, "0123456789abcdef" * 3 + "g" + "a" * 15, "ABCDEF0123456789abcdef012345",
              "é" * 50 + "secret : " + "z" * 12 + "日本 token=" + "Z" * 11, "password" * 300 + "=" + "x" * 40, "token" + " " * 2000 + "= " + "f" * 2000, "passwd=\npassword=aaaaaaaaaaaa"]


def test_secret_base_spans_equal_the_contract():
    for text in BASE_TEXTS:
        assert [s for s in secret_scan.find_secrets(text) if s[1] < 3] == brute_base(text), text


def test_secret_scan_of_a_table(spark):
    rows = [(i, t) for i, t in enumerate(BASE_TEXTS)] + [(None, None), (1, BASE_TEXTS[1]), (50, f"{JWT} {b64(PKCS8)} " * 40)]
    df = secret_scan.scan(spark.createDataFrame([(*r, "old", 7) for r in rows], "doc_id long, text string, secrets string, start int"))
    assert df.columns == ["doc_id", "text", "start", "secrets"]
    got = df.select("doc_id", "text", secret_scan.span_list("secrets", secret_scan.BASE_KINDS).alias("b"), F.size("secrets").alias("k")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["b"] == ",".join(f"{secret_scan.KINDS[k]}:{lo}:{hi}" for lo, k, hi in brute_base(r["text"] or ""))
    assert [r["k"] for r in got if r["doc_id"] == 50] == [len(secret_scan.find_secrets(rows[-1][1]))]
    assert secret_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_secret_scan_long_runs_stay_linear():
    text = "MIIEMIIE" * 50_000 + " " + "30820100" * 50_000 + " " + "eyJ." * 50_000 + "-----BEGIN PRIVATE KEY-----" * 2000
    assert all(k < 3 for _, k, _ in secret_scan.find_secrets(text))


def test_secret_query_equals_brute_force(spark):
    got = queries.QUERIES["op13_secret_scans"](spark, SF_SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in queries.documents(spark, SF_SMALL).collect()}
    assert len(got) == len(texts)
    for r in got:
        base = brute_base(texts[r["doc_id"]] or "")
        digest = hashlib.sha256(",".join(f"{secret_scan.KINDS[k]}:{lo}:{hi}" for lo, k, hi in base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in base) for j in range(3)) and r["base_sha256"] == digest


def test_whitening_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()
    by_id = {r["vec_id"]: i for i, r in enumerate(rows)}
    got = queries.QUERIES["op11_embedding_whitening"](spark, SF_SMALL)
    index = spark.createDataFrame(list(by_id.items()), "vec_id long, i long")
    check_whitened(got.join(index, "vec_id").drop("vec_id").withColumnRenamed("i", "vec_id"), [r["embedding"] for r in rows])
