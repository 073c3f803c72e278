"""Edge cases of the operators on small inputs: nulls, empty and long texts, ties,
repeated rows, empty tables, clashing extra columns; brute-force twins where SQL
cannot express the operator."""

import collections
import decimal
import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from motorlytics.llm import (bpe_automaton, chat_format, components, decontaminate, line_runs, ngram_join, nn_descent, quality_fm,
                             suffix_dedup, token_rollup, url_filter)
from motorlytics.sources.io import shared_path

DOCS = "doc_id long, text string"
LONG = "this is a line that is long enough to count as a key"


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ---- 3: line dedup ----------------------------------------------------------
def brute_lines(rows, min_chars=40, min_docs=5):
    white, upper = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(white).translate(upper)
    holds = collections.defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= min_chars:
                holds[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(holds[key(x)]) < min_docs or max(holds[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup_edge_cases(spark):
    rows = [(i, f"own line number {i}\n  {LONG.upper() if i % 2 else LONG}\t\nshort") for i in range(7)]
    rows += [(7, None), (8, ""), (None, LONG), (9, "\n".join([LONG] * 3)), (9, "\n".join([LONG] * 3)), (10, "é" * 39), (11, "é" * 40 + "É")]
    rows += [(20 + i, "É" * 40 + "\n" + "é" * 40) for i in range(5)]
    extra = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS + ", h1 int, dropped string, lines string")
    done = line_runs.dedup_lines(extra)
    assert done.columns == [*extra.columns, "line_dedup"]
    assert rows_of(done.select("doc_id", "line_dedup.*"), "doc_id", "n_lines", "n_dropped", "kept") == brute_lines(rows)


def test_line_dedup_empty_table(spark):
    assert line_runs.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_line_runs_levels_and_unseen(spark):
    store = line_runs.LineRuns(spark, n_buckets=2, fanout=2)
    batch = lambda ids, texts: line_runs.hashed_lines(spark.createDataFrame(list(zip(ids, texts)), DOCS), 1)
    assert store.add(batch([1, 2], ["a\nb", "a"])).count() == 2
    assert store.add(batch([3], ["a\nc"])).count() == 1  # only c is new
    assert [len(x) for x in store.levels] == [0, 1]
    assert store.add(batch([4], ["c\nd"])).count() == 1
    assert [len(x) for x in store.levels] == [1, 1]
    assert store.unseen(batch([5], ["a\ne"])).count() == 1
    assert sorted(r.last_doc for r in store.repeated(2).collect()) == [3, 4]


def test_line_runs_hold_each_line_once(spark):
    """What the anti-join finds unseen is what the next run holds; the rest only counts."""
    store = line_runs.LineRuns(spark, n_buckets=2, fanout=3)
    batch = lambda ids, texts: line_runs.hashed_lines(spark.createDataFrame(list(zip(ids, texts)), DOCS), 1)
    for ids, texts in (([1, 2], ["a\nb", "a"]), ([9, 4], ["a\nc", "c"])):
        store.add(batch(ids, texts))
    first, second = (spark.table(name) for name in store.runs())
    assert sorted(r.last_doc for r in first.collect()) == [1, 2] and [(r.n_docs, r.last_doc) for r in second.collect()] == [(2, 9)]
    assert [(r.n_docs, r.last_doc) for name in store.again[0] for r in spark.table(name).collect()] == [(1, 9)]
    for i in range(5):  # both kinds are compacted
        store.add(batch([20 + i], [f"b\na\nd{i}\nd{i - 1}"]))
    assert sum(spark.table(name).count() for name in store.runs()) == 3 + 6
    assert sorted(r.last_doc for r in store.repeated(5).collect()) == [24, 24]
    assert sorted(r.last_doc for r in store.repeated(2).collect()) == [9, 21, 22, 23, 24, 24, 24]


# ---- 5: n-gram join ---------------------------------------------------------
def word_set(text, size=5):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def brute_components(rows):
    sets = [word_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted(((d, len(sets[i]), min(x for x in least[find(i)] if x is not None) if any(x is not None for x in least[find(i)]) else None)
                   for i, (d, _) in enumerate(rows)), key=repr)


def near_copies(seed=1, n=30):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(6):
        base = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        for _ in range(n):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows) * 3 % 1009, " ".join(text)))
    return rows


@pytest.mark.parametrize("star_rounds", [0, 2])
def test_ngram_components_equal_brute_force(spark, monkeypatch, star_rounds):
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", star_rounds)
    rows = near_copies() + [(5001, None), (5002, ""), (5003, " \t\n"), (5004, "A b"), (5005, "a  B\n"), (5006, "a b c"), (5007, "x " * 30000), (5008, "X " * 30000)]
    got = ngram_join.ngram_components(spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", n int, node int"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_ngram_signatures_never_differ_in_more_bits_than_rows_in_ngrams():
    rng = np.random.default_rng(4)
    for n in (1, 5, 60, 3000):
        x = rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64)
        for changed in {0, 1, n // 9, n}:
            y = x.copy()
            y[:changed] = rng.integers(-(1 << 63), 1 << 63, changed, dtype=np.int64)
            bits = sum(int(w).bit_count() for w in (ngram_join.signature(x) ^ ngram_join.signature(y)).view(np.uint64))
            assert bits <= len(set(x.tolist()) ^ set(y.tolist()))


def test_ngram_null_ids_repeats_and_empty(spark):
    rows = [(3, "one two three four five six"), (3, "one two three four five six"), (None, "one two three four five six"),
            (None, "alone with five words here now"), (1, "seven eight"), (1, "nine ten")]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, DOCS))
    assert rows_of(got, "doc_id", "component_id") == sorted([(3, 3), (3, 3), (None, 3), (None, None), (1, 1), (1, 1)], key=repr)
    assert ngram_join.ngram_components(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 301), (301, 300), (None, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[301] == 300


# ---- 6: suffix array --------------------------------------------------------
def brute_repeats(rows, length):
    seen = collections.Counter()
    for _, t in rows:
        raw = (t or "").encode()
        seen.update(raw[i:i + length] for i in range(len(raw) - length + 1))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if seen[raw[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        n = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), n, bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=repr)


def test_suffix_array_is_sorted():
    rng = random.Random(2)
    for _ in range(400):
        s = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 50))] + [0]
        assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("hot", [0, 500])
def test_suffix_dedup_equals_brute_force(spark, hot):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, other = word(70), word(45)
    rows = [(i, word(rng.randint(0, 60)) + (passage if i % 2 else other) + word(rng.randint(0, 60))) for i in range(24)]
    rows += [(100, None), (101, ""), (102, "a" * 300), (103, "ab" * 100), (104, passage[:35]), (105, rows[0][1]), (105, rows[0][1]), (None, rows[1][1]), (106, "x" * 41)]
    table = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", raw int")
    got = suffix_dedup.remove_repeats(table, length=40, gram=16, hot=hot)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()), key=repr)
    assert got == brute_repeats(rows, 40)


def test_suffix_dedup_chunks_long_texts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    raw = bytes(random.Random(1).choices(range(97, 100), k=1000))
    found = list(suffix_dedup.runs(raw, 40, 16))
    assert [s for _, s, _, _ in found][0] == 0 and sum(w for _, _, w, _ in found) == 1000 - 39


def test_suffix_dedup_splits_buckets_of_many_bytes(spark, monkeypatch):
    ends = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN"  # each in one document only
    rows = [(i, end + (" " if i % 2 else "-=") * (60_000 + 777 * i) + end) for i, end in enumerate(ends)]
    arrays, most = suffix_dedup.array_marks, []

    def seen(strings, length):
        most.append(strings.groupBy("v").agg(F.sum(F.length("bytes")).alias("n")).agg(F.max("n")).first()[0] or 0)
        return arrays(strings, length)

    monkeypatch.setattr(suffix_dedup, "array_marks", seen)
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept).decode()) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: (len(t) - 2, 1, 2 * ends[i]) for i, t in rows}
    assert max(most) <= 2 << 20


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


# ---- 8: BPE -----------------------------------------------------------------
VOCABULARY = bpe_automaton.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_the_tokenizers_library():
    encoder, library = bpe_automaton.Encoder(VOCABULARY), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    bits = ["a", "b", " ", "\n", "\t", "é", "ß", "1", "٣", "'s", "'", "<|endoftext|>", " ", "\x1c", "\x85", "🎉", "漢", "the", "ing", "!", "...", "aaaa", "  ", "​", "½"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + ["", "a" * 20000, "ab" * 5000, " " * 3000, "<|endoftext|>"]
    for text, ids in zip(texts, encoder.encode_batch(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert encoder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_table_stays_bounded(monkeypatch):
    monkeypatch.setattr(bpe_automaton, "TABLE_WORDS", 50)
    encoder, library = bpe_automaton.Encoder(VOCABULARY), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(5):
        texts = [" ".join(f"word{i * 7 % 90 + k} and" for i in range(60))]
        assert np.frombuffer(next(iter(encoder.encode_batch(texts))), "<u4").tolist() == library.encode(texts[0], add_special_tokens=False).ids
    assert max(len(encoder.pieces.young), len(encoder.words.young)) < 300


def test_bpe_over_spark_round_trip(spark):
    rows = [(1, "héllo wörld\n  x", "z"), (2, None, None), (3, "", "q"), (None, "a " * 60000, "r"), (1, "héllo wörld\n  x", "z")]
    table = spark.createDataFrame(rows, DOCS + ", run string")
    coded = bpe_automaton.encode_documents(table, VOCABULARY)
    back = bpe_automaton.decode_documents(coded, VOCABULARY)
    assert rows_of(back.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "decoded"), "doc_id", "text", "decoded") == sorted(
        [(d, t or "", t or "") for d, t, _ in rows], key=repr)
    assert bpe_automaton.decode_documents(bpe_automaton.encode_documents(table.limit(0), VOCABULARY), VOCABULARY).count() == 0


def test_bpe_decode_of_broken_and_unknown_ids():
    encoder = bpe_automaton.Encoder(VOCABULARY)
    broken = np.array([encoder.merges.byte_id[0xC3]], "<u4").tobytes()
    assert encoder.decode(broken) == "�"
    with pytest.raises(KeyError):
        encoder.decode(np.array([10 ** 6], "<u4").tobytes())


# ---- 2: decontamination -----------------------------------------------------
def brute_leaks(docs, items, threshold=0.8):
    import regex
    words = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    grams = lambda w, k: [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]
    out = set()
    for d, t in docs:
        for i, b in items:
            wanted = words(b)
            k, m = min(5, len(wanted)), len(wanted) - min(5, len(wanted)) + 1
            if not wanted:
                continue
            have, item = grams(words(t), k), collections.Counter(grams(wanted, k))
            for s in range(max(1, len(have) - m + 1)):
                part = collections.Counter(have[s:s + m])
                least = sum((part & item).values())
                if least and least / (sum(part.values()) + m - least) >= threshold:
                    out.add((d, i))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    words = [f"tok{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(6, 60))) for i in range(12)] + [(50, "three short words"), (51, None), (52, ""), (53, "!!"), (54, "tok1 tok1 tok1 tok1 tok1 tok1 tok1"), (1, text(20))]
    docs = []
    for i in range(60):
        item = (items[i % 12][1]).split()
        for _ in range(i % 4):
            at = rng.randrange(len(item))
            item[at:at + 1] = rng.choice([[], ["new"], [item[at], "extra"]])
        docs.append((i, text(rng.randint(0, 40)) + "\n" + ", ".join(item).upper() + ". " + text(rng.randint(0, 40))))
    docs += [(100, "Three SHORT   words!"), (101, None), (102, ""), (103, items[3][1]), (103, items[3][1]), (None, items[4][1]), (104, "tok1 " * 40), (105, " ".join(items[5][1].split()[:-1]))]
    got = decontaminate.find_leaks(spark.createDataFrame([(*d, 1, 2) for d in docs], DOCS + ", h int, start int"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute_leaks(docs, items)


def test_decontamination_swapped_halves_and_edited_ends(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"f{rng.randrange(10 ** 9)}" for _ in range(n)]
    items = [(i, " ".join(fresh(50))) for i in range(6)] + [(i, " ".join(fresh(200))) for i in range(6, 10)]
    docs = []
    for i, text in items:
        item = text.split()
        half = len(item) // 2
        docs.append((2 * i, " ".join(fresh(rng.randint(0, 30)) + item[half:] + item[:half] + fresh(rng.randint(0, 30)))))
        middle = rng.randint(half - 5, half + 5)
        edited = item[:1] + fresh(1) + item[2:middle] + fresh(1) + item[middle:-2] + fresh(1) + item[-1:]
        docs.append((2 * i + 1, " ".join(fresh(rng.randint(0, 30)) + edited + fresh(rng.randint(0, 30)))))
    want = brute_leaks(docs, items)
    assert {(2 * i, i) for i, _ in items} <= want
    got = decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_decontamination_empty_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.find_leaks(none, items).count() == 0
    assert decontaminate.find_leaks(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0


def test_fingerprints_within_the_radius_share_a_block(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << bit
        rows.append((a - (1 << 63), b - (1 << 63)))
    table = spark.createDataFrame(rows, "a long, b long")
    near = sum((F.bit_count(decontaminate.block(F.col("a"), k).bitwiseXOR(decontaminate.block(F.col("b"), k))) <= decontaminate.BLOCK_RADIUS).cast("int") for k in range(decontaminate.BLOCKS))
    assert table.where(near == 0).count() == 0


# ---- 9: URL filters ---------------------------------------------------------
def test_url_filter_edge_cases(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/")]
    pages = spark.createDataFrame([(1, "http://A.Example.NET/en/x?q#f", 1), (2, "http://a.net", 1), (3, "http://notexample.net/en/", 1), (4, None, 1), (5, "no scheme", 1),
                                   (6, "https://www.bad.org/p/", 1), (7, "http://bad.org/p?x=1", 1), (8, "http://bad.org/P", 1), (8, "http://bad.org/P", 1), (9, "", 1), (None, "http://x.net/a", 1)],
                                  "page_id long, url string, block int")
    listed = spark.createDataFrame([("http://BAD.org/p",), ("http://bad.org/p",), (None,), ("junk",)], "url string")
    got = rows_of(url_filter.filter_urls(pages, listed, rules), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted([(1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "a.net", "", None, "allow"), (3, "notexample.net", "/en/", "net/", "block"),
                          (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "www.bad.org", "/p/", None, "block"), (7, "bad.org", "/p", None, "block"),
                          (8, "bad.org", "/P", None, "allow"), (8, "bad.org", "/P", None, "allow"), (9, "", "", None, "allow"), (None, "x.net", "/a", "net/", "block")], key=repr)
    assert url_filter.filter_urls(pages.limit(0), listed, rules).count() == 0
    assert url_filter.filter_urls(pages, listed.limit(0), []).where("verdict = 'block'").count() == 0


def test_bloom_blocks_have_no_false_negative_and_few_false_positives(spark):
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), F.col("id")).alias("url"))
    got = url_filter.filter_urls(pages, pages.where("page_id % 4 = 0").select("url"), []).cache()
    assert got.where("page_id % 4 = 0 and not (bloom_hit and listed)").count() == 0
    assert got.where("page_id % 4 <> 0 and listed").count() == 0
    assert got.where("page_id % 4 <> 0 and bloom_hit").count() < 60


# ---- 10: token counts -------------------------------------------------------
def changes(spark, rows):
    full = [(c, d, s, la, t, n, *(old or (None,) * 4)) for c, d, s, la, t, n, old in rows]
    return spark.createDataFrame([(*r, 1) for r in full], token_rollup.CHANGE_SCHEMA + ", sign int")


def test_token_rollup_batches(spark):
    rollup = token_rollup.TokenRollup(spark, shared_path(spark, "rollup-test"))
    assert rollup.totals().count() == 0
    first = changes(spark, [("insert", 1, "a", "en", "v1", 10, None), ("insert", 2, "a", "en", "v1", 5, None), ("insert", 2, "a", "en", "v1", 5, None),
                            ("insert", 3, None, None, "v1", None, None)])
    assert rollup.commit("b1", first) and not rollup.commit("b1", first)
    want = [("a", "en", "v1", 2, 15), (None, None, "v1", 1, 0)]
    assert rows_of(rollup.totals(), "source", "lang", "tokenizer", "n_docs", "n_tokens") == sorted(want, key=repr)
    # a half-written batch: its delta lies there, but the log does not name it
    token_rollup.signed_sums(first).write.parquet(f"{rollup.path}/deltas/b2")
    assert rows_of(rollup.totals(), "source", "lang", "tokenizer", "n_docs", "n_tokens") == sorted(want, key=repr)
    rollup.commit("b2", changes(spark, [("revise", 1, "a", "en", "v2", 12, ("a", "en", "v1", 10)), ("delete", 2, "a", "en", "v1", 5, None)]))
    rollup.compact("c1")
    rollup.compact("c1")
    again = token_rollup.TokenRollup(spark, rollup.path)
    assert not again.commit("b1", first) and again.batches() == ["c1"]
    assert rows_of(again.totals(), "source", "lang", "tokenizer", "n_docs", "n_tokens") == sorted([("a", "en", "v2", 1, 12), (None, None, "v1", 1, 0)], key=repr)


def test_token_rollup_documents_without_id_are_each_their_own(spark):
    rollup = token_rollup.TokenRollup(spark, shared_path(spark, "rollup-null-ids"))
    rollup.commit("b1", changes(spark, [("insert", None, "a", "en", "v1", 5, None)] * 3 + [("insert", 7, "a", "en", "v1", 5, None)] * 2))
    assert rows_of(rollup.totals(), "n_docs", "n_tokens") == [(4, 20)]
    rollup.commit("b2", changes(spark, [("delete", None, "a", "en", "v1", 5, None), ("revise", None, "a", "en", "v1", 6, ("a", "en", "v1", 5))]))
    assert rows_of(rollup.totals(), "n_docs", "n_tokens") == [(3, 16)]


def test_token_rollup_unknown_change_raises(spark):
    with pytest.raises(Exception, match="unknown change"):
        token_rollup.signed_sums(changes(spark, [("upsert", 1, "a", "en", "v1", 1, None)])).collect()


def test_token_count_patterns(spark):
    table = spark.createDataFrame([("a  b,c\n", 1), ("", 2), (None, 3), ("é1 ü!?", 4)], "text string, k int")
    got = table.select("k", token_rollup.token_count("words-1").alias("n1"), token_rollup.token_count("wordpunct-2").alias("n2"))
    assert rows_of(got, "k", "n1", "n2") == [(1, 2, 4), (2, 0, 0), (3, 0, 0), (4, 2, 5)]


# ---- 1: chat formatting -----------------------------------------------------
CALL = "conv_id long, turn long, call_id string, name string, arguments string, uses array<string>"
RESULT = "conv_id long, turn long, call_id string, content string"
SCHEMA = "name string, param string, type string, required boolean, min_size double, max_size double"


def test_chat_linking_order_and_json(spark):
    calls = [(1, 5, "c", "f", '{"b": 1, "a": {"z": null, "y": [1.50, "é\\n"]}}', ["a", "b"]), (1, 1, "a", "f", "{}", []), (1, 3, "b", "f", '{"b":"x"}', ["a", "zz", None]),
             (1, 9, "b", "f", "{}", None), (1, 2, "b2", "g", "[1]", None), (2, 1, "p", "f", "nope", ["q"]), (2, 2, "q", "f", None, ["p"]), (2, 3, "r", None, "{}", ["q"]),
             (2, 4, None, "f", "{}", ["p"]), (3, 1, "s", "f", '{"b":1}', ["s"]), (None, 1, "n", "f", '{"b":2}', None), (4, 1, "k", "f", '{"b":7}', None), (4, 1, "k", "f", '{"b":7}', None)]
    results = [(1, 2, "a", 'say "hi"'), (1, 4, "a", "late"), (1, 6, "c", None), (1, 7, "x", "lost"), (2, 9, None, "none"), (None, 2, "n", "ok"), (4, 2, "k", "done")]
    schemas = [("f", "a", "object", False, None, None), ("f", "b", "integer", True, None, 5.0), ("f", "b", "integer", True, None, 5.0), (None, "c", "string", True, None, None)]
    got = chat_format.format_chat(spark.createDataFrame([(*c, "x", "y") for c in calls], CALL + ", status string, level string"),
                                  spark.createDataFrame(results, RESULT), spark.createDataFrame(schemas, SCHEMA)).collect()
    by = {(r.conv_id, r.part, r.call_id, r.status): r for r in got}
    assert len(got) == 12 + 7
    assert [by[1, 0, x, s].level for x, s in (("a", "linked"), ("b", "unanswered"), ("c", "linked"), ("b2", "unanswered"))] == [0, 1, 2, 0]
    assert by[1, 0, "b", "duplicate"].turn == 9 and by[1, 1, "a", "duplicate"].turn == 4 and by[1, 1, "x", "orphan"].level is None
    assert by[1, 1, "c", "linked"].turn == 5 and by[2, 0, None, "no_id"].level is None and by[2, 1, None, "no_id"].status == "no_id"
    assert {x: by[2, 0, x, "unanswered"].level for x in "pqr"} == dict.fromkeys("pqr") and "cycle" in by[3, 0, "s", "unanswered"].errors
    assert by[1, 0, "c", "linked"].errors == [] and by[1, 0, "c", "linked"].json == (
        '{"arguments":{"a":{"y":[1.5,"é\\n"],"z":null},"b":1},"call_id":"c","name":"f","role":"assistant","valid":true}')
    assert by[1, 0, "a", "linked"].errors == ["b: missing"] and by[1, 0, "b", "unanswered"].errors == ["b: not of type integer", "uses: unknown call"]
    assert by[1, 0, "b2", "unanswered"].errors == ["unknown tool"] and by[2, 0, "p", "unanswered"].errors[0] == "arguments: not an object"
    assert by[4, 0, "k", "linked"].errors == ["b: too large"] and by[4, 0, "k", "linked"].copies == 2 and by[None, 1, "n", "linked"].json.endswith('"ok","role":"tool"}')
    for r in got:
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json


def test_chat_empty(spark):
    none = chat_format.format_chat(spark.createDataFrame([], CALL), spark.createDataFrame([], RESULT), spark.createDataFrame([], SCHEMA))
    assert none.count() == 0


NUMBERS = ["0", "-0", "-0.0", "0e5", "1e2", "100.0", "100", "1.50", "-1.5E0", "0.000001", "1e-7", "0.00000123", "1e20", "1e21", "12e20", "123456789012345678901",
           "12345678901234567890123456789012345678901", "-12345678901234567890123456789012345678901.5", "1E+400", "1e-400", "9007199254740993", "0.1234567890123456789"]


def plain_number(text):
    """The documented form, from Python's decimals."""
    sign, digits, power = decimal.Decimal(text).as_tuple()
    digits = "".join(map(str, digits)).lstrip("0")
    point = len(digits) + power
    digits = digits.rstrip("0")
    if not digits:
        return "0"
    if len(digits) <= point <= 21:
        size = digits + "0" * (point - len(digits))
    elif 0 < point <= 21:
        size = digits[:point] + "." + digits[point:]
    elif -6 < point <= 0:
        size = "0." + "0" * -point + digits
    else:
        size = digits[0] + ("." + digits[1:] if digits[1:] else "") + f"e{point - 1:+d}"
    return "-" * sign + size


def test_chat_numbers_keep_their_digits_and_have_one_text(spark):
    odd = json.dumps({"a": "\x01n5", "b": '"\x01n7', "\x01k": "-1e2 \\"})
    calls = [(1, i, str(i), "f", f'{{"z":[{t}],"b":{t}}}', None) for i, t in enumerate(NUMBERS)] + [(2, 0, "odd", "f", odd, None), (2, 1, "bad", "f", '{"b":01}', None)]
    schemas = [("f", "b", "integer", True, None, None), ("f", "z", "array", False, None, None)]
    got = {r.call_id: r for r in chat_format.format_chat(spark.createDataFrame(calls, CALL), spark.createDataFrame([], RESULT), spark.createDataFrame(schemas, SCHEMA)).collect()}
    for i, t in enumerate(NUMBERS):
        r = got[str(i)]
        assert r.json.startswith(f'{{"arguments":{{"b":{plain_number(t)},"z":[{plain_number(t)}]}},'), (t, r.json)
        whole = decimal.Decimal(t) == 0 or decimal.Decimal(t).normalize(decimal.Context(prec=99)).as_tuple().exponent >= 0
        assert (r.errors == []) == whole, (t, r.errors)
    assert json.loads(got["odd"].json)["arguments"] == json.loads(odd) and got["odd"].errors[0] == "b: not of type integer"
    assert got["bad"].errors == ["arguments: not an object"]


def test_chat_long_texts_and_other_turns(spark):
    long = 'a\\"é-1e2 ' * 200_000
    calls = [(1, 1, "c", "f", json.dumps({"t": long}), None)]
    others = [(1, 0, "system", "Be kind"), (1, 0, "system", "Be kind"), (1, 4, None, None), (None, None, "tool", "x"), (1, 5, "critic", long)]
    done = chat_format.format_chat(spark.createDataFrame(calls, CALL), spark.createDataFrame([], RESULT), spark.createDataFrame([("f", "t", "string", True, None, float(len(long)))], SCHEMA),
                                   spark.createDataFrame(others, "conv_id long, turn long, role string, content string")).collect()
    made = {(r.conv_id, r.turn): r for r in done}
    assert len(done) == 5 and json.loads(made[1, 1].json)["arguments"] == {"t": long} and made[1, 1].errors == []
    assert made[1, 0].copies == 2 and made[1, 0].json == '{"content":"Be kind","role":"system"}' and made[1, 4].json == '{"content":""}'
    assert {(r.level, r.part, r.call_id, r.status) for r in done if r.part == 2} == {(0, 2, None, "message")} and json.loads(made[1, 5].json)["content"] == long


# ---- 4: nearest neighbours --------------------------------------------------
def test_nearest_exact_on_one_block_with_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((150, 6)).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200 + i, x[3].tolist()) for i in range(15)] + [(0, x[0].tolist())]
    odd = [(300, None), (301, [0.0] * 6), (302, [float("nan")] * 6), (303, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (304, [float("inf")] + [1.0] * 5), (305, [1.0, 2.0]), (None, [1.0] * 6)]
    table = spark.createDataFrame([(*r, 1.0) for r in rows + odd], "vec_id long, embedding array<double>, d double")
    got = collections.defaultdict(list)
    for r in sorted(nn_descent.nearest(table, lambda i: i % 10 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    real = dict(rows)
    ids = sorted(real)
    assert sorted(got) == [i for i in ids if i % 10 == 0]
    for q, found in got.items():
        want = sorted((float(np.sqrt(((np.array(real[i]) - np.array(real[q])) ** 2).sum())), i) for i in ids if i != q)[:10]
        assert [v for v, _ in found] == [i for _, i in want]
        assert np.allclose([s for _, s in found], [s for s, _ in want], rtol=0, atol=1e-12)


def test_nn_descent_recall_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 128)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((600, 16)) + 4 * rng.standard_normal(16) for _ in range(2)])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nn_descent.nearest(table, lambda i: i % 40 == 0, beam=60).toPandas()
    hits = 0
    for q in range(0, 1200, 40):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & set(got[got.query_id == q].vec_id))
    assert hits / 300 >= 0.9


def test_nn_descent_with_a_huge_outlier_and_near_copies(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 128)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.standard_normal((500, 16)), 3 + 1e-6 * rng.standard_normal((60, 16)), rng.standard_normal((1, 16))])
    x[-1, 0] = 1e200
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = [*range(0, 500, 25), *range(500, 560, 5)]
    got = nn_descent.nearest(table, lambda i: i.isin(asked), beam=60).toPandas()
    hits = 0
    for q in asked:
        d = ((x[:-1] - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & set(got[got.query_id == q].vec_id))
    assert hits / (10 * len(asked)) >= 0.95


def test_nearest_of_nothing_and_of_one(spark):
    kind = "vec_id long, embedding array<float>"
    assert nn_descent.nearest(spark.createDataFrame([], kind), lambda i: i >= 0).count() == 0
    assert nn_descent.nearest(spark.createDataFrame([(1, [1.0, 2.0])], kind), lambda i: i >= 0).count() == 0
    assert nn_descent.nearest(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind), lambda i: i >= 0).count() == 2


# ---- 7: quality classifier --------------------------------------------------
def test_quality_scores_and_degenerate_fits(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "slowly", "past", "old", "stones"]) for _ in range(40)) + "."
    docs = [(i, good() if i % 3 else " | ".join(["BUY!!", "###", "NOW!!"] * 10), 1, "x") for i in range(240)] + [(500, None, None, "x"), (501, "", 0, "x"), (None, good(), 1, "x"), (1, good(), 5, "x")]
    docs = spark.createDataFrame(docs, DOCS + ", n_chars long, features string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(3, None), (None, 1)], "doc_id long, quality int")
    model = quality_fm.fit(docs, labels, maxIter=40)
    got = quality_fm.scores(docs, model, ["doc_id"]).collect()
    assert len(got) == 244 and all(0 <= r.score <= 1 for r in got)
    wrong = [r for r in got if r.doc_id is not None and r.doc_id < 240 and r.doc_id != 1 and (r.score >= quality_fm.THRESHOLD) != (r.doc_id % 3 > 0)]
    assert len(wrong) <= 2
    one = quality_fm.fit(docs, labels.where("quality = 1"))
    assert one.model is None and one.constant == 1.0 and quality_fm.fit(docs, labels.limit(0)).constant == 0.5
    assert quality_fm.scores(docs.limit(0), model, ["doc_id"]).count() == 0


def test_quality_never_learns_the_held_out_fold(spark):
    import zlib
    ids = spark.range(50).select(F.col("id").alias("doc_id"))
    got = {r.doc_id: r.h for r in ids.select("doc_id", quality_fm.held_out(F.col("doc_id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}
    docs = ids.select("doc_id", F.lit("some text").alias("text"))
    labels = ids.select("doc_id", F.lit(1).alias("quality"))
    assert quality_fm.training_rows(docs, labels).count() == sum(not h for h in got.values())
