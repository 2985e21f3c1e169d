"""Each operator on small rows, against brute force, an exact round trip or held-out accuracy."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from quaere.llm import bpe, decontaminate, fingerprints, jaccard, licenses, lines, pii, quality, suffixes, toxicity

ODD = [None, "", " \n", "x", "one two", "one two three four five", "é 😀 \x00 end", "word " * 4000, "a" * 3000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, row long, bucket long, gone int"


def frame(spark, texts, first=0):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(first + k, t, "en", "s", len(t or ""), 1, 0.5, 3, 4, 5) for k, t in enumerate(texts)], SCHEMA).repartition(3)


def words(rng, n, names=300):
    return [f"w{rng.randrange(names)}" for _ in range(n)]


def test_bpe(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    theirs = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aab é\n'sth<|endoftext|>9中") for _ in range(rng.randrange(200))) for _ in range(200)] + ["ab" * 20000]
    df = frame(spark, texts)
    got = {r.doc_id: r for r in bpe.digests(df, path, public_tokenizers.PATTERN).collect()}
    for k, text in enumerate(texts):
        ids = theirs.encode_ordinary(text or "")
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == want
    encoded = bpe.encode(df, path, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.data).decode() for r in bpe.decode(encoded, path).collect()} == {k: t or "" for k, t in enumerate(texts)}


def test_rank_queue_takes_the_least_rank_first():
    # "ab" has a greater rank than "abc": merging a pair may bring up a lesser rank
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"abc": 3, b"ab": 4, b"ca": 5, b"abcabc": 6}
    assert bpe.merge([b"abcabcab", b"aab"], ranks) == [(6, 4), (0, 4)]


def brute_links(texts):
    sets = [frozenset(jaccard.shingle_set(t or "").tolist()) for t in texts]
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    root, links = list(range(len(texts))), Counter()

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in where[x] if j > k).items():
            if both / (len(s) + len(sets[j]) - both) >= 0.8 - 1e-12:
                links[k] += 1
                links[j] += 1
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    return {k: (find(k), links[k]) for k in range(len(texts))}


@pytest.mark.parametrize("limit", [jaccard.LIMIT, 8])
def test_jaccard(spark, limit):
    rng = random.Random(2)
    base = words(rng, 120)
    texts = list(ODD)
    for _ in range(60):
        t = list(base)
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = "zz"
        texts.append(" ".join(t))
    texts += [" ".join(words(rng, rng.randrange(5, 200))) for _ in range(10)] + texts[12:15]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(frame(spark, texts), limit=limit).collect()}
    assert got == brute_links(texts)
    assert {r.doc_id for r in jaccard.keep_one(frame(spark, texts)).collect()} == {k for k, (c, _) in got.items() if k == c}


def test_jaccard_of_rows_without_keys(spark):
    rng = random.Random(22)
    base = words(rng, 100, 10**6)
    near = " ".join([*base[:50], "zz", *base[51:]])
    rows = [(None, " ".join(base)), (None, near), (None, "alone " * 3), (4, " ".join(base)), (4, near), (9, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(df).collect())
    assert got == Counter([(None, 4, 3)] * 2 + [(4, 4, 3)] * 2 + [(None, None, 0)] * 2 + [(9, 9, 0)])
    only = df.where("doc_id IS NULL")
    assert Counter((r.class_id, r.n_links) for r in jaccard.join(only).collect()) == Counter({(None, 1): 2, (None, 0): 2})
    assert Counter(r.doc_id for r in jaccard.keep_one(df).collect()) == Counter({None: 4, 4: 2, 9: 1})
    assert jaccard.join(df.where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_jaccard_recall(spark):
    rows = sorted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    want = brute_links([r.text for r in rows])
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    ends = sum(n for _, n in want.values())
    recall = sum(min(got[r.doc_id][1], want[k][1]) for k, r in enumerate(rows)) / ends
    print(f"measured recall of link ends on sf0.01: {recall:.4f} of {ends}")
    assert recall >= 0.99 and all(got[r.doc_id][1] <= want[k][1] for k, r in enumerate(rows))
    assert {r.doc_id: got[r.doc_id][0] for r in rows} == {r.doc_id: rows[want[k][0]].doc_id for k, r in enumerate(rows)}


def dropped_by_signature(shared, union, pairs=2000):
    rng = np.random.default_rng(13)
    sets = [rng.integers(0, 1 << 64, union, np.uint64) for _ in range(pairs)]
    signs = [(jaccard.signature(s) & 255, jaccard.signature(s[:shared]) & 255) for s in sets]
    return sum(int((a == b).sum()) < jaccard.LEAST_EQUAL for a, b in signs)


def test_short_texts_pass_the_signature():
    assert [dropped_by_signature(4, 5), dropped_by_signature(8, 10), dropped_by_signature(12, 15)] == [0, 0, 0]


def test_quality(spark):
    rng = random.Random(3)
    good = [" ".join(words(rng, rng.randrange(30, 200))) + "." for _ in range(300)]
    bad = [" ".join(w.upper() + "!!" for w in words(rng, rng.randrange(30, 200))) for _ in range(100)]
    texts = ODD + good + bad
    labels = spark.createDataFrame([(k, int(k < len(ODD) + 300)) for k in range(len(ODD), len(texts))] + [(99999, 1), (len(ODD), None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(frame(spark, texts), labels).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got.values())
    held = [k for k in range(len(ODD), len(texts)) if got[k].held_out]
    assert np.mean([got[k].predicted == (k < len(ODD) + 300) for k in held]) > 0.98
    assert got[0].score == got[1].score
    kept = quality.keep_good(frame(spark, texts), labels)
    assert kept.columns == frame(spark, texts).columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.predicted}
    assert {r.score for r in quality.classify(frame(spark, texts), labels.where("false")).collect()} == {0.5}


def test_pairs_are_learnt():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs and np.mean((model.scores(x[3000:]) >= 0.5) == y[3000:]) > 0.95


def test_toxicity(spark):
    rng = random.Random(4)
    plain = [" ".join(words(rng, 80)) for _ in range(300)]
    toxic = [" ".join(w if rng.random() > 0.05 else "grobl" + rng.choice("aeiou") for w in words(rng, 80)) + " groblu" for _ in range(120)]
    texts = ODD + plain + toxic
    labels = spark.createDataFrame([(k, int(k >= len(ODD) + 300)) for k in range(len(ODD), len(texts))], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(frame(spark, texts), labels).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got.values())
    held = [k for k in range(len(ODD), len(texts)) if got[k].held_out]
    assert np.mean([got[k].predicted == (k >= len(ODD) + 300) for k in held]) > 0.98
    assert {r.predicted for r in toxicity.classify(frame(spark, texts), labels.where("false")).collect()} == {0}


def test_toxicity_counts_do_not_depend_on_partitions(spark):
    texts = [" ".join(words(random.Random(k), 30)) for k in range(150)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, toxic int")
    one, many = (toxicity.counts(frame(spark, texts).repartition(n), labels, lambda key: F.lit(True)) for n in (1, 70))
    assert all(np.array_equal(one[k], many[k]) for k in one)


def test_toxicity_counts_are_exact(spark):
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)) for _ in range(150)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, toxic int")
    held = toxicity.counts(frame(spark, texts), labels, lambda key: F.lit(True))
    want = Counter((w[:k], w[k]) for t in texts for w in t.split(" ") for w in [w + " "] for k in range(len(w)))
    for t in texts:
        want[t.split(" ")[-1], " "] -= 1  # nothing follows a text's last word
    want = +want
    assert len(held["gram"]) == len(want) and sorted(held["a"].tolist()) == sorted(want.values())
    assert len(np.unique(held["context"])) == len({u for u, _ in want})


def brute_gaps(texts, kinds):
    """What each word says by Kneser-Ney models in dictionaries; kinds are 0, 1 or None."""
    items = lambda t: re.findall(r"[a-z]+ ?", t)

    def grams(item):
        for k, c in enumerate(item):
            padded = "^" * 9 + item[:k]
            yield ("^" + item[:k] if k < toxicity.LONG else item[k - toxicity.LONG + 1 : k]), c, padded[-3:], padded[-4]

    count = [Counter(), Counter(), Counter()]  # of each class, of all
    before = defaultdict(set)
    for t, kind in zip(texts, kinds, strict=True):
        for item in items(t):
            for u, c, v, x in grams(item):
                before[v, c].add(x)
                for k in [2] if kind is None else [2, kind]:
                    count[k][u, c] += 1
    total = Counter()
    for (v, _), of in before.items():
        total[v] += len(of)
    size, after = [Counter() for _ in range(3)], [Counter() for _ in range(3)]
    for k in range(3):
        for (u, _), n in count[k].items():
            size[k][u] += n
            after[k][u] += 1

    def backed(k, u, c, p, more):
        n, m = count[k][u, c], size[k][u]
        gained = max(n - toxicity.DISCOUNT, 0)
        left = min(toxicity.DISCOUNT * max(after[k][u], 1), m - gained)
        return (gained + (left + more) * p) / (m + more) if m + more else p

    def gap(item):
        out = 0.0
        for u, c, v, _ in grams(item):
            p = backed(2, u, c, (len(before[v, c]) + 0.1) / (total[v] + 6.4), 0.0)
            out += np.log(backed(1, u, c, p, toxicity.SHARED) / backed(0, u, c, p, toxicity.SHARED))
        return out

    return [[gap(i) for i in items(t)] for t in texts]


@pytest.mark.parametrize("few", [10**6, 3])
def test_toxicity_is_kneser_ney(spark, few):
    rng = random.Random(15)
    spelled = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 14)))
    some = [spelled("abc") for _ in range(60)]
    bad = [spelled("abd") for _ in range(6)]
    texts = [" ".join(rng.choice(some + bad * (k % 3 == 0)) for _ in range(40)) for k in range(120)]
    kinds = [int(k % 3 == 0) if k < 100 else None for k in range(120)]
    labels = spark.createDataFrame([(k, y) for k, y in enumerate(kinds) if y is not None], "doc_id long, toxic int")
    df = frame(spark, [None, *texts, "", texts[3]], first=-1).unionAll(frame(spark, texts[:1]).where("doc_id = 0"))
    model = toxicity.train(df, labels, few_grams=few, few_shorts=few)
    got = defaultdict(list)
    for r in toxicity.score(df, model).collect():
        got[r.doc_id].append(r)
    want = brute_gaps([*texts, texts[3], texts[0]], [*kinds, None, kinds[0]])
    for k in range(120):
        for r in got[k]:
            bulk = [min(max(x, -toxicity.BULK), toxicity.BULK) for x in want[k]]
            assert r.n_words == 40 and abs(r.bulk - np.mean(bulk)) < 1e-5 and abs(r.bulk + r.beyond - np.mean(want[k])) < 1e-5
    assert len(got[0]) == 2 and got[-1][0].score == got[120][0].score and got[-1][0].n_words == 0 and got[3][0].score == got[121][0].score


def test_toxicity_reads_words_to_their_ends(spark):
    rng = random.Random(12)
    texts = ["abcdefghijab" + (rng.choice("klm") if k % 2 else "xyzzy") + " " + " ".join(words(rng, 10)) for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(frame(spark, texts), labels).collect()}
    assert np.mean([got[k].beyond + got[k].bulk > 0 for k in range(0, 200, 2)]) > 0.9
    a, b = (toxicity.Grams.of([t]) for t in ("abcdefghijkl", "abcdefghijxl"))
    assert len(a.gram) == 12 and (a.gram != b.gram).sum() == 2


def test_licenses(spark):
    mit = dict(licenses.TEMPLATES)["MIT-text"]
    edited = mit.replace("merge", "fuse").replace("hereby", "here")
    texts = ODD + ["before " * 37 + mit, edited + " after" * 50, " ".join(mit.split()[:40]), "Released under the MIT License.", "under MIT", mit + " " + mit]
    got = defaultdict(dict)
    for r in licenses.scan(frame(spark, texts)).collect():
        got[r.doc_id][r.license] = r.containment
    n = len(ODD)
    assert set(got) == {n, n + 1, n + 3, n + 5} and got[n]["MIT-text"] == 1.0 and 0.8 <= got[n + 1]["MIT-text"] < 1 and got[n + 3] == {"MIT": 1.0}
    with pytest.raises(ValueError):
        licenses.scan(frame(spark, texts), [("x", "too short")])


def test_edited_short_licenses(spark):
    rng = random.Random(14)
    notices = [words(rng, 29, 10**6) for _ in range(100)]  # 25 shingles each, of which one changed word leaves 20
    texts = [" ".join(words(rng, 3) + n[:12] + ["edited"] + n[13:] + words(rng, 9)) for n in notices]
    got = licenses.scan(frame(spark, texts), [(f"n{k}", " ".join(n)) for k, n in enumerate(notices)]).collect()
    assert {(r.doc_id, r.license, r.containment) for r in got} == {(k, f"n{k}", 0.8) for k in range(100)}


def test_licenses_of_all_lengths(spark):
    rng = random.Random(16)
    find = regex.compile(r"[\p{L}\p{N}]+").findall
    cut = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    notices = [words(rng, n + 4, 10**6) for n in range(1, 61) for _ in range(3)]
    texts = []
    for n in notices:
        for edits in range(4):
            t = list(n)
            for _ in range(edits):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(2)] = words(rng, rng.randrange(2), 10**6)
                if rng.random() < 0.2:
                    t = t[at:] + t[:at]  # turned round
            texts.append(" ".join(words(rng, 7, 10**6) + t + words(rng, 9, 10**6)))
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan(frame(spark, texts), [(str(k), " ".join(n)) for k, n in enumerate(notices)]).collect()}
    want = {}
    for k, t in enumerate(texts):
        share = len(cut(find(t)) & cut(notices[k // 4])) / len(cut(notices[k // 4]))
        if share >= 0.8:
            want[k, str(k // 4)] = share
    assert got == want and len(want) > 250 and sum(v < 1 for v in want.values()) > 30
    collide = [1 - (1 - j * j) ** licenses.BANDS for j in (0.8, 1.0)]
    assert collide[0] > 0.98 and collide[1] == 1


def test_fingerprints(spark):
    rng = random.Random(5)
    texts = ODD + [" ".join(words(rng, rng.randrange(1, 400))) for _ in range(60)]
    got = {r.doc_id: r for r in fingerprints.compare_edited(frame(spark, texts)).collect()}
    ids = sorted(got, reverse=True)
    assert len(ids) == len(texts)
    find = regex.compile(r"[\p{L}\p{N}]+").findall

    def shingles(t):
        w = find(t.lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    errors = []
    for k, i in enumerate(ids):
        own, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        third = len(own) // 3
        edited = own[: len(own) - third] + after[:third]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(own), shingles(edited)
        errors.append(got[i].near_edited - (len(a & b) / len(a | b) if a | b else 1.0))
        if own == edited:
            assert got[i].fingerprint == got[i].edited_fingerprint and got[i].near_edited == 1.0
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
    assert fingerprints.compare_edited(frame(spark, texts).where("false")).count() == 0
    keys = spark.createDataFrame([(k * k,) for k in range(3000)], "k long")
    assert {r.k: r.next for r in fingerprints.following(keys, "k", rows=100).collect()} == {k * k: (k - 1) ** 2 if k else 2999**2 for k in range(3000)}


def brute_bins(hashes):
    """One permutation and optimal densification, step by step."""
    shift = 64 - (fingerprints.BINS.bit_length() - 1)
    full = {}
    for h in hashes:
        b = (h >> shift) + fingerprints.BINS // 2  # signed hashes
        if h != ((b - fingerprints.BINS // 2 + 1) << shift) - 1:
            full[b] = min(h, full.get(b, h))
    out = []
    for b in range(fingerprints.BINS):
        take = next((t for t in [b, *fingerprints._tries[b], *fingerprints._orders[b]] if t in full), None)
        out.append(full[take])
    return out if full else []


def test_fingerprint_values(spark):
    from quaere.llm import shingles as sh

    rng = random.Random(19)
    texts = ODD + [" ".join(words(rng, n)) for n in (1, 5, 6, 9, 20, 60, 300, 2000)]
    df = frame(spark, texts)
    hashes = {r.doc_id: r.h for r in df.select("doc_id", sh.shingles(sh.words(F.col("text"))).alias("h")).collect()}
    for r in fingerprints.fingerprints(df).collect():
        want = "".join(f"{v & 255:02x}" for v in brute_bins(hashes[r.doc_id])) if hashes[r.doc_id] else ""
        assert r.fingerprint == want


def test_fingerprints_of_any_keys(spark):
    rng = random.Random(20)
    keys = [0, 2**60, -(2**62), 2**62, 2**63 - 1, -(2**63), None, None, 7, 7, *range(-40, 40)]
    rows = sorted(((k is not None, k or 0, " ".join(words(rng, 12))) for k in keys), reverse=True)
    df = spark.createDataFrame([(k if told else None, t, 1) for told, k, t in rows], "doc_id long, text string, range int").repartition(3)
    got = Counter((r.doc_id, r.edited_sha256) for r in fingerprints.compare_edited(df).collect())
    want = Counter()
    for (told, k, own), (_, _, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        third = len(own) // 3
        want[k if told else None, hashlib.sha256((own[: len(own) - third] + after[:third]).encode()).hexdigest()] += 1
    assert got == want


def brute_tiles(doc, item, least):
    used_doc, used_item, out = [x < 0 for x in doc], [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and not used_item[i + n] and not used_doc[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        used_item[i : i + n] = used_doc[j : j + n] = [True] * n
        out.append((j, i, n))


def test_tiles():
    rng = random.Random(6)
    for _ in range(400):
        v = rng.choice([2, 3, 9])
        item, doc = [rng.randrange(v) for _ in range(rng.randrange(24))], [rng.randrange(-1, v) for _ in range(rng.randrange(40))]
        assert decontaminate.tiles(doc, item, 3) == brute_tiles(doc, item, 3)


@pytest.mark.parametrize("part", [decontaminate.PART_WORDS, 1])
def test_decontaminate(spark, part):
    rng = random.Random(7)
    items = [words(rng, 40, 5000) for _ in range(5)]
    turned = items[1][20:] + words(rng, 30) + items[1][:20]
    texts = ODD + [" ".join(words(rng, 50) + items[0] + words(rng, 50)), " ".join(turned), " ".join(items[2][:8] + words(rng, 90)), " ".join(w.upper() + "," for w in items[3])]
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(8, None), (9, "one two")], "item_id long, text string")
    n = len(ODD)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(frame(spark, texts), bench, part_words=part).collect()}
    assert set(got) == {(n, 0), (n + 1, 1), (n + 3, 3)} and len(got[n + 1, 1].tiles) == 2 and got[n, 0].coverage == 1.0
    kept = decontaminate.remove(frame(spark, texts), bench, part_words=part)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {n, n + 1, n + 3} and kept.columns == frame(spark, texts).columns


@pytest.mark.parametrize("hot", [suffixes.HOT, 20, 3])
def test_suffixes(spark, hot):
    rng = random.Random(8)
    some = ["alpha", "δelta", "😀x", "e", "For"]
    text = lambda n: " ".join(rng.choice(some) for _ in range(n))
    shared = [text(60) for _ in range(3)]
    texts = ODD + ["x" * 199, "x" * 201, "For " * 300] + [text(rng.randrange(40)) + rng.choice(shared) + text(rng.randrange(40)) for _ in range(30)]
    texts += texts[15:19]
    want = suffixes.brute([(t or "").encode() for t in texts])
    got = {r.doc_id: (r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.removed(frame(spark, texts), hot=hot).collect()}
    assert got == dict(enumerate(want))


@pytest.mark.parametrize("few", [suffixes.FEW, 0])
def test_suffixes_of_equal_rows(spark, few):
    rng = random.Random(21)
    long, other = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (4700, 900))
    rows = [(5, long)] * 1000 + [(None, other)] * 20 + [(None, None), (7, "s" * 199), (7, "s" * 199), (8, long[300:900] + other[:250]), (9, "".join(rng.choice("xyz") for _ in range(400)))]
    want = sorted((r[0] is None, r[0] or 0, *w) for r, w in zip(rows, suffixes.brute([(t or "").encode() for _, t in rows]), strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.removed(df, hot=20, few=few).collect())
    assert got == want
    assert suffixes.removed(df.where("false")).count() == 0


def brute_spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, pattern in patterns.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(spark):
    rng = random.Random(9)
    bits = ["a", "b.c", "@", "x.com", "1", "255", ".", "+", "4111 1111 1111 1111", " ", "-", "(555) 123-4567", "_", "é", "😀", "1.2.3.4", "+49 30 1234567", "a@b.de", "me [at] x [dot] com", "300"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(24))) for _ in range(400)] + ["1 " * 3000, "9" * 9000, "a" * 20000 + "@", "a@b.c_d@e.f 1.2.3.4.5.6.7.8"]
    got = {r.doc_id: r for r in pii.digests(frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        want = brute_spans(t or "")
        assert got[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[k].spans.split(","))
        assert [got[k][f"n_{kind}"] for kind in pii.KINDS] == [want.count(kind + ":") for kind in pii.KINDS]
    assert pii.digests(frame(spark, texts).where("false")).count() == 0
    hidden = pii.masked(frame(spark, ["mail a@b.de or 1.2.3.4 now", None]).where("doc_id = 0")).first().text
    assert hidden == "mail <email> or <ip> now"


def test_pii_added(spark):
    rng = random.Random(17)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    def luhn(d):
        return sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0
    good, bad, texts = set(), set(), []
    for k in range(400):
        name = "".join(rng.choice("abcdef") for _ in range(5))
        wrong = next(d for d in iter(lambda: "4" + digits(15), None) if not luhn(d))
        start, span, true = [
            ("call my mobile ", f"({digits(3)}) {digits(3)}-{digits(4)}", True), ("contact me by email: ", f"{name} [at] {name}.com", True), ("mail to ", f"{name} [at] {name} [dot] org", True),
            ("plain words and then ", f"{name}@{name}.org", None), ("ring +", f"49 30 {digits(7)}", None), ("card number ", wrong, False), ("visa card ", wrong, False),
        ][k % 7]
        texts.append(start + span + " and more words")
        if true is not None:
            (good if true else bad).add((k, len(start), len(start) + len(span)))
    added = {(r.doc_id, s.at, s.until) for r in pii.detect(frame(spark, texts)).collect() for s in r.added}
    print(f"added spans: precision {len(added & good) / len(added):.3f}, recall {len(added & good) / len(good):.3f}")
    assert len(added & good) >= 0.9 * len(added) and len(added & good) >= 0.9 * len(good) and not added & bad


def test_pii_estimates():
    # three labelers that are right at known rates, one that says nothing
    rng = np.random.default_rng(18)
    true = rng.random(20000) < 0.3
    votes = np.stack([np.where(rng.random(20000) < r, np.where(true, 1, -1), np.where(true, -1, 1)) for r in (0.95, 0.85, 0.75)] + [np.zeros(20000, int)], axis=1)
    rows = [(0, False, v, n) for v, n in Counter(map(tuple, votes.tolist())).items()]
    model = pii.fit(rows)
    assert abs(model.share[0] - 0.3) < 0.05 and all(abs(model.rates[0, 1, j, 2] - r) < 0.05 for j, r in enumerate((0.95, 0.85, 0.75)))
    said = {v: model.probability(0, v) >= 0.5 for _, _, v, _ in rows}
    assert np.mean([said[tuple(v)] == t for v, t in zip(votes.tolist(), true, strict=True)]) > 0.93


def test_lines(spark):
    rng = random.Random(10)
    line = lambda: " ".join(words(rng, 6))
    block = [line() for _ in range(30)]
    texts = ODD + ["\n".join([line() for _ in range(rng.randrange(6))] + block + [line() for _ in range(rng.randrange(6))]) for _ in range(8)] + ["\n\n\n\n\n"] * 3
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    rows = [(k, t) for k, t in enumerate(texts) if "\x00" not in (t or "")]
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: r[1:] for r in con.execute(lines.ORACLE_SQL).fetchall()}
    df = frame(spark, texts).where(F.col("doc_id").isin([k for k, _ in rows]))
    got = {r.doc_id: tuple(r)[1:] for r in lines.dedup(df).collect()}
    assert got == want and sum(r[2] for r in got.values()) > 150
    out = lines.remove(df)
    assert out.columns[:10] == df.columns and all(r.n_chars == len(r.text or "") or r.text is None for r in out.collect())
