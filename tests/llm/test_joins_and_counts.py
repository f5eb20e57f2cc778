"""Importance resampling, collocations and the Jaccard join against brute force, and faults that once were there."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from sedimenta.llm.ball_tree import top_inner_products
from sedimenta.llm.collocations import collocations
from sedimenta.llm.decontaminate import contaminated
from sedimenta.llm.html_text import parse, render
from sedimenta.llm.importance import drawn, importance_sample
from sedimenta.llm.jaccard_join import band_ends, bitmap, folded, jaccard_classes, jaccard_links, most_apart, tile_keys
from sedimenta.llm.shuffle_shards import shuffle_shards
from sedimenta.llm.surrogates import ENTITY

CLASH = "doc_id long, lang string, text string, node string, weight string, score string, tile string, digest string, n string, phrase string"


def docs(spark, texts, ids=None, langs=None):
    n = len(texts)
    return spark.createDataFrame([(i, g, t, *"abcdefg") for i, g, t in zip(ids or range(n), langs or ["en"] * n, texts, strict=True)], CLASH)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_sample(rows, target, percent=25):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    s, t = (Counter(b for text in texts for b in features(text)[1]) for texts in ([text for _, text in rows], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out, able = [], []
    for at, (i, text) in enumerate(rows):
        n_words, f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        able += [at] * (n_words >= 20)
    able.sort(key=lambda at: (-out[at][3], rows[at][0] is None, rows[at][0] or 0, hashlib.sha256((rows[at][1] or "").encode()).hexdigest()))
    for place, at in enumerate(able[: percent * len(able) // 100]):
        out[at][4] = place + 1
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_importance_sample(spark, hot):
    rng = random.Random(8)
    words = ["Alpha", "beta", "été", "x1", "don't", "naïve", "漢字", "_", "q" * 90, "zz"]
    text = lambda: rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(60)))
    rows = [(i, text()) for i in range(150)] + [(None, text()), (None, None), (900, ""), (901, None), (902, "---"), (3, text()), (904, "w" * 300_000), (905, "a b " * 20_000)]
    rows += [(1000 + i, "beta zz " * 15) for i in range(80 if hot else 3)] + [(1000, "beta zz " * 15)]
    target = ["zz zz beta alpha", None, "", "zz été"]
    table = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    tests = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    found = importance_sample(table, tests)
    got = found.select("doc_id", "n_features", "weight", "score", "rank").collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, brute_sample(rows, target)), key=key)
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1))
    assert set(drawn(table, found).columns) == set(table.columns) and drawn(table, found).count() >= len(ranks)
    none = importance_sample(table.where("false"), tests)
    assert none.count() == 0 and importance_sample(table, tests.where("false")).where("rank IS NOT NULL").count() == len(ranks)


def brute_phrases(rows, least, most):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    able = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in able.items():
        if any(lang == g and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in able.items()):
            continue
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:most]
        ranked += [(lang, k + 1, *r[1:]) for k, r in enumerate(mine)]
    return sorted(ranked)


@pytest.mark.parametrize("bits, most", [(26, 2000), (6, 7)])
def test_collocations(spark, bits, most, monkeypatch):
    from sedimenta.llm import collocations as module

    if bits != 26:  # a filter that lets nearly all pass changes nothing
        known = module.phrase_counts
        monkeypatch.setattr(module, "phrase_counts", lambda *a, **k: known(*a, **k, bits=bits))
    rng = random.Random(2)
    words = ["New", "york", "city", "hall", "été", "a\x00b", "z" * 70, "o'clock", "of", "the"]
    line = lambda: " ".join(rng.choice([rng.choice(words), "New York city", "city\thall  of the", "x%d" % rng.randrange(300)]) for _ in range(rng.randrange(30)))
    rows = [(rng.choice(["en", "fr", None, "und", ""]), rng.choice([". ", "\n", ",", " ! "]).join(line() for _ in range(4))) for _ in range(120)]
    rows += [("en", None), ("de", ""), ("de", " \t "), ("en", "new york " * 20_000), ("en", "the end")] + [("fr", "tic tac toe")] * 40
    got = collocations(docs(spark, [t for _, t in rows], langs=[g for g, _ in rows]), least=10, most=most)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases(rows, 10, most)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 15
    assert collocations(docs(spark, ["x"]).where("false")).count() == 0 and collocations(docs(spark, ["one two", None])).count() == 0


def triples(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))) if w else frozenset()


def linked(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 90 * (len(a) + len(b) - both)


@pytest.mark.parametrize("most", [1024, 4])
def test_jaccard_join(spark, most):
    rng = random.Random(11)
    texts = [None, "", " \n", "one two", "One two", "one two three", "ONE two three", "one"]
    for size in (8, 19, 40, 120, 400):
        base = [f"w{rng.randrange(200)}" for _ in range(size)]
        texts.append(" ".join(base))
        for _ in range(14):  # most of them just at the threshold
            t = list(base)
            for _ in range(rng.randrange(1, 2 + size // 60)):
                t[rng.choice([0, size - 1, rng.randrange(size)])] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(t[: size - rng.randrange(1 + size // 15)] + [f"u{rng.randrange(9)}"] * rng.randrange(2)))
    texts += texts[8:12] + ["long " * 50_000, " ".join(f"k{i}" for i in range(30_000)), " ".join(f"k{i}" for i in range(29_000))]
    sets = [triples(t) for t in texts]
    label = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if linked(sets[i], sets[j])]
    for i, j in pairs:
        old, new = max(label[i], label[j]), min(label[i], label[j])
        label = [new if x == old else x for x in label]
    got = {r.doc_id: r for r in jaccard_classes(docs(spark, texts), most=most).collect()}
    assert [got[i].component_id for i in range(len(texts))] == label and len(pairs) > 60
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    links, rows = jaccard_links(docs(spark, texts), most=most)
    ids = {}
    for r in rows.collect():
        ids.setdefault(r.node and bytes(r.node), []).append(r.doc_id)
    told = {(max(x, y), min(x, y)) for r in links.collect() for x in ids[bytes(r.a)] for y in ids[bytes(r.b)]}
    assert told == {(i, j) for i, j in pairs if sets[i] != sets[j]}


def test_jaccard_rows(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (5, "x y z w"), (7, "X y z w"), (None, "q r s"), (None, None), (8, None)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_classes(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect())
    assert got == sorted([(0, 2, 5), (0, 2, 5), (5, 2, 5), (5, 2, 5), (5, 2, 5), (7, 2, 5), (0, 1, 0), (0, 0, 0), (8, 0, 8)])
    assert jaccard_classes(docs(spark, ["x"]).where("false")).count() == 0


def test_tiles_meet_and_bitmaps_bound():
    rng, ends = np.random.default_rng(1), band_ends(90)
    for _ in range(300):
        n = int(rng.integers(1, 600))
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        out = int(rng.integers(0, len(a) // 9 + 1))
        b = np.unique(np.concatenate((a[rng.permutation(len(a))[out:]], rng.integers(0, 2**64, int(rng.integers(0, max(1, len(a) // 9 - out + 1))), np.uint64))))
        both = len(np.intersect1d(a, b))
        if both < len(a) or both < len(b):
            with np.errstate(over="ignore"):
                meet = np.intersect1d(tile_keys(a, ends, 90), tile_keys(b, ends, 90))
            assert len(meet) or 100 * both < 90 * (len(a) + len(b) - both)
        x, y = bitmap(a), bitmap(b)
        size = min(len(x), len(y))
        assert int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= len(a) + len(b) - 2 * both
    assert int(most_apart(np.array([5]), 90)[0]) == 0 and len(tile_keys(np.arange(3, dtype=np.uint64), ends, 90)) == 0


def test_large_components(spark):
    rows = [(0, [2.0**22, 2.0**-8]), (1, [2.0**22, 2.0**-8]), (2, [2.0**22, 0.0]), (3, [1.0, 1.0]), (4, [2.0**22, 2.0**-7])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in top_inner_products(table.where("vec_id = 0"), table).orderBy("rank").collect()]
    assert got == [(4, 2**60 + 2), (1, 2**60 + 1), (2, 2**60), (3, 256 * 2**30 + 256)]
    many = [(i, [2.0**22 + i % 7, float(i % 11) / 256]) for i in range(600)]
    table = spark.createDataFrame(many, "vec_id long, embedding array<double>")
    whole = [[math.floor(256 * x) for x in v] for _, v in many]
    want = sorted(((-sum(a * b for a, b in zip(whole[0], v, strict=True)), i) for i, v in enumerate(whole) if i))[:5]
    got = [(-r["score"], r["vec_id"]) for r in top_inner_products(table.where("vec_id = 0"), table, shards=9).orderBy("rank").collect()]
    assert got == want
    with pytest.raises(Exception, match="too large"):
        huge = spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")
        top_inner_products(huge, huge).collect()


def test_time_follows_length():
    def seconds(f, x):
        began = time.perf_counter()
        f(x)
        return time.perf_counter() - began

    assert seconds(lambda t: list(ENTITY.finditer(t)), "1 " + "a-" * 100_000) < 10
    assert seconds(parse, "<b>" * 30_000 + "<p>x" * 30_000) < 10 and seconds(parse, "<svg><g>" * 30_000 + "<p>x" * 30_000) < 10


def test_repeated_words_of_items(spark):
    """A text position counts once for an item, however often the item repeats its words."""
    item = "same " * 300
    table = spark.createDataFrame([(1, "same " * 4000), (2, "other words " * 50), (3, "before " + item + "after")], "doc_id long, text string")
    got = {r.doc_id: r.share for r in contaminated(table, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert got == {1: 1.0, 3: 1.0}


def test_controls_of_pages():
    page = "<p>A<input value=v><input placeholder=ph><input type=hidden value=h><select><option>one<option selected>two</select><select multiple><option>p<option>q</select><textarea placeholder=t></textarea> <progress>no</progress><ruby>x<rp>(</rp><rt>y</rt></ruby>"
    text = render(parse(page))[0]
    assert [w for w in ("v", "ph", "two", "p", "q", "t") if w not in text.split()] == [] and not re.search(r"\b(h|one|no)\b|\(", text)


def test_maps_inside_columns(spark):
    rows = spark.sql("SELECT id AS doc_id, 'x' AS text, array(map('k', id)) AS many, named_struct('m', map(1, id)) AS one, map('z', 1) AS node FROM range(50)")
    got = shuffle_shards(rows, shards=4).collect()
    assert sorted(r.record.doc_id for r in got) == list(range(50)) and all(r.record.many[0]["k"] == r.record.doc_id == r.record.one.m[1] for r in got)
