"""The stored index against BM25 in plain Python, with phrases, diacritics, underscores, stems and scopes, and what a search reads."""

import math
import random
import re

import pytest

from sedimenta.functions.stems import porter
from sedimenta.operators import inverted

SCHEMA = "chunk_id string, document string, symbols array<string>, project string"


def words(text, stem):
    plain = re.findall(r"[a-z0-9é漢]+", (text or "").lower().replace("é", "e"))
    return [porter(w) for w in plain] if stem else plain


def brute(rows, query, k, stem, project=None):
    phrases = {tuple(words(w, stem)) for w in re.split(r"[^\w]+", query.lower()) if len(w) >= 2}
    phrases.discard(())
    texts = {i: (words(d, stem), words(" ".join(x for x in s or [] if x is not None), stem)) for i, d, s, _ in rows}
    length = {i: sum(map(len, t)) for i, t in texts.items()}
    average, scores = sum(length.values()) / len(rows), {}
    for p in phrases:
        tf = {i: sum(w[j : j + len(p)] == list(p) for w in t for j in range(len(w))) for i, t in texts.items()}
        df = sum(n > 0 for n in tf.values())
        for i, n in tf.items():
            if n:
                scores[i] = scores.get(i, 0) + max(math.log((len(rows) - df + 0.5) / (df + 0.5)), 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length[i] / average))
    where = {r[0]: r[3] for r in rows}
    return [(i, s) for i, s in sorted(((i, round(s, 6)) for i, s in scores.items()), key=lambda r: (-r[1], r[0])) if project in (None, where[i])][:k]


@pytest.mark.parametrize("stem, block_chunks, first", [(False, 4, 1), (True, 8, 2), (False, 4096, 8)])
def test_search(spark, tmp_path, stem, block_chunks, first):
    rng = random.Random(7)
    vocabulary = ["foo", "bar", "foo_bar", "Été", "ete", "hopping", "hops", "run", "the", "the", "the", "x1", "漢"]
    rows = [(f"c{i:03}", rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 9, 40, 120]))), rng.choice([None, ["bar"], ["foo", None, "bar"]]), rng.choice("pq")) for i in range(160)]
    rows += [("n1", None, None, "p"), ("n2", "", ["foo_bar"], "q"), ("rare", "needle in the hay", None, "q"), ("twin", "needle in the hay", None, "q")]
    index = inverted.build_index(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/index", symbols="symbols", keep=["project"], stem=stem, buckets=8, block_chunks=block_chunks)
    for query in ("foo_bar", "foo bar", "été HOP", "needle the", "the", "foo_bar_foo hops", "zzz", "x", " !", "zzz_foo the", "the_the"):
        for project in (None, "q"):
            got = inverted.search_index(index, query, 7, None if project is None else inverted.F.col("project") == project, first).collect()
            want = brute(rows, query, 7, stem, project)
            assert [(r.key, pytest.approx(r.bm25, abs=2e-6)) for r in got] == want, query
    assert len(brute(rows, "foo_bar", 500, stem)) < len(brute(rows, "foo bar", 500, stem))


def test_what_is_read(spark, tmp_path):
    """Folders of other terms aren't opened, and blocks below the k-th score aren't scored."""
    rows = [(f"c{i:04}", ("needle " if i % 50 == 0 else "") + "hay " * (1 + i % 97), None, "p") for i in range(2000)]
    index = inverted.build_index(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/index", buckets=16, block_chunks=64)
    found = index.of_terms("postings", ["needle"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (=|IN)", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)
    found.collect()
    read = {r.f for r in found.select(inverted.F.input_file_name().alias("f")).distinct().collect()}
    assert len({f.split("bucket=")[1].split("/")[0] for f in read}) == 1
    blocks = index.of_terms("blocks", ["hay"])
    best = sorted((r.best for r in blocks.collect()), reverse=True)
    assert len(best) > 20 and best[0] > 1.05 * best[-1]
    assert inverted.search_index(index, "needle", 3).count() == 3
    none = inverted.build_index(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none")
    assert inverted.search_index(none, "needle", 3).count() == 0


def test_a_row_for_each_term_and_block(spark, tmp_path):
    """Lists hold a block's chunks by place, so that keys stand once in the index, and diacritics of any text fall away."""
    rows = [(f"c{i:04}", "Été x̣́ " + "hay " * (i % 5), None, "p") for i in range(400)]
    index = inverted.build_index(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"{tmp_path}/index", buckets=4, block_chunks=64)
    posted = index.of_terms("postings", ["hay"]).collect()
    assert len(posted) == len({r.block for r in posted}) < 10 and sum(len(r.ats) for r in posted) == 320 and "key" not in posted[0]
    docs = {(r.block, r.at): r.len for r in index.table("docs").collect()}
    assert len(docs) == 400 and all(docs[r.block, at] == n for r in posted for at, n in zip(r.ats, r.lens))
    assert sum(len(r.ats) for r in index.of_terms("postings", ["ete", "x"]).collect()) == 800
