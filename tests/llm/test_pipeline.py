"""The pipeline's stages on a small table, against plain Python, with nulls, repeated ids and rows, and a further column."""

import hashlib
import random

import public_tokenizers
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from sedimenta.llm import queries  # noqa: E402
from sedimenta.llm.surrogates import Replacer  # noqa: E402


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def linked(a, b):
    both = len(a & b)
    return 100 * both >= 75 * (len(a) + len(b) - both)


def test_stages(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en' AND length(text) BETWEEN 600 AND 3000").orderBy("doc_id").limit(40).collect()
    prose = [r.text for r in base]
    words = prose[0].split()
    near = " ".join(w if k % 60 else "changed" for k, w in enumerate(words))
    rng = random.Random(4)
    item = " ".join(rng.choice(prose[3].split()) for _ in range(40))
    rows = [(k, t) for k, t in enumerate(prose)]
    rows += [(900, prose[0]), (901, near), (None, prose[1]), (902, prose[5] + " " + item + " " + prose[6][:200]), (3, prose[7] + " Write to anna.smith@example.org."), (903, None), (904, ""), (905, "1234 5678"), (906, prose[2]), (2, prose[2]), (907, "Вчера вечером мы пошли в лес за грибами, но начался дождь."), (None, item)]
    docs = spark.createDataFrame([(i, t, "en" if (i or 999) < 900 else None, "s", len(t or ""), "more") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, item_id string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, after = docs, {}
    for name, stage in pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{name}")
        after[name] = [(r.doc_id, getattr(r, "text", None)) for r in now.collect()]
        assert name == "byte_bpe" or now.columns == before.columns
    of_language = after["language_id"]
    assert not {903, 904, 905, 907} & {i for i, _ in of_language} and len(of_language) >= len(rows) - 6
    # one row of each group, that of the least id, null last
    left, order = [], sorted(set(of_language), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [shingles(t) for _, t in order]
    label = list(range(len(order)))
    for i in range(len(order)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    left = [r for k, r in enumerate(order) if label[k] == k]
    assert sorted(after["near_dedup"], key=str) == sorted(left, key=str)
    assert not {900, 901, 906} & {i for i, _ in left} and (None, prose[1]) not in left
    assert (3, prose[7] + " Write to anna.smith@example.org.") in left and (7, prose[7]) not in left  # linked by the text, whatever other rows have the id
    clean = [r for r in left if item not in r[1]]
    assert len(clean) < len(left) and sorted(after["decontamination"], key=str) == sorted(clean, key=str)
    replace = Replacer(queries.SURROGATE_KEY)
    assert sorted(after["pii_surrogates"], key=str) == sorted(((i, replace(t)[0]) for i, t in clean), key=str)
    hashes = sorted(hashlib.sha256(t.encode()).hexdigest() for _, t in after["pii_surrogates"])
    assert sorted(r.decoded_sha256 for r in now.collect()) == hashes
    assert pipeline.run(spark, str(tmp_path)).count() == len(clean)
    assert public_tokenizers.path(queries.VOCABULARY)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
