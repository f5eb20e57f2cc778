"""Golden pages, and for every operator nulls, empty and very long texts, ties, repeated rows, empty tables and further columns with clashing names."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest

from sedimenta.llm import queries, surrogates
from sedimenta.llm.ball_tree import top_inner_products
from sedimenta.llm.byte_bpe import bpe_round_trip
from sedimenta.llm.decontaminate import contaminated
from sedimenta.llm.html_text import parse, render, render_pages
from sedimenta.llm.language_id import fit_languages, identify_languages, term_counts
from sedimenta.llm.near_dedup import near_duplicates
from sedimenta.llm.repeated_bytes import remove_repeats
from sedimenta.llm.shuffle_shards import shuffle_shards, write_shards
from sedimenta.llm.surrogates import replace_entities
from sedimenta.llm.warc_index import loser_tree, merge_runs, order, positions, records, sorted_runs, write_archives

CLASH = "doc_id long, text string, node string, core string, shard string, key string, spans string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, *"abcde") for i, t in zip(ids or range(len(texts)), texts, strict=True)], CLASH)


PAGES = [
    ("<table><tr><td rowspan=2>aa<td>bb<td>cc<tr><td>dddd<td>e</table>", "aa  bb    cc\n    dddd  e"),
    ("<style>.x{display:none} #k, p.h{visibility:hidden} @media print{b{display:none}} i{display:none}</style><p class='a x'>gone<p id=k>hid<p class=h>hid<p>seen <b>bold</b><i>it</i> <i style='display:inline'>own</i>", "seen bold own"),
    ("<p><img alt='A cat' src=x> and <object data=x>fall back</object> <input type=submit><input type=image alt=Go>", "A cat and fall back Submit Go"),
    ("<table><tr><td>漢字<td>x<tr><td>abcdef<td>y</table>", "漢字    x\nabcdef  y"),
    ("<table><tr><td colspan=2>wide cell here<td>z<tr><td>a<td>b<td>c</table>", "wide cell here  z\na  b            c"),
    ("<ol start=3><li>a<li>b<ul><li>c</ul></ol><pre>  x\n   y</pre><blockquote>q</blockquote>", "3. a\n4. b\n   - c\n\n  x\n   y\n\n  q"),
    ("<p>one<p>two<div>three<br>four</div>five", "one\n\ntwo\n\nthree\nfour\nfive"),
    ("<p hidden>no<p hidden style='display:block'>yes<!-- c --><details><summary>sum</summary>closed</details>", "yes\n\nsum"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>&lt;&amp;&nbsp;x", "t\n  d\nu\n  e\n\n<&\xa0x"),
    ("", ""), ("<", "<"), ("<p", ""), ("a<b", "a"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_golden_pages(page, text):
    assert render(parse(page))[0] == text


def test_pages_edge_cases(spark):
    long = "<div>" * 3000 + "<p>x " * 60_000
    rows = [(1, None, "u"), (None, "<p>a", "u"), (2, "<p>a", "u"), (2, "<p>a", "u"), (3, long, "u"), (4, "", "u")]
    got = render_pages(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 1), (1, 0), (2, 1), (2, 1), (3, 60_000 * 3 - 2), (4, 0)]


def test_surrogate_formats(spark):
    replace = surrogates.Replacer("key")
    say = lambda t: replace(t)[0]
    assert re.fullmatch(r"\+353 \d \d{3} \d{4}", say("+353 1 234 5678")) and say("+353 1 234 5678") != "+353 1 234 5678"
    assert say("+44 20 7946 0958").startswith("+44 ") and say("+1 202 555 0143").startswith("+1 ")
    for iban in ("GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"):
        new = say(iban)
        assert new != iban and new[:2] == iban[:2] and surrogates._mod97(new.replace(" ", "")[4:] + new.replace(" ", "")[:4]) == 1
    assert say("GB00WEST12345698765432")[2:4] == "00"
    for a, net in (("10.1.2.3", "10."), ("192.168.1.7", "192.168."), ("127.0.0.1", "127."), ("172.20.1.1", "172.")):
        assert say(a).startswith(net) and say(a) != a
    assert not re.match(r"(10|127)\.|192\.168\.", say("8.8.8.8"))
    assert say("fe80::1ff:fe23:4567:890a").startswith("fe80:") and say("std::vector and a::b at 10:30") == "std::vector and a::b at 10:30"
    born = say("DOB: 1984-03-12, geboren am 12.03.1984")
    iso, german = re.fullmatch(r"DOB: (\d{4}-\d\d-\d\d), geboren am (\d\d\.\d\d\.\d{4})", born).groups()
    assert ".".join(reversed(iso.split("-"))) == german != "12.03.1984"
    assert say("Ms Maria Kowalska met Kowalska")[-1] == "a"
    seen = [surrogates.surrogate("ipv4", f"10.0.{i}.{j}", b"k") for i in range(40) for j in range(40)]
    assert len(set(seen)) == len(seen) and all(s.startswith("10.") for s in seen)
    texts = [None, "", "x " * 200_000 + "anna@example.org", "call +1 202 555 0143", "call +1 202 555 0143"]
    got = {r.doc_id: r for r in replace_entities(docs(spark, texts), "key").collect()}
    assert got[0].text is None and got[1].text == "" and got[2].n_email == 1 and got[3].text == got[4].text != texts[3]


def test_language_edge_cases(spark):
    table = "doc_id long, text string, lang string, accepted string, tf string"
    none = spark.createDataFrame([], table)
    model = fit_languages(none)
    assert identify_languages(none, model).count() == 0
    rows = [(i, f"the cat and the dog number {i} run here", "en", "x", "y") for i in range(30)] + [(100 + i, f"der hund und die katze laufen {i} nicht", "de", "x", "y") for i in range(30)]
    odd = [(200, None, "en", "x", "y"), (201, "", None, "x", "y"), (202, "12 34", "en", "x", "y"), (None, "the cat", "en", "x", "y"), (203, "the dog and the cat " * 60_000, None, "x", "y"), (1, rows[1][1], "en", "x", "y")]
    df = spark.createDataFrame(rows + odd, table)
    model = fit_languages(df)
    got = identify_languages(df, model).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and not by[i].accepted for i in (200, 201, 202)) and by[203].lang_pred == "en"
    # by brute force: the centroid of highest cosine
    for i, text, lang, *_ in rows:
        v = np.log1p(term_counts([text])[0][0]) * model.idf
        cosine = model.centroids @ (v / np.linalg.norm(v))
        assert by[i].lang_pred == model.langs[model.owner[cosine.argmax()]] == lang and abs(by[i].score - cosine.max()) < 1e-4


def test_top_k_with_repeated_rows_and_clashing_columns(spark):
    rng = random.Random(2)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(6)]
    own = vec()
    rows = [(0, own, 1, "a")] * 10 + [(i, vec(), 2, "b") for i in range(1, 60)] + [(60, [0.5] * 6, 1, "c")] * 3 + [(None, own, 1, "d"), (61, [1.0, 2.0], 1, "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int, tree string")
    ints = [(i, [int((256 * x) // 1) for x in v]) for i, v, *_ in rows if i is not None and len(v) == 6]
    want = sorted(((-sum(a * b for a, b in zip(ints[0][1], v, strict=True)), i) for i, v in ints if i != 0))[:5]
    for shards, growth in ((1, 8), (7, 2), (13, 3)):
        got = sorted((r["rank"], r.vec_id, r.score) for r in top_inner_products(df.where("vec_id = 0").limit(1), df, shards=shards, growth=growth).collect())
        assert got == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]
    assert top_inner_products(df.limit(0), df).count() == 0 and top_inner_products(df, df.limit(0)).count() == 0


def test_order_of_shards_is_the_same_in_every_session(spark, tmp_path):
    texts = [None, "", "x" * 300_000, *(f"text {i % 50}" for i in range(300))]
    ids = [None, None, 7, *(7 if i % 3 == 0 else i for i in range(300))]
    df = docs(spark, texts, ids)
    found = []
    for n, parts in (("3", 2), ("9", 5)):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        done = write_shards(shuffle_shards(df.repartition(parts), shards=4, bucket_bytes=50_000, task_bytes=100_000), f"{tmp_path}/{n}")
        found.append(sorted((r.shard, r.slot, str(r.record), r.grown_shard) for r in done.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and len(found[0]) == len(texts)
    slots = {}
    for shard, slot, *_ in found[0]:
        slots.setdefault(shard, []).append(slot)
    assert all(s == list(range(len(s))) for s in slots.values()) and all(g in (s, 4) for s, _, _, g in found[0])


def test_archives_in_any_time_zone(spark, tmp_path):
    rows = [(0, "http://www.B.org/x?b=2&a=1#f", "é" * 100, 1), (5, None, None, 1), (3, "http://b.org/", "é" * 100, 1), (3, "http://b.org/", "é" * 100, 1), (None, "ftp://[bad", "", 1), (9, "http://a.org/" + "y" * 5000, "z" * 300_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, part int")
    found = []
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        write_archives(pages, f"{tmp_path}/{zone[:3]}")
        sorted_runs(spark, f"{tmp_path}/{zone[:3]}").write.parquet(f"{tmp_path}/runs-{zone[:3]}")
        merge_runs(spark.read.parquet(f"{tmp_path}/runs-{zone[:3]}")).write.parquet(f"{tmp_path}/index-{zone[:3]}")
        found.append([(r.url_key, r.captured_at, r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in positions(spark.read.parquet(f"{tmp_path}/index-{zone[:3]}")).orderBy("position").collect()])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found[0] == found[1] == sorted(found[0], key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))
    by = {r[2]: r for r in found[0]}
    assert by[0][1] == "20240101000000" and by[0][0] == "org,b)/x?a=1&b=2" and by[0][3:] == ("response", None, 200) and by[3][3:5] == ("revisit", 0) and by[5][5] == 0 and len(found[0]) == 6
    assert merge_runs(spark.read.parquet(f"{tmp_path}/runs-UTC").limit(0)).count() == 0


def test_loser_tree():
    rng = random.Random(1)
    row = lambda k, t, p: (k, t, p, 0, "d", "response", None, "a", p or 0)
    for n in (0, 1, 2, 3, 7, 20):
        runs = [sorted((row(rng.choice("abc"), str(rng.randrange(3)), rng.choice([None, 1, 2, 3])) for _ in range(rng.randrange(6))), key=order) for _ in range(n)]
        assert [order(r) for r in loser_tree([iter(r) for r in runs])] == sorted(order(r) for run in runs for r in run)


def test_cut_off_archive():
    import gzip

    whole = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    assert [b for *_, b in records(gzip.compress(whole * 2))] == [b"hello"] * 2
    for bad in (whole[:-6], b"nonsense\r\n" + whole):
        with pytest.raises(ValueError):
            list(records(gzip.compress(bad)))


def test_short_items_and_periodic_changes(spark):
    rng = random.Random(6)
    item = [f"w{i}" for i in range(30)]
    third = [w if i % 3 != 2 else f"x{i}" for i, w in enumerate(item)]
    texts = ["xx one two yy", "one or two", " ".join(third), None, "", "solo " * 100_000, "one two"]
    items = spark.createDataFrame([(1, "one two", 5), (2, " ".join(item), 5), (3, "", 5), (4, None, 5), (None, "one", 5)], "item_id long, text string, doc_id long")
    got = sorted((r.doc_id, r.item_id) for r in contaminated(docs(spark, texts), items).collect())
    assert got == [(0, 1), (2, 2), (6, 1)]
    vocabulary, planted = [f"v{i}" for i in range(300)], []
    wanted = [[rng.choice(vocabulary) for _ in range(40)] for _ in range(20)]
    for k, words in enumerate(wanted):
        changes = [[w if i % 3 != 2 else "q" for i, w in enumerate(words)], [w if rng.random() > 0.25 else rng.choice(vocabulary) for w in words], [w for w in words if rng.random() > 0.2], words[:20], [y for w in words for y in ([w] if rng.random() > 0.15 else [w, "z"])]]
        planted += [(k, " ".join([rng.choice(vocabulary) for _ in range(50)] + c + [rng.choice(vocabulary) for _ in range(50)])) for c in changes]
    found = {(r.doc_id, r.item_id) for r in contaminated(docs(spark, [t for _, t in planted]), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(wanted)], "item_id long, text string")).collect()}
    assert sum((n, k) in found for n, (k, _) in enumerate(planted)) >= 0.9 * len(planted) and len(found) <= 1.02 * len(planted)


def brute(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        cut = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                cut[i : i + length] = True
        out.append((len(d), int(cut.sum()), int((cut[1:] & ~cut[:-1]).sum() + (len(cut) > 0 and cut[0])), hashlib.sha256(bytes(b for b, c in zip(d, cut, strict=True) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("most", [256, 1])
def test_repeats_in_large_groups(spark, most):
    """A passage of over 50 words that many documents share, in copies, with changes near it, and in words of Thue and Morse; both ways of sorting."""
    rng = random.Random(9)
    line = lambda n: "".join(rng.choice("abcdefé ") for _ in range(n))
    passage, tail = " ".join(line(7).replace(" ", "x") for _ in range(60)), line(500)
    morse = "a"
    while len(morse) < 2048:
        morse += morse.translate(str.maketrans("ab", "ba"))
    texts = [line(rng.randrange(300)) + passage + line(rng.randrange(300)) for _ in range(40)] + [tail] * 30 + [tail[:k] + "#" + tail[k + 1 :] for k in range(0, 500, 25)]
    texts += [morse[:1024], morse[1024:], morse[512:1536], None, "", "z" * 1200, line(60_000) + passage, passage[:399]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in remove_repeats(docs(spark, texts), most=most).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_near_duplicates_rows(spark):
    base = " ".join(f"w{i}" for i in range(100))
    texts, ids = [base, base, base + " x", None, "", "one", base, "long " * 100_000], [5, 5, 5, 6, None, None, None, 9]
    got = [(r.doc_id, r.component_id, r.kept, r.stays) for r in near_duplicates(docs(spark, texts, ids)).collect()]
    assert sorted(got, key=str)[:5] != [] and sum(r[3] for r in got if r[1] == 5) in (1, 2) and all(r[1] == 5 for r in got if r[0] == 5)
    assert [r[2:] for r in got if r[0] == 6] == [(True, True)] and len(got) == 8


def test_bpe_edge_cases(spark):
    path = public_tokenizers.path(queries.VOCABULARY)
    texts = [None, "", "x" * 100_000, "same", "same", "퟿\0é"]
    got = {r.doc_id: r for r in bpe_round_trip(docs(spark, texts, [0, 1, 2, 3, 3, None]), path, public_tokenizers.PATTERN).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert got[0].n_tokens == 0 and got[0].ids_sha256 == got[1].ids_sha256 == got[1].decoded_sha256 == none
    assert got[2].decoded_sha256 == hashlib.sha256(b"x" * 100_000).hexdigest() and got[None].n_bytes == 6


def test_sql_of_searches_and_groups(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name in ("op2_superminhash_dedup", "op8_ball_tree_topk"):
        found = con.execute(queries.SQL[name])
        names = [c[0] for c in found.description]
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert set(df.columns) == set(names) and sorted(map(tuple, df.select(names).collect())) == sorted(found.fetchall())
