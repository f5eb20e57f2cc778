"""The operators of this subpackage against brute force, exact round trips and planted cases, with nulls, empty texts, repeated rows and clashing columns."""

import base64
import hashlib
import math
import random
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sedimenta.llm import near_dedup, queries, surrogates
from sedimenta.llm.ball_tree import top_inner_products
from sedimenta.llm.byte_bpe import bpe_round_trip
from sedimenta.llm.decontaminate import contaminated
from sedimenta.llm.html_text import render_pages
from sedimenta.llm.language_id import fit_languages, held_out
from sedimenta.llm.near_dedup import near_duplicates
from sedimenta.llm.repeated_bytes import remove_repeats
from sedimenta.llm.shuffle_shards import shuffle_shards
from sedimenta.llm.surrogates import replace_entities

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, node string, component string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOC)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("most", [1024, 8])
def test_near_duplicates(spark, most):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    texts = [None, "", "  ", "one two", "ONE two", "one two three"]
    for _ in range(40):  # a group whose members are often just below or above the threshold
        t = list(base)
        for _ in range(rng.randrange(1, 6)):
            t[rng.randrange(80)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += texts[6:9]
    got = {r.doc_id: r for r in near_duplicates(docs(spark, texts), most=most).collect()}
    want = brute_components(texts)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(shingles(t)) for t in texts]
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_empty_tables(spark):
    none = docs(spark, ["x"]).where("false")
    assert near_duplicates(none).count() == 0 and remove_repeats(none).count() == 0 and shuffle_shards(none).count() == 0
    assert bpe_round_trip(none, public_tokenizers.path(queries.VOCABULARY), public_tokenizers.PATTERN).count() == 0 and replace_entities(none, "k").count() == 0
    assert contaminated(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert render_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeats(spark):
    rng = random.Random(3)
    line = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, near = line(600), "ab" * 300
    texts = [None, "", line(900), "p" + shared + line(50), line(30) + shared, near, "z" * 401, "q" * 400, shared, line(399)]
    got = {r.doc_id: r for r in remove_repeats(docs(spark, texts)).collect()}
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - 399):
            seen[d[i : i + 400]] = seen.get(d[i : i + 400], 0) + 1
    for k, d in enumerate(data):
        cut = bytearray(len(d))
        for i in range(len(d) - 399):
            if seen[d[i : i + 400]] > 1:
                cut[i : i + 400] = b"\1" * 400
        kept = bytes(b for b, c in zip(d, cut, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(cut) if c and (i == 0 or not cut[i - 1]))
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, bytes(got[k].kept)) == (len(d), sum(cut), spans, kept)


def test_bpe_is_exact(spark):
    path = public_tokenizers.path(queries.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "a" * 3000, "é\U0001f600\0 \n\n x", " <|endoftext|>", "aaaa bbbb " * 50] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for r in bpe_round_trip(docs(spark, texts), path, public_tokenizers.PATTERN).collect():
        ids = exact.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)] + [(300, None), (301, [float("nan")] * 6), (302, [None] * 6), (303, [0.5] * 6), (304, [0.5] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_inner_products(df.where("vec_id % 50 = 0"), df).collect()}
    ints = {i: [int((256 * x) // 1) for x in v] for i, v in rows if v and all(x is not None and x == x for x in v)}
    want = {}
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:5]
        want |= {(q, n): (i, -s) for n, (s, i) in enumerate(best, 1)}
    assert got == want


def test_shards(spark):
    df = queries.op5_external_shuffle(spark, SF)
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_decontamination_finds_copies_and_edits(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    first = items.where("length(text) > 150").orderBy("item_id").first()
    words = first.text.split()
    edited = [w if i % 9 else "changed" for i, w in enumerate(words)]
    texts = ["prefix words " + first.text + " tail", "start " + " ".join(edited) + " end", "nothing of this is in a test item at all", None, ""]
    assert {r.doc_id for r in contaminated(docs(spark, texts), items).collect()} >= {0, 1}
    assert not {r.doc_id for r in contaminated(docs(spark, texts[2:]), items).collect()}


def test_language_on_held_out_rows(spark):
    """Over all held-out rows with a letter, accepted or not; and over those of them whose text is no copy of a training row's."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op6_centroid_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id")
    asked = got.where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    fresh = asked.join(got.where("NOT held_out").select("text"), "text", "left_anti")
    right = F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))
    measured = [df.agg(right, F.count("*"), F.avg(F.col("accepted").cast("int"))).first() for df in (asked, fresh)]
    print("right, rows, accepted:", measured)
    assert all(m[0] > 0.95 and m[1] > 100 for m in measured)
    assert got.where("NOT score BETWEEN 0 AND 1").count() == 0


def test_rendering(spark):
    html = "<p>One<p>Two<ul><li>a<li>b</ul><script>no()</script><div style='display:none'>hidden</div><table><tr><td>x<td>y</table>&amp;"
    text = " ".join(str(v) for v in render_pages(spark.createDataFrame([(1, "u", html), (2, "u", None), (3, "u", "")], "page_id long, url string, html string")).where("page_id = 1").first())
    assert all(t in text for t in ("One", "Two", "- a", "- b", "x", "y", "&")) and "hidden" not in text and "no()" not in text


def test_surrogates(spark):
    texts = ["Write to anna.smith@example.org or call +1 202 555 0143.", "anna.smith@example.org again", None, ""]
    got = {r.doc_id: " ".join(map(str, r)) for r in replace_entities(docs(spark, texts), "key").collect()}
    assert "anna.smith@example.org" not in got[0] and "555 0143" not in got[0]
    mail = re.compile(r"[\w.]+@[\w.]+\w")
    assert mail.search(got[0])[0] == mail.search(got[1])[0]


def test_archives_agree_with_sql(spark):
    import duckdb

    rows = queries.op9_warc_index_merge(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    found = con.execute(queries.SQL["op9_warc_index_merge"])
    names = [c[0] for c in found.description]
    assert {tuple(r) for r in rows.select(names).collect()} == set(found.fetchall())


def brute_score(item, text):
    """Best local score of two word sequences, cell by cell."""
    best, above = 0, [0] * (len(text) + 1)
    for w in item:
        row = [0]
        for k, t in enumerate(text):
            row.append(max(0, above[k] + (2 if t == w else -1), above[k + 1] - 1, row[k] - 1))
        best, above = max(best, max(row)), row
    return best


def test_decontamination_is_the_same_however_often_an_item_occurs(spark):
    """Truncated and edited copies, and one with a long insertion, of an item that 120 documents copy, against alignment by brute force."""
    rng = random.Random(8)
    item = [f"k{i}" for i in range(40)]
    noise = lambda n: [f"z{rng.randrange(10**6)}" for _ in range(n)]
    edited = lambda step: [w if i % step else f"e{rng.randrange(10**6)}" for i, w in enumerate(item)]
    texts = [noise(20) + item + noise(5) for _ in range(120)]
    texts += [noise(30) + item[20:], item[20:40] + noise(40), item[:20] + noise(3), item[10:30], item[:17], item[3:20] + noise(9), item[:8] + item[33:]]
    texts += [edited(step) + noise(7) for step in (3, 4, 5, 6, 9)] + [noise(4) + item[:20] + noise(36) + item[20:], item[:20] + noise(60) + item[20:]]
    texts += [edited(5)[20:] + item[1:4], noise(50)] + [noise(9) + item[20:] for _ in range(20)]
    got = {r.doc_id: (r.score, r.share) for r in contaminated(docs(spark, [" ".join(t) for t in texts]), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    want = {i: brute_score(item, t) for i, t in enumerate(texts)}
    seeds = lambda t: {tuple(t[k : k + 3]) for k in range(len(t) - 2)} | {(*t[k : k + 2], "", t[k + 3]) for k in range(len(t) - 3)}
    seeded = {i for i, t in enumerate(texts) if seeds(item) & seeds(t)}
    assert got == {i: (s, s / 80) for i, s in want.items() if s >= 0.45 * 80 and i in seeded}
    assert {120, 121, 122, 123, 132} <= set(got)


FOREIGN = [
    "Wczoraj wieczorem poszliśmy do lasu, żeby zbierać grzyby, ale zaczął padać deszcz i wróciliśmy do domu z pustymi koszami. Babcia ugotowała nam gorącą zupę i opowiadała o dawnych czasach, kiedy wszyscy mieszkali jeszcze na wsi.",
    "Eilen illalla menimme metsään keräämään sieniä, mutta alkoi sataa ja palasimme kotiin tyhjin korein. Isoäiti keitti meille kuumaa keittoa ja kertoi vanhoista ajoista, jolloin kaikki asuivat vielä maalla.",
    "Dün akşam mantar toplamak için ormana gittik ama yağmur başladı ve eve boş sepetlerle döndük. Büyükannem bize sıcak çorba pişirdi ve herkesin hâlâ köyde yaşadığı eski günleri anlattı.",
    "Tegnap este elmentünk az erdőbe gombát szedni, de eleredt az eső, és üres kosárral tértünk haza. Nagymama forró levest főzött nekünk, és a régi időkről mesélt, amikor még mindenki falun lakott.",
    "Вчера вечером мы пошли в лес за грибами, но начался дождь.",
    "xqzv wkjf qpwz mnbv zxcv lkjh gfds qwrt plmk ijnb uhbv ygcx tfzq vvkq jjwx",
    "a a a a a a a a",
]


def test_language_rejects_foreign_and_junk_texts_and_keeps_its_own(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_languages(rows.where(~held_out(F.col("doc_id"))))
    texts = [t * n for t in FOREIGN for n in (1, 20)]
    assert not any(model.predict(texts)[2])
    own = [r.text for r in rows.where(held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike("[A-Za-z]")).select("text").collect()]
    kept = model.predict(own)[2]
    print("false rejections:", kept.count(False), "of", len(own))
    assert len(own) > 300 and kept.count(False) <= 0.02 * len(own)


def test_surrogates_follow_a_person_and_all_scripts(spark):
    texts = [
        "Becker came.\nDr Anna Becker wrote. Becker added; ANNA's and BECKER's notes, Becker-Lang too. Beckers stay.",
        "Clara von Berg met Prof. Dr. Hugo Lindt-Maier and Robert Stone. Stone said that Berg and Lindt left. The stone fell.",
        "هاتف\n+٩٦٦ ٥٥ ١٢٣ ٤٥٦٧\n٤١١١ ١١١١ ١١١١ ١١١١\nend", "कार्ड ४१११ १११১ ११११ ११११ and ۴۱۱۱ ۱۱۱۱ ۱۱۱۱ ۱۱۱۱",
        "Mary had a lamb. Will Carmen?",
    ]
    got = {r.doc_id: r for r in replace_entities(docs(spark, texts), "key").collect()}
    a = got[0].text
    first, last = re.search(r"Dr (\w+) (\w+) wrote", a).groups()
    assert not re.search(r"Anna|ANNA|Becker(?!s)|BECKER", a) and "Beckers stay." in a
    assert a == f"{last} came.\nDr {first} {last} wrote. {last} added; {first.upper()}'s and {last.upper()}'s notes, {last}-Lang too. Beckers stay."
    b = got[1].text
    assert not re.search("Clara|Berg|Hugo|Lindt|Maier|Robert|Stone", b) and "The stone fell." in b and " von " in b and "Prof. Dr. " in b
    x = re.fullmatch(r"(\w+) von (\w+) met Prof. Dr. (\w+) (\w+)-(\w+) and (\w+) (\w+)\. (\w+) said that (\w+) and (\w+) left\. The stone fell\.", b)
    assert x and (x[8], x[9], x[10]) == (x[7], x[2], x[4])
    assert got[2].n_phone == 1 and got[2].n_card == 1 and re.fullmatch("هاتف\n\\+٩٦[٠-٩ ]+\n[٠-٩ ]+\nend", got[2].text)
    assert "٤١١١ ١١١١" not in got[2].text and "٥٥ ١٢٣" not in got[2].text
    assert got[3].n_card == 2 and "४१११" not in got[3].text and "۴۱۱۱" not in got[3].text
    assert got[4].text == texts[4]


def test_surrogates_do_not_collide(spark):
    hexes = "aB1c" * 8, "ab1c" * 8
    texts = ["10.0.0.1 and 10.0.0.01", "10.0.0.01", "10.0.0.1", f"'{hexes[0]}' '{hexes[1]}'", "1.2.3.4", "Dr Maça, Dr MAÇA, Dr Maßa, Dr MAẞA, xK@k.org, xK@k.org"]
    got = {r.doc_id: r.text for r in replace_entities(docs(spark, texts), "key").collect()}
    assert got[0] == f"{got[2]} and {got[1]}" and got[1] == got[2] and got[4] != got[2]
    assert got[3].lower()[1:33] == got[3].lower()[36:68] and hexes[1] not in got[3].lower()
    assert "AKIA" + "QWERTYUIOPASDFGH" not in replace_entities(docs(spark, ["key AKIA" + "QWERTYUIOPASDFGH"]), "key").first().text
    assert len(set(got[5].split(", "))) == 6
    every = [f"Dr {c}{d}a" for c in "ÀÇẞŽàçß" for d in "çßñÇẞÑ"]
    assert len({surrogates.surrogate("person", v, b"key") for v in every}) == len(every)
    table = spark.createDataFrame([("ssn", "111-11-1111", "222-22-2222"), ("ssn", "333-33-3333", "222-22-2222"), ("ssn", "444-44-4444", "555-55-5555")], "kind string, value string, surrogate string")
    settled = surrogates.settle(table, "key")
    assert set(settled) == {("ssn", "333-33-3333")} and not set(settled.values()) & {"222-22-2222", "333-33-3333", "555-55-5555"}
    assert surrogates.Replacer("key", settled)("id 333-33-3333.")[0] == f"id {settled['ssn', '333-33-3333']}."


def test_rendering_of_formulas_drawings_and_buttons(spark):
    html = (
        "<p>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><mspace/><mn>42</mn><mphantom><mi>ghost</mi></mphantom></mrow><annotation encoding='t'>anno</annotation></semantics></math> hold."
        "<svg><title/><title>svgtitle</title><desc>svgdesc</desc><defs><text>svgdefs</text></defs>loose<rect width='1'/><g><text x='1'>Label <tspan>one</tspan></text><a href='#'><text>Link</text></a></g>"
        "<text display='none'>gone</text><g visibility='hidden'><text>unseen</text></g><path d='M0'/><text><textPath href='#p'>Curve</textPath></text><foreignObject><p>Inner</p></foreignObject></svg>after"
        "<form><input type=submit value='Send it'><input type='BUTTON' value='Go'><input type=reset value='Clear'><input type=hidden value='token'><input type=submit value='nope' style='display:none'><input value='typed'></form>"
        "<svg><rect><p>Broken out"
    )
    text = render_pages(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).first().text
    assert "Let x=42 hold." in text and "Label one Link Curve" in text and "Inner" in text and "after" in text and "Send it Go Clear typed" in text and "Broken out" in text
    assert not re.search("ghost|anno|svgtitle|svgdesc|svgdefs|loose|gone|unseen|token|nope", text)


def test_signature_estimate_misses_far_less_than_banding():
    agree = lambda k: math.comb(near_dedup.PLACES, k) * 0.75**k * 0.25 ** (near_dedup.PLACES - k)
    assert sum(map(agree, range(near_dedup.estimate_floor(75)))) < 0.01 * (1 - 0.75**near_dedup.ROWS) ** near_dedup.BANDS
