"""Operators against brute force, and nulls, empty and long texts, ties, repeats, empty tables and
clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import (
    context_tree,
    exact_dedup,
    language_id,
    mixing,
    phrase_index,
    quality,
    queries,
    simhash,
    storage,
    url_filter,
    warc,
    wrappers,
)
from tests.llm import brute

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "Alpha beta gamma delta", "en", "a", 1),
    (2, "ALPHA beta gamma delta", "en", "b", 1),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, "É Über  x", "de", None, 5),
    (6, "word " * 30000, "en", "a", 150000),
    (7, "one", "fr", "b", 3),
    (7, "one", "fr", "b", 3),
    (None, "keyless text of four", "en", "a", 2),
    (8, "alpha BETA gamma delta", "en", "c", 1),
    (9, "é über  x", "de", None, 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def clashing(odd):
    names = ["size", "position", "copy", "key", "kept", "fp", "score", "segment", "features", "block", "__x"]
    return odd.withColumns({name: F.lit("own") for name in names})


def rows_of(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


# --- exact dedup


def test_exact_groups_of_odd_texts(odd, none):
    found = exact_dedup.group_copies(odd, hash_all=True)
    by_key = {}
    for row in found.collect():
        by_key.setdefault(row["doc_id"], row)
    assert [by_key[k]["keep_id"] for k in (1, 2, 8)] == [8, 8, 8]
    assert by_key[8]["kept"] and not by_key[1]["kept"] and by_key[1]["group_size"] == 3
    assert by_key[3]["keep_id"] == 4 and by_key[3]["group_size"] == 2
    assert by_key[5]["keep_id"] == 5 and by_key[9]["keep_id"] == 9  # only A-Z are lower-cased
    assert by_key[7]["group_size"] == 2 and found.filter("doc_id = 7 and kept").count() == 2
    assert by_key[6]["text_sha256"] == hashlib.sha256(("word " * 30000).encode()).hexdigest()
    assert found.count() == len(ODD)
    assert exact_dedup.group_copies(none).count() == 0


def test_exact_drop_keeps_columns_and_one_of_each(clashing, none):
    kept = exact_dedup.drop_copies(clashing)
    assert kept.columns == clashing.columns
    assert rows_of(kept, "doc_id") == sorted([(k,) for k in (8, 4, 5, 6, 7, None, 9)], key=repr)
    assert exact_dedup.drop_copies(none).count() == 0


def test_exact_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", 8)
    docs = storage.table(spark, SF, "documents")
    small = rows_of(exact_dedup.group_copies(docs), "doc_id", "keep_id", "group_size", "kept")
    texts = {}
    for key, text in docs.select("doc_id", "text").collect():
        texts.setdefault(brute.lower(text), []).append(key)
    assert small == sorted(
        [(k, max(g), len(g), k == max(g)) for g in texts.values() for k in g], key=repr
    )


# --- simhash


def test_golay_keys_meet_within_two_bits():
    random.seed(3)
    words = np.array([random.getrandbits(23) for _ in range(300)], np.int64)
    keys = [set(k[k >= 0].tolist()) for k in simhash.golay_keys(words)]
    assert {len(k) for k in keys} <= {1, 6}
    for word, own in zip(words.tolist(), keys):
        for flips in ([1 << 5], [1 << 2, 1 << 19]):
            other = simhash.golay_keys(np.array([word ^ sum(flips)], np.int64))[0]
            assert own & set(other[other >= 0].tolist())


def test_near_duplicates_equal_brute_force(spark):
    docs = storage.table(spark, SF, "documents").select("doc_id", "text")
    wanted = brute.near_components([tuple(r) for r in docs.collect()])
    found = queries.QUERIES["op2_simhash"](spark, SF).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == wanted
    texts = dict(map(tuple, docs.collect()))
    assert all(r["fingerprint"] == f"{brute.simhash(texts[r['doc_id']]):016x}" for r in found)


@pytest.mark.parametrize("hot", [1, 64])
def test_links_of_close_fingerprints(spark, monkeypatch, hot):
    """A chain, a dense ball and far fingerprints, under rare and under hot keys."""
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    random.seed(5)
    prints = {random.getrandbits(64) for _ in range(150)}
    center = random.getrandbits(64)
    prints |= {center ^ sum(1 << b for b in random.sample(range(64), 2)) for _ in range(80)}
    link = random.getrandbits(64)
    for _ in range(12):
        link ^= sum(1 << b for b in random.sample(range(64), 3))
        prints.add(link)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(frame)).collect()}
    mask = (1 << 64) - 1
    wanted = brute.components(sorted(signed), lambda a, b: ((a ^ b) & mask).bit_count() <= 3)
    assert {n: found.get(n, n) for n in signed} == wanted


def test_near_duplicates_of_odd_rows(odd, clashing, none):
    found = simhash.near_duplicates(odd)
    by_key = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == len(ODD)
    assert by_key[3]["fp"] == 0 and by_key[4]["component_id"] == 3
    assert by_key[2]["component_id"] == 1 and by_key[8]["component_id"] == 1
    kept = simhash.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns
    assert rows_of(kept, "doc_id") == sorted([(k,) for k in (1, 3, 5, 6, 7, None, 9)], key=repr)
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.drop_near_duplicates(none).count() == 0


# --- phrase index


def test_contamination_of_odd_rows(spark, odd, none):
    items = [(1, "beta gamma"), (2, ""), (3, None), (4, "word " * 20), (1, "delta"), (None, "one"), (5, "absent words")]
    found = phrase_index.contamination(odd, spark.createDataFrame(items, "item_id long, text string"))
    named = [("" if k is None else k, t) for k, t in items]
    for row in found.collect():
        text = next(r[1] for r in ODD if r[0] == row["doc_id"])
        n_words, n_hit, names = brute.contamination(text[:3000] if row["doc_id"] == 6 else text, named)
        if row["doc_id"] == 6:
            n_words, n_hit = 30000, 30000
        assert (row["n_words"], row["n_hit"], row["items"]) == (n_words, n_hit, names)
        assert row["contaminated"] == (n_hit > 0 and 20 * n_hit >= n_words)
    assert found.count() == len(ODD)
    items = spark.createDataFrame([], "item_id long, text string")
    assert phrase_index.contamination(odd, items).filter("contaminated").count() == 0
    assert phrase_index.contamination(none, items).count() == 0


def test_index_in_small_segments(spark):
    """Segments of a few kilobytes give what one segment gives."""
    docs = storage.table(spark, SF, "documents").limit(60)
    items = [tuple(r) for r in storage.table(spark, SF, "benchmark").collect()]
    index = phrase_index.build_index(docs, segment_bytes=4000)
    words = phrase_index.item_words(storage.table(spark, SF, "benchmark"))
    found = phrase_index.documents_hit(index, phrase_index.phrase_matches(index, words)).collect()
    texts = dict(map(tuple, docs.select("doc_id", "text").collect()))
    assert len(found) == 60
    for row in found:
        assert (row["n_words"], row["n_hit"], row["items"]) == brute.contamination(texts[row["doc_id"]], items)


def test_proximity_matches(spark):
    texts = ["a x x b x x x x a b", "b a", "a a a", "x b x x a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    index = phrase_index.build_index(docs)
    items = spark.createDataFrame([(1, "a b"), (2, "a q")], "item_id int, text string")
    words = phrase_index.item_words(items)
    found = phrase_index.documents_hit(index, phrase_index.proximity_matches(index, words, 3))
    assert rows_of(found, "doc_id", "n_hit") == [(0, 2), (1, 2), (2, 0), (3, 0)]
    wide = phrase_index.documents_hit(index, phrase_index.proximity_matches(index, words, 4))
    assert rows_of(wide, "doc_id", "n_hit") == [(0, 6), (1, 2), (2, 0), (3, 4)]


# --- URLs


def test_urls(spark):
    urls = [
        ("http://www.Example.ORG/es/x?y#z", "www.example.org", "/es/x", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://a.org/", "a.org", "/", "org/", "allow"),
        ("https://a.org", "a.org", "", None, "allow"),
        ("https://xorg/", "xorg", "/", None, "allow"),
        ("http://free-bets.example.net/", "free-bets.example.net", "/", None, "block"),
        ("http://cheap-pills.net/", "cheap-pills.net", "/", None, "block"),
        ("http://pillsbury.net/", "pillsbury.net", "/", None, "allow"),
        ("http://a.net/?q=cheap-deals", "a.net", "/", None, "allow"),
        ("no scheme /porn", "", "", None, "block"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "own") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    found = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (found[i]["host"], found[i]["path"], found[i]["rule"], found[i]["verdict"]) == (host, path, rule, verdict)
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


# --- language


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.QUERIES["op4_language_id"](spark, sf).join(storage.table(spark, sf, "documents"), "doc_id")
    held = found.filter("held_out").select("lang", "lang_pred", "score").collect()
    assert sum(r[0] == r[1] for r in held) >= 0.97 * len(held)
    assert all(0 <= r[2] <= 1 for r in held)


def test_language_of_odd_rows(odd, none):
    dictionaries = language_id.learn(odd, F.lit(True))
    assert set(dictionaries) == {"en", "de", "fr"}
    found = {r["doc_id"]: r for r in language_id.identify(odd, dictionaries).collect()}
    assert found[3]["lang_pred"] == found[4]["lang_pred"] == "und" and found[3]["rejected"]
    assert found[6]["lang_pred"] == "en"
    letterless = odd.limit(1).withColumn("text", F.lit("12 ² ... _ Ⅷ"))
    assert language_id.identify(letterless, dictionaries).first()["lang_pred"] == "und"
    assert language_id.identify(odd, language_id.learn(none, F.lit(True))).filter("lang_pred <> 'und'").count() == 0
    assert language_id.identify(none, dictionaries).count() == 0


# --- language model


def test_context_tree_equals_its_definition(spark):
    texts = ["Abra kadabra", "abra  abra", None, "", "simsalabim é", "abra dabra", "unseen q"]
    rows = [(i, t, i >= 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, held boolean").repartition(2)
    found = {r["doc_id"]: r for r in context_tree.score_texts(docs, "held", block_bytes=12).collect()}
    plain = [" ".join(brute.space_words(t)).encode() + b"\n" for t in texts]
    tree = brute.ContextTree(plain[:5], context_tree.DEPTH)
    tokens = [[*brute.space_words(t), "\n"] for t in texts]
    known = [w for t in tokens[:5] for w in t]
    for i in range(len(texts)):
        assert found[i]["score"] == pytest.approx(tree.score(plain[i]), abs=1e-6)
        base = sum(
            math.log10((known.count(w) + 0.1) / (len(known) + 0.1 * (len(set(known)) + 1))) for w in tokens[i]
        )
        assert found[i]["base_score"] == pytest.approx(base, abs=1e-9)
        assert found[i]["n_tokens"] == len(tokens[i])
        assert found[i]["n_known"] == sum(w in known for w in tokens[i])
        assert found[i]["train_tokens"] == len(known) and found[i]["held_out"] == (i >= 5)


def test_context_tree_of_odd_rows(odd, none):
    found = context_tree.score_texts(odd.withColumn("n", F.col("doc_id").isNull()), "n", block_bytes=100000)
    assert found.count() == len(ODD)
    assert context_tree.score_texts(none.withColumn("n", F.lit(False)), "n").count() == 0
    unlearned = context_tree.score_texts(odd.withColumn("n", F.lit(True)), "n")
    assert all(r[0] == pytest.approx(8) for r in unlearned.select("bits_per_byte").collect())


# --- HTML

PAGE = """<!doctype html><html><head><title>T{0}</title><style>x</style></head><body class="has-sidebar">
<header><a href=/>Site {0}</a></header><div class="cookie-notice">Cookies {0}</div>
<div id=wrap><div class="sidebar">Links {0}</div><div class=content><h1>Title {0}</h1><p>Written by staff</p>
<p>Body &amp; text{1}   with
lines<br>next</p><ul><li>one {0}<li>two {1}</ul><script>bad()</script>{2}<form>mail {0}<input></form></div></div>
<div class="comments"><p>nice {0}</p></div><footer>&copy; {0}</footer>"""


def test_wrapper_of_a_host():
    wrapper = wrappers.induce([PAGE.format(i, i * 7919, "") for i in range(4)])
    page = PAGE.format(9, 3, "<div>in <b>bo</b>ld</div>")
    wanted = "Title 9\nBody & text3 with lines next\none 9\ntwo 3\nin bold"
    assert wrappers.main_text(page, wrapper) == wanted
    assert "Written by staff" in wrappers.main_text(page, None)
    assert wrappers.main_text("<article><p>other</article>", wrapper) == "other"
    assert wrappers.induce([page]) is None and wrappers.induce([page, page]) is not None


LEAD = "<article><h1>Title {0}</h1><div class=lead>{1}</div><div class=body>{2}</div></article>"


def test_text_beside_the_largest_container(spark):
    leads, bodies = [f"lead {i} " + "a " * 30 + "z" for i in range(9)], [f"body {i} " + "b " * 60 + "z" for i in range(9)]
    rows = [(i, f"http://a/{i}", LEAD.format(i, leads[i], bodies[i])) for i in range(9)]
    rows += [(9, "http://a/9", "<article><h1>Title 9</h1><div class=body>short</div></article><div class=more>long 9</div>")]
    rows += [(i, f"http://b/{i}", f"<main><h1>T{i}</h1><article><p>in {i}</p><section>{bodies[i]}</section></article></main>")
             for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = rows_of(wrappers.extract(pages), "url", "text")
    wanted = [(f"http://a/{i}", f"Title {i}\n{leads[i]}\n{bodies[i]}") for i in range(9)]
    wanted += [("http://a/9", "Title 9\nshort\nlong 9")]
    wanted += [(f"http://b/{i}", f"T{i}\nin {i}\n{bodies[i]}") for i in range(9)]
    assert found == sorted(wanted, key=repr)


def test_wrappers_count_all_pages_of_a_host(spark):
    long = "w " * 40000
    rows = [(f"http://long/{i}", f"<div>Printed by us</div><p>{i} {long}</p>") for i in range(4)]
    # One page thousands of times, few others.
    rows += [("http://copies/0", "<div>Printed by us</div><p>copy</p>")] * 2000
    rows += [(f"http://copies/{i}", f"<div>Printed by us</div><p>own {i}</p>") for i in range(1, 4)]
    # Two layouts, one of them rare.
    rows += [(f"http://two/{i}", f"<div class=a>Common</div><p>own {i}</p>") for i in range(400)]
    rows += [(f"http://two/r{i}", f"<div class=b>Rare</div><p>rare {i}</p>") for i in range(3)]
    # Constant on all pages but the last, which keeps its own.
    rows += [(f"http://most/{i}", f"<div>{'Alike' if i < 99 else 'Unlike'}</div><p>own {i}</p>") for i in range(100)]
    # Copies are one page, not three.
    rows += [(f"http://same/{i % 2}", f"<div>Two pages</div><p>{i % 2}</p>") for i in range(6)]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    found = [t for _, t in sorted(wrappers.extract(pages).select("page_id", "text").collect())]
    wanted = [f"{i} {long}".strip() for i in range(4)] + ["copy"] * 2000 + [f"own {i}" for i in range(1, 4)]
    wanted += [f"own {i}" for i in range(400)] + [f"rare {i}" for i in range(3)]
    wanted += [("" if i < 99 else "Unlike\n") + f"own {i}" for i in range(100)]
    wanted += [f"Two pages\n{i % 2}" for i in range(6)]
    assert found == wanted


@pytest.mark.parametrize("tag", ["article", "main"])
@pytest.mark.parametrize("n", [2, 3, 8])
def test_shared_passages_of_articles_stay(tag, n):
    page = "<div>Printed by us</div><{1}><h1>T{0}</h1><h2>Background</h2><p>shared words</p><p>own {0}</p></{1}>"
    wrapper = wrappers.induce([page.format(i, tag) for i in range(n)])
    for i in range(n + 1):
        text = f"T{i}\nBackground\nshared words\nown {i}"
        assert wrappers.main_text(page.format(i, tag), wrapper) == ("Printed by us\n" if n < 3 else "") + text


@pytest.mark.parametrize(
    "page, text",
    [(None, ""), ("", ""), ("<", "<"), ("<p", ""), ("a<b>c", "ac"), ("<p>a</p", "a"), ("&amp;lt", "&lt"), ("</p>x", "x"),
     ("<!-- a", ""), ("<script>x", ""), ("a < b", "a < b"), ('<a href="x>y</a>z', "yz"), ("<p>a<p>b<div>c", "a\nb\nc"),
     ("<nav>m</nav><p>&eacute;&#233;", "éé"), ("<div>" * 5000 + "x", "x")],
)
def test_odd_pages(page, text):
    assert wrappers.main_text(page, None) == text


def test_articles_of_the_tables(spark):
    pages = {r["page_id"]: r["html"] for r in storage.table(spark, SF, "pages").collect()}
    found = queries.QUERIES["op7_html"](spark, SF).collect()
    assert len(found) == len(pages)
    import html

    for row in found:
        article = re.search("<article>(.*)</article>", pages[row["page_id"]], re.S)[1]
        parts = re.split("</?(?:p|h1)>", article.replace("<br>", " "))
        texts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts]
        assert row["text"] == "\n".join(t for t in texts if t)
        assert row["n_chars"] == len(row["text"])


def test_extract_of_odd_rows(spark):
    rows = [(1, "http://a/x", None), (2, None, "<p>b</p>"), (3, "http://a/y", ""), (3, "http://a/y", ""), (None, "u", "<p>c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    assert rows_of(wrappers.extract(pages), "page_id", "text") == sorted(
        [(1, ""), (2, "b"), (3, ""), (3, ""), (None, "c")], key=repr
    )
    assert wrappers.extract(pages.limit(0)).count() == 0


# --- quality


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.QUERIES["op8_quality"](spark, sf).join(storage.table(spark, sf, "labels"), "doc_id")
    held = found.filter("held_out").select("quality", "predicted", "score").collect()
    assert sum(r[0] == r[1] for r in held) >= 0.95 * len(held)
    assert all(0 <= r[2] <= 1 and (r[2] >= 0.7) == r[1] for r in held)


def test_preferences_are_learned():
    random.seed(1)
    good = np.array([[random.gauss(1, 1), random.gauss(0, 1)] for _ in range(400)])
    bad = np.array([[random.gauss(-1, 1), random.gauss(0, 1)] for _ in range(100)])
    model = quality.fit(good, bad, 0.2)
    assert model.weights[0] > 5 * abs(model.weights[1])
    rejected = np.concatenate([model.scores(good), model.scores(bad)]) < quality.CUT_SCORE
    assert abs(rejected.mean() - 0.2) < 0.01  # the cut-off is the quantile


def test_quality_of_odd_rows(spark, odd, clashing, none):
    labels = spark.createDataFrame(
        [(1, 1, 0), (6, 0, 0), (6, 0, 0), (99, 1, 0), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int"
    )
    model = quality.learn(odd, labels, modulus=1, rest=1)
    found = quality.score(odd, model)
    assert found.count() == len(ODD) and found.filter("score between 0 and 1").count() == len(ODD)
    assert quality.keep_good(clashing, labels).columns == clashing.columns
    assert quality.learn(none, labels) is None
    assert quality.learn(odd, labels.limit(0)) is None
    assert quality.keep_good(odd, labels.limit(0)).count() == len(ODD)
    assert quality.score(none, model).count() == 0


# --- mixing


def test_mix_is_near_its_targets(spark):
    found = queries.QUERIES["op9_mixing"](spark, SF)
    assert found.filter("taken > 3 * size").count() == 0
    groups = found.join(storage.table(spark, SF, "documents").select("doc_id", "source"), "doc_id").groupBy("source")
    for row in groups.agg(F.sum("taken").alias("t"), F.max("target").alias("w"), F.max("size").alias("m")).collect():
        assert abs(row["t"] - row["w"]) <= row["m"] / 2
    total = found.agg(F.sum("size")).first()[0]
    shares = {tuple(r) for r in found.select("source_size", "target").distinct().collect()}
    assert sum(t for _, t in shares) == pytest.approx(total)


def test_mix_of_odd_rows(clashing, odd, none):
    planned = mixing.plan_mix(odd)
    assert planned.count() == len(ODD)
    sizes = {r[0]: r[1] for r in planned.select("__row.doc_id", "size").collect()}
    assert sizes[3] == sizes[4] == 0 and sizes[6] == 30000 and sizes[5] == 3
    mixed = mixing.ordered_mix(clashing)
    positions = [r["position"] for r in mixed.collect()]
    assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)
    assert set(clashing.columns) <= set(mixed.columns)
    assert mixing.plan_mix(none).count() == 0 and mixing.ordered_mix(none).count() == 0


def test_positions_invert_the_schedule(spark):
    segments = mixing._segments(((0.0, 2.0), (0.5, 0.0), (1.0, 4.0)))
    shares = spark.createDataFrame([(i / 20,) for i in range(21)], "share double")
    for share, at in shares.select("share", mixing.position_of(F.col("share"), segments)).collect():
        area = 2 * at - 2 * at * at if at <= 0.5 else 0.5 + 4 * (at - 0.5) ** 2
        assert area / 1.5 == pytest.approx(share, abs=1e-9)


# --- WARC


def test_archives_round_trip(spark):
    odd = "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nb\r\n\r\n"
    rows = [
        (3, "http://h/p?q#f", odd), (1, "http://h/q", odd), (2, None, odd), (4, "u\r\nX: 1", None), (5, "", ""),
        (6, "http://é/", "é" * 70000), (6, "http://é/", "é" * 70000), (None, "n", "alone"), (7, "s", "x"), (None, "m", "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit("own"))
    path = storage.new_path(spark, "test-warc")
    warc.write_archives(pages, path, archive_captures=3)
    records = warc.read_archives(spark, path)
    assert records.count() == 3 * len(rows)
    captures = warc.assemble(records).collect()
    assert len(captures) == len(rows)
    assert all(c["request"] is not None and c["metadata"] is not None for c in captures)
    bodies = sorted(
        bytes(c["block"]).split(b"\r\n\r\n", 1)[1].decode() for c in captures if c["type"] == "response"
    )
    assert bodies == sorted(["", odd, "é" * 70000, "é" * 70000, "alone", "x"])
    found = warc.archived_captures(pages)
    got = rows_of(found, "page_id", "type", "refers_to_page", "page_bytes")
    size = len(odd.encode())
    assert got == sorted(
        [(1, "response", None, size), (2, "revisit", 1, size), (3, "revisit", 1, size), (4, "response", None, 0),
         (5, "revisit", 4, 0), (6, "response", None, 140000), (6, "response", None, 140000), (None, "response", None, 5),
         (7, "response", None, 1), (None, "revisit", 7, 1)], key=repr)
    first = {r["record_id"]: r for r in captures}
    assert all(r["refers_to"] in first for r in captures if r["type"] == "revisit")
    small = warc.archived_captures(pages, revisit_bytes=2)
    assert small.filter("type = 'revisit' and page_bytes < 2").count() == 0
    assert warc.archived_captures(pages.limit(0)).count() == 0


def test_warc_archives_of_long_pages(spark):
    import gzip
    import tracemalloc

    html = F.concat(F.col("page_id").cast("string"), F.expr("repeat('x', 1 << 20)"))
    pages = spark.range(150).coalesce(1).select(F.col("id").alias("page_id"), F.lit("http://a/b").alias("url"))
    path = storage.new_path(spark, "test-warc-long")
    warc.write_archives(pages.withColumn("html", html), path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").collect()
    assert max(len(gzip.decompress(r["content"])) for r in files) <= (128 << 20) + 1000 * 2000
    found = warc.read_archives(spark, path).filter("type = 'response'")
    assert found.filter("claimed_digest = digest").agg(F.count("*"), F.sum("payload_bytes")).first() == (
        150, sum(len(str(i)) + (1 << 20) for i in range(150)),
    )

    record = b"WARC/1.1\r\nContent-Length: 1000000\r\n\r\n" + b"y" * 1000000 + b"\r\n\r\n"
    archive = gzip.compress(record * 30) + gzip.compress(record[:-4]) + gzip.compress(b"\r\n\r\n" + record)
    tracemalloc.start()
    assert sum(len(block) for _, block in warc.parse_records(archive)) == 32 * 1000000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.parse_records(gzip.compress(record[:-100])))


def test_held_out_share(spark):
    frame = spark.range(50).select(F.col("id").alias("doc_id"), quality.held_out("id", 5, 0).alias("held"))
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in frame.collect())
