"""Language identification, quality scores and the order of the mix against plain versions."""

import math

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from marginalia.llm import language_id, mixing, quality
from marginalia.llm.storage import table
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_languages_equal_a_plain_loop(spark):
    """Every text against every dictionary, one compressor per chunk, from the definition."""
    docs = table(spark, SF, "documents")
    dictionaries = language_id.learn(docs, ~quality.held_out("doc_id", 5, 0))
    found = {r["doc_id"]: r for r in language_id.identify(docs, dictionaries).collect()}
    assert len(dictionaries) == 4

    def size(content, raw):
        total = 0
        for at in range(0, len(content), language_id.CHUNK_BYTES):
            held = zstandard.ZstdCompressionDict(raw + b" " + language_id.LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            packer = zstandard.ZstdCompressor(
                level=language_id.LEVEL, dict_data=held, write_content_size=False, write_dict_id=False
            )
            total += len(packer.compress(language_id.LEAD + content[at : at + language_id.CHUNK_BYTES]))
        return total

    order = list(dictionaries)
    seen = set()
    for row in docs.collect()[::4]:
        letters = "".join(c if c.isalpha() else " " for c in (row["text"] or "").lower())
        content = " ".join(letters.split()).encode()
        judged = found[row["doc_id"]]
        seen.add(judged["lang_pred"])
        if not content:
            assert (judged["lang_pred"], judged["score"], judged["rejected"]) == ("und", 0.0, True)
            continue
        assert content.split() == language_id.normalized(row["text"]).split()
        sizes = {lang: size(language_id.normalized(row["text"]), raw) for lang, raw in dictionaries.items()}
        best = min(order, key=lambda lang: (sizes[lang], order.index(lang)))
        unit = 8 * math.log(2) / math.sqrt(len(language_id.normalized(row["text"])))
        weights = [math.exp(-unit * (n - sizes[best])) for n in sizes.values()]
        second = sorted(sizes.values())[1]
        assert judged["lang_pred"] == best
        assert judged["score"] == pytest.approx(1 / sum(weights))
        assert judged["rejected"] == ((second - sizes[best]) / second < language_id.MARGIN)
    assert len(seen) >= 4


def descended(differences, ridge, turns=60_000):
    """The same loss by plain gradient descent."""
    weights = np.zeros(differences.shape[1])
    rate = 1 / (0.25 * np.linalg.eigvalsh(differences.T @ differences / len(differences)).max() + ridge)
    for _ in range(turns):
        p = 1 / (1 + np.exp(differences @ weights))
        step = -(differences * p[:, None]).mean(axis=0) + ridge * weights
        weights -= rate * step
        if np.abs(step).max() < 1e-10:
            break
    return weights


def test_preferences_equal_gradient_descent():
    rng = np.random.default_rng(3)
    differences = rng.normal(size=(400, 5)) @ np.diag([1, 2, 0.5, 1, 1]) + [0.5, -0.4, 0.1, 0, 0.2]
    for ridge in (0.01, 0.1):
        assert quality.fit_preferences(differences, ridge) == pytest.approx(descended(differences, ridge), abs=1e-5)


def test_scores_equal_the_model_fitted_by_descent(spark):
    """All of it from the definition: features by label, pairs, loss, quantile, logistic score."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = {r["doc_id"] for r in docs.filter(quality.held_out("doc_id", 4, 2)).select("doc_id").collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in texts and r["doc_id"] not in out}
    rows = {k: quality.features(texts[k]) for k in known}
    good, bad = (np.array([rows[k] for k in sorted(known) if known[k] == label]) for label in (1, 0))
    both = np.concatenate([good, bad])
    mean, spread = both.mean(axis=0), both.std(axis=0) + 1e-6
    scaled = lambda found: np.clip((found - mean) / spread, -8, 8)
    pairs = [
        scaled(good)[i % len(good)] - scaled(bad)[(i + turn * 7919) % len(bad)]
        for turn in range(quality.PARTNERS)
        for i in range(max(len(good), len(bad)))
    ]
    weights = descended(np.array(pairs), quality.RIDGE)
    utilities = sorted([*(scaled(good) @ weights), *(scaled(bad) @ weights)])
    cut = (utilities[len(bad) - 1] + utilities[len(bad)]) / 2  # as many below as there are bad labels
    shift = math.log(quality.CUT_SCORE / (1 - quality.CUT_SCORE))
    model = quality.learn(docs, labels)
    assert model.cut == pytest.approx(cut, abs=1e-3)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for key, text in texts.items():
        utility = float(scaled(np.array(quality.features(text))) @ weights)
        assert scores[key] == pytest.approx(1 / (1 + math.exp(-(utility - cut + shift))), abs=2e-3)


def test_the_last_stage_stands_in_training_order(spark):
    """Every copy at the time by which its source's schedule has given what stands before its middle."""
    docs = table(spark, SF, "documents").filter("doc_id % 3 = 0")
    mixed = corpus_pipeline.mixed(spark, docs, SF).select("doc_id", "source", "size", "target", "copy", "position").collect()
    places = [r["position"] for r in mixed]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places) and len(set(places)) > 50

    import hashlib

    rows = [(r["doc_id"], r["source"], len(brute.space_words(r["text"]))) for r in docs.collect()]
    by_source = {}
    for key, source, size in rows:
        by_source.setdefault(source, []).append((hashlib.md5(str(key).encode()).hexdigest(), size, key))
    found = {(r["doc_id"], r["copy"]): r for r in mixed}
    assert len(found) == len(mixed)
    expected = 0
    for number, source in enumerate(sorted(by_source)):
        (t0, w0), (t1, w1) = mixing.SCHEDULES[number % 3]
        own = sorted(by_source[source])
        whole = sum(size for _, size, _ in own)
        target = next(r["target"] for r in mixed if r["source"] == source)
        start = 0
        for _, size, key in own:
            passes = math.floor(target / whole)
            copies = passes + (start + size / 2 < target - passes * whole)
            for copy in range(copies):
                due = min((copy * whole + start + size / 2) / target, 1)
                # The integral of the weight up to the position, over that of the whole time.
                at = found[key, copy]["position"]
                area = w0 * at + (w1 - w0) * at * at / 2
                assert area / ((w0 + w1) / 2) == pytest.approx(due, abs=1e-9)
                expected += 1
            start += size
    assert expected == len(mixed)
