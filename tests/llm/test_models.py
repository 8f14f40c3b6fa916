"""The language model and the classifier chain against plain versions, and on held-out labels."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from meterline.llm import quality, toxicity

from .conftest import prose
from .test_text_operators import brute_base, labelled


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def bucket(before, v, lang):
    """Which of the sketch's 16 bits the word `before` the history `v` sets; None is the start."""
    ids = [np.uint64(0) if w is None else quality._word_ids(pa.array([w]), [lang])[0][0] for w in (before, v)]
    return int(quality._bigram_key(np.array(ids[:1]), np.array(ids[1:]))[0] & np.uint64(15))


def brute_discounts(n):
    y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return [0.0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.0), i) if n[i] else i / 2 for i in (1, 2, 3)]


def brute_perplexities(rows):
    """log perplexity of each row (doc_id, lang, text) by the documented model, with dictionaries."""
    out = {}
    for lang in {r[1] for r in rows}:
        plain, seen = collections.Counter(), collections.defaultdict(set)
        for _, of, text in rows:
            if of == lang:
                padded = [None, None, *words_of(text)]
                for u, v, w in zip(padded, padded[1:], padded[2:]):
                    plain[v, w] += 1
                    seen[v, w].add((u, v))
        kinds = {pair: bucket(*pair, lang) for pairs in seen.values() for pair in pairs}
        count = {}
        for k, c in plain.items():
            bits = len({kinds[pair] for pair in seen[k]})
            count[k] = c if bits == 16 else min(c, round(-16 * math.log(1 - bits / 16)))
        histories = collections.Counter(w for _, w in count)
        of_history = collections.defaultdict(list)
        for (v, _), c in count.items():
            of_history[v].append(c)
        high = brute_discounts(collections.Counter(count.values()))
        low = brute_discounts(collections.Counter(histories.values()))
        n = sum(histories.values())
        floor = sum(low[min(c, 3)] for c in histories.values()) / n / (len(histories) + 1)

        def log_p(v, w):
            lower = max(histories[w] - low[min(histories[w], 3)], 0) / n + floor
            counts = of_history[v]
            spare = sum(high[min(c, 3)] for c in counts)
            return math.log((max(count[v, w] - high[min(count[v, w], 3)], 0) + spare * lower) / sum(counts))

        for i, of, text in rows:
            if of == lang and words_of(text):
                w = words_of(text)
                out[i] = -sum(map(log_p, [None, *w], w)) / len(w)
    return out


def lesser_median(x):
    return sorted(x)[(len(x) - 1) // 2]


def test_verdicts_equal_a_plain_model(spark):
    rows = [(i, "en" if i % 3 else None, f"{prose(i, 60 + i % 40, 25 if i % 3 else 200)} a{i} b{i // 4} c{i // 7} d{i // 10} e{i // 13}") for i in range(150)]
    rows += [(500 + i, rows[4][1], rows[4][2]) for i in range(60)]  # copies count once in the band
    rows += [(600 + i, "en", prose(700 + i, 80, 4 + i % 5)) for i in range(8)]  # too predictable
    rows += [(700 + i, "en", " ".join(f"zz{i}q{k}" for k in range(70))) for i in range(4)]  # foretold by nothing but itself
    rows += [(710 + i, "en", " ".join(random.Random(i).choices([f"yy{i}q{k}" for k in range(80)], k=3000))) for i in range(4)]  # any word after any
    rows += [(800, "en", "too short"), (801, None, None), (802, "en", ""), (803, "en", "a b c " * 40)]
    score = brute_perplexities(rows)
    base = {i: brute_base(t) for i, _, t in rows}
    band = {}
    for lang in ("en", None):
        sound = {(base[i], round(score[i], 12)): score[i] for i, of, _ in rows if of == lang and not base[i][-1]}.values()
        middle = lesser_median(sound)
        below, above = (max(1.4826 * lesser_median([abs(x - middle) for x in sound if s * (x - middle) >= 0]), 0.1) for s in (-1, 1))
        band[lang] = middle - 3 * below, middle + 6 * above
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(5)).collect()}
    sides = collections.Counter()
    for i, lang, _ in rows:
        r, (lower, upper) = got[i], band[lang]
        assert (r.perplexity is None) == (i not in score)
        assert (r.lower, r.upper) == pytest.approx((math.exp(lower), math.exp(upper)), rel=1e-9)
        if i in score:
            assert math.log(r.perplexity) == pytest.approx(score[i], rel=1e-9)
        assert r.kept == (not base[i][-1] and lower <= score[i] <= upper)
        sides.update([(score[i] < lower) - (score[i] > upper)] if not base[i][-1] else [])
    assert sides[1] and sides[-1] and sides[0] > 100  # both sides of the band reject


def test_chain_equals_plain_sums(spark):
    docs, labels = labelled(spark, 200)
    docs = docs.unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "!!! ..."), (903, prose(1, 300, 500) + " Awful-nasty loweiQ")], docs.schema))
    chain = toxicity.fit(docs, labels, ["poor", "toxic"], balance="toxic")
    got = {r.doc_id: r for r in toxicity.predict(docs, chain).collect()}
    assert len(got) == 204
    for r in docs.collect():
        held = set()
        for w in re.findall(r"\w+", (r.text or "").lower()):
            held |= {w} | {w[:n] + "*" for n in (4, 5) if len(w) >= n}
        p = []
        for link in chain.links:
            x = link.bias + sum(link.weights[chain.features[f]] for f in held if f in chain.features) + sum(map(float.__mul__, map(float, link.earlier), p))
            p.append(1 / (1 + math.exp(-min(max(x, -30), 30))))
        assert (got[r.doc_id].p_poor, got[r.doc_id].p_toxic) == pytest.approx(tuple(p), rel=1e-9)
        assert (got[r.doc_id].is_poor, got[r.doc_id].is_toxic) == tuple(x >= link.threshold for x, link in zip(p, chain.links))


def test_held_out_labels(spark):
    """Fitted on half of the labels, the chain finds nine in ten toxic documents of the other half."""
    from meterline.llm.queries import TOXICITY_CHAIN, toxicity_labels

    sf = "/root/testdata/sf0.1"
    labels = toxicity_labels(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    chain = toxicity.fit(docs, labels.where("xxhash64(doc_id) & 256 = 0"), TOXICITY_CHAIN, balance="toxic")
    other = labels.where("xxhash64(doc_id) & 256 <> 0").select("doc_id", "toxic")
    n = {(r.toxic, r.is_toxic): r["count"] for r in toxicity.predict(docs, chain).join(other, "doc_id").groupBy("toxic", "is_toxic").count().collect()}
    assert n[1, True] > 0.9 * (n[1, True] + n.get((1, False), 0)) and n.get((0, True), 0) < 0.02 * n[0, False]
