"""Language identification, the Kneser-Ney classifier and the pipeline."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from modelwatch.llm import kneser, kneser_points, langid
from modelwatch.llm.common import documents
from tests.conftest import SF_CHECK, SF_SMOKE
from tests.llm.cases import AWKWARD, awkward, empty, table

# --- language identification -----------------------------------------------------------------------------------------


def test_counts_equal_plain_ngrams(monkeypatch):
    text = "Ab é漢 12 aBc, zz" * 3
    low = "".join(" " if c < "a" or "z" < c < "\x80" else c for c in text.lower())

    def slot(gram):
        h = 0
        for step, c in zip(langid._STEPS.tolist(), gram):
            h = (h + ord(c)) * step % 2 ** 64
            h ^= h >> 29
        return (h * langid._STEPS.tolist()[0] % 2 ** 64) >> (64 - langid.BUCKET_BITS)

    want = Counter(slot(low[i:i + n]) for n in (1, 2, 3) for i in range(len(low) - n + 1))
    for piece in (1 << 20, 7):
        monkeypatch.setattr(langid, "_PIECE", piece)
        found, times = langid.counts(text)
        assert dict(zip(found.tolist(), times.tolist())) == want
    assert [len(x) for x in langid.counts("")] == [0, 0]


def test_held_out_accuracy(spark):
    docs = documents(spark, SF_CHECK)
    model = langid.fit(docs, ~langid.held_out())
    rows = langid.predict(docs.withColumn("held", langid.held_out()), model, keep=["held", "lang"]).where("held").collect()
    assert len(rows) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert (model.weights == 0).mean() > 0.2  # elastic net: unused features stay at zero


def test_predictions_come_from_text_only(spark):
    docs = documents(spark, SF_SMOKE)
    model = langid.fit(docs, ~langid.held_out())
    other = docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("zz").alias("lang"))
    a = langid.predict(docs, model, keep=["text"]).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, langid.predict(other, model, keep=["text"]).collect()))


def test_language_of_awkward_and_empty(spark):
    docs = awkward(spark)
    model = langid.fit(docs, ~langid.held_out())
    rows = langid.predict(docs, model, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "de")
    none = langid.fit(empty(spark), ~langid.held_out())
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0


def test_temperature_is_the_best_scale():
    rng = np.random.default_rng(5)
    z = rng.standard_normal((4000, 3))
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(langid.temperature(z * 4, y) - 4) < 0.6


def test_letters_are_those_of_unicode():
    model = langid.Model(["en"], np.ones(1 << langid.BUCKET_BITS), np.zeros((1 << langid.BUCKET_BITS, 1)), np.zeros(1))
    for text in ("½", "² ³", "①", "123 _", "", "☃"):
        assert model.predict(text) == ("und", 0.0)
    for text in ("a", "1ª", "漢", "½ é"):
        assert model.predict(text) == ("en", 1.0)


def test_weights_equal_a_plain_ftrl():
    """Follow-the-regularised-leader coordinate by coordinate, with the batches of the fit."""
    rng = np.random.default_rng(9)
    size, classes, batch, alpha, beta, l1, l2 = 7, 3, 4, 0.5, 1.0, 0.4, 0.1
    rows = [(f := np.sort(rng.choice(size, rng.integers(1, 4), replace=False)), rng.uniform(0.1, 1, len(f))) for _ in range(22)]
    y = rng.integers(0, classes, len(rows))
    z, n, w = ({(j, c): 0.0 for j in range(size + 1) for c in range(classes)} for _ in range(3))
    order = np.random.default_rng(7)
    for _ in range(3):
        shuffled = order.permutation(len(rows)).tolist()
        for at in range(0, len(rows), batch):
            some = shuffled[at:at + batch]
            grad = Counter()
            for r in some:
                x = {**dict(zip(rows[r][0].tolist(), rows[r][1].tolist())), size: 1.0}
                e = [math.exp(sum(v * w[j, c] for j, v in x.items())) for c in range(classes)]
                for j, v in x.items():
                    for c in range(classes):
                        grad[j, c] += v * (e[c] / sum(e) - (c == y[r])) / len(some)
            for (j, c), g in grad.items():
                sigma = (math.sqrt(n[j, c] + g * g) - math.sqrt(n[j, c])) / alpha
                z[j, c] += g - sigma * w[j, c]
                n[j, c] += g * g
                first, second = (0.0, 0.0) if j == size else (l1 / batch, l2 / batch)
                sign = math.copysign(1, z[j, c])
                w[j, c] = 0.0 if abs(z[j, c]) <= first else -(z[j, c] - sign * first) / ((beta + math.sqrt(n[j, c])) / alpha + second)
    weights, bias = langid.fit_ftrl(rows, y, classes, size, 3, batch, alpha, beta, l1, l2)
    want = np.array([[w[j, c] for c in range(classes)] for j in range(size + 1)])
    assert np.allclose(weights, want[:size]) and np.allclose(bias, want[size]) and (weights == 0).any() and (weights != 0).any()


def test_copies_and_many_languages(spark, monkeypatch):
    """Copies of a text are sampled once; of many languages those with the most different texts are learned."""
    rows = [(i, f"{chr(97 + k)}{chr(98 + k)} text {i % 30}" if k else "hot text", f"l{k:02d}") for k in range(12) for i in range(30 + k)]
    docs = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "FIT_LANGS", 5)
    model = langid.fit(docs, F.lit(True))
    assert model.langs == ["l01", "l02", "l03", "l04", "l05"]  # 30 texts each, first by name; l00 has one text


# --- quality classifier ----------------------------------------------------------------------------------------------

def test_discounts_are_never_zero():
    counts = [({}, [0.5, 1.0, 1.5]), ({1: 4}, None), ({1: 9, 2: 5, 3: 1, 4: 9}, None), ({2: 5, 4: 1}, [0.5, 1.0, 1.5])]
    for of, want in counts:
        d = kneser_points.discounts(of)
        assert all(0 < x <= i for i, x in enumerate(d, 1)) and (want is None or d == want)


def test_clean_documents_stay_and_junk_goes(spark):
    docs, labels = documents(spark, SF_CHECK), documents(spark, SF_CHECK, "labels")
    rows = kneser.classify(docs, labels).join(labels, "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.2


def test_hidden_good_documents_are_lost_as_rarely_as_the_quantiles_say(spark):
    """Half of the trusted labels are hidden: their documents are judged as strictly as the others, not more."""
    docs, labels = documents(spark, SF_CHECK), documents(spark, SF_CHECK, "labels")
    hidden = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = kneser.classify(docs, labels.where(~hidden)).join(labels, "doc_id").withColumn("hidden", hidden).collect()
    good = [r for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    seen, unseen = ([r["kept"] for r in good if r["hidden"] is h] for h in (False, True))
    share = 1 - kneser.QUANTILE + kneser.LOW_QUANTILE
    # two standard deviations of a count this small on top of twice the share
    assert 1 - np.mean(unseen) <= 2 * share + 2 * (share / len(unseen)) ** 0.5
    assert abs(np.mean(unseen) - np.mean(seen)) < 0.03


def test_classifier_of_awkward_and_empty(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (6, None, 0), (None, 1, 0), (8, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    rows = kneser.classify(awkward(spark), labels, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(AWKWARD)
    assert all((r["perplexity"] is None and not r["kept"]) == (not r["text"]) for r in rows)
    assert all(r["kept"] for r in rows if r["doc_id"] == 1)
    untrusted = kneser.classify(awkward(spark), labels.limit(0)).collect()
    assert all(r["kept"] == bool(r["text"]) for r in untrusted)
    assert kneser.classify(empty(spark), labels).count() == 0


# --- pipeline --------------------------------------------------------------------------------------------------------

def test_pipeline_equals_its_stages_applied_plainly(spark):
    """Every stage on what the one before kept, each checked against a plain reading of its operator's rows."""
    docs = documents(spark, SF_SMOKE)
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF_SMOKE).collect()}
    verdict = kneser.classify(docs, documents(spark, SF_SMOKE, "labels")).collect()
    kept = [r for r in verdict if r["kept"]]
    assert all(c in corpus_pipeline.quality(spark, docs, SF_SMOKE).columns for c in docs.columns)
    from tests.llm.test_scans import _contained, _patterns
    from tests.llm.test_simhash import _expected

    component = {i: c for i, _, c in _expected([(r["doc_id"], r["text"]) for r in kept])}
    first = [r for r in kept if component[str(r["doc_id"])] == str(r["doc_id"])]
    items = [(r["item_id"], r["text"]) for r in documents(spark, SF_SMOKE, "benchmark").collect()]
    hit = {eval(p)[0] for p in _contained([(r["doc_id"], r["text"]) for r in first], items)}
    left = {r["doc_id"]: r["text"] for r in first if r["doc_id"] not in hit}
    assert set(rows) == set(left) and all(r["lossless"] for r in rows.values())
    from modelwatch.llm import bpe

    codec = bpe.load(corpus_pipeline.tokenizer_path("byte_bpe_50k.json"))
    for i, text in left.items():
        back = codec.decode(np.array(rows[i]["ids"], np.uint32))
        assert not _patterns(back)
        if not any(c in "0123456789@" for c in text):
            assert back == text


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_awkward_and_empty_tables(spark, stage):
    docs = awkward(spark)
    out = stage(spark, docs, SF_SMOKE)
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.schema.fieldNames() == docs.columns
    assert 0 < out.count() <= len(AWKWARD)
    assert stage(spark, empty(spark), SF_SMOKE).count() == 0
