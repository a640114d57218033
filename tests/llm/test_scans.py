"""Decontamination, licences, quality rules and personal data against plain versions."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from modelwatch.llm import decontaminate, licenses, pii, quality_rules
from tests.conftest import SF_CHECK
from tests.llm.cases import AWKWARD, awkward, empty, table


def _fold(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


# --- decontamination -------------------------------------------------------------------------------------------------

def _items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def _contained(docs, items):
    out = []
    for i, text in docs:
        words = _fold(text)
        for j, item in dict.fromkeys(items):
            w = _fold(item)
            k = min(5, len(w))
            if not k:
                continue
            grams = {tuple(w[p:p + k]) for p in range(len(w) - k + 1)}
            have = {tuple(words[p:p + k]) for p in range(len(words) - k + 1)}
            if 10 * len(grams & have) >= 8 * len(grams):
                out.append(str((i, j, len(grams), len(grams & have))))
    return sorted(out)


def _benchmark_case(seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ñu"]
    items = [" ".join(rnd.choices(vocabulary, k=rnd.choice([0, 1, 3, 5, 12, 30, 70]))) for _ in range(40)]
    texts = []
    for _ in range(60):
        words = rnd.choices(vocabulary, k=rnd.randint(0, 200))
        if rnd.random() < 0.6:
            planted = rnd.choice(items).split()
            for _ in range(rnd.randint(0, 2)):
                if planted:
                    planted[rnd.randrange(len(planted))] = "changed"
            at = rnd.randint(0, len(words))
            words[at:at] = planted
        texts.append(", ".join(words).upper() if rnd.random() < 0.2 else " ".join(words))
    return texts, [*items, None]


@pytest.mark.parametrize("block", [8 << 20, 600])
def test_contained_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)  # 600: several passes
    texts, items = _benchmark_case()
    docs, bench = table(spark, texts), _items(spark, items).unionByName(_items(spark, items[:2]))
    got = decontaminate.contained(docs, bench)
    pairs = _contained(list(enumerate(texts)), list(enumerate(items)))
    assert sorted(str((r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"])) for r in got.collect()) == pairs
    hit = {eval(p)[0] for p in pairs}
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == set(range(len(texts))) - hit
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", bench.toPandas())
    twin = con.execute(decontaminate.SQL).fetchall()
    assert sorted(str((r[0], r[1], r[2], r[3])) for r in twin) == pairs


def test_decontamination_of_awkward_and_empty(spark):
    docs = awkward(spark)
    items = _items(spark, ["", None, "a plain text with a few words"])
    assert {r["doc_id"] for r in decontaminate.contained(docs, items).collect()} == {1, 14}
    assert decontaminate.clean(docs, items).columns == docs.columns
    assert decontaminate.clean(docs, items).count() == len(AWKWARD) - 3
    assert decontaminate.contained(docs, items.limit(0)).count() == 0
    assert decontaminate.contained(empty(spark), items).count() == 0


# --- licences --------------------------------------------------------------------------------------------------------

def test_license_places_and_labels(spark):
    texts = ["Released under the MIT License.", "the mit, LICENSE mit license", "general public\nlicense apache license",
             "Permission is hereby granted, free of charge, to any new person obtaining a copy of this software and associated "
             "documentation files, to deal in the Software without restriction", "all rights are reserved", "All RIGHTS reserved",
             "mit-license apache  license", "submit license", "licensed under cc by nc"]
    got = {r["doc_id"]: r for r in licenses.scan(table(spark, texts)).collect()}
    for i, text in enumerate(texts):
        words, starts, labels = _fold(text), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            for k in range(len(words)):
                if words[k:k + len(p)] == p:
                    starts.append(k)
                    labels.add(label)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= {x for x in r["labels"].split(",") if x} and 0 <= r["score"] <= 1
    assert [got[i]["labels"] for i in (3, 4, 5, 7, 8)] == ["mit", "", "all-rights-reserved", "", ""]
    assert got[3]["score"] > 0.9 and 0 < got[8]["score"] < 0.8


def test_license_spans_equal_a_plain_vote(spark):
    rnd = random.Random(4)
    templates = tuple((f"l{i}", " ".join(rnd.choices("abcd", k=rnd.randint(3, 9)))) for i in range(5))
    texts = [" ".join(rnd.choices("abcd", k=rnd.randint(0, 60))) for _ in range(40)]
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in licenses.scan(table(spark, texts), templates).collect()}
    for i, text in enumerate(texts):
        words, labels, most = text.split(), set(), 0.0
        for label, t in templates:
            t = t.split()
            votes = {}
            for p in range(len(words) - 2):
                for q in range(len(t) - 2):
                    if words[p:p + 3] == t[q:q + 3]:
                        votes.setdefault(p - q, set()).update(range(q, q + 3))
            groups = []
            for d in sorted(votes):
                if groups and d - groups[-1][0] <= licenses.SLACK:
                    groups[-1] = (d, groups[-1][1] | votes[d])
                else:
                    groups.append((d, votes[d]))
            for _, covered in groups:
                most = max(most, len(covered) / len(t))
                if len(covered) / len(t) >= licenses.COVER:
                    labels.add(label)
        assert got[i] == (",".join(sorted(labels)), round(most, 9))
    con = duckdb.connect()
    con.register("documents", table(spark, texts).toPandas())
    twin = {r[0]: (r[6], round(r[7], 9)) for r in con.execute(licenses.sql(templates)).fetchall()}
    assert twin == got


def test_licenses_of_awkward_and_empty(spark):
    assert licenses.scan(awkward(spark)).count() == len(AWKWARD)
    assert licenses.scan(empty(spark)).count() == 0


# --- quality rules ---------------------------------------------------------------------------------------------------

def _statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = [False] * len(words)
    for k in range(len(words) - 2):
        if windows[tuple(words[k:k + 3])] > 1:
            inside[k:k + 3] = [True] * 3
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, sum(inside)]


def test_statistics_equal_plain_counts():
    rnd = random.Random(6)
    texts = ["".join(rnd.choices(["a ", "b ", "é ", "\n", "# ", "|", "漢", "\t", "\x1c"], k=rnd.randint(0, 80))) for _ in range(400)]
    for text in [*texts, *(t for t in AWKWARD if t)]:
        assert quality_rules.statistics(text.encode())[0] == _statistics(text), text[:200]


def test_trees_learn_and_keep_their_signs():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * rng.standard_normal(3000)) > 0.5).astype(float)
    trees = quality_rules.fit_trees(x, y, [1, 0, -1], trees=30)
    p = trees.probability(x)
    assert ((p > 0.5) == y).mean() > 0.85
    for feature, sign in ((0, 1), (2, -1)):
        at = np.repeat(rng.random((200, 3)), 30, axis=0).reshape(200, 30, 3)
        at[:, :, feature] = np.linspace(0, 1, 30)
        steps = np.diff(trees.probability(at.reshape(-1, 3)).reshape(200, 30), axis=1) * sign
        assert steps.min() >= -1e-12
    walked = []
    for row in x[:50]:  # node by node
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        walked.append(1 / (1 + np.exp(-total)))
    assert np.allclose(walked, p[:50])
    assert quality_rules.fit_trees(np.empty((0, 3)), np.empty(0), [0, 0, 0]).probability(x[:2]).min() > 0.9


def test_quality_rules_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (8, 1, 0), (8, 0, 0), (None, 1, 0), (9, None, None)],
                                   "doc_id long, quality int, toxic int")
    trees = quality_rules.fit(docs, labels)
    rows = quality_rules.judge(docs, trees, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        counts = _statistics(r["text"])
        assert [r[c] for c in quality_rules.COUNTS] == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["kept"] and r["base_failed"])
    model = quality_rules.fit(empty(spark), labels.limit(0))
    assert quality_rules.judge(empty(spark), model).count() == 0


# --- personal data ---------------------------------------------------------------------------------------------------

def _patterns(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        checks = sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and checks % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                  if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_patterns_equal_plain_searches():
    rnd = random.Random(1)
    for letters in ("0123456789aB@.+- ()_%é\n", "0123.@a+- ", "0 1-2"):
        for _ in range(4000):
            text = "".join(rnd.choices(letters, k=rnd.randint(0, 60)))
            assert pii.base_spans(text) == _patterns(text), text
    assert pii.base_spans("9" * 300_000 + "a" * 300_000 + "@" * 1000) == []


CARD = "4111 1111 1111 1111"
PRIVATE = ["mail bob.x@foo.com or amy@bar.org now", "call +1 (389) 555-5010 or +49 30 1234567", f"pay {CARD} and 5500005555555559",
           "host 10.0.0.1, 192.168.10.254.", "in 1999 or 2004, version 2.0 and 4.0.", "no data at all"] * 15


def test_islands_equal_a_plain_reading():
    """One whole span of the patterns or none, at most 200 characters, whatever the other spans of the text are."""
    rnd = random.Random(2)
    for letters in ("0123456789aB@.+- ()é\n", "0123.@a+- "):
        for _ in range(2000):
            text = "".join(rnd.choices(letters, k=rnd.randint(0, 90)))
            want = []
            for a, b in pii.islands(text):
                here = [x for x in _patterns(text) if x[1] < b and x[2] > a]
                if not here:
                    want.append((-1, text[a:b], 0, 0))
                elif len(here) == 1 and a <= here[0][1] and here[0][2] <= b:
                    want.append((here[0][0], text[a:b], here[0][1] - a, here[0][2] - a))
            assert pii.labelled_islands(text) == want, text
    assert pii.labelled_islands("1" * 201) == []


def test_copies_and_long_texts_do_not_change_the_fit(spark):
    rows = sorted(set(PRIVATE)) + ["x " * 15_000 + "mail zed@long.example.org now"]
    one = pii.fit(table(spark, rows))
    many = pii.fit(table(spark, rows + [rows[0]] * 400 + [rows[-1]] * 5))
    assert np.array_equal(one.weights, many.weights) and np.array_equal(one.moves, many.moves)
    short = pii.fit(table(spark, rows[:-1]))
    assert not np.array_equal(one.weights, short.weights)  # the long text is in it


def test_recall_and_precision_on_forms_that_were_not_shown(spark):
    field = pii.fit(spark.read.parquet(f"{SF_CHECK}/documents.parquet"))
    rnd = random.Random(1)
    digits = lambda n: "".join(str(rnd.randrange(10)) for _ in range(n))
    found = planted = right = 0
    for _ in range(40):
        ip = [str(rnd.randrange(1, 255)) for _ in range(4)]
        card = "4" + digits(14)
        card += next(str(c) for c in range(10) if pii.luhn(card + str(c)))
        four = [card[i:i + 4] for i in range(0, 16, 4)]
        a, b, c = str(rnd.randrange(200, 999)), str(rnd.randrange(200, 999)), digits(4)
        forms = [(1, ", ".join(ip)), (2, "/".join(four)), (2, "_".join(four)), (3, f"({a}){b}-{c}"), (3, f"+1/{a}/{b}{c}"), (3, f"{a} {b} {c}")]
        other = ["on 2024-01-02 at 12:30:45", "version 1.2.3 of 2019", f"order {digits(8)} shipped", "costs 1,299.00 or 15 %",
                 f"pages {digits(2)}-{digits(3)}", "at 10.5.2023 or 11/12/2013", f"in {digits(4)} and 2020"]
        for kind, s in forms:
            before, after = rnd.choice([("call ", " now"), ("it is ", ""), ("", ", thanks"), ("see ", " or not")])
            spans = pii.all_spans(before + s + after, field)[1]
            planted += 1
            found += len(spans)
            right += (kind, len(before), len(before) + len(s)) in spans
        found += sum(len(pii.all_spans(s, field)[1]) for s in other)
    assert right >= 0.9 * planted and right >= 0.9 * found


def test_field_finds_rewritten_forms():
    field = pii.fit_field(pii.examples_of(sorted({x for t in PRIVATE for x in pii.labelled_islands(t)})))
    found = lambda t: [(pii.KINDS[k], t[a:b]) for k, a, b in pii.all_spans(t, field)[1]]
    assert found("call (389) 555-5010 now") == [("phone", "(389) 555-5010")]
    assert found("mail bob.x(at)foo.com ok") == [("email", "bob.x(at)foo.com")]
    assert found("in 1999 or 2004 and 4.0. Version 2.0") == []
    for text in PRIVATE:
        base, spans = pii.all_spans(text, field)
        assert base == _patterns(text) and set(base) <= set(spans)


def _paths(n, x, field):
    """All segmentations as lists of (segment, type)."""
    score = field.scores(x)

    def walk(j, before, total):
        if j == n:
            yield total, []
            return
        for s in np.flatnonzero(x.begin == j):
            for kind in range(len(field.weights)):
                if np.isfinite(score[s, kind]):
                    for t, rest in walk(int(x.end[s]), kind, total + score[s, kind] + field.moves[before, kind]):
                        yield t, [(int(s), kind), *rest]

    return walk(0, 0, 0.0)


def test_dynamic_program_equals_all_segmentations():
    rng = np.random.default_rng(3)
    for text in ("1.2 a", "+12 3", "a@b.c"):
        field = pii.Field(rng.standard_normal((5, pii.SIZE)), rng.standard_normal((5, 5)))
        x = pii.lattice(text, 0, len(text))
        paths = list(_paths(len(x.tokens), x, field))
        total, best = max(paths)
        spans = [(k - 1, x.tokens[x.begin[s]][0], x.tokens[x.end[s] - 1][1]) for s, k in best if k]
        assert field.best(x) == spans
        whole = np.logaddexp.reduce([t for t, _ in paths])
        value, weights, _ = field.gradient(x, best)
        assert np.isclose(value, total - whole)
        step = field.weights.copy()
        step[2, 3] += 1e-5
        moved = pii.Field(step, field.moves).gradient(x, best)[0]
        assert np.isclose((moved - value) / 1e-5, weights[2, 3], atol=1e-3)


def test_pii_rows_and_redaction(spark):
    docs = awkward(spark)
    field = pii.fit(docs.unionByName(table(spark, PRIVATE), allowMissingColumns=True))
    rows = pii.find(docs, field, keep=["doc_id", "text"]).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        base = _patterns(r["text"] or "")
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == i for s in base) for i in range(4)]
        assert {f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(","))
    assert next(r for r in rows if r["doc_id"] == 13)["redacted"] == "1 2 3 [IP] [PHONE] [EMAIL]"
    assert pii.redact("ab cd ef", [(0, 0, 2), (3, 1, 5), (1, 6, 8)]) == "[EMAIL] [IP]"
    none = pii.fit(empty(spark))
    assert pii.find(empty(spark), none).count() == 0
