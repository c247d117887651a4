"""The operators for training data, against brute force, round trips and held-out accuracy."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import clean_events, groups, leaks, packing, runs, subjects, subsequences


def test_groups(spark):
    rng = random.Random(1)
    rows = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 400)] + [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(300)]
    rows += [(5000, None), (None, 5001), (None, None), (5002, 5002), (3, 2), (3, 2), (-7, -(2**62)), (-7, 2**63 - 1)]
    rng.shuffle(rows)
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in rows:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = groups.consolidate(spark.createDataFrame([(a, b, "x") for a, b in rows], "src bigint, dst bigint, record_id string"))
    assert {(r.record_id, r.group_id) for r in got.collect()} == {(x, find(x)) for x in parent} and got.count() == len(parent)
    empty = spark.createDataFrame([], "src bigint, dst bigint")
    assert groups.consolidate(empty).count() == 0
    assert {tuple(r) for r in groups.consolidate(spark.createDataFrame([(1, None), (2, 2)], "src bigint, dst bigint")).collect()} == {(1, 1), (2, 2)}


def test_scramble_is_a_permutation(spark):
    from pyspark.sql import functions as F

    df = spark.range(-500, 500).select((F.col("id") * 9_000_000_000_000_007).alias("x"))
    df = df.select("x", groups.scramble(F.col("x"), 5).alias("y")).select("x", "y", groups.unscramble(F.col("y"), 5).alias("z"))
    assert df.where("x <> z").count() == 0 and df.select("y").distinct().count() == 1000 and df.where("y < 0").count() > 300


def events_of(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, person_id bigint, time double, location bigint, loaded_at timestamp_ntz, place string")


def test_clean_events(spark):
    import datetime as dt

    t = lambda n: dt.datetime(2024, 1, n)
    locations = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 6), (6, 5), (7, 99), (8, None)], "location bigint, alias_of bigint")
    rows = [(1, 1, 1.0, 4, t(1), "x"), (1, 2, 2.0, 8, t(2), "x"), (2, 1, 1.0, 1, t(2), "x"), (2, None, 1.0, 1, t(3), "x"), (3, 1, 5.0, 5, t(1), "x"), (4, 1, 5.0, 7, t(1), "x"), (5, 1, float("nan"), 1, t(1), "x"), (None, 1, 1.0, 1, t(1), "x"), (6, 3, 1.0, 3, None, "x"), (7, 1, 1.0, 1, t(1), "x"), (7, 1, 2.0, 1, t(1), "x")]
    got = {tuple(r) for r in clean_events.clean_events(events_of(spark, rows), locations).select("event_id", "person_id", "time", "place").collect()}
    assert got == {(1, 2, 2.0, 8), (6, 3, 1.0, 1), (7, 1, 2.0, 1)}
    assert clean_events.clean_events(events_of(spark, []), locations).count() == 0


def sequences(spark, seed, persons=30, n=60, places=6, hot=True):
    rng = random.Random(seed)
    rows, k = [], 0
    for p in range(persons):
        t = 0.0
        for _ in range(n * (15 if hot and p == 0 else 1) if p % 3 else n // 4):
            t += rng.choice([0.0, 100.0, 3000.0, 9000.0, 50_000.0])
            rows.append((p, t, k, rng.randrange(places)))
            k += 1
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "person_id bigint, time double, event_id bigint, place bigint")


def brute_patterns(rows, share, window, least, most):
    by = {}
    for p, t, e, x in rows:
        by.setdefault(p, []).append((t, e, x))
    count = Counter()
    for seq in by.values():
        seq.sort()
        have = set()
        for i in range(len(seq)):
            near = [j for j in range(i + 1, len(seq)) if seq[j][0] < seq[i][0] + window]
            for k in range(least - 1, most):
                for c in combinations(near, k):
                    p = (seq[i][2], *(seq[j][2] for j in c))
                    if len(set(p)) == len(p):
                        have.add(p)
        count.update(have)
    return {">".join(map(str, p)): n for p, n in count.items() if n * 100 >= share * 100 * len(by)}


@pytest.mark.parametrize(("seed", "share", "persons", "hot"), [(1, 0.3, 20, True), (2, 0.6, 12, False), (3, 0.05, 10, False)])
def test_frequent_subsequences(spark, seed, share, persons, hot):
    rows, df = sequences(spark, seed, persons, 24, 5, hot)
    old, subsequences.HOT_PERSON = subsequences.HOT_PERSON, 0.2
    try:
        got = {r.pattern: r.persons for r in subsequences.frequent_subsequences(df, share, 15_000.0).collect()}
    finally:
        subsequences.HOT_PERSON = old
    assert got == brute_patterns(rows, share, 15_000.0, 3, 5)


def test_no_sequences(spark):
    df = spark.createDataFrame([], "person_id bigint, time double, event_id bigint, place bigint")
    assert subsequences.frequent_subsequences(df).count() == 0
    one = spark.createDataFrame([(1, 1.0, 1, 5), (1, 1.0, 2, 6), (1, 1.0, 3, 7)], "person_id bigint, time double, event_id bigint, place bigint")
    assert {r.pattern for r in subsequences.frequent_subsequences(one.union(one)).collect()} == {"5>6>7"}


def brute_runs(rows, least):
    out = set()
    by = {}
    for p, t, e, x in rows:
        by.setdefault(p, []).append((t, e, x))
    for p, seq in by.items():
        seq.sort()
        i = 0
        while i < len(seq):
            j = i
            while j + 1 < len(seq) and seq[j + 1][2] == seq[i][2]:
                j += 1
            if j - i + 1 >= least:
                out.add((p, seq[i][2], seq[i][1], seq[j][1], seq[i][0], seq[j][0], j - i + 1))
            i = j + 1
    return out


@pytest.mark.parametrize(("places", "least", "batch"), [(2, 2, 10_000), (3, 1, 7), (1, 2, 7), (2, 1, 1)])
def test_runs(spark, places, least, batch):
    rows, df = sequences(spark, places, 25, 40, places)
    df = df.selectExpr("*", "'clash' as events")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {tuple(r)[:7] for r in runs.collapse_runs(df, least).select("person_id", "place", "first_event_id", "last_event_id", "startTime", "endTime", "events").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == brute_runs(rows, least)
    assert runs.collapse_runs(df.limit(0)).count() == 0


def test_symbols_leave_out_surrogates():
    codes = np.arange(60_000)
    text, owner = runs.symbol_string(codes, np.zeros(60_000, bool))
    assert len(set(text)) == 60_000 and not any(0xD800 <= ord(c) < 0xE000 for c in text) and (owner == codes).all()


@given(st.lists(st.integers(0, 50), max_size=200))
@settings(max_examples=100, deadline=None)
def test_pack(sizes):
    sizes = np.array(sizes, np.int64)
    into, count = packing.pack(sizes, 50)
    assert len(into) == len(sizes) and (len(sizes) == 0 or into.max() < max(count, 1))
    assert (np.bincount(into, sizes, count) <= 50).all()


def test_containers(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "Bär", "niño", "x"]) for _ in range(rng.choice([1, 5, 40, 300]))) for _ in range(300)]
    texts += ["", None, "word " * 5000, texts[0]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (1, "another", "x")], "doc_id bigint, text string, tokens string")
    out = packing.fill_containers(docs, 2048)
    rows = out.collect()
    enc = packing.encoder()
    per, seen = Counter(), Counter()
    for r in rows:
        per[r.container] += r.tokens
        seen[r.doc_id] += r.tokens
    assert max(per.values()) <= 2048 and set(seen) == set(range(len(texts)))
    for i, t in enumerate(texts):
        want = len(enc.encode_ordinary(t)) if t else 0
        assert seen[i] == want + (len(enc.encode_ordinary("another")) if i == 1 else 0)
    parts = Counter(r.doc_id for r in rows)
    assert all(n == 1 for d, n in parts.items() if seen[d] <= 2048 and d != 1) and parts[302] == -(-seen[302] // 2048)
    report = packing.fill_report(out).first()
    assert report.containers <= report.least_containers + 1
    assert len({(r.doc_id, r.part, r.container) for r in packing.fill_containers(docs, 2048, shard_docs=50).collect()}) == len(rows)
    assert packing.fill_containers(docs.limit(0)).count() == 0


def brute_leaks(docs, items):
    out = set()
    for i, t in items:
        w = leaks.words(t)
        n = min(10, len(w))
        wanted = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for d, text in docs:
            v = leaks.words(text)
            if any(tuple(v[k : k + n]) in wanted for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_leaks(spark):
    rng = random.Random(5)
    vocabulary = ["der", "Bär", "ﬁnds", "no", "1", "Straße", "x2", "é", "and", "ÖL"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 9, 10, 11, 25, 60]))) for i in range(40)] + [(90, ""), (91, None), (92, "…!"), (93, "Zebra crossing ahead")]
    docs = [(i, say(rng.choice([0, 5, 30, 200]))) for i in range(60)]
    for i in range(30):
        w = leaks.words(items[i][1])
        at = rng.randrange(max(1, len(w) - 9))
        docs.append((100 + i, say(5) + ", <b>" + "-".join(w[at : at + 10]).upper() + "</b>. " + say(3)))
    docs += [(200, None), (201, ""), (202, "ZEBRA   crössing\tahead"), (203, "zebracrossing ahead"), (204, "word " * 200_000 + "zebra crossing ahead"), (202, "ZEBRA crossing ahead")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, item_id int")
    wanted = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_leaks(docs, items)
    assert (202, 93) in want and (204, 93) in want and (203, 93) not in want
    for size in (leaks.BLOCK_CHARS, 500):
        got = leaks.leaks(frame, wanted, block_chars=size)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert leaks.leaks(frame.limit(0), wanted).count() == 0 and leaks.leaks(frame, wanted.limit(0)).count() == 0


def test_words():
    assert leaks.words("Ｆｕｌｌ-width ½ naïve naïve İ ß x²") == ["full", "width", "1", "2", "naive", "naive", "i", "ss", "x2"]


TERMS = {"science": ["atom", "orbit", "enzyme", "isotope"], "law": ["court", "statute", "verdict", "appeal"], None: ["house", "song", "lamp", "door", "child"]}


def written(rng, subject):
    a, b = rng.sample(TERMS[subject], 2)
    c = rng.choice(TERMS[rng.choice([None, "science", "law"])])
    name = "".join(rng.choice("bdklmnprst") + rng.choice("aeiou") for _ in range(3)).title()
    return rng.choice([f"In {name}, the {a} changes the {b} without the {c}.", f"According to {name}, the {a} finds the {b}.", f"Against the {c}, the {a} likes the {b} again."])


def test_subjects(spark):
    rng = random.Random(6)
    docs, truth, labels = [], {}, []
    for d in range(900):
        kinds = [rng.choice(["science", "law", None]) for _ in range(rng.choice([1, 2, 4]))]
        docs.append((d, " ".join(written(rng, k) for k in kinds), rng.choice(["en", "EN", "eng", "de", None])))
        truth[d] = {k for k in kinds if k}
        if d < 500:
            said = truth[d] if rng.random() > 0.1 else {rng.choice(["science", "law"])}
            labels += [(d, s, "a1") for s in said] or [(d, None, "a1")]
    docs += [(2000, None, "en"), (2001, "", "en"), (2002, "…", "en"), (2003, written(rng, "law") + " filler words" * 50_000, "en")]
    frame = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, lang string, subjects int")
    given_ = spark.createDataFrame(labels, "doc_id bigint, subject string, annotator string")
    model = subjects.fit(frame, given_)
    got = {r.doc_id: set(r.subjects) for r in subjects.document_subjects(frame, model).collect()}
    held = range(500, 900)
    tp = sum(len(got[d] & truth[d]) for d in held)
    precision = tp / max(1, sum(len(got[d]) for d in held))
    recall = tp / sum(len(truth[d]) for d in held)
    assert precision > 0.95 and recall > 0.95, (precision, recall)
    assert got[2000] == got[2001] == got[2002] == set()
    shares = {r.subject: r.documents for r in subjects.composition(subjects.document_subjects(frame, model)).collect()}
    assert shares["none"] == sum(not s for s in got.values())
    nothing = subjects.fit(frame, given_.limit(0))
    assert all(not r.subjects for r in subjects.document_subjects(frame, nothing).collect())
    assert subjects.document_subjects(frame.limit(0), model).count() == 0


def test_language_codes():
    assert [subjects.language_code(x) for x in ("EN", "eng", "de-XX", "fra", None, " es ")] == ["en", "en", "de", "fr", "", "es"]


def test_language_codes_of_a_column(spark):
    codes = ["EN", "eng", "de-XX", "fra", None, " es ", "xx", "q", "", "pt_BR"]
    rows = spark.createDataFrame([(c,) for c in codes], "lang string").select(subjects.language_column("lang")).collect()
    assert [r[0] for r in rows] == [subjects.language_code(c) for c in codes]


def test_subject_models_sum_to_one():
    """Of every context, the ratios of a subject's model times its background are probabilities, and none is below the share that may be borrowed."""
    rng, n, size = np.random.default_rng(3), len(subjects.SUBJECTS), 12
    text = rng.integers(2, size, 400)
    v, w = np.append(1, text[:-1]), text
    given_ = rng.random((400, n + 1))
    one, two = np.zeros((size, n + 1)), np.zeros((size, size, n + 1))
    np.add.at(one, w, given_)
    np.add.at(two, (v, w), given_)
    a, b = np.nonzero(two.sum(2))
    m = subjects._model(np.append(np.full(size - 2, -1), a), np.append(np.arange(2, size), b), np.concatenate([one[2:], two[a, b]]), subjects.Languages(["en"], {f"w{i}": i for i in range(2, size)}, np.zeros((size, 1))))
    prior = lambda c, every, k: (c + k * every) / (c.sum() + k)
    for s in range(n):
        rest = prior(one.sum(1) - one[:, s], one.sum(1) / one.sum(), subjects.UNIGRAM_PRIOR)
        assert np.isclose((np.exp(m.single[:, s]) * rest).sum(), 1, atol=1e-5)
        for context in range(2, size):
            c = two[context]
            back = subjects.BIGRAM * prior(c.sum(1) - c[:, s], c.sum(1) / c.sum(), subjects.BIGRAM_PRIOR) + (1 - subjects.BIGRAM) * rest
            ratio = np.exp(m.single[:, s])
            for x in np.flatnonzero(c.sum(1)):
                ratio[x] = np.exp(m.pair[np.searchsorted(m.keys, context * size + x), s])
            assert np.isclose((ratio * back).sum(), 1, atol=1e-4) and ratio.min() >= subjects.BORROWED - 1e-6


def test_a_language_with_few_labels_is_modelled_with_others(spark):
    rng = random.Random(8)
    docs = [(d, written(rng, "law" if d % 2 else None), "en") for d in range(60)] + [(100 + d, " ".join(rng.choice(["lex", "ius", "domus", "via"]) for _ in range(5)) + ".", rng.choice(["la", "it", "pt"])) for d in range(12)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(d, "law" if d % 2 else None, "a") for d in range(60)] + [(100 + d, "law", "a") for d in range(12)], "doc_id bigint, subject string, annotator string")
    sample = subjects.labelled_sample(frame, labels).mapInArrow(subjects._tokenised, "doc_id bigint, lang string, subjects array<string>, words array<string>, size array<int>")
    assert subjects._languages(sample).codes == ["en", "other"]


def test_null_ids_keep_the_others_exact(spark):
    big = 2**60 + 1
    docs = spark.createDataFrame([(big, "a b"), (None, "c"), (3, None)], "doc_id bigint, text string").coalesce(1)
    items = spark.createDataFrame([(1, "A b"), (None, "c")], "item_id bigint, text string")
    assert {r.doc_id for r in packing.fill_containers(docs).collect()} == {big, None, 3}
    assert {tuple(r) for r in leaks.leaks(docs, items).collect()} == {(big, 1), (None, None)}
    model = subjects.fit(docs, spark.createDataFrame([], "doc_id bigint, subject string, annotator string"))
    assert {r.doc_id for r in subjects.document_subjects(docs, model).collect()} == {big, None, 3}
