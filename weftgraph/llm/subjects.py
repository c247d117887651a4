"""Subject areas of documents: interpolated n-gram language models against a background model."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import drop, rows_of, spill

#: The subjects of the hand labels (fixed values).
SUBJECTS = ["science", "law", "sport", "software", "medicine", "finance", "cooking", "travel"]
#: Labelled documents that the models are fitted on at most; beyond it those of smallest hashed id are taken.
LABELLED_DOCS = 20_000
#: A word seen less often in the sample is the unknown word.
LEAST_COUNT = 3
#: Weight of the bigram in the models, the rest being the unigram's.
BIGRAM = 0.1
#: Prior of a subject's unigram and bigram estimates, in words at the background's rates.
UNIGRAM_PRIOR, BIGRAM_PRIOR = 1000.0, 50.0
#: Weight of the background in a subject's model: the share of a sentence's words that may be borrowed from elsewhere.
BORROWED = 0.2
#: Evidence (nats a sentence) from which a sentence is taken as of a labelled subject while fitting, and of one that is not labelled.
FIT_EVIDENCE, FREE_EVIDENCE = 0.0, 5.0
ROUNDS = 3
#: One labelled document in so many is held out of the models and calibrates them.
HELD_OUT = 3
#: Weight of all subjects' results in the calibration of each.
POOLED = 0.1
#: Nats by which the words of a sentence must each exceed the background, as tried in the calibration; and the nats a sentence besides.
SLOPES, MARGINS = (0.0, 0.05, 0.1, 0.15), np.arange(0.1, 10.01, 0.1)
#: Three-letter language codes and their two-letter forms (fixed values).
LANGUAGE_CODES = {"deu": "de", "eng": "en", "fra": "fr", "fre": "fr", "ger": "de", "spa": "es"}
#: Labelled documents from which a claimed language is modelled; others are modelled together, if they have as many.
LEAST_DOCS = 10
_TAG = re.compile(r"</?[a-z][^<>]*>", re.I)
_END = re.compile(r"(?<=[.!?。])[\"'”»)]*\s+|[\r\n]+")
_TOKEN = re.compile(r"[^\W_]+")


def repaired(text: str) -> str:
    """Compatibility form of a text, with UTF-8 that was read as a one-byte code put right where it is whole."""
    for code in ("cp1252", "latin-1"):
        if any(c in text for c in "ÃÂâ"):
            try:
                text = text.encode(code).decode("utf-8")
            except UnicodeError:
                continue
    return unicodedata.normalize("NFKC", text)


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence, without case and accents, numbers as one word; markup is no text."""
    if not text:
        return []
    out = []
    for part in _END.split(_TAG.sub(" ", repaired(text))):
        plain = unicodedata.normalize("NFKD", part.casefold())
        found = _TOKEN.findall("".join(c for c in plain if not unicodedata.combining(c)))
        if found:
            out.append(["0" if w.isdigit() else w for w in found])
    return out


def language_code(claimed: str | None) -> str:
    """Two-letter form of a language code written in one of the usual ways; empty for none."""
    code = re.split(r"[-_]", claimed.strip().lower())[0] if isinstance(claimed, str) else ""
    return LANGUAGE_CODES.get(code, code[:2])


def language_column(claimed: str) -> Column:
    """:func:`language_code` of a column, in built-in functions."""
    code = F.split(F.lower(F.trim(F.coalesce(claimed, F.lit("")))), "[-_]")[0]
    known = F.create_map(*(F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair))
    return F.coalesce(known[code], F.substring(code, 1, 2))


@dataclass
class Languages:
    """Unigram model of each language. Claimed languages are often wrong, so a text's language is the likeliest by its words."""

    codes: list[str]
    words: dict[str, int]
    score: np.ndarray

    def of(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.score[ids], begin, axis=0).argmax(1)


@dataclass
class Model:
    """Logarithms of each subject's model over the background's, within a language: of single words, and of words after the word before for all pairs known.

    Calibrated acceptance: a sentence of n words is accepted for a subject if its cross-entropy a word under the background exceeds that under the
    subject by ``slope + margin / n``. A word of language k has number ``id * languages + k``.
    """

    languages: Languages
    single: np.ndarray
    keys: np.ndarray
    pair: np.ndarray
    slope: float = 0.0
    margin: np.ndarray | None = None

    def difference(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each sentence of all texts: number of its text, number of words, and cross-entropy a word under the background less that under each subject."""
        return self.difference_of(*encode(texts, self.languages))

    def difference_of(self, owner: np.ndarray, ids: np.ndarray, begin: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`difference` of encoded sentences."""
        if not len(owner):
            return owner, np.zeros(0, np.int64), np.zeros((0, len(SUBJECTS)))
        value = self.single[ids]
        if len(self.keys):
            key = before.astype(np.int64) * len(self.single) + ids
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            value[known] = self.pair[at[known]]
        size = np.diff(np.append(begin, len(ids)))
        return owner, size, np.add.reduceat(value, begin, axis=0) / size[:, None]

    def surplus(self, size: np.ndarray, difference: np.ndarray, slope: float | None = None) -> np.ndarray:
        """Nats of a sentence above the slope; it is accepted from the margin on."""
        return (difference - (self.slope if slope is None else slope)) * size[:, None]


def encode(texts: list[str | None], languages: Languages) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences as numbers: text of each sentence, numbers of all words, first word of each sentence, word before each word.

    Number 0 times the languages is the unknown word, 1 the start of a sentence.
    """
    owner, tokens = [], []
    for k, text in enumerate(texts):
        for s in sentences(text):
            owner.append(k)
            tokens.append(s)
    return _numbered(np.array(owner, np.int64), np.array([len(s) for s in tokens], np.int64), [w for s in tokens for w in s], languages)


def _numbered(owner: np.ndarray, size: np.ndarray, words: list[str], languages: Languages) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if not len(owner):
        return (np.zeros(0, np.int64),) * 4
    begin = np.cumsum(size) - size
    known = languages.words
    ids = np.array([known.get(w, 0) for w in words])
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    tongue = languages.of(ids, begin[first])
    of = np.repeat(np.repeat(tongue, np.diff(np.append(first, len(owner)))), size)
    width = len(languages.codes)
    return owner, ids * width + of, begin, _before(ids, begin) * width + of


def _before(ids: np.ndarray, begin: np.ndarray, start: int = 1) -> np.ndarray:
    before = np.roll(ids, 1)
    before[begin] = start
    return before


def _lists(batch: pa.RecordBatch, name: str) -> tuple[pa.Array, np.ndarray]:
    column = batch.column(name)
    return column.flatten(), np.diff(column.offsets.to_numpy())


def _stored(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences as :func:`encode` gives them, from their written form."""
    ids, _ = _lists(batch, "ids")
    size, per = _lists(batch, "size")
    ids, size = ids.to_numpy(zero_copy_only=False).astype(np.int64), size.to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(size) - size
    before = np.roll(ids, 1)
    before[begin] = width + ids[begin] % width
    return np.repeat(np.arange(len(per)), per), ids, begin, before


def _count(batches, width: int, model: Model | None, free: bool):
    """Counts of words (v = -1) and pairs over labelled documents: v, w, then one count a subject and that of sentences without."""
    n = len(SUBJECTS)
    for batch in batches:
        if not batch.num_rows:
            continue
        labels = [[SUBJECTS.index(s) for s in x if s in SUBJECTS] for x in batch.column("subjects").to_pylist()]
        owner, ids, begin, before = _stored(batch, width)
        if not len(ids):
            continue
        share = np.zeros((len(owner), n + 1))
        allowed = np.full((len(labels), n), -np.inf if model is None or not free else FIT_EVIDENCE - FREE_EVIDENCE)
        for k, x in enumerate(labels):
            allowed[k, x] = 0.0
        if model is None:
            named = np.isfinite(allowed)[owner]
            share[:, :n] = named / np.maximum(1, named.sum(1, keepdims=True))
            share[:, n] = ~named.any(1)
        else:
            _, size, difference = model.difference_of(owner, ids, begin, before)
            evidence = difference * size[:, None] + allowed[owner]
            best = evidence.argmax(1)
            share[np.arange(len(owner)), np.where(evidence.max(1) >= FIT_EVIDENCE, best, n)] = 1
        weight = np.repeat(share, np.diff(np.append(begin, len(ids))), axis=0)
        keys, at = np.unique(np.concatenate([-1 - ids, before * (1 << 31) + ids]), return_inverse=True)
        total = np.stack([np.bincount(at, np.concatenate([weight[:, c]] * 2), len(keys)) for c in range(n + 1)], axis=1)
        single = keys < 0
        v, w = np.where(single, -1, keys >> 31), np.where(single, -1 - keys, keys & ((1 << 31) - 1))
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(w), *(pa.array(total[:, c]) for c in range(n + 1))], names=["v", "w", *(f"c{c}" for c in range(n + 1))])


def _model(v: np.ndarray, w: np.ndarray, count: np.ndarray, languages: Languages) -> Model:
    """The interpolated models, as ratios. ``count`` has a column a subject and one for the rest.

    A subject's background is all other sentences. Both are P(w|v) = BIGRAM * P2(w|v) + (1 - BIGRAM) * P1(w), where P1 and P2 are shares of the counts with those of all
    sentences together as a prior. The subject's model is then mixed with its background, which has the weight BORROWED. So each sums to one
    over the words, and no word counts more than -log(BORROWED) against a subject. A pair never seen has the ratio of its word alone.
    """
    n, width = len(SUBJECTS), len(languages.codes)
    size = (len(languages.words) + 2) * width
    tongue = np.arange(size) % width
    alone = v < 0
    uni = np.zeros((size, n + 1))
    uni[w[alone]] = count[alone]
    total = np.zeros((width, n + 1))
    np.add.at(total, tongue, uni)
    one, rest = _shares(uni, total[tongue], uni.sum(1) / np.maximum(total.sum(1), 1e-9)[tongue], UNIGRAM_PRIOR)
    v, w, count = v[~alone], w[~alone], count[~alone]
    context = np.zeros((size, n + 1))
    np.add.at(context, v, count)
    two, rest_two = _shares(count, context[v], count.sum(1) / context[v].sum(1), BIGRAM_PRIOR)
    pair = (BIGRAM * two + (1 - BIGRAM) * one[w]) / (BIGRAM * rest_two + (1 - BIGRAM) * rest[w])
    single = np.divide(one, rest, out=np.ones_like(one), where=rest > 0)
    mixed = lambda ratio: np.log((1 - BORROWED) * ratio + BORROWED).astype(np.float32)
    keys = v * size + w
    order = np.argsort(keys)
    return Model(languages, mixed(single), keys[order], mixed(pair[order]))


def _shares(count: np.ndarray, total: np.ndarray, every: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares under each subject and under all but it, with the shares of all as a prior."""
    n = len(SUBJECTS)
    rest, whole = count.sum(1, keepdims=True) - count[:, :n], total.sum(1, keepdims=True) - total[:, :n]
    return (count[:, :n] + prior * every[:, None]) / (total[:, :n] + prior), (np.maximum(rest, 0) + prior * every[:, None]) / (np.maximum(whole, 0) + prior)


def _best(owner: np.ndarray, surplus: np.ndarray, n: int) -> np.ndarray:
    best = np.full((n, len(SUBJECTS)), -np.inf)
    np.maximum.at(best, owner, surplus)
    return best


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = LABELLED_DOCS) -> DataFrame:
    """doc_id, text, lang, subjects of labelled documents: those named by at least half of a document's annotators. Of a repeated doc_id the least text counts."""
    votes = labels.where("doc_id is not null").groupBy("doc_id", "subject").agg(F.count_distinct(F.coalesce("annotator", F.lit(""))).alias("n"))
    people = labels.where("doc_id is not null").groupBy("doc_id").agg(F.count_distinct(F.coalesce("annotator", F.lit(""))).alias("all"))
    chosen = people.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    named = votes.join(chosen, "doc_id").where("n * 2 >= all").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    lang = language_column("lang") if "lang" in docs.columns else F.lit("")
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text", *(["lang"] if "lang" in docs.columns else [])).join(F.broadcast(named), "doc_id")
    least = texts.groupBy("doc_id").agg(F.min(F.struct("text", lang.alias("lang"), "subjects")).alias("d"))
    return least.select("doc_id", "d.*")


def _tokenised(batches):
    """The words of each text and the sizes of its sentences."""
    for batch in batches:
        each = [sentences(t) for t in batch.column("text").to_pylist()]
        words = pa.array([[w for s in x for w in s] for x in each], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("subjects"), words, pa.array([[len(s) for s in x] for x in each], pa.list_(pa.int32()))], names=["doc_id", "lang", "subjects", "words", "size"])


def _languages(sample: DataFrame) -> Languages:
    """Languages with enough documents of their own, and the vocabulary with its counts in each."""
    share = sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    codes = sorted(r.lang for r in share if r.n >= LEAST_DOCS and r.lang)
    rest = sum(r.n for r in share if r.lang and r.lang not in codes)
    column = F.when(F.col("lang").isin(codes), F.col("lang")) if codes else F.lit(None)
    if rest >= LEAST_DOCS or not codes:  # all others in one
        column = F.coalesce(column, F.when((F.col("lang") != "") | F.lit(not codes), F.lit("other")))
        codes = [*codes, "other"]
    counted = sample.select(column.alias("lang"), F.explode("words").alias("w")).where("lang is not null").groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    pdf = counted.groupBy("w").pivot("lang", codes).agg(F.sum("n")).fillna(0).toPandas()
    pdf = pdf[pdf[codes].sum(axis=1) >= LEAST_COUNT].sort_values("w")
    count = pdf[codes].to_numpy().astype(float)
    score = np.zeros((len(pdf) + 2, len(codes)))
    score[2:] = np.log((count + 0.5) / (count.sum(0) + 0.5 * max(1, len(pdf))))
    return Languages(codes, {w: i + 2 for i, w in enumerate(pdf["w"])}, score)


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED_DOCS) -> Model:
    """Fit the models on a bounded sample of labelled documents, and calibrate them on a third of it that they have not seen.

    Texts are cut into words once and kept as numbers. Round by round, each sentence of the documents fitted on is given to the one labelled subject it has most evidence
    for, or to none, and the models are counted anew; in the last rounds strong evidence outweighs a missing label.
    What is accepted is set for each subject where the held-out documents' labels agree best (F1); then all documents are counted once more. Without labels nothing is accepted.
    All words and pairs of the sample are counted; the sample's size bounds what the driver and the workers hold.
    """
    n = len(SUBJECTS)
    spark = docs.sparkSession
    cut = labelled_sample(docs, labels, most).repartition(max(2, spark.sparkContext.defaultParallelism), "doc_id")
    words = spill(cut.mapInArrow(_tokenised, "doc_id bigint, lang string, subjects array<string>, words array<string>, size array<int>"))
    languages = _languages(words)
    width = len(languages.codes)
    vocabulary = spark.sparkContext.broadcast(languages)

    def numbered(batches):
        for batch in batches:
            flat, _ = _lists(batch, "words")
            size, per = _lists(batch, "size")
            _, ids, _, _ = _numbered(np.repeat(np.arange(len(per)), per), size.to_numpy(zero_copy_only=False).astype(np.int64), flat.to_pylist(), vocabulary.value)
            column = pa.ListArray.from_arrays(batch.column("words").offsets.cast(pa.int32()) if not batch.column("words").offset else pa.array(np.append(0, np.cumsum(_lists(batch, "words")[1])), pa.int32()), pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("subjects"), column, batch.column("size")], names=["doc_id", "subjects", "ids", "size"])

    sample = spill(words.mapInArrow(numbered, "doc_id bigint, subjects array<string>, ids array<bigint>, size array<int>"))
    drop(words)
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(HELD_OUT)) == 0
    fitted, kept = sample.where(~held).select("subjects", "ids", "size"), sample.where(held).select("subjects", "ids", "size")
    cols = [f"c{i}" for i in range(n + 1)]
    schema = "v bigint, w bigint, " + ", ".join(f"{c} double" for c in cols)

    def recounted(rows: DataFrame, model: Model | None, free: bool) -> Model:
        shared = spark.sparkContext.broadcast(model)
        counted = rows.mapInArrow(lambda b: _count(b, width, shared.value, free), schema).groupBy("v", "w").agg(*(F.sum(c).alias(c) for c in cols)).toPandas()
        return _model(counted["v"].to_numpy(), counted["w"].to_numpy(), counted[cols].to_numpy(), languages)

    model: Model | None = None
    for k in range(ROUNDS + 1):
        model = recounted(fitted, model, k >= 2)
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            owner, size, difference = shared.value.difference_of(*_stored(batch, width))
            rows = [_best(owner, shared.value.surplus(size, difference, a), batch.num_rows) for a in SLOPES]
            flat = np.nan_to_num(np.concatenate(rows, axis=1), neginf=-1e9)
            yield pa.RecordBatch.from_arrays([batch.column("subjects"), pa.array(list(flat), pa.list_(pa.float64()))], names=["subjects", "best"])

    scored = kept.mapInArrow(score, "subjects array<string>, best array<double>").toPandas()
    slope, margin = _calibrated(scored)
    model = recounted(sample.select("subjects", "ids", "size"), model, True)
    drop(sample)
    model.slope, model.margin = slope, margin
    return model


def _calibrated(scored: pd.DataFrame) -> tuple[float, np.ndarray]:
    """The slope with the best F1 over all subjects, and the margin of each subject: the middle of the range in which its F1 is within 0.5 % of its best,
    the counts of all subjects being added to its own with the weight ``POOLED``, since a subject may have few documents held out."""
    if not len(scored):
        return 0.0, np.full(len(SUBJECTS), np.inf)
    n = len(SUBJECTS)
    best = np.stack(scored["best"].to_numpy()).reshape(len(scored), len(SLOPES), n)
    truth = np.array([[s in x for s in SUBJECTS] for x in scored["subjects"]])
    f1 = np.zeros((len(SLOPES), len(MARGINS), n))
    for a in range(len(SLOPES)):
        for m, margin in enumerate(MARGINS):
            said = best[:, a] >= margin
            both, sums = (said & truth).sum(0), said.sum(0) + truth.sum(0)
            f1[a, m] = 2 * (both + POOLED * both.sum()) / np.maximum(1e-9, sums + POOLED * sums.sum())
    top = int(f1.mean(2).max(1).argmax())
    margin = [float(np.median(MARGINS[f1[top, :, s] >= f1[top, :, s].max() - 0.005])) for s in range(n)]
    return SLOPES[top], np.array(margin)


def document_subjects(docs: DataFrame, model: Model) -> DataFrame:
    """Subjects of every document: doc_id, subjects (an array, empty for none), evidence (nats) of the best sentence for each.

    A document has every subject that one of its sentences is accepted for. Null and empty texts have none; repeated rows
    come out as often; whole texts are read, in one pass without a shuffle. Extra columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            owner, size, difference = m.difference(batch.column(1).to_pylist())
            best = _best(owner, m.surplus(size, difference), batch.num_rows)
            said = best >= m.margin
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([[SUBJECTS[i] for i in np.flatnonzero(r)] for r in said], pa.list_(pa.string())),
                pa.array([b[r].tolist() for b, r in zip(best, said)], pa.list_(pa.float64())),
            ], names=["doc_id", "subjects", "evidence"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id bigint, subjects array<string>, evidence array<double>")


def composition(found: DataFrame) -> DataFrame:
    """Share of documents of each subject, and of none: subject, documents, share. Over distinct doc_id."""
    per = spill(found.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("subjects"))).alias("subjects")))
    named = per.select(F.explode(F.when(F.size("subjects") > 0, F.col("subjects")).otherwise(F.array(F.lit("none")))).alias("subject"))
    total = max(1, rows_of(per))
    return named.groupBy("subject").agg(F.count(F.lit(1)).alias("documents")).withColumn("share", F.col("documents") / total)
