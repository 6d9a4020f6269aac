"""Subject area of each document.

Method: one interpolated n-gram language model per subject and one of the background. The tokens are runs of one
script (words, in languages that write them), the models, one set per language, mix bigrams, unigrams and the background. A sentence goes to
the subject under which its per-token cross-entropy lies furthest below the background's, weighed by how much of the
document is about it; a subject is accepted for a document if its sentences make up at least a calibrated share
of the text.

1. All labelled documents give the vocabulary and first models, by EM over their sentences: a sentence of a document
   labelled s is about s or about nothing. Their encoded sentences are written once; a step of the EM is one pass over these.
2. All documents are scored once to re-estimate the models, the background among them, by the sentences' posteriors.
   Only sums over the vocabulary leave a task, in 1 as in 2.
3. All documents are scored with these models; the share from which a subject is accepted is calibrated by F1 on
   the labelled documents, from counts per share.

Defined results: null and empty texts have no subject; labels of unknown documents or subjects are ignored; a null
label says that a document has no subject; with no labels at all nothing is accepted; repeated rows of a document or
label count once; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.evaluation_leaks import RUBY_OR_NOTE
from corpusloom.functions.hashing import Grams, code_points
from corpusloom.runtime import broadcast_if_small, checkpoint

LABELLED_PER_TASK = 1_000  # documents from which on another task takes part in fitting
PACKED = 500  # of them to a written row
MOST_BROADCAST = 1_000_000  # ids of labelled documents up to which they are broadcast
LEAST_DOCS = 2  # labelled documents that a token of the vocabulary occurs in
LEAST_DOCS_PAIR = 5
EM_STEPS = 8
SHARES = [x / 100 for x in range(8, 41)]
DEFAULT_SHARE = 0.2
NOISE = 0.001

#: Characters of a token, a script to a number; ends of sentences are SENTENCE_END, all others 0.
SCRIPTS = ("一-鿿々", "ァ-ヺー", "ぁ-ゖ", "a-zà-öø-ÿœ")
SENTENCE_END = len(SCRIPTS) + 1
WRAPPED = re.compile(r"(?<=[ぁ-ヿ一-鿿、])[ 　]*\n[ 　]*(?=[ぁ-ヿ一-鿿])")
ENDS = "。．.!?！？\n"


def _script_table() -> np.ndarray:
    every = "".join(map(chr, range(0xD800)))
    table = np.zeros(0x10000, np.int8)
    for k, chars in enumerate(SCRIPTS):
        table[[ord(c) for c in re.findall(f"[{chars}]", every)]] = k + 1
    table[[ord(c) for c in ENDS]] = SENTENCE_END
    return table


SCRIPT = _script_table()
#: Frequent words that tell languages of one script apart.
FREQUENT = {"en": "the of and a in to was is that".split(), "fr": "le la les de des et un une du à".split()}


def plain(text: str | None) -> str:
    """Lower case, without ruby readings and notes, lines of one paragraph joined; ends in an end of sentence."""
    if not text:
        return "\n"
    if "《" in text or "＃" in text or "#" in text:
        text = RUBY_OR_NOTE.sub("", text)
    return WRAPPED.sub("", text).lower() + "\n"


class Tokens:
    """The tokens of many texts as arrays: hash (0 for an end of sentence), text and length."""

    def __init__(self, texts: list[str | None]):
        cleaned = [plain(t) for t in texts]
        points = code_points("".join(cleaned))
        sizes = np.fromiter(map(len, cleaned), np.int64, len(cleaned))
        script = SCRIPT[np.minimum(points, 0xFFFF)]
        edge = np.ones(len(script), bool)
        edge[1:] = (script[1:] != script[:-1]) | (script[1:] == SENTENCE_END)
        start = np.flatnonzero(edge)
        length = np.diff(np.append(start, len(script)))
        kept = script[start] > 0
        start, self.length = start[kept], length[kept]
        script = script[start]
        self.hash = np.where(script == SENTENCE_END, np.uint64(0), Grams(points).at(start, self.length) | np.uint64(1))
        self.text = np.searchsorted(np.cumsum(sizes), start, "right")
        self.texts = len(texts)
        # One language per text: by script, then by frequent words.
        n = np.maximum(np.bincount(self.text, script < SENTENCE_END, minlength=self.texts), 1)
        native = np.bincount(self.text, script < 4, minlength=self.texts) * 2 > n
        often = [np.bincount(self.text, np.isin(self.hash, h), minlength=self.texts) for h in FREQUENT_HASHES]
        self.language = np.where(native, 0, 1 + np.argmax(often, axis=0))

    def of(self, texts: np.ndarray) -> Tokens:
        """The tokens of some texts, numbered anew."""
        out = object.__new__(Tokens)
        number = np.full(self.texts, -1)
        number[texts] = np.arange(len(texts))
        inside = number[self.text] >= 0
        out.hash, out.length, out.text = self.hash[inside], self.length[inside], number[self.text[inside]]
        out.texts, out.language = len(texts), self.language[texts]
        return out


def word_hashes(words: list[str]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words])
    return Grams(code_points("".join(words))).at(ends - [len(w) for w in words], np.array([len(w) for w in words])) | np.uint64(1)


FREQUENT_HASHES = [word_hashes(w) for w in FREQUENT.values()]


class Encoded:
    """Sentences of many documents as arrays of vocabulary numbers.

    vocabulary: sorted hashes; pairs: sorted numbers before * words + word.
    """

    def __init__(self, tokens: Tokens, vocabulary: np.ndarray, pairs: np.ndarray):
        at = np.minimum(np.searchsorted(vocabulary, tokens.hash), len(vocabulary) - 1)
        ids = np.where(vocabulary[at] == tokens.hash, at, -1)
        end = tokens.hash == 0
        sentence = np.cumsum(end) - end
        n = int(end.sum())
        self.chars = np.bincount(sentence, np.where(end, 0, tokens.length), minlength=n)
        self.doc, self.docs = tokens.text[end], tokens.texts
        before = np.full(len(ids), -1)
        before[1:] = np.where(end[:-1], -1, ids[:-1])
        inside = ids >= 0
        self.word, self.before, self.sentence = ids[inside], before[inside], sentence[inside]
        key = np.where(self.before >= 0, self.before * len(vocabulary) + self.word, -1)
        at = np.minimum(np.searchsorted(pairs, key), max(len(pairs) - 1, 0))
        self.pair = np.where(pairs[at] == key, at, -1) if len(pairs) else np.full(len(key), -1)

    def small(self) -> Encoded:
        """What the models read, in half the bytes."""
        out = object.__new__(Encoded)
        out.docs = self.docs
        for x in ("chars", "doc", "word", "sentence", "pair"):
            setattr(out, x, getattr(self, x).astype(np.int32))
        return out


class Models:
    """Interpolated bigram models of the classes; the last class is the background."""

    def __init__(self, one: np.ndarray, two: np.ndarray, pairs: np.ndarray):
        total = one.sum(axis=0) + 0.5
        back = total / total.sum()
        size = one.sum(axis=1, keepdims=True)
        strength = 50.0 + 0.02 * size
        p = (one + strength * back) / (size + strength)
        # A token's probability depends on its word alone, or on its pair.
        before, word = np.divmod(pairs, one.shape[1])
        context = one[:, before]
        weight = context / (context + 5.0)
        q = (1 - weight) * p[:, word] + weight * two / np.maximum(context, 1e-9)
        self.logs = np.log(np.maximum(np.concatenate([p, q], axis=1), 1e-12)).T.astype(np.float32)
        self.one, self.two = one, two

    def log_likelihoods(self, e: Encoded) -> np.ndarray:
        """(classes, sentences)."""
        out = np.zeros((len(e.chars), self.logs.shape[1]), np.float64)
        if len(e.word):
            held, first = np.unique(e.sentence, return_index=True)
            out[held] = np.add.reduceat(self.logs[np.where(e.pair >= 0, self.one.shape[1] + e.pair, e.word)], first, axis=0)
        return out.T

    def posteriors(self, e: Encoded, allowed: np.ndarray | None = None, steps: int = 3) -> np.ndarray:
        """(classes, sentences); the mixture of each document is estimated from its own sentences. allowed: (documents, classes)."""
        logs = self.log_likelihoods(e)
        k = len(logs)
        prior = np.full((e.docs, k), 0.5 / max(1, k - 1))
        prior[:, -1] = 0.5
        if allowed is not None:
            prior = prior * allowed
        r = logs
        for _ in range(steps):
            z = logs + np.log(np.maximum(prior[e.doc].T, 1e-9 if allowed is None else 1e-300))
            r = np.exp(z - z.max(axis=0))
            r /= r.sum(axis=0)
            for c in range(k):
                prior[:, c] = np.bincount(e.doc, r[c], minlength=e.docs) + (0.3 / k if allowed is None else 0.3 * allowed[:, c])
            prior /= np.maximum(prior.sum(axis=1, keepdims=True), 1e-300)
        return r

    @staticmethod
    def counted(e: Encoded, r: np.ndarray, words: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected counts of words and pairs per class; the background has what the subjects leave."""
        one, two = np.zeros((len(r), words)), np.zeros((len(r), pairs))
        every = np.bincount(e.word, minlength=words), np.bincount(e.pair[e.pair >= 0], minlength=pairs)
        for c, x in enumerate(r[:-1]):
            at = np.flatnonzero((x > 1e-3)[e.sentence])
            known = at[e.pair[at] >= 0]
            one[c] = np.bincount(e.word[at], x[e.sentence[at]], minlength=words)
            two[c] = np.bincount(e.pair[known], x[e.sentence[known]], minlength=pairs)
        one[-1], two[-1] = np.maximum(every[0] - one.sum(axis=0), 0), np.maximum(every[1] - two.sum(axis=0), 0)
        return one, two


def _documents_of(texts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values, and how many texts each occurs in."""
    found, at = np.unique(values, return_inverse=True)
    both = np.unique(at.astype(np.int64) * (int(texts.max(initial=0)) + 1) + texts)
    return found, np.bincount(both // (int(texts.max(initial=0)) + 1), minlength=len(found))


def _shares(e: Encoded, r: np.ndarray) -> np.ndarray:
    """(documents, subjects): the part of the characters in sentences about each subject."""
    total = np.maximum(np.bincount(e.doc, e.chars, minlength=e.docs), 1)
    return np.stack([np.bincount(e.doc, e.chars * x, minlength=e.docs) / total for x in r[:-1]], axis=1)


#: Of each language: models (none before the first), vocabulary, pairs.
Fitted = dict[int, tuple[Models | None, np.ndarray, np.ndarray]]


def _by_language(texts: list[str | None], fitted: Fitted) -> Iterator[tuple[int, np.ndarray, Encoded]]:
    """(language, numbers of its texts, their sentences) of the languages that have a vocabulary."""
    tokens = Tokens(texts)
    for name, (_, vocabulary, pairs) in fitted.items():
        at = np.flatnonzero(tokens.language == name)
        if len(at):
            yield name, at, Encoded(tokens.of(at), vocabulary, pairs)


def _token_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        tokens = Tokens(pdf["text"].tolist())
        for name in np.unique(tokens.language):
            at = (tokens.hash != 0) & (tokens.language[tokens.text] == name)
            found, n = _documents_of(tokens.text[at], tokens.hash[at])
            yield pd.DataFrame({"language": name, "value": found.view(np.int64), "n": n})


def _pair_documents(batches: Iterator[pd.DataFrame], fitted: Fitted) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for name, _, e in _by_language(pdf["text"].tolist(), fitted):
            two = e.before >= 0
            found, n = _documents_of(e.doc[e.sentence[two]], (e.before * len(fitted[name][1]) + e.word)[two])
            yield pd.DataFrame({"language": name, "value": found, "n": n})


def _often(counted: DataFrame, least: int) -> dict[int, np.ndarray]:
    """The values of each language that occur in so many documents."""
    rows = counted.groupBy("language", "value").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("language", "value").toArrow()
    language, value = rows["language"].to_numpy(), rows["value"].to_numpy()
    return {int(x): value[language == x] for x in np.unique(language)}


def vocabulary_of(docs: DataFrame) -> Fitted:
    """Of each language the tokens of LEAST_DOCS documents and the pairs of LEAST_DOCS_PAIR; docs has a row per document."""
    counts = "language long, value long, n long"
    words = _often(docs.select("text").mapInPandas(_token_documents, counts), LEAST_DOCS)
    fitted: Fitted = {name: (None, np.sort(found.view(np.uint64)), np.zeros(0, np.int64)) for name, found in words.items()}
    if fitted:
        shared = docs.sparkSession.sparkContext.broadcast(fitted)
        pairs = _often(docs.select("text").mapInPandas(lambda it: _pair_documents(it, shared.value), counts), LEAST_DOCS_PAIR)
        fitted = {name: (None, vocabulary, np.sort(pairs.get(name, none))) for name, (_, vocabulary, none) in fitted.items()}
    return fitted


#: Sentences of one language and, if their documents are labelled, the classes that these may be about.
Sentences = tuple[int, Encoded, np.ndarray | None]


def _packed(batches: Iterator[pd.DataFrame], fitted: Fitted, names: list[str]) -> Iterator[pd.DataFrame]:
    """Sentences of labelled documents (marked: their subjects), which are about these or about nothing; PACKED documents to a row."""
    number = {x: k for k, x in enumerate(names)}
    for pdf in batches:
        for start in range(0, len(pdf), PACKED):
            part = pdf.iloc[start : start + PACKED]
            allowed = np.zeros((len(part), len(names) + 1))
            allowed[:, -1] = 1
            for d, marked in enumerate(part["marked"]):
                allowed[d, [number[x] for x in marked if x in number]] = 1
            rows = [(name, zlib.compress(pickle.dumps((e.small(), allowed[of])), 1)) for name, of, e in _by_language(part["text"].tolist(), fitted)]
            yield pd.DataFrame(rows, columns=["language", "sentences"])


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[Sentences]:
    for pdf in batches:
        for name, packed in zip(pdf["language"], pdf["sentences"]):
            yield name, *pickle.loads(zlib.decompress(packed))


def _of_texts(batches: Iterator[pd.DataFrame], fitted: Fitted) -> Iterator[Sentences]:
    for pdf in batches:
        for name, _, e in _by_language(pdf["text"].tolist(), fitted):
            yield name, e, None


def _recount(sentences: Iterator[Sentences], fitted: Fitted, classes: int) -> Iterator[pd.DataFrame]:
    """Expected counts; before there are models, all allowed classes are equally likely."""
    sums = {name: [np.zeros((classes, len(vocabulary))), np.zeros((classes, len(pairs)))] for name, (_, vocabulary, pairs) in fitted.items()}
    for name, e, allowed in sentences:
        models, vocabulary, pairs = fitted[name]
        r = (allowed / allowed.sum(axis=1, keepdims=True))[e.doc].T if models is None else models.posteriors(e, allowed)
        for total, more in zip(sums[name], Models.counted(e, r, len(vocabulary), len(pairs))):
            total += more
    for name, (one, two) in sums.items():
        both = np.concatenate([one, two], axis=1)
        c, at = np.nonzero(both)
        yield pd.DataFrame({"language": name, "class": c, "feature": at, "n": both[c, at]})


def _refitted(rows: DataFrame, fitted: Fitted, classes: int, packed: bool) -> Fitted:
    """The models of the expected counts under the present ones: one pass over rows, of packed sentences or of texts."""
    shared = rows.sparkSession.sparkContext.broadcast(fitted)
    counted = rows.mapInPandas(lambda it: _recount(_unpacked(it) if packed else _of_texts(it, shared.value), shared.value, classes), "language int, class int, feature int, n double")
    sums = counted.groupBy("language", "class", "feature").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    language, c, feature, n = (sums[x].to_numpy() for x in ("language", "class", "feature", "n"))
    again: Fitted = {}
    for name, (_, vocabulary, pairs) in fitted.items():
        both, own = np.zeros((classes, len(vocabulary) + len(pairs))), language == name
        both[c[own], feature[own]] = n[own]
        again[name] = (Models(both[:, : len(vocabulary)], both[:, len(vocabulary) :], pairs), vocabulary, pairs)
    return again


def _score(batches: Iterator[pd.DataFrame], fitted: Fitted, names: list[str]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for name, of, e in _by_language(pdf["text"].tolist(), fitted):
            shares = _shares(e, fitted[name][0].posteriors(e))
            d, c = np.nonzero(shares >= SHARES[0])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[of[d]], "subject": np.array(names, object)[c], "share": shares[d, c]})


def _best_share(scored: DataFrame, truth: DataFrame) -> float:
    """The middle of the shares whose F1 on the labelled documents is within NOISE of the best (some labels are wrong).

    scored: (doc_id, subject, share) of the labelled documents, truth: (doc_id, subject), a row each.
    """
    true = truth.count()
    if not true:
        return DEFAULT_SHARE
    best = scored.groupBy("doc_id", "subject").agg(F.max("share").alias("share")).join(truth.withColumn("hit", F.lit(1)), ["doc_id", "subject"], "left")
    passed = F.size(F.filter(F.array(*map(F.lit, SHARES)), lambda x: x <= F.col("share")))
    counts = best.groupBy(passed.alias("passed")).agg(F.count("*").alias("found"), F.count("hit").alias("hits")).collect()
    quality = [2 * sum(r["hits"] for r in counts if r["passed"] > k) / (sum(r["found"] for r in counts if r["passed"] > k) + true) for k in range(len(SHARES))]
    good = [x for x, q in zip(SHARES, quality) if q >= max(quality) - NOISE]
    return good[len(good) // 2]


EMPTY = "doc_id long, subject string, share double"


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, marked): all documents with a label, a row each, and their labels; written, in tasks of LABELLED_PER_TASK or as many as there are cores."""
    marks = checkpoint(labels.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("marked")))
    texts = docs.join(broadcast_if_small(marks.select("doc_id"), MOST_BROADCAST), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    tasks = min(marks.count() // LABELLED_PER_TASK + 1, docs.sparkSession.sparkContext.defaultParallelism)
    return checkpoint(texts.join(marks, "doc_id").repartition(tasks, "doc_id"))


def scored_subjects(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(doc_id, subject, share) of all documents, and the accepting share."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    names = sorted(r[0] for r in subjects.select("subject").where("subject is not null").distinct().collect())
    if not names:
        return spark.createDataFrame([], EMPTY), DEFAULT_SHARE
    labelled = labelled_documents(docs, labels)
    fitted = vocabulary_of(labelled)
    if not fitted:
        return spark.createDataFrame([], EMPTY), DEFAULT_SHARE
    first = spark.sparkContext.broadcast(fitted)
    packed = checkpoint(labelled.select("text", "marked").mapInPandas(lambda it: _packed(it, first.value, names), "language int, sentences binary"))
    for _ in range(1 + EM_STEPS):
        fitted = _refitted(packed, fitted, len(names) + 1, True)
    final = spark.sparkContext.broadcast(_refitted(docs.select("text"), fitted, len(names) + 1, False))
    scored = checkpoint(docs.mapInPandas(lambda it: _score(it, final.value, names), EMPTY))
    known = scored.join(broadcast_if_small(labelled.select("doc_id"), MOST_BROADCAST), "doc_id", "left_semi")
    truth = labelled.select("doc_id", F.explode("marked").alias("subject")).where(F.col("subject").isin(names))
    return scored, _best_share(known, truth)


def subjects_of_documents(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject) of every accepted subject."""
    scored, least = scored_subjects(documents, subjects, labels)
    return scored.where(F.col("share") >= least).select("doc_id", "subject").distinct()


def composition(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """(subject, documents, characters): how many documents are about a subject, and the characters of their sentences about it."""
    scored, least = scored_subjects(documents, subjects, labels)
    kept = scored.where(F.col("share") >= least).distinct().join(documents.select("doc_id", F.length("text").alias("chars")).distinct(), "doc_id")
    return kept.groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"), F.round(F.sum(F.col("share") * F.col("chars"))).cast("long").alias("characters"))
