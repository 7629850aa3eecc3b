"""Toxicity by a gap-weighted subsequence-kernel SVM over Nystrom landmarks, trained on sentences.

The kernel of two words (Lodhi et al., "Text Classification using String Kernels")
counts common subsequences of ORDER letters, each occurrence weighed by DECAY to the
power of the letters it spans, and is normalised; so "id-xiot" is still close to
"idiot".  A word's start and end are letters too.  Occurrences that span more than
MAX_SPAN letters are left out; such a pair of occurrences weighs at most
DECAY ** (2 * MAX_SPAN + 2) before normalising, 6 % of a pair without gaps.

A sentence is as toxic as its most toxic word (a set kernel's maximum).  Only documents
carry labels, so a toxic document is a bag of sentences of which one at least is toxic
(multiple-instance learning): a linear SVM over the kernels with a few landmark words
(Nystrom) is trained on sentences of clean documents, and on those of toxic documents that
the machine of the round before holds for toxic, at least the most toxic one of each.  Every
feature is a weighted sum of kernels, so the machine folds into one weight per letter
triple, which scoring looks up.  A document's score is the calibrated margin of its most
toxic sentences.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridscope import ship
from gridscope.llm import scratch
from gridscope.llm.sampling import bounded_sample

ORDER = 3
DECAY = 0.7
#: Longest stretch of letters a subsequence may span.
MAX_SPAN = 6
LANDMARKS = 200
#: Labelled rows that training reads at most, those with the smallest hashes of their ids, and the bytes of their
#: whole texts together: rows go from the end of that order until they fit.
SAMPLE_ROWS = 6_000
SAMPLE_BYTES = 24_000_000
#: Words whose margins a process remembers.
MEMORY_WORDS = 200_000
#: Longer tokens are scored by overlapping pieces of this many letters.
PIECE = 16
#: Rounds of choosing the toxic documents' sentences anew, and clean sentences in each: the machine's hardest and some of all.
ROUNDS, CLEAN_SENTENCES = 4, 16_000
#: Sentences whose margins the calibration weighs: a document's most toxic ones.
TOPS = 3
THRESHOLD = 0.7

# Digits and signs that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

#: a-z are 0 to 25, other letters are numbered from there by code point, a word's start and end last.
ALPHABET, START, END = 64, 62, 63
_SIGNS = re.compile(r"[013457@$!]")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_ENDS = re.compile(r"^[^\w@$]+|[^\w@$]+$")


def sentences(text: str | None) -> list[list[str]]:
    """The sentences of a whole text as words of letters: lower case, signs inside dropped, spelled-out words joined.

    A sentence ends with a line and at a token that ends in . ! or ?.
    """
    out: list[list[str]] = []
    for line in (text or "").lower().splitlines():
        words, spelled = [], []
        for token in line.split():
            last = token[-1] in ".!?"
            if not token.isalpha():
                if _SIGNS.search(token) and any(map(str.isalpha, token)):
                    token = _ENDS.sub("", token).translate(LEET)
                token = _NOT_LETTER.sub("", token)
            if len(token) == 1:
                spelled.append(token)
            elif token:
                if len(spelled) > 2:
                    words += _pieces("".join(spelled))
                spelled = []
                words += [token] if len(token) <= PIECE else _pieces(token)
            if last:
                if len(spelled) > 2:
                    words += _pieces("".join(spelled))
                if words:
                    out.append(words)
                words, spelled = [], []
        if len(spelled) > 2:
            words += _pieces("".join(spelled))
        if words:
            out.append(words)
    return out


def _pieces(letters: str) -> list[str]:
    return [letters[i : i + PIECE] for i in range(0, max(1, len(letters) - PIECE // 2), PIECE // 2)]


def _letters(words: list[str], length: int) -> np.ndarray:
    """Numbers of the words' letters, START before and END behind them."""
    code = np.array(["".join(words)]).view(np.int32).reshape(len(words), length)
    code = np.where((code >= 97) & (code <= 122), code - 97, 26 + code % (START - 26))
    return np.pad(code, ((0, 0), (1, 1)), constant_values=((0, 0), (START, END)))


def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all subsequences of ORDER letters within MAX_SPAN, and their weights."""
    at = [c for c in combinations(range(length), ORDER) if c[-1] - c[0] < MAX_SPAN]
    at = np.array(at, np.int64).reshape(-1, ORDER)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)


def subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which words, their triples' codes, the triples' weights over the norm), for words of one length at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths[lengths >= ORDER]).tolist():
        where = np.flatnonzero(lengths == length)
        at, weight = _triples(length + 2)
        span = (at[:, -1] - at[:, 0]).astype(np.int32)
        by_span = np.zeros(8, np.float32)
        by_span[span] = weight
        for some in np.array_split(where, -(-len(where) // 4_000)):
            c = _letters([words[i] for i in some], length)
            code = ((c[:, at[:, 0]] * ALPHABET + c[:, at[:, 1]]) * ALPHABET + c[:, at[:, 2]]) * 8 + span
            code.sort(axis=1)
            w = by_span[code & 7]
            code >>= 3
            # equal triples add up before they are squared
            new = np.ones(code.shape, bool)
            np.not_equal(code[:, 1:], code[:, :-1], out=new[:, 1:])
            sums = np.add.reduceat(w.ravel(), np.flatnonzero(new.ravel()))
            square = np.add.reduceat(sums * sums, np.concatenate(([0], np.cumsum(new.sum(1))[:-1])))
            yield some, code, w / np.sqrt(square)[:, None]


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernels; 0 where a word has fewer than ORDER letters."""
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for at in range(0, len(landmarks), 32):  # bounds the table
        some = landmarks[at : at + 32]
        table = np.zeros((ALPHABET**ORDER, len(some)), np.float32)
        for which, code, w in subsequences(some):
            np.add.at(table, (code, which[:, None]), w)
        for which, code, w in subsequences(words):
            for part in np.array_split(np.arange(len(which)), -(-len(which) // 500)):
                out[which[part], at : at + 32] = np.einsum("nt,ntl->nl", w[part], table[code[part]])
    return out


class Bags:
    """Texts as sentences of words: the distinct words, and for all sentences of all texts the words' places."""

    def __init__(self, texts: list[str | None]):
        ids: dict[str, int] = {}
        words, length, count = array("i"), array("q"), array("q")
        for t in texts:
            cut = sentences(t)
            count.append(len(cut))
            for s in cut:
                length.append(len(s))
                words.extend([ids.setdefault(w, len(ids)) for w in s])
        self.words, self.used = list(ids), None
        self._set(np.array(words, np.int32), np.array(length, np.int64), np.array(count, np.int64))

    def _set(self, words_of: np.ndarray, length: np.ndarray, sentences: np.ndarray) -> None:
        self.words_of, self.length, self.sentences = words_of, length, sentences
        self.start = np.cumsum(length) - length
        self.text = np.repeat(np.arange(len(sentences)), sentences)  # of each sentence

    def part(self, texts: np.ndarray) -> Bags:
        """Some of the texts (ascending), with the same list of words."""
        some = np.zeros(len(self.sentences), bool)
        some[texts] = True
        sentence = some[self.text]
        out = Bags.__new__(Bags)
        out.words = self.words
        out._set(self.words_of[np.repeat(sentence, self.length)], self.length[sentence], self.sentences[some])
        out.used = np.flatnonzero(np.bincount(out.words_of, minlength=len(self.words)))
        return out

    def values(self, values) -> np.ndarray:
        """values(list of words) for each word; nothing is said of words that no text here has."""
        if self.used is None:
            return values(self.words)
        out = np.full(len(self.words), -np.inf)
        out[self.used] = values([self.words[i] for i in self.used.tolist()])
        return out

    def margins(self, values: np.ndarray) -> np.ndarray:
        """Per sentence: the largest value of its words."""
        return np.maximum.reduceat(values[self.words_of], self.start) if len(self.start) else np.zeros(0)

    def witnesses(self, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The first word with the largest value of each of some sentences."""
        return np.array([self.words_of[a + int(np.argmax(values[self.words_of[a : a + n]]))] for a, n in zip(self.start[rows].tolist(), self.length[rows].tolist())], np.int64)

    def tops(self, margins: np.ndarray, none: float) -> np.ndarray:
        """Per text: the TOPS largest margins of its sentences, largest first; ``none`` where it has fewer sentences."""
        out = np.full((len(self.sentences), TOPS), none)
        order = np.lexsort((-margins, self.text))
        first = np.cumsum(self.sentences) - self.sentences
        for k in range(TOPS):
            some = np.flatnonzero(self.sentences > k)
            out[some, k] = margins[order[first[some] + k]]
        return out


class Model:
    """weights: one per letter triple; bias; slope and odds: a document's score is the logistic of its calibrated margin."""

    def __init__(self, weights: np.ndarray, bias: float, slope: np.ndarray, odds: float):
        self.weights, self.bias, self.slope, self.odds = weights, bias, slope, odds

    def values(self, words: list[str]) -> np.ndarray:
        """The margin of each word."""
        out = np.full(len(words), self.bias, np.float64)
        for which, code, w in subsequences(words):
            out[which] += np.einsum("nt,nt->n", self.weights[code], w)
        return out

    def remembered(self, words: list[str]) -> np.ndarray:
        """values(), through a bounded memory of words seen before in this process."""
        memory = self.__dict__.setdefault("memory", {})
        new = [w for w in words if w not in memory]
        if len(memory) + len(new) > MEMORY_WORDS:
            memory.clear()
            new = words
        memory.update(zip(new, self.values(new).tolist()))
        return np.fromiter(map(memory.__getitem__, words), np.float64, len(words))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "memory"}

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        return _evidence(Bags(texts), self.values, self.bias)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-(_evidence(Bags(texts), self.remembered, self.bias) @ self.slope + self.odds)))


def _evidence(bags: Bags, values, bias: float) -> np.ndarray:
    """Per text: its largest sentence margins, and the log of the number of words they are the largest of."""
    tops = bags.tops(bags.margins(bags.values(values)), bias)
    words = np.bincount(bags.text, bags.length, len(bags.sentences))
    return np.column_stack([np.clip(tops, -4, 4), np.log1p(words)])


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps on its active rows, a block of rows at a time; y is -1 or 1."""
    n = x.shape[1] + 1
    w = np.zeros(n)
    ridge = np.eye(n)
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        left, right = ridge.copy(), np.zeros(n)
        for at in range(0, len(x), 2_000):
            rows = np.column_stack([x[at : at + 2_000], np.ones(len(x[at : at + 2_000]))]).astype(np.float64)
            t = y[at : at + 2_000]
            active = t * (rows @ w) < 1
            rows, t = rows[active], t[active]
            a = rows * (cost * weight[at : at + 2_000][active])[:, None]
            left += a.T @ rows
            right += a.T @ t
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> tuple[np.ndarray, float]:
    x1 = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x1.shape[1]), ridge * np.eye(x1.shape[1])
    penalty[-1, -1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve(penalty * len(x) / 100 + (x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1, x1.T @ (p - y) + penalty @ w * len(x) / 100)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(texts: list[str | None], labels: list[int], n_landmarks: int = LANDMARKS) -> Model:
    """A model from labelled texts.

    The calibration is fitted on other halves than the machine (two-fold), so that it
    holds for unseen texts, and also on copies with letters inserted, of both kinds of texts.
    """
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return Model(np.zeros(ALPHABET**ORDER, np.float32), -1.0, np.zeros(TOPS + 1), float(np.log(rate / (1 - rate))))
    again = np.sort(np.concatenate([np.flatnonzero(y == k)[: int(y.sum())] for k in (0, 1)]))
    target = np.concatenate([y, y[again]])
    fold = np.arange(len(y)) % 2
    if min(len(set(y[fold == k].tolist())) for k in (0, 1)) < 2:
        fold[:] = 2  # too few labels to hold half of them out
    bags = Bags(texts)
    seen = np.zeros((len(target), TOPS + 1))
    for k in sorted(set(fold.tolist())):
        learn, held = np.flatnonzero((fold != k) | (k == 2)), np.flatnonzero(fold == k)
        half = Model(*_machine(bags.part(learn), y[learn], n_landmarks), np.zeros(TOPS + 1), 0.0)
        seen[held] = _evidence(bags.part(held), half.values, half.bias)
        copies = np.flatnonzero(fold[again] == k)
        for some in np.array_split(copies, -(-len(copies) // 200)):  # their words are many and met once
            seen[len(y) + some] = half.evidence([distorted(texts[i], int(i)) for i in again[some]])
    slope, odds = _logistic(seen, target.astype(float))
    weights, bias = _machine(bags, y, n_landmarks)
    return Model(weights, bias, slope, odds)


def distorted(text: str | None, seed: int) -> str:
    """The text with a letter inserted into about half of its words of four letters or more."""
    rng = np.random.default_rng(seed)
    words = (text or "").split()
    change = rng.random(len(words)) < 0.5
    letters, places = rng.integers(97, 123, len(words)).tolist(), rng.random(len(words)).tolist()
    out = []
    for w, c, letter, place in zip(words, change.tolist(), letters, places):
        at = 1 + int(place * (len(w) - 1))
        out.append(w[:at] + chr(letter) + w[at:] if c and len(w) >= 4 else w)
    return " ".join(out)


def _lifts(bags: Bags, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word: log odds of a toxic text given the word, less one and a half standard errors; and its number of texts."""
    pairs = np.repeat(bags.text, bags.length) * np.int64(len(bags.words)) + bags.words_of
    pairs.sort()  # in place: sets of millions of numbers take several times their size
    pairs = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
    text, word = pairs // max(1, len(bags.words)), pairs % max(1, len(bags.words))
    bad, good = (np.bincount(word[y[text] == k], minlength=len(bags.words)) for k in (1, 0))
    a, b = bad + 0.25, good + 0.25
    lift = np.log(a / max(1, int(y.sum()))) - np.log(b / max(1, int((1 - y).sum()))) - 1.5 * np.sqrt(1 / a + 1 / b)
    return np.where(bad > 0, lift, -1.0), bad + good


def _machine(bags: Bags, y: np.ndarray, n_landmarks: int) -> tuple[np.ndarray, float]:
    """Weights of letter triples and the bias, by rounds of choosing the toxic texts' toxic sentences."""
    none = np.zeros(ALPHABET**ORDER, np.float32), -1.0
    if not len(bags.start):
        return none
    lift, count = _lifts(bags, y)
    toxic = np.flatnonzero((y == 1) & (bags.sentences > 0))
    first = np.cumsum(bags.sentences) - bags.sentences
    clean = np.flatnonzero(y[bags.text] == 0)
    if not len(toxic) or not len(clean):
        return none
    # landmarks: the words most on the toxic side, and common ones of all
    long = np.fromiter((len(w) >= ORDER for w in bags.words), bool, len(bags.words))
    side = np.flatnonzero(long & (lift > 0))
    side = sorted(side.tolist(), key=lambda i: (-lift[i], bags.words[i]))[: n_landmarks // 2]
    taken = set(side)
    rest = [i for i in np.argsort(-count, kind="stable").tolist() if long[i] and i not in taken][: 4 * n_landmarks]
    landmarks = [bags.words[i] for i in side + rest[:: max(1, len(rest) // max(1, n_landmarks - len(side)))][: n_landmarks - len(side)]]
    if not landmarks:
        return none
    kmm = kernel(landmarks, landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((kmm + kmm.T) / 2)
    keep = value > 1e-4 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])  # K^-1/2 up to a rotation
    values, features = np.maximum(lift, 0) - 1e-9, {}
    rng = np.random.default_rng(5)
    weights, bias = none
    for _ in range(ROUNDS):
        margins = bags.margins(values)
        best = np.array([f + int(np.argmax(margins[f : f + n])) for f, n in zip(first[toxic].tolist(), bags.sentences[toxic].tolist())])
        best = np.union1d(best, np.flatnonzero((margins > 0) & (y[bags.text] == 1)))
        hard = clean[np.argsort(-margins[clean], kind="stable")[: CLEAN_SENTENCES // 2]]
        usual = rng.permutation(clean)[: CLEAN_SENTENCES // 2]
        other = bags.words_of[bags.start[usual] + (rng.random(len(usual)) * bags.length[usual]).astype(np.int64)]
        good = np.concatenate([bags.witnesses(values, hard), other])
        rows, label, weight = [], [], []
        for words, side in ((bags.witnesses(values, best), 1.0), (good, -1.0)):
            word, times = np.unique(words, return_counts=True)
            rows.append(word)
            label.append(np.full(len(word), side))
            weight.append(times * ((500 if side > 0 else 1500) / len(words)))
        x = _nystrom([bags.words[i] for i in np.concatenate(rows)], landmarks, root, features)
        w, bias = _svm(x, np.concatenate(label), np.concatenate(weight))
        weights = _folded(landmarks, root @ w)
        values = bags.values(Model(weights, bias, np.zeros(TOPS + 1), 0.0).values)
    return weights, bias


def _folded(landmarks: list[str], alpha: np.ndarray) -> np.ndarray:
    """The sum of alpha times the landmarks' kernels as one weight per letter triple."""
    table = np.zeros(ALPHABET**ORDER)
    for which, code, u in subsequences(landmarks):
        np.add.at(table, code, u * alpha[which][:, None])
    return table.astype(np.float32)


def _nystrom(words: list[str], landmarks: list[str], root: np.ndarray, known: dict[str, np.ndarray]) -> np.ndarray:
    """Features of words: their kernels with the landmarks, times the root; remembered in ``known``."""
    new = [w for w in words if w not in known]
    for a in range(0, len(new), 5_000):  # bounds the kernel's rows
        known.update(zip(new[a : a + 5_000], (kernel(new[a : a + 5_000], landmarks).astype(np.float64) @ root).astype(np.float32)))
    return np.array([known[w] for w in words], np.float32)


def held_out(id_col: Column) -> Column:
    """Rows whose labels training never sees: crc32 of the id's digits leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES
) -> Model:
    """A model from at most ``rows`` labelled rows outside the held-out third, by the hashes of their ids.

    Labels are joined to texts by id after the bound, so few texts move.  Texts are
    whole; rows at the end of the order go until all texts together have at most ``max_bytes``.
    A label that is null or an id that is has no part.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    # toxic rows are few: they may be half of the bound; the odds are set right by the true counts
    some = bounded_sample(known.where("y = 1"), ["id"], rows // 2).unionByName(bounded_sample(known.where("y = 0"), ["id"], rows // 2))
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    got = text.join(F.broadcast(some.select("id", "y")), "id").groupBy("id", "y").agg(F.min("text").alias("text"))  # at most ``rows`` rows
    got = scratch.save(got, "labelled")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    fits = F.sum(size).over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)) <= max_bytes
    got = got.withColumn("fits", fits).where("fits").orderBy(F.xxhash64("id"), "id").select("text", "y").toArrow()
    labels_read = got["y"].to_pylist()
    model = train(got["text"].to_pylist(), labels_read)
    scratch.tidy()
    true = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    used = {y: labels_read.count(y) for y in (0, 1)}
    if all(d.get(y) for d in (true, used) for y in (0, 1)):
        model.odds += float(np.log(true[1] / true[0]) - np.log(used[1] / used[0]))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column of scores between 0 and 1 of each whole text; null and empty texts have one too."""
    import pandas as pd

    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one float per letter triple: 1 MB

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in scratch.tidied(texts):
            out = [sent.value.scores(t.iloc[i : i + CHUNK].where(t.iloc[i : i + CHUNK].notna(), "").tolist()) for i in range(0, len(t), CHUNK)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(run, "double")
    return docs.withColumn(name, udf(F.col(text_col).cast("string")))


CHUNK = 500


def detect(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
    score_col: str = "toxic_score", predicted_col: str = "toxic_predicted",
) -> DataFrame:
    """docs with toxic_score and toxic_predicted (1 at the threshold or above); all rows and other columns kept.

    Empty tables pass; without usable labels of both kinds every score is the labels' rate.
    """
    model = fit(docs, labels, id_col, text_col)
    out = score(docs, model, text_col, score_col)
    return out.withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))
