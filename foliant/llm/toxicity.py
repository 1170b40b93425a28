"""Toxicity by a support vector machine over a gapped subsequence kernel, approximated with Nyström landmarks.

The kernel of two words counts the subsequences of three letters that they share, each weighed by DECAY to the power of
the stretch it takes in both (Lodhi et al. 2002); it is divided by norms that depend on the words' lengths. Letters put
into an insult or left out of it only stretch or thin out what it shares with the plain one. A text's units are its
words, and runs of single characters (spelt-out words) as one word each.

A unit's vector is its kernel with the landmarks, times the inverse square root of the landmarks' own kernel; a linear
machine is trained on these vectors. As the kernel is a product of sparse subsequence counts, machine, landmarks and root
multiply out to one weight for each subsequence, which is how whole corpora are scored.

A document is as toxic as its most toxic unit. Training is on labelled sentences, which carry their document's label:
units of clean sentences are all negative; of each toxic document those that the machine so far ranks highest are positive.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import bound_batches, only, stored
from foliant.llm.dedup import signature
from foliant.llm.shingles import shingle_set

#: Weight of each place that a subsequence takes, and most places; letters of a unit that are compared at once.
DECAY, STRETCH, WIDEST = 0.5, 7, 20
#: Labelled rows for training, toxic and clean, and their longest text; landmarks; negative units in a round.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_CHARS, LANDMARKS, NEGATIVES = 1500, 3000, 20_000, 400, 6000
#: Words whose margins are worked out at once; bounds the memory.
AT_ONCE = 20_000
#: Texts beyond which a unit that they share counts no more in training.
ENOUGH = 10
#: Rounds of training on bags; steps of the solver; weight of the regulariser.
ROUNDS, STEPS, REGULAR = 8, 30, 1e-5
#: Classes of letters: a to z, the begin of a unit, and the rest hashed to the others; 0 is no letter.
CLASSES, BEGIN, FIRST_OTHER = 48, 27, 28
#: Score at or above which a document is predicted to be toxic.
THRESHOLD = 0.7

_SPELT = re.compile(r"(?:^|(?<=\s))\S(?:\s\S){2,}(?=\s|$)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
# Figures and signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


@functools.cache
def letter_classes() -> np.ndarray:
    """The class of every character of the basic plane: letters with accents differ from those without, lookalikes are
    letters. A line feed, which stands before every unit, is the mark of a unit's begin."""
    out = np.zeros(0x10000, np.int32)
    for code in range(0x10000):
        c = LOOKALIKES.get(chr(code)) or chr(code).lower()[0]
        out[code] = ord(c) - 96 if "a" <= c <= "z" else FIRST_OTHER + ord(c) % (CLASSES - FIRST_OTHER) if c.isalpha() else 0
    out[10] = BEGIN
    return out


def units(text: str | None) -> set[str]:
    """The distinct words of a text, and its runs of single characters as words."""
    if not text:
        return set()
    found = set(text.split())
    found.update("".join(run.split()) for run in _SPELT.findall(text))
    return found


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words as classes of letters one after another, and the word and the bounds of each part that is compared:
    the word itself, or overlapping parts of a wide one."""
    codes = np.frombuffer("\n".join(["", *words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = letter_classes()[np.minimum(codes, 0xFFFF)]
    of = np.cumsum(codes == 10) - 1
    keep = classes > 0
    letters, of = classes[keep], of[keep]
    sizes = np.bincount(of, minlength=len(words))
    starts = np.cumsum(sizes) - sizes
    parts = [(np.flatnonzero(sizes <= WIDEST), 0)]
    whose, begin, stop = [parts[0][0]], [starts[parts[0][0]]], [(starts + sizes)[parts[0][0]]]
    for w in np.flatnonzero(sizes > WIDEST):
        at = np.append(np.arange(0, sizes[w] - WIDEST, WIDEST // 2), sizes[w] - WIDEST) + starts[w]
        whose, begin, stop = [*whose, np.full(len(at), w)], [*begin, at], [*stop, at + WIDEST]
    return letters, np.concatenate(whose), np.stack([np.concatenate(begin), np.concatenate(stop)])


@functools.cache
def triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places of the subsequences of three in n letters that stretch over STRETCH at most, and their weights, divided
    by the norm of a word of n letters."""
    i, j, k = (np.array(x, np.int64) for x in zip(*(c for c in combinations(range(n), 3) if c[2] - c[0] < STRETCH)))
    weight = DECAY ** (k - i + 1.0)
    return i, j, k, (weight / np.sqrt((weight**2).sum())).astype(np.float32)


def project(words: list[str], weights: np.ndarray, row_of: np.ndarray | None = None) -> np.ndarray:
    """The products of the words' normed subsequence counts with the columns of weights (CLASSES ** 3 rows, or fewer, of
    which row_of names each subsequence's); of a wide word's parts the greatest. Words of less than three letters have no subsequences: zeros."""
    one = weights.ndim == 1
    letters, whose, (begin, stop) = windows(words)
    size, out = stop - begin, np.zeros((len(words), *weights.shape[1:]), np.float32)
    wide: dict[int, np.ndarray] = {}
    for n in np.unique(size):
        if n < 3:
            continue
        i, j, k, weight = triples(int(n))
        some = np.flatnonzero(size == n)
        step = max(1, 1_000_000 // (len(weight) if one else weights.shape[1]))
        for first in range(0, len(some), step):
            rows = some[first : first + step]
            x = letters[begin[rows][:, None] + np.arange(n)]
            code = (x[:, i] * CLASSES + x[:, j]) * CLASSES + x[:, k]
            code = code if row_of is None else row_of[code]
            value = weights[code] @ weight if one else sum(weights[code[:, t]] * weight[t] for t in range(len(weight)))
            if n < WIDEST:
                out[whose[rows]] = value
            else:
                for w, v in zip(whose[rows], value):
                    wide[w] = np.maximum(wide[w], v) if w in wide else v
    for w, v in wide.items():
        out[w] = v
    return out


def entries_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The normed subsequence counts of words: subsequence, word and weight of each place; wide words by their first part."""
    codes, of, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    letters, whose, (begin, stop) = windows(words)
    done: set[int] = set()
    for w, a, b in zip(whose.tolist(), begin, stop):
        if b - a >= 3 and w not in done:
            done.add(w)
            i, j, k, weight = triples(int(b - a))
            x = letters[a:b]
            codes, of, weights = [*codes, (x[i] * CLASSES + x[j]) * CLASSES + x[k]], [*of, np.full(len(weight), w)], [*weights, weight]
    return np.concatenate(codes), np.concatenate(of), np.concatenate(weights)


def counts_of(words: list[str]) -> np.ndarray:
    """The normed subsequence counts of words, a column each."""
    out = np.zeros((CLASSES**3, len(words)), np.float32)
    codes, of, weights = entries_of(words)
    np.add.at(out, (codes, of), weights)
    return out


def used_counts(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The subsequences that words have, the rows of counts_of for these after a row of zeros, and each subsequence's row."""
    codes, of, weights = entries_of(words)
    used, at = np.unique(codes, return_inverse=True)
    out = np.zeros((len(used) + 1, len(words)), np.float32)
    np.add.at(out, (at + 1, of), weights)
    row_of = np.zeros(CLASSES**3, np.int32)
    row_of[used] = np.arange(1, len(used) + 1)
    return used, out, row_of


@dataclass
class Machine:
    """weights: for each subsequence; bias; slope and offset: of the calibrated probability."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, words: list[str]) -> np.ndarray:
        parts = [project(words[i : i + AT_ONCE], self.weights) for i in range(0, max(1, len(words)), AT_ONCE)]
        return np.concatenate(parts) + np.float32(self.bias)

    def text_margins(self, texts: list[str | None]) -> np.ndarray:
        """Of each text its greatest margin; that of no subsequence at all for one without units."""
        bags = [units(text.lower() if text else text) for text in texts]
        words = list(set().union(*bags)) if bags else []
        known = dict(zip(words, self.margins(words).tolist()))
        return np.array([max(map(known.__getitem__, bag), default=self.bias) for bag in bags])

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -50, 50)))


def with_letters_put_in(word: str, rng: np.random.Generator) -> str:
    at = int(rng.integers(1, max(2, len(word))))
    return word[:at] + chr(97 + int(rng.integers(26))) + word[at:]


def unlike(texts: list[str]) -> list[str]:
    """The texts without those that share a chunk of their MinHash signatures with an earlier one: copies count once."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text in texts:
        shingles = shingle_set(text.encode())
        chunks = set(enumerate(signature(shingles).tolist())) if len(shingles) else set()
        if seen.isdisjoint(chunks):
            out.append(text)
        seen |= chunks
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The linear machine (weights, then bias) of the least squared hinge loss, by Newton steps that are halved until the
    loss falls."""
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = REGULAR * np.eye(x.shape[1])
    keep[-1, -1] = 0.0
    loss = lambda w: float((share * np.maximum(0.0, 1 - y * (x @ w)) ** 2).sum() + w @ keep @ w)
    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(STEPS):
        inside = y * (x @ w) < 1
        some, weight = x[inside], share[inside]
        new = np.linalg.solve((some * weight[:, None]).T @ some + keep + 1e-9 * np.eye(len(w)), some.T @ (weight * y[inside]))
        step, then = 1.0, loss(new)
        while then > now and step > 1e-3:
            step /= 2
            then = loss(w + step * (new - w))
        if now - then < 1e-6 * now:
            break
        w, now = w + step * (new - w), then
    return w


def letters_of(words: list[str]) -> list[bytes]:
    """Each word's classes of letters; words that differ in signs alone have the same."""
    letters, whose, (begin, stop) = windows(words)
    out = [b""] * len(words)
    for w, a, b in zip(whose.tolist(), begin, stop):
        out[w] += letters[a:b].astype(np.uint8).tobytes()
    return out


def sentences_of(text: str) -> list[set[str]]:
    """The units of each sentence."""
    return [found for part in _SENTENCE.split(text.lower()) if (found := units(part))]


def train(toxic: list[str], clean: list[str], seed: int = 1) -> Machine:
    """Train on the sentences of texts of both classes, which carry their text's label; with none of one class the machine
    finds nothing toxic.

    All sentences of clean texts are clean, but of a toxic text's only some are toxic (Andrews et al. 2003). At first every
    unit that clean sentences never have stands for the sentences that have it, and counts more the more toxic texts share
    it; then each toxic text elects its most toxic sentence, by the machine so far, and that sentence's most toxic unit."""
    rng = np.random.default_rng(seed)
    toxic, clean = unlike(toxic), unlike(clean)
    number: dict[str, int] = {}  # sentences are arrays of units' numbers, which take little of the driver's memory
    numbered = lambda t: [np.array(sorted(number.setdefault(w, len(number)) for w in sorted(some)), np.int32) for some in sentences_of(t)]
    bad_texts, good_texts = ([numbered(t) for t in some] for some in (toxic, clean))
    words, n_words = list(number), len(number)
    none = np.zeros(0, np.int32)
    of_texts = lambda texts: [np.unique(np.concatenate([none, *t])) for t in texts]
    bad_bags, good_bags = of_texts(bad_texts), of_texts(good_texts)
    bad, good = (np.bincount(np.concatenate([none, *bags]), minlength=n_words) for bags in (bad_bags, good_bags))
    if not bad.any() or not good.any():
        return Machine(np.zeros(CLASSES**3, np.float32), -1.0, 1.0, -3.0)
    every, suspects = np.flatnonzero(good), np.flatnonzero((bad > 0) & (good == 0))
    if not len(suspects):
        suspects = np.flatnonzero(bad)
    letters = letters_of(words)
    shared = suspects[bad[suspects] > 1]
    elected = {int(w): float(bad[w]) for w in (shared if len(shared) else suspects)}  # units that stand for toxic sentences, and texts that say so
    hard = none
    for _ in range(ROUNDS):
        ranked = sorted(elected, key=lambda w: (-elected[w], words[w]))
        unlike_letters: dict[bytes, int] = {}
        for u in ranked:
            if len(letters[u]) > 2:
                unlike_letters.setdefault(letters[u], u)
        marked = list(unlike_letters.values())[: LANDMARKS // 2]
        usual = rng.choice(every, min(LANDMARKS // 4, len(every)), replace=False)
        used, land, row_of = used_counts([words[w] for w in dict.fromkeys([*marked, *hard[: LANDMARKS // 4].tolist(), *usual.tolist()])])
        values, vectors = np.linalg.eigh(land.T @ land)
        maps = land @ (vectors / np.sqrt(np.maximum(values, 1e-4))).astype(np.float32)  # a unit's vector: its counts times this
        positive = ranked[: NEGATIVES // 2]
        often = np.minimum([elected[w] for w in positive], ENOUGH) ** 2
        negative = np.concatenate([rng.choice(every, min(NEGATIVES, len(every)), replace=False), hard])
        put_in = [with_letters_put_in(words[w], rng) for w in positive]
        x = project([*(words[w] for w in positive), *put_in, *(words[w] for w in negative)], maps, row_of).astype(np.float64)
        share = np.concatenate([often, 0.3 * often, np.minimum(good[negative], ENOUGH)])
        y = np.where(np.arange(len(x)) < 2 * len(positive), 1.0, -1.0)
        for side in (y > 0, y < 0):
            share[side] *= 0.5 / share[side].sum()
        w = squared_hinge(x, y, share)
        weights = np.zeros(CLASSES**3, np.float32)
        weights[used] = (maps @ w[:-1])[1:]
        machine = Machine(weights, float(w[-1]))
        of_words = machine.margins(words)
        votes: dict[int, float] = {}
        suspected = np.zeros(n_words, bool)
        suspected[suspects] = True
        for bag in bad_bags:
            some = bag[suspected[bag]]
            for u in some[of_words[some] > 0].tolist():
                votes[u] = votes.get(u, 0.0) + 1.0
            if len(some):
                top = int(some[of_words[some].argmax()])
                votes[top] = votes.get(top, 0.0) + 1.0
        elected = {u: n for u, n in votes.items() if n > 1} or votes
        closest = every[np.argsort(-of_words[every], kind="stable")[: NEGATIVES // 3]]
        hard = np.array(list(dict.fromkeys([*closest.tolist(), *hard.tolist()])), np.int64)[:NEGATIVES]
    margins = np.array([of_words[b].max() if len(b) else machine.bias for b in (*bad_bags, *good_bags)], np.float64)
    machine.slope, machine.offset = calibrate(margins, np.arange(len(margins)) < len(toxic))
    return machine


def calibrate(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability (Platt 1999), by Newton steps."""
    n_pos, n_neg = positive.sum(), (~positive).sum()
    target = np.where(positive, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    x, beta = np.stack([margins, np.ones(len(margins))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        grad = x.T @ (p - target) + 1e-3 * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        beta = beta - np.clip(step, -5, 5)
    return float(beta[0]), float(beta[1])


def held_out(id_col: str) -> Column:
    """Rows whose labels are not learnt from."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> Machine:
    """Train on TOXIC_ROWS and CLEAN_ROWS labelled rows at most, the first in the order of a hash of their ids among those
    whose document is there, not empty and of SAMPLE_CHARS at most. They are picked by ids and lengths alone, and are few
    enough to broadcast, so no text is shuffled."""
    known = only(labels, id_col, "toxic").filter(~held_out(id_col)).filter("toxic IN (0, 1)").dropDuplicates([id_col])
    rows = only(docs, id_col, text_col).filter(F.char_length(f"`{text_col}`").between(1, SAMPLE_CHARS))
    known = stored(known.join(only(rows, id_col), id_col, "left_semi"), "labelled")
    order = [F.xxhash64(id_col), F.col(id_col)]
    picked = [known.filter(F.col("toxic") == c).orderBy(*order).limit(n) for c, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS))]
    sample = rows.join(F.broadcast(picked[0].unionByName(picked[1])), id_col).dropDuplicates([id_col]).select(id_col, "toxic", text_col).collect()
    sample.sort(key=lambda r: r[0])
    return train([r[2] for r in sample if r[1] == 1], [r[2] for r in sample if r[1] == 0])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score (0 to 1) and predicted for every row of docs.

    The score depends on the whole text alone. Null and empty texts have the score of a text without units. A null id is
    not held out; repeated rows give repeated results; rows with null labels, or labels without a document, are not learnt
    from. Without labels of both classes every score is low. The machine, one weight for each of CLASSES ** 3
    subsequences, goes to the tasks with their code; of texts only those of the sample are shuffled.
    """
    bound_batches(docs.sparkSession)
    machine = train_on(docs, labels, id_col, text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = machine.probability(machine.text_margins(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = only(docs, id_col, text_col).mapInArrow(judge, f"id {kind}, score double").withColumnRenamed("id", id_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
