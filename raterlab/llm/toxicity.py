"""Toxicity scores of texts restored by noisy-channel decoding.

A character trigram model is counted over the words of all documents. What writers do to
hide a word (leet signs, spaced-out letters, repeated letters) makes a lattice: each sign may stand for a
letter, be noise or part words, each run of signs or letters may be one or two; the Viterbi path under the
character model and the channel's costs is the restored text. Chunks of signs alone are decoded like others.
Signs at a chunk's edge and doubled letters are ambiguous (marks or letters, spelling or disguise): such a chunk has
the words of its best path and also those that it has as it is written. Plain words without doubled
letters have a lattice of one path and are taken as they are.

Scores come from the restored words alone. A logistic regression over words and their
beginnings, fitted on labelled documents outside the held-out fold, weighs each word; a
second one, fitted on a fold that the first has not seen, turns a document's three highest
word weights into a probability. The labelled sample is bounded by SAMPLE rows (drawn by a
hash threshold); character counts and scores cover all documents.

Defined results: a null, empty or wordless text gets the score of a text whose words weigh
nothing; a null doc_id counts as the empty text in the fold; whole texts are scored, whatever
their length; repeated rows get equal scores; without labels of both kinds every score is the
share of toxic labels (0 without labels); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raterlab.llm.common import kept_by_worker, map_texts, scratch_table

#: Labelled rows that the classifier is fitted on, at most about so many.
SAMPLE = 10_000
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 4
BEGINNINGS = (3, 4, 5, 6)
TOP = 3
REMEMBERED = 400_000

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
#: symbols: 0 ends a word, 1..n are LETTERS, n + 1 is any other letter
SYMBOLS = len(LETTERS) + 2
INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
#: fixed values: what a sign may stand for
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "2": "z",
         "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y", "#": "h", "*": "aeiou"}
SIGN_COST, NOISE_COST, PART_COST, REPEAT_COST = 1.0, 4.0, 2.5, 0.5
#: one letter written as two; a gap wider than others as nothing and as a word's end
DOUBLE_COST, WIDE_COST, WIDE_PART_COST = 2.0, 1.0, 1.5
EDGE = ".,;:?\"'()[]{}<>«»“”„…¿¡-–—/\\"
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_GAP, _NARROW = re.compile(r"\s+"), re.compile(r"(?<!\s)\s(?!\s)")
_EDGE_RUNS = re.compile(r"^([^\w\s])\1+|([^\w\s])\2+$")
_DOUBLE, _RUN = re.compile(r"(.)\1"), re.compile(r"(.)\1{2,}")
#: marks at a chunk's edge that stand for no letter
MARKS = "".join(c for c in EDGE if c not in SIGNS)


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of character trigrams over all texts; at most SYMBOLS ** 3 rows reach the driver."""
    def worker():
        table = np.zeros(0x110000, np.int64)
        for cp in range(0x110000):
            if chr(cp).isalpha():
                table[cp] = SYMBOLS - 1
        for c, i in INDEX.items():
            table[ord(c)] = i
        return table

    source = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa
        table = kept_by_worker("letters", worker)
        counts = np.zeros(SYMBOLS ** 3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                s = table[np.frombuffer((" " + text.as_py().lower() + " ").encode("utf-32-le", "replace"), np.uint32)]
                tri = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
                np.add.at(counts, tri[(s[1:-1] > 0) | (s[2:] > 0)], 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["tri", "n"])
    out = np.zeros(SYMBOLS ** 3, np.int64)
    for r in source.mapInArrow(run, "tri long, n long").groupBy("tri").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["tri"]] = r["n"]
    return out


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), smoothed by the second-order model."""
    c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
    two = c.sum(0)
    lower = (two + 0.1) / (two.sum(1, keepdims=True) + 0.1 * SYMBOLS)
    return np.log((c + 2.0 * lower[None]) / (c.sum(2, keepdims=True) + 2.0)).astype(np.float32)


def lattice(chunk: str) -> list[list[tuple[str, float]]]:
    """Per place of a chunk its readings: (letters, "" for nothing or " " for a word's end; cost)."""
    places, i = [], 0
    while i < len(chunk):
        c = chunk[i]
        n = 1
        while i + n < len(chunk) and chunk[i + n] == c:
            n += 1
        i += n
        if c.isalpha():
            if n == 1:
                places.append([(c, 0.0)])
            elif n == 2:
                places.append([(c + c, 0.0), (c, DOUBLE_COST)])
            else:
                places.append([(c, REPEAT_COST), (c + c, 2 * REPEAT_COST)])
        elif c == " ":
            places.append([("", 0.2), (" ", PART_COST)] if n == 1 else [("", WIDE_COST), (" ", WIDE_PART_COST)])
        else:
            cost = SIGN_COST * (1 + 0.5 * (n - 1)) + (0.5 if c == "*" else 0.0)
            read = [(x, cost + (REPEAT_COST if n > 1 else 0.0)) for x in SIGNS.get(c, "")]
            read += [(x + x, cost) for x in SIGNS.get(c, "") if n > 1]
            places.append(read + [("", NOISE_COST if c in SIGNS else 0.5), (" ", PART_COST + 1.0)])
    return places


def decode(chunk: str, model: np.ndarray) -> str:
    """The cheapest path through the chunk's lattice. A path is its cost and a chain of back-pointers, which paths
    share, so time and memory grow with the chunk's length alone."""
    other, price_of = SYMBOLS - 1, model.item
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for readings in [*lattice(chunk), [(" ", 0.0)]]:
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, trail) in paths.items():
            for letters, price in readings:
                x, y, total = a, b, cost + price
                for c in letters:
                    k = 0 if c == " " else INDEX.get(c, other)
                    if k or y:
                        total -= price_of(x, y, k)
                        x, y = y, k
                held = step.get((x, y))
                if held is None or total < held[0]:
                    step[x, y] = (total, (trail, letters))
        paths = step
    trail, out = min(paths.values(), key=lambda p: p[0])[1], []
    while trail is not None:
        trail, letters = trail
        out.append(letters)
    return "".join(reversed(out)).strip()


def restore(chunk: str, model: np.ndarray) -> list[str]:
    """The words of one chunk of lower-case text, restored."""
    core = chunk.strip(MARKS)
    if core.isalpha() and not _DOUBLE.search(core):
        return [core]
    if not any(c.isalpha() or c in SIGNS for c in core):
        return []
    words = decode(core, model).split()
    # and as it is written: signs at the edge are marks, doubled letters spelling
    written = _EDGE_RUNS.sub("", chunk.strip(EDGE)).strip(EDGE).rstrip("!")
    if written == core and not core.isalpha() or not any(map(str.isalpha, written)):
        return words
    known = set(words)
    more = [written] if written.isalpha() and not _RUN.search(written) else decode(written, model).split()
    return words + [w for w in more if w not in known]


def chunks(text: str) -> set[str]:
    """What is restored on its own: text between white space, and runs of single signs, however far apart, as one."""
    low = text.lower()
    found = set(low.split())
    for m in _SPACED.finditer(low):
        # gaps of one width part signs; where some are wider, these may part words
        wide = "  " if _NARROW.search(m.group()) else " "
        found.add(_GAP.sub(lambda gap: " " if len(gap.group()) == 1 else wide, m.group()))
    return found


def features(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in BEGINNINGS if len(word) >= n)]


def fold(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


class Scorer:
    """Word weights and calibration, with what has been restored so far."""

    def __init__(self, model: np.ndarray, weights: dict[str, float]) -> None:
        self.model, self.weights, self.known = model, weights, {}

    def words(self, text: str) -> set[str]:
        out: set[str] = set()
        for c in chunks(text):
            out.update(restore(c, self.model))
        return out

    def _weigh(self, chunk: str) -> float:
        get = self.weights.get
        return max((sum(get(f, 0.0) for f in features(w)) for w in restore(chunk, self.model)), default=0.0)

    def top(self, text: str) -> list[float]:
        """The TOP highest word weights of a text."""
        known, found = self.known, chunks(text)
        new = found.difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = found
        for c in new:
            known[c] = self._weigh(c)
        best = sorted(map(known.__getitem__, found), reverse=True)[:TOP]
        return best + [0.0] * (TOP - len(best))


class ToxicityModel:
    def __init__(self, characters: np.ndarray, weights: dict[str, float], intercept: float, slopes: list[float]) -> None:
        self.characters, self.weights, self.intercept, self.slopes = characters, weights, intercept, slopes


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample: int = SAMPLE) -> ToxicityModel:
    """Character counts over all documents, weights from a bounded sample of labelled ones."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import array_to_vector

    model = log_probabilities(character_counts(docs, text_col))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"),
                          fold(id_col).alias("fold")).filter(f"fold <> {HELD_OUT} and label in (0, 1) and doc_id is not null")
    known = scratch_table(known.groupBy("doc_id", "fold").agg(F.max("label").alias("label")), "labels")
    total, toxic = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = toxic / total if total else 0.0

    def constant() -> ToxicityModel:
        s = min(max(share, 1e-9), 1 - 1e-9)
        return ToxicityModel(model, {}, float(np.log(s / (1 - s))), [0.0] * TOP)
    if not 0 < toxic < total:
        return constant()
    if total > sample:
        # the part that stays is about `sample` rows, drawn by the id's hash
        part = int(sample / total * (1 << 30))
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < part)
    # bounded by `sample` rows
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")

    def worker():
        scorer = Scorer(model, {})

        def compute(texts):
            return [[sorted({f for w in scorer.words(t) for f in features(w)}) for t in texts]]
        return compute
    made = scratch_table(map_texts(rows, "text", ["doc_id", "label", "fold"], "words array<string>", worker), "labelled")
    first = made.filter(f"fold <> {CALIBRATE}")
    if first.agg(F.countDistinct("label")).first()[0] < 2:
        return constant()
    counter = CountVectorizer(inputCol="words", outputCol="features", minDF=2.0, vocabSize=1 << 17, binary=True)
    try:
        vocabulary = counter.fit(first)
    except Exception as ex:
        if "vocabulary" not in str(ex):
            raise
        return constant()
    ready = vocabulary.transform(first).select("features", F.col("label").cast("double").alias("label"))
    line = LogisticRegression(maxIter=30, regParam=0.001, standardization=False).fit(ready)
    values = line.coefficients.toArray()
    weights = {w: float(v) for w, v in zip(vocabulary.vocabulary, values) if abs(v) > 1e-3}

    def tops():
        scorer = Scorer(model, weights)
        return lambda texts: [[scorer.top(t) for t in texts]]
    rated = map_texts(rows.filter(f"fold = {CALIBRATE}"), "text", ["label"], "top array<double>", tops)
    rated = scratch_table(rated.select("top", F.col("label").cast("double").alias("label")), "rated")
    if rated.agg(F.countDistinct("label")).first()[0] < 2:
        # too few labels to calibrate: a line through the fitted words' own scale
        return ToxicityModel(model, weights, -2.0, [2.0, 1.0, 1.0])
    rated = rated.select(array_to_vector("top").alias("features"), "label")
    final = LogisticRegression(maxIter=50, regParam=1e-4, lowerBoundsOnCoefficients=_zeros()).fit(rated)
    return ToxicityModel(model, weights, float(final.intercept), [float(x) for x in final.coefficients])


def _zeros():
    from pyspark.ml.linalg import Matrices
    return Matrices.dense(1, TOP, [0.0] * TOP)


def score(docs: DataFrame, model: ToxicityModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and score (0 to 1, higher: toxic likelier)."""
    key = "toxicity" + uuid.uuid4().hex
    characters, weights, intercept, slopes = model.characters, model.weights, model.intercept, np.array(model.slopes)

    def worker():
        scorer = kept_by_worker(key, lambda: Scorer(characters, weights))

        def compute(texts):
            x = np.array([scorer.top(t) for t in texts]).reshape(-1, TOP) @ slopes + intercept
            return [(1 / (1 + np.exp(-np.clip(x, -60, 60)))).tolist()]
        return compute
    return map_texts(docs, text_col, keep, "score double", worker)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = score(ids, fit(ids, labels.withColumnRenamed(id_col, "doc_id")), ["doc_id"])
    return out.select("doc_id", (fold("doc_id") == HELD_OUT).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    model = fit(docs, labels, text_col=text_col)
    kept = [c for c in docs.columns]
    out = score(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text")), model, ["row"])
    return out.filter("score < 0.5").select(*[F.col("row").getField(c).alias(c) for c in kept])
