"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded texts.

Folding lower-cases, strips accents and invisible characters, maps homoglyphs
and digit substitutions to one letter each and turns everything else into
spaces.  The lexicon holds whole words and beginnings of words with weights
learned from labelled rows; phrases listed as exceptions hide the words inside
them.  A document's sum of weights is normalised by its length and mapped to a
probability by bins fitted on labelled rows that the lexicon did not see.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.session import discard, stored
from tablescope.llm.attach import attach
from tablescope.llm.words import sliced

#: Labelled rows that lexicon and bins are fitted on, the first by hash order.
TRAINING_ROWS = 40_000
#: Entries considered for the lexicon, those in most contexts first.
CANDIDATES = 50_000
PREFIXES = range(4, 10)
MIN_CONTEXTS = 4
MIN_WEIGHT = 3.0
BINS = 64
THRESHOLD = 0.3

# Look-alikes of Latin letters, digits read as letters, and
# everyday phrases in which a strong word is meant literally.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ɡ": "g", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j",
    "к": "k", "ӏ": "i", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y",
    "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ı": "i", "ø": "o", "đ": "d", "ł": "i", "ß": "ss",
    "æ": "ae", "œ": "oe", "ɑ": "a", "ո": "n", "ս": "u", "օ": "o",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SYMBOLS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "sore loser", "pond scum", "pathetic fallacy")


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for code in (*range(0x80, 0x2C0), *range(0x300, 0x370), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0xFF00, 0xFF60), *range(0x1D400, 0x1D800)):
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", char).lower() if not unicodedata.combining(c))
        if unicodedata.category(char) in ("Cf", "Mn") or not base:
            table[code] = None
        else:
            table[code] = base if base.isalnum() else " "
    table |= {code: chr(code).lower() if chr(code).isalnum() else " " for code in range(0x80)}
    table |= {ord(k): v for part in (HOMOGLYPHS, DIGITS) for k, v in part.items()}
    table |= {ord(k.upper()): v for k, v in HOMOGLYPHS.items() if len(k.upper()) == 1}
    table = {k: None if v is None else "".join(DIGITS.get(c, HOMOGLYPHS.get(c, c)) for c in v) for k, v in table.items()}
    # l, i and 1 look alike and become one letter, in texts as in entries
    return {k: v and v.replace("l", "i") for k, v in table.items()} | {0xAD: None, 0xFEFF: None}


_FOLD = _fold_table()
_SYMBOL = re.compile("[" + re.escape("".join(SYMBOLS)) + r"](?=\w)")


def fold(text: str) -> str:
    """Folded words, each with a space before and after."""
    if any(s in text for s in SYMBOLS):
        text = _SYMBOL.sub(lambda m: SYMBOLS[m[0]], text)
    return f" {text} ".translate(_FOLD)


class Lexicon:
    """Entries (" beginning" or " word ") with weights; exceptions cover spans."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in exceptions:
            entry = " " + " ".join(fold(phrase).split()) + " "
            self.automaton.add_word(entry, (len(entry), -1.0))
        self.used = len(self.automaton) > 0
        if self.used:
            self.automaton.make_automaton()

    def raw(self, text: str) -> float:
        """Strongest entry of every word outside exceptions, summed, over the root of the length."""
        if not self.used:
            return 0.0
        best: dict[int, float] = {}
        hidden: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton.iter(fold(text)):
            begin = end - length + 1
            if weight < 0:
                hidden.append((begin, end))
            elif weight > best.get(begin, 0.0):
                best[begin] = weight
        if hidden:
            best = {at: w for at, w in best.items() if not any(a <= at < b for a, b in hidden)}
        return sum(best.values()) / math.sqrt(1 + len(text) / 1000)


class Model:
    """Lexicon and the probabilities of the bins of its raw scores."""

    def __init__(self, weights: dict[str, float], centres: list[float], chances: list[float], exceptions: Iterable[str]):
        self.weights, self.centres, self.chances, self.exceptions = weights, centres, chances, tuple(exceptions)

    def scorer(self):
        made: list[Lexicon] = []

        def scores(texts: list[str]) -> list[list]:
            if not made:
                made.append(Lexicon(self.weights, self.exceptions))
            levels = [math.log2(1 + made[0].raw(t)) for t in texts]
            return [np.interp(levels, self.centres, self.chances).tolist()]

        return scores


def _entries(word: str) -> list[str]:
    return [f" {word} ", *(f" {word[:n]}" for n in PREFIXES if n <= len(word))]


def _contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (word, neighbours) of a slice; copies of a passage give the same contexts."""
    for batch in sliced(batches, "text"):
        seen = set()
        for text in batch.column("text").to_pylist():
            words = ["", *fold(text or "").split(), ""]
            seen.update(zip(words[1:], words, words[2:], strict=False))
        rows = [(w, xxhash.xxh64_intdigest(f"{a} {b}") - (1 << 63)) for w, a, b in seen if w]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["word", "context"])


def _occurrences(batches: Iterable[pa.RecordBatch], wanted: set[str]) -> Iterator[pa.RecordBatch]:
    """Occurrences of the wanted entries, and of all words under the empty entry."""
    for batch in sliced(batches, "text"):
        words = Counter()
        for text in batch.column("text").to_pylist():
            words.update(fold(text or "").split())
        counts = Counter({"": words.total()})
        for word, n in words.items():
            for entry in _entries(word):
                if entry in wanted:
                    counts[entry] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["entry", "n"])


def _rising(chances: np.ndarray, weights: np.ndarray) -> list[float]:
    """Pool neighbouring bins until their probabilities rise."""
    pools: list[list[float]] = []
    for p, w in zip(chances, weights, strict=True):
        pools.append([p, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            p2, w2, n2 = pools.pop()
            p1, w1, n1 = pools.pop()
            pools.append([(p1 * w1 + p2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return [p for p, _, n in pools for _ in range(int(n))]


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    training_rows: int = TRAINING_ROWS, exceptions: Iterable[str] = EXCEPTIONS,
) -> Model:
    """Learn lexicon and bins from labelled documents.

    The classifier is fitted on at most `training_rows` labelled documents, the
    first by a hash of the id; that table is the only one broadcast.  Labels of
    one id are merged to the largest; null ids and labels are ignored.  Without
    labelled rows every score is 0.
    """
    rated = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).dropna()
    sample = rated.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(training_rows)
    sample = stored(sample.withColumn("_part", F.pmod(F.xxhash64("_id", F.lit("part")), F.lit(3))), "toxicity-sample")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("text")).join(F.broadcast(sample), "_id")
    learn = rows.filter("_part > 0")
    words = (
        learn.filter("_label > 0").select("text").mapInArrow(_contexts, "word string, context long")
        .distinct().groupBy("word").agg(F.count("*").alias("n"))
    )
    entries = F.array(
        F.concat(F.lit(" "), "word", F.lit(" ")),
        *(F.when(F.length("word") >= n, F.concat(F.lit(" "), F.substring("word", 1, n))) for n in PREFIXES),
    )
    rolled = words.select(F.explode(entries).alias("entry"), "n").filter("entry IS NOT NULL").groupBy("entry").agg(F.sum("n").alias("n"))
    rolled = stored(rolled, "toxicity-entries")
    seen_toxic = rolled.filter(F.col("entry").endswith(" ")).agg(F.sum("n")).first()[0] or 0
    top = rolled.filter(F.col("n") >= MIN_CONTEXTS).orderBy(F.desc("n"), "entry").limit(CANDIDATES).collect()
    toxic = {r.entry: r.n for r in top}
    wanted = set(toxic)
    other = (
        learn.filter("_label = 0").select("text").mapInArrow(lambda it: _occurrences(it, wanted), "entry string, n long")
        .groupBy("entry").agg(F.sum("n").alias("n")).collect()
    )
    clean = {r.entry: r.n for r in other}
    seen_clean = clean.pop("", 0)
    weights = {}
    for entry, n in toxic.items():
        weight = math.log((n + 0.5) / (seen_toxic + 1)) - math.log((clean.get(entry, 0) + 0.5) / (seen_clean + 1))
        if weight >= MIN_WEIGHT:
            weights[entry] = min(weight, 10.0)
    first = Model(weights, [0.0, float(BINS)], [0.0, float(BINS)], exceptions)
    rest = attach(rows.filter("_part = 0").select("_label", "text"), "text", "_level double", first.scorer())
    bins = rest.groupBy(F.least(F.floor(F.col("_level") * 8), F.lit(BINS - 1)).alias("b")).agg(F.count("*").alias("n"), F.sum("_label").alias("t")).collect()
    discard(sample, rolled)
    bins = sorted((int(r.b), r.n, r.t) for r in bins)
    if not bins:
        return Model(weights, [0.0], [0.0], exceptions)
    prior = sum(t for _, _, t in bins) / sum(n for _, n, _ in bins)
    chances = np.array([(t + prior) / (n + 1) for _, n, t in bins])
    rising = _rising(chances, np.array([n for _, n, _ in bins], float))
    # bins above the highest one seen share its probability; a slight slope keeps the order of scores
    centres = [(b + 0.5) / 8 if b else 0.0 for b, _, _ in bins] + [float(BINS)]
    rising = [min(1.0, p * 0.999 + 0.001 * c / BINS) for p, c in zip([*rising, rising[-1]], centres, strict=True)]
    return Model(weights, centres, rising, exceptions)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns with `score`, 0 to 1; null and empty texts have the score of no hit."""
    return attach(docs, text_col, "score double", model.scorer())


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score lies under the threshold."""
    scores = model.scorer()
    return attach(docs, text_col, "_kept boolean", lambda texts: [[s < threshold for s in scores(texts)[0]]], keep="_kept")
