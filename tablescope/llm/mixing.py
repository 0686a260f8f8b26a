"""Mixing to target weights with soft domain membership.

A classifier fitted on a labelled table gives every document a probability for
each domain, from the shape of its text and from words that tell a domain from
the others.  Document rates r >= 0 are fitted by projected-gradient least squares
so that the expected tokens of each domain, the sum over documents of rate *
tokens * probability, match the targets.

The number of domains K is small.  Rates are never stored between steps: a
document's rate is the projection of 1 - own tokens * multipliers on r >= 0, so K
numbers stand for all steps so far.  A step goes along the gradient of the squared
gap, scaled by the K x K products of the documents with a positive rate; several
step lengths are tried in one pass, and one is taken only if it lowers the function
whose least point is the solution.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.session import discard, stored
from tablescope.llm.attach import attach
from tablescope.llm.words import split_words

#: Labelled rows that the classifier is fitted on, the first by hash order.
TRAINING_ROWS = 20_000
HASHED = 64
PENALTY = 0.01
#: Places of the word lexicon, and what a word needs to enter it: documents of its domain, and odds against the others.
LEXICON = 1 << 17
MIN_DOCUMENTS, MIN_ODDS = 3, 4.0
STEPS = 60
#: Step lengths tried in one pass.
LENGTHS = 0.5 ** np.arange(12)
TOLERANCE = 1e-9
#: A domain with a smaller share of the tokens can't be matched by rates.
LEAST_SHARE = 1e-6
#: Domains of the labels table and their shares of all tokens.
DOMAINS = ("clean", "poor", "toxic")
TARGETS = {"clean": 0.90, "poor": 0.08, "toxic": 0.02}
_MARKS = b"$%&*#"
_EDGES = " .,;:!?\"()'-"
_BYTES = {name: np.frombuffer(own, np.uint8) for name, own in {
    "upper": bytes(range(65, 91)), "digit": b"0123456789", "bar": b"|", "call": b"!", "sign": bytes(c for c in range(33, 127) if not chr(c).isalnum()),
}.items()}


def digests(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def lexicon_places(words: pa.Array, known: np.ndarray | None = None) -> np.ndarray:
    """Place of each word in the lexicon: lower case, without marks at its ends.

    `known` are digests of the words, which must differ; most words are plain as they stand.
    """
    plain = pc.utf8_trim(pc.utf8_lower(words), characters=_EDGES)
    if known is None:
        plain = plain.dictionary_encode()
        return (digests(plain.dictionary) % np.uint64(LEXICON)).astype(np.int64)[plain.indices.to_numpy()]
    found = known.copy()
    other = pc.not_equal(plain, words).to_numpy(zero_copy_only=False)
    rest = plain.filter(pa.array(other)).dictionary_encode()
    found[other] = digests(rest.dictionary)[rest.indices.to_numpy()]
    return (found % np.uint64(LEXICON)).astype(np.int64)


def last_bytes(words: pa.Array) -> np.ndarray:
    """The last byte of each word, none of which is empty."""
    if not len(words):
        return np.empty(0, np.uint8)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2], np.uint8)[offsets[1:] - 1]


def features(texts: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of words, and shape, lexicon sums and hashed word frequencies, of each text of a slice."""
    count = len(texts)
    offsets, words = split_words(pa.array(texts, pa.string()), lower=False)
    sizes = np.diff(offsets)
    n = np.maximum(1, sizes).astype(float)
    coded = words.dictionary_encode()
    own = digests(coded.dictionary)
    codes, owner = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(count), sizes)
    bucket = (own % np.uint64(HASHED)).astype(np.int64)
    marked = np.isin(last_bytes(coded.dictionary), np.frombuffer(_MARKS, np.uint8)).astype(float)
    hashed = np.bincount(owner * HASHED + bucket[codes], minlength=count * HASHED).reshape(count, HASHED)
    pairs, times = np.unique(owner * max(1, len(own)) + codes, return_counts=True)
    holder = pairs // max(1, len(own))
    distinct, most = np.bincount(holder, minlength=count), np.zeros(count)
    first = np.flatnonzero(np.diff(holder, prepend=-1))  # pairs are sorted by their text
    if len(first):
        most[holder[first]] = np.maximum.reduceat(times, first)
    bytes_of = np.array([np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256) for t in texts]).reshape(count, 256)
    chars = np.maximum(1, bytes_of.sum(axis=1)).astype(float)
    of = {name: bytes_of[:, places].sum(axis=1) for name, places in _BYTES.items()}
    lines = [[line for line in t.split("\n") if line] for t in texts]
    n_lines = np.array([len(x) for x in lines], float)
    other = np.array([len(set(x)) for x in lines], float)
    shape = [
        np.log1p(sizes), chars / n / 10, of["sign"] / chars * 10, of["upper"] / chars, of["digit"] / chars * 10, distinct / n, most / n,
        np.log1p(n_lines), 1 - other / np.maximum(1, n_lines), of["bar"] / n, of["call"] / n, np.bincount(owner, marked[codes], count) / n,
    ]
    found = lexicon_places(coded.dictionary, own)[codes]
    for weights in lexicon:
        total = np.bincount(owner, weights[found], count)
        shape += [total / np.sqrt(n), np.log1p(total), total / n * 10]
    return sizes, np.concatenate([np.array(shape).T.reshape(count, len(shape)), np.sqrt(hashed / n[:, None])], axis=1)


def held_places(texts: list[str]) -> list[list[int]]:
    """The places of each text's words, each once."""
    offsets, words = split_words(pa.array(texts, pa.string()), lower=False)
    coded = words.dictionary_encode()
    places = lexicon_places(coded.dictionary)[coded.indices.to_numpy()]
    return [np.unique(places[b:e]).tolist() for b, e in zip(offsets, offsets[1:], strict=False)]


def word_lexicon(counts: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Log odds of each place for each domain against the others, 0 where too weak; counts are (domain, place)."""
    rest, others = counts.sum(0) - counts, documents.sum() - documents
    odds = np.log((counts + 0.5) / (documents + 1)[:, None]) - np.log((rest + 0.5) / (others + 1)[:, None])
    return np.where((counts >= MIN_DOCUMENTS) & (odds > np.log(MIN_ODDS)), odds, 0.0).astype(np.float32)


def softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)


@dataclass
class Mixture:
    """Classifier, and the multipliers from which a document's rate follows."""

    domains: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    lexicon: np.ndarray
    multipliers: np.ndarray | None = None
    residual: float = 0.0

    def posteriors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokens, given = features(texts, self.lexicon)
        return tokens.astype(float), softmax(given @ self.weights.T + self.bias)

    def rates(self, tokens: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        if self.multipliers is None:
            return np.ones(len(tokens))
        return np.maximum(0.0, 1.0 - (tokens[:, None] * posterior) @ self.multipliers)


def domain_labels(labels: DataFrame) -> DataFrame:
    """Domain of each labelled document: toxic before poor (quality 0) before clean."""
    toxic, quality = F.max(F.col("toxic").cast("int")), F.min(F.col("quality").cast("int"))
    return labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.when(toxic > 0, "toxic").when(quality == 0, "poor").when(quality > 0, "clean").alias("domain")
    )


def fit_classifier(
    docs: DataFrame, labelled: DataFrame, domains: tuple[str, ...] = DOMAINS, id_col: str = "doc_id", text_col: str = "text",
    training_rows: int = TRAINING_ROWS,
) -> Mixture:
    """Multinomial logistic regression on a bounded sample of labelled (doc_id, domain) rows.

    Only that sample, at most `training_rows` rows, is broadcast.  Null ids and
    domains not listed are ignored; without two domains the priors are used.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    code = F.array_position(F.lit(list(domains)), F.col("domain")) - 1
    sample = labelled.select(F.col("doc_id").alias("_id"), code.cast("double").alias("label")).filter("label >= 0 AND _id IS NOT NULL")
    sample = stored(sample.orderBy(F.xxhash64("_id"), "_id").limit(training_rows), "mixing-sample")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "_id")
    # words are counted in two folds; a row's lexicon comes from the fold that it isn't in
    rows = stored(rows.select((F.xxhash64("_id", F.lit(1)) % 2 == 0).cast("int").alias("fold"), F.col("label").cast("int").alias("label"), "text"), "mixing-rows")
    counts, documents = np.zeros((2, len(domains), LEXICON)), np.zeros((2, len(domains)))
    for r in rows.groupBy("fold", "label").count().collect():
        documents[r["fold"], r["label"]] = r["count"]
    places = attach(rows, "text", "places array<int>", lambda texts: [held_places(texts)]).select("fold", "label", F.explode("places").alias("place"))
    for r in places.groupBy("fold", "label", "place").agg(F.count(F.lit(1)).alias("n")).where("n > 1").toLocalIterator():
        counts[r["fold"], r["label"], r["place"]] = r["n"]
    other = [word_lexicon(counts[1 - f], documents[1 - f]) for f in (0, 1)]
    lexicon = word_lexicon(counts.sum(0), documents.sum(0))

    def featured(own: np.ndarray):
        return lambda texts: [features(texts, own)[1].tolist()]

    parts = [attach(rows.where(F.col("fold") == f).select("label", "text"), "text", "features array<double>", featured(other[f])) for f in (0, 1)]
    given = stored(parts[0].unionByName(parts[1]).select("label", array_to_vector("features").alias("features")), "mixing-features")
    seen = {int(r.label): r["count"] for r in given.groupBy("label").count().collect()}
    size = features([""], lexicon)[1].shape[1]
    weights, bias = np.zeros((len(domains), size)), np.full(len(domains), -30.0)
    for place, n in seen.items():
        bias[place] = np.log(n)
    if len(seen) > 1:
        model = LogisticRegression(family="multinomial", maxIter=40, regParam=PENALTY).fit(given)
        fitted = model.coefficientMatrix.toArray()
        for place in seen:
            weights[place], bias[place] = fitted[place], model.interceptVector[place]
    elif not seen:
        bias[:] = 0.0
    discard(sample, rows, given)
    return Mixture(domains, weights, bias, lexicon)


def fit_rates(docs: DataFrame, mixture: Mixture, targets: Mapping[str, float] = TARGETS, text_col: str = "text", steps: int = STEPS) -> Mixture:
    """Fit nonnegative rates so that expected domain tokens match the targets.

    Targets are shares of the token total of `docs` and are scaled to sum to 1.
    Of all rates that match them, those nearest to 1 are found.  A domain with next
    to no tokens stays unmatched, as do targets that no rates reach; `residual` tells
    the gap that is left as a share of all tokens.
    """
    k = len(mixture.domains)
    classifier = Mixture(mixture.domains, mixture.weights, mixture.bias, mixture.lexicon)

    def shares(texts: list[str]) -> list[list]:
        tokens, posterior = classifier.posteriors(texts)
        return [tokens.tolist(), posterior.tolist()]

    rows = attach(docs.select(F.col(text_col).alias("text")), "text", "tokens double, posterior array<double>", shares)
    table = stored(rows.select("tokens", "posterior"), "mixing-shares")
    mass = table.agg(F.sum("tokens"), *(F.sum(F.col("tokens") * F.col("posterior")[i]) for i in range(k))).first()
    total = mass[0] or 0.0
    mixture.multipliers, mixture.residual = None, 0.0
    if not total:
        return mixture
    wanted = np.array([max(0.0, targets.get(d, 0.0)) for d in mixture.domains])
    wanted = wanted / (wanted.sum() or 1.0) * total
    matched = np.flatnonzero(np.array(mass[1:], float) > LEAST_SHARE * total)
    m = len(matched)
    width = 1 + m + m * m + k

    def partial(batches: Iterable[pa.RecordBatch], tried: np.ndarray) -> Iterator[pa.RecordBatch]:
        """For each set of multipliers: half the squared rates, tokens of the matched domains, their products, tokens of all."""
        sums = np.zeros((len(tried), width))
        for batch in batches:
            tokens = batch.column("tokens").to_numpy()
            own = tokens[:, None] * batch.column("posterior").flatten().to_numpy().reshape(-1, k)
            near = own[:, matched]
            for n, multipliers in enumerate(tried):
                rate = np.maximum(0.0, 1.0 - near @ multipliers)
                inside = near[rate > 0]
                sums[n] += np.concatenate([[rate @ rate / 2], rate @ near, (inside.T @ inside).ravel(), rate @ own])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["i", "v"])

    def evaluated(tried: np.ndarray) -> np.ndarray:
        found = table.mapInArrow(lambda it: partial(it, tried), "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
        sums = np.zeros(len(tried) * width)
        for r in found.collect():  # a few numbers per step length
            sums[r["i"]] = r["v"]
        return sums.reshape(len(tried), width)

    at = np.zeros(m)
    now = evaluated(at[None])[0]
    for _ in range(steps):
        gap, products = now[1 : 1 + m] - wanted[matched], now[1 + m : 1 + m + m * m].reshape(m, m)
        if np.abs(gap).sum() <= TOLERANCE * total:
            break
        scale = 1 / np.sqrt(np.maximum(np.diag(products), 1e-300))
        step = scale * (np.linalg.pinv(products * scale[:, None] * scale, rcond=1e-14, hermitian=True) @ (scale * gap))
        tried = at + LENGTHS[:, None] * step
        found = evaluated(tried)
        value = found[:, 0] + tried @ wanted[matched]
        best = int(value.argmin())
        if not value[best] < now[0] + at @ wanted[matched]:
            break
        at, now = tried[best], found[best]
    mixture.multipliers = np.zeros(k)
    mixture.multipliers[matched] = at
    mixture.residual = float(np.abs(now[1 + m + m * m :] - wanted).sum() / total)
    discard(table)
    return mixture


def apply_rates(docs: DataFrame, mixture: Mixture, text_col: str = "text") -> DataFrame:
    """All rows and columns with n_tokens, posterior, rate and copies.

    copies realises the rate: its whole part, and one more for a share of the
    documents, chosen by a hash of the text, that equals the fraction.  Null and empty
    texts have no tokens and rate 1; equal texts get equal results.
    """

    def made(texts: list[str]) -> list[list]:
        tokens, posterior = mixture.posteriors(texts)
        rate = mixture.rates(tokens, posterior)
        chance = np.array([xxhash.xxh64_intdigest(t, 1) for t in texts], np.float64) / 2.0**64
        copies = np.floor(rate) + (chance < rate - np.floor(rate))
        return [tokens.astype(np.int64).tolist(), posterior.tolist(), rate.tolist(), copies.astype(np.int64).tolist()]

    return attach(docs, text_col, "n_tokens long, posterior array<double>, rate double, copies long", made)


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """Fit classifier and rates on `docs` and return its rows with their rates."""
    return apply_rates(docs, fit_rates(docs, fit_classifier(docs, domain_labels(labels)), targets))
