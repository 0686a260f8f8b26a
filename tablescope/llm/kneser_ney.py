"""Interpolated modified Kneser-Ney bigram model, counted in Spark.

Words are hashed to 64 bits; the rank of a hash among all words is the word's
id.  Bigrams are packed pairs of ids.  Tasks fold the counts of a slice of text
and send one compressed block per shard; a shard merges its blocks and writes
sorted arrays to the shared folder.  Workers memory-map these files and look up
sorted batches of keys.  The number of shards grows with the text, so a shard
has a bounded share of it, and only sums reach the driver.

Shards split the range of word hashes, so a frequent word falls into one shard:
as a context it costs one entry per distinct continuation, not per occurrence.
"""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.functions.session import discard, scratch_path, stored
from tablescope.llm.words import sliced, split_words

#: Text bytes folded at once, and text bytes a shard stands for.
FOLD_BYTES = 12 << 20
SHARD_BYTES = 12 << 20
#: The end of a text is a token of its own; no word contains a zero byte and a space.
END = np.uint64(xxhash.xxh64_intdigest(b"\0 end"))
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def pack(values: np.ndarray) -> bytes:
    """Rising integers: differences, grouped by byte, compressed."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    return zstandard.compress(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view(np.uint64).ravel()


def folded(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their summed counts."""
    if counts is None:
        found, sums = np.unique(keys, return_counts=True)
        return found, sums.astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[begins], np.add.reduceat(counts[order], begins) if len(keys) else counts


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes >> _32) * np.uint64(shards)) >> _32).astype(np.int64)


# ---- files in the shared folder -------------------------------------------------


def _write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays one after another in one file; a repeated attempt replaces the file by an equal one."""
    system, path = pafs.FileSystem.from_uri(folder)
    head = ",".join(f"{k}:{v.dtype.str}:{len(v)}" for k, v in arrays.items()).encode()
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(len(head).to_bytes(8, "little") + head + b"\0" * (-len(head) % 8))
        for values in arrays.values():
            data = np.ascontiguousarray(values)
            out.write(data.data.cast("B") if len(data) else b"")
            out.write(b"\0" * (-data.nbytes % 8))
    system.move(draft, f"{path}/{name}")


@functools.cache
def _local_folder() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="model-")


@functools.lru_cache(maxsize=4096)
def _mapped(folder: str, name: str) -> dict[str, np.ndarray]:
    """Memory-mapped arrays of a file; a store that can't be mapped is copied once per worker."""
    system, path = pafs.FileSystem.from_uri(folder)
    if isinstance(system, pafs.LocalFileSystem):
        place = f"{path}/{name}"
    else:
        place = os.path.join(_local_folder().name, f"{xxhash.xxh64_hexdigest(folder)}-{name}")
        if not os.path.exists(place):
            with system.open_input_stream(f"{path}/{name}") as source, open(place + ".part", "wb") as target:
                while data := source.read(1 << 20):
                    target.write(data)
            os.replace(place + ".part", place)
    whole = np.memmap(place, np.uint8, "r")
    size = int.from_bytes(whole[:8].tobytes(), "little")
    at, out = 8 + size + -size % 8, {}
    for part in whole[8 : 8 + size].tobytes().decode().split(","):
        key, kind, n = part.split(":")
        nbytes = int(n) * np.dtype(kind).itemsize
        out[key] = whole[at : at + nbytes].view(kind)
        at += nbytes + -nbytes % 8
    return out


# ---- tokens ---------------------------------------------------------------------


@dataclass
class Tokens:
    """Tokens of a slice: distinct hashes, the code of each token and its document's number."""

    hashes: np.ndarray
    codes: np.ndarray
    owner: np.ndarray
    first: np.ndarray


def tokens_of(texts: pa.Array) -> Tokens:
    """Words in lower case, then one end, for every text of a slice."""
    offsets, words = split_words(texts, lower=True)
    coded = words.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64)
    n = len(offsets) - 1
    sizes = np.diff(offsets) + 1
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    codes = np.full(int(sizes.sum()), len(hashes), np.int64)
    inside = np.ones(len(codes), bool)
    inside[first + sizes - 1] = False
    codes[inside] = coded.indices.to_numpy()
    return Tokens(np.append(hashes, END), codes, np.repeat(np.arange(n), sizes), first)


def _blocks(shards: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per shard from keys sorted by shard, then key."""
    cuts = np.flatnonzero(np.diff(shards)) + 1
    rows = [(int(s[0]), pack(k), pack_counts(c)) for s, k, c in zip(np.split(shards, cuts), np.split(keys, cuts), np.split(counts, cuts), strict=True) if len(s)]
    kinds = (pa.int32(), pa.binary(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["shard", "keys", "counts"])


BLOCK = "shard int, keys binary, counts binary"


def _word_blocks(batches: Iterable[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", FOLD_BYTES):
        tokens = tokens_of(batch.column("text"))
        order = np.argsort(tokens.hashes)
        hashes, counts = tokens.hashes[order], np.bincount(tokens.codes, minlength=len(order))[order].astype(np.uint64)
        yield from _blocks(shard_of(hashes, shards), hashes, counts)


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Folded keys and counts of every shard in a partition sorted by shard."""
    shard, held, size = None, [], 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        return folded(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

    for batch in batches:
        for own, keys, counts in zip(*(batch.column(n).to_pylist() for n in ("shard", "keys", "counts")), strict=True):
            if own != shard:
                if held:
                    yield (shard, *fold())
                shard, held, size = own, [], 0
            held.append((unpack(keys), unpack_counts(counts)))
            size += len(held[-1][0])
            if size > 4_000_000 and len(held) > 1:  # keep what is held near the number of distinct keys
                held = [fold()]
                size = len(held[0][0]) // 2
    if held:
        yield (shard, *fold())


def _long_rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(r[i]) for r in rows], pa.int64()) for i in range(len(names))], names=names)


def _write_words(batches: Iterable[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for shard, hashes, counts in _merged(batches):
        _write(folder, f"words-{shard}", {"hash": hashes, "count": counts})
        yield _long_rows([(shard, len(hashes), counts.sum())], ["shard", "words", "tokens"])


# ---- the model ------------------------------------------------------------------


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of entries seen once to four times.

    Where such a number is 0 the closed form has no value; half a count per step is taken.
    """
    if min(n[:4], default=0) <= 0:
        return 0.5, 1.0, 1.5
    ratio = n[0] / (n[0] + 2 * n[1])
    return tuple(min(float(i), max(0.0, i - (i + 1) * ratio * n[i] / n[i - 1])) for i in (1, 2, 3))


@dataclass
class Model:
    """What workers need beside the files: where each shard's ids begin, and the sums."""

    folder: str
    starts: np.ndarray
    tokens: int
    vocabulary: int
    pairs: int = 0
    bigram_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    word_discounts: tuple[float, float, float] = (0.5, 1.0, 1.5)
    word_rest: float = 1.0

    @property
    def shards(self) -> int:
        return len(self.starts) - 1

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted hashes, -1 for unknown words."""
        out = np.full(len(hashes), -1, np.int64)
        owners = shard_of(hashes, self.shards)
        cuts = np.searchsorted(owners, np.arange(self.shards + 1))
        for shard in np.unique(owners):
            if self.starts[shard] == self.starts[shard + 1]:
                continue
            own = _mapped(self.folder, f"words-{shard}")["hash"]
            wanted = hashes[cuts[shard] : cuts[shard + 1]]
            at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            out[cuts[shard] : cuts[shard + 1]] = np.where(own[at] == wanted, at + self.starts[shard], -1)
        return out

    def by_id(self, kind: str, field: str, ids: np.ndarray) -> np.ndarray:
        """Values of an array that runs over the ids, for sorted ids of known words."""
        cuts = np.searchsorted(ids, self.starts)
        parts = [_mapped(self.folder, f"{kind}-{s}")[field][ids[cuts[s] : cuts[s + 1]] - self.starts[s]] for s in range(self.shards) if cuts[s] < cuts[s + 1]]
        return np.concatenate(parts) if parts else np.empty(0)

    def word_shard(self, ids: np.ndarray) -> np.ndarray:
        """Shard of ids; the beginning of a text has the id after the last word and falls into the last shard."""
        return np.clip(np.searchsorted(self.starts, ids, "right") - 1, 0, self.shards - 1)

    def word_chance(self, seen: np.ndarray) -> np.ndarray:
        """Lowest order from the number of distinct predecessors, 0 for unknown words."""
        if not self.pairs:
            return np.full(len(seen), 1.0 / (self.vocabulary + 1))
        off = np.array([0.0, *self.word_discounts])[np.minimum(seen, 3).astype(np.int64)]
        return np.maximum(seen - off, 0.0) / self.pairs + self.word_rest / (self.vocabulary + 1)


def _bigrams(tokens: Tokens, ids: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of predecessor and word of every token; `begin` precedes the first of a text."""
    words = ids[tokens.codes]
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[tokens.first] = begin
    return before, words


def _token_ids(tokens: Tokens, model: Model) -> np.ndarray:
    order = np.argsort(tokens.hashes)
    ids = np.empty(len(order), np.int64)
    ids[order] = model.ids(tokens.hashes[order])
    return ids


def _bigram_blocks(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", FOLD_BYTES):
        tokens = tokens_of(batch.column("text"))
        before, words = _bigrams(tokens, _token_ids(tokens, model), model.vocabulary)
        keys, counts = folded(before.astype(np.uint64) << _32 | words.astype(np.uint64))
        yield from _blocks(model.word_shard((keys >> _32).astype(np.int64)), keys, counts)


def _write_bigrams(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for shard, keys, counts in _merged(batches):
        before = (keys >> _32).astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], np.diff(before) != 0]))
        large = np.flatnonzero(counts >= 255)
        arrays = {
            "key": keys, "count": np.minimum(counts, 255).astype(np.uint8), "large": large.astype(np.uint64), "large_count": counts[large],
            "context": before[begins].astype(np.uint64), "total": np.add.reduceat(counts, begins),
        }
        for name, own in (("once", counts == 1), ("twice", counts == 2), ("more", counts > 2)):
            arrays[name] = np.add.reduceat(own.astype(np.uint32), begins)
        _write(model.folder, f"bigrams-{shard}", arrays)
        words, seen = folded(keys & _LOW)
        tally = [int((counts == n).sum()) for n in (1, 2, 3, 4)]
        for block in _blocks(model.word_shard(words.astype(np.int64)), words, seen):
            rows = block.num_rows
            extra = [pa.array([n] + [0] * (rows - 1), pa.int64()) for n in (*tally, len(keys))]
            yield pa.RecordBatch.from_arrays([*block.columns, *extra], names=["shard", "keys", "counts", "n1", "n2", "n3", "n4", "pairs"])


def _write_seen(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for shard, words, seen in _merged(batches):
        dense = np.zeros(int(model.starts[shard + 1] - model.starts[shard]), np.uint64)
        dense[words.astype(np.int64) - model.starts[shard]] = seen
        _write(model.folder, f"seen-{shard}", {"seen": dense})
        yield _long_rows([[int((dense == n).sum()) for n in (1, 2, 3, 4)] + [int((dense > 2).sum())]], ["n1", "n2", "n3", "n4", "more"])


def _by_shard(blocks: DataFrame, shards: int) -> DataFrame:
    return blocks.repartition(shards, "shard").sortWithinPartitions("shard")


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Count a model over all rows of `docs`; null texts are empty, every text ends with one end token.

    An empty table gives a model without words.  Repeated rows count each time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shards = int(size // SHARD_BYTES) + 1
    folder = scratch_path(spark, "kneser-ney")
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    words = _by_shard(rows.mapInArrow(lambda it: _word_blocks(it, shards), BLOCK), shards)
    found = words.mapInArrow(lambda it: _write_words(it, folder), "shard long, words long, tokens long").collect()
    sizes = np.zeros(shards + 1, np.int64)
    for row in found:
        sizes[row.shard + 1] = row.words
    starts = np.cumsum(sizes)
    model = Model(folder, starts, sum(r.tokens for r in found), int(starts[-1]))
    if not model.tokens:
        return model
    if model.vocabulary >= (1 << 32) - 1:
        raise ValueError("Bigrams are packed from 32-bit word ids; the vocabulary is larger.")
    bigrams = _by_shard(rows.mapInArrow(lambda it: _bigram_blocks(it, model), BLOCK), shards)
    schema = BLOCK + ", n1 long, n2 long, n3 long, n4 long, pairs long"
    seen = stored(bigrams.mapInArrow(lambda it: _write_bigrams(it, model), schema), "kneser-ney-seen")
    *tally, pairs = seen.agg(*(F.sum(c) for c in ("n1", "n2", "n3", "n4", "pairs"))).first()
    model.pairs, model.bigram_discounts = int(pairs), discounts([int(n) for n in tally])
    written = _by_shard(seen.select("shard", "keys", "counts"), shards).mapInArrow(lambda it: _write_seen(it, model), "n1 long, n2 long, n3 long, n4 long, more long")
    *tally, more = (int(n) for n in written.agg(*(F.sum(c) for c in ("n1", "n2", "n3", "n4", "more"))).first())
    discard(seen)
    model.word_discounts = discounts(tally)
    model.word_rest = sum(d * n for d, n in zip(model.word_discounts, (tally[0], tally[1], more), strict=True)) / model.pairs
    return model


def _bigram_chance(model: Model, before: np.ndarray, words: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probability of each (predecessor, word); equal pairs are looked up once."""
    if not model.pairs:
        return lower
    keys, first, back = np.unique(before.astype(np.uint64) << _32 | (words & 0xFFFFFFFF).astype(np.uint64), return_index=True, return_inverse=True)
    context, base = before[first], lower[first]
    chance = base.copy()
    owners = model.word_shard(context)
    unknown = context < 0
    off = np.array([0.0, *model.bigram_discounts])
    for shard in np.unique(owners[~unknown]):
        own = np.flatnonzero((owners == shard) & ~unknown)
        data = _mapped(model.folder, f"bigrams-{shard}")
        at = np.minimum(np.searchsorted(data["context"], context[own].astype(np.uint64)), len(data["context"]) - 1)
        held = data["context"][at] == context[own].astype(np.uint64)
        own, at = own[held], at[held]
        total = data["total"][at].astype(float)
        rest = (off[1] * data["once"][at] + off[2] * data["twice"][at] + off[3] * data["more"][at]) / total
        place = np.minimum(np.searchsorted(data["key"], keys[own]), len(data["key"]) - 1)
        count = np.where(data["key"][place] == keys[own], data["count"][place], 0).astype(np.int64)
        big = np.flatnonzero(count == 255)
        if len(big):
            count[big] = data["large_count"][np.searchsorted(data["large"], place[big].astype(np.uint64))]
        chance[own] = np.maximum(count - off[np.minimum(count, 3)], 0.0) / total + rest * base[own]
    return chance[back]


def _scores(batches: Iterable[pa.RecordBatch], model: Model, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", FOLD_BYTES):
        tokens = tokens_of(batch.column("text"))
        ids = _token_ids(tokens, model)
        known = np.flatnonzero(ids >= 0)
        known = known[np.argsort(ids[known])]
        count, seen = np.zeros(len(ids)), np.zeros(len(ids))
        count[known] = model.by_id("words", "count", ids[known])
        if model.pairs:
            seen[known] = model.by_id("seen", "seen", ids[known])
        n = batch.num_rows
        base = np.log10((count + 1) / (model.tokens + (model.vocabulary + 1)))[tokens.codes]
        before, words = _bigrams(tokens, ids, model.vocabulary)
        chance = _bigram_chance(model, before, words, model.word_chance(seen)[tokens.codes])
        sums = [np.bincount(tokens.owner, w, n) for w in (base, np.log10(chance))]
        made = [
            np.bincount(tokens.owner, minlength=n), np.bincount(tokens.owner, count[tokens.codes] > 0, n).astype(np.int64),
            np.full(n, model.tokens), *sums,
        ]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, k) for v, k in zip(made, kinds, strict=True))], names=names)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the kept columns, n_tokens, n_known, train_tokens, base_score and score.

    score is the model's log10 probability of the text with its end, base_score
    that of the add-one unigram model.  An empty or null text is its end alone.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    made = _parse_datatype_string("n_tokens long, n_known long, train_tokens long, base_score double, score double")
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = StructType([*rows.drop("text").schema.fields, *made.fields])
    return rows.mapInArrow(lambda it: _scores(it, model, out.names), out)
