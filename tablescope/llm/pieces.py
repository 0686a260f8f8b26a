"""Texts as token ids of a public vocabulary, cut into pieces of bounded length.

The vocabulary's own tokenizer decides every id.  Where its tokens never cross
white space, a text's ids are those of its words one after the other, and each
distinct word of a task is encoded once; any other vocabulary gets whole texts.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from tokenizers import Tokenizer

from tablescope.llm.words import sliced, split_words

#: Words, and parts of words, whose ids a task keeps; beyond, it starts afresh.
KEPT_WORDS, KEPT_PARTS = 500_000, 200_000
#: Id that ends every document.
END = 1
# Normaliser and pattern of the vocabulary whose words are encoded one by one.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters of the plain words, and what the tokenizer's pattern makes of them in lower case.
_LETTERS = "À-ÖØ-öø-ÿ"
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary; visible ones stand for themselves."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)}


_BYTES = _byte_letters()


def drops_white_space(data: str) -> bool:
    """Whether normaliser and pattern are those fixed above, so that words can be encoded one by one."""
    made = json.loads(data)
    steps = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    split = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
    return (made.get("normalizer") or {}).get("normalizers") == NORMALIZERS and steps[0] == split and made["model"]["type"] == "BPE"


@functools.lru_cache(maxsize=2)
def tokenizer(data: str) -> Tokenizer:
    made = Tokenizer.from_str(data)
    made.no_truncation()
    made.no_padding()
    return made


class Encoder:
    """Ids of words, each distinct word encoded once while it is kept.

    Words of printable ASCII and accented Latin letters have no other normal form
    than lower case, so their parts go to the merge rules directly; every other
    word, and one that holds a reserved string, goes through the whole tokenizer.
    """

    def __init__(self, data: str) -> None:
        self.coder, self.by_word = tokenizer(data), drops_white_space(data)
        reserved = [re.escape(t.content) for t in self.coder.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([f"[^!-~{_LETTERS}]", *reserved]))
        self._clear()

    def _clear(self) -> None:
        self.words, self.parts = {"": 0}, {}
        self.flat, self.sizes = array("I", [END]), array("q", [1])

    def _part(self, part: str) -> list[int]:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTES)
        found = self.parts[part] = [t.id for t in self.coder.model.tokenize(letters)]
        return found

    def encode(self, words: list[str]) -> np.ndarray:
        """Numbers of the words in `flat` and `sizes`; the empty word stands for the end of a text."""
        if len(self.words) > KEPT_WORDS:
            self._clear()
        if len(self.parts) > KEPT_PARTS:
            self.parts.clear()
        known, parts, odd = self.words, self.parts, []
        numbers = list(map(known.get, words))
        for at in [at for at, number in enumerate(numbers) if number is None]:
            word = words[at]
            if self.odd.search(word):
                odd.append(at)
                continue
            ids = [i for p in _PARTS.findall(word.lower()) for i in (parts.get(p) or self._part(p))]
            known[word] = numbers[at] = len(self.sizes)
            self.flat.extend(ids)
            self.sizes.append(len(ids))
        for at, found in zip(odd, self.coder.encode_batch([words[at] for at in odd], add_special_tokens=False), strict=True):
            known[words[at]] = numbers[at] = len(self.sizes)
            self.flat.extend(found.ids)
            self.sizes.append(len(found.ids))
        return np.array(numbers, np.int64)


def text_ids(texts: pa.Array, encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) into the flat ids of all texts, every text closed by END."""
    if not encoder.by_word:
        found = [[*e.ids, END] for e in encoder.coder.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        offsets = np.cumsum([0, *map(len, found)])
        return offsets, np.fromiter((i for ids in found for i in ids), "<u4", int(offsets[-1]))
    offsets, words = split_words(texts, lower=False)
    coded = words.dictionary_encode()
    numbers = encoder.encode(coded.dictionary.to_pylist())
    # the end of a text counts as a word of its own, number 0
    order = np.insert(numbers[coded.indices.to_numpy()] if len(words) else numbers, offsets[1:], 0)
    table, sizes = np.array(encoder.flat, "<u4"), np.array(encoder.sizes, np.int64)
    starts = np.cumsum(sizes) - sizes
    taken = sizes[order]
    ends = np.cumsum(taken)
    flat = table[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[order] - (ends - taken), taken)]
    at = offsets + np.arange(len(offsets))  # words and ends before each text
    return np.concatenate([[0], ends])[at], flat


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `capacity` ids: id_col, piece, start, length, ids (binary, little-endian unsigned 32 bits).

    A document is the ids of its whole text and END; only longer ones are cut,
    every piece but the last being full.  Null texts are empty and give the one
    piece END.  Rows with equal or null ids are documents of their own.  Other
    columns are ignored.  `vocabulary` is the path of a tokenizer file on the
    driver, which is read there and broadcast.  No rows move.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        data = file.read()
    if len(data) > 64 << 20:
        raise ValueError("A vocabulary file of more than 64 MB isn't broadcast.")
    sent = spark.sparkContext.broadcast(data)
    kind = docs.schema[id_col].dataType
    schema = "piece int, start long, length long, ids binary"
    out = StructType([StructField(id_col, kind), *StructType.fromDDL(schema).fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in sliced(batches, "_text_"):
            offsets, flat = text_ids(batch.column("_text_"), encoder)
            sizes = np.diff(offsets)
            counts = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = piece * capacity
            length = np.minimum(capacity, sizes[row] - start)
            begin = offsets[row] + start
            ids = [flat[b:e].tobytes() for b, e in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text_")
    return docs.select(F.col(f"`{id_col}`"), text).mapInArrow(run, out)


