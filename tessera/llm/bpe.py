"""BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never be joined by a
merge, so a cut between the two bytes is certain. White space is the main case (no token of a word
vocabulary holds an inner space); inside words, every other absent pair cuts as well. The fragments
between the cuts are encoded independently of each other, each distinct one once for as long as it
stays in a bounded cache, and their ids are concatenated.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS

#: Fragments (and words) in each of the two generations that a worker remembers.
CACHE_FRAGMENTS = 280_000
#: Longer fragments are encoded but not remembered.
CACHE_BYTES = 48

#: Latin letters that normalisation leaves as they are, and marks that may follow them in a fragment:
#: such a fragment is one pre-token of letters and one of marks, so the general splitting isn't needed.
PLAIN_MARKS = frozenset("!\"#$%&()*+,-./:;=?@[]^_`{}~|")
PLAIN = re.compile("([a-zA-ZÀ-ÖØ-öø-įı-ňŊ-ſ]+)([" + re.escape("".join(sorted(PLAIN_MARKS))) + "]*)")

_encoders: dict[str, "FragmentEncoder"] = {}


class Recent:
    """The CACHE_FRAGMENTS to twice as many entries used last, in two generations."""

    def __init__(self):
        self.new: dict = {}
        self.old: dict = {}

    def get(self, key):
        out = self.new.get(key)
        if out is None and (out := self.old.get(key)) is not None:
            self.put(key, out)
        return out

    def put(self, key, value) -> None:
        if len(self.new) >= CACHE_FRAGMENTS:
            self.old = dict(self.new)
            self.new.clear()
        self.new[key] = value


def byte_char(byte: int) -> str:
    """The character that stands for a byte in a byte-level vocabulary: itself if printable, else moved up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return chr(byte) if byte in shown else chr(256 + [b for b in range(256) if b not in shown].index(byte))


def encoder(path: str) -> "FragmentEncoder":
    """The encoder for a tokenizer file, built once in each Python worker."""
    if path not in _encoders:
        _encoders[path] = FragmentEncoder(path)
    return _encoders[path]


class FragmentEncoder:
    """Encodes whole texts through certain cuts; equals the tokenizers library on the uncut text.

    ``suffix`` is the vocabulary's end-of-word mark. Only the last fragment of a word may end with
    it, so the other fragments go through a copy of the model that has no such mark.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.special = [x["content"] for x in spec["added_tokens"]]
        words = spec["model"]["vocab"]
        bare = [w.removesuffix(self.suffix) if self.suffix else w for w in words]
        self.pairs = {w[i : i + 2] for w in bare for i in range(len(w) - 1)}
        inner = dict(spec, added_tokens=[], model=dict(spec["model"], end_of_word_suffix=None))
        self.inner = Tokenizer.from_str(json.dumps(inner)).model
        self.model = self.library.model
        size = 1 + max([*words.values(), *(x["id"] for x in spec["added_tokens"])])
        self.tokens = [b""] * size
        for w, i in words.items():
            self.tokens[i] = w.encode()
        for x in spec["added_tokens"]:
            self.tokens[x["id"]] = x["content"].encode()
        self.byte_chars = {b: byte_char(b) for b in range(128, 256)}
        self.plain = PLAIN.fullmatch if all("<" in x for x in self.special) else lambda _: None
        self.fragments, self.words = Recent(), Recent()

    def cuts(self, word: str) -> list[str]:
        """Split a pre-token, written one character a byte, wherever the pair is in no token."""
        if self.pairs.issuperset(map(add, word, word[1:])):
            return [word]
        out, start = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.pairs:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def word(self, word: str) -> bytes:
        """Ids of one pre-token (written one character a byte), as little-endian unsigned 32-bit integers."""
        *first, last = self.cuts(word)
        ids = [t.id for part in first for t in self.inner.tokenize(part)]
        ids += [t.id for t in self.model.tokenize(last)]
        out = array("I", ids).tobytes()
        if len(word) <= CACHE_BYTES:
            self.words.put(word, out)
        return out

    def fragment(self, fragment: bytes) -> bytes:
        """Ids of a run without ASCII white space, as little-endian unsigned 32-bit integers."""
        if (out := self.fragments.old.get(fragment)) is not None:
            self.fragments.put(fragment, out)
            return out
        text = fragment.decode("utf-8", "replace")
        known = self.words.get
        if plain := self.plain(text):
            letters, marks = plain.groups()
            letters = letters.lower()
            if not letters.isascii():
                letters = letters.encode().decode("latin-1").translate(self.byte_chars)
            out = known(letters) or self.word(letters)
            if marks:
                out += known(marks) or self.word(marks)
        elif any(s in text for s in self.special):
            out = array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        else:
            normal = self.library.normalizer.normalize_str(text)
            out = b"".join([known(w) or self.word(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)])
        if len(fragment) <= CACHE_BYTES:
            self.fragments.put(fragment, out)
        return out

    def encode(self, text: bytes | str | None) -> bytes:
        """Ids of a whole text (null: empty) as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        data = text.encode("utf-8", "replace") if isinstance(text, str) else text
        known, miss = self.fragments.new.get, self.fragment
        return b"".join([known(x) or miss(x) for x in data.split()])

    def decode(self, ids: list[int]) -> str:
        """Token strings joined by one space, special tokens included, as a model without decoder does."""
        return b" ".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


def encode_decode(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True
) -> DataFrame:
    """``id_col``, ``ids`` (array of int) and ``decoded`` (text of those ids) for every row of ``docs``.

    Null or empty texts give an empty array and an empty text; repeated rows and null ids stay as they
    are; other columns of ``docs``, whatever their names, are not read. No shuffle: each row is encoded
    where it is read, in slices of bounded size. ``decode=False`` leaves ``decoded`` null.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                coded = [np.frombuffer(own.encode(x), dtype="<i4") for x in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, coded)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(coded)))
                text = pa.array([own.decode(x.tolist()) if decode else None for x in coded], type=pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, text], names=["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
