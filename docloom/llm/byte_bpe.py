"""Byte-level BPE encoding and decoding over Arrow batches.

The tokenizers library merges; Spark carries the texts.  A text falls into chunks at
spaces that other characters follow, where no match of the splitting pattern
can cross, so a chunk is encoded alike wherever it stands.  Each worker
remembers the chunks it has met (up to a bound) and sends only new ones through the
library, all of a batch at once.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import slices

#: Chunks that one worker remembers, some 150 bytes each; those met later are encoded each time.
REMEMBERED = 200_000
#: Chunks that go through the library as one text.
JOINED = 64
#: Longer chunks are not remembered.
LONGEST = 64
_EMPTY = np.zeros(0, np.int32)
#: A space inside or at the head of wider white space: there the text may only be cut at lone spaces.
_INSIDE = re.compile(r" \s")
_CUT = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def byte_table() -> dict[str, int]:
    """The character that stands for each byte: printable bytes for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in table.values()]
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a vocabulary file; added tokens stand for their own text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    table = byte_table()
    vocabulary = spec["model"]["vocab"]
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    out = [b""] * (max([*vocabulary.values(), *added.values()]) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    for token, i in added.items():
        out[i] = token.encode()
    return out


class Codec:
    """One vocabulary file, loaded once in each worker that encodes.

    With ``special`` the strings of special tokens in a text become those tokens, as the
    library does by itself; without, they are ordinary text.
    """

    def __init__(self, path: str, special: bool = False) -> None:
        # a task has one core: threads of the library would take those of other tasks, and hold memory each
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.lengths = np.array([len(x) for x in token_bytes(path)], np.int64)
        self.known: dict[str, bytes] = {}

    def _merge(self, chunks: list[str]) -> list[bytes]:
        """The ids, as 32-bit bytes, of chunks " x" that may follow each other; they run through the library many to a text."""
        joined = ["".join(chunks[k : k + JOINED]) for k in range(0, len(chunks), JOINED)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        sizes = np.fromiter(map(len, map(str.encode, chunks)), np.int64, len(chunks))
        cuts = (4 * (np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes)) + 1)).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _alone(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null is empty.

        A chunk after a space is known by what follows the space; what begins a
        text is encoded by itself.
        """
        get = self.known.get
        first: list[str] = []
        split: list[list[str]] = []
        found: list[list[bytes | None]] = []
        new: set[str] = set()
        for text in texts:
            if not text:
                parts = [""]
            elif text[-1] == " " or _INSIDE.search(text):
                parts = _CUT.split(text)
            else:
                parts = text.split(" ")
            first.append(parts.pop(0))
            ids = list(map(get, parts))
            if None in ids:
                new.update([p for p, i in zip(parts, ids, strict=True) if i is None])
            split.append(parts)
            found.append(ids)
        fresh: dict[str, bytes] = {}
        odd = [p for p in new if not p or p[0].isspace()]
        even = list(new.difference(odd))
        if even:
            fresh.update(zip(even, self._merge([" " + p for p in even]), strict=True))
        if odd:
            fresh.update(zip(odd, self._alone([" " + p for p in odd]), strict=True))
        out = []
        for head, parts, ids in zip(self._alone(first), split, found, strict=True):
            if None in ids:
                ids = [fresh[p] if i is None else i for p, i in zip(parts, ids, strict=True)]
            out.append(np.frombuffer(b"".join([head, *ids]), np.int32))
        for p, i in fresh.items():
            if len(self.known) >= REMEMBERED:
                break
            if len(p) <= LONGEST:
                self.known[p] = i
        return out

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one character of ``text`` that each id touches; ids that split a character share it."""
        ends = np.cumsum(self.lengths[ids])
        raw = np.frombuffer(text.encode(), np.uint8)
        of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1
        if not len(ids):
            return _EMPTY, _EMPTY
        return of_byte[ends - self.lengths[ids]].astype(np.int32), (of_byte[ends - 1] + 1).astype(np.int32)


@lru_cache(maxsize=4)
def codec(path: str, special: bool = False) -> Codec:
    return Codec(path, special)


def encode(docs: DataFrame, vocabulary: str, *, offsets: bool = False, spans: bool = False) -> DataFrame:
    """``doc_id``, ``ids`` and, on request, ``starts`` and ``ends`` in characters of the text, or what sums them up.

    With ``spans`` that is ``n_split``, the ids that begin inside a character, and ``spans_crc32``,
    of all starts and then all ends as little-endian 32-bit numbers.

    ``vocabulary`` is the path of a byte-level BPE file of the tokenizers library, on
    every worker.  Strings of special tokens are ordinary text.  Null is encoded as
    the empty text, to no id.  Any id may be null or repeated.
    """
    more = (", starts array<int>, ends array<int>" if offsets else "") + (", n_split long, spans_crc32 long" if spans else "")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            ids = own.encode(texts)
            columns = [b.column("doc_id"), ints(ids)]
            names = ["doc_id", "ids"]
            found = [own.offsets(t or "", i) for t, i in zip(texts, ids, strict=True)] if offsets or spans else []
            if offsets:
                columns += [ints([s for s, _ in found]), ints([e for _, e in found])]
                names += ["starts", "ends"]
            if spans:
                columns.append(pa.array([int((s[1:] < e[:-1]).sum()) for s, e in found], pa.int64()))
                columns.append(pa.array([zlib.crc32(e.astype("<i4").tobytes(), zlib.crc32(s.astype("<i4").tobytes())) for s, e in found], pa.int64()))
                names += ["n_split", "spans_crc32"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(apply, f"doc_id long, ids array<int>{more}")


def decode(encoded: DataFrame, vocabulary: str, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``ids`` and the columns ``keep`` as given, ``raw`` (the decoded bytes) and ``text`` (those bytes as UTF-8).

    Decoding works on bytes, so a character that several ids split comes back whole;
    a sequence cut inside a character yields the replacement character in ``text`` only.
    Null ids decode to no bytes.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                col = part.column("ids")
                flat = col.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(np.nan_to_num(np.array([0 if n is None else n for n in pa.compute.list_value_length(col).to_pylist()])))
                raw, at_id = [], 0
                for e in ends.astype(np.int64):
                    raw.append(b"".join([table[i] for i in flat[at_id:e]]))
                    at_id = e
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), col, *[part.column(c) for c in keep], pa.array(raw, pa.binary())], names=["doc_id", "ids", *keep, "raw"])

    import pyarrow.compute  # noqa: F401

    more = "".join(f", {c} {encoded.schema[c].dataType.simpleString()}" for c in keep)
    rows = encoded.select("doc_id", "ids", *keep).mapInArrow(apply, f"doc_id long, ids array<int>{more}, raw binary")
    return rows.withColumn("text", F.decode(F.col("raw"), "UTF-8"))


def ints(values: list[np.ndarray]) -> pa.Array:
    """A list<int> array without a Python object for each number."""
    off = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=off[1:])
    flat = np.concatenate(values) if values else _EMPTY
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.astype(np.int32, copy=False)))
