"""Byte-level BPE by prefix dynamic programming.

Of all tokens that could end a byte prefix, exactly one is the last token of the prefix's own encoding. A table that holds
this token for every prefix gives the encoding by walking back from the end, can be extended at its end without touching
what it holds, and after an edit needs new entries only until it agrees with the old ones again.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm.common import keep, ship, take_turn

RANKS = "byte_bpe_50k.tiktoken"

#: When a worker holds so many pieces' encodings, they become its older half, and those of the last such half go.
PIECES_KEPT = 200_000


class Vocabulary:
    """Ranks of byte strings, with what the table needs: the halves of each token, and a matcher of all tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.bytes = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._fits: dict[int, bool] = {}
        own = [t for t in ranks if self._merged(t) == [ranks[t]]]  # a token that isn't its own encoding is never used
        self._matcher = ahocorasick.Automaton()
        for t in own:
            self._matcher.add_word(t.decode("latin-1"), (len(t), ranks[t]))
        self._matcher.make_automaton()

    def _merged(self, data: bytes) -> list[int]:
        """Encoding of a short string by its definition: the lowest-ranked pair first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes are encoded together."""
        known = self._fits.get(left << 32 | right)
        if known is None:
            if len(self._fits) > 250_000:
                self._fits.clear()
            known = self._fits[left << 32 | right] = self._merged(self.bytes[left] + self.bytes[right]) == [left, right]
        return known

    def ending(self, data: bytes, start: int = 0):
        """For each position, the tokens that end there, as (end, (length, token)), from those that begin at start or later."""
        return self._matcher.iter(data[start:].decode("latin-1"))


class PrefixTable:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _extend(self, data: bytes, begin: int, old: list[int] | None = None, shift: int = 0) -> None:
        """Fills last from position begin on; stops where a stretch as long as the longest token equals the old table."""
        last, known, fits, same = self.last, self.vocabulary._fits.get, self.vocabulary.fits, 0
        low = max(0, begin - self.vocabulary.longest)
        at = len(last)
        for end, (size, token) in self.vocabulary.ending(data, low):
            end += low
            if end != at:  # before begin, or its token is found
                continue
            if end >= size and not (known((before := last[end - size]) << 32 | token) or fits(before, token)):
                continue
            last.append(token)
            at += 1
            if old is not None:
                same = same + 1 if 0 <= end - shift < len(old) and old[end - shift] == token else 0
                if same > self.vocabulary.longest:
                    last.extend(old[end - shift + 1 :])
                    return
        if len(last) < len(data):
            raise ValueError("no token ends here: the vocabulary lacks single bytes")

    def append(self, more: bytes) -> None:
        """Adds bytes at the end; what was there is kept as it is."""
        begin, self.data = len(self.data), self.data + more
        if more:
            self._extend(self.data, begin)

    def replace(self, start: int, stop: int, more: bytes) -> None:
        """Puts other bytes in place of data[start:stop] and encodes anew only near the edit."""
        old, shift = self.last, len(more) - (stop - start)
        self.data = self.data[:start] + more + self.data[stop:]
        # what comes after the edit equals the old table only from entries whose bytes are all behind it
        self.last = old[:start]
        guard = [-1] * stop + old[stop:]
        if start < len(self.data):
            self._extend(self.data, start, guard, shift)

    def tokens(self) -> list[int]:
        """The encoding, read back from the end."""
        out, at = [], len(self.data)
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= len(self.vocabulary.bytes[token])
        return out[::-1]


def read_ranks(name: str = RANKS) -> dict[bytes, int]:
    """The ranks of a public vocabulary file."""
    with open(public_tokenizers.path(name), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class _Pieces(dict):
    """Encodings of pieces as ids joined by a space, made when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.before = vocabulary, {}
        self.decoded = {str(i): t for i, t in vocabulary.bytes.items()}

    def __missing__(self, piece: str) -> str:
        if len(self) >= PIECES_KEPT:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(piece)
        if ids is None:
            ids = " ".join(map(str, PrefixTable(self.vocabulary, piece.encode()).tokens()))
        self[piece] = ids
        return ids


@lru_cache(2)
def codec(name: str) -> tuple[_Pieces, object]:
    """This process's encodings of pieces, and the pattern that cuts texts into pieces."""
    return _Pieces(Vocabulary(read_ranks(name))), regex.compile(public_tokenizers.PATTERN)


keep("bpe", codec.cache_clear)


def encode_text(text: str, name: str = RANKS) -> tuple[str, bytes]:
    """Ids joined by a space, and the bytes that these ids decode to."""
    pieces, pattern = codec(name)
    ids = " ".join([pieces[p] for p in pattern.findall(text)])
    return ids, b"".join([pieces.decoded[i] for i in ids.split()])


def encode(docs: DataFrame, text: str = "text", name: str = RANKS, with_ids: bool = False) -> DataFrame:
    """All columns of docs but those of the result, and n_tokens, ids_sha256, decoded_sha256, and ids (array) if asked for.

    Null is the empty text: no tokens, the digests of the empty string. Rows are independent, so repeated rows and ids give
    equal rows, and an empty table gives an empty one. Long texts are cut by the pattern and encoded piece by piece; memory
    per text is a small multiple of its size.
    """
    ship(docs.sparkSession)
    own = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    kept = [c for c in docs.columns if c not in own and c != text]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "n_tokens long, ids_sha256 string, decoded_sha256 string", *["ids array<int>"] * with_ids])

    def run(batches):
        take_turn("bpe")
        for batch in batches:
            n, ids_sha, decoded_sha, all_ids = [], [], [], []
            for value in batch.column(text):
                ids, decoded = encode_text(value.as_py() or "", name)
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    all_ids.append(np.array(ids.split(), np.int32))
            columns = [*(batch.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            columns += [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(columns, [*kept, *own[: 3 + with_ids]])

    return docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`").cast("string").alias(text)).mapInArrow(run, schema)


def decode(ids: list[int], name: str = RANKS) -> bytes:
    """The bytes of a list of ids."""
    return b"".join(map(codec(name)[0].vocabulary.bytes.__getitem__, ids))
