"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 characters and every prefix of every token is a path of one pyahocorasick automaton, which
holds the longest token on that path; so two calls give the longest token that starts at any place. Encoding walks a
piece from its start: at each place it tries the longest token first and steps back to the token's own longest prefix,
or to the place before, whenever the token could not stand next to its left neighbour. Two tokens are compatible if
merging their joined bytes by rank would give just these two; verdicts are memoised. For a piece only one chain of
compatible tokens exists, and it is the result of the merges. A place is closed at most once, and a token is no longer
than the longest of the vocabulary, so a piece takes linear time.

A piece (a match of the split pattern) that is itself in the vocabulary is its own token, as in the usual encoders.
Pieces are memoised in a table of at most ``MEMO`` entries; pieces over ``LONG`` characters are encoded anew. The memo is only a cache: its size changes nothing.

Defined results: a null text counts as empty (no tokens); rows are independent of each other, so repeated rows get
equal rows; an empty table gives an empty result; other columns are not read by :func:`encode_decode`, whatever they
are called.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.llm.batches import short_batches

MEMO, LONG = 1_000_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PieceMemo(dict):
    """Tokens of the pieces seen, in two generations: when the young one is full it becomes the old one, which goes.

    A piece that is asked for again moves to the young one, so what is frequent stays.
    """

    def __init__(self, encode, most: int):
        self.encode, self.half, self.old = encode, max(1, most // 2), {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = tuple(self.encode(piece.encode("utf-8", "replace")))
            if len(piece) > LONG:
                return ids
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class BytePairEncoder:
    """Encodes and decodes by ``ranks`` (bytes to rank); ``pattern`` splits a text into pieces.

    Pickled as its ranks and pattern: a Python worker builds the automaton once and keeps its memo from task to task.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int | None = None):
        self.ranks, self.pattern, self.memo = ranks, pattern, memo or MEMO
        self.vocab = {v: k for k, v in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.widest = max(map(len, ranks), default=0)
        self.automaton = ahocorasick.Automaton()
        for token in sorted(ranks):  # a token's prefixes first, so each path is set by its nearest token
            best = None
            for n in range(1, len(token) + 1):
                best = ranks.get(token[:n], best)
                self.automaton.add_word(token[:n].decode("latin-1"), -1 if best is None else best)
        self.prefix: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.verdicts: dict[int, bool] = {}
        self.pieces = PieceMemo(self.piece, self.memo)

    def __reduce__(self):
        return BytePairEncoder, (self.ranks, self.pattern, self.memo)

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        if token not in self.prefix:
            b = self.vocab[token]
            self.prefix[token] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), -1)
        return self.prefix[token]

    def last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one when its own bytes are merged; itself twice for a single byte.

        None for the few entries of a vocabulary that merges never give: they only match whole pieces.
        """
        if token not in self.halves:
            parts = [bytes([x]) for x in self.vocab[token]]
            made = (token, token) if len(parts) == 1 else None
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                if len(parts) == 2 and rank == token:
                    made = self.ranks[parts[0]], self.ranks[parts[1]]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = made
        return self.halves[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of two tokens gives just these two; without a first one (-1), just the second.

        The merges of both are undone from the last to the first. At each step the tokens at the seam must not have had
        a merge of their own that came before the merge just undone (of equal ranks the left one comes first).
        """
        verdict = self.verdicts.get(a << 32 | b)
        if verdict is None:
            if len(self.verdicts) >= 4 * self.memo:
                self.verdicts.clear()
            verdict = self.last_merge(b) is not None and (a < 0 or (self.last_merge(a) is not None and self._seam_holds(a, b)))
            self.verdicts[a << 32 | b] = verdict
        return verdict

    def _seam_holds(self, x: int, y: int) -> bool:
        vocab, ranks, undone = self.vocab, self.ranks, 1 << 60
        while True:
            if ranks.get(vocab[x] + vocab[y], 1 << 60) < undone:
                return False
            left, right = self.last_merge(x), self.last_merge(y)
            if left[0] == left[1] == x and right[0] == right[1] == y:
                return True
            if right[0] == right[1] == y or (x > y and not left[0] == left[1] == x):  # the left one was made later
                undone, x = x, left[1]
            else:
                undone, y = y + 1, right[0]

    def piece(self, b: bytes) -> list[int]:
        """Tokens of one piece."""
        token = self.ranks.get(b)
        if token is not None:
            return [token]
        n, piece, wide = len(b), b.decode("latin-1"), self.widest
        vocab, verdicts, path, longest = self.vocab, self.verdicts, self.automaton.longest_prefix, self.automaton.get
        closed: set[int] = set()
        out: list[int] = []
        at, last, fresh = 0, -1, True
        while at < n:
            if fresh:  # the longest token that starts here
                ahead = piece[at : at + wide]
                token = longest(ahead[: path(ahead)], -1)
            while token >= 0:
                end = at + len(vocab[token])
                if end not in closed:
                    ok = verdicts.get(last << 32 | token)
                    if ok or (ok is None and self.compatible(last, token)):
                        break
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                at, last, fresh = end, token, True
            elif out:  # nothing stands here: close the place and shorten the token before it
                closed.add(at)
                token = out.pop()
                at -= len(vocab[token])
                last, token, fresh = out[-1] if out else -1, self.shorter(token), False
            else:
                raise ValueError("a byte has no token")
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (if asked for), ids_sha256, decoded_sha256.

    The vocabulary is read by the driver and broadcast (its size is that of the file); executors need no file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(BytePairEncoder(ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        decimal = {i: str(i) for i in coder.vocab}
        for b in batches:
            n, lists, ids_sha, text_sha = [], [], [], []
            for t in b.column(1):
                ids = coder.encode(t.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(ids)
            cols, names = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return short_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
