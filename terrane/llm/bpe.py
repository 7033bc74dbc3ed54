"""Byte-level BPE encoding and decoding with a fixed vocabulary of ranks.

A piece (one match of the splitting pattern) is encoded left to right with an Aho-Corasick automaton over all tokens, whose
bytes are mapped to Latin-1 characters: take the longest token that starts here and is compatible with the token before it;
if none is, take shorter prefixes of it, and then step back and shorten the token before. Two adjacent tokens are compatible if
merging by rank would leave the boundary between them, which is decided by undoing their merges from the highest
rank down; decisions are memoised. A sequence whose neighbours are all compatible is the one that the merges produce, and
every byte position is given up at most once, so that the work is linear in the piece.

Encoded pieces are memoised per worker in dictionaries of bounded size: so many entries, none of them long.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_rows, ranges

#: Pieces that a worker remembers, and their characters at most; when there are more, it starts anew, and longer ones aren't kept.
MEMO, LONGEST = 400_000, 48


def read_ranks(spark, path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file (base64 token, space, rank on each line). Its size is that of a vocabulary."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes pieces. ``ranks`` must hold all 256 single bytes, and its other tokens must be made of lower ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for t, r in ranks.items():
            self.auto.add_word(t.decode("latin-1"), r)
        self.auto.make_automaton()
        self.length = {r: len(t) for t, r in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        #: the longest token that is a proper prefix of a token; -1 for a byte
        self.shorter = {r: next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), -1) for t, r in ranks.items()}
        self.pieces: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        import regex

        self.findall = regex.compile(pattern).findall
        spaces = [chr(c) for c in range(0x3001) if regex.match(r"\s", chr(c))]
        self.doubles = [a + b for a in spaces for b in (" ", "\n")] + [b + a for a in spaces for b in ("\n", " ") if a not in " \n"]
        #: whether the pattern keeps letters, with a space before them or none, in one piece
        self.letters = self.findall(" aZq") == [" aZq"] and self.findall("Zaq") == ["Zaq"]
        self.newline = self.piece("\n")
        most = max(self.tokens)
        self.sizes = np.zeros(most + 1, np.int64)
        self.sizes[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        order = sorted(self.tokens)
        self.starts = np.zeros(most + 1, np.int64)
        self.starts[order] = np.concatenate([[0], np.cumsum(self.sizes[order])[:-1]])
        self.table = np.frombuffer(b"".join(self.tokens[r] for r in order), np.uint8)

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a byte."""
        if token not in self.halves:
            parts = self.merge(self.tokens[token], token)
            self.halves[token] = tuple(parts) if len(parts) == 2 else None
        return self.halves[token]

    def merge(self, data: bytes, below: int = 1 << 60) -> list[int]:
        """The plain algorithm: merge the adjacent pair of lowest rank (below a limit) until there is none."""
        parts = [bytes([b]) for b in data]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the boundary between the two tokens; memoised."""
        if len(self.pairs) > 2 * MEMO:
            self.pairs.clear()
        known = self.pairs[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Walk back in time. The side made last is undone first; at each moment the tokens that touch the boundary must
        # not have a merge that would have come before the merge that made one of them bigger.
        limit, tokens, ranks = 1 << 60, self.tokens, self.ranks
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < limit and self.split(joined) == (left, right):
                return False
            l, r = self.split(left), self.split(right)
            if l is None and r is None:
                return True
            if r is None or l is not None and left > right:
                limit, left = left, l[1]  # a merge of the same rank happens left to right, so at the left side first
            else:
                limit, right = right + 1, r[0]

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text, n, length, pairs, longest = data.decode("latin-1"), len(data), self.length, self.pairs, self.auto.iter_long
        dead: set[int] = set()  # positions from which the rest can't be encoded
        out: list[int] = []
        before, at, token = -1, 0, next(longest(text))[1]
        while True:
            end = at + length[token]
            if end not in dead:
                fits = before < 0 or pairs.get((before, token))
                if fits is None:
                    fits = self.compatible(before, token)
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    before, at = token, end
                    token = next(longest(text, at))[1]
                    continue
            token = self.shorter[token]
            while token < 0:  # nothing fits here: shorten the token before
                dead.add(at)
                token = out.pop()
                at -= length[token]
                before = out[-1] if out else -1
                token = self.shorter[token]

    def piece(self, piece: str) -> bytes:
        """The ids of a piece as 32-bit numbers."""
        got = self.pieces.get(piece)
        if got is None and len(piece) > LONGEST:
            return array("i", self.encode_piece(piece)).tobytes()
        if got is None:
            if len(self.pieces) > MEMO:
                self.pieces.clear()
            got = self.pieces[piece] = array("i", self.encode_piece(piece)).tobytes()
        return got

    def lookup(self, memo: dict[str, bytes], lead: str, words: list[str]) -> list[bytes]:
        """The ids of each of ``words`` with ``lead`` before it."""
        got = list(map(memo.get, words))
        if None in got:
            if len(memo) > MEMO:
                memo.clear()
            for i, ids in enumerate(got):
                if ids is None:
                    w = words[i]
                    ids = memo.get(w)
                    if ids is None:
                        parts = [lead + w] if self.letters and w.isascii() and w.isalpha() else self.findall(lead + w)
                        ids = b"".join(map(self.piece, parts))
                        if len(w) <= LONGEST:
                            memo[w] = ids
                    got[i] = ids
        return got

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text.

        Where no two white-space characters are neighbours, every match of the pattern lies within a word with
        at most one space before it, or is a line break; such texts are cut there, so that the memo has words. (It holds
        for patterns in which only single spaces join what follows them.) Other texts are cut by the pattern."""
        if any(map(text.__contains__, self.doubles)):
            return np.frombuffer(b"".join(map(self.piece, self.findall(text))), np.int32)
        out: list[bytes] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.newline)
            words = line.split(" ")
            out += self.lookup(self.first, "", words[:1])
            out += self.lookup(self.later, " ", words[1:])
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        return self.table[ranges(self.starts[ids], self.sizes[ids])].tobytes()


#: The encoder of this Python worker; the tasks that it runs share it.
_WORKER: dict = {}


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded binary (the ids turned back to bytes), for every row. A null or empty text has no ids.
    Texts are read whole. Rows stay where they are: no shuffle, and memory is bounded by a batch and the memo.

    ``path``: a .tiktoken file that the driver reads; its ranks (one vocabulary, some MB) are broadcast."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(spark, path))
    ident = (path, pattern)

    def run(batches):
        if _WORKER.get("ident") != ident:
            _WORKER.update(ident=ident, encoder=Encoder(ranks.value, pattern))
        enc = _WORKER["encoder"]
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids = [enc.encode(raw.decode("utf-8", "replace")) if raw else np.zeros(0, np.int32) for raw in part.column(1).to_pylist()]
                off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.concatenate(ids)
                bounds = np.concatenate([[0], np.cumsum(enc.sizes[values])])[off]
                decoded = binary_rows(np.frombuffer(enc.decode(values), np.uint8), bounds)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(off, pa.array(values)), decoded], names=["doc_id", "ids", "decoded"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
