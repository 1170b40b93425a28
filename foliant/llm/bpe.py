"""Byte-level BPE by prefix dynamic programming.

For each byte prefix of a piece exactly one token can be the last of the prefix's encoding. The table of these last
tokens is enough to encode (walk back from the end), to append bytes exactly (earlier entries never change) and to
encode again near an edit (entries before it stay; those after it are copied once they agree over a longest token).
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import bound_batches, only, release

#: Words whose encodings are kept, besides those of a batch; the longest unused half goes first.
KEPT_WORDS = 600_000
#: The same for a task that encodes rows, which share a worker's memory with all that rows pass through.
KEPT_IN_TASK = 100_000
#: Pairs of tokens of which a worker keeps whether they are valid; beyond it all go.
KEPT_PAIRS = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_bytes(piece: bytes, ranks: dict[bytes, int], until: int = 1) -> list[bytes]:
    """Plain BPE: again and again join the leftmost of the adjacent pairs with the lowest rank, until so few are left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > until:
        rank, at = min(((ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
        if rank == 1 << 62:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class PrefixTable:
    """The last tokens of all prefixes of a byte string: `last[i]` is the last token of the encoding of data[:i]."""

    def __init__(self, codec: BpeCodec, data: bytes = b""):
        self.codec, self.data, self.last = codec, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        self._fill(start + 1, len(self.data))

    def move_to(self, data: bytes) -> None:
        """Become the table of data, keeping the entries of the prefix that it shares with the present string."""
        same = 0
        for a, b in zip(self.data, data):
            if a != b:
                break
            same += 1
        del self.last[same + 1 :]
        self.data = data
        self._fill(same + 1, len(data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put new in place of data[start:end]; returns how many entries were computed afresh."""
        old, shift, longest = self.last, len(new) - (end - start), self.codec.longest
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        agreed = 0
        for i in range(start + 1, len(self.data) + 1):
            self._fill(i, i)
            before = i - shift
            agreed = agreed + 1 if before > end and old[before] == self.last[i] else 0
            if agreed >= longest:
                self.last += old[before + 1 :]
                return i - start
        return len(self.data) - start

    def _fill(self, first: int, final: int) -> None:
        """Try the tokens that end at each place; exactly one fits the last token before it."""
        data, last, endings, pairs, shift = self.data, self.last, self.codec.endings.get, self.codec.pairs, self.codec.shift
        for i in range(first, final + 1):
            j, found = i - 1, []
            while j >= 0 and (token := endings(data[j:i])) is not None:
                if token >= 0:
                    found.append((j, token))
                j -= 1
            for j, token in reversed(found):
                if not j:
                    break
                valid = pairs.get(key := last[j] << shift | token)
                if valid is None:
                    valid = pairs[key] = self.codec.pair_valid(last[j], token)
                if valid:
                    break
            else:
                raise ValueError("the ranks lack a single byte")
            last.append(token)

    def ids(self) -> list[int]:
        out, at, sizes = [], len(self.data), self.codec.sizes
        while at:
            out.append(self.last[at])
            at -= sizes[out[-1]]
        return out[::-1]


class BpeCodec:
    """encode and decode as the tiktoken library would, without special tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.sizes = {i: len(t) for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.sound: dict[bytes, int] = {}  # the tokens that plain BPE can make
        self.halves: dict[int, tuple[int, int]] = {}  # the two tokens that its last merge joins
        self.joined: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.sound[token], self.halves[rank] = rank, (rank, rank)
                continue
            last = merge_bytes(token, ranks, until=2)
            if len(last) == 2 and all(t in self.sound for t in last):
                self.sound[token] = rank
                self.halves[rank] = a, b = ranks[last[0]], ranks[last[1]]
                self.joined[a, b] = rank
        # every end of a token, with the token that it is itself, or -1
        self.endings = {t[i:]: -1 for t in self.sound for i in range(1, len(t))} | self.sound
        self.shift = max(ranks.values()).bit_length()
        self.pairs: dict[int, bool] = {}

    def pair_valid(self, a: int, b: int) -> bool:
        """Whether a then b is the encoding of their bytes; a sequence is an encoding if all neighbours are valid.

        Undo the merges of both, latest first. A merge across the border that comes before the merges undone so far
        would have been made instead, so there must be none.
        """
        halves, joined, before = self.halves, self.joined, 1 << 62
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        while True:
            across = joined.get((a, b))
            if across is not None and across < before:
                return False
            if a > b:
                before, whole = a, a
                a = halves[a][1]
                if a != whole:
                    continue
                before, whole = b + 1, b  # a is a single byte
                b = halves[b][0]
                if b == whole:
                    return True
            else:
                before, whole = b + 1, b
                b = halves[b][0]
                if b != whole:
                    continue
                before, whole = a, a  # b is a single byte
                a = halves[a][1]
                if a == whole:
                    return True

    def encode_piece(self, piece: bytes, table: PrefixTable | None = None) -> list[int]:
        whole = self.ranks.get(piece)  # the library takes a piece that is a token as it is
        if whole is not None:
            return [whole]
        table = table or PrefixTable(self)
        table.move_to(piece)
        return table.ids()

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pattern.findall(text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class WordMemory:
    """Encodings of whole texts by the encodings of their words, each of which is worked out once while it is kept.

    A space between two characters that are not white space always starts a piece, so what lies between such spaces
    is encoded by itself. A text with other white space beside a space is split by the pattern as a whole. New pieces
    are taken in order, so that each keeps the table entries of the prefix it shares with the one before.
    """

    def __init__(self, codec: BpeCodec, most: int):
        self.codec, self.most, self.words, self.before = codec, most, {}, {}

    def kept(self, ids: list[int]):
        """What is kept of the ids of a piece; whole() joins what is kept of pieces in a row."""
        return array("i", ids)

    def whole(self, parts: list):
        return array("i", b"".join(parts))

    def texts(self, texts: list[str]) -> list:
        """Of each text what is kept of its pieces, joined."""
        split, find, joined = [text.split(" ") for text in texts], self.codec.pattern.findall, self.whole
        known, before = self.words, self.before
        new = {w for words in split for w in words[1:]}.difference(known)
        for w in new.intersection(before):
            known[w] = before[w]
        apart = {w: None if not w or w[0].isspace() or w[-1].isspace() else find(" " + w) for w in new.difference(before)}
        odd = {w for w, pieces in apart.items() if pieces is None}
        heads = [None if not (h := words[0]) or h[-1].isspace() or not odd.isdisjoint(words[1:]) else find(h) for words in split]
        whole = [find(text) if head is None else None for head, text in zip(heads, texts)]
        table, made = PrefixTable(self.codec), {}
        for piece in sorted({p for some in (apart.values(), heads, whole) for pieces in some if pieces for p in pieces}):
            made[piece] = self.kept(self.codec.encode_piece(piece.encode(), table))
        for word, pieces in apart.items():
            if pieces is not None:
                known[word] = made[pieces[0]] if len(pieces) == 1 else joined([made[p] for p in pieces])
        out = [joined([made[p] for p in every]) if every is not None else joined([*[made[p] for p in head], *map(known.__getitem__, words[1:])]) for every, head, words in zip(whole, heads, split)]
        if len(known) > self.most // 2:
            self.words, self.before = {}, known
        return out


class LineMemory(WordMemory):
    """As WordMemory, but ids as decimal numbers between single spaces."""

    def __init__(self, codec: BpeCodec, most: int):
        super().__init__(codec, most)
        self.bytes_of = {str(i): t for i, t in codec.bytes_of.items()}

    def kept(self, ids: list[int]) -> str:
        return " ".join(map(str, ids))

    def whole(self, parts: list[str]) -> str:
        return " ".join(parts)

    def decode(self, ids: list[str]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.cache
def codec_of(ranks_path: str, pattern: str) -> BpeCodec:
    return BpeCodec(load_ranks(ranks_path), pattern)


@functools.cache
def lines_of(ranks_path: str, pattern: str) -> LineMemory:
    """One memory for all tasks that a worker process runs."""
    return LineMemory(codec_of(ranks_path, pattern), KEPT_WORDS)


def digest_rows(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text; per row: id, n_tokens, SHA-256 of the ids and of the decoded bytes.

    A null text counts as empty (no tokens). Repeated rows give repeated results; a null id stays null; other columns
    of the input are not read. No rows give no rows. No shuffle: a text never leaves its task.
    """
    bound_batches(docs.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lines_of(ranks_path, pattern)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for line in words.texts([text or "" for text in batch.column(1).to_pylist()]):
                ids = line.split()
                counts.append(len(ids))
                encoded.append(hashlib.sha256(line.encode()).hexdigest())
                decoded.append(hashlib.sha256(words.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
    kind = docs.schema[id_col].dataType.simpleString()
    out = only(docs, id_col, text_col).mapInArrow(digest, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def encode_rows(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """All rows and columns of docs, and the ids of the text in out_col (an empty array for a null text), in place of a
    column that has this name. Repeated rows stay; no rows give no rows."""
    bound_batches(docs.sparkSession)
    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, batch, rows = WordMemory(codec_of(ranks_path, pattern), KEPT_IN_TASK), None, None
        for batch in batches:
            rows = words.texts([text or "" for text in batch.to_pylist()])
            starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            yield pa.ListArray.from_arrays(starts, np.frombuffer(b"".join(rows), np.int32))
        words.codec.pairs.clear()
        del words, batch, rows
        release()
    return docs.drop(out_col).withColumn(out_col, encode(F.col(f"`{text_col}`").cast("string")))
