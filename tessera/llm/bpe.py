"""Byte-level BPE encoding and decoding with a rank queue (operator 1).

``encode`` adds the ids of every whole text, ``decode`` turns ids back to bytes.
The merges of a pre-token run on a linked list of its parts.  A queue has one
bucket per merge rank that holds the positions (starts of left parts) at which
that merge is possible.  A bitmap in two levels marks the buckets in use, so that
find-first-set twice gives the lowest rank; entries that an earlier merge has
overtaken are skipped.  The cost of a pre-token is near linear in its length.

Defined results: null and empty texts give no ids and empty bytes; repeated rows
are encoded each; other columns, whatever their names, pass through; an empty
table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from tessera.llm.words import SLICE_BYTES, give_back, slices

#: Ranks in one word of the lower bitmap (as a power of two); the upper one has a bit per word.
SHIFT = 9
LOW = (1 << SHIFT) - 1
#: Words and pre-tokens that a worker remembers, or those of the slice at hand if there are more; longer pre-tokens merge one by one, and neither they nor such words are remembered.
CACHED, LONGEST = 100_000, 64
#: Text bytes that are split into words at a time, and that are handed on at a time.
ENCODED_BYTES, SENT_BYTES = 3 << 20, 1 << 20
#: White space of any kind, and some before a space: there a text can't be cut at its spaces.
BLANK = re.compile("[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
SPACED = re.compile(BLANK.pattern + " ")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line has the token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token.

    ``buckets`` has the positions by merge rank (a heap each: of one rank the leftmost
    comes first), ``lower`` the bitmap of the ranks in use in words of ``1 << SHIFT``
    bits, and ``upper`` a bit for each word that has any.
    """
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n, get = len(piece), ranks.get
    end, before = list(range(1, n + 1)), list(range(-1, n))
    waiting = [-1] * n  # the rank at which the part that starts here can merge with the next
    buckets: dict[int, list[int]] = {}
    lower: dict[int, int] = {}
    upper = 0
    for i in range(n - 1):
        if (rank := get(piece[i : i + 2])) is not None:
            waiting[i] = rank
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
                word = rank >> SHIFT
                lower[word] = lower.get(word, 0) | 1 << (rank & LOW)
                upper |= 1 << word
    while upper:
        word = (upper & -upper).bit_length() - 1
        bits = lower[word]
        rank = word << SHIFT | (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            del buckets[rank]
            lower[word] = bits = bits & bits - 1
            if not bits:
                upper &= upper - 1
        if waiting[i] != rank:  # overtaken by another merge
            continue
        j = end[i]
        k = end[i] = end[j]
        waiting[j] = -1
        before[k] = i
        h = before[i]
        for start, stop in ((i, end[k] if k < n else 0), (h, k)):
            if not stop:  # the last part has no next
                waiting[start] = -1
            elif start >= 0:
                if (rank := get(piece[start:stop])) is None:
                    waiting[start] = -1
                    continue
                waiting[start] = rank
                if rank in buckets:
                    heappush(buckets[rank], start)
                else:
                    buckets[rank] = [start]
                    word = rank >> SHIFT
                    lower[word] = lower.get(word, 0) | 1 << (rank & LOW)
                    upper |= 1 << word
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Vocabulary:
    """Ranks of tokens and, for joint merges, of pairs of token ids."""

    def __init__(self, data: bytes) -> None:
        self.ranks = ranks = read_ranks(data)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.column = pa.array(self.tokens, pa.binary())
        self.byte_ids = np.array([ranks.get(bytes([x]), 0) for x in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = sorted(pairs)
        self.pairs = np.array([*keys, 1 << 62], np.int64)
        self.pair_ranks = np.array([*map(pairs.get, keys), -1], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids, -1 where there is none."""
        key = left << 32 | right
        at = self.pairs.searchsorted(key)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], -1)


def merge_many(pieces: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Ids of many short pre-tokens, each as the bytes of an int32 array.

    One queue holds the positions of all: pre-tokens don't touch each other, so from the
    lowest rank's bucket the leftmost position of every pre-token merges in one step.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    n = int(sizes.sum())
    stops = np.cumsum(sizes)
    word = np.append(np.repeat(np.arange(len(pieces)), sizes), -1)
    ids = np.append(vocabulary.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)], -1)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[stops - 1] = n  # position n stands for "none"
    before[stops - sizes] = n
    waiting = np.full(n + 1, -1, np.int64)
    paired = np.flatnonzero(after[:n] < n)
    waiting[paired] = vocabulary.rank(ids[paired], ids[paired + 1])
    buckets: dict[int, list[np.ndarray]] = {}
    lower: dict[int, int] = {}
    upper = 0

    def push(positions: np.ndarray, upper: int) -> int:
        ranks = waiting[positions]
        paired = ranks >= 0
        ranks, positions = ranks[paired], positions[paired]
        if not len(ranks):
            return upper
        order = ranks.argsort(kind="stable")
        ranks, positions = ranks[order], positions[order]
        begins = [0, *((ranks[1:] != ranks[:-1]).nonzero()[0] + 1).tolist()]
        for rank, begin, end in zip(ranks[begins].tolist(), begins, [*begins[1:], len(ranks)]):
            if rank in buckets:
                buckets[rank].append(positions[begin:end])
            else:
                buckets[rank] = [positions[begin:end]]
                lower[rank >> SHIFT] = lower.get(rank >> SHIFT, 0) | 1 << (rank & LOW)
                upper |= 1 << (rank >> SHIFT)
        return upper

    upper = push(paired, upper)
    while upper:
        at = (upper & -upper).bit_length() - 1
        bits = lower[at]
        rank = at << SHIFT | (bits & -bits).bit_length() - 1
        found = buckets.pop(rank)
        i = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        i = i[waiting[i] == rank]
        if len(i) > 1:
            first = np.ones(len(i), bool)
            first[1:] = word[i[1:]] != word[i[:-1]]
            if not first.all():
                buckets[rank] = [i[~first]]
                i = i[first]
        if rank not in buckets:
            lower[at] = bits = bits & bits - 1
            if not bits:
                upper &= upper - 1
        if not len(i):
            continue
        j = after[i]
        k = after[j]
        ids[i] = rank
        ids[j] = waiting[i] = waiting[j] = -1
        after[i] = k
        before[k] = i
        left = before[i]
        beside = np.concatenate([i[k < n], left[left < n]])
        if len(beside):
            waiting[beside] = vocabulary.rank(ids[beside], ids[after[beside]])
            upper = push(beside, upper)
    alive = ids[:n] >= 0
    out = ids[:n][alive].astype(np.int32)
    ends = np.cumsum(np.bincount(word[:n][alive], minlength=len(pieces))) * 4
    data, begin, cut = out.tobytes(), 0, []
    for end in ends.tolist():
        cut.append(data[begin:end])
        begin = end
    return cut


class Encoder:
    """Texts -> ids; remembers the ids of words (with the space before them) and of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Encode the pre-tokens that are new."""
        ranks, short = self.vocabulary.ranks, []
        for piece in pieces:
            data = piece.encode()
            if data in ranks:
                self.pieces[piece] = array("i", [ranks[data]]).tobytes()
            elif len(data) <= LONGEST:
                short.append((piece, data))
            else:
                self.pieces[piece] = array("i", merge(data, ranks)).tobytes()
        if short:
            self.pieces.update(zip((x for x, _ in short), merge_many([x for _, x in short], self.vocabulary)))

    def split(self, words: list[str]) -> tuple[list[str], list[int]]:
        """Pre-tokens of all words with a space before each, and where each word's end; words without white space are split in one pass."""
        found = [] if "" in words or BLANK.search("".join(words)) else self.find("".join(" " + word for word in words))
        ends = [*(i for i, piece in enumerate(found) if i and piece[0] == " "), *([len(found)] if found else [])]
        if len(ends) != len(words):  # white space, or a pattern under which words don't start pre-tokens
            found, ends = [], []
            for word in words:
                found += self.find(" " + word)
                ends.append(len(found))
        return found, ends

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text."""
        ends, ids = self.encode_all(texts)
        data, begin, out = ids.tobytes(), 0, []
        for end in (ends * 4).tolist():
            out.append(data[begin:end])
            begin = end
        return out

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text end, and the ids of all.

        A space between two other characters always starts a pre-token, so the distinct
        words are looked up one by one; only a text's first word has no space before it.
        """
        whole = [bool(text and SPACED.search(text)) for text in texts]
        parts = pc.split_pattern(pa.array(["" if not text or alone else text for text, alone in zip(texts, whole)], pa.string()), " ")
        starts = parts.offsets.to_numpy()
        rest = np.ones(len(parts.values), bool)
        rest[starts[:-1]] = False
        coded = parts.values.filter(pa.array(rest)).dictionary_encode()
        del parts
        used = coded.dictionary.to_pylist()
        heads = [self.find(text if alone else text.split(" ", 1)[0]) if text else [] for text, alone in zip(texts, whole)]
        new = [word for word in used if word not in self.words]
        if len(self.words) + len(new) > CACHED:
            self.words = {word: self.words[word] for word in used if word in self.words}
        new.sort(key=lambda word: not word or BLANK.search(word) is not None)
        odd = next((i for i, word in enumerate(new) if not word or BLANK.search(word)), len(new))  # these need a pass each
        pieces = set().union(*heads)
        split = [(words, *self.split(words)) for words in (new[:odd], new[odd:])]
        for _, found, _ in split:
            pieces.update(found)
        if len(self.pieces) + len(pieces) > CACHED:
            self.pieces = {x: self.pieces[x] for x in pieces if x in self.pieces}
        fresh = pieces - self.pieces.keys()
        self.learn(fresh)
        del pieces
        get = self.pieces.__getitem__
        for words, found, ends in split:
            for word, begin, end in zip(words, [0, *ends], ends):
                self.words[word] = get(found[begin]) if end - begin == 1 else b"".join(map(get, found[begin:end]))
        del split
        known = [*map(self.words.__getitem__, used), *(b"".join(map(get, head)) for head in heads)]
        for held, added in ((self.words, new), (self.pieces, fresh)):
            for x in added:
                if len(x) > LONGEST:
                    del held[x]
        del new, fresh, used
        places = np.empty(len(rest), np.int64)
        places[rest], places[~rest] = coded.indices.to_numpy(), np.arange(len(coded.dictionary), len(known))
        table = pa.ListArray.from_arrays(_bounded(known, 4), pa.array(np.frombuffer(b"".join(known), np.int32)))
        taken = table.take(pa.array(places))
        return taken.offsets.to_numpy()[starts[1:]].astype(np.int64), taken.values.to_numpy()


_CODERS: dict[tuple, object] = {}


def _vocabulary(data) -> Vocabulary:
    """The worker's copy of a broadcast vocabulary."""
    key = xxh3_128_digest(data.value)
    if key not in _CODERS:
        _CODERS[key] = Vocabulary(data.value)
    return _CODERS[key]


def _encoder(data, pattern: str) -> Encoder:
    key = (xxh3_128_digest(data.value), pattern)
    if key not in _CODERS:
        _CODERS[key] = Encoder(_vocabulary(data), pattern)
    return _CODERS[key]


def _bounded(parts: list[bytes], width: int) -> pa.Array:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // width
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def vocabulary_bytes(spark, path: str):
    """Broadcast of a vocabulary file that the driver can read (a megabyte; the vocabulary bounds it)."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _joined(table: list[bytes], ids: list[int]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


def encode(docs: DataFrame, vocabulary, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with array<int> column ``ids``: each match of ``pattern`` in the whole text, merged by the vocabulary's ranks.

    With ``decoded`` also a binary column of that name: the bytes of those ids, as ``decode``
    gives them, without another pass through Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = _encoder(vocabulary, pattern), _vocabulary(vocabulary).column
        for batch in slices(batches, text, ENCODED_BYTES):
            ends, flat = encoder.encode_all(batch.column(text).to_pylist())
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            columns, names = [pa.ListArray.from_arrays(offsets, pa.array(flat))], [ids]
            if decoded:
                columns.append(pc.binary_join(pa.ListArray.from_arrays(offsets, table.take(pa.array(flat))), b""))
                names.append(decoded)
            found = pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])
            yield from slices(iter([found]), text, SENT_BYTES)
        give_back()

    kept = docs.drop(ids, *([decoded] if decoded else []))
    new = {ids: F.lit(None).cast("array<int>")} | ({decoded: F.lit(None).cast("binary")} if decoded else {})
    return kept.mapInArrow(run, kept.withColumns(new).schema)


def decode(tokens: DataFrame, vocabulary, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``tokens`` with binary column ``decoded``: the bytes of the ids, joined (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _vocabulary(vocabulary).tokens
        for batch in batches:
            column = batch.column(ids)
            step = max(1, SLICE_BYTES // 4 * batch.num_rows // max(1, len(column.flatten())))
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                out = [_joined(table, x or []) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, decoded])
        give_back()

    schema = tokens.drop(decoded).withColumn(decoded, F.lit(None).cast("binary")).schema
    return tokens.drop(decoded).mapInArrow(run, schema)


def digests(ids: str = "ids", decoded: str = "decoded") -> list:
    """Columns n_tokens, ids_sha256 (ids in decimal, joined by spaces) and decoded_sha256."""
    listed = F.coalesce(F.array_join(F.col(ids).cast("array<string>"), " "), F.lit(""))
    return [
        F.coalesce(F.size(ids), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    ]
