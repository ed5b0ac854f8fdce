"""Byte-level BPE encoding and decoding.

A priority queue holds the merge ranks of adjacent symbols over a doubly linked symbol list. Entries whose symbols have since
been merged are stale and are skipped when they come up. Decoding concatenates the vocabulary's byte strings.

Rows: a null text counts as empty and gives no ids; very long texts are encoded whole, and a piece without white space of n
bytes costs O(n log n). Repeated rows give repeated results. Columns of the input other than `text` pass through, unless
their names are ids or decoded, which the results replace."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import bounded_batches, read, steps

# How the vocabulary file's pre-tokenizer splits a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """A vocabulary with its merges. Encoded pieces are remembered, until there are `remembered` of them: frequent ones come early."""

    def __init__(self, file: bytes, remembered: int):
        spec = json.loads(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        value = {x: b for b, x in enumerate(letters)}
        self.strings = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for s, i in vocab.items():
            self.strings[i] = bytes(value[x] for x in s) if all(x in value for x in s) else s.encode()
        self.byte_ids = [vocab[x] for x in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.strings[i] = content.encode()
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._find = regex.compile(PIECES).findall
        self._seen: dict[str, bytes] = {}
        self._remembered = remembered

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ids: list[int] = [self.byte_ids[b] for b in piece]
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        queue = [(*m, i) for i, pair in enumerate(pairwise(ids)) if (m := merges.get(pair))]
        heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            rank, merged, i = heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n or merges.get((ids[i], ids[j])) != (rank, merged):
                continue  # stale
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((merged, ids[k])):
                    heappush(queue, (*m, i))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], merged))):
                heappush(queue, (*m, h))
        return [x for x in ids if x >= 0]

    def _missed(self, piece: str) -> bytes:
        ids = b"".join([x.to_bytes(4, "little") for x in self.merge(piece.encode())])
        if len(piece) <= 48 and len(self._seen) < self._remembered:
            self._seen[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for part in self._split.split(text) if self._split else [text]:
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
                continue
            pieces = self._find(part)
            found = list(map(self._seen.get, pieces))
            if None in found:
                found = [x if x is not None else self._seen.get(p) or self._missed(p) for p, x in zip(pieces, found)]
            out.append(b"".join(found))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


#: Pieces that a worker remembers between tasks (about 200 bytes each), and how many in a pipeline, whose other stages need the room.
REMEMBERED, FEW = 600_000, 100_000

_loaded: dict[tuple[int, int], Bpe] = {}


def bpe_round_trip(df: DataFrame, vocabulary: str, text: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Replaces `text` by ids (binary: little-endian unsigned 32-bit integers) and decoded (string).

    `vocabulary` is the path of a byte-level BPE file in the tokenizers library's JSON format. The driver reads it (its size is that of the
    vocabulary, not of the data) and broadcasts it. No shuffle: a narrow map over the scan."""
    bounded_batches(df.sparkSession)
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in df.columns if c not in (text, "ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (hash(shared.value), remembered)
        bpe = _loaded.get(key) or _loaded.setdefault(key, Bpe(shared.value, remembered))
        for part in steps(batches, text):
            ids = [bpe.encode(x or "") for x in part.column(text).to_pylist()]
            decoded = [bpe.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=[*rest, "ids", "decoded"])

    schema = df.select(*rest).schema.add("ids", "binary").add("decoded", "string")
    return df.select(*rest, text).mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_round_trip(docs, default_vocabulary()).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids: doc_id, lang, source, ids (little-endian unsigned 32-bit integers), n_tokens, and the digest of the decoded text."""
    got = bpe_round_trip(docs.select("doc_id", "lang", "source", "text"), default_vocabulary(), remembered=FEW)
    return got.select("doc_id", "lang", "source", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
