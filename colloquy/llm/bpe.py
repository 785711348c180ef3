"""Byte-level BPE encoding and decoding.

Two tiers resolve a pre-token: a minimal perfect hash finds those that are vocabulary
entries as a whole; for the others a heap of candidate merges runs over a linked list
of bytes, lowest rank first and leftmost among equals.
"""

from __future__ import annotations

import base64
import heapq
import uuid

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembering, arrow_rows, once, schema_with

#: Bytes of pre-tokens that a task remembers at most (a matter of speed, not of results).
REMEMBERED = 20 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """Maps each of n byte strings to its own slot of n, and any other string to none.

    Keys fall into n first-level cells. Cells of several keys store a displacement under
    which all their keys find free slots; cells of one key name their slot directly.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if not ranks:
            raise ValueError("an empty vocabulary")
        n = self.n = len(ranks)
        cells: dict[int, list[tuple[int, int, bytes]]] = {}
        for key in ranks:
            a, b = self._halves(key)
            cells.setdefault(a % n, []).append((a, b, key))
        self.shift, self.keys = [0] * n, [b""] * n
        self.values = np.full(n, -1, np.int64)
        free = bytearray(b"\1") * n
        singles = []
        for cell, members in sorted(cells.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                singles.append((cell, members[0][2]))
                continue
            d = 1
            while len(set(slots := [(b + d * (a | 1)) % (1 << 64) % n for a, b, _ in members])) < len(slots) or not all(free[s] for s in slots):
                d += 1
            self.shift[cell] = d
            for slot, (_, _, key) in zip(slots, members, strict=True):
                free[slot], self.keys[slot], self.values[slot] = 0, key, ranks[key]
        empty = (s for s in range(n) if free[s])
        for (cell, key), slot in zip(singles, empty, strict=False):
            self.shift[cell], self.keys[slot], self.values[slot] = -slot - 1, key, ranks[key]
        self.values = self.values.tolist()

    def state(self) -> dict:
        return self.__dict__

    @classmethod
    def of(cls, state: dict) -> PerfectHash:
        self = cls.__new__(cls)
        self.__dict__.update(state)
        return self

    @staticmethod
    def _halves(key: bytes) -> tuple[int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return h >> 64, h & 0xFFFFFFFFFFFFFFFF

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        a, b = self._halves(key)
        d = self.shift[a % self.n]
        slot = -d - 1 if d < 0 else (b + d * (a | 1)) % (1 << 64) % self.n
        return self.values[slot] if self.keys[slot] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a pre-token that isn't in the vocabulary."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(ranks[pair], i, i + 2) for i in range(n - 1) if (pair := piece[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or after[j] != end:
            continue  # one of its halves has been merged meanwhile
        alive[j], after[i] = False, end
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder(Remembering):
    """Pre-token to packed little-endian 32-bit ids."""

    def __init__(self, hashed: PerfectHash, pattern: str):
        super().__init__(REMEMBERED)
        self.hashed = hashed
        self.ranks = {k: v for k, v in zip(hashed.keys, hashed.values, strict=True)}
        self.find = regex.compile(pattern).findall

    def work_out(self, token: str) -> bytes:
        raw = token.encode()
        whole = self.hashed.get(raw)
        ids = [whole] if whole >= 0 else merge(raw, self.ranks)
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        out = b"".join(map(self.__getitem__, self.find(text)))
        self.age()
        return out


def _packed(encoder: Encoder, texts: list[str | None]) -> list[bytes]:
    return [encoder(x) if x else b"" for x in texts]


def _unpacked(token, ids: list[bytes | None]) -> list[bytes | None]:
    return [None if x is None else b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in ids]


def _more(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", decoded: str | None = None) -> DataFrame:
    """Adds ids (packed little-endian unsigned 32-bit integers) and their number and, if named, the bytes that those ids decode to
    (what decode() gives, in the same pass); columns of these names are replaced.

    A null or empty text has no tokens and empty ids. Any length of text is taken whole.
    Rows are independent: ties, repeated rows and clashing extra columns change nothing; an empty table gives an empty one.
    """
    shared = df.sparkSession.sparkContext.broadcast(PerfectHash(load_ranks(ranks_path)).state())
    kept, key = df.drop(ids, n_tokens, *([decoded] if decoded else [])), uuid.uuid4().hex
    at = kept.columns.index(text)

    def per_partition():
        encoder = once("byte BPE", key, lambda: Encoder(PerfectHash.of(shared.value), pattern))
        token = {v: k for k, v in encoder.ranks.items()}.__getitem__ if decoded else None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = _packed(encoder, batch.column(at).to_pylist())
            more = {ids: pa.array(packed, pa.binary()), n_tokens: pa.array([len(x) // 4 for x in packed], pa.int64())}
            if decoded:
                more[decoded] = pa.array(_unpacked(token, packed), pa.binary())
            return _more(batch, **more)

        return step

    columns = [f"{ids} binary", f"{n_tokens} long", *([f"{decoded} binary"] if decoded else [])]
    return arrow_rows(kept, schema_with(kept, *columns), per_partition, "byte BPE")


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the bytes that packed ids stand for; null ids give null. A clashing column is replaced."""
    shared = df.sparkSession.sparkContext.broadcast({v: k for k, v in load_ranks(ranks_path).items()})
    kept = df.drop(decoded)
    at = kept.columns.index(ids)

    def per_partition():
        token = shared.value.__getitem__
        return lambda batch: _more(batch, **{decoded: pa.array(_unpacked(token, batch.column(at).to_pylist()), pa.binary())})

    return arrow_rows(kept, schema_with(kept, f"{decoded} binary"), per_partition)


def op4_byte_bpe(spark, sf_dir):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    import public_tokenizers as public

    from .common import read

    path = public.path("byte_bpe_50k.tiktoken")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    both = encode(docs, path, public.PATTERN, decoded="decoded")
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
