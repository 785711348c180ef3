"""Text scores under a hierarchical Pitman-Yor language model with a restaurant for every word before.

The restaurant of a word u serves the words that follow u; its tables are customers of the root, which serves all words
from a uniform base over the vocabulary and one unknown word. Seating is sampled by Gibbs sweeps:

* Given a restaurant's number of tables t, an auxiliary variable g ~ Gamma(strength / d + t) makes its dishes independent:
  a customer of dish w opens a new table with weight d g p(w) against n - d for each table of n customers. So all dishes of
  all restaurants are reseated in parallel.
* All customers of a dish get up at once in every sweep. As only the number of their tables counts further on, it is drawn from
  its whole distribution: t tables with weight S(n, t) x ** t for n customers and a new table's weight x, where S are the generalised
  Stirling numbers. The rule is the same for dishes of any size, and nothing of the seating before is needed.
* The tables below are the root's customers; their tables there are drawn in the same way.

The model's probability of w after u is (n(u, w) - d t(u, w) + (strength + d t(u)) p(w)) / (strength + n(u)), averaged over
the sweeps after the burn-in. Contexts, pairs and counts are those of all training texts, so they grow with the corpus.

Words are known by 56 bits of a hash. Texts are coded once, in blocks of some million tokens; a block asks for its distinct
words and pairs, packed by buckets of their hashes. A bucket's task counts what it is asked for and files the answers by
place, so that each block is answered once after the last sweep. Only words and pairs that occur at least twice have a state;
buckets of words and of pairs tell each other tables and weights in every sweep.
"""

from __future__ import annotations

import functools
import itertools
import math
import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import LOWER, discard, fold, grouped, in_arrow, mix, packed, schema_with, squeezed, table, unpacked, unsqueezed

SWEEPS, BURN_IN = 4, 1
STRENGTH = 0.5
#: The end of a text as a word; no word holds a space.
END = b" "
#: Tokens to a block, and documents to a bucket of words and one of pairs.
BLOCK, BUCKET_DOCS = 2_000_000, 4_096
#: Bytes of text to a block, where words are long.
BLOCK_BYTES = 64 << 20
#: Bytes of a word's hash.
WIDTH = 7
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(text: str | None) -> list[bytes]:
    """Words (A-Z lower-cased, cut at ASCII white space) and the end."""
    return [*(text or "").encode().translate(LOWER).split(), END]


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(64 - 8 * WIDTH)


class Numbers(dict):
    """Numbers words as they come; the end is 0."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def coded(docs: DataFrame, learn: str, text: str) -> DataFrame:
    """Blocks of texts: block (its id), rest (docs' other columns), sizes (tokens a text), learn (which texts are learnt from),
    codes (the tokens by their number in the block), words (the hashes of those). A text isn't parted."""
    kept = [text, learn, *(c for c in docs.columns if c not in (text, learn))]

    def run(batches):
        serial = itertools.count((TaskContext.get().partitionId() << 32) if TaskContext.get() else 0)
        ids, codes, rows = Numbers({END: 0}), [], []

        def block():
            rest = pa.Table.from_batches(rows).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.drop_columns(["_text", "_learn"]).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(rest.drop_columns(["_text", "_learn"]))
            learnt = np.array([x is True for x in rest.column("_learn").to_pylist()], np.uint8)
            sizes = np.array([len(c) for c in codes], np.int32)
            values = [next(serial), sink.getvalue().to_pybytes(), sizes.tobytes(), learnt.tobytes(), squeezed(np.concatenate(codes)), packed(hashes_of(list(ids)), WIDTH)]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["block", "rest", "sizes", "learn", "codes", "words"])

        held = size = 0
        for batch in batches:
            begun = 0
            for k, x in enumerate(batch.column(0).to_pylist()):
                words = tokens_of(x)
                codes.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
                held, size = held + len(words), size + len(x or "")
                if held >= BLOCK or size >= BLOCK_BYTES:
                    rows.append(_named(batch.slice(begun, k + 1 - begun)))
                    yield block()
                    ids, codes, rows, held, size, begun = Numbers({END: 0}), [], [], 0, 0, k + 1
            if begun < batch.num_rows:
                rows.append(_named(batch.slice(begun)))
        if rows:
            yield block()

    return in_arrow(docs.select(*kept), run, StructType.fromDDL("block long, rest binary, sizes binary, learn binary, codes binary, words binary"))


def _named(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The text and whether it is learnt get names that no other column has; the text itself isn't kept."""
    n = batch.num_rows
    return pa.RecordBatch.from_arrays([pa.nulls(n), *batch.columns[1:]], names=["_text", "_learn", *(f"c{k}" for k in range(batch.num_columns - 2))])


class Block:
    """The words and pairs of a coded block, in the order in which it asks for them."""

    def __init__(self, sizes: bytes, learn: bytes, codes: bytes, words: bytes, buckets: int):
        self.sizes = np.frombuffer(sizes, np.int32).astype(np.int64)
        self.hashes = unpacked(words, WIDTH)
        v = len(self.hashes)
        self.word = unsqueezed(codes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.learnt = np.repeat(np.frombuffer(learn, np.uint8), self.sizes)
        keys = self.word * np.int64(v)
        begins = np.ones(len(keys), bool)
        begins[self.starts] = False
        begins = np.flatnonzero(begins)
        keys[begins] += self.word[begins - 1]  # the end, number 0, stands before a text
        del begins
        self.token_keys = keys
        order = keys * 2
        order += self.learnt
        order.sort()
        first = np.flatnonzero(np.diff(order >> 1, prepend=-1))
        self.keys = order[first] >> 1
        order &= 1
        self.count = np.add.reduceat(order, first).astype(np.int32)
        del order, first
        self.w, self.u = (self.keys // v).astype(np.int32), (self.keys % v).astype(np.int32)
        bucket = bucket_of(self.hashes[self.w] + (self.hashes[self.u] & np.uint64(3)) * _ODD, buckets)
        self.order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        self.bucket = bucket[self.order]
        self.word_bucket = bucket_of(self.hashes, buckets)
        self.word_order = np.argsort(self.word_bucket, kind="stable")
        self.word_bucket = self.word_bucket[self.word_order]

    def pair_asks(self):
        """Bucket, keys and counts: each distinct word once, the number of its pairs, and the words before."""
        for b, a, z in runs(self.bucket):
            at = self.order[a:z]
            w = self.w[at]
            first = np.flatnonzero(np.diff(w, prepend=-1))
            lengths = np.diff(first, append=len(w)).astype(np.int32)
            yield b, packed(self.hashes[w[first]], WIDTH), squeezed(lengths), packed(self.hashes[self.u[at]], WIDTH), squeezed(self.count[at])

    def word_asks(self):
        n = np.bincount(self.word[self.learnt > 0], minlength=len(self.hashes))
        for b, a, z in runs(self.word_bucket):
            at = self.word_order[a:z]
            yield b, packed(self.hashes[at], WIDTH), squeezed(n[at])


#: Tasks at most; beyond, a task has several buckets.
PARTS = 20_000


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h) >> np.uint64(20)).astype(np.int64) % buckets


def runs(x: np.ndarray):
    """Value, begin and end of each run of equal values."""
    first = np.flatnonzero(np.diff(x, prepend=-1))
    return zip(x[first].tolist(), first.tolist(), np.append(first[1:], len(x))[: len(first)].tolist(), strict=True)


def asks(blocks: DataFrame, buckets: int) -> DataFrame:
    """What the blocks ask for, by bucket (words: buckets from `buckets` on)."""

    def run(batches):
        for batch in batches:
            for block, *parts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                x = Block(*parts, buckets)
                rows = [(b, block, w, n, u, c) for b, w, n, u, c in x.pair_asks()] + [(b + buckets, block, h, None, None, c) for b, h, c in x.word_asks()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32(), pa.int64()] + [pa.binary()] * 4, strict=True)], names=["bucket", "block", "w", "n", "u", "c"])

    return in_arrow(blocks.select("block", "sizes", "learn", "codes", "words"), run, StructType.fromDDL("bucket int, block long, w binary, n binary, u binary, c binary"))


#: What the tasks of merged() return: rows of several kinds.
_FOUND = "kind int, bucket int, block long, place int, n long, keys binary, w binary, u binary, counts binary"


def merged(asked: DataFrame, buckets: int) -> DataFrame:
    """Counts over all blocks. kind 0: the answers to a block by place (0: not met in training, 1: met once, k + 2: entry k of the
    bucket). 1: the entries of a bucket of words (hashes and counts). 2: for a bucket of words, how many pairs met once have each
    as word (place 0) or word before (place 1). 3: how many words (block 0) and pairs (block 1) were met `place` times, 1 or 2.
    4: the entries of a bucket of pairs, with their words numbered in the order in which the bucket asks for them.
    5: what a bucket of pairs (block) asks of a bucket of words, and how many entries have each word as word before (u) or word (w)."""

    def run(groups):
        for bucket, rows in groups:
            w, u, c, sizes = [], [], [], []
            for _, _, hashes, lengths, before, counts in rows:
                h = unpacked(hashes, WIDTH)
                w.append(h if before is None else np.repeat(h, unsqueezed(lengths)))
                u.append(None if before is None else unpacked(before, WIDTH))
                c.append(unsqueezed(counts))
                sizes.append(len(c[-1]))
            pairs, w, c = bucket < buckets, np.concatenate(w), np.concatenate(c)
            u = np.concatenate(u) if pairs else None
            _, first, of = np.unique(mix(w * _ODD + u) if pairs else w, return_index=True, return_inverse=True)
            total = np.bincount(of, c, len(first)).astype(np.int64)
            entry, once = np.flatnonzero(total > 1), total == 1
            place = np.minimum(total, 1).astype(np.int32)
            place[entry] = np.arange(2, len(entry) + 2)
            answers = np.split(place[of], np.cumsum(sizes)[:-1])
            yield _rows(_FOUND, kind=[0] * len(rows), bucket=[bucket] * len(rows), block=[r[1] for r in rows], keys=[squeezed(a) for a in answers])
            yield _rows(_FOUND, kind=[3, 3], bucket=[bucket] * 2, block=[int(pairs)] * 2, place=[1, 2], n=[int((total == k).sum()) for k in (1, 2)])
            w = w[first]
            if not pairs:
                yield _rows(_FOUND, kind=[1], bucket=[bucket], n=[int(total[entry].sum())], keys=[packed(w[entry], WIDTH)], counts=[squeezed(total[entry])])
                continue
            u = u[first]
            for side, words in enumerate((w[once], u[once])):
                h, n = np.unique(words, return_counts=True)
                order, parts = _by_bucket(h, buckets)
                yield from (_rows(_FOUND, kind=[2], bucket=[b + buckets], place=[side], keys=[packed(h[order[a:z]], WIDTH)], counts=[squeezed(n[order[a:z]])]) for b, a, z in parts)
            if len(entry):
                words, of = np.unique(np.concatenate([w[entry], u[entry]]), return_inverse=True)
                order, parts = _by_bucket(words, buckets)
                rank = np.empty(len(words), np.int32)
                rank[order] = np.arange(len(words))
                words, of_w, of_u = words[order], rank[of[: len(entry)]], rank[of[len(entry) :]]
                yield _rows(_FOUND, kind=[4], bucket=[bucket], keys=[packed(words, WIDTH)], w=[squeezed(of_w)], u=[squeezed(of_u)], counts=[squeezed(total[entry])])
                as_w, as_u = np.bincount(of_w, minlength=len(words)), np.bincount(of_u, minlength=len(words))
                yield from (_rows(_FOUND, kind=[5], bucket=[b + buckets], block=[bucket], keys=[packed(words[a:z], WIDTH)], w=[squeezed(as_w[a:z])], u=[squeezed(as_u[a:z])]) for b, a, z in parts)

    return grouped(asked, ["bucket"], run, StructType.fromDDL(_FOUND), parts=min(2 * buckets, PARTS), direct=True)


def _by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, list]:
    """An order of words by bucket, and the bucket, begin and end of each run in it."""
    to = bucket_of(h, buckets)
    order = np.argsort(to, kind="stable")
    return order, list(runs(to[order]))


_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _rows(ddl: str, **columns) -> pa.RecordBatch:
    """A batch of the columns of a schema; those not given are null."""
    size, schema = len(columns["kind"]), [part.split() for part in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], _KINDS[k]) if c in columns else pa.nulls(size, _KINDS[k]) for c, k in schema], names=[c for c, _ in schema])


def frozen(**arrays) -> bytes:
    return _compressed(pickle.dumps(arrays, protocol=5))


def thawed(raw: bytes) -> dict:
    return pickle.loads(_raw(raw))  # what frozen() wrote to our own tables


def _compressed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _raw(compressed: bytes) -> bytes:
    return pa.decompress(compressed[8:], int.from_bytes(compressed[:8], "little"), codec="zstd", asbytes=True)


def _times(a: int, b: int) -> np.uint64:
    return np.uint64(int(a) * b & 0xFFFFFFFFFFFFFFFF)


class Chance:
    """Streams of random numbers, each told by a seed, so that a task run again draws the same."""

    def __init__(self, seeds: np.ndarray, sweep: int):
        self.seeds, self.drawn = mix(seeds.astype(np.uint64) + _times(_ODD, sweep + 1)), 0

    def uniform(self, rows=slice(None)) -> np.ndarray:
        self.drawn += 1
        return ((mix(self.seeds[rows] + _times(0xD1342543DE82EF95, self.drawn)) >> np.uint64(11)) + 0.5) * 2.0**-53

    def gamma(self, shape: np.ndarray) -> np.ndarray:
        """Gamma(shape, 1) for shapes of at least 1, by Marsaglia and Tsang's rejection."""
        d = shape - 1 / 3
        out, todo = np.empty(len(shape)), np.arange(len(shape))
        while todo.size:
            normal = np.sqrt(-2 * np.log(self.uniform(todo))) * np.cos(2 * np.pi * self.uniform(todo))
            v = (1 + normal / np.sqrt(9 * d[todo])) ** 3
            good = v > 0
            safe = np.where(good, v, 1.0)
            good &= np.log(self.uniform(todo)) < 0.5 * normal**2 + d[todo] * (1 - safe + np.log(safe))
            out[todo[good]] = d[todo[good]] * safe[good]
            todo = todo[~good]
        return out


def begun(customers: np.ndarray, weight: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Tables (flat sizes, and how many a dish) to begin with: about as many as the weight lets expect, sizes falling by a power."""
    t = np.clip(np.rint(1 + weight * np.log((weight + customers) / (weight + 1 - discount))), 1, customers).astype(np.int64)
    first = np.cumsum(t) - t
    share = (np.arange(t.sum()) - np.repeat(first, t) + 1.0) ** (-1 / discount)
    share /= np.repeat(np.add.reduceat(share, first), t) if len(t) else 1
    sizes = 1 + np.floor(share * np.repeat(customers - t, t)).astype(np.int64)
    if len(t):
        sizes[first] += customers - np.add.reduceat(sizes, first)
    return sizes, t


def resized(sizes: np.ndarray, t: np.ndarray, customers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables of `customers` customers, each table keeping its share of them, and one customer at least."""
    kept = np.minimum(t, customers)
    rank = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
    sizes = sizes[rank < np.repeat(kept, t)]
    if not len(kept):
        return sizes, kept
    first = np.cumsum(kept) - kept
    over = np.maximum(np.add.reduceat(sizes, first) - kept, 1)
    sizes = 1 + (sizes - 1) * np.repeat(customers - kept, kept) // np.repeat(over, kept)
    sizes[first] += customers - np.add.reduceat(sizes, first)
    return sizes, kept


def reseated(sizes: np.ndarray, t: np.ndarray, customers: np.ndarray, weight: np.ndarray, discount: float, chance: Chance) -> tuple[np.ndarray, np.ndarray]:
    """Tables (flat sizes, and how many a dish) after as many customers of each dish as it has, drawn at random, have got up one after
    another and been seated anew. Where `customers` differs from the tables', these grow or shrink in proportion first. These are the
    plain steps whose distribution tables_drawn() draws from at once; they give tables' sizes, which the model doesn't need."""
    sizes, t = resized(sizes, t, customers)
    first = np.cumsum(t) - t
    wide = 1 << np.ceil(np.log2(np.maximum(customers, 1))).astype(np.int64)
    out_t, parts = np.zeros(len(t), np.int64), []
    for cap in np.unique(wide):
        members = np.flatnonzero(wide == cap)
        for at in range(0, len(members), max(1, 2_000_000 // int(cap))):
            m = members[at : at + max(1, 2_000_000 // int(cap))]
            x = np.zeros((len(m), int(cap)))
            row = np.repeat(np.arange(len(m)), t[m])
            column = np.arange(t[m].sum()) - np.repeat(np.cumsum(t[m]) - t[m], t[m])
            x[row, column] = sizes[np.repeat(first[m], t[m]) + column]
            for step in range(int(customers[m].max())):
                rows = np.flatnonzero(customers[m] > step)
                _leave(x, rows, chance.uniform(m[rows]))
                _seat(x, rows, weight[m], discount, chance.uniform(m[rows]))
            out_t[m] = (x > 0).sum(axis=1)
            parts.append((np.repeat(m, out_t[m]), x[x > 0]))
    if not parts:
        return np.zeros(0, np.int64), out_t
    owner, flat = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
    return flat[np.argsort(owner, kind="stable")], out_t


def _leave(x: np.ndarray, rows: np.ndarray, u: np.ndarray) -> None:
    """One customer of each row, drawn at random, leaves its table."""
    sums = np.cumsum(x[rows], axis=1)
    x[rows, (sums <= (u * sums[:, -1])[:, None]).sum(axis=1)] -= 1


def _seat(x: np.ndarray, rows: np.ndarray, weight: np.ndarray, discount: float, u: np.ndarray) -> None:
    """One customer of each row comes: a table of n customers has weight n - discount, a new one `weight`."""
    mine = x[rows]
    sums = np.cumsum(np.where(mine > 0, mine - discount, 0.0), axis=1)
    r = u * (weight[rows] + sums[:, -1])
    new = r >= sums[:, -1]
    x[rows, np.where(new, (mine == 0).argmax(axis=1), (sums <= r[:, None]).sum(axis=1))] += 1


#: Customers of a dish up to which generalised Stirling numbers are listed, and nodes and cells of the integrals beyond.
LISTED, NODES, CELLS = 1_024, 64, 1 << 20


@functools.lru_cache(2)
def stirling_logs(discount: float, upto: int = LISTED) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(n, t), n and t up to `upto`, by S(n + 1, t) = S(n, t - 1) + (n - t d) S(n, t)."""
    out = np.full((upto + 1, upto + 1), -np.inf)
    out[1, 1] = 0.0
    for n in range(1, upto):
        out[n + 1, 1 : n + 1] = np.logaddexp(out[n, :n], np.log(n - np.arange(1, n + 1) * discount) + out[n, 1 : n + 1])
        out[n + 1, n + 1] = 0.0
    return out


def tables_drawn(customers: np.ndarray, weight: np.ndarray, discount: float, chance: Chance) -> np.ndarray:
    """The number of tables of each dish, drawn with weight S(n, t) x ** t for t tables of its n customers, x its weight: the distribution
    that seating all customers anew, over and over, leads to."""
    u, out = chance.uniform(), np.minimum(customers, 1).astype(np.int64)
    order = np.argsort(customers, kind="stable")
    order = order[np.searchsorted(customers[order], 2) :]
    for n, a, z in runs(customers[order]):
        if n > LISTED:
            out[order[a:z]] = [large_drawn(n, x, discount, y) for x, y in zip(weight[order[a:z]].tolist(), u[order[a:z]].tolist(), strict=True)]
            continue
        logs, t = stirling_logs(discount)[n, 1 : n + 1], np.arange(1, n + 1)
        for at in range(a, z, CELLS // n):
            m = order[at : min(z, at + CELLS // n)]
            p = logs + np.log(weight[m])[:, None] * t
            p = np.exp(p - p.max(axis=1, keepdims=True)).cumsum(axis=1)
            out[m] = 1 + (p[:, :-1] <= (u[m] * p[:, -1])[:, None]).sum(axis=1)
    return out


def large_chances(n: int, weight: float, discount: float) -> tuple[int, np.ndarray]:
    """The least t of the range that holds all but some 1e-16 of the tables of a large dish, and the chances of each t from there, up to a factor.

    S(n, t) x ** t / n! is y ** t / t! times the coefficient of z ** n in (1 - (1 - z) ** d) ** t, with y = x / d: Cauchy's integral, by the
    trapezoid rule on a path through the saddle point of their sum exp(y (1 - (1 - z) ** d)) / z ** n. With v = 1 - z the path is a parabola about
    the cut of v ** d; where the saddle is nearer to z = 0, a circle about that.
    """
    d, y = discount, weight / discount
    low, high = -700.0, -1e-12  # of ln v, where y d v ** (d - 1) (1 - v) = n
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if math.log(weight / n) + (d - 1) * middle + math.log(-math.expm1(middle)) > 0 else (low, middle)
    v, z, mean = math.exp(low), -math.expm1(low), min(-y * math.expm1(d * low), n)
    wide = 10 * math.sqrt(min(mean, n - mean)) + 30  # t is a sum of independent indicators
    least, most = max(1, int(mean - wide)), min(n, int(mean + wide) + 1)
    t = np.arange(least, most + 1)
    if v < 0.1:
        v = max(v, 3 / n)
        curve = 4 * v * v * (y * d * (1 - d) * v ** (d - 2) + n / (1 - v) ** 2) + 2 * v * (n / (1 - v) - y * d * v ** (d - 1))
        s = 1 + 1j * min(0.4 / math.sqrt(curve), 0.15) * np.arange(NODES)
        path = v * s * s
        each, factor = np.log(-np.expm1(d * np.log(path))), np.log(s) - (n + 1) * np.log1p(-path)
        factor[0] -= math.log(2)
    else:
        step = 0.4 / math.sqrt(n * (1 + (1 - d) * z / v))
        reach = 10 / math.sqrt(max(n * ((1 - d) * z / v - (n - mean) / mean), 1e-6))  # of one t; only all t together end within some steps
        nodes = math.ceil(min(reach, math.pi) / step)
        path = z * np.exp(1j * min(step, math.pi / nodes) * (np.arange(nodes) + 0.5))
        each, factor = np.log(-np.expm1(d * np.log1p(-path))), -n * np.log(path)
    logs = t * math.log(y) - np.cumsum(np.log(t))
    top = (logs + t * each[0].real).max() + factor[0].real
    rows = CELLS // len(path) + 1
    found = [np.exp((logs[at : at + rows, None] - top) + t[at : at + rows, None] * each + factor).real.sum(axis=1) for at in range(0, len(t), rows)]
    return least, np.maximum(np.concatenate(found), 0.0)


def large_drawn(n: int, weight: float, discount: float, u: float) -> int:
    least, chances = large_chances(n, weight, discount)
    sums = np.cumsum(chances)
    return least + int(np.searchsorted(sums[:-1], u * sums[-1], side="right"))


#: What the steps of the sampler return. kind 0: a bucket's state; 1: what it tells a bucket of the other sort (block); 2: sums over
#: its words (c: customers of the root, t: their tables, once and twice: words with one and two customers); 3: places asked for.
_STEP = "kind int, bucket int, block int, state binary, c long, t long, once long, twice long"


def words_begun(found: DataFrame, buckets: int) -> DataFrame:
    """The buckets' words met at least twice: counts and how many pairs met once have each as word or word before; and at which
    places the buckets of pairs ask for them."""

    def run(groups):
        for bucket, rows in groups:
            entries = [r for r in rows if r[1] == 1]
            if not entries or not (h := unpacked(entries[0][4], WIDTH)).size:
                continue
            sums = np.zeros((2, len(h)), np.int64)
            for _, kind, block, place, keys, _, _, counts in rows:
                if kind == 2:
                    x = unpacked(keys, WIDTH)
                    at = np.minimum(np.searchsorted(h, x), len(h) - 1)
                    sums[place, at[h[at] == x]] += unsqueezed(counts)[h[at] == x]
            yield _rows(_STEP, kind=[0], bucket=[bucket], state=[frozen(h=h, n=unsqueezed(entries[0][7]).astype(np.int64), as_word=sums[0], as_before=sums[1], kept=[])])
            for _, kind, block, _, keys, w, u, _ in rows:
                if kind == 5:
                    yield _rows(_STEP, kind=[3], bucket=[bucket], block=[block], state=[frozen(at=np.searchsorted(h, unpacked(keys, WIDTH)).astype(np.int32))])
                    yield _rows(_STEP, kind=[1], bucket=[bucket], block=[block], state=[frozen(as_w=unsqueezed(w), as_u=unsqueezed(u))])

    rows = found.where(f"kind in (2, 5) or kind = 1 and bucket >= {buckets}").select("bucket", "kind", "block", "place", "keys", "w", "u", "counts")
    return grouped(rows, ["bucket"], run, StructType.fromDDL(_STEP), parts=min(buckets, PARTS), direct=True)


def words_moved(state: DataFrame, places: DataFrame, told: DataFrame, model: dict, number: int, buckets: int) -> DataFrame:
    """A sweep's part over words: the root's dishes seated anew after the tables below (told by the buckets of pairs), and what the
    buckets of pairs are to know of their words: g, and root, a word's customers less discounts there."""
    top, d, keep = dict(model["roots"][-1]) if model["roots"] else None, model["d"], number > BURN_IN
    size, d0 = model["v"] + 1, model.get("d0")

    def run(groups):
        for bucket, rows in groups:
            x = thawed(next(r[3] for r in rows if r[1] == 0))
            t, c = x["as_before"].copy(), x["as_word"].copy()
            at = {r[2]: thawed(r[3])["at"] for r in rows if r[1] == 3}
            for _, kind, block, raw in rows:
                if kind == 1:
                    sums = thawed(raw)
                    t += np.bincount(at[block], sums["as_u"], len(t)).astype(np.int64)
                    c += np.bincount(at[block], sums["as_w"], len(c)).astype(np.int64)
            x["g"] = Chance(x["h"] + np.uint64(77), number).gamma(STRENGTH / d + t)
            if number:
                g = Chance(np.array([number], np.uint64), 1000).gamma(np.array([STRENGTH / d0 + max(top["t"], 1)]))[0]
                weight = np.full(len(c), g * d0 / size)
                x["r"] = tables_drawn(c, weight, d0, Chance(x["h"] + np.uint64(5), number))
            else:
                x["r"] = np.ones(len(c), np.int64)
            if keep:
                x["kept"].append((t, c, x["r"]))
            yield _rows(_STEP, kind=[0, 2], bucket=[bucket] * 2, state=[frozen(**x), None], c=[None, int(c.sum())], t=[None, int(x["r"].sum())], once=[None, int((c == 1).sum())], twice=[None, int((c == 2).sum())])
            for block, places_ in at.items():
                yield _rows(_STEP, kind=[1], bucket=[bucket], block=[block], state=[frozen(g=x["g"][places_], c=c[places_].astype(np.int64), r=x["r"][places_])])

    union = state.union(places).union(told).select("bucket", "kind", "block", "state")
    return grouped(union, ["bucket"], run, StructType.fromDDL(_STEP), parts=min(buckets, PARTS), direct=True)


def pairs_begun(found: DataFrame) -> DataFrame:
    """The buckets' pairs met at least twice."""

    def run(batches):
        for batch in batches:
            for bucket, keys, w, u, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                n = unsqueezed(counts).astype(np.int64)
                yield _rows(_STEP, kind=[0], bucket=[bucket], state=[frozen(h=unpacked(keys, WIDTH), w=unsqueezed(w), u=unsqueezed(u), n=n, kept=np.zeros(len(n), np.int64))])

    return in_arrow(found.where("kind = 4").select("bucket", "keys", "w", "u", "counts"), run, StructType.fromDDL(_STEP))


def pairs_moved(state: DataFrame, told: DataFrame, model: dict, number: int, buckets: int) -> DataFrame:
    """A sweep's part over pairs: the restaurants' dishes seated anew, given what the buckets of words tell; and what those are to know."""
    d, d0, keep, top = model["d"], model["d0"], number > BURN_IN, STRENGTH + model["roots"][-1]["c"]
    mass = root_mass(model)

    def run(groups):
        for bucket, rows in groups:
            x = thawed(next(r[2] for r in rows if r[1] is None))
            told_ = [thawed(r[2]) for r in rows if r[1] is not None]
            g = np.concatenate([y["g"] for y in told_])
            p = (np.concatenate([y["c"] - d0 * y["r"] for y in told_]) + mass) / top
            weight = d * g[x["u"]] * p[x["w"]]
            t = tables_drawn(x["n"], weight, d, Chance(mix(x["h"][x["w"]] * _ODD + x["h"][x["u"]]), number))
            if keep:
                x["kept"] = x["kept"] + t
            yield _rows(_STEP, kind=[0], bucket=[bucket], state=[frozen(**x)])
            as_u, as_w = (np.bincount(x[k], t, len(x["h"])).astype(np.int64) for k in "uw")
            for b, a, z in runs(bucket_of(x["h"], buckets)):
                yield _rows(_STEP, kind=[1], bucket=[b + buckets], block=[bucket], state=[frozen(as_u=as_u[a:z], as_w=as_w[a:z])])

    union = state.select("bucket", F.lit(None).cast("int").alias("of"), "state").union(told.select(F.col("block").alias("bucket"), F.col("bucket").alias("of"), "state"))
    return grouped(union, ["bucket"], run, StructType.fromDDL(_STEP), then=["of"], parts=min(buckets, PARTS), direct=True)


def discount_of(once: int, twice: int) -> float:
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.95)) if once else 0.5


def root_mass(model: dict, number: int = -1) -> float:
    """What the base adds to each word's customers at the root."""
    return (STRENGTH + model["d0"] * model["roots"][number]["t"]) / (model["v"] + 1)


def trained(found: DataFrame, buckets: int) -> tuple[dict, DataFrame, DataFrame]:
    """The model's numbers, and the last states of its words and pairs met at least twice, from merged counts."""
    sizes = {(r["block"], r["place"]): r["s"] for r in found.where("kind = 3").groupBy("block", "place").agg(F.sum("n").alias("s")).collect()}
    hapax = sizes.get((0, 1), 0)
    words = table(words_begun(found, buckets), "lm-words", by="kind")
    n = found.where(f"kind = 1 and bucket >= {buckets}").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = found.where(f"kind = 1 and bucket >= {buckets}").agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0] // WIDTH
    model = {"v": size + hapax, "n": n + hapax, "d": discount_of(sizes.get((1, 1), 0), sizes.get((1, 2), 0)), "roots": []}
    kind = lambda df, k: df.where(F.col("kind") == k).select(*[p.split()[0] for p in _STEP.split(", ")])
    first, states, seats = words, words, pairs_begun(found)
    told = kind(words, 1)
    for number in range(SWEEPS + 1):
        if number:
            moved = table(pairs_moved(kind(seats, 0), kind(states, 1), model, number, buckets), "lm-pairs", by="kind")
            discard(seats)
            seats, told = moved, kind(moved, 1)
        moved = table(words_moved(kind(states, 0), kind(first, 3), told, model, number, buckets), "lm-states", by="kind")
        if states is not first:
            discard(states)
        states = moved
        r = kind(states, 2).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("c", "t", "once", "twice")]).first()
        if not number:
            model["d0"] = discount_of(r["once"] + hapax, r["twice"])
        model["roots"].append({"c": r["c"] + hapax, "t": r["t"] + hapax})
    discard(first)
    return model, states, seats


def _record(kept: int) -> np.dtype:
    return np.dtype([("n", "<i8"), ("a", "<f4", (kept,)), ("p", "<f4", (kept,))])


def word_values(states: DataFrame, model: dict) -> tuple[DataFrame, bytes]:
    """By bucket the values of the words met at least twice; and those of a word not met and of one met once.

    n: its count; for each sweep kept a: the weight that the word's own restaurant gives the root; p: the root's probability."""
    kinds = _record(SWEEPS - BURN_IN)
    roots, d, d0 = model["roots"][BURN_IN + 1 :], model["d"], model["d0"]
    mass = np.array([root_mass(model, k) for k in range(BURN_IN + 1, SWEEPS + 1)])
    total = np.array([STRENGTH + r["c"] for r in roots])
    other = np.zeros(2, kinds)
    other["n"] = [0, 1]
    other["a"] = [[1.0], [(STRENGTH + d) / (STRENGTH + 1)]]
    other["p"] = [mass / total, (1 - d0 + mass) / total]

    def values(x: dict) -> np.ndarray:
        out = np.zeros(len(x["n"]), kinds)
        out["n"] = x["n"]
        for k, (t, c, r) in enumerate(x["kept"]):
            out["a"][:, k] = (STRENGTH + d * t) / (STRENGTH + x["n"])
            out["p"][:, k] = (c - d0 * r + mass[k]) / total[k]
        return out

    return _values(states, values), other.tobytes()


def pair_values(seats: DataFrame, model: dict) -> tuple[DataFrame, bytes]:
    """By bucket the customers less discounts of the pairs met at least twice; and those of a pair not met and of one met once."""
    kept, d = SWEEPS - BURN_IN, model["d"]
    return _values(seats, lambda x: (x["n"] - d * x["kept"] / kept).astype("<f4")), np.array([0, 1 - d], "<f4").tobytes()


def _values(states: DataFrame, values) -> DataFrame:
    """bucket and values, from the states of buckets."""

    def run(batches):
        for batch in batches:
            for bucket, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([values(thawed(raw)).tobytes()], pa.binary())], names=["bucket", "values"])

    return in_arrow(states.where("kind = 0").select("bucket", "state"), run, StructType.fromDDL("bucket int, values binary"))


def answered(found: DataFrame, words: tuple[DataFrame, bytes], pairs: tuple[DataFrame, bytes], buckets: int) -> DataFrame:
    """block, bucket and values: those that a block asked for in a bucket, in its order (compressed)."""
    none = lambda kind, c: F.lit(None).cast(kind).alias(c)
    asked = found.where("kind = 0").select("bucket", "block", F.col("keys").alias("values"))
    given = words[0].union(pairs[0]).select("bucket", none("long", "block"), "values")

    def run(groups):
        for bucket, rows in groups:
            other = words[1] if bucket >= buckets else pairs[1]
            kind = np.dtype((np.void, len(other) // 2))
            table_ = np.frombuffer(other + b"".join(r[2] for r in rows if r[1] is None), kind)
            for _, block, places in rows:
                if block is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([_compressed(table_[unsqueezed(places)].tobytes())], pa.binary())], names=["block", "bucket", "values"])

    words, pairs = (None, words[1]), (None, pairs[1])  # run() takes no DataFrames along
    return grouped(given.union(asked), ["bucket"], run, StructType.fromDDL("block long, bucket int, values binary"), then=["block"], parts=min(2 * buckets, PARTS), direct=True)


def score(docs: DataFrame, learn: str, text: str = "text") -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score to docs' rows, learning from those whose column `learn` is true
    (null: false); the columns text and learn go, clashing ones are replaced, others stay.

    n_known: tokens met in training; train_tokens: all tokens of training. base_score adds
    log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens, score the model's log10 probabilities, so 10 ** (-sum of score / sum
    of n_tokens) is its perplexity. Null and empty texts consist of their end alone. Each row is scored by itself, with the
    rows learnt from counted as often as they repeat; equal texts get equal scores, and ids play no part. Without any training
    text every token has probability 1. An empty table gives an empty table. Very long texts are whole: a block of texts ends after the
    text that fills it.
    """
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = docs.drop(*[c for c in added if c not in (text, learn)])
    others = [c for c in kept.columns if c not in (text, learn)]
    ordered = kept.select(F.col(text), F.col(learn), *others)
    buckets = 1 << max(0, -(-ordered.count() // BUCKET_DOCS) - 1).bit_length()
    blocks = table(coded(ordered, learn, text), "lm-blocks")
    found = table(merged(asks(blocks, buckets), buckets), "lm-found", by="kind")
    model, states, seats = trained(found, buckets)
    answers = table(answered(found, word_values(states, model), pair_values(seats, model), buckets), "lm-answers")
    for old in (found, states, seats):
        discard(old)
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    rows = answers.select("block", "bucket", "values", *none("binary", "rest", "sizes", "learn", "codes", "words"))
    rows = rows.union(blocks.select("block", *none("int", "bucket"), *none("binary", "values"), "rest", "sizes", "learn", "codes", "words"))
    schema = schema_with(kept.select(*others), "n_tokens long", "n_known long", "base_score double", "score double")
    n, v, kinds = model["n"], model["v"], _record(SWEEPS - BURN_IN)

    def run(groups):
        for _, given in groups:
            (row,) = [r for r in given if r[1] is None]
            x = Block(*row[4:], buckets)
            own, record = np.empty(len(x.keys), np.float64), np.empty(len(x.hashes), kinds)
            at = {True: 0, False: 0}
            for _, bucket, values, *_ in given:
                if bucket is not None:
                    raw, of_words = _raw(values), bucket >= buckets
                    got = np.frombuffer(raw, kinds if of_words else "<f4")
                    to, order = (record, x.word_order) if of_words else (own, x.order)
                    to[order[at[of_words] : at[of_words] + len(got)]] = got
                    at[of_words] += len(got)
            count = record["n"]
            p = own / (STRENGTH + count[x.u])
            for k in range(SWEEPS - BURN_IN):
                p += (record["a"][:, k].astype(np.float64)[x.u] * record["p"][:, k].astype(np.float64)[x.w]) / (SWEEPS - BURN_IN)
            del own
            by_token = np.log10(p)[np.searchsorted(x.keys, x.token_keys)]
            base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))[x.word]
            sums = [np.add.reduceat(c, x.starts) for c in ((count > 0)[x.word].astype(np.int64), base, by_token)]
            rest = pa.ipc.open_stream(row[3]).read_all().combine_chunks()
            more = [pa.array(c) for c in (x.sizes, *sums)]
            whole = pa.Table.from_arrays([*rest.columns, *more], names=schema.names)
            yield from whole.combine_chunks().to_batches()

    scored = grouped(rows, ["block"], run, schema, then=["bucket"], nulls_last=True, parts=min(2 * buckets, PARTS))
    return scored.withColumn("train_tokens", F.lit(n).cast("long")).select(*others, *added)


FOLDS, HELD_OUT = 5, 1


def op8_lm_score(spark, sf_dir):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    from .common import read

    held_out = fold("doc_id", FOLDS) == HELD_OUT
    docs = read(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text", (~held_out).alias("learn"))
    return score(docs, "learn")
