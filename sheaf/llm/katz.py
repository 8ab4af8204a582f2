"""Katz backoff language model over words of any order, trained and evaluated in exchanges of blocks.

P(w | h) is the Good-Turing discounted share of h's continuations that are w if
the n-gram was seen in training, else alpha(h) * P(w | h'), where h' is h without
its first word; P(w) is the discounted share of w itself, the mass left over
belonging to words never seen.  alpha(h) makes the probabilities of all words
after h sum to 1.  Counts up to five are discounted (Katz 1987); larger ones are
taken as they are.  A history whose continuations leave no mass by discounts
gives one count to the rest.

The corpus never travels word by word.  It is written once as chunks (documents
of one task: local dictionary, packed local ids).  For each order a chunk sends
every bucket one block of its distinct keys with training counts; the bucket
adds up, stores its part of the model, and answers each chunk in the order asked.
Answers are stored by chunk, and a chunk's task reads its own.

 order 1:     bucket of the word     -> count of each word
 order m > 1: bucket of the history  -> count of each n-gram, and for each history
              the number of continuations by count, their sum, and the sum of their
              probabilities by order m - 1, which the chunks send along

So each alpha is known once the discounts are, without another pass, and an
order's probabilities follow from those of the order below, token by token.
Histories of one bucket's share of all tokens or more, and the text's start, are
spread over all buckets, and their few sums added up apart.  Buckets follow the
tokens; an exchange is made in ``PASSES`` parts, so that one part is on disk at a time.

The stored model (``model``, kept if a folder is named): ``ngrams/order=m``
(history, word, count), ``backoff/order=m`` (history, alpha, scale, total) and
``discounts``; ``load`` and ``probabilities`` evaluate it by joins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.files import located, new_file
from sheaf.llm.tables import deleted, fitted, integral, ready, released, shared_path, text_bytes, written
from sheaf.llm.token_output import pack, unpack
from sheaf.llm.words import distinct, group, lean, mix, of_column, pieces

_U = np.uint64
#: The end of a text, a token, and its start, a history only.
END, START = _U(0x0E0D0F0C0A0B0D01), _U(0x05B0A0B050F0D0E03)
K = 5
CHUNK_TOKENS = 9 << 19
#: Tokens for each bucket, and parts of an exchange of n-grams.
BUCKET_TOKENS, PASSES = 1 << 19, 2
W48 = _U((1 << 48) - 1)


def held_out(ids: list) -> np.ndarray:
    """Whether crc32 of the id as text is 0 modulo 10; a null id counts as the empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in ids], bool)


def _squeezed(x: np.ndarray) -> bytes:
    """Bytes of integers or floats, byte planes apart, compressed; the first 8 bytes have the length."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T) if len(x) else np.empty(0, np.uint8)
    return np.int64(len(x)).tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _spread(b: bytes, dtype) -> np.ndarray:
    n, size = int(np.frombuffer(b[:8], np.int64)[0]), np.dtype(dtype).itemsize
    if not n:
        return np.empty(0, dtype)
    planes = np.frombuffer(pa.decompress(b[8:], decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


@lean
def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    ids: list = []
    hashes: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal ids, hashes, counts, held, number
        flat, n = np.concatenate(hashes), np.concatenate(counts)
        hashes = []
        words, which = distinct(flat)
        del flat
        times = np.bincount(which, minlength=len(words))
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        tokens = rank[which]
        train = np.bincount(tokens[np.repeat(~held_out(ids), n)], minlength=len(words))
        control, data = pack(tokens)
        row = {"chunk": (part << 20) + number, "ids": ids, "tokens": n.tolist(), "control": control, "data": data, "words": words[order].tobytes(), "train": _squeezed(train)}
        ids, hashes, counts, held, number = [], [], [], 0, number + 1
        return pa.RecordBatch.from_pylist([row], schema=_CHUNK)

    for batch in batches:
        for piece in pieces(batch):
            words = of_column(piece.column("text"), lower=True)
            ids += piece.column("id").to_pylist()
            hashes.append(np.insert(words.hash, words.first[1:], END))
            counts.append(words.counts + 1)
            held += len(hashes[-1])
            if held >= CHUNK_TOKENS:
                yield flush()
    if ids:
        yield flush()


_CHUNK = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary()), ("words", pa.binary()), ("train", pa.binary())])
_CHUNK_SQL = "chunk long, ids array<long>, tokens array<long>, control binary, data binary, words binary, train binary"
#: Answers of chunk PARTS tell where the model's parts are (a: n-grams, b: histories) and their sums (e); those of chunk HOT the sums of a spread history (e, f).
PARTS, HOT = -1, -2
_ASK = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), *((x, pa.binary()) for x in "abcd"), ("e", pa.list_(pa.int64())), ("f", pa.float64())])
_ASK_SQL = "bucket long, chunk long, a binary, b binary, c binary, d binary, e array<long>, f double"


def _row(bucket: int, chunk: int, *parts: bytes, e: list[int] | None = None, f: float | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"bucket": bucket, "chunk": chunk, "e": e, "f": f} | dict(zip("abcd", parts, strict=False))], schema=_ASK)


def _coded(x: np.ndarray) -> bytes:
    """Doubles as their distinct values and the place of each among them."""
    values, which = np.unique(x, return_inverse=True)
    table = _squeezed(values)
    return np.int64(len(table)).tobytes() + table + _squeezed(which.astype(np.uint32))


def _decoded(b: bytes) -> np.ndarray:
    stop = 8 + int(np.frombuffer(b[:8], np.int64)[0])
    return _spread(b[8:stop], np.float64)[_spread(b[stop:], np.uint32)]


def _bucket_order(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


@lean
def _ask_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            words, train = np.frombuffer(r["words"], np.uint64), _spread(r["train"], np.int64)
            order, cuts = _bucket_order(words % _U(buckets), buckets)
            for b in range(buckets):
                own = order[cuts[b] : cuts[b + 1]]
                if len(own):
                    yield _row(b, r["chunk"], words[own].tobytes(), _squeezed(train[own]))


def _of_counts(c: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, ... K + 1."""
    return np.bincount(c[(c > 0) & (c <= K + 1)].astype(np.int64), minlength=K + 2)[1 : K + 2]


def _answer_words(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in b.to_pylist()]
    keys = [np.frombuffer(r["a"], np.uint64) for r in rows]
    found, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate([_spread(r["b"], np.int64) for r in rows]), minlength=len(found)).astype(np.int64)
    cuts = np.append(0, np.cumsum([len(k) for k in keys]))
    for r, a, b in zip(rows, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield _row(r["bucket"], r["chunk"], _squeezed(total[which[a:b]]))
    part = pa.table({"word": pa.array(found[total > 0].view(np.int64)), "count": pa.array(total[total > 0])})
    with new_file(f"{model}/ngrams/order=1/bucket={rows[0]['bucket']}", ".parquet") as (uri, out):
        pq.write_table(part, out, compression="zstd", use_dictionary=["count"], column_encoding={"word": "DELTA_BINARY_PACKED"})
    yield _row(rows[0]["bucket"], PARTS, uri.encode(), e=[int(total.sum()), int((total > 0).sum()), *_of_counts(total).tolist()])


def _tabled(table: pa.Table, f) -> pa.Table:
    return pa.Table.from_batches(f(iter(table.to_batches())), _ASK)


class Discounts:
    """Good-Turing factors for counts 1 to K; absolute discounting where the counts of counts allow none."""

    def __init__(self, n: np.ndarray):
        n = n.astype(float)
        d = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        fixed = np.array([(r - min(d, 0.9)) / r for r in range(1, K + 1)])
        factor = fixed
        if (n > 0).all():
            r = np.arange(1, K + 1)
            cut = (K + 1) * n[K] / n[0]
            if cut < 1:
                gt = ((r + 1) * n[1:] / n[:K] / r - cut) / (1 - cut)
                factor = np.where((gt > 0) & (gt < 1), gt, fixed)
        #: By count, 0 to K; larger ones have factor 1.
        self.factor = np.append(0.0, factor)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return np.where(c > K, c, c * self.factor[np.minimum(c, K)])


class Unigrams:
    """P(w) by the count of w; 0 stands for all unseen words together."""

    def __init__(self, n: int, kinds: int, of_counts: np.ndarray):
        self.n, self.kinds, self.discount = n, kinds, Discounts(of_counts)
        low = np.arange(1, K + 1)
        mass = n - float((of_counts[:K] * (low - self.discount(low))).sum()) if n else 0.0
        self.rest = 1 - mass / n if n else 1.0
        self.scale = 1.0
        if self.rest <= 1e-12:
            self.scale, self.rest = n / (n + 1), 1 / (n + 1)

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.discount(c) / max(self.n, 1) * self.scale, self.rest)


def _files(folder: str) -> list:
    store, at = located(folder)
    return [store.open_input_file(f.path) for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.path.endswith(".parquet")]


def _answers(path: str, chunk: int) -> list[dict]:
    """The rows stored for a chunk, by bucket."""
    rows = [r for f in _files(f"{path}/chunk={chunk}") for r in pq.ParquetFile(f).read().to_pylist()]
    return sorted(rows, key=lambda r: r["bucket"])


class Order:
    """What is known of an order above the first: where its answers are and the sums of spread histories, its discounts."""

    def __init__(self, paths: list[str], hot: str, discount: Discounts):
        self.paths, self.hot, self.discount = paths, hot, discount

    def spread(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted names of the spread histories, their counts (ofs and total, one row each) and sums of lower probabilities; at most one for each bucket and the start."""
        tables = [pq.ParquetFile(f).read() for f in _files(self.hot)]
        table = pa.concat_tables(tables) if tables else pa.table({"name": pa.array([], pa.int64()), "e": pa.array([], pa.list_(pa.int64())), "f": pa.array([], pa.float64())})
        name = table.column("name").to_numpy().view(np.uint64)
        order = np.argsort(name)
        sums = np.array(table.column("e").to_pylist(), np.int64).reshape(len(name), K + 1)
        return name[order], sums[order], table.column("f").to_numpy()[order]


class _Chunk:
    """A chunk with the counts of its words: ``words`` (local id -> hash), ``c``, ``tokens``, ``n`` by document, ``train`` by document.

    ``rise`` goes up one order; ``name``, ``count``, ``prob`` are by local n-gram of the
    order reached, ``of`` is the n-gram that ends with each token.
    """

    def __init__(self, r: dict, words_path: str, unigrams: Unigrams, buckets: int):
        self.chunk, self.buckets, self.n_train = r["chunk"], buckets, unigrams.n
        self.words = np.frombuffer(r["words"], np.uint64)
        self.ids, self.n = r["ids"], np.array(r["tokens"])
        self.tokens = unpack(r["control"], r["data"], int(self.n.sum())).view(np.int32)
        self.train = ~held_out(self.ids)
        order, _ = _bucket_order(self.words % _U(buckets), buckets)
        self.c = np.empty(len(self.words), np.int64)
        self.c[order] = np.concatenate([_spread(x["a"], np.int64) for x in _answers(words_path, r["chunk"])])
        self.name, self.count, self.prob, self.of = self.words, self.c, unigrams(self.c), self.tokens
        self.h = None

    def climb(self) -> None:
        """The distinct n-grams of the next order, sorted by bucket, history and word: ``h`` and ``w`` (the start is len(name)), ``cuts`` of buckets, ``which`` of each token, ``lower`` probability, ``hot`` of histories."""
        d = len(self.name)
        key = np.empty(len(self.tokens), np.int64)
        key[1:] = self.of[:-1]
        key[np.cumsum(self.n) - self.n] = d
        key *= len(self.words)
        key += self.tokens
        found, which = distinct(key)
        del key
        h, w = (found // len(self.words)).astype(np.int32), (found % len(self.words)).astype(np.int32)
        del found
        self.past = np.append(self.name, START)
        self.hot = np.append(self.count * self.buckets >= max(self.n_train, 1), True)
        # By history; the n-grams of a hot one by the word too.
        bucket = (mix(self.past, 9) % _U(self.buckets)).astype(np.int32)[h]
        spread = np.flatnonzero(self.hot[h])
        bucket[spread] = mix(self.past[h[spread]] ^ mix(self.words[w[spread]], 3), 9) % _U(self.buckets)
        order, self.cuts = _bucket_order(bucket, self.buckets)
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        self.h, self.w, self.which = h[order], w[order], back[which]
        del h, w, which, back, order, bucket
        if self.of is self.tokens:
            self.lower = self.prob[self.w]
        else:
            some = np.empty(len(self.h), np.int32)
            some[self.which] = self.of
            self.lower = self.prob[some]

    def settle(self, order: Order) -> None:
        """Counts and probabilities of the order climbed to, from its answers; then this is the order reached."""
        count, prob = np.zeros(len(self.h), np.int64), np.empty(len(self.h))
        at_name, sums, below = order.spread()
        for path in order.paths:
            for x in _answers(path, self.chunk):
                own = slice(self.cuts[x["bucket"]], self.cuts[x["bucket"] + 1])
                n = count[own] = _spread(x["a"], np.int64)
                at = _runs(self.h[own])
                size = np.diff(np.append(at, own.stop - own.start))
                ofs = _spread(x["b"], np.int64).reshape(K + 1, -1).copy()
                rest = _spread(x["c"], np.float64).copy()
                heads = self.h[own][at]
                for i in np.flatnonzero(self.hot[heads]).tolist():
                    j = int(np.searchsorted(at_name, self.past[heads[i]]))
                    ofs[:, i], rest[i] = sums[j], below[j]
                alpha, scale, total = (np.repeat(v, size) for v in _alpha(ofs[:K], ofs[K], rest, order.discount))
                prob[own] = np.where(n > 0, order.discount(n) * scale / np.maximum(total, 1), alpha * self.lower[own])
        self.name, self.count, self.prob, self.of = gram_name(self.past[self.h], self.words[self.w]), count, prob, self.which
        self.h = self.w = self.which = self.lower = None


def gram_name(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The name of an n-gram, as a history of the next order."""
    return mix(mix(history, 31) + word, 32)


def _runs(h: np.ndarray) -> np.ndarray:
    """First places of the runs of equal values."""
    return np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)


@lean
def _ask_grams(batches: Iterator[pa.RecordBatch], words_path: str, unigrams: Unigrams, orders: list[Order], buckets: int, turn: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk a row for each bucket of this turn, for the order after ``orders``."""
    for batch in batches:
        for r in batch.to_pylist():
            chunk = _Chunk(r, words_path, unigrams, buckets)
            for order in orders:
                chunk.climb()
                chunk.settle(order)
            chunk.climb()
            count = np.bincount(chunk.which[np.repeat(chunk.train, chunk.n)], minlength=len(chunk.h))
            chunk.which = chunk.tokens = chunk.of = None
            low = (chunk.words & W48).view(np.uint8).reshape(-1, 8)[:, :6]
            for b in range(turn, buckets, PASSES):
                own = slice(chunk.cuts[b], chunk.cuts[b + 1])
                if own.start == own.stop:
                    continue
                h = chunk.h[own]
                at = _runs(h)
                heads = np.int64(len(at)).tobytes() + chunk.past[h[at]].tobytes() + np.packbits(chunk.hot[h[at]]).tobytes() + _squeezed(np.diff(np.append(at, len(h))))
                yield _row(b, r["chunk"], heads, low[chunk.w[own]].tobytes(), _squeezed(count[own]), _coded(chunk.lower[own]))


def _heads(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, whether they are spread, and numbers of n-grams of the histories of a block."""
    n = int(np.frombuffer(b[:8], np.int64)[0])
    stop = 8 + 8 * n
    flags = stop + (n + 7) // 8
    return np.frombuffer(b[8:stop], np.uint64), np.unpackbits(np.frombuffer(b[stop:flags], np.uint8))[:n] == 1, _spread(b[flags:], np.int64)


def _answer_grams(batches: Iterator[pa.RecordBatch], model: str, order: int) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in b.to_pylist()]
    names, flags, sizes = zip(*(_heads(r.pop("a")) for r in rows), strict=True)
    h, at_first, head = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
    hot = np.concatenate(flags)[at_first]
    head_of = np.repeat(head, np.concatenate(sizes))
    low = np.zeros((len(head_of), 8), np.uint8)
    low[:, :6] = np.frombuffer(b"".join(r.pop("b") for r in rows), np.uint8).reshape(-1, 6)
    low = low.view(np.uint64).ravel()
    # An n-gram: the history's number above the word's 48 bits would be too wide, so it is mixed.
    _, first, which = np.unique(mix(h[head_of], 21) ^ mix(low, 22), return_index=True, return_inverse=True)
    total = np.bincount(which, weights=np.concatenate([_spread(r.pop("c"), np.int64) for r in rows]), minlength=len(first)).astype(np.int64)
    lower = np.concatenate([_decoded(r.pop("d")) for r in rows])[first]
    owner = head_of[first]
    seen = total > 0
    ofs = np.zeros((K + 1, len(h)), np.int64)
    for i in range(1, K + 1):
        ofs[i - 1] = np.bincount(owner[total == i], minlength=len(h))
    ofs[K] = np.bincount(owner, weights=total, minlength=len(h)).astype(np.int64)
    below = np.bincount(owner[seen], weights=lower[seen], minlength=len(h))
    pair_cuts = np.append(0, np.cumsum([int(s.sum()) for s in sizes]))
    head_cuts = np.append(0, np.cumsum([len(x) for x in names]))
    bucket = rows[0]["bucket"]
    for i, r in enumerate(rows):
        own, heads = which[pair_cuts[i] : pair_cuts[i + 1]], head[head_cuts[i] : head_cuts[i + 1]]
        yield _row(bucket, r["chunk"], _squeezed(total[own]), _squeezed(np.ascontiguousarray(ofs[:, heads].ravel())), _squeezed(below[heads]))
    by = np.lexsort((low[first], owner))
    by = by[seen[by]]
    part = pa.table({"history": pa.array(h[owner[by]].view(np.int64)), "word": pa.array(low[first][by].view(np.int64)), "count": pa.array(total[by])})
    with new_file(f"{model}/ngrams/order={order}/bucket={bucket}", ".parquet") as (uri, out):
        pq.write_table(part, out, compression="zstd", use_dictionary=["history", "count"], column_encoding={"word": "DELTA_BINARY_PACKED"})
    whole = np.flatnonzero(~hot & (ofs[K] > 0))
    sums = pa.table({"name": pa.array(h[whole].view(np.int64)), "e": pa.ListArray.from_arrays(pa.array(np.arange(len(whole) + 1, dtype=np.int32) * (K + 1)), pa.array(np.ascontiguousarray(ofs[:, whole].T).ravel())), "f": pa.array(below[whole])})
    with new_file(f"{model}/histories/order={order}/bucket={bucket}", ".parquet") as (heads_uri, out):
        pq.write_table(sums, out, compression="zstd")
    yield _row(bucket, PARTS, uri.encode(), heads_uri.encode(), e=_of_counts(total).tolist())
    for j in np.flatnonzero(hot).tolist():
        yield _row(bucket, HOT, e=[int(h[j].view(np.int64)), *ofs[:, j].tolist()], f=float(below[j]))


def _alpha(ofs: np.ndarray, total: np.ndarray, below: np.ndarray, discount: Discounts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of histories: alpha, the factor of seen n-grams, and the number of continuations; ofs is (K, n): how many have count 1 to K."""
    total = total.astype(float)
    low = np.arange(1, K + 1)
    freed = ((low - discount(low))[:, None] * ofs).sum(axis=0)
    scale = np.where(freed > 0, 1.0, total / (total + 1))
    left = np.where(freed > 0, freed / np.maximum(total, 1), 1 / (total + 1))
    return np.where(total > 0, left / np.maximum(1 - below, 1e-300), 1.0), scale, total


@lean
def _backoff(batches: Iterator[pa.RecordBatch], discount: Discounts) -> Iterator[pa.RecordBatch]:
    """The backoff weights of histories (name, e, f)."""
    for batch in batches:
        if batch.num_rows:
            sums = np.array(batch.column("e").to_pylist(), np.int64).reshape(batch.num_rows, K + 1).T
            alpha, scale, total = _alpha(sums[:K], sums[K], batch.column("f").to_numpy(), discount)
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(alpha), pa.array(scale), pa.array(total.astype(np.int64))], ["history", "alpha", "scale", "total"])


@lean
def _score(batches: Iterator[pa.RecordBatch], words_path: str, unigrams: Unigrams, orders: list[Order], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            chunk = _Chunk(r, words_path, unigrams, buckets)
            for order in orders:
                chunk.climb()
                chunk.settle(order)
            log = np.log10(chunk.prob)[chunk.of]
            c = chunk.c[chunk.tokens]
            at = np.cumsum(chunk.n) - chunk.n
            base = np.log10((c + 0.1) / (unigrams.n + 0.1 * (unigrams.kinds + 1)))
            k = len(chunk.n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk.ids, pa.int64()), pa.array(~chunk.train), pa.array(chunk.n), pa.array(np.add.reduceat((c > 0).astype(np.int64), at)), pa.array(np.full(k, unigrams.n)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(log, at))],
                ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )


def _stored(rows: DataFrame, spark: SparkSession, name: str) -> str:
    """Answers as a table partitioned by chunk (-1: the model's parts), so that a chunk's task reads its own and nothing else."""
    path, first = shared_path(spark, name), shared_path(spark, "answers")
    schema = rows.schema
    rows.write.option("compression", "zstd").parquet(first)
    del rows
    released(spark)
    spark.read.schema(schema).parquet(first).repartition("chunk").write.option("compression", "zstd").partitionBy("chunk").parquet(path)
    deleted(spark, first)
    released(spark)
    return path


def _part(spark: SparkSession, path: str, chunk: int) -> DataFrame:
    """The rows of a chunk's own folder; the other folders are not listed."""
    store, at = located(f"{path}/chunk={chunk}")
    schema = _ASK_SQL.replace("chunk long, ", "")
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/chunk={chunk}")


def _sums(parts: DataFrame, width: int) -> np.ndarray:
    row = parts.agg(*(F.coalesce(F.sum(F.get("e", F.lit(i))), F.lit(0)) for i in range(width))).first()
    return np.array(row, np.int64)


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, model: str | None = None) -> DataFrame:
    """One row for each row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text).

    Training documents are those whose crc32(id as text) mod 10 is not 0.  Tokens
    are words without white space, A-Z lower-cased, and one end.  ``order``: words
    of an n-gram at most, 1 or more.  ``model``: a folder all executors see, which
    keeps the model for ``load``; without one it goes with the session.  A null or
    empty text is its end alone; a null id counts as the empty text for the fold.
    Repeated rows are documents of their own.  Without training documents every
    word is unseen; an empty table gives an empty table.
    """
    spark = ready(docs.sparkSession)
    source = docs.select(integral(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    # Partitions that hold little are read together: each would be a chunk of its own.
    source = fitted(source, text_bytes(source), 8 << 20)
    chunks = written(source.mapInArrow(_chunks, _CHUNK_SQL), "chunks")
    tokens = chunks.agg(F.sum(F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(8, -(-int(tokens) // BUCKET_TOKENS))

    folder = model or shared_path(spark, "model")
    asked = chunks.select("chunk", "words", "train").mapInArrow(partial(_ask_words, buckets=buckets), _ASK_SQL)
    words_path = _stored(asked.groupBy("bucket").applyInArrow(group(_tabled, partial(_answer_words, model=folder)), _ASK_SQL), spark, "unigrams")
    parts = [_part(spark, words_path, PARTS).select(F.lit(1).alias("order"), "bucket", "a", "b")]
    sums = _sums(_part(spark, words_path, PARTS), K + 3)
    unigrams = Unigrams(int(sums[0]), int(sums[1]), sums[2:])
    orders: list[Order] = []
    for m in range(2, order + 1):
        paths = []
        for turn in range(PASSES):
            asked = chunks.mapInArrow(partial(_ask_grams, words_path=words_path, unigrams=unigrams, orders=list(orders), buckets=buckets, turn=turn), _ASK_SQL)
            paths.append(_stored(asked.groupBy("bucket").applyInArrow(group(_tabled, partial(_answer_grams, model=folder, order=m)), _ASK_SQL), spark, f"order-{m}"))
        of = lambda chunk, paths=paths: reduce(DataFrame.union, (_part(spark, p, chunk) for p in paths))
        parts.append(of(PARTS).select(F.lit(m).alias("order"), "bucket", "a", "b"))
        # One row for each spread history: at most one for each bucket, and the start.
        spread = of(HOT).groupBy(F.get("e", F.lit(0)).alias("name")).agg(F.array(*(F.sum(F.get("e", F.lit(i))) for i in range(1, K + 2))).alias("e"), F.sum("f").alias("f"))
        hot = shared_path(spark, "spread")
        fitted(spread, buckets + 1).write.parquet(hot)
        orders.append(Order(paths, hot, Discounts(_sums(of(PARTS), K + 1))))
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if model:
        _kept(spark, folder, reduce(DataFrame.union, parts), unigrams, orders)
    return chunks.mapInArrow(partial(_score, words_path=words_path, unigrams=unigrams, orders=orders, buckets=buckets), schema).withColumnRenamed("id", id_col)


def _kept(spark: SparkSession, folder: str, parts: DataFrame, unigrams: Unigrams, orders: list[Order]) -> None:
    """Completes a model's folder: the list of its files, discounts, and backoff weights by order."""
    parts = parts.select("order", "bucket", F.col("a").cast("string").alias("uri"), F.col("b").cast("string").alias("histories"))
    parts.write.mode("overwrite").parquet(f"{folder}/files")
    rows = [(1, unigrams.n, unigrams.rest, unigrams.scale, unigrams.discount.factor.tolist())] + [(m, unigrams.n, 0.0, 1.0, o.discount.factor.tolist()) for m, o in enumerate(orders, 2)]
    spark.createDataFrame(rows, "order int, tokens long, rest double, scale double, factor array<double>").write.mode("overwrite").parquet(f"{folder}/discounts")
    shape = "name long, e array<long>, f double"
    for m, order in enumerate(orders, 2):
        own = _named(spark, folder, f"histories/order={m}", shape, "histories", m)
        every = own.union(spark.read.schema(shape).parquet(order.hot))
        every.mapInArrow(partial(_backoff, discount=order.discount), "history long, alpha double, scale double, total long").write.mode("overwrite").parquet(f"{folder}/backoff/order={m}")


def _named(spark: SparkSession, folder: str, name: str, schema: str, column: str, order: int) -> DataFrame:
    """The rows of a model's files that its list names: a task that ran twice leaves a file that the list doesn't have."""
    listed = spark.read.parquet(f"{folder}/files").where(F.col("order") == order).select(F.substring_index(column, "/", -1).alias("_file"))
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/{name}")
    return rows.withColumn("_file", F.substring_index(F.col("_metadata.file_path"), "/", -1)).join(listed, "_file", "left_semi").drop("_file")


def load(spark: SparkSession, folder: str) -> dict:
    """A kept model: ``discounts`` by order, and the tables ``ngrams`` and ``backoff`` by order."""
    discounts = {r["order"]: r for r in spark.read.parquet(f"{folder}/discounts").collect()}  # a row for each order
    shape = lambda m: "word long, count long" if m == 1 else "history long, word long, count long"
    return {
        "discounts": discounts,
        "ngrams": {m: _named(spark, folder, f"ngrams/order={m}", shape(m), "uri", m) for m in discounts},
        "backoff": {m: spark.read.parquet(f"{folder}/backoff/order={m}") for m in discounts if m > 1},
    }


@lean
def _names(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Of n-grams (gram, words): the hash of the last word, and the name of the history of each length that it has; null words are the start in front and the end behind."""
    for batch in batches:
        for gram, words in zip(batch.column("gram").to_pylist(), batch.column("words").to_pylist(), strict=True):
            known = of_column(pa.array([" ".join(w for w in words if w is not None)]), lower=True).hash
            hashes = iter(known)
            last = len(words) - 1
            seq = [next(hashes) if w is not None else (END if i == last else START) for i, w in enumerate(words)]
            out: list[int | None] = []
            for m in range(2, order + 1):
                past = seq[max(0, last - m + 1) : last]
                if len(past) < m - 1 and not (past and past[0] == START):
                    out.append(None)
                    continue
                name = np.array([past[0]], np.uint64)
                for x in past[1:]:
                    name = gram_name(name, np.array([x], np.uint64))
                out.append(int(name.view(np.int64)[0]))
            word = np.array([seq[-1]], np.uint64)
            yield pa.RecordBatch.from_pylist([{"gram": gram, "word": int(word.view(np.int64)[0]), "low": int((word & W48).view(np.int64)[0]), "past": out}], schema=pa.schema([("gram", pa.int64()), ("word", pa.int64()), ("low", pa.int64()), ("past", pa.list_(pa.int64()))]))


def probabilities(model: dict, grams: DataFrame) -> DataFrame:
    """(gram, p): the probability of the last of ``words`` after those before it, order by order from the stored tables.

    ``grams``: (gram long, words array<string>); a null in front is the text's
    start, a null behind its end.  A history shorter than the model's goes as far
    up as it has words.  All words never seen share one probability.
    """
    ready(grams.sparkSession)
    order = max(model["discounts"])
    keys = grams.mapInArrow(partial(_names, order=order), "gram long, word long, low long, past array<long>")

    def given(m: int, c: Column) -> Column:
        factor = F.array(*(F.lit(x) for x in model["discounts"][m]["factor"]))
        return F.when(c > K, c.cast("double")).otherwise(c * F.get(factor, c.cast("int")))

    one = model["discounts"][1]
    rows = keys.join(model["ngrams"][1].withColumnRenamed("count", "n"), "word", "left")
    rows = rows.withColumn("p", F.when(F.col("n") > 0, given(1, F.col("n")) / max(one["tokens"], 1) * one["scale"]).otherwise(one["rest"])).drop("n")
    for m in range(2, order + 1):
        rows = rows.withColumn("history", F.get("past", F.lit(m - 2)))
        seen = model["ngrams"][m].select("history", F.col("word").alias("low"), F.col("count").alias("n"))
        rows = rows.join(seen, ["history", "low"], "left").join(model["backoff"][m], "history", "left")
        higher = F.when(F.col("n") > 0, given(m, F.col("n")) * F.col("scale") / F.col("total")).otherwise(F.coalesce("alpha", F.lit(1.0)) * F.col("p"))
        rows = rows.withColumn("p", F.when(F.col("history").isNotNull(), higher).otherwise(F.col("p"))).select("gram", "word", "low", "past", "p")
    return rows.select("gram", "p")
