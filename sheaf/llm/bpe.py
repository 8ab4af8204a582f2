"""Byte-level BPE by forced-boundary splitting.

A pair of bytes that occurs inside no token of the vocabulary marks a certain
cut: no token can span it, whatever the merges are.  A text is cut wherever such
a pair also goes from a visible character to white space, where the
pre-tokeniser's pattern always ends a piece and looks no further; the fragments
are then encoded independently, each distinct one once, and the ids put back
together.  Cuts, fragment hashes and the concatenation are numpy passes over the
raw bytes; the tokenizers library sees only fragments that are new to a worker.
Fragments are found by their hash and told apart by their bytes.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.tables import integral, ready
from sheaf.llm.words import Lanes, lean, pieces, raw

#: Fragments that a worker remembers before it starts afresh.
POOL = 1_000_000
#: Bytes of fragments for one call of the library.
CALL_BYTES = 1 << 12
_WHITE = np.zeros(256, bool)
_WHITE[[0x09, 0x0A, 0x0D, 0x20]] = True
#: Bytes after which nothing is cut: any that some pattern may take for white space.
_VISIBLE = np.ones(256, bool)
_VISIBLE[:0x21] = False
_VISIBLE[0x7F] = False


def byte_symbols() -> dict[str, int]:
    """The symbol of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Growing:
    """An array that rows are added to; ``rows`` is what it holds."""

    def __init__(self, kind: type):
        self.store, self.rows = np.empty(0, kind), np.empty(0, kind)

    def add(self, more: np.ndarray) -> None:
        n = len(self.rows) + len(more)
        if n > len(self.store):
            store = np.empty(max(n, 2 * len(self.store)), self.store.dtype)
            store[: len(self.rows)] = self.rows
            self.store = store
        self.store[n - len(more) : n] = more
        self.rows = self.store[:n]


class Encoder:
    """``tokenizers`` file -> vectorised encoding of many texts.  ``special``: strings of added tokens are those tokens."""

    def __init__(self, path: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            layout = json.load(f)
        pre = layout["pre_tokenizer"] or {}
        if layout["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or layout["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE")
        symbols = byte_symbols()
        self.added = {t["content"].encode(): t["id"] for t in layout["added_tokens"]} if special else {}
        vocabulary = layout["model"]["vocab"]
        size = 1 + max([*vocabulary.values(), *(t["id"] for t in layout["added_tokens"])])
        self.token: list[bytes] = [b""] * size
        for word, i in vocabulary.items():
            self.token[i] = bytes(symbols[c] for c in word)
        for t in layout["added_tokens"]:
            self.token[t["id"]] = t["content"].encode()
        self.decimal = [str(i) for i in range(size)]
        self.length = np.array([len(t) for t in self.token])
        together = np.zeros((256, 256), bool)
        for word in vocabulary:
            b = [symbols[c] for c in word]
            together[b[:-1], b[1:]] = True
        #: Whether a cut between two bytes is certain and at a place where the pattern ends a piece.
        self.cuts = (~together & _VISIBLE[:, None] & _WHITE[None, :]).ravel()
        #: Last bytes after which a cut is certain whatever white space follows.
        self.closed = self.cuts.reshape(256, 256)[:, _WHITE].all(axis=1)
        self._forget()

    def _forget(self) -> None:
        #: Of each known fragment, by number: its hash, its bytes as lanes, whether it is an added token, and its ids.
        self.key, self.lane, self.lane_at, self.bytes = Growing(np.uint64), Growing(np.uint64), Growing(np.int64), Growing(np.int64)
        self.marked, self.pool, self.at, self.size = Growing(bool), Growing(np.uint32), Growing(np.int64), Growing(np.int64)
        #: Numbers at the places their hashes lead to; a taken place sends on to the next.
        self.table = np.full(1 << 16, -1, np.int32)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - len(self.table).bit_length() + 1)).astype(np.int64)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for unknown ones."""
        known, place = self.key.rows, self._place(key)
        out = self.table[place]
        on = np.flatnonzero(out >= 0)
        on = on[known[out[on]] != key[on]]
        while len(on):
            place[on] = (place[on] + 1) & (len(self.table) - 1)
            out[on] = self.table[place[on]]
            on = on[out[on] >= 0]
            on = on[known[out[on]] != key[on]]
        return out

    def _enter(self, first: int) -> None:
        """Enters the fragments from number ``first`` on; the table stays at most a quarter full."""
        key = self.key.rows
        if 4 * len(key) > len(self.table):
            self.table = np.full(1 << (4 * len(key)).bit_length(), -1, np.int32)
            first = 0
        todo = np.arange(first, len(key))
        place = self._place(key[todo])
        while len(todo):
            free = self.table[place] < 0
            self.table[place[free]] = todo[free]
            on = self.table[place] != todo
            todo, place = todo[on], (place[on] + 1) & (len(self.table) - 1)

    def _split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First bytes of all fragments, and those of added tokens among them."""
        n = len(data)
        cut = np.zeros(n, bool)
        if n > 1:
            np.take(self.cuts, data[:-1].astype(np.int64) * 256 + data[1:], out=cut[1:])
            # After a character that may be Unicode white space there is no cut.
            wide = np.flatnonzero(cut & np.concatenate(([False], data[:-1] >= 0x80)))
            b1, b2, b3 = data[wide - 1], data[wide - 2], data[wide - 3]
            cut[wide[((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | ((b3 >= 0xE1) & (b3 <= 0xE3))]] = False
        starts = offsets[:-1]
        cut[starts[starts < n]] = True
        added: list[int] = []
        if self.added:
            text = data.tobytes()
            for word in self.added:
                p = text.find(word)
                while p >= 0:
                    if not np.searchsorted(offsets, p, "right") < np.searchsorted(offsets, p + len(word), "left"):
                        added.append(p)
                        cut[p + 1 : p + len(word)] = False
                        cut[p] = True
                        if p + len(word) < n:
                            cut[p + len(word)] = True
                    p = text.find(word, p + len(word))
        return np.flatnonzero(cut), np.array(sorted(added), np.int64)

    def _learn(self, data: np.ndarray, a: np.ndarray, n: np.ndarray, fixed: np.ndarray) -> None:
        """Encodes new fragments: those that end visibly many in one text, the few others one by one; ``fixed``: the id of an added token, else -1.

        A fragment that begins visibly is put behind a line break, which is a
        token of its own there and is then left out.
        """
        last, one, two = data[a + n - 1], data[np.maximum(a + n - 2, 0)], data[np.maximum(a + n - 3, 0)]
        wide = (last >= 0x80) & ((one == 0xC2) | ((two >= 0xE1) & (two <= 0xE3)))
        head = data[a]
        plain = _WHITE[head] | (_VISIBLE[head] & (head != 0xC2) & ((head < 0xE1) | (head > 0xE3)))
        many = np.flatnonzero(self.closed[last] & ~wide & plain & (fixed < 0))
        lead = (~_WHITE[data[a[many]]]).astype(np.int64)
        size = n[many] + lead
        ends = np.cumsum(size)
        at = np.empty(len(a), np.int64)
        count = np.empty(len(a), np.int64)
        parts = []
        base = len(self.pool.rows)
        if len(many):
            text = np.full(int(ends[-1]), 0x0A, np.uint8)
            fill = np.repeat(ends - n[many], n[many]) + (within := np.arange(int(n[many].sum())) - np.repeat(np.cumsum(n[many]) - n[many], n[many]))
            text[fill] = data[np.repeat(a[many], n[many]) + within]
            stops = ends[np.append(np.searchsorted(ends, np.arange(CALL_BYTES, int(ends[-1]), CALL_BYTES)), len(ends) - 1)]
            calls = [text[x:y].tobytes().decode() for x, y in zip(np.append(0, stops[:-1]).tolist(), stops.tolist(), strict=True) if y > x]
            got = np.concatenate([np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(calls, add_special_tokens=False)])
            upto = np.searchsorted(np.cumsum(self.length[got]), ends) + 1
            begin = np.append(0, upto[:-1]) + lead
            at[many], count[many] = base + begin, upto - begin
            parts.append(got)
            base += len(got)
        few = np.ones(len(a), bool)
        few[many] = False
        few = np.flatnonzero(few)
        for i in few.tolist():
            ids = [int(fixed[i])] if fixed[i] >= 0 else self.library.encode(data[a[i] : a[i] + n[i]].tobytes().decode(), add_special_tokens=False).ids
            parts.append(np.array(ids, np.uint32))
            at[i], count[i] = base, len(ids)
            base += len(ids)
        self.pool.add(np.concatenate(parts))
        self.at.add(at)
        self.size.add(count)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and n + 1 offsets into them."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        start, added = self._split(data, offsets)
        length = np.diff(np.append(start, len(data)))
        fixed = np.full(len(start), -1)
        for x in added.tolist():
            fixed[np.searchsorted(start, x)] = next(i for t, i in self.added.items() if data[x : x + len(t)].tobytes() == t)
        if len(self.key.rows) > POOL:
            self._forget()
        number = np.empty(len(start), np.int64)
        todo, seed = np.arange(len(start)), 0
        while len(todo):
            # Equal hashes count for nothing unless the bytes are equal; what differs is hashed anew.
            a, n, mark = start[todo], length[todo], fixed[todo] >= 0
            lanes = Lanes(data, a, n)
            key = self._keys(lanes, mark, seed)
            of = self._find(key).astype(np.int64)
            new = np.flatnonzero(of < 0)
            if len(new):
                found, first, which = np.unique(key[new], return_index=True, return_inverse=True)
                own, base = new[first], len(self.key.rows)
                of[new] = base + which
                self.key.add(found)
                taken = lanes.taken(own)
                self.lane_at.add(len(self.lane.rows) + taken.first)
                self.lane.add(taken.value)
                self.bytes.add(n[own])
                self.marked.add(mark[own])
                self._learn(data, a[own], n[own], fixed[todo[own]])
                self._enter(base)
            good = lanes.same(Lanes.of(self.lane.rows, self.lane_at.rows, self.bytes.rows), of) & (mark == self.marked.rows[of])
            number[todo[good]] = of[good]
            todo, seed = todo[~good], seed + 1
        return self._joined(number, np.searchsorted(start, offsets))

    @staticmethod
    def _keys(lanes: Lanes, mark: np.ndarray, seed: int) -> np.ndarray:
        return lanes.hash(seed) ^ mark.astype(np.uint64)

    def _joined(self, number: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known fragments one after the other, and the places of some fragments in them."""
        size = self.size.rows[number]
        ends = np.cumsum(size)
        ids = self.pool.rows[np.repeat(self.at.rows[number] - ends + size, size) + np.arange(int(ends[-1]))]
        return ids, np.append(0, ends)[cuts]

    def encode_texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.encode(*raw(column))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def encoder(path: str, special: bool = True) -> Encoder:
    """One encoder for each file and worker process."""
    return Encoder(path, special)


@lean
def _round_trip(batches: Iterator[pa.RecordBatch], path: str, texts: bool) -> Iterator[pa.RecordBatch]:
    code = encoder(path)
    for batch in batches:
        for piece in pieces(batch):
            ids, cuts = code.encode_texts(piece.column("text"))
            id_sums, text_sums, n, decoded = [], [], np.diff(cuts), []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = ids[a:b].tolist()
                id_sums.append(hashlib.sha256(",".join(map(code.decimal.__getitem__, own)).encode()).hexdigest())
                back = code.decode(own)
                text_sums.append(hashlib.sha256(back.encode()).hexdigest())
                if texts:
                    decoded.append(back)
            columns = {"id": piece.column("id"), "n_tokens": pa.array(n), "ids_sha256": pa.array(id_sums, pa.string()), "decoded_sha256": pa.array(text_sums, pa.string())}
            if texts:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))
                columns["decoded"] = pa.array(decoded, pa.string())
            yield pa.RecordBatch.from_pydict(columns)


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row for each row: id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256; with ``texts`` also ``ids`` and ``decoded``.

    A null or empty text has no tokens and decodes to the empty text; a null id
    stays null; repeated rows stay.  Only the two named columns are read.
    """
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts
    ready(docs.sparkSession)
    source = docs.select(integral(docs, id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(partial(_round_trip, path=path, texts=texts), schema).withColumnRenamed("id", id_col)
