"""Byte-level BPE encoding and decoding over a pair occurrence index.

A batch's texts are split by the tokenizer's pattern; pieces not met before in the partition are laid out as one
chain of byte symbols. An index maps each mergeable pair to all its positions in that chain. Ranks that occur are
taken in ascending order from a heap; each is applied at all its positions, left to right, and the lists of the pairs
that this makes are extended. In a vocabulary whose merges come after the merges that make their parts (checked on
loading) this is the same as merging each piece on its own. Pieces are kept with their ids, up to a bound.

Defined cases: null is encoded as empty; the special tokens' strings in a text become their ids, as the library does
by default; decoding replaces broken UTF-8. Memory in a task: the piece table (``KEEP_PIECES`` entries at most), the
pieces of a chunk (``CHUNK_BYTES`` of short texts, or ``CHUNK_PIECES`` of one long text) and a chunk's ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonloom.llm.textops import lean, sliced

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces held with their ids; the table starts anew beyond, so memory is bounded.
KEEP_PIECES = 200_000
#: Ids of a pair are packed into one number; places of a rank up to which they are merged one by one.
WIDTH, FEW = 1 << 20, 12
#: Text bytes that are split and merged together; longer texts are taken so many pieces at a time.
CHUNK_BYTES, CHUNK_PIECES = 2 << 20, 1 << 18


def _byte_chars() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE vocabulary (tokenizers' JSON) as lookup tables."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normaliser or prefix space is supported")
        chars, vocab = _byte_chars(), spec["model"]["vocab"]
        self.bytes_of = {i: bytes(map(chars.__getitem__, token)) for token, i in vocab.items()}
        self.byte_symbol = np.full(256, -1)
        for token, i in vocab.items():
            if len(token) == 1:
                self.byte_symbol[chars[token]] = i
        self.byte_symbol[0xFF] = -1
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        self.parts: list[tuple[int, int]] = []
        made: dict[int, int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, xy = vocab[a], vocab[b], vocab[a + b]
            if any(made.get(p, -1 if len(self.bytes_of[p]) == 1 else r) >= r for p in (x, y)):
                raise ValueError("a merge comes before the merges of its parts")
            made.setdefault(xy, r)
            self.rank[x * WIDTH + y] = r
            self.parts.append((x, y))
            self.merged.append(xy)
        self.keys = np.array(sorted(self.rank))
        self.key_rank = np.array([self.rank[k] for k in self.keys.tolist()])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that strip or match whole words aren't supported")
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        #: The ids as decimals.
        self.names = [str(i) for i in range(max(self.bytes_of) + 1)]
        pattern = regex.compile(PATTERN)
        self.split, self.walk = pattern.findall, pattern.finditer
        self.parted = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pieces(self, text: str) -> list[str]:
        if self.parted is None or not any(t in text for t in self.special):
            return self.split(text)
        out: list[str] = []
        for i, part in enumerate(self.parted.split(text)):
            out.extend([part] if i % 2 else self.split(part))
        return out

    def stretches(self, text: str) -> Iterator[list[str]]:
        """The pieces of a long text, so many at a time; its list of pieces is never whole."""
        held: list[str] = []
        marked = self.parted is not None and any(t in text for t in self.special)
        for i, part in enumerate(self.parted.splititer(text) if marked else [text]):
            for piece in [part] if marked and i % 2 else (m[0] for m in self.walk(part)):
                held.append(piece)
                if len(held) == CHUNK_PIECES:
                    yield held
                    held = []
        if held:
            yield held

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other and where each piece's end, by one pass over the pair occurrence index
        of all of them."""
        # 0xFF never occurs in UTF-8: it parts the pieces, as a symbol that pairs with nothing
        raw = np.frombuffer(b"\xff".join([p.encode("utf-8") for p in pieces]) + b"\xff", np.uint8)
        symbol = self.byte_symbol[raw]
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        sym, nxt, prv = memoryview(symbol), memoryview(after), memoryview(before)  # plain ints for single places
        where: dict[int, list[int]] = {}
        self._index(where, [], np.arange(n - 1), symbol[:-1] * WIDTH + symbol[1:])
        active = list(where)
        heapq.heapify(active)
        rank = self.rank
        while active:
            r = heapq.heappop(active)
            (a, b), new = self.parts[r], self.merged[r]
            at = where.pop(r)
            if len(at) > FEW and a != b:
                pos = np.array(at)
                pos = pos[symbol[pos] == a]
                j = after[pos]
                ok = symbol[j] == b
                pos, j = pos[ok], j[ok]
                k = after[j]
                symbol[pos], symbol[j] = new, -1
                after[pos], before[k] = k, pos
                left = before[pos]
                key = np.concatenate([np.where(left >= 0, symbol[left], -1) * WIDTH + new, new * WIDTH + symbol[k]])
                self._index(where, active, np.concatenate([left, pos]), key)
                continue
            for i in sorted(at):  # few places, or runs of one symbol: left to right
                if sym[i] != a or sym[j := nxt[i]] != b:
                    continue  # an earlier merge took one of them
                sym[i], sym[j] = new, -1
                nxt[i] = k = nxt[j]
                prv[k] = i
                left = prv[i]
                for p, key in ((left, sym[left] * WIDTH + new if left >= 0 else -1), (i, new * WIDTH + sym[k])):
                    if (q := rank.get(key)) is not None:
                        if q not in where:
                            where[q] = []
                            heapq.heappush(active, q)
                        where[q].append(p)
        alive = np.flatnonzero((symbol >= 0) | (raw == 0xFF))
        ids = symbol[alive]
        ends = np.flatnonzero(ids < 0)
        return ids[ids >= 0].astype(np.int32), ends - np.arange(len(ends))

    def _index(self, where: dict[int, list[int]], active: list[int], places: np.ndarray, keys: np.ndarray) -> None:
        """Adds the places of mergeable pairs to their ranks' lists; new ranks become active."""
        at = np.searchsorted(self.keys, keys)
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        ranks, places = self.key_rank[at[hit]], places[hit]
        by = np.argsort(ranks, kind="stable")
        ranks, places = ranks[by], places[by].tolist()
        cuts = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])) if len(ranks) else ranks
        for q, lo, hi in zip(ranks[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(ranks)]):
            if q not in where:
                where[q] = []
                heapq.heappush(active, q)
            where[q].extend(places[lo:hi])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


class Encoder:
    """Encodes texts chunk by chunk and keeps what it has learnt of pieces: their ids lie in one array."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self._forget()

    def _forget(self) -> None:
        self.place = {p: n for n, p in enumerate(self.bpe.special)}
        self.ids = [np.array(list(self.bpe.special.values()), np.int32)]
        self.ends = [np.arange(len(self.bpe.special) + 1)]

    def _learn(self, met: set[str]) -> None:
        fresh = [p for p in met if p not in self.place]
        if not fresh:
            return
        ids, ends = self.bpe.encode_pieces(fresh)
        self.place |= zip(fresh, range(len(self.place), len(self.place) + len(fresh)))
        held = np.concatenate([*self.ids, ids])
        self.ends = [np.concatenate([*self.ends, self.ends[-1][-1] + ends])]
        self.ids = [held]

    def _encode(self, split: list[list[str]]) -> Iterator[np.ndarray]:
        """The ids of each text of a chunk from its pieces."""
        if len(self.place) > KEEP_PIECES or len(self.ids[-1]) > 8 * KEEP_PIECES:
            self._forget()
        self._learn(set().union(*split))
        (ids,), (ends,) = self.ids, self.ends
        for pieces in split:
            at = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))
            size = ends[at + 1] - ends[at]
            upto = np.cumsum(size)
            yield ids[np.arange(upto[-1] if len(upto) else 0) + np.repeat(ends[at] - upto + size, size)]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(texts) == 1 and len(texts[0]) > CHUNK_BYTES:
            yield np.concatenate([next(self._encode([pieces])) for pieces in self.bpe.stretches(texts[0])])
        else:
            yield from self._encode([self.bpe.pieces(t) for t in texts])


def _joined(names: list[str], ids: np.ndarray) -> Iterator[bytes]:
    """The ids as decimals, comma-joined, in parts."""
    for at in range(0, len(ids), CHUNK_PIECES):
        yield (b"," if at else b"") + ",".join(map(names.__getitem__, ids[at : at + CHUNK_PIECES].tolist())).encode()


def _digests(bpe: ByteBpe, ids: np.ndarray) -> tuple[str, str]:
    of_ids = hashlib.sha256()
    for part in _joined(bpe.names, ids):
        of_ids.update(part)
    return of_ids.hexdigest(), hashlib.sha256(bpe.decode(ids.tolist()).encode()).hexdigest()


def _coder(path: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        encoder = Encoder(bpe)
        for batch in batches:
            kept = batch.num_columns - 1
            for a, b, texts in sliced(batch.column(kept), CHUNK_BYTES):
                counts, digests, all_ids = [], [], []
                for ids in encoder.encode([(t or b"").decode("utf-8", "replace") for t in texts]):
                    counts.append(len(ids))
                    digests.append(_digests(bpe, ids))
                    if keep_ids:
                        all_ids.append(ids)
                columns = [batch.column(c).slice(a, b - a) for c in range(kept)]
                columns += [pa.array(counts, pa.int64()), *(pa.array(x, pa.string()) for x in zip(*digests))]
                names = [*batch.schema.names[:kept], "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(all_ids))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
            pa.default_memory_pool().release_unused()

    return lean(run)


def encoded(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined), decoded_sha256 (of the ids decoded again) and,
    if asked for, the ids. ``path``: a byte-level BPE JSON that every worker can open."""
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_coder(path, keep_ids), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with ``ids`` (null: empty text)."""
    rows = tokens.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decoder(path), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
