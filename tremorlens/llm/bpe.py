"""Byte-level BPE: cached, vectorised pair merging of pre-tokens, and decoding from retained offsets."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tremorlens.llm.common import slices, texts_of
from tremorlens.llm.pretokens import json_file_classes, rank_file_classes, split_bytes

NONE = np.int64(1) << 40
#: Pre-tokens of at most so many bytes are merged together as rows of one matrix; longer ones by a heap each.
MATRIX_BYTES = 40
#: Ids that the pre-token cache of one worker holds; it is emptied when full.
CACHE_IDS = 1_500_000


def runs(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indexes begin, begin + 1, ... of every run, in a row."""
    ends = np.cumsum(count)
    return np.repeat(begin - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def row_keys(rows: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row of bytes: the bytes themselves up to eight, else a mix that callers verify."""
    n = rows.shape[1]
    words = -(-n // 8)
    padded = np.zeros((len(rows), words * 8), dtype=np.uint8)
    padded[:, :n] = rows
    packed = padded.view("<u8")
    key = packed[:, 0].copy()
    for k in range(1, words):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + packed[:, k]
    return key


def distinct_rows(raw: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct byte strings of length ``n`` that begin at ``starts``, and which of them each is."""
    rows = raw[starts[:, None] + np.arange(n)]
    key = row_keys(rows)
    _, where, inverse = np.unique(key, return_index=True, return_inverse=True)
    distinct = rows[where]
    if n > 8 and not (distinct[inverse] == rows).all():  # two strings with one key
        distinct, inverse = np.unique(rows, axis=0, return_inverse=True)
    return distinct, inverse.ravel()


class PairTable:
    """Open-addressed hash table from a pair of ids to the rank of its merge and the merged id."""

    def __init__(self, left, right, rank, merged):
        size = 1 << max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.mask = np.uint64(size - 1)
        self.shift = np.uint64(64 - int(np.log2(size)))
        self.key = np.full(size, np.uint64(2**64 - 1))
        self.rank = np.full(size, NONE)
        self.merged = np.zeros(size, dtype=np.int64)
        key = (np.asarray(left, dtype=np.uint64) << np.uint64(32)) | np.asarray(right, dtype=np.uint64)
        slot, todo = self._home(key), np.arange(len(key))
        rank, merged = np.asarray(rank, dtype=np.int64), np.asarray(merged, dtype=np.int64)
        while len(todo):  # of those that want one free slot the first takes it, the others move on
            free = self.key[slot[todo]] == np.uint64(2**64 - 1)
            _, first = np.unique(slot[todo], return_index=True)
            wins = np.zeros(len(todo), dtype=bool)
            wins[first] = True
            wins &= free
            put = todo[wins]
            self.key[slot[put]], self.rank[slot[put]], self.merged[slot[put]] = key[put], rank[put], merged[put]
            todo = todo[~wins]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    def _home(self, key):
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, left, right):
        """Slot of each pair's merge, -1 where it has none."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._home(key)
        there = self.key[slot]
        out = np.where(there == key, slot.astype(np.int64), -1)
        todo = np.flatnonzero((there != key) & (there != np.uint64(2**64 - 1)))
        flat_slot, flat_key, flat_out = slot.ravel(), key.ravel(), out.ravel()
        while len(todo):
            flat_slot[todo] = (flat_slot[todo] + np.uint64(1)) & self.mask
            there = self.key[flat_slot[todo]]
            hit = there == flat_key[todo]
            flat_out[todo[hit]] = flat_slot[todo[hit]].astype(np.int64)
            todo = todo[~hit & (there != np.uint64(2**64 - 1))]
        return flat_out.reshape(out.shape)

    def ranks(self, left, right):
        slot = self.find(left, right)
        return np.where(slot >= 0, self.rank[slot], NONE)


class Encoder:
    """Ids of texts by one vocabulary, and back."""

    def __init__(self, classes, token_bytes: dict[int, bytes], pairs, whole: dict[bytes, int], special: dict[str, int]):
        self.classes, self.special = classes, special
        left, right, rank, merged = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        self.table = PairTable(left, right, rank, merged)
        by_bytes = {b: i for i, b in token_bytes.items()}
        self.byte_ids = np.array([by_bytes[bytes([b])] for b in range(256)], dtype=np.int64)
        top = max(token_bytes) + 1
        lengths = np.zeros(top, dtype=np.int64)
        for i, b in token_bytes.items():
            lengths[i] = len(b)
        self.lengths, self.offsets = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(token_bytes[i] for i in sorted(token_bytes)), dtype=np.uint8)
        self.cache: dict[int, tuple] = {}
        self.pool = np.zeros(0, dtype="<u4")
        self.odd: dict[int, list] = {}
        for n in {len(t) for t in whole}:  # tokens that merging alone would not give
            tokens = [t for t in whole if len(t) == n]
            rows = np.frombuffer(b"".join(tokens), dtype=np.uint8).reshape(-1, n)
            count = np.concatenate([[0], self.merge(rows)[1]])[1:]
            self.odd[n] = [(rows[k], whole[tokens[k]]) for k in np.flatnonzero(count != 1).tolist()]
        self.cache, self.pool = {}, self.pool[:0]

    def _heap(self, piece: bytes) -> np.ndarray:
        """Merges of one long pre-token: lowest rank first, leftmost among equals."""
        ids = [int(self.byte_ids[b]) for b in piece]
        n = len(ids)
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        slots = self.table.find(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(self.table.rank[s]), i, int(s), ids[i], ids[i + 1]) for i, s in enumerate(slots.tolist()) if s >= 0]
        heapq.heapify(heap)
        while heap:
            _, i, slot, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = int(self.table.merged[slot]), False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else n
                if y < n:
                    slot = int(self.table.find(np.array([ids[x]]), np.array([ids[y]]))[0])
                    if slot >= 0:
                        heapq.heappush(heap, (int(self.table.rank[slot]), x, slot, ids[x], ids[y]))
        return np.array([x for x, ok in zip(ids, alive, strict=True) if ok], dtype="<u4")

    def _matrix(self, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merge rows of equal length together: a round merges one pair in every row that is not finished."""
        rows = np.arange(len(tokens))
        ranks = self.table.ranks(tokens[:, :-1], tokens[:, 1:])
        while len(rows):
            n = tokens.shape[1]
            if n == 1:
                yield rows, tokens
                return
            place = ranks.argmin(axis=1)
            going = ranks[np.arange(len(rows)), place] < NONE
            if not going.all():
                yield rows[~going], tokens[~going]
                rows, tokens, ranks, place = rows[going], tokens[going], ranks[going], place[going]
                if not len(rows):
                    return
            each = np.arange(len(rows))
            slot = self.table.find(tokens[each, place], tokens[each, place + 1])
            tokens[each, place] = self.table.merged[slot]
            tokens = tokens[np.arange(n) != (place + 1)[:, None]].reshape(len(rows), n - 1)
            ranks = ranks[np.arange(n - 1) != place[:, None]].reshape(len(rows), n - 2)
            left = place > 0
            ranks[each[left], place[left] - 1] = self.table.ranks(tokens[each[left], place[left] - 1], tokens[each[left], place[left]])
            right = place < n - 2
            ranks[each[right], place[right]] = self.table.ranks(tokens[each[right], place[right]], tokens[each[right], place[right] + 1])

    def distinct(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Number of the distinct pre-token of each pre-token, the distinct ones, and the first pre-token of each text.

        Distinct pre-tokens come as one byte matrix for each length, numbered in that order.
        """
        raw, starts, stops, first = split_bytes(texts, self.classes)
        sizes = stops - starts
        codes, groups, base = np.empty(len(starts), dtype=np.int64), [], 0
        order = np.argsort(sizes.astype(np.int32), kind="stable")
        bounds = np.append(0, np.cumsum(np.bincount(sizes))) if len(sizes) else np.zeros(1, dtype=np.int64)
        for n in np.flatnonzero(np.diff(bounds)).tolist():
            at = order[bounds[n] : bounds[n + 1]]
            rows, inverse = distinct_rows(raw, starts[at], n)
            codes[at] = base + inverse
            groups.append(rows)
            base += len(rows)
        return codes, groups, first

    def fresh(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge pre-tokens of one length, cache aside: where the ids of each begin, how many they are, and all ids."""
        n, end = rows.shape[1], 0
        place, count, added = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64), []
        if n > MATRIX_BYTES:
            parts = ((np.array([k]), self._heap(row.tobytes())[None, :]) for k, row in enumerate(rows))
        else:
            parts = self._matrix(self.byte_ids[rows])
        for which, ids in parts:
            place[which] = end + np.arange(len(which)) * ids.shape[1]
            count[which] = ids.shape[1]
            added.append(ids.astype("<u4").ravel())
            end += ids.size
        for token, i in self.odd.get(n, ()):
            same = np.flatnonzero((rows == token).all(axis=1))
            place[same], count[same] = end, 1
            added.append(np.array([i], dtype="<u4"))
            end += 1
        return place, count, np.concatenate(added)

    def merge(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens of one length: place in the pool and number of ids, from the cache where it has them."""
        n = rows.shape[1]
        if len(self.pool) > CACHE_IDS:
            self.cache, self.pool = {}, self.pool[:0]
        key = row_keys(rows)
        keys, kept, place, count = self.cache.get(n) or (key[:0], rows[:0], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        slot = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        known = np.zeros(len(rows), dtype=bool)
        if len(keys):
            known = (keys[slot] == key) & (kept[slot] == rows).all(axis=1)
        out_place, out_count = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        out_place[known], out_count[known] = place[slot[known]], count[slot[known]]
        new = np.flatnonzero(~known)
        if len(new):
            begin, sizes, ids = self.fresh(rows[new])
            out_place[new], out_count[new] = begin + len(self.pool), sizes
            self.pool = np.concatenate([self.pool, ids])
            both = np.concatenate([keys, key[new]])
            order = np.argsort(both, kind="stable")
            self.cache[n] = (
                both[order], np.concatenate([kept, rows[new]])[order],
                np.concatenate([place, out_place[new]])[order], np.concatenate([count, out_count[new]])[order],
            )
        return out_place, out_count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin (one more than texts)."""
        if any(s in t for s in self.special for t in texts):
            return self._with_specials(texts)
        return self._plain(texts)

    def _plain(self, texts):
        codes, groups, first = self.distinct(texts)
        flat, counts = [], []
        for rows in groups:  # the pool may be emptied between lengths, so ids are taken at once
            place, count = self.merge(rows)
            flat.append(self.pool[runs(place, count)])
            counts.append(count)
        counts = np.concatenate(counts or [np.zeros(0, dtype=np.int64)])
        flat = np.concatenate(flat or [self.pool[:0]])
        begin, each = np.cumsum(counts) - counts, counts[codes]
        return flat[runs(begin[codes], each)], np.append(0, np.cumsum(each))[first]

    def _with_specials(self, texts):
        """Strings of special tokens are cut out first, and become their ids."""
        segments, owner = [], []
        for k, t in enumerate(texts):
            parts = cut_specials(t, self.special)
            segments += parts
            owner += [k] * len(parts)
        plain = [s if isinstance(s, str) else "" for s in segments]
        ids, at = self._plain(plain)
        out, sizes = [], np.zeros(len(texts), dtype=np.int64)
        for k, s in enumerate(segments):
            part = ids[at[k] : at[k + 1]] if isinstance(s, str) else np.array([s], dtype="<u4")
            out.append(part)
            sizes[owner[k]] += len(part)
        return np.concatenate(out), np.append(0, np.cumsum(sizes))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids in a row, and where each id's bytes begin (one more than ids)."""
        sizes = self.lengths[ids]
        to = np.append(0, np.cumsum(sizes))
        return self.bytes[np.repeat(self.offsets[ids] - to[:-1], sizes) + np.arange(to[-1])], to


def cut_specials(text: str, special: dict[str, int]) -> list[str | int]:
    """Text between special strings, and the ids of those."""
    parts: list[str | int] = [text]
    for s, i in special.items():
        cut: list[str | int] = []
        for part in parts:
            if isinstance(part, int):
                cut.append(part)
                continue
            for k, x in enumerate(part.split(s)):
                cut += [i, x] if k else [x]
        parts = cut
    return parts


@lru_cache(maxsize=2)
def rank_encoder(path: str) -> Encoder:
    """Encoder of a rank file: a pair merges if its joined bytes have a rank, and a whole pre-token with a rank is one id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pairs = [(ranks[t[:k]], ranks[t[k:]], r, r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    return Encoder(rank_file_classes(), {i: b for b, i in ranks.items()}, pairs, ranks, {})


def _printable_bytes() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabularies: themselves if visible, else the next code point from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def json_encoder(path: str) -> Encoder:
    """Encoder of a byte-level ``.json`` vocabulary: pairs merge as listed; added tokens are found in texts first."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    vocab, back = model["model"]["vocab"], _printable_bytes()
    special = {x["content"]: x["id"] for x in model["added_tokens"]}
    token_bytes = {i: s.encode() if s in special else bytes(back[c] for c in s) for s, i in vocab.items()}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
    pairs = [(vocab[a], vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(merges)]
    return Encoder(json_file_classes(), token_bytes, pairs, {}, special)


def encode_and_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every whole text by the rank file at ``path`` and the bytes they decode to.

    Returns id, n_bytes, n_tokens, ids (binary, little-endian unsigned 32-bit), offsets (binary, likewise: the first byte of each id in
    the text) and decoded (binary).  A null text is empty; an empty text has no ids; a text of any length is encoded whole; repeated
    rows and null ids are kept as they come; other columns are not read.  No shuffle: each task encodes its own rows.
    """

    def work(batches):
        encoder = rank_encoder(path)
        for part in slices(batches):
            ids, at = encoder.encode(texts_of(part.column(1)))
            raw, to = encoder.decode(ids)
            spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(to[at[1:]] - to[at[:-1]], pa.int64()),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([(to[a:b] - to[a]).astype("<u4").tobytes() for a, b in spans], pa.binary()),
                    pa.array([raw[to[a] : to[b]].tobytes() for a, b in spans], pa.binary()),
                ],
                names=[id_column, "n_bytes", "n_tokens", "ids", "offsets", "decoded"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(work, f"`{id_column}` {kind}, n_bytes long, n_tokens long, ids binary, offsets binary, decoded binary")


def digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
