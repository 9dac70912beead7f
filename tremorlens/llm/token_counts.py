"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies.

No document is ever encoded.  A chunk of documents is cut into pre-tokens; the chunk's distinct
pre-tokens go out in blocks, one for each bucket of their hash, and each document keeps the
numbers and frequencies of its pre-tokens.  Blocks of one bucket meet, every distinct pre-token
of the bucket is merged once, and its number of pieces goes back to the chunk, where it is
multiplied with the frequencies.  Blocks are columns of bytes, so what is shuffled is a few bytes
for each distinct pre-token of a chunk and of a document, never a text.

A frequent pre-token is one entry in each chunk that has it, so no bucket is hot; buckets grow
in number with the bytes of the input, so that the dictionary of one stays bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlens.llm.bpe import cut_specials, distinct_rows, json_encoder, row_keys
from tremorlens.llm.common import landed, slices, texts_of

#: Bytes of text for which one more bucket of the dictionary is opened.
BUCKET_BYTES = 64 << 20
SCHEMA = "chunk string, id {kind}, n_bytes long, specials long, frequencies binary, bucket int, words binary"


def _pack(*arrays) -> bytes:
    """A few arrays of unsigned numbers, each in its narrowest type, compressed."""
    parts = []
    for a in arrays:
        kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(a) or int(a.max()) < 1 << (8 * int(k[2])))
        parts.append(np.array([len(a), int(kind[2])], dtype="<u4").tobytes() + a.astype(kind).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(raw: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    while at < len(raw):
        n, width = np.frombuffer(raw, dtype="<u4", count=2, offset=at).tolist()
        out.append(np.frombuffer(raw, dtype=f"<u{width}", count=n, offset=at + 8).astype(np.int64))
        at += 8 + n * width
    return out


def _frequencies(codes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each text, its pre-token numbers (as differences) and how often each occurs."""
    width = int(codes.max(initial=0)) + 1
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair, count = np.unique(owner * width + codes, return_counts=True)
    cut = np.searchsorted(pair, np.arange(len(first)) * width)
    pair %= width
    return [_pack(np.diff(pair[a:b], prepend=0), count[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _by_bucket(groups: list[np.ndarray], buckets: int) -> tuple[np.ndarray, dict[int, bytes]]:
    """New number of each distinct pre-token (ordered by bucket), and the pre-tokens of each bucket: lengths and bytes."""
    bucket = np.concatenate([(row_keys(g) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets) for g in groups]).astype(np.int64)
    size = np.concatenate([np.full(len(g), g.shape[1], dtype=np.int64) for g in groups])
    raw = np.concatenate([g.ravel() for g in groups])
    begin = np.cumsum(size) - size
    order = np.argsort(bucket, kind="stable")
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.arange(len(order))
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    words = {}
    for b in np.flatnonzero(np.diff(cut)).tolist():
        mine = order[cut[b] : cut[b + 1]]
        at = np.repeat(begin[mine] - np.cumsum(size[mine]) + size[mine], size[mine]) + np.arange(size[mine].sum())
        words[b] = _pack(size[mine], raw[at])
    return number, words


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Number of tokens of every whole text by the byte-level ``.json`` vocabulary at ``path``.

    Returns id, n_bytes (UTF-8) and n_tokens, one row for each row of ``docs``.  Special strings inside a text count as one token, as
    the tokenizer's own library has it.  A null or empty text has no tokens; repeated rows and null ids come back as often as they
    are there; other columns are not read; an empty table gives no rows.  ``buckets`` follows the bytes of the input unless given.
    """
    spark, kind = docs.sparkSession, docs.schema[id_column].dataType.simpleString()
    if buckets is None:
        total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        buckets = 12 + int(total) // BUCKET_BYTES

    def cut(batches):
        import uuid

        encoder = json_encoder(path)
        for part in slices(batches):
            chunk = uuid.uuid4().hex
            texts, specials, owner = [], [], []
            for k, t in enumerate(texts_of(part.column(1))):
                pieces = cut_specials(t, encoder.special) if any(s in t for s in encoder.special) else [t]
                plain = [x for x in pieces if isinstance(x, str)]
                specials.append(len(pieces) - len(plain))
                texts += plain
                owner += [k] * len(plain)
            codes, groups, first = encoder.distinct(texts)
            first = first[np.searchsorted(owner, np.arange(part.num_rows + 1))]
            words: dict[int, bytes] = {}
            if groups:
                number, words = _by_bucket(groups, buckets)
                codes = number[codes]
            n, m = part.num_rows, len(words)
            sizes = [len(t.encode()) for t in texts_of(part.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk] * (n + m), pa.string()),
                    pa.concat_arrays([part.column(0), pa.nulls(m, part.column(0).type)]),
                    pa.array(sizes + [None] * m, pa.int64()),
                    pa.array(specials + [None] * m, pa.int64()),
                    pa.array([*_frequencies(codes, first), *[None] * m], pa.binary()),
                    pa.array([-1] * n + list(words), pa.int32()),
                    pa.array([None] * n + list(words.values()), pa.binary()),
                ],
                names=["chunk", "id", "n_bytes", "specials", "frequencies", "bucket", "words"],
            )

    def count(batches):
        """Blocks arrive bucket by bucket; when a bucket is complete, each of its distinct pre-tokens is merged once."""
        encoder, bucket, held = json_encoder(path), None, []

        def close():
            sizes, letters = [], []
            for _, raw in held:
                size, letter = _unpack(raw)
                sizes.append(size)
                letters.append(letter.astype(np.uint8))
            size, letter = np.concatenate(sizes), np.concatenate(letters)
            begin, pieces = np.cumsum(size) - size, np.zeros(len(size), dtype=np.int64)
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                distinct, which = distinct_rows(letter, begin[at], n)
                pieces[at] = encoder.fresh(distinct)[1][which]
            cut = np.cumsum([0, *map(len, sizes)]).tolist()
            out = [_pack(pieces[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in held], pa.string()), pa.array([bucket] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["chunk", "bucket", "pieces"])

        for batch in batches:
            for c, b, raw in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if b != bucket and held:
                    yield close()
                    held = []
                bucket = b
                held.append((c, raw))
        if held:
            yield close()

    def add(batches):
        """The counts of a chunk arrive before its documents, bucket after bucket, which is the order of their numbers."""
        chunk, vector, parts = None, None, []
        for batch in batches:
            keep, tokens = [], []
            for k, (c, b, frequencies, specials) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 4, 5, 3)), strict=True)):
                if c != chunk:
                    chunk, vector, parts = c, None, []
                if b >= 0:
                    parts.append(_unpack(frequencies)[0])
                    continue
                if vector is None:
                    vector = np.concatenate([*parts, np.zeros(0, np.int64)])
                steps, times = _unpack(frequencies)
                keep.append(k)
                tokens.append(int((vector[np.cumsum(steps)] * times).sum()) + specials)
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(keep), batch.column(2).take(keep), pa.array(tokens, pa.int64())], names=[id_column, "n_bytes", "n_tokens"])

    cut_docs = landed(docs.select(id_column, text).mapInArrow(cut, SCHEMA.format(kind=kind)), "pretokens")
    blocks = cut_docs.filter("bucket >= 0").select("chunk", "bucket", "words")
    n = max(buckets, 1)
    counted = blocks.repartition(n, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(count, "chunk string, bucket int, pieces binary")
    rows = cut_docs.filter("bucket < 0").select("chunk", "id", "n_bytes", "specials", "bucket", "frequencies")
    backs = counted.select("chunk", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("specials"), "bucket", F.col("pieces").alias("frequencies"))
    return (
        backs.unionByName(rows)
        .repartition(n, "chunk")
        .sortWithinPartitions("chunk", F.col("bucket") < 0, "bucket")
        .mapInArrow(add, f"`{id_column}` {kind}, n_bytes long, n_tokens long")
    )
