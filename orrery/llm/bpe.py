"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Each task cuts its texts into pre-tokens. A block of texts keeps a list of
   its distinct words; a text becomes the sequence of its words' places in that
   list, in order of position. Words leave the block in packs, one for each
   hash bucket.
2. Packs are dealt out by bucket: all occurrences of a word in any block meet in
   one task, which encodes each distinct word once and hands the ids back to
   every block that asked.
3. Ids and sequences are dealt out by block: each text's ids are put together by
   position. Decoding looks the ids up in the table of token bytes.

A word crosses the network once for each block and not for each occurrence,
so frequent words are no hot keys, and blocks and buckets are of bounded size.
The packed table is written to the shared folder once, so a repeated task
never sees other blocks; it is bucketed by block, so that only words and ids are
shuffled.

Edge cases: null counts as empty; empty texts have no ids; null identifiers
and repeated rows are encoded row by row; an empty table gives no rows; other
columns are ignored, whatever their names. Decoding keeps null id lists null
and rejects ids outside the vocabulary.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.bpe_core import Vocabulary, by_size, decimals, encode_words, from_ranks, gathered
from orrery.llm.pretokens import Splitter, known_to_tiktoken
from orrery.llm.shared import scratch_path, table

CHARS = 1 << 19
BLOCK_CHARS = 24 << 20
BLOCK_WORDS = 300_000
HELD_WORDS = 300_000

PACKS = "block long, bucket int, kind int, ids array<long>, pack binary"
SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("ids", pa.list_(pa.int64())), ("pack", pa.binary())])
WORDS, SEQUENCE = 0, 1

#: Numbers below ONE take one byte, below TWO two bytes, any other five.
ONE, TWO = 200, 200 + 55 * 256


def planes(a: np.ndarray) -> bytes:
    """Numbers as planes of bytes: first bytes, second bytes, then the large ones."""
    a = np.asarray(a, np.int64)
    two, large = (a >= ONE) & (a < TWO), a >= TWO
    first = np.where(two, ONE + ((a - ONE) >> 8), np.where(large, 255, a)).astype(np.uint8)
    wide = np.ascontiguousarray(a[large], dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return b"".join(n.to_bytes(8, "little") for n in (len(a), int(two.sum()), int(large.sum()))) + first.tobytes() + ((a[two] - ONE) & 255).astype(np.uint8).tobytes() + wide


def from_planes(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    n, m, k = (int.from_bytes(raw[at + 8 * i : at + 8 * i + 8], "little") for i in range(3))
    at += 24
    first = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    two, large = (first >= ONE) & (first < 255), first == 255
    first[two] = ((first[two] - ONE) << 8) + np.frombuffer(raw, np.uint8, m, at + n) + ONE
    first[large] = np.frombuffer(raw, np.uint8, 4 * k, at + n + m).reshape(4, k).T.copy().view("<u4").ravel()
    return first, at + n + m + 4 * k


def packed(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(map(planes, arrays)) + tail)


def unpacked(pack: bytes, n: int) -> list:
    """``n`` arrays and the bytes after them."""
    import zstandard

    raw, at, found = zstandard.ZstdDecompressor().decompress(pack), 0, []
    for _ in range(n):
        a, at = from_planes(raw, at)
        found.append(a)
    return [*found, raw[at:]]


def pack_words(places: list[int], words: list[bytes]) -> bytes:
    return packed(np.diff(np.array(places), prepend=0), np.fromiter(map(len, words), np.int64, len(words)), tail=b"".join(words))


def unpack_words(pack: bytes) -> tuple[np.ndarray, list[str]]:
    steps, lengths, raw = unpacked(pack, 2)
    return steps, [raw[b - n : b].decode("utf-8", "surrogatepass") for b, n in zip(np.cumsum(lengths).tolist(), lengths.tolist(), strict=True)]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA, strict=True)], schema=SCHEMA)


def splitter(cut: Splitter, buckets: int):
    """Texts to blocks: sequences of words' places, and packs of the block's distinct words.

    Places go by falling frequency in the block, then by the words themselves,
    which keeps both the sequences and the packs short.
    """

    def close(block: int, places: dict[str, int], held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        n = len(places)
        often = sum((np.bincount(at, minlength=n) for _, _, at in held), np.zeros(n, np.int64)).tolist()
        words = sorted(places, key=lambda w: (-often[places[w]], w))
        to = np.empty(n, np.int64)
        to[np.fromiter(map(places.__getitem__, words), np.int64, n)] = np.arange(n)
        packs: dict[int, tuple[list, list]] = {}
        for k, word in enumerate(words):
            raw = word.encode("utf-8", "surrogatepass")
            mine = packs.setdefault(zlib.crc32(raw) % buckets, ([], []))
            mine[0].append(k), mine[1].append(raw)
        rows = [(block, b, WORDS, None, pack_words(*x)) for b, x in packs.items()]
        if rows:
            yield batch_of(rows)
        for ids, sizes, at in held:
            yield batch_of([(block, 0, SEQUENCE, ids, packed(np.array(sizes), to[at]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = cut.compiled()
        new_block = lambda: uuid.uuid4().int >> 65
        places, held, chars = {}, [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in by_size([x or 0 for x in pa.compute.utf8_length(texts).to_pylist()], CHARS):
                sizes, at = [], []
                for text in texts.slice(a, b - a).to_pylist():
                    words = find(text or "")
                    for word in set(words).difference(places):
                        places[word] = len(places)
                    sizes.append(len(words))
                    at.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
                    chars += len(text or "")
                held.append((ids[a:b], sizes, np.concatenate(at)))
                if len(places) >= BLOCK_WORDS or chars >= BLOCK_CHARS:
                    yield from close(new_block(), places, held)
                    places, held, chars = {}, [], 0
        yield from close(new_block(), places, held)

    return run


def encoder(vocabulary: Vocabulary):
    """Packs of words to packs of ids; each distinct word of the task is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, bytes] = {}
        for batch in batches:
            for block, bucket, _, _, pack in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                steps, words = unpack_words(pack)
                new = [w for w in words if w not in held]
                if len(held) + len(new) > HELD_WORDS:
                    held.clear()
                    new = words
                if new:
                    flat, counts = encode_words(new, vocabulary)
                    raw, ends = flat.astype(np.int32).tobytes(), np.cumsum(counts) * 4
                    held.update((w, raw[e - 4 * n : e]) for w, e, n in zip(new, ends.tolist(), counts.tolist(), strict=True))
                got = [held[w] for w in words]
                counts = np.fromiter(map(len, got), np.int64, len(got)) // 4
                yield batch_of([(block, bucket, WORDS, None, packed(steps, counts, np.frombuffer(b"".join(got), np.int32)))])

    return run


def assembler(vocabulary: Vocabulary, ids: bool, digests: bool):
    """A block's sequences and its packs of ids to one row for each text."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if ids else []
    fields += [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else []
    schema = pa.schema(fields)

    def text_row(doc_id, words: np.ndarray, block: tuple, decimal: tuple | None) -> tuple:
        found, total, a, b = [], 0, hashlib.sha256(), hashlib.sha256()
        # A very long text goes in pieces: only its ids are held whole, if asked for.
        for lo in range(0, len(words), 1 << 16):
            got = gathered(*block, words[lo : lo + (1 << 16)])
            total += len(got)
            if digests:
                a.update(b"," * (lo > 0) + gathered(*decimal, got).tobytes()[:-1])
                b.update(gathered(vocabulary.bytes, vocabulary.starts, vocabulary.lengths, got).tobytes())
            if ids:
                found.append(got.astype(np.int32))
        return (doc_id, total, *([np.concatenate(found) if found else np.zeros(0, np.int32)] if ids else []), *([a.hexdigest(), b.hexdigest()] if digests else []))

    def run(sequences: pa.Table, words: pa.Table) -> pa.Table:
        decimal = decimals(len(vocabulary.lengths)) if digests else None
        parts = []
        for pack in words.column("pack"):
            steps, n, raw, _ = unpacked(pack.as_py(), 3)
            parts.append((np.cumsum(steps), n, raw))
        place, n, flat = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
        starts, counts = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        starts[place], counts[place] = np.cumsum(n) - n, n
        found = []
        for doc_ids, pack in zip(sequences.column("ids"), sequences.column("pack"), strict=True):
            sizes, at, _ = unpacked(pack.as_py(), 2)
            ends = np.cumsum(sizes).tolist()
            rows = [text_row(i, at[e - k : e], (flat, starts, counts), decimal) for i, e, k in zip(doc_ids.as_py(), ends, sizes.tolist(), strict=True)]
            found.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema))
        return pa.Table.from_batches(found, schema=schema)

    return run, "doc_id long, n_tokens long" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests


def encode(df: DataFrame, vocabulary: Vocabulary, cut: Splitter, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """One row for each row of ``df``: doc_id, n_tokens, ids; with ``digests`` those of the ids and of the bytes they decode to."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Dealt by block as it is written, so that sequences need no shuffle to meet their ids.
    name, path = f"orrery_packs_{uuid.uuid4().hex}", scratch_path(spark, "packs")
    rows.mapInArrow(splitter(cut, buckets), PACKS).write.format("parquet").bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    packs = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its name only: files at a path of their own stay
    known = packs.where(F.col("kind") == WORDS).repartition(buckets, "bucket").mapInArrow(encoder(vocabulary), PACKS)
    run, schema = assembler(vocabulary, ids, digests)
    sequences = packs.where(F.col("kind") == SEQUENCE).select("block", "ids", "pack")
    return sequences.groupBy("block").cogroup(known.select("block", "pack").groupBy("block")).applyInArrow(run, schema)


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the bytes that ``ids_col`` stands for, by the table of token bytes."""
    from pyspark.sql.pandas.functions import pandas_udf

    starts, lengths, raw = vocabulary.starts, vocabulary.lengths, vocabulary.bytes

    def bytes_of(ids):
        return ids.map(lambda x: None if x is None else gathered(raw, starts, lengths, np.asarray(x, np.int64)).tobytes())

    import pandas as pd

    bytes_of.__annotations__ = {"ids": pd.Series, "return": pd.Series}
    return df.withColumn(to, pandas_udf(bytes_of, "binary")(F.col(ids_col)))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(table(spark, sf_dir, "documents"))


def encoded_documents(docs: DataFrame) -> DataFrame:
    """The query and the pipeline's stage: digests of ids and of decoded bytes for each document."""
    import public_tokenizers as public

    return encode(docs, from_ranks(public.path("byte_bpe_multi_50k.tiktoken")), Splitter(public.PATTERN, known_to_tiktoken), ids=False, digests=True)
