"""Token counts of texts by rank-synchronous array merging.

Texts go through Arrow in batches; in each, the pre-tokens not seen before by
the task are merged together (``bpe_core.merge``) and the counts of surviving
symbols are added up for each text. A task's memory holds at most
``HELD_WORDS`` counted pre-tokens and the pre-tokens of ``CHARS`` characters, plus
one text.

Edge cases: null counts as empty; empty texts have no tokens; strings of added
special tokens inside a text are one token each, as in the tokenizer's library;
null identifiers and repeated rows are counted row by row; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.bpe_core import Vocabulary, by_size, encode_words, from_json
from orrery.llm.pretokens import Splitter, known_to_tokenizers
from orrery.llm.shared import table

CHARS = 1 << 20
HELD_WORDS = 300_000
LIMIT = 512


def counter(vocabulary: Vocabulary, splitter: Splitter, limit: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = splitter.compiled()
        special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        held: dict[str, int] = {}
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            lengths = [len(t.as_py() or "") for t in texts] if len(texts) < 64 else [x or 0 for x in pa.compute.utf8_length(texts).to_pylist()]
            for a, b in by_size(lengths, CHARS):
                part, words, extra = texts.slice(a, b - a).to_pylist(), [], []
                for text in part:
                    pieces = special.split(text or "") if special else [text or ""]
                    extra.append(len(pieces) - 1)
                    words.append(find(pieces[0]) if len(pieces) == 1 else [w for p in pieces for w in find(p)])
                new = list(set().union(*words).difference(held))
                if len(held) + len(new) > HELD_WORDS:
                    held.clear()
                    new = list(set().union(*words))
                if new:
                    held.update(zip(new, encode_words(new, vocabulary)[1].tolist(), strict=True))
                n = np.array([sum(map(held.__getitem__, w)) + x for w, x in zip(words, extra, strict=True)], np.int64)
                size = [len((t or "").encode("utf-8")) for t in part]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], schema=schema)

    return run


def count_tokens(df: DataFrame, vocabulary: Vocabulary, splitter: Splitter, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row. The vocabulary's size bounds what is sent to workers."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(counter(vocabulary, splitter, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return count_tokens(table(spark, sf_dir, "documents"), from_json(public.path("byte_bpe_50k.json")), Splitter(public.PATTERN, known_to_tokenizers))
