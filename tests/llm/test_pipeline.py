import base64
import hashlib
import sys
from pathlib import Path

import public_tokenizers as public
from orrery.llm import mixing, toxicity

sys.path.insert(0, str(Path(__file__).parent))
from test_dedup import lines_by_hand, sets_by_hand  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import corpus_pipeline
    import tiktoken

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    ok = {r["doc_id"] for r in toxicity.scored_documents(docs, labels).where("predicted = 0").collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] in ok}
    texts = lines_by_hand([(i, r["text"]) for i, r in rows.items()])
    groups = sets_by_hand(list(texts.items()), 80)
    kept = {i: t for i, t in texts.items() if groups[i][2]}
    small = spark.createDataFrame([(i, t, rows[i]["lang"], rows[i]["source"], len(t)) for i, t in kept.items()], docs.schema)
    taken = [r["doc_id"] for r in mixing.mixed_documents(small).collect()]
    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    codec = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i in taken:
        ids = codec.encode_ordinary(kept[i])
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(kept[i].encode()).hexdigest()))
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_stages_take_nulls_and_other_columns(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    schema = docs.schema
    odd = [(None, None, None, None, None), (1000, None, "en", None, 0), (1001, "a b c d e f", None, "src1", None), (1001, "a b c d e f", None, "src1", None), (1002, "", "en", "src1", 0)]
    more = docs.unionByName(spark.createDataFrame(odd, schema))
    for c in ("id", "id_", "key", "kept", "component_id", "n_tokens", "score", "epoch", "domain", "h1", "exact", "a", "b", "set"):
        more = more.withColumn(c, F.lit(1))
    more = more.cache()
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, more, FOLDER)
        rows = got.collect()
        assert rows, name
        if name != "bpe":
            assert got.columns == more.columns
        if name == "line_dedup":
            assert len(rows) == more.count()
        if name == "near_dedup":
            assert sum(r["doc_id"] == 1001 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
