import glob
import gzip
import hashlib

import numpy as np
import pytest
from orrery.llm import ann, mixing, warc
from orrery.llm.queries import QUERIES, SQL
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string, payload string, key int"


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://h/{i}\n", t, "clash", 1) for i, t in rows], PAGES)


def test_warc(spark, tmp_path):
    long = "<p>é</p>" * 4000
    rows = [(1, "x" * 999), (2, "x" * 999), (3, "y" * 1000), (4, "y" * 1000), (5, None), (6, ""), (7, long), (8, long), (9, long), (None, "y" * 1000), (10, "z\r\n\r\nWARC/1.1\r\n" * 200), (4, "y" * 1000)]
    manifest = warc.write_archives(warc.records(pages(spark, rows)), f"file://{tmp_path}/out", chunk=1000)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    chunks = warc.read_archives(manifest, chunk=777)
    got = sorted(map(repr, (tuple(r) for r in warc.payloads_of(chunks).collect())))
    top = {}
    for i, t in rows:
        if len((t or "").encode()) >= 1000:
            top[t] = max(top.get(t, -1), -1 if i is None else i)
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        again = t in top and i != top[t]
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top[t] if again else None))
    assert got == sorted(map(repr, want))
    # Chunks put together give the payloads; each one's digest covers all bytes so far.
    held = {}
    for r in sorted(chunks.where("record_type = 'response'").collect(), key=lambda r: r["chunk_no"]):
        assert len(r["data"]) <= 777
        held.setdefault(r["page_id"], b"")
        if r["page_id"] != 4:
            held[r["page_id"]] += bytes(r["data"])
            assert r["digest"] == hashlib.sha1(held[r["page_id"]]).hexdigest()
    assert held[9].decode() == long and held[10] == (b"z\r\n\r\nWARC/1.1\r\n" * 200)
    text = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/out/*.warc.gz"))
    assert text.startswith(b"WARC/1.1\r\n") and b"WARC-Type: revisit" in text


def test_warc_without_identifiers(spark):
    got = warc.read_archives(warc.write_archives(warc.records(pages(spark, [(None, "y" * 2000), (None, "y" * 2000), (1, "z")])))).where("last").collect()
    assert {q["record_type"] for q in got} == {"response"} and len({q["record_id"] for q in got}) == 3


def test_warc_empty(spark):
    manifest = warc.write_archives(warc.records(pages(spark, [])))
    assert warc.payloads_of(warc.read_archives(manifest)).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], "vec_id long, embedding array<float>, label int, rank string")


def nearest_by_hand(rows, asked, k):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == len(rows[0][1]) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in ok:
        if asked(i):
            scored = sorted((-float(np.dot(np.float64(v), np.float64(w))), j) for j, w in ok if j != i)
            out[i] = scored[:k]
    return out


@pytest.mark.parametrize("copies", [0, 300])
def test_ann(spark, copies, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERIES", 16)
    r = np.random.default_rng(1)
    x = r.standard_normal((600, 16)).astype(np.float32)
    x[-copies or 600 :] = x[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(2000, None), (2010, [0.0] * 16), (2020, [None] + [1.0] * 15), (2030, [float("nan")] * 16), (2040, [float("inf")] * 16), (2050, []), (None, rows[3][1]), rows[20]]
    got = {}
    for row in ann.search(vectors(spark, rows), F.col("vec_id") % 10 == 0, k=7, target=1.0).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], -row["score"], row["vec_id"]))
    want = nearest_by_hand(rows, lambda i: i % 10 == 0, 7)
    assert set(got) == set(want)
    hit = sum(len({v for _, _, v in got[q]} & {v for _, v in want[q]}) for q in want)
    assert hit >= 0.95 * 7 * len(want)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 8)) and q not in {f[2] for f in found}
        assert [(f[1], f[2]) for f in found] == sorted((f[1], f[2]) for f in found)
        if copies and q >= 300:
            assert [f[2] for f in found] == [v for _, v in want[q]]


def test_ann_few(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (20, [0.0, 1.0])]
    got = [tuple(r) for r in ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0)]
    assert ann.search(vectors(spark, rows[:1]), F.lit(True)).count() == 0
    assert ann.search(vectors(spark, []), F.lit(True)).count() == 0
    with pytest.raises(ValueError, match="no inner product"):
        ann.search(vectors(spark, [*rows, (3, [1.0, 2.0, 3.0])]), F.lit(True))


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_ann_recall(spark, folder):
    """Recall of the search as it ships, against brute force."""
    df = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([q[0] for q in rows]), np.array([q[1] for q in rows], float)
    scores = x[ids % 20 == 0] @ x.T
    scores[np.arange(len(scores)), np.flatnonzero(ids % 20 == 0)] = -np.inf
    want = {int(q): set(ids[np.argsort(-s)[:20]].tolist()) for q, s in zip(ids[ids % 20 == 0], scores, strict=True)}
    found = {}
    for q in ann.op1_ann(spark, f"/root/testdata/{folder}").collect():
        found.setdefault(q["query_id"], set()).add(q["vec_id"])
    assert set(found) == set(want)
    recall = sum(len(found[q] & want[q]) for q in want) / (20 * len(want))
    print("recall", folder, recall)
    assert recall >= 0.9


def fill(budget, children):
    """children: name -> (cap, weight); shortages go to siblings by weight."""
    got, left, open_ = {}, budget, {n for n, (c, w) in children.items() if w > 0}
    while open_:
        total = sum(children[n][1] for n in open_)
        full = {n for n in open_ if children[n][0] <= left * children[n][1] / total + 1e-9}
        if not full:
            got |= {n: left * children[n][1] / total for n in open_}
            break
        n = min(full, key=lambda n: children[n][0] / children[n][1])
        got[n] = children[n][0]
        left -= got[n]
        open_.remove(n)
    return {n: got.get(n, 0.0) for n in children}


def test_mixing(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), " ".join(["w"] * int(r.integers(0, 40))), str(r.choice(["en", "en", "en", "de", "fr"])), f"src{r.integers(0, 9)}") for i in range(3000)]
    rows += [(5000, None, None, None), (6000, "a b c", None, "none"), (6001, "d e", "none", None), (6002, "f g h i", None, None), (5001, "", "en", "src1"), (None, "a b", "en", "odd"), (5002, "x " * 50_000, "de", "src3"), (7, rows[7][1], rows[7][2], rows[7][3])]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, lang string, source string, domain string")
    got = mixing.mix(df, mixing.document_levels(), share=0.8, max_epochs=2, seed=17, weights=mixing.WEIGHTS).collect()
    leaves = {}
    for i, t, lang, source in rows:
        number = int("".join(c for c in source or "" if c.isdigit()) or 0)
        leaves.setdefault((f"domain{number % 4}", lang, source), []).append((i, len((t or "").split())))
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
    budget = {(): 0.8 * sum(tokens.values())}
    for depth, level in enumerate(("domain", "lang", "source")):
        new = {}
        for parent, b in budget.items():
            kids = {k[: depth + 1] for k in leaves if k[:depth] == parent}
            caps = {k: (2.0 * sum(n for leaf, n in tokens.items() if leaf[: depth + 1] == k), mixing.WEIGHTS.get(level, {}).get(k[-1], 1.0)) for k in kids}
            new |= fill(b, caps)
        budget = new
    want = []
    for leaf, members in leaves.items():
        n = tokens[leaf]
        whole = int(min(2, np.floor(budget[leaf] / n + 1e-9))) if n else 0
        want += [(i, *leaf, w, e) for i, w in members for e in range(whole)]
        edge, start = (0 if whole >= 2 else budget[leaf] - whole * n), 0
        keyed = {}
        for i, w in members:
            keyed.setdefault(hashlib.md5(f"17:{whole}:{'none' if i is None else i}".encode()).hexdigest(), []).append((i, w))
        for _, same in sorted(keyed.items()):
            if edge > 1e-6 and start < edge:
                want += [(i, *leaf, w, whole) for i, w in same]
            start += sum(w for _, w in same)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert mixing.mix(df.limit(0), mixing.document_levels()).count() == 0
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() == len(want)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(against_sql, name):
    against_sql(QUERIES[name], SQL[name], "/root/testdata/sf0.001")
