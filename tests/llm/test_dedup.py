import hashlib
import random
import re

import pytest
from orrery.llm import exact_dedup, line_dedup, near_dedup

DOCS = "doc_id long, text string, text_sha256 string, digest int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOCS)


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


ROWS = [(1, "a b"), (2, "ab"), (3, " a  b "), (4, None), (5, ""), (6, " \n"), (7, "x"), (None, "x"), (8, "y" * 50_000), (9, "y" * 50_000), (10, "ab"), (10, "ab"), (11, "a b")]


@pytest.mark.parametrize("digest_bytes", [32, 1, 0])
def test_exact(spark, digest_bytes):
    got = exact_dedup.dedup_exact(frame(spark, ROWS), digest_bytes=digest_bytes) if digest_bytes else exact_dedup.dedup_exact(frame(spark, ROWS).repartition(7))
    groups = {}
    for i, t in ROWS:
        groups.setdefault(squeezed(t), []).append((i, t))
    want = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1] or ""), m[0] is None, m[0] or 0))
        want += [(i, best[0], len(members), i == best[0], hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_exact_empty(spark):
    assert exact_dedup.dedup_exact(frame(spark, [])).count() == 0


def test_exact_many_copies(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(9000)]
    got = exact_dedup.dedup_exact(frame(spark, rows))
    assert got.where("kept").count() == 6001
    assert got.where("keep_id = 0").count() == 3000


def test_exact_index_takes_more_batches(spark, monkeypatch):
    """Batches that come later find what earlier ones left, through filters, levels and merges."""
    monkeypatch.setattr(exact_dedup, "FANOUT", 2)
    r = random.Random(6)
    index, held = exact_dedup.Index(spark), {}
    for batch in range(5):
        rows = [(100 * batch + k, f"text  number {r.randrange(60)}" + " " * r.randrange(3)) for k in range(40)]
        hits = index.add(exact_dedup.digests(frame(spark, rows), "doc_id", "text"))
        want = {i: min(held[squeezed(t)])[1] for i, t in rows if squeezed(t) in held}
        assert {q["doc_id"]: q["keep_id"] for q in hits.collect()} == want if hits is not None else not held
        for i, t in rows:
            held.setdefault(squeezed(t), []).append((-len(t), i))
        assert all(len(level) < 2 for level in index.levels)
    whole = index.compact()
    assert len(index.runs()) == 1 and whole.entries.count() == len(held)
    got = {q["digest"].hex(): (q["best"]["ident"], q["n"]) for q in whole.entries.collect()}
    assert got == {hashlib.sha256(t.encode()).hexdigest(): (min(x)[1], len(x)) for t, x in held.items()}


def test_exact_filter(spark):
    """A run's filter lets all of its own digests through and few others."""
    rows = exact_dedup.digests(frame(spark, [(i, f"t{i}") for i in range(9000)]), "doc_id", "text")
    run = exact_dedup.Index(spark).write(exact_dedup.entries_of(rows.where("doc_id < 6000")))
    assert run.blocks > 1
    tested = run.tested(rows)
    assert tested.where("doc_id < 6000 AND maybe").count() == 6000
    assert tested.where("doc_id >= 6000 AND maybe").count() < 300


def one_edit(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def lines_by_hand(rows, least=16):
    seen, out = [], {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        kept = []
        for raw in (t or "").split("\n"):
            line = re.sub(r"[\x20\x09-\x0D]+", " ", raw).strip(" ")
            if line:
                gone = line in seen or len(line) >= least and any(one_edit(line, s) for s in seen if len(s) >= least)
                seen.append(line)
                if gone:
                    continue
            kept.append(raw)
        out[i] = "\n".join(kept)
    return out


def some_lines(n, seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcde é") for _ in range(r.randint(16, 60))) for _ in range(25)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(r.randint(0, 5)):
            line = r.choice(base)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                k = r.randrange(len(line))
                line = r.choice([line[:k] + line[k + 1 :], line[:k] + r.choice("abcxz") + line[k:], line[:k] + r.choice("abcxz") + line[k + 1 :]])
            text.append(line)
        rows.append((i, "\n".join(text)))
    return rows


def test_lines(spark):
    rows = [*some_lines(80, 3), (200, None), (201, ""), (202, "short\nshort"), (203, "a long line that is here twice\n\n a long  line that\tis here twice\nend"), (None, "a long line that is here twice"), (204, "z" * 40_000), (205, "z" * 39_999 + "q")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    want = lines_by_hand(rows)
    assert {k: v or "" for k, v in got.items()} == want
    assert got[200] is None and got[202] == "short" and got[205] == "" and got[None] == ""


def test_short_lines(spark):
    rows = [(1, "And ornd.\n\nLes.\n\n Les."), (2, "And  ornd.\nAnd ornt.\nx"), (3, "a line of sixteen or more\nLes.\nx"), (4, "a line of sixteen or mare\n \n")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: "And ornd.\n\nLes.\n", 2: "And ornt.\nx", 3: "a line of sixteen or more", 4: " \n"}


def test_lines_keep_columns_and_rows(spark):
    df = frame(spark, [(1, "a line of the same words\nb"), (1, "a line of the same words\nb"), (2, "a line of the same words")])
    got = line_dedup.dedup_lines(df)
    assert got.columns == df.columns
    assert sorted(r["text"] for r in got.collect()) == ["", "a line of the same words\nb", "a line of the same words\nb"]
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def sets_by_hand(rows, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        if w:
            sets.setdefault(i, set()).update(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    parent = {i: i for i, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets.get(i, ())), find(i), find(i) == i) for i, _ in rows}


def near_rows(seed, families=4, size=30, words=60):
    r, rows, k = random.Random(seed), [], 0
    for _ in range(families):
        base = [f"w{r.randrange(5000)}" for _ in range(words)]
        for _ in range(size):
            text = list(base)
            for _ in range(r.randrange(4)):
                text[r.randrange(words)] = f"n{r.randrange(10**6)}"
            rows.append((k, " ".join(text)))
            k += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("held", "block", "percent"), [(1 << 21, 2048, 85), (600, 8, 85), (1 << 21, 2048, 80)])
def test_near(spark, monkeypatch, held, block, percent):
    monkeypatch.setattr(near_dedup, "HELD", held)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = [*near_rows(5), (900, None), (901, ""), (902, "one two"), (903, "ONE two"), (904, " \n"), (905, "q " * 30_000), (906, "q " * 30_000 + "z")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.dedup_near(frame(spark, rows), percent=percent).collect()}
    assert got == sets_by_hand(rows, percent)


def test_near_nulls_and_repeats(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f")]
    got = sorted(map(repr, (tuple(r) for r in near_dedup.dedup_near(frame(spark, rows)).select("doc_id", "component_id", "kept").collect())))
    assert got == sorted(map(repr, [(None, None, True), (3, 3, True), (3, 3, True), (5, 3, False)]))
    assert near_dedup.dedup_near(frame(spark, [])).count() == 0


def test_near_other_texts_of_an_identifier(spark):
    same = "a b c d e f g h i j"
    rows = [(1, same), (2, "k l m n o p q"), (2, same + " z"), (3, "k l m n o p q"), (4, same + " z")]
    got = sorted(tuple(r) for r in near_dedup.dedup_near(frame(spark, rows), percent=80).select("doc_id", "component_id", "kept").collect())
    # The larger of identifier 2's texts stands for it; its other rows follow it.
    assert got == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 1, False)]


def test_signature_bound():
    assert near_dedup.chunks_for(85) == 13
    assert near_dedup.chunks_for(80) > near_dedup.chunks_for(85)


def test_near_keys_come_in_bounded_batches():
    import numpy as np
    import pyarrow as pa

    chunks = near_dedup.chunks_for(80)
    sig = np.random.default_rng(1).integers(0, 1 << 16, (3000, chunks * near_dedup.WIDE), dtype=np.uint16)
    rows = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array([s.tobytes() for s in sig], pa.binary())], names=["id", "sig"])
    run = near_dedup.keyer(chunks, near_dedup.WIDE)
    got = list(run(iter([rows.slice(0, 0), rows])))
    # Whatever the batches that come in: the worker and the JVM each hold one of these for every task.
    assert max(b.nbytes for b in got) <= 1 << 20
    alone = [b for k in range(0, 3000, 100) for b in run(iter([rows.slice(k, 100)]))]
    pairs = lambda batches: sorted((i, k) for b in batches for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    assert pairs(got) == pairs(alone) and len(pairs(got)) == 3000 * chunks * near_dedup.WIDE


def test_workers_give_memory_back(monkeypatch):
    import pyarrow as pa
    from orrery.llm import shared

    said = []
    monkeypatch.setattr(shared, "released", lambda: said.append("released"))
    rows = pa.RecordBatch.from_pydict({"x": list(range(10))})

    def run(batches):
        for batch in shared.sliced(batches, 4):
            said.append(batch.num_rows)
            yield batch

    assert pa.Table.from_batches(shared.lean(run)(iter([rows, rows.slice(0, 0)]))).column("x").to_pylist() == list(range(10))
    assert said == ["released", 4, 4, 2, "released"]
