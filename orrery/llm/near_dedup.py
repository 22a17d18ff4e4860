r"""MinHash near-dedup by a multi-index Hamming join.

Words are ``[^\x20\x09-\x0D]+`` with A-Z in lower case; a document's set holds its
distinct shingles of ``WORDS`` words (as 64-bit hashes), or its whole sequence as one
if it has fewer. Documents are linked if 100 * intersection >= ``PERCENT`` * union.

1. Documents with the same set collapse to the one with the smallest identifier.
2. A signature has c chunks of ``WIDE`` MinHash symbols of 16 bits. Two signatures
   that differ in at most 2c - 1 symbols have, by the pigeonhole principle, a
   chunk with at most one error; leaving out each symbol of each chunk in turn
   gives keys of which such a pair shares one, always. c is the least number for which a pair at
   the threshold differs in more symbols with a probability of at most ``MISS``;
   a closer pair does so more rarely still.
3. Members of a bucket (equal keys) are compared with its leader, the member
   with the most bucket partners: as many pairs as members. Signatures within the
   distance make families. Where a bucket then holds several families, its
   members outside the leader's family meet all others in blocks of bounded size, which
   give back edges that join families. So each pair within the distance lies in
   one family, and pairs are never listed.
4. A family's sets are fetched once. The leader is compared with all, row by row; every
   document that it doesn't link is compared with all in blocks of bounded size, by counting
   common shingles through an inverted index: exact similarities, of which links that
   join components are kept. No family has to fit a task.
5. Components come from star contraction on the links, in tables, in a number of
   rounds that grows with the logarithm of a component's diameter.

Edge cases: null counts as empty; documents without words have no shingles and
are linked with nothing; rows with a null identifier are linked with nothing and
kept; rows of one identifier count as one document (if their texts differ, the one with
the most shingles, then the larger hashes, is compared with others); an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.shared import Scratch, lean, merged, sliced, table

WORDS, PERCENT, WIDE, SEED = 5, 85, 5, 23
#: Probability that a pair at the threshold differs in more symbols than the join allows for.
MISS = 1e-6
BLOCK = 2048
#: Shingles that a block holds.
HELD = 1 << 21
#: Signatures whose keys are one batch: a row becomes more than a hundred.
KEYED = 512
SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")

SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.binary())])


def chunks_for(percent: int, wide: int = WIDE, miss: float = MISS) -> int:
    """Chunks for signatures of pairs with a similarity of ``percent``."""
    c, p = 1, 1 - percent / 100
    while sum(comb(c * wide, k) * p**k * (1 - p) ** (c * wide - k) for k in range(2 * c, c * wide + 1)) > miss:
        c += 1
    return c


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    from xxhash import xxh3_64_intdigest

    found = SPLIT.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    total = np.full(n, np.uint64(min(len(h), words)))
    for k in range(min(words, len(h))):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(total)


def signer(words: int, symbols: int, seed: int):
    r = np.random.default_rng(seed)
    multiply = r.integers(1, 2**63, symbols, dtype=np.uint64) | np.uint64(1)
    add = r.integers(0, 2**63, symbols, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                sets = [shingles(t.as_py(), words) for t in part.column(1)]
                sizes = np.array([len(s) for s in sets], np.int64)
                some, flat = sizes > 0, np.concatenate(sets)
                starts = (np.cumsum(sizes) - sizes)[some]
                sig, h1, h2 = np.zeros((len(sets), symbols), np.uint16), np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                if len(flat):
                    h1[some], h2[some] = sums(flat, starts)
                    for k in range(symbols):
                        low = np.minimum.reduceat(mixed(flat * multiply[k] + add[k]), starts)
                        sig[some, k] = (mixed(low) & np.uint64(0xFFFF)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array([s.tobytes() for s in sig], pa.binary())], schema=SIGNED)

    return run


def signatures_of(column: pa.Array, symbols: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, symbols)


def keyer(chunks: int, wide: int):
    """Keys of each signature: each chunk without each of its symbols."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, KEYED):
            sig = signatures_of(batch.column(1), chunks * wide).astype(np.uint64)
            keys = []
            for c in range(chunks):
                for left in range(wide):
                    key = np.full(len(sig), np.uint64(c * wide + left + 1))
                    for k in range(wide):
                        if k != left:
                            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, c * wide + k])
                    keys.append(key)
            ids = np.tile(batch.column(0).to_numpy(), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(ids)], schema=schema)

    return run


def within(limit: int, symbols: int):
    """Pairs whose signatures differ in at most ``limit`` symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = (signatures_of(batch.column(2), symbols) != signatures_of(batch.column(3), symbols)).sum(1)
                yield batch.filter(pa.array(away <= limit)).select(["a", "b"])

    return run


def sums(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums that stand for each of several sets laid end to end."""
    return np.add.reduceat(mixed(flat), starts), np.add.reduceat(mixed(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """Adds the set (sorted 64-bit hashes) to rows (text, id, h1, h2, ...); rows whose text has another set go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingles(t.as_py(), words) for t in part.column(0)]
                own = [tuple(int(x[0].view(np.int64)) for x in sums(s, np.zeros(1, np.int64))) if len(s) else (0, 0) for s in sets]
                same = pa.array([x == y for x, y in zip(own, zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([s.tobytes() for s in sets], pa.binary())], names=[*part.schema.names[1:], "set"]).filter(same)

    rest = [f for f in texts.schema.fields if f.name != "text"]
    return texts.select("text", *[f.name for f in rest]).mapInArrow(lean(run), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest) + ", set binary")


class Overlaps:
    """Inverted index of sets; counts what another set shares with each."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.tokens, at = np.unique(flat, return_inverse=True)
        self.doc = np.repeat(np.arange(len(sets)), self.sizes)[np.argsort(at, kind="stable")]
        self.ends = np.cumsum(np.bincount(at, minlength=len(self.tokens)))

    def links(self, x: np.ndarray, percent: int) -> np.ndarray:
        """Whether each set is alike enough to ``x``."""
        k = np.minimum(np.searchsorted(self.tokens, x), len(self.tokens) - 1)
        k = k[self.tokens[k] == x]
        starts = np.where(k > 0, self.ends[k - 1], 0)
        sizes = self.ends[k] - starts
        at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        both = np.bincount(self.doc[at], minlength=len(self.sizes))
        return 100 * both >= percent * (self.sizes + len(x) - both)


def block_links(percent: int):
    """Links between a block of a family's open documents (left) and a block of all of it (right)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("set")] for t in (left, right))
        found, ids = Overlaps(y), right.column("id").to_numpy()
        # What is linked with the leader is one component already.
        place = {int(j): k for k, j in enumerate(ids)}
        root = np.where(right.column("linked").to_numpy(zero_copy_only=False), -1, np.arange(len(ids)))
        edges = []
        for i, v in zip(left.column("id").to_numpy().tolist(), x, strict=True):
            hit = np.flatnonzero(found.links(v, percent) & (ids != i))
            own = root[place[i]] if i in place else None
            for r in np.unique(root[hit]):
                if r != own:
                    edges.append((i, int(ids[hit[root[hit] == r][0]])))
                    if own is not None:
                        root[root == r] = own
        return pa.table([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], schema=schema)

    return run


def with_leader(percent: int, names: list[str]):
    """Rows (lead, set, ...) without the first column, with ``linked``: whether both sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            found = []
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                found.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.bool_())], names=names)

    return run


def exact_links(families: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) within families (id, family, n_shingles, h1, h2, central) by full sets; as many as join their components."""
    top = F.max(F.struct("central", (-F.col("id")).alias("least"))).alias("top")
    # A family's leader is its most central document.
    heads = families.groupBy("family").agg(top, F.ceil(F.sum("n_shingles") / HELD).cast("int").alias("blocks"))
    heads = scratch.put("heads", heads.select("family", (-F.col("top.least")).alias("leader"), "blocks"))
    members = families.select("id", "h1", "h2", "family", F.col("n_shingles").alias("n"))
    texts = docs.join(merged(members), F.col("doc_id") == F.col("id")).select("text", *members.columns)
    # Repeated rows of an identifier give one set.
    sets = scratch.put("sets", shingle_sets(texts, words).groupBy("id", "family", "n").agg(F.first("set").alias("set")))
    lead = heads.join(merged(sets.select(F.col("id").alias("leader"), F.col("set").alias("lead"))), "leader")
    pairs = sets.join(merged(lead), "family").select("lead", "set", "id", "family", "n", "leader", "blocks")
    kinds = "set binary, id long, family long, n long, leader long, blocks int, linked boolean"
    marked = scratch.put("marked", pairs.mapInArrow(lean(with_leader(percent, [k.split()[0] for k in kinds.split(", ")])), kinds))
    near = marked.where("linked AND id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b"))
    rest = marked.where("NOT linked")
    parts = scratch.put("parts", rest.groupBy("family").agg(F.ceil(F.sum("n") / HELD).cast("int").alias("parts")))
    if not parts.isEmpty():
        cut = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = rest.join(merged(parts), "family").withColumn("part", cut(F.col("parts"))).withColumn("block", every(F.col("blocks"))).select("family", "part", "block", "id", "set")
        right = marked.join(merged(parts), "family").withColumn("block", cut(F.col("blocks"))).withColumn("part", every(F.col("parts"))).select("family", "part", "block", "id", "set", "linked")
        left = left.toDF(*left.columns)  # new column identities: both sides come from one table
        by = ["family", "part", "block"]
        near = near.unionByName(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(block_links(percent), "a long, b long"))
    links = scratch.put("links", near)
    scratch.drop("heads", "sets", "marked", "parts")
    return links


def stars(edges: DataFrame) -> bool:
    """Whether every id of ``edges`` (u, v) is a centre (v) or has one centre (as u) and is none."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("spoke"), F.lit(0).alias("hub")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("spoke"), F.lit(1).alias("hub")))
    return ends.groupBy("id").agg(F.sum("spoke").alias("spoke"), F.max("hub").alias("hub")).where("spoke + hub > 1").isEmpty()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id and component (its smallest id) of every id in ``links`` (a, b), by alternating star contraction; in the scratch table ``name``."""
    edges, last = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), 0
    edges = scratch.put(f"{name}-0", edges)
    while not stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Larger neighbours point to the smallest one.
        large = both.join(merged(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # So do smaller ones, and the id itself.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(merged(least), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges, last = scratch.put(f"{name}-{last + 1}", small), last + 1
        scratch.drop(f"{name}-{last - 1}")
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    found = scratch.put(name, found)
    scratch.drop(f"{name}-{last}")
    return found


def comparer(limit: int, symbols: int):
    """Joins families (component) of members outside the leader's one (left) with others (right) that come within the distance."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        x, y = (signatures_of(t.column("sig"), symbols) for t in (left, right))
        c, d = (t.column("component").to_numpy() for t in (left, right))
        edges: set[tuple[int, int]] = set()
        for lo in range(0, len(x), 64):
            away = np.zeros((len(x[lo : lo + 64]), len(y)), np.uint8)
            for k in range(symbols):
                away += x[lo : lo + 64, k, None] != y[None, :, k]
            p, q = np.nonzero((away <= limit) & (c[lo : lo + 64, None] != d[None, :]))
            edges.update(map(tuple, np.unique(np.stack([c[lo + p], d[q]], axis=1), axis=0).tolist()))
        parent: dict[int, int] = {}

        def find(a: int) -> int:
            while parent.setdefault(a, a) != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            return a

        kept = []
        for a, b in sorted(edges):
            if (r := find(a)) != (t := find(b)):
                parent[r] = t
                kept.append((a, b))
        return pa.table([pa.array([e[k] for e in kept], pa.int64()) for k in (0, 1)], schema=schema)

    return run


def dedup_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``df``."""
    chunks, scratch = chunks_for(percent), Scratch(df.sparkSession)
    limit, symbols = 2 * chunks - 1, chunks * WIDE
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.put("signatures", docs.mapInArrow(lean(signer(words, symbols, SEED)), "doc_id long, n_shingles long, h1 long, h2 long, sig binary"))
    sets = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "h1", "h2")
    # The signature follows from the set, so any row of the set has it.
    nodes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"))
    groups = nodes = scratch.put("nodes", nodes)
    own = F.struct("n_shingles", "h1", "h2")
    twice = scratch.put("twice", nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(own).alias("own")).where("n > 1").select("id", "own"))
    if not twice.isEmpty():
        nodes = nodes.join(merged(twice), "id", "left").where(F.col("own").isNull() | (F.col("own") == own)).select(*groups.columns)
    sigs = nodes.select("id", "sig")
    keys = sigs.mapInArrow(lean(keyer(chunks, WIDE)), "key long, id long")
    # Summed before rows meet: a frequent key is one row a task.
    shared = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("size")).where("a <> b").select("key", "size")
    shared = scratch.put("shared", shared)
    members = scratch.put("members", keys.join(merged(shared), "key"))
    central = scratch.put("central", members.groupBy("id").agg(F.sum("size").alias("central")))
    leaders = members.join(merged(central), "id").groupBy("key").agg(F.max(F.struct("central", (-F.col("id")).alias("least"))).alias("top"))
    leaders = scratch.put("leaders", leaders.select("key", (-F.col("top.least")).alias("leader")))
    pairs = members.join(merged(leaders), "key").where("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    sig = lambda x: merged(sigs.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")))
    close = pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(within(limit, symbols), "a long, b long")
    found = components(scratch.put("close", close), scratch, "near")
    # What the leaders leave open.
    placed = members.join(merged(found), "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("component"))
    spread = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("size").alias("size")).where("lo <> hi").select("key", "size")
    spread = spread.join(merged(leaders), "key").join(merged(found.withColumnRenamed("id", "leader")), "leader", "left").select("key", F.coalesce("component", "leader").alias("head"))
    spread = scratch.put("spread", spread)
    if not spread.isEmpty():
        rest = scratch.put("open", placed.join(merged(spread), "key").join(merged(sigs), "id"))
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        block = F.pmod(F.xxhash64("id"), blocks).cast("int")
        every = F.explode(F.sequence(F.lit(0), blocks - 1))
        left = rest.where("component <> head").withColumn("block", block).withColumn("other", every).select("key", "block", "other", "id", "component", "sig")
        right = rest.withColumn("other", block).withColumn("block", every).select("key", "block", "other", "id", "component", "sig")
        by = ["key", "block", "other"]
        more = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(comparer(limit, symbols), "a long, b long").distinct()
        star = found.select(F.col("id").alias("a"), F.col("component").alias("b"))
        found = components(star.unionByName(scratch.put("more", more)), scratch, "families")
        scratch.drop("open", "more", "near")
    scratch.drop("shared", "members", "leaders", "close", "spread")
    families = found.withColumnRenamed("component", "family").join(merged(nodes.drop("sig")), "id").join(merged(central), "id", "left")
    families = scratch.put("members", families.withColumn("central", F.coalesce("central", F.lit(0))))
    links = exact_links(families, docs, words, percent, scratch)
    linked = components(links, scratch, "components")
    scratch.drop(*[n for n in scratch.paths if n not in ("signatures", "nodes", "components")])
    groups = groups.select("h1", "h2", "n_shingles", "id").join(merged(linked), "id", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    empty = signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = sets.join(merged(groups), ["h1", "h2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_near(table(spark, sf_dir, "documents"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates (shingles of five words, similarity 0.8 or more) the first document."""
    gone = dedup_near(docs, percent=80).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
    return docs.join(merged(gone.distinct()), F.col("doc_id") == F.col("__gone"), "left_anti")


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
  FROM d),
e AS MATERIALIZED (SELECT doc_id, unnest(g) AS x FROM s),
n AS (SELECT doc_id, len(g) AS k FROM s),
f AS (SELECT x, count(*) AS c FROM e GROUP BY x),
r AS (
  SELECT doc_id, x FROM (
    SELECT e.doc_id, e.x, k, row_number() OVER (PARTITION BY e.doc_id ORDER BY c, e.x) AS place FROM e JOIN f USING (x) JOIN n USING (doc_id))
  WHERE place <= k - (85 * k + 99) // 100 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.x = b.x AND a.doc_id < b.doc_id),
i AS (SELECT a, b, count(*) AS n FROM c JOIN e p ON p.doc_id = a JOIN e q ON q.doc_id = b AND q.x = p.x GROUP BY a, b),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i.n >= 85 * (p.k + q.k - i.n)),
t AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
m AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT m.a, t.b FROM m JOIN t ON m.b = t.a)
SELECT n.doc_id, CAST(n.k AS BIGINT) AS n_shingles, min(m.b) AS component_id, min(m.b) = n.doc_id AS kept
FROM n JOIN m ON m.a = n.doc_id GROUP BY n.doc_id, n.k
"""
