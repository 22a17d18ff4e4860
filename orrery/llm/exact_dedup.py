"""Exact dedup: a log-structured merge index over digests, DataFrame operations only.

* Memtable and flush: a batch of rows is summed to one entry for each digest (the row that
  stays and the number of rows) and written as a run, sorted by digest, with a
  filter: for each block of digests their least and largest one and a bitmap in which every
  digest sets ``HASHES`` bits.
* Compaction: ``FANOUT`` runs of a level become one of the next; an entry keeps
  the smaller rank of both and the sum of their rows.
* Lookup: rows are dealt to the blocks of a run's filter; only those whose bits
  are set and that lie between the block's ends are joined with the run's entries. A new batch is
  looked up in each run before it is added (``Index.add``).
* Of the compacted index the entries of more than one row form a run of their own. Rows that its
  filter denies are alone in their group; hits among the rest are compared
  byte for byte with the row that stays. Groups whose bytes differ under one
  digest are grouped again by the bytes themselves.

Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``. Of
equal texts the row with the most code points in the original stays, then the
one with the smallest identifier.

Edge cases: a null text counts as empty; empty texts are equal to each other;
rows with a null identifier take part and sort after all identifiers; repeated
rows of one identifier count one by one in ``group_size`` and are all ``kept``
if their identifier stays; an empty table gives no rows; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.shared import Scratch, merged, table, written

#: Rows of a group that are verified against one copy of the text that stays.
ROWS_PER_COPY = 2048
#: Runs of a level before they are merged; batches that a table is added in; bits an entry and bits set for it; bits of a block.
FANOUT, BATCHES, BITS, HASHES, BLOCK = 4, 4, 12, 2, 32768


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def rank(points: Column, ident: Column) -> Column:
    """Smallest is best: most code points, then the smallest identifier, nulls last."""
    return F.struct((-points).alias("less"), ident.isNull().alias("none"), ident.alias("ident"))


def digests(df: DataFrame, id_col: str, text_col: str, digest_bytes: int = 32) -> DataFrame:
    """doc_id, points, sha and digest (the first bytes of sha) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), F.char_length(text).cast("long").alias("points"), F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("sha"))
    return rows.withColumn("digest", F.substring("sha", 1, digest_bytes))


def entries_of(rows: DataFrame) -> DataFrame:
    """One entry for each digest of rows: digest, best (the row that stays), n."""
    return rows.groupBy("digest").agg(F.min(rank(F.col("points"), F.col("doc_id"))).alias("best"), F.count(F.lit(1)).alias("n"))


def place(digest: Column, k: int, below: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(below)).cast("int")


def bit(bits: Column, at: Column) -> Column:
    """Whether bit ``at`` (from 0) of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0


@dataclass
class Run:
    """A sorted run: entries (digest, best, n) and the filter (block, lo, hi, bits) over them."""

    name: str
    entries: DataFrame
    filter: DataFrame
    blocks: int

    def tested(self, rows: DataFrame) -> DataFrame:
        """Rows with ``maybe``: whether the filter lets their digest through."""
        dealt = rows.withColumn("block", place(F.col("digest"), 0, self.blocks)).join(merged(self.filter), "block", "left")
        held = (F.col("digest") >= F.col("lo")) & (F.col("digest") <= F.col("hi"))
        for k in range(1, HASHES + 1):
            held &= bit(F.col("bits"), place(F.col("digest"), k, BLOCK))
        return dealt.withColumn("maybe", F.coalesce(held, F.lit(False))).drop("block", "lo", "hi", "bits")

    def lookup(self, rows: DataFrame) -> DataFrame:
        """Rows whose digest the run has, with ``best`` and ``n`` of its entry."""
        return self.tested(rows).where("maybe").drop("maybe").join(merged(self.entries), "digest")


class Index:
    """Runs by level, the newest last; level 0 takes flushed batches."""

    def __init__(self, spark: SparkSession):
        self.scratch, self.levels, self.made = Scratch(spark), [], 0

    def write(self, entries: DataFrame) -> Run:
        name, self.made = f"run-{self.made}", self.made + 1
        held = self.scratch.put(name, entries.sortWithinPartitions("digest"))
        blocks = max(1, -(-held.count() * BITS // BLOCK))
        bits = held.select("digest", place(F.col("digest"), 0, blocks).alias("block"), F.explode(F.array(*[place(F.col("digest"), k, BLOCK) for k in range(1, HASHES + 1)])).alias("at"))
        bits = bits.groupBy("block").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.bitmap_construct_agg(F.col("at").cast("long")).alias("bits"))
        return Run(name, held, self.scratch.put(f"{name}-filter", bits), blocks)

    def drop(self, *runs: Run) -> None:
        self.scratch.drop(*[n for r in runs for n in (r.name, f"{r.name}-filter")])

    def flush(self, entries: DataFrame, level: int = 0) -> None:
        """A new run; ``FANOUT`` of a level go to the next as one."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self.write(entries))
        if len(self.levels[level]) >= FANOUT:
            runs, self.levels[level] = self.levels[level], []
            self.flush(self.joint(runs), level + 1)
            self.drop(*runs)

    @staticmethod
    def joint(runs: list[Run]) -> DataFrame:
        every = runs[0].entries
        for run in runs[1:]:
            every = every.unionByName(run.entries)
        return every.groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n")) if len(runs) > 1 else every

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in reversed(level)]

    def lookup(self, rows: DataFrame) -> DataFrame | None:
        """doc_id, digest and keep_id (of the rows held so far) of each row whose digest the index has; None from an empty one."""
        found = None
        for run in self.runs():
            hits = run.lookup(rows.select("doc_id", "digest").distinct()).select("doc_id", "digest", "best")
            found = hits if found is None else found.unionByName(hits)
        return None if found is None else found.groupBy("doc_id", "digest").agg(F.min("best").alias("best")).select("doc_id", "digest", F.col("best.ident").alias("keep_id"))

    def add(self, rows: DataFrame) -> DataFrame | None:
        """Adds a batch (see ``digests``); returns its hits in what the index held before."""
        hits = self.lookup(rows)
        if hits is not None:
            hits = self.scratch.put(f"hits-{self.made}", hits)
        self.flush(entries_of(rows))
        return hits

    def compact(self) -> Run:
        """All runs as one."""
        runs = self.runs()
        if len(runs) > 1:
            run = self.write(self.joint(runs))
            self.drop(*runs)
            self.levels = [[] for _ in self.levels[1:]] + [[run]]
        return self.runs()[0]


def mismatches(df: DataFrame, id_col: str, text_col: str, members: DataFrame) -> DataFrame:
    """Digests under which some row's bytes differ from those of the row that stays."""
    copies = F.ceil(F.col("group_size") / ROWS_PER_COPY).cast("int")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    hits = members.where("group_size > 1").select("doc_id", "digest", stays.alias("stays"), copies.alias("copies")).distinct()
    texts = df.select(F.col(id_col).alias("t_id"), normalised(F.col(text_col)).alias("norm"))
    texts = merged(hits).join(merged(texts), F.col("doc_id").eqNullSafe(F.col("t_id"))).drop("t_id")
    # An identifier may stand in rows with other texts: only bytes of this digest count.
    texts = texts.where(F.substring(F.unhex(F.sha2(F.col("norm").cast("binary"), 256)), 1, F.length("digest")) == F.col("digest"))
    texts = written(texts, "hits")
    kept = texts.where("stays").groupBy("digest", "copies").agg(F.min("norm").alias("keep_norm"))
    kept = kept.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    dealt = texts.withColumn("copy", F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int"))
    return dealt.join(merged(kept), ["digest", "copy"]).where(F.col("norm") != F.col("keep_norm")).select("digest").distinct()


def regrouped(df: DataFrame, id_col: str, text_col: str, bad: DataFrame) -> DataFrame:
    """Rows of digests that collide, grouped by their bytes."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("points"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    width = F.length("digest")
    rows = rows.join(bad, F.substring("sha", 1, width) == F.col("digest"), "left_semi")
    best = rows.groupBy("norm").agg(F.min(rank(F.col("points"), F.col("doc_id"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(best, "norm").select("doc_id", F.col("best.ident").alias("keep_id"), "group_size", "sha")


def dedup_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """One row for each row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest_bytes`` below 32 shortens the index's keys; results stay the same,
    as colliding groups are split by their bytes.
    """
    index, scratch = Index(df.sparkSession), Scratch(df.sparkSession)
    rows = scratch.put("rows", digests(df, id_col, text_col, digest_bytes))
    for batch in range(BATCHES):
        index.add(rows.where(F.pmod(F.xxhash64("digest", "doc_id"), F.lit(BATCHES)) == batch))
    repeats = index.write(index.compact().entries.where("n > 1"))
    # What the filter denies needs no join; what it lets through by chance finds no entry.
    tested = scratch.put("tested", repeats.tested(rows.select("doc_id", "sha", "digest")))
    members = tested.where("maybe").join(merged(repeats.entries), "digest", "left")
    own = F.col("best").isNull()
    members = members.select("doc_id", "sha", "digest", F.when(own, F.col("doc_id")).otherwise(F.col("best.ident")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"))
    members = scratch.put("members", members)
    alone = tested.where("NOT maybe")
    bad = scratch.put("collisions", mismatches(df, id_col, text_col, members))
    columns = ["doc_id", "keep_id", "group_size", "sha"]
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    found = members.select(*columns)
    if not bad.isEmpty():
        found = members.join(merged(bad), "digest", "left_anti").select(*columns).unionByName(regrouped(df, id_col, text_col, bad).select(*columns))
    index.drop(repeats, *index.runs())
    scratch.drop("rows")
    found = alone.select(*columns).unionByName(found)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha
  FROM documents),
w AS (
  SELECT doc_id, sha, first_value(doc_id) OVER (PARTITION BY sha ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY sha) AS group_size
  FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM w
"""
