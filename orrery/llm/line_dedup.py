r"""Line dedup by a deletion-neighbourhood join.

Lines (cut at "\n") are compared with white space ``[\x20\x09-\x0D]`` trimmed and
runs of it as one space. A line goes if an earlier one, by (identifier, line number), is
the same, and one of ``min_chars`` or more characters also if an earlier one is within one
edit (one character put in, taken out or replaced): in short lines one edit makes
another word. Blank lines stay.

1. Lines are digested where they are read. Equal digests: all but the earliest go.
2. Two lines within one edit agree on all but one of any ``m`` blocks that both
   are cut into. Each distinct line emits its variants with one block deleted
   as hashed keys; lines that share none have no partner and stop here. With 2 blocks
   this leaves few lines, whose texts are then fetched; with 8 fewer still.
3. The rest emit every variant with one character deleted, and themselves, as
   hashed keys with the place of the deletion. Lines that meet on a key and place
   differ there only, so each is compared with the earliest of its key and place;
   a line that is another's variant is compared with that line. No pairs within a
   key are enumerated.
4. Partners are verified by edit distance on the texts.

A line's partner need not stay itself. Edge cases: null counts as empty; texts
of which no line stays become empty, their rows stay; null identifiers come after
all others; rows with one identifier count as one text where their lines agree;
an empty table gives no rows; other columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.shared import Scratch, lean, merged, released, sliced, table

#: Least length for the near join.
MIN_CHARS = 16
SPACES = re.compile(r"[\x20\x09-\x0D]+")
#: Two primes below 2^31: variant hashes have 62 bits.
PRIMES, BASES = (2147483647, 2147483629), (1000003, 69069)

LINES = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), *[(f"k{i}", pa.int64()) for i in range(4)]])
TEXTS = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("line", pa.string())])
VARIANTS = pa.schema([("v", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("line_no", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def normal(line: str) -> str:
    if "  " in line or "\t" in line or "\r" in line or "\x0b" in line or "\x0c" in line:
        line = SPACES.sub(" ", line)
    return line.strip(" ")


def digest(line: str) -> tuple[int, int]:
    raw = hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def block_keys(line: str, m: int) -> list[int]:
    """Hashes of the line without one of m blocks, cut as for its own length and as for one less."""
    n, found = len(line), set()
    for size in (n, n - 1):
        cuts = [j * size // m for j in range(m + 1)]
        for j in range(m):
            rest = f"{size}:{j}:{line[: cuts[j]]}\0{line[n - (size - cuts[j + 1]) :]}"
            found.add(hashlib.blake2b(rest.encode("utf-8", "surrogatepass"), digest_size=8).digest())
    return [int.from_bytes(k, "little", signed=True) for k in found]


def rows_of(batches: Iterator[pa.RecordBatch], schema: pa.Schema, make) -> Iterator[pa.RecordBatch]:
    """Output in batches of bounded size; ``make`` gives the rows of an input row."""
    released()
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(k) for k in range(batch.num_columns)), strict=True):
            for out in make(*(x.as_py() for x in row)):
                rows.append(out)
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
    del rows
    released()


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """Lines that take part: place, digest and keys with one of two blocks deleted (null for lines too short for the near join)."""
    short = (None,) * 4

    def make(doc_id, text):
        for k, line in enumerate((text or "").split("\n")):
            if line and (line := normal(line)):
                keys = sorted(block_keys(line, 2)) if len(line) >= min_chars else ()
                yield doc_id, k, *digest(line), *(*keys, *short)[:4]

    return docs.mapInArrow(lambda batches: rows_of(batches, LINES, make), ddl(LINES))


def place(doc_id: str = "doc_id", line_no: str = "line_no") -> Column:
    """Sorts by identifier, nulls last, then by line."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.col(line_no).alias("line_no"))


#: The same order as one number, which a hash aggregate can hold.
PLACE = "coalesce(CAST(doc_id AS DECIMAL(20,0)) * 2147483648BD + line_no, 100000000000000000000000000000BD + line_no)"


def place_parts(at: str) -> list[Column]:
    """doc_id and line_no of such a number."""
    line_no = f"CAST(pmod({at}, 2147483648BD) AS BIGINT)"
    doc_id = f"CASE WHEN {at} < 100000000000000000000000000000BD THEN ({at} - {line_no}) DIV 2147483648BD END"
    null_line = f"CASE WHEN {at} < 100000000000000000000000000000BD THEN CAST({line_no} AS INT) ELSE CAST({at} - 100000000000000000000000000000BD AS INT) END"
    return [F.expr(doc_id).alias("doc_id"), F.expr(null_line).alias("line_no")]


def sharing(keyed: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Digests (h1) of lines that share a key with another line. keyed: key, h1; read twice, so that a frequent key is summed before its rows meet."""
    shared = keyed.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a != b").select("key")
    return scratch.put(name, keyed.join(merged(scratch.put("keys", shared)), "key", "left_semi").select("h1").distinct())


def variants_of(texts: DataFrame) -> DataFrame:
    """Each line's hash (place -1) and those of the line without one character, vectorised over a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_id, line_no, h1, h2, line = (batch.column(k)[row].as_py() for k in range(5))
                codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
                n, whole = len(codes), []
                for prime, base in zip(PRIMES, BASES, strict=True):
                    p, powers = np.uint64(prime), power_table(base, prime, n)
                    at = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers % p, dtype=np.uint64) % p])
                    after = np.concatenate([np.cumsum((codes[1:] * powers[:-1] % p)[::-1], dtype=np.uint64)[::-1] % p, np.zeros(1, np.uint64)])
                    whole.append((at[-1], (at[:-1] + after) % p))
                v = np.empty(n + 1, np.int64)
                v[0] = int(whole[0][0]) << 31 | int(whole[1][0])
                v[1:] = (whole[0][1].astype(np.int64) << 31) | whole[1][1].astype(np.int64)
                fill = lambda x, t: pa.array([x] * (n + 1), t)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(np.arange(-1, n, dtype=np.int32)), fill(doc_id, pa.int64()), fill(line_no, pa.int32()), fill(h1, pa.int64()), fill(h2, pa.int64())], schema=VARIANTS)

    return texts.mapInArrow(run, ddl(VARIANTS))


_powers: dict[tuple[int, int], np.ndarray] = {}


def power_table(base: int, prime: int, n: int) -> np.ndarray:
    held = _powers.get((base, prime))
    if held is None or len(held) < n:
        size, out = max(1024, 2 * n), [1]
        for _ in range(size - 1):
            out.append(out[-1] * base % prime)
        held = _powers[(base, prime)] = np.array(out, np.uint64)
    return held[:n]


def near(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Digests of lines with an earlier line within one edit. texts: as TEXTS, one row for each distinct line."""

    def eight(_, __, h1, ___, line):
        for key in block_keys(line, 8):
            yield key, h1

    keys = pa.schema([("key", pa.int64()), ("h1", pa.int64())])
    shared = sharing(texts.mapInArrow(lambda b: rows_of(b, keys, eight), ddl(keys)), scratch, "eighths")
    texts = scratch.put("near", texts.join(merged(shared), "h1", "left_semi").select(*TEXTS.names))
    line = F.struct(place().alias("at"), F.col("h1"), F.col("h2"))
    variants = scratch.put("variants", variants_of(texts).select("v", "place", line.alias("line")))
    cut = variants.where("place >= 0")
    least = scratch.put("least", cut.groupBy("v", "place").agg(F.min("line").alias("other")))
    by_place = cut.join(merged(least), ["v", "place"])
    uncut = variants.where("place < 0").select("v", F.col("line").alias("other"))
    longer = cut.join(merged(uncut), "v")
    shorter = uncut.select("v", F.col("other").alias("line")).join(merged(least.select("v", "other")), "v")
    pairs = None
    for found in (by_place, longer, shorter):
        found = found.where("other.at < line.at").select(*[F.col(f"{s}.{h}").alias(f"{s}_{h}") for s in ("line", "other") for h in ("h1", "h2")])
        pairs = found if pairs is None else pairs.unionByName(found)
    one = lambda s: merged(texts.select(F.col("h1").alias(f"{s}_h1"), F.col("h2").alias(f"{s}_h2"), F.col("line").alias(f"{s}_text")))
    pairs = pairs.distinct().join(one("line"), ["line_h1", "line_h2"]).join(one("other"), ["other_h1", "other_h2"])
    apart = F.levenshtein(F.col("line_text"), F.col("other_text"), 1)
    found = scratch.put("gone", pairs.where(apart.between(0, 1)).select(F.col("line_h1").alias("h1"), F.col("line_h2").alias("h2")).distinct())
    scratch.drop("eighths", "near", "variants", "least")
    return found


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, exact and near: the numbers of the lines that go, for each text that loses any."""
    scratch = Scratch(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines = scratch.put("lines", lines_of(docs, min_chars))
    keys = [f"k{i}" for i in range(4)]
    # One row for each distinct line, summed before rows meet: a frequent line is no hot key from here on.
    firsts = lines.groupBy("h1", "h2").agg(F.min(F.expr(PLACE)).alias("at"), F.max(F.expr(PLACE)).alias("end"), *[F.min(k).alias(k) for k in keys])
    firsts = scratch.put("firsts", firsts)
    close = sharing(firsts.select(F.explode(F.array(*keys)).alias("key"), "h1").where("key IS NOT NULL"), scratch, "halves")
    wanted = firsts.where("k0 IS NOT NULL").join(merged(close), "h1", "left_semi").select("h1", "h2", *place_parts("at"))
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "h1", "h2")).alias("wanted"))

    def pick(doc_id, text, wanted):
        found = (text or "").split("\n")
        for w in wanted:
            # Rows that share an identifier may hold other lines.
            if w["line_no"] < len(found) and digest(line := normal(found[w["line_no"]])) == (w["h1"], w["h2"]):
                yield doc_id, w["line_no"], w["h1"], w["h2"], line

    same = F.col("doc_id").eqNullSafe(F.col("w_id"))
    texts = docs.join(merged(wanted.withColumnRenamed("doc_id", "w_id")), same).select("doc_id", "text", "wanted")
    texts = scratch.put("close", texts.mapInArrow(lambda b: rows_of(b, TEXTS, pick), ddl(TEXTS)).dropDuplicates(["h1", "h2"]))
    repeats = scratch.put("repeats", firsts.where("at != end").select("h1", "h2", "at"))
    scratch.drop("keys", "halves", "firsts")
    gone = near(texts, scratch)
    lines = lines.select("h1", "h2", "doc_id", "line_no")
    exact = lines.join(merged(repeats), ["h1", "h2"]).where(F.expr(PLACE) != F.col("at")).select("doc_id", "line_no", F.lit(0).alias("kind"))
    close = lines.join(merged(gone), ["h1", "h2"]).select("doc_id", "line_no", F.lit(1).alias("kind"))
    each = exact.unionByName(close).groupBy("doc_id", "line_no").agg(F.min("kind").alias("kind"))
    of = lambda k: F.collect_list(F.when(F.col("kind") == k, F.col("line_no")))
    found = scratch.put("dropped", each.groupBy("doc_id").agg(of(0).alias("exact"), of(1).alias("near")))
    scratch.drop(*[n for n in scratch.paths if n != "dropped"])
    return found


def with_dropped(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    gone = dropped_lines(df, id_col, text_col, min_chars)
    gone = gone.select(F.col("doc_id").alias("__gone_id"), F.col("exact").alias("__exact"), F.col("near").alias("__near"))
    return df.join(merged(gone), F.col(id_col).cast("long").eqNullSafe(F.col("__gone_id")), "left")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``df`` with the lines that go taken out of ``text_col``; all rows and columns stay."""
    joined = with_dropped(df, id_col, text_col, min_chars).select(*[F.col(f"`{c}`") for c in df.columns], "__exact", "__near")
    at = df.columns.index(text_col)

    def strip(text, exact, close):
        if not exact and not close:
            return text
        gone = {*(exact or ()), *(close or ())}
        return "\n".join(x for k, x in enumerate((text or "").split("\n")) if k not in gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1024):
            n = batch.num_columns - 2
            texts = [strip(*x) for x in zip(*(batch.column(k).to_pylist() for k in (at, n, n + 1)), strict=True)]
            columns = [batch.column(k) if k != at else pa.array(texts, batch.schema.field(at).type) for k in range(n)]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(k) for k in range(n)]))

    return joined.mapInArrow(lean(run), df.schema)


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents without repeated lines; n_chars follows the text."""
    found = dedup_lines(docs)
    return found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_exact and n_near (lines that go), and the digest of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = with_dropped(docs, "doc_id", "text", MIN_CHARS)
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_exact", pa.int64()), ("n_near", pa.int64()), ("kept_sha256", pa.string())])

    def make(doc_id, text, exact, close):
        lines, gone = (text or "").split("\n"), {*(exact or ()), *(close or ())}
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text or ""
        yield doc_id, len(lines), len(exact or ()), len(close or ()), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()

    return joined.select("doc_id", "text", "__exact", "__near").mapInArrow(lambda b: rows_of(b, schema, make), ddl(schema))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no
  FROM documents),
n AS (SELECT *, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM l),
f AS (SELECT line, min((doc_id, line_no)) AS first_at, length(line) AS k FROM n WHERE line <> '' GROUP BY line),
h AS (
  SELECT line, k, first_at, s, substr(line, 1, (s - 1) // 2) AS a, substr(line, k - (s - 1) // 2 + 1) AS b
  FROM (SELECT *, k AS s FROM f WHERE k >= 16 UNION ALL SELECT *, k - 1 AS s FROM f WHERE k >= 16)),
c AS (
  SELECT x.line AS x, y.line AS y FROM h x JOIN h y ON x.s = y.s AND x.a = y.a AND abs(x.k - y.k) <= 1 AND y.first_at < x.first_at
  UNION
  SELECT x.line AS x, y.line AS y FROM h x JOIN h y ON x.s = y.s AND x.b = y.b AND abs(x.k - y.k) <= 1 AND y.first_at < x.first_at),
z AS (
  SELECT DISTINCT x FROM c
  WHERE len(list_filter(range(1, greatest(length(x), length(y)) + 1), lambda i:
    CASE WHEN length(x) = length(y) THEN substr(x, 1, i - 1) = substr(y, 1, i - 1) AND substr(x, i + 1) = substr(y, i + 1)
         WHEN length(x) > length(y) THEN substr(x, 1, i - 1) || substr(x, i + 1) = y
         ELSE substr(y, 1, i - 1) || substr(y, i + 1) = x END)) > 0),
d AS (
  SELECT n.doc_id, n.line_no, n.raw, coalesce(f.first_at <> (n.doc_id, n.line_no), FALSE) AS exact, z.x IS NOT NULL AS near
  FROM n LEFT JOIN f ON n.line = f.line LEFT JOIN z ON n.line = z.x)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near AND NOT exact) AS n_near,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT exact AND NOT near), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
