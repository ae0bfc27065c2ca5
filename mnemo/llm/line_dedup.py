"""Line dedup by content-defined chunks, in DataFrame and SQL functions only.

A rolling polynomial hash runs over the hashes of a document's lines; a line
whose value is a local minimum ends a chunk.  Boundaries depend on the nearby
lines alone, so text inserted elsewhere doesn't move them, and two minima are
never adjacent, so inner chunks have two lines at least.  A chunk of several
lines that occurs again anywhere, byte for byte, is kept at its first place
(smallest doc_id, then chunk number) and removed everywhere else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import stage

#: Parameters of the rolling hash over three lines: base, its square modulo the prime, the prime.
PRIME = 2147483647
BASE = 1000003
BASE2 = BASE * BASE % PRIME
#: Repeated hashes, removed chunks, and bytes of repeated chunks that are broadcast at most; beyond, joins shuffle.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 16 << 20


def let(value: str, name: str, body: str) -> str:
    """SQL that computes ``value`` once and names it in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def chunks_sql(text: str) -> str:
    """array<struct<no, n_lines, body>> of a text column, in order; null for a null text."""
    line_hashes = "transform(ls, l -> cast(conv(substr(md5(l), 1, 7), 16, 10) AS bigint))"
    rolled = (f"transform(hs, (x, i) -> (coalesce(get(hs, i - 2), 0L) * {BASE2}L % {PRIME}L"
              f" + coalesce(get(hs, i - 1), 0L) * {BASE}L % {PRIME}L + x) % {PRIME}L)")
    ends = ("filter(sequence(1, size(rs)), i -> i = size(rs)"
            " OR (i > 1 AND get(rs, i - 1) < get(rs, i - 2) AND get(rs, i - 1) <= get(rs, i)))")
    rows = ("transform(es, (e, k) -> named_struct('no', k, 'n_lines', e - coalesce(get(es, k - 1), 0),"
            " 'body', array_join(slice(ls, coalesce(get(es, k - 1), 0) + 1, e - coalesce(get(es, k - 1), 0)), '\\n')))")
    return let(f"split({text}, '\\n')", "ls", let(line_hashes, "hs", let(rolled, "rs", let(ends, "es", rows))))


def line_dedup(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove repeated multi-line chunks from all documents.

    Returns one row per input row: id, the text without removed chunks, the columns
    named in ``keep``, ``n_lines`` and ``n_removed`` (lines).  A null text stays null
    with 0 lines, an empty text is one empty line; a text whose every chunk is
    removed becomes empty.  Of equal chunks the one with the smallest id (null first)
    and chunk number stays, so rows that repeat an id and a text are treated alike.
    Chunks of one line or of white space alone always stay.  An empty table gives an
    empty result; columns not named are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("version"),
                       F.struct(*[F.col(c) for c in keep]).alias("rest") if keep else F.lit(None).alias("rest"))
    chunks = (rows.select("id", "version", F.inline(F.expr(chunks_sql("text"))))
              .where("n_lines > 1 AND trim(body) <> ''").withColumn("hash", F.xxhash64("body")))
    place = F.struct("id", "no")

    # hashes seen at two places, from the hashes alone; their chunks' bytes are then compared
    repeated = stage(chunks.groupBy("hash").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b OR a.id IS NULL").select("hash"), "repeated-hashes")
    few = repeated.count() <= BROADCAST_ROWS
    again = stage(chunks.join(F.broadcast(repeated) if few else repeated, "hash").select("id", "version", "no", "hash", "body"), "repeated-chunks")
    first = stage(again.groupBy("body").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min("hash").alias("hash"))
                  .where(~F.col("first").eqNullSafe(F.col("last"))), "first-chunks")
    n, size = first.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
    kept = F.broadcast(first) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else first
    same = [again["hash"] == kept["hash"], again["body"] == kept["body"]]
    # rows that repeat an id are told apart by their texts
    gone = stage(again.join(kept, same).where(~F.struct(again["id"], again["no"]).eqNullSafe(F.col("first")))
                 .groupBy(again["id"].alias("gone_id"), again["version"].alias("gone_version")).agg(F.collect_set(again["no"]).alias("gone")), "removed-chunks")
    removed = gone.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0]

    of_row = [rows["id"].eqNullSafe(F.col("gone_id")), rows["version"] == F.col("gone_version")]
    done = rows.join(F.broadcast(gone) if removed <= BROADCAST_ROWS else gone, of_row, "left")
    left = let(chunks_sql("text"), "cs", "transform(array_except(sequence(0, size(cs) - 1), gone), k -> get(cs, k))")
    done = done.withColumn("left", F.when(F.col("gone").isNotNull(), F.expr(left)))
    kept_text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.expr("array_join(transform(left, c -> c.body), '\\n')"))
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(lines)
    kept_lines = F.when(F.col("gone").isNull(), lines).otherwise(F.expr("aggregate(left, 0, (n, c) -> n + c.n_lines)"))
    return done.select(F.col("id").alias(id_col), kept_text.alias(text_col), *[F.col("rest")[c].alias(c) for c in keep or []],
                       lines.cast("long").alias("n_lines"), (lines - kept_lines).cast("long").alias("n_removed"))


LINE_DEDUP_SQL = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
h AS (SELECT *, list_transform(ls, lambda l: ('0x' || substr(md5(l), 1, 7))::BIGINT) AS hs FROM d),
r AS (SELECT *, list_transform(range(1, len(hs) + 1), lambda i:
        ((CASE WHEN i > 2 THEN hs[i - 2] ELSE 0 END) * {BASE2} % {PRIME}
         + (CASE WHEN i > 1 THEN hs[i - 1] ELSE 0 END) * {BASE} % {PRIME} + hs[i]) % {PRIME}) AS rs FROM h),
e AS (SELECT *, list_filter(range(1, len(rs) + 1), lambda i:
        i = len(rs) OR (i > 1 AND rs[i] < rs[CASE WHEN i > 1 THEN i - 1 ELSE 1 END] AND rs[i] <= rs[i + 1])) AS es FROM r),
c AS (SELECT doc_id, unnest(range(1, len(es) + 1)) AS no, es, ls FROM e WHERE text IS NOT NULL),
k AS (SELECT doc_id, no, es[no] - (CASE WHEN no > 1 THEN es[no - 1] ELSE 0 END) AS n_lines,
        array_to_string(ls[(CASE WHEN no > 1 THEN es[no - 1] ELSE 0 END) + 1 : es[no]], chr(10)) AS body FROM c),
m AS (SELECT *, n_lines > 1 AND trim(body) <> ''
        AND row_number() OVER (PARTITION BY body, n_lines > 1 ORDER BY doc_id, no) > 1 AS gone FROM k),
g AS (SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS text,
        sum(n_lines)::BIGINT AS n_lines, sum(CASE WHEN gone THEN n_lines ELSE 0 END)::BIGINT AS n_removed FROM m GROUP BY doc_id)
SELECT doc_id, g.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents LEFT JOIN g USING (doc_id)
"""
