"""Merkle fixity audit of WARC replicas: record digests, digests of ordered ranges above them, and a descent into what differs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import stored

#: Slots of records in one WARC file, and children of a node; FILE_SLOTS is a power of FAN.
FILE_SLOTS = 4096
FAN = 16
LEVELS = 3
#: Files of records without an id.
NULL_FILES = 1024


def records(pages: DataFrame) -> DataFrame:
    """file, slot, record, offset, length, digest of each page as a WARC response record.

    A file takes FILE_SLOTS consecutive ids, in the order of the ids (rows with equal ids share a slot, in the order of
    their digests); offset is where the record starts in its file. Null ids fill files -1 to -NULL_FILES, file and slot
    by the digest. Null url and html are empty. Other columns of pages are ignored.
    """
    html, url = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("html", "url"))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    record = F.concat(head, html, F.lit("\r\n\r\n"))
    rows = pages.select(F.col("page_id").cast("long").alias("record"), F.octet_length(record).cast("long").alias("length"), F.sha2(record.cast("binary"), 256).alias("digest"))
    place = F.pmod(F.xxhash64("digest"), F.lit(NULL_FILES * FILE_SLOTS))
    file = F.coalesce(F.floor(F.col("record") / FILE_SLOTS), -1 - F.floor(place / FILE_SLOTS))
    rows = rows.select(file.cast("long").alias("file"), F.pmod(F.coalesce("record", place), F.lit(FILE_SLOTS)).cast("long").alias("slot"), "record", "length", "digest")
    before = Window.partitionBy("file").orderBy("slot", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("file", "slot", "record", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "digest")


def tree(leaves: DataFrame, name: str) -> list[DataFrame]:
    """Nodes (file, node, start, end, digest) of each level, records' slots first, a file's root last; each level a stored table.

    A slot's digest is over its records' ids, lengths and digests (equal ones counted before they meet), a node's over its
    children's places, the lengths of the offset ranges that they cover (start to end) and their digests, in order. So a
    record under another id, or in another place, shows up to the root.
    """
    over = lambda *of: F.sha2(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct(*of))), lambda x: F.to_json(x))).cast("binary"), 256).alias("digest")
    size = (F.col("end") - F.col("start")).alias("size")
    copies = leaves.groupBy("file", "slot", "record", "length", "digest").agg(F.count("*").alias("n"), F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"))
    level = copies.groupBy("file", F.col("slot").alias("node")).agg(F.min("start").alias("start"), F.max("end").alias("end"), over("record", "length", "digest", "n"))
    out = [stored(level, f"{name}-0")]
    for i in range(LEVELS):
        level = out[-1].groupBy("file", F.floor(F.col("node") / FAN).cast("long").alias("up")).agg(F.min("start").alias("start"), F.max("end").alias("end"), over("node", size, "digest"))
        out.append(stored(level.withColumnRenamed("up", "node"), f"{name}-{i + 1}"))
    return out


def differing(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """(file, node) of the slots whose digests differ, found from the roots down: a level is read only below differing nodes,
    and not at all if there are none. Each level's differing nodes are a stored table."""
    found = None
    for left, right in zip(reversed(a), reversed(b), strict=True):
        if found is not None:
            up = found.withColumnRenamed("node", "up")
            left, right = (x.withColumn("up", F.floor(F.col("node") / FAN).cast("long")).join(up, ["file", "up"], "left_semi") for x in (left, right))
        both = left.select("file", "node", F.col("digest").alias("l")).join(right.select("file", "node", F.col("digest").alias("r")), ["file", "node"], "full")
        found = stored(both.where(~F.col("l").eqNullSafe(F.col("r"))).select("file", "node"), "warc-differing")
        if found.isEmpty():
            return found
    return found


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """file, record, offset, length, digest, replica_digest, status of every record that is not the same in both.

    offset and length are those in the primary, or in the replica if the record is only there. status: `changed`,
    `missing` (not in the replica) or `extra` (only in the replica). Records with equal ids are paired in the order of
    their digests. Equal inputs, and empty ones: no rows.
    """
    left, right = stored(records(primary), "warc-primary"), stored(records(replica), "warc-replica")
    slots = differing(tree(left, "warc-primary"), tree(right, "warc-replica")).withColumnRenamed("node", "slot")
    rank = F.row_number().over(Window.partitionBy("file", "slot", "record").orderBy("digest"))
    left, right = (x.join(slots, ["file", "slot"], "left_semi").withColumn("i", rank) for x in (left, right))
    l, r = (x.select(*(F.col(c).alias(f"{c}_{k}") for c in x.columns)) for x, k in ((left, "l"), (right, "r")))
    on = [F.col(f"{c}_l").eqNullSafe(F.col(f"{c}_r")) for c in ("file", "slot", "record", "i")]
    both = l.join(r, reduce(lambda x, y: x & y, on), "full").where(~F.col("digest_l").eqNullSafe(F.col("digest_r")))
    status = F.when(F.col("digest_r").isNull(), "missing").when(F.col("digest_l").isNull(), "extra").otherwise("changed")
    pick = lambda c: F.coalesce(f"{c}_l", f"{c}_r").alias(c)
    return both.select(pick("file"), pick("record"), pick("offset"), pick("length"), F.col("digest_l").alias("digest"), F.col("digest_r").alias("replica_digest"), status.alias("status"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of pages as a failing disk would leave it: some records changed, some lost, by fixed arithmetic on the id."""
    changed = F.col("page_id") * 7919 % 53 == 11
    return pages.where("NOT coalesce(page_id * 104729 % 331 = 5, false)").withColumn("html", F.when(changed, F.concat(F.substring("html", 1, 40), F.lit("�"), F.expr("substring(html, 42)"))).otherwise(F.col("html")))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, url, CASE WHEN page_id * 7919 % 53 = 11 THEN substring(html, 1, 40) || chr(65533) || substring(html, 42) ELSE html END AS html FROM p WHERE NOT coalesce(page_id * 104729 % 331 = 5, false)),
r AS (SELECT k, page_id AS record, page_id // {FILE_SLOTS} AS file, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS body
  FROM (SELECT 'l' AS k, * FROM p UNION ALL SELECT 'r', * FROM q)),
s AS (SELECT k, file, record, strlen(body) AS length, sha256(body) AS digest, sum(strlen(body)) OVER (PARTITION BY k, file ORDER BY record) - strlen(body) AS "offset" FROM r)
SELECT l.file::BIGINT AS file, l.record AS record, l."offset"::BIGINT AS "offset", l.length::BIGINT AS length, l.digest AS digest, r.digest AS replica_digest,
  CASE WHEN r.digest IS NULL THEN 'missing' ELSE 'changed' END AS status
FROM (SELECT * FROM s WHERE k = 'l') l LEFT JOIN (SELECT * FROM s WHERE k = 'r') r ON l.record = r.record WHERE l.digest IS DISTINCT FROM r.digest
"""
