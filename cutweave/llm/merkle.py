"""Merkle fixity audit of WARC record stores.

Records are hashed, and the hashes of ordered offset ranges are hashed again,
FAN children at a time, first within a file, then over the files. Two
replicas are compared at their roots; where these differ, only the children
of differing nodes are looked at, level by level, down to the records.

A leaf is the records of one id, which are neighbours in their file; so two
replicas that were packed apart have the same leaves, whatever the offsets.

Everything is JVM-side. No node has more than FAN children, and a leaf's
records are summed up where they are read, so no task ever gathers more than
that at once, whatever the size of a file or store.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutweave.llm.common import materialize

FAN = 16
#: Page ids that share a WARC file.
FILE_IDS = 1000


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.1 response record of a page; nulls count as empty."""
    html = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )


def stored(pages: DataFrame) -> DataFrame:
    """Pages as records: page_id, file_no, record.

    File: floor(page_id / 1000); pages without id go by their URL's CRC-32
    to one of 1024 files numbered below 0.
    """
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    no_id = -1 - F.pmod(F.crc32(F.coalesce(F.col("url"), F.lit(""))), F.lit(1024))
    file_no = F.coalesce(F.floor(F.col("page_id") / FILE_IDS), no_id).cast("bigint")
    return pages.select("page_id", file_no.alias("file_no"), record.alias("record"))


def placed(records: DataFrame) -> DataFrame:
    """Records, or what is known of them, with rec_offset in their file.

    Records (page_id, file_no, rec_length, digest) stand in order of page_id,
    then of their bytes' hash; repeated pages are records of their own. The
    sums are two-level: a window holds the records of one id whose hashes
    begin alike, and another the totals of a file's ids.
    """
    head = F.substring("digest", 1, 2)
    sums = records.groupBy("file_no", "page_id", head.alias("__head")).agg(F.sum("rec_length").alias("__sum"))
    over = Window.partitionBy("file_no").orderBy("page_id", "__head").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("file_no").alias("__file"), F.col("page_id").alias("__page"), F.col("__head").alias("__of"), F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__base"))
    inner = Window.partitionBy("file_no", "page_id", "__head").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    out = records.withColumn("__head", head).withColumn("__in", F.coalesce(F.sum("rec_length").over(inner), F.lit(0)))
    out = out.join(sums, (F.col("file_no") == F.col("__file")) & F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("__head") == F.col("__of")))
    return out.withColumn("rec_offset", F.col("__base") + F.col("__in")).select(*records.columns, "rec_offset")


def pack(pages: DataFrame) -> DataFrame:
    """Pages as records of WARC files: page_id, file_no, rec_offset, rec_length, record."""
    out = stored(pages).withColumn("rec_length", F.octet_length("record").cast("bigint"))
    return placed(out.withColumn("digest", F.sha2("record", 256))).drop("digest")


def hashed(records: DataFrame) -> DataFrame:
    """page_id, file_no, rec_offset, rec_length, digest, and the leaf (node)
    of the file that the record belongs to, which its id alone decides: so a
    record that was lost, or changed its length, moves no other to another
    leaf. Records that come without their bytes bring their digest."""
    digest = F.sha2("record", 256) if "record" in records.columns else F.col("digest")
    node = F.coalesce(F.pmod(F.col("page_id"), F.lit(FILE_IDS)), F.lit(0)).cast("bigint")
    return records.select("page_id", "file_no", "rec_offset", "rec_length", digest.alias("digest"), node.alias("node"))


@dataclass
class Trees:
    """levels[0]: leaves of all replicas; levels[-1]: one root each. Columns:
    replica, file_no, node, first, last (offsets that the node spans), digest."""

    levels: list[DataFrame]
    shape: list[tuple[str, int]]  # of each level above the leaves: "node" or "file", which FAN divides, and the least file below


def parent(what: str, least: int) -> tuple[Column, Column]:
    """file_no and node of the node above."""
    if what == "node":
        return F.col("file_no"), F.floor(F.col("node") / FAN).cast("bigint")
    return F.floor((F.col("file_no") - F.lit(least)) / FAN).cast("bigint"), F.col("node")


def multiset_digest() -> Column:
    """SHA-256 of the number of records and of the sums of their hashes' four
    words: the order makes no difference, and an id whose records are very
    many is summed up before the shuffle."""
    words = [F.sum(F.conv(F.substring("digest", 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *words), 256)


def build(replicas: dict[str, DataFrame]) -> Trees:
    """Trees over each replica's hashed records."""
    parts = [r.withColumn("replica", F.lit(name)) for name, r in replicas.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    base = rows.groupBy("replica", "file_no", "node").agg(F.min("rec_offset").alias("first"), F.max(F.col("rec_offset") + F.col("rec_length")).alias("last"), multiset_digest().alias("digest"))
    levels, shape = [materialize(base, "merkle-0")], []
    while True:
        top = levels[-1].agg(F.max("node").alias("n"), F.min("file_no").alias("lo"), F.max("file_no").alias("hi")).first()
        if top["n"] is None or (top["n"] == 0 and top["lo"] == top["hi"]):
            return Trees(levels, shape)
        what = "node" if top["n"] > 0 else "file"
        file_no, node = parent(what, top["lo"])
        child = F.struct("file_no", "node", "digest")
        up = levels[-1].select("replica", file_no.alias("f"), node.alias("n"), "first", "last", child.alias("c"))
        up = up.groupBy("replica", "f", "n").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.array_sort(F.collect_list("c")).alias("cs"))
        text = F.concat_ws("\n", F.transform("cs", lambda c: F.concat_ws(":", c["file_no"].cast("string"), c["node"].cast("string"), c["digest"])))
        up = up.select("replica", F.col("f").alias("file_no"), F.col("n").alias("node"), "first", "last", F.sha2(text, 256).alias("digest"))
        levels.append(materialize(up, f"merkle-{len(levels)}"))
        shape.append((what, top["lo"]))


def differing(trees: Trees, a: str, b: str) -> DataFrame:
    """Leaves in which two replicas differ: file_no, node."""

    def compared(level: DataFrame) -> DataFrame:
        cell = lambda name: F.max(F.when(F.col("replica") == name, F.col("digest")))
        both = level.groupBy("file_no", "node").agg(cell(a).alias("x"), cell(b).alias("y"))
        return both.filter(~F.col("x").eqNullSafe(F.col("y"))).select("file_no", "node")

    bad = compared(trees.levels[-1])
    for depth in range(len(trees.levels) - 2, -1, -1):
        f, n = parent(*trees.shape[depth])
        parents = bad.select(F.col("file_no").alias("pf"), F.col("node").alias("pn"))
        below = trees.levels[depth].withColumn("pf", f).withColumn("pn", n).join(parents, ["pf", "pn"], "left_semi")
        bad = materialize(compared(below), "merkle-bad")
        if bad.isEmpty():
            break
    return bad


def leftover(bad: DataFrame, own: DataFrame, other: DataFrame, tag: str) -> DataFrame:
    """Records of differing leaves that the other replica does not have as
    often, numbered within their id: id_rank. Of equal records the last ones."""
    key = ["file_no", "page_id", "digest"]
    mine = own.join(bad, ["file_no", "node"], "left_semi")
    n = other.join(bad, ["file_no", "node"], "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("n_other"))
    nulls = (mine["file_no"] == n["file_no"]) & mine["page_id"].eqNullSafe(n["page_id"]) & (mine["digest"] == n["digest"])
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("rec_offset"))
    left = mine.join(n, nulls, "left").select(mine["*"], F.coalesce("n_other", F.lit(0)).alias("n_other")).withColumn("copy", rank).filter("copy > n_other")
    left = left.withColumn("id_rank", F.row_number().over(Window.partitionBy("file_no", "page_id").orderBy("rec_offset", "digest")))
    return left.select(*[F.col(c).alias(f"{c}_{tag}") for c in ("page_id", "file_no", "rec_offset", "rec_length", "digest", "id_rank")])


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """Records that a replica has altered or lost, or has in addition.

    Both: page_id, file_no, rec_offset, rec_length, and record or digest (its
    SHA-256, where the store was hashed in place); other columns are not read.
    Returns page_id, file_no, rec_offset, rec_length, status (altered, missing
    or extra), digest_a, digest_b. Offsets are each store's own: where a
    replica lost a record, or holds one of another length, the records after
    it have moved there, which is no fault. Place and length are the
    original's; of extra records the replica's.

    Records are held against those of their id. An id may have several, equal
    ones too: those that both have are equal, of the others the first of one
    are the altered ones of the other, and the rest is missing or extra. Null
    ids are an id of each file. Equal replicas, and empty ones, give no rows.
    Records of any length count as one SHA-256 each.
    """
    a, b = hashed(records), hashed(replica)
    bad = differing(build({"a": a, "b": b}), "a", "b")
    x, y = leftover(bad, a, b, "a"), leftover(bad, b, a, "b")
    same = (F.col("file_no_a") == F.col("file_no_b")) & F.col("page_id_a").eqNullSafe(F.col("page_id_b")) & (F.col("id_rank_a") == F.col("id_rank_b"))
    both = x.join(y, same, "full_outer")
    here = F.col("digest_a").isNotNull()
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("altered")
    of = [F.when(here, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(c) for c in ("page_id", "file_no", "rec_offset", "rec_length")]
    return both.select(*of, status.alias("status"), "digest_a", "digest_b")
