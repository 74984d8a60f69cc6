"""Exact duplicates by a cuckoo-filter index of live digests.

A digest's 16-bit fingerprint sits in one of two buckets (partial-key cuckoo hashing). A fingerprint hit is only a hint:
the full digest stored in the bucket confirms it, so no text is lost to a collision. Digests can be deleted again; an
index that overflows is rebuilt at twice the size from the digests it stores.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrift.llm.common import ascii_lower, documents, tidy, unused, whole, written

SLOTS, KICKS, FIRST_BUCKETS = 4, 200, 64
#: Rows for each shard of the index, some hundreds of bytes each.
SHARD = 1_000_000


class CuckooIndex:
    """Digest -> value, with membership by cuckoo filter and proof by the stored digest."""

    def __init__(self, buckets: int = FIRST_BUCKETS):
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets is a power of two")
        self.mask, self.size = buckets - 1, 0
        self.marks: list[list[int]] = [[] for _ in range(buckets)]
        self.stored: list[list[list]] = [[] for _ in range(buckets)]

    @staticmethod
    def _mark(digest: bytes) -> int:
        return int.from_bytes(digest[:2], "little") or 1

    def _homes(self, digest: bytes) -> tuple[int, int, int]:
        mark = self._mark(digest)
        home = int.from_bytes(digest[2:8], "little") & self.mask
        return mark, home, self._other(home, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def find(self, digest: bytes) -> list | None:
        """The live entry [digest, value], or None. A mark that agrees with another digest's is no hit."""
        mark, one, two = self._homes(digest)
        for bucket in (one, two):
            if mark in self.marks[bucket]:
                for entry in self.stored[bucket]:
                    if entry[0] == digest:
                        return entry
        return None

    def insert(self, digest: bytes, value: object) -> None:
        """Add a digest that isn't live."""
        entry = [digest, value]
        mark, one, two = self._homes(digest)
        bucket = one if len(self.marks[one]) <= len(self.marks[two]) else two
        for kick in range(KICKS):
            if len(self.marks[bucket]) < SLOTS:
                self.marks[bucket].append(mark)
                self.stored[bucket].append(entry)
                self.size += 1
                return
            slot = kick % SLOTS
            self.marks[bucket][slot], mark = mark, self.marks[bucket][slot]
            self.stored[bucket][slot], entry = entry, self.stored[bucket][slot]
            bucket = self._other(bucket, mark)
        self._grow(entry)

    def _grow(self, homeless: list) -> None:
        entries = [*self.entries(), homeless]
        self._clear(2 * (self.mask + 1))
        for digest, value in entries:
            self.insert(digest, value)

    def delete(self, digest: bytes) -> bool:
        """Forget a digest; False if it isn't live."""
        mark, one, two = self._homes(digest)
        for bucket in {one, two}:
            for slot, entry in enumerate(self.stored[bucket]):
                if entry[0] == digest:
                    del self.stored[bucket][slot], self.marks[bucket][slot]
                    self.size -= 1
                    return True
        return False

    def entries(self) -> Iterator[list]:
        for bucket in self.stored:
            yield from bucket


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each digest of a batch: so a digest that a third of all rows share travels once a batch."""
    for rows in batches:
        yield rows.groupby("digest", as_index=False, sort=False).agg(keep_id=("doc_id", "max"), group_size=("doc_id", "size"))


def _indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    index = CuckooIndex()
    for rows in batches:
        for digest, keep, size in zip(rows["digest"], rows["keep_id"], rows["group_size"], strict=True):
            digest, keep = bytes(digest), None if pd.isna(keep) else int(keep)
            entry = index.find(digest)
            if entry is None:
                index.insert(digest, (keep, int(size)))
            else:
                old, n = entry[1]
                entry[1] = (keep if old is None or keep is not None and keep > old else old, n + int(size))
    found = list(index.entries())
    for at in range(0, len(found), 10_000):
        part = found[at : at + 10_000]
        yield pd.DataFrame({"digest": [d for d, _ in part], "keep_id": pd.array([v[0] for _, v in part], dtype="Int64"),
                            "group_size": [v[1] for _, v in part]})


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with A-Z in lower case; a null text is the empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(ascii_lower(whole()), 256)).alias("digest"))


def copy_groups(rows: DataFrame) -> DataFrame:
    """Of rows (doc_id, digest): (digest, keep_id, group_size), a row for each digest.

    The row with the largest doc_id stays; null is smaller than any. Batches are counted before the shuffle, and each
    shard of digests has an index of its own, whose size is that of the shard's distinct digests: SHARD on average at
    most, as there are more shards than the session has partitions where the rows need them.
    """
    kind = "digest binary, keep_id long, group_size long"
    counted, needed = rows.mapInPandas(_counted, kind), -(-rows.count() // SHARD)
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.repartition("digest") if needed <= usual else counted.repartition(needed, "digest")
    return dealt.mapInPandas(_indexed, kind)


@tidy
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equal texts that stays.

    Empty and null texts are equal. A row that is repeated, id and text, is kept or dropped in all its places. The join
    has a row for each digest on one side, so Spark splits a digest that many rows share (AQE's skew join).
    """
    rows = written(digests(documents(spark, sf_dir)), "digests")
    groups = copy_groups(rows)
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without the copies: of equal texts the row with the largest doc_id stays, once.

    Rows that agree in id and text are told apart by nothing that matters; any one of them stays. Rows whose id is
    null stay only if no equal text has an id.
    """
    names = docs.columns
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    key = [unused(docs, "digest"), unused(docs, "place")]
    marked = docs.withColumns({key[0]: F.unhex(F.sha2(ascii_lower(whole()), 256)), key[1]: place})
    keep = copy_groups(digests(docs)).select(F.col("digest").alias(key[0]), F.coalesce("keep_id", F.lit(-(2**63))).alias(key[1]))
    # Both keys: a digest that many rows share is spread by its ids, and one exchange serves the join and what follows.
    return marked.join(keep, key, "left_semi").dropDuplicates(key).select(*names)


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
"""

QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLES = {"op6_exact_dedup": ORACLE}
