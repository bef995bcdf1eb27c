"""How often every distinct term occurs and in how many records.

Last-seen counters: occurrences are partitioned by a hash of the term, ordered by
term and record, and streamed past counters that hold only the occurrences, the
records and the last record seen. No set of records exists anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a term's records. A term with a third of all rows is counted by so many tasks.
SALTS = 32
# Blanks that may stand at a term's ends (white space of the Unicode standard, zero-width space, byte-order mark).
BLANKS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def term_key(term: Column) -> Column:
    """The term in lower case, without blanks at its ends."""
    return F.lower(F.regexp_replace(term, f"^{BLANKS}|{BLANKS}$", ""))


def _last_seen(batches):
    """Counters over batches sorted by (term, record): one row per term of the partition.

    A batch's runs of equal terms are found with array comparisons; only the last
    term's counters and last record pass from batch to batch.
    """
    held = None  # [term, seen, survived, records, last record]
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy(zero_copy_only=False)
        rec = b.column(1)
        none = rec.is_null().to_numpy(zero_copy_only=False)
        rec = pc.fill_null(rec, 0).to_numpy(zero_copy_only=False)
        seen = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        surv = b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
        new_term = np.ones(len(keys), bool)
        new_term[1:] = keys[1:] != keys[:-1]
        new_rec = new_term.copy()
        new_rec[1:] |= rec[1:] != rec[:-1]
        new_rec &= ~none
        # nulls sort first, so the record before the first one that is not null counts as another
        new_rec[1:] |= ~none[1:] & none[:-1]
        if held is not None and held[0] == keys[0] and not none[0] and held[4] is not None and held[4] == rec[0]:
            new_rec[0] = False
        at = np.flatnonzero(new_term)
        last = np.append(at[1:], len(keys)) - 1
        rows = [[keys[i], s, v, r, None if none[j] else rec[j]] for i, j, s, v, r in zip(at, last, np.add.reduceat(seen, at).tolist(), np.add.reduceat(surv, at).tolist(), np.add.reduceat(new_rec.astype(np.int64), at).tolist())]
        if held is not None:
            if held[0] == rows[0][0]:
                rows[0] = [held[0], held[1] + rows[0][1], held[2] + rows[0][2], held[3] + rows[0][3], rows[0][4] if rows[0][4] is not None else held[4]]
            else:
                rows.insert(0, held)
        held = rows.pop()
        if rows:
            yield _batch(rows)
    if held is not None:
        yield _batch([held])


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3))], names=["term_key", "seen", "survived", "records"])


def term_frequency(df: DataFrame, key: Column, record: Column, seen: Column, survived: Column, salts: int = SALTS) -> DataFrame:
    """(term_key, seen, survived, records) of every distinct key, exact.

    Rows with a null key are left out. A null count adds nothing; a null record adds to
    the counts but is no record. Repeated rows count each time; deduplicate before.
    Columns of ``df`` clash with nothing, only the four expressions are read. Each key's
    records are spread over ``salts`` tasks by the record's hash, so the record counts of the
    parts add up and a hot key meets no single task; the parts are summed at the end.
    """
    rows = df.select(key.alias("k"), record.cast("bigint").alias("r"), F.coalesce(seen.cast("bigint"), F.lit(0)).alias("s"), F.coalesce(survived.cast("bigint"), F.lit(0)).alias("v")).where("k is not null")
    parts = rows.repartition(F.col("k"), F.pmod(F.xxhash64("r"), F.lit(salts))).sortWithinPartitions("k", "r")
    each = parts.mapInArrow(_last_seen, "term_key string, seen bigint, survived bigint, records bigint")
    return each.groupBy("term_key").agg(F.sum("seen").alias("seen"), F.sum("survived").alias("survived"), F.sum("records").alias("records"))


def mark(freq: DataFrame, records: DataFrame, rare_most: int = 2, common_share: float = 0.05) -> DataFrame:
    """``freq`` with a ``mark``: 'rare' if seen at most ``rare_most`` times in all, else 'common' if
    in more than ``common_share`` of all records, else null. ``records`` has one row, column ``n``;
    with no record at all no term is common."""
    most = records.agg(F.max("n")).scalar() * common_share
    return freq.withColumn("mark", F.when(F.col("seen") <= rare_most, "rare").when(F.col("records") > most, "common"))


def dedupe(df: DataFrame, key: str) -> DataFrame:
    """One row per value of ``key``, each of a redelivery's rows being equal but for the time of loading.
    Rows with a null key stay, as nothing says that they are the same."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(df.where(F.col(key).isNull()))
