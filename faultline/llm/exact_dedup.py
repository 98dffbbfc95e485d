"""Exact duplicates with a heavy-hitter split (op2).

Texts are equal when identical, unchanged; null counts as empty.  Each text becomes its
SHA-256.  A Misra-Gries summary of ``counters`` entries per task, merged in a tree, holds every
digest that more than 1 / (counters + 1) of the rows share.  These candidates are counted
exactly; the verified winners (at most ``counters`` rows, whatever the data) are broadcast
and their copies are resolved map-side, so no reducer meets a hot digest.  All other
digests go through an ordinary shuffle: their groups are small by the summary's guarantee.

Defined results: the row with the largest ``doc_id`` of a group stays; rows that repeat both
id and text all refer to that id, and :func:`drop_copies` keeps one of them; null ids are smaller than all others;
null and empty texts form one group; an empty table gives an empty table; other columns do
not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import words
from faultline.session import broadcast_if_small, materialize

#: Entries of a Misra-Gries summary and so the most rows that are ever broadcast.
COUNTERS = 1024
#: Tasks of the middle level of the merge; the last one reads at most so many summaries.
MERGERS = 16


def _trim(table: pa.Table, counters: int) -> pa.Table:
    """Misra-Gries: subtract the (counters + 1)-th largest count and drop what is used up."""
    table = table.group_by("digest").aggregate([("n", "sum")]).rename_columns(["digest", "n"])
    if table.num_rows > counters:
        n = np.asarray(table["n"])
        less = np.partition(n, len(n) - counters - 1)[len(n) - counters - 1]
        table = table.set_column(1, "n", pa.array(n - less)).filter(pc.greater(pa.array(n), int(less)))
    return table


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.table({"digest": batch.column("digest"), "n": batch.column("n")})
            held = _trim(table if held is None else pa.concat_tables([held, table]), counters)
        if held is not None:
            yield from held.combine_chunks().to_batches()
    return run


def heavy_candidates(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests that may be frequent: all with more than rows / (counters + 1) rows, at most
    ``counters`` in all.  Input and output have ``digest`` and a weight ``n``."""
    words.prepare(digests.sparkSession)
    kind = "digest binary, n long"
    step = digests.select("digest", F.lit(1).cast("long").alias("n")).mapInArrow(_summaries(counters), kind)
    step = step.repartition(MERGERS).mapInArrow(_summaries(counters), kind)
    return step.repartition(1).mapInArrow(_summaries(counters), kind)


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = materialize(df.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("digest")), "digests")
    total = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    candidates = materialize(heavy_candidates(digests, counters).select("digest"), "heavy-candidates")
    winners = materialize(digests.join(F.broadcast(candidates), "digest").groupBy("digest").agg(*total)
                          .where("group_size > 1"), "heavy-winners")
    heavy = digests.join(F.broadcast(winners), "digest")
    light = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = light.groupBy("digest").agg(*total)
    rows = heavy.unionByName(light.join(groups, "digest"))
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                       F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``df`` without the rows that repeat another row's text; one row of each group stays."""
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    own, id_, sha = words.unused(df, "own_sha", "gone_id", "gone_sha")
    groups = materialize(exact_groups(df, doc_id, text, counters).where("group_size > 1"), "copies")
    keys = [F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)]
    gone = materialize(groups.where("not kept").select(*keys).distinct(), "copies-gone")
    same = F.col(doc_id).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(sha))
    rest = df.withColumn(own, digest).join(broadcast_if_small(gone), same, "left_anti")
    # a kept row may be there twice, with the same id: of such twins one stays
    twins = materialize(groups.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").select(*keys), "twins")
    if twins.take(1):
        once = rest.join(broadcast_if_small(twins), same, "left_semi").dropDuplicates([doc_id, own])
        rest = rest.join(broadcast_if_small(twins), same, "left_anti").unionByName(once)
    return rest.drop(own)
