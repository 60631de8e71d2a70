"""Exact duplicates by a log-structured index of digests.  DataFrame operations only.

* *Memtable and flush*: each scan task's rows, as (digest, doc_id), sorted by digest, become one run: a Parquet file.
* *Filters*: a digest has a place in a bitmap of 16 bits or more for each row.  Entries of all runs are counted by place, a
  run's own ones folded before, and places with one entry are clear in the filter.
* *Compaction*: a run's entry is probed in the filter.  Where the place is clear no other entry has the digest, so the row is
  alone and never moves; the others merge by digest into one entry with the smallest and the largest identifier and the
  number of rows.
* *Verification*: digests with several rows are hits; their texts are compared byte by byte, by grouping on digest and
  text.  Should different texts share a digest, each text is a group of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ragged, shared


#: Bits of the filter for each row, at least, and of a piece of it.
BITS_A_ROW, PIECE = 16, 32768
#: Pieces of 4 KB of the filter that are broadcast at most; a larger filter is joined piece by piece.
BROADCAST_PIECES = 2048


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def flush(docs: DataFrame, normalised: Column) -> DataFrame:
    """Writes the sorted digest runs of all documents; returns ``digest, doc_id``."""
    return shared.stored(docs.select(digest(normalised).alias("digest"), "doc_id").sortWithinPartitions("digest", "doc_id"), "runs", {})


def place(bits: int) -> Column:
    """A digest's place in a filter of ``bits``."""
    return F.pmod(F.xxhash64("digest"), F.lit(bits))


def filters(runs: DataFrame, bits: int) -> DataFrame:
    """Pieces of the filter: ``piece, seen``, a bitmap of the places that several entries share.  Pieces without any are left out."""
    shared_ = runs.groupBy(place(bits).alias("place")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return shared_.groupBy(F.floor(F.col("place") / PIECE).alias("piece")).agg(F.bitmap_construct_agg(F.col("place") % PIECE).alias("seen"))


def probe(runs: DataFrame, pieces: DataFrame, bits: int, n_pieces: int) -> DataFrame:
    """``runs`` with ``again``: whether another entry may have the digest.  Never wrongly false."""
    placed = runs.withColumn("place", place(bits)).withColumn("piece", F.floor(F.col("place") / PIECE))
    joined = placed.join(F.broadcast(pieces) if n_pieces <= BROADCAST_PIECES else pieces, "piece", "left")
    bit = F.col("place") % PIECE
    byte = F.conv(F.hex(F.substr("seen", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_ = F.floor(F.col("byte") / F.pow(F.lit(2), bit % 8)) % 2 == 1
    return joined.withColumn("byte", byte).select("digest", "doc_id", F.coalesce(set_, F.lit(False)).alias("again"))


def compact(runs: DataFrame) -> DataFrame:
    """One entry for each digest: ``digest, first_id, last_id, n``."""
    return runs.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n"))


def verified(docs: DataFrame, normalised: Column, hits: DataFrame, hot: DataFrame, n_hits: int) -> DataFrame:
    """Hits, with their texts compared byte by byte: ``digest, texts, first_id, last_id, n``, where texts is how many differ.

    Copies fold within each task before the last shuffle, so a hot text costs a row a task.
    """
    keyed = docs.select("doc_id", normalised.alias("text"), digest(normalised).alias("digest"))
    if n_hits <= shared.BROADCAST_ROWS:
        found = keyed.join(F.broadcast(hits.select("digest")), "digest", "left_semi")
    else:
        found = shared.join_salted(keyed, hits.select("digest"), "digest", hot, F.col("doc_id"), "inner")
    groups = found.groupBy("digest", "text").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n"))
    return groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("n").alias("n"))


def exact_groups(docs: DataFrame, normalised: Column | None = None, keep: str = "last") -> DataFrame:
    """Groups of documents whose normalised texts are equal byte for byte.

    ``normalised`` is an expression over ``text`` (default: the text unchanged); ``keep`` says which identifier stays,
    ``first`` or ``last``.  Returns a row for each input row: ``doc_id, keep_id, group_size, kept, text_sha256``.  Null texts
    count as empty, so all empty texts are one group.  A row that is there twice counts twice in ``group_size``.
    """
    docs = ragged.documents(docs)
    normalised = F.col("text") if normalised is None else normalised
    runs = flush(docs, normalised)
    n_rows = runs.count()
    bits = max(PIECE, 1 << (BITS_A_ROW * n_rows - 1).bit_length())
    pieces = shared.stored(filters(runs, bits), "filter", {})
    probed = shared.stored(probe(runs, pieces, bits, pieces.count()), "probed", {})
    entries = shared.stored(compact(probed.where("again")).where(F.col("n") > 1), "entries")
    n_hits = entries.count()
    hot = shared.hot_keys(entries, "digest", "n", n_rows)
    checked = shared.stored(verified(docs, normalised, entries, hot, n_hits), "verified")
    shared.drop(runs, pieces)
    kept = F.col("first_id" if keep == "first" else "last_id")
    whole = checked.where(F.col("texts") == 1).select("digest", kept.alias("keep_id"), F.col("n").alias("group_size"))
    torn = checked.where(F.col("texts") > 1).select("digest")
    alone = probed.where("NOT again").select("digest", "doc_id", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    merged = probed.where("again").select("digest", "doc_id")
    if torn.isEmpty():
        rows = merged
    else:  # different texts with one digest: these rows are grouped by their texts
        keyed = docs.select("doc_id", normalised.alias("text"), digest(normalised).alias("digest")).join(torn, "digest", "left_semi")
        groups = keyed.groupBy("digest", "text").agg((F.min if keep == "first" else F.max)("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        apart = keyed.join(groups, ["digest", "text"]).select("digest", "doc_id", "keep_id", "group_size")
        rows = merged.join(torn, "digest", "left_anti")
    if n_hits <= shared.BROADCAST_ROWS:
        joined = rows.join(F.broadcast(whole), "digest", "left")
    else:
        joined = shared.join_salted(rows, whole, "digest", hot, F.col("doc_id"))
    joined = alone.unionByName(joined) if rows is merged else alone.unionByName(joined).unionByName(apart)
    keep_id = F.coalesce("keep_id", "doc_id")
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("doc_id") == keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, normalised: Column | None = None, keep: str = "last") -> DataFrame:
    """The rows of ``docs``, all columns, that exact_groups() keeps.  Of rows with one doc_id one stays; rows without go."""
    groups = shared.stored(exact_groups(docs, normalised, keep), "groups", {})
    left = shared.without(docs, groups.where(~F.col("kept")))
    again = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return left if again.isEmpty() else left.dropDuplicates(["doc_id"])
