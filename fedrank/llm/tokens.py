"""Token counts, encoding and decoding with a byte-level BPE vocabulary file."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, lexicon, ragged

#: Bytes of text whose equal pieces are looked up once.
PIECE_BLOCK = ragged.BLOCK_BYTES


def distinct_pieces(block: ragged.Block) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Starts of the block's pieces, the distinct ones' bytes, and the number of each piece's."""
    starts, ends = ragged.chunks(block.data, block.offs)
    rep, inv = ragged.fold(block.data, starts, ends)
    raw = block.data.tobytes()
    return starts, [raw[a:b] for a, b in zip(starts[rep].tolist(), ends[rep].tolist(), strict=True)], inv


def token_ids(block: ragged.Block, coder: bpe.PieceCache) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the block's texts, flat, and how many each text has."""
    starts, pieces, inv = distinct_pieces(block)
    flat, start, length = coder.get(pieces)
    return ragged.gather(flat, start[inv], length[inv]), ragged.by_text(starts, block.offs, length[inv])


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Tokens of every text, by rank-synchronous merging of ragged pre-token arrays.

    Returns ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens).
    Null and empty texts have 0 bytes and tokens.  A map without a shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.cache(path, "merge")
        for block in ragged.blocks(batches, PIECE_BLOCK):
            starts, pieces, inv = distinct_pieces(block)
            _, _, length = coder.get(pieces)
            n = ragged.by_text(starts, block.offs, length[inv])
            yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(np.diff(block.offs)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return ragged.documents(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def frequent_pieces(docs: DataFrame, size: int, block_count: int = 8, longest: int = 64) -> list[bytes]:
    """The ``size`` most frequent pieces of the corpus, counted where they come ``block_count`` times in a block of 1 MB.

    At most ``size`` rows reach the driver.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in ragged.blocks(batches, PIECE_BLOCK):
            _, pieces, inv = distinct_pieces(block)
            n = np.bincount(inv, minlength=len(pieces))
            keep = [k for k in np.flatnonzero(n >= block_count).tolist() if len(pieces[k]) <= longest]
            yield pa.RecordBatch.from_arrays([pa.array([pieces[k] for k in keep], pa.binary()), pa.array(n[keep].astype(np.int64))], ["piece", "n"])

    counted = ragged.documents(docs).mapInArrow(run, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [bytes(r.piece) for r in counted.orderBy(F.desc("n"), "piece").limit(size).collect()]


def encode(docs: DataFrame, path: str, lexicon_size: int = 32768, decoded: bool = False) -> DataFrame:
    """Token ids of every text, from a minimal acyclic transducer of frequent words and exact merging of all others.

    The lexicon holds the corpus's ``lexicon_size`` most frequent words (a fixed size; it only saves work, as words that
    it lacks are merged with the same result) and is memory-mapped on each executor.  A special token's text gives its id.
    Returns ``doc_id, ids array<int>``, with ``decoded`` also ``text``, decoded from the ids in the same pass.  Null and
    empty texts have an empty array.
    """
    docs = ragged.documents(docs)
    words = frequent_pieces(docs, lexicon_size)
    name = lexicon.share(docs.sparkSession.sparkContext, lexicon.compile_lexicon(words, *bpe.merger(path).encode(words)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, coder = lexicon.opened(name), bpe.cache(path, "merge")
        known_ids = known.ids.astype(np.int32)
        for block in ragged.blocks(batches):
            starts, ends = ragged.chunks(block.data, block.offs)
            rep, inv = ragged.fold(block.data, starts, ends)
            a, z = starts[rep], ends[rep]
            place = known.place(block.data, a, z - a)
            rest = np.flatnonzero(place < 0)
            raw = block.data.tobytes()
            flat, start, length = coder.get([raw[x:y] for x, y in zip(a[rest].tolist(), z[rest].tolist(), strict=True)])
            at, n = np.empty(len(rep), np.int64), np.empty(len(rep), np.int64)
            found = np.flatnonzero(place >= 0)
            at[found], n[found] = known.start[place[found]], known.len[place[found]]
            at[rest], n[rest] = start + len(known_ids), length
            ids = ragged.gather(np.concatenate([known_ids, flat]), at[inv], n[inv])
            counts = ragged.by_text(starts, block.offs, n[inv])
            offs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            cols = [pa.array(block.ids), pa.ListArray.from_arrays(pa.array(offs), pa.array(ids))]
            if decoded:
                cols.append(pa.array(decode_ids(path, ids, counts), pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "text"][: len(cols)])

    return docs.mapInArrow(run, "doc_id long, ids array<int>" + ", text string" * decoded)


@functools.lru_cache(maxsize=2)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every id's bytes, flat, where they start and how many they are."""
    table = bpe.merger(path).bytes_of
    size = np.array([len(b) for b in table])
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(size) - size, size


def decode_ids(path: str, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """Texts of flat ids, ``counts`` of them each; U+FFFD stands for what is no UTF-8."""
    flat, start, size = byte_table(path)
    size = size[ids]
    raw = ragged.gather(flat, start[ids], size).tobytes()
    cut = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [raw[x:y].decode("utf-8", "replace") for x, y in zip(cut[:-1], cut[1:], strict=True)]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Texts of ``doc_id, ids``, as ``doc_id, text``.  Null or empty ids give an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                ids = part.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                n = pc.list_value_length(part.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(decode_ids(path, ids, n), pa.string())], ["doc_id", "text"])

    full = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return full.mapInArrow(run, "doc_id long, text string")
