"""Problem 8: texts packed into containers of fixed capacity by minimum bin slack.

Texts are measured in tokens; one longer than a container is cut into full containers and a remainder. Every shard of
texts packs its own containers: while texts are left, the longest opens a container, and a subset-sum dynamic program
over the lengths still there, kept as bits of one integer, finds the fullest combination beside it, which is removed.

A shard is a hash range of texts (about ``shard_items`` each), so no task grows with the data, and only the last
container of a shard is likely to have slack.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch
from . import arrow

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of the byte_bpe vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for b in arrow.slices(batches, "text"):
            n = [len(encode(x)) if x else 0 for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], ["id", "tokens"])

    return run


def fill(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of every item, by minimum bin slack; every length is in 1..capacity."""
    order = np.argsort(-lengths, kind="stable")
    waiting: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        waiting.setdefault(int(lengths[i]), []).append(i)
    sizes = sorted(waiting, reverse=True)
    out, container, left = np.zeros(len(lengths), np.int64), 0, len(lengths)
    while left:
        while not waiting[sizes[0]]:
            sizes.pop(0)
        first = sizes[0]
        out[waiting[first].pop()] = container
        left -= 1
        room = capacity - first
        if room and left:
            # bit s of reach: a combination of the items seen so far has the sum s
            mask, reach, steps = (1 << (room + 1)) - 1, 1, []
            full = 1 << room
            for s in sizes:
                n = len(waiting[s]) if s <= room else 0
                part = 1
                while n > 0:  # 1, 2, 4, ... copies of a length: every number of copies can be formed
                    take = min(part, n)
                    if take * s > room:
                        take = room // s
                        if not take:
                            break
                        n = take
                    new = reach | (reach << (take * s)) & mask
                    if new != reach:
                        steps.append((reach, s, take))
                        reach = new
                    n -= take
                    part *= 2
                if reach & full:
                    break
            goal = reach.bit_length() - 1
            for before, s, take in reversed(steps):
                if not before >> goal & 1:
                    for _ in range(take):
                        out[waiting[s].pop()] = container
                    left -= take
                    goal -= take * s
        container += 1
    return out


def _pack(capacity: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        lengths = table["tokens"].to_numpy()
        return table.append_column("container", pa.array(fill(lengths, capacity)))

    return run


def pack(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
    vocabulary: str = VOCABULARY, shard_items: int = 20_000,
) -> DataFrame:
    """``(id, piece, first_token, tokens, container_id)``: every text once, whole, in a container; a text of more than
    ``capacity`` tokens as consecutive pieces, all but the last of ``capacity`` tokens.

    A null or empty text needs no room: it comes out as one piece of 0 tokens with a null container. Rows are packed
    as they come, repeated ids too. Rows with a null id are packed like others.
    """
    scratch = Scratch(documents.sparkSession, "packing")
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sizes = rows.mapInArrow(_count(vocabulary), f"id {kind}, tokens int")
    sizes = scratch.save(sizes.withColumn("row", F.monotonically_increasing_id()), "sizes")
    none = sizes.filter("tokens = 0").selectExpr("id", "0 as piece", "0L as first_token", "0 as tokens", "cast(null as string) as container_id")
    pieces = sizes.filter("tokens > 0").selectExpr(
        "id", "row", "tokens as whole", f"posexplode(sequence(0L, cast(tokens - 1 as bigint), {capacity}L)) as (piece, first_token)"
    )
    pieces = pieces.selectExpr("id", "row", "piece", "first_token", f"cast(least({capacity}L, whole - first_token) as int) as tokens")
    full = pieces.filter(f"tokens = {capacity}").selectExpr("id", "piece", "first_token", "tokens", "concat('full-', row, '-', piece) as container_id")
    rest = pieces.filter(f"tokens < {capacity}")
    shards = max(1, -(-rest.count() // shard_items))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    schema = f"id {kind}, row long, piece int, first_token long, tokens int, shard int, container long"
    packed = rest.groupBy("shard").applyInArrow(_pack(capacity), schema)
    packed = packed.selectExpr("id", "piece", "first_token", "tokens", "concat(shard, '-', container) as container_id")
    return packed.unionByName(full).unionByName(none)
