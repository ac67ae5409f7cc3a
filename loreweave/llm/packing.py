"""Problem 6: packs of fixed capacity, filled along a space-filling curve.

Documents are ordered by the Hilbert key of their projected, hashed token vectors, cut into
range blocks of that order, and packed with their neighbours: a window of the curve at a
time, its largest items first, each into the fullest open pack that still takes it. A text
is cut only if it alone exceeds the capacity.

Packs that a block leaves with room are opened again: their items are packed once more in
fewer, larger blocks of the curve, level by level, until one block is left.

Null texts and texts without tokens are in no pack; repeated rows (same id) count once.
Each item is in exactly one pack of every capacity.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import task_count
from .tokens import token_sizes, tokenizer_path

#: Items of the curve that are packed together, and packs kept open from window to window: a small part of a block.
WINDOW, OPEN = 1024, 256
#: Items a range block holds at most, blocks whose rests are packed together, and the fill from which a pack is no rest.
BLOCK_ITEMS, MERGED, FULL = 50_000, 8, 0.995

COLUMNS = ["pack_name", "capacity_tokens", "pack_id", "item_no", "doc_id", "part_no", "start_pos", "end_pos", "n_tokens"]
SCHEMA = "pack_name string, capacity_tokens int, pack_id string, item_no int, doc_id bigint, part_no int, start_pos int, end_pos int, n_tokens int"
INNER = ["doc_id", "part_no", "start_pos", "end_pos", "n_tokens", "curve"]


class _Packer:
    """Best fit over the open packs of one capacity, kept in order of their room."""

    def __init__(self, name: str, capacity: int) -> None:
        self.name, self.capacity = name, capacity
        self.room: list[tuple[int, int]] = []  # (room left, pack), ascending
        self.packs: dict[int, list[tuple]] = {}
        self.made = 0

    def window(self, items: list[tuple]) -> Iterator[list[tuple]]:
        for item in sorted(items, key=lambda i: (-i[4], i[0], i[1])):
            need = item[4]
            k = bisect_left(self.room, (need, -1))
            if k < len(self.room):
                room, pack = self.room.pop(k)
            else:
                self.made += 1
                room, pack = self.capacity, self.made
                self.packs[pack] = []
            self.packs[pack].append(item)
            if room > need:
                insort(self.room, (room - need, pack))
            else:
                yield self.packs.pop(pack)
        while len(self.room) > OPEN:
            yield self.packs.pop(self.room.pop(0)[1])

    def rest(self) -> Iterator[list[tuple]]:
        yield from self.packs.values()
        self.packs, self.room = {}, []

    def rows(self, packs: Iterator[list[tuple]]) -> pd.DataFrame:
        out = []
        for pack in packs:
            name = f"{self.name}-{pack[0][0]}-{pack[0][1]}"
            loose = sum(item[4] for item in pack) < FULL * self.capacity
            out.extend((self.name, self.capacity, name, no, *item, loose) for no, item in enumerate(pack, 1))
        return pd.DataFrame(out, columns=[*COLUMNS[:4], *INNER, "loose"])


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    packer, waiting = None, []
    for pdf in batches:
        for name, capacity, *item in pdf[["pack_name", "capacity_tokens", *INNER]].itertuples(index=False, name=None):
            if packer is None or (packer.name, packer.capacity) != (name, capacity):
                if packer is not None:
                    yield packer.rows(packer.window(waiting))
                    yield packer.rows(packer.rest())
                packer, waiting = _Packer(name, capacity), []
            waiting.append(tuple(item))
            if len(waiting) >= WINDOW:
                yield packer.rows(packer.window(waiting))
                waiting = []
    if packer is not None:
        yield packer.rows(packer.window(waiting))
        yield packer.rows(packer.rest())


def pack_documents(docs: DataFrame, packs: DataFrame, tokenizer: str | None = None, block_items: int = BLOCK_ITEMS, blocks: int | None = None) -> DataFrame:
    """Every item of every capacity with its pack. ``packs`` is the small table of capacities (a row each)."""
    sizes = [(r["pack_name"], int(r["capacity_tokens"])) for r in packs.select("pack_name", "capacity_tokens").distinct().orderBy("pack_name").toLocalIterator() if r["capacity_tokens"]]
    if not sizes:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    measured = token_sizes(texts, tokenizer or tokenizer_path(), [c for _, c in sizes]).groupBy("doc_id").agg(
        *[F.first(c).alias(c) for c in ("n_tokens", "n_chars", "curve", "parts")]
    ).where("n_tokens > 0").checkpoint()
    wanted = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).alias("capacity_tokens")) for n, c in sizes])
    each = measured.select("*", F.explode(wanted).alias("w")).select("doc_id", "n_tokens", "n_chars", "curve", "parts", "w.*")
    whole = F.array(F.struct(F.col("capacity_tokens").alias("capacity"), F.lit(1).alias("part_no"), F.lit(0).alias("start_pos"), F.col("n_chars").alias("end_pos"), F.col("n_tokens").alias("n_tokens")))
    items = each.select(
        "pack_name", "capacity_tokens", "curve", "doc_id",
        F.explode(F.when(F.col("n_tokens") > F.col("capacity_tokens"), F.filter("parts", lambda p: p["capacity"] == F.col("capacity_tokens"))).otherwise(whole)).alias("p"),
    ).select("pack_name", "capacity_tokens", "curve", "doc_id", "p.part_no", "p.start_pos", "p.end_pos", "p.n_tokens")
    order = ["pack_name", "curve", "doc_id", "part_no"]
    schema = f"{SCHEMA}, curve bigint, loose boolean"
    n = max(blocks or task_count(docs.sparkSession), -(-measured.count() * len(sizes) // block_items))
    rest, done = items, []
    while True:
        placed = rest.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(_pack, schema)
        if n == 1:
            break
        placed = placed.checkpoint()  # read twice: packs that are full, and the rests
        done.append(placed.where("not loose"))
        rest, n = placed.where("loose"), -(-n // MERGED)
    return reduce(DataFrame.unionByName, [*done, placed]).select(*COLUMNS)


def pack_report(packed: DataFrame) -> DataFrame:
    """Per capacity: packs, items, tokens, and the share of the room that is filled."""
    return (
        packed.groupBy("pack_name", "capacity_tokens", "pack_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("i"))
        .groupBy("pack_name", "capacity_tokens")
        .agg(F.count("*").alias("packs"), F.sum("i").alias("items"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
        .withColumn("fill", F.round(F.col("tokens") / (F.col("packs") * F.col("capacity_tokens")), 6))
    )


def pack_check(packed: DataFrame) -> DataFrame:
    """Per capacity: texts and characters in packs, and packs over their capacity."""
    over = packed.groupBy("pack_name", "capacity_tokens", "pack_id").agg(F.sum("n_tokens").alias("t")).groupBy("pack_name").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("over"))
    held = packed.groupBy("pack_name", "doc_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("chars")).groupBy("pack_name").agg(F.count("*").alias("texts"), F.sum("chars").alias("chars"))
    return held.join(over, "pack_name").select("pack_name", "texts", "chars", "over")
