"""Sharding over a fixed number of virtual slots."""

from __future__ import annotations

import heapq
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandframe.plans.session import shared_dir

SLOTS = 4096
PARTS = 32
#: A text is hot from this part of a shard's share of the bytes on.
HOT = 64


@dataclass(frozen=True)
class SlotMap:
    """A version of the map from cells to shards.

    A cell is ``slot * parts + part``. The slots by hash hold texts by hash, all in part 0; each slot after them holds
    the copies of one hot text, dealt over its parts. A slot moves as a whole unless it alone holds more
    than a shard's share; only then, and only copies of one text, do its parts move one by one.
    """

    version: int
    n_shards: int
    slots: int
    parts: int
    shard: list[int]
    rows: list[int]
    bytes: list[int]

    def starts(self) -> list[int]:
        """The first position of each cell within its shard."""
        at = [0] * self.n_shards
        out = []
        for s, n in zip(self.shard, self.rows, strict=True):
            out.append(at[s])
            at[s] += n
        return out

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for s, b in zip(self.shard, self.bytes, strict=True):
            out[s] += b
        return out

    def _units(self) -> list[list[int]]:
        """Cells that move together, those of most bytes first; cells without rows are left out."""
        share, units = sum(self.bytes) / max(1, self.n_shards), []
        for s in range(self.slots):
            own = [c for c in range(s * self.parts, (s + 1) * self.parts) if self.rows[c]]
            units += [own] if self._load(own) <= share else [[c] for c in own]
        return sorted(filter(None, units), key=lambda u: (-self._load(u), u))

    def _load(self, cells: list[int]) -> int:
        return sum(self.bytes[c] for c in cells)


def _size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def hot_texts(df: DataFrame, n_shards: int, text_col: str = "text") -> list[int]:
    """Hashes of texts whose copies hold more than one ``HOT``-th of a shard's share of the bytes: fewer than ``HOT`` times the shards."""
    by_text = df.groupBy(F.xxhash64(text_col).alias("h")).agg(F.sum(_size(F.col(text_col))).alias("b"), F.count("*").alias("n"))
    top = by_text.where("n > 1").orderBy(F.desc("b"), "h").limit(n_shards * HOT).collect()
    total = df.agg(F.sum(_size(F.col(text_col)))).first()[0] or 0
    return [r.h for r in top if r.b * n_shards * HOT > total]


def cells(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, parts: int = PARTS, hot: list[int] | None = None) -> DataFrame:
    """Per row: ``id, size, text_crc32, vslot, part``.

    The slot comes from the text, so equal texts share a slot; a text whose
    hash is in ``hot`` has a slot of its own, in which its copies are spread over the parts by id. A null text counts as no
    bytes and hashes alike everywhere; rows alike in id and text share a cell.
    """
    text, row_id = F.col(text_col), F.col(id_col)
    h = F.xxhash64(text)
    slot, part = F.pmod(h, F.lit(slots)), F.lit(0)
    if hot:
        slot = F.when(h.isin(hot), F.array_position(F.array(*map(F.lit, hot)), h) + (slots - 1)).otherwise(slot)
        part = F.when(h.isin(hot), F.pmod(F.xxhash64(row_id), F.lit(parts))).otherwise(part)
    return df.select(
        row_id.alias("doc_id"), _size(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        slot.cast("int").alias("vslot"), part.cast("int").alias("part"),
    )


def plan(placed: DataFrame, n_shards: int, slots: int = SLOTS, parts: int = PARTS) -> SlotMap:
    """Version 1 of the map: rows and bytes of each cell, heaviest units first to the lightest shard.

    The aggregate has at most ``slots * parts`` rows whatever the input, and is all that
    reaches the driver.
    """
    rows, size = [0] * (slots * parts), [0] * (slots * parts)
    for r in placed.groupBy("vslot", "part").agg(F.count("*").alias("n"), F.sum("size").alias("b")).toLocalIterator():
        rows[r.vslot * parts + r.part], size[r.vslot * parts + r.part] = r.n, r.b
    shard = [0] * (slots * parts)
    heap = [(0, s) for s in range(n_shards)]
    empty = SlotMap(1, n_shards, slots, parts, shard, rows, size)
    for unit in empty._units():
        load, s = heapq.heappop(heap)
        for c in unit:
            shard[c] = s
        heapq.heappush(heap, (load + empty._load(unit), s))
    return SlotMap(1, n_shards, slots, parts, shard, rows, size)


def rebalance(old: SlotMap, n_shards: int) -> SlotMap:
    """The next version for ``n_shards``: an edit that moves as few slots as it can.

    Slots leave shards that hold more than the new share and go to the added shards, or
    leave removed shards for the lightest ones; every other entry stays.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    share = sum(old.bytes) / n_shards
    shard, load, loose = [s if s < n_shards else 0 for s in old.shard], [0.0] * n_shards, []
    for unit in SlotMap(old.version, n_shards, old.slots, old.parts, old.shard, old.rows, old.bytes)._units():
        s, b = old.shard[unit[0]], old._load(unit)
        if s < n_shards and load[s] + b <= share and len({old.shard[c] for c in unit}) == 1:
            load[s] += b
        else:
            loose.append(unit)
    added = range(old.n_shards, n_shards) or range(n_shards)
    for unit in loose:
        s = min(added, key=lambda k: (load[k], k))
        load[s] += old._load(unit)
        for c in unit:
            shard[c] = s
    return SlotMap(old.version + 1, n_shards, old.slots, old.parts, shard, old.rows, old.bytes)


def map_table(spark: SparkSession, m: SlotMap) -> DataFrame:
    """The map as rows: ``n_shards, cell, vslot, part, shard, start, rows, bytes``."""
    cols = {"shard": m.shard, "start": m.starts(), "rows": m.rows, "bytes": m.bytes}
    one = spark.range(1).select(*(_numbers(v).alias(k) for k, v in cols.items()))
    return one.select(F.posexplode(F.arrays_zip(*cols)).alias("cell", "x")).select(
        F.lit(m.n_shards).alias("n_shards"), "cell",
        F.expr(f"cast(cell div {m.parts} as int)").alias("vslot"), (F.col("cell") % m.parts).alias("part"),
        F.col("x.shard").cast("int").alias("shard"), "x.start", "x.rows", "x.bytes",
    )


def store(spark: SparkSession, m: SlotMap, path: str | None = None) -> str:
    """Write a version of the map beside the versions before it, never over one. Returns the path of all versions."""
    path = path or f"{shared_dir(spark)}/strandframe/slot-map-{uuid.uuid4().hex}"
    map_table(spark, m).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={m.version}")
    return path


def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version of the map, the last by default."""
    if version is None:
        version = spark.read.parquet(path).agg(F.max("version")).first()[0]
    rows = spark.read.parquet(f"{path}/version={version}").orderBy("cell").collect()
    return SlotMap(version, rows[0].n_shards, rows[-1].vslot + 1, rows[-1].part + 1, [r.shard for r in rows], [r.rows for r in rows], [r.bytes for r in rows])


def _numbers(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def assign(placed: DataFrame, m: SlotMap, by: list[str] | None = None) -> DataFrame:
    """Adds ``shard`` and ``slot``: the row's gapless position, from 0, within its shard.

    The map is a literal of fixed size, looked up without a join. Positions are counted
    within cells, of which the slots have thousands, and start where the cell starts.
    """
    cell = F.col("vslot") * m.parts + F.col("part")
    rank = F.row_number().over(Window.partitionBy("vslot", "part").orderBy(*(by or ["doc_id", "text_crc32", "size"])))
    return placed.withColumn("shard", F.get(_numbers(m.shard), cell).cast("int")).withColumn("slot", (F.get(_numbers(m.starts()), cell) + rank - 1).cast("long"))


def shard(df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, parts: int = PARTS, store_path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Put every row into one of ``n_shards`` shards of near equal bytes; returns rows and map.

    Rows come back as ``doc_id, size, text_crc32, vslot, part, shard, slot``; repeated rows
    each get a place, nulls and empty texts have size 1, an empty table gives no rows, other
    columns of ``df`` are ignored. Equal texts stay in one shard unless they alone exceed
    a shard's share of the bytes. Rows are numbered within cells, of which a hot text has ``parts``.
    """
    hot = hot_texts(df, n_shards, text_col)
    placed = cells(df, id_col, text_col, slots, parts, hot)
    m = plan(placed, n_shards, slots + len(hot), parts)
    store(df.sparkSession, m, store_path)
    return assign(placed, m), m
