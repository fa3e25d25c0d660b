"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has 64 bits; a bit is set if it is set in over half of the
XXH64 values (seed 42) of the text's word shingles.  Distinct fingerprints are
ordered by population count and dealt into cells of even size.  Two
fingerprints within the radius differ in population count by at most the
radius, so only pairs of cells whose ranges are that near meet, each pair in a
task of its own.  Inside a pair, tiles ordered by the population counts of
the four 16-bit words are skipped by the same argument; tiles that remain are
compared exactly with exclusive-or and bit counts.

A pair of cells returns a spanning forest of the links found, not all pairs,
so a large group of near copies costs one link per member.  Equal fingerprints
are one node.  Components are contracted in Spark.

Defined results: a null or wordless text has fingerprint zero, which links
like any other; fewer words than a shingle make one shingle; repeated rows are
each returned; an empty table gives no rows; a component of rows without ids
has a null id.  The comparison is exact and so grows with the square of the
number of distinct fingerprints, divided by what the population counts exclude.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.llm.common import map_texts, need_columns, ship, stored, text_of
from strataspark.llm.components import components

SEED = 42
TILE = 256
# Links held before they are folded into the forest.
BUFFER = 1 << 18
# Fingerprints of a cell at most: a task holds two cells, whatever the number of all fingerprints.
MOST_CELL = 1 << 18


def fingerprint(text: str, width: int) -> int:
    """The fingerprint of a text as an unsigned number; A-Z count as a-z."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(s) for s in zip(*(words[i:] for i in range(width)))] or [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``docs`` with ``row``, a key of its own for each row, and ``fingerprint``, the 64 bits as a signed number.

    The result is stored: the keys are drawn once.
    """
    need_columns(docs, "doc_id", "text")
    own = [c for c in docs.columns if c not in ("row", "fingerprint")]
    rows = docs.select(*own, F.monotonically_increasing_id().alias("row"), text_of().alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema)

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.array([fingerprint(t, width) for t in piece.column(piece.num_columns - 1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(bits.view(np.int64))], names=[*piece.schema.names[:-1], "fingerprint"])

    return stored(map_texts(rows, run, f"{schema}, fingerprint long", "_text", limit=2 << 20), "fingerprints")


class Forest:
    """Components of links that arrive in large arrays; every node knows its smallest member."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        new = self.label[a] != self.label[b]
        if new.any():
            self.held.append((a[new], b[new]))
            self.size += int(new.sum())
            if self.size > BUFFER:
                self.fold()

    def fold(self) -> None:
        if not self.held:
            return
        a, b = (np.concatenate(x) for x in zip(*self.held))
        label = self.label
        while len(a):
            a, b = label[a], label[b]
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label = jumped
        self.label, self.held, self.size = label, [], 0


def _words16(bits: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit words of each fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(bits).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _tiles(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints in tile order, and least and greatest word counts of each tile."""
    counts = _words16(bits)
    order = np.lexsort(counts.T[::-1])
    bits, counts = bits[order], counts[order]
    starts = np.arange(0, len(bits), TILE)
    return bits, np.minimum.reduceat(counts, starts), np.maximum.reduceat(counts, starts)


def forest_of(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span all pairs within the radius, of one set (right is None) or between two."""
    a, a_least, a_most = _tiles(left)
    b, b_least, b_most = (a, a_least, a_most) if right is None else _tiles(right)
    shift = 0 if right is None else len(a)
    forest = Forest(len(a) + (0 if right is None else len(b)))
    for i in range(len(a_least)):
        gap = np.maximum(b_least - a_most[i], a_least[i] - b_most).clip(0).sum(1)
        near = np.flatnonzero(gap <= radius)
        block = a[i * TILE : (i + 1) * TILE]
        for j in near[near >= i] if right is None else near:
            other = b[j * TILE : (j + 1) * TILE]
            x, y = np.nonzero(np.bitwise_count(block[:, None] ^ other[None, :]) <= radius)
            if len(x):
                forest.add(x + i * TILE, y + j * TILE + shift)
    forest.fold()
    nodes = a if right is None else np.concatenate([a, b])
    linked = np.flatnonzero(forest.label != np.arange(len(nodes)))
    return nodes[linked], nodes[forest.label[linked]]


def _cells(counts: dict[int, int], size: int) -> list[tuple[int, int, int]]:
    """(first popcount, last popcount, parts): popcounts merged or split into cells of about ``size``."""
    cells: list[tuple[int, int, int]] = []
    first, held = None, 0
    for p in range(65):
        n = counts.get(p, 0)
        if first is not None and held + n > size:
            cells.append((first, p - 1, 1))
            first, held = None, 0
        if n > size:
            cells.append((p, p, -(-n // size)))
        elif n or first is not None:
            first, held = p if first is None else first, held + n
    if first is not None:
        cells.append((first, 64, 1))
    return cells


def cell_size(total: int, least: int = 4096, most: int = MOST_CELL) -> int:
    """A 48th of all fingerprints, within bounds: cells grow no further when the table does, there are more of them."""
    return min(max(least, -(-total // 48)), most)


def links(nodes: DataFrame, radius: int = 4, least_cell: int = 4096, most_cell: int = MOST_CELL) -> DataFrame:
    """Links (a, b) between distinct fingerprints, spanning every pair within the radius.

    65 counts reach the driver.  A cell holds about ``most_cell`` fingerprints
    at most, so the memory of a task does not grow with the table; the number
    of pairs of cells grows with its square, as an exact comparison must.
    """
    ship(nodes.sparkSession)
    popcount = F.bit_count("fingerprint").cast("int")
    counts = {r["p"]: r["n"] for r in nodes.groupBy(popcount.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = _cells(counts, cell_size(sum(counts.values()), least_cell, most_cell))
    numbered: list[tuple[int, int]] = []  # popcount range of each cell number
    base, parts = [0] * 65, [1] * 65
    for first, last, n in cells:
        for p in range(first, last + 1):
            base[p], parts[p] = len(numbered), n
        numbered += [(first, last)] * n
    near = [
        (
            min((k for k, (f, t) in enumerate(numbered) if f - radius <= p <= t + radius), default=0),
            max((k for k, (f, t) in enumerate(numbered) if f - radius <= p <= t + radius), default=-1),
        )
        for p in range(65)
    ]

    def of(values: list[int]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), popcount)

    placed = nodes.select("fingerprint", (of(base) + F.pmod(F.xxhash64("fingerprint"), of(parts)).cast("int")).alias("cell"), popcount.alias("p"))
    first, last = (F.get(F.array(*[F.lit(n[k]) for n in near]), F.col("p")) for k in (0, 1))
    met = placed.select("fingerprint", "cell", F.explode(F.sequence(first, last)).alias("other")).select(
        "fingerprint", "cell", F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high")
    )

    def compare(key, table):
        low, high = key[0].as_py(), key[1].as_py()
        bits = table.column("fingerprint").to_numpy().astype(np.int64).view(np.uint64)
        if low == high:
            a, b = forest_of(bits, None, radius)
        else:
            side = table.column("cell").to_numpy() == low
            if side.all() or not side.any():
                a = b = bits[:0]
            else:
                a, b = forest_of(bits[side], bits[~side], radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return met.groupBy("low", "high").applyInArrow(compare, "a long, b long")


def components_of(prints: DataFrame, radius: int = 4) -> DataFrame:
    """``prints`` (row, doc_id, fingerprint) with component_id, the smallest doc_id that links reach."""
    nodes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, radius)).select(F.col("node").alias("fingerprint"), "root")
    members = nodes.join(roots, "fingerprint", "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    smallest = members.filter("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component_id"))
    known = members.join(smallest, "root").select("fingerprint", "component_id")
    return prints.join(known, "fingerprint")


def keep_one(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with the columns of ``docs``."""
    aside = {c: f"_own_{c}" for c in docs.columns if c in ("row", "fingerprint")}
    prints = fingerprints(docs.withColumnsRenamed(aside), width)
    # Components are known by their smallest fingerprint here, so rows without ids stay apart.
    keyed = prints.select("row", "doc_id", "fingerprint")
    nodes = keyed.select("fingerprint").distinct()
    roots = components(links(stored(nodes, "nodes"), radius)).select(F.col("node").alias("fingerprint"), "root")
    grouped = keyed.groupBy("fingerprint").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    chosen = grouped.join(roots, "fingerprint", "left").groupBy(F.coalesce("root", "fingerprint").alias("root")).agg(F.min("first").alias("first"))
    kept = chosen.select(F.col("first.row").alias("row"))
    own = prints.join(kept, "row", "left_semi").drop("row", "fingerprint")
    return own.withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def hexed(column: str = "fingerprint") -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
