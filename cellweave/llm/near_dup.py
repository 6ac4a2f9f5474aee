"""Near-duplicate documents by MinHash bands, signature verification and connected components.

1. Every document becomes the set of its distinct word shingles; documents with equal sets form a class, and one of each class
   goes on. So exact copies never meet each other.
2. ``bands * rows`` universal hash minima make the signature. With 40 bands of 6 rows a pair at similarity 0.8 shares no band
   with probability 5e-6, a more similar one with less.
3. In each bucket the member with the most bucket mates is the pivot: pairs go from the pivots to the other members, so they
   grow with the members, not with their square. The signature estimate refuses pairs that are far below the threshold, and
   the full sets decide the others.
4. Two members of a bucket that are not both linked to its pivot may still be linked to each other. Relative to the pivot a
   set is a bit mask over the pivot's shingles and the few shingles besides; on those the overlaps of all members of a star
   are exact matrix products. The Jaccard distance is a metric, so members whose distances from the pivot differ by more than
   a link's can't be linked: a star falls into layers of that width, and only members of neighbouring layers meet, in pairs of
   blocks of bounded size. What leaves a pair of blocks is a spanning forest of its links: no pairs are stored, none of the links
   between different components is lost. Members that are linked to the pivot never meet each other.
5. Alternating large-star and small-star find the components; classes carry them back to all documents.

Defined results: null texts, and texts without words, are linked with nothing; rows that repeat a doc_id with another text are
linked with each other; a null doc_id is a component of its own, with null as its id, and is kept; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import small, stored
from .components import components

BANDS, ROWS = 40, 6
#: Estimates this many standard deviations below the threshold are refused without a look at the sets.
DEVIATIONS = 6
#: Members of a layer of a star that are compared with others in one step.
BLOCK = 1024


def _sketch(width: int, bands: int, rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = shingles.hash_family(bands * rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles.shingle_set(x.as_py(), width) for x in part.column(1)]
                some = [i for i, s in enumerate(sets) if len(s)]
                sig = shingles.signatures([sets[i] for i in some], family) if some else np.empty((0, bands * rows), np.uint32)
                keys, low = shingles.band_keys(sig, rows), sig.astype(np.uint8)
                row = dict(zip(some, range(len(some)), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([shingles.set_key(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([keys[row[i]] if i in row else None for i in range(len(sets))], pa.list_(pa.int64())),
                        pa.array([low[row[i]].tobytes() if i in row else None for i in range(len(sets))], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "bands", "signature"],
                )

    return work


def _linked(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


def _hopeful(a: bytes, b: bytes, least: float) -> bool:
    """Whether the share of equal signature bytes leaves a similarity of ``least`` possible."""
    same = (np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean()
    return (same - 1 / 256) / (1 - 1 / 256) >= least - DEVIATIONS * (least * (1 - least) / len(a)) ** 0.5


def _verify(width: int, percent: int):
    """(pivot, member, texts, signatures) to the member's encoding relative to the pivot, and whether they are linked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = object(), np.empty(0, np.uint64)
        for batch in batches:
            out: list[tuple] = []
            p, x, pt, xt, ps, xs = (batch.column(i) for i in range(6))
            for i in range(batch.num_rows):
                pid, text = p[i].as_py(), pt[i].as_py()
                if (pid, text) != last:
                    last, pivot = (pid, text), shingles.shingle_set(text, width)
                own = shingles.shingle_set(xt[i].as_py(), width)
                mask = np.isin(pivot, own, assume_unique=True)
                beside = own[~np.isin(own, pivot, assume_unique=True)]
                hopeful = not (ps[i].is_valid and xs[i].is_valid) or _hopeful(ps[i].as_py(), xs[i].as_py(), percent / 100)
                common = int(mask.sum())
                out.append((pid, x[i].as_py(), len(own), len(pivot), common, bool(hopeful and _linked(common, len(own), len(pivot), percent)), np.packbits(mask).tobytes(), beside.tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(STAR, r, strict=True)) for r in out], schema=STAR_ARROW)

    return work


STAR = ("p", "x", "n", "pn", "common", "linked", "mask", "beside")
STAR_SQL = "p bigint, x bigint, n bigint, pn bigint, common bigint, linked boolean, mask binary, beside binary"
STAR_ARROW = pa.schema([("p", pa.int64()), ("x", pa.int64()), ("n", pa.int64()), ("pn", pa.int64()), ("common", pa.int64()), ("linked", pa.bool_()), ("mask", pa.binary()), ("beside", pa.binary())])


def star_links(ids: np.ndarray, n: np.ndarray, pn: int, linked: np.ndarray, masks: list[bytes], beside: list[bytes], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the members of a star that are not all linked to its pivot."""
    m = len(ids)
    bits = np.unpackbits(np.frombuffer(b"".join(masks), np.uint8).reshape(m, -1), axis=1)[:, :pn].astype(np.float32)
    rest = [np.frombuffer(b, np.uint64) for b in beside]
    extra = np.array([len(r) for r in rest])
    parent = list(range(m))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = -1
    for i in np.flatnonzero(linked).tolist():  # linked to the pivot, and so to each other
        if first < 0:
            first = i
        parent[i] = first
    out = []
    loose = np.flatnonzero(~linked)
    for at in range(0, len(loose), 256):
        rows = loose[at : at + 256]
        common = bits[rows] @ bits.T
        most = common + np.minimum(extra[rows][:, None], extra[None, :])
        both = n[rows][:, None] + n[None, :]
        could = (100 + percent) * most >= percent * both
        for r, j in zip(*np.nonzero(could), strict=True):
            i, j = int(rows[r]), int(j)
            if i == j or find(i) == find(j):
                continue
            c = round(float(common[r, j]))
            if extra[i] and extra[j]:
                c += len(np.intersect1d(rest[i], rest[j], assume_unique=True))
            if _linked(c, int(n[i]), int(n[j]), percent):
                parent[find(i)] = find(j)
                if ids[i] != ids[j]:
                    out.append((int(ids[i]), int(ids[j])))
    return out


def _stars(percent: int):
    """Rows sorted by (p, g), one group after the other; a group has two blocks at most and so a bounded size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def done() -> list[tuple[int, int]]:
            if len(held) < 2 or all(h[3] for h in held):
                return []
            by_pivot: dict[int, list[tuple]] = {}
            for h in held:  # a pivot id that stands for several texts has masks of several lengths
                by_pivot.setdefault(h[1], []).append(h)
            found: list[tuple[int, int]] = []
            for pn, g in by_pivot.items():
                found += star_links(np.array([h[0] for h in g]), np.array([h[2] for h in g]), pn, np.array([h[3] for h in g]), [h[4] for h in g], [h[5] for h in g], percent)
            return found

        def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["u", "v"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:2] != key:
                    if links := done():
                        yield batch_of(links)
                    held, key = [], r[:2]
                _, _, x, pn, linked, n, mask, beside = r
                held.append((x, pn, n, linked, mask, beside))
        if links := done():
            yield batch_of(links)

    return work


def _layer(percent: int) -> Column:
    """How many whole link distances (100 - percent hundredths) a member's Jaccard distance from the pivot has; 0 for linked ones.

    The Jaccard distance is a metric: members whose distances from the pivot differ by more than a link distance can't be linked.
    So members meet those of their own layer and of the next ones only. In integers: layer k has k * step <= distance < (k + 1) * step.
    """
    union = F.col("n") + F.col("pn") - F.col("common")
    # a distance of exactly one step is a link, so it belongs to layer 0, and so on: ceil(distance / step) - 1
    steps = F.ceil(100 * (union - F.col("common")) / ((100 - percent) * union)).cast("int") - 1 if percent < 100 else F.lit(1)
    return F.when(F.col("linked"), 0).otherwise(F.greatest(F.lit(1), steps))


def _meetings() -> Column:
    """The pairs of blocks that a member belongs to, as (layer, block) twice; ``blocks`` has the number of blocks of each layer of its star.

    A block meets every block of its own layer and of the two beside; linked members are linked through the pivot, so blocks of
    layer 0 meet those of layer 1 alone.
    """
    up_to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    count = lambda k: F.coalesce(F.try_element_at("blocks", k), F.lit(0))
    pair = lambda i, a, j, b: F.struct(i.alias("i"), a.alias("a"), j.alias("j"), b.alias("b"))
    k = F.col("layer")
    own = F.pmod("h", count(k)).cast("int")
    same = F.transform(up_to(count(k)), lambda o: pair(k, F.least(own, o), k, F.greatest(own, o)))
    above = F.transform(up_to(count(k + 1)), lambda o: pair(k, own, k + 1, o))
    below = F.transform(up_to(count(k - 1)), lambda o: pair(k - 1, o, k, own))
    # a block that meets others meets itself on the way, unless it is the only one of its layers
    alone = F.size(F.concat(above, F.when(k > 0, below).otherwise(F.array().cast(BLOCK_PAIRS)))) == 0
    inner = F.filter(same, lambda x: (x["a"] != x["b"]) | alone)
    return F.when(k == 0, above).otherwise(F.concat(F.when((count(k) > 1) | alone, inner).otherwise(F.array().cast(BLOCK_PAIRS)), above, below))


BLOCK_PAIRS = "array<struct<i:int,a:int,j:int,b:int>>"


def near_duplicate_links(docs: DataFrame, sketches: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v): links between classes, each named by its least doc_id, enough to connect all that are connected."""
    spark = docs.sparkSession
    reps = sketches.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    bands = stored(reps.select("id", F.explode("bands").alias("key")), "bands")
    many = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(bands.join(many, "key").select("key", "id", "size").distinct(), "members")
    mates = members.groupBy("id").agg(F.sum("size").alias("mates"))
    ranked = members.select("key", "id").join(mates, "id")
    pivots = ranked.groupBy("key").agg(F.min(F.struct((-F.col("mates")).alias("r"), F.col("id"))).alias("p")).select("key", F.col("p.id").alias("p"))
    pairs = stored(members.select("key", "id").join(pivots, "key").where("id <> p").select("p", F.col("id").alias("x")).distinct(), "pairs")
    used = pairs.select(F.explode(F.array("p", "x")).alias("id")).distinct()
    wanted = small(used, 2 * pairs.count(), 1_000_000)
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")).join(wanted, "id", "left_semi")
    signs = sketches.where("set_key is not null").select(F.col("doc_id").alias("id"), "set_key", "signature").join(wanted, "id", "left_semi").groupBy("id").agg(F.when(F.min("set_key") == F.max("set_key"), F.first("signature")).alias("s"))  # none for an id with several texts
    texts = texts.groupBy("id", F.xxhash64("t").alias("h")).agg(F.first("t").alias("t")).select("id", "t").join(signs, "id")
    member = texts.select(F.col("id").alias("x"), F.col("t").alias("xt"), F.col("s").alias("xs"))
    pivot = texts.select(F.col("id").alias("p"), F.col("t").alias("pt"), F.col("s").alias("ps"))
    # a pivot with many members meets them in parts, so that no star is one task's work
    large = pairs.groupBy("p").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("parts > 1")
    large = small(large, large.count())
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(large, "p", "left").select("p", "x", F.pmod(F.xxhash64("x"), parts).cast("int").alias("part"))
    pivot = pivot.join(large, "p", "left").select("p", "pt", "ps", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    full = dealt.join(member, "x").join(pivot, ["p", "part"]).select("p", "x", "pt", "xt", "ps", "xs")
    star = stored(full.mapInArrow(_verify(width, percent), STAR_SQL), "stars")
    direct = star.where("linked").select(F.col("p").alias("u"), F.col("x").alias("v"))
    layered = star.withColumn("layer", _layer(percent))
    layers = layered.groupBy("p", "layer").agg(F.count("*").alias("m"))
    sized = layers.groupBy("p").agg(F.map_from_entries(F.collect_list(F.struct("layer", F.ceil(F.col("m") / BLOCK).cast("int")))).alias("blocks"), F.sum("m").alias("m"), F.max("layer").alias("top"))
    sized = sized.where("m > 1 and top > 0").select("p", "blocks")
    dealt = layered.join(small(sized, sized.count()), "p").withColumn("h", F.xxhash64("x")).withColumn("at", F.explode(_meetings()))
    dealt = dealt.select("p", F.struct("at.i", "at.a", "at.j", "at.b").alias("g"), "x", "pn", "linked", "n", "mask", "beside")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cross = dealt.repartition(n, "p", "g").sortWithinPartitions("p", "g").mapInArrow(_stars(percent), "u bigint, v bigint")
    return direct.union(cross)


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document row."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, signature binary"
    sketches = stored(own.mapInArrow(_sketch(width, bands, rows), schema), "sketches")
    keyed = sketches.where("set_key is not null and doc_id is not null")
    classes = keyed.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last"))
    links = near_duplicate_links(own, sketches, width, percent)
    twice = keyed.groupBy("doc_id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b")).where("a <> b").select("doc_id")
    if n := twice.count():
        several = keyed.join(small(twice, n), "doc_id", "left_semi").select("doc_id", "set_key").distinct().join(classes, "set_key").select("doc_id", "node")
        links = links.union(several.join(several.groupBy("doc_id").agg(F.min("node").alias("u")), "doc_id").select("u", F.col("node").alias("v")))
    labels = components(links)
    # one row for each class that has copies or links, stored: the join meets plain rows, so that a class with a third of all
    # documents is split over several tasks
    named = classes.join(labels, "node", "left").where("component is not null or node <> last").select(F.col("set_key").alias("k"), F.coalesce("component", "node").alias("c"))
    named = stored(named, "classes")
    out = sketches.select("doc_id", "n_shingles", "set_key").join(small(named, named.count()), F.col("set_key") == F.col("k"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
