"""Near-duplicates by DartMinHash, banded joining and an exact check of each link.

A document is the weighted set of its runs of five words; the weight of a run is how often it occurs. Each unit of weight of an
element is a region into which darts are thrown from a hash of the element: their order in time is
the same in every document. Of the darts that reach each of ``K`` coordinates the earliest counts, so two documents
agree in a coordinate with the probability of their weighted Jaccard similarity. Time is cut where
enough darts have been thrown for the total weight, so a sketch costs its elements and K log K darts.

Exact copies are one node, however many. Nodes that agree in a band are compared with one pivot of that
bucket and not with each other; buckets that still hold several classes get other pivots in further rounds. The nodes of
buckets that hold several classes after those are joined exactly: of two sets that are similar enough, the rarest units
have one in common, so nodes meet by these, and those of different classes are compared in blocks.

Rows: texts without words, null texts and rows without an id are classes of their own; ids must be whole numbers, others count
as missing; shorter texts than five words are one run; rows with the same doc_id and text are one document, those with the same
doc_id and different texts are different documents, whose classes ``class_key`` tells apart; very long texts are taken whole;
ties cannot occur, as pivots and class ids are chosen by hash and doc_id; other columns may have any name; an empty table
gives an empty result. Of N texts two are taken for one with a chance of N * N / 2**65; similarity is that of 32-bit
hashes of the units.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import F, T, WordHashes, free_name, hash64, map_arrow, portions, stored, windows

#: Words of a run, coordinates, those of a band, similarity of a link, rounds of pivots.
WORDS, K, ROWS, SIMILARITY, ROUNDS = 5, 64, 4, 0.8, 3
#: Ids up to which a list of ids is broadcast (some tens of MB); beyond it, the join is a shuffle.
MOST_SENT = 1_000_000
#: Counters of units that tell rare ones, nodes of a unit up to which pairs are rows, nodes and units of a block beyond.
COUNTERS, FEW, BLOCK, BLOCK_UNITS = 1 << 20, 8, 256, 1 << 20


def runs(text: str, hashes: WordHashes) -> np.ndarray:
    """Units of weight: a hash of each run of words and of how many like it stand before it."""
    h = np.sort(windows(hashes.of(text.encode("utf-8", "surrogatepass").lower().split()), WORDS))
    if not len(h):
        return h
    new = np.concatenate(([True], h[1:] != h[:-1]))
    place = np.arange(len(h))
    return hash64(h + (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _gap(h: np.ndarray) -> np.ndarray:
    """Exponential waiting times from hashes."""
    return -np.log((h >> np.uint64(11)).astype(np.float64) + 0.5) + 53 * np.log(2)


def sketch(units: list[np.ndarray], k: int = K) -> np.ndarray:
    """A row of ``k`` dart ids for each set of units; none of the sets may be empty."""
    out = np.zeros((len(units), k), np.uint64)
    todo, darts = np.arange(len(units)), k * (np.log(k) + 3)
    while len(todo):
        flat = np.concatenate([units[i] for i in todo])
        sizes = np.array([len(units[i]) for i in todo])
        owner = np.repeat(np.arange(len(todo)), sizes)
        until = (darts / sizes)[owner]
        seed, time, turn, thrown = flat, np.zeros(len(flat)), 0, []
        while len(seed):
            turn += 1
            h = hash64(seed + np.uint64(turn))
            time = time + _gap(h)
            live = time <= until
            seed, time, owner, until, h = seed[live], time[live], owner[live], until[live], h[live]
            aim = hash64(h + np.uint64(0x5851F42D4C957F2D))
            thrown.append((owner * k + (aim % np.uint64(k)).astype(np.int64), time, aim))
        at, when, dart = (np.concatenate(x) for x in zip(*thrown, strict=True))
        order = np.lexsort((when, at))
        at = at[order]
        first = np.concatenate(([True], at[1:] != at[:-1])) if len(at) else np.zeros(0, bool)
        got = np.zeros(len(todo) * k, np.uint64)
        hit = np.zeros(len(todo) * k, bool)
        got[at[first]], hit[at[first]] = dart[order][first], True
        full = hit.reshape(-1, k).all(1)
        out[todo[full]] = got.reshape(-1, k)[full]
        todo, darts = todo[~full], darts * 2
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each band of ``rows`` coordinates, salted with its number."""
    n, k = signature.shape
    h = np.tile(np.arange(k // rows, dtype=np.uint64), (n, 1))
    for i in range(rows):
        h = hash64(h + np.uint64(i)) + signature[:, i::rows]
    return hash64(h)


def digest(text: str | None) -> int | None:
    """64 bits that tell texts apart, the same for texts of the same words; None without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else None


def sketches(df: DataFrame) -> DataFrame:
    """doc_id, node (digest of the words) and bands of every row with an id and a word."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("node", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def make():
        hashes = WordHashes(200_000)

        def each(batch: pa.RecordBatch):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in portions(texts):
                some = [(d, digest(x), u) for d, x in zip(ids[a:b], texts[a:b], strict=True) if len(u := runs(x, hashes))]
                if some:
                    signed = bands(sketch([u for _, _, u in some])).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in some], pa.int64()), pa.array([n for _, n, _ in some], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * signed.shape[1], pa.int32()), pa.array(signed.ravel()))], names=schema.names)

        return each

    return map_arrow(_worded(df), schema, make)


def _worded(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")


def _elements(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its sorted units (32 bits of each) for ``nodes``, each with the doc_id of a row that has its text."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("units", T.BinaryType())])
    rows = _worded(df).join(F.broadcast(nodes) if nodes.count() <= MOST_SENT else nodes, "doc_id").select("node", "text")

    def make():
        hashes = WordHashes(200_000)

        def each(batch: pa.RecordBatch):
            nodes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in portions(texts):
                # rows with the id of a node's row may have other texts
                got = [(n, np.unique((runs(x, hashes) >> np.uint64(32)).astype(np.uint32)).tobytes()) for n, x in zip(nodes[a:b], texts[a:b], strict=True) if digest(x) == n]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.int64()), pa.array([u for _, u in got], pa.binary())], names=schema.names)

        return each

    return map_arrow(rows, schema, make).dropDuplicates(["node"])


def _verified(pairs: DataFrame, elements: DataFrame, similarity: float) -> DataFrame:
    """The pairs (pivot, node) whose units have at least this Jaccard similarity."""
    mine = pairs.join(elements, "node").withColumnRenamed("units", "own")
    both = mine.join(elements.withColumnRenamed("node", "pivot"), "pivot").select("pivot", "node", "own", "units")
    schema = T.StructType([T.StructField("pivot", T.LongType()), T.StructField("node", T.LongType()), T.StructField("linked", T.BooleanType())])

    def make():
        def each(batch: pa.RecordBatch):
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                if min(len(a), len(b)) < similarity * max(len(a), len(b)):
                    linked.append(False)
                    continue
                n = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(n >= similarity * (len(a) + len(b) - n))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=schema.names)

        return each

    return map_arrow(both, schema, make)


def _counts(elements: DataFrame) -> np.ndarray:
    """How many nodes have the units of each counter."""
    schema = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches):
        table = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(table, np.frombuffer(x.as_buffer(), np.uint32) & np.uint32(COUNTERS - 1), 1)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], names=schema.names)

    got = elements.select("units").mapInArrow(run, schema).groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def rarest(units: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """As many of the rarest units that two sets of at least this similarity have one of them in common."""
    n = len(units) - int(np.ceil(similarity * len(units) - 1e-9)) + 1
    order = np.lexsort((hash64(units), counts[units & np.uint32(COUNTERS - 1)]))
    return units[order[:n]]


def _keyed(elements: DataFrame, similarity: float) -> DataFrame:
    """node, label, its number of units, and a row for each of its rarest units."""
    sent = elements.sparkSession.sparkContext.broadcast(_counts(elements).astype(np.int32))
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("label", T.LongType()), T.StructField("size", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def make():
        counts = sent.value

        def each(batch: pa.RecordBatch):
            units = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(2)]
            keys = pa.array([rarest(u, counts, similarity).astype(np.int64) for u in units], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(u) for u in units], pa.int64()), keys], names=schema.names)

        return each

    return map_arrow(elements.select("node", "label", "units"), schema, make).select("node", "label", "size", F.explode("keys").alias("key"))


def links_within(nodes: list[int], labels: list[int], sides: list[bool], units: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join different labels; nodes of the second side are compared with those of the first only."""
    sizes, label = np.array([len(u) for u in units]), np.unique(np.array(labels), return_inverse=True)[1]
    ends, flat, second = np.cumsum(sizes), np.concatenate(units), np.array(sides)
    both, out = bool(second.any()), []
    for i in np.flatnonzero(~second):
        apart = (label != label[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]))
        # within one block each pair comes once
        apart &= second if both else np.arange(len(nodes)) > i
        if not apart.any():
            continue
        own = units[i]
        at = np.searchsorted(own, flat)
        hit = own[np.minimum(at, len(own) - 1)] == flat
        upto = np.concatenate(([0], np.cumsum(hit)))
        n = upto[ends] - upto[ends - sizes]
        for j in np.flatnonzero(apart & (n >= similarity * (sizes + sizes[i] - n))):
            if label[i] != label[j]:
                out.append((nodes[i], nodes[j]))
                label[label == label[j]] = label[i]
    return out


def _rest(members: DataFrame, labels: DataFrame | None, elements: DataFrame, tried: DataFrame, similarity: float) -> DataFrame:
    """Links between the nodes of different classes in buckets that hold several: an exact join by the rarest units."""
    if labels is None:
        placed = members.withColumn("label", F.col("node"))
    else:
        placed = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # two nodes of a bucket were compared in the first round
    mixed = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high AND n > 2").select("bucket")
    nodes = placed.join(mixed, "bucket").select("node", "label").distinct()
    mine = stored(nodes.join(elements, "node"), "rest")
    keyed = stored(_keyed(mine, similarity), "keyed")
    by_label = keyed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.min(F.xxhash64("node")).alias("low"))
    by_key = stored(by_label.groupBy("key").agg(F.sum("n").alias("m"), F.max_by("label", F.struct("n", "label")).alias("major"), F.sum("sum").alias("sum"), F.min("low").alias("low"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "keys")
    # units that the same nodes have are one
    alone = by_key.where(F.col("m") <= FEW).groupBy("m", "sum").agg(F.min("key").alias("key")).select("key")
    few = keyed.join(alone, "key").select("key", "node", "label")
    other = few.select("key", F.col("node").alias("pivot"), F.col("label").alias("class"))
    pairs = few.join(other, "key").where("pivot < node AND label <> class").select("pivot", "node").distinct().join(tried, ["pivot", "node"], "left_anti")
    found = _verified(pairs, elements, similarity).where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    # larger ones are mostly those of one family, with almost the same nodes: they are put together by the most frequent class and
    # a least hash of a node, so each node comes once for all; then the nodes outside the most frequent class are in blocks
    # that meet each other and those of that class
    group = ["major", "low"]
    met = stored(keyed.join(by_key.where(F.col("m") > FEW).select("key", *group), "key").select(*group, "node", "label", "size").distinct(), "met")
    minor = F.col("label") != F.col("major")
    parts = lambda of: F.ceil(F.greatest(F.count_if(of) / BLOCK, F.coalesce(F.sum(F.when(of, F.col("size"))), F.lit(0)) / BLOCK_UNITS, F.lit(1))).cast("int")
    sizes = stored(met.groupBy(*group).agg(parts(minor).alias("minor"), parts(~minor).alias("rest")), "sizes")
    dealt = met.join(sizes, group).withColumn("own", F.when(F.col("label") == F.col("major"), F.col("minor") + F.pmod(F.xxhash64("node"), F.col("rest"))).otherwise(F.pmod(F.xxhash64("node"), F.col("minor"))).cast("int"))
    others = F.when(F.col("label") == F.col("major"), F.sequence(F.lit(0), F.col("minor") - 1)).otherwise(F.sequence(F.lit(0), F.col("minor") + F.col("rest") - 1))
    dealt = dealt.select(*group, "node", "own", F.explode(others).alias("other")).select(*group, "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def compare(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).to_pylist()
        units = [np.frombuffer(x, np.uint32) for x in get("units")]
        out = [] if table.num_rows < 2 else links_within(get("node"), get("label"), get("side"), units, similarity)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    blocks = dealt.join(mine, "node").groupBy(*group, "i", "j").applyInArrow(compare, schema)
    return stored(found.union(blocks).distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """node and label, the lowest node that links lead to; ``edges`` has the columns a and b.

    Every node takes the lowest label among its neighbours', then the label of its label, until none changes.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = stored(hooked.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        labels = moved.select("node", "label")
        if not moved.where("label <> old").limit(1).count():
            return labels


def _found(df: DataFrame, similarity: float, rounds: int) -> DataFrame:
    """doc_id, node, class_key (the lowest node that links lead to) and class_id of every row with an id and a word."""
    rows = stored(sketches(df), "sketches")
    nodes = rows.groupBy("node").agg(F.min(F.struct("doc_id", "bands")).alias("first"), F.count(F.lit(1)).alias("n")).select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.bands").alias("bands"), "n")
    nodes = stored(nodes, "nodes")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    # stored, so that the joins by bucket below read exchanges, whose large partitions Spark splits
    shared = stored(banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket"), "shared")
    members = stored(banded.join(shared, "bucket"), "members")
    involved = stored(nodes.join(members.select("node").distinct(), "node").select("node", "doc_id"), "involved")
    elements = stored(_elements(df, involved), "elements")
    labels, tried, links = None, None, None
    for turn in range(rounds):
        salt = [F.lit(turn)] + ([F.col("bucket")] if turn else [])
        if labels is None:
            placed = members.withColumn("label", F.col("node"))
        else:
            placed = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        pivots = placed.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", *salt).alias("h"), F.col("node").alias("pivot"), F.col("label").alias("class"))).alias("p"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket", "p.pivot", "p.class")
        pivots = stored(pivots, "pivots")
        pairs = placed.join(pivots, "bucket").where("label <> class AND node <> pivot").select(F.least("pivot", "node").alias("pivot"), F.greatest("pivot", "node").alias("node")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["pivot", "node"], "left_anti")
        seen = stored(_verified(pairs, elements, similarity), "links")
        new = seen.where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
        tried = seen.select("pivot", "node") if tried is None else tried.union(seen.select("pivot", "node"))
        if not new.limit(1).count():
            if turn:
                break
            continue
        links = new if links is None else links.union(new)
        labels = components(links)
    if tried is not None:
        new = _rest(members, labels, elements, tried, similarity)
        if new.limit(1).count():
            labels = components(new if links is None else links.union(new))
    # only texts with copies or links need a lookup; of all others the class is their own row
    placed = nodes.select("node", "doc_id", "n", F.col("node").alias("class_key")) if labels is None else nodes.select("node", "doc_id", "n").join(labels, "node", "left").select("node", "doc_id", "n", F.coalesce("label", "node").alias("class_key"), F.col("label").isNotNull().alias("linked"))
    placed = placed.where("n > 1" if labels is None else "n > 1 OR linked")
    known = placed.join(placed.groupBy("class_key").agg(F.min("doc_id").alias("class_id")), "class_key").select("node", "class_key", "class_id")
    return rows.select("doc_id", "node").join(stored(known, "known"), "node", "left").select("doc_id", "node", F.coalesce("class_key", "node").alias("class_key"), F.coalesce("class_id", "doc_id").alias("class_id"))


def classes(df: DataFrame, similarity: float = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, class_id (the lowest doc_id of the class; null for rows without an id) and class_key of every row."""
    doc_id = F.col("doc_id").try_cast("long")
    alone = df.where(doc_id.isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select(doc_id.alias("doc_id"), doc_id.alias("class_id"), F.lit(None).cast("long").alias("class_key"))
    return _found(df, similarity, rounds).select("doc_id", "class_id", "class_key").union(alone)


def distinct(df: DataFrame, similarity: float = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """One document of each class, that with the lowest doc_id, with its columns; rows without an id or a word stay."""
    found = stored(_found(df, similarity, rounds), "classes")
    # ids with several rows: their texts tell which row is meant
    several = stored(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "several")
    some = several.limit(1).count() > 0
    key, node = free_name(df, "key"), free_name(df, "node")
    goes = found.where("doc_id <> class_id").select(F.col("doc_id").alias(key)).distinct()
    if some:
        goes = goes.union(several.select(F.col("doc_id").alias(key)))
    same = F.col("doc_id").try_cast("long") == F.col(key)
    left = df.join(F.broadcast(goes) if goes.count() <= MOST_SENT else goes, same, "left_anti")
    if some:
        kept = found.where("doc_id = class_id").groupBy("class_key").agg(F.min(F.struct("doc_id", "node")).alias("k")).select(F.col("k.doc_id").alias(key), F.col("k.node").alias(node)).join(several.withColumnRenamed("doc_id", key), key, "left_semi")
        rows = _with_digest(df.join(several.select(F.col("doc_id").alias(key)), same, "left_semi"), node)
        chosen = rows.where(F.col(node).isNotNull()).withColumn(key, F.col("doc_id").try_cast("long")).join(kept, [key, node], "left_semi").dropDuplicates([key, node])
        left = left.union(rows.where(F.col(node).isNull()).select(*df.columns)).union(chosen.select(*df.columns))
    return left


def _with_digest(df: DataFrame, name: str) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    at = df.columns.index("text")

    def make():
        return lambda batch: pa.RecordBatch.from_arrays([*batch.columns, pa.array([digest(x) for x in batch.column(at).to_pylist()], pa.int64())], names=schema.names)

    return map_arrow(df, schema, make)
