"""Near-duplicate groups by a signature-coordinate inverted join, confirmed on full shingle sets.

Steps, all of them linear in the number of documents:

1. One pass over the texts gives each document its shingle-set hash and a MinHash signature of 64 coordinates.
   Documents of equal sets are one class from here on, so exact copies cost one row.
2. Every class is posted under the values of its first eight coordinates.  A pair of similarity s shares a given
   value with probability s, so at 0.8 it misses all eight with probability 3e-6.  Posting lists of one class go.
3. A list of at most ``LIST`` classes is merged on the spot: collisions are counted over the signature, with skip
   merging (a pair already joined through others isn't counted), and pairs at or above the match threshold are kept
   as a spanning forest.  The threshold lies 4.5 standard deviations below the expected collisions.
   The classes of longer lists, each once, are posted again under ten pairs of further coordinates (a pair at 0.8 shares
   none with probability 4e-5), those of lists still long under twelve triples (2e-4).  What is long even then agrees on
   three coordinates; it is linked whole, without counting.  These links are candidates only: they decide which classes
   are compared, not which are equal.  A pair missed in a long list is lost only if no other member joins it.
4. Connected candidates are clusters.  Their sets are read again from the texts and tested exactly, counting common
   shingles through the cluster's inverted lists; pairs joined already aren't tested, which loses no component.  Clusters
   above ``BLOCK`` are cut into blocks that meet the same ``LEADERS`` each; what is then outside of the cluster's largest
   component meets every block.  So a cluster of near copies costs a row a member.
5. Connected components of the true links are the groups.

With ``exact`` no chance is left: instead of 2 and 3 every class is posted under its rarest shingles (by their counts
over all classes), one more than may lack in a set of the required similarity, so that linked classes always meet; each
list is then tested like a cluster in 4.  Sets are carried to each list, so this moves several times as much.

Defined results: null or wordless texts have ``n_shingles`` 0 and stand alone; component_id is the smallest id that isn't
null in the group, null where all are, and rows with that id are kept, so repeated rows (same id, same text) are kept or
not together.  Rows of one id with different texts are documents of their own, told apart by ``text_hash``.  An empty
table gives an empty result.  Very long texts are held one at a time.  Extra columns are ignored, whatever their names.
Classes are named by 64 bits of their set's hash, and shingles and texts compared by 64-bit hashes.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .kernels import U64, chunks, groups_of, mix, shingle_sets, text_buffer
from .runtime import stored

COORDINATES = 64
POSTED = 8
LIST = 96
BLOCK = 2048
LOWEST = -(2**63)
LEADERS = 32
# first coordinate, width and number of bands under which classes of long lists are posted again, round by round
BANDS = ((POSTED, 2, 10), (POSTED + 20, 3, 12), (0, 0, 0))
_rng = np.random.Generator(np.random.PCG64(7))
FACTORS = _rng.integers(1, 2**63, COORDINATES, dtype=np.int64).astype(U64) * U64(2) + U64(1)
SHIFTS = _rng.integers(1, 2**63, COORDINATES, dtype=np.int64).astype(U64)

FEATURES = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("posts", pa.list_(pa.int64())), ("sig", pa.binary())])


def signature(values: np.ndarray) -> np.ndarray:
    """Minimum of each coordinate's permutation; long sets go through in slices."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, U64)
    for a in range(0, len(values), 4096):
        np.minimum(low, ((values[a : a + 4096, None] ^ SHIFTS) * FACTORS).min(0), out=low)
    return low


def set_key(values: np.ndarray) -> tuple[int, int]:
    if not len(values):
        return 0, 0
    a, b = mix(values), mix(values ^ U64(0xA5A5A5A5A5A5A5A5))
    pair = mix(np.array([a.sum(dtype=U64), np.bitwise_xor.reduce(b)], U64))
    return tuple(pair.view(np.int64).tolist())


def _features(width: int):
    salt = np.arange(POSTED, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)

    def run(batches):
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            for a, b, buf, offs in chunks(*text_buffer(batch.column(2))):
                sets = shingle_sets(buf, offs, width)
                keys = [set_key(s) for s in sets]
                sigs = [signature(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a), hashes.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                        pa.array([[] if s is None else mix(s[:POSTED] + salt).view(np.int64) for s in sigs], pa.list_(pa.int64())),
                        pa.array([b"" if s is None else (mix(s) >> U64(48)).astype(np.uint16).tobytes() for s in sigs], pa.binary()),
                    ],
                    schema=FEATURES,
                )

    return run


def _forest(n: int, linked) -> np.ndarray:
    """Smallest member of each member's component; linked(i, rest) is the mask of rest that i is linked with."""
    root = np.full(n, -1)
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed] = seed
        front = [seed]
        rest = np.flatnonzero(root < 0)
        while front and len(rest):
            hit = linked(front.pop(), rest)
            root[rest[hit]] = seed
            front.extend(rest[hit].tolist())
            rest = rest[~hit]
    return root


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edge_batch(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=EDGES)


def _merge_lists(matches: int):
    def run(batches):
        pairs = []
        for group in groups_of(batches, ["k"]):
            ids, first = np.unique(group.column("id").to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(-1, COORDINATES)[first]
            root = _forest(len(ids), lambda i, rest: (sigs[rest] == sigs[i]).sum(1) >= matches)
            own = root != np.arange(len(ids))
            pairs.append((ids[root[own]], ids[own]))
            if len(pairs) >= 4096:
                yield _edge_batch(pairs)
                pairs = []
        yield _edge_batch(pairs)

    return run


def _candidates(classes: DataFrame, matches: int) -> DataFrame:
    """Candidate links as pairs of ids.  Signatures are brought only to the lists that are merged."""
    signatures = classes.select("id", "sig")
    lists = classes.select("id", F.explode("posts").alias("k"))
    found = []
    for first, width, bands in BANDS:
        # written first, so that a long list can be split over tasks in the join
        counts = stored(lists.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("hub")).where("m > 1"), "list-lengths")
        counted = lists.join(counts, "k")
        short = counted.where(F.col("m") <= LIST).select("k", "id").join(signatures, "id").select("k", "id", "sig")
        found.append(short.repartition("k").sortWithinPartitions("k").mapInArrow(_merge_lists(matches), "a long, b long"))
        long = counted.where(F.col("m") > LIST)
        if not bands:
            found.append(long.select(F.col("hub").alias("a"), F.col("id").alias("b")))
            break
        if counts.where(F.col("m") > LIST).isEmpty():
            break
        keys = [F.xxhash64(F.lit(c), F.substring("sig", 2 * c + 1, 2 * width)) for c in range(first, first + bands * width, width)]
        again = signatures.join(long.select("id").distinct(), "id", "left_semi")
        lists = stored(again.select("id", F.explode(F.array(*keys)).alias("k")), "lists")
    return functools.reduce(DataFrame.union, found)


def _sets(width: int):
    """Full sets of the wanted texts; of repeated rows, which come one after the other, the first counts."""

    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column("id").to_numpy()
            new = np.append(nodes[0] != last, nodes[1:] != nodes[:-1])
            last = nodes[-1]
            batch = batch.filter(pa.array(new))
            for a, b, buf, offs in chunks(*text_buffer(batch.column("text"))):
                sets = shingle_sets(buf, offs, width)
                kept = [batch.column(c).slice(a, b - a) for c in ("id", "cluster", "size")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "cluster", "size", "set"])

    return run


class Inverted:
    """Lists of the members that have each shingle; counts what a member has in common with all others."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(column, kind="stable")
        self.owner = owner[order]
        self.start = np.append(0, np.cumsum(np.bincount(column)))
        self.column, self.first = column, np.append(0, np.cumsum(self.sizes))

    def common(self, i: int) -> np.ndarray:
        c = self.column[self.first[i] : self.first[i + 1]]
        a, n = self.start[c], self.start[c + 1] - self.start[c]
        at = np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.sizes))


def _confirm(keys: list[str], percent: int):
    """A spanning forest of the true links of each group of rows (id, set)."""

    def run(batches):
        pairs = []
        for group in groups_of(batches, keys):
            ids, first = np.unique(group.column("id").to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            lists = Inverted([np.frombuffer(r, U64) for r in group.column("set").take(pa.array(first)).to_pylist()])
            sizes = lists.sizes

            def linked(i, rest):
                common = lists.common(i)[rest]
                return 100 * common >= percent * (sizes[rest] + sizes[i] - common)

            root = _forest(len(ids), linked)
            own = root != np.arange(len(ids))
            pairs.append((ids[root[own]], ids[own]))
            if len(pairs) >= 4096:
                yield _edge_batch(pairs)
                pairs = []
        yield _edge_batch(pairs)

    return run


def _grouped_links(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_confirm(keys, percent), "a long, b long")


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """True links inside clusters, as pairs of ids that connect what is connected, from rows (cluster, size, id, set)."""
    small = _grouped_links(rows.where(F.col("size") <= BLOCK).select("cluster", "id", "set"), ["cluster"], percent)
    rows = rows.where(F.col("size") > BLOCK)
    if rows.isEmpty():
        return small
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    # some LEADERS rows of each cluster, by hash, whatever its size
    leader = F.pmod(F.xxhash64("id", F.lit(1)), F.col("size")) < LEADERS
    place = F.explode(F.when(leader, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(block)))
    first = stored(_grouped_links(rows.select("cluster", place.alias("i"), "id", "set"), ["cluster", "i"], percent), "block-links")
    roots = rows.select("cluster", "id", "size").join(components(first), F.col("id") == F.col("node"), "left").select("cluster", "id", "size", F.coalesce("root", "id").alias("root"))
    counts = roots.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("m"))
    main = stored(counts.groupBy("cluster").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.sum("m").alias("size"), F.max("m").alias("most")), "main-components")
    apart = stored(roots.join(main.select("cluster", "main"), "cluster").where("root <> main").select("cluster", "id"), "apart")
    if apart.isEmpty():
        return small.union(first)
    # every block meets those apart, BLOCK of them at a time
    groups = F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int")
    facing = rows.drop("size").join(main.select("cluster", "size", "most").where("size > most"), "cluster").withColumn("groups", groups)
    apart = apart.withColumn("apart", F.lit(1))
    facing = facing.join(apart, ["cluster", "id"], "left").withColumn("own", F.pmod(F.xxhash64("id", F.lit(2)), F.col("groups")).cast("int"))
    as_block = facing.select("cluster", block.alias("i"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("j"), "id", "set")
    as_apart = facing.where("apart = 1").select("cluster", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"), F.col("own").alias("j"), "id", "set")
    second = _grouped_links(as_block.union(as_apart), ["cluster", "i", "j"], percent)
    return small.union(first).union(second)


def _sized(members: DataFrame) -> DataFrame:
    """(cluster, id, size) of the clusters of more than one member."""
    sizes = stored(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "cluster-sizes")
    return members.join(sizes, "cluster")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(cluster, id): every class in the lists of its rarest shingles, one more than a linked class may lack."""
    owned = stored(sets.select("id", "set").mapInArrow(_explode_sets, "id long, n long, shingle long"), "shingles")
    counts = owned.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("id").orderBy("df", "shingle")
    ranked = owned.join(stored(counts, "shingle-counts"), "shingle").withColumn("r", F.row_number().over(order))
    # two sets of at least percent hundredths have that share of the larger one in common
    longest = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return stored(ranked.where((F.col("r") <= longest) & (F.col("df") > 1)).select(F.col("shingle").alias("cluster"), "id"), "prefixes")


def _explode_sets(batches):
    for batch in batches:
        for i, raw in zip(batch.column("id").to_pylist(), batch.column("set").to_pylist()):
            s = np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i)), pa.array(np.full(len(s), len(s))), pa.array(s)], names=["id", "n", "shingle"])


def minhash_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, kept, text_hash) for each row of docs: groups of texts whose sets of ``width``-word shingles have at least ``percent`` hundredths in common."""
    s = percent / 100
    matches = int(np.floor(COORDINATES * s - 4.5 * np.sqrt(COORDINATES * s * (1 - s))))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.col(id_col).cast("long")
    base = docs.select(own.alias("id"), F.coalesce(own, F.lit(LOWEST)).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))
    rows = stored(base.select("id", "h", "text").mapInArrow(_features(width), "id long, h long, n long, s1 long, s2 long, posts array<long>, sig binary"), "signatures")
    sound = rows.where("n > 0")
    # a class is named by its set; of the texts that have it one is read again
    row = F.struct(F.col("id").isNull().alias("nameless"), F.coalesce("id", F.lit(LOWEST)).alias("k"), "h", "posts", "sig")
    classes = sound.groupBy("s1", "s2").agg(F.min(row).alias("c"), F.min("id").alias("least"))
    classes = stored(classes.select(F.col("s1").alias("id"), "s2", "c.k", "c.h", "c.posts", "c.sig", "least"), "classes")
    if exact:
        wanted = classes.select("id", "k", "h", F.lit(0).cast("long").alias("cluster"), F.lit(0).cast("long").alias("size"))
    else:
        clusters = components(_candidates(classes, matches)).select(F.col("node").alias("id"), F.col("root").alias("cluster"))
        wanted = _sized(stored(clusters, "clusters")).join(classes.select("id", "k", "h"), "id")
    texts = base.select("k", "h", "text").join(wanted, ["k", "h"]).sortWithinPartitions("k", "h", "id").select("id", "cluster", "size", "text")
    sets = stored(texts.mapInArrow(_sets(width), "id long, cluster long, size long, set binary"), "sets")
    if exact:
        sets = stored(_sized(_prefixes(sets, percent)).join(sets.select("id", "set"), "id"), "listed-sets")
    groups = components(_links(sets, percent))
    named = classes.select("id", "s2", "least").join(groups, F.col("id") == F.col("node"), "left").select("id", "s2", "least", F.coalesce("root", "id").alias("root"))
    named = stored(named, "classes-by-group")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(stored(smallest, "groups"), "root").select(F.col("id").alias("s1"), "s2", "component_id")
    alone = rows.where("n = 0").select("id", "h", "n", F.col("id").alias("component_id"))
    out = sound.select("id", "h", "n", "s1", "s2").join(named, ["s1", "s2"]).select("id", "h", "n", "component_id").union(alone)
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), F.col("h").alias("text_hash"))
