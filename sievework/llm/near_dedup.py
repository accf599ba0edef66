"""MinHash near-duplicates with sequential Bayesian verification.

1. One scan gives each text its distinct word shingles' number, a key of the set, a MinHash signature and
   band hashes. Texts of equal sets form a class, which gets a number.
2. Within each band bucket, signatures are compared batch by batch; a pair is pruned once the posterior
   probability that its similarity reaches the threshold falls below the miss probability. What survives
   connects classes to suspect groups; one link for each class joined is all that is written.
3. The classes of suspect groups come together with their full sets. Pairs that the posterior doesn't prune
   are confirmed on the full sets, unless their classes are linked already.
4. Components of the links, and of classes that share an id, give each document its component.

Buckets and groups are cut into blocks of bounded size. Blocks are first linked within themselves; then one
class of each linked part stands for it, and these are linked in blocks again, until those of a bucket fit a
block. Only what isn't linked to the largest part of its bucket then is compared across blocks. No pair within
a linked part is compared or written, and none outside is left out: there is no cap on buckets or partners.

At 32 bands of 4 rows, a pair of similarity 0.8 shares no bucket with probability 5e-8; it is pruned with
probability 1e-5 at most. Shingles are compared by 64-bit hashes, sets by 128-bit ones.

A set: distinct shingles of the lower-cased (A-Z) words; with fewer words than a shingle has, the whole
sequence as one. Very long texts are sets like others. Texts without words, and null texts, have empty sets
and are linked with nothing; their component is their own id. Rows that share an id are one node of the graph,
whatever their texts. A row with a null id is linked like others, shows the component of its text, null where
that has no id at all, and is never kept. Repeated rows stay. Other columns aren't read, so their names don't
matter. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import among, in_arrow, packed, slices, staged, unpacked, with_table, without

WORDS, THRESHOLD = 5, (80, 100)
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Signature entries compared at once, and the chance at which a pair of the threshold's similarity may be pruned.
BATCH, MISS = 32, 1e-5
#: Classes of a block in step 2, shingles of a block in step 3.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 100_000
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of one text."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if n < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), n)] if n else [], np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, found)), np.uint64)
    out = np.zeros(n - words + 1, np.uint64)
    for k in range(words):
        out *= _PLACES[0]
        out += h[k : n - words + 1 + k] * _PLACES[1 + k % 3]
        out ^= out >> np.uint64(29)
    out *= _PLACES[2]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def set_key(found: np.ndarray) -> bytes | None:
    """The name of a set; none for the empty set."""
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_011)
    return rng.integers(1, 2**62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each) of a set of one shingle at least."""
    a, b = _functions()
    least = None
    for k in range(0, len(found), 512):
        got = ((found[k : k + 512, None] * a + b) >> np.uint64(32)).astype(np.uint32).min(0)
        least = got if least is None else np.minimum(least, got)
    return least


def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """After n compared entries, the smallest number of matches that isn't pruned. With a uniform prior, the
    posterior of similarity >= t after m of n matches is the chance of m hits at most in n + 1 throws at t."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def profile(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """doc, n (shingles), set (key of the set), sig (16 bits of each entry) and bands of each row."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in slices(batches, text):
            n, sets, sigs, bands = [], [], [], []
            for t in part.column(text).to_pylist():
                found = shingles(t, words)
                n.append(len(found))
                sig = signature(found) if len(found) else None
                sets.append(set_key(found))
                sigs.append(None if sig is None else sig.astype("<u2").tobytes())
                raw = b"" if sig is None else sig.tobytes()
                bands.append(
                    None if sig is None else [xxhash.xxh3_64_intdigest(raw[b * ROWS * 4 : (b + 1) * ROWS * 4], b) - 2**63 for b in range(BANDS)]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(key), pa.array(n, pa.int64()), pa.array(sets, pa.binary()),
                    pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))
                ],
                ["doc", "n", "set", "sig", "bands"]
            )

    kept = docs.select(f"`{key}`", f"`{text}`")
    return in_arrow(kept, run, f"doc {kept.schema[key].dataType.simpleString()}, n long, set binary, sig binary, bands array<long>")


def full_sets(docs: DataFrame, text: str, words: int) -> DataFrame:
    """set (its key) and items (its shingles) of each row that has any."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            found = [shingles(t, words) for t in part.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(map(set_key, found)), pa.binary()), pa.array([f.tobytes() for f in found], pa.binary())],
                ["set", "items"]
            )

    return in_arrow(docs.select(f"`{text}`"), run, "set binary, items binary").where("set IS NOT NULL")


class Block:
    """Classes of a block, linked in memory. Parts are known to belong together; each has a number for its name."""

    def __init__(
        self, docs: list, parts: list, sizes: np.ndarray, sigs: list[bytes], items: list[bytes] | None,
        ours: np.ndarray | None, threshold: tuple[int, int]
    ):
        self.docs, self.sizes, self.threshold = docs, sizes, threshold
        self.sig = np.frombuffer(b"".join(sigs), "<u2").reshape(len(docs), HASHES)
        self.names, self.part = np.unique(np.array(parts, np.int64), return_inverse=True)
        self.names = self.names.tolist()
        self.ours = ours
        self.bounds = least_bounds(threshold)
        if items is not None:
            # places of the shingles in the block's own dictionary; each class's stand together
            lengths = np.array([len(x) // 8 for x in items])
            self.local = np.unique(np.frombuffer(b"".join(items), np.uint64), return_inverse=True)[1]
            self.start = np.concatenate([[0], np.cumsum(lengths)])
            self.flag = np.zeros(int(self.local.max(initial=-1)) + 1, bool)
        self.items = items

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of others that the posterior doesn't prune."""
        least, whole = self.threshold
        a, b = self.sizes[i], self.sizes[others]
        others = others[np.minimum(a, b) * whole >= least * np.maximum(a, b)]
        matches = np.zeros(len(others), np.int64)
        for n, need in self.bounds:
            if not len(others):
                break
            matches = matches + (self.sig[others, n - BATCH : n] == self.sig[i, n - BATCH : n]).sum(1)
            others, matches = others[matches >= need], matches[matches >= need]
        return others

    def confirmed(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of others whose full sets reach the threshold."""
        if self.items is None or not len(others):
            return others
        mine = self.local[self.start[i] : self.start[i + 1]]
        self.flag[mine] = True
        common = np.array([np.count_nonzero(self.flag[self.local[self.start[j] : self.start[j + 1]]]) for j in others])
        self.flag[mine] = False
        least, whole = self.threshold
        return others[whole * common >= least * (self.sizes[i] + self.sizes[others] - common)]

    def links(self) -> list[tuple]:
        """Links between the names of parts: of those that belong together, the smallest with each other one."""
        index, count = np.arange(len(self.docs)), len(self.names)
        first = np.zeros(count, np.int64)
        first[self.part[::-1]] = index[::-1]
        for i in index if self.ours is None else index[self.ours]:
            away = self.part != self.part[i]
            # all pairs once; or, across blocks, ours with the others
            others = index[away & (index > i)] if self.ours is None else index[away & ~self.ours]
            for j in self.confirmed(i, self.similar(i, others)):
                if self.part[i] != self.part[j]:
                    self.part[self.part == self.part[j]] = self.part[i]
        self.roots: dict[int, int] = {}
        order = sorted(range(count), key=self.names.__getitem__)
        return [(self.names[self.roots[now]], self.names[p]) for p in order if self.roots.setdefault(now := int(self.part[first[p]]), p) != p]


@lru_cache(maxsize=8)
def least_bounds(threshold: tuple[int, int]) -> tuple:
    return tuple(least_matches(threshold[0] / threshold[1]))


def _groups(batches: Iterator, names: list[str]) -> Iterator[list]:
    """Columns of the rows of each run of equal names, of batches sorted by them."""
    held, at = None, None
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        keys = list(zip(*(cols[n] for n in names), strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                part = {n: v[start:i] for n, v in cols.items()}
                if at == keys[start]:
                    for n, v in part.items():
                        held[n] += v
                else:
                    if held:
                        yield held
                    held, at = part, keys[start]
                start = i
    if held:
        yield held


_FOUND = "u long, v long, bucket long, n long, blocks int"


def _linker(threshold: tuple[int, int]) -> Callable:
    """Arrow function from rows sorted by bucket and blocks to links (u, v), and for buckets of several blocks to the
    heads of the parts of each block: bucket, u, n and the number of blocks."""
    import pyarrow as pa

    kinds = [pa.int64()] * 4 + [pa.int32()]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
            ["u", "v", "bucket", "n", "blocks"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, many = [], 10_000
        for g in _groups(batches, ["bucket", "p", "q"]):
            ours = np.array(g["ours"]) if g["ours"][0] is not None else None
            block = Block(g["doc"], g["part"], np.array(g["n"]), g["sig"], g.get("items"), ours, threshold)
            out += [(u, v, None, None, None) for u, v in block.links()]
            if ours is None and g["blocks"][0] > 1:
                n = dict(zip(g["doc"], g["n"], strict=True))
                heads = [block.names[p] for p in block.roots.values()]
                out += [(h, None, g["bucket"][0], n[h], g["blocks"][0]) for h in heads]
            if len(out) >= many:
                yield emit(out)
                out = []
        if out:
            yield emit(out)

    return run


def _to_roots(hooks: DataFrame) -> DataFrame:
    """node and root of a forest of node and root (a node's parent, a root's own): each pass halves the depth."""
    while True:
        up = hooks.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("_up"))
        deep = staged(hooks.join(up, "root").select("node", F.col("_up").alias("root")), "deep")
        if deep.isEmpty():
            return hooks
        rest = hooks.join(deep.select("node"), "node", "left_anti")
        hooks = staged(rest.select("node", "root").unionAll(deep), "roots")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of an undirected graph's edges u, v.

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots and contracts the
    edges. A node that nothing hooks to has only smaller neighbours in the next round, and hooks then; so two
    rounds halve the nodes at least, and the number of rounds is logarithmic, as that of passes in a round."""
    edges = staged(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    known = None
    while not edges.isEmpty():
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = _to_roots(
            staged(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "hooks")
        )
        if known is None:
            known = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            known = staged(known.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root")), "roots")
        a, b = hooks.select(F.col("node").alias("u"), F.col("root").alias("ru")), hooks.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        moved = edges.join(a, "u").join(b, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
        edges = staged(moved.distinct(), "edges")
    if known is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return known


def linked(members: DataFrame, payload: DataFrame, weight: Column, most: int, threshold: tuple[int, int]) -> DataFrame:
    """Components (node, root) of the links between members (bucket, doc, n) of equal buckets; nodes without a link are
    left out. payload: by doc, what a block needs. Blocks hold `most` of weight, or one member."""
    cols = [c for c in payload.columns if c != "doc"]
    none = F.lit(None).cast("boolean")

    def link(rows: DataFrame) -> DataFrame:
        full = rows.join(payload, "doc").select(*rows.columns, *cols)
        together = full.repartition(F.col("bucket"), F.col("p"), F.col("q")).sortWithinPartitions("bucket", "p", "q")
        return in_arrow(together, _linker(threshold), _FOUND)

    def in_blocks(rows: DataFrame) -> DataFrame:
        """rows (bucket, doc, n) of buckets with two members at least, with the number of their block and of blocks."""
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_m"), F.sum(weight).alias("_w")).where("_m > 1")
        sized = rows.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("_w") / most).cast("int"))
        return sized.drop("_m", "_w").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))

    def within(rows: DataFrame) -> DataFrame:
        at = F.col("block")
        return staged(
            link(rows.select("bucket", at.alias("p"), at.alias("q"), "doc", F.col("doc").alias("part"), "n", none.alias("ours"), "blocks")),
            "within"
        )

    blocked = staged(in_blocks(members), "members")
    found = within(blocked)
    links, heads = found.where("v IS NOT NULL").select("u", "v"), found.where("v IS NULL")
    large = blocked.where("blocks > 1")
    if large.isEmpty():
        return components(links)
    while not heads.isEmpty():
        # of buckets that a block doesn't hold, one class stands for each part; while that leaves half the blocks at most
        fewer = in_blocks(heads.select("bucket", F.col("u").alias("doc"), "n", F.col("blocks").alias("_before")))
        found = within(fewer.where("2 * blocks <= _before"))
        links, heads = links.unionAll(found.where("v IS NOT NULL").select("u", "v")), found.where("v IS NULL")
    known = components(links)
    # across blocks: what is outside the largest part of its bucket, with everything of another part
    parted = large.join(known, F.col("doc") == F.col("node"), "left").withColumn("part", F.coalesce("root", "doc")).drop("node", "root")
    parted = staged(parted, "parted")
    main = parted.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket").agg(
        F.max_by("part", F.struct("c", "part")).alias("main")
    )
    minor = staged(parted.join(main, "bucket").where("part <> main").drop("main"), "minor")
    if minor.isEmpty():
        return known
    few = minor.groupBy("bucket").agg(F.ceil(F.sum(weight) / most).cast("int").alias("rows"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    ours = minor.join(few, "bucket").select(
        "bucket", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("rows")).cast("int").alias("p"),
        spread(F.col("blocks")).alias("q"), "doc", "part", "n", F.lit(True).alias("ours"), "blocks"
    )
    theirs = parted.join(few, "bucket").select(
        "bucket", spread(F.col("rows")).alias("p"), F.col("block").alias("q"), "doc", "part", "n",
        F.lit(False).alias("ours"), "blocks"
    )
    more = components(staged(link(ours.unionAll(theirs)), "across").select("u", "v"))
    # roots that are joined by now, and nodes that had no link before
    above = more.select(F.col("node").alias("root"), F.col("root").alias("_top"))
    moved = known.join(above, "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
    return staged(moved.unionAll(more.join(known.select("node"), "node", "left_anti").select("node", "root")), "linked")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
    threshold: tuple[int, int] = THRESHOLD
) -> DataFrame:
    """key, n_shingles, component_id and kept of each row."""
    rows = staged(profile(docs, key, text, words), "profiles")
    full = rows.where(F.col("set").isNotNull())
    classes = full.groupBy("set").agg(
        F.min("doc").alias("least"), F.min("n").alias("n"), F.first("sig").alias("sig"),
        F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies")
    )
    # the numbers are written, so that they stay
    classes = staged(classes.withColumn("doc", F.monotonically_increasing_id()), "classes")
    buckets = classes.select("doc", "n", F.posexplode("bands").alias("band", "hash")).select("doc", "n", F.xxhash64("band", "hash").alias("bucket"))
    suspects = linked(buckets, classes.select("doc", "sig"), F.lit(1), BLOCK_CLASSES, threshold)
    groups = suspects.join(classes, F.col("node") == F.col("doc")).select(F.col("root").alias("bucket"), "doc", "set", "least", "n", "sig")
    groups = staged(groups, "suspects")
    # other texts of the ids that stand for the classes are read with them, and find no class in the join
    wanted = among(docs.select(f"`{key}`", f"`{text}`"), key, groups, "least")
    sets = full_sets(wanted, text, words).groupBy("set").agg(F.first("items").alias("items"))
    payload = staged(groups.select("doc", "set", "sig").join(sets, "set").drop("set"), "sets")
    found = linked(groups.select("bucket", "doc", "n"), payload, F.col("n"), BLOCK_SHINGLES, threshold)
    # classes that share an id
    known = full.where(F.col("doc").isNotNull()).select("doc", "set")
    several = known.groupBy("doc").agg(F.min("set").alias("a"), F.max("set").alias("b")).where("a <> b").select("doc", "a")
    number = lambda c, name: classes.select(F.col("set").alias(c), F.col("doc").alias(name))
    shared = staged(known.join(several, "doc").where("a <> set").select("a", "set").distinct(), "shared")
    if not shared.isEmpty():
        pairs = shared.join(number("a", "u"), "a").join(number("set", "v"), "set").select("u", "v")
        found = components(pairs.unionAll(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))))
    named = found.join(classes.select("doc", "set", "least"), F.col("node") == F.col("doc")).select("set", "root", "least")
    tops = named.groupBy("root").agg(F.min("least").alias("top"))
    tops = staged(named.select(F.col("set").alias("_set"), "root").join(tops, "root").select("_set", "top"), "components")
    names = classes.select("set", "least", "copies").join(tops, F.col("set") == F.col("_set"), "left").select(
        "set", F.coalesce("top", "least").alias("_component"), "copies"
    )
    # a text of which there are very many copies has a row of its own in every task
    total = classes.agg(F.sum("copies")).first()[0] or 0
    out = with_table(rows.select("doc", "n", "set"), names, "set", "copies", total)
    component = F.coalesce("_component", "doc")
    return out.select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(False)).alias("kept")
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """docs with one row of each group of near-duplicates: of the smallest id (null ids last), and of its texts the one
    of the smallest hash; of repeated rows one. Rows with one id and different texts are documents of their own here.
    Rows without words all stay."""
    own = F.struct(F.col(f"`{key}`").isNull().alias("z"), F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    keyed = packed(docs, own=own)
    found = near_duplicates(keyed.select("own", F.col("row").getField(text).alias("text")), "own", "text", words, threshold)
    found = staged(found.groupBy("own", "kept").agg(F.count(F.lit(1)).alias("c"), F.max("n_shingles").alias("n")), "marked")
    again = found.where("kept and c > 1 and n > 0").select("own")
    rest = without(keyed, "own", found.where("not kept").select("own").unionAll(again), "own")
    # repeated rows meet by a hash of their key; one a task is left before they move
    once = among(keyed, "own", again, "own").dropDuplicates(["own"])
    return unpacked(rest.unionAll(once), docs.columns)
