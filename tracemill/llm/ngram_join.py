"""Exact Jaccard self-join on word n-grams by token-combination prefixes, and its connected components.

A document is its set of distinct word n-grams (64-bit hashes). Tokens have one global order: rare ones first, frequent
ones last, by hash within each class. A frequent token is one whose cell in a hashed count sketch over all documents
stands out; any such split is correct, a good one keeps buckets small. If two sets are similar enough, at most `miss`
tokens of either are missing in the other. A prefix therefore extends until dropping any `miss` of its tokens leaves,
in some class, enough of them to form an indexed combination: one rare token, or two frequent tokens of one sub-class.

Signatures meet in buckets. Buckets are never expanded into all pairs: first each member is compared with the bucket's
smallest document; verified links are contracted; only buckets that still hold several components go on, small ones
as the pairs across components, large ones in blocks of bounded size that skip what is connected already. All links
that matter for connectivity are therefore found, and every link used was verified on whole sets.

Before texts move, a pair's profiles are compared: counts of its tokens by hash cell, one or two tokens a cell. The
sum of the cells' minima is an upper bound of the intersection, so no linked pair is lost. Of the pairs that may link,
one for each document and other component is verified first; the others only if that leaves them in two components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counting
from . import textarrays as ta
from .components import components
from .shared import Scratch, keep_ids

#: Cells of the count sketch; a task's is 8 MB whatever the input, what is broadcast a bit for each cell.
SKETCH = 1 << 21
#: Sets below so many tokens index single tokens only.
SMALL = 16
#: Buckets up to this many documents are resolved by pairs, larger ones in blocks of BLOCK profiles; texts that meet in one task.
PAIRS, BLOCK, TEXTS = 24, 1024, 128
_U = np.uint64


def gram_sets(w: ta.Words, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; fewer words than n make one token of the whole sequence."""
    at, grams = ta.ngrams(w, n)
    cut = np.searchsorted(at, w.first)
    out = []
    for i, count in enumerate(w.counts):
        if count >= n:
            out.append(np.unique(grams[cut[i] : cut[i + 1]]))
        elif count:
            out.append(ta.gram_hash(w.hash, np.array([w.first[i]]), int(count)))
        else:
            out.append(np.zeros(0, _U))
    return out


def needed(n: int, percent: int) -> int:
    """Fewest tokens that a set of n shares with any set linked to it."""
    return (percent * n + 99) // 100


def signatures(s: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Signature hashes of one sorted set; linked sets have one in common. frequent: a flag for each token."""
    n = len(s)
    if not n:
        return s
    miss = n - needed(n, percent)
    rare = s[~frequent][: miss + 1]
    if len(rare) == miss + 1:
        return rare
    often, out = s[frequent], [rare]
    band = n.bit_length()
    bands = {band} | ({band - 1} if needed(n, percent) < 1 << (band - 1) else set())  # sets linked to it may be in the band below
    for b in bands:
        salt = ta.mix(np.array([b], dtype=_U))
        if 1 << (b - 1) < SMALL:
            out.append(ta.mix(often[: miss + 1 - len(rare)] ^ salt))
            continue
        classes = max(1, (1 << (b - 1)) * (100 - percent) // 100)
        cls = (often >> _U(32)) % _U(classes)
        order = np.argsort(cls, kind="stable")
        again = np.zeros(len(often), dtype=bool)  # not the first of its class
        again[order[1:]] = cls[order[1:]] == cls[order[:-1]]
        cut = int(np.searchsorted(np.cumsum(again), miss + 1 - len(rare))) + 1
        order = order[order < cut]
        kind, token = cls[order], often[order]
        for d in range(1, len(order)):
            same = kind[d:] == kind[:-d]
            if not same.any():
                break
            out.append(ta.mix(token[:-d][same] * _U(3) + ta.mix(token[d:][same] ^ salt)))
    return np.unique(np.concatenate(out))


def _describe(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros(SKETCH, np.int32)
    for run in ta.runs(batches):
        sets = gram_sets(ta.words(ta.column(run, "text"), lower=True), n)
        k = len(sets)
        one = np.array([s.sum(dtype=_U) for s in sets], dtype=_U)
        two = np.array([ta.mix(s).sum(dtype=_U) for s in sets], dtype=_U)
        yield pa.record_batch([ta.column(run, "doc_id"), pa.array([len(s) for s in sets], pa.int64()), ta.signed(one), ta.signed(ta.mix(two)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=_DESCRIBED)
        for some in sets:
            np.add.at(sketch, (some & _U(SKETCH - 1)).astype(np.int64), 1)
    if sketch.any():
        k = SKETCH // counting.PART
        yield pa.record_batch([*(pa.nulls(k, pa.int64()) for _ in range(4)), *counting.parts(sketch)], names=_DESCRIBED)


_DESCRIBED = ["doc_id", "n", "k1", "k2", "part", "counts"]


def _sketch(described: DataFrame) -> np.ndarray:
    return counting.total(described.where("part is not null").select("part", "counts"), SKETCH)


def _sign(batches: Iterator[pa.RecordBatch], n: int, percent: int, frequent) -> Iterator[pa.RecordBatch]:
    cells = np.unpackbits(frequent.value, bitorder="little").astype(bool)
    for run in ta.runs(batches):
        sets = gram_sets(ta.words(ta.column(run, "text"), lower=True), n)
        signed = [ta.signed(signatures(s, cells[s & _U(SKETCH - 1)], percent)) for s in sets]
        at = np.concatenate([[0], np.cumsum([len(s) for s in signed])])
        flat = np.concatenate(signed) if len(signed) else np.zeros(0, np.int64)
        yield pa.record_batch(
            [
                ta.column(run, "doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), flat).cast(pa.list_(pa.int64())),
                pa.array([profile(s).tobytes() for s in sets], pa.binary()),
            ],
            names=["doc_id", "n", "sigs", "profile"],
        )


def profile(s: np.ndarray) -> np.ndarray:
    """Number of tokens in each of a power of two of hash cells; none if a count doesn't fit a byte."""
    k = max(1, len(s).bit_length() - 1)
    counts = np.bincount((s >> _U(64 - k)).astype(np.int64), minlength=1 << k)
    return counts.astype(np.uint8) if counts.max(initial=0) < 256 else np.zeros(0, np.uint8)


def may_link(left: list[np.ndarray], right: list[np.ndarray], n_left: np.ndarray, n_right: np.ndarray, percent: int) -> np.ndarray:
    """For each pair of a left and a right profile, whether the sets can be similar enough."""
    known = [len(x) for x in (*left, *right) if len(x)]
    out = np.ones((len(left), len(right)), dtype=bool)
    out &= (100 * np.minimum(n_left[:, None], n_right[None]) >= percent * np.maximum(n_left[:, None], n_right[None])) & (n_left[:, None] > 0)
    if not known:
        return out
    cells = min(known)
    fold = lambda x: x.reshape(cells, -1).sum(axis=1, dtype=np.uint16) if len(x) else np.full(cells, 65535, np.uint16)
    a, b = np.stack([fold(x) for x in left]), np.stack([fold(x) for x in right])
    for i in np.flatnonzero(out.any(axis=1)):
        most = np.minimum(a[i], b).sum(axis=1, dtype=np.int64)
        out[i] &= 100 * most >= percent * (n_left[i] + n_right - np.minimum(most, n_left[i] + n_right))
    return out


def _plausible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, na, nb, pa, pb) -> (a, b) that can link."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, dtype=bool)
        na, nb = ta.column(batch, "na").to_numpy(), ta.column(batch, "nb").to_numpy()
        for i, (x, y) in enumerate(zip(ta.column(batch, "pa"), ta.column(batch, "pb"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
            keep[i] = may_link([x], [y], na[i : i + 1], nb[i : i + 1], percent)[0, 0]
        yield pa.record_batch([ta.column(batch, "a"), ta.column(batch, "b")], names=["a", "b"]).filter(pa.array(keep))


def _plausible_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (task, side, id, n, c, profile) in order of task and side -> (a, b) of different components that can link."""
    task, sides = None, ([], [])

    def pairs() -> pa.RecordBatch | None:
        left, right = sides[0], sides[1] or sides[0]
        if not left:
            return None
        (ia, na, ca), (ib, nb, cb) = (np.array([x[:3] for x in side], dtype=np.int64).T for side in (left, right))
        ok = may_link([x[3] for x in left], [x[3] for x in right], na, nb, percent) & (ca[:, None] != cb[None])
        if not sides[1]:
            ok &= ia[:, None] < ib[None]
        x, y = np.nonzero(ok)
        return pa.record_batch([pa.array(ia[x]), pa.array(ib[y])], names=["a", "b"]) if len(x) else None

    for batch in batches:
        columns = [ta.column(batch, c).to_pylist() for c in ("task", "side", "id", "n", "c", "profile")]
        for t, side, i, n, c, packed in zip(*columns, strict=True):
            if t != task:
                if (out := pairs()) is not None:
                    yield out
                task, sides = t, ([], [])
            sides[side].append((i, n, c, np.frombuffer(packed, np.uint8)))
    if (out := pairs()) is not None:
        yield out


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right sets."""
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    if not len(both):
        return out

    def cells(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(both, flat)
        hit = both[np.minimum(at, len(both) - 1)] == flat
        return row[hit], at[hit]

    (ra, ca), (rb, cb) = cells(a, left), cells(b, right)
    for lo in range(0, len(both), 1 << 13):
        wide = min(1 << 13, len(both) - lo)
        x, y = np.zeros((len(left), wide), np.float32), np.zeros((len(right), wide), np.float32)
        ka, kb = (ca >= lo) & (ca < lo + wide), (cb >= lo) & (cb < lo + wide)
        x[ra[ka], ca[ka] - lo] = 1
        y[rb[kb], cb[kb] - lo] = 1
        out += (x @ y.T).astype(np.int64)
    return out


def _compare(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (task, side, id, text) in order of task and side -> links of left with right documents; without a right side, of left among themselves."""
    task, sides = None, ([], [])

    def links() -> pa.RecordBatch | None:
        left, right = sides[0], sides[1] or sides[0]
        if not left:
            return None
        ids = [np.array([i for i, _ in x]) for x in (left, right)]
        sets = [[s for _, s in x] for x in (left, right)]
        size = [np.array([len(s) for s in x]) for x in sets]
        common = overlaps(*sets)
        hit = 100 * common >= percent * (size[0][:, None] + size[1][None] - common)
        x, y = np.nonzero(hit & (common > 0))
        found = ids[0][x] != ids[1][y]
        return pa.record_batch([pa.array(ids[0][x][found], pa.int64()), pa.array(ids[1][y][found], pa.int64())], names=["a", "b"]) if found.any() else None

    for run in ta.runs(batches):
        sets = gram_sets(ta.words(ta.column(run, "text"), lower=True), n)
        for t, side, i, s in zip(ta.column(run, "task").to_pylist(), ta.column(run, "side").to_pylist(), ta.column(run, "id").to_pylist(), sets, strict=True):
            if t != task:
                if (out := links()) is not None:
                    yield out
                task, sides = t, ([], [])
            sides[side].append((i, s))
    if (out := links()) is not None:
        yield out


def _verified(docs: DataFrame, tasks: DataFrame, n: int, percent: int) -> DataFrame:
    """tasks(task, side, id): each task compares its two sides, both bounded. Only documents named by a task move."""
    wanted = tasks.select(F.col("id").alias("doc_id")).distinct()
    texts = keep_ids(docs, wanted).join(wanted, "doc_id").select(F.col("doc_id").alias("id"), "text")
    rows = tasks.join(texts, "id").select("task", "side", "id", "text")
    return rows.repartition("task").sortWithinPartitions("task", "side").mapInArrow(lambda it: _compare(it, n, percent), "a long, b long")


def _stars(pairs: DataFrame) -> DataFrame:
    """pairs(a, b) -> tasks that compare a with up to about TEXTS of its partners; a hub with more gets several tasks."""
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TEXTS).alias("parts"))
    dealt = pairs.join(size, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("parts"))).alias("task"))
    return dealt.select("task", F.lit(1).alias("side"), F.col("b").alias("id")).unionByName(dealt.select("task", F.lit(0).alias("side"), F.col("a").alias("id")).distinct())


def _merge_hubs(members: DataFrame) -> DataFrame:
    """members(hub, id, n, c) with hubs whose members also have a smaller hub replaced by it, so that a group that meets in many buckets is compared once."""
    lowest = members.groupBy("id").agg(F.min("hub").alias("low"))
    top = members.join(lowest, "id").groupBy("hub").agg(F.min("low").alias("top"))
    return members.join(top, "hub").select(F.col("top").alias("hub"), "id", "n", "c").distinct()


def _blocks(members: DataFrame, percent: int) -> DataFrame:
    """members(hub, id, n, own): within each hub, tasks that compare blocks of similar size, but for two blocks of the hub's own component."""
    step = float(np.log(100 / percent)) if percent < 100 else 1.0
    members = members.withColumn("bin", F.floor(F.log(F.col("n").cast("double")) / step))
    cell = ["hub", "own", "bin"]
    parts = members.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    placed = members.join(parts, cell).select(*cell, F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "id")
    blocks = placed.select(*cell, "part").distinct()
    left, right = (blocks.select("hub", *(F.col(c).alias(f"{c}_{x}") for c in ("own", "bin", "part"))) for x in "ab")
    in_order = F.struct("own_a", "bin_a", "part_a") <= F.struct("own_b", "bin_b", "part_b")
    pairs = left.join(right, "hub").where(in_order & ~(F.col("own_a") & F.col("own_b")) & (F.abs(F.col("bin_a") - F.col("bin_b")) <= 1))
    pairs = pairs.withColumn("task", F.xxhash64("hub", "own_a", "bin_a", "part_a", "own_b", "bin_b", "part_b"))
    one = F.struct("own_a", "bin_a", "part_a") == F.struct("own_b", "bin_b", "part_b")
    sides = [pairs.where(~one if x == "b" else F.lit(True)).select("hub", "task", F.lit(k).alias("side"), *(F.col(f"{c}_{x}").alias(c) for c in ("own", "bin", "part"))) for k, x in enumerate("ab")]
    return sides[0].unionByName(sides[1]).join(placed, [*cell, "part"]).select("task", "side", "id")


def ngram_classes(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_shingles, component_id), one row for each row of docs.

    Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of distinct word n-grams; A-Z count as
    a-z, words are runs of anything but ASCII white space. component_id is the smallest doc_id reachable by links, its
    own without any. Texts without words (null, empty, blank) have no set and link with nothing; a text of fewer words
    than an n-gram is one token. Rows of one doc_id with different texts are one node of the graph. A row without
    doc_id takes no part: its component_id is null. An empty table gives no rows. Other columns are not read.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent is over 50 and at most 100")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = scratch.save(docs.mapInArrow(lambda it: _describe(it, shingle), "doc_id long, n long, k1 long, k2 long, part int, counts binary"), "described")
    counts = _sketch(described)
    frequent = spark.sparkContext.broadcast(np.packbits(counts > counts.mean() + 6 * np.sqrt(counts.mean()) + 16, bitorder="little"))
    rows = described.where("part is null").select("doc_id", "n", "k1", "k2")
    same = scratch.save(rows.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.max("n").alias("n")), "classes")

    signed = docs.mapInArrow(lambda it: _sign(it, shingle, percent, frequent), "doc_id long, n long, sigs array<long>, profile binary")
    signed = signed.join(same.select(F.col("id").alias("doc_id"), "n").distinct(), ["doc_id", "n"], "left_semi")  # one document of each class of equal sets
    signed = scratch.save(signed.withColumnRenamed("doc_id", "id"), "signed")
    index = signed.select("id", F.col("n").cast("int").alias("n"), F.explode("sigs").alias("sig"))
    buckets = index.groupBy("sig").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    met = scratch.save(index.join(buckets, "sig").select("sig", "hub", "size", "id", "n"), "buckets")
    profiles = signed.select("id", "n", "profile")

    def plausible(pairs: DataFrame) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(profiles.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("profile").alias(f"p{x}")), x)
        return pairs.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(lambda it: _plausible(it, percent), "a long, b long")

    stars = met.where("id <> hub").groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.max("n").alias("n"))
    strong = scratch.save(stars.where(F.col("shared") * 400 > F.col("n") * (100 - percent)).select("a", "b"), "stars")
    links = scratch.save(_verified(docs, _stars(scratch.save(plausible(strong), "plausible")), shingle, percent), "links")
    joined = components(links, scratch).withColumnRenamed("node", "id")

    own = met.join(joined, "id", "left").withColumn("c", F.coalesce("component", "id"))
    split = own.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("sig")
    open_ = scratch.save(own.join(split, "sig").select("sig", "hub", "size", "id", "n", "c"), "open")
    scratch.drop(met)
    few = open_.where(F.col("size") <= PAIRS)
    pairs = few.select("sig", F.col("id").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na")).join(few.select("sig", F.col("id").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb")), "sig")
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))).select("a", "b").distinct()
    of_hub = joined.select(F.col("id").alias("hub"), F.col("component").alias("hub_c"))
    many = _merge_hubs(scratch.save(open_.where(F.col("size") > PAIRS).select("hub", "id", "n", "c").distinct(), "hubs")).join(of_hub, "hub", "left")
    many = scratch.save(many.select("hub", "id", "n", "c", (F.col("c") == F.coalesce("hub_c", "hub")).alias("own")), "large")
    in_blocks = _blocks(many, percent).join(many.select("id", "c").distinct(), "id").join(profiles, "id")
    in_blocks = in_blocks.select("task", "side", "id", "n", "c", "profile").repartition("task").sortWithinPartitions("task", "side").mapInArrow(lambda it: _plausible_blocks(it, percent), "a long, b long")
    named = {x: joined.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"}
    more = plausible(pairs).unionByName(in_blocks).distinct().join(strong, ["a", "b"], "left_anti")
    more = more.join(named["a"], "a", "left").join(named["b"], "b", "left")
    more = scratch.save(more.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "more")
    first = scratch.save(more.groupBy("a", "cb").agg(F.min("b").alias("b")).select("a", "b"), "first")
    links = links.unionByName(scratch.save(_verified(docs, _stars(first), shingle, percent), "first_links"))
    now = components(links.select("a", "b"), scratch)
    rest = more.select("a", "b").join(first, ["a", "b"], "left_anti")
    for x in "ab":
        rest = rest.join(now.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x, "left")
    rest = scratch.save(rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "rest")
    links = links.unionByName(scratch.save(_verified(docs, _stars(rest), shingle, percent), "rest_links"))
    scratch.drop(open_, signed)
    # equal sets are one node; rows of one doc_id are one node as well
    equal = rows.where("n > 0 and doc_id is not null").join(same.select("k1", "k2", "id"), ["k1", "k2"]).where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    final = components(links.select("a", "b").unionByName(equal), scratch)
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
