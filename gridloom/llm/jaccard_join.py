"""N-gram Jaccard self-join over a prefix tree, exact, with connected components.

Sets are the distinct five-word shingles of texts as 63-bit hashes. The global order of
n-grams is by hash, except that those in crowded cells of a counting table over all n-grams
come last, so passages that many documents share do not lead anybody's prefix. Equal sets are
one class from the start.

Two sets that reach the threshold share many n-grams of their first three tenths; a document
with fewer shared ones there than any partner would give cannot link and is left out. The
rest is grouped by its first shared n-grams of each class of frequency (branches at the root of
the tree), leaving out groups whose members all met in an earlier one. Each group's sets are stored in a tree in global order and all other sets'
overlaps are carried along its branches as one vector, shared by the sets below; a branch is
left as soon as what remains cannot bring any overlap to its bound. Pairs of different
components that never met in a group are listed from their shared prefix n-grams, filtered by the number shared, and
verified in the same tree. No pair inside a component is needed and none between
components is skipped.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.batches import frugal
from gridloom.llm.shared import compact, components, dropped, sized, stored, table
from gridloom.llm.shingles import shingle_hashes
from gridloom.llm.tokenizing import plain_text

#: Cells of the counting table (a power of two), slices in which it is summed, members of a group before it is dealt out.
CELL_BITS, SLICES, GROUP = 18, 64, 4096
#: Groups that a document joins: its first shared n-grams, so many of each class of frequency (powers of 4).
PICKS = 3
#: Sets of a group that are compared with all others first, members of a list that are compared at once, pairs of a packed row batch.
HUBS, FEW, PAIRS = 8, 256, 1 << 19
#: Keys of copies that are broadcast (32 MB).
COPIES = 4 << 20
_TOP = np.uint64(1 << 63)


def need(n):
    """The least overlap with any partner at Jaccard 0.8 for a set of n: ceil(4n/5)."""
    return (4 * n + 4) // 5


def lead(n):
    """Shared n-grams that a prefix of ``n - need(n) + lead(n)`` n-grams holds at least."""
    return np.maximum(1, n // 10) if isinstance(n, np.ndarray) else max(1, n // 10)


def pair_need(a, b):
    """The least overlap of sets of a and b at Jaccard 0.8: 100 k >= 80 (a + b - k)."""
    return (4 * (a + b) + 8) // 9


def sets_of(texts):
    """The sets of texts: sorted distinct 63-bit hashes."""
    for h in shingle_hashes(texts):
        yield np.unique(h >> np.uint64(1))


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(63 - CELL_BITS)).astype(np.int64)


def _scan(batches):
    """Rows (doc_id, n, key) of documents, and at the end slices of this task's counting table."""
    counts = np.zeros(1 << CELL_BITS, np.int64)
    none = pa.nulls
    for b in frugal(batches, 1):
        ns, keys = [], []
        for s in sets_of(plain_text(b.column(1))):
            np.add.at(counts, _cells(s), 1)
            ns.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
        k = b.num_rows
        yield pa.record_batch([b.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), none(k, pa.int32()), none(k, pa.binary())], ["doc_id", "n", "key", "slice", "counts"])
    rows = [zlib.compress(x.astype("<i8").tobytes(), 1) for x in np.split(counts, SLICES)]
    yield pa.record_batch([none(SLICES, pa.int64()), none(SLICES, pa.int64()), none(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(rows, pa.binary())], ["doc_id", "n", "key", "slice", "counts"])


def _crowded(limit):
    def run(batches):
        sums: dict = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(c), "<i8")
        for k, c in sums.items():
            yield pa.record_batch([pa.array(np.flatnonzero(c > limit) + k * len(c))], ["cell"])

    return run


def _ordered(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """A set in global order: crowded n-grams, marked by the top bit, last."""
    return np.sort(s | (hot[_cells(s)].astype(np.uint64) << np.uint64(63)))


def _signed(s: np.ndarray) -> np.ndarray:
    return (s ^ _TOP).view(np.int64)


def _absent(ids: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which ids the sorted array doesn't have."""
    return np.searchsorted(held, ids, "right") == np.searchsorted(held, ids, "left")


def _packed_ids(batches):
    for b in batches:
        yield pa.record_batch([pa.array([b.column(0).to_numpy().tobytes()], pa.binary())], ["ids"])


def _postings(held, copies):
    """Prefix n-grams (token, doc_id, n); ``copies`` and sets that this task has seen before give none."""

    def run(batches):
        hot, seen, skipped = held.value, set(), copies.value
        for b in frugal(batches, 1):
            b = b.filter(pa.array(_absent(b.column(0).to_numpy(), skipped)))
            tokens, ids, ns = [], [], []
            for d, s in zip(b.column(0).to_pylist(), sets_of(plain_text(b.column(1)))):
                key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                p = _ordered(s, hot)[: len(s) - need(len(s)) + lead(len(s))]
                tokens.append(_signed(p))
                ids.append(np.full(len(p), d))
                ns.append(np.full(len(p), len(s), np.int32))
            if tokens:
                yield pa.record_batch([np.concatenate(tokens), np.concatenate(ids), np.concatenate(ns)], ["token", "doc_id", "n"])

    return run


def _shared(batches):
    """Of rows sorted by token, those whose token has more than one."""
    kept = None

    def some(t, whole):
        token = t.column(0).to_numpy()
        cut = len(token) if whole else int(np.searchsorted(token, token[-1], "left"))
        if not cut:  # one token so far
            return t.slice(0, 0), t
        same = token[1:cut] == token[: cut - 1]
        keep = np.zeros(cut, bool)
        keep[1:] |= same
        keep[:-1] |= same
        return t.slice(0, cut).filter(pa.array(keep)), t.slice(cut)

    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b])
            kept = t if kept is None else pa.concat_tables([kept, t])
            out, kept = some(kept.combine_chunks(), False)
            yield from out.to_batches()
    if kept is not None and kept.num_rows:
        yield from some(kept.combine_chunks(), True)[0].to_batches()


def _packed_sets(held):
    def run(batches):
        for b in frugal(batches, 1):
            sets = [_ordered(s, held.value) for s in sets_of(plain_text(b.column(1)))]
            yield pa.record_batch([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "n", "grams"])

    return run


def _root(parent: dict, x: int) -> int:
    while parent.get(x, x) != x:
        parent[x] = parent.get(parent[x], parent[x])
        x = parent[x]
    return x


def tree_links(sets: list[np.ndarray], labels: np.ndarray, probes: np.ndarray | None = None):
    """Pairs (i, j) of sets (sorted, in global order) that link, enough to connect all that do.

    Pairs of one label are taken as connected already. With ``probes`` only pairs with one of
    them count. The most central sets are compared with all others first, which connects copies
    of one text. Where few sets are left outside the largest component, or few probes are given, every pair
    still open has an end among them and they are compared with all. Otherwise the sets are kept
    as a tree: sorted, a range of them with a common beginning is a node, and overlaps with all sets are
    carried down as a vector.
    """
    full = np.array([len(s) for s in sets])
    vocab, where, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[where]
    seqs = [r[r >= 0] for r in np.split(rank, np.cumsum(full)[:-1])]
    m = np.array([len(s) for s in seqs])
    alive = np.flatnonzero((m >= need(full)) & (m > 0))
    if len(alive) < 2:
        return
    alive = np.array(sorted(alive.tolist(), key=lambda i: seqs[i].astype(">u4").tobytes()))
    seqs, full, m, tags = [seqs[i] for i in alive], full[alive], m[alive], labels[alive]
    asks = np.ones(len(alive), bool) if probes is None else probes[alive]
    k = len(seqs)
    # which sets have an n-gram: lists one after the other
    order = np.argsort(np.concatenate(seqs), kind="stable")
    owners = np.repeat(np.arange(k), m)[order]
    size = np.bincount(np.concatenate(seqs), minlength=int((count > 1).sum()))
    first = np.cumsum(size) - size
    comp = np.unique(tags, return_inverse=True)[1]

    def counted(grams):
        """How many of the n-grams each set has."""
        lists = np.repeat(first[grams] - (np.cumsum(size[grams]) - size[grams]), size[grams]) + np.arange(int(size[grams].sum()))
        return np.bincount(owners[lists], minlength=k)

    def joined(i, over, among):
        """Connects set i and those among the others that reach the threshold."""
        for j in np.flatnonzero((over >= pair_need(full, full[i])) & among & (comp != comp[i]) & (asks | asks[i])).tolist():
            if comp[i] != comp[j]:
                comp[comp == comp[j]] = comp[i]
                yield int(alive[i]), int(alive[j])

    def star(i):
        over = np.zeros(k, np.int64)
        for at in range(0, len(seqs[i]), 64):
            over += counted(seqs[i][at : at + 64])
        return joined(i, over, np.ones(k, bool))

    if k >= 8:
        central = np.array([size[s].sum() for s in seqs]) / full
        for _ in range(HUBS):
            outside = np.flatnonzero((comp != np.bincount(comp).argmax()) & asks)
            if not len(outside):
                break
            links = list(star(int(outside[central[outside].argmax()])))
            yield from links
            if 16 * len(links) < len(outside):
                break
    if (comp == comp[0]).all():
        return
    ends = min(np.flatnonzero(asks), np.flatnonzero(comp != np.bincount(comp).argmax()), key=len)
    if 4 * len(ends) <= k:
        for i in ends.tolist():
            yield from star(i)
        return

    common = np.zeros(k, np.int64)
    for i in range(1, k):
        a, b = seqs[i - 1], seqs[i]
        n = min(len(a), len(b))
        diff = a[:n] != b[:n]
        common[i] = int(diff.argmax()) if diff.any() else n
    stack = [(0, k, 0, np.zeros(k, np.int64))]
    while stack:
        lo, hi, depth, over = stack.pop()
        later = np.arange(k) > lo
        if (comp[lo:hi] == comp[lo]).all():
            later &= comp != comp[lo]
        stop = int(common[lo + 1 : hi].min()) if hi - lo > 1 else int(m[lo])
        least, longest = int(full[lo:hi].min()), int(m[lo:hi].max())
        bound = np.maximum(pair_need(full, least), 0)
        gone = not later.any()
        while depth < stop and not gone:
            step = seqs[lo][depth : min(depth + 64, stop)]
            over = over + counted(step)
            depth += len(step)
            # what is left on this branch, and in each other set
            gone = not (later & (over + np.minimum(longest - depth, m - over) >= bound)).any()
        if gone:
            continue
        if hi - lo == 1:
            yield from joined(lo, over, later)
            continue
        cuts = [lo, *(np.flatnonzero(common[lo + 1 : hi] == stop) + lo + 1).tolist(), hi]
        stack += [(a, b, stop, over) for a, b in zip(cuts, cuts[1:])]


def _grouped(batches):
    """Runs of rows (g1, g2, rep, label, probe, grams) with one (g1, g2)."""
    key, rows = None, []
    for b in frugal(batches, 5):
        cols = [c.to_pylist() for c in b.columns]
        for g1, g2, *row in zip(*cols):
            if (g1, g2) != key and rows:
                yield rows
                rows = []
            key = (g1, g2)
            rows.append(row)
    if rows:
        yield rows


def _link(batches):
    for rows in _grouped(batches):
        if len(rows) < 2:
            continue
        reps = [r[0] for r in rows]
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        parent: dict = {}
        for i, j in tree_links(sets, np.array([r[1] for r in rows]), np.array([r[2] for r in rows])):
            a, b = sorted((_root(parent, reps[i]), _root(parent, reps[j])))
            if a != b:
                parent[b] = a
        if parent:  # stars around the smallest
            yield pa.record_batch([pa.array([_root(parent, x) for x in parent], pa.int64()), pa.array(list(parent), pa.int64())], ["a", "b"])


def _unmet(t):
    """Pairs (x, its n, y, its n) of reps x < y of different labels under one token that no group has compared, in arrays.

    Short lists are compared all at once, by the distance of two rows. In a long one each member outside
    the most frequent label is compared with all others; no pair inside that label is looked at.
    """
    token, rep, n, label = (t.column(i).to_numpy() for i in range(4))
    lists = t.column(4).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, offs = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    held = np.diff(offs)
    picks = flat[offs[:-1, None] + np.minimum(np.arange(held.max()), held[:, None] - 1)]  # short rows repeat their last
    here = (picks == token[:, None]).any(axis=1)  # in the token's own group

    def open_pairs(i, j):
        ok = (label[i] != label[j]) & ~(here[i] & here[j]) & (np.minimum(n[i], n[j]) >= need(np.maximum(n[i], n[j])))
        i, j = i[ok], j[ok]
        met, other = np.zeros(len(i), bool), picks[j]
        for c in picks[i].T:
            met |= (other == c[:, None]).any(axis=1)
        i, j = i[~met], j[~met]
        i, j = np.where(rep[i] < rep[j], i, j), np.where(rep[i] < rep[j], j, i)
        return rep[i], n[i], rep[j], n[j]

    cuts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
    size = np.diff(cuts)
    end = np.repeat(np.where(size <= FEW, cuts[1:], 0), size)
    for d in range(1, min(FEW, int(size.max()))):
        i = np.flatnonzero(np.arange(len(token)) + d < end)
        yield open_pairs(i, i + d)
    for k in np.flatnonzero(size > FEW).tolist():
        part = np.arange(cuts[k], cuts[k + 1])
        names, at, count = np.unique(label[part], return_inverse=True, return_counts=True)
        most = at == count.argmax()
        # the list's 64 most frequent groups as bits: most pairs have met in one of them
        groups, at, count = np.unique(picks[part], return_inverse=True, return_counts=True)
        bit = np.zeros(len(groups), np.uint64)
        often = np.argsort(-count)[:64]
        bit[often] = np.uint64(1) << np.arange(len(often), dtype=np.uint64)
        bits = np.bitwise_or.reduce(bit[at.reshape(len(part), -1)], axis=1)
        for x in np.flatnonzero(~most).tolist():
            i = int(part[x])
            j = part[(most | (part > i)) & (bits & bits[x] == 0)]
            if not len(j):
                continue
            yield open_pairs(np.full(len(j), i), j)


def _listed(batches):
    """Of rows (token, rep, n, label, picks) sorted by token: for each rep those after it that no group has compared."""

    def packed(found):
        x, nx, y, ny = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(x, kind="stable")
        x, nx, both = x[order], nx[order], np.stack([y[order], ny[order]])
        cuts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])).tolist()
        blobs = [both[:, a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        return pa.record_batch([pa.array(x[cuts[:-1]], pa.int64()), pa.array(nx[cuts[:-1]], pa.int64()), pa.array(blobs, pa.binary())], ["rep", "n", "others"])

    def out(t):
        found, rows = [], 0
        for pairs in _unmet(t):
            if len(pairs[0]):
                found.append(pairs)
                rows += len(pairs[0])
            if rows > PAIRS:
                yield packed(found)
                found, rows = [], 0
        if found:
            yield packed(found)

    kept = None
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b])
            kept = (t if kept is None else pa.concat_tables([kept, t])).combine_chunks()
            token = kept.column(0).to_numpy()
            cut = int(np.searchsorted(token, token[-1], "left"))
            if cut:
                yield from out(kept.slice(0, cut))
            kept = kept.slice(cut)
    if kept is not None and kept.num_rows:
        yield from out(kept.combine_chunks())


def _counted(batches):
    """Of rows (rep, n, others) sorted by rep: groups of a rep and the partners that share enough of its prefix."""

    def out(rep, n, blobs):
        both = np.concatenate([np.frombuffer(x, np.int64).reshape(2, -1) for x in blobs], axis=1)
        others, at, count = np.unique(both[0], return_index=True, return_counts=True)
        enough = count >= lead(np.minimum(both[1][at], n))
        some = others[enough]
        if len(some):
            k = len(some) + 1
            return pa.record_batch([pa.array([rep] * k, pa.int64()), pa.array(np.append(some, rep)), pa.array([False] * (k - 1) + [True])], ["g1", "rep", "probe"])
        return None

    last, n, blobs = None, 0, []
    for b in batches:
        for r, size, x in zip(*(c.to_pylist() for c in b.columns)):
            if r != last and blobs:
                if (got := out(last, n, blobs)) is not None:
                    yield got
                blobs = []
            last, n = r, size
            blobs.append(x)
    if blobs and (got := out(last, n, blobs)) is not None:
        yield got


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys)


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (``key``, n_shingles, component_id), one for each row of ``docs``.

    Two documents link when the Jaccard similarity of their sets of distinct five-word shingles
    is 0.8 or more (with fewer words the whole sequence is one shingle); component_id is the
    smallest key reachable. Texts without words and null texts have an empty set and link with
    nothing, not even each other. Rows of one key are one document, with the links of all of them:
    one component, and each row its own set size. A null key gets a null component and links nothing.
    Other columns are not carried; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = _components_of_rows(rows)
    if out is None:  # keys repeat: rows get numbers, and a component of keys is one of rows joined by their keys
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
        by_row = stored(_components_of_rows(rows.where("doc_id is not null").select(F.col("row").alias("doc_id"), "text")), "row-components")
        named = rows.select("row", F.col("doc_id").alias("d")).join(by_row.withColumnRenamed("doc_id", "row"), "row", "left")
        named = stored(named.select("row", "d", F.col("component").alias("c")), "named-rows")
        least = named.where("c is not null").groupBy("c").agg(F.min("d").alias("least"))
        links = components(named.join(least, "c").select(F.col("d").alias("a"), F.col("least").alias("b")), "key-components")
        sizes = by_row.select(F.col("doc_id").alias("row"), "n")
        alone = _set_sizes(rows.where("doc_id is null").select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row")
        out = named.select("row", F.col("d").alias("doc_id")).join(sizes.unionByName(alone), "row")
        out = out.join(links.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _set_sizes(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in frugal(batches, 1):
            yield pa.record_batch([b.column(0), pa.array([len(s) for s in sets_of(plain_text(b.column(1)))], pa.int64())], ["doc_id", "n"])

    return rows.mapInArrow(run, "doc_id long, n long")


def _components_of_rows(rows: DataFrame) -> DataFrame | None:
    """Rows (doc_id, n, component) for rows (doc_id, text); None if keys repeat among those that have words."""
    spark = rows.sparkSession
    scanned = stored(rows.mapInArrow(_scan, "doc_id long, n long, key binary, slice int, counts binary"), "sets")
    each = scanned.where("slice is null").select("doc_id", "n", "key")
    named = each.where("doc_id is not null and n > 0")
    if named.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").limit(1).count():
        dropped(spark, scanned)
        return None

    # crowded cells: at most 2^18 numbers come to the driver, and a table of as many booleans goes out
    grams = each.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    mean = grams / (1 << CELL_BITS)
    slices = _dealt(scanned.where("slice is not null").select("slice", "counts"), "slice")
    hot = np.zeros(1 << CELL_BITS, bool)
    hot[[r[0] for r in slices.mapInArrow(_crowded(mean + 8 * mean**0.5 + 32), "cell long").collect()]] = True
    held = spark.sparkContext.broadcast(hot)

    # equal sets are one class; its representative is the smallest key
    twins = named.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).where("k > 1").select("key", "rep")
    classes = compact(named.join(twins, "key", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")), "classes")

    # of equal sets the representative alone is posted: keys of the others go out, 8 bytes each; where
    # they are more than COPIES, some of them do, and the rest is replaced after the shuffle
    others = classes.where("doc_id <> rep")
    share = -(-others.count() // COPIES)
    sent = others.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0) if share > 1 else others
    packed = [np.frombuffer(r[0], np.int64) for r in sent.select("doc_id").mapInArrow(_packed_ids, "ids binary").collect()]
    copies = spark.sparkContext.broadcast(np.sort(np.concatenate([np.zeros(0, np.int64), *packed])))
    posted = rows.where("doc_id is not null").mapInArrow(_postings(held, copies), "token long, doc_id long, n int")
    shared = stored(_dealt(posted, "token").mapInArrow(_shared, "token long, doc_id long, n int"), "shared")
    a = shared.select("token", F.col("doc_id").alias("rep"), F.col("n").cast("long").alias("n"))
    a.scratch_path = shared.scratch_path
    if share > 1:
        a = shared.join(sized(others), "doc_id", "left").select("token", F.coalesce("rep", "doc_id").alias("rep"), F.col("n").cast("long").alias("n")).distinct()
        a = compact(a, "postings")
        dropped(spark, shared)
    for _ in range(2):
        tokens = a.groupBy("token").agg((F.min("rep") != F.max("rep")).alias("ok")).where("ok").select("token")
        b = a.join(tokens, "token", "left_semi")
        enough = b.groupBy("rep").agg(F.count("*").alias("k"), F.max("n").alias("n")).where(F.expr("k >= greatest(1, ((4 * n + 4) div 5) div 10)")).select("rep")
        b = compact(b.join(enough, "rep", "left_semi").select("token", "rep", "n"), "postings")
        dropped(spark, a)
        a = b

    # sets of the documents that remain
    reps = compact(a.select("rep").distinct(), "reps")
    sets = stored(rows.join(sized(reps.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi").mapInArrow(_packed_sets(held), "rep long, n long, grams binary"), "grams")

    def linked(groups):
        """Links inside groups (g1, rep, label, probe)."""
        members = _dealt(groups.join(sets, "rep").select("g1", F.lit(0).alias("g2"), "rep", "label", "probe", "grams"), "g1")
        return compact(members.mapInArrow(_link, "a long, b long"), "links")

    # groups by the first shared n-grams; a very large one is dealt out, and what that parts is listed below
    crowd = a.groupBy("token").agg(F.count("*").alias("k")).withColumn("class", F.floor(F.log(4.0, "k")))
    order = Window.partitionBy("rep", "class").orderBy("token")
    picks = a.join(crowd, "token").withColumn("r", F.row_number().over(order)).where(F.col("r") <= PICKS)
    salt = F.pmod(F.xxhash64("rep"), F.ceil(F.col("k") / GROUP))
    picks = picks.select("rep", "token", F.when(F.col("k") <= GROUP, F.col("token")).otherwise(F.xxhash64("token", salt)).alias("g1"))
    per = picks.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("token", "g1"))).alias("p"))
    per = compact(per.select("rep", F.get("p", 0)["g1"].alias("first"), F.transform("p", lambda x: x["g1"]).alias("picks")), "picks")
    picks = per.select("rep", "first", F.explode("picks").alias("g1"))
    fresh = (F.count("*") > 1) & ((F.min("first") != F.max("first")) | (F.min("first") == F.col("g1")))
    groups = picks.groupBy("g1").agg(fresh.alias("fresh")).where("fresh").select("g1").join(picks, "g1").select("g1", "rep", F.col("rep").alias("label"), F.lit(True).alias("probe"))
    edges = linked(groups)
    labels = components(edges)

    # pairs of different components that have not met
    named_a = a.join(per, "rep").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("label", F.coalesce("component", "rep"))
    met = (F.min("label") == F.max("label")) | (F.min("first") == F.max("first"))
    left = compact(named_a.select("token", "rep", "n", "label", "picks", "first"), "labelled")
    open_tokens = left.groupBy("token").agg(met.alias("met")).where("not met").select("token")
    lists = _dealt(left.join(open_tokens, "token", "left_semi").drop("first"), "token").mapInArrow(_listed, "rep long, n long, others binary")
    pairs = compact(_dealt(lists, "rep").mapInArrow(_counted, "g1 long, rep long, probe boolean"), "pairs")
    if pairs.limit(1).count():
        more = linked(pairs.join(left.groupBy("rep").agg(F.first("label").alias("label")), "rep"))
        if more.limit(1).count():
            labels = components(edges.unionByName(more))
    dropped(spark, a, left, sets)

    out = each.join(classes.where("doc_id <> rep"), "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = out.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", "n", F.coalesce("component", "rep").alias("component"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return jaccard_components(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM texts WHERE len(w) > 0
), grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') || ' ' END AS g FROM places
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes k ON k.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, m.n, k.n HAVING 100 * count(*) >= 80 * (m.n + k.n - count(*))
), links AS (SELECT x, y FROM shared UNION ALL SELECT y, x FROM shared),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.least AS component_id FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""
