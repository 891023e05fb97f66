"""Shared keys, connected components and exact set verification, all distributed.

`shared` finds the nodes that share a key, `components` is a distributed union-find, `verify`
compares the sets of candidate groups exactly, block by block, and `spread_join` looks up one row for
each key where a key may hold any share of the rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.llm._bytes import RELEASE, list_array, pieces, release, text_bytes

#: pairs that a task holds before it hands them on, and edges that a bucket of `components` has on average at most
FLUSH, HELD = 1_000_000, 1_000_000
#: buckets per shuffle partition; a task holds one at a time
FINE = 8
#: shingles and members that one side of a verification block holds on average
BLOCK_ITEMS, BLOCK_ROWS = 1_000_000, 2048
#: features that one dense product of `common` takes, and bytes of text whose sets are made at once
DENSE, TOGETHER = 1024, 4 << 20
#: a key is hot if it holds more than one of so many rows (and more than 1,000)
HOT = 50_000
#: kinds of message in `components`: a node's parent, an edge of another bucket's node, a question
#: after a node's root and its answer, and the mark of a bucket that changed
OWN, EDGE, ASK, ANSWER, CHANGED = range(5)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's, else one of this machine in local mode."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isEmpty() and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lemmata-") if known.isEmpty() else known.get()
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the cluster's checkpoint folder and go on from there (lineage ends)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """Joins the one row of `right` for each `key` to the rows of `left`, however many of these share a key.

    The rows of a key are dealt over all partitions by `by`; each partition's share asks once, so
    neither side has more rows of one key in a task than there are partitions, or its dealt share.
    """
    dealt = left.withColumn("_s", F.pmod(F.xxhash64(by), F.lit(partitions(left.sparkSession))))
    told = dealt.select(key, "_s").distinct().join(right, key)
    return dealt.join(told, [key, "_s"], how).drop("_s")


def hot_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Joins the one row of `right` for each `key` to the rows of `left`; `count` is how many rows of `left` hold the key.

    Keys with more than one of `HOT` rows (`total` in all) are fewer than `HOT` and are broadcast; of every
    other key a task gets no more than that.
    """
    bound = max(1000, total // HOT)
    hot = right.where(F.col(count) > bound)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(right.where(F.col(count) <= bound), key))


def _by_key(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, node) in order, each key's first row, and how many nodes it has."""
    order = np.argsort(key)
    key, node = key[order], node[order]
    again = key[1:] == key[:-1]
    many = np.append(again, False) | np.insert(again, 0, False)
    if len(key) and many.any():  # only rows of keys that come again need their nodes sorted
        some, who = key[many], node[many]
        who = who[np.lexsort((who, some))]
        node[many] = who
        fresh = np.ones(len(key), bool)
        fresh[1:] = ~again | (node[1:] != node[:-1])
        key, node = key[fresh], node[fresh]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(head)
    return key, node, at, np.diff(np.append(at, len(key)))


def _many(key: np.ndarray, node: np.ndarray, at: np.ndarray, n: np.ndarray, stars: bool) -> np.ndarray:
    """Rows (key, node) of the keys with two nodes or more; as stars (least node, other node) instead."""
    if not stars:
        return np.stack([key, node], 1)[np.repeat(n > 1, n)]
    others = np.ones(len(key), bool)
    others[at] = False
    return np.stack([np.repeat(node[at], n), node], 1)[others]


def shared(df: DataFrame, node: str, keys: str, stars: bool = False) -> DataFrame:
    """(key, node) for every key that two or more distinct nodes hold, some of them more than once.

    With `stars`, edges (a, b) instead that connect all nodes of a key. `node` is one long or an array
    of longs, `keys` an array of longs, for an array of nodes as many for each. Each task first joins
    its own nodes by key and sends only the smallest of them on, so a key that a third of all rows
    hold reaches its bucket once per task.
    """
    spark = df.sparkSession
    parts = partitions(spark)
    buckets = parts * FINE
    names = ["a", "b"] if stars else ["key", "node"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            if not held:
                return
            key, who, at, n = _by_key(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            met = _many(key, who, at, n, stars)
            rows, blobs, done = [], [], []
            for a in range(0, len(met), FLUSH):
                rows.append(abs(hash((len(rows), int(key[0])))) % buckets)
                blobs.append(np.ascontiguousarray(met[a : a + FLUSH]).tobytes())
                done.append(True)
            lead = np.stack([key[at], who[at]], 1)
            place = (lead[:, 0].view(np.uint64) >> np.uint64(17)) % np.uint64(buckets)
            order = np.argsort(place, kind="stable")
            lead, place = lead[order], place[order].astype(np.int64)
            cuts = np.flatnonzero(np.diff(place)) + 1
            for part, p in zip(np.split(lead, cuts), place[np.concatenate([[0], cuts])], strict=True):
                rows.append(int(p))
                blobs.append(np.ascontiguousarray(part).tobytes())
                done.append(False)
            for a in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(rows[a : a + 64], pa.int64()), pa.array(done[a : a + 64]), pa.array(blobs[a : a + 64], pa.binary())], ["bucket", "done", "blob"])

        size = 0
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            if pa.types.is_list(b.column(0).type):
                each = b.column(0).flatten().to_numpy(zero_copy_only=False)
                who = np.repeat(each, len(flat) // max(1, len(each)))
            else:
                who = np.repeat(b.column(0).to_numpy(zero_copy_only=False), n)
            if len(flat):
                held.append((flat, who))
                size += len(flat)
            if size >= FLUSH:
                yield from flush()
                size = 0
        yield from flush()
        release(RELEASE)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out(pairs):
            for a in range(0, len(pairs), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[a : a + 100_000, c])) for c in (0, 1)], names)

        def close():
            if held:
                pairs = np.concatenate(held)
                yield from out(_many(*_by_key(pairs[:, 0], pairs[:, 1]), stars))
                held.clear()

        for b in batches:
            for bucket, done, blob in zip(*(b.column(i) for i in range(3)), strict=True):
                pairs = np.frombuffer(blob.as_buffer(), np.int64).reshape(-1, 2)
                if done.as_py():
                    yield from out(pairs)
                    continue
                if bucket.as_py() != now:
                    yield from close()
                    now = bucket.as_py()
                held.append(pairs)
        yield from close()
        release(RELEASE)

    return (
        df.select(node, keys)
        .mapInArrow(local, "bucket long, done boolean, blob binary")
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(meet, ", ".join(f"{x} long" for x in names))
    )


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, sorted, and of each the smallest node that it is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return nodes, nodes[root]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _bucket(node: np.ndarray, buckets: int) -> np.ndarray:
    h = node.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64)


def _messages(rows: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(dest, kind, a, b), in batches."""
    for dest, kind, a, b in rows:
        for i in range(0, len(a), 100_000):
            s = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(dest[s]), pa.array(np.full(len(a[s]), kind, np.int8)), pa.array(a[s]), pa.array(b[s])], ["dest", "kind", "a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of `edges` (a, b), root the smallest node of the component.

    Every node belongs to a bucket by hash, which keeps its parent. In each round a bucket joins all
    it knows by union-find, tells the buckets of other nodes of the parents it found for them, and asks
    those of its roots whether these have roots in turn; answers shorten the paths of the next round, so the
    rounds grow with the logarithm of a component's diameter. A bucket sends one row at most
    for each node and each root, so a root with any number of members receives no more rows than there
    are buckets. There is a bucket for every `HELD` edges; each round is one shuffle and is written to the
    checkpoint folder, and only the kinds of messages that it sent come to the driver.
    """
    schema = "dest long, kind byte, a long, b long"

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            nodes, root = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            low = nodes != root
            yield from _messages([(np.zeros(low.sum(), np.int64), EDGE, nodes[low], root[low])])

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
                size += b.num_rows
            if size >= FLUSH:
                yield from flush()
                size = 0
        if size:
            yield from flush()
        release(RELEASE)

    e = cut(edges.where("a <> b").select("a", "b").mapInArrow(contract, schema))
    buckets = max(1, -(-e.count() // HELD))

    def address(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = b.column(2).to_numpy()
            yield from _messages([(_bucket(a, buckets), EDGE, a, b.column(3).to_numpy())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(i).to_numpy() for i in range(4)] for b in batches if b.num_rows]
        if not got:
            return
        dest, kind, a, b = (np.concatenate(x) for x in zip(*got, strict=True))
        here = np.unique(dest)
        asks, own, told = kind == ASK, kind == OWN, kind == ANSWER
        known = own | told | (kind == EDGE)
        nodes, root = forest(a[known], b[known])

        def root_of(x: np.ndarray) -> np.ndarray:
            if not len(nodes):
                return x
            i = np.minimum(np.searchsorted(nodes, x), len(nodes) - 1)
            return np.where(nodes[i] == x, root[i], x)

        low = nodes != root
        x, r = nodes[low], root[low]
        place = _bucket(x, buckets)
        mine = np.isin(place, here)
        away = ~mine
        if told.any():  # what an answer said, its bucket knows
            sure = root_of(a[told]) == b[told]
            away &= ~np.isin(x, a[told][sure])
        roots = np.unique(r[mine])
        there = _bucket(roots, buckets)
        other = ~np.isin(there, here)
        up = root_of(a[asks])
        answers = up != a[asks]
        same = mine.sum() == len(np.unique(a[own])) and (root_of(a[own]) == b[own]).all()
        out = [
            (place[mine], OWN, x[mine], r[mine]),
            (place[away], EDGE, x[away], r[away]),
            (there[other], ASK, roots[other], np.full(other.sum(), here[0])),
            (b[asks][answers], ANSWER, a[asks][answers], up[answers]),
        ]
        if not same:
            out.append((here[:1], CHANGED, here[:1], here[:1]))
        yield from _messages(out)
        del got, dest, kind, a, b, nodes, root, out
        release(RELEASE)

    e = e.mapInArrow(address, schema)
    while True:
        e = cut(e.where(F.col("kind") != CHANGED).repartition(buckets, "dest").mapInArrow(step, schema))
        news = {r["kind"] for r in e.select("kind").distinct().collect()}
        if not news & {EDGE, ASK, ANSWER} or not news & {EDGE, ANSWER, CHANGED}:
            break
    kept = e.where(F.col("kind") == OWN)
    return kept.select(F.col("a").alias("node"), F.col("b").alias("root")).union(kept.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def in_blocks(members: DataFrame, percent: int) -> DataFrame:
    """Members (node, root, items, ...) dealt into blocks (root, own) of bounded size, each member into one.

    A group within the bound is one block, not `wide`; a larger one is dealt by classes of items that differ by the
    threshold's ratio and within a class by hash, so most of its blocks hold sets of like size.
    """
    blocks = F.greatest(F.ceil(F.sum("items") / BLOCK_ITEMS), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).cast("long")
    sized = members.withColumn("_class", F.struct("root", F.floor(F.log(F.greatest("items", F.lit(1))) / float(np.log(100 / percent) or 1)).alias("c")))
    size = members.groupBy("root").agg((blocks > 1).alias("wide"))
    dealt = spread_join(sized, size, "root", "node")
    large, small = dealt.where("wide"), dealt.where("not wide")
    many = spread_join(large, large.groupBy("_class").agg(blocks.alias("blocks")), "_class", "node")
    own = (F.col("_class.c") * F.lit(1 << 32) + F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("own")
    names = [*members.columns, "wide"]
    return small.select(*names, F.lit(0).cast("long").alias("own")).unionByName(many.select(*names, own))


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many features each set of `left` shares with each of `right` (sorted distinct hashes).

    Features that a sixth of the sets or more hold are counted by products of 0/1 matrices, the others
    by their lists of holders.
    """
    both = np.zeros((len(left), len(right)), np.float32)
    flat = [np.concatenate(s) for s in (left, right)]
    who = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    met = np.intersect1d(*(np.unique(x) for x in flat))
    if not len(met):
        return both
    for k in (0, 1):
        code = np.minimum(np.searchsorted(met, flat[k]), len(met) - 1)
        held = met[code] == flat[k]
        order = np.argsort(code[held], kind="stable")
        flat[k], who[k] = code[held][order], who[k][held][order]
    at = [np.searchsorted(f, np.arange(len(met) + 1)) for f in flat]
    n = [np.diff(a) for a in at]
    dense = (6 * n[0] >= len(left)) & (6 * n[1] >= len(right)) & (n[0] * n[1] >= 64)
    heavy = np.flatnonzero(dense)
    for a in range(0, len(heavy), DENSE):
        some = heavy[a : a + DENSE]
        column = np.full(len(met), -1)
        column[some] = np.arange(len(some))
        sides = []
        for k, s in ((0, left), (1, right)):
            use = column[flat[k]] >= 0
            m = np.zeros((len(s), len(some)), np.float32)
            m[who[k][use], column[flat[k][use]]] = 1
            sides.append(m)
        both += sides[0] @ sides[1].T
    light = ~dense[flat[0]]
    order = np.argsort(who[0][light], kind="stable")
    code, row = flat[0][light][order], who[0][light][order]
    bounds = np.searchsorted(row, np.arange(len(left) + 1))
    for i in range(len(left)):
        c = code[bounds[i] : bounds[i + 1]]
        if len(c):
            m = n[1][c]
            index = np.repeat(at[1][c] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            both[i] += np.bincount(who[1][index], minlength=len(right))
    return both


def similar(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of `left` those of `right` (without one: the later ones of `left`) with Jaccard >= percent/100, exactly."""
    other = left if right is None else right
    sizes = [np.array([len(s) for s in x], np.int64) for x in (left, other)]
    both = common(left, other)
    for i in range(len(left)):
        shares = both[i].astype(np.int64)
        near = 100 * shares >= percent * (sizes[0][i] + sizes[1] - shares)
        if right is None:
            near[: i + 1] = False
        if near.any():
            yield i, np.flatnonzero(near)


Block = tuple[np.ndarray, np.ndarray, list[np.ndarray]]


def _linked(left: Block, right: Block | None, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(node, root, links) of the similar pairs between two blocks (nodes, copies, sets), or within one."""
    other = left if right is None else right
    if not len(left[0]) or not len(other[0]):
        return None
    links = [np.zeros(len(left[0]), np.int64), np.zeros(len(other[0]), np.int64)]
    a, b = [], []
    for i, near in similar(left[2], None if right is None else right[2], percent):
        links[0][i] += other[1][near].sum()
        links[1][near] += left[1][i]
        a.append(np.full(len(near), left[0][i]))
        b.append(other[0][near])
    if not a:
        return None
    nodes, root = forest(np.concatenate(a), np.concatenate(b))
    total = np.zeros(len(nodes), np.int64)
    for who, n in ((left[0], links[0]), (other[0], links[1])):
        at = np.minimum(np.searchsorted(nodes, who), len(nodes) - 1)
        held = nodes[at] == who
        np.add.at(total, at[held], n[held])
    return nodes, root, total


def _store(block: Block, folder: str) -> str:
    """Writes a block to a new file of the shared folder and returns its path."""
    from lemmata.llm.binary import filesystem

    path = f"{folder}/{uuid.uuid4().hex}.arrow"
    fs, where = filesystem(path)
    fs.create_dir(where.rpartition("/")[0], recursive=True)
    at = np.concatenate([[0], np.cumsum([len(x) for x in block[2]])])
    rows = pa.RecordBatch.from_arrays([pa.array(block[0]), pa.array(block[1]), list_array(np.concatenate(block[2]), at)], ["node", "copies", "set"])
    with fs.open_output_stream(where, compression=None) as out, pa.ipc.new_stream(out, rows.schema) as writer:
        writer.write_batch(rows)
    return path


def _load(path: str) -> Block:
    from lemmata.llm.binary import filesystem

    fs, where = filesystem(path)
    with fs.open_input_stream(where, compression=None) as source:
        rows = pa.ipc.open_stream(source).read_next_batch()
    flat, at = rows.column(2).flatten().to_numpy(), rows.column(2).offsets.to_numpy()
    return rows.column(0).to_numpy(), rows.column(1).to_numpy(), [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def verify(blocks: DataFrame, make: Callable[[pa.Array], list[np.ndarray]], percent: int, stamp: Callable[[np.ndarray], int] | None) -> DataFrame:
    """Exact check of the blocks' members (root, own, wide, node, copies, text).

    `make` turns texts into sorted sets of hashes and `stamp`, if given, names a set: a text whose set
    is not its node's is left out. Returns (node, root, links): for every node with links its smallest
    linked relative in the block and how many documents it links with there. Rows are linear in the
    members, however many pairs are similar.

    A group of one block is checked where it is gathered. Of a wide group every block's sets are written once to the shared
    folder, and only the names of two files travel for each pair of blocks whose sizes allow the threshold: disk is linear
    in the members, and a task holds two blocks.
    """
    spark = blocks.sparkSession
    parts = partitions(spark)
    folder = f"{shared_folder(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"
    names = ["node", "root", "links", "own", "path", "least", "most"]

    def two(held: dict[int, tuple[int, np.ndarray]]):
        (x, (m, s)), (y, (n, t)) = held.items()
        if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
            return
        both = len(np.intersect1d(s, t, assume_unique=True))
        if 100 * both >= percent * (len(s) + len(t) - both):
            yield np.array([x, y]), np.full(2, min(x, y)), np.array([n, m])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found, stored = None, {}, [], []

        def close():
            if not held:
                return
            root, own, wide = now
            if not wide and len(held) == 2:
                found.extend(two(held))
            elif wide or len(held) > 2:
                block = np.array(list(held), np.int64), np.array([x[0] for x in held.values()], np.int64), [x[1] for x in held.values()]
                if wide:
                    sizes = [len(x) for x in block[2]]
                    stored.append((root, own, _store(block, folder), min(sizes), max(sizes)))
                elif (got := _linked(block, None, percent)) is not None:
                    found.append(got)
            held.clear()

        def send():
            if found:
                made = [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]
                none = [pa.nulls(len(made[0]), k) for k in (pa.int64(), pa.string(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*made, *none], names)
                found.clear()
            if stored:
                root, own, path, low, high = (list(x) for x in zip(*stored, strict=True))
                none = pa.nulls(len(root), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(root), none, pa.array(own), pa.array(path), pa.array(low), pa.array(high)], names)
                stored.clear()

        for batch in batches:
            for lo, hi in pieces(text_bytes(batch.column(5))[1], TOGETHER):  # sets of many groups
                b = batch.slice(lo, hi - lo)
                sets = make(b.column(5))
                keys = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
                for key, node, copies, s in zip(keys, *(b.column(i).to_pylist() for i in (3, 4)), sets, strict=True):
                    if key != now:
                        close()
                        now = key
                    if node not in held and (stamp is None or stamp(s) == node):
                        held[node] = (copies, s)
            yield from send()
        close()
        yield from send()
        release(RELEASE)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, left = None, None
        for b in batches:
            for one, other in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if one != name:
                    name, left = one, _load(one)
                got = _linked(left, None if one == other else _load(other), percent)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names[:3])
                release(RELEASE // 4)

    checked = cut(
        blocks.select("root", "own", "wide", "node", "copies", "text")
        .repartition(parts, "root", "own")
        .sortWithinPartitions("root", "own")
        .mapInArrow(run, "node long, root long, links long, own long, path string, least long, most long")
    )
    files = checked.where("path is not null").select("root", "own", "path", "least", "most")
    right = files.select("root", *[F.col(x).alias(f"_{x}") for x in ("own", "path", "least", "most")])
    fits = (F.col("own") <= F.col("_own")) & (100 * F.col("most") >= percent * F.col("_least")) & (100 * F.col("_most") >= percent * F.col("least"))
    pairs = files.join(right, "root").where(fits).select("path", F.col("_path").alias("other"))
    linked = pairs.repartition(parts, "path", "other").sortWithinPartitions("path").mapInArrow(across, "node long, root long, links long")
    return checked.where("path is null").select("node", "root", "links").unionByName(linked)
