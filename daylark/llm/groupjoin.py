"""Jaccard join of documents by word n-grams through a matrix of tokens and groups of similar documents.

A document's tokens are the hashes of its distinct shingles; documents with equal sets are one node.

1. Groups. Under each of ``MINIMA`` permutations a node has its least token. Nodes that share one meet in a
   bucket, whose hub is the node that meets most others in all its buckets; a node with the same hub in at
   least ``VOTES`` buckets joins that one's group, any other node is a group of its own. Nodes are
   compared with their hub; those that link with it are tied to it.
2. Bound. A node of n tokens that links with a node of another group shares at least ``n - n // 5`` tokens
   with that group's union. A first matrix holds tokens below a fixed hash value (all tokens of short
   texts): a node of h such tokens has to share ``h - n // 5`` of them with other groups, or it has no
   link outside its own. Nodes that are left enter the full matrix, where the bound holds with all tokens.
   For each of them, the groups that hold some of its rarest tokens (as many as it takes for one to be in
   any link) are candidates.
3. Opening. Groups are kept in blocks of some ``BLOCK`` members with their token union. A candidate's block
   qualifies if its union holds enough of the node's tokens; the node is then compared with its members. A node
   that isn't tied to its hub is compared likewise with its own group.

The bounds never lose a link; they tell which groups can't hold one.
All comparisons count the shared tokens of both sets. Links are decided by ``100 * shared >= 80 * union``.

Defined cases: a null text counts as empty; a text without words has no tokens, links with nothing and
is its own component. Fewer than five words are one shingle. Null ids are allowed; a component's id is
its smallest non-null id, null if there is none. Repeated rows and ids get the same result. Texts
are hashed whole. An empty table gives an empty result. Columns other than the id and the text aren't
read. Sets and shingles are told apart by 64 bits of XXH64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daylark.llm.common import small_side, stored
from daylark.llm.components import connected_components
from daylark.llm.simhash import hashes

WORDS, PERCENT = 5, 80
#: Texts of at most so many tokens are bounded by all their tokens, longer ones by tokens below ``BELOW`` (5/16 of all hash values).
SHORT, BELOW = 128, -(1 << 63) + 5 * (1 << 60)
MINIMA, VOTES, BLOCK = 12, 4, 256
#: Rows of a node from which its component is looked up by broadcast.
HOT = 1_000
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tokens_of(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    return np.unique(hashes((text or "").encode("utf-8", "surrogatepass"), WORDS).view(np.int64))


def node_of(tokens: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes()))))


def minima_of(tokens: np.ndarray) -> np.ndarray:
    """The least token under each of the permutations (multiplications by odd numbers)."""
    return np.array([(tokens.view(np.uint64) * f).min() for f in _FACTORS] if len(tokens) else [], np.uint64).view(np.int64)


def prints(docs: DataFrame) -> DataFrame:
    """(id, node, n, h, least) of each row of (id, text): its set, the tokens in it, those bounded first, its minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, least = [], []
            for text in batch.column(1):
                t = tokens_of(text.as_py())
                n = len(t)
                rows.append((node_of(t), n, n if n <= SHORT else int(np.searchsorted(t, BELOW))))
                least.append(minima_of(t))
            made = [pa.array(list(c), pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, pa.array(least, pa.list_(pa.int64()))], names=["id", "node", "n", "h", "least"])

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, node long, n long, h long, least array<long>")


def first_matrix(docs: DataFrame) -> DataFrame:
    """(token, node, n) of the tokens that the first bound counts; a node that a task has met is not written again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            tokens, nodes, sizes, waiting = [], [], [], 0
            for k, text in enumerate(batch.column(1)):
                t = tokens_of(text.as_py())
                node, n = node_of(t), len(t)
                if n and node not in met:
                    met.add(node)
                    own = t if 4 * n <= 5 * SHORT else t[: np.searchsorted(t, BELOW)]
                    tokens.append(own)
                    nodes.append(np.full(len(own), node))
                    sizes.append(np.full(len(own), n))
                    waiting += len(own)
                if tokens and (waiting > 200_000 or k + 1 == len(batch)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (tokens, nodes, sizes)], names=["token", "node", "n"])
                    tokens, nodes, sizes, waiting = [], [], [], 0
            if len(met) > 1_000_000:
                met.clear()

    return docs.select("id", "text").mapInArrow(run, "token long, node long, n long")


def in_several(rows: DataFrame) -> DataFrame:
    """The distinct (token, node, n) whose token at least two nodes have. Tokens are dealt to tasks and sorted; a task holds a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, written = None, False  # the row before this batch, and whether its token's rows have been written
        for batch in batches:
            if not len(batch):
                continue
            t, v, n = (batch.column(k).to_numpy() for k in range(3))
            if last is not None:
                t, v, n = (np.append(x, c) for x, c in zip(last, (t, v, n)))
            same = np.append(False, t[1:] == t[:-1])
            fresh = ~same | np.append(True, v[1:] != v[:-1])
            token = np.cumsum(~same) - 1
            several = np.bincount(token, fresh) > 1
            several[0] |= written
            keep = fresh & several[token]
            keep[0] &= not written
            last, written = (t[-1], v[-1], n[-1]), several[-1]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (t, v, n)], names=["token", "node", "n"])

    return rows.repartition("token").sortWithinPartitions("token", "node").mapInArrow(run, "token long, node long, n long")


def token_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, tokens) of the nodes in ``wanted`` (node, rep), read again from the text of the row ``rep``."""
    ids = small_side(wanted.select("node", "rep"))
    found = docs.select("id", "text").join(ids, F.col("id").eqNullSafe(F.col("rep"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                sets = [tokens_of(text.as_py()) for text in part.column(1)]
                own = np.array([node_of(t) == node for t, node in zip(sets, part.column(0).to_pylist())], bool)
                if own.any():
                    made = pa.array([t for t, ok in zip(sets, own) if ok], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(own)), made], names=["node", "tokens"])

    return found.mapInArrow(run, "node long, tokens array<long>")


def linked(pairs: DataFrame, left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose sets, in ``left`` for a and ``right`` for b, link."""
    of = lambda sets, name: sets.select(F.col("node").alias(name), F.col("tokens").alias(f"{name}s"))
    both = pairs.join(of(right, "b"), "b").join(of(left, "a"), "a")
    shared = F.size(F.array_intersect("as", "bs"))
    return both.where(100 * shared >= percent * (F.size("as") + F.size("bs") - shared)).select(*pairs.columns)


def _least(n: str | Column, percent: int) -> Column:
    """How many of its tokens a set of ``n`` shares with any other that it links with: ``percent`` %, rounded up."""
    n = F.col(n) if isinstance(n, str) else n
    return n - F.floor(n * (100 - percent) / 100).cast("long")


def similar_groups(nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, least, ...) with their ``group``, the node of its hub."""
    met = nodes.select("node", F.posexplode("least").alias("k", "token"))
    several = met.groupBy("k", "token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    met = stored(met.join(several, ["k", "token"]), "buckets")
    rated = met.join(met.groupBy("node").agg(F.sum("c").alias("meets")), "node")
    hubs = rated.groupBy("k", "token").agg(F.max_by("node", F.struct("meets", "node")).alias("hub"))
    votes = met.join(hubs, ["k", "token"]).groupBy("node", "hub").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= VOTES)
    best = votes.groupBy("node").agg(F.max_by("hub", F.struct("votes", "hub")).alias("group"))
    return nodes.drop("least").join(best, "node", "left").withColumn("group", F.coalesce("group", "node"))


def shared_between_groups(rows: DataFrame) -> DataFrame:
    """``rows`` (token, group, ...) whose token several groups have, with the number of its rows as ``c``."""
    known = rows.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo < hi").select("token", "c")
    return rows.join(known, "token")


def united(above: dict[int, int], a: int, b: int) -> bool:
    """Whether ``a`` and ``b`` were apart in the forest ``above``; they are together from now on."""
    ends = []
    for x in (a, b):
        root = x
        while (up := above.get(root, root)) != root:
            root = up
        while x != root:
            above[x], x = root, above[x]
        ends.append(root)
    if ends[0] != ends[1]:
        above[ends[0]] = ends[1]
    return ends[0] != ends[1]


def opened(members: DataFrame, queries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between queries (g, node, label) and members of their ``g`` (g, node, label) that connect what all such links connect.

    A label stands for nodes known to be connected. While a block is open, a link between labels that its links so far have
    connected isn't written again, so a block writes fewer links than it meets labels, however many pairs link. A task holds one block of members at a time with the union of their
    tokens. A query that shares too few tokens with the union passes on, for others the block is opened: the tokens
    shared with every member are counted.
    """
    blocks = members.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = members.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    asked = queries.join(blocks, "g").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = own.select("g", "block", F.lit(0).alias("asks"), "node", "label").unionByName(asked.select("g", "block", F.lit(1).alias("asks"), "node", "label"))
    rows = sides.join(sets, "node").select("g", "block", "asks", "node", "label", "tokens").repartition("g", "block").sortWithinPartitions("g", "block", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, labels, held, index, joined = None, [], [], [], None, {}
        for batch in batches:
            found = []
            plain = [batch.column(k).to_pylist() for k in range(5)]
            for k, (g, block, asks, node, label) in enumerate(zip(*plain)):
                tokens = batch.column(5)[k].values.to_numpy()
                if (g, block) != key:
                    key, nodes, labels, held, index, joined = (g, block), [], [], [], None, {}
                if not asks:
                    nodes.append(node)
                    labels.append(label)
                    held.append(tokens)
                    continue
                if not held:
                    continue
                if index is None:
                    every, size = np.concatenate(held), np.array([len(t) for t in held])
                    order = np.argsort(every, kind="stable")
                    index = (every[order], np.repeat(np.arange(len(held)), size)[order], size, np.array(nodes), np.array(labels))
                every, owner, size, members_, labels_ = index
                lo, hi = np.searchsorted(every, tokens), np.searchsorted(every, tokens, side="right")
                n = hi - lo
                if np.count_nonzero(n) < len(tokens) - len(tokens) * (100 - percent) // 100:
                    continue  # the block's union holds too few of the tokens
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                shared = np.bincount(owner[at], minlength=len(size))
                near = (100 * shared >= percent * (size + len(tokens) - shared)) & (labels_ != label)
                if near.any():
                    others, first = np.unique(labels_[near], return_index=True)
                    found += [(node, m) for other, m in zip(others.tolist(), members_[near][first].tolist()) if united(joined, label, other)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*found)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def candidates(docs: DataFrame, homes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes that may link outside their group, (node, g) of the other groups that may hold a partner, their token sets)."""
    spare = F.floor(F.col("n") * (100 - percent) / 100).cast("long")
    first = stored(in_several(first_matrix(docs)).drop("n").join(homes.select("node", "n", "group"), "node"), "first-matrix")
    counted = shared_between_groups(first).where(f"n <= {SHORT} or token < {BELOW}").groupBy("node").agg(F.count(F.lit(1)).alias("s"))
    held = homes.join(counted, "node", "left").withColumn("s", F.coalesce("s", F.lit(0)))
    left = stored(held.where((F.col("h") <= spare) | (F.col("s") >= F.col("h") - spare)).select("node", "rep", "n", "group"), "open")
    sets = stored(token_sets(docs, left).dropDuplicates(["node"]), "open-sets")
    full = sets.join(left.drop("rep"), "node").select("node", "n", "group", F.explode("tokens").alias("token"))
    rarest = F.array_sort(F.collect_list(F.struct("c", "token")))
    own = shared_between_groups(full).groupBy("node", "n", "group").agg(rarest.alias("shared"))
    own = stored(own.where(F.size("shared") >= _least("n", percent)), "bounded")
    matrix = stored(own.select(F.col("group").alias("g"), F.explode("shared.token").alias("token")).distinct(), "matrix")
    probes = own.select("node", "n", "group", F.explode(F.slice("shared", F.lit(1), (F.size("shared") - _least("n", percent) + 1).cast("int"))).alias("x"))
    met = probes.select("node", "n", "group", "x.token").join(matrix, "token").where("g <> group").select("node", "g").distinct()
    return own.select("node", "group"), stored(met, "candidates"), sets


def links(docs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with their group, and links (a, b) between nodes that make up the components."""
    homes = stored(similar_groups(nodes), "homes")
    hubs = stored(homes.where("node <> group").select("group").distinct(), "hubs")
    heads = hubs.withColumnRenamed("group", "node")
    grouped = homes.join(hubs, "group")
    near = stored(grouped.select("node", "rep").unionByName(homes.join(heads, "node").select("node", "rep")).distinct(), "near")
    sets = stored(token_sets(docs, near).dropDuplicates(["node"]), "sets")
    tied = stored(linked(grouped.where("node <> group").select(F.col("group").alias("a"), F.col("node").alias("b")), sets.join(heads, "node"), sets, percent), "tied")
    labelled = homes.join(tied.select(F.col("b").alias("node"), F.col("a").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = stored(labelled.select("node", "group", "label"), "labelled")
    loose = labelled.where("label <> group")
    loose = loose.join(hubs, "group").withColumnRenamed("group", "g")
    within = opened(labelled.withColumnRenamed("group", "g").join(loose.select("g").distinct(), "g"), loose, sets, percent)
    outside, asks, open_sets = candidates(docs, homes, percent)
    label = labelled.select("node", "label")
    across = opened(outside.withColumnRenamed("group", "g").join(label, "node"), asks.join(label, "node"), open_sets, percent)
    return homes, tied.unionByName(stored(within, "within")).unionByName(stored(across, "across"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles and component_id, under links of at least ``percent`` % (80 to 100)."""
    if not 80 <= percent <= 100:
        raise ValueError("the first bound holds for 80 to 100 %")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = stored(prints(docs), "prints")
    same = rows.where("n > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "h", "least")], F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    homes, edges = links(docs, stored(same, "nodes"), percent)
    roots = connected_components(edges)
    named = homes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = stored(named.join(named.groupBy("root").agg(F.min("rep").alias("component")), "root").select("node", "component", "rows"), "components")
    # hot nodes by broadcast, as all their rows have one key
    hot, rest = small_side(found.where(F.col("rows") >= HOT)), found.where(F.col("rows") < HOT)
    full = rows.where("n > 0")
    placed = full.join(hot, "node").unionByName(full.join(rest, "node"))
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component"))
    both = placed.select("id", "n", "component").unionByName(alone)
    return both.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
