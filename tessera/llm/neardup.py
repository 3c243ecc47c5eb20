"""MinHash near-dedup: a chosen-path set similarity join over five-word shingles.

Documents of one word sequence form a class with one representative.  Independent trees branch representatives by
selected minwise tokens; a node's members are compared exhaustively by sketches once it is small, and the rare large
node is compared with some of its members and branched further.  Pairs that pass form clusters, whose full shingle
sets are then compared, which alone decides links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Words, plain, shingles, slices, stage, table, unstage
from tessera.llm.components import components, join_sized, joined_least

SIZE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Independent trees; at the root they select ROOTS minwise tokens in all (about 1 / similarity for a tree).
TREES, ROOTS = 8, 9
#: Minwise values of a sketch, 16 bits each.
SKETCH = 64
#: Members of a node that is compared exhaustively; members of a larger one that all the others are compared with.
NODE, HUBS = 4096, 64
#: Members of a large group that one task sees after the group's guides.
PART = 8192
#: Members and shingles of a cluster that one task compares in full; a larger cluster is split.
CHUNK, CHUNK_SHINGLES, CHUNK_HUBS = 1000, 1_000_000, 32
BLOCK = 400
_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, (2, ROOTS + SKETCH), dtype=np.uint64) | np.uint64(1)


def least_matches(percent: int, positions: int = SKETCH) -> int:
    """Equal sketch values below which a pair is not taken up: five standard deviations under the similarity asked for."""
    p = percent / 100
    return max(1, int(positions * p - 5 * (positions * p * (1 - p)) ** 0.5))


def minwise(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minwise values (positions x sets) of non-empty sets of hashes that begin at ``first``."""
    out = np.empty((_SEEDS.shape[1], len(first)), np.uint64)
    for k in range(_SEEDS.shape[1]):
        out[k] = np.minimum.reduceat(h * _SEEDS[0, k] + _SEEDS[1, k], first)
    return out


def signatures(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id, hash, cls, n, roots, sketch`` of (doc_id, text): hash of the text, class of the word sequence, set size, root nodes and sketch; nulls for no words."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    schema = T.StructType([*docs.schema.fields[:2], *T.StructType.fromDDL("cls binary, n bigint, roots array<bigint>, sketch binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = plain(b.column(2))
            for lo, hi in slices(texts):
                part = texts.slice(lo, hi - lo)
                h, begin = shingles(Words(part), size)
                sets = [np.unique(h[begin[i] : begin[i + 1]]) for i in range(len(part))]
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                cls: list = [None] * len(part)
                roots: list = [None] * len(part)
                sketch: list = [None] * len(part)
                if len(full):
                    values = minwise(np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(n[full])[:-1]]))
                    # A root node is a tree's token at a selected position.
                    at = (values[:ROOTS] ^ (np.arange(ROOTS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15))).view(np.int64).T
                    small = np.ascontiguousarray((values[ROOTS:] >> np.uint64(40)).astype(np.uint16).T)
                    for k, i in enumerate(full):
                        cls[i] = hashlib.md5(b" ".join(part[int(i)].as_py().encode("utf-8", "surrogatepass").lower().split()), usedforsecurity=False).digest()
                        roots[i] = at[k]
                        sketch[i] = small[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(cls, pa.binary()), pa.array(n), pa.array(roots, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    names=schema.fieldNames(),
                )

    return docs.mapInArrow(run, schema)


def _matrix(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint16).reshape(len(sketches), -1)


def matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal positions of each sketch of ``a`` with each of ``b``."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for k in range(a.shape[1]):
        out += a[:, k, None] == b[None, :, k]
    return out


def _stars(ids: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Links of each member to its group's least, from a boolean matrix."""
    left, out = np.ones(len(ids), bool), []
    for i in range(len(ids)):
        if not left[i]:
            continue
        group, front = np.zeros(len(ids), bool), np.array([i])
        group[i] = True
        while len(front):
            new = near[front].any(0) & ~group
            group |= new
            front = np.flatnonzero(new)
        left &= ~group
        own = ids[group]
        root = int(own.min())
        out += [(int(x), root) for x in own if x != root]
    return out


_EDGE = "a bigint, b bigint"


def _compare_small(sets: DataFrame, least: int) -> DataFrame:
    """Links within nodes (``members``: array of struct(rep, sketch)), every pair compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(0)
            off, flat = col.offsets.to_numpy(), col.values
            ids, raw = flat.field("rep").to_numpy(), flat.field("sketch").to_pylist()
            out: list[tuple[int, int]] = []
            for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                m = _matrix(raw[lo:hi])
                if hi - lo == 2:
                    if np.count_nonzero(m[0] == m[1]) >= least:
                        out.append((int(max(ids[lo:hi])), int(min(ids[lo:hi]))))
                else:
                    out += _stars(ids[lo:hi], matches(m, m) >= least)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return sets.select("members").mapInArrow(run, _EDGE)


def _dealt(members: DataFrame, guides: DataFrame, key: str, size: str) -> DataFrame:
    """Members (rep, sketch) of large groups after their group's guides, in one stream for each part of a group.

    A group of ``size`` members is dealt in parts of about ``PART`` by hash; each part has the guides first, once, and
    then its members row by row, so neither a row nor a task holds more than the guides beside it.
    """
    parts = F.ceil(F.col(size) / PART)
    own = members.select(key, F.pmod(F.xxhash64("rep", F.lit(7)), parts).alias("part"), F.lit(1).alias("kind"), "rep", "sketch")
    lead = guides.select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"), F.lit(0).alias("kind"), "rep", "sketch")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lead.unionAll(own).repartition(n, key, "part").sortWithinPartitions(key, "part", "kind", "rep")


class _Guides:
    """The guides of the part that a stream of ``_dealt`` rows is in."""

    def __init__(self):
        self.at, self.ids, self.sketches, self.matrix = None, [], [], None

    def take(self, at, kind: int, rep: int, sketch: bytes) -> bool:
        """Whether the row is a guide (and kept as one)."""
        if at != self.at:
            self.at, self.ids, self.sketches, self.matrix = at, [], [], None
        if kind == 0:
            self.ids.append(rep)
            self.sketches.append(sketch)
            return True
        if self.matrix is None:
            self.matrix = _matrix(self.sketches)
        return False


def _branch(dealt: DataFrame, least: int, keep: int, depth: int, percent: int) -> DataFrame:
    """Large nodes: members linked with hubs (``a, b``), and the nodes (``node, rep``) that the others branch to.

    A member alike a hub beyond ``keep`` is done with: what it links to meets that hub as well.  Hubs that are joined
    among themselves need one link with a member, and of hubs that are not each gets its own, so no cluster is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hubs, group = _Guides(), None
        for b in batches:
            a, to, child = [], [], []
            for node, part, kind, rep, sketch in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if hubs.take((node, part), kind, rep, sketch):
                    group = None
                    continue
                if group is None:
                    stars = _stars(np.array(hubs.ids), matches(hubs.matrix, hubs.matrix) >= least)
                    root = dict(stars)
                    group = np.array([root.get(h, h) for h in hubs.ids])
                    hub_ids = np.array(hubs.ids)
                    if part == 0:
                        a += [x for x, _ in stars]
                        to += [y for _, y in stars]
                        child += [None] * len(stars)
                s = np.frombuffer(sketch, np.uint16)
                m = np.count_nonzero(hubs.matrix == s, axis=1)
                m[hub_ids == rep] = 0
                alike = m >= least
                if alike.any() and rep not in root and rep not in group:
                    _, first = np.unique(group[alike], return_index=True)
                    for h in hub_ids[alike][first]:
                        a.append(rep)
                        to.append(int(h))
                        child.append(None)
                if m.max(initial=0) < keep:
                    # Selected positions follow from the node, alike for all its members; 1 / similarity on average.
                    r = np.random.default_rng([node & 0x7FFFFFFFFFFFFFFF, depth])
                    for p in r.permutation(SKETCH)[: 1 + (r.random() < 100 / percent - 1)]:
                        a.append(rep)
                        to.append(None)
                        child.append(int.from_bytes(hashlib.blake2b(b"%d %d %d %d" % (node, depth, p, s[p]), digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, to, child)], names=["a", "b", "node"])

    return dealt.mapInArrow(run, _EDGE + ", node bigint")


def candidates(reps: DataFrame, percent: int = PERCENT, node: int = NODE, max_depth: int = 64) -> DataFrame:
    """Links (``a, b``) that join, in clusters, all pairs of (rep, roots, sketch) that meet in a node and whose sketches are alike.

    An error is raised should nodes still be large after ``max_depth`` branchings.
    """
    least = least_matches(percent)
    keep = SKETCH - (SKETCH - least) // 2
    rows = reps.select("rep", F.explode("roots").alias("node"))
    sketches = reps.select("rep", "sketch")
    found: list[DataFrame] = []
    for depth in range(max_depth):
        # Sketches are fetched for members that have company only; merge joins keep one plan at every size.
        sizes = rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1").hint("merge")
        live = stage(rows.join(sizes, "node").join(sketches.hint("merge"), "rep"))
        small = live.where(F.col("size") <= node).groupBy("node").agg(F.collect_list(F.struct("rep", "sketch")).alias("members"))
        found.append(stage(_compare_small(small, least).distinct()))
        hot = live.where(F.col("size") > node)
        if not hot.head(1):
            unstage(live)
            break
        order = Window.partitionBy("node").orderBy(F.xxhash64("rep", F.lit(depth)), "rep")
        hubs = hot.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= HUBS)
        out = stage(_branch(_dealt(hot, hubs, "node", "size"), least, keep, depth, percent))
        unstage(live)
        found.append(out.where("b is not null").select("a", "b"))
        rows = out.where("node is not null").select(F.col("a").alias("rep"), "node")
    else:
        raise RuntimeError(f"nodes of over {node} members after {max_depth} branchings")
    return reduce(DataFrame.unionAll, found)


def shingle_set(text: str, size: int = SIZE) -> frozenset[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return frozenset()
    return frozenset(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def solve(ids: list[int], texts: list[str], sketches: list[bytes], labels: list[int] | None, first: np.ndarray | None, percent: int, size: int, least: int) -> list[tuple[int, int]]:
    """Stars of what is linked among the rows, or joined by ``labels``; ``first`` marks those of which a pair needs one.

    Pairs already joined are not compared; the most central rows come first, as they join most.
    """
    n = len(ids)
    m = _matrix(sketches)
    near = matches(m, m)
    group = np.array(labels if labels is not None else ids)
    sets: list = [None] * n

    def get(i: int) -> frozenset[bytes]:
        if sets[i] is None:
            sets[i] = shingle_set(texts[i], size)
        return sets[i]

    joined = False
    rank = np.empty(n, np.int64)
    order = np.argsort(-near.astype(np.int64).sum(1), kind="stable")
    rank[order] = np.arange(n)
    for i in order:
        later = (near[i] >= least) & (group != group[i]) & (rank > rank[i])
        if first is not None and not first[i]:
            later &= first
        for j in np.flatnonzero(later):
            if group[i] == group[j]:
                continue
            x, y = get(i), get(j)
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                group[group == group[j]] = group[i]
                joined = True
    if not joined:
        return []
    # A star for each group: its least member's links to the others.
    out, centre = [], {}
    for i in np.argsort(np.array(ids), kind="stable").tolist():
        root = centre.setdefault(int(group[i]), ids[i])
        if root != ids[i]:
            out.append((ids[i], root))
    return out


def _solve_groups(rows: DataFrame, keys: list[str], percent: int, size: int, least: int) -> DataFrame:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("rep")  # a row may be repeated
        labels = part["label"].tolist() if "label" in part else None
        first = part["first"].to_numpy(bool) if "first" in part else None
        out = solve(part["rep"].tolist(), part["text"].tolist(), part["sketch"].tolist(), labels, first, percent, size, least)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    # A set number of partitions: groups of few bytes can take long, so they aren't merged by size.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).groupBy(*keys).applyInPandas(run, _EDGE)


def representatives(signed: DataFrame) -> DataFrame:
    """One row for each class of signed rows: ``cls, copies, rep`` (a number), the least id, and a row's id and text hash.

    A class's rows agree in all but the id and text.  Classes are numbered and not named by an id, as rows may share one.
    """
    one = signed.where("n > 0").groupBy("cls").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "hash")).alias("at"), *(F.first(c).alias(c) for c in ("n", "roots", "sketch"))
    )
    return stage(one.select("cls", "copies", "least_id", "at.doc_id", "at.hash", "n", "roots", "sketch", F.monotonically_increasing_id().alias("rep")))


def _texts(docs: DataFrame, seats: DataFrame) -> DataFrame:
    """Seats (doc_id, hash and others) with their texts."""
    rows = docs.where("text is not null").select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__hash"), "text")
    return seats.join(rows, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash"))).drop("doc_id", "hash", "__id", "__hash")


def linked(docs: DataFrame, reps: DataFrame, edges: DataFrame, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """``id, component`` (numbers of representatives) by links of full sets within the clusters that candidate ``edges`` make.

    A cluster beyond the bounds of a task is split by hash; its most central members go to every part.  If parts do
    not join, all pairs of which one lies outside the largest component follow in blocks, so no link is lost.
    """
    least = least_matches(percent)
    named = components(edges).select(F.col("id").alias("rep"), F.col("component").alias("cluster"))
    clusters = stage(named.join(reps.select("rep", "doc_id", "hash", "n", "sketch"), "rep").select("rep", "cluster", "doc_id", "hash", "n", "sketch"))
    total = clusters.count()
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("__n"), F.count("*").alias("members"), F.sum("n").alias("shingles"))
    sizes = sizes.withColumn("parts", F.greatest(F.ceil(F.col("members") / CHUNK), F.ceil(F.col("shingles") / CHUNK_SHINGLES)))
    placed = join_sized(clusters, sizes.select("cluster", "parts", "members", "__n"), "cluster", total)
    placed = stage(placed.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))))
    large = placed.where("parts > 1")
    any_large = bool(large.head(1))
    seats = placed.select("rep", "doc_id", "hash", "cluster", F.array("part").alias("at"), "sketch")
    if any_large:
        # Hubs: the members most like a random few.
        order = Window.partitionBy("cluster").orderBy(F.xxhash64("rep", F.lit(1)), "rep")
        few = large.withColumn("__n", F.row_number().over(order)).where(f"__n <= {HUBS}")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            few_ = _Guides()
            for b in batches:
                out: list = []
                for cluster, part, kind, rep, sketch in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                    if not few_.take((cluster, part), kind, rep, sketch):
                        out.append((cluster, rep, int(np.count_nonzero(few_.matrix == np.frombuffer(sketch, np.uint16)))))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["cluster", "rep", "like"])

        central = _dealt(large, few, "cluster", "members").mapInArrow(score, "cluster bigint, rep bigint, like bigint")
        order = Window.partitionBy("cluster").orderBy(F.desc("like"), "rep")
        hubs = central.withColumn("__n", F.row_number().over(order)).where(f"__n <= {CHUNK_HUBS}").select("rep", F.lit(True).alias("hub"))
        seats = placed.join(hubs, "rep", "left").select("rep", "doc_id", "hash", "cluster", F.when(F.col("hub"), F.expr("sequence(0, parts - 1)")).otherwise(F.array("part")).alias("at"), "sketch")
    texts = _texts(docs, seats)
    out = stage(_solve_groups(texts.withColumn("part", F.explode("at")).drop("at"), ["cluster", "part"], percent, size, least).distinct())
    names = components(out)
    if not any_large:
        return names
    # What is left of large clusters.
    found = names.select(F.col("id").alias("rep"), F.col("component").alias("label"))
    left = stage(large.select("rep", "doc_id", "hash", "cluster", "sketch", "members").join(found, "rep", "left").withColumn("label", F.coalesce("label", "rep")))
    groups = left.groupBy("cluster", "label").agg(F.count("*").alias("own")).groupBy("cluster").agg(
        F.max_by("label", F.struct("own", "label")).alias("main"), F.max("own").alias("in_main"), F.count("*").alias("groups"), F.sum("own").alias("__n")
    )
    open_ = join_sized(left, groups.where("groups > 1"), "cluster", total).withColumn("first", F.col("label") != F.col("main"))
    open_ = open_.withColumn("blocks", F.ceil((F.col("members") - F.col("in_main")) / BLOCK)).withColumn("chunks", F.ceil(F.col("members") / BLOCK))
    open_ = stage(open_.drop("members"))
    if not open_.head(1):
        return names
    # A row outside the main component goes, as the first of a pair, to every chunk of its block; every row goes, as the second, to every block of its chunk.
    seats = open_.select("rep", "doc_id", "hash", "cluster", "sketch", "label", "first", F.explode(F.when(F.col("first"), F.concat(
        F.expr("transform(sequence(0, chunks - 1), c -> named_struct('block', pmod(xxhash64(rep, 2), blocks), 'chunk', c, 'first', true))"),
        F.expr("transform(sequence(0, blocks - 1), b -> named_struct('block', b, 'chunk', pmod(xxhash64(rep, 3), chunks), 'first', false))"),
    )).otherwise(F.expr("transform(sequence(0, blocks - 1), b -> named_struct('block', b, 'chunk', pmod(xxhash64(rep, 3), chunks), 'first', false))"))).alias("s"))
    seats = seats.groupBy("rep", "doc_id", "hash", "cluster", "label", F.col("s.block").alias("block"), F.col("s.chunk").alias("chunk")).agg(F.max("s.first").alias("first"), F.first("sketch").alias("sketch"))
    more = _solve_groups(_texts(docs, seats), ["cluster", "block", "chunk"], percent, size, least)
    return components(names.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more))


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", percent: int = PERCENT, size: int = SIZE, keep_hash: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row (and ``hash``, xxhash64 of the text, if asked for).

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of ``size``-word shingles (A-Z
    lower-cased); a shorter document is one shingle, and one without words or text links with nothing.
    ``component_id`` is the least id reachable, of whatever type ids have.  Rows that share an id and not their words
    are documents of their own.  A null id never names a component: its row takes the least id of those it is joined
    with, or null, and is not kept.  Ties need no rule: the result does not depend on order.  An empty table gives no
    rows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = stage(signatures(docs, size))
    reps = representatives(signed)
    names = linked(docs, reps, candidates(reps, percent), percent, size)
    # The least id of each component, then of each class.
    ends = stage(names.select(F.col("id").alias("rep"), F.col("component").alias("a")).join(reps.select("rep", F.col("least_id").alias("b")), "rep"))
    least = joined_least(ends, ends.count()).select("rep", F.col("m").alias("component"))
    alone = reps.join(ends, "rep", "left_anti").select("rep", F.col("least_id").alias("component"))
    classes = reps.select("rep", "cls", F.col("copies").alias("__n")).join(least.unionAll(alone), "rep").select("cls", "component", "__n")
    out = join_sized(signed.select("doc_id", "hash", "n", "cls"), stage(classes), "cls", signed.count(), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "hash")
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return out if keep_hash else out.drop("hash")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id AS id, doc_id AS c FROM w UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.id),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN m ON m.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
