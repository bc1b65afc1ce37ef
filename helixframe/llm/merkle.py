"""A Merkle manifest of a dataset: every row's digest, one root, and each row's path to it, by fractal traversal.

A row is a leaf, the hash of its fields. Within a group the leaves stand in the
order of their key, and every two neighbours become their hash, level by level
(the last one alone, where their number is odd), until one remains; these
subroots, in the order of the groups, become the root likewise.

Ranks come from one range partitioning: a task numbers what it reads in order,
and the tasks' counts say where each begins. A group's leaves are then cut into
aligned blocks of 2^10. A block's root is a leaf of the tree above, which is cut
into blocks in its turn, so there are as many levels of jobs as the logarithm
of the rows to base 1024. On the way down a block gets the path of its root as a
row before its leaves, and its task emits the leaves' paths from left to right
by fractal traversal (Jakobsson, Leighton, Micali and Szydlo, 2003): the block's
tree is stacked subtrees of two levels; of each level of the stack the subtree
over the present leaf exists, and the next one is built by a few steps for
each leaf, so the values held are a few times the block's height. Each path is
continued by the path of the block.

A path is the siblings' digests in one text, from the leaf's level up, and a
letter for each level: L or R for the side where the sibling stands, - where there
is none. With these and a leaf anyone can work out the root again (``folded``).

A null group comes first; groups are ordered bytewise. A null key comes first;
rows of equal keys are ordered by their digests, and rows alike in both by
chance, which changes no digest, as they are the same. Every row has a leaf. Texts
of any length stay in the task that reads them. An empty table gives no row.
Columns carried along keep their names, but for those of the new columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import small_batches, table, without
from helixframe.plans.scratch import cut

#: Levels of a block's tree, and of a subtree of the traversal.
BLOCK, STEP = 10, 2
#: Rows up to which a table is sent to all tasks.
SMALL = 100_000
#: Hex digits of a digest.
HEX = 64

Digest = bytes | None


def joined(left: Digest, right: Digest) -> Digest:
    """A node of one child or two; none of none."""
    if left is None:
        return None
    return sha256(left if right is None else left + right).hexdigest().encode()


class Builder:
    """Works through the leaves below one node, by ``step``s of a leaf or a hash, and keeps the nodes that ``want`` asks for."""

    def __init__(self, leaf: Callable[[int], Digest], first: int, height: int, want: Callable[[int, int], bool]):
        self.leaf, self.at, self.height, self.want = leaf, first, height, want
        self.stack: list[tuple[int, int, Digest]] = []
        self.nodes: dict[tuple[int, int], Digest] = {}

    def done(self) -> bool:
        return len(self.stack) == 1 and self.stack[0][0] == self.height

    def step(self, times: int) -> None:
        stack = self.stack
        for _ in range(times):
            if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
                t, _, right = stack.pop()
                _, i, left = stack.pop()
                node = (t + 1, i >> 1, joined(left, right))
            elif stack and stack[-1][0] == self.height:
                return
            else:
                node = (0, self.at, self.leaf(self.at))
                self.at += 1
            stack.append(node)
            if self.want(node[0], node[1]):
                self.nodes[node[0], node[1]] = node[2]


def height_of(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    return max(0, n - 1).bit_length()


def root_of(leaves: list[bytes], height: int) -> bytes:
    """The node at ``height`` above the leaves; there may be fewer of these than fit."""
    built = Builder(lambda i: leaves[i] if i < len(leaves) else None, 0, height, lambda t, i: False)
    built.step(2 << height)
    return built.stack[0][2]


def traverse(leaves: list[bytes], height: int, step: int = STEP) -> Iterator[tuple[bytes, str]]:
    """(siblings, sides) of each leaf in turn, from stacked subtrees of ``step`` levels that exist, and the next ones that are built meanwhile."""
    count = len(leaves)

    def leaf(i: int) -> Digest:
        return leaves[i] if i < count else None

    tops = [min(low + step, height) for low in range(0, height, step)]

    def wanted(low: int, top: int) -> Callable[[int, int], bool]:
        return lambda t, i: low <= t < top

    def begin(level: int, root: int) -> Builder | None:
        """The subtree of a level over its ``root``-th node; there is none beyond the leaves."""
        top = tops[level]
        return Builder(leaf, root << top, top, wanted(level * step, top)) if root << top < count else None

    existing: list[dict] = []
    for level, top in enumerate(tops):
        first = begin(level, 0)
        first.step(2 << top)
        existing.append(first.nodes)
    desired = [begin(level, 1) for level in range(len(tops))]
    for j in range(count):
        siblings, sides = [], []
        for t in range(height):
            k = (j >> t) ^ 1
            found = existing[t // step].get((t, k))
            sides.append("-" if found is None else "R" if k & 1 else "L")
            if found is not None:
                siblings.append(found)
        yield b"".join(siblings), "".join(sides)
        for level, top in enumerate(tops):
            built = desired[level]
            if built is not None:
                built.step(2)  # a subtree's leaves and hashes are fewer than twice the leaves it follows
            if (j + 1) % (1 << top) == 0 and built is not None:
                existing[level] = built.nodes
                desired[level] = begin(level, ((j + 1) >> top) + 1)


def numbered(items: DataFrame, order: list[str]) -> DataFrame:
    """``items`` (with a text ``g`` that isn't null) with i, the rank from 0 in the group by ``order``, and m, the group's size.

    Rows alike in all of ``order`` are dealt out by a random number, written
    before, so a key of a third of all rows has no task of its own.
    """
    items = cut(items.withColumn("__salt", F.rand(11)), "items")
    small_batches(items.sparkSession)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            at = []
            for g in b.column(0).to_pylist():
                n = n + 1 if g == group else 0
                group = g
                at.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(at, pa.int64())], [*b.schema.names, "part", "at"])

    names = ["g", *[c for c in items.columns if c not in ("g", "__salt")]]
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = items.repartitionByRange(parts, "g", *order, "__salt").sortWithinPartitions("g", *order).select(*names)
    schema = T.StructType([*ranged.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])
    found = cut(ranged.mapInArrow(count, schema), "numbered")
    each = found.groupBy("g", "part").agg(F.count("*").alias("c"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = cut(each.select("g", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy("g")).alias("m")), "counts")
    return found.join(_small(each), ["g", "part"]).withColumn("i", F.col("before") + F.col("at")).drop("part", "at", "before")


def _small(df: DataFrame) -> DataFrame:
    """Sent to all tasks if it has few rows; joined by shuffles else."""
    return F.broadcast(df) if df.count() <= SMALL else df.hint("merge")


def _blocks(df: DataFrame, leaf: Callable[[dict, list[dict]], Iterable], schema: str) -> DataFrame:
    """``leaf`` on each block's rows of the sorted stream, in order. A block begins where j is the least: -1 for a row that stands before its leaves."""
    names = df.columns
    at = [names.index(c) for c in ("g", "block", "j")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            block, j = b.column(at[1]).to_numpy(), b.column(at[2]).to_numpy()
            g = b.column(at[0]).dictionary_encode()
            codes, texts = g.indices.to_numpy(), g.dictionary.to_pylist()
            new = np.flatnonzero((np.diff(block) != 0) | (np.diff(codes) != 0)) + 1
            for x, y in zip([0, *new.tolist()], [*new.tolist(), len(j)], strict=True):
                if held and (texts[codes[x]], block[x]) != key:
                    yield from leaf(pa.Table.from_batches(held))
                    held = []
                key = (texts[codes[x]], block[x])
                held.append(b.slice(x, y - x))
        if held:
            yield from leaf(pa.Table.from_batches(held))

    small_batches(df.sparkSession)
    return df.repartition("g", "block").sortWithinPartitions("g", "block", "j").mapInArrow(run, schema)


def _in_blocks(items: DataFrame) -> DataFrame:
    return items.withColumn("block", F.shiftright("i", BLOCK)).withColumn("j", F.col("i").bitwiseAND((1 << BLOCK) - 1))


def _height(m: int) -> int:
    """Of a block's tree, in a group of m leaves: whole, if there are more blocks."""
    return min(BLOCK, height_of(m))


def _hex(column: pa.ChunkedArray) -> list[bytes]:
    return [x.hex().encode() for x in column.to_pylist()]


def block_roots(items: DataFrame) -> DataFrame:
    """(g, i, m, digest): the blocks of (g, i, m, digest) as leaves of the tree above."""

    def root(t: pa.Table) -> Iterator[pa.RecordBatch]:
        m = t.column("m")[0].as_py()
        digest = bytes.fromhex(root_of(_hex(t.column("digest")), _height(m)).decode())
        values = [t.column("g")[0].as_py(), t.column("block")[0].as_py(), -(-m >> BLOCK), digest]
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["g", "i", "m", "digest"])

    return _blocks(_in_blocks(items.select("g", "i", "m", "digest")), root, "g string, i long, m long, digest binary")


def _paths(items: DataFrame, above: DataFrame) -> DataFrame:
    """``items`` (g, i, m, digest, rec) with siblings, sides, and what ``above`` (g, i: the block) says of the block: its path goes on where the leaf's ends."""
    own = _in_blocks(items.select("g", "i", "m", "digest", "rec"))
    texts = ["siblings", "sides", "subroot", "root"]
    own = own.select("g", "block", "j", "m", "digest", "rec", *[F.lit(None).cast("string").alias(c) for c in texts])
    head = above.select("g", F.col("i").alias("block"), F.lit(-1).cast("long").alias("j"), F.lit(None).cast("long").alias("m"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast(items.schema["rec"].dataType).alias("rec"), *texts)

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        up = {c: t.column(c)[0].as_py() for c in texts}
        t = t.slice(1).combine_chunks()
        if not t.num_rows:
            return
        found = list(traverse(_hex(t.column("digest")), _height(t.column("m")[0].as_py())))
        n = t.num_rows
        siblings = pa.array([s.decode() + up["siblings"] for s, _ in found], pa.string())
        sides = pa.array([s + up["sides"] for _, s in found], pa.string())
        i = pa.array((t.column("block").to_numpy() << BLOCK) + t.column("j").to_numpy(), pa.int64())
        kept = [t.column(c).combine_chunks() for c in ("g", "digest", "rec")]
        more = [siblings, sides, *(pa.array([up[c]] * n, pa.string()) for c in ("subroot", "root"))]
        yield from pa.Table.from_arrays([kept[0], i, *kept[1:], *more], ["g", "i", "digest", "rec", *texts]).to_batches()

    schema = T.StructType([*items.select("g", "i", "digest", "rec").schema.fields, *[T.StructField(c, T.StringType()) for c in texts]])
    return _blocks(own.unionByName(head), emit, schema)


def _authenticated(items: DataFrame, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``items`` (g, i, m, digest, rec) with their paths; ``above`` continues the ones of the groups' roots (g, i, digest): (g, i, siblings, sides, subroot, root)."""
    levels = [items]
    while (levels[-1].agg(F.max("m")).first()[0] or 0) > 1 << BLOCK:
        levels.append(cut(block_roots(levels[-1]).withColumn("rec", F.lit(None).cast("int")), "roots"))
    up = above(cut(block_roots(levels[-1]), "subroots"))
    for level in levels[:0:-1]:
        up = cut(_paths(level, up), "paths")
    return _paths(items, up)


def _groups(subroots: DataFrame) -> DataFrame:
    """Paths of the groups' roots to the root of all, in a tree of the groups."""
    one = subroots.select(F.lit("").alias("g"), F.struct("g").alias("rec"), F.col("g").alias("by"), "digest")
    items = cut(numbered(one, ["by"]).drop("by"), "groups")

    def ends(root: DataFrame) -> DataFrame:
        last = F.lower(F.hex("digest"))
        return root.select("g", "i", F.lit("").alias("siblings"), F.lit("").alias("sides"), last.alias("subroot"), last.alias("root"))

    found = _authenticated(items, ends)
    return found.select("rec.g", F.lit(0).cast("long").alias("i"), "siblings", "sides", F.lower(F.hex("digest")).alias("subroot"), "root")


def field(c: Column) -> Column:
    """A field of a leaf: its length in bytes and its value, or - for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)).cast("binary"), 256)


def manifest(df: DataFrame, *, digest: Column, group: Column, key: Column) -> DataFrame:
    """``df`` with leaf, siblings, sides, subroot and root. ``digest``: a leaf's hash in hex, as ``leaf`` makes it of fields.

    The columns of ``df`` go through the shuffles: pass those that are needed.
    """
    keep = without(df, "leaf", "siblings", "sides", "subroot", "root")
    rec = F.struct(*[F.col(f"`{c}`") for c in keep])
    named = F.when(group.isNull(), "").otherwise(F.concat(F.lit("+"), group.cast("string")))
    rows = df.select(named.alias("g"), key.alias("key"), F.unhex(digest).alias("digest"), rec.alias("rec"))
    items = cut(numbered(rows, ["key", "digest"]).drop("key"), "ranked")
    found = _authenticated(items, _groups)
    return found.select("rec.*", F.lower(F.hex("digest")).alias("leaf"), "siblings", "sides", "subroot", "root")


def folded(digest: Column, siblings: Column, sides: Column) -> Column:
    """The root that a leaf and its path give."""
    start = F.struct(digest.alias("h"), F.lit(1).alias("at"))

    def up(state: Column, level: Column) -> Column:
        h, at, side = state["h"], state["at"], F.substr(sides, level, F.lit(1))
        near = F.substr(siblings, at, F.lit(HEX))
        both = F.when(side == "L", F.concat(near, h)).when(side == "R", F.concat(h, near)).otherwise(h)
        return F.struct(F.sha2(both.cast("binary"), 256).alias("h"), (at + F.when(side == "-", 0).otherwise(HEX)).alias("at"))

    levels = F.filter(F.sequence(F.lit(0), F.length(sides)), lambda i: i > 0)
    return F.aggregate(levels, start, up, lambda s: s["h"])


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and what becomes of the root where n_chars was tampered with."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in docs.columns]
    other = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in docs.columns]
    hurt = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    rows = docs.select("doc_id", "lang", leaf(*fields).alias("digest"), F.when(hurt, F.unhex(leaf(*other))).alias("tampered"))
    found = manifest(rows, digest=F.col("digest"), group=F.col("lang"), key=F.col("doc_id"))
    shown = F.coalesce(F.lower(F.hex("tampered")), F.col("leaf"))
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"), folded(shown, F.col("siblings"), F.col("sides")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels that the SQL has room for, in a group and above the groups.
_HIGH, _WIDE = 24, 6


def _levels(name: str, key: str, high: int) -> str:
    """Tables of the levels of a tree, from ``name``0 (key, i, h) on: a level is made while the one below has two nodes or more."""
    by = f"PARTITION BY {key}" if key else ""
    own = f"{key}, " if key else ""
    made = [
        f"{name}{t} AS MATERIALIZED (SELECT {own}i // 2 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM (SELECT *, count(*) OVER ({by}) AS c FROM {name}{t - 1}) WHERE c > 1 GROUP BY {own}i // 2)"
        for t in range(1, high + 1)
    ]
    every = " UNION ALL ".join(f"SELECT {t} AS t, * FROM {name}{t}" for t in range(high + 1))
    return ",\n".join([*made, f"{name} AS MATERIALIZED ({every})"])


def _field_sql(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


_LEAF_SQL = "sha256({})".format
_CRC_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)), 4294967295::BIGINT)"

OP13_SQL = f"""
WITH RECURSIVE leaf AS MATERIALIZED (
  SELECT doc_id, coalesce('+' || lang, '') AS g, {_LEAF_SQL(' || '.join(map(_field_sql, ('doc_id', 'source', 'lang', 'n_chars', 'text'))))} AS h,
         CASE WHEN doc_id IS NOT NULL AND {_CRC_SQL} % 7 = 0 THEN {_LEAF_SQL(' || '.join(map(_field_sql, ('doc_id', 'source', 'lang', '(n_chars + 1)', 'text'))))} END AS bad
  FROM documents
), ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaf
), n0 AS MATERIALIZED (SELECT g, i, h FROM ranked),
{_levels('n', 'g', _HIGH)},
sub AS MATERIALIZED (SELECT g, max(t) AS top, arg_max(h, t) AS subroot, row_number() OVER (ORDER BY g) - 1 AS i FROM n GROUP BY g),
w0 AS MATERIALIZED (SELECT i, subroot AS h FROM sub),
{_levels('w', '', _WIDE)},
total AS MATERIALIZED (SELECT max(t) AS top, arg_max(h, t) AS root FROM w),
low(doc_id, g, leaf, i, t, top, cur, sibs) AS (
  SELECT r.doc_id, r.g, r.h, r.i, 0, s.top, coalesce(r.bad, r.h), '' FROM ranked r JOIN sub s USING (g)
  UNION ALL
  SELECT l.doc_id, l.g, l.leaf, l.i // 2, l.t + 1, l.top, sha256(CASE WHEN l.i % 2 = 1 THEN coalesce(s.h, '') || l.cur ELSE l.cur || coalesce(s.h, '') END), l.sibs || coalesce(s.h, '')
  FROM low l LEFT JOIN n s ON s.t = l.t AND s.g = l.g AND s.i = xor(l.i, 1) WHERE l.t < l.top
), high(doc_id, leaf, subroot, i, t, top, root, cur, sibs) AS (
  SELECT l.doc_id, l.leaf, s.subroot, s.i, 0, x.top, x.root, l.cur, l.sibs FROM low l JOIN sub s USING (g), total x WHERE l.t = l.top
  UNION ALL
  SELECT h.doc_id, h.leaf, h.subroot, h.i // 2, h.t + 1, h.top, h.root, sha256(CASE WHEN h.i % 2 = 1 THEN coalesce(s.h, '') || h.cur ELSE h.cur || coalesce(s.h, '') END), h.sibs || coalesce(s.h, '')
  FROM high h LEFT JOIN w s ON s.t = h.t AND s.i = xor(h.i, 1) WHERE h.t < h.top
)
SELECT doc_id, leaf, subroot, root, sha256(sibs) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM high WHERE t = top
"""
