"""The trie of all conversations' prefixes, merged family by family.

Conversations of one family (ids with the same base id) meet in one task, are rebuilt with the
base's first turns, and make a small trie; a turn travels as the digest of its role and text and its
number of words. A node is named by a digest of its path, so that nodes of different families that
are one node meet when the families' nodes, not the turns, are shuffled and added up.

Sums over subtrees need no walk over depths. A node belongs to its smallest member; what a
conversation owns is the lower end of its own path. A subtree's sum is what its owner has from there
down, and the whole of what each other member owns, all of which lies in the subtree. So each
conversation's total goes back to its family, and every family node gives its members' totals to the node.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quill.llm.runtime import checkpoint, tune, written

#: Ids of a family, and the number of turns a conversation takes from its base: crc32 of its id modulo this.
FAMILY, SHARED = 20, 4
#: Families that are neighbours and go to one task, where their ends are joined before they are shuffled.
BLOCK = 8
#: Rows of one Arrow batch of nodes, and bytes of ends that a task holds, about.
ROWS, ENDS = 20_000, 4 << 20
_ROOT = bytes(16)

_SCHEMA = pa.schema(
    [("path", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("base", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("mask", pa.int64()), ("words", pa.int64()), ("ends", pa.string())]
)


def shared_turns(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % SHARED


class Family:
    """The trie of one family: lists over its nodes, the root first."""

    def __init__(self, base: int, turns: dict[int, list[tuple[bytes, int]]]):
        self.path, self.parent, self.depth, self.words = [_ROOT], [-1], [0], [0]
        self.members: list[list[int]] = [[]]
        self.ends: dict[int, list[int]] = {}
        below: dict[tuple[int, bytes], int] = {}
        first = turns.get(base, [])
        for conv in sorted(turns):
            n, at = shared_turns(conv), 0
            self.members[0].append(conv)
            for digest, words in first[:n] + turns[conv][n:]:
                at, above = below.setdefault((at, digest), len(self.path)), at
                if at == len(self.path):
                    self.path.append(hashlib.blake2b(self.path[above] + digest, digest_size=16).digest())
                    self.parent.append(above)
                    self.depth.append(self.depth[above] + 1)
                    self.words.append(words)
                    self.members.append([])
                self.members[at].append(conv)
            self.ends.setdefault(at, []).append(conv)


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, dict]]:
    """(block, base, turns of each conversation) of rows sorted by block, base, conversation and turn."""
    now, turns = None, {}
    for batch in batches:
        for block, base, conv, digest, words in zip(*(batch.column(c).to_pylist() for c in ("block", "base", "c", "digest", "words")), strict=True):
            if (block, base) != now:
                if now:
                    yield *now, turns
                now, turns = (block, base), {}
            turns.setdefault(conv, []).append((digest, words))
    if now:
        yield *now, turns


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of every family's nodes, and of the ends of a block's nodes: ids that end there, ascending."""
    rows: list[tuple] = []
    ends: dict[bytes, list[int]] = {}
    held, last = 0, None

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
        rows.clear()
        return out

    def flush() -> None:
        rows.extend((path, None, None, None, own[0], None, None, None, ",".join(map(str, own))) for path, own in ends.items())
        ends.clear()

    for block, base, turns in _families(batches):
        if block != last or held > ENDS:
            flush()
            held, last = 0, block
        family = Family(base, turns)
        for i, (path, up, depth, words, own) in enumerate(zip(family.path, family.parent, family.depth, family.words, family.members, strict=True)):
            rows.append((path, family.path[up] if up >= 0 else None, depth, base, own[0], len(own), sum(1 << (c - base + FAMILY - 1) for c in own), words, None))
            if i in family.ends:
                ends.setdefault(path, []).extend(family.ends[i])
                held += 40 * len(family.ends[i])
            if len(rows) >= ROWS:
                yield batch()
    flush()
    if rows:
        yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each path's ends, which come in pieces sorted by path and first id; only the digest's state is held."""
    path, state = None, None
    schema = pa.schema([("path", pa.binary()), ("ends_sha256", pa.string())])
    for batch in batches:
        done = []
        for p, text in zip(batch.column("path").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if p != path:
                if state:
                    done.append((path, state.hexdigest()))
                path, state = p, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
    if state:
        yield pa.RecordBatch.from_pydict({"path": [path], "ends_sha256": [state.hexdigest()]}, schema=schema)


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every turn that has a conversation: c, base, block, turn, the digest of role and text, and its number of words."""
    col = lambda c: conversations[f"`{c.replace('`', '``')}`"]
    role, text = F.coalesce(col(role_col), F.lit("")), F.coalesce(col(text_col), F.lit(""))
    t = conversations.select(
        col(id_col).cast("long").alias("c"), col(turn_col).alias("turn"), F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long").alias("words"),
    ).where(F.col("c").isNotNull())
    return t.withColumn("base", F.col("c") - F.col("c") % FAMILY).withColumn("block", F.col("base") - F.col("base") % (FAMILY * BLOCK))


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, path (hex).

    Turns go by turn, null first; turns that tie by the digest of role and text. Null role or text is
    empty. Rows that repeat are turns each. Rows without a conversation's id belong to no conversation and are
    left out; an empty table has no nodes, not even a root. Ids are whole numbers; other columns, whatever they
    are called, are not read. A family's turns (40 bytes each) are held by one task.
    """
    spark = conversations.sparkSession
    tune(spark)
    dealt = turns_of(conversations, id_col, turn_col, role_col, text_col).repartition("block")
    dealt = dealt.sortWithinPartitions("block", "base", F.col("c") != F.col("base"), "c", F.col("turn").asc_nulls_first(), "digest").select("block", "base", "c", "digest", "words")
    merged = written(dealt.mapInArrow(_merge, "path binary, parent binary, depth long, base long, first long, n long, mask long, words long, ends string"))
    own = merged.where(F.col("depth").isNotNull()).drop("ends")

    nodes = own.groupBy("path").agg(F.min("parent").alias("parent"), F.max("depth").alias("depth"), F.min("first").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("words").alias("words"))
    nodes = checkpoint(nodes)
    below = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(below, "path", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = checkpoint(nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}))

    # What each conversation owns, and from which depth on, goes back to its family: FAMILY * 2 - 1 entries at most.
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    entry = F.struct((F.col("conv_id") - F.col("base") + FAMILY - 1).cast("int").alias("bit"), "top", "leaf", "saved")
    totals = owned.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).groupBy("base").agg(F.collect_list(entry).alias("owned"))
    given = own.select("path", "base", "depth", "mask").join(totals, "base")
    others = F.filter("owned", lambda x: (x["top"] > F.col("depth")) & (F.call_function("shiftright", F.col("mask"), x["bit"]) % 2 != 0))
    given = given.select("path", others.alias("o")).where(F.size("o") > 0)
    total = lambda name: F.aggregate("o", F.lit(0).cast("long"), lambda a, x: a + x[name])
    given = given.select("path", total("leaf").alias("leaf_below"), total("saved").alias("saved_below")).groupBy("path").agg(F.sum("leaf_below").alias("leaf_below"), F.sum("saved_below").alias("saved_below"))

    down = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    mine = nodes.withColumns({"leaf": F.sum("leaf").over(down), "saved": F.sum("saved").over(down)})
    ends = merged.where(F.col("ends").isNotNull()).select("path", "first", "ends").repartition("path").sortWithinPartitions("path", "first").select("path", "ends").mapInArrow(_digests, "path binary, ends_sha256 string")
    above = nodes.select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = mine.join(given, "path", "left").join(ends, "path", "left").join(above, "parent", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaf") + F.coalesce("leaf_below", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("saved_below", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), F.hex("path").alias("path"),
    )
