"""Chat logs that hold a conversation again and again as it grows: only the longest snapshots are rendered.

Every step of a conversation (all its rows of one turn number) gets a hash of turn, role and text; the running XOR
over the turns is the hash of the prefix that ends there, twice with different salts (128 bits). A conversation
whose whole hash is a proper prefix of another one is a snapshot and goes by an anti join; of equal ones the smallest id stays.

Order is the turn number (null first), within it role and text; rows that repeat in full count once. Rows without a
conversation id belong to no conversation and are left out. Null roles and texts read as empty when rendered
but differ from empty ones when compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from scanlake.scale import CHUNK, keys_fit, range_chunks, running_sum, stable

#: Turns (rows) that one rendered row holds at most; a longer conversation has several parts that follow on each other.
PART_TURNS = 1024
#: Bytes at which a rendered row ends: the turn that reaches them is its last.
PART_BYTES = 64 << 20
HASH = ["h1", "h2"]


def prefix_hashes(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, h1, h2): hash of the prefix that ends with this turn.

    Steps are narrow rows, written once. A conversation of more steps than one task may sort is cut into range pieces by position,
    whatever its turn numbers are; each piece starts from the XOR of those before it, of which there are no more than range partitions.
    """
    salted = [F.bit_xor(F.xxhash64(F.lit(salt), F.coalesce("turn", F.lit(-1)), F.col("turn").isNull(), F.col("role").isNull(), F.coalesce("role", F.lit("")),
                                   F.col("text").isNull(), F.coalesce("text", F.lit("")))).alias(h) for salt, h in zip((1, 2), HASH)]
    steps = stable(rows.groupBy("conv_id", "turn").agg(*salted))
    if keys_fit(steps, ["conv_id"]):
        upto = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
        return steps.select("conv_id", "turn", *[F.bit_xor(h).over(upto).alias(h) for h in HASH])
    pieces = range_chunks(steps, ["conv_id"], ["turn"])
    earlier = W.partitionBy("conv_id").orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    bases = pieces.groupBy("conv_id", CHUNK).agg(*[F.bit_xor(h).alias(h) for h in HASH])
    bases = bases.select("conv_id", CHUNK, *[F.bit_xor(h).over(earlier).alias(f"{h}_base") for h in HASH]).filter("h1_base is not null")
    inside = W.partitionBy("conv_id", CHUNK).orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    run = pieces.select("conv_id", "turn", CHUNK, *[F.bit_xor(h).over(inside).alias(h) for h in HASH])
    return run.join(F.broadcast(bases), ["conv_id", CHUNK], "left").select("conv_id", "turn", *[F.col(h).bitwiseXOR(F.coalesce(f"{h}_base", F.lit(0))).alias(h) for h in HASH])


def maximal(rows: DataFrame) -> DataFrame:
    """(conv_id, last_turn, copies): conversations that prefix no longer one; of equal ones the smallest id."""
    prefixes = stable(prefix_hashes(rows))
    last = F.max_by(F.struct(*HASH), F.coalesce(F.col("turn"), F.lit(-(2**63)))).alias("whole")
    whole = prefixes.groupBy("conv_id").agg(last, F.max("turn").alias("last_turn")).select("conv_id", "last_turn", "whole.*")
    classes = whole.groupBy(*HASH).agg(F.min("conv_id").alias("conv_id"), F.max("last_turn").alias("last_turn"), F.count("*").alias("copies"))
    kept = classes.select("conv_id", F.col("last_turn").alias("_last"))
    proper = prefixes.join(kept, "conv_id").filter(~F.col("turn").eqNullSafe(F.col("_last"))).select(*HASH).distinct()
    return classes.join(proper, HASH, "left_anti").select("conv_id", "last_turn", "copies")


def render(rows: DataFrame, head: str = "<|im_start|>", tail: str = "<|im_end|>\n") -> DataFrame:
    """(conv_id, part, n_turns, rendered): turns as ``head role newline text tail``; parts in order make the whole.

    ``rows`` are distinct. Parts are cut by a running sum over the rows in order, whatever their turn numbers are: a row
    weighs its bytes, at least the ``PART_TURNS``-th of a part. Part numbers ascend; a turn larger than a part leaves some out.
    """
    piece = F.concat(F.lit(head), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(tail))
    least = -(-PART_BYTES // PART_TURNS)
    weight = F.greatest(F.octet_length(piece).cast("long"), F.lit(least))
    placed = running_sum(rows.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn", "role", "text"], weight, "until")
    begin = F.col("until") - weight
    cut = placed.select("conv_id", F.floor(begin / (least * PART_TURNS)).alias("part"), F.struct(begin.alias("begin"), piece.alias("piece")).alias("t"))
    parts = cut.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return parts.select("conv_id", "part", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("rendered"))


def collapsed(conversations: DataFrame) -> DataFrame:
    """Rendered maximal conversations: (conv_id, part, n_turns, copies, rendered)."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").filter("conv_id is not null").distinct()
    kept = maximal(rows).select("conv_id", "copies")
    return render(rows.join(kept.select("conv_id"), "conv_id", "left_semi")).join(kept, "conv_id").select("conv_id", "part", "n_turns", "copies", "rendered")
