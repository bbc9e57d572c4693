"""Rebuilding conversations from message rows (problem 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.ranking import HOT_ROWS, ranked
from mnemospark.session import materialize

ROLE_ORDER = ("system", "user", "tool", "assistant")
# Characters that show nothing, beside white space, controls and formats: fillers and the blank braille cell.
_NOTHING = r"^[\s\p{Z}\p{C}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}]*$"


def is_blank(text: Column) -> Column:
    """Null, or only white space and invisible characters."""
    return text.isNull() | text.rlike("(?U)" + _NOTHING)


def roles(aliases: DataFrame) -> DataFrame:
    """alias (one spelling) and role."""
    return aliases.select(spelling(F.col("alias_text")).alias("_alias"), F.col("speaker_role").alias("role")).dropDuplicates(["_alias"])


def spelling(speaker: Column) -> Column:
    """Without case, surrounding white space and one trailing colon."""
    bare = F.regexp_replace(speaker, r"(?U)^\s+|\s+$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r":$", ""), r"(?U)\s+$", ""))


def messages(chunks: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per chunk_id that belongs to a conversation, with role and parent; notes are left out.

    A chunk that came more than once counts once: deliveries differ only in fields
    that aren't read here. Text is reduced to whether it is blank before the shuffle.
    """
    rows = chunks.filter(F.col("chunk_id").isNotNull() & (F.trim(F.coalesce("conversation_id", F.lit(""))) != ""))
    rows = rows.select(
        "chunk_id", "conversation_id", "user_id", F.col("timestamp").cast("timestamp").alias("at"), spelling(F.col("speaker")).alias("_alias"),
        F.get_json_object("extra", "$.reply_to").alias("parent"), is_blank(F.col("text")).alias("blank"),
    )
    rows = rows.dropDuplicates(["conversation_id", "chunk_id"])
    return rows.join(roles(aliases), "_alias", "left").drop("_alias")


def jump_tables(msgs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Threads of msgs, and per round k the pointer of every message to its ancestor 2^k steps up, where there is one.

    Every message starts with a pointer to its parent and doubles its reach in each
    round by taking its target's pointer. A round joins only the messages whose chain
    goes on with the ends found so far and with each other, so what is joined shrinks.
    After as many rounds as the longest conversation has binary digits, chains that
    still go on are in a cycle or lead into one.
    """
    keys = ["conversation_id", "chunk_id"]
    known = msgs.select("conversation_id", F.col("chunk_id").alias("parent"), F.lit(True).alias("there"))
    first = msgs.select(*keys, "parent").join(known, ["conversation_id", "parent"], "left").select(*keys, F.when(F.col("there"), F.col("parent")).alias("to"), (F.col("parent").isNotNull() & F.col("there").isNull()).alias("orphan"))
    first = materialize(first, "threads")
    ends = first.filter("to is null").select(*keys, F.col("chunk_id").alias("root"), F.lit(0).cast("bigint").alias("depth"), "orphan")
    going, jumps = first.filter("to is not null").select(*keys, "to"), []
    longest = going.groupBy("conversation_id").count().agg(F.max("count")).first()[0] or 0
    for k in range(int(longest).bit_length() + 1):
        if going.isEmpty():
            break
        jumps.append(going)
        at = ends.select("conversation_id", F.col("chunk_id").alias("to"), "root", "depth", "orphan")
        step = materialize(going.join(at, ["conversation_id", "to"], "left").join(going.select("conversation_id", F.col("chunk_id").alias("to"), F.col("to").alias("next")), ["conversation_id", "to"], "left"), "threads")
        over = step.filter("root is not null").select(*keys, "root", (F.col("depth") + 2**k).alias("depth"), "orphan")
        ends = ends.unionByName(over)
        going = step.filter("root is null").select(*keys, F.col("next").alias("to"))
    circle = going.select(*keys, F.lit(None).cast("string").alias("root"), F.lit(None).cast("bigint").alias("depth"), F.lit(False).alias("orphan"), F.lit(True).alias("cycle"))
    return ends.withColumn("cycle", F.lit(False)).unionByName(circle), jumps


def resolve_threads(msgs: DataFrame) -> DataFrame:
    """(conversation_id, chunk_id, root, depth, orphan, cycle) from parent pointers by pointer jumping.

    A message is an orphan if the chain from it ends at a message whose parent its
    conversation lacks, and in a cycle if the chain never ends; root and depth are null
    then. Joins are on (conversation_id, chunk_id), which is unique, so no conversation
    makes a hot key. A null parent makes a root, of depth 0.
    """
    return jump_tables(msgs)[0]


def thread_paths(msgs: DataFrame, threads: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(conversation_id, leaf, step, chunk_id): for every message that none answers the path to it from its root, step 0 at the root.

    Paths grow by doubling: what is 2^k steps above the messages of a path is added in
    round k. Messages in cycles are on no path. A path has a row per message on it, so
    messages above a fork come out once for every leaf.
    """
    answered = msgs.filter("parent is not null").select("conversation_id", F.col("parent").alias("chunk_id")).distinct()
    path = threads.filter("not cycle").join(answered, ["conversation_id", "chunk_id"], "left_anti").select("conversation_id", F.col("chunk_id").alias("leaf"), "chunk_id")
    for jump in jumps:
        up = path.join(jump, ["conversation_id", "chunk_id"]).select("conversation_id", "leaf", F.col("to").alias("chunk_id"))
        path = materialize(path.unionByName(up), "paths")
    return path.join(threads.select("conversation_id", "chunk_id", F.col("depth").alias("step")), ["conversation_id", "chunk_id"]).select("conversation_id", "leaf", "step", "chunk_id")


def sound(msgs: DataFrame, threads: DataFrame) -> DataFrame:
    """(conversation_id) of the conversations that are kept, see rebuild. Flags are partial aggregates, so a conversation may have any size."""
    rank = F.array_position(F.array(*[F.lit(r) for r in ROLE_ORDER]), F.col("role"))
    no_user = F.lit("\0")
    last = lambda role: F.max(F.when(~F.col("blank") & (F.col("role") == role), F.struct("at", rank.alias("r"), "chunk_id")))
    broken = msgs.groupBy("conversation_id").agg(
        F.bool_or(F.col("at").isNull() | F.col("role").isNull()).alias("bad"),
        F.min(F.coalesce("user_id", no_user)).alias("u0"),
        F.max(F.coalesce("user_id", no_user)).alias("u1"),
        last("user").alias("asked"),
        last("assistant").alias("answered"),
    )
    good = broken.filter(~F.col("bad") & (F.col("u0") == F.col("u1")) & (F.col("answered") > F.col("asked"))).select("conversation_id")
    return good.join(threads.filter("orphan").select("conversation_id").distinct(), "conversation_id", "left_anti")


def rebuild(chunks: DataFrame, aliases: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(conversation_id, turn_no, chunk_id, role, root, depth) of the sound conversations.

    Dropped: conversations with a null timestamp, an unknown speaker, more than one
    user_id (a null one counts as another) or a thread that ends at a reply to a message
    that isn't in them. Then blank messages go; a conversation stays if an assistant
    message follows its last user message. Turns are ordered by time, role (system,
    user, tool, assistant) and chunk_id. A cycle of replies alone drops nothing: it has
    no effect on that order; root and depth are null there. Empty tables give an empty
    result; other columns are dropped.
    """
    msgs = materialize(messages(chunks, aliases), "messages")
    threads = materialize(resolve_threads(msgs), "threads")
    rank = F.array_position(F.array(*[F.lit(r) for r in ROLE_ORDER]), F.col("role"))
    kept = msgs.filter(~F.col("blank")).join(sound(msgs, threads), "conversation_id", "left_semi").select("conversation_id", "chunk_id", "role", "at", rank.alias("_role_no"))
    kept = kept.join(threads.select("conversation_id", "chunk_id", "root", "depth"), ["conversation_id", "chunk_id"])
    turns = ranked(materialize(kept, "kept"), ["conversation_id"], ["at", "_role_no", "chunk_id"], "turn_no", hot_rows)
    return turns.select("conversation_id", F.col("turn_no").cast("int").alias("turn_no"), "chunk_id", "role", "root", "depth")


def rebuild_paths(chunks: DataFrame, aliases: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(conversation_id, leaf, turn_no, chunk_id, role): the sound conversations as paths from root to leaf, each an ordered conversation by itself.

    Blank messages are left out of the paths and turns counted without them.
    """
    msgs = materialize(messages(chunks, aliases), "messages")
    threads, jumps = jump_tables(msgs)
    threads = materialize(threads, "threads")
    kept = msgs.join(sound(msgs, threads), "conversation_id", "left_semi")
    paths = thread_paths(kept, threads.join(kept.select("conversation_id").distinct(), "conversation_id", "left_semi"), jumps)
    shown = paths.join(kept.filter(~F.col("blank")).select("conversation_id", "chunk_id", "role"), ["conversation_id", "chunk_id"])
    turns = ranked(materialize(shown, "paths"), ["conversation_id", "leaf"], ["step"], "turn_no", hot_rows)
    return turns.select("conversation_id", "leaf", F.col("turn_no").cast("int").alias("turn_no"), "chunk_id", "role")
