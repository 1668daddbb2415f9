"""Chat formatting of reply trees.

Messages point to the message they answer.  Iterative self-joins double the
reach of these pointers, so a thread of 400 replies takes nine rounds: first
every message learns its root, depth and score so far; then branches (paths that
end in a message nobody answers) are ranked by the mean score along the path, and
the chosen ones are unrolled by the same pointers, widest first.  Each chosen path
becomes one conversation of marked turns with a loss mask over the assistant's
texts; control strings inside texts are escaped, so that the output reads back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, materialise

BEGIN = "<s>"
#: What opens and closes the turns of a role; all other roles are named in their opening mark.
TURNS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n")}
OTHER = ("<|", "|>\n", "\n<|end|>\n")
# What follows the first character of a control string.
_REST = r"(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|)"


def escape(text: Column) -> Column:
    r"""Put one more ``\`` behind the first character of every control string, escaped or not."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("|"), F.lit("\\p"))


def _unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\p"), F.lit("|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(plain, "\\")


def _marks(role: Column) -> tuple[Column, Column]:
    opening, closing = F.concat(F.lit(OTHER[0]), _escape_role(role), F.lit(OTHER[1])), F.lit(OTHER[2])
    for name, (first, last) in TURNS.items():
        opening, closing = F.when(role == name, F.lit(first)).otherwise(opening), F.when(role == name, F.lit(last)).otherwise(closing)
    return opening, closing


def reach(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Root, depth (from 1) and summed score of every message, and the pointers of each round.

    Pointers of round k lead 2^k messages up.  Messages that have arrived leave
    the loop; a parent that is missing makes a root.  Messages below a cycle of
    parents never arrive and are in no tree.  A message that very many answer is
    joined by broadcast.
    """
    spark = messages.sparkSession
    slim = messages.select("msg_id", "parent_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = slim.select(F.col("msg_id").alias("parent_id"), F.lit(True).alias("known"))
    answers = slim.where("parent_id is not null").groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"))
    total = slim.count()
    linked = materialise(join_hot(slim, known.join(answers, "parent_id"), ["parent_id"], total), "chat-linked").select(
        "msg_id", F.col("parent_id").alias("up"), "score"
    )
    roots = slim.join(linked.select("msg_id"), "msg_id", "left_anti")
    done = roots.select("msg_id", F.col("msg_id").alias("root"), F.lit(1).cast("long").alias("depth"), "score")
    going = linked.select("msg_id", "up", F.lit(1).cast("long").alias("steps"), "score")
    jumps, arrived, steps = [], [done], 1
    while steps <= total and not going.isEmpty():
        jumps.append(going.select("msg_id", "up"))
        # score covers the messages from msg_id to the one before ``up``
        met = going.groupBy("up").agg(F.count(F.lit(1)).alias("n"))
        ends = done.select(F.col("msg_id").alias("up"), "root", F.col("depth").alias("d"), F.col("score").alias("s"), F.lit(None).cast("string").alias("next"))
        mids = going.select(F.col("msg_id").alias("up"), F.lit(None).cast("string").alias("root"), F.col("steps").alias("d"), F.col("score").alias("s"), F.col("up").alias("next"))
        joined = materialise(join_hot(going, ends.unionByName(mids).join(met, "up"), ["up"], total), "chat-reach")
        done = done.unionByName(
            joined.where("root is not null").select("msg_id", "root", (F.col("steps") + F.col("d")).alias("depth"), (F.col("score") + F.col("s")).alias("score"))
        )
        going = joined.where("root is null").select("msg_id", F.col("next").alias("up"), (F.col("steps") + F.col("d")).alias("steps"), (F.col("score") + F.col("s")).alias("score"))
        steps *= 2
    return done, jumps


def branches(messages: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` best branches of each tree: path_id (its last message), root, rank, depth, msg_id; one row per message.

    Branches are ranked by their mean score, ties to the smaller path_id.  Only
    ``top`` rows of a tree leave each task before they are ranked together.
    """
    found, jumps = reach(messages)
    found = materialise(found, "chat-found")
    leaves = found.join(messages.select(F.col("parent_id").alias("msg_id")).where("msg_id is not null").distinct(), "msg_id", "left_anti")
    order = Window.partitionBy("root").orderBy((F.col("score") / F.col("depth")).desc(), "msg_id")
    best = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    paths = materialise(best.select(F.col("msg_id").alias("path_id"), "root", "rank", "depth", "msg_id"), "chat-paths")
    for k in reversed(range(len(jumps))):
        higher = paths.join(jumps[k], "msg_id").select("path_id", "root", "rank", (F.col("depth") - (1 << k)).alias("depth"), F.col("up").alias("msg_id"))
        paths = materialise(paths.unionByName(higher), "chat-paths")
    return paths


def format_trees(messages: DataFrame, top: int = 1, loss_role: str = "assistant") -> DataFrame:
    """One row per chosen path: path_id, root, rank, n_turns, formatted, loss (array of start and size in code points).

    ``messages`` has msg_id and parent_id (strings), role, text and score; other
    columns are not read.  A null role or text counts as empty, a null score as 0.
    Messages without an id take no part; of repeated ids the smallest row by
    parent, role, text and score stands.  A parent that is missing makes a root;
    cycles of parents and what hangs below them are in no tree.  An empty table
    gives no rows.  A conversation is one value, so very long texts are bounded
    by what a row can hold (2 GB), and by nothing else.
    """
    empty = F.lit("")
    messages = materialise(
        messages.where("msg_id is not null").groupBy("msg_id").agg(F.min(F.struct("parent_id", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"), "score")).alias("m")).select("msg_id", "m.*"),
        "chat-messages",
    )
    path = Window.partitionBy("path_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opening, closing = _marks(F.col("role"))
    turns = (
        branches(messages, top).join(messages.select("msg_id", "role", "text"), "msg_id")
        .select("path_id", "root", "rank", "depth", "role", opening.alias("o"), escape(F.col("text")).alias("t"), closing.alias("c"))
        .withColumn("size", F.char_length("t"))
        .withColumn("end", len(BEGIN) + F.sum(F.char_length("o") + F.col("size") + F.char_length("c")).over(path) - F.char_length("c"))
    )
    masked = F.col("role") == loss_role
    return turns.groupBy("path_id", "root", "rank").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("depth", F.concat("o", "t", "c").alias("piece")))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(masked, F.struct((F.col("end") - F.col("size")).cast("int").alias("start"), F.col("size").cast("int").alias("size"))))).alias("loss"),
    ).select("path_id", "root", "rank", "n_turns", F.concat(F.lit(BEGIN), F.array_join(F.transform("pieces", lambda p: p["piece"]), "")).alias("formatted"), "loss")


def read_back(formatted: Column) -> Column:
    """The turns, as an array of role and text, that a formatted conversation was made of."""
    kinds = [*TURNS.items()]
    of = {name: rf"\Q{first}\E(?:.*?)\Q{last}\E" for name, (first, last) in kinds}
    other = rf"\Q{OTHER[0]}\E[^|]*\Q{OTHER[1]}\E(?:.*?)\Q{OTHER[2]}\E"
    every = F.regexp_extract_all(F.substring(formatted, len(BEGIN) + 1, 2**31 - 1), F.lit("(?s)" + "|".join([other, *of.values()])), 0)

    def turn(piece: Column) -> Column:
        inside = lambda first, last: F.substring(piece, len(first) + 1, F.char_length(piece) - len(first) - len(last))
        role = F.regexp_extract(piece, rf"^\Q{OTHER[0]}\E([^|]*)", 1)
        body = F.regexp_extract(piece, rf"(?s)^\Q{OTHER[0]}\E[^|]*\Q{OTHER[1]}\E(.*)\Q{OTHER[2]}\E$", 1)
        found = F.struct(_unescape_role(role).alias("role"), unescape(body).alias("text"))
        for name, (first, last) in kinds:
            found = F.when(F.startswith(piece, F.lit(first)), F.struct(F.lit(name).alias("role"), unescape(inside(first, last)).alias("text"))).otherwise(found)
        return found

    return F.transform(every, turn)


def loss_texts(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, one after another."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["size"]))), "")


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> messages, each the answer to the one before it.

    Turns in order of turn (null first), then role and text, so repeated turns and
    rows follow one another; a null conv_id is a conversation of its own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    name = lambda at: F.concat_ws(":", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null")), at.cast("string"))
    at = F.col("at")
    return conversations.select("conv_id", "role", "text", F.row_number().over(order).alias("at")).select(
        "conv_id", name(at).alias("msg_id"), F.when(at > 1, name(at - 1)).alias("parent_id"), "role", "text", F.lit(0.0).alias("score")
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and the columns of :func:`format_trees`."""
    messages = materialise(conversation_messages(conversations), "chat-turns")
    heads = messages.where("parent_id is null").select("conv_id", F.col("msg_id").alias("root"))
    return format_trees(messages).join(heads, "root").select("conv_id", "n_turns", "formatted", "loss")


def digests(conversations: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: turns and loss as digests and sizes."""
    turns = F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = loss_texts(F.col("formatted"), F.col("loss"))
    return conversations.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
