"""Reply trees as conversations.

Messages point at the message they reply to.  Self-joins double the reach of
each message's pointer until no pointer is left; joined to the leaves, the
pointers list every message above a leaf in as many rounds, so the work is the
total length of the paths.  Branches are ranked by their score, and each
chosen path is written as one text with marks around its turns and a mask of
the characters to learn from.  Only keys travel until the paths are chosen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.tables import stored

@dataclass(frozen=True)
class Template:
    """The marks around a turn, and which strings a text may not hold as they are.

    A turn is ``opened + role + newline + text + closed``.  Control strings
    are one opening character and one of ``rests``; inside texts and roles an
    ``escape`` is put between the two, before those that stand there already,
    so that taking one away restores the text.  No rest may hold an opening
    character or the escape, and the rests must cover both marks.
    """

    opened: str = "<|im_start|>"
    closed: str = "<|im_end|>\n"
    first: str = r"[<\[]"
    rests: tuple[str, ...] = (r"\|im_start\|>", r"\|im_end\|>", r"/?s>", r"/?INST\]", r"\|endoftext\|>")
    escape: str = "\\"

    @property
    def pattern(self) -> str:
        return "|".join(self.rests)

    def escaped(self, text: Column) -> Column:
        mark = self.escape.replace("\\", "\\\\")
        return F.regexp_replace(text, f"({self.first})({mark}*)({self.pattern})", f"$1{mark}$2$3")

    def unescaped(self, text: Column) -> Column:
        mark = self.escape.replace("\\", "\\\\")
        return F.regexp_replace(text, f"({self.first}){mark}({mark}*)({self.pattern})", "$1$2$3")

    def role(self, role: Column) -> Column:
        """A role as it stands in a header, which ends at the first newline."""
        return self.escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))

    def role_of(self, header: Column) -> Column:
        return F.replace(F.replace(self.unescaped(header), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


CHAT = Template()


# A null tree is a tree like any other: inside a struct, null equals null.
def _node(tree: str, node: str) -> Column:
    return F.struct(F.col(tree).alias("tree_id"), F.col(node).alias("node_id"))


def _parted(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose ``key`` occurs once, and the others, if any; only keys are shuffled for rows that occur once."""
    again = stored(rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key), "repeated")
    if again.isEmpty():
        return rows, None
    return rows.join(again, key, "left_anti"), rows.join(again, key, "left_semi")


def linear(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations ``conv_id, turn, role, text`` as messages and links, each turn a reply to the one before.

    Turns are ordered by ``turn`` (null first); rows of one turn by role and
    text, so that repeated rows are turns of their own.  A null ``conv_id`` is
    a conversation like any other.
    """
    rows = turns.select(F.col("conv_id").alias("tree_id"), "turn", "role", "text", F.struct("conv_id", "turn").alias("at"))
    single, tied = _parted(rows, "at")
    single = single.withColumn("tie", F.lit(1))
    if tied is not None:
        within = Window.partitionBy("at").orderBy("role", "text")
        single = single.unionByName(tied.withColumn("tie", F.row_number().over(within)))
    messages = single.select("tree_id", F.struct("turn", "tie").alias("node_id"), "role", "text")
    before = Window.partitionBy("tree_id").orderBy("node_id")
    links = messages.select("tree_id", "node_id", F.lag("node_id").over(before).alias("parent_id"), F.lit(0.0).alias("score"))
    return messages, links


def leaf_paths(links: DataFrame) -> DataFrame:
    """``leaf, node, above, score``: each message on the path to each leaf, which lies ``above`` replies below it.

    ``links`` has ``tree_id, node_id, parent_id, score``; of several rows for a
    node the smallest (parent, score) counts.  ``leaf`` and ``node`` are
    structs of ``tree_id`` and ``node_id``.  A parent that is missing or null
    makes a root.  A path that runs into a circle has no root and is left out.
    A null score counts as zero.
    """
    rows = links.select(_node("tree_id", "node_id").alias("node"), F.when(F.col("parent_id").isNotNull(), _node("tree_id", "parent_id")).alias("to"),
                        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = stored(rows.groupBy("node").agg(F.min(F.struct("to", "score")).alias("m")).select("node", "m.to", "m.score"), "nodes")
    pointing = nodes.filter("to is not null").select("node", "to", F.col("node.tree_id").alias("tree")).join(
        nodes.select(F.col("node").alias("to")), "to", "left_semi")
    sizes = nodes.groupBy(F.struct("node.tree_id").alias("of")).agg(F.count("*").alias("size"))
    jumps = stored(pointing.withColumn("of", F.struct(F.col("tree").alias("tree_id"))).join(sizes, "of").select("node", "to", "size"), "jumps")
    is_parent = jumps.select(F.col("to").alias("node")).distinct()
    leaves = nodes.join(is_parent, "node", "left_anti").select("node")
    steps, reach = [], 1
    while not jumps.isEmpty():
        steps.append(jumps)
        far = jumps.select(F.col("node").alias("to"), F.col("to").alias("next"))
        reach *= 2
        doubled = stored(jumps.join(far, "to").select("node", F.col("next").alias("to"), "size"), "jumps")
        # no path has as many steps as its tree has nodes: what gets that far goes round in a circle
        jumps, circular = doubled.filter(F.col("size") > reach), doubled.filter(F.col("size") <= reach).select("node")
        leaves = leaves.join(circular, "node", "left_anti")
    paths = stored(leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).alias("above")), "paths")
    for k, jump in enumerate(steps):
        more = paths.join(jump, "node").select("leaf", F.col("to").alias("node"), (F.col("above") + 2**k).alias("above"))
        paths = paths.union(stored(more, "paths"))
    return paths.join(nodes.select("node", "score"), "node").select("leaf", "node", "above", "score")


def ranked_branches(paths: DataFrame, branches: int | None = 1) -> DataFrame:
    """``leaf, rank, branch_score, n_turns``: the ``branches`` best paths of each tree (``None``: all, with a null rank).

    A path's score is the mean of its messages' scores; ties go to the smaller
    leaf.  Best paths are chosen inside each task first.
    """
    scored = paths.groupBy("leaf").agg(F.avg(F.col("score").cast("decimal(28,10)")).alias("branch_score"), F.count("*").alias("n_turns"))
    if branches is None:
        return scored.select("leaf", F.lit(None).cast("int").alias("rank"), "branch_score", "n_turns")
    best = Window.partitionBy("leaf.tree_id").orderBy(F.desc("branch_score"), "leaf.node_id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches)
    return ranked.select("leaf", "rank", "branch_score", "n_turns")


def conversations(messages: DataFrame, links: DataFrame, branches: int | None = 1, template: Template = CHAT, learned: str = "assistant") -> DataFrame:
    """``tree_id, leaf_id, rank, branch_score, n_turns, formatted, loss``: one row for each chosen path.

    ``messages`` has ``tree_id, node_id, role, text`` and ``links`` has what
    :func:`leaf_paths` reads; they may be one table.  Extra columns are
    ignored, null roles and texts are empty, a linked node without a message
    is an empty turn.  Of several messages for one node the smallest (role,
    text) counts.  ``loss`` lists start (from 1) and length, in code points,
    of the texts of role ``learned`` in ``formatted``, as they are escaped.
    No links give no rows.
    """
    paths = stored(leaf_paths(links), "all_paths")
    chosen = stored(ranked_branches(paths, branches), "chosen")
    on_chosen = paths.select("leaf", "node", "above").join(chosen, "leaf")
    said, repeated = _parted(messages.select(_node("tree_id", "node_id").alias("node"), F.coalesce("role", F.lit("")).alias("role"),
                                             F.coalesce("text", F.lit("")).alias("text")), "node")
    if repeated is not None:
        least = repeated.groupBy("node").agg(F.min(F.struct("role", "text")).alias("m")).select("node", "m.role", "m.text")
        said = said.unionByName(least)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = on_chosen.join(said, "node", "left").select(
        "leaf", "rank", "branch_score", "n_turns", "above", role.eqNullSafe(F.lit(learned)).alias("learned"),
        F.concat(F.lit(template.opened), template.role(role), F.lit("\n")).alias("header"), template.escaped(text).alias("body"))
    upto = Window.partitionBy("leaf").orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tail = F.length("body") + len(template.closed)
    begin = (F.sum(F.length("header") + tail).over(upto) - tail + 1).cast("int")
    placed = turns.select("leaf", "rank", "branch_score", "n_turns", F.struct(
        (-F.col("above")).alias("at"), F.concat("header", "body", F.lit(template.closed)).alias("piece"), "learned",
        F.struct(begin.alias("start"), F.length("body").alias("length")).alias("span")).alias("turn"))
    whole = placed.groupBy("leaf", "rank", "branch_score", "n_turns").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t.learned), lambda t: t.span)
    return whole.select(F.col("leaf.tree_id").alias("tree_id"), F.col("leaf.node_id").alias("leaf_id"), "rank", "branch_score", "n_turns",
                        F.array_join(F.col("turns.piece"), "").alias("formatted"), loss.alias("loss"))


def turns_of(formatted: Column, template: Template = CHAT) -> Column:
    """``role, text`` of each turn, read from a formatted conversation alone."""
    mark = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in template.opened)
    parts = F.split(formatted, mark)

    def turn(part: Column) -> Column:
        header = F.substring_index(part, "\n", 1)
        body = F.substring(part, F.length(header) + 2, F.length(part) - F.length(header) - 1 - len(template.closed))
        return F.struct(template.role_of(header).alias("role"), template.unescaped(body).alias("text"))

    return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), turn)


def learned_text(formatted: Column, loss: Column, template: Template = CHAT) -> Column:
    """What stands under the mask, unescaped, one after the other."""
    return F.array_join(F.transform(loss, lambda s: template.unescaped(F.substring(formatted, s.start, s.length))), "")


def digest(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """What a reader finds in the output: turns, their hash, the learned characters and theirs."""
    turns, text = F.col("turns"), F.col("learned")
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    read = formatted.select(F.col("tree_id").alias("conv_id"), "formatted", turns_of(F.col("formatted"), template).alias("turns"),
                            learned_text(F.col("formatted"), F.col("loss"), template).alias("learned"))
    return read.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length(text).cast("long").alias("loss_chars"), F.sha2(text.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
