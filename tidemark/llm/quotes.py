"""Chat formatting by quotation linking.

Lines that begin with ``>`` marks are quoted, as many levels deep as there are marks;
consecutive lines of one level are a passage. Passages, and the paragraphs and lines
within, are normalised (compatibility forms, case, white space) and hashed, and joined
to the latest earlier message of the conversation that has the same unit in its own
words. The message that most characters of the first level come from is the one that
is answered. Conversations are given in reply order: each thread after its first
message, answers below what they answer, in the order of their turns. Quotes link inside
a conversation; with ``elsewhere`` the passages that only another conversation has are
counted too.

Cases: null text counts as empty; a quote whose original is unknown links to nothing
and still goes; messages without a linked quote begin a thread; equal units link to the
latest earlier turn; rows that repeat a turn are each given, side by side, and answered
as one; a null conversation or turn is linked with nothing (nulls come first in the
order of turns); very long texts are parsed line by line; further columns are ignored;
an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.asof import asof
from ..operators.ranking import running
from . import common as C

MARKS = re.compile(r"^[ \t]?((?:>[ \t]?)+)(.*)$", re.DOTALL)
WROTE = re.compile(r"^\S.{0,200}\b(?:wrote|schrieb|escribió|a écrit) ?:$")
#: First messages of a range: a task counts the threads of one range.
ROOTS = 1024


def normalised(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def unit_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def units(lines: list[str]) -> dict[int, int]:
    """Hash and length of a passage, its paragraphs and its lines."""
    paragraphs, own = [], []
    for line in [*lines, ""]:
        if line.strip():
            own.append(line)
        elif own:
            paragraphs.append("\n".join(own))
            own = []
    out = {}
    for part in ("\n".join(lines), *paragraphs, *lines):
        if text := normalised(part):
            out[unit_hash(text)] = len(text)
    return out


def parse(text: str | None) -> tuple[str, list[tuple[int, list[str]]]]:
    """The text without quotes, and the quoted passages with their levels."""
    body: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    level = 0
    for line in (text or "").split("\n"):
        if m := MARKS.match(line):
            depth = m[1].count(">")
            if depth != level:
                passages.append((depth, []))
                if not level and body and WROTE.match(body[-1].strip()):
                    body.pop()
            passages[-1][1].append(m[2])
            level = depth
        else:
            body.append(line)
            level = 0
    if passages:
        return re.sub(r"\n{3,}", "\n\n", "\n".join(body)).strip("\n"), passages
    return text or "", passages


PARSED = "conv_id long, turn long, role string, text string, n_quotes int, own array<long>, quoted array<struct<passage:int,level:int,hash:long,size:int>>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("hash", pa.int64()), ("size", pa.int32())]))
    for batch in batches:
        texts, n, own, quoted = [], [], [], []
        for text in batch.column("text").to_pylist():
            body, passages = parse(text)
            texts.append(body)
            n.append(len(passages))
            own.append(list(units(body.split("\n"))))
            quoted.append([{"passage": i, "level": d, "hash": h, "size": s} for i, (d, lines) in enumerate(passages) for h, s in units(lines).items()])
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(texts, pa.string()), pa.array(n, pa.int32()), pa.array(own, pa.list_(pa.int64())), pa.array(quoted, kind)],
            ["conv_id", "turn", "role", "text", "n_quotes", "own", "quoted"],
        )


#: Turns of a block of the as-of join: a unit that a long conversation repeats is not one task.
TURNS = 4096


def quoted_units(parsed: DataFrame) -> DataFrame:
    return parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", F.col("q.hash").alias("hash"), "q.passage", "q.level", "q.size")


def link(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quoted units with the turn they come from (null: unknown), and (conv_id, turn, parent_turn, n_linked)."""
    quoted = quoted_units(parsed)
    # only units that somebody quotes
    wanted = quoted.select("conv_id", "hash").distinct()
    own = parsed.select("conv_id", "turn", F.explode("own").alias("hash")).distinct().join(wanted, ["conv_id", "hash"], "left_semi")
    own = own.select("conv_id", "hash", F.col("turn").alias("from"))
    found = asof(quoted.withColumn("_before", F.col("turn") - 1), own, "_before", "from", ["from"], ["conv_id", "hash"], block=TURNS).drop("_before")
    found = C.materialise(found)
    known = found.where("`from` is not null")
    linked = known.groupBy("conv_id", "turn").agg(F.countDistinct("passage").cast("int").alias("n_linked"))
    score = known.where("level = 1").groupBy("conv_id", "turn", "from").agg(F.sum("size").alias("size"))
    parent = score.groupBy("conv_id", "turn").agg(F.max_by("from", F.struct("size", "from")).alias("parent_turn"))
    return found, linked.join(parent, ["conv_id", "turn"], "left")


def from_elsewhere(parsed: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, turn, n_elsewhere): passages without an original in their conversation that another one has."""
    whole = found.groupBy("conv_id", "turn", "passage").agg(F.max(F.col("from").isNotNull()).alias("_known"))
    open_ = found.join(whole.where("not _known"), ["conv_id", "turn", "passage"], "left_semi").select("conv_id", "turn", "passage", "hash")
    own = parsed.where("conv_id is not null").select("conv_id", F.explode("own").alias("hash"))
    # a row for each unit: two of its conversations tell whether another one than this has it
    holders = own.groupBy("hash").agg(F.min("conv_id").alias("_low"), F.max("conv_id").alias("_high"))
    hit = open_.join(holders, "hash").where((F.col("_low") != F.col("conv_id")) | (F.col("_high") != F.col("conv_id")))
    return hit.groupBy("conv_id", "turn").agg(F.countDistinct("passage").cast("int").alias("n_elsewhere"))


def doubled(state: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Follows the pointers ``up`` to the end of each chain: sums of the chain, and its last node as ``end``.

    keys: names of the node's columns, within conv_id; up: a struct of them, null at an end.
    Each round doubles the reach and is written, a row a node.
    """
    node = F.struct(*keys)
    state = C.materialise(state.select("conv_id", *keys, "up", F.coalesce("up", node).alias("end"), *sums))
    while not state.where("up is not null").isEmpty():
        above = state.select(F.col("conv_id").alias("_c"), node.alias("_node"), F.col("up").alias("_up"), F.col("end").alias("_end"), *[F.col(s).alias(f"_{s}") for s in sums])
        joined = state.join(above, (F.col("conv_id") == F.col("_c")) & (F.col("up") == F.col("_node")), "left")
        state = C.materialise(joined.select("conv_id", *keys, F.col("_up").alias("up"), F.coalesce("_end", "end").alias("end"), *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums]))
    return state.drop("up")


def threads(nodes: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth, before): of nodes (conv_id, turn, parent_turn, rows), the rows that stand before in the thread.

    Pointers up give root and depth. For the order a thread is walked around: into a message,
    into its first answer, out of it into the next answer of the same message, and out of
    the last one into the message above. What is left of the walk, in rows, is a sum along
    pointers too; so no task needs a whole thread, and no row grows with its depth.
    """
    nodes = C.materialise(nodes)
    up = nodes.select("conv_id", "turn", F.when(F.col("parent_turn").isNotNull(), F.struct(F.col("parent_turn").alias("turn"))).alias("up"), F.when(F.col("parent_turn").isNotNull(), 1).otherwise(0).alias("depth"))
    roots = doubled(up, ["turn"], ["depth"]).select("conv_id", "turn", F.col("end.turn").alias("root_turn"), "depth")
    siblings = Window.partitionBy("conv_id", "parent_turn").orderBy("turn")
    following = nodes.withColumn("next", F.when(F.col("parent_turn").isNotNull(), F.lead("turn").over(siblings)))
    first = nodes.where("parent_turn is not null").groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("first"))
    known = following.join(first, ["conv_id", "turn"], "left")
    step = lambda turn, out: F.struct(turn.alias("turn"), F.lit(out).alias("out"))
    into = known.select("conv_id", "turn", F.lit(False).alias("out"), "rows", F.when(F.col("first").isNotNull(), step(F.col("first"), False)).otherwise(step(F.col("turn"), True)).alias("up"))
    outof = known.select("conv_id", "turn", F.lit(True).alias("out"), F.lit(0).cast("long").alias("rows"), F.when(F.col("next").isNotNull(), step(F.col("next"), False)).when(F.col("parent_turn").isNotNull(), step(F.col("parent_turn"), True)).alias("up"))
    left = doubled(into.unionByName(outof), ["turn", "out"], ["rows"]).where("not out").select("conv_id", "turn", F.col("rows").alias("left"))
    placed = C.materialise(roots.join(left, ["conv_id", "turn"]))
    whole = placed.where("turn = root_turn").select("conv_id", "root_turn", F.col("left").alias("whole"))
    return placed.join(whole, ["conv_id", "root_turn"]).select("conv_id", "turn", "root_turn", "depth", (F.col("whole") - F.col("left")).alias("before"))


def format_conversations(conversations: DataFrame, elsewhere: bool = False) -> DataFrame:
    """conv_id, position, turn, role, text without quotes, parent_turn, root_turn, depth, n_quotes, n_linked (and n_elsewhere)."""
    parsed = C.materialise(conversations.select("conv_id", "turn", "role", "text").mapInArrow(_parse, PARSED))
    found, links = link(parsed)
    links = C.materialise(links)
    # messages without a linked quote begin a thread: only the others, and what they answer, need a walk
    answers = links.where("parent_turn is not null").select("conv_id", "turn", "parent_turn")
    roots = answers.select("conv_id", F.col("parent_turn").alias("turn")).distinct().join(answers, ["conv_id", "turn"], "left_anti")
    copies = parsed.groupBy("conv_id", "turn").agg(F.count("*").alias("rows"))
    walked = threads(answers.unionByName(roots, allowMissingColumns=True).join(copies, ["conv_id", "turn"]))
    rows = parsed.join(links, ["conv_id", "turn"], "left").join(walked, ["conv_id", "turn"], "left")
    rows = rows.select("conv_id", "turn", "role", "text", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("before", F.lit(0)).alias("before"), "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
    rows = C.materialise(rows)
    # rows before a thread: sums over ranges of first messages, one row a range carried on
    sizes = rows.groupBy("conv_id", "root_turn").agg(F.count("*").alias("_n"))
    sizes = C.materialise(running(sizes, {"_upto": F.col("_n")}, "root_turn", ["conv_id"], F.expr(f"root_turn div {ROOTS}")))
    sizes = sizes.select(F.col("conv_id").alias("_c"), F.col("root_turn").alias("_r"), (F.col("_upto") - F.col("_n")).alias("_earlier"))
    # rows that repeat a turn stand side by side
    same = Window.partitionBy("conv_id", "turn").orderBy("role", F.xxhash64("text"))
    placed = rows.withColumn("_at", F.row_number().over(same) - 1).join(sizes, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("root_turn").eqNullSafe(F.col("_r")))
    out = placed.select("conv_id", (F.col("_earlier") + F.col("before") + F.col("_at")).alias("position"), "turn", "role", "text", "parent_turn", "root_turn", "depth", "n_quotes", "n_linked")
    if elsewhere:
        out = out.join(from_elsewhere(parsed, found), ["conv_id", "turn"], "left").withColumn("n_elsewhere", F.coalesce("n_elsewhere", F.lit(0)))
    return out
