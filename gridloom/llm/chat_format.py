"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: its context is everything formatted
before it in the conversation and only its own text is trainable. Because the
context of every example is a prefix of one shared transcript, an example is
stored as offsets into that transcript; text is never copied once per turn,
so a conversation of n turns costs O(n), not O(n^2). Transcripts are kept in
blocks of ``block_turns`` turns: one hot conversation spreads over many rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Turn markers; every control string must begin with ``<`` or ``[``, the characters escaped inside texts."""

    turn_open: str = "<|turn|>"
    turn_close: str = "<|end|>\n"
    trainable_role: str = "assistant"

    def __post_init__(self) -> None:
        for marker in (self.turn_open, self.turn_close):
            if marker[:1] not in ("<", "[") or "\\E" in marker:
                raise ValueError(f"a marker begins with < or [, which texts can't hold, and has no \\E: {marker!r}")
        if self.turn_open.startswith(self.turn_close) or self.turn_close.startswith(self.turn_open):
            raise ValueError("no marker may begin with the other one")


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def escape(e: str) -> str:
    """SQL for the reversible escape: afterwards no control string can occur in the text."""
    return f"replace(replace(replace({e}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"


def unescape(e: str) -> str:
    return f"replace(replace(replace({e}, '&#91;', '['), '&lt;', '<'), '&amp;', '&')"


def format_blocks(turns: DataFrame, template: ChatTemplate = ChatTemplate(), block_turns: int = 64) -> DataFrame:
    """conv_id, block, n_turns, formatted, formatted_chars, targets (one entry for each trainable turn).

    Input columns conv_id, turn, role, text; others are ignored. Null role or
    text counts as empty; turns with equal number are ordered by role and text;
    null turn numbers come first; all rows with a null conv_id are one conversation.
    """
    t = turns.selectExpr(
        "conv_id",
        f"coalesce(cast(floor(turn / {block_turns}D) as bigint), {-(1 << 62)}) AS block",
        "struct(turn, coalesce(role, '') AS role, coalesce(text, '') AS text) AS t",
    )
    b = t.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    role = "replace(" + escape("x.role") + ", '\\n', '&#10;')"
    b = b.selectExpr(
        "conv_id",
        "block",
        "ts",
        f"transform(ts, x -> concat({_lit(template.turn_open)}, {role}, '\\n', {escape('x.text')}, {_lit(template.turn_close)})) AS pieces",
        f"transform(ts, x -> struct(x.turn AS turn, x.role = {_lit(template.trainable_role)} AS on, {len(template.turn_open) + 1} + length({role}) AS head, length({escape('x.text')}) AS body)) AS shape",
    )
    step = f"s.head + s.body + {len(template.turn_close)}"
    walk = (
        "aggregate(shape, named_struct('at', 0L, 'out', cast(array() as array<struct<turn:bigint,context_end:bigint,loss_start:bigint,loss_end:bigint>>)), "
        f"(a, s) -> named_struct('at', a.at + {step}, 'out', if(s.on, concat(a.out, array(named_struct("
        "'turn', cast(s.turn as bigint), 'context_end', a.at, 'loss_start', a.at + s.head, 'loss_end', a.at + s.head + s.body))), a.out)))"
    )
    b = b.selectExpr("conv_id", "block", "cast(size(ts) as bigint) AS n_turns", "array_join(pieces, '') AS formatted", f"{walk} AS w")
    return b.selectExpr("conv_id", "block", "n_turns", "formatted", "w.at AS formatted_chars", "w.out AS targets")


def expand_examples(blocks: DataFrame) -> DataFrame:
    """One row for each trainable turn: conv_id, turn, block, place (within its block), context_chars, loss_start, loss_end, target.

    The numbers are code-point offsets into the conversation's transcript (its
    blocks in order): the context is transcript[0:context_chars], and only
    transcript[loss_start:loss_end] is trainable; target is that reply,
    unescaped. Texts of earlier turns are not copied.
    """
    at = blocks.select("conv_id", "block", "formatted", F.posexplode("targets").alias("place", "e"))
    target = unescape("substring(formatted, cast(e.loss_start + 1 as int), cast(e.loss_end - e.loss_start as int))")
    at = at.selectExpr("conv_id", "block", "place", "e", f"{target} AS target")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("conv_id", "block", F.coalesce(F.sum("formatted_chars").over(before), F.lit(0)).alias("base"))  # one short row a block
    base = base.withColumnsRenamed({"conv_id": "_conv", "block": "_block"})
    at = at.join(base, F.expr("conv_id <=> _conv AND block = _block"))
    return at.selectExpr("conv_id", "e.turn AS turn", "block", "place", "base + e.context_end AS context_chars", "base + e.loss_start AS loss_start", "base + e.loss_end AS loss_end", "target")


def render_examples(blocks: DataFrame) -> DataFrame:
    """conv_id, turn, context, target: the examples as texts. Quadratic in a conversation's length by nature; for exports of a selection."""
    whole = blocks.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "formatted"))), lambda x: x["formatted"]), "").alias("whole"))
    e = expand_examples(blocks).join(whole.withColumnRenamed("conv_id", "_conv"), F.expr("conv_id <=> _conv"))
    return e.selectExpr("conv_id", "turn", "substring(whole, 1, cast(context_chars as int)) AS context", "target")


def read_back(blocks: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """conv_id, block, formatted_chars and turns (array of role, text), parsed from the formatted text alone."""
    close = _lit("\\Q" + template.turn_close + "\\E")
    return blocks.selectExpr(
        "conv_id",
        "block",
        "formatted_chars",
        f"transform(filter(split(formatted, {close}), p -> p != ''), p -> named_struct("
        f"'role', {unescape(f'replace(substring_index(substring(p, {len(template.turn_open) + 1}), {_lit(chr(10))}, 1), {_lit("&#10;")}, {_lit(chr(10))})')}, "
        f"'text', {unescape(f'substring(p, {len(template.turn_open) + 2} + length(substring_index(substring(p, {len(template.turn_open) + 1}), {_lit(chr(10))}, 1)))')})) AS turns",
    )


def conversation_digests(blocks: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Digests of the turns that read_back() finds and of the examples that expand_examples() makes, by conversation.

    SHA-256 has no combiner, so a conversation's text meets in one row here,
    its turns already joined block by block.
    """
    turns = read_back(blocks, template).selectExpr(
        "conv_id",
        "struct(block, array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '') AS said) AS b",
        "cast(size(turns) as bigint) AS n",
        "formatted_chars",
        "cast(null as struct<block:bigint,place:int,target:string>) AS e",
        "cast(null as bigint) AS context_chars",
    )
    examples = expand_examples(blocks).selectExpr("conv_id", "cast(null as struct<block:bigint,said:string>) AS b", "0L AS n", "0L AS formatted_chars", "struct(block, place, target) AS e", "context_chars")
    g = turns.unionByName(examples).groupBy("conv_id")
    g = g.agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("b")).alias("bs"), F.sort_array(F.collect_list("e")).alias("es"), F.sum("formatted_chars").alias("formatted_chars"), F.coalesce(F.sum("context_chars"), F.lit(0)).alias("context_chars"))
    return g.selectExpr(
        "conv_id",
        "n_turns",
        "sha2(array_join(transform(bs, x -> x.said), ''), 256) AS turns_sha256",
        "cast(aggregate(es, 0L, (a, x) -> a + length(x.target)) as bigint) AS loss_chars",
        "sha2(array_join(transform(es, x -> x.target), ''), 256) AS loss_sha256",
        "formatted_chars",
        "cast(size(es) as bigint) AS n_examples",
        "context_chars",
    )
