"""Chat formatting, with Spark expressions only.

The template: `<|im_start|>ROLE\n TEXT <|im_sep|> TEXT ... <|im_end|>\n` (without the blanks).
Adjacent turns of one role form one block and are parted by `<|im_sep|>`. Within roles and texts
`&` is written `&amp;` and `<|` is written `&lt;|`, and a line end in a role `&nl;`, so no text can
hold a control string, and `read_back` gives the texts exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings of the template.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def format_chats(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conv_id: `formatted`, and `loss_spans`, the places (start from 1, length, in
    code points) of the texts of the role `learn`.

    Turns are sorted by turn, then role and text; nulls come first. Repeated rows are kept. Null
    role or text is empty; rows with a null conv_id are one conversation. Other columns are ignored.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    # One block per run of a role: texts of the same role are added to the last block.
    empty = F.expr("cast(array() as array<struct<role:string,texts:array<string>>>)")

    def add(blocks: Column, t: Column) -> Column:
        last = F.try_element_at(blocks, F.lit(-1))
        fresh = F.struct(t["role"].alias("role"), F.array(escape(t["text"])).alias("texts"))
        grown = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(escape(t["text"]))).alias("texts"))
        same = (F.size(blocks) > 0) & (last["role"] == t["role"])
        return F.when(same, F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(grown))).otherwise(F.concat(blocks, F.array(fresh)))

    blocks = ordered.select("conv_id", F.aggregate("ts", empty, add).alias("blocks"))
    head = lambda b: F.concat(F.lit(START), _escape_role(b["role"]), F.lit("\n"))
    written = F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], SEP), F.lit(END + "\n")))

    # Walk over the blocks with the number of characters so far.
    spans = F.expr("cast(array() as array<struct<start:int,length:int>>)")

    def walk(state: Column, b: Column) -> Column:
        at = state["at"] + F.char_length(head(b))
        inner = F.aggregate(
            b["texts"],
            F.struct(at.alias("at"), state["spans"].alias("spans")),
            lambda s, x: F.struct(
                (s["at"] + F.char_length(x) + len(SEP)).alias("at"),
                F.when(
                    b["role"] == learn,
                    F.concat(s["spans"], F.array(F.struct((s["at"] + 1).alias("start"), F.char_length(x).alias("length")))),
                )
                .otherwise(s["spans"])
                .alias("spans"),
            ),
        )
        return F.struct((inner["at"] - len(SEP) + len(END) + 1).alias("at"), inner["spans"].alias("spans"))

    walked = F.aggregate("blocks", F.struct(F.lit(0).alias("at"), spans.alias("spans")), walk)
    return blocks.select("conv_id", F.array_join(written, "").alias("formatted"), walked["spans"].alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """`turns` (role, text) and `loss_text` from `formatted` and `loss_spans`."""
    parts = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda x: x != "")

    def turns_of(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        rest = F.substring(part, F.char_length(role) + 2, F.char_length(part))
        body = F.substring(rest, F.lit(1), F.char_length(rest) - len(END) - 1)
        return F.transform(
            F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(_unescape_role(role).alias("role"), unescape(t).alias("text"))
        )

    loss = F.array_join(F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), s["start"], s["length"])), "")
    return chats.withColumn("turns", F.flatten(F.transform(parts, turns_of))).withColumn("loss_text", unescape(loss))
