"""Chat formatting with a grammar round trip (DataFrame functions only).

Grammar of the rendered text::

    conversation := turn*
    turn         := START [ESCAPED] role "\\n" text END "\\n"

Role and text hold no control string; a role holds no newline. A deterministic parser reads this
back by splitting on END. Each turn is first rendered plainly and reparsed by
itself; a turn that does not come back identical is rendered with ESCAPED and with its
control strings escaped (``&`` -> ``&amp;``, ``<|`` -> ``&lt;|`` and, in a role,
a newline -> ``&nl;``). The whole conversation is then reparsed and compared
again; if it still differed, every turn would be escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END, ESCAPED = "<|im_start|>", "<|im_end|>", "<|escaped|>"


def _escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def _unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _turn(role: Column, text: Column, escape: Column) -> Column:
    safe_role = F.replace(_escape(role), F.lit("\n"), F.lit("&nl;"))
    plain = F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))
    return F.when(escape, F.concat(F.lit(START + ESCAPED), safe_role, F.lit("\n"), _escape(text), F.lit(END + "\n"))).otherwise(plain)


def _pieces(rendered: Column) -> Column:
    """The parts before each END, without the newline that closes the turn before."""
    parts = F.split(rendered, r"<\|im_end\|>", -1)
    whole = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(whole, lambda p, i: F.when(i == 0, p).when(p.startswith("\n"), F.substr(p, F.lit(2))).otherwise(F.lit("")))


def _piece_turn(piece: Column) -> Column:
    """struct(role, text, head, escaped) of one piece, or null where it breaks the grammar. head: characters before the text."""
    escaped = piece.startswith(START + ESCAPED)
    skip = F.when(escaped, F.lit(len(START + ESCAPED))).otherwise(F.lit(len(START)))
    body = F.substr(piece, skip + 1)
    cut = F.locate("\n", body)
    role, text = F.substr(body, F.lit(1), cut - 1), F.substr(body, cut + 1)
    broken = ~piece.startswith(START) | (cut == 0) | body.contains(START) | body.contains(ESCAPED)
    return F.when(
        ~broken,
        F.struct(
            F.when(escaped, _unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))).otherwise(role).alias("role"),
            F.when(escaped, _unescape(text)).otherwise(text).alias("text"),
            (skip + cut).cast("int").alias("head"),
            escaped.alias("escaped"),
        ),
    )


def parse(rendered: Column) -> Column:
    """array<struct<role, text, head, escaped>>; a piece that breaks the grammar is null."""
    return F.transform(_pieces(rendered), _piece_turn)


def _same(parsed: Column, turns: Column) -> Column:
    view = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    return F.coalesce(F.transform(parsed, view) == F.transform(turns, view), F.lit(False))


def format_chat(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: ``conv_id, turns, formatted, mask, escaped_turns, identical``.

    Turns are ordered by (turn, role, text), so ties and repeated rows have one
    order; null roles and texts are empty. ``mask`` has for each turn its characters before
    the text (``head``), of the text (``body``), after it (``tail``) and whether
    the body counts in the loss; the runs add up to the formatted text.
    ``identical`` says that the formatted text parses to the source. An empty table gives no rows.
    A conversation is one formatted text, hence one row: its size bounds a task's memory. Texts of any length stay whole. Other columns are not
    read, so clashing names don't matter.
    """
    piece = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    grouped = conversations.select(F.col(id_col).alias("conv_id"), piece.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    alone = grouped.withColumn(
        "marked",
        F.transform(
            "turns",
            lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (~_same(parse(_turn(t["role"], t["text"], F.lit(False))), F.array(t))).alias("clash")),
        ),
    )
    first = alone.withColumn("formatted", F.array_join(F.transform("marked", lambda t: _turn(t["role"], t["text"], t["clash"])), ""))
    checked = first.withColumn("formatted", F.when(_same(parse(F.col("formatted")), F.col("turns")), F.col("formatted")).otherwise(F.array_join(F.transform("marked", lambda t: _turn(t["role"], t["text"], F.lit(True))), "")))
    parsed = checked.withColumn("pieces", _pieces(F.col("formatted"))).withColumn("parsed", F.transform("pieces", _piece_turn))
    mask = F.transform(
        F.arrays_zip("pieces", "parsed"),
        lambda z: F.struct(
            z["parsed"]["head"].alias("head"),
            (F.length(z["pieces"]) - z["parsed"]["head"]).alias("body"),
            F.lit(len(END) + 1).alias("tail"),
            (z["parsed"]["role"] == loss_role).alias("loss"),
        ),
    )
    return parsed.select(
        "conv_id",
        "turns",
        "formatted",
        mask.alias("mask"),
        F.size(F.filter("parsed", lambda p: p["escaped"])).alias("escaped_turns"),
        _same(F.col("parsed"), F.col("turns")).alias("identical"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text and its mask hold: one row a conversation."""
    rows = formatted.withColumn("pieces", _pieces(F.col("formatted"))).withColumn("parsed", F.transform("pieces", _piece_turn))
    turns = F.array_join(F.transform("parsed", lambda p: F.concat(p["role"], F.lit("\n"), p["text"], F.lit("\n"))), "")
    zipped = F.arrays_zip("pieces", "parsed", "mask")
    under = F.transform(F.filter(zipped, lambda z: z["mask"]["loss"]), lambda z: F.struct(F.substr(z["pieces"], z["mask"]["head"] + 1, z["mask"]["body"]).alias("text"), z["parsed"]["escaped"].alias("escaped")))
    loss = F.array_join(F.transform(under, lambda u: F.when(u["escaped"], _unescape(u["text"])).otherwise(u["text"])), "")
    return rows.select("conv_id", F.size("parsed").cast("long").alias("n_turns"), turns.alias("turns_text"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id",
        "n_turns",
        F.sha2("turns_text", 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
