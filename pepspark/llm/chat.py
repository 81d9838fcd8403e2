"""Chat formatting checked by a grammar round trip, in DataFrame functions only.

Grammar: a conversation is a sequence of turns; a turn is ``### NAME: BODY</turn>`` and a
newline.  The roles user, assistant and system have capitalised names; any other role is
its own name.  A backslash makes the next character ordinary text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, COLON, END = "### ", ": ", "</turn>\n"
NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}


def _choose(value: Column, table: dict[str, str], other: Column) -> Column:
    out = other
    for key, name in table.items():
        out = F.when(value == key, F.lit(name)).otherwise(out)
    return out


def _escape(text: Column) -> Column:
    """A body in which no control string is left: backslashes doubled, end marks broken."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("</turn>"), F.lit("<\\/turn>"))


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _name(role: Column, escaped: Column) -> Column:
    safe = F.replace(_escape(role), F.lit(COLON), F.lit(":\\ "))
    safe = F.when(role.isin(*NAMES.values()), F.concat(F.lit("\\"), safe)).otherwise(safe)
    return _choose(role, NAMES, F.when(escaped, safe).otherwise(role))


def _piece(turn: Column, escaped: Column) -> Column:
    """A turn without its end mark."""
    return F.concat(F.lit(HEAD), _name(turn["role"], escaped), F.lit(COLON), F.when(escaped, _escape(turn["text"])).otherwise(turn["text"]))


def parse(formatted: Column) -> Column:
    """The deterministic parser: array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"\Q" + END + r"\E", -1), lambda p: p.startswith(HEAD))

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, len(HEAD) + 1, 2147483647)
        at = F.locate(COLON, inner)
        name = inner.substr(F.lit(1), at - 1)
        body = inner.substr(at + len(COLON), F.lit(2147483647))
        role = _choose(name, {v: k for k, v in NAMES.items()}, _unescape(name))
        return F.struct(role.alias("role"), _unescape(body).alias("text"))

    return F.transform(pieces, turn)


def _same(formatted: Column, turns: Column) -> Column:
    plain = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return parse(formatted).eqNullSafe(plain) & formatted.endswith(END)


def format_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_spans, n_escaped.

    Turns are in order of turn (null first), then role, then text, so repeated turns all
    stay in a defined order; a null role or text is empty; rows of a null id are one
    conversation.  The plain rendering is parsed again; the turns that do not come back
    by themselves are escaped, and the result is parsed and compared once more.  An
    escaped turn always comes back, so a difference then is an error, not a row.
    ``loss_spans`` are the (start, length) in code points, from 0, of the assistant
    bodies as they stand in ``formatted``.  A conversation is one value, so it must fit
    in one row (2 GB).
    """
    plain = rows.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
        ).alias("turn"),
    )
    grouped = plain.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    render = lambda t, e: F.concat(_piece(t, e), F.lit(END))
    none = F.lit(False)
    first = grouped.withColumn("plain", F.array_join(F.transform("turns", lambda t: render(t, none)), ""))
    checked = first.withColumn("identical", _same(F.col("plain"), F.col("turns")))
    marked = checked.withColumn(
        "marked",
        F.when(F.col("identical"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), none.alias("escaped")))).otherwise(
            F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (~_same(render(t, none), F.array(t))).alias("escaped")))
        ),
    )
    pieces = marked.withColumn("pieces", F.transform("marked", lambda t: _piece(t, t["escaped"])))
    joined = pieces.withColumn("formatted", F.concat(F.array_join("pieces", END), F.lit(END)))
    proved = joined.withColumn(
        "formatted",
        F.when(F.col("identical") | _same(F.col("formatted"), F.col("turns")), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip"))),
    )
    kind = "struct<at:int,spans:array<struct<start:int,length:int>>>"
    steps = F.zip_with("marked", "pieces", lambda t, p: F.struct((t["role"] == "assistant").alias("masked"), F.length(p).alias("size"), F.length(_name(t["role"], t["escaped"])).alias("name")))
    spans = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")).cast(kind),
        lambda a, s: F.struct(
            (a["at"] + s["size"] + len(END)).alias("at"),
            F.when(
                s["masked"],
                F.array_append(
                    a["spans"],
                    F.struct(
                        (a["at"] + s["name"] + len(HEAD) + len(COLON)).cast("int").alias("start"),
                        (s["size"] - s["name"] - len(HEAD) - len(COLON)).cast("int").alias("length"),
                    ),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ).cast(kind),
        lambda a: a["spans"],
    )
    escaped = F.size(F.filter("marked", lambda t: t["escaped"]))
    return proved.select("conv_id", "formatted", spans.alias("loss_spans"), escaped.alias("n_escaped"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted text holds: conv_id, turns, loss_text (unescaped text under the mask), formatted_chars."""
    under = F.transform("loss_spans", lambda s: _unescape(F.col("formatted").substr(s["start"] + 1, s["length"])))
    return formatted.select("conv_id", parse(F.col("formatted")).alias("turns"), F.array_join(under, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns of each conversation, all taken from the formatted text."""
    back = read_back(formatted)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
