"""Chat formatting by event-sourced reconstruction, on built-in functions only.

A log holds events of conversations.  Events are partitioned by conversation and
folded in the order of their sequence:

* ``message`` sets the text of a turn, and its role;
* ``delta`` appends to the text of its turn (a streamed piece);
* ``edit`` replaces the text of its turn and drops all that was said after it;
* ``regenerate`` empties its turn and drops all that was said after it, so that
  the deltas that follow write it anew.

What is left is rendered with a template whose marks cannot occur in a text:
``&`` and the opening of a mark are escaped, and ``unescaped`` undoes that.

Null texts and null roles are empty, events without a conversation or a
turn are put to conversation or turn null and kept apart like any other value.
Ties of sequence are ordered by kind, role and text; repeated events of kind
``message`` and ``edit`` change nothing, repeated deltas append twice.  Empty logs
give no conversations.

A conversation is one value in the result, so its events meet in one task; they
are folded per turn first.  A log whose events of one turn outgrow a task's
memory can't be rendered into one string either.  Folds, places and reading back take
time in proportion to the text: places are running sums, and spans are cut out by bytes.

``as_log`` writes conversations as the log of a service that streams: texts come in
pieces, some after a draft that is generated anew, some after a wrong text that was
answered before it was edited.  Folding must undo all of that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|turn|>", "<|says|>", "<|end|>"
#: Code points of a streamed piece.
PIECE = 512
#: What starts every mark of the template, and what stands for it inside texts.
MARK, STANDS = "<|", "&lt;|"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit(MARK), F.lit(STANDS))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(STANDS), F.lit(MARK)), F.lit("&amp;"), F.lit("&"))


def numbered(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text), each a turn of its own in order of turn (null last), role and text.

    So rows that share a turn or are repeated all stay.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role"), F.col("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("turn", F.row_number().over(order).cast("long"))


def as_log(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """The event log of a service that ended with these conversations: conv_id, seq, turn, kind, role, text."""
    text = F.coalesce("text", F.lit(""))
    event = lambda kind, said, ahead=0, role="role": F.struct(F.lit(ahead).cast("long").alias("ahead"), F.lit(kind).alias("kind"), (F.col(role) if role else F.lit("assistant")).alias("role"), said.alias("text"))
    count = F.greatest(F.lit(1), F.ceil(F.length(text) / piece)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), count - 1), lambda k: event("delta", F.substr(text, k * piece + 1, F.lit(piece))))
    opened, draft = event("message", F.lit("")), event("delta", F.concat(F.substr(text, F.lit(1), F.lit(9)), F.lit(" no, wait")))
    streamed = F.concat(F.array(opened), pieces)
    anew = F.concat(F.array(opened, draft, event("regenerate", F.lit(""))), pieces)
    # the wrong text is answered, and the answer's answer too, before the edit drops them
    edited = F.array(event("message", F.lit("a slip")), event("message", F.lit("what?"), 1, None), event("delta", F.lit(" so?"), 1, None), event("message", text, 2), event("edit", text))
    how = F.pmod(F.crc32(F.concat(text, F.col("turn").cast("string")).cast("binary")), F.lit(3))
    rows = numbered(conversations).withColumn("events", F.when(how == 0, streamed).when(how == 1, anew).otherwise(edited))
    rows = rows.select("conv_id", "turn", F.posexplode("events").alias("at", "event"))
    return rows.select("conv_id", (F.shiftleft(F.col("turn"), 24) + F.col("at")).alias("seq"), (F.col("turn") + F.col("event.ahead")).alias("turn"), "event.kind", "event.role", "event.text")


def reconstructed(log: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of the turns that are left of a log."""
    events = log.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.struct(
            F.col("seq").cast("long").alias("seq"),
            F.coalesce("kind", F.lit("message")).alias("kind"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("event"),
    )
    turns = events.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("event")).alias("events"))
    cuts = F.filter("events", lambda e: e["kind"].isin("edit", "regenerate"))
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.max(F.array_max(F.transform(cuts, lambda e: e["seq"]))).over(before)
    alive = F.filter("events", lambda e: F.col("cut").isNull() | (e["seq"] > F.col("cut")))
    # the text is what the last event that isn't a delta says, and the deltas after it
    place = F.aggregate("events", F.struct(F.lit(0).alias("at"), F.lit(0).alias("last")), lambda a, e: F.struct((a["at"] + 1).alias("at"), F.when(e["kind"] == "delta", a["last"]).otherwise(a["at"] + 1).alias("last")))["last"]
    base = F.when(F.col("last") > 0, F.element_at("events", F.greatest("last", F.lit(1))))
    said = F.when(base["kind"] == "regenerate", F.lit("")).otherwise(F.coalesce(base["text"], F.lit("")))
    pieces = F.array_join(F.transform(F.slice("events", F.col("last") + 1, F.size("events")), lambda e: e["text"]), "")
    named = F.filter("events", lambda e: e["kind"] == "message")
    role = F.when(F.size(named) > 0, F.element_at(named, -1)["role"]).otherwise(F.element_at("events", -1)["role"])
    return turns.withColumn("cut", cut).withColumn("events", alive).where(F.size("events") > 0).withColumn("last", place).select("conv_id", "turn", role.alias("role"), F.concat(said, pieces).alias("text"))


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, and loss: of each assistant text in it start (from 0) and length, in code points and in bytes."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.select("conv_id", "turn", (F.col("role") == "assistant").alias("learn"), F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(CLOSE)).alias("head"), escaped(F.col("text")).alias("body"))
    for name, size in (("length", F.length), ("octets", F.octet_length)):
        whole = (size("head") + size("body") + len(END)).cast("long")
        rows = rows.withColumns({f"{name}_at": F.coalesce(F.sum(whole).over(before), F.lit(0)) + size("head"), name: size("body").cast("long")})
    span = F.struct(F.col("length_at").alias("start"), "length", F.col("octets_at").alias("byte_start"), F.col("octets").alias("byte_length"))
    # pieces in the order of where they start
    piece = F.struct(F.col("length_at").alias("at"), F.concat("head", "body", F.lit(END)).alias("piece"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.array_sort(F.collect_list(F.when(F.col("learn"), span))).alias("loss"))
    return rows.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss")


def formatted(log: DataFrame) -> DataFrame:
    """Reconstruct a log and render it."""
    return rendered(reconstructed(log))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    parts = F.filter(F.split(formatted, r"\Q" + END + r"\E", -1), lambda p: p.startswith(OPEN))
    return F.transform(parts, lambda p: F.struct(unescaped(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), CLOSE, 1)).alias("role"), unescaped(F.substr(p, F.locate(CLOSE, p) + len(CLOSE))).alias("text")))


def digests(conversations: DataFrame) -> DataFrame:
    """Format conversations and report on what is read back from the output."""
    rows = formatted(as_log(conversations)).withColumn("turns", read_back(F.col("formatted")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    octets = F.col("formatted").cast("binary")
    masked = F.transform("loss", lambda s: unescaped(F.substr(octets, s["byte_start"].cast("int") + 1, s["byte_length"].cast("int")).cast("string")))
    rows = rows.withColumn("learned", F.array_join(masked, ""))
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
