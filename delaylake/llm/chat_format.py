"""Chat logs to training texts with a loss mask.

Method: event-sourced reconstruction. A log holds events: ``open`` starts a message with its
first text, ``delta`` adds text, ``edit`` sets another text, ``regenerate`` throws the text away
(the deltas after it make it anew) and ``retract`` takes the message out. Events are gathered by
conversation and message, sorted by sequence and folded into the final text; messages are
escaped and rendered one by one, and only then brought together, so that the events of a long
conversation are spread over tasks. Everything is DataFrame expressions.

A message is rendered as ``### role: text</turn>`` and a line break. In texts every ``\\`` and ``#``
gets a ``\\`` before it, and ``</turn>`` becomes ``<\\/turn>``; in roles ``%``, ``:``, ``<``, ``#`` are
written as ``%25``, ``%3A``, ``%3C``, ``%23``. So no text or role can end a turn or start one, and reading
back gives what was written.

Defined results: null texts and roles are empty ones; events of an unknown or null kind count for
nothing; events with equal sequence are ordered by kind and text; conversations and messages
with a null id are one conversation and one message; a conversation whose messages are all
retracted has no row; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylake.llm.common import let

#: Fixed values of the template.
TURN_START, ROLE_END, TURN_END = "### ", ": ", "</turn>\n"
TRAINED_ROLE = "assistant"

ROLE_CODES = (("%", "%25"), (":", "%3A"), ("<", "%3C"), ("#", "%23"))


def escape_text(text: Column) -> Column:
    for plain, coded in (("\\", "\\\\"), ("#", "\\#"), ("</turn>", "<\\/turn>")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    for plain, coded in ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for plain, coded in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def fold(events: DataFrame) -> DataFrame:
    """The final messages: conv_id, message, at (sequence of its first event), role, text.

    ``events`` has conv_id, message, seq, kind, role and text; seq may be of any type with an
    order."""
    kinds = ("open", "delta", "edit", "regenerate", "retract")
    known = events.where(F.col("kind").isin(*kinds))
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")
    restart = F.when(F.col("kind").isin("open", "edit", "regenerate"), F.col("seq"))
    gathered = known.groupBy("conv_id", "message").agg(
        F.min("seq").alias("at"),
        F.min(F.when(F.col("kind") == "open", F.struct("seq", "role")))["role"].alias("role"),
        F.max(restart).alias("_from"),
        F.max(F.col("kind") == "retract").alias("_retracted"),
        F.collect_list(event).alias("_events"),
    )
    valid = F.filter(
        F.array_sort("_events"),
        lambda e: F.col("_from").isNull() | (e["seq"] >= F.col("_from")),
    )
    parts = F.transform(
        valid, lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"])
    )
    return gathered.where(~F.col("_retracted")).select(
        "conv_id",
        "message",
        "at",
        F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(parts, "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One text for each conversation, and its mask.

    ``loss_mask`` has one entry for each turn: how many characters (code points) the turn takes,
    and the loss is on ``take`` of them after the first ``skip``."""
    head = F.concat(F.lit(TURN_START), escape_role(F.col("role")), F.lit(ROLE_END))
    trained = F.col("role") == TRAINED_ROLE
    turns = messages.select(
        "conv_id", "at", "message", head.alias("head"), escape_text(F.col("text")).alias("body"),
        trained.alias("trained"),
    )
    turn = F.struct(
        "at",
        "message",
        F.concat("head", "body", F.lit(TURN_END)).alias("written"),
        F.length("head").alias("skip"),
        F.when(F.col("trained"), F.length("body")).otherwise(0).alias("take"),
    )
    gathered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    mask = F.transform(
        "turns",
        lambda t: F.struct(
            F.length(t["written"]).alias("turn_chars"), t["skip"].alias("skip"),
            t["take"].alias("take"),
        ),
    )
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["written"]), "").alias("formatted"),
        mask.alias("loss_mask"),
    )


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text of each) and loss_text, from the rendered text and mask."""
    pieces = F.split("formatted", TURN_END)

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(TURN_START) + 1), F.length(piece))
        return let(
            F.substring_index(inner, ROLE_END, 1),
            lambda role: F.struct(
                unescape_role(role).alias("role"),
                unescape_text(
                    F.substring(inner, F.length(role) + len(ROLE_END) + 1, F.length(inner))
                ).alias("text"),
            ),
        )

    def trained(piece: Column, mask: Column) -> Column:
        return F.when(
            mask["take"] > 0, F.substring(piece, mask["skip"] + 1, mask["take"])
        ).otherwise(F.lit(""))

    whole = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return formatted.select(
        "conv_id",
        F.transform(whole, turn).alias("turns"),
        unescape_text(F.array_join(F.zip_with(whole, "loss_mask", trained), "")).alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Of the texts, by a checksum, one in so many takes each of the ways to its final form.
WAYS = 4


def log_of(conversations: DataFrame) -> DataFrame:
    """Finished turns as a log that ends in them. Every row is a message of its own; rows of one
    turn are ordered by role and a hash of the text.

    A text is streamed line by line: ``open`` and ``delta``. By the checksum of the text, some of the
    messages got there by other ways: a draft and the start of its next line, thrown away by
    ``regenerate`` before the lines; a draft whose place an ``edit`` with the first line takes; a
    second message, opened beside the first and retracted. Events are listed last first."""
    messages = conversations.select(
        "conv_id",
        F.monotonically_increasing_id().alias("message"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.md5("text")).alias("_row"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.split(F.coalesce("text", F.lit("")), r"(?<=\n)").alias("_lines"),
        F.pmod(F.crc32(F.coalesce("text", F.lit(""))), F.lit(WAYS)).alias("_way"),
    )
    message, beside = F.col("message"), -1 - F.col("message")
    regenerated, edited, retracted = (F.col("_way") == i for i in (1, 2, 3))

    def event(place: int | Column, kind: str | Column, text: Column, of: Column = message) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        place = F.lit(place) if isinstance(place, int) else place
        return F.struct(
            of.alias("message"), place.alias("place"), kind.alias("kind"), text.alias("text")
        )

    draft = F.concat(F.lit("draft: "), F.reverse(F.get("_lines", F.lit(0))))
    first = F.when(regenerated, "delta").when(edited, "edit").otherwise("open")
    before = (
        F.when(
            regenerated,
            F.array(
                event(0, "open", draft), event(1, "delta", F.lit("and")),
                event(2, "regenerate", F.lit(None).cast("string")),
            ),
        )
        .when(edited, F.array(event(0, "open", draft)))
        .when(
            retracted,
            F.array(
                event(0, "open", draft, beside),
                event(1, "retract", F.lit(None).cast("string"), beside),
            ),
        )
        .otherwise(F.array())
    )
    lines = F.transform(
        "_lines",
        lambda line, i: event(i + 3, F.when(i == 0, first).otherwise("delta"), line),
    )
    events = messages.select(
        "conv_id", "role", "_row", F.explode(F.reverse(F.concat(before, lines))).alias("_event")
    )
    return events.select(
        "conv_id",
        F.col("_event.message").alias("message"),
        F.struct("_row", F.col("_event.place").alias("_place")).alias("seq"),
        F.col("_event.kind").alias("kind"),
        "role",
        F.col("_event.text").alias("text"),
    )
