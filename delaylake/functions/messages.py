"""JSON messages: writing them from records and reading them back."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values
MESSAGE_FIELDS = (
    "FL_DATE",
    "AIRLINE",
    "ORIGIN",
    "DEST",
    "DISTANCE",
    "DEP_DELAY",
    "ARR_DELAY",
    "CANCELLED",
    "CANCELLATION_REASON",
)

UNPARSED = "_unparsed"


def text_schema(names: Iterable[str]) -> T.StructType:
    """Every field as text: numbers arrive both quoted and bare, and a text field takes both."""
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def to_messages(
    records: DataFrame, columns: Iterable[str] | None = None, *also: str
) -> DataFrame:
    """One JSON object per record in a column ``value``, after the columns named in ``also``.
    NULL fields stay in the object."""
    names = list(columns or records.columns)
    return records.select(
        *also, F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")
    )


def parse_messages(
    bronze: DataFrame,
    keep_unparsed: bool = False,
    keep_message: bool = False,
    once: bool = False,
) -> DataFrame:
    """The message fields as text columns.

    No row is dropped: a message that is no JSON object becomes a row of NULLs.
    With ``keep_unparsed`` such a message is also kept whole in ``_unparsed``, and with
    ``keep_message`` every message in ``json``.

    A later filter on a field is moved below the parse, and then parses every message itself.
    With ``once`` it stays above; but then all fields are parsed, whichever are asked for.
    """
    schema, options = text_schema(MESSAGE_FIELDS), {}
    if keep_unparsed:
        schema = schema.add(UNPARSED, T.StringType())
        options = {"columnNameOfCorruptRecord": UNPARSED}
    also = ["json"] if keep_message else []
    message = F.from_json("json", schema, options)
    if once:
        return bronze.select(*also, F.inline(F.array(message)))
    return bronze.select(*also, message.alias("m")).select(*also, "m.*")
