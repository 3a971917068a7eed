"""Loading delimited records while setting the failing ones apart with the reason.

Records are split into fields by quoting rules and exploded into cells (row,
column, value): one a checked field, one for the quoting and one for the number
of fields. Cells meet a rule table, the errors of a row are aggregated to the
first that applies, and an anti join leaves the clean rows.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workdir import materialize

#: Stands for a comma inside quotes while fields are split, and for itself.
_ESC = "\x1a"


#: Columns of the cells that a record has besides its fields: whether its quoting holds (``ok``), and its number of fields.
QUOTING, COLUMNS = -2, -1


@dataclass(frozen=True)
class Rule:
    """A cell of a column (0-based) must hold the null mark or match; ``reason`` names a failure.

    ``equals`` is the only value allowed; else ``pattern`` must match the whole
    value, ``max_chars`` bounds its length and ``whole_number`` asks that it fit
    a signed 64-bit integer. ``priority`` orders the reasons of one row, the
    smallest counts.
    """

    column: int
    reason: str
    priority: int
    pattern: str | None = None
    max_chars: int = 2**31 - 1
    whole_number: bool = False
    equals: str | None = None


def record_rules(fields: int) -> tuple[Rule, ...]:
    """The rules of any record: sound quoting, so many fields."""
    return Rule(QUOTING, "quoting", 1, equals="ok"), Rule(COLUMNS, "columns", 2, equals=str(fields))


_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
HTTP_FIELDS = (
    "c_ip c_port s_ip s_port req_time resp_time method host path referrer user_agent req_cookie set_cookie server "
    "content_type content_range request_body_len response_body_len status_code"
).split()
HTTP_RULES = (
    *record_rules(len(HTTP_FIELDS)),
    Rule(7, "host", 3, rf"{_LABEL}(?:\.{_LABEL})*", 253),
    Rule(17, "response_body_len", 4, "[0-9]+", whole_number=True),
    Rule(18, "status_code", 5, "[1-5][0-9][0-9]", 3),
)


def split_record(line: Column) -> Column:
    """The fields of a record, or NULL where its quoting is broken.

    Cutting at every quote leaves pieces that lie in turn outside and inside
    quotes. Quoting holds if the count is odd and each outside piece touches a
    comma or the record's edge wherever it meets a quote; an empty one between
    two quoted pieces is a doubled quote. All in array functions: no pattern
    that could run deep on a long record.
    """
    return F.when(~line.contains('"'), F.split(line, ",", -1)).otherwise(_quoted_fields(line))


def _let(value: Column, body) -> Column:
    """``body`` over ``value`` computed once: inside a lambda a variable is a value, not an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _quoted_fields(line: Column) -> Column:
    def read(pieces: Column) -> Column:
        return _let(F.size(pieces) - 1, lambda last: _join_pieces(pieces, last))

    return _let(F.split(line, '"', -1), read)


def _join_pieces(pieces: Column, last: Column) -> Column:
    inside = lambda i: F.pmod(i, F.lit(2)) == 1

    def outside_ok(x: Column, i: Column) -> Column:
        opens, closes = (i == 0) | x.startswith(","), (i == last) | x.endswith(",")
        return inside(i) | (x == "") | (opens & closes)

    def shield(x: Column, i: Column) -> Column:
        kept = F.replace(x, F.lit(_ESC), F.lit(_ESC + "0"))
        doubled = (x == "") & (i > 0) & (i < last)
        return F.when(inside(i), F.replace(kept, F.lit(","), F.lit(_ESC + "1"))).when(doubled, F.lit('"')).otherwise(kept)

    good = ~inside(last) & F.forall(F.transform(pieces, outside_ok), lambda ok: ok)
    text = F.concat_ws("", F.transform(pieces, shield))
    fields = F.transform(F.split(text, ",", -1), lambda x: F.replace(F.replace(x, F.lit(_ESC + "1"), F.lit(",")), F.lit(_ESC + "0"), F.lit(_ESC)))
    return F.when(good, fields)


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """The rules as a table, one row each."""
    return spark.createDataFrame(
        [(r.column, r.reason, r.priority, r.pattern and rf"\A(?:{r.pattern})\z", r.max_chars, r.whole_number, r.equals) for r in rules],
        "column int, reason string, priority int, pattern string, max_chars int, whole_number boolean, equals string",
    )


class Intake:
    """Rows of ``df`` parsed from ``line`` and known by ``id``.

    ``rejected()`` has one row (id, reason) for each record that fails,
    ``accepted()`` the others as typed columns. Every reason comes from the
    rule table; rules for the record as a whole are those of ``record_rules``.
    Rows are told apart by place, so repeated ids and rows are judged each on
    their own; a NULL id is an id. A NULL line has no fields and so fails as
    ``columns``; an empty one has a single empty field. Fields that hold the
    null mark ``-`` come out NULL. Other columns of ``df`` are not read.
    """

    def __init__(self, df: DataFrame, id: str, line: str, fields: list[str], rules: tuple[Rule, ...], types: dict[str, str] | None = None):
        self.id, self.fields, self.types = id, fields, types or {}
        raw = F.col(line)
        self.rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id).alias("_id"), raw.isNull().alias("_none"), split_record(raw).alias("_fields"))
        self.rules = F.broadcast(rule_table(df.sparkSession, rules))
        self.columns = sorted({r.column for r in rules} - {QUOTING, COLUMNS})

    def _errors(self, rows: DataFrame) -> DataFrame:
        """``_row, _id, reason`` of each failing record: its cells against the rules, the first reason of those that fail."""
        sound = F.col("_none") | F.col("_fields").isNotNull()
        cells = F.array(
            F.struct(F.lit(QUOTING).alias("column"), F.when(sound, "ok").otherwise("broken").alias("value")),
            F.struct(F.lit(COLUMNS).alias("column"), F.coalesce(F.size("_fields"), F.lit(0)).cast("string").alias("value")),
            *[F.struct(F.lit(c).alias("column"), F.get("_fields", F.lit(c)).alias("value")) for c in self.columns],
        )
        each = rows.select("_row", "_id", F.explode(cells).alias("_cell")).select("_row", "_id", "_cell.*").where("value IS NOT NULL")
        value = F.col("value")
        fits = (F.length(value) <= F.col("max_chars")) & F.rlike(value, F.col("pattern")) & (~F.col("whole_number") | value.try_cast("bigint").isNotNull())
        holds = F.when(F.col("equals").isNotNull(), value == F.col("equals")).otherwise((value == "-") | fits)
        first = F.min(F.struct("priority", "reason")).getField("reason")
        return each.join(self.rules, "column").where(~holds).groupBy("_row", "_id").agg(first.alias("reason"))

    def rejected(self) -> DataFrame:
        """``id, reason`` of each failing record, in one pass over the lines."""
        return self._errors(self.rows).select(F.col("_id").alias(self.id), "reason")

    def accepted(self) -> DataFrame:
        """The clean records: the id, then the fields, cast where a type is given (NULL where the cast fails).

        The parsed records are written to the shared folder when this is
        called, so each line is parsed once and its place stays its name.
        """
        rows = materialize(self.rows, "records")
        clean = rows.join(self._errors(rows).select("_row"), "_row", "left_anti")
        out = []
        for i, name in enumerate(self.fields):
            value = F.nullif(F.get("_fields", F.lit(i)), F.lit("-"))
            out.append((value.try_cast(self.types[name]) if name in self.types else value).alias(name))
        return clean.select(F.col("_id").alias(self.id), *out)
