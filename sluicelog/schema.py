"""The three fixed tables. Times are epoch seconds; every column is nullable but two of the flows'."""

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(text: str, required: tuple[str, ...] = ()) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(), "as": T.ArrayType(T.StringType()), "al": T.ArrayType(T.LongType())}
    return T.StructType([T.StructField(name, kinds[kind], name not in required) for name, kind in (x.split(":") for x in text.split())])


DNS = _schema(
    "c_ip:s c_port:l s_ip:s s_port:l trans_id:s query:s req_type:s req_class:s req_time:d resp_time:d "
    "flags_req:l flags_resp:l resp_code:s answers:as answer_types:as answer_ttls:al"
)
HTTP = _schema(
    "c_ip:s c_port:l s_ip:s s_port:l req_time:d resp_time:d method:s host:s path:s referrer:s user_agent:s req_cookie:s "
    "set_cookie:s server:s content_type:s content_range:s request_body_len:l response_body_len:l status_code:l"
)
NAMED_FLOWS = _schema("c_ip:s c_port:l s_ip:s s_port:l c_pkt:l c_bytes:l s_pkt:l s_bytes:l time_start:d time_end:d name:s", ("c_ip", "time_start"))


class TableType(Enum):
    """What a source gives and an analytic takes; ``ANY`` takes all."""

    DNS = "DNS"
    HTTP = "HTTP"
    NAMED_FLOWS = "NamedFlows"
    ANY = "*"

    @property
    def schema(self) -> T.StructType | None:
        return {"DNS": DNS, "HTTP": HTTP, "NamedFlows": NAMED_FLOWS}.get(self.value)


def validate(df: DataFrame, kind: TableType) -> DataFrame:
    """``df``, or an error that names the columns it lacks or has in another type. More columns do no harm."""
    if kind.schema is not None:
        has = {f.name: f.dataType for f in df.schema}
        wrong = [f.name for f in kind.schema if has.get(f.name) != f.dataType]
        if wrong:
            raise ValueError(f"not a {kind.value} table: {', '.join(wrong)}")
    return df


def conform(df: DataFrame, kind: TableType) -> DataFrame:
    """The table's columns by name, in order and type; columns that ``df`` lacks are NULL."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.schema])
