"""Error bodies of database calls, brought to one shape.

``normalise`` and ``rollbacks`` add the same six columns: error_kind (``unavailable``
for transport failures, ``worker`` for errors the database reported), error_code,
error_message, inner_code, driver and failed_index.  The JSON text is parsed once, into
a column of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Messages and codes callers match on.
TIMED_OUT = "invocation timed out"
NOT_CONNECTED = "engine not connected"
ROLLED_BACK = "transaction rolled back"
NOT_REGISTERED = (
    "database worker function not registered (%s); is the database worker running?"
)
CONFIG_CODES = ("UNKNOWN_DB", "CONFIG_ERROR")
CONFIG_ERROR = "CONFIG_ERROR"
WORKER_UNAVAILABLE = "DATABASE_WORKER_UNAVAILABLE"
REJECTED = "database worker rejected the call: "
CALL_FAILED = "database call failed: "


def _json(text: Column) -> Column:
    """Variant of a whole JSON text; null when anything else follows the value.

    Parsing it as the only element of an array makes trailing text an error.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(
        F.try_variant_get(wrapped, "$[1]", "variant").isNull(),
        F.try_variant_get(wrapped, "$[0]", "variant"),
    )


def _field(body: Column, path: str) -> Column:
    return F.try_variant_get(body, path, "variant")


def _string(body: Column, path: str) -> Column:
    """A field only when it is a JSON string."""
    field = _field(body, path)
    return F.when(F.schema_of_variant(field) == "STRING", field.cast("string"))


def _index(body: Column, path: str) -> Column:
    """A field only when it is a non-negative JSON integer."""
    field = _field(body, path)
    number = F.when(F.schema_of_variant(field) == "BIGINT", field.cast("bigint"))
    return F.when(number >= 0, number)


def _body_message(fallback: Column) -> Column:
    """The body's message with the driver's own code, which is what people search for."""
    base, inner, driver = F.coalesce("_message", fallback), F.col("inner_code"), F.col("driver")
    return (
        F.when(inner.isNull(), base)
        .when(
            F.coalesce(driver, F.lit("postgres")) == "postgres",
            F.concat(base, F.lit(" (SQLSTATE "), inner, F.lit(")")),
        )
        .otherwise(F.concat(base, F.lit(" ("), driver, F.lit(" error code "), inner, F.lit(")")))
    )


def _with_body_fields(df: DataFrame) -> DataFrame:
    body = F.col("_body")
    return df.withColumns(
        {
            "_code": _string(body, "$.code"),
            "_message": _string(body, "$.message"),
            "inner_code": _string(body, "$.inner_code"),
            "driver": _string(body, "$.driver"),
            "failed_index": _index(body, "$.failed_index"),
        }
    )


def normalise(df: DataFrame) -> DataFrame:
    """Errors of failed calls (kind, code, message), kind being timeout, not_connected,
    remote or other.  The body starts at the message's first brace; a remote message
    without a body that names a code stands for itself."""
    kind, code, message = F.col("kind"), F.col("code"), F.col("message")
    worker = F.coalesce((kind == "remote") & (code != "function_not_found"), F.lit(False))
    start = F.instr(message, "{")
    parsed = df.withColumn(
        "_body", F.when(worker & (start > 0), _json(F.substr(message, start)))
    ).withColumn("_coded", _field(F.col("_body"), "$.code").isNotNull())
    named = _with_body_fields(parsed.withColumn("_body", F.when(F.col("_coded"), F.col("_body"))))
    text = (
        F.when(kind == "timeout", TIMED_OUT)
        .when(kind == "not_connected", NOT_CONNECTED)
        .when((kind == "remote") & ~worker, F.format_string(NOT_REGISTERED, message))
        .when(F.col("_coded"), _body_message(message))
        .otherwise(message)
    )
    return named.withColumns(
        {
            "error_kind": F.when(kind.isNotNull(), F.when(worker, "worker").otherwise("unavailable")),
            "error_code": F.when(worker, F.when(F.col("_coded"), F.col("_code")).otherwise(code)),
            "error_message": text,
        }
    ).drop("_body", "_coded", "_code", "_message")


def rollbacks(df: DataFrame, response: str = "response") -> DataFrame:
    """Errors hidden in successful transaction responses; all null where it committed."""
    parsed = df.withColumn("_response", _json(F.col(response)))
    committed = _field(F.col("_response"), "$.committed")
    refused = (F.schema_of_variant(committed) == "BOOLEAN") & ~committed.cast("boolean")
    judged = parsed.withColumn("_refused", F.coalesce(refused, F.lit(False)))
    outer = _index(F.col("_response"), "$.failed_index")
    inner = F.when(F.col("_refused"), _field(F.col("_response"), "$.error"))
    named = _with_body_fields(judged.withColumn("_body", inner))
    failed = F.col("_refused")
    return named.withColumns(
        {
            "error_kind": F.when(failed, "worker"),
            "error_code": F.col("_code"),
            "error_message": F.when(failed, _body_message(F.lit(ROLLED_BACK))),
            "failed_index": F.when(failed, F.coalesce("failed_index", outer)),
        }
    ).drop("_response", "_refused", "_body", "_code", "_message")


def for_callers(df: DataFrame) -> DataFrame:
    """Add caller_code and caller_message: how an error shows outside a run."""
    rejected = (F.col("error_kind") == "worker") & F.col("error_code").isin(*CONFIG_CODES)
    message = F.col("error_message")
    return df.withColumns(
        {
            "caller_code": F.when(rejected, CONFIG_ERROR).otherwise(WORKER_UNAVAILABLE),
            "caller_message": F.when(F.col("error_kind") == "unavailable", message)
            .when(rejected, F.concat(F.lit(REJECTED), message))
            .otherwise(F.concat(F.lit(CALL_FAILED), message)),
        }
    )


def statement_index(failed_index: Column, offset: Column, batch_len: Column) -> Column:
    """Index within the script; null for the preamble and for the closing ledger insert."""
    inside = (failed_index >= offset) & (failed_index + 1 < batch_len)
    return F.when(inside, failed_index - offset)
