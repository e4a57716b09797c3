"""Kafka messages as rows: reading, writing, and (de)serialising with what fails kept apart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sinks import KafkaSink
from ..sources import KafkaSource
from ..stream import ORDER, Flow, Stream, operator
from . import stateless


@dataclass(frozen=True)
class KafkaOpOut:
    """Messages that were read, and those that failed as they came, with the column err."""

    oks: Stream
    errs: Stream


Codec = Callable[[Column], Column]


def json_deserializer(ddl: str) -> Codec:
    """Bytes to a struct of the given columns; null where they aren't JSON of that form."""
    return lambda c: F.from_json(c.cast("string"), ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})


def json_serializer() -> Codec:
    return lambda c: F.to_json(c).cast("binary")


def avro_deserializer(schema: str) -> Codec:
    """Bytes to what an Avro schema says; needs Spark's Avro module on the class path."""
    from pyspark.sql.avro.functions import from_avro

    return lambda c: from_avro(c, schema, {"mode": "PERMISSIVE"})


def avro_serializer(schema: str) -> Codec:
    from pyspark.sql.avro.functions import to_avro

    return lambda c: to_avro(c, schema)


@operator
def input(step_id: str, flow: Flow, *, brokers: list[str], topics: list[str], tail: bool = True, starting_offset: str = "earliest", add_config: dict[str, str] | None = None, batch_size: int | None = None) -> KafkaOpOut:  # noqa: A001
    """Messages of topics. Read errors stop Spark's source, so errs has rows only if later steps put them there."""
    up = stateless.input("input", flow, KafkaSource(brokers, topics, tail, starting_offset, add_config or {}, batch_size))
    return KafkaOpOut(up, up.with_df(up.df.withColumn("err", F.lit(None).cast("string")).filter(F.lit(False))))


@operator
def output(step_id: str, up: Stream, *, brokers: list[str], topic: str | None = None, add_config: dict[str, str] | None = None) -> None:
    """Writes key, value, headers and, if there is one, topic."""
    KafkaSink(brokers, topic, add_config or {}).rows(up.df)
    stateless.output("output", up, KafkaSink(brokers, topic, add_config or {}))


def _decoded(up: Stream, codecs: dict[str, Codec]) -> KafkaOpOut:
    made = {f"_{c}": codec(F.col(c)) for c, codec in codecs.items()}
    df = up.df.withColumns(made)
    bad = F.lit(False)
    for c in codecs:
        kind = df.schema[f"_{c}"].dataType
        empty = F.col(f"_{c}").isNull()
        if hasattr(kind, "names") and kind.names:  # from_json gives a struct of nulls for what it can't parse
            nothing = F.lit(True)
            for n in kind.names:
                nothing = nothing & F.col(f"_{c}")[n].isNull()
            empty = empty | nothing
        bad = bad | (F.col(c).isNotNull() & empty)
    rest = [c for c in up.df.columns if c not in codecs]
    good = df.filter(~bad).select(*(F.col(f"_{c}").alias(c) for c in codecs), *rest)
    message = F.concat_ws(", ", *(F.when(F.col(c).isNotNull() & F.col(f"_{c}").isNull(), F.lit(f"{c} can't be deserialised")) for c in codecs))
    failed = df.filter(bad).select(*up.columns, F.when(message == "", "can't be deserialised").otherwise(message).alias("err"), *(c for c in ORDER if c in df.columns))
    return KafkaOpOut(up.with_df(good), up.with_df(failed))


@operator
def deserialize_key(step_id: str, up: Stream, deserializer: Codec) -> KafkaOpOut:
    """Keys from bytes; a message whose key fails goes to errs unchanged."""
    return _decoded(up, {"key": deserializer})


@operator
def deserialize_value(step_id: str, up: Stream, deserializer: Codec) -> KafkaOpOut:
    """Values from bytes; a message whose value fails goes to errs unchanged."""
    return _decoded(up, {"value": deserializer})


@operator
def deserialize(step_id: str, up: Stream, *, key_deserializer: Codec, val_deserializer: Codec) -> KafkaOpOut:
    """Keys and values from bytes."""
    return _decoded(up, {"key": key_deserializer, "value": val_deserializer})


def _encoded(up: Stream, codecs: dict[str, Codec]) -> Stream:
    return up.with_df(up.df.withColumns({c: codec(F.col(c)) for c, codec in codecs.items()}))


@operator
def serialize_key(step_id: str, up: Stream, serializer: Codec) -> Stream:
    """Keys to bytes."""
    return _encoded(up, {"key": serializer})


@operator
def serialize_value(step_id: str, up: Stream, serializer: Codec) -> Stream:
    """Values to bytes."""
    return _encoded(up, {"value": serializer})


@operator
def serialize(step_id: str, up: Stream, *, key_serializer: Codec, val_serializer: Codec) -> Stream:
    """Keys and values to bytes."""
    return _encoded(up, {"key": key_serializer, "value": val_serializer})
