"""Tables of the engine.

Every replica keeps application tables, and one generic store in which each
record is a JSON text with version columns. Vectors (who has seen which counter
of whom) are tables with a row for each entry.
"""

from __future__ import annotations

from pyspark.sql import types as T

_RECORD = (
    "profile string, model_name string, partition string, source_id string, serialized string, deleted boolean, hard_deleted boolean, "
    "last_saved_instance string, last_saved_counter int, conflicting_serialized_data string, self_ref_fk string"
)


_TYPES = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "timestamp": T.TimestampType()}


def _schema(text: str) -> T.StructType:
    """Column names and types; unlike fromDDL it needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in map(str.split, text.split(","))])


#: Columns that a stored record and a transferred one have in common.
RECORD = _schema(_RECORD)
STORE = _schema(f"id string, {_RECORD}, dirty_bit boolean, deserialization_error string, last_transfer_session_id string")
BUFFER = _schema(f"transfer_session_id string, model_uuid string, {_RECORD}")
#: Record vectors: the greatest counter of an instance that a record has seen.
RMC = _schema("id string, instance_id string, counter int")
RMCB = _schema("transfer_session_id string, model_uuid string, instance_id string, counter int")
#: Database vectors: all records under a partition are held up to the counter.
DMC = _schema("partition string, instance_id string, counter int")
#: Ids of records deleted from application tables since the last capture.
DELETED = _schema("id string, profile string")
SYNC_SESSIONS = _schema("id string, active boolean, last_activity timestamp, client_instance_id string, server_instance_id string, profile string")
TRANSFER_SESSIONS = _schema("id string, sync_session_id string, active boolean, last_activity timestamp, filter string, push boolean, records_total long, records_transferred long, stage string, status string")

#: A transfer as it is kept between its stages, and what its sides have ("sent", "had"), a row for each entry.
TRANSFERS = _schema("id string, filter string, push boolean, page int, stage string, status string, records_total long, records_transferred long")
TRANSFER_VECTORS = _schema("transfer_session_id string, vector string, side string, partition string, instance_id string, counter int")
#: Who a replica is: a single row.
IDENTITY = _schema("profile string, instance_id string, counter int")

RECORD_COLUMNS = RECORD.fieldNames()
#: Bookkeeping columns on each row of an application table.
DIRTY, SOURCE, PARTITION = "_dirty", "_source_id", "_partition"
