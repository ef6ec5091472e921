"""The data model: status enumerations and the schemas of graphs, events and payloads."""

from __future__ import annotations

from enum import IntEnum


class DropState(IntEnum):
    INITIALIZED, WRITING, COMPLETED, ERROR, EXPIRED, DELETED, CANCELLED, SKIPPED = range(8)


class ExecState(IntEnum):
    NOT_RUN, RUNNING, FINISHED, ERROR, CANCELLED, SKIPPED = range(6)


class Phase(IntEnum):
    PLASMA, GAS, SOLID, LIQUID, LOST = range(5)


class SessionState(IntEnum):
    PRISTINE, BUILDING, DEPLOYING, RUNNING, FINISHED, CANCELLED, FAILED = range(7)


class ReproMode(IntEnum):
    ALL = -1
    NOTHING = 0
    RERUN = 1
    REPEAT = 2
    RECOMPUTE = 4
    REPRODUCE = 5
    REPLICATE_SCI = 6
    REPLICATE_COMP = 7
    REPLICATE_TOTAL = 8
    EXPERIMENTAL = 9


#: Codes of a write that did not happen.
CANCELLED_WRITE, NOT_WRITABLE, NOT_BINARY = -1, -2, -3

#: States from which a drop may go to another: (from, to).
TRANSITIONS = {
    (DropState.INITIALIZED, DropState.WRITING), (DropState.INITIALIZED, DropState.COMPLETED), (DropState.INITIALIZED, DropState.ERROR), (DropState.INITIALIZED, DropState.SKIPPED), (DropState.INITIALIZED, DropState.CANCELLED),
    (DropState.WRITING, DropState.COMPLETED), (DropState.WRITING, DropState.ERROR), (DropState.WRITING, DropState.CANCELLED), (DropState.COMPLETED, DropState.EXPIRED), (DropState.EXPIRED, DropState.DELETED), (DropState.COMPLETED, DropState.DELETED),
}

NODES_DDL = (
    "session_id STRING, oid STRING, uid STRING, lg_key STRING, iid ARRAY<INT>, loop_ctx ARRAY<INT>, name STRING, category STRING, category_type STRING, weight BIGINT, num_cpus INT, rank ARRAY<INT>, "
    "node STRING, island STRING, params MAP<STRING,STRING>, n_effective_inputs INT, input_error_threshold INT, n_tries INT, block_skip BOOLEAN, persist BOOLEAN, expire_after_use BOOLEAN, expiration_date DOUBLE, rmode INT"
)
EDGES_DDL = "session_id STRING, src STRING, dst STRING, rel STRING, port STRING, weight BIGINT, is_stream BOOLEAN"
EVENTS_DDL = "session_id STRING, ts TIMESTAMP, uid STRING, event_type STRING, status INT"
PAYLOAD_DDL = "session_id STRING, uid STRING, seq BIGINT, chunk BINARY"

DATA_CATEGORIES = ("Data", "File", "Memory", "SharedMemory", "S3", "NGAS", "Directory", "NULL", "EndNode", "json", "ParameterSet", "PythonObject", "RDBMS", "Plasma")
GROUP_CATEGORIES = ("Scatter", "Gather", "GroupBy", "Loop", "MKN", "SubGraph")
