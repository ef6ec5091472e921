"""Sources and sinks: readers and writers by address scheme, and drops that hold payloads."""

from .stores import open_source, sink  # noqa: F401
