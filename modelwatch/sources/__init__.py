"""Sources and sinks: driver tables, bindings to fixture shapes, table I/O."""
