"""Sources and sinks: driver tables, file corpora, mapping store, log sink,
session payloads, attachments."""
