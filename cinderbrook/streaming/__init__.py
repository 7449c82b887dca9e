"""Structured Streaming counterparts of the batch ingest operators; additions, as batch is what the library is modelled on."""
