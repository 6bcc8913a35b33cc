"""lakehook: an event-triggered data lake expressed as Spark DataFrame operators.

Datasets of files are described by catalog DataFrames (users, datasets, files,
transforms, event log, lifecycle rules). Changes land in an append-only event
log; registered SQL or Python transforms run over the files that matching
events point at, and their results are written back as Parquet.

Sub-packages:
  functions  -- column expressions (scalars, predicate compiler)
  operators  -- DataFrame -> DataFrame operators (lookups, matching, mutation,
                lifecycle, quality checks)
  sources    -- scans and sinks (Parquet, CSV, dataset scans, event-log append)
  plans      -- transforms, batch dispatch, and the lake views derived from the
                test tables
  streaming  -- Structured Streaming dispatch of new events
"""

from lakehook.session import build_session, scratch_path

__all__ = ["build_session", "scratch_path"]
