"""Micro-batch adapter: apply the batch operators to files as they arrive.

The original application only ever processes a whole uploaded file, so no
streaming operator exists; this adapter lets a deployment run the same batch
functions per arriving batch of files with exactly-once file tracking from
Structured Streaming's checkpoint.
"""

from ledgerlens.streaming.filedrop import run_on_new_files

__all__ = ["run_on_new_files"]
