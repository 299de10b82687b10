"""The stage graph: each stage keeps its result under the work directory and is skipped once it is there."""
