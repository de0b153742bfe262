"""vigilo — Spark-native analytics for labelled adverse-event reports.

Every public function takes DataFrames (or a session plus a data folder)
and returns a lazy DataFrame; Catalyst plans the work, executors do it.

Sub-packages
------------
sources    scans of the input tables, CSV, result tables, model persistence
functions  column expressions (cleaning, rounding, names, labels)
operators  relational building blocks (reshape, sampling, exploration,
           evaluation, attribution) plus the distributed helpers they share
plans      end-to-end jobs: sample assembly, feature preparation, models,
           what-if scoring, result upsert
streaming  the reference has no streaming input; see its docstring
"""

__all__ = ["session"]
