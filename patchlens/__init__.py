"""patchlens: source-change risk analytics as Spark jobs.

Commit, diff and pull-request tables (or streams) go in; labelled corpora,
feature tables, fitted classifiers, findings and review reports come out.
Functions take and return DataFrames; the helpers in ``patchlens.functions``
take and return Columns.
"""

__version__ = "0.1.0"
