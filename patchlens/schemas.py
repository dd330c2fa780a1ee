"""Explicit schemas of every table the library reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LINE = _struct(line_no=T.IntegerType(), text=T.StringType())

COMMITS = _struct(
    commit_hash=T.StringType(),
    project_url=T.StringType(),
    msg=T.StringType(),
    parents=T.ArrayType(T.StringType()),
    committed_at=T.TimestampType(),
)

FILE_CHANGES = _struct(
    commit_hash=T.StringType(),
    new_path=T.StringType(),
    deleted=T.ArrayType(LINE),
    added=T.ArrayType(LINE),
    source_before=T.StringType(),
    source_after=T.StringType(),
)

# Exports of several repositories: the branches of a commit, the project and former path of a file.
EXPORTED_COMMITS = T.StructType([*COMMITS.fields, *_struct(branches=T.ArrayType(T.StringType())).fields])
EXPORTED_FILE_CHANGES = T.StructType(
    [
        *_struct(project_url=T.StringType(), filename=T.StringType(), old_path=T.StringType()).fields,
        *FILE_CHANGES.fields,
    ]
)

CHANGES = _struct(
    project=T.StringType(),
    commit_hash=T.StringType(),
    file_path=T.StringType(),
    buggy_change=T.StringType(),
    fixed_change=T.StringType(),
    buggy_label=T.DoubleType(),
    fixed_label=T.DoubleType(),
)

SOURCE_PAIRS = _struct(
    project=T.StringType(),
    commit_hash=T.StringType(),
    file_path=T.StringType(),
    buggy_code=T.StringType(),
    fixed_code=T.StringType(),
)

LABELLED_DIFFS = _struct(
    diff_text=T.StringType(),
    added_loc=T.IntegerType(),
    removed_loc=T.IntegerType(),
    lint_warnings=T.IntegerType(),
    label=T.IntegerType(),
)

FINDING = _struct(
    line=T.IntegerType(),
    severity=T.StringType(),
    message=T.StringType(),
    source=T.StringType(),
)

FINDINGS = T.ArrayType(FINDING)

REPORTS = _struct(
    report_id=T.StringType(),
    repo=T.StringType(),
    pr=T.LongType(),
    head_sha=T.StringType(),
    filename=T.StringType(),
    issues=FINDINGS,
    code=T.StringType(),
)

# A flagged section for which an analyzer failed.
FAILED = _struct(
    report_id=T.StringType(),
    repo=T.StringType(),
    pr=T.LongType(),
    head_sha=T.StringType(),
    pos=T.IntegerType(),
    filename=T.StringType(),
    failures=T.ArrayType(T.StringType()),
)

# One <file> element of a lint report; "_x" is how Spark names XML attributes.
LINT_FILE = _struct(
    _name=T.StringType(),
    error=T.ArrayType(
        _struct(
            _line=T.StringType(),
            _severity=T.StringType(),
            _message=T.StringType(),
            _source=T.StringType(),
        )
    ),
)

WEBHOOK_BODY = _struct(
    action=T.StringType(),
    pull_request=_struct(number=T.LongType(), head=_struct(sha=T.StringType())),
    repository=_struct(full_name=T.StringType()),
)

WEBHOOK_EVENTS = _struct(
    event_id=T.LongType(),
    received_at=T.TimestampType(),
    event_type=T.StringType(),
    body=T.StringType(),
    signature=T.StringType(),
)

EMBEDDINGS = _struct(key=T.StringType(), embedding=T.ArrayType(T.FloatType()))
