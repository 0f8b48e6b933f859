"""Ingest verdicts, as exceptions with the stable codes that verdict columns use too."""

from __future__ import annotations


class IngestError(Exception):
    code = "ingestion_error"


class UnsupportedFormat(IngestError):
    code = "unsupported_format"


class FileTooLarge(IngestError):
    code = "file_too_large"


class LimitExceeded(IngestError):
    code = "dataset_limit_exceeded"


class Malformed(IngestError):
    code = "malformed_dataset"


class EmptyDataset(IngestError):
    code = "empty_dataset"


class SheetNotFound(IngestError):
    code = "sheet_not_found"


_BY_CODE = {
    kind.code: kind for kind in (UnsupportedFormat, FileTooLarge, LimitExceeded, Malformed, EmptyDataset, SheetNotFound)
}


def raise_for(code: str, detail: str) -> None:
    raise _BY_CODE.get(code, IngestError)(detail)
