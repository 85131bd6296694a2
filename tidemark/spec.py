"""Targets and pipelines as plain data."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

MARKER = "/*WM*/"
TIMESTAMP, NUMBER = "TIMESTAMP", "NUMBER"


@dataclass(frozen=True)
class Clause:
    """One WHEN of a merge.  ``when``: matched or not_matched; ``do``: update, delete or
    insert; ``condition`` and the values of ``columns`` are SQL over ``tgt`` and ``src``.
    Without ``columns`` an update or insert takes every column of the source."""

    when: str
    do: str
    condition: str | None = None
    columns: dict[str, str] | None = None


UPSERT = (Clause("matched", "update"), Clause("not_matched", "insert"))


@dataclass(frozen=True)
class TargetSpec:
    """A declarative load: what to read, how far it was read, and where it goes."""

    name: str
    sourceQuery: str
    targetTable: str
    watermarkColumn: str
    keyColumns: tuple[str, ...]
    watermarkType: str = TIMESTAMP
    initialWm: str = "1970-01-01 00:00:00"
    stagingTable: str = ""
    insertColumns: tuple[str, ...] = ()
    merge: tuple[Clause, ...] = UPSERT
    #: Columns that a merge joins by, where these are not the ``keyColumns`` of the pages.
    mergeKeys: tuple[str, ...] = ()
    #: Instead of ``insertColumns``, and of ``merge`` and ``mergeKeys``: INSERT and MERGE texts.
    targetInsert: str = ""
    targetMerge: str = ""
    pageSize: int | None = None
    lookbackMinutes: int | None = None
    group: int | None = None
    #: Types of staged columns that the source has as text, and the session formats that read them.
    types: dict[str, str] = field(default_factory=dict)
    formats: dict[str, str] = field(default_factory=dict)
    #: "watermark": a stopped run goes on after the last watermark, rows tied with it are
    #: left to the lookback; "tuple": it goes on after the last row.
    resume: str = "watermark"
    #: Never store a watermark below the stored one.
    monotonic: bool = False
    #: None: repeated keys in a page are an error; "latest": the last in page order counts.
    dedupe: str | None = None
    #: Parts of the target by a hash of its keys, at least; a merge rewrites those that it touches.
    buckets: int = 16
    #: What new and wider columns of the source do: "evolve" the target, or fail the run ("fixed").
    schema: str = "evolve"

    #: "grow": pages of plain upserts are merged together until they have as many rows as the
    #: target, so a load's cost follows its rows; "page": each page is a merge and a version.
    publish: str = "grow"

    @property
    def joined_by(self) -> tuple[str, ...]:
        return self.mergeKeys or self.keyColumns


@dataclass(frozen=True)
class PipelineSpec:
    targets: tuple[TargetSpec, ...]


_REQUIRED = [f.name for f in dataclasses.fields(TargetSpec) if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
_KNOWN = {f.name for f in dataclasses.fields(TargetSpec)}
#: Fields of texts to the fields that they stand for; other names of fields.
_TEXTS = {"targetInsert": ("insertColumns",), "targetMerge": ("merge", "mergeKeys")}
_OTHER_NAMES = {"nlsSettings": "formats"}


def target(data: dict) -> TargetSpec:
    """A target from decoded JSON; unknown and missing fields are errors."""
    data = {_OTHER_NAMES.get(k, k): v for k, v in data.items()}
    if unknown := sorted(set(data) - _KNOWN):
        raise ValueError(f"unknown field {', '.join(unknown)}")
    if missing := [n for n in _REQUIRED if n not in data]:
        raise ValueError(f"missing field {', '.join(missing)}")
    data = dict(data)
    for text, parts in _TEXTS.items():
        if data.get(text) and (both := [p for p in parts if p in data]):
            raise ValueError(f"{text} stands for {', '.join(both)}: not both")
    for name in ("keyColumns", "insertColumns", "mergeKeys"):
        data[name] = tuple(data.get(name, ()))
    if "merge" in data:
        data["merge"] = tuple(Clause(**c) for c in data["merge"])
    return TargetSpec(**data)


def load(text: str) -> PipelineSpec:
    data = json.loads(text)
    if set(data) != {"targets"}:
        raise ValueError("a pipeline has one field, targets")
    return PipelineSpec(tuple(map(target, data["targets"])))
