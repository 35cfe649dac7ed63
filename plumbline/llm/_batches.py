"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns, row by row; one batch is in memory at a time, a slice of it as Python values."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for start in range(0, batch.num_rows, 512):
            yield from zip(*(c.slice(start, 512).to_pylist() for c in columns), strict=True)


class Writer:
    """Gathers rows and hands them out as record batches of at most ``size`` rows or ``weight`` units."""

    def __init__(self, schema: pa.Schema, size: int = 4096, weight: int = 8 << 20):
        self.schema, self.size, self.weight = schema, size, weight
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, row: tuple, weight: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += weight
        if len(self.rows) >= self.size or self.held >= self.weight:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, self.schema, strict=True)]
            self.rows, self.held = [], 0
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)
