"""Sequential searches as Arrow-batched kernels: a text in, any number of rows out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a result that go back at once, and characters of the texts that a kernel prepares at once.
ROWS, PORTION = 1_000, 65_536


def each_text(rows: DataFrame, schema: str | T.StructType, func: Callable[[str], Iterable[tuple]], text: str = "text", keep: list[str] | None = None, prepare: Callable[[list[str]], list] | None = None) -> DataFrame:
    """The columns keep of rows (all but the text, if not told), and the columns that func gives for each text.

    A null text counts as empty. A column of rows with the name of a result is replaced. With prepare, func gets
    what that makes of each text; it is given several texts, of PORTION characters together or one longer one.
    """
    made = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [x for x in (keep if keep is not None else [c for c in rows.columns if c != text]) if x not in made.names]
    source = rows.select(*dict.fromkeys([*names, text]))
    at = [source.columns.index(x) for x in names]
    types = [f.type for f in to_arrow_schema(made)]

    def prepared(values: Iterable[str]) -> Iterator:
        held, size = [], 0
        for value in values:
            if held and size + len(value) > PORTION:
                yield from prepare(held)
                held, size = [], 0
            held.append(value)
            size += len(value)
        if held:
            yield from prepare(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch: pa.RecordBatch, index: list[int], found: list[tuple]) -> pa.RecordBatch:
            kept = [pc.take(batch.column(k), pa.array(index, pa.int64())) for k in at]
            columns = zip(*found, strict=True) if found else [()] * len(types)
            return pa.RecordBatch.from_arrays([*kept, *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=[*names, *made.names])

        for batch in batches:
            index: list[int] = []
            found: list[tuple] = []
            values = (x.as_py() or "" for x in batch.column(batch.schema.get_field_index(text)))
            for k, value in enumerate(values if prepare is None else prepared(values)):
                for row in func(value):
                    index.append(k)
                    found.append(row)
                if len(found) >= ROWS:
                    yield out(batch, index, found)
                    index, found = [], []
            yield out(batch, index, found)

    return source.mapInArrow(run, T.StructType([*(source.schema.fields[k] for k in at), *made.fields]))
