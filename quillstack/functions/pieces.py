"""Results of an Arrow step in small pieces: a task holds a batch as it came, one row's values and a piece, not the whole batch's results."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

# Fixed value: about so many characters or bytes of results wait before they are sent on.
PIECE = 4 << 20


def in_pieces(batches: Iterable[pa.RecordBatch], inputs: list[str], make: Callable, added: pa.Schema, kept: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """The columns `kept` (None: all) with those of `added`, one tuple make(*inputs) per row; every row comes once, in order."""
    for batch in batches:
        rest = batch if kept is None else batch.select(kept)
        held, done = 0, []
        for at, row in enumerate(zip(*map(batch.column, inputs)), 1):
            done.append(make(*(x.as_py() for x in row)))
            held += sum(len(v) for v in done[-1] if isinstance(v, (str, bytes)))
            if held >= PIECE or at == batch.num_rows:
                made = [pa.array(c, f.type) for c, f in zip(zip(*done), added)]
                held, done = 0, []
                yield pa.RecordBatch.from_arrays([*rest.slice(at - len(made[0]), len(made[0])).columns, *made], [*rest.schema.names, *added.names])
                del made
