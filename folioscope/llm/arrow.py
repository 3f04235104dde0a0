"""Running NumPy work over the texts of a table, a few megabytes at a time."""

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20  # texts handled at once; one longer text is handled alone
SMALL_BYTES = 512 << 10  # the same for work that takes some 60 times its texts' size: a Python worker keeps what it once took


class Texts:
    """The texts of some rows as one byte array. A null text is empty."""

    def __init__(self, column):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        self.n = len(column)
        buffers = column.buffers()
        kind = np.int64 if wide else np.int32
        if self.n == 0 or buffers[1] is None:
            self.offsets = np.zeros(self.n + 1, np.int64)
            self.data = np.zeros(0, np.uint8)
            return
        at = np.frombuffer(buffers[1], kind)[column.offset:column.offset + self.n + 1].astype(np.int64)
        raw = np.zeros(0, np.uint8) if buffers[2] is None else np.frombuffer(buffers[2], np.uint8)
        self.data, self.offsets = raw[at[0]:at[-1]], at - at[0]
        if column.null_count:
            # A null has no bytes in the arrays that Spark sends, but need not have none.
            valid = np.asarray(column.is_valid())
            sizes = np.diff(self.offsets)
            if sizes[~valid].any():
                self.data = self.data[np.repeat(valid, sizes)]
                self.offsets = np.concatenate([[0], np.cumsum(np.where(valid, sizes, 0))])

    @property
    def sizes(self):
        return np.diff(self.offsets)

    def rows(self):
        """The row of each byte."""
        return np.repeat(np.arange(self.n), self.sizes)

    def sums(self, per_byte):
        """Sum of a value per byte over each text."""
        total = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def pieces(batch, text, limit=CHUNK_BYTES):
    """Slices of a record batch that hold up to ``limit`` bytes of text, or one row."""
    sizes = Texts(batch.column(text)).sizes
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def over_texts(df, text, work, schema, limit=CHUNK_BYTES):
    """``work(piece) -> RecordBatch or None`` over pieces of all rows."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for piece in pieces(batch, text, limit):
                    out = work(piece)
                    if out is not None:
                        yield out

    return df.mapInArrow(run, schema)


def batch(**columns):
    return pa.RecordBatch.from_pydict(columns)
