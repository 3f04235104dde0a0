"""Batch encoders: text or image bytes to vectors, through an injected model.

``make_predict`` is a function without arguments. It runs once per Python worker,
loads whatever model the caller uses and returns ``predict(batch) -> matrix``.
"""

import uuid
from collections import OrderedDict

from pyspark.sql import functions as F, types as T


ALL_FAILED = 16  # so many inputs of one batch that all fail are the model's fault
MODELS_KEPT = 4  # in a Python worker; a build uses three
_models = OrderedDict()


def _model(name, make):
    """The model of an encoder, made once per Python worker; the ones that were used last are kept."""
    if name not in _models:
        _models[name] = make()
    _models.move_to_end(name)
    while len(_models) > MODELS_KEPT:
        _models.popitem(last=False)
    return _models[name]


def guarded(make_predict, width):
    """Let a failing row cost only itself: it becomes a zero vector.

    A missing input is a zero vector without asking the model. A batch that fails as a whole
    is retried row by row; where a whole batch of inputs fails even so, the model is broken
    and the job ends with its error, as it does when the model cannot be made.
    """

    def make():
        import numpy as np

        predict = make_predict()

        def run(batch):
            out = np.zeros((len(batch), width), dtype=np.float32)
            there = np.array([i for i in range(len(batch)) if batch[i] is not None], dtype=np.int64)
            if not len(there):
                return out
            try:
                out[there] = np.asarray(predict(batch[there]), dtype=np.float32).reshape(len(there), width)
            except Exception as problem:
                failed = 0
                for i in there:
                    try:
                        out[i] = np.asarray(predict(batch[i:i + 1]), dtype=np.float32).reshape(width)
                    except Exception:
                        failed += 1
                if failed == len(there) >= ALL_FAILED:
                    raise RuntimeError(f"the model fails on every input: {type(problem).__name__}: {problem}") from problem
            return out

        return run

    return make


def strict(make_predict, width):
    """For texts, which have no reason to fail: a failure ends the job. Null is a zero vector."""

    def make():
        import numpy as np

        predict = make_predict()

        def run(batch):
            out = np.zeros((len(batch), width), dtype=np.float32)
            there = np.array([i for i in range(len(batch)) if batch[i] is not None], dtype=np.int64)
            if len(there):
                out[there] = np.asarray(predict(batch[there]), dtype=np.float32).reshape(len(there), width)
            return out

        return run

    return make


def encoder(make_predict, width, batch_size=256, failures="zero"):
    """A function ``Column -> Column`` (array of float) around the model.

    ``failures``: ``zero`` makes a failing row a zero vector, for images, whose files may be
    damaged; ``raise`` ends the job, for texts. ``sources.vectors.failures`` counts the former.
    It is declared nondeterministic, which stops the optimizer from copying the call into
    a filter or a second projection: each row is encoded once.

    Encoders of one projection share a Python worker and its Arrow batch: an iterator function
    would have a worker and a batch each, all at a time in every task. The inputs of ``batch_size``
    rows are Python objects at once.
    """
    import pyarrow as pa

    guard = {"zero": guarded, "raise": strict}[failures](make_predict, width)
    name = uuid.uuid4()

    def predict(column: pa.Array) -> pa.Array:
        import numpy as np

        model = _model(name, guard)
        out = np.empty((len(column), width), dtype=np.float32)
        for start in range(0, len(column), batch_size):
            inputs = column.slice(start, batch_size).to_pylist()
            batch = np.empty(len(inputs), dtype=object)
            batch[:] = inputs
            out[start:start + len(batch)] = model(batch)
        ends = np.arange(0, out.size + 1, width, dtype=np.int32)
        return pa.ListArray.from_arrays(ends, out.ravel())

    return F.arrow_udf(predict, T.ArrayType(T.FloatType())).asNondeterministic()


def hashed_words(width, cache_size=1 << 18):
    """A model stand-in that needs no weights: a hashed bag of words.

    A word's slot is the first 32 bits of its MD5 modulo ``width``; the vector holds
    the word counts per slot. Counts are whole numbers, so nothing is lost in float;
    search and build bring vectors to unit length.
    """

    def make():
        import hashlib
        import re

        import numpy as np

        find = re.compile(r"\w{2,}").findall
        is_word = re.compile(r"\w+").fullmatch
        # bytes that part words; those of other code points than ASCII's are looked at when a piece is met first
        parted = bytes(c if c > 127 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
        short, mixed = width, width + 1

        def slot_of(word):
            return int(hashlib.md5(word).hexdigest()[:8], 16) % width

        class Slots(dict):
            """Slots of pieces seen before; emptied when it has grown too large. ``short``: one code point, no word;
            ``mixed``: other than a word."""

            def __missing__(self, piece):
                if len(self) >= cache_size:
                    self.clear()
                text = piece.decode("utf-8")
                slot = mixed if is_word(text) is None else slot_of(piece) if len(text) > 1 else short
                self[piece] = slot
                return slot

        slots = Slots()

        def predict(texts):
            out = np.zeros((len(texts), width), dtype=np.float32)
            for i, text in enumerate(texts):
                pieces = text.lower().encode("utf-8").translate(parted).split() if text is not None else []
                if not pieces:
                    continue
                counts = np.bincount(np.fromiter(map(slots.__getitem__, pieces), np.int64, len(pieces)), minlength=width + 2)
                out[i] = counts[:width]
                if counts[mixed]:
                    for piece in pieces:
                        if slots[piece] == mixed:
                            for word in find(piece.decode("utf-8")):
                                out[i, slot_of(word.encode("utf-8"))] += 1
            return out

        return predict

    return make
