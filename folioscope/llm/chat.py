"""Conversations as training text with a loss mask per token.

A whole conversation is rendered, its turn spans noted, and encoded once with offsets; the
tokens of a span are found by binary search in the token offsets. Control strings are pre-tokens of their own,
so no token joins text and template: the masked tokens are the text, no more and no less.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

CHUNK_CHARS = 1 << 18  # rendered text encoded at once; one longer conversation is encoded alone


@dataclass(frozen=True)
class Template:
    """``open`` role ``middle`` text ``close`` per turn.

    A control string inside a text or a role gets a backslash after its first character, and
    one that already has backslashes there gets one more, so escaping can be undone and no
    text holds a control string.
    """

    open: str = "<s>"
    middle: str = "[INST]"
    close: str = "</s>"
    others: tuple = ("[/INST]", "<|endoftext|>")

    @property
    def controls(self):
        return (self.open, self.middle, self.close, *self.others)

    def _pattern(self, least):
        return re.compile("|".join(f"(?:{re.escape(c[0])}\\\\{{{least},}}{re.escape(c[1:])})" for c in self.controls))

    def escape(self, text):
        return self._pattern(0).sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text):
        return self._pattern(1).sub(lambda m: m[0][0] + m[0][2:], text)

    def render(self, turns):
        """The text of a conversation and the (start, end) of each turn's escaped text."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            head = self.open + self.escape(role) + self.middle
            body = self.escape(text)
            parts += [head, body, self.close]
            spans.append((at + len(head), at + len(head) + len(body)))
            at += len(head) + len(body) + len(self.close)
        return "".join(parts), spans

    def parse(self, text):
        """(role, text) of each turn of a rendered conversation."""
        turns, at = [], 0
        while at < len(text):
            if not text.startswith(self.open, at):
                raise ValueError(f"no turn begins at {at}")
            middle = text.index(self.middle, at + len(self.open))
            end = text.index(self.close, middle + len(self.middle))
            turns.append((self.unescape(text[at + len(self.open):middle]),
                          self.unescape(text[middle + len(self.middle):end])))
            at = end + len(self.close)
        return turns


def mask(starts, ends, spans):
    """True for the tokens that share a character with a span.

    ``starts`` and ``ends`` are the sorted token offsets; two searches per span.
    """
    out = np.zeros(len(starts), bool)
    for a, b in spans:
        if b > a:
            out[np.searchsorted(ends, a, side="right"):np.searchsorted(starts, b, side="left")] = True
    return out


def masked_texts(text, starts, ends, loss):
    """What each run of masked tokens covers. Spans are not looked at."""
    on = np.flatnonzero(loss)
    if not len(on):
        return []
    first = np.concatenate([[True], np.diff(on) > 1])
    last = np.concatenate([first[1:], [True]])
    return [text[a:b] for a, b in zip(starts[on[first]].tolist(), ends[on[last]].tolist())]


_loaded = {}


def tokenizer(path, controls):
    """The tokenizer of a file, with untrimmed offsets, that cuts at control strings first. They are plain text to it."""
    if (path, controls) not in _loaded:
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        found = Tokenizer.from_file(path)
        found.encode_special_tokens = True
        found.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex("|".join(re.escape(c) for c in controls)), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)])
        _loaded[path, controls] = found
    return _loaded[path, controls]


def conversations(turns, id_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
    """One row per conversation with its turns in order.

    Ordered by turn, equal turns by role and text; a null turn comes first; null role and text are empty.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return turns.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


FORMATTED = "id {kind}, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>, spans array<struct<role:string,start:int,end:int>>"


def formatted(turns, tokenizer_path, template=Template(), loss_roles=("assistant",), **columns):
    """Each conversation rendered and encoded: text, token ids, offsets, loss mask, turn spans.

    Offsets count code points. A conversation of any length is encoded whole. Repeated rows are repeated turns; rows with a null id
    form one conversation; empty texts have empty spans and no masked token; an empty table
    gives an empty one; other columns are not read. The tokenizer file must be readable on
    every executor, as any installed package is.
    """
    whole = conversations(turns, **columns)
    kind = whole.schema["id"].dataType.simpleString()
    schema = FORMATTED.format(kind=kind)

    def emit(ids, rendered):
        encoded = tokenizer(tokenizer_path, template.controls).encode_batch([t for t, _, _ in rendered], add_special_tokens=False)
        out = {"ids": [], "starts": [], "ends": [], "loss": [], "spans": []}
        for (text, spans, roles), e in zip(rendered, encoded):
            offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
            starts, ends = np.ascontiguousarray(offsets[:, 0]), np.ascontiguousarray(offsets[:, 1])
            out["ids"].append(np.array(e.ids, np.int32))
            out["starts"].append(starts)
            out["ends"].append(ends)
            out["loss"].append(mask(starts, ends, [s for s, r in zip(spans, roles) if r in loss_roles]))
            out["spans"].append([{"role": r, "start": a, "end": b} for (a, b), r in zip(spans, roles)])
        span = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array([t for t, _, _ in rendered], pa.string()),
             *[pa.array(out[k], pa.list_(pa.int32())) for k in ("ids", "starts", "ends")],
             pa.array(out["loss"], pa.list_(pa.bool_())), pa.array(out["spans"], span)],
            names=["id", "formatted", "ids", "starts", "ends", "loss", "spans"])

    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)

    def run(batches):
        for rows in batches:
            ids, rendered, size = [], [], 0
            for id_, cell in zip(rows.column(0).to_pylist(), rows.column(1)):
                turns = cell.as_py()
                text, spans = template.render([(t["role"], t["text"]) for t in turns])
                ids.append(id_)
                rendered.append((text, spans, [t["role"] for t in turns]))
                size += len(text)
                if size >= CHUNK_CHARS:
                    yield emit(pa.array(ids, id_type), rendered)
                    ids, rendered, size = [], [], 0
            if ids:
                yield emit(pa.array(ids, id_type), rendered)

    return whole.mapInArrow(run, schema)


def read_back(rows, template=Template()):
    """What the formatted text and the mask hold: id, turns, and the unescaped loss texts.

    Turns come from parsing the text; loss texts are what the runs of masked tokens cover. An empty text has no token and is not listed.
    """
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, turns array<struct<role:string,text:string>>, loss_texts array<string>, formatted_chars long"

    def run(batches):
        for batch in batches:
            turns, texts, chars = [], [], []
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("formatted", "starts", "ends", "loss")]
            for text, starts, ends, loss in zip(*columns):  # row by row: tokens stay in arrays
                text = text.as_py()
                starts, ends, loss = (x.values.to_numpy(zero_copy_only=False) for x in (starts, ends, loss))
                turns.append([{"role": a, "text": b} for a, b in template.parse(text)])
                texts.append([template.unescape(t) for t in masked_texts(text, starts, ends, loss)])
                chars.append(len(text))
            turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("id")), pa.array(turns, turn), pa.array(texts, pa.list_(pa.string())), pa.array(chars, pa.int64())],
                names=["id", "turns", "loss_texts", "formatted_chars"])

    return rows.mapInArrow(run, schema)
