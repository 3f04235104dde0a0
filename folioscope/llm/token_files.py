"""Token ids in binary files that decode in parallel.

    path/blocks/*.ids   blocks of whole documents, in ascending id order over all files
    path/model          the frequency of every token, shared by all blocks
    path/manifest       one row per block: file, offset, length, ids before it; written last

Texts are tokenised once. The ids, sorted by document in ranges, go to one file per task, in
blocks of about 131,072 ids that ``ans`` codes; a longer document is one block. A
task that is run again writes a file of another name, and the manifest lists those of the
runs that counted, so a lost executor leaves at most files that nothing refers to. Files are opened through
``pyarrow.fs``, so the folder may be on any store that it knows.
"""

import io
import json
import os
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import functions as F, types as T

from . import ans, pretokens
from .arrow import over_texts
from .shared import stored

BLOCK_IDS = 131_072
TOGETHER = 16  # blocks that are coded side by side
FILE_IDS = 1 << 26  # ids per file, about 90 MB
TASK_IDS = 1 << 22  # ids that a reading task decodes
TEXT_BYTES = 512 << 10  # text tokenised at once
SEGMENT = ans.STEPS * ans.LANES


def _byte_level():
    """Code points 0 to 255 to the characters that stand for these bytes in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


BYTE_LEVEL = _byte_level()


def _load(path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _cuts_by_pattern(tokenizer):
    """Does this tokenizer do nothing before its merges but cut by the public pattern?"""
    parts = json.loads(tokenizer.to_str())
    cut = parts["pre_tokenizer"] or {}
    return (parts["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space"))


class _Encoder:
    """Ids of whole texts. Pre-tokens that repeat are asked from the library's model once; texts that hold a special token or code points
    that not all versions of Unicode know are asked whole."""

    def __init__(self, path, table):
        self.tokenizer = _load(path)
        self.special = [t["content"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]]
        self.model = self.tokenizer.model
        self.memory = pretokens.Memory(self._ask_model, table) if _cuts_by_pattern(self.tokenizer) else None

    def _ask(self, texts):
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask_model(self, pieces):
        """Ids of pre-tokens: there is nothing left to cut, so the merges are all that is asked."""
        merged = self.model.tokenize
        return [[x.id for x in merged(p.encode("utf-8").decode("latin-1").translate(BYTE_LEVEL))] for p in pieces]

    def __call__(self, texts):
        out = [None] * len(texts)
        whole = [self.memory is None or any(s in t for s in self.special) for t in texts]
        plain = [k for k, w in enumerate(whole) if not w]
        if plain:
            ids, sizes, odd = self.memory([texts[k] for k in plain])
            for k, strange, some in zip(plain, odd, np.split(ids, np.cumsum(sizes)[:-1])):
                out[k], whole[k] = some, strange
        asked = [k for k, w in enumerate(whole) if w]
        for k, ids in zip(asked, self._ask([texts[k] for k in asked])):
            out[k] = np.array(ids, np.uint32)
        return out


def _encoder(path, sent):
    """The encoder of this Python worker. It is kept where all tasks of a worker find it, since functions arrive anew with each task."""
    kept = vars(sys).setdefault("_encoders_of_this_worker", {})
    if path not in kept:
        kept.clear()
        kept[path] = _Encoder(path, sent.value)
    return kept[path]


def tokenized(docs, tokenizer_path, end_id=None, id_col="doc_id", text_col="text"):
    """(rows, kind): rows (id, n, ids) with the ids of each text, little-endian of 16 or 32 bits as ``kind`` says, ``end_id`` after the last.

    The ids are those of the tokenizer's library for the whole text, without added special tokens. A
    null text is empty. Rows are independent: repeated rows and rows with a null id each
    give a row. A text is encoded whole, whatever its length. Columns not named are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    wide = "<u2" if max(_load(tokenizer_path).get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else "<u4"
    tail = np.array([] if end_id is None else [end_id], wide)
    sent = docs.sparkSession.sparkContext.broadcast(pretokens.classes())  # one byte per code point

    def work(piece):
        found = _encoder(tokenizer_path, sent)([t or "" for t in piece.column(1).to_pylist()])
        ids = [np.concatenate([x.astype(wide), tail]) for x in found]
        return pa.RecordBatch.from_arrays(
            [piece.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["id", "n", "ids"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return over_texts(rows, 1, work, f"id {kind}, n long, ids binary", limit=TEXT_BYTES), wide


def _counted(tokens, wide):
    """(token, n) over all ids, summed up within tasks first."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for cell in b.column(0):
                raw = cell.as_buffer()
                if raw is not None and raw.size:
                    more = np.bincount(np.frombuffer(raw, wide))
                    if len(more) > len(total):
                        total, more = more.astype(np.int64), total
                    total[:len(more)] += more
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["token", "n"])

    return tokens.select("ids").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _index(ids, sizes):
    """The documents of a block as an Arrow stream."""
    sink = io.BytesIO()
    rows = pa.record_batch([ids, pa.array(sizes, pa.int64())], names=["id", "n"])
    with ipc.new_stream(sink, rows.schema, options=ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue()


MANIFEST = "shard int, file string, block long, offset long, length long, n_ids long, n_docs long, before long"


def write(tokens, path, wide="<u2"):
    """Write the rows (id, n, ids) of ``tokens`` in ascending id order to a new folder ``path``.

    Null ids come first; rows with one id are ordered by their ids' hash. A table without rows gives a
    manifest without rows. ``tokens`` is read several times: give a stored table.
    """
    spark = tokens.sparkSession
    totals = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # at most one row per token of the vocabulary
    counts = {r["token"]: r["n"] for r in _counted(tokens, wide).collect()}
    size = max(counts, default=-1) + 1
    freq = ans.frequencies([counts.get(i, 0) for i in range(size)])
    sent = spark.sparkContext.broadcast(freq.astype("<u4").tobytes())
    folder = f"{path}/blocks"
    files, where = fs.FileSystem.from_uri(folder)
    files.create_dir(where, recursive=True)

    def run(batches):
        model = ans.Model(np.frombuffer(sent.value, "<u4"))
        shard, name = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.ids"
        out, rows, offset, before = None, [], 0, 0
        ready, docs, sizes, ids, held = [], [], [], [], 0

        def closed():
            nonlocal docs, sizes, ids, held
            if docs:
                ready.append((np.concatenate(ids), _index(pa.concat_arrays(docs), sizes), len(sizes)))
            docs, sizes, ids, held = [], [], [], 0

        def flushed():
            nonlocal out, offset, before
            if not ready:
                return
            if out is None:
                out = fs.FileSystem.from_uri(folder)[0].open_output_stream(f"{where}/{name}")
            for (block, _, n), data in zip(ready, ans.encode([r[0] for r in ready], model, [r[1] for r in ready])):
                out.write(data)
                rows.append((shard, name, len(rows), offset, len(data), len(block), n, before))
                offset += len(data)
                before += len(block)
            ready.clear()

        for b in batches:
            names, cells = b.column(0), b.column(1)
            for k in range(b.num_rows):
                one = np.frombuffer(cells[k].as_buffer(), wide)
                if held and held + len(one) > BLOCK_IDS:
                    closed()
                docs.append(names.slice(k, 1))
                sizes.append(len(one))
                ids.append(one)
                held += len(one)
                if held >= BLOCK_IDS:
                    closed()
                if len(ready) >= TOGETHER or held > BLOCK_IDS * TOGETHER or ready and len(ready[-1][0]) > BLOCK_IDS * 2:
                    flushed()
        closed()
        flushed()
        if out is not None:
            # for readers without the manifest: where the blocks are
            out.write(json.dumps([[r[3], r[4], r[5]] for r in rows]).encode() + offset.to_bytes(8, "little") + b"IDSFILE1")
            out.close()
        columns = list(zip(*rows)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (
            pa.int32(), pa.string(), *[pa.int64()] * 6))], names=["shard", "file", "block", "offset", "length", "n_ids", "n_docs", "before"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-totals // FILE_IDS))
    order = ["id", "tie", "row"]  # the row number only keeps equal rows from falling into one range
    rows = tokens.select("id", "ids", F.xxhash64("ids").alias("tie"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = stored(rows.select("id", "ids").mapInArrow(run, MANIFEST), "blocks")
    # one row per file
    files = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    starts = np.concatenate([[0], np.cumsum([r["n"] for r in files])]).tolist()
    first = spark.createDataFrame([(r["shard"], s) for r, s in zip(files, starts)], "shard int, start long")
    model = [(int(i), int(freq[i])) for i in np.flatnonzero(freq)]
    spark.createDataFrame(model, "token int, freq int").coalesce(1).write.parquet(f"{path}/model")
    kind = tokens.schema["id"].dataType.json()
    manifest = blocks.join(F.broadcast(first), "shard").select(
        "shard", "file", "block", "offset", "length", "n_ids", "n_docs", (F.col("start") + F.col("before")).alias("start"), F.lit(kind).alias("id_type"))
    manifest.write.parquet(f"{path}/manifest")


def _model(spark, path):
    rows = spark.read.parquet(f"{path}/model").collect()  # at most one per token
    freq = np.zeros(max((r["token"] for r in rows), default=-1) + 1, "<u4")
    for r in rows:
        freq[r["token"]] = r["freq"]
    return spark.sparkContext.broadcast(freq.tobytes())


class _Opened:
    """The files of one task and the model."""

    def __init__(self, path, sent):
        self.files, where = fs.FileSystem.from_uri(f"{path}/blocks")
        self.where, self.model = where, ans.Model(np.frombuffer(sent.value, "<u4"))

    def block(self, row):
        with self.files.open_input_file(f"{self.where}/{row['file']}") as f:
            return ans.Block(f.read_at(row["length"], row["offset"]))


def _spread(manifest):
    total = manifest.agg(F.coalesce(F.sum("n_ids"), F.lit(0)).alias("n")).first()["n"]
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_IDS))
    return manifest.repartition(tasks, "shard", "block")


def read(spark, path):
    """(id, start, n, ids) of every document: ``start`` ids come before it, ``ids`` are 32-bit little-endian.

    Blocks are decoded in tasks of their own, the segments of a few blocks side by side;
    every checksum is tested, and one that does not fit raises ``ans.Damaged``.
    """
    sent, manifest = _model(spark, path), spark.read.parquet(f"{path}/manifest")
    first = manifest.select("id_type").first()
    kind = T._parse_datatype_json_string(first["id_type"]) if first else T.LongType()
    schema = T.StructType([T.StructField("id", kind), T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def documents(opened, rows):
        blocks = [opened.block(r) for r in rows]
        for row, block, ids in zip(rows, blocks, ans.decode([(b, 0, b.segments) for b in blocks], opened.model)):
            index = ipc.open_stream(block.index).read_all().combine_chunks()
            sizes = index.column("n").to_numpy()
            ends = np.cumsum(sizes)
            raw = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [index.column("id").chunk(0), pa.array(row["start"] + ends - sizes), pa.array(sizes),
                 pa.array([raw[e - n:e].tobytes() for e, n in zip(ends, sizes)], pa.binary())], names=["id", "start", "n", "ids"])

    def run(batches):
        opened, few, held = _Opened(path, sent), [], 0
        for b in batches:
            for row in b.to_pylist():
                if few and (held + row["n_ids"] > BLOCK_IDS * TOGETHER or len(few) == TOGETHER):
                    yield from documents(opened, few)
                    few, held = [], 0
                few.append(row)
                held += row["n_ids"]
        if few:
            yield from documents(opened, few)

    return _spread(manifest.select("shard", "file", "block", "offset", "length", "n_ids", "start")).mapInArrow(run, schema)


def between(spark, path, start, stop):
    """(start, ids) pieces that cover the ids ``start`` to ``stop`` of the whole stream.

    Only blocks that meet the range are opened, and in them only the segments between the
    checkpoints around it are decoded.
    """
    sent, manifest = _model(spark, path), spark.read.parquet(f"{path}/manifest")

    def run(batches):
        opened = _Opened(path, sent)
        for b in batches:
            for row in b.to_pylist():
                lo, hi = max(start - row["start"], 0), min(stop - row["start"], row["n_ids"])
                segment = lo // SEGMENT
                block = opened.block(row)
                ids = ans.decode([(block, segment, -(-hi // SEGMENT))], opened.model)[0][lo - segment * SEGMENT:hi - segment * SEGMENT]
                yield pa.RecordBatch.from_arrays([pa.array([row["start"] + lo]), pa.array([ids.tolist()], pa.list_(pa.int32()))], names=["start", "ids"])

    asked = manifest.where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    return asked.select("shard", "file", "block", "offset", "length", "n_ids", "start").mapInArrow(run, "start long, ids array<int>")


