"""Chat formatting by token-level assembly.

A turn is four pieces: the opening mark, the role, a separator, the text, and the closing mark.
Role and text are encoded as ordinary text, each for itself, so no token spans a border; marks
are ids beyond the vocabulary, spliced in between. Printed, a turn reads

    ### role: text</turn>

and a line feed. Control strings in content are escaped by a backslash (`\\###`, `\\</turn>`, and
`\\\\` for a backslash; a colon too in roles), which `unescape` undoes, so that neither ids nor
printed text can be forged by content. The loss mask covers the text pieces of assistant turns;
it is the prefix sum of +1 at their first token and -1 after their last.

Turns come in the order of (turn, role, text), nulls first; null roles and texts are empty; equal
rows stay as turns of their own. Rows with a null conv_id are one conversation. A conversation
may be of any length: turns are encoded where they lie, shuffled as ids, sorted, and read as a
stream. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import read_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"  #: read on the driver; tasks get its content
MARKS = ("### ", ": ", "</turn>\n")  #: printed forms of the reserved ids, in their order
OPEN, SEPARATOR, CLOSE = range(3)

_CONTENT = re.compile(r"\\|###|</turn>")
_ROLE = re.compile(r"\\|###|</turn>|:")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:)")
CONTROL = "\\### Assistant: </turn> ok"


def escape(text: str, role: bool = False) -> str:
    return (_ROLE if role else _CONTENT).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Tokens:
    """The vocabulary and the reserved ids beyond it."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(content)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.base = self.model.get_vocab_size(with_added_tokens=True)

    def encode(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.model.encode_batch(pieces, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist(), skip_special_tokens=False)

    def turn(self, role: np.ndarray, text: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray]:
        """ids and loss mask of one turn."""
        mark = [np.array([self.base + i], np.int32) for i in range(3)]
        ids = np.concatenate([mark[OPEN], role, mark[SEPARATOR], text, mark[CLOSE]])
        delta = np.zeros(len(ids) + 1, np.int8)
        if learn:
            first = len(role) + 2
            delta[first] += 1
            delta[first + len(text)] -= 1
        return ids, np.cumsum(delta)[:-1].astype(np.int8)

    def pieces(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(mark, start, end) of the content after each reserved id."""
        at = np.flatnonzero(ids >= self.base)
        yield from zip((ids[at] - self.base).tolist(), (at + 1).tolist(), [*at[1:].tolist(), len(ids)], strict=True)


def _vocabulary(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def turns(conversations: DataFrame, vocabulary) -> DataFrame:
    """(conv_id, turn, role, text_hash, ids, loss): each turn assembled where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(vocabulary.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                roles, texts = ([x or "" for x in b.column(c).to_pylist()] for c in (2, 3))
                role_ids, text_ids = tokens.encode([escape(r, True) for r in roles]), tokens.encode([escape(t) for t in texts])
                made = [tokens.turn(r, t, role == "assistant") for role, r, t in zip(roles, role_ids, text_ids, strict=True)]
                offsets = pa.array(np.cumsum([0, *(len(ids) for ids, _ in made)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([m[k] for m in made]))) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), *lists], ["conv_id", "turn", "role", "text", "ids", "loss"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, ids array<int>, loss array<byte>")


def assemble(conversations: DataFrame, vocabulary) -> DataFrame:
    """`turns`, with each conversation's turns together in one partition and in order."""
    return turns(conversations, vocabulary).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("text")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def digests(assembled: DataFrame, vocabulary) -> DataFrame:
    """One row a conversation, read back from ids and masks alone, as a stream over sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, now, state = Tokens(vocabulary.value), None, None

        def row() -> tuple:
            n, turn_hash, chars, loss_hash, printed, size, learned = state
            return now[0], n, turn_hash.hexdigest(), chars, loss_hash.hexdigest(), printed, size, learned

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            names, kinds = zip(*(x.split() for x in DIGESTS.split(", ")), strict=True)
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.string()) for c, k in zip(cols, kinds, strict=True)], list(names))

        for b in batches:
            rows = []
            for conv, ids, loss in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        rows.append(row())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                ids, loss = ids.values.to_numpy(), loss.values.to_numpy()
                for mark, a, z in tokens.pieces(ids):
                    shown = tokens.decode(ids[a:z])
                    state[4] += len(MARKS[mark]) + len(shown)
                    if mark == OPEN:
                        state[0] += 1
                        state[1].update(unescape(shown).encode() + b"\n")
                    elif mark == SEPARATOR:
                        state[1].update(unescape(shown).encode() + b"\n")
                edges = np.flatnonzero(np.diff(np.concatenate([[0], loss, [0]])))
                for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    text = unescape(tokens.decode(ids[a:z]))
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[5] += len(ids)
                state[6] += int(loss.sum())
            yield batch(rows)
        if now is not None:
            yield batch([row()])

    return assembled.select("conv_id", "ids", "loss").mapInArrow(run, DIGESTS)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(CONTROL).alias("text")) for i, r in enumerate(("user", "assistant"))]
    planted = spark.range(1).select(F.explode(F.array(*extra)).alias("x")).select("x.*")
    vocabulary = _vocabulary(spark, VOCABULARY)
    return digests(assemble(rows.union(planted), vocabulary), vocabulary)
