"""Token counts by batch encoding in an Arrow function that returns lengths only.

A vocabulary file decides the library: ``.json`` is read by ``tokenizers``,
``.model`` by ``sentencepiece``.  Counts are those of the library for the whole
text, without begin, end or other added tokens, padding or truncation; special
strings inside a text are treated as the library does by default.

Inside a task a text longer than ``piece_chars`` is split at safe boundaries,
the pieces of an Arrow batch are dealt to encoder calls of about equal bytes,
and only the number of tokens leaves a call: ids and strings of one call of
about ``BATCH_BYTES`` are all that is held.  Nothing is shuffled.

A boundary is safe when no token can cross it and the pieces' tokens are those
of the whole text:

* ``.json``: before a space that follows a letter or digit, between an ASCII
  letter and an ASCII digit, and before full-width punctuation after a letter.
  The pre-tokeniser ends a word there.  A vocabulary with an added token that
  holds white space, strips its surroundings or holds such a boundary is
  encoded without splitting.
* ``.model``: at a single space between two ASCII letters.  The space goes, the
  encoder's own leading word mark replaces it.  Only if every piece has word
  marks at its start alone and the encoder of a probe agrees, else no splitting.

A run without any safe boundary is encoded at once.

Cases: a null or empty text has 0 bytes and 0 tokens; repeated rows and ties
each get their row; an empty table gives none; carried columns with the name of
a made one are left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Bytes of text in one call of the encoder (about 50 bytes of memory each).
BATCH_BYTES = 1 << 20
#: Texts longer than this are split.
PIECE_CHARS = 1 << 16
MADE = ["n_bytes", "n_tokens", "over_limit"]

_WORD_END = re.compile(r"(?<=[^\W_])(?= )|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[^\W\d_])(?=[。，、！？；：])")
_SINGLE_SPACE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_MARK = "▁"


class Counter:
    """Token counts of a list of texts with one vocabulary file."""

    def __init__(self, path: str, piece_chars: int = PIECE_CHARS, batch_bytes: int = BATCH_BYTES):
        self.piece_chars, self.batch_bytes = piece_chars, batch_bytes
        self.cut = None
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            added = model.get_added_tokens_decoder().values()
            if not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) or _WORD_END.search(t.content) for t in added):
                self.cut = _WORD_END
            self.encode = lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            pieces = (model.id_to_piece(i).lstrip(_MARK) for i in range(model.get_piece_size()))
            if not any(_MARK in p for p in pieces) and model.encode("ab cd") == model.encode("ab") + model.encode("cd"):
                self.cut = _SINGLE_SPACE
        else:
            raise ValueError(f"no library for {path}")

    def pieces(self, text: str):
        """The text, or its pieces of about ``piece_chars`` characters."""
        i, n = 0, len(text)
        while self.cut is not None and n - i > self.piece_chars:
            at = self.cut.search(text, i + self.piece_chars)
            if at is None:
                break
            yield text[i:at.start()]
            i = at.end()
        yield text[i:] if i else text

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text; encoder calls of about equal bytes."""
        row, piece = [], []
        for i, text in enumerate(texts):
            if text:
                for p in self.pieces(text):
                    row.append(i)
                    piece.append(p)
        out = np.zeros(len(texts), np.int64)
        if not piece:
            return out
        size = np.cumsum([len(p.encode()) if not p.isascii() else len(p) for p in piece])
        calls = -(-int(size[-1]) // self.batch_bytes)
        cuts = np.unique(np.searchsorted(size, np.arange(1, calls) * (size[-1] / calls))).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(piece)]):
            if a < b:
                np.add.at(out, row[a:b], self.encode(piece[a:b]))
        return out


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, carry: list[str] | None = None,
                 piece_chars: int = PIECE_CHARS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``carry`` columns of ``docs`` (default: all) plus n_bytes (UTF-8), n_tokens and over_limit.

    ``tokenizer`` is a file name of the installed public vocabularies or a path
    that every executor can read.
    """
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in MADE]
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.col("text").alias("__tokens_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("over_limit", T.BooleanType())])

    def scan(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        path = tokenizer
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        counter = Counter(path, piece_chars, batch_bytes)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n = pa.array(counter.counts(texts.to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n_bytes, n, pc.greater(n, limit)], names=[*carry, *MADE])

    return rows.mapInArrow(scan, schema)
