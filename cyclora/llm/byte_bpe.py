"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

The tokenizer is assembled from a file of ranks (base64 bytes and rank per
line). Every byte is written as one printable character (the byte table), each
match of the split pattern is encoded alone, and pairs are merged in order of
the rank of what they make. Decoding reverses the byte table: the characters
that the tokenizer shows for an id become bytes again, and the bytes of all
ids are joined before they are decoded, so that a character whose bytes are
spread over several ids comes back whole.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclora.sources.shared import spread

from .common import table

if TYPE_CHECKING:
    from tokenizers import Encoding

#: Pieces of text whose ids a task remembers at most; beyond that it starts afresh.
REMEMBERED = 600_000

#: White space and the rest as the split pattern means them (the regex module's \\s has four more characters).
_WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_table() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The bytes of each id, by id."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out = [b""] * (max(int(rank) for _, rank in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def tokenizer_json(tokens: list[bytes]) -> str:
    """A serialised tokenizer that merges by rank: any two neighbours whose bytes together are a token."""
    chars = byte_table()
    shown = ["".join(chars[b] for b in t) for t in tokens]
    known = {t: i for i, t in enumerate(tokens) if t}
    merges = [
        [shown[known[t[:k]]], shown[known[t[k:]]]]
        for t in tokens
        for k in range(1, len(t))
        if t[:k] in known and t[k:] in known
    ]
    return json.dumps(
        {
            "version": "1.0",
            "truncation": None,
            "padding": None,
            "added_tokens": [],
            "normalizer": None,
            "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
            "post_processor": None,
            "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
            "model": {
                "type": "BPE",
                "dropout": None,
                "unk_token": None,
                "continuing_subword_prefix": None,
                "end_of_word_suffix": None,
                "fuse_unk": False,
                "byte_fallback": False,
                "ignore_merges": True,
                "vocab": {shown[i]: i for i, t in enumerate(tokens) if t},
                "merges": merges,
            },
        }
    )


def split_pattern(pattern: str) -> str:
    """The pattern with \\s and \\S spelt out, for the regex module."""
    return pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\s", f"[{_WHITE}]").replace(r"\S", f"[^{_WHITE}]")


class Decoder:
    """Bytes of ids, by the byte table reversed."""

    def __init__(self, shown: list[str | None]) -> None:
        back = {ord(c): b for b, c in enumerate(byte_table())}
        #: The bytes of each id, from the characters that stand for it.
        self.tokens = [(x or "").translate(back).encode("latin-1") for x in shown]

    def bytes(self, ids: Iterable[int]) -> bytes:
        """The bytes that ids stand for; characters split between ids are joined again."""
        return b"".join(map(self.tokens.__getitem__, ids))

    def text(self, ids: Iterable[int]) -> str:
        """The text that ids stand for; bytes that are no UTF-8 are replaced."""
        return self.bytes(ids).decode("utf-8", "replace")


class Encoder:
    """Ids and offsets of texts; pieces that come again are looked up."""

    def __init__(self, spec: str, pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        size = 1 + max(self.tokenizer.get_vocab().values(), default=-1)
        self.decoder = Decoder([self.tokenizer.id_to_token(i) for i in range(size)])
        self.pieces = regex.compile(split_pattern(pattern)).findall
        self.known: dict[str, tuple] = {}
        self.digested: dict[str, tuple] = {}

    def forget(self) -> None:
        """Give the remembered pieces' memory back, for whatever the worker runs next."""
        self.known.clear()
        self.digested.clear()

    def _learn(self, known: dict[str, tuple], pieces: list[str], offsets: bool, made: Callable[[Encoding], tuple]) -> None:
        """Encode the pieces that are not known yet, each separately."""
        if len(known) > REMEMBERED:
            known.clear()
        new = [p for p in dict.fromkeys(pieces) if p not in known]
        run = self.tokenizer.encode_batch if offsets else self.tokenizer.encode_batch_fast
        known.update(zip(new, map(made, run(new, add_special_tokens=False)), strict=True))

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and digests of the ids (decimal, joined by spaces) and of the bytes decoded from them."""
        pieces, known = self.pieces(text), self.digested
        if not pieces:
            return 0, hashlib.sha256().hexdigest(), hashlib.sha256().hexdigest()
        try:
            found = [known[p] for p in pieces]
        except KeyError:
            self._learn(known, pieces, False, lambda x: (len(x.ids), " ".join(map(str, x.ids)), self.decoder.bytes(x.ids)))
            found = [known[p] for p in pieces]
        sizes, told, decoded = zip(*found, strict=True)
        return sum(sizes), hashlib.sha256(" ".join(told).encode()).hexdigest(), hashlib.sha256(b"".join(decoded)).hexdigest()

    def ids_and_offsets(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids, and the code points (start, end) of the text that each of them touches."""
        pieces = self.pieces(text)
        self._learn(self.known, pieces, True, lambda x: (x.ids, x.offsets))
        ids: list[int] = []
        starts: list[int] = []
        ends: list[int] = []
        at = 0
        for piece in pieces:
            some, spans = self.known[piece]
            ids += some
            starts += [at + a for a, _ in spans]
            ends += [at + b for _, b in spans]
            at += len(piece)
        return ids, starts, ends


@lru_cache(maxsize=1)
def _encoder(spec: str, pattern: str) -> Encoder:
    """The encoder of a worker process, which serves its tasks one after the other."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(spec, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, digests: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Encode the column ``text`` of ``docs``, one row out for each row in.

    Without ``digests`` the columns ``ids`` (array<int>), ``starts`` and
    ``ends`` (code points of the text that each id touches) and ``decoded``
    (the text from the ids) follow those in ``keep``. With ``digests`` they
    are n_tokens, ids_sha256 and decoded_sha256 instead.

    A null text counts as empty and has no ids. A text of any length is encoded
    whole. Repeated rows are encoded each on its own, an empty table gives an empty table, and further columns are
    ignored unless ``keep`` names them. A column of ``keep`` that has the name
    of a result is replaced by the result. ``ranks_path`` is read by the
    driver; the vocabulary (a fixed few MB) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(ranks_path)))
    kinds = (
        {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
        if digests
        else {"ids": "array<int>", "starts": "array<int>", "ends": "array<int>", "decoded": "string"}
    )
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in kinds]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    rows = spread(rows)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    types = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        try:
            for batch in batches:
                out: list[list] = [[] for _ in kinds]
                for cell in batch.column(batch.num_columns - 1):
                    text = cell.as_py()
                    if digests:
                        values: tuple = encoder.digests(text)
                    else:
                        ids, starts, ends = encoder.ids_and_offsets(text)
                        values = ids, starts, ends, encoder.decoder.text(ids)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                made = [pa.array(v, types[t]) for v, t in zip(out, kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *kinds])
        finally:
            encoder.forget()

    return rows.mapInArrow(run, ", ".join([*fields, *(f"{k} {t}" for k, t in kinds.items())]))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded bytes for every document."""
    import public_tokenizers

    return encode(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        digests=True,
    )
