"""Byte-level BPE encoding and decoding by tree concatenation.

Texts longer than a leaf are cut into halves, wherever the middle falls, down to leaves.  The leaves of all texts at
hand are encoded in parallel; then neighbours are joined upwards: a window of tokens around each cut is encoded anew
and grows until both of its edges agree with the halves.

An edge agrees in one of two ways.  Some places are borders between pre-tokens in any context (a word's end before a
blank, a letter before a digit): what stands on either side is encoded alike with or without the other.  Within one
pre-token, a sequence of tokens is right exactly if each two neighbours encode to themselves, so there the window's
outermost tokens must fit the tokens outside.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tagloom.llm.common import only, scan, texts

#: Fixed value: the pre-token pattern of the public byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that \s stands for in the pattern.
BLANKS = "\t\n\v\f\r \x85\xa0                　"
#: Texts of more bytes than this are encoded as a tree of halves.
LEAF = 512
#: Tokens taken on each side of a join at first.
WINDOW = 2
#: Leaves are encoded by so many threads, so many leaves at a time.
THREADS, CHUNK = 2, 256
#: Pairs of kinds of characters between which there is always a border of pre-tokens.  A mark before a letter is none,
#: since contractions begin with one, nor is a blank before anything.
BORDERS = frozenset((a, b) for a in "LNP" for b in "LNPB" if a != b and (a, b) != ("P", "L"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Kinds(dict):
    """Kind of each character: L letter, N number, B blank, P any other; empty where no kind is certain."""

    def __missing__(self, c: str) -> str:
        category = unicodedata.category(c)
        kind = "B" if c in BLANKS else category[0] if category[0] in "LN" else "" if category == "Cn" else "P"
        self[c] = kind
        return kind


class Codec:
    """A vocabulary file of the ``tokenizers`` library, read as ranks.

    ``joined`` counts the bytes of all texts that were put together from leaves.
    """

    def __init__(self, path: str | None = None, leaf: int = LEAF, window: int = WINDOW, threads: int = THREADS):
        spec = json.loads(open(path or default_path(), encoding="utf-8").read())
        back, self.special = byte_alphabet(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        for i, pair in enumerate(spec["model"]["merges"]):  # ranks stand for merges only if both have one order
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if spec["model"]["vocab"][a + b] != 256 + i:
                raise ValueError("ids of merged tokens don't follow the order of merges")
        self.core = tiktoken.Encoding("tagloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=dict(self.special))
        self.size = {i: len(token) for token, i in ranks.items()}
        self.cut_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.leaf, self.window, self.kinds, self.joined = max(4, leaf), max(1, window), Kinds(), 0
        self.pool = ThreadPoolExecutor(threads)

    # -- encoding

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text, those of special tokens where their strings stand."""
        return self.encode_all([text])[0]

    def encode_all(self, many: list[str]) -> list[list[int]]:
        """:meth:`encode` of each text; the leaves of all are encoded together."""
        plan: list[list] = []  # of each text: ids of special tokens, and plain parts as (bytes, cuts)
        leaves: list[str] = []
        for text in many:
            parts, at = [], 0
            for m in self.cut_special.finditer(text) if self.cut_special else ():
                parts += [self._part(text[at : m.start()], leaves), self.special[m[0]]]
                at = m.end()
            plan.append([*parts, self._part(text[at:], leaves)])
        done = iter(self._leaves(leaves))
        out = []
        for parts in plan:
            ids: list[int] = []
            for p in parts:
                ids += [p] if isinstance(p, int) else self.tree(p[0], p[1], [next(done) for _ in p[1][1:]])
            out.append(ids)
        return out

    def _part(self, text: str, leaves: list[str]) -> tuple[bytes, list[int]]:
        """The bytes of a part and the borders of its leaves, which are added to ``leaves``."""
        data = text.encode()
        cuts = self.cuts(data)
        leaves += [text] if len(cuts) == 2 else [data[a:b].decode() for a, b in zip(cuts, cuts[1:], strict=False)]
        return data, cuts

    def cuts(self, data: bytes) -> list[int]:
        """Borders of the leaves: halves of halves, between characters."""
        out = [0, len(data)]
        while max(b - a for a, b in zip(out, out[1:], strict=False)) > self.leaf:
            middle = [(a + b) // 2 for a, b in zip(out, out[1:], strict=False)]
            middle = [next(m for m in range(m, -1, -1) if data[m] & 0xC0 != 0x80) for m in middle]
            if set(middle) <= set(out):  # single characters
                break
            out = sorted({*out, *middle})
        return out

    def _leaves(self, leaves: list[str]) -> list[list[int]]:
        encode = self.core.encode_ordinary
        chunks = [leaves[i : i + CHUNK] for i in range(0, len(leaves), CHUNK)]
        return [ids for done in self.pool.map(lambda chunk: [encode(s) for s in chunk], chunks) for ids in done]

    def tree(self, data: bytes, cuts: list[int], level: list[list[int]]) -> list[int]:
        """Ids of ``data`` from those of its leaves between ``cuts``, joined in pairs."""
        if len(level) > 1:
            self.joined += len(data)
        while len(level) > 1:
            pairs = range(0, len(level) - 1, 2)
            joined = [self.join(data, cuts[i], level[i], cuts[i + 1], level[i + 1], cuts[i + 2]) for i in pairs]
            level = joined + level[2 * len(pairs) :]
            cuts = cuts[:-1:2] + cuts[-1:]
        return level[0]

    def join(self, data: bytes, start: int, left: list[int], cut: int, right: list[int], end: int) -> list[int]:
        """Ids of data[start:end] from those of data[start:cut] and data[cut:end], encoded for themselves."""
        take = self.window
        while True:
            i, a, inside = self._edge(data, left[::-1] if take > 64 else left[: -take - 65 : -1], cut, -1, take, start, end, len(left))
            j, b, within = self._edge(data, right if take > 64 else right[: take + 64], cut, 1, take, start, end, len(right))
            middle = self.core.encode_ordinary(data[a:b].decode())
            if (not inside or self._fits(left[len(left) - i - 1], middle[0])) and (not within or self._fits(middle[-1], right[j])):
                return left[: len(left) - i] + middle + right[j:]
            take *= 2

    def _edge(self, data: bytes, tokens: list[int], cut: int, way: int, take: int, start: int, end: int, n: int) -> tuple[int, int, bool]:
        """Number of tokens from the cut to the first place, ``take`` or more away, that can be an edge; the place;
        and whether it lies within a pre-token.  The end of the half is an edge."""
        at = cut
        for i, token in enumerate(tokens, 1):
            at += way * self.size[token]
            if i >= take and i < n and (kind := self.edge(data, at, start, end)):
                return i, at, kind == "inside"
        if len(tokens) < n:  # no edge among the nearest tokens
            return n, start if way < 0 else end, False
        return n, at, False

    def edge(self, data: bytes, at: int, start: int, end: int) -> str:
        """'border' where pre-tokens of data[start:end] part in any case, 'inside' where one surely goes on, else ''."""
        if data[at] & 0xC0 == 0x80:
            return ""
        before = [self.kinds[c] for c in data[max(start, at - 12) : at].decode("utf-8", "ignore")[-3:]]
        after = [self.kinds[c] for c in data[at : min(end, at + 12)].decode("utf-8", "ignore")[:3]]
        if (before[-1], after[0]) in BORDERS:
            return "border"
        return "inside" if len(before) == 3 == len(after) and before[0] and len({*before, *after}) == 1 else ""

    def unit(self, piece: bytes) -> list[int]:
        """Ids of bytes that form one pre-token or a part of one."""
        return self.core._core_bpe.encode_single_piece(piece)

    def _fits(self, a: int, b: int) -> bool:
        return self.unit(self.core.decode_bytes([a, b])) == [a, b]

    # -- decoding

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, special tokens included; bytes that are no UTF-8 become replacement characters."""
        return self.core.decode_bytes(ids).decode("utf-8", "replace")


def encode_texts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, leaf: int = LEAF, emit: tuple[str, Callable] = ("ids array<int>, decoded string", lambda ids, decoded: (ids, decoded))) -> DataFrame:
    """Columns ``keep``, then what ``emit`` makes of the ids and the decoded text of every row.

    ``emit`` is a schema and a function; by default both come as they are (``ids``, ``decoded``), while a digest or a
    length spares moving the ids out of the Python worker.  Null and empty texts have no ids and decode to an empty
    text.  Each row is encoded for itself, however long, so repeated rows stay repeated and an empty table gives an
    empty one.  Other columns are left out.
    """
    extra = T.StructType.fromDDL(emit[0])
    schema = T.StructType([*docs.select(*keep).schema.fields, *extra.fields])

    def rows(batch: pa.RecordBatch, codec: Codec) -> list:
        made: list[list] = [[] for _ in extra.fields]
        for ids in codec.encode_all(texts(batch, text)):
            for column, value in zip(made, emit[1](ids, codec.decode(ids)), strict=True):
                column.append(value)
        return [*(batch.column(c) for c in keep), *made]

    return scan(only(docs, *dict.fromkeys((*keep, text))), rows, schema, lambda: Codec(path, leaf), limit=1 << 20)
