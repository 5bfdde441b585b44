"""Encoding and decoding with merge-type SentencePiece vocabularies."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.batches import slices, texts_of

DEFAULT = public_tokenizers.path("piece_bpe_32k.model")
#: Segments a worker remembers, and the longest it remembers.
REMEMBERED = 1_000_000
LONGEST = 48
_SPACE = "▁"
_NEVER = float("inf")
_SHORT = 32
_WORD = re.compile(r"[^\W\d_]")


class Pieces:
    """The vocabulary of a merge-type model and its way from text to ids and back.

    Encoding puts the adjacent symbol pairs that form a piece on an agenda by
    score, leftmost first among equals, and merges the best until none is left.
    A text is first cut where no piece reaches across, which cannot change the
    result, and what each segment gives is remembered.
    """

    def __init__(self, path: str, checked: bool = True):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.checked = checked
        n = self.library.vocab_size()
        names = self.library.id_to_piece(list(range(n)))
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(n)]
        if any(self.library.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not supported")
        self.ids = {p: i for i, p in enumerate(names) if not special[i]}
        self.costs = {p: -self.library.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        bytes_ = {int(names[i][3:5], 16): i for i in range(n) if self.library.is_byte(i)}
        self.byte_ids = [bytes_.get(b) for b in range(256)]
        self.unknown = self.library.unk_id()
        self.end = self.library.eos_id()
        if any(_SPACE in p.lstrip(_SPACE) for p in self.ids):
            raise ValueError("pieces with a blank after a letter are not supported")
        # Where no piece holds a letter next to another sign, runs of either merge by themselves.
        signs = re.escape("".join(sorted({c for p in self.ids for c in p if _WORD.match(c) and not c.isalpha()})))
        letter = re.compile(rf"[^\W\d_{signs}]")
        kinds = [[bool(letter.match(c)) for c in p.lstrip(_SPACE)] for p in self.ids]
        self.apart = all(a == b for k in kinds for a, b in zip(k, k[1:]))
        cut = rf"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+"
        if self.apart:
            cut = rf"{_SPACE}*[^\W\d_{signs}]+|{_SPACE}*(?:[^\w{_SPACE}]|[\d_{signs}])+|{_SPACE}+"
        self.segments = re.compile(cut).findall
        self.memory: dict[str, tuple[int, ...]] = {}

    def _single(self, symbol: str) -> list[int]:
        own = self.ids.get(symbol)
        if own is not None:
            return [own]
        fallback = [self.byte_ids[b] for b in symbol.encode("utf-8")]
        return [self.unknown] if None in fallback else fallback

    def merged(self, segment: str) -> tuple[int, ...]:
        """Ids of one segment."""
        symbols = self._merged_short(segment) if len(segment) <= _SHORT else self._merged_long(segment)
        out: list[int] = []
        for s in symbols:
            own = self.ids.get(s)
            if own is not None:
                out.append(own)
            else:
                out += self._single(s)
        return tuple(out)

    def _merged_short(self, segment: str) -> list[str]:
        """The agenda as a flat list beside the symbols: the first lowest cost is the next pair."""
        cost = self.costs.get
        symbols = list(segment)
        agenda = [cost(pair, _NEVER) for pair in map(str.__add__, symbols, symbols[1:])]
        while agenda:
            low = min(agenda)
            if low == _NEVER:
                break
            i = agenda.index(low)
            pair = symbols[i] + symbols[i + 1]
            symbols[i : i + 2] = [pair]
            del agenda[i]
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + pair, _NEVER)
            if i < len(agenda):
                agenda[i] = cost(pair + symbols[i + 1], _NEVER)
        return symbols

    def _merged_long(self, segment: str) -> list[str]:
        """The agenda as a heap, over linked symbols."""
        cost = self.costs.get
        symbols: list[str] = list(segment)
        n = len(symbols)
        agenda = []
        for i, pair in enumerate(map(str.__add__, symbols, symbols[1:])):
            if (c := cost(pair)) is not None:
                agenda.append((c, i, pair))
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, pair = heappop(agenda)
            j = after[i]
            # The entry is stale if either side has changed since.
            if j >= n or symbols[i] + symbols[j] != pair or not symbols[i]:
                continue
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                wider = pair + symbols[k]
                if (c := cost(wider)) is not None:
                    heappush(agenda, (c, i, wider))
            h = before[i]
            if h >= 0:
                wider = symbols[h] + pair
                if (c := cost(wider)) is not None:
                    heappush(agenda, (c, h, wider))
        return [s for s in symbols if s]

    def encode(self, text: str) -> list[int]:
        """Ids of a text as the library gives them, the end id last."""
        # The library's own normalization, with the blank it puts before a text and its sign for blanks.
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        cut = [self.segments(t) for t in map(self.library.normalize, texts)]
        memory, new = self.memory, {}
        for segments in cut:
            for s in segments:
                if s not in memory and s not in new:
                    new[s] = self.merged(s)
        if self.checked and new:
            self._check(new)
        both = new if not memory else memory | new if len(new) > len(memory) else None
        if both is None:
            memory.update(new)
            both = memory
        out = []
        for segments in cut:
            ids: list[int] = []
            for s in segments:
                ids += both[s]
            ids.append(self.end)
            out.append(ids)
        if len(both) > REMEMBERED:
            self.memory = {}
        else:
            for s in [s for s in new if len(s) > LONGEST]:
                both.pop(s, None)
            self.memory = both
        return out

    def _check(self, segments: dict[str, tuple[int, ...]]) -> None:
        """Each new segment that opens with one blank against the library, which adds that blank itself."""
        plain = [s for s in segments if s[0] == _SPACE and s[1:2] != _SPACE and len(s) > 1]
        for s, ids in zip(plain, self.library.encode([s[1:] for s in plain], num_threads=1)):
            if tuple(ids) != segments[s]:
                raise AssertionError(f"the library encodes {s!r} otherwise")

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@cache
def pieces(path: str, checked: bool = True) -> Pieces:
    """One vocabulary per file and Python worker."""
    return Pieces(path, checked)


def encoded(docs: DataFrame, path: str = DEFAULT, text: str = "text", keep: tuple[str, ...] = (), checked: bool = True) -> DataFrame:
    """The ``keep`` columns of ``docs`` with ``ids`` and ``decoded``, the library's text of the ids.

    Null text is the empty text, which has the end id alone; repeated rows get
    equal results; an empty table gives none.  With ``checked``, every new
    segment of a batch is compared with the library, and a difference fails
    the job.
    """
    return _mapped(docs, path, text, keep, checked, ("ids array<int>", "decoded string"), lambda ids, plain: (ids, plain))


def digests(docs: DataFrame, path: str = DEFAULT, text: str = "text", keep: tuple[str, ...] = (), checked: bool = True) -> DataFrame:
    """Like ``encoded``, with ``n_tokens`` and the SHA-256 of the ids in decimal and of the decoded text."""

    def digest(ids: list[int], plain: str):
        line = " ".join(map(str, ids)).encode()
        return len(ids), hashlib.sha256(line).hexdigest(), hashlib.sha256(plain.encode("utf-8")).hexdigest()

    return _mapped(docs, path, text, keep, checked, ("n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"), digest)


def _mapped(docs, path, text, keep, checked, columns, result) -> DataFrame:
    narrow = docs.select(*[F.col(k) for k in keep], F.col(text).cast("string").alias("_text"))
    names = [*keep, *[c.split(" ")[0] for c in columns]]
    types = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    kinds = [types[c.split(" ")[1]] for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path, checked)
        for part in slices(batches, "_text"):
            ids = own.encode_all(texts_of(part.column("_text")))
            rows = [result(i, d) for i, d in zip(ids, own.library.decode(ids, num_threads=1))]
            yield pa.record_batch([*[part.column(k) for k in keep], *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=names)

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]]
    return narrow.mapInArrow(run, ", ".join([*schema, *columns]))


def op2(docs: DataFrame) -> DataFrame:
    return digests(docs.select("doc_id", "text"), keep=("doc_id",))
