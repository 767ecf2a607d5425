"""Byte-level BPE as a streaming transducer of bounded lookahead, and its incremental decoder.

``sufficient_lookahead`` derives from the merge list how many bytes to the right can still change a token boundary.
Rules apply in rank order. If two texts differ only to the right of a place D, one rule (x, y) can move D left by at most
the length of x, and the next rule that moves it further must rank later and have a right part that begins with x on
its left spine. The longest such chain, found in one sweep over the rules, bounds the change: boundaries further left
than that are stable whatever follows, and a token sequence cut at a boundary encodes both sides alike. So tokens
leave as soon as they are stable and memory stays constant, however long the text or one word of it.

Defined results: a null or empty text has no tokens and decodes to the empty text; the special tokens' strings in a
text are encoded as those tokens, as the tokenizers library does; decoding replaces bytes that are no UTF-8 with U+FFFD.
Columns other than the key and the text are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, tidied

#: The pattern that splits text before the merges (a fixed value of byte-level BPE files).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters pushed at a time; bytes of a longer piece merged at a time; pieces kept in the cache; longest cached piece.
CHUNK, BLOCK, CACHED, CACHED_CHARS = 1 << 16, 1 << 12, 1 << 17, 32


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {chr(b if b in plain else next(spare)): b for b in range(256)}


class Merges:
    """A vocabulary file's rules: ids of bytes, ranks of pairs, the bytes of ids and the special strings."""

    def __init__(self, source: str):
        data, letters = json.loads(source), byte_alphabet()
        vocab = data["model"]["vocab"]
        self.byte_id = [0] * 256
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.pairs: list[tuple[int, int, int]] = []
        for pair in data["model"]["merges"]:
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.append((vocab[x], vocab[y], vocab[x + y]))
        self.rank = {(x, y): r for r, (x, y, _) in enumerate(self.pairs)}
        self.made = [z for _, _, z in self.pairs]
        self.lookahead = sufficient_lookahead(self)


def sufficient_lookahead(m: Merges) -> int:
    """Bytes to the right of a boundary that can still change it; see the module's text."""
    left: dict[int, int] = {}
    best: dict[int, int] = {}
    known = set(m.byte_id)
    longest = 0
    for x, y, z in m.pairs:
        if x not in known or y not in known or z in left:
            raise ValueError("a rule's parts must be bytes or results of earlier rules, and each result have one rule")
        reach, v = 0, y
        while v is not None:
            reach, v = max(reach, best.get(v, 0)), left.get(v)
        far = len(m.bytes_of[x]) + reach
        best[x] = max(best.get(x, 0), far)
        longest = max(longest, far)
        left[z] = x
        known.add(z)
    return longest


def merge(m: Merges, data: bytes) -> list[int]:
    """Token ids of one piece: the pair of least rank first, the leftmost of equals."""
    ids = [m.byte_id[b] for b in data]
    rank, made, none = m.rank.get, m.made, len(m.made)
    if len(ids) <= 64:
        ranks = [rank(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            r = min(ranks)
            if r == none:
                break
            i = ranks.index(r)
            ids[i] = z = made[r]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((z, ids[i + 1]), none)
            if i:
                ranks[i - 1] = rank((ids[i - 1], z), none)
        return ids
    n = len(ids)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, *p) for i, p in enumerate(zip(ids, ids[1:])) if (r := rank(p, none)) < none]
    heapq.heapify(heap)
    while heap:
        r, i, x, y = heapq.heappop(heap)
        j = after[i] if ids[i] == x else -1
        if j < 0 or ids[j] != y:
            continue
        ids[i], ids[j] = made[r], -1
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
            p = ids[i], ids[after[i]]
            if (r := rank(p, none)) < none:
                heapq.heappush(heap, (r, i, *p))
        if (h := before[i]) >= 0:
            p = ids[h], ids[i]
            if (r := rank(p, none)) < none:
                heapq.heappush(heap, (r, h, *p))
    return [i for i in ids if i >= 0]


class PieceStream:
    """Bytes of one piece in, stable token ids out, in a buffer of BLOCK + lookahead bytes."""

    def __init__(self, m: Merges):
        self.m, self.held = m, bytearray()

    def push(self, data: bytes) -> list[int]:
        out: list[int] = []
        for i in range(0, len(data), BLOCK):
            self.held += data[i : i + BLOCK]
            if len(self.held) >= BLOCK + self.m.lookahead:
                stable, end = len(self.held) - self.m.lookahead, 0
                for t in merge(self.m, bytes(self.held)):
                    if end + len(self.m.bytes_of[t]) > stable:
                        break
                    end += len(self.m.bytes_of[t])
                    out.append(t)
                del self.held[:end]
        return out

    def finish(self) -> list[int]:
        out, self.held = merge(self.m, bytes(self.held)), bytearray()
        return out


class Encoder:
    """Text in, in chunks of any size; token ids out as soon as nothing that follows can change them."""

    def __init__(self, m: Merges):
        self.m, self.cache, self.older = m, {}, {}
        self.find = regex.compile(PIECES).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(m.special, key=len, reverse=True)))) if m.special else None
        self.kinds = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"\s+", r"[^\s\p{L}\p{N}]+")]
        self._reset()

    def _reset(self) -> None:
        self.tail = ""  # may begin a special string
        self.pending = ""  # pieces that what follows may change
        self.long: PieceStream | None = None  # a piece that outgrew the buffer, and the pattern of its characters
        self.kind = None

    def forget(self) -> None:
        """Drop the cache."""
        self.cache, self.older = {}, {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a whole piece. Two generations of the cache: when the younger is full it becomes the older."""
        ids = self.older.get(piece)
        if ids is None:
            data = piece.encode()
            if len(data) <= 2 * BLOCK:
                ids = tuple(merge(self.m, data))
            else:
                stream = PieceStream(self.m)
                ids = (*stream.push(data), *stream.finish())
        if len(piece) <= CACHED_CHARS:
            self.cache[piece] = ids
        return ids

    def _section(self, text: str, last: bool) -> list[int]:
        """Ids of a stretch without special strings; ``last``: it ends here."""
        out: list[int] = []
        text = self.pending + text
        self.pending = ""
        if self.long is not None:
            m = self.kind.match(text)
            end = m.end() if m else 0
            if end == len(text) and not last:
                self.pending = text[-1:]  # of white space, the last character may belong to what follows
                return self.long.push(text[:-1].encode())
            if self.kind is self.kinds[2] and end < len(text):
                end -= 1
            out += self.long.push(text[:end].encode()) + self.long.finish()
            self.long, text = None, text[end:]
        pieces = self.find(text)
        if not last:
            kept = 0
            while pieces and (not kept or kept < 3):
                kept += len(pieces.pop())
            while pieces and kept + len(pieces[-1]) < 3:
                kept += len(pieces.pop())
            self.pending = text[len(text) - kept :] if kept else ""
        if len(self.cache) >= CACHED:
            self.older, self.cache = self.cache, {}
        get = self.cache.get
        for p in pieces:
            out += get(p) or self._piece(p)
        if len(self.pending) >= BLOCK and len(self.find(self.pending)) == 1:
            self.kind = next(k for k in self.kinds if k.match(self.pending, len(self.pending) - 1))
            self.long, text, self.pending = PieceStream(self.m), self.pending[:-1], self.pending[-1:]
            out += self.long.push(text.encode())
        return out

    def push(self, text: str) -> list[int]:
        out: list[int] = []
        text = self.tail + text
        self.tail = ""
        if self.special is not None:
            at = 0
            for m in self.special.finditer(text):
                out += self._section(text[at : m.start()], True)
                out.append(self.m.special[m.group()])
                at = m.end()
            text = text[at:]
            hold = next((n for n in range(min(len(text), max(map(len, self.m.special)) - 1), 0, -1) if any(s.startswith(text[-n:]) for s in self.m.special)), 0)
            if hold:
                text, self.tail = text[:-hold], text[-hold:]
        return out + self._section(text, False)

    def finish(self) -> list[int]:
        out = self._section(self.tail, True)
        self._reset()
        return out

    def stream(self, text: str) -> Iterator[list[int]]:
        """Lists of ids of a whole text, chunk by chunk."""
        for i in range(0, len(text), CHUNK):
            yield self.push(text[i : i + CHUNK])
        yield self.finish()


class Decoder:
    """Token ids in; text out as soon as its bytes are whole characters."""

    def __init__(self, m: Merges):
        self.table = m.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out


_loaded: dict[int, tuple[Merges, Encoder, list[str]]] = {}


def _tools(source: str) -> tuple[Merges, Encoder, dict[int, str]]:
    """The tables of a vocabulary, made once in a worker process."""
    key = hash(source)
    if key not in _loaded:
        m = Merges(source)
        _loaded.clear()
        _loaded[key] = m, Encoder(m), {i: str(i) for i in m.bytes_of}
    return _loaded[key]


def _per_text(docs: DataFrame, source: str, key: str, text: str, one: Callable, schema: str) -> DataFrame:
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(source)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tools(held.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                ids, texts = batch.column(0).slice(i, 256), batch.column(1).slice(i, 256)
                rows = [one(tools, t.as_py() or "") for t in texts]
                names = list(rows[0])
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[c] for r in rows]) for c in names)], names=["doc_id", *names])
        tools[1].forget()  # the worker serves other tasks

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda b: tidied(run(b)), schema)


def _round_trip(tools: tuple, text: str) -> dict:
    m, encoder, decimal = tools
    ids_hash, text_hash, n, decoder = hashlib.sha256(), hashlib.sha256(), 0, Decoder(m)
    for ids in encoder.stream(text):
        if ids:
            ids_hash.update((("," if n else "") + ",".join(map(decimal.__getitem__, ids))).encode())
            n += len(ids)
            text_hash.update(decoder.push(ids).encode())
    text_hash.update(decoder.finish().encode())
    return {"n_tokens": n, "ids_sha256": ids_hash.hexdigest(), "decoded_sha256": text_hash.hexdigest()}


def round_trip(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``. ``vocabulary``: the file's path."""
    return _per_text(docs, open(vocabulary, encoding="utf-8").read(), key, text, _round_trip, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every text: ``doc_id, ids array<int>``."""

    def one(tools: tuple, text: str) -> dict:
        return {"ids": [i for ids in tools[1].stream(text) for i in ids]}

    return _per_text(docs, open(vocabulary, encoding="utf-8").read(), key, text, one, "doc_id long, ids array<long>")
