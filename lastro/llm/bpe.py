"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Encoding reads text left to right and keeps a bounded buffer. Pieces (words,
digits, runs of signs) never merge with each other, so the end of a piece makes
all of its tokens stable. Inside a piece longer than the buffer, a token is
stable once it ends `lookahead` symbols before the end of what has been read.

The lookahead comes from the merge list. Take two texts with a common prefix and
apply the merges by rank. Both parses agree up to some boundary; rule (a, b) can
move that boundary only if `a` is the last token before it and `b` begins behind
it in one parse alone, and then by len(a). What begins behind it has the formerly
lost token on its left spine. So the total loss is at most the heaviest chain of
rules of rising rank in which each rule's right side has the previous rule's left
side on its left spine; one pass over the merge list finds it.

Over a batch of texts the buffers of all distinct pieces run in lockstep: each
round merges, in every piece, the pair of lowest rank. Memory depends on the
slice of text and on the vocabulary, not on the corpus or on a document's length
beyond its own text.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lastro.llm.common import RollingHash, held, importable, mix64, text_slices

SLICE_BYTES = 2 << 20
#: Symbols of a piece that wait at most, besides the lookahead; bytes of a longer piece that are read at once.
WINDOW, READ = 512, 4096
#: Ids that are decoded at once; characters that a long text is fed in.
BLOCK, FED = 4096, 1 << 18
SPACE, LETTER, NUMBER, OTHER = range(4)
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def stand_ins() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(others)) for b in range(256)]


def classes() -> np.ndarray:
    """For each code point: white space, letter, number or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    for cp in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        out[cp] = SPACE
    return out


def normal(text: str) -> str:
    """NFC, then lower case letter by letter (no final sigma)."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return "σ".join(x.lower() for x in text.split("Σ")) if "Σ" in text else text.lower()


def lookahead(merges: list[tuple[int, int]], made: list[int], size: dict[int, int]) -> int:
    """Symbols after which no continuation changes a token; see the module's text."""
    left = {new: a for (a, _), new in zip(merges, made, strict=True)}
    best: dict[int, int] = {}
    most = 0
    for a, b in merges:
        lost, s = 0, b
        while s is not None:
            lost = max(lost, best.get(s, 0))
            s = left.get(s)
        lost += size[a]
        best[a] = max(best.get(a, 0), lost)
        most = max(most, lost)
    return most


class WordBpe:
    """A byte-level BPE with word ends, read from a tokenizer's JSON text."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        end = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.byte = np.array([vocab[c] for c in stand_ins()], np.int64)
        self.byte_end = np.array([vocab[c + end] for c in stand_ins()], np.int64)
        top = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * top
        self.raw: list[bytes] = [b""] * top
        byte_of = {c: b for b, c in enumerate(stand_ins())}
        for text, i in vocab.items():
            self.tokens[i] = text.encode()
            word = text.endswith(end)
            self.raw[i] = bytes(byte_of[c] for c in text.removesuffix(end)) + (b" " if word else b"")
        for text, i in self.special.items():
            self.tokens[i] = self.raw[i] = text.encode()
        pairs = [(vocab[a], vocab[b]) for a, b in merges]
        made = [vocab[a + b] for a, b in merges]
        size = {i: len(t.removesuffix(end)) for t, i in vocab.items()}
        self.lookahead = lookahead(pairs, made, size)
        self.rank = {pair: (r, new) for r, (pair, new) in enumerate(zip(pairs, made, strict=True))}
        self._table(pairs, made)
        self.hash = RollingHash(0x9E3779B97F4A7C15)
        self.classes = classes()

    @cached_property
    def joins(self) -> np.ndarray:
        """For each code point, whether the normal form of what stands before it may change by it."""
        out = np.zeros(0x110000, bool)
        for cp in range(0x110000):
            c = chr(cp)
            out[cp] |= unicodedata.combining(c) > 0 or not unicodedata.is_normalized("NFC", c)
            parts = unicodedata.decomposition(c).split()
            if len(parts) == 2 and parts[0][0] != "<":
                out[int(parts[1], 16)] = True
        out[0x1161:0x1176] = out[0x11A8:0x11C3] = True  # vowels and finals of Hangul syllables
        return out

    def _table(self, pairs: list[tuple[int, int]], made: list[int]) -> None:
        """An open-addressing table from a pair to its rank and its token."""
        self.bits = 19
        size = 1 << self.bits
        self.keys, self.ranks, self.made = np.full(size, -1, np.int64), np.full(size, 1 << 30, np.int32), np.zeros(size, np.int32)
        keys = np.array([a << 17 | b for a, b in pairs], np.int64)
        for key, slot, rank, new in zip(keys.tolist(), self._slot(keys).tolist(), range(len(made)), made, strict=True):
            while self.keys[slot] != -1:
                slot = (slot + 1) % size
            self.keys[slot], self.ranks[slot], self.made[slot] = key, rank, new

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair; an empty one if it has no rule."""
        keys = a << 17 | b
        slot = self._slot(keys)
        found = self.keys[slot]
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[todo]]
            todo = todo[(found != keys[todo]) & (found != -1)]
        return slot

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Applies the merges to many pieces in lockstep; returns their tokens and token counts.

        symbols: all pieces' symbols, one piece after the other; sizes: each piece's symbols (1 or more).
        """
        count = len(sizes)
        word = np.repeat(np.arange(count), sizes)
        order = np.arange(len(symbols))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sym = symbols
        while len(sym):
            same = np.empty(len(sym), bool)
            same[-1] = False
            np.equal(word[1:], word[:-1], out=same[:-1])
            at = np.flatnonzero(same)
            slot = self._look(sym[at], sym[at + 1])
            rank = np.full(len(sym), 1 << 30, np.int32)
            rank[at] = self.ranks[slot]
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(sym)))
            live = np.repeat(least < 1 << 30, length)
            if not live.all():
                done.append((order[~live], sym[~live], word[~live]))
            hit = np.flatnonzero((rank == np.repeat(least, length)) & live)
            if len(hit) > 1:  # of equal symbols in a row, every other pair
                touching = np.flatnonzero(np.diff(hit) == 1)
                if len(touching):
                    keep, last = np.ones(len(hit), bool), -2
                    for k in np.unique(np.concatenate((touching, touching + 1))).tolist():
                        if hit[k] == last + 1:
                            keep[k] = False
                        else:
                            last = int(hit[k])
                    hit = hit[keep]
            new = sym.copy()
            made = np.zeros(len(sym), np.int64)
            made[at] = self.made[slot]
            new[hit] = made[hit]
            live[hit + 1] = False
            sym, word, order = new[live], word[live], order[live]
        if not done:
            return np.empty(0, np.int64), np.zeros(count, np.int64)
        order, sym, word = (np.concatenate(x) for x in zip(*done, strict=True))
        return sym[np.argsort(order, kind="stable")], np.bincount(word, minlength=count)

    def start(self, piece: bytes, ended: bool = True) -> np.ndarray:
        data = np.frombuffer(piece, np.uint8)
        out = self.byte[data]
        if ended and len(data):
            out[-1] = self.byte_end[data[-1]]
        return out

    def long_piece(self, piece: bytes) -> list[int]:
        """A piece of any length through a buffer of bounded length."""
        stream = PieceStream(self)
        out: list[int] = []
        for i in range(0, len(piece), READ):
            out += stream.feed(piece[i : i + READ])
        return out + stream.finish()

    def _pieces(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of distinct pieces given as bytes one after the other."""
        ends = np.cumsum(sizes)
        symbols = self.byte[data]
        symbols[ends - 1] = self.byte_end[data[ends - 1]]
        long = np.flatnonzero(sizes > self.lookahead + WINDOW)
        if not len(long):
            return self.merge(symbols, sizes)
        short = np.ones(len(sizes), bool)
        short[long] = False
        ids, counts = self.merge(symbols[np.repeat(short, sizes)], sizes[short])
        out, counts_all = [], np.zeros(len(sizes), np.int64)
        counts_all[short] = counts
        begin = np.concatenate(([0], np.cumsum(counts_all)))
        previous = 0
        for k in long.tolist():
            own = self.long_piece(data[ends[k] - sizes[k] : ends[k]].tobytes())
            out += [ids[previous : begin[k]], np.array(own, np.int64)]
            previous, counts_all[k] = begin[k], len(own)
        return np.concatenate([*out, ids[previous:]]), counts_all

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and where each text's ids begin (one more than texts).

        A text that is long and alone goes through StreamEncoder, so that only its ids grow with it.
        """
        if len(texts) == 1 and len(texts[0] or "") > SLICE_BYTES // 2:
            stream = StreamEncoder(self)
            fed = [np.array(stream.feed(texts[0][k : k + FED]), np.int64) for k in range(0, len(texts[0]), FED)]
            ids = np.concatenate([*fed, np.array(stream.finish(), np.int64)])
            return ids, np.array([0, len(ids)])
        parts: list[str] = []
        owner: list[int] = []
        marks: list[tuple[int, int]] = []  # before which part a special token stands
        for i, text in enumerate(texts):
            text = text or ""
            if self.special_re is not None and self.special_re.search(text):
                last = 0
                for m in self.special_re.finditer(text):
                    parts.append(normal(text[last : m.start()]))
                    owner.append(i)
                    marks.append((len(parts), self.special[m[0]]))
                    last = m.end()
                text = text[last:]
            parts.append(normal(text))
            owner.append(i)
        ids, begin = self._parts(parts)
        if marks:
            cut, extra = [x for x, _ in marks], [x for _, x in marks]
            ids = np.insert(ids, begin[cut], extra)
            begin = begin + np.searchsorted(np.array(cut), np.arange(len(begin)), side="right")
        first = np.searchsorted(np.array(owner), np.arange(len(texts) + 1), side="left")
        return ids, begin[first]

    def starts(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each code point's class, and whether a piece begins there. The last three may depend on what follows."""
        kind = self.classes[cp]
        start = kind != SPACE
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        sign = np.flatnonzero(start[:-1] & (cp[:-1] == ord("'")) & (kind[1:] == LETTER))
        if len(sign):
            one, two = cp[sign + 1], cp[np.minimum(sign + 2, len(cp) - 1)]
            size = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
            for pair in ("re", "ve", "ll"):
                size[(one == ord(pair[0])) & (two == ord(pair[1])) & (sign + 2 < len(cp))] = 2
            sign, size = sign[size > 0], size[size > 0]
            start[sign + 1] = False
            after = sign + 1 + size
            after = after[after < len(cp)]
            start[after[kind[after] == LETTER]] = True
        return kind, start

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        begin = np.concatenate(([0], np.cumsum(sizes)))
        cp = code_points("\n".join(parts) + "\n")
        kind, start = self.starts(cp)
        end = kind != SPACE
        end[:-1] &= (kind[1:] == SPACE) | start[1:]
        first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
        if not len(first):
            return np.empty(0, np.int64), np.zeros(len(parts) + 1, np.int64)
        code, where = self._distinct(cp, first, last)
        a, n = first[where], (last - first)[where]
        size = n + 1  # each distinct piece and a blank behind it
        close = np.cumsum(size)
        index = np.repeat(a - (close - size), size) + np.arange(close[-1])
        flat = cp[np.minimum(index, len(cp) - 1)]
        flat[close - 1] = 0x20
        data = np.frombuffer(flat.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        blank = np.flatnonzero(data == 0x20)
        ids, counts = self._pieces(data[data != 0x20], np.diff(blank, prepend=-1) - 1)
        offset = np.concatenate(([0], np.cumsum(counts)))
        each = counts[code]
        upto = np.concatenate(([0], np.cumsum(each)))
        out = ids[np.repeat(offset[code] - upto[:-1], each) + np.arange(upto[-1])]
        return out, upto[np.searchsorted(first, begin)]

    def _distinct(self, cp: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces cp[first:last], a number for each that equal pieces share, and for each number its first piece.

        Hashes propose what is equal; every piece is compared with the one that stands for it.
        """
        prefix = self.hash.prefix(mix64(cp.astype(np.uint64)))
        code, found = pd.factorize(self.hash.ranges(prefix, first, last))
        where = _first_of(code, len(found))
        size = last - first
        other = np.flatnonzero(where[code] != np.arange(len(code)))
        stand = where[code[other]]
        same = size[other] == size[stand]
        wrong, other, stand = other[~same], other[same], stand[same]
        if len(other):
            n = size[other]
            upto = np.cumsum(n) - n
            place = np.arange(n.sum())
            equal = cp[place + np.repeat(first[other] - upto, n)] == cp[place + np.repeat(first[stand] - upto, n)]
            wrong = np.concatenate((wrong, other[~np.logical_and.reduceat(equal, upto)]))
        if len(wrong):
            more: dict[bytes, int] = {}
            for k in np.sort(wrong).tolist():
                code[k] = more.setdefault(cp[first[k] : last[k]].tobytes(), len(found) + len(more))
            where = _first_of(code, len(found) + len(more))
        return code, where


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _first_of(code: np.ndarray, n: int) -> np.ndarray:
    """The first place of each number below n."""
    out = np.empty(n, np.int64)
    out[code[::-1]] = np.arange(len(code))[::-1]
    return out


class PieceStream:
    """One piece's bytes in, stable tokens out; holds a bounded buffer."""

    def __init__(self, bpe: WordBpe):
        self.bpe, self.buffer = bpe, b""

    def feed(self, data: bytes) -> list[int]:
        self.buffer += data
        if len(self.buffer) <= self.bpe.lookahead + WINDOW:
            return []
        # The piece goes on: its last symbol isn't the one that ends it.
        symbols = self.bpe.start(self.buffer, ended=False)
        ids, _ = self.bpe.merge(symbols, np.array([len(symbols)]))
        ends = np.cumsum([len(self.bpe.raw[i]) for i in ids.tolist()])
        stable = int(np.searchsorted(ends, len(self.buffer) - self.bpe.lookahead - 1, side="right"))
        if stable:
            self.buffer = self.buffer[ends[stable - 1] :]
        return ids[:stable].tolist()

    def finish(self) -> list[int]:
        data, self.buffer = self.buffer, b""
        return self.bpe.merge(self.bpe.start(data), np.array([len(data)]))[0].tolist() if data else []


class StreamEncoder:
    """Text in chunks of any size in, ids out as soon as they are stable; `held` is what waits.

    Three states follow each other. Raw text waits while a special token's string may have
    begun, and up to the last character that can't change the normal form of what stands
    before it. Normal text waits up to the last piece, of which WINDOW characters are held.
    A piece that outgrows them, of letters of any script or of signs, goes through
    PieceStream. So memory doesn't grow with the text; what normal forms need whole, a
    letter with all of its combining marks, is held whole.
    """

    def __init__(self, bpe: WordBpe):
        self.bpe, self.raw, self.tail = bpe, "", ""
        self.piece: PieceStream | None = None  # the piece that goes on, of characters of class `kind`
        self.kind = SPACE
        self.wait = max(1, *(len(s) - 1 for s in bpe.special)) if bpe.special else 1

    @property
    def held(self) -> str:
        return self.tail + self.raw

    def feed(self, chunk: str) -> list[int]:
        self.raw += chunk
        return self._release(False)

    def finish(self) -> list[int]:
        return self._release(True)

    def _release(self, ended: bool) -> list[int]:
        out: list[int] = []
        done, upto = 0, len(self.raw) - (0 if ended else self.wait)
        if self.bpe.special_re is not None:
            for m in self.bpe.special_re.finditer(self.raw):
                if m.start() >= upto:
                    break
                out += self._text(self.raw[done : m.start()], True)
                out.append(self.bpe.special[m[0]])
                done = m.end()
        if not ended:
            while upto > done and self.bpe.joins[ord(self.raw[upto])]:
                upto -= 1
        upto = max(upto, done)
        out += self._text(self.raw[done:upto], ended)
        self.raw = self.raw[upto:]
        return out

    def _text(self, text: str, closed: bool) -> list[int]:
        """Takes text whose normal form nothing that follows can change; closed: no piece goes on behind it."""
        self.tail += normal(text)
        out: list[int] = []
        while True:
            if self.piece is not None:
                kinds = self.bpe.classes[code_points(self.tail)]
                n = int(np.argmax(np.append(kinds, SPACE) != self.kind))
                data, self.tail = self.tail[:n].encode("utf-8", "surrogatepass"), self.tail[n:]
                for k in range(0, len(data), READ):
                    out += self.piece.feed(data[k : k + READ])
                if not self.tail and not closed:
                    return out
                out += self.piece.finish()
                self.piece = None
            if closed or len(self.tail) <= WINDOW:
                cut = len(self.tail) if closed else 0
            else:
                kind, start = self.bpe.starts(code_points(self.tail))
                blank, begun = np.flatnonzero(kind == SPACE), np.flatnonzero(start[: len(start) - 2])
                cut = max(int(blank[-1]) + 1 if len(blank) else 0, int(begun[-1]) if len(begun) else 0)
                if not cut:
                    self.piece, self.kind = PieceStream(self.bpe), kind[0]
                    continue
            if cut:
                out += self.bpe._parts([self.tail[:cut]])[0].tolist()
                self.tail = self.tail[cut:]
            if closed or len(self.tail) <= WINDOW:
                return out


class StreamDecoder:
    """Ids in, text out: a state machine over bytes that holds those of a character still incomplete.

    plain=True gives the text itself, from the bytes that tokens stand for (word ends as
    blanks). plain=False gives the token strings with a blank between them, as a tokenizer
    without a decoder prints them.
    """

    def __init__(self, bpe: WordBpe, plain: bool = True):
        self.bpe, self.plain, self.begun = bpe, plain, False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        if self.plain:
            return self.state.decode(b"".join([self.bpe.raw[i] for i in ids]))
        text = b" ".join([self.bpe.tokens[i] for i in ids])
        lead, self.begun = b" " * self.begun, True
        return self.state.decode(lead + text)

    def finish(self) -> str:
        return self.state.decode(b"", True)


_LOADED: dict[str, WordBpe] = {}


def loaded(source: str) -> WordBpe:
    """One instance for each vocabulary in a Python worker."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = WordBpe(source)
        held(_LOADED[key].hash)
    return _LOADED[key]


def vocabulary(df: DataFrame, path: str):
    """The vocabulary file's text, sent to the executors once; its size is that of a fixed file."""
    importable(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def decoded_digest(bpe: WordBpe, ids: np.ndarray) -> str:
    """SHA-256 of what StreamDecoder prints for the ids, a block at a time."""
    decoder, digest = StreamDecoder(bpe, plain=False), hashlib.sha256()
    for a in range(0, len(ids), BLOCK):
        digest.update(decoder.feed(ids[a : a + BLOCK].tolist()).encode())
    digest.update(decoder.finish().encode())
    return digest.hexdigest()


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Encodes every text and decodes it again; one row per row of docs.

    path: a tokenizer's JSON with a byte-level BPE and word ends. Returns doc_id,
    n_tokens, ids_sha256, decoded_sha256 and, if with_ids, ids. A null text counts
    as empty: no tokens, the digest of nothing. Repeated rows give repeated rows;
    null ids stay null; other columns of docs are ignored whatever their names.
    """
    source = vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(source.value)
        for batch in text_slices(batches, "text", SLICE_BYTES):
            ids, begin = bpe.encode(batch.column("text").to_pylist())
            wide = ids.astype("<u4")
            own = [wide[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            out = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(np.diff(begin), pa.int64()),
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in own],
                "decoded_sha256": [decoded_digest(bpe, x) for x in own],
            }
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    from pyspark.sql import functions as F

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
