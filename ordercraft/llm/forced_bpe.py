"""BPE encoding by forced boundaries, and decoding.

A byte pair that lies inside no token of the vocabulary can never be joined by
a merge, whatever stands around it: between its two bytes there is a certain
cut. Texts are cut at all of them (white space first, then the pieces of the
tokenizer's own splitting rule, then the pairs inside a piece), every fragment
is encoded by itself with the vocabulary's merges, and the ids are concatenated. The last byte of a piece
carries the end mark, so the pair it ends has a table of its own, which cuts
more often. Fragments and short words repeat a lot; each task keeps a bounded
table of those it has encoded.

The vocabulary file is read once on the driver and travels with the tasks.
Texts are split piece by piece of 4 MB (at white space), so a very long text
takes little more memory than itself and its ids. Null and empty texts have no ids. Repeated rows are
encoded each. Nothing is shuffled.

The ids of a text are those of the ``tokenizers`` library without added
special tokens; the strings of special tokens in a text become their ids, as
the library has it. ``decode`` joins the tokens with blanks, the library's
rule for a vocabulary without a decoder.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import annotate, flat_text

VOCABULARY = "word_bpe_49k.json"
PIECE_BYTES = 4 << 20  # of a long text, split at a time
LONG = 64  # bytes from which a piece is cut by array operations
WORD_BYTES, CACHE_WORDS = 64, 400_000  # longest word and number of words that a task remembers

# The vocabulary's end mark and the forms that its splitting rule keeps whole.
END_MARK = "</w>"
SHORT_FORMS = "'s|'t|'re|'ve|'m|'ll|'d"
BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")
# Latin letters before U+0250 have no other normal form; for the separators and all
# other scripts the library's normaliser and splitter decide
LATIN = re.compile("[^\x1c-\x1f\u0250-\U0010ffff]*")


def read_vocabulary(path: str | None = None) -> str:
    """The text of the vocabulary file (default: the installed public one)."""
    import public_tokenizers
    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        return f.read()


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if
    it is printable Latin-1, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def latin_pieces() -> str:
    """The splitting rule for characters before U+0250: short forms, runs of letters,
    single digits, runs of anything else but white space."""
    kind = {c: unicodedata.category(chr(c))[0] for c in range(0x250)}
    letters, digits = ("".join(chr(c) for c in kind if kind[c] == k) for k in "LN")
    return f"{SHORT_FORMS}|[{letters}]+|[{digits}]|[^\\s{letters}{digits}]+"


class ForcedBoundaryEncoder:
    """Encodes the bytes of whole texts with the vocabulary in ``source`` (JSON)."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer, models
        spec = json.loads(source)
        vocab, added = spec["model"]["vocab"], spec["added_tokens"]
        library = Tokenizer.from_str(source)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.letters = dict(enumerate(letters))
        merges = [tuple(m) for m in spec["model"]["merges"]]
        # inside a piece, and with the end mark after the last byte
        self.models = [models.BPE(vocab, merges), models.BPE(vocab, merges, end_of_word_suffix=END_MARK)]
        self.names = [""] * (max([*vocab.values(), *(t["id"] for t in added)]) + 1)
        for name, i in vocab.items():
            self.names[i] = name
        self.special = {}
        for t in added:
            self.names[t["id"]] = t["content"]
            self.special[t["content"].encode()] = t["id"]
        marks = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.marks = re.compile(b"(" + b"|".join(marks) + b")") if marks else None
        self.latin_pieces = re.compile(latin_pieces())
        self.joins, self.last_joins = self._joins(vocab)
        self.words, self.ids = _Memo(self._word), _Memo(self._piece)

    def _joins(self, vocab) -> tuple[bytes, bytes]:
        """Whether some token holds the pair (256 x first + second), inside it or
        as its last two bytes before the end mark."""
        inside, at_end = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        for name in vocab:
            ends = name.endswith(END_MARK) and len(name) > len(END_MARK)
            b = [self.byte_of[c] for c in (name[:-len(END_MARK)] if ends else name)]
            pairs = [x << 8 | y for x, y in zip(b, b[1:])]
            if ends and pairs:
                at_end[pairs.pop()] = True
            inside[pairs] = True
        return inside.tobytes(), at_end.tobytes()

    # ------------------------------------------------------------ encoding

    def encode(self, raw: bytes) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if len(raw) <= PIECE_BYTES:
            return b"".join(map(self.words.__getitem__, raw.split()))
        out, at = [], 0
        while at < len(raw):
            blank = BLANK.search(raw, min(at + PIECE_BYTES, len(raw)))
            stop = blank.start() if blank else len(raw)
            out.append(b"".join(map(self.words.__getitem__, raw[at:stop].split())))
            at = stop
        return b"".join(out)

    def _word(self, word: bytes) -> bytes:
        """The ids of a run without ASCII white space."""
        if self.marks is None or b"<" not in word:
            return b"".join(map(self.ids.__getitem__, self.pieces(word)))
        return b"".join(_pack([self.special[part]]) if part in self.special
                        else b"".join(map(self.ids.__getitem__, self.pieces(part))) for part in self.marks.split(word))

    def pieces(self, word: bytes) -> list[str]:
        """The normalised pieces of a run that the vocabulary treats apart."""
        text = word.decode("utf-8", "replace")
        low = text.lower()
        if LATIN.fullmatch(text) and LATIN.fullmatch(low):
            return [low] if low.isalpha() else self.latin_pieces.findall(low)
        pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text)) if text else []
        return [bytes(map(self.byte_of.__getitem__, p)).decode("utf-8", "surrogateescape") for p, _ in pieces]

    def _piece(self, piece: str) -> bytes:
        out: list[int] = []
        for fragment, ends in self.cut(piece.encode("utf-8", "surrogateescape")):
            out += self._fragment(fragment, ends)
        return _pack(out)

    def cut(self, piece: bytes) -> list[tuple[bytes, bool]]:
        """``piece`` cut at its certain cuts; the last fragment bears the end mark."""
        n, joins = len(piece), self.joins
        if n == 1:
            return [(piece, True)]
        if n < LONG:
            at = [i for i in range(1, n - 1) if not joins[piece[i - 1] << 8 | piece[i]]]
        else:
            b = np.frombuffer(piece, np.uint8).astype(np.int64)
            apart = np.frombuffer(joins, np.uint8)[b[:-2] << 8 | b[1:-1]] == 0
            at = (np.flatnonzero(apart) + 1).tolist()
        if not self.last_joins[piece[-2] << 8 | piece[-1]]:
            at.append(n - 1)
        if not at:
            return [(piece, True)]
        return [(piece[i:j], j == n) for i, j in zip([0, *at], [*at, n])]

    def _fragment(self, fragment: bytes, ends: bool) -> list[int]:
        """The ids of one fragment, by the vocabulary's merges alone."""
        return [t.id for t in self.models[ends].tokenize(fragment.decode("latin-1").translate(self.letters))]

    # ------------------------------------------------------------ decoding

    def decode(self, packed: bytes) -> str:
        """The tokens of packed ids, joined with blanks."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(packed, "<u4").tolist()))


class _Memo(dict):
    """Results of ``make`` for short keys, bounded in number."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= WORD_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[key] = value
        return value


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def encode(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None,
           vocabulary: str | None = None, out: str = "bpe") -> DataFrame:
    """``docs`` (or its ``keep`` columns) with a struct column ``out``: ``ids``
    (binary: packed little-endian unsigned 32-bit integers) and ``decoded``, the
    text that these ids decode to. ``vocabulary`` is the path of the vocabulary
    file. An empty table gives an empty result; other columns stay as they are,
    and one that is already called ``out`` is replaced."""
    sc = docs.sparkSession.sparkContext
    source = sc.broadcast(read_vocabulary(vocabulary))  # a few MB, whatever the data

    def make():
        coder = ForcedBoundaryEncoder(source.value)

        def work(text):
            raw, off = flat_text(text)
            raw = raw.tobytes()
            ids = [coder.encode(raw[i:j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
            return [pa.array(ids, pa.binary()), pa.array([coder.decode(x) for x in ids], pa.string())]
        return work

    return annotate(docs, text_col, make, "ids binary, decoded string", out, keep, chunk_bytes=2 << 20)
