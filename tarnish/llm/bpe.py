"""Byte-pair encoding of whole corpora with a public tokenizer file.

Encoding and decoding give what the tokenizers library gives for the whole
text (no special tokens added, none skipped).  Two devices keep that cheap:

* White space ends every piece that the tokenizer merges within, so a task
  encodes each different word once and keeps the result (``WordEncoder``).
* A text over ``split_chars`` code points is encoded by tree concatenation:
  halves (of halves) are separate rows that tasks encode in parallel, and
  neighbours are joined by encoding a window around the seam again.  The
  window doubles until its tokens agree with one token of either side (same
  place, same id).  Tokens outside keep the neighbours they were merged
  with, and a sequence whose adjacent tokens are each a valid pair is the
  encoding of the text, so the join is exact; a window that reaches both
  ends is the plain encoding.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, prepare

#: Parameters: the tokenizer file, code points in a text that is not split,
#: first half-width of a window, and words that a task keeps.
TOKENIZER, SPLIT_CHARS, WINDOW, KEPT_WORDS = "word_bpe_49k.json", 65536, 32, 500_000
#: White space for str.split, but not for the tokenizer.
OTHER_SPACE = re.compile("[\x1c-\x1f]")

_loaded: dict[str, object] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    return name if "/" in name else public_tokenizers.path(name)


def tokenizer(name: str = TOKENIZER):
    """The file's tokenizer, one for each worker, without truncation or padding."""
    if name not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer_path(name))
        t.no_truncation()
        t.no_padding()
        _loaded[name] = t
    return _loaded[name]


#: Fixed values of the tokenizer file: its piece pattern, and the printable
#: stand-ins of its byte alphabet (other bytes follow from U+0100 on).
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


class Memo(dict):
    """Results of a function, kept by its argument."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class WordEncoder:
    """Ids of texts, word by word, for files whose pieces end at white space.

    Words of Latin letters and signs (all below U+0250, where normalisation
    is lower case only) are cut into pieces here and only pieces not met
    before go to the library's model; any other word goes through the
    library whole.
    """

    def __init__(self, name: str = TOKENIZER):
        self.tok, self.words, self.pieces = tokenizer(name), Memo(self.word), Memo(self.piece)
        self.model, self.find = self.tok.model, regex.compile(PIECE).findall
        others = (b for b in range(256) if b not in PRINTABLE)
        self.alphabet = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(others)}

    def piece(self, piece: str) -> bytes:
        plain = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.alphabet)
        return array("H", [t.id for t in self.model.tokenize(plain)]).tobytes()

    def word(self, word: str) -> bytes:
        if not word.isascii() and max(word) >= "\u0250" or "<|" in word:
            return array("H", self.tok.encode(word, add_special_tokens=False).ids).tobytes()
        low = word.lower()
        if low.isalpha():
            return self.pieces[low]
        if low[:-1].isalpha() and low[-1] in ".,!?:;":
            return self.pieces[low[:-1]] + self.pieces[low[-1]]
        return b"".join([self.pieces[p] for p in self.find(low)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 16-bit numbers."""
        out, known = [], self.words
        for text in texts:
            if text and OTHER_SPACE.search(text):
                out.append(array("H", self.tok.encode(text, add_special_tokens=False).ids).tobytes())
                continue
            for memo in (known, self.pieces):
                if len(memo) > KEPT_WORDS:
                    memo.clear()
            out.append(b"".join(map(known.__getitem__, (text or "").split())))
        return out


def word_encoder(name: str = TOKENIZER) -> WordEncoder:
    key = f"words:{name}"
    if key not in _loaded:
        _loaded[key] = WordEncoder(name)
    return _loaded[key]


class Tokens:
    """Ids with the code points that each token covers."""

    def __init__(self, ids, starts, ends):
        self.ids, self.starts, self.ends = (np.asarray(x, dtype=np.int64) for x in (ids, starts, ends))

    @classmethod
    def of(cls, text: str, at: int, name: str) -> Tokens:
        e = tokenizer(name).encode(text, add_special_tokens=False)
        spans = np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + at
        return cls(e.ids, spans[:, 0], spans[:, 1])

    def cut(self, a: int | None, b: int | None) -> Tokens:
        return Tokens(self.ids[a:b], self.starts[a:b], self.ends[a:b])

    @staticmethod
    def chain(parts: list[Tokens]) -> Tokens:
        return Tokens(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("ids", "starts", "ends")))


def _common(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the tokens that both have at the same place."""
    _, i, j = np.intersect1d(a.starts, b.starts, return_indices=True)
    same = (a.ids[i] == b.ids[j]) & (a.ends[i] == b.ends[j])
    return i[same], j[same]


def join_encodings(text: str, at: int, left: Tokens, right: Tokens, seam: int, name: str = TOKENIZER) -> Tokens:
    """Encoding of ``text`` (which starts at place ``at``) from those of its
    parts before and after ``seam``."""
    end, width = at + len(text), WINDOW
    while True:
        a, b = max(at, seam - width), min(end, seam + width)
        if a > at:  # from the start of a token
            k = int(np.searchsorted(left.starts, a))
            a = int(left.starts[k]) if k < len(left.starts) else a
        window = Tokens.of(text[a - at : b - at], a, name)
        if a <= at and b >= end:
            return window
        i, n = _common(window, left)
        j, m = _common(window, right)
        ok = window.ends[i] <= seam
        i, n = i[ok], n[ok]
        if (len(i) or a <= at) and (len(j) or b >= end):
            head = [left.cut(None, int(n[-1]) + 1)] if len(i) else []
            tail = [right.cut(int(m[0]) + 1, None)] if len(j) else []
            return Tokens.chain([*head, window.cut(int(i[-1]) + 1 if len(i) else None, int(j[0]) + 1 if len(j) else None), *tail])
        width *= 2


def safe_cut(text: str, near: int) -> int:
    """First place from ``near`` on where normalisation composes nothing
    across the cut (the text's end, if there is none)."""
    for p in range(max(near, 1), len(text)):
        a, b = text[max(0, p - 16) : p], text[p : p + 16]
        if unicodedata.normalize("NFC", a + b) == unicodedata.normalize("NFC", a) + unicodedata.normalize("NFC", b):
            return p
    return len(text)


def leaf_starts(text: str, split_chars: int) -> list[int]:
    """Where halving a text until no part is over ``split_chars`` cuts it."""
    out, todo = [0], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a > split_chars:
            c = safe_cut(text[a:b], (b - a) // 2) + a
            if c < b:
                out.append(c)
                todo += [(a, c), (c, b)]
    return sorted(out)


def concatenate(parts: list[tuple[int, str, Tokens]], name: str = TOKENIZER) -> Tokens:
    """Joins neighbouring (start, text, tokens) pairwise, up the tree."""
    while len(parts) > 1:
        up = []
        for k in range(0, len(parts) - 1, 2):
            (a, s, x), (b, t, y) = parts[k : k + 2]
            up.append((a, s + t, join_encodings(s + t, a, x, y, b, name)))
        parts = up + parts[len(up) * 2 :]
    return parts[0][2]


def tree_encode(text: str, split_chars: int = SPLIT_CHARS, name: str = TOKENIZER) -> np.ndarray:
    """Ids of one text by tree concatenation, in this process."""
    cuts = leaf_starts(text, split_chars)
    parts = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]
    return concatenate([(a, s, Tokens.of(s, a, name)) for a, s in zip(cuts, parts, strict=True)], name).ids


def encode(docs: DataFrame, finish, schema: str, *, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", split_chars: int = SPLIT_CHARS, name: str = TOKENIZER) -> DataFrame:
    """Encodes every text and hands ids to ``finish``.

    ``finish(columns, ids)`` gets the carried columns as a dict of lists and
    a list of uint16 arrays, and returns a dict of lists that fits
    ``schema``.  Null text is empty.  Rows are kept as they are, repeated
    ones too.  Texts over ``split_chars`` take the parallel path.
    """
    prepare(docs.sparkSession)
    arrow = _arrow_schema(docs.sparkSession, schema)
    docs = docs.select(*carry, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def whole(batches):
        enc = word_encoder(name)
        for b in batches:
            if b.num_rows:
                ids = [np.frombuffer(x, dtype=np.uint16) for x in enc.encode(b.column("_text").to_pylist())]
                yield pa.RecordBatch.from_pydict(finish({c: b.column(c).to_pylist() for c in carry}, ids), schema=arrow)

    short = docs.where(F.length("_text") <= split_chars).mapInArrow(whole, schema)
    carried = docs.select(*carry).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)
    piece = f"_row long, _leaf int, _at long, _part string, {fields}"
    piece_arrow = _arrow_schema(docs.sparkSession, piece)

    def halves(batches):
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for r in b.to_pylist():
                text = r.pop("_text")
                cuts = leaf_starts(text, split_chars // 2)
                yield pa.RecordBatch.from_pylist([{"_row": row, "_leaf": k, "_at": a, "_part": text[a:e], **r} for k, (a, e) in enumerate(zip(cuts, [*cuts[1:], len(text)], strict=True))], schema=piece_arrow)
                row += 1

    coded = f"{piece}, _ids array<long>, _starts array<long>, _ends array<long>"
    coded_arrow = _arrow_schema(docs.sparkSession, coded)

    def leaves(batches):
        for b in batches:
            for r in b.to_pylist():
                t = Tokens.of(r["_part"], r["_at"], name)
                yield pa.RecordBatch.from_pylist([{**r, "_ids": t.ids.tolist(), "_starts": t.starts.tolist(), "_ends": t.ends.tolist()}], schema=coded_arrow)

    def tree(rows: pa.Table) -> pa.Table:
        found = sorted(rows.to_pylist(), key=lambda r: r["_leaf"])
        ids = concatenate([(r["_at"], r["_part"], Tokens(r["_ids"], r["_starts"], r["_ends"])) for r in found], name).ids
        return pa.table(finish({c: [found[0][c]] for c in carry}, [ids.astype(np.uint16)]), schema=arrow)

    n = partitions(docs.sparkSession)
    long = docs.where(F.length("_text") > split_chars).mapInArrow(halves, piece).repartition(n, "_row", "_leaf").mapInArrow(leaves, coded)
    return short.unionByName(long.groupBy("_row").applyInArrow(tree, schema))


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def vocabulary(name: str = TOKENIZER) -> list[str]:
    key = f"vocabulary:{name}"
    if key not in _loaded:
        t = tokenizer(name)
        _loaded[key] = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
    return _loaded[key]


def decode(ids, name: str = TOKENIZER) -> str:
    """The library's decode for files without a decoder: tokens joined by a space."""
    return " ".join([vocabulary(name)[i] for i in ids])


def round_trip(documents: DataFrame, *, split_chars: int = SPLIT_CHARS, name: str = TOKENIZER) -> DataFrame:
    """Digest of every text's ids and of the text decoded from them.

    Null and empty text, and text of white space only, have no ids; their
    digests are those of the empty string.  Repeated rows and null doc_ids
    are kept; an empty table gives no rows; other columns are ignored.
    """

    def finish(columns, ids):
        numbers = [str(i) for i in range(len(vocabulary(name)))]
        lists = [x.tolist() for x in ids]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return {"doc_id": columns["doc_id"], "n_tokens": [len(x) for x in lists], "ids_sha256": [sha(" ".join([numbers[i] for i in x])) for x in lists], "decoded_sha256": [sha(decode(x, name)) for x in lists]}

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return encode(docs, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", split_chars=split_chars, name=name)
