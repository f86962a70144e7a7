"""BPE encoding by dynamic programming over prefixes, and decoding.

For each prefix of a word there is exactly one token that ends its encoding.
The tokens that end at a position come from a suffix automaton of the vocabulary: the word is
read once, the state tells the longest string of the vocabulary that ends here, and its suffix links
lead to the tokens among that string's suffixes, the longest first. Such a token ends the prefix if it goes with the last token of the
prefix before it: the pair is compatible when undoing both tokens' merges, latest
first, never shows a merge across their border that would have come earlier. So the table `last`
is filled from left to right and back-pointers give the exact ids.

Files are those of the tokenizers library with a BPE model and a word-end suffix, whose normaliser and pre-tokenizer don't look across
white space. So texts are cut at white space, by Arrow, and each distinct chunk is encoded once for as long as the cache holds it. Chunks of
printable ASCII and letters of Latin-1 are normalised and cut here; all others by the file's own normaliser and pre-tokenizer in the library, whose tables of letters,
compositions and cases differ from Python's.

Null and empty texts have no ids and decode to the empty text. Special tokens in a text become their ids, as in the library.
"""

from __future__ import annotations

import json
import os
import re
import struct
from array import array
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from sessionloom.llm.automaton import Automaton
from sessionloom.llm.common import Held, alone, parts, worker_cache, workers_find_package

#: Most texts are made of fewer pieces than chunks, which come with all kinds of signs.
CHUNKS_HELD, PIECES_HELD, PAIRS_HELD = 150_000, 300_000, 300_000
#: White space as the library knows it; str.split() also cuts at 0x1c to 0x1f.
_ODD_BLANKS = "\x1c\x1d\x1e\x1f"
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def chunks(text: str) -> list[str]:
    """The runs between white space."""
    if any(c in text for c in _ODD_BLANKS):
        return [x for x in _BLANKS.split(text) if x]
    return text.split()


#: White space beyond ASCII, for RE2.
WIDE_BLANKS = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def cut_all(texts, added: re.Pattern | None):
    """(chunks of all texts of an Arrow array one after another, number of each text's), both of Arrow, which cuts at white space. ASCII texts are lower-cased, as the library does.

    Texts with an added token are cut here; it comes with a blank before it, so that no chunk is taken for one. Some chunks may be empty.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = texts.take(pa.array(np.arange(len(texts))))  # a copy from 0 on: Arrow's lower case is wrong on slices of cast arrays
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if added is not None and pc.any(pc.match_substring_regex(texts, added.pattern)).as_py():
        plain = lambda part: chunks(part.lower() if part.isascii() else part)
        cut = [[c for k, part in enumerate(added.split(t)) for c in ([f" {part}"] if k % 2 else plain(part))] for t in texts.to_pylist()]
        return pa.array(list(chain.from_iterable(cut)), pa.large_string()), np.fromiter(map(len, cut), np.int64, len(cut))
    texts = pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), pc.replace_substring_regex(texts, WIDE_BLANKS, " "))
    cut = pc.ascii_split_whitespace(texts)  # blanks at the ends of a text make empty chunks, which have no ids
    return cut.flatten(), cut.value_lengths().to_numpy().astype(np.int64)


def laid_out(raw: list[bytes], codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, number of each text's), from each distinct chunk's ids as 32-bit little-endian, the chunks' numbers, and how many of these a text has."""
    width = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    first, n = np.cumsum(width) - width, width[codes]
    before = np.concatenate([[0], np.cumsum(n)])
    ids = np.frombuffer(b"".join(raw), "<u4")[np.repeat(first[codes] - before[:-1], n) + np.arange(before[-1])]
    return ids, np.diff(before[np.cumsum(sizes)], prepend=0)


def byte_letters() -> list[str]:
    """Byte -> the letter that byte-level vocabularies write for it: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Cutter:
    """A chunk between white space -> its pieces, spelled in byte letters, as the file's normaliser and pre-tokenizer make them."""

    #: Printable ASCII and the letters of Latin-1: composed already, and with the same case and class in any version of Unicode.
    _PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
    _LETTERS = "a-z\xdf-\xf6\xf8-\xff"
    #: What may follow a word as one piece: the apostrophe begins pieces of its own.
    _ENDS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        j = json.loads(spec)
        pattern = next(p["pattern"]["Regex"] for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # On plain chunks in lower case the file's classes are these.
        self._plain = re.compile(pattern.replace("\\p{L}", self._LETTERS).replace("\\p{N}", "0-9")).findall
        self._word = re.compile(f"([{self._LETTERS}]+)([{re.escape(self._ENDS)}]*)").fullmatch
        empty = Tokenizer.from_str(json.dumps({**j, "added_tokens": [], "model": {**j["model"], "vocab": {}, "merges": []}}))
        self._normal, self._cut = empty.normalizer.normalize_str, empty.pre_tokenizer.pre_tokenize_str
        self._letters = byte_letters()

    def pieces(self, chunk: str) -> list[str]:
        word = chunk.rstrip(self._ENDS)
        if word.isascii() and word.isalpha():
            return [word.lower()] if len(word) == len(chunk) else [word.lower(), chunk[len(word) :]]
        if not self._PLAIN(chunk):
            return [p for p, _ in self._cut(self._normal(chunk))]
        chunk = chunk.lower()
        word = self._word(chunk)
        got = self._plain(chunk) if word is None else [x for x in word.groups() if x]
        return got if chunk.isascii() else ["".join([self._letters[b] for b in p.encode()]) for p in got]


class WordBPE:
    END = 256  # stands for the word-end suffix; no byte

    def __init__(self, spec: str):
        j = json.loads(spec)
        model, suffix = j["model"], j["model"]["end_of_word_suffix"]
        self.tokens = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.cutter = Cutter(spec)
        ids = model["vocab"]
        self._code = {letter: b for b, letter in enumerate(byte_letters())}
        self.rank, self.made = {}, {}  # (left, right) -> rank; id -> (rank, left, right)
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = ids[a], ids[b]
            self.rank.setdefault(pair, r)
            self.made.setdefault(ids[a + b], (r, *pair))
        auto, own = Automaton(), {}
        #: Pieces that are one token: a token that its own spelling encodes to is what the whole piece encodes to.
        self.whole: dict[str, int] = {}
        for t, i in ids.items():
            ended = t.endswith(suffix) and t != suffix
            letters = [self._code.get(c, -1) for c in (t.removesuffix(suffix) if ended else t)]
            if -1 not in letters and self._stable(i, len(letters)):
                own[auto.add(letters + [self.END] * ended)] = i
                if ended:
                    self.whole[t.removesuffix(suffix)] = i
        self._go = {s << 9 | c: to for s, go in enumerate(auto.go) for c, to in go.items()}
        self._link, self._length = array("i", [max(0, s) for s in auto.link]), array("i", auto.length)
        # The token that a state's longest string is (-1: none), and the nearest state on its suffix links, itself included, that has one.
        self._token, self._near = array("i", [own.get(s, -1) for s in range(len(auto.go))]), array("i", [0] * len(auto.go))
        for s in sorted(range(1, len(auto.go)), key=auto.length.__getitem__):
            self._near[s] = s if s in own else self._near[auto.link[s]]
        self.goes = Held(lambda pair: self._compatible(pair >> 32, pair & 0xFFFFFFFF), PAIRS_HELD, None)
        self.fallen = Held(self._fall, PAIRS_HELD, None)
        self._spelled = None  # the tokens' spellings by id, for Arrow
        self.piece = Held(self._piece, PIECES_HELD)
        self.chunk = Held(self._chunk, CHUNKS_HELD)

    def _stable(self, token: int, letters: int) -> bool:
        """Whether the token's own spelling encodes to it: a letter, or made by a merge that nothing comes before."""
        if token not in self.made:
            return letters == 1
        _, a, b = self.made[token]
        return self._compatible(a, b, self.rank[a, b])

    def _compatible(self, left: int, right: int, bound: float = float("inf")) -> bool:
        """Whether left and right, side by side, stay two tokens: no merge across their border has a rank under the bound of its time."""
        rank, made = self.rank, self.made
        while True:
            across = rank.get((left, right))
            if across is not None and across < bound:
                return False
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):  # the left one was made last
                bound, left = a[0], a[2]
            else:  # of equal merges the left one comes first, so one across the border would have come before the right one
                bound, right = b[0] + 1, b[1]

    def _fall(self, key: int) -> tuple[int, int]:
        """(state, size of the match) after a sign that a state has no way for, by its suffix links; (0, 0) if none has."""
        state, c = key >> 9, key & 511
        while (to := self._go.get(state << 9 | c)) is None:
            if not state:
                return 0, 0
            state = self._link[state]
        return to, self._length[state] + 1

    def _piece(self, piece: str) -> bytes:
        """Ids as little-endian int32 of one piece in byte letters."""
        if (one := self.whole.get(piece)) is not None:
            return struct.pack("<i", one)
        word = [*piece.encode(), self.END] if piece.isascii() else [*[self._code[c] for c in piece], self.END]
        n = len(word)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        go, link, length, near, token, goes, fallen = self._go, self._link, self._length, self._near, self._token, self.goes, self.fallen
        state = size = 0
        for end, c in enumerate(word, 1):
            to = go.get(state << 9 | c)
            if to is not None:
                state, size = to, size + 1
            else:
                # Where suffix links lead from here doesn't hang on what came before, so it is kept.
                state, size = fallen[state << 9 | c]
                if not size:
                    continue
            # Tokens among the suffixes of what is matched: the state's longest string only if all of it is.
            at = near[state if length[state] == size else link[state]]
            while at:
                start = end - length[at]
                if start == 0 or (last[start] >= 0 and goes[last[start] << 32 | token[at]]):
                    last[end], back[end] = token[at], start
                    break
                at = near[link[at]]
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        out.reverse()
        return struct.pack(f"<{len(out)}i", *out)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space."""
        got = [self.piece[x] for x in self.cutter.pieces(chunk)]
        return got[0] if len(got) == 1 else b"".join(got)

    def decode(self, ids) -> str:
        """As the library does without a decoder: the tokens' spellings, one blank between. Ids that are no token are left out."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def encode_bytes(self, text: str | None) -> tuple[bytes, str]:
        """Ids as little-endian int32, and decoded text."""
        if not text:
            return b"", ""
        got = []
        for part in self._special.split(text) if self._special and any(x in text for x in self.special) else (text,):
            if part in self.special:
                got.append(struct.pack("<i", self.special[part]))
            else:
                got += map(self.chunk.__getitem__, chunks(part.lower() if part.isascii() else part))
        ids = b"".join(got)
        return ids, self.decode(np.frombuffer(ids, "<i4").tolist())

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text)[0], "<i4").tolist()

    def _found(self, chunk: str) -> bytes:
        return struct.pack("<i", self.special[chunk[1:]]) if chunk[:1] == " " else self.chunk[chunk]

    def encode_all(self, texts, decoded: bool = True):
        """(ids of all texts of an Arrow array one after another, number of each text's ids, decoded texts as an Arrow array or None).

        Only distinct chunks become Python's; numpy lays out the ids and Arrow the spellings of theirs.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        cut, sizes = cut_all(texts, self._special)
        coded = cut.dictionary_encode()
        got = list(map(self._found if self._special else self.chunk.__getitem__, coded.dictionary.to_pylist()))
        ids, n = laid_out(got, coded.indices.to_numpy(), sizes)
        if not decoded:
            return ids, n, None
        if self._spelled is None:
            self._spelled = pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.large_string())
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        return ids, n, pc.binary_join(pa.ListArray.from_arrays(ends, self._spelled.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))


@worker_cache
def tokenizer(spec: str) -> WordBPE:
    return WordBPE(spec)


def encode_decode(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), decoded: bool = True) -> DataFrame:
    """(id_col, *keep, ids array<int>, decoded string), one row for each row of documents. The file at path is read on the driver only."""
    spark = documents.sparkSession
    workers_find_package(spark)
    with open(path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    rows = documents.select(F.col(f"`{text_col}`").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in (id_col, *keep)])
    schema = StructType([*rows.schema.fields[1:], StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())][: None if decoded else -1])
    kinds = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        alone(tokenizer)
        bpe = tokenizer(sent.value)
        for batch in batches:
            for part in parts(batch, 0, 4 << 20):
                got, n, texts = bpe.encode_all(part.column(0), decoded)
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]).astype(np.int32)), pa.array(got.view("<i4")))
                columns = [*part.columns[1:], ids, *([texts] if decoded else [])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return rows.mapInArrow(run, schema)
