"""Operator 10: BPE encoding and decoding.

The encoder never runs the merge loop over a word. Aho-Corasick gives every token that starts at every place; the
longest is tried first, and a token may follow another only if the pair is compatible, that is, if merging the two
tokens' own symbols gives back just these two. Where nothing fits, the last token is taken back and its start is closed,
so every place is left once at most and a word takes linear time. Decoding looks tokens up in one byte string by an
offset table.

Words repeat, so each Python worker keeps the codes of the pieces between white space that it has met, up to a bound.

The library's three Unicode tables are of different versions (letters and numbers 16, case 17, composition 9); the code
points in which the modules used here know more, or less, are stated below as ranges.

Defined results: a null text is an empty text: no tokens, the hash of nothing; a null id stays null; rows that repeat, or
tie in id or text, stay rows of their own; a text of any length is encoded whole, in memory of its own size times a few,
and batches are bounded by bytes; an empty table gives an empty result. Other columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bound_batches, by_value, pieces, read, worker_tables

by_value(__name__)

#: Of each kind a worker keeps twice this many codes at most.
KEEP_PIECES, KEEP_WORDS, KEEP_PAIRS = 60_000, 150_000, 150_000
_SPACE = "\t-\r \x85\xa0  -     　"
_ODD = regex.compile("[\x1c-\x1f]")

# Where the installed modules' Unicode tables differ from the tokenizers library's, as ranges of code points.
#: Letters and numbers that Unicode has only after version 16; the library takes them for other characters.
LATER_LETTERS = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20
18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE
1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: Marks that Unicode has only after version 9, and the second half of a later pair: to the library they are plain
#: characters, so nothing is composed or reordered across them.
LATER_MARKS = """7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50
10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42
16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"""
#: Capitals that the library knows and Python doesn't, each with its distance to the small letter.
LATER_CAPITALS = {"1C89": 1, "A7CB": 0x264 - 0xA7CB, "A7CC": 1, "A7CE": 1, "A7D2": 1, "A7D4": 1, "A7DA": 1, "A7DC": 0x19B - 0xA7DC, "10D50-10D65": 0x20, "16EA0-16EB8": 0x1B}


def _ranges(text: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b or a, 16)) for a, _, b in (r.partition("-") for r in text.split())]


def _class(text: str) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in _ranges(text))


_LATER = regex.compile(f"[{_class(LATER_LETTERS)}{_class(LATER_NUMBERS)}]")
_MARKS = regex.compile(f"([{_class(LATER_MARKS)}])")
#: The least code point of all these; texts below it need no look at them.
_HIGH = re.compile("[\u0558-\U0010ffff]")
_CAPITALS = {c: c + step for r, step in LATER_CAPITALS.items() for a, b in _ranges(r) for c in range(a, b + 1)}


def composed(text: str) -> str:
    """NFC, by parts where the text holds marks that aren't marks to the library."""
    if _HIGH.search(text) is None or _MARKS.search(text) is None:
        return unicodedata.normalize("NFC", text)
    return "".join(p if k % 2 else unicodedata.normalize("NFC", p) for k, p in enumerate(_MARKS.split(text)))

_END = "\U000f0000"  # stands for the end of a word in the search alphabet


def byte_alphabet() -> str:
    """The printable character of every byte: itself if printable in Latin-1, else the next from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return "".join(chr(b if b in set(shown) else 256 + hidden.index(b)) for b in range(256))


class Recent:
    """A bounded table that keeps what was used last: when the young half is full it becomes the old half."""

    def __init__(self, half: int):
        self.half, self.young, self.old = half, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value


class WordBPE:
    """A tokenizer file of the kind "lower case, words with an end mark, byte level"."""

    def __init__(self, file: str, decoding: bool = True):
        spec = json.loads(file)
        self.decoding, self.bare = decoding, set()
        model = spec["model"]
        vocab, self.mark = model["vocab"], model["end_of_word_suffix"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # \s of the tokenizer's engine, spelled out
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}"))
        # the same for words with letters or numbers of later versions
        letters, numbers = _class(LATER_LETTERS), _class(LATER_NUMBERS)
        exact = pattern.replace(r"[\p{L}]", rf"(?:(?![{letters}])\p{{L}})").replace(r"[\p{N}]", rf"(?:(?![{numbers}])\p{{N}})")
        self.exact = regex.compile(exact.replace(r"[^\s\p{L}\p{N}]", rf"(?:[{letters}{numbers}]|[^{_SPACE}\p{{L}}\p{{N}}])"))
        self.ids = vocab
        self.rank = {(a, b): i for i, (a, b) in enumerate(map(tuple, model["merges"]))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        self.names = names
        # the offset table: token i is blob[at[i]:at[i + 1]]
        blob, self.at = bytearray(), [0]
        for i in range(max(names) + 1):
            blob += names.get(i, "").encode()
            self.at.append(len(blob))
        self.blob = bytes(blob)
        self.alphabet = {i: c for i, c in enumerate(byte_alphabet())}
        self.search = ahocorasick.Automaton()
        for t, i in vocab.items():
            key = t[: -len(self.mark)] + _END if t.endswith(self.mark) and len(t) > len(self.mark) else t
            self.search.add_word(key, (i, len(key)))
        self.search.make_automaton()
        self.fits, self.words, self.known = Recent(KEEP_PAIRS), Recent(KEEP_WORDS), Recent(KEEP_PIECES)
        self.whole: dict[int, bool] = {}  # at most one entry a token

    def symbols(self, token: int) -> list[str]:
        """A token as the model's first symbols: characters, the last with the end mark if the token has it."""
        t = self.names[token]
        if t.endswith(self.mark) and len(t) > len(self.mark):
            t = t[: -len(self.mark)]
            return [*t[:-1], t[-1] + self.mark]
        return list(t)

    def merged(self, symbols: list[str]) -> list[str]:
        """Merging by rank, for short sequences: it fills the tables below."""
        rank, last = self.rank.get, len(self.rank)
        while len(symbols) > 1:
            pairs = list(zip(symbols, symbols[1:]))
            ranks = [rank(p, last) for p in pairs]
            best = min(ranks)
            if best == last:
                break
            pair = pairs[ranks.index(best)]
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def reachable(self, token: int) -> bool:
        """Whether merging the token's symbols gives the token."""
        if token not in self.whole:
            self.whole[token] = self.merged(self.symbols(token)) == [self.names[token]]
        return self.whole[token]

    def compatible(self, left: int, right: int) -> bool:
        """The pair-compatibility table, filled as pairs are met."""
        pair = left << 20 | right
        fit = self.fits.get(pair)
        if fit is None:
            # two tokens that merge with each other don't stay apart
            fit = (self.names[left], self.names[right]) not in self.rank and not self.names[left].endswith(self.mark) and self.merged(self.symbols(left) + self.symbols(right)) == [self.names[left], self.names[right]]
            self.fits.put(pair, fit)
        return fit

    def word(self, word: str) -> list[int]:
        """The word's tokens, by backtracking over the longest matches."""
        if word.isascii() and word.isprintable():  # these bytes' characters are themselves
            text = word + _END
        else:
            text = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet) + _END
        size = len(text)
        starts: list = [None] * size
        for end, match in self.search.iter(text):
            at = end - match[1] + 1
            if starts[at] is None:
                starts[at] = [match]
            else:
                starts[at].append(match)  # by length, as ends grow
        closed: set[int] = set()
        out: list[int] = []
        trail: list[tuple[int, list]] = []  # starts and what is left to try there
        whole, fits = self.whole, self.fits
        at, left, last = 0, starts[0], -1
        while at < size:
            while left:
                token, length = left.pop()
                if at + length in closed or not (whole.get(token) or self.reachable(token)):
                    continue
                if last < 0 or fits.young.get(last << 20 | token) or self.compatible(last, token):
                    out.append(token)
                    trail.append((at, left))
                    at += length
                    last = token
                    # a place is tried anew only if it isn't closed, so its list is whole then
                    left = starts[at].copy() if at < size and starts[at] else []
                    break
            else:
                if not trail:
                    raise ValueError(f"no encoding of {word!r}")
                closed.add(at)
                at, left = trail.pop()
                out.pop()
                last = out[-1] if out else -1
        return out

    def decode(self, ids) -> bytes:
        """Tokens joined by blanks, as a tokenizer without a decoder gives them."""
        blob, at = self.blob, self.at
        return b" ".join([blob[at[i] : at[i + 1]] for i in ids])

    def coded(self, word: str) -> tuple[bytes, bytes]:
        """A word's ids, packed, and their decoding."""
        code = self.words.young.get(word) or self.words.get(word)
        if code is None:
            ids = self.word(word)
            code = struct.pack(f"<{len(ids)}I", *ids), self.decode(ids) if self.decoding else b""
            if len(word) <= 64:
                self.words.put(word, code)
        return code

    def piece(self, piece: str) -> tuple[bytes, bytes]:
        """The same of a piece between white space."""
        ascii_ = piece.isascii()
        if ascii_ and piece.isalpha():  # letters alone are one word
            return self.coded(piece)
        pattern = self.pattern if ascii_ or _HIGH.search(piece) is None or _LATER.search(piece) is None else self.exact
        codes = [*map(self.coded, pattern.findall(piece))]
        if len(codes) == 1:
            return codes[0]
        return b"".join([c[0] for c in codes]), b" ".join([c[1] for c in codes])

    def plain(self, text: str) -> list[tuple[bytes, bytes]]:
        """Codes of a text without special tokens, by its pieces between white space."""
        if not text.isascii():
            # lower case by character: no final sigma
            text = composed(text).replace("Σ", "σ")
            if _HIGH.search(text) is not None:
                text = text.translate(_CAPITALS)
        text = text.lower()
        found = regex.split(f"[{_SPACE}]+", text) if _ODD.search(text) else text.split()
        known, bare = self.known, self.bare
        out = [*map(known.young.get, found)]
        if None in out:
            for i, p in enumerate(found):
                if out[i] is None:
                    code = known.get(p)
                    if code is None:
                        code = self.piece(p)
                        if not code[0]:
                            bare.add(p)
                        if len(p) <= 64:
                            known.put(p, code)
                    out[i] = code
        if bare and not bare.isdisjoint(found):  # pieces without a word
            out = [c for c in out if c[0]]
            if len(bare) > KEEP_PIECES:
                bare = self.bare = set()
                known.young, known.old = {}, {}
        return out

    def encode(self, text: str) -> list[tuple[bytes, bytes]]:
        if self.split_special is None or "<|" not in text:
            return self.plain(text)
        out = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append((struct.pack("<I", self.special[part]), self.decode([self.special[part]])))
            else:
                out += self.plain(part)
        return out


def encoder(file: str, decoding: bool = True) -> WordBPE:
    """One encoder for each worker and tokenizer file's content; without decoding its codes hold the ids alone."""
    cache = worker_tables("bpe")
    key = hash(file), decoding
    if key not in cache:
        cache[key] = WordBPE(file, decoding)
    return cache[key]


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, tokens: bool = False) -> DataFrame:
    """Per row of docs: its id, n_tokens, ids_sha256, decoded_sha256; with tokens also ids and decoded. The tokenizer
    file is read by the driver and broadcast (its size does not depend on the data)."""
    spark = docs.sparkSession
    bound_batches(spark)
    with open(path or default_file(), encoding="utf-8") as f:
        file = spark.sparkContext.broadcast(f.read())
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches):
        model = encoder(file.value)
        for batch in batches:
            for ids, texts in pieces(batch, ["id", "text"]):
                n, sha, back, blobs, outs = [], [], [], [], []
                for text in texts:
                    codes = model.encode(text)
                    blob = b"".join([c[0] for c in codes])
                    decoded = b" ".join([c[1] for c in codes])
                    n.append(len(blob) // 4)
                    sha.append(hashlib.sha256(blob).hexdigest())
                    back.append(hashlib.sha256(decoded).hexdigest())
                    if tokens:
                        blobs.append(blob)
                        outs.append(decoded.decode())
                cols = [pa.array(ids, type=batch.schema.field("id").type), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if tokens:
                    cols += [pa.array(blobs, pa.binary()), pa.array(outs)]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if tokens else "")
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"))
